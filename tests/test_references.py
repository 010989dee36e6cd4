import json
import random

import pytest
from pyspark.sql import functions as F

from veinwork.functions import paths
from veinwork.operators import detectors, globjoin, references, targets
from veinwork.plans import scan as plan
from veinwork.sources import settings


def tree_of(spark, files, app="app"):
    return spark.createDataFrame([(app, p, t) for p, t in files.items()], "app string, path string, text string")


def named_edges(c, df):
    path = c.files.select("id", "path")
    found = df.join(path.select(F.col("id").alias("src"), F.col("path").alias("a")), "src", "left").join(path.select(F.col("id").alias("dst"), F.col("path").alias("b")), "dst")
    return sorted((tuple(r[x] for x in ("a", "b", *[k for k in df.columns if k == "kind"])) for r in found.collect()), key=str)


def test_references_of_any_kind_keep_files_alive(spark):
    tree = tree_of(spark, {
        "src/a.ts": "import type { T } from './type'\nimport raw from './raw?raw'\nexport { x } from './again'\nconst l = import('./lazy')\nrequire('./old')\nimport { v } from './value.js'\nconst p = import.meta.glob(['./l/*.ts', '!./l/no*'])\n// import.meta.glob('./**')",
        "src/type.ts": "import './a'", "src/raw.ts": "", "src/again.ts": "", "src/lazy.ts": "", "src/old.ts": "", "src/value.ts": "", "src/setup.ts": "", "src/page.ts": "",
        "src/tested.ts": "", "src/tested.test.ts": "import './tested'", "src/nobody.ts": "import './nobody'", "src/byjs.ts": "", "src/bytestjs.ts": "", "src/l/one.ts": "", "src/l/two.ts": "", "src/l/no.ts": "", "src/c/d/in.ts": "require.context('../e', true, /\\.\\/k[^/]*$/)", "src/c/e/k1.ts": "", "src/c/e/f/k2.ts": "", "src/c/e/m.ts": "import '../d/in'",
    })
    others = tree_of(spark, {"vitest.config.mjs": "export default { setupFiles: ['<rootDir>/src/setup.ts', 'src/page.ts', 'nothing'] }", "tools/x.js": "import '../src/byjs'", "tools/x.test.js": "require('../src/bytestjs')"})
    c = plan.codebase(tree, referrers=others)
    kinds = {(a, b): k for a, b, k in named_edges(c, c.references)}
    a = "src/a.ts"
    assert {b: k for (x, b), k in kinds.items() if x == a} == {"src/type.ts": "type", "src/raw.ts": "import", "src/again.ts": "reexport", "src/lazy.ts": "dynamic", "src/old.ts": "require", "src/value.ts": "import", "src/l/one.ts": "loader", "src/l/two.ts": "loader"}
    assert kinds[None, "src/setup.ts"] == kinds[None, "src/page.ts"] == "config"
    assert (a, "src/type.ts") not in named_edges(c, c.edges) and (a, "src/raw.ts") in named_edges(c, c.edges)
    assert sorted(map(tuple, c.orphans().collect())) == [("src/bytestjs.ts", "test_only"), ("src/c/e/f/k2.ts", "orphan"), ("src/c/e/m.ts", "orphan"), ("src/l/no.ts", "orphan"), ("src/nobody.ts", "orphan"), ("src/tested.ts", "test_only")]
    c.close()


def test_handlers_that_reach_leaves_through_barrels(spark):
    files = {f"src/views/v{k}.tsx": "" for k in range(6)} | {
        "src/api/a.controller.ts": "import { v } from './lib'", "src/api/b.controller.ts": "import { v } from '../views/v1'", "src/api/c.controller.ts": "import type { v } from './lib'",
        "src/api/lib.ts": "export * from './deeper'", "src/api/deeper.ts": "export { v } from '../views/v0'\nexport * from './lib'", "src/api/plain.controller.ts": "import './code'", "src/api/code.ts": "export * from '../views/v0'\nexport const x = 1",
    }
    c = plan.codebase(tree_of(spark, files))
    patterns = {"AP-001": c.database, "AP-002": "(^|/)(views)(/|$)"}
    found = {r["rule_id"]: (r["population"], r["violators"]) for r in plan.families(c, patterns)["forbidden-imports"].collect()}
    assert found == {"AP-001": (4, 0), "AP-002": (4, 2)}
    broken = sorted(tuple(r) for r in plan.broken(c, patterns).filter("family = 'forbidden-imports'").select("file", "subject").collect())
    assert broken == [("src/api/a.controller.ts", "./lib"), ("src/api/b.controller.ts", "../views/v1")]
    c.close()


MONOREPO = {
    "package.json": {"name": "root", "workspaces": ["packages/*", "apps/**", "!apps/no"]},
    "tsconfig.json": {"compilerOptions": {"paths": {"@/*": ["./root/*"]}}},
    "apps/a/package.json": {"name": "a", "dependencies": {"left": "1", "@w/lib": "*"}, "imports": {"#db": "./src/db.ts", "#x/*": {"node": "./src/x/*.ts", "types": "./src/x/*.d.ts"}, "#x/y*.js": "./src/special/*.ts"}},
    "apps/a/tsconfig.json": {"extends": "./base", "compilerOptions": {}},
    "apps/a/base.json": {"extends": ["../shared/one.json", "../shared/two"], "compilerOptions": {"strict": True}},
    "apps/shared/one.json": {"compilerOptions": {"paths": {"@/*": ["./wrong/*"]}}},
    "apps/shared/two.json": {"extends": "./one.json", "compilerOptions": {"baseUrl": "../a", "paths": {"@/*": ["./missing/*", "./src/*"], "@": ["./src/index.ts"], "w/*": ["./src/*/deep.ts"]}}},
    "apps/b/package.json": {"name": "b", "dependencies": {"react-native": "1"}},
    "apps/b/tsconfig.json": {"compilerOptions": {"paths": {"@/*": ["./lib/*"], "own/*": ["./own/*"]}}, "references": [{"path": "./tsconfig.node.json"}, {"path": "./other"}]},
    "apps/b/tsconfig.node.json": {"compilerOptions": {"paths": {"@/*": ["./never/*"], "node/*": ["./lib/*"], "two/*": ["./lib/*"]}}},
    "apps/b/other/tsconfig.json": {"compilerOptions": {"paths": {"two/*": ["./lib/*"]}}},
    "packages/lib/package.json": {"name": "@w/lib", "exports": {".": {"types": "./dist/i.d.ts", "default": "./src/i.ts"}, "./sub": "./src/sub.js", "./icons/*": "./src/icons/*.ts", "./icons/a-*": "./src/a/*.ts", "./none/*": None}},
    "packages/lib/src/no/package.json": {"name": "inner"},
    "other/away/package.json": {"name": "@w/away"},
}


def settings_of(spark, files, app="app"):
    text = {p: t if isinstance(t, str) else "// comment\n" + json.dumps(t)[:-1] + ",}" for p, t in files.items()}
    return tree_of(spark, text, app)


def test_two_apps_of_one_repository_keep_their_aliases_apart(spark):
    sources = {
        "apps/a/src/m.ts": "import '@/ui'\nimport '@'\nimport 'w/q'\nimport 'src/ui'\nimport 'left/x'\nimport 'right'\nimport 'a/src/ui'", "apps/a/src/ui.ts": "", "apps/a/src/index.ts": "", "apps/a/src/q/deep.ts": "", "root/ui.ts": "",
        "apps/b/m.ts": "import '@/ui'\nimport 'own/z'\nimport 'node/ui'\nimport 'two/ui'", "apps/b/lib/ui.ts": "", "apps/b/own/z.ts": "", "apps/b/never/ui.ts": "", "apps/shared/wrong/ui.ts": "", "tool.ts": "import '@/ui'", "apps/shared/wrong/x.ts": "",
    }
    c = plan.codebase(tree_of(spark, sources), written=settings_of(spark, MONOREPO))
    assert named_edges(c, c.edges) == [
        ("apps/a/src/m.ts", "apps/a/src/index.ts"), ("apps/a/src/m.ts", "apps/a/src/q/deep.ts"), ("apps/a/src/m.ts", "apps/a/src/ui.ts"),
        ("apps/b/m.ts", "apps/b/lib/ui.ts"), ("apps/b/m.ts", "apps/b/own/z.ts"), ("tool.ts", "root/ui.ts"),
    ]
    phantom = sorted(r["subject"] for r in plan.broken(c).filter("family = 'phantom-deps'").select("subject").collect())
    assert phantom == ["right", "two/ui"]  # two configurations map "two" differently: neither counts
    c.close()


def test_imports_of_packages_and_hash_names_make_edges(spark):
    sources = {
        "apps/a/src/m.ts": "import '@w/lib'\nimport '@w/lib/sub'\nimport '@w/lib/icons/b'\nimport '@w/lib/icons/a-c'\nimport '@w/lib/src/no/k'\nimport '@w/away'\nimport '#db'\nimport '#x/k'\nimport '#x/yes.js'\nimport '@w/lib/none/z'",
        "apps/a/src/db.ts": "", "apps/a/src/x/k.ts": "", "apps/a/src/special/es.ts": "", "packages/lib/src/i.ts": "", "packages/lib/src/sub.ts": "", "packages/lib/src/icons/b.ts": "", "packages/lib/src/a/c.ts": "",
        "packages/lib/src/no/k.ts": "import '#db'\nimport './near'", "packages/lib/src/no/near.ts": "", "apps/b/m.ts": "import './w'\nimport '#db'", "apps/b/w.ts": "", "apps/b/w.ios.ts": "", "apps/b/w.native.ts": "", "packages/lib/none/z.ts": "",
        "other/away/index.ts": "",
    }
    c = plan.codebase(tree_of(spark, sources), written=settings_of(spark, MONOREPO))
    m = "apps/a/src/m.ts"
    expected = ["apps/a/src/db.ts", "apps/a/src/special/es.ts", "apps/a/src/x/k.ts", "packages/lib/none/z.ts", "packages/lib/src/a/c.ts", "packages/lib/src/i.ts", "packages/lib/src/icons/b.ts", "packages/lib/src/no/k.ts", "packages/lib/src/sub.ts"]
    assert named_edges(c, c.edges) == sorted([(m, x) for x in expected] + [("packages/lib/src/no/k.ts", "packages/lib/src/no/near.ts"), ("apps/b/m.ts", "apps/b/w.ts")])
    kinds = {(a, b, k) for a, b, k in named_edges(c, c.references)}
    assert {(b, k) for a, b, k in kinds if a == "apps/b/m.ts"} == {("apps/b/w.ts", "import"), ("apps/b/w.ios.ts", "platform"), ("apps/b/w.native.ts", "platform")}
    assert (None, "packages/lib/src/sub.ts", "manifest") in kinds and (None, "packages/lib/src/i.ts", "manifest") in kinds
    c.close()


def test_chains_of_configurations_double(spark):
    """A chain of 40 and a circle: the nearest options are found, and rounds end."""
    files = {f"c{k}.json": {"extends": f"./c{k + 1}"} for k in range(40)} | {"c40.json": {"compilerOptions": {"paths": {"@/*": ["./far/*"]}}}, "tsconfig.json": {"extends": "./c0.json"}}
    files |= {"r/tsconfig.json": {"extends": "./s.json"}, "r/s.json": {"extends": "./tsconfig.json", "compilerOptions": {"baseUrl": "."}}}
    got = {(r["owner"], r["prefix"], r["dir"]) for r in settings.config_aliases(settings_of(spark, files), tree_of(spark, {"r/lib/x.ts": ""})).collect()}
    assert got == {("", "@", "far"), ("r", "lib", "r/lib"), ("", None, None), ("r", None, None)}


def test_workspace_globs(spark):
    def names(files):
        written = settings_of(spark, files)
        return {(r["root"], r["dir"]) for r in settings.workspace_members(written, settings.manifests(written)).collect()}

    folders = {f"{d}/package.json": {"name": d} for d in ("p/a", "p/b/c", "q", "in/p/z")}
    assert names({"package.json": {"workspaces": {"packages": ["p/*", "q"]}}, **folders}) == {("", "p/a"), ("", "q")}
    yaml = "packages:\n  - 'q'\n  - '!p/a'\n"
    assert names({"package.json": {"workspaces": ["p/*"]}, "pnpm-workspace.yaml": yaml, **folders}) == {("", "p/a")}
    assert names({"package.json": {"workspaces": ["p/*"], "packageManager": "pnpm@9"}, "pnpm-workspace.yaml": yaml, **folders}) == {("", "q")}
    assert names({"package.json": {}, "pnpm-lock.yaml": "", "pnpm-workspace.yaml": yaml, "in/package.json": {"workspaces": ["./p/*"]}, **folders}) == {("", "q"), ("in", "in/p/z")}


def test_globs_equal_the_regular_expressions(spark):
    draw = random.Random(5)
    part = lambda: draw.choice(["src", "a", "b.c", "(x)", "t", "*", "a*", "?", "**", "{a,b.c}", "[id]"])
    globs = {"/".join([part() for _ in range(draw.randint(0, 3))] + [draw.choice(["*.ts", "*.{ts,tsx}", "x.ts", "*", "**", "x.*", "?.ts", "a"])]) for _ in range(250)} | {"./src/*.ts", "**/*.ts", "src/**", "a/x.ts"}
    globs = {g for g in globs if "[id]" not in g}
    files = {"/".join([draw.choice(["src", "a", "b.c", "(x)", "t", ".dot"]) for _ in range(draw.randint(0, 3))] + [draw.choice(["x.ts", "y.ts", "x.tsx", "a", "x.js"])]) for _ in range(200)}
    import re

    expected = {(g, f) for g in globs for f in files if re.match(paths.glob_regex(g), f)}
    left = spark.createDataFrame([("app", g) for g in globs], "app string, glob string")
    right = spark.createDataFrame([("app", k, f) for k, f in enumerate(files)], "app string, id long, path string")
    got = [(r["glob"], r["path"]) for r in globjoin.matches(left, right).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert globjoin.matches(left.withColumn("app", F.lit("other")), right).count() == 0


def test_subpaths_by_specificity(spark):
    keys = [("./a", ["t/a"]), ("./a*", ["t/any*"]), ("./a/*", ["t/in/*", "u/*/*"]), ("./a/*.js", ["t/js/*"]), ("./*", ["all/*"]), ("./gone/*", [])]
    subpaths = spark.createDataFrame([("app", "d", k, n, t) for n, (k, t) in enumerate(keys)], "app string, dir string, key string, at int, targets array<string>")
    wanted = spark.createDataFrame([("app", "d", s) for s in ("./a", "./ab", "./a/x", "./a/x.js", "./a/.js", "./z", "./gone/y", "./")], "app string, dir string, subpath string")
    got = {}
    for r in targets.matched_subpaths(wanted, subpaths).orderBy("ord").collect():
        got.setdefault(r["subpath"], []).append(r["target"])
    assert got == {"./a": ["t/a"], "./ab": ["t/anyb"], "./a/x": ["t/in/x", "u/x/x"], "./a/x.js": ["t/js/x"], "./a/.js": ["t/in/.js", "u/.js/.js"], "./z": ["all/z"]}


@pytest.mark.parametrize("empty", [True])
def test_empty_tree(spark, empty):
    c = plan.codebase(tree_of(spark, {"a.ts": ""}).filter("false"), written=settings_of(spark, MONOREPO))
    assert c.edges.isEmpty() and c.references.filter("kind <> 'manifest'").isEmpty() and c.orphans().isEmpty()
    c.close()


def test_imports_of_files_that_wrap_a_database_client(spark):
    manifests = {
        "package.json": {"name": "root", "workspaces": ["packages/*", "apps/*"]}, "apps/a/package.json": {"name": "a"}, "apps/a/tsconfig.json": {"compilerOptions": {"paths": {"@/*": ["./src/*"]}}},
        "packages/db/package.json": {"name": "@w/db", "exports": {".": "./dist/x.js"}}, "packages/ui/package.json": {"name": "@w/ui"}, "apps/b/tsconfig.json": {},
    }
    code = {
        "packages/db/src/client.ts": "export const db = new PrismaClient()", "packages/ui/index.ts": "export const x = 1", "apps/a/src/store/index.ts": "import { Pool } from 'pg'\nexport const p = new Pool<X>({})",
        "apps/a/src/pool.ts": "export const p = new Pool()", "apps/a/src/sb.ts": "import { createBrowserClient } from '@supabase/ssr'\nexport const c = createBrowserClient(a)", "apps/a/src/other.ts": "import { createClient } from 'redis'\ncreateClient()",
        "apps/a/src/again.ts": "export * from 'kysely'", "apps/a/src/all.ts": "export * from './sb'", "apps/a/src/self.controller.ts": "import 'x'\nconst d = drizzle(q)",
    }
    asks = {"pkg": "@w/db", "deep": "@w/db/some/where", "ui": "@w/ui", "alias": "@/store", "gone": "@/store/missing", "pool": "../pool", "sb": "../sb", "bar": "../all", "other": "../other", "again": "@/again", "lone": "../again", "store": "../storefront", "self": "../self.controller"}
    code |= {f"apps/a/src/api/{k}.controller.ts": f"import {{ x }} from '{v}'" for k, v in asks.items()} | {"apps/b/b.controller.ts": "import '@/store'\nimport '@w/dbx'"}
    c = plan.codebase(tree_of(spark, code), written=settings_of(spark, manifests))
    patterns = {"AP-001": c.database, "AP-002": None}
    found = detectors.forbidden_occurrences(c.production, c.ends, patterns).join(c.files.select("id", "path"), "id")
    broken = {r["path"].split("/")[-1].split(".")[0] for r in found.collect()}
    assert broken == {"pkg", "deep", "alias", "gone", "sb", "bar", "again"}
    gate = {r["rule_id"]: r["violators"] for r in detectors.forbidden_imports(c.production, c.ends, patterns).collect()}
    assert gate["AP-001"] == 7
    c.close()


def test_entries_are_moved_to_the_sources_that_they_are_built_from(spark):
    manifests = {
        "package.json": {"name": "root", "main": "./lib/cli.js"}, "tsconfig.json": {"compilerOptions": {"outDir": "lib"}},
        "p/package.json": {"name": "p", "types": "dist/i.d.ts", "exports": {".": {"node": {"import": "./dist/i.mjs"}}, "./deep": {"default": "./dist/esm/deep.js"}, "./none": None}},
        "p/tsconfig.build.json": {"extends": "./tsconfig.base.json"}, "p/tsconfig.base.json": {"compilerOptions": {"outDir": "./dist", "rootDir": "./code"}}, "q/package.json": {"name": "q", "main": "dist/x.js"}, "r/package.json": {"main": "./src/unnamed.ts"},
    }
    sources = {"src/cli.ts": "", "cli.ts": "", "p/code/i.mts": "", "p/code/i.ts": "", "p/code/esm/deep.tsx": "", "p/code/other.ts": "", "q/x.ts": "", "r/src/unnamed.ts": ""}
    c = plan.codebase(tree_of(spark, sources), written=settings_of(spark, manifests))
    assert {b for a, b, k in named_edges(c, c.references) if k == "entry"} == {"src/cli.ts", "cli.ts", "p/code/i.ts", "p/code/esm/deep.tsx"}
    assert {r["path"] for r in c.orphans().collect()} == {"p/code/i.mts", "p/code/other.ts", "q/x.ts", "r/src/unnamed.ts"}
    c.close()


def test_unknown_parts_of_a_computed_path_may_be_empty(spark):
    files = spark.createDataFrame([("src/promo/a/p1.ts",), ("src/promo/a/p12.ts",), ("src/promo/p1.ts",), ("src/promo/a/b/p1.ts",), ("src/promo/a/p2.ts",)], "path string")
    found = references.computed_targets(files, [("one", ["src/promo/", None, "/p1", None, ".ts"])])
    assert sorted(r["path"] for r in found.collect()) == ["src/promo/a/p1.ts", "src/promo/a/p12.ts"]
