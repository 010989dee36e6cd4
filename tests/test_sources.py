from pyspark.sql import functions as F

from veinwork.plans import scan as plan
from veinwork.plans.scan import scan
from veinwork.sources import code, routes
from veinwork.streaming import monitor

CODE = """// import x from 'comment'
import React, { useState as s, type T } from 'react';
import type { A } from './types';
import './side';
export * from "./all";
const s1 = "import y from 'string'";
const lazy = import('./lazy'), old = require("old");
import {
  one,
  two } from '../pair';
"""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_imports():
    found = [(spec, value, names, line, reexport) for spec, value, names, line, reexport, *_ in code.imports_of(CODE)]
    assert [x for x in found if x[0] != "string"] == [
        ("react", True, ["useState", "default"], 2, False), ("./types", False, ["A"], 3, False), ("./side", True, [], 4, False), ("./all", True, ["*"], 5, True),
        ("./lazy", True, None, 7, False), ("old", True, None, 7, False), ("../pair", True, ["one", "two"], 8, False),
    ]


def test_component_scripts():
    vue = "<template>\n</template>\n<script>\nimport a from 'b'\n</script>"
    assert list(code.imports_of(code.script_of("x.vue", vue)))[0][3] == 4
    assert "const" in code.script_of("x.astro", "---\nconst a = 1\n---\n<p>") and "<p>" not in code.script_of("x.astro", "---\nconst a = 1\n---\n<p>")


def test_configuration(spark):
    text = '{ // comment\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"], "~lib": ["lib/index"],}} }'
    assert code.aliases_of("app", text) == [("@/", "app/src", 0), ("~lib", "app/lib/index", 1)] or code.aliases_of("app", text)[0] == ("@", "app/src", 0)
    assert code.loose_json("not json") == {}
    assert code.workspace_globs('{"workspaces": {"packages": ["a/*"]}}') == ["a/*"]
    assert code.workspace_globs("{}", "packages:\n  - 'apps/*'\n  - libs/*\n") == ["apps/*", "libs/*"]
    manifests = spark.createDataFrame([("apps/x/package.json", '{"name": "x", "main": "i.js", "exports": {".": "./i.js", "./sub": "./s.js"}, "dependencies": {"react": "1"}, "devDependencies": {"eslint": "2"}}')], "path string, text string")
    assert rows(code.declared_packages(manifests)) == [("apps/x/package.json", "eslint"), ("apps/x/package.json", "react")]
    assert [(r["name"], r["dir"], r["entry"], sorted(r["subpaths"])) for r in code.workspace_packages(manifests, ["apps/*"]).collect()] == [("x", "apps/x", "i.js", [".", "./sub"])]
    assert rows(code.installed_tools(manifests)) == [("dependency-cruiser", False), ("eslint", True)]


def test_ignore(spark):
    tree = spark.createDataFrame([("a", p, "") for p in ("x.ts", "out/y.ts", "out/keep.ts", "p/gen.ts", "p/x.ts")], "app string, path string, text string")
    kept = code.not_ignored(tree, {"": "# c\nout/*\n!out/keep.ts\n", "p": "gen.ts\n"})
    assert sorted(r["path"] for r in kept.collect()) == ["out/keep.ts", "p/x.ts", "x.ts"]


def test_diff(spark):
    assert code.renames_of("M\ta\nR100\told.ts\tnew.ts\n") == [("old.ts", "new.ts")]
    assert rows(code.added_lines(spark, "+++ b/f.ts\n@@ -1 +3,2 @@\n+++ /dev/null\n@@ -1 +0,0 @@\n")) == [("f.ts", 3), ("f.ts", 4)]


def test_context(spark):
    md = spark.createDataFrame([("d", "---\nx: y\n---\n# Title\nUse *tabs*. Fine.\n```\nnever code\n```\n- Always test.")], "doc string, text string")
    assert rows(code.context_rules(md)) == [("d", 5, "Fine.", False), ("d", 5, "Use tabs.", True), ("d", 9, "Always test.", True)]


def test_tree_and_scan(spark, tmp_path):
    for name, text in {
        "src/features/auth/index.ts": "export * from './s'", "src/features/auth/s.ts": "console.log(process.env.X)", "src/views/v.tsx": "import { s } from '@/features/auth/s'\nimport fs from 'fs'\nimport l from 'lodash'",
        "src/views/v.test.ts": "import '../views/v'", "node_modules/x/i.ts": "", "src/x.d.ts": "",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    tree = code.read_tree(spark, str(tmp_path))
    assert sorted(r["path"] for r in tree.collect()) == ["src/features/auth/index.ts", "src/features/auth/s.ts", "src/views/v.test.ts", "src/views/v.tsx"]
    found = scan(tree, [("@", "src", 0)], ("react",))
    assert tuple(found["console-isolation"].first())[:2] == (3, 1)
    assert tuple(found["env-access"].first())[:2] == (3, 1)
    assert tuple(found["phantom-deps"].first())[:2] == (1, 1)
    assert rows(found["orphans"]) == [("src/views/v.tsx", "test_only")]
    assert [tuple(r)[:4] for r in found["public-api"].collect()] == [("src/features/auth", 1, 1, 1)]
    assert [r["path"] for r in code.barrels(code.extract_imports(tree), tree).collect()] == ["src/features/auth/index.ts"]
    for name, df in found.items():
        df.collect()


def test_routes(spark):
    listing = spark.createDataFrame([(p,) for p in (
        "web/next.config.mjs", "web/src/pages/about.tsx", "web/src/lib/x.ts", "kit/svelte.config.js", "kit/src/routes/+page.svelte", "kit/src/routes/a/+layout@.ts", "kit/src/routes/a/b.ts",
        "exp/src/app/home.tsx", "exp/app/old.tsx", "exp2/app/home.tsx", "rr/app/root.tsx", "rr/app/routes/a.tsx", "rr/app/routes/b/route.tsx", "rr/app/routes/b/part.tsx", "rr/app/far/away.tsx", "rr/app/routes/.hidden.tsx",
        "tan/src/routes/x.tsx", "tan/src/routes/-part/y.tsx", "tan/src/routes/z/-w.tsx", "src/pages/none.tsx",
    )], "path string")
    manifests = spark.createDataFrame([("exp", "expo-router"), ("exp2", "expo-router"), ("rr", "@react-router/dev"), ("tan", "@tanstack/router-plugin"), ("tan", "react")], "dir string, package string")
    named = routes.module_files(spark.createDataFrame([("rr", "// route('x', './no.tsx')\nroute('far/:id', './far/away.tsx'), index('home.tsx')")], "dir string, text string"), F.lit("app"))
    found = {r["path"]: r["framework"] for r in routes.routed(listing, routes.projects(listing, manifests), named).collect()}
    assert found == {
        "web/src/pages/about.tsx": "next", "kit/src/routes/+page.svelte": "sveltekit", "kit/src/routes/a/+layout@.ts": "sveltekit", "exp/src/app/home.tsx": "expo", "exp2/app/home.tsx": "expo",
        "rr/app/root.tsx": "react-router", "rr/app/routes/a.tsx": "react-router", "rr/app/routes/b/route.tsx": "react-router", "rr/app/far/away.tsx": "react-router", "tan/src/routes/x.tsx": "tanstack",
    }


def test_inherited_configuration():
    configs = {
        "base.json": '{"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["./*"], "~x": ["x/index"]}}}', "app/tsconfig.json": '{"extends": ["../base"], "compilerOptions": {"strict": true}, "references": [{"path": "./lib"}]}',
        "app/lib/tsconfig.json": '{"compilerOptions": {"paths": {"#/*": ["./gen/*", "./src/*"], "@": ["own"]}}}', "loop.json": '{"extends": "./loop.json"}',
    }
    assert code.inherited("app/tsconfig.json", configs)["baseDir"] == ""
    assert code.inherited_aliases("app/tsconfig.json", configs) == [("@", "src", 0), ("~x", "src/x/index", 1), ("#", "app/lib/gen", 2), ("#", "app/lib/src", 3), ("@", "app/lib/own", 4)]
    assert code.inherited("loop.json", configs) == {} and code.inherited_aliases("none.json", configs) == []
    kit = "export default { kit: { files: { lib: 'src/library' }, alias: { $data: './src/data', '~/*': 'src/*' } } } // lib: 'no'"
    assert code.kit_aliases("web", kit) == [("$lib", "web/src/library", 0), ("$data", "web/src/data", 1), ("~", "web/src", 2)]
    assert code.kit_aliases("", None) == [("$lib", "src/lib", 0)]


def test_literals_and_markup(spark):
    tree = tree_of(spark, {"a.ts": "const a = 'x/y', b = \"it's\" // 'no'\nconst c = `no`", "b.tsx": "export const B = () => <div className='q'>x</div>", "c.tsx": "const f = <T,>(x: T) => x\nconst y = a < b", "d.ts": "React.createElement('p')", "e.tsx": "return <></>", "f.ts": "const a = <any>b"})
    assert rows(code.string_literals(tree).filter("path = 'a.ts'").select("literal")) == [("it's",), ("x/y",)]
    assert rows(tree.filter(code.renders_markup(F.col("path"), F.col("text"))).select("path")) == [("b.tsx",), ("d.ts",), ("e.tsx",)]


def tree_of(spark, files, app="app"):
    return spark.createDataFrame([(app, p, t) for p, t in files.items()], "app string, path string, text string")


def measured(found, family):
    row = found[family].first()
    return row["population"], row["violators"]


def test_scan_leaves_out_tests_and_types(spark):
    tree = tree_of(spark, {
        "src/typed.ts": "import type { A } from 'lodash/internal/a'\nimport type { B } from '../../../b'", "src/value.ts": "import x from 'lodash'\nimport y from './typed'",
        "src/value.test.ts": "import x from 'lodash/internal/z'\nimport '../../../deep'\nimport 'undeclared'",
    })
    found = scan(tree, packages=("lodash",))
    assert measured(found, "dependency-hygiene") == (1, 0)
    assert measured(found, "phantom-deps") == (1, 0)
    assert measured(found, "import-style") == (2, 1)  # types count for style


def test_scan_of_two_apps(spark):
    a = tree_of(spark, {"src/a.ts": "import './b'"}, "one")
    b = tree_of(spark, {"src/b.ts": ""}, "two")
    c = plan.codebase(a.unionByName(b))
    assert c.edges.count() == 0
    assert plan.codebase(a.unionByName(b.withColumn("app", F.lit("one")))).edges.count() == 1


def test_scan_of_patterns_and_packages(spark):
    files = {f"src/api/r{k}.controller.ts": "import { PrismaClient } from '@prisma/client'" if k == 0 else "import { s } from '@w/lib'" for k in range(6)}
    files |= {f"src/widgets/w{k}.tsx": "" for k in range(6)} | {"src/api/ui.controller.ts": "import { w } from '../widgets/w1'", "src/api/deep.controller.ts": "import x from '@w/lib/src/x'"}
    c = plan.codebase(tree_of(spark, files), packages=("@prisma/client",), workspace=[("@w/lib", ["."], False)])
    found = plan.families(c)
    assert {r["rule_id"]: (r["population"], r["violators"]) for r in found["forbidden-imports"].collect()} == {"AP-001": (8, 1), "AP-002": (8, 1)}
    assert measured(found, "workspace-package-api") == (6, 1)
    assert measured(found, "phantom-deps") == (7, 0)
    gates = plan.rule_relation(c)
    assert {r["id"] for r in gates.collect()} >= {"AP-001", "AP-002", "no-cycles", "workspace-package", "no-ui-to-data"}
    broken = rows(plan.broken(c).filter("family IN ('forbidden-imports', 'workspace-package-api')").select("rule_id", "file", "subject"))
    assert broken == [("AP-001", "src/api/r0.controller.ts", "@prisma/client"), ("AP-002", "src/api/ui.controller.ts", "../widgets/w1"), ("workspace-package", "src/api/deep.controller.ts", "@w/lib/src/x")]
    assert plan.summary(c).filter("status = 'REJECT'").count() == 0
    few = plan.codebase(tree_of(spark, {"src/a.controller.ts": "import 'pg'"}))
    assert {r["rule_id"]: (r["violators"], r["status"]) for r in plan.families(few)["forbidden-imports"].collect()}["AP-002"] == (0, "REJECT")


def test_gates_agree_with_findings(spark):
    """Files with findings are the violators of their rule, family by family."""
    files = {
        "src/features/auth/index.ts": "export * from './s'", "src/features/auth/s.ts": "console.log(1)\nimport '../bill/b'", "src/features/bill/b.ts": "import '../auth/s'\nprocess.env.X",
        "src/pages/p.tsx": "'use client'\nimport 'server-only'\nimport '../features/auth/s'", "src/pages/p.stories.tsx": "import './p'", "src/x.ts": "import './pages/p.stories'\nimport './x.test'\nimport '../../../out'", "src/x.test.ts": "",
    }
    c = plan.codebase(tree_of(spark, files))
    gates = {(r["family"], r["id"]): r["violators"] for r in plan.rule_relation(c).collect()}
    broken = {}
    for r in plan.broken(c).collect():
        broken.setdefault((r["family"], r["rule_id"]), set()).add(r["subject"] if r["family"] in ("entry-purity", "stories-isolation") else r["file"])
    assert {k: len(v) for k, v in broken.items()} == {k: n for k, n in gates.items() if n}
    assert ("cycles", "no-cycles") in broken and ("feature-slice", "no-cross-slice-src-features") in broken and ("test-isolation", "test-isolation") in broken


def test_check(spark):
    side = lambda rules, found: {"rules": spark.createDataFrame(rules, "id string, definition string"), "findings": spark.createDataFrame(found, "rule_id string, file string, subject string, kind string, line int")}
    base = side([("a", "1"), ("b", "1"), ("gone", "1")], [("a", "old", "s", "specifier", None), ("a", "f", "s", "specifier", None), ("gone", "f", "s", "specifier", None)])
    head = side([("a", "1"), ("b", "2"), ("c", "1")], [("a", "new", "s", "specifier", None), ("a", "g", "s", "specifier", None), ("a", "ok", "s", "specifier", None), ("b", "f", "t", "target", None), ("c", "f", "t", "target", None)])
    pairs = lambda r, schema: spark.createDataFrame(r, schema)
    allowed = pairs([("a", "ok"), ("a", "never")], "rule string, file string")
    found = plan.check(base, head, allowed, allowed.filter("false"), pairs([("old", "new")], "from string, to string"), pairs([], "file string, line int"))
    got = {k: sorted(tuple(r)[:3] for r in v.collect()) for k, v in found.items()}
    assert got == {"introduced": [("a", "g", "s")], "fixed": [("a", "f", "s")], "adopted": [("b", "changed", 1), ("c", "new", 1)], "removed": [("gone",)], "allowed_in_change": [("a", "ok")], "unused": [("a", "never")]}
    assert plan.exit_code(found) == 1 and plan.exit_code(found, "never") == 0


def test_stream(spark, tmp_path):
    schema = "rule_id string, file string, line long"
    spark.createDataFrame([("r", "a", 1), ("r", "b", 1)], schema).write.parquet(str(tmp_path / "in"))
    base = spark.createDataFrame([("r", "a", 1)], schema)
    got = []
    query = monitor.new_findings(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), base, lambda df, n: got.extend(rows(df)), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert got == [("r", "b", 0, 1)]
