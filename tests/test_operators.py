import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veinwork.operators import change, detectors, graph, resolve, rules
from veinwork.operators.graph import strong_components


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edges_of(spark, pairs):
    return spark.createDataFrame([("x", a, b) for a, b in pairs], "app string, src long, dst long")


def test_cycles(spark):
    edges = edges_of(spark, [(1, 2), (2, 1), (2, 3), (3, 3), (4, 1)])
    nodes = graph.cyclic_nodes(edges)
    assert rows(nodes) == [("x", 1, 1), ("x", 2, 1), ("x", 3, 3)]
    assert rows(graph.cycle_edges(edges, nodes)) == [("x", 1, 2), ("x", 2, 1), ("x", 3, 3)]
    assert [(r["component"], r["loop"]) for r in graph.cycle_loops(edges).orderBy("component").collect()] == [(1, [1, 2, 1]), (3, [3, 3])]
    assert rows(graph.cyclic_nodes(edges, local_edges=0)) == rows(nodes)
    assert [(r["component"], r["loop"]) for r in graph.cycle_loops(edges, local_edges=0).orderBy("component").collect()] == [(1, [1, 2, 1]), (3, [3, 3])]


def test_large_graphs_by_joins(spark):
    """The forms without a task for a whole app agree with those that have one."""
    draw = random.Random(3)
    pairs = {(draw.randrange(30), draw.randrange(30)) for _ in range(45)} | {(100 + k, 101 + k) for k in range(6)} | {(200 + k, 200 + (k + 1) % 7) for k in range(7)}
    edges = edges_of(spark, sorted(pairs)).unionByName(edges_of(spark, [(1, 2), (2, 1)]).withColumn("app", F.lit("y")))
    small, large = graph.split_by_size(edges, 10)
    assert {r["app"] for r in small.collect()} == {"y"} and {r["app"] for r in large.collect()} == {"x"}
    assert rows(graph.cyclic_nodes(edges, 10)) == rows(graph.cyclic_nodes(edges))
    layers = edges.select("app", F.col("src").alias("node")).union(edges.select("app", "dst")).distinct().withColumn("layer", F.concat(F.lit("l"), (F.col("node") % 4).cast("string")))
    assert rows(graph.layer_reachability(edges, layers, 10)) == rows(graph.layer_reachability(edges, layers))
    assert rows(graph.cyclic_nodes(edges.filter("false"), 0)) == []
    loops = lambda df: {(r["app"], r["component"]): (r["size"], r["loop"]) for r in df.collect()}
    assert loops(graph.cycle_loops(edges, 10)) == loops(graph.cycle_loops(edges)) and loops(graph.cycle_loops(edges, 10))["x", 200] == (7, [*range(200, 207), 200])


def test_more_layers_than_bits_of_a_row(spark):
    """Layers of a long way with a shortcut at every power of two, and a loop at its end."""
    edges = edges_of(spark, [(k, k + 1) for k in range(69)] + [(69, 67)])
    layers = spark.range(70).select(F.lit("x").alias("app"), F.col("id").alias("node"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("layer"))
    assert graph.with_shortcuts(edges_of(spark, [(k, k + 1) for k in range(8)])).count() == 8 + 7 + 5 + 1
    expected = sorted(("x", f"l{a}", f"l{b}") for a in range(70) for b in range(70) if b > a or a > 66 and b > 66)
    assert rows(graph.layer_reachability(edges, layers, 0)) == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=24))
def test_components_against_closure(pairs):
    reach = set(pairs)
    for k in range(8):
        reach |= {(a, d) for a, b in reach if b == k for c, d in reach if c == k}
    nodes = {n for p in pairs for n in p}
    expected = {n: min([n] + [m for m in nodes if (n, m) in reach and (m, n) in reach]) for n in nodes}
    assert strong_components(pairs) == expected


def test_reachability(spark):
    layers = lambda m: spark.createDataFrame([("x", k, v) for k, v in m.items()], "app string, node long, layer string")
    chain = graph.layer_reachability(edges_of(spark, [(1, 2), (2, 3)]), layers({1: "api", 2: "service", 3: "db"}))
    assert rows(chain) == [("x", "api", "db"), ("x", "api", "service"), ("x", "service", "db")]
    loop = graph.layer_reachability(edges_of(spark, [(1, 2), (2, 1)]), layers({1: "a", 2: "b"}))
    assert rows(loop) == [("x", a, b) for a in "ab" for b in "ab"]


def test_leaf_files(spark):
    hops = spark.createDataFrame([(1, 2), (2, 3), (2, 1), (1, 4)], "src long, dst long")
    assert rows(graph.leaf_files(hops, spark.createDataFrame([(1,), (2,)], "id long"))) == [(1, 3), (1, 4), (2, 3), (2, 4)]
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "src long, dst long")
    assert rows(graph.leaf_files(chain, spark.range(40).filter("id <> 17"))) == sorted([(k, 17) for k in range(17)] + [(k, 40) for k in range(40) if k != 17])


def files_of(spark, items):
    from veinwork.functions import paths, roles

    df = spark.createDataFrame(list(enumerate(items)), "id long, path string")
    return df.select("id", "path", paths.layer_of(F.col("path")).alias("layer"), roles.classify(F.col("path")).alias("c")).select("id", "path", "layer", "c.*")


def edge(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_layers(spark):
    files = files_of(spark, [f"src/helpers/h{i}.ts" for i in range(40)] + [f"src/views/v{i}.ts" for i in range(40)])
    found = detectors.layer_boundaries(files, edge(spark, [(40 + i, i) for i in range(40)])).first()
    assert (found["from_layer"], found["to_layer"], found["violators"], found["reverse_flow"], found["status"]) == ("helpers", "views", 0, 40, "AUTO")


def test_siblings_and_public_api(spark):
    files = files_of(spark, ["src/features/auth/a.ts", "src/features/auth/b.ts", "src/features/bill/c.ts", "src/features/lone.ts", "src/modules/x/y.ts"])
    members = detectors.members_of(files, ("features", "modules"))
    assert rows(members) == [(0, "src/features", "auth"), (1, "src/features", "auth"), (2, "src/features", "bill"), (4, "src/modules", "x")]
    group = detectors.sibling_isolation(members, edge(spark, [(0, 2), (0, 1)])).collect()
    assert [(g["container"], g["members"], g["files"], g["cross_importers"]) for g in group] == [("src/features", 2, 3, 1)]
    files = files_of(spark, ["f/auth/index.ts", "f/auth/s.ts", "f/auth/tokens/index.ts", "f/auth/tokens/t.ts", "u/a.ts", "u/b.ts"])
    barrels = spark.createDataFrame([(0, "f/auth"), (2, "f/auth/tokens")], "id long, dir string")
    found = detectors.public_api(files, edge(spark, [(4, 0), (5, 1), (4, 2), (1, 0), (3, 2)]), barrels)
    assert [tuple(r)[:4] for r in found.orderBy("dir").collect()] == [("f/auth", 1, 2, 1), ("f/auth/tokens", 1, 1, 0)]


def test_isolation_families(spark):
    files = files_of(spark, ["src/a.ts", "src/a.test.ts", "src/x.controller.ts", "src/y.controller.ts", "src/c.tsx", "src/db/q.ts"])
    pairs = edge(spark, [(0, 1), (0, 2), (3, 2), (4, 5)])
    assert tuple(detectors.test_isolation(files, pairs).first())[:2] == (5, 1)
    assert tuple(detectors.entry_purity(files, pairs, F.col("role") == "CONTROLLER").first())[:2] == (2, 1)
    assert rows(detectors.entry_importers(files, pairs, F.col("role") == "CONTROLLER")) == [("src/x.controller.ts", "src/a.ts")]
    assert tuple(detectors.reaches_role(files, pairs, F.col("role") == "COMPONENT", F.col("role") == "DATA_ACCESS").first())[:2] == (1, 1)
    assert rows(graph.orphans(files, pairs, F.col("role") == "CONTROLLER")) == [("src/a.ts", "orphan"), ("src/c.tsx", "orphan")]
    empty = files.filter("false")
    assert tuple(detectors.test_isolation(empty, pairs).first()) == (0, 0, 0.0, 0.0, "REJECT")


def test_imports_families(spark):
    imports = spark.createDataFrame([(1, "react"), (1, "../../../x"), (2, "lodash/internal/y"), (2, "./a"), (3, "@/c"), (3, "zod")], "id long, spec string")
    assert tuple(detectors.import_style(imports).first())[:2] == (2, 1)
    assert tuple(detectors.package_hygiene(imports, ("@",)).first())[:2] == (3, 1)
    declared = spark.createDataFrame([("react",), ("zod",)], "package string")
    assert tuple(detectors.phantom_dependencies(imports, declared, ("@",)).first())[:2] == (3, 1)


def test_diff(spark):
    schema = "rule_id string, file string, line long"
    base = spark.createDataFrame([("r", "a", 1), ("r", "a", 2), ("r", "b", 1)], schema)
    head = spark.createDataFrame([("r", "a", 1), ("r", "c", 5), ("r", "b", 1), ("r", "b", 7)], schema)
    added = spark.createDataFrame([("b", 7)], "file string, line long")
    assert rows(change.introduced(base, head, added)) == [("r", "b", 7), ("r", "c", 5)]
    assert rows(change.introduced(base, head, added.filter("false"))) == [("r", "b", 1), ("r", "b", 7), ("r", "c", 5)]
    assert rows(change.fixed(base, head)) == [("r", "a", 2)]
    assert rows(change.introduced(head, head, added)) == []
    found = spark.createDataFrame([("r", "old", "old", "target"), ("r", "x", "old", "specifier")], "rule_id string, file string, subject string, kind string")
    names = spark.createDataFrame([("old", "new")], "from string, to string")
    assert rows(change.renamed(found, names)) == [("r", "new", "new", "target"), ("r", "x", "old", "specifier")]
    lines = spark.createDataFrame([("r", "f", "s", 3), ("r", "g", "s", 1), ("r", "g", "s", 2)], "rule_id string, file string, subject string, line long")
    where = spark.createDataFrame([("r", "f", "s"), ("r", "g", "s")], "rule_id string, file string, subject string")
    assert rows(change.located(where, lines)) == [("r", "f", "s", 3), ("r", "g", "s", None)]


def test_context_and_state(spark):
    text = lambda *t: spark.createDataFrame([("d", x) for x in t], "doc string, text string")
    quoted = spark.createDataFrame([("Use tabs",), ("a longer statement: No",)], "statement string")
    assert rows(change.unchecked_sentences(text("Use tabs.", "New one.", "Old one.", "No", "t: "), text("Old one."), quoted)) == [("d", "New one.")]
    prior = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "id string, v int")
    scanned = spark.createDataFrame([("b", 2)], "id string, v int")
    assert rows(change.merged_state(prior, scanned, F.col("id") == "c")) == [("a", 1), ("b", 2)]


def test_references_of_configuration(spark):
    files = files_of(spark, ["src/setup.ts", "tools/x.ts", "pkg/src/index.ts", "src/a/b.ts"])
    literals = spark.createDataFrame([(9, "vitest.config.ts", "./src/setup.ts"), (9, "vitest.config.ts", "<rootDir>/tools/x"), (9, "vitest.config.ts", "node")], "id long, path string, literal string")
    assert rows(resolve.config_references(literals, files)) == [(9, 0), (9, 1)]
    assert rows(resolve.manifest_references(spark.createDataFrame([(8, "pkg", "./src/index.ts"), (8, "pkg", "./dist/x.js")], "id long, dir string, target string"), files)) == [(8, 2)]
    shared = lambda *p: resolve.common_directory(spark.createDataFrame([(x,) for x in p], "path string")).first()["dir"]
    assert (shared("a/b/x.ts", "a/b/c/y.ts"), shared("a/b/x.ts", "a/bc/y.ts"), shared("x.ts", "a/y.ts"), shared("a/b/x.ts")) == ("a/b", "a", "", "a/b")
    assert resolve.common_directory(files.filter("false")).count() == 0


def test_checker_rules(spark):
    from veinwork.operators import emit

    families = ["layer", "role-layering", "public-api", "feature-slice", "app-isolation", "test-isolation", "entry-purity", "dependency-hygiene", "phantom-deps", "stories-isolation", "ui-data", "server-client", "console-isolation"]
    sides = {"layer": ("db", "ui"), "role-layering": ("SERVICE", "CONTROLLER"), "public-api": ("src/f.x", None), "feature-slice": ("src/features", None), "app-isolation": ("apps", None), "server-client": ("^client", "^server")}
    gates = spark.createDataFrame([(f, f"r-{f}", "AUTO", *sides.get(f, (None, None))) for f in families] + [("layer", "weak", "SUGGEST", "a", "b")], "family string, id string, status string, from string, to string")
    found = {r["family"]: json.loads(r["rule"]) for r in emit.checker_rules(gates, spark.createDataFrame([("r-layer", "src/db/x.ts")], "rule string, file string")).collect()}
    assert set(found) == set(families) - {"console-isolation"}
    assert found["layer"] == {"name": "r-layer", "severity": "error", "from": {"path": ["^src/db/"]}, "to": {"path": ["^src/ui/"]}, "exempt": ["^src/db/x\\.ts$"]}
    assert found["public-api"]["from"] == {"pathNot": ["^src/f\\.x/"]} and found["public-api"]["to"]["pathNot"] == ["^src/f\\.x/index\\.(ts|tsx)$"]
    assert found["feature-slice"]["to"] == {"path": ["^src/features/([^/]+)/"], "pathNot": ["^src/features/$1/"]}
    assert found["role-layering"]["from"]["path"] == [r"\.service\.ts$"] and found["phantom-deps"]["to"]["dependencyTypes"] == ["npm-no-pkg", "npm-unknown"]
    line = emit.annotation_summary(spark.createDataFrame([("a",), ("a",), ("b",)], "rule_id string"), spark.createDataFrame([], "rule_id string")).first()["line"]
    assert line == "3 new violations of 2 rules, 0 fixed"


def test_exceptions_and_removed_rules(spark):
    schema = "rule string, exception string"
    adopted = spark.createDataFrame([("a", "forbidden-imports", "fast"), ("b", "forbidden-imports", "fast"), ("c", "layer", "fast"), ("d", "forbidden-imports", "fast")], "rule string, family string, mode string")
    recorded = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x")], schema)
    current = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")], schema)
    assert sorted(((r[0], r[1]) for r in change.remeasured(adopted, recorded, current, "deep").collect()), key=str) == [("a", "x"), ("a", "y"), ("d", None)]
    assert rows(change.remeasured(adopted, recorded, current, "fast")) == []
    ids = spark.createDataFrame([("r",), ("s",)], "id string")
    assert rows(change.removed_rules(ids, ids.filter("false"))) == [("r",), ("s",)] and rows(change.removed_rules(ids, ids.limit(1))) == []
    sentences = spark.createDataFrame([("d", "Use x.", True), ("d", "Fine.", False), ("e", "Old.", False)], "doc string, text string, rule_like boolean")
    assert rows(change.context_counts(sentences, spark.createDataFrame([("d", "Use x."), ("d", "Fine.")], "doc string, text string"))) == [(2, 1)]


def test_names_of_imports(spark):
    imports = spark.createDataFrame([(1, ["useState"]), (2, ["*"]), (3, None), (4, ["other"]), (5, [])], "id long, names array<string>")
    assert rows(imports.filter(rules.takes_name(F.col("names"), ["useState", "x"])).select("id")) == [(1,), (2,)]
    assert imports.filter(rules.takes_name(F.col("names"), None)).count() == 5


def test_workspace_packages(spark):
    packages = spark.createDataFrame([("@a/lib", [".", "./sub", "./gen/*.js"], False), ("@a/open", ["./*"], True), ("plain", [], False)], "name string, exports array<string>, open boolean")
    imports = spark.createDataFrame([(1, "@a/lib"), (2, "@a/lib/sub"), (3, "@a/lib/deep/x"), (4, "@a/open/any"), (5, "@a/library"), (6, "plain/x"), (7, "@a/lib/gen/y.js"), (8, "@a/lib/gen/.js")], "id long, spec string")
    found = detectors.workspace_imports(imports, packages)
    assert rows(found.select("id", "violates")) == [(1, False), (2, False), (3, True), (6, True), (7, False), (8, True)]
    assert tuple(detectors.workspace_api(imports, packages).first())[:2] == (6, 3)


def test_forbidden_imports_by_leaf_and_without_pattern(spark):
    files = files_of(spark, ["src/a.controller.ts", "src/b.controller.ts", "src/c.ts"])
    imports = spark.createDataFrame([(0, "./all", "src/db/client.ts"), (1, "./x", "node_modules/pg/index.js"), (2, "pg", None)], "id long, spec string, leaf string")
    found = {r["rule_id"]: (r["population"], r["violators"], r["status"]) for r in detectors.forbidden_imports(files, imports, {"A": r"(^|/)(db|pg)(/|$)", "B": None}).collect()}
    assert found["A"][:2] == (2, 1) and found["B"] == (2, 0, "REJECT")
    assert rows(detectors.forbidden_occurrences(files, imports, {"A": r"(^|/)(db|pg)(/|$)", "B": None})) == [(0, "./all", "A")]


def test_texts(spark):
    from veinwork.functions import prose
    from veinwork.operators import emit

    row = spark.createDataFrame([("# T\n\n Use  *tabs*\nand spaces.\nEnd", "tabs and", "absent", "")], "t string, q string, a string, e string")
    assert tuple(row.select(*[prose.quote_line(F.col("t"), F.col(c)) for c in "qae"]).first()) == (3, None, None)
    assert row.select(emit.code_frame(F.lit("a\nb\nc\nd"), F.lit(2), 1).alias("x")).first()["x"] == ">    2 | b".join(["     1 | a\n", "\n     3 | c"]).replace("     1", "     1")
    bounds = spark.createDataFrame([("db", "ui", "AUTO", 40, 1, 0.9, 0.975)], "from_layer string, to_layer string, status string, population long, violators long, floor double, observed double")
    assert emit.statements(bounds).first()["statement"] == "Files in db must not import ui (39 of 40 follow, 97.5%)."
    assert "# no-db-to-ui" in emit.cards(bounds).first()["card"] and "expectNoDependency" in emit.architecture_tests(bounds).first()["test"]
    summary = spark.createDataFrame([("r1", "layer", "AUTO", 40, 1, 0.9), ("r2", "layer", "SUGGEST", 9, 0, 0.7)], "id string, family string, status string, population long, violators long, floor double")
    assert rows(emit.report(summary)) == [("AUTO", 1, "r1: 1/40"), ("SUGGEST", 1, "r2: 0/9")]
    assert '"app":"x"' in emit.scan_json(summary, "x").first()["json"]
    assert rows(emit.found_rules(spark.createDataFrame([("Lint/ R1",), ("zz",)], "ref string"), summary.select("id", F.lit(None).cast("string").alias("label")))) == [("Lint/ R1", "r1"), ("zz", None)]


def test_rules(spark):
    status = spark.createDataFrame([("a", "AUTO"), ("a", "REJECT"), ("b", "SUGGEST"), ("c", "REJECT")], "family string, status string")
    assert rows(rules.family_status(status)) == [("a", "AUTO"), ("b", "SUGGEST"), ("c", "NONE")]
    named = spark.createDataFrame([("x", "SUGGEST"), ("y", "SUGGEST")], "id string, status string")
    assert rows(rules.promoted(named, ["x"])) == [("x", "AUTO", "SUGGEST"), ("y", "SUGGEST", None)]
    deps = spark.createDataFrame([("next",), ("left-pad",)], "package string")
    assert rows(rules.detected_stack(deps, {"next": "next", "react": "react"})) == [("next",)]


def test_resolution(spark):
    files = files_of(spark, ["src/a/x.ts", "src/b/index.ts", "src/ui/c.tsx"])
    imports = spark.createDataFrame([(0, "../b"), (0, "@/ui/c"), (0, "../../../out")], "id long, spec string")
    aliases = spark.createDataFrame([("@", "src", 0), ("@/ui", "src/ui", 1)], "prefix string, dir string, ord int")
    targets = resolve.relative(imports, files).unionByName(resolve.aliased(imports, aliases))
    assert rows(resolve.resolved(targets, files)) == [(0, "../b", 1), (0, "@/ui/c", 2)]
    # all targets of the longest prefix, in order; files of another app do not count
    apps = files.withColumn("app", F.when(F.col("id") == 2, "b").otherwise("a"))
    own = spark.createDataFrame([(0, "a", "@/ui/c"), (0, "a", "@/b")], "id long, app string, spec string")
    several = spark.createDataFrame([("@", "nowhere", 0), ("@", "src", 1)], "prefix string, dir string, ord int")
    assert rows(resolve.resolved(resolve.alias_targets(own, several), apps)) == [(0, "@/b", 1)]
    assert rows(resolve.resolved(resolve.relative(imports.filter("spec = '../b'"), apps), apps.withColumn("app", F.when(F.col("id") == 1, "b").otherwise("a")))) == []
    dirs = spark.createDataFrame([("src",), ("src/ui",)], "dir string")
    assert rows(resolve.owners(files, dirs)) == [(0, "src"), (1, "src"), (2, "src/ui")]
    assert rows(resolve.discovered_apps(files, dirs)) == [("src", 2), ("src/ui", 1)]
    assert rows(resolve.discovered_apps(files, dirs, 2)) == [("src", 2)]
    assert rows(resolve.matched_loaders(files, [("g", "src/**/*.tsx")])) == [("g", "src/ui/c.tsx")]


def test_relocated_rules(spark):
    texts = spark.createDataFrame([("a.md", "# Title\n\nUse *named* exports.\nNever reach into\n  a sibling. Never reach into a sibling."), ("b.md", None), ("c.md", "")], "file string, text string")
    rules_ = [("r1", "a.md", "Use named exports.", 3), ("r2", "a.md", "Never reach into a sibling.", 9), ("r3", "a.md", "Gone.", 4), ("r4", "b.md", "x", 1), ("r5", "none.md", "x", 2), ("r6", "a.md", "", 7), ("r7", "a.md", "Use `named` exports.", 1), ("r8", None, "x", 5), ("r9", "c.md", None, 6)]
    found = change.relocated(spark.createDataFrame(rules_, "id string, file string, statement string, line long"), texts)
    assert rows(found.select("id", "line", "moved", "stale")) == [
        ("r1", 3, False, False), ("r2", 4, True, False), ("r3", 4, False, True), ("r4", 1, False, True), ("r5", 2, False, True), ("r6", 7, False, True), ("r7", 3, True, False), ("r8", 5, False, True), ("r9", 6, False, True)
    ]
    assert found.columns == ["id", "file", "statement", "line", "moved", "stale"]
    assert rows(change.relocated(found.drop("moved", "stale").filter("false"), texts)) == []


def test_sentences_and_statements_meet_by_all_their_first_characters(spark):
    """Every statement begins alike, so few pairs may share a key; all lengths of keys, and the empty one, are met."""
    text = lambda n: "the " + "".join(chr(97 + (n * k * k + k) % 23) for k in range(40))
    parts = ["", "e", "ye", *(text(n)[: 4 + n] for n in range(40))]
    wholes = [f"so {text(n)} ends" for n in range(40)]
    found = change._holders(spark.createDataFrame([(p,) for p in parts], "part string"), spark.createDataFrame([(w,) for w in wholes], "whole string"))
    assert sorted(map(tuple, found.collect())) == sorted((p, w) for p in set(parts) for w in wholes if p in w)
    fresh = spark.createDataFrame([("d", w) for w in wholes], "doc string, text string")
    quoted = spark.createDataFrame([(p,) for p in parts[10:]] + [(f"{w} and on",) for w in wholes[:3]], "statement string")
    plan = change.unchecked_sentences(fresh, fresh.limit(0), quoted)
    held = {w for w in wholes if any(p in w for p in parts[10:])} | set(wholes[:3])
    assert sorted(r["text"] for r in plan.collect()) == sorted(set(wholes) - held)


def test_relocated_rules_look_at_a_text_once_a_rule(spark):
    """A file of many lines and rules: the place of a sentence is not found anew for each line."""
    import time

    lines = [f"Rule {k} *says* {k * k}." for k in range(1500)]
    texts = spark.createDataFrame([("a.md", "\n".join(lines))], "file string, text string")
    stated = spark.createDataFrame([("a.md", x, 1) for x in lines], "file string, statement string, line long")
    start = time.time()
    found = change.relocated(stated, texts).select("statement", "line").collect()
    assert {r["statement"]: r["line"] for r in found} == {x: k + 1 for k, x in enumerate(lines)}
    assert time.time() - start < 60


def test_leaf_files_do_not_go_through_the_driver(spark):
    hops = spark.range(1, 50).selectExpr("id div 2 AS src", "id AS dst")
    found = graph.leaf_files(hops, hops.selectExpr("src AS id").distinct())
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert {r["leaf"] for r in found.collect()} == set(range(25, 50))
