import json

from pyspark.sql import functions as F

from veinwork.operators import globjoin, pathrules
from veinwork.plans import scan as plan
from veinwork.sources import settings


def rows_of(spark, files, app="app"):
    return spark.createDataFrame([(app, p, t if isinstance(t, str) else json.dumps(t)) for p, t in files.items()], "app string, path string, text string")


def files_of(spark, names):
    return spark.createDataFrame([("app", k, p) for k, p in enumerate(names)], "app string, id long, path string")


def kept(spark, names, written):
    return sorted(r["path"] for r in pathrules.not_ignored(files_of(spark, names), rows_of(spark, written)).collect())


def test_ignore_files_found_in_the_tree(spark):
    names = ["a.ts", "a.log.ts", "keep.log.ts", "gen/x.ts", "gen/keep.ts", "src/gen/y.ts", "src/out/z.ts", "out/z.ts", "src/deep/er/w.ts", "src/[id]/p.ts", "lib/q.ts", "pkg/lib/r.ts", "pkg/x.ts", "pkg/a.log.ts", "pkg/in/x.ts", "node_modules/m.ts", "src/build/b.ts", "b1.ts", "bx.ts", "#h.ts", "!e.ts"]
    written = {
        ".gitignore": "# comment\n\n*.log.ts  \n!keep.log.ts\ngen/\n!gen/keep.ts\n/out\nsrc/**/w.ts\nb[0-9].ts\n\\#h.ts\n\\!e.ts",
        "pkg/.gitignore": "lib\n/x.ts\n!a.log.ts\n", "src/[id]/.gitignore": "p.ts", "lib/.npmignore": "*",
    }
    # a folder that is out stays out whatever names a file in it; a nested file does not bring back what the root leaves out
    assert kept(spark, names, written) == sorted(["a.ts", "keep.log.ts", "src/out/z.ts", "lib/q.ts", "pkg/in/x.ts", "bx.ts"])
    assert kept(spark, ["dist/x.ts", "d.ts"], {".gitignore": "!dist"}) == ["d.ts", "dist/x.ts"]
    assert kept(spark, ["x/y.ts", "z.ts"], {}) == ["x/y.ts", "z.ts"]
    assert kept(spark, ["x/y.ts", "x/z.ts"], {".gitignore": "x/*\n!x/z.ts"}) == ["x/z.ts"]


def shipped(spark, names, written):
    files, own = files_of(spark, names), rows_of(spark, written)
    ids = {r["id"] for r in pathrules.shipped_files(files, own, settings.manifests(own)).collect()}
    return sorted(p for k, p in enumerate(names) if k in ids)


def test_files_that_packages_ship(spark):
    names = ["src/a.ts", "src/in/b.ts", "lib/c.ts", "lib/d.test.ts", "index.ts", "deep/index.ts", "x/y/z.ts"]
    listed = lambda *files, **more: {"package.json": {"name": "p", "files": list(files), **more}}
    assert shipped(spark, names, listed("src")) == ["src/a.ts", "src/in/b.ts"]
    assert shipped(spark, names, listed("./src/*", "INDEX.ts")) == ["index.ts", "src/a.ts", "src/in/b.ts"]
    assert shipped(spark, names, listed("lib", "!lib/*.test.ts")) == ["lib/c.ts"]
    assert shipped(spark, names, listed("/src/", "!/src/in/")) == ["src/a.ts"] and shipped(spark, names, listed("/src/", "!/src/in/", "/src/in/b.ts")) == ["src/a.ts", "src/in/b.ts"]
    assert shipped(spark, names, listed("x/y/*.ts", "**/index.ts")) == ["deep/index.ts", "index.ts", "x/y/z.ts"]
    assert shipped(spark, names, listed("src", private=True)) == shipped(spark, names, listed("src", exports="./x")) == []
    assert shipped(spark, names, {"package.json": {"name": "p"}}) == []
    assert shipped(spark, names, {"package.json": {"name": "p"}, ".npmignore": "src\n*.test.ts"}) == ["deep/index.ts", "index.ts", "lib/c.ts", "x/y/z.ts"]
    # a line that keeps something inside a folder keeps the folder, and with it what no line names
    assert shipped(spark, names, {"package.json": {"name": "p"}, ".npmignore": "src\n!src/in\nlib"}) == ["deep/index.ts", "index.ts", "src/a.ts", "src/in/b.ts", "x/y/z.ts"]
    assert shipped(spark, names, {"package.json": {"name": "p", "publishConfig": {}}, ".gitignore": "lib/"}) == ["deep/index.ts", "index.ts", "src/a.ts", "src/in/b.ts", "x/y/z.ts"]
    assert shipped(spark, names, {"package.json": {"name": "p", "publishConfig": {"directory": "d"}}, ".gitignore": "lib/"}) == sorted(names)
    nested = {"package.json": {"name": "p", "publishConfig": {}, "workspaces": ["lib"]}, "lib/package.json": {"name": "q", "files": ["c.ts"]}, "x/package.json": {"name": "r"}}
    assert shipped(spark, names, nested) == ["deep/index.ts", "index.ts", "lib/c.ts", "src/a.ts", "src/in/b.ts", "x/y/z.ts"]


def test_scan_leaves_out_what_is_ignored_and_tells_what_is_shipped(spark):
    sources = {"src/a.ts": "import './gen/g'", "src/gen/g.ts": "", "src/open.ts": "", "other/o.ts": ""}
    written = rows_of(spark, {".gitignore": "gen", "package.json": {"name": "p", "files": ["src"]}})
    c = plan.codebase(rows_of(spark, sources), written=written)
    assert sorted(r["path"] for r in c.files.collect()) == ["other/o.ts", "src/a.ts", "src/open.ts"]
    assert sorted(map(tuple, c.orphans().collect())) == [("other/o.ts", "orphan"), ("src/a.ts", "shipped"), ("src/open.ts", "shipped")]
    c.close()


def test_exploded_paths_are_never_broadcast(spark):
    """The planner takes keys of paths for as many rows as the files."""
    files = spark.createDataFrame([(k, f"src/l{k % 3}/b{k}/p{k}.ts") for k in range(50)], "id long, path string").withColumn("app", F.lit("app"))
    globs = files.select("app", F.concat(F.lit("src/**/b"), "id", F.lit("/*.ts")).alias("glob"))
    lines = files.select("app", F.lit("src").alias("dir"), F.lit(0).alias("line"), F.concat(F.lit("b"), "id", F.lit("/")).alias("text"))
    for found in (globjoin.matches(globs, files), pathrules.left_out(files, lines)):
        assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
        assert found.count() == 50
