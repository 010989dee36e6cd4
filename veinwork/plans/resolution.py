"""Registered queries on what files refer to: resolution, references, path rules, each with its SQL.

Settings are derived from the bridge's files: folders of layers own aliases,
suppliers have export maps, brands have globs and rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.operators import globjoin, graph, pathrules, resolve, targets
from veinwork.plans.catalog import _with, query
from veinwork.sources import bridge, settings

def _app() -> Column:
    return F.lit("app").alias("app")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return bridge.files(spark, d).select(_app(), "id", "path", "layer", "slice", "role")


@query(_with(
    """SELECT i.id, spec, ord, CASE
    WHEN length(layer) % 2 = 1 THEN 'src/root' || substr(spec, 2)
    WHEN ord = 0 THEN 'src/' || layer || '/ui' || substr(spec, 13) ELSE 'src/kit' || substr(spec, 13) END AS target
  FROM imports i JOIN files f ON f.id = i.id, (VALUES (0), (1)) AS o(ord)
  WHERE spec LIKE '@/components/%' AND (ord = 0 OR length(layer) % 2 = 0)"""
))
def owned_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of the deepest owning folder: the root has one for ``@``; every second layer has its own, and one of two folders for a longer prefix."""
    files = _files(spark, d)
    layers = files.select("layer").distinct().filter(F.length("layer") % 2 == 0)
    folder = F.concat(F.lit("src/"), F.col("layer"))
    row = lambda prefix, ord_, to: F.struct(F.lit(prefix).alias("prefix"), F.lit(ord_).alias("ord"), to.alias("dir"))
    own = layers.select(_app(), folder.alias("owner"), F.explode(F.array(row("@", 0, folder), row("@/components", 0, F.concat(folder, F.lit("/ui"))), row("@/components", 1, F.lit("src/kit")))).alias("x"))
    root = spark.range(1).select(_app(), F.lit("src").alias("owner"), row("@", 0, F.lit("src/root")).alias("x"))
    aliases = own.unionByName(root).select("app", "owner", "x.*")
    owner = targets.owned(files, aliases.select("app", F.col("owner").alias("dir"))).withColumnRenamed("dir", "owner")
    asked = bridge.imports(spark, d).filter("startswith(spec, '@/')").withColumn("app", _app()).join(owner, "id")
    return resolve.alias_targets(asked, aliases).select("id", "spec", "ord", "target")


_SUBPATHS = """
keys AS (
  SELECT 'd' || (s_suppkey % 40) AS dir, s_suppkey AS pos, CASE s_suppkey % 3 WHEN 0 THEN './p' || (s_suppkey % 9) || '/*' WHEN 1 THEN './p*' ELSE './p' || (s_suppkey % 9) || '/*.js' END AS key,
         'src/' || s_suppkey || '/*' AS target FROM supplier
  UNION ALL SELECT 'd' || (s_suppkey % 40), s_suppkey, './p' || (s_suppkey % 9) || '/x3', 'exact/' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0),
wanted AS (
  SELECT DISTINCT 'd' || (l_suppkey % 40) AS dir, './p' || (l_partkey % 9) || '/x' || l_linenumber || CASE WHEN l_partkey % 2 = 0 THEN '.js' ELSE '' END AS subpath FROM lineitem),
"""


@query("WITH " + _SUBPATHS + """
met AS (
  SELECT w.dir, subpath, target, CASE WHEN contains(key, '*') THEN substr(subpath, strpos(key, '*'), length(subpath) - length(key) + 1) ELSE '' END AS star,
         row_number() OVER (PARTITION BY w.dir, subpath ORDER BY contains(key, '*'), CASE WHEN contains(key, '*') THEN -strpos(key, '*') ELSE 0 END, CASE WHEN contains(key, '*') THEN -length(key) ELSE 0 END, pos) AS n
  FROM wanted w JOIN keys k ON w.dir = k.dir AND (key = subpath OR (contains(key, '*') AND length(subpath) >= length(key)
    AND starts_with(subpath, split_part(key, '*', 1)) AND suffix(subpath, split_part(key, '*', 2)))))
SELECT dir, subpath, replace(target, '*', star) AS target FROM met WHERE n = 1""")  # fmt: skip
def subpath_targets(spark: SparkSession, d: str) -> DataFrame:
    """Export maps as rows: the most specific key of the package's map, by literal head, and what its star stands for."""
    supplier, line = bridge.table(spark, d, "supplier").select("s_suppkey"), bridge.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber")
    text = lambda c: F.col(c).cast("string")
    ninth = F.concat(F.lit("./p"), (F.col("s_suppkey") % 9).cast("string"))
    folder = F.concat(F.lit("d"), (F.col("s_suppkey") % 40).cast("string")).alias("dir")
    key = F.when(F.col("s_suppkey") % 3 == 0, F.concat(ninth, F.lit("/*"))).when(F.col("s_suppkey") % 3 == 1, F.lit("./p*")).otherwise(F.concat(ninth, F.lit("/*.js")))
    at = F.col("s_suppkey").cast("int").alias("at")
    starred = supplier.select(_app(), folder, key.alias("key"), at, F.array(F.concat(F.lit("src/"), text("s_suppkey"), F.lit("/*"))).alias("targets"))
    exact = supplier.filter("s_suppkey % 5 = 0").select(_app(), folder, F.concat(ninth, F.lit("/x3")).alias("key"), at, F.array(F.concat(F.lit("exact/"), text("s_suppkey"))).alias("targets"))
    subpath = F.concat(F.lit("./p"), (F.col("l_partkey") % 9).cast("string"), F.lit("/x"), text("l_linenumber"), F.when(F.col("l_partkey") % 2 == 0, ".js").otherwise(""))
    wanted = line.select(_app(), F.concat(F.lit("d"), (F.col("l_suppkey") % 40).cast("string")).alias("dir"), subpath.alias("subpath")).distinct()
    return targets.matched_subpaths(wanted, starred.unionByName(exact)).select("dir", "subpath", "target")


@query(_with(
    """SELECT id, platform, arg_min(dst, (source, ord, place)) AS dst FROM (
    SELECT l_orderkey AS id, f.id AS dst, l_suppkey % 3 AS source, l_partkey AS ord, platform,
           CASE WHEN platform = '' THEN 0 WHEN contains(path, '.ts') AND NOT contains(path, '.tsx') THEN 1 ELSE 2 END AS place
    FROM lineitem JOIN files f ON f.id = l_partkey, (VALUES (''), ('ios')) AS p(platform)
    WHERE f.id % 3 > 0 AND (platform = '' OR l_orderkey % 2 = 0)) GROUP BY id, platform"""
))
def first_targets(spark: SparkSession, d: str) -> DataFrame:
    """The first file that exists, of all sources and platforms of an import in one shuffle: an order's lines are its candidates."""
    files = _files(spark, d)
    line = bridge.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    stems = files.select(F.col("id").alias("l_partkey"), F.regexp_replace("path", r"\.tsx?$", "").alias("target"))
    tried = line.join(stems, "l_partkey").select(_app(), F.col("l_orderkey").alias("id"), F.lit("x").alias("spec"), (F.col("l_suppkey") % 3).cast("int").alias("source"), F.col("l_partkey").cast("int").alias("ord"), "target")
    native = line.filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("id"), F.array(F.lit("ios")).alias("platforms")).distinct()
    return targets.first_hits(tried, files.filter("id % 3 > 0"), native).select("id", "platform", "dst")


_REFERENCES = """
refs AS (
  SELECT src, dst, CASE WHEN dst % 5 = 0 THEN 'import' WHEN dst % 5 = 1 THEN 'type' ELSE 'dynamic' END AS kind FROM edges WHERE dst % 5 < 3
  UNION SELECT l.src, f.id, 'loader' FROM files f JOIN (SELECT layer, min(id) AS src FROM files GROUP BY layer) l ON f.layer = l.layer
  WHERE f.layer LIKE 's%' AND f.path LIKE '%.tsx' AND l.src <> f.id),
"""


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = _files(spark, d)
    edges = bridge.edges(spark, d).filter("dst % 5 < 3")
    kind = F.when(F.col("dst") % 5 == 0, "import").when(F.col("dst") % 5 == 1, "type").otherwise("dynamic")
    globs = files.filter("startswith(layer, 's')").groupBy("app", "layer").agg(F.min("id").alias("id"), F.min_by("path", "id").alias("path")).select("app", "id", "path", F.concat(F.lit("/src/"), "layer", F.lit("/**/*.tsx")).alias("glob"))
    loaded = globjoin.loaded(globs, files).select(F.col("id").alias("src"), "dst", F.lit("loader").alias("kind"))
    return files, edges.select("src", "dst", kind.alias("kind")).unionByName(loaded).filter("src <> dst").distinct()


@query(_with("SELECT kind, count(*) AS n, count(DISTINCT dst) AS files FROM refs GROUP BY kind", ", " + _REFERENCES.strip().removesuffix(",")))
def reference_kinds(spark: SparkSession, d: str) -> DataFrame:
    """References by kind: imports of three kinds, and what files load by glob."""
    return _references(spark, d)[1].groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("files"))


@query(_with(
    """SELECT path, CASE WHEN id % 13 = 0 THEN 'shipped' WHEN seen IS NULL THEN 'orphan' ELSE 'test_only' END AS kind
  FROM files f LEFT JOIN (SELECT dst, bool_and(coalesce(s.role = 'TEST', false)) AS seen FROM refs LEFT JOIN files s ON s.id = refs.src GROUP BY dst) r ON r.dst = f.id
  WHERE role <> 'TEST' AND role <> 'CONTROLLER' AND coalesce(seen, true)""", ", " + _REFERENCES.strip().removesuffix(","),
))
def unreferenced_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that no reference of any kind, or only those of tests, leads to, with those that a package ships."""
    files, refs = _references(spark, d)
    return graph.orphans(files, refs, F.col("role") == "CONTROLLER", F.col("id") % 13 == 0)


@query(_with(
    """SELECT slice, f.path FROM (SELECT DISTINCT slice FROM files) g JOIN files f USING (slice) WHERE regexp_matches(f.path, '^src/([^/]+/)*' || slice || '/[^/]*\\.(service|test)\\.ts$')"""
))
def globbed_files(spark: SparkSession, d: str) -> DataFrame:
    """Globs of two large sides: one of each brand against all paths, with alternatives in braces."""
    files = _files(spark, d)
    globs = files.select("app", "slice", F.concat(F.lit("src/**/"), "slice", F.lit("/*.{service,test}.ts")).alias("glob")).distinct()
    return globjoin.matches(globs, files).select("slice", "path")


@query(_with(
    """SELECT id, 'src/' || layer AS dir FROM files WHERE slice LIKE '%1' AND path NOT LIKE '%.service.ts' OR path LIKE '%.test.ts'
  UNION SELECT id, 'src' FROM files WHERE path LIKE '%.stories.tsx' AND id % 10 <> 3"""
))
def ignored_files(spark: SparkSession, d: str) -> DataFrame:
    """Ignore files of the root and of every layer: folders, extensions, and lines that keep what an earlier one leaves out."""
    files = _files(spark, d)
    text = lambda dir_, lines: [F.struct(F.lit(k).alias("line"), F.lit(x).alias("text")) for k, x in enumerate(lines)]
    layers = files.select("app", F.concat(F.lit("src/"), "layer").alias("dir")).distinct()
    own = layers.select("app", "dir", F.explode(F.array(*text("", ["# of a layer", "brand-*1/*", "!*.service.ts", "/**/*.test.ts"]))).alias("x"))
    root = spark.range(1).select(_app(), F.lit("src").alias("dir"), F.explode(F.array(*text("", ["*.stories.tsx", "!*3.stories.tsx"]))).alias("x"))
    return pathrules.left_out(files, own.unionByName(root).select("app", "dir", "x.*"))


@query("""
WITH built AS (SELECT 'pkg/s' || (s_suppkey % 20) AS dir, 'pkg/s' || (s_suppkey % 20) || CASE s_suppkey % 4 WHEN 0 THEN '/dist/esm/f' WHEN 1 THEN '/dist/f' WHEN 2 THEN '/out/f' ELSE '/f' END || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.d.ts' ELSE '.js' END AS target, s_suppkey AS k FROM supplier)
SELECT DISTINCT dir, target, replace(CASE k % 4 WHEN 0 THEN dir || CASE WHEN k % 20 < 10 THEN '/module/f' ELSE '/src/esm/f' END WHEN 1 THEN dir || '/src/f' WHEN 2 THEN 'common/' || dir || '/out/f' ELSE 'common/' || dir || '/f' END || k || CASE WHEN k % 2 = 0 THEN '.d.ts' ELSE '.js' END, '.d.ts', '.js') AS moved
FROM built""")
def built_entries(spark: SparkSession, d: str) -> DataFrame:
    """What manifests name in folders that are compiled to, moved to where it is compiled from, by the deepest folder of the owning configurations."""
    key = F.col("s_suppkey")
    supplier = bridge.table(spark, d, "supplier").select("s_suppkey")
    folder = F.concat(F.lit("pkg/s"), (key % 20).cast("string"))
    place = F.when(key % 4 == 0, "/dist/esm/f").when(key % 4 == 1, "/dist/f").when(key % 4 == 2, "/out/f").otherwise("/f")
    built = supplier.select(_app(), folder.alias("dir"), F.concat(folder, place, key.cast("string"), F.when(key % 2 == 0, ".d.ts").otherwise(".js")).alias("target"))
    owners = built.select("app", F.col("dir").alias("owner")).distinct()
    row = lambda out, root: F.struct(F.concat("owner", F.lit(out)).alias("out"), F.concat("owner", F.lit(root)).alias("root"))
    number = F.substring("owner", 6, 2).cast("int")
    own = owners.select("app", "owner", F.explode(F.array(row("/dist", "/src"), F.when(number < 10, row("/dist/esm", "/module")).otherwise(row("/dist", "/src")))).alias("x")).select("app", "owner", "x.*")
    above = spark.range(1).select(_app(), F.lit("").alias("owner"), F.lit("").alias("out"), F.lit("common").alias("root"))
    return settings.sources_of(built, own.unionByName(above).distinct()).select("dir", "target", "moved")
