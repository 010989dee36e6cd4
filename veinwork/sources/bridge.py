"""Relations of a code base, derived from warehouse tables by fixed rules.

``files`` come from part, ``edges`` and ``imports`` from lineitem, a cyclic
graph and two snapshots from events.  ``SQL`` states the same rules as common
table expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.functions import paths, roles

_SUFFIXES = (".controller.ts", ".service.ts", ".repository.ts", ".test.ts", ".stories.tsx", ".tsx", ".ts")


#: Relations that are worked out once for all queries built inside ``shared``, by folder and name.
_shared: dict[tuple[str, str], DataFrame] = {}


@contextmanager
def shared(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame]) -> Iterator[None]:
    """What is built inside reads files, edges and imports as ``keep`` stored them, instead of deriving them anew each time."""
    for relation in (files, edges, imports):
        _shared[sf_dir, relation.__name__] = keep(relation(spark, sf_dir))
    try:
        yield
    finally:
        for relation in (files, edges, imports):
            _shared.pop((sf_dir, relation.__name__), None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _suffix(size: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (size % 7 + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, layer, slice, role, role_confidence, matched_rule."""
    if (sf_dir, "files") in _shared:
        return _shared[sf_dir, "files"]
    part = table(spark, sf_dir, "part")
    slice_ = F.replace("p_brand", F.lit("#"), F.lit("-"))
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.lower(slice_), F.lit("/p"), F.col("p_partkey").cast("string"), _suffix(F.col("p_size")))
    named = part.select(F.col("p_partkey").alias("id"), path.alias("path"), F.lower(slice_).alias("slice"))
    return named.select("id", "path", paths.layer_of(F.col("path")).alias("layer"), "slice", roles.classify(F.col("path")).alias("c")).select("id", "path", "layer", "slice", "c.*")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: distinct imports between files, one join of lineitem with itself and two lookups."""
    if (sf_dir, "edges") in _shared:
        return _shared[sf_dir, "edges"]
    line = table(spark, sf_dir, "lineitem")
    a = line.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").alias("src"))
    b = line.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("dst"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    pairs = a.join(b, ["o", "n"]).select("src", "dst").distinct()
    typed = pairs.join(part.select(F.col("p_partkey").alias("src"), F.col("p_type").alias("ts")), "src").join(part.select(F.col("p_partkey").alias("dst"), F.col("p_type").alias("td")), "dst")
    keep = ((F.col("src") > F.col("dst")) & (F.col("ts") >= F.col("td"))) | ((F.col("src") % 97 == 0) & (F.col("dst") % 3 == 0))
    return typed.filter(keep).select("src", "dst")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, spec: specifiers of several kinds."""
    if (sf_dir, "imports") in _shared:
        return _shared[sf_dir, "imports"]
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    supp = F.col("l_suppkey").cast("string")
    kind = F.col("l_linenumber")
    spec = (
        F.when((kind == 1) & (F.col("l_quantity") < 10), F.concat(F.lit("pkg"), supp, F.when(F.col("l_suppkey") % 41 == 0, "/internal/x").otherwise("")))
        .when(kind == 2, F.concat(F.when(F.col("l_suppkey") % 60 == 1, "../../../shared/").otherwise("../shared/"), (F.col("l_suppkey") % 10).cast("string")))
        .when((kind == 3) & (F.col("l_suppkey") % 29 == 0), F.concat(F.lit("@/components/c"), (F.col("l_suppkey") % 10).cast("string")))
        .when((kind == 4) & (F.col("l_quantity") < 5), F.concat(F.lit("@scope/lib"), (F.col("l_suppkey") % 7).cast("string"), F.when(F.col("l_suppkey") % 53 == 0, "/src/x").otherwise("")))
        .when((kind == 5) & (F.col("l_quantity") < 3), F.lit("node:fs"))
        .when((kind == 6) & (F.col("l_quantity") < 3), F.lit("server-only"))
    )
    return line.select(F.col("l_partkey").alias("id"), spec.alias("spec")).filter("spec IS NOT NULL").distinct()


def user_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: each user points at the user of the event after its own first one."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    first = events.groupBy(F.col("user_id").alias("src")).agg((F.min("event_id") + 1).alias("event_id"))
    return first.join(events, "event_id").select("src", F.col("user_id").alias("dst"))


def snapshot(spark: SparkSession, sf_dir: str, dropped: int) -> DataFrame:
    """Findings: rule_id, file, line; the rows of events whose id modulo 10 is not ``dropped``."""
    events = table(spark, sf_dir, "events").filter(F.col("event_id") % 10 != dropped)
    return events.select(F.col("event_type").alias("rule_id"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("line"))


SQL = f"""
WITH named AS (
  SELECT p_partkey AS id, lower(replace(p_brand, '#', '-')) AS slice, lower(p_type) AS layer,
         'src/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '-')) || '/p' || p_partkey ||
         ['.controller.ts', '.service.ts', '.repository.ts', '.test.ts', '.stories.tsx', '.tsx', '.ts'][p_size % 7 + 1] AS path
  FROM part),
files AS (SELECT *, {roles.case_sql("path", 0)} AS role, {roles.case_sql("path", 1)} AS matched_rule, ({roles.case_sql("path", 3)})::DOUBLE AS role_confidence FROM named),
edges AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  JOIN part s ON s.p_partkey = a.l_partkey JOIN part d ON d.p_partkey = b.l_partkey
  WHERE (a.l_partkey > b.l_partkey AND s.p_type >= d.p_type) OR (a.l_partkey % 97 = 0 AND b.l_partkey % 3 = 0)),
imports AS (
  SELECT DISTINCT l_partkey AS id, spec FROM (SELECT l_partkey, CASE
    WHEN l_linenumber = 1 AND l_quantity < 10 THEN 'pkg' || l_suppkey || CASE WHEN l_suppkey % 41 = 0 THEN '/internal/x' ELSE '' END
    WHEN l_linenumber = 2 THEN CASE WHEN l_suppkey % 60 = 1 THEN '../../../shared/' ELSE '../shared/' END || (l_suppkey % 10)
    WHEN l_linenumber = 3 AND l_suppkey % 29 = 0 THEN '@/components/c' || (l_suppkey % 10)
    WHEN l_linenumber = 4 AND l_quantity < 5 THEN '@scope/lib' || (l_suppkey % 7) || CASE WHEN l_suppkey % 53 = 0 THEN '/src/x' ELSE '' END
    WHEN l_linenumber = 5 AND l_quantity < 3 THEN 'node:fs'
    WHEN l_linenumber = 6 AND l_quantity < 3 THEN 'server-only' END AS spec FROM lineitem) WHERE spec IS NOT NULL),
ugraph AS (
  SELECT f.src, e.user_id AS dst FROM (SELECT user_id AS src, min(event_id) + 1 AS event_id FROM events GROUP BY 1) f JOIN events e USING (event_id)),
base AS (SELECT event_type AS rule_id, 'f' || user_id AS file, event_id AS line FROM events WHERE event_id % 10 <> 0),
head AS (SELECT event_type AS rule_id, 'f' || user_id AS file, event_id AS line FROM events WHERE event_id % 10 <> 1)
"""
