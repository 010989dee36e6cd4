"""Registered queries over the bridge relations, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.functions import paths, prose, roles
from veinwork.functions.stats import gate, gate_sql, wilson_sql
from veinwork.operators import change, detectors, emit, findings, graph, pathrules, references, resolve, rules
from veinwork.plans import scan as plan
from veinwork.sources import bridge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _with(body: str, more: str = "") -> str:
    return bridge.SQL + more + body


ALIASES = ("@/components",)
_PACKAGE = """packages AS (
  SELECT id, spec, CASE WHEN spec LIKE '@%' THEN split_part(spec, '/', 1) || '/' || split_part(spec, '/', 2) ELSE split_part(spec, '/', 1) END AS package
  FROM imports WHERE spec NOT LIKE '.%' AND spec NOT LIKE '#%' AND NOT regexp_matches(spec, '(?i)^[a-z][a-z0-9+.-]*:') AND NOT (spec = '@/components' OR spec LIKE '@/components/%')),
"""


def _pairs_sql(group: str, names: tuple[str, str], least: int, member: str, mean: bool) -> str:
    direction = wilson_sql("reverse_flow", "violators + reverse_flow")
    exact = f"least({direction}, (s.conf + t.conf) / (s.n + t.n))" if mean else direction
    return _with(
        f"""
SELECT from_group AS {names[0]}, to_group AS {names[1]}, population, violators, reverse_flow, floor(exact * 10000 + 0.5) / 10000 AS role_confidence,
       {gate_sql("population", "violators", "exact")}
FROM (SELECT from_group, to_group, s.n AS population, violators, reverse_flow, {exact} AS exact
      FROM aimed JOIN sizes s ON s.g = from_group JOIN sizes t ON t.g = to_group WHERE s.n >= {least} AND t.n >= {least})""",
        f""",
member AS (SELECT id, {group} AS g, role_confidence FROM files WHERE {member}),
sizes AS (SELECT g, count(*) AS n, sum(role_confidence) AS conf FROM member GROUP BY 1),
flow AS (SELECT a.g AS a, b.g AS b, count(DISTINCT src) AS n FROM edges JOIN member a ON a.id = src JOIN member b ON b.id = dst WHERE a.g <> b.g GROUP BY 1, 2),
pairs AS (SELECT least(a, b) AS x, greatest(a, b) AS y, coalesce(sum(n) FILTER (a < b), 0)::BIGINT AS xy, coalesce(sum(n) FILTER (a > b), 0)::BIGINT AS yx FROM flow GROUP BY 1, 2),
aimed AS (SELECT CASE WHEN xy <= yx THEN x ELSE y END AS from_group, CASE WHEN xy <= yx THEN y ELSE x END AS to_group, least(xy, yx) AS violators, greatest(xy, yx) AS reverse_flow FROM pairs)
""",
    )


_LAYERS = _pairs_sql("layer", ("from_layer", "to_layer"), detectors.MIN_LAYER, "true", False)


@query(_LAYERS)
def layer_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return detectors.layer_boundaries(bridge.files(spark, d), bridge.edges(spark, d))


@query(f"WITH lb AS ({_LAYERS}) SELECT to_layer AS from_layer, from_layer AS to_layer, reverse_flow AS weight, false AS leak FROM lb UNION ALL SELECT from_layer, to_layer, violators, true FROM lb WHERE violators > 0")
def layer_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return rules.graph_edges(layer_boundaries(spark, d))


@query(_with("SELECT role, matched_rule, count(*) AS n, round(avg(role_confidence), 6) AS avg_confidence FROM files GROUP BY 1, 2"))
def role_classification(spark: SparkSession, d: str) -> DataFrame:
    return bridge.files(spark, d).groupBy("role", "matched_rule").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("role_confidence"), 6).alias("avg_confidence"))


@query(_pairs_sql("role", ("from_role", "to_role"), 1, "role IN ('CONTROLLER', 'SERVICE', 'REPOSITORY', 'DATA_ACCESS', 'DB_MODULE')", True))
def role_layering(spark: SparkSession, d: str) -> DataFrame:
    return detectors.role_layering(bridge.files(spark, d), bridge.edges(spark, d))


def _siblings_sql(container: str, member: str) -> str:
    return _with(
        f"SELECT container, count(DISTINCT member) AS members, count(*) AS files, count(*) FILTER (crosses) AS cross_importers, {gate_sql('count(*)', 'count(*) FILTER (crosses)', '1.0')} FROM rows GROUP BY 1 HAVING count(DISTINCT member) >= 2",
        f""",
m AS (SELECT id, {container} AS container, {member} AS member FROM files),
x AS (SELECT DISTINCT src FROM edges JOIN m a ON a.id = src JOIN m b ON b.id = dst AND b.container = a.container WHERE a.member <> b.member),
rows AS (SELECT m.*, x.src IS NOT NULL AS crosses FROM m LEFT JOIN x ON x.src = m.id)
""",
    )


def _in_containers(spark: SparkSession, d: str, prefix: str, containers: tuple[str, ...]) -> DataFrame:
    files = bridge.files(spark, d).withColumn("path", F.concat(F.lit(prefix), F.expr("substring(path, 4)")))
    return detectors.sibling_isolation(detectors.members_of(files, containers), bridge.edges(spark, d))


@query(_siblings_sql("'src/features'", "layer"))
def feature_slice_isolation(spark: SparkSession, d: str) -> DataFrame:
    return _in_containers(spark, d, "src/features", ("features", "modules", "slices", "domains"))


@query(_siblings_sql("'apps'", "layer"))
def app_isolation(spark: SparkSession, d: str) -> DataFrame:
    return _in_containers(spark, d, "apps", ("apps", "services"))


def _measure_sql(rows: str, role: str = "1.0", applicable: str = "true", more: str = "") -> str:
    """rows: SQL with (member, violates)."""
    n, v = "count(DISTINCT member)", "count(DISTINCT member) FILTER (violates)"
    return _with(f"SELECT {n} AS population, {v} AS violators, {gate_sql(n, v, role, applicable)} FROM ({rows})", more)


@query(_measure_sql("SELECT f.id AS member, EXISTS (SELECT 1 FROM edges JOIN files t ON t.id = dst AND t.role = 'TEST' WHERE src = f.id) AS violates FROM files f WHERE role <> 'TEST'", applicable="(SELECT count(*) > 0 FROM files WHERE role = 'TEST')"))
def test_isolation(spark: SparkSession, d: str) -> DataFrame:
    return detectors.test_isolation(bridge.files(spark, d), bridge.edges(spark, d))


_ENTRY = "f.id IN (SELECT id FROM entries)"


@query(_measure_sql("SELECT id AS member, EXISTS (SELECT 1 FROM edges WHERE dst = id AND src NOT IN (SELECT id FROM entries)) AS violates FROM entries", applicable="count(DISTINCT member) > 0", more=", entries AS (SELECT id, path FROM files WHERE role = 'CONTROLLER')"))
def entry_purity(spark: SparkSession, d: str) -> DataFrame:
    return detectors.entry_purity(bridge.files(spark, d), bridge.edges(spark, d), F.col("role") == "CONTROLLER")


@query(_with("SELECT e.path AS entry, min(f.path) AS importer FROM edges JOIN files e ON e.id = dst AND e.role = 'CONTROLLER' JOIN files f ON f.id = src WHERE f.role <> 'CONTROLLER' GROUP BY 1"))
def entry_importers(spark: SparkSession, d: str) -> DataFrame:
    return detectors.entry_importers(bridge.files(spark, d), bridge.edges(spark, d), F.col("role") == "CONTROLLER")


@query(_measure_sql("SELECT id AS member, EXISTS (SELECT 1 FROM edges WHERE dst = id AND src NOT IN (SELECT id FROM entries)) AS violates FROM entries", applicable="count(DISTINCT member) > 0", more=r", entries AS (SELECT id, path FROM files WHERE regexp_matches(path, '\.stories\.(ts|tsx)$'))"))
def stories_isolation(spark: SparkSession, d: str) -> DataFrame:
    return detectors.entry_purity(bridge.files(spark, d), bridge.edges(spark, d), F.col("path").rlike(paths.STORY))


@query(_measure_sql("SELECT f.id AS member, role_confidence, EXISTS (SELECT 1 FROM edges JOIN files t ON t.id = dst AND t.role = 'REPOSITORY' WHERE src = f.id) AS violates FROM files f WHERE role = 'COMPONENT'", role="avg(role_confidence)", applicable="(SELECT count(*) > 0 FROM files WHERE role = 'REPOSITORY')"))
def ui_data_isolation(spark: SparkSession, d: str) -> DataFrame:
    return detectors.reaches_role(bridge.files(spark, d), bridge.edges(spark, d), F.col("role") == "COMPONENT", F.col("role").isin("REPOSITORY", "DB_MODULE", "DATA_ACCESS"))


@query(_measure_sql("SELECT f.id AS member, f.id IN (SELECT id FROM srv) OR EXISTS (SELECT 1 FROM edges WHERE src = f.id AND dst IN (SELECT id FROM srv)) AS violates FROM files f WHERE role = 'COMPONENT'", applicable="(SELECT count(*) > 0 FROM srv)", more=", srv AS (SELECT DISTINCT id FROM imports WHERE spec = 'server-only')"))
def server_client(spark: SparkSession, d: str) -> DataFrame:
    return detectors.server_client(bridge.files(spark, d), bridge.edges(spark, d), bridge.imports(spark, d), F.col("role") == "COMPONENT")


@query(
    _with(
        f"""SELECT dir, internals, consumers, deep_importers, {gate_sql("consumers", "deep_importers", "1.0")} FROM (
SELECT dir, count(DISTINCT src) AS consumers, count(DISTINCT src) FILTER (dst <> barrel_id) AS deep_importers FROM use GROUP BY 1) JOIN inside USING (dir)""",
        """, b AS (SELECT 'src/' || layer || '/' || slice AS dir, min(id) AS barrel_id FROM files GROUP BY 1),
near AS (SELECT f.id, dir, barrel_id FROM files f JOIN b ON b.dir = 'src/' || f.layer || '/' || f.slice),
inside AS (SELECT dir, count(*) AS internals FROM near WHERE id <> barrel_id GROUP BY 1),
use AS (SELECT e.src, e.dst, n.dir, n.barrel_id FROM edges e JOIN near n ON n.id = e.dst JOIN near s ON s.id = e.src WHERE s.dir <> n.dir)
""",
    )
)
def public_api_boundaries(spark: SparkSession, d: str) -> DataFrame:
    files = bridge.files(spark, d)
    barrels = files.groupBy(paths.directory(F.col("path")).alias("dir")).agg(F.min("id").alias("id"))
    return detectors.public_api(files, bridge.edges(spark, d), barrels)


@query(_measure_sql(r"SELECT id AS member, regexp_matches(spec, '^(\.\./){3,}') AS violates FROM imports WHERE spec LIKE '.%'"))
def import_style(spark: SparkSession, d: str) -> DataFrame:
    return detectors.import_style(bridge.imports(spark, d))


@query(_measure_sql("SELECT id AS member, split_part(substr(spec, length(package) + 2), '/', 1) IN ('src', 'internal', 'internals') AS violates FROM packages", more=", " + _PACKAGE.rstrip(",\n") + "\n"))
def package_hygiene(spark: SparkSession, d: str) -> DataFrame:
    return detectors.package_hygiene(bridge.imports(spark, d), ALIASES)


@query(_measure_sql("SELECT id AS member, package NOT IN (SELECT package FROM declared) AS violates FROM packages", more=", " + _PACKAGE + "declared AS (SELECT 'pkg' || s_suppkey AS package FROM supplier WHERE s_suppkey % 50 <> 7 UNION ALL SELECT '@scope/lib' || i FROM range(7) t(i) UNION ALL SELECT 'server-only')\n"))
def phantom_dependencies(spark: SparkSession, d: str) -> DataFrame:
    own = bridge.table(spark, d, "supplier").filter("s_suppkey % 50 <> 7").select(F.concat(F.lit("pkg"), F.col("s_suppkey").cast("string")).alias("package"))
    scoped = spark.range(7).select(F.concat(F.lit("@scope/lib"), F.col("id").cast("string")).alias("package"))
    declared = own.unionByName(scoped).unionByName(spark.range(1).select(F.lit("server-only").alias("package")))
    return detectors.phantom_dependencies(bridge.imports(spark, d), declared, ALIASES)


@query(_measure_sql("SELECT id AS member, sub <> '' AND sub NOT IN ('index') AS violates FROM (SELECT id, CASE WHEN spec = name THEN '' ELSE substr(spec, length(name) + 2) END AS sub FROM imports JOIN (SELECT '@scope/lib' || i AS name FROM range(6) t(i)) ON spec = name OR spec LIKE name || '/%')"))
def workspace_package_api(spark: SparkSession, d: str) -> DataFrame:
    packages = spark.range(7).select(F.concat(F.lit("@scope/lib"), F.col("id").cast("string")).alias("name"), F.array(F.lit("index")).alias("exports"), (F.col("id") == 6).alias("open"))
    return detectors.workspace_api(bridge.imports(spark, d), packages)


def _usage(spark: SparkSession, d: str, kind: int) -> DataFrame:
    return bridge.table(spark, d, "lineitem").filter(f"l_linenumber = {kind} AND l_quantity < 2").select(F.col("l_partkey").alias("id"))


_USED = "SELECT f.id AS member, f.id IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = {} AND l_quantity < 2) AS violates FROM files f WHERE {}"


@query(_measure_sql(_USED.format(7, "role <> 'TEST' AND slice <> 'brand-1'")))
def console_isolation(spark: SparkSession, d: str) -> DataFrame:
    return detectors.usage_isolation(bridge.files(spark, d), _usage(spark, d, 7), (F.col("role") != "TEST") & (F.col("slice") != "brand-1") & ~F.col("path").rlike(paths.CLI_PATH), False)


@query(_measure_sql(_USED.format(3, "slice <> 'brand-2'"), applicable="(SELECT count(*) > 0 FROM lineitem WHERE l_linenumber = 3 AND l_quantity < 2)"))
def env_access(spark: SparkSession, d: str) -> DataFrame:
    return detectors.usage_isolation(bridge.files(spark, d), _usage(spark, d, 3), (F.col("slice") != "brand-2") & ~F.col("path").rlike(paths.CONFIG_PATH), True)


@query(_with("SELECT path, CASE WHEN tests IS NULL THEN 'orphan' ELSE 'test_only' END AS kind FROM (SELECT f.path, f.role, bool_and(r.role = 'TEST') AS tests FROM files f LEFT JOIN edges e ON e.dst = f.id AND e.src <> e.dst LEFT JOIN files r ON r.id = e.src GROUP BY 1, 2) WHERE role NOT IN ('TEST', 'CONTROLLER') AND path NOT LIKE '%.stories.tsx' AND (tests IS NULL OR tests)"))
def orphans(spark: SparkSession, d: str) -> DataFrame:
    entry = F.col("role").isin(*roles.REQUEST_ENTRY, "ROUTE_ENTRY") | F.col("path").rlike(paths.ENTRY_FILE) | F.col("path").rlike(paths.STORY) | F.col("path").rlike(paths.APP_FILE) | F.col("path").rlike(paths.ROOT_FILE)
    return graph.orphans(bridge.files(spark, d), bridge.edges(spark, d), entry)


_CLOSURE = "WITH RECURSIVE " + bridge.SQL.replace("WITH ", "", 1) + ", reach AS (SELECT src, dst FROM ugraph UNION SELECT r.src, g.dst FROM reach r JOIN ugraph g ON g.src = r.dst), cyc AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src GROUP BY 1, a.src)\n"


def _user_app(spark: SparkSession, d: str) -> DataFrame:
    return bridge.user_graph(spark, d).withColumn("app", F.lit("events"))


@query(_CLOSURE + "SELECT node, component FROM cyc")
def cyclic_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.cyclic_nodes(_user_app(spark, d)).select("node", "component")


@query(_CLOSURE + "SELECT g.src, g.dst FROM ugraph g JOIN cyc a ON a.node = g.src JOIN cyc b ON b.node = g.dst AND a.component = b.component")
def cycle_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = _user_app(spark, d)
    return graph.cycle_edges(edges, graph.cyclic_nodes(edges)).select("src", "dst")


@query(_CLOSURE + "SELECT component, count(*) AS size, count(*) + 1 AS loop_length FROM cyc GROUP BY 1")
def cycle_loops(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycle_loops(_user_app(spark, d)).select("component", "size", F.size("loop").cast("long").alias("loop_length"))


@query(_CLOSURE + "SELECT DISTINCT 'l' || (src % 5) AS from_layer, 'l' || (dst % 5) AS to_layer FROM reach")
def layer_reachability(spark: SparkSession, d: str) -> DataFrame:
    edges = _user_app(spark, d)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    layers = nodes.select(F.lit("events").alias("app"), "node", F.concat(F.lit("l"), (F.col("node") % 5).cast("string")).alias("layer"))
    return graph.layer_reachability(edges, layers).select("from_layer", "to_layer")


def _part_layers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = bridge.files(spark, d)
    edges = bridge.edges(spark, d)
    flows = edges.join(files.select(F.col("id").alias("src"), F.col("layer").alias("a")), "src").join(files.select(F.col("id").alias("dst"), F.col("layer").alias("b")), "dst")
    # layer graph without the rare flows against the grain, as a graph of layer names
    return files, flows.filter("a > b").select("a", "b").distinct()


@query(
    f"WITH RECURSIVE lb AS ({_LAYERS}), g AS (SELECT to_layer AS a, from_layer AS b FROM lb), r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b) "
    "SELECT from_layer, to_layer, EXISTS (SELECT 1 FROM r WHERE r.a = from_layer AND r.b = to_layer) AS leaks FROM lb"
)
def transitive_leaks(spark: SparkSession, d: str) -> DataFrame:
    bounds = layer_boundaries(spark, d)
    names = bounds.select(F.col("to_layer").alias("a"), F.col("from_layer").alias("b"))
    number = lambda c: F.xxhash64(c)
    edges = names.select(F.lit("layers").alias("app"), number("a").alias("src"), number("b").alias("dst"))
    every = names.select(F.col("a").alias("layer")).union(names.select(F.col("b").alias("layer"))).distinct()
    layers = every.select(F.lit("layers").alias("app"), number("layer").alias("node"), "layer")
    reach = graph.layer_reachability(edges, layers).select("from_layer", "to_layer", F.lit(True).alias("hit"))
    return bounds.join(reach, ["from_layer", "to_layer"], "left").select("from_layer", "to_layer", F.coalesce("hit", F.lit(False)).alias("leaks"))


_MARKED = _with(
    """SELECT segment, component_files, other_files, component_files / (component_files + other_files) AS specificity, component_files / total AS coverage
FROM c, (SELECT count(*) AS total FROM files WHERE role = 'COMPONENT') WHERE total >= 5 AND component_files >= 3 AND component_files / (component_files + other_files) >= 0.1
ORDER BY component_files / total * (component_files / (component_files + other_files)) DESC, segment LIMIT 8""",
    ", s AS (SELECT role = 'COMPONENT' AS ui, unnest([layer, slice]) AS segment FROM files), c AS (SELECT segment, count(*) FILTER (ui) AS component_files, count(*) FILTER (NOT ui) AS other_files FROM s GROUP BY 1)\n",
)


@query(_MARKED)
def marker_inference(spark: SparkSession, d: str) -> DataFrame:
    return detectors.ui_markers(bridge.files(spark, d), specific=0.1)


MARKERS = {"AP-001": r"^@scope/lib[0-6]", "AP-002": r"^pkg\d*7(/|$)", "AP-003": r"^(node:fs|server-only)$"}


@query(
    _with(
        "SELECT rule_id, population, violators, floor, observed, status, infra_caution FROM ("
        + " UNION ALL ".join(
            f"SELECT '{rule}' AS rule_id, count(*) AS population, count(*) FILTER (v) AS violators, {gate_sql('count(*)', 'count(*) FILTER (v)', 'avg(role_confidence)')}, false AS infra_caution FROM (SELECT role_confidence, id IN (SELECT id FROM imports WHERE regexp_matches(spec, '{pattern}')) AS v FROM files WHERE role = 'CONTROLLER')"
            for rule, pattern in MARKERS.items()
        )
        + ")"
    )
)
def forbidden_imports(spark: SparkSession, d: str) -> DataFrame:
    return detectors.forbidden_imports(bridge.files(spark, d), bridge.imports(spark, d), MARKERS)


@query(_with("SELECT path, min(spec) AS spec FROM imports JOIN files USING (id) WHERE regexp_matches(spec, '^@scope/') GROUP BY 1"))
def import_evidence(spark: SparkSession, d: str) -> DataFrame:
    return detectors.first_evidence(bridge.files(spark, d), bridge.imports(spark, d), "^@scope/")


@query(f"SELECT supplier, line, n, v, role, {gate_sql('n', 'v', 'role')} FROM (SELECT l_suppkey AS supplier, l_linenumber AS line, count(*) AS n, count(*) FILTER (l_quantity < 2 + l_suppkey % 5) AS v, (l_suppkey % 7 + 4) / 10.0::DOUBLE AS role FROM lineitem GROUP BY ALL)")
def gate_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The gate of a population for each supplier and line number, of many sizes, violations and confidences."""
    line = bridge.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_linenumber").alias("line"), "l_quantity")
    few = F.col("l_quantity") < 2 + F.col("supplier") % 5
    grid = line.groupBy("supplier", "line").agg(F.count(F.lit(1)).alias("n"), F.count_if(few).alias("v")).withColumn("role", ((F.col("supplier") % 7 + 4) / 10.0).cast("double"))
    return grid.withColumns(gate(F.col("n"), F.col("v"), F.col("role")))


_GROWN = ", counts AS (SELECT coalesce(b.rule_id, h.rule_id) AS rule_id, coalesce(b.file, h.file) AS file, coalesce(b.n, 0) AS base_n, coalesce(h.n, 0) AS head_n FROM (SELECT rule_id, file, count(*) AS n FROM base GROUP BY 1, 2) b FULL JOIN (SELECT rule_id, file, count(*) AS n FROM head GROUP BY 1, 2) h ON b.rule_id = h.rule_id AND b.file = h.file)\n"


@query(_with("SELECT * FROM counts", _GROWN))
def findings_diff(spark: SparkSession, d: str) -> DataFrame:
    return change.grown(bridge.snapshot(spark, d, 0), bridge.snapshot(spark, d, 1))


@query(
    _with(
        "SELECT rule_id, file, line FROM m WHERE base_n = 0 OR on_added <> head_n - base_n OR is_added",
        _GROWN + ", m AS (SELECT h.*, base_n, head_n, line % 10 = 0 AS is_added, count(*) FILTER (line % 10 = 0) OVER (PARTITION BY rule_id, file) AS on_added FROM head h JOIN counts USING (rule_id, file) WHERE head_n > base_n)\n",
    )
)
def findings_introduced(spark: SparkSession, d: str) -> DataFrame:
    head = bridge.snapshot(spark, d, 1)
    return change.introduced(bridge.snapshot(spark, d, 0), head, head.filter("line % 10 = 0"))


@query(_with("SELECT rule_id, file, line FROM (SELECT b.*, head_n, row_number() OVER (PARTITION BY rule_id, file ORDER BY line) AS place FROM base b JOIN counts USING (rule_id, file) WHERE base_n > head_n) WHERE place > head_n", _GROWN))
def findings_fixed(spark: SparkSession, d: str) -> DataFrame:
    return change.fixed(bridge.snapshot(spark, d, 0), bridge.snapshot(spark, d, 1))


@query(
    _with(
        "SELECT coalesce(b.id, h.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN h.id IS NULL THEN 'removed' WHEN b.d = h.d THEN 'comparable' ELSE 'changed' END AS change FROM b FULL JOIN h ON b.id = h.id",
        ", b AS (SELECT 'r' || c_custkey AS id, c_mktsegment AS d FROM customer WHERE c_custkey % 7 <> 0), h AS (SELECT 'r' || c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE c_mktsegment END AS d FROM customer WHERE c_custkey % 11 <> 0)\n",
    )
)
def rule_partition(spark: SparkSession, d: str) -> DataFrame:
    customer = bridge.table(spark, d, "customer")
    name = F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("id")
    base = customer.filter("c_custkey % 7 <> 0").select(name, F.col("c_mktsegment").alias("definition"))
    head = customer.filter("c_custkey % 11 <> 0").select(name, F.when(F.col("c_custkey") % 5 == 0, "other").otherwise(F.col("c_mktsegment")).alias("definition"))
    return change.rule_partition(base, head)


def _exceptions(spark: SparkSession, d: str, dropped: int) -> DataFrame:
    return bridge.snapshot(spark, d, dropped).select(F.col("rule_id").alias("rule"), F.col("file").alias("exception")).distinct()


@query(_with("SELECT rule, count(*) FILTER (cur AND NOT rec) AS new_n, count(*) FILTER (rec AND NOT cur) AS fixed_n, count(*) FILTER (rec AND cur) AS left_n FROM (SELECT rule, exception, bool_or(s = 0) AS rec, bool_or(s = 1) AS cur FROM (SELECT rule_id AS rule, file AS exception, 0 AS s FROM base WHERE line % 3 = 0 UNION ALL SELECT rule_id, file, 1 FROM head WHERE line % 3 = 1) GROUP BY 1, 2) GROUP BY 1 HAVING bool_or(rec) AND bool_or(cur)"))
def exception_ratchet(spark: SparkSession, d: str) -> DataFrame:
    as_exceptions = lambda df: df.select(F.col("rule_id").alias("rule"), F.col("file").alias("exception"))
    return change.ratchet(as_exceptions(bridge.snapshot(spark, d, 0).filter("line % 3 = 0")), as_exceptions(bridge.snapshot(spark, d, 1).filter("line % 3 = 1")))


@query(_with("SELECT rule, count(*) FILTER (rec AND now) AS left_n, count(*) FILTER (old AND bef AND NOT now) AS fixed_in_change_n, count(*) FILTER (rec AND NOT now) AS still_recorded_n FROM (SELECT rule, exception, bool_or(s = 0) AS rec, bool_or(s = 1) AS old, bool_or(s = 2) AS bef, bool_or(s = 3) AS now FROM (SELECT rule_id AS rule, file AS exception, 0 AS s FROM base WHERE line % 3 = 0 UNION ALL SELECT rule_id, file, 1 FROM base WHERE line % 2 = 0 UNION ALL SELECT rule_id, file, 2 FROM base UNION ALL SELECT rule_id, file, 3 FROM head WHERE line % 3 = 1) GROUP BY 1, 2) GROUP BY 1"))
def exception_burndown(spark: SparkSession, d: str) -> DataFrame:
    as_exceptions = lambda df: df.select(F.col("rule_id").alias("rule"), F.col("file").alias("exception"))
    base, head = bridge.snapshot(spark, d, 0), bridge.snapshot(spark, d, 1)
    return change.burn_down(as_exceptions(base.filter("line % 3 = 0")), as_exceptions(base.filter("line % 2 = 0")), as_exceptions(base), as_exceptions(head.filter("line % 3 = 1")))


def _rule_rows(spark: SparkSession, d: str) -> DataFrame:
    files, edges = bridge.files(spark, d), bridge.edges(spark, d)
    tests = edges.join(files.filter("role = 'TEST'").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("violates", F.lit(True))
    rows = files.filter("role <> 'TEST'").join(tests, "id", "left")
    return rows.select(F.concat(F.lit("no-test-import-"), F.col("layer")).alias("rule"), F.col("path").alias("file"), F.coalesce("violates", F.lit(False)).alias("violates"), "id")


_RULE_ROWS = ", rr AS (SELECT 'no-test-import-' || layer AS rule, path AS file, id, id IN (SELECT src FROM edges JOIN files t ON t.id = dst AND t.role = 'TEST') AS violates FROM files WHERE role <> 'TEST')\n"


@query(_with(f"SELECT rule, count(*) FILTER (NOT gone) AS population, count(*) FILTER (violates AND NOT gone) AS violators, {gate_sql('count(*) FILTER (NOT gone)', 'count(*) FILTER (violates AND NOT gone)', '1.0')} FROM (SELECT *, violates AND id % 50 <> 1 AS gone FROM rr) GROUP BY 1", _RULE_ROWS))
def regate_allowed(spark: SparkSession, d: str) -> DataFrame:
    rows = _rule_rows(spark, d)
    return rules.regate(rows.select("rule", "file", "violates"), rows.filter("id % 50 <> 1").select("rule", "file"))


@query(f"WITH lb AS ({_LAYERS}) SELECT 'layer' AS family, 'no-' || from_layer || '-to-' || to_layer AS id, status, CASE WHEN status = 'SUGGEST' AND from_layer = 'small' THEN status END AS promoted_from FROM lb WHERE status <> 'x'")
def promoted_rules(spark: SparkSession, d: str) -> DataFrame:
    bounds = layer_boundaries(spark, d)
    named = bounds.select(F.lit("layer").alias("family"), paths.boundary_name(F.col("from_layer"), F.col("to_layer")).alias("id"), "status", "from_layer")
    marked = rules.promoted(named, [])
    return marked.select("family", "id", "status", F.when((F.col("status") == "SUGGEST") & (F.col("from_layer") == "small"), F.col("status")).alias("promoted_from"))


_VIOL = ", rr2 AS (SELECT 'no-' || a.layer || '-to-' || b.layer AS id, a.path AS exception FROM edges JOIN files a ON a.id = src JOIN files b ON b.id = dst WHERE a.layer <> b.layer)\n"


@query(
    f"WITH lb AS ({_LAYERS}), ex AS ({_with('SELECT DISTINCT id, exception FROM rr2', _VIOL)}), named AS (SELECT *, 'no-' || from_layer || '-to-' || to_layer AS id FROM lb WHERE status <> 'REJECT') "
    "SELECT 'layer' AS family, n.id, status, 'review' AS adoption, floor, observed, population, violators, coalesce((SELECT string_agg(exception, ',' ORDER BY exception) FROM (SELECT exception FROM ex WHERE ex.id = n.id ORDER BY exception LIMIT 10)), '') AS exceptions FROM named n"
)
def rule_summary(spark: SparkSession, d: str) -> DataFrame:
    files, edges = bridge.files(spark, d), bridge.edges(spark, d)
    bounds = detectors.layer_boundaries(files, edges)
    named = bounds.withColumns({"family": F.lit("layer"), "id": paths.boundary_name(F.col("from_layer"), F.col("to_layer"))})
    a = files.select(F.col("id").alias("src"), F.col("layer").alias("a"), F.col("path").alias("exception"))
    crossing = edges.join(a, "src").join(files.select(F.col("id").alias("dst"), F.col("layer").alias("b")), "dst").filter("a <> b")
    listed = crossing.select(paths.boundary_name(F.col("a"), F.col("b")).alias("id"), "exception").distinct()
    return rules.summary(named, listed).withColumn("exceptions", F.array_join("exceptions", ","))


FAMILIES = (("Layer boundaries", "layer"), ("Test isolation", "test-isolation"), ("Public API", "public-api"), ("Import style", "import-style"), ("Orphans", "orphans"), ("Console isolation", "console-isolation"), ("Cycles", "cycles"))


@query(
    f"""WITH st AS (SELECT CASE WHEN bool_or(status = 'AUTO') THEN 'AUTO' WHEN bool_or(status = 'SUGGEST') THEN 'SUGGEST' ELSE 'NONE' END AS s FROM ({_LAYERS})),
fam AS (SELECT * FROM (VALUES ('Layer boundaries', 'layer', 0), ('Test isolation', 'test-isolation', 1), ('Public API', 'public-api', 2), ('Import style', 'import-style', 3), ('Orphans', 'orphans', 4), ('Console isolation', 'console-isolation', 5), ('Cycles', 'cycles', 6)) t(title, key, i)),
stat AS (SELECT title, key, i, CASE WHEN key = 'layer' THEN (SELECT s FROM st) WHEN i % 3 = 1 THEN 'AUTO' WHEN i % 3 = 2 THEN 'SUGGEST' ELSE 'NONE' END AS status,
  CASE WHEN i = 6 THEN NULL ELSE greatest((i * 6)::DOUBLE, CASE WHEN i % 2 = 1 THEN (i * 6 + 5)::DOUBLE ELSE (i * 6)::DOUBLE END) END AS rate FROM fam),
tiered AS (SELECT title, rate, CASE WHEN status = 'AUTO' AND key = 'orphans' THEN 'review' WHEN status = 'AUTO' AND key IN ('cycles', 'test-isolation', 'console-isolation', 'import-style', 'public-api') THEN 'enforce'
  WHEN status IN ('AUTO', 'SUGGEST') THEN 'review' WHEN rate IS NULL OR rate >= 15 THEN 'adopt' END AS tier FROM stat) SELECT title, tier, rate FROM tiered WHERE tier IS NOT NULL"""
)
def recommendation_tiers(spark: SparkSession, d: str) -> DataFrame:
    status = rules.family_status(layer_boundaries(spark, d).withColumn("family", F.lit("layer"))).select(F.col("family").alias("key"), "status")
    values = [(t, k, i) for i, (t, k) in enumerate(FAMILIES)]
    fam = spark.createDataFrame(values, "title string, key string, i int")
    given = F.when(F.col("i") % 3 == 1, "AUTO").when(F.col("i") % 3 == 2, "SUGGEST").otherwise("NONE")
    families = fam.join(status, "key", "left").select("title", "key", F.when(F.col("key") == "layer", F.coalesce("status", F.lit("NONE"))).otherwise(given).alias("status"))
    by_stack = F.when(F.col("i") % 2 == 1, F.create_map(F.lit("react"), (F.col("i") * 6 + 5).cast("double"))).otherwise(F.create_map().cast("map<string,double>"))
    catalog = fam.select("title", F.when(F.col("i") < 6, (F.col("i") * 6).cast("double")).alias("overall"), by_stack.alias("by_stack"))
    return rules.tiers(families, catalog, ["react", "next"])


@query(
    _with(
        "SELECT rule, problem FROM (SELECT rule, unnest([CASE WHEN status = 'AUTO' AND population = 0 THEN 'auto on an empty population' END, CASE WHEN violators <> listed THEN 'recorded and listed violators differ' END, CASE WHEN status = 'AUTO' AND violators > 3 THEN 'auto beyond the exceptions allowed' END]) AS problem FROM (SELECT rule, 'AUTO' AS status, count(*) AS population, count(*) FILTER (violates) AS violators, count(*) FILTER (violates AND id % 2 = 0) AS listed FROM rr GROUP BY 1)) WHERE problem IS NOT NULL",
        _RULE_ROWS,
    )
)
def self_consistency(spark: SparkSession, d: str) -> DataFrame:
    rows = _rule_rows(spark, d)
    recorded = rows.groupBy("rule").agg(F.lit("AUTO").alias("status"), F.count(F.lit(1)).alias("population"), F.count_if("violates").alias("violators"))
    return rules.self_consistency(recorded, rows.filter("violates AND id % 2 = 0").select("rule", "file"))


DECLARED = [
    {"name": "doc-no-packages-in-promo", "template": "forbid-import", "files": ["src/promo/**"], "except": ["**/*.test.ts"], "pattern": r"^pkg"},
    {"name": "doc-no-fs", "template": "forbid-import", "files": ["src/**/*.tsx"], "pattern": r"^node:"},
    {"name": "doc-no-stories-in-small", "template": "forbid-file", "files": ["src/small/**/*.stories.tsx"]},
    {"name": "doc-nothing", "template": "forbid-import", "files": ["lib/**"], "pattern": r"^x"},
]
_DECLARED = """, d AS (SELECT id, path, spec, path LIKE 'src/promo/%' AND path NOT LIKE '%.test.ts' AS s1, coalesce(spec LIKE 'pkg%', false) AS h1, path LIKE 'src/%.tsx' AS s2, coalesce(spec LIKE 'node:%', false) AS h2,
  path LIKE 'src/small/%.stories.tsx' AS s3 FROM files LEFT JOIN imports USING (id)),
dm AS (SELECT 'doc-no-packages-in-promo' AS rule, 'forbid-import' AS template, count(DISTINCT id) FILTER (s1) AS scope_n, count(DISTINCT id) FILTER (s1 AND h1) AS violators_n, count(DISTINCT id) FILTER (NOT s1 AND h1) AS elsewhere_n FROM d
  UNION ALL SELECT 'doc-no-fs', 'forbid-import', count(DISTINCT id) FILTER (s2), count(DISTINCT id) FILTER (s2 AND h2), count(DISTINCT id) FILTER (NOT s2 AND h2) FROM d
  UNION ALL SELECT 'doc-no-stories-in-small', 'forbid-file', count(DISTINCT id) FILTER (s3), count(DISTINCT id) FILTER (s3), 0 FROM d
  UNION ALL SELECT 'doc-nothing', 'forbid-import', 0, 0, 0)
"""


@query(_with("SELECT * FROM dm", _DECLARED))
def declared_measure(spark: SparkSession, d: str) -> DataFrame:
    return rules.declared_measure(bridge.files(spark, d), bridge.imports(spark, d), DECLARED)


@query(_with("SELECT rule, CASE WHEN template = 'forbid-file' THEN 'enforce-now' WHEN scope_n = 0 THEN 'no-match' WHEN violators_n > 0 THEN 'baseline' ELSE 'enforce-now' END AS verdict, CASE WHEN template = 'forbid-file' THEN scope_n = 0 ELSE violators_n = 0 AND elsewhere_n = 0 END AS vacuous FROM dm", _DECLARED))
def gap_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return rules.verdicts(declared_measure(spark, d))


@query(f"WITH lb AS ({_LAYERS}) SELECT from_layer, string_agg(DISTINCT to_layer, ',' ORDER BY to_layer) AS disallow FROM lb WHERE status = 'AUTO' GROUP BY 1")
def boundaries_config(spark: SparkSession, d: str) -> DataFrame:
    return rules.disallowed(layer_boundaries(spark, d))


@query(
    f"""WITH lb AS ({_LAYERS}) SELECT 'no-' || from_layer || '-to-' || to_layer AS name,
 '{{"name":"no-' || from_layer || '-to-' || to_layer || '","severity":"error","from":{{"path":"^src/' || from_layer || '/"}},"to":{{"path":"^src/' || to_layer || '/"}}}}' AS rule FROM lb WHERE status = 'AUTO'"""
)
def dependency_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.forbidden_rules(layer_boundaries(spark, d))


@query(
    f"""WITH lb AS ({_LAYERS}), e AS (SELECT to_layer AS a, from_layer AS b, reverse_flow AS w, false AS leak FROM lb UNION ALL SELECT from_layer, to_layer, violators, true FROM lb WHERE violators > 0),
n AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT a AS x FROM e UNION SELECT b FROM e)),
l AS (SELECT 0 AS k, i AS o1, '' AS o2, false AS o3, 0 AS o4, '  n' || i || '["' || x || '"]' AS line FROM n
 UNION ALL SELECT 1, na.i, b, leak, w, '  n' || na.i || CASE WHEN leak THEN ' -.->|' ELSE ' -->|' END || w || '| n' || nb.i FROM e JOIN n na ON na.x = a JOIN n nb ON nb.x = b)
SELECT 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY k, o1, o2, o3, o4) AS chart FROM l"""
)
def layer_chart(spark: SparkSession, d: str) -> DataFrame:
    return rules.mermaid(layer_graph_edges(spark, d))


@query(_with("SELECT '::error file=' || file || ',line=' || line || '::' || rule_id || ': new violation' AS annotation FROM head"))
def ci_annotations(spark: SparkSession, d: str) -> DataFrame:
    return rules.annotations(bridge.snapshot(spark, d, 1))


@query(_with("SELECT id, spec, 'src/ui' || substr(spec, 13) AS target FROM imports WHERE spec LIKE '@/components/%' UNION ALL SELECT id, spec, 'lib/' || substr(spec, 8) || '/index' FROM imports WHERE spec LIKE '@scope/%' AND spec NOT LIKE '@scope/%/%' UNION ALL SELECT id, spec, 'lib/' || substr(spec, 8) || '/index' FROM imports WHERE spec LIKE '@scope/%/%'"))
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame([("@", "src", 0), ("@/components", "src/ui", 1), ("@scope", "lib/*/index", 2), ("@scope", "never", 3)], "prefix string, dir string, ord int")
    return resolve.aliased(bridge.imports(spark, d), aliases)


@query(_with("SELECT id, spec, CASE WHEN spec LIKE '../../../%' THEN 'shared/' || substr(spec, 17) ELSE 'src/' || layer || '/shared/' || substr(spec, 11) END AS target FROM imports JOIN files USING (id) WHERE spec LIKE '.%'"))
def relative_resolution(spark: SparkSession, d: str) -> DataFrame:
    return resolve.relative(bridge.imports(spark, d), bridge.files(spark, d))


@query(_with("SELECT f.id, CASE WHEN f.slice = 'brand-3' THEN 'src/' || f.layer || '/brand-3' WHEN f.layer IN ('promo', 'small') THEN 'src/' || f.layer ELSE 'src' END AS dir FROM files f"))
def owning_config(spark: SparkSession, d: str) -> DataFrame:
    files = bridge.files(spark, d)
    dirs = files.filter("slice = 'brand-3'").select(paths.directory(F.col("path")).alias("dir")).unionByName(spark.createDataFrame([("src",), ("src/promo",), ("src/small",)], "dir string"))
    return resolve.owners(files, dirs)


@query(_with("SELECT DISTINCT package FROM packages", ", " + _PACKAGE.rstrip(",\n") + "\n"))
def imported_packages(spark: SparkSession, d: str) -> DataFrame:
    return bridge.imports(spark, d).select(paths.package_name(F.col("spec"), ALIASES).alias("package")).filter("package IS NOT NULL").distinct()


@query("SELECT page_id, count(*) AS links, count(DISTINCT link) AS targets, count(*) FILTER (link LIKE '/%') AS rooted FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY 1")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    links = bridge.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(?i)href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("link").alias("targets"), F.count_if(F.col("link").startswith("/")).alias("rooted"))


@query("SELECT conv_id, turn, line, text FROM (SELECT conv_id, turn, i AS line, unnest(string_split(regexp_replace(trim(lines[i]), '([.!?]) +', '\\1' || chr(1), 'g'), chr(1))) AS text FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS lines FROM conversations), unnest(range(1, len(lines) + 1)) t(i)) WHERE text <> ''")
def context_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = bridge.table(spark, d, "conversations").select("conv_id", "turn", F.explode(prose.sentences(F.col("text"))).alias("s"))
    return rows.select("conv_id", "turn", "s.line", "s.text")


@query(
    "SELECT conv_id, count(*) AS sentences, count(*) FILTER (regexp_matches(text, '(?i)\\b(must|should|shall|never|always|do not|don''t|avoid|required?|prefer|instead of|make sure|ensure|recommended|mandatory)\\b') OR lower(regexp_extract(text, '(?i)^((if|when|for|before|after|while|once|unless|in)\\b[^,:]{0,80}[,:]\\s*)?(please\\s+)?([a-z-]+)', 4)) IN ("
    + ", ".join(f"'{v}'" for v in prose.VERBS)
    + ")) AS rule_like FROM ("
    + ORACLE_SQL["context_sentences"]
    + ") GROUP BY 1"
)
def rule_like_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = context_sentences(spark, d)
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(prose.reads_like_rule(F.col("text"))).alias("rule_like"))


@query(r"SELECT page_id AS id, len(t)::BIGINT AS scripts, len(t) - len(regexp_extract_all(bare, '(?i)<script\\b[^>]*src=[^>]*>', 0))::BIGINT AS inline_scripts FROM (SELECT page_id, bare, regexp_extract_all(bare, '(?i)<script\\b([^>]*)>', 1) AS t FROM (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS bare FROM pages))".replace("\\\\", "\\"))
def page_scripts(spark: SparkSession, d: str) -> DataFrame:
    return references.inline_scripts(bridge.table(spark, d, "pages"), "page_id", "html")


@query(_with("SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT src, dst FROM ugraph) WHERE src <> dst"))
def reference_graph(spark: SparkSession, d: str) -> DataFrame:
    return references.reference_graph(bridge.edges(spark, d), bridge.user_graph(spark, d))


EXPORTS = [".", "lib0", "lib*/src/*", "lib*", "lib*/src/x", "li*", "lib1/"]


@query(_with("SELECT spec, CASE WHEN s = 'lib0' THEN 'lib0' WHEN s LIKE 'lib_%/src/x' THEN 'lib*/src/x' WHEN s LIKE 'lib_%' THEN 'lib*' WHEN s LIKE 'li_%' THEN 'li*' END AS key FROM (SELECT DISTINCT spec, substr(spec, 8) AS s FROM imports WHERE spec LIKE '@scope/%')"))
def export_matching(spark: SparkSession, d: str) -> DataFrame:
    own = bridge.imports(spark, d).filter("spec LIKE '@scope/%'").select("spec").distinct()
    return own.select("spec", references.matching_export(F.expr("substr(spec, 8)"), EXPORTS).alias("key"))


@query(f"""WITH lb AS ({_LAYERS}) SELECT 'no-' || from_layer || '-to-' || to_layer AS name, 'Files in ' || from_layer || ' must not import ' || to_layer || ' (' || (population - violators) || ' of ' || population || ' follow, ' || format('{{:.1f}}%', 100 * observed) || ').' AS statement FROM lb""")
def rule_statements(spark: SparkSession, d: str) -> DataFrame:
    return emit.statements(layer_boundaries(spark, d))


@query(f"""WITH lb AS ({_LAYERS}) SELECT from_layer, '{{"files":["src/' || from_layer || '/**"],"restricted":[' || string_agg(DISTINCT '"**/' || to_layer || '/**"', ',' ORDER BY '"**/' || to_layer || '/**"') || ']}}' AS config FROM lb WHERE status = 'AUTO' GROUP BY 1""")
def linter_config(spark: SparkSession, d: str) -> DataFrame:
    return emit.restricted_imports(layer_boundaries(spark, d))


@query(f"""WITH lb AS ({_LAYERS}), e AS (SELECT to_layer AS a, from_layer AS b, reverse_flow AS w, false AS leak FROM lb UNION ALL SELECT from_layer, to_layer, violators, true FROM lb WHERE violators > 0)
SELECT 'digraph layers {{' || chr(10) || string_agg(l, chr(10) ORDER BY l) || chr(10) || '}}' AS graph FROM (SELECT '  "' || a || '" -> "' || b || '" [label="' || w || CASE WHEN leak THEN '", style=dashed]' ELSE '"]' END AS l FROM e)""")
def layer_dot(spark: SparkSession, d: str) -> DataFrame:
    return emit.dot(layer_graph_edges(spark, d))


@query(f"WITH lb AS ({_LAYERS}), r AS (SELECT 'no-' || from_layer || '-to-' || to_layer AS id FROM lb) SELECT 'Tool/  ' || upper(id) AS ref, id FROM r UNION ALL SELECT 'absent', NULL")
def rule_lookup(spark: SparkSession, d: str) -> DataFrame:
    named = emit.rule_names(layer_boundaries(spark, d)).select(F.col("name").alias("id"), F.lit(None).cast("string").alias("label"))
    refs = named.select(F.concat(F.lit("Tool/  "), F.upper("id")).alias("ref")).unionByName(spark.createDataFrame([("absent",)], "ref string"))
    return emit.found_rules(refs.withColumn("ref", F.col("ref")), named)


#: Families of the rule relation, the registered query that measures each, and the rule ids in SQL.
GATED = {
    "forbidden-imports": ("forbidden_imports", "rule_id", "population", "violators"),
    "layer": ("layer_boundaries", "'no-' || from_layer || '-to-' || to_layer", "population", "violators"),
    "role-layering": ("role_layering", "'no-' || lower(from_role) || '-to-' || lower(to_role)", "population", "violators"),
    "public-api": ("public_api_boundaries", "'no-deep-import-' || replace(dir, '/', '-')", "consumers", "deep_importers"),
    "feature-slice": ("feature_slice_isolation", "'no-cross-slice-' || replace(container, '/', '-')", "files", "cross_importers"),
    "app-isolation": ("app_isolation", "'no-cross-app-' || container", "files", "cross_importers"),
    "test-isolation": ("test_isolation", "'test-isolation'", "population", "violators"),
    "dependency-hygiene": ("package_hygiene", "'no-dependency-internals'", "population", "violators"),
    "phantom-deps": ("phantom_dependencies", "'no-phantom-dependencies'", "population", "violators"),
    "entry-purity": ("entry_purity", "'no-import-framework-entry'", "population", "violators"),
    "import-style": ("import_style", "'import-style'", "population", "violators"),
    "console-isolation": ("console_isolation", "'console-isolation'", "population", "violators"),
    "env-access": ("env_access", "'env-access'", "population", "violators"),
    "workspace-package-api": ("workspace_package_api", "'workspace-package'", "population", "violators"),
    "stories-isolation": ("stories_isolation", "'no-import-stories'", "population", "violators"),
    "ui-data": ("ui_data_isolation", "'no-ui-to-data'", "population", "violators"),
    "server-client": ("server_client", "'no-server-only-in-client'", "population", "violators"),
}
_CYCLES = _CLOSURE + f"SELECT {{columns}} FROM (SELECT count(*) AS n, count(*) FILTER (id IN (SELECT node FROM cyc)) AS v FROM files)"
_GATED = " UNION ALL ".join(
    [f"SELECT '{family}' AS family, {rule} AS id, {n}::BIGINT AS population, {v}::BIGINT AS violators, floor, observed, status FROM ({ORACLE_SQL[name].replace('{{', '{').replace('}}', '}')})" for family, (name, rule, n, v) in GATED.items()]
    + ["SELECT * FROM (" + _CYCLES.format(columns="'cycles' AS family, 'no-cycles' AS id, n AS population, v AS violators, " + gate_sql("n", "v", "1.0")) + ")"]
)


@query(_GATED)
def scan_gates(spark: SparkSession, d: str) -> DataFrame:
    with bridge.shared(spark, d, graph.stored):  # edges are a join of the largest table with itself, which a dozen families start from
        found = {family: QUERIES[name](spark, d) for family, (name, *_) in GATED.items()}
        return findings.gates(found | {"cycles": findings.cycles_gate(bridge.files(spark, d), graph.cyclic_nodes(_user_app(spark, d)))})


@query(f"SELECT *, CASE WHEN status = 'AUTO' AND family IN ({', '.join(repr(f) for f in rules.STABLE)}) THEN 'enforce' ELSE 'review' END AS adoption FROM ({_GATED}) WHERE status <> 'REJECT'")
def scan_adoption(spark: SparkSession, d: str) -> DataFrame:
    return findings.adoption(scan_gates(spark, d))


def _broken(spark: SparkSession, d: str) -> DataFrame:
    files, edges, imports = bridge.files(spark, d), bridge.edges(spark, d), bridge.imports(spark, d)
    entries = files.filter("role = 'CONTROLLER'")
    importers = edges.join(entries.select(F.col("id").alias("dst")), "dst", "left_semi").join(entries.select(F.col("id").alias("src")), "src", "left_anti")
    tests = edges.join(files.filter("role = 'TEST'").select(F.col("id").alias("dst")), "dst", "left_semi").join(files.filter("role <> 'TEST'").select(F.col("id").alias("src")), "src", "left_semi")
    parts = [
        findings.boundary_findings("layer", detectors.layer_boundaries(files, edges), edges, files, "layer"),
        findings.target_findings("entry-purity", importers, files),
        findings.target_findings("test-isolation", tests, files),
        findings.import_findings("dependency-hygiene", findings.packages_broken(imports, ALIASES), files),
        findings.import_findings("forbidden-imports", detectors.forbidden_occurrences(files, imports, MARKERS), files, F.col("rule_id")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


_BROKEN = (
    f"SELECT 'layer' AS family, 'no-' || a.layer || '-to-' || b.layer AS rule_id, a.path AS file, b.path AS subject, 'target' AS kind, NULL::INTEGER AS line FROM edges JOIN files a ON a.id = src JOIN files b ON b.id = dst JOIN ({_LAYERS}) lb ON lb.from_layer = a.layer AND lb.to_layer = b.layer"
    " UNION ALL SELECT 'entry-purity', 'no-import-framework-entry', a.path, b.path, 'target', NULL FROM edges JOIN files a ON a.id = src JOIN files b ON b.id = dst WHERE b.role = 'CONTROLLER' AND a.role <> 'CONTROLLER'"
    " UNION ALL SELECT 'test-isolation', 'test-isolation', a.path, b.path, 'target', NULL FROM edges JOIN files a ON a.id = src JOIN files b ON b.id = dst WHERE b.role = 'TEST' AND a.role <> 'TEST'"
    " UNION ALL SELECT 'dependency-hygiene', 'no-dependency-internals', path, spec, 'specifier', NULL FROM packages JOIN files USING (id) WHERE split_part(substr(spec, length(package) + 2), '/', 1) IN ('src', 'internal', 'internals')"
    + "".join(f" UNION ALL SELECT 'forbidden-imports', '{rule}', path, spec, 'specifier', NULL FROM imports JOIN files USING (id) WHERE role = 'CONTROLLER' AND regexp_matches(spec, '{pattern}')" for rule, pattern in MARKERS.items())
)
_PACKAGES = ", " + _PACKAGE.rstrip(",\n") + "\n"


@query(_with(_BROKEN, _PACKAGES))
def rule_findings(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d)


@query(_with(f"SELECT DISTINCT rule_id, CASE WHEN family = 'entry-purity' THEN file || ' -> ' || subject ELSE file END AS exception FROM ({_BROKEN})", _PACKAGES))
def rule_exceptions(spark: SparkSession, d: str) -> DataFrame:
    return findings.current_exceptions(_broken(spark, d))


@query(_with(f"SELECT * FROM ({_BROKEN}) WHERE rule_id IN ('test-isolation', 'AP-002')", _PACKAGES))
def adopted_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.evaluated(spark.createDataFrame([("test-isolation",), ("AP-002",), ("absent",)], "id string"), _broken(spark, d))


def _checked(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A change between the two snapshots: signup is removed, view is new, error has changed; clicks of every fifth user are allowed."""
    side = {}
    for name, dropped, without in (("base", 0, "view"), ("head", 1, "signup")):
        rows = bridge.snapshot(spark, d, dropped)
        found = rows.select("rule_id", "file", F.concat(F.lit("s"), (F.col("line") % 3).cast("string")).alias("subject"), F.lit("specifier").alias("kind"), "line")
        rules_ = rows.select(F.col("rule_id").alias("id")).distinct().filter(F.col("id") != without)
        side[name] = {"findings": found, "rules": rules_.withColumn("definition", F.when(F.col("id") == "error", name).otherwise("same"))}
    allowed = bridge.table(spark, d, "customer").filter("c_custkey % 5 = 0").select(F.lit("click").alias("rule"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("file"))
    renames = spark.createDataFrame([("f5", "f7"), ("f6", "f9999")], "from string, to string")
    added = side["head"]["findings"].filter("line % 4 = 0").select("file", "line")
    return plan.check(side["base"], side["head"], allowed, allowed.filter("length(file) <= 3"), renames, added)


_CHECK = """, cmp AS (SELECT unnest(['click', 'purchase']) AS rule_id),
ren AS (SELECT * FROM (VALUES ('f5', 'f7'), ('f6', 'f9999')) t(src, dst)),
allowed AS (SELECT 'click' AS rule, 'f' || c_custkey AS file FROM customer WHERE c_custkey % 5 = 0),
was AS (SELECT rule_id, coalesce(dst, file) AS file, 's' || (line % 3) AS subject, line FROM base LEFT JOIN ren ON src = file WHERE rule_id IN (SELECT rule_id FROM cmp)),
cur AS (SELECT rule_id, file, 's' || (line % 3) AS subject, line FROM head WHERE rule_id IN (SELECT rule_id FROM cmp)),
open AS (SELECT * FROM cur WHERE (rule_id, file) NOT IN (SELECT (rule, file) FROM allowed)),
wn AS (SELECT rule_id, file, subject, count(*) AS n FROM was GROUP BY ALL), cn AS (SELECT rule_id, file, subject, count(*) AS n FROM cur GROUP BY ALL), opn AS (SELECT rule_id, file, subject, count(*) AS n FROM open GROUP BY ALL),
intro AS (SELECT * FROM (SELECT o.*, coalesce(w.n, 0) AS base_n, c.n AS head_n, line % 4 = 0 AS is_added, count(*) FILTER (line % 4 = 0) OVER (PARTITION BY rule_id, file, subject) AS on_added FROM open o JOIN opn c USING (rule_id, file, subject) LEFT JOIN wn w USING (rule_id, file, subject)) WHERE head_n > base_n AND (base_n = 0 OR on_added <> head_n - base_n OR is_added)),
gone AS (SELECT * FROM (SELECT w.*, b.n AS base_n, coalesce(c.n, 0) AS head_n, row_number() OVER (PARTITION BY rule_id, file, subject ORDER BY line) AS place FROM was w JOIN wn b USING (rule_id, file, subject) LEFT JOIN cn c USING (rule_id, file, subject)) WHERE base_n > head_n AND place > head_n)
"""


@query(_with("SELECT 'introduced' AS state, rule_id, file, subject, 'specifier' AS kind, line FROM intro UNION ALL SELECT 'fixed', rule_id, file, subject, 'specifier', line FROM gone", _CHECK))
def check_findings(spark: SparkSession, d: str) -> DataFrame:
    checked = _checked(spark, d)
    return checked["introduced"].withColumn("state", F.lit("introduced")).unionByName(checked["fixed"].withColumn("state", F.lit("fixed")))


@query(_with("SELECT rule_id AS id, CASE WHEN rule_id = 'view' THEN 'new' ELSE 'changed' END AS change, count(*) AS n FROM head WHERE rule_id IN ('view', 'error') GROUP BY 1"))
def check_adopted(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d)["adopted"]


@query(_with("SELECT CASE WHEN file IN (SELECT file FROM head WHERE rule_id = 'click') THEN 'in_change' ELSE 'unused' END AS state, rule, file FROM allowed WHERE file NOT IN (SELECT file FROM head WHERE rule_id = 'click') OR file NOT IN (SELECT coalesce(dst, file) FROM allowed LEFT JOIN ren ON src = file WHERE length(file) <= 3)", _CHECK))
def check_allowances(spark: SparkSession, d: str) -> DataFrame:
    checked = _checked(spark, d)
    return checked["allowed_in_change"].withColumn("state", F.lit("in_change")).unionByName(checked["unused"].withColumn("state", F.lit("unused")))


@query(_with("SELECT rule_id, coalesce(dst, file) AS file, CASE WHEN kind = 'target' THEN coalesce(sdst, subject) ELSE subject END AS subject, kind, line FROM (SELECT rule_id, file, 'f' || (line % 9) AS subject, CASE WHEN line % 2 = 0 THEN 'target' ELSE 'specifier' END AS kind, line FROM head) LEFT JOIN ren ON src = file LEFT JOIN (SELECT src AS ssrc, dst AS sdst FROM ren) ON ssrc = subject", _CHECK))
def renamed_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = bridge.snapshot(spark, d, 1)
    found = rows.select("rule_id", "file", F.concat(F.lit("f"), (F.col("line") % 9).cast("string")).alias("subject"), F.when(F.col("line") % 2 == 0, "target").otherwise("specifier").alias("kind"), "line")
    return change.renamed(found, spark.createDataFrame([("f5", "f7"), ("f6", "f9999")], "from string, to string"))


@query(_with("SELECT rule_id, file, 's' || (line % 7) AS subject, CASE WHEN count(DISTINCT line) = 1 THEN min(line) END AS at FROM head GROUP BY 1, 2, 3"))
def located_findings(spark: SparkSession, d: str) -> DataFrame:
    lines = bridge.snapshot(spark, d, 1).withColumn("subject", F.concat(F.lit("s"), (F.col("line") % 7).cast("string")))
    return change.located(lines.select("rule_id", "file", "subject").distinct(), lines).select("rule_id", "file", "subject", "at")


@query(_with("SELECT rule, exception FROM (SELECT rule_id AS rule, file AS exception, max((s = 0)::INT) AS rec, max((s = 1)::INT) AS cur FROM (SELECT rule_id, file, 0 AS s FROM base WHERE line % 3 = 0 UNION ALL SELECT rule_id, file, 1 FROM head WHERE line % 3 = 1) WHERE rule_id IN ('view', 'click') GROUP BY 1, 2) WHERE cur = 1 AND rule IN (SELECT rule FROM (SELECT rule_id AS rule, file, max((s = 0)::INT) AS rec, max((s = 1)::INT) AS cur FROM (SELECT rule_id, file, 0 AS s FROM base WHERE line % 3 = 0 UNION ALL SELECT rule_id, file, 1 FROM head WHERE line % 3 = 1) GROUP BY 1, 2) WHERE rec <> cur)"))
def remeasured_exceptions(spark: SparkSession, d: str) -> DataFrame:
    of = lambda side, rest: bridge.snapshot(spark, d, side).filter(f"line % 3 = {rest}").select(F.col("rule_id").alias("rule"), F.col("file").alias("exception"))
    adopted = spark.createDataFrame([("view", "forbidden-imports", "fast"), ("click", "forbidden-imports", "fast"), ("error", "forbidden-imports", "deep"), ("signup", "layer", "fast")], "rule string, family string, mode string")
    return change.remeasured(adopted, of(0, 0), of(1, 1), "deep")


@query(_with("SELECT DISTINCT rule_id AS rule, file AS exception FROM head WHERE rule_id = 'error'"))
def first_exceptions(spark: SparkSession, d: str) -> DataFrame:
    current = bridge.snapshot(spark, d, 1).select(F.col("rule_id").alias("rule"), F.col("file").alias("exception")).distinct()
    return change.first_recorded(spark.createDataFrame([("error", False), ("view", True)], "rule string, recorded boolean"), current)


@query(
    f"""SELECT title, CASE WHEN tier = 'enforce' AND key NOT IN ('cycles', 'orphans', 'layer') THEN 'report-only' WHEN tier IN ('enforce', 'review') AND key IN ('cycles', 'orphans', 'layer') THEN 'enforce' ELSE tier END AS tier, rate
FROM ({ORACLE_SQL["recommendation_tiers"]}) JOIN (VALUES {", ".join(f"('{t}', '{k}')" for t, k in FAMILIES)}) f(title, key) USING (title)"""
)
def reconciled_tiers(spark: SparkSession, d: str) -> DataFrame:
    adopted = spark.createDataFrame([("cycles",), ("orphans",), ("layer",), ("declared",)], "family string")
    return rules.reconciled(recommendation_tiers(spark, d), spark.createDataFrame(list(FAMILIES), "title string, key string"), adopted)


STATED = [
    {"name": "no-console", "template": "forbid-usage", "files": ["src/**/*.ts"], "except": ["**/*.test.ts"], "usage": ["console"]},
    {"name": "no-clock", "template": "forbid-usage", "files": ["src/**"], "usage": ["Date.now"]},
    {"name": "no-names", "template": "forbid-import", "files": ["src/**"], "packages": [("@scope/lib*", ["a1"])]},
    {"name": "no-lib", "template": "forbid-import", "files": ["src/promo/**"], "packages": [("pkg*", None)], "targets": ["lib/**", "src/promo/**"]},
]
_STATED = """, imp AS (SELECT id, spec, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN ['*'] ELSE ['a' || (id % 5), 'b'] END AS names FROM imports),
use AS (SELECT DISTINCT l_partkey AS id, CASE WHEN l_linenumber = 7 THEN 'console' ELSE 'process.env' END AS subject, l_orderkey AS line FROM lineitem WHERE l_linenumber IN (3, 7) AND l_quantity < 2),
sm AS (SELECT 'no-console' AS rule, 'forbid-usage' AS template, (SELECT count(*) FROM files WHERE path LIKE 'src/%.ts' AND path NOT LIKE '%.test.ts') AS scope_n, count(DISTINCT id) FILTER (path LIKE '%.ts' AND path NOT LIKE '%.test.ts') AS violators_n, count(DISTINCT id) FILTER (NOT (path LIKE '%.ts' AND path NOT LIKE '%.test.ts')) AS elsewhere_n FROM use JOIN files USING (id) WHERE subject = 'console'
 UNION ALL SELECT 'no-clock', 'forbid-usage', (SELECT count(*) FROM files), 0, 0
 UNION ALL SELECT 'no-names', 'forbid-import', (SELECT count(*) FROM files), count(DISTINCT id), 0 FROM imp JOIN files USING (id) WHERE regexp_matches(spec, '^@scope/lib[^/]*$') AND id % 5 = 1
 UNION ALL SELECT 'no-lib', 'forbid-import', (SELECT count(*) FROM files WHERE path LIKE 'src/promo/%'), count(DISTINCT id) FILTER (path LIKE 'src/promo/%'), count(DISTINCT id) FILTER (path NOT LIKE 'src/promo/%') FROM imp JOIN files USING (id) WHERE regexp_matches(spec, '^pkg[^/]*$'))
"""


def _stated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    names = F.when(F.col("id") % 5 == 1, F.array(F.lit("*"))).when(F.col("id") % 5 != 0, F.array(F.concat(F.lit("a"), (F.col("id") % 5).cast("string")), F.lit("b")))
    line = bridge.table(spark, d, "lineitem").filter("l_linenumber IN (3, 7) AND l_quantity < 2")
    usage = line.select(F.col("l_partkey").alias("id"), F.when(F.col("l_linenumber") == 7, "console").otherwise("process.env").alias("subject"), F.col("l_orderkey").alias("line")).distinct()
    return bridge.files(spark, d), bridge.imports(spark, d).withColumn("names", names), usage


@query(_with("SELECT * FROM sm", _STATED))
def stated_measure(spark: SparkSession, d: str) -> DataFrame:
    files, imports, usage = _stated(spark, d)
    return rules.declared_measure(files, imports, STATED, usage)


@query(_with("SELECT rule, CASE WHEN scope_n = 0 OR rule IN ('no-lib', 'no-clock') THEN 'no-match' WHEN violators_n > 0 THEN 'baseline' ELSE 'enforce-now' END AS verdict, violators_n = 0 AND elsewhere_n = 0 AND rule <> 'no-clock' AS vacuous FROM sm", _STATED))
def stated_verdicts(spark: SparkSession, d: str) -> DataFrame:
    files, imports, usage = _stated(spark, d)
    other = files.filter("id % 10 = 0").select("id", F.lit("Date.now").alias("subject"))
    return rules.verdicts(rules.declared_measure(files, imports, STATED, usage), rules.unmatched_targets(files, STATED), rules.not_global(other, usage, STATED))


@query(
    _with(
        "SELECT entry, rule, CASE WHEN entry % 6 = 0 THEN 'invalid' WHEN entry % 6 = 1 THEN 'quote-not-found' WHEN entry % 6 = 2 THEN 'guidance' WHEN entry % 6 = 3 AND entry % 4 = 3 THEN 'stated' WHEN entry % 6 = 3 THEN 'inferred' WHEN verdict = 'no-match' THEN 'no-match' ELSE 'adopted' END AS outcome "
        "FROM (SELECT i AS entry, CASE i % 4 WHEN 0 THEN 'no-console' WHEN 1 THEN 'no-lib' WHEN 2 THEN 'no-clock' ELSE 'no-names' END AS rule FROM range(48) t(i)) JOIN (SELECT rule, CASE WHEN scope_n = 0 OR rule IN ('no-lib', 'no-clock') THEN 'no-match' ELSE 'x' END AS verdict FROM sm) USING (rule)",
        _STATED,
    )
)
def declared_outcomes(spark: SparkSession, d: str) -> DataFrame:
    rule = F.element_at(F.array(*[F.lit(r) for r in ("no-console", "no-lib", "no-clock", "no-names")]), (F.col("id") % 4 + 1).cast("int"))
    kind = F.col("id") % 6
    mapped = spark.range(48).select(
        F.col("id").alias("entry"), F.when(kind == 2, "none").when(kind == 3, "inferred").otherwise("forbid-import").alias("template"), rule.alias("rule"), F.when(kind != 1, F.lit(1)).alias("line"), F.when(kind == 0, "no template").alias("invalid")
    )
    return rules.declared_adoption(rules.gap_report(mapped, stated_verdicts(spark, d)), spark.createDataFrame([("no-names",)], "id string"), baseline=True)


@query(_with("SELECT family, id, status, CASE WHEN family = 'layer' THEN 'linter' WHEN family = 'import-style' THEN 'checker' END AS enforcer FROM (" + _GATED + ") WHERE status = 'AUTO' AND (family = 'layer' OR id IN ('import-style', 'test-isolation')) AND id <> 'test-isolation'"))
def selected_rules(spark: SparkSession, d: str) -> DataFrame:
    found = scan_gates(spark, d).select("family", "id", "status")
    return rules.selected(found, only=["import-style", "test-isolation"], removed=["test-isolation"], structural=["layer"], enforcers={"layer": "linter", "import-style": "checker"})


@query("WITH RECURSIVE hop AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 4 FROM part WHERE p_partkey % 17 = 0 AND p_partkey >= 4), bar AS (SELECT DISTINCT p_partkey // 2 AS id FROM part WHERE p_partkey > 1), r AS (SELECT src AS barrel, dst AS leaf FROM hop JOIN bar ON id = src UNION SELECT r.barrel, hop.dst FROM r JOIN hop ON hop.src = r.leaf) SELECT barrel, leaf FROM r WHERE leaf NOT IN (SELECT id FROM bar)")
def barrel_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Parts re-export the two parts of twice their number, and some one further up, so that there are circles."""
    key = F.col("p_partkey")
    part = bridge.table(spark, d, "part").select("p_partkey")
    down = part.filter(key > 1).select(F.floor(key / 2).cast("long").alias("src"), key.alias("dst"))
    back = part.filter((key % 17 == 0) & (key >= 4)).select(key.alias("src"), F.floor(key / 4).cast("long").alias("dst"))
    return graph.leaf_files(down.unionByName(back), down.select(F.col("src").alias("id")).distinct())


@query(_with("SELECT 'src/' || layer AS dir, count(*) AS n FROM files GROUP BY 1 HAVING count(*) >= 25 OR (SELECT max(n) FROM (SELECT count(*) AS n FROM files GROUP BY layer)) < 25"))
def app_folders(spark: SparkSession, d: str) -> DataFrame:
    files = bridge.files(spark, d)
    return resolve.discovered_apps(files, files.select(F.concat(F.lit("src/"), "layer").alias("dir")).distinct())


@query(_with("SELECT 'stories' AS loader, path FROM files WHERE path LIKE '%.stories.tsx' UNION ALL SELECT 'one', path FROM files WHERE regexp_matches(path, '^src/promo/[^/]+/p1[^/]*\\.ts$')").replace("\\\\", "\\"))
def loaded_files(spark: SparkSession, d: str) -> DataFrame:
    files = bridge.files(spark, d)
    return resolve.matched_loaders(files, [("stories", "src/**/*.stories.tsx")]).unionByName(references.computed_targets(files, [("one", ["src/promo/", None, "/p1", None, ".ts"])]))


@query(_with("SELECT 'pkg' || (id % 3) AS package, path FROM files WHERE path LIKE '%.ts' AND path NOT LIKE '%.%.ts'"))
def published_entries(spark: SparkSession, d: str) -> DataFrame:
    files = bridge.files(spark, d)
    plain = files.filter("path LIKE '%.ts' AND path NOT LIKE '%.%.ts'")
    built = plain.select(F.concat(F.lit("pkg"), (F.col("id") % 3).cast("string")).alias("package"), F.concat(F.lit("./dist/"), F.regexp_replace(F.expr("substring(path, 5)"), r"\.ts$", ".d.ts")).alias("target"))
    return references.package_entries(files, references.entry_candidates(built, "dist", "src"))


@query(_with("SELECT path, (path LIKE 'src/promo/%' AND path NOT LIKE '%.test.ts') OR (path LIKE 'src/%/brand-11/%' AND path NOT LIKE 'src/promo/%' AND path NOT LIKE '%.tsx') AS shipped FROM files"))
def shipped_files(spark: SparkSession, d: str) -> DataFrame:
    """What a package's list names, with what later entries take away again; the last that matches decides."""
    listed = ["*", "!SRC/promo", "!SRC/promo/**", "!src/*/brand-11/**", "src/**/*.test.ts", "src/**/*.tsx", "!src/promo/**/*.tsx", "!src/*/brand-11/*.test.ts", "src/promo/**/*.test.ts"]
    files = bridge.files(spark, d).select(F.lit("app").alias("app"), "id", "path")
    lines = files.limit(1).select("app", F.lit("").alias("dir"), F.posexplode(F.array(*[F.lit(x) for x in listed])).alias("line", "text"))
    out = pathrules.left_out(files, lines, partial=True, nocase=True).select("id", F.lit(False).alias("shipped"))
    return files.join(out, "id", "left").select("path", F.coalesce("shipped", F.lit(True)).alias("shipped"))


@query(_with("SELECT path FROM files WHERE id % 11 = 0 OR (id % 7 = 0 AND id IN (SELECT id FROM imports WHERE spec LIKE 'pkg%'))"))
def client_files(spark: SparkSession, d: str) -> DataFrame:
    code = bridge.files(spark, d).select("id", "path", F.when(F.col("id") % 11 == 0, "const c = new PrismaClient()").when(F.col("id") % 7 == 0, "const p = new Pool<X>(url)").otherwise("// nothing").alias("text"))
    imports = bridge.imports(spark, d).select("id", F.when(F.col("spec").startswith("pkg"), "pg").otherwise("left-pad").alias("spec"))
    return references.data_clients(code, imports)


@query(_with("SELECT id, '#own' AS spec, 'src/' || layer AS dir FROM files"))
def scoped_specifiers(spark: SparkSession, d: str) -> DataFrame:
    files = bridge.files(spark, d)
    own = files.select("id", F.lit("#own").alias("spec"))
    return references.scoped_imports(own.unionByName(own.withColumn("spec", F.lit("plain"))), files, files.select(F.concat(F.lit("src/"), "layer").alias("dir")).distinct())


@query(_with("SELECT t.id, 'x' AS spec, min_by(f.id, CASE WHEN f.path LIKE '%.controller.ts' THEN 0 ELSE 1 END) AS dst FROM files t JOIN files f ON f.path = regexp_replace(t.path, '\\.[a-z.]+$', '') || '.ios.tsx' OR f.path = regexp_replace(t.path, '\\.[a-z.]+$', '') || '.tsx' OR f.path = regexp_replace(t.path, '\\.[a-z.]+$', '') || '.ts' GROUP BY 1").replace("\\\\", "\\"))
def platform_targets(spark: SparkSession, d: str) -> DataFrame:
    files = bridge.files(spark, d)
    targets = files.select("id", F.lit("x").alias("spec"), F.regexp_replace("path", r"\.[a-z.]+$", "").alias("target"))
    return references.platform_file(targets, files, "ios", True)


@query("WITH s AS (" + ORACLE_SQL["context_sentences"] + "), h AS (SELECT DISTINCT conv_id AS doc, text FROM s WHERE turn % 2 = 0), b AS (SELECT DISTINCT conv_id AS doc, text FROM s WHERE turn % 2 = 1), q AS (SELECT DISTINCT substr(text, 3, 14) AS statement FROM s WHERE turn % 2 = 1 AND length(text) >= 20) SELECT doc, text FROM h WHERE (doc, text) NOT IN (SELECT (doc, text) FROM b) AND NOT EXISTS (SELECT 1 FROM q WHERE contains(h.text, q.statement) OR contains(q.statement, h.text))")
def unchecked_context(spark: SparkSession, d: str) -> DataFrame:
    rows = context_sentences(spark, d)
    of = lambda rest: rows.filter(f"turn % 2 = {rest}").select(F.col("conv_id").alias("doc"), "text").distinct()
    quoted = rows.filter("turn % 2 = 1 AND length(text) >= 20").select(F.substring("text", 3, 14).alias("statement"))
    return change.unchecked_sentences(of(0), of(1), quoted)


_PLAIN = "trim(regexp_replace(translate({}, '‘’“”*_`', '\'\'\'\'\"\"'), '\\s+', ' ', 'g'))".replace("\'", "'")
_EDITED = "CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN 'Notes of *today*.' || chr(10) || chr(10) || text ELSE regexp_replace(text, '^[^' || chr(10) || ']*' || chr(10) || '?', '') END"


@query(
    "WITH s AS (" + ORACLE_SQL["context_sentences"] + f"""),
r AS (SELECT DISTINCT conv_id, turn, text AS statement, line FROM s),
t AS (SELECT conv_id, turn, {_EDITED} AS body FROM conversations WHERE turn % 3 <> 2 OR conv_id % 2 <> 0),
l AS (SELECT conv_id, turn, i, length({_PLAIN.format("parts[i]")}) AS n FROM (SELECT conv_id, turn, string_split(body, chr(10)) AS parts FROM t), unnest(range(1, len(parts) + 1)) u(i)),
total AS (SELECT conv_id, turn, i, sum(n) OVER w + greatest(count(*) FILTER (n > 0) OVER w - 1, 0) AS upto FROM l WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
p AS (SELECT r.conv_id, r.turn, statement, r.line, CASE WHEN {_PLAIN.format("statement")} <> '' THEN instr({_PLAIN.format("body")}, {_PLAIN.format("statement")}) ELSE 0 END AS place FROM r LEFT JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn),
f AS (SELECT p.conv_id, p.turn, statement, p.line, p.place, count(*) FILTER (upto < place) + 1 AS found FROM p LEFT JOIN total USING (conv_id, turn) GROUP BY ALL)
SELECT conv_id, turn, statement, line AS last_line, CASE WHEN place > 0 THEN found ELSE line END AS line, coalesce(place > 0, false) AND found <> line AS moved, NOT coalesce(place > 0, false) AS stale FROM f"""
)
def relocated_rules(spark: SparkSession, d: str) -> DataFrame:
    """Each sentence as a rule's quote; its file then gets a heading, loses its first line, or goes."""
    file = F.concat_ws("/", "conv_id", "turn")
    stated = context_sentences(spark, d).select("conv_id", "turn", F.col("text").alias("statement"), "line").distinct()
    text = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("Notes of *today*.\n\n"), "text")).otherwise(F.regexp_replace("text", r"\A[^\n]*\n?", ""))
    texts = bridge.table(spark, d, "conversations").filter("turn % 3 <> 2 OR conv_id % 2 <> 0").select(file.alias("file"), text.alias("text"))
    found = change.relocated(stated.withColumn("file", file).withColumn("last_line", F.col("line")), texts)
    return found.select("conv_id", "turn", "statement", "last_line", "line", "moved", "stale")


@query(
    _with(
        """SELECT rule, exception, CASE WHEN NOT cur THEN 'fixed' WHEN rule = 'click' OR rule = 'signup' THEN 'first' WHEN rec THEN 'kept' ELSE 'grown' END AS state FROM (
  SELECT rule, exception, bool_or(s = 0) AS rec, bool_or(s = 1) AS cur FROM (
    SELECT rule_id AS rule, file AS exception, 0 AS s FROM base UNION ALL SELECT rule_id, file, 1 FROM head) GROUP BY 1, 2)
WHERE rule <> 'error'"""
    )
)
def ratcheted_exceptions(spark: SparkSession, d: str) -> DataFrame:
    """Event types as rules: one goes, one is recorded anew, one is new, the others may only shrink."""
    of = lambda dropped: bridge.snapshot(spark, d, dropped).select(F.col("rule_id").alias("rule"), F.col("file").alias("exception"))
    recorded, current = of(0), of(1)
    one = lambda name: current.filter(F.col("rule") == name).select("rule").distinct()
    prior = recorded.select("rule").distinct().filter("rule <> 'signup'")
    return change.ratcheted(prior, recorded, current.select("rule").distinct().filter("rule <> 'error'"), current, one("error"), one("click"))
