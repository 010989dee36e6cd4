"""Rule families: a population of files, the violators among it, and the gate.

Every detector returns one row a rule.  ``measure`` is the shared kernel: one
aggregation over (group, member, violates) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions import paths, roles
from veinwork.functions.stats import gate, wilson

MIN_LAYER = 5


def measure(rows: DataFrame, keys: list[str], role: Column | None = None, applicable: Column | None = None) -> DataFrame:
    """keys, population, violators and the gate, from rows (keys..., member, violates[, confidence])."""
    values = [F.count_distinct("member").alias("population"), F.count_distinct(F.when(F.col("violates"), F.col("member"))).alias("violators")]
    if "confidence" in rows.columns:
        values.append(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
        role = F.col("confidence") if role is None else role
    if "applies" in rows.columns:
        values.append(F.coalesce(F.bool_or("applies"), F.lit(False)).alias("applies"))
        applicable = F.col("applies")
    counted = rows.groupBy(*keys).agg(*values)
    columns = gate(F.col("population"), F.col("violators"), F.lit(1.0) if role is None else role, applicable)
    return counted.withColumns(columns).select(*keys, "population", "violators", *columns)


def directed_pairs(files: DataFrame, edges: DataFrame, group: str, least_files: int, mean_confidence: bool) -> DataFrame:
    """Boundaries between groups: the smaller direction of each pair violates, ties keep the lexicographic order."""
    member = files.select("id", F.col(group).alias("g"), "role_confidence").filter("g IS NOT NULL")
    size = member.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("role_confidence").alias("conf"))
    of = member.select("id", "g")
    flow = (
        edges.join(of.withColumnsRenamed({"id": "src", "g": "a"}), "src")
        .join(of.withColumnsRenamed({"id": "dst", "g": "b"}), "dst")
        .filter("a <> b")
        .groupBy("a", "b")
        .agg(F.count_distinct("src").alias("n"))
    )
    pairs = flow.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
        F.coalesce(F.sum(F.when(F.col("a") < F.col("b"), F.col("n"))), F.lit(0)).alias("xy"), F.coalesce(F.sum(F.when(F.col("a") > F.col("b"), F.col("n"))), F.lit(0)).alias("yx")
    )
    forward = F.col("xy") <= F.col("yx")
    aimed = pairs.select(
        F.when(forward, F.col("x")).otherwise(F.col("y")).alias("from_group"),
        F.when(forward, F.col("y")).otherwise(F.col("x")).alias("to_group"),
        F.least("xy", "yx").alias("violators"),
        F.greatest("xy", "yx").alias("reverse_flow"),
    )
    sized = aimed.join(size.filter(F.col("n") >= least_files).withColumnsRenamed({"g": "from_group", "n": "population"}), "from_group").join(
        size.filter(F.col("n") >= least_files).select(F.col("g").alias("to_group"), F.col("n").alias("n_to"), F.col("conf").alias("conf_to")), "to_group"
    )
    direction = wilson(F.col("reverse_flow"), F.col("violators") + F.col("reverse_flow"))
    if mean_confidence:
        direction = F.least(direction, (F.col("conf") + F.col("conf_to")) / (F.col("population") + F.col("n_to")))
    sized = sized.withColumn("exact", direction)
    columns = gate(F.col("population"), F.col("violators"), F.col("exact"))
    return sized.withColumns(columns).select("from_group", "to_group", "population", "violators", "reverse_flow", (F.floor(F.col("exact") * 10000 + 0.5) / 10000).alias("role_confidence"), *columns)


def layer_boundaries(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Imports between layers.  Layers are few, so their sizes are broadcast."""
    return directed_pairs(files, edges, "layer", MIN_LAYER, False).withColumnsRenamed({"from_group": "from_layer", "to_group": "to_layer"})


def role_layering(files: DataFrame, edges: DataFrame) -> DataFrame:
    return directed_pairs(files.filter(F.col("role").isin(*roles.LAYERED)), edges, "role", 1, True).withColumnsRenamed({"from_group": "from_role", "to_group": "to_role"})


def sibling_isolation(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members (id, container, member) that import another member of their container; at least two members."""
    src = members.select(F.col("id").alias("src"), F.col("container").alias("c"), F.col("member").alias("m"))
    dst = members.select(F.col("id").alias("dst"), F.col("container").alias("c"), F.col("member").alias("other"))
    cross = edges.join(src, "src").join(dst, ["dst", "c"]).filter("m <> other").select(F.col("src").alias("id")).distinct().withColumn("crosses", F.lit(True))
    rows = members.join(cross, "id", "left")
    counted = rows.groupBy("container").agg(
        F.count_distinct("member").alias("members"), F.count(F.lit(1)).alias("files"), F.count_if(F.col("crosses")).alias("cross_importers")
    )
    columns = gate(F.col("files"), F.col("cross_importers"), F.lit(1.0))
    return counted.filter("members >= 2").withColumns(columns).select("container", "members", "files", "cross_importers", *columns)


def members_of(files: DataFrame, containers: tuple[str, ...]) -> DataFrame:
    """(id, container, member): the first container segment with at least two more segments below it."""
    parts = paths.segments(F.col("path"))
    at = F.get(F.filter(F.sequence(F.lit(1), F.size(parts) - 2), lambda i: F.element_at(parts, i).isin(*containers)), F.lit(0))
    placed = files.select("id", parts.alias("parts"), F.when(F.size(parts) > 2, at).alias("at")).filter("at IS NOT NULL")
    return placed.select("id", F.array_join(F.slice("parts", F.lit(1), F.col("at")), "/").alias("container"), F.element_at("parts", F.col("at") + 1).alias("member"))


def _violating(population: DataFrame, offenders: DataFrame) -> DataFrame:
    """Population rows with ``violates``: whether ``offenders`` (id) has them."""
    marked = offenders.select("id").distinct().withColumn("violates", F.lit(True))
    return population.join(marked, "id", "left").withColumn("violates", F.coalesce("violates", F.lit(False))).withColumnRenamed("id", "member")


def test_isolation(files: DataFrame, edges: DataFrame) -> DataFrame:
    tests = files.filter("role = 'TEST'").select(F.col("id").alias("dst"))
    production = files.filter("role <> 'TEST'").select("id")
    rows = _violating(production, edges.join(tests, "dst", "left_semi").select(F.col("src").alias("id")))
    any_test = files.agg(F.bool_or(F.col("role") == "TEST").alias("applies"))
    return measure(rows.crossJoin(F.broadcast(any_test)), [])


def entry_purity(files: DataFrame, edges: DataFrame, entries: Column) -> DataFrame:
    """Entries that something other than an entry imports."""
    own = files.filter(entries).select("id")
    importers = edges.join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").join(own.withColumnRenamed("id", "src"), "src", "left_anti")
    rows = _violating(own, importers.select(F.col("dst").alias("id")))
    return measure(rows, [], applicable=F.col("population") > 0)


def entry_importers(files: DataFrame, edges: DataFrame, entries: Column) -> DataFrame:
    """Each imported entry with its smallest importer."""
    own = files.filter(entries).select("id", "path")
    importers = edges.join(own.select(F.col("id").alias("dst"), F.col("path").alias("entry")), "dst").join(own.select(F.col("id").alias("src")), "src", "left_anti")
    named = importers.join(files.select(F.col("id").alias("src"), F.col("path").alias("importer")), "src")
    return named.groupBy("entry").agg(F.min("importer").alias("importer"))


def reaches_role(files: DataFrame, edges: DataFrame, population: Column, targets: Column) -> DataFrame:
    """Files of a population that import a target; the population's mean confidence counts as the role's."""
    own = files.filter(population).select("id", F.col("role_confidence").alias("confidence"))
    hit = edges.join(files.filter(targets).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    any_target = files.agg(F.coalesce(F.bool_or(targets), F.lit(False)).alias("applies"))
    return measure(_violating(own, hit).crossJoin(F.broadcast(any_target)), [])


def server_client(files: DataFrame, edges: DataFrame, imports: DataFrame, client: Column, marker: str = "server-only") -> DataFrame:
    """Client files that import the marker or a module that does."""
    server = imports.filter(F.col("spec") == marker).select("id").distinct()
    hit = edges.join(server.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).unionByName(server)
    some = server.agg((F.count(F.lit(1)) > 0).alias("applies"))
    return measure(_violating(files.filter(client).select("id"), hit).crossJoin(F.broadcast(some)), [])


def outside_use(files: DataFrame, edges: DataFrame, barrels: DataFrame) -> DataFrame:
    """Edges into a directory with a barrel from outside it: src, dst, dir, barrel_id; the nearest barrel above a target counts.

    Ancestors are exploded and met by equality, so no prefix join is needed.
    """
    nearest = _nearest_barrel(files, barrels)
    path_of = files.select(F.col("id").alias("src"), F.col("path").alias("src_path"))
    use = edges.join(nearest.withColumnRenamed("id", "dst"), "dst").join(path_of, "src")
    return use.filter(~F.col("src_path").startswith(F.concat("dir", F.lit("/"))) & (F.col("src") != F.col("barrel_id")))


def _nearest_barrel(files: DataFrame, barrels: DataFrame) -> DataFrame:
    dirs = barrels.select(F.col("id").alias("barrel_id"), F.col("dir"))
    above = files.select("id", F.explode(paths.ancestors(F.col("path"))).alias("dir")).join(dirs, "dir")
    return above.groupBy("id").agg(F.max_by(F.struct("dir", "barrel_id"), F.length("dir")).alias("b")).select("id", "b.dir", "b.barrel_id")


def public_api(files: DataFrame, edges: DataFrame, barrels: DataFrame) -> DataFrame:
    """Consumers outside a directory with a barrel that reach past it."""
    inside = _nearest_barrel(files, barrels).filter("id <> barrel_id").groupBy("dir").agg(F.count(F.lit(1)).alias("internals"))
    outside = outside_use(files, edges, barrels)
    counted = outside.groupBy("dir").agg(F.count_distinct("src").alias("consumers"), F.count_distinct(F.when(F.col("dst") != F.col("barrel_id"), F.col("src"))).alias("deep_importers"))
    joined = counted.join(inside, "dir")
    columns = gate(F.col("consumers"), F.col("deep_importers"), F.lit(1.0))
    return joined.withColumns(columns).select("dir", "internals", "consumers", "deep_importers", *columns)


def import_style(imports: DataFrame) -> DataFrame:
    """Files with relative imports that climb three folders or more."""
    rows = imports.filter(F.col("spec").startswith(".")).select(F.col("id").alias("member"), F.col("spec").rlike(paths.DEEP_RELATIVE).alias("violates"))
    return measure(rows, [])


def _packages(imports: DataFrame, aliases: tuple[str, ...]) -> DataFrame:
    return imports.withColumn("package", paths.package_name(F.col("spec"), aliases)).filter("package IS NOT NULL")


def package_hygiene(imports: DataFrame, aliases: tuple[str, ...]) -> DataFrame:
    """Files that import a package's internals."""
    rows = _packages(imports, aliases).select(F.col("id").alias("member"), paths.is_internal(F.col("spec"), F.col("package")).alias("violates"))
    return measure(rows, [])


def phantom_dependencies(imports: DataFrame, declared: DataFrame, aliases: tuple[str, ...]) -> DataFrame:
    """Files that import a package that ``declared`` (package) does not have; where both have an app, within it."""
    keys = ["package", *[c for c in ("app",) if c in imports.columns and c in declared.columns]]
    used = _packages(imports, aliases).select("id", *keys)
    known = declared.select(*keys).distinct().withColumn("known", F.lit(True))
    rows = used.join(known, keys, "left").select(F.col("id").alias("member"), F.col("known").isNull().alias("violates"))
    return measure(rows, [])


def usage_isolation(files: DataFrame, usage: DataFrame, population: Column, applies_if_used: bool) -> DataFrame:
    """Files of a population with a use (id, line); optionally only where anything uses it at all."""
    rows = _violating(files.filter(population).select("id"), usage)
    if applies_if_used:
        rows = rows.crossJoin(F.broadcast(usage.agg((F.count(F.lit(1)) > 0).alias("applies"))))
    return measure(rows, [])


def workspace_imports(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """id, spec, package, violates: imports of workspace packages (name, exports, open) that are not open.

    A specifier is exploded into its prefixes and meets names by equality.  It
    violates unless it is the name or an exported subpath; a star in an export
    stands for one character at least.
    """
    scope = [c for c in ("app",) if c in imports.columns and c in packages.columns]
    sides = packages.filter("NOT open").select(*scope, "name", F.transform("exports", lambda e: F.regexp_replace(e, r"^\./", "")).alias("exports"))
    met = imports.select("id", "spec", *scope, F.explode(paths.prefixes(F.col("spec"))).alias("name")).join(sides, [*scope, "name"])
    first = met.groupBy("id", "spec").agg(F.min_by(F.struct("name", "exports"), "name").alias("p"))
    subpath = F.substring(F.col("spec"), F.length("p.name") + 2, F.length("spec"))
    starred = lambda e: e.contains("*") & subpath.startswith(F.substring_index(e, "*", 1)) & subpath.endswith(F.substring_index(e, "*", -1)) & (F.length(subpath) >= F.length(e))
    exported = F.exists("p.exports", lambda e: (e == subpath) | starred(e))
    return first.select("id", "spec", F.col("p.name").alias("package"), ((F.col("spec") != F.col("p.name")) & ~exported).alias("violates"))


def workspace_api(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Files that import a workspace package other than by its name or an exported subpath."""
    return measure(workspace_imports(imports, packages).select(F.col("id").alias("member"), "violates"), [])


def forbidden_imports(files: DataFrame, imports: DataFrame, markers: dict[str, str | None]) -> DataFrame:
    """For each rule (id -> pattern): request entry files that import a match, in one pass over the imports.

    ``imports`` are those that bind a value; where they have ``leaf``, the path
    of the file that the import ends at, that counts too, and where they have
    ``marked``, the rules (an array) that an import breaks whatever its names.
    A rule without a pattern has nothing to forbid and is rejected.
    """
    own = files.filter(F.col("role").isin(*roles.REQUEST_ENTRY)).select("id", F.col("role_confidence").alias("confidence"), F.col("path").rlike(paths.INFRA_PATH).alias("infra"))
    flags = [F.coalesce(F.bool_or(_reaches(imports, pattern, rule)), F.lit(False)).alias(rule) for rule, pattern in markers.items()]
    hits = imports.groupBy("id").agg(*flags)
    wide = own.join(hits, "id", "left")
    rows = wide.select(F.col("id").alias("member"), "confidence", "infra", F.explode(F.array(*[F.struct(F.lit(r).alias("rule_id"), F.coalesce(F.col(f"`{r}`"), F.lit(False)).alias("violates")) for r in markers])).alias("x"))
    rows = rows.select("member", "confidence", "infra", "x.*")
    caution = rows.filter("violates").groupBy("rule_id").agg(F.bool_and("infra").alias("infra_caution"))
    found = measure(rows, ["rule_id"]).join(caution, "rule_id", "left").withColumn("infra_caution", F.coalesce("infra_caution", F.lit(False)))
    empty = [r for r, pattern in markers.items() if pattern is None]
    return found.withColumn("status", F.when(F.col("rule_id").isin(*empty), "REJECT").otherwise(F.col("status"))) if empty else found


def _reaches(imports: DataFrame, pattern: str | None, rule: str) -> Column:
    if pattern is None:
        return F.lit(False)
    hit = F.col("spec").rlike(pattern)
    if "marked" in imports.columns:
        hit = hit | F.coalesce(F.array_contains("marked", rule), F.lit(False))
    return hit | F.coalesce(F.col("leaf").rlike(pattern) & ~F.col("leaf").rlike("(^|/)node_modules/"), F.lit(False)) if "leaf" in imports.columns else hit


def forbidden_occurrences(files: DataFrame, imports: DataFrame, markers: dict[str, str | None]) -> DataFrame:
    """rule_id, id, spec: every import of a request entry file that a rule forbids."""
    own = files.filter(F.col("role").isin(*roles.REQUEST_ENTRY)).select("id")
    marks = F.array(*[F.when(_reaches(imports, p, r), F.lit(r)) for r, p in markers.items()])
    found = imports.join(own, "id", "left_semi").select("id", "spec", F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("rule_id"))
    return found.distinct() if "leaf" in imports.columns else found


def first_evidence(files: DataFrame, imports: DataFrame, pattern: str) -> DataFrame:
    """The first matching import of each offending file, in file order where imports have ``ord``, else by specifier."""
    met = imports.filter(F.col("spec").rlike(pattern)).join(files.select("id", "path"), "id")
    first = F.min_by("spec", F.struct("ord", "spec")) if "ord" in imports.columns else F.min("spec")
    return met.groupBy("path").agg(first.alias("spec"))


#: Fixed value: folder names of structure, which tell nothing about what a file is.
STRUCTURAL = r"^(\(.*\)|\[.*\]|app|pages|src|dist|build)$"


def ui_markers(files: DataFrame, least: int = 3, specific: float = 0.85, population: int = 5, top: int = 8) -> DataFrame:
    """Folder names that tell components from other files, best first."""
    parts = paths.segments(F.col("path"))
    named = files.select((F.col("role") == "COMPONENT").alias("ui"), F.explode(F.array_distinct(F.slice(parts, F.lit(1), F.size(parts) - 1))).alias("segment"))
    total = files.agg(F.count_if(F.col("role") == "COMPONENT").alias("total"))
    counted = named.groupBy("segment").agg(F.count_if("ui").alias("component_files"), F.count_if(~F.col("ui")).alias("other_files"))
    scored = counted.crossJoin(F.broadcast(total)).withColumns(
        {"specificity": F.col("component_files") / (F.col("component_files") + F.col("other_files")), "coverage": F.col("component_files") / F.when(F.col("total") > 0, F.col("total"))}
    )
    kept = scored.filter((F.col("total") >= population) & (F.col("component_files") >= least) & (F.col("specificity") >= specific) & ~F.col("segment").rlike(STRUCTURAL) & ~F.col("segment").contains("."))
    return kept.select("segment", "component_files", "other_files", "specificity", "coverage").orderBy((F.col("coverage") * F.col("specificity")).desc(), "segment").limit(top)
