"""What breaks each rule, and the gates of all families, as one relation each.

A finding is (family, rule_id, file, subject, kind, line): the file that breaks
a rule, and what it reaches or uses.  ``kind`` is target for files, specifier
for imports, usage for globals, which have a row for each line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions import paths
from veinwork.operators import detectors, graph
from veinwork.operators.rules import STABLE

COLUMNS = ["family", "rule_id", "file", "subject", "kind", "line"]
#: Rule ids of the families that are one rule.
SINGLE = {
    "cycles": "no-cycles",
    "test-isolation": "test-isolation",
    "dependency-hygiene": "no-dependency-internals",
    "phantom-deps": "no-phantom-dependencies",
    "entry-purity": "no-import-framework-entry",
    "import-style": "import-style",
    "console-isolation": "console-isolation",
    "env-access": "env-access",
    "workspace-package-api": "workspace-package",
    "stories-isolation": "no-import-stories",
    "ui-data": "no-ui-to-data",
    "server-client": "no-server-only-in-client",
}
_GATE = ["population", "violators", "floor", "observed", "status"]


def _slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9]+", "-"), "^-|-$", "")


def rule_of(family: str, row: dict[str, Column]) -> Column:
    """The id of a rule of a family that has one rule for each group, from its columns."""
    if family == "layer":
        return paths.boundary_name(row["from_layer"], row["to_layer"])
    if family == "role-layering":
        return paths.boundary_name(F.lower(row["from_role"]), F.lower(row["to_role"]))
    if family == "public-api":
        return F.concat(F.lit("no-deep-import-"), _slug(row["dir"]))
    if family in ("feature-slice", "app-isolation"):
        return F.concat(F.lit("no-cross-slice-" if family == "feature-slice" else "no-cross-app-"), _slug(row["container"]))
    return row["rule_id"] if family == "forbidden-imports" else F.lit(SINGLE[family])


def gates(families: dict[str, DataFrame]) -> DataFrame:
    """family, id, population, violators and the gate of every rule of every family, from what the detectors return."""
    alike = {"files": "population", "cross_importers": "violators", "consumers": "population", "deep_importers": "violators"}
    parts = []
    for family, found in families.items():
        named = found.withColumnsRenamed({k: v for k, v in alike.items() if k in found.columns and v not in found.columns})
        parts.append(named.select(F.lit(family).alias("family"), rule_of(family, {c: F.col(c) for c in named.columns}).alias("id"), *_GATE))
    return reduce(DataFrame.unionByName, parts)


def adoption(gated: DataFrame) -> DataFrame:
    """Gates that are not rejected, with how far each is to be adopted."""
    return gated.filter("status <> 'REJECT'").withColumn("adoption", F.when((F.col("status") == "AUTO") & F.col("family").isin(*STABLE), "enforce").otherwise("review"))


def cycles_gate(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: files, those of them on a cycle, and the gate."""
    cyclic = nodes.select(F.col("node").alias("id"))
    return detectors.measure(detectors._violating(files.select("id"), cyclic), [])


def _of(df: DataFrame, family: str, rule: Column, file: str, subject: str, kind: str, line: Column | None = None) -> DataFrame:
    at = F.lit(None).cast("int") if line is None else line.cast("int")
    return df.select(F.lit(family).alias("family"), rule.alias("rule_id"), F.col(file).alias("file"), F.col(subject).alias("subject"), F.lit(kind).alias("kind"), at.alias("line"))


def named(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with the paths of both ends: file, target."""
    return edges.join(files.select(F.col("id").alias("src"), F.col("path").alias("file")), "src").join(files.select(F.col("id").alias("dst"), F.col("path").alias("target")), "dst")


def target_findings(family: str, edges: DataFrame, files: DataFrame, rule: Column | None = None) -> DataFrame:
    return _of(named(edges, files), family, F.lit(SINGLE.get(family)) if rule is None else rule, "file", "target", "target")


def import_findings(family: str, imports: DataFrame, files: DataFrame, rule: Column | None = None) -> DataFrame:
    """A row for each import (id, spec) of a file that breaks the rule."""
    at = imports.join(files.select("id", F.col("path").alias("file")), "id")
    return _of(at, family, F.lit(SINGLE.get(family)) if rule is None else rule, "file", "spec", "specifier")


def usage_findings(family: str, usage: DataFrame, files: DataFrame) -> DataFrame:
    at = usage.join(files.select("id", F.col("path").alias("file")), "id")
    return _of(at, family, F.lit(SINGLE[family]), "file", "subject", "usage", F.col("line"))


def boundary_findings(family: str, boundaries: DataFrame, edges: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """Edges that run from a boundary's first group to its second."""
    of = files.filter(F.col(group).isNotNull()).select("id", F.col(group).alias("g"))
    a, b = f"from_{group}", f"to_{group}"
    flow = edges.join(of.withColumnsRenamed({"id": "src", "g": a}), "src").join(of.withColumnsRenamed({"id": "dst", "g": b}), "dst")
    met = flow.join(boundaries.select(a, b), [a, b])
    return target_findings(family, met, files, rule_of(family, {a: F.col(a), b: F.col(b)}))


def sibling_findings(family: str, members: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    src = members.select(F.col("id").alias("src"), "container", F.col("member").alias("m"))
    dst = members.select(F.col("id").alias("dst"), "container", F.col("member").alias("other"))
    return target_findings(family, edges.join(src, "src").join(dst, ["dst", "container"]).filter("m <> other"), files, rule_of(family, {"container": F.col("container")}))


def public_api_findings(files: DataFrame, edges: DataFrame, barrels: DataFrame) -> DataFrame:
    deep = detectors.outside_use(files, edges, barrels).filter("dst <> barrel_id")
    return target_findings("public-api", deep, files, rule_of("public-api", {"dir": F.col("dir")}))


def cycle_findings(edges: DataFrame, files: DataFrame) -> DataFrame:
    return target_findings("cycles", graph.cycle_edges(edges, graph.cyclic_nodes(edges)), files)


def current_exceptions(findings: DataFrame) -> DataFrame:
    """rule_id, exception: what breaks each rule as it is allowed: the file, and for entry purity the importer and the entry."""
    key = F.when(F.col("family") == "entry-purity", F.concat("file", F.lit(" -> "), "subject")).otherwise(F.col("file"))
    return findings.select("rule_id", key.alias("exception")).distinct()


def evaluated(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of adopted rules (id): what breaks each of them in a snapshot."""
    return findings.join(rules.select(F.col("id").alias("rule_id")).distinct(), "rule_id", "left_semi").select(*COLUMNS)


def packages_broken(imports: DataFrame, aliases: tuple[str, ...]) -> DataFrame:
    return detectors._packages(imports, aliases).filter(paths.is_internal(F.col("spec"), F.col("package")))


def packages_undeclared(imports: DataFrame, declared: DataFrame, aliases: tuple[str, ...]) -> DataFrame:
    keys = ["package", *[c for c in ("app",) if c in imports.columns and c in declared.columns]]
    return detectors._packages(imports, aliases).join(declared.select(*keys).distinct(), keys, "left_anti")


def workspace_broken(imports: DataFrame, packages: DataFrame) -> DataFrame:
    return detectors.workspace_imports(imports, packages).filter("violates")


