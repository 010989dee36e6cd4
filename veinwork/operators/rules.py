"""Rules as a relation: summaries, re-gating, consistency, tiers, declared rules, verdicts, emitted configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.functions import paths
from veinwork.functions.stats import gate

#: Families whose rules are stable, and families with nothing to enforce.
STABLE = ("forbidden-imports", "cycles", "test-isolation", "console-isolation", "import-style", "public-api")
NO_TOOL = ("orphans", "reachability")
ADOPT_RATE = 15.0


def regate(population: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rules measured again without allowed violators, which leave population and violators both.

    population: rule, file, violates; allowed: rule, file.
    """
    marked = population.join(allowed.select("rule", "file").distinct().withColumn("allowed", F.lit(True)), ["rule", "file"], "left")
    gone = F.col("violates") & F.coalesce("allowed", F.lit(False))
    counted = marked.groupBy("rule").agg(F.count_if(~gone).alias("population"), F.count_if(F.col("violates") & ~gone).alias("violators"))
    return counted.withColumns(gate(F.col("population"), F.col("violators"), F.lit(1.0)))


def promoted(rules: DataFrame, names: list[str]) -> DataFrame:
    """Named rules that only reached SUGGEST count as AUTO and remember it."""
    hit = F.col("id").isin(*names) & (F.col("status") == "SUGGEST")
    return rules.withColumns({"promoted_from": F.when(hit, F.col("status")), "status": F.when(hit, "AUTO").otherwise(F.col("status"))})


def self_consistency(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """rule, problem for rules (rule, status, population, violators) against their listed violators (rule, file)."""
    counts = listed.groupBy("rule").agg(F.count_distinct("file").alias("listed"))
    joined = rules.join(counts, "rule", "left").withColumn("listed", F.coalesce("listed", F.lit(0)))
    problems = F.filter(
        F.array(
            F.when((F.col("status") == "AUTO") & (F.col("population") == 0), "auto on an empty population"),
            F.when(F.col("violators") != F.col("listed"), "recorded and listed violators differ"),
            F.when((F.col("status") == "AUTO") & (F.col("violators") > 3), "auto beyond the exceptions allowed"),
        ),
        lambda x: x.isNotNull(),
    )
    return joined.select("rule", F.explode(problems).alias("problem"))


def summary(rules: DataFrame, exceptions: DataFrame, cap: int = 10) -> DataFrame:
    """Rules that are not rejected, with at most ``cap`` exceptions in order (the report's own limit)."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("exception"))
    first = exceptions.select("id", "exception").distinct().withColumn("place", place).filter(F.col("place") <= cap)
    listed = first.groupBy("id").agg(F.array_sort(F.collect_list("exception")).alias("exceptions"))
    kept = rules.filter("status <> 'REJECT'").join(listed, "id", "left")
    adoption = F.when(F.col("status") == "AUTO", F.when(F.col("family").isin(*STABLE), "enforce").otherwise("review")).otherwise("review")
    return kept.select("family", "id", "status", adoption.alias("adoption"), "floor", "observed", "population", "violators", F.coalesce("exceptions", F.array().cast("array<string>")).alias("exceptions"))


def tiers(families: DataFrame, catalog: DataFrame, stack: list[str], adoptable: Column | None = None) -> DataFrame:
    """title, tier, rate for families (title, key, status): enforce, report-only, review or adopt; others have no row.

    catalog: title, overall, by_stack map<string, double>.
    """
    own = F.transform(F.array(*[F.lit(s) for s in stack]).cast("array<string>"), lambda s: F.try_element_at("by_stack", s))
    best = F.when(F.col("overall").isNotNull(), F.array_max(F.concat(F.array("overall"), own)))
    joined = families.join(catalog, "title", "left").withColumn("rate", best)
    base = F.when(~F.col("key").isin(*STABLE), "review").when(F.col("key").isin(*NO_TOOL), "report-only").otherwise("enforce")
    if adoptable is not None:
        base = F.when((base == "enforce") & ~adoptable, "report-only").otherwise(base)
    tier = (
        F.when((F.col("status") == "AUTO") & (base != "review"), base)
        .when(F.col("status").isin("AUTO", "SUGGEST"), "review")
        .when(F.col("rate").isNull() | (F.col("rate") >= ADOPT_RATE), "adopt")
    )
    return joined.select("title", tier.alias("tier"), "rate").filter("tier IS NOT NULL")


def family_status(groups: DataFrame) -> DataFrame:
    """family, status: AUTO if any of its rules is, else SUGGEST if any, else NONE."""
    rank = F.max(F.when(F.col("status") == "AUTO", 2).when(F.col("status") == "SUGGEST", 1).otherwise(0))
    return groups.groupBy("family").agg(rank.alias("r")).select("family", F.element_at(F.array(F.lit("NONE"), F.lit("SUGGEST"), F.lit("AUTO")), F.col("r") + 1).alias("status"))


def detected_stack(dependencies: DataFrame, tokens: dict[str, str]) -> DataFrame:
    """token for each dependency -> token of the table that (package) holds."""
    chain = F
    for package, token in tokens.items():
        chain = chain.when(F.col("package") == package, token)
    return dependencies.select(chain.otherwise(None).alias("token")).filter("token IS NOT NULL").distinct()


def takes_name(names: Column, forbidden: list[str] | None) -> Column:
    """Whether an import takes one of the forbidden names; all of a module ('*') takes them, unknown names (null) do not."""
    if forbidden is None:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(names, F.array(F.lit("*"), *[F.lit(n) for n in forbidden])), F.lit(False))


def _import_hit(rule: dict, columns: list[str]) -> Column:
    """Whether an import (spec, and where known names and target) is what a rule forbids."""
    hit = F.col("spec").rlike(rule["pattern"]) if "pattern" in rule else F.lit(False)
    for glob, names in rule.get("packages", []):
        hit = hit | (paths.matches_any(F.col("spec"), [glob]) & (takes_name(F.col("names"), names) if "names" in columns else F.lit(names is None)))
    if rule.get("targets") and "target" in columns:
        hit = hit | F.coalesce(paths.matches_any(F.col("target"), rule["targets"]), F.lit(False))
    return F.coalesce(hit, F.lit(False))


def _marks(marks: list[tuple[str, Column]]) -> Column:
    """Names whose condition holds."""
    return F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in marks]), lambda x: x.isNotNull()) if marks else F.array().cast("array<string>")


def declared_violations(files: DataFrame, imports: DataFrame, rules: list[dict], usage: DataFrame | None = None) -> DataFrame:
    """rule, id, subject, line, inside: each import, use or file that a declared rule forbids, and whether it is in the rule's scope.

    A rule has name, template (forbid-import, forbid-usage or forbid-file),
    files, except, and for imports a pattern, packages (glob, names or None) or
    target globs, for uses the globals.  Globs compile on the driver, so every
    rule is a pair of column expressions; rows explode for rules they hit only.
    """
    scopes = [(r["name"], paths.in_scope(F.col("path"), r["files"], r.get("except", []))) for r in rules]
    placed = files.select("id", "path", _marks(scopes).alias("scopes"))
    of = lambda template: [r for r in rules if r["template"] == template]
    line = F.col("line") if "line" in imports.columns else F.lit(None)
    hits = imports.select("id", F.col("spec").alias("subject"), line.cast("long").alias("line"), F.explode(_marks([(r["name"], _import_hit(r, imports.columns)) for r in of("forbid-import")])).alias("rule"))
    if usage is not None:
        uses = _marks([(r["name"], F.col("subject").isin(*r["usage"])) for r in of("forbid-usage")])
        hits = hits.unionByName(usage.select("id", "subject", F.col("line").cast("long").alias("line"), F.explode(uses).alias("rule")))
    found = hits.join(placed.select("id", "scopes"), "id").select("rule", "id", "subject", "line", F.array_contains("scopes", F.col("rule")).alias("inside"))
    whole = [r["name"] for r in of("forbid-file")]
    present = placed.select(F.explode(F.array_intersect("scopes", F.array(*[F.lit(n) for n in whole]).cast("array<string>"))).alias("rule"), "id", F.col("path").alias("subject"), F.lit(1).cast("long").alias("line"), F.lit(True).alias("inside"))
    return found.unionByName(present)


def declared_measure(files: DataFrame, imports: DataFrame, rules: list[dict], usage: DataFrame | None = None) -> DataFrame:
    """rule, template, scope_n, violators_n, elsewhere_n of declared rules; see ``declared_violations``."""
    scopes = [(r["name"], paths.in_scope(F.col("path"), r["files"], r.get("except", []))) for r in rules]
    scope = files.select(F.explode(_marks(scopes)).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("scope_n"))
    broken = declared_violations(files, imports, rules, usage).groupBy("rule").agg(
        F.count_distinct(F.when(F.col("inside"), F.col("id"))).alias("violators_n"), F.count_distinct(F.when(~F.col("inside"), F.col("id"))).alias("elsewhere_n")
    )
    every = files.sparkSession.createDataFrame([(r["name"], r["template"]) for r in rules], "rule string, template string")
    joined = every.join(scope, "rule", "left").join(broken, "rule", "left")
    return joined.select("rule", "template", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("scope_n", "violators_n", "elsewhere_n")])


def unmatched_targets(files: DataFrame, rules: list[dict]) -> DataFrame:
    """rule, target: target globs of declared rules that no file matches."""
    pairs = [(r["name"], t) for r in rules for t in r.get("targets", [])]
    marks = F.filter(F.array(*[F.when(paths.matches_any(F.col("path"), [t]), F.struct(F.lit(n).alias("rule"), F.lit(t).alias("target"))) for n, t in pairs]), lambda x: x.isNotNull()) if pairs else F.array().cast("array<struct<rule:string,target:string>>")
    met = files.select(F.explode(marks).alias("x")).select("x.*").distinct()
    return files.sparkSession.createDataFrame(pairs, "rule string, target string").join(met, ["rule", "target"], "left_anti")


def not_global(other_forms: DataFrame, usage: DataFrame, rules: list[dict]) -> DataFrame:
    """rule, usage, files_n: globals of usage rules that are only read in other forms (id, subject), never as globals."""
    pairs = [(r["name"], u) for r in rules if r["template"] == "forbid-usage" for u in r["usage"]]
    wanted = other_forms.sparkSession.createDataFrame(pairs, "rule string, usage string")
    counted = other_forms.groupBy(F.col("subject").alias("usage")).agg(F.count_distinct("id").alias("files_n"))
    return wanted.join(usage.select(F.col("subject").alias("usage")).distinct(), "usage", "left_anti").join(counted, "usage").select("rule", "usage", "files_n")


def verdicts(measured: DataFrame, unmatched: DataFrame | None = None, other: DataFrame | None = None) -> DataFrame:
    """rule, verdict, vacuous: what a declared rule's measure says, with ``unmatched_targets`` and ``not_global`` where known."""
    rows = measured
    for name, found in (("unmatched", unmatched), ("other", other)):
        rows = rows.withColumn(name, F.lit(False)) if found is None else rows.join(found.select("rule", F.lit(True).alias(name)).distinct(), "rule", "left").fillna(False, name)
    empty, whole = F.col("scope_n") == 0, F.col("template") == "forbid-file"
    verdict = F.when(whole, "enforce-now").when(empty | F.col("unmatched") | F.col("other"), "no-match").when(F.col("violators_n") > 0, "baseline").otherwise("enforce-now")
    vacuous = F.when(whole, empty).otherwise((F.col("violators_n") == 0) & (F.col("elsewhere_n") == 0) & ~F.col("other"))
    return rows.select("rule", verdict.alias("verdict"), vacuous.alias("vacuous"))


def gap_report(mapped: DataFrame, declared: DataFrame) -> DataFrame:
    """entry, verdict of mapped sentences (entry, template, rule, line, invalid): what is invalid, then whose quote is not found (no line), then by template.

    ``declared`` has the verdicts of declared rules.
    """
    joined = mapped.join(declared.select("rule", F.col("verdict").alias("measured")), "rule", "left")
    verdict = (
        F.when(F.col("invalid").isNotNull(), "invalid").when(F.col("line").isNull(), "quote-not-found").when(F.col("template") == "none", "guidance")
        .when(F.col("template") == "inferred", "inferred").otherwise(F.col("measured"))
    )
    return joined.select("entry", "rule", verdict.alias("verdict"))


def declared_adoption(report: DataFrame, adopted: DataFrame, baseline: bool) -> DataFrame:
    """entry, rule, outcome of a gap report: adopted, stated (an inferred rule, adopted already, in words) or the verdict that refuses it."""
    joined = report.join(adopted.select(F.col("id").alias("rule"), F.lit(True).alias("known")).distinct(), "rule", "left")
    taken = F.col("verdict").isin("enforce-now", *(["baseline"] if baseline else []))
    outcome = F.when((F.col("verdict") == "inferred") & F.col("known"), "stated").when(taken, "adopted").otherwise(F.col("verdict"))
    return joined.select("entry", "rule", outcome.alias("outcome"))


def reconciled(recommended: DataFrame, families: DataFrame, adopted: DataFrame) -> DataFrame:
    """title, tier, rate as adopted: a family (title, key) is enforced exactly if an adopted rule (family) enforces it."""
    known = families.join(adopted.filter("family <> 'declared'").select(F.col("family").alias("key")).distinct(), "key", "left_semi").select("title", F.lit(True).alias("known"))
    tier = F.when(F.col("known") & F.col("tier").isin("enforce", "review"), "enforce").when(F.col("known").isNull() & (F.col("tier") == "enforce"), "report-only").otherwise(F.col("tier"))
    return recommended.join(known, "title", "left").select("title", tier.alias("tier"), "rate")


def selected(rules: DataFrame, only: list[str] | None = None, removed: list[str] = (), structural: list[str] = (), enforcers: dict[str, str] | None = None) -> DataFrame:
    """Rules (id, family, status) that are to be written out: enforced ones that are asked for and not removed, with their enforcer.

    ``structural`` families are written whatever was asked for; without an
    enforcer for its family a rule is only reported.
    """
    asked = F.lit(True) if only is None else F.col("id").isin(*only) | F.col("family").isin(*structural)
    chain = F
    for family, tool in (enforcers or {}).items():
        chain = chain.when(F.col("family") == family, tool)
    tool = chain.otherwise(F.lit(None).cast("string")) if enforcers else F.lit(None).cast("string")
    return rules.filter((F.col("status") == "AUTO") & asked & ~F.col("id").isin(*removed)).withColumn("enforcer", tool)


def graph_edges(boundaries: DataFrame) -> DataFrame:
    """Two rows a boundary: the flow against it, and the leak along it."""
    flow = boundaries.select(F.col("to_layer").alias("from_layer"), F.col("from_layer").alias("to_layer"), F.col("reverse_flow").alias("weight"), F.lit(False).alias("leak"))
    leak = boundaries.filter("violators > 0").select("from_layer", "to_layer", F.col("violators").alias("weight"), F.lit(True).alias("leak"))
    return flow.unionByName(leak)


def mermaid(edges: DataFrame) -> DataFrame:
    """One row, a flow chart; node ids follow the order of names.  Layers are few."""
    names = F.array_sort(F.array_union(F.collect_set("from_layer"), F.collect_set("to_layer")))
    lines = F.array_sort(F.collect_list(F.struct("from_layer", "to_layer", "leak", "weight")))
    packed = edges.agg(names.alias("names"), lines.alias("lines"))
    node = lambda name: F.concat(F.lit("n"), (F.array_position("names", name) - 1).cast("string"))
    nodes = F.transform("names", lambda x: F.concat(F.lit("  "), node(x), F.lit('["'), x, F.lit('"]')))
    arrows = F.transform("lines", lambda e: F.concat(F.lit("  "), node(e["from_layer"]), F.when(e["leak"], F.lit(" -.->|")).otherwise(F.lit(" -->|")), e["weight"].cast("string"), F.lit("| "), node(e["to_layer"])))
    return packed.select(F.array_join(F.concat(F.array(F.lit("flowchart LR")), nodes, arrows), "\n").alias("chart"))


def disallowed(boundaries: DataFrame) -> DataFrame:
    """from_layer, disallow: per layer the sorted layers it must not import (enforced boundaries)."""
    return boundaries.filter("status = 'AUTO'").groupBy("from_layer").agg(F.array_join(F.array_sort(F.collect_set("to_layer")), ",").alias("disallow"))


def forbidden_rules(boundaries: DataFrame) -> DataFrame:
    """name, rule: a dependency checker's forbidden entries as JSON; names that occur twice drop out."""
    named = boundaries.filter("status = 'AUTO'").withColumn("name", paths.boundary_name(F.col("from_layer"), F.col("to_layer")))
    single = named.join(named.groupBy("name").count().filter("count = 1").select("name"), "name", "left_semi")
    side = lambda c: F.struct(F.concat(F.lit("^src/"), F.col(c), F.lit("/")).alias("path"))
    return single.select("name", F.to_json(F.struct(F.col("name"), F.lit("error").alias("severity"), side("from_layer").alias("from"), side("to_layer").alias("to"))).alias("rule"))


def annotations(findings: DataFrame) -> DataFrame:
    """CI annotations of findings (rule_id, file, line)."""
    text = F.concat(F.lit("::error file="), paths.annotation_property(F.col("file")), F.lit(",line="), F.col("line").cast("string"), F.lit("::"), paths.annotation_text(F.concat(F.col("rule_id"), F.lit(": new violation"))))
    return findings.select(text.alias("annotation"))
