"""Texts from rules: checks, cards, charts.  Rules are few; every text is one column expression over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions import paths, roles


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def rule_names(boundaries: DataFrame) -> DataFrame:
    return boundaries.withColumn("name", paths.boundary_name(F.col("from_layer"), F.col("to_layer")))


def statements(boundaries: DataFrame) -> DataFrame:
    """name, statement: a boundary in words, with its evidence."""
    share = F.format_string("%.1f%%", 100 * F.col("observed"))
    text = F.concat(F.lit("Files in "), "from_layer", F.lit(" must not import "), "to_layer", F.lit(" ("), (F.col("population") - F.col("violators")).cast("string"), F.lit(" of "), F.col("population").cast("string"), F.lit(" follow, "), share, F.lit(")."))
    return rule_names(boundaries).select("name", text.alias("statement"))


def cards(boundaries: DataFrame) -> DataFrame:
    """name, card: a rule card in markdown."""
    named = rule_names(boundaries).join(statements(boundaries), "name")
    card = _lines(
        F.concat(F.lit("# "), "name"), "", F.col("statement"), "", F.concat(F.lit("- status: "), "status"), F.concat(F.lit("- floor: "), F.col("floor").cast("string")),
        "", "Passing:", F.concat(F.lit("  import './"), "from_layer", F.lit("/other'")), "Failing:", F.concat(F.lit("  import './"), "to_layer", F.lit("/any'")),
    )
    return named.select("name", card.alias("card"))


def restricted_imports(boundaries: DataFrame) -> DataFrame:
    """from_layer, config: a linter's entry for each layer: its files, and the patterns it must not import."""
    patterns = F.array_sort(F.collect_set(F.concat(F.lit("**/"), "to_layer", F.lit("/**"))))
    grouped = boundaries.filter("status = 'AUTO'").groupBy("from_layer").agg(patterns.alias("patterns"))
    return grouped.select("from_layer", F.to_json(F.struct(F.array(F.concat(F.lit("src/"), "from_layer", F.lit("/**"))).alias("files"), F.col("patterns").alias("restricted"))).alias("config"))


def architecture_tests(boundaries: DataFrame) -> DataFrame:
    """name, test: an assertion for a test runner per enforced boundary."""
    test = F.format_string("expectNoDependency({ name: '%s', from: /^src\\/%s\\//, to: /^src\\/%s\\// })", "name", "from_layer", "to_layer")
    return rule_names(boundaries.filter("status = 'AUTO'")).select("name", test.alias("test"))


def dot(edges: DataFrame) -> DataFrame:
    """graph: one row, a directed graph with dashed leaks; layers are few."""
    line = F.concat(F.lit('  "'), "from_layer", F.lit('" -> "'), "to_layer", F.lit('" [label="'), F.col("weight").cast("string"), F.when(F.col("leak"), F.lit('", style=dashed]')).otherwise(F.lit('"]')))
    packed = edges.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    return packed.select(_lines("digraph layers {", F.col("body"), "}").alias("graph"))


def report(summary: DataFrame, cap: int = 8) -> DataFrame:
    """status, n, text: per status how many rules, and the first ``cap`` of them (the report's own limit)."""
    one = F.concat("id", F.lit(": "), F.col("violators").cast("string"), F.lit("/"), F.col("population").cast("string"))
    return summary.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list(one)), 1, cap), "\n").alias("text"))


def scan_json(summary: DataFrame, app: str, version: int = 1) -> DataFrame:
    """json: one row, an app's rules as a document."""
    rules = F.array_sort(F.collect_list(F.struct("id", "family", "status", "population", "violators", "floor")))
    return summary.agg(rules.alias("rules")).select(F.to_json(F.struct(F.lit(version).alias("version"), F.array(F.struct(F.lit(app).alias("app"), F.col("rules"))).alias("apps"))).alias("json"))


def rule_key(ref: Column) -> Column:
    """A rule's name as users write it: case, spaces and a tool's prefix do not count."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(ref), r"\s+", " ")), r"^[a-z]+/ *", "")


def found_rules(refs: DataFrame, rules: DataFrame) -> DataFrame:
    """ref, id: the rule (id, label) that each reference (ref) names."""
    names = rules.select("id", F.explode(F.filter(F.array("id", "label"), lambda x: x.isNotNull())).alias("name")).select("id", rule_key(F.col("name")).alias("key"))
    return refs.select("ref", rule_key(F.col("ref")).alias("key")).join(names, "key", "left").groupBy("ref").agg(F.min("id").alias("id"))


def code_frame(text: Column, line: Column, around: int = 2) -> Column:
    """The lines around one, numbered, the one itself marked."""
    lines = F.split(text, "\n")
    first = F.greatest(line - around, F.lit(1))
    shown = F.slice(lines, first, F.least(line + around, F.size(lines)) - first + 1)
    return F.array_join(F.transform(shown, lambda t, i: F.concat(F.when(i + first == line, "> ").otherwise("  "), F.lpad((i + first).cast("string"), 4, " "), F.lit(" | "), t)), "\n")


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def checker_rules(gates: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """family, name, rule: a dependency checker's forbidden entry for each enforced rule (family, id, from, to) as JSON.

    ``from`` and ``to`` are a rule's two sides: layers, roles, a directory or a
    container.  Files that may break a rule (rule, file) are exempt from it.
    """
    tests = roles.pattern_of("TEST")
    side = lambda path=None, but=None: F.struct(*([F.array(path).alias("path")] if path is not None else []), *([F.array(but).alias("pathNot")] if but is not None else []))
    text = lambda t: F.to_json(t)
    within = lambda c: F.concat(F.lit("^src/"), _quoted(F.col(c)), F.lit("/"))
    members = F.concat(F.lit("^"), _quoted(F.col("from")), F.lit("/([^/]+)/"))
    same = F.concat(F.lit("^"), _quoted(F.col("from")), F.lit("/$1/"))
    folder = F.concat(F.lit("^"), _quoted(F.col("from")), F.lit("/"))
    role = lambda c: F.element_at(F.create_map(*[F.lit(x) for r in sorted({r for r, *_ in roles.RULES}) for x in (r, roles.pattern_of(r))]), F.col(c))
    shapes = {
        "layer": (text(side(within("from"))), text(side(within("to")))),
        "role-layering": (text(side(role("from"))), text(side(role("to")))),
        "public-api": (text(side(but=folder)), text(side(folder, F.concat(folder, F.lit("index\\.(ts|tsx)$"))))),
        "feature-slice": (text(side(members)), text(side(members, same))),
        "app-isolation": (text(side(members)), text(side(members, same))),
        "test-isolation": (text(side(but=F.lit(tests))), text(side(F.lit(tests)))),
        "entry-purity": (text(side(but=F.lit(roles.pattern_of(*roles.FRAMEWORK_ENTRY)))), text(side(F.lit(roles.pattern_of(*roles.FRAMEWORK_ENTRY))))),
        "dependency-hygiene": (text(side(but=F.lit(tests))), text(side(F.lit(f"node_modules/(@[^/]+/)?[^/]+/({'|'.join(paths.INTERNAL)})/")))),
        "phantom-deps": (text(side(but=F.lit(tests))), F.lit('{"dependencyTypes":["npm-no-pkg","npm-unknown"]}')),
        "stories-isolation": (text(side(but=F.lit(paths.STORY))), text(side(F.lit(paths.STORY)))),
        "ui-data": (text(side(F.lit(roles.pattern_of("COMPONENT")))), text(side(F.lit(roles.pattern_of("DB_MODULE", "DATA_ACCESS"))))),
        "server-client": (text(side(F.col("from"))), text(side(F.col("to")))),
    }
    source = target = F
    for family, (a, b) in shapes.items():
        source, target = source.when(F.col("family") == family, a), target.when(F.col("family") == family, b)
    rows = gates.filter((F.col("status") == "AUTO") & F.col("family").isin(*shapes))
    if exempt is not None:
        listed = exempt.groupBy(F.col("rule").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("^"), _quoted(F.col("file")), F.lit("$")))).alias("exempt"))
        rows = rows.join(listed, "id", "left")
    else:
        rows = rows.withColumn("exempt", F.lit(None).cast("array<string>"))
    free = F.when(F.col("exempt").isNotNull(), F.concat(F.lit(',"exempt":'), F.to_json("exempt"))).otherwise("")
    rule = F.concat(F.lit('{"name":"'), F.col("id"), F.lit('","severity":"error","from":'), source.otherwise("{}"), F.lit(',"to":'), target.otherwise("{}"), free, F.lit("}"))
    return rows.select("family", F.col("id").alias("name"), rule.alias("rule"))


def annotation_summary(introduced: DataFrame, fixed: DataFrame) -> DataFrame:
    """line: one row, what a change introduces and fixes, in words."""
    n = introduced.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rule_id").alias("rules"))
    m = fixed.agg(F.count(F.lit(1)).alias("m"))
    return n.crossJoin(F.broadcast(m)).select(F.format_string("%d new violations of %d rules, %d fixed", "n", "rules", "m").alias("line"))
