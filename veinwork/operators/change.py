"""Comparing two snapshots: findings, rules, exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.functions import prose

IDENTITY = ["rule_id", "file"]


def grown(base: DataFrame, head: DataFrame, keys: list[str] = IDENTITY) -> DataFrame:
    """Identities with their counts on both sides (a bag comparison): keys, base_n, head_n.

    One aggregation over the union instead of two and a full outer join.
    """
    both = base.select(*keys, F.lit(0).alias("side")).unionByName(head.select(*keys, F.lit(1).alias("side")))
    return both.groupBy(*keys).agg(F.count_if(F.col("side") == 0).alias("base_n"), F.count_if(F.col("side") == 1).alias("head_n"))


def introduced(base: DataFrame, head: DataFrame, added: DataFrame, keys: list[str] = IDENTITY) -> DataFrame:
    """Findings of identities that grew: the ones on added lines if those are as many as the growth, else all.

    ``added`` has (file, line).  keys..., line.
    """
    counts = grown(base, head, keys).filter("head_n > base_n")
    marked = head.join(added.select("file", "line").distinct().withColumn("is_added", F.lit(True)), ["file", "line"], "left").join(counts, keys)
    on_added = F.count_if("is_added").over(Window.partitionBy(*keys))
    exact = marked.withColumn("on_added", on_added)
    keep = (F.col("base_n") == 0) | (F.col("on_added") != F.col("head_n") - F.col("base_n")) | F.col("is_added")
    return exact.filter(keep).select(*keys, "line")


def fixed(base: DataFrame, head: DataFrame, keys: list[str] = IDENTITY) -> DataFrame:
    """Base findings beyond the number that the head still has, by line."""
    counts = grown(base, head, keys).filter("base_n > head_n")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("line"))
    return base.join(counts, keys).withColumn("place", place).filter("place > head_n").select(*keys, "line")


def renamed(findings: DataFrame, renames: DataFrame) -> DataFrame:
    """Findings under the new names of files; the subject too when it is a file (kind 'target')."""
    as_file = renames.select(F.col("from").alias("file"), F.col("to").alias("new_file"))
    as_subject = renames.select(F.col("from").alias("subject"), F.col("to").alias("new_subject"))
    joined = findings.join(as_file, "file", "left").join(as_subject, "subject", "left")
    subject = F.when((F.col("kind") == "target") & F.col("new_subject").isNotNull(), F.col("new_subject")).otherwise(F.col("subject"))
    return joined.select("rule_id", F.coalesce("new_file", "file").alias("file"), subject.alias("subject"), "kind", *[c for c in findings.columns if c not in ("rule_id", "file", "subject", "kind")])


def rule_partition(base: DataFrame, head: DataFrame) -> DataFrame:
    """id, change: comparable, changed, new or removed, from (id, definition) on both sides."""
    b, h = base.select("id", F.col("definition").alias("was")), head.select("id", F.col("definition").alias("now"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "comparable").otherwise("changed")
    return b.join(h, "id", "full_outer").select("id", change.alias("change"))


def ratchet(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """rule, new_n, fixed_n, left_n of exceptions (rule, exception); rules of both sides only."""
    both = recorded.select("rule", "exception", F.lit(True).alias("rec"), F.lit(False).alias("cur")).unionByName(current.select("rule", "exception", F.lit(False).alias("rec"), F.lit(True).alias("cur")))
    each = both.groupBy("rule", "exception").agg(F.bool_or("rec").alias("rec"), F.bool_or("cur").alias("cur"))
    out = each.groupBy("rule").agg(
        F.count_if(F.col("cur") & ~F.col("rec")).alias("new_n"), F.count_if(F.col("rec") & ~F.col("cur")).alias("fixed_n"), F.count_if(F.col("rec") & F.col("cur")).alias("left_n"),
        F.bool_or("rec").alias("has_rec"), F.bool_or("cur").alias("has_cur"),
    )
    return out.filter("has_rec AND has_cur").select("rule", "new_n", "fixed_n", "left_n")


def burn_down(recorded: DataFrame, was_recorded: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """rule, left_n, fixed_in_change_n, still_recorded_n of exceptions (rule, exception)."""
    sides = {"rec": recorded, "old": was_recorded, "before": before, "now": now}
    union: DataFrame | None = None
    for name, df in sides.items():
        rows = df.select("rule", "exception", *[F.lit(name == other).alias(other) for other in sides])
        union = rows if union is None else union.unionByName(rows)
    each = union.groupBy("rule", "exception").agg(*[F.bool_or(n).alias(n) for n in sides])
    return each.groupBy("rule").agg(
        F.count_if(F.col("rec") & F.col("now")).alias("left_n"),
        F.count_if(F.col("old") & F.col("before") & ~F.col("now")).alias("fixed_in_change_n"),
        F.count_if(F.col("rec") & ~F.col("now")).alias("still_recorded_n"),
    )


def without_allowed(findings: DataFrame, allowed: DataFrame) -> DataFrame:
    return findings.join(allowed.select(F.col("rule").alias("rule_id"), "file"), ["rule_id", "file"], "left_anti")


def unused_allowances(allowed: DataFrame, findings: DataFrame) -> DataFrame:
    return allowed.join(findings.select(F.col("rule_id").alias("rule"), "file"), ["rule", "file"], "left_anti")


def located(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """A line for each finding where its (rule_id, file, subject) has exactly one."""
    one = lines.groupBy("rule_id", "file", "subject").agg(F.count_distinct("line").alias("n"), F.min("line").alias("at"))
    return findings.join(one, ["rule_id", "file", "subject"], "left").select(*findings.columns, F.when(F.col("n") == 1, F.col("at")).alias("at"))


def _rung(text: Column) -> Column:
    """How many first characters of a text are its key: all up to 16, else 16, 24 or 32."""
    n = F.length(text)
    return F.when(n < 16, n).when(n < 24, 16).when(n < 32, 24).otherwise(F.when(n.isNotNull(), 32))


def _holders(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole): texts ``whole`` that hold a text ``part``, itself included.

    Whatever holds a text holds its first characters, so the two sides meet by
    equality: a whole has a key for each place and each length of keys that occurs.
    """
    longest = wholes.agg(F.max(F.length("whole")).alias("longest"))
    own = parts.crossJoin(F.broadcast(longest)).filter(F.length("part") <= F.col("longest")).select("part", _rung(F.col("part")).alias("n"))
    rungs = own.agg(F.collect_set("n").alias("rungs"))  # one row of at most 19 lengths
    places = lambda n: F.when(n == 0, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.length("whole") - n + 1), lambda k: F.substring(F.col("whole"), k, n)))
    keys = F.array_distinct(F.flatten(F.transform(F.filter("rungs", lambda n: n <= F.length("whole")), places)))
    keyed = wholes.crossJoin(F.broadcast(rungs)).select("whole", F.explode(keys).alias("key"))
    # many more rows than texts, which the planner does not see
    met = own.select("part", F.substring(F.col("part"), F.lit(1), F.col("n")).alias("key")).join(keyed.hint("merge"), "key")
    return met.filter(F.col("whole").contains(F.col("part"))).select("part", "whole")


def unchecked_sentences(head: DataFrame, base: DataFrame, quoted: DataFrame) -> DataFrame:
    """Sentences (doc, text) that the base lacks and no quoted statement holds or is held by."""
    fresh = head.join(base.select("doc", "text").distinct(), ["doc", "text"], "left_anti")
    texts, statements = fresh.select("text").distinct(), quoted.select("statement").distinct()
    longer = _holders(statements.toDF("part"), texts.toDF("whole")).select(F.col("whole").alias("text"))
    shorter = _holders(texts.toDF("part"), statements.toDF("whole")).select(F.col("part").alias("text"))
    return fresh.join(longer.unionByName(shorter).distinct(), "text", "left_anti").select("doc", "text")


def context_counts(sentences: DataFrame, unchecked: DataFrame) -> DataFrame:
    """One row, unchecked_n and rule_like_n: of sentences (doc, text, rule_like), those that are unchecked, and rules among them."""
    met = sentences.select("doc", "text", "rule_like").distinct().join(unchecked.select("doc", "text").distinct(), ["doc", "text"], "left_semi")
    return met.agg(F.count(F.lit(1)).alias("unchecked_n"), F.count_if("rule_like").alias("rule_like_n"))


def relocated(rules: DataFrame, texts: DataFrame) -> DataFrame:
    """Rules (file, statement, line, more columns) with the line on which their sentence now stands in texts (file, text), and two flags.

    ``moved``: the line is another.  ``stale``: the file is gone, or no longer
    holds the sentence; the rule keeps its last line.  Emphasis, quotes and white
    space are told apart in neither.  Where a sentence stands more than once, the
    first counts.  Sentences of one file are looked up once each, however many
    rules state them.
    """
    stated = rules.select("file", "statement").distinct()
    one = texts.groupBy("file").agg(F.min("text").alias("text")).select("file", prose.plain(F.col("text")).alias("body"), prose.line_lengths(F.col("text")).alias("lengths"))  # once a file
    found = stated.join(one, "file").select("file", "statement", prose.line_at(F.col("body"), F.col("lengths"), F.col("statement")).cast("long").alias("at"))
    met = rules.alias("r").join(found.alias("f"), (F.col("r.file") == F.col("f.file")) & (F.col("r.statement") == F.col("f.statement")), "left")
    now = F.coalesce(F.col("f.at"), F.col("r.line").cast("long"))
    kept = [F.col(f"r.{c}") for c in rules.columns if c != "line"]
    return met.select(*kept, now.alias("line"), F.coalesce(F.col("f.at") != F.col("r.line"), F.lit(False)).alias("moved"), F.col("f.at").isNull().alias("stale"))


def remeasured(rules: DataFrame, recorded: DataFrame, current: DataFrame, mode: str) -> DataFrame:
    """rule, exception: the exceptions of rules (rule, family, mode) adopted in another mode, where they are no longer those recorded.

    Only forbidden imports are seen differently by mode; a rule that has none
    left has one row without an exception.
    """
    other = rules.filter((F.col("family") == "forbidden-imports") & (F.col("mode") != mode)).select("rule")
    both = recorded.select("rule", "exception", F.lit(1).alias("rec"), F.lit(0).alias("cur")).unionByName(current.select("rule", "exception", F.lit(0).alias("rec"), F.lit(1).alias("cur")))
    each = both.groupBy("rule", "exception").agg(F.max("rec").alias("rec"), F.max("cur").alias("cur"))
    changed = each.groupBy("rule").agg(F.bool_or(F.col("rec") != F.col("cur")).alias("changed")).filter("changed").join(other, "rule", "left_semi").select("rule")
    now = current.select("rule", "exception").distinct()
    return changed.join(now, "rule", "left").select("rule", "exception")


def first_recorded(rules: DataFrame, current: DataFrame) -> DataFrame:
    """rule, exception: what breaks rules (rule, recorded) that have no record of exceptions."""
    return current.join(rules.filter("NOT recorded").select("rule"), "rule", "left_semi").select("rule", "exception")


def removed_rules(base: DataFrame, head: DataFrame) -> DataFrame:
    """Rules (id) of the base where the head has none at all: a change that takes the rules themselves away."""
    n = head.agg(F.count(F.lit(1)).alias("n"))
    return base.select("id").crossJoin(F.broadcast(n)).filter("n = 0").select("id")


def merged_state(prior: DataFrame, scanned: DataFrame, removed: Column) -> DataFrame:
    """Adoption state: scanned rules win, prior ones are carried, removed ones go.  (id, ...)."""
    carried = prior.join(scanned.select("id"), "id", "left_anti")
    return scanned.unionByName(carried, allowMissingColumns=True).filter(~removed)


def ratcheted(prior: DataFrame, recorded: DataFrame, scanned: DataFrame, current: DataFrame, removed: DataFrame, baseline: DataFrame) -> DataFrame:
    """(rule, exception, state) of the rules in force after a scan, from what is recorded and what breaks them now.

    Exceptions of rules that were in force are ``kept``, ``fixed`` or ``grown``;
    those of new rules, and of rules in ``baseline``, are ``first`` or ``fixed``.
    """
    rule = lambda df, flag: df.select("rule", F.lit(flag).alias("flag"))
    flags = rule(prior, 1).unionByName(rule(scanned, 2)).unionByName(rule(removed, 4)).unionByName(rule(baseline, 8))
    in_force = flags.groupBy("rule").agg(F.bit_or("flag").alias("flags")).filter("flags & 3 <> 0 AND flags & 4 = 0")
    side = lambda df, seen: df.select("rule", "exception", F.lit(seen).alias("seen"))
    seen = side(recorded, 1).unionByName(side(current, 2)).groupBy("rule", "exception").agg(F.bit_or("seen").alias("seen"))
    held = F.expr("flags & 1 <> 0 AND flags & 8 = 0")
    state = F.when(F.col("seen") == 1, "fixed").when(~held, "first").when(F.col("seen") == 3, "kept").otherwise("grown")
    return seen.join(in_force, "rule").select("rule", "exception", state.alias("state"))
