"""An audit of how filters interact: what each removes in every order, and what others would have removed.

Five filters fail a document: A short, B repetitive, C shouting, D symbols, E a
duplicate.  One pass reads the texts and gives four of them, the length and
hashes of successive blocks.  Duplicates come by partition refinement: classes
of equal length are split by the hash of the first block, then of the next,
and classes of one document leave after each step; the texts of what is left
are compared in full, by grouping on the text itself, and all but the row of
the smallest id are marked.  Which filters a document fails is then a mask;
all orders are evaluated from the numbers of documents by (part, mask).

Defined results: a null text counts as empty (it fails A, and E where a
smaller id has no words of any kind either); a null part is the empty string;
rows of one id with equal texts are no duplicates of each other; a null id is
neither smaller nor larger than another, so its row does not fail E; labels
of one id are joined by "any"; ids without labels count as unlabelled; texts of
any length are hashed and compared whole; an empty table gives no rows.  Only
the named columns are read, so other columns may have any name.

A third of all rows may be one text: rows meet the sizes of their classes
under (class, salt), copies are grouped where they are read, and rows meet the
smallest id of their class under (class, id).
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.llm.workspace import BROADCAST_ROWS, from_files, shared_folder, written

FILTERS = "ABCDE"
WORD_BREAK = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 200
#: Code points of the first block; each block after it is ``GROWTH`` times as long.
BLOCK, GROWTH = 512, 8
SALTS = 64
HASH_BITS = 64


def failures(text: Column) -> Column:
    """The bits 1, 2, 4 and 8 of the filters A to D."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    number, distinct = F.size(words), F.size(F.array_distinct(words))
    checks = [
        number < LEAST_WORDS,
        100 * distinct < 50 * number,
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    bits = [F.when(check, 1 << k).otherwise(0) for k, check in enumerate(checks)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def blocks(text: Column, bits: int = HASH_BITS) -> Column:
    """Hashes of the blocks of a text that it reaches into: one at least."""
    number = F.ceil(F.log(F.greatest(F.length(text), F.lit(1)) * (GROWTH - 1) / F.lit(float(BLOCK)) + 1) / F.log(F.lit(float(GROWTH))) - 1e-9)

    def one(k: Column) -> Column:
        before = (F.pow(F.lit(float(GROWTH)), k) - 1) / (GROWTH - 1) * BLOCK
        value = F.xxhash64(F.substring(text, (before + 1).cast("int"), (F.pow(F.lit(float(GROWTH)), k) * BLOCK).cast("int")))
        return value if bits >= 64 else F.pmod(value, F.lit(1 << bits))

    return F.transform(F.sequence(F.lit(0), F.greatest(number, F.lit(1)).cast("int") - 1), one)


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` another row has too."""
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    parts = rows.withColumn("salt", salt).groupBy(key, "salt").agg(F.count(F.lit(1)).alias("n"))
    common = parts.groupBy(key).agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).filter("n > 1").select(key, F.explode("salts").alias("salt"))
    return rows.withColumn("salt", salt).join(common, [key, "salt"], "left_semi").drop("salt")


def refined(rows: DataFrame, folder: str) -> DataFrame:
    """Rows (row, length, blocks, ...) that share their length and all block hashes with others, with ``class``."""
    named = rows.withColumn("class", F.xxhash64(F.lit(0).cast("long"), F.col("length").cast("long")))
    left = written(_shared(named, "class"), f"{folder}/length")
    done, k = left.limit(0), 0
    while not left.isEmpty():
        split = left.withColumn("class", F.xxhash64("class", F.element_at("blocks", k + 1)))
        left = written(_shared(split, "class"), f"{folder}/block{k}")
        k += 1
        ended = F.size("blocks") <= k  # rows of one class have as many blocks, as they have one length
        done, left = done.unionByName(left.filter(ended)), left.filter(~ended)
    return done


def class_of(text: Column, bits: int = HASH_BITS) -> Column:
    """The class that ``refined`` gives a text in the end."""
    return F.aggregate(blocks(text, bits), F.xxhash64(F.lit(0).cast("long"), F.length(text).cast("long")), lambda c, b: F.xxhash64(c, b))


def duplicates(docs: DataFrame, rows: DataFrame, folder: str, bits: int = HASH_BITS) -> DataFrame:
    """Rows of ``rows`` (row, doc_id, length, blocks, ...) that equal the text of a smaller id in ``docs`` (doc_id, text)."""
    alike = written(refined(rows, f"{folder}/refined"), f"{folder}/alike")
    classes = written(alike.select("class").distinct(), f"{folder}/classes")
    number = classes.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = texts.withColumn("class", class_of(F.col("text"), bits))
    if number > BROADCAST_ROWS:  # a hot class meets its one row under many salts
        salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["class", "salt"], "left_semi")
    else:
        met = own.join(F.broadcast(classes), "class", "left_semi")
    # the comparison in full: rows are grouped by the text itself, each task sending a text once
    least = met.groupBy("class", "text").agg(F.min("doc_id").alias("doc_id")).select("class", "doc_id").filter("doc_id IS NOT NULL").distinct()
    return alike.filter("doc_id IS NOT NULL").join(written(least, f"{folder}/least"), ["class", "doc_id"], "left_anti")


def _orders() -> tuple[list[str], list[int]]:
    names = ["".join(p) for p in permutations(FILTERS)]
    return names, [len(names) // n for n in range(1, len(FILTERS) + 1)]


def effects(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, from counts (part, mask, n, good, toxic).

    Of the orders, the filter of a mask with k filters stands before the other
    k - 1 in one of k: so it removes those documents in that share of them.
    """
    names, shares = _orders()
    masks = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    orders = masks.withColumn("filter_order", F.explode(F.split(F.lit(",".join(names)), ",")))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda at: F.shiftleft(F.lit(1), F.locate("x", F.translate(F.lit(FILTERS), "", ""), 1)) if at is None else F.pow(F.lit(2.0), F.instr(F.lit(FILTERS), at) - 1).cast("int")
    steps = steps.withColumn("own", bit(F.expr("substring(filter_order, step, 1)")))
    before = F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda a, k: a + F.when(k < F.col("step"), F.pow(F.lit(2.0), F.instr(F.lit(FILTERS), F.substring(F.col("filter_order"), k, F.lit(1))) - 1).cast("int")).otherwise(0))
    steps = steps.withColumn("before", before)

    def total(what: str, keep) -> Column:
        return F.aggregate(F.filter("masks", keep), F.lit(0).cast("long"), lambda a, m: a + m[what])

    fails = lambda m: m["mask"].bitwiseAND(F.col("own")) > 0
    gone = lambda m: m["mask"].bitwiseAND(F.col("before")) > 0
    here = lambda m: fails(m) & ~gone(m)
    share = F.array(*[F.lit(s) for s in shares])
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m["mask"] == F.col("own")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        F.aggregate(F.filter("masks", fails), F.lit(0).cast("long"), lambda a, m: a + m["n"] * F.element_at(share, F.bit_count(m["mask"]))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, folder: str, bits: int = HASH_BITS) -> DataFrame:
    """The interaction of the five filters over ``docs`` (doc_id, text, lang), with ``labels`` (doc_id, quality, toxic)."""
    docs = from_files(docs.select("doc_id", "text", "lang"), f"{folder}/input")
    text = F.coalesce("text", F.lit(""))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
    )
    seen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), failures(text).alias("mask"),
        F.length(text).alias("length"), blocks(text, bits).alias("blocks"), F.monotonically_increasing_id().alias("row"),
    )
    rows = written(seen, f"{folder}/seen")
    rows = written(rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"]), f"{folder}/rows")
    failing = written(duplicates(docs, rows, folder, bits), f"{folder}/duplicates")
    keys = ["part", "mask"]
    sums = lambda df, sign: df.groupBy(*keys).agg(*[(F.sum(c) * sign).cast("long").alias(c) for c in ("n", "good", "toxic")])
    one = lambda df: df.select(*keys, F.lit(1).alias("n"), "good", "toxic")
    # a duplicate moves from the number of its mask to that of the mask with E
    moved = sums(one(failing), -1).unionByName(sums(one(failing), 1).withColumn("mask", F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E")))))
    return effects(sums(sums(one(rows), 1).unionByName(moved), 1))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), shared_folder(spark))


_PERMUTED = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
ORACLE_SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), counted AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM texts
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         {{'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
           'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
           'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)}} AS f
  FROM counted LEFT JOIN marks USING (doc_id)
), masks AS (
  SELECT part, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END)
         || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM failed GROUP BY ALL
), orders(filter_order) AS (VALUES {_PERMUTED}),
steps AS (
  SELECT filter_order, step, filter_order[step] AS own, '[' || filter_order[1:step - 1] || '0]' AS before FROM orders, generate_series(1, 5) AS s(step)
), results AS (
  SELECT part, filter_order, step, own,
         sum(n) FILTER (NOT contains(fails, own) AND NOT regexp_matches(fails, before)) AS kept,
         sum(n) FILTER (contains(fails, own) AND NOT regexp_matches(fails, before)) AS removed,
         sum(n) FILTER (contains(fails, own) AND regexp_matches(fails, before)) AS redundant,
         sum(n) FILTER (fails = own) AS unique_fails,
         sum(good) FILTER (contains(fails, own) AND NOT regexp_matches(fails, before)) AS good_lost,
         sum(toxic) FILTER (contains(fails, own) AND NOT regexp_matches(fails, before)) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM results
"""
