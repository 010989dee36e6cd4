"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

Each source has a target of words.  Of all rates of its documents between 0
and ``MOST`` that meet the target, those nearest to 1 in relative entropy are
``min(MOST, exp(a * size))``, with one ``a`` a source: the solution of a convex
dual, which Newton iterations find for all sources at once, each iteration one
aggregation over the histogram (source, size, number).  Rates become copies in
classes of documents of one source and size: the expected copies of a class
are rounded by a hash, and what a source is then off its words is given to
classes with room for it, or taken back.

Defined results: a null or empty text has size 0, and is taken with 0 words;
a null source is a source, after all others; sources without words have
target 0; repeated rows are documents of their own; long texts count whole;
documents of one class are ranked by a hash of their id, so that reruns
agree (rows of one id, source and size are alike in all that is returned);
an empty table gives no rows.  Only id, text and source are read, so other
columns may have any name.

Nothing is bound to one task: a source's histogram has one row a size; a class
is dealt out by the hash of the id in ``SALTS`` parts, each ranked apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinwork.llm.ranks import ranked_strings
from veinwork.llm.workspace import BROADCAST_ROWS, shared_folder, written

#: Weights of sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Copies that a document is taken at most.
MOST = 3
SALTS = 256
#: Relative error of a source's words before rounding, and Newton or bisection steps at most (each halves the bracket at least).
CLOSE, STEPS = 1e-6, 80
#: Rounds after the first rounding: shares of what classes have room for, and one copy a class in a hashed order.
FILLS = ("share", "next", "share", "next", "next")
#: A class whose documents are longer than a target divided by this is rounded to the nearest number: others could not make up for it.
LONG = 200

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _near(rows: DataFrame, few: DataFrame, number: int, on: str | list[str]) -> DataFrame:
    """A join with a table of one row a source, broadcast while those are at most ``BROADCAST_ROWS``."""
    return rows.join(F.broadcast(few) if number <= BROADCAST_ROWS else few, on)


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sources (name, rank, source_size) with ``target``: weights share all words, a target ends at ``most`` times its source's, and the excess is shared again.

    With ``share`` words a weight, targets are min(most * size, share * weight);
    the share grows until no further source is above its end.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = sources.withColumn("weight", weight).withColumn("end", F.col("source_size") * most)
    share = 0.0
    while True:
        full = F.col("end") <= F.col("weight") * F.lit(share)
        now = weighted.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("end"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        grown = ((now["all"] or 0) - (now["full"] or 0)) / now["open"] if now["open"] else share
        if grown <= share:
            break
        share = grown
    return weighted.withColumn("target", F.least(F.col("end").cast("double"), F.col("weight") * F.lit(share))).select("name", "source_size", "target")


def tilted(histogram: DataFrame, sources: DataFrame, most: int, folder: str, number: int) -> DataFrame:
    """sources (name, source_size, target) with ``a`` and ``scale``: the rate of a document is min(most, exp(a * size / scale)).

    Where the target is all that a source can give, ``a`` is infinite.  Newton's
    step is taken on the logarithm of the words, and bisection where it leaves
    the bracket: rates at its ends are too low and too high for every document.
    """
    shape = histogram.filter("size > 0").groupBy("name").agg(F.min("size").alias("least"), (F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("scale"))
    full = F.col("target") >= F.col("source_size") * most
    unit = F.col("least") / F.col("scale")
    state = sources.join(shape, "name", "left").withColumns({
        "done": F.coalesce(full | (F.col("target") <= 0), F.lit(True)),
        "low": F.least(F.lit(0.0), F.log(F.try_divide("target", "source_size")) / unit),
        "high": F.lit(math.log(most)) / unit,
        "a": F.when(full, F.lit(math.inf)).otherwise(F.lit(0.0)),
    }).drop("least")
    state = written(state, f"{folder}/0")
    for step in range(1, STEPS + 1):
        open_ = state.filter("NOT done")
        met = _near(histogram.filter("size > 0"), open_.select("name", "a", "scale"), number, "name")
        rate = F.exp(F.least(F.col("a") * F.col("size") / F.col("scale"), F.lit(math.log(most))))
        mass = F.col("n") * F.col("size") * rate
        free = F.col("a") * F.col("size") / F.col("scale") < math.log(most)
        sums = met.groupBy("name").agg(F.sum(mass).alias("now"), F.sum(F.when(free, mass * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"))
        off = F.log(F.col("now") / F.col("target"))
        moved = F.col("a") - off * F.try_divide("now", "slope")
        stepped = (
            state.join(sums, "name", "left")
            .withColumn("close", F.col("done") | (F.abs(off) <= CLOSE))
            .withColumn("low", F.when(~F.col("done") & (off < 0), F.col("a")).otherwise(F.col("low")))
            .withColumn("high", F.when(~F.col("done") & (off > 0), F.col("a")).otherwise(F.col("high")))
            .withColumn("a", F.when(F.col("close"), F.col("a")).when((moved > F.col("low")) & (moved < F.col("high")), moved).otherwise((F.col("low") + F.col("high")) / 2))
            .withColumn("done", F.col("close"))
            .select(*state.columns)
        )
        state = written(stepped, f"{folder}/{step}")
        if state.filter("NOT done").isEmpty():
            break
    return state.select("name", "source_size", "target", "a", "scale")


def copies(histogram: DataFrame, sources: DataFrame, most: int, folder: str) -> DataFrame:
    """name, size, n, copies: how many copies the documents of a class have together.

    The expected number is rounded up with the chance of its fraction, by the
    hash of the class.  Words that this leaves missing, or too many, are given
    to classes with room for them, or taken back, in the rounds of ``FILLS``:
    none goes past the target.
    """
    expected = F.col("n") * F.exp(F.least(F.col("a") * F.col("size") / F.col("scale"), F.lit(math.log(most))))
    expected = F.when(F.col("a") == math.inf, (F.col("n") * most).cast("double")).otherwise(F.least(expected, (F.col("n") * most).cast("double")))
    uniform = F.pmod(F.xxhash64("name", "size"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    classes = histogram.join(sources.select("name", "target", "a", "scale"), "name").withColumn("size0", F.col("size") == 0)
    classes = classes.withColumn("expected", F.when(F.col("size0") | (F.col("target") <= 0), F.lit(0.0)).otherwise(expected)).withColumn("order", uniform).withColumn("given", F.lit(False))
    chance = F.when(F.col("size") * LONG > F.col("target"), F.lit(0.5)).otherwise(F.col("order"))
    classes = classes.withColumn("copies", F.least(F.floor(F.col("expected") + chance), F.ceil("expected")).cast("long"))
    classes = written(classes.select("name", "size", "n", "target", "copies", "order", "given"), f"{folder}/floors")
    for k, fill in enumerate(FILLS):
        has = classes.groupBy("name").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        left = F.abs("gap")
        room = F.when((F.col("size") == 0) | (F.col("size") > left), F.lit(0)).when(F.col("gap") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        if fill == "share":
            share = F.try_divide(left, F.sum(room * F.col("size")).over(Window.partitionBy("name")))
            more = F.coalesce(F.least(room, F.floor(room * share)), F.lit(0))
            given = F.lit(False)
        else:
            open_ = ~F.col("given") & (room > 0)
            upto = F.sum(F.when(open_, F.col("size")).otherwise(0)).over(Window.partitionBy("name").orderBy(F.col("order"), "size"))
            more = (open_ & (upto <= left)).cast("long")
            given = F.col("given") | (F.col("more") > 0)
        grown = classes.join(has, "name").withColumn("more", more).withColumn("given", given).withColumn("copies", (F.col("copies") + F.signum("gap") * F.col("more")).cast("long"))
        classes = written(grown.select("name", "size", "n", "target", "copies", "order", "given"), f"{folder}/fill{k}")
    return classes.select("name", "size", "n", "copies")


def mixed(docs: DataFrame, folder: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: one row a document."""
    name = F.when(F.col("source").isNull(), "t").otherwise(F.concat(F.lit("s"), F.col("source")))  # null sorts last
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(12)), F.lit(SALTS)).cast("int")
    rows = written(docs.select(F.col("doc_id").alias("doc_id"), name.alias("name"), words(F.col("text")).alias("size"), part.alias("part")), f"{folder}/sizes")
    parts = written(rows.groupBy("name", "size", "part").agg(F.count(F.lit(1)).alias("here")), f"{folder}/parts")
    histogram = written(parts.groupBy("name", "size").agg(F.sum("here").alias("n")), f"{folder}/histogram")
    sizes = histogram.groupBy("name").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranked = written(ranked_strings(sizes, "name", f"{folder}/ranges"), f"{folder}/sources")
    number = ranked.count()
    sources = tilted(histogram, written(targets(ranked, weights, most), f"{folder}/targets"), most, f"{folder}/newton", number)
    decided = copies(histogram, sources, most, f"{folder}/copies")
    # the copies of a class over its parts: all documents have what is whole, and the first parts one more
    earlier = Window.partitionBy("name", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.col("copies") - F.col("each") * F.col("n") - F.coalesce(F.sum("here").over(earlier), F.lit(0))
    dealt = (
        parts.join(decided, ["name", "size"])
        .withColumn("each", F.expr("copies div n"))
        .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("here"), extra)))
        .select("name", "size", "part", "each", "extra")
    )
    place = F.row_number().over(Window.partitionBy("name", "size", "part").orderBy(F.xxhash64(F.col("doc_id"), F.lit(13)), "doc_id"))
    placed = rows.withColumn("place", place).join(dealt, ["name", "size", "part"])
    out = _near(placed, sources.select("name", "source_size", "target"), number, "name")
    number_of = F.col("each") + (F.col("place") <= F.col("extra")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", number_of.alias("copies"), (number_of * F.col("size")).alias("taken"))


def op12_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)).drop("copies")
