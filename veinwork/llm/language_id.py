"""Language identification by prediction by partial matching.

Each language has a context tree over bytes of order three: a context counts
the bytes that followed it, a byte it has not seen costs an escape (method C,
with exclusion) and is then predicted by the next shorter context, down to a
uniform distribution over all byte values.  The statistics are frozen after
training.  Because they are frozen, the exact code length of every byte after
every context is tabulated once, and a text is scored by looking up the
longest context that any language has seen at each of its bytes.

Training takes a bounded sample of labelled texts: for each language the
``docs_per_language`` labelled training documents of at most ``max_text``
characters with the smallest hash of their id.  Every text is predicted whole.

Defined results: a null text, or one without a letter, is ``und`` with score
0; ties go to the language first in order; rows with a null id or label are
predicted but not learned from; without any training row all are ``und``; an
empty table gives no rows.  Label, source and id are not inputs of a
prediction, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinwork.llm.textbatch import runs, texts
from veinwork.llm.workspace import released, rested, small_batches

DOCS_PER_LANGUAGE = 300
MAX_TEXT = 1 << 16
ORDER = 3
UNKNOWN = "und"
#: Bits a byte from which on a text is in none of the languages: its code is no shorter than its bytes.
FOREIGN_BITS = 8.0


class ContextTrees:
    """Code lengths of ``languages`` under their frozen context trees."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        joined = {k: np.frombuffer(b"\n\n\n" + b"\n\n\n".join(v), np.uint8) for k, v in samples.items()}
        seen = np.unique(np.concatenate([np.unique(x) for x in joined.values()]))
        # symbol 0 stands for all bytes that no sample holds
        self.symbol = np.zeros(256, np.int32)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        size = len(seen) + 1
        self.bits = max(1, (size - 1).bit_length())
        self.size = size
        rare = max(1, 256 - len(seen))
        uniform = np.full(size, 1 / 256)
        streams = {k: self.symbol[x].astype(np.int64) for k, x in joined.items()}
        nodes = {0: np.zeros(1, np.int64)}
        for order in range(1, ORDER + 1):
            nodes[order] = np.unique(np.concatenate([np.unique(self._context(s, order)) for s in streams.values()]))
        count = sum(len(x) for x in nodes.values())
        first = np.cumsum([0] + [len(nodes[o]) for o in range(ORDER)])
        table = np.zeros((count, size, len(self.languages)), np.float32)
        for j, name in enumerate(self.languages):
            below = uniform[None, :]
            weights = np.ones(size)
            weights[0] = rare
            for order in range(ORDER + 1):
                parent = np.zeros(len(nodes[order]), np.int64)
                if order > 1:
                    parent = np.searchsorted(nodes[order - 1], nodes[order] & ((1 << self.bits * (order - 1)) - 1))
                below = self._predict(streams[name], order, nodes[order], below[parent], weights)
                table[first[order] : first[order] + len(below), :, j] = -np.log2(below)
        self.table = table.reshape(count * size, len(self.languages))
        # the longest known suffix of every possible context
        longest = np.zeros(1 << self.bits * ORDER, np.int32)
        every = np.arange(len(longest))
        for order in range(1, ORDER + 1):
            short = every & ((1 << self.bits * order) - 1)
            at = np.minimum(np.searchsorted(nodes[order], short), len(nodes[order]) - 1)
            hit = nodes[order][at] == short
            longest[hit] = first[order] + at[hit]
        self.longest = longest

    def _context(self, stream: np.ndarray, order: int) -> np.ndarray:
        """Context before each position from ORDER on."""
        key = np.zeros(len(stream) - ORDER, np.int64)
        for back in range(order, 0, -1):
            key = key << self.bits | stream[ORDER - back : len(stream) - back]
        return key

    def _predict(self, stream: np.ndarray, order: int, nodes: np.ndarray, below: np.ndarray, weights: np.ndarray) -> np.ndarray:
        node = np.searchsorted(nodes, self._context(stream, order))
        counts = np.bincount(node * self.size + stream[ORDER:], minlength=len(nodes) * self.size).reshape(len(nodes), self.size).astype(float)
        total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        unseen = counts == 0
        left = (below * weights * unseen).sum(1, keepdims=True)
        here = np.where(
            unseen,
            kinds / np.maximum(total + kinds, 1) * below / np.maximum(left, 1e-12),
            counts / np.maximum(total + kinds, 1) / weights,
        )
        return np.maximum(np.where(total > 0, here, below), 1e-12)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each document of a run in each language."""
        docs = len(offsets) - 1
        out = np.zeros((docs, len(self.languages)))
        if not len(data):
            return out
        symbol = self.symbol[data]
        newline = self.symbol[10]
        key = np.zeros(len(data), np.int32)
        starts = offsets[:-1][np.diff(offsets) > 0]
        previous = symbol
        for back in range(1, ORDER + 1):
            shifted = np.empty_like(previous)
            shifted[1:] = previous[:-1]
            shifted[starts] = newline
            key |= shifted << (self.bits * (back - 1))
            previous = shifted
        row = self.longest[key] * self.size + symbol
        for j in range(len(self.languages)):
            total = np.concatenate([[0.0], np.cumsum(self.table[:, j][row], dtype=np.float64)])
            out[:, j] = total[offsets[1:]] - total[offsets[:-1]]
        return out


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def sample(docs: DataFrame, docs_per_language: int, max_text: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[bytes]]:
    """Labelled training texts: at most docs_per_language * max_text characters a language, or one text.

    Texts of up to max_text characters come in a hashed order; where a language
    has too few, longer ones follow, the shortest first and whole.
    """
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("doc_id"), 4) != 2) & (F.length("text") > 0)
    )
    size = F.length("text").cast("long")
    order = ["long", "spread", "doc_id"]
    spread = labelled.select("lang", "text", F.when(size > max_text, size).otherwise(F.lit(0).cast("long")).alias("long"), F.xxhash64(F.col("doc_id").cast("string")).alias("spread"), "doc_id", size.alias("size"))
    of = Window.partitionBy("lang").orderBy(*order)
    ranked = spread.select("lang", *order, "size").withColumn("rank", F.row_number().over(of)).filter(F.col("rank") <= docs_per_language)
    held = ranked.withColumn("held", F.sum("size").over(of.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = held.filter((F.col("held") <= docs_per_language * max_text) | (F.col("rank") == 1))
    wanted = F.lit(False)
    for r in chosen.groupBy("lang").agg(F.max(F.struct("long", "spread")).alias("top")).collect():
        within = (F.col("long") < r["top"]["long"]) | ((F.col("long") == r["top"]["long"]) & (F.col("spread") <= r["top"]["spread"]))
        wanted = wanted | ((F.col("lang") == r["lang"]) & within)
    found: dict[str, list[bytes]] = {}
    for row in spread.filter(wanted).orderBy(*order).select("lang", "text").toLocalIterator():
        texts_of = found.setdefault(row["lang"], [])
        if len(texts_of) < docs_per_language:
            texts_of.append(row["text"].encode())
    return found


_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def identify(docs: DataFrame, trees: ContextTrees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior of the predicted language) and bits_per_byte of every row."""
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (remainder(F.col(id_col), 4) == 2).alias("held_out"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        F.col(text_col).cast("string").alias("text"),
    )
    if trees is None:
        return source.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(8.0).alias("bits_per_byte"))
    sent = spark.sparkContext.broadcast(trees)  # bounded by the alphabet, the order and the sample

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            data, offsets = texts(batch.column(3))
            bits = np.zeros((len(offsets) - 1, len(model.languages)))
            for lo, hi in runs(offsets):
                bits[lo:hi] = model.code_lengths(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            best = bits.argmin(1)
            least = bits.min(1)
            score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            lettered = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(lettered, best, len(model.languages))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(least / np.maximum(np.diff(offsets), 1))],
                ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
            )

    return source.mapInArrow(rows, _SCHEMA)


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, max_text: int = MAX_TEXT, **columns: str) -> ContextTrees | None:
    """Trees of the labelled training texts; ``columns`` names id_col, text_col and lang_col where they are other."""
    found = sample(docs, docs_per_language, max_text, **columns)
    return ContextTrees(found) if found else None


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))


def known(docs: DataFrame, trees: ContextTrees | None, text_col: str = "text", limit: float = FOREIGN_BITS) -> DataFrame:
    """Rows with letters whose shortest code is below ``limit`` bits a byte, with all their columns and no exchange."""
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if trees is None:
        return docs.filter("false")
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            data, offsets = texts(batch.column(at))
            least = np.zeros(len(offsets) - 1)
            for lo, hi in runs(offsets):
                least[lo:hi] = model.code_lengths(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).min(1)
            yield batch.filter(pa.array(least < limit * np.diff(offsets)))
        # the worker goes on to other stages: the next task reads the trees again
        del model
        sent.__dict__.pop("_value", None)
        released()

    return docs.filter(lettered).mapInArrow(rows, docs.schema)


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without letters, or in none of the learned languages, go."""
    rested(spark)
    small_batches(spark)
    return known(docs, train(docs))
