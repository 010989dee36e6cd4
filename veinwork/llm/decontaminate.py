"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Each benchmark item gets windows sized from it: the ladder's largest length up
to the item's, and the largest up to its half, each taken at its start and at
its end, and windows of about three quarters of the stretch that no passage of
similarity 0.8 can do without (``unedited``), so close to each other that
every such stretch holds one whole.  Every window of those lengths in every document gets a 64-bit
SimHash over its lower-cased words, from packed running sums.  Of the
four 16-bit blocks of a fingerprint at least one is equal when two
fingerprints differ in at most ``RADIUS`` = 3 bits, so four tables find all
fingerprints within the radius, comparing those of an equal block only.  For each candidate the stretch of the
document around the window with the highest exact multiset Jaccard of
five-word shingles (weights: occurrences) is taken, of all lengths that can
reach 0.8.

Items shorter than a shingle are found by a hash of their words at every
place of a document.  Items come to the executors in blocks of ``ITEM_WORDS`` words,
one pass over the documents a block.

Defined results: null and empty texts contain nothing and null or empty items
are in nothing; several items of equal text are each reported; a document with
an item twice gives its best match once, of equally good stretches one that
begins first; very long texts are searched whole, in runs of one text; repeated rows each give their rows;
empty tables give no rows.  Only ids and texts are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.llm.textbatch import SHINGLE, _STEP, mix, ragged, runs, texts, word_hashes
from veinwork.llm.workspace import rested, small_batches, sparing

RADIUS = 3
SIMILARITY = 0.8
ITEM_WORDS = 1_000_000
#: Window lengths, a quarter apart; an item beyond the last has windows of its parts.
LADDER = [5, 6, 7, 9, 11, 14, 17, 21, 26, 33, 41, 51, 64, 80, *(int(100 * 1.25**k) for k in range(26))]

#: Lanes of 8 bits count up to 127 words, lanes of 16 bits up to 32,767.
_LANES = {8: 127, 16: 32767}


class Sums:
    """Running counts of every hash bit, eight counts of 8 bits or four of 16 to a 64-bit word."""

    def __init__(self, words: np.ndarray):
        self.words, self.lanes = words, {}

    def _counts(self, bits: int) -> list[np.ndarray]:
        if bits not in self.lanes:
            each = 64 // bits
            spread = np.array([sum(1 << bits * j for j in range(each) if b >> j & 1) for b in range(1 << each)], np.uint64)
            self.lanes[bits] = []
            for k in range(bits):
                total = np.zeros(len(self.words) + 1, np.uint64)
                np.cumsum(spread[(self.words >> np.uint64(each * k) & np.uint64((1 << each) - 1)).astype(np.int64)], out=total[1:])
                self.lanes[bits].append(total)
        return self.lanes[bits]

    def fingerprints(self, width: int) -> np.ndarray:
        """SimHash of every window of ``width`` words: a bit is set if most words have it."""
        bits = 8 if width <= _LANES[8] else 16
        ones = sum(1 << bits * j for j in range(64 // bits))
        lift, high = np.uint64((_LANES[bits] - width // 2) * ones), np.uint64((_LANES[bits] + 1) * ones)
        out = None
        for k, total in enumerate(self._counts(bits)):
            count = total[width:] - total[:-width]
            count += lift
            count &= high
            count >>= np.uint64(bits - 1 - k)
            out = count if out is None else np.bitwise_or(out, count, out=out)
        return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` words at every place that has as many; none of fewer."""
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        total += words[k : k + len(total)] * _STEP[k + 1]
    return mix(total)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of at least ``SHINGLE`` words; none of fewer."""
    return gram_hashes(words, SHINGLE)


def unedited(n: int) -> int:
    """Words in a row that any passage of ``SIMILARITY`` leaves of an item of ``n`` words whose shingles differ.

    An edit within the item, of however few words, costs the shingles across
    it on one side or both: an insertion takes 4 of the item's and adds 5, a
    removal takes 4 and one a word and adds 4.  Against the similarity that is
    at least 7.2 of the item's shingles, and 0.8 or 1 more for each word put in
    or taken; words gone from the ends cost one each.
    """
    spare = (1 - SIMILARITY) * (n - SHINGLE + 1) + 1e-9
    edit = (SHINGLE - 1) * (1 + SIMILARITY)
    return min(-(-(n - int(spare - edit * k)) // (k + 1)) for k in range(int(spare / (edit + SIMILARITY)) + 1))


class Items:
    """Fingerprints and block tables of a block of items."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids, self.words, self.bags = [], [], []
        short: dict[int, list[tuple[int, int]]] = {}
        anchors: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = word_hashes(raw, np.array([0, len(raw)]))[0]
            n = len(words)
            if not n:
                continue
            at = len(self.ids)
            self.ids.append(item_id)
            self.words.append(words)
            self.bags.append(Counter(shingle_hashes(words).tolist()))
            if n < SHINGLE:
                short.setdefault(n, []).append((int(gram_hashes(words, n)[0]), at))
                continue
            sums = Sums(words)
            stretch = unedited(n)
            dense = max(x for x in LADDER if x <= max(stretch * 3 // 4, LADDER[0]))
            entered = {(dense, offset) for offset in range(0, n - dense + 1, stretch - dense + 1)}
            for width in {max(x for x in LADDER if x <= n), max(x for x in LADDER if x <= max(n // 2, LADDER[0]))}:
                entered |= {(width, 0), (width, n - width)}
            prints = {width: sums.fingerprints(width) for width in {w for w, _ in entered}}
            for width, offset in sorted(entered):
                anchors.setdefault(width, []).append((int(prints[width][offset]), at))
        # for each length: hashes in order, and their items
        self.short = {n: (np.array([h for h, _ in sorted(kept)], np.uint64), [at for _, at in sorted(kept)]) for n, kept in short.items()}
        self.classes = {}
        for width, kept in anchors.items():
            prints = np.array([x[0] for x in kept], np.uint64)
            # for each 16-bit block: prints in its order, and where those of each value begin
            blocks = prints.view(np.uint16).reshape(-1, 4)
            orders = [np.argsort(blocks[:, k], kind="stable") for k in range(4)]
            starts = [np.searchsorted(blocks[orders[k], k], np.arange((1 << 16) + 1)).astype(np.int32) for k in range(4)]
            self.classes[width] = (prints, orders, starts, np.array([x[1] for x in kept], np.int64))

    @staticmethod
    def near(found: np.ndarray, prints: np.ndarray, orders: list[np.ndarray], starts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of ``found`` and of ``prints`` that are within ``RADIUS`` bits: only prints with an equal block are compared."""
        blocks = found.view(np.uint16).reshape(-1, 4)
        for k in range(4):
            begin = starts[k][blocks[:, k]].astype(np.int64)
            number = starts[k][1:][blocks[:, k]] - begin
            where = np.flatnonzero(number)
            reach = np.cumsum(number[where])
            lo = 0
            while lo < len(where):  # about a million comparisons at a time
                hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + (1 << 20), "right")))
                part = where[lo:hi]
                at, which = np.repeat(part, number[part]), orders[k][ragged(begin[part], number[part])]
                close = np.bitwise_count(found[at] ^ prints[which]) <= RADIUS
                yield at[close], which[close]
                lo = hi

    def search(self, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(document, item, similarity, first word, words) of the best match of each pair in a run of documents."""
        ends = np.cumsum(counts)
        begins = ends - counts
        yield from self.short_hits(words, begins, ends)
        if not len(words) or not self.classes:
            return
        sums, best = Sums(words), {}
        for width, (prints, orders, starts, anchors) in self.classes.items():
            if len(words) < width:
                continue
            for at, which in self.near(sums.fingerprints(width), prints, orders, starts):
                doc = np.searchsorted(ends, at, "right")
                inside = at + width <= ends[doc]
                for position, d, item in zip(at[inside].tolist(), doc[inside].tolist(), anchors[which[inside]].tolist()):
                    best.setdefault((d, item), set()).add((position, width))
        for (d, item), held in best.items():
            similar, first, length = self.aligned(item, words[begins[d] : ends[d]], sorted((at - int(begins[d]), width) for at, width in held))
            if similar >= SIMILARITY:
                yield d, item, similar, first, length

    def short_hits(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """The first place of each short item in each document."""
        for n, (prints, items) in self.short.items():
            found = gram_hashes(words, n)
            lo, hi = np.searchsorted(prints, found, "left"), np.searchsorted(prints, found, "right")
            at = np.flatnonzero(hi > lo)
            doc = np.searchsorted(ends, at, "right")
            inside = at + n <= ends[doc]
            seen = set()
            for place, d in zip(at[inside].tolist(), doc[inside].tolist()):
                for k in range(int(lo[place]), int(hi[place])):
                    if (d, k) not in seen:
                        seen.add((d, k))
                        yield d, items[k], 1.0, place - int(begins[d]), n

    def aligned(self, item: int, words: np.ndarray, held: list[tuple[int, int]]) -> tuple[float, int, int]:
        """(similarity, first word, words) of the best stretch around the windows (start, words) of a document.

        A shingle adds to the stretches that begin after its occurrence that
        many places back as the item has of it, so the shared shingles of all
        ends of one beginning are a running sum.  A best stretch begins and
        ends with a shared shingle.
        """
        own = self.bags[item]
        size = sum(own.values())
        most, need = int(size / SIMILARITY + 1e-9), SIMILARITY * size - 1e-9
        longest = most + SHINGLE - 1
        regions: list[list[int]] = []
        for start, width in held:
            lo, hi = max(0, start + width - longest), min(len(words), start + longest)
            if regions and lo <= regions[-1][1]:
                regions[-1][1] = max(hi, regions[-1][1])
            else:
                regions.append([lo, hi])
        top = (0.0, 0, 0)
        for lo, hi in regions:
            found = shingle_hashes(words[lo:hi]).tolist()
            after = np.full(len(found) + most, len(found), np.int64)  # beginnings before this place do without the shingle
            places: dict[int, list[int]] = {}
            for k, h in enumerate(found):
                if h in own:
                    seen = places.setdefault(h, [])
                    after[k] = seen[-own[h]] + 1 if len(seen) >= own[h] else 0
                    seen.append(k)
            known = np.concatenate([[0], np.cumsum(after < len(found))])
            begins = np.flatnonzero(after[: len(found)] < len(found))
            begins = begins[known[begins + most] - known[begins] >= need]
            rows = max(1, (1 << 20) // most)
            for k in range(0, len(begins), rows):
                part = begins[k : k + rows, None]
                shared = np.cumsum(after[part + np.arange(most)] <= part, axis=1)
                value = shared / (size + np.arange(1, most + 1) - shared)
                best = value.max(1)
                at = int(best.argmax())
                end = most - 1 - int(value[at, ::-1].argmax())
                top = max(top, (float(best[at]), -(lo + int(part[at, 0])), end + SHINGLE))
        return top[0], -top[1], top[2]


_SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_words: int = ITEM_WORDS) -> DataFrame:
    """Each document that holds a benchmark item, with the item: doc_id, item_id, similarity, first_word, n_words."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def searched(rows: list[tuple[int, str | None]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(Items(rows))

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                data, offsets = texts(batch.column(1))
                for lo, hi in runs(offsets):
                    words, counts = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    hits = list(items.search(words, counts))
                    if hits:
                        docs_of = batch.column(0).take(pa.array([lo + h[0] for h in hits]))
                        rest = [[items.ids[h[1]] for h in hits], [h[2] for h in hits], [h[3] for h in hits], [h[4] for h in hits]]
                        kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([docs_of, *[pa.array(x, k) for x, k in zip(rest, kinds)]], [x.split()[0] for x in _SCHEMA.split(", ")])

        return source.mapInArrow(found, _SCHEMA)

    out = [searched(block) for block in item_blocks(benchmark, item_words)]
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def item_blocks(benchmark: DataFrame, item_words: int) -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of about ``item_words`` words; one empty block if there is none."""
    block, held, some = [], 0, False
    for row in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        held += len((row["text"] or "").split())
        if held >= item_words:
            yield block
            block, held, some = [], 0, True
    if block or not some:
        yield block


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_words: int = ITEM_WORDS) -> DataFrame:
    """Rows that hold no item, with all their columns and no exchange: one filter for each block of items."""
    at, schema = docs.columns.index(text_col), docs.schema

    def kept(sent: object):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = texts(batch.column(at))
                for lo, hi in runs(offsets):
                    words, counts = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    keep = np.ones(hi - lo, bool)
                    keep[[h[0] for h in sent.value.search(words, counts)]] = False
                    yield batch.slice(lo, hi - lo).filter(pa.array(keep))

        return sparing(rows)

    for block in item_blocks(benchmark, item_words):
        docs = docs.mapInArrow(kept(docs.sparkSession.sparkContext.broadcast(Items(block))), schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    rested(spark)
    small_batches(spark)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
