"""Token ids in directly addressable codes.

Ids are cut in levels of eight bits.  Level 0 holds the low chunk of every id;
a continuation bitmap tells which ids go on in the next level, and a rank
directory (set bits before each block of 512) turns a position of one level
into the position in the next, so any token is read from a few bytes without
decoding what stands before it.

The file is a Parquet table with one row per shard of consecutive documents:
part, shard, local_start (ids of the part before this shard), n_ids, and the
binary columns doc_ids and counts (little-endian 64-bit) and codes.  Parts
follow each other in ascending doc_id, shards in the order of local_start.

Defined results: ids are those of the library as its file sets it up, so the
text of an added token is that token; null and empty texts hold the end id alone; null ids come
first and repeated rows stay, next to each other; a document larger than a
shard makes a shard of its own; an empty table gives an empty file and no rows.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.llm.pieces import PieceCache, split
from veinwork.llm.textbatch import runs, texts
from veinwork.llm.workspace import shared_folder

_BLOCK = 512
SHARD_IDS = 1 << 20
END_ID = 0


def pack(ids: np.ndarray) -> bytes:
    """Codes of a sequence of ids below 2**32."""
    rest, parts = np.asarray(ids, np.uint32), []
    while True:
        parts.append((rest & np.uint32(0xFF)).astype(np.uint8).tobytes())
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(rest) // _BLOCK) * _BLOCK, bool)
        padded[: len(rest)] = more
        ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, _BLOCK).sum(1))]).astype("<u4")
        parts += [bits.tobytes(), ranks.tobytes()]
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    return struct.pack("<I", len(parts)) + b"".join(struct.pack("<Q", len(p)) for p in parts) + b"".join(parts)


class Codes:
    """Random and sequential access to packed ids."""

    def __init__(self, raw: bytes):
        (count,) = struct.unpack_from("<I", raw)
        sizes = struct.unpack_from(f"<{count}Q", raw, 4)
        at, parts = 4 + 8 * count, []
        for k, size in enumerate(sizes):
            parts.append(np.frombuffer(raw, "<u4" if k % 3 == 2 else np.uint8, size // (4 if k % 3 == 2 else 1), at))
            at += size
        self.levels = [tuple(parts[k : k + 3]) for k in range(0, count, 3)]

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def get(self, i: int) -> int:
        """The id at position ``i``: one chunk, one bit and one rank a level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // _BLOCK
            head = bits[block * _BLOCK // 8 : i >> 3]
            tail = int(bits[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[block]) + int(np.bitwise_count(head).sum()) + tail.bit_count()
            shift += 8
        return value

    def all(self) -> np.ndarray:
        out, at = np.zeros(len(self), np.uint32), np.arange(len(self))
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            at = at[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)]
        return out


class LibraryEncoder:
    """Ids of texts by the tokenizers library, each distinct piece passed to it once.

    Texts that hold an added token, such as the end of a text spelt out, are
    passed to it whole: it takes those tokens out before it cuts pieces.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.cache = PieceCache(self._pieces)

    def _pieces(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        lengths = np.array([len(x) for x in found], np.int64)
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, counts = split(data, offsets)
        ids, each = self.cache.ids(data, starts, ends)
        total = np.concatenate([[0], np.cumsum(each)])
        n = np.diff(total[np.concatenate([[0], np.cumsum(counts)])])
        raw, done, parts = data.tobytes(), 0, []
        last = np.cumsum(n)
        for d in self._with_added(raw, offsets):
            own = self.library.encode(raw[offsets[d] : offsets[d + 1]].decode(), add_special_tokens=False).ids
            parts += [ids[done : last[d] - n[d]], np.array(own, np.uint32)]
            done, n[d] = last[d], len(own)
        return (np.concatenate([*parts, ids[done:]]) if parts else ids), n

    def _with_added(self, raw: bytes, offsets: np.ndarray) -> list[int]:
        """Texts that hold an added token."""
        out = set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                d = int(np.searchsorted(offsets, at, "right")) - 1
                inside = at + len(token) <= offsets[d + 1]
                if inside:
                    out.add(d)
                at = raw.find(token, int(offsets[d + 1]) if inside else at + 1)
        return sorted(out)


@functools.lru_cache(2)
def _library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


_FILE_SCHEMA = "part int, shard int, local_start long, n_ids long, doc_ids binary, counts binary, codes binary"
_MISSING = -(2**63)


def _shards(path: str, shard_ids: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _library(path), TaskContext.get().partitionId()
        state = {"shard": 0, "start": 0}
        docs: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            values = [part, state["shard"], state["start"], len(flat), np.concatenate(docs).astype("<i8").tobytes(), np.concatenate(counts).astype("<i8").tobytes(), pack(flat)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            state["shard"] += 1
            state["start"] += len(flat)
            for kept in (docs, counts, ids):
                kept.clear()
            names = [x.split()[0] for x in _FILE_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        held = 0
        for batch in batches:
            data, offsets = texts(batch.column(1))
            names = batch.column(0).fill_null(_MISSING).to_numpy(zero_copy_only=False)
            for lo, hi in runs(offsets):
                flat, n = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                closed = np.insert(flat, np.cumsum(n), np.uint32(END_ID))
                docs.append(names[lo:hi])
                counts.append(n + 1)
                ids.append(closed)
                held += len(closed)
                if held >= shard_ids:
                    yield shard()
                    held = 0
        if docs:
            yield shard()

    return rows


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode all texts and write the store at ``path``, in ascending order of the id column."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_shards(tokenizer_path, shard_ids), _FILE_SCHEMA).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = Codes(row["codes"]).all().astype("<u4")
            counts = np.frombuffer(row["counts"], "<i8")
            docs = np.frombuffer(row["doc_ids"], "<i8")
            ends = np.cumsum(counts)
            sums = [zlib.crc32(ids[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(docs), row["part"], np.int32)),
                    pa.array(docs, mask=docs == _MISSING),
                    pa.array(row["local_start"] + ends - counts),
                    pa.array(counts),
                    pa.array(sums, pa.int64()),
                ],
                ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone.

    A part's offset is the sum of the parts before it: one number a part, and
    there are no more parts than the writing job had partitions.
    """
    store = spark.read.schema(_FILE_SCHEMA).parquet(path)
    totals = {r["part"]: r["n"] for r in store.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    bases, base = [], 0
    for part in sorted(totals):
        bases.append((part, base))
        base += totals[part]
    offsets = spark.createDataFrame(bases, "part int, base long")
    read = store.mapInArrow(_documents, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_token(spark: SparkSession, path: str, position: int) -> int:
    """The id at one position of the whole store: one shard's codes are fetched, one token is read."""
    store = spark.read.schema(_FILE_SCHEMA).parquet(path)
    for r in store.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        if position < r["n"]:
            row = store.filter((F.col("part") == r["part"]) & (F.col("local_start") <= position) & (F.col("local_start") + F.col("n_ids") > position)).select("local_start", "codes").first()
            return Codes(bytes(row["codes"])).get(position - row["local_start"])
        position -= r["n"]
    raise IndexError(position)


def op10_dac_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/ids"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)
