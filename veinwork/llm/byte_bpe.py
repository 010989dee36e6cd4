"""Byte-level BPE by segment trees, and decoding.

Each piece is a row of byte positions.  A segment tree over the positions
keeps the smallest pair rank and, among equals, the leftmost one; a merge
takes the root, walks down to that position and makes three point updates
(the merged pair, its left neighbour, the freed position), each logarithmic.
``encode_pieces`` runs the trees of many pieces of a width at once in numpy;
``encode_long`` is the same tree for one piece of any length.

Defined results: null and empty texts have no ids and decode to nothing;
documents of any length are encoded whole; repeated rows each give a row; an
empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.llm.pieces import PieceCache, split
from veinwork.llm.textbatch import ragged, runs, texts
from veinwork.llm.workspace import rested, small_batches, sparing

_NONE = np.int32(1 << 30)
_WIDEST = 64


class ByteBpe:
    """Ranks of a public vocabulary in the tiktoken file format."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        top = max(self.ranks.values()) + 1
        self.shift = max(top - 1, 1).bit_length()
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << self.shift | right] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        by_id = [b""] * top
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.token_length = np.array([len(t) for t in by_id], np.int64)
        self.token_begin = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.digits = np.array([b"%d " % i for i in range(top)])
        self.cache = PieceCache(self.encode_pieces)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << self.shift | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def encode_pieces(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each piece has."""
        rank = self.ranks.get
        whole = np.array([rank(p, -1) for p in pieces], np.int64)
        size = np.array([len(p) for p in pieces], np.int64)
        lengths = np.ones(len(pieces), np.int64)
        width = np.where(size > _WIDEST, 0, 2 ** np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64))
        order, flats = [np.flatnonzero(whole >= 0)], [whole[whole >= 0].astype(np.uint32)]
        for w in np.unique(width[whole < 0]).tolist():
            members = np.flatnonzero((whole < 0) & (width == w))
            for lo in range(0, len(members), 1 << 14 if w else 1):
                part = members[lo : lo + (1 << 14 if w else 1)]
                if w:
                    flat, lengths[part] = self._encode_width([pieces[i] for i in part.tolist()], w)
                else:
                    flat = self.encode_long(pieces[part[0]])
                    lengths[part] = len(flat)
                order.append(part)
                flats.append(flat)
        placed = np.concatenate(order)
        begin = np.zeros(len(pieces), np.int64)
        begin[placed] = np.cumsum(lengths[placed]) - lengths[placed]
        return np.concatenate(flats)[ragged(begin, lengths)], lengths

    def _encode_width(self, pieces: Sequence[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        inside = np.arange(width) < size[:, None]
        token = np.where(inside, self.byte_ids[raw], -1).astype(np.int32)
        place = np.arange(width, dtype=np.int64)
        after = np.broadcast_to(place + 1, (m, width)).copy()
        before = np.broadcast_to(place - 1, (m, width)).copy()
        tree = np.full((m, 2 * width), _NONE, np.int32)
        tree[:, width : 2 * width - 1] = np.where(inside[:, 1:], self._rank(token[:, :-1], np.maximum(token[:, 1:], 0)), _NONE)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        flat, tokens, nexts, befores = tree.reshape(-1), token.reshape(-1), after.reshape(-1), before.reshape(-1)

        def put(r: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            base = r * (2 * width)
            node = at + width
            flat[base + node] = rank
            node = node >> 1
            while node[0]:
                flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])
                node = node >> 1

        while len(rows):
            base = rows * (2 * width)
            merged = flat[base + 1]
            node = np.ones(len(rows), np.int64)
            while node[0] < width:
                left = base + 2 * node
                node = 2 * node + (flat[left + 1] < flat[left])
            at = node - width
            row = rows * width
            right = nexts[row + at]
            beyond = nexts[row + right]
            tokens[row + at], tokens[row + right] = merged, -1
            nexts[row + at] = beyond
            more = beyond < size[rows]
            befores[(row + beyond)[more]] = at[more]
            put(rows, right, np.full(len(rows), _NONE, np.int32))
            following = tokens[row + np.minimum(beyond, width - 1)]
            put(rows, at, np.where(more, self._rank(merged, np.maximum(following, 0)), _NONE))
            ahead = befores[row + at]
            has = ahead >= 0
            if has.any():
                put(rows[has], ahead[has], self._rank(tokens[(row + ahead)[has]], merged[has]))
            rows = rows[flat[base + 1] < _NONE]
        kept = token >= 0
        return token[kept].astype(np.uint32), kept.sum(1)

    def encode_long(self, piece: bytes) -> np.ndarray:
        n, none, pairs, shift = len(piece), int(_NONE), self.pairs, self.shift
        width = 1 << max(1, (n - 1).bit_length())
        token = [int(self.byte_ids[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = pairs.get(token[i] << shift | token[i + 1], none)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(at: int, rank: int) -> None:
            at += width
            tree[at] = rank
            at >>= 1
            while at:
                best = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == best:
                    break
                tree[at] = best
                at >>= 1

        while tree[1] < none:
            rank, node = tree[1], 1
            while node < width:
                node = 2 * node + (tree[2 * node + 1] < tree[2 * node])
            at = node - width
            right = after[at]
            beyond = after[right]
            token[at], token[right], after[at] = rank, -1, beyond
            put(right, none)
            if beyond < n:
                before[beyond] = at
                put(at, pairs.get(rank << shift | token[beyond], none))
            else:
                put(at, none)
            if before[at] >= 0:
                put(before[at], pairs.get(token[before[at]] << shift | rank, none))
        return np.array([t for t in token if t >= 0], np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of documents, and ids per document."""
        starts, ends, counts = split(data, offsets)
        ids, each = self.cache.ids(data, starts, ends)
        total = np.concatenate([[0], np.cumsum(each)])
        bounds = total[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and bytes per id."""
        length = self.token_length[ids]
        return self.token_bytes[ragged(self.token_begin[ids], length)], length

    def encode_text(self, text: str | None) -> list[int]:
        data = np.frombuffer((text or "").encode(), np.uint8)
        return self.encode(data, np.array([0, len(data)]))[0].tolist()


@functools.lru_cache(2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def _encoded(path: str, with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for lo, hi in runs(offsets):
                part = data[offsets[lo] : offsets[hi]]
                ids, counts = bpe.encode(part, offsets[lo : hi + 1] - offsets[lo])
                ends = np.cumsum(counts)
                shown = bpe.digits[ids].view(np.uint8)
                shown = shown[shown != 0]
                width = np.concatenate([[0], np.cumsum(np.char.str_len(bpe.digits)[ids])])
                back, length = bpe.decode(ids)
                at = np.concatenate([[0], np.cumsum(length)])
                a, b = ends - counts, ends
                text_bytes, raw = memoryview(shown), memoryview(back)
                columns = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(text_bytes[x : max(x, y - 1)]).hexdigest() for x, y in zip(width[a].tolist(), width[b].tolist())]),
                    pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(at[a].tolist(), at[b].tolist())]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))),
                        pa.array([bytes(raw[x:y]).decode("utf-8", "replace") for x, y in zip(at[a].tolist(), at[b].tolist())], pa.string()),
                    ]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return sparing(rows)


def encode_documents(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless switched off, ids and the decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_ids else ""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_encoded(vocabulary_path, with_ids), schema)


def _public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, _public_path(), with_ids=False)


def token_table(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of every document that is left."""
    rested(spark)
    small_batches(spark)
    return encode_documents(docs, _public_path(), with_ids=False)
