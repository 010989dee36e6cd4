"""Exact n-gram Jaccard self-join by prefix trees.

A document is the set of its distinct five-word shingles; two documents link
when 100 * intersection >= 80 * union.

1.  Shingles are dealt by value, packed in binary columns, and looked for in
    other documents.  A shingle that no other document has can link nothing,
    and a document links with nothing unless four fifths of its shingles
    recur, so most documents leave here.  A shingle of several documents of
    one block of texts goes out once for the block, so that a shingle of a
    third of all documents makes one entry a block, not one a document.
2.  Documents of equal sets fold into one representative.
3.  The shingles left are counted over the representatives left, exactly, and
    sets are put in one global order, rare shingles first (shingles of one
    document, before all others, are not stored).  Linked sets share one of
    their first ``n - ceil(0.8 n) + 1`` shingles.
4.  Documents at one prefix shingle form a run, which pairs its leader, the
    document that shares most with all others, with the other members.  A
    leader's partners are stored as ordered sets in a trie; the leader's set
    walks down it, sharing partial overlaps among sets with a common prefix
    and leaving subtrees whose remaining length cannot reach the bound.
5.  Links found so far give components.  Members of a run that are in
    different components, and for which what follows the shared shingle is
    long enough, are tried in the same way; as long as those pairs are many
    more than the members, further leaders go first.
6.  Components of all links, and of the folded copies.

So a group of near copies costs its size, not its square, and no task holds a
whole group: a leader's partners are cut in blocks of about ``BLOCK`` shingles.

Defined results: null and empty texts, and texts without words, have no
shingles and link with nothing; fewer than five words make one shingle of the
whole sequence; repeated rows are copies of each other; the smallest doc_id of
a component names it (null where all its ids are null); an empty table gives
no rows.  Only the id and text columns are read.  Sets are told apart by their
size and 128 bits of hashes, shingles by 56 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.llm.components import components
from veinwork.llm.textbatch import mix, runs, shingles, texts, word_hashes
from veinwork.llm.workspace import from_files, kept_rows, partitions, released, rested, shared_folder, written

TOKEN_BITS = 56
#: Shingles and documents of a block of texts.
BLOCK_SHINGLES, BLOCK_DOCUMENTS = 750_000, 65_535
#: In place of a document's number in its block: more than one document has the shingle.
SEVERAL = 65_535
#: Shingles that a task answers for at a time.
ANSWERED = 2_000_000
#: Shingles of the partners that one trie holds, about.
BLOCK = 50_000
SALTS = 64
#: Further leaders at most, and pairs for each member of a run from which on they are sent first.
LEADERS, MANY = 4, 8


def document_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each document, a run of documents at a time."""
    for lo, hi in runs(offsets):
        part = data[offsets[lo] : offsets[hi]]
        words, counts = word_hashes(part, offsets[lo : hi + 1] - offsets[lo])
        found, made = shingles(words, counts)
        at = np.concatenate([[0], np.cumsum(made)])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield np.unique(found[a:b])


def required(n: int, m: int, percent: int = 80) -> int:
    """Least intersection of sets of n and m shingles with Jaccard of percent / 100."""
    return -(-percent * (n + m) // (100 + percent))


def _needed(n: Column, m: Column) -> Column:
    return F.ceil(80 * (n + m) / 180)


class Trie:
    """Ordered sets that share their common prefixes; a set may be larger than its stored part, by shingles of its own."""

    __slots__ = ("child", "ends", "least", "longest")

    def __init__(self) -> None:
        self.child: dict[int, Trie] = {}
        # below: size of the smallest set, length of the longest stored part
        self.least, self.longest = 1 << 62, 0
        self.ends: tuple[tuple[int, int], ...] = ()

    @classmethod
    def of(cls, sets: list[tuple[int, int, list[int]]]) -> Trie:
        """``sets``: name, size and ordered shingles of each."""
        root = cls()
        for name, size, tokens in sets:
            node, length = root, len(tokens)
            node.least, node.longest = min(node.least, size), max(node.longest, length)
            for token in tokens:
                step = node.child.get(token)
                if step is None:
                    step = node.child[token] = cls()
                node = step
                if size < node.least:
                    node.least = size
                if length > node.longest:
                    node.longest = length
            node.ends += ((name, size),)
        return root

    def overlaps(self, probe: list[int], n: int, percent: int = 80) -> Iterator[tuple[int, int, int]]:
        """(name, size, intersection) of the stored sets with Jaccard of at least percent / 100 with a set of ``n`` shingles."""
        length, at = len(probe), {token: i for i, token in enumerate(probe)}
        bound: dict[int, int] = {}
        stack = [(self, 0, 0, 0)]
        while stack:
            node, depth, shared, passed = stack.pop()
            for name, size in node.ends:
                if shared >= required(n, size, percent):
                    yield name, size, shared
            for token, step in node.child.items():
                # passed: probe tokens known to be smaller than all that follow
                where = at.get(token)
                now, seen = (shared, passed) if where is None else (shared + 1, where + 1)
                least = bound.get(step.least)
                if least is None:
                    least = bound[step.least] = required(n, step.least, percent)
                if now + min(step.longest - depth - 1, length - seen) >= least:
                    stack.append((step, depth + 1, now, seen))


_PROFILE = "row long, doc long, digest long, n long, high long, low long, shared array<long>"
#: Either a document's profile, or shingles of documents of the block that begins at row ``base``.
_ANSWERED = f"base long, {_PROFILE}, tokens binary, places binary"
_DEALT = f"bucket int, {_ANSWERED}"


_KINDS = {"bucket": pa.int32(), "shared": pa.list_(pa.int64()), "tokens": pa.binary(), "places": pa.binary()}


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _lists(tokens: np.ndarray, counts: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=None if none is None else np.append(none, False))
    return pa.ListArray.from_arrays(ends, _signed(tokens))


class _Block:
    """Documents of a task, up to a number of shingles: their profiles, and their shingles dealt by value."""

    def __init__(self, bits: int):
        self.bits, self.base = bits, TaskContext.get().partitionId() << 40
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []
        self.sets: list[np.ndarray] = []
        self.of: list[int] = []
        self.known: set[tuple] = set()
        self.held = 0

    def add(self, doc: int | None, digest: int, found: np.ndarray) -> None:
        n = len(found)
        high = int(np.bitwise_xor.reduce(mix(found))) if n else 0
        low = int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if n else 0
        if n and (n, high, low) not in self.known:  # a copy in the block needs no shingles of its own
            self.known.add((n, high, low))
            self.sets.append(np.unique(found >> np.uint64(64 - TOKEN_BITS)))
            self.of.append(len(self.rows))
            self.held += n
        self.rows.append((doc, digest, n, high, low))

    def full(self) -> bool:
        return self.held >= BLOCK_SHINGLES or len(self.rows) >= BLOCK_DOCUMENTS

    def batches(self) -> Iterator[pa.RecordBatch]:
        size = len(self.rows)
        if not size:
            return
        tokens = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        place = np.repeat(np.array(self.of, np.uint16), [len(s) for s in self.sets])
        self.sets.clear(), self.known.clear()
        order = np.argsort(tokens, kind="stable")
        tokens, place = tokens[order], place[order]
        del order
        # flags, not places: several numbers of 64 bits a shingle would be most of a worker's memory
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        several = ~new
        several[:-1] |= ~new[1:]
        # what the block itself shows to recur
        own = np.argsort(place[several], kind="stable")
        counts = np.bincount(place[several], minlength=size)
        without = np.ones(size, bool)
        without[self.of] = False
        doc, digest, n, high, low = zip(*self.rows)
        narrow = lambda x, kind: pa.array(x, kind)
        bucket = (np.arange(size) * 0x9E3779B1 >> 7) % (1 << self.bits)
        yield self._batch(
            size, bucket=narrow(bucket, pa.int32()), base=narrow(np.full(size, self.base), pa.int64()), row=narrow(self.base + np.arange(size), pa.int64()), doc=narrow(doc, pa.int64()), digest=narrow(digest, pa.int64()),
            n=narrow(n, pa.int64()), high=_signed(np.array(high, np.uint64)), low=_signed(np.array(low, np.uint64)), shared=_lists(tokens[several][own], counts, without),
        )
        del own
        once, first = tokens[new], np.where(several[new], np.uint16(SEVERAL), place[new])
        del tokens, place, new, several
        cut = np.searchsorted(once, np.arange((1 << self.bits) + 1, dtype=np.uint64) << np.uint64(TOKEN_BITS - self.bits))
        used = np.flatnonzero(np.diff(cut))
        # 48 bits of each shingle, a plane for each byte: they ascend, so the first planes compress
        planes = once.view(np.uint8).reshape(-1, 8)[:, 5::-1]
        packed = [np.ascontiguousarray(planes[cut[b] : cut[b + 1]].T).tobytes() for b in used]
        places = [first[cut[b] : cut[b + 1]].tobytes() for b in used]
        yield self._batch(len(used), bucket=narrow(used, pa.int32()), base=narrow(np.full(len(used), self.base), pa.int64()), tokens=narrow(packed, pa.binary()), places=narrow(places, pa.binary()))
        self.base += size
        self.clear()

    @staticmethod
    def _batch(size: int, **given: pa.Array) -> pa.RecordBatch:
        names = _names(_DEALT)
        return pa.RecordBatch.from_arrays([given[k] if k in given else pa.nulls(size, _KINDS.get(k, pa.int64())) for k in names], names)


def _dealt(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(bits)
        for batch in batches:
            for doc, digest, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), document_sets(*texts(batch.column(1)))):
                block.add(doc, digest, found)
                if block.full():
                    yield from block.batches()
        yield from block.batches()
        released()

    return rows


def _recurring(tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which entries are of one document each and meet another entry of the same shingle."""
    order = np.argsort(tokens, kind="stable")
    s = tokens[order]
    same = s[1:] == s[:-1]
    met = np.zeros(len(tokens), bool)
    met[order[1:][same]] = True
    met[order[:-1][same]] = True
    return met & (place != SEVERAL)


def _answers(bits: int):
    """Profiles as they are, and shingles of each block's documents that recur elsewhere; rows come sorted by bucket."""
    low_bits = np.uint64(TOKEN_BITS - bits)
    names = _names(_ANSWERED)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        bucket: int | None = None
        size = 0

        def close() -> None:
            nonlocal size
            if held:
                met = _recurring(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                at = 0
                for tokens, place, base in held:
                    own = met[at : at + len(tokens)]
                    at += len(tokens)
                    if own.any():
                        below = tokens[own] & ((np.uint64(1) << low_bits) - np.uint64(1))
                        found.setdefault(base, []).append((below | np.uint64(bucket) << low_bits, place[own]))
                        size += len(below)
                held.clear()

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal size
            bases = list(found)
            tokens, places = ([np.concatenate([x[k] for x in found[b]]).tobytes() for b in bases] for k in (0, 1))
            found.clear()
            size = 0
            given = {"base": pa.array(bases, pa.int64()), "tokens": pa.array(tokens, pa.binary()), "places": pa.array(places, pa.binary())}
            yield pa.RecordBatch.from_arrays([given[k] if k in given else pa.nulls(len(bases), _KINDS.get(k, pa.int64())) for k in names], names)

        for batch in batches:
            own = batch.column("tokens").is_valid().to_numpy(zero_copy_only=False)
            if not own.all():
                yield batch.filter(pa.array(~own)).select(names)
            for b, base, packed, places in zip(*(batch.filter(pa.array(own)).column(k).to_pylist() for k in ("bucket", "base", "tokens", "places"))):
                if b != bucket:
                    close()
                    bucket = b
                    if size >= ANSWERED:
                        yield from answers()
                wide = np.zeros((len(places) // 2, 8), np.uint8)
                wide[:, 5::-1] = np.frombuffer(packed, np.uint8).reshape(6, -1).T
                held.append((wide.view(np.uint64).ravel(), np.frombuffer(places, np.uint16), base))
        close()
        if found:
            yield from answers()
        released()

    return rows


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Profiles with all their shingles that recur, where four fifths do; rows come sorted by block."""
    names = _names(_PROFILE)
    base: int | None = None
    profiles: list[pa.RecordBatch] = []
    tokens: list[np.ndarray] = []
    places: list[np.ndarray] = []

    def close() -> Iterator[pa.RecordBatch]:
        if not profiles:
            return
        own = pa.Table.from_batches(profiles).sort_by("row").combine_chunks()
        n = own["n"].to_numpy()
        known = own["shared"].combine_chunks()
        size = known.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        every = np.concatenate([known.flatten().to_numpy().view(np.uint64), *tokens])
        place = np.concatenate([np.repeat(np.arange(len(n)), size), *places])
        counts = np.bincount(place, minlength=len(n))
        enough = (n > 0) & (5 * counts >= 4 * n)
        order = np.argsort(place, kind="stable")
        order = order[enough[place[order]]]
        shared = _lists(every[order], np.where(enough, counts, 0), ~enough)
        profiles.clear(), tokens.clear(), places.clear()
        yield from own.set_column(own.schema.get_field_index("shared"), "shared", shared).to_batches()

    for batch in batches:
        of = batch.column("base").to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if lo == hi:
                continue
            if of[lo] != base:
                yield from close()
                base = of[lo]
            part = batch.slice(lo, hi - lo)
            answer = part.column("tokens").is_valid()
            profiles.append(part.filter(pa.compute.invert(answer)).select(names))
            answers = part.filter(answer)
            tokens += [np.frombuffer(x, np.uint64) for x in answers.column("tokens").to_pylist()]
            places += [np.frombuffer(x, np.uint16).astype(np.int64) for x in answers.column("places").to_pylist()]
    yield from close()
    released()


def profiles(docs: DataFrame, id_col: str, text_col: str, folder: str) -> DataFrame:
    """Per row of ``docs``: row, doc, digest, n, high, low, and its shingles that recur, null unless four fifths do or a copy has them."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    columns = [F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest")]
    source = from_files(docs.select(*columns), f"{folder}/documents")
    bits = min(max(8, (2 * partitions(spark) - 1).bit_length()), 20)
    dealt = source.mapInArrow(_dealt(bits), _DEALT).repartition("bucket").sortWithinPartitions("bucket")
    parts = dealt.mapInArrow(_answers(bits), _ANSWERED).repartition("base").sortWithinPartitions("base")
    return written(parts.mapInArrow(_assembled, _PROFILE), f"{folder}/profiles")


def ordered_sets(sets: DataFrame, folder: str) -> DataFrame:
    """node, n and keys of the sets (node, n, shared) that can link: shingles of more than one set, rare ones first.

    A key is seven bits of level (twice the logarithm of the exact count) and
    the shingle's 56 bits.
    """
    entries = written(sets.select("node", "n", F.explode("shared").alias("token")), f"{folder}/entries")
    count = entries.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    level = F.least(F.floor(2 * F.log2("k")), F.lit(126)).cast("long")
    met = entries.join(count.hint("merge"), "token").select("node", "n", F.shiftleft(level, TOKEN_BITS).bitwiseOR(F.col("token")).alias("key"))
    keys = met.groupBy("node", "n").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return written(keys.filter("5 * size(keys) >= 4 * n"), f"{folder}/sets")


def _walk(percent: int):
    def rows(table: pa.Table) -> pa.Table:
        """One block of partners of one document."""
        a = table["a"][0].as_py()
        sets = list(zip(table["b"].to_pylist(), table["n"].to_pylist(), table["keys"].to_pylist()))
        [(n, probe)] = [(n, keys) for b, n, keys in sets if b is None]
        trie = Trie.of([x for x in sets if x[0] is not None])
        found = [(a, b, n + size - shared, shared) for b, size, shared in trie.overlaps(probe, n, percent)]
        return pa.table({k: pa.array([r[i] for r in found], pa.int64()) for i, k in enumerate(("a", "b", "together", "shared"))})

    return rows


def overlaps(pairs: DataFrame, sets: DataFrame, folder: str, percent: int = 80) -> DataFrame:
    """(a, b, together, shared) of the pairs (a, b) with Jaccard of at least percent / 100."""
    sized = written(pairs.join(sets.select(F.col("node").alias("b"), F.size("keys").alias("length")).hint("merge"), "b"), f"{folder}/pairs")
    blocks = sized.groupBy("a").agg(F.ceil(F.sum("length") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    partner = sized.join(blocks.hint("merge"), "a").select("a", block.alias("block"), "b")
    leader = partner.select("a", "block", F.lit(None).cast("long").alias("b")).distinct()
    going = partner.unionByName(leader).withColumn("node", F.coalesce("b", "a"))
    met = going.join(sets.hint("merge"), "node").select("a", "block", "b", "n", "keys")
    return written(met.groupBy("a", "block").applyInArrow(_walk(percent), "a long, b long, together long, shared long"), f"{folder}/overlaps")


def _possible(n: str, rest: str, m: str, other: str) -> Column:
    """Whether sets of n and m shingles can link whose first common one has so many left in each, itself included."""
    return F.least(F.col(rest), F.col(other)) >= _needed(F.col(n), F.col(m))


def _led(members: DataFrame) -> DataFrame:
    """Members of each run beside its leader, the one of the highest score; leaders themselves are left out."""
    best = F.max_by(F.struct("node", "n", "rest", *(["comp"] if "comp" in members.columns else [])), F.struct("score", -F.col("node")))
    lead = members.groupBy("token").agg(best.alias("best")).select("token", *[F.col(f"best.{k}").alias(f"lead_{k}") for k in ("node", "n", "rest", *(["comp"] if "comp" in members.columns else []))])
    return members.join(lead.hint("merge"), "token").filter("node <> lead_node")


def _placed(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members with their components: runs of more than one component, without members too different from all others."""
    known = members.drop("comp").join(comp.select(F.col("doc").alias("node"), "comp").hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = known.groupBy("token").agg(F.min("n").alias("least"))
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * 0.8))
    able = known.join(least.hint("merge"), "token").filter(F.col("rest") >= _needed(F.col("n"), smallest)).drop("least")
    mixed = able.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members")).filter("lo <> hi")
    return able.join(mixed.select("token", "members").hint("merge"), "token")


def links_of(sets: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, together, shared) that connect all components of the ordered sets, and (doc, comp) of linked nodes."""
    least = F.expr("size(keys) - CAST(ceil(n * 0.8) AS INT) + 1")
    spread = sets.select("node", "n", F.size("keys").alias("m"), F.posexplode(F.slice("keys", 1, least)).alias("pos", "token"))
    entries = written(spread.select("token", "node", F.col("n").cast("int").alias("n"), (F.col("m") - F.col("pos")).alias("rest")), f"{folder}/prefixes")
    size = entries.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = entries.join(size.hint("merge"), "token")
    # central documents share their shingles with many: the sum of the sizes of a document's runs
    score = members.groupBy("node").agg(F.sum("size").alias("score"))
    led = written(_led(members.drop("size").join(score.hint("merge"), "node")), f"{folder}/led")
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    star = led.filter(_possible("n", "rest", "lead_n", "lead_rest")).select(F.col("lead_node").alias("a"), F.col("node").alias("b")).distinct()
    links = overlaps(star, sets, f"{folder}/star")
    comp = components(links, f"{folder}/components0")
    members = led.select("token", "node", "n", "rest", "score")
    for step in range(1, LEADERS + 2):
        members = written(_placed(members, comp), f"{folder}/placed{step}")
        rows, pairs = members.agg(F.count(F.lit(1)), F.sum(F.col("members") - 1) / 2).first()
        if not rows:
            break
        members = members.drop("members")
        if pairs > MANY * rows and step <= LEADERS:
            led = written(_led(members), f"{folder}/led{step}")
            tried = led.filter("comp <> lead_comp").filter(_possible("n", "rest", "lead_n", "lead_rest")).select(*pair("lead_node", "node")).distinct()
            members = led.select("token", "node", "n", "rest", "score")
        else:
            other = members.select("token", *[F.col(k).alias(f"{k}_b") for k in ("node", "n", "rest", "comp")])
            both = members.join(other.hint("merge"), "token").filter("node < node_b AND comp <> comp_b")
            tried = both.filter(_possible("n", "rest", "n_b", "rest_b")).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
            members = None
        found = overlaps(tried, sets, f"{folder}/tried{step}")
        if not found.isEmpty():
            links = written(links.unionByName(found), f"{folder}/links{step}")
            comp = components(links, f"{folder}/components{step}")
        if members is None:
            break
    return links, comp


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc, digest, n, group, component_id), and links (a, b, jaccard) between representatives of different sets.

    ``digest`` is the hash of the text; rows of one component have one ``group``.
    """
    folder = shared_folder(docs.sparkSession)
    profile = profiles(docs, id_col, text_col, folder).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    key = ["n", "high", "low"]
    carrier = F.min(F.when(F.col("shared").isNotNull(), F.col("row")))
    salted = profile.filter("n > 0").groupBy(*key, "salt").agg(F.min("doc").alias("rep"), F.min("row").alias("first"), carrier.alias("node"))
    whole = salted.groupBy(*key).agg(F.min("rep").alias("rep"), F.min("first").alias("first"), F.min("node").alias("node"), F.collect_list("salt").alias("salts"))
    whole = written(whole, f"{folder}/classes")
    carriers = whole.filter("node IS NOT NULL").select(F.col("node").alias("row"))
    sets = profile.filter("shared IS NOT NULL").join(carriers.hint("merge"), "row").select(F.col("row").alias("node"), "n", "shared")
    links, comp = links_of(ordered_sets(sets, folder), folder)
    named = whole.filter("node IS NOT NULL").select("node", "rep")
    label = comp.withColumnRenamed("doc", "node").join(named.hint("merge"), "node")
    least = label.groupBy("comp").agg(F.min("rep").alias("least"))
    label = written(label.join(least.hint("merge"), "comp").select("node", "comp", "least"), f"{folder}/labels")
    placed = whole.join(label.hint("merge"), "node", "left").select(*key, F.explode("salts").alias("salt"), F.coalesce("comp", "first").alias("group"), F.coalesce("least", "rep").alias("least"))
    rows = profile.select("row", "doc", "digest", *key, "salt").join(placed.hint("merge"), [*key, "salt"], "left").select("doc", "digest", "n", F.coalesce("group", "row").alias("group"), F.coalesce("least", "doc").alias("component_id"))
    ends = [named.select(F.col("node").alias(k), F.col("rep").alias(f"{k}_doc")).hint("merge") for k in ("a", "b")]
    return rows, links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"), (F.col("shared") / F.col("together")).alias("jaccard"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, component_id) and verified links between distinct sets (a, b, jaccard).

    The links connect every component; pairs within a component that were
    already connected need not be among them.
    """
    rows, links = grouped(docs, id_col, text_col)
    return rows.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id"), links


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, of those with the smallest doc_id; repeated rows leave one."""
    rested(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    folder = shared_folder(spark)
    rows = grouped(docs)[0].groupBy("doc", "digest").agg(F.min("group").alias("group"), F.count(F.lit(1)).alias("copies"))
    rows = written(rows, f"{folder}/rows")
    best = rows.groupBy("group").agg(F.min(F.struct(F.col("doc").isNull().alias("without"), "doc", "digest")).alias("best")).select("group", "best.*")
    same = F.col("own.doc").eqNullSafe(F.col("best.doc")) & (F.col("own.digest") == F.col("best.digest"))
    decided = rows.alias("own").join(best.alias("best").hint("merge"), "group").select("own.doc", "own.digest", "copies", same.alias("kept"))
    return kept_rows(docs, {"doc": F.col("doc_id").cast("long"), "digest": F.xxhash64(text)}, written(decided, f"{folder}/decided"))
