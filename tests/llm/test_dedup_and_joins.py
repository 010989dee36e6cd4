import hashlib
import os
import random
import re
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import frame, words
from veinwork.llm import components, exact_dedup, ngram_join, substring_dedup, workspace
from veinwork.llm.textbatch import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text):
    w = tokens(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_exact_dedup(spark, corpus, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    found = {r["doc_id"]: r for r in exact_dedup.deduplicate(frame(spark, corpus), index).collect()}
    groups = {}
    for i, t in corpus:
        groups.setdefault(t or "", []).append(i)
    assert len(found) == len(corpus)
    for t, members in groups.items():
        for i in members:
            r = found[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(members), len(members), i == max(members), hashlib.sha256(t.encode()).hexdigest())
    # a second batch meets the index: known texts go, new ones are appended
    again = exact_dedup.deduplicate(frame(spark, [(1000, "one"), (1001, "brand new"), (1002, "brand new")]), index)
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in again.collect()) == [(1000, 4, False), (1001, 1002, False), (1002, 1002, True)]
    assert index.table().count() == len(groups) + 1
    reopened = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    assert reopened.table().count() == len(groups) + 1
    plan = frame(spark, corpus).limit(0)
    assert exact_dedup.deduplicate(plan, index).count() == 0
    reopened.close()


def test_index_keeps_its_buckets(spark, tmp_path):
    """Opened again under another number of shuffle partitions, it knows all that it knew."""
    texts = [(i, f"text {i}") for i in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    path = f"file://{tmp_path}/index"
    names = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index")}
    known = names()
    try:
        index = exact_dedup.DigestIndex(spark, path)
        assert exact_dedup.deduplicate(frame(spark, texts), index).filter("kept").count() == 60
        index.close()
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = exact_dedup.DigestIndex(spark, path)
        assert again.buckets == int(before)
        assert exact_dedup.deduplicate(frame(spark, [(i + 100, t) for i, t in texts]), again).filter("kept").count() == 0
        assert again.table().count() == 60
        again.close()
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, path, 9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    frame(spark, [(1, "a")]).write.parquet(f"file://{tmp_path}/other")
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, f"file://{tmp_path}/other")
    exact_dedup._once(frame(spark, texts)).count()
    assert names() == known


def test_stages_leave_one_of_repeated_rows(spark):
    draw = random.Random(2)
    base = words(draw, 60)
    near = base.rsplit(" ", 1)[0] + " other"
    rows = [(1, "same text"), (1, "same text"), (3, "same text"), (3, "same text"), (3, base), (4, near), (4, near), (None, "no id"), (None, "no id"), (7, None), (7, None), (8, "")]
    docs = frame(spark, rows).withColumn("__keep", F.lit(1)).withColumn("copies", F.lit(2)).withColumn("kept", F.lit(False))
    found = exact_dedup.distinct_documents(spark, docs, "")
    assert found.columns == docs.columns
    key = lambda rows: sorted(((r["doc_id"], r["text"]) for r in rows), key=str)
    # null and empty texts are equal
    assert key(found.collect()) == sorted([(3, "same text"), (3, base), (4, near), (None, "no id"), (8, "")], key=str)
    found = ngram_join.one_of_each_group(spark, docs, "")
    assert found.columns == docs.columns
    rest = [r for r in found.collect() if r["text"]]
    assert key(rest) == sorted([(1, "same text"), (3, base), (None, "no id")], key=str)
    assert sorted(r["doc_id"] for r in found.collect() if not r["text"]) == [7, 8]


def expected_components(corpus):
    sets = {i: shingle_set(t) for i, t in corpus}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_join(spark, corpus):
    draw = random.Random(3)
    # chains of small edits, and documents that share a large common passage
    text = words(draw, 120).split(" ")
    chain = []
    for k in range(12):
        text = list(text)
        text[draw.randrange(len(text))] = f"edit{k}"
        chain.append(" ".join(text))
    shared = words(draw, 70)
    more = chain + [f"{shared} {words(draw, 20)}" for _ in range(10)] + [f"{words(draw, 12)} {shared}" for _ in range(6)]
    full = corpus + list(enumerate(more, 5000))
    docs, links = ngram_join.similar(frame(spark, full))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in docs.collect()}
    assert found == expected_components(full)
    sets = dict(full)
    for r in links.collect():
        a, b = shingle_set(sets[r["a"]]), shingle_set(sets[r["b"]])
        assert abs(len(a & b) / len(a | b) - r["jaccard"]) < 1e-9 and r["jaccard"] >= 0.8
    assert ngram_join.similar(frame(spark, []))[0].count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.frozensets(st.integers(0, 14), min_size=1, max_size=12), st.integers(0, 3)), min_size=1, max_size=8), st.frozensets(st.integers(0, 14), min_size=1, max_size=12), st.integers(0, 3), st.sampled_from([60, 80]))
def test_trie_against_pairs(stored, probe, own, percent):
    """Sets with some shingles of their own beside the stored ones."""
    trie = ngram_join.Trie.of([(k, len(s) + more, sorted(s)) for k, (s, more) in enumerate(stored)])
    found = sorted(trie.overlaps(sorted(probe), len(probe) + own, percent))
    assert found == sorted((k, len(s) + more, len(s & probe)) for k, (s, more) in enumerate(stored) if 100 * len(s & probe) >= percent * (len(s | probe) + more + own))


def test_components(spark, tmp_path):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 103), (101, 103)]
    random.Random(1).shuffle(chain)
    found = components.components(spark.createDataFrame(chain, "a long, b long"), f"file://{tmp_path}/c")
    assert {r["doc"]: r["comp"] for r in found.collect()} == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 103: 100}


def cartesian(x, lo, hi, width):
    """Nodes of the Cartesian tree, by recursion."""
    if hi - lo + 1 < width:
        return []
    c = min(range(lo, hi + 1), key=lambda i: (x[i], i))
    return [(lo, c, hi), *cartesian(x, lo, c - 1, width), *cartesian(x, c + 1, hi, width)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=3), st.integers(2, 9), st.integers(0, 10**6))
def test_compact_windows(sizes, width, seed):
    x = mix(np.arange(sum(sizes), dtype=np.uint64) + np.uint64(seed))
    found = sorted(zip(*(v.tolist() for v in substring_dedup.compact_windows(x, np.array(sizes), width)[1:])))
    expected, at = [], 0
    for n in sizes:
        expected += cartesian(x.tolist(), at, at + n - 1, width)
        at += n
    assert found == sorted(expected)


def test_entries_of_a_large_key_meet_in_blocks(monkeypatch, spark):
    """Every two of different classes once, and no group of entries that meet has a whole key."""
    monkeypatch.setattr(substring_dedup, "BLOCK", 20)
    draw = random.Random(6)
    rows = [(key, draw.getrandbits(63) - (1 << 62), doc, doc % 7, 0, doc % 3) for key, size in ((1, 300), (2, 5), (3, 1)) for doc in range(size)]
    nodes = spark.createDataFrame(rows, "key long, node long, doc long, place int, reach int, label long")
    entry = ["node", "doc", "place", "reach", "label"]
    found = [(r["key"], *sorted((r["doc"], r["head"]))) for r in substring_dedup._paired(nodes, entry).collect()]
    assert sorted(found) == [(key, a, b) for key, size in ((1, 300), (2, 5)) for a in range(size) for b in range(a + 1, size) if a % 3 != b % 3]
    for side in substring_dedup._blocks(nodes, entry):
        assert side.groupBy("key", "x", "y").count().agg({"count": "max"}).first()[0] < 60


def test_groups_of_documents_meet_after_one_another(monkeypatch, spark):
    draw = random.Random(29)
    short, shared = words(draw, 28), words(draw, 60)
    texts = [f"{words(draw, 60)} {short} {words(draw, 60)}" for _ in range(60)] + [f"{words(draw, 9)} {short} {words(draw, 70)} {shared} {words(draw, 9)}" for _ in range(4)]
    monkeypatch.setattr(substring_dedup, "LEADERS", 0)
    monkeypatch.setattr(substring_dedup, "AT_ONCE", 4, raising=False)
    sizes, tables = {}, set()

    def noted(df, path):
        out = workspace.written(df, path)
        tables.add(path)
        if "/pairs_" in path:
            sizes[path] = out.select("a", "b").collect()
        return out

    monkeypatch.setattr(substring_dedup, "written", noted)
    found = {(r["doc_id"], r["other_id"]) for r in substring_dedup.repeated_passages(frame(spark, list(enumerate(texts)))).collect()}
    assert {(a, b) for a, b in found if a < 60} == set() and {x for p in found for x in p} == set(range(60, 64))
    last = [v for k, v in sizes.items() if "/pairs_0" not in k]
    pairs = [(r["a"], r["b"]) for v in last for r in v]
    assert len(pairs) == len(set(pairs)) >= 60 * 59 // 2 - 59  # every two once, but for those that met a head before
    assert max(map(len, last)) < len(pairs) // 2  # not all at a time
    left = [path for path in tables if os.path.exists(path.removeprefix("file://"))]
    assert not [path for path in left if re.search("/(links|wanted|unmet|nodes|classes|pairs|beside)", path)], left


@pytest.mark.parametrize("block", [3, 512])
def test_entries_of_two_groups_meet_once(monkeypatch, spark, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    entry = ["node", "doc", "place", "reach", "label"]
    of = lambda lo, hi: spark.createDataFrame([(k % 3, 7919 * k, k, 1, 1, k % 4) for k in range(lo, hi)], "key long, node long, doc long, place int, reach int, label long")
    found = [(r["key"], r["doc"], r["head"]) for r in substring_dedup._paired(of(0, 30), entry, of(30, 70)).collect()]
    assert sorted(found) == sorted((a % 3, a, b) for a in range(30) for b in range(30, 70) if a % 3 == b % 3 and a % 4 != b % 4)


def test_repeated_passages(spark, corpus):
    found = substring_dedup.repeated_passages(frame(spark, corpus)).toPandas()
    places = {}
    for i, t in corpus:
        w = tokens(t)
        for k in range(len(w) - 49):
            places.setdefault(tuple(w[k : k + 50]), set()).add(i)
    expected = {i for v in places.values() if len(v) > 1 for i in v}
    assert expected <= set(found.doc_id)
    texts = dict(corpus)
    for r in found.itertuples():
        a = tokens(texts[r.doc_id])[r.first_word : r.first_word + r.n_words]
        b = tokens(texts[r.other_id])[r.other_first_word : r.other_first_word + r.n_words]
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        assert r.n_words >= 50 and r.doc_id != r.other_id and abs(len(x & y) / len(x | y) - r.similarity) < 1e-9 and r.similarity >= 0.8
    alone = [(1, words(random.Random(5), 400)), (2, words(random.Random(6), 400)), (3, None)]
    assert substring_dedup.repeated_passages(frame(spark, alone)).count() == 0
    assert substring_dedup.repeated_passages(frame(spark, [])).count() == 0


def with_words_in_between(draw):
    """Two texts that share 60 words, with one word more in the middle of the second's."""
    shared = words(draw, 60).split(" ")
    ends = [words(draw, 30) for _ in range(4)]
    return f"{ends[0]} {' '.join(shared)} {ends[1]}", f"{ends[2]} {' '.join([*shared[:30], 'inserted', *shared[30:]])} {ends[3]}"


def test_passage_with_an_inserted_word():
    for seed in range(20):
        a, b = (tokens(t) for t in with_words_in_between(random.Random(seed)))
        x, y = (np.array([hash(tuple(w[k : k + 5])) & (2**63 - 1) for k in range(len(w) - 4)], np.uint64) for w in (a, b))
        for first, second, shifts, more in ((x, y, [0], (56, 57)), (x, y, [1], (56, 57)), (y, x, [0, -1], (57, 56))):
            [(at, n, other, m, jaccard)] = substring_dedup.passages(first, second, shifts, 46, 0.8)
            assert (at, n, other, m) == (30, more[0], 30, more[1]) and abs(jaccard - 52 / 61) < 1e-9
    same = np.ones(300, np.uint64)
    assert (0, 300, 0, 300, 1.0) in list(substring_dedup.passages(same, same, [0], 46, 0.8))


def test_documents_meet_over_an_inserted_word(spark):
    draw = random.Random(41)
    pairs = [with_words_in_between(draw) for _ in range(60)]
    found = substring_dedup.repeated_passages(frame(spark, [(2 * k + side, t[side]) for k, t in enumerate(pairs) for side in (0, 1)]))
    met = {(r["doc_id"], r["other_id"]) for r in found.collect()}
    assert all(a // 2 == b // 2 for a, b in met) and len(met) >= 2 * 40


def test_documents_meet_past_a_head_with_a_shorter_part(spark):
    """Many documents have 45 of a passage's 52 words; the two that have all of it are found all the same."""
    draw = random.Random(61)
    texts, pairs = [], []
    for k in range(12):
        whole = words(draw, 52).split(" ")
        core = " ".join(whole[3:48])
        base = 1000 * k
        texts += [(base + j, f"{words(draw, 40)} {core} {words(draw, 40)}") for j in range(6)]
        texts += [(base + j, f"{words(draw, 40)} {' '.join(whole)} {words(draw, 40)}") for j in (100, 101)]
        pairs.append((base + 100, base + 101))
    found = {(r["doc_id"], r["other_id"]) for r in substring_dedup.repeated_passages(frame(spark, texts)).collect()}
    assert {p for a, b in pairs for p in ((a, b), (b, a))} <= found
    assert all(a % 1000 >= 100 and b % 1000 >= 100 for a, b in found)


def test_recall_of_passages_against_brute_force(spark):
    """Documents that share a stretch of 50 words with another, and only those, over random splices of common material."""
    draw = random.Random(62)
    pool = [words(draw, 80).split(" ") for _ in range(8)]
    texts = []
    for i in range(120):
        parts = [words(draw, 40)]
        for _ in range(draw.randint(0, 2)):
            source = draw.choice(pool)
            size = draw.randint(30, 75)
            at = draw.randint(0, 80 - size)
            parts += [" ".join(source[at : at + size]), words(draw, 30)]
        texts.append((i, " ".join(parts)))
    places = {}
    for i, t in texts:
        w = tokens(t)
        for k in range(len(w) - 49):
            places.setdefault(tuple(w[k : k + 50]), set()).add(i)
    expected = {i for v in places.values() if len(v) > 1 for i in v}
    found = {r["doc_id"] for r in substring_dedup.repeated_passages(frame(spark, texts)).select("doc_id").distinct().collect()}
    assert expected and expected <= found


def test_edited_repeats_meet_past_heads_with_a_part(spark):
    """Edited repeats beside documents of smaller ids that have one half of them: each pair is found, whatever heads their keys have."""
    draw = random.Random(63)
    texts, pairs = [], []
    for k in range(40):
        whole = words(draw, 52).split(" ")
        edited = [*whole[:26], f"edit{k}", *whole[26 + k % 2 :]]
        base = 1000 * k
        halves = (whole[:30], whole[22:])
        texts += [(base + j, f"{words(draw, 40)} {' '.join(halves[j % 2])} {words(draw, 40)}") for j in range(4)]
        texts += [(base + 100 + j, f"{words(draw, 40)} {' '.join(part)} {words(draw, 40)}") for j, part in enumerate((whole, edited))]
        pairs.append((base + 100, base + 101))
    found = {(r["doc_id"], r["other_id"]) for r in substring_dedup.repeated_passages(frame(spark, texts)).collect()}
    assert found == {p for a, b in pairs for p in ((a, b), (b, a))}


def test_run_that_similar_passages_share():
    """Against all ways to place breaks of the least cost: some stretch that agrees is as long."""
    assert substring_dedup.common_run(50, 0.8) == 21
    width = 46
    for breaks in range(8):
        for agree in range(1, 400):
            if agree + 4 * breaks >= width and agree >= 0.8 * (agree + 8 * breaks):
                assert -(-agree // (breaks + 1)) >= 21


def test_heads_of_a_batch_stand_for_it():
    names = [c.split()[0] for c in substring_dedup._ENTRY.split(", ")]
    columns = [np.array(v, k) for v, k in (([5, 5, 5, 5, 9], np.int64), ([1, 1, 1, 2, 1], np.int32), ([3, 2, 2, 7, 4], np.int64), ([10, 20, 30, 40, 50], np.int32), ([0, 1, 2, 0, 1], np.int32))]
    heads, met = (b.to_pydict() for b in substring_dedup._met(columns))
    assert [heads[k] for k in ("key", "deep", "doc", "place")] == [[5, 5, 9], [1, 2, 1], [2, 7, 4], [20, 40, 50]] and heads["head"] == [None] * 3 and list(heads) == names
    assert [met[k] for k in ("doc", "place", "head", "head_place")] == [[3], [10], [2], [20]]


def test_stages_keep_columns(spark, corpus):
    docs = frame(spark, corpus)
    kept = exact_dedup.distinct_documents(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {max(i for i, u in corpus if (u or "") == (t or "")) for _, t in corpus}
    one = ngram_join.one_of_each_group(spark, docs, "")
    assert one.columns == docs.columns
    assert {r["doc_id"] for r in one.collect()} == {i for i, (_, c) in expected_components(corpus).items() if i == c}
    assert docs.filter(F.col("doc_id") < 0).count() == 0


def test_blocks_let_go_of_their_shingles(monkeypatch):
    """Dealing a block takes no more than some six times its shingles beside them, and blocks of any size give the same shingles."""
    monkeypatch.setattr(ngram_join.TaskContext, "get", lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)}))
    draw = np.random.default_rng(4)
    block = ngram_join._Block(8)
    block.add(0, 0, np.arange(9, dtype=np.uint64))
    list(block.batches())  # what is loaded at first does not count
    for k in range(400):
        block.add(k, k, np.unique(draw.integers(0, 1 << 62, 1500).astype(np.uint64)))
    size = 8 * block.held
    tracemalloc.start()
    try:
        out = list(block.batches())
        assert tracemalloc.get_traced_memory()[1] < 6 * size
    finally:
        tracemalloc.stop()
    assert not block.sets and sum(len(p) // 2 for p in out[1].column("places").to_pylist()) == size // 8


def test_blocks_take_few_bytes_a_shingle(monkeypatch):
    """The shingles of a block are sorted and cut with flags beside them, not with several numbers of 64 bits for each."""
    monkeypatch.setattr(ngram_join, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    block, draw, n = ngram_join._Block(8), np.random.default_rng(3), 400_000
    for doc in range(40):
        block.add(doc, doc, np.unique(draw.integers(0, 1 << 63, n // 40, dtype=np.uint64)))
    tracemalloc.start()
    try:
        shingles = sum(sum(len(x) // 2 for x in b.column("places").to_pylist() if x) for b in block.batches())
        assert tracemalloc.get_traced_memory()[1] < 36 * n
    finally:
        tracemalloc.stop()
    assert shingles == n


def test_released_memory_leaves_the_process():
    """Arrays of a task that ended go back to the system, though smaller ones lie among them."""
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10
    before = held()
    rows = [bytearray(20_000) for _ in range(8_000)]
    rows = rows[::40]
    workspace.released()
    assert held() - before < 60
    assert len(rows) == 200


def test_passages_meet_across_batches(spark, monkeypatch):
    """Entries of small batches meet each other as those of a large one do, and sequences come a run at a time."""
    draw = random.Random(8)
    passage = words(draw, 60)
    texts = [f"{words(draw, 30)} {passage} {words(draw, 30)}" for _ in range(40)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], ["doc", "text"])
    released = []
    monkeypatch.setattr(workspace, "released", lambda: released.append(1))
    entries = lambda batches: sorted(tuple(r.values()) for b in substring_dedup._windows(21)(iter(batches)) for r in b.select([0, 2, 3, 5, 6]).to_pylist() if r["head"] is not None)
    met = entries([whole])
    assert met and entries([whole.slice(k, 4) for k in range(0, 40, 4)]) == met and released == [1, 1]
    monkeypatch.setattr(substring_dedup, "runs", lambda offsets: ((k, k + 10) for k in range(0, 40, 10)))
    assert [b.num_rows for b in substring_dedup._sequences(iter([whole]))] == [10] * 4
    monkeypatch.undo()

    before = spark.conf.get(workspace.BATCH_BYTES)
    try:
        spark.conf.set(workspace.BATCH_BYTES, "64m")
        found = {(r["doc_id"], r["other_id"]) for r in substring_dedup.repeated_passages(frame(spark, list(enumerate(texts)))).collect()}
        assert {a for a, _ in found} == set(range(40)) and spark.conf.get(workspace.BATCH_BYTES) in ("4m", "4194304b")
    finally:
        spark.conf.set(workspace.BATCH_BYTES, before)
