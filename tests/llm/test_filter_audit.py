import os
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from veinwork.llm import filter_audit
from veinwork.llm.workspace import shared_folder

SCHEMA = "doc_id long, text string, lang string, part string, mask int, row int, class string, n int, blocks int, length int, source string"
LABELS = "doc_id long, quality int, toxic int, part string, good int"


def fails(text):
    words = [w for w in __import__("re").split(r"[ \t\n\v\f\r]+", text) if w]
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text)]


def brute(rows, labels):
    """Each order applied to the documents one filter after another."""
    texts = [(i, t or "", p or "") for i, t, p in rows]
    smallest = {}
    for i, t, _ in texts:
        if i is not None:
            smallest[t] = min(i, smallest.get(t, i))
    docs = []
    for i, t, p in texts:
        own = [x for x in labels if x[0] == i and i is not None]
        bad = {f for f, b in zip("ABCDE", [*fails(t), i is not None and i > smallest[t]]) if b}
        docs.append((p, bad, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, removed_by = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            everything = left
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                early = [d for d in everything if set(order[: step - 1]) & d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, order, step] = [len(left), len(gone), sum(f in d[1] for d in early), sum(d[1] == {f} for d in everything), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                removed_by[part, f] += len(gone)
    return {(p, o, s, *v, removed_by[p, o[s - 1]]) for (p, o, s), v in out.items()}


def rows_of():
    long = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", " \n", "short", long, long + " #", long.upper(), "ab " * 300, "AB $ " * 300, long + " x" * 300, " ".join(f"word{k}é中" for k in range(6000))]
    rows = []
    for k in range(4):  # copies over parts and ids; a text that differs in its last character only
        rows += [(100 * k + n, t, [None, "", "en", "de"][(n + k) % 4]) for n, t in enumerate(texts)]
        rows += [(100 * k + 50, texts[-1][:-1] + "abcd"[k], "en")]
    return rows + [rows[5], rows[5], (None, long, "en"), (None, "alone", "de"), (7_000, "alone", "de"), (7_001, texts[-1][:-1] + "a", "fr")] + [(8_000 + k, "copies", "en") for k in range(300)]


LABELLED = [(1, 1, 0, "x", 9), (104, 1, 1, "x", 9), (104, 0, 1, "x", 9), (204, None, 1, "x", 9), (8_001, 1, 1, "x", 9), (None, 1, 1, "x", 9), (99_999, 1, 1, "x", 9)]


def found(spark, rows, labels, bits):
    docs = spark.createDataFrame([(i, t, p, "x", 1, 2, "y", 3, 4, 5, "z") for i, t, p in rows], SCHEMA)
    return {tuple(r) for r in filter_audit.audit(docs, spark.createDataFrame(labels, LABELS), shared_folder(spark), bits).collect()}


@pytest.mark.parametrize("bits", [64, 1])
def test_equals_filters_applied_in_every_order(spark, bits):
    """With one bit a block, most classes hold several texts: the comparison in full tells them apart."""
    assert found(spark, rows_of(), LABELLED, bits) == brute(rows_of(), LABELLED)


def test_shuffled_classes_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BROADCAST_ROWS", 0)
    assert found(spark, rows_of(), [], 64) == brute(rows_of(), [])


def test_small_inputs(spark):
    assert found(spark, [], [], 64) == set()
    assert found(spark, [(1, None, None)], [], 64) == brute([(1, None, None)], [])


def test_blocks_cover_the_text(spark):
    """A change of any one character changes the class; texts as long as a whole number of blocks have no empty block."""
    from pyspark.sql import functions as F

    for size in (1, 511, 512, 513, 4607, 4608, 4609, 40_000):
        base = "a" * size
        texts = [base] + [base[:k] + "b" + base[k + 1 :] for k in {0, size // 2, size - 1, min(511, size - 1), min(512, size - 1)}]
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(filter_audit.class_of(F.col("t")).alias("c"), F.size(filter_audit.blocks(F.col("t"))).alias("n")).collect()
        assert len({r["c"] for r in rows}) == len(texts)
        assert {r["n"] for r in rows} == {1 + (size > 512) + (size > 4608) + (size > 37_376)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    expected = con.sql(filter_audit.ORACLE_SQL)
    got = filter_audit.op11_filter_audit(spark, "/root/testdata/sf0.001")
    assert got.columns == expected.columns
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())
