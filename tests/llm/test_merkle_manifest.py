import hashlib
import os
import zlib

import duckdb
import pytest

from veinwork.llm import merkle_manifest
from veinwork.llm.ranks import radix_offsets, ranked_strings
from veinwork.llm.workspace import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, at long, node string, run int, total int, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at - at % 3
        out.append((nodes[first:at], nodes[at + 1 : first + 3]))
        at //= 3
    return out


def brute(rows):
    """Every tree in full, every proof from it."""
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[name] = levels_of([leaf(r, r["text"]) for r in groups[name]])
    over = levels_of([trees[n][-1][0] for n in names])
    root, out = over[-1][0] if names else "", []
    for k, name in enumerate(names):
        for at, row in enumerate(groups[name]):
            way = siblings(trees[name], at) + siblings(over, k)
            text = row["text"]
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf(row, text)
            for left, right in way:
                node = h(*left, node, *right)
            out.append((row["doc_id"], trees[name][0][at], trees[name][-1][0], root, h(*[x for left, right in way for x in left + right]), node, node == root))
    return sorted(out, key=repr)


def rows_of(n, sources, step=1):
    texts = [None, "", "a\nb", "plain", "é\n\n中", "x\n" * 40_000]
    return [
        {"doc_id": (i * 7919 % n) * step - 5, "text": texts[i % 6] if i % 6 < 5 or i < 12 else f"text {i}\n", "lang": [None, "en"][i % 2], "source": sources(i), "n_chars": [None, i][i % 3 > 0]}
        for i in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1, "y", 2, 3, "z") for r in rows], SCHEMA)


def found(spark, rows, digits):
    df = merkle_manifest.manifest(frame(spark, rows), merkle_manifest.without_breaks, shared_folder(spark), digits)
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("digits", [1, 7])
def test_equals_trees_built_in_full(spark, digits):
    sources = lambda i: "hot" if i % 3 else [None, "", "é", "a", "z", "~", "中", "b", "B", "a0", "alone"][min(10, i % 31)]
    rows = rows_of(300, sources, 10**15)  # ids far apart: histograms of five levels
    rows += [dict(rows[4]), dict(rows[4]), {**rows[4], "text": "another"}, {**rows[9], "doc_id": None}, {**rows[9], "doc_id": None, "text": "b\n"}]
    rows += [{**rows[1], "doc_id": (1 << 63) - 1}, {**rows[1], "doc_id": -(1 << 63)}, {**rows[2], "source": "once", "doc_id": 77}]
    assert found(spark, rows, digits) == brute(rows)


@pytest.mark.parametrize("n", [1, 3, 10])
def test_edges_of_runs(spark, n):
    rows = rows_of(n, lambda i: "s")
    assert found(spark, rows, 1) == brute(rows)


def test_one_source_a_document(spark):
    rows = rows_of(30, lambda i: f"s{i}")
    assert found(spark, rows, 2) == brute(rows)


def test_empty_table(spark):
    assert found(spark, [], 7) == []


def test_ranks(spark, tmp_path):
    ids = [-(1 << 63), -4097, -4096, -1, 0, 1, 4095, 4096, 1 << 40, (1 << 63) - 1]
    rows = spark.createDataFrame([("g", i) for i in ids for _ in range(2)] + [("h", 5)], "g string, k long")
    got = {(r["g"], r["prefix"]): (r["offset"], r["total"]) for r in radix_offsets(rows, "g", "k", f"file://{tmp_path}/h").collect()}
    for i in ids:
        assert got["g", i >> 12] == (2 * sum((j >> 12) < (i >> 12) for j in ids), 2 * len(ids))
    assert got["h", 0] == (0, 1)
    names = ["", "a", "b", "é", "中", "\U0001f600", "Z", "aa"]
    ranked = ranked_strings(spark.createDataFrame([(n,) for n in names], "s string"), "s", f"file://{tmp_path}/r").collect()
    assert {r["s"]: r["rank"] for r in ranked} == {n: k for k, n in enumerate(sorted(names, key=str.encode))}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    expected = con.sql(merkle_manifest.ORACLE_SQL)
    got = merkle_manifest.op13_merkle_manifest(spark, "/root/testdata/sf0.001")
    assert got.columns == expected.columns
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())
