import math
import random
from collections import defaultdict

import pytest

from veinwork.llm import source_mixing
from veinwork.llm.workspace import shared_folder

SCHEMA = "doc_id long, text string, source string, name string, size string, part int, target string, n int, copies int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", 1, "z", 2, 3, 4) for i, t, s in rows], SCHEMA)


def plain_targets(sizes):
    """Share by weight, cut, share the excess again: as a plain loop. sizes: by source, in order."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sizes)}
    total, cut, out = sum(sizes.values()), {}, {}
    while True:
        left, open_ = total - sum(cut.values()), [s for s in sizes if s not in cut]
        out = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_} if open_ else {}
        above = [s for s in open_ if out[s] > 3 * sizes[s]]
        if not above:
            return {**cut, **out}
        cut |= {s: 3 * sizes[s] for s in above}


def rows_of(seed):
    draw, rows = random.Random(seed), []
    for i in range(900):
        source = "hot" if i % 3 == 0 else draw.choice([None, "", "a", "é", "中", "tiny", "z"])
        n = draw.choice([0, 1, 1, 2, 5, 5, 17, 40, 120]) if source != "tiny" else 1
        rows.append((i, " \t".join(["w"] * n) if n or i % 2 else None, source))
    return rows + [(10_000, "w\n" * 30_000, "hot"), (10_001, "w " * 5_000, "a")] + [(77, "same text here", "z")] * 400 + [(None, "no id", "z")] * 2 + [(10_002, None, "void")]


@pytest.fixture(scope="module")
def mix(spark):
    rows = rows_of(3)
    return rows, source_mixing.mixed(frame(spark, rows), shared_folder(spark)).collect()


def test_every_document_once_with_its_size(mix):
    rows, got = mix
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"]) for r in got) == sorted((i if i is not None else -1, len((t or "").split())) for i, t, _ in rows)


def test_targets_equal_a_plain_loop(mix):
    rows, got = mix
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in order}
    expected = plain_targets(sizes)
    of = {i: s for i, _, s in rows}
    for r in got:
        assert r["source_size"] == sizes[of[r["doc_id"]]]
        assert math.isclose(r["target"], expected[of[r["doc_id"]]], rel_tol=1e-9, abs_tol=1e-9)


def test_words_taken_meet_targets_by_whole_copies(mix):
    rows, got = mix
    of = {i: s for i, _, s in rows}
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        s = of[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    for s in target:
        assert abs(taken[s] - target[s]) <= max(20, 0.002 * target[s]), (s, taken[s], target[s])
    assert taken["void"] == 0


def test_rates_are_the_exponential_tilt(spark):
    """The rate of a class is exp(a * size), cut at 3, with the one ``a`` that bisection over all documents finds."""
    histogram = spark.createDataFrame([("x", s, n) for s, n in ((0, 9), (1, 400), (7, 300), (50, 20), (900, 3))] + [("y", 4, 10)], "name string, size long, n long")
    words_of = {"x": 400 + 2100 + 1000 + 2700, "y": 40}
    for wanted in (0.05, 0.7, 1.0, 1.6, 2.9):
        sources = spark.createDataFrame([(k, v, v * wanted) for k, v in words_of.items()], "name string, source_size long, target double")
        found = {r["name"]: r["a"] / r["scale"] for r in source_mixing.tilted(histogram, sources, 3, shared_folder(spark), 2).collect()}
        rate = lambda a, s: math.exp(min(a * s, math.log(3)))
        for name, classes in (("x", ((1, 400), (7, 300), (50, 20), (900, 3))), ("y", ((4, 10),))):
            assert math.isclose(sum(s * n * rate(found[name], s) for s, n in classes), words_of[name] * wanted, rel_tol=1e-5)


def test_reruns_agree(spark, mix):
    rows, got = mix
    again = source_mixing.mixed(frame(spark, rows[::-1]).repartition(7), shared_folder(spark)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_small_inputs(spark):
    run = lambda rows: sorted(map(tuple, source_mixing.mixed(frame(spark, rows), shared_folder(spark)).collect()))
    assert run([]) == []
    assert run([(1, None, None)]) == [(1, 0, 0, 0.0, 0, 0)]
    assert run([(1, "a b", "s")]) == [(1, 2, 2, 2.0, 1, 2)]
