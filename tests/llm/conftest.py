import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, block int, doc string, n int, salt int, text_sha256 string, held_out int, row int, line int, prefix string"


def rows_of(texts, lang=None):
    return [(i, t, (lang or {}).get(i), "src0", len(t or ""), "d", 1, "x", 2, 3, "h", 0, 7, 8, "p") for i, t in texts]


def frame(spark, texts, lang=None):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame(rows_of(texts, lang), SCHEMA)


def words(draw, n):
    return " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Nulls, empty and very long texts, exact and near copies, shared passages, odd characters."""
    draw = random.Random(11)
    base = [words(draw, draw.randint(60, 160)) for _ in range(24)]
    passage = words(draw, 60)
    texts = [None, "", " \n\t ", "one", "two words", "Two Words", "a b c d e", "éß 中文 \U0001f600 don't 'll x's  end ", "word " * 30, words(draw, 6000)]
    texts += base
    for i in range(8):  # near copies: one word changed
        parts = base[i].split(" ")
        parts[len(parts) // 2] = "changed"
        texts += [" ".join(parts), base[i].upper()]
    texts += [base[0]] * 5 + [f"{words(draw, 30)} {passage} {words(draw, 40)}" for _ in range(6)]
    return list(enumerate(texts, 1))
