import hashlib
import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

import corpus_pipeline
from tests.llm.conftest import words
from tests.llm.test_dedup_and_joins import expected_components, tokens
from tests.llm.test_tokens import RANKS
from veinwork.llm import byte_bpe, language_id, workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_against_brute_force(spark, corpus, tmp_path):
    draw = random.Random(21)
    items = [(k, words(draw, 30)) for k in range(5)]
    texts = [*corpus, *[(3000 + k, f"{words(draw, 40)}\n{item}\n{words(draw, 10)}") for k, item in items], (4000, "12345 !!"), (4001, None)]
    spark.createDataFrame([(i, t, draw.choice(["en", "fr"]), "s", len(t or "")) for i, t in texts], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(i, t) for i, t in texts if t and any(c.isalpha() for c in t)]
    left = [(i, t) for i, t in left if i == max(j for j, u in left if u == t)]
    component = expected_components(left)
    left = [(i, t) for i, t in left if component[i][1] == i]
    left = [(i, t) for i, t in left if not any(" ".join(tokens(item)) in " ".join(tokens(t)) for _, item in items)]
    assert set(found) == {i for i, _ in left}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.vocabulary(RANKS).ranks, special_tokens={})
    for i, t in left:
        ids = encoding.encode_ordinary(t)
        assert found[i]["n_tokens"] == len(ids) and found[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_stages_are_the_five_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "decontaminate", "byte_bpe"]


def test_language_stage_gives_memory_back(spark, monkeypatch):
    """When a task of the stage ends, the trees go, and free memory with them."""
    calls = []
    monkeypatch.setattr(language_id, "released", lambda: calls.append("_value" in kept.__dict__))
    kept = SimpleNamespace(_value=1, value=SimpleNamespace(code_lengths=lambda data, offsets: np.zeros((len(offsets) - 1, 2))))
    docs = SimpleNamespace(columns=["text"], schema=None, sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda trees: kept)))
    docs.filter, docs.mapInArrow = lambda condition: docs, lambda rows, schema: rows
    rows = language_id.known(docs, object())
    assert [b.num_rows for b in rows(iter([pa.RecordBatch.from_arrays([pa.array(["one text", "another"])], ["text"])]))] == [2]
    assert calls == [False] and "_value" not in kept.__dict__


def test_stages_take_small_batches(spark, tmp_path):
    """Rows come to workers in batches of 4 MB at most, whatever the session had; a smaller bound stays."""
    rows = [(k, "some words of a long text " * 400, "en", "s", 1) for k in range(2000)]  # 20 MB
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get(workspace.BATCH_BYTES)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    try:
        for was, most in (("256m", 5 << 20), ("512k", 1 << 20)):
            spark.conf.set(workspace.BATCH_BYTES, was)
            byte_bpe.token_table(spark, docs, str(tmp_path))
            assert max(r["size"] for r in docs.coalesce(1).mapInArrow(sizes, "size long").collect()) <= most
    finally:
        spark.conf.set(workspace.BATCH_BYTES, before)


def test_workers_give_memory_back(monkeypatch):
    """When the task ends, each time."""
    calls = []
    monkeypatch.setattr(workspace, "released", lambda: calls.append("back"))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one text", None])], ["doc_id", "text"])

    def batches():
        for _ in range(2):
            calls.append("taken")
            yield batch

    assert sum(b.num_rows for b in byte_bpe._encoded(RANKS, False)(batches())) == 4
    assert calls == ["taken", "taken", "back"]
