import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import frame
from veinwork.llm import byte_bpe, dac_store
from veinwork.llm.pieces import PieceCache, split

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "s", "'s", "'", "'ll", "'re", " ", "  ", "\n", "\t", "é", "ß", "中", "1", "٣", "!", "the", "ing", "\U0001f600", "\x1c", " ", "\u0085", "ab" * 40, "\r\n", "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    own = byte_bpe.vocabulary(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join))
def test_encode_equals_library(reference, text):
    own = byte_bpe.vocabulary(RANKS)
    ids = own.encode_text(text)
    assert ids == reference.encode_ordinary(text)
    assert own.decode(np.array(ids, np.int64))[0].tobytes() == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=200))
def test_tree_widths_agree(piece):
    own = byte_bpe.vocabulary(RANKS)
    long = own.encode_long(piece).tolist()
    flat, lengths = own.encode_pieces([piece[:60], piece])
    assert flat[: lengths[0]].tolist() == (own.encode_long(piece[:60]).tolist() if piece[:60] not in own.ranks else [own.ranks[piece[:60]]])
    assert flat[lengths[0] :].tolist() == ([own.ranks[piece]] if piece in own.ranks else long)


def test_run_of_documents(reference):
    draw = random.Random(2)
    texts = ["".join(draw.choices(ALPHABET, k=draw.randint(0, 30))) for _ in range(200)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    ids, counts = byte_bpe.vocabulary(RANKS).encode(data, offsets)
    at = np.cumsum([0, *counts])
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [reference.encode_ordinary(t) for t in texts]
    assert split(data, offsets)[2].sum() == len(split(data, offsets)[0])


def test_cache_is_bounded():
    calls = []

    def encode(pieces):
        calls.append(len(pieces))
        return np.array([len(p) for p in pieces], np.uint32), np.ones(len(pieces), np.int64)

    cache = PieceCache(encode, limit=3)
    data = np.frombuffer(b"aabbcaabb", np.uint8)
    starts = np.array([0, 2, 4, 5, 7])
    ids, each = cache.ids(data, starts, np.array([2, 4, 5, 7, 9]))
    assert ids.tolist() == [2, 2, 1, 2, 2] and each.tolist() == [1] * 5 and calls == [3]
    cache.ids(np.frombuffer(b"xyz", np.uint8), np.arange(3), np.arange(1, 4))
    assert len(cache.keys) == 3


def test_op3(spark, corpus, reference):
    found = {r["doc_id"]: r for r in byte_bpe.encode_documents(frame(spark, corpus), RANKS).collect()}
    for i, t in corpus:
        ids, r = reference.encode_ordinary(t or ""), found[i]
        assert (r["n_tokens"], r["ids"], r["decoded"]) == (len(ids), ids, t or "")
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(frame(spark, []), RANKS).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_codes(ids):
    codes = dac_store.Codes(dac_store.pack(np.array(ids, np.uint32)))
    assert codes.all().tolist() == ids
    for i in range(0, len(ids), 37):
        assert codes.get(i) == ids[i]
    with pytest.raises(IndexError):
        codes.get(len(ids))


def test_op10(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    path = f"file://{tmp_path}/ids"
    dac_store.write_ids(frame(spark, corpus), path, TOKENIZER, shard_ids=2000)
    found = {r["doc_id"]: r for r in dac_store.read_documents(spark, path).collect()}
    start, every = 0, []
    for i, t in corpus:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        r = found[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        every += ids
    for position in (0, 1, start // 2, start - 1):
        assert dac_store.read_token(spark, path, position) == every[position]
    with pytest.raises(IndexError):
        dac_store.read_token(spark, path, start)
    empty = f"file://{tmp_path}/none"
    dac_store.write_ids(frame(spark, []), empty, TOKENIZER)
    assert dac_store.read_documents(spark, empty).count() == 0
    odd = f"file://{tmp_path}/odd"
    dac_store.write_ids(frame(spark, [(None, "x"), (3, "y"), (3, "y")]), odd, TOKENIZER)
    assert sorted((r["doc_id"] or -1, r["start"]) for r in dac_store.read_documents(spark, odd).collect()) == [(-1, 0), (3, 2), (3, 4)]


def test_added_tokens_as_the_library_has_them(spark, tmp_path):
    from tokenizers import Tokenizer

    library, draw = Tokenizer.from_file(TOKENIZER), random.Random(6)
    assert 50256 in library.encode("end <|endoftext|> begin", add_special_tokens=False).ids
    texts = ["end <|endoftext|> begin", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a <|endof", "text|> b", "", "<|endoftext|", ">", None]
    texts += ["".join(draw.choices(ALPHABET, k=draw.randint(0, 30))) for _ in range(300)]
    path = f"file://{tmp_path}/added"
    dac_store.write_ids(frame(spark, list(enumerate(texts))), path, TOKENIZER)
    found = {r["doc_id"]: r for r in dac_store.read_documents(spark, path).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
