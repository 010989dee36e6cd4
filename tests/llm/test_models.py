import hashlib
import itertools
import math
import random
import re
import time
import tracemalloc
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import frame, words
from tests.llm.test_dedup_and_joins import tokens
from tests.llm.test_tokens import RANKS
from veinwork.llm import attention_model, byte_bpe, decontaminate, language_id, license_scan, lm_scoring, personal_data, workspace
from veinwork.llm.textbatch import word_hashes


def test_context_trees_are_distributions():
    trees = language_id.ContextTrees({"x": [b"abracadabra abra"], "y": [b"zigzag zig zag"]})
    for context in (b"abr", b"zzz", b"qqq"):
        total = np.zeros(2)
        for byte in range(256):
            data = np.frombuffer(context + bytes([byte]), np.uint8)
            ends = np.array([0, 3, 4])
            whole = trees.code_lengths(data, np.array([0, 4]))[0]
            before = trees.code_lengths(data, ends[:2])[0] if False else trees.code_lengths(data[:3], np.array([0, 3]))[0]
            total += np.exp2(before - whole)
        assert np.allclose(total, 1, atol=1e-3)


def slow_bits(trees, text):
    """Code length byte by byte through the same tables."""
    out = np.zeros(len(trees.languages))
    padded = b"\n\n\n" + text
    for i in range(len(text)):
        key = 0
        for back in range(language_id.ORDER, 0, -1):
            key = key << trees.bits | int(trees.symbol[padded[i + 3 - back]])
        out += trees.table[trees.longest[key] * trees.size + trees.symbol[padded[i + 3]]]
    return out


def test_languages_of_long_texts_only_are_learned(spark):
    """Texts within the bound come first; a language without any has its shortest ones, whole, as far as its characters go."""
    ids = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = [(i, "abcd ef" * 40) for i in ids[:6]] + [(i, "wxyz uv" * (100 + i)) for i in ids[6:12]] + [(ids[12], "ghij " * 9), (ids[13], "ghij " * 2000)]
    lang = {i: "en" for i in ids[:6]} | {i: "fr" for i in ids[6:12]} | {ids[12]: "de", ids[13]: "de"}
    docs = frame(spark, texts, lang)
    found = language_id.sample(docs, 3, 300)
    assert {k: len(v) for k, v in found.items()} == {"en": 3, "fr": 1, "de": 1} and found["fr"] == [("wxyz uv" * (100 + ids[6])).encode()]
    assert sorted(len(t) for t in language_id.sample(docs, 3, 600)["fr"]) == [len("wxyz uv" * (100 + i)) for i in ids[6:8]]
    assert language_id.train(docs, 3, 300).languages == ["de", "en", "fr"]
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.train(docs, 3, 300)).filter("doc_id = %d" % ids[11]).collect()} == {"fr"}


def test_language_id(spark):
    draw = random.Random(4)
    kinds = {"aa": "abcd ef", "bb": "wxyz uv"}
    texts, lang = [], {}
    for i in range(1, 121):
        name = draw.choice(["aa", "bb"])
        texts.append((i, "".join(draw.choices(kinds[name], k=draw.randint(5, 300)))))
        lang[i] = name if i % 9 else None
    true = {i: ("aa" if t.strip(" ") and t.strip(" ")[0] in "abcdef" else "bb") for i, t in texts}
    texts += [(500, None), (501, ""), (502, "123 !"), (None, "abab abab")]
    docs = frame(spark, texts, lang)
    trees = language_id.train(docs)
    found = {r["doc_id"]: r for r in language_id.identify(docs, trees).collect()}
    held = [i for i in true if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(found[i]["held_out"] == (i in held) for i in true)
    assert sum(found[i]["lang_pred"] == true[i] for i in held) >= 0.95 * len(held)
    assert {found[i]["lang_pred"] for i in (500, 501, 502)} == {"und"} and found[None]["lang_pred"] == "aa"
    for i, t in texts[:5]:
        bits = slow_bits(trees, t.encode())
        assert found[i]["lang_pred"] == trees.languages[int(bits.argmin())] and abs(found[i]["bits_per_byte"] - bits.min() / len(t)) < 1e-3
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.train(frame(spark, [(1, "x")])) is None
    kept = language_id.known_languages(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in texts} - {500, 501, 502}
    assert language_id.identify(frame(spark, []), trees).count() == 0
    assert language_id.known(docs, None).count() == 0


def test_fingerprints():
    draw = np.random.default_rng(1)
    hashes = draw.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2) + draw.integers(0, 2, 400).astype(np.uint64)
    for width in (1, 5, 17, 60, 127, 128, 400):
        bits = 8 if width <= 127 else 16
        found = decontaminate.Sums(hashes).fingerprints(width)
        for start in range(0, 400 - width + 1, 71):
            window = hashes[start : start + width]
            for bit in range(64):
                # lane j of sum k is bit j of field k, a field having as many bits as a word has lanes; it lands on that lane's bit k
                j, k = divmod(bit, bits)
                count = sum(int(w) >> (64 // bits * k + j) & 1 for w in window)
                assert int(found[start]) >> bit & 1 == (count > width // 2)


def test_blocks_find_all_within_radius():
    """All fingerprints of any number of items within the radius, and no others."""
    draw = random.Random(9)
    items = decontaminate.Items([(k, words(draw, 40)) for k in range(30)])
    for width, (prints, orders, starts, _) in items.classes.items():
        probes = prints.tolist()
        for p in prints.tolist():
            for _ in range(20):
                q = p
                for bit in draw.sample(range(64), draw.randint(0, decontaminate.RADIUS + 2)):
                    q ^= 1 << bit
                probes.append(q)
        found = {pair for at, which in decontaminate.Items.near(np.array(probes, np.uint64), prints, orders, starts) for pair in zip(at.tolist(), which.tolist())}
        assert found == {(i, j) for i, q in enumerate(probes) for j, p in enumerate(prints.tolist()) if (p ^ q).bit_count() <= decontaminate.RADIUS}, width


def test_recall_of_edited_items_by_length():
    """Edited copies whose similarity is 0.8 or more are found as brute force finds them."""
    draw = random.Random(77)
    for n in (9, 15, 25, 40, 59, 100, 180):
        found = tried = 0
        while tried < 30:
            item = words(draw, n).split(" ")
            copy = list(item)
            for _ in range(draw.randint(1, max(1, n // 25))):
                at = draw.randrange(len(copy))
                copy[at : at + draw.randint(0, 1)] = draw.choice([[], ["changed"]])
            if best_stretch(item, copy)[0] < decontaminate.SIMILARITY:
                continue
            tried += 1
            found += bool(searched(" ".join(item), " ".join(copy)))
        assert found >= 0.9 * tried, (n, found, tried)


def test_decontamination(spark, corpus):
    draw = random.Random(8)
    items = [(1, words(draw, 36)), (2, words(draw, 14)), (3, words(draw, 150)), (4, None), (5, "tiny item"), (6, words(draw, 59))]
    texts = [(i + 10000, t) for i, t in corpus]
    edited = items[5][1].split(" ")
    edited[0] = "other"
    hits = {
        1: f"{words(draw, 30)} {items[0][1].upper()} {words(draw, 9)}", 2: items[1][1], 3: f"x {items[2][1]}\n{items[0][1]}", 4: "Tiny  Item", 5: f"{words(draw, 5)} {' '.join(edited)} {words(draw, 5)}",
        6: "tiny item here", 7: " ".join(items[2][1].split(" ")[:70]),
    }
    docs = frame(spark, texts + list(hits.items()))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(docs, benchmark)
    pairs = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert pairs == {(1, 1), (2, 2), (3, 3), (3, 1), (4, 5), (5, 6), (6, 5)}  # items of a few words count inside documents too
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark, item_words=20).collect()} == pairs
    for size in (20, 10**6):
        kept = decontaminate.clean(docs, benchmark, item_words=size)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in pairs}
    assert all(r["similarity"] == 1.0 for r in found.filter("doc_id < 5").collect())
    assert decontaminate.contaminated(docs, benchmark.filter("false")).count() == 0 == decontaminate.contaminated(docs.filter("false"), benchmark).count()


def test_short_items_at_every_place(spark):
    """Items of one to four words, against a plain search of word lists; equal items, repeats, and ends of documents."""
    draw = random.Random(17)
    small = lambda n: " ".join(draw.choice("abcd") for _ in range(n))
    items = [(k, small(1 + k % 4)) for k in range(12)] + [(50, "a b"), (51, "A\tb"), (52, "zz")]
    texts = [(k, small(draw.randint(1, 9))) for k in range(60)] + [(100, None), (101, ""), (102, "b"), (103, "a"), (104, "xa b")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    places = lambda text, item: [k for k in range(len(text) - len(item) + 1) if text[k : k + len(item)] == item]
    expected = set()
    for d, t in texts:
        for i, item in items:
            at = places((t or "").lower().split(), item.lower().split())
            if at:
                expected.add((d, i, 1.0, at[0], len(item.split())))
    got = decontaminate.contaminated(frame(spark, texts), benchmark).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def searched(item, passage):
    """Matches of one item in a document with 20 words before and after the passage."""
    around = random.Random(32)
    raw = np.frombuffer(f"{words(around, 20)} {passage} {words(around, 20)}".encode(), np.uint8)
    return list(decontaminate.Items([(1, item)]).search(*word_hashes(raw, np.array([0, len(raw)]))))


def test_items_without_first_and_last_word():
    draw = random.Random(31)
    for n in (20, 25, 30, 38, 48, 59, 100, 300, 600):
        for _ in range(10):
            item = words(draw, n).split(" ")
            assert [h[:2] for h in searched(" ".join(item), " ".join(item[1:-1]))] == [(0, 0)], n


def best_stretch(item, text):
    """Highest multiset Jaccard of all stretches of a text, with the first and longest of them."""
    bags = [Counter(tuple(t[k : k + 5]) for k in range(len(t) - 4)) for t in (item, text)]
    top = (0, 0, 0)
    for a in range(len(text) - 4):
        bag = Counter()
        for b in range(a + 5, len(text) + 1):
            bag[tuple(text[b - 5 : b])] += 1
            top = max(top, ((bag & bags[0]).total() / (bag | bags[0]).total(), -a, b - a))
    return top[0], -top[1], top[2]


def test_decontamination_of_edited_items():
    draw = random.Random(33)
    kinds = Counter()
    for n in (5, 6, 7, 8, 12, 20, 36, 59, 59, 100):
        for _ in range(25):
            item = words(draw, n).split(" ")
            if draw.random() < 0.3:
                item[n // 3 : n // 3 + 6] = item[:6]  # shingles that occur twice
            text, size, at = list(item), draw.randint(0, n // 8), draw.randrange(n)
            text[at : at + size * draw.randrange(2)] = words(draw, size).split(" ") if size and draw.random() < 0.7 else []
            around = random.Random(32)
            whole = [*words(around, 20).split(" "), *text, *words(around, 20).split(" ")]
            expected = best_stretch(item, whole)
            found = [h[2:] for h in searched(" ".join(item), " ".join(text))]
            assert found == ([expected] if expected[0] >= 0.8 else []), (n, size, at)
            kinds[bool(found), len(text) - n > 2] += 1
    assert min(kinds[True, True], kinds[True, False], kinds[False, False]) >= 5


def brute_spans(text):
    out = []
    for kind, pattern in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")) or kind == 2 and not (16 <= len(digits) <= 19 and personal_data.luhn(digits)) or kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "1", "+", "23", " ", "(", ")", "-", "b.c", "_", "255", "256", "@x.y", "4111 1111 1111 1111", "é", "%"]), max_size=16).map("".join))
def test_base_spans(text):
    assert personal_data.base_spans(text) == brute_spans(text)


def test_personal_data(spark, corpus):
    texts = corpus + [(900 + i, f"é mail a{i}.b@x{i}.example.com, call +1 (555) 010-99{i:02d} from 10.0.0.{i} card 4111-1111-1111-1111 {'x' * i}") for i in range(30)]
    texts += [(1000 + i, f"contact e-mail: joe{i} (at) mail (dot) com ok") for i in range(5)] + [(1100, "version 1.2.3.4567 4111-1111-1111-1112")]
    found = {r["doc_id"]: r for r in personal_data.personal_data(frame(spark, texts)).collect()}
    for i, t in texts:
        spans, r = brute_spans(t or ""), found[i]
        listed = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(k == j for k, _, _ in spans) for j in range(4)]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
    assert all(found[i]["spans"] == "" for i, _ in corpus)
    assert personal_data.personal_data(frame(spark, [])).count() == 0


def test_added_spans():
    """Trained on loose mentions with cues and on look-alikes without: held-out mentions are added, look-alikes are not, and added spans do not overlap."""
    draw = random.Random(5)
    right = lambda: f"e-mail: {draw.choice(['joe', 'ana', 'li'])}{draw.randint(1, 99)} (at) {words(draw, 1)} (dot) com, thanks"
    wrong = lambda: f"version {words(draw, 1)}_at {words(draw, 1)} {draw.randint(1000, 9999)}-{draw.randint(1000, 9999)}-{draw.randint(1000, 9999)}-{draw.randint(1000, 9999)}/x"
    plain = lambda: f"mail {words(draw, 1)}@{words(draw, 1)}.com"
    texts = [right() for _ in range(200)] + [wrong() for _ in range(200)] + [plain() for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    [found] = personal_data._found([batch])
    counts = Counter(code for more in found.column(2).to_pylist() for code in more[3::4])
    model = personal_data.SpanClassifier(counts)
    accepted = {c for c, p in model.table.items() if p >= personal_data.THRESHOLD}
    added = [sum(more[k + 3] in accepted and more[k : k + 3] not in [base[j : j + 3] for j in range(0, len(base), 3)] for k in range(0, len(more), 4)) for base, more in zip(found.column(1).to_pylist(), found.column(2).to_pylist())]
    assert sum(n > 0 for n in added[:200]) >= 180 and sum(added[200:400]) == 0 and sum(added[400:]) == 0


def test_many_spans_in_a_text_take_linear_time():
    times = []
    for n in (2000, 8000):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["".join(f"a{i}@b.com 555 123-4567 ({i}) " for i in range(n))])], ["doc_id", "text"])
        began = time.process_time()
        list(personal_data._found([batch]))
        times.append(time.process_time() - began)
    assert times[1] < 9 * times[0] + 0.2


def test_vote_model():
    counts = {personal_data.pattern(0, [1, 1, 1, 1, 1]): 50, personal_data.pattern(0, [0, 1, 1, 1, 1]): 10, personal_data.pattern(2, [0, -1, -1, -1, -1]): 80}
    table = personal_data.SpanClassifier(counts).table
    codes = list(counts)
    assert table[codes[0]] > 0.9 and table[codes[2]] < 0.1
    assert [personal_data.unpack(c)[0] for c in codes] == [0, 0, 2]
    assert personal_data.SpanClassifier({}).table == {}


def test_licences(spark, corpus):
    given_lines = {1: ("mit", "Released under the MIT License."), 2: ("gpl", "This work is licensed under the GNU General Public License, version 3."), 3: ("apache-2.0", "Licensed under the Apache License, Version 2.0."), 4: ("cc-by-nc", "Licensed under CC BY-NC 4.0."), 5: ("proprietary", "All rights reserved.")}
    texts = [(i + 100, t) for i, t in corpus] + [(i, f"some plain words\n{line}\nmore words here") for i, (_, line) in given_lines.items()] + [(6, "the License of the library"), (7, "\n\n")]
    docs = frame(spark, texts)
    model = license_scan.train(docs)
    assert model.held_out_accuracy > 0.95
    found = license_scan.licences(docs, model)
    rows = {(r["doc_id"], r["line"]): r for r in found.collect()}
    for i, (family, _) in given_lines.items():
        assert (rows[i, 1]["family"], rows[i, 1]["confirmed"]) == (family, True)
    assert {d for d, _ in rows} <= set(given_lines) | {6}
    assert license_scan.licences(docs.filter("false"), model).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_unknown_licences(spark):
    """Licences that no template has are unknown or none; all templates, alone and among other words, are known."""
    draw = random.Random(1)
    model = license_scan.LicenceModel([words(draw, 12) for _ in range(600)])
    assert model.unknown_accuracy > 0.85
    unseen = [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Distributed under the Boost Software License, Version 1.0.",
        "This is free and unencumbered software released into the public domain.", "Licensed under the EUPL, Version 1.2 or later.", "Licensed under the Artistic License 2.0.",
        "Do what you want to public license", "Released under the zlib License.", "Licensed under the Common Development and Distribution License, Version 1.0",
    ]
    known = [(f, t) for f, family in license_scan.TEMPLATES.items() for t in family]
    rows = [(i, t) for i, t in enumerate(unseen)] + [(100 + i, t) for i, (_, t) in enumerate(known)] + [(1000 + i, f"{words(draw, 3)} {t} {words(draw, 3)}") for i, (_, t) in enumerate(known)]
    found = {r["doc_id"]: (r["family"], r["confirmed"]) for r in license_scan.licences(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(found.get(i, (license_scan.UNKNOWN, False)) == (license_scan.UNKNOWN, False) for i in range(len(unseen)))
    assert all(found[100 + i] == (f, True) for i, (f, _) in enumerate(known))
    assert sum(found.get(1000 + i, ("", 0))[0] == f for i, (f, _) in enumerate(known)) >= 0.9 * len(known)


def test_licence_model_by_hand(spark):
    model = license_scan.LicenceModel(["plain words of a text", "and another line"])
    line = "Licensed under the Mozilla Public License, Version 2.0."
    grams = [model.grams.index(g) for g in license_scan.bigrams(line)]
    z = model.weights[grams].sum(0) + model.weights[-1]
    row = license_scan.licences(spark.createDataFrame([(1, line)], "doc_id long, text string"), model).first()
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert (row["family"], row["similarity"]) == (model.classes[int(z.argmax())], 1.0) and abs(row["probability"] - p.max()) < 1e-9


def small_model(steps=30):
    """Ids 1-4 follow each other, 9 ends a text; 1 and 3 begin words."""
    draw = np.random.default_rng(0)
    sequences = [np.append(np.tile([1, 2, 3, 4], 20)[draw.integers(0, 4) :], 9) for _ in range(20)]
    ids, counts = np.concatenate(sequences), np.array([len(s) for s in sequences])
    model = attention_model.AttentionModel(np.bincount(ids, minlength=10), 9, np.isin(np.arange(10), [1, 3, 9]))
    model.train(ids, counts, steps, batch=16)
    return model


def test_attention_learns_and_is_causal():
    model = small_model(80)
    assert np.mean(model.losses[-10:]) < 0.5 * np.mean(model.losses[:5])
    ids = np.append(np.tile([1, 2, 3, 4], 30), 9)
    whole = model.scores(ids, np.array([len(ids)]))[0]
    changed = ids.copy()
    changed[70:] = 5
    again = model.scores(changed, np.array([len(ids)]))[0]
    assert np.allclose(whole[:70], again[:70], atol=1e-4) and not np.allclose(whole[70:], again[70:])
    assert np.allclose(model.scores(ids, np.array([len(ids)]), rows=2)[0], whole, atol=1e-4)


def test_each_id_is_scored_once_as_by_hand():
    model = small_model()
    ids = np.array([1, 2, 3, 4] * 11 + [9] + [2, 3] + [9])
    counts = np.array([45, 3])
    value, edge = model.scores(ids, counts)
    assert (value < 0).all() and (edge < 0).all()
    p = model.p
    for doc, begin in ((0, 0), (1, 45)):
        own = ids[begin : begin + counts[doc]]
        inputs = np.append(9, own[:-1])
        for t in range(len(own)):
            lo = max(0, t // attention_model.STEP * attention_model.STEP - attention_model.STEP)
            place = np.arange(lo, t + 1) - (t // attention_model.STEP * attention_model.STEP - attention_model.STEP)
            e = p["E"][model.slot[inputs[lo : t + 1]]] + p["P"][place]
            s = (e[-1] @ p["Q"]) @ (e @ p["K"]).T * attention_model.WIDTH**-0.5
            a = np.exp(s - s.max())
            h = e[-1] + (a / a.sum()) @ (e @ p["V"]) @ p["O"]
            h = h + np.maximum(h @ p["F"] + p["f"], 0) @ p["G"]
            soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            upper = soft(h @ p["A"] + p["a"])
            cluster, member = divmod(int(model.of[own[t]]), attention_model.MEMBERS)
            expected = np.log(upper[cluster]) + np.log(soft(h @ p["W"][cluster] + p["w"][cluster])[member]) + model.share[own[t]]
            assert abs(expected - value[begin + t]) < 2e-3
            assert abs(np.log(upper[: attention_model.BOUNDARY].sum()) - edge[begin + t]) < 2e-3


def test_gradients():
    """Of the two-level output, against differences."""
    model = small_model(5)
    draw = np.random.default_rng(2)
    h = draw.standard_normal((12, attention_model.WIDTH))
    y = model.of[draw.integers(1, 5, 12)]
    for k in "AaWw":
        model.p[k] = model.p[k].astype(float)
    loss, dh, g = model._output_gradients(h, y)
    for k in ("A", "a", "W", "w", None):
        x, grad = (h, dh) if k is None else (model.p[k], g[k])
        for at in [tuple(draw.integers(0, s) for s in x.shape) for _ in range(5)] + [np.unravel_index(np.abs(grad).argmax(), grad.shape)]:
            held, out = x[at], []
            for step in (1e-5, -1e-5):
                x[at] = held + step
                out.append(model._output_gradients(h, y)[0])
            x[at] = held
            assert abs((out[0] - out[1]) / 2e-5 - grad[at]) < 1e-5


def test_word_probabilities_sum_to_one():
    """Words of one to four subwords and the end, after one history: 1 at most, and nearly so."""
    model = small_model(40)
    history = [1, 2, 3, 4, 1]
    total, inner = 0.0, [0, 2, 4, 5, 6, 7, 8]
    first = [1, 3]
    texts = [[*history, f, *more, 9] for f in first for n in range(4) for more in itertools.product(inner, repeat=n)] + [[*history, 9]]
    value, edge = model.scores(np.concatenate(texts), np.array([len(t) for t in texts]))
    ends = np.cumsum([len(t) for t in texts]) - 1
    for t, e in zip(texts, ends.tolist()):
        begin = e - len(t) + 1 + len(history)
        total += math.exp(value[begin:e].sum() - edge[begin] + edge[e]) if begin < e else math.exp(value[e] - edge[e])
    assert 0.9 < total <= 1 + 1e-4


def test_words_and_ends_add_up():
    """Word scores of a text are the ids' own, but for boundaries that are counted once."""
    bpe = lm_scoring.vocabulary(RANKS)
    end = len(bpe.token_length)
    boundary = np.append(bpe.token_bytes[np.minimum(bpe.token_begin, len(bpe.token_bytes) - 1)] == 0x20, True)
    model = attention_model.AttentionModel(np.ones(end + 1), end, boundary)
    raw = np.frombuffer("Unbelievable things, don't they; \u00a0 \u00a0 x".encode() + b"a second one", np.uint8)
    offsets = np.array([0, len(raw) - 12, len(raw), len(raw)])
    starts, ends, counts = lm_scoring.spans(raw, offsets)
    of_word, of_end = lm_scoring.word_scores(bpe, model, raw, starts, ends, counts)
    text, begins = lm_scoring.normalised(raw, starts, ends, counts)
    ids, _, each = lm_scoring.subwords(bpe, text, begins)
    value, edge = model.scores(np.insert(ids.astype(np.int64), np.cumsum(each), end), each + 1)
    at, word = np.cumsum(each + 1) - each - 1, np.concatenate([[0], np.cumsum(counts)])
    for k in range(3):
        mine = of_word[word[k] : word[k + 1]]
        assert abs(mine[np.isfinite(mine)].sum() + of_end[k] - (value[at[k] : at[k] + each[k] + 1].sum() - edge[at[k]])) < 1e-6
    assert len(of_end) == 3 and len(of_word) == counts.sum()


def test_models_of_shards_are_averaged(spark, tmp_path):
    alphabet = "the of and to in that was for with his".split(" ")
    docs = frame(spark, [(i, " ".join(alphabet[(i + k) % 10] for k in range(200))) for i in range(1, 200)])
    one, aside = lm_scoring.train_model(lm_scoring.blocked(docs, "doc_id", "text", 16), RANKS, f"file://{tmp_path}/one")
    many, _ = lm_scoring.train_model(lm_scoring.blocked(docs, "doc_id", "text", 16), RANKS, f"file://{tmp_path}/many", shard=2)
    bpe = lm_scoring.vocabulary(RANKS)
    raw, offsets = lm_scoring.texts(pa.array(aside))
    starts, ends, counts = lm_scoring.spans(raw, offsets)
    before = lm_scoring.word_scores(bpe, attention_model.AttentionModel(np.ones(len(bpe.token_length) + 1), one.end, np.arange(len(bpe.token_length) + 1) == one.end), raw, starts, ends, counts)[0].mean()
    for model in (one, many):
        assert lm_scoring.word_scores(bpe, model, raw, starts, ends, counts)[0].mean() > -2 > before


def test_every_window_is_learned_from(monkeypatch, spark, tmp_path):
    """Each window of the training texts is in one shard of one round or set aside, and each id in one step of a long enough shard."""
    docs = lm_scoring.blocked(frame(spark, [(i, f"text {i} of two thousand, which are more than a sample") for i in range(2000)]), "doc_id", "text", 512)
    out = str(tmp_path / "seen")

    def shard(path, model, steps, rate):
        def rows(table):
            with open(f"{out}-{uuid.uuid4().hex}", "w") as file:
                file.write("\n".join(table["id"].to_pylist()))
            return pa.table({"shard": table["shard"][:1], "weight": pa.array([float(len(table))]), "values": pa.array([model.value[1].tobytes()], pa.binary())})

        return rows

    monkeypatch.setattr(lm_scoring, "_shard", shard)
    monkeypatch.setattr(lm_scoring, "ASIDE", 30)
    _, aside = lm_scoring._trained(docs, RANKS, f"file://{tmp_path}/one", shard=500)
    learned = [x for p in tmp_path.glob("seen-*") for x in p.read_text().split("\n")]
    wanted = {f"{r['doc_id']}:0": r["text"] for r in docs.filter("NOT held_out").collect()}
    assert len(learned) == len(set(learned)) and set(learned) <= set(wanted) and 0 < len(aside) < 100
    assert sorted([t for t, _ in aside] + [wanted[x] for x in learned]) == sorted(wanted.values())
    model = small_model(1)
    picked = []
    monkeypatch.setattr(model, "_batch", lambda padded, first, size, past, own=model._batch: picked.append(first) or own(padded, first, size, past))
    model.train(np.tile([1, 2, 3, 9], 1000), np.full(1000, 4), 1)
    assert sorted(np.concatenate(picked).tolist()) == list(range(0, 4000, 4))


def test_words_are_counted_and_heaps_are_empty_before_training(monkeypatch, spark, corpus, tmp_path):
    class Reached(Exception):
        pass

    done = []

    def noted(df, path):
        done.append(path.rsplit("/", 1)[-1])
        if done[-1].startswith("models"):
            raise Reached
        return workspace.written(df, path)

    def train(docs, path, folder):
        raise Reached

    monkeypatch.setattr(lm_scoring, "written", noted)
    monkeypatch.setattr(lm_scoring, "rested", lambda spark: done.append("rested"), raising=False)
    docs = lm_scoring.blocked(frame(spark, corpus), "doc_id", "text", 512)
    done.clear()
    with pytest.raises(Reached):
        lm_scoring._trained_and_met(docs, RANKS, f"file://{tmp_path}/one")
    assert done == ["rested", "models0"]
    monkeypatch.setattr(lm_scoring, "_trained_and_met", train)
    done.clear()
    with pytest.raises(Reached):
        lm_scoring.score_documents(frame(spark, corpus), RANKS)
    assert done == ["documents", "rested", "blocks", "counts"]


def test_lm_scoring(spark, corpus):
    texts = corpus + [(None, "one two")]
    found = lm_scoring.score_documents(frame(spark, texts), RANKS, block_rows=16)
    rows = {r["doc_id"]: r for r in found.collect()}
    held = {i for i, _ in corpus if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter(w for i, t in texts if i not in held for w in [*tokens(t), None])
    total, distinct = sum(counts.values()), len(counts)
    for i, t in texts:
        w, r = [*tokens(t), None], rows[i]
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(w), sum(counts[x] > 0 for x in w), total)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
    assert lm_scoring.score_documents(frame(spark, []), RANKS).count() == 0


def test_frequent_ids_are_classes_of_their_own():
    boundary = np.arange(2000) < 1000
    of = attention_model.classes(np.arange(2000, 0, -1), boundary)
    edge = attention_model.BOUNDARY * attention_model.MEMBERS
    assert len(set(of[:560].tolist())) == 560 and len(set(of[560:1000].tolist())) == 80 and of[:1000].max() < edge
    assert len(set(of[1000:1336].tolist())) == 336 and len(set(of[1336:].tolist())) == 48 and of[1000:].min() >= edge and of.max() < 1024


def test_model_share_is_the_likeliest():
    draw = np.random.default_rng(3)
    base, model = draw.random(4000), draw.random(4000) ** 2
    found = lm_scoring.best_share(base, model)
    grid = np.linspace(0.001, 0.999, 999)
    assert abs(found - grid[np.argmax([np.log((1 - g) * base + g * model).sum() for g in grid])]) < 0.01
    assert lm_scoring.best_share(base, base * 100) > 0.99 and lm_scoring.best_share(base, base / 100) < 0.01


def test_learning_costs_a_few_times_scoring():
    """In one process and the best of three: some three times, and five to six before."""
    draw = np.random.default_rng(4)
    ids, counts = np.minimum(draw.zipf(1.3, 40000), 20000).astype(np.int64), np.full(50, 800)
    model = attention_model.AttentionModel(np.bincount(ids, minlength=20002), 20001, np.arange(20002) % 2 == 1)

    def least(run):
        took = []
        for _ in range(3):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: model.train(ids, counts, 1)) < 4.2 * least(lambda: model.scores(ids, counts))


def test_scores_before_learning_are_noted():
    """Of every id once, by the model before the step that first learns from it."""
    model = small_model()
    ids, counts = np.tile([1, 2, 3, 4, 1, 2, 9], 60), np.full(60, 7)
    expected = model.scores(ids, counts)
    logs = np.full(len(ids), np.nan), np.full(len(ids), np.nan)
    model.train(ids, counts, 12, (0.0, 0.0), batch=16, logs=logs)
    for mine, wanted in zip(logs, expected):
        assert np.allclose(mine, wanted, atol=1e-3)
    again = np.full(len(ids), np.nan), np.full(len(ids), np.nan)
    model.train(ids, counts, 12, (0.01, 0.01), batch=16, logs=again)
    assert np.isfinite(again[0]).all() and np.isfinite(again[1]).all() and not np.allclose(again[0], model.scores(ids, counts)[0], atol=1e-3)


def test_share_comes_from_all_windows_of_later_rounds(monkeypatch, spark, tmp_path):
    monkeypatch.setattr(lm_scoring, "ASIDE", 5)
    monkeypatch.setattr(lm_scoring, "STEPS", 8)
    docs = lm_scoring.blocked(frame(spark, [(i, f"{'common ' * (1 + i % 3)}text{i} of many") for i in range(1, 400)]), "doc_id", "text", 512)
    model, aside, met = lm_scoring._trained_and_met(docs, RANKS, f"file://{tmp_path}/one", shard=40)
    met = met.toPandas()
    number = {i: 4 - 1 + i % 3 + 1 for i in range(1, 400)}
    later = spark.createDataFrame([(f"{i}:0",) for i in number], "id string").filter(f"pmod(xxhash64('round', id), {lm_scoring.ROUNDS}) > 0")
    own = {int(t.split("text")[1].split()[0]) for t, _ in aside}
    train = {r["doc_id"] for r in docs.filter("NOT held_out").collect()} - own
    wanted = {int(r["id"].split(":")[0]) for r in later.collect()} & train
    assert len(aside) < 30 < len(wanted) and met["n"].sum() == sum(number[i] for i in wanted)
    common = met[met["word"] == met.groupby("word")["n"].sum().idxmax()]
    assert set(met["own"]) == {1, 2, 3} and common.groupby("own")["n"].sum().to_dict() != {} and (met["level"] >= 0).all()


def test_words_before_learning_agree_with_word_scores():
    bpe = lm_scoring.vocabulary(RANKS)
    end = len(bpe.token_length)
    boundary = np.append(bpe.token_bytes[np.minimum(bpe.token_begin, len(bpe.token_bytes) - 1)] == 0x20, True)
    model = attention_model.AttentionModel(np.ones(end + 1), end, boundary)
    windows = ["Unbelievable things, things and so", "a second one", "", "cut in the mid"]
    finals = [True, True, True, False]
    ids, counts = lm_scoring._sequences(windows, finals, bpe, end)
    met = lm_scoring._met_words(windows, finals, bpe, *model.scores(ids, counts), counts)
    raw, offsets = lm_scoring.texts(pa.array(windows))
    starts, ends, number = lm_scoring.spans(raw, offsets)
    scores, _ = lm_scoring.word_scores(bpe, model, raw, starts, ends, number)
    hashes = lm_scoring.span_hashes(raw, starts, ends).view(np.int64)[:-1]  # no one knows where the last word ends
    for word in set(hashes.tolist()):
        mine = met[met["word"] == word]
        assert mine["n"].sum() == (hashes == word).sum() and (mine["own"] == (hashes == word).sum()).all()
        assert np.allclose(np.sort(np.repeat(mine["level"], mine["n"])), np.sort(np.minimum(-scores[:-1][hashes == word] * lm_scoring.LEVELS, lm_scoring.LEAST - 1)), atol=0.51)
    assert met["n"].sum() == len(hashes)


def test_share_does_not_shrink_where_words_repeat(spark):
    """Each word follows the one before it and none occurs once: the model, not the counts, knows what comes."""
    alphabet = "the of and to in that was for with his".split(" ")
    texts = [(i, " ".join(alphabet[(i + k) % 10] for k in range(200))) for i in range(1, 200)]
    rows = lm_scoring.score_documents(frame(spark, texts), RANKS).collect()
    assert all(r["score"] > 0.3 * r["base_score"] for r in rows)


def test_long_texts_are_learned_from(spark):
    docs = lm_scoring.blocked(frame(spark, [(k, f"{'ab ' * 20}end{k}") for k in range(1, 40)]), "doc_id", "text", 16)
    cut = lm_scoring.windows(docs, 25).collect()
    held = {r["doc_id"] for r in docs.filter("held_out").collect()}
    for k in {*range(1, 40)} - held:
        mine = sorted((r["part"], r["text"], r["final"]) for r in cut if r["doc_id"] == k)
        assert "".join(t for _, t, _ in mine) == f"{'ab ' * 20}end{k}" and [f for *_, f in mine] == [False, False, True]
    assert not held & {r["doc_id"] for r in cut}


def test_repeated_rows_each_give_theirs(spark):
    """A row twice, an id on two texts and null ids: as many rows as went in, equal ones for equal rows."""
    texts = [(1, "mail joe@x.com now"), (1, "mail joe@x.com now"), (1, "another text of the same id"), (None, "Released under the MIT License."), (None, "Released under the MIT License."), (2, None), (2, ""), (3, "abab abab")]
    docs = frame(spark, texts, {1: "aa", 2: "bb", 3: "aa"})
    trees = language_id.train(docs)
    licence = license_scan.LicenceModel(["plain words", "and more of them"])
    results = {
        "op1": lm_scoring.score_documents(docs, RANKS, block_rows=4), "op3": byte_bpe.encode_documents(docs, RANKS, with_ids=False), "op4": personal_data.personal_data(docs), "op9": language_id.identify(docs, trees),
    }
    for name, found in results.items():
        rows = Counter(tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in found.collect())
        assert sum(rows.values()) == len(texts), name
        assert sorted(rows.values()) == [1, 1, 2, 2, 2], name
    assert [(r["doc_id"], r["family"]) for r in license_scan.licences(docs, licence).collect()] == [(None, "mit")] * 2
    benchmark = spark.createDataFrame([(7, "another text of the same"), (7, "another text of the same")], "item_id long, text string")
    assert Counter(tuple(r)[:2] for r in decontaminate.contaminated(docs, benchmark).collect()) == {(1, 7): 2}
    assert decontaminate.clean(docs, benchmark).count() == len(texts) - 1


def test_ties():
    trees = language_id.ContextTrees({"b": [b"same text"], "a": [b"same text"]})
    bits = trees.code_lengths(np.frombuffer(b"some text", np.uint8), np.array([0, 9]))[0]
    assert bits[0] == bits[1] and trees.languages[int(bits.argmin())] == "a"


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "pipeline"])
def test_registered(name):
    import __spark_entry__

    assert [q for q in __spark_entry__.queries() if q.split("_")[0] == name]


def test_words_of_a_block_take_little_memory():
    """Words are added up a run at a time, and once for a block whose rows come in several batches."""
    draw = random.Random(3)
    texts = [words(draw, 300) for _ in range(500)] * 8  # 6 MB
    counted = Counter(w for k, t in enumerate(texts) if k % 10 for w in t.split(" "))
    batches = [pa.RecordBatch.from_arrays([pa.array([k % 10 == 0 for k in range(lo, lo + 2000)]), pa.array(texts[lo : lo + 2000]), pa.array([7] * 2000)], ["held_out", "text", "block"]) for lo in (0, 2000)]
    tracemalloc.start()
    found = list(lm_scoring._distinct_words(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b.column(1).to_pylist() for b in found] == [[7] * len(set(" ".join(texts).split(" ")))]
    assert sorted(n for n in found[0].column(2).to_pylist() if n) == sorted(counted.values())
    assert peak < 40 << 20
