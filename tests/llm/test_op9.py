"""Language ID: the distance against a plain version, accuracy on held-out documents."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from tenantscope.llm import language_id as L
from tenantscope.llm.blobs import text_buffer

import pyarrow as pa


def grams(t):
    low = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in t or ""]
    words = "".join(low).split()
    out = Counter()
    for k, w in enumerate(words):
        for i in range(len(w)):
            out[w[i]] += 1
        p = " " + w + " "
        for i in range(len(p) - 1):
            out[p[i:i + 2]] += 1
        for i in range(len(p) - 2):
            out[p[i:i + 3]] += 1
    return out


def counted(texts):
    gram, doc, letters = L._ngrams(*text_buffer(pa.array(texts, pa.string())))
    return [sorted(Counter(gram[doc == i].tolist()).values()) for i in range(len(texts))], letters.tolist()


def test_ngrams_are_those_of_the_words():
    texts = ["The cat, the Hat", "", None, " 12 ", "été ÉTÉ x", "a", "İi ß", "日本語 テキスト", "one\ntwo", "🙂a🙂b"]
    got, letters = counted(texts)
    assert got == [sorted(grams(t).values()) for t in texts]
    assert letters == [sum(c.isalpha() for c in t or "") for t in texts]


def test_long_text_counts_like_its_parts(monkeypatch):
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 9))) for _ in range(5000))
    whole = counted([text])[0][0]
    monkeypatch.setattr(L, "_PIECE", 1024)
    off, data = text_buffer(pa.array(["x y", text, "z"]))
    found = [L._counts(of[p], g) for c, d, of in L._pieces(off, data) for g, p, _ in [L._ngrams(c, d)]]
    doc, _, n = L._merge(found)
    assert len(found) > 10 and sorted(n[doc == 1].tolist()) == whole


def test_prediction_is_the_out_of_place_distance(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de")] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = 15
    learned = L.profiles(docs, size)
    probe = ["the hat", "le chapeau", "katze", "", None, "123", "ж", "die the le", "x" * 50]
    got = L.predict(spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string"), learned, size).orderBy("doc_id").collect()
    for r, t in zip(got, probe, strict=True):
        off, data = text_buffer(pa.array([t], pa.string()))
        c = Counter(L._ngrams(off, data)[0].tolist())
        own = sorted(c, key=lambda g: (-c[g], g))[:size]
        if not any(ch.isalpha() for ch in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        dist = {lang: sum(min(abs(p.index(g) - i), size) if g in p else size for i, g in enumerate(own)) / (len(own) * size) for lang, p in learned.items()}
        best = min(sorted(dist), key=dist.get)
        assert r.lang_pred == best and np.isclose(r.distance, dist[best]) and 0 <= r.score <= 1
    assert [r.lang_pred for r in got[:2]] == ["en", "fr"]


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = L.op9_language_id(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and len(rows) == len(lang)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) >= 0.97
    odd = spark.createDataFrame([(1, None, "en", 0.5), (2, "", None, 1.0), (None, "the cat", "fr", None), (3, "word", None, 1.0)],
                                "doc_id long, text string, lang string, score double")
    assert {(r.lang_pred, r.score, r.held_out) for r in L.op9_language_id(odd).collect()} <= {("und", 0.0, False), ("und", 0.0, True)}
    assert not L.op9_language_id(docs.limit(0)).collect()


def test_a_batch_is_counted_in_little_memory():
    """A worker holds arrays for a small slice of a batch at a time, and its
    counts are merged before they pile up."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(words, k=300)) for _ in range(1500)]
    off, data = text_buffer(pa.array(texts))
    code = np.arange(len(texts)) % 3
    assert len(data) > 2 << 20
    L._letters()
    assert max(len(d) for _, d, _ in L._pieces(off, data)) <= 1 << 16
    tracemalloc.start()
    group, gram, n = L._batch_counts(off, data, code)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    whole, doc, _ = L._ngrams(off, data)
    expect = L._counts(code[doc], whole)
    assert all((a == b).all() for a, b in zip((group, gram, n), expect, strict=True))
