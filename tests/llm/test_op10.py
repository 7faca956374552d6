"""Decontamination against a scan of every window at every place."""

import hashlib
import random
import re

import pytest
from tenantscope.llm.decontam import benchmark_hits, op10_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return WORD.findall(low)


def brute(docs, items, window):
    found = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            found.setdefault(tuple(w[k:k + window]), set()).add("null" if i is None else str(i))
    sizes = {len(w) for w in found}
    out = []
    for d, t in docs:
        w, hit, of = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                ids = found.get(tuple(w[k:k + n]))
                if ids:
                    hit.update(range(k, k + n))
                    of |= ids
        sha = hashlib.sha256(",".join(sorted(of)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(of), sha, bool(hit)))
    return sorted(out, key=repr)


def digest(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=repr)


def corpus():
    rnd = random.Random(5)
    vocab = ["alpha", "Beta", "été", "x9", "42", "日本", "of", "the"]
    prose = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    twice = prose(15)
    items = [(i, prose(rnd.randrange(1, 30))) for i in range(20)] + [(7, "The of"), (None, prose(12)), (98, None), (99, " .!"),
                                                                     (3, twice), (3, twice)]
    some = [t for _, t in items if t]
    docs = [(i, prose(rnd.randrange(40)) + rnd.choice(some).upper() if i % 3 else prose(60)) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "..."), (None, twice), (5, twice), (5, twice)]
    return docs, items


@pytest.mark.parametrize("window", [3, 10])
def test_matches_brute_force(spark, window):
    docs, items = corpus()
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, items string").repartition(3)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_words int")
    want = brute(docs, items, window)
    for kw in ({}, {"near_terms": 0}, {"max_bytes": 150}):
        got = benchmark_hits(d, b, window, **kw).collect()
        have = sorted(((r.doc_id, r.n_words, sum(h.end - h.start for h in r.hits), len(r["items"]),
                        hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.hits)) for r in got), key=repr)
        assert have == want
        assert kw.get("near_terms") == 0 or all(set(r["items"]) <= set(r.near_items) for r in got)


def test_proximity_finds_a_word_slipped_in(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "a b one two three four five indeed six seven eight nine ten c"), (2, "nothing here")], "doc_id long, text string")
    got = {r.doc_id: r for r in benchmark_hits(docs, spark.createDataFrame([(8, item)], "item_id long, text string")).collect()}
    assert got[1].near_items == ["8"] and got[1]["items"] == [] and got[2].near_items == []


@pytest.mark.parametrize("max_bytes", [8 << 20, 60])
def test_proximity_finds_a_replaced_word_however_rows_are_dealt(spark, max_bytes):
    item = "one two three four five six seven eight nine ten"
    w = item.split()
    docs = [(i, " ".join(["a", *w[:i], "other", *w[i + 1:], "b"])) for i in range(10)]
    # The replaced words elsewhere, once and often, and words that are no match.
    docs += [(100 + i, " ".join([x] * (i % 3 + 1) + ["z"] * 20)) for i, x in enumerate(w)] + [(200, "ten nine eight seven six five four three two one")]
    bench = spark.createDataFrame([(8, item), (9, "some quite different words " * 3)], "item_id long, text string")
    for few in (docs, docs[:10], docs[3:4]):
        for n in (1, 3, 7):
            d = spark.createDataFrame(few, "doc_id long, text string").repartition(n, "doc_id")
            got = {r.doc_id: (r.near_items, r["items"]) for r in benchmark_hits(d, bench, max_bytes=max_bytes).collect()}
            assert got == {i: (["8"] if i < 10 else [], []) for i, _ in few}
    assert {r.doc_id: r.n_near_items for r in op10_decontamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()} \
        == {i: int(i < 10) for i, _ in docs}


def test_query_and_empty_tables(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()], 10)
    assert digest(op10_decontamination(docs, bench)) == want
    assert not digest(op10_decontamination(docs.limit(0), bench))
    assert not any(r[5] for r in digest(op10_decontamination(docs, bench.limit(0))))


def test_long_texts_are_read_in_pieces():
    from tenantscope.llm.blobs import text_buffer
    from tenantscope.llm.words import ALNUM, SPACED, word_table
    import pyarrow as pa
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab C.é\n") for _ in range(n)) for n in (0, 500, 3, 0, 700, 1)] + ["x" * 300, "", " "]
    off, data = text_buffer(pa.array(texts))
    for table in (ALNUM, SPACED):
        whole = word_table(data, off, table)
        for limit in (1, 7, 64):
            assert all((a == b).all() for a, b in zip(whole, word_table(data, off, table, limit), strict=True))


def test_long_words_that_the_rolling_hash_takes_for_equal(spark):
    word = "a"
    while len(word) < 65_536:
        word += word.translate(str.maketrans("ab", "ba"))
    for n in (1024, 2048, 65_536):
        docs = spark.createDataFrame([(1, word[:n].translate(str.maketrans("ab", "ba"))), (2, "x " + word[:n])], "doc_id long, text string")
        got = op10_decontamination(docs, spark.createDataFrame([("i", word[:n])], "item_id string, text string"))
        assert sorted((r.doc_id, r.n_hit, r.contaminated) for r in got.collect()) == [(1, 0, False), (2, 1, True)]
