"""Suffix-order dedup against a brute-force scan of every string."""

import hashlib
import random

import pytest
from tenantscope.llm.suffix_dedup import op1_suffix_array_dedup, repeated_spans


def brute(rows, length):
    order = sorted(((-1 << 63 if d is None else d), (t or "").encode(), d) for d, t, *_ in rows)
    seen, out = set(), []
    for _, b, d in order:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if s in seen:
                gone[i:i + length] = [True] * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    words = ["alpha", "be", "été", "delta", "the", "of", "x"]
    prose = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "s", str(rnd.randrange(50))]) for _ in range(n))
    shared = prose(30)
    rows = [(i, prose(rnd.randrange(60))) for i in range(40)]
    rows += [(100 + i, prose(4) + shared + prose(4)) for i in range(12)]
    rows += [(200, shared), (201, shared), (202, shared[:50] + "!" + shared[50:])]
    rows += [(300, "a" * 700), (301, "b" + "a" * 300), (302, "ab" * 200)]
    rows += [(400, None), (401, ""), (402, "short"), (None, shared), (500, shared), (500, shared), (500, prose(9) + shared)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("length", "gram"), [(100, 50), (20, 8), (20, 20), (20, 1)])
def test_matches_brute_force(spark, length, gram):
    rows = corpus(length + gram)
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, kept string")
    for part_bytes in (500, 1 << 22):
        got = repeated_spans(docs, length, gram, part_bytes=part_bytes).collect()
        have = sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans),
                        hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr)
        assert have == brute(rows, length)


def test_long_text_is_cut_into_overlapping_ranges(spark):
    rnd = random.Random(1)
    body = "".join(rnd.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, body + body[:500_000]), (2, "zz" + body[700_000:900_000])]
    got = {r.doc_id: r for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.start, s.end) for s in got[1].spans] == [(1_300_000, 1_800_000)]
    assert [(s.start, s.end) for s in got[2].spans] == [(2, 200_002)]


def test_empty_table_and_query(spark, sf_dir):
    assert not op1_suffix_array_dedup(spark.createDataFrame([], "doc_id long, text string")).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in op1_suffix_array_dedup(docs).collect()), key=repr)
    assert got == brute(rows, 100)
