"""Best-fit packing: every id placed once, no gap, near the lower bound."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tenantscope.llm.packing import best_fit, op7_best_fit_packing, pack_documents, sequences
from tenantscope.llm.tokens import default_path


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_is_the_plain_rule(sizes):
    bins, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [b for b in range(len(bins)) if room[b] >= sizes[i]]
        if fits:
            b = min(fits, key=lambda b: room[b])
        else:
            b = len(bins)
            bins.append([])
            room.append(50)
        bins[b].append(i)
        room[b] -= sizes[i]
    got = best_fit(sizes, 50)
    assert len(got) == len(bins)
    assert sorted(sum(sizes[i] for i in b) for b in got) == sorted(sum(sizes[i] for i in b) for b in bins)
    assert sorted(i for b in got for i in b) == list(range(len(sizes)))


def check(rows, placed, capacity, end_id):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(default_path())
    want = []
    for d, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, end_id], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            p = ids[at:at + capacity]
            want.append((str(d), k, at, len(p), zlib.crc32(p.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in placed) == sorted(want)
    by = {}
    for r in placed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(by), -(-sum(w[3] for w in want) // capacity)


@pytest.mark.parametrize("parts", [1, 40])
def test_query(spark, sf_dir, parts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(parts)
    placed = op7_best_fit_packing(docs)
    n, least = check([(r.doc_id, r.text) for r in docs.collect()], placed.collect(), 2048, 0)
    assert n <= 1.08 * least + 1
    assert sequences(placed).count() == n


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "tie"), (3, "tie"), (4, "word " * 205), (5, "word " * 99), (6, "word " * 100)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, piece int").repartition(5)
    for kw in ({}, {"carry": 1}, {"tolerance": 99}, {"group_pieces": 2, "fan_in": 2}):
        check(rows, pack_documents(docs, capacity=100, **kw).collect(), 100, 0)
    assert not op7_best_fit_packing(docs.limit(0)).collect()


@pytest.mark.parametrize("layout", ["two sizes", "sorted", "random"])
def test_as_few_sequences_as_plain_best_fit(spark, sf_dir, layout):
    """Whatever order the table is in, pieces of all sizes meet in every group."""
    if layout == "two sizes":
        docs = spark.createDataFrame([(i, "word " * (1100 if i < 400 else 900)) for i in range(800)], "doc_id long, text string").repartitionByRange(2, "doc_id")
    else:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
        docs = docs.repartitionByRange(4, F.length("text")) if layout == "sorted" else docs.repartition(4)
    placed = pack_documents(docs, group_pieces=60)
    sizes = [r.length for r in placed.collect()]
    plain = len(best_fit(sizes, 2048))
    assert plain <= sequences(placed).count() <= 1.02 * plain
    assert layout != "two sizes" or plain == 400
