"""N-gram Jaccard join against all pairs."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tenantscope.llm.blobs import text_buffer
from tenantscope.llm.components import connected_components
from tenantscope.llm.ngram_jaccard import TokenGroupMatrix, jaccard_classes, op2_ngram_jaccard_join
from tenantscope.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k=3):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, num=90, den=100, k=3):
    sets = [shingles(t, k) for _, t, *_ in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        d = rows[i][0]
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((rows[i][0], len(sets[i]), least.get(find(i)), links[i]) for i in range(n)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect()), key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "Ab", "ab", "x.y"]
    prose = lambda n: [rnd.choice(vocab) for _ in range(n)]
    rows, docs = [], []
    for size in [1, 2, 3, 4, 9, 10, 11, 12, 20, 30, 45, 60, 90, 150, 300]:
        for _ in range(3):
            base = prose(size)
            docs.append(base)
            for _ in range(5):
                near = list(base)
                for _ in range(rnd.randrange(0, 1 + size // 30 + 1)):
                    p = rnd.randrange(len(near))
                    op = rnd.randrange(3)
                    if op == 0:
                        near[p] = rnd.choice(vocab)
                    elif op == 1:
                        near.insert(p, rnd.choice(vocab))
                    elif len(near) > 1:
                        del near[p]
                docs.append(near)
    for i, d in enumerate(docs):
        rows.append((1000 - i, rnd.choice([" ", "\n", " \t"]).join(d)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, rows[40][1]), (7, rows[50][1]), (7, rows[50][1]), (None, "lone null doc")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "num"), [(1, 90), (2, 80), (3, 100), (4, 45)])
def test_matches_all_pairs(spark, seed, num):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, mark int").repartition(5)
    want = brute(rows, num)
    assert got(jaccard_classes(docs, 3, num, 100)) == want
    assert got(jaccard_classes(docs, 3, num, 100, part_bytes=3000, chunk_tokens=400, cell_visitors=4)) == want


def test_query_and_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(op2_ngram_jaccard_join(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(op2_ngram_jaccard_join(docs.limit(0))) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=20), min_size=1, max_size=12), st.sets(st.integers(0, 30), min_size=1))
def test_matrix_finds_the_linked_members(members, q):
    m = TokenGroupMatrix([np.array(sorted(s), np.uint64) for s in members], subgroup=2)
    want = [i for i, s in enumerate(members) if 4 * len(s & q) >= 2 * len(s | q)]
    assert m.links(np.array(sorted(q), np.uint64), 2, 4).tolist() == want


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(900, 901), (5, 5)]
    edges += [(500 + i, 499) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    have = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert have == {x: find(x) for x in root}


def test_long_words_that_the_rolling_hash_takes_for_equal(spark):
    """Thue-Morse words and their complements: different documents stay apart."""
    word = "a"
    while len(word) < 65_536:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = []
    for k, n in enumerate((1024, 2048, 65_536)):
        rows += [(2 * k, f"x y {word[:n]}"), (2 * k + 1, f"x y {word[:n].translate(str.maketrans('ab', 'ba'))}")]
    got = op2_ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id and r.n_links == 0 for r in got) and len(got) == 6


def test_cells_are_bounded_by_their_visitors(spark, tmp_path):
    """One set that 400 others visit: its group is cut by them, not by its one
    member."""
    from tenantscope.llm.ngram_jaccard import _cells
    rows = [(1, 50, 7, 900, [7])] + [(100 + i, 50, 1000 + i, 2, [7, 1000 + i]) for i in range(400)]
    live = spark.createDataFrame(rows, "mark long, n_shingles long, home long, home_sets long, shared array<long>")
    for kw in ({"chunk_tokens": 1 << 19, "cell_visitors": 50}, {"chunk_tokens": 2500, "cell_visitors": 4096}):
        cells = _cells(live, str(tmp_path / str(kw["cell_visitors"])), **kw).where("home = 7")
        size = [r["count"] for r in cells.groupBy("chunk", "block").count().collect()]
        assert cells.where("not member").select("mark").distinct().count() == 400
        assert max(size) <= 2 * 50 and len(size) >= 8


def test_shingles_of_a_part_take_little_memory():
    """Texts of a part are read in slices of a few hundred KB."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rnd.choices(words, k=350)) for _ in range(2000)]
    off, data = text_buffer(pa.array(texts))
    assert len(data) > 3 << 20
    shingle_sets(off, data, 5)
    tracemalloc.start()
    sets = shingle_sets(off, data, 5)
    peak = tracemalloc.get_traced_memory()[1] - sum(s.nbytes for s in sets)
    tracemalloc.stop()
    assert peak < 12 << 20
    for i in (0, 999, 1999):
        assert (shingle_sets(*text_buffer(pa.array([texts[i]])), 5)[0] == sets[i]).all()
