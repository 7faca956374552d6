"""Token output: exact round trip through the files."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tenantscope.llm.token_output import SequenceFile, op3_token_output, read_sequences, write_sequences
from tenantscope.llm.tokens import Encoder, default_path

TEXTS = ["The cat's naïve CAFÉ́ it's 42nd, they'll   go\n\n\tnow", "", None, "x y z\x1cq", "İstanbul ΑΣ ﬁne",
         "<|endoftext|> a<|startoftext|>b <|endoftext", "'s 't 'S ''s don't '", "日本語 テキスト 🙂🙂", "a\x00b\x85c­é́ ́ e",
         "½ ² ٣ Ⅷ", "word " * 3000, "x" * 5000, "\n\n \n"]


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(default_path())


def test_word_cache_gives_the_library_s_ids(tok, sf_dir, spark):
    enc = Encoder(default_path())
    assert enc.by_word
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # cold and warm
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want


def test_long_texts_are_encoded_in_stretches(tok):
    from tenantscope.llm.tokens import _stretches
    text = "The cat, it's naïve\n\n ok  " * 40 + "x" * 300 + " end "
    for limit in (1, 10, 100):
        assert " ".join(_stretches(text, limit)) == text
    enc = Encoder(default_path())
    long = text * 900
    assert np.frombuffer(enc.encode([long])[0], enc.dtype).tolist() == tok.encode(long, add_special_tokens=False).ids


def test_round_trip(spark, tok, tmp_path):
    rows = [(i * 7 % 13 - 3, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (4, TEXTS[0], "x"), (4, TEXTS[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    shards = write_sequences(docs, str(tmp_path / "out"), seq_len=64, rows=4, shard_bytes=9000)
    assert shards.count() >= 2
    got = read_sequences(shards).collect()
    want = {}
    for d, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(d, []).append(np.array(ids, "<u4").tobytes())
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(d), x) for d, xs in want.items() for x in xs)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])


def test_files_are_equal_length_sequences_without_copies(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shard = write_sequences(docs, str(tmp_path / "s"), seq_len=128, rows=16).orderBy("shard").first()
    f = SequenceFile(shard.path)
    with pa.memory_map(shard.path) as m:
        table = pa.ipc.open_stream(m).read_all()
    assert table.schema.field("input_ids").type == pa.list_(pa.field("item", pa.uint16(), nullable=False), 128)
    ids = np.concatenate([f.sequence(i) for i in range(len(f))])
    mask = np.concatenate([f.mask(i) for i in range(len(f))])
    assert len(f) == -(-shard.n_tokens // 128) and mask.sum() == shard.n_tokens and mask[:shard.n_tokens].all()
    assert ids.tolist() == table.column("input_ids").combine_chunks().flatten().to_pylist()
    assert np.shares_memory(f.sequence(3), f.sequence(3)) and not f.sequence(3).flags.owndata
    assert {len(b) for b in f.batches[:-1]} <= {16}


def test_query(spark, tok, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(tuple(r) for r in op3_token_output(docs).collect())
    at, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert not op3_token_output(docs.limit(0)).collect()
    assert os.path.exists(default_path())
