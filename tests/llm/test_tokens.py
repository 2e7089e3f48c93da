import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from labelflow.llm import byte_bpe, token_counts, token_files
from labelflow.llm.queries import QUERIES, WORD_TOKENIZER, byte_vocabulary
from labelflow.llm.word_tokens import check_splits_at_space, word_tokens
from labelflow.session import scratch_path
from labelflow.sources.tables import table

SF = "/root/testdata/sf0.01"
PATH = P.path(WORD_TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r.doc_id, r.text) for r in table(spark, SF, "documents", "doc_id", "text").collect())


def strange(n=3000, seed=0):
    rng = random.Random(seed)
    parts = ["a", "B", "é", "é", "́", " ", " ", "\n", "\t", "\r", "\x0b", "\xa0", "\x1c", "\x85", "'s", "'T", "'", ".", ",", "!",
             "1", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "中", "\U0001f600", "Σ", "ς", "İ", "ß", "ﬁ", " ", "\x00", "▁", "K", "ĠĠ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_word_tokens_equal_the_library(library):
    w = word_tokens(open(PATH, "rb").read())
    for rows in (strange(), [x.replace("<|", "") for x in strange(seed=1)], [None, ""]):
        counts, ids = w.encode(pa.array(rows, pa.string()))
        at = np.concatenate([[0], np.cumsum(counts)])
        for i, x in enumerate(rows):
            assert library.encode(x or "", add_special_tokens=False).ids == ids[at[i]:at[i + 1]].tolist(), repr(x)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        word_tokens(open(P.path("byte_bpe_50k.json"), "rb").read())
    with pytest.raises(ValueError):
        check_splits_at_space({})


def test_counts_and_cache(spark, library, texts):
    docs = table(spark, SF, "documents", "doc_id", "text")
    cache = token_counts.CountCache(spark, scratch_path(spark, "cache"))
    want = []
    for i, t in texts:
        n = len(library.encode(t, add_special_tokens=False).ids)
        want.append((i, len(t.encode()), n, n > 2048))
    got = sorted(map(tuple, token_counts.count_tokens(docs, PATH, cache).collect()))
    assert got == want
    spec = hashlib.sha256(open(PATH, "rb").read()).hexdigest()
    stored = cache.read(spec).count()
    assert stored == docs.select(token_counts.content_digest()).distinct().count()
    more = docs.union(spark.createDataFrame([(10**6, "only  this\nis new"), (10**6 + 1, "only this is new"), (5, None)], docs.schema))
    got = {tuple(r) for r in token_counts.count_tokens(more, PATH, cache).collect()}
    assert {(10**6, 17, 4, False), (10**6 + 1, 16, 4, False), (5, 0, 0, False)} <= got and set(want) <= got
    assert spark.read.parquet(cache.path).count() == stored + 2
    assert cache.read("another version").count() == 0


def test_counts_of_odd_rows(spark, library, odd_docs):
    cache = token_counts.CountCache(spark, scratch_path(spark, "cache"))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_counts.count_tokens(odd_docs, PATH, cache).collect()))
    assert got == sorted((r.doc_id is None, r.doc_id or 0, len(library.encode(r.text or "", add_special_tokens=False).ids))
                         for r in odd_docs.collect())
    assert token_counts.count_tokens(odd_docs.limit(0), PATH, cache).count() == 0


def test_token_files(spark, library, texts, odd_docs):
    at, want = 0, []
    for i, t in texts:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op5_token_files"](spark, SF).collect())) == want
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(odd_docs, PATH, path)
    rows = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7]
    assert all(b.start == a.start + len(a.ids) // 4 for a, b in zip(rows, rows[1:])) and rows[1].ids == b"\x02\0\0\0"
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(odd_docs.limit(0), PATH, path)
    assert token_files.read_tokens(spark, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 50_000, 2**32])
def test_blocks_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[rng.random(n) < 0.01] = 2**32 - 1
    data = token_files.encode_ids(ids)
    assert (token_files.decode_ids(data) == ids).all()
    assert (token_files.decode_ids(data, 1, 3) == ids[1024:3072]).all()


def test_byte_bpe_equals_tiktoken(spark, texts):
    bpe = byte_vocabulary()
    tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.vocab)}, special_tokens={})
    enc = byte_bpe.Encoder(bpe, bpe.model)
    rows = [*strange(), "a" * 50_000, " " * 3000, None]
    for x, ids in zip(rows, enc.encode(rows)):
        assert tk.encode_ordinary(x or "") == np.frombuffer(ids, "<u4").tolist(), repr(x)
    want = []
    for i, t in texts:
        ids = tk.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op6_byte_bpe"](spark, SF).collect())) == want


def test_byte_bpe_odd_rows(spark, odd_docs):
    bpe = byte_vocabulary()
    rows = byte_bpe.encode(odd_docs, bpe)
    assert rows.count() == odd_docs.count()
    decoded = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(rows, bpe).collect()}
    assert decoded == {r.doc_id: (r.text or "").encode() for r in odd_docs.collect()}
    assert byte_bpe.round_trip(odd_docs.limit(0), bpe).count() == 0
