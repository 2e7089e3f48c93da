import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from test_tokens import strange
from tokenizers import Tokenizer

from labelflow.llm import merge_bpe
from labelflow.llm.queries import QUERIES, WORD_TOKENIZER
from labelflow.sources.tables import table

SF = "/root/testdata/sf0.01"
PATH = P.path(WORD_TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def sha(x):
    return hashlib.sha256(x).hexdigest()


def row(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())


def test_strange_texts_equal_the_library(library):
    m = merge_bpe.MergeTokens(open(PATH, "rb").read())
    for rows in (strange(seed=7), [None, "", "a" * 20_000, "ab" * 9000, "<|startoftext|>x<|endoftext|><|endoftext|>"]):
        counts, ids = m.encode(pa.array(rows, pa.string()))
        for x, got in zip(rows, merge_bpe._slices(counts, ids)):
            want = library.encode(x or "", add_special_tokens=False).ids
            assert got.tolist() == want, repr(x)
            assert m.decode(got) == library.decode(want, skip_special_tokens=False)


def test_the_queue_merges_as_a_plain_scan_does():
    """Lowest rank first, leftmost first, over random merge tables."""
    rng = random.Random(3)
    for _ in range(300):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        for _ in range(rng.randint(1, 8)):
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        word = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        want = list(word)
        while True:
            pairs = [(merges.index(p), i) for i, p in enumerate(zip(want, want[1:])) if p in merges]
            if not pairs:
                break
            _, i = min(pairs)
            want[i:i + 2] = [want[i] + want[i + 1]]
        got = merge_bpe.MergeQueue(vocab, merges).merge([vocab[c] for c in word])
        assert got == [vocab[c] for c in want], (merges, word)


def test_whole_table(spark, library):
    rows = table(spark, SF, "documents", "doc_id", "text").collect()
    assert sorted(map(tuple, QUERIES["op11_merge_bpe"](spark, SF).collect())) == sorted((r.doc_id, *row(library, r.text)) for r in rows)


def test_odd_rows(spark, library, odd_docs):
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted(map(tuple, merge_bpe.digests(merge_bpe.round_trip(odd_docs, PATH)).collect()), key=key)
    assert got == sorted(((r.doc_id, *row(library, r.text)) for r in odd_docs.collect()), key=key)
    ids = merge_bpe.encode(odd_docs, PATH)
    two = {(r.doc_id, r.decoded) for r in merge_bpe.decode(ids, PATH).collect()}
    assert two == {(r.doc_id, r.decoded) for r in merge_bpe.round_trip(odd_docs, PATH).collect()}
    assert merge_bpe.round_trip(odd_docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        merge_bpe.MergeTokens(open(P.path("byte_bpe_50k.json"), "rb").read())
