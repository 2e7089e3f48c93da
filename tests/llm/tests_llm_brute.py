"""Brute-force versions that the pipeline test compares with."""
import public_tokenizers as P
import tiktoken

from test_ngram_join import brute
from test_scans import hit_rows


def components_by_brute(rows):
    return {i: c for i, _, c, _ in brute(rows)}


def hit_ids(docs, bench):
    return {r[0] for r in hit_rows(docs, bench) if r[5]}


def tokens_by_tiktoken(texts, bpe):
    tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.vocab)}, special_tokens={})
    return [tk.encode_ordinary(t or "") for t in texts]
