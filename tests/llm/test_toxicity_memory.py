"""The fit's matrices: one of all near words, none of the same size beside it."""

import numpy as np

from labelflow.llm import toxicity


def test_kernels_are_changed_block_by_block(monkeypatch):
    r = np.random.default_rng(3)
    words = ["^" + "".join(r.choice(list("abcdefgh"), 6)) for _ in range(7_000)]
    marks = list(dict.fromkeys(words))[:20]
    change = r.random((len(marks), 10)).astype(np.float32)
    kernels = toxicity.Kernels(marks)
    whole = np.vstack([kernels.of(words), np.zeros((1, len(marks)), np.float32)])
    sizes, of = [], kernels.of
    monkeypatch.setattr(kernels, "of", lambda w: sizes.append(len(w)) or of(w))
    x = kernels.changed(words, change)
    assert x.shape == (len(words) + 1, 10) and not x[-1].any()
    assert max(sizes) <= toxicity.BLOCK and sum(sizes) == len(words)
    np.testing.assert_allclose(x, whole @ change, rtol=1e-4, atol=1e-5)
