"""Toxicity: subsequence string-kernel support vector machine with Nystroem
landmarks.

The kernel of two words adds, over all common subsequences of ORDER letters, the
product of DECAY to the length each one spans, gaps included, and is normalised;
so letters inserted into an insult, or put between its letters, change it little.
It is computed for every word: a machine's weights are summed into one table by
letter triple, so that a word costs the same whatever the number of landmarks.

The machine is trained on the sentences of labelled documents, by multi-instance
rounds.  A sentence stands for its most toxic word (by the machine so far): each
toxic document gives its most toxic sentence as a positive row, and all words of
its sentences that are toxic so far, each clean document all of its sentences as
negative rows, and the machine is fitted anew.
The first round starts from the words that speak for the label beyond chance.
Copies of positive words with one or two letters put in are trained on as well.
Landmarks only approximate the kernel: the starting words and the clean words
nearest to them, or, of more than MAX_LANDMARKS, those that leave least of the
kernel unexplained.  A document scores as its most toxic sentence, through a
logistic map fitted to the labels.

Words are the space-separated pieces, lower-cased, without their non-alphanumeric
characters, after a mark for their beginning.  Sentences end at .!? before a piece
that begins with three alphanumeric characters.  Pieces of one or two letters in
a row also count joined: three or more single letters, and any three or more
pieces, up to the longest landmark together.  A word with three or more equal
letters in a row also counts with one of them, and one longer than LONG counts as
its overlapping stretches of LONG letters.  Null
texts are empty and score like a text without a suspicious word.  Every row gives
one output row, repeated ids too; an id labelled twice takes the mean of its
labels, null labels are skipped.  Without labels, or with one class only, all
rows score that share (0.5 without any).  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import map_arrow, release_memory, text_buffer, text_chunks
from labelflow.llm.quality import labelled_sample

#: Labelled rows the fit may use at most (a deterministic sample by id hash).
MAX_FIT_ROWS = 6_000
THRESHOLD = 0.3
ORDER = 3
DECAY = 0.8
#: Letters of a word that are compared at once; longer ones come in stretches
#: that overlap by half.
LONG = 32
#: Letters of short pieces that are joined at most in training (runs of single
#: letters: all); a machine joins up to its longest landmark.
JOIN = 16
#: Landmarks at least (if there are words enough), and at most.
LANDMARKS = 384
MAX_LANDMARKS = 384
#: Landmarks whose kernels are computed together.
COLUMNS = 128
#: A training word whose kernel with every toxic landmark is smaller counts as a
#: word like none of them.
NEAR = 0.15
#: Multi-instance rounds.
ROUNDS = 3
#: Bytes of text up to which a labelled row can be in the training sample.
MAX_FIT_BYTES = 1 << 16
#: Stands before the letters of a word.
BEGIN = "^"
#: Distinct words a worker remembers before it starts anew.
CACHE_ENTRIES = 600_000
CHUNK_BYTES = 8 << 20
#: Pairs of word and landmark whose kernel is computed together.
PAIRS = 12_000
#: Training words whose kernels are computed together.
ROWS = 5_000
#: Rows whose kernels are changed to another base together.
BLOCK = 6_144
#: Kinds of pieces: without letters, of one or two.
BLANK, SHORT = 1, 2
_DROP = re.compile(r"[\W_]+")
#: The same in many pieces at once, one in a line.
_DROP_IN_LINES = re.compile(r"(?:[^\w\n]|_)+")
_REPEAT = re.compile(r"(.)\1{2,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\W_]{3})")


def letters(words: list[str]) -> np.ndarray:
    """Set of each word's letters as a 64-bit mask (letters share 64 slots)."""
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    size = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.uint64)
    some = size > 0
    out[some] = np.bitwise_or.reduceat(np.uint64(1) << (codes & 63).astype(np.uint64), (np.cumsum(size) - size)[some])
    return out


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def raw_kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Kernel of row i of ``s`` with row i of ``t``: (pairs, n) and (pairs, m) letters.

    ends[i][j] sums decay to both spans over the common subsequences that end at
    s[i], t[j]; open[j] carries those that ended before, decayed by the gap."""
    pairs, n = s.shape
    m = t.shape[1]
    same = s.T[:, None, :] == t.T[None, :, :]
    square = np.float32(decay * decay)
    ends = same * square
    for _ in range(order - 1):
        # before[i, j]: all ends at (i' < i, j' < j), decayed by (i - i' - 1) + (j - j' - 1)
        before = np.zeros((n + 1, m + 1, pairs), np.float32)
        for i in range(n):
            down, row = before[i], before[i + 1]
            fresh = decay * (down[1:] - decay * down[:-1]) + ends[i]
            for j in range(m):
                np.multiply(row[j], decay, out=row[j + 1])
                row[j + 1] += fresh[j]
        ends = np.where(same, square * before[:n, :m], 0)
    return ends.sum((0, 1), dtype=np.float64)


def in_support(words: list[str], landmarks: list[str], order: int = ORDER) -> np.ndarray:
    """(words, landmarks) where the kernel may differ from zero: both have ``order``
    letters and share one (letter masks never miss a shared letter)."""
    a, b = letters(words), letters(landmarks)
    la, lb = (np.array([len(w) for w in x], np.int64) for x in (words, landmarks))
    return ((a[:, None] & b[None, :]) != 0) & (la[:, None] >= order) & (lb[None, :] >= order)


def kernel(words: list[str], landmarks: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """(words, landmarks) normalised kernel."""
    out = np.zeros((len(words), len(landmarks)))
    i, j = np.nonzero(in_support(words, landmarks))
    if not len(i):
        return out
    own = [_self(x, np.unique(k), order, decay) for x, k in ((words, i), (landmarks, j))]
    la, lb = np.array([len(w) for w in words])[i], np.array([len(w) for w in landmarks])[j]
    shape = la * 100_000 + lb
    by = np.argsort(shape, kind="stable")
    for group in np.split(by, np.flatnonzero(np.diff(shape[by])) + 1):
        n, m = int(la[group[0]]), int(lb[group[0]])
        step = max(1, PAIRS * 64 // (n * m))
        for k in range(0, len(group), step):
            g = group[k:k + step]
            s, t = _codes([words[x] for x in i[g]]), _codes([landmarks[x] for x in j[g]])
            out[i[g], j[g]] = raw_kernel(s, t, order, decay)
    norm = own[0][:, None] * own[1][None, :]
    return np.divide(out, np.sqrt(norm), out=np.zeros_like(out), where=norm > 0)


def _self(words: list[str], wanted: np.ndarray, order: int, decay: float) -> np.ndarray:
    out = np.zeros(len(words))
    size = np.array([len(words[k]) for k in wanted])
    for n in np.unique(size):
        g = wanted[size == n]
        step = max(1, PAIRS * 64 // int(n * n))
        for k in range(0, len(g), step):
            c = _codes([words[x] for x in g[k:k + step]])
            out[g[k:k + step]] = raw_kernel(c, c, order, decay)
    return out


def views(word: str) -> list[str]:
    """The word, also with one letter for each long run of it, in stretches of
    LONG; the mark for its beginning stands before the first."""
    out = []
    for w in dict.fromkeys((word, _REPEAT.sub(r"\1", word))):
        parts = [w] if len(w) <= LONG else [w[i:i + LONG] for i in range(0, len(w) - LONG // 2, LONG // 2)]
        out += [BEGIN + parts[0], *parts[1:]]
    return out


def joined(run: list[str], most: int = JOIN) -> list[str]:
    """Words that a run of pieces of one or two letters may be split from."""
    out = []
    for i in range(len(run) - 2):
        w = run[i] + run[i + 1]
        for piece in run[i + 2:i + most]:
            w += piece
            if len(w) > most:
                break
            out.append(w)
    single = ""
    for w in [*run, "  "]:
        if len(w) == 1:
            single += w
        else:
            if len(single) > 2:
                out.append(single)
            single = ""
    return [v for w in dict.fromkeys(out) for v in views(w)]


def words_of(text: str, most: int = JOIN) -> list[str]:
    """Words of a sentence or text, see the module's note."""
    plain = [w for w in (_DROP.sub("", p.lower()) for p in text.split()) if w]
    out, run = [v for w in plain for v in views(w)], []
    for w in [*plain, "   "]:
        if len(w) <= 2:
            run.append(w)
        elif run:
            out += joined(run, most) if len(run) > 2 else []
            run = []
    return out


def sentences(text: str) -> list[list[str]]:
    """Distinct words of each sentence."""
    return [w for s in _SENTENCE.split(text) if (w := list(dict.fromkeys(words_of(s))))]


class Triples:
    """Sum over landmarks of weight * normalised phi, by ordered letter triple: a
    table of the letter pairs that open one, and for each a row by third letter.
    ``weights`` may have several columns."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, decay: float = DECAY):
        self.decay = decay
        self.alphabet = np.unique(np.frombuffer("".join(landmarks).encode("utf-32-le"), "<u4"))
        norm = np.sqrt(_self(landmarks, np.arange(len(landmarks)), ORDER, decay))
        self.flat = weights.ndim == 1
        weights = weights.reshape(len(landmarks), -1)
        total: dict[tuple, np.ndarray] = {}
        for word, w, n in zip(landmarks, weights, norm):
            if n == 0:
                continue
            c = self.index(_codes([word]))[0].tolist()
            for i, j, k in itertools.combinations(range(len(c)), ORDER):
                t = c[i], c[j], c[k]
                total[t] = total.get(t, 0) + w / n * decay ** (k - i + 1)
        size = len(self.alphabet) + 1  # the last letter is any other
        pairs = sorted({t[:2] for t in total})
        self.pair = np.zeros((size, size), np.int32)
        for n, (i, j) in enumerate(pairs):
            self.pair[i, j] = n + 1
        self.third = np.zeros((len(pairs) + 1, size), np.int32)
        self.value = np.zeros((len(total) + 1, weights.shape[1]))
        for n, ((i, j, k), v) in enumerate(total.items()):
            self.third[self.pair[i, j], k] = n + 1
            self.value[n + 1] = v
        # one column: the values themselves stand by pair and third letter
        self.by_pair = self.value[self.third, 0].ravel() if self.flat else None

    def index(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.zeros(codes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at, len(self.alphabet))

    def _sums(self, c: np.ndarray) -> np.ndarray:
        """(words, columns) sum over the triples of letter indices (n, words)."""
        n, size = c.shape[0], len(self.alphabet) + 1
        dot = np.zeros((c.shape[1], self.value.shape[1]))
        for i, j in itertools.combinations(range(n - 1), 2):
            p = self.pair[c[i], c[j]]
            if self.flat:   # a letter or pair without a value adds zero
                p = p * size
                for q in range(j + 1, n):
                    dot[:, 0] += self.by_pair.take(p + c[q]) * self.decay ** (q - i + 1)
                continue
            some = np.flatnonzero(p)
            if not len(some):
                continue
            p = p[some]
            for q in range(j + 1, n):
                t = self.third[p, c[q, some]]
                hit = np.flatnonzero(t)
                dot[some[hit]] += self.value[t[hit]] * self.decay ** (q - i + 1)
        return dot

    def decide(self, words: list[str]) -> np.ndarray:
        """Sum of weight * kernel over the landmarks, for each word."""
        out = np.zeros((len(words), self.value.shape[1]))
        size = np.array([len(w) for w in words], np.int64)
        for n in np.unique(size[size >= ORDER]).tolist():
            group = np.flatnonzero(size == n)
            step = max(1, PAIRS * 64 // (n * n))
            for k in range(0, len(group), step):
                g = group[k:k + step]
                codes = _codes([words[x] for x in g])
                c = np.ascontiguousarray(self.index(codes).T)
                g, codes, c = (x[..., keep] if x is c else x[keep] for keep in [(c < len(self.alphabet)).sum(0) >= ORDER] for x in (g, codes, c))
                if not len(g):
                    continue
                dot = self._sums(c)
                some = np.flatnonzero(dot.any(1))
                if len(some):
                    own = codes[some]
                    out[g[some]] = dot[some] / np.sqrt(raw_kernel(own, own, ORDER, self.decay))[:, None]
        return out[:, 0] if self.flat else out


@dataclass
class Machine:
    """decision(word) = kernel(word, landmarks) . weights + bias, the first ``toxic``
    landmarks being toxic words; a document's score is the logistic of
    slope * decision + shift."""

    landmarks: list[str] = field(default_factory=list)
    toxic: int = 0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 0.0
    triples: Triples | None = field(default=None, repr=False, compare=False)

    def decisions(self, words: list[str]) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(words), self.bias)
        if self.triples is None:
            self.triples = Triples(self.landmarks, self.weights)
        return self.triples.decide(words) + self.bias

    @property
    def join(self) -> int:
        """Letters of short pieces that are joined at most."""
        return max((len(w) - 1 for w in self.landmarks[:self.toxic]), default=0)

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * decision + self.shift)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps that are halved
    until the loss falls; the normal equations add up over blocks of rows."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6

    def margins(v: np.ndarray) -> np.ndarray:
        return 1 - y * (x @ v[:-1].astype(np.float32) + v[-1])

    def loss(v: np.ndarray) -> float:
        return float(v @ ridge @ v + c * (weight * np.maximum(margins(v), 0) ** 2).sum())

    now = loss(w)
    for _ in range(steps):
        active = np.flatnonzero(margins(w) > 0)
        left, right = ridge.copy(), np.zeros(len(w))
        for k in range(0, len(active), ROWS):
            g = active[k:k + ROWS]
            z = np.hstack([x[g], np.ones((len(g), 1))])
            zw = z * weight[g, None]
            left += c * z.T @ zw
            right += c * zw.T @ y[g]
        step = np.linalg.solve(left, right) - w
        size = 1.0
        while size > 1e-3 and loss(w + size * step) > now:
            size /= 2
        new = loss(w + size * step)
        if now - new < 1e-6 * now:
            break
        w, now = w + size * step, new
    return w[:-1], float(w[-1])


def _logistic(d: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the probability of a label given a decision."""
    prior = (y.sum() + 1) / (len(y) + 2)
    w = np.array([0.0, np.log(prior / (1 - prior))])
    z = np.stack([d, np.ones(len(d))], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ w)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (y - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


class Kernels:
    """``kernel`` of many words with the landmarks, by their triple tables."""

    def __init__(self, landmarks: list[str]):
        self.n = len(landmarks)
        parts = [landmarks[c:c + COLUMNS] for c in range(0, self.n, COLUMNS)]
        self.tables = [Triples(p, np.eye(len(p))) for p in parts]

    def of(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.n), np.float32)
        for k in range(0, len(words), ROWS):
            for c, table in enumerate(self.tables):
                out[k:k + ROWS, c * COLUMNS:(c + 1) * COLUMNS] = table.decide(words[k:k + ROWS])
        return out

    def changed(self, words: list[str], change: np.ndarray) -> np.ndarray:
        """``of(words) @ change`` and a row of zeros, block by block, so that the
        kernels of all words never stand beside it."""
        out = np.zeros((len(words) + 1, change.shape[1]), np.float32)
        for k in range(0, len(out), BLOCK):
            part = self.of(words[k:k + BLOCK])
            if k + BLOCK >= len(out):
                part = np.vstack([part, np.zeros((1, self.n), np.float32)])
            out[k:k + BLOCK] = part @ change
        return out


def _near(words: list[str], landmarks: list[str]) -> list[tuple[float, str]]:
    """(kernel, word) of the words that come near one of the landmarks."""
    out, kernels = [], Kernels(landmarks)
    for k in range(0, len(words), ROWS):
        part = words[k:k + ROWS]
        most = kernels.of(part).max(1, initial=0)
        out += [(float(v), w) for v, w in zip(most, part) if v >= NEAR]
    return out


def _pivots(words: list[str], n: int) -> list[str]:
    """``n`` of the words, each the one whose kernel those before explain least
    (pivoted Cholesky), the first ones first where tied."""
    left, rows, picked = np.ones(len(words)), np.zeros((0, len(words))), []
    while len(picked) < min(n, len(words)) and left.max() > 1e-9:
        i = int(left.argmax())
        row = kernel([words[i]], words)[0] - rows[:, i] @ rows
        row /= np.sqrt(left[i])
        rows = np.vstack([rows, row])
        left = np.maximum(left - row ** 2, 0)
        left[i] = 0
        picked.append(words[i])
    return picked


_SENTENCES = pa.list_(pa.list_(pa.string()))


@dataclass
class Sentences:
    """Labelled documents: place of each sentence's words in ``vocabulary``, the
    sentence of each place, the document of each sentence, the documents' labels."""

    vocabulary: list[str]
    word: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray
    y: np.ndarray

    @classmethod
    def of(cls, docs: pa.Array, y: np.ndarray) -> "Sentences":
        """From lists (documents) of lists (sentences) of words; copies (the same
        words and label) speak once."""
        docs = docs.combine_chunks() if isinstance(docs, pa.ChunkedArray) else docs
        each = docs.flatten()
        words = each.flatten().dictionary_encode()
        place = words.indices.to_numpy()
        size = np.asarray(pc.list_value_length(each)).astype(np.int64)
        per = np.asarray(pc.list_value_length(docs)).astype(np.int64)
        end = np.concatenate([[0], np.cumsum(size)])
        last = np.concatenate([[0], np.cumsum(per)])
        first: dict[tuple, int] = {}
        for i in range(len(docs)):
            a, b = last[i], last[i + 1]
            same = hashlib.sha256(size[a:b].tobytes())
            same.update(place[end[a]:end[b]].tobytes())
            first.setdefault((b - a, same.digest(), int(y[i])), i)
        keep = np.zeros(len(docs), bool)
        keep[list(first.values())] = True
        some = np.repeat(keep, per)
        place, size, per = place[np.repeat(some, size)], size[some], per[keep]
        return cls(words.dictionary.to_pylist(), place, np.repeat(np.arange(len(size), dtype=np.int32), size),
                   np.repeat(np.arange(len(per), dtype=np.int32), per), y[keep])

    def counts(self) -> np.ndarray:
        """(2, words): clean and toxic documents of each word."""
        n = len(self.vocabulary)
        pair = np.unique(self.doc[self.sentence].astype(np.int64) * n + self.word)
        return np.stack([np.bincount(pair[self.y[pair // n] == c] % n, minlength=n) for c in (0, 1)])

    def witnesses(self, value: np.ndarray) -> np.ndarray:
        """Each sentence's word of the highest value (the first one on ties)."""
        order = np.lexsort((self.word, -value[self.word], self.sentence))
        first = np.flatnonzero(np.diff(self.sentence[order], prepend=-1))
        return self.word[order[first]]


def _evidence(clean: np.ndarray, toxic: np.ndarray, rate: float) -> np.ndarray:
    """Log-likelihood ratio of a word's own toxic share against the overall one,
    for words above it."""
    n = clean + toxic
    p = toxic / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = toxic * np.log(p / rate) + np.where(clean > 0, clean * np.log((1 - p) / (1 - rate)), 0.0)
    return np.where(p > rate, gain, 0.0)


def fit_machine(texts: Iterable[str], y: np.ndarray, landmarks: int = LANDMARKS, max_landmarks: int = MAX_LANDMARKS) -> Machine:
    """Train on the sentences of labelled texts."""
    return fit_sentences(pa.array([sentences(t) for t in texts], _SENTENCES), y, landmarks, max_landmarks)


def fit_sentences(docs: pa.Array, y: np.ndarray, landmarks: int = LANDMARKS, max_landmarks: int = MAX_LANDMARKS) -> Machine:
    """Train on documents given as lists of the words of their sentences."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    flat = Machine(shift=float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return flat
    data = Sentences.of(docs, y)
    del docs
    release_memory()
    words = data.vocabulary
    clean, toxic = data.counts()
    gain = _evidence(clean, toxic, float(data.y.mean()))
    gain[[len(w) <= ORDER for w in words]] = 0
    seeds = np.flatnonzero(gain > np.log(max(1, len(words))) + 2)
    if not len(seeds):
        return flat
    start = [words[i] for i in sorted(seeds, key=lambda i: (-gain[i], words[i]))]
    marks = start if len(start) <= max_landmarks // 2 else _pivots(start, max_landmarks // 2)
    n_toxic = len(marks)
    near = _near(sorted(words), marks)
    most = sorted((-v, w) for v, w in near if w not in set(start))
    marks = marks + [w for _, w in most[:max(landmarks - n_toxic, n_toxic)]]
    # rows by place: the words near a landmark, then one row like none of them
    place = {w: i for i, w in enumerate(w for _, w in near)}
    del near, most
    row = np.array([place.get(w, len(place)) for w in words], np.int32)
    gram = kernel(marks, marks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-3
    whiten = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    kernels, near = Kernels(marks), list(place)
    x = kernels.changed(near, whiten)
    del near, place
    known = set(words)
    release_memory()
    spelled: dict[str, np.ndarray] = {}
    value = np.where(gain > 0, gain, -1.0) / gain.max()
    value[np.setdiff1d(np.arange(len(words)), seeds)] -= 1.0
    bad = data.y[data.doc] == 1     # by sentence
    machine = flat
    for _ in range(ROUNDS):
        witness = data.witnesses(value)
        # of a toxic document the most toxic sentence, and all words that are toxic so far
        order = np.lexsort((-value[witness], data.doc))
        best = order[np.flatnonzero(np.diff(data.doc[order], prepend=-1))]
        best = witness[best[(data.y[data.doc[best]] == 1) & (value[witness[best]] > -0.5)]]
        told = data.word[bad[data.sentence] & (value[data.word] > 0)]
        pos, n_pos = np.unique(np.concatenate([best, told]), return_counts=True)
        neg, n_neg = np.unique(row[witness[~bad]], return_counts=True)
        changed = [v for i in pos for v in _respelled(words[i]) if v not in known]
        fresh = [v for v in dict.fromkeys(changed) if v not in spelled]
        spelled.update(zip(fresh, kernels.of(fresh) @ whiten))
        other = np.array([spelled[v] for v in dict.fromkeys(changed)], np.float32).reshape(-1, x.shape[1])
        rows = np.vstack([x[row[pos]], other, x[neg]])
        label = np.concatenate([np.ones(len(pos) + len(other)), -np.ones(len(neg))])
        # the respelled copies of a word weigh as much as it does, all together
        copies = np.array([1.0] * len(other))
        w, b = _svm(rows, label, np.concatenate([n_pos, copies, n_neg]).astype(np.float64))
        value = (x @ w.astype(np.float32) + b)[row]
        machine = Machine(marks, n_toxic, whiten @ w, b)
        del rows, other
        release_memory()
    del x, spelled, known
    exact = machine.decisions(words)
    per = np.full(len(data.y), machine.bias)
    np.maximum.at(per, data.doc[data.sentence], exact[data.word])
    machine.slope, machine.shift = _logistic(per, data.y)
    return machine


def _respelled(word: str) -> set[str]:
    """The word with one or two letters put in, after its mark of the beginning."""
    w = word.removeprefix(BEGIN)
    one = {w[:i] + c + w[i:] for i in range(1, len(w)) for c in (w[i - 1], "x")}
    two = {w[:i] + "x" + w[i:j] + "y" + w[j:] for i, j in itertools.combinations(range(1, len(w)), 2)}
    return {BEGIN + v for v in one | two if len(v) <= LONG}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_FIT_ROWS, max_bytes: int = MAX_FIT_BYTES) -> Machine:
    """Sentences are cut on the executors; the driver gets the distinct words of
    each sentence of at most ``max_rows`` rows of at most ``max_bytes``, one row
    for each id."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in text_chunks(b):
                part = b.slice(lo, hi - lo)
                found = [sentences(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, _SENTENCES)],
                                                 ["doc_id", "y", "sentences"])

    sample = labelled_sample(docs, labels, label, max_rows).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    rows = map_arrow(sample, cut, "doc_id long, y int, sentences array<array<string>>")
    rows = rows.groupBy("doc_id", "y").agg(F.min("sentences").alias("sentences")).toArrow().sort_by("doc_id")
    y = np.asarray(rows["y"]).astype(np.int64)
    docs = [rows["sentences"].combine_chunks()]
    del rows
    release_memory()
    return fit_sentences(docs.pop(), y)     # popped, so that the fit can let go of them


class Scorer:
    """Document decisions inside a task; each distinct piece is looked at once."""

    def __init__(self, machine: Machine):
        self.machine = machine
        #: Place of each known piece in ``value`` (its decision) and ``kind``.
        self.known: dict[str, int] = {}
        self.value, self.kind = np.zeros(0), np.zeros(0, np.uint8)
        self.space = np.arange(256, dtype=np.uint8)
        self.space[[9, 10, 11, 12, 13, 28, 29, 30, 31]] = 32

    def _learn(self, pieces: list[str]) -> None:
        """All pieces are lower-cased and stripped as one text, a line for each."""
        if not pieces:
            return
        plain = _DROP_IN_LINES.sub("", "\n".join(pieces).lower()).split("\n")
        size = np.fromiter(map(len, plain), np.int64, len(plain))
        # several words, letters to be cut or repeated: the general way
        other = _repeats(plain, size) | (size > LONG)
        other[[i for i, p in enumerate(pieces) if not p.isascii() and len(p.split()) > 1]] = True
        parts = {i: [_DROP.sub("", q) for q in pieces[i].lower().split()] for i in np.flatnonzero(other).tolist()}
        seen = {i: [v for w in x if w for v in views(w)] for i, x in parts.items()}
        one = np.flatnonzero(~other & (size > 0))
        single = pa.array([BEGIN + plain[i] for i in one.tolist()], pa.string()).dictionary_encode()
        words = list(dict.fromkeys(itertools.chain(single.dictionary.to_pylist(), *seen.values())))
        decision = self.machine.decisions(words)
        value = np.full(len(pieces), -np.inf)
        value[one] = decision[single.indices.to_numpy()]    # these words come first
        place = dict(zip(words, decision)) if seen else {}
        for i, x in seen.items():
            value[i] = max((place[v] for v in x), default=-np.inf)
        kind = np.where(size == 0, BLANK, np.where(size <= 2, SHORT, 0)).astype(np.uint8)
        kind[[i for i, x in parts.items() if len(x) != 1 and size[i] > 0]] = 0
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.value, self.kind = np.concatenate([self.value, value]), np.concatenate([self.kind, kind])

    def decisions(self, texts: pa.Array) -> np.ndarray:
        raw, offsets = text_buffer(texts)
        flat = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.space[raw].tobytes()))
        split = pc.split_pattern(flat, " ")
        words = split.flatten().dictionary_encode()
        values = words.dictionary.to_pylist()
        new = [v for v in values if v not in self.known]
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known, new = {}, values
            self.value, self.kind = np.zeros(0), np.zeros(0, np.uint8)
        self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, values), np.int64, len(values))
        index = words.indices.to_numpy()
        value = self.value[at][index]
        ends = np.asarray(split.offsets)
        out = np.maximum.reduceat(np.append(value, -np.inf), ends[:-1]) if len(ends) > 1 else np.zeros(0)
        self._joined(self.kind[at][index], values, index, ends, out)
        return np.where(np.isfinite(out), out, self.machine.bias)

    def _joined(self, kind, values, index, ends, out) -> None:
        """Runs of three or more short pieces count joined as well; pieces
        without letters in between do not break a run."""
        at = np.flatnonzero(kind != BLANK)
        one = kind[at] == SHORT
        row = np.searchsorted(ends, at, side="right") - 1
        start = one & ~np.concatenate([[False], one[:-1] & (row[1:] == row[:-1])])
        stop = one & ~np.concatenate([one[1:] & (row[1:] == row[:-1]), [False]])
        runs = [(a, b) for a, b in zip(np.flatnonzero(start), np.flatnonzero(stop)) if b - a > 1]
        if runs:
            bare = {k: _DROP.sub("", values[k].lower()) for k in np.unique(index[at[one]]).tolist()}
            words = [joined([bare[k] for k in index[at[a:b + 1]].tolist()], self.machine.join) for a, b in runs]
            every = list(dict.fromkeys(w for x in words for w in x))
            value = dict(zip(every, self.machine.decisions(every)))
            for (a, _), x in zip(runs, words):
                out[row[a]] = max(out[row[a]], max((value[w] for w in x), default=-np.inf))


def _repeats(words: list[str], size: np.ndarray) -> np.ndarray:
    """Which words have three or more equal letters in a row."""
    c = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    at = np.flatnonzero((c[2:] == c[1:-1]) & (c[1:-1] == c[:-2]))
    end = np.cumsum(size)
    of = np.searchsorted(end, at, side="right")
    out = np.zeros(len(words), bool)
    out[of[at + 2 < end[of]]] = True
    return out


_SCORERS: dict[bytes, Scorer] = {}


def _scorer(machine: Machine) -> Scorer:
    """The worker's scorer: the words of one task are known to the next."""
    key = hashlib.sha256(repr((machine.landmarks, machine.toxic, machine.bias)).encode() + machine.weights.tobytes()).digest()
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(machine)
    return _SCORERS[key]


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row, texts whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(machine)
        for b in batches:
            for lo, hi in text_chunks(b, limit=CHUNK_BYTES):
                part = b.slice(lo, hi - lo)
                p = machine.probability(scorer.decisions(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                                 ["doc_id", "score", "predicted"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")
