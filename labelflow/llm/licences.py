"""Licence scan: notices found by template shingles, judged by a trained classifier.

A notice is looked for by words, whatever the line breaks, comment marks and
blank lines between them: a window of bounded length slides over the words of the
whole text, and one that holds at least CONFIRM of the different 3-word shingles of a
template is a candidate, however long the line or text around it is.  Words that
tell families and versions apart (REQUIRED) must stand in the window.

Candidates that lie to half in one of more shingles form a passage with it.  The
words of a passage, and no others, are a sparse bag of word 1- and 2-grams,
hashed into SLOTS columns (those of no template share their weights).  A multinomial
logistic regression, trained here, gives the probability of each licence family and
of the class "unknown"; a temperature fitted on held-back rows calibrates it.  The
passage is a notice of its most probable family among those that a candidate
confirms, if that is more probable than unknown, and none otherwise; likeness only
decides between candidates of one family.

Training rows: the templates, variants of them (words dropped, other text around
them), and as unknown the lines of a bounded sample of documents that resemble no
template.

A paragraph is a line; a notice is listed with the one it starts in.  Null texts
have no paragraphs.  Rows count one by one, repeated ones too; without
documents to sample, the unknown class is trained on word salad of the templates
alone.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import map_arrow, mix64, odd_numbers, text_buffer, text_chunks
from labelflow.llm.shingles import word_hashes

SLOTS = 1 << 16
#: Documents whose paragraphs the unknown class is trained on (a sample by id hash).
MAX_FIT_DOCS = 1_000
#: Paragraphs of them that are used at most.
MAX_FIT_PARAGRAPHS = 8_000
#: Words of each of them that are trained on, as many as a usual candidate has.
FIT_WORDS = 48
CONFIRM = 0.6
#: A window has at most this many words for each of the template's, and SLACK more.
STRETCH = 1.5
SLACK = 8
#: Words on either side of a window in which a required phrase may end.
MARGIN = 2
VARIANTS = 40
SEED = 9

# Public notices of licence families.
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License "
        "as published by the Free Software Foundation, either version {1} of the License, or any later version.")
_GNU_OLD = ("This {2} is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public License "
            "as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version.")
_CC = "This work is licensed under a Creative Commons {0} {1} License."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = (" 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
          " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
          " in the documentation and/or other materials provided with the distribution.")
_BSD_3 = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
          " derived from this software without specific prior written permission.")
_BSD_END = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,"
            " BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"


def _gnu(name: str, version: str, spdx: str, thing: str = "program") -> tuple[str, ...]:
    short = version.removesuffix(".0")
    return (f"This work is licensed under the GNU {name}General Public License, version {short}.", _GNU.format(name, short),
            _GNU_OLD.format(name, short, thing), f"Licensed under the GNU {name}General Public License v{version}.",
            f"SPDX-License-Identifier: {spdx}-{version}")


def _cc(short: str, name: str, version: str = "4.0", area: str = "International") -> tuple[str, ...]:
    return (f"Licensed under CC {short} {version}.", _CC.format(f"{name} {version}", area), f"SPDX-License-Identifier: CC-{short}-{version}")


TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "SPDX-License-Identifier: Apache-2.0"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", _BSD, _BSD + _BSD_1 + _BSD_3, _BSD + _BSD_1 + _BSD_3 + _BSD_END,
                     "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "GPL-3.0": _gnu("", "3.0", "GPL"),
    "MIT": ("Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "AGPL-3.0": _gnu("Affero ", "3.0", "AGPL"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", _BSD + _BSD_1, _BSD + _BSD_1 + _BSD_END, "SPDX-License-Identifier: BSD-2-Clause"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-3.0": _cc("BY-SA", "Attribution-ShareAlike", "3.0", "Unported"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication.",
                "SPDX-License-Identifier: CC0-1.0"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
                "SPDX-License-Identifier: EPL-2.0"),
    "GPL-2.0": _gnu("", "2.0", "GPL"),
    "ISC": ("Released under the ISC License.", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.",
            "SPDX-License-Identifier: ISC"),
    "LGPL-2.1": _gnu("Lesser ", "2.1", "LGPL", "library"),
    "LGPL-3.0": _gnu("Lesser ", "3.0", "LGPL", "library"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "Zlib": ("Released under the zlib License.",
             "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
             "SPDX-License-Identifier: Zlib"),
}
FAMILIES = tuple(TEMPLATES)
UNKNOWN = len(FAMILIES)
_WORD = re.compile(r"(?:[a-z0-9]|(?<=[0-9])\.(?=[0-9]))+")


def plain_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


#: Phrases that tell families apart, as alternatives: a template that holds one
#: of a group is only found where one of the group stands.
_V = {v: (f"version {v}", f"version {v.removesuffix('.0')}", f"v{v}", f"v{v.removesuffix('.0')}", f"v {v}", f"license {v}") for v in ("1.0", "2.0", "2.1", "3.0")}
REQUIRED = {
    "Apache-2.0": (("apache license",), _V["2.0"]),
    "BSD-3-Clause": (("3 clause",), ("neither the name",)),
    "BSD-2-Clause": (("2 clause",),),
    "BSL-1.0": (("boost software license",), _V["1.0"]),
    "CC0-1.0": (("cc0 1.0",),),
    "EPL-2.0": (("eclipse public license",), _V["2.0"]),
    "GPL-2.0": (("gnu general public license",), _V["2.0"]),
    "GPL-3.0": (("gnu general public license",), _V["3.0"]),
    "LGPL-2.1": (("lesser general public license",), _V["2.1"]),
    "LGPL-3.0": (("lesser general public license",), _V["3.0"]),
    "AGPL-3.0": (("affero general public license",), _V["3.0"]),
    "ISC": (("isc license",), ("provided that the above",)),
    "MIT": (("mit license",),),
    "MPL-2.0": (("mozilla public license",), _V["2.0"]),
    "Unlicense": (("unencumbered software",),),
    "Zlib": (("zlib license",),),
} | {f: ((f.removesuffix(v).lower().replace("-", " ") + v,), (" ".join(plain_words(TEMPLATES[f][1])[7:-2]),))
     for f in TEMPLATES if f.startswith("CC-") for v in (f[-3:],)}


def _shingles(words: list[str], size: int = 3) -> frozenset:
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


@dataclass(frozen=True)
class Template:
    family: int
    n_words: int
    shingles: frozenset
    required: tuple[tuple[str, ...], ...]

    @property
    def window(self) -> int:
        return int(STRETCH * self.n_words) + SLACK


def _template(k: int, text: str) -> Template:
    words = plain_words(text)
    line = f" {' '.join(words)} "
    groups = [g for g in REQUIRED[FAMILIES[k]] if any(f" {p} " in line for p in g)]
    if words[:3] == ["spdx", "license", "identifier"]:
        groups = [(" ".join(words[1:]),)]
    return Template(k, len(words), _shingles(words), tuple(groups))


_TEMPLATES = [_template(k, t) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f]]


def likeness(text: str, family: str) -> float:
    """Largest share of a template's shingles that the text holds."""
    own = _shingles(plain_words(text))
    return max(len(t.shingles & own) / len(t.shingles) for t in _TEMPLATES if FAMILIES[t.family] == family)


def _resembles(text: str, least: float) -> bool:
    own = _shingles(plain_words(text))
    return any(len(t.shingles & own) >= least * len(t.shingles) for t in _TEMPLATES)


def word_starts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``plain_words`` of all rows (ASCII): hashes, first bytes, ends, row of each."""
    plain = np.full(256, 32, np.uint8)
    plain[48:58], plain[97:123], plain[65:91] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123)
    flat = plain[raw]
    digit = (raw >= 48) & (raw < 58)
    dot = np.flatnonzero(raw[1:-1] == 46) + 1
    dot = dot[digit[dot - 1] & digit[dot + 1]]
    at_edge = np.zeros(len(raw) + 1, bool)
    at_edge[offsets] = True
    flat[dot[~at_edge[dot] & ~at_edge[dot + 1]]] = 46
    word = flat != 32
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | at_edge[1:-1]
    last[:-1] &= ~word[1:] | at_edge[1:-1]
    h, per_row = word_hashes(flat, offsets)
    return h, np.flatnonzero(first), np.flatnonzero(last) + 1, np.repeat(np.arange(len(per_row)), per_row)


def _mixed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    x, y, z = odd_numbers(3, 43)
    return mix64(a * x + b * y + c * z)


class Finder:
    """Candidate notices of texts: windows like a template, required words held."""

    def __init__(self, confirm: float = CONFIRM):
        self.need = [max(1, -(-int(round(confirm * 1000)) * len(t.shingles) // 1000)) for t in _TEMPLATES]
        grams = sorted({s for t in _TEMPLATES for s in t.shingles})
        h, *_ = word_starts(*text_buffer(pa.array([" ".join(g) for g in grams])))
        keys = _mixed(*h.reshape(-1, 3).T)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.uses = [[k for k, t in enumerate(_TEMPLATES) if grams[i] in t.shingles] for i in order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(row, first byte, end, family, likeness) of the candidates, best of
        those that overlap not yet chosen, with the number of shingles last."""
        h, begin, end, row = word_starts(raw, offsets)
        if len(h) < 3:
            return []
        key = _mixed(h[:-2], h[1:-1], h[2:])
        at = np.flatnonzero(self.maybe[(key & np.uint64(0xFFFF)).astype(np.int64)] & (row[:-2] == row[2:]))
        place = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
        same = self.keys[place] == key[at]
        at, place = at[same], place[same]
        out = []
        hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, p, r in zip(at.tolist(), place.tolist(), row[at].tolist()):
            for t in self.uses[p]:
                hits.setdefault((r, t), []).append((i, p))
        for (r, k), found in hits.items():
            if len(found) < self.need[k]:
                continue
            t = _TEMPLATES[k]
            for a, b, n in windows(found, self.need[k], t.window):
                lo, hi = max(a - MARGIN, int(np.searchsorted(row, r))), min(b + 2 + MARGIN, int(np.searchsorted(row, r, "right")) - 1)
                line = f" {' '.join(plain_words(raw[begin[lo]:end[hi]].tobytes().decode(errors='replace')))} "
                if all(any(f" {p} " in line for p in g) for g in t.required):
                    out.append((r, int(begin[a]), int(end[b + 2]), t.family, n / len(t.shingles), n))
        return out


def windows(found: list[tuple[int, int]], need: int, span: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, number) of the disjoint windows over ``found`` (place, shingle)
    of at most ``span`` places with at least ``need`` different shingles, each the
    fullest of those that start with it and no longer than needed."""
    seen: Counter = Counter()
    lo = hi = 0
    best: tuple[int, int, int] | None = None
    after = 0

    def drop() -> None:
        nonlocal lo
        s = found[lo][1]
        seen[s] -= 1
        if not seen[s]:
            del seen[s]
        lo += 1

    while hi < len(found):
        place, s = found[hi]
        if best and place > best[0] + span:
            yield best
            best = None
            while lo < after:
                drop()
        seen[s] += 1
        hi += 1
        while found[lo][0] + span - 2 <= place and lo < hi - 1:
            drop()
        while lo < hi - 1 and seen[found[lo][1]] > 1:
            drop()
        if len(seen) >= need and (best is None or len(seen) > best[2]):
            best, after = (found[lo][0], place, len(seen)), hi
    if best:
        yield best


def passages(found: list[tuple]) -> list[list[tuple]]:
    """The candidates of one text in groups: one that lies to half in a candidate of
    more shingles belongs to it.  The fullest of a group comes first."""
    groups: list[list[tuple]] = []
    for x in sorted(found, key=lambda x: (-x[5], -x[4], x[1], x[3])):
        home = next((g for g in groups if 2 * (min(x[2], g[0][2]) - max(x[1], g[0][1])) >= x[2] - x[1]), None)
        groups.append([x]) if home is None else home.append(x)
    return sorted(groups, key=lambda g: g[0][1])


def judged(found: list[tuple], raw: np.ndarray, model: "Classifier") -> list[tuple]:
    """(*candidate, probability) of the notices in one text: the classifier names the
    family of a passage, one of its candidates must confirm it."""
    groups = passages(found)
    if not groups:
        return []
    spans = [raw[min(x[1] for x in g):max(x[2] for x in g)].tobytes().decode() for g in groups]
    out = []
    for g, q in zip(groups, model.probabilities(*text_buffer(pa.array(spans)))):
        best = max(g, key=lambda x: (q[x[3]], x[5], x[4]))
        if q[best[3]] > q[UNKNOWN]:
            out.append((*best, float(q[best[3]])))
    return out


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the 1- and 2-grams of each row (row numbers, columns)."""
    h, _, _, row = word_starts(raw, offsets)
    a, b = odd_numbers(2, 41)
    two = mix64(h[:-1] * a + h[1:] * b)[row[:-1] == row[1:]] if len(h) > 1 else h[:0]
    rows = np.concatenate([row, row[:-1][row[:-1] == row[1:]]]) if len(h) > 1 else row
    return rows, (np.concatenate([h, two]) & np.uint64(SLOTS - 1)).astype(np.int64)


def paragraphs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the lines of all rows, and the row of each line."""
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(raw == 10) + 1]))
    return cuts, np.searchsorted(offsets, cuts[:-1], side="right") - 1


@dataclass
class Classifier:
    """Log-odds = mean gram weight * sqrt(number of grams) + bias, over the temperature."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        count = np.maximum(np.bincount(rows, minlength=n), 1)
        out = np.stack([np.bincount(rows, self.weights[columns, k], n) for k in range(len(self.bias))], 1)
        return out / np.sqrt(count)[:, None] + self.bias

    def probabilities(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.logits(*grams(raw, offsets), len(offsets) - 1) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True, initial=-np.inf))
        return p / p.sum(1, keepdims=True)


def _variants(rng: np.random.Generator, salad: list[str]) -> tuple[list[str], list[int]]:
    texts, label = [], []
    for k, f in enumerate(FAMILIES):
        for t in TEMPLATES[f]:
            words = t.split()
            for i in range(VARIANTS):
                w = [x for x in words if i == 0 or rng.random() > 0.08]
                around = [salad[j] for j in rng.integers(0, len(salad), rng.integers(0, 6))] if i % 2 else []
                at = rng.integers(0, len(around) + 1)
                texts.append(" ".join([*around[:at], *w, *around[at:]]))
                label.append(k)
    every = [w for ts in TEMPLATES.values() for t in ts for w in t.split()]
    for _ in range(4 * VARIANTS):  # words of notices out of order are no licence
        texts.append(" ".join(every[j] for j in rng.integers(0, len(every), rng.integers(2, 14))))
        label.append(UNKNOWN)
    return texts, label


def train(unknown: list[str], steps: int = 200, rate: float = 1.0, l2: float = 1e-4) -> Classifier:
    """Full-batch gradient steps with momentum, then the temperature on every fifth row."""
    rng = np.random.default_rng(SEED)
    salad = [w for t in unknown[:500] for w in t.split()] or ["text"]
    texts, label = _variants(rng, salad)
    texts, y = texts + unknown, np.array(label + [UNKNOWN] * len(unknown))
    rows, cols = grams(*text_buffer(pa.array(texts)))
    n, k = len(texts), UNKNOWN + 1
    # grams that no template holds share one column, the last
    used = np.unique(grams(*text_buffer(pa.array([t for ts in TEMPLATES.values() for t in ts])))[1])
    place = np.full(SLOTS, len(used))
    place[used] = np.arange(len(used))
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    x = np.bincount(rows * (len(used) + 1) + place[cols], minlength=n * (len(used) + 1)).reshape(n, -1).astype(np.float32)
    x *= scale[:, None].astype(np.float32)
    fit = np.arange(n) % 5 != 4
    weight = np.where(fit, 1 / np.bincount(y, minlength=k)[y], 0)
    weight /= weight.sum()
    w, b = np.zeros((len(used) + 1, k), np.float32), np.zeros(k)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    one = np.eye(k)[y]

    def logits() -> np.ndarray:
        return x @ w + b

    def soft(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    for _ in range(steps):
        g = (soft(logits()) - one) * weight[:, None]
        vw, vb = 0.9 * vw - rate * (x.T @ g.astype(np.float32) + l2 * w), 0.9 * vb - rate * g.sum(0)
        w, b = w + vw, b + vb
    z, held = logits()[~fit], y[~fit]
    temps = np.geomspace(0.2, 5, 60)
    loss = [-np.log(np.maximum(soft(z / t)[np.arange(len(held)), held], 1e-12)).mean() for t in temps]
    return Classifier(w[place].astype(np.float64), b, float(temps[int(np.argmin(loss))]))


def fit(docs: DataFrame, max_docs: int = MAX_FIT_DOCS) -> Classifier:
    """Train with the paragraphs of at most about ``max_docs`` documents."""
    n = docs.count()
    share = min(1.0, 0.95 * max_docs / max(1, n))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    lines = (sample.select(F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) > 0")
             .select(F.array_join(F.slice(F.split(F.trim("line"), r"\s+"), 1, FIT_WORDS), " ").alias("line")).distinct()
             .orderBy(F.xxhash64("line"), "line").limit(MAX_FIT_PARAGRAPHS))
    texts = lines.toArrow()["line"].to_pylist()
    return train([t for t in texts if not _resembles(t, 0.3)])


def scan(docs: DataFrame, model: Classifier, confirm: float = CONFIRM) -> DataFrame:
    """Per row: doc_id, n_paragraphs, licences (array of paragraph number,
    family, probability, likeness) of the whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(confirm)
        kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()),
                                   ("probability", pa.float64()), ("likeness", pa.float64())]))
        for b in batches:
            for lo, hi in text_chunks(b):
                part = b.slice(lo, hi - lo)
                raw, offsets = text_buffer(part.column(1))
                cuts, row = paragraphs(raw, offsets)
                first = np.searchsorted(row, np.arange(hi - lo))
                own: list[list] = [[] for _ in range(hi - lo)]
                for x in finder.find(raw, offsets):
                    own[x[0]].append(x)
                found = [[{"paragraph": int(np.searchsorted(cuts, x[1], side="right") - 1 - first[x[0]]), "family": FAMILIES[x[3]],
                           "probability": x[6], "likeness": x[4]} for x in judged(o, raw, model)] for o in own]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.bincount(row, minlength=hi - lo).astype(np.int64)), pa.array(found, kind)],
                    ["doc_id", "n_paragraphs", "licences"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_paragraphs long, "
                     "licences array<struct<paragraph: int, family: string, probability: double, likeness: double>>")


def report(docs: DataFrame, model: Classifier, confirm: float = CONFIRM) -> DataFrame:
    """doc_id, n_paragraphs, n_licences, families (sorted, comma-joined)."""
    return scan(docs, model, confirm).select(
        "doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct("licences.family")), ",").alias("families"))
