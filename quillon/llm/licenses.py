"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are cut into words; hashes of GRAM consecutive words are winnowed (the least of each WINDOW neighbours is a
fingerprint), so any GRAM + WINDOW - 1 words in common give a common fingerprint. Of templates under SHORT_WORDS words every
pair of neighbours is one. An inverted index leads from a fingerprint to templates and places. Fingerprints of a document
that hit one template on nearby diagonals make one candidate, which is aligned with the whole template inside a band; a
match covers at least COVERAGE of its words. What is left of a candidate before and behind a match is looked at again.

Result: df with `licenses`, array<struct<name, matched, coverage, start, end>> by start, positions in code points, end
exclusive. Null, empty or wordless text has none; texts are scanned whole; each occurrence is a match of its own. The
templates are the texts in the folder templates/, whole licenses, their headers for single files and one-line notices,
or any others given. No shuffle. Empty input: no rows. Other columns pass through, but for one named licenses, which the
result replaces.
"""

from __future__ import annotations

import functools
import importlib.resources
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.align import common
from quillon.llm.common import added, chunks, mapped, texts_of
from quillon.llm.decontam import _LETTERS, words
from quillon.llm.neardup import _P, _mixed

GRAM, WINDOW = 3, 3
#: Templates of fewer words are found by all their pairs of neighbours.
SHORT_WORDS = 30
COVERAGE = 0.8
#: Share of a template's fingerprints that a candidate has to hit, and half the band as a share of the template's words.
HITS, BAND = 0.2, 0.25


@functools.cache
def templates() -> dict[str, str]:
    folder = importlib.resources.files("quillon.llm") / "templates"
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name)}


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NONE = np.uint64(2**64 - 1)


def fingerprints(code: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the winnowed grams; grams that hold a code of 0 or less don't count."""
    n = len(code) - gram + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known, hashes = np.ones(n, bool), np.zeros(n, np.uint64)
    for k in range(gram):
        known &= code[k : k + n] > 0
        hashes += np.maximum(code[k : k + n], 0).astype(np.uint64) * _P[k]
    hashes = np.where(known, _mixed(hashes), _NONE)
    padded = np.concatenate([hashes, np.full(window - 1, _NONE)])  # a short text is one window
    place = np.unique(np.arange(n) + np.lib.stride_tricks.sliding_window_view(padded, window).argmin(axis=1))
    place = place[place < n]
    place = place[hashes[place] != _NONE]
    return place, hashes[place]


class Index:
    """The inverted index of some of the templates' codes, by number."""

    def __init__(self, codes: dict[int, np.ndarray], gram: int, window: int):
        self.gram, self.window, self.codes = gram, window, codes
        self.size, self.band, rows = {}, {}, []
        for t, code in codes.items():
            place, hashes = fingerprints(code, gram, window)
            self.size[t], self.band[t] = len(place), max(2, int(BAND * len(code)))
            rows += [(int(h), t, int(p)) for p, h in zip(place, hashes, strict=True)]
        rows.sort()
        self.hashes = np.array([r[0] for r in rows], np.uint64)
        self.of, self.at = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        self.reach = np.array([self.band.get(t, 0) for t in range(max(codes, default=-1) + 1)])

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and hash of the fingerprints of code that some template has."""
        place, hashes = fingerprints(code, self.gram, self.window)
        known = np.searchsorted(self.hashes, hashes, "right") > np.searchsorted(self.hashes, hashes)
        return place[known], hashes[known]

    def candidates(self, place: np.ndarray, hashes: np.ndarray):
        """(template, places in the text, places in the template) of each group of hits on nearby diagonals."""
        low, high = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, "right")
        n = high - low
        hit = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        template, own, text = self.of[hit], self.at[hit], np.repeat(place, n)
        order = np.lexsort((text - own, template))
        template, own, text = template[order], own[order], text[order]
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(template) != 0) | (np.diff(text - own) > self.reach[template[1:]]), [True]]))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield int(template[a]), text[a:b], own[a:b]

    def matches(self, code: np.ndarray, place: np.ndarray, hashes: np.ndarray, coverage: float):
        """(template, matched words, first word, end) of each match."""
        todo = [(*c, 0, len(code)) for c in self.candidates(place, hashes)]
        while todo:
            t, text, own, start, stop = todo.pop()
            if len(np.unique(own)) < HITS * self.size[t]:
                continue
            template, band = self.codes[t], self.band[t]
            found = aligned(template, code[start:stop], int((text - own).min()) - start, int((text - own).max()) - start, band, coverage)
            if found:
                matched, a, b = found[0], found[1] + start, found[2] + start
                yield t, matched, a, b
                for x, y in ((start, a), (b, stop)):
                    inside = (text >= x) & (text + self.gram <= y)
                    todo.append((t, text[inside], own[inside], x, y))


def aligned(template: np.ndarray, code: np.ndarray, first: int, last: int, band: int, coverage: float) -> tuple[int, int, int] | None:
    """Number of template words matched in order within the band around the diagonals, first word and end of the match; None
    if they cover less. No part of the table is kept: the end comes from a pass forwards, the first word from one back."""
    n, low, high = len(template), first - band, last + band
    skip = max(0, low)
    part = code[skip : max(skip, high + n)]
    matched, end = common(template, part, low - skip, high - skip)
    if matched < coverage * n - 1e-9:
        return None
    low, high = low - skip, high - skip
    _, back = common(template[::-1], part[:end][::-1], end - n - high, end - n - low)
    return matched, skip + end - back, skip + end


@functools.lru_cache(maxsize=2)
def _indexes(fixed: tuple) -> tuple[dict[bytes, int], list[str], list[np.ndarray], list[Index]]:
    said = [words(text) for _, text in fixed]
    vocab = {w: i + 1 for i, w in enumerate(sorted({w for x in said for w in x}))}
    codes = [np.array([vocab[w] for w in x], np.int64) for x in said]
    long, short = ({t: c for t, c in enumerate(codes) if len(c) and (len(c) < SHORT_WORDS) == s} for s in (False, True))
    return vocab, [name for name, _ in fixed], codes, [Index(long, GRAM, WINDOW), Index(short, 2, 1)]


def scan(df: DataFrame, text: str = "text", given: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """df with `licenses`; given: name -> text of other templates."""
    names = [c for c in df.columns if c != "licenses"]
    fixed = df.sparkSession.sparkContext.broadcast(tuple((given or templates()).items()))  # 250 KB
    kind = pa.list_(pa.struct([("name", pa.string()), ("matched", pa.int32()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        vocab, called, codes, indexes = _indexes(fixed.value)
        get = (vocab | {b"A": -1}).get
        for part in chunks(batches, text):
            texts = texts_of(part.column(text)).to_pylist()
            said = b" A ".join([t.encode().translate(_LETTERS) for t in texts]).split()
            code = np.array([get(w, 0) for w in said] + [-1], np.int64)
            stops = np.flatnonzero(code == -1)
            found: list[list] = [[] for _ in texts]
            for index in indexes:
                place, hashes = index.hits(code)
                doc = np.searchsorted(stops, place)
                bounds = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
                for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                    d = int(doc[i])
                    a, spans = int(stops[d - 1]) + 1 if d else 0, None
                    for t, matched, x, y in index.matches(code[a : stops[d]], place[i:j] - a, hashes[i:j], coverage):
                        spans = spans or [m.span() for m in _WORD.finditer(texts[d])]
                        found[d].append({"name": called[t], "matched": matched, "coverage": matched / len(codes[t]), "start": spans[x][0], "end": spans[y - 1][1]})
            for x in found:
                x.sort(key=lambda m: (m["start"], m["end"], m["name"]))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(found, kind)], names=[*names, "licenses"])

    return mapped(df, run, added(df.select(names), "licenses array<struct<name:string,matched:int,coverage:double,start:int,end:int>>"))
