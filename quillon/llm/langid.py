"""Language identification as inference of a multilingual mixture.

Learning counts letter trigrams (hashed into BINS features) for each label over all training rows; counts are summed
within each task before the one small shuffle. The model is a table of BINS x languages and comes to the driver as Arrow
columns, so its size is bounded by the number of labels, of which there may be any. Prediction is a pass without a shuffle: for each document an
expectation-maximisation estimates the proportions of the languages from the likelihoods of its trigrams, and the set of
languages grows in the order of these proportions as long as the likelihood, penalised for each language, rises.

Result columns: lang_pred, the language of the largest proportion (`und` if the text is null or has no letter, or if
nothing was learned); score, that proportion, 0 for `und`; langs, the selected set in alphabetical order. Training
rows with null label or text don't count. Ties go to the alphabetically first language. Texts are read whole, whatever
their length. Empty input: no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import added, chunks, mapped, texts_of

BINS = 1 << 16
UNKNOWN = "und"
SMOOTHING = 0.2
#: Each letter is in three trigrams, so these are worth a third of as many independent observations.
OVERLAP = 3
ROUNDS, REFINE = 8, 4
#: Text of one step; each of its characters takes some 60 bytes while trigrams are formed, and 4 for each language. Of more
#: than MANY languages a step takes less text.
STEP_BYTES, MANY = 1 << 20, 32


@functools.cache
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint32)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, count) of the distinct trigrams, sorted by document."""
    joined = "\n\n" + "\n\n".join(texts).lower() + "\n\n"
    lengths = np.array([len(t.lower()) for t in texts], np.int64)
    code = _letters()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    middle = np.flatnonzero(code[1:-1])
    a, b, c = (code[middle + i].astype(np.uint64) for i in range(3))
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    feature = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
    ends = np.cumsum(lengths + 2) + 2  # behind the separator of each document
    doc = np.searchsorted(ends, middle + 1, "right")
    key = doc.astype(np.uint64) << np.uint64(16) | feature
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    key, count = key[new], np.diff(np.append(new, len(key)))
    return (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(0xFFFF)).astype(np.int64), count


class Model:
    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.p = np.stack([(c + SMOOTHING) / (c.sum() + SMOOTHING * BINS) for c in map(counts.get, self.langs)], axis=1).astype(np.float32) if counts else np.zeros((BINS, 0), np.float32)

    def predict(self, texts: list[str]) -> list[tuple[str, float, list[str]]]:
        out = [(UNKNOWN, 0.0, [])] * len(texts)
        doc, feature, count = features(texts)
        if not len(doc) or not self.langs:
            return out
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        ids, seg = doc[starts], np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
        p = self.p[feature]
        p /= p.max(axis=1, keepdims=True)
        weight = count.astype(np.float32)
        total = np.add.reduceat(weight, starts)
        share = np.full((len(ids), len(self.langs)), 1 / len(self.langs), np.float32)
        share, _ = _em(p, weight, starts, seg, total, share, ROUNDS)
        order = np.argsort(-share, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        penalty = OVERLAP * 0.5 * np.log(np.maximum(total, 2))
        best, best_value = np.where(rank == 0, 1, 0).astype(np.float32), None
        going = np.arange(len(ids))
        for k in range(1, len(self.langs) + 1):
            rows = np.isin(seg, going) if len(going) < len(ids) else np.ones(len(seg), bool)
            own = share[going] * (rank[going] < k)
            own /= np.maximum(own.sum(axis=1, keepdims=True), 1e-30)
            first = np.flatnonzero(np.diff(np.concatenate([[-1], seg[rows]])))
            sub = np.cumsum(np.diff(np.concatenate([seg[rows][:1], seg[rows]])) > 0)
            own, value = _em(p[rows], weight[rows], first, sub, total[going], own.astype(np.float32), REFINE if k > 1 else 0)
            value = value - k * penalty[going]
            if best_value is None:
                best_value = value
                continue
            up = value > best_value[going]
            if not up.any():
                break
            going = going[up]
            best[going], best_value[going] = own[up], value[up]
        top = best.argmax(axis=1)
        for k, d in enumerate(ids):
            out[d] = (self.langs[top[k]], float(min(1.0, best[k, top[k]])), [x for x, s in zip(self.langs, best[k], strict=True) if s > 0])
        return out


def _em(p, weight, starts, seg, total, share, rounds):
    """Proportions after so many rounds, and the log-likelihood (up to what doesn't depend on them)."""
    for _ in range(rounds):
        part = p * share[seg]
        part *= (weight / np.maximum(part.sum(axis=1), 1e-30))[:, None]
        share = np.add.reduceat(part, starts, axis=0) / total[:, None]
    mixed = np.maximum((p * share[seg]).sum(axis=1), 1e-30)
    return share, np.add.reduceat(weight * np.log(mixed), starts)


def learn(df: DataFrame, label: str = "lang", text: str = "text") -> Model:
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for part in chunks(batches, "text", STEP_BYTES):
            labels = part.column("lang").to_pylist()
            doc, feature, n = features(texts_of(part.column("text")).to_pylist())
            code = {x: i for i, x in enumerate(sorted(set(labels)))}
            of = np.array([code[x] for x in labels])[doc]
            for x, i in code.items():
                at = of == i
                sums[x] = sums.get(x, 0) + np.bincount(feature[at], n[at], BINS).astype(np.int64)
        for x, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["lang", "feature", "n"])

    known = df.select(F.col(label).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sums = mapped(known, count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = sums.toArrow()  # BINS rows for each label at most
    names = pa.chunked_array(table.column("lang").chunks, pa.string()).combine_chunks().dictionary_encode()
    code, feature, n = names.indices.to_numpy(), table.column("feature").to_numpy(), table.column("n").to_numpy()
    counts = {}
    for k, name in enumerate(names.dictionary.to_pylist()):
        counts[name] = np.bincount(feature[code == k], n[code == k], BINS).astype(np.int64)
    return Model(counts)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred, score and langs, which replace columns of these names."""
    own = ["lang_pred", "score", "langs"]
    names = [c for c in df.columns if c not in own]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in chunks(batches, text, STEP_BYTES * MANY // max(MANY, len(shared.value.langs))):
            found = shared.value.predict(texts_of(part.column(text)).to_pylist())
            lang, score, langs = zip(*found, strict=True)
            columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *columns], names=[*names, *own])

    return mapped(df, run, added(df.select(names), "lang_pred string, score double, langs array<string>"))
