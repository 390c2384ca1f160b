"""Constituency parsing by a chart: rule counts of a treebank, probabilities, inside-outside, and parsing in batches.

A grammar is small (rules of two parts over a closed set of symbols) and goes to every task; counts over trees and
sentences are summed in each task before they are shuffled.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import chart, sequences
from quillon.functions.chart import MIDDLE, Grammar
from quillon.functions.forest import LIMIT, Forest

#: Sentences of more words get the status too_long: a chart grows with the square, its time with the cube.
MOST_WORDS = 120
RULES = "lhs string, rhs string, n long"
_LEAF = r"\(([^\s()]+)\s+([^\s()]+)\)"


def leaf_tags(parse: Column) -> Column:
    return F.regexp_extract_all(parse, F.lit(_LEAF), F.lit(1))


def leaf_words(parse: Column) -> Column:
    return F.regexp_extract_all(parse, F.lit(_LEAF), F.lit(2))


def count_rules(parses: DataFrame, parse: str = "parse_str") -> DataFrame:
    """lhs, rhs (labels, a space between), n: how often a node has these children; words and nodes without children don't
    count. Equal subtrees of a task are looked at once."""

    def run(batches):
        forest, seen = Forest(most=1), Counter()
        for batch in batches:
            seen.update(r for t in batch.column(0).to_pylist() if t is not None and (r := forest.root(t)) is not None)
            if forest.size > LIMIT:
                yield summed(forest, seen)
                forest, seen = Forest(most=1), Counter()
        yield summed(forest, seen)

    def summed(forest, seen):
        out = Counter()
        for k, n in forest.times(seen):
            if below := tuple(forest.labels[c] for c in forest.kids[k] if c >= 0):
                out[forest.labels[k], below] += n
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([" ".join(b) for _, b in out], pa.string()), pa.array(list(out.values()), pa.int64())], names=["lhs", "rhs", "n"])

    return parses.select(parse).mapInArrow(run, RULES).groupBy("lhs", "rhs").agg(F.sum("n").alias("n"))


def binarised(rules: DataFrame) -> DataFrame:
    """lhs, left, right (null for one part), n: a rule of more than two parts becomes a chain through the symbol MIDDLE + lhs,
    so there are at most as many rules as triples of symbols."""
    parts, middle = F.split("rhs", " "), F.concat(F.lit(MIDDLE), F.col("lhs"))
    size = F.size(parts)
    step = lambda k: F.struct(F.when(k == 1, F.col("lhs")).otherwise(middle).alias("lhs"), F.get(parts, k - 1).alias("left"), F.when(k == size - 1, F.get(parts, k)).otherwise(middle).alias("right"))
    one = F.struct(F.col("lhs"), F.col("rhs").alias("left"), F.lit(None).cast("string").alias("right"))
    made = F.when(size == 1, F.array(one)).otherwise(F.transform(F.sequence(F.lit(1), size - 1), step))
    return rules.select("n", F.explode(made).alias("r")).groupBy("r.lhs", "r.left", "r.right").agg(F.sum("n").alias("n")).where("right IS NOT NULL OR lhs <> left")


def estimated(binary: DataFrame, start: str = "S") -> Grammar:
    """The grammar of relative frequencies of binarised() counts."""
    rows = binary.collect()  # a row for each triple of symbols at most
    total = Counter()
    for r in rows:
        total[r["lhs"]] += r["n"]
    return Grammar([(r["lhs"], r["left"], r["right"], r["n"] / total[r["lhs"]]) for r in rows], start)


def _numbered(g: Grammar, tags: list[list[str] | None]) -> list[tuple[int, ...] | None]:
    return [None if t is None or any(x not in g.numbers for x in t) else tuple(g.numbers[x] for x in t) for t in tags]


def scores(sentences: DataFrame, g: Grammar, tags: str = "tags", most_words: int = MOST_WORDS) -> DataFrame:
    """sentences with `inside` and `best`: log probability over all derivations, and of the best one; null if there is none,
    or if the sentence is empty or of more than most_words words."""
    keep = [c for c in sentences.columns if c not in ("inside", "best")]

    def run(batches):
        other = len(g.names)
        for batch in batches:
            rows = sequences.numbered(batch.column(tags), g.numbers, other)
            places: dict[bytes, int] = {}
            own = np.array([places.setdefault(s, len(places)) for s in rows], np.int64)
            each, sizes = list(places), {}
            for k, s in enumerate(each):
                if 0 < len(s) <= 4 * most_words:
                    sizes.setdefault(len(s) // 4, []).append(k)
            inside, best = np.full(len(each), -np.inf), np.full(len(each), -np.inf)
            for n, some in sizes.items():
                at = sequences.matrix([each[k] for k in some], n)
                known = (at < other).all(1)
                at, some = at[known].astype(np.int64), np.array(some)[known]
                step = max(1, chart.TOTALS_BYTES // (32 * n * n * len(g.names)))
                for k in range(0, len(some), step):
                    inside[some[k : k + step]], best[some[k : k + step]] = chart.totals(g, at[k : k + step])
            none = ~np.isfinite(best[own])
            columns = [pa.array(x[own], mask=none) for x in (inside, best)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, "inside", "best"])

    return sentences.mapInArrow(run, T.StructType([*sentences.select(keep).schema.fields, *T.StructType.fromDDL("inside double, best double").fields]))


def parse(sentences: DataFrame, g: Grammar, words: str = "words", tags: str = "tags", most_words: int = MOST_WORDS) -> DataFrame:
    """sentences with parse_str, score (log probability of the tree) and status: ok, empty, too_long or no_parse. Sentences of
    equal tags are parsed once in each batch."""
    keep = [c for c in sentences.columns if c not in ("parse_str", "score", "status")]

    def run(batches):
        rules, other = chart.Rules(g), len(g.names)
        for batch in batches:
            rows, said = sequences.numbered(batch.column(tags), g.numbers, other), batch.column(words).to_pylist()
            n = [len(w) if w is not None else 0 for w in said]
            places: dict[bytes, list[int]] = {}
            for k, s in enumerate(rows):
                if 0 < len(s) // 4 == n[k] <= most_words:
                    places.setdefault(s, []).append(k)
            out = [(None, None, "empty" if not size else "too_long" if size > most_words else "no_parse") for size in n]
            each = [(s, np.frombuffer(s, np.int32)) for s in places]
            some = [(s, own) for s, own in each if (own < other).all()]
            for own in chart.alike([len(x) for _, x in some], g):
                sizes = np.array([len(some[k][1]) for k in own])
                at = np.full((len(own), sizes.max()), other, np.int64)
                for r, k in enumerate(own):
                    at[r, : sizes[r]] = some[k][1]
                best, frames = chart.trees(g, rules, at, sizes)
                for k, score, frame in zip(own, best.tolist(), frames, strict=True):
                    if frame is not None:
                        for place in places[some[k][0]]:
                            out[place] = (chart.worded(frame, said[place]), score, "ok")
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, "parse_str", "score", "status"])

    return sentences.mapInArrow(run, T.StructType([*sentences.select(keep).schema.fields, *T.StructType.fromDDL("parse_str string, score double, status string").fields]))


def reestimated(sentences: DataFrame, g: Grammar, tags: str = "tags", most_words: int = MOST_WORDS) -> tuple[Grammar, float]:
    """One round of inside-outside over untreed sentences: the grammar of the expected counts, and the log likelihood under
    the old one. Each task sums its own sentences; Spark adds the tasks up."""
    n_binary, pairs = len(g.binary), list(zip(*np.nonzero(g.unary), strict=True))

    def run(batches):
        total = np.zeros(n_binary + len(pairs) + 1)
        for batch in batches:
            seen = Counter(s for s in _numbered(g, batch.column(0).to_pylist()) if s and len(s) <= most_words)
            some = list(seen)
            for own, at in chart.by_length(some, g):
                binary, unary, log = chart.expected(g, at, np.array([float(seen[some[k]]) for k in own]))
                total += np.concatenate([binary, [unary[a, b] for a, b in pairs], [log]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], names=["k", "x"])

    rows = sentences.select(tags).mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()  # a row for each rule
    x = np.zeros(n_binary + len(pairs) + 1)
    for r in rows:
        x[r["k"]] = r["x"]
    rules = [(g.names[a], g.names[b], g.names[c], n) for (a, b, c, _), n in zip(g.binary, x, strict=False)] + [(g.names[a], g.names[b], None, n) for (a, b), n in zip(pairs, x[n_binary:], strict=False)]
    total = Counter()
    for a, _, _, n in rules:
        total[a] += n
    return Grammar([(a, b, c, n / total[a]) for a, b, c, n in rules if n > 0], g.names[g.start]), float(x[-1])
