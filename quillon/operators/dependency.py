"""Dependency parses: serialised tokens, one line for each that isn't white space."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import schemas
from quillon.functions import arcs, sequences

ROOT = "ROOT"
#: Distances between head and dependent from here on count alike.
FAR = 4
#: Sentences of more words get the status too_long; time grows with the cube.
MOST_WORDS = 120


def to_lines(tokens: Column) -> Column:
    """Tokens (schemas.TOKENS; i and head from 1, head = i for the root) -> lines `i, text, pos, head, dep` with tabs.
    White-space tokens count in the numbering but have no line. Null if a head lies outside the sentence."""

    def of(ts: Column) -> Column:
        inside = F.forall(ts, lambda t: t["is_space"] | ((t["head"] >= 1) & (t["head"] <= F.size(ts))))
        line = lambda t: F.concat_ws("\t", t["i"], t["text"], t["pos"], F.when(t["head"] == t["i"], 0).otherwise(t["head"]), t["dep"])
        return F.when(inside, F.array_join(F.transform(F.filter(ts, lambda t: ~t["is_space"]), line), "\n"))

    # bound as a lambda's variable: an expression inside a lambda would be made anew for each token
    return F.get(F.transform(F.array(tokens), of), F.lit(0))


def from_lines(lines: Column) -> Column:
    """The lines as array<struct<idx, text, pos, head, dep>>."""
    cell = lambda x, k: F.get(x, F.lit(k))
    return F.transform(F.transform(F.filter(F.split(lines, "\n"), lambda x: x != ""), lambda x: F.split(x, "\t")), lambda x: F.struct(cell(x, 0).cast("int").alias("idx"), cell(x, 1).alias("text"), cell(x, 2).alias("pos"), cell(x, 3).cast("int").alias("head"), cell(x, 4).alias("dep")))


def chain_tokens(sentence: Column) -> Column:
    """The default dependency rule: each word hangs on the one before, the first is the root."""
    words = F.filter(F.split(sentence, " "), lambda w: w != "")
    return F.transform(words, lambda w, k: F.struct((k + 1).alias("i"), w.alias("text"), F.when(w.rlike("^[0-9]"), "NUM").otherwise("X").alias("pos"), F.greatest(k, F.lit(1)).alias("head"), F.when(k == 0, "ROOT").otherwise("dep").alias("dep"), F.lit(False).alias("is_space")))


def parse_dependency(sentences: DataFrame, parser: Callable[[str], list[tuple]] | None = None) -> DataFrame:
    """Sentences (doc_id, domain, source, author, sent_idx, sent_text) -> the same with parse_str. Sentences with a head
    outside, or for which the parser raises ValueError, are dropped; empty sentences stay. parser: sentence ->
    [(i, text, pos, head, dep, is_space)]."""
    if parser is None:
        tokens = chain_tokens(F.col("sent_text"))
    else:
        fields = ("i", "text", "pos", "head", "dep", "is_space")

        def one(text: str | None):
            try:
                return [dict(zip(fields, t, strict=True)) for t in parser(text or "")]
            except ValueError:
                return None

        def parsed(sentences: pd.Series) -> pd.Series:
            return sentences.map(one)

        sentences = sentences.withColumn("_tokens", F.pandas_udf(parsed, schemas.TOKENS)("sent_text"))  # no lambda may hold it
        tokens = F.col("_tokens")
    return sentences.withColumn("parse_str", to_lines(tokens)).where("parse_str IS NOT NULL").drop("_tokens")


def parse_status(corpus: DataFrame, parser: Callable[[list[str]], Iterable], batch: int = 32) -> DataFrame:
    """corpus (id, domain, source, author, text) -> PARSES and status: ok, sentence_failed (a head outside its sentence) or
    document_failed. parser gets `batch` texts at a time and gives for each the sentences, [(sentence, tokens)] with
    tokens as parse_dependency takes them, or None (or a ValueError) where it fails; it lives once in each worker."""
    fields = ("i", "text", "pos", "head", "dep", "is_space")
    schema = f"doc_id string, domain string, source string, author string, sent_idx int, sent_text string, tokens {schemas.TOKENS}, failed boolean"

    def run(frames):
        for frame in frames:
            rows = []
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                for r, found in zip(part.itertuples(index=False), parser([t or "" for t in part["text"]]), strict=True):
                    key = (r.id, r.domain, r.source, r.author)
                    if found is None or isinstance(found, ValueError):
                        rows.append((*key, None, None, None, True))
                    else:
                        rows += [(*key, i, s.strip(), [dict(zip(fields, t, strict=True)) for t in tokens], False) for i, (s, tokens) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")][:6] + ["tokens", "failed"]).astype({"sent_idx": "Int32"})

    rows = corpus.select("id", "domain", "source", "author", "text").mapInPandas(run, schema).withColumn("parse_str", to_lines(F.col("tokens")))
    status = F.when(F.col("failed"), "document_failed").when(F.col("parse_str").isNull(), "sentence_failed").otherwise("ok")
    return rows.withColumn("status", status).drop("tokens", "failed")


def parse_documents(corpus: DataFrame, parser: Callable[[list[str]], Iterable], batch: int = 32) -> tuple[DataFrame, Observation]:
    """PARSES of what parses, and an observation of n_ok, n_sentence_failed and n_document_failed, filled when it is written."""
    seen = Observation("dependency")
    counts = (F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "sentence_failed", "document_failed"))
    return parse_status(corpus, parser, batch).observe(seen, *counts).where("status = 'ok'").drop("status"), seen


def count_arcs(parses: DataFrame, lines: str = "parse_str") -> DataFrame:
    """head_pos (ROOT for the root), dep_pos, side (-1: the dependent comes first, 1: behind, 0: root), distance (FAR and
    beyond alike), n: the arcs of parsed lines."""
    def of(t: Column) -> Column:
        near = lambda x: F.get(t, x["head"] - 1)  # noqa: E731  where it stands if no token is missing
        found = lambda x: F.when(near(x)["idx"] == x["head"], near(x)["pos"]).otherwise(F.get(F.filter(t, lambda y: y["idx"] == x["head"]), F.lit(0))["pos"])
        gap = lambda x: x["idx"] - x["head"]
        root = lambda x: F.struct(F.lit(ROOT).alias("head_pos"), x["pos"].alias("dep_pos"), F.lit(0).alias("side"), F.lit(0).alias("distance"))
        other = lambda x: F.struct(found(x).alias("head_pos"), x["pos"].alias("dep_pos"), F.signum(gap(x)).cast("int").alias("side"), F.least(F.abs(gap(x)), F.lit(FAR)).alias("distance"))
        return F.transform(t, lambda x: F.when(x["head"] == 0, root(x)).otherwise(other(x)))

    # the tokens are bound as a lambda's variable, so that they are read once for a sentence and not once for each token
    arc = parses.select(F.explode(F.flatten(F.transform(F.array(from_lines(F.col(lines))), of))).alias("a")).select("a.*")
    return arc.groupBy("head_pos", "dep_pos", "side", "distance").agg(F.count("*").alias("n"))


def arc_scores(counts: DataFrame, smoothing: float = 0.5) -> dict[tuple[str, str, int, int], float]:
    """Log share of each arc among those of its dependent's tag, smoothed; the key (None, dep_pos, 0, 0) has the score of arcs
    that weren't seen. count_arcs() has a row for each two tags, side and distance at most."""
    rows = counts.collect()
    total, kinds = Counter(), Counter()
    for r in rows:
        total[r["dep_pos"]] += r["n"]
        kinds[r["dep_pos"]] += 1
    share = lambda n, d: math.log((n + smoothing) / (total[d] + smoothing * (kinds[d] + 1)))
    return {(r["head_pos"], r["dep_pos"], r["side"], r["distance"]): share(r["n"], r["dep_pos"]) for r in rows} | {(None, d, 0, 0): share(0, d) for d in total}


class ArcTable:
    """Arc scores as an array [head's tag, dependent's tag, side and distance], for sentences of numbered tags. Tags without a
    score share the last number, which ROOT has as a head."""

    def __init__(self, scores: dict, unseen: float = -20.0):
        self.numbers = {t: k for k, t in enumerate(sorted({d for _, d, _, _ in scores} | {h for h, _, _, _ in scores if h not in (None, ROOT)}))}
        size = len(self.numbers) + 1
        self.other = size - 1
        new = np.full(size, unseen)
        for (h, d, side, far), x in scores.items():
            if (h, side, far) == (None, 0, 0):
                new[self.numbers[d]] = x
        self.arcs = np.tile(new[None, :, None], (size, 1, 2 * FAR + 1))  # the side times the distance, from FAR
        self.roots = new.copy()
        for (h, d, side, far), x in scores.items():
            if h == ROOT and side == 0 and far == 0:
                self.roots[self.numbers[d]] = x
            elif h in self.numbers and side in (-1, 1) and 1 <= far <= FAR:
                self.arcs[self.numbers[h], self.numbers[d], FAR + side * far] = x

    def scored(self, tags: np.ndarray) -> np.ndarray:
        """tags (row, n), by number -> the arc scores (row, n + 1, n + 1) [head, dependent]."""
        b, n = tags.shape
        at = np.arange(n)
        gap = FAR + np.clip(at[None, :] - at[:, None], -FAR, FAR)
        out = np.zeros((b, n + 1, n + 1))
        out[:, 0, 1:] = self.roots[tags]
        out[:, 1:, 1:] = self.arcs[tags[:, :, None], tags[:, None, :], gap]
        return out


def _lines(words: pa.Array, tags: pa.Array, starts: np.ndarray, heads: np.ndarray, ok: np.ndarray) -> pa.Array:
    """What to_lines() says of the sentences; the heads of each begin at its `starts`. Null if it isn't ok or has a word
    without a head, or a head without a word."""
    said, first, n_words = sequences.spans(words)
    names, first_tag, n_tags = sequences.spans(tags)
    ok = ok & (n_words <= n_tags) & words.is_valid().to_numpy(zero_copy_only=False)
    n = np.where(ok, n_words, 0)
    row, k = np.repeat(np.arange(len(n)), n), sequences.ranges(np.zeros(len(n), np.int64), n)
    head = heads[starts[row] + k]
    ok[row[head > n[row]]] = False
    text = lambda x: pa.array(x).cast(pa.string())
    dep = pa.array([ROOT, "dep"]).take(pa.array((head > 0).astype(np.int8)))
    cells = [text(k + 1), said.take(pa.array(first[row] + k)), names.take(pa.array(first_tag[row] + k)), text(head), dep]
    line = pc.binary_join_element_wise(*cells, "\t", null_handling="skip")
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), line), "\n")
    return pc.if_else(pa.array(ok), joined, None)


def _width(n: int) -> int:
    """Sentences of up to so many words are parsed together; few are long, so these share their steps."""
    return n if n <= 16 else -(-n // 4) * 4 if n <= 48 else -(-n // 12) * 12


def parse_arcs(sentences: DataFrame, scores: dict, words: str = "words", tags: str = "tags", projective: bool = True, most_words: int = MOST_WORDS, lines: bool = True) -> DataFrame:
    """sentences with parse_str (lines as to_lines() makes them), score and status (ok, empty, too_long): the tree of the
    highest sum of arc scores, with one root. Sentences of equal tags are parsed once in each batch, those of like length
    together. Without `lines` there is no parse_str."""
    made = ["parse_str", "score", "status"] if lines else ["score", "status"]
    keep = [c for c in sentences.columns if c not in ("parse_str", "score", "status")]

    def run(batches):
        table = ArcTable(scores)
        for batch in batches:
            rows = sequences.numbered(batch.column(tags), table.numbers, table.other)
            places: dict[bytes, int] = {}
            own = np.array([places.setdefault(s, len(places)) for s in rows], np.int64)
            each = list(places)
            length = np.array([len(s) // 4 for s in each], np.int64)
            begin = np.cumsum(length) - length
            heads, total = np.zeros(int(length.sum()), np.int32), np.zeros(len(each))
            sizes: dict[int, list[int]] = {}
            for k, n in enumerate(length.tolist()):
                if 0 < n <= most_words:
                    sizes.setdefault(_width(n) if projective else n, []).append(k)
            for n, some in sizes.items():
                step = max(1, (16 << 20) // (8 * (n + 1) ** 2 * 8))
                for k in range(0, len(some), step):
                    part = np.array(some[k : k + step])
                    at = table.scored(sequences.matrix([each[i] for i in part], n))
                    if projective:
                        found, total[part] = arcs.projective(at, length[part], lines)
                    else:
                        found, total[part] = map(np.array, zip(*map(arcs.spanning, at), strict=True))
                    if found is not None:
                        inside = np.arange(n) < length[part][:, None]
                        heads[(begin[part][:, None] + np.arange(n))[inside]] = found[inside]
            size = length[own]
            ok = (size > 0) & (size <= most_words)
            status = pa.array(["empty", "ok", "too_long"]).take(pa.array(np.where(ok, 1, np.where(size > 0, 2, 0))))
            columns = [pa.array(total[own], mask=~ok), status]
            if lines:
                columns.insert(0, _lines(batch.column(words), batch.column(tags), begin[own], heads, ok))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *made])

    kinds = {"parse_str": T.StringType(), "score": T.DoubleType(), "status": T.StringType()}
    return sentences.mapInArrow(run, T.StructType([*sentences.select(keep).schema.fields, *(T.StructField(c, kinds[c]) for c in made)]))
