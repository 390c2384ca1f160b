"""A learned segmenter: abbreviations and sentence starters by log-likelihood ratios (Kiss and Strunk 2006).

Counts over all texts make the model, which is two tables. Tasks look at each different token once and sum before anything is
shuffled; both learning and cutting run over Arrow batches.
Tokens are what white space parts; a token's type is its lower-cased core without marks at its ends. No sentence crosses a
line break. A token that ends in ! or ? ends its sentence. One that ends in a period does unless its type is an abbreviation
(a single letter, or a ratio of LEAST_ABBREVIATION) and what follows is no known starter with a capital, or unless it is a
number and what follows begins in lower case. One that ends in dots does if what follows begins with a capital.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as X

# The thresholds and the assumed share of periods behind an abbreviation, as published.
LEAST_ABBREVIATION, LEAST_STARTER, SURE = 0.3, 30.0, 0.99
#: Types that a model's sets may hold; they become constants of the expression.
MOST_TYPES = 100_000

SPACE = r"\x20\x09-\x0D"
PIECE = rf"[^{SPACE}]+[{SPACE}]*"
OPENING, CLOSING, MARKS = r"""^["'(\[]+""", r"""["')\]]+$""", r"[.,;:!?]+$"


def pieces(line: Column) -> Column:
    """The tokens of a line, each with the white space behind it."""
    return F.regexp_extract_all(line, F.lit(PIECE), F.lit(0))


def core(piece: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(piece, rf"[{SPACE}]+$", ""), CLOSING, ""))


def type_of(piece: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(core(piece), MARKS, ""), OPENING, "")


def ending(piece: Column) -> Column:
    """period, dots, strong or none."""
    c = core(piece)
    return F.when(c.rlike(r"\.\.$"), "dots").when(c.rlike(r"\.$"), "period").when(c.rlike(r"[!?]$"), "strong").otherwise("none")


def tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    """type, ending, next (the type behind it in its line, null at the end) of every token that has a type."""
    of = lambda line: F.transform(F.array(pieces(line)), lambda p: F.transform(p, lambda x, k: F.struct(type_of(x).alias("type"), ending(x).alias("ending"), type_of(F.get(p, k + 1)).alias("next"))))
    rows = texts.select(F.explode(F.split(text, "\n")).alias("line"))
    return rows.select(F.explode(F.flatten(of(F.col("line")))).alias("t")).select("t.*").where("type <> ''")


#: Different tokens that a task remembers, and sums that it keeps before it hands them on.
MOST_TOKENS, SUMS = 100_000, 200_000
_PIECE, _TOKEN, _NUMBER, _BLANK = re.compile(PIECE), re.compile(rf"[^{SPACE}]+"), re.compile("[0-9]+"), " \t\n\v\f\r"


class Looked(dict):
    """(type, ending) of each token (without white space) that was asked for, of MOST_TOKENS at most."""

    def __missing__(self, token: str) -> tuple[str, str]:
        if len(self) >= MOST_TOKENS:
            self.clear()
        c = token.rstrip("\"')]").lower()
        kind = "dots" if c.endswith("..") else "period" if c.endswith(".") else "strong" if c.endswith(("!", "?")) else "none"
        found = self[token] = (c.rstrip(".,;:!?").lstrip("\"'(["), kind)
        return found


def counted(texts: DataFrame, text: str = "text") -> DataFrame:
    """type, ending, next, c: how often tokens() has each, summed in the tasks first. next is null behind other endings than
    period and strong, where no one asks for it."""

    def run(batches):
        looked, seen = Looked(), Counter()
        for batch in batches:
            for said in batch.column(0).to_pylist():
                for line in said.split("\n") if said else ():
                    found = [looked[t] for t in _TOKEN.findall(line)]
                    behind = [t for t, _ in found[1:]] + [None]
                    seen.update([(t, kind, then if kind in ("period", "strong") else None) for (t, kind), then in zip(found, behind, strict=False) if t])
                if len(seen) > SUMS:
                    yield summed(seen)
                    seen = Counter()
        yield summed(seen)

    def summed(seen):
        columns = [pa.array([k[j] for k in seen], pa.string()) for j in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(seen.values()), pa.int64())], names=["type", "ending", "next", "c"])

    rows = texts.select(text).mapInArrow(run, "type string, ending string, next string, c long")
    return rows.groupBy("type", "ending", "next").agg(F.sum("c").alias("c"))


def _times(found: DataFrame) -> Column:
    """How often a row of tokens() or counted() stands for a token."""
    return F.col("c") if "c" in found.columns else F.lit(1)


def abbreviations(found: DataFrame) -> DataFrame:
    """type, n_period, n_other, ratio of types with a letter that a period was seen behind. found: tokens() or counted()."""
    c, period = _times(found), F.col("ending") == "period"
    of = lambda kind: F.coalesce(F.sum(F.when(kind, c)), F.lit(0)).cast("long")
    counts = found.groupBy("type").agg(of(period).alias("n_period"), of(~period).alias("n_other"))
    totals = counts.agg((F.sum("n_period") / F.sum(F.col("n_period") + F.col("n_other"))).alias("_share"))  # one row
    counts = counts.where((F.col("n_period") > 0) & F.col("type").rlike(r"\p{L}")).join(F.broadcast(totals), F.lit(True))
    log = lambda p: F.col("n_period") * F.log(p) + F.col("n_other") * F.log(1 - p)
    size = F.length(F.replace("type", F.lit("."), F.lit("")))
    dots = F.length("type") - size + 1
    scale = F.exp(-size.cast("double")) * dots * F.pow(size.cast("double"), -F.col("n_other").cast("double"))
    ratio = F.lit(-2.0) * (log(F.col("_share")) - log(F.lit(SURE))) * scale
    # a share of 1 leaves no other ending to compare with
    return counts.withColumn("ratio", F.when(F.col("_share") < 1, ratio).otherwise(0.0)).drop("_share")


def is_abbreviation() -> Column:
    return (F.col("ratio") >= LEAST_ABBREVIATION) | (F.length("type") == 1)


def starters(found: DataFrame, abbreviated: DataFrame) -> DataFrame:
    """type, n_first, n_all, ratio of types that were seen behind a sure end of a sentence: a period behind a type that is no
    abbreviation, or a ! or ?. abbreviated: the abbreviations() that count as such."""
    short = abbreviated.select("type").distinct()
    # types are summed first, so the join has a row for each pair and not for each token
    pairs = found if "c" in found.columns else found.groupBy("type", "ending", "next").agg(F.count("*").alias("c"))
    sure = pairs.where("ending = 'strong'").unionByName(pairs.where("ending = 'period'").join(short, "type", "left_anti")).where("next <> ''")
    first = sure.groupBy(F.col("next").alias("type")).agg(F.sum("c").alias("n_first"))
    every = pairs.groupBy("type").agg(F.sum("c").alias("n_all"))
    totals = every.agg(F.sum("n_all").cast("double").alias("_n")).join(first.agg(F.sum("n_first").cast("double").alias("_ends")), F.lit(True))  # one row
    x = lambda k, m: F.when(k > 0, k * F.log(k / m)).otherwise(0.0)  # noqa: E731  k ln(k / m)
    a, b = F.col("n_first").cast("double"), F.col("n_all").cast("double")
    n, one = F.col("_n"), F.col("_ends")
    rest = n - one
    apart = x(a, one) + x(one - a, one) + x(b - a, rest) + x(rest - b + a, rest)
    alike = x(b, n) + x(n - b, n)
    return first.join(every, "type").join(F.broadcast(totals), F.lit(True)).withColumn("ratio", 2.0 * (apart - alike)).drop("_n", "_ends")


def is_starter(n_first: int, n: int) -> Column:
    """More often behind an end than elsewhere, and surely so. n_first, n: ends with a token behind, and tokens, in all."""
    return (F.col("ratio") >= LEAST_STARTER) & (F.col("n_first") * n > F.col("n_all") * n_first)


def learn(texts: DataFrame, text: str = "text", most_types: int = MOST_TYPES) -> tuple[frozenset[str], frozenset[str]]:
    """The types of abbreviations (longer than a letter) and of starters. ValueError beyond most_types of either."""
    found = counted(texts, text).persist()
    short = abbreviations(found).where(is_abbreviation()).persist()
    first = starters(found, short).persist()  # each is made once, for the jobs below
    sets = []
    try:
        n = found.agg(F.sum("c")).first()[0] or 0
        ends = first.agg(F.sum("n_first")).first()[0] or 0
        for rows in (short.where(F.length("type") > 1), first.where(is_starter(ends, n))):
            types = [r["type"] for r in rows.select("type").limit(most_types + 1).collect()]
            if len(types) > most_types:
                raise ValueError(f"more than {most_types} types; learn from texts of one language, or ask for higher ratios")
            sets.append(frozenset(types))
    finally:
        for made in (first, short, found):
            made.unpersist()
    return sets[0], sets[1]


def segments(text: Column, model: tuple[frozenset[str], frozenset[str]]) -> Column:
    """The stripped sentences of a text that aren't empty; null for null. Characters stay as they are."""
    short, first = model

    def cut(line: str, looked: Looked) -> Iterator[str]:
        """The sentences of a line."""
        own = _PIECE.findall(line)
        found = [looked[p.rstrip(_BLANK)] for p in own]
        begun = 0
        for k, (name, kind) in enumerate(found[:-1]):
            if kind == "none":
                continue
            then = own[k + 1].lstrip("\"'([")
            of = unicodedata.category(then[0]) if then else ""
            if kind == "period":
                if len(name) == 1 and unicodedata.category(name)[0] == "L" or name in short:
                    ends = of == "Lu" and found[k + 1][0] in first
                else:
                    ends = not _NUMBER.fullmatch(name) or of != "Ll"
            else:
                ends = kind == "strong" or of == "Lu"
            if ends:
                yield "".join(own[begun : k + 1])
                begun = k + 1
        yield "".join(own[begun:])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        looked = Looked()
        for batch in batches:
            said = [None if t is None else [x for line in t.split("\n") for s in cut(line, looked) if (x := s.strip(X.WHITE))] for t in batch.to_pylist()]
            yield pa.array(said, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)
