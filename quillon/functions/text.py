"""Scalar text functions, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What (?U)\s matches.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null for null, 0 for none."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long") + F.when(text.isNull(), F.lit(None)).otherwise(0)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def labels(motif: Column) -> Column:
    """The labels of a motif, in order, that begin with a capital or $."""
    return F.regexp_extract_all(motif, F.lit(r"\(([A-Z$]+[A-Z0-9$-]*)"), F.lit(1))


def n_terminals(motif: Column) -> Column:
    """Number of childless labels; punctuation labels don't count."""
    return F.size(F.regexp_extract_all(motif, F.lit(r"\([A-Z$][A-Z0-9$-]*\)"), F.lit(0)))


def highlight(sentence: Column, words: Column) -> Column:
    """The first place where the words follow each other, with ** around it; case and light punctuation don't matter."""
    parts = F.transform(F.filter(F.split(words, r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.concat(F.lit(r"(?isuU)^(.*?)(\b"), F.array_join(parts, r"""[\s,;:'"]*"""), F.lit(r"\b)"))
    return F.when(F.size(parts) == 0, sentence).otherwise(F.regexp_replace(sentence, pattern, F.lit("$1**$2**")))


def smart_truncate(text: Column, most: int = 140) -> Column:
    """Up to `most` characters that show the ** mark, with ... where text is missing."""
    half = most // 2
    mark = F.locate("**", text)
    window = F.concat(F.lit("..."), F.substring(text, mark - half, F.lit(most)), F.lit("..."))
    return F.when(F.length(text) <= most, text).when((mark == 0) | (mark - 1 < half), F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(window)


def log2_ratio(count: Column, total: Column, base_count: Column, base_total: Column, smoothing: float = 0.5) -> Column:
    """log2 of (count / total) / (base_count / base_total), with smoothing / base_total where the base has none."""
    base = F.try_divide(F.when(base_count == 0, F.lit(smoothing)).otherwise(base_count.cast("double")), base_total)
    return F.log2(F.try_divide(F.try_divide(count.cast("double"), total), base))
