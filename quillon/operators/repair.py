"""Author repair: a left join on four keys whose right side may hold each key once."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.parse import sentences
from quillon.operators.stats import duplicates
from quillon.sources import files

KEYS = ["source", "doc_id", "sent_idx", "sent_text"]


class Ambiguous(ValueError):
    """The lookup has several rows for one key."""


def author_lookup(corpus: DataFrame, domain: str = "reuter", segment=sentences) -> DataFrame:
    """Sentences of one domain's documents with their author."""
    rows = corpus.where(F.col("domain") == domain).select("source", F.col("id").cast("string").alias("doc_id"), "author", "text")
    return segment(rows).select(*KEYS, "author")


def recover_authors(parses: DataFrame, lookup: DataFrame, domain: str = "reuter") -> DataFrame:
    """parses with the author of the lookup in `domain`, null elsewhere. Raises Ambiguous if the lookup repeats a key. An
    author that a row has already stays. Null keys match null keys."""
    if not lookup.groupBy(*KEYS).count().where("count > 1").isEmpty():
        raise Ambiguous("the author lookup isn't unique by " + ", ".join(KEYS))
    parses = parses.withColumn("doc_id", F.col("doc_id").cast("string"))
    if "author" not in parses.columns:
        parses = parses.withColumn("author", F.lit(None).cast("string"))
    found = lookup.select(*KEYS, F.col("author").alias("_author"))
    left = parses.alias("l")
    on = [F.col(f"l.{k}").eqNullSafe(found[k]) for k in KEYS] + [F.col("l.domain") == domain]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    joined = left.join(found, condition, "left")
    return joined.select(*(F.coalesce("l.author", "_author").alias("author") if c == "author" else F.col(f"l.{c}") for c in parses.columns))


def unmatched(repaired: DataFrame, domain: str = "reuter") -> DataFrame:
    """n_rows and n_unmatched of the domain."""
    return repaired.where(F.col("domain") == domain).agg(F.count("*").alias("n_rows"), F.count_if(F.col("author").isNull()).alias("n_unmatched"))


def repair_job(spark: SparkSession, corpus: DataFrame, paths: list[str], domain: str = "reuter", segment=sentences) -> list[dict]:
    """Repairs the tables (Parquet) at `paths`, each with a backup beside it. Gives a dict for each path: path, found (false
    if there is none), n_rows, n_unmatched (a warning if any), and n_ambiguous of the lookup: rows of one key with different
    authors, which recover_authors refuses, so nothing is written then."""
    lookup = author_lookup(corpus, domain, segment)
    n_ambiguous = duplicates(lookup, KEYS).count()
    out = []
    for path in paths:
        if n_ambiguous or not files.exists(spark, path):
            out.append({"path": path, "found": files.exists(spark, path), "n_rows": 0, "n_unmatched": 0, "n_ambiguous": n_ambiguous})
            continue
        files.write_with_backup(recover_authors(spark.read.parquet(path), lookup, domain), path)
        n = unmatched(spark.read.parquet(path), domain).first()
        if n["n_unmatched"]:
            warnings.warn(f"{n['n_unmatched']} of {n['n_rows']} rows of {path} have no author", stacklevel=2)
        out.append({"path": path, "found": True, "n_rows": n["n_rows"], "n_unmatched": n["n_unmatched"], "n_ambiguous": 0})
    return out
