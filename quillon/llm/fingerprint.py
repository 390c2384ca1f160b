"""Canonical exact document fingerprints, in DataFrame functions only.

canonical(): Unicode compatibility composition (NFKC) and full case folding by the ICU library that Spark carries, white
space folded to single spaces and trimmed. A fingerprint is the 128-bit digest of the canonical text, two xxhash64 with
different keys. Documents are grouped by the digest, and inside buckets of more than one document the canonical texts'
bytes are compared: the aggregate there is keyed by the text itself, after partial aggregation within each task, so a
bucket that holds a third of all rows leaves each task as one row. Texts that differ in equal buckets part again.

Likeness of two exact fingerprints is 1 (equal) or 0.

Null text counts as empty; empty texts are equal texts. Rows that share a doc_id share its place in the order; the next
document of a doc_id is the smallest greater one, after the last the first, and where several rows have that id, the one
with the smallest text prefix stands for it. A null doc_id has no next document: its edited text only loses the tail.
Empty input: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import stored


def canonical(text: Column) -> Column:
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    return F.trim(F.regexp_replace(again, r"(?U)\s+", " "))


def wide(canon: Column) -> tuple[Column, Column]:
    return F.xxhash64(canon), F.xxhash64(F.lit("wide"), canon)


def with_digest(df: DataFrame, text: str, prefix: str, digest=wide) -> DataFrame:
    """df with PREFIX_canon, and its digest as PREFIX_h1 and PREFIX_h2."""
    return df.withColumn(f"{prefix}_canon", canonical(F.col(text))).withColumns(dict(zip((f"{prefix}_h1", f"{prefix}_h2"), digest(F.col(f"{prefix}_canon")), strict=True)))


def hexed(prefix: str) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(F.col(f"{prefix}_{h}")), 16, "0") for h in ("h1", "h2"))))


def _base(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def next_ids(ids: DataFrame) -> DataFrame:
    """doc (distinct, not null) -> doc, next_id, in ring order. Only ids move: ranges of ids, with bounds that Spark takes
    from a sample, are sorted for themselves, and the last id of each finds the first of the next range that has one."""
    ids = stored(ids.repartitionByRange("doc").withColumn("bin", F.spark_partition_id()))
    firsts = ids.groupBy("bin").agg(F.min("doc").alias("first"))  # one row for each partition
    after = firsts.select("bin", F.coalesce(F.lead("first").over(Window.orderBy("bin")), F.min("first").over(Window.partitionBy(F.lit(0)))).alias("after"))
    lead = F.lead("doc").over(Window.partitionBy("bin").orderBy("doc"))
    return ids.withColumn("lead", lead).join(F.broadcast(after), "bin").select("doc", F.coalesce("lead", "after").alias("next_id"))


def likeness(df: DataFrame, key: str = "doc_id", text: str = "text", digest=wide) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id (the smallest
    doc_id with the same canonical text), group_size. digest: two hash columns of a column of canonical text."""
    whole = with_digest(_base(df, key, text), "text", "own", digest).drop("own_canon")
    marks = stored(whole.select("doc", F.length("text").alias("n"), "own_h1", "own_h2"))
    buckets = stored(marks.groupBy("own_h1", "own_h2").agg(F.count("*").alias("size"), F.min("doc").alias("first")).where("size > 1"))
    ids = marks.where("doc IS NOT NULL").groupBy("doc").agg(F.max("n").alias("n"))
    wants = next_ids(ids.select("doc")).join(ids, "doc").select(F.col("next_id").alias("doc"), F.col("doc").alias("to"), F.expr("CAST(n div 4 AS INT)").alias("take"))
    rows = whole.where("doc IS NOT NULL").repartition("doc").join(wants, "doc")  # the one exchange of whole texts; both branches below share it
    head = F.struct(F.expr("substring(text, 1, take)").alias("head"), F.col("own_h1").alias("h1"), F.col("own_h2").alias("h2"))
    heads = rows.select("to", head.alias("next")).groupBy("to").agg(F.min("next").alias("next"))
    full = rows.drop("to", "take").join(heads.withColumnRenamed("to", "doc"), "doc", "left").select("doc", "text", "own_h1", "own_h2", "next")
    lone = whole.where("doc IS NULL").select("doc", "text", "own_h1", "own_h2", F.lit(None).cast("struct<head:string,h1:bigint,h2:bigint>").alias("next"))
    full = full.unionByName(lone).withColumn("n_chars", F.length("text").cast("long"))
    full = full.withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars - n_chars div 4 AS INT)), coalesce(substring(next.head, 1, CAST(n_chars div 4 AS INT)), ''))"))
    full = with_digest(full, "edited", "edit", digest)
    like = lambda a, b: F.when((F.col("own_h1") == F.col(a)) & (F.col("own_h2") == F.col(b)), 1.0).otherwise(0.0)
    out = full.select(
        "doc", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), hexed("own").alias("fingerprint"), hexed("edit").alias("edited_fingerprint"),
        like("edit_h1", "edit_h2").alias("near_edited"), like("next.h1", "next.h2").alias("near_next"), "own_h1", "own_h2", F.xxhash64("text").alias("row"),
    )
    out = out.join(buckets, ["own_h1", "own_h2"], "left").alias("o")
    # byte comparison in buckets of more than one row, keyed by the canonical text itself; where that parts a bucket, rows
    # find their text by (doc, hash of the row)
    some = whole.join(buckets, ["own_h1", "own_h2"], "left_semi").select("doc", F.xxhash64("text").alias("row"), canonical(F.col("text")).alias("canon"), "own_h1", "own_h2")
    texts = some.groupBy("own_h1", "own_h2", "canon").agg(F.count("*").alias("n"), F.min("doc").alias("least"))
    parted = stored(texts.groupBy("own_h1", "own_h2").agg(F.count("*").alias("texts")).where("texts > 1").select("own_h1", "own_h2"))
    if parted.isEmpty():
        out = out.withColumns({"n": F.lit(None).cast("long"), "least": F.lit(None).cast("long")}).alias("o")
    else:
        some = some.join(parted, ["own_h1", "own_h2"], "left_semi")
        texts = stored(some.groupBy("own_h1", "own_h2", "canon").agg(F.count("*").alias("n"), F.min("doc").alias("least")))
        split = stored(some.join(texts, ["own_h1", "own_h2", "canon"]).select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), "n", "least").distinct())
        out = out.join(split, F.col("o.doc").eqNullSafe(F.col("_doc")) & (F.col("o.row") == F.col("_row")), "left")
    return out.select(
        F.col("doc").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.when(F.col("n").isNotNull(), F.col("least")).otherwise(F.coalesce("first", "doc")).alias("group_id"), F.coalesce("n", "size", F.lit(1)).cast("long").alias("group_size"),
    )
