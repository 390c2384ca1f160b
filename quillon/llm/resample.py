"""Importance resampling towards a target distribution, by hashed n-gram features.

In each task DuckDB takes the words of a chunk of whole texts, unnests them, windows them into runs of 1 to n words and
hashes each different run with a registered zlib CRC function; the bucket counts of each text, and the sums of each task,
are spilled to Parquet in the shared folder. Spark merges the sums of source and target into one gain for each bucket,
scores every text from its own spilled counts, perturbs the scores by a keyed hash (Gumbel top-k, so a draw without
replacement), and ranks them: one range exchange of narrow rows, whose partitions' sizes give each row its rank.

What is bounded: a task holds the words of CHUNK_BYTES of text (or of one longer text) and a count for each bucket; the
driver gets a row for each bucket (a parameter) and for each partition of the ranking. Texts are never shuffled.

Null and empty texts have no features and weight 0. A null key is hashed as the empty string and ranks behind equal
scores. Repeated rows are scored and ranked each for itself; ties go by key, then by features and weight. An empty source
gives no rows; an empty target gives gains from the source alone. Other columns stay out of the result.
"""

from __future__ import annotations

import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import batch, chunks, discard, mapped, stored, texts_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Memory that DuckDB may take in a worker.
MEMORY = "600MB"
#: Buckets that fit a spilled short; more are refused.
MOST_BUCKETS = 1 << 20

COUNTS = "key long, n_words long, n_features long, buckets array<int>, counts array<long>, whole boolean"


def feature_sql(n: int) -> str:
    """SQL over texts(r, text): words(r, p, w), and runs(r, f) of 1 to n consecutive words."""
    runs = ["SELECT r, w AS f FROM words"]
    for k in range(2, n + 1):
        said = " || ' ' || ".join(["w", *(f"lead(w, {i}) OVER o" for i in range(1, k))])
        runs.append(f"SELECT r, f FROM (SELECT r, {said} AS f FROM words WINDOW o AS (PARTITION BY r ORDER BY p)) WHERE f IS NOT NULL")
    return f"""
        words AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS p FROM (SELECT r, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM texts)),
        runs AS ({' UNION ALL '.join(runs)})"""


def _connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": "false"})

    def crc(words: pa.ChunkedArray) -> pa.Array:
        return pa.array([zlib.crc32(w.encode()) for w in words.to_pylist()], pa.uint32())

    con.create_function("crc", crc, ["VARCHAR"], "UINTEGER", type="arrow")
    return con


def bucket_counts(df: DataFrame, key: str, text: str = "text", n: int = 1, buckets: int = 10_000) -> DataFrame:
    """COUNTS: a row for each row of df with the counts of its buckets, and for each task one row (`whole`, null key) with
    the sums of all its texts."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}")
    schema = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("whole", pa.bool_())])
    counted = f"""
        WITH {feature_sql(n)},
        own AS MATERIALIZED (SELECT r, f, count(*) AS c FROM runs GROUP BY r, f),
        hashed AS (SELECT f, CAST(crc(f) % {buckets} AS INTEGER) AS b FROM (SELECT DISTINCT f FROM own))
        SELECT r, b, sum(c)::BIGINT AS c FROM own JOIN hashed USING (f) GROUP BY r, b ORDER BY r, b"""
    sizes = f"SELECT r, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS n FROM texts ORDER BY r"

    def run(batches):
        con, sums = _connection(), np.zeros(buckets, np.int64)
        for part in chunks(batches, "text"):
            texts = pa.table({"r": pa.array(np.arange(part.num_rows)), "text": texts_of(part.column("text"))})
            con.register("texts", texts)
            found = con.sql(counted).to_arrow_table()
            n_words = con.sql(sizes).to_arrow_table().column("n").to_numpy() if n > 1 else None
            con.unregister("texts")
            r, b, c = (found.column(x).to_numpy() for x in ("r", "b", "c"))
            np.add.at(sums, b, c)
            at = np.searchsorted(r, np.arange(part.num_rows + 1)).astype(np.int32)
            upto = np.concatenate([[0], np.cumsum(c)])
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (b.astype(np.int32), c)]
            n_features = upto[at[1:]] - upto[at[:-1]]
            yield batch(schema, part.column("key"), n_features if n == 1 else n_words, n_features, *lists, np.zeros(part.num_rows, bool))
        full = np.flatnonzero(sums)
        yield batch(schema, [None], [0], [int(sums.sum())], [full.astype(np.int32)], [sums[full]], [True])
        con.close()

    return mapped(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), run, COUNTS)


def merged(counts: DataFrame) -> DataFrame:
    """bucket, n: the sums of all tasks."""
    return counts.where("whole").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of each bucket from merged() counts, log ratios of smoothed shares in thousandths, rounded down."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # a row for each bucket at most
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return [math.floor(1000 * math.log(x)) for x in ratio.tolist()]


def scored(counts: DataFrame, gain: list[int], seed: str) -> DataFrame:
    """key, n_words, n_features, weight, score of each text. The gains are one folded array constant."""
    of = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate(F.zip_with("buckets", "counts", lambda b, c: c * F.get(of, b)), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = counts.where("NOT whole").select("key", "n_words", "n_features", total.alias("total"))
    weight = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (total - pmod(total, n_features)) DIV n_features END")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("weight", weight).select("key", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def draw(rows: DataFrame, percent: int, least_words: int) -> DataFrame:
    """rows (as scored() gives them) with `rank`: 1, 2, 3 ... for the `percent` of the rows of at least `least_words` words
    that score highest, null for all others. Ranks come from the sizes of a range exchange's partitions."""
    able = rows.where(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_last("key"), "n_features", "weight"]
    placed = stored(able.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "p long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("p", F.shiftright("at", 33)).join(starts, "p").withColumn("rank", F.when(rank <= percent * before // 100, rank))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest)


def resample(source: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", n: int = 1, buckets: int = 10_000, seed: str = "2024", percent: int = 10, least_words: int = 20) -> DataFrame:
    """key, n_features, weight, score, rank of every row of source, drawn towards the texts of target."""
    own = stored(bucket_counts(source, key, text, n, buckets))
    wanted = bucket_counts(target.withColumn("_k", F.lit(None).cast("long")), "_k", text, n, buckets)
    gain = gains(merged(own), merged(wanted), buckets)
    rows = stored(scored(own, gain, seed))
    discard(own)
    return draw(rows, percent, least_words).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
