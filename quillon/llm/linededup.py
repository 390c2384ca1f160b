"""Line dedup by range-partitioned hashes, streamed in order, with keep bitmaps as the result.

Each line of a document has a key: the line stripped of ASCII white space at both ends, A-Z in lower case. A row
(128-bit hash of the key, document, position) goes through one range exchange by (hash, document), so that a line that
many documents share spreads over several partitions instead of meeting in one task. Partitions are sorted by hash,
document and position and streamed: the first document of each hash keeps its lines, and the others lose theirs. Only
the run that begins a partition may have begun in an earlier one; its rows wait for a table of two rows for each
partition that tells the first document of such hashes.

Result: for each document that loses lines, a zlib-compressed bitmap with one bit for each line, no text.

Keys shorter than min_chars code points stay always. Null and empty texts are one empty line. Rows are told apart by
(doc_id, hash of the text): equal rows lose equal lines, and the smallest doc_id decides. A null doc_id counts as the
largest. Empty input: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import batch, checkpointed, chunks, mapped, texts_of

MIN_CHARS = 10
STRIP = b" \t\n\x0b\f\r"
_LAST = 2**63 - 1
_DROP, _WAITS, _FIRST = 0, 1, 2


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(body).alias("version"), body.alias("text"))


def _lines(df: DataFrame, min_chars: int) -> DataFrame:
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("version", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])

    def run(batches):
        for part in chunks(batches, "text"):
            digests, row, pos, count = [], [], [], []
            for k, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                lines = text.split(b"\n")
                for i, line in enumerate(lines):
                    line = line.strip(STRIP)
                    if len(line) >= min_chars and (line.isascii() or len(line.decode()) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(line.lower()))
                        row.append(k)
                        pos.append(i)
                        count.append(len(lines))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int32())
            yield batch(schema, np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]), part.column("doc").take(at), part.column("version").take(at), pos, count)

    return mapped(df, run, "h1 long, h2 long, doc long, version long, pos int, n_lines int")


def _streamed(sorted_lines: DataFrame) -> DataFrame:
    """Rows of kind _DROP, _WAITS (in the run that begins the partition) and _FIRST (a run's first document here)."""
    fields = "kind int, h1 long, h2 long, doc long, version long, pos int, n_lines int"
    schema = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("version", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])

    def run(batches):
        open_, first, opening = None, 0, True  # the run that is open, its first document, whether it began the partition
        for part in batches:
            n = part.num_rows
            if not n:
                continue
            h1, h2, doc = (part.column(c).to_numpy() for c in ("h1", "h2", "doc"))
            new = np.concatenate([[open_ != (h1[0], h2[0])], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            starts = np.flatnonzero(new)
            begins = open_ is None
            run_of = np.cumsum(new) - 1  # -1: the run that the last batch left open
            firsts = doc[starts]
            own = np.where(run_of < 0, first, firsts[np.maximum(run_of, 0)] if len(firsts) else first)
            waits = (run_of == 0) if begins else (run_of < 0) & opening
            out = waits | (doc != own)
            if out.any():
                kind = pa.array(np.where(waits, _WAITS, _DROP)[out].astype(np.int32))
                mask = pa.array(out)
                yield batch(schema, kind, *(part.column(c).filter(mask) for c in schema.names[1:]))
            if begins:
                yield _first(schema, h1[0], h2[0], firsts[0])
            if len(starts):
                opening = begins and len(starts) == 1
                first = firsts[-1]
            open_ = (h1[-1], h2[-1])
        if open_ is not None:
            yield _first(schema, *open_, first)

    return mapped(sorted_lines, run, fields)


def _first(schema: pa.Schema, h1: int, h2: int, doc: int) -> pa.RecordBatch:
    return batch(schema, [_FIRST], [int(h1)], [int(h2)], [int(doc)], [0], [0], [0])


def keep_bitmaps(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, version, n_dropped, bitmap of the documents that lose lines."""
    lines = _lines(_keyed(df, key, text), min_chars)
    seen = checkpointed(_streamed(lines.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "version", "pos")))
    # two rows for each partition at most, so their number is bounded by the number of partitions
    firsts = F.broadcast(seen.where(F.col("kind") == _FIRST).groupBy("h1", "h2").agg(F.min("doc").alias("first")))
    late = seen.where(F.col("kind") == _WAITS).join(firsts, ["h1", "h2"]).where(F.col("doc") != F.col("first"))
    cols = ["doc", "version", "pos", "n_lines"]
    gone = seen.where(F.col("kind") == _DROP).select(cols).unionByName(late.select(cols))
    lost = gone.groupBy("doc", "version").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    schema = pa.schema([("doc", pa.int64()), ("version", pa.int64()), ("n_dropped", pa.int64()), ("bitmap", pa.binary())])

    def pack(batches):
        for part in batches:
            bitmaps = []
            for n, pos in zip(part.column("n_lines").to_pylist(), part.column("gone").to_pylist(), strict=True):
                keep = np.ones(n, bool)
                keep[pos] = False
                bitmaps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
            yield batch(schema, part.column("doc"), part.column("version"), pc.list_value_length(part.column("gone")).cast(pa.int64()), pa.array(bitmaps, pa.binary()))

    return mapped(lost, pack, "doc long, version long, n_dropped long, bitmap binary")


def with_bitmaps(df: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the column keep_bitmap (null: every line stays)."""
    b = bitmaps.select("doc", "version", F.col("bitmap").alias("keep_bitmap"))
    on = (F.coalesce(F.col(f"d.{key}").cast("long"), F.lit(_LAST)) == F.col("b.doc")) & (F.xxhash64(F.coalesce(F.col(f"d.{text}"), F.lit(""))) == F.col("b.version"))
    return df.drop("keep_bitmap").alias("d").join(b.alias("b"), on, "left").select("d.*", "b.keep_bitmap")


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[bytes, int]:
    """The lines that stay, joined, and the number of lines before."""
    lines = text.split(b"\n")
    if bitmap is None:
        return text, len(lines)
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines)).astype(bool)
    return b"\n".join([line for line, k in zip(lines, keep.tolist(), strict=True) if k]), len(lines)


def apply_bitmaps(df: DataFrame, text: str = "text", bitmap: str = "keep_bitmap") -> DataFrame:
    """df without its bitmap column and with the lines that stay as its text; untouched rows keep their text, null too."""
    names = [c for c in df.columns if c != bitmap]

    def run(batches):
        for part in chunks(batches, text):
            column = part.column(text)
            marks = part.column(bitmap).to_pylist()
            if any(m is not None for m in marks):
                column = pa.array([t if m is None else kept_text((t or "").encode(), m)[0].decode() for t, m in zip(column.to_pylist(), marks, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([column if n == text else part.column(n) for n in names], names=names)

    return mapped(df, run, df.drop(bitmap).schema)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_lines, n_dropped, kept_sha256 of a frame with keep_bitmap."""
    schema = pa.schema([(key, pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for part in chunks(batches, text):
            rows = []
            for t, m in zip(texts_of(part.column(text)).cast(pa.binary()).to_pylist(), part.column("keep_bitmap").to_pylist(), strict=True):
                kept, n = kept_text(t, m)
                dropped = 0
                if m is not None:
                    dropped = n - int(np.unpackbits(np.frombuffer(zlib.decompress(m), np.uint8), count=n).sum())
                rows.append((n, dropped, hashlib.sha256(kept).hexdigest()))
            yield batch(schema, part.column(key).cast(pa.int64()), *map(list, zip(*rows, strict=True)))

    return mapped(df.select(key, text, "keep_bitmap"), run, f"{key} long, n_lines long, n_dropped long, kept_sha256 string")
