"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded run of documents in one task. Its words become symbols: one for each word of the benchmark, and a
separator for all others, for document ends, and for runs too short to hold a phrase (no occurrence can cross them).
The test phrases, windows of `size` consecutive benchmark words, are searched backwards in the shard's FM-index through
wavelet-matrix ranks; occurrences are located by sampled suffix positions, and the words they cover are merged into
removal spans. No shuffle. Phrases go to the shards in blocks of bounded size: one index for each shard and block, in one
Python stage; a benchmark of more blocks takes as many passes, each written before the next, that add to the spans and
items found before.

Words: A-Z lower-cased, then runs of letters, digits and non-ASCII characters. An item of fewer words than `size` is
one window; one without words is none. Null text has no words. Repeated rows and ids each get their own result. The
windows of an item without an id hit words like any other's, but the item is not listed. An empty benchmark hits nothing;
an empty table gives no rows. Other columns pass through, but for those named n_words, spans or items, which the result
replaces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import added, batch, chunks, mapped, ranges, stored, texts_of
from quillon.llm.fmindex import MOST, FmIndex

SIZE = 10
SHARD_BYTES = 4 << 20
#: Windows of one block, which is broadcast; about 40 MB at most.
BLOCK_WINDOWS = 400_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


class Block:
    """Phrases as rows of symbols, and the items of each phrase."""

    def __init__(self, windows: dict[tuple, set[str]], size: int):
        self.vocab = {w: i + 1 for i, w in enumerate(sorted({w for x in windows for w in x}))}
        self.sigma = len(self.vocab)
        self.phrases = np.zeros((len(windows), size), np.int32)
        for row, x in zip(self.phrases, windows, strict=True):
            row[size - len(x) :] = [self.vocab[w] for w in x]
        self.length = (self.phrases > 0).sum(axis=1)
        self.items = [tuple(x) for x in windows.values()]


def blocks(benchmark: DataFrame, key: str, text: str, size: int, most: int):
    """The benchmark's windows, read as a stream, in blocks of `most`."""
    windows: dict[tuple, set[str]] = {}
    for item, said in benchmark.select(key, text).toLocalIterator():
        x = words(said or "")
        for i in range(max(1, len(x) - size + 1) if x else 0):
            windows.setdefault(tuple(x[i : i + size]), set()).update([] if item is None else [str(item)])
            if len(windows) >= most:
                yield Block(windows, size)
                windows = {}
    if windows:
        yield Block(windows, size)


def search(texts: list[bytes], block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the documents of a shard: the first word of each and the end; and (phrase, word place) of each occurrence."""
    vocab = block.vocab | {b"A": -1}  # no word has capitals
    get = vocab.get
    code = np.array([get(w, 0) for w in b" A ".join([t.translate(_LETTERS) for t in texts]).split()] + [-1], np.int32)
    stops = np.flatnonzero(code == -1)
    first = np.concatenate([[0], stops + 1])
    size = block.phrases.shape[1]
    edge = np.diff(np.concatenate([[0], (code > 0).astype(np.int8)]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= block.length.min()
    place = ranges(starts[long], (ends - starts)[long] + 1)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for a in range(0, max(1, len(place) - size + 1), MOST - size):  # a stretch overlaps the next by a phrase less one word
        part = place[a : a + MOST - 1]
        if len(part):
            seq = np.append(np.maximum(code[part], 0), 0)
            phrase, at = FmIndex(seq, block.sigma).find(block.phrases)
            found.append((phrase, part[at]))
    phrase, at = (np.concatenate(x) for x in zip(*found, strict=True))
    return first, stops, phrase, at


def _pass(df: DataFrame, shared, text: str, again: bool) -> DataFrame:
    names = [c for c in df.columns if c not in ("n_words", "spans", "items")]
    schema = added(df.select(names), "n_words long, spans array<struct<start:int,end:int>>, items array<string>")
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        block = shared.value
        for part in chunks(batches, text, SHARD_BYTES):
            first, stops, phrase, at = search(texts_of(part.column(text)).cast(pa.binary()).to_pylist(), block)
            doc = np.searchsorted(stops, at)
            delta = np.zeros(int(stops[-1]) + 2, np.int64)
            np.add.at(delta, at, 1)
            np.add.at(delta, at + block.length[phrase], -1)
            items = [set() for _ in range(part.num_rows)]
            pairs = np.unique(doc * len(block.items) + phrase)
            for d, p in zip(*divmod(pairs, len(block.items)), strict=True):
                items[d].update(block.items[p])
            if again:
                for k, (spans, before) in enumerate(zip(part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True)):
                    items[k].update(before)
                    for s in spans:
                        delta[first[k] + s["start"]] += 1
                        delta[first[k] + s["end"]] -= 1
            hit = np.diff(np.concatenate([[0], (np.cumsum(delta) > 0).astype(np.int8)]))
            starts, ends = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
            owner = np.searchsorted(stops, starts)
            values = pa.StructArray.from_arrays([pa.array((x - first[owner]).astype(np.int32)) for x in (starts, ends)], fields=list(span))
            offsets = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            columns = [pa.array(stops - first[:-1], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *columns], names=[*names, "n_words", "spans", "items"])

    return mapped(df, run, schema)


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "item_id", item_text: str = "text", size: int = SIZE, most: int = BLOCK_WINDOWS) -> DataFrame:
    """df with n_words, spans (of words, merged, end exclusive) and items (ids as strings, sorted)."""
    spark, out, again = df.sparkSession, df, False
    for block in blocks(benchmark, key, item_text, size, most):
        if again:
            out = stored(out)
        out, again = _pass(out, spark.sparkContext.broadcast(block), text, again), True
    return out if again else _pass(df, spark.sparkContext.broadcast(Block({(b"-",): set()}, size)), text, False)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated of contamination()'s rows."""
    schema = pa.schema([(key, pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    def run(batches):
        for part in batches:
            hits = [sum(s["end"] - s["start"] for s in x) for x in part.column("spans").to_pylist()]
            items = part.column("items").to_pylist()
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield batch(schema, part.column(key).cast(pa.int64()), part.column("n_words"), hits, list(map(len, items)), sha, [h > 0 for h in hits])

    return mapped(found.select(key, "n_words", "spans", "items"), run, f"{key} long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
