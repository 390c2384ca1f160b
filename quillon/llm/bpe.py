"""Byte-level BPE encoding and decoding over length-bucketed padded numpy matrices.

A text is cut into pieces by the tokenizer's pattern, and the different pieces of a chunk of texts are numbered. Those not
met before by this worker are put into padded matrices of token ids, one for each bucket of lengths and a column for each
piece; in each round every column merges its leftmost pair of the lowest rank, found by a hashed pair table, and links
the places beside it. Pieces are remembered with their ids and decimals in Arrow columns of bounded size, so a frequent word
is merged once for each worker, and a text's ids are taken from there by the numbers of its pieces.

Null text encodes as no ids; repeated rows each get their own; an empty table gives no rows. Rows keep every other
column, but for one named like a result, which it replaces; a text of any length is encoded whole. Pieces over
LONGEST bytes (runs without any break) take the same merges through a heap, as a matrix of one column would cost the
square of its length. Any pattern may be given, with groups too; empty matches give no ids. Ranks of 2^21 and more are
refused.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quillon.llm.common import added, batch, buffers, chunks, mapped, texts_of

PLACE_BITS, ID_BITS = 9, 21
LONGEST = 1 << PLACE_BITS
#: Pieces that a worker remembers at once, and about how many bytes they may take; beyond either the table starts anew.
REMEMBERED, REMEMBERED_BYTES = 400_000, 64 << 20
#: Pieces that are Python strings at once, beside those of one text of as many characters.
AT_ONCE = 1 << 18
NONE = np.int32(2**31 - 1)
KNOWN = pa.schema([("piece", pa.large_binary()), ("ids", pa.large_binary()), ("decimals", pa.large_binary())])


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The parts of data, in bytes, that lie between 0 and each of the ends."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def joined(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large binary array without nulls, and its n + 1 offsets in them."""
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    return np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class PairTable:
    """Rank of the pair (left id, right id) by open addressing with linear probes; a slot holds left, right and rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(len(rank) * 2).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        key = left.astype(np.int64) << ID_BITS | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.slots[slot[todo]] == -1
            first = np.unique(slot[todo[free]], return_index=True)[1]
            won = todo[free][first]
            self.slots[slot[won]] = key[won] << ID_BITS | rank[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = np.where(self.slots[slot[todo]] == -1, slot[todo], (slot[todo] + 1) & ((1 << self.bits) - 1))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each pair its rank and behind that its place, as one number; NONE if there is no such pair."""
        key = left.astype(np.int64) << ID_BITS | right
        slot = self._slot(key)
        found = self.slots[slot]
        same = found >> ID_BITS == key
        out = np.where(same, (found & ((1 << ID_BITS) - 1)) << PLACE_BITS | place, NONE).astype(np.int32)
        open_ = np.flatnonzero(~same & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slots[slot[open_]]
            same = found >> ID_BITS == key[open_]
            hit = open_[same]
            out[hit] = (found[same] & ((1 << ID_BITS) - 1)) << PLACE_BITS | place[hit]
            open_ = open_[~same & (found >= 0)]
        return out


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        #: An id that no token has, at places without one.
        self.nothing = max(ranks.values()) + 1
        if self.nothing >= 1 << ID_BITS:
            raise ValueError(f"ranks of {1 << ID_BITS} and more are not supported")
        vocab = [b""] * self.nothing
        for token, rank in ranks.items():
            vocab[rank] = token
        self.vocab = pa.array(vocab, pa.large_binary())
        self.decimals = pa.array([b"%d," % k for k in range(self.nothing)], pa.large_binary())
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank)
        self.rank_of = {(a, b): r for a, b, r in pairs}
        self.forget()

    def forget(self) -> None:
        self.known = pa.RecordBatch.from_pylist([], KNOWN)
        self.held = 0

    def merge(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces (large binary), one after the other, and how many each has; by buckets of like length."""
        data, offsets = joined(pieces)
        lengths = np.diff(offsets)
        whole = np.where(lengths > 0, pc.fill_null(pc.index_in(pieces, value_set=self.vocab), -1).to_numpy(), -1)
        width = np.where(lengths < 24, -(-lengths // 3) * 3, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        width[(whole >= 0) | (lengths > LONGEST)] = 0
        rows = np.flatnonzero(whole >= 0)
        done = [(rows, whole[rows].astype(np.int32), np.ones(len(rows), np.int64))]
        for k in np.flatnonzero(lengths > LONGEST):
            if whole[k] < 0:
                ids = np.array(self._merge_long(data[offsets[k] : offsets[k + 1]]), np.int32)
                done.append((np.array([k]), ids, np.array([len(ids)])))
        for w in np.unique(width[width > 0]).tolist():
            rows = np.flatnonzero(width == w)
            for part in np.array_split(rows, -(-len(rows) * w >> 16)):
                done.append((part, *self._merge_rows(data, offsets[part], lengths[part], w)))
        rows, ids, count = map(np.concatenate, zip(*done, strict=True))
        counts = np.zeros(len(pieces), np.int64)
        counts[rows] = count
        return joined(binaries(ids, 4 * np.cumsum(count)).take(pa.array(np.argsort(rows))))[0].view(np.int32), counts

    def _merge_rows(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """merge() of pieces of up to `width` bytes. A column is a piece, with a row for each place and one of nothing
        below, which is also what comes before the first place."""
        n, place = len(starts), np.arange(width)[:, None]
        ids = np.full((width + 1, n), self.nothing, np.int32)
        ids[:width] = np.where(place < lengths, self.single[data.take(starts + place, mode="clip")], self.nothing)
        key = np.full((width + 1, n), NONE, np.int32)
        key[:width] = self.pairs.get(ids[:-1].ravel(), ids[1:].ravel(), np.repeat(place, n)).reshape(width, n)
        after = np.repeat(np.arange(1, width + 2), n)
        before = np.repeat(np.arange(-1, width), n)
        before[:n] = width
        ids, column = ids.ravel(), np.arange(n)
        while True:
            low = key.min(axis=0)
            live = np.flatnonzero(low != NONE)
            if not len(live):
                break
            if 2 * len(live) <= len(column):
                key, low, column, live = key[:, live], low[live], column[live], np.arange(len(live))
            low, c = low[live].astype(np.int64), column[live]
            here, rank = low & (LONGEST - 1), low >> PLACE_BITS
            at = here * n + c
            gone = after[at]
            dead = gone * n + c
            right = after[dead]
            left = before[at]
            ids[at], ids[dead] = rank, self.nothing
            after[at] = right
            before[right * n + c] = here
            key[gone, live] = NONE
            key[here, live] = self.pairs.get(rank, ids[right * n + c], here)
            key[left, live] = self.pairs.get(ids[left * n + c], rank, left)
        ids = ids[: width * n].reshape(width, n).T
        there = ids != self.nothing
        return ids[there], there.sum(axis=1)

    def _merge_long(self, piece: np.ndarray) -> list[int]:
        ids = self.single[piece].tolist()
        n = len(ids)
        after, before, get = list(range(1, n + 1)), list(range(-1, n - 1)), self.rank_of.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := get((r, ids[k]))) is not None:
                    heapq.heappush(heap, (s, i, r, ids[k]))
            if (h := before[i]) >= 0 and (s := get((ids[h], r))) is not None:
                heapq.heappush(heap, (s, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, and how many each text has."""
        blocks, loose, count = [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if len(text) <= AT_ONCE and not self.pattern.groups:
                parts = [self.pattern.findall(text)]
            else:
                found = (m[0] for m in self.pattern.finditer(text))
                parts = iter(lambda found=found: list(islice(found, AT_ONCE)), [])
            for part in parts:
                count[k] += len(part)
                loose += part
                if len(loose) >= AT_ONCE:
                    blocks.append(pa.array(loose, pa.large_string()))
                    loose = []
        return pa.concat_arrays([*blocks, pa.array(loose, pa.large_string())]), count

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts and the n + 1 places between texts in them; their decimals, a comma behind each, and the
        places between texts in those. The texts' new pieces are merged together."""
        pieces, count = self._cut(texts)
        coded = pieces.cast(pa.large_binary()).dictionary_encode()
        slot = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known["piece"]), -1).to_numpy().copy()
        if (new := slot < 0).any():
            fresh = coded.dictionary.filter(pa.array(new))
            ids, counts = self.merge(fresh)
            ends = np.cumsum(counts)
            decimals, places = joined(self.decimals.take(pa.array(ids)))
            slot[new] = np.arange(self.known.num_rows, self.known.num_rows + len(fresh))
            rows = pa.RecordBatch.from_arrays([fresh, binaries(ids, 4 * ends), binaries(decimals, places[ends])], schema=KNOWN)
            self.known = pa.concat_batches([self.known, rows])
        slots = pa.array(slot[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(count)])
        ids, at = joined(self.known["ids"].take(slots))
        decimals, places = joined(self.known["decimals"].take(slots))
        # the columns, a copy of them as they grow, and what index_in makes of the pieces
        self.held = 3 * self.known.nbytes
        if self.known.num_rows > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.forget()
        return ids.view(np.int32), at[ends] // 4, decimals, places[ends]

    def encode(self, texts: list[str]):
        """For each text its ids, as an array and as comma-joined decimals."""
        ids, at, decimals, places = self.tokens(texts)
        for k in range(len(texts)):
            yield ids[at[k] : at[k + 1]], decimals[places[k] : places[k + 1]].tobytes().decode().rstrip(",")

    def decode(self, ids: np.ndarray) -> bytes:
        return joined(self.vocab.take(pa.array(ids)))[0].tobytes()


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    with open(path, "rb") as file:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the column `ids` (array<int>) after its own columns, replacing one of that name.

    path: a ranks file that every executor has (an installed vocabulary). No shuffle, no state between rows."""
    schema = added(df.drop(ids), f"{ids} array<int>")
    names = df.drop(ids).columns

    def run(batches):
        bpe = load(path, pattern)
        for part in chunks(batches, text):
            flat, at, _, _ = bpe.tokens(texts_of(part.column(text)).to_pylist())
            column = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), column], names=[*names, ids])

    return mapped(df, run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the column `out` (binary): the bytes of the ids; null ids give no bytes."""
    schema = added(df.drop(out), f"{out} binary")
    names = df.drop(out).columns

    def run(batches):
        bpe = load(path, pattern)
        for part in batches:
            column = pa.array([bpe.decode(np.array(x or [], np.int64)) for x in part.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), column], names=[*names, out])

    return mapped(df, run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_tokens, ids_sha256, decoded_sha256, lossless: encode, then decode, in one pass."""
    schema = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("lossless", pa.bool_())])

    def run(batches):
        bpe = load(path, pattern)
        for part in chunks(batches, text):
            whole = texts_of(part.column(text))
            ids, at, decimals, places = bpe.tokens(whole.to_pylist())
            back, ends = joined(bpe.vocab.take(pa.array(ids)))
            (said, spots), ends = buffers(whole), ends[at]
            rows = []
            for k in range(len(whole)):
                own, same = back[ends[k] : ends[k + 1]], np.array_equal(back[ends[k] : ends[k + 1]], said[spots[k] : spots[k + 1]])
                listed = decimals[places[k] : max(places[k], places[k + 1] - 1)]
                rows.append((int(at[k + 1] - at[k]), hashlib.sha256(listed).hexdigest(), hashlib.sha256(own).hexdigest(), same))
            yield batch(schema, part.column(key).cast(pa.int64()), *map(list, zip(*rows, strict=True)))

    return mapped(df.select(key, text), run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
