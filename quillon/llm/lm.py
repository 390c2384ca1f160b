"""Language-model scoring with a hierarchical Pitman-Yor model of words, seated by Gibbs sampling.

Restaurants: one for each word, for what follows it; all share the unigram restaurant as parent, whose own parent is uniform
over the V training words and one unknown. Each customer of a context restaurant is a training token; each of its tables
is a customer of the parent. Discounts follow from the counts of counts, n1 / (n1 + 2 n2), at either level.

The work goes in steps over messages (to, kind, src, payload), each a table in the shared folder:
1. A chunk of documents sends its distinct (context, word) pairs to shards and keeps where they stand. A shard is a range of
   (word, context), cut at quantiles of a sample, so that a frequent word spreads over several shards; only the balance
   depends on the sample. The shard merges the chunks' pairs and reports its contexts, with their types and customers.
2. Homes, hash ranges of contexts, add the reports up and reply: each shard knows all sizes of its contexts' restaurants.
3. A shard seats the customers of each pair one after the other (drawn at once from the distribution of that process: the
   gaps between new tables by their Gamma-function form, then the sizes of the tables), likewise the parent's, and runs
   BURN sweeps. In a sweep up to STEPS random customers of each pair are taken out and seated again, given all others; then
   the parent's, after words whose tables below have changed in number are seated there anew. Pairs of a shard move in
   step, and what other shards do is known from the last exchange.
4. Homes add up the tables; the shards go on for SAMPLES sweeps that count.
5. Homes add up the tables of each sample; shards answer the chunks with the predictive probability of every pair,
   averaged over the samples. All sums are exact there, so the probabilities of a context sum to one.
6. The chunk adds up its documents' tokens.

Words are told apart by 64-bit hashes, contexts by 48 bits of them. A pair of one customer always has one table and needs no
sampling. Sums of words that lie in several shards, at most one cut for each shard, go through the driver. Memory follows
the sizes of a chunk and a shard, not the corpus.

Null text is empty: only the end token. Repeated rows are scored each for itself. A null doc_id is kept. Empty input: no
rows. Other columns stay out of the result. If nothing is learned, each token has probability one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import chunks, discard, mapped, stored, texts_of

SHARD_BYTES = 10 << 20
CHUNK_BYTES = 6 << 20
CHUNK_ROWS = 1 << 15
#: Text from which the shards' bounds are taken, and one of how many of its pairs.
SAMPLE_BYTES, SAMPLE_PAIRS = 64 << 20, 64
REMEMBERED = 150_000
STRENGTH = 2.0
BURN, SAMPLES = 2, 3
#: Customers of a pair that one sweep takes out and seats again.
STEPS = 16
#: So many customers are seated one by one before gaps between new tables are drawn at once; either way is the same process.
ONE_BY_ONE = 12
#: Pairs of so many customers are seated each for itself.
MANY = 2000

PAIRS, KEPT, STATE, PLACES, REPORT, CUT, COUNTS, REPLY, SEATS, EXTRA, DRAWN, ANSWER = range(12)
MESSAGE = "to long, kind int, src long, payload binary"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
END = xxhash.xxh3_64_intdigest(b"\0END")


class Hasher:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit hashes of the different tokens in order, and the place of each token's among them; an END stands behind
        each document."""
        said = b" E ".join([*(t.translate(_LOWER) for t in texts), b""]).split()  # no word has capitals
        all_ = list(set(said))
        if len(self.known) > REMEMBERED:
            self.known = {}
        for w in set(all_).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        self.known[b"E"] = END
        names, at = np.unique(np.fromiter(map(self.known.__getitem__, all_), np.uint64, len(all_)), return_inverse=True)
        place = dict(zip(all_, at.tolist(), strict=True))
        return names, np.fromiter(map(place.__getitem__, said), np.int64, len(said))


def pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Arrays of not negative integers with so many bytes each, byte by byte in planes, which compress well; compressed."""
    head = np.array([len(columns), *(n for x, size in columns for n in (len(x), size))], "<i8").tobytes()
    return head + zstandard.compress(b"".join(np.ascontiguousarray(np.asarray(x).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes() for x, size in columns), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    shape, at, out = np.frombuffer(data, "<i8", 2 * n, 8).reshape(n, 2).tolist(), 0, []
    data = zstandard.decompress(data[8 + 16 * n :])
    for length, size in shape:
        x = np.zeros((length, 8), np.uint8)
        x[:, :size] = np.frombuffer(data, np.uint8, length * size, at).reshape(size, length).T
        out.append(x.view("<u8").ravel())
        at += length * size
    return out


def bytes_for(x: np.ndarray) -> int:
    return max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts) if len(starts) else np.zeros(0, np.int64)


class Chunk:
    """The distinct pairs of a chunk in order of word and context, and the documents that each stands in."""

    def __init__(self, names: np.ndarray, own: np.ndarray, held: np.ndarray):
        end = np.searchsorted(names, END)
        ends = own == end
        doc = np.cumsum(ends) - ends
        self.tokens = np.diff(np.concatenate([[-1], np.flatnonzero(ends)]))
        key = own << 32 | np.concatenate([[end], own[:-1]])
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        pairs, refs = _starts(key), _starts(key, doc)
        times = np.diff(np.append(refs, len(key)))
        first = np.searchsorted(refs, pairs)
        self.doc, self.times, self.each = doc[refs], times, np.diff(np.append(first, len(refs)))
        self.word, self.context = names[key[pairs] >> 32], names[key[pairs] & 0xFFFFFFFF] >> np.uint64(16)
        self.learned = _sums(np.where(held[self.doc], 0, times), first)


def shard_of(word: np.ndarray, context: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of bounds (word, context) at or below each pair, by 48 bits of either."""
    word = word >> np.uint64(16)
    low, high = np.searchsorted(bounds[0], word, "left"), np.searchsorted(bounds[0], word, "right")
    for a, b in np.unique(np.stack([low, high])[:, low < high], axis=1).T:
        at = np.flatnonzero((low == a) & (high == b))
        low[at] = a + np.searchsorted(bounds[1][a:b], context[at], "right")
    return low


def log_gamma(x: np.ndarray) -> np.ndarray:
    small = np.prod([x + k for k in range(7)], axis=0)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(small)


def arrangement(customers: np.ndarray, chance: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The tables of items with so many customers of one dish, seated one after the other: the number of each item's
    tables, and all sizes. chance: (strength + discount * tables of the restaurant) * probability of the dish above."""
    customers = customers.astype(np.float64)
    tables, came = np.ones(len(customers), np.int64), []  # came: items, the number of their new table, customers before it
    going, j = np.flatnonzero(customers > 1), 1
    while len(going) and j < ONE_BY_ONE:
        a, t = chance[going], tables[going]
        new = going[rng.random(len(going)) * (j - discount * t + a) < a]
        came.append((new, tables[new], np.full(len(new), float(j))))
        tables[new] += 1
        j += 1
        going = going[customers[going] > j]
    seated = np.full(len(customers), float(j))
    for i in going[customers[going] >= MANY].tolist():  # few items, each with many tables
        at = _arrivals(int(customers[i]), j, int(tables[i]), float(chance[i]), discount, rng)
        came.append((np.full(len(at), i), tables[i] + np.arange(len(at)), at))
        tables[i] += len(at)
    going = going[customers[going] < MANY]
    while len(going):
        # customers x .. y - 1 all find a table with probability exp(f(y) - f(x))
        a, t, x, n = chance[going], tables[going], seated[going], customers[going]
        f = lambda y, a=a, t=t: log_gamma(y - discount * t) - log_gamma(y - discount * t + a)
        least = f(x) + np.log(1 - rng.random(len(going)))
        some = f(n) < least
        going, low, high, a, t, least = going[some], x[some], n[some], a[some], t[some], least[some]
        f = lambda y, a=a, t=t: log_gamma(y - discount * t) - log_gamma(y - discount * t + a)
        while len(going) and (high - low > 1).any():  # low: still above, high: below
            y = np.floor((low + high) / 2)
            up = f(y) >= least
            low, high = np.where(up, y, low), np.where(up, high, y)
        came.append((going, tables[going], low))  # the customer after the first `low` took a new table
        tables[going] += 1
        seated[going] = high
        going = going[high < customers[going]]
    item, number, before = map(np.concatenate, zip(*came, strict=True)) if came else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.argsort(-number, kind="stable")
    item, number, before = item[order], number[order], before[order]
    left, size = customers.astype(np.int64), np.zeros(len(item), np.int64)
    cut = np.append(_starts(number), len(number))
    for x, y in zip(cut[:-1], cut[1:], strict=True):  # of all who sat at the first tables, those at the last of them
        own, at, k = item[x:y], before[x:y], number[x]
        size[x:y] = 1 + rng.binomial(left[own] - at.astype(np.int64) - 1, rng.beta(1 - discount, at - discount * k))
        left[own] -= size[x:y]
    item, size = np.concatenate([np.arange(len(customers)), item[::-1]]), np.concatenate([left, size[::-1]])
    return tables, size[np.argsort(item, kind="stable")]


def _arrivals(customers: int, seated: int, tables: int, chance: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """How many customers sat before each new table, from the first after `seated`: one by one where new tables are near to
    each other, by the gaps beyond."""
    out, j, t, a = [], seated, tables, chance
    near = int(min(customers, max(j, 30 * a)))
    for x in rng.random(near - j).tolist():
        if x * (j - discount * t + a) < a:
            out.append(j)
            t += 1
        j += 1
    while j < customers:
        f = lambda y, t=t: math.lgamma(y - discount * t) - math.lgamma(y - discount * t + a)
        least = f(j) + math.log(1 - rng.random())
        if f(customers) >= least:
            break
        low, high = j, customers
        while high - low > 1:
            y = (low + high) // 2
            low, high = (y, high) if f(y) >= least else (low, y)
        out.append(low)
        t, j = t + 1, high
    return np.array(out, np.float64)


def predictive(own, own_tables, customers, tables, above, discount: float):
    """Probability of a dish in a restaurant with so many customers and tables, of which so many are its own; above: the
    dish's probability in the restaurant above."""
    return (np.maximum(own - discount * own_tables, 0) + (STRENGTH + discount * tables) * above) / (STRENGTH + customers)


class Seats:
    """Tables of items, each with customers of one dish in one restaurant; items are in order of falling customers."""

    def __init__(self, tables: np.ndarray, sizes: np.ndarray):
        self.tables, self.sizes = tables.astype(np.int64), sizes.astype(np.int64)

    def room(self, more: np.ndarray) -> None:
        """Lays the tables out with so many free places behind those of each item."""
        self.slots = self.tables + more
        self.start = np.cumsum(self.slots) - self.slots
        flat = np.zeros(int(self.slots.sum()), np.int64)
        flat[np.repeat(self.start, self.tables) + np.arange(len(self.sizes)) - np.repeat(np.cumsum(self.tables) - self.tables, self.tables)] = self.sizes
        self.flat, self.used = flat, self.tables.copy()

    def close(self) -> None:
        self.sizes = self.flat[self.flat > 0]

    def _pick(self, n: int, weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A place of each of the first n items, by weight."""
        total = np.cumsum(weights)
        base = np.where(self.start[:n] > 0, total[self.start[:n] - 1], 0)
        end = self.start[:n] + self.slots[:n]
        at = np.searchsorted(total, base + rng.random(n) * (total[end - 1] - base), "right")
        at = np.clip(at, self.start[:n], end - 1)
        for k in np.flatnonzero(weights[at] <= 0):  # a rounded sum has led behind the last table
            at[k] = self.start[k] + np.flatnonzero(weights[self.start[k] : end[k]])[-1]
        return at

    def leave(self, n: int, rng: np.random.Generator) -> np.ndarray:
        """A random customer of each of the first n items leaves; -1 where the table goes with it."""
        flat = self.flat[: self.start[n - 1] + self.slots[n - 1]]
        at = self._pick(n, flat.astype(np.float64), rng)
        flat[at] -= 1
        gone = flat[at] == 0
        self.tables[:n] -= gone
        return -gone.astype(np.int64)

    def sit(self, n: int, chance: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
        """A customer of each of the first n items sits down; 1 where at a new table."""
        flat = self.flat[: self.start[n - 1] + self.slots[n - 1]]
        weights = np.where(flat > 0, flat - discount, 0.0)
        known = _sums(weights, self.start[:n])
        new = rng.random(n) * (known + chance) >= known
        at = np.where(new, self.start[:n] + self.used[:n], self._pick(n, weights, rng))
        flat[at] += 1
        self.used[:n] += new
        self.tables[:n] += new
        return new.astype(np.int64)


def cut_words(word: np.ndarray, cut: dict[int, tuple]) -> tuple[np.ndarray, list[tuple]]:
    """The places of the cut words among these sorted words, and what is known of each."""
    names = np.array(sorted(cut), np.uint64)
    at = np.searchsorted(word, names)
    here = at < len(word)
    here[here] = word[at[here]] == names[here]
    return at[here], [cut[w] for w in names[here].tolist()]


class Shard:
    """The seating of a shard: its pairs with two customers or more, and its words as customers' dishes of the parent."""

    def __init__(self, state: bytes, sizes: np.ndarray, extra: np.ndarray, totals: dict):
        self.word, self.each, self.context, self.count = unpack(state)
        self.each, self.context, self.count = (x.astype(np.int64) for x in (self.each, self.context, self.count))
        self.of = np.repeat(np.arange(len(self.word)), self.each)
        self.totals, self.discount, self.above = totals, totals["discount"], totals["above"]
        active = np.flatnonzero(self.count > 1)
        self.active = active[np.argsort(-self.count[active], kind="stable")]
        self.types = _sums((self.count > 0).astype(np.int64), np.cumsum(self.each) - self.each)
        # tables of each context that are not this shard's extra ones
        self.elsewhere = sizes + extra
        self.known = np.flatnonzero(self.types > 0)
        self.cut, found = cut_words(self.word, totals["cut"])
        self.others = np.array([x[1] for x in found], np.float64)

    def begin(self, rng: np.random.Generator) -> None:
        """Seats all customers anew."""
        a = self.active
        t = self.totals
        share = predictive(self.customers(self.types), 1, t["pairs"], t["v"], 1 / (t["v"] + 1), self.above)
        chance = (STRENGTH + self.discount * self.elsewhere[self.context[a]]) * share[self.of[a]]
        self.seats = Seats(*arrangement(self.count[a], chance, self.discount, rng))
        self.extra = np.bincount(self.context[a], self.seats.tables - 1, len(self.elsewhere)).astype(np.int64)
        self.totals["customers"] += int(self.extra.sum())
        self._parent(rng)

    def resume(self, tables: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> None:
        self.seats = Seats(tables, sizes)
        self.extra = np.bincount(self.context[self.active], self.seats.tables - 1, len(self.elsewhere)).astype(np.int64)
        self.elsewhere = self.elsewhere - self.extra  # the homes' sums hold them too
        self._parent(rng)

    def customers(self, own: np.ndarray) -> np.ndarray:
        """Customers of each word at the parent, with those of other shards where the word is cut."""
        out = own.astype(np.float64)
        out[self.cut] = np.maximum(out[self.cut], self.others)
        return out

    def own_customers(self) -> np.ndarray:
        return self.types + np.bincount(self.of[self.active], self.seats.tables - 1, len(self.word)).astype(np.int64)

    def _parent(self, rng: np.random.Generator) -> None:
        """The words' seats at the parent, in order of falling customers; drawn one after the other."""
        n = self.own_customers()
        self.dishes = self.known[np.argsort(-n[self.known], kind="stable")]
        chance = np.full(len(self.dishes), (STRENGTH + self.above * self.totals["tables"]) / (self.totals["v"] + 1))
        self.parent = Seats(*arrangement(n[self.dishes], chance, self.above, rng))

    def share(self, n: np.ndarray) -> np.ndarray:
        """Predictive probability of each word at the parent."""
        t = self.totals
        tables = np.zeros(len(self.word))
        tables[self.dishes] = self.parent.tables
        return predictive(n, tables, t["customers"], t["tables"], 1 / (t["v"] + 1), self.above)

    def sweep(self, rng: np.random.Generator) -> None:
        a, seats = self.active, self.seats
        rows = self.own_customers()
        if len(a):
            size = self.count[a]
            seats.room(np.minimum(size, STEPS))
            for step in range(STEPS):
                n = int(np.searchsorted(-size, -step - 1, "right"))  # items with more customers than steps done
                if not n:
                    break
                context, word = self.context[a[:n]], self.of[a[:n]]
                for seat in (False, True):
                    if seat:
                        share = self.share(self.customers(rows))
                        chance = (STRENGTH + self.discount * (self.elsewhere + self.extra)[context]) * share[word]
                        change = seats.sit(n, chance, self.discount, rng)
                    else:
                        change = seats.leave(n, rng)
                    at = np.flatnonzero(change)
                    self.totals["customers"] += int(change.sum())
                    np.add.at(self.extra, context[at], change[at])
                    np.add.at(rows, word[at], change[at])
            seats.close()
        self._follow(rows, rng)

    def _follow(self, rows: np.ndarray, rng: np.random.Generator) -> None:
        """The parent's customers after a sweep below: as many leave or come as there are fewer or more, then STEPS of
        each word are seated again."""
        tables, parent = int(self.parent.tables.sum()), self.parent
        n = rows[self.dishes]
        had = np.zeros(len(self.dishes), np.int64)
        np.add.at(had, np.repeat(np.arange(len(self.dishes)), parent.tables), parent.sizes)
        order = np.argsort(-n, kind="stable")
        starts = np.cumsum(parent.tables) - parent.tables
        from_ = np.repeat(starts[order], parent.tables[order]) + np.arange(len(parent.sizes)) - np.repeat(np.cumsum(parent.tables[order]) - parent.tables[order], parent.tables[order])
        sizes, self.dishes, n, had = parent.sizes[from_], self.dishes[order], n[order], had[order]
        self.parent = parent = Seats(parent.tables[order], sizes)
        # words whose customers changed are seated anew: a draw of their seats given all others
        changed = np.flatnonzero(n != had)
        base = (STRENGTH + self.above * (self.totals["tables"])) / (self.totals["v"] + 1)
        if len(changed):
            own, drawn = arrangement(n[changed], np.full(len(changed), base), self.above, rng)
            item = np.repeat(np.arange(len(n)), parent.tables)
            stay = ~np.isin(item, changed)
            item, sizes = np.concatenate([item[stay], np.repeat(changed, own)]), np.concatenate([parent.sizes[stay], drawn])
            parent.tables[changed] = own
            parent.sizes = sizes[np.argsort(item, kind="stable")]
        self.totals["tables"] += int(parent.tables.sum()) - tables
        more = int(np.searchsorted(-n, -2, "right"))
        if more:
            parent.room(np.minimum(n, STEPS))
            for step in range(STEPS):
                k = int(np.searchsorted(-n, -max(2, step + 1), "right"))
                if not k:
                    break
                self.totals["tables"] += int(parent.leave(k, rng).sum())
                base = (STRENGTH + self.above * self.totals["tables"]) / (self.totals["v"] + 1)
                self.totals["tables"] += int(parent.sit(k, np.full(k, base), self.above, rng).sum())
            parent.close()


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["to", "kind", "src", "payload"])


def _table(rows: DataFrame) -> DataFrame:
    return stored(rows, "kind")


def _step(parts: int, run, *tables: DataFrame) -> DataFrame:
    """run(to, frame by kind and src) for the messages to each place, dealt to so many partitions, as new messages."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)

    def each(key, frame):
        return _rows(run(int(key[0]), frame.sort_values(["kind", "src"])))

    return rows.repartition(parts, "to").groupBy("to").applyInPandas(each, MESSAGE)


def _addresses(spark: SparkSession, n: int) -> np.ndarray:
    """n growing numbers that Spark's hash deals to n different partitions: the addresses of the shards and homes."""
    some = 64 * n
    while True:
        found = spark.range(some).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("id")).collect()
        if len(found) == n:
            return np.sort(np.array([r["id"] for r in found], np.int64))
        some *= 2


def _of(frame: pd.DataFrame, kind: int) -> list[tuple[int, bytes]]:
    own = frame[frame["kind"] == kind]
    return list(zip(own["src"].tolist(), own["payload"], strict=True))


def _merge(key: int, frame: pd.DataFrame, address: np.ndarray, cuts: np.ndarray) -> list[tuple]:
    """Step 1 at a shard: STATE, PLACES for each chunk, REPORT for each home, CUT words, COUNTS of counts."""
    sent, n_shards = [(src, unpack(p)) for src, p in _of(frame, PAIRS)], len(address)
    word, context, learned = ([] for _ in range(3))
    for _, (w, each, c, n) in sent:
        word.append(np.repeat(w, each.astype(np.int64)))
        context.append(c)
        learned.append(n.astype(np.int64))
    sizes = [len(x) for x in context]
    word, context, learned = map(np.concatenate, (word, context, learned))
    order = np.lexsort((context, word))
    first = _starts(word[order], context[order])
    place = np.empty(len(order), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    count = _sums(learned[order], first)
    word, context = word[order][first], context[order][first]
    words = _starts(word)
    each = np.diff(np.append(words, len(word)))
    names, at = np.unique(context, return_inverse=True)
    out = [(key, STATE, key, pack((word[words], 8), (each, bytes_for(each)), (at, bytes_for(at)), (count, bytes_for(count))))]
    for (src, _), a, b in zip(sent, np.cumsum([0, *sizes]), np.cumsum(sizes), strict=False):
        steps = np.diff(place[a:b], prepend=0)  # a chunk's pairs are in the shard's order
        out.append((src, PLACES, key, pack((steps, bytes_for(steps)))))
    types, customers = np.bincount(at, count > 0, len(names)).astype(np.int64), np.zeros(len(names), np.int64)
    np.add.at(customers, at, count)
    bounds = np.searchsorted((names * np.uint64(n_shards)) >> np.uint64(48) if n_shards < 1 << 16 else ((names >> np.uint64(16)) * np.uint64(n_shards)) >> np.uint64(32), np.arange(n_shards + 1))
    for home, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            out.append((int(address[home]), REPORT, key, pack((np.diff(names[a:b], prepend=np.uint64(0)), 6), (types[a:b], bytes_for(types)), (customers[a:b], bytes_for(customers)))))
    total, kinds = _sums(count, words), _sums((count > 0).astype(np.int64), words)
    cut = np.isin(word[words] >> np.uint64(16), cuts)
    out += [(0, CUT, key, pack((np.array([w], np.uint64), 8), (np.array([n, k]), 8))) for w, n, k in zip(word[words][cut].tolist(), total[cut].tolist(), kinds[cut].tolist(), strict=True)]
    ones = [int((x == k).sum()) for x in (count, kinds[~cut]) for k in (1, 2)]
    out.append((0, COUNTS, key, pack((np.array([int(total.sum()), int((total[~cut] > 0).sum()), int(kinds.sum()), *ones]), 8))))
    return out


def _summed(key: int, frame: pd.DataFrame, kind: int, width: int) -> list[tuple]:
    """A home: sums of the columns that messages of this kind have for the contexts of the REPORTs, as REPLY to each shard."""
    asked = {src: np.cumsum(unpack(p)[0]) for src, p in _of(frame, REPORT)}
    sent = {src: unpack(p) for src, p in _of(frame, kind)}
    names = np.unique(np.concatenate(list(asked.values())))
    at = {src: np.searchsorted(names, x) for src, x in asked.items()}
    sums = np.zeros((width, len(names)), np.int64)
    for src, columns in sent.items():
        for total, x in zip(sums, columns[-width:], strict=True):
            total[at[src]] += x.astype(np.int64)
    return [(src, REPLY, key, pack(*((total[x], bytes_for(total)) for total in sums))) for src, x in at.items()]


def _replies(frame: pd.DataFrame) -> list[np.ndarray]:
    """The columns of the REPLYs of all homes; contexts are in order of their homes."""
    return [np.concatenate(x).astype(np.int64) for x in zip(*(unpack(p) for _, p in _of(frame, REPLY)), strict=True)]


def _split(columns: list[np.ndarray], frame: pd.DataFrame, key: int) -> list[tuple]:
    """Columns over a shard's contexts as EXTRA messages to their homes."""
    out, a = [], 0
    for home, p in _of(frame, REPLY):
        b = a + int(np.frombuffer(p, "<i8", 1, 8)[0])
        out.append((home, EXTRA, key, pack(*((x[a:b], bytes_for(x)) for x in columns))))
        a = b
    return out


def score(df: DataFrame, held: str, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; `held`: boolean column, true where a
    row isn't learned. The steps run at once; the result is a table in the shared folder."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(held), F.lit(False)).alias("held"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(4, -(-size // SHARD_BYTES))
    bounds = _bounds(docs, size, n_shards, seed)
    cuts = np.unique(bounds[0])
    address = _addresses(docs.sparkSession, n_shards)
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def push(batches):
        of, base = Hasher(), TaskContext.get().partitionId() << 32
        for part in (p for b in batches for q in range(0, b.num_rows, CHUNK_ROWS) for p in chunks([b.slice(q, CHUNK_ROWS)], "text", CHUNK_BYTES)):
            marks, ids = part.column("held").to_numpy(zero_copy_only=False), part.column("doc_id")
            chunk = Chunk(*of(texts_of(part.column("text")).cast(pa.binary()).to_pylist()), marks)
            to = shard_of(chunk.word, chunk.context, shared.value)
            at, rows = np.append(_starts(to), len(to)), []
            for a, b in zip(at[:-1], at[1:], strict=True):
                words = _starts(chunk.word[a:b])
                each, learned = np.diff(np.append(words, b - a)), chunk.learned[a:b]
                rows.append((int(address[to[a]]), PAIRS, -1 - base, pack((chunk.word[a:b][words], 8), (each, bytes_for(each)), (chunk.context[a:b], 6), (learned, bytes_for(learned)))))
            kept = ((ids.fill_null(0).to_numpy().view(np.uint64), 8), (ids.is_null().to_numpy(zero_copy_only=False), 1), (marks, 1), (chunk.tokens, 4), (chunk.each, bytes_for(chunk.each)), (chunk.doc, 2), (chunk.times, bytes_for(chunk.times)))
            rows.append((-1 - base, KEPT, -1 - base, pack(*kept)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["to", "kind", "src", "payload"])
            base += 1

    def merge(k, frame):
        return [(k, KEPT, k, p) for _, p in _of(frame, KEPT)] if k < 0 else _merge(k, frame, address, cuts)

    first = _table(_step(n_shards, merge, mapped(docs, push, MESSAGE)))
    of = lambda t, *kinds: t.where(F.col("kind").isin(*kinds))
    totals = _totals(first)
    sizes = _table(_step(n_shards, lambda k, f: _summed(k, f, REPORT, 2), of(first, REPORT)))

    def burn(k, frame):
        shard = Shard(_of(frame, STATE)[0][1], _replies(frame)[0], 0, dict(totals))
        rng = np.random.default_rng([seed, k, 0])
        shard.begin(rng)
        for _ in range(BURN):
            shard.sweep(rng)
        t = shard.seats.tables
        seats = pack((t, bytes_for(t)), (shard.seats.sizes, bytes_for(shard.seats.sizes)))
        return [(k, SEATS, k, seats), *_split([shard.extra], frame, k), *_customers(shard, k, cuts, 0)]

    burnt = _table(_step(n_shards, burn, of(first, STATE), sizes))
    totals = _totals(first, burnt)
    more = _table(_step(n_shards, lambda k, f: _summed(k, f, EXTRA, 1), of(first, REPORT), of(burnt, EXTRA)))
    as_extra = lambda t: t.withColumn("kind", F.lit(EXTRA))

    def draw(k, frame):
        extra = np.concatenate([unpack(p)[0] for _, p in _of(frame, EXTRA)]).astype(np.int64)
        shard = Shard(_of(frame, STATE)[0][1], _replies(frame)[0], extra, dict(totals))
        rng = np.random.default_rng([seed, k, 1])
        shard.resume(*unpack(_of(frame, SEATS)[0][1]), rng)
        drawn, extras, out = [], [], []
        for s in range(SAMPLES):
            shard.sweep(rng)
            extras.append(shard.extra.copy())
            tables = np.zeros(len(shard.word), np.int64)
            tables[shard.dishes] = shard.parent.tables
            drawn += [(shard.seats.tables.copy(), 4), (shard.own_customers(), 5), (tables, 4)]
            out += _customers(shard, k, cuts, s)
        return [(k, DRAWN, k, pack(*drawn)), *_split(extras, frame, k), *out]

    drawn = _table(_step(n_shards, draw, of(first, STATE), sizes, as_extra(more), of(burnt, SEATS)))
    discard(more, burnt)
    final = [_totals(first, drawn, s) for s in range(SAMPLES)]
    last = _table(_step(n_shards, lambda k, f: _summed(k, f, EXTRA, SAMPLES), of(first, REPORT), of(drawn, EXTRA)))

    def answer(k, frame):
        if k < 0:
            return [(k, KEPT, k, p) for _, p in _of(frame, KEPT)]
        word, each, context, count = unpack(_of(frame, STATE)[0][1])
        each, context, count = (x.astype(np.int64) for x in (each, context, count))
        of_word = np.repeat(np.arange(len(word)), each)
        types, customers = _replies(frame)
        extras = [np.concatenate(x).astype(np.int64) for x in zip(*(unpack(p) for _, p in _of(frame, EXTRA)), strict=True)]
        active = np.flatnonzero(count > 1)
        active = active[np.argsort(-count[active], kind="stable")]
        known, mean, drawn = _sums(count, np.cumsum(each) - each), 0, unpack(_of(frame, DRAWN)[0][1])
        for s, t in enumerate(final):
            tables, own, above = (x.astype(np.int64) for x in drawn[3 * s : 3 * s + 3])
            own, above = own.astype(np.float64), above.astype(np.float64)
            for at, (n, others, under) in zip(*cut_words(word, t["cut"]), strict=True):
                known[at], own[at], above[at] = n, others, under
            share = predictive(own, above, t["customers"], t["tables"], 1 / (t["v"] + 1), t["above"])
            laid = (count > 0).astype(np.float64)
            laid[active] = tables
            mean = mean + predictive(count, laid, customers[context], (types + extras[s])[context], share[of_word], t["discount"])
        logs = np.log10(mean / len(final)).astype("<f4").view("<u4")
        known = known[of_word]
        out = []
        for src, p in _of(frame, PLACES):
            at = np.cumsum(unpack(p)[0].astype(np.int64))
            out.append((src, ANSWER, k, pack((logs[at], 4), (known[at], bytes_for(known[at])))))
        return out

    places = of(first, PLACES).select(F.col("src").alias("to"), "kind", F.col("to").alias("src"), "payload")
    answers = _step(n_shards, answer, of(first, STATE, KEPT), places, sizes, as_extra(last), of(drawn, DRAWN))

    def gather(k, frame):
        frame = frame.sort_values(["kind", "src"])
        ids, null, held_out, tokens, each, doc, times = unpack(_of(frame, KEPT)[0][1])
        logs, counts = (np.concatenate(x) for x in zip(*(unpack(p) for _, p in _of(frame, ANSWER)), strict=True))
        n, pair = len(ids), np.repeat(np.arange(len(each)), each.astype(np.int64))
        doc, times, logs = doc.astype(np.int64), times.astype(np.float64), logs.astype("<u4").view("<f4").astype(np.float64)
        counts = counts.astype(np.float64)
        sums = [np.bincount(doc, x[pair] * times, n) for x in (logs, np.log10(counts + 1), counts > 0)]
        return pd.DataFrame({"doc_id": pd.array([None if z else i for i, z in zip(ids.view(np.int64).tolist(), null.tolist(), strict=True)], "Int64"), "held_out": held_out.astype(bool), "n_tokens": tokens.astype(np.int64), "n_known": sums[2].astype(np.int64), "base": sums[1], "score": sums[0]})

    whole = answers.where("to < 0").repartition(n_shards, "to").groupBy("to").applyInPandas(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    base = F.col("base") - F.col("n_tokens") * math.log10(totals["n"] + totals["v"] + 1)
    out = stored(whole.select(F.col("doc_id").alias(key), "held_out", "n_tokens", "n_known", F.lit(totals["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")))
    discard(first, sizes, drawn, last)
    return out


def _bounds(docs: DataFrame, size: int, n_shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n_shards - 1 bounds (word, context), 48 bits each, at quantiles of a sample of pairs."""

    def some(batches):
        of = Hasher()
        for part in chunks(batches, "text", CHUNK_BYTES):
            chunk = Chunk(*of(texts_of(part.column("text")).cast(pa.binary()).to_pylist()), np.zeros(part.num_rows, bool))
            yield pa.RecordBatch.from_arrays([pa.array((chunk.word >> np.uint64(16)).view(np.int64)[::SAMPLE_PAIRS]), pa.array(chunk.context.view(np.int64)[::SAMPLE_PAIRS])], names=["word", "context"])

    taken = docs if size <= SAMPLE_BYTES else docs.sample(SAMPLE_BYTES / size, seed)
    found = mapped(taken.select("text"), some, "word long, context long").toArrow()
    word, context = (found.column(c).to_numpy().astype(np.uint64) for c in ("word", "context"))
    if len(word) < n_shards:
        return np.arange(1, n_shards, dtype=np.uint64) * np.uint64((1 << 48) // n_shards), np.zeros(n_shards - 1, np.uint64)
    at = np.lexsort((context, word))[np.arange(1, n_shards) * len(word) // n_shards]
    return word[at], context[at]


def _customers(shard: Shard, key: int, cuts: np.ndarray, sample: int) -> list[tuple]:
    """The parent's customers, its tables but for those of cut words, and the customers of these, for the driver."""
    own = shard.own_customers()
    tables = np.zeros(len(shard.word), np.int64)
    tables[shard.dishes] = shard.parent.tables
    cut = np.isin(shard.word >> np.uint64(16), cuts)
    rows = [(0, COUNTS, key, pack((np.array([sample, int(own.sum()), int(tables[~cut].sum())]), 8)))]
    return rows + [(0, CUT, key, pack((np.array([w], np.uint64), 8), (np.array([sample, n]), 8))) for w, n in zip(shard.word[cut].tolist(), own[cut].tolist(), strict=True)]


def _totals(first: DataFrame, later: DataFrame | None = None, sample: int = 0) -> dict:
    """n, v, pairs, customers and tables of the parent, the discounts, and for cut words (those of bounds, so as many as
    shards at most) what all shards hold: training tokens and the parent's customers, then its tables, drawn here."""
    pick = lambda t, kind: [[c.tolist() for c in unpack(bytes(r.payload))] for r in t.where(F.col("kind") == kind).select("payload").collect()]
    counts = [sum(x) for x in zip(*(c for c, in pick(first, COUNTS)), strict=True)] or [0] * 7
    cut: dict = {}
    for (w,), (n, k) in pick(first, CUT):
        a, b = cut.get(w, (0, 0))
        cut[w] = (a + n, b + k)
    ratio = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5
    v = counts[1] + sum(n > 0 for n, _ in cut.values())
    out = {"n": counts[0], "v": v, "pairs": counts[2], "discount": ratio(*counts[3:5]), "above": ratio(*counts[5:7]), "customers": counts[2], "tables": v, "cut": cut}
    if later is None:
        return out
    sums = [c for c, in pick(later, COUNTS) if c[0] == sample]
    out |= {"customers": sum(n for _, n, _ in sums), "tables": sum(t for _, _, t in sums)}
    held: dict = {}
    for (w,), (s, n) in pick(later, CUT):
        if s == sample:
            held[w] = held.get(w, 0) + n
    words = [w for w in sorted(held) if held[w]]
    base = (STRENGTH + out["above"] * (out["tables"] + len(words))) / (v + 1)
    tables, _ = arrangement(np.array([held[w] for w in words], np.int64), np.full(len(words), base), out["above"], np.random.default_rng(sample))
    under = dict(zip(words, tables.tolist(), strict=True))
    out["tables"] += sum(under.values())
    out["cut"] = {w: (cut[w][0], n, under.get(w, 0)) for w, n in held.items()}
    return out
