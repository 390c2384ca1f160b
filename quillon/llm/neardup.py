"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Equal texts first become one node, by their 128-bit digest. A node's text becomes labelled shingles: SHINGLE consecutive
words with the number of their earlier occurrences. For each of SKETCHES hash functions the PICKED smallest shingles, in
text order, make one key, so a key holds order as well as content; texts that share a key are candidates. Candidates are
compared by the longest common subsequence of their shingle sequences, inside the band that a similarity of SIMILAR
leaves, and are linked if common / (all - common) reaches it. Classes are the connected components of the links.

Of pairs that just reach SIMILAR, (1 - SIMILAR ** PICKED) ** SKETCHES, one in 3,000, share no key (one in 700 at 20
shingles, which have fewer ways to be picked). Texts of up to SHORT shingles take exact keys instead, n - ceil(SIMILAR * n)
+ 1 shingles by hash, as does every text that can be similar to one of them; none of their pairs is lost.

No bucket of a key is expanded into its pairs, whatever its size, and no link inside a bucket is lost:
1. Each node meets one candidate: of the hubs of its buckets, the one with which it shares most keys. The hub is the
   bucket's node whose own buckets are largest, which in a group of edited copies is the least edited one. This joins
   nearly all of every true group.
2. In buckets that still hold several classes, all others meet the hub. Buckets of two texts are settled by that.
3. The texts of the rest meet by an exact prefix filter: of two similar texts of m and n shingles, which have t in common
   at least, each has a common one among its first m - t + 1 (n - t + 1) in any order, here from rare to frequent. Texts
   are dealt to classes of like size, and t follows the sizes of both, so texts that only share a passage don't meet
   unless that passage nearly makes them similar. Every pair of different classes that passes is compared.
Step 3 alone can grow faster than the input: by the number of pairs that reach the similarity nearly but not quite.

Texts move to the comparison sorted behind their hub, which comes once for each PART pairs; the rest carries numbers.

Result: doc_id and class_id, the smallest doc_id of the class. Words: A-Z lower-cased, runs of letters, digits and
non-ASCII characters; a text of fewer than SHINGLE words is one shingle; a text without words (null counts as
empty) is only like an equal text. Rows that share a doc_id each keep their row; a class without any doc_id has a null
class_id. Empty input: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.align import common
from quillon.llm.common import Tables, batch, chunks, mapped, stored, texts_of
from quillon.llm.decontam import words

SHINGLE = 5
SIMILAR = 0.8
SKETCHES = 20
PICKED = 5
#: Pairs whose shorter text has up to so many shingles are found by exact keys.
SHORT = 16
RARITY_BINS = 1 << 18
#: Ratio of the sizes of neighbouring size classes in step 3.
STEP = 1.05
#: Pairs for each copy of a hub's text.
PART = 64
REMEMBERED = 300_000
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_SEEDS = (np.arange(1, SKETCHES + 1, dtype=np.uint64) * _P[0]) ^ _P[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _P[3]
    x = (x ^ (x >> np.uint64(29))) * _P[4]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Shingle hashes of texts; the hashes of words are remembered up to REMEMBERED words."""

    def __init__(self):
        self.hashes: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        said = words(text)
        new = set(said).difference(self.hashes)
        if len(self.hashes) + len(new) > REMEMBERED:
            self.hashes, new = {}, set(said)
        for w in new:
            self.hashes[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(self.hashes.__getitem__, said), np.uint64, len(said))
        n = max(1, len(h) - SHINGLE + 1) if len(h) else 0
        out = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE, len(h))):
            out += h[k : k + n] * _P[k]
        return _mixed(out)


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Each shingle together with the number of its earlier occurrences."""
    order = np.argsort(shingles, kind="stable")
    seen = shingles[order]
    place = np.arange(len(seen))
    starts = np.concatenate([[True], seen[1:] != seen[:-1]])
    count = place - np.maximum.accumulate(np.where(starts, place, 0))
    if not count.any():
        return shingles
    earlier = np.empty(len(seen), np.uint64)
    earlier[order] = count
    return np.where(earlier > 0, _mixed(shingles + earlier * _P[2]), shingles)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCHES keys of a text with at least one shingle."""
    own = labelled(shingles)
    k = min(PICKED, len(own))
    values = _mixed(own ^ _SEEDS[:, None])
    picked = np.argpartition(values, k - 1, axis=1)[:, :k] if k < len(own) else np.broadcast_to(np.arange(k), (SKETCHES, k))
    picked = np.sort(picked, axis=1)
    key = _SEEDS.copy()
    for j in range(k):
        key = _mixed(key * _P[2] + own[picked[:, j]])
    return key.view(np.int64)


def keys_of(shingles: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """The keys of a text with at least one shingle: its sketches if it is longer than SHORT, and if it can be similar to a
    text of SHORT or less, those of its shingles by hash of which two similar texts always share one."""
    n = len(shingles)
    if n * similar > SHORT + 1e-9:
        return sketch(shingles)
    least = np.sort(labelled(shingles))[: n - int(np.ceil(similar * n - 1e-9)) + 1]
    exact = _mixed(least ^ _P[2]).view(np.int64)
    return exact if n <= SHORT else np.concatenate([sketch(shingles), exact])


def needed(a: int, b: int, similar: float) -> int:
    """The least number of common shingles for this similarity."""
    return int(np.ceil(similar / (1 + similar) * (a + b) - 1e-9))


def aligned(a: np.ndarray, b: np.ndarray, similar: float) -> int:
    """The length of the longest common subsequence of two shingle sequences inside the band; exact where it reaches what
    is needed, else a number that doesn't."""
    need = needed(len(a), len(b), similar)
    m = min(len(a), len(b))
    if m < need:
        return 0
    differ = np.flatnonzero(a[:m] != b[:m])
    front = int(differ[0]) if len(differ) else m
    differ = np.flatnonzero(a[len(a) - m + front :][::-1] != b[len(b) - m + front :][::-1])
    back = int(differ[0]) if len(differ) else m - front
    a, b = a[front : len(a) - back], b[front : len(b) - back]
    found = front + back
    if not len(a) or not len(b) or found + len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) < need:
        return found
    return found + common(a, b, -max(0, len(a) - (need - found)), max(0, len(b) - (need - found)))[0]


def _docs(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, digest (128 bits) and text of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).cast("long").alias("doc_id"), F.unhex(F.md5(body)).alias("digest"), body.alias("text"))


def _nodes(keep, docs: DataFrame, similar: float) -> DataFrame:
    """digest, node (a number), doc_id (the smallest), size and keys of each different text; stored."""
    schema = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("size", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        of = Shingler()
        for part in chunks(batches, "text"):
            size, keys, known = [], [], {}
            for d, t in zip(part.column("digest").to_pylist(), texts_of(part.column("text")).to_pylist(), strict=True):
                if d not in known:
                    s = of(t)
                    known[d] = (len(s), keys_of(s, similar) if len(s) else np.empty(0, np.int64))
                size.append(known[d][0])
                keys.append(known[d][1])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32)), pa.array(np.concatenate(keys)))
            yield batch(schema, part.column("digest"), part.column("doc_id"), size, lists)

    found = mapped(docs.select("digest", "doc_id", "text"), run, "digest binary, doc_id long, size int, keys array<long>")
    found = found.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    return keep(found.withColumn("node", F.monotonically_increasing_id()))


def verified(keep, pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Those of the different pairs (a, b) whose texts (node, text) are similar. A text of b comes once for each PART pairs."""
    pairs = keep(pairs.select("a", "b"))
    often = pairs.groupBy("b").agg(F.count("*").alias("n")).where(f"n > {PART}").select(F.col("b").alias("often"), "n")
    pairs = pairs.join(often, pairs["b"] == often["often"], "left").select("a", "b", F.coalesce(F.expr(f"pmod(xxhash64(a), n div {PART} + 1)"), F.lit(0)).alias("part"))
    rows = pairs.join(texts, pairs["a"] == texts["node"]).select("b", "part", "a", "text")
    hubs = pairs.select("b", "part").distinct()
    hubs = hubs.join(texts, hubs["b"] == texts["node"]).select("b", "part", F.lit(None).cast("long").alias("a"), "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        of, hub, own = Shingler(), None, None
        for piece in chunks(batches, "text"):
            left, right = [], []
            for a, b, t in zip(piece.column("a").to_pylist(), piece.column("b").to_pylist(), piece.column("text").to_pylist(), strict=True):
                if a is None:
                    hub, own = b, of(t)
                    continue
                assert b == hub
                x = of(t)
                if aligned(x, own, similar) >= needed(len(x), len(own), similar):
                    left.append(a)
                    right.append(b)
            yield batch(schema, left, right)

    return keep(mapped(rows.unionByName(hubs).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first()), run, "a long, b long"))


def components(keep, edges: DataFrame) -> DataFrame:
    """node -> label, the smallest node of its component, for all nodes of the edges (a, b): alternating large and small
    stars until each node hangs on one label that hangs on none."""
    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not (now.isEmpty() or _settled(now)):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = keep(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = keep(small)
    return keep(now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))


def _settled(edges: DataFrame) -> bool:
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    return twice.unionByName(edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")).isEmpty()


def _label(df: DataFrame, labels: DataFrame, node: str = "node", out: str = "label") -> DataFrame:
    """df with the label of a node; one that nothing is linked to is its own."""
    labels = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return df.join(labels, df[node] == labels["_n"], "left").withColumn(out, F.coalesce("_l", node)).drop("_n", "_l")


def _merged(keep, labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links (a, b)."""
    edges = _label(_label(links, labels, "a", "a"), labels, "b", "b").select("a", "b")
    more = components(keep, edges)
    nodes = labels.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("label"))).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label")))
    nodes = nodes.groupBy("node").agg(F.min("label").alias("label"))
    more = more.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return keep(nodes.join(more, nodes["label"] == more["_n"], "left").select("node", F.coalesce("_l", "label").alias("label")))


def _possible(pairs: DataFrame, similar: float) -> DataFrame:
    """The pairs whose numbers of shingles m and n don't rule the similarity out."""
    return pairs.where(F.least("m", "n") >= similar * F.greatest("m", "n") - 1e-9)


def _bins(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(RARITY_BINS)).astype(np.int64)


def _frequencies(texts: DataFrame) -> np.ndarray:
    """Number of texts for each bin of labelled shingles, RARITY_BINS at most to the driver."""
    schema = pa.schema([("bin", pa.int32()), ("c", pa.int64())])

    def run(batches):
        of, counts = Shingler(), np.zeros(RARITY_BINS, np.int64)
        for part in chunks(batches, "text"):
            for t in texts_of(part.column("text")).to_pylist():
                np.add.at(counts, _bins(labelled(of(t))), 1)
        seen = np.flatnonzero(counts)
        yield batch(schema, seen.astype(np.int32), counts[seen])

    found = mapped(texts.select("text"), run, "bin int, c long").groupBy("bin").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(RARITY_BINS, np.int64)
    out[found.column("bin").to_numpy()] = found.column("c").to_numpy()
    return out


def size_class(n: int) -> int:
    return math.floor(math.log(n) / math.log(STEP) + 1e-9)


def prefixes(n: int, similar: float) -> list[tuple[int, int]]:
    """For a text of n shingles (partner's size class, length of the prefix) for each class that can be similar."""
    low, high = math.ceil(similar * n - 1e-9), math.floor(n / similar + 1e-9)
    out = []
    for k in range(size_class(max(1, low)), size_class(high) + 1):
        least = max(low, math.ceil(STEP**k - 1e-6), 1)
        if least <= high and (length := n - needed(n, least, similar) + 1) > 0:
            out.append((k, length))
    return out


def _meetings(keep, own: DataFrame, similar: float) -> DataFrame:
    """token, side, place, node, size and label of the prefixes of own (node, size, label, text). A token stands for a
    shingle and two size classes; side: 0 for the smaller class, 1 for the larger, 2 if both are one."""
    shared = own.sparkSession.sparkContext.broadcast(_frequencies(own))
    schema = pa.schema([("token", pa.int64()), ("side", pa.int8()), ("place", pa.int32()), ("node", pa.int64()), ("size", pa.int32()), ("label", pa.int64())])

    def run(batches):
        of = Shingler()
        for part in chunks(batches, "text"):
            columns = [[] for _ in schema]
            for node, label, t in zip(part.column("node").to_pylist(), part.column("label").to_pylist(), texts_of(part.column("text")).to_pylist(), strict=True):
                s = labelled(of(t))
                s = s[np.lexsort((s, shared.value[_bins(s)]))]
                c = size_class(len(s))
                for k, length in prefixes(len(s), similar):
                    salt = np.uint64(min(c, k)) * _P[0] + np.uint64(max(c, k)) * _P[1]
                    values = (_mixed(s[:length] + salt).view(np.int64), 0 if c < k else 1 if c > k else 2, np.arange(length), node, len(s), label)
                    for column, v, field in zip(columns, values, schema, strict=True):
                        column.append(np.broadcast_to(v, length).astype(field.type.to_pandas_dtype()))
            yield batch(schema, *map(np.concatenate, columns))

    return keep(mapped(own.select("node", "label", "text"), run, "token long, side byte, place int, node long, size int, label long"))


def _filtered(keep, rows: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) of different labels that the prefix filter lets through."""
    counted = rows.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.count("*").alias("labels"), F.max(F.struct("c", "label")).alias("x"))
    mixed = counted.where("labels > 1").select("token", F.col("x.label").alias("main"))
    rows = keep(rows.join(mixed, "token"))
    x, y = rows.where("label <> main").alias("x"), rows.drop("main").alias("y")
    # of two rows one at least is outside the token's main class; where both are, the pair counts once
    pairs = x.join(y, "token").where(f"""x.label <> y.label AND (y.label = x.main OR x.node < y.node) AND (x.side = 2 OR x.side <> y.side)
        AND least(x.size, y.size) >= {similar!r}D * greatest(x.size, y.size) - 1e-9
        AND least(x.size - x.place, y.size - y.place) >= ceil({similar / (1 + similar)!r}D * (x.size + y.size) - 1e-9)""")
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _mixed_buckets(keep, shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, node, size, n, label) of buckets that hold several labels."""
    own = keep(_label(shared, labels))
    keys = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return own.join(keys, "key", "left_semi").select("key", "node", "size", "n", "label")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, digest of the text, and whether the row is of its class's first text (smallest doc_id, then digest)."""
    docs = _docs(df, key, text)
    with Tables() as keep:
        marks = stored(_classes(keep, docs, similar))
    return docs.join(marks, docs["digest"] == marks["own"]).select("doc_id", "class_id", "digest", (F.col("digest") == F.col("first")).alias("is_first"))


def _classes(keep, docs: DataFrame, similar: float) -> DataFrame:
    """own (a digest), class_id and first (the digest of the class's first text)."""
    nodes = _nodes(keep, docs, similar)
    rows = nodes.select("node", "size", F.explode("keys").alias("key"))
    buckets = keep(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = keep(rows.join(buckets, "key").select("key", "node", "size", "n"))
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = keep(shared.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node", "size")).alias("x")).select("key", F.col("x.node").alias("hub"), F.col("x.size").alias("hub_size")))
    stars = shared.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"), F.col("size").alias("m"), F.col("hub_size").alias("n"))
    best = _possible(stars, similar).groupBy("a", "b").agg(F.count("*").alias("shared")).groupBy("a").agg(F.max(F.struct("shared", "b")).alias("x"))
    met = keep(best.select("a", F.col("x.b").alias("b")))
    found = shared.select("node").distinct().join(nodes.select("node", "digest"), "node")
    texts = keep(docs.groupBy("digest").agg(F.first("text").alias("text")).join(found, "digest").select("node", "text"))
    labels = components(keep, verified(keep, met, texts, similar))
    own = _mixed_buckets(keep, shared, labels).join(hubs, "key")
    own = _label(own, labels, "hub", "hub_label").where("label <> hub_label")
    own = _possible(own.select(F.col("node").alias("a"), F.col("hub").alias("b"), F.col("size").alias("m"), F.col("hub_size").alias("n")), similar)
    labels = _merged(keep, labels, verified(keep, own.select("a", "b").distinct().join(met, ["a", "b"], "left_anti"), texts, similar))
    members = keep(_mixed_buckets(keep, shared, labels).where("n > 2").select("node", "size", "label").distinct())
    if not members.isEmpty():
        own = keep(members.join(texts, "node"))
        labels = _merged(keep, labels, verified(keep, _filtered(keep, _meetings(keep, own, similar), similar), texts, similar))
    marks = keep(_label(nodes.select("digest", "node", "doc_id"), labels))
    first = keep(marks.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("x")))
    return marks.join(first, "label").select(F.col("digest").alias("own"), F.col("x.doc_id").alias("class_id"), F.col("x.digest").alias("first"))


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row of df for each class, whole: of the smallest doc_id (a row with an id before those without), and of the
    smallest digest among such."""
    kept = classes(df, key, text, similar).where("is_first").where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = stored(kept.select("digest", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id")).distinct())
    body = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    marks = [f"_{c}_{xxhash.xxh32_hexdigest('|'.join(df.columns))}" for c in ("digest", "id", "no_id")]  # names that df doesn't have
    own = df.withColumns(dict(zip(marks, (body, F.coalesce(F.col(key).cast("long"), F.lit(0)), F.col(key).isNull()), strict=True)))
    kept = kept.toDF(*(f"{m}_kept" for m in marks))
    own = own.join(kept, [own[m] == kept[f"{m}_kept"] for m in marks], "left_semi")
    return own.dropDuplicates(marks).select(*df.columns)
