"""Tree columns: decoding, motifs and sentence types over many rows."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillon import schemas
from quillon.functions import trees
from quillon.functions.forest import LIMIT, Forest, outline, words

#: Sums of different (key, pattern) that a task keeps before it hands them on.
SUMS = 200_000


def parse_tree(text: Column | str) -> Column:
    """The tree as an array in pre-order, words as entries of their own; null if malformed."""
    kinds = [*((n, pa.int32()) for n in ("pre", "post", "depth", "parent", "ord")), ("label", pa.string()), ("word", pa.string())]

    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [_lists([trees.nodes(t) for t in batch[k : k + 1_000].to_pylist()]) for k in range(0, len(batch), 1_000)]
            yield pa.concat_arrays(parts) if parts else _lists([])

    def _lists(found: list[list[tuple] | None]) -> pa.Array:
        ends = list(itertools.accumulate((len(f or ()) for f in found), initial=0))
        offsets = pa.array([None if f is None else e for f, e in zip([*found, ()], ends, strict=True)], pa.int32())
        columns = list(zip(*itertools.chain.from_iterable(f or () for f in found), strict=True)) or [()] * len(kinds)
        nodes = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])
        return pa.ListArray.from_arrays(offsets, nodes)

    return F.arrow_udf(decoded, schemas.NODES)(text)


def _types(batches, limit: int = LIMIT):
    """Types of trees by their outlines(), each of which is looked at once until those remembered take `limit` bytes."""
    forest, known, size = Forest(most=1), {}, 0
    for text in batches:
        if size + forest.size > limit:
            forest, known, size = Forest(most=1), {}, 0
        found = []
        for t in text.to_pylist():
            key = None if t is None else outline(t)
            pair = known.get(key)
            if pair is None:
                root = None if key is None else forest.root(key)
                pair = known[key] = (schemas.ERROR, schemas.ERROR) if root is None else forest.types(root)
                size += 150 + len(key or "")
            found.append(pair)
        yield pa.StructArray.from_arrays([pa.array([p[k] for p in found], pa.string()) for k in range(2)], ["feng_algo_1", "feng_algo_2"])


def _pretty(text: pd.Series) -> pd.Series:
    return text.map(trees.pretty)


def pretty(text: Column | str) -> Column:
    """For debugging: the tree with one label for each line."""
    return F.pandas_udf(_pretty, "string")(text)


def classify(parses: DataFrame, parse: str = "parse_str") -> DataFrame:
    """parses with feng_algo_1 and feng_algo_2, from a forest in each task, where equal subtrees are looked at once."""

    def types(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _types(batches)

    found = F.arrow_udf(types, "struct<feng_algo_1:string,feng_algo_2:string>")(parse)
    return parses.withColumn("_t", found).select(*parses.columns, "_t.feng_algo_1", "_t.feng_algo_2")


def error_count(typed: DataFrame) -> DataFrame:
    """n_rows and n_error: rows whose tree could not be classified."""
    return typed.agg(F.count("*").alias("n_rows"), F.count_if(F.col("feng_algo_1") == schemas.ERROR).alias("n_error"))


def type_1(nodes: Column) -> Column:
    """Type I of a decoded tree, as an expression."""
    top = lambda label: F.exists(nodes, lambda m: (m["depth"] == 1) & (m["label"] == label))
    dependent = F.exists(nodes, lambda m: m["label"] == "SBAR")
    named = F.when(top("S"), F.when(dependent, "COMPLEX-COMPOUND").otherwise("COMPOUND")).when(top("VP"), F.when(dependent, "COMPLEX").otherwise("SIMPLE")).otherwise("OTHER")
    return F.when(nodes.isNull(), schemas.ERROR).otherwise(named)


def type_2(nodes: Column) -> Column:
    """Type II of a decoded tree: the first child of the root that holds a clause decides."""
    holds = lambda m: F.exists(F.slice(nodes, m["pre"] + 1, m["post"] - m["pre"] + 1), lambda k: k["label"].isin("S", "SBAR"))
    first = F.get(F.filter(nodes, lambda m: (m["depth"] == 1) & m["label"].isNotNull() & holds(m)), F.lit(0))
    named = F.when(first.isNull(), "OTHER").when(first["label"] == "VP", "LOOSE").otherwise("PERIODIC")
    return F.when(nodes.isNull(), schemas.ERROR).otherwise(named)


def node_motifs(nodes: str = "nodes", most: int = 4, least: int = 2, min_terminals: int = 2) -> Column:
    """array<struct<pattern, words>> of a decoded tree, without Python: a node's subtree is a slice of the array."""
    return F.expr(f"""
        filter(flatten(transform(filter({nodes}, n -> n.label IS NOT NULL), n ->
            transform(sequence({least}, {most}), d -> named_struct('pattern',
                aggregate(filter(slice({nodes}, n.pre + 1, n.post - n.pre + 1), m -> m.label IS NOT NULL AND m.depth < n.depth + d),
                    named_struct('s', '', 'depth', n.depth - 1),
                    (a, m) -> named_struct('s', a.s || CASE WHEN a.s = '' THEN '' ELSE repeat(')', a.depth - m.depth + 1) || ' ' END || '(' || m.label, 'depth', m.depth),
                    a -> a.s || repeat(')', a.depth - n.depth + 1)),
                'words', array_join(transform(filter(slice({nodes}, n.pre + 1, n.post - n.pre + 1), m -> m.word IS NOT NULL), m -> m.word), ' '))))),
            x -> size(regexp_extract_all(x.pattern, r'\\([A-Z$][A-Z0-9$-]*\\)', 0)) >= {min_terminals})""")


def motifs(parses: DataFrame, parse: str = "parse_str", most: int = 4, least: int = 2, min_terminals: int = 2, wanted: frozenset[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """A row for each motif of each tree: the row's other columns, pattern, words, place (order within the tree).
    wanted: only these patterns leave the worker, and subtrees without any are stepped over. A task's forest of different
    subtrees takes some `limit` bytes."""
    keep = [c for c in parses.columns if c not in ("pattern", "words", "place")]

    def run(batches):
        forest = Forest(most, least, min_terminals, wanted)
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(parse).to_pylist()):
                root = forest.root(text) if text is not None else None
                if root is not None and forest.hit[root]:
                    own = list(forest.hits(root))
                    said = words(text)
                    rows += [k] * len(own)
                    found += [(motif, " ".join(said[a:b]), i) for i, motif, a, b in own]
                if forest.size > limit:
                    forest = Forest(most, least, min_terminals, wanted)
            at = pa.array(rows, pa.int32())
            pattern, said, place = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array(pattern, pa.string()), pa.array(said, pa.string()), pa.array(place, pa.int32())], names=[*keep, "pattern", "words", "place"])

    return parses.mapInArrow(run, T.StructType([*parses.select(keep).schema.fields, *T.StructType.fromDDL("pattern string, words string, place int").fields]))


def summed_motifs(parses: DataFrame, keys: list[str], parse: str = "parse_str", most: int = 4, least: int = 2, min_terminals: int = 2, limit: int = LIMIT) -> DataFrame:
    """keys, pattern, words, cnt: what motifs() gives, summed within each task before it leaves the worker; a row may come
    more than once. A pattern that is cut alike at several depths has its words put together once. The forest and the sums
    take some `limit` bytes each."""

    def run(batches):
        forest, seen, size = Forest(most, least, min_terminals), {}, 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            for *key, text in zip(*columns, batch.column(parse).to_pylist(), strict=True):
                root = forest.root(text) if text is not None else None
                if root is None or not forest.hit[root]:
                    continue
                said, at = words(text), None
                for _, motif, a, b in forest.hits(root):
                    if at != (a, b):
                        at, spoken = (a, b), " ".join(said[a:b])
                    row = (*key, motif, spoken)
                    if row in seen:
                        seen[row] += 1
                    else:
                        seen[row] = 1
                        size += 350 + len(motif) + len(spoken)
                if forest.size > limit:
                    forest = Forest(most, least, min_terminals)
                if size > limit:
                    yield from _rows(seen)
                    seen, size = {}, 0
        yield from _rows(seen)

    def _rows(seen):
        rows = list(seen)
        for k in range(0, len(rows), 10_000):
            columns = [*zip(*rows[k : k + 10_000], strict=True), [seen[r] for r in rows[k : k + 10_000]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    schema = T.StructType([*parses.select(*keys).schema.fields, *T.StructType.fromDDL("pattern string, words string, cnt long").fields])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    kinds = to_arrow_schema(schema)
    return parses.select(*keys, parse).mapInArrow(run, schema)


def first_motifs(parses: DataFrame, keys: list[str], order: list[str], n: int, parse: str = "parse_str", sentence: str = "sent_text", most: int = 4, least: int = 2, min_terminals: int = 2, wanted: frozenset[str] | None = None, limit: int = LIMIT, flush: int = SUMS) -> DataFrame:
    """keys, pattern, words, order and sentence: for each task the first n motifs with different words of each key and
    pattern. Words that aren't among a task's first n can't be among the first n of all, so what a task hands on merges, and
    it is at most n rows for each key and pattern (more only if a task has over `flush` of these). `order` may name `place`,
    the motif's place in its tree; nulls come first, equal places go by words."""
    at = [c for c in order if c != "place"]

    def run(batches):
        forest, kept = Forest(most, least, min_terminals, wanted), {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, *at, sentence, parse)]
            for row in zip(*columns, strict=True):
                text = row[-1]
                root = forest.root(text) if text is not None else None
                if root is None or not forest.hit[root]:
                    continue
                key, values = row[: len(keys)], dict(zip(at, row[len(keys) :], strict=False))
                said = None
                for place, motif, a, b in forest.hits(root):
                    values["place"] = place
                    here = tuple([(values[c] is not None, values[c]) for c in order])
                    own = kept.setdefault((key, motif), {})
                    if len(own) == n and here > max(own.values())[0]:
                        continue
                    if said is None:
                        said = words(text)
                    spoken = " ".join(said[a:b])
                    new = (here, spoken, row[-2])
                    if spoken in own:
                        own[spoken] = min(own[spoken], new)
                    elif len(own) < n:
                        own[spoken] = new
                    elif new < (last := max(own.values())):
                        del own[last[1]]
                        own[spoken] = new
                if forest.size > limit:
                    forest = Forest(most, least, min_terminals, wanted)
            if len(kept) > flush:
                yield from _rows(kept)
                kept = {}
        yield from _rows(kept)

    def _rows(kept):
        rows = [(*key, motif, spoken, *(v for _, v in here), sentence_) for (key, motif), own in kept.items() for here, spoken, sentence_ in own.values()]
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 10_000], strict=True), schema, strict=True)], schema=schema)

    kinds = dict(zip(parses.columns, parses.schema.fields, strict=True))
    fields = [*(kinds[k] for k in keys), T.StructField("pattern", T.StringType()), T.StructField("words", T.StringType()), *(T.StructField("place", T.IntegerType()) if c == "place" else kinds[c] for c in order), kinds[sentence]]
    fields = [T.StructField(f.name, f.dataType, True) for f in fields]
    schema = to_arrow_schema(T.StructType(fields))
    return parses.select(*dict.fromkeys([*keys, *at, sentence, parse])).mapInArrow(run, T.StructType(fields))


def partial_counts(parses: DataFrame, keys: list[str], parse: str = "parse_str", most: int = 4, least: int = 2, min_terminals: int = 2, limit: int = LIMIT, flush: int = SUMS) -> DataFrame:
    """keys, pattern, cnt: summed within each task before anything is shuffled. A task only notes how often it has seen each
    tree under each key; when its forest reaches `limit` bytes or the notes `flush` entries, the numbers are carried down
    the forest, and it hands on the sums and starts anew."""

    def run(batches):
        forest, seen = Forest(most, least, min_terminals), {}
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            for *key, text in zip(*columns, batch.column(parse).to_pylist(), strict=True):
                root = forest.root(text) if text is not None else None
                if root is not None:
                    own = seen.get(tuple(key))
                    if own is None:
                        own = seen[tuple(key)] = Counter()
                    own[root] += 1
                if forest.size > limit:
                    yield from _rows(forest, seen)
                    forest, seen = Forest(most, least, min_terminals), {}
            if sum(map(len, seen.values())) > flush:
                yield from _rows(forest, seen)
                seen = {}
        yield from _rows(forest, seen)

    def _rows(forest, seen):
        for key, roots in seen.items():
            own = forest.sums(roots)
            columns = [pa.array([k] * len(own), t) for k, t in zip(key, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([forest.patterns[m] for m in own], pa.string()), pa.array(list(own.values()), pa.int64())], names=[*keys, "pattern", "cnt"])

    kinds = [{"int": pa.int32(), "bigint": pa.int64()}.get(dict(parses.dtypes)[k], pa.string()) for k in keys]
    schema = T.StructType([*parses.select(*keys).schema.fields, *T.StructType.fromDDL("pattern string, cnt long").fields])
    return parses.select(*keys, parse).mapInArrow(run, schema)
