"""Dependency parsers against all trees of short sentences."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import arcs
from quillon.operators import dependency


def is_tree(heads):
    if heads.count(0) != 1:
        return False
    for v in range(1, len(heads) + 1):
        seen = set()
        while v:
            if v in seen:
                return False
            seen.add(v)
            v = heads[v - 1]
    return True


def is_projective(heads):
    spans = [tuple(sorted((h, d))) for d, h in enumerate(heads, 1) if h]
    if any(a < c < b < d for (a, b), (c, d) in itertools.permutations(spans, 2)):
        return False
    root = heads.index(0) + 1
    return not any(a < root < b for a, b in spans)


TREES = {n: [h for h in itertools.product(range(n + 1), repeat=n) if is_tree(h)] for n in range(1, 7)}


@pytest.mark.parametrize("n", range(1, 7))
def test_best_trees_equal_those_among_all_trees(n):
    rng = np.random.default_rng(n)
    assert len(TREES[n]) == n ** (n - 1)
    scores = rng.standard_normal((25, n + 1, n + 1))
    scores[20:] = rng.integers(0, 3, (5, n + 1, n + 1))  # ties
    heads, total = arcs.projective(scores)
    every, at = np.array(TREES[n]), np.arange(1, n + 1)
    flat = np.array([is_projective(h) for h in TREES[n]])
    for k, s in enumerate(scores):
        sums = s[every, at].sum(1)
        assert total[k] == pytest.approx(sums[flat].max())
        assert is_tree(heads[k].tolist()) and is_projective(tuple(heads[k])) and s[heads[k], at].sum() == pytest.approx(total[k])
        any_heads, any_total = arcs.spanning(s)
        assert any_total == pytest.approx(sums.max()) and is_tree(any_heads.tolist())


def test_seven_words():
    rng = np.random.default_rng(7)
    every = np.stack(np.meshgrid(*[np.arange(8)] * 7, indexing="ij"), -1).reshape(-1, 7)
    every = every[(every == 0).sum(1) == 1]
    up = np.concatenate([np.zeros((len(every), 1), int), every], 1)
    reach = np.tile(np.arange(8), (len(every), 1))
    for _ in range(7):
        reach = np.take_along_axis(up, reach, 1)
    every = every[(reach == 0).all(1)]
    assert len(every) == 7**6
    flat = np.array([is_projective(tuple(h)) for h in every.tolist()])
    for _ in range(3):
        s = rng.standard_normal((8, 8))
        sums = s[every, np.arange(1, 8)].sum(1)
        assert arcs.projective(s[None])[1][0] == pytest.approx(sums[flat].max())
        assert arcs.spanning(s)[1] == pytest.approx(sums.max())


def test_long_sentences_agree_where_trees_are_projective():
    rng = np.random.default_rng(8)
    for n in (30, 90):
        s = rng.standard_normal((n + 1, n + 1)) * 0.1
        for d in range(1, n + 1):
            s[d - 1, d] += 5  # a chain is best by far
        heads, total = arcs.projective(s[None])
        assert heads[0].tolist() == list(range(n)) == arcs.spanning(s)[0].tolist()
        assert total[0] == pytest.approx(arcs.spanning(s)[1])


def test_arc_table_and_parses(spark):
    rows = [("a b c", "DT NN VB", "1\ta\tDT\t2\tdep\n2\tb\tNN\t3\tdep\n3\tc\tVB\t0\tROOT"), ("a b c d e", "DT NN VB DT NN", "1\ta\tDT\t2\tdep\n2\tb\tNN\t3\tdep\n3\tc\tVB\t0\tROOT\n4\td\tDT\t5\tdep\n5\te\tNN\t3\tdep")]
    df = spark.createDataFrame([(w.split(), t.split(), x) for w, t, x in rows], "words array<string>, tags array<string>, parse_str string")
    counts = {tuple(r)[:4]: r.n for r in dependency.count_arcs(df).collect()}
    assert counts == {("NN", "DT", -1, 1): 3, ("VB", "NN", -1, 1): 2, ("ROOT", "VB", 0, 0): 2, ("VB", "NN", 1, 2): 1}
    scores = dependency.arc_scores(dependency.count_arcs(df))
    for projective in (True, False):
        got = dependency.parse_arcs(df.select("words", "tags", F.lit(1).alias("score")), scores, projective=projective)
        assert {r.parse_str for r in got.collect()} == {x for _, _, x in rows}
    odd = spark.createDataFrame([([], []), (None, None), (["x"] * 200, ["NN"] * 200), (["new"], ["??"])], "words array<string>, tags array<string>")
    found = dependency.parse_arcs(odd, scores).collect()
    assert sorted(r.status for r in found) == ["empty", "empty", "ok", "too_long"]
    assert [r.parse_str for r in found if r.status == "ok"] == ["1\tnew\t??\t0\tROOT"]
    assert dependency.parse_arcs(odd.limit(0), scores).count() == 0


def test_sentences_of_like_length_share_a_chart():
    rng = np.random.default_rng(9)
    for n, beyond in ((1, 3), (5, 1), (9, 4)):
        own = rng.integers(-2, 3, (20, n + 1, n + 1)).astype(float)
        padded = rng.standard_normal((20, n + beyond + 1, n + beyond + 1)) * 50
        padded[:, : n + 1, : n + 1] = own
        heads, total = arcs.projective(own)
        found, score = arcs.projective(padded, np.full(20, n))
        assert (found[:, :n] == heads).all() and not found[:, n:].any() and (score == total).all()
        assert arcs.projective(padded, np.full(20, n), trees=False)[0] is None
        assert (arcs.projective(padded, np.full(20, n), trees=False)[1] == total).all()


def test_arc_table_by_numbers():
    scores = {("ROOT", "A", 0, 0): 3.0, ("A", "B", 1, 1): 1.0, ("A", "B", 1, dependency.FAR): 2.0, ("B", "A", -1, 2): 4.0, (None, "B", 0, 0): -7.0}
    table = dependency.ArcTable(scores)
    tags = ["A", "B", "?", "A", "B", "A", "B"]
    found = table.scored(np.array([[table.numbers.get(t, table.other) for t in tags]]))[0]
    for d, tag in enumerate(tags, 1):
        new = scores.get((None, tag, 0, 0), -20.0)
        assert found[0, d] == scores.get(("ROOT", tag, 0, 0), new)
        for h, head in enumerate(tags, 1):
            assert found[h, d] == scores.get((head, tag, 1 if d > h else -1, min(abs(d - h), dependency.FAR)), new)


def test_lines_of_odd_sentences(spark):
    said = [(["a", None, "c"], ["X", "Y", "X"]), (None, ["X"]), (["a", "b"], ["X"]), (["a"], ["X", "X"]), (["a", "b", "c"], ["X", None, "X"])]
    df = spark.createDataFrame([(k, w, t) for k, (w, t) in enumerate(said)], "k int, words array<string>, tags array<string>").coalesce(1)
    scores = {("ROOT", "X", 0, 0): 1.0, ("X", "X", 1, 1): 1.0}
    found = {r.k: r for r in dependency.parse_arcs(df, scores).collect()}
    assert [len(x.split("\t")) for x in found[0].parse_str.split("\n")] == [5, 4, 5] and found[1].parse_str is found[2].parse_str is None
    assert found[3].parse_str == "1\ta\tX\t0\tROOT" and [len(x.split("\t")) for x in found[4].parse_str.split("\n")] == [5, 4, 5]
    assert {r.status for r in found.values()} == {"ok"}
    plain = dependency.parse_arcs(df, scores, lines=False)
    assert plain.columns == ["k", "words", "tags", "score", "status"] and {r.k: r.score for r in plain.collect()} == {k: r.score for k, r in found.items()}
