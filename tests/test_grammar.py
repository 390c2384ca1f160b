"""The chart parser against all derivations of short sentences."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.functions import chart
from quillon.functions.chart import Grammar
from quillon.functions.forest import Forest
from quillon.operators import grammar


def random_grammar(rng):
    """Binary rules between any symbols, and rules of one part that only go from A to B to C, so chains end."""
    rules = []
    for k, a in enumerate("SABC"):
        own = [(a, rng.choice("SABCxyz"), rng.choice("SABCxyz")) for _ in range(3)]
        own += [(a, t, None) for t in rng.sample("xyz", 2)] + [(a, b, None) for b in "SABC"[k + 1 :] if rng.random() < 0.5]
        share = [rng.random() + 0.05 for _ in own]
        rules += [(*r, p / sum(share)) for r, p in zip(dict.fromkeys(own), share, strict=False)]
    return rules


def derivations(rules, symbol, tags):
    """(probability, tree, rules used) of everything that `symbol` can become."""
    if len(tags) == 1 and symbol == tags[0]:
        yield 1.0, "w", Counter()
    for a, b, c, p in rules:
        if a != symbol:
            continue
        if c is None:
            for q, t, used in derivations(rules, b, tags):
                yield p * q, f"({a} {t})", used + Counter([(a, b, c)])
        else:
            for k in range(1, len(tags)):
                for q, t, one in derivations(rules, b, tags[:k]):
                    for r, u, two in derivations(rules, c, tags[k:]):
                        yield p * q * r, f"({a} {t} {u})", one + two + Counter([(a, b, c)])


@pytest.mark.parametrize("seed", range(12))
def test_charts_equal_all_derivations(seed):
    rng = random.Random(seed)
    rules = random_grammar(rng)
    g = Grammar(rules)
    for n in (1, 2, 3, 4):
        tags = [rng.choice("xyz") for _ in range(n)]
        if any(t not in g.numbers for t in tags):
            continue
        at = np.array([[g.numbers[t] for t in tags]] * 2)
        every = list(derivations(rules, "S", tags))
        total = sum(p for p, _, _ in every)
        inside, (best, charts) = chart.inside(g, at)[0], chart.best(g, at)
        if not every:
            assert not np.isfinite(best).any() and not np.isfinite(inside).any()
            continue
        assert inside == pytest.approx(math.log(total))
        top = max(p for p, _, _ in every)
        assert best == pytest.approx(math.log(top))
        said = re.sub(r"\(([xyz]) w\)", "w", chart.tree(g, charts, 1, ["w"] * n))
        assert said in {t for p, t, _ in every if p == pytest.approx(top)}
        binary, unary, log = chart.expected(g, at, np.array([2.0, 1.0]))
        want = Counter()
        for p, _, used in every:
            for r, k in used.items():
                want[r] += 3 * p * k / total
        assert log == pytest.approx(3 * math.log(total))
        for (a, b, c, _), x in zip(g.binary, binary, strict=True):
            assert x == pytest.approx(want[g.names[a], g.names[b], g.names[c]], abs=1e-9)
        for a, b in zip(*np.nonzero(g.unary), strict=True):
            assert unary[a, b] == pytest.approx(want[g.names[a], g.names[b], None], abs=1e-9)


TREES = ["(S (NP (DT the) (JJ old) (JJ red) (NN cat)) (VP (VBD sat)) (. .))", "(S (NP (DT the) (NN cat)) (VP (VBD saw) (NP (DT a) (NN dog))))", "(S (NP (NN cats)) (VP (VBD saw) (NP (NN dogs)) (PP (IN with) (NP (NN eyes)))))", "(FRAG)", None, "(S"]


@pytest.fixture
def treebank(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(TREES)], "k int, parse_str string, status string")


def test_rules_and_parsing(spark, treebank):
    rules = {(r.lhs, r.rhs): r.n for r in grammar.count_rules(treebank).collect()}
    assert rules["NP", "DT NN"] == 2 and rules["NP", "NN"] == 3 and rules["NP", "DT JJ JJ NN"] == 1 and ("NN", "w") not in rules
    binary = {(r.lhs, r.left, r.right): r.n for r in grammar.binarised(grammar.count_rules(treebank)).collect()}
    assert binary["NP", "DT", "@NP"] == 1 and binary["@NP", "JJ", "@NP"] == 1 and binary["@NP", "JJ", "NN"] == 1 and binary["NP", "NN", None] == 3
    g = grammar.estimated(grammar.binarised(grammar.count_rules(treebank)))
    tree = F.col("parse_str")
    rows = [("the cat saw dogs", "DT NN VBD NN"), ("cats saw the old old old dog .", "NN VBD DT JJ JJ JJ NN ."), ("", ""), ("a " * 200, "DT " * 200), ("what ?", "WP ?"), ("the", "DT")]
    df = spark.createDataFrame([(w.split(), t.split(), "mine") for w, t in rows], "words array<string>, tags array<string>, score string").repartition(2)
    found = {" ".join(r.words): r for r in grammar.parse(df, g).collect()}
    assert found["the cat saw dogs"].parse_str == "(S (NP (DT the) (NN cat)) (VP (VBD saw) (NP (NN dogs))))"
    assert found["cats saw the old old old dog ."].status == "ok" and "@" not in found["cats saw the old old old dog ."].parse_str
    assert [found[k].status for k in ("", ("a " * 200).strip(), "what ?", "the")] == ["empty", "too_long", "no_parse", "no_parse"]
    own = treebank.where("k < 3").select("k", grammar.leaf_words(tree).alias("words"), grammar.leaf_tags(tree).alias("tags"))
    assert {r.k: r.parse_str for r in grammar.parse(own, g).collect()} == dict(enumerate(TREES[:3]))
    assert grammar.parse(df.limit(0), g).count() == 0


def test_inside_outside_climbs(spark):
    rng = random.Random(4)
    said = [["DT", "NN", "VB"] + (["DT", "NN"] if rng.random() < 0.5 else []) + (["IN", "NN"] if rng.random() < 0.3 else []) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in said], "tags array<string>").repartition(3)
    rules = [(a, b, c, rng.random()) for a in "SXY" for b in ("S", "X", "Y", "DT", "NN", "VB", "IN") for c in ("X", "Y", "NN", "VB")] + [(a, t, None, rng.random()) for a in "XY" for t in ("NN", "VB", "DT", "IN")]
    total = Counter()
    for r in rules:
        total[r[0]] += r[3]
    g = Grammar([(a, b, c, p / total[a]) for a, b, c, p in rules])
    logs = []
    for _ in range(6):
        g, log = grammar.reestimated(df, g)
        logs.append(log)
    assert all(b >= a - 1e-6 for a, b in zip(logs, logs[1:], strict=False)) and logs[-1] > logs[0] + 50
    for a in {r[0] for r in g.rules()}:
        assert sum(p for b, _, _, p in g.rules() if b == a) == pytest.approx(1)


def test_node_counts_of_a_forest():
    forest = Forest(most=1)
    one, two = forest.root("(S (A x) (A y))"), forest.root("(S (S (A x) (A y)) (B z))")
    assert {forest.labels[k]: n for k, n in forest.times(Counter({one: 2, two: 3})) if forest.labels[k] in "AB"} == {"A": 10, "B": 3}


@pytest.mark.parametrize("seed", range(6))
def test_totals_equal_whole_charts(seed):
    g = Grammar(random_grammar(random.Random(seed)))
    rng = np.random.default_rng(seed)
    own = [g.numbers[t] for t in "xyz" if t in g.numbers]
    for n in (1, 2, 5, 9):
        tags = rng.choice(own, (20, n))
        inside, best = chart.totals(g, tags)
        np.testing.assert_allclose(inside, chart.inside(g, tags)[0], rtol=1e-9)
        np.testing.assert_allclose(best, chart.best(g, tags)[0], rtol=1e-9)


def test_scores_of_odd_sentences(spark):
    g = Grammar([("S", "A", "S", 0.5), ("S", "A", None, 0.5), ("A", "x", None, 1.0)])
    rows = [["x"], ["x", "x"], ["x", "?"], [], None, ["x"] * 200, [None]]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, tags array<string>").coalesce(1)
    found = {r.k: r.inside for r in grammar.scores(df, g).collect()}
    assert [found[k] is None for k in range(7)] == [False, False, True, True, True, True, True]
    assert found[0] == pytest.approx(math.log(0.5)) and found[1] == pytest.approx(math.log(0.25))


@pytest.mark.parametrize("seed", range(8))
def test_trees_of_unequal_sentences_equal_those_of_single_charts(seed):
    rng = random.Random(seed)
    g = Grammar(random_grammar(rng))
    own = [g.numbers[t] for t in "SABCxyz" if t in g.numbers]
    said = [[rng.choice(own[-3:]) for _ in range(rng.randint(1, 12))] for _ in range(60)] + [[rng.choice(own)] for _ in range(5)]
    rules, seen = chart.Rules(g), []
    for places in chart.alike([len(s) for s in said], g):
        seen += places
        sizes = np.array([len(said[k]) for k in places])
        tags = np.full((len(places), sizes.max()), len(g.names))
        for r, k in enumerate(places):
            tags[r, : sizes[r]] = said[k]
        for k, score, frame in zip(places, *chart.trees(g, rules, tags, sizes), strict=True):
            best, charts = chart.best(g, np.array([said[k]]))
            assert score == best[0]
            words = [f"w{i}" for i in range(len(said[k]))]
            assert (frame and chart.worded(frame, words)) == (chart.tree(g, charts, 0, words) if np.isfinite(score) else None)
    assert sorted(seen) == list(range(len(said)))


def test_parsing_makes_charts_for_many_sentences_at_a_time(spark, treebank, monkeypatch):
    calls = []
    monkeypatch.setattr(chart, "trees", lambda g, r, tags, sizes: calls.append(len(sizes)) or (np.full(len(sizes), -np.inf), [None] * len(sizes)))
    g, plans = Grammar([("S", "x", "y", 0.5), ("S", "x", "S", 0.5)]), []
    frame = spark.createDataFrame([(["w"] * 2, ["x"] * 2)], "words array<string>, tags array<string>")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: plans.append(run) or self)
    grammar.parse(frame, g)
    tags = [[*t] for t in {"".join(rng) for n in (16, 15, 14) for rng in (random.Random(k).choices("xy", k=n) for k in range(300))}]
    out = list(plans[0]([pa.RecordBatch.from_arrays([pa.array([["w"] * len(t) for t in tags]), pa.array(tags)], names=["words", "tags"])]))
    assert out[0].num_rows == len(tags) and sum(calls) == len(tags) and len(calls) <= 3
