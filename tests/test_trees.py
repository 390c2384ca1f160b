"""Sentence types, motifs and witnesses against hand-worked trees and a recursive definition."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.functions import trees as T
from quillon.functions.forest import Forest, outline
from quillon.operators import trees

TREES = [
    ("(S (NP (DT The) (NN cat)) (VP (VBD sat)) (. .))", "SIMPLE", "OTHER"),
    ("(S (SBAR (IN If) (S (NP (PRP it)) (VP (VBZ rains)))) (, ,) (NP (PRP we)) (VP (VBP stay)) (. .))", "COMPLEX", "PERIODIC"),
    ("(S (NP (PRP He)) (VP (VBD said) (SBAR (S (NP (PRP he)) (VP (VBD left))))) (. .))", "COMPLEX", "LOOSE"),
    ("(S (S (NP (PRP I)) (VP (VBP run))) (CC and) (S (NP (PRP you)) (VP (VBP walk))))", "COMPOUND", "PERIODIC"),
    ("(FRAG (ADVP (RB Never)) (. .))", "OTHER", "OTHER"),
    ("(TOP (S (NP (PRP I)) (VP (VBP run))))", "COMPOUND", "PERIODIC"),
    ("(SBAR (IN If) (S (NP (PRP it)) (VP (VBZ rains))))", "COMPLEX-COMPOUND", "PERIODIC"),
    ("(NP (NP (DT A) (NN cat)) (SBAR (WHNP (WDT that)) (S (VP (VBD ran)))))", "OTHER", "PERIODIC"),
    ("(SBARQ (WHNP (WP Who)) (SQ (VP (VBD ran))) (. ?))", "OTHER", "OTHER"),
    ("(S)", "OTHER", "OTHER"),
    ("(S (NP the (NN cat)) (VP (VBZ sits)))", "SIMPLE", "OTHER"),
    ("(S (NP", "ERROR", "ERROR"),
    ("", "ERROR", "ERROR"),
    ("(S) (S)", "ERROR", "ERROR"),
    (None, "ERROR", "ERROR"),
]


@pytest.mark.parametrize(("tree", "first", "second"), TREES)
def test_types(tree, first, second):
    assert T.sentence_types(tree) == (first, second)


def test_types_by_expression_agree(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in TREES], "parse_str string")
    rows = trees.classify(df).collect()
    assert [(r.feng_algo_1, r.feng_algo_2) for r in rows] == [(a, b) for _, a, b in TREES]
    nodes = df.select(trees.parse_tree("parse_str").alias("nodes"))
    rows = nodes.select(trees.type_1(F.col("nodes")), trees.type_2(F.col("nodes"))).collect()
    assert [tuple(r) for r in rows] == [(a, b) for _, a, b in TREES]


def test_motifs_of_one_tree():
    found = Counter(m for m, _, _ in T.motifs(TREES[0][0]))
    assert found == {"(NP (DT) (NN))": 3, "(S (NP (DT) (NN)) (VP (VBD)) (.))": 2, "(S (NP) (VP) (.))": 1}


def test_motifs_of_five_trees():
    found = Counter(m for t, _, _ in TREES[:5] for m, _, _ in T.motifs(t))
    assert found["(S (NP (PRP)) (VP (VBP)))"] == 4
    assert found["(S (NP) (VP))"] == 4
    assert found["(NP (DT) (NN))"] == 3


def grown(rng, depth=0):
    label = rng.choice(["S", "NP", "VP", "SBAR", "PP", ",", "NN", "PRP$", "-LRB-"])
    if depth > 5 or rng.random() < 0.3:
        return f"({label} w{rng.randrange(9)})" if rng.random() < 0.9 else f"({label})"
    return f"({label} {' '.join(grown(rng, depth + 1) if rng.random() < 0.9 else 'x' for _ in range(rng.randrange(1, 4)))})"


def recursive(node, depth):
    below = [c for c in node[1] if not isinstance(c, str)]
    if depth == 1 or not below:
        return f"({node[0]})"
    return f"({node[0]} {' '.join(recursive(c, depth - 1) for c in below)})"


def all_motifs(node, words):
    for d in (2, 3, 4):
        motif = recursive(node, d)
        if T.n_terminals(motif) >= 2:
            yield motif, " ".join(words[node[2] : node[3]])
    for c in node[1]:
        if not isinstance(c, str):
            yield from all_motifs(c, words)


def test_random_trees_against_the_recursive_definition(spark):
    rng = random.Random(7)
    texts = [grown(rng) for _ in range(150)]
    want = [Counter(all_motifs(*T.decode(t))) for t in texts]
    for text, w in zip(texts, want, strict=True):
        words = T.decode(text)[1]
        assert Counter((m, " ".join(words[a:b])) for m, a, b in T.motifs(text)) == w
    df = spark.createDataFrame(list(enumerate(texts)), "k int, parse_str string")
    fast = Counter((r.k, r.pattern, r.words) for r in trees.motifs(df).collect())
    exprs = df.select("k", F.explode(trees.node_motifs("nodes")).alias("m")) if "nodes" in df.columns else df.select("k", trees.parse_tree("parse_str").alias("nodes")).select("k", F.explode(trees.node_motifs()).alias("m"))
    slow = Counter((r.k, r.m.pattern, r.m.words) for r in exprs.collect())
    assert fast == slow == Counter({(k, m, w): n for k, c in enumerate(want) for (m, w), n in c.items()})
    counted = {r.pattern: r.n for r in trees.partial_counts(df, ["k"]).groupBy("pattern").agg(F.sum("cnt").alias("n")).collect()}
    total = Counter()
    for c in want:
        for (m, _), n in c.items():
            total[m] += n
    assert counted == total


def grown_to(rng, n):
    """A tree of n words, as sentences have: few labels, so that small subtrees repeat and whole trees don't."""
    if n == 1:
        return f"({rng.choice(['NN', 'DT', 'VB', 'IN'])} w{rng.randrange(1000)})"
    parts = min(n, rng.choice([2, 2, 2, 3]))
    cuts = [0, *sorted(rng.sample(range(1, n), parts - 1)), n]
    return f"({rng.choice(['S', 'NP', 'VP', 'PP'])} {' '.join(grown_to(rng, b - a) for a, b in zip(cuts, cuts[1:], strict=False))})"


def test_forest_counts_long_trees_once_for_each_different_subtree(spark):
    rng = random.Random(11)
    texts = [grown_to(rng, rng.randrange(20, 61)) for _ in range(3000)]
    forest, seen, want = Forest(), Counter(), Counter()
    for t in texts:
        seen[forest.root(t)] += 1
        want.update(m for m, _ in all_motifs(*T.decode(t)))
    assert len(seen) > 2900  # whole trees hardly repeat
    assert {forest.patterns[m]: n for m, n in forest.sums(seen).items()} == want
    assert forest.seen == sum(t.count("(") for t in texts)
    assert len(forest.nodes) * 3 < forest.seen  # patterns are put together for less than a third of the nodes
    df = spark.createDataFrame([(k % 3, t) for k, t in enumerate(texts)], "k int, parse_str string").repartition(2)
    for limits in ({}, {"limit": 2_000_000}, {"flush": 50}):  # however often a task starts anew
        counted = trees.partial_counts(df, ["k"], **limits).groupBy("pattern").agg(F.sum("cnt").alias("n"))
        assert {r.pattern: r.n for r in counted.collect()} == want


def test_wanted_motifs_keep_their_places(spark):
    rng = random.Random(12)
    df = spark.createDataFrame([(k, grown_to(rng, 30)) for k in range(60)], "k int, parse_str string")
    every = trees.motifs(df).collect()
    few = frozenset(sorted({r.pattern for r in every})[::9])
    assert sorted(r for r in every if r.pattern in few) == sorted(trees.motifs(df, wanted=few, limit=100_000).collect())


def test_trees_of_ten_thousand_levels(spark):
    deep = "(S " * 10_000 + "(SBAR (NN a) (NN b))" + ")" * 10_000
    assert T.sentence_types(deep) == ("COMPLEX-COMPOUND", "PERIODIC")
    assert len(T.nodes(deep)) == 10_005
    assert [m for m, _, _ in T.motifs(deep)].count("(SBAR (NN) (NN))") == 3
    df = spark.createDataFrame([(1, deep)], "k int, parse_str string")
    assert trees.classify(df).first().feng_algo_1 == "COMPLEX-COMPOUND"
    assert trees.partial_counts(df, ["k"]).where("pattern = '(SBAR (NN) (NN))'").first().cnt == 3
    assert df.select(F.size(trees.parse_tree("parse_str")).alias("n")).first().n == 10_005


def test_pretty():
    assert T.pretty("(S (NP x))") == "S\n  NP\n    x"
    assert T.pretty("(") == ""


def test_outlines_keep_the_types_of_any_tree():
    """Runs of leaves are one leaf to a classifier, so that few trees are looked at; malformed trees stay malformed."""
    rng = random.Random(5)

    def tree(depth):
        label = rng.choice(["S", "SBAR", "VP", "NP", "X", "-LRB-", ""])
        if depth == 0 or rng.random() < 0.3:
            return f"({label} {rng.choice(['a', 'S', 'é', ''])})"
        return f"({label} {' '.join(tree(depth - 1) for _ in range(rng.randint(0, 4)))})"

    whole = [tree(rng.randint(0, 4)) for _ in range(2_000)]
    cut = [t[: rng.randint(0, len(t))] + rng.choice(["", ")", " (NN a)"]) for t in whole]
    odd = ["(NN a)", "(NN a) (NN b)", " (NN a) (NN b) ", "(S (NN a)) (NN b)", "(NN a) (S (NN b))", "(NN a)(NN b)", "x (NN a)", "(NN a) x", "", "(VP a)", "(SBAR a)"]
    for text in [*whole, *cut, *odd]:
        assert T.sentence_types(outline(text)) == T.sentence_types(text), text
    assert len({outline("(S (NP " + " ".join(["(NN a)"] * k) + ") (VP (VBZ is)))") for k in range(1, 9)}) == 1


def test_only_parts_of_wanted_patterns_are_put_together():
    """What isn't part of a wanted pattern is neither built nor kept; places and words stay those of all patterns."""
    rng = random.Random(8)

    def tree(depth):
        label = rng.choice(["S", "NP", "VP", "X", "-LRB-"])
        if depth == 0 or rng.random() < 0.2:
            return f"({label} {rng.choice('abc')})"
        return f"({label} {' '.join(tree(depth - 1) for _ in range(rng.randint(0, 3)))})"

    texts = [tree(5) for _ in range(300)]
    whole = Forest()
    every = [list(whole.hits(whole.root(t))) for t in texts]
    names = sorted({h[1] for own in every for h in own})
    for n in (0, 1, 5, 60, len(names)):
        wanted = frozenset(rng.sample(names, n))
        some = Forest(wanted=wanted)
        assert [list(some.hits(some.root(t))) for t in texts] == [[h for h in own if h[1] in wanted] for own in every]
        assert n > 5 or len(some.patterns) <= sum(w.count("(") for w in wanted) < len(names) / 4


def test_a_phrase_of_leaves_is_one_node():
    forest = Forest()
    root = forest.root("(S (NP (DT the) (np x) (NN cat)) (VP (VBD sat)) (NP (DT a) (np y) (NN b)))")
    assert len(forest.labels) == 3 and forest.types(root) == ("SIMPLE", "OTHER")
    found = [(p, a, b) for _, p, a, b in forest.hits(root)]
    assert found.count(("(NP (DT) (np) (NN))", 0, 3)) == 3 and found.count(("(NP (DT) (np) (NN))", 4, 7)) == 3
    assert forest.sums(Counter({root: 2}))[forest.numbers["(NP (DT) (np) (NN))"]] == 12


def test_summed_motifs_are_those_of_motifs(spark):
    said = ["(S (NP (DT the) (NN cat)) (VP (VBD sat)))", "(S (NP (DT a) (NN cat)) (SBAR (WDT that) (S (NP (NN x) (. .)))))", "(S", None, "(FRAG)"]
    df = spark.createDataFrame([(k % 2, said[k % 5]) for k in range(400)], "k int, parse_str string").repartition(3)
    for limit in (1, 1 << 20):
        own = trees.summed_motifs(df, ["k"], limit=limit)
        want = trees.motifs(df).groupBy("k", "pattern", "words").count()
        assert sorted(map(tuple, own.groupBy("k", "pattern", "words").sum("cnt").collect())) == sorted(map(tuple, want.collect()))
    # equal motifs of a task leave it once: fewer rows than motifs
    assert trees.summed_motifs(df, ["k"]).count() < trees.motifs(df).count() / 3
