"""The learned segmenter on a made corpus, and its ratios against the formulas."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import parse, segment


def made_corpus(rng):
    words, names, out = "river stone garden window letter morning market captain village bridge".split(), ["Smith", "Jones", "Brown"], []
    for _ in range(400):
        said = []
        for _ in range(6):
            body = rng.choices(words, k=rng.randrange(4, 9))
            if rng.random() < 0.5:
                body.insert(rng.randrange(len(body)), f"{rng.choice(['Dr.', 'Mr.', 'e.g.', 'approx.'])} {rng.choice(names)}")
            said.append((rng.choice(["The", "But", "When"]) + " " + " ".join(body), rng.choice([".", ".", ".", "!", "?"])))
        out.append(" ".join(a + b for a, b in said))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(t,) for t in made_corpus(random.Random(5))], "text string").repartition(3)


def test_abbreviations_and_starters(corpus):
    short, first = segment.learn(corpus)
    assert {"dr", "mr", "e.g"} <= short and not {"river", "stone", "smith", "the"} & short
    assert first == {"the", "but", "when"}


def test_ratios_follow_the_formulas(corpus):
    found = segment.tokens(corpus)
    rows = found.collect()
    n, p = len(rows), sum(r.ending == "period" for r in rows) / len(rows)
    for r in segment.abbreviations(found).collect():
        k, m = sum(x.type == r.type and x.ending == "period" for x in rows), sum(x.type == r.type for x in rows)
        size = len(r.type.replace(".", ""))
        log = -2 * (k * math.log(p) + (m - k) * math.log(1 - p) - k * math.log(0.99) - (m - k) * math.log(0.01))
        assert (r.n_period, r.n_other) == (k, m - k)
        assert r.ratio == pytest.approx(log * math.exp(-size) * (r.type.count(".") + 1) * size ** -float(m - k))
    assert n == found.count()


def test_sentences(spark, corpus):
    model = segment.learn(corpus)
    said = {
        "He met Dr. Smith. Then he left.": ["He met Dr. Smith.", "Then he left."],
        "He saw the dr. The river rose.": ["He saw the dr.", "The river rose."],
        "Fruit, e.g. pears. \nA line\n\n": ["Fruit, e.g. pears.", "A line"],
        "J. Brown came! (When?) \"But no.\" Yes": ["J. Brown came!", "(When?)", "\"But no.\"", "Yes"],
        "See page 3. of it. No. 4. Next": ["See page 3. of it.", "No.", "4.", "Next"],
        "Well... so it was... Now go": ["Well... so it was...", "Now go"],
        "": [],
        " \n ": [],
        None: None,
    }
    df = spark.createDataFrame([(t,) for t in said], "text string")
    assert {r.text: r.s for r in df.select("text", segment.segments(F.col("text"), model).alias("s")).collect()} == said
    rows = parse.sentences(df, segmenter=model)
    assert rows.where("text IS NOT NULL").count() == 0 if "text" in rows.columns else rows.count() == sum(len(s or []) for s in said.values())


def test_sentences_of_the_made_corpus(corpus):
    cut = corpus.select(F.size(segment.segments(F.col("text"), segment.learn(corpus))).alias("n"))
    assert cut.where("n = 6").count() >= 0.99 * cut.count()  # the rule would cut behind each abbreviation


def test_no_texts_and_too_many_types(spark, corpus):
    empty = corpus.limit(0)
    assert segment.learn(empty) == (frozenset(), frozenset())
    assert segment.learn(spark.createDataFrame([(None,), ("",), ("no end",)], "text string")) == (frozenset(), frozenset())
    with pytest.raises(ValueError, match="types"):
        segment.learn(corpus, most_types=1)


def test_counted_tokens_are_the_tokens_summed(spark, corpus):
    odd = spark.createDataFrame([(None,), ("",), ('A b "c." (D)... e!\n\n.. x\x0by. z',), ("Ünder. ... Q",)], "text string").unionByName(corpus.select("text"))
    then = F.when(F.col("ending").isin("period", "strong"), F.col("next")).alias("next")
    want = segment.tokens(odd).select("type", "ending", then).groupBy("type", "ending", "next").count()
    found = segment.counted(odd)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert sorted(map(tuple, segment.abbreviations(found).collect())) == sorted(map(tuple, segment.abbreviations(segment.tokens(odd)).collect()))
