"""Strings, counting modes, PMI, statistics, dependency lines and author repair on small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon import schemas
from quillon.functions import text as X
from quillon.operators import dependency, motifs, parse, repair, stats, trees
from quillon.plans import catalog, report

TREE = "(S (NP (DT The) (NN cat)) (VP (VBD sat)) (. .))"


def one(spark, value, f, *more):
    return spark.createDataFrame([(value, *more)], "a string" + "".join(f", {c} string" for c in "bc"[: len(more)])).select(f).first()[0]


@pytest.mark.parametrize(
    ("sentence", "words", "want"),
    [
        ("At least, at LEAST now.", "at least", "**At least**, at LEAST now."),
        ("the a.b x", "a.b", "the **a.b** x"),
        ("ends here.", "here .", "ends here."),
        ("I don't know", "do n't", "I **don't** know"),
        ("anything", "", "anything"),
        ("two\nlines of it", "lines of", "two\n**lines of** it"),
    ],
)
def test_highlight(spark, sentence, words, want):
    assert one(spark, sentence, X.highlight(F.col("a"), F.col("b")), words) == want


@pytest.mark.parametrize(("text", "want"), [("abcdefghijkl", "abcdefghij..."), ("0123456789**ab**", "...56789**ab*..."), ("**ab**cdefgh", "**ab**cdef..."), ("short", "short")])
def test_truncate(spark, text, want):
    assert one(spark, text, X.smart_truncate(F.col("a"), 10)) == want


@pytest.mark.parametrize(("text", "want"), [("", 0), (" a  b ", 2), (None, None), ("a b", 2)])
def test_word_count(spark, text, want):
    assert one(spark, text, X.word_count(F.col("a"))) == want


def test_labels(spark):
    assert one(spark, "(PP (IN) (NP (PRP$) (NN) (.)))", X.labels(F.col("a"))) == ["PP", "IN", "NP", "PRP$", "NN"]


def test_pmi(spark):
    rows = [("d", "gpt", "both", 10), ("d", "human", "both", 5), ("d", "gpt", "alone", 10), ("d", "gpt", "rare", 4)]
    total = spark.createDataFrame([("d", "gpt", 100), ("d", "human", 100)], "domain string, source string, total long")
    found = {r.pattern: r.pmi for r in motifs.pmi(spark.createDataFrame(rows, "domain string, source string, pattern string, cnt long"), total, "gpt").collect()}
    assert found == {"both": pytest.approx(1.0), "alone": pytest.approx(math.log2(20))}
    no_base = total.where("source = 'gpt'")
    found = motifs.pmi(spark.createDataFrame(rows, "domain string, source string, pattern string, cnt long"), no_base, "gpt").collect()
    assert all(r.pmi is None for r in found)


def parses(spark, n=10):
    rows = [(str(k // 2), "d", s, None, k % 2, "The cat sat.", TREE) for s in schemas.SOURCES for k in range(n)]
    return spark.createDataFrame(rows, schemas.PARSES)


def test_counts_sum_and_max_chunk(spark):
    df = parses(spark)
    total = {(r.source, r.pattern): r.cnt for r in motifs.count_motifs(df).collect()}
    assert total["gpt", "(NP (DT) (NN))"] == 30
    most = {(r.source, r.pattern): r.cnt for r in motifs.count_motifs(df, mode="max_chunk", n_chunks=5).collect()}
    assert most["gpt", "(NP (DT) (NN))"] == 6
    spread = {(r.source, r.pattern): r.cnt for r in motifs.count_motifs(df.repartition(7)).collect()}
    assert spread == total
    with pytest.raises(ValueError):
        motifs.count_motifs(df, mode="other")
    assert motifs.count_motifs(df.limit(0)).count() == 0


def test_compare_examples_and_report(spark):
    df = parses(spark)
    compared = motifs.compare(motifs.count_motifs(df), motifs.totals(df), min_count=5)
    tops = report.with_examples(report.top_motifs(compared), df)
    row = tops.where("pattern = '(NP (DT) (NN))'").first()
    assert [tuple(e) for e in row.examples] == [("The cat", "The cat sat."), ("The cat", "The cat sat.")]
    text = report.render(report.lines(tops).collect(), ["d", "none"], {"d": 1.0})
    assert "  -> GPT PMI:    +0.000\n  -> Claude PMI: +0.000\n  -> Gap Size:   0.000\n" in text
    assert "     ex1: **The cat** sat....\n" in text
    assert "No shared patterns found for domain 'none'." in text


def test_totals(spark):
    df = spark.createDataFrame([("1", "d", "gpt", None, 0, "a", None), ("1", "d", "gpt", None, 1, "b", TREE)], schemas.PARSES)
    assert motifs.totals(df).first().total == 2
    assert motifs.totals(df, parsed_only=True).first().total == 1


def test_merge_examples(spark):
    schema = "k string, pattern string, chunk int, examples array<struct<words:string,sentence:string>>"
    rows = [("k", "p", 1, [("c", "3"), ("d", "4")]), ("k", "p", 0, [("a", "1"), ("a", "1")])]
    assert [e.words for e in motifs.merge_examples(spark.createDataFrame(rows, schema), ["k"]).first().examples] == ["a", "a", "c"]


def test_variability(spark):
    rows = [("g", "A", "SIMPLE"), ("g", "B", "SIMPLE"), ("g", "B", "ERROR")]
    row = stats.variability(spark.createDataFrame(rows, "g string, doc string, t string"), ["g"], ["doc"], "t", schemas.TYPE_1).first()
    assert row.SIMPLE == 0.354
    assert row.COMPLEX == 0


def test_document_metrics(spark):
    rows = parse.with_metrics(spark.createDataFrame([("one sentence only",), ("a b. c d e f.",), ("",), (None,)], "text string")).collect()
    assert [(r.sent_count, r.mean_sent_length, r.sent_length_var) for r in rows[:3]] == [(1, 3.0, None), (2, 3.0, 2.0), (0, None, None)]
    assert rows[3].word_count is None


def test_half_even_rounding(spark):
    assert stats.describe(spark.createDataFrame([(2.25,)], "v double"), [], "v", 1).first()["mean"] == 2.2


def test_parser_plug_in(spark):
    def parser(text):
        if text == "bad":
            raise ValueError
        return [("a ", TREE), ("b", None), (" ", TREE), ("c", TREE)]

    corpus = spark.createDataFrame([("1", "d", "gpt", None, "x"), ("2", "d", "gpt", None, "bad")], schemas.CORPUS)
    rows = parse.parse_constituency(corpus, parser).orderBy("sent_idx").collect()
    assert [(r.doc_id, r.sent_idx, r.sent_text) for r in rows] == [("1", 0, "a"), ("1", 3, "c")]
    status = {r.status: r.n for r in parse.parse_status(corpus, parser).groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert status == {"ok": 3, "sentence_failed": 1, "document_failed": 1}


def test_dependency_lines(spark):
    def tokens(head):
        return [(1, "a", "X", 1, "ROOT", False), (2, "b", "X", 1, "dep", False), (3, " ", "SPACE", 2, "", True), (4, "c", "X", head, "dep", False)]

    df = spark.createDataFrame([("ok", tokens(2)), ("out", tokens(9))], f"k string, t {schemas.TOKENS}")
    rows = {r.k: r.x for r in df.select("k", dependency.to_lines(F.col("t")).alias("x")).collect()}
    assert rows == {"ok": "1\ta\tX\t0\tROOT\n2\tb\tX\t1\tdep\n4\tc\tX\t2\tdep", "out": None}
    back = df.select(dependency.from_lines(dependency.to_lines(F.col("t"))).alias("x")).first().x
    assert [(t.idx, t.head) for t in back] == [(1, 0), (2, 1), (4, 2)]


def test_author_repair(spark):
    df = spark.createDataFrame([("1", "reuter", "gpt", None, 0, "hit", ""), ("1", "reuter", "gpt", "own", 1, "has", ""), ("2", "reuter", "gpt", None, 0, "miss", ""), ("1", None, "gpt", None, 0, "hit", "")], schemas.PARSES)
    lookup = spark.createDataFrame([("gpt", "1", 0, "hit", "a"), ("gpt", "1", 1, "has", "b")], schemas.LOOKUP)
    rows = repair.recover_authors(df, lookup)
    assert sorted(((r.sent_text, r.domain, r.author) for r in rows.collect()), key=str) == sorted([("hit", "reuter", "a"), ("has", "reuter", "own"), ("miss", "reuter", None), ("hit", None, None)], key=str)
    assert tuple(repair.unmatched(rows).first()) == (3, 1)
    assert repair.recover_authors(df.drop("author"), lookup).count() == 4
    with pytest.raises(repair.Ambiguous):
        repair.recover_authors(df, lookup.union(lookup))
    assert stats.duplicates(lookup.union(lookup.limit(1)), repair.KEYS).count() == 2


def test_highlighting_query_covers_all_sentences(spark, tmp_path):
    docs = [(1, "en", "src0", "The cat and the dog sat."), (2, "de", "src1", "In the house."), (3, "fr", "src2", "Other words here."), (4, "en", "src1", "x" * 70 + " the end of a long one that goes on for a good while longer.")]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {(r.doc_id, r.sent_idx): r.shown for r in catalog.QUERIES["x5_x6_highlight_truncate"](spark, str(tmp_path)).collect()}
    assert rows == {
        ("1", 0): "**The** cat and the dog sat.", ("2", 0): "In **the** house.", ("3", 0): "Other words here.",
        ("4", 0): "..." + (docs[3][3][:71] + "**the**" + docs[3][3][74:])[41:101] + "...",
    }


def test_quartiles_of_many_values_and_null_keys(spark):
    import statistics

    rng = random.Random(3)
    rows = [(k, rng.choice([rng.gauss(0, 1), float(rng.randrange(5)), 1e6 * rng.random(), None])) for k in ("a", None, "c") for _ in range(700)] + [("one", 5.0), ("none", None)]
    found = {r.g: r for r in stats.describe(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 6).collect()}
    assert set(found) == {"a", None, "c", "one", "none"}
    for g in ("a", None, "c"):
        want = statistics.quantiles([v for k, v in rows if k == g and v is not None], n=4, method="inclusive")
        assert [found[g].q25, found[g].q50, found[g].q75] == pytest.approx(want, abs=1e-6)
    assert (found["one"].q25, found["one"].q75, found["one"]["std"]) == (5.0, 5.0, None)
    assert (found["none"]["count"], found["none"].q50) == (0, None)
    assert stats.describe(spark.createDataFrame([], "v double"), [], "v", 1).first()["count"] == 0


def test_tasks_hand_on_their_first_witnesses_only(spark):
    rng = random.Random(13)
    rows = [(rng.choice(["d", None]), rng.choice(["gpt", "human"]), rng.choice([None, "x", "y"]), str(rng.randrange(40)), rng.randrange(30), f"(S (NP (DT {rng.choice('ab')}) (NN {rng.choice('cdef')})) (VP (VBD {rng.choice('gh')})))") for _ in range(2500)]
    rows = [(*r[:5], f"sentence {k % 50}", r[5]) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "domain string, source string, author string, doc_id string, sent_idx int, sent_text string, parse_str string").repartition(4)
    every = trees.motifs(df).collect()
    for n in (1, 2, 5):
        found = trees.first_motifs(df, ["domain", "source"], motifs.ORDER, n)
        assert max(r.n for r in found.groupBy(F.spark_partition_id().alias("p"), "domain", "source", "pattern").agg(F.count("*").alias("n")).collect()) <= n
        first = {}
        for r in every:
            at = tuple((v is not None, v) for v in (r.author, r.doc_id, r.sent_idx, r.place))
            own = first.setdefault((r.domain, r.source, r.pattern), {})
            own[r.words] = min(own.get(r.words, (at, r.words, r.sent_text)), (at, r.words, r.sent_text))
        want = {k: [(w, s) for _, w, s in sorted(own.values())[:n]] for k, own in first.items()}
        got = {(r.domain, r.source, r.pattern): [tuple(e) for e in r.examples] for r in motifs.examples(df, df.select(F.lit("(NP (DT) (NN))").alias("pattern")), n).collect()}
        assert got == {k: v for k, v in want.items() if k[2] == "(NP (DT) (NN))"} and len(got) == 4
        few = trees.first_motifs(df, ["domain", "source"], motifs.ORDER, n, flush=1)
        assert {tuple(r)[:4] for r in found.collect()} <= {tuple(r)[:4] for r in few.collect()}


def test_chunks_follow_the_order_of_the_whole_key(spark, monkeypatch):
    monkeypatch.setattr(motifs, "STRETCHES", 5)
    rng = random.Random(14)
    docs = [(rng.choice(["d", None]), rng.choice("gh"), rng.choice([None, "x", "y"]), str(k)) for k in range(80)]
    rows = [(*d, i, f"{d[3]}-{i}", "(S)") for d in docs for i in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "domain string, source string, author string, doc_id string, sent_idx int, sent_text string, parse_str string").repartition(3)
    want = {}
    for key in {d[:2] for d in docs}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: (r[2] is not None, r[2] or "", r[3], r[4]))
        want |= {r[5]: k // max(1, len(own) // 7) for k, r in enumerate(own)}
    assert {r.sent_text: r.chunk for r in motifs.in_chunks(df, ["domain", "source"], 7).collect()} == want


def scans(df):
    """How often the plan that ran reads a file."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


def test_statistics_read_their_input_once(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.gauss(1e6, 1), float(rng.randrange(9))) for _ in range(3000)]
    spark.createDataFrame(rows, "g string, v double, w double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for out in (stats.describe(df, ["g"], "v", 9), stats.describe_many(df, ["g"], ["v", "w"], 9), stats.box(df, ["g"], "v"), stats.outliers(df, ["g"], "v")):
        assert scans(out) == 1
    import statistics

    for r in stats.describe(df, ["g"], "v", 12).collect():  # deviations of large numbers that differ little
        own = [v for g, v, _ in rows if g == r.g]
        assert r["std"] == pytest.approx(statistics.stdev(own), rel=1e-9) and r.mean == pytest.approx(statistics.fmean(own))


def test_boxes_with_null_keys_and_outliers(spark):
    rows = [(g, float(v)) for g in ("a", None) for v in (*range(1, 12), 100, 100, -60)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    boxes = {r.g: tuple(r)[1:] for r in stats.box(df, ["g"], "v").collect()}
    assert boxes == {g: (3.25, 6.5, 9.75, 1.0, 11.0) for g in ("a", None)}
    found = sorted(map(tuple, stats.outliers(df, ["g"], "v", (0, 150)).where("g = 'a'").collect()))
    assert found == [("a", -60.0, 1, -1, False), ("a", 100.0, 2, 1, True)]
    assert {r.g: tuple(r)[1:] for r in stats.clipped(df, ["g"], "v", (0, 50)).collect()} == {"a": (14, 1, 2), None: (14, 1, 2), "none": (0, 0, 0)}


def test_samples_do_not_depend_on_partitions(spark):
    rows = [(g, k, None if k % 50 == 0 else f"k{k}") for k in range(600) for g in ("a", None)]
    df = spark.createDataFrame(rows, "g string, k int, key string")
    one, two = (sorted(map(tuple, stats.sample(x, ["g"], ["key", "k"], 25, "s").collect()), key=str) for x in (df.repartition(7), df.orderBy("key").coalesce(2)))
    assert one == two and len(one) == 50
    assert {r[:3] for r in one} > {tuple(r)[:3] for r in stats.sample(df, ["g"], ["key", "k"], 10, "s").collect()}
    assert one != sorted(map(tuple, stats.sample(df, ["g"], ["key", "k"], 25, "t").collect()), key=str)
    out = stats.sample(df, ["g"], ["key", "k"], 25, "s")
    out.collect()
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_report_job(spark, tmp_path):
    rows = parses(spark, 20).withColumn("doc_id", F.concat("source", "doc_id"))
    both = rows.unionByName(rows.withColumn("domain", F.lit("few")).limit(3))
    seconds = report.write_report(spark, both, str(tmp_path / "report.txt"), ["d", "few", "none"])
    assert set(seconds) == {"d", "few", "none"}
    text = (tmp_path / "report.txt").read_text()
    assert text.startswith("=== AI vs HUMAN")
    assert text.count("### ") == 3
    assert f"[ Domain 'd' completed in {seconds['d']:.1f}s ]" in text
    assert "No shared patterns found for domain 'few'.\nNo shared patterns found for domain 'none'.\n" in text


def test_repair_job(spark, tmp_path):
    corpus = spark.createDataFrame([("1", "reuter", "gpt", "a", "First one. Second one."), ("2", "reuter", "gpt", None, "Third.")], schemas.CORPUS)
    table = parse.parse_constituency(corpus).withColumn("author", F.lit(None).cast("string"))
    table.write.parquet(str(tmp_path / "t"))
    with pytest.warns(UserWarning, match="1 of 3"):
        done = repair.repair_job(spark, corpus, [str(tmp_path / "t"), str(tmp_path / "gone")])
    assert [(d["found"], d["n_rows"], d["n_unmatched"]) for d in done] == [(True, 3, 1), (False, 0, 0)]
    assert spark.read.parquet(str(tmp_path / "t")).where("author = 'a'").count() == 2
    assert spark.read.parquet(str(tmp_path / "t.bak")).where("author IS NULL").count() == 3
    again = corpus.unionByName(corpus.withColumn("author", F.lit("b")))
    assert repair.repair_job(spark, again, [str(tmp_path / "t")])[0]["n_ambiguous"] == 6


def test_dependency_documents(spark, tmp_path):
    def parser(texts):
        for t in texts:
            if t == "bad":
                yield None
            else:
                yield [(s, [(1, "x", "X", 1, "ROOT", False), (2, "y", "X", 9 if s == "out" else 1, "dep", False)]) for s in t.split("|")]

    corpus = spark.createDataFrame([("1", "d", "gpt", None, "a|out|b "), ("2", "d", "gpt", None, "bad"), ("3", "d", "gpt", None, None)], schemas.CORPUS)
    rows, seen = dependency.parse_documents(corpus, parser, batch=2)
    rows.write.parquet(str(tmp_path / "dep"))
    rows = spark.read.parquet(str(tmp_path / "dep")).orderBy("doc_id", "sent_idx").collect()
    assert [(r.doc_id, r.sent_idx, r.sent_text) for r in rows] == [("1", 0, "a"), ("1", 2, "b"), ("3", 0, "")]
    assert seen.get == {"n_ok": 3, "n_sentence_failed": 1, "n_document_failed": 1}

    def one(sentence):
        if sentence == "bad":
            raise ValueError
        return [(1, sentence, "X", 1, "ROOT", False)]

    sents = spark.createDataFrame([("a",), ("bad",)], "sent_text string")
    assert [r.parse_str for r in dependency.parse_dependency(sents, one).collect()] == ["1\ta\tX\t0\tROOT"]


def test_segmenter_and_observed_parses(spark, tmp_path):
    rows = parse.with_metrics(spark.createDataFrame([("a b|c",), (None,)], "text string"), lambda t: t.split("|")).collect()
    assert (rows[0].sent_count, rows[0].mean_sent_length) == (2, 1.5)
    corpus = spark.createDataFrame([("1", "d", "gpt", None, "x"), ("2", "d", "gpt", None, "bad")], schemas.CORPUS)

    def parser(text):
        if text == "bad":
            raise ValueError
        return [("a", TREE), ("b", None)]

    frame, seen = parse.observed(corpus, parser)
    frame.write.parquet(str(tmp_path / "p"))
    assert seen.get == {"n_ok": 1, "n_sentence_failed": 1, "n_document_failed": 1}


def test_many_wanted_patterns_and_chunk_examples(spark, monkeypatch):
    df = parses(spark)
    few = motifs.examples(df, motifs.count_motifs(df)).orderBy("source", "pattern").collect()
    monkeypatch.setattr(motifs, "FEW_WANTED", 0)
    assert motifs.examples(df, motifs.count_motifs(df)).orderBy("source", "pattern").collect() == few
    row = motifs.chunk_examples(df, motifs.count_motifs(df), n_chunks=5).where("source = 'gpt' AND pattern = '(NP (DT) (NN))'").first()
    assert [e.words for e in row.examples] == ["The cat"] * 3


def test_the_bracketer_says_what_its_sql_says(spark):
    said = ["", "(", ")", "(a)", "that", "that is", "and", "and was good", "Ünder ſ KELVIN K", "a,b,,c", ", ,", "x\x0bis y", "the THE 9lives running", "($^) a . ! ; :", "ss ed", "which (was) and, and it went", "\\1 $1 is", "x  is y", None]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    assert df.select(parse.bracketed(F.col("s")).eqNullSafe(F.expr(f"CASE WHEN s IS NOT NULL THEN {parse.bracket_sql('s')} END"))).distinct().collect() == [(True,)]
    # a line separator is a character like any other, as in the SQL that checks the queries
    odd = spark.createDataFrame([("1", "en", "gpt", None, "x\u2028 is y")], schemas.CORPUS)
    assert parse.parse_constituency(odd).first()["parse_str"] == "(S (NP (NN x\u2028)) (VP (VBZ is) (CC y)))"


def test_one_pass_parses_what_the_steps_parse(spark, monkeypatch):
    texts = ["", None, " . \x0b!", "a b. \x85c is d?\u3000\n\x1c. e, and f", "x\r\n\r\ny.\u2028z!", "no end", "\n\n", "a." * 30]
    corpus = spark.createDataFrame([(str(k), "en", None if k % 2 else "gpt", "a", t) for k, t in enumerate(texts)], schemas.CORPUS)
    monkeypatch.setattr(parse, "ROWS", 7)
    steps = parse.remove_empty(parse.sentences(corpus.withColumnRenamed("id", "doc_id")))
    steps = steps.withColumn("parse_str", parse.bracketed(F.col("sent_text")))
    found = parse.parse_constituency(corpus)
    assert found.columns == steps.columns and found.dtypes == steps.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, steps.collect())) and found.count() == 40
    # the texts go to Python once, and no expression cuts them up beforehand
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp" not in plan and "Generate" not in plan


def test_strip_takes_what_is_white_space_for_the_regular_expression(spark):
    df = spark.range(0x3100).select(F.expr("concat(char(id), 'x ', char(id))").alias("a")).unionByName(spark.createDataFrame([(f"{c}a {c}{d}",) for c in X.WHITE for d in "\n\r\x85"] + [("",), (" \t",), (None,)], "a string"))
    assert df.where(~X.strip(F.col("a")).eqNullSafe(F.regexp_replace("a", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_pmi_reads_its_counts_once(spark):
    rows = [(None, "gpt", "p", 9), ("a", "gpt", "p", 6), ("a", "human", "p", 3), ("a", "gpt", "q", 4), ("a", "gpt", "r", 5), ("a", "human", "s", 9), ("b", "gpt", "p", 8)]
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counts = spark.createDataFrame(rows, "domain string, source string, pattern string, cnt long").mapInArrow(run, "domain string, source string, pattern string, cnt long")
    total = spark.createDataFrame([("a", "gpt", 10), ("a", "human", 20), ("b", "gpt", 4)], "domain string, source string, total long")
    found = {(r.domain, r.pattern): r.pmi for r in motifs.pmi(counts, total, "gpt").collect()}
    assert found == {("a", "p"): pytest.approx(2.0), ("a", "r"): pytest.approx(math.log2(0.5 / 0.025)), ("b", "p"): None}
    assert seen.value == len(rows)


def test_patterns_and_comparisons_take_what_tasks_sum(spark):
    rows = [("en", s, "d", None, k, "x", TREE if k % 3 else "(S (NP (DT a) (NN b)) (VP (VBD c)))") for s in ("gpt", "claude", "human") for k in range(12)] + [("en", "gpt", "d", None, 99, None, "(Q (A a) (B b))")]
    df = spark.createDataFrame(rows, "domain string, source string, doc_id string, author string, sent_idx int, sent_text string, parse_str string").repartition(5)
    parts, sums = motifs.partial_counts(df), motifs.count_motifs(df)
    assert parts.count() > sums.count()
    compared = lambda counts: sorted(map(tuple, motifs.compare(counts, motifs.totals(df), min_count=4).collect()))
    assert compared(parts) == compared(sums) != []
    pmi = lambda counts: sorted(map(tuple, motifs.pmi(counts, motifs.totals(df), "gpt").collect()))
    assert pmi(parts) == pmi(sums) != []
    found = [r.pattern for r in motifs.patterns(df).collect()]
    assert len(found) == len(set(found)) and set(found) == {r.pattern for r in sums.collect()}


def test_chunks_move_no_row(spark):
    """Cuts go to the tasks; only rows of one place on both sides of a cut are numbered, and cuts beyond MOST_CUTS."""
    rows = [(d, s, None, f"d{k:02}", i, "t", "(S)") for d in "ab" for s in ("gpt", None) for k in range(9) for i in range(0, 2 * (k + 1), 2)]
    df = spark.createDataFrame(rows, "domain string, source string, author string, doc_id string, sent_idx int, sent_text string, parse_str string").repartition(3)
    keys = ["domain", "source"]
    cut = motifs.in_chunks(df, keys, 7, df.drop("parse_str"))
    assert "Window" not in cut._jdf.queryExecution().optimizedPlan().toString()
    want = {(r[0], r[1], r[3], r[4]): k for d in "ab" for s in ("gpt", None) for k, r in ((n // 6, r) for n, r in enumerate(sorted((r for r in rows if r[:2] == (d, s)), key=lambda r: r[3:5])))}
    assert {(r.domain, r.source, r.doc_id, r.sent_idx): r.chunk for r in cut.collect()} == want
    tied = motifs.in_chunks(df.withColumn("sent_idx", F.lit(1)), keys, 7)
    assert {r["count"] for r in tied.where("chunk < 7").groupBy(*keys, "chunk").count().collect()} == {6}
