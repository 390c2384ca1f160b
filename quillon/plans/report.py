"""The comparison report: top motifs of each domain with highlighted witnesses, as lines of text."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import motifs
from quillon.sources import files

# Section order, ranking column and heading of the report.
SECTIONS = [
    ("model_gap", "TOP DIVERGENCE: WHERE GPT AND CLAUDE DISAGREE MOST"),
    ("gpt_deviation", "STRONGEST GPT SIGNATURES: FURTHEST FROM HUMANS"),
    ("claude_deviation", "STRONGEST CLAUDE SIGNATURES: FURTHEST FROM HUMANS"),
]
ORDER = ["gpt", "claude", "human"]
TITLE = "=== AI vs HUMAN STYLOMETRIC ANALYSIS REPORT ==="


def top_motifs(comparison: DataFrame, most: int = 4) -> DataFrame:
    """section, rank and the comparison's columns: `most` rows for each domain and section. The comparison runs once, and
    its few rows come back as a table of their own, so that looking up witnesses doesn't compare again."""
    rows = motifs.tops(comparison, [by for by, _ in SECTIONS], most)
    return comparison.sparkSession.createDataFrame(rows.collect(), rows.schema)


def with_examples(tops: DataFrame, parses: DataFrame, most: int = 2) -> DataFrame:
    """tops with `examples`: the sources' witnesses in ORDER, the first `most` of them."""
    found = motifs.examples(parses, tops, most)
    of = lambda s: F.coalesce(F.max(F.when(F.col("source") == s, F.col("examples"))), F.array().cast("array<struct<words:string,sentence:string>>"))
    merged = found.groupBy("domain", "pattern").agg(F.slice(F.concat(*map(of, ORDER)), 1, most).alias("examples"))
    return tops.join(merged, ["domain", "pattern"], "left")


def lines(tops: DataFrame) -> DataFrame:
    """domain, section, rank, line_no, line of the report's body."""
    signed = lambda c: F.format_string("%+.3f", F.col(c))
    gpt = F.concat(F.lit("  -> GPT PMI:    "), signed("gpt_pmi"), F.when(F.col("section") == 2, " (Max Deviation)").otherwise(""))
    claude = F.concat(F.lit("  -> Claude PMI: "), signed("claude_pmi"), F.when(F.col("section") == 3, " (Max Deviation)").otherwise(""))
    gap = F.concat(F.lit("  -> Gap Size:   "), F.format_string("%.3f", F.col("model_gap")))
    shown = F.transform(F.coalesce("examples", F.array().cast("array<struct<words:string,sentence:string>>")), lambda e, k: F.concat(F.lit("     ex"), k + 1, F.lit(": "), X.smart_truncate(X.highlight(e["sentence"], e["words"])), F.lit("...")))
    head = F.array(F.lit(""), F.concat(F.lit("Pattern: "), F.col("pattern")))
    body = F.when(F.col("section") == 1, F.array(gpt, claude, gap)).when(F.col("section") == 2, F.array(gpt, claude)).otherwise(F.array(claude, gpt))
    return tops.select("domain", "section", "rank", F.posexplode(F.concat(head, body, shown)).alias("line_no", "line"))


def section_text(rows: list, domain: str, seconds: float) -> Iterator[str]:
    """The report's lines on one domain from lines() rows (a few)."""
    own = sorted((r for r in rows if r["domain"] == domain), key=lambda r: (r["section"], r["rank"], r["line_no"]))
    if not own:
        yield f"No shared patterns found for domain '{domain}'."
        return
    for k, (_, title) in enumerate(SECTIONS):
        yield from ("", "", f"### {title} ({domain.upper()})", "-" * 80, *(r["line"] for r in own if r["section"] == k + 1))
    yield from ("", f"[ Domain '{domain}' completed in {seconds:.1f}s ]")


def render(rows: list, domains: list[str], seconds: dict[str, float]) -> str:
    """The text of the report from lines() rows and each domain's seconds."""
    return "\n".join([TITLE, *(x for d in domains for x in section_text(rows, d, seconds.get(d, 0.0)))]) + "\n"


def domain_lines(parses: DataFrame, domain: str, min_count: int = 15) -> list:
    """lines() rows of one domain."""
    own = parses.where(F.col("domain") == domain)
    found = top_motifs(motifs.compare(motifs.count_motifs(own), motifs.totals(own), min_count=min_count))
    return lines(with_examples(found, own)).collect() if not found.isEmpty() else []


def write_report(spark: SparkSession, parses: DataFrame, path: str, domains: list[str], min_count: int = 15) -> dict[str, float]:
    """The report job: compares the sources of each domain in turn, goes on where one has no shared patterns, and writes the
    text to `path` in whatever file system it names. Gives the seconds of each domain."""
    rows, seconds = [], {}
    for domain in domains:
        began = time.time()
        rows += domain_lines(parses, domain, min_count)
        seconds[domain] = time.time() - began
    files.write_text(spark, render(rows, domains, seconds), path)
    return seconds
