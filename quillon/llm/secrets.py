"""Secret scans in DataFrame functions only: three fixed patterns and a battery of randomness tests.

Base kinds: assign, access, hex (patterns below), leftmost and non-overlapping for each kind. The battery adds the kind
`rand`: maximal runs of RUN_CHARS of MIN_RUN characters or more are candidates. The narrowest of five alphabets that
holds a candidate is its encoding; hexadecimal of either case may be in groups between dashes, which are not tested.
Three tests ask whether it was drawn evenly from that alphabet:
- chi-squared of its character counts, as the chance that readable text (LETTER_SHARE, or digits for hexadecimal) of
  this length would look as even as that. The chance falls with the length, so the test is aware of it;
- a runs test of its characters in the upper and lower half of the alphabet, and
- the serial correlation of neighbours, each as the chance that readable text comes as near to what randomness lets
  expect.
The three chances make one by Good's weighted form of Fisher's method. What either of the latter two finds too regular to be random, whatever
its characters, has chance 1. The chances of all candidates of the table go through the Benjamini-Hochberg procedure on a
table of BINS counts, so the share of false discoveries stays under FALSE_SHARE.

Positions come from the lengths of what stands between the matches. Null text counts as empty; empty texts and tables
give zero counts and no rows; repeated rows each get their own result. Texts are scanned whole; of a run of any length
only counts and one block of BLOCK codes are held beside the text. Other columns stay out of the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's patterns (a shorter run than asked for never matches), in Java's syntax.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_CHARS = 6

RUN_CHARS = "A-Za-z0-9+/_=-"
MIN_RUN = 20
RUN = rf"(?<![{RUN_CHARS}])[{RUN_CHARS}]{{{MIN_RUN},}}"
FALSE_SHARE = 0.05
#: Standard deviations at which a regularity test rejects, and how many readable text has in these tests
#: (0.6 to 0.95 in stretches of 20 to 80 letters of English prose).
REGULAR, SPREAD = 3.3, 1.0
BINS = 400

#: Weights of the three tests' evidence, all different: the latter two tell little that the first doesn't.
WEIGHTS = (1.0, 0.2, 0.1)

# Alphabets in the order of their codes, and shares of letters in English text, a to z.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
}
#: Hexadecimal of one case in groups between dashes, as UUIDs are, is tested without its dashes.
DASHED = "(r.hit RLIKE '^[0-9a-f-]+$' OR r.hit RLIKE '^[0-9A-F-]+$') AND contains(r.hit, '-') AND NOT contains(concat('-', r.hit, '-'), '--')"
#: Characters of a long run that are looked at together: blocks of blocks, so that neither is read from its start too often.
BLOCK, BLOCKS = 4096, 64
LETTER_SHARE = [
    0.082, 0.015, 0.028, 0.043, 0.127, 0.022, 0.020, 0.061, 0.070, 0.002, 0.008, 0.040, 0.024,
    0.067, 0.075, 0.019, 0.001, 0.060, 0.063, 0.091, 0.028, 0.010, 0.024, 0.002, 0.020, 0.001,
]
KINDS = ["assign", "access", "hex", "rand"]


_FOUND = "array<struct<start:int,rank:int,end:int,hit:string>>"


def _sql(pattern: str) -> str:
    return '"' + pattern.replace("\\", "\\\\").replace('"', '\\"') + '"'


def spans(text: str, pattern: str, kind: str, keep: str = "true") -> Column:
    """array<struct<start, rank, end, hit>> of the matches; keep: SQL over `m.hit`."""
    return F.expr(spans_sql(text, pattern, kind, keep))


def spans_sql(text: str, pattern: str, kind: str, keep: str = "true") -> str:
    p = _sql(pattern)
    # sums over ever longer stretches, so that a text with n matches takes n log n steps
    running = """aggregate(sequence(0, CAST(ceil(log2(greatest(size(x.n), 1))) AS INT)), x.n, (a, k) -> transform(a, (v, i) -> v + CASE WHEN i >= shiftleft(1, k) THEN get(a, i - shiftleft(1, k)) ELSE 0 END))"""
    return f"""
        CASE WHEN {text} RLIKE {p} THEN get(transform(transform(transform(
            array(named_struct('hits', regexp_extract_all({text}, {p}, 0), 'gaps', split({text}, {p}, -1))),
            x -> named_struct('hits', x.hits, 'n', zip_with(slice(x.gaps, 1, size(x.hits)), x.hits, (gap, hit) -> length(gap) + length(hit)))),
            x -> named_struct('hits', x.hits, 'ends', {running})),
            x -> filter(zip_with(x.ends, x.hits, (at, hit) -> named_struct('start', at - length(hit), 'rank', {KINDS.index(kind)}, 'end', at, 'hit', hit)), m -> {keep})), 0)
        ELSE CAST(array() AS {_FOUND}) END"""


def _normal_below(z: str) -> str:
    """SQL for the normal distribution function (Abramowitz and Stegun 26.2.17), never 0."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = f"(exp(-0.5 * ({z}) * ({z})) * 0.3989422804014327 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"greatest(CASE WHEN {z} < 0 THEN {tail} ELSE 1 - {tail} END, 1e-39)"


def _as_close(z: str) -> str:
    """SQL for the chance that readable text is as near to what randomness lets expect."""
    return f"greatest(1 - 2 * {_normal_below(f'(-abs({z}) / {SPREAD})')}, 1e-3)"


def _good(x: str) -> str:
    """SQL for the chance of so much weighted evidence, by Good's method."""
    parts = []
    for w in WEIGHTS:
        share = w ** (len(WEIGHTS) - 1) / math.prod(w - v for v in WEIGHTS if v != w)
        parts.append(f"{share!r}D * exp(-{x} / {w!r}D)")
    return " + ".join(parts)


def _lagged() -> str:
    """SQL for the sum of products of neighbours, less the mean: each block holds one character of the next, and codes exist
    for one block at a time."""
    product = "aggregate(zip_with(slice(x, 1, size(x) - 1), slice(x, 2, size(x)), (u, v) -> (u - r.mean) * (v - r.mean)), 0D, (w, y) -> w + y)"
    small = f"get(transform(array(transform(split(substring(s, j * {BLOCK} + 1, {BLOCK} + 1), ''), c -> CAST(instr(r.letters, c) AS DOUBLE))), x -> {product}), 0)"
    large = f"get(transform(array(substring(r.body, i * {BLOCK * BLOCKS} + 1, {BLOCK * BLOCKS} + 1)), s -> aggregate(sequence(0, CAST(greatest(length(s) - 2, 0) DIV {BLOCK} AS INT)), 0D, (b, j) -> b + {small})), 0)"
    return f"aggregate(sequence(0, CAST(greatest(length(r.body) - 2, 0) DIV {BLOCK * BLOCKS} AS INT)), 0D, (a, i) -> a + {large})"


def _steps() -> list[dict[str, str]]:
    """SQL over a candidate r, step by step; each step sees the fields of those before."""
    inside = {name: f"r.body RLIKE '^[{chars.replace('-', '')}{'-' if '-' in chars else ''}]+$'" for name, chars in ALPHABETS.items()}
    pick = lambda values: "CASE r.encoding " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"
    squares = sum(p * p for p in LETTER_SHARE)
    excess = {k: len(a) * (0.1 if k in ("hex", "hex_upper") else squares) - 1 for k, a in ALPHABETS.items()}
    return [
        {"body": f"CASE WHEN {DASHED} THEN replace(r.hit, '-', '') ELSE r.hit END"},
        {"encoding": "CASE " + " ".join(f"WHEN {test} THEN '{k}'" for k, test in inside.items()) + " END"},
        {
            "size": pick({k: f"{len(a)}D" for k, a in ALPHABETS.items()}),
            "excess": pick({k: f"{x!r}D" for k, x in excess.items()}),
            "n": "CAST(length(r.body) AS DOUBLE)",
            "letters": pick({k: f"'{a}'" for k, a in ALPHABETS.items()}),
            "sides": pick({k: "'" + "".join("H" if i + 1 > len(a) / 2 else "L" for i in range(len(a))) + "'" for k, a in ALPHABETS.items()}),
        },
        {
            "counts": "transform(split(r.letters, ''), (c, i) -> named_struct('code', CAST(i + 1 AS DOUBLE), 'k', r.n - length(replace(r.body, c, ''))))",
            "halves": "translate(r.body, r.letters, r.sides)",
        },
        {
            "chi_squared": "aggregate(r.counts, 0D, (a, c) -> a + c.k * c.k) * r.size / r.n - r.n",
            "mean": "aggregate(r.counts, 0D, (a, c) -> a + c.code * c.k) / r.n",
            "high": "aggregate(filter(r.counts, c -> c.code > r.size / 2), 0D, (a, c) -> a + c.k)",
            "runs": "1 + (r.n - length(replace(r.halves, 'HL', ''))) / 2 + (r.n - length(replace(r.halves, 'LH', ''))) / 2",
        },
        {
            "spread": "aggregate(r.counts, 0D, (a, c) -> a + c.k * (c.code - r.mean) * (c.code - r.mean))",
            "lagged": _lagged(),
            "even_z": "(r.chi_squared - (r.size - 1 + r.n * r.excess)) / sqrt(2 * (r.size - 1 + 2 * r.n * r.excess))",
        },
        {
            "runs_mean": "2 * r.high * (r.n - r.high) / r.n + 1",
            "serial_z": "CASE WHEN r.spread > 0 THEN r.lagged / r.spread * sqrt(r.n) ELSE sqrt(r.n) END",
        },
        {"runs_z": "CASE WHEN (r.runs_mean - 1) * (r.runs_mean - 2) > 0 THEN (r.runs - r.runs_mean) / sqrt((r.runs_mean - 1) * (r.runs_mean - 2) / (r.n - 1)) ELSE sqrt(r.n) END"},
        {
            "evidence": " - ".join(["0", *(f"{w} * ln({p})" for w, p in zip(WEIGHTS, (_normal_below("r.even_z"), _as_close("r.runs_z"), _as_close("r.serial_z")), strict=True))]),
            "regular": f"abs(r.runs_z) > {REGULAR} OR abs(r.serial_z) > {REGULAR}",
        },
        {"chance": "CASE WHEN r.regular THEN 1D ELSE greatest(least(1D, " + _good("r.evidence") + "), 1e-39D) END"},
    ]


def tested(candidates: str) -> Column:
    """The array of candidates with encoding, chi_squared, runs_z, serial_z and chance of each."""
    sql, fields = candidates, ["start", "rank", "end", "hit"]
    keep = [*fields, "encoding", "chi_squared", "runs_z", "serial_z", "chance"]
    for step in _steps():
        sql = f"transform({sql}, r -> named_struct({', '.join([*(f"'{f}', r.{f}" for f in fields), *(f"'{f}', {x}" for f, x in step.items())])}))"
        fields = [*fields, *step]
    return F.expr(f"transform({sql}, r -> named_struct({', '.join(f"'{f}', r.{f}" for f in keep)}))")


def _bin(chance: str) -> str:
    return f"CAST(least({BINS - 1}, floor(-10 * log10({chance}))) AS INT)"


def threshold(chances: DataFrame) -> int:
    """The least bin of -10 log10(chance) that Benjamini and Hochberg let through; BINS if none."""
    counts = dict(chances.groupBy(F.expr(_bin("chance")).alias("bin")).count().collect())  # BINS rows at most
    total, below, least = sum(counts.values()), 0, BINS
    for b in sorted(counts, reverse=True):
        below += counts[b]
        if math.pow(10, -b / 10) <= FALSE_SHARE * below / total:
            least = b
    return least


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and added: arrays of struct<start, rank, end, hit>, positions in code points, end exclusive."""
    docs = df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    runs = docs.select(key, "text", spans("text", RUN, "rand").alias("runs")).withColumn("runs", tested("runs"))
    least = threshold(runs.select(F.explode("runs.chance").alias("chance")))
    long = f"length(regexp_extract(m.hit, {_sql(ASSIGN)}, 1)) >= {ASSIGN_CHARS}"
    base = F.concat(spans("text", ASSIGN, "assign", long), spans("text", ACCESS, "access"), spans("text", HEX, "hex"))
    passed = F.expr(f"transform(filter(runs, r -> {_bin('r.chance')} >= {least}), r -> named_struct('start', r.start, 'rank', r.rank, 'end', r.end, 'hit', r.hit))")
    return runs.select(key, base.alias("base"), passed.alias("added"))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_rand of scan()'s rows."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    said = lambda a: F.expr(f"array_join(transform(array_sort({a}), m -> concat({kinds}[m.rank], ':', m.start, ':', m.end)), ',')")
    count = lambda k: F.expr(f"CAST(size(filter(base, m -> m.rank = {k})) AS BIGINT)")
    return found.select(
        key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(said("base"), 256).alias("base_sha256"), said("concat(base, added)").alias("spans"), F.size("added").cast("long").alias("n_rand"),
    )
