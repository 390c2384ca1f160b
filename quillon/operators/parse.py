"""From documents to one row for each sentence, with a bracketed tree.

The default segmenter and bracketer are rules that SQL can say, so another engine can repeat them; they are no linguistic
parser. The bracketer runs over Arrow batches, as nested lambdas of SQL are slower. A model takes their place through
`parser`, which gets a text and returns a tree for each sentence.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillon import schemas
from quillon.functions import text as X
from quillon.operators import segment

SENTENCE = r"[^.!?\n]+[.!?]*"
TOKEN = r"[^\s(),.;:!?]+|[.;:!?()]"

# Closed word lists and endings of the rule-based tagger.
TAGS = [
    ("DT", "the a an la le les el los las un une una der die das ein eine"),
    ("IN", "of in to for with on by at as de en von zu mit auf dans por para"),
    ("CC", "and or but et y und o ou"),
    ("PRP", "it he she er sie il elle ella"),
    ("WDT", "that which who if que qui dass wenn weil si"),
    ("VBZ", "is was are be ist est es fue"),
]
ENDINGS = [("CD", "^[0-9]"), ("RB", "(ly|mente|ment)$"), ("VBD", "(ed|ing|ent|ar|ir|er)$"), ("JJ", "(ble|lich|eux|al)$"), ("NNP", "^[A-Z]"), ("NNS", "s$")]

SPARK = {"map": "transform({0}, {1} -> {2})", "filter": "filter({0}, {1} -> {2})", "join": "array_join({0}, {1})", "all": "regexp_extract_all({0}, {1}, 0)", "like": "regexp_like({0}, {1})", "sub": "regexp_replace({0}, {1}, {2})", "size": "size({0})", "split": "split({0}, ',')", "ref": "$", "q": lambda s: "r'" + s + "'"}
DUCKDB = {"map": "list_transform({0}, lambda {1}: {2})", "filter": "list_filter({0}, lambda {1}: {2})", "join": "array_to_string({0}, {1})", "all": "regexp_extract_all({0}, {1})", "like": "regexp_matches({0}, {1})", "sub": "regexp_replace({0}, {1}, {2})", "size": "len({0})", "split": "string_split({0}, ',')", "ref": "\\", "q": lambda s: "'" + s + "'"}


def bracket_sql(sentence: str, d: dict = SPARK) -> str:
    """SQL for the tree of a sentence: comma-separated clauses, each an SBAR, a coordinated S, NP with VP, or NP."""
    q, ref = d["q"], d["ref"]
    tag = "CASE WHEN t IN ('.', '!', '?') THEN '.' WHEN t IN (';', ':') THEN ':' WHEN t = '(' THEN '-LRB-' WHEN t = ')' THEN '-RRB-' "
    tag += " ".join(f"WHEN lower(t) IN ({', '.join(repr(w) for w in words.split())}) THEN '{name}'" for name, words in TAGS)
    tag += " " + " ".join(f"WHEN {d['like'].format('t', q(end))} THEN '{name}'" for name, end in ENDINGS) + " ELSE 'NN' END"
    word = "CASE WHEN t = '(' THEN '-LRB-' WHEN t = ')' THEN '-RRB-' ELSE t END"
    tagged = d["map"].format(d["all"].format("c", q(TOKEN)), "t", f"'(' || {tag} || ' ' || {word} || ')'")
    clauses = d["filter"].format(d["map"].format(d["split"].format(sentence), "c", d["join"].format(tagged, "' '")), "x", "x <> ''")
    sub = lambda s, pattern, by: d["sub"].format(s, q(pattern), q(by.replace("$", ref)))
    like = lambda s, pattern: d["like"].format(s, q(pattern))
    phrase = lambda s: f"CASE WHEN {like(s, r'^\(VB')} THEN '(VP ' || {s} || ')' WHEN {like(s, r' \(VB')} THEN {sub(s, r'^(.*?) (\(VB.*)$', '(NP $1) (VP $2)')} ELSE '(NP ' || {s} || ')' END"
    rest = sub("x", r"^\([^ ]+ [^ ]+\) (.*)$", "$1")
    first = sub("x", r"^(\([^ ]+ [^ ]+\)) .*$", "$1")
    clause = f"CASE WHEN {like('x', r'^\(WDT [^ ]+\) ')} THEN '(SBAR ' || {first} || ' (S ' || {phrase(rest)} || '))' WHEN {like('x', r'^\(CC [^ ]+\) ')} THEN {first} || ' (S ' || {phrase(rest)} || ')' ELSE {phrase('x')} END"
    whole = d["join"].format(d["map"].format(clauses, "x", clause), "' (, ,) '")
    return f"CASE WHEN {d['size'].format(clauses)} = 0 THEN '(FRAG)' ELSE '(S ' || {whole} || ')' END"


_TOKEN = re.compile(TOKEN, re.ASCII)
#: The endings in their order: codes that the first character may have, or strings that the token may end with.
_ENDINGS = [(name, range(ord(end[2]), ord(end[4]) + 1), None) if end[0] == "^" else (name, None, tuple(end.strip("()$").split("|"))) for name, end in ENDINGS]
_TAG = {w: name for name, words in reversed(TAGS) for w in words.split()}
_MARKS = {".": "(. .)", "!": "(. !)", "?": "(. ?)", ";": "(: ;)", ":": "(: :)", "(": "(-LRB- -LRB-)", ")": "(-RRB- -RRB-)"}
#: Different tokens that a task remembers.
MOST_TOKENS = 100_000


class Tagged(dict):
    """The leaf of each token that was asked for, of MOST_TOKENS at most."""

    def __missing__(self, token: str) -> str:
        if len(self) >= MOST_TOKENS:
            self.clear()
        name = _TAG.get(token.lower())
        if name is None:
            first = ord(token[0])
            name = next((name for name, some, ends in _ENDINGS if (first in some if some else token.endswith(ends))), "NN")
        leaf = self[token] = _MARKS.get(token) or f"({name} {token})"
        return leaf


def _phrase(leaves: str) -> str:
    verb = leaves.find("(VB")  # a word has no bracket
    if verb < 0:
        return f"(NP {leaves})"
    return f"(NP {leaves[: verb - 1]}) (VP {leaves[verb:]})" if verb else f"(VP {leaves})"


def _clause(leaves: str) -> str:
    if leaves.startswith(("(WDT ", "(CC ")):
        first, _, rest = leaves.partition(") ")
        if rest:
            return f"(SBAR {first}) (S {_phrase(rest)}))" if first[1] == "W" else f"{first}) (S {_phrase(rest)})"
    return _phrase(leaves)


def bracket(sentence: str, tagged: Tagged) -> str:
    """What bracket_sql() says of a sentence."""
    leaf = tagged.__getitem__
    clauses = [_clause(" ".join(map(leaf, found))) for part in sentence.split(",") if (found := _TOKEN.findall(part))]
    return f"(S {' (, ,) '.join(clauses)})" if clauses else "(FRAG)"


def bracketed(sentence: Column) -> Column:
    """The trees of sentences by the rules; null for null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagged = Tagged()
        for batch in batches:
            yield pa.array([None if s is None else bracket(s, tagged) for s in batch.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(sentence)


_SENTENCE = re.compile(SENTENCE)
#: Sentences that a task hands on at once.
ROWS = 8_192


def rule_parses(corpus: DataFrame) -> DataFrame:
    """The sentences that aren't empty with their trees, by the rules, in one pass over the texts: a sentence goes neither
    through expressions of its own nor to Python a second time. A long text leaves in parts of ROWS sentences."""
    keys = ["doc_id", "domain", "source", "author"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagged = Tagged()
        for batch in batches:
            own: tuple[list, ...] = ([], [], [], [])
            for row, text in enumerate(batch.column("text")):
                if (text := text.as_py()) is None:
                    continue
                for k, m in enumerate(_SENTENCE.finditer(text)):
                    if said := m[0].strip(X.WHITE):
                        for column, value in zip(own, (row, k, said, bracket(said, tagged)), strict=True):
                            column.append(value)
                        if len(own[0]) == ROWS:
                            yield _rows(batch, own)
                            own = ([], [], [], [])
            if own[0]:
                yield _rows(batch, own)

    def _rows(batch: pa.RecordBatch, own: tuple[list, ...]) -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, t in zip(own, (pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(columns[0]) for c in keys), *columns[1:]], names=[*keys, "sent_idx", "sent_text", "parse_str"])

    rows = corpus.select(F.col("id").cast("string").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in (*keys[1:], "text")))
    return rows.mapInArrow(run, schemas.PARSES)


def segments(text: Column, segmenter: Callable[[str], list[str]] | tuple | None = None) -> Column:
    """The sentences of a text, by the rule, by a model of segment.learn(), or by a segmenter, which gets a text and lives
    once in each worker."""
    if segmenter is None:
        return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    if isinstance(segmenter, tuple):
        return segment.segments(text, segmenter)

    def cut(texts):
        return texts.map(lambda t: None if t is None else list(segmenter(t)))

    return F.pandas_udf(cut, "array<string>")(text)


def sentences(corpus: DataFrame, text: str = "text", segmenter: Callable[[str], list[str]] | tuple | None = None) -> DataFrame:
    """corpus without its text, with sent_idx (from 0) and sent_text (stripped); a null text has no sentences."""
    cols = [c for c in corpus.columns if c != text]
    rows = corpus.select(*cols, F.posexplode(segments(F.col(text), segmenter)).alias("sent_idx", "sent_text"))
    return rows.withColumn("sent_text", X.strip(F.col("sent_text")))


def remove_empty(parses: DataFrame) -> DataFrame:
    """Without rows whose stripped sentence is empty; null sentences stay."""
    return parses.where(F.col("sent_text").isNull() | F.col("sent_text").rlike(r"(?U)\S"))


def parse_constituency(corpus: DataFrame, parser: Callable[[str], list[tuple[str, str]]] | None = None) -> DataFrame:
    """corpus (id, domain, source, author, text) -> PARSES. parser: text -> [(sentence, tree)]; a tree of None skips the
    sentence and leaves a gap in sent_idx; ValueError skips the document. Skips are the rows that parse_status() counts."""
    if parser is None:
        return rule_parses(corpus)
    return remove_empty(parse_status(corpus, parser).where("status = 'ok'").drop("status"))


def parse_status(corpus: DataFrame, parser: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """PARSES and status: ok, sentence_failed or document_failed. The parser lives once in each worker."""
    columns = [c.split()[0] for c in schemas.PARSES.split(", ")] + ["status"]

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                key = (r.id, r.domain, r.source, r.author)
                try:
                    found = list(enumerate(parser(r.text))) if r.text is not None else []
                except ValueError:
                    rows.append((*key, None, None, None, "document_failed"))
                    continue
                rows += [(*key, i, s.strip(), tree, "ok" if tree is not None else "sentence_failed") for i, (s, tree) in found]
            yield pd.DataFrame(rows, columns=columns).astype({"sent_idx": "Int32"})

    return corpus.select("id", "domain", "source", "author", "text").mapInPandas(run, schemas.PARSES + ", status string")


def observed(corpus: DataFrame, parser: Callable[[str], list[tuple[str, str]]]) -> tuple[DataFrame, Observation]:
    """parse_constituency() by a parser, and an observation of n_ok, n_sentence_failed and n_document_failed, filled when the
    frame is written."""
    seen = Observation("constituency")
    counts = (F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "sentence_failed", "document_failed"))
    return remove_empty(parse_status(corpus, parser).observe(seen, *counts).where("status = 'ok'").drop("status")), seen


def with_metrics(corpus: DataFrame, segmenter: Callable[[str], list[str]] | tuple | None = None) -> DataFrame:
    """corpus with word_count, sent_count, mean_sent_length and sent_length_var (null for one sentence), inside the row."""
    lengths = F.transform(F.filter(segments(F.col("text"), segmenter), lambda s: X.strip(s) != ""), lambda s: X.word_count(s).cast("double"))
    out = corpus.withColumn("_l", lengths).withColumn("sent_count", F.size("_l").cast("long"))
    total = F.aggregate("_l", F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("mean_sent_length", F.try_divide(total, F.col("sent_count")))
    spread = F.aggregate("_l", F.lit(0.0), lambda a, x: a + (x - F.col("mean_sent_length")) * (x - F.col("mean_sent_length")))
    variance = F.when(F.col("sent_count") > 1, spread / (F.col("sent_count") - 1))
    return out.withColumn("sent_length_var", variance).withColumn("word_count", X.word_count(F.col("text"))).drop("_l")
