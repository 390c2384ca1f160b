"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, chat, decontam, dialogue, fingerprint, langid, licenses, linededup, lm, neardup, pii, resample, secrets, stages
from quillon.llm.common import read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digests(decontam.contamination(docs, read(spark, sf_dir, "benchmark")))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.likeness(read(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("licenses.name")), ",").alias("names"),
        F.coalesce(F.array_max("licenses.coverage"), F.lit(0.0)).alias("best_coverage"),
        F.expr("array_join(transform(licenses, m -> concat(m.name, ':', m.start, ':', m.end, ':', bround(m.coverage, 3))), ',')").alias("spans"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.digests(linededup.with_bitmaps(docs, linededup.keep_bitmaps(docs)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"))
    docs = docs.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    model = langid.learn(docs.where("NOT held_out"))
    return langid.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(read(spark, sf_dir, "documents")))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 7 == 2).alias("held_out"))
    return lm.score(docs, "held_out")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(own)))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return dialogue.digests(turns, *dialogue.repair(dialogue.damaged(turns)))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digests(pii.scan(docs, pii.learn(docs)))


OPERATORS = [
    op1_decontamination, op2_fingerprint, op3_near_dedup, op4_license_scan, op5_line_dedup, op6_language_id, op7_secret_scan,
    op8_lm_score, op9_chat_format, op10_byte_bpe, op11_dialogue_repair, op12_importance_resample, op13_personal_data,
]
QUERIES = {f.__name__: f for f in OPERATORS} | {"pipeline": stages.run}


#: CRC-32 in SQL: its table, and the checksum of the UTF-8 bytes of an expression beside that table.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t)"


def crc_sql(text: str) -> str:
    code = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({code}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _edit(state: str, cost: str, letter: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}}"


def _kept(state: str, initial: str) -> str:
    return _edit(state, f"t + CASE WHEN i = '{initial}' THEN g ELSE 1000000 END", "K")


def repair_sql() -> str:
    """The same edits by the plain programme over (row, state), with the least list of edits of each state beside its cost."""
    row = {
        "s0": _edit("s0", "4", "D"),
        "s1": _least(_edit("s1", "4", "D"), _kept("s0", "s")),
        "r2": _least(_edit("s2", "4", "D"), *(f(x) for x in ("s0", "s1", "s3") for f in (lambda x: _edit(x, "3 + t + g", "R"), lambda x: _kept(x, "u")))),
        "r3": _least(_edit("s3", "4", "D"), _edit("s2", "3 + t + g", "R"), _kept("s2", "a")),
    }
    step = ", ".join(f"{x} AS {k}" for k, x in row.items())
    user = _least("r2", *(_edit(x, "3", "I") for x in ("s0", "s1", "r3")))
    return rf"""
WITH RECURSIVE {CRC_TABLE},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS said FROM conversations),
hit AS (SELECT raw.*, {crc_sql('said')} % 20 AS f FROM raw, crc),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM d),
m AS MATERIALIZED (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(body, '[.!?]$') THEN 'truncated' END AS fault, substr(role, 1, 1) AS i, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS li FROM o),
dp AS (
    SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': ''}} AS s0, {{'c': 1000000::BIGINT, 'a': ''}} AS s1, {{'c': 3::BIGINT, 'a': 'I'}} AS s2, {{'c': 6::BIGINT, 'a': 'II'}} AS s3 FROM m GROUP BY conv_id
    UNION ALL
    SELECT conv_id, k, s0, s1, s2, {_least('r3', _edit('s2', '3', 'I'))} FROM (
        SELECT conv_id, k, s0, s1, {user} AS s2, r3 FROM (
            SELECT dp.conv_id, m.k, {step} FROM (SELECT *, s0 AS _ FROM dp) dp JOIN (SELECT conv_id, k, i, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS t, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 ELSE 0 END AS g FROM m) m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.k = dp.k + 1))),
best AS MATERIALIZED (SELECT conv_id, list_sort([s0, s3])[1] AS x FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
l AS (SELECT conv_id, x.a AS a, unnest(range(1, length(x.a) + 1)) AS p FROM best),
e AS (SELECT conv_id, p, substr(a, p, 1) AS x, length(replace(substr(a, 1, p), 'I', '')) AS k, length(replace(substr(a, 1, p), 'D', '')) AS j FROM l),
r AS (SELECT e.conv_id, e.p, e.j, CASE WHEN e.x = 'K' THEN m.role END AS role, CASE WHEN e.x = 'I' THEN '' ELSE m.text END AS text FROM e LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.k = e.k WHERE e.x <> 'D'),
n AS (SELECT *, max(CASE WHEN j = 1 AND role LIKE 's%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS sys FROM r),
h AS (SELECT conv_id, string_agg(coalesce(role, CASE WHEN (j - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY p) AS said FROM n GROUP BY conv_id),
u AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (li IS NOT NULL AND li || i NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.x.c, 0)::BIGINT AS cost, coalesce(best.x.a, '') AS audit, sha256(coalesce(h.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN u ON u.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id"""


RESAMPLE = rf"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
o AS MATERIALIZED (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(w) AS f FROM d) GROUP BY ALL),
hashed AS MATERIALIZED (SELECT f, {crc_sql('f')} % 10000 AS b FROM (SELECT f FROM o UNION SELECT f FROM b), crc),
s AS (SELECT b, sum(n) AS s FROM o JOIN hashed USING (f) GROUP BY b),
t AS (SELECT hashed.b, count(*) AS t FROM b JOIN hashed USING (f) GROUP BY 1),
g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT sum(t) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (b)),
w AS (SELECT r, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM o JOIN hashed USING (f) JOIN g USING (b) GROUP BY r),
x AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r)),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM z"""

ORACLE = {
    "op11_dialogue_repair": repair_sql(),
    "op12_importance_resample": RESAMPLE,
    "op1_decontamination": r"""
WITH b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + 9], ' ') AS said FROM i),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
s AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
h AS (SELECT s.r, s.p, s.n, win.item FROM s JOIN win ON s.n = win.n AND array_to_string(s.w[s.p:s.p + s.n - 1], ' ') = win.said),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)""",
    "op5_line_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, f.first IS NOT NULL AND f.first <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id""",
    "op9_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '<\|im_start\|>|<\|im_end\|>|</?s>|\[/?INST\]|<</?SYS>>|<\|endoftext\|>', '\0\\', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + length(role) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
}
