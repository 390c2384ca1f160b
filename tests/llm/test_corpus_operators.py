"""Fingerprints, near-duplicates, language ID, secrets, language model and pipeline against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quillon.llm import align, bpe, decontam, fingerprint, langid, linededup, lm, neardup, secrets, stages
from quillon.llm.common import stored
from quillon.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fingerprints(spark, odd, empty):
    docs = [(k * 3, t) for k, (_, t) in enumerate(ODD)] + [(1000, "ﬁne  Straße"), (1001, "FINE\tSTRASSE "), (1002, "other")]
    rows = {r.doc_id: r for r in fingerprint.likeness(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, (i, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        n = len(text) // 4
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(text), sha(text[: len(text) - n] + after[:n]))
    assert rows[1000].fingerprint == rows[1001].fingerprint != rows[1002].fingerprint
    assert (rows[1000].near_next, rows[1001].near_next) == (1.0, 0.0)
    assert all(r.near_edited == (r.fingerprint == r.edited_fingerprint) for r in rows.values())
    assert {r.near_edited for r in rows.values()} == {0.0, 1.0}
    assert (rows[1001].group_id, rows[1001].group_size) == (1000, 2)
    assert fingerprint.likeness(odd).count() == len(ODD)
    assert fingerprint.likeness(empty).count() == 0


def test_equal_digests_of_different_texts_part(spark):
    docs = [(1, "aaaa"), (2, "bbbb"), (3, "AAAA "), (4, "cccc"), (5, "dd"), (None, "bbbb"), (7, "dddddd"), (7, "aaaa")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = fingerprint.likeness(df, digest=lambda c: (F.length(c).cast("long"), F.lit(0).cast("long"))).collect()
    assert sorted(((r.doc_id, r.n_chars, r.group_id, r.group_size) for r in rows), key=str) == sorted(
        [(1, 4, 1, 3), (2, 4, 2, 2), (3, 5, 1, 3), (4, 4, 4, 1), (5, 2, 5, 1), (None, 4, 2, 2), (7, 6, 7, 1), (7, 4, 1, 3)], key=str)


def test_edited_texts_equal_those_of_sql(spark):
    import duckdb

    want = duckdb.sql(f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id), '') AS after FROM read_parquet('{SF}/documents.parquet'))
        SELECT doc_id, length(text), sha256(substr(text, 1, length(text) - length(text) // 4) || substr(after, 1, length(text) // 4)) FROM d""").fetchall()
    rows = QUERIES["op2_fingerprint"](spark, SF).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, rows)) == sorted(want)


def test_wide_and_negative_ids(spark):
    ids = [-(2**62), -5, 0, 7, 2**40, 2**62]
    rows = fingerprint.next_ids(spark.createDataFrame([(i,) for i in ids], "doc long")).collect()
    assert {r.doc: r.next_id for r in rows} == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def shingles(text):
    w, c, out = decontam.words(text), collections.Counter(), set()
    for k in range(max(1, len(w) - 4) if w else 0):
        g = tuple(w[k : k + 5])
        out.add((g, c[g]))
        c[g] += 1
    return out


def brute_classes(docs):
    own, parent = [shingles(t or "") for _, t in docs], list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            m = len(own[a] & own[b])
            if m and m / (len(own[a]) + len(own[b]) - m) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    least = {}
    for k, (i, _) in enumerate(docs):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: least[root(k)] for k, (i, _) in enumerate(docs)}


def test_near_duplicates(spark, odd, empty):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(400)]
    docs, passage = [], [rng.choice(vocab) for _ in range(60)]
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(80, 300))]
        for c in range(rng.choice([1, 2, 5, 90 if g == 3 else 3])):
            x = list(base)
            for _ in range(rng.randrange(3)):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            docs.append((len(docs), " ".join(x)))
    docs += [(len(docs) + k, " ".join(passage + [rng.choice(vocab) for _ in range(40)])) for k in range(90)]
    docs += [(len(docs) + k, t) for k, (i, t) in enumerate(ODD) if t and neardup.words(t)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert found == brute_classes(docs)
    rows = neardup.classes(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r.doc_id, r.class_id) for r in rows} >= {(5, 5), (6, 5), (1, 1), (2, 1), (3, 3), (9, 9)}
    assert neardup.classes(empty).count() == 0


def test_near_pairs_inside_a_large_templated_bucket(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(5000)]
    passage = [rng.choice(vocab) for _ in range(320)]
    docs = []
    for _ in range(100):
        own = [rng.choice(vocab) for _ in range(40)]
        docs.append(" ".join(passage + own))
        docs.append(" ".join(passage + own[:6] + [rng.choice(vocab) for _ in range(34)]))
    docs = list(enumerate(docs))
    want = brute_classes(docs)
    assert len(set(want.values())) == 100
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == want


def test_pairs_that_share_a_passage_with_all_others(spark):
    rng = random.Random(14)
    passage = [f"p{k}" for k in range(250)]
    docs = []
    for k in range(600):
        own = [f"w{rng.randrange(10**6)}" for _ in range(44)]
        docs.append((2 * k, " ".join(passage + own)))
        docs.append((2 * k + 1, " ".join(passage + own[:30] + [f"w{rng.randrange(10**6)}" for _ in range(14)])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert all(r.class_id == r.doc_id // 2 * 2 for r in neardup.classes(df).collect())


def test_classes_of_real_documents_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = {r.doc_id: r.class_id for r in QUERIES["op3_near_dedup"](spark, "/root/testdata/sf0.01").collect()}
    worded = [(i, t) for i, t in docs if t and neardup.words(t)]
    assert {i: found[i] for i, _ in worded} == brute_classes(worded)


def test_short_near_duplicates(spark):
    rng = random.Random(5)
    docs = []
    for g in range(150):
        base = [f"g{g}w{rng.randrange(10_000)}" for _ in range(8 + g % 16)]
        docs += [base, [f"before{g}", *base] if g % 2 else [*base, f"behind{g}"]]
    docs = [(k, " ".join(x)) for k, x in enumerate(docs)]
    want = brute_classes(docs)
    assert len(set(want.values())) == 150
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == want


def test_banded_alignment_equals_full_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = [rng.randrange(6) for _ in range(rng.randrange(3))]
        if not b:
            continue
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        need, full = neardup.needed(len(a), len(b), 0.8), table[-1, -1]
        hashed = [neardup._mixed(np.array(x, np.uint64) * np.uint64(64)) for x in (a, b)]
        got = neardup.aligned(*hashed, 0.8)
        assert (got >= need) == (full >= need)
        if full >= need:
            assert got == full


def test_alignment_from_places_equals_that_from_masks(monkeypatch):
    rng = np.random.default_rng(3)
    cases = []
    for _ in range(300):
        n, m, kinds = (int(rng.integers(1, k)) for k in (40, 40, 12))
        low = int(rng.integers(-12, 6))
        cases.append((rng.integers(0, kinds, n), rng.integers(0, kinds, m), low, low + int(rng.integers(0, 20))))
    want = [align.common(*c) for c in cases]
    monkeypatch.setattr(align, "MOST_BITS", -1)
    assert [align.common(*c) for c in cases] == want


def test_alignment_of_long_texts_in_bounded_memory():
    import tracemalloc

    a = np.arange(60_000, dtype=np.uint64)
    b = np.concatenate([a[:20_000], a[20_300:], a[:300] + np.uint64(10**9)])
    tracemalloc.start()
    assert align.common(a, b, -1000, 1000)[0] == 59_700
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # masks of all places would take 450 MB


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    rows = {r.node: r.label for r in neardup.components(stored, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {rows[100 + k] for k in range(31)} == {100}
    for a, b in edges:
        if a != b:
            assert rows[a] == rows[b] <= min(a, b)


def test_language_id(spark, odd, empty):
    rows = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    model = langid.Model({"en": np.bincount(langid.features(["the cat sat on the mat with that thing"] * 3)[1], minlength=langid.BINS), "de": np.bincount(langid.features(["der hund und die katze schlafen nicht"] * 3)[1], minlength=langid.BINS)})
    mixed = model.predict(["the cat sat on the mat with that thing " * 4 + "der hund und die katze schlafen nicht " * 6, "der hund", "12 ...", ""])
    assert mixed[0][0] == "de"
    assert mixed[0][2] == ["de", "en"]
    assert 0.5 < mixed[0][1] < 0.7
    assert mixed[1][0] == "de"
    assert mixed[2][:2] == mixed[3][:2] == ("und", 0.0)
    found = {(r.doc_id, r.text): r for r in langid.identify(odd, model).collect()}
    assert found[1, None].lang_pred == found[2, ""].lang_pred == "und"
    assert langid.identify(odd, langid.learn(empty)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


def brute_mixture(model, text):
    """Expectation-maximisation in plain Python for one document: language, share and set."""
    counts = collections.Counter(langid.features([text])[1].repeat(langid.features([text])[2]).tolist())
    if not counts:
        return "und", 0.0, []
    p = {f: [float(x) for x in model.p[f]] for f in counts}
    total, k = sum(counts.values()), len(model.langs)

    def em(share, rounds):
        for _ in range(rounds):
            new = [0.0] * k
            for f, n in counts.items():
                parts = [a * b for a, b in zip(p[f], share, strict=True)]
                for i, x in enumerate(parts):
                    new[i] += n * x / sum(parts)
            share = [x / total for x in new]
        return share, sum(n * math.log(max(1e-300, sum(a * b for a, b in zip(p[f], share, strict=True)))) for f, n in counts.items())

    share, _ = em([1 / k] * k, langid.ROUNDS)
    order = sorted(range(k), key=lambda i: (-share[i], i))
    best = None
    for size in range(1, k + 1):
        own = [share[i] if i in order[:size] else 0.0 for i in range(k)]
        own, value = em([x / sum(own) for x in own], langid.REFINE if size > 1 else 0)
        value -= size * langid.OVERLAP * 0.5 * math.log(max(total, 2))
        if best and value <= best[0]:
            break
        best = value, own
    top = max(range(k), key=lambda i: (best[1][i], -i))
    return model.langs[top], best[1][top], [model.langs[i] for i in range(k) if best[1][i] > 0]


def test_language_mixtures_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    texts = [t[:1500] for t in texts[:60]] + [a[:300] + " " + b[:400] + " " + c[:200] for a, b, c in zip(texts[:25], texts[25:50], texts[50:75], strict=True)] + ["", "7 + 8", "x"]
    mixed = 0
    for text, (lang, score, langs) in zip(texts, model.predict(texts), strict=True):
        want = brute_mixture(model, text)
        assert (lang, langs) == (want[0], want[2])
        assert score == pytest.approx(want[1], abs=2e-3)
        mixed += len(langs) > 1
    assert mixed >= 10


def test_hundreds_of_labels(spark):
    rng = random.Random(1)
    docs = [(k, " ".join("".join(rng.choice(a) for _ in range(6)) for _ in range(20)), f"l{g:03}") for g, a in enumerate("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(300)) for k in range(2 * g, 2 * g + 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    model = langid.learn(df)
    assert len(model.langs) == 300
    rows = langid.identify(df, model).collect()
    assert sum(r.lang_pred == r.lang for r in rows) > 570


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def brute_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark, odd, empty):
    rng = random.Random(6)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(20)]
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(20)]
    texts = ["🙂 password = 'hunter22', Token:abc token=token: abcdefgh", "token=key=x API_KEY:  \"a.b-c=d/e\"", "AKIA" + "A1" * 8 + " AKIAAKIA xAKIA" + "B" * 30, "id " + hexes[0] + hexes[1] + "g" + hexes[2][:23], "secret=" + "a" * 24]
    texts += [f"é value {x} end" for x in hexes + keys] + ["thisisaverylongreadablewordwithoutanybreaks inthemiddle" * 2, "=" * 60] + [t or "" for _, t in ODD]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secrets.digests(secrets.scan(df)).orderBy("doc_id").collect()
    for text, r in zip(texts, rows, strict=True):
        want = brute_secrets(text)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(m[1] == k for m in want) for k in range(3)]
        said = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == sha(",".join(said))
        assert [x for x in r.spans.split(",") if x and not x.startswith("rand")] == said
    random_ones, readable = rows[5:45], rows[45:47]
    assert sum(r.n_rand for r in random_ones) >= 30
    assert all(r.n_rand == 0 for r in readable)
    assert secrets.scan(odd).count() == len(ODD)
    assert secrets.digests(secrets.scan(empty)).count() == 0


def below(z):
    return max(0.5 * math.erfc(-z / math.sqrt(2)), 1e-39)


def brute_battery(texts):
    """start, end and chance of the candidates of all texts, one by one."""
    run = re.compile(rf"(?<![{secrets.RUN_CHARS}])[{secrets.RUN_CHARS}]{{{secrets.MIN_RUN},}}")
    out = []
    for k, text in enumerate(texts):
        for m in run.finditer(text):
            body = m[0].replace("-", "") if re.fullmatch("[0-9a-f]+(-[0-9a-f]+)+|[0-9A-F]+(-[0-9A-F]+)+", m[0]) else m[0]
            name, letters = next((n, a) for n, a in secrets.ALPHABETS.items() if set(body) <= set(a))
            n, size, count = len(body), len(letters), collections.Counter(body)
            chi = sum((count[c] - n / size) ** 2 / (n / size) for c in letters)
            excess = size * (0.1 if name.startswith("hex") else sum(p * p for p in secrets.LETTER_SHARE)) - 1
            even = below((chi - (size - 1 + n * excess)) / math.sqrt(2 * (size - 1 + 2 * n * excess)))
            codes = [letters.index(c) + 1 for c in body]
            high = [c > size / 2 for c in codes]
            up, runs, mean = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:], strict=False)), sum(codes) / n
            expected = 2 * up * (n - up) / n + 1
            var = (expected - 1) * (expected - 2)
            runs_z = (runs - expected) / math.sqrt(var / (n - 1)) if var > 0 else math.sqrt(n)
            spread = sum((c - mean) ** 2 for c in codes)
            serial_z = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:], strict=False)) / spread * math.sqrt(n) if spread else math.sqrt(n)
            chances = [even, *(max(1e-3, 1 - 2 * below(-abs(z))) for z in (runs_z, serial_z))]
            x = -sum(w * math.log(p) for w, p in zip(secrets.WEIGHTS, chances, strict=True))
            a, b, c = secrets.WEIGHTS
            tail = a * a / (a - b) / (a - c) * math.exp(-x / a) + b * b / (b - a) / (b - c) * math.exp(-x / b) + c * c / (c - a) / (c - b) * math.exp(-x / c)
            chance = 1.0 if max(abs(runs_z), abs(serial_z)) > secrets.REGULAR else min(1.0, tail)
            out.append((k, m.start(), m.end(), chance))
    return out


def test_battery_against_brute_force(spark):
    rng = random.Random(11)
    made = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    texts += [f"x {made(rng.randrange(20, 90), a)} 🙂 {made(30, 'etaoin')} {'abcdefghij' * 5} {'A' * 40}" for a in secrets.ALPHABETS.values() for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tested = df.select("doc_id", secrets.tested(f"({secrets.spans_sql('text', secrets.RUN, 'rand')})").alias("r")).select("doc_id", F.explode("r").alias("r")).select("doc_id", "r.start", "r.end", "r.chance").collect()
    want = brute_battery(texts)
    assert len(want) > 150
    found = {(r.doc_id, r.start, r.end): r.chance for r in tested}
    assert set(found) == {x[:3] for x in want}
    for *at, chance in want:
        assert math.log(found[tuple(at)]) == pytest.approx(math.log(max(chance, 1e-39)), abs=0.02 + 1e-3 * abs(math.log(max(chance, 1e-39))))
    # Benjamini and Hochberg over all chances, on the operator's bins
    bins = sorted(min(secrets.BINS - 1, math.floor(-10 * math.log10(found[x[:3]]))) for x in want)[::-1]
    least = min((b for k, b in enumerate(bins) if 10 ** (-b / 10) <= secrets.FALSE_SHARE * sum(y >= b for y in bins) / len(bins)), default=secrets.BINS)
    passed = {k for k, c in found.items() if min(secrets.BINS - 1, math.floor(-10 * math.log10(c))) >= least}
    rows = secrets.digests(secrets.scan(df)).collect()
    assert {(r.doc_id, int(a), int(b)) for r in rows for kind, a, b in (x.split(":") for x in r.spans.split(",") if x) if kind == "rand"} == passed
    assert passed


def test_many_secrets_in_one_text(spark):
    df = spark.createDataFrame([(1, "token=abcdef " * 64_000)], "doc_id long, text string")
    r = secrets.digests(secrets.scan(df)).first()
    assert r.n_assign == 64_000
    assert r.spans.endswith(f"assign:{13 * 63_999}:{13 * 63_999 + 12}")


def test_very_long_runs(spark):
    rng = random.Random(8)
    alphabet = secrets.ALPHABETS["base64"][:64]
    long = "".join(rng.choices(alphabet, k=6_000_000))
    dashed = "-".join(["ab12cd34"] * 200_000)
    texts = ["begin " + long + " end", "x" * 3_000_000, dashed, "=" * 30, "a" * 20, long[: secrets.BLOCK * secrets.BLOCKS + 1], long[: secrets.BLOCK + 2]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.added] for r in secrets.scan(df).collect()}
    assert found[0] == [(6, 6 + len(long))] and found[5] == [(0, len(texts[5]))] and found[6] == [(0, len(texts[6]))]
    assert found[1] == found[2] == found[4] == []
    runs = df.where("doc_id IN (5, 6)").select("text", secrets.spans("text", secrets.RUN, "rand").alias("runs")).withColumn("runs", secrets.tested("runs")).collect()
    for r in runs:  # blocks leave no pair of neighbours out
        codes = np.array([secrets.ALPHABETS["base64"].index(c) + 1 for c in r.text], float)
        off = codes - codes.mean()
        assert r.runs[0].serial_z == pytest.approx((off[1:] * off[:-1]).sum() / (off * off).sum() * math.sqrt(len(codes)), abs=1e-6)


def test_upper_case_and_dashed_hexadecimal(spark):
    rng = random.Random(8)
    run = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    upper = [run(64, "0123456789ABCDEF") for _ in range(20)]
    dashed = ["-".join(run(n, "0123456789abcdef") for n in (16, 16, 16, 16)) for _ in range(20)]
    readable = ["thisisaverylongreadablewordwithoutanybreaks", "a-long-chain-of-words-with-dashes-between-them", "2024-01-01-2024-01-01-2024-01-01"]
    df = spark.createDataFrame(list(enumerate(f"key {x} end" for x in upper + dashed + readable)), "doc_id long, text string")
    n = [r.n_rand for r in secrets.digests(secrets.scan(df)).orderBy("doc_id").collect()]
    assert sum(n[:20]) >= 16
    assert sum(n[20:40]) >= 16
    assert sum(n[40:]) == 0


def test_language_model(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op8_lm_score"](spark, SF).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)), "\0END"] for i, t in docs}
    c = collections.Counter(w for i, x in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    n, v = sum(c.values()), len(c)
    for r in rows:
        x = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(c[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    out = lm.score(odd.withColumn("h", F.lit(False)), "h").collect()
    assert sorted(map(str, (r.doc_id for r in out))) == sorted(str(i) for i, _ in ODD)
    assert all(r.score < 0 for r in out)
    assert lm.score(empty.withColumn("h", F.lit(False)), "h").count() == 0
    none = lm.score(odd.withColumn("h", F.lit(True)), "h").collect()
    assert len(none) == len(ODD)
    assert all((r.score, r.base_score, r.n_known, r.train_tokens) == (0, 0, 0, 0) for r in none)


def test_seating_follows_the_restaurant():
    rng = np.random.default_rng(0)
    d = 0.7
    tables, sizes = lm.arrangement(np.full(6000, 30), np.full(6000, 2.0), d, rng)
    assert sizes.sum() == 6000 * 30
    assert (np.add.reduceat(sizes, np.cumsum(tables) - tables) == 30).all()
    # number of tables of 30 customers, and of tables with one customer, one customer after the other
    want = np.zeros((6000, 2))
    for row in want:
        seats = [1]
        for j in range(1, 30):
            x = rng.random() * (j - d * len(seats) + 2.0)
            if x < 2.0:
                seats.append(1)
            else:
                x -= 2.0
                for k, n in enumerate(seats):
                    x -= n - d
                    if x < 0 or k == len(seats) - 1:
                        seats[k] += 1
                        break
        row[:] = len(seats), seats.count(1)
    assert tables.mean() == pytest.approx(want[:, 0].mean(), rel=0.02)
    assert tables.std() == pytest.approx(want[:, 0].std(), rel=0.05)
    assert (sizes == 1).sum() / 6000 == pytest.approx(want[:, 1].mean(), rel=0.03)
    assert lm.arrangement(np.array([1, 1]), np.ones(2), d, rng)[0].tolist() == [1, 1]
    few = lm.arrangement(np.full(400, 1999), np.full(400, 40.0), d, rng)[0]  # all at once, and each for itself
    many = lm.arrangement(np.full(400, 2001), np.full(400, 40.0), d, rng)[0]
    assert few.mean() == pytest.approx(many.mean(), rel=0.02)
    assert few.std() == pytest.approx(many.std(), rel=0.15)
    big, sizes = lm.arrangement(np.array([10**9]), np.array([5.0]), d, rng)
    assert big[0] == len(sizes) < 10**9
    assert sizes.sum() == 10**9


def test_sweeps_leave_the_distribution_as_it_is():
    rng = np.random.default_rng(1)
    n, c, a, d = 4000, 6, 1.5, 0.6
    # all arrangements of 6 customers with fixed chances: weight a^tables * product of Gamma(size - d) / Gamma(1 - d)
    def parts(left, most):
        if not left:
            yield []
        for x in range(min(left, most), 0, -1):
            for rest in parts(left - x, x):
                yield [x, *rest]

    total = mean = 0.0
    for p in parts(c, c):
        ways = math.factorial(c)
        for x in p:
            ways /= math.factorial(x)
        for k in collections.Counter(p).values():
            ways /= math.factorial(k)
        w = ways * a ** len(p) * math.prod(math.gamma(x - d) / math.gamma(1 - d) for x in p)
        total, mean = total + w, mean + w * len(p)
    seats = lm.Seats(np.ones(n, int), np.full(n, c))
    for _ in range(12):
        seats.room(8)
        for _ in range(8):
            seats.leave(n, rng)
            seats.sit(n, np.full(n, a), d, rng)
        seats.close()
        assert seats.sizes.sum() == n * c
        assert len(seats.sizes) == seats.tables.sum()
    assert seats.tables.mean() == pytest.approx(mean / total, rel=0.02)


def brute_model(tokens, learned, discount, above, sweeps=40, burn=20):
    """Mean probability of each pair of a document, times its number: Gibbs sampling of one customer after the other."""
    rng, theta = random.Random(3), lm.STRENGTH
    pairs = [(u, w) for x in learned for u, w in zip(["\0END", *x], x, strict=False)]
    vocab = {w for _, w in pairs}
    low, high = collections.defaultdict(lambda: collections.defaultdict(list)), collections.defaultdict(list)

    def p0(w):
        n, t = sum(map(sum, high.values())), sum(map(len, high.values()))
        return (max(0, sum(high[w]) - above * len(high[w])) + (theta + above * t) / (len(vocab) + 1)) / (theta + n)

    def sit(tables, new, d):
        x = rng.random() * (sum(tables) - d * len(tables) + new)
        for k, n in enumerate(tables):
            x -= n - d
            if x < 0:
                tables[k] += 1
                return False
        tables.append(1)
        return True

    def leave(tables):
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def add(u, w):
        if sit(low[u][w], (theta + discount * sum(map(len, low[u].values()))) * p0(w), discount):
            sit(high[w], (theta + above * sum(map(len, high.values()))) / (len(vocab) + 1), above)

    for u, w in pairs:
        add(u, w)
    out = collections.Counter()
    for k in range(sweeps):
        for u, w in pairs:
            if leave(low[u][w]):
                leave(high[w])
            add(u, w)
        if k >= burn:
            for i, x in tokens.items():
                for u, w in zip(["\0END", *x], x, strict=False):
                    own = low[u][w] if w in low[u] else []
                    p = (max(0, sum(own) - discount * len(own)) + (theta + discount * sum(map(len, low[u].values()))) * p0(w)) / (theta + sum(map(sum, low[u].values())))
                    out[i, u, w] += p / (sweeps - burn)
    return out


def test_scores_equal_those_of_a_plain_sampler(spark):
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(25)]
    docs = [(k, " ".join(vocab[min(24, int(rng.expovariate(0.2)))] for _ in range(15))) for k in range(25)]
    docs += [(100 + k, " ".join(rng.choice([*vocab, "new"]) for _ in range(12))) for k in range(6)]
    tokens = {i: [*t.split(), "\0END"] for i, t in docs}
    learned = [tokens[i] for i in tokens if i < 100]
    c = collections.Counter((u, w) for x in learned for u, w in zip(["\0END", *x], x, strict=False))
    types = collections.Counter(w for _, w in c)
    ratio = lambda n: min(0.95, max(0.05, sum(x == 1 for x in n) / max(1, sum(x == 1 for x in n) + 2 * sum(x == 2 for x in n)))) if 1 in n else 0.5
    p = brute_model(tokens, learned, ratio(list(c.values())), ratio(list(types.values())))
    times = collections.Counter((i, u, w) for i, x in tokens.items() for u, w in zip(["\0END", *x], x, strict=False))
    want = collections.Counter()
    for (i, u, w), n in times.items():
        want[i] += n * math.log10(p[i, u, w] / n)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("held", F.col("doc_id") >= 100)
    rows = lm.score(df, "held").collect()
    for r in rows:
        assert r.score == pytest.approx(want[r.doc_id], rel=0.06)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    assert sum(r.score for r in rows) == pytest.approx(sum(want.values()), rel=0.015)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    counts = rng.poisson(0.7, (30, 40))
    tables = np.where(counts > 0, rng.binomial(np.maximum(counts - 1, 0), 0.4) + 1, 0)
    n = tables.sum(axis=0)
    above = np.where(n > 0, rng.binomial(np.maximum(n - 1, 0), 0.3) + 1, 0)
    share = lm.predictive(np.append(n, 0), np.append(above, 0), n.sum(), above.sum(), 1 / 41, 0.4)
    assert share.sum() == pytest.approx(1)
    for c, t in zip(counts, tables, strict=True):
        assert lm.predictive(np.append(c, 0), np.append(t, 0), c.sum(), t.sum(), share, 0.6).sum() == pytest.approx(1)


def test_shards_cut_a_frequent_word():
    word = np.repeat(np.array([5, 9, 20], np.uint64) << np.uint64(16), 6)
    context = np.tile(np.arange(6, dtype=np.uint64) * np.uint64(10), 3)
    bounds = (np.array([9, 9, 20], np.uint64), np.array([15, 40, 0], np.uint64))
    assert lm.shard_of(word, context, bounds).tolist() == [0] * 6 + [0, 0, 1, 1, 2, 2] + [3] * 6


def test_known_words_score_above_unknown_ones(spark):
    words = ["a", "b", "c", "d"]
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice(words) for _ in range(20))) for k in range(60)]
    probe = [(1000 + k, f"a {w}") for k, w in enumerate([*words, "unknown"])] + [(2000, "a")]
    df = spark.createDataFrame([*docs, *probe], "doc_id long, text string").withColumn("held", F.col("doc_id") >= 1000)
    scores = {r.doc_id: r.score for r in lm.score(df, "held").collect()}
    assert all(s < 0 for s in scores.values())
    assert max(scores[1000 + k] for k in range(4)) > scores[1004]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    found = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_pipeline_stages(spark, odd, benchmark, tmp_path):
    more = spark.createDataFrame([(50, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu and more words here", "en", "s", 1, "x", "y", 1, "z")], odd.schema)
    clashing = ("score", "lang_pred", "langs", "keep_bitmap", "n_words", "items", "digest", "class_id", "label", "_row", "row")
    docs = odd.union(more).withColumns({c: F.concat(F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in clashing})
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (name, stage) in enumerate(stages.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == docs.columns
            for r in out.collect():
                assert all(r[c] == f"own {c} {r.doc_id if r.doc_id is not None else '-'}" for c in clashing)
                assert (r.node, r.bitmap, r.key, r.spans) == ("x", "y", 1, "z")
        ids = collections.Counter(r.doc_id for r in out.collect())
        if name == "language_id":
            assert 1 not in ids and 2 not in ids and ids[5] == 2
        if name == "line_dedup":
            assert out.where("doc_id = 10").first().text == "line one is long enough\nline two is long enough"
            assert out.where("doc_id = 11").first().text == "other"
        if name == "near_dedup":
            assert ids[5] == 1
        if name == "decontaminate":
            assert 50 not in ids
        docs = out
    assert docs.where("NOT lossless").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_of_empty_tables(spark, empty, benchmark, tmp_path, k):
    benchmark.limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stages.STAGES[k][1](spark, empty, str(tmp_path))
    assert out.count() == 0
    assert k == 4 or out.columns == empty.columns


def test_near_dedup_keeps_one_document_of_each_class_without_or_with_shared_ids(spark):
    words = lambda k: " ".join(f"t{k}w{j}" for j in range(30))
    docs = [(None, words(1)), (None, words(2)), (None, words(2)), (7, words(3)), (7, words(4)), (None, words(5)), (9, words(5)), (8, words(5))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.text, r.doc_id) for r in stages.near_dedup(spark, df, "").collect())
    assert kept == [(words(1), None), (words(2), None), (words(3), 7), (words(4), 7), (words(5), 8)]


def test_pipeline_against_the_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in langid.identify(docs, langid.learn(docs)).where("lang_pred <> 'und' AND score >= 0.5").collect()}
    own = spark.createDataFrame(sorted(kept.items()), "doc_id long, text string")
    kept = {r.doc_id: r.text for r in linededup.apply_bitmaps(linededup.with_bitmaps(own, linededup.keep_bitmaps(own))).collect()}
    worded = sorted((i, t) for i, t in kept.items() if neardup.words(t))
    classes = brute_classes(worded)
    first = {t: i for i, t in sorted(kept.items(), reverse=True)}
    kept = {i: t for i, t in kept.items() if classes.get(i, first[t]) == i}
    rows = {r.doc_id: r for r in stages.run(spark, SF).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [decontam.words(t)] for i in range(max(1, len(w) - 9))}
    clean = {i: t for i, t in kept.items() if not any(tuple(decontam.words(t)[k : k + 10]) in windows for k in range(len(decontam.words(t))))}
    assert set(rows) == set(clean)
    b = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for (i, t), (ids, joined) in zip(clean.items(), b.encode(list(clean.values())), strict=True):
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), sha(joined))
