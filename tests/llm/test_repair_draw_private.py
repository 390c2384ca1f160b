"""Conversation repair, importance resampling and personal data against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from array import array

import duckdb
import numpy as np
import pytest

from quillon.llm import dialogue, pii, resample
from tests.llm.conftest import ODD

LANGUAGE = re.compile(r"(s?(ua)+)?")


def brute_repair(rows):
    """(cost, audit, role initials) over all lists of edits of rows (initial, fault), with insertions anywhere."""
    n, found = len(rows), []

    def walk(k, cost, audit, said):
        if cost > 4 * n + 6 or len(said) > n + 4:
            return
        if k == n and LANGUAGE.fullmatch(said):
            found.append((cost, audit, said))
        walk_insert = [("I", "u"), ("I", "a")] if not audit.endswith("III") else []
        for x, role in walk_insert:
            walk(k, cost + 3, audit + x, said + role)
        if k < n:
            initial, fault = rows[k]
            walk(k + 1, cost + 4, audit + "D", said)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                walk(k + 1, cost + more, audit + "K", said + initial)
                for role in "ua":
                    walk(k + 1, cost + 3 + more, audit + "R", said + role)

    walk(0, 0, "", "")
    return min(found)


def plain_repair(rows):
    """The same by a table over (row, state), for longer lists."""
    inf = (10**9, "")
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def closed(v):
        for _ in range(3):
            for p, q in ((0, 2), (1, 2), (3, 2), (2, 3)):
                v[q] = min(v[q], (v[p][0] + 3, v[p][1] + "I"))
        return v

    v = closed([(0, ""), inf, inf, inf])
    for initial, fault in rows:
        w = [(c + 4, a + "D") for c, a in v]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            for p in range(4):
                for role, q in step[p].items():
                    if role == initial:
                        w[q] = min(w[q], (v[p][0] + more, v[p][1] + "K"))
                    if role != "s":
                        w[q] = min(w[q], (v[p][0] + 3 + more, v[p][1] + "R"))
        v = closed(w)
    return min(v[0], v[3])


def symbol(initial, fault):
    return dialogue.MUST_GO if fault in ("blank", "duplicate") else 2 * "sua?".index(initial) + (fault == "truncated")


def test_cheapest_edits_equal_those_of_all_lists():
    machine = dialogue.Automaton()
    for n in range(4):
        for rows in itertools.product(itertools.product("sua?", (None, "truncated", "blank")), repeat=n):
            if n == 3 and hash(rows) % 9:
                continue
            cost, audit, kept, roles = machine.repair(bytearray(symbol(*r) for r in rows), array("q", [1] * n))
            assert (cost, audit) == brute_repair(rows)[:2]
            said = "".join(rows[k][0] if r == 0 else dialogue.ROLES[r][0] for k, r in zip(kept, roles, strict=True))
            assert LANGUAGE.fullmatch(said)
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.choice("suuaa?"), rng.choice([None, None, None, "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(60))]
        assert machine.repair(bytearray(symbol(*r) for r in rows), array("q", [1] * len(rows)))[:2] == plain_repair(rows)
    assert len(machine.vectors) < 200  # vectors are few, however long the rows


def brute_summary(rows):
    """Of (turn, role, text) rows of one conversation: SUMMARY's fields and the repaired text."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = plain_repair([((r[:1] if r[:1] in ("s", "u", "a") else "?"), f) for (_, r, _), f in zip(rows, faults, strict=True)])
    out, k = [], 0
    for x in audit:
        role = "assistant" if out and out[-1].startswith("u") else "user"
        if x in "KR":
            out.append(f"{rows[k][1] if x == 'K' else role}:{rows[k][2]}")
        elif x == "I":
            out.append(f"{role}:")
        k += x != "I"
    count = collections.Counter(faults)
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def repaired(spark, rows, conversations=None):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, audit string, pos int").repartition(3)
    ids = df if conversations is None else spark.createDataFrame(conversations, "conv_id long")
    return {r.conv_id: tuple(r)[1:] for r in dialogue.digests(ids, *dialogue.repair(df)).collect()}


def test_conversations(spark):
    rng = random.Random(2)
    said = ["Hello there.", "And", "ok!", "", " \n", None, "Well?", "é 🙂", "Hello there."]
    rows = [(rng.choice([1, 2, 3, 4, None]), rng.choice([1, 2, 3, 7, None]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(said)) for _ in range(150)]
    rows += [(9, k, ("user", "assistant")[k % 2], "the same") for k in range(400)]  # one conversation with most of the rows
    rows += [(10, 0, "user", "again and again.")] * 500  # and one row many times
    rows += [(11, 5, "assistant", "x" * 200_000)]
    got = repaired(spark, [(*r, "x", 1) for r in rows], [(c,) for c in (1, 2, 3, 4, None, 9, 10, 11, 77)])
    by = collections.defaultdict(list)
    for c, *r in rows:
        by[c].append(tuple(r))
    assert got.pop(77) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: brute_summary(r) for c, r in by.items()}
    assert repaired(spark, [], []) == {}


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in (0, 1, None)]
    got = collections.Counter(tuple(r) for r in dialogue.damaged(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect())
    want = collections.Counter()
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        if fault:
            want[c, t, "user" if fault == 4 else role, {1: "", 2: "One Two"}.get(fault, text)] += 1 + (fault == 3)
    assert got == want


WORDS = re.compile(resample.WORD)


def brute_draw(docs, target, n, buckets, seed, percent, least):
    def words(t):
        return WORDS.findall((t or "").translate(str.maketrans(resample.UPPER, resample.LOWER)))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[k : k + m]).encode()) % buckets for m in range(1, n + 1) for k in range(len(w) - m + 1)]

    s, t = (collections.Counter(b for x in texts for b in features(x)) for texts in ([x for _, x in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for key, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((len(words(text)), key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    able = [(*r[1:], k + 1 if k < percent * len(able) // 100 else None) for k, r in enumerate(able)]
    return sorted([*able, *((*r[1:], None) for r in rows if r[0] < least)], key=str)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_draw_against_brute_force(spark, odd, n):
    rng = random.Random(n)
    words = [f"w{k}" for k in range(40)] + ["É", "x-y", "don't"]
    docs = [*ODD, *((100 + k, " ".join(rng.choices(words, k=rng.randrange(60)))) for k in range(120)), *((500, "w1 " * 30) for _ in range(9))]
    target = ["W1 w2 w3 w1 w2", None, "x-y É w3"]
    df = spark.createDataFrame([(*d, "k", 3) for d in docs], "doc_id long, text string, key string, weight int").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(df, goal, n=n, buckets=64, seed="7", percent=30, least_words=20)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_draw(docs, target, n, 64, "7", 30, 20)


def test_draw_of_empty_tables(spark, empty, odd):
    assert resample.resample(empty, odd).count() == 0
    assert resample.resample(odd, empty).count() == len(ODD)


# The contract's patterns as they stand.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = sum(sum(map(int, str(int(d) * (1 + k % 2)))) for k, d in enumerate(reversed(digits)))
            if {"email": True, "ip": kind != "ip" or max(map(int, m.group().split("."))) <= 255, "card": 14 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_base_patterns_equal_plain_ones():
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "@@", ".", "-", "_", "1", "255", "256", "4111111111111111", " ", "+1", "+49 (30) 1234567", "(", ")", "1.2.3.4", "é", "x@y.z", "0", "4111 1111 1111 1111", "+"]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randrange(14)))
        assert pii.base_spans(text) == brute_base(text), text


def test_crf_and_gradients_against_enumeration(monkeypatch):
    monkeypatch.setattr(pii, "WINDOW", 4)
    rng = np.random.default_rng(0)
    scores = rng.standard_normal((4, 2, pii.N_TAGS)).astype(np.float32)
    t = rng.standard_normal((pii.N_TAGS, pii.N_TAGS)).astype(np.float32)
    whole, marginal, expected = pii.crf(scores, t)
    for r in range(2):
        weights = {}
        for path in itertools.product(range(pii.N_TAGS), repeat=4):
            if not any(pii.FORBIDDEN[a, b] for a, b in itertools.pairwise(path)):
                weights[path] = math.exp(sum(scores[k, r, g] for k, g in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path)))
        total = sum(weights.values())
        assert whole[r] == pytest.approx(math.log(total), abs=1e-4)
        assert marginal[2, r, 3] == pytest.approx(sum(w for p, w in weights.items() if p[2] == 3) / total, abs=1e-5)
    assert expected.sum() == pytest.approx(6, abs=1e-3)  # three steps of two rows
    p = pii.fresh(rng)
    x, y = rng.integers(0, pii.N_CHARS - 1, (3, 4)), np.array([[0, 1, 2, 0], [3, 4, 4, 4], [0, 0, 7, 0]])
    _, grads = pii.loss(p, x, y)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(np.where(pii.FORBIDDEN, 0, g) if name == "t" else g).argmax(), g.shape)
        old, step = p[name][at], np.float32(0.02)
        above, below = ((p[name].__setitem__(at, old + s), pii.loss(p, x, y)[0])[1] for s in (step, -step))
        p[name][at] = old
        assert (above - below) / (2 * step) == pytest.approx(float(g[at]), rel=0.05, abs=2e-3), name


def test_reconciled_spans_have_the_highest_sum():
    rng = random.Random(3)
    for _ in range(200):
        spans = {}
        for _ in range(rng.randrange(9)):
            a = rng.randrange(30)
            spans[a, rng.randrange(4), a + rng.randrange(1, 9)] = rng.uniform(1, 9)
        taken = [(12, 0, 15), (20, 2, 21)]
        able = [s for s, odds in spans.items() if odds >= pii.LEAST and all(s[2] <= a or s[0] >= b for a, _, b in taken)]
        best = max(sum(spans[s] for s in some) for k in range(len(able) + 1) for some in itertools.combinations(able, k) if all(x[2] <= y[0] or y[2] <= x[0] for x, y in itertools.combinations(some, 2)))
        got = pii.reconciled(spans, taken)
        assert set(got) <= set(able) and sum(spans[s] for s in got) == pytest.approx(best)
        assert all(x[2] <= y[0] for x, y in itertools.pairwise(got))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def model(documents):
    return pii.learn(documents)


def test_other_spellings_are_found_and_clean_texts_left_alone(spark, documents, model):
    rng = np.random.default_rng(77)
    made = [pii.made(rng) for _ in range(800)]
    prose = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE NOT regexp_matches(text, '[0-9@]') AND length(text) > 500 LIMIT 60").fetchall()
    rows, where = [], []
    for k, (item, kind) in enumerate(made):
        text = prose[k % 60][0]
        cut = text.index(" ", 40 + k % 200)
        rows.append((k, f"{text[:cut]} {item} {text[cut + 1:]}"))
        where.append((cut + 1, kind, cut + 1 + len(item)))
    found = {r.doc_id: [tuple(s) for s in [*r.base, *r.added]] for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    items = [k for k, (_, kind) in enumerate(made) if kind >= 0]
    hit = sum(any(a < where[k][2] and b > where[k][0] and r == where[k][1] for a, r, b in found[k]) for k in items)
    base = sum(any(a < where[k][2] and b > where[k][0] for a, _, b in pii.base_spans(rows[k][1])) for k in items)
    assert hit / len(items) > 0.85 > 0.6 > base / len(items)
    alike = [k for k, (_, kind) in enumerate(made) if kind < 0]
    assert sum(len(found[k]) - len(pii.base_spans(rows[k][1])) for k in alike) <= 0.06 * len(alike)
    assert all(not r.added for r in pii.scan(documents, model).collect())


def test_odd_texts_and_base_spans_of_documents(spark, odd, empty, documents, model):
    rows = pii.scan(documents, model).collect()
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert all([tuple(s) for s in r.base] == brute_base(texts[r.doc_id]) for r in rows)
    assert pii.digests(pii.scan(odd, model)).count() == len(ODD)
    assert pii.digests(pii.scan(empty, model)).count() == 0
    long = [(1, "7" * 2_000_000), (2, "a1." * 400_000 + "@b.c"), (3, "1-" * 500_000), (4, None)]
    got = {r.doc_id: r for r in pii.digests(pii.scan(spark.createDataFrame(long, "doc_id long, text string"), model)).collect()}
    assert got[2].spans.startswith("email:0:1200004") and got[4].spans == "" and got[1].n_card == 0


def test_a_corpus_without_digits_still_gives_a_model(spark):
    model = pii.learn(spark.createDataFrame([("only words",), (None,)], "text string"), steps=2)
    assert pii.scan(spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string"), model).first().base[0].end == 6
