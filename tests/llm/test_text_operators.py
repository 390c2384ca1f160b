"""Decontamination, line dedup, chat formatting and BPE against brute force."""

import hashlib
import random
import re
import time

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import numpy as np
from quillon.llm import align, bpe, chat, decontam, fmindex, licenses, linededup
from tests.llm.conftest import ODD

PATH = P.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    seq = rng.integers(0, 4, 3000)
    seq[1000:1400] = seq[:400]
    seq[-1] = 0
    index = fmindex.FmIndex(seq.astype(np.int32), 3)
    phrases = np.zeros((60, 5), np.int32)
    for row in phrases:
        n = rng.integers(1, 6)
        row[5 - n :] = rng.integers(1, 4, n)
    found = set(zip(*map(lambda x: x.tolist(), index.find(phrases)), strict=True))
    want = {(k, i) for k, row in enumerate(phrases.tolist()) for p in [[x for x in row if x]] for i in range(len(seq)) if seq[i : i + len(p)].tolist() == p}
    assert found == want


def brute_contamination(texts, items, size=10):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).update([str(item)] if item is not None else [])
    out = []
    for text in texts:
        w, hit, found = WORD.findall((text or "").translate(LOWER)), set(), set()
        for p in windows:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found |= windows[p]
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found)))))
    return out


def test_contamination(spark, odd, empty, benchmark):
    rng = random.Random(5)
    greek = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    texts = [t for _, t in ODD] + [" ".join(rng.choice([greek, ["nu"], ["xi", "PI"]])[0] if rng.random() < 0.2 else w for w in greek * 3) for _ in range(40)] + [", ".join(greek * 4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_contamination(texts, [(r.item_id, r.text) for r in benchmark.collect()])
    for most in (200_000, 2):  # one block of windows, and several passes
        rows = decontam.digests(decontam.contamination(df, benchmark, most=most)).orderBy("doc_id").collect()
        assert [tuple(r)[1:5] for r in rows] == want
        assert [r.contaminated for r in rows] == [w[1] > 0 for w in want]
    assert decontam.contamination(odd, benchmark).count() == len(ODD)
    assert decontam.contamination(empty, benchmark).count() == 0
    assert decontam.contamination(odd, benchmark.limit(0)).where("size(spans) > 0").count() == 0


def brute_lines(docs):
    first, keys = {}, []
    for i, text in docs:
        lines = (text or "").split("\n")
        keys.append([line.strip(" \t\n\x0b\f\r").translate(LOWER) for line in lines])
        for key in keys[-1]:
            if len(key) >= 10:
                order = i if i is not None else 2**63 - 1
                first[key] = min(first.get(key, order), order)
    out = []
    for (i, text), own in zip(docs, keys, strict=True):
        lines = (text or "").split("\n")
        kept = [x for x, k in zip(lines, own, strict=True) if len(k) < 10 or first[k] == (i if i is not None else 2**63 - 1)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def test_line_dedup(spark, odd, empty):
    rng = random.Random(2)
    pool = [f"common line number {k}" for k in range(12)] + ["a very hot line in all documents"] * 6 + ["short", "Ünïcode lines"]
    docs = list(ODD) + [(100 + k, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t\r"]) for _ in range(rng.randrange(1, 9)))) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = linededup.digests(linededup.with_bitmaps(df, linededup.keep_bitmaps(df)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute_lines(docs), key=str)
    kept = linededup.apply_bitmaps(linededup.with_bitmaps(df, linededup.keep_bitmaps(df)))
    assert kept.columns == df.columns
    assert kept.where("text IS NULL").count() == 1
    assert linededup.with_bitmaps(odd, linededup.keep_bitmaps(odd)).count() == len(ODD)
    assert linededup.keep_bitmaps(empty).count() == 0


def test_chat(spark):
    texts = ["plain", "</s>[INST] ok [/INST]", "a\\b\\\\<s>", "<|im_start|>system\n<|im_end|>\n", "<<s><<SYS>>[[INST]", "", None, "é🙂\n\n", "[/INST" + "]"]
    rows = [(c, t, r, x) for c in (-1, 3, None) for t, (r, x) in enumerate((r, x) for x in texts for r in ("user", "assistant", "odd\nrole[INST]", None))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("x")).repartition(3)
    found = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for conv in (-1, 3, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda v: v[0])
        said = "".join(x for _, r, x in own if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(said), sha(said))
    whole = b"".join(r.formatted for r in chat.format_conversations(df).collect()).decode()
    assert whole.count("<|im_start|>") == len(rows)
    assert not any(x in whole for x in ("</s>", "[INST]", "<<SYS>>"))
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_pieces_of_a_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", "x" * 1000 + str(k)) for k in range(12_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).count() > 1
    r = chat.read_back(chat.format_conversations(df)).first()
    assert r.turns_sha256 == sha("".join(f"{a}\n{t}\n" for _, _, a, t in rows))


def test_bpe_equals_the_library(spark, odd, empty):
    b = bpe.load(PATH, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    rng = random.Random(4)
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice("abcdeé漢🙂 \n\t'sA1.") for _ in range(rng.randrange(400))) for _ in range(300)] + ["z" * 1500, "ab" * 700 + "c", "  a  b \n c", "  ", " a", "a ", "a  b", "<|endoftext|>"]
    for text, (ids, joined) in zip(texts, b.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert joined == ",".join(map(str, ids.tolist()))
        assert b.decode(ids) == text.encode()
    other = bpe.Bpe(b.ranks, r"\w+ ?|[^\w]")  # a pattern that joins a word and the space behind it
    library = tiktoken.Encoding("other", pat_str=r"\w+ ?|[^\w]", mergeable_ranks=b.ranks, special_tokens={})
    for text, (ids, _) in zip(texts[-40:], other.encode(texts[-40:]), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
    b.forget()
    rows = bpe.decode(bpe.encode(odd, PATH, P.PATTERN), PATH, P.PATTERN)
    assert rows.where("decode(decoded, 'UTF-8') <> coalesce(text, '')").count() == 0
    assert rows.count() == len(ODD)
    assert bpe.round_trip(odd, PATH, P.PATTERN).where("NOT lossless").count() == 0
    assert bpe.encode(empty, PATH, P.PATTERN).count() == 0


def test_bpe_remembers_so_many_bytes_of_texts_without_spaces():
    rng = random.Random(6)
    model = bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    chars = [chr(0x4E00 + k) for k in range(3000)]
    sizes = []
    for _ in range(12):
        texts = ["".join(rng.choices(chars, k=900)) for _ in range(400)]
        for text, (ids, joined) in zip(texts, model.encode(texts), strict=True):
            assert joined.count(",") == len(ids) - 1
        assert model.decode(ids) == text.encode()
        sizes.append(model.held)
    assert max(sizes) < 2 * bpe.REMEMBERED_BYTES and sizes[-1] < sum(sizes[:2])  # it starts anew now and then


def made_words(n, seed):
    rng = random.Random(seed)
    parts = ["an", "ha", "tion", "ble", "éau", "ß", "th", "re", "ing", "ó", "wh", "st", "en", "li"]
    return sorted({"".join(rng.choices(parts, k=rng.randrange(3, 8))) for _ in range(n)})


def test_bpe_merges_a_word_once_for_each_worker(monkeypatch):
    model = bpe.Bpe(bpe.load(PATH, P.PATTERN).ranks, P.PATTERN)
    merged, merge = [], bpe.Bpe.merge
    monkeypatch.setattr(bpe.Bpe, "merge", lambda self, pieces: merged.append(len(pieces)) or merge(self, pieces))
    words = made_words(260_000, 3)
    assert len(words) > 150_000
    for _ in range(2):
        for k in range(0, len(words), 20_000):
            list(model.encode(["".join(" " + w for w in words[k : k + 20_000])]))
    assert sum(merged) == len(words)


def test_bpe_takes_little_longer_than_its_pattern():
    model = bpe.Bpe(bpe.load(PATH, P.PATTERN).ranks, P.PATTERN)
    words, rng = made_words(80_000, 4), random.Random(5)
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(600)]

    def seconds(f):
        took = []
        for _ in range(3):
            model.forget()
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(lambda: list(model.encode(texts))) < 5 * seconds(lambda: [model.pattern.findall(t) for t in texts])


def test_bpe_pieces_of_all_lengths_and_patterns_with_groups():
    ranks, rng = bpe.load(PATH, P.PATTERN).ranks, random.Random(8)
    texts = ["".join(rng.choices("aaabtehé漢", k=k)) for k in range(540)] + ["x1 " * 100_000]
    for pattern, plain in ((P.PATTERN, P.PATTERN), (r"(\w)\w*|(\W)", r"\w+|\W"), (r"\w*", r"\w+")):  # the last has empty matches
        library = tiktoken.Encoding("own", pat_str=plain, mergeable_ranks=ranks, special_tokens={})
        for text, (ids, joined) in zip(texts, bpe.Bpe(ranks, pattern).encode(texts), strict=True):
            expected = library.encode_ordinary(text)
            assert ids.tolist() == expected
            assert joined == ",".join(map(str, expected))


def lcs(a, b):
    row = np.zeros(len(b) + 1, int)
    for x in a:
        now = np.maximum.accumulate(np.concatenate([[0], np.maximum(row[1:], row[:-1] + (b == x))]))
        row = now
    return int(row[-1])


def test_band_and_ends_of_alignments():
    rng = random.Random(8)
    for _ in range(300):
        a = np.array([rng.randrange(1, 7) for _ in range(rng.randrange(1, 25))])
        b = np.array([rng.randrange(1, 7) for _ in range(rng.randrange(1, 40))])
        n, end = align.common(a, b, -len(a), len(b))
        assert n == lcs(a, b) == (lcs(a, b[:end]) if end else 0)
        assert not n or lcs(a, b[: end - 1]) == n - 1
        low, high = sorted((rng.randrange(-10, 20), rng.randrange(-10, 20)))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + 1 if x == y and low <= j - i <= high else 0)
        assert align.common(a, b, low, high)[0] == table[-1, -1]


def test_licenses(spark, odd, empty):
    mit = licenses.templates()["MIT"].strip()
    changed = mit.replace("free of charge", "at no charge").replace("to deal in", "to do anything with")
    texts = ["Some words before. " + mit + " after", changed, "Released under the MIT License.\nReleased  UNDER the mit license", mit[: len(mit) // 2], "the rights to use, copy", "released under an MIT License", mit + "\n\n" + "a word of no meaning " * 3 + mit]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    named = [[m.name for m in r.licenses if m.name in ("MIT", "MIT-notice")] for r in rows]
    assert named == [["MIT"], ["MIT"], ["MIT-notice", "MIT-notice"], [], [], ["MIT-notice"], ["MIT", "MIT"]]
    m = next(m for m in rows[0].licenses if m.name == "MIT")
    assert m.coverage == 1.0
    assert texts[0][m.start : m.end] == mit[:-1]
    assert 0.8 <= next(m for m in rows[1].licenses if m.name == "MIT").coverage < 1
    assert licenses.scan(odd).where("size(licenses) > 0").count() == 0
    assert licenses.scan(odd).count() == len(ODD)
    assert licenses.scan(empty).count() == 0
    assert len(licenses.templates()) >= 25


def test_license_filter_and_spans_against_alignment_of_every_template(spark):
    rng = random.Random(10)
    fixed = {k: t for k, t in licenses.templates().items() if len(decontam.words(t)) < 700}
    coded = {k: [w.decode() for w in decontam.words(t)] for k, t in fixed.items()}
    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    planted = []
    for k, w in coded.items():
        for rate in (0.05, 0.1, 0.15):
            x = list(w)
            for _ in range(int(rate * len(w))):
                i = rng.randrange(len(x))
                x[i : i + rng.randrange(2)] = [f"odd{rng.randrange(50)}"] * rng.randrange(2)
            planted.append(" ".join([*(f"pre{rng.randrange(99)}" for _ in range(rng.randrange(60))), *x, *(f"post{rng.randrange(99)}" for _ in range(rng.randrange(60)))]))
    texts = planted + docs[:80]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), given=fixed).orderBy("doc_id").collect()
    vocab = {w: i + 1 for i, w in enumerate(sorted({w for x in coded.values() for w in x}))}
    right = missed = 0
    for text, r in zip(texts, rows, strict=True):
        code = np.array([vocab.get(w.decode(), 0) for w in decontam.words(text)])
        found = {m.name for m in r.licenses}
        for k, w in coded.items():
            own, n = np.array([vocab[x] for x in w]), len(w)
            reach = n + max(2, n // 4)
            best = max((align.common(own, code[i : i + reach], -n, reach)[0] for i in range(0, max(1, len(code)), max(1, n // 8))), default=0) / n
            right += best >= licenses.COVERAGE and k in found
            missed += best >= licenses.COVERAGE and k not in found
        for m in r.licenses:
            inside = np.array([vocab.get(w.decode(), 0) for w in decontam.words(text[m.start : m.end])])
            own = np.array([vocab[x] for x in coded[m.name]])
            assert lcs(own, inside) == m.matched
            assert m.coverage == m.matched / len(own) >= licenses.COVERAGE
    assert right > 60
    assert missed <= 0.02 * (right + missed)
