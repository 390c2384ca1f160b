"""Personal data: four fixed patterns, and a character-level bidirectional LSTM with a CRF that adds what they miss.

Base kinds (email, ip, card, phone) are found leftmost and non-overlapping for each kind in whole texts. The model tags
characters with the same four kinds. It is trained in numpy, in one task, from labelled spans: windows of the corpus
labelled by the base patterns, and items in other spellings (`jan (at) mail.example.org`, `030/123 45 67`, IPv6, cards
with dots) as well as look-alikes (dates, versions, prices, hashes, book numbers) set into such windows. The sample is
bounded by SAMPLE different windows, those of least hash; everything else covers all texts.

Prediction: overlapping windows of WINDOW characters start every STRIDE characters. A window without a digit, an at sign
or an `at` in brackets can hold no item and isn't decoded; that is part of the definition. Each window is decoded by
Viterbi; spans cut by a window's edge are left to the window that holds them whole, which exists up to WINDOW - STRIDE
characters. A document's spans of all windows are then reconciled at once: votes for the same span add up, and of
overlapping spans the set with the highest sum stays (weighted interval scheduling). What overlaps a base span, or fails
its kind's exact check (Luhn, parts of an address, number of digits), goes.

No shuffle but for the sample's distinct windows; a task holds CHUNK_BYTES of text (or one longer text) and BATCH windows.
Null text counts as empty; empty texts and tables give no spans; a corpus without any digit gives a model trained on the
made items alone. Repeated rows each get their own result. Other columns stay out of the result.
"""

from __future__ import annotations

import bisect
import io
import ipaddress
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import batch, chunks, mapped, texts_of

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STRIDE, BATCH = 96, 32, 2048
#: Windows that the model is fitted on at most, and what the fit takes.
SAMPLE, STEPS, SIZE, HIDDEN, RATE = 600, 400, 96, 16, 0.03
#: Log odds against the same characters untagged that a span needs, summed over its windows.
LEAST = 3.0

# The contract's patterns, in forms that take linear time (the address's local part is read backwards).
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TRIGGER = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]", re.I)
_DIGITS = re.compile(r"[0-9]")

#: Characters: ASCII as themselves, then other letters, everything else, and the filling behind a text's end.
LETTER, OTHER, FILL, N_CHARS = 128, 129, 130, 131
N_TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
#: Tags that may not follow each other: `inside` only follows its own kind.
FORBIDDEN = np.array([[q > 0 and q % 2 == 0 and p not in (q - 1, q) for q in range(N_TAGS)] for p in range(N_TAGS)])
LOW = np.float32(-1e4)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank, end) of the base kinds, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m.group())) <= 15]
    return sorted(out)


def starts(text: str) -> list[int]:
    """Where the windows begin that hold a trigger."""
    found: set[int] = set()
    for m in TRIGGER.finditer(text):
        k = m.start() // STRIDE
        if k not in found or k - (WINDOW // STRIDE - 1) not in found:
            found.update(range(max(0, k - WINDOW // STRIDE + 1), k + 1))
    return sorted(k * STRIDE for k in found)


def codes(texts: list[str]) -> np.ndarray:
    """Character numbers of windows, filled up to WINDOW."""
    out = np.full((len(texts), WINDOW), FILL, np.int64)
    for k, t in enumerate(texts):
        raw = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[k, : len(raw)] = raw if t.isascii() else [c if c < 128 else LETTER if chr(c).isalpha() else OTHER for c in raw.tolist()]
    return out


# --- the model


def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    make = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
    p = {f"{n}{d}": make(*shape) for d in "fb" for n, shape in (("x", (N_CHARS, 4 * h)), ("h", (h, 4 * h)))}
    p |= {f"c{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32) for d in "fb"}
    return p | {"o": make(2 * h, N_TAGS), "u": np.zeros(N_TAGS, np.float32), "t": np.zeros((N_TAGS, N_TAGS), np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(p: dict, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (time, row, h) of one direction over characters (time, row), and what the way back needs."""
    n, h = x.shape[1], HIDDEN
    state, cell, out, kept = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((len(x), n, h), np.float32), []
    for k in range(len(x)):
        z = p["x" + d][x[k]] + state @ p["h" + d] + p["c" + d]
        gates, new = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
        i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        before, old = cell, state
        cell = f * cell + i * new
        squashed = np.tanh(cell)
        state = out[k] = o * squashed
        kept.append((i, f, o, new, before, squashed, old))
    return out, kept


def lstm_back(p: dict, d: str, x: np.ndarray, kept: list, above: np.ndarray, grads: dict) -> None:
    """Adds the gradients of one direction, given those of its hidden states."""
    to_state, to_cell = np.zeros_like(above[0]), np.zeros_like(above[0])
    each = np.empty((len(x), x.shape[1], 4 * HIDDEN), np.float32)
    for k in range(len(x) - 1, -1, -1):
        i, f, o, new, before, squashed, _ = kept[k]
        ds = above[k] + to_state
        dc = ds * o * (1 - squashed * squashed) + to_cell
        dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - new * new)], axis=1)
        to_cell, to_state, each[k] = dc * f, dz @ p["h" + d].T, dz
    each, at = each.reshape(-1, 4 * HIDDEN), x.ravel()
    hot = np.zeros((len(at), N_CHARS), np.float32)
    hot[np.arange(len(at)), at] = 1
    grads["x" + d], grads["h" + d], grads["c" + d] = hot.T @ each, np.concatenate([k[-1] for k in kept]).T @ each, each.sum(0)


def emissions(p: dict, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Tag scores (time, row, tag) of windows (row, time). Filling has only the tag `none`."""
    t = np.ascontiguousarray(x.T)
    fore, kept_f = lstm(p, "f", t)
    back, kept_b = lstm(p, "b", t[::-1])
    hidden = np.concatenate([fore, back[::-1]], axis=2)
    scores = hidden @ p["o"] + p["u"]
    scores[..., 1:][t == FILL] = LOW
    return scores, (t, hidden, kept_f, kept_b)


def crf(scores: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition of each row, the marginals of tags (time, row, tag), and the expected transitions (tag, tag). Sums are
    scaled at each step, so they stay in range."""
    t = np.where(FORBIDDEN, 0, np.exp(t))
    top = scores.max(2, keepdims=True)
    e = np.exp(scores - top)
    fore, back, scale = np.empty_like(e), np.empty_like(e), np.empty(scores.shape[:2], np.float32)
    for k in range(len(e)):
        x = e[k] if k == 0 else fore[k - 1] @ t * e[k]
        scale[k] = x.sum(1)
        fore[k] = x / scale[k][:, None]
    back[-1] = 1
    for k in range(len(e) - 1, 0, -1):
        back[k - 1] = (e[k] * back[k]) @ t.T / scale[k][:, None]
    later = (e[1:] * back[1:] / scale[1:, :, None]).reshape(-1, N_TAGS)
    return (np.log(scale) + top[..., 0]).sum(0), fore * back, t * (fore[:-1].reshape(-1, N_TAGS).T @ later)


def loss(p: dict, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log likelihood of the windows' tags (row, time), and the gradients of all parameters."""
    scores, (t, hidden, kept_f, kept_b) = emissions(p, x)
    n, y = len(x), tags.T
    whole, marginal, expected = crf(scores, p["t"])
    rows = np.arange(n)
    path = sum(scores[k, rows, y[k]] for k in range(len(y))) + sum(p["t"][y[k - 1], y[k]] for k in range(1, len(y)))
    seen = np.zeros_like(p["t"])
    np.add.at(seen, (y[:-1].ravel(), y[1:].ravel()), 1)
    marginal[np.arange(len(y))[:, None], rows[None], y] -= 1
    marginal[..., 1:][t == FILL] = 0
    d = marginal / n
    grads = {"t": np.where(FORBIDDEN, 0, expected - seen).astype(np.float32) / n, "o": np.einsum("tnh,tnl->hl", hidden, d), "u": d.sum((0, 1))}
    above = d @ p["o"].T
    lstm_back(p, "f", t, kept_f, above[..., :HIDDEN], grads)
    lstm_back(p, "b", t[::-1], kept_b, above[::-1][..., HIDDEN:], grads)
    return float((whole - path).mean()), grads


def fit(x: np.ndarray, tags: np.ndarray, seed: int = 0, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Adam over random batches of SIZE windows, with a falling rate."""
    rng = np.random.default_rng(seed)
    p = fresh(rng)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(x), SIZE)
        _, grads = loss(p, x[rows], tags[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * (1 - step / (steps + 1))
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def decoded(p: dict, x: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, log odds) of the spans of each window's best path; a span cut at the front has start -1."""
    scores, _ = emissions(p, x)
    t = np.where(FORBIDDEN, LOW, p["t"])
    best, back = scores[0], np.empty(scores.shape, np.int8)
    for k in range(1, len(scores)):
        each = best[:, :, None] + t[None]
        back[k] = each.argmax(1)
        best = each.max(1) + scores[k]
    path = np.empty(scores.shape[:2], np.int8)
    path[-1] = best.argmax(1)
    rows = np.arange(len(x))
    for k in range(len(scores) - 1, 0, -1):
        path[k - 1] = back[k, rows, path[k]]
    out = []
    for r in range(len(x)):
        tags, spans, k = path[:, r].tolist(), [], 0
        while k < len(tags):
            if not tags[k]:
                k += 1
                continue
            kind, first = (tags[k] - 1) // 2, k
            k += 1
            while k < len(tags) and tags[k] == 2 * kind + 2:
                k += 1
            said = tags[first:k]
            odds = float(sum(scores[i, r, g] - scores[i, r, 0] for i, g in enumerate(said, first)) + sum(t[a, b] - t[0, 0] for a, b in zip(said, said[1:], strict=False)))
            odds += float((t[0, said[0]] - t[0, 0] if first else 0) + (t[said[-1], 0] - t[0, 0] if k < len(tags) else 0))
            spans.append((first if said[0] % 2 else -1, kind, k, odds))
        out.append(spans)
    return out


# --- labelled spans

# Parts of made items.
NAMES = "anna ben carla dmitri eva farid greta hugo ines jan kofi lena marta noor olga pavel quinn rosa sven tara umar vera wim xena yara zoe".split()
HOSTS = "mail post example web data corp uni shop labs firma".split()
ENDS = "com org net de fr es io info".split()
BEFORE = ["", "", "", "", "mail: ", "contact ", "tel. ", "phone ", "ip ", "card no. ", "call ", "write to "]


def made(rng: np.random.Generator) -> tuple[str, int]:
    """An item and its kind; -1 for a look-alike."""
    pick = lambda a: a[int(rng.integers(len(a)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    kind = int(rng.integers(0, 7))
    if kind == 0:
        local = pick([pick(NAMES), f"{pick(NAMES)}.{pick(NAMES)}", f"{pick(NAMES)}{digits(2)}", f"{pick(NAMES)[0]}_{pick(NAMES)}"])
        host = pick([pick(HOSTS), f"{pick(HOSTS)}{digits(1)}.{pick(HOSTS)}", f"{pick(HOSTS)}-{pick(HOSTS)}"])
        at, dot = pick([("@", "."), ("@", "."), (" @ ", "."), (" (at) ", "."), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" {at} ", "."), ("@", " dot ")])
        return local + at + host.replace(".", dot) + dot + pick(ENDS), 0
    if kind == 1:
        if rng.random() < 0.4:
            parts = [f"{int(v):x}" for v in rng.integers(0, 65536, 8)]
            cut = int(rng.integers(1, 6))
            return pick([":".join(parts), ":".join(parts[:cut]) + "::" + ":".join(parts[cut + 2 :]), "2001:db8::" + ":".join(parts[:2]), "fe80::" + ":".join(parts[:4])]), 1
        sep = pick([".", ".", ".", " . ", "[.]", "-"])
        return sep.join(str(int(v)) for v in rng.integers(1, 256, 4)), 1
    if kind == 2:
        body = pick("45") + digits(14)
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        sep = pick(["", " ", "-", ".", "/", "  ", "_", " - "])
        return sep.join(body[k : k + 4] for k in range(0, 16, 4)), 2
    if kind == 3:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b} {c}", f"+1 ({a}) {b}-{c}", f"00{digits(2)} {digits(2)} {digits(7)}", f"0{digits(2)}/{digits(3)} {digits(2)} {digits(2)}", f"+{digits(2)}/{digits(3)}/{digits(6)}", f"0{digits(3)} {digits(6)}", f"({a}) {b} {c}", f"1-{a}-{b}-{c}"]), 3
    year = str(int(rng.integers(1900, 2030)))
    return pick([
        f"{year}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{year}", f"{digits(2)}.{digits(2)}.{year}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}",
        f"{digits(1)},{digits(3)},{digits(3)}", f"${digits(3)}.{digits(2)}", f"{digits(1)}.{digits(6)}", year, f"{year}-{year}", digits(int(rng.integers(1, 21))), f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        f"{rng.bytes(16).hex()}", f"{rng.bytes(4).hex()}-{rng.bytes(2).hex()}-{rng.bytes(2).hex()}-{rng.bytes(2).hex()}-{rng.bytes(6).hex()}", f'token = "{rng.bytes(20).hex()}"', f"@{pick(NAMES)}", f"#{digits(5)}",
        f"{digits(3)} {digits(3)} {digits(3)} {digits(3)} {digits(3)} {digits(3)}", f"page {digits(3)}", f"{digits(2)} (at) noon", f"{year}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}:{digits(2)}Z", f"no. {digits(4)}-{digits(6)}-{digits(8)}", f"{pick(NAMES)}{digits(3)}", f"1.{digits(1)}.{digits(1)}-{digits(2)}",
    ]), -1


def examples(windows: list[str], n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags: those given, as the base patterns label them, and n with made items set in."""
    rng = np.random.default_rng(seed)
    texts, tags = [], []

    def tagged(text: str, spans: list[tuple[int, int, int]], cut: int) -> None:
        y = np.zeros(max(len(text), cut + WINDOW), np.int64)
        for a, kind, b in spans:
            if not y[a:b].any():
                y[a:b], y[a] = 2 * kind + 2, 2 * kind + 1
        texts.append(text[cut : cut + WINDOW])
        tags.append(y[cut : cut + WINDOW])

    for w in windows:
        tagged(w, base_spans(w), 0)
    words = [x for w in windows for x in re.findall(r"[^\W\d_]+[.,]?", w)] or ["word"]
    for _ in range(n):
        fill = lambda: " ".join(words[int(k)] for k in rng.integers(0, len(words), 16))
        text, spans = fill()[-int(rng.integers(1, 80)) :], []
        for _ in range(int(rng.integers(1, 3))):
            item, kind = made(rng)
            text += ("\n" if rng.random() < 0.1 else " ") + BEFORE[int(rng.integers(len(BEFORE)))] + ("" if rng.random() < 0.9 else '"')
            if kind >= 0:
                spans.append((len(text), kind, len(text) + len(item)))
            text += item + ("" if rng.random() < 0.7 else ".,;!)\n"[int(rng.integers(6))])
            text += " " + fill()[: int(rng.integers(1, 60))]
        tagged(text, spans, int(rng.integers(0, max(1, len(text) - WINDOW // 2))))
    return codes(texts), np.stack(tags)


def plausible(kind: int, said: str) -> bool:
    """The exact check of a span that the model adds."""
    digits = "".join(_DIGITS.findall(said))
    if kind == 0:
        parts = re.split(r"\s*(?:@|[\[({] ?at ?[\])}])\s*", said.strip(), flags=re.I)
        return len(parts) == 2 and bool(re.search(r"\w$", parts[0])) and bool(re.fullmatch(r"[\w-]+(?:\s*(?:\.|[\[({] ?dot ?[\])}]|\sdot\s)\s*[\w-]+)+", parts[1], re.I)) and " " not in parts[0]
    if kind == 1:
        if ":" in said:
            try:
                return ipaddress.ip_address(said).version == 6 and len(said) >= 6
            except ValueError:
                return False
        parts = re.split(r" ?(?:\.|\[\.\]|-) ?", said)
        return len(parts) == 4 and all(x.isascii() and x.isdigit() and _small(x) for x in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9]{2,}(?:[ ./_-]{1,3}[0-9]{2,})*", said))
    parts = re.findall(r"[0-9]+", said)
    return 9 <= len(digits) <= 15 and 2 <= len(parts) <= 6 and bool(re.fullmatch(r"\+?\(?[0-9][0-9 ()./-]*[0-9]", said)) and said.count("(") == said.count(")")


def reconciled(votes: dict[tuple[int, int, int], float], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans (start, kind, end) with summed log odds, the set without overlap that has the highest sum. `taken` spans stay
    free of others; equal sums prefer what ends first, then the shorter list."""
    ends = [b for _, b in sorted((a, b) for a, _, b in taken)]
    begins = sorted(a for a, _, _ in taken)
    upto = list(np.maximum.accumulate(ends)) if ends else []

    def free(a: int, b: int) -> bool:
        k = bisect.bisect_left(begins, b)
        return k == 0 or upto[k - 1] <= a

    spans = sorted((s for s, odds in votes.items() if odds >= LEAST and free(s[0], s[2])), key=lambda s: (s[2], s[0], s[1]))
    stops = [s[2] for s in spans]
    best, chosen = [0.0], []
    for k, s in enumerate(spans):
        before = bisect.bisect_right(stops, s[0], 0, k)
        with_it = best[before] + votes[s]
        chosen.append(with_it > best[k])
        best.append(max(with_it, best[k]))
    out, k = [], len(spans)
    while k:
        if chosen[k - 1]:
            out.append(spans[k - 1])
            k = bisect.bisect_right(stops, spans[k - 1][0], 0, k - 1)
        else:
            k -= 1
    return out[::-1]


def learn(df: DataFrame, text: str = "text", sample: int = SAMPLE, steps: int = STEPS) -> bytes:
    """A model fitted to at most `sample` different windows of the texts (those of least hash) and made items."""

    def windows(batches):
        for part in chunks(batches, "text"):
            found = {t[a : a + WINDOW] for t in texts_of(part.column("text")).to_pylist() for a in starts(t)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["w"])

    def train(frames):
        seen = [w for frame in frames for w in frame["w"]]
        x, y = examples(sorted(seen), 12 * SAMPLE)
        buffer = io.BytesIO()
        np.savez(buffer, **fit(x, y, steps=steps))
        yield pd.DataFrame({"model": [buffer.getvalue()]})

    some = mapped(df.select(F.col(text).alias("text")), windows, "w string").distinct().withColumn("h", F.xxhash64("w")).orderBy("h", "w").limit(sample)
    rows = some.select("w").collect()  # at most `sample` windows
    one = df.sparkSession.createDataFrame([(r["w"],) for r in rows] or [("",)], "w string").coalesce(1)
    return bytes(one.mapInPandas(train, "model binary").first()["model"])


def scan(df: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and added: arrays of struct<start, rank, end>, positions in code points, end exclusive."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([(key, pa.int64()), ("base", kind), ("added", kind)])

    def run(batches):
        p = dict(np.load(io.BytesIO(model)))
        for part in chunks(batches, "text"):
            texts = texts_of(part.column("text")).to_pylist()
            base = [base_spans(t) for t in texts]
            votes: list[dict] = [{} for _ in texts]
            queue: list[tuple[int, int]] = []
            for k, t in enumerate(texts):
                for a in starts(t):
                    queue.append((k, a))
                    if len(queue) == BATCH:
                        _vote(p, texts, queue, votes)
                        queue = []
            _vote(p, texts, queue, votes)
            added = [reconciled({s: odds for s, odds in v.items() if plausible(s[1], t[s[0] : s[2]])}, b) for v, b, t in zip(votes, base, texts, strict=True)]
            said = lambda rows: pa.array([[dict(zip(("start", "rank", "end"), s, strict=True)) for s in r] for r in rows], kind)
            yield batch(schema, part.column(key), said(base), said(added))

    spans = "array<struct<start:int,rank:int,end:int>>"
    return mapped(df.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")), run, f"{key} long, base {spans}, added {spans}")


def _vote(p: dict, texts: list[str], queue: list[tuple[int, int]], votes: list[dict]) -> None:
    if not queue:
        return
    for (k, at), found in zip(queue, decoded(p, codes([texts[k][a : a + WINDOW] for k, a in queue])), strict=True):
        size = min(WINDOW, len(texts[k]) - at)
        for a, kind, b, odds in found:
            if a >= 0 and b <= size and (a or not at) and (b < WINDOW or at + b == len(texts[k])):
                span = (at + a, kind, at + b)
                votes[k][span] = votes[k].get(span, 0.0) + odds


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of scan()'s rows."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    said = lambda a: F.expr(f"array_join(transform(array_sort({a}), m -> concat({kinds}[m.rank], ':', m.start, ':', m.end)), ',')")
    count = lambda k: F.expr(f"CAST(size(filter(base, m -> m.rank = {k})) AS BIGINT)").alias(f"n_{KINDS[k]}")
    return found.select(key, *map(count, range(len(KINDS))), F.sha2(said("base"), 256).alias("base_sha256"), said("concat(base, added)").alias("spans"), F.size("added").cast("long").alias("n_added"))
