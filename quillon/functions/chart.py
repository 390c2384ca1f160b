"""Chart parsing (CKY) with a binary probabilistic grammar: many sentences of one length at a time, spans as numpy arrays.

Symbols that begin with MIDDLE come from rules of more than two parts and leave no trace in trees. Rules of one part are
closed beforehand: the best chain between two symbols, and the sum over all chains. Nothing recurses.
"""

from __future__ import annotations

import numpy as np

MIDDLE = "@"
#: Times a word, so that sums over long sentences stay in the range of doubles; taken out again of what is returned.
BOOST = 8.0
#: Bytes of the charts that are filled at a time, of those of totals(), which are best small enough for a cache, and of those of trees().
BYTES, TOTALS_BYTES, TREES_BYTES = 64 << 20, 8 << 20, 64 << 20


class Grammar:
    """rules: (lhs, left, right or None, probability). Symbols that are no lhs are tags."""

    def __init__(self, rules: list[tuple[str, str, str | None, float]], start: str = "S"):
        names = sorted({s for a, b, c, _ in rules for s in (a, b, c) if s is not None} | {start})
        self.names, self.numbers, self.start = names, {s: k for k, s in enumerate(names)}, names.index(start)
        n, at = len(names), self.numbers
        self.binary = sorted((at[a], at[b], at[c], p) for a, b, c, p in rules if c is not None and p > 0)
        self.lhs, self.left, self.right = (np.array([r[k] for r in self.binary], np.int64) for k in range(3))
        self.p = np.array([r[3] for r in self.binary])
        self.unary = np.zeros((n, n))
        for a, b, c, p in rules:
            if c is None and a != b:
                self.unary[at[a], at[b]] += p
        self.log = np.log(self.p)
        self.heads, self.first = np.unique(self.lhs, return_index=True) if len(self.lhs) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        # symbols that are no lhs stand for one word: a rule that begins or ends with one has one place to be cut at
        made = np.zeros(n, bool)
        made[self.lhs] = True
        made |= self.unary.any(1)
        self.made = made
        longs = {(False, False): made[self.left] & made[self.right], (True, False): made[self.right], (False, True): made[self.left], (True, True): np.ones(len(self.lhs), bool)}
        self.parts = {key: self._part(np.flatnonzero(own)) for key, own in longs.items()}
        self.tagged = ~made[self.left]
        self.dense = np.zeros((n, n, n))
        np.add.at(self.dense, (self.lhs, self.left, self.right), self.p)
        self.closed = np.linalg.inv(np.eye(n) - self.unary)
        with np.errstate(divide="ignore"):
            self.chain = np.log(self.unary)
        np.fill_diagonal(self.chain, 0.0)
        self.then = np.where(np.isfinite(self.chain), np.arange(n)[None, :], -1)  # the next symbol of the best chain
        for k in range(n):
            way = self.chain[:, k, None] + self.chain[None, k, :]
            better = way > self.chain + 1e-12
            self.chain, self.then = np.where(better, way, self.chain), np.where(better, self.then[:, k, None], self.then)
        chained = np.isfinite(self.chain) & ~np.eye(n, dtype=bool)
        self.from_, self.to = np.flatnonzero(chained.any(1)), np.flatnonzero(chained.any(0))

    def _part(self, own: np.ndarray) -> tuple:
        """left, right, log, heads and where each head begins, of some of the binary rules."""
        heads, first = np.unique(self.lhs[own], return_index=True)
        return self.left[own], self.right[own], self.log[own], heads, first

    def rules(self) -> list[tuple[str, str, str | None, float]]:
        names = self.names
        out = [(names[a], names[b], names[c], p) for a, b, c, p in self.binary]
        return out + [(names[a], names[b], None, float(self.unary[a, b])) for a, b in zip(*np.nonzero(self.unary), strict=True)]

    def at_once(self, n: int) -> int:
        return max(1, BYTES // (16 * n * (n + 1) * len(self.names) + 16 * n * max(len(self.log), len(self.names) ** 2)))


def by_length(sentences: list[tuple[int, ...]], g: Grammar):
    """(row numbers, tags as an array) of equally long sentences, some at a time."""
    rows: dict[int, list[int]] = {}
    for k, s in enumerate(sentences):
        rows.setdefault(len(s), []).append(k)
    for n, own in rows.items():
        step = g.at_once(n)
        for k in range(0, len(own), step):
            yield own[k : k + step], np.array([sentences[i] for i in own[k : k + step]], np.int64)


def best(g: Grammar, tags: np.ndarray) -> tuple[np.ndarray, list]:
    """Log probability of each sentence's best derivation, and raw and closed charts, by length: (start, row, symbol)."""
    b, n = tags.shape
    raw: list = [None]
    chart: list = [None]
    for size in range(1, n + 1):
        m = n - size + 1
        cell = np.full((m, b, len(g.names)), -np.inf)
        if size == 1:
            cell[np.arange(n)[:, None], np.arange(b)[None], tags.T] = 0
        for k in range(1, size):
            left, right, log, heads, first = g.parts[k == 1, k == size - 1]
            if len(log):
                each = chart[k][:m][..., left] + chart[size - k][k : k + m][..., right] + log
                cell[..., heads] = np.maximum(cell[..., heads], np.maximum.reduceat(each, first, axis=-1))
        raw.append(cell)
        closed = cell.copy()
        if len(g.from_):
            closed[..., g.from_] = np.maximum(cell[..., g.from_], (cell[..., None, g.to] + g.chain[np.ix_(g.from_, g.to)]).max(-1))
        chart.append(closed)
    return chart[n][0, :, g.start], [raw, chart]


def tree(g: Grammar, charts: list, row: int, words: list[str]) -> str:
    """The best derivation in brackets; equal ones by the shortest left part, then by the rule's place."""
    raw, chart = charts
    ends = np.append(g.first[1:], len(g.log))
    rules = {int(h): slice(a, e) for h, a, e in zip(g.heads, g.first, ends, strict=True)}
    out, stack = [], [(len(words), 0, g.start)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        size, i, symbol = item
        scores = raw[size][i, row] + g.chain[symbol]
        last = int(scores.argmax())
        said, k = [symbol], symbol
        while k != last:
            k = int(g.then[k, last])
            said.append(k)
        shown = [g.names[s] for s in said if not g.names[s].startswith(MIDDLE)]
        if size == 1:
            out.append("".join(f" ({s}" for s in shown) + f" {words[i]}" + ")" * len(shown))
            continue
        own = rules[last]
        # a rule that begins with a tag is cut behind it
        most = 2 if g.tagged[own].all() else size
        each = np.array([chart[k][i, row][g.left[own]] + chart[size - k][i + k, row][g.right[own]] + g.log[own] for k in range(1, most)])
        k, rule = divmod(int(each.argmax()), each.shape[1])
        out.append("".join(f" ({s}" for s in shown))
        stack += [")" * len(shown), (size - k - 1, i + k + 1, int(g.right[own][rule])), (k + 1, i, int(g.left[own][rule]))]
    return "".join(out).strip()


def alike(sizes: list[int], g: Grammar):
    """Places of sentences of nearly one length, some at a time, the longest first: what is shorter by an eighth at most is
    padded, so that long sentences, of which there are few, don't go one by one."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    k = 0
    while k < len(order):
        n = sizes[order[k]]
        end, most = k + 1, k + max(1, TREES_BYTES // (24 * n * n * (int(g.made.sum()) + 1)))
        while end < min(most, len(order)) and 8 * sizes[order[end]] >= 7 * n:
            end += 1
        yield order[k:end]
        k = end


class Rules:
    """The binary rules of a grammar by what their parts are: made symbols of any length, and tags of one word, of which only
    the words at a span's ends tell which rule can hold. Tables over tags have a column more, for padding."""

    def __init__(self, g: Grammar):
        n, self.count = len(g.names), max(1, len(g.log))
        self.kept = np.flatnonzero(g.made | (np.arange(n) == g.start))
        self.slot = np.full(n, -1)
        self.slot[self.kept] = np.arange(len(self.kept))
        self.chain = np.pad(g.chain[self.kept], ((0, 0), (0, 1)), constant_values=-np.inf)
        inner = g.chain[np.ix_(self.kept, self.kept)]
        self.inner, self.steps = inner, [(a, b, inner[a, b]) for a, b in zip(*np.nonzero(np.isfinite(inner)), strict=True) if a != b]
        self.both: dict[tuple, list] = {}  # (left, right): (head, log, rule)
        self.first: dict[tuple, tuple] = {}  # (head, right): log and rule by the first word's tag
        self.last: dict[tuple, tuple] = {}  # (head, left): by the last word's tag
        self.two: dict[int, tuple] = {}  # head: by two words' tags
        empty = lambda *shape: (np.full(shape, -np.inf), np.zeros(shape, np.int64))
        for r, (a, b, c) in enumerate(zip(g.lhs.tolist(), g.left.tolist(), g.right.tolist(), strict=True)):
            head, left, right, log = int(self.slot[a]), int(self.slot[b]), int(self.slot[c]), float(g.log[r])
            if g.made[b] and g.made[c]:
                self.both.setdefault((left, right), []).append((head, log, r))
                continue
            if g.made[c]:
                table, at = self.first.setdefault((head, right), empty(n + 1)), b
            elif g.made[b]:
                table, at = self.last.setdefault((head, left), empty(n + 1)), c
            else:
                table, at = self.two.setdefault(head, empty(n + 1, n + 1)), (b, c)
            table[0][at], table[1][at] = log, r


def trees(g: Grammar, rules: Rules, tags: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list]:
    """What best() and tree() say of many sentences at once: the log probability, and the tree as what stands before its
    words and behind the last one (None without a derivation). tags: (sentence, word), padded by len(g.names) beyond `sizes`.
    Values are the same sums in the same order as in best(), so ties fall alike."""
    b, n = tags.shape
    symbols = len(rules.kept)
    spoken = np.ascontiguousarray(tags.T)
    # [symbol, size - 1, start, row], and the same [symbol, size - 1, end, row]
    raw, closed, closed_to = (np.full((symbols, n, n, b), -np.inf) for _ in range(3))
    closed[:, 0] = closed_to[:, 0] = rules.chain[:, spoken]
    first = [(h, y, t[spoken]) for (h, y), (t, _) in rules.first.items()]
    last = [(h, x, t[spoken]) for (h, x), (t, _) in rules.last.items()]
    room = np.empty((n + 1) ** 2 // 4 * b)
    for k in range(1, n):
        m = n - k
        cell = raw[:, k, :m]
        view = room[: k * m * b].reshape(k, m, b)
        for (x, y), own in rules.both.items():
            most = np.add(closed[x, :k, :m], closed_to[y, k - 1 :: -1, k:], out=view).max(0)
            for h, log, _ in own:
                np.maximum(cell[h], most + log, out=cell[h])
        for h, y, logs in first:
            np.maximum(cell[h], closed[y, k - 1, 1 : m + 1] + logs[:m], out=cell[h])
        for h, x, logs in last:
            np.maximum(cell[h], closed[x, k - 1, :m] + logs[k:], out=cell[h])
        if k == 1:
            for h, (t, _) in rules.two.items():
                np.maximum(cell[h], t[spoken[:-1], spoken[1:]], out=cell[h])
        own = closed[:, k, :m]
        own[:] = cell
        for x, y, log in rules.steps:
            np.maximum(own[x], cell[y] + log, out=own[x])
        closed_to[:, k, k:] = own
    best = closed[rules.slot[g.start], sizes - 1, 0, np.arange(b)]
    return best, _said(g, rules, tags, sizes, np.flatnonzero(np.isfinite(best)), raw, closed, closed_to)


def _said(g: Grammar, rules: Rules, tags: np.ndarray, sizes: np.ndarray, rows: np.ndarray, raw: np.ndarray, closed: np.ndarray, closed_to: np.ndarray) -> list:
    """The trees of the given rows, read off the charts of trees(): all spans of one size at a time, the largest first."""
    (b, n), names = tags.shape, len(g.names)
    waiting: dict[int, list] = {}
    leaves, places, codes, ends = [], [], [], []

    def add(size, row, start, symbol):
        order = np.argsort(size, kind="stable")
        size, row, start, symbol = size[order], row[order], start[order], symbol[order]
        cuts = np.flatnonzero(np.diff(size)) + 1
        for s, *part in zip(size[np.append(0, cuts)].tolist() if len(size) else [], *(np.split(x, cuts) for x in (row, start, symbol)), strict=False):
            (leaves if s == 1 else waiting.setdefault(s, [])).append(part)

    add(sizes[rows], rows, np.zeros(len(rows), np.int64), np.full(len(rows), g.start))
    for s in range(n, 1, -1):
        if s not in waiting:
            continue
        row, start, symbol = (np.concatenate(x) for x in zip(*waiting.pop(s), strict=True))
        slot = rules.slot[symbol]
        end = (raw[:, s - 1, start, row].T + rules.inner[slot]).argmax(1)
        places.append(row * n + start)
        codes.append(symbol * names + rules.kept[end])
        ends.append(row * n + start + s - 1)
        want = raw[end, s - 1, start, row]
        nothing = s * rules.count
        found = np.full(len(row), nothing)  # (size of the left part - 1, rule), the first of equal ones

        def take(own, hit, code, found=found):
            found[own] = np.minimum(found[own], np.where(hit, code, nothing))  # noqa: B023

        of = {h: np.flatnonzero(end == h) for h in np.unique(end).tolist()}
        for (x, y), each in rules.both.items():
            for h, log, r in each:
                if (own := of.get(h)) is not None:
                    i, w = start[own], row[own]
                    hit = closed[x, : s - 1, i, w] + closed_to[y, s - 2 :: -1, i + s - 1, w] + log == want[own, None]
                    take(own, hit.any(1), hit.argmax(1) * rules.count + r)
        for (h, y), (t, r) in rules.first.items():
            if (own := of.get(h)) is not None:
                i, w = start[own], row[own]
                tag = tags[w, i]
                take(own, closed[y, s - 2, i + 1, w] + t[tag] == want[own], r[tag])
        for (h, x), (t, r) in rules.last.items():
            if (own := of.get(h)) is not None:
                i, w = start[own], row[own]
                tag = tags[w, i + s - 1]
                take(own, closed[x, s - 2, i, w] + t[tag] == want[own], (s - 2) * rules.count + r[tag])
        if s == 2:
            for h, (t, r) in rules.two.items():
                if (own := of.get(h)) is not None:
                    at = tags[row[own], start[own]], tags[row[own], start[own] + 1]
                    take(own, t[at] == want[own], r[at])
        left, rule = np.divmod(found, rules.count)
        left += 1
        add(np.concatenate([left, s - left]), np.tile(row, 2), np.concatenate([start, start + left]), np.concatenate([g.left[rule], g.right[rule]]))
    if leaves:
        row, start, symbol = (np.concatenate(x) for x in zip(*leaves, strict=True))
        places.append(row * n + start)
        codes.append(symbol * names + tags[row, start])
        ends.append(places[-1])
    out: list = [None] * b
    if not places:
        return out
    place, code, end = (np.concatenate(x) for x in (places, codes, ends))
    kinds, kind = np.unique(code, return_inverse=True)
    shown = [_shown(g, *divmod(k, names)) for k in kinds.tolist()]
    closing = np.bincount(end, np.array([len(x) for x in shown])[kind], b * n).astype(np.int64).tolist()
    order = np.argsort(place, kind="stable")  # of equal places the larger spans come first
    opening = ["".join(f" ({s}" for s in x) for x in shown]
    said = [opening[k] for k in kind[order].tolist()]
    at = np.searchsorted(place[order], np.arange(b * n + 1)).tolist()
    for r, size in zip(rows.tolist(), sizes[rows].tolist(), strict=True):
        own = range(r * n, r * n + size)
        before = ["".join(said[at[k] : at[k + 1]]) + " " for k in own]
        after = [")" * closing[k] for k in own]
        out[r] = [before[0], *map(str.__add__, after, before[1:]), after[-1]]
    return out


def _shown(g: Grammar, symbol: int, last: int) -> list[str]:
    """The names on the best chain between two symbols, but for those that leave no trace."""
    said = [symbol]
    while said[-1] != last:
        said.append(int(g.then[said[-1], last]))
    return [g.names[s] for s in said if not g.names[s].startswith(MIDDLE)]


def worded(frame: list[str], words: list[str]) -> str:
    """The tree of a frame of trees() with its words."""
    parts = [""] * (2 * len(words) + 1)
    parts[::2], parts[1::2] = frame, words
    return "".join(parts).strip()


def inside(g: Grammar, tags: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Log probability of each sentence over all derivations, and what outside() needs."""
    b, n = tags.shape
    size_n = len(g.names)
    flat = g.dense.reshape(size_n, -1)
    raw: list = [None]
    chart: list = [None]
    for size in range(1, n + 1):
        m = n - size + 1
        if size == 1:
            cell = np.zeros((m, b, size_n))
            cell[np.arange(n)[:, None], np.arange(b)[None], tags.T] = BOOST
        else:
            left = np.stack([chart[k][:m] for k in range(1, size)], -1)
            right = np.stack([chart[size - k][k : k + m] for k in range(1, size)], -2)
            cell = (left @ right).reshape(m, b, -1) @ flat.T
        raw.append(cell)
        chart.append(cell @ g.closed.T)
    with np.errstate(divide="ignore"):
        return np.log(chart[n][0, :, g.start]) - n * np.log(BOOST), (raw, chart)


def totals(g: Grammar, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What inside() and best() say of the log probabilities, without charts: only symbols that begin or end a rule are kept,
    and pairs of them that no rule has are left out."""
    b, n = tags.shape
    pairs, of = np.unique(np.stack([g.left, g.right], 1), axis=0, return_inverse=True) if len(g.p) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    of = of.ravel()
    need = np.unique(np.append(pairs, g.start))
    left, right = np.searchsorted(need, pairs).T
    weight, log = np.zeros((len(g.heads), len(pairs))), np.full((len(g.heads), len(pairs)), -np.inf)
    head = np.searchsorted(g.heads, g.lhs)
    np.add.at(weight, (head, of), g.p)
    np.maximum.at(log, (head, of), g.log)
    own = [np.flatnonzero(np.isfinite(x)) for x in log]
    closed, chain = g.closed[np.ix_(need, g.heads)], g.chain[np.ix_(need, g.heads)]
    # sums and maxima: [symbol, size - 1, start, row], and the same [symbol, size - 1, end, row]
    add, add_to, top, top_to = (np.zeros((len(need), n, n, b)) for _ in range(4))
    add[:, 0] = add_to[:, 0] = BOOST * g.closed[need][:, tags.T]
    top[:, 0] = top_to[:, 0] = g.chain[need][:, tags.T]
    room = np.empty((n + 1) ** 2 // 4 * b)
    for k in range(1, n):
        m = n - k
        sums, most = np.empty((len(pairs), m * b)), np.empty((len(pairs), m * b))
        view = room[: k * m * b].reshape(k, m, b)
        for j, (x, y) in enumerate(zip(left, right, strict=True)):
            sums[j] = np.multiply(add[x, :k, :m], add_to[y, k - 1 :: -1, k:], out=view).reshape(k, -1).sum(0)
            most[j] = np.add(top[x, :k, :m], top_to[y, k - 1 :: -1, k:], out=view).reshape(k, -1).max(0)
        add[:, k, :m] = add_to[:, k, k:] = (closed @ (weight @ sums)).reshape(-1, m, b)
        raw = [(most[o] + x[o, None]).max(0) for x, o in zip(log, own, strict=True)]
        best_ = [np.max([r + c for r, c in zip(raw, x, strict=True) if np.isfinite(c)], 0) if np.isfinite(x).any() else np.full(m * b, -np.inf) for x in chain]
        top[:, k, :m] = top_to[:, k, k:] = np.array(best_).reshape(-1, m, b)
    s = int(np.searchsorted(need, g.start))
    with np.errstate(divide="ignore"):
        return np.log(add[s, n - 1, 0]) - n * np.log(BOOST), top[s, n - 1, 0]


def expected(g: Grammar, tags: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected uses of each binary rule and each unary rule over the sentences, and their log likelihood."""
    b, n = tags.shape
    size_n = len(g.names)
    logs, (_, chart) = inside(g, tags)
    good = np.isfinite(logs)
    flat, whole = g.dense.reshape(size_n, -1), chart[n][0, :, g.start]
    above = [None] + [np.zeros((n - size + 1, b, size_n)) for size in range(1, n + 1)]
    above[n][0, good, g.start] = weights[good] / whole[good]
    binary, unary = np.zeros_like(flat), np.zeros((size_n, size_n))
    for size in range(n, 0, -1):
        m = n - size + 1
        own = above[size] @ g.closed  # of the cell before its chains
        unary += np.einsum("mba,mbc->ac", own, chart[size])
        if size == 1:
            break
        left = np.stack([chart[k][:m] for k in range(1, size)], -1)
        right = np.stack([chart[size - k][k : k + m] for k in range(1, size)], -2)
        binary += own.reshape(-1, size_n).T @ (left @ right).reshape(m * b, -1)
        pairs = (own @ flat).reshape(m, b, size_n, size_n)
        to_left, to_right = pairs @ right.swapaxes(-1, -2), left.swapaxes(-1, -2) @ pairs
        for k in range(1, size):
            above[k][:m] += to_left[..., k - 1]
            above[size - k][k : k + m] += to_right[..., k - 1, :]
    return (binary * flat).reshape(g.dense.shape)[g.lhs, g.left, g.right], unary * g.unary, float((logs[good] * weights[good]).sum())
