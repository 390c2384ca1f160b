"""Best dependency trees over arc scores: Eisner's programme for projective trees, many sentences of one length at a time,
and Chu-Liu and Edmonds' contraction for any tree. Exactly one word hangs on the root. Nothing recurses.

Scores are arrays [head, dependent] with the root as 0 and words from 1; heads come back the same way.
"""

from __future__ import annotations

import numpy as np


def projective(scores: np.ndarray, sizes: np.ndarray | None = None, trees: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
    """scores (row, n + 1, n + 1) -> heads (row, n) and the trees' scores. Of equal trees the one with the shorter left parts.
    sizes: each row's number of words where it is less than n; what is beyond counts for nothing and has the head 0. Without
    `trees` only the scores are found."""
    b, n = len(scores), scores.shape[1] - 1
    sizes = np.full(b, n) if sizes is None else np.asarray(sizes)
    arc = np.ascontiguousarray(scores[:, 1:, 1:].transpose(1, 2, 0))
    # whole and just linked spans: [size, start, row], or [size, end, row], so that all ways to cut spans of a size are two slices
    right, left, right_to, left_to, part_right, part_left_to = (np.zeros((n, n, b)) for _ in range(6))
    room = np.empty((n + 1) ** 2 // 4 * b)

    def most(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.add(x, y, out=room[: x.size].reshape(x.shape)).reshape(len(x), -1).max(0).reshape(x.shape[1:])

    for k in range(1, n):
        m = n - k
        i = np.arange(m)
        top = most(right[:k, :m], left_to[k - 1 :: -1, k:])
        part_right[k, :m] = top + arc[i, i + k]
        part_left_to[k, k:] = top + arc[i + k, i]
        right[k, :m] = right_to[k, k:] = most(part_right[1 : k + 1, :m], right_to[k - 1 :: -1, k:])
        left[k, :m] = left_to[k, k:] = most(left[:k, :m], part_left_to[k:0:-1, k:])
    r, rows = np.arange(n)[:, None], np.arange(b)
    roots = left[r, 0, rows] + right[np.maximum(sizes - 1 - r, 0), r, rows] + scores[:, 0, 1:].T
    roots[r >= sizes] = -np.inf
    best = roots.argmax(0)
    if not trees:
        return None, roots[best, rows]
    heads = np.zeros((b, n), np.int32)
    # the spans of the best trees, from large to small: [size, start, row]; where each is cut is found anew
    wanted = {kind: np.zeros((n, n, b), bool) for kind in ("right", "left", "part_right", "part_left")}
    wanted["left"][best, 0, rows] = wanted["right"][sizes - 1 - best, best, rows] = True
    for k in range(n - 1, 0, -1):
        t = np.arange(k)
        i, row = np.nonzero(wanted["right"][k])
        if len(i):
            end, own = i[:, None] + k, row[:, None]
            c = (part_right[t + 1, i[:, None], own] + right_to[k - 1 - t, end, own]).argmax(1)
            wanted["part_right"][c + 1, i, row] = wanted["right"][k - 1 - c, i + c + 1, row] = True
        i, row = np.nonzero(wanted["left"][k])
        if len(i):
            end, own = i[:, None] + k, row[:, None]
            c = (left[t, i[:, None], own] + part_left_to[k - t, end, own]).argmax(1)
            wanted["left"][c, i, row] = wanted["part_left"][k - c, i + c, row] = True
        for kind, step in (("part_right", 0), ("part_left", k)):
            i, row = np.nonzero(wanted[kind][k])
            if len(i):
                heads[row, i + k - step] = i + step + 1
                end, own = i[:, None] + k, row[:, None]
                c = (right[t, i[:, None], own] + left_to[k - 1 - t, end, own]).argmax(1)
                wanted["right"][c, i, row] = wanted["left"][k - 1 - c, i + c + 1, row] = True
    return heads, roots[best, rows]


def _cycle(heads: dict[int, int]) -> list[int] | None:
    done: set[int] = set()
    for v in heads:
        path, seen = [], set()
        while v in heads and v not in done and v not in seen:
            path.append(v)
            seen.add(v)
            v = heads[v]
        if v in seen:
            return path[path.index(v) :]
        done |= seen
    return None


def spanning(scores: np.ndarray) -> tuple[np.ndarray, float]:
    """scores (n + 1, n + 1) -> heads (n) of the best tree, projective or not, and its score."""
    n = len(scores) - 1
    s = scores.astype(float).copy()
    s[0, 1:] -= np.abs(s).sum() + 1  # so that the root takes one word only
    np.fill_diagonal(s, -np.inf)
    s[:, 0] = -np.inf
    size = 2 * n + 2
    grown = np.full((size, size), -np.inf)
    grown[: n + 1, : n + 1] = s
    alive, folded = list(range(n + 1)), []
    while True:
        at = np.array(alive)
        words = at[at != 0]
        heads = {int(v): int(at[k]) for v, k in zip(words, grown[np.ix_(at, words)].argmax(0), strict=True)}
        cycle = _cycle(heads)
        if cycle is None:
            break
        new, ring = n + 1 + len(folded), np.array(cycle)
        rest = np.array([v for v in alive if v not in set(cycle)])
        inner = grown[[heads[v] for v in cycle], ring]
        into = grown[np.ix_(rest, ring)] - inner[None, :]
        out = grown[np.ix_(ring, rest)]
        grown[rest, new], grown[new, rest] = into.max(1) + inner.sum(), out.max(0)
        folded.append((new, cycle, heads, dict(zip(rest.tolist(), ring[into.argmax(1)].tolist(), strict=True)), dict(zip(rest.tolist(), ring[out.argmax(0)].tolist(), strict=True))))
        alive = [*rest.tolist(), new]
    for new, cycle, own, entered, left in reversed(folded):
        entry = heads.pop(new)
        heads = {v: left[v] if h == new else h for v, h in heads.items()}
        broken = entered[entry]
        heads |= {v: entry if v == broken else own[v] for v in cycle}
    found = np.array([heads[v] for v in range(1, n + 1)], np.int32)
    return found, float(scores[found, np.arange(1, n + 1)].sum())
