"""A forest of trees in which equal subtrees are one node, so that work is done once for each different subtree.

A node is its label and its children's numbers, made from the leaves upwards without recursion, so a child's number is
below its parent's. Patterns cut at depth 1 to `most` are put together from the children's patterns of the depth before,
once for each different subtree and depth; where only some patterns are wanted, only what these are made of. Counting only notes how often each tree was seen; sums() carries these numbers
down from parents to children and reads each node's patterns off once. `size` estimates the bytes held, for callers that
start anew at a limit.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections import Counter
from collections.abc import Iterator

#: A phrase of leaves and a leaf are tokens of their own, looked up whole; then opening and closing brackets and words.
_TOKEN = re.compile(r"\([^\s()]+(?: \([^\s()]+ _\))+\)|\([^\s()]+ _\)|\(\s*[^\s()]*|\)|[^\s()]+")
_LEAF, _ENDS = re.compile(r"\(([^\s()]+) _\)"), re.compile(r"\([A-Z$][A-Z0-9$-]* _\)")
_TERMINAL = re.compile(r"\([A-Z$][A-Z0-9$-]*\)")
#: A word and the space before it; what follows an opening bracket is a label, also behind a space.
_WORD = re.compile(r"(?<=[^\s(])\s+([^()\s]+)")
_RUN = re.compile(r"{0}(?: {0})*".format(r"\((?!(?:S|SBAR|VP) )[^\s()]+ [^\s()]+\)"))
#: Stands for a word among a node's children.
WORD = -1
#: Stands for any pattern that no wanted one has as a part.
OTHER = -1
#: Bytes that a forest may take before its owner starts a new one.
LIMIT = 64 << 20


def shape(text: str) -> str:
    """The tree with each word replaced by the same sign."""
    return _WORD.sub(" _", text)


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def outline(text: str) -> str:
    """The tree with each run of leaves replaced by one leaf, but for labels that types() looks at: far fewer trees have
    different outlines than different shapes. Malformed trees stay malformed."""
    said = _RUN.sub("(X _)", text)
    return text if said.strip() == "(X _)" else said  # two roots would be one


@functools.lru_cache(maxsize=4)
def parts(wanted: frozenset[str]) -> frozenset[str]:
    """The patterns with all their subtrees: what a pattern of `wanted` is put together from."""
    found = set(wanted)
    for pattern in wanted:
        opened = []
        for k, sign in enumerate(pattern):
            if sign == "(":
                opened.append(k)
            elif sign == ")" and opened:
                found.add(pattern[opened.pop() : k + 1])
    return frozenset(found)


class Forest:
    def __init__(self, most: int = 4, least: int = 2, min_terminals: int = 2, wanted: frozenset[str] | None = None):
        self.most, self.least, self.min_terminals, self.wanted = most, least, min_terminals, wanted
        self.parts = None if wanted is None else parts(wanted)
        self.nodes: dict[tuple, int] = {}
        self.roots: dict[str, int | None] = {}  # whole shapes, for corpora that repeat them
        self.whole: dict[str, int] = {}  # leaves and phrases of leaves
        self.phrases: dict[str, int] = {}  # those whose leaves aren't nodes
        self.bare = most > 1 and min_terminals > 1  # a leaf has no patterns
        self.labels: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.width: list[int] = []  # words below
        self.cuts: list[tuple[int, ...]] = []  # the patterns of depth 1 to most, by number
        self.own: list[tuple[int, ...]] = []  # those that are emitted
        self.terminals: list[tuple[int, ...]] = []  # how many each of the cuts has
        self.emitted: list[int] = []  # how many are emitted here and below
        self.hit: list[bool] = []  # whether a wanted one is among them
        self.dependent: list[bool] = []  # whether there is an SBAR here or below
        self.clause: list[bool] = []  # or an S
        self.patterns: list[str] = []
        self.numbers: dict[str, int] = {}
        self.chosen: list[bool] = []
        self.size = 0
        self.seen = 0  # nodes of all trees, to compare with len(self.nodes)

    def root(self, text: str) -> int | None:
        """The number of the tree; None if the brackets don't make one tree."""
        key = shape(text)
        if key in self.roots:
            return self.roots[key]
        found = self.roots[key] = self._read(key)
        self.size += 150 + len(key)
        return found

    def _read(self, text: str) -> int | None:
        labels: list[str] = []
        below: list[list[int]] = []
        top = None
        for token in _TOKEN.findall(text):
            if token == ")":
                if not labels:
                    return None
                node = self.node(labels.pop(), tuple(below.pop()))
                self.seen += 1
                if labels:
                    below[-1].append(node)
                else:
                    top = node
            elif token[0] == "(":
                if top is not None:
                    return None
                if token[-1] == ")":
                    self.seen += token.count("(")
                    if labels and self.bare and token[-2] == ")":
                        node = self.phrases.get(token)
                        below[-1].append(self._phrase(token) if node is None else node)
                        continue
                    node = self.whole.get(token)
                    if node is None:
                        node = self._whole(token)
                    if labels:
                        below[-1].append(node)
                    else:
                        top = node
                    continue
                labels.append(token[1:].lstrip())
                below.append([])
            elif labels:
                below[-1].append(WORD)
            else:
                return None
        return None if labels else top

    def _whole(self, token: str) -> int:
        if (leaf := _LEAF.fullmatch(token)) is not None:
            found = self.node(leaf[1], (WORD,))
        else:
            label, _, below = token[1:-1].partition(" ")
            kids = []
            for x in below[:-1].split(") "):
                leaf = self.whole.get(x + ")")
                kids.append(self._whole(x + ")") if leaf is None else leaf)
            found = self.node(label, tuple(kids))
        self.whole[token] = found
        self.size += 150 + len(token)
        return found

    def _phrase(self, token: str) -> int:
        """A phrase of leaves below another node, where no leaf has patterns of its own: its leaves are words to it, and it is
        cut alike at each depth but the first."""
        found = self.phrases[token] = len(self.labels)
        label = token[1 : token.index(" ")]
        top, cut = self._pattern(f"({label})"), self._pattern(token.replace(" _", ""))
        own = () if len(_ENDS.findall(token)) < self.min_terminals else (cut,) * (self.most - max(self.least, 2) + 1)
        width = token.count(" _")
        self.labels.append(label)
        self.kids.append((WORD,) * width)
        self.terminals.append((1 if _TERMINAL.fullmatch(f"({label})") else 0, *[len(_ENDS.findall(token))] * (self.most - 1)))
        self.cuts.append((top, *[cut] * (self.most - 1)))
        self.own.append(own)
        self.width.append(width)
        self.emitted.append(len(own))
        self.hit.append(bool(own) and cut != OTHER and self.chosen[cut])
        self.dependent.append("(SBAR " in token)
        self.clause.append("(SBAR " in token or "(S " in token)
        self.size += 690 + 9 * len(token)
        return found

    def node(self, label: str, kids: tuple[int, ...]) -> int:
        found = self.nodes.get((label, kids))
        if found is None:
            found = self.nodes[label, kids] = len(self.labels)
            real = [c for c in kids if c != WORD]
            self.labels.append(label)
            self.kids.append(kids)
            width, emitted = len(kids) - len(real), 0
            hit, dependent, clause = False, label == "SBAR", label in ("S", "SBAR")
            for c in real:
                width += self.width[c]
                emitted += self.emitted[c]
                hit, dependent, clause = hit or self.hit[c], dependent or self.dependent[c], clause or self.clause[c]
            cuts = [self._pattern(f"({label})")]
            below = [self.cuts[c] for c in real]
            terminals = [1 if _TERMINAL.fullmatch(f"({label})") else 0]
            ends = [self.terminals[c] for c in real]
            for d in range(1, self.most):
                terminals.append(sum([e[d - 1] for e in ends]) if real else terminals[0])
                if not real or d > 1 and all([c[d - 1] == c[d - 2] for c in below]):  # cut no further down
                    cuts.append(cuts[-1])
                elif self.parts is not None and any([c[d - 1] == OTHER for c in below]):
                    cuts.append(OTHER)
                else:
                    cuts.append(self._pattern(f"({label} {' '.join([self.patterns[c[d - 1]] for c in below])})"))
            own = tuple(cuts[d] for d in range(self.least - 1, self.most) if terminals[d] >= self.min_terminals)
            self.terminals.append(tuple(terminals))
            self.cuts.append(tuple(cuts))
            self.own.append(own)
            self.width.append(width)
            self.emitted.append(len(own) + emitted)
            self.hit.append(hit or any([m != OTHER and self.chosen[m] for m in own]))
            self.dependent.append(dependent)
            self.clause.append(clause)
            self.size += 540 + 16 * len(kids)
        return found

    def _pattern(self, said: str) -> int:
        found = self.numbers.get(said)
        if found is None:
            if self.parts is not None and said not in self.parts:
                return OTHER
            found = self.numbers[said] = len(self.patterns)
            self.patterns.append(said)
            self.chosen.append(self.wanted is None or said in self.wanted)
            self.size += 170 + len(said)
        return found

    def times(self, roots: Counter) -> Iterator[tuple[int, int]]:
        """(node, how often it is in trees that were seen so often), parents before children."""
        times, order = dict(roots), [-r for r in roots]
        heapq.heapify(order)
        while order:
            k = -heapq.heappop(order)
            n = times.pop(k)
            yield k, n
            for c in self.kids[k]:
                if c != WORD:
                    if c in times:
                        times[c] += n
                    else:
                        times[c] = n
                        heapq.heappush(order, -c)

    def sums(self, roots: Counter) -> Counter:
        """How often each pattern (by number) is in trees that were seen so often."""
        out = Counter()
        for k, n in self.times(roots):
            for m in self.own[k]:
                out[m] += n
        return out

    def hits(self, root: int) -> Iterator[tuple[int, str, int, int]]:
        """(place, pattern, first word, end) of the wanted patterns in pre-order; place counts the others too. Subtrees
        without any are stepped over."""
        stack, place = [(root, 0)], 0
        while stack:
            k, word = stack.pop()
            if not self.hit[k]:
                place += self.emitted[k]
                continue
            for m in self.own[k]:
                if m != OTHER and self.chosen[m]:
                    yield place, self.patterns[m], word, word + self.width[k]
                place += 1
            below = []
            for c in self.kids[k]:
                if c == WORD:
                    word += 1
                else:
                    below.append((c, word))
                    word += self.width[c]
            stack += below[::-1]

    def types(self, root: int) -> tuple[str, str]:
        """Type I (clauses) and type II (where the main clause ends)."""
        tops = [c for c in self.kids[root] if c != WORD]
        names = {self.labels[c] for c in tops}
        if "S" in names:
            first = "COMPLEX-COMPOUND" if self.dependent[root] else "COMPOUND"
        elif "VP" in names:
            first = "COMPLEX" if self.dependent[root] else "SIMPLE"
        else:
            first = "OTHER"
        clause = next((c for c in tops if self.clause[c]), None)
        return first, "OTHER" if clause is None else "LOOSE" if self.labels[clause] == "VP" else "PERIODIC"
