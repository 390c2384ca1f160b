"""Bracketed trees: decoding, motifs and sentence types. Plain Python for one tree; the operators apply it in batches."""

from __future__ import annotations

import re

from quillon.functions.forest import Forest

# Node: [label, children, start, end] with children a list of nodes and words (str); words start .. end - 1 are below it.
_TOKEN = re.compile(r"\(\s*([^\s()]+)?|(\))|([^\s()]+)")
_TERMINAL = re.compile(r"\([A-Z$][A-Z0-9$-]*\)")


def decode(text: str) -> tuple[list, list[str]] | None:
    """The root and all words; None if the brackets don't make one tree."""
    top, stack, words = None, [], []
    for m in _TOKEN.finditer(text):
        label, close, word = m.groups()
        if close:
            if not stack:
                return None
            node = stack.pop()
            node[3] = len(words)
            if stack:
                stack[-1][1].append(node)
            else:
                top = node
        elif word is not None:
            if not stack:
                return None
            stack[-1][1].append(word)
            words.append(word)
        else:
            if top is not None:
                return None
            stack.append([label or "", [], len(words), 0])
    return None if stack or top is None else (top, words)


def nodes(text: str | None) -> list[tuple] | None:
    """(pre, post, depth, parent, ord, label, word) of every node and word in pre-order; post: the last pre below."""
    tree = decode(text) if text is not None else None
    if tree is None:
        return None
    out: list[list] = []
    stack: list = [(tree[0], 0, -1, 0)]
    while stack:
        node, depth, parent, place = stack.pop()
        if depth < 0:  # all below this one is done
            out[parent][1] = len(out) - 1
            continue
        pre = len(out)
        if isinstance(node, str):
            out.append([pre, pre, depth, parent, place, None, node])
            continue
        out.append([pre, pre, depth, parent, place, node[0], None])
        stack.append((None, -1, pre, 0))
        stack += [(child, depth + 1, pre, k) for k, child in enumerate(node[1])][::-1]
    return [tuple(x) for x in out]


def n_terminals(motif: str) -> int:
    return len(_TERMINAL.findall(motif))


def motifs(text: str, most: int = 4, least: int = 2, min_terminals: int = 2):
    """(motif, first word, end) for each node in pre-order and each depth."""
    forest = Forest(most, least, min_terminals)
    root = forest.root(text)
    if root is not None:
        yield from ((motif, a, b) for _, motif, a, b in forest.hits(root))


def sentence_types(text: str | None) -> tuple[str, str]:
    """Type I (clauses) and type II (where the main clause ends); ERROR for null or malformed trees."""
    forest = Forest(most=1)
    root = forest.root(text) if text is not None else None
    return ("ERROR", "ERROR") if root is None else forest.types(root)


def pretty(text: str) -> str:
    """The tree with one label for each line, indented by depth."""
    found = nodes(text)
    return "" if found is None else "\n".join("  " * n[2] + (n[5] if n[6] is None else n[6]) for n in found)
