"""Chat formatting by columnar byte assembly.

One hash exchange by conversation, sorted by turn; then each Arrow batch is assembled at once.
Segment lengths and their cumulative sums give the place of each segment, and headers and contents are scattered into
one preallocated buffer that becomes the Arrow column. The output is in pieces (conversation, piece number), one for
each conversation and batch, so a conversation of any length takes bounded memory.

Template of a turn: <|im_start|>ROLE\\nTEXT<|im_end|>\\n. Control strings of this and other common templates inside a
role or text get a backslash after their first character, and a backslash is doubled; `unescape` takes both back.
The loss mask is a list of byte spans of assistant texts.

Null text or role: empty. Null conversation ids form one conversation, which comes first; turns with equal numbers
follow role, then text. Empty input: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import batch, buffers, chunks, mapped, ranges, texts_of

# Control strings of public chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"]
START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"

_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)")
_MAYBE = r"[\\<\[]"
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)

PIECES = "conv_id long, piece int, n_turns int, formatted binary, loss_start array<int>, loss_end array<int>"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _escaped(column: pa.Array, newline: bool = False) -> pa.Array:
    column = texts_of(column)
    rows = np.flatnonzero(pc.match_substring_regex(column, _MAYBE + ("|\n" if newline else "")).to_numpy(zero_copy_only=False))
    if not len(rows):
        return column
    said = column.to_pylist()
    for k in rows:
        said[k] = escape(said[k])
        if newline:
            said[k] = said[k].replace("\n", "\\\n")
    return pa.array(said, pa.string())


def _assembled(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, the turns' n + 1 offsets, and start and end of each text."""
    n = len(role)
    (role_data, role_at), (text_data, text_at) = buffers(role), buffers(text)
    role_len, text_len = np.diff(role_at).astype(np.int64), np.diff(text_at).astype(np.int64)
    ends = np.cumsum(len(START) + role_len + len(MIDDLE) + text_len + len(END))
    offsets = np.concatenate([[0], ends])
    role_to = offsets[:-1] + len(START)
    text_to = role_to + role_len + len(MIDDLE)
    out = np.empty(offsets[-1], np.uint8)
    for const, to in ((START, offsets[:-1]), (MIDDLE, role_to + role_len), (END, text_to + text_len)):
        out[to[:, None] + np.arange(len(const))] = np.frombuffer(const, np.uint8)
    for data, at, length, to in ((role_data, role_at, role_len, role_to), (text_data, text_at, text_len, text_to)):
        out[ranges(to, length)] = data[at[0] : at[n]]
    return out, offsets, text_to, text_to + text_len


def format_conversations(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> pieces (PIECES), in order within each partition."""
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("n_turns", pa.int32()), ("formatted", pa.binary()), ("loss_start", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32()))])

    def run(batches):
        last, piece = object(), 0
        for part in chunks(batches, "text"):
            conv = part.column("conv_id").to_pylist()
            role, text = part.column("role"), _escaped(part.column("text"))
            out, offsets, start, end = _assembled(_escaped(role, newline=True), text)
            loss = pc.fill_null(pc.equal(role, "assistant"), False).to_numpy(zero_copy_only=False)
            firsts = [k for k in range(len(conv)) if not k or conv[k] != conv[k - 1]]
            bounds = np.array([*firsts, len(conv)])
            at = offsets[bounds].astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(at), pa.py_buffer(out)])
            kept = np.flatnonzero(loss)
            base = np.repeat(at[:-1], np.diff(bounds))
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, bounds).astype(np.int32)), pa.array((x - base)[kept].astype(np.int32))) for x in (start, end)]
            numbers = []
            for k in firsts:
                piece = piece + 1 if conv[k] == last else 0
                last = conv[k]
                numbers.append(piece)
            yield batch(schema, [conv[k] for k in firsts], numbers, np.diff(bounds).astype(np.int32), column, *lists)

    turns = df.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return mapped(turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), run, PIECES)


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation from its pieces alone, which must come in order (as from format_conversations)."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        now = None
        for part in batches:
            done = []
            for row in part.to_pylist():
                if now is None or row["piece"] == 0:
                    if now:
                        done.append(now)
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                whole = row["formatted"]
                said = whole.decode()
                for role, text in _TURN.findall(said):
                    now[1] += 1
                    now[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                for a, b in zip(row["loss_start"], row["loss_end"], strict=True):
                    text = unescape(whole[a:b].decode())
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(said)
            if done:
                yield _closed(schema, done)
        if now:
            yield _closed(schema, [now])

    return mapped(pieces, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _closed(schema: pa.Schema, rows: list[list]) -> pa.RecordBatch:
    return batch(schema, *map(list, zip(*[[x.hexdigest() if hasattr(x, "hexdigest") else x for x in r] for r in rows], strict=True)))
