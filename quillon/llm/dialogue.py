"""Repair of conversation structure: the cheapest edits that make the roles of a conversation read `(s?(ua)+)?`.

Edits: keep a row (K, 0), give it the role user or assistant (R, 3), delete it (D, 4; the only one for blank rows and
repeats), insert an empty user or assistant row (I, 3). A truncated row that stays costs 3 more. Of the cheapest lists of
edits the one with the ASCII-least initials is taken.

The role pattern is a weighted automaton of four states (nothing yet, after s, after u, after a). It is determinised
lazily: the vector of the states' least costs, closed under insertion and less its minimum, is one state of a
deterministic automaton, and (vector, symbol) -> (vector, added cost) is cached when first met. A state that another one
beats whatever follows drops out of its vector, so vectors are few, however long a conversation is. A scan through that
table gives the cost. A trace backwards over tight arcs, also cached, marks the states of cheapest paths, and reading
them forwards by the least letter gives the audit.

How rows move: equal rows (conversation, turn, role, text) are counted within tasks first, so repeats never pile up;
a row is a repeat if its (conversation, role, digest of the text) was first seen at an earlier turn, found by a minimum that is
also taken within tasks first. Only symbols and digests are then put in order for each conversation: they stream through
one task in Spark's sorter, and what the task holds of a conversation is some 30 bytes a row beside its audit. Texts move once more, behind the rows that stay.

Order within a conversation: turn (null first), then role, then the text's SHA-256. Null role or text count as one space.
Roles are known by their first character; one without any of s, u, a can't be kept. Null conversation ids form one
conversation. A conversation without rows has cost 0 and an empty audit. Empty input: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import batch, mapped, stored

#: Costs, and the states each row's class or an inserted row leads to (start, after s, after u, after a).
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {0: {START: SYSTEM}, 1: {START: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}, 3: {}}
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ENDS = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Symbols: 2 * class (s, u, a, other) + truncated; MUST_GO for blank rows and repeats.
MUST_GO = 8
NEVER = 1 << 40
SPACE = r"\x20\x09-\x0D"

SUMMARY = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Automaton:
    """The cached tables. A vector has a number; vectors[k] are its costs."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[int, tuple[int, int]] = {}
        self.marks: dict[tuple[int, int, int], int] = {}
        self.moves: dict[tuple[int, int, int, int, int], tuple[str, int]] = {}
        self.first, base = self._number([0, NEVER, NEVER, NEVER])
        assert base == 0

    def _number(self, costs: list[int]) -> tuple[int, int]:
        for _ in range(2):
            for p, q in NEXT.items():
                costs[q] = min(costs[q], costs[p] + INSERT)
        low = min(costs)
        costs = [min(c - low, NEVER) for c in costs]
        # what begins with nothing can begin after an answer for one deletion more; after s, for nothing more
        if costs[START] > costs[ASSISTANT] + DELETE:
            costs[START] = NEVER
        if costs[SYSTEM] > costs[ASSISTANT]:
            costs[SYSTEM] = NEVER
        key = tuple(costs)
        if key not in self.numbers:
            self.numbers[key] = len(self.vectors)
            self.vectors.append(key)
        return self.numbers[key], low

    @staticmethod
    def arcs(symbol: int) -> list[tuple[str, int, int, int]]:
        """(letter, from, to, cost) of the edits of a row."""
        out = [("D", p, p, DELETE) for p in range(4)]
        if symbol != MUST_GO:
            more = TRUNCATED * (symbol & 1)
            out += [("K", p, q, KEEP + more) for p, q in KEPT[symbol >> 1].items()]
            out += [("R", p, q, REROLE + more) for p, q in NEXT.items()]
        return out

    def step(self, vector: int, symbol: int) -> tuple[int, int]:
        at = vector * 9 + symbol
        found = self.steps.get(at)
        if found is None:
            own, costs = self.vectors[vector], [NEVER] * 4
            for _, p, q, cost in self.arcs(symbol):
                costs[q] = min(costs[q], own[p] + cost)
            found = self.steps[at] = self._number(costs)
        return found

    def tight_inserts(self, vector: int) -> list[tuple[int, int]]:
        own = self.vectors[vector]
        return [(p, q) for p, q in NEXT.items() if own[q] < NEVER and own[p] + INSERT == own[q]]

    def widened(self, vector: int, mask: int) -> int:
        """mask and the states from which tight insertions lead into it."""
        for _ in range(2):
            for p, q in self.tight_inserts(vector):
                if mask >> q & 1:
                    mask |= 1 << p
        return mask

    def before(self, vector: int, symbol: int, mask: int) -> int:
        """The marks before a row, from those (widened) behind it."""
        key = (vector, symbol, mask)
        found = self.marks.get(key)
        if found is None:
            to, low = self.step(vector, symbol)
            own, then, found = self.vectors[vector], self.vectors[to], 0
            for _, p, q, cost in self.arcs(symbol):
                if mask >> q & 1 and own[p] < NEVER and own[p] + cost == then[q] + low:
                    found |= 1 << p
            found = self.marks[key] = self.widened(vector, found)
        return found

    def move(self, vector: int, symbol: int, state: int, here: int, behind: int) -> tuple[str, int]:
        """The least letters (insertions, then one for the row) from `state` over a row along marked tight arcs."""
        key = (vector, symbol, state, here, behind)
        found = self.moves.get(key)
        if found is None:
            to, low = self.step(vector, symbol)
            own, then, letters, inserts = self.vectors[vector], self.vectors[to], "", dict(self.tight_inserts(vector))
            while True:
                options = [(x, q) for x, p, q, cost in self.arcs(symbol) if p == state and behind >> q & 1 and own[p] + cost == then[q] + low]
                if state in inserts and here >> inserts[state] & 1:
                    options.append(("I", inserts[state]))
                x, state = min(options)
                letters += x
                if x != "I":
                    break
            found = self.moves[key] = (letters, state)
        return found

    def repair(self, symbols: bytearray, times: array):
        """cost, audit, and two arrays over the rows of the result: which run it comes from (-1: inserted), and the state that
        names its new role (0: its own). symbols, times: the runs of a conversation; a run's later rows must go."""
        n, vector, cost = len(symbols), self.first, 0
        path = array("H", [vector])
        for k in range(n):
            vector, more = self.step(vector, symbols[k])
            cost += more + DELETE * (times[k] - 1)
            path.append(vector)
        own = self.vectors[vector]
        best = min(own[q] for q in ENDS)
        marks = bytearray(n + 1)
        marks[n] = self.widened(vector, sum(1 << q for q in ENDS if own[q] == best))
        for k in range(n - 1, -1, -1):
            marks[k] = self.before(path[k], symbols[k], marks[k + 1])
        letters, state = [], START
        kept, roles = array("q"), bytearray()
        for k in range(n):
            said, then = self.move(path[k], symbols[k], state, marks[k], marks[k + 1])
            for x in said:
                if x == "I":
                    state = NEXT[state]
                if x != "D":
                    kept.append(-1 if x == "I" else k)
                    roles.append(0 if x == "K" else NEXT[state] if x == "R" else state)
            letters.append(said + "D" * (times[k] - 1))
            state = then
        inserts = dict(self.tight_inserts(path[n]))
        while state not in ENDS or own[state] != best:
            state = inserts[state]
            letters.append("I")
            kept.append(-1)
            roles.append(state)
        return cost + best, "".join(letters), kept, roles


def prepared(turns: DataFrame) -> DataFrame:
    """Different rows of (conv_id, turn, role, text) with their number, stored: conv_id, turn, role, text, digest, n."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), value("role"), value("text"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    return counted.withColumn("digest", F.unhex(F.sha2("text", 256)))


def same(a: str, b: str, *keys: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def symbols(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, n, symbol, fault (blank, duplicate, truncated or null) of prepared() rows, without texts."""
    body = F.regexp_replace("text", rf"[{SPACE}]+$", "")
    marked = rows.select("conv_id", "turn", "role", "digest", "n", F.when(body == "", "blank").when(~body.rlike(r"[.!?]\z"), "truncated").alias("fault"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # null turns come first
    first = marked.where(F.col("fault").isNull() | (F.col("fault") != "blank")).groupBy("conv_id", "role", "digest").agg(F.min(at).alias("at"))
    both = marked.alias("m").join(first.alias("f"), same("m", "f", "conv_id", "role", "digest"), "left").select("m.*", F.col("f.at.turn").alias("first"), F.col("f.at").isNotNull().alias("seen"))
    fault = F.when(F.col("seen") & ~F.col("first").eqNullSafe(F.col("turn")), "duplicate").otherwise(F.col("fault"))
    kind = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    kind = F.when(F.col("role") == "", 3).otherwise(kind)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).otherwise(2 * kind + (F.coalesce("fault", F.lit("")) == "truncated").cast("int"))
    return both.withColumn("fault", fault).withColumn("symbol", symbol.cast("int")).drop("first", "seen")


def edits(marked: DataFrame) -> DataFrame:
    """Rows of two kinds: `summary` (SUMMARY, one for each conversation) and, without it, an output row for each kept or
    inserted row: conv_id, no, new_role (null for the row's own) and pos, the row's place (null if inserted)."""
    ordered = marked.select("conv_id", "turn", "role", "digest", "n", "symbol", F.substring("role", 1, 1).alias("initial"), F.array_position(F.array(*map(F.lit, ("blank", "duplicate", "truncated"))), F.col("fault")).cast("int").alias("fault"))
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    schema = pa.schema([(x, pa.string() if x == "audit" else pa.int64()) for x in names] + [("pos", pa.int64()), ("no", pa.int64()), ("new_role", pa.string())])
    legal = {("s", "u"), ("u", "a"), ("a", "u")}

    def run(batches):
        machine, now, known = Automaton(), None, False
        for part in batches:
            columns = [part.column(c) for c in ("conv_id", "turn", "initial", "n", "symbol", "fault")]
            for conv, turn, initial, n, symbol, fault in zip(*(c.to_pylist() for c in columns), strict=True):
                if not known or conv != now.conv:
                    if known:
                        yield from done(machine, now)
                    now, known = Conversation(conv), True
                now.add(turn, initial, n, symbol, fault or 0)
        if known:
            yield from done(machine, now)

    class Conversation:
        def __init__(self, conv):
            self.conv, self.symbols, self.times, self.counts = conv, bytearray(), array("q"), [0] * 4
            self.low = self.turn = self.last = None
            self.different = self.illegal = self.n_rows = 0

        def add(self, turn, initial, n, symbol, fault):
            if turn is not None and turn != self.turn:
                self.low = turn if self.low is None else self.low
                self.turn, self.different = turn, self.different + 1
            self.illegal += (self.n_rows > 0 and (self.last, initial) not in legal) + n - 1
            self.counts[fault] += 1
            self.counts[1 if fault == 1 else 2] += n - 1  # the same row again is a repeat, if it isn't blank
            self.last, self.n_rows = initial, self.n_rows + n
            self.symbols.append(symbol)
            self.times.append(n)

    def done(machine, c):
        cost, audit, kept, roles = machine.repair(c.symbols, c.times)
        gaps = 0 if c.low is None else c.turn - c.low + 1 - c.different
        nothing = [None] * 3
        yield batch(schema, *([x] for x in (c.conv, c.n_rows, gaps, *c.counts[1:], c.illegal, cost, audit, *nothing)))
        kept, roles = np.frombuffer(kept, np.int64), np.frombuffer(bytes(roles), np.uint8)
        for k in range(0, len(kept), 10_000):
            pos, some = kept[k : k + 10_000], roles[k : k + 10_000]
            blank = [pa.nulls(len(pos), f.type) for f in list(schema)[1 : len(names)]]
            yield batch(schema, pa.array([c.conv] * len(pos), pa.int64()), *blank, pa.array(pos, mask=pos < 0), np.arange(k, k + len(pos)), [ROLES.get(int(x)) for x in some])

    # the sorter numbers a conversation's rows as it streams them to the scan; the same order numbers the rows again below
    return mapped(ordered.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest"), run, SUMMARY + ", pos long, no long, new_role string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: SUMMARY for each conversation that has rows, and the repaired rows: conv_id, no, edit, role, text."""
    rows = stored(prepared(turns))
    marked = stored(symbols(rows))
    found = stored(edits(marked))
    summary = found.where("audit IS NOT NULL").select(*(f.split()[0] for f in SUMMARY.split(", ")))
    kept = found.where("audit IS NULL").select("conv_id", "pos", "no", "new_role")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")) - 1
    placed = marked.select("conv_id", "turn", "role", "digest").withColumn("pos", pos)
    named = kept.where("pos IS NOT NULL").alias("k").join(placed.alias("p"), same("k", "p", "conv_id") & (F.col("k.pos") == F.col("p.pos"))).select("p.conv_id", "p.turn", "p.role", "p.digest", "k.no", "k.new_role")
    said = named.alias("k").join(rows.alias("r"), same("k", "r", "conv_id", "turn") & (F.col("k.role") == F.col("r.role")) & (F.col("k.digest") == F.col("r.digest")))
    own = said.select("k.conv_id", "k.no", F.when(F.col("k.new_role").isNull(), "K").otherwise("R").alias("edit"), F.coalesce("k.new_role", "r.role").alias("role"), "r.text")
    added = kept.where("pos IS NULL").select("conv_id", "no", F.lit("I").alias("edit"), F.col("new_role").alias("role"), F.lit("").alias("text"))
    return summary, own.unionByName(added)


def digests(conversations: DataFrame, summary: DataFrame, repaired: DataFrame) -> DataFrame:
    """A row for each conv_id of `conversations`: SUMMARY without n_rows (zeros where nothing is left) and repaired_sha256 over
    `role:text`, newline-joined, which is read in order in one task for a conversation, in a stream."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches):
        conv, state = None, None
        for part in batches:
            done = []
            for c, no, role, text in zip(*(part.column(x).to_pylist() for x in ("conv_id", "no", "role", "text")), strict=True):
                if no == 0:
                    if state:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield batch(schema, *map(list, zip(*done, strict=True)))
        if state:
            yield batch(schema, [conv], [state.hexdigest()])

    hashed = mapped(repaired.select("conv_id", "no", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "no"), run, "conv_id long, repaired_sha256 string")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.alias("i").join(summary.alias("s"), same("i", "s", "conv_id"), "left").join(hashed.alias("h"), same("i", "h", "conv_id"), "left")
    zero = [F.coalesce(f"s.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("i.conv_id", *zero, F.coalesce("s.audit", F.lit("")).alias("audit"), F.coalesce("h.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties it, 2 takes its `[.!?]`,
    3 repeats it, 4 makes it the user's. Nulls count as one space."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", value("conv_id"), value("turn"))) % 20
    rows = turns.select("conv_id", "turn", value("role").alias("role"), value("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fault")
    return rows.withColumn("_n", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_n", "fault")
