"""Conversation structure repair: the cheapest edits that make the roles of a conversation
``(s?(ua)+)?`` (system at most once and first, then user and assistant in turns).

Rows may be kept, given another role, deleted, and empty rows inserted. What the rest of
a conversation costs depends on the rows to come and on one of four states (nothing yet,
after system, user, assistant). Less their minimum, these cost vectors take a handful of
values, so the change that ``BLOCK`` rows make to each of them is worked out beforehand
for every block of row symbols (the method of the Four Russians). A conversation is read
from its end, one lookup a block, which leaves the vector behind each block; then each
block is expanded backward from that vector and traced forward, and at each step the
least letter among the cheapest edits is taken, so that ties are settled for the whole.

Spark deals the rows by ranges of (conversation, turn), so that a conversation with a
third of all rows spans many tasks. Each task cuts its conversations into pieces of bounded
size. A conversation inside one task is finished there; pieces of the two at a task's ends
go on: one byte a row tells the vector behind and the state before each piece, and
the pieces are then traced apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import staged

#: Costs of the edits; a row that ends without a stop costs one more unless it is deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows a table block.
BLOCK = 4
#: Rows and characters of a piece of a conversation at most (a single longer row is a piece).
PIECE_ROWS, PIECE_CHARS = 4096, 4 << 20
#: Blanks: all that is no word.
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"

# States: nothing yet, after system, after user, after assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: State after an inserted or rewritten row, and the role it gets.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: Cost left in each state when no row is left: what has begun must be filled up.
END = (0, 2 * INSERT, INSERT, 0)
# Symbols of a row: initial s, u, a or another, times two, plus one if truncated; or one to delete.
INITIALS = {"s": 0, "u": 2, "a": 4}
MUST_DELETE, SYMBOLS = 8, 9
NONE, IS_BLANK, IS_DUPLICATE, IS_TRUNCATED = range(4)


def kept_state(state: int, symbol: int) -> int | None:
    """State after the row as it is, None if its role cannot stand there."""
    role = symbol // 2
    if role == 0 and state == EMPTY:
        return SYSTEM
    if role == 1 and state != USER:
        return USER
    return ASSISTANT if role == 2 and state == USER else None


def edits(state: int, symbol: int, behind: tuple[int, ...]) -> Iterator[tuple[str, int, int]]:
    """(letter, cost with what follows, next state) of the edits of a row, by letter; ``behind`` is the cost after it."""
    yield "D", DELETE + behind[state], state
    if symbol != MUST_DELETE:
        late = TRUNCATED * (symbol % 2)
        kept = kept_state(state, symbol)
        if kept is not None:
            yield "K", KEEP + late + behind[kept], kept
        yield "R", REROLE + late + behind[NEXT[state]], NEXT[state]


def before(symbol: int, behind: tuple[int, ...]) -> tuple[int, ...]:
    """Cost in each state before a row, insertions in front of it included."""
    row = [min(cost for _, cost, _ in edits(s, symbol, behind)) for s in range(4)]
    return tuple(min(row[s], INSERT + row[NEXT[s]], 2 * INSERT + row[NEXT[NEXT[s]]]) for s in range(4))


class Tables:
    """Normalised cost vectors, and which of them stands before each symbol and each block of symbols."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors = [END]
        number = {END: 0}
        step = []
        for vector in self.vectors:  # grows until no new vector turns up
            row = []
            for symbol in range(SYMBOLS):
                cost = before(symbol, vector)
                cost = tuple(c - min(cost) for c in cost)
                if cost not in number:
                    number[cost] = len(self.vectors)
                    self.vectors.append(cost)
                row.append(number[cost])
            step.append(row)
        self.step = np.array(step, dtype=np.int16)
        jump = self.step
        for _ in range(block - 1):  # one more symbol in front
            jump = self.step[jump[:, None, :], np.arange(SYMBOLS)[None, :, None]].reshape(len(step), -1)
        self.jump = jump.tolist()
        self.trace = lru_cache(maxsize=1 << 20)(self._trace)

    def _trace(self, vector: int, symbols: bytes, state: int) -> tuple[str, int]:
        """Edits of a block from ``state``, with ``vector`` behind it, and the state after it."""
        behind = [self.vectors[vector]]
        for symbol in reversed(symbols):
            behind.append(before(symbol, behind[-1]))
        behind.reverse()
        letters = []
        for at, symbol in enumerate(symbols):
            here, done = behind[at], False
            while not done:
                options = list(edits(state, symbol, behind[at + 1]))
                options.append(("I", INSERT + here[NEXT[state]], NEXT[state]))
                letter, _, to = min(o for o in options if o[1] == here[state])
                letters.append(letter)
                state, done = to, letter != "I"
        return "".join(letters), state

    def vectors_behind(self, symbols: bytes, last: int) -> list[int]:
        """Vector before the first symbol and behind each block, ``last`` behind the last; a short block comes first."""
        out, vector, b = [last], last, self.block
        for at in range(len(symbols) - b, -1, -b):
            code = 0
            for symbol in symbols[at:at + b]:
                code = code * SYMBOLS + symbol
            vector = self.jump[vector][code]
            out.append(vector)
        for symbol in reversed(symbols[:len(symbols) % b]):
            vector = int(self.step[vector][symbol])
        if len(symbols) % b:
            out.append(vector)
        return out[::-1]

    def traced(self, symbols: bytes, last: int, state: int) -> tuple[str, int]:
        """Cheapest edits, least by letters, from ``state`` through all ``symbols``, and the state after them."""
        behind = self.vectors_behind(symbols, last)[1:]
        short = len(symbols) % self.block
        ends = range(short or self.block, len(symbols) + 1, self.block)
        letters, at = [], 0
        for end, vector in zip(ends, behind, strict=True):
            more, state = self.trace(vector, symbols[at:end], state)
            letters.append(more)
            at = end
        return "".join(letters), state


@lru_cache(maxsize=4)
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def closing(state: int) -> str:
    """Insertions after the last row."""
    return "I" * (END[state] // INSERT)


def apply(letters: str, symbols: bytes, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str], int]:
    """Roles and texts after the edits, and their cost."""
    out_roles, out_texts, cost, at = [], [], 0, 0
    for letter in letters:
        if letter == "I":
            out_roles.append(ROLE[state])
            out_texts.append("")
            cost += INSERT
            state = NEXT[state]
            continue
        symbol = symbols[at]
        if letter == "D":
            cost += DELETE
        else:
            cost += (REROLE if letter == "R" else KEEP) + TRUNCATED * (symbol % 2)
            out_roles.append(roles[at] if letter == "K" else ROLE[state])
            out_texts.append(texts[at])
            state = kept_state(state, symbol) if letter == "K" else NEXT[state]
        at += 1
    return out_roles, out_texts, cost


PIECE_FIELDS = [("part", pa.int32()), ("k", pa.int64()), ("whole", pa.bool_()), ("symbols", pa.binary()), ("roles", pa.list_(pa.string())),
                ("texts", pa.list_(pa.string())), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                ("first_initial", pa.string()), ("last_initial", pa.string()), ("turn_min", pa.int64()), ("turn_max", pa.int64()), ("turns", pa.int64()),
                ("audit", pa.string()), ("cost", pa.int64())]
PIECE_DDL = ("part int, k bigint, whole boolean, symbols binary, roles array<string>, texts array<string>, blank bigint, duplicate bigint, truncated bigint, "
             "illegal bigint, first_initial string, last_initial string, turn_min bigint, turn_max bigint, turns bigint, audit string, cost bigint")


class _Piece:
    """Rows of one conversation that follow each other, with what the report needs of them."""

    def __init__(self, conv, part: int, k: int):
        self.conv, self.part, self.k = conv, part, k
        self.chars, self.symbols, self.roles, self.texts = 0, bytearray(), [], []
        self.faults = [0, 0, 0, 0]
        self.illegal, self.first, self.last = 0, None, None
        self.turn_min, self.turn_max, self.turns = None, None, 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        words = text.rstrip(BLANK)
        fault = IS_BLANK if not words else IS_DUPLICATE if seen else NONE if words[-1] in ".!?" else IS_TRUNCATED
        self.faults[fault] += 1
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.last = initial
        if turn is not None and turn != self.turn_max:
            self.turn_min = turn if self.turn_min is None else self.turn_min
            self.turn_max = turn
            self.turns += 1
        self.symbols.append(MUST_DELETE if fault in (IS_BLANK, IS_DUPLICATE) else INITIALS.get(initial, 6) + (fault == IS_TRUNCATED))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)

    def full(self, most: int) -> bool:
        return len(self.roles) >= most or self.chars >= PIECE_CHARS

    def record(self, whole: bool) -> dict:
        symbols = bytes(self.symbols)
        out = {"conv": self.conv, "part": self.part, "k": self.k, "whole": whole, "symbols": symbols, "roles": self.roles, "texts": self.texts,
               "blank": self.faults[IS_BLANK], "duplicate": self.faults[IS_DUPLICATE], "truncated": self.faults[IS_TRUNCATED], "illegal": self.illegal,
               "first_initial": self.first, "last_initial": self.last, "turn_min": self.turn_min, "turn_max": self.turn_max, "turns": self.turns}
        return repaired(out, 0, EMPTY, True) if whole else out


def repaired(piece: dict, behind: int, state: int, last: bool) -> dict:
    """A piece's record with its rows edited."""
    letters, end = tables().traced(piece["symbols"], behind, state)
    letters += closing(end) if last else ""
    roles, texts, cost = apply(letters, piece["symbols"], state, piece["roles"], piece["texts"])
    return {**piece, "roles": roles, "texts": texts, "audit": letters, "cost": cost}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(records: Iterator[dict], schema: pa.Schema, size=lambda r: 1, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Records in batches of bounded size."""
    held, total = [], 0
    for record in records:
        held.append(record)
        total += 1 + size(record)
        if total >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _chars(record: dict) -> int:
    return 64 + sum(map(len, record["texts"]))


def _pieces(rows: Iterator[tuple], part: int, most: int = PIECE_ROWS) -> Iterator[dict]:
    """Pieces of a task's conversations, from rows (conv, turn, role, th, kind, text) sorted by all but the text.

    The first and the last conversation may go on in other tasks; the others are whole.
    """
    piece, first, mark, conv = None, True, None, object()
    for c, turn, role, th, kind, text in rows:
        if piece is None or c != conv:
            if piece is not None:
                yield piece.record(whole=not first and piece.k == 0)
                first = False
            piece, mark, conv = _Piece(c, part, 0), None, c
        if kind == 2:  # only names the conversation
            continue
        key = (turn, role, th)
        if kind == 1:
            if piece.full(most):
                yield piece.record(whole=False)
                piece = _Piece(c, part, piece.k + 1)
            piece.add(turn, role, text, seen=key == mark)
        mark = key
    if piece is not None:
        yield piece.record(whole=False)


def _plan(rows: Iterator[tuple]) -> Iterator[dict]:
    """Vector behind and state before each piece, from (conv, part, k, symbols) sorted by conversation and backward."""
    held: list[tuple] = []

    def forward() -> Iterator[dict]:
        state = EMPTY
        for at in range(len(held) - 1, -1, -1):
            conv, part, k, behind, ends = held[at]
            yield {"conv": conv, "part": part, "k": k, "behind": behind, "state": state, "last": at == 0}
            state = ends[state]

    vector = 0
    for conv, part, k, symbols in rows:
        if held and conv != held[-1][0]:
            yield from forward()
            held, vector = [], 0
        held.append((conv, part, k, vector, [tables().traced(symbols, vector, s)[1] for s in range(4)]))
        vector = tables().vectors_behind(symbols, vector)[0]
    yield from forward()


def repair(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           live: Column | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The repaired conversations, in pieces: ``conv, part, k`` (order of a conversation's pieces), ``whole`` (the only piece),
    ``roles`` and ``texts`` (after the edits), ``audit`` (the edits' initials K, R, D, I), ``cost`` and, of the rows before the edits,
    the counts ``blank, duplicate, truncated, illegal``, first and last initial, and ``turn_min, turn_max, turns`` (different ones).

    Rows are taken by turn, null turns first; rows of one turn by role, then by the MD5 of role
    and text. Null role or text: one space. Where ``live`` is not true the row only
    makes its conversation appear. A row is blank without a word; a duplicate if a row
    before it has its role and text (by 128 bits of MD5); truncated if its last word does
    not end in ``.``, ``!`` or ``?``. Blank rows and duplicates must be deleted.

    Null conversation ids are one conversation. A role counts by its first letter; an
    empty one, or any letter but s, u and a, cannot be kept. Texts of any length are kept
    whole. Empty table: empty result. Other columns play no part, whatever their names.
    ``piece_rows``: rows of a piece at most; it changes the cut, not the repair.
    """
    col = {n: F.col(f"`{c}`") for n, c in (("conv", conv_col), ("turn", turn_col), ("role", role_col), ("text", text_col))}
    role, text = (F.coalesce(col[n].cast("string"), F.lit(" ")) for n in ("role", "text"))
    kind = F.lit(1) if live is None else F.when(live, 1).otherwise(2)
    th = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    named = rows.select(col["conv"].alias("conv"), col["turn"].cast("long").alias("turn"), role.alias("role"), th.alias("th"), kind.alias("kind"), text.alias("text"))
    named = named.select("conv", *[F.when(F.col("kind") == 1, F.col(c)).alias(c) for c in ("turn", "role", "th")], "kind",
                         F.when(F.col("kind") == 1, F.col("text")).alias("text"))

    # Rows whose role and text stand at an earlier turn: narrow rows, combined map-side. Equal rows of one turn are neighbours.
    cells = staged(named.where("kind = 1").groupBy("conv", "turn", "role", "th").agg(F.lit(0).alias("kind")), "repair-cells")
    firsts = staged(cells.groupBy("conv", "th").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
                    .select(F.col("conv").alias("c"), F.col("th").alias("h"), "first"), "repair-firsts")
    seen = (cells.join(firsts, cells["conv"].eqNullSafe(firsts["c"]) & (cells["th"] == firsts["h"]))
            .where(~F.col("turn").eqNullSafe(F.col("first.turn"))).select("conv", "turn", "role", "th", "kind", F.lit(None).cast("string").alias("text")))

    order = ["conv", "turn", "role", "th"]
    dealt = named.unionByName(seen).repartitionByRange(*order).sortWithinPartitions(*order, "kind").select(*order, "kind", "text")
    conv_type = named.schema["conv"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv", first.schema.field(0).type), *PIECE_FIELDS])

        def all_batches():
            yield first
            yield from batches

        yield from _batches(_pieces(_rows(all_batches()), TaskContext.get().partitionId(), piece_rows), schema, _chars, PIECE_CHARS)

    pieces = staged(dealt.mapInArrow(cut, f"conv {conv_type}, {PIECE_DDL}"), "repair-pieces")
    parts = pieces.where("not whole")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv", first.schema.field(0).type), ("part", pa.int32()), ("k", pa.int64()), ("behind", pa.int32()), ("state", pa.int32()), ("last", pa.bool_())])

        def all_batches():
            yield first
            yield from batches

        yield from _batches(_plan(_rows(all_batches())), schema)

    planned = staged(parts.select("conv", "part", "k", "symbols").repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("k"))
                     .mapInArrow(plan, f"conv {conv_type}, part int, k bigint, behind int, state int, last boolean"), "repair-plan")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([f for f in batch.schema if f.name not in ("behind", "state", "last")])
            done = (repaired({f: r[f] for f in schema.names}, r["behind"], r["state"], r["last"])
                    for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())
            yield from _batches(done, schema, _chars, PIECE_CHARS)

    keyed = planned.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("k").alias("j"), "behind", "state", "last")
    traced = (parts.join(keyed, parts["conv"].eqNullSafe(keyed["c"]) & (parts["part"] == keyed["p"]) & (parts["k"] == keyed["j"])).drop("c", "p", "j")
              .mapInArrow(trace, f"conv {conv_type}, {PIECE_DDL}"))
    return pieces.where("whole").unionByName(traced)


def _reports(rows: Iterator[tuple]) -> Iterator[dict]:
    """One report a conversation, from its pieces (conv, roles, texts, ... in the order of ``report``'s select) in their order."""
    now, digest, audit, turn_min, turn_max, initial, lines = None, None, [], None, None, None, 0

    def close() -> dict:
        gaps = 0 if turn_min is None else turn_max - turn_min + 1 - now["turns"]
        return {k: v for k, v in now.items() if k != "turns"} | {"gaps": gaps, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    for conv, roles, texts, blank, duplicate, truncated, illegal, first, last, lowest, highest, turns, letters, cost in rows:
        if now is None or conv != now["conv"]:
            if now is not None:
                yield close()
            now = {"conv": conv, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "turns": 0}
            digest, audit, turn_min, turn_max, initial, lines = hashlib.sha256(), [], None, None, None, 0
        for name, value in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated), ("illegal", illegal), ("cost", cost), ("turns", turns)):
            now[name] += value
        if initial is not None and first is not None:
            now["illegal"] += initial + first not in ("su", "ua", "au")
        initial = initial if last is None else last
        if lowest is not None:
            now["turns"] -= lowest == turn_max
            turn_min = lowest if turn_min is None else turn_min
            turn_max = highest
        audit.append(letters)
        for role, text in zip(roles, texts, strict=True):
            digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
            lines += 1
    if now is not None:
        yield close()


def report(pieces: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row a conversation of ``repair``'s result: id, ``gaps`` (missing turns), the counts, ``cost``, ``audit`` and the
    SHA-256 of the repaired ``role:text`` lines.

    Whole conversations are reported where they are. Pieces are brought together and hashed in
    order as they stream by; a hash of a conversation can only be taken in its order.
    """
    conv_type = pieces.schema["conv"].dataType.simpleString()
    wanted = pieces.select("conv", "roles", "texts", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "turn_min",
                           "turn_max", "turns", "audit", "cost", "part", "k", "whole")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        longs = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        schema = pa.schema([("conv", first.schema.field(0).type), *longs, ("audit", pa.string()), ("repaired_sha256", pa.string())])

        def all_rows():
            yield from _rows(iter([first]))
            yield from _rows(batches)

        yield from _batches((r for r in _reports(all_rows())), schema, lambda r: len(r["audit"]), 1 << 20)

    ddl = f"conv {conv_type}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    alone = wanted.where("whole").drop("part", "k", "whole").mapInArrow(task, ddl)
    joined = wanted.where("not whole").repartition("conv").sortWithinPartitions("conv", "part", "k").drop("part", "k", "whole").mapInArrow(task, ddl)
    return alone.unionByName(joined).withColumnRenamed("conv", conv_col)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, live`` of ``rows``, harmed by d = CRC-32 of ``conv_id:turn`` modulo 20.

    Nulls become one space (in the key too; ids and turns themselves stay null). d = 0: not
    live any more; 1: no text; 2: no ``.``, ``!``, ``?``; 3: twice; 4: role user.
    """
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    key = F.concat(conv, F.lit(":"), turn)
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    d = F.col("_d")
    return (rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_d"))
            .select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(d == 1, "").when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    (d != 0).alias("live"), F.explode(F.array_repeat(F.lit(0), F.when(d == 3, 2).otherwise(1))).alias("_copy")).drop("_copy"))
