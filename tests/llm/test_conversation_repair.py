"""Conversation repair: against a search over (cost, audit) pairs, and the cases of the docstring."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from helpers import SF

from touchline.llm import conversation_repair as C
from touchline.llm import queries

STATES = {"": "u", "s": "u", "u": "a", "a": "u"}  # last role kept, and what may come next
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, lines) of ``rows`` (role, text, must delete, truncated): all edits, states by their last role."""
    def inserted(best):
        for _ in range(3):
            for s, (cost, audit, lines) in list(best.items()):
                to = STATES[s]
                new = (cost + 2, audit + "I", (*lines, FULL[to] + ":"))
                best[to] = min(best.get(to, new), new)
        return best

    best = inserted({"": (0, "", ())})
    for role, text, delete, late in rows:
        now = {}

        def offer(state, item):
            now[state] = min(now.get(state, item), item)

        for s, (cost, audit, lines) in best.items():
            offer(s, (cost + 3, audit + "D", lines))
            if not delete:
                to = STATES[s]
                offer(to, (cost + 2 + late, audit + "R", (*lines, f"{FULL[to]}:{text}")))
                if role[:1] == to or (role[:1], s) == ("s", ""):
                    offer(role[:1], (cost + late, audit + "K", (*lines, f"{role}:{text}")))
        best = inserted(now)
    return min(v for s, v in best.items() if s in ("", "a"))


def brute(rows, harm=True):
    """Reports by conversation of raw (conv_id, turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if harm else 9
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        th = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
        mine += [(turn is not None, turn or 0, "user" if d == 4 else role, th if d != 4 else hashlib.md5(f"4:user{text}".encode()).digest(), text)] * (0 if d == 0 else 2 if d == 3 else 1)
    out = []
    for conv, mine in convs.items():
        mine.sort()
        seen, faults, items = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, _, role, _, text in mine:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            items.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(items))
        turns = {t for there, t, *_ in mine if there}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, lines = cheapest(items)
        out.append((conv, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()), key=str)


def cases(seed, convs=120):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rnd.randint(1, 14)):
            role = rnd.choice(["user", "assistant", ("user", "assistant")[t % 2], ("user", "assistant")[t % 2], "system", "tool", "", "Ünder", None])
            text = rnd.choice(["Yes.", "No!", "Why?", "cut off", "", " \t\x0b", "x. ", "e.g. this", None, "é中.", f"only here {rnd.random()}."])
            rows.append((rnd.choice([c, c, c, c, None]) if c < 5 else c, rnd.choice([t, t, t, t + 3, None]), role, text))
    rnd.shuffle(rows)
    return rows


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_edits_against_all_edits(block):
    rnd, tables = random.Random(block), C.Tables(block)
    assert len(tables.vectors) < 40
    for _ in range(1500):
        rows = [(rnd.choice(["system", "user", "user", "assistant", "assistant", "x"]), "t", rnd.random() < 0.15, rnd.random() < 0.2) for _ in range(rnd.randint(0, 13))]
        symbols = bytes(C.MUST_DELETE if d else C.INITIALS.get(r[:1], 6) + late for r, _, d, late in rows)
        letters, end = tables.traced(symbols, 0, C.EMPTY)
        letters += C.closing(end)
        roles, texts, cost = C.apply(letters, symbols, C.EMPTY, [r for r, *_ in rows], ["t"] * len(rows))
        assert (cost, letters, tuple(f"{r}:{t}" for r, t in zip(roles, texts))) == cheapest([(r, t, d, late) for r, t, d, late in rows])
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in roles))


@pytest.mark.parametrize("rows_a_piece", [3, 4096])
def test_table(spark, rows_a_piece):
    """Also with conversations in many pieces, over many partitions."""
    rows = cases(1) + [(7, i, "user" if i % 2 else "assistant", f"Turn {i}." if i % 5 else "Again.") for i in range(100, 700)]
    for harm in (True, False):
        source = table(spark, rows)
        pieces = C.repair(C.damaged(source), live=C.F.col("live"), piece_rows=rows_a_piece) if harm else C.repair(source, piece_rows=rows_a_piece)
        assert rows_of(C.report(pieces)) == brute(rows, harm)
        assert pieces.where("conv = 7").count() > (100 if rows_a_piece == 3 else 0)


def test_pieces_end_at_their_bounds():
    """Pieces are bounded, whatever the conversation's size."""
    rows = [(1, t, "user", bytes([t % 256, t // 256]), 1, "x.") for t in range(1000)] + [(2, 0, "user", b"", 1, "x."), (3, 0, "user", b"", 1, "x.")]
    pieces = list(C._pieces(iter(rows), 0, 5))
    assert max(len(p["symbols"]) for p in pieces) == 5
    assert [p["conv"] for p in pieces if p["whole"]] == [2]  # the first and the last may go on elsewhere


def test_clashing_columns_and_extra_types(spark):
    source = table(spark, cases(2, 20))
    wide = source.selectExpr("*", "1 as conv", "2 as th", "'x' as kind", "3 as part", "4 as k", "5 as `a.b`")
    assert rows_of(C.report(C.repair(wide))) == rows_of(C.report(C.repair(source)))


def test_empty(spark):
    assert C.report(C.repair(table(spark, [], 1))).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = C.report(C.repair(C.damaged(table(spark, [(dropped, 0, "user", "x")], 1)), live=C.F.col("live")))
    assert rows_of(got) == [(dropped, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert rows_of(C.report(C.repair(table(spark, [(None, None, None, None)], 1)))) == [(None, 0, 1, 0, 0, 0, 3, "D", nothing)]


def test_query(spark):
    got = queries.QUERIES["op12_conversation_repair"](spark, SF.replace("sf0.001", "sf0.01"))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(got) == brute(rows)
