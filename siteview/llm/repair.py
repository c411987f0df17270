"""Conversation structure repair: the cheapest edits by an auction for shortest paths over a lattice.

A node is (row, state): rows before it are edited, and the roles so far leave the state 0 (nothing), 1 (a system row), 2 (a
user row, the assistant's is due) or 3 (a finished exchange). Arcs keep, rerole, delete or insert a row. Rows are sorted over
the cluster by conversation and turn. A conversation that lies inside one partition is repaired there; one that crosses a
border or has more than CHUNK rows is cut to pieces, whose costs between states give the prices at their borders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows of a piece and characters from which one is full, and rows of a conversation whose repair is remembered.
CHUNK, FULL, FEW = 1024, 4_000_000, 16
#: Costs of the edits, and what is added for a truncated row that stays.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: State after the role that is due, and after a kept row of each initial.
DUE = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_SPACE, _INF = " \t\n\x0b\x0c\r", float("inf")
_END = (0, _INF, _INF, 0)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live): rows after the damage that crc32 of ``conv_id:turn`` modulo 20 deals: 0 drops the
    row (live is false), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's. A null is one space."""
    conv, turn = (F.col(c).cast("long") for c in ("conv_id", "turn"))
    spaced = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), spaced(F.col("role")).alias("role"), spaced(F.col("text")).alias("text"))
    rows = rows.withColumn("_d", F.crc32(F.concat(spaced(F.col("conv_id")), F.lit(":"), spaced(F.col("turn")))) % 20)
    text = F.when(F.col("_d") == 1, F.lit("")).when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_d") != 0).alias("live"), copies.alias("_c")).drop("_c")


def arcs(row: tuple[str, str] | None, state: int, inserts: bool) -> list[tuple[str, int, int, int]]:
    """(edit, cost, rows taken, next state) of a node before ``row`` = (initial, fault), or behind the last row."""
    out = []
    if row is not None:
        initial, fault = row
        out.append(("D", DELETE, 1, state))
        if fault in ("", "truncated"):
            stays = CUT if fault else 0
            kept = KEPT.get(initial, (None,) * 4)[state]
            if kept is not None:
                out.append(("K", stays, 1, kept))
            out.append(("R", REROLE + stays, 1, DUE[state]))
    if inserts:
        out.append(("I", INSERT, 0, DUE[state]))
    return sorted(out)


def auction(rows: tuple[tuple[str, str], ...], leave: tuple[float, ...], last: bool) -> list[list[float]]:
    """Converged prices of all nodes: the least cost from each to the end, where leaving in state q costs ``leave[q]``.

    Prices start at what no repair of the rows ahead can avoid, which no arc undercuts. A path starts at each node, those
    nearest the end first. Its tip, if its price is below its cheapest arc's, is raised to it and the path contracts by a
    node; else the path extends along that arc. It ends at the sink or at a node whose price has converged, and then all its
    nodes have. Rows are inserted before a row, and behind the last one only if ``last``, so that a piece's end belongs to
    the next piece. Nodes without a way to the end are left out, at an infinite price: bids on a cycle of them would not end.
    """
    n = len(rows)
    price = [[0.0] * 4 for _ in range(n + 1)]
    ahead = min(leave)
    price[n] = [ahead] * 4
    for i in range(n - 1, -1, -1):
        ahead += DELETE if rows[i][1] in ("blank", "duplicate") else CUT if rows[i][1] else 0
        price[i] = [ahead] * 4
    done: set[tuple[int, int]] = set()
    for i in range(n, -1, -1):
        ends = [leave[q] < _INF if i == n else any(taken and price[i + 1][then] < _INF for _, _, taken, then in arcs(rows[i], q, False)) for q in range(4)]
        if i < n or last:
            ends = [e or ends[DUE[q]] or ends[DUE[DUE[q]]] for q, e in enumerate(ends)]
        for q in range(4):
            if not ends[q]:
                price[i][q] = _INF
                done.add((i, q))
        for origin in ((i, 3), (i, 2), (i, 1), (i, 0)):
            path = [] if origin in done else [origin]
            while path:
                k, q = path[-1]
                best, tip = (leave[q], None) if k == n else (_INF, None)
                for _, cost, taken, then in arcs(rows[k] if k < n else None, q, k < n or last):
                    if cost + price[k + taken][then] < best:
                        best, tip = cost + price[k + taken][then], (k + taken, then)
                if price[k][q] < best:
                    price[k][q] = best
                    if len(path) > 1:
                        path.pop()
                elif tip is not None and tip not in done:
                    path.append(tip)
                else:
                    done.update(path)
                    path = []
    return price


def trace(rows: tuple[tuple[str, str], ...], price: list[list[float]], leave: tuple[float, ...], last: bool, state: int) -> tuple[str, int]:
    """The least string of edits along tight arcs from ``state``, and the state it ends in."""
    n, at, audit = len(rows), 0, []
    while at < n or leave[state] > price[n][state]:
        for edit, cost, taken, then in arcs(rows[at] if at < n else None, state, at < n or last):
            if cost + price[at + taken][then] == price[at][state]:
                audit.append(edit)
                at, state = at + taken, then
                break
    return "".join(audit), state


def solve(rows: tuple[tuple[str, str], ...]) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    price = auction(rows, _END, True)
    return int(price[0][0]), trace(rows, price, _END, True, 0)[0]


@lru_cache(100_000)
def _remembered(rows: tuple[tuple[str, str], ...]) -> tuple[int, str]:
    return solve(rows)


def edited(messages: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str]]:
    """The (role, text) that the edits leave of the messages."""
    out, at = [], 0
    for edit in audit:
        if edit == "K":
            out.append(messages[at])
            state = KEPT[messages[at][0][:1]][state]
        elif edit in "RI":
            state = DUE[state]
            out.append(("user" if state == 2 else "assistant", messages[at][1] if edit == "R" else ""))
        at += edit != "I"
    return out


def _fault(text: str, seen: bool) -> str:
    body = text.rstrip(_SPACE)
    return "blank" if not body else "duplicate" if seen else "" if body[-1] in ".!?" else "truncated"


def _illegal(a: str, b: str) -> bool:
    return a[:1] + b[:1] not in ("su", "ua", "au")


_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SORTED = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("messages", _MESSAGES), ("part", pa.int32()), ("block", pa.int64()), ("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("live", pa.bool_())])
_SORTED_DDL = "conv_id long, " + "".join(f"{c} long, " for c in _COUNTS) + "audit string, messages array<struct<role: string, text: string>>, part int, block long, at long, turn long, role string, text string, live boolean"


def _sorted(chunk: int):
    """A finished row for each conversation inside the partition, and the rows of those at its borders or of too many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        out: list[dict] = []
        now, whole, at = None, False, 0
        size = block = rows_of = chars_of = 0

        def spill() -> None:
            nonlocal block, rows_of, chars_of, size
            for k, t, r, x, y in held:
                if rows_of >= chunk or chars_of >= FULL:
                    block, rows_of, chars_of = block + 1, 0, 0
                rows_of, chars_of = rows_of + 1, chars_of + len(x)
                out.append({"conv_id": now, "part": part, "block": block, "at": k, "turn": t, "role": r, "text": x, "live": y})
            held.clear()
            size = 0

        def finish() -> None:
            rows = [(t, r, x) for _, t, r, x, live in held if live]
            seen: set[tuple[str, str]] = set()
            faults = []
            for _, r, x in rows:
                faults.append(_fault(x, (r, x) in seen))
                seen.add((r, x))
            cost, audit = (_remembered if len(rows) <= FEW else solve)(tuple((r[:1], f) for (_, r, _), f in zip(rows, faults, strict=True)))
            turns = {t for t, _, _ in rows if t is not None}
            done = {c: faults.count(c) for c in ("blank", "duplicate", "truncated")}
            done |= {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "illegal": sum(_illegal(a[1], b[1]) for a, b in zip(rows, rows[1:], strict=False)), "cost": cost}
            out.append({"conv_id": now, "audit": audit, "messages": [{"role": r, "text": x} for r, x in edited([m[1:] for m in rows], audit, 0)]} | done)
            held.clear()

        for batch in batches:
            for conv, turn, role, text, live in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at == 0 or conv != now:
                    if held:
                        finish()
                    now, whole, size, block, rows_of, chars_of = conv, at > 0, 0, block + 1, 0, 0
                held.append((at, turn, role, text, live))
                at, size = at + 1, size + len(text)
                if len(held) > chunk or size > FULL:
                    whole = False
                if not whole:
                    spill()
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema=_SORTED)
                    out = []
        spill()  # the last conversation may go on in the next partition
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SORTED)

    return run


def _mapped(f, schema: pa.Schema):
    """Rows of dicts through ``f``, a few at a time: a row holds a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                yield pa.RecordBatch.from_pylist([f(r) for r in batch.slice(at, 16).to_pylist()], schema=schema)

    return run


def _codes(piece: dict) -> tuple[tuple[str, str], ...]:
    return tuple((m["role"][:1], _fault(m["text"], m["seen"])) for m in piece["rows"])


_SUMMARY = pa.schema([("key", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")], ("first", pa.string()), ("final", pa.string()), ("costs", pa.list_(pa.float64()))])
_SUMMARY_DDL = "key string, part int, block long, n long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, final string, costs array<double>"


def _summary(piece: dict) -> dict:
    """Counts of a piece, and the cost from each state to each: as its end may be followed, nothing is inserted there."""
    codes, rows = _codes(piece), piece["rows"]
    turns = {m["turn"] for m in rows if m["turn"] is not None}
    costs = [price for q in range(4) for price in auction(codes, tuple(0 if p == q else _INF for p in range(4)), False)[0]]
    return {"key": piece["key"], "part": piece["part"], "block": piece["block"], "n": len(rows), "turns": len(turns), "low": min(turns, default=None), "high": max(turns, default=None), "costs": costs} | {
        "first": rows[0]["role"] if rows else None, "final": rows[-1]["role"] if rows else None, "illegal": sum(_illegal(a["role"], b["role"]) for a, b in zip(rows, rows[1:], strict=False)),
    } | {f: sum(c[1] == f for c in codes) for f in ("blank", "duplicate", "truncated")}


_PRICES = pa.schema([("key", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("leave", pa.list_(pa.float64())), ("last", pa.bool_()), *[(c, pa.int64()) for c in _COUNTS]])
_PRICES_DDL = "key string, part int, block long, leave array<double>, last boolean, " + ", ".join(f"{c} long" for c in _COUNTS)


def _prices(table: pa.Table) -> pa.Table:
    """Prices at the end of each piece of a conversation, backwards from the last; its counts on the first piece's row."""
    pieces = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
    # behind the last row one insert can follow: the assistant's after a user
    leave, last, out = [0.0, 2 * INSERT, INSERT, 0.0], True, []
    for p in reversed(pieces):
        out.append({"key": p["key"], "part": p["part"], "block": p["block"], "leave": list(_END) if last else leave, "last": last})
        leave, last = [min(p["costs"][4 * q + s] + leave[q] for q in range(4)) for s in range(4)], False
    full = [p for p in pieces if p["n"]]
    timed = [p for p in full if p["low"] is not None]
    total = {c: sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(_illegal(a["final"], b["first"]) for a, b in zip(full, full[1:], strict=False))
    distinct = sum(p["turns"] for p in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:], strict=False))
    total["gaps"] = timed[-1]["high"] - timed[0]["low"] + 1 - distinct if timed else 0
    out[-1] |= total | {"cost": int(leave[0])}
    return pa.Table.from_pylist(out, schema=_PRICES)


_TRACES = pa.schema([("key", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("audits", pa.list_(pa.string())), ("ends", pa.list_(pa.int32()))])
_TRACES_DDL = "key string, part int, block long, audits array<string>, ends array<int>"


def _traces(piece: dict) -> dict:
    """The least edits of a piece from each state; null from a state that no cheap way leads on from."""
    codes, leave = _codes(piece), tuple(piece["leave"])
    price = auction(codes, leave, piece["last"])
    found = [trace(codes, price, leave, piece["last"], q) if price[0][q] < _INF else (None, None) for q in range(4)]
    return {"key": piece["key"], "part": piece["part"], "block": piece["block"], "audits": [a for a, _ in found], "ends": [q for _, q in found]}


_CHOSEN = pa.schema([("key", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("state", pa.int32()), ("audit", pa.string())])
_CHOSEN_DDL = "key string, part int, block long, state int, audit string"


def _chosen(table: pa.Table) -> pa.Table:
    state, out = 0, []
    for p in sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"])):
        out.append({"key": p["key"], "part": p["part"], "block": p["block"], "state": state, "audit": p["audits"][state]})
        state = p["ends"][state]
    return pa.Table.from_pylist(out, schema=_CHOSEN)


_EDITED = pa.schema([("key", pa.string()), ("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("audit", pa.string()), ("messages", _MESSAGES)])
_EDITED_DDL = "key string, conv_id long, part int, block long, audit string, messages array<struct<role: string, text: string>>"


def _edited(piece: dict) -> dict:
    left = edited([(m["role"], m["text"]) for m in piece["rows"]], piece["audit"], piece["state"])
    return {c: piece[c] for c in ("key", "conv_id", "part", "block", "audit")} | {"messages": [{"role": r, "text": x} for r, x in left]}


def repair(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Report and messages of conversations (conv_id, turn, role, text, live), taken by turn (nulls first), role and text.

    A row's first fault counts: blank, duplicate (role and text seen earlier) or truncated (no ``.!?`` at its end). Report:
    conv_id, gaps in the turns, blank, duplicate, truncated, illegal neighbours, cost of the cheapest edits. Messages: conv_id, part,
    block, pieces, audit and messages, an array of (role, text); a conversation has one row, or one for each of its
    ``pieces`` in the order of part and block. Null ids are one conversation, repeated rows are duplicates, rows that are not
    live only name their conversation, and an empty table gives none.
    """
    rows = rows.select("conv_id", "turn", "role", "text", "live")
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 16)).sortWithinPartitions("conv_id", "turn", "role", "text")
    found = stored(dealt.mapInArrow(_sorted(chunk), _SORTED_DDL))
    whole, cut = found.where("part IS NULL"), found.where("part IS NOT NULL").select("conv_id", "part", "block", "at", "turn", "role", "text", "live")
    cut = cut.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    place = ["key", "part", "block"]
    first = cut.where("live").groupBy("key", "role", "text").agg(F.min(F.struct("part", "at")).alias("_first"))
    seen = cut.join(first, ["key", "role", "text"], "left").withColumn("seen", F.coalesce(F.struct("part", "at") > F.col("_first"), F.lit(False)))
    seen = seen.groupBy(*place).agg(F.first("conv_id").alias("conv_id"), F.collect_list(F.struct("at", "turn", "role", "text", "seen", "live")).alias("rows"))
    pieces = stored(seen.withColumn("rows", F.expr("filter(array_sort(rows), r -> r.live)")))
    prices = stored(pieces.mapInArrow(_mapped(_summary, _SUMMARY), _SUMMARY_DDL).groupBy("key").applyInArrow(_prices, _PRICES_DDL))
    traces = pieces.join(prices.select(*place, "leave", "last"), place).mapInArrow(_mapped(_traces, _TRACES), _TRACES_DDL)
    chosen = traces.groupBy("key").applyInArrow(_chosen, _CHOSEN_DDL)
    left = pieces.join(chosen, place).mapInArrow(_mapped(_edited, _EDITED), _EDITED_DDL)
    sizes = prices.groupBy("key").agg(F.count("*").alias("pieces"))
    messages = whole.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("pieces"), "audit", "messages")
    messages = messages.unionByName(left.join(sizes, "key").select("conv_id", "part", "block", "pieces", "audit", "messages"))
    counts = prices.where("cost IS NOT NULL").select(F.when(F.col("key") != "", F.col("key")).cast("long").alias("conv_id"), *_COUNTS)
    return whole.select("conv_id", *_COUNTS).unionByName(counts), messages


def _lines(messages: str) -> Column:
    return F.expr(f"concat_ws('\\n', transform({messages}, m -> concat(m.role, ':', m.text)))")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, audit, repaired_sha256) of conversations whose pieces come in order, one piece at a time."""
    hashed, audit, left, fed = hashlib.sha256(), [], 0, False
    for batch in batches:
        out = []
        for at in range(batch.num_rows):
            conv, pieces, edits, some, text = (batch.column(k)[at].as_py() for k in range(5))
            if not left:
                hashed, audit, left, fed = hashlib.sha256(), [], pieces, False
            if some:
                hashed.update(("\n" * fed + text).encode("utf-8", "surrogatepass"))
                fed = True
            audit.append(edits)
            left -= 1
            if not left:
                out.append((conv, "".join(audit), hashed.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["conv_id", "audit", "repaired_sha256"])


def repair_digest(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): the report with the edits and the
    hash of the repaired ``role:text`` lines. A hash takes its bytes in order, so the pieces of one conversation stream
    through one task; nothing else of them meets there."""
    report, messages = repair(rows, chunk)
    lines = F.expr("concat_ws('\n', transform(messages, m -> concat(m.role, ':', m.text)))")
    one = messages.where("pieces = 1").select("conv_id", "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    many = messages.where("pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    many = many.select("conv_id", "pieces", "audit", (F.size("messages") > 0).alias("some"), lines.alias("text")).mapInArrow(_hashed, "conv_id long, audit string, repaired_sha256 string")
    hashes = one.unionByName(many).withColumnRenamed("conv_id", "_id")
    return report.join(hashes, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
