"""Straight legs of missions against cells of a grid: what they pass, and the first event of a flight, with no sample written out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import missions, rays, voxels

GRID = {"res": 2.0, "origin": (-48.0, -48.0, 0.0)}


def mission_legs(waypoints: DataFrame, cruise: float = 5.0, fastest: float = 15.0) -> DataFrame:
    """(mission_id, site_id, seq, pe, pn, pu, e, n, u, leg, v, before_m, before_s): the way to each waypoint from the one before
    it, at the speed of the waypoint that it leads to, and the path and time before it. The first has no length, and
    neither way nor time."""
    by = Window.partitionBy("mission_id").orderBy("seq")
    rows = waypoints.select("mission_id", "site_id", "seq", *[F.coalesce(F.lag(c).over(by), F.col(c)).cast("double").alias(f"p{c}") for c in "enu"], *[F.col(c).cast("double").alias(c) for c in "enu"], "speed")
    rows = rows.withColumn("leg", F.expr("sqrt((e - pe) * (e - pe) + (n - pn) * (n - pn) + (u - pu) * (u - pu))"))
    rows = rows.withColumn("v", F.least(F.greatest(F.coalesce("speed", F.lit(cruise)), F.lit(0.1)), F.lit(fastest)).cast("double")).drop("speed")
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"before_m": F.coalesce(F.sum("leg").over(past), F.lit(0.0)), "before_s": F.coalesce(F.sum(F.col("leg") / F.col("v")).over(past), F.lit(0.0))})


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"({a.format(c)}) * ({b.format(c)})" for c in "enu") + ")"


_WAY, _OFF = "{0} - p{0}", "p{0} - c{0}"


def leg_cells(legs: DataFrame, cells: DataFrame, reach: float, res: float = 2.0, origin: tuple[float, float, float] = (-48.0, -48.0, 0.0), cube: bool = False) -> DataFrame:
    """Pairs of a leg (site_id, pe..pu, e..u) and a cell of its site whose centre is nearer than ``reach`` to it, or with ``cube`` in the cube of that
    reach round some place of it, with the
    cell's i, j, k, the squared distances ``near2`` of the leg and ``start2`` of its start, and ``qa``, ``qb``: the squared length
    and the product of way and offset.

    Cells lie in blocks. A leg is cut to stretches of a block's edge at most, and each looks into the blocks that the reach round it
    touches; so a leg meets what is near its line and not what is in the box round it. A pair may come more than once.
    """
    edge, axes = max(2.0 * res, 2.0 * reach), list(zip("enu", "ijk", origin, strict=True))
    rows = legs.withColumn("m", F.expr(f"cast(greatest(1, ceil(sqrt((e - pe) * (e - pe) + (n - pn) * (n - pn) + (u - pu) * (u - pu)) / {edge}D)) as int)"))
    rows = rows.withColumn("s", F.explode(F.expr("sequence(0, m - 1)")))
    for c, x, o in axes:
        a, b = (f"(p{c} + ({c} - p{c}) * (s + {k}) / m - {o}D)" for k in (0, 1))
        rows = rows.withColumn(f"b{x}", F.explode(F.expr(f"sequence(cast(floor((least({a}, {b}) - {reach}D) / {edge}D) as int), cast(floor((greatest({a}, {b}) + {reach}D) / {edge}D) as int))")))
    blocks = ["bi", "bj", "bk"]
    named = cells.select(*voxels.CELL, *[(F.lit(o) + (F.col(x) + 0.5) * res).alias(f"c{c}") for c, x, o in axes]).distinct()
    named = named.withColumns({f"b{x}": F.floor((F.col(f"c{c}") - o) / edge).cast("int") for c, x, o in axes})
    pairs = rows.select(*legs.columns, *blocks).join(voxels.sorted_side(named), ["site_id", *blocks]).drop(*blocks)
    pairs = pairs.withColumns({"qa": F.expr(_dot(_WAY, _WAY)), "qb": F.expr(_dot(_WAY, _OFF)), "start2": F.expr(_dot(_OFF, _OFF))})
    pairs = pairs.withColumn("near2", F.expr("CASE WHEN qb >= 0 OR qa = 0 THEN start2 WHEN -qb >= qa THEN start2 + 2 * qb + qa ELSE start2 - qb * qb / qa END"))
    if not cube:
        return pairs.where(F.col("near2") < reach * reach).drop("ce", "cn", "cu")
    # the share of the way on which the cell lies between both faces of each axis
    lo, hi, beside = "0D", "1D", []
    for c in "enu":
        a, b = (f"((c{c} {sign} {reach}D - p{c}) / ({c} - p{c}))" for sign in "-+")
        lo, hi = f"IF({c} = p{c}, {lo}, greatest({lo}, least({a}, {b})))", f"IF({c} = p{c}, {hi}, least({hi}, greatest({a}, {b})))"
        beside.append(f"c{c} BETWEEN least(p{c}, {c}) - {reach + 1e-6}D AND greatest(p{c}, {c}) + {reach + 1e-6}D")
    return pairs.where(" AND ".join(beside)).withColumns({"lo": F.expr(lo), "hi": F.expr(hi)}).where("lo <= hi + 1e-9").drop("ce", "cn", "cu")


def missed_on_legs(waypoints: DataFrame, truth: DataFrame, mapped: DataFrame, clearance: float = 4.0) -> DataFrame:
    """(site_id, n_missed, n_on_path): pole and wire cells nearer than ``clearance`` to a mission's way, and those of them that
    the map lacks."""
    thin = truth.where(F.col("label").isin(4, 5))
    close = leg_cells(mission_legs(waypoints), thin, clearance, **GRID).select(*voxels.CELL).distinct()
    held = close.join(mapped.select(*voxels.CELL).distinct().withColumn("_held", F.lit(1)), voxels.CELL, "left")
    return held.groupBy("site_id").agg(F.count(F.when(F.col("_held").isNull(), 1)).alias("n_missed"), F.count("*").alias("n_on_path"))


def missed_on_samples(waypoints: DataFrame, truth: DataFrame, mapped: DataFrame, dt: float = 0.1, clearance: float = 4.0) -> DataFrame:
    """``rays.missed_on_path`` over the first waypoint of each mission and its legs' samples every ``dt`` or less
    (``missions.path_samples``), which are never written out: of a leg and a cell only the two samples on either side of the leg's
    nearest point are looked at, and one of them is the nearest."""
    start = waypoints.where("seq = 0").select("mission_id", "site_id").withColumn("_start", F.lit(True))
    rows = mission_legs(waypoints).drop("site_id").join(voxels.sorted_side(start), "mission_id")
    rows = rows.withColumn("steps", F.expr(f"CASE WHEN leg >= 1e-9 THEN cast(greatest(ceil(leg / v / {dt}D), 1) AS int) WHEN seq = 0 THEN 0 END")).where("steps IS NOT NULL")
    thin = truth.where(F.col("label").isin(4, 5))
    pairs = leg_cells(rows.select("site_id", "steps", "pe", "pn", "pu", "e", "n", "u"), thin, clearance + 1e-6, **GRID)
    pairs = pairs.withColumn("_s", F.explode(F.expr("CASE WHEN steps = 0 THEN array(0) ELSE transform(array(0, 1), d -> least(steps, greatest(1, cast(floor(-qb / qa * steps) AS int) + d))) END")))
    gap = F.lit(0.0)
    for c, x, o in zip("enu", "ijk", GRID["origin"], strict=True):
        at = F.expr(f"IF(steps = 0, {c}, p{c} + ({c} - p{c}) * _s / steps)")
        gap = gap + F.pow(at - (F.lit(o) + (F.col(x) + 0.5) * GRID["res"]), 2)
    close = pairs.where(F.sqrt(gap) <= clearance).select(*voxels.CELL).distinct()
    held = close.join(voxels.sorted_side(mapped.select(*voxels.CELL).distinct()).withColumn("_held", F.lit(1)), voxels.CELL, "left")
    return held.groupBy("site_id").agg(F.count(F.when(F.col("_held").isNull(), 1)).alias("n_missed"), F.count("*").alias("n_on_path"))


#: Legs that a task holds in a group, places of cells that it looks into at once, and cells of a box that it holds as an array.
LEGS, LOOKED, BOXED = 40_000, 400_000, 20_000_000


def _meets(p: np.ndarray, w: np.ndarray, cells: np.ndarray, reach: float, cube: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(leg, centre) of the cells that may be nearer than ``reach`` to the legs from p along w, or with ``cube`` in the cube of that reach round some place
    of them: those round the middle of each stretch of a leg. A pair may come more than once."""
    if not len(cells):
        return
    res, origin, edge = GRID["res"], np.array(GRID["origin"]), max(GRID["res"], reach)
    length = np.sqrt((w * w).sum(axis=1) + 0 * p.sum(axis=1))
    known = np.flatnonzero(np.isfinite(length))
    m = np.maximum(1, np.ceil(length[known] / edge)).astype(np.int64)
    ends = np.cumsum(m)
    r = int((reach + edge / 2) / res + 0.5 + 1e-6)
    off = np.stack(np.meshgrid(*[np.arange(-r, r + 1)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    if not cube:
        off = off[np.sqrt((off * off).sum(axis=1)) * res <= reach + edge / 2 + res * np.sqrt(3) / 2 + 1e-6]
    low = cells.min(axis=0) - 2 * r
    shape = cells.max(axis=0) - low + 1 + 2 * r
    number = lambda c: (c[:, 0] * shape[1] + c[:, 1]) * shape[2] + c[:, 2]
    numbers, there, held = np.sort(number(cells - low)), number(off), None
    if shape.astype(float).prod() <= BOXED:
        held = np.zeros(int(shape.prod()), bool)
        held[numbers] = True
        some = held.reshape(shape)
        for axis in range(3):  # whether a cell is near enough for any offset, axis by axis
            wide = some.copy()
            for d in range(1, r + 1):
                to, of = [slice(None)] * 3, [slice(None)] * 3
                to[axis], of[axis] = slice(d, None), slice(None, -d)
                wide[tuple(to)] |= some[tuple(of)]
                wide[tuple(of)] |= some[tuple(to)]
            some = wide
        some = some.reshape(-1)
    step = max(1, LOOKED // len(off))
    for at in range(0, int(ends[-1]) if len(ends) else 0, step):
        n = np.arange(at, min(at + step, int(ends[-1])))
        of = np.searchsorted(ends, n, "right")
        leg = known[of]
        middle = p[leg] + w[leg] * ((n - ends[of] + m[of] + 0.5) / m[of])[:, None]
        cell = np.floor((middle - origin) / res) - low
        near = ((cell >= r) & (cell < shape - r)).all(axis=1)
        cell, leg = cell[near].astype(np.int64), leg[near]
        here = number(cell)
        if held is not None:
            near = some[here]
            cell, leg, here = cell[near], leg[near], here[near]
        tried = here[:, None] + there
        full = held[tried] if held is not None else numbers[np.minimum(np.searchsorted(numbers, tried), len(numbers) - 1)] == tried
        found = np.flatnonzero(full)
        i = found // len(off)
        yield leg[i], origin + (cell[i] + off[found - i * len(off)] + low + 0.5) * res


def _offsets(p: np.ndarray, w: np.ndarray, leg: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, ...]:
    """qa, qb, start2 and near2 of pairs, as in ``leg_cells``."""
    way, off = w[leg], p[leg] - centre
    qa, qb, start2 = (way * way).sum(axis=1), (way * off).sum(axis=1), (off * off).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        near2 = np.where((qb >= 0) | (qa == 0), start2, np.where(-qb >= qa, start2 + 2 * qb + qa, start2 - qb * qb / qa))
    return qa, qb, start2, near2


def _parts(waypoints: DataFrame) -> int:
    """Parts that the legs of every site are dealt over: as many as the largest asks for."""
    return -(-(waypoints.groupBy("site_id").count().agg(F.max("count")).first()[0] or 1) // LEGS)


#: Legs of a mission, by seq, that go to one group.
PIECE = 1000


def _cells_beside(legs: DataFrame, cells: DataFrame, parts: int, added: str, work: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], first: bool = False) -> DataFrame:
    """The legs with columns ``added``, doubles that ``work`` finds of the legs' columns, starts and ways and the cells (i, j, k) of their site; infinite is
    null. With ``first``, only up to the first leg of each mission that has a value, or some legs further.

    The legs of a site are dealt to groups, pieces of missions together, and each group gets the site's cells as bits, 64 a row, which the grid
    bounds; so no pair of a leg and a cell is shuffled."""
    dealt = legs.withColumn("_piece", F.expr(f"seq div {PIECE}")).withColumn("_part", F.pmod(F.xxhash64("mission_id", "_piece"), F.lit(parts)).cast("int"))
    solid = rays._bits(cells, 0).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    numbers = [c for c, t in legs.dtypes if t in ("double", "int", "bigint") and c not in ("mission_id", "site_id", "seq")]
    names = [a.split()[0] for a in added.split(",")]
    kept = legs.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([(c, "ascending") for c in ("mission_id", "_piece", "seq")]) if first else left
        rows = {c: left.column(c).to_numpy().astype(float) for c in numbers}
        p = np.column_stack([rows[f"p{c}"] for c in "enu"]).reshape(-1, 3)
        w = np.column_stack([rows[c] for c in "enu"]).reshape(-1, 3) - p
        held = rays._cells(right, 0)
        if first:
            values = [np.full(len(p), np.inf) for _ in names]
            mission, piece = (left.column(c).to_numpy() for c in ("mission_id", "_piece"))
            begins = np.flatnonzero(np.append(len(p) > 0, (mission[1:] != mission[:-1]) | (piece[1:] != piece[:-1])))
            of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(p))))
            nth, open_ = np.arange(len(p)) - begins[of], np.ones(len(begins), bool)
            low, high = 0, 1
            while low <= nth.max(initial=-1):  # a leg of each, the next, the next two and so on
                some = np.flatnonzero((nth >= low) & (nth < high) & open_[of])
                for to, found in zip(values, work({c: v[some] for c, v in rows.items()}, p[some], w[some], held), strict=True):
                    to[some] = found
                open_[of[some[np.isfinite(values[0][some])]]] = False
                low, high = high, 2 * high
        else:
            values = work(rows, p, w, held)
        out = left.select(kept)
        for name, found in zip(names, values, strict=True):
            out = out.append_column(name, pa.array(found, pa.float64(), mask=~np.isfinite(found)))
        return out

    schema = ", ".join(f"`{c}` {t}" for c, t in legs.dtypes)
    return dealt.groupBy("site_id", "_part").cogroup(solid.groupBy("site_id", "_part")).applyInArrow(run, f"{schema}, {added}")


def audit_flights(waypoints: DataFrame, obstacles: DataFrame, margin: float = 1.5, reserve: float = 0.15, battery_s: float = 1080.0, reach: float = 6.0) -> DataFrame:
    """One row a mission: path_m, time_s, used, min_clearance, collided, landed, completed up to the first event, and its place
    event_e, event_n, event_u.

    A flight ends in a collision where its way comes nearer than ``margin`` to an obstacle's centre, or lands where the battery
    is down to the ``reserve``; at the same moment it is a collision. Both are solved for on the leg, so nothing depends on
    steps. min_clearance is the least distance of the flown way to an obstacle, null if it never is under ``reach``.
    """
    if not 0 < margin < reach:
        raise ValueError("margin must be positive and below reach")
    legs = mission_legs(waypoints).withColumn("left_s", F.lit((1 - reserve) * battery_s) - F.col("before_s"))
    # what is flown if nothing is in the way: a leg is cut where the battery is down
    legs = legs.where("left_s > 0 OR (leg = 0 AND before_s = 0)").withColumn("part", F.expr("CASE WHEN leg / v >= left_s AND leg > 0 THEN left_s * v / leg ELSE 1D END"))
    legs = legs.withColumn("lands", F.expr("leg > 0 AND leg / v >= left_s"))
    legs = legs.withColumns({c: F.expr(f"p{c} + ({c} - p{c}) * part") for c in "enu"} | {"leg": F.expr("leg * part")}).drop("part", "left_s")
    m2, parts = float(margin) * margin, _parts(waypoints)

    def touched(rows: dict[str, np.ndarray], p: np.ndarray, w: np.ndarray, cells: np.ndarray) -> list[np.ndarray]:
        hit, start = np.full((2, len(p)), np.inf)
        for leg, centre in _meets(p, w, cells, margin):
            qa, qb, start2, near2 = _offsets(p, w, leg, centre)
            on = near2 < m2
            leg, qa, qb, start2 = leg[on], qa[on], qb[on], start2[on]
            with np.errstate(divide="ignore", invalid="ignore"):
                entry = (-qb - np.sqrt(qb * qb - qa * (start2 - m2))) / qa
            np.minimum.at(hit, leg, np.where(start2 < m2, 0.0, np.where(qb < 0, entry, np.inf)))
            np.minimum.at(start, leg, start2)
        return [hit, start]

    def passed(rows: dict[str, np.ndarray], p: np.ndarray, w: np.ndarray, cells: np.ndarray) -> list[np.ndarray]:
        least, left = np.full(len(p), np.inf), np.flatnonzero(np.isnan(rows["hit"]))
        for far in [r for r in (2.0, 4.0) if r < reach] + [reach]:
            for leg, centre in _meets(p[left], w[left], cells, far):
                near2 = _offsets(p[left], w[left], leg, centre)[3]
                on = near2 < far * far
                np.minimum.at(least, left[leg[on]], near2[on])
            left = left[np.isinf(least[left])]
        return [least]

    obstacles = voxels.stored(obstacles.select(*voxels.CELL).distinct())
    first = Window.partitionBy("mission_id").orderBy("seq")
    rows = _cells_beside(legs, obstacles, parts, "hit double, start2 double", touched, first=True).withColumn("_hits", F.count("hit").over(first.rowsBetween(Window.unboundedPreceding, -1)))
    rows = voxels.stored(rows.where("_hits = 0").drop("_hits"))
    # the least distance is looked for on legs that are flown to their end
    rows = _cells_beside(rows, obstacles, parts, "near2 double", passed)
    flown = F.coalesce(F.col("hit"), F.lit(1.0))
    # before a contact nothing is nearer than the margin, unless the way starts there
    gap = F.when(F.col("hit").isNull(), F.sqrt("near2")).when(F.col("hit") > 0, F.lit(float(margin))).otherwise(F.sqrt("start2"))
    place = F.struct("seq", *[(F.col(f"p{c}") + (F.col(c) - F.col(f"p{c}")) * flown).alias(c) for c in "enu"])
    out = rows.groupBy("mission_id").agg(
        F.max(F.col("before_m") + F.col("leg") * flown).alias("path_m"), F.max(F.col("before_s") + F.col("leg") / F.col("v") * flown).alias("time_s"), F.min(gap).alias("min_clearance"),
        F.max(F.col("hit").isNotNull()).alias("collided"), F.max(F.col("lands") & F.col("hit").isNull()).alias("landed"), F.max(place).alias("_p"),
    )
    out = out.withColumn("used", F.col("time_s") / battery_s).withColumn("completed", ~F.col("collided") & ~F.col("landed"))
    where = [F.when(~F.col("completed"), F.col(f"_p.{c}")).alias(f"event_{c}") for c in "enu"]
    return out.select("mission_id", "path_m", "time_s", "used", "min_clearance", "collided", "landed", "completed", *where)


#: Half the edge of the cube of cells that a sample looks into, three cells each way from its own.
CUBE = 7.0


class _Samples:
    """The samples of legs: number s of a leg of some steps, up to its ``top``, is at s / steps of its way; a mission's start is a leg of no steps."""

    def __init__(self, rows: dict[str, np.ndarray], p: np.ndarray, w: np.ndarray) -> None:
        self.p, self.w, self.steps, self.top = p, w, rows["steps"], rows["top"]

    def beside(self, leg: np.ndarray, at: np.ndarray, offsets: tuple[int, ...], centre: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each offset from the samples ``at`` of the legs their number, their way to the centres and its length."""
        steps, top = self.steps[leg], self.top[leg]
        for d in offsets:
            s = np.where(steps == 0, 0.0, np.minimum(top, np.maximum(1.0, at + d)))
            way = self.p[leg] + self.w[leg] * s[:, None] / np.where(steps == 0, 1.0, steps)[:, None] - centre
            yield s, way, np.sqrt((way * way).sum(axis=1))


def _share(above: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.where(below == 0, 0.0, above / np.where(below == 0, 1.0, below))


def _first_within(rows: dict[str, np.ndarray], p: np.ndarray, w: np.ndarray, cells: np.ndarray, margin: float) -> list[np.ndarray]:
    """The first sample of each leg within the margin of a cell, and its least distance."""
    number, gap = np.full((2, len(p)), np.inf)
    samples, reach = _Samples(rows, p, w), margin + 1e-6
    for leg, centre in _meets(p, w, cells, reach):
        qa, qb, start2, near2 = _offsets(p, w, leg, centre)
        on = near2 < reach * reach
        leg, centre, qa, qb, start2 = leg[on], centre[on], qa[on], qb[on], start2[on]
        enter = np.maximum(0.0, _share(-qb - np.sqrt(np.maximum(0.0, qb * qb - qa * (start2 - margin * margin))), qa))
        for s, _, far in samples.beside(leg, np.ceil(enter * samples.steps[leg]), (-1, 0, 1), centre):
            on = far < margin
            of, s, far = leg[on], s[on], far[on]
            gap[of[s < number[of]]] = np.inf
            np.minimum.at(number, of, s)
            on = s == number[of]
            np.minimum.at(gap, of[on], far[on])
    return [number, gap]


def _nearest(rows: dict[str, np.ndarray], p: np.ndarray, w: np.ndarray, cells: np.ndarray, margin: float) -> list[np.ndarray]:
    """The least distance of each leg's samples to a cell in their cube, looked for within 2, 4 and 7 m and then in the whole cube."""
    least, left = np.full(len(p), np.inf), np.arange(len(p))
    for reach, cube in ((2.0, False), (4.0, False), (CUBE, False), (CUBE, True)):
        if reach <= margin:
            continue
        start, way, samples = p[left], w[left], _Samples({c: rows[c][left] for c in ("steps", "top")}, p[left], w[left])
        for leg, centre in _meets(start, way, cells, reach, cube):
            qa, qb, _, near2 = _offsets(start, way, leg, centre)
            if not cube:  # whatever is nearer than half its edge lies in the cube, and the nearest sample is beside the nearest point
                on = near2 < reach * reach
                leg, centre, qa, qb = leg[on], centre[on], qa[on], qb[on]
                for _, _, far in samples.beside(leg, np.floor(_share(-qb, qa) * samples.steps[leg]), (0, 1), centre):
                    on = far < reach
                    np.minimum.at(least, left[leg[on]], far[on])
                continue
            # the share of the way on which the cell lies between both faces of each axis
            a, b, going = start[leg], start[leg] + way[leg], way[leg]
            on = ((centre >= np.minimum(a, b) - CUBE - 1e-6) & (centre <= np.maximum(a, b) + CUBE + 1e-6)).all(axis=1)
            leg, centre, qa, qb, a, going = leg[on], centre[on], qa[on], qb[on], a[on], going[on]
            still, by = going == 0, np.where(going == 0, 1.0, going)
            faces = [(centre + d - a) / by for d in (-CUBE, CUBE)]
            lo = np.where(still, 0.0, np.minimum(*faces)).max(axis=1, initial=0.0)
            hi = np.where(still, 1.0, np.maximum(*faces)).min(axis=1, initial=1.0)
            on = lo <= hi + 1e-9
            leg, centre, lo, hi, closest = leg[on], centre[on], lo[on], hi[on], _share(-qb, qa)[on]
            for f in (np.maximum(lo, np.minimum(hi, closest)), lo, hi, np.ones(len(leg))):
                for _, gap, far in samples.beside(leg, np.floor(f * samples.steps[leg]), (-1, 0, 1, 2), centre):
                    on = ((gap >= -CUBE) & (gap < CUBE)).all(axis=1)
                    np.minimum.at(least, left[leg[on]], far[on])
        left = left[np.isinf(least[left])]
    return [least]


def audit_samples(waypoints: DataFrame, obstacles: DataFrame, dt: float = 0.1, margin: float = 1.5, reserve: float = 0.15, battery_s: float = 1080.0) -> DataFrame:
    """``measures.audit_missions`` with its window of three cells, without a row for a sample: which sample of a leg is the first within the margin of
    a cell, at which the battery is down and which is nearest to a cell is solved for, and the samples beside it are looked at.

    Legs meet the cells of their site in the task (``_cells_beside``).
    """
    if not 0 < margin < CUBE:
        raise ValueError("margin must be positive and within the cube")
    by = Window.partitionBy("mission_id").orderBy("seq")
    rows = missions.leg_lengths(waypoints).withColumns({f"p{c}": F.lag(c).over(by).cast("double") for c in "enu"} | {c: F.col(c).cast("double") for c in "enu"})
    rows = rows.withColumn("v", F.least(F.greatest(F.coalesce("speed", F.lit(5.0)), F.lit(0.1)), F.lit(15.0)).cast("double"))
    rows = rows.withColumn("has_start", F.max(F.col("seq") == 0).over(Window.partitionBy("mission_id"))).where("has_start AND (seq = 0 OR leg >= 1e-9)")
    # a mission's first waypoint is its sample 0, whatever comes before it
    rows = rows.withColumns({f"p{c}": F.expr(f"IF(seq = 0, {c}, p{c})") for c in "enu"} | {"leg": F.expr("IF(seq = 0, 0D, leg)")})
    rows = rows.withColumn("steps", F.expr(f"IF(seq = 0, 0, cast(greatest(ceil(leg / v / {dt}D), 1) AS int))"))
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"before_m": F.coalesce(F.sum("leg").over(past), F.lit(0.0)), "before_s": F.coalesce(F.sum(F.col("leg") / F.col("v")).over(past), F.lit(0.0))})
    left = f"1 - (before_s + leg / v * s / steps) / {battery_s}D <= {reserve}D"
    near = f"cast(ceil(((1 - {reserve}D) * {battery_s}D - before_s) / (leg / v) * steps) AS long)"
    rows = rows.withColumn("low", F.expr(f"IF(steps = 0, NULL, array_min(filter(transform(array(-1, 0, 1), d -> cast(least(steps, greatest(1, {near} + d)) AS int)), s -> {left})))"))
    rows = rows.withColumn("lows", F.count("low").over(past)).where("lows = 0").withColumn("top", F.coalesce("low", "steps"))
    rows = voxels.stored(rows.select("mission_id", "site_id", "seq", *[f"p{c}" for c in "enu"], *"enu", "leg", "v", "steps", "top", "low", "before_m", "before_s"))
    parts, obstacles = _parts(rows), voxels.stored(obstacles.select(*voxels.CELL).distinct())
    rows = _cells_beside(rows, obstacles, parts, "hit_s double, hit_d double", lambda *of: _first_within(*of, margin), first=True)
    rows = rows.withColumn("_hits", F.count("hit_s").over(past)).where("_hits = 0").drop("_hits")
    rows = voxels.stored(rows.withColumn("_clear", F.count("hit_s").over(Window.partitionBy("mission_id")) == 0))
    # before a collision nothing is within the margin
    way = ["mission_id", "site_id", "seq", *[f"p{c}" for c in "enu"], *"enu", "steps", "top"]
    near = _cells_beside(rows.where("_clear").select(*way), obstacles, parts, "near double", lambda *of: _nearest(*of, margin))
    found = rows.select("mission_id", F.col("hit_d").alias("_d")).unionByName(near.select("mission_id", F.col("near").alias("_d"))).where("_d IS NOT NULL")
    found = found.groupBy("mission_id").agg(F.min("_d").alias("min_clearance"))
    share = F.coalesce(F.col("hit_s"), F.col("top")) / F.nullif(F.col("steps"), F.lit(0))
    out = rows.groupBy("mission_id").agg(
        F.max(F.col("before_m") + F.coalesce(F.col("leg") * share, F.lit(0.0))).alias("path_m"), F.max(F.col("before_s") + F.coalesce(F.col("leg") / F.col("v") * share, F.lit(0.0))).alias("time_s"),
        F.max(F.col("hit_s").isNotNull()).alias("collided"), F.max(F.col("low").isNotNull() & F.col("hit_s").isNull()).alias("landed"),
    )
    out = out.join(voxels.sorted_side(found), "mission_id", "left").withColumns({"used": F.col("time_s") / battery_s, "completed": ~F.col("collided") & ~F.col("landed")})
    return out.select("mission_id", "path_m", "time_s", "used", "min_clearance", "collided", "landed", "completed")
