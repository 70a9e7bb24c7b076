"""Overhead search and close-approach screening."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..functions import columns as C

#: The most observers that are broadcast.
SENT_OBSERVERS = 1000
#: A cell and its neighbours; of any two neighbouring cells one has the other among those that are not before (0, 0, 0).
_AROUND = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
#: Kilometres of a shell around the Earth.
SHELL_KM = 20
#: A state: its place and speed.
STATE = ["x", "y", "z", "vx", "vy", "vz"]
#: The edge of a block, in boxes of a state.
BLOCK = 3
#: The most hosts, or guests, that are packed in one row, but for chance.
BLOCK_ROWS = 50_000
#: Rows that a task packs.
TASK_ROWS = 100_000
#: Pairs that arrays look at in one go.
PAIRS_AT_ONCE = 1 << 15


def _covers(observers: DataFrame, top_km: float) -> DataFrame:
    """(obs_id, radius_deg, ox, oy, oz, level, face, i, j): the cells under which a point within radius_deg of an observer's zenith can be.

    A point at the distance r of the Earth's centre that is seen at the zenith angle z from the distance o lies z - asin(o sin(z) / r)
    away on the ground if z is up to 90 degrees, and less than z in any case; no point is farther than top_km.
    """
    own = observers.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                place = np.stack([part.column(own.index(c)).to_numpy(zero_copy_only=False) for c in ("ox", "oy", "oz")], axis=1)
                far = np.linalg.norm(place, axis=1)
                z = np.radians(np.minimum(part.column(own.index("radius_deg")).to_numpy(zero_copy_only=False), 180))
                ground = np.where(z <= np.pi / 2, z - np.arcsin(np.minimum(1, far * np.sin(z) / max(top_km, 1e-9))), z)
                ground = np.where((z <= np.pi / 2) & (far > top_km), 0, ground)  # it looks up from above them all
                which, *cell = cells.cover(place / far[:, None], ground)
                taken = part.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*taken.columns, *[pa.array(c, pa.int32()) for c in cell]], [*own, "level", "face", "i", "j"])

    return observers.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in observers.schema) + ", level int, face int, i int, j int")


def overhead(points: DataFrame, observers: DataFrame) -> DataFrame:
    """(obs_id, norad_id, zenith_deg): points within radius_deg of an observer's zenith, on a sphere.

    The part of the sphere that an observer can see is covered by cells of several levels (functions.cells), and points meet
    observers by cell: each point once for every level that covers use, at most one of whose cells holds it for one observer.
    Up to SENT_OBSERVERS observers, some tens of thousands of cells, are broadcast; with more, both sides are shuffled by cell.
    Points and observers with a coordinate that is null or no number, and observers with such a radius or a negative one, meet none.
    """
    o, p = C.ecef(F.col("o_lat"), F.col("o_lon"), F.col("o_alt")), C.ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    finite = lambda *names: F.expr(" and ".join(f"{c} is not null and abs({c}) < double('infinity')" for c in names))
    observers = observers.select("obs_id", F.col("radius_deg").cast("double").alias("radius_deg"), *[x.alias(n) for x, n in zip(o, ("ox", "oy", "oz"), strict=True)])
    observers = observers.where(finite("ox", "oy", "oz", "radius_deg")).where("radius_deg >= 0 and ox * ox + oy * oy + oz * oz > 0")
    points = points.select("norad_id", *[x.alias(n) for x, n in zip(p, ("x", "y", "z"), strict=True)]).where(finite("x", "y", "z"))
    top = points.agg(F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))).first()[0] or 0.0
    few = observers.count() <= SENT_OBSERVERS
    covers = _covers(observers, top * (1 + 1e-9))
    levels = sorted(r["level"] for r in covers.select("level").distinct().collect())  # at most FINEST + 1
    face, i, j = cells.cell_of(F.col("x"), F.col("y"), F.col("z"))
    points = points.select("*", face.alias("face"), i.alias("fi"), j.alias("fj"))
    points = points.select("norad_id", "x", "y", "z", "face", "fi", "fj", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("level"))
    points = points.select("norad_id", "x", "y", "z", "face", "level", *[F.expr(f"shiftright(f{c}, {cells.FINEST} - level)").alias(c) for c in "ij"])
    dx, dy, dz = F.col("x") - F.col("ox"), F.col("y") - F.col("oy"), F.col("z") - F.col("oz")
    up = F.sqrt(F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy") + F.col("oz") * F.col("oz"))
    cosine = (dx * F.col("ox") + dy * F.col("oy") + dz * F.col("oz")) / (up * F.sqrt(dx * dx + dy * dy + dz * dz))
    zenith = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    both = points.join(F.broadcast(covers) if few else covers, ["level", "face", "i", "j"])
    return both.select("obs_id", "norad_id", zenith.alias("zenith_deg"), "radius_deg").where("zenith_deg <= radius_deg").drop("radius_deg")


def _candidates(rows: DataFrame, distance_km: float, kept: list[str], shells: bool = False) -> DataFrame:
    """Pairs of rows (tick, norad_id, x, y, z and reaches rx, ry, rz) of one tick that may come within distance_km: along each axis a
    row stays within its reach of its place. Columns: tick, and a_ and b_ before norad_id and each of kept; each pair once.

    Space is cut in cells of several levels, whose edges double. A row goes to the level at which an edge is at least distance_km
    and twice its reach, so rows that meet on the level of the one with the greater reach lie in neighbouring cells there. Each
    row is a host on its own level, in its cell and its neighbours, and a guest on its own and each higher level in use, in the one
    cell that holds it there. A few rows of great reach cost their own meetings only: the first edges are those that 99 of 100 rows
    need. With shells, rows (low, high: their least and greatest distance from the Earth's centre) meet only where these
    intervals, widened by distance_km, overlap; this is told by shells that join the cell in the key.

    Both sides are shuffled and sorted: Spark takes a side for as small as the files it comes from, however many rows it is
    turned into, and would send it to the driver. Rows are dealt out first, as a small file is one task.
    """
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "norad_id")
    need = {c: distance_km + 2 * F.col(f"r{c}") for c in "xyz"}
    base = rows.agg(*[F.percentile_approx(need[c], 0.99, 1000).alias(c) for c in "xyz"]).first()
    edge = {c: max((base[c] or 0) * 1.05, 1e-6) for c in "xyz"}
    level = F.greatest(*[F.ceil(F.log2(F.greatest(F.lit(1.0), need[c] / edge[c]))) for c in "xyz"], F.lit(0)).cast("int")
    shell = lambda c: F.floor(F.col(c) / SHELL_KM).cast("int")
    own = ["norad_id", *kept]
    s = rows.select("tick", *own, *[F.floor(F.col(c) / edge[c]).alias(f"c{c}") for c in "xyz"], level.alias("level"), *([shell("low").alias("s0"), F.col("low").alias("low_"), F.col("high").alias("high_")] if shells else []))
    used = sorted(r["level"] for r in s.select("level").distinct().collect())  # some tens at most
    up = lambda c, n: F.shiftright(F.col(c), n) if isinstance(n, int) else F.expr(f"shiftright({c}, {n})")
    extra = ["s0", "low_", "high_"] if shells else []
    guest = s.select("*", F.explode(F.filter(F.array(*map(F.lit, used)), lambda n: n >= F.col("level"))).alias("on")) if used else s.withColumn("on", F.col("level"))
    guest = guest.select("tick", F.col("on").alias("level"), F.col("level").alias("a_level"), *[up(f"c{c}", "on").alias(f"c{c}") for c in "xyz"], *[F.col(c).alias(f"a_{c}") for c in own + extra])
    moves = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", f, strict=True)], F.lit(f >= (0, 0, 0)).alias("forward"), F.lit(f == (0, 0, 0)).alias("here")) for f in _AROUND])
    lower = F.col("level") > (used[0] if used else 0)  # guests of lower levels come from all sides, those of its own from one
    host = s.select("*", F.explode(F.filter(moves, lambda m: m["forward"] | lower)).alias("m"))
    host = host.select("tick", "level", F.col("m.forward").alias("forward"), F.col("m.here").alias("here"), *[(up(f"c{c}", "level") + F.col("m")[c]).alias(f"c{c}") for c in "xyz"], *[F.col(c).alias(f"b_{c}") for c in own + extra])
    keys = ["tick", "level", "cx", "cy", "cz"]
    if shells:  # a pair is taken in the first shell that both are in
        guest = guest.withColumn("shell", F.explode(F.sequence(F.col("a_s0"), shell("a_high_"))))
        host = host.withColumn("b_s0", shell("b_low_") - F.lit(-(-int(distance_km + SHELL_KM) // SHELL_KM)))
        host = host.withColumn("shell", F.explode(F.sequence(F.col("b_s0"), F.floor((F.col("b_high_") + distance_km) / SHELL_KM).cast("int"))))
        keys.append("shell")
    both = guest.join(host.hint("merge"), keys).where("a_norad_id <> b_norad_id and (a_level < level or forward and (not here or a_norad_id < b_norad_id))")
    if shells:
        both = both.where("shell = greatest(a_s0, b_s0)").where(F.expr(f"a_low_ <= b_high_ + {distance_km} and b_low_ <= a_high_ + {distance_km}"))
    return both.select("tick", *[f"{side}_{c}" for c in own for side in "ab"])


def _slices(known: DataFrame, distance_km: float, half: float) -> int:
    """In how many parts of equal time to look at a step: each part places every state anew and pairs by its smaller columns.

    Weighed by the microseconds of either, as measured, for states spread evenly between the first and last hundredth along each axis.
    """
    spread = [F.percentile_approx(c, [0.01, 0.99], 1000).alias(f"s{c}") for c in "xyz"]
    r = known.agg(F.count("*").alias("n"), F.approx_count_distinct("tick").alias("ticks"), *spread, *[F.percentile_approx(F.abs(f"v{c}") * half, 0.99, 1000).alias(f"r{c}") for c in "xyz"]).first()
    if not r["n"]:
        return 1
    edges = lambda n: [distance_km + 2 * r[f"r{c}"] / n for c in "xyz"]
    alone = lambda n: float(np.prod([e / max(e, r[f"s{c}"][1] - r[f"s{c}"][0]) for e, c in zip(edges(n), "xyz", strict=True)]))
    return min(range(1, 33), key=lambda n: n * (2.0 + 9 * 0.06 * r["n"] / max(1, r["ticks"]) * alone(n)))


def _near(a: np.ndarray, b: np.ndarray, reach: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Orders of a and of b, places, and pairs of rows so ordered that are at most reach apart along each axis, and some more; with
    same, a is b and a pair comes once.

    The order is by columns of x and y, an edge as wide as reach, and then by z. A row of b looks up and down its own column and
    those around it, with same one half of them.
    """
    low, high = np.minimum(a.min(axis=0), b.min(axis=0)), np.maximum(a.max(axis=0), b.max(axis=0))
    edge = np.maximum(reach, (high - low) / 1000)
    tall = np.floor((high[1] - low[1]) / edge[1]) + 3
    up = edge[2] * (1 + 1e-6)
    span = high[2] - low[2] + 4 * up
    line = lambda p: ((np.floor((p[:, 0] - low[0]) / edge[0]) + 1) * tall + np.floor((p[:, 1] - low[1]) / edge[1]) + 1) * span + p[:, 2] - low[2]
    at_a, at_b = line(a), line(b)
    order_a, order_b = np.argsort(at_a), np.argsort(at_b)
    at_a, at_b = at_a[order_a], at_b[order_b]

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for dx, dy in [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)] if same else [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]:
            there = at_b + (dx * tall + dy) * span
            first = np.arange(1, len(b) + 1) if same and dx == dy == 0 else np.searchsorted(at_a, there - up)
            n = np.maximum(np.searchsorted(at_a, there + up, "right") - first, 0)
            ends, start = np.cumsum(n), 0
            while start < len(n):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
                many = n[start:stop]
                if ends[stop - 1] > done:
                    yield np.arange(ends[stop - 1] - done) + np.repeat(first[start:stop] + many + done - ends[start:stop], many), np.repeat(np.arange(start, stop), many)
                start = stop

    return order_a, order_b, pairs()


def _met(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], distance_km: float, half: float, parts: int, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, miss, time) of states (numbers, marks and rows of x, y, z, vx, vy, vz) of one block that come within distance_km, but for
    pairs that another block has first; with same, a is b.

    The step is cut in parts of time, in which states reach less far; a pair is taken in the part that its closest approach is in.
    """
    if not len(a[0]) or not len(b[0]):
        return
    wide, within = 2 * half / parts, _within(distance_km)
    reach = within + (np.abs(a[2][:, 3:]).max(axis=0) + np.abs(b[2][:, 3:]).max(axis=0)) * (wide / 2)
    for part in range(parts):
        at_a, at_b = (s[:, :3] + s[:, 3:] * ((part + 0.5) * wide - half) for *_, s in (a, b))
        order_a, order_b, pairs = _near(at_a, at_b, reach, same)
        (ax, ay, az), (bx, by, bz) = np.ascontiguousarray(at_a[order_a].T), np.ascontiguousarray(at_b[order_b].T)
        (id_a, mark_a, of_a), (id_b, mark_b, of_b) = (tuple(c[order] for c in side) for side, order in ((a, order_a), (b, order_b)))
        far_a, far_b = (np.linalg.norm(s[:, 3:], axis=1) * (wide / 2) + within / 2 for s in (of_a, of_b))
        for i, j in pairs:
            x, y, z, far = bx[j] - ax[i], by[j] - ay[i], bz[j] - az[i], far_b[j] + far_a[i]
            near = np.flatnonzero(x * x + y * y + z * z <= far * far)
            i, j = i[near], j[near]
            near = np.flatnonzero(((mark_a[i] | mark_b[j]) & 7 == 7) & (id_a[i] != id_b[j]))
            i, j = i[near], j[near]
            x, y, z, vx, vy, vz = np.ascontiguousarray(((of_b[j] - of_a[i]) * np.where(id_a[i] < id_b[j], 1.0, -1.0)[:, None]).T)
            vv = vx * vx + vy * vy + vz * vz
            t = np.where(vv == 0, 0.0, np.clip(-(x * vx + y * vy + z * vz) / np.where(vv == 0, 1.0, vv), -half, half))
            miss = np.sqrt((x + vx * t) * (x + vx * t) + (y + vy * t) * (y + vy * t) + (z + vz * t) * (z + vz * t))
            hit = np.flatnonzero((miss <= distance_km) & (np.clip((t + half) // wide, 0, parts - 1) == part))
            one, other = id_a[i[hit]], id_b[j[hit]]
            yield np.minimum(one, other), np.maximum(one, other), miss[hit], t[hit]


def _within(distance_km: float) -> float:
    """The distance with some room for rounding."""
    return distance_km * (1 + 1e-6) + 1e-6


def _blocks(states: DataFrame, distance_km: float, half: float) -> DataFrame:
    """(tick, one, other, part, hosts, guests): states (tick, norad_id, x, y, z, vx, vy, vz) packed by blocks of space.

    A state fills a box: its place, its way in half a step and half of distance_km. States that meet have boxes that meet. A
    block's edges are BLOCK times those of the boxes that 99 of 100 states need, so a state lies in two or three blocks on average, however
    crowded they are. A wider box goes to a level whose edges are doubled as often as it needs: states are hosts on their own level
    and guests on each higher level in use. Hosts of a block meet each other and its guests. Of the blocks that two states
    share, theirs is the one in which, along each axis, one of them has its first: mark has three bits for that.

    A block of more than BLOCK_ROWS hosts or guests is dealt into shares: hosts of share one and of share other meet in one row
    (one <= other), and guests of a part meet the hosts of a share (one = other) in another. So no row is large, and no task has a whole block
    that is crowded. The share of a host is in its mark, above the three bits.
    """
    reach = {c: F.abs(f"v{c}") * half + F.abs(c) * 1e-12 + _within(distance_km) / 2 for c in "xyz"}
    base = states.agg(*[F.percentile_approx(reach[c] * 2, 0.99, 1000).alias(c) for c in "xyz"]).first()
    need = {c: max((base[c] or 0) * 1.05, 1e-6) for c in "xyz"}
    at_once = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = states.repartition(at_once, "norad_id")  # a small file is one task
    rows = rows.withColumn("own", F.greatest(*[F.ceil(F.log2(F.greatest(F.lit(1.0), reach[c] * 2 / need[c]))) for c in "xyz"], F.lit(0)).cast("int"))
    used = sorted(r["own"] for r in rows.select("own").distinct().collect()) or [0]  # some tens at most
    keys = ["tick", "level", "ix", "iy", "iz"]

    def placed(rows: DataFrame, least: int) -> DataFrame:
        rows = rows.select("*", F.explode(F.filter(F.array(*map(F.lit, used)), lambda n: n >= F.col("own") + least)).alias("level"))
        edge = {c: F.pow(F.lit(2.0), F.col("level")) * (need[c] * BLOCK) for c in "xyz"}
        rows = rows.select("*", *[F.floor((F.col(c) - reach[c]) / edge[c]).alias(f"f{c}") for c in "xyz"], *[F.floor((F.col(c) + reach[c]) / edge[c]).alias(f"l{c}") for c in "xyz"])
        for c in "xyz":
            rows = rows.select("*", F.explode(F.sequence(f"f{c}", f"l{c}")).alias(f"i{c}"))
        first = [F.when(F.col(f"i{c}") == F.col(f"f{c}"), 1 << k).otherwise(0) for k, c in enumerate("xyz")]
        return rows.select(*keys, "own", "norad_id", *STATE, (first[0] + first[1] + first[2]).alias("mark"))

    count = placed(rows, 0).groupBy(keys).agg(F.sum(F.when(F.col("own") == F.col("level"), 1).otherwise(0)).alias("h"), F.sum(F.when(F.col("own") < F.col("level"), 1).otherwise(0)).alias("g"))
    count = count.where("h > 0").select(*keys, "h", "g", F.ceil(F.col("h") / BLOCK_ROWS).cast("int").alias("shares"), F.greatest(F.lit(1), F.ceil(F.col("g") / BLOCK_ROWS).cast("int")).alias("parts"))
    crowded = F.collect_list(F.when(F.expr("shares > 1 or parts > 1"), F.struct(*keys, "shares", "parts")))  # at most one for BLOCK_ROWS rows
    total, crowded = count.agg(F.sum(F.expr("h * (shares + parts - 1) + g * shares")), crowded).first()
    spread = max(min(at_once, 1 + (total or 0) // 2000), 1 + (total or 0) // TASK_ROWS)
    hosts, guests = placed(rows.where(F.col("own").isin(used)), 0).where("own = level"), placed(rows.where(F.col("own") < used[-1]), 1)
    if crowded:
        known = states.sparkSession.createDataFrame([tuple(r) for r in crowded], hosts.select(*keys).schema.add("shares", "integer").add("parts", "integer"))
        hosts, guests = (side.join(F.broadcast(known), keys, "left").fillna(1, ["shares", "parts"]) for side in (hosts, guests))
        share, part = F.pmod(F.xxhash64("norad_id"), F.col("shares")).cast("int"), F.pmod(F.xxhash64("norad_id"), F.col("parts")).cast("int")
        cell = lambda one, other, part: F.struct(one.alias("one"), other.alias("other"), part.alias("part"))
        upto = lambda first, n: F.filter(F.sequence(F.lit(0), F.col(n) - 1), lambda k: k >= first)
        of_host = F.concat(F.transform(upto(0, "shares"), lambda k: cell(F.least(k, F.col("share")), F.greatest(k, F.col("share")), F.lit(0))), F.transform(upto(1, "parts"), lambda k: cell(F.col("share"), F.col("share"), k)))
        hosts = hosts.withColumn("share", share).select("*", F.explode(of_host).alias("cell")).withColumn("mark", F.col("mark") + F.col("share") * 8)
        guests = guests.withColumn("guest", part).select("*", F.explode(F.transform(upto(0, "shares"), lambda k: cell(k, k, F.col("guest")))).alias("cell"))
        hosts, guests = (side.select("*", "cell.*") for side in (hosts, guests))
    else:
        hosts, guests = (side.withColumns({c: F.lit(0) for c in ("one", "other", "part")}) for side in (hosts, guests))
    keys += ["one", "other", "part"]
    packed = lambda side, name: side.repartition(spread, *keys).groupBy(keys).agg(F.collect_list(F.struct("norad_id", "mark", *STATE)).alias(name))
    return packed(hosts, "hosts").join(packed(guests, "guests").hint("merge"), keys, "left").select("tick", "one", "other", "part", "hosts", "guests")


def screen(states: DataFrame, distance_km: float = 5.0, step_s: float = 10.0) -> DataFrame:
    """(tick, a, b, miss_km, t_offset): pairs a < b whose least distance within half a step of the tick is small.

    Between ticks motion is linear, so along each axis a state stays within half a step at its speed. States meet in blocks of space
    (_blocks), whose rows are paired by arrays (_met); only there is the step cut in parts of time (_slices), so what is
    shuffled grows with the states, and with the shares of blocks that are too crowded for one row. States with a coordinate or speed that is null, infinite or no number are left out.
    """
    half = step_s / 2
    known = states.where(" and ".join(f"abs({c}) < double('infinity')" for c in STATE)).where("tick is not null and norad_id is not null").select("tick", "norad_id", *[F.col(c).cast("double").alias(c) for c in STATE])
    parts = _slices(known, distance_km, half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other, part = (batch.column(c).to_numpy() for c in ("one", "other", "part"))
            sides = []
            for side in ("hosts", "guests"):
                values = batch.column(side).values
                get = lambda n, values=values: values.field(n).to_numpy(zero_copy_only=False)
                sides.append((batch.column(side).offsets.to_numpy(), get("norad_id"), get("mark"), [get(c) for c in STATE]))

            def found(r: int, one=one, other=other, part=part, sides=sides) -> Iterator[tuple[np.ndarray, ...]]:
                hosts, guests = ((number[o[r] : o[r + 1]], mark[o[r] : o[r + 1]], np.stack([c[o[r] : o[r + 1]] for c in state], axis=1)) for o, number, mark, state in sides)
                if part[r] == 0 and one[r] == other[r]:
                    yield from _met(hosts, hosts, distance_km, half, parts, True)
                elif part[r] == 0:
                    yield from _met(*(tuple(c[hosts[1] >> 3 == share[r]] for c in hosts) for share in (one, other)), distance_km, half, parts, False)
                yield from _met(guests, hosts, distance_km, half, parts, False)

            held, size = [], 0
            for r in range(batch.num_rows):
                for hit in found(r):
                    held.append((np.full(len(hit[0]), r), *hit))
                    size += len(hit[0])
                    if size >= PAIRS_AT_ONCE:
                        yield out(batch, held)
                        held, size = [], 0
            if size:
                yield out(batch, held)

    def out(batch: pa.RecordBatch, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        row, *rest = (np.concatenate(c) for c in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([batch.column("tick").take(pa.array(row)), *map(pa.array, rest)], ["tick", "a", "b", "miss_km", "t_offset"])

    return _blocks(known, distance_km, half).mapInArrow(run, f"tick {states.schema['tick'].dataType.simpleString()}, a bigint, b bigint, miss_km double, t_offset double")


def _nearest(p: np.ndarray, v: np.ndarray, q: np.ndarray, w: np.ndarray, step_s: float) -> tuple[np.ndarray, np.ndarray]:
    """The least distance and its time in the step of relative motions from p at speed v to q at speed w, on cubics.

    The range rate has at most five roots. It is looked at on 32 parts; in each where it rises through zero the root is
    halved down to below a microsecond. The ends count, too.
    """
    a, b = (2 * (p - q) + step_s * (v + w)) / step_s**3, (3 * (q - p) - step_s * (2 * v + w)) / step_s**2
    place = lambda t: p + t[:, None] * (v + t[:, None] * (b + t[:, None] * a))
    rate = lambda t: (place(t) * (v + t[:, None] * (2 * b + 3 * t[:, None] * a))).sum(axis=1)
    far = lambda t: np.linalg.norm(place(t), axis=1)
    best_t, best = np.zeros(len(p)), far(np.zeros(len(p)))
    marks = np.linspace(0, step_s, 33)
    before = rate(np.full(len(p), marks[0]))
    for low, high in zip(marks[:-1], marks[1:], strict=True):
        after = rate(np.full(len(p), high))
        rows = np.flatnonzero((before < 0) & (after >= 0))
        if len(rows):
            pick = lambda x, rows=rows: x[rows]
            pp, vv, aa, bb = map(pick, (p, v, a, b))
            lo, hi = np.full(len(rows), low), np.full(len(rows), high)
            for _ in range(30):
                t = (lo + hi) / 2
                r = pp + t[:, None] * (vv + t[:, None] * (bb + t[:, None] * aa))
                up = (r * (vv + t[:, None] * (2 * bb + 3 * t[:, None] * aa))).sum(axis=1) >= 0
                lo, hi = np.where(up, lo, t), np.where(up, t, hi)
            r = pp + hi[:, None] * (vv + hi[:, None] * (bb + hi[:, None] * aa))
            d = np.linalg.norm(r, axis=1)
            closer = d < best[rows]
            best[rows[closer]], best_t[rows[closer]] = d[closer], hi[closer]
        before = after
    last = far(np.full(len(p), step_s))
    return np.where(last < best, last, best), np.where(last < best, step_s, best_t)


def screen_curved(states: DataFrame, distance_km: float = 5.0, step_s: float = 60.0) -> DataFrame:
    """(tick, a, b, miss_km, t_offset): pairs a < b whose least distance between a tick and the next, t_offset seconds after the
    tick, is small. Between ticks an object moves on the cubic that has its place and speed at both.

    An object whose next tick is missing has no motion from there. The cubic lies in the hull of its four control points, which
    bounds its reach along each axis and its distance from the Earth's centre: pairs whose shells do not overlap never meet, the
    rest by _candidates. States that are null, infinite or no number are left out. At a minute's ticks the cubic is within a metre of
    an orbit.
    """
    names = [f"{d}{c}" for d in ("p", "v", "q", "w") for c in "xyz"]
    known = states.where(" and ".join(f"abs({c}) < double('infinity')" for c in ("x", "y", "z", "vx", "vy", "vz")))
    after = Window.partitionBy("norad_id").orderBy("tick")
    rows = known.select("tick", "norad_id", *[F.col(c).alias(f"p{c}") for c in "xyz"], *[f"v{c}" for c in "xyz"], F.lead("tick").over(after).alias("next"), *[F.lead(c).over(after).alias(n) for c, n in zip(("x", "y", "z", "vx", "vy", "vz"), names[6:], strict=True)])
    rows = rows.where("next = tick + 1").drop("next")
    points = [{c: F.col(f"p{c}") for c in "xyz"}, {c: F.col(f"p{c}") + F.col(f"v{c}") * step_s / 3 for c in "xyz"}, {c: F.col(f"q{c}") - F.col(f"w{c}") * step_s / 3 for c in "xyz"}, {c: F.col(f"q{c}") for c in "xyz"}]
    norm = lambda p: F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"])
    rows = rows.withColumns({c: (F.least(*[p[c] for p in points]) + F.greatest(*[p[c] for p in points])) / 2 for c in "xyz"} | {f"r{c}": (F.greatest(*[p[c] for p in points]) - F.least(*[p[c] for p in points])) / 2 for c in "xyz"})
    length = F.greatest(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")), F.lit(1e-9))
    rows = rows.withColumns({"low": F.greatest(F.lit(0.0), F.least(*[(p["x"] * F.col("x") + p["y"] * F.col("y") + p["z"] * F.col("z")) / length for p in points])), "high": F.greatest(*[norm(p) for p in points])})
    both = _candidates(rows, distance_km, names, shells=True)
    columns = ["tick", "a_norad_id", "b_norad_id", *[f"{s}_{n}" for n in names for s in "ab"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda n, batch=batch: batch.column(columns.index(n)).to_numpy(zero_copy_only=False)
            moves = [np.stack([get(f"b_{d}{c}") - get(f"a_{d}{c}") for c in "xyz"], axis=1) for d in "pvqw"]
            miss, t = _nearest(*moves, step_s)
            near = np.flatnonzero(miss <= distance_km)
            a, b = get("a_norad_id")[near], get("b_norad_id")[near]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(near)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(miss[near]), pa.array(t[near])], ["tick", "a", "b", "miss_km", "t_offset"])

    return both.select(*columns).mapInArrow(run, f"tick {states.schema['tick'].dataType.simpleString()}, a bigint, b bigint, miss_km double, t_offset double")


def conjunctions_between(states: DataFrame, first_tick: int, last_tick: int, distance_km: float = 5.0, step_s: float = 10.0) -> DataFrame:
    """The encounters within a range of ticks, both ends included, with the closest approach of each inside the range.

    The range is cut out of the states, below the cell join.
    """
    return encounters(screen(states.where(F.col("tick").between(first_tick, last_tick)), distance_km, step_s))


def encounters(hits: DataFrame) -> DataFrame:
    """One row for each run of consecutive ticks of a pair: its first tick, its least distance and that tick."""
    w = Window.partitionBy("a", "b").orderBy("tick")
    rows = hits.withColumn("new", F.when(F.lag("tick").over(w) == F.col("tick") - 1, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(w))
    return rows.groupBy("a", "b", "island").agg(F.min("tick").alias("first_tick"), F.count("*").alias("ticks"), F.min("miss_km").alias("miss_km"), F.min_by("tick", F.struct("miss_km", "tick")).alias("tca_tick")).drop("island")


def risk_band(miss):
    return F.when(miss < 1, "high").when(miss < 5, "medium").otherwise("low")


def alerts(health: DataFrame, close: DataFrame) -> DataFrame:
    """Critical objects and encounters of high risk, in one list."""
    ill = health.where("status = 'Critical'").select(F.lit("health").alias("kind"), F.col("norad_id").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("reason").alias("detail"))
    near = close.where(risk_band(F.col("miss_km")) == "high").select(F.lit("conjunction").alias("kind"), "a", "b", F.lit("high").alias("detail"))
    return ill.unionByName(near)
