"""Overhead search and close approaches against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.functions import cells
from perigee.operators import screening

STATE = "tick int, norad_id long, x double, y double, z double, vx double, vy double, vz double"


def ecef(lat, lon, alt):
    r, lat, lon = 6378.137 + alt, np.radians(lat), np.radians(lon)
    return np.stack([r * np.cos(lat) * np.cos(lon), r * np.cos(lat) * np.sin(lon), r * np.sin(lat)], axis=1)


def zeniths(points, observer):
    d = points - observer
    with np.errstate(all="ignore"):
        return np.degrees(np.arccos(np.clip((d @ observer) / (np.linalg.norm(observer) * np.linalg.norm(d, axis=1)), -1, 1)))


def test_covers_hold_every_place_once():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 3))
    v = np.concatenate([v, [[0, 0, 1], [0, 0, -1], [-1, 1e-12, 0], [1, 1, 1], [1, -1, 0]]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    radii = np.concatenate([10 ** rng.uniform(-4, 0.5, 400), [0.3, 3.2, 0.0, 0.01, 1.6]])
    which, level, face, i, j = cells.cover(v, radii)
    assert np.bincount(which).max() < 200 and len(set(zip(which, level, face, i, j, strict=True))) == len(which)
    have = {}
    for w, *cell in zip(which, level, face, i, j, strict=True):
        have.setdefault(w, set()).add(tuple(map(int, cell)))
    for w in range(len(v)):
        for _ in range(20):
            side = np.cross(v[w], rng.normal(size=3))
            a = rng.uniform(0, min(radii[w], math.pi))
            p = v[w] * math.cos(a) + side / np.linalg.norm(side) * math.sin(a)
            assert sum(cell in have[w] for cell in path(p)) == 1


def path(p):
    """The cells of a place at all levels, as the columns give them."""
    axis = int(np.argmax(np.abs(p)))
    s, t = ((1, 2), (2, 0), (0, 1))[axis]
    place = lambda side: min((1 << cells.FINEST) - 1, int(math.floor((math.atan(side / abs(p[axis])) / math.pi * 4 + 1) / 2 * (1 << cells.FINEST))))
    return [(n, axis * 2 + (p[axis] < 0), place(p[s]) >> (cells.FINEST - n), place(p[t]) >> (cells.FINEST - n)) for n in range(cells.FINEST + 1)]


def test_many_observers_equal_brute_force(spark):
    """A hundred thousand observers, some at the poles and the date line, some that see all round; checked on a sample."""
    rng = np.random.default_rng(9)
    lat, lon, alt = np.degrees(np.arcsin(rng.uniform(-1, 1, 500))), rng.uniform(-180, 180, 500), rng.choice([550.0, 1500.0, 36_000.0], 500)
    lat[:6], lon[:6] = [90, -90, 89.99, 0, 0, 0], [0, 0, 120, 180, -180, 179.999]
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(zip(lat, lon, alt, strict=True))], "norad_id long, lat double, lon double, alt double")
    points = points.unionByName(spark.createDataFrame([(900, math.nan, 0.0, 1.0), (901, None, 0.0, 1.0)], points.schema))
    observers = spark.range(100_000).selectExpr("cast(id as int) obs_id", "degrees(asin(2D * pmod(xxhash64(id), 100003) / 100003 - 1)) o_lat", "360D * pmod(xxhash64(id, 1), 100003) / 100003 - 180 o_lon", "0.1D o_alt", "double(pmod(id, 21)) radius_deg")
    fixed = [(200_001, 90.0, 0.0, 0.0, 90.0), (200_002, -90.0, 77.0, 0.0, 40.0), (200_003, 0.0, 180.0, 0.0, 60.0), (200_004, 10.0, -180.0, 0.0, 89.0), (200_005, 0.0, 0.0, 0.0, 180.0), (200_006, 5.0, 5.0, 5000.0, 120.0), (200_007, 0.0, 0.0, 40_000.0, 50.0), (200_008, math.nan, 0.0, 0.0, 50.0), (200_009, 0.0, 0.0, 0.0, -1.0)]
    observers = observers.unionByName(spark.createDataFrame(fixed, observers.schema))
    hits = screening.overhead(points, observers)
    asked = observers.where("obs_id % 997 = 3 or obs_id > 200000").collect()
    places, got = ecef(lat, lon, alt), {}
    for r in hits.where("obs_id % 997 = 3 or obs_id > 200000").collect():
        got.setdefault(r["obs_id"], []).append(r["norad_id"])
    for o in asked:
        if o["obs_id"] > 200_007:
            assert o["obs_id"] not in got
            continue
        z = zeniths(places, ecef(np.array([o["o_lat"]]), np.array([o["o_lon"]]), o["o_alt"])[0])
        clear = np.abs(z - o["radius_deg"]) > 1e-6
        assert set(np.flatnonzero((z <= o["radius_deg"]) & clear)) <= set(got.get(o["obs_id"], [])) <= set(np.flatnonzero((z <= o["radius_deg"]) | ~clear))
        assert len(got.get(o["obs_id"], [])) == len(set(got.get(o["obs_id"], [])))
    assert len(got[200_005]) == 500
    keys = screening._covers(spark.createDataFrame([(i, 20.0, *map(float, v)) for i, v in enumerate(ecef(np.linspace(-89, 89, 3000), np.linspace(-180, 900, 3000), 0.0))], "obs_id int, radius_deg double, ox double, oy double, oz double"), 7000.0)
    assert keys.select("level", "face", "i", "j").distinct().count() > 2000


def lines(n, rng, speed=4.0):
    return np.concatenate([rng.uniform(0, 150, (n, 3)), rng.uniform(-speed, speed, (n, 3))], axis=1)


def table(spark, states, ticks=1, step=0.0):
    rows = [(t, i, *map(float, s[:3] + t * step * s[3:]), *map(float, s[3:])) for i, s in enumerate(states) for t in range(ticks)]
    return spark.createDataFrame(rows, STATE)


def brute(states, distance, half):
    out = set()
    for a, b in itertools.combinations(range(len(states)), 2):
        d, v = states[b][:3] - states[a][:3], states[b][3:] - states[a][3:]
        vv = v @ v
        t = max(-half, min(half, -(d @ v) / vv)) if vv else 0.0
        if np.linalg.norm(d + v * t) <= distance:
            out.add((a, b))
    return out


@pytest.mark.parametrize("odd", [[], [10_000.0], [300.0, 40.0, 10_000.0, 9000.0]])
def test_screening_with_fast_states_equals_brute_force(spark, odd):
    rng = np.random.default_rng(11)
    states = lines(400, rng)
    for k, v in enumerate(odd):  # they fly through the crowd
        states[k, 3:] = np.array([v, v / 7, -v / 9])
        states[k, :3] = states[50 + k, :3] + (states[50 + k, 3:] - states[k, 3:]) * 2
    got = {(r["a"], r["b"]) for r in screening.screen(table(spark, states)).collect()}
    want = brute(states, 5.0, 5.0)
    assert got == want and len(want) > 30
    for k in range(len(odd)):
        assert any(k in pair for pair in want)


def test_a_fast_state_costs_only_itself(spark):
    rng = np.random.default_rng(2)
    states = lines(3000, rng)

    def pairs(s):
        rows = table(spark, s).withColumns({f"r{c}": F.abs(f"v{c}") * 5 for c in "xyz"})
        made = screening._candidates(rows, 5.0, [])
        return made.count(), made.where("a_norad_id < 3000 and b_norad_id < 3000").count()

    whole, _ = pairs(states)
    fast = np.concatenate([states, [[0, 0, 0, 10_000.0, 0, 0]]])
    total, rest = pairs(fast)
    assert abs(rest - whole) < 0.05 * whole and total - rest <= 3000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_grown_from_a_small_file_are_shuffled(spark, tmp_path):
    """A file far below the broadcast limit: neither side may go to the driver, whatever it is turned into."""
    table(spark, lines(50, np.random.default_rng(1)), 3, 60.0).coalesce(1).write.parquet(f"{tmp_path}/s")
    states = spark.read.parquet(f"{tmp_path}/s")
    for made in (screening.screen(states), screening.screen_curved(states)):
        assert "SortMergeJoin" in plan(made) and "BroadcastHashJoin" not in plan(made)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_parts_of_a_step_give_the_same_approaches(spark, monkeypatch, parts):
    rng = np.random.default_rng(17)
    states = lines(300, rng)
    states[:100, 3:] = states[200:, 3:]  # some fly side by side
    states[:40, :3] = states[200:240, :3] + rng.uniform(-2, 2, (40, 3))
    states[0, 3:] = states[1, 3:] = 0
    monkeypatch.setattr(screening, "_slices", lambda *_: parts)
    got = screening.screen(table(spark, states)).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got}) and {(r["a"], r["b"]) for r in got} == brute(states, 5.0, 5.0)
    for r in got:
        d, v = states[r["b"]][:3] - states[r["a"]][:3], states[r["b"]][3:] - states[r["a"]][3:]
        assert abs(np.linalg.norm(d + v * r["t_offset"]) - r["miss_km"]) < 1e-9


def test_crowded_states_are_looked_at_in_more_parts(spark):
    few = table(spark, lines(50, np.random.default_rng(1)))
    crowd = spark.range(200_000).selectExpr("0 tick", "id norad_id", *[f"pmod(xxhash64(id, {k}), 8000) / 10D {c}" for k, c in enumerate("xyz")], *[f"pmod(xxhash64(id, {k}), 90) / 10D - 4.5D v{c}" for k, c in enumerate("uvw", 3)]).withColumnsRenamed({"vu": "vx", "vv": "vy", "vw": "vz"})
    assert screening._slices(few, 5.0, 5.0) == 1 < screening._slices(crowd, 5.0, 5.0)


def test_states_that_are_no_number_are_left_out(spark):
    rng = np.random.default_rng(3)
    states = lines(60, rng)
    want = {(r["a"], r["b"]) for r in screening.screen(table(spark, states)).collect()}
    bad = spark.createDataFrame([(0, 100, math.nan, *[0.0] * 5), (0, 101, 1.0, 1.0, 1.0, math.nan, 0.0, 0.0), (0, 102, *[1.0] * 5, math.inf), (0, 103, None, *[0.0] * 5)], STATE)
    assert {(r["a"], r["b"]) for r in screening.screen(table(spark, states).unionByName(bad)).collect()} == want
    assert screening.screen(bad).count() == 0 and screening.screen(bad.limit(0)).count() == 0 and screening.screen_curved(bad).count() == 0


def orbits(n, rng):
    """Orbits near the Earth: the radius, and two unit vectors in each plane; pairs of them are made to meet."""
    out = []
    for k in range(n):
        u = rng.normal(size=3)
        u /= np.linalg.norm(u)
        w = np.cross(u, rng.normal(size=3))
        w /= np.linalg.norm(w)
        r = 7000 + rng.uniform(-60, 60)
        if k % 2 and k < n // 2:  # through the place of the one before at a common time, within a few kilometres
            r0, u0, w0 = out[-1]
            n0 = math.sqrt(398600.4418 / r0**3)
            at = rng.uniform(0, 1500)
            p = u0 * math.cos(n0 * at) + w0 * math.sin(n0 * at)
            r = r0 + rng.uniform(-6, 6)
            nn = math.sqrt(398600.4418 / r**3)
            q = np.cross(p, rng.normal(size=3))
            q /= np.linalg.norm(q)
            u, w = p * math.cos(nn * at) - q * math.sin(nn * at), p * math.sin(nn * at) + q * math.cos(nn * at)
        out.append((r, u, w))
    return out


def at(orbit, t):
    r, u, w = orbit
    n = math.sqrt(398600.4418 / r**3)
    c, s = np.cos(n * t)[:, None], np.sin(n * t)[:, None]
    return r * (u * c + w * s), r * n * (w * c - u * s)


def test_coarse_ticks_find_the_encounters_of_fine_ones(spark):
    rng = np.random.default_rng(21)
    made, span = orbits(60, rng), 1800

    def found(step):
        t = np.arange(0, span + 1, step, dtype=float)
        rows = [(k, i, *map(float, p), *map(float, v)) for i, o in enumerate(made) for k, (p, v) in enumerate(zip(*at(o, t), strict=True))]
        hits = screening.screen_curved(spark.createDataFrame(rows, STATE), 5.0, float(step))
        hits = hits.withColumn("when", F.col("tick") * step + F.col("t_offset"))
        return sorted((r["a"], r["b"], r["miss_km"], r["when"]) for r in hits.groupBy("a", "b").agg(F.min("miss_km").alias("miss_km"), F.min_by("when", "miss_km").alias("when")).collect())

    fine, coarse = found(10), found(60)
    t = np.arange(0, span + 0.25, 0.25)
    paths = [at(o, t)[0] for o in made]
    want = {}
    for a, b in itertools.combinations(range(60), 2):
        d = np.linalg.norm(paths[a] - paths[b], axis=1)
        if d.min() < 7:
            k = int(d.argmin())
            tt = np.linspace(max(0, t[k] - 0.3), min(span, t[k] + 0.3), 6001)
            e = np.linalg.norm(at(made[a], tt)[0] - at(made[b], tt)[0], axis=1)
            if e.min() <= 5:
                want[a, b] = (e.min(), tt[e.argmin()])
    assert {x[:2] for x in fine} == {x[:2] for x in coarse} == set(want) and len(want) > 8
    for a, b, miss, when in fine + coarse:
        assert abs(miss - want[a, b][0]) < 0.01 and abs(when - want[a, b][1]) < 0.05


def test_two_minima_in_one_step_and_missing_ticks(spark):
    # straight motion past each other, seen at ticks a minute apart; an object without its next tick has no motion
    rows = [(k, i, x + k * 60 * v, 7000.0, y, v, 0.0, 0.0) for i, (x, y, v) in enumerate([(-200.0, 0.0, 7.0), (200.0, 3.0, -7.0), (0.0, 0.0, 0.0)]) for k in range(2)]
    rows += [(0, 9, 0.0, 7000.0, 1.0, 0.0, 0.0, 0.0), (2, 9, 0.0, 7000.0, 1.0, 0.0, 0.0, 0.0)]
    got = {(r["a"], r["b"]): (round(r["miss_km"], 6), round(r["t_offset"], 4)) for r in screening.screen_curved(spark.createDataFrame(rows, STATE)).collect()}
    assert got == {(0, 1): (3.0, 28.5714), (0, 2): (0.0, 28.5714), (1, 2): (3.0, 28.5714)}


def crowd(spark, n, side):
    """States spread over a cube at up to 4.5 km/s."""
    states = spark.range(n).selectExpr("0 tick", "id norad_id", *[f"pmod(xxhash64(id, {k}), 100003) * {side}D / 100003 {c}" for k, c in enumerate("xyz")], *[f"pmod(xxhash64(id, {k}), 91) / 10D - 4.5D v{c}" for k, c in enumerate("xyz", 3)])
    return states.select("tick", "norad_id", "x", "y", "z", "vx", "vy", "vz")


def shuffled_rows(spark):
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_crowding_does_not_shuffle_more(spark):
    """In a crowd a step is looked at in parts; the shuffles hold a few rows of each state all the same."""
    few, n = crowd(spark, 500, 300), 20_000
    states = crowd(spark, n, 300)
    assert screening._slices(few, 5.0, 5.0) == 1 < screening._slices(states, 5.0, 5.0)
    before = shuffled_rows(spark)
    assert screening.screen(states).count() > n
    assert shuffled_rows(spark) - before < 6 * n


@pytest.mark.parametrize("odd", [[], [300.0, 40.0, 10_000.0, 9000.0]])
def test_crowded_blocks_are_dealt_into_small_rows(spark, monkeypatch, odd):
    rng = np.random.default_rng(31)
    states = lines(500, rng)
    states[:150, :3] = states[150, :3] + rng.uniform(-4, 4, (150, 3))
    for k, v in enumerate(odd):
        states[k, 3:] = np.array([v, v / 7, -v / 9])
    monkeypatch.setattr(screening, "BLOCK_ROWS", 20)
    got = [(r["a"], r["b"]) for r in screening.screen(table(spark, states)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(states, 5.0, 5.0) and len(got) > 5000
    r = screening._blocks(table(spark, states), 5.0, 5.0).agg(F.max(F.size("hosts")), F.max(F.size("guests")), F.count("*")).first()
    assert r[0] <= 80 and (r[1] or 0) <= 60 and r[2] > 100


def test_states_without_tick_or_number_meet_none(spark):
    rows = [(None, 1, *[0.0] * 6), (None, 2, *[0.0] * 6), (0, None, *[0.0] * 6), (0, 3, *[0.0] * 6), (0, 3, *[0.0] * 6), (0, 4, *[0.0] * 6)]
    assert sorted((r["a"], r["b"], r["miss_km"]) for r in screening.screen(spark.createDataFrame(rows, STATE)).collect()) == [(3, 4, 0.0), (3, 4, 0.0)]
