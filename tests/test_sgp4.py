import numpy as np

from perigee.functions import sgp4


def test_verification_object_00005():
    # 58002B, epoch 00179.78495062, at the epoch (AIAA 2006-6753)
    rad = np.radians
    r, v, ok = sgp4.propagate(0.0, 2.8098e-5, 0.1859667, rad(34.2682), rad(348.7242), rad(331.7664), rad(19.3264), 10.82419157 * 2 * np.pi / 1440, 2451722.5)
    assert bool(ok)
    assert np.allclose([float(x) for x in r], [7022.465, -1400.083, 0.040], atol=0.01)
    assert np.allclose([float(x) for x in v], [1.894, 6.406, 4.535], atol=0.001)


def julian(year, day):
    return 2440587.5 + (np.datetime64(f"{year}-01-01") - np.datetime64("1970-01-01")).astype(int) + day - 1


#: Published test objects of deep space (AIAA 2006-6753): epoch, drag, eccentricity, inclination, node, perigee, anomaly, rev/day.
DEEP = {
    11801: (julian(1980, 230.29629788), 0.014311, 0.7318036, 46.7916, 230.4354, 47.4722, 10.4117, 2.28537848),
    28626: (julian(2006, 176.46683397), 1e-4, 0.0000335, 0.0019, 286.9433, 13.7918, 55.6504, 1.00270176),
    8195: (julian(2006, 176.33215444), 1.1873e-4, 0.6877146, 64.1586, 279.0717, 264.7651, 20.2257, 2.00491383),
}


def deep(name, minutes):
    jd, drag, ecc, *angles, rev = DEEP[name]
    return sgp4.propagate(minutes, drag, ecc, *np.radians(angles), rev * 2 * np.pi / 1440, jd)


def test_deep_space_objects():
    # no resonance, one revolution a day, two a day
    for name, t, place, speed in [
        (11801, 0.0, [7473.37102491, 428.94748312, 5828.74846783], [5.107155391, 6.444680305, -0.186133297]),
        (11801, 360.0, [-3305.22148694, 32410.84323331, -24697.16974954], [-1.301137319, -1.151315600, -0.283335823]),
        (28626, 0.0, [42080.71852213, -2646.86387436, 0.81851294], [0.193105177, 3.068688251, 0.000438449]),
        (28626, 120.0, [37740.00085593, 18802.76872802, 3.45512584], [-1.371035206, 2.752105932, 0.000336883]),
        (8195, 0.0, [2349.89483350, -14785.93811562, 0.02119378], [2.721488096, -3.256811655, 4.498416672]),
        (8195, 120.0, [15223.91713658, -17852.95881713, 25280.39558224], [1.079041732, 0.875187372, 2.485682813]),
    ]:
        r, v, ok = deep(name, t)
        assert bool(ok) and np.allclose([float(x) for x in r], place, atol=1e-3) and np.allclose([float(x) for x in v], speed, atol=1e-6)


def test_deep_space_over_steps_of_the_integrator():
    for name in DEEP:
        times = np.array([719.99, 720.01, -720.01, -719.99, 10_000.0, 10_000.02])
        r, _, ok = deep(name, times)
        alone = [[float(x) for x in deep(name, t)[0]] for t in times]
        assert ok.all() and np.allclose(np.array(r).T, alone)
        gaps = np.linalg.norm(np.diff(np.array(r).T, axis=0)[::2], axis=1)
        assert (gaps < 0.02 * 60 * 11).all()


def test_velocity_is_the_derivative():
    a = (1e-5, 0.001, 1.0, 0.3, 0.2, 0.1, 15 * 2 * np.pi / 1440, 2451722.5)
    (p0, _, _), (p1, _, _), (_, v, ok) = (sgp4.propagate(t, *a) for t in (99.99, 100.01, 100.0))
    assert np.allclose((np.array(p1) - np.array(p0)) / 1.2, v, atol=1e-3) and bool(ok)
    assert not bool(sgp4.propagate(0.0, 1e-5, 1.2, *a[2:])[2])


def test_geodetic_inverts():
    lat, lon, alt = np.radians(50.0), np.radians(-30.0), 700.0
    e2 = 2 * sgp4.F84 - sgp4.F84**2
    n = sgp4.A84 / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    xyz = ((n + alt) * np.cos(lat) * np.cos(lon), (n + alt) * np.cos(lat) * np.sin(lon), (n * (1 - e2) + alt) * np.sin(lat))
    assert np.allclose([float(x) for x in sgp4.geodetic(*map(np.array, xyz), 0.0)], [50.0, -30.0, 700.0], atol=1e-6)


def test_a_grid_of_times_is_time_by_time():
    rng = np.random.default_rng(8)
    n = 40
    elements = [rng.uniform(-1e-4, 1e-4, n), rng.uniform(0, 0.7, n), rng.uniform(0, 3, n), *(rng.uniform(0, 6, n) for _ in range(3)), 2 * np.pi / rng.choice([95.0, 130.0, 219.0, 222.0, 226.0, 718.0, 1436.0], n), np.full(n, 2453911.5)]
    elements[6][3], elements[1][4] = np.nan, 1.5
    minutes = rng.uniform(-3000, 3000, (n, 7))
    r, v, ok = sgp4.propagate_grid(minutes, *elements)
    for k in range(7):
        rr, vv, good = sgp4.propagate(minutes[:, k], *elements)
        assert (good == ok[:, k]).all() and good.sum() > 10
        for x, y in zip([*r, *v], [*rr, *vv], strict=True):
            assert np.allclose(x[good, k], y[good], rtol=0, atol=1e-9)
