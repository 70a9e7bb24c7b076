"""Deep-space terms of SGP4 (Hoots and Roehrich 1980, SDP4; Vallado et al. 2006, AIAA 2006-6753), over arrays of objects and times.

For periods of 225 minutes or more: the long-period pull of sun and moon, secular and periodic, and the resonance with the
Earth's field of objects that go round once or twice a day.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np

TWO_PI = 2 * np.pi
#: Sun and moon (orbit's eccentricity, mean motion in radians a minute, strength).
SUN, MOON = (0.01675, 1.19459e-5, 2.9864797e-6), (0.05490, 1.5835218e-4, 4.7968065e-7)
#: The sun's orbit (sine and cosine of inclination, cosine and sine of the argument of perigee).
SUN_ORBIT = (0.39785416, 0.91744867, 0.1945905, -0.98088458)
#: The Earth's rotation in radians a minute, and the step of the resonance integrator in minutes.
ROTATION, STEP = 4.37526908801129966e-3, 720.0
#: Minutes from the epoch beyond which a resonant object counts as failed: about twenty years.
FARTHEST = 10_500_000.0
#: For an object that goes round once a day, (strength, phase) of the three terms.
ONCE = ((2.1460748e-6, 0.13130908), (1.7891679e-6, 2.8843198), (2.2123015e-7, 0.37448087))
#: For one that goes round twice a day, strengths by degree and order, and phases.
ROOT22, ROOT32, ROOT44, ROOT52, ROOT54 = 1.7891679e-6, 3.7393792e-7, 7.3636953e-9, 1.1428639e-7, 2.1765803e-9
G22, G32, G44, G52, G54 = 5.7686396, 0.95240898, 1.8014998, 1.0508330, 4.4108898


def _pull(body, orbit, e, sin_i, cos_i, sin_w, cos_w, n) -> SimpleNamespace:
    """The coefficients of one body's pull; orbit: cosine and sine of its argument, inclination and relative node."""
    cg, sg, ci, si, ch, sh = orbit
    e2 = e * e
    beta2 = 1 - e2
    beta = np.sqrt(beta2)
    a1, a3 = cg * ch + sg * ci * sh, -sg * ch + cg * ci * sh
    a7, a8, a9, a10 = -cg * sh + sg * ci * ch, sg * si, sg * sh + cg * ci * ch, cg * si
    a2, a4 = cos_i * a7 + sin_i * a8, cos_i * a9 + sin_i * a10
    a5, a6 = -sin_i * a7 + cos_i * a8, -sin_i * a9 + cos_i * a10
    x1, x2, x3, x4 = a1 * cos_w + a2 * sin_w, a3 * cos_w + a4 * sin_w, -a1 * sin_w + a2 * cos_w, -a3 * sin_w + a4 * cos_w
    x5, x6, x7, x8 = a5 * sin_w, a6 * sin_w, a5 * cos_w, a6 * cos_w
    z31, z32, z33 = 12 * x1 * x1 - 3 * x3 * x3, 24 * x1 * x2 - 6 * x3 * x4, 12 * x2 * x2 - 3 * x4 * x4
    z1 = 6 * (a1 * a1 + a2 * a2) + (1 + e2) * z31
    z2 = 12 * (a1 * a3 + a2 * a4) + (1 + e2) * z32
    z3 = 6 * (a3 * a3 + a4 * a4) + (1 + e2) * z33
    z11 = -6 * a1 * a5 + e2 * (-24 * x1 * x7 - 6 * x3 * x5)
    z12 = -6 * (a1 * a6 + a3 * a5) + e2 * (-24 * (x2 * x7 + x1 * x8) - 6 * (x3 * x6 + x4 * x5))
    z13 = -6 * a3 * a6 + e2 * (-24 * x2 * x8 - 6 * x4 * x6)
    z21 = 6 * a2 * a5 + e2 * (24 * x1 * x5 - 6 * x3 * x7)
    z22 = 6 * (a4 * a5 + a2 * a6) + e2 * (24 * (x2 * x5 + x1 * x6) - 6 * (x4 * x7 + x3 * x8))
    z23 = 6 * a4 * a6 + e2 * (24 * x2 * x6 - 6 * x4 * x8)
    s3 = body[2] / n
    s2, s4 = -0.5 * s3 / beta, s3 * beta
    s1 = -15 * e * s4
    s5, s6, s7 = x1 * x3 + x2 * x4, x2 * x3 + x1 * x4, x2 * x4 - x1 * x3
    zn = body[1]
    return SimpleNamespace(
        e=(2 * s1 * s6, 2 * s1 * s7), i=(2 * s2 * z12, 2 * s2 * (z13 - z11)), l=(-2 * s3 * z2, -2 * s3 * (z3 - z1), -2 * s3 * (-21 - 9 * e2) * body[0]),
        g=(2 * s4 * z32, 2 * s4 * (z33 - z31), -18 * s4 * body[0]), h=(-2 * s2 * z22, -2 * s2 * (z23 - z21)),
        de=s1 * zn * s5, di=s2 * zn * (z11 + z13), dm=-zn * s3 * (z1 + z3 - 14 - 6 * e2), dg=s4 * zn * (z31 + z33 - 6), dh=-zn * s2 * (z21 + z23),
    )


def start(epoch_jd, e, i, node, w, m, n, rates, sidereal, xke) -> SimpleNamespace:
    """All that depends on the elements alone. rates: of mean anomaly, perigee and node; n: the mean motion, radians a minute."""
    sin_i, cos_i, sin_w, cos_w, sin_n, cos_n = np.sin(i), np.cos(i), np.sin(w), np.cos(w), np.sin(node), np.cos(node)
    day = epoch_jd - 2433281.5 + 18261.5
    node_m = np.mod(4.5236020 - 9.2422029e-4 * day, TWO_PI)
    ci = 0.91375164 - 0.03568096 * np.cos(node_m)
    si = np.sqrt(1 - ci * ci)
    sh = 0.089683511 * np.sin(node_m) / si
    ch = np.sqrt(1 - sh * sh)
    gam = 5.8351514 + 0.0019443680 * day
    arg = gam + np.arctan2(0.39785416 * np.sin(node_m) / si, ch * np.cos(node_m) + 0.91744867 * sh * np.sin(node_m)) - node_m
    sun = _pull(SUN, (SUN_ORBIT[2], SUN_ORBIT[3], SUN_ORBIT[1], SUN_ORBIT[0], cos_n, sin_n), e, sin_i, cos_i, sin_w, cos_w, n)
    moon = _pull(MOON, (np.cos(arg), np.sin(arg), ci, si, ch * cos_n + sh * sin_n, sin_n * ch - cos_n * sh), e, sin_i, cos_i, sin_w, cos_w, n)
    d = SimpleNamespace(sun=sun, moon=moon, w=w, wdot=rates[1], n=n)
    d.phase_m, d.phase_s = np.mod(4.7199672 + 0.22997150 * day - gam, TWO_PI), np.mod(6.2565837 + 0.017201977 * day, TWO_PI)
    flat = (i < 5.2359877e-2) | (i > np.pi - 5.2359877e-2)
    over = np.where(sin_i == 0, 1.0, sin_i)
    dh = np.where(flat, 0.0, (sun.dh + moon.dh) / over)
    d.de, d.di, d.dm, d.dnode = sun.de + moon.de, sun.di + moon.di, sun.dm + moon.dm, dh
    d.dw = sun.dg + moon.dg - cos_i * dh
    d.theta = sidereal(epoch_jd)
    _resonance(d, e, sin_i, cos_i, node, w, m, rates, xke)
    return d


def _poly(x, *c):
    return sum(k * x**p for p, k in enumerate(c))


def _resonance(d, e, s, c, node, w, m, rates, xke) -> None:
    n, e2 = d.n, e * e
    d.once = (n > 0.0034906585) & (n < 0.0052359877)
    d.twice = (n >= 8.26e-3) & (n <= 9.24e-3) & (e >= 0.5)
    a = (n / xke) ** (2 / 3)  # the inverse of the axis
    base = 3 * n * n * a * a
    f220 = 0.75 * (1 + c) ** 2
    f311, f330 = 0.9375 * s * s * (1 + 3 * c) - 0.75 * (1 + c), 1.875 * (1 + c) ** 3
    g200, g310, g300 = 1 + e2 * (-2.5 + 0.8125 * e2), 1 + 2 * e2, 1 + e2 * (-6 + 6.60937 * e2)
    d.del1, d.del2, d.del3 = base * f311 * g310 * ONCE[0][0] * a, 2 * base * f220 * g200 * ONCE[1][0], 3 * base * f330 * g300 * ONCE[2][0] * a
    # fixed values: the eccentricity functions, by ranges of the eccentricity
    low = e <= 0.65
    g201 = -0.306 - (e - 0.64) * 0.440
    g211 = np.where(low, _poly(e, 3.616, -13.2470, 16.2900), _poly(e, -72.099, 331.819, -508.738, 266.724))
    g310 = np.where(low, _poly(e, -19.302, 117.3900, -228.4190, 156.5910), _poly(e, -346.844, 1582.851, -2415.925, 1246.113))
    g322 = np.where(low, _poly(e, -18.9068, 109.7927, -214.6334, 146.5816), _poly(e, -342.585, 1554.908, -2366.899, 1215.972))
    g410 = np.where(low, _poly(e, -41.122, 242.6940, -471.0940, 313.9530), _poly(e, -1052.797, 4758.686, -7193.992, 3651.957))
    g422 = np.where(low, _poly(e, -146.407, 841.8800, -1629.014, 1083.4350), _poly(e, -3581.690, 16178.110, -24462.770, 12422.520))
    high = np.where(e > 0.715, _poly(e, -5149.66, 29936.92, -54087.36, 31324.56), _poly(e, 1464.74, -4664.75, 3763.64))
    g520 = np.where(low, _poly(e, -532.114, 3017.977, -5740.032, 3708.2760), high)
    low = e < 0.7
    g533 = np.where(low, _poly(e, -919.22770, 4988.6100, -9064.7700, 5542.21), _poly(e, -37995.780, 161616.52, -229838.20, 109377.94))
    g521 = np.where(low, _poly(e, -822.71072, 4568.6173, -8491.4146, 5337.524), _poly(e, -51752.104, 218913.95, -309468.16, 146349.42))
    g532 = np.where(low, _poly(e, -853.66600, 4690.2500, -8624.7700, 5341.4), _poly(e, -40023.880, 170470.89, -242699.48, 115605.82))
    # fixed values: the inclination functions
    s2, c2 = s * s, c * c
    f220, f221 = 0.75 * (1 + 2 * c + c2), 1.5 * s2
    f321, f322 = 1.875 * s * (1 - 2 * c - 3 * c2), -1.875 * s * (1 + 2 * c - 3 * c2)
    f441, f442 = 35 * s2 * f220, 39.3750 * s2 * s2
    f522 = 9.84375 * s * (s2 * (1 - 2 * c - 5 * c2) + 0.33333333 * (-2 + 4 * c + 6 * c2))
    f523 = s * (4.92187512 * s2 * (-2 - 4 * c + 10 * c2) + 6.56250012 * (1 + 2 * c - 3 * c2))
    f542 = 29.53125 * s * (2 - 8 * c + c2 * (-12 + 8 * c + 10 * c2))
    f543 = 29.53125 * s * (-2 - 8 * c + c2 * (12 + 8 * c - 10 * c2))
    b3, b4, b5 = base * a, base * a * a, base * a**3
    # (strength, multiple of the perigee's argument, multiple of the longitude, phase)
    d.terms = [
        (base * ROOT22 * f220 * g201, 2, 1, G22), (base * ROOT22 * f221 * g211, 0, 1, G22), (b3 * ROOT32 * f321 * g310, 1, 1, G32), (b3 * ROOT32 * f322 * g322, -1, 1, G32),
        (2 * b4 * ROOT44 * f441 * g410, 2, 2, G44), (2 * b4 * ROOT44 * f442 * g422, 0, 2, G44), (b5 * ROOT52 * f522 * g520, 1, 1, G52), (b5 * ROOT52 * f523 * g532, -1, 1, G52),
        (2 * b5 * ROOT54 * f542 * g521, 1, 2, G54), (2 * b5 * ROOT54 * f543 * g533, -1, 2, G54),
    ]
    mdot, wdot, nodedot = rates
    once = mdot + wdot + nodedot - ROTATION + d.dm + d.dw + d.dnode - n
    twice = mdot + d.dm + 2 * (nodedot + d.dnode - ROTATION) - n
    d.drift = np.where(d.once, once, twice)
    d.longitude = np.mod(np.where(d.once, m + node + w - d.theta, m + 2 * node - 2 * d.theta), TWO_PI)


def _slopes(d, li, ni, at):
    """(rate of the longitude, rate of the mean motion, its rate)."""
    rate = ni + d.drift
    x = [(d.del1, 1, li - ONCE[0][1]), (d.del2, 2, 2 * (li - ONCE[1][1])), (d.del3, 3, 3 * (li - ONCE[2][1]))]
    n1, n2 = sum(k * np.sin(u) for k, _, u in x), sum(p * k * np.cos(u) for k, p, u in x)
    if d.twice.any():
        w = d.w + d.wdot * at
        y = [(k, q, p * w + q * li - g) for k, p, q, g in d.terms]
        n1 = np.where(d.twice, sum(k * np.sin(u) for k, _, u in y), n1)
        n2 = np.where(d.twice, sum(q * k * np.cos(u) for k, q, u in y), n2)
    return rate, n1, n2 * rate


def secular(d, t, e, i, node, w, m):
    """(e, i, node, w, m, n, ok) after the secular pull and the resonance, t minutes from the epoch."""
    e, i, node, w, m = e + d.de * t, i + d.di * t, node + d.dnode * t, w + d.dw * t, m + d.dm * t
    resonant = d.once | d.twice
    ok = ~resonant | (np.abs(t) <= FARTHEST)
    n = d.n + 0 * t
    if (resonant & ok).any():
        at, li, ni = np.zeros_like(t), d.longitude + 0 * t, d.n + 0 * t
        goal, step = np.where(resonant & ok, t, 0.0), np.where(t > 0, STEP, -STEP)
        while (far := np.abs(goal - at) >= STEP).any():
            rate, n1, n2 = _slopes(d, li, ni, at)
            li = np.where(far, li + rate * step + n1 * STEP * STEP / 2, li)
            ni = np.where(far, ni + n1 * step + n2 * STEP * STEP / 2, ni)
            at = np.where(far, at + step, at)
        rate, n1, n2 = _slopes(d, li, ni, at)
        rest = goal - at
        theta = np.mod(d.theta + t * ROTATION, TWO_PI)
        longitude = li + rate * rest + n1 * rest * rest / 2
        n = np.where(resonant, ni + n1 * rest + n2 * rest * rest / 2, n)
        m = np.where(d.once, longitude - node - w + theta, np.where(d.twice, longitude - 2 * node + 2 * theta, m))
    return e, i, node, w, m, n, ok


def periodic(d, t, e, i, node, w, m):
    """(e, i, node, w, m) with the periodic pull of sun and moon; at small inclinations by Lyddane's form."""
    pe = pi = pl = pg = ph = 0.0
    for body, phase, k in ((SUN, d.phase_s, d.sun), (MOON, d.phase_m, d.moon)):
        zm = phase + body[1] * t
        zf = zm + 2 * body[0] * np.sin(zm)
        f1 = np.sin(zf)
        f2, f3 = 0.5 * f1 * f1 - 0.25, -0.5 * f1 * np.cos(zf)
        pe, pi, ph = pe + k.e[0] * f2 + k.e[1] * f3, pi + k.i[0] * f2 + k.i[1] * f3, ph + k.h[0] * f2 + k.h[1] * f3
        pl, pg = pl + k.l[0] * f2 + k.l[1] * f3 + k.l[2] * f1, pg + k.g[0] * f2 + k.g[1] * f3 + k.g[2] * f1
    e, i = e + pe, i + pi
    s, c = np.sin(i), np.cos(i)
    direct = i >= 0.2
    over = ph / np.where(direct, s, 1.0)
    # Lyddane
    sn, cn = np.sin(node), np.cos(node)
    alpha, beta = s * sn + ph * cn + pi * c * sn, s * cn - ph * sn + pi * c * cn
    old = np.fmod(node, TWO_PI)
    total = m + w + c * old + pl + pg - pi * old * s
    new = np.arctan2(alpha, beta)
    new = np.where(np.abs(old - new) > np.pi, np.where(new < old, new + TWO_PI, new - TWO_PI), new)
    m = m + pl
    w = np.where(direct, w + pg - c * over, total - m - c * new)
    node = np.where(direct, node + over, new)
    below = i < 0
    return e, np.where(below, -i, i), np.where(below, node + np.pi, node), np.where(below, w - np.pi, w), m
