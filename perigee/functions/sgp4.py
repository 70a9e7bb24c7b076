"""SGP4 (Hoots and Roehrich 1980; Vallado et al. 2006, AIAA 2006-6753), over arrays of objects and times.

Gravity constants are those of WGS-72. Periods of 225 minutes or more get the deep-space terms of sdp4.
"""

from __future__ import annotations

import numpy as np

from . import sdp4

#: WGS-72.
MU, RADIUS, J2, J3, J4 = 398600.8, 6378.135, 0.001082616, -0.00000253881, -0.00000165597
XKE = 60.0 / np.sqrt(RADIUS**3 / MU)
#: The WGS-84 ellipsoid.
A84, F84 = 6378.137, 1 / 298.257223563


#: Minutes of a period from which an object is in deep space.
DEEP = 225.0


def propagate(minutes, bstar, ecc, incl, node, argp, mean, no_kozai, epoch_jd):
    """TEME position (km), velocity (km/s) and whether it went well; angles in radians, no_kozai in radians a minute."""
    with np.errstate(all="ignore"):
        given = np.broadcast_arrays(*(np.asarray(x, float) for x in (minutes, bstar, ecc, incl, node, argp, mean, no_kozai, epoch_jd)))
        position, velocity, ok = _propagate(*(np.ravel(x) for x in given))
    shape = given[0].shape
    return [x.reshape(shape) for x in position], [x.reshape(shape) for x in velocity], ok.reshape(shape)


def propagate_grid(minutes, *elements):
    """As propagate, for objects (elements, one number each) at several times (minutes, a row an object): elements are initialised
    once an object. Those that may be in deep space are worked out time by time."""
    minutes, elements = np.asarray(minutes, float), [np.asarray(x, float) for x in elements]
    position, velocity, ok = np.full((3, *minutes.shape), np.nan), np.full((3, *minutes.shape), np.nan), np.zeros(minutes.shape, bool)
    with np.errstate(all="ignore"):
        near = 2 * np.pi / elements[6] < 0.98 * DEEP
        if near.any():
            position[:, near], velocity[:, near], ok[near] = _propagate(minutes[near], *[x[near, None] for x in elements])
        if not near.all():
            position[:, ~near], velocity[:, ~near], ok[~near] = propagate(minutes[~near], *[x[~near, None] for x in elements])
    return list(position), list(velocity), ok


def _propagate(t, bstar, e0, i0, node0, w0, m0, n_kozai, epoch_jd):
    k2, cosi, sini = J2 / 2, np.cos(i0), np.sin(i0)
    theta2 = cosi * cosi
    x3m1, x1m, x7m1 = 3 * theta2 - 1, 1 - theta2, 7 * theta2 - 1
    beta2 = 1 - e0 * e0
    beta = np.sqrt(beta2)
    # mean motion and axis without the J2 part of the given mean motion
    a1 = (XKE / n_kozai) ** (2 / 3)
    d = 1.5 * k2 * x3m1 / (beta * beta2)
    d1 = d / (a1 * a1)
    a0 = a1 * (1 - d1 * d1 - d1 * (1 / 3 + 134 * d1 * d1 / 81))
    d0 = d / (a0 * a0)
    n0 = n_kozai / (1 + d0)
    a = (XKE / n0) ** (2 / 3)
    perigee_er = a * (1 - e0)
    perigee = (perigee_er - 1) * RADIUS
    # drag
    s4 = np.where(perigee < 156, np.where(perigee < 98, 20.0, perigee - 78), 78.0)
    qzms = np.where(perigee < 156, ((120 - s4) / RADIUS) ** 4, ((120 - 78) / RADIUS) ** 4)
    s4 = s4 / RADIUS + 1
    ao = a
    xi = 1 / (ao - s4)
    eta = ao * e0 * xi
    eta2, eeta = eta * eta, e0 * eta
    psi2 = np.abs(1 - eta2)
    coef = qzms * xi**4
    coef1 = coef / psi2**3.5
    c2 = coef1 * n0 * (ao * (1 + 1.5 * eta2 + eeta * (4 + eta2)) + 0.375 * J2 * xi / psi2 * x3m1 * (8 + 3 * eta2 * (8 + eta2)))
    c1 = bstar * c2
    c3 = np.where(e0 > 1e-4, -2 * coef * xi * (J3 / J2) * n0 * sini / np.where(e0 > 1e-4, e0, 1), 0.0)
    c4 = 2 * n0 * coef1 * ao * beta2 * (eta * (2 + 0.5 * eta2) + e0 * (0.5 + 2 * eta2) - J2 * xi / (ao * psi2) * (-3 * x3m1 * (1 - 2 * eeta + eta2 * (1.5 - 0.5 * eeta)) + 0.75 * x1m * (2 * eta2 - eeta * (1 + eta2)) * np.cos(2 * w0)))
    c5 = 2 * coef1 * ao * beta2 * (1 + 2.75 * (eta2 + eeta) + eeta * eta2)
    p2 = 1 / (ao * beta2) ** 2
    t1, t2 = 1.5 * J2 * p2 * n0, 0.5 * 1.5 * J2 * p2 * n0 * J2 * p2
    t3 = -0.46875 * J4 * p2 * p2 * n0
    theta4 = theta2 * theta2
    mdot = n0 + 0.5 * t1 * beta * x3m1 + 0.0625 * t2 * beta * (13 - 78 * theta2 + 137 * theta4)
    wdot = -0.5 * t1 * (1 - 5 * theta2) + 0.0625 * t2 * (7 - 114 * theta2 + 395 * theta4) + t3 * (3 - 36 * theta2 + 49 * theta4)
    h1 = -t1 * cosi
    nodedot = h1 + (0.5 * t2 * (4 - 19 * theta2) + 2 * t3 * (3 - 7 * theta2)) * cosi
    wcof = bstar * c3 * np.cos(w0)
    mcof = np.where(e0 > 1e-4, -2 / 3 * coef * bstar / np.where(eeta != 0, eeta, 1), 0.0)
    nodecf = 3.5 * beta2 * h1 * c1
    delmo = (1 + eta * np.cos(m0)) ** 3
    deep = (2 * np.pi / n0 >= DEEP) & (e0 < 1)
    simple = (perigee_er < 220 / RADIUS + 1) | deep
    d2 = 4 * ao * xi * c1 * c1
    temp = d2 * xi * c1 / 3
    d3 = (17 * ao + s4) * temp
    d4 = 0.5 * temp * ao * xi * (221 * ao + 31 * s4) * c1
    l3, l4 = d2 + 2 * c1 * c1, 0.25 * (3 * d3 + c1 * (12 * d2 + 10 * c1 * c1))
    l5 = 0.2 * (3 * d4 + 12 * c1 * d3 + 6 * d2 * d2 + 15 * c1 * c1 * (2 * d2 + c1 * c1))
    # secular terms
    m, w = m0 + mdot * t, w0 + wdot * t
    node = node0 + nodedot * t + nodecf * t * t
    tempa, tempe, templ = 1 - c1 * t, bstar * c4 * t, 1.5 * c1 * t * t
    delm = mcof * ((1 + eta * np.cos(m)) ** 3 - delmo)
    both = np.where(simple, 0.0, wcof * t + delm)
    m2, w = m + both, w - both
    tempa = tempa - np.where(simple, 0.0, d2 * t**2 + d3 * t**3 + d4 * t**4)
    tempe = tempe + np.where(simple, 0.0, bstar * c5 * (np.sin(m2) - np.sin(m0)))
    templ = templ + np.where(simple, 0.0, l3 * t**3 + t**4 * (l4 + t * l5))
    e, inc, n, ok = e0.copy(), i0.copy(), n0.copy(), np.ones(t.shape, bool)
    far = np.flatnonzero(deep)
    if len(far):
        own = lambda *x: [y[far] for y in x]
        terms = sdp4.start(*own(epoch_jd, e0, i0, node0, w0, m0, n0), own(mdot, wdot, nodedot), sidereal, XKE)
        e[far], inc[far], node[far], w[far], m2[far], n[far], ok[far] = sdp4.secular(terms, *own(t, e, inc, node, w, m2))
    am = (XKE / n) ** (2 / 3) * tempa * tempa
    n = XKE / am**1.5
    e = e - tempe
    ok &= (e < 1) & (e > -0.001) & (am > 0.95) & (e0 < 1) & (n0 > 0)
    e = np.maximum(e, 1e-6)
    m2 = m2 + n0 * templ
    if len(far):
        e[far], inc[far], node[far], w[far], m2[far] = sdp4.periodic(terms, *own(t, e, inc, node, w, m2))
        ok &= (e >= 0) & (e <= 1)
        cosi, sini = np.cos(inc), np.sin(inc)
        theta2 = cosi * cosi
        x3m1, x1m, x7m1 = 3 * theta2 - 1, 1 - theta2, 7 * theta2 - 1
    lcof = -0.25 * (J3 / J2) * sini * (3 + 5 * cosi) / np.where(np.abs(1 + cosi) > 1.5e-12, 1 + cosi, 1.5e-12)
    aycof = -0.5 * (J3 / J2) * sini
    # long-period terms and Kepler's equation
    axn = e * np.cos(w)
    inv = 1 / (am * (1 - e * e))
    ayn = e * np.sin(w) + inv * aycof
    u = np.mod(m2 + w + inv * lcof * axn, 2 * np.pi)
    eo = u.copy()
    for _ in range(10):
        s, c = np.sin(eo), np.cos(eo)
        eo = eo + np.clip((u - ayn * c + axn * s - eo) / (1 - c * axn - s * ayn), -0.95, 0.95)
    s, c = np.sin(eo), np.cos(eo)
    ecose, esine, el2 = axn * c + ayn * s, axn * s - ayn * c, axn * axn + ayn * ayn
    pl = am * (1 - el2)
    ok &= pl >= 0
    r = am * (1 - ecose)
    rdot, rvdot = np.sqrt(am) * esine / r, np.sqrt(np.maximum(pl, 0)) / r
    betal = np.sqrt(np.maximum(1 - el2, 0))
    temp = esine / (1 + betal)
    sinu, cosu = am / r * (s - ayn - axn * temp), am / r * (c - axn + ayn * temp)
    su = np.arctan2(sinu, cosu)
    sin2u, cos2u = 2 * cosu * sinu, 1 - 2 * sinu * sinu
    # short-period terms
    q1, q2 = 0.5 * J2 / pl, 0.5 * J2 / pl / pl
    mr = r * (1 - 1.5 * q2 * betal * x3m1) + 0.5 * q1 * x1m * cos2u
    su = su - 0.25 * q2 * x7m1 * sin2u
    nk, ik = node + 1.5 * q2 * cosi * sin2u, inc + 1.5 * q2 * cosi * sini * cos2u
    mv, rv = rdot - n * q1 * x1m * sin2u / XKE, rvdot + n * q1 * (x1m * cos2u + 1.5 * x3m1) / XKE
    ok &= mr >= 1
    ss, cs, sn, cn, si, ci = np.sin(su), np.cos(su), np.sin(nk), np.cos(nk), np.sin(ik), np.cos(ik)
    ux, uy, uz = -sn * ci * ss + cn * cs, cn * ci * ss + sn * cs, si * ss
    vx, vy, vz = -sn * ci * cs - cn * ss, cn * ci * cs - sn * ss, si * cs
    speed = RADIUS * XKE / 60
    position = [mr * x * RADIUS for x in (ux, uy, uz)]
    velocity = [(mv * x + rv * y) * speed for x, y in ((ux, vx), (uy, vy), (uz, vz))]
    ok &= np.isfinite(sum(position)) & np.isfinite(sum(velocity))
    return position, velocity, ok


def sidereal(jd):
    """Greenwich sidereal time in radians (IAU 1982)."""
    t = (jd - 2451545.0) / 36525.0
    seconds = -6.2e-6 * t**3 + 0.093104 * t**2 + (876600.0 * 3600 + 8640184.812866) * t + 67310.54841
    return np.mod(np.radians(seconds / 240.0), 2 * np.pi)


def geodetic(x, y, z, gmst):
    """Latitude and longitude in degrees and altitude in km over the ellipsoid."""
    r, e2 = np.hypot(x, y), 2 * F84 - F84 * F84
    lon = np.mod(np.arctan2(y, x) - gmst + np.pi, 2 * np.pi) - np.pi
    lat, c = np.arctan2(z, r), np.ones_like(r)
    for _ in range(20):
        c = 1 / np.sqrt(1 - e2 * np.sin(lat) ** 2)
        lat = np.arctan2(z + A84 * c * e2 * np.sin(lat), r)
    return np.degrees(lat), np.degrees(lon), r / np.cos(lat) - A84 * c
