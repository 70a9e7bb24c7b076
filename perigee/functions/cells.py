"""A tree of cells on the sphere: the six faces of a cube, each halved along both sides again and again.

Lines of equal angle divide a face, so cells of a level are alike in size. A cell is (level, face, i, j); its parent's i and j
are its own halved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The finest level: cells of about a fiftieth of a degree.
FINEST = 12
#: Radians by which covers are wider than asked, for rounding.
SLACK = 1e-7
#: Fixed signs: face f has axis f // 2, on its positive side if f is even.
_OTHER = ((1, 2), (2, 0), (0, 1))


def cell_of(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The face and the i and j at FINEST of a point that is not the centre; at coarser levels i and j are shifted right."""
    v = (x, y, z)
    axis = F.when((F.abs(x) >= F.abs(y)) & (F.abs(x) >= F.abs(z)), 0).when(F.abs(y) >= F.abs(z), 1).otherwise(2)
    pick = lambda order: F.when(axis == 0, v[order[0]]).when(axis == 1, v[order[1]]).otherwise(v[order[2]])
    main = pick((0, 1, 2))
    face = axis * 2 + F.when(main < 0, 1).otherwise(0)
    place = lambda side: F.greatest(F.lit(0), F.least(F.lit((1 << FINEST) - 1), F.floor((F.atan(side / F.abs(main)) / np.pi * 4 + 1) / 2 * (1 << FINEST)).cast("int")))
    return face, place(pick(tuple(o[0] for o in _OTHER))), place(pick(tuple(o[1] for o in _OTHER)))


def _vector(face: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Unit vectors of places s, t from -1 to 1 on a face."""
    out = np.empty((len(face), 3))
    rows, axis = np.arange(len(face)), face // 2
    other = np.array(_OTHER)[axis]
    out[rows, axis] = np.where(face % 2, -1.0, 1.0)
    out[rows, other[:, 0]], out[rows, other[:, 1]] = np.tan(s * np.pi / 4), np.tan(t * np.pi / 4)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((a * b).sum(axis=1), -1, 1))


def cover(centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, ...]:
    """(which, level, face, i, j): disjoint cells that cover the cap of each radius (radians) around each centre (unit vector).

    A cell that is wholly inside is taken as it is; one that is partly inside is halved, down to a level at which an edge is
    at most half the radius. So a cap has some tens of cells, whatever its size.
    """
    finest = np.clip(np.ceil(np.log2(np.pi / np.maximum(radii, 1e-9))), 0, FINEST)
    which, face = np.repeat(np.arange(len(radii)), 6), np.tile(np.arange(6), len(radii))
    i = j = np.zeros(len(which), np.int64)
    out, level = [], 0
    while len(which):
        at = lambda di, dj, i=i, j=j, face=face, n=1 << level: _vector(face, (i + di) / n * 2 - 1, (j + dj) / n * 2 - 1)
        middle = at(0.5, 0.5)
        reach = np.max([_angle(middle, at(di, dj)) for di in (0, 1) for dj in (0, 1)], axis=0)
        away = _angle(middle, centres[which])
        near = away <= radii[which] + reach + SLACK
        done = near & ((away + reach <= radii[which]) | (level >= finest[which]))
        out.append((which[done], np.full(done.sum(), level), face[done], i[done], j[done]))
        more = near & ~done
        which, face = np.repeat(which[more], 4), np.repeat(face[more], 4)
        i, j = np.repeat(i[more] * 2, 4) + np.tile([0, 0, 1, 1], more.sum()), np.repeat(j[more] * 2, 4) + np.tile([0, 1, 0, 1], more.sum())
        level += 1
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))
