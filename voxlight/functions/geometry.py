"""Vectors, rotations and rays as column expressions; all stay inside the JVM.

Reflection vectors are (v0, v1, v2); the volume's axes are (z, y, x) and the map between
them is a swap: z from v0, y from v2, x from v1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Faces of the volume in the order in which ties are settled, with the axis each one cuts.
FACES = {"BACK": "x", "FRONT": "x", "TOP": "y", "BOT": "y", "LE": "z", "RI": "z"}


def dot(a: Sequence, b: Sequence) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def rotation(axis: Sequence[Column], cos: Column, sin: Column) -> list[list[Column]]:
    """The 3 x 3 matrix that turns about a unit axis by the angle with the given cosine and sine."""
    u, v, w = axis
    rest = 1 - cos
    return [
        [cos + u * u * rest, u * v * rest - w * sin, u * w * rest + v * sin],
        [u * v * rest + w * sin, cos + v * v * rest, v * w * rest - u * sin],
        [u * w * rest - v * sin, v * w * rest + u * sin, cos + w * w * rest],
    ]


def product(a: list[list], b: list[list]) -> list[list[Column]]:
    return [[dot(row, [b[k][j] for k in range(3)]) for j in range(3)] for row in a]


def orientation(axes: Sequence[Sequence], angles: Sequence[Column]) -> list[list[Column]]:
    """The goniometer's rotation from its axes and angles (radians) in the order phi, kappa, omega: omega times kappa times phi. Directions are turned back by it."""
    phi, kappa, omega = (rotation(axis, F.cos(w), F.sin(w)) for axis, w in zip(axes, angles, strict=True))
    return product(product(omega, kappa), phi)


def turn(m: list[list], v: Sequence) -> list[Column]:
    return [dot(row, v) for row in m]


def turn_back(m: list[list], v: Sequence) -> list[Column]:
    """By the transpose, which is a rotation's inverse."""
    return [dot([m[k][i] for k in range(3)], v) for i in range(3)]


def axis_angle(m: list[list]) -> tuple[list[Column], Column]:
    """The unit axis and angle of a rotation matrix; the axis is null where the angle is 0 or a half turn."""
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0][0] + m[1][1] + m[2][2] - 1) / 2)))
    twice = [m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]]
    norm = F.sqrt(dot(twice, twice))
    return [F.when(norm > 1e-12, t / norm) for t in twice], angle


def to_volume(v: Sequence[Column]) -> list[Column]:
    """(v0, v1, v2) to (z, y, x)."""
    return [v[0], v[2], v[1]]


def from_volume(m: Sequence[Column]) -> list[Column]:
    return [m[0], m[2], m[1]]


def angles(v: Sequence[Column]) -> tuple[Column, Column]:
    """(theta, phi) of an outgoing direction. Elevation counts down v2; directions with v1 > 0 lie beyond a quarter turn."""
    v0, v1, v2 = v
    up = F.atan(-v2 / F.sqrt(v0 * v0 + v1 * v1))
    theta = F.when(v1 < 0, up).when(v2 < 0, F.lit(3.141592653589793) - up).otherwise(F.lit(-3.141592653589793) - up)
    return theta, -F.atan(v0 / v1)


def direction(theta: Column, phi: Column) -> list[Column]:
    """The direction (v0, v1, v2) of two angles in radians."""
    return [F.cos(theta) * F.sin(phi), -F.cos(theta) * F.cos(phi), -F.sin(theta)]


def exit_face(origin: Sequence[Column], heading: Sequence[Column], shape: Sequence[Column]) -> Column:
    """The name of the face that a ray from origin leaves by; all in (z, y, x). The first of equal crossings in the order of FACES."""
    at = dict(zip("zyx", zip(origin, heading, shape, strict=True), strict=True))
    crossings = []
    for name, axis in FACES.items():
        o, d, n = at[axis]
        wall = n if name in ("FRONT", "BOT", "RI") else F.lit(0)
        t = F.when(d != 0, (wall - o) / d)
        crossings.append((name, F.when(t >= 0, t)))
    first = F.least(*(t for _, t in crossings))
    out = F.when(crossings[0][1] == first, crossings[0][0])
    for name, t in crossings[1:]:
        out = out.when(t == first, name)
    return out


def step_vector(face: Column, heading: Sequence[Column]) -> list[Column]:
    """(dz, dy, dx) of one step: 1 or -1 along the axis of the exit face."""
    z, y, x = heading
    along = F.abs(F.when(face.isin("LE", "RI"), z).when(face.isin("TOP", "BOT"), y).otherwise(x))
    return [z / along, y / along, x / along]


def step_count(face: Column, origin: Sequence[Column], shape: Sequence[Column], beyond: Column) -> Column:
    """Steps of a ray, its origin included. `beyond`: theta lies beyond a quarter turn, which is v1 > 0."""
    z, y, x = origin
    more = F.when(beyond, 1).otherwise(0)
    steps = F.when(face == "BACK", x + 1).when(face == "FRONT", shape[2] - x).when(face == "LE", z + 1)
    return steps.when(face == "RI", shape[0] - z + more).when(face == "TOP", y + 1).otherwise(shape[1] - y + more).cast("int")
