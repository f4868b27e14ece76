"""Column expressions: rotations, squashing, levels, and exact text formatting. All run inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Quat = tuple[Column, Column, Column, Column]
Vec = tuple[Column, Column, Column]


def quat_normalize(q: Quat) -> Quat:
    """Unit quaternion, scalar first; a zero quaternion becomes the identity."""
    norm = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    return tuple(F.when(norm > 0, c / norm).otherwise(F.lit(one)) for c, one in zip(q, (1.0, 0.0, 0.0, 0.0), strict=True))


def quat_conjugate(q: Quat) -> Quat:
    return q[0], -q[1], -q[2], -q[3]


def quat_multiply(a: Quat, b: Quat) -> Quat:
    """Hamilton product."""
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return (
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    )


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(v: Vec) -> Column:
    return F.sqrt(dot(v, v))


def rotate(q: Quat, v: Vec) -> Vec:
    """``v`` turned by ``q``, which is normalised first: v + 2w(u x v) + 2u x (u x v)."""
    w, *u = quat_normalize(q)
    once = cross(tuple(u), v)
    twice = cross(tuple(u), once)
    return tuple(c + 2 * w * o + 2 * t for c, o, t in zip(v, once, twice, strict=True))


def rotate_inverse(q: Quat, v: Vec) -> Vec:
    return rotate(quat_conjugate(q), v)


#: The double nearest to ln 3; Spark's own logarithm is off by its last bit there.
LN3 = math.log(3.0)


def sigmoid(z: Column) -> Column:
    """Logistic function of z clipped to 30 either way."""
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def squash(deviation: Column, scale: float) -> Column:
    """100 at no deviation, 50 at ``scale``, towards 0 beyond; negative deviations count as none."""
    if scale <= 0:
        raise ValueError("scale must be positive")
    return 200 * (1 - 1 / (1 + F.exp(F.lit(-LN3) * F.greatest(deviation, F.lit(0.0)) / scale)))


def proximity(value: Column, target: Column | float, tolerance: float) -> Column:
    """100 on target, falling linearly to 0 at ``tolerance`` away."""
    if tolerance <= 0:
        raise ValueError("tolerance must be positive")
    target = target if isinstance(target, Column) else F.lit(target)
    return F.least(F.greatest(100 * (1 - F.abs(value - target) / tolerance), F.lit(0.0)), F.lit(100.0))


#: Reported effort: 6, 6.5, ... 10.
RPE_LEVELS = tuple(6.0 + 0.5 * k for k in range(9))


def level_index(rpe: Column) -> Column:
    """Place of the nearest level, the lower one on ties."""
    return F.least(F.greatest(F.ceil((rpe - 6.0) / 0.5 - 0.5), F.lit(0)), F.lit(8)).cast("int")


def round_half(x: Column) -> Column:
    """To the nearest half, halves of it to even."""
    return F.bround(2 * x, 0) / 2


def plain_number(x: Column) -> Column:
    """A number without trailing zeros, as C's %g has it for moderate values."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def signed_percent(x: Column) -> Column:
    """A share as a signed whole percentage, halves to even."""
    return F.format_string("%+d%%", F.bround(100 * x, 0).cast("long"))


def pmf_from_cumulative(at_most: Column) -> Column:
    """Probabilities of each level from P(y <= level), negative ones cut off, adding up to 1."""
    raw = F.transform(at_most, lambda p, i: F.greatest(p - F.when(i > 0, F.get(at_most, i - 1)).otherwise(F.lit(0.0)), F.lit(0.0)))
    return F.transform(raw, lambda p: p / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))


def expected(pmf: Column, levels: tuple[float, ...] = RPE_LEVELS) -> Column:
    return F.aggregate(F.zip_with(pmf, F.array(*[F.lit(x) for x in levels]), lambda p, x: p * x), F.lit(0.0), lambda a, b: a + b)


def first_argmax(values: Column) -> Column:
    """Place, from 0, of the first largest value."""
    return F.array_position(values, F.array_max(values)) - 1
