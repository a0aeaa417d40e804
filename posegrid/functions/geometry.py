"""Pose algebra as column expressions.

Rotations are arrays of nine doubles, row by row; translations arrays of three;
quaternions arrays of four with the scalar first. Everything is written out by
element, so that it stays inside generated code. Arguments are columns or names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import DEFAULT_CONVENTION, POSE_CONVENTIONS

CAM2WORLD, WORLD2CAM = POSE_CONVENTIONS


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _e(a: Column | str, n: int) -> list[Column]:
    return [F.get(_c(a), F.lit(i)) for i in range(n)]


def _array(*xs: Column) -> Column:
    return F.array(*xs)


def quat_to_rotation(q: Column | str) -> Column:
    """Rotation of a unit quaternion."""
    w, x, y, z = _e(q, 4)
    return _array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def norm(a: Column | str, n: int) -> Column:
    total = F.lit(0.0)
    for x in _e(a, n):
        total = total + x * x
    return F.sqrt(total)


def normalised(a: Column | str, n: int) -> Column:
    size = norm(a, n)
    return _array(*(x / size for x in _e(a, n)))


def rotation_to_quat(r: Column | str) -> Column:
    """Unit quaternion of a rotation, scalar part not negative.

    The largest of the four squared components decides which one is computed by a
    square root; each root stays inside its own branch.
    """
    m = _e(r, 9)
    trace = m[0] + m[4] + m[8]

    def four(of: Column, k: int) -> Column:
        s = F.sqrt(of) * 2.0
        parts = {
            0: (0.25 * s, (m[7] - m[5]) / s, (m[2] - m[6]) / s, (m[3] - m[1]) / s),
            1: ((m[7] - m[5]) / s, 0.25 * s, (m[1] + m[3]) / s, (m[2] + m[6]) / s),
            2: ((m[2] - m[6]) / s, (m[1] + m[3]) / s, 0.25 * s, (m[5] + m[7]) / s),
            3: ((m[3] - m[1]) / s, (m[2] + m[6]) / s, (m[5] + m[7]) / s, 0.25 * s),
        }
        return _array(*parts[k])

    raw = (
        F.when(trace > 0, four(trace + 1.0, 0))
        .when((m[0] > m[4]) & (m[0] > m[8]), four(1.0 + m[0] - m[4] - m[8], 1))
        .when(m[4] > m[8], four(1.0 + m[4] - m[0] - m[8], 2))
        .otherwise(four(1.0 + m[8] - m[0] - m[4], 3))
    )
    size = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    sign = F.when(F.get(raw, F.lit(0)) < 0, -1.0).otherwise(1.0)
    return F.transform(raw, lambda x: sign * x / size)


def quat_branch(r: Column | str) -> Column:
    """Which of the four branches rotation_to_quat takes."""
    m = _e(r, 9)
    return F.when(m[0] + m[4] + m[8] > 0, 0).when((m[0] > m[4]) & (m[0] > m[8]), 1).when(m[4] > m[8], 2).otherwise(3)


def transposed(r: Column | str) -> Column:
    m = _e(r, 9)
    return _array(*(m[3 * c + row] for row in range(3) for c in range(3)))


def rotated(r: Column | str, t: Column | str) -> Column:
    """R t."""
    m, v = _e(r, 9), _e(t, 3)
    return _array(*(m[3 * k] * v[0] + m[3 * k + 1] * v[1] + m[3 * k + 2] * v[2] for k in range(3)))


def apply_se3(r: Column | str, t: Column | str, x: Column | str) -> Column:
    """R x + t."""
    return _array(*(a + b for a, b in zip(_e(rotated(r, x), 3), _e(t, 3))))


def apply_sim3(s: Column | str, r: Column | str, t: Column | str, x: Column | str) -> Column:
    """s R x + t."""
    return _array(*(_c(s) * a + b for a, b in zip(_e(rotated(r, x), 3), _e(t, 3))))


def inverse_translation(r: Column | str, t: Column | str) -> Column:
    """-R^T t."""
    m, v = _e(r, 9), _e(t, 3)
    return _array(*(-(m[k] * v[0] + m[3 + k] * v[1] + m[6 + k] * v[2]) for k in range(3)))


def flipped(convention: Column | str) -> Column:
    """The opposite pose convention; null for unknown ones."""
    convention = _c(convention)
    return F.when(convention == CAM2WORLD, WORLD2CAM).when(convention == WORLD2CAM, CAM2WORLD)


def identity() -> tuple[Column, Column, Column]:
    one = F.array(*(F.lit(1.0 if k % 4 == 0 else 0.0) for k in range(9)))
    return one, F.array(*(F.lit(0.0) for _ in range(3))), F.lit(DEFAULT_CONVENTION)


def se3_inverse(r: Column | str, t: Column | str, convention: Column | str) -> tuple[Column, Column, Column]:
    """Inverse pose; its convention is the opposite one."""
    return transposed(r), inverse_translation(r, t), flipped(convention)


def as_convention(r: Column | str, t: Column | str, convention: Column | str, wanted: str) -> tuple[Column, Column, Column]:
    """The same pose in the wanted convention."""
    r, t, same = _c(r), _c(t), _c(convention) == wanted
    pick = lambda a, b, n: _array(*(F.when(same, x).otherwise(y) for x, y in zip(_e(a, n), _e(b, n))))
    return pick(r, transposed(r), 9), pick(t, inverse_translation(r, t), 3), F.lit(wanted)


def se3_matrix(r: Column | str, t: Column | str) -> Column:
    """Homogeneous 4 x 4 matrix, row by row."""
    m, v = _e(r, 9), _e(t, 3)
    rows = [x for k in range(3) for x in (*m[3 * k : 3 * k + 3], v[k])]
    return _array(*rows, *(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)))


def sim3_matrix(s: Column | str, r: Column | str, t: Column | str) -> Column:
    s, m, v = _c(s), _e(r, 9), _e(t, 3)
    rows = [x for k in range(3) for x in (*(s * y for y in m[3 * k : 3 * k + 3]), v[k])]
    return _array(*rows, *(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)))


def sim3_inverse(s: Column | str, r: Column | str, t: Column | str, convention: Column | str) -> tuple[Column, Column, Column, Column]:
    """1/s, R^T, -(1/s) R^T t, opposite convention."""
    s, back = _c(s), inverse_translation(r, t)
    return 1.0 / s, transposed(r), _array(*((1.0 / s) * x for x in _e(back, 3))), flipped(convention)


def from_world2cam(q: Column | str, t: Column | str, convention: str = DEFAULT_CONVENTION) -> tuple[Column, Column, Column]:
    """Pose of a world-to-camera quaternion and translation; as cam-to-world its translation is the camera centre."""
    return as_convention(quat_to_rotation(normalised(q, 4)), t, F.lit(WORLD2CAM), convention)


def to_world2cam(r: Column | str, t: Column | str, convention: Column | str) -> tuple[Column, Column]:
    """World-to-camera quaternion and translation of a pose."""
    r2, t2, _ = as_convention(r, t, convention, WORLD2CAM)
    return rotation_to_quat(r2), t2


def orthonormal_error(r: Column | str) -> Column:
    """Largest absolute element of R R^T - I."""
    m = _e(r, 9)
    parts = []
    for a in range(3):
        for b in range(a, 3):
            dot = m[3 * a] * m[3 * b] + m[3 * a + 1] * m[3 * b + 1] + m[3 * a + 2] * m[3 * b + 2]
            parts.append(F.abs(dot - (1.0 if a == b else 0.0)))
    return F.greatest(*parts)


def determinant(r: Column | str) -> Column:
    m = _e(r, 9)
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
