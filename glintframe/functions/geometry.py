"""Rotations and poses as columns. A rotation is a unit quaternion ``w, x, y, z``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from glintframe.functions.scalar import clip, col

Quat = tuple


def quat(prefix: str) -> Quat:
    return tuple(F.col(f"{prefix}{c}") for c in "wxyz")


def quat_product(p: Quat, q: Quat) -> Quat:
    pw, px, py, pz = p
    qw, qx, qy, qz = q
    return (pw * qw - px * qx - py * qy - pz * qz, pw * qx + px * qw + py * qz - pz * qy,
            pw * qy - px * qz + py * qw + pz * qx, pw * qz + px * qy - py * qx + pz * qw)


def quat_conjugate(q: Quat) -> Quat:
    return (q[0], -q[1], -q[2], -q[3])


def quat_dot(p: Quat, q: Quat) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2] + p[3] * q[3]


def quat_unit(q: Quat) -> Quat:
    size = F.sqrt(quat_dot(q, q))
    return tuple(c / size for c in q)


def quat_midpoint(p: Quat, q: Quat) -> Quat:
    """Geodesic halfway rotation: the normalised sum, on the shorter arc."""
    sign = F.when(quat_dot(p, q) < 0, -1.0).otherwise(1.0)
    return quat_unit(tuple(a + sign * b for a, b in zip(p, q)))


def quat_angle_deg(p: Quat, q: Quat) -> Column:
    """Angle of the rotation that takes ``p`` to ``q``."""
    return 2.0 * F.degrees(F.acos(clip(F.abs(quat_dot(p, q)))))


def quat_matrix(q: Quat) -> list[list[Column]]:
    w, x, y, z = q
    return [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
            [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
            [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]


def quat_axis_z(q: Quat) -> list[Column]:
    """Viewing direction: third column of the rotation matrix."""
    return [row[2] for row in quat_matrix(q)]


def matrix_quat(m) -> Quat:
    """Quaternion of a rotation given as nested array column or 3x3 columns (non-negative w)."""
    e = (lambda i, j: m[i][j]) if isinstance(m, list) else (lambda i, j: col(m)[i][j])
    half = lambda v: 0.5 * F.sqrt(F.greatest(F.lit(0.0), v))
    size = [half(1 + e(0, 0) + e(1, 1) + e(2, 2)), half(1 + e(0, 0) - e(1, 1) - e(2, 2)),
            half(1 - e(0, 0) + e(1, 1) - e(2, 2)), half(1 - e(0, 0) - e(1, 1) + e(2, 2))]
    # divide by the largest component: each case gives all four up to sign
    top = F.greatest(*size)
    q4 = lambda a, b: (a + b) / (4.0 * top)
    d4 = lambda a, b: (a - b) / (4.0 * top)
    cases = [(size[0], d4(e(2, 1), e(1, 2)), d4(e(0, 2), e(2, 0)), d4(e(1, 0), e(0, 1))),
             (d4(e(2, 1), e(1, 2)), size[1], q4(e(0, 1), e(1, 0)), q4(e(0, 2), e(2, 0))),
             (d4(e(0, 2), e(2, 0)), q4(e(0, 1), e(1, 0)), size[2], q4(e(1, 2), e(2, 1))),
             (d4(e(1, 0), e(0, 1)), q4(e(0, 2), e(2, 0)), q4(e(1, 2), e(2, 1)), size[3])]
    pick = lambda k: F.when(size[0] == top, cases[0][k]).when(size[1] == top, cases[1][k]).when(size[2] == top, cases[2][k]).otherwise(cases[3][k])
    sign = F.when(pick(0) < 0, -1.0).otherwise(1.0)
    return tuple(sign * pick(k) for k in range(4))


def rotate(q: Quat, v) -> list[Column]:
    return [sum((a * col(b) for a, b in zip(row[1:], v[1:])), row[0] * col(v[0])) for row in quat_matrix(q)]


def transform_pose(centre, q: Quat, scale, turn: Quat, shift):
    """Similarity applied to a pose: turned rotation; scaled, turned and shifted centre."""
    moved = [col(scale) * c + col(t) for c, t in zip(rotate(turn, centre), shift)]
    return moved, quat_product(turn, q)


def inverse_pose(centre, q: Quat, scale, turn: Quat, shift):
    back = quat_conjugate(turn)
    return rotate(back, [(col(c) - col(t)) / col(scale) for c, t in zip(centre, shift)]), quat_product(back, q)
