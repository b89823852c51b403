"""sRGB (D65) to CIELAB and back, as column expressions on doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from glintframe.functions.scalar import clip, col

# The public 8-digit sRGB/D65 matrices and the CIE constants.
_TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
_TO_RGB = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
_WHITE = (0.950456, 1.0, 1.088754)
_EPS, _KAPPA, _SLOPE, _OFFSET = 0.008856, 903.3, 7.787, 16.0 / 116.0


def _linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def _companded(v: Column) -> Column:
    return F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1.0 / 2.4)) - 0.055)


def _dot(row, values):
    return sum((c * v for c, v in zip(row[1:], values[1:])), row[0] * values[0])


def rgb_to_lab(r, g, b) -> tuple[Column, Column, Column]:
    rgb = [_linear(col(c)) for c in (r, g, b)]
    x, y, z = (_dot(row, rgb) / white for row, white in zip(_TO_XYZ, _WHITE))
    f = lambda t: F.when(t > _EPS, F.cbrt(t)).otherwise(_SLOPE * t + _OFFSET)
    light = F.when(y > _EPS, 116.0 * F.cbrt(y) - 16.0).otherwise(_KAPPA * y)
    return light, 500.0 * (f(x) - f(y)), 200.0 * (f(y) - f(z))


def lab_to_rgb(light, a, b) -> tuple[Column, Column, Column]:
    l_ = col(light)
    y = F.when(l_ <= _EPS * _KAPPA, l_ / _KAPPA).otherwise(F.pow((l_ + 16.0) / 116.0, F.lit(3.0)))
    fy = F.when(l_ <= _EPS * _KAPPA, _SLOPE * (l_ / _KAPPA) + _OFFSET).otherwise((l_ + 16.0) / 116.0)
    back = lambda f: F.when(f <= _SLOPE * _EPS + _OFFSET, (f - _OFFSET) / _SLOPE).otherwise(F.pow(f, F.lit(3.0)))
    xyz = (back(fy + col(a) / 500.0) * _WHITE[0], y, back(fy - col(b) / 200.0) * _WHITE[2])
    return tuple(clip(_companded(clip(_dot(row, xyz)))) for row in _TO_RGB)


def delta_e76(first, second) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(map(col, first), map(col, second))), F.lit(0.0)))
