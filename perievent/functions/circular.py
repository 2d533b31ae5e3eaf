"""Angles, phases and coordinates as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI, TWO_PI = math.pi, 2 * math.pi


def circular_mean(theta: Column, low: float = 0.0, high: float = TWO_PI) -> Column:
    """Aggregate: the mean direction of angles on [low, high)."""
    turn = TWO_PI / (high - low)
    return F.pmod(F.atan2(F.avg(F.sin((theta - low) * turn)), F.avg(F.cos((theta - low) * turn))), F.lit(TWO_PI)) / turn + low


def angle_apart(x: Column) -> Column:
    """A difference of angles in degrees, on [0, 180]."""
    return F.least(F.abs(x), F.abs(x - 360), F.abs(x + 360))


def phase_unwrapped(phase: Column) -> Column:
    """Negative phases turned positive, positive ones counted from the other end: a run from 0 to 2 pi."""
    return F.when(phase < 0, -phase).when(phase > 0, TWO_PI - phase).otherwise(phase)


def phase_apart(d: Column) -> Column:
    """A difference of phases on [-pi, pi)."""
    return F.pmod(d + PI, F.lit(TWO_PI)) - PI


def rescaled(x: Column, old: tuple[float, float], new: tuple[float, float]) -> Column:
    return (x - old[0]) * (new[1] - new[0]) / (old[1] - old[0]) + new[0]


def spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """azimuth, elevation, radius of a point."""
    flat = F.sqrt(x * x + y * y)
    return F.atan2(y, x), F.atan2(z, flat), F.sqrt(x * x + y * y + z * z)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def theta_folded(theta: Column) -> Column:
    """An axis angle on (-pi/2, pi/2]."""
    t = F.pmod(theta, F.lit(PI))
    return F.when(t > PI / 2, t - PI).otherwise(t)


def double_gaussian(theta: Column, pref: Column, sigma: Column, r1: Column, r2: Column, offset: Column) -> Column:
    """A direction tuning curve: two wrapped bumps, 180 degrees apart."""
    bump = lambda d: F.exp(-F.pow(angle_apart(d), 2) / (2 * sigma * sigma))
    return offset + r1 * bump(F.pmod(theta - pref, F.lit(360.0))) + r2 * bump(F.pmod(theta + 180 - pref, F.lit(360.0)))


def von_mises(theta: Column, mu: Column, kappa: Column, scale: Column) -> Column:
    return scale * F.exp(kappa * (F.cos(F.radians(theta - mu)) - 1))
