"""Sphere points and scalar geometry."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PROBE, N_POINTS, N_SLICES = 1.4, 100, 20
NM_TO_ANGSTROM, SQUARE_ANGSTROM_TO_NM = 10.0, 0.01


def sphere_points(n: int) -> np.ndarray:
    """n unit vectors on a golden-angle spiral, from pole to pole; height and longitude add up step by step."""
    turn, drop = math.pi * (3 - math.sqrt(5)), 2.0 / n
    lon, z, out = 0.0, 1 - drop / 2, []
    for _ in range(n):
        r = math.sqrt(max(0.0, 1 - z * z))
        out.append((math.cos(lon) * r, math.sin(lon) * r, z))
        z -= drop
        lon += turn
    return np.array(out)


def sphere_area(r: Column) -> Column:
    return 4 * math.pi * r * r


def distance2(a: str, b: str) -> Column:
    """Squared distance between the points a_x, a_y, a_z and b_x, b_y, b_z."""
    d = [F.col(f"{a}_{k}") - F.col(f"{b}_{k}") for k in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
