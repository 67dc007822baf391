"""Draws that are a function of (seed, replicate, cell, index): the same under any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SEED

M = 2_147_483_647


def draw(rep: Column, cell: Column, i: Column, seed: int = SEED) -> Column:
    """An integer in [0, M); every intermediate fits a long."""
    x = (rep.cast("long") * 7919 + cell.cast("long") * 104729 + i.cast("long") * 1299709 + F.lit(seed)) % F.lit(M)
    y = (x * 48271) % F.lit(M)
    return (y * y + x * 69621) % F.lit(M)


def uniform(rep: Column, cell: Column, i: Column, seed: int = SEED) -> Column:
    """In (0, 1)."""
    return (draw(rep, cell, i, seed) + 0.5) / float(M)


def gaussian(rep: Column, cell: Column, i: Column, seed: int = SEED) -> Column:
    """Standard normal, by Box and Muller from two draws."""
    return F.sqrt(-2.0 * F.ln(uniform(rep, cell, i * 2, seed))) * F.cos(2 * math.pi * uniform(rep, cell, i * 2 + 1, seed))
