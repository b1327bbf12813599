"""Predicates on times in seconds. Three conventions live side by side on purpose; they differ at the edges only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Times closer than this are the same time.
EPS = 1e-6


def contains(t_in: Column, t_out: Column, t: Column) -> Column:
    """Half open: t_in <= t < t_out, both moved down by EPS."""
    return (t >= t_in - EPS) & (t < t_out - EPS)


def holds(t_in: Column, t_out: Column, t: Column) -> Column:
    """Closed on both sides, widened by EPS: for kept spans."""
    return (t >= t_in - EPS) & (t <= t_out + EPS)


def covers(t_in: Column, t_out: Column, t: Column) -> Column:
    """Right side inclusive: for proposals."""
    return (t >= t_in - EPS) & (t < t_out + EPS)


def overlaps(a_in: Column, a_out: Column, b_in: Column, b_out: Column) -> Column:
    return (a_in < b_out - EPS) & (b_in < a_out - EPS)


def approx_eq(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= EPS


def tier_rank(tier: Column) -> Column:
    """optional 0, supporting 1, essential 2; anything else null."""
    return F.when(tier == "optional", 0).when(tier == "supporting", 1).when(tier == "essential", 2)


def trapezoid(t: Column, t_in: Column, t_out: Column, ease: float) -> Column:
    """Weight of a region at t: ramps of length ease on both sides, or the plain half-open interval."""
    if ease <= 0:
        return contains(t_in, t_out, t).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - (t_in - ease)) / ease, ((t_out + ease) - t) / ease))


def clock(seconds: Column) -> Column:
    """H:MM:SS.cc, never negative, half-even centiseconds."""
    cs = F.bround(F.greatest(seconds, F.lit(0.0)) * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)
