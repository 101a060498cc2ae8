"""Queries over recurrences."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cadenza.operators import recurrences as R
from cadenza.plans._register import SERIES, query, r6
from cadenza.sources import tables as S

ORDER, STEP = 4, 0.05


def projection_sql() -> str:
    """The same recurrence as a recursive query, a column for each coefficient."""
    a, b = R.bilinear(*R.legendre_memory(ORDER), STEP)
    first = ", ".join(f"{float(b[i])!r}::DOUBLE * v AS c{i}" for i in range(ORDER))
    later = ", ".join(" + ".join(f"{float(a[i, j])!r}::DOUBLE * p.c{j}" for j in range(ORDER)) + f" + {float(b[i])!r}::DOUBLE * s.v" for i in range(ORDER))
    shown = ", ".join(f"round(c{i}, 6) AS c{i}" for i in range(ORDER))
    return f"WITH RECURSIVE {SERIES}, p AS (SELECT series_id, t, {first} FROM s WHERE t = 0 UNION ALL SELECT s.series_id, s.t, {later} FROM p JOIN s ON s.series_id = p.series_id AND s.t = p.t + 1) SELECT series_id, t, {shown} FROM p"


@query("w20_projection_state", projection_sql())
def w20(spark, d):
    rows = R.linear_state(S.events_series(spark, d), *R.bilinear(*R.legendre_memory(ORDER), STEP))
    return rows.select("series_id", F.col("t").cast("long").alias("t"), *[r6(F.get("state", F.lit(i))).alias(f"c{i}") for i in range(ORDER)])


LOW, HIGH, RATE = 1.0, 6.0, 24.0


def _direct_form(cutoff: float, kind: str) -> tuple[float, float, float, float, float]:
    """b0, b1, b2, a1, a2 of the filter, from the cookbook formulas."""
    w = 2 * math.pi * cutoff / RATE
    alpha = math.sin(w) / (2 * math.sqrt(0.5))
    edge = 1 - math.cos(w) if kind == "low" else -(1 + math.cos(w))
    return tuple(x / (1 + alpha) for x in (abs(edge) / 2, edge, abs(edge) / 2, -2 * math.cos(w), 1 - alpha))


def band_pass_sql() -> str:
    """Both filters in the direct form, as one recursive query over the last two inputs and outputs."""
    step = lambda f, x: f"{f[0]!r}::DOUBLE * {x[0]} + {f[1]!r}::DOUBLE * {x[1]} + {f[2]!r}::DOUBLE * {x[2]} - ({f[3]!r}::DOUBLE) * {x[3]} - ({f[4]!r}::DOUBLE) * {x[4]}"
    high, low = _direct_form(LOW, "high"), _direct_form(HIGH, "low")
    y = step(high, ("s.v", "p.x", "p.x1", "p.y", "p.y1"))
    z = step(low, (f"({y})", "p.y", "p.y1", "p.z", "p.z1"))
    y0 = f"{high[0]!r}::DOUBLE * v"
    return f"WITH RECURSIVE {SERIES}, p AS (SELECT series_id, t, v AS x, 0.0::DOUBLE AS x1, {y0} AS y, 0.0::DOUBLE AS y1, {low[0]!r}::DOUBLE * {y0} AS z, 0.0::DOUBLE AS z1 FROM s WHERE t = 0 UNION ALL SELECT s.series_id, s.t, s.v, p.x, {y}, p.y, {z}, p.z FROM p JOIN s ON s.series_id = p.series_id AND s.t = p.t + 1) SELECT series_id, t, round(z, 6) + 0.0 AS v FROM p"


@query("w21_band_pass", band_pass_sql())
def w21(spark, d):
    return R.band_pass(S.events_series(spark, d), LOW, HIGH, RATE).select("series_id", F.col("t").cast("long").alias("t"), r6(F.col("v")).alias("v"))


@query("x15_beats")
def x15(spark, d):
    return R.beats(S.events_series(spark, d), 8)
