"""Multi-turn tracking, spiral sense, and seed patches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminar.operators.axis import asof, interpolated


def track(runs: DataFrame, bins: int, gate: float = 6.0, skips: int = 15, turns: int = 2, least: int = 10) -> DataFrame:
    """``gid, z, direction, seed, step, r``: tracks of up to ``turns`` turns through crossings ``gid, z, theta, r`` (angle bins).

    All crossings in the bin of an instance's mean angle (its first bin where it has none) are seeds, innermost first, and both directions are tried. A track
    takes in each bin the crossing nearest in radius (the inner one on ties); bins without one within ``gate`` are skipped, and
    more than ``skips`` in a row end it. Of each direction the first seed stays whose track reaches 1.03 turns and has ``least``
    steps beyond the first turn. Steps depend on each other, so the crossings of an instance in one slice are a group: its size
    is that of the rays of a slice, not of the table.
    """
    angle = F.col("theta") * F.lit(2 * np.pi / bins)
    at = runs.groupBy("gid", "z").agg(F.avg(F.sin(angle)).alias("s"), F.avg(F.cos(angle)).alias("c"), F.min("theta").alias("low"))
    near = F.pmod(F.round(F.atan2("s", "c") * bins / (2 * np.pi)).cast("long"), F.lit(bins))
    start = F.when(F.hypot("s", "c") < 1e-6, F.col("low")).otherwise(near).alias("start")
    held = runs.join(at.select("gid", "z", start), ["gid", "z"]).select("gid", "z", "theta", "r", "start")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {t: np.unique(g.to_numpy()) for t, g in pdf.groupby("theta")["r"]}
        start, rows = int(pdf["start"].iloc[0]), []
        for direction in (1, -1):
            for seed, r in enumerate(by.get(start, ())):
                steps, missed = [(0, r)], 0
                for step in range(1, turns * bins + 1):
                    here = by.get((start + direction * step) % bins, ())
                    best = here[np.argmin(np.abs(here - steps[-1][1]))] if len(here) else None
                    if best is None or abs(best - steps[-1][1]) > gate:
                        missed += 1
                        if missed > skips:
                            break
                        continue
                    missed = 0
                    steps.append((step, best))
                if steps[-1][0] >= 1.03 * bins and sum(s > bins for s, _ in steps) >= least:
                    rows.extend((direction, seed, s, float(x)) for s, x in steps)
                    break
        out = pd.DataFrame(rows, columns=["direction", "seed", "step", "r"])
        return out.assign(gid=pdf["gid"].iloc[0], z=pdf["z"].iloc[0])[["gid", "z", "direction", "seed", "step", "r"]]

    return held.groupBy("gid", "z").applyInPandas(one, "gid long, z long, direction long, seed long, step long, r double")


def turn_advance(tracks: DataFrame, bins: int, loop: float = 2.0) -> DataFrame:
    """``gid, z, direction, n, advance, kind``: median radius gained since one turn before, outwards for positive angles.

    The radius one turn before is interpolated between the track's steps there. Below ``loop`` the track is a closed loop.
    """
    by = ["gid", "z", "direction", "seed"]
    late = tracks.where(F.col("step") > bins).select(*by, (F.col("step") - bins).alias("step"), F.col("r").alias("now"))
    both = interpolated(asof(late, tracks.select(*by, "step", "r"), by, "step", "r"), "step")
    out = both.groupBy("gid", "z", "direction").agg(F.count("*").alias("n"), (F.median(F.col("now") - F.col("value")) * F.first("direction")).alias("advance"))
    return out.withColumn("kind", F.when(F.abs("advance") < loop, "loop").otherwise("spiral"))


def spiral_sense(advances: DataFrame) -> DataFrame:
    """One row ``spirals, loops, advance, sense``: clockwise where radii grow with the angle; null without a spiral."""
    some = F.col("kind") == "spiral"
    out = advances.agg(F.count_if(some).alias("spirals"), F.count_if(~some).alias("loops"), F.median(F.when(some, F.col("advance"))).alias("advance"))
    return out.withColumn("sense", F.when(F.col("advance") > 0, "CW").when(F.col("advance").isNotNull(), "ACW"))


def mean_angle(points: DataFrame, by: list[str], theta: str) -> DataFrame:
    """Circular mean of an angle in radians per group."""
    return points.groupBy(*by).agg(F.atan2(F.avg(F.sin(theta)), F.avg(F.cos(theta))).alias("theta"))


def patch_grid(radii: DataFrame, cy: float, cx: float, bins: int) -> DataFrame:
    """``uuid, row, col, z, y, x`` from ``uuid, z, bin, r``: vertices of a seed patch, rows by z, columns by angle."""
    row = F.dense_rank().over(Window.partitionBy("uuid").orderBy("z")) - 1
    col = F.dense_rank().over(Window.partitionBy("uuid").orderBy("bin")) - 1
    theta = F.col("bin") * F.lit(2 * np.pi / bins)
    return radii.select("uuid", row.alias("row"), col.alias("col"), "z", (F.lit(cy) + F.col("r") * F.sin(theta)).alias("y"), (F.lit(cx) + F.col("r") * F.cos(theta)).alias("x"))


def seed_patch(points: DataFrame, bins: int, columns: int, gap: float, axis: DataFrame) -> DataFrame:
    """``gid, row, col, z, y, x``: the grid of one instance of ``points`` (``gid, z, bin, r``), the one with most vertices.

    A vertex is the middle of the largest cluster of radii of an angle bin in a slice (clusters part at ``gap``). Columns are the
    circular run of ``columns`` bins that holds most vertices of an instance (lowest start on ties), rows its slices in order;
    instances tie by smaller id. ``axis`` (``z, cy, cx``) gives the centre of each slice.
    """
    from laminar.operators.windings import circular_peak, largest_cluster

    radii = largest_cluster(points, ["gid", "z", "bin"], "r", gap).select("gid", "z", "bin", F.col("middle").alias("r"))
    score = radii.groupBy("gid", "bin").agg(F.count("*").alias("n"))
    wedge = circular_peak(score, ["gid"], bins, columns)
    best = wedge.agg(F.max_by(F.struct("gid", "start"), F.struct("total", (-F.col("gid")).alias("m"))).alias("b")).select("b.gid", "b.start")
    held = radii.join(F.broadcast(best), "gid").withColumn("col", F.pmod(F.col("bin") - F.col("start"), F.lit(bins))).where(F.col("col") < columns)  # one row
    row = F.dense_rank().over(Window.partitionBy("gid").orderBy("z")) - 1
    theta = (F.col("bin") + 0.5) * F.lit(2 * np.pi / bins) - F.lit(np.pi)
    placed = held.withColumn("row", row).join(axis, "z")
    return placed.select("gid", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "z", (F.col("cy") + F.col("r") * F.sin(theta)).alias("y"), (F.col("cx") + F.col("r") * F.cos(theta)).alias("x"))


def patch_gate(vertices: DataFrame, least: int, ny: float, nx: float) -> DataFrame:
    """``uuid, quads, n_outside, ok`` of patches ``uuid, row, col, z, y, x``: enough quads, every vertex inside the grid."""
    quads = patch_meta(vertices).select("uuid", "quads")
    inside = (F.col("y") > 0) & (F.col("y") < ny) & (F.col("x") > 0) & (F.col("x") < nx)
    out = vertices.groupBy("uuid").agg(F.count_if(~inside).alias("n_outside")).join(quads, "uuid")
    return out.select("uuid", "quads", "n_outside", ((F.col("quads") >= least) & (F.col("n_outside") == 0)).alias("ok"))


def patch_meta(vertices: DataFrame, step: float = 64.0, um: float = 8.64) -> DataFrame:
    """``uuid, quads, area_vx2, area_cm2`` and the bounding box; a quad needs its four corners."""
    right = F.lead("col").over(Window.partitionBy("uuid", "row").orderBy("col")) == F.col("col") + 1
    edges = vertices.withColumn("right", F.coalesce(right, F.lit(False)))
    below = F.lead("row").over(Window.partitionBy("uuid", "col").orderBy("row")) == F.col("row") + 1
    below_right = F.lead("right").over(Window.partitionBy("uuid", "col").orderBy("row"))
    quads = edges.withColumn("quad", F.coalesce(F.col("right") & below & below_right, F.lit(False)))
    box = [f(c).alias(f"{c}_{n}") for c in ("z", "y", "x") for f, n in ((F.min, "min"), (F.max, "max"))]
    out = quads.groupBy("uuid").agg(F.count_if("quad").alias("quads"), *box)
    area = F.col("quads") * step * step
    return out.withColumns({"area_vx2": area, "area_cm2": area * um * um / 1e8})
