"""Queries of the quality-control plane: rays, pitch, layers, injection, axis."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminar.operators import axis, inject, rays, windings
from laminar.plans.adapters import CANVAS_SQL, CELLS_SQL, CROSSINGS_SQL, HITS_SQL, canvas, hits
from laminar.plans.registry import register, table


@register("ray_cells", f"WITH {CELLS_SQL} SELECT slab, theta, n_distinct, n_runs, round(pitch_um, 6) AS pitch_um, round(span_um, 6) AS span_um, round(ratio, 6) AS ratio FROM raycells")
def ray_cells(spark, sf_dir):
    out = rays.ray_cells(hits(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("pitch_um", "span_um", "ratio")})


@register("ray_crossings", f"WITH {CROSSINGS_SQL} SELECT slab, theta, k, r_vox, r_vox * 17.28 AS r_um, n_ids FROM crossings")
def ray_crossings(spark, sf_dir):
    return rays.crossings(hits(spark, sf_dir)).select("slab", "theta", "k", "r_vox", (F.col("r_vox") * 17.28).alias("r_um"), "n_ids")


@register(
    "ray_id_runs",
    f"""WITH {HITS_SQL}, m AS (SELECT *, CASE WHEN gid = lag(gid) OVER (PARTITION BY slab, theta ORDER BY r) THEN 0 ELSE 1 END AS s FROM hits),
    k AS (SELECT *, CAST(sum(s) OVER (PARTITION BY slab, theta ORDER BY r ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM m)
    SELECT slab, theta, run, min(gid) AS gid, min(r) AS first_r, max(r) AS last_r FROM k GROUP BY slab, theta, run""",
)
def ray_id_runs(spark, sf_dir):
    return rays.id_runs(hits(spark, sf_dir))


@register(
    "pitch_summary",
    f"""WITH {CELLS_SQL}, good AS (SELECT * FROM raycells WHERE n_distinct >= 4 AND pitch_um IS NOT NULL)
    SELECT count(*) AS n_cells, round(median(pitch_um), 6) AS pitch_median, round(quantile_cont(pitch_um, 0.25), 6) AS pitch_p25, round(quantile_cont(pitch_um, 0.75), 6) AS pitch_p75,
      round(median(ratio), 6) AS ratio_median, count(*) FILTER (WHERE pitch_um > 2 * (SELECT median(pitch_um) FROM good)) AS n_wide FROM good""",
)
def pitch_summary(spark, sf_dir):
    out = rays.pitch_summary(rays.ray_cells(hits(spark, sf_dir)), 4)
    return out.withColumns({c: F.round(c, 6) for c in ("pitch_median", "pitch_p25", "pitch_p75", "ratio_median")})


_LAYERS = f"""{HITS_SQL}, per AS (SELECT slab, theta, count(DISTINCT gid) AS n FROM hits GROUP BY slab, theta),
layers AS (SELECT slab, count(*) AS n_rays, median(n) AS median_n, quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.9) AS p90, (quantile_cont(n, 0.9) - quantile_cont(n, 0.1)) / median(n) AS spread FROM per GROUP BY slab)"""


@register("layer_counts", f"WITH {_LAYERS} SELECT slab, n_rays, median_n, round(p10, 6) AS p10, round(p90, 6) AS p90, round(spread, 6) AS spread FROM layers")
def layer_counts(spark, sf_dir):
    return rays.layer_counts(hits(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("p10", "p90", "spread")})


@register("anchor_slab", f"WITH {_LAYERS} SELECT slab, round(spread, 6) AS spread FROM layers WHERE median_n >= 3 ORDER BY layers.spread, slab LIMIT 1")
def anchor_slab(spark, sf_dir):
    return rays.anchor_slab(rays.layer_counts(hits(spark, sf_dir)), 3).withColumn("spread", F.round("spread", 6))


@register(
    "layer_histogram_bars",
    f"""WITH {HITS_SQL}, per AS (SELECT slab, theta, count(DISTINCT gid) AS n FROM hits GROUP BY slab, theta), c AS (SELECT n, count(*) AS rays FROM per GROUP BY n)
    SELECT n, rays, repeat('#', CAST(round_even(rays * 40.0 / (SELECT max(rays) FROM c), 0) AS INTEGER)) AS bar FROM c""",
)
def layer_histogram_bars(spark, sf_dir):
    from laminar.operators.sweep import text_bar

    per = hits(spark, sf_dir).groupBy("slab", "theta").agg(F.countDistinct("gid").alias("n"))
    counts = per.groupBy("n").agg(F.count("*").alias("rays"))
    peak = counts.agg(F.max("rays").alias("peak"))
    return counts.crossJoin(F.broadcast(peak)).select("n", "rays", text_bar(F.col("rays"), F.col("peak")).alias("bar"))


@register(
    "boundary_profile",
    """WITH s AS (SELECT user_id % 10 AS series, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS z, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2),
    b AS (SELECT series, z, n, sum(n) OVER (PARTITION BY series ORDER BY z ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9.0 AS baseline FROM s)
    SELECT series, z, n, round(baseline, 6) AS baseline, round(abs(n - baseline), 6) AS deviation, z % 8 < 2 AS near_boundary FROM b""",
)
def boundary_profile(spark, sf_dir):
    hour = F.floor(F.unix_timestamp("ts") / 3600).cast("long")
    per = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("series"), hour.alias("z")).agg(F.count("*").cast("double").alias("n"))
    out = rays.boundary_profile(per.withColumn("pos", F.col("z") % 8))
    return out.withColumns({c: F.round(c, 6) for c in ("baseline", "deviation")})


_PAIRS = """m AS (SELECT *, CASE WHEN gid = lag(gid) OVER (PARTITION BY slab, theta ORDER BY r) THEN 0 ELSE 1 END AS s FROM hits),
k AS (SELECT *, sum(s) OVER (PARTITION BY slab, theta ORDER BY r ROWS UNBOUNDED PRECEDING) - 1 AS run FROM m),
idruns AS (SELECT slab, theta, run, min(gid) AS gid FROM k GROUP BY slab, theta, run),
nb AS (SELECT *, lead(gid) OVER (PARTITION BY slab, theta ORDER BY run) AS b, count(*) OVER (PARTITION BY slab, theta) AS n FROM idruns),
cand AS (SELECT theta, gid AS a, b, (theta * 7919 + run * 104729) % 1000003 AS h, run FROM nb WHERE slab = 0 AND n >= 4 AND b IS NOT NULL AND b <> gid),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY theta ORDER BY h, run) AS rn FROM cand) WHERE rn = 1),
pairs AS (SELECT a, b FROM (SELECT a, b, min(h) AS h FROM one GROUP BY a, b) ORDER BY h, a, b LIMIT 3)"""


@register(
    "seam_injection",
    f"""WITH {HITS_SQL}, {_PAIRS}, map AS (SELECT b AS gid, min(a) AS dst FROM pairs GROUP BY b),
    inj AS (SELECT slab, theta, r, coalesce(dst, gid) AS gid FROM hits LEFT JOIN map USING (gid)),
    base AS (SELECT slab, median(n) AS was FROM (SELECT slab, theta, count(DISTINCT gid) AS n FROM hits GROUP BY slab, theta) GROUP BY slab),
    now AS (SELECT slab, median(n) AS now FROM (SELECT slab, theta, count(DISTINCT gid) AS n FROM inj GROUP BY slab, theta) GROUP BY slab),
    d AS (SELECT slab, now - was AS d FROM base JOIN now USING (slab)),
    v AS (SELECT avg(d) FILTER (WHERE slab = 0) AS target_delta, coalesce(avg(d) FILTER (WHERE slab <> 0), 0.0) AS other_delta FROM d)
    SELECT target_delta, other_delta, target_delta <= -0.5 AS fires, abs(other_delta) < abs(target_delta) / 3 AS localised FROM v""",
)
def seam_injection(spark, sf_dir):
    h = hits(spark, sf_dir)
    pairs = inject.adjacent_candidates(rays.id_runs(h), 0, 3, 4)
    return inject.control_verdict(rays.layer_counts(h), rays.layer_counts(inject.remap(h, pairs)), 0)


@register(
    "slice_centroids",
    f"WITH {CANVAS_SQL} SELECT slab AS z, round(avg(y), 9) AS cy, round(avg(x), 9) AS cx, count(*) AS n FROM canvas GROUP BY slab HAVING count(*) >= 100",
)
def slice_centroids(spark, sf_dir):
    out = axis.centroids(canvas(spark, sf_dir).withColumnRenamed("slab", "z"), 100)
    return out.withColumns({c: F.round(c, 9) for c in ("cy", "cx")})


_DAYS = """days AS (SELECT user_id % 20 AS g, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS z, avg(value) AS cy, CAST(count(*) AS DOUBLE) AS cx FROM events GROUP BY 1, 2)"""
_SMOOTH = f"""{_DAYS}, smooth AS (SELECT g, z, median(cy) OVER (PARTITION BY g ORDER BY z ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS cy,
  median(cx) OVER (PARTITION BY g ORDER BY z ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS cx FROM days)"""


def _axis(spark, sf_dir):
    day = F.floor(F.unix_timestamp("ts") / 86400).cast("long")
    per = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("g"), day.alias("z")).agg(F.avg("value").alias("cy"), F.count("*").cast("double").alias("cx"))
    return axis.smooth_axis(per, ["g"])


@register("running_median_axis", f"WITH {_SMOOTH} SELECT g, z, round(cy, 6) AS cy, round(cx, 6) AS cx FROM smooth")
def running_median_axis(spark, sf_dir):
    return _axis(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("cy", "cx")})


@register(
    "axis_checks",
    f"""WITH {_SMOOTH}, st AS (SELECT *, sqrt((cy - lag(cy) OVER w) ** 2 + (cx - lag(cx) OVER w) ** 2) AS step FROM smooth WINDOW w AS (PARTITION BY g ORDER BY z))
    SELECT g, count(*) AS n, count(*) FILTER (WHERE NOT (cy BETWEEN 0 AND 60 AND cx BETWEEN 0 AND 30)) AS n_outside, count(*) FILTER (WHERE step >= 5) AS n_jumps, round(max(step), 6) AS max_step FROM st GROUP BY g""",
)
def axis_checks(spark, sf_dir):
    return axis.axis_checks(_axis(spark, sf_dir), ["g"], 60, 30, 5).withColumn("max_step", F.round("max_step", 6))


@register(
    "first_slab_per_z",
    """WITH p AS (SELECT l_orderkey // 1000 AS slab, l_partkey AS z, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
    SELECT slab, z, q FROM (SELECT *, row_number() OVER (PARTITION BY z ORDER BY slab) AS r FROM p) WHERE r = 1""",
)
def first_slab_per_z(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 1000).cast("long").alias("slab"), F.col("l_partkey").alias("z")).agg(F.sum("l_quantity").alias("q"))
    return axis.first_slab_wins(p)


_ASOF = """l AS (SELECT o_orderkey, o_custkey % 50 AS g, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS t FROM orders),
r AS (SELECT user_id % 50 AS g, (CAST(floor(epoch(ts) / 86400) AS BIGINT)) * 7 % 3000 + 8000 AS t, max(value) AS v FROM events GROUP BY 1, 2),
b AS (SELECT l.o_orderkey, max(r.t) AS bt FROM l JOIN r ON l.g = r.g AND r.t <= l.t GROUP BY 1), a AS (SELECT l.o_orderkey, min(r.t) AS aft FROM l JOIN r ON l.g = r.g AND r.t >= l.t GROUP BY 1),
f AS (SELECT l.*, bt AS before_t, rb.v AS before_v, aft AS after_t, ra.v AS after_v FROM l LEFT JOIN b USING (o_orderkey) LEFT JOIN a USING (o_orderkey)
      LEFT JOIN r rb ON rb.g = l.g AND rb.t = bt LEFT JOIN r ra ON ra.g = l.g AND ra.t = aft)"""


def _asof(spark, sf_dir):
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400).cast("long")
    left = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("g"), day("o_orderdate").alias("t"))
    right = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("g"), (day("ts") * 7 % 3000 + 8000).alias("t")).agg(F.max("value").alias("v"))
    return axis.asof(left, right, ["g"], "t", "v")


@register("asof_nearest", f"WITH {_ASOF} SELECT o_orderkey, g, t, CASE WHEN after_t IS NULL OR t - before_t <= after_t - t THEN before_v ELSE after_v END AS nearest FROM f")
def asof_nearest(spark, sf_dir):
    return axis.nearest(_asof(spark, sf_dir), "t").select("o_orderkey", "g", "t", "nearest")


@register(
    "interpolated_axis",
    f"""WITH {_ASOF} SELECT o_orderkey, g, t, round(CASE WHEN before_t IS NULL THEN after_v WHEN after_t IS NULL OR after_t = before_t THEN before_v
      ELSE before_v + (after_v - before_v) * (t - before_t) / (after_t - before_t) END, 6) AS value FROM f""",
)
def interpolated_axis(spark, sf_dir):
    return axis.interpolated(_asof(spark, sf_dir), "t").select("o_orderkey", "g", "t", F.round("value", 6).alias("value"))


@register(
    "circular_window_peak",
    """WITH h AS (SELECT event_type, CAST(hour(ts) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2),
    d AS (SELECT * FROM h UNION ALL SELECT event_type, bin + 24, n FROM h),
    s AS (SELECT event_type, bin, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY bin RANGE BETWEEN CURRENT ROW AND 5 FOLLOWING) AS BIGINT) AS total FROM d)
    SELECT event_type, bin AS start, total FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY total DESC, bin) AS r FROM s WHERE bin < 24) WHERE r = 1""",
)
def circular_window_peak(spark, sf_dir):
    h = table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return windings.circular_peak(h, ["event_type"], 24, 6)


@register(
    "event_runs",
    """WITH m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS s FROM events),
    k AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM m)
    SELECT user_id, run, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_id FROM k GROUP BY user_id, run""",
)
def event_runs(spark, sf_dir):
    from laminar.functions.islands import islands, prev

    e = table(spark, sf_dir, "events")
    runs = islands(e, ["user_id"], "event_id", F.col("event_type") != prev("event_type", ["user_id"], "event_id"))
    return runs.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@register(
    "largest_radial_cluster",
    """WITH v AS (SELECT l_suppkey AS g, l_extendedprice AS r FROM lineitem), m AS (SELECT *, CASE WHEN r - lag(r) OVER (PARTITION BY g ORDER BY r) > 400 THEN 1 WHEN lag(r) OVER (PARTITION BY g ORDER BY r) IS NULL THEN 1 ELSE 0 END AS s FROM v),
    k AS (SELECT *, sum(s) OVER (PARTITION BY g ORDER BY r ROWS UNBOUNDED PRECEDING) AS c FROM m), a AS (SELECT g, c, count(*) AS n, median(r) AS middle FROM k GROUP BY g, c)
    SELECT g, n, round(middle, 6) AS middle FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, c) AS rn FROM a) WHERE rn = 1""",
)
def largest_radial_cluster(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_extendedprice").alias("r"))
    return windings.largest_cluster(v, ["g"], "r", 400).withColumn("middle", F.round("middle", 6))


@register(
    "sliding_windows",
    """WITH e AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS z, value FROM events),
    w AS (SELECT unnest(range(z // 640 * 640 - 640, z // 640 * 640 + 1, 640)) AS w0, z, value FROM e)
    SELECT CAST(w0 AS BIGINT) AS w0, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE z >= w0 AND z < w0 + 800 GROUP BY w0""",
)
def sliding_windows(spark, sf_dir):
    z = F.floor(F.unix_timestamp("ts") / 3600).cast("long")
    base = F.floor(F.col("z") / 640) * 640
    e = table(spark, sf_dir, "events").select(z.alias("z"), "value").withColumn("w0", F.explode(F.array(base - 640, base)))
    inside = e.where((F.col("z") >= F.col("w0")) & (F.col("z") < F.col("w0") + 800))
    return inside.groupBy(F.col("w0").cast("long").alias("w0")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register(
    "resume_slabs",
    """WITH s AS (SELECT DISTINCT l_orderkey // 1000 AS slab FROM lineitem), done AS (SELECT DISTINCT o_orderkey // 1000 AS slab FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 1000 = 3)
    SELECT slab FROM s ANTI JOIN done USING (slab)""",
)
def resume_slabs(spark, sf_dir):
    slab = lambda c: F.floor(F.col(c) / 1000).cast("long").alias("slab")
    todo = table(spark, sf_dir, "lineitem").select(slab("l_orderkey")).distinct()
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_orderkey % 1000 = 3").select(slab("o_orderkey")).distinct()
    return todo.join(done, "slab", "left_anti")


@register(
    "run_ordinals",
    f"WITH {CROSSINGS_SQL} SELECT slab, theta, k, r_vox, r_vox - lag(r_vox) OVER (PARTITION BY slab, theta ORDER BY k) AS gap FROM crossings",
)
def run_ordinals(spark, sf_dir):
    along = Window.partitionBy("slab", "theta").orderBy("k")
    return rays.crossings(hits(spark, sf_dir)).select("slab", "theta", "k", "r_vox", (F.col("r_vox") - F.lag("r_vox").over(along)).alias("gap"))
