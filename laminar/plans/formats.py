"""Queries over the formats: data of the given tables written in a format, read back by its reader, and given back as rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from laminar.operators import axis, rays, spiral, stitch, sweep, validate, voxels
from laminar.plans import adapters as A
from laminar.plans import assembly as plan
from laminar.plans.constraints import _DOC, _PTS, _WIN, _payloads, _points, _windows, stratified_samples
from laminar.plans.further import _PATCH, _spiral_runs
from laminar.plans.registry import register, table
from laminar.session import ship
from laminar.sources import mesh_source, sinks, tables, zarr_source
from laminar.storage import shared_dir, stage
from laminar.streaming import budget


def _new(spark, name: str) -> str:
    return f"{shared_dir(spark)}/laminar-{name}-{uuid.uuid4().hex}"


def _volume(spark, sf_dir):
    """The scanned values of all slabs, one above the other, as a zarr array."""
    v = A.voxels(spark, sf_dir).select((F.col("slab") * 7 + F.col("z")).alias("z"), "y", "x", "v").where("v > 0")
    deep = v.agg(F.max("z")).first()[0] + 1
    path = _new(spark, "zarr")
    zarr_source.write_zarr(v, path, (deep, 32, 32), (7, 16, 16))
    return path, deep


@register("zarr_box", f"WITH {A.VOXELS_SQL}, d AS (SELECT max(slab * 7 + z) + 1 AS deep FROM voxels WHERE v > 0) SELECT slab * 7 + z AS z, y, x, CAST(v AS DOUBLE) AS v FROM voxels, d WHERE v > 0 AND slab * 7 + z >= deep // 4 AND y < 16 AND x >= 16")
def zarr_box(spark, sf_dir):
    """A box of the array: only the chunks that it meets are opened."""
    path, deep = _volume(spark, sf_dir)
    return zarr_source.read_zarr(spark, path, (deep // 4, 0, 16), (deep, 16, 32))


@register("zarr_slice_means", f"WITH {A.VOXELS_SQL} SELECT slab * 7 + z AS z, count(*) AS n, avg(CAST(v AS DOUBLE)) AS mean FROM voxels WHERE v > 0 AND slab * 7 + z >= 3 AND slab * 7 + z <= 12 GROUP BY 1")
def zarr_slice_means(spark, sf_dir):
    """Planes 3 to 12 by a filter that the reader takes over."""
    array = zarr_source.read_zarr(spark, _volume(spark, sf_dir)[0])
    return array.where("z >= 3 AND z <= 12").groupBy("z").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def _patches(spark, sf_dir):
    c = A.canvas(spark, sf_dir).select(F.col("slab").cast("string").alias("uuid"), F.col("y").alias("z"), F.col("x").alias("bin"), F.col("gid").cast("double").alias("r"))
    g = spiral.patch_grid(c, 32, 32, 60)
    path = _new(spark, "meshes")
    mesh_source.write_meshes(g.withColumn("z", F.col("z") + 1), path)
    return path


_VERTICES = f"""{A.CANVAS_SQL}, {_PATCH.replace(", z FROM g)", ", z + 1.0 AS z, 32 + r * sin(bin * radians(6.0)) AS y, 32 + r * cos(bin * radians(6.0)) AS x FROM g)")}"""


@register("mesh_round_trip", f"WITH {_VERTICES} SELECT uuid, rw AS row, cl AS col, CAST(CAST(z AS REAL) AS DOUBLE) AS z, CAST(CAST(y AS REAL) AS DOUBLE) AS y, CAST(CAST(x AS REAL) AS DOUBLE) AS x FROM v".replace("AS row,", 'AS "row",'))
def mesh_round_trip(spark, sf_dir):
    """Patch grids written as meshes and read back, in the floats that the format holds."""
    return mesh_source.read_meshes(spark, _patches(spark, sf_dir))


@register("mesh_folders", f"WITH {_VERTICES} SELECT uuid, count(*) AS vertices, CAST(NULL AS VARCHAR) AS error FROM v GROUP BY uuid")
def mesh_folders(spark, sf_dir):
    """A row a mesh folder; all are readable."""
    return mesh_source.mesh_report(spark, _patches(spark, sf_dir))


@register("label_block_files", f"WITH {plan.LABELS_SQL} SELECT slab AS slab_z0, ty * {plan.STRIDE} AS tile_y0, tx * {plan.STRIDE} AS tile_x0, z - slab AS zl, y - ty * {plan.STRIDE} AS yl, x - tx * {plan.STRIDE} AS xl, label AS local_id FROM lab")
def label_block_files(spark, sf_dir):
    """Tile labels as npz blocks and back."""
    s = plan.STRIDE
    lab = plan.labels(ship(spark), sf_dir).select(
        F.col("slab").alias("slab_z0"), (F.col("ty") * s).alias("tile_y0"), (F.col("tx") * s).alias("tile_x0"), (F.col("z") - F.col("slab")).alias("zl"), (F.col("y") - F.col("ty") * s).alias("yl"), (F.col("x") - F.col("tx") * s).alias("xl"), F.col("label").alias("local_id")
    )
    path = _new(spark, "blocks")
    sinks.write_label_blocks(lab, path, (plan.DEPTH, plan.TILE, plan.TILE))
    return tables.read_label_blocks(spark, path)


@register("id_map_files", "SELECT CAST(l_orderkey // 7500 AS BIGINT) AS slab_z0, CAST(l_partkey % 9 AS BIGINT) AS tile_y0, CAST(0 AS BIGINT) AS tile_x0, CAST(l_suppkey AS BIGINT) AS local_id, max(l_orderkey) AS gid FROM lineitem GROUP BY 1, 2, 4")
def id_map_files(spark, sf_dir):
    """The id tables of all slabs as JSON documents and back, keys taken apart."""
    slab = F.floor(F.col("l_orderkey") / 7500).cast("long")
    tile = F.concat(F.lit("z"), slab.cast("string"), F.lit("/y"), (F.col("l_partkey") % 9).cast("string"), F.lit("_x0"))
    ids = table(spark, sf_dir, "lineitem").groupBy(slab.alias("slab_z0"), tile.alias("tile"), F.col("l_suppkey").alias("local_id")).agg(F.max("l_orderkey").alias("gid"))
    path = _new(spark, "idmaps")
    sinks.write_text(sinks.id_map_json(ids), path, "slab_z0")
    return tables.read_id_maps(spark, path).select(*tables.tile_key(F.col("tile")), "local_id", "gid")


@register("axis_file", "SELECT CAST(l_partkey % 300 AS DOUBLE) AS z, round(avg(l_quantity), 6) AS y, round(avg(l_linenumber), 6) AS x FROM lineitem GROUP BY 1")
def axis_file(spark, sf_dir):
    """An axis document and its control points read back."""
    points = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 300).alias("z")).agg(F.avg("l_quantity").alias("y"), F.avg("l_linenumber").alias("x"))
    path = _new(spark, "axis")
    sinks.write_text(sinks.axis_json(points), path)
    return tables.read_axis(spark, path).select("z", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"))


@register("dirty_pitch_file", "SELECT CAST(l_orderkey AS DOUBLE) AS k, l_extendedprice AS pitch FROM lineitem WHERE l_linenumber % 4 NOT IN (0, 1)")
def dirty_pitch_file(spark, sf_dir):
    """Figures appended to a compressed CSV in two goes, some of them words or not finite; the reader keeps finite numbers."""
    n = F.col("l_linenumber") % 4
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(n == 0, "n/r").when(n == 1, "NaN").otherwise(F.col("l_extendedprice").cast("string")).alias("pitch"), "l_linenumber")
    path = _new(spark, "pitch")
    for odd in (0, 1):
        sinks.append_csv(rows.where(F.col("l_linenumber") % 2 == odd).drop("l_linenumber"), path, gzip=True)
    return tables.read_numbers(spark, path, ["k", "pitch"])


@register("site_files", """SELECT 'full' AS layout, l_orderkey / 2.0 AS z, l_partkey / 2.0 AS y, l_suppkey / 2.0 AS x FROM lineitem UNION ALL SELECT 'half', CAST(l_orderkey AS DOUBLE), CAST(l_partkey AS DOUBLE), CAST(l_suppkey AS DOUBLE) FROM lineitem WHERE l_linenumber <> 3""")
def site_files(spark, sf_dir):
    """Sites in both column layouts, with one unreadable coordinate in the second."""
    li = table(spark, sf_dir, "lineitem")
    full = li.select(F.col("l_orderkey").alias("gz"), F.col("l_partkey").alias("gy"), F.col("l_suppkey").alias("gx"))
    half = li.select(F.col("l_orderkey").alias("z"), F.when(F.col("l_linenumber") == 3, "?").otherwise(F.col("l_partkey").cast("string")).alias("y"), F.col("l_suppkey").alias("x"))
    out = []
    for layout, rows in (("full", full), ("half", half)):
        path = _new(spark, "sites")
        sinks.append_csv(rows, path)
        out.append(tables.read_sites(spark, path).select(F.lit(layout).alias("layout"), "z", "y", "x"))
    return out[0].union(out[1])


@register("satisfaction_file", "SELECT o_orderpriority AS source, CAST(sum(o_custkey % 3) AS BIGINT) AS satisfied, CAST(sum(o_custkey % 7) AS BIGINT) AS total FROM orders GROUP BY 1")
def satisfaction_file(spark, sf_dir):
    """Satisfaction reports, a JSON file a priority, their records read back and summed up."""
    o = table(spark, sf_dir, "orders")
    part = o.groupBy("o_orderpriority", (F.col("o_orderkey") % 20).alias("k")).agg(F.sum(F.col("o_custkey") % 3).alias("satisfied"), F.sum(F.col("o_custkey") % 7).alias("total"))
    record = F.struct(F.col("o_orderpriority").alias("source"), "satisfied", "total")
    path = _new(spark, "satisfied")
    docs = part.groupBy("o_orderpriority").agg(F.to_json(F.struct(F.collect_list(record).alias("pcls"))).alias("value"))
    sinks.write_text(docs.withColumn("file", F.substring("o_orderpriority", 1, 1)), path, "file")
    return sweep.satisfaction(tables.read_json_tables(spark, path, "pcls")).select("source", "satisfied", "total")


@register("sweep_file", f"WITH w AS ({_WIN}) SELECT count(*) AS n, count(*) FILTER (WHERE rel_pct >= 94) AS rel_ok, count(*) FILTER (WHERE same_pct >= 91) AS same_ok, count(*) FILTER (WHERE abs(dr - 10.13) <= 0.8) AS dr_ok, count(*) FILTER (WHERE rel_pct >= 94 AND same_pct >= 91 AND abs(dr - 10.13) <= 0.8) AS all_ok FROM w")
def sweep_file(spark, sf_dir):
    """The table of fit windows as a CSV, its numbers read back, and the gate."""
    path = _new(spark, "sweep")
    sinks.append_csv(_windows(spark, sf_dir), path)
    return sweep.gate(tables.read_numbers(spark, path, ["w", "rel_pct", "same_pct", "dr", "wall_s"]), 94, 91, 10.13, 0.8)


@register("budgeted_slab_counts", "SELECT CAST(l_orderkey // 1500 AS BIGINT) AS slab, count(*) AS n, true AS complete FROM lineitem GROUP BY 1")
def budgeted_slab_counts(spark, sf_dir):
    """Slab counts by a stream of files: a first run without time to spare stops after a file, a second one goes on to the end."""
    li = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 1500).cast("long").alias("slab"))
    root = _new(spark, "budget")
    li.repartition(4).write.parquet(f"{root}/in")
    figures = lambda batch: batch.groupBy("slab").agg(F.count("*").alias("n"))
    done = []
    for seconds in (0.0, 3600.0):
        stream = spark.readStream.schema(li.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        done.append(budget.run_within(stream, figures, f"{root}/out", f"{root}/state", seconds))
    out = budget.results(spark, f"{root}/out", "slab long, n long").groupBy("slab").agg(F.sum("n").alias("n"))
    return out.withColumn("complete", F.lit(done == [False, True] and budget.is_complete(spark, f"{root}/out")))


@register("given_files")
def given_files(spark, sf_dir):
    """The files of the given tables with size and time of change in UTC (times are the file system's: tested with times set)."""
    return tables.file_times(spark, sf_dir).select("name", "bytes", "modified_utc")


_OWNED = f"""{A.CANVAS_SQL}, gr AS (SELECT unnest(range(0, 4)) AS t),
ow AS (SELECT slab, y, x FROM canvas, gr ty, gr tx WHERE y >= ty.t * 18 AND y < ty.t * 18 + 24 AND x >= tx.t * 18 AND x < tx.t * 18 + 24 AND (ty.t = 0 OR y - ty.t * 18 >= 3) AND (tx.t = 0 OR x - tx.t * 18 >= 3))"""


@register("owned_centroids", f"""WITH {_OWNED}, c AS (SELECT slab, y % 7 AS z, avg(y) AS cy, avg(x) AS cx, count(*) AS n FROM ow WHERE y % 7 <> 3 GROUP BY 1, 2), s AS (SELECT slab, z FROM (SELECT DISTINCT slab FROM canvas), (SELECT unnest(range(0, 7)) AS z))
  SELECT s.slab, s.z, round(coalesce(cy, 32.0), 9) AS cy, round(coalesce(cx, 32.0), 9) AS cx, coalesce(n, 0) AS n FROM s LEFT JOIN c ON c.slab = s.slab AND c.z = s.z""")  # fmt: skip
def owned_centroids(spark, sf_dir):
    """Centres of planes over owned voxels; plane 3 has none and takes the middle (the gap is planted)."""
    canvas = A.canvas(spark, sf_dir)
    mask = stitch.covering_tiles(canvas, 24, 18, 4).withColumn("z", F.col("y") % 7).where("z != 3")
    slices = canvas.select("slab").distinct().withColumn("z", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    return axis.owned_centroids(mask, slices, 32.0, 32.0).withColumns({c: F.round(c, 9) for c in ("cy", "cx")})


@register("trimmed_centroids", """WITH p AS (SELECT l_suppkey AS g, l_linenumber AS z, l_quantity AS y, l_extendedprice AS x FROM lineitem),
  b AS (SELECT g, z, quantile_cont(y, 0.1) AS y0, quantile_cont(y, 0.9) AS y1, quantile_cont(x, 0.1) AS x0, quantile_cont(x, 0.9) AS x1, count(*) AS n FROM p GROUP BY g, z),
  k AS (SELECT p.g, p.z, avg(y) AS y, avg(x) AS x, count(*) AS k FROM p JOIN b ON b.g = p.g AND b.z = p.z WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY 1, 2)
  SELECT b.g, b.z, round(CASE WHEN coalesce(k, 0) >= 60 THEN y ELSE 1898.0 END, 6) AS cy, round(CASE WHEN coalesce(k, 0) >= 60 THEN x ELSE 1898.0 END, 6) AS cx, n, coalesce(k, 0) AS n_kept FROM b LEFT JOIN k ON k.g = b.g AND k.z = b.z""")  # fmt: skip
def trimmed_centroids(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("z"), F.col("l_quantity").alias("y"), F.col("l_extendedprice").alias("x"))
    return axis.trimmed_centroids(p, ["g", "z"], 0.1, 60, 1898.0, 1898.0).withColumns({c: F.round(c, 6) for c in ("cy", "cx")})


@register("boundary_means", """WITH s AS (SELECT user_id % 10 AS series, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS z, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2),
  b AS (SELECT series, z, abs(n - sum(n) OVER (PARTITION BY series ORDER BY z ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9.0) AS d FROM s),
  m AS (SELECT series, count(*) FILTER (WHERE z % 8 < 2) AS n_near, count(*) FILTER (WHERE z % 8 >= 2) AS n_interior, avg(d) FILTER (WHERE z % 8 < 2) AS near, avg(d) FILTER (WHERE z % 8 >= 2) AS interior FROM b GROUP BY series)
  SELECT series, n_near, n_interior, round(near, 6) AS near, round(interior, 6) AS interior, round(near / interior, 6) AS ratio FROM m""")  # fmt: skip
def boundary_means(spark, sf_dir):
    hour = F.floor(F.unix_timestamp("ts") / 3600).cast("long")
    per = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("series"), hour.alias("z")).agg(F.count("*").cast("double").alias("n"))
    out = rays.boundary_means(rays.boundary_profile(per.withColumn("pos", F.col("z") % 8)))
    return out.withColumns({c: F.round(c, 6) for c in ("near", "interior", "ratio")})


@register("spiral_sense")
def spiral_sense(spark, sf_dir):
    """One row over all informative tracks (tested against a plain tracker)."""
    return spiral.spiral_sense(spiral.turn_advance(spiral.track(_spiral_runs(ship(spark), sf_dir), 60), 60))


@register("tile_id_fallback", """WITH t AS (SELECT DISTINCT l_orderkey // 500 AS tile, l_suppkey AS local FROM lineitem), g AS (SELECT DISTINCT tile, local, tile * 1000 + local AS gid FROM t WHERE tile % 3 <> 0 AND local % 5 <> 0),
  s AS (SELECT tile, local, local + 7 AS gid FROM t WHERE local % 2 = 0), have AS (SELECT DISTINCT tile FROM g)
  SELECT t.tile, t.local, coalesce(CASE WHEN h.tile IS NOT NULL THEN g.gid ELSE s.gid END, 0) AS gid FROM t LEFT JOIN have h ON h.tile = t.tile LEFT JOIN g ON g.tile = t.tile AND g.local = t.local LEFT JOIN s ON s.tile = t.tile AND s.local = t.local""")  # fmt: skip
def tile_id_fallback(spark, sf_dir):
    """Ids from the table of the whole where it knows the tile at all, from the slab's table else; both tables have planted gaps."""
    t = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 500).cast("long").alias("tile"), F.col("l_suppkey").alias("local")).distinct()
    whole = t.where("tile % 3 != 0 AND local % 5 != 0").withColumn("gid", F.col("tile") * 1000 + F.col("local"))
    slab = t.where("local % 2 = 0").withColumn("gid", F.col("local") + 7)
    return stitch.tile_ids(t, whole, slab)


@register("missing_slab_policies", """WITH h AS (SELECT DISTINCT l_orderkey // 500 AS slab FROM lineitem WHERE l_orderkey // 500 % 9 <> 4), w AS (SELECT DISTINCT CAST(o_orderkey // 500 AS BIGINT) AS slab FROM orders), m AS (SELECT count(*) AS n FROM w ANTI JOIN h USING (slab))
  SELECT 'fail' AS policy, CAST(CASE WHEN n > 0 THEN 0 ELSE (SELECT count(*) FROM w) END AS BIGINT) AS slabs, n AS missing, CASE WHEN n > 0 THEN 'failed' ELSE 'ok' END AS outcome FROM m
  UNION ALL SELECT 'stop', CAST(CASE WHEN n > 0 THEN 0 ELSE (SELECT count(*) FROM w) END AS BIGINT), n, CASE WHEN n > 0 THEN 'stopped' ELSE 'ok' END FROM m
  UNION ALL SELECT 'warn', (SELECT count(*) FROM w SEMI JOIN h USING (slab)), n, CASE WHEN n > 0 THEN 'warned' ELSE 'ok' END FROM m""")  # fmt: skip
def missing_slab_policies(spark, sf_dir):
    """What each policy makes of wanted slabs of which some are missing (a gap in nine is planted)."""
    slab = lambda c: F.floor(F.col(c) / 500).cast("long").alias("slab")
    have = table(spark, sf_dir, "lineitem").select(slab("l_orderkey")).where("slab % 9 != 4").distinct()
    return stitch.slab_policies(table(spark, sf_dir, "orders").select(slab("o_orderkey")).distinct(), have)


@register("seed_rows", """WITH s AS (SELECT o_custkey % 40 AS w, o_orderkey AS seed, CAST(90 + o_custkey * o_orderkey % 11 AS DOUBLE) AS pct FROM orders)
  SELECT w, '| ' || w || ' | ' || count(*) || ' | ' || count(*) FILTER (WHERE pct >= 97) || ' | ' || string_agg(CAST(seed AS VARCHAR), ', ' ORDER BY pct DESC, seed) || ' |' AS line FROM s GROUP BY w""")  # fmt: skip
def seed_rows(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("w"), F.col("o_orderkey").alias("seed"), (90 + F.col("o_custkey").cast("long") * F.col("o_orderkey") % 11).cast("double").alias("pct"))
    return sweep.seed_row(s, "w")


@register("mesh_winding_gaps", """WITH ax AS (SELECT CAST(l_linenumber * 40 AS DOUBLE) AS z, avg(l_quantity) AS cy, avg(l_tax) * 100 AS cx FROM lineitem GROUP BY 1),
  v AS (SELECT l_suppkey % 25 AS w, CAST(l_partkey % 280 + 1 AS DOUBLE) AS z, 100.0 + l_quantity + l_suppkey % 25 * 10 AS y, CAST(l_linenumber * 5 AS DOUBLE) AS x FROM lineitem),
  b AS (SELECT v.*, (SELECT max(z) FROM ax WHERE ax.z <= v.z) AS z0, (SELECT min(z) FROM ax WHERE ax.z >= v.z) AS z1 FROM v),
  i AS (SELECT b.w, b.z, b.y, b.x, CASE WHEN z0 IS NULL THEN q.cy WHEN z1 IS NULL OR z1 = z0 THEN p.cy ELSE p.cy + (q.cy - p.cy) * (b.z - z0) / (z1 - z0) END AS cy, CASE WHEN z0 IS NULL THEN q.cx WHEN z1 IS NULL OR z1 = z0 THEN p.cx ELSE p.cx + (q.cx - p.cx) * (b.z - z0) / (z1 - z0) END AS cx
    FROM b LEFT JOIN ax p ON p.z = z0 LEFT JOIN ax q ON q.z = z1),
  r AS (SELECT w, z, sqrt((y - cy) ** 2 + (x - cx) ** 2) AS r FROM i), pl AS (SELECT unnest([60.0, 140.0, 220.0]) AS z0),
  m AS (SELECT z0, w, median(r) AS r FROM r, pl WHERE abs(z - z0) < 30 GROUP BY z0, w HAVING count(*) >= 20),
  g AS (SELECT z0, lead(r) OVER (PARTITION BY z0 ORDER BY w) - r AS gap, lead(w) OVER (PARTITION BY z0 ORDER BY w) = w + 1 AS next FROM m)
  SELECT z0 AS z, count(*) AS n_gaps, round(median(gap) / 2, 5) AS dr, round(quantile_cont(gap, 0.75) - quantile_cont(gap, 0.25), 5) AS iqr FROM g WHERE next GROUP BY z0""")  # fmt: skip
def mesh_winding_gaps(spark, sf_dir):
    """Radius gaps of windings about an axis that is interpolated at each vertex, in bands around three planes."""
    li = table(spark, sf_dir, "lineitem")
    ax = li.groupBy((F.col("l_linenumber") * 40).alias("z")).agg(F.avg("l_quantity").alias("cy"), (F.avg("l_tax") * 100).alias("cx"))
    w = F.col("l_suppkey") % 25
    v = li.select(w.alias("w"), (F.col("l_partkey") % 280 + 1).cast("double").alias("z"), (100.0 + F.col("l_quantity") + w * 10).alias("y"), (F.col("l_linenumber") * 5).cast("double").alias("x"))
    planes = spark.createDataFrame([(60.0,), (140.0,), (220.0,)], "z0 double")
    out = sweep.winding_gaps(sweep.winding_radii(v, stage(ax, "axis"), planes))
    return out.withColumns({"dr": F.round("dr", 5), "iqr": F.round("iqr", 5)})


@register("validation_lines", f"""WITH d AS ({_DOC}), f AS (SELECT doc, CASE WHEN s = 9 THEN 'unreadable' WHEN s = 8 THEN 'unknown' WHEN s = 7 THEN 'umbilicus' ELSE 'point_collection' END AS kind,
    CAST((s > 0)::INT + CASE WHEN c >= 7593 AND s IN (0, 1, 2, 6) THEN 1 WHEN c >= 7593 AND s = 3 THEN 2 ELSE 0 END AS BIGINT) AS n FROM d)
  SELECT doc, kind, n = 0 AS ok, n AS n_violations, CAST((SELECT max(CASE WHEN n > 0 THEN 1 ELSE 0 END) FROM f) AS BIGINT) AS exit_code FROM f""")  # fmt: skip
def validation_lines(spark, sf_dir):
    """The validation report as JSON lines, read back, and its exit code."""
    lines, code = validate.report(_payloads(spark, sf_dir))
    path = _new(spark, "report")
    sinks.write_text(lines, path)
    back = spark.read.text(path).select(F.from_json("value", "doc long, kind string, ok boolean, violations array<struct<severity:string,rule:string,at:string>>").alias("r")).select("r.*")
    return back.select("doc", "kind", "ok", F.size("violations").cast("long").alias("n_violations"), F.lit(code).cast("long").alias("exit_code"))


@register("cleaning_components")
def cleaning_components(spark, sf_dir):
    """The cleaning report with the components of the gated mask that are large enough to stay (brute force in the tests)."""
    v = A.voxels(spark, sf_dir)
    return voxels.cleaning_report(v.withColumn("ct", F.col("v")), 32, 32, 30)


@register("rest_components")
def rest_components(spark, sf_dir):
    """Components of the labelled voxels whose label has no seed, by size (brute force in the tests)."""
    lab = A.labelled(spark, sf_dir)
    seeds = lab.where("depth >= 48 AND label % 7 != 3").select("slab", "label").distinct()
    found = voxels.rest_components(lab, lab.join(seeds, ["slab", "label"], "left_semi"), 32, 32)
    return found.groupBy("slab", "component").agg(F.count("*").alias("n")).groupBy("slab", "n").agg(F.count("*").alias("components"))


@register("vector_products", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
  SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i])), 6) AS dot, round(sqrt(list_sum(list_transform(a, lambda c: c * c))), 6) AS norm FROM p""")  # fmt: skip
def vector_products(spark, sf_dir):
    """Inner product of each vector with the next one, and its length."""
    from laminar.functions.columns import dot, norm

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return both.select("vec_id", F.round(dot(F.col("a"), F.col("b")), 6).alias("dot"), F.round(norm(F.col("a")), 6).alias("norm"))


_SEED = """p AS (SELECT l_suppkey % 20 AS gid, l_linenumber AS z, l_orderkey % 60 AS bin, l_quantity AS r FROM lineitem),
m AS (SELECT *, CASE WHEN r - lag(r) OVER (PARTITION BY gid, z, bin ORDER BY r) <= 4 THEN 0 ELSE 1 END AS s FROM p),
k AS (SELECT *, sum(s) OVER (PARTITION BY gid, z, bin ORDER BY r ROWS UNBOUNDED PRECEDING) AS c FROM m), a AS (SELECT gid, z, bin, c, count(*) AS n, median(r) AS r FROM k GROUP BY gid, z, bin, c),
rad AS (SELECT gid, z, bin, r FROM (SELECT *, row_number() OVER (PARTITION BY gid, z, bin ORDER BY n DESC, c) AS rn FROM a) WHERE rn = 1),
sc AS (SELECT gid, bin, count(*) AS n FROM rad GROUP BY gid, bin), tw AS (SELECT * FROM sc UNION ALL SELECT gid, bin + 60, n FROM sc),
wi AS (SELECT gid, bin, sum(n) OVER (PARTITION BY gid ORDER BY bin RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS total FROM tw),
be AS (SELECT gid, bin AS start FROM wi WHERE bin < 60 ORDER BY total DESC, gid, bin LIMIT 1),
ve AS (SELECT gid, dense_rank() OVER (ORDER BY z) - 1 AS rw, (bin - start + 60) % 60 AS cl, z, 60 + r * sin((bin + 0.5) * radians(6.0) - pi()) AS y, 60 + z + r * cos((bin + 0.5) * radians(6.0) - pi()) AS x
  FROM rad JOIN be USING (gid) WHERE (bin - start + 60) % 60 < 20)"""


def _seed(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    points = li.select((F.col("l_suppkey") % 20).alias("gid"), F.col("l_linenumber").alias("z"), (F.col("l_orderkey") % 60).alias("bin"), F.col("l_quantity").alias("r"))
    middle = li.select(F.col("l_linenumber").alias("z")).distinct().select("z", F.lit(60.0).alias("cy"), (F.col("z") + 60.0).alias("cx"))
    return spiral.seed_patch(points, 60, 20, 4.0, middle)


@register("seed_patch", f'WITH {_SEED} SELECT gid, rw AS "row", cl AS "col", z, round(y, 6) AS y, round(x, 6) AS x FROM ve')
def seed_patch(spark, sf_dir):
    """The grid of the instance that fills its best wedge of twenty bins most."""
    return _seed(spark, sf_dir).withColumns({c: F.round(c, 6) for c in "yx"})


@register("seed_patch_gate", f"""WITH {_SEED}, q AS (SELECT count(*) AS n FROM ve a JOIN ve b ON b.rw = a.rw AND b.cl = a.cl + 1 JOIN ve c ON c.rw = a.rw + 1 AND c.cl = a.cl JOIN ve d ON d.rw = a.rw + 1 AND d.cl = a.cl + 1),
  o AS (SELECT min(gid) AS gid, count(*) FILTER (WHERE NOT (y > 0 AND y < 130 AND x > 0 AND x < 110)) AS n_outside FROM ve)
  SELECT CAST(gid AS VARCHAR) AS uuid, n AS quads, n_outside, n >= 20 AND n_outside = 0 AS ok FROM q, o""")  # fmt: skip
def seed_patch_gate(spark, sf_dir):
    patch = _seed(spark, sf_dir).withColumn("uuid", F.col("gid").cast("string"))
    return spiral.patch_gate(stage(patch, "seed"), 20, 130.0, 110.0)


@register("output_checks", f"""WITH {_PTS}, r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY z, x, y) - 1 AS r0, count(*) OVER (PARTITION BY gid) AS n FROM (SELECT DISTINCT gid, z, y, x FROM pts)),
  s AS (SELECT gid, z, y, x FROM r WHERE n <= 40 OR r0 = 0 OR floor(r0 * 39.0 / greatest(n - 1, 1)) <> floor((r0 - 1) * 39.0 / greatest(n - 1, 1)))
  SELECT 'bounds' AS "check", count(*) AS n, count(*) FILTER (WHERE y > 1499) AS bad, count(*) > 0 AND count(*) FILTER (WHERE y > 1499) = 0 AS ok FROM s
  UNION ALL SELECT 'round_trip', least(200, count(*)), 0, true FROM s UNION ALL SELECT 'non_empty', count(DISTINCT gid), 0, true FROM s""")  # fmt: skip
def output_checks(spark, sf_dir):
    """Self-checks of sampled points; the bounds are set so that some lie outside."""
    points = stage(stratified_samples(spark, sf_dir), "sampled")
    return validate.output_checks(points, _points(spark, sf_dir).select("gid", "z", "y", "x"), (8, 1500, 1 << 40))
