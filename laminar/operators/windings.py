"""Winding constraints: pairs of adjacent runs, gap gates, cycle checks, same-winding filters and points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminar.functions.columns import closed_bucket, half_even
from laminar.graph import conflicts, offset_components
from laminar.storage import stage


def dominant_ids(hits: DataFrame) -> DataFrame:
    """``slab, theta, k, gid, pos``: per crossing its commonest id (smallest on ties) and the id's sample
    nearest to the centre of the run."""
    votes = hits.groupBy("slab", "theta", "k", "gid").agg(F.count("*").alias("c"))
    best = votes.groupBy("slab", "theta", "k").agg(F.min_by("gid", F.struct((-F.col("c")).alias("m"), "gid")).alias("gid"))
    centre = hits.groupBy("slab", "theta", "k").agg(((F.min("r") + F.max("r")) / 2).alias("mid"))
    held = hits.join(best, ["slab", "theta", "k", "gid"]).join(centre, ["slab", "theta", "k"])
    return held.groupBy("slab", "theta", "k").agg(F.first("gid").alias("gid"), F.first("mid").alias("mid"), F.min_by("r", F.struct(F.abs(F.col("r") - F.col("mid")).alias("d"), "r")).alias("pos"))


def neighbourhood_pitch(cells: DataFrame, keys: DataFrame, bins: int, reach: int = 3, fallback: float = 10.0) -> DataFrame:
    """``slab, theta, pitch``: median pitch over slabs within 1 and bins within ``reach``, wrapping around."""
    wide = keys.select("slab", "theta").distinct()
    wide = wide.withColumn("s2", F.explode(F.sequence(F.col("slab") - 1, F.col("slab") + 1)))
    wide = wide.withColumn("t2", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.pmod(F.col("theta") + d, F.lit(bins)))))
    near = cells.where("pitch IS NOT NULL").select(F.col("slab").alias("s2"), F.col("theta").alias("t2"), "pitch")
    return wide.join(near, ["s2", "t2"], "left").groupBy("slab", "theta").agg(F.coalesce(F.median("pitch"), F.lit(fallback)).alias("pitch"))


def adjacent_pairs(runs: DataFrame) -> DataFrame:
    """``slab, theta, k, a, b, gap``: each run with the next one outwards."""
    along = Window.partitionBy("slab", "theta").orderBy("k")
    pairs = runs.select("slab", "theta", "k", F.col("gid").alias("a"), F.lead("gid").over(along).alias("b"), (F.lead("mid").over(along) - F.col("mid")).alias("gap"))
    return pairs.where("b IS NOT NULL AND a != b")


def gap_window(pairs: DataFrame, pitch: DataFrame, low: float = 0.6, high: float = 1.4) -> DataFrame:
    """Pairs whose gap is ``low`` to ``high`` pitches, with ``ratio``."""
    both = pairs.join(pitch, ["slab", "theta"]).withColumn("ratio", F.col("gap") / F.col("pitch"))
    return both.where(F.col("ratio").between(low, high))


def pair_support(pairs: DataFrame) -> DataFrame:
    """Per unordered pair: ``lo, hi, n, n_up, n_down, slabs, sectors`` and the observation nearest to one pitch."""
    p = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b"), "up": F.col("a") < F.col("b")})
    first = F.struct(F.abs(F.col("ratio") - 1).alias("score"), "slab", "theta", "k")
    best = F.min_by(F.struct("slab", "theta", "k"), first)
    out = p.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.count_if("up").alias("n_up"), F.count_if(~F.col("up")).alias("n_down"), F.countDistinct("slab").alias("slabs"), F.countDistinct(F.floor(F.col("theta") / 10)).alias("sectors"), best.alias("best"))
    return out.select("lo", "hi", "n", "n_up", "n_down", "slabs", "sectors", F.col("best.slab").alias("best_slab"), F.col("best.theta").alias("best_theta"), F.col("best.k").alias("best_k"))


def consistent_pairs(support: DataFrame, least: int = 2) -> DataFrame:
    """Pairs seen ``least`` times in one orientation only: ``inner, outer, n``."""
    good = support.where((F.col("n") >= least) & ((F.col("n_up") == 0) | (F.col("n_down") == 0)))
    up = F.col("n_up") > 0
    return good.select(F.when(up, F.col("lo")).otherwise(F.col("hi")).alias("inner"), F.when(up, F.col("hi")).otherwise(F.col("lo")).alias("outer"), "n")


def gap_histogram(ratios: DataFrame, low: float = 0.6, high: float = 1.4, bins: int = 16, smooth: int = 5) -> DataFrame:
    """``bin, n, smoothed``: counts and their moving mean, zero beyond the ends."""
    every = ratios.sparkSession.range(bins).select(F.col("id").alias("bin"))
    counts = ratios.select(closed_bucket(F.col("ratio"), low, high, bins).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    full = every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    frame = Window.orderBy("bin").rowsBetween(-(smooth // 2), smooth // 2)  # one row per bin
    return full.withColumn("smoothed", F.sum("n").over(frame) / float(smooth))


def histogram_gate(histogram: DataFrame, low: float = 0.6, high: float = 1.4, bins: int = 16, peak: tuple = (0.8, 1.2), tail_from: float = 1.3, tail_most: float = 0.15) -> DataFrame:
    """One row: ``peak, tail, ok``: centre of the highest smoothed bin, share beyond ``tail_from``, verdict."""
    width = (high - low) / bins
    centre = F.lit(low) + (F.col("bin") + 0.5) * width
    total = histogram.select(centre.alias("c"), "n", "smoothed", "bin")
    out = total.agg(F.max_by("c", F.struct("smoothed", (-F.col("bin")).alias("m"))).alias("peak"), (F.sum(F.when(F.col("c") > tail_from, F.col("n")).otherwise(0)) / F.sum("n")).alias("tail"))
    return out.withColumn("ok", F.col("peak").between(*peak) & (F.col("tail") < tail_most))


def observed_pairs(pairs: DataFrame, least: int = 2) -> DataFrame:
    """``inner, outer, n, pos``: consistent pairs with the place (slab, theta, k) of their first observation."""
    first = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min(F.struct("slab", "theta", "k")).alias("pos"))
    good = consistent_pairs(pair_support(pairs), least).withColumns({"lo": F.least("inner", "outer"), "hi": F.greatest("inner", "outer")})
    return good.join(first, ["lo", "hi"]).select("inner", "outer", "n", "pos")


def relative_windings(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windings along +1 edges ``inner, outer, pos``, and the edges with ``component`` and ``conflict``.

    Edges are taken in the order of ``pos``: one that contradicts those before it is a conflict and is dropped; what remains is
    consistent, so no further round is needed. Windings are ``component, node, winding``, 0 for the innermost of a component;
    components may have any size (see ``offset_components``).
    """
    plain = edges.select(F.col("inner").alias("src"), F.col("outer").alias("dst"), F.lit(1).cast("long").alias("delta"), "pos")
    placed = stage(offset_components(plain), "windings")
    low = placed.groupBy("component").agg(F.min("offset").alias("low"))
    windings = placed.join(low, "component").select("component", "node", (F.col("offset") - F.col("low")).alias("winding"))
    checked = conflicts(plain, placed).select("component", F.col("src").alias("inner"), F.col("dst").alias("outer"), "conflict")
    return windings, checked


def instance_details(points: DataFrame, bins: int = 12, least: int = 20) -> DataFrame:
    """Per id of ``gid, z, r, theta_deg, inside``: size, interior share, z extent, mean angle and the
    count-weighted mean of the radial deviation within angular bins of at least ``least`` points."""
    whole = points.groupBy("gid").agg(
        F.count("*").alias("volume"), (F.count_if(F.col("inside")) / F.count("*")).alias("deep_frac"), F.min("z").alias("z_min"), F.max("z").alias("z_max"),
        F.degrees(F.atan2(F.avg(F.sin(F.radians("theta_deg"))), F.avg(F.cos(F.radians("theta_deg"))))).alias("mean_theta"),
    )
    per_bin = points.groupBy("gid", F.floor(F.col("theta_deg") / (360.0 / bins)).alias("b")).agg(F.count("*").alias("c"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("s2"))
    per_bin = per_bin.where(F.col("c") >= least).withColumn("sd", F.sqrt(F.greatest(F.col("s2") / F.col("c") - F.pow(F.col("s") / F.col("c"), 2), F.lit(0.0))))
    spread = per_bin.groupBy("gid").agg((F.sum(F.col("c") * F.col("sd")) / F.sum("c")).alias("sigma"))
    return whole.join(spread, "gid", "left")


def first_rejection(details: DataFrame, total: int, pitch: float, mega: float = 0.03, deep: float = 0.10, sigma: float = 0.30) -> DataFrame:
    """``details`` with ``rejected``: the first rule that an instance fails, else null."""
    return details.withColumn(
        "rejected",
        F.when(F.col("volume") >= mega * total, "mega").when(F.col("deep_frac") > deep, "thickness").when(F.coalesce("sigma", F.lit(0.0)) > sigma * pitch, "radial"),
    )


def points_wanted(volume, per: int = 1500, low: int = 3, high: int = 20):
    """How many points an instance contributes: its volume over ``per``, rounded half to even, within bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), half_even(volume / float(per))))


def budgeted(instances: DataFrame, budget: int) -> DataFrame:
    """Largest instances first while points last; the last one is clipped. ``instances`` has ``gid, volume, k``, ``k`` at least 1.

    As each takes a point, the first ``budget`` of them are enough: the running sum is over these.
    """
    instances = instances.orderBy(F.desc("volume"), "gid").limit(budget)
    along = Window.orderBy(F.desc("volume"), "gid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("k").over(along)
    return instances.withColumn("upto", upto).where(F.col("upto") - F.col("k") < budget).withColumn("k", F.least(F.col("k"), budget - (F.col("upto") - F.col("k")))).drop("upto")


def stratified(rows: DataFrame, by: list[str], order: str, want: int) -> DataFrame:
    """Rows at ``want`` even ranks of each group along ``order`` (all rows of smaller groups)."""
    w = Window.partitionBy(*by).orderBy(order)
    n = F.count("*").over(Window.partitionBy(*by))
    placed = rows.withColumns({"__r": F.row_number().over(w) - 1, "__n": n})
    slot = F.floor(F.col("__r") * (want - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    before = F.floor((F.col("__r") - 1) * (want - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    return placed.where((F.col("__n") <= want) | (F.col("__r") == 0) | (slot != before)).drop("__r", "__n")


def z_chunks(points: DataFrame, k: int) -> DataFrame:
    """``points`` (``gid, z, y, x``, distinct) with ``chunk``: the part of ``least(k, n)`` even ones, along z, y, x, that a point of an
    instance of n points falls in; the first parts are one larger where n does not divide.

    Places are counted axis by axis: planes of an instance, lines of a plane, points of a line.
    """
    lines = points.groupBy("gid", "z", "y").agg(F.count("*").alias("c"))
    planes = lines.groupBy("gid", "z").agg(F.sum("c").alias("c"))
    before = lambda *by: F.coalesce(F.sum("c").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    planes = planes.select("gid", "z", before("gid", "z").alias("above"), F.sum("c").over(Window.partitionBy("gid")).alias("n"))
    lines = lines.select("gid", "z", "y", before("gid", "z", "y").alias("left"))
    at = F.row_number().over(Window.partitionBy("gid", "z", "y").orderBy("x")) - 1
    placed = points.withColumn("at", at).join(lines, ["gid", "z", "y"]).join(planes, ["gid", "z"])
    pos, m = F.col("at") + F.col("left") + F.col("above"), F.least(F.lit(k), F.col("n"))
    q, r = F.floor(F.col("n") / m), F.col("n") % m
    chunk = F.when(pos < r * (q + 1), F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - r * (q + 1)) / q))
    return placed.select("gid", "z", "y", "x", chunk.cast("int").alias("chunk"))


_AT = ["gid", "z", "y", "x"]


def _cells(apart: float) -> list:
    return [F.floor(F.col(c) / apart).cast("long").alias(f"c{c}") for c in "zyx"]


def _marked(points: DataFrame, apart: float) -> DataFrame:
    """``gid, z, y, x, chunk`` with their order and cells, which follow from the point: staged tables and shuffles go without them."""
    return points.select(*_AT, "chunk", F.struct(F.xxhash64(*_AT).alias("h"), "z", "y", "x").alias("o"), *_cells(apart))


def _around(points: DataFrame) -> DataFrame:
    """Points repeated for their own and the 26 neighbouring cells."""
    for c in ("cz", "cy", "cx"):
        points = points.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    return points


def _far_from(points: DataFrame, chosen: DataFrame, apart: float) -> DataFrame:
    """``points`` (with cells) that no chosen point of their instance is nearer to than ``apart``. Chosen points keep that distance
    among themselves, so those around a cell are few."""
    near = _around(chosen.select(*_AT, *_cells(apart))).groupBy("gid", "cz", "cy", "cx").agg(F.collect_list(F.struct("z", "y", "x")).alias("__c"))
    close = F.expr(f"exists(__c, c -> (c.z - z) * (c.z - z) + (c.y - y) * (c.y - y) + (c.x - x) * (c.x - x) < {float(apart * apart)})")
    return points.join(near, ["gid", "cz", "cy", "cx"], "left").where(~F.coalesce(close, F.lit(False))).drop("__c")


def _pairs_before(late: DataFrame, early: DataFrame, before, apart: float) -> DataFrame:
    """Points of ``late`` (key ``gid, z, y, x``) with a point of ``early`` (``qz, qy, qx``) that comes ``before`` and is nearer than ``apart``."""
    q = early.select("gid", "cz", "cy", "cx", F.col("z").alias("qz"), F.col("y").alias("qy"), F.col("x").alias("qx"), F.col("o").alias("qo"), F.col("chunk").alias("qchunk"))
    d = sum((F.col(c) - F.col(f"q{c}")) * (F.col(c) - F.col(f"q{c}")) for c in "zyx")
    return _around(late).join(q, ["gid", "cz", "cy", "cx"]).where(before).where(d < apart * apart).select(*_AT, "qz", "qy", "qx")


def _one_a_chunk(points: DataFrame, apart: float) -> DataFrame:
    """Chunk by chunk along z, the first point in order that keeps its distance from those of earlier chunks.

    Chunks are settled side by side: the first open point of a chunk is its choice as soon as no open point of an earlier,
    unsettled chunk lies near it.
    """
    open_, found = points, None
    while open_.head(1):
        heads = open_.groupBy("gid", "chunk").agg(F.min("o").alias("o")).select("gid", "chunk", "o", *[F.col(f"o.{c}").alias(c) for c in "zyx"])
        heads = stage(heads.select("*", *_cells(apart)), "chunkheads")
        waiting = _pairs_before(heads, open_, F.col("qchunk") < F.col("chunk"), apart).select(*_AT).distinct()
        chosen = stage(heads.join(waiting, _AT, "left_anti").select(*_AT, "chunk"), "chunkpicks")
        found = chosen if found is None else found.unionByName(chosen)
        left = open_.join(chosen.select("gid", "chunk"), ["gid", "chunk"], "left_anti")
        open_ = _marked(stage(_far_from(left, chosen, apart).select(*_AT, "chunk"), "chunkopen"), apart)
    return found


def _independent(points: DataFrame, apart: float) -> DataFrame:
    """The points that a pass in order would keep, each if no kept one is nearer than ``apart``: in rounds, a point is kept when no
    open point before it lies near it, and those near it go."""
    pairs = stage(_pairs_before(points, points, F.col("qo") < F.col("o"), apart), "nearpairs")
    q = ["gid", "qz", "qy", "qx"]
    as_q = lambda t: t.select("gid", *[F.col(c).alias(f"q{c}") for c in "zyx"])
    open_, found = stage(points.select(*_AT), "nearopen"), None
    while open_.head(1):
        live = pairs.join(open_, _AT, "left_semi").join(as_q(open_), q, "left_semi")
        kept = stage(open_.join(live.select(*_AT).distinct(), _AT, "left_anti"), "nearkept")
        found = kept if found is None else found.unionByName(kept)
        gone = pairs.join(as_q(kept), q, "left_semi").select(*_AT).distinct()
        open_ = stage(open_.join(kept, _AT, "left_anti").join(gone, _AT, "left_anti"), "nearopen")
    return found


def spaced_points(points: DataFrame, k: int = 20, apart: float = 5.0, batch: int = 16) -> DataFrame:
    """Up to ``k`` points per ``gid``, no two closer than ``apart`` (``gid, z, y, x``): one a chunk along z first, then others.

    The choice is that of a pass in the order of a hash: an instance's points are cut into ``k`` even chunks along z, each of which
    gives its first point that keeps the distance; then all points are gone through until ``k`` are found. Rounds of joins over
    grid cells of size ``apart`` make it; the second part takes ``batch * k`` open points an instance at a time, which bounds
    their pairs. Repeated points count once, null coordinates are left out.
    """
    distinct = stage(points.select(*[F.col(c).cast("long").alias(c) for c in _AT]).dropna().distinct(), "spots")
    spots = _marked(stage(z_chunks(distinct, k), "chunks"), apart)
    found = _one_a_chunk(spots, apart)
    if found is None:
        return distinct
    found = stage(found.select(*_AT), "spaced")
    lacking = lambda: found.groupBy("gid").agg((F.lit(k) - F.count("*")).alias("need")).where("need > 0")
    left = stage(_far_from(spots.join(lacking().select("gid"), "gid", "left_semi"), found, apart).select(*_AT, "chunk"), "spacedleft")
    while left.head(1):
        need = lacking()
        left = _marked(left, apart).join(need.select("gid"), "gid", "left_semi")
        first = F.row_number().over(Window.partitionBy("gid").orderBy("o"))
        some = stage(left.withColumn("r", first).where(F.col("r") <= batch * k).drop("r"), "spacedsome")
        if not some.head(1):
            break
        kept = _independent(some, apart).join(some.select(*_AT, "o"), _AT).join(need, "gid")
        kept = stage(kept.withColumn("r", first).where(F.col("r") <= F.lit(k)).where("r <= need").select(*_AT), "spacedkept")
        upto = some.groupBy("gid").agg(F.max("o").alias("upto"))
        left = stage(_far_from(left.join(upto, "gid").where("o > upto").drop("upto"), kept, apart).select(*_AT, "chunk"), "spacedleft")
        found = stage(found.unionByName(kept), "spaced")
    return found


def circular_peak(counts: DataFrame, by: list[str], bins: int, width: int) -> DataFrame:
    """``by, start, total``: the run of ``width`` bins, wrapping around, with the largest sum (lowest start)."""
    twice = counts.select(*by, "bin", "n").union(counts.select(*by, F.col("bin") + bins, "n"))
    frame = Window.partitionBy(*by).orderBy("bin").rangeBetween(0, width - 1)
    sums = twice.withColumn("total", F.sum("n").over(frame)).where(F.col("bin") < bins)
    best = sums.groupBy(*by).agg(F.max_by("bin", F.struct("total", (-F.col("bin")).alias("m"))).alias("start"), F.max("total").alias("total"))
    return best


def largest_cluster(values: DataFrame, by: list[str], value: str, gap: float) -> DataFrame:
    """Per group: clusters split where sorted values are more than ``gap`` apart; size and median of the
    largest (the first on ties)."""
    from laminar.functions.islands import islands, prev

    runs = islands(values, by, value, F.col(value) - prev(value, by, value) > gap, "cluster")
    sized = runs.groupBy(*by, "cluster").agg(F.count("*").alias("n"), F.median(value).alias("middle"))
    best = F.min_by(F.struct("n", "middle"), F.struct((-F.col("n")).alias("m"), "cluster"))
    return sized.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.n").alias("n"), F.col("b.middle").alias("middle"))


def knn_pairs(points: DataFrame, reach: float, k: int, finest: int = 8) -> DataFrame:
    """``src, dst, d``: for each point its ``k`` nearest within ``reach`` (ties to the smaller id), over grids of cells of ``reach``
    and of its halves, quarters and so on (``finest`` times).

    A point looks in the finest grid in which its own cell holds ``k`` others: the k-th nearest of these bounds its distance, and only
    the cells within that bound are looked up, by an equi-join. So the comparisons of a point do not grow with the number of points in
    ``reach``. Of points at one place only the ``k + 1`` smallest ids can be among the nearest of any.
    """
    zyx, size = ["z", "y", "x"], F.lit(float(reach)) / F.pow(F.lit(2.0), F.col("level"))
    cell = [F.floor(F.col(c) / size).cast("long").alias(f"c{c}") for c in zyx]
    held = points.select("id", *zyx).where("z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL")
    same = F.row_number().over(Window.partitionBy(*zyx).orderBy("id"))
    held = stage(held.withColumn("r", same), "knnpoints")
    leveled = held.where(F.col("r") <= k + 1).select("id", *zyx, F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("level")).select("id", *zyx, "level", *cell)
    at = ["level", "cz", "cy", "cx"]
    full = leveled.groupBy(*at).count().where(F.col("count") > k).select(*at)
    own = held.select("id", *zyx, F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("level")).select("id", "level", *cell).join(full, at, "left_semi")
    level = own.groupBy("id").agg(F.max("level").alias("level"))
    asks = stage(held.join(level, "id", "left").select(F.col("id").alias("src"), *[F.col(c).alias(f"{c}1") for c in zyx], F.coalesce("level", F.lit(0)).alias("level"), F.col("level").isNotNull().alias("known")), "knnasks")
    there = leveled.select(F.col("id").alias("dst"), *[F.col(c).alias(f"{c}2") for c in zyx], *at)
    d = F.sqrt(sum(F.pow(F.col(f"{c}1") - F.col(f"{c}2"), 2) for c in zyx))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))

    def meet(asking: DataFrame) -> DataFrame:
        return asking.join(there, at).where("src != dst").withColumn("d", d)

    first = meet(asks.where("known").select("*", *[F.floor(F.col(f"{c}1") / size).cast("long").alias(f"c{c}") for c in zyx])).select("src", "dst", "d")
    bound = first.withColumn("r", rank).where(F.col("r") == k).select("src", F.col("d").alias("most"))
    near = asks.join(bound, "src", "left").withColumn("most", F.least(F.coalesce("most", F.lit(float(reach))), F.lit(float(reach))))
    wide = F.col("most") * (1 + 1e-9) + 1e-12
    for c in zyx:
        near = near.withColumn(f"c{c}", F.explode(F.sequence(F.floor((F.col(f"{c}1") - wide) / size).cast("long"), F.floor((F.col(f"{c}1") + wide) / size).cast("long"))))
    found = meet(near).where((F.col("d") <= F.col("most")) & (F.col("d") < reach)).select("src", "dst", "d")
    return found.withColumn("r", rank).where(F.col("r") <= k).select("src", "dst", "d")
