"""Validation of constraint documents as rule tables: every broken rule is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminar.storage import stage

BOUNDS = (7593.0, 7593.0, 23247.0)  # fixed values: exclusive upper bounds of x, y, z
KNOWN = ("name", "points", "metadata", "color")


def parse(docs: DataFrame) -> DataFrame:
    """``doc, v, kind``: payloads as VARIANT (null: unreadable) and the kind of file they are."""
    v = F.try_parse_json("payload")
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    umbilicus = _get("$.control_points").isNotNull()
    collection = _get("$.collections").isNotNull() | _get("$.vc_pointcollections_json_version").isNotNull()
    kind = F.when(F.col("v").isNull(), "unreadable").when(is_object & umbilicus, "umbilicus").when(is_object & collection, "point_collection").otherwise("unknown")
    return docs.select("doc", "payload", v.alias("v")).select("doc", "payload", "v", kind.alias("kind"))


def _get(path: str, kind: str = "variant", of: str = "v") -> Column:
    return F.expr(f"try_variant_get({of}, '{path}', '{kind}')")


def _type(column: str) -> Column:
    return F.schema_of_variant(F.col(column))


def _numeric(column: str) -> Column:
    return _type(column).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")


def collections(parsed: DataFrame) -> DataFrame:
    """``doc, key, c``: the collections of each document."""
    one = parsed.where("kind = 'point_collection'").select("doc", _get("$.collections").alias("cs"))
    one = one.where(_type("cs").startswith("OBJECT"))
    return one.lateralJoin(one.sparkSession.tvf.variant_explode_outer(F.col("cs").outer())).select("doc", F.col("key"), F.col("value").alias("c")).where("key IS NOT NULL")


def points(cs: DataFrame) -> DataFrame:
    """``doc, key, point, p``: the points of each collection."""
    one = cs.withColumn("ps", _get("$.points", of="c")).where(_type("ps").startswith("OBJECT")).select("doc", F.col("key").alias("ckey"), "ps")
    return one.lateralJoin(one.sparkSession.tvf.variant_explode(F.col("ps").outer())).select("doc", F.col("ckey").alias("key"), F.col("key").alias("point"), F.col("value").alias("p"))


def _rule(where: Column, severity: str, rule: str, *at: str) -> Column:
    """The broken rule as a struct, null where it holds."""
    place = F.concat_ws("/", *at) if at else F.lit("")
    return F.when(where, F.struct(place.alias("at"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule")))


def _broken(df: DataFrame, *rules: Column, more: Column | None = None) -> DataFrame:
    """``doc, at, severity, rule``: all rules of one level in one pass."""
    found = F.array_compact(F.array(*rules))
    return df.select("doc", F.explode(found if more is None else F.concat(found, more)).alias("r")).select("doc", "r.*")


def violations(docs: DataFrame) -> DataFrame:
    """``doc, at, severity, rule`` for documents ``doc, payload``. Payloads are parsed once and staged; then one pass a level."""
    return _violations(stage(parse(docs).drop("payload"), "parsed"))


def _violations(parsed: DataFrame) -> DataFrame:
    """Broken rules of parsed documents, level by level (documents, collections, points, axes)."""
    cs = collections(parsed)
    ps = points(cs).withColumn("xyz", _get("$.p", of="p")).withColumn("coords", F.expr("try_variant_get(xyz, '$', 'array<double>')"))
    top = parsed.withColumn("ver", _get("$.vc_pointcollections_json_version"))
    listed = F.col("kind") == "point_collection"
    three = (F.size("coords") == 3) & ~F.exists("coords", lambda x: x.isNull() | F.isnan(x))
    plain = _type("xyz").rlike("^ARRAY<(BIGINT|DOUBLE|DECIMAL)")
    sound = F.coalesce(plain & three, F.lit(False))
    inside = F.forall(F.arrays_zip(F.col("coords"), F.array(*[F.lit(b) for b in BOUNDS]).alias("b")), lambda t: (t["coords"] >= 0) & (t["coords"] < t["b"]))
    wind = ps.groupBy("doc", "key").agg(F.count(_get("$.wind_a", of="p")).alias("w"), F.count("*").alias("n"))
    umb = parsed.where("kind = 'umbilicus'").withColumn("cp", _get("$.control_points"))
    axis = umb.lateralJoin(umb.sparkSession.tvf.variant_explode(F.col("cp").outer())).select("doc", "pos", F.col("value").alias("p"))
    axis = axis.select("doc", "pos", *[_get(f"$.{a}", "double", "p").alias(a) for a in ("z", "y", "x")])
    unknown = F.filter(F.json_object_keys(F.to_json("c")), lambda f: ~f.isin(*KNOWN))
    unknown = F.transform(unknown, lambda f: F.struct(F.concat_ws("/", F.col("key"), f).alias("at"), F.lit("warning").alias("severity"), F.lit("unknown_key").alias("rule")))
    none = F.array().cast("array<struct<at:string,severity:string,rule:string>>")
    parts = [
        _broken(
            top,
            _rule(F.col("kind") == "unreadable", "error", "unreadable"),
            _rule(F.col("kind") == "unknown", "error", "unknown_kind"),
            _rule(listed & (F.col("ver").isNull() | ~((_type("ver") == "STRING") & (F.expr("try_variant_get(ver, '$', 'string')") == "1"))), "error", "version"),
            _rule(listed & ~F.coalesce(F.schema_of_variant(_get("$.collections")).startswith("OBJECT"), F.lit(False)), "error", "collections"),
        ),
        _broken(
            cs,
            _rule(~F.coalesce(F.schema_of_variant(_get("$.name", of="c")) == "STRING", F.lit(False)), "error", "name", "key"),
            _rule(~F.coalesce(F.schema_of_variant(_get("$.points", of="c")).startswith("OBJECT"), F.lit(False)), "error", "points", "key"),
            _rule(~F.coalesce(F.schema_of_variant(_get("$.metadata", of="c")).startswith("OBJECT"), F.lit(True)), "error", "metadata", "key"),
            _rule(F.coalesce(_get("$.color", of="c").isNotNull() & (F.size(F.expr("try_variant_get(c, '$.color', 'array<double>')")) != 3), F.lit(False)), "error", "color", "key"),
            more=F.coalesce(unknown, none),
        ),
        _broken(ps, _rule(~sound, "error", "coordinates", "key", "point"), _rule(sound & ~inside, "error", "bounds", "key", "point")),
        _broken(wind, _rule((F.col("w") > 0) & (F.col("w") < F.col("n")), "error", "mixed_wind", "key")),
        _broken(umb.join(axis.groupBy("doc").count(), "doc", "left"), _rule(F.coalesce("count", F.lit(0)) < 2, "error", "too_few_points")),
        _broken(
            axis,
            _rule(F.col("z").isNull() | F.col("y").isNull() | F.col("x").isNull(), "error", "axis", "pos"),
            _rule(~(F.col("z").between(0, BOUNDS[2]) & F.col("y").between(0, BOUNDS[1]) & F.col("x").between(0, BOUNDS[0])), "error", "axis_bounds", "pos"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def file_stats(docs: DataFrame) -> DataFrame:
    """``doc, kind, n_collections, n_points, n_errors, n_warnings, ok`` per document."""
    parsed = stage(parse(docs).drop("payload"), "parsed")
    return _stats(parsed, _violations(parsed))


def _stats(parsed: DataFrame, broken: DataFrame) -> DataFrame:
    cs = collections(parsed)
    n_c = cs.groupBy("doc").agg(F.count("*").alias("n_collections"))
    n_p = points(cs).groupBy("doc").agg(F.count("*").alias("n_points"))
    bad = broken.groupBy("doc").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    out = parsed.select("doc", "kind").join(n_c, "doc", "left").join(n_p, "doc", "left").join(bad, "doc", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_collections", "n_points", "n_errors", "n_warnings")]
    return out.select("doc", "kind", *zero).withColumn("ok", F.col("n_errors") == 0)


def round_trip(points_: DataFrame, owners: DataFrame, least: float = 0.9) -> DataFrame:
    """One row: hits, misses, unresolved and rate of points whose id is looked up again where they lie."""
    found = points_.join(owners.withColumnRenamed("gid", "found"), ["slab", "y", "x"], "left")
    counts = found.agg(F.count_if(F.col("found") == F.col("gid")).alias("hits"), F.count_if(F.col("found") != F.col("gid")).alias("misses"), F.count_if(F.col("found").isNull()).alias("unresolved"))
    rate = F.col("hits") / (F.col("hits") + F.col("misses"))
    return counts.select("hits", "misses", "unresolved", rate.alias("rate"), (rate >= least).alias("ok"))


def pack_manifest(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``name, status``: full outer join of expected and found files ``name[, valid]``."""
    both = expected.withColumn("e", F.lit(True)).join(found.withColumn("f", F.lit(True)), "name", "full")
    status = F.when(F.col("e").isNull(), "skipped").when(F.col("f").isNull() & F.col("optional"), "placeholder").when(F.col("f").isNull(), "missing").when(~F.col("valid"), "invalid").otherwise("copied")
    return both.select("name", status.alias("status"))


def dated_manifest(expected: DataFrame, files: DataFrame) -> DataFrame:
    """``name, status, bytes, modified_utc``: the manifest of a pack with sizes and times. ``files`` are those of ``file_times``, in
    which empty files are not there; ``expected`` has ``name, optional``."""
    found = files.select("name", F.lit(True).alias("valid"))
    return pack_manifest(expected, found).join(files.select("name", "bytes", "modified_utc"), "name", "left")


def report(docs: DataFrame) -> tuple[DataFrame, int]:
    """One JSON line per document (``doc, value``: its figures and its violations) and the exit code: 1 where any is in error."""
    parsed = stage(parse(docs).drop("payload"), "parsed")
    broken = stage(_violations(parsed), "violations")
    found = broken.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("severity", "rule", "at"))).alias("violations"))
    rows = stage(_stats(parsed, broken).join(found, "doc", "left"), "report")
    value = F.to_json(F.struct("doc", "kind", "n_collections", "n_points", "n_errors", "n_warnings", "ok", F.coalesce("violations", F.array().cast("array<struct<severity:string,rule:string,at:string>>")).alias("violations")))
    return rows.select("doc", value.alias("value")), int(rows.where("NOT ok").limit(1).count())


def output_checks(points_: DataFrame, owners: DataFrame, shape: tuple[int, int, int], sample: int = 200) -> DataFrame:
    """``check, n, bad, ok`` of collections ``gid, z, y, x``: points in bounds; the ids where ``sample`` of them lie (those of smallest
    hash; ``owners`` has ``gid, z, y, x``), none there counting as bad; at least one collection."""
    outside = ~(F.col("z").between(0, shape[0] - 1) & F.col("y").between(0, shape[1] - 1) & F.col("x").between(0, shape[2] - 1))
    bounds = points_.agg(F.count("*").alias("n"), F.count_if(outside).alias("bad")).withColumn("check", F.lit("bounds"))
    some = points_.orderBy(F.xxhash64("gid", "z", "y", "x"), "gid", "z", "y", "x").limit(sample)
    there = owners.select(F.col("gid").alias("found"), "z", "y", "x")
    back = some.join(there, ["z", "y", "x"], "left").groupBy("gid", "z", "y", "x").agg(F.max(F.coalesce(F.col("found") == F.col("gid"), F.lit(False))).alias("same"))
    trip = back.agg(F.count("*").alias("n"), F.count_if(~F.col("same")).alias("bad")).withColumn("check", F.lit("round_trip"))
    some_at_all = points_.agg(F.countDistinct("gid").alias("n")).withColumns({"bad": F.when(F.col("n") == 0, 1).otherwise(0).cast("long"), "check": F.lit("non_empty")})
    every = bounds.unionByName(trip).unionByName(some_at_all)
    return every.select("check", "n", "bad", ((F.col("n") > 0) & (F.col("bad") == 0)).alias("ok"))
