"""Operator 10: mixing sources to target weights by pivotal dependent rounding, DataFrame functions only.

Every document of a source should appear target / size times on average. The whole part is taken as it
is; the fractions are rounded by pivotal steps: two open documents exchange words until one of them is at
0 or 1, at odds that keep both expectations, and the words of the two together do not change. Documents
are dealt by hash into buckets of a bounded expected size; each bucket settles all but one document, and
the open ones go on to the next level of a reduction tree. Per source at most one rounding is left over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminar.llm.pigeonhole import small
from laminar.storage import stage

WORDS = r"[^\x20\x09-\x0D]+"

# One pivotal step on acc.p (open document) and x: up and down are the most that acc.p may rise or fall.
_STEP = """
transform(transform(array(struct(
    least(1D - acc.open.p, x.p * x.s / acc.open.s) AS up,
    least(acc.open.p, (1D - x.p) * x.s / acc.open.s) AS down,
    shiftrightunsigned(xxhash64({seed}, acc.open.h, x.h), 11) * 1.1102230246251565E-16D AS u)),
  t -> CASE WHEN t.u * (t.up + t.down) < t.down THEN
    CASE WHEN 1D - acc.open.p <= x.p * x.s / acc.open.s
      THEN struct(1D AS a, greatest(0D, x.p - t.up * acc.open.s / x.s) AS b, true AS first)
      ELSE struct(least(1D, acc.open.p + t.up) AS a, 0D AS b, false AS first) END
  ELSE
    CASE WHEN acc.open.p <= (1D - x.p) * x.s / acc.open.s
      THEN struct(0D AS a, least(1D, x.p + t.down * acc.open.s / x.s) AS b, true AS first)
      ELSE struct(greatest(0D, acc.open.p - t.down) AS a, 1D AS b, false AS first) END
  END),
  r -> CASE WHEN r.first
    THEN struct(named_struct('h', x.h, 'id', x.id, 't', x.t, 's', x.s, 'p', r.b) AS open,
                array_append(acc.done, struct(acc.open.id AS id, acc.open.t AS t, acc.open.s AS s, r.a AS p)) AS done)
    ELSE struct(named_struct('h', acc.open.h, 'id', acc.open.id, 't', acc.open.t, 's', acc.open.s, 'p', r.a) AS open,
                array_append(acc.done, struct(x.id AS id, x.t AS t, x.s AS s, r.b AS p)) AS done) END)[0]
"""


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Per source: ``source, source_size, n, target``.

    Sources in code point order, null last, get the weights in turn; targets are shares of all sizes by
    weight, no target above ``most`` times its source's size, the excess shared by weight among the rest.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("k") % len(weights) + 1)
    ranked = by_source.withColumn("k", (F.row_number().over(order) - 1).cast("int")).withColumn("w", w)
    ranked = ranked.withColumn("cap", most * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "k")
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = ranked.withColumn("level", (total - before) / rest).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    one = level.withColumn("all_level", F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("cap") / F.col("w"))).over(Window.partitionBy()))
    return one.select("source", "source_size", "n", F.least("cap", F.col("all_level") * F.col("w")).alias("target"))


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7, fan: int = 64) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, text_hash, size, source_size, target, copies, taken``.

    ``size`` is the number of words (a null text has none), ``taken`` is ``size * copies``. A document
    without words has one copy and takes nothing. Rows that agree on id, source and text are one unit and
    get the same copies. Null ids and null sources are values like any other; columns other than
    ``doc_id, source, text`` are not read. The result depends on the rows alone, not on their order or
    partitioning, so reruns agree. The table of sources is broadcast while it has at most 20,000 rows.
    """
    words = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORDS))).cast("long")
    rows = stage(docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words.alias("size")), "sizes")
    targets = stage(source_targets(rows, weights, most).withColumn("sid", F.xxhash64("source", F.col("source").isNull())), "targets")
    about = targets.agg(F.count("*").alias("sources"), F.max("n").alias("most")).first()
    units = rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("m"))
    units = units.withColumn("sid", F.xxhash64("source", F.col("source").isNull()))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.join(small(targets.select("sid", "source_size", "n", "target"), about["sources"]), "sid").withColumn("ratio", ratio)
    part = F.col("ratio") - F.floor("ratio")
    part = F.when(part < 1e-12, 0.0).when(part > 1 - 1e-12, 1.0).otherwise(part)
    units = stage(units.withColumns({"base": F.floor("ratio").cast("int"), "p": part}), "units")

    fraction = units.where("p > 0 AND p < 1 AND size > 0")
    now = fraction.select(
        "sid", F.col("n").alias("left"), F.struct(F.xxhash64(F.lit(seed), "doc_id", "text_hash", "size").alias("h"), F.col("doc_id").alias("id"), F.col("text_hash").alias("t"), (F.col("size") * F.col("m")).cast("double").alias("s"), "p").alias("x")
    )
    settled, height = None, about["most"] or 0
    while True:
        last = height <= fan
        height = -(-height // fan)
        dealt = now.withColumn("left", F.ceil(F.col("left") / fan)).withColumn("bucket", F.expr(f"pmod(xxhash64({seed}, x.h, {height}L), left)"))
        held = dealt.groupBy("sid", "left", "bucket").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        fold = f"""aggregate(slice(xs, 2, size(xs)),
            named_struct('open', xs[0], 'done', CAST(array() AS array<struct<id:{_type(units, 'doc_id')},t:bigint,s:double,p:double>>)),
            (acc, x) -> CASE WHEN acc.open.p <= 0D OR acc.open.p >= 1D
              THEN struct(x AS open, array_append(acc.done, struct(acc.open.id AS id, acc.open.t AS t, acc.open.s AS s, acc.open.p AS p)) AS done)
              ELSE {_STEP.format(seed=seed)} END)"""
        level = stage(held.select("sid", "left", F.expr(fold).alias("r")), "pivot")
        done = level.select("sid", F.explode("r.done").alias("d")).select("sid", "d.*")
        settled = done if settled is None else settled.union(done)
        now = level.select("sid", "left", F.col("r.open").alias("x"))
        if last:
            break
    toss = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col("x.h")), 11) * F.lit(2.0**-53)
    final = now.select("sid", F.col("x.id").alias("id"), F.col("x.t").alias("t"), F.col("x.s").alias("s"), F.when(toss < F.col("x.p"), 1.0).otherwise(0.0).alias("p"))
    settled = settled.union(final).select("sid", F.col("id").alias("doc_id"), F.col("t").alias("text_hash"), F.col("p").cast("int").alias("more"))
    u, s = units.alias("u"), settled.alias("s")
    both = u.join(s, (F.col("u.sid") == F.col("s.sid")) & (F.col("u.text_hash") == F.col("s.text_hash")) & F.col("u.doc_id").eqNullSafe(F.col("s.doc_id")), "left")
    copies = F.when(F.col("u.size") == 0, 1).otherwise(F.col("u.base") + F.coalesce("s.more", F.col("u.p").cast("int")))
    out = both.select("u.*", copies.cast("int").alias("copies"))
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("m"))))
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (dropped at 0), with all its columns, whatever their names.

    Nulls, empty texts, repeated rows and empty tables are treated as ``mix_copies`` says; texts stay as they are.
    """
    decided = mix_copies(docs, weights, most, seed).select("doc_id", "source", "text_hash", "copies").distinct()
    c = decided.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("text_hash").alias("t"), "copies").alias("c")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).alias("d")
    same = F.col("d.doc.doc_id").eqNullSafe(F.col("c.i")) & F.col("d.doc.source").eqNullSafe(F.col("c.s")) & (F.col("d.h") == F.col("c.t"))
    taken = d.join(c, same).select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("k"))
    return taken.select([F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
