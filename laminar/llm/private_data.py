"""Operator 9: personal data spans and information-theoretic sanitisation, DataFrame functions only.

Base spans are addresses, numbers and cards found by fixed patterns. The corpus tells which terms give a
protected value away: with P(e) the share of documents that mention value e and P(e | t) its share among
documents that have term t, a term discloses log(P(e | t) / P(e)) of the log(1 / P(e)) bits that name e.
Terms whose share of disclosed bits reaches the threshold are spans wherever they stand, in any document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminar.llm.pigeonhole import small
from laminar.llm.sieve import sieve
from laminar.storage import stage

KINDS = ("email", "ip", "card", "phone")
# Possessive quantifiers and the look-behind change no match (a failed run of characters fails from any
# later start too); they keep the search linear and free of recursion on very long runs.
_PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(t, '@') > 0"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"t rlike '[0-9]\\.[0-9]'"),
    "card": (r"[0-9](?:[ -]?[0-9])++", "t rlike '[0-9](?:[ -]?[0-9]){11}'"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "instr(t, '+') > 0"),
}
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = f"""aggregate(transform(filter(split(reverse({_DIGITS}), ''), c -> c != ''),
    (c, i) -> IF(i % 2 = 1, int(c) * 2 - IF(int(c) > 4, 9, 0), int(c))), 0, (a, c) -> a + c) % 10 = 0"""
_FITS = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), c -> length(ltrim('0', c)) <= 3 AND int('0' || right(ltrim('0', c), 3)) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
TERM = r"\p{L}[\p{L}\p{M}]*"
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"


def _spans(kind: str) -> str:
    """SQL for the spans of one kind in column ``t``: matches, placed by the lengths of what lies between."""
    pattern, chance = _PATTERNS[kind]
    lit = "'" + pattern.replace("\\", "\\\\") + "'"
    walk = f"""aggregate(zip_with(regexp_extract_all(t, {lit}, 0), slice(split(t, {lit}, -1), 1, size(regexp_extract_all(t, {lit}, 0))), (m, gap) -> struct(m AS m, length(gap) AS g)),
      named_struct('at', 0, 'out', CAST(array() AS {SPAN})),
      (acc, x) -> named_struct('at', acc.at + x.g + length(x.m), 'out',
        IF(exists(array(x.m), m -> {_FITS[kind]}),
           array_append(acc.out, named_struct('start', acc.at + x.g, 'ord', {KINDS.index(kind)}, 'end', acc.at + x.g + length(x.m), 'kind', '{kind}', 'value', x.m)), acc.out)),
      acc -> acc.out)"""
    return f"CASE WHEN {chance} THEN {walk} ELSE CAST(array() AS {SPAN}) END"


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, tkey, spans``: text hash and base spans in order."""
    t = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = t.withColumns({k: F.expr(_spans(k)) for k in KINDS}).withColumn("spans", F.array_sort(F.concat(*KINDS)))
    return found.select(id_col, F.xxhash64("t").alias("tkey"), "spans")


def _terms(text: str) -> F.Column:
    """Different terms of a text, in lower case."""
    return F.array_distinct(F.expr(f"regexp_extract_all(lower({text}), '{TERM}', 0)".replace("\\", "\\\\")))


def _places() -> str:
    """SQL: where the terms in ``wanted`` stand in ``t``."""
    lit = "'" + TERM.replace("\\", "\\\\") + "'"
    return f"""aggregate(zip_with(regexp_extract_all(t, {lit}, 0), slice(split(t, {lit}, -1), 1, size(regexp_extract_all(t, {lit}, 0))), (m, gap) -> struct(m AS m, length(gap) AS g)),
      named_struct('at', 0, 'out', CAST(array() AS array<struct<start:int,end:int>>)),
      (acc, x) -> named_struct('at', acc.at + x.g + length(x.m), 'out',
        IF(array_contains(wanted, lower(x.m)), array_append(acc.out, named_struct('start', acc.at + x.g, 'end', acc.at + x.g + length(x.m))), acc.out)),
      acc -> acc.out)"""


def disclosing_spans(base: DataFrame, docs: DataFrame, text_col: str = "text", threshold: float = 0.8, min_contexts: int = 3) -> DataFrame:
    """``tkey, start, end``: every occurrence, in any text, of a term that discloses a value.

    A term counts once in each text that mentions the value, at any distance, and wherever it stands in the corpus; a text is taken
    whole in both counts. It needs ``min_contexts`` different texts with the same value (copies of one text are one), and to
    disclose ``threshold`` of its bits; a value that all documents mention has none. Terms that overlap a base span are left to it.

    Values that are mentioned by the same texts are one class, and so are terms that stand in the same ones of these: their
    common counts are equal, so a page of many values and many terms is counted once, not value by term.
    """
    holds = base.where(F.size("spans") > 0)
    copies = holds.groupBy("tkey").agg(F.count("*").alias("copies"), F.first("spans").alias("spans"))
    values = stage(copies.select("tkey", "copies", F.explode(F.expr("array_distinct(transform(spans, s -> s.value))")).alias("value")), "values")
    by_text = [F.expr("bit_xor(xxhash64(tkey))").alias("x"), F.sum(F.expr("xxhash64(tkey, 1) % 1000000007")).alias("s"), F.count("*").alias("texts")]
    n_docs = docs.count()
    sets = values.groupBy("value").agg(*by_text, F.sum("copies").alias("n_e")).where((F.col("texts") >= min_contexts) & (F.col("n_e") < n_docs))
    mentions = stage(sets.groupBy("x", "s", "texts", "n_e").agg(F.min("value").alias("value")).select("value", "n_e"), "mentions")
    held = stage(values.join(mentions.select("value"), "value").select("value", "tkey", "copies"), "mentioned")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("tkey", F.xxhash64("t"))
    about = sieve(texts, "tkey", held.select("tkey").distinct()).dropDuplicates(["tkey"]).join(held.select("tkey").distinct(), "tkey", "left_semi")
    words = stage(about.select("tkey", F.explode(_terms("t")).alias("term")), "words")
    classes = words.groupBy("term").agg(*by_text).where(F.col("texts") >= min_contexts)
    classes = stage(classes.select("term", F.min("term").over(Window.partitionBy("x", "s", "texts")).alias("class")), "termclasses")
    one = words.join(classes.where("term = class").select("term"), "term")
    joint = held.join(one, "tkey").groupBy("value", F.col("term").alias("class")).agg(F.sum("copies").alias("joint"), F.count("*").alias("texts"))
    joint = stage(joint.where(F.col("texts") >= min_contexts).select("value", "class", "joint"), "joint")
    terms = stage(classes.join(joint.select("class").distinct(), "class").select("term", "class"), "terms")
    seen = sieve(docs.select(F.explode(_terms(text_col)).alias("term")), "term", terms)
    df = seen.groupBy("term").agg(F.count("*").alias("df"))  # counted before the join: a row a term
    shares = joint.join(mentions, "value").join(terms.join(df, "term"), "class")
    p_e = F.col("n_e") / F.lit(float(n_docs))
    disclosed = F.log(F.col("joint") / F.col("df") / p_e) / -F.log(p_e)
    telling = stage(shares.where(disclosed >= threshold).select("term").distinct(), "telling")
    holding = sieve(texts.select("tkey", F.explode(_terms("t")).alias("term")), "term", telling).join(telling, "term")
    holding = stage(holding.groupBy("tkey").agg(F.collect_set("term").alias("wanted")), "holding")
    spans = sieve(base.select("tkey", "spans"), "tkey", holding).dropDuplicates(["tkey"])
    one = sieve(texts, "tkey", holding).dropDuplicates(["tkey"])  # copies go before the shuffle
    placed = one.join(holding, "tkey").select("tkey", F.explode(F.expr(_places())).alias("w"))
    placed = placed.join(spans, "tkey").where("NOT exists(spans, s -> s.start < w.end AND w.start < s.end)")
    return placed.select("tkey", "w.start", "w.end")


def find_private_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, min_contexts: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``id_col, tkey, spans, added``: base spans, and the method's own.

    A null text is an empty one and has none. Ids and other columns do not matter to the result, so null
    and repeated ids are rows like any other; an empty table gives none. Offsets count code points, the
    end is exclusive. Spans are ordered by start, then kind.
    """
    base = stage(base_spans(docs, id_col, text_col), "base")
    extra = disclosing_spans(base, docs, text_col, threshold, min_contexts)
    one = F.struct(F.col("start"), F.lit(len(KINDS)).alias("ord"), F.col("end"), F.lit("term").alias("kind"), F.lit("").alias("value"))
    extra = stage(extra.groupBy("tkey").agg(F.array_sort(F.collect_list(one)).alias("added")), "extra")
    out = base.select(id_col, "tkey", "spans").join(small(extra, extra.count()), "tkey", "left")
    return out.withColumn("added", F.coalesce("added", F.expr(f"CAST(array() AS {SPAN})")))


def span_text(spans) -> F.Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` with every span of its text generalised to its kind in brackets, all columns kept, whatever their names.

    Null and empty texts stay as they are, null and repeated ids are rows like others, an empty table gives no rows.
    Overlapping spans are replaced from the last start to the first; one that reaches into a span already
    replaced is cut there.
    """
    found = find_private_data(docs, id_col, text_col, threshold).where("size(spans) + size(added) > 0")
    found = stage(found.dropDuplicates(["tkey"]).select("tkey", F.array_sort(F.concat("spans", "added")).alias("all")), "spans")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tkey"))
    joined = d.join(small(found, found.count()), "tkey", "left")
    new = F.expr(
        f"""aggregate(reverse(all), named_struct('t', doc.`{text_col}`, 'from', 2147483647),
        (acc, s) -> named_struct('t', concat(substring(acc.t, 1, s.start), '[', s.kind, ']', substring(acc.t, least(s.end, acc.from) + 1)), 'from', s.start), acc -> acc.t)"""
    )
    text = F.when(F.col("all").isNull(), F.col(f"doc.`{text_col}`")).otherwise(new)
    return joined.select([text.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
