"""Mixing of sources to target weights, in DataFrame operations only.

Weighted sampling without replacement after Efraimidis and Spirakis: a document
of quality weight w gets the key -ln(u) / w, and the documents of a source are
taken in ascending order of their keys until its budget of words is used up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landloom.llm.common import n_words, written

#: Rows of one source that one task sorts.
SORT_ROWS = 1_000
#: Buckets for each unit of a key's logarithm, and into how many parts a bucket is cut at a time.  Powers of 2, so that parts lie within their bucket exactly.
BUCKETS, PARTS = 16.0, 256.0
#: Finer parts than this cannot be told from each other.
FINEST = 2.0**44


def quality_weight(text, size) -> F.Column:
    """1 for clean text, less with symbols per word: 1 / (1 + symbols / words)."""
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    return F.lit(1.0) / (F.lit(1.0) + symbols.cast("double") / F.greatest(size, F.lit(1)))


def sampling_key(doc_id, text, size, seed: int) -> F.Column:
    """Exponential key scaled by quality: a function of the row alone, so reruns agree.

    Rows of equal id and text share a key and are decided together.
    """
    name = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / quality_weight(text, size)


def keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with _source, _size and _key of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(*keep, F.col(source_col).alias("_source"), F.col(id_col).alias("_doc"), text.alias("_text"), n_words(F.col(text_col)).cast("long").alias("_size"))
    return sized.withColumn("_key", sampling_key(F.col("_doc"), F.col("_text"), F.col("_size"), seed)).drop("_doc", "_text")


def targets(rows: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """Per source: source_size, n_rows and target; ``rows`` has _source and _size.

    Sources in order of code points, null last, take ``weights`` in turn.  The
    targets are a common level times the weight, at most ``cap`` times the
    source's size: what a capped source can't take is shared by weight again.
    The windows run over one row per source.
    """
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n_rows"))
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    each = sizes.withColumn("_rank", place).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("double"))
    each = each.withColumn("_cap", F.col("source_size") * F.lit(cap)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", "_rank")
    everything = Window.partitionBy()
    each = each.withColumn("_used", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    each = each.withColumn("_left", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    each = each.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(share) - F.col("_used")) / F.col("_left"))
    free = F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.struct("_ratio", "_rank", "_level"))
    each = each.withColumn("_level", F.min(free).over(everything)["_level"])
    return each.select("_source", "source_size", "n_rows", F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), F.col("_cap")).alias("target"))


def plan(rows: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """What each source takes, one row per source; ``rows`` has _source, _size, _key.

    ``epochs`` whole passes come first.  Of the rest, the documents whose
    bucket is below ``cut_bucket``, or in it with keys up to ``cut_key``, are
    those before the running sum of sizes passes the budget; ``closing_key`` is
    the document behind the cut whose size fits what is left of it best, if
    taking it comes nearer to the budget than leaving it.

    Sizes are summed in buckets of the key's logarithm.  The bucket in which
    the budget ends is cut into parts, and the part in which it ends again,
    until no such part holds more than ``SORT_ROWS`` rows; only these are sorted.
    """
    each = written(targets(rows, weights, share, cap), "mix-targets")
    each = each.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    each = each.withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    same = F.col("a._source").eqNullSafe(F.col("b._source"))
    grouped = rows.groupBy("_source", "_key").agg(F.sum("_size").alias("_size"))
    groups = written(grouped.alias("a").join(each.alias("b"), same).select("a.*", "b._rest"), "mix-groups")

    scale, inside = BUCKETS, groups.withColumn("_base", F.lit(0).cast("long"))
    while True:
        cut = written(where_it_ends(inside, scale), "mix-cut")
        if (cut.agg(F.max("_rows")).first()[0] or 0) <= SORT_ROWS or scale >= FINEST:
            break
        inside = groups.alias("a").join(cut.alias("b"), same & (bucket(F.col("a._key"), F.lit(scale)) == F.col("b.cut_bucket"))).select("a.*", F.col("b._before").alias("_base"))
        scale *= PARTS
    cut = cut.select("_source", "cut_bucket", "_before")
    groups = groups.withColumn("_bucket", bucket(F.col("_key"), F.lit(scale)))
    inside = groups.alias("a").join(cut.alias("b"), same & (F.col("a._bucket") == F.col("b.cut_bucket"))).select("a.*", "b._before")
    upto = Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    ends = inside.withColumn("_upto", F.sum("_size").over(upto) + F.col("_before")).groupBy("_source").agg(
        F.max(F.when(F.col("_upto") <= F.col("_rest"), F.col("_key"))).alias("cut_key"),
        F.coalesce(F.max(F.when(F.col("_upto") <= F.col("_rest"), F.col("_upto"))), F.min("_before")).alias("_taken"),
    )
    cut = cut.alias("a").join(ends.alias("b"), same).select("a._source", "a.cut_bucket", "b.cut_key", "b._taken")
    gap = F.col("_rest") - F.col("_taken")
    fits = F.when(~below_cut() & (F.col("_size") > 0) & (F.col("_size") < 2 * gap), F.struct(F.abs(F.col("_size") - gap).alias("off"), F.col("_key").alias("key")))
    closing = groups.alias("a").join(cut.alias("b"), same).select("a.*", "b.cut_bucket", "b.cut_key", "b._taken").groupBy("_source").agg(F.min(fits)["key"].alias("closing_key"))
    out = each.withColumn("_scale", F.lit(scale)).alias("a").join(cut.alias("b"), same, "left").select("a.*", "b.cut_bucket", "b.cut_key")
    out = out.alias("a").join(closing.alias("b"), same, "left").select("a.*", "b.closing_key")
    return written(out.select("_source", "source_size", "target", "epochs", "_scale", "cut_bucket", "cut_key", "closing_key"), "mix-plan")


def where_it_ends(inside: DataFrame, scale: float) -> DataFrame:
    """Per source the bucket in which its budget ends: cut_bucket, _before (words before it) and _rows.

    ``inside`` holds the rows of one bucket of each source, or of all, with the
    words before them in _base; so few rows of sums meet in a window.
    """
    sums = inside.groupBy("_source", bucket(F.col("_key"), F.lit(scale)).alias("_bucket")).agg(F.sum("_size").alias("_sum"), F.count("*").alias("_rows"), F.min("_rest").alias("_rest"), F.min("_base").alias("_base"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)) + F.col("_base"))
    over = sums.filter("_before + _sum > _rest").groupBy("_source").agg(F.min(F.struct("_bucket", "_before", "_rows")).alias("c"))
    return over.select("_source", F.col("c._bucket").alias("cut_bucket"), F.col("c._before").alias("_before"), F.col("c._rows").alias("_rows"))


def bucket(key, scale) -> F.Column:
    """Bucket of a key: its logarithm, some 45 wide for any weight, times ``scale``."""
    return F.floor((F.log(key) + 40.0) * scale)


def below_cut() -> F.Column:
    return F.coalesce((F.col("_bucket") < F.col("cut_bucket")) | ((F.col("_bucket") == F.col("cut_bucket")) & (F.col("_key") <= F.col("cut_key"))), F.lit(False))


def passes(rows: DataFrame, each: DataFrame) -> DataFrame:
    """Adds source_size, target and _times, how often the mix takes each row."""
    joined = rows.alias("a").join(each.alias("b"), F.col("a._source").eqNullSafe(F.col("b._source"))).drop(F.col("b._source"))
    joined = joined.withColumn("_bucket", bucket(F.col("_key"), F.col("_scale")))
    chosen = below_cut() | F.coalesce(F.col("_key") == F.col("closing_key"), F.lit(False))
    return joined.withColumn("_times", F.col("epochs") + F.when(chosen & (F.col("_size") > 0), 1).otherwise(0))


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, cap: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What a mix takes of each document: doc_id, size, source_size, target, taken.

    Sizes are words; the mix has ``share`` times all words, dealt to the sources
    by weight.  A document is taken whole, ``epochs`` times or once more, so a
    source misses its target by less than half a document, or by less than half
    of all rows that repeat one id and text: these stay and are decided
    together.  Null texts have size 0 and are never taken; a null source is a
    source of its own; an empty table gives no row.
    """
    rows = written(keyed(docs, seed, id_col, text_col, source_col, [F.col(id_col).alias("doc_id")]), "mix-rows")
    out = passes(rows, plan(rows, weights, share, cap))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_times")).alias("taken"))


def mixed(docs: DataFrame, weights: list[int], share: float = 1.5, cap: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix`` takes it.

    The texts are not shuffled: each row is held against its source's plan.
    Columns of ``docs`` may have any names but those that begin with ``_mix``.
    Rows without words, null texts among them, are never taken; repeated rows
    come equally often; an empty table gives no row.
    """
    rows = written(keyed(docs, seed, id_col, text_col, source_col, []), "mix-rows")
    each = plan(rows, weights, share, cap)
    full = keyed(docs.select(F.struct("*").alias("_mix_row"), id_col, text_col, source_col), seed, id_col, text_col, source_col, ["_mix_row"])
    times = passes(full, each).filter("_times > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return times.select("_mix_row.*")


def mix_sql(weights: list[int], share: float = 1.5, cap: float = 2.0, seed: int = 17) -> str:
    """DuckDB SQL for ``mix`` of the view ``documents``."""
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(body)), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE)
         / (1::DOUBLE / (1::DOUBLE + length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::DOUBLE / greatest(size, 1))) AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, ([{", ".join(map(str, weights))}])[(rk % {len(weights)} + 1)::INT]::DOUBLE AS w, source_size * {cap}::DOUBLE AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () * {share}::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
f AS (SELECT arg_min(lev, rk2) AS lev FROM (SELECT lev, row_number() OVER (ORDER BY cap / w, rk) AS rk2, w, cap FROM l) WHERE lev * w < cap),
t AS (SELECT source, source_size, coalesce(least(cap, f.lev * w), cap) AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
g AS (SELECT k.source, k.key, sum(k.size)::BIGINT AS size FROM k GROUP BY 1, 2),
c AS (SELECT g.*, e.target - e.epochs * e.source_size AS rest, sum(g.size) OVER (PARTITION BY g.source ORDER BY g.key ROWS UNBOUNDED PRECEDING) AS upto
      FROM g JOIN e ON g.source IS NOT DISTINCT FROM e.source),
p AS (SELECT source, coalesce(max(upto) FILTER (upto <= rest), 0) AS got FROM c GROUP BY source),
x AS (SELECT c.source, arg_min(c.key, {{'o': abs(c.size - (c.rest - p.got)), 'k': c.key}}) AS closing
      FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source
      WHERE c.upto > c.rest AND c.size > 0 AND c.size < 2 * (c.rest - p.got) GROUP BY c.source)
SELECT k.doc_id, k.size, e.source_size, e.target,
       (k.size * (e.epochs + CASE WHEN c.upto <= c.rest OR k.key = x.closing THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
JOIN c ON k.source IS NOT DISTINCT FROM c.source AND k.key = c.key
LEFT JOIN x ON k.source IS NOT DISTINCT FROM x.source"""
