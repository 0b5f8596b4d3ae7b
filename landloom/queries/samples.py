"""Queries of labelled samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom.functions.counter import mixed, mixed_sql
from landloom.operators import grid as G
from landloom.operators import pixels as P
from landloom.operators import sampling as S
from landloom.queries import query
from landloom.queries.accuracy import rounded
from landloom.sources.derived import table
from landloom.sources.shared import folder

_U = "xor(xor(px_row // 5 * 73856093, px_col // 5 * 19349663), 42::BIGINT * 83492791) % 10000000 / 10000000.0::DOUBLE"
SPLIT = f"(SELECT *, CASE WHEN u < 0.15 THEN 'test' WHEN u < 0.3 THEN 'val' ELSE 'train' END AS split, printf('%d:r%04d_c%04d', area, px_row // 5, px_col // 5) AS block_id FROM (SELECT *, {_U} AS u FROM {{ae_pixels}}))"


def samples(spark, d):
    s = G.with_blocks(table(spark, d, "ae_pixels"), 5)
    return s.withColumn("split", P.split_of(G.block_fraction(42), 0.15, 0.15))


@query("SELECT sample_id, class_id FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY area, sample_id * 7919 % 10007, sample_id) AS r FROM {ae_pixels}) WHERE r <= 20")
def w12_capped_sample(spark, d):
    order = [F.col("area"), F.col("sample_id") * 7919 % 10007, F.col("sample_id")]
    return S.capped(table(spark, d, "ae_pixels"), ["class_id"], order, 20, salts=4).select("sample_id", "class_id")


@query(f"""SELECT sample_id, class_id, split FROM (SELECT *, row_number() OVER (PARTITION BY class_id, split ORDER BY sample_id) AS q FROM (
 SELECT *, row_number() OVER (PARTITION BY class_id, area ORDER BY sample_id) AS r FROM {SPLIT}) WHERE r <= 10) WHERE (split = 'train' AND q <= 12) OR (split = 'val' AND q <= 4)""")
def w13_area_budgets(spark, d):
    return S.capped_by_area(samples(spark, d), 10, 12, 4, [F.col("sample_id")]).select("sample_id", "class_id", "split")


_BLOCKS = "CASE WHEN (px_row // 5 + px_col // 5) % 2 = 0 THEN 1 ELSE 2 END"
_PLACED = f"(SELECT *, {_BLOCKS} AS kind FROM {SPLIT})"


@query(f"""SELECT sample_id, kind AS class_id, split FROM (SELECT *, row_number() OVER (PARTITION BY kind, split ORDER BY sample_id) AS q FROM (
 SELECT *, row_number() OVER (PARTITION BY kind, area ORDER BY sample_id) AS r FROM {_PLACED} a WHERE split <> 'train' OR
 9 = (SELECT count(*) FROM {_PLACED} b WHERE abs(a.px_row - b.px_row) <= 1 AND abs(a.px_col - b.px_col) <= 1 AND a.kind = b.kind)) WHERE r <= 10) WHERE (split = 'train' AND q <= 12) OR (split = 'val' AND q <= 4)""")
def w13_eroded_budgets(spark, d):
    blocks = F.when((F.expr("px_row div 5") + F.expr("px_col div 5")) % 2 == 0, 1).otherwise(2)
    s = samples(spark, d).select("sample_id", "px_row", "px_col", "area", "split", blocks.alias("class_id"))
    return S.capped_by_area(S.eroded_training(s, 1), 10, 12, 4, [F.col("sample_id")]).select("sample_id", "class_id", "split")


@query(f"SELECT sample_id, class_id, {mixed_sql(42, 'sample_id')} AS key FROM {{ae_pixels}} ORDER BY key, sample_id")
def t07_shuffled(spark, d):
    rows = table(spark, d, "ae_pixels").select("sample_id", "class_id")
    return S.shuffled(rows.withColumn("key", mixed(42, F.col("sample_id"))), 42, ["sample_id"])


@query("SELECT class_id, n, round(raw / avg(raw) OVER (), 6) AS balanced, round((1.0 / n) / sum(1.0 / n) OVER () * 10, 6) AS inverse, round(n / sum(n) OVER (), 6) AS prior FROM (SELECT class_id, count(*) AS n, sum(count(*)) OVER () / (10 * count(*)) AS raw FROM {ae_pixels} GROUP BY 1)")
def a29_a30_a31_class_weights(spark, d):
    return rounded(S.class_weights(table(spark, d, "ae_pixels")), "balanced", "inverse", "prior")


@query(f"SELECT CAST(k - 1 AS INT) AS pos, round(avg(ae[k]::DOUBLE), 6) AS mu, round(stddev_pop(ae[k]::DOUBLE), 6) AS sigma FROM {SPLIT}, range(1, 65) r(k) WHERE split = 'train' GROUP BY k")
def a32_feature_statistics(spark, d):
    s = samples(spark, d).withColumn("ae", F.col("ae").cast("array<double>"))
    return rounded(S.feature_statistics(s, "ae"), "mu", "sigma")


@query(f"SELECT split, class_id, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 6) AS pct_split, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct_all FROM {SPLIT} GROUP BY 1, 2")
def a34_split_counts(spark, d):
    return rounded(S.split_counts(samples(spark, d)), "pct_split", "pct_all")


@query(f"SELECT split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {SPLIT} GROUP BY 1")
def a35_split_sizes(spark, d):
    return rounded(S.split_sizes(samples(spark, d)), "share")


@query(f"SELECT area, split, class_id, count(*) AS n FROM {SPLIT} GROUP BY ROLLUP (area, split, class_id)")
def a36_sample_statistics(spark, d):
    return S.sample_statistics(samples(spark, d))


@query(f"""SELECT split, list_filter(range(1, 11), lambda k: list_contains(seen, k)) AS present, list_filter(range(1, 11), lambda k: NOT list_contains(seen, k)) AS missing, list_filter(list_sort(seen), lambda k: k > 10) AS invalid
 FROM (SELECT split, list(DISTINCT CASE WHEN sample_id % 50 = 0 THEN 11 ELSE class_id END) AS seen FROM {SPLIT} WHERE class_id <> 4 GROUP BY 1)""")
def a37_label_presence(spark, d):
    s = samples(spark, d).filter("class_id <> 4").withColumn("class_id", F.when(F.col("sample_id") % 50 == 0, 11).otherwise(F.col("class_id")))
    return S.label_presence(s)


@query(f"SELECT DISTINCT area, block_id, split FROM {SPLIT}")
def a49_blocks_per_split(spark, d):
    return S.blocks_per_split(samples(spark, d))


@query("SELECT unnest(['length', 'not_finite', 'label_range', 'split_name', 'sample_id']) AS \"check\", unnest([0, 0, (SELECT count(*) FROM {ae_pixels} WHERE sample_id % 50 = 0), 0, 0]) AS offending, unnest([true, true, (SELECT count(*) FROM {ae_pixels} WHERE sample_id % 50 = 0) = 0, true, true]) AS ok")
def v04_archive_checks(spark, d):
    s = samples(spark, d).withColumn("class_id", F.when(F.col("sample_id") % 50 == 0, 11).otherwise(F.col("class_id")))
    return S.archive_checks(s, "ae", 64)


@query("SELECT count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, 1.0::DOUBLE AS finite_share FROM (SELECT unnest(ae)::DOUBLE AS v FROM {ae_pixels})")
def v05_array_summary(spark, d):
    return rounded(S.array_summary(table(spark, d, "ae_pixels"), "ae"), "mean", "std")


@query("SELECT (SELECT count(*) FROM {ae_pixels}) AS n, 0::BIGINT AS differing")
def v10_sample_replay(spark, d):
    one = samples(spark, d).select("sample_id", "block_id", "split", "class_id")
    two = samples(spark, d).repartition(7).select("sample_id", "block_id", "split", "class_id")
    return one.agg(F.count("*").alias("n")).join(one.exceptAll(two).unionByName(two.exceptAll(one)).agg(F.count("*").alias("differing")), how="cross")


@query(f"SELECT count(*) AS n, CAST(2 * count(*) FILTER (u >= 0.25 AND u < 0.3) AS BIGINT) AS differing FROM {SPLIT}")
def v10_replay_with_other_shares(spark, d):
    at = folder(spark)
    samples(spark, d).select("sample_id", "split").write.parquet(at)
    stored, again = spark.read.parquet(at), G.with_blocks(table(spark, d, "ae_pixels"), 5).withColumn("split", P.split_of(G.block_fraction(42), 0.1, 0.15)).select("sample_id", "split")
    return stored.agg(F.count("*").alias("n")).join(stored.exceptAll(again).unionByName(again.exceptAll(stored)).agg(F.count("*").alias("differing")), how="cross")


@query(f"""WITH rows AS (SELECT sample_id, class_id, row_number() OVER (PARTITION BY class_id ORDER BY {mixed_sql(0, 'sample_id')}, sample_id) - 1 AS place FROM {{ae_pixels}}),
 kinds AS (SELECT class_id, n, row_number() OVER (ORDER BY class_id) - 1 AS k, count(*) OVER () AS kinds FROM (SELECT class_id, count(*) AS n FROM rows GROUP BY 1)),
 draws AS (SELECT copy, {mixed_sql(42, '0', 'copy')} AS a, {mixed_sql(42, '1', 'copy')} AS b FROM (SELECT unnest(range(count(*))) AS copy FROM rows))
 SELECT r.sample_id, r.class_id, copy FROM draws JOIN kinds ON (a * kinds) >> 32 = k JOIN rows r ON r.class_id = kinds.class_id AND r.place = (b * n) >> 32""")
def m10_balanced_draw(spark, d):
    return S.balanced_draw(table(spark, d, "ae_pixels").select("sample_id", "class_id"), 42, ["sample_id"])


@query("SELECT s_suppkey, s_acctbal >= 0 AND s_acctbal / 10000 + 0.25::DOUBLE < 1 AS valid FROM {supplier}")
def v09_valid_shares(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", P.valid_shares(F.col("s_acctbal") / 10000, F.lit(0.25)).alias("valid"))
