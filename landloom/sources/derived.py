"""Tables in the shapes the operators expect, derived from the test tables.

Each is one SQL statement that Spark and DuckDB both read; a name in braces is
another derived table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events embeddings".split()

#: Ten optical values of a pixel, 0 to 10000, with nodata and dark pixels.
_DN = "CASE WHEN l_orderkey % 37 = 0 THEN 65535 WHEN l_orderkey % 41 = 0 THEN 0 ELSE CAST(({}) % 10001 AS INT) END"

DERIVED = {
    "ae_pixels": """SELECT vec_id AS sample_id, CAST(floor(vec_id / 25) AS BIGINT) AS px_row, vec_id % 25 AS px_col, CAST(vec_id % 4 AS INT) AS area,
        CAST(label + 1 AS INT) AS class_id, embedding AS ae FROM {embeddings}""",
    "class_pair": """SELECT l_orderkey AS px_row, l_linenumber AS px_col, l_partkey AS part, l_returnflag AS zone,
        CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE CAST(l_partkey % 10 + 1 AS INT) END AS c1,
        CASE WHEN l_orderkey % 29 = 0 THEN NULL WHEN l_orderkey % 3 > 0 THEN CAST(l_partkey % 10 + 1 AS INT) ELSE CAST(l_suppkey % 10 + 1 AS INT) END AS c2,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS u1, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS u2 FROM {lineitem}""",
    "class_year": """SELECT px_row, px_col, 2017 AS year, min(c1) AS class_id, min(u1) AS uncertainty FROM {class_pair} GROUP BY px_row, px_col
        UNION ALL SELECT px_row, px_col, 2024 AS year, max(c2) AS class_id, max(u2) AS uncertainty FROM {class_pair} GROUP BY px_row, px_col""",
    "band_pixels": f"""SELECT l_orderkey AS px_row, l_linenumber AS px_col, l_partkey AS part,
        {_DN.format("l_partkey * 7 + l_suppkey")} AS b2, {_DN.format("l_partkey * 3 + l_suppkey * 11 + 5")} AS b3, {_DN.format("l_partkey + l_orderkey * 13")} AS b4,
        {_DN.format("l_suppkey * 17 + l_orderkey")} AS b8, {_DN.format("l_partkey * 5 + l_orderkey * 3")} AS b11, {_DN.format("l_suppkey * 23 + l_partkey * 2")} AS b12
        FROM {{lineitem}}""",
    "map_stack": """SELECT l_orderkey AS px_row, l_linenumber AS px_col, l_partkey AS part, CAST(l_partkey % 9 AS INT) AS dw, CAST(l_suppkey % 16 AS INT) AS jaxa,
        CAST(l_orderkey % 15 AS INT) AS hr, CAST((l_partkey + l_suppkey) % 11 AS INT) AS study FROM {lineitem}""",
    "predictions": """SELECT concat('run_', CAST(l_linenumber AS VARCHAR(9))) AS run_name, CASE WHEN l_linenumber % 2 = 0 THEN 'AE64' ELSE 'AE64_plus10indices' END AS feature_set,
        CASE WHEN l_linenumber <= 2 THEN 'MLP' WHEN l_linenumber <= 4 THEN 'ResMLP' ELSE 'XGBoost' END AS model_family,
        CASE WHEN l_suppkey % 5 = 0 THEN 'val' ELSE 'test' END AS split, l_orderkey AS sample_id, CAST(l_orderkey % 50 AS INT) AS block_id,
        CAST(l_partkey % 10 + 1 AS INT) AS y_true, CAST(CASE WHEN l_orderkey % 3 > 0 THEN l_partkey % 10 + 1 ELSE l_suppkey % 11 + 1 END AS INT) AS y_pred,
        CAST(round(50 + l_discount * 490) AS INT) AS w1, CAST(round(l_tax * 250) AS INT) AS w2 FROM {lineitem}""",
    "scores": """SELECT run_name, split, sample_id, y_true, CASE WHEN y_pred > 10 THEN 10 ELSE y_pred END AS y_pred, w1 / 100.0 AS confidence, (100 - w1) / 100.0 AS uncertainty,
        (w1 - w2) / 100.0 AS margin FROM {predictions}""",
    "confusion": """SELECT run_name, feature_set, model_family, split, y_true, y_pred, count(*) AS n FROM {predictions}
        WHERE y_true BETWEEN 1 AND 10 AND y_pred BETWEEN 1 AND 10 GROUP BY run_name, feature_set, model_family, split, y_true, y_pred""",
    "block_confusion": """SELECT run_name, feature_set, model_family, block_id, y_true, y_pred, count(*) AS n FROM {predictions}
        WHERE split = 'test' AND y_true BETWEEN 1 AND 10 AND y_pred BETWEEN 1 AND 10 GROUP BY run_name, feature_set, model_family, block_id, y_true, y_pred""",
    "runs": """SELECT concat('run_', CAST(s_suppkey AS VARCHAR(9))) AS run_name, s_suppkey AS run_id,
        CASE s_nationkey % 6 WHEN 0 THEN 'cnn1d' WHEN 1 THEN 'FT-Transformer' WHEN 2 THEN 'lgbm' WHEN 3 THEN 'mlp' WHEN 4 THEN 'ResMLP' ELSE 'xgb' END AS family,
        CASE WHEN s_suppkey % 2 = 0 THEN 'ae64' ELSE 'ae64_plus10indices' END AS feature_set, CAST(s_suppkey % 10 AS INT) AS seed,
        CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE round(abs(s_acctbal) / 12000, 3) END AS val_f1, round((s_suppkey * 37 % 101) / 101.0, 3) AS test_f1,
        CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE round((s_suppkey * 53 % 97) / 97.0, 3) END AS val_loss, CAST(s_suppkey % 4 AS INT) AS depth, s_nationkey FROM {supplier}""",
    "landuse": """SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN ' Settlement' WHEN 1 THEN 'ROAD' WHEN 2 THEN 'Agricultural  Land' WHEN 3 THEN 'Water Bodies' WHEN 4 THEN 'Forest'
        WHEN 5 THEN 'Unknown' ELSE NULL END AS maj,
        CASE p_partkey % 6 WHEN 0 THEN 'Urban Built-up Area' WHEN 1 THEN 'Rural  Road ' WHEN 2 THEN 'Orchard' WHEN 3 THEN 'River' WHEN 4 THEN 'Pond' ELSE 'Other' END AS sub FROM {part}""",
    "parcel_year": """SELECT o_custkey AS parcel, CASE WHEN year(o_orderdate) % 2 = 0 THEN 2024 ELSE 2017 END AS year, min(o_orderkey % 10 + 1) AS class_id,
        max(o_totalprice) AS area_m2, min(o_orderpriority) AS kind FROM {orders} GROUP BY o_custkey, CASE WHEN year(o_orderdate) % 2 = 0 THEN 2024 ELSE 2017 END""",
    "observations": """SELECT event_id AS scene, user_id AS pixel, event_type AS band, ts, CAST(round(value * 100) AS INT) AS dn,
        CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 100) / 100.0 END AS qa, CAST(event_id % 40 AS INT) AS cloud FROM {events}""",
    "dem": """SELECT CAST(floor(vec_id / 25) AS BIGINT) AS px_row, vec_id % 25 AS px_col,
        CASE WHEN vec_id % 17 = 0 THEN NULL ELSE CAST((vec_id * 37) % 430 - 70 AS DOUBLE) END AS z FROM {embeddings}""",
    "tiles": """SELECT 0 AS tile, px_row, px_col, CASE WHEN sample_id % 5 = 0 THEN NULL ELSE class_id END AS value FROM {ae_pixels} WHERE px_col < 15
        UNION ALL SELECT 1 AS tile, px_row, px_col, CASE WHEN sample_id % 7 = 0 THEN NULL ELSE class_id + 10 END AS value FROM {ae_pixels} WHERE px_col >= 10
        UNION ALL SELECT 2 AS tile, px_row, px_col, CASE WHEN sample_id % 3 = 0 THEN NULL ELSE class_id + 20 END AS value FROM {ae_pixels} WHERE px_row % 4 < 2""",
    "zones": """SELECT n_nationkey AS zone_id, lower(n_name) AS zone, n_regionkey AS region, (n_nationkey % 5) * 5 + 0.25 AS x0, CAST(floor(n_nationkey / 5) AS INT) * 4 + 0.25 AS y0,
        (n_nationkey % 5) * 5 + 5.75 AS x1, CAST(floor(n_nationkey / 5) AS INT) * 4 + 4.75 AS y1 FROM {nation}""",
    "grids": """SELECT concat('g', CAST(s_suppkey AS VARCHAR(9))) AS grid_id, 32646 AS epsg, 10.0 AS a, -10.0 AS e, 200000.0 + s_nationkey * 10 + CASE s_suppkey % 3 WHEN 1 THEN 0.0000001 WHEN 2 THEN 5.0 ELSE 0.0 END AS c,
        2500000.0 AS f, 100 + CAST(s_suppkey % 2 AS INT) AS width, 80 AS height FROM {supplier}""",
}


def expanded(sql: str) -> str:
    """``sql`` with the names of derived tables replaced by subqueries and base tables by themselves."""

    def put(m: re.Match) -> str:
        name = m[1]
        return name if name in BASE else f"({expanded(DERIVED[name])})"

    return re.sub(r"\{(\w+)\}", put, sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a table derived from it."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = DERIVED[name]
    parts = {k: table(spark, sf_dir, k) for k in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **parts)
