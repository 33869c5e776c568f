"""Queries: joins with profiles, counts, summaries, pivots."""

from pyspark.sql import Window, functions as F

from ..functions import geo
from ..operators import enrich, profile
from ..operators.clean import complete, well_located
from ..operators.quantiles import exact_quantiles
from .adapter import SQL_OBS, observations, table, with_rounded
from .catalogue import query


@query("enriched_month_profile", """
  WITH o AS (SELECT o_orderkey AS id, c_mktsegment || '/' || o_orderpriority AS label, o_orderdate,
               (o_orderkey * 37) % 181 - 90 >= 0 AS north
             FROM orders JOIN customer ON o_custkey = c_custkey WHERE (o_orderkey * 7919) % 60000 <= 40000),
  j AS (SELECT o.*, l_quantity, l_extendedprice, l_discount FROM o JOIN lineitem ON l_orderkey = id
        WHERE l_quantity IS NOT NULL),
  big AS (SELECT label FROM j GROUP BY label HAVING count(*) >= 5)
  SELECT label, CAST(month(o_orderdate) AS INTEGER) AS month, round(avg(l_quantity) + 1e-9, 6) AS quantity,
    round(avg(l_extendedprice) + 1e-9, 6) AS price, round(avg(l_discount) + 1e-9, 6) AS discount, count(*) AS n,
    count(*) FILTER (WHERE north) AS n_north
  FROM j WHERE label IN (SELECT label FROM big) GROUP BY ALL""")
def enriched_month_profile(spark, folder):
    """Mean readings by (label, month) of well-located observations in large classes."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    i = F.col("o_orderkey")
    obs = o.join(c.select("c_custkey", "c_mktsegment"), o.o_custkey == c.c_custkey).select(
        i.alias("id"), F.concat_ws("/", "c_mktsegment", "o_orderpriority").alias("label"),
        F.col("o_orderdate").alias("observed_on"), ((i * 37) % 181 - 90).alias("latitude"),
        ((i * 7919) % 60000).cast("double").alias("public_positional_accuracy"))
    obs = well_located(complete(obs, ["label", "public_positional_accuracy"]))
    readings = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    joined = complete(enrich.join_readings(obs, readings), ["quantity"])
    # One aggregate per (label, month); class sizes are sums of at most 12 of its
    # rows, so the joined table is neither built twice nor shuffled by label.
    groups = joined.groupBy("label", F.month("observed_on").alias("month")).agg(
        F.avg("quantity").alias("quantity"), F.avg("price").alias("price"),
        F.avg("discount").alias("discount"), F.count(F.lit(1)).alias("n"),
        F.count_if(geo.hemisphere("latitude") == 1).alias("n_north"))
    size = F.sum("n").over(Window.partitionBy("label"))
    large = groups.withColumn("size", size).where("size >= 5").drop("size")
    return with_rounded(large, "quantity", "price", "discount")


@query("value_counts", """
  SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def value_counts(spark, folder):
    o = table(spark, folder, "orders")
    o = o.withColumn("o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    return profile.value_counts(o, "o_orderpriority")


@query("level_counts", """
  SELECT 'p_type' AS level, p_type AS label, count(*) AS n FROM part GROUP BY ALL
  UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY ALL
  UNION ALL SELECT 'p_name', p_name, count(*) FROM part GROUP BY ALL""")
def level_counts(spark, folder):
    return profile.level_counts(table(spark, folder, "part"), ["p_type", "p_brand", "p_name"])


@query("level_label_sets", """
  SELECT DISTINCT 'p_type' AS level, p_type AS label FROM part
  UNION SELECT DISTINCT 'p_brand', p_brand FROM part WHERE p_size % 7 <> 0
  UNION SELECT DISTINCT 'p_name', p_name FROM part WHERE p_size % 7 <> 0 AND p_type <> 'PROMO'""")
def level_label_sets(spark, folder):
    p = table(spark, folder, "part")
    p = p.withColumn("p_brand", F.when(F.col("p_size") % 7 != 0, F.col("p_brand"))) \
         .withColumn("p_name", F.when(F.col("p_type") != "PROMO", F.col("p_name")))
    return profile.level_labels(p, ["p_type", "p_brand", "p_name"])


@query("distinct_counts", """
  SELECT 'l_suppkey' AS "column", count(DISTINCT l_suppkey) AS n_distinct FROM lineitem
  UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem
  UNION ALL SELECT 'l_discount', count(DISTINCT l_discount) FROM lineitem""")
def distinct_counts(spark, folder):
    return profile.distinct_counts(table(spark, folder, "lineitem"), ["l_suppkey", "l_returnflag", "l_discount"])


@query("two_key_counts", f"""WITH {SQL_OBS} SELECT label, parent, count(*) AS n FROM obs GROUP BY ALL""")
def two_key_counts(spark, folder):
    return profile.two_key_counts(observations(spark, folder), "label", "parent")


@query("table_shape", "SELECT count(*) AS n_rows, CAST(11 AS INTEGER) AS n_columns FROM lineitem")
def table_shape(spark, folder):
    return profile.shape(table(spark, folder, "lineitem"))


@query("class_size_filter", """
  SELECT p_partkey, label FROM (SELECT *, p_brand || p_type AS label,
    count(*) FILTER (WHERE p_size > 5) OVER (PARTITION BY p_brand || p_type) AS n FROM part) WHERE n >= 12""")
def class_size_filter(spark, folder):
    p = table(spark, folder, "part").select(
        "p_partkey", F.concat("p_brand", "p_type").alias("label"),
        F.when(F.col("p_size") > 5, F.col("p_name")).alias("common_name"))
    return profile.large_classes(p, "label", 12).select("p_partkey", "label")


@query("group_value", """
  SELECT o_orderkey, o_orderpriority,
    round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority) + 1e-7, 4) AS mean_price FROM orders""")
def group_value(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    o = profile.with_group_value(o, "o_orderpriority", F.avg("o_totalprice"), "mean_price")
    return with_rounded(o.drop("o_totalprice"), "mean_price", digits=4)


@query("group_mean_impute", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(coalesce(nullif(l_discount, 0),
    avg(nullif(l_discount, 0)) OVER (PARTITION BY l_partkey)) + 1e-9, 6) AS elevation FROM lineitem""")
def group_mean_impute(spark, folder):
    li = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        geo.real_elevation(F.col("l_discount"), F.lit(1)).alias("elevation"))
    return with_rounded(profile.impute_group_mean(li, "elevation", "l_partkey"), "elevation")


MONTH_CELLS = ", ".join(
    f"avg(o_totalprice) FILTER (WHERE month(o_orderdate) = {m}) AS m{m}" for m in profile.MONTHS)
FILLED = ", ".join(f"round(coalesce(m{m}, rm) + 1e-7, 4) AS m{m}" for m in profile.MONTHS)


@query("month_pivot_filled", f"""
  WITH p AS (SELECT o_orderpriority AS label, {MONTH_CELLS} FROM (
      SELECT * REPLACE (CASE WHEN o_orderpriority = '1-URGENT' AND month(o_orderdate) IN (2, 7) THEN NULL
        ELSE o_totalprice END AS o_totalprice) FROM orders) GROUP BY 1),
  q AS (SELECT *, list_avg(list_filter([{", ".join(f"m{m}" for m in profile.MONTHS)}], lambda x: x IS NOT NULL)) AS rm
        FROM p)
  SELECT label, {FILLED} FROM q""")
def month_pivot_filled(spark, folder):
    unknown = (F.col("o_orderpriority") == "1-URGENT") & F.month("o_orderdate").isin(2, 7)
    o = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("label"), "o_orderdate",
                                              F.when(~unknown, F.col("o_totalprice")).alias("o_totalprice"))
    means = profile.month_profile(o, "label", F.month("o_orderdate"), ["o_totalprice"])
    wide = profile.month_pivot(means, "label", "o_totalprice")
    cells = [f"m{m}" for m in profile.MONTHS]
    return with_rounded(profile.fill_row_mean(wide, cells), *cells, digits=4)


@query("month_means", """
  SELECT o_orderpriority, CAST(month(o_orderdate) AS INTEGER) AS month, round(avg(o_totalprice) + 1e-7, 4) AS o_totalprice
  FROM orders GROUP BY ALL""")
def month_means(spark, folder):
    o = table(spark, folder, "orders")
    return with_rounded(profile.month_profile(o, "o_orderpriority", F.month("o_orderdate"), ["o_totalprice"]),
                        "o_totalprice", digits=4)


def _summary(column):
    d = f"CAST({column} AS DOUBLE)"
    return (f"SELECT '{column}' AS \"column\", count({column}) AS count, round(avg({d}) + 1e-7, 4) AS mean, "
            f"round(stddev({d}) + 1e-7, 4) AS std, min({d}) AS min, round(quantile_cont({d}, 0.25) + 1e-7, 4) AS q25, "
            f"round(quantile_cont({d}, 0.5) + 1e-7, 4) AS q50, round(quantile_cont({d}, 0.75) + 1e-7, 4) AS q75, "
            f"max({d}) AS max FROM lineitem")


@query("describe_numeric", " UNION ALL ".join(
    _summary(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_suppkey")))
def describe_numeric(spark, folder):
    li = table(spark, folder, "lineitem")
    d = profile.describe_numeric(li, ["l_quantity", "l_extendedprice", "l_discount", "l_suppkey"])
    return with_rounded(d, "mean", "std", "q25", "q50", "q75", digits=4)


def _text_summary(name, column):
    return (f"SELECT '{column}' AS \"column\", CAST(sum(n) AS BIGINT) AS count, count(*) AS \"unique\", "
            f"arg_min(v, (-n, v)) AS top, max(n) AS freq FROM (SELECT {column} AS v, count(*) AS n "
            f"FROM {name} GROUP BY 1)")


@query("describe_text", " UNION ALL ".join(_text_summary("part", c) for c in ("p_name", "p_brand", "p_type")))
def describe_text(spark, folder):
    return profile.describe_text(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"])


@query("histogram10", """
  WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w FROM lineitem)
  SELECT CAST(least(floor((l_extendedprice - lo) / w) + 1, 10) AS INTEGER) AS bin,
    round(lo + (least(floor((l_extendedprice - lo) / w) + 1, 10) - 1) * w + 1e-7, 4) AS left_edge, count(*) AS n
  FROM lineitem, b GROUP BY ALL""")
def histogram10(spark, folder):
    return with_rounded(profile.histogram(table(spark, folder, "lineitem"), "l_extendedprice"),
                        "left_edge", digits=4)


@query("class_size_quantiles", """
  WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS x FROM lineitem GROUP BY l_suppkey HAVING count(*) > 500)
  SELECT p, n, round(v + 1e-9, 6) AS value FROM (
    SELECT 0.25::DOUBLE AS p, count(*) AS n, quantile_cont(x, 0.25) AS v FROM s
    UNION ALL SELECT 0.5, count(*), quantile_cont(x, 0.5) FROM s
    UNION ALL SELECT 0.75, count(*), quantile_cont(x, 0.75) FROM s) WHERE n > 0""")
def class_size_quantiles(spark, folder):
    return with_rounded(profile.class_size_quantiles(
        table(spark, folder, "lineitem"), "l_suppkey", more_than=500), "value")


@query("mean_interval", """
  SELECT o_orderpriority, round(avg(o_totalprice) + 1e-7, 4) AS mean, round(quantile_cont(o_totalprice, 0.025) + 1e-7, 4) AS low,
    round(quantile_cont(o_totalprice, 0.975) + 1e-7, 4) AS high FROM orders GROUP BY 1""")
def mean_interval(spark, folder):
    return with_rounded(profile.mean_interval(table(spark, folder, "orders"), "o_totalprice", "o_orderpriority"),
                        "mean", "low", "high", digits=4)


@query("exact_quantiles", """
  SELECT l_returnflag, 'l_extendedprice' AS "column", p, n, round(v + 1e-7, 4) AS value FROM (
    SELECT l_returnflag, count(*) AS n, unnest([0.0, 0.1, 0.9, 1.0]::DOUBLE[]) AS p,
      unnest(quantile_cont(l_extendedprice, [0.0, 0.1, 0.9, 1.0])) AS v FROM lineitem GROUP BY 1)""")
def grouped_quantiles(spark, folder):
    q = exact_quantiles(table(spark, folder, "lineitem"), ["l_extendedprice"], [0.0, 0.1, 0.9, 1.0], "l_returnflag")
    return with_rounded(q.select("l_returnflag", "column", "p", "n", "value"), "value", digits=4)


@query("top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_rows(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return profile.top(o, [F.desc("o_totalprice"), "o_orderkey"], 10)


@query("middle_slice", """
  SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 50 OFFSET 100""")
def middle_slice(spark, folder):
    counts = profile.value_counts(table(spark, folder, "lineitem"), "l_partkey")
    return profile.positions(counts, [F.desc("n"), "l_partkey"], 100, 150)


@query("given_order", """
  SELECT o_orderpriority, n, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS place
  FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
  WHERE o_orderpriority IN ('5-LOW', '2-HIGH', '1-URGENT')""")
def given_order(spark, folder):
    counts = profile.value_counts(table(spark, folder, "orders"), "o_orderpriority")
    return profile.in_given_order(counts, "o_orderpriority", ["5-LOW", "2-HIGH", "1-URGENT"])


@query("transposed_report", """
  SELECT 'n' AS "column", CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS A,
    CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS DOUBLE) AS N,
    CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS R FROM lineitem
  UNION ALL SELECT 'quantity', sum(l_quantity) FILTER (WHERE l_returnflag = 'A'),
    sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), sum(l_quantity) FILTER (WHERE l_returnflag = 'R')
  FROM lineitem""")
def transposed_report(spark, folder):
    report = table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("l_quantity").alias("quantity"))
    return profile.transpose(report, "l_returnflag", ["n", "quantity"], ["A", "N", "R"])


@query("row_of_label", """
  SELECT o_orderpriority, CAST(month(o_orderdate) AS INTEGER) AS month, round(avg(o_totalprice) + 1e-7, 4) AS o_totalprice
  FROM orders WHERE o_orderpriority = '3-MEDIUM' GROUP BY ALL""")
def row_of_label(spark, folder):
    means = profile.month_profile(table(spark, folder, "orders"), "o_orderpriority", F.month("o_orderdate"),
                                  ["o_totalprice"])
    return with_rounded(means.where("o_orderpriority = '3-MEDIUM'"), "o_totalprice", digits=4)
