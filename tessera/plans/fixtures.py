"""Cohort-shaped views of the test tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import recode
from tessera.operators.relational import reduce_left_join
from tessera.sources.tables import landed

SCORES = """(SELECT o_orderkey AS id, o_orderpriority AS layer, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS truth,
 floor(o_totalprice / 1000) / 1000e0 AS s1, (o_custkey % 97) / 97e0 AS s2, (o_orderkey % 53) / 53e0 AS s3 FROM orders)"""

CLINICAL = """(SELECT c.c_custkey AS id, r.r_name AS region, c.c_mktsegment AS segment,
 CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE c.c_acctbal END AS balance, o.n_orders, o.spend, e.n_events, e.mean_value,
 CASE WHEN coalesce(o.n_open, 0) * 2 > coalesce(o.n_orders, 0) THEN 1 ELSE 0 END AS truth
 FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
 LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spend, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS n_open FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey
 LEFT JOIN (SELECT user_id, count(*) AS n_events, avg(value) AS mean_value FROM events GROUP BY 1) e ON c.c_custkey = e.user_id)"""

LAYERS = """(SELECT DISTINCT user_id AS id, 'events' AS layer, 1 AS ord FROM events UNION ALL
 SELECT DISTINCT o_custkey, 'recent', 2 FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' UNION ALL
 SELECT c_custkey, 'funded', 3 FROM customer WHERE c_acctbal > 0)"""

FEATURES = """(SELECT vec_id AS id, 'f' || lpad(CAST(k AS VARCHAR), 2, '0') AS feature, k, CAST(embedding[k + 1] AS DOUBLE) AS value, CASE WHEN label < 5 THEN 1 ELSE 0 END AS truth
 FROM embeddings, range(64) AS t(k))"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    o = landed(spark, d, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_custkey"])
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("layer"), (F.col("o_orderstatus") == "F").cast("int").alias("truth"),
        (F.floor(F.col("o_totalprice") / 1000) / 1000.0).alias("s1"), ((F.col("o_custkey") % 97) / 97.0).alias("s2"), ((F.col("o_orderkey") % 53) / 53.0).alias("s3"),
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Three models' risks in long form."""
    risks = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("risk")) for m in ("s1", "s2", "s3")])
    return scores(spark, d).select("id", "layer", "truth", F.explode(risks).alias("x")).select("id", "layer", "truth", "x.model", "x.risk")


#: Everybody has a risk in each of three layers by two models, and one of the clinical model.
MATCHED = """(SELECT id, truth, layer, model, CASE WHEN model = 'EN omics' THEN r ELSE r * r END AS risk FROM (
 SELECT id, truth, 'microbiome' AS layer, s1 AS r FROM """ + SCORES + """ UNION ALL SELECT id, truth, 'metabolomics', s2 FROM """ + SCORES + """
 UNION ALL SELECT id, truth, 'proteomics', (s1 + s3) / 2 FROM """ + SCORES + """), (SELECT 'EN omics' AS model UNION ALL SELECT 'XGB omics')
 UNION ALL SELECT id, truth, 'clinical', 'RF clinical', (s1 + s2) / 2 FROM """ + SCORES + """)"""
MATCHED_LAYERS = ["microbiome", "metabolomics", "proteomics"]


def matched(spark: SparkSession, d: str) -> DataFrame:
    one = lambda layer, model, risk: F.struct(F.lit(layer).alias("layer"), F.lit(model).alias("model"), risk.alias("risk"))
    sources = zip(MATCHED_LAYERS, (F.col("s1"), F.col("s2"), (F.col("s1") + F.col("s3")) / 2))
    cells = [one(n, m, r if m == "EN omics" else r * r) for n, r in sources for m in ("EN omics", "XGB omics")]
    cells.append(one("clinical", "RF clinical", (F.col("s1") + F.col("s2")) / 2))
    return scores(spark, d).select("id", "truth", F.explode(F.array(*cells)).alias("x")).select("id", "truth", "x.*")


def clinical(spark: SparkSession, d: str) -> DataFrame:
    """One row a participant: five tables reduced onto the customers."""
    c = landed(spark, d, "customer", ["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"])
    geo = landed(spark, d, "nation", ["n_nationkey", "n_regionkey"]).join(landed(spark, d, "region", ["r_regionkey", "r_name"]), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = landed(spark, d, "orders", ["o_custkey", "o_totalprice", "o_orderstatus"]).groupBy(F.col("o_custkey").alias("id")).agg(
        F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("spend"), F.sum((F.col("o_orderstatus") == "O").cast("bigint")).alias("n_open")
    )
    events = landed(spark, d, "events", ["user_id", "value"]).groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n_events"), F.avg("value").alias("mean_value"))
    base = c.join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("id"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("balance"),
    )
    truth = (F.coalesce("n_open", F.lit(0)) * 2 > F.coalesce("n_orders", F.lit(0))).cast("int")
    return reduce_left_join(base, [orders, events], "id").withColumn("truth", truth).select("id", "region", "segment", "balance", "n_orders", "spend", "n_events", "mean_value", "truth")


def layers(spark: SparkSession, d: str) -> DataFrame:
    e = landed(spark, d, "events", ["user_id"]).select(F.col("user_id").alias("id")).distinct().select("id", F.lit("events").alias("layer"), F.lit(1).alias("ord"))
    o = landed(spark, d, "orders", ["o_custkey", "o_orderdate"]).where("o_orderdate >= TIMESTAMP '1997-01-01'").select(F.col("o_custkey").alias("id")).distinct()
    c = landed(spark, d, "customer", ["c_custkey", "c_acctbal"]).where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return e.union(o.select("id", F.lit("recent"), F.lit(2))).union(c.select("id", F.lit("funded"), F.lit(3)))


def features(spark: SparkSession, d: str) -> DataFrame:
    v = landed(spark, d, "embeddings", ["vec_id", "embedding", "label"])
    return v.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("k", "v"), (F.col("label") < 5).cast("int").alias("truth")).select(
        "id", F.concat(F.lit("f"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("feature"), "k", F.col("v").cast("double").alias("value"), "truth"
    )


def planted(spark: SparkSession, d: str) -> DataFrame:
    """Rows with two arrays of 32 features, some of which share a latent number in one group."""
    v = landed(spark, d, "embeddings", ["vec_id", "embedding", "label"])
    latent = F.conv(F.substring(F.md5(F.concat(F.lit("z|"), F.col("vec_id").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32) - 0.5
    x = F.transform(F.slice("embedding", 1, 32), lambda e, k: e.cast("double") + F.when((F.col("label") < 5) & (k < 8), latent).otherwise(0.0))
    y = F.transform(F.slice("embedding", 33, 32), lambda e, k: e.cast("double") + F.when((F.col("label") < 5) & (k < 6), latent).otherwise(0.0))
    return v.select(F.col("vec_id").alias("id"), x.alias("x"), y.alias("y"), (F.col("label") < 5).cast("int").alias("truth"))


def segment_code(c):
    return recode(c, [(c == "BUILDING", "build"), (c.isin("MACHINERY", "AUTOMOBILE"), "make")], "other")
