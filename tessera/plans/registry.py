"""Queries by name: each a function of (spark, folder), with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import labels, scalars
from tessera.operators import blocks, contracts, discrimination, importance, inference, models, quantiles, recodes, relational, resampling, screening, tables
from tessera.plans import fixtures as fx
from tessera.sources import provenance, sheets, sinks
from tessera.sources.folders import own_folder
from tessera.sources.tables import file_manifest, landed, read_csv, read_matrix_text, read_with_found_header, split_missing_code
from tessera.streaming.events import windowed_summary

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def md5_number(*parts: str) -> str:
    """SQL of ``scalars.hash_order`` for DuckDB."""
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8))::BIGINT"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Which score ranks the event better, by layer, with DeLong intervals."""
    return rounded(discrimination.delong(fx.predictions(spark, d), ["model", "layer"]))


# ---- projection, expressions, recodes -------------------------------------------------

@query("SELECT c_custkey AS id, CASE WHEN c_mktsegment IS NULL THEN 'Missing' WHEN c_mktsegment = 'BUILDING' THEN 'build' WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'make' ELSE 'other' END AS code FROM customer")
def recode_case_when(s, d):
    return landed(s, d, "customer", ["c_custkey", "c_mktsegment"]).select(F.col("c_custkey").alias("id"), fx.segment_code(F.col("c_mktsegment")).alias("code"))


@query(f"SELECT CASE WHEN balance IS NULL THEN 'Missing' WHEN balance < 0 THEN 'debt' WHEN balance < 5000 THEN 'low' ELSE 'high' END AS band, count(*) AS n FROM {fx.CLINICAL} GROUP BY 1")
def missing_category(s, d):
    b = F.col("balance")
    return fx.clinical(s, d).groupBy(scalars.recode(b, [(b < 0, "debt"), (b < 5000, "low")], "high").alias("band")).agg(F.count("*").alias("n"))


@query(f"SELECT id, CAST(n AS INTEGER) AS n_known, round(m, 6) AS row_mean, round(round_even(h, 0), 6) AS half_even FROM (SELECT id, (balance IS NOT NULL)::INT + (spend IS NOT NULL)::INT + (mean_value IS NOT NULL)::INT AS n, (coalesce(balance, 0) + coalesce(spend, 0) + coalesce(mean_value, 0)) / nullif((balance IS NOT NULL)::INT + (spend IS NOT NULL)::INT + (mean_value IS NOT NULL)::INT, 0) AS m, id / 2e0 AS h FROM {fx.CLINICAL})")
def rowwise_known_mean(s, d):
    cols = [F.col(c) for c in ("balance", "spend", "mean_value")]
    return rounded(fx.clinical(s, d).select("id", scalars.present(cols).alias("n_known"), scalars.row_mean(cols).alias("row_mean"), scalars.half_even(F.col("id") / 2.0).alias("half_even")))


@query(f"SELECT id, round(greatest(1e-6, least(1 - 1e-6, s1)), 6) AS clamped, round(ln(greatest(1e-6, least(1 - 1e-6, s1)) / (1 - greatest(1e-6, least(1 - 1e-6, s1)))), 6) AS logit FROM {fx.SCORES}")
def clamp_and_logit(s, d):
    return rounded(fx.scores(s, d).select("id", scalars.clamp(F.col("s1"), 1e-6, 1 - 1e-6).alias("clamped"), scalars.logit(F.col("s1")).alias("logit")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linenumber::DOUBLE END AS value, CASE WHEN l_returnflag = 'R' THEN 'r' END AS value_missing FROM lineitem")
def split_tagged_missing(s, d):
    li = landed(s, d, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag"])
    raw = li.withColumn("value", F.when(F.col("l_returnflag") == "R", "R").otherwise(F.col("l_linenumber").cast("string")))
    return split_missing_code(raw, "value", ["R", "U"]).select("l_orderkey", "l_linenumber", "value", "value_missing")


@query("SELECT c_custkey AS id, round(40 + c_custkey % 30 + c_nationkey / 10e0 - c_custkey % 5, 6) AS age FROM customer")
def derived_age(s, d):
    c = landed(s, d, "customer", ["c_custkey", "c_nationkey"])
    return rounded(c.select(F.col("c_custkey").alias("id"), scalars.derived_age(40 + F.col("c_custkey") % 30, F.col("c_nationkey") / 10.0, F.col("c_custkey") % 5).alias("age")))


FRAIL = """(SELECT c_custkey AS id, c_custkey % 11 <> 0 AS in_clinic,
 CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS b,
 CASE WHEN c_nationkey % 4 = 0 THEN NULL WHEN c_nationkey % 3 = 0 THEN 1 ELSE 0 END AS c, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS e, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS f FROM customer)"""


@query(f"SELECT id, score, CASE WHEN score IS NULL THEN 'Missing' WHEN score = 0 THEN 'Robust' WHEN score <= 2 THEN 'Intermediate' ELSE 'Frail' END AS frailty FROM (SELECT id, CASE WHEN in_clinic AND n >= 3 THEN round_even(CASE WHEN n = 5 THEN t ELSE 5 * (t / n) END, 0) END AS score FROM (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + 2 AS n, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + e + f)::DOUBLE AS t FROM {FRAIL}))")
def frailty_composite(s, d):
    k, n, b = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    crit = [F.when(k % 3 != 0, (k % 2 == 0).cast("int")), F.when(k % 5 != 0, (k % 4 == 0).cast("int")), F.when(n % 4 != 0, (n % 3 == 0).cast("int")), (b < 0).cast("int"), (b > 5000).cast("int")]
    score, label = recodes.frailty(crit, k % 11 != 0)
    return landed(s, d, "customer", ["c_custkey", "c_nationkey", "c_acctbal"]).select(k.alias("id"), score.cast("double").alias("score"), label.alias("frailty"))


@query("SELECT id, CASE WHEN chg <= -5 AND intended = 'No' THEN 1 WHEN chg <= -5 AND intended = 'Yes' THEN 0 WHEN chg > -5 THEN 0 END AS weight_loss, CASE WHEN energy = 'No' THEN 1 WHEN energy = 'Yes' THEN 0 END AS low_energy FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE (c_custkey % 17) - 9 END AS chg, CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Missing' END AS intended, CASE c_custkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Missing' END AS energy FROM customer)")
def frailty_criteria(s, d):
    k = F.col("c_custkey")
    yes_no = lambda m: F.when(k % m == 0, "Yes").when(k % m == 1, "No").otherwise("Missing")
    change = F.when(k % 13 != 0, k % 17 - 9)
    return landed(s, d, "customer", ["c_custkey"]).select(k.alias("id"), recodes.weight_loss(change, yes_no(3)).alias("weight_loss"), recodes.low_energy(yes_no(4)).alias("low_energy"))


# ---- labels ---------------------------------------------------------------------------

TAXA = """(SELECT p_partkey AS id, 'k__' || p_brand || '_ p__' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END || '_ f__' || CASE WHEN p_partkey % 5 = 0 THEN 'fam' || p_size ELSE '' END || '_ g__' || CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS name FROM part)"""


@query(f"SELECT id, CASE WHEN length(g) > 3 THEN substr(g, 4) WHEN length(f) > 3 THEN f WHEN length(p) > 3 THEN p WHEN length(k) > 3 THEN k ELSE name END AS label FROM (SELECT id, name, split_part(name, '_ ', 1) AS k, split_part(name, '_ ', 2) AS p, split_part(name, '_ ', 3) AS f, split_part(name, '_ ', 4) AS g FROM {TAXA})")
def taxon_label_clean(s, d):
    k = F.col("p_partkey")
    part = lambda cond, c: F.when(cond, c).otherwise("")
    name = F.concat(F.lit("k__"), "p_brand", F.lit("_ p__"), part(k % 2 == 0, F.col("p_type")), F.lit("_ f__"), part(k % 5 == 0, F.concat(F.lit("fam"), F.col("p_size").cast("string"))), F.lit("_ g__"), part(k % 3 == 0, F.col("p_type")))
    return landed(s, d, "part", ["p_partkey", "p_brand", "p_type", "p_size"]).select(k.alias("id"), labels.taxon_label(name).alias("label"))


@query("SELECT p_partkey, CASE WHEN n = 0 THEN p_type ELSE p_type || '.' || n END AS p_type_unique FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS n FROM part)")
def make_unique(s, d):
    return labels.make_unique(landed(s, d, "part", ["p_partkey", "p_type"]), "p_type", ["p_partkey"]).select("p_partkey", "p_type_unique")


@query("SELECT c_custkey, coalesce(nullif(trim(lab), ''), 'CHEM_' || c_nationkey) AS label FROM customer LEFT JOIN (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN ' ' ELSE n_name END AS lab FROM nation WHERE n_nationkey % 6 <> 5) ON c_nationkey = n_nationkey")
def dictionary_label(s, d):
    dim = landed(s, d, "nation").where("n_nationkey % 6 <> 5").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 4 == 0, " ").otherwise(F.col("n_name")).alias("label"))
    return labels.dictionary_label(landed(s, d, "customer", ["c_custkey", "c_nationkey"]), dim, "c_nationkey", "label", "CHEM_").select("c_custkey", "label")


@query("SELECT p_partkey, CASE WHEN length(l) > 20 THEN substr(l, 1, 19) || '…' ELSE l END AS label, p_brand IN ('Brand#11', 'Brand#12') AS listed, 'seq.' || replace(p_brand, '-', '.') AS key_form FROM (SELECT p_partkey, p_brand, CASE WHEN p_brand = 'Brand#11' THEN 'First brand of the list' ELSE p_name END AS l FROM part)")
def label_truncate(s, d):
    p = landed(s, d, "part", ["p_partkey", "p_brand", "p_name"])
    c = F.when(F.col("p_brand") == "Brand#11", F.col("p_brand")).otherwise(F.col("p_name"))
    shown = labels.pretty(c, {"Brand#11": "First brand of the list"}, 20)
    return p.select("p_partkey", shown.alias("label"), labels.is_listed(F.col("p_brand"), ["Brand#11", "Brand#12"]).alias("listed"), labels.key_form("seq.", F.col("p_brand")).alias("key_form"))


# ---- joins and sets -------------------------------------------------------------------

@query(f"SELECT id, region, segment, round(balance, 6) AS balance, n_orders, round(spend, 4) AS spend, n_events, round(mean_value, 6) AS mean_value, truth FROM {fx.CLINICAL}")
def reduce_left_join(s, d):
    return rounded(fx.clinical(s, d)).withColumn("spend", F.round("spend", 4))


def _type2(value: str, p: float, table: str, by: str) -> str:
    return f"""(SELECT {by}, (min(CASE WHEN rn = greatest(1, ceil(round(n * {p}, 9))) THEN v END) + min(CASE WHEN rn = least(n, floor(round(n * {p}, 9)) + 1) THEN v END)) / 2 AS q
 FROM (SELECT {by}, {value} AS v, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM {table} WHERE {value} IS NOT NULL) GROUP BY {by})"""


BUCKETS = f"(SELECT *, CASE WHEN balance IS NULL THEN NULL WHEN balance < 0 THEN 1 WHEN balance < 3000 THEN 2 WHEN balance < 6000 THEN 3 ELSE 4 END AS bucket FROM {fx.CLINICAL})"


def _bucketed(s, d):
    b = F.col("balance")
    return fx.clinical(s, d).withColumn("bucket", F.when(b < 0, 1).when(b < 3000, 2).when(b < 6000, 3).when(b.isNotNull(), 4))


@query(f"SELECT t.id, t.bucket, round(c.q, 6) AS cut FROM {BUCKETS} t LEFT JOIN {_type2('spend', 0.2, BUCKETS, 'bucket')} c ON t.bucket IS NOT DISTINCT FROM c.bucket")
def null_safe_bucket_join(s, d):
    return rounded(recodes.with_bucket_cut(_bucketed(s, d), "bucket", "spend", 0.2, "cut").select("id", "bucket", "cut"))


@query(f"SELECT id FROM {fx.LAYERS} GROUP BY id HAVING count(DISTINCT layer) = 3")
def matched_cohort_intersection(s, d):
    return relational.in_all_layers(fx.layers(s, d), "id", "layer", 3)


@query(f"SELECT id, layer FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM {fx.LAYERS}) WHERE n = 1")
def distinct_keep_first(s, d):
    return relational.keep_first(fx.layers(s, d), ["id"], ["ord"]).select("id", "layer")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def keep_last_unique(s, d):
    return relational.keep_last(landed(s, d, "events", ["user_id", "event_id", "event_type", "ts"]), ["user_id"], ["ts", "event_id"]).drop("ts")


@query(f"SELECT a.layer AS layer_a, b.layer AS layer_b FROM (SELECT DISTINCT layer, ord FROM {fx.LAYERS}) a JOIN (SELECT DISTINCT layer, ord FROM {fx.LAYERS}) b ON a.ord < b.ord")
def layer_pairs(s, d):
    return relational.layer_pairs(fx.layers(s, d).select("layer", "ord").distinct(), "layer", "ord")


RANKS = "(SELECT p_brand AS feature, row_number() OVER (ORDER BY {0} DESC, p_brand) AS rank, {0} AS importance FROM (SELECT p_brand, sum(p_retailprice) AS total, count(*)::DOUBLE AS n FROM part WHERE p_size {1} GROUP BY 1))"


def _ranking(s, d, value, cond):
    g = landed(s, d, "part", ["p_brand", "p_retailprice", "p_size"]).where(cond).groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("total"), F.count("*").cast("double").alias("n"))
    return relational.rank_by(g.withColumn("g", F.lit(1)), ["g"], value, "feature").select("feature", "rank", F.col(value).alias("importance"))


@query(f"SELECT coalesce(a.feature, b.feature) AS feature, a.rank AS rank_a, b.rank AS rank_b FROM {RANKS.format('n', '< 25')} a FULL JOIN {RANKS.format('n', '>= 40')} b ON a.feature = b.feature")
def full_join_rank(s, d):
    return importance.merged_ranks(_ranking(s, d, "n", "p_size < 25"), _ranking(s, d, "n", "p_size >= 40"))


@query(f"SELECT a.feature, a.rank AS rank_a, round(a.importance / ma, 6) AS scaled_a, b.rank AS rank_b, round(b.importance / mb, 6) AS scaled_b, (a.rank + b.rank) / 2e0 AS mean_rank FROM (SELECT *, max(importance) OVER () AS ma FROM {RANKS.format('n', '< 25')}) a JOIN (SELECT *, max(importance) OVER () AS mb FROM {RANKS.format('n', '>= 25')}) b ON a.feature = b.feature WHERE a.rank <= 20 AND b.rank <= 20")
def shared_top_features(s, d):
    return rounded(importance.shared_top(_ranking(s, d, "n", "p_size < 25"), _ranking(s, d, "n", "p_size >= 25"), 20))


@query("SELECT l_suppkey, l_returnflag, round(q, 6) AS qty, round(q / max(q) OVER (PARTITION BY l_suppkey), 6) AS scaled FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)")
def group_max_normalise(s, d):
    g = landed(s, d, "lineitem", ["l_suppkey", "l_returnflag", "l_quantity"]).groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("qty"))
    return rounded(relational.max_normalised(g, ["l_suppkey"], "qty", "scaled"))


@query("SELECT o_orderpriority, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 10")
def topk_per_group(s, d):
    o = landed(s, d, "orders", ["o_orderpriority", "o_orderkey", "o_totalprice"])
    return rounded(relational.top_k(o, 10, [F.desc("o_totalprice"), "o_orderkey"], ["o_orderpriority"]))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def topk_frequency(s, d):
    return relational.tally(landed(s, d, "part", ["p_type"]), "p_type").limit(15)


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_detection(s, d):
    return relational.duplicates(landed(s, d, "orders", ["o_custkey", "o_orderpriority"]), ["o_custkey", "o_orderpriority"])


@query("SELECT c_mktsegment AS name, count(*) AS n, round(avg(c_acctbal), 6) AS balance, NULL::BIGINT AS total_size FROM customer GROUP BY 1 UNION ALL SELECT p_brand, count(*), NULL, sum(p_size)::BIGINT FROM part GROUP BY 1")
def bind_rows(s, d):
    a = landed(s, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("balance"))
    b = landed(s, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"), F.sum("p_size").alias("total_size"))
    return rounded(relational.stack([a, b]))


@query("SELECT o_custkey AS id, CASE WHEN src = 1 THEN 'left' ELSE 'right' END AS side FROM (SELECT * FROM (SELECT o_custkey, 1 AS src FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey, 1 FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT * FROM (SELECT o_custkey, 2 FROM orders WHERE o_orderstatus = 'O' EXCEPT ALL SELECT o_custkey, 2 FROM orders WHERE o_orderstatus = 'F'))")
def table_difference(s, d):
    o = landed(s, d, "orders", ["o_custkey", "o_orderstatus"])
    own = lambda v: o.where(F.col("o_orderstatus") == v).select(F.col("o_custkey").alias("id"))
    return relational.table_difference(own("F"), own("O"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events")
def set_difference(s, d):
    return landed(s, d, "customer", ["c_custkey"]).subtract(landed(s, d, "events", ["user_id"]))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def resume_remaining(s, d):
    from tessera.sources.sinks import remaining

    return remaining(landed(s, d, "customer", ["c_custkey"]), landed(s, d, "events", ["user_id"]).withColumnRenamed("user_id", "c_custkey"), "c_custkey")


@query(f"SELECT id, layer, s1 FROM (SELECT *, row_number() OVER (PARTITION BY layer, truth ORDER BY {md5_number(chr(39) + '7' + chr(39), chr(39) + 'sample' + chr(39), 'id::VARCHAR')}, id) AS n FROM {fx.SCORES}) WHERE n <= 8")
def stratified_sample(s, d):
    return relational.stratified_sample(fx.scores(s, d), ["layer", "truth"], 8, scalars.hash_order(7, "sample", F.col("id")), "id").select("id", "layer", "s1")


# ---- quantiles and ranks --------------------------------------------------------------

@query(f"SELECT l_returnflag, round(q, 6) AS q FROM {_type2('l_extendedprice', 0.2, 'lineitem', 'l_returnflag')}")
def quantile_type2_grouped(s, d):
    return rounded(quantiles.quantile_averaged(landed(s, d, "lineitem", ["l_returnflag", "l_extendedprice"]), "l_extendedprice", 0.2, ["l_returnflag"]))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75 FROM lineitem GROUP BY 1")
def quantile_type7_grouped(s, d):
    return rounded(quantiles.quantiles_interpolated(landed(s, d, "lineitem", ["l_returnflag", "l_extendedprice"]), "l_extendedprice", [0.25, 0.5, 0.75], ["l_returnflag"]))


@query(f"SELECT segment, round(coalesce(median(balance), 0), 6) AS balance, round(coalesce(median(spend), 0), 6) AS spend FROM {fx.CLINICAL} GROUP BY 1")
def median_by_group(s, d):
    return rounded(quantiles.medians(fx.clinical(s, d), ["balance", "spend"], ["segment"]))


@query(f"SELECT id, layer, rank() OVER (PARTITION BY layer ORDER BY s1) + (count(*) OVER (PARTITION BY layer, s1) - 1) / 2e0 AS avg_rank FROM {fx.SCORES}")
def average_rank(s, d):
    return quantiles.average_rank(fx.scores(s, d), "s1", ["layer"]).select("id", "layer", "avg_rank")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty, round(avg(l_extendedprice), 6) AS price, round(stddev_samp(l_discount), 6) AS sd_discount, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1, 2")
def group_summarise(s, d):
    li = landed(s, d, "lineitem", ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"])
    out = li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.avg("l_extendedprice").alias("price"), F.stddev_samp("l_discount").alias("sd_discount"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    return rounded(out).withColumn("qty", F.round("qty", 4))


# ---- criteria with cut-points --------------------------------------------------------

MEASURED = "(SELECT id, balance AS build, CASE WHEN id % 5 <> 0 THEN spend END AS grip, id % 23 = 0 AS unable, n_events::DOUBLE AS height, CASE WHEN id % 6 <> 0 THEN mean_value END AS walk FROM " + fx.CLINICAL + ")"


def _measured(s, d):
    c = fx.clinical(s, d)
    return c.select("id", F.col("balance").alias("build"), F.when(F.col("id") % 5 != 0, F.col("spend")).alias("grip"), (F.col("id") % 23 == 0).alias("unable"),
                    F.col("n_events").cast("double").alias("height"), F.when(F.col("id") % 6 != 0, F.col("mean_value")).alias("walk"))


def _averaged(value: str, p: float, rows: str) -> str:
    """SQL of one averaged quantile of a table."""
    return f"(SELECT q FROM {_type2(value, p, f'(SELECT *, 1 AS one FROM {rows})', 'one')})"


@query(f"WITH m AS (SELECT * FROM {MEASURED}), c AS (SELECT {_averaged('grip', 0.2, 'm')} AS cut) SELECT id, CASE WHEN grip <= cut THEN 1 WHEN grip > cut THEN 0 END AS low_activity FROM m, c")
def low_activity(s, d):
    return recodes.low_activity(_measured(s, d), "grip", "low_activity").select("id", "low_activity")


@query(f"WITH m AS (SELECT * FROM {MEASURED}), h AS (SELECT *, CASE WHEN height < {_averaged('height', 0.5, 'm')} THEN 1 WHEN height >= {_averaged('height', 0.5, 'm')} THEN 2 END AS half FROM m), c AS (SELECT half, q FROM {_type2('walk', 0.2, '(SELECT * FROM h WHERE walk IS NOT NULL OR unable)', 'half')}) "
       "SELECT id, CASE WHEN h.half IS NULL THEN NULL WHEN unable OR walk <= q THEN 1 WHEN walk > q THEN 0 END AS slow FROM h LEFT JOIN c ON h.half IS NOT DISTINCT FROM c.half")
def slowness(s, d):
    return recodes.slowness(_measured(s, d), "height", "walk", "unable", "slow").select("id", "slow")


@query(f"WITH m AS (SELECT * FROM {MEASURED}), b AS (SELECT *, CASE WHEN build <= {_averaged('build', 0.25, 'm')} THEN 1 WHEN build <= {_averaged('build', 0.5, 'm')} THEN 2 WHEN build <= {_averaged('build', 0.75, 'm')} THEN 3 WHEN build IS NOT NULL THEN 4 END AS quarter FROM m), c AS (SELECT quarter, q FROM {_type2('grip', 0.2, '(SELECT * FROM b WHERE grip IS NOT NULL OR unable)', 'quarter')}) "
       "SELECT id, CASE WHEN q IS NULL THEN NULL WHEN unable OR grip <= q THEN 1 WHEN grip > q THEN 0 END AS weak FROM b LEFT JOIN c ON b.quarter IS NOT DISTINCT FROM c.quarter")
def weakness(s, d):
    return recodes.weakness(_measured(s, d), "build", "grip", "unable", "weak").select("id", "weak")


# ---- composition ----------------------------------------------------------------------

COUNTS = "(SELECT user_id AS sample, event_type AS taxon, count(*) AS n FROM events WHERE user_id % 4 <> 0 OR event_type <> (SELECT min(event_type) FROM events) GROUP BY 1, 2)"


def _counts(s, d):
    e = landed(s, d, "events", ["user_id", "event_type"])
    least = e.agg(F.min("event_type").alias("m"))
    e = e.join(F.broadcast(least)).where("user_id % 4 <> 0 OR event_type <> m")
    return e.groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("taxon")).agg(F.count("*").alias("n"))


@query(f"WITH big AS (SELECT sample FROM {COUNTS} GROUP BY 1 HAVING sum(n) >= 50), kept AS (SELECT * FROM {COUNTS} WHERE sample IN (SELECT sample FROM big)) SELECT taxon, sample, n FROM kept WHERE taxon IN (SELECT taxon FROM kept GROUP BY 1 HAVING count(DISTINCT sample) >= 0.8 * (SELECT count(DISTINCT sample) FROM kept))")
def prevalence_library_filter(s, d):
    return recodes.count_filters(_counts(s, d), "sample", "taxon", "n", 0.8, 50).select("taxon", "sample", "n")


@query(f"SELECT sample, taxon, round(ln(n + 1) - avg(ln(n + 1)) OVER (PARTITION BY sample), 6) AS clr FROM {COUNTS}")
def clr_transform(s, d):
    return rounded(recodes.clr(_counts(s, d), "sample", "n").select("sample", "taxon", "clr"))


@query(f"WITH x AS (SELECT sample, taxon, ln(n) AS l, ln(n) - avg(ln(n)) OVER (PARTITION BY taxon, sample % 2) AS r, sample % 2 AS g FROM {COUNTS}) SELECT sample, taxon, round(l - avg(r) OVER (PARTITION BY sample), 6) AS log_corrected FROM x")
def log_bias_correction(s, d):
    c = _counts(s, d).withColumn("g", F.col("sample") % 2)
    return rounded(recodes.bias_corrected_log(c, "sample", "taxon", "n", ["g"]).select("sample", "taxon", "log_corrected"))


# ---- resampling -----------------------------------------------------------------------

def _h(salt: str, *ids: str, seed: int = 1) -> str:
    return md5_number(f"'{seed}'", salt, *[f"{i}::VARCHAR" for i in ids])


@query(f"SELECT id, truth, rn <= floor(n * 0.8) AS in_train FROM (SELECT id, truth, row_number() OVER (PARTITION BY truth ORDER BY {_h(chr(39) + 'split' + chr(39), 'id')}, id) AS rn, count(*) OVER (PARTITION BY truth) AS n FROM {fx.SCORES})")
def stratified_split(s, d):
    return resampling.stratified_split(fx.scores(s, d).select("id", "truth"), "id", ["truth"])


@query(f"SELECT id, truth, 1 AS repeat_id, ((row_number() OVER (PARTITION BY truth ORDER BY {_h(chr(39) + 'fold1' + chr(39), 'id')}, id) - 1) % 5 + 1)::INT AS fold_id FROM {fx.SCORES}")
def stratified_folds(s, d):
    return resampling.stratified_folds(fx.scores(s, d), "id", ["truth"])


REPEATED = f"(SELECT id, truth, r::INT AS repeat_id, ((row_number() OVER (PARTITION BY r, truth ORDER BY {_h('(' + chr(39) + 'fold' + chr(39) + ' || r)', 'id')}, id) - 1) % 5 + 1)::INT AS fold_id FROM {fx.SCORES}, range(1, 6) AS t(r))"


@query(f"SELECT * FROM {REPEATED}")
def repeated_folds(s, d):
    return resampling.repeated_folds(fx.scores(s, d), "id", ["truth"])


@query(f"WITH f AS (SELECT id, truth, 1 AS repeat_id, ((row_number() OVER (PARTITION BY truth ORDER BY {_h(chr(39) + 'fold1' + chr(39), 'id')}, id) - 1) % 5 + 1)::INT AS fold_id FROM {fx.SCORES}), o AS (SELECT DISTINCT fold_id AS outer_fold FROM f) SELECT repeat_id, outer_fold, id, ((row_number() OVER (PARTITION BY repeat_id, outer_fold, truth ORDER BY {_h(chr(39) + 'inner' + chr(39), 'repeat_id', 'outer_fold', 'id')}, id) - 1) % 3 + 1)::INT AS inner_fold FROM f JOIN o ON fold_id <> outer_fold")
def inner_folds(s, d):
    return resampling.inner_folds(resampling.stratified_folds(fx.scores(s, d), "id", ["truth"]), "id", ["truth"])


@query(f"SELECT model, layer, count(*) AS n, round(avg(risk), 6) AS mean_risk FROM (SELECT model, layer, id, truth, avg(risk) AS risk FROM (SELECT id, layer, truth, repeat_id, 's1' AS model, least(1, s1 + repeat_id / 100e0) AS risk FROM {fx.SCORES} s JOIN (SELECT id AS i, repeat_id FROM {REPEATED}) r ON s.id = r.i) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2")
def averaged_over_repeats(s, d):
    f = resampling.repeated_folds(fx.scores(s, d), "id", ["truth"]).select("id", "repeat_id")
    p = fx.scores(s, d).join(f, "id").withColumn("model", F.lit("s1")).withColumn("risk", F.least(F.lit(1.0), F.col("s1") + F.col("repeat_id") / 100.0))
    a = resampling.averaged_over_repeats(p, ["model", "layer", "id", "truth"])
    return rounded(a.groupBy("model", "layer").agg(F.count("*").alias("n"), F.avg("risk").alias("mean_risk")))


@query(f"SELECT repeat_id, CASE WHEN n IS NULL THEN 'absent' WHEN w IS NULL THEN 'unknown' ELSE 'repeated' END AS fault, count(*) AS n FROM (SELECT coalesce(p.repeat_id, m.repeat_id) AS repeat_id, p.n, m.id AS w FROM (SELECT repeat_id, CASE WHEN id % 97 = 0 THEN -id - 1 ELSE id END AS id, count(*) AS n FROM (SELECT * FROM {REPEATED} UNION ALL SELECT * FROM {REPEATED} WHERE id % 89 = 0 AND repeat_id = 2) WHERE id % 101 <> 0 OR repeat_id <> 1 GROUP BY 1, 2) p FULL JOIN (SELECT id, r::INT AS repeat_id FROM {fx.SCORES}, range(1, 6) AS t(r)) m ON p.id = m.id AND p.repeat_id = m.repeat_id) WHERE n IS NULL OR w IS NULL OR n > 1 GROUP BY 1, 2")
def oof_completeness(s, d):
    f = resampling.repeated_folds(fx.scores(s, d), "id", ["truth"])
    f = f.unionByName(f.where("id % 89 = 0 AND repeat_id = 2")).where("id % 101 <> 0 OR repeat_id <> 1")
    f = f.withColumn("id", F.when(F.col("id") % 97 == 0, -F.col("id") - 1).otherwise(F.col("id")))
    return resampling.out_of_fold_faults(f, fx.scores(s, d), "id")


def _boot(rows: str, replicates: int, by: str | None = None) -> str:
    """SQL of ``resampling.bootstrap_draws`` over the groups of ``by``."""
    part, cols = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    on = f"m.{by} = slots.{by} AND " if by else ""
    pick = f"m.{by}, " if by else ""
    return (
        f"(WITH m AS (SELECT *, row_number() OVER ({part} ORDER BY {_h(chr(39) + 'index' + chr(39), 'id')}, id) - 1 AS i FROM {rows}), c AS (SELECT {cols}count(*) AS n FROM m" + (f" GROUP BY {by}" if by else "") + "), "
        f"slots AS (SELECT {cols}slot, (floor(slot / n::DOUBLE) + 1)::INT AS replicate, {_h(chr(39) + 'boot' + chr(39), 'slot')} % n AS i FROM (SELECT {cols}n, unnest(range({replicates} * n)) AS slot FROM c)) "
        f"SELECT {pick}replicate, id, count(*) AS times FROM slots JOIN m ON {on}m.i = slots.i GROUP BY ALL)"
    )


@query(f"SELECT * FROM {_boot(fx.SCORES, 20, 'layer')}")
def bootstrap_draws(s, d):
    return resampling.bootstrap_draws(fx.scores(s, d), "id", 20, by=["layer"])


@query(f"SELECT layer, p::INT AS perm_id, id, CASE WHEN p = 0 THEN truth WHEN row_number() OVER (PARTITION BY layer, p ORDER BY {_h(chr(39) + 'perm' + chr(39), 'p', 'id')}, id) <= sum(truth) OVER (PARTITION BY layer, p) THEN 1 ELSE 0 END AS truth FROM {fx.SCORES}, range(0, 6) AS t(p)")
def permute_labels(s, d):
    return resampling.permuted_labels(fx.scores(s, d), "id", "truth", 5, by=["layer"])


# ---- discrimination and inference -----------------------------------------------------

PRED = f"(SELECT id, layer, truth, 's1' AS model, s1 AS risk FROM {fx.SCORES} UNION ALL SELECT id, layer, truth, 's2', s2 FROM {fx.SCORES} UNION ALL SELECT id, layer, truth, 's3', s3 FROM {fx.SCORES})"
AVG_RANKS = f"(SELECT *, rank() OVER (PARTITION BY model, layer ORDER BY risk) + (count(*) OVER (PARTITION BY model, layer, risk) - 1) / 2e0 AS ra, rank() OVER (PARTITION BY model, layer, truth ORDER BY risk) + (count(*) OVER (PARTITION BY model, layer, truth, risk) - 1) / 2e0 AS ro, count(*) OVER (PARTITION BY model, layer) - count(*) OVER (PARTITION BY model, layer, truth) AS other FROM {PRED})"
PLACE = f"(SELECT *, CASE WHEN truth = 1 THEN (ra - ro) / other ELSE 1 - (ra - ro) / other END AS v FROM {AVG_RANKS})"


@query(f"SELECT model, layer, sum(truth)::BIGINT AS n1, sum(1 - truth)::BIGINT AS n0, round((sum(CASE WHEN truth = 1 THEN ra END) - sum(truth) * (sum(truth) + 1) / 2e0) / (sum(truth)::DOUBLE * sum(1 - truth)), 6) AS auc FROM {AVG_RANKS} GROUP BY 1, 2")
def auc_pinned(s, d):
    return rounded(discrimination.auc(fx.predictions(s, d), ["model", "layer"]))


@query(f"WITH r AS (SELECT p.model, p.layer, p.id, p.truth, least(1, p.risk + (p.id * f.repeat_id) % 7 / 100e0) AS risk, f.repeat_id FROM {PRED} p JOIN {REPEATED} f ON p.id = f.id), a AS (SELECT *, rank() OVER (PARTITION BY model, layer, repeat_id ORDER BY risk) + (count(*) OVER (PARTITION BY model, layer, repeat_id, risk) - 1) / 2e0 AS ra FROM r), u AS (SELECT model, layer, repeat_id, (sum(CASE WHEN truth = 1 THEN ra END) - sum(truth) * (sum(truth) + 1) / 2e0) / (sum(truth)::DOUBLE * sum(1 - truth)) AS auc FROM a GROUP BY 1, 2, 3) SELECT model, layer, count(*) AS repeats, round(avg(auc), 6) AS auc_mean, round(stddev_samp(auc), 6) AS auc_sd, round(min(auc), 6) AS auc_min, round(max(auc), 6) AS auc_max FROM u GROUP BY 1, 2")
def auc_by_repeat(s, d):
    f = resampling.repeated_folds(fx.scores(s, d), "id", ["truth"]).select("id", "repeat_id")
    p = fx.predictions(s, d).join(f, "id").withColumn("risk", F.least(F.lit(1.0), F.col("risk") + (F.col("id") * F.col("repeat_id")) % 7 / 100.0))
    return rounded(discrimination.repeat_summary(p, ["model", "layer"]))


@query(f"WITH b AS (SELECT layer, s2 AS t, sum(truth) AS p, count(*) - sum(truth) AS q FROM {fx.SCORES} GROUP BY 1, 2) SELECT layer, round(t, 6) AS threshold, round(sum(p) OVER w / (sum(p) OVER (PARTITION BY layer))::DOUBLE, 6) AS sensitivity, round(1 - sum(q) OVER w / (sum(q) OVER (PARTITION BY layer))::DOUBLE, 6) AS specificity FROM b WINDOW w AS (PARTITION BY layer ORDER BY t DESC ROWS UNBOUNDED PRECEDING)")
def roc_curve(s, d):
    return rounded(discrimination.roc_curve(fx.scores(s, d), ["layer"], "s2").where("threshold < CAST('Infinity' AS DOUBLE)"))


@query(f"WITH a AS (SELECT model, layer, sum(truth)::BIGINT AS n1, sum(1 - truth)::BIGINT AS n0, avg(CASE WHEN truth = 1 THEN v END) AS auc, sqrt(var_samp(CASE WHEN truth = 1 THEN v END) / sum(truth) + var_samp(CASE WHEN truth = 0 THEN v END) / sum(1 - truth)) AS se FROM {PLACE} GROUP BY 1, 2) SELECT model, layer, n1, n0, round(auc, 6) AS auc, round(se, 6) AS se, round(greatest(0, auc - 1.959963984540054 * se), 6) AS lower, round(least(1, auc + 1.959963984540054 * se), 6) AS upper FROM a")
def delong_ci(s, d):
    return flagship(s, d)


PAIRED = f"""(WITH v AS {PLACE}, j AS (SELECT a.layer, a.truth, a.v AS va, b.v AS vb, b.model AS reference FROM v a JOIN v b ON a.id = b.id AND a.model = 's1' AND b.model <> 's1')
 SELECT layer, reference, avg(CASE WHEN truth = 1 THEN va END) AS auc_a, avg(CASE WHEN truth = 1 THEN vb END) AS auc_b, (avg(CASE WHEN truth = 1 THEN va END) - avg(CASE WHEN truth = 1 THEN vb END)) / sqrt(
 (var_samp(CASE WHEN truth = 1 THEN va END) + var_samp(CASE WHEN truth = 1 THEN vb END) - 2 * covar_samp(CASE WHEN truth = 1 THEN va END, CASE WHEN truth = 1 THEN vb END)) / sum(truth)
 + (var_samp(CASE WHEN truth = 0 THEN va END) + var_samp(CASE WHEN truth = 0 THEN vb END) - 2 * covar_samp(CASE WHEN truth = 0 THEN va END, CASE WHEN truth = 0 THEN vb END)) / sum(1 - truth)) AS z FROM j GROUP BY 1, 2)"""


@query(f"SELECT layer, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(auc_a - auc_b, 6) AS delta, round(z, 6) AS z FROM {PAIRED} WHERE reference = 's2'")
def delong_paired_z(s, d):
    return rounded(discrimination.delong_paired(fx.scores(s, d), "id", ["layer"], "s1", "s2").drop("p_value"))


@query()
def delong_paired_test(s, d):
    return rounded(discrimination.delong_paired(fx.scores(s, d), "id", ["layer"], "s1", "s2"))


ALL_PAIRS = f"""(WITH v AS {PLACE}, j AS (SELECT a.layer, a.truth, a.model AS model_a, b.model AS model_b, a.v AS va, b.v AS vb, CASE WHEN a.truth = 1 THEN a.v END AS va1, CASE WHEN a.truth = 1 THEN b.v END AS vb1 FROM v a JOIN v b ON a.id = b.id AND a.model < b.model)
 SELECT layer, model_a, model_b, count(*) AS n, avg(va1) AS auc_a, avg(vb1) AS auc_b, (avg(va1) - avg(vb1)) / sqrt(var_samp(va1 - vb1) / sum(truth) + var_samp(CASE WHEN truth = 0 THEN va - vb END) / sum(1 - truth)) AS z FROM j GROUP BY 1, 2, 3)"""


@query(f"SELECT layer, model_a, model_b, n, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(auc_a - auc_b, 6) AS delta, round(z, 6) AS z FROM {ALL_PAIRS}")
def delong_all_pairs_z(s, d):
    return rounded(discrimination.delong_all_pairs(fx.predictions(s, d), "id", ["layer"], ["s1", "s2", "s3"]).drop("p_value"))


@query()
def model_comparisons(s, d):
    return rounded(discrimination.compare(fx.scores(s, d), "id", ["layer"], {"s2": ["s1", "s3"], "s3": ["s1"]}, replicates=200))


LAYER_NAMES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("SELECT model, " + ", ".join(f"round(max(CASE WHEN layer = '{p}' THEN auc END), 6) AS \"{p}\"" for p in LAYER_NAMES) + f" FROM (SELECT model, layer, avg(CASE WHEN truth = 1 THEN v END) AS auc FROM {PLACE} GROUP BY 1, 2) GROUP BY 1")
def auc_table_wide(s, d):
    return rounded(discrimination.wide_auc(discrimination.auc(fx.predictions(s, d), ["model", "layer"]), list(LAYER_NAMES)))


@query(f"WITH m AS (SELECT layer, id, truth, s1, s2 FROM {fx.SCORES}), b AS {_boot(fx.SCORES, 200, 'layer')}, j AS (SELECT b.layer, replicate, times, truth, s1, s2 FROM b JOIN m ON b.layer = m.layer AND b.id = m.id), " + ", ".join(
    f"g{k} AS (SELECT layer, replicate, s{k} AS r, sum(truth * times) AS p, sum((1 - truth) * times) AS q FROM j GROUP BY 1, 2, 3), u{k} AS (SELECT layer, replicate, sum(pu) / nullif(sum(p)::DOUBLE * sum(q), 0) AS auc FROM (SELECT layer, replicate, p, q, p * (coalesce(sum(q) OVER (PARTITION BY layer, replicate ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2e0) AS pu FROM g{k}) GROUP BY 1, 2)" for k in (1, 2))
    + " SELECT layer, count(x) AS n_valid, round(quantile_cont(x, 0.025), 6) AS delta_lo, round(quantile_cont(x, 0.975), 6) AS delta_hi FROM (SELECT layer, u1.auc - u2.auc AS x FROM u1 JOIN u2 USING (layer, replicate)) GROUP BY 1")
def bootstrap_delta_auc(s, d):
    return rounded(discrimination.bootstrap_delta(fx.scores(s, d), "id", "s1", "s2", replicates=200, by=["layer"]))


MATCHED_PLACE = f"(SELECT *, CASE WHEN truth = 1 THEN (ra - ro) / other ELSE 1 - (ra - ro) / other END AS v FROM (SELECT *, rank() OVER (PARTITION BY model, layer ORDER BY risk) + (count(*) OVER (PARTITION BY model, layer, risk) - 1) / 2e0 AS ra, rank() OVER (PARTITION BY model, layer, truth ORDER BY risk) + (count(*) OVER (PARTITION BY model, layer, truth, risk) - 1) / 2e0 AS ro, count(*) OVER (PARTITION BY model, layer) - count(*) OVER (PARTITION BY model, layer, truth) AS other FROM {fx.MATCHED}))"
MATCHED_PAIRS = f"""(WITH v AS {MATCHED_PLACE}, o AS (SELECT unnest({[n for n in fx.MATCHED_LAYERS]}) AS layer, unnest([1, 2, 3]) AS ord), j AS (
 SELECT 'Between omics layers' AS family, a.model, upper(a.layer[1]) || a.layer[2:] || ' vs ' || upper(b.layer[1]) || b.layer[2:] AS comparison, a.truth, a.v AS va, b.v AS vb FROM v a JOIN o oa ON a.layer = oa.layer JOIN v b ON a.id = b.id AND a.model = b.model JOIN o ob ON b.layer = ob.layer AND oa.ord < ob.ord
 UNION ALL SELECT 'Versus the clinical model', a.model, upper(a.layer[1]) || a.layer[2:] || ' vs Clinical', a.truth, a.v, b.v FROM v a JOIN v b ON a.id = b.id AND a.layer <> 'clinical' AND b.layer = 'clinical')
 SELECT family, model, comparison, count(*) AS n, sum(truth)::BIGINT AS events, avg(CASE WHEN truth = 1 THEN va END) AS auc_a, avg(CASE WHEN truth = 1 THEN vb END) AS auc_b, (avg(CASE WHEN truth = 1 THEN va END) - avg(CASE WHEN truth = 1 THEN vb END)) / sqrt(
 (var_samp(CASE WHEN truth = 1 THEN va END) + var_samp(CASE WHEN truth = 1 THEN vb END) - 2 * covar_samp(CASE WHEN truth = 1 THEN va END, CASE WHEN truth = 1 THEN vb END)) / sum(truth)
 + (var_samp(CASE WHEN truth = 0 THEN va END) + var_samp(CASE WHEN truth = 0 THEN vb END) - 2 * covar_samp(CASE WHEN truth = 0 THEN va END, CASE WHEN truth = 0 THEN vb END)) / sum(1 - truth)) AS z FROM j GROUP BY 1, 2, 3)"""
MATCHED_Z = f"SELECT family, model, comparison, n, events, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(auc_a - auc_b, 6) AS delta, round(z, 6) AS z FROM {MATCHED_PAIRS}"


def _matched_z(t, family):
    return rounded(t.withColumn("family", F.lit(family)).select("family", "model", "comparison", "n", "events", "auc_a", "auc_b", "delta", "z"))


@query(MATCHED_Z + " WHERE family = 'Between omics layers'")
def matched_between_layers(s, d):
    return _matched_z(discrimination.between_layers(fx.matched(s, d), "id", fx.MATCHED_LAYERS, replicates=20), "Between omics layers")


@query(MATCHED_Z + " WHERE family = 'Versus the clinical model'")
def matched_versus_clinical(s, d):
    return _matched_z(discrimination.versus_clinical(fx.matched(s, d), "id", "RF clinical", replicates=20), "Versus the clinical model")


@query()
def matched_comparisons(s, d):
    return rounded(discrimination.matched_comparisons(fx.matched(s, d), "id", fx.MATCHED_LAYERS, "RF clinical", replicates=200))


@query(f"WITH t AS (SELECT id, truth, s1, s2, {_h(chr(39) + 'split' + chr(39), 'id')} AS h FROM {fx.SCORES}), k AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY h, id) <= floor(count(*) OVER (PARTITION BY truth) * 0.8) AS in_train FROM t) SELECT id, truth, round(s1, 6) AS risk, CASE WHEN in_train THEN 'out_of_fold' ELSE 'held_out_test' END AS source FROM k")
def out_of_sample_union(s, d):
    t = resampling.stratified_split(fx.scores(s, d), "id", ["truth"])
    train = t.where("in_train").withColumn("train_row", F.col("id") * 3 + 1)
    oof = train.select("train_row", (1 - F.col("s1")).alias("p1"))  # this generation stores survival
    test = t.where("NOT in_train").select("id", "truth", (1 - F.col("s1")).alias("p1"), F.col("s1").alias("pred_event"))
    return rounded(discrimination.out_of_sample(oof, train, test, "id", "p1", "pred_event"))


@query(f"SELECT model, layer, count(*) AS n, sum(truth)::BIGINT AS events, round(avg(risk), 6) AS mean_predicted, round(avg(truth), 6) AS observed, round(avg((risk - truth) * (risk - truth)), 6) AS brier, round(avg(truth) * (1 - avg(truth)), 6) AS brier_null FROM {PRED} GROUP BY 1, 2")
def brier_score(s, d):
    return rounded(discrimination.brier(fx.predictions(s, d), ["model", "layer"]))


@query()
def calibration_table(s, d):
    return rounded(discrimination.calibration(fx.predictions(s, d), ["model", "layer"]))


@query(f"SELECT layer, round(corr(a, b), 6) AS rho FROM (SELECT layer, rank() OVER (PARTITION BY layer ORDER BY s1) + (count(*) OVER (PARTITION BY layer, s1) - 1) / 2e0 AS a, rank() OVER (PARTITION BY layer ORDER BY s2) + (count(*) OVER (PARTITION BY layer, s2) - 1) / 2e0 AS b FROM {fx.SCORES}) GROUP BY 1")
def spearman_age_proxy(s, d):
    return rounded(inference.spearman(fx.scores(s, d), "s1", "s2", ["layer"]))


@query()
def age_proxy_table(s, d):
    return rounded(discrimination.age_proxy(fx.scores(s, d).withColumn("both", F.col("s1") + F.col("s3")), ["layer"], "id", ["s1", "s2"], "s3", "s3", "both"))


PVALUES = "(SELECT p_brand AS family, p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE ((p_partkey * 37) % 1000) / 1000e0 END AS p FROM part)"


@query(f"WITH k AS (SELECT *, p * count(*) OVER (PARTITION BY family) / (rank() OVER (PARTITION BY family ORDER BY p) + count(*) OVER (PARTITION BY family, p) - 1) AS q FROM {PVALUES} WHERE p IS NOT NULL) SELECT family, id, round(p, 6) AS p, round(least(1, min(q) OVER (PARTITION BY family ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS p_adj FROM k UNION ALL SELECT family, id, NULL, NULL FROM {PVALUES} WHERE p IS NULL")
def bh_families(s, d):
    p = landed(s, d, "part", ["p_brand", "p_partkey"])
    t = p.select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 11 != 0, (F.col("p_partkey") * 37 % 1000) / 1000.0).alias("p"))
    return rounded(inference.bh_adjust(t, "p", ["family"]))


@query(f"WITH o AS (SELECT layer, segment, truth, count(*) AS o FROM (SELECT s.layer, c.segment, s.truth FROM {fx.SCORES} s JOIN orders ON o_orderkey = s.id JOIN {fx.CLINICAL} c ON c.id = o_custkey) GROUP BY 1, 2, 3), e AS (SELECT r.layer, r.segment, t.truth, r.n * t.n / g.n::DOUBLE AS e FROM (SELECT layer, segment, sum(o) AS n FROM o GROUP BY 1, 2) r JOIN (SELECT layer, truth, sum(o) AS n FROM o GROUP BY 1, 2) t ON r.layer = t.layer JOIN (SELECT layer, sum(o) AS n FROM o GROUP BY 1) g ON g.layer = r.layer) SELECT e.layer, round(sum((coalesce(o.o, 0) - e) ** 2 / e), 6) AS statistic, (count(DISTINCT e.segment) - 1) * (count(DISTINCT e.truth) - 1) AS df, round(min(e), 6) AS least_expected FROM e LEFT JOIN o ON e.layer = o.layer AND e.segment = o.segment AND e.truth = o.truth GROUP BY 1")
def table1_chisq_stat(s, d):
    o = landed(s, d, "orders", ["o_orderkey", "o_custkey"]).select(F.col("o_orderkey").alias("id"), "o_custkey")
    c = landed(s, d, "customer", ["c_custkey", "c_mktsegment"]).select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    j = fx.scores(s, d).select("id", "layer", "truth").join(o, "id").join(c, "o_custkey")
    return rounded(inference.chi_square(j, "segment", "truth", ["layer"]).drop("p_value"))


@query()
def table1_chisq_p(s, d):
    return rounded(inference.chi_square(fx.clinical(s, d), "segment", "truth"))


@query(f"WITH r AS (SELECT *, rank() OVER (PARTITION BY layer ORDER BY s1) + (count(*) OVER (PARTITION BY layer, s1) - 1) / 2e0 AS a FROM {fx.SCORES}), t AS (SELECT layer, sum(c * c * c - c) AS tie FROM (SELECT layer, s1, count(*) AS c FROM {fx.SCORES} GROUP BY 1, 2) GROUP BY 1), g AS (SELECT layer, sum(CASE WHEN truth = 1 THEN a END) AS r1, sum(truth)::BIGINT AS n1, sum(1 - truth)::BIGINT AS n0 FROM r GROUP BY 1), w AS (SELECT g.layer, n1, n0, r1 - n1 * (n1 + 1) / 2e0 AS w, n1 * n0 / 2e0 AS m, sqrt(n1 * n0 / 12e0 * (n1 + n0 + 1 - tie::DOUBLE / ((n1 + n0) * (n1 + n0 - 1)))) AS sd FROM g JOIN t ON g.layer = t.layer) SELECT layer, n1, n0, w, round((w - m - sign(w - m) * 0.5) / sd, 6) AS z FROM w")
def wilcoxon_z(s, d):
    return rounded(inference.wilcoxon(fx.scores(s, d), "s1", "truth", ["layer"]).select("layer", "n1", "n0", "w", "z"))


# ---- tables and contracts -------------------------------------------------------------

@query("WITH l AS (" + " UNION ALL ".join(f"SELECT truth, '{v}' AS variable, coalesce({v}, 'Missing') AS level FROM {fx.CLINICAL}" for v in ("region", "segment")) + "), c AS (SELECT variable, level, count(*) AS n, sum(truth)::BIGINT AS n_a, sum(1 - truth)::BIGINT AS n_b FROM l GROUP BY 1, 2) SELECT *, round(100e0 * n / sum(n) OVER w, 6) AS pct, round(100e0 * n_a / sum(n_a) OVER w, 6) AS pct_a, round(100e0 * n_b / sum(n_b) OVER w, 6) AS pct_b FROM c WINDOW w AS (PARTITION BY variable)")
def table1_categorical(s, d):
    return rounded(tables.categorical_rows(fx.clinical(s, d), ["region", "segment"], "truth"))


@query(" UNION ALL ".join(f"SELECT '{v}' AS variable, count({v}) AS n, sum(({v} IS NULL)::INT)::BIGINT AS missing, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS sd, round(avg(CASE WHEN truth = 1 THEN {v} END), 4) AS mean_a, round(stddev_samp(CASE WHEN truth = 1 THEN {v} END), 4) AS sd_a, round(avg(CASE WHEN truth = 0 THEN {v} END), 4) AS mean_b, round(stddev_samp(CASE WHEN truth = 0 THEN {v} END), 4) AS sd_b FROM {fx.CLINICAL}" for v in ("balance", "spend", "mean_value")))
def table1_continuous(s, d):
    return rounded(tables.continuous_rows(fx.clinical(s, d), ["balance", "spend", "mean_value"], "truth"), 4)


@query(f"WITH m AS (SELECT id FROM {fx.LAYERS} GROUP BY 1 HAVING count(DISTINCT layer) = 3), t AS (SELECT c.*, (m.id IS NOT NULL)::INT AS complete FROM {fx.CLINICAL} c LEFT JOIN m ON c.id = m.id), c AS (SELECT 'region' AS variable, coalesce(region, 'Missing') AS level, count(*) AS n, sum(complete)::BIGINT AS n_a, sum(1 - complete)::BIGINT AS n_b FROM t GROUP BY 2) SELECT *, round(100e0 * n / sum(n) OVER (), 6) AS pct, round(100e0 * n_a / sum(n_a) OVER (), 6) AS pct_a, round(100e0 * n_b / sum(n_b) OVER (), 6) AS pct_b FROM c")
def complete_case_vs_rest(s, d):
    m = relational.in_all_layers(fx.layers(s, d), "id", "layer", 3).withColumn("c", F.lit(1))
    t = fx.clinical(s, d).join(m, "id", "left").withColumn("complete", F.coalesce("c", F.lit(0)))
    return rounded(tables.categorical_rows(t, ["region"], "complete"))


@query(f"SELECT layer, count(*) AS n, sum(truth)::BIGINT AS events FROM {fx.LAYERS} l JOIN {fx.CLINICAL} c ON l.id = c.id GROUP BY 1")
def layer_contract(s, d):
    return contracts.layer_contract(fx.layers(s, d).join(fx.clinical(s, d).select("id", "truth"), "id"), "layer", "truth")


@query("SELECT 'c_acctbal' AS \"check\", count(*) AS failures FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT 'c_mktsegment', count(*) FROM customer WHERE c_custkey % 10 = 0 AND c_mktsegment <> 'BUILDING'")
def cross_layer_agreement(s, d):
    a = landed(s, d, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"])
    b = a.withColumn("c_acctbal", F.when(F.col("c_custkey") % 9 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal") + 1e-12)).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, "BUILDING").otherwise(F.col("c_mktsegment")))
    return contracts.agreement(a, b, "c_custkey", ["c_acctbal"], ["c_mktsegment"])


@query("SELECT 'empty_id' AS \"check\", 0::BIGINT AS failures UNION ALL SELECT 'repeated_id', 0 UNION ALL SELECT 'unknown_outcome', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) UNION ALL SELECT 'not_finite', (SELECT count(*) FROM orders WHERE o_orderkey % 1000 = 0)")
def frame_validation(s, d):
    o = landed(s, d, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"]).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 1000 == 0, float("inf")).otherwise(F.col("o_totalprice")))
    return contracts.frame_checks(o, "o_orderkey", "o_orderstatus", ["F", "O"], ["o_totalprice"])


FAULTY = f"(SELECT id, layer, CASE WHEN id % 61 = 0 AND model = 's2' THEN 1 - truth ELSE truth END AS truth, model, CASE WHEN id % 71 = 0 THEN 2.0 WHEN id % 73 = 0 THEN NULL ELSE least(1, risk) END AS risk, repeat_id, CASE WHEN id % 79 = 0 AND model = 's3' THEN fold_id % 5 + 1 ELSE fold_id END AS fold_id FROM (SELECT p.*, f.repeat_id, f.fold_id FROM {PRED} p JOIN {REPEATED} f USING (id) WHERE f.repeat_id <= 2 UNION ALL SELECT p.*, f.repeat_id, f.fold_id FROM {PRED} p JOIN {REPEATED} f USING (id) WHERE f.repeat_id = 1 AND id % 83 = 0))"


def _faulty(s, d):
    f = resampling.repeated_folds(fx.scores(s, d), "id", ["truth"], repeats=2).select("id", "repeat_id", "fold_id")
    p = fx.predictions(s, d).join(f, "id")
    p = p.unionByName(p.where("repeat_id = 1 AND id % 83 = 0"))
    i, m = F.col("id"), F.col("model")
    return p.withColumns({
        "truth": F.when((i % 61 == 0) & (m == "s2"), 1 - F.col("truth")).otherwise(F.col("truth")),
        "risk": F.when(i % 71 == 0, 2.0).when(i % 73 != 0, F.least("risk", F.lit(1.0))),
        "fold_id": F.when((i % 79 == 0) & (m == "s3"), F.col("fold_id") % 5 + 1).otherwise(F.col("fold_id")),
    })


@query(f"WITH p AS (SELECT * FROM {FAULTY}) SELECT 'invalid_risk' AS \"check\", count(*) FILTER (WHERE risk IS NULL OR risk > 1) AS failures FROM p UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT 1 FROM p GROUP BY id, repeat_id, model, layer HAVING count(*) > 1) UNION ALL SELECT 'two_truths', count(*) FROM (SELECT 1 FROM p GROUP BY id HAVING count(DISTINCT truth) > 1) UNION ALL SELECT 'two_folds', count(*) FROM (SELECT 1 FROM p GROUP BY id, repeat_id HAVING count(DISTINCT fold_id) > 1)")
def prediction_validation(s, d):
    return contracts.prediction_checks(_faulty(s, d), "id")


HELD = "(SELECT id, truth, model, risk, CASE WHEN model = 's3' THEN risk ELSE 1 - risk END AS score FROM (SELECT CASE WHEN id % 67 = 0 THEN -id - 1 ELSE id END AS id, CASE WHEN id % 59 = 0 THEN 1 - truth ELSE truth END AS truth, model, CASE WHEN id % 71 = 0 THEN 2.0 ELSE risk END AS risk FROM " + PRED + " WHERE id % 103 <> 0))"
HELD_CHECKS = {
    "repeated_id": "0", "unknown_id": "count(*) FILTER (WHERE t.id IS NULL)", "absent_id": "count(*) FILTER (WHERE h.id IS NULL)",
    "other_truth": "count(*) FILTER (WHERE h.truth <> t.truth)", "invalid_risk": "count(*) FILTER (WHERE risk > 1 OR risk < 0)", "mixed_score": "max((coalesce(h.model, t.model) = 's3')::INT)",
}


@query(f"WITH h AS (SELECT * FROM {HELD}), t AS (SELECT id, truth, model FROM {fx.SCORES}, (SELECT DISTINCT model FROM h)), j AS (SELECT coalesce(h.model, t.model) AS model, " + ", ".join(f"({v})::BIGINT AS {k}" for k, v in HELD_CHECKS.items()) + " FROM h FULL JOIN t ON h.id = t.id AND h.model = t.model GROUP BY 1) SELECT model, \"check\", failures FROM j UNPIVOT (failures FOR \"check\" IN (" + ", ".join(HELD_CHECKS) + "))")
def held_out_validation(s, d):
    i = F.col("id")
    p = fx.predictions(s, d).where("id % 103 <> 0").withColumns({
        "id": F.when(i % 67 == 0, -i - 1).otherwise(i), "truth": F.when(i % 59 == 0, 1 - F.col("truth")).otherwise(F.col("truth")), "risk": F.when(i % 71 == 0, 2.0).otherwise(F.col("risk")),
    })
    p = p.withColumn("score", F.when(F.col("model") == "s3", F.col("risk")).otherwise(1 - F.col("risk")))
    return contracts.held_out_checks(p, fx.scores(s, d).select("id", "truth"), "id")


@query(f"WITH l AS (SELECT id, layer, CASE WHEN id % 7 = 0 AND layer = 'funded' THEN 'x' ELSE 'y' END AS status FROM {fx.LAYERS}), k AS (SELECT id, count(DISTINCT layer) = 3 AS inside, count(DISTINCT status) AS o, max(status) AS status FROM l GROUP BY 1) SELECT 'repeated_id' AS \"check\", 0::BIGINT AS failures UNION ALL SELECT 'outcome_differs', count(*) FILTER (WHERE inside AND o > 1) FROM k UNION ALL SELECT 'overlap_off', abs(count(*) FILTER (WHERE inside) - 5) FROM k UNION ALL SELECT 'events_off', abs(count(*) FILTER (WHERE inside AND status = 'y') - 5) FROM k")
def matched_preflight(s, d):
    rows = fx.layers(s, d).withColumn("status", F.when((F.col("id") % 7 == 0) & (F.col("layer") == "funded"), "x").otherwise("y"))
    return contracts.preflight(rows, "id", "layer", "status", "y", 5, 5)


@query("SELECT 'customers' AS step, count(*) AS n FROM customer UNION ALL SELECT 'funded', count(*) FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'building', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'")
def participant_flow(s, d):
    return tables.flow_counts(landed(s, d, "customer", ["c_acctbal", "c_mktsegment"]), {"customers": "true", "funded": "c_acctbal > 0", "building": "c_mktsegment = 'BUILDING'"})


# ---- screening and importance ---------------------------------------------------------

TSTATS = f"(WITH g AS (SELECT feature, count(CASE WHEN truth = 1 THEN value END) AS n1, count(CASE WHEN truth = 0 THEN value END) AS n0, avg(CASE WHEN truth = 1 THEN value END) AS mean1, avg(CASE WHEN truth = 0 THEN value END) AS mean0, var_samp(CASE WHEN truth = 1 THEN value END) AS v1, var_samp(CASE WHEN truth = 0 THEN value END) AS v0 FROM {fx.FEATURES} GROUP BY 1) SELECT *, mean1 - mean0 AS effect, ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) AS s2, n1 + n0 - 2 AS df FROM g)"


@query(f"SELECT feature, n1, n0, round(mean1, 6) AS mean1, round(mean0, 6) AS mean0, round(effect, 6) AS effect, df, round(s2, 6) AS s2, round(effect / sqrt(s2 * (1e0 / n1 + 1e0 / n0)), 6) AS t FROM {TSTATS}")
def two_sample_t_stats(s, d):
    return rounded(screening.two_group_stats(fx.features(s, d)))


@query()
def moderated_t_screen(s, d):
    return rounded(screening.screen_moderated(fx.features(s, d)))


SIS = f"(SELECT feature, abs(corr(x, y)) AS score FROM (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2e0 AS x, rank() OVER (PARTITION BY feature ORDER BY truth) + (count(*) OVER (PARTITION BY feature, truth) - 1) / 2e0 AS y FROM {fx.FEATURES}) GROUP BY 1)"


@query(f"SELECT feature, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, feature)::INT AS rank FROM {SIS} ORDER BY 3 LIMIT 10")
def sis_screen(s, d):
    return rounded(screening.screen_sis(fx.features(s, d), 10))


@query()
def mrmr_screen(s, d):
    got = screening.screen_mrmr(fx.features(s, d), 8, "id")
    return s.createDataFrame([(f, k) for k, f in enumerate(got, 1)], "feature string, rank int")


@query("SELECT l_shipmonth AS fold, feature, count(*) AS n FROM (SELECT month(l_shipdate) AS l_shipmonth, 'p' || (l_partkey % 10) AS feature FROM lineitem) GROUP BY 1, 2")
def selection_frequency(s, d):
    li = landed(s, d, "lineitem", ["l_shipdate", "l_partkey", "l_orderkey"])
    t = li.groupBy(F.month("l_shipdate").alias("fold"), "l_orderkey").agg(F.collect_list(F.concat(F.lit("p"), (F.col("l_partkey") % 10).cast("string"))).alias("selected_features"))
    return screening.selection_frequency(t, ["fold"])


@query(f"WITH c AS (SELECT feature, corr(value, truth) AS coefficient FROM {fx.FEATURES} GROUP BY 1), a AS (SELECT id, f.feature, coefficient * (value - avg(value) OVER (PARTITION BY f.feature)) AS att FROM {fx.FEATURES} f JOIN c ON f.feature = c.feature) SELECT feature, round(avg(abs(att)), 6) AS importance, row_number() OVER (ORDER BY avg(abs(att)) DESC, feature) AS rank FROM a GROUP BY 1 ORDER BY 3 LIMIT 20")
def shap_linear(s, d):
    return rounded(importance.mean_importance(_attributions(s, d), [], 20))


def _attributions(s, d):
    f = fx.features(s, d)
    c = f.groupBy("feature").agg(F.corr("value", F.col("truth").cast("double")).alias("coefficient"))
    return importance.linear_attributions(f, c, "id")


@query(f"WITH c AS (SELECT feature, corr(value, truth) AS coefficient FROM {fx.FEATURES} GROUP BY 1), a AS (SELECT f.feature, value, coefficient * (value - avg(value) OVER (PARTITION BY f.feature)) AS att, quantile_cont(value, 0.25) OVER (PARTITION BY f.feature) AS q1, quantile_cont(value, 0.75) OVER (PARTITION BY f.feature) AS q3 FROM {fx.FEATURES} f JOIN c ON f.feature = c.feature), k AS (SELECT feature, avg(CASE WHEN value >= q3 THEN att END) - avg(CASE WHEN value <= q1 THEN att END) AS contrast FROM a GROUP BY 1) SELECT feature, round(contrast, 6) AS contrast, CASE WHEN contrast > 0.002 THEN 'Adverse' WHEN contrast < -0.002 THEN 'Protective' ELSE 'Neutral' END AS direction FROM k")
def direction_quartile(s, d):
    return rounded(importance.directions(_attributions(s, d), [], 0.002))


@query(f"WITH a AS (SELECT feature, rank, CASE WHEN length(feature) % 2 = 0 THEN 'up' ELSE 'down' END AS d FROM {RANKS.format('n', '< 25')}), b AS (SELECT feature, rank, CASE WHEN feature > 'Brand#3' THEN 'up' ELSE 'down' END AS d FROM {RANKS.format('n', '>= 25')}), j AS (SELECT a.rank AS ra, b.rank AS rb, a.d AS da, b.d AS db, t FROM a JOIN b ON a.feature = b.feature, (VALUES (5), (10), (20)) v(t)) SELECT t AS top_n, sum((ra <= t AND rb <= t)::INT)::BIGINT AS overlap, round(100e0 * sum((ra <= t AND rb <= t)::INT) / t, 6) AS overlap_pct, sum((ra <= t AND rb <= t AND da = db)::INT)::BIGINT AS concordant, round(100e0 * sum((ra <= t AND rb <= t AND da = db)::INT) / nullif(sum((ra <= t AND rb <= t)::INT), 0), 6) AS concordant_pct FROM j GROUP BY 1")
def rank_overlap_concordance(s, d):
    a = _ranking(s, d, "n", "p_size < 25").withColumn("direction", F.when(F.length("feature") % 2 == 0, "up").otherwise("down"))
    b = _ranking(s, d, "n", "p_size >= 25").withColumn("direction", F.when(F.col("feature") > "Brand#3", "up").otherwise("down"))
    return rounded(importance.overlap(a, b, (5, 10, 20)))


@query()
def shap_sampled(s, d):
    import numpy as np

    weights = np.linspace(-1, 1, 64)
    rows = landed(s, d, "embeddings", ["vec_id", "embedding"]).select(F.col("vec_id").alias("id"), F.expr("transform(embedding, x -> CAST(x AS DOUBLE))").alias("features"))
    # the background: 32 rows of the whole table, drawn by hash
    back = np.array([r["features"] for r in rows.orderBy(F.xxhash64(F.lit("background"), "id"), "id").limit(32).collect()])
    att = importance.sampled_attributions(rows, "id", [f"f{k}" for k in range(64)], lambda z: 1 / (1 + np.exp(-z @ weights)), back, permutations=4)
    return rounded(importance.mean_importance(att, []))


# ---- cross-layer blocks ---------------------------------------------------------------

def _halves(s, d, truth):
    f = fx.features(s, d).where(F.col("truth") == truth)
    return f.where("k < 32"), f.where("k >= 32")


CORR = f"(SELECT a.feature AS x, b.feature AS y, count(*) AS n, corr(a.value, b.value) AS r FROM (SELECT * FROM {fx.FEATURES} WHERE k < 32 AND truth = {{0}}) a JOIN (SELECT * FROM {fx.FEATURES} WHERE k >= 32 AND truth = {{0}}) b ON a.id = b.id GROUP BY 1, 2)"


@query(f"SELECT x, y, n, round(r, 6) AS r FROM {CORR.format(1)}")
def cross_corr_long(s, d):
    return rounded(blocks.correlate(*_halves(s, d, 1), "id"))


@query(f"SELECT x, y, n, round(r, 6) AS r FROM {CORR.format(1)}")
def cross_corr_blocked(s, d):
    rows = landed(s, d, "embeddings", ["embedding", "label"]).where("label < 5").select(F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"))
    names = [f"f{k:02d}" for k in range(64)]
    return rounded(blocks.correlate_wide(rows, "x", "y", names[:32], names[32:]))


@query(f"SELECT d.x, d.y, round(d.r, 6) AS r_d, round(a.r, 6) AS r_a, round(CASE WHEN abs(d.r) >= abs(a.r) THEN d.r ELSE a.r END, 6) AS r FROM {CORR.format(1)} d JOIN {CORR.format(0)} a ON d.x = a.x AND d.y = a.y")
def signed_larger_magnitude(s, d):
    dd, aa = (blocks.correlate(*_halves(s, d, t), "id") for t in (1, 0))
    return rounded(blocks.two_group_table(dd, aa).select("x", "y", "r_d", "r_a", "r"))


@query()
def cross_corr_two_group(s, d):
    dd, aa = (blocks.correlate(*_halves(s, d, t), "id") for t in (1, 0))
    return rounded(blocks.two_group_table(dd, aa))


@query(f"SELECT d.x, d.y, round((atanh(d.r) - atanh(a.r)) / sqrt(1e0 / (d.n - 3) + 1e0 / (a.n - 3)), 6) AS z FROM {CORR.format(1)} d JOIN {CORR.format(0)} a ON d.x = a.x AND d.y = a.y")
def fisher_z_difference(s, d):
    dd, aa = (blocks.correlate(*_halves(s, d, t), "id") for t in (1, 0))
    return rounded(blocks.z_differences(dd, aa).select("x", "y", "z"))


@query("SELECT p_partkey, round(CASE WHEN a <= 1 THEN 0 ELSE -(p_size / 2e0) * (a - 1 - ln(a)) / ln(10e0) END, 6) AS bound FROM (SELECT p_partkey, p_size, p_retailprice / 1000e0 AS a FROM part)")
def chernoff_bound(s, d):
    p = landed(s, d, "part", ["p_partkey", "p_size", "p_retailprice"])
    return rounded(p.select("p_partkey", scalars.chernoff_log10(F.col("p_retailprice") / 1000.0, F.col("p_size").cast("double")).alias("bound")))


MEMBERS = "(SELECT 1 + (substr(feature, 2)::INT % 3) AS block_id, CASE WHEN k < 32 THEN 'x' ELSE 'y' END AS axis, feature FROM (SELECT DISTINCT feature, k FROM " + fx.FEATURES + "))"


def _members(s, d):
    f = fx.features(s, d).select("feature", "k").distinct()
    return f.select((F.col("k") % 3 + 1).cast("int").alias("block_id"), F.when(F.col("k") < 32, "x").otherwise("y").alias("axis"), "feature", F.row_number().over(Window.partitionBy(F.col("k") % 3, F.col("k") < 32).orderBy("feature")).alias("ord"))


@query(f"WITH m AS {MEMBERS}, e AS (SELECT d.x, d.y, d.r AS r_d, a.r AS r_a, CASE WHEN abs(d.r) >= abs(a.r) THEN d.r ELSE a.r END AS r FROM {CORR.format(1)} d JOIN {CORR.format(0)} a ON d.x = a.x AND d.y = a.y) SELECT mx.block_id, count(DISTINCT x) AS len_x, count(DISTINCT y) AS len_y, round(avg(r), 6) AS mean_r, round(avg(r_d), 6) AS mean_r_d, round(avg(r_a), 6) AS mean_r_a FROM e JOIN m mx ON mx.axis = 'x' AND mx.feature = e.x JOIN m my ON my.axis = 'y' AND my.feature = e.y AND my.block_id = mx.block_id GROUP BY 1")
def block_summary(s, d):
    dd, aa = (blocks.correlate(*_halves(s, d, t), "id") for t in (1, 0))
    return rounded(blocks.block_summary(blocks.two_group_table(dd, aa), _members(s, d)).drop("mean_nlp"))


@query(f"WITH m AS {MEMBERS}, z AS (SELECT d.x, d.y, atanh(d.r) AS zd, atanh(a.r) AS za, (atanh(d.r) - atanh(a.r)) / sqrt(1e0 / (d.n - 3) + 1e0 / (a.n - 3)) AS z FROM {CORR.format(1)} d JOIN {CORR.format(0)} a ON d.x = a.x AND d.y = a.y) SELECT mx.block_id, count(z) AS n_valid, round(sum(z * z), 6) AS sum_z2, round(max(abs(z)), 6) AS max_abs_z, round(avg(abs(z)), 6) AS mean_abs_z, sum((z > 0)::INT)::BIGINT AS n_pos, sum((z < 0)::INT)::BIGINT AS n_neg, round(tanh(avg(zd)), 6) AS r_d, round(tanh(avg(za)), 6) AS r_a, round(avg(zd) - avg(za), 6) AS delta, round(avg(abs(zd - za)), 6) AS delta_abs_r, round(least(abs(tanh(avg(zd))), abs(tanh(avg(za)))), 6) AS min_abs_r, round(greatest(abs(tanh(avg(zd))), abs(tanh(avg(za)))), 6) AS max_abs_r FROM z JOIN m mx ON mx.axis = 'x' AND mx.feature = z.x JOIN m my ON my.axis = 'y' AND my.feature = z.y AND my.block_id = mx.block_id GROUP BY 1")
def fisher_combining(s, d):
    dd, aa = (blocks.correlate(*_halves(s, d, t), "id") for t in (1, 0))
    return rounded(blocks.block_statistics(blocks.z_differences(dd, aa), _members(s, d)).drop("mean_z_d", "mean_z_a"))


def _planted_edges(s, d):
    p = fx.planted(s, d)
    xs, ys = [f"x{k:02d}" for k in range(32)], [f"y{k:02d}" for k in range(32)]
    one = lambda t: blocks.correlate_wide(p.where(F.col("truth") == t), "x", "y", xs, ys)
    return blocks.two_group_table(one(1), one(0)).withColumn("pair", F.lit("x_y"))


@query()
def peel_bipartite(s, d):
    return rounded(blocks.find_blocks(_planted_edges(s, d), ["pair"], 1.4))


@query()
def peel_symmetric(s, d):
    names = [f"x{k:02d}" for k in range(32)]
    edges = blocks.correlate_wide(fx.planted(s, d).where("truth = 1").select("x", F.col("x").alias("y")), "x", "y", names, names)
    return rounded(blocks.find_communities(edges.withColumn("r", F.abs("r")).withColumn("pair", F.lit("x")), ["pair"], 1.2).drop("pair"))


PERMUTATIONS = 40


@query()
def permutation_search(s, d):
    how = blocks.Search(lam=(1.4, 1.5, 1.5), x_size=(0, 15), y_size=(0, 15))
    return rounded(blocks.permutation_log(fx.planted(s, d), "id", "x", "y", "truth", blocks.permutation_shard(s, PERMUTATIONS), how))


@query()
def permutation_p_value(s, d):
    return rounded(inference.permutation_p(permutation_search(s, d), "a_diff", PERMUTATIONS))


# ---- small rules ----------------------------------------------------------------------

@query("SELECT n_nationkey AS at, n_name, c_custkey, c_mktsegment FROM nation LEFT JOIN customer ON c_custkey = n_nationkey * 7")
def index_match_alignment(s, d):
    ids = landed(s, d, "nation", ["n_nationkey", "n_name"]).select((F.col("n_nationkey") * 7).cast("bigint").alias("c_custkey"), F.col("n_nationkey").alias("at"))
    c = landed(s, d, "customer", ["c_custkey", "c_mktsegment"]).withColumn("found", F.col("c_custkey"))
    out = relational.aligned(ids, c, "c_custkey", "at").join(landed(s, d, "nation", ["n_nationkey", "n_name"]), F.col("at") == F.col("n_nationkey"))
    return out.select("at", "n_name", F.col("found").alias("c_custkey"), "c_mktsegment")


@query("SELECT r_name AS layer, kind, size FROM region, (VALUES ('sis', 10), ('mrmr', 5), ('none', NULL)) AS t(kind, size)")
def specification_grid(s, d):
    specs = s.createDataFrame([("sis", 10), ("mrmr", 5), ("none", None)], "kind string, size int")
    return screening.plan_grid(landed(s, d, "region", ["r_name"]).select(F.col("r_name").alias("layer")), specs)


@query("SELECT feature, round(coefficient, 6) AS coefficient, row_number() OVER (ORDER BY abs(coefficient) DESC, feature) AS rank FROM (SELECT p_brand || '-' || p_size AS feature, avg(p_retailprice - 1000) * (p_size % 3) AS coefficient FROM part GROUP BY p_brand, p_size) WHERE coefficient <> 0")
def coefficient_ranking(s, d):
    p = landed(s, d, "part", ["p_brand", "p_size", "p_retailprice"]).groupBy("p_brand", "p_size").agg(F.avg(F.col("p_retailprice") - 1000).alias("m"))
    return rounded(importance.coefficient_importance(p.select(F.concat_ws("-", "p_brand", "p_size").alias("feature"), (F.col("m") * (F.col("p_size") % 3)).alias("coefficient"))))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey % 2 = 0 AND o_orderkey NOT IN (1, 5, 7)")
def eligible_layer_rows(s, d):
    o = landed(s, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"]).withColumn("antibiotics", F.when(F.col("o_custkey") % 2 == 0, "No").otherwise("Yes"))
    return recodes.eligible_layer_rows(o, "o_orderstatus", ["F", "O"], "antibiotics", ("o_orderkey", [1, 5, 7])).select("o_orderkey", "o_orderstatus")


EDGES = f"(SELECT d.x, d.y, CASE WHEN abs(d.r) >= abs(a.r) THEN d.r ELSE a.r END AS r, abs(d.r) + abs(a.r) AS nlp FROM {CORR.format(1)} d JOIN {CORR.format(0)} a ON d.x = a.x AND d.y = a.y)"


def _edges(s, d):
    dd, aa = (blocks.correlate(*_halves(s, d, t), "id") for t in (1, 0))
    return blocks.two_group_table(dd, aa).withColumn("nlp", F.abs("r_d") + F.abs("r_a"))


@query(f"WITH m AS {MEMBERS}, e AS (SELECT mx.block_id, x, y, nlp FROM {EDGES} e JOIN m mx ON mx.axis = 'x' AND mx.feature = e.x JOIN m my ON my.axis = 'y' AND my.feature = e.y AND my.block_id = mx.block_id), b AS (SELECT block_id, 'x' AS axis, x AS feature, sum(nlp) AS marginal FROM e GROUP BY 1, 3 UNION ALL SELECT block_id, 'y', y, sum(nlp) FROM e GROUP BY 1, 3) SELECT block_id, axis, feature, round(marginal, 6) AS marginal, row_number() OVER (PARTITION BY block_id, axis ORDER BY abs(round(marginal, 9)) DESC, feature) AS ord FROM b")
def block_feature_order(s, d):
    return rounded(blocks.feature_order(_edges(s, d), _members(s, d)))


@query(f"WITH m AS (SELECT *, row_number() OVER (PARTITION BY block_id, axis ORDER BY feature) AS ord FROM {MEMBERS}) SELECT mx.block_id, mx.ord AS row, my.ord AS col, round(least(greatest(r, -0.1), 0.1), 6) AS value, least(floor(round((least(greatest(r, -0.1), 0.1) + 0.1) / 0.2 * 10, 9)) + 1, 10)::BIGINT AS colour FROM {EDGES} e JOIN m mx ON mx.axis = 'x' AND mx.feature = e.x JOIN m my ON my.axis = 'y' AND my.feature = e.y AND my.block_id = mx.block_id")
def heat_map_cells(s, d):
    return rounded(blocks.cell_table(_edges(s, d), _members(s, d), -0.1, 0.1, 10).withColumn("colour", F.col("colour").cast("bigint")))


@query("SELECT DISTINCT c_custkey FROM customer INTERSECT SELECT user_id FROM events")
def set_intersection(s, d):
    return landed(s, d, "customer", ["c_custkey"]).intersect(landed(s, d, "events", ["user_id"]))


@query("SELECT c_custkey AS id, c_mktsegment, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON c_custkey = o_custkey")
def left_join_matched(s, d):
    n = landed(s, d, "orders", ["o_custkey", "o_orderpriority"]).where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return relational.matched_left_join(landed(s, d, "customer", ["c_custkey", "c_mktsegment"]).withColumnRenamed("c_custkey", "id"), n, "id")[0]


@query(f"SELECT id, truth, s1, s2 FROM {fx.SCORES}")
def asserted_inner_join(s, d):
    t = fx.scores(s, d)
    return relational.aligned_join(t.select("id", "truth", "s1"), t.select("id", "truth", "s2"), "id", "truth")


@query("SELECT COLUMNS('^l_.*(key|date)$') FROM lineitem")
def columns_by_pattern(s, d):
    t = landed(s, d, "lineitem", None)
    return t.select(relational.pick_columns(t, "^l_.*(key|date)$"))


NATIONS = "(SELECT r_name, count(*)::DOUBLE AS nations, avg(n_nationkey) AS mean_key FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)"
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query(f"SELECT name, {', '.join(f"""max(CASE WHEN r_name = '{r}' THEN v END) AS "{r}" """ for r in REGIONS)} FROM (SELECT r_name, 'nations' AS name, nations AS v FROM {NATIONS} UNION ALL SELECT r_name, 'mean_key', mean_key FROM {NATIONS}) GROUP BY name")
def transposed_table(s, d):
    n = landed(s, d, "nation", ["n_nationkey", "n_regionkey"]).join(landed(s, d, "region", ["r_regionkey", "r_name"]), F.col("n_regionkey") == F.col("r_regionkey"))
    return relational.transposed(n.groupBy("r_name").agg(F.count("*").alias("nations"), F.avg("n_nationkey").alias("mean_key")), "r_name", ["nations", "mean_key"])


@query("SELECT r_name, upper(r_name[1]) || lower(r_name[2:5]) AS title, CASE r_name WHEN 'ASIA' THEN 'east' ELSE r_name END AS alias, trim(r_name || '  ') AS id FROM region")
def small_labels(s, d):
    return landed(s, d, "region", ["r_name"]).select(
        "r_name", labels.title_case(F.lower(F.substring("r_name", 1, 5))).alias("title"), labels.canonical(F.col("r_name"), {"ASIA": "east"}).alias("alias"), scalars.as_id(F.concat(F.col("r_name"), F.lit("  "))).alias("id")
    )


@query(f"WITH r AS (SELECT s1, s2, rank() OVER (ORDER BY s1) + (count(*) OVER (PARTITION BY s1) - 1) / 2e0 AS a, rank() OVER (ORDER BY s2) + (count(*) OVER (PARTITION BY s2) - 1) / 2e0 AS b FROM {fx.SCORES}) SELECT round(corr(s1, s2), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM r")
def oof_agreement(s, d):
    t = fx.scores(s, d)
    return rounded(models.oof_agreement(t.select("id", F.col("s1").alias("risk")), t.select("id", F.col("s2").alias("risk")), "id"))


LOG = "(SELECT o_custkey % 60 AS perm_id, max(o_totalprice / (1 + o_custkey % 7)) AS s FROM orders WHERE o_custkey % 60 NOT IN (11, 13, 17) GROUP BY 1)"


@query(f"SELECT round((SELECT s FROM {LOG} WHERE perm_id = 0), 6) AS observed, 59::BIGINT AS permutations, round((1 + (SELECT count(*) FROM {LOG} WHERE perm_id > 0 AND s >= (SELECT s FROM {LOG} WHERE perm_id = 0))) / 60e0, 6) AS p_value")
def permutation_p_of_log(s, d):
    o = landed(s, d, "orders", ["o_custkey", "o_totalprice"]).where("o_custkey % 60 NOT IN (11, 13, 17)")
    log = o.select((F.col("o_custkey") % 60).alias("perm_id"), (F.col("o_totalprice") / (1 + F.col("o_custkey") % 7)).alias("s"))
    return rounded(inference.permutation_p(log, "s", 59))


@query("SELECT coalesce(f.layer, c.layer) AS layer, f.n, c.n AS declared_n FROM (SELECT o_orderpriority AS layer, count(*) AS n FROM orders GROUP BY 1) f FULL JOIN (SELECT o_orderpriority AS layer, count(*) + (o_orderpriority = '2-HIGH')::INT AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1) c ON f.layer = c.layer WHERE f.n IS DISTINCT FROM c.n")
def contract_faults(s, d):
    o = landed(s, d, "orders", ["o_orderpriority"]).groupBy(F.col("o_orderpriority").alias("layer")).agg(F.count("*").alias("n"))
    declared = o.where("layer <> '5-LOW'").withColumn("n", F.col("n") + (F.col("layer") == "2-HIGH").cast("int"))
    return contracts.contract_faults(o, declared, "layer")


@query()
def characteristics_with_p(s, d):
    c = fx.clinical(s, d).withColumn("funded", F.when(F.col("balance") > 0, "Yes").when(F.col("balance").isNotNull(), "No"))
    return rounded(tables.characteristics(c, "id", "truth", ["region", "segment"], ["funded"], ["balance", "spend", "n_events"], permutations=50))


# ---- sources and sinks ----------------------------------------------------------------

def _text_file(s, head: list[str], lines, path: str) -> None:
    """One file of some lines, then ``lines(value, at)`` in the order of ``at``."""
    first = s.createDataFrame([(v, k - len(head)) for k, v in enumerate(head)], "value string, at int")
    first.unionByName(lines.withColumn("at", F.col("at").cast("int"))).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(s, d):
    t, path = landed(s, d, "supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]), own_folder(s)
    sinks.write_csv(t, path)
    return read_csv(s, path, t.schema)


@query("SELECT c_mktsegment, c_custkey % 3 AS part, count(*) AS n FROM customer GROUP BY 1, 2")
def append_log(s, d):
    path = own_folder(s)
    for k in range(3):
        sinks.append(landed(s, d, "customer", ["c_custkey", "c_mktsegment"]).where(F.col("c_custkey") % 3 == k).withColumn("part", F.lit(k).cast("bigint")), path)
    return s.read.parquet(path).groupBy("c_mktsegment", "part").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def replaced_table(s, d):
    path, t = own_folder(s), landed(s, d, "nation", ["n_nationkey", "n_name"])
    sinks.replace(t.where("n_nationkey < 5"), path)
    sinks.replace(t, path)
    return s.read.parquet(path)


@query("SELECT r_regionkey, r_name FROM region")
def cached_table(s, d):
    path, t = own_folder(s), landed(s, d, "region", ["r_regionkey", "r_name"])
    sinks.cached(s, path, lambda: t)
    return sinks.cached(s, path, lambda: t.limit(0))


@query("SELECT r_regionkey, r_name, 'kept' AS state FROM region")
def design_matched_checkpoint(s, d):
    path, t = own_folder(s), landed(s, d, "region", ["r_regionkey", "r_name"])
    sinks.write_with_design(t, path, {"seed": 1, "folds": 5})
    other = sinks.read_if_same_design(s, path, {"seed": 2, "folds": 5})
    found = sinks.read_if_same_design(s, path, {"folds": 5, "seed": 1})
    return found.withColumn("state", F.lit("kept" if other is None else "stale"))


@query("SELECT n_nationkey::VARCHAR AS id, feature, value FROM (SELECT n_nationkey, 'seq.' || k AS feature, CASE WHEN (n_nationkey + k) % 5 <> 0 THEN n_nationkey * k / 2e0 END AS value FROM nation, range(1, 4) AS t(k))")
def text_matrix_scan(s, d):
    n, path = F.col("n_nationkey"), own_folder(s)
    cells = [F.when((n + k) % 5 == 0, F.lit("x")).otherwise((n * k / 2.0).cast("string")) for k in range(1, 4)]
    lines = landed(s, d, "nation", ["n_nationkey"]).select(F.concat_ws("\t", n.cast("string"), *cells).alias("value"), n.alias("at"))
    _text_file(s, ["!Version\t1", "^TABLE_BEGIN", "SampleId\tseq.1\tseq.2\tseq.3"], lines, path)
    return read_matrix_text(s, path, "SampleId")


@query("SELECT 's' || r_regionkey AS SeqId, r_name AS Target, lower(r_name) AS \"Target.1\" FROM region")
def found_header_scan(s, d):
    path = own_folder(s)
    body = landed(s, d, "region", ["r_regionkey", "r_name"]).select(F.concat_ws(",", F.concat(F.lit("s"), "r_regionkey"), "r_name", F.lower("r_name")).alias("value"), F.col("r_regionkey").alias("at"))
    _text_file(s, ["exported,,", "by hand,,", " SeqId ,Target,Target"], body, path)
    return read_with_found_header(s, path, "SeqId")


@query("SELECT 's' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS balance FROM supplier")
def sheet_by_index(s, d):
    path = f"{own_folder(s)}.xlsx"
    t = landed(s, d, "supplier", ["s_suppkey", "s_name", "s_acctbal"]).select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("balance"))
    sheets.write_workbook({"notes": s.createDataFrame([("a & b", 1)], "note string, n int"), "data": t}, path)
    return sheets.read_sheet(s, path, 2).withColumn("balance", F.col("balance").cast("double"))


@query("SELECT id, model, round(CASE WHEN model = 's2' THEN 0 - risk ELSE risk END, 6) AS attribution FROM " + PRED)
def attribution_signs(s, d):
    return rounded(importance.towards_event(fx.predictions(s, d).select("id", "model", F.col("risk").alias("attribution")), "model", ["s2"]))


@query("SELECT md5(string_agg(r_name || chr(10), '' ORDER BY r_regionkey)) AS md5, sum(length(r_name) + 1)::BIGINT AS bytes FROM region")
def manifest_of_files(s, d):
    path = own_folder(s)
    landed(s, d, "region", ["r_regionkey", "r_name"]).coalesce(1).sortWithinPartitions("r_regionkey").select("r_name").write.text(path)
    return file_manifest(s, path, "*.txt").select("md5", "bytes")


@query("""SELECT coalesce(b.part, a.part) AS part, coalesce(b.name, a.name) AS name, CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM (SELECT o_orderpriority AS part, o_orderkey::VARCHAR AS name, o_custkey AS v FROM orders WHERE o_orderpriority <> '1-URGENT') b
 FULL JOIN (SELECT o_orderpriority AS part, o_orderkey::VARCHAR AS name, CASE WHEN o_orderstatus = 'O' THEN -1 ELSE o_custkey END AS v FROM orders WHERE o_orderstatus <> 'P') a
 ON a.part = b.part AND a.name = b.name WHERE a.v IS DISTINCT FROM b.v""")
def provenance_changes(s, d):
    o = landed(s, d, "orders", ["o_orderkey", "o_orderpriority", "o_custkey", "o_orderstatus"])
    entries = lambda t, v: t.select(F.col("o_orderpriority").alias("part"), F.col("o_orderkey").cast("string").alias("name"), F.md5(v.cast("string")).alias("digest"))
    before = entries(o.where("o_orderpriority <> '1-URGENT'"), F.col("o_custkey"))
    after = entries(o.where("o_orderstatus <> 'P'"), F.when(F.col("o_orderstatus") == "O", -1).otherwise(F.col("o_custkey")))
    return provenance.changes(before, after)


# ---- models ---------------------------------------------------------------------------

def _model_frame(s, d):
    docs = landed(s, d, "embeddings", ["vec_id", "embedding", "label"])
    latent = F.conv(F.substring(F.md5(F.concat(F.lit("m|"), F.col("vec_id").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    label = (F.col("label") < 5).cast("double")
    return docs.select(F.col("vec_id").alias("id"), label.alias("label"), (label + 2 * latent).alias("a"), F.when(F.col("vec_id") % 9 != 0, F.col("embedding")[0].cast("double")).alias("b"), F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("c"))


NAMES = tuple(f"f{k:02d}" for k in range(16))


def _nested(s, d):
    """The whole table, small grids: 2 outer and 2 inner folds, three learners, screens learnt in every analysis set. A run of its own."""
    rows = _model_frame(s, d).join(landed(s, d, "embeddings", ["vec_id", "embedding"]).select(F.col("vec_id").alias("id"), F.slice("embedding", 1, len(NAMES)).alias("layer")), "id")
    folds = resampling.stratified_folds(rows, "id", ["label"], 2)
    inner = resampling.inner_folds(folds, "id", ["label"], 2)
    learners = [
        models.Learner("elastic", "elastic", ("a", "b"), ("c",), ({"regParam": 0.01, "elasticNetParam": 0.5}, {"regParam": 0.1, "elasticNetParam": 0.0})),
        models.Learner("forest", "forest", ("a",), (), ({"numTrees": 10, "minInstancesPerNode": 5},), "layer", NAMES, ("sis", 4)),
        models.Learner("boosted", "boosted", ("a",), (), ({"maxIter": 6, "maxDepth": 2, "stepSize": 0.3, "subsamplingRate": 0.9},), "layer", NAMES, ("mrmr", 3), stop=True),
    ]
    return models.nested_cv(rows, "id", folds, inner, learners, own_folder(s))


@query()
def nested_cv_predictions(s, d):
    return _nested(s, d)[0]


@query()
def nested_cv_tuning(s, d):
    return _nested(s, d)[2]


@query()
def stack_ridge(s, d):
    outer, inner, _ = _nested(s, d)
    return models.stack_ridge(inner, outer, "id", ["elastic", "forest"])[0]


# ---- streams --------------------------------------------------------------------------

@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def event_windows(s, d):
    return rounded(windowed_summary(landed(s, d, "events", ["ts", "event_type", "value"])))


from tessera.plans import modelling  # noqa: E402, F401  its queries are registered as it is read
