"""The engine's operators over the driver tables, each with the SQL that gives the same rows.

The catalogue of these queries counts line items by supplier nation (sample) and
by return flag, line status and ship month (channel). Where cells must be
absent, suppliers are the samples and ship days the channels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import matrix as M
from ..sources import catalog as C
from . import extract as X
from . import report as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CATALOG_SQL = """catalog AS (SELECT l_returnflag || '[' || l_linestatus || ']' || month(l_shipdate) AS channel, n_name AS sample, count(*) AS cnt
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""
SPARSE_SQL = """sparse AS (SELECT 'd' || dayofyear(l_shipdate) AS channel, 's' || s_suppkey AS sample, count(*) FILTER (WHERE s_suppkey % 7 <> 0) AS cnt
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
#: A rank-2 factorisation given by a formula: weights by channel, activities by sample.
WH_SQL = """w AS (SELECT channel, s.signature, CASE s.signature WHEN 'A' THEN 1 + length(channel) % 3 + ascii(channel) % 5 ELSE 1 + ascii(channel) % 3 END::DOUBLE AS weight
 FROM (SELECT DISTINCT channel FROM catalog), (VALUES ('A'), ('B')) s(signature)),
h AS (SELECT sample, s.signature, CASE s.signature WHEN 'A' THEN 10 + length(sample) ELSE 20 + ascii(sample) % 7 END::DOUBLE AS activity FROM (SELECT DISTINCT
 sample FROM catalog), (VALUES ('A'), ('B')) s(signature)),
est AS (SELECT channel, sample, sum(weight * activity) AS est FROM w JOIN h USING (signature) GROUP BY 1, 2)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def catalog(spark: SparkSession, d: str) -> DataFrame:
    item = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")
    where = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    joined = item.join(where, F.col("l_suppkey") == F.col("s_suppkey"))
    channel = F.concat("l_returnflag", F.lit("["), "l_linestatus", F.lit("]"), F.month("l_shipdate").cast("string"))
    return C.count_events(joined, channel, F.col("n_name"))


def sparse(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a number divisible by 7 have cells of zero."""
    joined = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    cells = C.count_events(joined, F.concat(F.lit("d"), F.dayofyear("l_shipdate")), F.concat(F.lit("s"), "s_suppkey"))
    return cells.withColumn("cnt", F.when(F.substring("sample", 2, 20).cast("int") % 7 == 0, 0).otherwise(F.col("cnt")))


def factors(cat: DataFrame) -> tuple[DataFrame, DataFrame]:
    two = F.explode(F.array(F.lit("A"), F.lit("B"))).alias("signature")
    a = F.col("signature") == "A"
    w = cat.select("channel").distinct().select("channel", two).withColumn("weight", F.when(a, 1 + F.length("channel") % 3 + F.ascii("channel") % 5).otherwise(1 + F.ascii("channel") % 3).cast("double"))
    h = cat.select("sample").distinct().select("sample", two).withColumn("activity", F.when(a, 10 + F.length("sample")).otherwise(20 + F.ascii("sample") % 7).cast("double"))
    return w, h


def six(df: DataFrame, *cols: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), to) for c in cols})


@query(f"WITH {CATALOG_SQL} SELECT * FROM catalog")
def catalog_long(spark, d):
    return catalog(spark, d)


#: The samples of the catalogue: the names of all nations, a fixed list.
NATIONS = [f"NATION_{i}" for i in range(25)]


@query(f"WITH {CATALOG_SQL} SELECT channel, " + ", ".join(f"coalesce(sum(cnt) FILTER (WHERE sample = '{n}'), 0)::BIGINT AS \"{n}\"" for n in NATIONS) + " FROM catalog GROUP BY channel")
def catalog_wide(spark, d):
    return C.to_wide(catalog(spark, d), NATIONS)


@query(f"WITH {CATALOG_SQL} SELECT channel, sample, cnt::DOUBLE AS cnt FROM catalog")
def melt(spark, d):
    return C.to_long(C.to_wide(catalog(spark, d), NATIONS)).where("cnt > 0")


@query(f"WITH {SPARSE_SQL} SELECT * FROM sparse WHERE sample IN (SELECT sample FROM sparse GROUP BY 1 HAVING sum(cnt) > 0)")
def drop_zero(spark, d):
    return M.drop_zero_samples(sparse(spark, d))


@query(f"WITH {SPARSE_SQL}, n AS (SELECT channel, sample, CASE WHEN NOT (channel = 'd10' AND cnt = 1) THEN cnt END AS cnt FROM sparse) SELECT * FROM n WHERE sample NOT IN (SELECT sample FROM n WHERE cnt IS NULL)")
def drop_null(spark, d):
    cells = sparse(spark, d)
    return M.drop_null_samples(cells.withColumn("cnt", F.when(~((F.col("channel") == "d10") & (F.col("cnt") == 1)), F.col("cnt"))))


@query("SELECT a.n_nationkey, a.n_regionkey, a.n_name, b.suppliers FROM nation a JOIN (SELECT n_nationkey, n_regionkey, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) b USING (n_nationkey, n_regionkey)")
def csv_merge(spark, d):
    nation = table(spark, d, "nation")
    count = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_regionkey").agg(F.count("*").alias("suppliers"))
    return C.merge_matrices([nation, count], ["n_nationkey", "n_regionkey"])


@query(f"""WITH {SPARSE_SQL}, o AS (SELECT 'd' || i AS channel, i AS channel_idx FROM range(1, 367) t(i)), s AS (SELECT DISTINCT sample FROM sparse)
SELECT channel, sample, channel_idx::INTEGER AS channel_idx, coalesce(cnt, 0) AS cnt FROM o CROSS JOIN s LEFT JOIN sparse USING (channel, sample)""")
def order_align(spark, d):
    order = spark.range(1, 367).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("channel"), F.col("id").cast("int").alias("channel_idx"))
    return C.align(sparse(spark, d), order).select("channel", "sample", "channel_idx", "cnt")


@query(f"WITH {CATALOG_SQL} SELECT sample, sum(cnt)::BIGINT AS total FROM catalog GROUP BY 1")
def totals(spark, d):
    return M.totals(catalog(spark, d))


@query(f"WITH {SPARSE_SQL} SELECT channel, sample, greatest(cnt, 0.0001)::DOUBLE AS cnt FROM sparse")
def floor_cells(spark, d):
    return M.floor_cells(sparse(spark, d))


def _norm_sql(cutoff: str) -> str:
    return f"WITH {CATALOG_SQL}, t AS (SELECT *, sum(cnt) OVER (PARTITION BY sample) AS total FROM catalog) SELECT channel, sample, round(CASE WHEN total > {cutoff} THEN cnt::DOUBLE / total * {cutoff} ELSE cnt END, 6) AS cnt FROM t"


@query(_norm_sql("2000::DOUBLE"))
def norm_gmm(spark, d):
    return six(M.normalise(catalog(spark, d), "gmm", 2000), "cnt")


@query(_norm_sql("(100 * (SELECT count(DISTINCT channel) FROM catalog))::DOUBLE"))
def norm_100x(spark, d):
    return six(M.normalise(catalog(spark, d), "100X"), "cnt")


@query(_norm_sql("1500::DOUBLE"))
def norm_numeric(spark, d):
    return six(M.normalise(catalog(spark, d), "1500"), "cnt")


@query(f"WITH {CATALOG_SQL}, t AS (SELECT *, sum(cnt) OVER (PARTITION BY sample)::DOUBLE AS total FROM catalog) SELECT channel, sample, round(cnt / total * log2(total), 6) AS cnt FROM t")
def norm_log2(spark, d):
    return six(M.normalise(catalog(spark, d), "log2"), "cnt")


@query(f"WITH {CATALOG_SQL}, {WH_SQL}, t AS (SELECT sample, sum(cnt) AS total FROM catalog GROUP BY 1) SELECT sample, signature, round_even(activity / sum(activity) OVER (PARTITION BY sample) * total, 0) AS activity FROM h JOIN t USING (sample)")
def denorm(spark, d):
    cat = catalog(spark, d)
    return M.denormalise(factors(cat)[1], M.totals(cat))


@query(f"WITH {CATALOG_SQL}, {WH_SQL} SELECT channel, signature, round(weight / sum(weight) OVER (PARTITION BY signature), 8) AS weight FROM w")
def l1_norm(spark, d):
    return six(M.l1_normalise(factors(catalog(spark, d))[0]), "weight", to=8)


@query(f"WITH {CATALOG_SQL}, {WH_SQL} SELECT sample, signature, round(activity * (SELECT sum(weight) FROM w WHERE w.signature = h.signature), 6) AS activity FROM h")
def rescale(spark, d):
    return six(M.rescale(*factors(catalog(spark, d))), "activity")


@query(f"WITH {CATALOG_SQL} SELECT floor(avg(total) + 2 * stddev_pop(total))::BIGINT AS cutoff FROM (SELECT sample, sum(cnt) AS total FROM catalog GROUP BY 1)")
def cutoff_stats(spark, d):
    return M.cutoff_stats(catalog(spark, d))


@query(f"WITH {CATALOG_SQL}, {WH_SQL} SELECT channel, sample, round(est, 6) AS est FROM est")
def matmul(spark, d):
    return six(M.multiply(*factors(catalog(spark, d))), "est")


@query(f"WITH {CATALOG_SQL}, {WH_SQL} SELECT channel, sample, signature, round(weight * activity / sum(weight * activity) OVER (PARTITION BY channel, sample), 6) AS probability FROM w JOIN h USING (signature)")
def probabilities(spark, d):
    return six(M.probabilities(*factors(catalog(spark, d))), "probability")


def _vectors(cat: DataFrame) -> DataFrame:
    return cat.select(F.col("sample").alias("id"), F.col("channel").alias("dim"), F.col("cnt").alias("x"))


@query(f"WITH {CATALOG_SQL} SELECT a.sample AS a, b.sample AS b, round(sum(a.cnt * b.cnt)::DOUBLE / (sqrt(sum(a.cnt * a.cnt)) * sqrt(sum(b.cnt * b.cnt))), 6) AS similarity FROM catalog a JOIN catalog b USING (channel) WHERE a.sample < b.sample GROUP BY 1, 2")
def cos_pairs(spark, d):
    return six(M.pairwise(_vectors(catalog(spark, d))), "similarity")


@query(f"WITH {CATALOG_SQL} SELECT a.sample AS a, b.sample AS b, round(corr(a.cnt, b.cnt), 6) AS similarity FROM catalog a JOIN catalog b USING (channel) WHERE a.sample < b.sample GROUP BY 1, 2")
def corr_pairs(spark, d):
    return six(M.pairwise(_vectors(catalog(spark, d)), "correlation"), "similarity")


SIMILARITY_SQL = """x AS (SELECT e.channel, e.sample, coalesce(cnt, 0)::DOUBLE AS v, est AS q, coalesce(cnt, 0) / sum(coalesce(cnt, 0)) OVER (PARTITION BY e.sample)::DOUBLE AS pv,
 est / sum(est) OVER (PARTITION BY e.sample) AS pq FROM est e LEFT JOIN catalog c ON c.channel = e.channel AND c.sample = e.sample),
similarity AS (SELECT sample, sum(v)::BIGINT AS total_mutations, round(sum(v * q) / (sqrt(sum(v * v)) * sqrt(sum(q * q))), 3) AS cosine, round(sum(abs(v - q)), 3) AS l1,
 round(round(sum(abs(v - q)), 3) * 100 / sum(v), 3) AS l1_pct, round(sqrt(sum((v - q) * (v - q))), 3) AS l2, round(round(sqrt(sum((v - q) * (v - q))), 3) * 100
 / sqrt(sum(v * v)), 3) AS l2_pct,
 round(sum(CASE WHEN pv = 0 THEN 0 ELSE pv * ln(pv / pq) END), 5) AS kl, round(corr(v, q), 3) AS correlation FROM x GROUP BY sample)"""


def _similarity(spark, d) -> DataFrame:
    cat = catalog(spark, d)
    return M.similarity_table(cat, M.multiply(*factors(cat)))


@query(f"WITH {CATALOG_SQL}, {WH_SQL}, {SIMILARITY_SQL} SELECT * FROM similarity")
def similarity_table(spark, d):
    return _similarity(spark, d)


@query(f"""WITH {CATALOG_SQL}, {WH_SQL}, {SIMILARITY_SQL} SELECT round(avg(cosine), 6) AS mean_cosine, max(cosine) AS max_cosine, round(median(l1_pct), 6) AS
 median_l1_pct, max(l1_pct) AS max_l1_pct, round(median(l2_pct), 6) AS median_l2_pct, max(l2_pct) AS max_l2_pct,
 round(avg(kl), 6) AS mean_kl, max(kl) AS max_kl, round(avg(correlation), 6) AS mean_corr, min(correlation) AS min_corr FROM similarity""")
def metric_summary(spark, d):
    return six(M.metric_summary(_similarity(spark, d)), "mean_cosine", "median_l1_pct", "median_l2_pct", "mean_kl", "mean_corr")


@query(f"WITH {CATALOG_SQL}, {WH_SQL} SELECT round(sqrt(sum((coalesce(cnt, 0) - est) ** 2)) / sqrt(sum(cnt * cnt)), 4) AS fro_err FROM est LEFT JOIN catalog USING (channel, sample)")
def fro_error(spark, d):
    cat = catalog(spark, d)
    return M.frobenius_error(cat, M.multiply(*factors(cat)))


@query("SELECT label AS cluster, i::INTEGER AS channel, round(avg(x), 6) AS mean, round(stddev_samp(x) / sqrt(count(x)), 6) AS sem FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2")
def centroid_sem(spark, d):
    cells = table(spark, d, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("replicate"), F.posexplode("embedding").alias("channel", "weight")).withColumn("weight", F.col("weight").cast("double"))
    return six(M.centroids(cells), "mean", "sem")


@query("""WITH e AS (SELECT vec_id AS id, label AS cluster, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id, a.cluster, b.cluster AS c, 1 -
 list_cosine_similarity(a.v, b.v) AS dist FROM e a JOIN e b ON a.id <> b.id),
m AS (SELECT id, cluster, c, avg(dist) AS dist FROM p GROUP BY ALL), ab AS (SELECT id, cluster, max(dist) FILTER (WHERE c = cluster) AS a, min(dist) FILTER
 (WHERE c <> cluster) AS b FROM m GROUP BY 1, 2)
SELECT id, cluster, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM ab""")
def silhouette(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("vector"))
    return six(M.silhouettes(points), "silhouette")


RANKS_SQL = "stats AS (SELECT c_nationkey + 1 AS k, round(0.2 + (min(c_acctbal) + 1000) / 11000, 2) AS min_stability, round(0.2 + avg(c_acctbal) / 6000, 2) AS avg_stability FROM customer GROUP BY 1)"


def _ranks(spark, d) -> DataFrame:
    return table(spark, d, "customer").groupBy((F.col("c_nationkey") + 1).alias("k")).agg(F.round(F.lit(0.2) + (F.min("c_acctbal") + 1000) / 11000, 2).alias("min_stability"), F.round(F.lit(0.2) + F.avg("c_acctbal") / 6000, 2).alias("avg_stability"))


@query(f"WITH {RANKS_SQL} SELECT * FROM stats WHERE min_stability + avg_stability >= 1 AND min_stability >= 0.2 AND avg_stability >= 0.8")
def rank_filter(spark, d):
    return M.rank_filter(_ranks(spark, d))


@query(f"WITH {RANKS_SQL} SELECT *, row_number() OVER (ORDER BY avg_stability DESC, k)::INTEGER AS place FROM stats")
def selection_sort(spark, d):
    from pyspark.sql import Window

    return _ranks(spark, d).withColumn("place", F.row_number().over(Window.orderBy(F.desc("avg_stability"), "k")))


@query("""WITH v AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS grp, floor(o_totalprice / 1000) AS x FROM orders WHERE o_orderstatus IN ('F', 'O')), r
 AS (SELECT grp, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0e0 AS r FROM v),
s AS (SELECT sum(r) FILTER (WHERE grp = 'a') AS s, count(*) FILTER (WHERE grp = 'a')::DOUBLE AS n, count(*) FILTER (WHERE grp = 'b')::DOUBLE AS m FROM r) SELECT
 s AS rank_sum, round((s - n * (n + m + 1) / 2) / sqrt(n * m * (n + m + 1) / 12), 6) AS z FROM s""")
def ranksum(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus in ('F', 'O')")
    return six(M.rank_sum(orders.select(F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("grp"), F.floor(F.col("o_totalprice") / 1000).alias("x"))), "z")


@query(f"WITH {CATALOG_SQL}, t AS (SELECT sample, sum(cnt)::BIGINT AS total FROM catalog GROUP BY 1) SELECT *, (CASE WHEN total <= 500 THEN 0 WHEN total <= 2300 THEN 1 WHEN total <= 2500 THEN 2 ELSE 3 END)::INTEGER AS bucket FROM t")
def split_samples(spark, d):
    return M.split_samples(catalog(spark, d), [500, 2300, 2500])


@query(f"WITH {CATALOG_SQL}, {WH_SQL}, t AS (SELECT signature, sum(activity)::BIGINT AS total FROM h GROUP BY 1) SELECT *, row_number() OVER (ORDER BY total DESC, signature)::INTEGER AS position FROM t")
def signature_order(spark, d):
    return M.order_signatures(factors(catalog(spark, d))[1])


@query("SELECT label, count(*) AS count FROM embeddings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def majority_label(spark, d):
    return M.majority(table(spark, d, "embeddings").select("label"))


@query("SELECT p_partkey AS i, CASE WHEN p_partkey < 26 THEN chr((p_partkey + 65)::INTEGER) WHEN p_partkey < 702 THEN chr(((p_partkey - 26) // 26 + 65)::INTEGER) || chr(((p_partkey - 26) % 26 + 65)::INTEGER) END AS letters FROM part")
def letter_ids(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), S.letters(F.col("p_partkey")).alias("letters"))


@query("SELECT n_nationkey, 'Total Mutations: ' || format('{:,}', n_nationkey * 1234) || '/' || printf('%.1f', 100.0 * n_nationkey / 300) || '%' AS label FROM nation")
def plot_text(spark, d):
    return table(spark, d, "nation").select("n_nationkey", S.plot_text("Total Mutations", F.col("n_nationkey") * 1234, F.lit(300 * 1234)).alias("label"))


@query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query(f"""WITH {CATALOG_SQL} SELECT sample, sum(cnt)::BIGINT AS total, count(*) FILTER (WHERE cnt = 0) AS outside, 0::BIGINT AS far, count(*) < 2 AS same FROM catalog GROUP BY 1""")
def bootstrap_totals(spark, d):
    """A resample of every sample: its total stays, no new channel comes in, no cell is over six deviations off, and it differs."""
    import zlib

    import numpy as np
    import pandas as pd

    def run(key, pdf):
        v = pdf.sort_values("channel")["cnt"].to_numpy().astype(float)
        out = X.bootstrap(v[:, None], X._generator(7, zlib.crc32(key[0].encode())))[:, 0]
        sd = np.sqrt(v * (1 - v / v.sum()))
        return pd.DataFrame({"sample": key[0], "total": [int(out.sum())], "outside": [int((out[v == 0] > 0).sum())], "far": [int((np.abs(out - v) > 6 * sd + 1).sum())], "same": [bool((out == v).all())]})

    return catalog(spark, d).groupBy("sample").applyInPandas(run, "sample string, total long, outside long, far long, same boolean")


def _step_sql(rounds: int) -> str:
    parts, w, h = [], "w", "h"
    for r in range(rounds):
        parts.append(f"e{r} AS (SELECT channel, sample, sum(weight * activity) AS est FROM {w} JOIN {h} USING (signature) GROUP BY 1, 2)")
        parts.append(f"w{r} AS (SELECT w.channel, w.signature, any_value(weight) * sum(cnt / est * activity) / sum(activity) AS weight FROM {w} w JOIN {h} h USING (signature) JOIN e{r} e ON e.channel = w.channel AND e.sample = h.sample JOIN catalog c ON c.channel = e.channel AND c.sample = e.sample GROUP BY 1, 2)")
        w = f"w{r}"
        parts.append(f"f{r} AS (SELECT channel, sample, sum(weight * activity) AS est FROM {w} JOIN {h} USING (signature) GROUP BY 1, 2)")
        parts.append(f"h{r} AS (SELECT h.sample, h.signature, any_value(activity) * sum(cnt / est * weight) / sum(weight) AS activity FROM {w} w JOIN {h} h USING (signature) JOIN f{r} e ON e.channel = w.channel AND e.sample = h.sample JOIN catalog c ON c.channel = e.channel AND c.sample = e.sample GROUP BY 1, 2)")
        h = f"h{r}"
    return f"WITH {CATALOG_SQL}, {WH_SQL}, {', '.join(parts)} SELECT sample, signature, round(activity, 4) AS activity FROM {h}"


@query(_step_sql(2))
def nmf_kl_steps(spark, d):
    """Two rounds of the factorisation from the formula's factors, as joins and grouped sums."""
    cat = catalog(spark, d)
    w, h = factors(cat)
    for _ in range(2):
        w, h = M.nmf_round(cat, w, h, 1.0)
    return six(h, "activity", to=4)


def _beta_sql(beta: float) -> str:
    half = lambda new, old, est, name, other: f"{new} AS (SELECT {name}, x.signature, any_value(x.{old}) * sum(cnt * pow(est, {beta - 2}) * {other}) / sum(pow(est, {beta - 1}) * {other}) AS {old} FROM"
    h1 = half("h1", "activity", "est", "x.sample", "weight") + " w JOIN h x USING (signature) JOIN est e ON e.channel = w.channel AND e.sample = x.sample JOIN catalog c ON c.channel = e.channel AND c.sample = e.sample GROUP BY 1, 2)"
    e1 = "e1 AS (SELECT channel, sample, sum(weight * activity) AS est FROM w JOIN h1 USING (signature) GROUP BY 1, 2)"
    w1 = half("w1", "weight", "est", "x.channel", "activity") + " w x JOIN h1 USING (signature) JOIN e1 e ON e.channel = x.channel AND e.sample = h1.sample JOIN catalog c ON c.channel = e.channel AND c.sample = e.sample GROUP BY 1, 2)"
    return f"WITH {CATALOG_SQL}, {WH_SQL}, {h1}, {e1}, {w1} SELECT channel, signature, round(weight, 4) AS weight FROM w1"


def _one_step(spark, d, beta: float) -> DataFrame:
    cat = catalog(spark, d)
    return six(M.nmf_round(cat, *factors(cat), beta)[0], "weight", to=4)


@query(_beta_sql(2.0))
def nmf_euclid(spark, d):
    return _one_step(spark, d, 2.0)


@query(_beta_sql(0.0))
def nmf_itakura_saito(spark, d):
    return _one_step(spark, d, 0.0)


@query(f"WITH {CATALOG_SQL}, {WH_SQL} SELECT sample, signature, activity, round(activity / sum(activity) OVER (PARTITION BY sample), 6) AS share FROM h")
def activity_share(spark, d):
    return six(R.activity_share(factors(catalog(spark, d))[1]), "share")


@query(f"WITH {CATALOG_SQL}, {WH_SQL} SELECT signature, sample, round(activity / 2800.0::DOUBLE, 8) AS per_mb, round(log10(activity / 2800.0::DOUBLE), 6) AS log10_per_mb FROM h WHERE activity > 0")
def burden(spark, d):
    return six(six(R.burden(factors(catalog(spark, d))[1]), "log10_per_mb"), "per_mb", to=8)


@query(f"WITH {CATALOG_SQL}, {WH_SQL} SELECT signature, channel, weight, round(100 * weight / sum(weight) OVER (PARTITION BY signature), 6) AS percent FROM w")
def signature_profile(spark, d):
    return six(R.signature_profile(factors(catalog(spark, d))[0]), "percent")


@query(f"WITH {CATALOG_SQL}, {WH_SQL} SELECT round(sum(cnt * ln(cnt / est)) - sum(cnt) + sum(est), 3) AS loss FROM est LEFT JOIN catalog USING (channel, sample)")
def kl_loss(spark, d):
    cat = catalog(spark, d)
    return M.kl_loss(cat, M.multiply(*factors(cat))).select(F.round("loss", 3).alias("loss"))


@query("""WITH RECURSIVE c AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x,
 unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT a.label AS a, b.label AS b FROM c a, c b WHERE 1 - list_cosine_similarity(a.v, b.v) <= 0.98), r(id, other) AS (SELECT label, label FROM c UNION
 SELECT r.id, e.b FROM r JOIN e ON r.other = e.a) SELECT id, min(other) AS cluster FROM r GROUP BY 1""")
def dendrogram(spark, d):
    """Label centroids cut by single linkage."""
    cells = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).groupBy(F.col("label").alias("id"), "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    a, b = cells.select(F.col("id").alias("a"), "dim", F.col("x").alias("p")), cells.select(F.col("id").alias("b"), "dim", F.col("x").alias("q"))
    dist = a.join(b, "dim").where("a < b").groupBy("a", "b").agg((1 - F.sum(F.col("p") * F.col("q")) / F.sqrt(F.sum(F.col("p") * F.col("p"))) / F.sqrt(F.sum(F.col("q") * F.col("q")))).alias("distance"))
    return M.single_linkage(dist, cells.select("id").distinct(), 0.98)


@query("""WITH x AS (SELECT label, vec_id % 2 AS half, i, avg(x) AS m FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM
 embeddings) GROUP BY ALL),
c AS (SELECT label, half, list(m ORDER BY i) AS v FROM x GROUP BY 1, 2), p AS (SELECT a.label AS a, b.label AS b, list_cosine_similarity(a.v, b.v) AS s FROM c
 a, c b WHERE a.half = 0 AND b.half = 1),
t AS (SELECT *, s = max(s) OVER (PARTITION BY a) AND s = max(s) OVER (PARTITION BY b) AS best FROM p), n AS (SELECT count(*) FILTER (WHERE best AND s >=
 0.8)::BIGINT AS tp, count(DISTINCT a)::BIGINT AS na, count(DISTINCT b)::BIGINT AS nb FROM t)
SELECT tp, nb - tp AS fp, na - tp AS fn, round(tp / nb::DOUBLE, 2) AS precision, round(tp / na::DOUBLE, 2) AS recall, round(2 * tp / (na + nb)::DOUBLE, 2) AS f1
 FROM n""")
def evaluation(spark, d):
    """Label centroids of the vectors of even number, as the truth, against those of odd number.

    The SQL takes mutual best partners: these make the matching of least cost where every partner is mutual, as here.
    """
    cells = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 2).alias("half"), F.posexplode("embedding").alias("dim", "x"))
    half = lambda n: cells.where(F.col("half") == n).groupBy(F.col("label").cast("string").alias("signature"), F.col("dim").alias("channel")).agg(F.avg(F.col("x").cast("double")).alias("weight"))
    got = X.match_signatures(half(0), half(1), cutoff=0.8)
    return spark.createDataFrame([tuple(got.values())], "tp long, fp long, fn long, precision double, recall double, f1 double")


SETTINGS = X.Parameters(minimum_signatures=1, maximum_signatures=3, nmf_replicates=4, min_nmf_iterations=100, max_nmf_iterations=300, nmf_test_conv=100, clustering_restarts=4, seed=11)


@query()
def extraction(spark, d):
    """The whole extraction; stochastic, so its rows are checked by invariants in the tests."""
    e = X.extract(catalog(spark, d), SETTINGS)
    return e.selection.orderBy("k")


from . import factor_queries, genome_queries, more_queries  # noqa: E402, F401
