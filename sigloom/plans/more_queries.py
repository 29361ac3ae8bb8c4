"""Further registered queries: input kinds, name and list functions, selection and reports, each with its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import matrix as M
from ..sources import catalog as C
from ..sources import channels as H
from ..sources.shared import shared_base
from . import extract as X
from . import report as R
from .queries import CATALOG_SQL, NATIONS, RANKS_SQL, SIMILARITY_SQL, SQL, WH_SQL, _ranks, _similarity, catalog, factors, query, six, sparse, table

DIGITS = ("0123456789", "ACGTACGTAC")

VARIANT_SQL = """v AS (SELECT l_linenumber AS chrom, l_orderkey AS pos, l_returnflag AS sample, substr('ACGT', 1 + l_partkey % 4, 1) AS ref, substr('ACGT', 1 + l_suppkey % 4, 1)
 AS alt,
 substr('ACGT', 1 + l_orderkey % 4, 1) AS before, substr('ACGT', 1 + (l_orderkey // 4) % 4, 1) AS after FROM lineitem)"""


def _variants(spark, d) -> DataFrame:
    """A variant of each line item: its bases come from its keys."""
    base = lambda n: F.substring(F.lit("ACGT"), (1 + n).cast("int"), F.lit(1))
    at = F.col("l_orderkey")
    return table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("chrom"), at.alias("pos"), F.col("l_returnflag").alias("sample"), base(F.col("l_partkey") % 4).alias("ref"), base(F.col("l_suppkey") % 4).alias("alt"),
        base(at % 4).alias("before"), base(F.floor(at / 4) % 4).alias("after"))


@query(f"""WITH {VARIANT_SQL}, t AS (SELECT *, ref IN ('A', 'G') AS turn FROM v WHERE ref <> alt), c AS (SELECT sample, CASE WHEN turn THEN translate(ref, 'ACGT', 'TGCA')
 || '>' || translate(alt, 'ACGT', 'TGCA') ELSE ref || '>' || alt END AS change,
 CASE WHEN turn THEN translate(after, 'ACGT', 'TGCA') ELSE before END AS l, CASE WHEN turn THEN translate(before, 'ACGT', 'TGCA') ELSE after END AS r FROM t)
SELECT l || '[' || change || ']' || r AS channel, sample, count(*) AS cnt FROM c GROUP BY 1, 2""")
def snv_channels(spark, d):
    v = _variants(spark, d)
    return C.substitutions(v.drop("before", "after"), v.select("chrom", "pos", "before", "after").distinct())


@query(f"""WITH {VARIANT_SQL}, p AS (SELECT a.sample, a.ref || b.ref AS r, a.alt || b.alt AS x FROM v a JOIN v b ON a.chrom = b.chrom AND a.sample = b.sample AND b.pos =
 a.pos + 1 WHERE a.ref <> a.alt AND b.ref <> b.alt),
names AS (SELECT unnest({H.channel_names("DBS78")}) AS name), o AS (SELECT sample, r || '>' || x AS here, reverse(translate(r, 'ACGT', 'TGCA')) || '>' ||
 reverse(translate(x, 'ACGT', 'TGCA')) AS there FROM p)
SELECT name AS channel, sample, count(*) AS cnt FROM o JOIN names ON name = here OR (name = there AND here NOT IN (SELECT name FROM names)) GROUP BY 1, 2""")
def doublet_channels(spark, d):
    return C.doublets(_variants(spark, d))


@query(f"""WITH o AS (SELECT o_orderkey AS pos, o_orderstatus AS sample, o_orderkey % 2 = 1 AS del, 1 + o_orderkey % 6 AS size, translate(o_custkey::VARCHAR ||
 o_orderkey::VARCHAR || '012345', '{DIGITS[0]}', '{DIGITS[1]}') AS seq, o_custkey % 8 AS copies FROM orders),
v AS (SELECT *, substr(seq, 1, size) AS piece, repeat(substr(seq, 1, size), copies::INT) || reverse(seq) AS after, 'GATTACA' || reverse(substr(seq, 1, 3)) AS
 before FROM o),
n AS (SELECT *, list_max(list_filter(range(0, 6), lambda i: starts_with(after, repeat(piece, i::INT)))) AS n, list_max(list_filter(range(0, size), lambda i:
 left(after, i) = left(piece, i) OR right(before, i) = right(piece, i))) AS m FROM v)
SELECT least(size, 5)::VARCHAR || ':' || CASE WHEN del THEN 'Del' ELSE 'Ins' END || ':' || CASE WHEN size = 1 THEN CASE piece WHEN 'A' THEN 'T' WHEN 'G' THEN
 'C' ELSE piece END || ':' || n WHEN del AND n = 0 AND m > 0 THEN 'M:' || least(m, 5) ELSE 'R:' || n END AS channel, sample, count(*) AS cnt FROM n GROUP BY 1,
 2""")
def indel_channels(spark, d):
    """An indel of each order: piece, repeats and neighbours come from its keys."""
    seq = F.translate(F.concat(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.lit("012345")), *DIGITS)
    o = table(spark, d, "orders").select(F.lit("1").alias("chrom"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("sample"), (F.col("o_orderkey") % 2 == 1).alias("del"), seq.alias("seq"), (1 + F.col("o_orderkey") % 6).cast("int").alias("size"), (F.col("o_custkey") % 8).cast("int").alias("copies"))
    o = o.withColumn("piece", F.substring("seq", F.lit(1), F.col("size")))
    anchor = F.right(F.reverse(F.substring("seq", 1, 3)), F.lit(1))
    v = o.select("chrom", "pos", "sample", F.when(F.col("del"), F.concat(anchor, "piece")).otherwise(anchor).alias("ref"), F.when(F.col("del"), anchor).otherwise(F.concat(anchor, "piece")).alias("alt"))
    flanks = o.select("chrom", "pos", F.concat(F.lit("GATTACA"), F.reverse(F.substring("seq", 1, 3))).alias("before"), F.concat(F.repeat("piece", F.col("copies")), F.reverse("seq")).alias("after"))
    return C.indels(v, flanks)


@query("""WITH b AS (SELECT l_returnflag || l_linestatus AS sample, l_linenumber AS chrom1, (l_partkey * 100003) % 400000000 AS start1, l_linenumber + (l_suppkey % 4 =
 3)::INT AS chrom2, (l_partkey * 100003) % 400000000 + (10 ** (3 + l_orderkey % 6))::BIGINT AS start2, l_suppkey % 4 AS c FROM lineitem),
e AS (SELECT sample, chrom1 AS c, start1 // 1000000 AS bin FROM b UNION ALL SELECT sample, chrom2, start2 // 1000000 FROM b), n AS (SELECT sample, c, bin,
 count(*) AS n FROM e GROUP BY ALL),
w AS (SELECT sample, c, bin + o AS bin, sum(n) AS n FROM n, (VALUES (-1), (0), (1)) t(o) GROUP BY ALL),
t AS (SELECT b.sample, CASE WHEN coalesce(n, 0) >= 10 THEN 'clustered_' ELSE 'non-clustered_' END || (['del', 'tds', 'inv', 'trans'])[b.c + 1] AS k, b.c,
 abs(start2 - start1) AS s FROM b LEFT JOIN w ON w.sample = b.sample AND w.c = b.chrom1 AND w.bin = b.start1 // 1000000)
SELECT CASE WHEN c = 3 THEN k ELSE k || '_' || CASE WHEN s <= 10000 THEN '1-10Kb' WHEN s <= 100000 THEN '10-100Kb' WHEN s <= 1000000 THEN '100Kb-1Mb' WHEN s <=
 10000000 THEN '1Mb-10Mb' ELSE '>10Mb' END END AS channel, sample, count(*) AS cnt FROM t GROUP BY 1, 2""")
def structural_channels(spark, d):
    """A breakpoint pair of each line item."""
    start, kind = (F.col("l_partkey") * 100003) % 400_000_000, F.col("l_suppkey") % 4
    names = F.array(*map(F.lit, ("deletion", "tandem-duplication", "inversion", "translocation")))
    return C.structural(table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("sample"), F.col("l_linenumber").alias("chrom1"), start.alias("start1"), (F.col("l_linenumber") + (kind == 3).cast("int")).alias("chrom2"),
        (start + F.pow(F.lit(10.0), 3 + F.col("l_orderkey") % 6).cast("long")).alias("start2"), F.get(names, kind.cast("int")).alias("svclass")))


@query(f"""WITH s AS (SELECT l_returnflag AS sample, l_extendedprice::DOUBLE * 1000 / 1e6 AS mb, (l_quantity::BIGINT % 12 + l_linenumber % 3) AS t, l_linenumber % 3 AS m
 FROM lineitem), c AS (SELECT unnest({[*C.CALLERS]}) AS caller)
SELECT caller, CASE WHEN t = 0 THEN '0:homdel:' ELSE CASE WHEN t <= 2 THEN t::VARCHAR WHEN t <= 4 THEN '3-4' WHEN t <= 8 THEN '5-8' ELSE '9+' END || CASE WHEN m
 = 0 OR t = 1 THEN ':LOH:' ELSE ':het:' END END ||
 CASE WHEN mb <= 0.1 THEN '0-100kb' WHEN mb <= 1 THEN '100kb-1Mb' WHEN t = 0 THEN '>1Mb' WHEN mb <= 10 THEN '1Mb-10Mb' WHEN mb <= 40 THEN '10Mb-40Mb' ELSE
 '>40Mb' END AS channel, sample, count(*) AS cnt FROM s, c GROUP BY 1, 2, 3""")
def segment_channels(spark, d):
    """A segment of each line item, in the columns of every caller."""
    major, minor = F.col("l_quantity").cast("long") % 12, F.col("l_linenumber") % 3
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("who"), F.lit(0.0).alias("from"), (F.col("l_extendedprice") * 1000).alias("to"), major.alias("a"), minor.alias("b"))
    out = []
    for caller, (sample, _, start, end, total, minor_col) in C.CALLERS.items():
        parts = total.split("+")
        names = {sample: F.col("who"), start: F.col("from"), end: F.col("to")}
        names |= {parts[0]: F.col("a") + F.col("b"), minor_col: F.col("b")} if len(parts) == 1 else {(set(parts) - {minor_col}).pop(): F.col("a"), minor_col: F.col("b")}
        out.append(C.segments(rows.select(*(c.alias(n) for n, c in names.items())), caller).select(F.lit(caller).alias("caller"), "channel", "sample", "cnt"))
    return reduce(DataFrame.unionByName, out)


@query("""WITH s AS (SELECT * FROM (VALUES (0, '0-100kb', '(-0.01,0.1]'), (1, '100kb-1Mb', '(0.1,1]'), (2, '1Mb-10Mb', '(1,10]'), (3, '10Mb-40Mb', '(10,40]'), (4,
 '>40Mb', '(40,Inf]')) t(i, size, mb)),
c AS (SELECT * FROM (VALUES ('LOH', '1', 'del'), ('LOH', '2', 'neut'), ('LOH', '3-4', 'dup'), ('LOH', '5-8', 'quad'), ('LOH', '9+', 'amp'), ('het', '2',
 'neut'), ('het', '3-4', 'dup'), ('het', '5-8', 'quad'), ('het', '9+', 'amp')) t(state, n, kind))
SELECT kind || ':' || state || ':' || mb AS class, n || ':' || state || ':' || size AS channel FROM c, s UNION ALL SELECT 'del:homdel:' || CASE i WHEN 2 THEN
 '(1,Inf]' ELSE mb END, '0:homdel:' || CASE i WHEN 2 THEN '>1Mb' ELSE size END FROM s WHERE i < 3""")
def cnv_labels(spark, d):
    return C.cnv_classes(spark)


@query(f"WITH {CATALOG_SQL}, n AS (SELECT 'NATION_' || i AS sample FROM range(25) t(i)) SELECT channel, sample, coalesce(cnt, 0)::DOUBLE AS cnt FROM (SELECT DISTINCT channel FROM catalog) CROSS JOIN n LEFT JOIN catalog USING (channel, sample)")
def matrix_file(spark, d):
    """The catalogue as a tab-separated matrix, written and read back."""
    path = f"{shared_base(spark)}/matrix-{uuid.uuid4().hex}"
    R.write_wide(catalog(spark, d), path, "channel", "sample", "cnt", NATIONS)
    return C.read_input(spark, "text", path)


@query(f"WITH {CATALOG_SQL} SELECT channel, sample, cnt::DOUBLE AS cnt FROM catalog")
def norm_none(spark, d):
    return M.normalise(catalog(spark, d), "none")


@query("SELECT p_partkey, rtrim(p_name || repeat('*', p_size % 3) || repeat('%', p_size % 2), '*%') AS name FROM part")
def strip_marks(spark, d):
    marked = F.concat("p_name", F.repeat(F.lit("*"), (F.col("p_size") % 3).cast("int")), F.repeat(F.lit("%"), (F.col("p_size") % 2).cast("int")))
    return table(spark, d, "part").select("p_partkey", S.strip_marks(marked).alias("name"))


@query(f"SELECT p_partkey, reverse(translate(translate(p_partkey::VARCHAR, '{DIGITS[0]}', '{DIGITS[1]}'), 'ACGT', 'TGCA')) AS bases FROM part")
def reverse_complement(spark, d):
    return table(spark, d, "part").select("p_partkey", C.fold(F.translate(F.col("p_partkey").cast("string"), *DIGITS)).alias("bases"))


@query("""WITH n AS (SELECT c_nationkey AS k, c_custkey::VARCHAR AS c, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey::VARCHAR) - 1 AS i FROM customer)
SELECT k, i // 4 AS chunk, string_agg(c, ',' ORDER BY i) AS items FROM n GROUP BY 1, 2""")
def list_chunks(spark, d):
    """Each nation's customers, a bounded list here, in chunks of four."""
    lists = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_list(F.col("c_custkey").cast("string"))).alias("c"))
    return lists.select("k", F.posexplode(S.chunks_of(F.col("c"), 4)).alias("chunk", "items")).select("k", F.col("chunk").cast("long").alias("chunk"), F.array_join("items", ",").alias("items"))


@query("SELECT p_partkey, (['red', 'blue', p_brand, p_type])[1 + p_size % 4] AS item, p_size % 4 AS place FROM part")
def list_positions(spark, d):
    items = F.array(F.lit("red"), F.lit("blue"), F.col("p_brand"), F.col("p_type"))
    at = (F.col("p_size") % 4).cast("int")
    return table(spark, d, "part").select("p_partkey", F.get(items, at).alias("item"), S.positions_of(items, F.array(F.get(items, at)))[0].cast("int").alias("place"))


@query(f"WITH {CATALOG_SQL}, {WH_SQL}, {SIMILARITY_SQL} SELECT round(avg(l1), 6) AS l1, round(avg(l1_pct), 6) AS l1_pct, round(avg(l2), 6) AS l2, round(avg(l2_pct), 6) AS l2_pct, round(avg(kl), 6) AS kl, round(avg(correlation), 6) AS correlation FROM similarity")
def metric_means(spark, d):
    names = ["l1", "l1_pct", "l2", "l2_pct", "kl", "correlation"]
    return six(_similarity(spark, d).agg(*(F.avg(n).alias(n) for n in names)), *names)


@query(f"WITH {CATALOG_SQL}, {WH_SQL}, {SIMILARITY_SQL}, named AS (SELECT length(sample) AS k, * FROM similarity) SELECT k, round(median(l1_pct), 2) AS mean_l1_pct, round(max(l1_pct), 2) AS max_l1_pct, round(median(l2_pct), 2) AS mean_l2_pct, round(max(l2_pct), 2) AS max_l2_pct, round(avg(kl), 4) AS mean_kl, round(max(kl), 4) AS max_kl, round(avg(1 - cosine), 3) AS mean_cosine_distance, round(max(1 - cosine), 3) AS max_cosine_distance, round(avg(correlation), 3) AS mean_correlation, round(min(correlation), 3) AS min_correlation FROM named GROUP BY k")
def selection_metrics(spark, d):
    """The length of a sample's name stands for the rank."""
    return M.selection_metrics(_similarity(spark, d).withColumn("k", F.length("sample").cast("long")))


@query("SELECT 'd' || day AS channel, n FROM (SELECT dayofyear(l_shipdate) AS day, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)")
def channel_sort(spark, d):
    """The channels that occur, in the canonical order of days (366 rows at most)."""
    order = spark.range(1, 367).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("channel"), F.col("id").cast("int").alias("channel_idx"))
    return C.sort_channels(sparse(spark, d).groupBy("channel").agg(F.count("*").alias("n")), order)


@query("SELECT c_nationkey AS k, min(c_custkey) AS restart, max(c_acctbal) AS silhouette FROM (SELECT *, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS m FROM customer) WHERE c_acctbal = m GROUP BY 1")
def best_restart(spark, d):
    return M.best_restarts(table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("restart"), F.col("c_acctbal").alias("silhouette")))


@query(f"WITH {RANKS_SQL} SELECT max(k) AS k FROM stats WHERE min_stability + avg_stability >= 1 AND min_stability >= 0.2 AND avg_stability >= 0.8")
def last_rank(spark, d):
    return M.rank_filter(_ranks(spark, d)).agg(F.max("k").alias("k"))


@query("SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def row_concat(spark, d):
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name")))


@query(f"WITH {CATALOG_SQL}, {WH_SQL} SELECT signature, " + ", ".join(f"coalesce(sum(activity) FILTER (WHERE sample = '{n}'), 0) AS \"{n}\"" for n in NATIONS) + " FROM h GROUP BY 1")
def transpose(spark, d):
    """Activities with a column a sample, from rows by sample."""
    h = factors(catalog(spark, d))[1].select(F.col("signature").alias("channel"), "sample", F.col("activity").alias("cnt"))
    return C.to_wide(h, NATIONS).withColumnRenamed("channel", "signature")


@query("SELECT cluster, round(avg(s), 4) AS stability FROM (SELECT cluster, silhouette AS s FROM (" + SQL["silhouette"] + ")) GROUP BY 1")
def cluster_stability(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("vector"))
    return six(M.silhouettes(points).groupBy("cluster").agg(F.avg("silhouette").alias("stability")), "stability", to=4)


@query(f"WITH {CATALOG_SQL}, {WH_SQL}, {SIMILARITY_SQL}, {RANKS_SQL}, f AS (SELECT length(sample) AS k, round(avg(1 - cosine), 6) AS mean_cosine_distance FROM similarity GROUP BY 1) SELECT k::INTEGER AS k, avg_stability, mean_cosine_distance FROM stats JOIN f USING (k)")
def selection_curve(spark, d):
    return six(R.selection_curve(_ranks(spark, d), _similarity(spark, d).withColumn("k", F.length("sample"))), "mean_cosine_distance")


@query(f"WITH {CATALOG_SQL}, {WH_SQL} SELECT 2 AS k, signature, CASE signature WHEN 'A' THEN 0.9 ELSE 0.8 END::DOUBLE AS stability, sum(activity)::BIGINT AS total FROM h GROUP BY signature")
def signature_stats(spark, d):
    h = factors(catalog(spark, d))[1].withColumn("k", F.lit(2))
    stability = spark.createDataFrame([(2, "A", 0.9), (2, "B", 0.8)], "k int, signature string, stability double")
    return R.signature_stats(stability, h)


@query("SELECT p_partkey, printf('%.2E', sqrt(p_retailprice::DOUBLE)) AS price FROM part")
def sem_text(spark, d):
    return R.scientific(table(spark, d, "part").select("p_partkey", F.sqrt("p_retailprice").alias("price")), "price")


@query(f"""WITH {CATALOG_SQL}, {WH_SQL}, v AS (SELECT sample, sum(cnt) AS total, sum(cnt * wa) AS p, sum(cnt * wb) AS q FROM catalog JOIN (SELECT channel, max(weight)
 FILTER (WHERE signature = 'A') AS wa, max(weight) FILTER (WHERE signature = 'B') AS wb FROM w GROUP BY 1) USING (channel) GROUP BY 1),
g AS (SELECT sum(wa * wa) AS a, sum(wb * wb) AS b, sum(wa * wb) AS c FROM (SELECT channel, max(weight) FILTER (WHERE signature = 'A') AS wa, max(weight) FILTER
 (WHERE signature = 'B') AS wb FROM w GROUP BY 1)),
f AS (SELECT sample, total, (p * b - q * c) / (a * b - c * c) AS x, (q * a - p * c) / (a * b - c * c) AS y, p / a AS xo, q / b AS yo FROM v, g), s AS (SELECT
 sample, total, CASE WHEN x < 0 THEN 0 WHEN y < 0 THEN xo ELSE x END AS x, CASE WHEN y < 0 THEN 0 WHEN x < 0 THEN yo ELSE y END AS y FROM f)
SELECT 2 AS k, sample, 0 AS cluster, round(x * total / (x + y), 3) AS activity FROM s UNION ALL SELECT 2, sample, 1, round(y * total / (x + y), 3) FROM s""")
def refit(spark, d):
    """Every sample's non-negative fit to two given signatures, scaled to its total; the SQL solves the two unknowns by hand."""
    cat = catalog(spark, d)
    w = factors(cat)[0].select(F.lit(2).alias("k"), F.when(F.col("signature") == "A", 0).otherwise(1).alias("cluster"), "channel", "weight")
    return six(X.activities(w, cat), "activity", to=3)


@query(f"""WITH {RANKS_SQL}, e AS (SELECT c_nationkey + 1 AS k, c_acctbal AS x FROM customer), good AS (SELECT * FROM stats WHERE min_stability + avg_stability >= 1 AND
 min_stability >= 0.2 AND avg_stability >= 0.8),
hi AS (SELECT coalesce((SELECT max(k) FROM good), (SELECT min(k) FROM stats)) AS k), cand AS (SELECT k FROM good WHERE avg_stability >= (SELECT avg_stability
 FROM stats WHERE k = (SELECT k FROM hi)) UNION SELECT k FROM hi),
p AS (SELECT k, false AS a, x FROM e WHERE k IN (SELECT k FROM cand) UNION ALL SELECT cand.k, true, x FROM cand, e WHERE e.k = (SELECT k FROM hi)),
r AS (SELECT k, a, x, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0e0 AS r FROM p),
s AS (SELECT k, sum(r) FILTER (WHERE a) AS s, count(*) FILTER (WHERE a)::DOUBLE AS n, count(*) FILTER (WHERE NOT a)::DOUBLE AS m, median(x) FILTER (WHERE NOT a)
 AS med FROM r GROUP BY 1),
z AS (SELECT k, (s - n * (n + m + 1) / 2) / sqrt(n * m * (n + m + 1) / 12) AS z, med FROM s), base AS (SELECT med FROM z WHERE k = (SELECT k FROM hi)),
stop AS (SELECT max(k) AS k FROM z WHERE k < (SELECT k FROM hi) AND ((abs(z) > 1.959963984540054 AND med > (SELECT med FROM base)) OR k = (SELECT min(k) FROM stats))),
pick AS (SELECT min(k) AS k FROM cand WHERE k > coalesce((SELECT k FROM stop), 0))
SELECT k::INTEGER AS k, k = (SELECT k FROM pick) AS chosen, k IN (SELECT k FROM cand) AND k >= coalesce((SELECT k FROM stop), 0) AS considered FROM stats""")
def selection_walk(spark, d):
    """The choice of a rank over a fixed table of stabilities, with customers' balances as the samples' errors."""
    errors = table(spark, d, "customer").select((F.col("c_nationkey") + 1).alias("k"), F.col("c_acctbal").alias("x"))
    return X.choose(_ranks(spark, d), errors, X.Parameters())[1].select("k", "chosen", "considered")
