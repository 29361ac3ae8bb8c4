"""Registered queries of reference sequences, strands, channel grammars and catalogues with absent cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matrix as M
from ..sources import catalog as C
from ..sources import channels as H
from ..sources import genome as G
from .more_queries import VARIANT_SQL, _variants
from .queries import SPARSE_SQL, WH_SQL, factors, query, sparse, table

_TURN = "ref IN ('A', 'G')"
_SNV_SQL = f"""t AS (SELECT *, {_TURN} AS turn FROM v WHERE ref <> alt),
c AS (SELECT *, CASE WHEN turn THEN translate(ref, 'ACGT', 'TGCA') || '>' || translate(alt, 'ACGT', 'TGCA') ELSE ref || '>' || alt END AS change,
 CASE WHEN turn THEN translate(after, 'ACGT', 'TGCA') ELSE before END AS l, CASE WHEN turn THEN translate(before, 'ACGT', 'TGCA') ELSE after END AS r FROM t)"""

#: Variants and what is transcribed beside them: each order is a range of a strand, of any length up to 50,000 bases.
STRAND_SQL = f"""{VARIANT_SQL}, g AS (SELECT DISTINCT o_custkey % 7 + 1 AS chrom, o_orderkey * 37 AS s, o_orderkey * 37 + (o_custkey % 50) * 1000 AS e, CASE o_orderstatus WHEN
 'F' THEN '+' WHEN 'O' THEN '-' END AS strand FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey % 4 = 0),
x AS (SELECT c.chrom, c.pos, bool_or(strand = '+') AS plus, bool_or(strand = '-') AS minus FROM (SELECT DISTINCT chrom, pos * 37 AS pos FROM v) c JOIN g ON
 g.chrom = c.chrom AND c.pos BETWEEN g.s AND g.e GROUP BY 1, 2),
{_SNV_SQL},
k AS (SELECT sample, CASE WHEN plus AND minus THEN 'B' WHEN plus THEN CASE WHEN turn THEN 'T' ELSE 'U' END WHEN minus THEN CASE WHEN turn THEN 'U' ELSE 'T' END
 ELSE 'N' END AS strand, l || '[' || change || ']' || r AS plain FROM c LEFT JOIN x ON x.chrom = c.chrom AND x.pos = c.pos * 37)"""


def _stranded(spark, d) -> DataFrame:
    variants = _variants(spark, d).withColumn("pos", F.col("pos") * 37)
    orders = table(spark, d, "orders").where("o_custkey % 4 = 0")
    start = F.col("o_orderkey") * 37
    ranges = orders.select((F.col("o_custkey") % 7 + 1).alias("chrom"), start.alias("start"), (start + (F.col("o_custkey") % 50) * 1000).alias("end"), F.when(F.col("o_orderstatus") == "F", "+").when(F.col("o_orderstatus") == "O", "-").alias("strand"))
    return C.substitutions(G.with_strand(variants, G.transcribed(ranges)), context="SBS384")


@query(f"WITH {STRAND_SQL} SELECT strand || ':' || plain AS channel, sample, count(*) AS cnt FROM k GROUP BY 1, 2")
def strand_channels(spark, d):
    """Line items as variants, by the strand of the orders' ranges that they lie in."""
    return _stranded(spark, d)


@query(f"""WITH {STRAND_SQL} SELECT 'SBS96' AS context, plain AS channel, sample, count(*)::BIGINT AS cnt FROM k GROUP BY ALL
UNION ALL SELECT 'SBS288', CASE strand WHEN 'B' THEN 'N' ELSE strand END || ':' || plain, sample, count(*)::BIGINT FROM k GROUP BY ALL""")
def collapsed_channels(spark, d):
    """The same variants by strand, rolled up to coarser contexts."""
    fine = _stranded(spark, d)
    both = [H.collapse(fine, "SBS384", to).select(F.lit(to).alias("context"), "channel", "sample", "cnt") for to in ("SBS96", "SBS288")]
    return both[0].unionByName(both[1])


_LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


@query(f"""WITH s AS (SELECT doc_id AS chrom, translate(text, '{_LETTERS[0]}', '{_LETTERS[1]}') AS bases FROM documents),
v AS (SELECT l_partkey % 300 AS chrom, 1 + (l_partkey * 7919 + l_suppkey * 104729) % 9000 AS pos, l_orderkey, l_linenumber, l_linenumber % 3 AS gone FROM lineitem),
j AS (SELECT *, substr(bases, pos, 1 + gone) AS ref FROM v JOIN s USING (chrom) WHERE pos <= length(bases))
SELECT l_orderkey, l_linenumber, right(substr(bases, 1, pos - CASE WHEN length(ref) > 1 THEN 0 ELSE 1 END), 12) AS before, substr(bases, pos + length(ref), 12)
 AS after FROM j""")
def flank_bases(spark, d):
    """The bases beside variants and deletions in sequences made of the documents' texts, in blocks that overlap."""
    sequences = table(spark, d, "documents").select(F.col("doc_id").alias("chrom"), F.translate("text", *_LETTERS).alias("bases"))
    held = G.blocks(G.pieces(sequences))
    pos = 1 + (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % 9000
    v = table(spark, d, "lineitem").select((F.col("l_partkey") % 300).alias("chrom"), pos.alias("pos"), "l_orderkey", "l_linenumber", F.repeat(F.lit("N"), (1 + F.col("l_linenumber") % 3).cast("int")).alias("ref"), F.lit("N").alias("alt"))
    # a reference allele does not reach beyond the end of its sequence
    ends = sequences.select("chrom", F.length("bases").alias("size"))
    v = v.join(ends, "chrom").withColumn("ref", F.expr("left(ref, cast(least(length(ref), greatest(size - pos + 1, 1)) as int))"))
    return G.with_flanks(v, held).select("l_orderkey", "l_linenumber", F.right("before", F.lit(12)).alias("before"), F.left("after", F.lit(12)).alias("after"))


def _names_sql(context: str) -> str:
    return "(VALUES " + ", ".join(f"('{n}')" for n in H.channel_names(context)) + ")"


@query(f"""WITH {VARIANT_SQL}, {_SNV_SQL}, n AS (SELECT l || '[' || change || ']' || r AS channel, sample, count(*) AS cnt FROM c GROUP BY 1, 2), s AS (SELECT DISTINCT
 sample FROM n),
p AS (SELECT a.sample, a.ref || b.ref AS r, a.alt || b.alt AS x FROM v a JOIN v b ON a.chrom = b.chrom AND a.sample = b.sample AND b.pos = a.pos + 1 WHERE a.ref
 <> a.alt AND b.ref <> b.alt),
names AS (SELECT channel, split_part(channel, '>', 1) AS r, split_part(channel, '>', 2) AS x FROM {_names_sql("DBS78")} t(channel)),
q AS (SELECT channel, sample, count(*) AS cnt FROM p JOIN names ON (p.r = names.r AND p.x = names.x) OR (NOT EXISTS (SELECT 1 FROM names o WHERE o.r = p.r AND
 o.x = p.x) AND reverse(translate(p.r, 'ACGT', 'TGCA')) = names.r AND reverse(translate(p.x, 'ACGT', 'TGCA')) = names.x) GROUP BY 1, 2),
ds AS (SELECT DISTINCT sample FROM q)
SELECT 'SBS96' AS context, channel, sample, coalesce(cnt, 0)::BIGINT AS cnt FROM {_names_sql("SBS96")} o(channel) CROSS JOIN s LEFT JOIN n USING (channel, sample)
UNION ALL SELECT 'DBS78', channel, sample, coalesce(cnt, 0)::BIGINT FROM {_names_sql("DBS78")} o(channel) CROSS JOIN ds LEFT JOIN q USING (channel, sample)""")
def aligned_channels(spark, d):
    """The variants' catalogues with every channel of their contexts."""
    found = C.variant_contexts(_variants(spark, d), "SBS96,DBS78")
    both = [df.select(F.lit(name).alias("context"), "channel", "sample", "cnt") for name, df in found.items()]
    return both[0].unionByName(both[1])


#: The catalogue with absent cells, without its samples of zeros, and the estimate of the formula's factors for it.
SPARSE_EST_SQL = f"{SPARSE_SQL}, catalog AS (SELECT * FROM sparse WHERE cnt > 0), {WH_SQL}"


def _sparse(spark, d) -> tuple[DataFrame, DataFrame]:
    cells = sparse(spark, d).where("cnt > 0")
    return cells, M.multiply(*factors(cells))


@query(f"""WITH {SPARSE_EST_SQL}, x AS (SELECT e.sample, coalesce(cnt, 0)::DOUBLE AS v, est AS q FROM est e LEFT JOIN catalog c ON c.channel = e.channel AND c.sample =
 e.sample),
y AS (SELECT *, v / sum(v) OVER (PARTITION BY sample) AS pv, q / sum(q) OVER (PARTITION BY sample) AS pq FROM x)
SELECT sample, sum(v)::BIGINT AS total_mutations, round(sum(v * q) / (sqrt(sum(v * v)) * sqrt(sum(q * q))), 3) AS cosine, round(sum(abs(v - q)), 3) AS l1,
 round(round(sum(abs(v - q)), 3) * 100 / sum(v), 3) AS l1_pct,
 round(sqrt(sum((v - q) * (v - q))), 3) AS l2, round(round(sqrt(sum((v - q) * (v - q))), 3) * 100 / sqrt(sum(v * v)), 3) AS l2_pct, round(sum(CASE WHEN v = 0
 THEN 0 ELSE pv * ln(pv / pq) END), 5) AS kl, round(corr(v, q), 3) + 0.0::DOUBLE AS correlation FROM y GROUP BY sample""")
def similarity_sparse(spark, d):
    """Errors of a catalogue in which most cells are absent: they count as zeros."""
    return M.similarity_table(*_sparse(spark, d))


@query(f"""WITH {SPARSE_EST_SQL} SELECT round(sqrt(sum((coalesce(cnt, 0) - est) ** 2)) / sqrt(sum(cnt * cnt)), 4) AS fro_err,
 round(sum(CASE WHEN cnt > 0 THEN cnt * ln(cnt / est) - cnt ELSE 0 END + est), 3) AS loss FROM est LEFT JOIN catalog USING (channel, sample)""")
def error_sparse(spark, d):
    cells, est = _sparse(spark, d)
    return M.frobenius_error(cells, est).join(M.kl_loss(cells, est).select(F.round("loss", 3).alias("loss")))
