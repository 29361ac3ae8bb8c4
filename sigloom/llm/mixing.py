"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed in cells of source, language and topic. Rounds of raking scale
the cells to the target share of each source, of each language and of each topic
in turn. Documents are then drawn with the probability of their cell, decided by
a hash of the id. DataFrame operations only: the cells, not the documents, pass
through the rounds, as grouped sums that Spark pre-aggregates.

A cell cannot give more than its tokens. The bound is kept within the rounds, so
that what a full cell lacks comes from the others.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

DIMENSIONS = ("source", "lang", "topic")
#: A target share is proportional to the present one to this power; 1 would leave it.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ROUNDS, BUDGET, SEED = 8, 0.5, "mix"
#: Bounded rounds end when no marginal is further from its target than this share of the budget, or at MOST_ROUNDS.
TOLERANCE, MOST_ROUNDS = 1e-4, 60


def topic_of(text: Column) -> Column:
    """The first kind that a text shows: table, licensed, contact, shout, or prose; a null text is prose."""
    shows = lambda s: F.coalesce(F.contains(text, F.lit(s)), F.lit(False))
    return F.when(shows(" | "), "table").when(shows("icense"), "licensed").when(shows("@"), "contact").when(shows("!!"), "shout").otherwise("prose")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit(id_: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by the id."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**12))


def _filled(df: DataFrame, part: list[str], amount: str, room: str, total: str, order: list[str]) -> DataFrame:
    """``df`` with ``amount`` scaled in each part so that ``least(room, amount)`` sums to ``total``, or to all the room where that is less.

    In the order of room over amount, the rows before the last one whose factor fits are full.
    """
    ratio = F.try_divide(F.col(room), F.col(amount))
    by = Window.partitionBy(*part).orderBy(ratio.asc_nulls_last(), *order)
    full = F.coalesce(F.sum(room).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum(amount).over(by.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_ratio", ratio).withColumn("_f", F.try_divide(F.col(total) - full, free))
    whole = Window.partitionBy(*part)
    f = F.coalesce(F.max(F.when(F.col("_f") <= F.col("_ratio"), F.col("_f"))).over(whole), F.max("_ratio").over(whole), F.lit(0.0))
    scaled = F.least(F.col(amount) * f, F.col(room) * F.lit(1e12))
    return df.withColumn("_scaled", scaled).withColumn(amount, F.col("_scaled")).drop("_ratio", "_f", "_scaled")


def rake_bounded(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, rounds: int | None = None) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` and ``drawn``, the tokens to draw from each: at most its own, ``budget`` of all in sum.

    ``targets``: for a dimension, the shares of its values; values without one
    get none. A dimension without targets follows ``TEMPER``. Cells without
    tokens are left out. A value with fewer tokens than its target gives
    all of them, and the other values of its dimension share the rest in
    proportion to their targets. Marginals that miss the target asked for are
    logged. The factors go to the weights before the bound, so the rounds near
    the mixture closest to the present one that meets bounds and marginals.
    ``rounds``: exactly so many; without it, until no marginal moves.
    """
    cells = cells.where("tokens > 0")
    size = cells.agg(F.sum("tokens")).first()[0] or 0
    w = cells.withColumns({"room": F.col("tokens").cast("double"), "w": F.col("tokens").cast("double")})
    for d in DIMENSIONS:
        if targets and d in targets:
            pairs = [x for k, v in targets[d].items() for x in (F.lit(k), F.lit(float(v)))]
            w = w.withColumn(f"t_{d}", F.coalesce(F.create_map(*pairs)[F.col(d)], F.lit(0.0)))
        else:
            sums = materialise(cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(TEMPER[d])).alias("p")), "marginal")
            total = sums.agg(F.sum("p")).first()[0] or 1.0
            w = w.join(sums.select(d, (F.col("p") / F.lit(total)).alias(f"t_{d}")), d)
    nothing = w.where(" or ".join(f"t_{d} <= 0" for d in DIMENSIONS)).select(*DIMENSIONS, "tokens", F.lit(0.0).alias("drawn"))
    w = materialise(w.where(" and ".join(f"t_{d} > 0" for d in DIMENSIONS)), "cells")
    wanted = min(float(budget * size), float(w.agg(F.sum("room")).first()[0] or 0.0))
    for d in DIMENSIONS:
        m = w.groupBy(d).agg(F.sum("room").alias("room"), F.max(f"t_{d}").alias("share")).withColumns({"all": F.lit(0), "total": F.lit(wanted), "least": F.col("share")})
        m = _filled(m, ["all"], "share", "room", "total", [d])
        asked = F.col("least") * F.lit(float(budget * size)) / F.sum("least").over(Window.partitionBy("all"))
        w = w.join(m.select(d, F.least("share", "room").alias(f"s_{d}"), asked.alias(f"a_{d}")), d)
    w = materialise(w, "cells")
    for n in range(1, (rounds or MOST_ROUNDS) + 1):
        for d in DIMENSIONS:
            w = _filled(w, [d], "w", "room", f"s_{d}", list(DIMENSIONS))
        if n % 2 and n != rounds:
            continue
        w = materialise(w, "cells")  # keeps the plan short
        if rounds is None and (_marginals(w).agg(F.max(F.abs(F.col("drawn") - F.col("target")))).first()[0] or 0.0) <= TOLERANCE * wanted:
            break
    missed = _marginals(w).where(F.abs(F.col("drawn") - F.col("asked")) > F.lit(10 * TOLERANCE * wanted)).orderBy("dimension", "value").limit(100).collect()
    for r in missed:
        logging.getLogger(__name__).warning("mixing: %s %r gets %.0f tokens of %.0f asked for; it has %.0f", r.dimension, r.value, r.drawn, r.asked, r.room)
    return w.select(*DIMENSIONS, "tokens", F.least("w", "room").alias("drawn")).union(nothing)


def _marginals(w: DataFrame) -> DataFrame:
    """dimension, value, drawn, target (within reach), asked and room of each value."""
    one = lambda d: F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(f"s_{d}").alias("target"), F.col(f"a_{d}").alias("asked"))
    each = w.select("w", "room", F.explode(F.array(*map(one, DIMENSIONS))).alias("m")).select("w", "room", "m.*")
    return each.groupBy("dimension", "value").agg(F.sum(F.least("w", "room")).alias("drawn"), F.max("target").alias("target"), F.max("asked").alias("asked"), F.sum("room").alias("room"))


def _drawn(docs: DataFrame, targets, budget: float, id_col: str, text_col: str, seed: str, rounds: int | None, carry: list[str]) -> DataFrame:
    """(row, topic, tokens, probability, kept), ``row`` the struct of the carried columns, so that their names meet no others."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in carry))
    told = docs.select(row.alias("row"), key("source").alias("source"), key("lang").alias("lang"), topic_of(F.col(text_col)).alias("topic"), tokens_of(F.col(text_col)).alias("tokens"), unit(F.col(id_col), seed).alias("u"))
    narrow = text_col not in carry
    counted = materialise(told if narrow else told.drop("row"), "counted")
    cells = materialise(counted.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake_bounded(cells, targets, budget, rounds).select(*DIMENSIONS, (F.col("drawn") / F.col("tokens")).alias("probability"))
    out = (counted if narrow else told).join(materialise(raked, "shares"), list(DIMENSIONS), "left")
    p = F.when(F.col("tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(F.lit(0.0))
    return out.select("row", "topic", "tokens", p.alias("probability"), (F.col("u") < p).alias("kept"))


def probabilities(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rounds: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default: the id, source and lang) and topic, tokens, probability, kept: one row per document.

    A cell's probability is the tokens that ``rake_bounded`` draws from it over
    its tokens; ``budget`` is the tokens wanted as a share of all. Null and
    empty sources and languages are one value; documents without tokens have
    probability 0. Rows of equal id are drawn alike. A carried column named like
    a result is left out.
    """
    made = ["topic", "tokens", "probability", "kept"]
    carry = [c for c in carry or [id_col, "source", "lang"] if c not in made]
    return _drawn(docs, targets, budget, id_col, text_col, seed, rounds, carry).select(*(F.col(f"row.`{c}`") for c in carry), *made)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """The drawn rows of ``docs``, with its columns, which may have any names beside source and lang.

    Null sources and languages count as empty ones; null and empty texts have no
    tokens and are not drawn; rows of equal id are drawn alike; no rows give no rows.
    """
    drawn = _drawn(docs, targets, budget, id_col, text_col, seed, None, docs.columns)
    return drawn.where("kept").select(*(F.col(f"row.`{c}`") for c in docs.columns))


def _filled_sql(name: str, source: str, part: str, amount: str, total: str, order: str) -> str:
    """CTEs for ``_filled`` over the rows of ``source``; the result is called ``name``."""
    by = f"PARTITION BY {part} ORDER BY ratio ASC NULLS LAST, {order} ROWS BETWEEN"
    return f"""{name}_r AS MATERIALIZED (SELECT *, room / nullif({amount}, 0) AS ratio FROM {source}),
{name}_f AS MATERIALIZED (SELECT *, ({total} - coalesce(sum(room) OVER ({by} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum({amount}) OVER ({by} CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS f FROM {name}_r),
{name} AS MATERIALIZED (SELECT * EXCLUDE (ratio, f) REPLACE (least({amount} * coalesce(max(CASE WHEN f <= ratio THEN f END) OVER (PARTITION BY {part}), max(ratio) OVER (PARTITION BY {part}), 0), room * 1e12) AS {amount}) FROM {name}_f)"""


def oracle_sql(docs: str = "documents", rounds: int = ROUNDS) -> str:
    """DuckDB SQL for ``probabilities`` with its defaults and so many rounds, probabilities to six places."""
    parts = []
    for d in DIMENSIONS:
        parts.append(f"m_{d} AS (SELECT {d}, 0 AS everything, sum(tokens)::DOUBLE AS room, pow(sum(tokens)::DOUBLE, {TEMPER[d]}) AS share, {BUDGET}::DOUBLE * (SELECT sum(tokens) FROM cells) AS total FROM cells GROUP BY {d})")
        parts.append(_filled_sql(f"s_{d}", f"m_{d}", "everything", "share", "total", d))
    parts.append("raked AS (SELECT source, lang, topic, tokens, tokens::DOUBLE AS room, tokens::DOUBLE AS w, " + ", ".join(f"least(s_{d}.share, s_{d}.room) AS t_{d}" for d in DIMENSIONS) + " FROM cells " + " ".join(f"JOIN s_{d} USING ({d})" for d in DIMENSIONS) + ")")
    last = "raked"
    for r in range(rounds):
        for d in DIMENSIONS:
            parts.append(_filled_sql(f"w{r}{d}", last, d, "w", f"t_{d}", ", ".join(DIMENSIONS)))
            last = f"w{r}{d}"
    return f"""WITH counted AS (SELECT doc_id, source, lang,
 CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'icense') THEN 'licensed' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, '!!') THEN 'shout' ELSE 'prose' END AS topic,
 CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens,
 CAST(('0x' || substr(md5(doc_id || ':{SEED}'), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM {docs}),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM counted GROUP BY ALL HAVING sum(tokens) > 0),
{", ".join(parts)},
p AS (SELECT source, lang, topic, least(w, room) / tokens AS p FROM {last})
SELECT doc_id, source, lang, topic, tokens, round(CASE WHEN tokens > 0 THEN p ELSE 0 END, 6) AS probability, u < CASE WHEN tokens > 0 THEN p ELSE 0 END AS kept FROM counted LEFT JOIN p USING (source, lang, topic)"""
