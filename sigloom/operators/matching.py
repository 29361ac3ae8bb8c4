"""One-to-one matching of least cost over a table of pairs, by an auction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dropped, written


def assign(costs: DataFrame, tolerance: float = 1e-3, leave: float | None = None) -> DataFrame:
    """``costs(a, b, cost)`` -> (a, b, cost): each a and each b at most once.

    Every round, each a without a partner bids for the b that is worth most to it,
    by as much as it prefers it to its second choice and ``tolerance`` more; each b
    goes to its highest bidder, the smaller a of equals, and whoever had it is free
    again. The total is within ``tolerance`` times the number of matched a of the
    least one. An a whose best offer has come to cost more than ``leave`` stays
    alone; by default that is more than any way round through others could cost, so
    as many are matched as bids can reach. The side with fewer members bids. Pairs
    that are absent or of null cost are impossible; of repeated pairs the cheapest counts.

    A round is a join of the free bidders' pairs with the prices, their best two
    offers, and a maximum by b; prices and owners are a row a b.
    """
    sound = costs.where("a is not null and b is not null and cost is not null")
    pairs = written(sound.groupBy("a", "b").agg(F.min(F.col("cost").cast("double")).alias("cost")), "costs")
    told = pairs.agg(F.countDistinct("a").alias("n"), F.countDistinct("b").alias("m"), F.min("cost").alias("low"), F.max("cost").alias("high")).first()
    swapped = told.n > told.m
    own = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost") if swapped else pairs
    if not told.n:
        return pairs
    most = told.high + (min(told.n, told.m) + 1) * max(told.high - told.low, tolerance) if leave is None else leave
    prices = own.select("b").distinct().select("b", F.lit(0.0).alias("price"), F.lit(None).cast(dict(own.dtypes)["a"]).alias("owner"))
    prices = written(prices, "prices")
    bidders = written(own.select("a").distinct(), "bidders")
    while True:
        free = bidders.join(prices.where("owner is not null").select(F.col("owner").alias("a")), "a", "left_anti")
        offers = own.join(free, "a").join(prices.select("b", "price"), "b").withColumn("value", -F.col("cost") - F.col("price"))
        best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("value"), "b"))
        two = offers.withColumn("place", best).where("place <= 2").groupBy("a").agg(F.max("value").alias("first"), F.min("value").alias("second"), F.count("*").alias("n"), F.min_by(F.struct("b", "price"), "place").alias("at"))
        second = F.greatest(F.when(F.col("n") > 1, F.col("second")), F.lit(-most))  # to stay alone is an offer, too
        bids = two.where(F.col("first") >= -most).select("a", F.col("at.b").alias("b"), (F.col("at.price") + F.col("first") - second + tolerance).alias("bid"))
        won = bids.groupBy("b").agg(F.max("bid").alias("bid"), F.min_by("a", F.struct(-F.col("bid"), F.col("a"))).alias("by"))
        new = prices.join(won, "b", "left").select("b", F.coalesce("bid", "price").alias("price"), F.coalesce("by", "owner").alias("owner"), F.col("by").isNotNull().alias("changed"))
        new = written(new, "prices")
        over = new.where("changed").isEmpty()
        dropped(prices)
        prices = new.drop("changed")
        if over:
            break
    matched = prices.where("owner is not null").select(F.col("owner").alias("a"), "b")
    matched = written(matched.join(own, ["a", "b"]).select("a", "b", "cost"), "matched")
    dropped(prices, bidders)
    return matched.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost") if swapped else matched
