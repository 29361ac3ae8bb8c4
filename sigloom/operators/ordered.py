"""Order statistics, rank tests and single linkage of many groups at once, without a task or buffer that holds a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dropped, written

#: Cells that an interval of values is cut into in each round of refinement.
CELLS = 256


def order_statistics(values: DataFrame, by: tuple[str, ...], ranks: dict[str, Column]) -> DataFrame:
    """(``by``, names of ``ranks``): exact values of ``x`` at places from 0 in each group's order; nulls do not count.

    ``ranks``: a place for each name, from the group's count ``n``. A round counts the values
    of each group and place in cells of the interval that still holds the place, and goes on
    in the least and greatest value of the cell that has it, until these are the same. At
    most ``CELLS`` rows a group and place meet in a window; the values themselves are only
    filtered and counted.
    """
    keys = list(by)
    x = values.where("x is not null and not isnan(x)").select(*keys, F.col("x").cast("double").alias("x"))
    x = written(x.groupBy(*keys, "x").agg(F.count("*").alias("c")), "values")
    spread = x.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in ranks.items()))).alias("w")
    open_ = written(spread.select(*keys, "lo", "hi", wanted).select(*keys, "lo", "hi", "w.*"), "open")
    done = []
    while True:
        done.append(open_.where("lo = hi").select(*keys, "name", F.col("lo").alias("x")))
        todo = open_.where("lo < hi")
        if todo.isEmpty():
            break
        same = reduce(lambda a, b: a & b, (F.col(f"v.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys), F.lit(True))
        inside = x.alias("v").join(todo.alias("o"), same & (F.col("v.x") >= F.col("o.lo")) & (F.col("v.x") <= F.col("o.hi")))
        cell = F.least(F.lit(CELLS - 1), F.floor((F.col("v.x") - F.col("o.lo")) / (F.col("o.hi") - F.col("o.lo")) * CELLS)).cast("int")
        counted = inside.groupBy(*(F.col(f"v.{k}").alias(k) for k in keys), F.col("o.name").alias("name"), F.col("o.place").alias("place"), cell.alias("cell"))
        counted = counted.agg(F.sum("v.c").alias("c"), F.min("v.x").alias("lo"), F.max("v.x").alias("hi"))
        before = F.sum("c").over(Window.partitionBy(*keys, "name", "place").orderBy("cell")) - F.col("c")
        found = counted.withColumn("before", before).where("place >= before and place < before + c")
        new = written(found.select(*keys, "lo", "hi", "name", (F.col("place") - F.col("before")).alias("place")), "open")
        open_ = new
    every = written(reduce(DataFrame.unionByName, done), "statistics")
    dropped(x)
    return every.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in ranks))


def medians(values: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(``by``, median): the exact median of ``x`` in each group, the mean of the middle two."""
    n = F.col("n")
    found = order_statistics(values, by, {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2)})
    return found.select(*by, ((F.col("low") + F.col("high")) / 2).alias("median"))


def running_sums(rows: DataFrame, by: str, order: str, names: list[str]) -> DataFrame:
    """``rows`` with, for each of ``names``, its sum over the rows of the group that stand before.

    One exchange by range; a window holds a partition's rows, and another one a row a group and partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, by, order).withColumn("part", F.spark_partition_id()), "dealt")
    own = Window.partitionBy(by, "part")
    sums = dealt.groupBy(by, "part").agg(*(F.sum(c).alias(f"all_{c}") for c in names))
    past = Window.partitionBy(by).orderBy("part")
    base = sums.select(by, "part", *((F.sum(f"all_{c}").over(past) - F.col(f"all_{c}")).alias(f"base_{c}") for c in names))
    told = dealt.withColumns({f"in_{c}": F.sum(c).over(own.orderBy(order)) - F.col(c) for c in names}).join(base, [by, "part"])
    return told.withColumns({f"before_{c}": F.col(f"in_{c}") + F.col(f"base_{c}") for c in names}).drop("part", *(f"{p}_{c}" for p in ("in", "base") for c in names))


def rank_tests(errors: DataFrame, base: int) -> DataFrame:
    """``errors(k, x)`` -> (k, z, median): the rank sum test of the base's values against each group's, ties at mean ranks, and each group's median.

    Equal values of a group are one row. The base's values stand beside each group's, a few dozen times at most.
    """
    counts = errors.groupBy("k", "x").agg(F.count("*").alias("n"))
    ks = F.broadcast(errors.select(F.col("k").alias("other")).distinct())  # the groups are ranks, a few dozen
    own = counts.select("k", "x", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))
    beside = counts.where(F.col("k") == base).join(ks, F.lit(True)).select(F.col("other").alias("k"), "x", F.col("n").alias("a"), F.lit(0).cast("long").alias("b"))
    met = own.union(beside).groupBy("k", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ranked = running_sums(met, "k", "x", ["a", "b"])
    rank = F.col("before_a") + F.col("before_b") + (F.col("a") + F.col("b") + 1) / F.lit(2.0)
    n, m, s = F.sum("a").cast("double"), F.sum("b").cast("double"), F.sum(F.col("a") * rank)
    z = (s - n * (n + m + 1) / 2.0) / F.sqrt(n * m * (n + m + 1) / 12.0)
    return ranked.groupBy("k").agg(z.alias("z")).join(medians(errors, ("k",)), "k")


def spanning_tree(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs(a, b, distance)`` -> the edges of a least spanning forest, and (id, comp) with the smallest id of each tree.

    Rounds after Boruvka: every component takes its nearest edge, ties by ends, and
    chains of components are drawn together by pointer jumping; at least half of the
    components that can go are gone after each. Of several edges between two
    components only the nearest stays. Nulls and loops do not count.
    """
    sound = pairs.where("a is not null and b is not null and a <> b and distance is not null")
    edges = written(sound.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("distance").alias("distance")), "edges")
    both = edges.select("a").union(edges.select(F.col("b").alias("a"))).distinct()
    labels = written(both.select(F.col("a").alias("id"), F.col("a").alias("comp")), "labels")
    open_ = edges.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct("distance", "a", "b").alias("e"))
    tree = []
    while not open_.isEmpty():
        sides = open_.select("ca", "cb", "e").union(open_.select("cb", "ca", "e"))
        best = written(sides.groupBy(F.col("ca").alias("c")).agg(F.min(F.struct("e", "cb")).alias("m")).select("c", F.col("m.cb").alias("to"), F.col("m.e").alias("e")), "best")
        tree.append(best.select("e.a", "e.b", "e.distance").distinct())
        # two components that chose each other: the smaller one is the root
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        root = best.join(back, "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        root = written(root, "roots")
        while True:
            up = root.select(F.col("c").alias("to"), F.col("to").alias("up"))
            jumped = written(root.join(up, "to").select("c", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved")), "roots")
            root = jumped.select("c", "to")
            if jumped.where("moved").isEmpty():
                break
        left, right = root.select(F.col("c").alias("ca"), F.col("to").alias("ra")), root.select(F.col("c").alias("cb"), F.col("to").alias("rb"))
        drawn = open_.join(left, "ca").join(right, "cb").where("ra <> rb").select(F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb"), "e")
        open_ = written(drawn.groupBy("ca", "cb").agg(F.min("e").alias("e")), "edges")
        of = root.withColumnRenamed("c", "comp")
        labels = written(labels.join(of, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "labels")
    none = edges.where(F.lit(False)).select("a", "b", "distance")
    least = labels.groupBy("comp").agg(F.min("id").alias("least"))
    return reduce(DataFrame.union, tree, none), labels.join(least, "comp").select("id", F.col("least").alias("comp"))


def linkage_cuts(tree: DataFrame, points: DataFrame, distances: list[float]) -> DataFrame:
    """(cut, id, cluster): single linkage of ``points(id)`` cut at several distances, from the edges of its spanning tree alone."""
    cuts = []
    for d in distances:
        _, comps = spanning_tree(tree.where(F.col("distance") <= d))
        cuts.append(points.select("id").join(comps, "id", "left").select(F.lit(float(d)).alias("cut"), "id", F.coalesce("comp", "id").alias("cluster")))
    return reduce(DataFrame.union, cuts)
