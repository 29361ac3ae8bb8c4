"""Merkle manifest of a dataset: a tree of digests for each source, one tree over their roots, and proofs.

Trees grow by events, as ``combineByKey`` would: a partial parent holds the
indexed digests of the children that a task has seen; as soon as it has as many
as the size of its tree says, its digest is made and is a child of the next
level. Leaves lie sorted, so a task resolves all but the parents at its edges;
those partial parents are dealt anew by their key and merged, round by round,
until roots are left. Complete parents are stored with their children: read
from the root down, they are the links that give each leaf its proof.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import forget, materialise

WIDTH = 16
#: Partial and complete parents: ``tree``, ``size`` (leaves of the tree), level and place of the parent, children by place.
_NODE = "tree string, size long, level int, parent long, places array<int>, digests array<string>, done boolean"
_ARROW = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("parent", pa.int64()), ("places", pa.list_(pa.int32())), ("digests", pa.list_(pa.string())), ("done", pa.bool_())])


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes' count, a colon and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)).cast("binary"), 256)


def _at_level(size: int, level: int) -> int:
    """Nodes of a tree at a level."""
    for _ in range(level):
        size = -(-size // WIDTH)
    return size


def _fold(batches):
    """Merges partial parents; complete ones go out with ``done`` and are children of the next level, the others as they are."""
    partial: dict[tuple, dict[int, str]] = {}
    rows: list[tuple] = []

    def add(tree, size, level, parent, children):
        while True:
            held = partial.setdefault((tree, size, level, parent), {})
            held.update(children)
            if len(held) < min(WIDTH, _at_level(size, level) - parent * WIDTH):
                return
            del partial[tree, size, level, parent]
            places = sorted(held)
            rows.append((tree, size, level, parent, places, [held[p] for p in places], True))
            if _at_level(size, level + 1) == 1:
                return
            made = hashlib.sha256("".join(held[p] for p in places).encode()).hexdigest()
            level, parent, children = level + 1, parent // WIDTH, {parent % WIDTH: made}

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)
        rows.clear()
        return batch

    for batch in batches:
        for tree, size, level, parent, places, digests in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            add(tree, size, level, parent, dict(zip(places, digests, strict=True)))
        if len(rows) >= 4096:
            yield out()
    rows += [(*key, [*held], [*held.values()], False) for key, held in partial.items()]
    yield out()


def parents(leaves: DataFrame) -> DataFrame:
    """``leaves(tree, size, place, digest)``, places from 0 to size - 1, sorted or nearly so -> all parents with their children.

    A tree of one leaf has no parent. One shuffle a round; a round takes only what the last one left open.
    """
    of = F.col("place").cast("long")
    first = leaves.where("size > 1").select("tree", "size", F.lit(0).alias("level"), F.expr(f"place div {WIDTH}").alias("parent"), F.array((of % WIDTH).cast("int")).alias("places"), F.array("digest").alias("digests"))
    step = materialise(first.mapInArrow(_fold, _NODE), "parents")
    done, spark = [step.where("done")], leaves.sparkSession
    while not (open_ := step.where("not done")).isEmpty():
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = open_.drop("done").repartition(parts, "tree", "size", "level", "parent")
        step = materialise(dealt.mapInArrow(_fold, _NODE), "parents")
        done.append(step.where("done"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def placed(rows: DataFrame, tree: Column, *order: Column) -> DataFrame:
    """``rows`` with ``tree``, ``size`` and ``place``: rows of a tree are numbered in an order by one exchange and a running sum of counts.

    Only the number of rows of each (tree, partition) meets in a window: at most one row a partition. Rows that tie in
    the order are equal leaves; the place in the input parts them, so that copies do not all go to one task.
    """
    keyed = rows.withColumn("tree", tree).withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col("tree").asc_nulls_first(), *order, F.col("tie")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id())
    dealt = materialise(dealt, "dealt").withColumn("part", F.shiftright("at", 33))
    counts = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree_rows = Window.partitionBy("tree")
    base = counts.select("tree", "part", "first", F.sum("n").over(tree_rows).alias("size"), (F.sum("n").over(tree_rows.orderBy("part")) - F.col("n")).alias("before"))
    base = materialise(base, "bases").withColumnRenamed("tree", "of")
    same = F.col("tree").eqNullSafe(F.col("of")) & (dealt.part == base.part)
    return dealt.join(base, same).withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("part", "of", "at", "first", "before")


def _links(nodes: DataFrame, name: str) -> DataFrame:
    """(tree, level, parent, digests, up): for each parent, its children and the (left, right) digests from it to the root of its tree."""
    top = nodes.agg(F.max("level")).first()[0]
    above, levels = None, []
    for level in range(-1 if top is None else top, -1, -1):
        own = nodes.where(F.col("level") == level).select("tree", "size", "level", "parent", "digests")
        if above is None:
            own = own.withColumn("up", F.expr("cast(array() as array<struct<left: string, right: string>>)"))
        else:
            step = above.select(F.col("tree").alias("t"), F.col("parent").alias("p"), F.col("digests").alias("d"), F.col("up").alias("u"))
            own = own.join(step, (F.col("tree").eqNullSafe(F.col("t"))) & (F.expr(f"parent div {WIDTH}") == F.col("p")), "left")
            here = (F.col("parent") % WIDTH).cast("int")
            own = own.withColumn("up", F.when(F.col("p").isNull(), F.expr("cast(array() as array<struct<left: string, right: string>>)")).otherwise(F.concat(F.array(around(F.col("d"), here)), F.col("u")))).drop("t", "p", "d", "u")
        above = materialise(own, name)
        levels.append(above)
    return levels


def around(digests: Column, place: Column) -> Column:
    """What stands left and right of a child."""
    return F.struct(F.array_join(F.slice(digests, F.lit(1), place), "").alias("left"), F.array_join(F.slice(digests, place + 2, F.lit(WIDTH)), "").alias("right"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path of (left, right) digests give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s.left, acc, s.right).cast("binary"), 256))


def with_paths(leaves: DataFrame) -> DataFrame:
    """``leaves(tree, size, place, digest, ...)`` with ``path``, (left, right) digests from the leaf up, and ``top``, its tree's root."""
    levels = _links(parents(leaves), "links")
    none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    if not levels:
        return leaves.withColumn("path", none).withColumn("top", F.col("digest"))
    low = levels[-1].select(F.col("tree").alias("t"), F.col("parent").alias("p"), F.col("digests").alias("d"), F.col("up").alias("u"))
    joined = leaves.join(low, F.col("tree").eqNullSafe(F.col("t")) & (F.expr(f"place div {WIDTH}") == F.col("p")), "left")
    here = (F.col("place") % WIDTH).cast("int")
    joined = joined.withColumn("path", F.when(F.col("p").isNull(), none).otherwise(F.concat(F.array(around(F.col("d"), here)), F.col("u")))).drop("t", "p", "d", "u")
    return joined.withColumn("top", fold(F.col("digest"), F.col("path")))


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", source_col: str = "source", carry: list[Column] | None = None) -> DataFrame:
    """leaf, subroot, root and ``path`` (left and right digests, from the leaf to the root) of every row, with id and source and ``carry``.

    A leaf is the SHA-256 of its ``fields``, each ``-`` where null, else its
    bytes' count, ``:`` and value. Leaves of a source stand by id, null ids
    first; rows of one id stand by leaf, so equal rows have equal leaves and
    places next to each other. A null source is a source of its own and the
    first. No rows give no rows and no root. Empty and very long texts are
    fields like others. Columns of ``docs`` that are not named do not matter.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), digest(*(F.col(c) for c in fields)).alias("digest"), *(carry or []))
    leaves = placed(materialise(own, "leaves"), F.col("_source"), F.col("_id").asc_nulls_first(), F.col("digest"))
    within = with_paths(leaves).drop("size", "place")
    within = materialise(within, "within")
    tops = within.groupBy("tree").agg(F.first("top").alias("digest"))
    above = placed(materialise(tops.select(F.col("tree").alias("source"), "digest"), "tops"), F.lit(""), F.col("source").asc_nulls_first())
    above = with_paths(above).select(F.col("source").alias("s"), F.col("path").alias("over"), F.col("top").alias("root"))
    joined = within.join(above, F.col("tree").eqNullSafe(F.col("s")))
    out = joined.withColumn("path", F.concat("path", "over"))
    extra = [c for c in within.columns if c not in ("_id", "_source", "digest", "tree", "path", "top")]
    return out.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", "path", *extra)


def proof_digest(path: Column) -> Column:
    """SHA-256 of all digests of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), "").cast("binary"), 256)
