"""Shards of near-equal bytes by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, id), so equal texts lie together. A
splitter's place is found by rounds of exact counting: each round sums the
bytes in finer cells of the key range that still holds it, all partitions
counting at once and at most ``(shards - 1) * 2**BITS`` sums returning. A text
whose copies alone exceed the tolerance is cut by id in the same way. Then the
rows are exchanged once, sorted by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

BITS = 11
_TOP = 1 << 63


def _find(keyed: DataFrame, n_shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Splitters as (k1, k2): a row lies above one if its (k1, k2) is not smaller."""
    total = keyed.agg(F.sum("w")).first()[0] or 0
    slack = tolerance * total / n_shards
    cut = {}
    #: of each open splitter: (k1 if found, cell's prefix, bits known, weight below the cell)
    open_ = {j: (None, 0, 0, 0) for j in range(1, n_shards)} if total else {}
    while open_:
        sums = {}
        for k1, known in {(o[0], o[2]) for o in open_.values()}:
            take = min(BITS, 64 - known)
            col = F.col("k2" if k1 is not None else "k1").bitwiseXOR(F.lit(-_TOP))
            rows = keyed if k1 is None else keyed.where(F.col("k1") == k1)
            if known:
                cells = {o[1] for o in open_.values() if (o[0], o[2]) == (k1, known)}
                rows = rows.where(F.shiftrightunsigned(col, 64 - known).isin([c - (1 << 64) if c >= _TOP else c for c in cells]))
            cell = F.shiftrightunsigned(col, 64 - known - take) if known + take < 64 else col
            got = rows.groupBy(cell.alias("c")).agg(F.sum("w"), F.count("*"), F.min("k1"), F.max("k1"), F.min("k2"), F.max("k2")).collect()
            sums[k1, known] = take, sorted((r[0] % (1 << 64), *r[1:]) for r in got)
        for j, (k1, prefix, known, below) in list(open_.items()):
            take, rows = sums[k1, known]
            goal, at = j * total / n_shards, below
            for c, w, n, lo1, hi1, lo2, hi2 in (r for r in rows if r[0] >> take == prefix):
                if at + w >= goal:
                    break
                at += w
            edge = lambda x, done: (x, -_TOP) if k1 is None else (k1, x)  # noqa: B023,E731
            low = (c << (64 - known - take)) - _TOP
            high = low + (1 << (64 - known - take))
            if min(goal - at, at + w - goal) <= slack or (lo1, lo2) == (hi1, hi2):
                above = at + w - goal < goal - at
                cut[j] = (edge(high, 1) if above else edge(low, 1))
                if above and high == _TOP:
                    cut[j] = (k1, _TOP) if k1 is not None else (_TOP, 0)
                del open_[j]
            elif k1 is None and lo1 == hi1:
                open_[j] = (lo1, 0, 0, at)
            else:
                open_[j] = (k1, c, known + take, at)
    return [cut[j] for j in sorted(cut)]


def _above(k1: int, k2: int) -> Column:
    if k1 >= _TOP:
        return F.lit(0)
    over = F.col("k1") > k1
    if k2 < _TOP:
        over = over | ((F.col("k1") == k1) & (F.col("k2") >= k2))
    return over.cast("int")


def shard(docs: DataFrame, n_shards: int = 8, law: str = "bytes", tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default: all of ``docs``) and size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1. ``law``: ``bytes`` makes the shards'
    sizes near equal (within ``tolerance`` of a shard at each splitter where the
    rows allow it), ``rows`` their counts. slot numbers a shard's rows from 0
    without gaps, in key order. Ids are integers. A null text counts as empty, a null id sorts as
    the lowest; rows of equal text and id are not parted; no rows give no rows.
    A column of ``docs`` named like a result is left out.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"law must be 'bytes' or 'rows', not {law!r}")
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.struct(*carry).alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.coalesce(F.col(id_col).cast("long"), F.lit(-_TOP)).alias("k2"))
    narrow = set(carry) <= {id_col}
    keyed = materialise(own if narrow else own.drop("row"), "keys").withColumn("w", F.col("size") if law == "bytes" else F.lit(1))
    splitters = _find(keyed, n_shards, tolerance if law == "bytes" else 0.0)
    shard_of = sum((_above(*s) for s in splitters), F.lit(0)).cast("int")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (keyed.drop("w") if narrow else own).withColumn("shard", shard_of)
    dealt = dealt.repartitionByRange(parts, "shard", "k1", "k2").sortWithinPartitions("shard", "k1", "k2").withColumn("at", F.monotonically_increasing_id())
    dealt = materialise(dealt.drop("k1", "k2"), "dealt").withColumn("part", F.shiftright("at", 33))
    runs = dealt.groupBy("shard", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = runs.alias("x").join(runs.alias("y"), (F.col("x.shard") == F.col("y.shard")) & (F.col("y.part") < F.col("x.part")), "left")
    base = before.groupBy(F.col("x.shard").alias("shard"), F.col("x.part").alias("part"), F.col("x.first").alias("first")).agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("base"))
    out = dealt.join(materialise(base, "bases"), ["shard", "part"])
    return out.select(*(F.col(f"row.`{c}`") for c in carry), "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("at") - F.col("first") + F.col("base")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
