"""Multinomial resamples of a catalogue, cell by cell.

A sample's total is split down a binary tree over its channels: at each node a
binomial draw says how much goes to the left half. A draw's generator is keyed by
sample, node and replicate, so every cell replays the draws on its own way down
and meets the same numbers as its neighbours. No task needs a sample's cells
together, and replicates move no rows. The tree is over the leading bits of a
hash of the channel's name; the few channels that share all of these bits lie in
one bucket and split what reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits beyond the logarithm of the number of channels: buckets then mostly hold one channel.
SPARE = 2
#: Draws that a task remembers, so that neighbours need not replay them.
REMEMBERED = 200_000
#: Rows of resampled cells that a task hands on at a time.
ROWS_OUT = 50_000


def _leading(h: Column, bits: int | Column) -> Column:
    """The first ``bits`` (1 to 63) bits of a long, as a number; 0 for no bits."""
    n = F.lit(bits) if isinstance(bits, int) else bits
    shifted = F.call_function("shiftrightunsigned", h, (64 - n).cast("int"))
    return F.when(n > 0, shifted).otherwise(F.lit(0).cast("long"))


def _buckets(catalog: DataFrame) -> tuple[DataFrame, int]:
    """(sample, bucket, members, weight) and the bits of a bucket; members are (channel, cnt) of counts over zero."""
    cells = catalog.groupBy("channel", "sample").agg(F.round(F.sum("cnt")).cast("long").alias("cnt")).where("cnt > 0")
    n = catalog.select("channel").distinct().count()
    bits = max(1, min(62, n.bit_length() + SPARE))
    found = cells.groupBy("sample", _leading(F.xxhash64("channel"), bits).alias("bucket"))
    return found.agg(F.sort_array(F.collect_list(F.struct("channel", "cnt"))).alias("members"), F.sum("cnt").alias("weight")), bits


def _paths(buckets: DataFrame, bits: int, seed: int) -> DataFrame:
    """(sample, bucket, members, total, path): path holds (key, depth, share, left) of each node above where both halves hold counts.

    share is the left half's part of the node, left whether the bucket lies there.
    """
    depth = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("depth")
    steps = buckets.select("sample", "bucket", "weight", depth)
    node = F.call_function("shiftrightunsigned", F.col("bucket"), (bits - F.col("depth")).cast("int"))
    left = F.call_function("shiftrightunsigned", F.col("bucket"), (bits - 1 - F.col("depth")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 0
    steps = steps.select("sample", "bucket", "weight", "depth", node.alias("node"), left.alias("left"))
    left_part = F.sum(F.when(F.col("left"), F.col("weight")).otherwise(0))
    nodes = steps.groupBy(F.col("sample").alias("s"), F.col("depth").alias("d"), F.col("node").alias("n")).agg(F.sum("weight").alias("w"), left_part.alias("l"))
    nodes = nodes.where("d = 0 or (l > 0 and l < w)")
    met = steps.join(nodes, F.col("sample").eqNullSafe(F.col("s")) & (F.col("depth") == F.col("d")) & (F.col("node") == F.col("n")))
    key = F.xxhash64(F.lit(seed), "sample", "depth", "node")
    step = F.struct("depth", key.alias("key"), (F.col("l") / F.col("w")).alias("share"), "left")
    root = F.max(F.when(F.col("depth") == 0, F.col("w"))).alias("total")
    path = met.groupBy("sample", "bucket").agg(root, F.sort_array(F.collect_list(step)).alias("path")).withColumnsRenamed({"sample": "s", "bucket": "b"})
    at = F.col("sample").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    split = F.xxhash64(F.lit(seed), "sample", F.lit(bits), "bucket").alias("split")
    return buckets.join(path, at).select("sample", "bucket", "members", "total", "path", split)


def _generator(key: int, replicate: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=np.array([key & 0xFFFFFFFFFFFFFFFF, replicate], np.uint64)))


def _reaches(row: dict, replicate: int, known: dict) -> int:
    """The counts of a replicate that reach the row's bucket."""
    n = row["total"]
    for s in row["path"]:
        if 0 < s["share"] < 1 and n:
            at = (s["key"], replicate)
            if at not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[at] = int(_generator(*at).binomial(n, s["share"]))
            n = known[at] if s["left"] else n - known[at]
        elif s["left"] != (s["share"] == 1):
            n = 0
    return n


def _draw(replicates: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        out: list[tuple] = []

        def taken():
            columns = zip(*out, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                weights = np.array([m["cnt"] for m in row["members"]], np.float64)
                for r in range(replicates):
                    n = _reaches(row, r, known)
                    parts = [n] if len(weights) == 1 else _generator(row["split"], r).multinomial(n, weights / weights.sum()).tolist()
                    out.extend((m["channel"], row["sample"], r, c) for m, c in zip(row["members"], parts, strict=True) if c)
                    if len(out) >= ROWS_OUT:
                        yield taken()
        if out:
            yield taken()

    return run


def resample(catalog: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """(channel, sample, replicate, cnt): multinomial resamples of each sample's counts, without cells of zero.

    ``catalog`` has columns channel, sample, cnt; others are not read. Cells of
    one name are summed and rounded; null, zero and lower counts have no share.
    A sample's total stays in each replicate. Null names are names of their own.
    The draws depend on seed, sample, channels and replicate, not on how rows
    lie. No rows, or no replicates, give no rows.
    """
    kinds = dict(catalog.dtypes)
    if not {kinds["channel"], kinds["sample"]} <= {"string"}:
        catalog = catalog.select(F.col("channel").cast("string").alias("channel"), F.col("sample").cast("string").alias("sample"), "cnt")
    buckets, bits = _buckets(catalog.select("channel", "sample", "cnt"))
    parts = max(1, int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    #: by ranges, so that a task's rows are neighbours in the tree and a large sample is spread over tasks
    rows = _paths(buckets, bits, seed).repartitionByRange(parts, "sample", "bucket").sortWithinPartitions("sample", "bucket")
    schema = pa.schema([("channel", pa.string()), ("sample", pa.string()), ("replicate", pa.int32()), ("cnt", pa.int64())])
    return rows.mapInArrow(_draw(replicates, schema), "channel string, sample string, replicate int, cnt long")


def resampling_spread(catalog: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """(channel, sample, cnt, mean, sd): each cell over zero with mean and standard deviation over its resamples.

    Says how far a cell's count is noise: sd is near ``sqrt(cnt * (1 - cnt / total))``. At least two replicates.
    """
    if replicates < 2:
        raise ValueError("a deviation needs at least two replicates")
    cells = catalog.groupBy("channel", "sample").agg(F.round(F.sum("cnt")).cast("long").alias("cnt")).where("cnt > 0")
    x = F.col("cnt").cast("double")
    drawn = resample(catalog, replicates, seed).groupBy("channel", "sample").agg(F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"))
    drawn = drawn.withColumnsRenamed({"channel": "c", "sample": "s"})
    sx, sxx = (F.coalesce(c, F.lit(0.0)) for c in ("sx", "sxx"))
    sd = F.sqrt(F.greatest(F.lit(0.0), (sxx - sx * sx / replicates) / (replicates - 1)))
    at = F.col("channel").eqNullSafe(F.col("c")) & F.col("sample").eqNullSafe(F.col("s"))
    return cells.join(drawn, at, "left").select("channel", "sample", "cnt", (sx / replicates).alias("mean"), sd.alias("sd"))
