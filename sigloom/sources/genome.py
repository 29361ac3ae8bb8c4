"""Reference sequences in blocks, flanks of variants, and the strand that is transcribed.

Sequences are cut into blocks that overlap by a margin, so a variant and its
flanks lie in one block and meet in one equi-join. Transcribed ranges are cut at
the edges of bins and united there, so a variant meets one row of its bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bases of a block without its margins; bases of a margin; bases of a bin of ranges.
BLOCK, MARGIN, BIN = 4096, 512, 16_384


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, bases): pieces of the sequences of FASTA files, ``start`` counted from 1.

    Lines keep their order within a partition, and partitions theirs; a running
    sum within partitions and one over a row a partition and sequence give every
    line its place. A name ends at the first white space.
    """
    files = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    own = Window.partitionBy("file", "block").orderBy("at")
    head = F.when(F.startswith("value", F.lit(">")), F.regexp_extract("value", r"^>\s*(\S*)", 1))
    lines = files.select("file", "block", "at", F.trim("value").alias("value"), head.alias("head"))
    lines = lines.withColumn("part", F.count("head").over(own)).withColumn("name", F.last("head", True).over(own))
    size = F.when(F.col("head").isNull(), F.length("value")).otherwise(0)
    within = Window.partitionBy("file", "block", "part")
    lines = lines.withColumn("before", F.sum(size).over(within.orderBy("at")) - size)
    sums = lines.groupBy("file", "block", "part").agg(F.sum(size).alias("size"), F.first("name", True).alias("name"))
    order = Window.partitionBy("file").orderBy("block", "part")  # a row a partition and sequence
    told = sums.withColumn("chrom", F.last("name", True).over(order)).withColumn("run", F.count("name").over(order))
    told = told.withColumn("base", F.sum("size").over(Window.partitionBy("file", "run").orderBy("block", "part")) - F.col("size"))
    joined = lines.where("head is null and value <> ''").join(told.select("file", "block", "part", "chrom", "base"), ["file", "block", "part"])
    return joined.select("chrom", (F.col("base") + F.col("before") + 1).alias("start"), F.upper("value").alias("bases"))


def pieces(sequences: DataFrame, size: int = BLOCK) -> DataFrame:
    """``sequences(chrom, bases)`` of any length -> (chrom, start, bases) of at most ``size`` bases, in one pass over each."""
    cut = F.regexp_extract_all("bases", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return sequences.select("chrom", F.posexplode(cut).alias("i", "bases")).select("chrom", (F.col("i").cast("long") * size + 1).alias("start"), "bases")


def blocks(parts: DataFrame, size: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """Pieces (chrom, start, bases) -> (chrom, block, first, bases): each block with ``margin`` more bases on both sides where there are any.

    A group holds the pieces of one block, at most ``size + 2 * margin`` bases.
    """
    end = F.col("start") + F.length("bases") - 1
    lowest = F.greatest(F.lit(0), F.floor((F.col("start") - 1 - margin) / size)).cast("long")
    spread = parts.select("chrom", "start", "bases", F.explode(F.sequence(lowest, F.floor((end - 1 + margin) / size).cast("long"))).alias("block"))
    first, last = F.greatest(F.lit(1), F.col("block") * size + 1 - margin), (F.col("block") + 1) * size + margin
    low, high = F.greatest("start", first), F.least(end, last)
    clipped = spread.where(low <= high).select("chrom", "block", low.alias("low"), F.substring("bases", (low - F.col("start") + 1).cast("int"), (high - low + 1).cast("int")).alias("bases"))
    held = clipped.groupBy("chrom", "block").agg(F.array_sort(F.collect_list(F.struct("low", "bases"))).alias("p"))
    return held.select("chrom", "block", F.col("p")[0]["low"].alias("first"), F.array_join(F.col("p")["bases"], "").alias("bases"))


def with_flanks(variants: DataFrame, held: DataFrame, size: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """The variants (chrom, pos, ref, alt, ...) with ``before`` and ``after`` from ``blocks``; those outside the sequences go.

    ``after``: bases behind the reference allele, as far as the block's margin
    holds them. ``before``: bases up to the variant, and for insertions and
    deletions with their shared first base. The margin bounds how many repeats of
    a long piece are seen. Every variant is a row of its own, so variants at one
    position do not mix.
    """
    at = variants.withColumn("block", F.floor((F.col("pos") - 1) / size).cast("long"))
    joined = at.join(held, ["chrom", "block"]).withColumn("i", F.col("pos") - F.col("first"))
    anchor = F.when(F.length("ref") == F.length("alt"), 0).otherwise(1)
    stop = F.col("i") + anchor
    before = F.substring("bases", F.greatest(stop - margin, F.lit(0)).cast("int") + 1, F.least(stop, F.lit(margin)).cast("int"))
    after = F.substring("bases", (F.col("i") + F.length("ref") + 1).cast("int"), F.lit(margin))
    return joined.where("i >= 0 and i < length(bases)").withColumns({"before": before, "after": after}).drop("block", "first", "bases", "i")


def transcribed(ranges: DataFrame, size: int = BIN) -> DataFrame:
    """``ranges(chrom, start, end, strand)`` -> (chrom, bin, plus, minus): the disjoint stretches of each strand within each bin.

    Ranges are cut at the bins' edges; what overlaps or touches within a bin is
    united, so that an array holds at most half as many stretches as a bin has
    bases, whatever the number of ranges. Ends count; other strands than + and - go.
    """
    cut = ranges.where("strand in ('+', '-') and start <= end").select("chrom", "strand", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))).alias("bin"))
    cut = cut.select("chrom", "strand", "bin", F.greatest("start", F.col("bin") * size).alias("s"), F.least("end", (F.col("bin") + 1) * size - 1).alias("e"))
    ends = cut.groupBy("chrom", "bin", "strand", "s").agg(F.max("e").alias("e"))  # at most a row a base and strand from here
    own = Window.partitionBy("chrom", "bin", "strand").orderBy("s")
    reach = F.max("e").over(own.rowsBetween(Window.unboundedPreceding, -1))
    island = ends.withColumn("new", F.coalesce((F.col("s") > reach + 1).cast("int"), F.lit(1))).withColumn("n", F.sum("new").over(own))
    merged = island.groupBy("chrom", "bin", "strand", "n").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    of = lambda strand: F.array_sort(F.collect_list(F.when(F.col("strand") == strand, F.struct("s", "e"))))
    return merged.groupBy("chrom", "bin").agg(of("+").alias("plus"), of("-").alias("minus"))


def with_strand(variants: DataFrame, bins: DataFrame, size: int = BIN) -> DataFrame:
    """The variants with ``strand``: +, -, B (both) or N (none), by one equi-join with ``transcribed`` ranges."""
    at = variants.withColumn("bin", F.floor(F.col("pos") / size))
    joined = at.join(bins, ["chrom", "bin"], "left")
    inside = lambda c: F.coalesce(F.exists(c, lambda r: (r.s <= F.col("pos")) & (r.e >= F.col("pos"))), F.lit(False))
    plus, minus = inside("plus"), inside("minus")
    strand = F.when(plus & minus, "B").when(plus, "+").when(minus, "-").otherwise("N")
    return joined.withColumn("strand", strand).drop("bin", "plus", "minus")


def strand_class(strand: Column, turned: Column, classes: str) -> Column:
    """T where the pyrimidine stands on the transcribed strand, U where on the other, N or B; B counts as N where ``classes`` lack it.

    ``strand``: the coding strand of what is transcribed; ``turned``: whether the pyrimidine is on the reverse strand.
    """
    told = F.when(strand == "B", "B" if "B" in classes else "N").when(strand.isin("+", "-"), F.when((strand == "+") == turned, "T").otherwise("U"))
    return F.coalesce(told, F.lit("N"))
