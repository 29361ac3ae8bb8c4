"""Readers that turn events and matrices into the long catalogue (context, channel, sample, cnt)."""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import channels as H
from . import genome as G
from .matlab import read_matlab

#: A context's name by its number of channels.
CONTEXTS = {96: "SBS96", 288: "SBS288", 384: "SBS384", 1536: "SBS1536", 4608: "SBS4608", 78: "DBS78", 83: "ID83", 48: "CNV48", 32: "SV32"}
CALLERS = {
    # caller: (sample, chromosome, start, end, total copies, minor copies)
    "ASCAT": ("sample", "chr", "startpos", "endpos", "nMajor+nMinor", "nMinor"),
    "ASCAT_NGS": ("sample", "Chromosome", "Start", "End", "tumour_total", "tumour_minor"),
    "SEQUENZA": ("sample", "chromosome", "start.pos", "end.pos", "CNt", "B"),
    "ABSOLUTE": ("Sample", "Chromosome", "Start.bp", "End.bp", "Modal_HSCN_1+Modal_HSCN_2", "Modal_HSCN_1"),
    "BATTENBERG": ("sample", "chr", "startpos", "endpos", "nMaj1_A+nMin1_A", "nMin1_A"),
    "FACETS": ("ID", "chrom", "start", "end", "tcn.em", "lcn.em"),
    "PURPLE": ("sample", "chromosome", "start", "end", "majorAlleleCopyNumber+minorAlleleCopyNumber", "minorAlleleCopyNumber"),
    "TCGA": ("GDC_Aliquot", "Chromosome", "Start", "End", "Copy_Number", "Minor_Copy_Number"),
}


def context_of(n_channels: int) -> str:
    return CONTEXTS.get(n_channels, f"CH{n_channels}")


def parse_contexts(text: str) -> list[str]:
    if text.lower() == "default":
        return ["SBS96", "DBS78", "ID83"]
    return [c for c in text.upper().replace(" ", "").split(",") if c]


def seed_of(spark: SparkSession, seeds: str = "random") -> int:
    """A new 128-bit seed, or the one value of column ``Seed`` in a tab-separated file."""
    if seeds == "random":
        return secrets.randbits(128)
    try:
        rows = spark.read.option("sep", "\t").option("header", True).csv(seeds).select("Seed").limit(2).collect()
    except Exception as e:
        raise ValueError(f"cannot read seeds from {seeds!r}") from e
    if len(rows) != 1:
        raise ValueError("a seed file holds one seed")
    return int(rows[0][0])


def to_long(wide: DataFrame, channel: str | None = None) -> DataFrame:
    """First (or named) column is the channel, each other one a sample: (channel, sample, cnt)."""
    channel = channel or wide.columns[0]
    samples = [c for c in wide.columns if c != channel]
    named = wide.select(F.col(f"`{channel}`").cast("string").alias("channel"), *(F.col(f"`{c}`").cast("double").alias(c) for c in samples))
    return named.unpivot("channel", [F.col(f"`{c}`") for c in samples], "sample", "cnt")


def to_wide(catalog: DataFrame, samples: list[str] | None = None, value: str = "cnt") -> DataFrame:
    """Pivot with an explicit list of samples, so that no extra job finds them."""
    samples = samples or [r[0] for r in catalog.select("sample").distinct().orderBy("sample").collect()]
    return catalog.groupBy("channel").pivot("sample", samples).agg(F.sum(value)).fillna(0)


def sort_channels(rows: DataFrame, order: DataFrame) -> DataFrame:
    """``rows(channel, ...)`` in the order of ``order(channel, channel_idx)``, a few thousand names; rows of other channels go."""
    return rows.join(F.broadcast(order.select("channel", "channel_idx")), "channel").orderBy("channel_idx").drop("channel_idx")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return to_long(spark.read.option("sep", "\t").option("header", True).csv(path))


def _keyed(df: DataFrame) -> DataFrame:
    mutation, tri = df.columns[:2]
    label = F.concat(F.substring(tri, 1, 1), F.lit("["), F.col(f"`{mutation}`"), F.lit("]"), F.substring(tri, 3, 1))
    return df.select(label.alias("channel"), *(F.col(f"`{c}`") for c in df.columns[2:]))


def read_csv_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated matrix; with two key columns (mutation, trinucleotide) the channel is ``X[R>A]Y``."""
    df = spark.read.option("header", True).csv(path)
    return to_long(_keyed(df) if df.columns[1].lower().startswith("trinucleotide") else df)


def merge_matrices(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Inner equi-join of matrices on their key columns."""
    return reduce(lambda a, b: a.join(b, keys, "inner"), frames)


def read_csv_folder(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Comma-separated matrices of other samples each, merged on their key columns: two (mutation, trinucleotide) or one."""
    frames = [spark.read.option("header", True).csv(p) for p in paths]
    two = frames[0].columns[1].lower().startswith("trinucleotide")
    merged = merge_matrices(frames, frames[0].columns[: 2 if two else 1])
    return to_long(_keyed(merged) if two else merged)


def align(catalog: DataFrame, order: DataFrame) -> DataFrame:
    """Every channel of ``order(channel, channel_idx)`` for every sample; cells that are absent are 0, other channels go."""
    cells = order.crossJoin(catalog.select("sample").distinct())
    return cells.join(catalog, ["channel", "sample"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def count_events(events: DataFrame, channel: Column, sample: Column) -> DataFrame:
    return events.select(channel.alias("channel"), sample.alias("sample")).where("channel is not null and sample is not null").groupBy("channel", "sample").agg(F.count("*").alias("cnt"))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chrom string, pos bigint, sample string, ref string, alt string").option("sep", "\t").option("comment", "#").csv(path)


def fold(bases: Column) -> Column:
    """The other strand's bases, read in its direction."""
    return F.reverse(F.translate(bases, "ACGT", "TGCA"))


def _flanked(variants: DataFrame, flanks: DataFrame | None) -> DataFrame:
    """The variants with ``before`` and ``after``: their own, or those of ``flanks`` by position and, where it has them, alleles."""
    if flanks is None:
        return variants
    keys = ["chrom", "pos", *(c for c in ("ref", "alt") if c in flanks.columns)]
    return variants.join(flanks.select(*keys, "before", "after").distinct(), keys)


def substitutions(variants: DataFrame, flanks: DataFrame | None = None, context: str = "SBS96") -> DataFrame:
    """Single-base channels on the pyrimidine strand.

    ``X[R>A]Y`` where the variants have ``before`` and ``after`` (``genome.with_flanks``)
    or ``flanks`` gives them for substitutions; two bases on each side for
    SBS1536 and SBS4608, and ``T:``, ``U:``, ``N:`` or ``B:`` first where the
    context asks for strands, by the variants' ``strand`` (``genome.with_strand``).
    Without neighbours ``R>A``. Variants with other letters beside them go.
    """
    snv = variants.where("ref rlike '^[ACGT]$' and alt rlike '^[ACGT]$' and ref <> alt")
    turn = F.col("ref").isin("A", "G")
    change = F.when(turn, F.concat(fold(F.col("ref")), F.lit(">"), fold(F.col("alt")))).otherwise(F.concat("ref", F.lit(">"), "alt"))
    if flanks is None and "before" not in variants.columns:
        return count_events(snv, change, F.col("sample"))
    width, classes = H.WIDTHS[context], H.STRANDS[context]
    near = {"before": F.right("before", F.lit(width)), "after": F.left("after", F.lit(width))}
    both = _flanked(snv, flanks).withColumns(near).where(f"before rlike '^[ACGT]{{{width}}}$' and after rlike '^[ACGT]{{{width}}}$'")
    left, right = F.when(turn, fold(F.col("after"))).otherwise(F.col("before")), F.when(turn, fold(F.col("before"))).otherwise(F.col("after"))
    channel = F.concat(left, F.lit("["), change, F.lit("]"), right)
    if classes:
        channel = F.concat(G.strand_class(F.col("strand"), turn, classes), F.lit(":"), channel)
    return count_events(both, channel, F.col("sample"))


def doublets(variants: DataFrame) -> DataFrame:
    """Neighbouring substitutions of a sample as ``RR>AA``, one of 78 names: the strand on which the pair has one."""
    snv = variants.where("ref rlike '^[ACGT]$' and alt rlike '^[ACGT]$' and ref <> alt")
    nxt = snv.select("chrom", "sample", (F.col("pos") - 1).alias("pos"), F.col("ref").alias("ref2"), F.col("alt").alias("alt2"))
    pair = snv.join(nxt, ["chrom", "sample", "pos"]).select("sample", F.concat("ref", "ref2").alias("r"), F.concat("alt", "alt2").alias("a"))
    here = F.concat("r", F.lit(">"), "a")
    channel = F.when(here.isin(H.channel_names("DBS78")), here).otherwise(F.concat(fold(F.col("r")), F.lit(">"), fold(F.col("a"))))
    return count_events(pair, channel, F.col("sample"))


def indels(variants: DataFrame, flanks: DataFrame | None = None) -> DataFrame:
    """Insertions and deletions as ``length:type:class:n``.

    Alleles share their first base; ``before`` and ``after``, of the variants or of
    ``flanks``, are the reference's bases up to that base and those that follow the
    reference allele: after a deleted piece, or after the point of insertion.
    Lengths and repeats count up to 5. One base: its pyrimidine and the number of
    further such bases that follow. Longer pieces: R and the copies of the piece
    that follow, or, for a deletion without any, M and the longest part of the
    piece that stands at its end before it or at its beginning after it.
    """
    one = variants.where("ref rlike '^[ACGT]+$' and alt rlike '^[ACGT]+$' and left(ref, 1) = left(alt, 1) and (length(ref) = 1) <> (length(alt) = 1)")
    kind = F.when(F.length("ref") > 1, "Del").otherwise("Ins")
    piece = F.expr("substring(if(length(ref) > 1, ref, alt), 2)")
    both = _flanked(one, flanks).withColumns({"kind": kind, "piece": piece, "size": F.length(piece)})
    copies = F.least(F.lit(5), F.floor(F.length(F.call_function("regexp_extract", F.col("after"), F.concat(F.lit("^((?:"), F.col("piece"), F.lit("){0,5})")), F.lit(1))) / F.col("size")))
    shared = F.expr("array_max(transform(sequence(0, greatest(size - 1, 0)), i -> if(left(after, i) = left(piece, i) or right(before, i) = right(piece, i), i, 0)))")
    told = both.withColumns({"n": copies, "m": F.least(F.lit(5), shared)})
    base = F.when(F.col("piece").isin("A", "G"), fold(F.col("piece"))).otherwise(F.col("piece"))
    micro = (F.col("kind") == "Del") & (F.col("size") > 1) & (F.col("n") == 0) & (F.col("m") > 0)
    label = F.when(F.col("size") == 1, base).when(micro, "M").otherwise("R")
    count = F.when(micro, F.col("m")).otherwise(F.col("n"))
    return count_events(told, F.concat_ws(":", F.least(F.lit(5), "size").cast("string"), "kind", label, count.cast("string")), F.col("sample"))


#: Other names that a context may be asked for by.
ALIASES = {"DINUC": "DBS78", "DBS": "DBS78", "ID": "ID83", "SBS6": "SBS96", "6": "SBS96"} | {str(n): name for n, name in CONTEXTS.items()}


def variant_contexts(variants: DataFrame, context_type: str = "default", flanks: DataFrame | None = None, parts: DataFrame | None = None, ranges: DataFrame | None = None) -> dict[str, DataFrame]:
    """The catalogues of the contexts asked for, by name, with all channels of each; ``default`` are SBS96, DBS78 and ID83.

    Neighbours come from ``parts(chrom, start, bases)``, pieces of the reference,
    from ``flanks(chrom, pos, ref, alt, before, after)``, or are the variants'
    own ``before`` and ``after``. Without any,
    substitutions have six classes and indels cannot be told: SBS6 then stands
    for SBS96, and ID83 is left out. Contexts with strands need
    ``ranges(chrom, start, end, strand)``, what is transcribed.
    """
    if flanks is not None and not {"ref", "alt"} <= set(flanks.columns):
        raise ValueError("flanks need ref and alt: variants at one position have flanks of their own")
    names = [ALIASES.get(n, n) for n in parse_contexts(context_type)]
    known = parts is not None or flanks is not None or "before" in variants.columns
    for name in names:
        if name not in (*H.STRANDS, "DBS78", "ID83"):
            raise ValueError(f"unknown context {name!r} of variants")
        if not known and context_type.lower() != "default" and name not in ("SBS96", "DBS78"):
            raise ValueError(f"{name} needs the reference's bases beside the variants")
        if H.STRANDS.get(name) and ranges is None:
            raise ValueError(f"{name} needs the ranges that are transcribed")
    told = G.with_flanks(variants, G.blocks(parts)) if parts is not None else _flanked(variants, flanks)
    if ranges is not None:
        told = G.with_strand(told, G.transcribed(ranges))
    out = {}
    for name in names:
        if name == "DBS78":
            out[name] = H.complete(doublets(variants), name)
        elif name == "ID83":
            if known:
                out[name] = H.complete(indels(told), name)
        elif known:
            out[name] = H.complete(substitutions(told, context=name), name)
        else:
            out["SBS6"] = substitutions(variants)
    return out


def size_bin(length: Column, edges: list[tuple[float, str]], last: str) -> Column:
    out = F.lit(last)
    for upper, label in reversed(edges):
        out = F.when(length <= upper, label).otherwise(out)
    return out


def structural(bedpe: DataFrame, near: int = 1_000_000, crowd: int = 10) -> DataFrame:
    """``bedpe(sample, chrom1, start1, chrom2, start2, svclass)`` to 32 channels.

    A breakpoint is clustered if its bin of ``near`` bases and the two beside it
    hold at least ``crowd`` breakpoints of the sample.
    """
    kinds = {"deletion": "del", "tandem-duplication": "tds", "inversion": "inv", "translocation": "trans"}
    kind = F.coalesce(*(F.when(F.col("svclass") == k, v) for k, v in kinds.items()))
    span = size_bin(F.abs(F.col("start2") - F.col("start1")), [(1e4, "1-10Kb"), (1e5, "10-100Kb"), (1e6, "100Kb-1Mb"), (1e7, "1Mb-10Mb")], ">10Mb")
    rows = bedpe.withColumn("row", F.monotonically_increasing_id()).withColumn("bin", F.floor(F.col("start1") / near))
    ends = bedpe.select("sample", F.col("chrom1").alias("c"), F.col("start1").alias("p")).union(bedpe.select("sample", "chrom2", "start2"))
    bins = ends.groupBy("sample", "c", F.floor(F.col("p") / near).alias("b")).count()
    around = bins.select("sample", F.col("c").alias("chrom1"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("bin"), "count").groupBy("sample", "chrom1", "bin").agg(F.sum("count").alias("crowd"))
    told = rows.join(around, ["sample", "chrom1", "bin"], "left")
    prefix = F.when(F.coalesce("crowd", F.lit(0)) >= crowd, "clustered_").otherwise("non-clustered_")
    channel = F.when(kind == "trans", F.concat(prefix, kind)).otherwise(F.concat_ws("_", F.concat(prefix, kind), span))
    return count_events(told.where(kind.isNotNull()), channel, F.col("sample"))


def segments(df: DataFrame, caller: str) -> DataFrame:
    """A caller's segments to 48 copy-number channels ``copies:state:size``."""
    if caller not in CALLERS:
        raise ValueError(f"unknown caller {caller!r}")
    sample, _, start, end, total, minor = CALLERS[caller]
    add = lambda e: sum((F.col(f"`{c}`").cast("double") for c in e.split("+")[1:]), F.col(f"`{e.split('+')[0]}`").cast("double"))
    t, m, mb = F.round(add(total)), F.round(add(minor)), (add(end) - add(start)) / 1e6
    copies = F.when(t == 0, "0").when(t == 1, "1").when(t == 2, "2").when(t <= 4, "3-4").when(t <= 8, "5-8").otherwise("9+")
    state = F.when(t == 0, "homdel").when((m == 0) | (t == 1), "LOH").otherwise("het")
    small = size_bin(mb, [(0.1, "0-100kb"), (1, "100kb-1Mb")], ">1Mb")
    large = size_bin(mb, [(0.1, "0-100kb"), (1, "100kb-1Mb"), (10, "1Mb-10Mb"), (40, "10Mb-40Mb")], ">40Mb")
    return count_events(df.where(t.isNotNull() & mb.isNotNull()), F.concat_ws(":", copies, state, F.when(t == 0, small).otherwise(large)), F.col(f"`{sample}`"))


def channel_order(spark: SparkSession, context: str) -> DataFrame:
    """(channel, channel_idx): the channels of a context in order."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(H.channel_names(context))], "channel string, channel_idx int")


def cnv_order(spark: SparkSession) -> DataFrame:
    return channel_order(spark, "CNV48")


def cnv_classes(spark: SparkSession) -> DataFrame:
    """(class, channel): the 48 names ``del|neut|dup|quad|amp:state:interval in Mb`` and the channels they stand for."""
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in {"0": "del", "1": "del", "2": "neut", "3-4": "dup", "5-8": "quad", "9+": "amp"}.items() for x in kv)), F.split("channel", ":")[0])
    mb = F.element_at(F.create_map(*(F.lit(x) for kv in {"0-100kb": "(-0.01,0.1]", "100kb-1Mb": "(0.1,1]", "1Mb-10Mb": "(1,10]", "10Mb-40Mb": "(10,40]", ">40Mb": "(40,Inf]", ">1Mb": "(1,Inf]"}.items() for x in kv)), F.split("channel", ":")[2])
    return cnv_order(spark).select(F.concat_ws(":", kind, F.split("channel", ":")[1], mb).alias("class"), "channel")


def sbs96_order(spark: SparkSession) -> DataFrame:
    return channel_order(spark, "SBS96")


def read_inputs(spark: SparkSession, input_type: str, data, context_type: str = "default", flanks: DataFrame | None = None, parts: DataFrame | None = None, ranges: DataFrame | None = None) -> dict[str, DataFrame]:
    """The catalogues of an input by context; variants give several, as ``variant_contexts`` says, other inputs one."""
    if input_type.lower() == "vcf":
        return variant_contexts(read_variants(spark, data), context_type, flanks, parts, ranges)
    return {"": read_input(spark, input_type, data)}


def read_input(spark: SparkSession, input_type: str, data) -> DataFrame:
    """The long catalogue of any supported input; a bad type raises before any job runs.

    ``csv`` takes one path or a list of them. Breakpoints and segments have all
    channels of their context. Variants give their six classes of substitutions, and all contexts by ``read_inputs``.
    """
    kind = input_type.lower()
    if kind in ("text", "table", "matrix"):
        if isinstance(data, DataFrame):
            return to_long(data)
        return read_matrix(spark, data) if isinstance(data, str) else to_long(spark.createDataFrame(data))
    if kind == "csv":
        return read_csv_folder(spark, data) if isinstance(data, list) else read_csv_matrix(spark, data)
    if kind == "matobj":
        return read_matlab(spark, data)
    if kind == "vcf":
        return substitutions(read_variants(spark, data))
    tsv = lambda: spark.read.option("sep", "\t").option("header", True).csv(data)
    if kind == "bedpe":
        return H.complete(structural(tsv().withColumns({c: F.col(c).cast("long") for c in ("start1", "start2")})), "SV32")
    if kind.startswith("seg:"):
        return H.complete(segments(tsv(), input_type[4:].upper()), "CNV48")
    raise ValueError(f"unknown input type {input_type!r}; use text, table, matrix, csv, matobj, vcf, bedpe or seg:CALLER")


def read_solutions(spark: SparkSession, path: str, context: str | None = None, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Signatures and activities written by ``sinks``; the partition columns prune the files read."""
    out = []
    for name in ("signatures", "activities"):
        df = spark.read.parquet(f"{path}/{name}")
        for col, v in (("context", context), ("k", k)):
            df = df if v is None else df.where(F.col(col) == v)
        out.append(df)
    return tuple(out)
