"""Channel names of the known contexts, and sums of finer contexts to coarser ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"
#: References of doublets in the order of their names, and the alternatives that palindromes have; a palindrome's other alternatives read the same on the other strand.
DOUBLETS = ["AC", "AT", "CC", "CG", "CT", "GC", "TA", "TC", "TG", "TT"]
PALINDROMES = {
    "AT": ["CA", "CC", "CG", "GA", "GC", "TA"],
    "CG": ["AT", "GC", "GT", "TA", "TC", "TT"],
    "GC": ["AA", "AG", "AT", "CA", "CG", "TA"],
    "TA": ["AT", "CG", "CT", "GC", "GG", "GT"],
}
#: The strand classes of a context, T(ranscribed), U(ntranscribed), N(either), B(oth); and the bases on each side.
STRANDS = {"SBS96": "", "SBS288": "TUN", "SBS384": "TUNB", "SBS1536": "", "SBS4608": "TUN"}
WIDTHS = {"SBS96": 1, "SBS288": 1, "SBS384": 1, "SBS1536": 2, "SBS4608": 2}
CNV_SIZES = ["0-100kb", "100kb-1Mb", "1Mb-10Mb", "10Mb-40Mb", ">40Mb"]
SV_SIZES = ["1-10Kb", "10-100Kb", "100Kb-1Mb", "1Mb-10Mb", ">10Mb"]


def _substitutions(context: str) -> list[str]:
    sides = list(BASES) if WIDTHS[context] == 1 else [a + b for a in BASES for b in BASES]
    plain = [f"{x}[{r}>{a}]{y}" for r in "CT" for a in BASES if a != r for x in sides for y in sides]
    return [f"{s}:{c}" for s in STRANDS[context] for c in plain] or plain


def _doublets() -> list[str]:
    own = lambda r: PALINDROMES.get(r) or [a + b for a in BASES for b in BASES if a != r[0] and b != r[1]]
    return [f"{r}>{a}" for r in DOUBLETS for a in own(r)]


def _indels() -> list[str]:
    names = [f"1:{kind}:{base}:{n}" for kind in ("Del", "Ins") for base in "CT" for n in range(6)]
    names += [f"{size}:{kind}:R:{n}" for kind in ("Del", "Ins") for size in range(2, 6) for n in range(6)]
    return names + [f"{size}:Del:M:{n}" for size in range(2, 6) for n in range(1, size if size < 5 else 6)]


def _copy_numbers() -> list[str]:
    names = [f"0:homdel:{s}" for s in (*CNV_SIZES[:2], ">1Mb")]
    for state, copies in (("LOH", ["1", "2", "3-4", "5-8", "9+"]), ("het", ["2", "3-4", "5-8", "9+"])):
        names += [f"{c}:{state}:{s}" for c in copies for s in CNV_SIZES]
    return names


def _structural() -> list[str]:
    return [name for p in ("clustered", "non-clustered") for name in (*(f"{p}_{k}_{s}" for k in ("del", "tds", "inv") for s in SV_SIZES), f"{p}_trans")]


def channel_names(context: str) -> list[str]:
    """All channels of a context, in order."""
    if context in STRANDS:
        return _substitutions(context)
    makers = {"DBS78": _doublets, "ID83": _indels, "CNV48": _copy_numbers, "SV32": _structural}
    if context not in makers:
        raise ValueError(f"no channel names for {context!r}")
    return makers[context]()


def complete(catalog: DataFrame, context: str) -> DataFrame:
    """Every channel of the context for every sample of the catalogue, absent cells as 0; other channels go.

    Rows are the context's channels times samples, dealt by sample and channel.
    """
    names = F.array(*map(F.lit, channel_names(context)))
    cells = catalog.select("sample").distinct().select("sample", F.explode(names).alias("channel"))
    return cells.join(catalog, ["channel", "sample"], "left").select("channel", "sample", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def coarser(channel: Column, context: str, to: str) -> Column:
    """The channel of ``to`` that a channel of the finer ``context`` is part of."""
    if context == to:
        return channel
    if to not in STRANDS or context not in STRANDS or WIDTHS[to] > WIDTHS[context] or not set(STRANDS[to]) <= set(STRANDS[context]):
        raise ValueError(f"{context} cannot be collapsed to {to}")
    plain = F.regexp_replace(channel, "^[TUNB]:", "")
    if WIDTHS[to] < WIDTHS[context]:
        plain = F.substring(plain, 2, 7)
    if not STRANDS[to]:
        return plain
    strand = F.substring(channel, 1, 1)
    strand = F.when(strand.isin(list(STRANDS[to])), strand).otherwise(F.lit("N"))
    return F.concat(strand, F.lit(":"), plain)


def collapse(catalog: DataFrame, context: str, to: str = "SBS96", value: str = "cnt", by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Sums of a finer context's cells in the channels of a coarser one; ``by``: the other keys, as ``signature`` for weights.

    B, which contexts of three strand classes lack, counts as N there.
    """
    cells = catalog.withColumn("channel", coarser(F.col("channel"), context, to))
    return cells.groupBy(*by, "channel").agg(F.sum(value).alias(value))
