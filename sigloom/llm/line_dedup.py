"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is the set of its distinct words. Words are ordered by rarity, counted
over all lines in a fixed number of hash cells, so the order is one and the same
everywhere. What two sets do not share breaks few of the pairs of words that
follow each other in that order, so two sets of the wanted Jaccard similarity
share such a pair among the rarest of each (prefix filter). Few other lines share
one. Sizes (length filter), places (positional filter) and the parities of all
words bound the overlap before whole sets are compared. Equal sets are one class.

A line goes if any earlier line is similar enough. Lines are first held against
the earliest line of each of their keys and the few lines before them in it, in
small keys against all of them, and only those that stay against all earlier
ones, so that a group of near copies does not meet in all pairs: who has no
similar line among many is rare in it, or stands early. A pair that the first
round leaves out is tried in the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import forget, materialise, prune_by_bloom, settings

CELLS = 1 << 16
JACCARD = 0.8
#: Keys are dealt in so many passes, each over its share of them, so that one pass's shuffle is bounded.
PASSES = 3
#: Lines of more words carry 64 parities of half of the words as well.
LONG = 72
#: The first round holds a line against so many lines before it in a key, and the earliest one.
NEXT = 3
#: Keys of so many lines, or fewer, are done in the first round: a line there is held against all before it.
SMALL = 10
#: Between words, besides spaces.
_GAPS = "".join(chr(c) for c in (*range(0x20), *range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(line: Column) -> Column:
    """Words in order, folded A-Z only; "" may stand anywhere. A look-up by character takes two thirds of the time of lower() and a regular expression."""
    return F.split(F.translate(line, _GAPS + _UPPER, " " * len(_GAPS) + _LOWER), " ")


def _lines(docs: DataFrame) -> DataFrame:
    """(d, l, line) of every line; ``docs`` has columns d and text."""
    return docs.select("d", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("l", "line"))


def _tokens(lines: DataFrame) -> DataFrame:
    """(d, l, t) of lines: t holds the hashes of the distinct words."""
    hashes = F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))
    return lines.select("d", "l", F.array_remove(hashes, F.xxhash64(F.lit(""))).alias("t"))


def _cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit(CELLS - 1)).cast("int")


def _rarity(tokens: DataFrame) -> Column:
    """By cell: four times the logarithm of its count; a literal of fixed size and of small numbers, which the JVM keeps once."""
    cells = tokens.select(F.explode("t").alias("h")).groupBy(_cell(F.col("h")).alias("c")).count()
    count = {r.c: r["count"] for r in cells.select("c", F.least(F.lit(120), F.floor(4 * F.log2(F.col("count")))).alias("count")).collect()}
    return F.split(F.lit(",".join(str(count.get(i, 0)) for i in range(CELLS))), ",").cast("array<bigint>")


def _sets(tokens: DataFrame, rarity: Column) -> DataFrame:
    """(d, l, t, s): s holds the words as numbers, rarest first."""
    #: Not null by its type, which lets Spark sort plain numbers.
    word = lambda h: F.coalesce(F.shiftleft(F.get(rarity, _cell(h)), 56).bitwiseOR(F.shiftrightunsigned(h, 8)), F.lit(0).cast("long"))
    return tokens.select("d", "l", "t", F.sort_array(F.transform("t", word)).alias("s"))


def _place(lines: DataFrame) -> Column:
    """(d, l) as one number in the same order, from 0: a long where all of ``lines`` fit, else a decimal."""
    low, high, last = lines.agg(F.min("d"), F.max("d"), F.max("l")).first()
    if low is None:
        return F.col("d")
    if (high - low + 1) * (last + 1) < 1 << 63:
        return (F.col("d") - F.lit(low)) * F.lit(last + 1).cast("long") + F.col("l")
    d = F.col("d").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
    return (d * F.lit(last + 1).cast("decimal(11,0)") + F.col("l")).cast("decimal(38,0)")


def _width(jaccard: float) -> int:
    """Words of a key: two where similar lines are sure to share a pair of neighbours."""
    return 2 if jaccard >= 0.7 else 1


def _overlap(both: Column, jaccard: float) -> Column:
    """Keys that two similar sets of ``both`` words in all share at least. A word of one set alone takes two of its pairs away, one of the other set one."""
    words = F.ceil(F.lit(jaccard / (1 + jaccard)) * both - 1e-9)
    return words if _width(jaccard) == 1 else 3 * words - both - 1


def _prefix(n: Column, jaccard: float) -> Column:
    """How many of the rarest keys of a set must be looked at, whatever set is similar to it: the least one shares the least keys."""
    share = jaccard / (1 + jaccard)
    both = n + F.ceil(F.lit(jaccard) * n - 1e-9)
    least = F.ceil(F.lit(share) * both - 1e-9) if _width(jaccard) == 1 else F.ceil(F.lit(3 * share - 1) * both - 1 - 1e-9)
    return (n - (_width(jaccard) - 1) - least + 1).cast("int")


def _alike(a: str, b: str, jaccard: float) -> Column:
    """Whether sizes, the parities of words and the places i (from 0) of a shared key, if it is their first one, let two
    lines be similar enough; the test that most pairs fail comes first."""
    both = F.col(f"{a}n") + F.col(f"{b}n")
    most = F.lit((1 - jaccard) / (1 + jaccard)) * both + 1e-9
    sizes = F.least(f"{a}n", f"{b}n") >= F.lit(jaccard) * F.greatest(f"{a}n", f"{b}n") - 1e-9
    x0, x1 = (F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}")) for x in ("x0", "x1"))
    halves = (F.least(f"{a}n", f"{b}n") <= LONG) | (F.bit_count(x1) + F.bit_count(x0.bitwiseXOR(x1)) <= most)
    rest = F.least(F.col(f"{a}n") - F.col(f"{a}i"), F.col(f"{b}n") - F.col(f"{b}i")) - (_width(jaccard) - 1)
    return (F.bit_count(x0) <= most) & sizes & (rest >= _overlap(both, jaccard)) & halves


def _confirm(pairs: DataFrame, tokens: DataFrame, jaccard: float) -> DataFrame:
    """The later lines k of ``pairs(k, bk)`` that are similar. Whole sets ``tokens(k, t)`` move for the pairs' lines only."""
    ends = materialise(pairs.select("k").union(pairs.select("bk")).distinct(), "ends")
    #: A comparison, so that Spark builds its Bloom filter; places begin at 0.
    wanted = ends.where("k >= 0")
    with settings(tokens.sparkSession, {"spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}):
        sets = materialise(tokens.join(wanted, "k", "left_semi"), "sets")
    both = pairs.join(sets.withColumnRenamed("t", "s"), "k").join(sets.select(F.col("k").alias("bk"), "t"), "bk")
    shared = F.size(F.array_intersect("s", "t"))
    later = materialise(both.where(shared >= F.lit(jaccard) * (F.size("s") + F.size("t") - shared) - 1e-9).select("k").distinct(), "later")
    forget(ends, sets)
    return later


def _later(classes: DataFrame, tokens: DataFrame, jaccard: float) -> DataFrame:
    """(k) of the lines of ``classes(k, n, x0, x1, p)`` that an earlier one of them is similar to."""
    #: A set that has no place for one more or one less word is similar to itself alone.
    able = classes.where(F.col("n") >= F.lit(jaccard) * (F.col("n") + 1) - 1e-9)
    word = [F.get("p", F.col("i") + x) for x in range(_width(jaccard))]
    keys = able.select("k", "n", "x0", "x1", "p", F.posexplode("p").alias("i", "w")).where(F.col("i") <= F.size("p") - _width(jaccard))
    keys = keys.select("k", "n", "x0", "x1", "i", F.xxhash64(*word).alias("key"))
    order = Window.partitionBy("key").orderBy("k")
    whole, so_far = (order.rowsBetween(Window.unboundedPreceding, x) for x in (Window.unboundedFollowing, Window.currentRow))
    row = F.struct("k", "n", "x0", "x1", "i")
    met = None
    for j in range(PASSES):
        #: Most keys have one line; they go before anything else is done.
        some = keys.where(F.pmod("key", F.lit(PASSES)) == j).select("*", F.count(F.lit(1)).over(whole).alias("c")).where("c > 1")
        others = [F.first(row).over(so_far).alias("b0"), *(F.lag(row, x).over(order).alias(f"b{x}") for x in range(1, SMALL - 1))]
        some = some.select("*", F.row_number().over(order).alias("r"), *others).where("r > 1")
        alike = [F.when(_alike("", f"b{x}.", jaccard) & (F.lit(x <= NEXT) | (F.col("c") <= SMALL)), F.col(f"b{x}.k")) for x in range(SMALL - 1)]
        some = some.select("key", "k", "n", "x0", "x1", "i", "r", "c", F.array_compact(F.array(*alike)).alias("b"))
        some = materialise(some.where((F.col("c") > SMALL) | (F.size("b") > 0)), "met")
        met = some if met is None else met.union(some)
    pairs = materialise(met.select("k", F.explode("b").alias("bk")).distinct(), "pairs")
    gone = _confirm(pairs, tokens, jaccard)
    #: Lines found by now seek nothing more. A merge join at every size: what is moved grows with the table.
    many = met.where(F.col("c") > SMALL).drop("b", "c")
    seek = many.where(F.col("r") > NEXT + 2).join(gone.hint("merge"), "k", "left_anti")
    #: Two near copies share many keys; they meet at the first.
    own = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seek, many = (x.withColumn("keys", F.collect_list("key").over(own)) for x in (seek, many))
    once = F.get(F.array_intersect("a.keys", "b.keys"), F.lit(0)) == F.col("a.key")
    before = F.col("b.r") < F.col("a.r") - NEXT
    pairs = seek.alias("a").join(many.alias("b"), (F.col("a.key") == F.col("b.key")) & before & _alike("a.", "b.", jaccard) & once)
    pairs = materialise(pairs.select("a.k", F.col("b.k").alias("bk")).distinct(), "pairs")
    return gone.union(_confirm(pairs, tokens, jaccard))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", jaccard: float = JACCARD) -> DataFrame:
    """(id_col, line, removed): a row per line of each document, lines numbered from 0.

    A line is removed if a line before it, by (id, line), has a Jaccard
    similarity of at least ``jaccard`` to it on distinct words, folded A-Z. Lines
    without words, and so null and empty texts, are never removed. Ids are
    integers; null ids count as the lowest; rows that share an id are one
    document, of which equal lines at one place both stay and unlike ones go
    together. Other columns are not read.
    """
    prune_by_bloom(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), F.col(text_col).alias("text"))
    #: A word comes often: its number in a dictionary of one file is a third of its hash.
    often = {"parquet.dictionary.page.size": str(16 << 20)}
    tokens = materialise(_tokens(_lines(docs)), "tokens", often)
    place = _place(tokens).alias("k")
    n = F.size("s")
    #: Parities of the words in each of 64 cells: two sets' parities differ in no more cells than the sets in words.
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))
    parity = lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(bit(w)))
    half = F.when(n > LONG, parity(F.filter("s", lambda w: w.bitwiseAND(F.lit(64)) == 0))).otherwise(F.lit(0).cast("long"))
    rarest = F.slice("s", 1, F.greatest(F.lit(0), _prefix(n, jaccard) + (_width(jaccard) - 1)))
    prefix = F.transform(rarest, lambda w: w.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    told = _sets(tokens, _rarity(tokens)).select(
        "d", "l", n.alias("n"), F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(7), "s").alias("h2"), parity("s").alias("x0"), half.alias("x1"), prefix.alias("p")
    )
    told = materialise(told, "lines", often)
    #: All but the place follows from the set.
    classes = told.where("n > 0").groupBy("h1", "h2", "n", "x0", "x1", "p").agg(F.min(place).alias("k"))
    classes = materialise(classes, "classes", often)
    #: The result needs no more of a line than its place and its set's hashes.
    lines, told = told, materialise(told.select("d", "l", "h1", "h2"), "places")
    forget(lines)
    late = _later(classes, tokens.select(place, "t"), jaccard).select("k", F.lit(True).alias("late")).hint("merge")
    forget(tokens)
    fate = classes.select("h1", "h2", "k").join(late, "k", "left").select("h1", "h2", F.col("k").alias("first"), "late")
    out = told.select("d", "l", place, "h1", "h2").join(fate, ["h1", "h2"], "left")
    removed = F.coalesce(F.col("late"), F.lit(False)) | F.coalesce(F.col("k") != F.col("first"), F.lit(False))
    return out.select(F.when(F.col("d") != -(1 << 63), F.col("d")).alias(id_col), F.col("l").alias("line"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", jaccard: float = JACCARD) -> DataFrame:
    """``docs`` with the removed lines taken out of the texts; ids must be unique and not null; columns may have any names."""
    gone = repeated_lines(docs, id_col, text_col, jaccard).where("removed").groupBy(F.col(id_col).alias("key")).agg(F.collect_set("line").alias("gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("key"))
    text = F.col(f"row.`{text_col}`")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    joined = rows.join(gone, "key", "left").select("row", F.when(F.col("gone").isNull(), text).otherwise(left).alias("left"))
    return joined.select(*(F.col("left").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
