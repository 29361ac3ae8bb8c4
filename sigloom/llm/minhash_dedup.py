"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming search.

A signature is ``SYMBOLS`` minima of 16 bits. It is split into ``CHUNKS`` chunks.
If two signatures differ in at most ``2 * CHUNKS - 1`` symbols, some chunk
differs in at most one symbol (pigeonhole), so for every chunk each way of
leaving out one symbol becomes a key: two signatures within that distance
always share a key. Documents of equal shingle sets are one class first.

Links are confirmed on whole shingle sets. Only links that matter for the
components are tried: first the members of each undisturbed chunk are held
against the chunk's lowest member, then, over all keys, members of different
components against each other. So a group of n near copies costs about n
confirmations, while every pair that shares a key and would join two components
is confirmed or refuted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import FEW, components
from .storage import materialise, prune_by_bloom, small_batches
from .text import SPACED, chunks, mix, shingles

SYMBOLS, CHUNKS = 84, 12
#: Signatures are compared before whole sets are, by two bits of each of MINIMA minima: at a similarity of 0.8
#: 25.6 of the 256 bits differ in the mean, with a deviation of 5.8.
MINIMA, BITS_APART = 128, 52
BITS = ["b0", "b1", "b2", "b3"]
#: The parity of a set's shingles in each of CELLS cells. Two sets' parities differ in no more cells than the sets do in
#: shingles, so this bound loses no link; it is sharp for short texts, where the bits above are vague.
CELLS = 1024
PARITIES = [f"q{i}" for i in range(CELLS // 64)]
SKETCH = [*BITS, *PARITIES]
_U = np.uint64
_rng = np.random.default_rng(71)
_A = _rng.integers(0, 2**63, MINIMA, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_B = _rng.integers(0, 2**63, MINIMA, dtype=np.int64).astype(_U)
_SPLIT = np.array_split(np.arange(SYMBOLS), CHUNKS)


def signatures(sets: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """16-bit MinHash symbols, documents x MINIMA; rows of empty sets are 0."""
    full = np.flatnonzero(np.diff(ptr))
    out = np.zeros((len(ptr) - 1, MINIMA), np.uint16)
    if len(full):
        for k in range(MINIMA):
            out[full, k] = mix(np.minimum.reduceat(sets * _A[k] + _B[k], ptr[full])) & _U(0xFFFF)
    return out


def parities(sets: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Parities of the shingles in each cell, documents x CELLS / 64 words of 64 bits."""
    m = len(ptr) - 1
    cell = (mix(sets + _U(0x632BE59BD9B4E019)) % _U(CELLS)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(m), np.diff(ptr)) * CELLS + cell, minlength=m * CELLS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(m, CELLS), 1).view(np.int64)


def _describe(k: int):
    def run(batches):
        for batch in batches:
            for a, b, words in chunks(batch.column(1), SPACED):
                sets, ptr = shingles(words, k)
                n = np.diff(ptr)
                full = np.flatnonzero(n)
                h = np.zeros((2, b - a), _U)
                if len(full):
                    h[0, full] = np.add.reduceat(mix(sets + _U(1)), ptr[full])
                    h[1, full] = np.add.reduceat(mix(sets ^ _U(0x2545F4914F6CDD1D)), ptr[full])
                sig = signatures(sets, ptr)
                bits = np.packbits(np.concatenate([sig & 1, (sig >> 1) & 1], 1).astype(np.uint8), 1).view(np.int64)
                sketch = np.concatenate([bits, parities(sets, ptr)], 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)),
                     *(pa.array(sketch[:, c]) for c in range(len(SKETCH))), pa.array([r.tobytes() for r in sig[:, :SYMBOLS]], pa.binary())],
                    ["doc_id", "n", "h1", "h2", *SKETCH, "sig"])
    return run


def _keys(disturbed: bool):
    """(key, id, comp, left_out, lead) from (id, comp, sig): a key for each chunk, or for each chunk and symbol left out.

    Equal chunks meet under each of their keys; lead marks the one that counts for them.
    """

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(m, SYMBOLS).astype(_U)
            keys, left_out, lead = [], [], []
            for c, where in enumerate(_SPLIT):
                for out in where if disturbed else [-1]:
                    h = np.full(m, c * SYMBOLS + int(out) + 1, _U)
                    for p in where[where != out]:
                        h = mix(h + sig[:, p] * _U(0x9E3779B97F4A7C15))
                    keys.append(h)
                    left_out.append(sig[:, out].astype(np.int32) if out >= 0 else np.zeros(m, np.int32))
                    lead.append(np.full(m, out < 0 or out == where[0]))
            take = pa.array(np.tile(np.arange(m), len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(left_out)), pa.array(np.concatenate(lead))], ["key", "id", "comp", "left_out", "lead"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for a, b, words in chunks(batch.column(1), SPACED):
                sets, ptr = shingles(words, k)
                n = np.diff(ptr)
                full = np.flatnonzero(n)
                h = np.zeros(b - a, _U)
                if len(full):
                    h[full] = np.add.reduceat(mix(sets + _U(1)), ptr[full])
                lists = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(h.view(np.int64)), lists], ["id", "h1", "words"])
    return run


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` with a1 and b1, as far as the sizes and the sketches allow; this precedes the whole sets."""
    side = lambda v: classes.select(F.col("id").alias(v), *(F.col(c).alias(f"{v}_{c}") for c in ("n", "h1", *SKETCH)))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_similar(percent)).select("a", F.col("a_h1").alias("a1"), "b", F.col("b_h1").alias("b1"))


def _similar(percent: int):
    """Whether sizes and sketches let a pair reach the similarity: at most (100 - p) / (100 + p) of both sizes' sum may differ."""
    apart = lambda names: sum((F.bit_count(F.col(f"a_{b}").bitwiseXOR(F.col(f"b_{b}"))) for b in names), F.lit(0))
    sizes = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    return sizes & (apart(BITS) <= BITS_APART) & ((100 + percent) * apart(PARITIES) <= (100 - percent) * (F.col("a_n") + F.col("b_n")))


def _confirm(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of ``pairs(a, a1, b, b1)`` those whose whole sets are similar enough; only their documents' texts are moved.

    Few pairs, by a count of them, go to the texts and sets instead of being dealt with them.
    """
    pairs = materialise(pairs.distinct(), "pairs")
    few = pairs.count() <= FEW
    held = (lambda df: F.broadcast(df.coalesce(1))) if few else (lambda df: df)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).where("doc_id is not null")
    ids = held(ends.coalesce(1).distinct()) if few else materialise(ends.distinct(), "ids")
    texts = docs.join(ids, "doc_id", "left_semi")
    sets = materialise(texts.mapInArrow(_sets(shingle), "id long, h1 long, words array<long>").dropDuplicates(["id", "h1"]), "sets")
    sa = sets.select(F.col("id").alias("a"), F.col("h1").alias("a1"), F.col("words").alias("wa"))
    sb = sets.select(F.col("id").alias("b"), F.col("h1").alias("b1"), F.col("words").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    all_ = F.size("wa") + F.size("wb") - both
    first = sa.join(held(pairs), ["a", "a1"]) if few else pairs.join(sa, ["a", "a1"])
    return materialise(first.join(sb, ["b", "b1"]).where(100 * both >= percent * all_).select("a", "b"), "links")


def _shared_ids(told: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) between classes that have an id in common."""
    often = told.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("doc_id")
    of = told.join(often, "doc_id").join(classes.select("h1", "h2", "n", "id"), ["h1", "h2", "n"]).select("doc_id", "id").distinct()
    first = of.groupBy("doc_id").agg(F.min("id").alias("b"))
    return materialise(of.join(first, "doc_id").where("id <> b").select(F.col("id").alias("a"), "b").distinct(), "shared")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, pairs_per_row: int = 100) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): one row per row of ``docs``.

    Documents with ``100 * intersection >= percent * union`` of their distinct
    ``shingle``-word sets are linked; component_id is the smallest id reachable.
    Null, empty and wordless texts have no set and are linked with nothing;
    rows that share an id are one vertex, of one component and one fate; a row of null id is
    never kept; ids are integers.
    Of ``docs`` only the two columns are read, so other columns may have any name.
    ``pairs_per_row``: rounds that hold the members of each key against one of
    its lowest component precede the last, exhaustive one while more pairs than this for each class remain
    and a round still links a hundredth of the documents in question.
    """
    spark = docs.sparkSession
    small_batches(spark)
    prune_by_bloom(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    told = materialise(docs.mapInArrow(_describe(shingle), f"doc_id long, n long, h1 long, h2 long, {', '.join(f'{c} long' for c in SKETCH)}, sig binary"), "signatures")
    classes = materialise(told.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"), *(F.first(b).alias(b) for b in SKETCH), F.first("sig").alias("sig")), "classes")
    n_classes = classes.count()
    keyed = "key long, id long, comp long, left_out int, lead boolean"
    bands = classes.select("id", F.col("id").alias("comp"), "sig").mapInArrow(_keys(False), keyed)
    pivots = bands.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("b")).where("c > 1")
    star = bands.join(pivots, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    links = _confirm(_near(star, classes, percent), docs, shingle, percent).union(_shared_ids(told, classes))
    comps = materialise(components(links), "components")
    cross, turn, last, gaining = None, 0, False, True
    while not last:
        turn += 1
        label = comps.withColumnRenamed("comp", "c")
        if cross is None:
            named = classes.join(label, "id", "left").select("id", F.coalesce("c", "id").alias("comp"), "sig").mapInArrow(_keys(True), keyed)
            mixed = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
            cross = materialise(named.join(mixed, "key", "left_semi"), "cross")
        else:
            cross = materialise(cross.drop("comp").join(label, "id", "left").select("key", "id", F.coalesce("c", "id").alias("comp"), "left_out", "lead"), "cross")
        #: of each key: the pairs of different components it holds, and a member of its lowest component, another one each turn
        parts = cross.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min_by("id", F.xxhash64("id", "key", F.lit(turn))).alias("member"))
        parts = parts.groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"), F.min("comp").alias("low"), F.min_by("member", "comp").alias("b"))
        parts = materialise(parts.where("s * s > q"), "keys")
        left = parts.select(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0
        if not left:
            break
        last = left <= pairs_per_row * n_classes or not gaining
        if last:
            side = lambda v: cross.join(classes.select("id", "n", "h1", *SKETCH), "id").select("key", "lead", F.col("left_out").alias(f"{v}_out"), F.col("id").alias(v), F.col("comp").alias(f"{v}_comp"), *(F.col(c).alias(f"{v}_{c}") for c in ("n", "h1", *SKETCH)))
            once = F.col("lead") | (F.col("a_out") != F.col("b_out"))
            pairs = side("a").join(side("b"), ["key", "lead"]).where((F.col("a_comp") < F.col("b_comp")) & once & _similar(percent)).select("a", F.col("a_h1").alias("a1"), "b", F.col("b_h1").alias("b1"))
        else:
            pairs = _near(cross.join(parts, "key").where("comp <> low").select(F.col("id").alias("a"), "b").distinct(), classes, percent)
        found = _confirm(pairs, docs, shingle, percent)
        n_found = found.count()
        gaining = n_found > 0.01 * cross.select("id").distinct().count()
        if n_found:
            links = links.union(found)
            comps = materialise(components(links), "components")
    ids = classes.select("h1", "h2", "n", "id").join(comps, "id", "left").select("h1", "h2", "n", F.coalesce("comp", "id").alias("comp"))
    out = told.select("doc_id", "n", "h1", "h2").join(ids, ["h1", "h2", "n"], "left")
    component = F.coalesce("comp", "doc_id")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
