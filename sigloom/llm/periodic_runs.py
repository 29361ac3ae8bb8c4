"""Periodic runs of words: stretches that repeat themselves with some period.

Every lag of a text is scanned: its word numbers are held against themselves
shifted by the lag, for a block of lags at a time as one matrix, and stretches
of equal places long enough for that lag are runs. A stretch whose smallest
period divides the lag is found at both lags with the same ends, so the least
lag of each (start, length) is its period. Short texts are scanned where they
are read; of a long one, ranges of lags go to different tasks, so that no task
has more than a bounded share of a quadratic scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialise

#: Texts of more bytes are scanned by lag ranges in several tasks.
LONG_BYTES = 1 << 16
#: Comparisons of one lag range; a text of n words has at least n * SHARE, so that what its ranges carry stays small.
WORK, SHARE = 400_000_000, 4000
#: Cells of one block of lags.
CELLS = 1 << 21

RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "period", "length")])
RESULT = T.StructType([T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])
_RUNS = pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "period", "length")]))


def number(words: list[bytes]) -> np.ndarray:
    """Words -> integers that are equal where the words are."""
    table: dict[bytes, int] = {}
    return np.fromiter((table.setdefault(w, len(table)) for w in words), np.int32, len(words))


def stretches(ids: np.ndarray, first: int, last: int, least: int, exponent: int) -> np.ndarray:
    """Rows (start, length, lag) of the longest stretches that keep a lag of ``first`` to ``last``; of equal ones the least lag."""
    n, found = len(ids), []
    last = min(last, n // exponent)
    if n < least or last < first:
        return np.zeros((0, 3), np.int64)
    padded = np.concatenate([ids, np.full(last, -1, ids.dtype)])
    shifted = np.lib.stride_tricks.sliding_window_view(padded, n)
    step = max(1, CELLS // n)
    for low in range(first, last + 1, step):
        lags = np.arange(low, min(low + step, last + 1))
        need = np.maximum(exponent * lags, least) - lags
        same = shifted[lags[0] : lags[-1] + 1] == ids
        seen, width, goal = same, 1, min(int(need.min()), 8)
        while width < goal:
            move = min(width, goal - width)
            seen, width = seen[:, :-move] & seen[:, move:], width + move
        rows = np.flatnonzero(seen.any(1))
        if not len(rows):
            continue
        flat = np.zeros(len(rows) * n + 1, np.int8)
        flat[1:] = same[rows].ravel()  # a row ends unequal, so no stretch goes on into the next
        edges = np.flatnonzero(np.diff(flat))
        start, length = edges[::2], edges[1::2] - edges[::2]
        row = start // n
        fits = length >= need[rows][row]
        lag = lags[rows][row][fits]
        found.append(np.stack([start[fits] - row[fits] * n, length[fits] + lag, lag], 1))
    if not found:
        return np.zeros((0, 3), np.int64)
    every = np.concatenate(found)
    every = every[np.lexsort(every.T[::-1])]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    return every[new]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run (start, period, length) holds after its first period, joined by spaces."""
    if not len(runs):
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 1], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 2], -1)
    kept = np.cumsum(cover[:-1]) == 0
    return b" ".join(w for w, k in zip(words, kept, strict=True) if k)


def _words(column: pa.Array) -> list[list[bytes]]:
    """``bytes.split`` parts words at the six ASCII white spaces 0x20 and 0x09 to 0x0D."""
    return [(v or b"").split() for v in column.cast(pa.binary()).to_pylist()]


def _with(batch: pa.RecordBatch, runs: list[np.ndarray], texts: list[bytes]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
    flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
    structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUNS.value_type))
    made = [pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(texts, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "runs", "collapsed"])


def _by_start(rows: np.ndarray) -> np.ndarray:
    rows = rows[:, [0, 2, 1]]
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def _scan_texts(text_at: int, least: int, exponent: int):
    def run(batches):
        for batch in batches:
            runs, texts = [], []
            for words in _words(batch.column(text_at)):
                rows = _by_start(stretches(number(words), 1, len(words), least, exponent))
                runs.append(rows)
                texts.append(collapse(words, rows))
            yield _with(batch, runs, texts)

    return run


def _number_texts(batches):
    for batch in batches:
        ids = [number(w) for w in _words(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["at", "n", "ids"])


def _scan_ranges(least: int, exponent: int):
    def run(batches):
        for batch in batches:
            for at, ids, first, last in zip(*(batch.column(c).to_pylist() for c in ("at", "ids", "first", "last")), strict=True):
                rows = stretches(np.frombuffer(ids, np.int32), first, last, least, exponent)
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(rows), pa.int64()), *(pa.array(rows[:, i]) for i in range(3))], ["at", "start", "length", "period"])

    return run


def _collapse_texts(text_at: int, runs_at: int):
    def run(batches):
        for batch in batches:
            known = [np.array([(r["start"], r["period"], r["length"]) for r in v or []], np.int64).reshape(-1, 3) for v in batch.column(runs_at).to_pylist()]
            texts = [collapse(w, r) for w, r in zip(_words(batch.column(text_at)), known, strict=True)]
            yield _with(batch.select([i for i in range(batch.num_columns) if i != runs_at]), known, texts)

    return run


def periodic_runs(docs: DataFrame, least: int = 12, exponent: int = 2, text_col: str = "text", long_bytes: int = LONG_BYTES) -> DataFrame:
    """The rows of ``docs`` with ``runs`` and ``collapsed``.

    A run of smallest period q is a stretch of at least ``max(least, exponent *
    q)`` words in which words q apart are equal and which cannot be extended.
    ``runs`` lists (start, period, length) in words by start, then period;
    ``collapsed`` joins the words that no run holds after its first q by one
    space. Words are what white space (0x20, 0x09 to 0x0D) parts, compared byte
    by byte. A null or empty text has no words, no runs and the collapsed text
    '' ; repeated rows and null ids are rows like others; no rows give no rows.
    A column of ``docs`` named like a result is left out. ``exponent`` is an
    integer of at least 2, as a smaller period then divides a larger one.
    """
    if exponent < 2:
        raise ValueError("exponent must be at least 2")
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns if c not in RESULT.names)).alias("row"), F.col(text_col).cast("string").alias("text"))
    long = F.octet_length("text") > long_bytes
    short = rows.where(~F.coalesce(long, F.lit(False)))
    direct = short.mapInArrow(_scan_texts(1, least, exponent), T.StructType([*short.schema.fields, *RESULT.fields]))
    held = materialise(rows.where(long).withColumn("at", F.monotonically_increasing_id()), "long")
    numbered = materialise(held.select("at", "text").mapInArrow(_number_texts, "at long, n long, ids binary"), "numbered")
    lags = F.expr(f"n div {exponent}")
    share = F.greatest(F.lit(1), F.greatest(F.lit(WORK), F.col("n") * SHARE).cast("long") / F.greatest(F.col("n"), F.lit(1))).cast("long")
    ranged = numbered.withColumn("lags", lags).withColumn("share", share).where("lags > 0")
    ranged = ranged.select("at", "ids", "share", "lags", F.explode(F.expr("sequence(1L, lags, share)")).alias("first"))
    ranged = ranged.select("at", "ids", "first", F.least(F.col("first") + F.col("share") - 1, F.col("lags")).alias("last"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = ranged.repartition(parts, "at", "first").mapInArrow(_scan_ranges(least, exponent), "at long, start long, length long, period long")
    least_lag = found.groupBy("at", "start", "length").agg(F.min("period").alias("period"))
    runs = least_lag.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    joined = held.join(runs, "at", "left").select("row", "text", "runs")
    apart = joined.mapInArrow(_collapse_texts(1, 2), T.StructType([*short.schema.fields, *RESULT.fields]))
    out = direct.unionByName(apart)
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in RESULT.names), "runs", "collapsed")
