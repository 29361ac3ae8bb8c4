"""Arrays of MATLAB files (level 5) as rows, and the catalogue that such a file of counts holds.

Files come through Spark's binary source, so they may lie in any store, and each is
read by the task that has it: the format bounds a file's arrays. Sizes in a file are
checked against what is there before they are used.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: numbers of the data types that hold numbers or text, and of the classes of arrays.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED = 14, 15
CELL, CHAR, NUMERIC = 1, 4, range(6, 16)
#: Cells of one batch of rows.
ROWS = 1 << 16

_CELLS = "path string, name string, row long, col long, value double, text string"


def _element(data: memoryview, at: int, order: str) -> tuple[int, memoryview, int]:
    """Type and bytes of the element at ``at``, and where the next one begins."""
    if at + 8 > len(data):
        raise ValueError("a MATLAB file ends within an element")
    kind, size = struct.unpack_from(f"{order}II", data, at)
    if kind >> 16:  # up to four bytes beside the tag
        kind, size, start, end = kind & 0xFFFF, kind >> 16, at + 4, at + 8
    else:
        start = at + 8
        end = start + size + (-size % 8 if kind != COMPRESSED else 0)
    if start + size > len(data):
        raise ValueError("an element of a MATLAB file is longer than the file")
    return kind, data[start : start + size], end


def _unpacked(raw: memoryview, order: str) -> memoryview:
    """A compressed element, no longer than its own tag says."""
    unpack = zlib.decompressobj()
    head = unpack.decompress(raw, 8)
    if len(head) < 8:
        raise ValueError("a compressed element of a MATLAB file is empty")
    size = struct.unpack(f"{order}II", head)[1]
    return memoryview(head + unpack.decompress(unpack.unconsumed_tail, max(1, size)))


def _numbers(kind: int, data: memoryview, order: str) -> np.ndarray:
    if kind not in TYPES:
        raise ValueError(f"type {kind} of a MATLAB file holds no numbers")
    return np.frombuffer(data, np.dtype(TYPES[kind]).newbyteorder(order))


def _matrix(data: memoryview, order: str):
    """(name, dims, class, content): numbers or characters in column order, or the matrices of a cell array."""
    kind, raw, at = _element(data, 0, order)
    flags = int(_numbers(kind, raw, order)[0])
    kind, raw, at = _element(data, at, order)
    dims = tuple(int(x) for x in _numbers(kind, raw, order))
    _, raw, at = _element(data, at, order)
    name, cls = bytes(raw).decode("ascii", "replace"), flags & 0xFF
    if flags & 0x0800:
        raise ValueError(f"{name!r}: complex arrays are not read")
    if cls == CELL:
        held = []
        while at < len(data):
            kind, raw, at = _element(data, at, order)
            held.append(_matrix(raw, order) if len(raw) else ("", (0, 0), NUMERIC[0], np.zeros(0)))
        return name, dims, cls, held
    if cls != CHAR and cls not in NUMERIC:
        return name, dims, cls, None
    kind, raw, _ = _element(data, at, order)
    return name, dims, cls, _numbers(kind, raw, order)


def arrays(content: bytes) -> Iterator[tuple]:
    """(name, dims, class, content) of every array of a file; arrays of other classes than numbers, text and cells have no content."""
    data = memoryview(content)
    if len(data) < 128 or bytes(data[126:128]) not in (b"IM", b"MI"):
        raise ValueError("not a MATLAB file of level 5")
    order, at = "<" if bytes(data[126:128]) == b"IM" else ">", 128
    while at < len(data):
        kind, raw, at = _element(data, at, order)
        if kind == COMPRESSED:
            kind, raw, _ = _element(_unpacked(raw, order), 0, order)
        if kind == MATRIX:
            yield _matrix(raw, order)


def _text(held: tuple) -> str | None:
    """The text of a cell, which may be the one cell of a cell."""
    _, _, cls, content = held
    if cls == CELL and content:
        return _text(content[0])
    return "".join(map(chr, content)) if cls == CHAR and content is not None else None


def _columns(path: str, name: str, dims: tuple, cls: int, content) -> Iterator[dict]:
    rows = max(1, dims[0])
    if cls == CHAR:  # a row of characters is a text
        lines = np.asarray(content).reshape(dims[0], -1, order="F")
        content, cls, rows = ["".join(map(chr, line)) for line in lines], CELL, max(1, len(lines))
    elif cls == CELL:
        content = [_text(x) for x in content]
    for a in range(0, len(content), ROWS):
        at = np.arange(a, min(a + ROWS, len(content)))
        part, n = content[a : a + ROWS], len(at)
        value, text = (part, [None] * n) if cls != CELL else (np.full(n, np.nan), part)
        yield {"path": [path] * n, "name": [name] * n, "row": at % rows, "col": at // rows, "value": np.asarray(value, np.float64), "text": pa.array(text, pa.string())}


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, row, col, value, text): every cell of every array, places from 0; numbers have no text, texts the value NaN."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for array in arrays(content):
                    if array[3] is not None:
                        for part in _columns(file, *array):
                            yield pa.RecordBatch.from_pydict(part)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _CELLS)


def read_matlab(spark: SparkSession, path: str) -> DataFrame:
    """(channel, sample, cnt) of files with ``originalGenomes`` (channels x samples), ``sampleNames``, ``types`` and ``subtypes``.

    The channel is ``X[R>A]Y`` of type ``R>A`` and subtype ``XRY``. Names may stand in a row or a column.
    """
    cells = read_arrays(spark, path)
    names = lambda name, alias: cells.where(F.col("name") == name).select("path", F.greatest("row", "col").alias(f"at_{alias}"), F.col("text").alias(alias))
    counts = cells.where("name = 'originalGenomes'").select("path", F.col("row").alias("at_type"), F.col("col").alias("at_sample"), F.col("value").alias("cnt"))
    kinds = names("types", "type").join(names("subtypes", "subtype").withColumnRenamed("at_subtype", "at_type"), ["path", "at_type"])
    channel = F.concat(F.substring("subtype", 1, 1), F.lit("["), "type", F.lit("]"), F.substring("subtype", 3, 1))
    joined = counts.join(kinds, ["path", "at_type"]).join(names("sampleNames", "sample"), ["path", "at_sample"])
    return joined.select(channel.alias("channel"), "sample", "cnt")
