"""License scans, in DataFrame operations only.

A document's shingles are cut into overlapping windows, twice as wide as some
class of templates. Windows that hold no shingle of any template cannot match and
are left out. The others get MinHash values; bands of one value each bring
together windows and templates, so a window of Jaccard similarity s to a
template is retrieved with probability ``1 - (1 - s) ** HASHES``. A window has
fewer than four times the template's n shingles. One that holds the least share
wanted, 0.8 n of them, is thus of a similarity above ``0.8 / 4.2``, so it is
retrieved with a probability above 0.998; one that holds the whole template with
0.9998. Most places lie in several windows. Containment of the template's
shingles in the window is then checked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

SHINGLE, HASHES, CONTAINED = 5, 32, 0.8
#: Cells of the table of template shingles.
_BITS = 1 << 16

#: Names and notices of public licences.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _words(text: Column) -> Column:
    plain = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.filter(F.split(F.coalesce(plain, F.lit("")), " "), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hashes of each SHINGLE words in order; a shorter text is one shingle, one of no words has none."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.xxhash64(*(F.element_at(words, i + j) for j in range(SHINGLE))))
    return F.when(n >= SHINGLE, each).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(F.array().cast("array<bigint>"))


def _minhash(shingles: Column) -> Column:
    seeded = lambda k: lambda x: F.xxhash64(x, F.lit(k))
    return F.array(*(F.array_min(F.transform(shingles, seeded(k))) for k in range(HASHES)))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED) -> DataFrame:
    """id_col, license, containment, first_word: a row per document and template found in it.

    A template is found where a window holds at least ``contained`` of its
    distinct 5-word shingles; no templates find nothing; containment is that of the best window, first_word
    the first word of the earliest best window. Null, empty and wordless texts,
    and templates without words, are in no row. Repeated rows of a document
    count once; rows of null id are reported under null.
    """
    spark = docs.sparkSession
    empty = docs.select(F.col(id_col), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word")).where("false")
    texts = [(k, v) for k, v in (TEMPLATES if templates is None else templates).items() if v]
    if not texts:
        return empty
    told = materialise(spark.createDataFrame(texts, "license string, text string").select("license", _words(F.col("text")).alias("w")), "words").where("size(w) > 0")
    told = materialise(told.select("license", F.array_distinct(_shingles(F.col("w"))).alias("t")), "templates")
    lengths = [r[0] for r in told.select(F.size("t")).distinct().collect()]
    if not lengths:
        return empty
    #: by length class (powers of two): windows twice as long that start at each half class hold every such template whole
    classes = sorted({1 << (n - 1).bit_length() for n in lengths})
    known = [r[0] for r in told.select(F.explode("t")).distinct().toLocalIterator()]
    bits = [0] * (_BITS // 64)
    for h in known:
        bits[h % _BITS // 64] |= 1 << (h % 64)
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    table = literal(b - (1 << 64) if b >> 63 else b for b in bits)
    cell = lambda h: F.element_at(F.col("bits"), (F.shiftrightunsigned(h.bitwiseAND(F.lit(_BITS - 1)), 6) + 1).cast("int"))
    has = lambda h: (F.bit_get(cell(h), h.bitwiseAND(F.lit(63)).cast("int")) == 1) & F.array_contains("known", h)
    #: The row number in each step keeps Spark from pushing later conditions, and with them copies of the costly columns, below it.
    number = F.monotonically_increasing_id()
    base = docs.select(F.struct(F.col(id_col).alias("v"), number.alias("r")).alias("id"), _words(F.col(text_col)).alias("w"))
    base = base.select(F.struct("id.v", "id.r", number.alias("q")).alias("id"), _shingles(F.col("w")).alias("sh"), table.alias("bits"), literal(known).alias("known"))
    hits = F.filter(F.transform("sh", lambda h, i: F.when(has(h), i)), lambda i: i.isNotNull())
    found = base.select(F.struct("id.v", "id.r", "id.q", number.alias("p")).alias("id"), "sh", hits.alias("at")).where(F.size("at") > 0)
    starts = lambda c: F.array_distinct(F.flatten(F.transform("at", lambda i: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.greatest(F.lit(0), (F.floor(i / max(1, c // 2)) - k) * max(1, c // 2))))))
    window = lambda c: lambda s: F.struct(s.cast("int").alias("start"), F.lit(2 * c).alias("width"))
    windows = F.flatten(F.array(*(F.transform(starts(c), window(c)) for c in classes)))
    cut = found.select("id", "sh", F.explode(windows).alias("win")).select("id", "win.start", "win.width", F.array_distinct(F.slice("sh", F.col("win.start") + 1, F.col("win.width"))).alias("s")).where("size(s) > 0")
    bands = lambda df: df.select("*", F.posexplode(_minhash(F.col("s"))).alias("band", "value"))
    side = bands(told.select("license", F.col("t").alias("s"))).select("license", F.col("s").alias("t"), "band", "value")
    met = bands(cut).join(side, ["band", "value"]).select("id", "license", "start", (F.size(F.array_intersect("s", "t")) / F.size("t")).alias("c")).where(F.col("c") >= contained)
    best = met.groupBy("id", "license").agg(F.max(F.struct("c", -F.col("start"))).alias("m")).groupBy("id.v", "license").agg(F.max("m").alias("m"))
    return best.select(F.col("v").alias(id_col), "license", F.round("m.c", 6).alias("containment"), (-F.col("m")["col2"]).cast("long").alias("first_word"))
