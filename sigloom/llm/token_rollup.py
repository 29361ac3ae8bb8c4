"""Token counts as delta-maintained rollups.

A batch holds signed changes: a document's count under a tokenizer version with
+1 for an insert, -1 for a delete, and both for a revised count. Each batch is
summed to (source, lang, version) and written under its id by each attempt to a
directory of its own, complete once Spark's ``_SUCCESS`` marker is there. One
complete attempt of an id counts, so committing an id again changes nothing, a
half-written attempt is passed over, and two writers of one id at the same time
neither overwrite nor double what is read. Totals are the sum of the committed
batches, so late and repeated batches need no recount; a snapshot holds the sum
of the batches before it, so that reading need not go back to the first batch.
"""

from __future__ import annotations

import base64
import uuid
from functools import reduce
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import small_batches

#: Fixed value: the public split pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ["source", "lang", "version"]
_loaded: dict = {}


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """The token ranks of a ``.tiktoken`` file; the driver reads it, tasks get it by broadcast (fixed size)."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


def _encoder(ranks):
    if _loaded.get("of") is not ranks.value:
        import tiktoken

        _loaded.update(of=ranks.value, encoding=tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=dict(ranks.value), special_tokens={}))
    return _loaded["encoding"]


def _counter(ranks, text_at: int):
    def run(batches):
        encoding = _encoder(ranks)
        for batch in batches:
            texts = pc.fill_null(batch.column(text_at), "").to_pylist()
            n = [len(encoding.encode_ordinary(t)) for t in texts]
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(n, pa.int64())], [*names, "tokens"])

    return run


def count_tokens(docs: DataFrame, versions: dict[str, str | None], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, version, tokens: a row per document and tokenizer version.

    A version's value is the path of a ``.tiktoken`` file, or None for words
    between ASCII white space. Null texts have no tokens; null sources and
    languages stay null.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), "source", "lang", F.col(text_col).alias("text"))
    out = []
    for version, path in versions.items():
        if path is None:
            words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
            counted = base.select("doc_id", "source", "lang", words.alias("tokens"))
        else:
            shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
            kind = dict(base.dtypes)
            counted = base.mapInArrow(_counter(shared, 3), f"doc_id {kind['doc_id']}, source {kind['source']}, lang {kind['lang']}, tokens long")
        out.append(counted.select("doc_id", "source", "lang", F.lit(version).alias("version"), "tokens"))
    return reduce(DataFrame.unionByName, out)


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).alias("sign"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).alias("sign"), "tokens")


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """The old counts leave, the new ones come; the number of documents stays."""
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """Totals kept under ``path``, any file system that Spark writes to.

    A batch id names one set of changes: whoever commits it, and how often, it
    counts once. Nothing that was written is changed or deleted.
    """

    _TOTALS = "source string, lang string, version string, documents long, tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _listed(self, path: str) -> list[str]:
        """Names in a folder, in order; none where there is no folder."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _complete(self, path: str) -> bool:
        return "_SUCCESS" in self._listed(path)

    def _attempt(self, batch: str) -> str | None:
        """The folder of the attempt that counts: the first complete one by name."""
        home = f"{self.path}/batches/{quote(batch, safe='')}"
        return next((f"{home}/{x}" for x in self._listed(home) if self._complete(f"{home}/{x}")), None)

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return [b for b in map(unquote, self._listed(f"{self.path}/batches")) if self.committed(b)]

    def committed(self, batch: str) -> bool:
        return self._attempt(batch) is not None

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Whether the batch was new. ``changes(source, lang, version, sign, tokens)`` is summed before it is moved."""
        if self.committed(batch):
            return False
        summed = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        summed.write.parquet(f"{self.path}/batches/{quote(batch, safe='')}/{uuid.uuid4().hex}")
        return True

    def _read(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(self._TOTALS).parquet(*folders) if folders else self.spark.createDataFrame([], self._TOTALS)
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def _snapshot(self) -> tuple[list[str], set[str]]:
        """The folder of the snapshot over most batches, and their ids; none where none is complete."""
        homes = [f"{self.path}/snapshots/{x}" for x in self._listed(f"{self.path}/snapshots") if self._complete(f"{self.path}/snapshots/{x}/totals")]
        held = [({r.batch for r in self.spark.read.schema("batch string").parquet(f"{h}/batches").collect()}, h) for h in homes]
        covered, home = max(held, key=lambda x: (len(x[0]), x[1]), default=(set(), None))
        return ([f"{home}/totals"] if home else []), covered

    def _parts(self) -> tuple[list[str], set[str]]:
        """The folders whose sum is the total of all committed batches, and those batches' ids."""
        base, covered = self._snapshot()
        rest = [b for b in self.batches() if b not in covered]
        return base + [self._attempt(b) for b in rest], covered | set(rest)

    def compact(self) -> bool:
        """Write the sum of all batches committed so far as a snapshot; whether there was anything new to sum.

        The ids are written before the totals, whose marker completes the snapshot.
        """
        folders, ids = self._parts()
        if len(folders) < 2:
            return False
        home = f"{self.path}/snapshots/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(b,) for b in sorted(ids)], "batch string").coalesce(1).write.parquet(f"{home}/batches")
        self._read(folders).write.parquet(f"{home}/totals")
        return True

    def totals(self, batches: list[str] | None = None) -> DataFrame:
        """source, lang, version, documents, tokens over all committed batches, or those of the given ids; groups that fell to nothing go."""
        if batches is None:
            return self._read(self._parts()[0])
        return self._read([a for b in dict.fromkeys(batches) if (a := self._attempt(b))])
