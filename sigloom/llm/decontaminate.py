"""Benchmark decontamination by a generalised suffix automaton.

The words of all test items of a block form one automaton; each document's
words are streamed through it, which yields at every word the longest match
with any item. A match of at least the window's length marks the last window's
words; the state tells which items hold that window.

Blocks are bounded in bytes, so the automaton and its broadcast are bounded
too; a larger benchmark makes further passes over the documents. Spans of all
blocks are united before any is cut, so the blocks do not show in the result.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialise, small_batches
from .text import ALNUM, Words, chunks

#: Text bytes of the items of one automaton.
BLOCK_BYTES = 4 << 20


class SuffixAutomaton:
    """Of word sequences. ``items[s]``: the sequences that hold the strings of state s."""

    def __init__(self, sequences: list[np.ndarray], window: int):
        self.window = window
        self.alphabet = np.unique(np.concatenate([np.zeros(0, np.uint64), *sequences]))
        coded = [np.searchsorted(self.alphabet, s).tolist() for s in sequences]
        self.next, self.link, self.length = [{}], [-1], [0]
        for s in coded:
            last = 0
            for c in s:
                last = self._extend(last, c)
        self.items: list[list[int]] = [[] for _ in self.next]
        #: whole items shorter than the window, as (length, item), by the state that holds them
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, s in enumerate(coded):
            state = 0
            for c in s:
                state = up = self.next[state][c]
                while up > 0 and (not self.items[up] or self.items[up][-1] != k):
                    self.items[up].append(k)
                    up = self.link[up]
            if 0 < len(s) < window:
                while self.length[self.link[state]] >= len(s):
                    state = self.link[state]
                self.short[state].append((len(s), k))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in order:
            self.short[s] = self.short[s] + self.short[self.link[s]]
        #: the suffix state whose strings include the one of the window's length
        self.at_window = list(range(len(self.next)))
        for s in order:
            if self.length[self.link[s]] >= window:
                self.at_window[s] = self.at_window[self.link[s]]
        pairs = np.array(sorted({a * len(self.alphabet) + b for s in coded for a, b in itertools.pairwise(s)}), np.int64)
        self.pairs = pairs
        self.least = min([window, *(len(s) for s in coded if s)])

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        cur = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def _state(self, length: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def stretches(self, words: Words) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Coded words, and the runs in which every two neighbours occur in some item, if long enough to hold a window.

        Elsewhere no match is longer than one word, so the stream starts anew there.
        """
        n = len(words.hash)
        if not n or not len(self.alphabet):
            return np.zeros(n, np.int64), []
        code = np.minimum(np.searchsorted(self.alphabet, words.hash), len(self.alphabet) - 1)
        known = self.alphabet[code] == words.hash
        joined = np.zeros(n + 1, bool)  # joined[i]: word i continues the run of word i - 1
        if n > 1 and len(self.pairs):
            both = np.flatnonzero(known[:-1] & known[1:])
            pair = code[both] * len(self.alphabet) + code[both + 1]
            found = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
            joined[both[found] + 1] = True
            joined[words.ptr[:-1]] = False
        begins = np.flatnonzero(known & ~joined[:-1])
        ends = np.flatnonzero(known & ~joined[1:]) + 1
        long = ends - begins >= self.least
        return code, list(zip(begins[long].tolist(), ends[long].tolist(), strict=True))

    def stream(self, codes: list[int]):
        """Yields (start, end, items) in word positions for each window that ends at a word."""
        state = length = 0
        for i, c in enumerate(codes):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            if length >= self.window:
                yield i + 1 - self.window, i + 1, self.items[self.at_window[state]]
            for m, k in self.short[state]:
                if m <= length:
                    yield i + 1 - m, i + 1, (k,)


def matches(automaton: SuffixAutomaton, words: Words) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
    """By document of a chunk: word ranges hit, counted from the document's first word, and the items."""
    code, runs = automaton.stretches(words)
    found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
    for a, b in runs:
        doc = int(np.searchsorted(words.ptr, a, "right")) - 1
        shift = a - int(words.ptr[doc])
        for s, e, items in automaton.stream(code[a:b].tolist()):
            ranges, ids = found.setdefault(doc, ([], set()))
            if ranges and s + shift <= ranges[-1][1] and s + shift >= ranges[-1][0]:
                ranges[-1] = (ranges[-1][0], max(ranges[-1][1], e + shift))
            else:
                ranges.append((s + shift, e + shift))
            ids.update(items)
    return found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


_built: dict = {}


def _automaton(block, window: int) -> SuffixAutomaton:
    """Built once in each Python worker; a broadcast's list is the same object in all its tasks."""
    value = block.value
    if _built.get("of") is not value or _built["window"] != window:
        _built.update(of=value, window=window, automaton=SuffixAutomaton([np.frombuffer(s, np.uint64) for _, s in value], window))
    return _built["automaton"]


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """Lists of (id or None, word hashes), each of at most BLOCK_BYTES of text or one item."""
    block, size = [], 0
    for row in items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        if block and size + len(row.t) * 4 > BLOCK_BYTES:
            yield block
            block, size = [], 0
        for _, _, words in chunks(pa.array([row.t]), ALNUM):
            block.append((row.i, words.hash.tobytes()))
        size += len(row.t) * 4
    yield block


def _scan(block, window: int):
    """Adds the block's word ranges and items to ``hits`` and ``found``."""

    def run(batches):
        automaton = _automaton(block, window)
        names = [i for i, _ in block.value]
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            hits, found, n_words = col["hits"].to_pylist(), col["found"].to_pylist(), np.zeros(batch.num_rows, np.int64)
            for a, b, words in chunks(col["text"], ALNUM):
                n_words[a:b] = np.diff(words.ptr)
                for doc, (ranges, ids) in matches(automaton, words).items():
                    before = list(zip(hits[a + doc][::2], hits[a + doc][1::2], strict=True))
                    hits[a + doc] = [x for r in merged(before + ranges) for x in r]
                    found[a + doc] = sorted({*found[a + doc], *(names[k] for k in ids if names[k] is not None)})
            new = {"hits": pa.array(hits, pa.list_(pa.int64())), "found": pa.array(found, pa.list_(pa.string())), "n_words": pa.array(n_words)}
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in col.items()], list(col))

    return run


def scan(docs: DataFrame, items: DataFrame, window: int, item_id: str, item_text: str) -> DataFrame:
    """``docs`` (with a column ``text``) and n_words, hits (word ranges as start, end, ...), found (item ids)."""
    spark = docs.sparkSession
    small_batches(spark)
    empty = lambda kind: F.array().cast(kind)
    df = docs.withColumns({"n_words": F.lit(0).cast("long"), "hits": empty("array<long>"), "found": empty("array<string>")})
    blocks = _blocks(items, item_id, item_text)
    block = next(blocks)
    while block is not None:
        df = df.mapInArrow(_scan(spark.sparkContext.broadcast(block), window), T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]))
        block = next(blocks, None)
        if block is not None:
            df = materialise(df, "scanned")
    return df


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of ``docs``.

    A window is ``window`` consecutive words of an item, or a whole item of
    fewer but not none. Null, empty and wordless texts have no words and no
    hits; an item of null text is none, one of null id marks words but is not
    listed; repeated ids are listed once. Other columns are not read.
    """
    df = scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), items, window, item_id, item_text)
    n_hit = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda t, x: t + x)
    digest = F.sha2(F.array_join(F.array_sort("found"), ",").cast("binary"), 256)
    return df.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("found").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _without(text: str, words: Words, doc: int, cut: list[tuple[int, int]]) -> str:
    """``text``, document ``doc`` of the chunk, without the word ranges."""
    raw, w0, at = text.encode(), int(words.ptr[doc]), int(words.doc_start[doc])
    out, last = [], 0
    for s, e in cut:
        out.append(raw[last : words.start[w0 + s] - at])
        last = int(words.end[w0 + e - 1]) - at
    return b"".join([*out, raw[last:]]).decode()


def _lengths(batch: pa.RecordBatch, name: str, texts: list, changed) -> pa.Array:
    old = batch.column(batch.schema.names.index(name)).to_pylist()
    return pa.array([len(t) if c else o for t, c, o in zip(texts, changed, old, strict=True)], batch.schema.field(name).type)


def _clean(block, window: int, min_span: int, max_coverage: float, text_col: str):
    """All rounds of one block that holds every item."""

    def run(batches):
        automaton = _automaton(block, window)
        for batch in batches:
            names = batch.schema.names
            texts, keep = batch.column(names.index(text_col)).to_pylist(), np.ones(batch.num_rows, bool)
            todo, total, gone = range(batch.num_rows), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            first = True
            while len(todo):  # again where a cut has joined words into a new window
                some, again = pa.array([texts[i] for i in todo], pa.string()), []
                for a, b, words in chunks(some, ALNUM):
                    if first:
                        total[a:b] = np.diff(words.ptr)
                    for doc, (ranges, _) in matches(automaton, words).items():
                        cut = [(s, e) for s, e in merged(ranges) if e - s >= min_span]
                        if not cut:
                            continue
                        i = todo[a + doc]
                        gone[i] += sum(e - s for s, e in cut)
                        texts[i] = _without(texts[i], words, doc, cut)
                        keep[i] = gone[i] <= max_coverage * total[i]
                        if keep[i]:
                            again.append(i)
                todo, first = again, False
            new = {text_col: pa.array(texts, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = _lengths(batch, "n_chars", texts, gone > 0)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(names)], names).filter(pa.array(keep))

    return run


def _cut(min_span: int, max_coverage: float, n_chars: str | None):
    """Cuts the ``hits`` of one round; ``again`` marks the rows cut. Rows of which too much went are left out."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            col = {n: batch.column(i) for i, n in enumerate(names)}
            texts, hits, total, gone = (col[n].to_pylist() for n in ("text", "hits", "total", "gone"))
            again, keep = np.zeros(batch.num_rows, bool), np.ones(batch.num_rows, bool)
            for a, b, words in chunks(col["text"], ALNUM):
                for i in range(a, b):
                    cut = [(s, e) for s, e in zip(hits[i][::2], hits[i][1::2], strict=True) if e - s >= min_span]
                    if cut:
                        gone[i] += sum(e - s for s, e in cut)
                        texts[i] = _without(texts[i], words, i - a, cut)
                        again[i], keep[i] = True, gone[i] <= max_coverage * total[i]
            new = {"text": pa.array(texts, pa.string()), "gone": pa.array(gone, pa.int64()), "again": pa.array(again)}
            if n_chars:
                new[n_chars] = _lengths(batch, n_chars, texts, again)
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in col.items()], names).filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, min_span: int = 1, max_coverage: float = 0.5, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the marked spans of at least ``min_span`` words, and without documents of which more than ``max_coverage`` of the words went.

    Cuts repeat until no such span is left; every round unites the spans of all
    items first. Items of one block take one pass. Where there are more, each
    round scans what the last one cut with all blocks anew. A column n_chars,
    where there is one, follows a changed text. Texts without a span, null ones
    included, stay as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = _blocks(items, item_id, item_text)
    block = next(blocks)
    if next(blocks, None) is None:
        return docs.mapInArrow(_clean(spark.sparkContext.broadcast(block), window, min_span, max_coverage, text_col), T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
    names = ["text" if c == text_col else f"c{i}" for i, c in enumerate(docs.columns)]
    n_chars = names[docs.columns.index("n_chars")] if "n_chars" in docs.columns else None
    told = items.select(F.lit(None).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    todo, done = docs.toDF(*names).withColumns({"total": F.lit(None).cast("long"), "gone": F.lit(0).cast("long")}), []
    while True:
        marked = scan(todo, told, window, "item_id", "text").withColumns({"total": F.coalesce("total", "n_words"), "again": F.lit(False)}).drop("n_words", "found")
        df = materialise(marked.mapInArrow(_cut(min_span, max_coverage, n_chars), T.StructType([T.StructField(f.name, f.dataType) for f in marked.schema])), "cleaned")
        done.append(df.where("not again").select(names))
        todo = df.where("again").drop("again", "hits")
        if todo.isEmpty():
            return functools.reduce(DataFrame.union, done).toDF(*docs.columns)
