"""Token frequencies by batch: the compact form in which per-document counts meet a table of tokens.

A row holds one token of one batch of documents with the documents that hold it and how often: a
hundred million (document, token) pairs become a few million rows.  Documents are numbered by row,
so repeated ids stay apart; each batch has one row for the documents themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are cut into tokens at a time, and (document, token) pairs of a batch.  Both bound a
#: task's memory and change no result.
SLICE_CHARS, BATCH_PAIRS = 4_000_000, 4_000_000

#: Places of documents in a batch and counts fit short numbers; a larger count takes several pairs.
BITS = 15
MOST = (1 << BITS) - 1

FREQUENCIES = ("token string, base long, places array<smallint>, counts array<smallint>, marked long, "
               "documents array<struct<doc_id:long,mark:boolean,size:long>>")
_DOCUMENTS = pa.list_(pa.struct([("doc_id", pa.int64()), ("mark", pa.bool_()), ("size", pa.int64())]))


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``most`` in sum; a single large one stands alone."""
    part = np.cumsum(sizes) // max(1, most)
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


class _Batch:
    """Pairs of the documents since the last batch, each one number: token, place, count."""

    def __init__(self, base: int):
        self.base, self.numbers, self.parts, self.pairs = base, {}, [], 0
        self.ids, self.marks, self.sizes = [], [], []

    def add(self, tokens: list[list], ids: list, marks: list[bool], sizes: list[int]) -> None:
        first, counts = len(self.ids), np.array([len(t) for t in tokens], np.int64)
        self.ids += ids
        self.marks += marks
        self.sizes += sizes
        flat = pa.array([t for ts in tokens for t in ts])
        if not len(flat):
            return
        coded = flat.dictionary_encode()
        numbers = self.numbers
        own = np.array([numbers.setdefault(t, len(numbers)) for t in coded.dictionary.cast(pa.string()).to_pylist()], np.int64)
        keys = own[coded.indices.to_numpy()] << 32 | (np.repeat(np.arange(first, first + len(tokens)), counts) << BITS)
        keys, n = np.unique(keys, return_counts=True)
        if n.max() > MOST:
            times = -(-n // MOST)
            last = np.cumsum(times) - 1
            parts = np.full(int(times.sum()), MOST)
            parts[last] = n - (times - 1) * MOST
            keys, n = np.repeat(keys, times), parts
        self.parts.append(keys | n)
        self.pairs += len(n)

    def rows(self) -> Iterator[pa.RecordBatch]:
        documents = pa.StructArray.from_arrays([pa.array(self.ids, pa.int64()), pa.array(self.marks, pa.bool_()),
                                                pa.array(self.sizes, pa.int64())], fields=list(_DOCUMENTS.value_type))
        one, size = pa.array([0, len(self.ids)], pa.int32()), len(self.ids)
        # Its text stands for no token: tokens hold no blank behind another character.
        yield self._table(pa.array([f"documents from {self.base}"]), pa.ListArray.from_arrays(one, pa.array(np.arange(size, dtype=np.int16))),
                          pa.ListArray.from_arrays(one, pa.array(np.zeros(size, np.int16))), pa.array([0], pa.int64()),
                          pa.ListArray.from_arrays(one, documents))
        if not self.parts:
            return
        keys = np.concatenate(self.parts)
        self.parts = []
        keys.sort()
        names = list(self.numbers)
        edges = np.searchsorted(keys, np.arange(len(names) + 1) << 32)
        marks = np.array(self.marks)
        # By text, so that neighbours are alike and shuffle files smaller.
        order = pc.sort_indices(pa.array(names)).to_numpy()
        for a in range(0, len(names), 50_000):
            some = order[a:a + 50_000]
            sizes = edges[some + 1] - edges[some]
            starts = np.cumsum(sizes) - sizes
            pairs = keys[np.arange(int(sizes.sum())) + np.repeat(edges[some] - starts, sizes)] & 0xFFFFFFFF
            places, counts = (pairs >> BITS).astype(np.int16), (pairs & MOST).astype(np.int16)
            marked = np.add.reduceat(counts.astype(np.int64) * marks[places], starts)
            # Counts are left out where all are 1.
            told = np.maximum.reduceat(counts, starts) > 1
            yield self._table(pa.array([names[k] for k in some], pa.string()), _lists(sizes, places),
                              _lists(np.where(told, sizes, 0), counts[np.repeat(told, sizes)]), pa.array(marked),
                              pa.nulls(len(some), _DOCUMENTS))

    def _table(self, token, places, counts, marked, documents) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([token, pa.array([self.base] * len(token), pa.int64()), places, counts, marked, documents],
                                          names=["token", "base", "places", "counts", "marked", "documents"])


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


def token_frequencies(docs: DataFrame, split: Callable[[list[str]], list[list]], size: Callable[[str, int], int],
                      slice_chars: int = SLICE_CHARS, batch_pairs: int = BATCH_PAIRS) -> DataFrame:
    """Rows as in the module's text from rows (doc_id, text, mark).

    ``split`` gives the tokens of each text, as str or bytes; ``size(text, tokens)`` is kept with each
    document.  ``marked`` is how often the token stands in documents with a true mark.
    """
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = None
        for got in it:
            texts = ["" if t is None else t for t in got.column(2).to_pylist()]
            rows, ids, marks = (got.column(k).to_pylist() for k in (0, 1, 3))
            # An empty text counts too, so that no slice has more documents than a batch can number.
            for a, b in slices(np.array([len(t) + 1 + slice_chars // MOST for t in texts]), slice_chars):
                if batch and (batch.pairs >= batch_pairs or rows[b - 1] - batch.base >= 1 << BITS):
                    yield from batch.rows()
                    batch = None
                batch = batch or _Batch(rows[a])
                tokens = split(texts[a:b])
                batch.add(tokens, ids[a:b], marks[a:b], [size(t, len(n)) for t, n in zip(texts[a:b], tokens)])
        if batch:
            yield from batch.rows()

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text", "mark")
    return numbered.mapInArrow(batches, FREQUENCIES)


def document_sums(frequencies: DataFrame, **values: Column) -> DataFrame:
    """Per document (row, doc_id, mark, size) and, for each value, the sum of counts times the token's value.

    A value is an expression of the columns of ``frequencies``; null counts as 0.
    """
    names = list(values)
    pairs = frequencies.select("base", "counts", "documents", *[v.alias(n) for n, v in values.items()], F.posexplode("places").alias("at", "place"))
    count = F.coalesce(F.get("counts", F.col("at")), F.lit(1)).cast("long")
    each = pairs.select((F.col("base") + F.col("place")).alias("row"), F.get("documents", F.col("place")).alias("document"),
                        *[(count * F.coalesce(n, F.lit(0))).alias(n) for n in names])
    return each.groupBy("row").agg(*[F.max(f"document.{n}").alias(n) for n in ("doc_id", "mark", "size")],
                                   *[F.sum(n).alias(n) for n in names])
