"""Hard negatives by an inverted multi-index.

Each half of a vector has a codebook of its own; the two codes of a vector name its cell.  For an anchor, a half's code bounds
what that half can add to a score, by its centre's product and its radius.  A heap visits cells by the sum of the two
bounds, best first, until the next bound shows that no row that is left can enter a result.

Anchors, the query set, meet all rows in blocks: rows are packed into chunks of neighbouring cells, and one task
holds a chunk and a block of anchors, whatever there is of both.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepframe.session import materialize

#: Codes of a half, rows that the codebooks are fitted on (all rows are indexed), and turns of fitting.
CODES, SAMPLE, TURNS = 16, 4096, 8
#: Rows in a chunk and anchors in a block; they bound what a task holds and change no result.
CHUNK, BLOCK = 65_536, 16_384
#: Rows that are scored at a time, from as many cells as it takes.
SCORED = 512

_PACKED = "chunk long, bits int, ids binary, known binary, labels binary, anchors binary, cells binary, vectors binary"


def codebook(sample: np.ndarray, codes: int = CODES, turns: int = TURNS) -> np.ndarray:
    """Centres by Lloyd's method from rows that are spread over the sample."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = sample[np.linspace(0, len(sample) - 1, min(codes, len(sample))).astype(int)].astype(float)
    for _ in range(turns):
        near = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(1) - 2 * (rows @ centres.T)).argmin(1)


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones with zeros behind."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy()
    return out


class Index:
    """The rows of a chunk by cell."""

    def __init__(self, packed: dict, books: tuple[np.ndarray, np.ndarray]):
        self.books, self.half = books, books[0].shape[1]
        width = self.half + books[1].shape[1]
        self.ids = np.frombuffer(packed["ids"], np.int64)
        self.known = np.frombuffer(packed["known"], bool)
        self.labels = np.frombuffer(packed["labels"], np.int64)
        self.rows = (packed["chunk"] << 20) + np.arange(len(self.ids))
        self.vectors = np.frombuffer(packed["vectors"], f"i{packed['bits'] // 8}").reshape(len(self.ids), width).astype(np.int64)
        cells = np.frombuffer(packed["cells"], np.int32)
        n2 = len(books[1])
        self.starts = np.searchsorted(cells, np.arange(len(books[0]) * n2 + 1))
        self.radii = []
        for book, codes, part in zip(books, (cells // n2, cells % n2), (self.vectors[:, :self.half], self.vectors[:, self.half:])):
            radius = np.full(len(book), -np.inf)
            np.maximum.at(radius, codes, np.sqrt(((part - book[codes]) ** 2).sum(1)))
            self.radii.append(radius)
        self.largest = int(np.abs(self.vectors).max(initial=0))
        self.floats = self.vectors.astype(float) if self.largest < 1 << 52 else None

    def visits(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(the most that a row from here on can score, numbers of the next rows), best cells first."""
        order, bounds = [], []
        for book, radius, part in zip(self.books, self.radii, (q[:self.half].astype(float), q[self.half:].astype(float))):
            norm = np.sqrt((part ** 2).sum())
            held = np.flatnonzero(radius >= 0)
            # Radii and products are rounded; the margin is far above that.
            bound = book[held] @ part + norm * radius[held] + 1e-9 * norm * (radius[held] + np.sqrt((book[held] ** 2).sum(1))) + 1e-6
            best = np.argsort(-bound, kind="stable")
            order.append(held[best].tolist())
            bounds.append(bound[best].tolist())
        (first, second), (up, vp), n2 = order, bounds, len(self.books[1])
        if not first:
            return
        heap, seen, top, taken, size = [(-(up[0] + vp[0]), 0, 0)], {(0, 0)}, None, [], 0
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = first[i] * n2 + second[j]
            a, b = self.starts[cell], self.starts[cell + 1]
            if b > a:
                top = -bound if top is None else top
                taken.append(np.arange(a, b))
                size += b - a
                if size >= SCORED:
                    yield top, np.concatenate(taken)
                    top, taken, size = None, [], 0
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(first) and y < len(second) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(up[x] + vp[y]), x, y))
        if taken:
            yield top, np.concatenate(taken)

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        most = self.largest * int(np.abs(q).max(initial=0)) * len(q)
        if self.floats is not None and most < 1 << 52:
            return (self.floats[at] @ q.astype(float)).astype(np.int64)
        return self.vectors[at] @ q if most < 1 << 62 else self.vectors[at].astype(object) @ q.astype(object)

    def best(self, scores: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The highest scores and their rows, smaller ids before larger ones and those before none."""
        if len(at) > 4 * most and scores.dtype != object:
            enough = scores >= np.partition(scores, -most)[-most]
            scores, at = scores[enough], at[enough]
        order = np.lexsort((self.ids[at], ~self.known[at], -scores))[:most]
        return scores[order], at[order]

    def positives(self, q: np.ndarray, label: int, row: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and rows of the first ``most`` other rows of the label."""
        scores, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for bound, rows in self.visits(q):
            if len(at) == most and scores[-1] > bound:
                break
            rows = rows[(self.labels[rows] == label) & (self.rows[rows] != row)]
            scores, at = self.best(np.concatenate([scores, self.scores(rows, q)]), np.concatenate([at, rows]), most)
        return scores, at

    def negatives(self, q: np.ndarray, label: int, windows: list[tuple[int, int]], most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores (both ends included) the first rows of other labels that are in it."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        open_ = {i for i, (low, high) in enumerate(windows) if low <= high}
        for bound, rows in self.visits(q):
            open_ = {i for i in open_ if bound >= windows[i][0] and not (len(found[i][0]) == most and found[i][0][-1] > bound)}
            if not open_:
                break
            rows = rows[self.labels[rows] != label]
            scores = self.scores(rows, q)
            for i in open_:
                inside = (scores >= windows[i][0]) & (scores <= windows[i][1])
                if inside.any():
                    found[i] = self.best(np.concatenate([found[i][0], scores[inside]]), np.concatenate([found[i][1], rows[inside]]), most)
        return found


def _chunks(rows: DataFrame, books: tuple[np.ndarray, np.ndarray], n: int) -> DataFrame:
    """All rows, packed by cell; a cell of many equal vectors takes as many chunks as it needs."""
    half, width = books[0].shape[1], books[0].shape[1] + books[1].shape[1]

    def coded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = _matrix(batch.column(3), width).astype(float)
            cell = nearest(x[:, :half], books[0]) * len(books[1]) + nearest(x[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["id", "label", "anchor", "vector", "cell"])

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for i, batch in enumerate(_regrouped(it, CHUNK)):
            cells = batch.column("cell").to_numpy()
            order = np.argsort(cells, kind="stable")
            take = lambda c: batch.column(c).combine_chunks().take(pa.array(order))
            ids, x = take("id"), _matrix(take("vector"), width)
            least = next(b for b in (16, 32, 64) if int(np.abs(x).max(initial=0)) < 1 << (b - 1) or b == 64)
            yield pa.RecordBatch.from_pylist([{
                "chunk": number + i, "bits": least, "ids": ids.fill_null(0).to_numpy().tobytes(),
                "known": ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), "labels": take("label").to_numpy().tobytes(),
                "anchors": take("anchor").to_numpy(zero_copy_only=False).tobytes(), "cells": cells[order].astype(np.int32).tobytes(),
                "vectors": x.astype(f"i{least // 8}").tobytes()}], schema=_SCHEMA)

    by_cell = rows.mapInArrow(coded, "id long, label long, anchor boolean, vector array<long>, cell int")
    return by_cell.repartitionByRange(n, "cell", F.xxhash64("id", "vector")).mapInArrow(packed, _PACKED)


_SCHEMA = pa.schema([("chunk", pa.int64()), ("bits", pa.int32()), *((n, pa.binary()) for n in ("ids", "known", "labels", "anchors", "cells", "vectors"))])


def _regrouped(it: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in it:
        while len(batch):
            part = batch.slice(0, most - n)
            held.append(part)
            n, batch = n + len(part), batch.slice(len(part))
            if n == most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _anchors(chunks: DataFrame, books: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed in chain.from_iterable(b.to_pylist() for b in it):
            index = Index(packed, books)
            at = np.flatnonzero(np.frombuffer(packed["anchors"], bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(index.rows[at], pa.int64()), pa.array(index.ids[at], pa.int64(), mask=~index.known[at]), pa.array(index.labels[at], pa.int64()),
                 pa.array([index.vectors[i].tobytes() for i in at], pa.binary())], names=["row", "anchor_id", "label", "vector"])

    return chunks.mapInArrow(batches, "row long, anchor_id long, label long, vector binary")


def _met(chunks: DataFrame, anchors: DataFrame, groups: int, blocks: int, answer, schema: str) -> DataFrame:
    """``answer(index, anchor)`` for all chunks and anchors, a chunk and a block of anchors in a task."""
    left = chunks.withColumn("g", F.pmod(F.xxhash64("chunk"), F.lit(groups))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    right = anchors.withColumn("s", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    names = [c.split()[0] for c in schema.split(", ")]

    def meet(packed: pa.Table, asked: pa.Table) -> pa.Table:
        out, asked = [], asked.to_pylist()
        for one in packed.to_pylist():
            index = answer.index(one)
            for anchor in asked:
                out += answer(index, anchor)
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * len(names))], names=names)

    return left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(meet, schema)


class _Answer:
    def __init__(self, books, use):
        self.books, self.use = books, use

    def index(self, packed: dict) -> Index:
        return Index(packed, self.books)

    def __call__(self, index: Index, anchor: dict) -> list[tuple]:
        return [(anchor["row"], part, int(index.ids[i]) if index.known[i] else None, int(s))
                for part, (scores, at) in enumerate(self.use(index, np.frombuffer(anchor["vector"], np.int64), anchor)) for s, i in zip(scores, at)]


_FOUND = "row long, part long, id long, score long"


def _first(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("row", "part").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Needs ``vec_id``, ``label`` and ``vector``, an array of whole numbers; other columns are not read.  ``anchor`` says which
    rows are anchors.  Scores are inner products of whole vectors, exact; higher ones come first, ties by smaller id, a null id
    last.  The positives of an anchor are its first other rows of the same label, the negatives of a positive the first
    rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's, both included; fewer where there are fewer.  Rows without a label or vector, or with a
    null in it, take no part.  A shorter vector counts as filled up with zeros, an empty one scores 0.  Rows of one id are rows of their
    own.  A score beyond 64 bits is an error.  An empty table gives no rows.
    """
    rows = rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())).select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("vector").cast("array<long>").alias("vector"))
    size = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("asked"), F.max(F.size("vector")).alias("width")).first()
    width = max(2, size["width"] or 0)
    sample = rows.select("vector").orderBy(F.xxhash64("id", "vector")).limit(SAMPLE).toArrow()
    sample = _matrix(sample.column(0).combine_chunks(), width).astype(float)
    books = codebook(sample[:, :width // 2]), codebook(sample[:, width // 2:])
    groups, blocks = -(-size["n"] // CHUNK) or 1, -(-size["asked"] // BLOCK) or 1
    chunks = materialize(_chunks(rows, books, groups), "chunks")
    anchors = materialize(_anchors(chunks, books), "anchors")
    near = _Answer(books, lambda index, q, a: [index.positives(q, a["label"], a["row"], positives)])
    found = materialize(_first(_met(chunks, anchors, groups, blocks, near, _FOUND), positives), "positives")
    asked = anchors.join(found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("positives")), "row")
    windows = lambda a: [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in a["positives"]]
    hard = _Answer(books, lambda index, q, a: index.negatives(q, a["label"], windows(a), negatives))
    best = _first(_met(chunks, asked.select("row", "label", "vector", "positives"), groups, blocks, hard, _FOUND), negatives)
    part = F.posexplode("positives").alias("part_", "positive")
    given = asked.select(F.col("row").alias("row_"), "anchor_id", part)
    return best.join(given, (F.col("row") == F.col("row_")) & (F.col("part") == F.col("part_"))).select(
        "anchor_id", F.col("positive.id").alias("positive_id"), F.col("place").alias("rank"), F.col("id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
