"""Benchmark decontamination: every passage of the documents is a BM25 query against an index of test items.

The index is inverted, by term, with the largest impact of each term in each block of items.  An item's
common terms can't reach its threshold together, so only the others open it: a passage has to hold
enough of them.  A passage first sums its terms' block maxima, and reads the postings only of blocks whose
bound reaches the least need of their items; then the item's score decides.  Items above their threshold
are verified by the overlap of question and answer.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.session import Rounds, materialize

K1, B = 1.2, 0.75
#: Items in a block of the index, and items in an index that is sent to the executors at a time.
BLOCK, ITEMS = 64, 20_000
SHINGLE = 5
#: Share of an item's threshold that its most common terms may give without opening it.
COMMON = 0.6
TRIM = ".,;:!?\"'()[]{}<>*_"
ANSWER = re.compile(r"(?is)\banswer\s*:")
SLICE_CHARS = 4_000_000


def terms_of(texts: pa.Array) -> pa.ListArray:
    """Words between ASCII white space in lower case, without punctuation around them; empty ones stay as places."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    return pa.ListArray.from_arrays(split.offsets, pc.utf8_trim(split.values, TRIM))


def answered(question: str, marked: bool) -> bool:
    """Whether an item's answer has to be found too: it is marked, or the question is asked, short or empty.

    A passage that asks nothing is told by itself; its last sentence is no answer.
    """
    return marked or question.rstrip().endswith("?") or len(question.split()) < SHINGLE


def question_answer(text: str) -> tuple[str, str]:
    """The answer begins behind the last "answer:", else with the last sentence or line of several."""
    marks = list(ANSWER.finditer(text))
    if marks:
        return text[:marks[-1].start()], text[marks[-1].end():]
    ends = [m.end() for m in re.finditer(r"[.!?]+\s+|\n+", text.rstrip())]
    return (text[:ends[-1]], text[ends[-1]:]) if ends else (text, "")


@dataclass
class Index:
    """Items by number: ids, term numbers in order, where the answer begins, thresholds; impacts.

    ``opens`` has by term (from ``offsets``) the items that it opens and its impact there; ``need`` is what
    such impacts have to sum up to, the threshold without all that the other terms could give.  ``blocks`` has by
    term (from ``block_offsets``) the blocks with such items: number, largest impact, from and to in ``opens``.
    """

    ids: list[int]
    terms: list[str]
    words: list[np.ndarray]
    answers: list[int]
    asked: list[bool]
    impact: list[tuple[np.ndarray, np.ndarray]]  # by item: terms, impacts
    offsets: np.ndarray
    opens: tuple[np.ndarray, np.ndarray]
    block_offsets: np.ndarray
    blocks: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    block_need: np.ndarray                      # by block
    least: np.ndarray                           # by item
    need: np.ndarray
    pane: int
    block: int


def _parts(text: str) -> tuple[list[str], list[str], bool]:
    """Terms of question and answer, and whether the answer is required."""
    question, answer = question_answer(text)
    q, a = terms_of(pa.array([question, answer], pa.string())).to_pylist()
    return [w for w in q if w], [w for w in a if w], answered(question, bool(ANSWER.search(text)))


@dataclass
class Statistics:
    """Of all items, whatever the number of indexes: items, mean and largest length."""

    items: int
    mean: float
    longest: int


def build_index(items: list[tuple[int, str]], frequencies: dict[str, int], of_all: Statistics, share: float) -> Index | None:
    """``frequencies`` are the items that hold each term among all; ``share`` of an item's own score is its threshold."""
    rows = [(i, *_parts(t)) for i, t in items]
    rows = [r for r in rows if r[1] or r[2]]
    if not rows:
        return None
    terms = sorted({w for _, q, a, _ in rows for w in q + a})
    number = {w: k for k, w in enumerate(terms)}
    words = [np.array([number[w] for w in q + a]) for _, q, a, _ in rows]
    idf = np.array([math.log(1 + (of_all.items - frequencies[w] + 0.5) / (frequencies[w] + 0.5)) for w in terms])
    impact, opened = [], []
    least, need = np.zeros(len(rows)), np.zeros(len(rows))
    for at, ws in enumerate(words):
        own, n = np.unique(ws, return_counts=True)
        x = idf[own] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(ws) / of_all.mean))
        impact.append((own, x))
        # In the order of the words, so that sums are alike in every index.
        rising = np.argsort(x, kind="stable")
        common = int(np.searchsorted(np.cumsum(x[rising]), share * COMMON * x.sum()))
        least[at] = share * x.sum()
        need[at] = least[at] - x[rising[:common]].sum()
        opened += [(own[k], at, x[k]) for k in rising[common:]]
    opened.sort()
    term, item, most = (np.array(c) for c in zip(*opened))
    numbers = np.arange(len(terms) + 1)
    starts = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)))
    blocks = (item[starts] // BLOCK, np.maximum.reduceat(most, starts), starts, np.append(starts[1:], len(term)))
    return Index([i for i, *_ in rows], terms, words, [len(q) for _, q, _, _ in rows], [must for *_, must in rows], impact,
                 np.searchsorted(term, numbers), (item, most), np.searchsorted(term[starts], numbers), blocks,
                 np.minimum.reduceat(need, np.arange(0, len(rows), BLOCK)), least, need, of_all.longest, BLOCK)


def _shingles(words: np.ndarray) -> set:
    n = min(SHINGLE, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def _overlaps(index: Index, item: int, passage: np.ndarray) -> tuple[float, float]:
    """Shares of the question's and of the answer's shingles that stand in the passage.

    A part of fewer than five words is one shingle; an empty part counts as found.
    """
    def share(part: np.ndarray) -> float:
        want = _shingles(part)
        if not want:
            return 1.0
        n = len(next(iter(want)))
        have = {tuple(x) for x in np.lib.stride_tricks.sliding_window_view(passage, n)} if len(passage) >= n else set()
        return len(want & have) / len(want)

    words, cut = index.words[item], index.answers[item]
    return share(words[:cut]), share(words[cut:])


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(keys, return_inverse=True)
    return own, np.bincount(at, weights=values, minlength=len(own))


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from ``first`` up to ``last`` of each pair, and the number of the pair that each is of."""
    n = last - first
    pair = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) + np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n), pair


def candidates(index: Index, ids: np.ndarray, panes: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """(pane, items) whose opening terms in this pane and the next one may be enough, from term numbers and their panes.

    Blocks first: the maxima of a passage's terms bound the sums of all items of a block, and the postings
    of a block that can't reach the need of any of its items are not read.
    """
    opens = np.flatnonzero((ids >= 0) & (np.diff(index.offsets)[ids] > 0))
    seen = np.unique(panes[opens] * len(index.terms) + ids[opens])
    pane, term = np.divmod(seen, len(index.terms))
    at, of = _spread(index.block_offsets[term], index.block_offsets[term + 1])
    pane, many = pane[of], len(index.block_need)
    keys = pane * many + index.blocks[0][at]
    # A passage is its own pane and the one behind: a pane's terms count for it and for the pane before.
    bound, sums = _sums(np.concatenate([keys, keys - many]), np.tile(index.blocks[1][at], 2))
    good = bound[sums >= index.block_need[bound % many] - 1e-9]
    reads = np.isin(keys, good) | np.isin(keys - many, good)
    at, pane = at[reads], pane[reads]
    at, of = _spread(index.blocks[2][at], index.blocks[3][at])
    size = len(index.least)
    keys = pane[of] * size + index.opens[0][at]
    keys, sums = _sums(np.concatenate([keys, keys - size]), np.tile(index.opens[1][at], 2))
    pane, item = np.divmod(keys, size)
    good = sums >= index.need[item] - 1e-9
    pane, item = pane[good], item[good]
    edges = np.flatnonzero(np.append(True, pane[1:] != pane[:-1])) if len(pane) else np.zeros(0, int)
    for a, b in zip(edges, np.append(edges[1:], len(pane))):
        yield int(pane[a]), item[a:b].tolist()


def verified(index: Index, passage: np.ndarray, items: list[int], overlap: float) -> Iterator[tuple[int, float, float, float]]:
    """(item, score, question, answer) of the items that the passage reaches and holds."""
    terms = np.unique(passage[passage >= 0])
    for item in items:
        own, x = index.impact[item]
        score = float(x[np.isin(own, terms, assume_unique=True)].sum())
        if score >= index.least[item]:
            q, a = _overlaps(index, item, passage)
            if q >= overlap and (a >= overlap or not index.asked[item]):
                yield item, score, q, a


def search(index: Index, ids: np.ndarray, edges: np.ndarray, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(document, item, score, question, answer) for documents of term numbers (-1: no term of the index).

    A passage is two panes of the longest item's length each, and the next one begins a pane later, so
    any item lies whole in one.  An item's best passage counts.
    """
    lengths = np.diff(edges)
    first = np.append(0, np.cumsum(lengths // index.pane + 2))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    panes = first[doc] + (np.arange(len(ids)) - edges[doc]) // index.pane + 1
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for pane, items in candidates(index, ids, panes):
        k = int(np.searchsorted(first, pane, side="right")) - 1
        # Pane 0 of a document is empty: its passage is the first pane alone.
        a = int(edges[k]) + max(0, pane - int(first[k]) - 1) * index.pane
        b = min(int(edges[k + 1]), int(edges[k]) + (pane - int(first[k]) + 1) * index.pane)
        for item, *found in verified(index, ids[a:b], items, overlap):
            score, q, r = found
            old = best.get((k, item))
            if old is None or (q + r, score) > (old[1] + old[2], old[0]):
                best[k, item] = (score, q, r)
    for (k, item), found in best.items():
        yield k, item, *found


def contaminations(docs: DataFrame, items: DataFrame, share: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap), one per document row and leaked item.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` ``item_id`` and ``text``.  A passage is a query; an
    item is retrieved if the passage's BM25 score is at least ``share`` of the item's score of itself, and
    verified if at least ``overlap`` of the five-word shingles of its question stand in the passage, and of its
    answer too where it has one: behind a mark, behind a question that is asked, or behind less than five words.
    ``answer_overlap`` says how much of the answer, or of a passage's last sentence, is there; an empty part is
    there.  Null and empty texts leak nothing and are no items, repeated items are found each, repeated rows
    answer each, empty tables give none.

    An index of at most ``ITEMS`` items goes to the executors; more items are taken in further rounds, each
    stored before the next.  Lengths and frequencies are of all items, so scores don't depend on the rounds.
    """
    spark = docs.sparkSession
    items = items.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    terms = _terms(items)
    told = terms.filter(F.col("term").isNull()).agg(F.count("*"), F.sum("n"), F.max("n")).first()
    if not told[0]:
        return spark.createDataFrame([], FOUND)
    of_all = Statistics(told[0], told[1] / told[0], told[2])
    rounds = -(-of_all.items // ITEMS)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds))
    frequencies = terms.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("n"))
    if rounds > 1:
        frequencies = materialize(frequencies, "item-terms")
    stored = Rounds(spark, "leaks")
    for k in range(rounds):
        rows = [(r["item_id"], r["text"]) for r in items.filter(part == k).collect()]
        known = frequencies
        if rounds > 1:
            own = {w for _, t in rows for words in _parts(t)[:2] for w in words}
            known = frequencies.join(spark.createDataFrame([(w,) for w in own], "term string"), "term")
        index = build_index(sorted(rows), {r["term"]: r["n"] for r in known.collect()}, of_all, share)
        if index is None:
            continue
        sent = spark.sparkContext.broadcast(index)
        found = _search_all(docs, sent, overlap)
        if rounds == 1:
            return found
        stored.add(found)
        sent.destroy()
    return stored.all() if stored.n else spark.createDataFrame([], FOUND)


FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _terms(items: DataFrame) -> DataFrame:
    """Rows (term, n): each distinct term of an item with 1, and for the item a null one with its length.

    Items without terms give none.
    """
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for text in batch.column(0).to_pylist():
                q, a, _ = _parts(text)
                if q or a:
                    rows += [(w, 1) for w in {*q, *a}] + [(None, len(q) + len(a))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()),
                                              pa.array([n for _, n in rows], pa.int64())], names=["term", "n"])

    return items.select("text").mapInArrow(batches, "term string, n long")


def _search_all(docs: DataFrame, sent: Broadcast, overlap: float) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stepframe.llm.frequencies import slices

        index = sent.value
        terms = pa.array(index.terms, pa.string())
        for batch in it:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            for a, b in slices(lengths + 16, SLICE_CHARS):
                cut = batch.slice(a, b - a)
                words = terms_of(pc.fill_null(cut.column(1), ""))
                numbers = pc.fill_null(pc.index_in(words.values, terms), -1).to_numpy().astype(np.int64)
                docs_, edges = cut.column(0).to_pylist(), words.offsets.to_numpy().astype(np.int64)
                rows = [(docs_[k], index.ids[i], *s) for k, i, *s in search(index, numbers, edges, overlap)]
                columns = [list(c) for c in zip(*rows)] or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3)],
                                                 names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, FOUND)
