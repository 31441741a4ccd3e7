"""Removal of long strings that occur more than once, by bucket-pointer refinement.

Positions of a text that begin a string of ``length`` bytes start in buckets by a q-gram: each string is
filed under the q-gram of least hash inside it, so equal strings are in one bucket at the same
offset, and one row stands for a whole run of neighbouring strings.  A bucket with one member is done.  Others are
refined: a run is split into parts, whose identifier is made of the bucket's own and of the identifiers of the
pieces at the next offsets on either side; that identifier is the bucket which the next turn refines.  A part whose
bytes from its first string to its last occur elsewhere is settled as a whole, and one such part goes on for all that
have these bytes, for others that share less with it.  The last turn has single strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.llm.common import same
from stepframe.session import materialize

LENGTH = 400
#: Strings whose q-gram is looked for at a time, which bounds a task's memory and changes no result.
CHUNK = 1 << 20
#: Rows that a task hands on at a time, or those of one text.
ROWS = 20_000
#: Each turn splits a run into at most so many parts.
PARTS = 16

_PIECES = "n1 long, n2 long, at int, lo int, hi int, core long, whole long, settled boolean"
_PLACE_BITS = np.uint64(24)


def offsets_in(length: int) -> int:
    """Places that a string's q-gram may have in it: a power of two, so runs can be halved."""
    return 1 << max(0, (2 * length // 3).bit_length() - 1)


def turns(length: int) -> list[int]:
    """Sizes of the parts of a run, turn by turn down to single strings."""
    sizes, n = [], offsets_in(length)
    while n > 1:
        n = max(1, n // PARTS)
        sizes.append(n)
    return sizes


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    power, inverse = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    return np.multiply.accumulate(power), np.multiply.accumulate(inverse), _mix(np.arange(1, 257, dtype=np.uint64))


def _least_grams(data: np.ndarray, length: int) -> np.ndarray:
    """For each string of ``data`` the place of its q-gram of least hash, the first of equals."""
    width = offsets_in(length)
    q = length - width + 1
    power, inverse, value = _powers(CHUNK + length)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * power[:len(data)], out=sums[1:])
    grams = _mix((sums[q:] - sums[:-q]) * inverse[:len(data) - q + 1])
    least = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    n = 1
    while n < width:
        least, n = np.minimum(least[:-n], least[n:]), 2 * n
    return (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)


def runs(data: np.ndarray, stops: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, place of the q-gram, first string, last string) of the runs of strings that share their q-gram.

    ``data`` holds texts one after the other, ``stops`` says where each one ends.
    """
    for a in range(0, len(data) - length + 1, CHUNK):
        part = data[a:a + CHUNK + length - 1]
        gram = _least_grams(part, length) + a
        b = a + len(gram)
        i, j = np.searchsorted(stops, [a, b - 1], side="right")
        inner = stops[i:j]
        text = np.repeat(np.arange(i, j + 1), np.diff(inner, prepend=a, append=b))
        start = np.arange(a, b)
        inside = start + length <= stops[text]
        gram, start, text = gram[inside], start[inside], text[inside]
        if not len(start):
            continue
        first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (start[1:] != start[:-1] + 1)))
        last = np.append(first[1:], len(start)) - 1
        yield text[first], gram[first], start[first], start[last]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _batch(columns: list, types: list) -> pa.RecordBatch:
    names = [c.split()[0] for c in _PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]


def _whole_runs(texts: DataFrame, length: int) -> DataFrame:
    """One row per run: its text, the q-gram's place, offsets of its strings, the bucket, and its bytes as a whole."""
    q = length - offsets_in(length) + 1

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in it:
            texts = batch.column(2).to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            data, stops = b"".join(texts), np.cumsum(sizes)
            del texts
            n1, n2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for text, gram, first, last in runs(np.frombuffer(data, np.uint8), stops, length):
                core = [digest(data[g:g + q]) for g in gram.tolist()]
                whole = [digest(data[a:b + length], c) for a, b, c in zip(first.tolist(), last.tolist(), core)]
                yield _batch([n1[text], n2[text], gram - (stops - sizes)[text], gram - last, gram - first,
                              np.array(core, np.uint64).view(np.int64), np.array(whole, np.uint64).view(np.int64), np.zeros(len(core), bool)], _TYPES)

    return texts.select("n1", "n2", F.col("text").cast("binary").alias("text")).mapInArrow(batches, _PIECES)


def _parts(texts: DataFrame, open_: DataFrame, length: int, before: int, size: int) -> DataFrame:
    """The runs of ``open_``, whose buckets have parts of ``before`` strings, as parts of ``size`` strings."""
    asked = open_.groupBy("n1", "n2").agg(F.collect_set(F.struct("at", "lo", "hi", "core", "settled")).alias("runs"))
    once = texts.groupBy("n1", "n2").agg(F.first("text").alias("text"))
    joined = once.join(asked, ["n1", "n2"]).select("n1", "n2", F.col("text").cast("binary").alias("text"), "runs")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, out = xxhash.xxh3_64_intdigest, [[] for _ in _TYPES]
        for batch in it:
            for n1, n2, text, found in zip(*(batch.column(i) for i in range(4))):
                n1, n2, data = n1.as_py(), n2.as_py(), text.as_py()
                for run in found.values.to_pylist():
                    at, lo, hi, core = run["at"], run["lo"], run["hi"], run["core"] % (1 << 64)
                    own = lo // before * before
                    for d in range(lo // size * size, hi + 1, size):
                        a, b = max(lo, d), min(hi, d + size - 1)
                        right = digest(data[at - own - before + 1 + length:at - d - size + 1 + length], core)
                        bucket = digest(data[at - d:at - own], right)
                        whole = digest(data[at - b:at - a + length], bucket)
                        for c, v in zip(out, (n1, n2, at, a, b, _long(bucket), _long(whole), run["settled"])):
                            c.append(v)
                if len(out[0]) > ROWS:
                    yield _batch(out, _TYPES)
                    out = [[] for _ in _TYPES]
        yield _batch(out, _TYPES)

    return joined.mapInArrow(batches, _PIECES)


def _places(rows: DataFrame, key: str) -> DataFrame:
    """The least and the greatest place of each value of ``key``; repeats of a place count once."""
    place = F.xxhash64("n1", "n2", "at")
    return rows.groupBy(key).agg(F.min(place).alias("p1"), F.max(place).alias("p2"))


def _shared(rows: DataFrame) -> DataFrame:
    return rows.join(_places(rows, "core").filter("p1 < p2").select("core"), "core").select(rows.columns)


def _judged(rows: DataFrame) -> DataFrame:
    """Rows of buckets that several places have; ``settled`` also where the whole occurs twice, ``leads`` at one place of each whole."""
    shared = materialize(_shared(rows), "buckets")
    judged = shared.join(_places(shared, "whole"), "whole").withColumns(
        {"settled": F.col("settled") | (F.col("p1") < F.col("p2")), "leads": F.xxhash64("n1", "n2", "at") == F.col("p1")})
    return materialize(judged.drop("p1", "p2"), "judged")


def _going_on(judged: DataFrame) -> DataFrame:
    """What the next turn splits: all that is open, and settled runs that lead and share a bucket with it."""
    open_ = judged.filter("not settled")
    return open_.unionByName(judged.filter("settled and leads").join(open_.select("core").distinct(), "core", "left_semi"))


def _identity(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("n1"), F.xxhash64(F.lit("text"), text).alias("n2")]


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (n1, n2, text_copies, spans): per text, named by two hashes, the strings that occur elsewhere too.

    A span (start, end) covers strings of ``length`` bytes that follow one another; spans may touch or overlap.
    A text that several rows hold repeats as a whole.
    """
    texts = docs.filter(F.octet_length("text") >= length).select(*_identity(F.col("text")), "text")
    rows, spans, before = materialize(_whole_runs(texts, length), "runs"), [], offsets_in(length)
    for size in turns(length):
        judged = _judged(rows)
        spans.append(judged.filter("settled").select(rows.columns))
        rows = materialize(_parts(texts, _going_on(judged), length, before, size), "parts")
        before = size
    found = _shared(rows)
    for more in spans:
        found = found.unionByName(more)
    found = found.select("n1", "n2", F.struct((F.col("at") - F.col("hi")).alias("start"),
                                              (F.col("at") - F.col("lo") + length).alias("end")).alias("span"))
    per_text = found.groupBy("n1", "n2").agg(F.collect_set("span").alias("spans"))
    copies = texts.groupBy("n1", "n2").agg(F.count("*").alias("text_copies")).filter("text_copies > 1")
    return materialize(per_text.join(copies, ["n1", "n2"], "full").select("n1", "n2", F.coalesce("text_copies", F.lit(1)).alias(
        "text_copies"), "spans"), "spans")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans with those that touch or overlap made one, in order."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, spans, kept), one per row of ``docs``.

    Needs ``doc_id`` and ``text``; other columns are not read.  A byte goes if a string of ``length`` bytes that covers
    it also begins at another place of any text, the same one included; strings never cross texts
    and are judged on the texts as given.  ``spans`` are the removed ranges of bytes (start, end), joined where they
    touch, ``kept`` is what is left, as bytes.  A null text counts as empty.  Of equal texts all go, the first one too, if they
    have ``length`` bytes.  Ids are passed on only: null and repeated ids change nothing.  An empty table gives no rows.
    """
    if length < 1:
        raise ValueError("length must be positive")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(docs, length).withColumnsRenamed({"n1": "__llm_1", "n2": "__llm_2"})
    joined = docs.select("*", *_identity(F.col("text"))).join(
        spans, same({"n1": "__llm_1", "n2": "__llm_2"}), "left").select(
        "doc_id", F.col("text").cast("binary").alias("text"), (F.col("text_copies") > 1).alias("copy"), "spans")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes, removed, cut, kept = [], [], [], []
            for text, copy, spans in zip(batch.column(1), batch.column(2), batch.column(3)):
                data, found = text.as_py(), []
                if copy.as_py() and len(data) >= length:
                    found = [(0, len(data))]
                elif spans.is_valid:
                    at = spans.values.flatten()
                    found = [*zip(*(x.tolist() for x in merged(at[0].to_numpy().astype(np.int64), at[1].to_numpy().astype(np.int64))))]
                edges = [0, *(p for span in found for p in span), len(data)]
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in found))
                cut.append([{"start": a, "end": b} for a, b in found])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(batches, f"doc_id {kind}, n_bytes long, n_removed long, "
                             "spans array<struct<start:long,end:long>>, kept binary")
