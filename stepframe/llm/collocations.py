"""Collocations by top-order marginalisation.

Only the longest windows are counted, five words from each word on, padded where a piece of text ends; ROLLUP sums their
counts to those of all shorter phrases.  A window is padded as well where two or three neighbouring words are too rare
together: no phrase across them can be frequent enough, so the counts of those that are stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepframe.session import freed_shuffles, materialize

#: Words in the longest phrases.
ORDER = 5
#: Bytes of text that are cut into words at a time; bounds a task's memory and changes no result.
SLICE = 500_000
#: Size of each of the two filters of frequent words that tasks are sent, whatever there is of them: 2^25 bits are 4 MB.  One
#: that fills up lets rare ones pass, which makes more windows and the same result.
FILTER_BITS = 25

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(word number, or -1 between pieces; hash of each word; words) of some megabytes of text after the other."""
    held, size = [], 0
    for text in texts:
        data = text.encode().translate(_FOLD)
        while len(data) > SLICE and (cut := data.find(b"\n", SLICE)) >= 0:
            yield _coded(data[:cut])
            data = data[cut + 1:]
        held.append(data)
        size += len(data)
        if size > SLICE:
            yield _coded(b"\n".join(held))
            held, size = [], 0
    if held:
        yield _coded(b"\n".join(held))


def _coded(data: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    coded = pa.array(data.replace(b"\n", b" \n ").split(b" "), pa.binary()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    kind = np.array([0 if not w else -1 if w == b"\n" else 1 for w in words], np.int64)
    codes = coded.indices.to_numpy()
    codes = codes[kind[codes] != 0]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    return np.append(np.where(kind[codes] < 0, -1, codes), [-1, -1]), hashes, coded.dictionary


class _Slice:
    """Hashes of the words of a slice, of pairs and of triples of neighbouring words, and where those are whole."""

    def __init__(self, codes: np.ndarray, hashes: np.ndarray, lang: str):
        self.is_word = codes >= 0
        self.word = np.where(self.is_word, _mix(hashes[codes] + np.uint64(xxhash.xxh3_64_intdigest(lang))), np.uint64(0))
        self.paired = self.is_word[:-1] & self.is_word[1:]
        self.pair = _mix(self.word[:-1] * _M + self.word[1:])
        self.tripled = self.paired[:-1] & self.paired[1:]
        self.triple = _mix(self.pair[:-1] * _M + self.word[2:])


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = (keys >> np.uint64(64 - FILTER_BITS)) & np.uint64(7)
    return bits[keys >> np.uint64(67 - FILTER_BITS)] >> bit.astype(np.uint8) & 1 > 0


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    texts: dict[str, list[str]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        texts.setdefault(lang, []).append(text)
    yield from texts.items()


def _frequent(texts: DataFrame, least: int, pairs=None) -> np.ndarray:
    """A filter, as bytes of bits, that all words and pairs pass which occur ``least`` times in a language.

    With the filter of pairs, that of triples.
    """
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lang, found in _by_lang(batch):
                for codes, hashes, _ in _pieces(found):
                    own = _Slice(codes, hashes, lang)
                    if pairs is None:
                        keys = np.concatenate([own.word[own.is_word], own.pair[own.paired]])
                    else:
                        keys = own.triple[own.tripled & _passes(pairs.value, own.pair[:-1])]
                    keys, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    often = texts.mapInArrow(batches, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    # At most 2^19 rows of 64 bits come to the driver.
    bits = often.select(F.shiftrightunsigned("key", 64 - FILTER_BITS).alias("bit")).groupBy(F.expr("bit div 64").alias("cell")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    with freed_shuffles(texts.sparkSession):
        bits = bits.toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, "<u8")
    out[bits.column("cell").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def _windows(texts: DataFrame, pairs, triples) -> DataFrame:
    """Rows (lang, w1 ... w5, n): windows from each word on, null from where they are padded; all null from a rare word."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lang, found in _by_lang(batch):
                for codes, hashes, words in _pieces(found):
                    own, behind = _Slice(codes, hashes, lang), np.zeros(ORDER, bool)
                    two = np.append(own.paired & _passes(pairs.value, own.pair), behind)
                    three = np.append(own.tripled & _passes(triples.value, own.triple), behind) & two[:-1] & two[1:]
                    open_, key, columns = own.is_word & _passes(pairs.value, own.word), np.zeros(len(codes), np.uint64), []
                    far = np.append(codes, np.full(ORDER, -1))
                    for k in range(ORDER):
                        columns.append(np.where(open_, far[k:k + len(codes)], -1))
                        key = np.where(open_, _mix(key * _M + hashes[columns[k]]), key)
                        open_ = open_ & (two[:len(codes)] if k == 0 else three[k - 1:k - 1 + len(codes)])
                    is_word = own.is_word
                    _, first, n = np.unique(key[is_word], return_index=True, return_counts=True)
                    at = np.flatnonzero(is_word)[first]
                    taken = [words.take(pa.array(c[at], pa.int64(), mask=c[at] < 0)).cast(pa.string()) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), *taken, pa.array(n)],
                                                     names=["lang", *WORDS, "n"])

    return texts.mapInArrow(batches, f"lang string, {', '.join(f'{w} string' for w in WORDS)}, n long")


WORDS = [f"w{k}" for k in range(1, ORDER + 1)]


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """Rows (lang, size, phrase, f): all phrases of up to five words that occur ``least`` times; size 0 counts all words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter(F.col("text").isNotNull())
    send = texts.sparkSession.sparkContext.broadcast
    pairs = send(_frequent(texts, least))
    longest = materialize(_windows(texts, pairs, send(_frequent(texts, least, pairs))).groupBy("lang", *WORDS).agg(F.sum("n").alias("n")), "windows")
    # Under ROLLUP, prefixes of k words have the last 5 - k columns grouped away.
    sums = longest.rollup("lang", *WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("away"))
    size = F.lit(ORDER) - F.length(F.replace(F.bin("away"), F.lit("0"), F.lit("")))
    last = F.when(F.col("size") == 0, F.lit("")).otherwise(F.get(F.array(*WORDS), (F.col("size") - 1).cast("int")))
    sums = sums.withColumn("size", size).filter(F.col("size") >= 0).filter(last.isNotNull())
    return sums.filter((F.col("size") == 0) | (F.col("f") >= least)).select("lang", "size", F.concat_ws(" ", *WORDS).alias("phrase"), "f")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the phrases of each language whose words belong together most.

    Needs ``lang`` (null: ``und``) and ``text`` (null: none); other columns are not read.  A-Z is folded, texts are cut
    at ``.,;:!?`` and line ends, words at blanks and tabs; no phrase crosses a cut.  Phrases of 2 to 5 words that occur
    ``least`` times score ``floor(1000 * a * n / (l * r))`` at the cut into two parts where that is lowest, the first
    of equal ones: ``a``, ``l`` and ``r`` count the phrase and its parts, ``n`` all words of the language.  A phrase inside a longer one
    that occurs as often is left out.  Ranks go by score, ``a``, then the phrase's bytes.  Repeated rows count each time; empty and blank
    texts have no words; an empty table gives no rows.
    """
    counts = materialize(phrase_counts(docs, least), "phrases")
    found = counts.filter("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    part = lambda first, n: F.array_join(F.slice("words", first, n), " ")
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    of = lambda name, n: counts.filter("size > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    cut = cut.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    wide = "cast({} as decimal(38, 0))".format
    score = F.expr(f"1000 * {wide('a')} * {wide('n')} div ({wide('l')} * {wide('r')})")
    lowest = cut.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = found.filter("size > 2").withColumn("inner_size", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn(
        "at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inner_size") + 1)))
    inner = inner.groupBy("lang", part(F.col("at"), F.col("inner_size")).alias("phrase")).agg(F.max("a").alias("around"))
    kept = lowest.join(inner, ["lang", "phrase"], "left").filter("around is null or around < a")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").alias("score"))
