"""Document scores by a subword lattice: all segmentations of a word into pieces of an existing vocabulary.

The vocabulary's pieces get unigram scores from the training documents, and a word seen there is one
segment more, as a whole.  A word's probability sums over all its segmentations by a forward recursion
in log space, a document's is the product over its words and one end.  Words are scored once each and
joined to per-document frequencies.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.llm.common import lower_words
from stepframe.llm.frequencies import document_sums, token_frequencies
from stepframe.session import materialize

#: Added to each piece's expected count.
SMOOTHING = 0.01
MARK = "▁"
HELD_OUT_OF = 10


@lru_cache(maxsize=2)
def vocabulary(model: str) -> dict[str, int]:
    """Pieces by text; control pieces are left out, byte pieces keep their names."""
    from stepframe.llm.tokens import processor

    found = processor(model)
    return {found.id_to_piece(i): i for i in range(found.get_piece_size()) if not (found.is_control(i) or found.is_unknown(i))}


class Lattice:
    """Pieces that may stand at each place of a word, and the recursions over them.

    ``scores`` are natural logs by piece.  A character that is no piece is spelled in byte pieces.
    """

    def __init__(self, pieces: dict[str, int], scores: np.ndarray):
        self.pieces, self.scores, self.chances = pieces, scores.tolist(), np.exp(scores).tolist()
        self.longest = max(map(len, pieces))
        self.stems = {p[:k] for p in pieces for k in range(1, len(p) + 1)}

    def forward(self, text: str) -> float:
        """Log of the summed probability of all segmentations."""
        pieces, scores, stems, longest, n = self.pieces, self.scores, self.stems, self.longest, len(text)
        reach: list = [None] * (n + 1)
        reach[0] = (0.0,)
        exp, log = math.exp, math.log
        for i in range(n):
            got = reach[i]
            if got is None:
                continue
            if len(got) == 1:
                at = got[0]
            else:
                top = max(got)
                at = top + log(sum([exp(x - top) for x in got]))
            reach[i] = None
            for j in range(i + 1, min(n, i + longest) + 1):
                part = text[i:j]
                k = pieces.get(part)
                if k is not None:
                    if reach[j] is None:
                        reach[j] = [at + scores[k]]
                    else:
                        reach[j].append(at + scores[k])
                elif part not in stems:
                    break
            if text[i] not in pieces:
                x = at + sum(scores[pieces[f"<0x{b:02X}>"]] for b in text[i].encode())
                if reach[i + 1] is None:
                    reach[i + 1] = [x]
                else:
                    reach[i + 1].append(x)
        got = reach[n]
        top = max(got)
        return top + log(sum([exp(x - top) for x in got]))

    def word(self, token: str) -> float:
        """Log probability that pieces build the word and end there."""
        return self.forward(MARK + token) + self.scores[-1]

    def expect(self, text: str, weigh: Callable[[float], float], into: list[float]) -> float:
        """Add to ``into`` how often each piece is expected in ``weigh(log probability)`` such words; returns that number.

        Chances are kept as they are, or as logs where they would be too small for a float.
        """
        edges, n, at = self._edges(text), len(text), [1.0] + [0.0] * len(text)
        for i, j, p, _ in edges:
            at[j] += at[i] * p
        if at[n] > 1e-290:
            times = weigh(math.log(at[n]))
            share = lambda i, j, p: at[i] * p / at[j]
        else:
            logs: list = [[0.0]] + [[] for _ in text]
            for i, j, p, ids in edges:
                if isinstance(logs[i], list):
                    top = max(logs[i])
                    logs[i] = top + math.log(sum(math.exp(x - top) for x in logs[i]))
                logs[j].append(logs[i] + self._log(ids))
            top = max(logs[n])
            logs[n] = top + math.log(sum(math.exp(x - top) for x in logs[n]))
            times = weigh(logs[n])
            share = lambda i, j, p: math.exp(logs[i] + self._log(ids) - logs[j])
        mass = [0.0] * n + [times]
        for i, j, p, ids in reversed(edges):
            if mass[j]:
                part = mass[j] * share(i, j, p)
                mass[i] += part
                if isinstance(ids, int):
                    into[ids] += part
                else:
                    for k in ids:
                        into[k] += part
        return times

    def _log(self, ids: int | tuple[int, ...]) -> float:
        return self.scores[ids] if isinstance(ids, int) else sum(self.scores[k] for k in ids)

    def _edges(self, text: str) -> list[tuple[int, int, float, int | tuple[int, ...]]]:
        """(begin, end, chance, piece or bytes) of the pieces at places that can be reached, by begin."""
        pieces, chances, stems, longest, n, out = self.pieces, self.chances, self.stems, self.longest, len(text), []
        reached = [True] + [False] * n
        for i in range(n):
            if not reached[i]:
                continue
            for j in range(i + 1, min(n, i + longest) + 1):
                part = text[i:j]
                k = pieces.get(part)
                if k is not None:
                    out.append((i, j, chances[k], k))
                    reached[j] = True
                elif part not in stems:
                    break
            if text[i] not in pieces:
                ids = tuple(pieces[f"<0x{b:02X}>"] for b in text[i].encode())
                out.append((i, i + 1, math.prod(chances[k] for k in ids), ids))
                reached[i + 1] = True
        return out


def _to_scores(counts: np.ndarray, pieces: dict[str, int], smoothing: float) -> np.ndarray:
    """Log scores of the pieces and, in the last place, of a word's end, from their counts."""
    ids = np.append(np.fromiter(pieces.values(), int), len(counts) - 1)
    scores = np.full(len(counts), -np.inf)
    scores[ids] = np.log((counts[ids] + smoothing) / (counts[ids] + smoothing).sum())
    return scores


def _gather(words: DataFrame, size: int, count) -> np.ndarray:
    """Sums that ``count(words, times, sums)`` adds up in its last argument: a number per piece of the vocabulary."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for batch in it:
            count(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sums)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["piece", "n"])

    out = np.zeros(size)
    for r in words.select("token", "n").mapInArrow(batches, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r["piece"]] = r["n"]
    return out


def train(words: DataFrame, total: int, single: int, model: str, rounds: int = 1,
          smoothing: float = SMOOTHING) -> tuple[np.ndarray, float]:
    """Scores of pieces and word's end, and the share of words taken as a whole.

    ``words`` are rows (token, n) of the distinct training words, ``total`` of them in all, ``single``
    seen once.  The model's own segmentation of each distinct word gives first counts.  A round of
    expectation maximisation counts all segmentations by their weight; so that it learns how *new*
    words are built, a word's whole is weighed without the word itself (n - 1 of the total).  Only one
    number per piece of the fixed vocabulary comes to the driver.
    """
    from stepframe.llm.tokens import processor

    size = processor(model).get_piece_size() + 1

    def best(tokens: list[str], times: list[int], sums: np.ndarray) -> None:
        ids = processor(model).encode(tokens, num_threads=1)
        np.add.at(sums, np.fromiter((k for x in ids for k in x), int), 1.0)
        sums[-1] += len(tokens)

    counts = _gather(words, size, best)
    whole = min(0.999, max(0.5, 1 - single / total)) if total else 0.0
    for _ in range(rounds):
        scores = _to_scores(counts, vocabulary(model), smoothing)

        def expected(tokens: list[str], times: list[int], sums: np.ndarray, scores=scores, whole=whole) -> None:
            lattice, into = Lattice(vocabulary(model), scores), [0.0] * size
            for t, n in zip(tokens, times):
                def weigh(log: float, n=n) -> float:
                    built = (1 - whole) * math.exp(log + lattice.scores[-1])
                    return n * built / (built + whole * (n - 1) / total) if built > 0 or n > 1 else float(n)

                into[-1] += lattice.expect(MARK + t, weigh, into)
            sums += np.array(into)

        counts = _gather(words, size, expected)
        whole = min(0.999, max(0.5, 1 - counts[-1] / total)) if total else 0.0
    return _to_scores(counts, vocabulary(model), smoothing), whole


def lattice_scores(docs: DataFrame, model: str, rounds: int = 1) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one per row of ``docs``.

    Needs ``doc_id`` and ``text``; nothing else is read.  Training documents are those whose id's CRC-32
    as text is not divisible by 10 (a null id counts as an empty text).  Tokens are lower-cased words
    and one end per document.  ``base_score`` is the log10 score of an add-0.1 unigram model of the
    tokens, ``score`` that of the lattice.  Null and empty texts have only their end; repeated rows
    count each; an empty table gives none; without training documents all pieces are equally likely.
    The end's share is that of ends among the training tokens, (ends + 0.5) / (tokens + 1).
    """
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    marked = docs.select("doc_id", "text", (F.pmod(crc, F.lit(HELD_OUT_OF)) != 0).alias("mark"))
    frequencies = materialize(token_frequencies(marked, lambda texts: [lower_words(t) for t in texts], lambda t, n: n + 1),
                              "token-frequencies")
    words = materialize(frequencies.filter("documents is null").groupBy("token").agg(F.sum("marked").alias("n")), "token-counts")
    known = words.filter("n > 0")
    totals = known.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                       F.count(F.when(F.col("n") == 1, 1)).alias("single")).first()
    ends = frequencies.filter("documents is not null").select(F.explode("documents").alias("d")).filter("d.mark").count()
    seen, n, distinct = totals["n"], totals["n"] + ends, totals["v"] + (ends > 0)
    scores, whole = train(known, seen, totals["single"], model, rounds)
    end = (ends + 0.5) / (n + 1)
    base = lambda c: (F.log10((c + F.lit(0.1)) / F.lit(n + 0.1 * (distinct + 1))))

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for batch in it:
            lattice = lattice or Lattice(vocabulary(model), scores)
            got = []
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                built = lattice.word(t) + math.log(1 - whole)
                as_one = math.log(whole * c / seen) if c else -math.inf
                top = max(built, as_one)
                got.append((top + math.log(math.exp(built - top) + math.exp(as_one - top)) + math.log(1 - end)) / math.log(10))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64())], names=["known", "n", "log"])

    scored = words.mapInArrow(score, "known string, n long, log double").select("known", "n", "log", base(F.col("n")).alias("plain"))
    joined = frequencies.drop("marked").join(scored, F.col("token") == F.col("known"), "left")
    sums = document_sums(joined, seen=(F.col("n") > 0).cast("int"), plain=F.col("plain"), log=F.col("log"))
    return sums.select(
        "doc_id", (~F.col("mark")).alias("held_out"), F.col("size").alias("n_tokens"),
        (F.col("seen") + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("plain") + base(F.lit(ends).cast("long"))).alias("base_score"), (F.col("log") + F.lit(math.log10(end))).alias("score"))
