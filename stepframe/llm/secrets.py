"""Secret scans: fixed patterns, and strings that look random rather than like an identifier.

Two character Markov models, one of random strings and one of ordinary words and identifiers, are
trained from labelled samples; a candidate string is a secret if the log-likelihood ratio of the two
speaks for random.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

KINDS = ("assign", "access", "hex", "random")
#: What the models judge: a run of such characters with a digit and a letter in it.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALPHABETS = ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the fixed patterns' matches, kind by kind without overlap."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Markov:
    """Chances of a character given the one before it, with additive smoothing."""

    def __init__(self, samples: Iterable[str], smoothing: float = 0.05, symbols: int = 67):
        pairs, firsts = Counter(), Counter()
        for s in samples:
            for a, b in zip("^" + s, s):
                pairs[a, b] += 1
                firsts[a] += 1
        self.logs = {p: math.log((n + smoothing) / (firsts[p[0]] + smoothing * symbols)) for p, n in pairs.items()}
        self.least = {a: math.log(smoothing / (n + smoothing * symbols)) for a, n in firsts.items()}
        self.unseen = math.log(1 / symbols)

    def score(self, s: str) -> float:
        logs, least, unseen = self.logs, self.least, self.unseen
        return sum(logs.get((a, b), least.get(a, unseen)) for a, b in zip("^" + s, s))


def labelled_samples(docs: DataFrame, sample_docs: int, strings: int) -> tuple[list[str], list[str]]:
    """Random strings and ordinary identifiers.

    At most ``sample_docs`` documents, by least remainder of their hash, are read for labels: what the fixed patterns
    match is random, words outside are ordinary, alone and joined as identifiers are.  ``strings`` more
    random ones are drawn from the usual alphabets by a fixed seed, so that small tables do too.
    """
    docs = docs.filter(F.col("text").isNotNull()).select("text", F.pmod(F.xxhash64("text"), F.lit(1_000_000)).alias("h"))
    below = -(-2_000_000 * sample_docs // max(1, docs.count()))  # twice as many, so that tasks send few
    texts = [r["text"] for r in docs.filter(F.col("h") < below).orderBy("h", "text").limit(sample_docs).collect()]
    rng = random.Random(17)
    found = ["".join(rng.choices(ALPHABETS[k % len(ALPHABETS)], k=rng.randrange(20, 48))) for k in range(strings)]
    plain = []
    for t in texts:
        spans = base_spans(t)
        found += [t[a:b] for a, kind, b in spans if kind]
        words = re.findall(r"[A-Za-z]{2,}", t if not spans else HEX.sub(" ", ACCESS.sub(" ", ASSIGN.sub(" ", t))))
        plain += words
        plain += [join.join(words[i:i + 3]) for i, join in zip(range(0, len(words) - 3, 3), ("_", "-", "/") * len(words))]
        plain += ["".join(w.title() for w in words[i:i + 3]) for i in range(0, len(words) - 3, 9)]
        plain += [f"{w}{rng.randrange(100)}" for w in words[::7]]
    return found, plain


def secret_scan(docs: DataFrame, sample_docs: int = 1000, strings: int = 5000, least_ratio: float = 0.4) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans), one per row of ``docs``.

    Needs ``doc_id`` and ``text``; nothing else is read.  Spans are kind:start:end in code points, end
    exclusive, by start and then kind.  The models add runs of 20 or more characters of a key's alphabet,
    with a digit and a letter, that touch no other span and whose log-likelihood ratio is at least
    ``least_ratio`` per character.  Null and empty texts have no span; ids may be null or repeated; an
    empty table gives none.  The sample of labels is bounded by ``sample_docs``, the scan by nothing.
    """
    found, plain = labelled_samples(docs.select("text"), sample_docs, strings)
    secret, ordinary = Markov(found), Markov(plain)

    def added(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out, k, reach = [], 0, 0
        for m in CANDIDATE.finditer(text):
            while k < len(taken) and taken[k][0] < m.end():
                reach, k = max(reach, taken[k][2]), k + 1
            s = m.group()
            if reach > m.start() or s.isalpha() or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s):
                continue
            if secret.score(s) - ordinary.score(s) >= least_ratio * len(s):
                out.append((m.start(), 3, m.end()))
        return out

    say = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = added(text or "", base)
                kinds = Counter(k for _, k, _ in base)
                rows.append((kinds[0], kinds[1], kinds[2], len(more), hashlib.sha256(say(base).encode()).hexdigest(),
                             say(sorted(base + more))))
            columns = [list(c) for c in zip(*rows)] or [[]] * 6
            kind = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kind)], names=[
                "doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        scan, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
