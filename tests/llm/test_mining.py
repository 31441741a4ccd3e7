"""Repeated substrings, collocations and hard negatives against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import stepframe.llm.queries  # noqa: F401  (registers the queries)
from stepframe.llm.collocations import collocations
from stepframe.llm.negatives import hard_negatives
from stepframe.llm.substrings import remove_repeats
from tests.llm.conftest import crowded


def _cut(texts, length):
    """(bytes, removed bytes, spans, what is left) of each text, string by string."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(g > b for g, b in zip(gone, b"\0" + gone))
        yield len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone) if not g)


def _texts(length, seed):
    rng = random.Random(seed)
    letters = "abé\n" if length < 50 else "abcdefgh é"
    say = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pool = [say(rng.randrange(length // 2 + 1, 3 * length + 5)) for _ in range(6)]
    piece = lambda: rng.choice(pool)[rng.randrange(3):rng.randrange(length, 3 * length + 9)]
    texts = ["".join(piece() if rng.random() < .5 else say(rng.randrange(2 * length + 2)) for _ in range(rng.randrange(5))) for _ in range(50)]
    return [None, "", "a", *texts, *texts[:3], texts[0], "ab" * 2 * length, "a" * 3 * length]


@pytest.mark.parametrize("length", [1, 2, 8, 64, 400])
def test_removed_substrings_equal_brute_force(spark, length):
    texts = _texts(length, length)
    docs = spark.createDataFrame([(i % 7 if i % 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = [(r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in remove_repeats(docs, length).collect()]
    assert sorted(got) == sorted(_cut(texts, length))


def test_spans_are_those_of_the_text(spark):
    docs = spark.createDataFrame([(1, "xxHELLOWORLDyy"), (2, "HELLOWORLD!"), (3, "none of it")], "doc_id int, text string")
    got = {r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in remove_repeats(docs, 5).collect()}
    assert got == {1: ([(2, 12)], b"xxyy"), 2: ([(0, 10)], b"!"), 3: ([], b"none of it")}


def test_long_texts_are_cut_into_chunks_without_loss(spark, monkeypatch):
    import stepframe.llm.substrings as module
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh") for _ in range(90))
    texts = ["".join(rng.choice("abcdefgh") for _ in range(700)) + passage * 2, passage + "x" * 300 + passage]
    data = module.np.frombuffer("".join(texts).encode(), module.np.uint8)
    ends = module.np.array([len(texts[0]), len(data)])
    whole = [module.np.concatenate(x) for x in zip(*module.runs(data, ends, 40))]
    monkeypatch.setattr(module, "CHUNK", 64)
    cut = [module.np.concatenate(x) for x in zip(*module.runs(data, ends, 40))]
    each = lambda found: {i: (t, g) for t, g, a, b in zip(*(x.tolist() for x in found)) for i in range(a, b + 1)}
    assert each(whole) == each(cut) and len(each(whole)) == len(data) - 2 * 39


def test_substrings_of_odd_crowded_and_empty_tables(spark, odd, none, run):
    got = run("op11_repeated_substrings", documents=crowded(odd)).collect()
    texts = [r.text for r in odd.collect()]
    want = [(n, removed, spans, hashlib.sha256(kept).hexdigest()) for n, removed, spans, kept in _cut(texts, 400)]
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    assert run("op11_repeated_substrings", documents=none).count() == 0


def test_given_table_equals_brute_force(small, run):
    docs = small.limit(60).union(small.filter(F.length("text") > 400).limit(20))
    got = sorted(tuple(r)[1:] for r in run("op11_repeated_substrings", documents=docs).collect())
    texts = [r.text for r in docs.collect()]
    assert got == sorted((n, k, s, hashlib.sha256(kept).hexdigest()) for n, k, s, kept in _cut(texts, 400))


def _phrases(rows, least, top):
    """All phrases counted one by one."""
    counts, n, out = {}, Counter(), []
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        folded = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            own.update(tuple(words[i:i + k]) for i in range(len(words)) for k in range(1, 6) if i + k <= len(words))
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {p[i:i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= found[p[i:i + k]]}
        ranked = []
        for p in found.keys() - inside:
            score, k = min((1000 * own[p] * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -own[p], " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(2, 2000), (12, 7)])
def test_collocations_equal_brute_force(spark, odd, small, least, top):
    rare = spark.createDataFrame([("Ab ab,AB  ab\tab\x0bab é\x00x É\x00x é\x00X ab ab é\x00x.é\x00x", None), ("", "en"), (None, None),
                                  ("ab ab", "und")] * 12, "text string, lang string")
    docs = small.select("text", "lang").limit(60).union(odd.select("text", "lang")).union(rare)
    want = _phrases([(r.lang, r.text) for r in docs.collect()], least, top)
    assert sorted(tuple(r) for r in collocations(crowded(docs), least, top).collect()) == want


def test_collocations_whatever_the_filter_lets_pass(spark, small, monkeypatch):
    import stepframe.llm.collocations as module
    want = sorted(tuple(r) for r in collocations(small, 40).collect())
    monkeypatch.setattr(module, "SLICE", 1000)
    monkeypatch.setattr(module, "_frequent", lambda *given: module.np.full(1 << module.FILTER_BITS - 3, 255, module.np.uint8))
    assert want and sorted(tuple(r) for r in collocations(small, 40).collect()) == want


def test_collocations_of_an_empty_table(none):
    assert collocations(none).count() == 0


def test_scores_pass_64_bits(spark):
    exact = spark.sql("select 1000 * cast(a as decimal(38,0)) * cast(n as decimal(38,0)) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0))) x "
                      "from values (7000000000L, 90000000000L, 7000000001L, 7000000003L) t(a, n, l, r)").first().x
    assert exact == 1000 * 7000000000 * 90000000000 // (7000000001 * 7000000003)


def _mined(rows, is_anchor, positives=5, negatives=10):
    """All products, sorted."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for anchor in rows:
        if not is_anchor(anchor[0]):
            continue
        ranked = sorted(((-product(anchor[2], r[2]), r[0] is None, r[0] or 0, r[0], r[1]) for r in rows if r is not anchor), key=lambda t: t[:3])
        for s, *_, id_, label in [t for t in ranked if t[4] == anchor[1]][:positives]:
            hard = [t for t in ranked if t[4] != anchor[1] and 30 * -s <= 100 * -t[0] <= 90 * -s][:negatives]
            out += [(anchor[0], id_, n, t[3], -s, -t[0]) for n, t in enumerate(hard, 1)]
    return _ordered(out)


def _ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x or 0) for x in r])


def _vectors(seed):
    """Ties, repeated rows and ids, a crowd of equal vectors, nulls in every column, vectors of other lengths."""
    rng = random.Random(seed)
    odd = [None, [], [1, None]]
    rows = [[rng.randrange(300) if rng.random() < .95 else None, rng.choice([0, 1, 1, 2, None]),
             rng.choice(odd) if rng.random() < .05 else [rng.randrange(-9, 10) for _ in range(rng.choice([7, 7, 7, 3]))]] for _ in range(300)]
    return rows + [[1000 + i, 1, [3] * 7] for i in range(100)] + [list(r) for r in rows[:20]]


@pytest.mark.parametrize("scored, codes", [(512, 16), (1, 4)])
def test_hard_negatives_equal_brute_force(spark, scored, codes, monkeypatch):
    import stepframe.llm.negatives as module
    monkeypatch.setattr(module, "CHUNK", 65_536 if scored > 1 else 50)
    monkeypatch.setattr(module, "BLOCK", 16_384 if scored > 1 else 7)
    rows = _vectors(scored)
    frame = crowded(spark.createDataFrame([tuple(r) for r in rows], "vec_id long, label int, vector array<long>")).repartition(4)
    got = hard_negatives(frame, F.col("vec_id") % 10 == 0)
    assert _ordered(got.collect()) == _mined(rows, lambda i: i is not None and i % 10 == 0)


def test_cells_are_visited_until_the_window_is_certain():
    import numpy as np
    from stepframe.llm.negatives import Index, codebook, nearest
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (6, 8))
    x = (centres[rng.integers(0, 6, 5000)] + rng.integers(-9, 10, (5000, 8))).astype(np.int16)
    books = codebook(x[:, :4].astype(float)), codebook(x[:, 4:].astype(float))
    cells = nearest(x[:, :4], books[0]) * len(books[1]) + nearest(x[:, 4:], books[1])
    x, cells = x[np.argsort(cells, kind="stable")], np.sort(cells)
    index = Index({"chunk": 0, "bits": 16, "ids": np.arange(5000).tobytes(), "known": np.ones(5000, bool).tobytes(),
                   "labels": (np.arange(5000) % 2).tobytes(), "cells": cells.astype(np.int32).tobytes(), "vectors": x.tobytes()}, books)
    scored = []
    take, index.scores = index.scores, lambda at, q: scored.append(len(at)) or take(at, q)
    q = x[77].astype(np.int64)
    scores, at = index.positives(q, 1, 77, 5)
    want = sorted((-int(x[i].astype(int) @ q), i) for i in range(1, 5000, 2) if i != 77)[:5]
    assert [(-s, i) for s, i in zip(scores.tolist(), at.tolist())] == want and sum(scored) < 2500
    bounds = [b for b, _ in index.visits(q)]
    assert bounds == sorted(bounds, reverse=True) and sum(len(r) for _, r in index.visits(q)) == 5000


def test_scores_are_exact_beyond_doubles(spark):
    big = (1 << 30) + 1
    rows = [(0, 0, [big, 1]), (1, 0, [big, 3]), (2, 0, [big, 2]), (3, 1, [big // 2, 5]), (4, 1, [big // 2, 7])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    assert _ordered(hard_negatives(frame, F.col("vec_id") == 0).collect()) == _mined(rows, lambda i: i == 0)


def test_hard_negatives_of_an_empty_table_and_without_anchors(spark):
    none = spark.createDataFrame([], "vec_id long, label int, vector array<long>")
    assert hard_negatives(none, F.col("vec_id") >= 0).count() == 0
    one = spark.createDataFrame([(1, 1, [1]), (2, 0, [1])], none.schema)
    assert hard_negatives(one, F.lit(False)).count() == 0 and hard_negatives(one, F.lit(True)).count() == 0


def test_query_leaves_bad_vectors_out_and_moves_labels(spark, run):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 9, [.5, .25]), (100, 0, [.5, .5]), (1, 0, [.5, .5]), (3, 5, [.2, .25]), (4, 5, [nan, .3]), (5, 5, [inf, .3]), (6, 5, [None, .3]), (8, None, [.2, .2])]
    frame = spark.createDataFrame([(i, v, l) for i, l, v in rows], "vec_id long, embedding array<float>, label int")
    got = run("op13_hard_negatives", embeddings=frame)
    moved = [(i, (l + 1) % 10 if i % 7 == 0 else l, [int(256 * x // 1) for x in v]) for i, l, v in rows if i in (0, 100, 1, 3)]
    assert _ordered(got.collect()) == _mined(moved, lambda i: i % 100 == 0)
