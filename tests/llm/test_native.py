import collections
import hashlib
import math
import re
import zlib

import pytest

import stepframe.llm.queries_native  # noqa: F401
from stepframe.llm import chat, licenses, mixing, quality, shards
from tests.llm.conftest import crowded

W = re.compile(r"[^\x20\x09-\x0D]+")


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def by_id(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("which", ["odd", "small", "none"])
def test_shards_follow_the_published_function(request, run, which):
    docs = request.getfixturevalue(which)
    got = run("op2_jump_shards", documents=docs).collect()
    want = collections.Counter()
    for r in docs.collect():
        data, key = (r.text or "").encode(), r.doc_id or 0
        want[(r.doc_id, len(data) + 16, zlib.crc32(data), "key", jump(key, 40), jump(key, 41))] += 1
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(r.grown_shard in (r.shard, 40) for r in got)


def test_slots_in_many_blocks(spark):
    rows = spark.range(500).selectExpr("id doc_id", "id % 7 size", "id % 3 text_crc32")
    sharded = shards.assign_shards(rows.union(rows.limit(40)), "doc_id", 5)
    got = shards.shard_slots(sharded, "shard", rows.columns, block_rows=20).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 540 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_of_other_keys_and_columns(spark, odd):
    got = shards.assign_shards(crowded(odd), "text", 9, name="Size")
    assert "Size" in got.columns and "size" not in got.columns and got.count() == odd.count()
    assert got.groupBy("text").agg({"Size": "min"}).count() == odd.select("text").distinct().count()
    assert shards.assign_shards(spark.range(10), "id", 1).filter("shard <> 0").count() == 0
    with pytest.raises(ValueError):
        shards.assign_shards(odd, "doc_id", 0)


def water(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing the excess again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, total, capped = {}, sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: cap * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("which", ["odd", "small", "none"])
def test_mix_reaches_targets(request, run, which):
    docs = request.getfixturevalue(which)
    got = run("op3_pareto_mix", documents=docs).collect()
    rows = docs.collect()
    size = lambda r: len(W.findall(r.text or ""))
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((r.doc_id, size(r)) for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += size(r)
    want = water(sizes)
    assert {(sizes[s], round(t, 6)) for s, t in want.items()} == {(r.source_size, round(r.target, 6)) for r in got}
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        taken[r.source_size] += r.taken
        largest[r.source_size] = max(largest[r.source_size], r["size"])
        assert r["size"] == 0 or (r.taken % r["size"] == 0 and r.taken <= 3 * r["size"])
    assert all(abs(taken[sizes[s]] - t) <= largest[sizes[s]] / 2 + 1e-6 for s, t in want.items())
    again = run("op3_pareto_mix", documents=docs.repartition(7)).collect()
    assert collections.Counter(again) == collections.Counter(got)


def test_mix_in_many_blocks_equals_one(spark, small):
    from stepframe.llm.common import n_words
    rows = small.union(small.limit(50)).select("source", "doc_id", n_words(small.text).alias("size"),
                                               mixing.uniform(3, small.doc_id, small.text).alias("u"))
    many, one = (mixing.mix_plan(rows, block_rows=b).drop("u") for b in (7, 10**6))
    assert by_id(many) == by_id(one) and one.agg({"rows": "sum"}).first()[0] == 250


def test_mix_ranks_by_own_inclusion(spark):
    """Documents of unequal sizes: certain ones all go, others by random odds over their own inclusion odds, not by their draws."""
    import random
    rng = random.Random(4)
    rows = [("a", i, rng.choice([3, 10, 40, 400]), rng.random()) for i in range(400)] + [("a", 400, 30_000, 0.999)]
    rows += [("b", 1000 + i, 25, rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "source string, doc_id long, size long, u double")
    got = mixing.mix_plan(df, weights=(2, 3), block_rows=50).collect()
    for name in "ab":
        mine = [r for r in rows if r[0] == name]
        plan = {r.doc_id: r for r in got if r.source == name}
        assert len(plan) == len(mine)
        target, total = plan[mine[0][1]].target, sum(r[2] for r in mine)
        whole, left, open_ = int(target // total), target - target // total * total, sorted(mine, key=lambda r: -r[2])
        while open_ and left * open_[0][2] >= sum(r[2] ** 2 for r in open_):
            left -= open_.pop(0)[2]
        certain = {r[1] for r in mine} - {r[1] for r in open_}
        c = left / sum(r[2] ** 2 for r in open_)
        rank = {r[1]: r[3] / (1 - r[3]) * (1 - c * r[2]) / (c * r[2]) for r in open_}
        taken, cum = set(), 0
        for r in sorted(open_, key=lambda r: rank[r[1]]):
            if cum + r[2] / 2 <= left:
                taken.add(r[1])
            cum += r[2]
        assert {k for k, r in plan.items() if r.extra} == taken and {k for k, r in plan.items() if r.sure > whole} == certain
        if name == "a":
            assert 400 in certain
            by_draw = [r[1] for r in sorted(open_, key=lambda r: r[3])][:len(taken)]
            assert set(by_draw) != taken


def test_targets_with_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 3, "e": 0, None: 700}
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in water(sizes).items()}


def test_mix_sources_repeats_whole_rows(spark, odd, none):
    from stepframe.llm.common import n_words
    from pyspark.sql import functions as F
    mixed = mixing.mix_sources(crowded(odd), n_words(F.col("text")), seed=11)
    assert mixed.columns == crowded(odd).columns
    plan = collections.Counter()
    rows = odd.select("source", "doc_id", n_words(odd.text).alias("size"), mixing.uniform(11, odd.doc_id, odd.text).alias("u"))
    for r in mixing.mix_plan(rows).collect():
        plan[(r.doc_id, r["size"])] += r.sure * r.rows + r.extra
    got = collections.Counter((r.doc_id, len(W.findall(r.text or ""))) for r in mixed.collect())
    assert got == +plan
    assert mixing.mix_sources(none, n_words(F.col("text"))).count() == 0


def quality_counts(t):
    t = t or ""
    w = W.findall(t)
    runs = collections.defaultdict(list)
    for i in range(len(w) - 4):
        runs[tuple(w[i:i + 5])].append(i)
    repeated = {i + k for v in runs.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in t.split("\n") if W.search(x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated),
            len(w) < 10 or 100 * len(repeated) > 20 * len(w))


def chained_hash(words):
    """Spark's 64-bit hash of a list of texts."""
    import xxhash
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h - 2**64 if h >= 2**63 else h


def kept_ids(docs, min_documents, min_share, min_left, max_family=0.2):
    """The method with dictionaries."""
    norm = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower())).strip(" ")
    least = lambda x: min(chained_hash(w[i:i + 5]) for w in [x.split(" ")] for i in range(max(1, len(w) - 4)))
    lines = {(r.source, r.text): {norm(x): least(norm(x)) for x in (r.text or "").split("\n") if W.search(x)} for r in docs}
    holders = collections.defaultdict(collections.Counter)
    for (s, t), ls in lines.items():
        for x in ls:
            holders[s, x][min((v for y, v in ls.items() if y != x), default=("alone", t))] += 1
    from_host = collections.Counter(s for s, _ in lines)
    common = {k for k, f in holders.items() if f.total() > max(min_documents, min_share * from_host[k[0]])
              and max(f.values()) <= max_family * f.total()}
    out = []
    for r in docs:
        n = len(W.findall(r.text or ""))
        gone = sum(len(W.findall(x)) for x in (r.text or "").split("\n") if (r.source, norm(x)) in common)
        out.append((r.doc_id, gone, not quality_counts(r.text)[5] and n - gone > n * min_left))
    return sorted(out, key=str), common


@pytest.mark.parametrize("which", ["odd", "small", "none"])
def test_quality_counts(request, run, which):
    docs = request.getfixturevalue(which)
    got = run("op9_quality_rules", documents=docs).collect()
    want = collections.Counter((r.doc_id, *quality_counts(r.text)) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_common_lines_go_and_copies_stay(spark):
    spell = lambda i: "".join(chr(97 + int(d)) for d in str(i))  # noqa: E731  (digits count as equal)
    body = lambda i, n=12: " ".join(f"w{spell(i)}x{spell(k)}" for k in range(n))
    rows = [(i, f"Subscribe now to our 20{i % 10} letter\n{body(i)}", "h", None) for i in range(30)]
    rows += [(100 + i, f"{body(777)}\n{body(778)}\n{body(779)}\nversion v{i}", "h", None) for i in range(40)]
    rows += [(200 + i, body(900, 15), "h", None) for i in range(50)]
    rows += [(300, "subscribe now to  our 2099 LETTER\n\n Subscribe now to our 5 letter\nhi", "h", 1), (301, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")
    got = {r.doc_id: r for r in quality.quality_rules(df, min_documents=10, min_share=0.01, min_left=0.2).collect()}
    assert got[0].removed_words == 6 and got[0].clean_text == body(0) and got[0].kept
    assert all(got[i].kept and got[i].removed_words == 0 for i in [*range(100, 140), *range(200, 250)])
    assert not got[300].kept and got[300].clean_text == "\nhi" and got[301].clean_text is None and not got[301].kept


def test_common_lines_go_from_hosts_of_every_size(spark):
    from pyspark.sql import functions as F
    docs = spark.range(6000).select("id", F.when(F.col("id") < 5900, "hot").otherwise("small").alias("source"))
    own = F.concat_ws(" ", *[F.translate(F.md5(F.concat_ws("-", "id", F.lit(str(k)))), "0123456789", "ghijklmnop") for k in range(12)])
    has = (F.col("id") < 21) | (F.col("id") >= 5979)  # 21 documents of each host
    docs = docs.withColumn("text", F.when(has, F.concat(F.lit("all rights reserved by the owner\n"), own)).otherwise(own))
    got = quality.quality_rules(docs).groupBy("source", "removed_words").count().collect()
    assert {(r.source, r.removed_words): r["count"] for r in got} == {
        ("hot", 6): 21, ("hot", 0): 5879, ("small", 6): 21, ("small", 0): 79}


def test_quality_verdict_equals_brute_force(spark, small):
    docs = small.withColumn("source", small.source.substr(1, 4))
    want, common = kept_ids(docs.collect(), 1, 0.01, 0.5, 0.5)
    got = quality.quality_rules(crowded(docs), 1, 0.01, 0.5, 0.5)
    rows = sorted(((r.doc_id, r.removed_words, r.kept) for r in got.collect()), key=str)
    assert rows == want and common


def licence_base(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(w)) if w[i:i + len(p)] == p]
    at = [i for i, _ in hits]
    return (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))


@pytest.mark.parametrize("which", ["odd", "small", "none"])
def test_licence_base(request, run, which):
    docs = request.getfixturevalue(which)
    got = run("op7_license_scan", documents=docs).collect()
    want = collections.Counter((r.doc_id, *licence_base(r.text)) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_licence_labels(spark):
    texts = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0": "apache-2.0",
             "licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "nothing here": "", "the license of mit": "",
             "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0"}
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    assert [r.labels for r in licenses.license_scan(df).orderBy("doc_id").collect()] == list(texts.values())
    assert all(r.score == 0 for r in licenses.license_scan(df).collect() if r.labels == "")


def licence_labels(t, idf, support=0.5):
    """Labels and score by trying every notice at every place, without an index."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    labels, score = set(), 0.0
    for x in licenses.notices():
        whole = sum(idf[v] for v in x.words)
        for start in range(1 - len(x.words), len(w)):
            hit = [0 <= start + k < len(w) and w[start + k] == v for k, v in enumerate(x.words)]
            share = sum(idf[v] for v, h in zip(x.words, hit) if h) / whole
            if all(h for h, m in zip(hit, x.must) if m) and (x.base or share >= support):
                labels.add(x.label)
                score = max(score, 1.0 if x.base else min(1.0, share))
    return ",".join(sorted(labels)), round(score, 9)


def test_licence_index_equals_brute_force(spark, odd):
    """Whole, cut and changed notices among other words, several in one text, by IDF of the corpus and by a given one."""
    import random
    rng = random.Random(8)
    listed, texts = licenses.notices(), [None, "", "the the by 2 0", "general public license" * 3]
    for k in range(240):
        said = []
        for x in rng.sample(listed, rng.randrange(1, 4)):
            w = list(x.words)
            if k % 3 == 1:
                w = w[rng.randrange(3):len(w) - rng.randrange(3)]
            if k % 3 == 2 and w:
                w[rng.randrange(len(w))] = rng.choice(["the", "x", "license", "2"])
            said += [rng.choice(["by", "license", "of", "cc", "Other"])] * rng.randrange(3) + w
        texts.append(" ".join(said))
    texts += ["/* SPDX-License-Identifier: MIT */", "EPL: Eclipse Public License 2.0", "Licensed under the EUPL, version 1.2",
              "Redistributions in binary form must reproduce the above copyright notice"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary = {w for x in listed for w in x.words}
    docs = [set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())) for t in texts]
    own = {w: math.log(1 + (len(texts) + 1) / (sum(w in d for d in docs) + 0.5)) for w in vocabulary}
    for given, idf in ((None, own), ({w: 1.0 + len(w) for w in vocabulary},) * 2):
        got = [(r.labels, round(r.score, 9)) for r in licenses.license_scan(df, given).orderBy("doc_id").collect()]
        assert got == [licence_labels(t, idf) for t in texts]
    assert [r[0] for r in got[-4:]] == ["mit", "epl-2.0", "eupl-1.2", "bsd"]


def digests(rows):
    out, by = {}, collections.defaultdict(list)
    for r in rows:
        by[r.conv_id].append(r)
    for c, ts in by.items():
        ts.sort(key=lambda r: (r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
        told = "".join(f"{r.role or ''}\n{r.text or ''}\n" for r in ts)
        learnt = "".join(r.text or "" for r in ts if r.role == "assistant")
        out[c] = (len(ts), hashlib.sha256(told.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def odd_turns():
    say = lambda n: " ".join(f"w{k}" for k in range(n))
    rows = [(1, 0, "system", "be | kind & [INST]"), (1, 1, "user", None), (1, 2, None, "<|x|>\n&lt;</s>"), (1, 3, "assistant", ""),
            (2, 0, "user", ""), (None, None, None, None), (None, 4, "assistant", "a"), (3, 5, "assistant", "t"), (3, 5, "assistant", "t"),
            (3, -2, "tool|>\n", "&amp;lt;")]
    rows += [(4, t, ("system", "user", "assistant")[min(t, 1 + (t + 1) % 2)], say(1 + 37 * t % 90)) for t in range(700)]
    rows += [(5, 0, "system", say(30)), (5, 1, "user", say(4000)), (5, 2, "assistant", say(10)), (5, 3, "user", say(600)), (5, 4, "assistant", say(5))]
    return rows


@pytest.mark.parametrize("which", ["odd", "small", "none"])
def test_chat_round_trip(spark, run, which):
    schema = "conv_id long, turn long, role string, text string"
    df = (spark.read.parquet("/root/testdata/sf0.001/conversations.parquet") if which == "small"
          else spark.createDataFrame(odd_turns() if which == "odd" else [], schema))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in run("op10_chat_windows", conversations=df).collect()}
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], schema)
    assert got == digests(df.select("conv_id", "turn", "role", "text").union(extra).collect())


def test_chat_windows_keep_to_the_budget(spark):
    df = spark.createDataFrame(odd_turns(), "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(df, budget=256, history=64, chunk=16).filter("conv_id = 4").orderBy("window").collect()
    assert len(windows) > 50 and all(w.tokens <= 256 for w in windows)
    assert all(w.formatted.startswith("<|system|>") for w in windows) and sum(w.n_context > 1 for w in windows) > 20
    assert [w.first_turn for w in windows] == sorted(w.first_turn for w in windows)
    for w in windows:
        assert all(w.formatted[:a].endswith("<|assistant|>\n") and w.formatted[b:].startswith("</s>\n") for a, b in w.loss)
    digest = chat.conversation_digests(chat.chat_windows(df, budget=256, history=64, chunk=16)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digest} == digests(df.collect())


def test_native_plans_have_no_python(spark, run, odd):
    turns = spark.createDataFrame(odd_turns(), "conv_id long, turn long, role string, text string")
    for key in ("op2_jump_shards", "op3_pareto_mix", "op7_license_scan", "op9_quality_rules", "op10_chat_windows"):
        plan = run(key, documents=odd, conversations=turns)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan), key
