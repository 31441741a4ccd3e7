"""Registered queries of the operators that use DataFrame functions only: sharding, mixing, licences, quality, chat."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepframe.llm.chat import chat_windows, conversation_digests
from stepframe.llm.common import n_words
from stepframe.llm.licenses import license_scan
from stepframe.llm.mixing import mix_plan, uniform
from stepframe.llm.quality import quality_rules
from stepframe.llm.registry import query
from stepframe.llm.shards import assign_shards, shard_slots

SHARDS = 40
MIX_SEED = 11


@query("op2_jump_shards")
def jump_shards(table):
    """All documents in shards 0 to 39 by jump consistent hashing of the id."""
    text = F.coalesce("text", F.lit(""))
    rows = table("documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                                     F.crc32(text.cast("binary")).alias("text_crc32"))
    own = ["doc_id", "size", "text_crc32"]
    sharded = assign_shards(rows, "doc_id", SHARDS, grown="grown_shard")
    return shard_slots(sharded, "shard", own).select(
        *own, F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op3_pareto_mix", sql=r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE
           + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM s),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER e, 0) AS words,
             sum(weight) OVER () - coalesce(sum(weight) OVER e, 0) AS shares
      FROM w WINDOW e AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, most * shares <= words * weight AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN most::DOUBLE ELSE
        (sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN most END) OVER (), 0))::DOUBLE
        / (sum(CASE WHEN NOT capped THEN weight END) OVER ())::DOUBLE * weight::DOUBLE END AS target FROM c),
f AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS share FROM t),
g AS (SELECT *, floor(share)::BIGINT AS whole, target - floor(share) * source_size AS wanted,
             share > floor(share) AND floor(share) < 3 AS drawn FROM f),
h AS (SELECT g.source, d.size, wanted, d.size * count(*) AS words, sum(d.size::HUGEINT * d.size) AS squares
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source AND g.drawn GROUP BY g.source, d.size, wanted),
m AS (SELECT *, size > 0 AND (wanted - coalesce(sum(words) OVER (PARTITION BY source ORDER BY size DESC
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * size
               >= (sum(squares) OVER (PARTITION BY source ORDER BY size DESC
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS certain FROM h),
p AS (SELECT source, min(CASE WHEN certain THEN size END) AS certain_size,
             coalesce(sum(CASE WHEN certain THEN words END), 0) AS certain_words,
             (sum(CASE WHEN NOT certain THEN squares END))::DOUBLE AS squares, max(wanted) AS wanted FROM m GROUP BY source),
q AS (SELECT d.doc_id, d.size, d.u, g.source, g.source_size, g.target, g.whole, g.wanted, g.drawn, p.certain_words,
             coalesce(g.drawn AND d.size >= p.certain_size, false) AS certain,
             CASE WHEN squares > 0 THEN (p.wanted - certain_words) / squares ELSE 0.0 END * d.size AS chance
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN p ON p.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, CASE WHEN drawn AND NOT certain AND chance > 0
                     THEN u / (1 - u) / (chance / greatest(1 - chance, 1.1102230246251565e-16)) END AS rank FROM q),
r AS (SELECT *, sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id, size
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS cum FROM k)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN certain THEN 1
                        WHEN rank IS NOT NULL AND floor((wanted - certain_words - cum) / size + 0.5) >= 1 THEN 1
                        ELSE 0 END))::BIGINT AS taken
FROM r""")
def pareto_mix(table):
    """Words that the mix takes from each document, targets by source."""
    rows = table("documents").select("source", "doc_id", n_words(F.col("text")).alias("size"),
                                     uniform(MIX_SEED, F.col("doc_id"), F.col("text")).alias("u"))
    plan = mix_plan(rows)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    copies = F.col("sure") + F.when(F.col("nth") <= F.col("extra"), F.lit(1)).otherwise(F.lit(0))
    return plan.withColumn("nth", each).select("doc_id", "size", "source_size", "target",
                                               (F.col("size") * copies).alias("taken"))


@query("op7_license_scan")
def licenses(table):
    return license_scan(table("documents").select("doc_id", "text")).drop("text")


@query("op9_quality_rules")
def quality(table):
    return quality_rules(table("documents").select("doc_id", "text", "source")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


@query("op10_chat_windows")
def chat(table):
    """All conversations and one that is made of control strings, formatted and read back."""
    rows = table("conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    odd = rows.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), said.alias("text"))
    return conversation_digests(chat_windows(rows.unionByName(odd)))
