"""Registered queries of repeated substrings, collocations and hard negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepframe.llm.collocations import collocations
from stepframe.llm.negatives import hard_negatives
from stepframe.llm.registry import query
from stepframe.llm.substrings import remove_repeats


@query("op11_repeated_substrings")
def repeats(table):
    return remove_repeats(table("documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_collocations", sql=r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT lang, k, ws[i:i + k - 1] AS ws, count(*) AS f FROM t, (SELECT unnest(range(1, 6)) AS k)
      WHERE i + k - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k AS size, ws, f AS a FROM f WHERE k > 1 AND f >= 100),
u AS (SELECT *, unnest(range(1, size)) AS cut FROM c),
s AS (SELECT u.lang, u.size, u.ws, u.a, u.cut, x.f AS l, y.f AS r, n.n,
             (1000::HUGEINT * u.a * n.n) // (x.f::HUGEINT * y.f) AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.ws = u.ws[1:cut] JOIN f y ON y.lang = u.lang AND y.ws = u.ws[cut + 1:]
             JOIN n ON n.lang = u.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1),
b AS (SELECT lang, ws[i:i + k - 1] AS ws, max(a) AS around
      FROM (SELECT lang, ws, a, size, k, unnest(range(1, size - k + 2)) AS i
            FROM (SELECT *, unnest(range(2, size)) AS k FROM c)) GROUP BY ALL),
z AS (SELECT m.lang, array_to_string(m.ws, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
      FROM m LEFT JOIN b ON b.lang = m.lang AND b.ws = m.ws WHERE around IS NULL OR 100 * around < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM z QUALIFY rank <= 2000""")
def phrases(table):
    return collocations(table("documents").select("lang", "text"))


@query("op13_hard_negatives", sql=r"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS vector
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row, a.vec_id AS anchor_id, a.label = b.label AS same, b.row AS other, b.vec_id AS id,
             list_inner_product(a.vector, b.vector)::BIGINT AS score
      FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 100 = 0),
p AS (SELECT row, anchor_id, other, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY row, p.other ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (row, anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""")
def mined(table):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vector = F.when(~bad, F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)))
    return hard_negatives(table("embeddings").select("vec_id", label.alias("label"), vector.alias("vector")), F.col("vec_id") % 100 == 0)
