"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

Frequencies are dealt out by pre-token, so the join needs no table of all pre-tokens, and go back to
their documents as sums.  Ids of pieces are never kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.llm.frequencies import document_sums, token_frequencies

#: No piece has a blank behind another character or a line feed: a pre-token is a run of blanks with
#: what follows, or a line feed with what follows.  The model puts a blank before each text.
PRE_TOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")

#: Rows of a pre-token that more documents of a batch hold are dealt to so many tasks.
MANY, PARTS = 2000, 64


@lru_cache(maxsize=2)
def processor(model: str):
    """The piece model, loaded once per worker process.

    Its pieces must keep to the pre-tokens; a model with other pieces is refused.
    """
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=model)
    for i in range(found.get_piece_size()):
        piece = found.id_to_piece(i)
        if re.search("[^▁]▁|\n", piece):
            raise ValueError(f"piece {piece!r} spans pre-tokens")
    if found.encode("a  b ", out_type=str)[0][0] != "▁":
        raise ValueError("the model must put a blank before a text and keep white space")
    return found


def pre_tokens(text: str) -> list[str]:
    return PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []


def piece_counts(found, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token inside a text.

    The blank that the model adds is the token's own first blank, or is taken off again before a line
    feed, where it always makes a piece of its own.
    """
    pieces = found.encode([t[1:] if t[0] == " " else t for t in tokens], num_threads=1)
    return [max(1, len(p)) if t[0] == " " else len(p) - 1 for t, p in zip(tokens, pieces)]


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one per row of ``docs``.

    Needs ``doc_id`` and ``text``; nothing else is read.  A null text counts as empty, an empty text has
    no tokens, ids may be null or repeated (each row counts by itself), an empty table gives none.
    Rows of one pre-token meet in one task, which counts its pieces once; one that very many documents
    hold is dealt to some tasks more, by batch.
    """
    @F.pandas_udf("int")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for tokens in batches:
            new = list({t for t in tokens if t not in known})
            known.update(zip(new, piece_counts(processor(model), new)))
            yield tokens.map(known).astype("int32")

    frequencies = token_frequencies(docs.select("doc_id", "text", F.lit(False).alias("mark")),
                                    lambda texts: [pre_tokens(t) for t in texts], lambda t, n: len(t.encode()))
    part = F.when(F.size("places") > MANY, F.pmod(F.xxhash64("base"), F.lit(PARTS))).otherwise(F.lit(0))
    dealt = frequencies.select("token", "base", "places", "counts", "documents").repartition("token", part)
    sums = document_sums(dealt.withColumn("pieces", pieces("token")), n_tokens=F.col("pieces"))
    return sums.select("doc_id", F.col("size").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
