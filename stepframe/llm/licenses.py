"""Licence scan over a positional index of rare licence words.

The index holds, for each notice, the two words of its mandatory phrases that are rarest in the corpus, with
their offsets.  A file's words are looked up in it; each posting proposes the place where its notice
would begin, and only places that both words of a notice propose go on.  There the mandatory phrases have
to stand in full, and enough of the notice's IDF at the right offsets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.llm.common import let, with_new

#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases of the base rule with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices by label: the words of the notice, and the phrases in it that have to stand in full.
TEMPLATES = (
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is",
     ("with or without fee is hereby granted the software is provided",)),
    ("afl-3.0", "licensed under the academic free license version 3 0", ("academic free license version 3 0",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("agpl-3.0", "gnu affero general public license as published by the free software foundation either version 3 of the license",
     ("affero general public license as published", "either version 3")),
    ("apache-1.1", "licensed under the apache software license version 1 1", ("apache software license version 1 1",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
     ("www apache org licenses license 2 0",)),
    ("artistic-2.0", "licensed under the artistic license 2 0", ("artistic license 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ("redistribution and use in source and binary forms",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
     ("redistributions in binary form must reproduce the above copyright notice",)),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission",
     ("endorse or promote products derived from this software",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license",
     ("creative commons attribution noncommercial 4 0 international",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license",
     ("creative commons attribution sharealike 4 0 international",)),
    ("cc0", "to the extent possible under law waived all copyright and related rights", ("waived all copyright",)),
    ("cddl-1.0", "subject to the terms of the common development and distribution license", ("common development and distribution license",)),
    ("epl-1.0", "eclipse public license v1 0", ("eclipse public license v1 0",)),
    ("epl-2.0", "eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("epl-2.0", "eclipse public license v 2 0", ("eclipse public license v 2 0",)),
    ("eupl-1.2", "licensed under the eupl version 1 2", ("eupl version 1 2",)),
    ("eupl-1.2", "licensed under the european union public licence version 1 2", ("european union public licence",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-2.0", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
     ("gnu general public license as published by the free software foundation either version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
     ("gnu general public license as published by the free software foundation either version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("copy modify and or distribute",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("lgpl", "gnu library general public license as published by the free software foundation", ("library general public license",)),
    ("mit", "released under the mit license", ("the mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
     ("this permission notice shall be included",)),
    ("mpl-1.1", "subject to the mozilla public license version 1 1", ("mozilla public license version 1 1",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("ms-pl", "licensed under the microsoft public license ms pl", ("microsoft public license",)),
    ("odbl-1.0", "made available under the open database license", ("open database license",)),
    ("ofl-1.1", "licensed under the sil open font license version 1 1", ("sil open font license",)),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement",
     ("without fee and without a written agreement",)),
    ("python-2.0", "python software foundation license version 2", ("python software foundation license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("wtfpl", "do what the fuck you want to public license", ("do what the fuck you want to",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages",
     ("in no event will the authors be held liable",)),
    ("zpl-2.1", "subject to the provisions of the zope public license version 2 1", ("zope public license",)),
)

#: Identifiers of one-line tags ("SPDX-License-Identifier: MIT"): the tag's words are all mandatory.
TAG = "spdx license identifier"
TAGGED = ("0BSD", "AFL-3.0", "AGPL-3.0", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0",
          "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-3.0",
          "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "MS-PL", "ODbL-1.0", "OFL-1.1", "PostgreSQL", "Unlicense",
          "WTFPL", "Zlib")


def licence_words(text: Column) -> Column:
    """Words of the text with A-Z in lower case: runs of digits, letters and everything beyond ASCII.

    Letters beyond ASCII get lower case too, which moves no word and makes none of the notices' words:
    the Kelvin sign is the only one that would become an ASCII letter alone, and is taken out first.
    """
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u043a")))
    return F.array_remove(F.split(lower, BETWEEN), "")


@dataclass(frozen=True)
class Notice:
    label: str
    words: tuple[str, ...]
    #: Which of the words have to stand in their place.
    must: tuple[bool, ...]
    base: bool


def _notice(label: str, text: str, phrases: Sequence[str], base: bool = False) -> Notice:
    words, must = tuple(text.split()), set()
    for phrase in phrases:
        key = tuple(phrase.split())
        at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        must.update(range(at, at + len(key)))
    return Notice(label, words, tuple(i in must for i in range(len(words))), base)


def notices() -> list[Notice]:
    tags = [(i.lower(), f"{TAG} {' '.join(re.split(BETWEEN, i.lower()))}") for i in TAGGED]
    return ([_notice(label, phrase, [phrase], True) for phrase, label in BASE] + [_notice(*t) for t in TEMPLATES]
            + [_notice(label, text, [text]) for label, text in tags])


def document_frequencies(texts: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of texts, and of those that hold each word of the notices: one row for each such word."""
    vocabulary = sorted({w for n in notices() for w in n.words})
    present = F.array_distinct(F.filter(licence_words(F.col("text")), lambda w: w.isin(vocabulary)))
    found = texts.select(F.explode_outer(present).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    return texts.count(), {r["word"]: r["n"] for r in found if r["word"] is not None}


def rare_words(notice: Notice, idf: Mapping[str, float]) -> list[int]:
    """Offsets of the notice's two mandatory words of highest IDF, the rarest one first."""
    return sorted((i for i, m in enumerate(notice.must) if m), key=lambda i: (-idf[notice.words[i]], i))[:2]


def _postings(listed: Sequence[Notice], idf: Mapping[str, float], rank: int) -> dict[str, list[int]]:
    """By word the codes ``offset * len(listed) + notice`` of the notices whose rarest word (rank 0) or second one (1) it is."""
    out: dict[str, list[int]] = {}
    for t, notice in enumerate(listed):
        at = rare_words(notice, idf)[rank]
        out.setdefault(notice.words[at], []).append(at * len(listed) + t)
    return out


def _array(values: Iterable) -> str:
    """A constant array as SQL; words are digits, letters and characters beyond ASCII, so they need no escapes."""
    return "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v).lower() for v in values) + ")"


def _proposals(ws: Column, index: Mapping[str, list[int]], n: int) -> Column:
    """Codes ``start * n + notice`` of the places that the index's words in ``ws`` propose."""
    words = sorted(index)
    table = F.expr(f"map_from_arrays({_array(words)}, array({', '.join(_array(index[w]) for w in words)}))")
    hits = F.filter(F.transform(ws, lambda w, i: F.struct(F.when(w.isin(words), w).alias("word"), i.alias("at"))),
                    lambda h: h["word"].isNotNull())
    # A code less the offset's share of it is the code of the start.
    return F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(table, h["word"]), lambda p: (
        h["at"].cast("long") * n - F.floor(p / n) * n + F.pmod(p, F.lit(n))).cast("long"))))


def license_scan(docs: DataFrame, idf: Mapping[str, float] | None = None, support: float = 0.5) -> DataFrame:
    """``docs`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    Needs ``text``.  ``n_base`` counts the places of the base phrases and first and last word are their
    least and largest start; labels are distinct, sorted and joined by commas, empty without any.
    ``score`` is 1 with a base phrase, else the largest share of a notice's IDF found in place.  IDF is
    counted over all texts unless given.  A null or empty text has no words and no labels.  Other
    columns go along whatever their names; an empty table stays empty.  Each row is looked up by
    itself: nothing is shuffled but the counts of the licence words.
    """
    if idf is None:
        total, found = document_frequencies(docs.select("text"))
        idf = {w: math.log(1 + (total + 1) / (found.get(w, 0) + 0.5)) for x in notices() for w in x.words}
    listed = notices()
    first, second = (_postings(listed, idf, rank) for rank in (0, 1))
    n = len(listed)
    bodies = F.expr("array(" + ", ".join(
        f"named_struct('label', '{x.label}', 'words', {_array(x.words)}, 'must', {_array(x.must)}, 'idf', "
        f"{_array(float(idf[w]) for w in x.words)}, 'whole', {float(sum(idf[w] for w in x.words))}D, 'lead', {x.must.index(True)}, "
        f"'support', {0.0 if x.base else float(support)}D, 'base', {str(x.base).lower()})" for x in listed) + ")")

    def place(ws: Column, code: Column) -> Column:
        start, notice = F.floor(code / n).cast("int"), F.get(bodies, F.pmod(code, F.lit(n)).cast("int"))

        def at(x: Column, begin: Column) -> Column:
            # Offsets before the text's first word have none.
            same = F.transform(x["words"], lambda w, i: F.coalesce(
                (begin + i >= 0) & (F.get(ws, F.greatest(begin + i, F.lit(0))) == w), F.lit(False)))

            def told(hit: Column) -> Column:
                whole = F.forall(F.transform(x["must"], lambda m, i: ~m | F.get(hit, i)), lambda ok: ok)
                got = F.aggregate(F.transform(x["idf"], lambda v, i: F.when(F.get(hit, i), v).otherwise(F.lit(0.0))),
                                  F.lit(0.0), lambda s, v: s + v)
                return F.struct(whole.alias("whole"), (got / x["whole"]).alias("share"), (begin + x["lead"]).alias("at"),
                                x["label"].alias("label"), x["base"].alias("base"), x["support"].alias("support"))
            return let(same, told)
        return let(notice, lambda x: let(start, lambda begin: at(x, begin)))

    def scan(ws: Column) -> Column:
        met = F.array_intersect(_proposals(ws, first, n), _proposals(ws, second, n))
        found = F.filter(F.transform(met, lambda code: place(ws, code)), lambda x: x["whole"] & (x["share"] >= x["support"]))
        return let(found, lambda xs: F.struct(F.size(ws).cast("long").alias("n"), F.filter(xs, lambda x: x["base"]).alias("base"),
                                              F.filter(xs, lambda x: ~x["base"]).alias("own")))

    got = docs.withColumn("__llm_scan", let(licence_words(F.col("text")), scan))
    base, own = F.col("__llm_scan.base"), F.col("__llm_scan.own")
    names = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    score = F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(
        F.array_max(F.transform(own, lambda x: x["share"])), F.lit(0.0))))
    at = F.transform(base, lambda x: x["at"].cast("long"))
    return with_new(got, n_words=F.col("__llm_scan.n"), n_base=F.size(base).cast("long"), first_word=F.array_min(at),
                    last_word=F.array_max(at), base_labels=names(base), labels=names(F.concat(base, own)), score=score)
