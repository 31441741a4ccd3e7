"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into spans of whole turns.  A window shows the system
turn, as much earlier history as fits, then its span; the loss mask covers the assistant texts of the
span, never those that are repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepframe.llm.common import n_words, same

#: A turn is written as OPEN role MIDDLE text CLOSE.  Neither role nor text holds "<", "|" or "[" then.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "</s>\n"
TURN = r"(?s)<\|([^|]*)\|>\n([^<]*)</s>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("|", "&bar;"), ("[", "&lsqb;"))

SUMS_CHUNK = 256


def escape(text: Column) -> Column:
    """The text without the characters that control strings need; ``unescape`` gives it back exactly."""
    out = F.coalesce(text, F.lit(""))
    for plain, coded in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _turns(conversations: DataFrame, chunk: int) -> DataFrame:
    """Rows (conv, idx, role, text, tokens, before): place and tokens before each turn, from sums of chunks.

    Only the ``chunk`` turn numbers of a chunk and one row per chunk meet in a window, so a very long
    conversation is spread over many tasks.  A leading system turn adds nothing to the sums.
    """
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("turn") / chunk).alias("chunk"))
    rows = rows.withColumn("tokens", n_words(F.col("text")) + 1)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    begins = rows.groupBy("conv", "chunk").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("conv").orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    begins = begins.select(F.col("conv").alias("conv_"), F.col("chunk").alias("chunk_"),
                           F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_"),
                           F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("sum_"))
    inside = Window.partitionBy("conv", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select("*", F.row_number().over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("k"),
                         F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("sum"))
    placed = placed.join(begins, same({"conv": "conv_", "chunk": "chunk_"}))
    turns = placed.select("conv", (F.col("n_") + F.col("k") - 1).alias("idx"), "role", "text", "tokens",
                          (F.col("sum_") + F.col("sum")).alias("before"))
    lead = turns.filter((F.col("idx") == 0) & (F.col("role") == "system")).select(
        F.col("conv").alias("conv_"), F.col("text").alias("system"), F.col("tokens").alias("lead"))
    free = F.coalesce("lead", F.lit(0))
    return turns.join(lead, same({"conv": "conv_"}), "left").select(
        "conv", "idx", "role", "text", "system", free.alias("lead"),
        F.when(F.col("lead").isNotNull() & (F.col("idx") == 0), F.lit(0).cast("long")).otherwise(F.col("tokens")).alias("tokens"),
        F.when(F.col("idx") == 0, F.lit(0).cast("long")).otherwise(F.col("before") - free).alias("before"))


def chat_windows(conversations: DataFrame, budget: int = 2048, history: int = 512, target: str = "assistant",
                 chunk: int = SUMS_CHUNK) -> DataFrame:
    """Windows (conv_id, window, first_turn, n_context, n_turns, tokens, formatted, loss).

    Needs rows (conv_id, turn, role, text).  Turns follow by turn number, then role and text; a missing
    number comes first, a null role or text is empty, a null id is a conversation of its own, equal
    rows are turns of their own, an empty table gives none.  A turn counts its words and one token.

    A span holds the turns that begin in the same half budget, so system turn, span and history stay
    below ``budget`` unless a single turn is longer than what is left of half of it; turns are never
    cut or left out.  ``n_context`` turns at the window's start are repeated: the system turn, then
    the last turns before the span that fit ``history`` and the budget.  ``loss`` lists (start, end) in
    code points of ``formatted`` of the span's target texts.  Windows of one conversation are numbered
    from 0, not always without a gap.
    """
    span = max(1, budget // 2)
    turns = _turns(conversations, chunk).withColumn("window", F.floor(F.col("before") / span))
    spans = turns.groupBy("conv", "window").agg(
        F.min("idx").alias("first"), F.min("before").alias("begin"), F.sum("tokens").alias("sum"), F.max("lead").alias("lead"))
    room = F.greatest(F.lit(0), F.least(F.lit(history), F.lit(budget) - F.col("lead") - F.col("sum")))
    spans = spans.select(F.col("conv").alias("conv_"), F.col("window").alias("window_"), "first", "begin", room.alias("room"))
    body = F.struct(F.lit(1).alias("part"), F.col("idx"), F.col("role"), F.col("text"), F.col("tokens")).alias("turn")
    new = turns.select("conv", "window", body)
    # The begins of windows that repeat a turn lie within ``history`` behind it.
    later = turns.filter(~((F.col("idx") == 0) & F.col("system").isNotNull())).withColumn(
        "window", F.explode(F.sequence(F.col("window") + 1, F.col("window") + 1 + history // span)))
    again = later.join(spans, same({"conv": "conv_", "window": "window_"})).filter(
        F.col("begin") - F.col("before") <= F.col("room")).select(
        "conv", "window", F.struct(F.lit(0).alias("part"), F.col("idx"), F.col("role"), F.col("text"), F.col("tokens")).alias("turn"))
    head = turns.join(spans, same({"conv": "conv_", "window": "window_"})).filter(
        (F.col("idx") == F.col("first")) & F.col("system").isNotNull() & (F.col("window") > 0)).select(
        "conv", "window", F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("idx"), F.lit("system").alias("role"),
                                   F.col("system").alias("text"), F.col("lead").alias("tokens")).alias("turn"))
    windows = new.unionByName(again).unionByName(head).groupBy("conv", "window").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return _written(windows, target)


def _written(windows: DataFrame, target: str) -> DataFrame:
    piece = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(CLOSE))
    pieces = windows.withColumn("pieces", F.transform("turns", lambda t: F.struct(
        piece(t).alias("text"), (F.length(escape(t["role"])) + len(OPEN) + len(MIDDLE)).alias("skip"),
        F.length(escape(t["text"])).alias("size"), ((t["part"] == 1) & (t["role"] == target)).alias("loss"))))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(s: Column, p: Column) -> Column:
        start = s["at"] + p["skip"]
        return F.struct((s["at"] + F.length(p["text"])).alias("at"), F.when(p["loss"], F.concat(s["spans"], F.array(
            F.struct(start.alias("start"), (start + p["size"]).alias("end"))))).otherwise(s["spans"]).alias("spans"))

    count = lambda test: F.size(F.filter("turns", test))
    return pieces.select(
        F.col("conv").alias("conv_id"), "window", F.filter("turns", lambda t: t["part"] == 1)[0]["idx"].alias("first_turn"),
        count(lambda t: t["part"] < 1).alias("n_context"), F.size("turns").alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("tokens"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.aggregate("pieces", state, add, lambda s: s["spans"]).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted window, unescaped."""
    roles, texts = (F.regexp_extract_all(formatted, F.lit(TURN), F.lit(k)) for k in (1, 2))
    return F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")),
                       lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text")))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold: counts and digests of the turns and of the text under the loss mask.

    A digest is over one whole conversation, so the texts of a conversation meet in one row.
    """
    new = F.filter(read_turns(F.col("formatted")), lambda t, i: i >= F.col("n_context"))
    told = F.transform("new", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    rows = windows.select("conv_id", "window", "formatted", "loss", new.alias("new")).select(
        "conv_id", "window", F.size("new").cast("long").alias("n"), F.array_join(told, "").alias("told"),
        F.array_join(learnt, "").alias("learnt"), F.length("formatted").cast("long").alias("chars"))
    parts = F.sort_array(F.collect_list(F.struct("window", "told", "learnt")))
    text = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), parts.alias("parts")).select(
        "conv_id", "n_turns", F.sha2(text("told"), 256).alias("turns_sha256"), F.length(text("learnt")).cast("long").alias("loss_chars"),
        F.sha2(text("learnt"), 256).alias("loss_sha256"), "formatted_chars")
