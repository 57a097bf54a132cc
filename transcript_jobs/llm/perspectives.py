"""Chat formatting by perspective rotation: each speaker in turn is the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The role that sets the scene: it is never a perspective and keeps its name.
SYSTEM = "system"


#: Turn numbers that are rendered together before a dialogue's pieces are joined.
PIECE = 256


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """Render every dialogue once for each participant, with that speaker as assistant.

    The speaker's own turns open with ``<|assistant|>``, other participants' with
    ``<|user:NAME|>``, the system's with ``<|system|>``; each ends with ``<|end|>``
    and a new line. ``mask`` holds the spans to learn from, as character offsets
    ``start`` and ``stop`` (exclusive) in ``rendered``: the text and end mark of the
    assistant's turns.

    Returns ``conv_id, perspective, n_turns, rendered, mask``, a row for each
    conversation and participant, with the whole dialogue. Turns are rendered in
    pieces of ``piece`` consecutive turn numbers, which tasks share, and a dialogue's
    pieces are then joined; ``piece`` has no effect on the result.

    In texts and names ``<|`` becomes ``< |`` and ``|>`` becomes ``| >``: no words of a
    participant can end a turn or begin one. Null texts are empty; null speakers are named ``unknown``; null turns come first;
    rows of one turn are ordered by speaker and text, repeated rows stay. A row with a
    null conversation belongs to no other: it is a dialogue of its own. A conversation
    of system turns alone has no participant and no row. Other columns are ignored; an
    empty table gives no rows.
    """
    lines = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        _unmarked(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )
    named = lines.where(F.col("conv_id").isNotNull())
    people = named.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    seen = named.join(people, "conv_id").select("conv_id", "perspective", F.coalesce(F.floor(F.col("turn") / piece), F.lit(-(2**62))).cast("long").alias("piece"), _line())
    pieces = seen.groupBy("conv_id", "perspective", "piece").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    pieces = pieces.select("conv_id", "perspective", F.struct("piece", F.size("lines").alias("n"), _rendered().alias("rendered"), _mask().alias("mask")).alias("part"))
    whole = pieces.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    # Spans of a piece move by the length of all pieces before it.
    moved = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,stop:int>>>").alias("mask")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["rendered"])).alias("at"),
            F.array_append(s["mask"], F.transform(p["mask"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), (x["stop"] + s["at"]).alias("stop")))).alias("mask"),
        ),
        lambda s: F.flatten(s["mask"]),
    )
    whole = whole.select(
        "conv_id",
        "perspective",
        F.aggregate("parts", F.lit(0), lambda n, p: n + p["n"]).alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("rendered"),
        moved.alias("mask"),
    )
    alone = lines.where(F.col("conv_id").isNull() & (F.col("speaker") != SYSTEM)).withColumn("perspective", F.col("speaker"))
    alone = alone.select("conv_id", "perspective", F.array(_line()).alias("lines")).select("conv_id", "perspective", F.size("lines").alias("n_turns"), _rendered().alias("rendered"), _mask().alias("mask"))
    return whole.union(alone)


def _unmarked(c: Column) -> Column:
    """With a blank in what opens or closes a mark, so that a text or a name makes no turn."""
    return F.replace(F.replace(c, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def _line() -> Column:
    """A turn with its opening mark as the perspective has it, in the order of turns."""
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>")).when(F.col("speaker") == SYSTEM, F.lit("<|system|>")).otherwise(F.concat(F.lit("<|user:"), _unmarked(F.col("speaker")), F.lit("|>")))
    return F.struct("turn", "speaker", "text", head.alias("head"), own.alias("own")).alias("line")


def _rendered() -> Column:
    return F.array_join(F.transform("lines", lambda x: F.concat(x["head"], x["text"], F.lit("<|end|>\n"))), "")


def _mask() -> Column:
    """The spans of the perspective's own turns among ``lines``."""
    begin = lambda s, x: s["at"] + F.length(x["head"])
    span = lambda s, x: F.struct(begin(s, x).alias("start"), (begin(s, x) + F.length(x["text"]) + 7).alias("stop"))
    return F.aggregate(
        "lines",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("mask")),
        lambda s, x: F.struct(
            (begin(s, x) + F.length(x["text"]) + 8).alias("at"),
            F.when(x["own"], F.array_append(s["mask"], span(s, x))).otherwise(s["mask"]).alias("mask"),
        ),
        lambda s: s["mask"],
    )
