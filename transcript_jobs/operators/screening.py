"""Screening: parse what a model extracted, align it with its source, merge contexts, and route verdicts."""

from __future__ import annotations

import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transcript_jobs.functions.text import search_form, strip

# Phrases of outputs without findings, and greetings that are no findings.
NOTHING = ("該当なし", "見つかりません")
IGNORED = ("チャンネル登録", "高評価", "こんにちは", "さようなら", "ゆっくりしていってね")

ACCEPT, SURE = 0.65, 0.95


#: The decimal digits of all scripts, and those of ASCII that they stand for.
DIGITS = [c for c in map(chr, range(128, 0x20000)) if unicodedata.category(c) == "Nd"]
ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in DIGITS)


def digits_only(c: Column) -> Column:
    """The decimal digits of a text, of whatever script, in ASCII."""
    return F.regexp_replace(F.translate(c, "".join(DIGITS), ASCII_DIGITS), r"[^0-9]", "")


def parse_candidates(output: Column) -> Column:
    """Tagged findings as ``array<struct<quote, type, reason>>``, empty if the output says that there are none.

    A type without digits, or with more than an int holds, is 0.
    """
    field = lambda entry, tag: strip(F.regexp_extract(entry, rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    entries = F.regexp_extract_all(output, F.lit(r"(?s)<CANDIDATE>(.*?)</CANDIDATE>"), F.lit(1))
    number = lambda e: F.coalesce(digits_only(field(e, "TYPE")).try_cast("int"), F.lit(0))
    parsed = F.transform(entries, lambda e: F.struct(field(e, "QUOTE").alias("quote"), number(e).alias("type"), field(e, "REASON").alias("reason")))
    good = F.filter(parsed, lambda c: (c["quote"] != "") & ~c["quote"].rlike("|".join(IGNORED)))
    none = output.isNull() | output.rlike("|".join(NOTHING))
    return F.when(none, F.array().cast("array<struct<quote:string,type:int,reason:string>>")).otherwise(good)


def parse_status(output: Column) -> Column:
    none = output.isNull() | output.rlike("|".join(NOTHING)) | ~output.rlike(r"(?s)<CANDIDATE>.*?</CANDIDATE>")
    return F.when(none, "success_no_candidates").otherwise("success")


def candidate_rows(outputs: DataFrame, output: str = "output", least: int = 5) -> DataFrame:
    """One row for each finding with a quote of ``least`` characters or more; the other columns are kept."""
    rows = outputs.select("*", F.posexplode(parse_candidates(F.col(output))).alias("pos", "c")).select("*", "c.*").drop("c", output)
    return rows.where(F.length("quote") >= least)


def letter_counts(quote: str, sentences: list[str]) -> np.ndarray:
    """How often each sentence has each letter of the quote, a row for each sentence."""
    code = {c: k for k, c in enumerate(dict.fromkeys(quote))}
    flat = np.frombuffer("".join(sentences).encode("utf-32-le"), "<u4")
    known = np.array([ord(c) for c in code], np.uint32)
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], flat), len(known) - 1)
    hit = known[order][at] == flat
    row = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    return np.bincount(row[hit] * len(code) + order[at[hit]], minlength=len(sentences) * len(code)).reshape(len(sentences), len(code))


def shared_order(masks: dict[str, int], size: int, sentence: str) -> int:
    """How many letters a quote of ``size`` letters and a sentence share in the same order at most, from the places of the quote's letters as bits."""
    full = (1 << size) - 1
    row = full
    for c in sentence:
        if m := masks.get(c):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def best_ratio(quote: str, sentences: list[str], counts: np.ndarray, floor: float) -> tuple[float, int]:
    """The first sentence of the highest similarity ratio above ``floor``.

    Two bounds of a ratio keep most sentences from the matcher: the letters that both
    have, and those that they have in the same order, which no matching blocks exceed.
    Sentences come in descending order of the first, until none can be better.
    """
    if not sentences:
        return floor, -1
    of_quote = np.array(list(Counter(quote).values()))
    total = len(quote) + np.array([len(s) for s in sentences])
    bound = 2.0 * np.minimum(counts, of_quote).sum(axis=1) / total
    masks: dict[str, int] = {}
    for k, c in enumerate(quote):
        masks[c] = masks.get(c, 0) | 1 << k
    best, at = floor, -1
    for i in np.argsort(-bound, kind="stable").tolist():
        if bound[i] < best or bound[i] <= floor:
            break
        if sentences[i]:
            ordered = 2.0 * shared_order(masks, len(quote), sentences[i]) / total[i]
            if ordered < best or ordered <= floor:
                continue
            r = SequenceMatcher(None, quote, sentences[i]).ratio()
            if r > best or r == best and 0 <= i < at:
                best, at = r, i
    return best, at


def align_rest(quotes: pd.Series, sentences: pd.Series) -> pd.DataFrame:
    """Similarity of quotes that no sentence holds: single sentences first, then neighbours joined. Nulls, which need none, stay null."""
    rows = []
    for q, s in zip(quotes, sentences):
        if q is None or s is None:
            rows.append((None, None))
            continue
        s = list(s)
        counts = letter_counts(q, s)
        pairs = [a + b for a, b in zip(s, s[1:])]
        held = next((i for i, p in enumerate(pairs) if q in p), -1)
        # Two neighbours that hold the quote lose to a sentence that is sure alone, and to nothing else.
        score, at = best_ratio(q, s, counts, float(np.nextafter(SURE, 0)) if held >= 0 else 0.0)
        if held >= 0 and at < 0:
            score, at = 1.0, held
        elif score < SURE:
            pair_score, pair_at = best_ratio(q, pairs, counts[:-1] + counts[1:], score)
            if pair_at >= 0:
                score, at = pair_score, pair_at
        rows.append((score, at))
    return pd.DataFrame(rows, columns=["score", "at"]).astype({"score": "float64", "at": "Int32"})


def align_quotes(rows: DataFrame, quote: str = "quote", sentences: str = "sentences", window: int = 2) -> DataFrame:
    """Where each quote stands in its source's sentences: ``found, context, score, error``.

    A sentence that holds the normalised quote is found by built-in functions; only
    quotes that none holds go to the matcher, all in one pass. The context is ``window`` sentences
    before to ``window + 1`` after. The sentences travel with the row, so that there
    is no shuffle.
    """
    kept = rows.columns
    rows = rows.withColumn("_q", search_form(F.col(quote))).withColumn("_s", F.transform(F.col(sentences), search_form))
    rows = rows.withColumn("_hit", F.array_position(F.transform("_s", lambda s: (s != "") & s.contains(F.col("_q"))), True).cast("int") - 1)
    empty, hit = F.coalesce(F.col("_q") == "", F.lit(True)), F.coalesce(F.col("_hit") >= 0, F.lit(False))
    asks = ~empty & ~hit
    both = rows.withColumn("_r", F.pandas_udf(align_rest, "score double, at int")(F.when(asks, F.col("_q")), F.when(asks, F.col("_s"))))
    score = F.when(asks, F.col("_r")["score"]).when(hit & ~empty, F.lit(1.0))
    at = F.when(asks, F.col("_r")["at"]).when(hit & ~empty, F.col("_hit"))
    found = F.coalesce((score >= ACCEPT) & (at >= 0), F.lit(False))
    error = F.when(F.coalesce(F.col("_q") == "", F.lit(True)), "quote_empty").when(~found, "low_confidence_match")
    return both.select(*kept, found.alias("found"), F.when(found, context_window(F.col(sentences), at, window)).otherwise("").alias("context"), score.alias("score"), error.alias("error"))


def context_window(sentences: Column, at: Column, window: int = 2) -> Column:
    start = F.greatest(at - window, F.lit(0))
    stop = F.least(at + window + 2, F.size(sentences))
    return F.array_join(F.slice(sentences, start + 1, F.greatest(stop - start, F.lit(0))), "")


def with_context(aligned: DataFrame, chunk: str = "chunk_text") -> DataFrame:
    """Candidates with the found context, or the whole chunk and a flag that the context has to be checked."""
    return aligned.select("*", F.when(F.col("found"), F.col("context")).otherwise(F.col(chunk)).alias("context_step2"), (~F.col("found")).alias("requires_full_context_check"), F.col("error").alias("lookup_error"))


def screening_records(videos: DataFrame, candidates: DataFrame) -> DataFrame:
    """One record for each video with its candidates in order of chunk and place; videos without any have a count of 0."""
    fields = ["source_chunk_idx", "pos", "type", "reason", "quote", "context_step2", "lookup_error", "requires_full_context_check"]
    grouped = candidates.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("candidates"))
    joined = videos.select("video_id", "label").join(grouped, "video_id", "left")
    return joined.select("video_id", "label", F.coalesce(F.size("candidates"), F.lit(0)).alias("flagged_count"), F.coalesce("candidates", F.array().cast(grouped.schema["candidates"].dataType)).alias("candidates"))


#: Of the places of a merged text every so manieth is indexed.
STRIDE = 8


def overlap(text: str, part: str, least: int) -> int:
    """The most characters, ``least`` or more, that end ``text`` and start ``part``; 0 if there are fewer.

    A first search leaves out what cannot begin an overlap. From there each character
    of the end extends the longest start of ``part`` that ends with it, or falls back
    to the next shorter one, so that the time grows with the length alone.
    """
    end = text[max(len(text) - len(part), 0) :]
    at = end.find(part[:least])
    if at < 0 or len(part) < least:
        return 0
    end = end[at:]
    start = part[: len(end)]
    shorter, k = [0] * len(start), 0
    for i in range(1, len(start)):
        while k and start[i] != start[k]:
            k = shorter[k - 1]
        k += start[i] == start[k]
        shorter[i] = k
    k = 0
    for c in end:
        while k and (k == len(start) or start[k] != c):
            k = shorter[k - 1]
        k += start[k] == c
    return k if k >= least else 0


def merge_fragments(fragments: list[str], least: int = 10, gap: str = "\n……\n") -> str:
    """Fragments in order, without repeats and contained ones, joined where an end and a start overlap by ``least`` characters or more."""
    merged, seed, done = "", max(1, least), 0
    # Where every STRIDE-th run of ``seed`` characters begins, so that a fragment is compared at few places of a long text.
    places: dict[str, list[int]] = {}
    held = lambda part: any(merged.startswith(part, at - o) for o in range(STRIDE) for at in places.get(part[o : o + seed], ()) if at >= o)
    for k, part in enumerate(dict.fromkeys(fragments)):
        if not k:
            merged = part
        elif part in merged if len(part) < seed + STRIDE else held(part):
            continue
        else:
            n = overlap(merged, part, seed)
            merged += part[n:] if n else gap + part
        for at in range(done, len(merged) - seed + 1, STRIDE):
            places.setdefault(merged[at : at + seed], []).append(at)
            done = at + STRIDE
    return merged


def merged(fragments: Column, least: int = 10) -> Column:
    return F.pandas_udf(lambda c: c.map(lambda x: merge_fragments(list(x) if x is not None else [], least)), "string")(F.array_distinct(fragments))


def route(records: DataFrame, videos: DataFrame, order: str = "ord") -> DataFrame:
    """What each record is judged by: ``video_id, ground_truth, logic_type, context, step1_flagged_count``.

    Nothing flagged is real at once; trusted contexts are merged; without one the
    whole transcript counts, and also if the merged context is blank. Of several
    videos of an id the last holds; records without a video are left out.
    """
    last = videos.groupBy("video_id").agg(F.max_by(F.struct("label", "transcript"), F.col(order)).alias("v"))
    joined = records.select("video_id", "flagged_count", "candidates").join(last, "video_id")
    trusted = F.filter("candidates", lambda c: ~F.coalesce(c["requires_full_context_check"], F.lit(False)))
    contexts = F.transform(trusted, lambda c: F.coalesce(c["context_step2"], F.lit("")))
    joined = joined.withColumn("_parts", contexts)
    some = (F.col("flagged_count") > 0) & (F.size("_parts") > 0)
    both = joined.withColumn("_merged", merged(F.when(some, F.col("_parts")))).withColumn("_merged", F.when(some, F.col("_merged")))
    flagged, has = F.col("flagged_count") > 0, F.col("_merged").isNotNull()
    blank = has & (strip(F.col("_merged")) == "")
    empty_full = ~has & (strip(F.coalesce(F.col("v.transcript"), F.lit(""))) == "")
    logic = F.when(~flagged, "auto_real_step1").when(blank | empty_full, "llm_full_transcript_fallback").when(has, "llm_partial_context").otherwise("llm_full_transcript")
    context = F.when(~flagged, "").when(has & ~blank, F.col("_merged")).otherwise(F.coalesce(F.col("v.transcript"), F.lit("")))
    return both.select("video_id", F.col("v.label").alias("ground_truth"), logic.alias("logic_type"), context.alias("context"), F.col("flagged_count").alias("step1_flagged_count"))
