"""Model stages: batched calls of a user's function, and results kept by content."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def generate(prompts: DataFrame, model: Callable[[list], list], prompt_col: str = "prompt", on_error: str | None = None, fallback_col: str | None = None, parts: int | None = None) -> DataFrame:
    """``prompts`` with ``output`` and ``error``: the model's answer for each prompt, a batch at a time.

    A batch that fails is tried row by row, so that one bad prompt costs one row: its
    output is ``on_error`` or the text of ``fallback_col``, and its error is kept.
    With ``parts`` rows are first dealt out over as many tasks, as calls cost far more
    than rows weigh; without, they stay where they are.
    """
    dealt = prompts.repartition(parts) if parts else prompts

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = list(frame[prompt_col])
            try:
                out, errors = list(model(asked)), [None] * len(asked)
            except Exception:
                out, errors = [], []
                for k, one in enumerate(asked):
                    try:
                        out.append(model([one])[0])
                        errors.append(None)
                    except Exception as e:
                        out.append(frame[fallback_col].iloc[k] if fallback_col else on_error)
                        errors.append(str(e))
            yield frame.assign(output=out, error=errors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema if f.name not in ("output", "error"))
    return dealt.mapInPandas(run, f"{fields}, output string, error string")


def hashed_embedding(words: Column, size: int = 32) -> Column:
    """A stand-in embedding: counts of words by hash, scaled to length 1 (all zero without words)."""

    def run(lists: pd.Series) -> pd.Series:
        out = []
        for words in lists:
            slots = [zlib.crc32(w.encode()) % size for w in (words if words is not None else [])]
            counts = np.bincount(slots, minlength=size).astype(float) if slots else np.zeros(size)
            out.append(counts / max(np.sqrt((counts * counts).sum()), 1e-300))
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")(words)


def embed(df: DataFrame, model: Callable[[list[str]], list[list[float]]], text_col: str = "text", out: str = "embedding", normalise: bool = False, batch: int = 8) -> DataFrame:
    """``df`` with the model's vectors, asked for ``batch`` texts at a time, null texts as empty; ``normalise`` scales them to length 1, but for zero vectors."""

    def scaled(v: list[float]) -> np.ndarray:
        v = np.asarray(v, float)
        return v / (np.sqrt((v * v).sum()) or 1.0) if normalise else v

    def run(texts: pd.Series) -> pd.Series:
        asked = ["" if t is None else t for t in texts]
        return pd.Series([scaled(v) for i in range(0, len(asked), batch) for v in model(asked[i : i + batch])])

    return df.withColumn(out, F.pandas_udf(run, "array<double>")(F.col(text_col)))


def content_key(prefix: str, version: str, *columns: str) -> Column:
    """Prefix, version and the SHA-1 of the columns as JSON with sorted names."""
    payload = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(f"{prefix}_{version}_"), F.sha1(payload))


def with_cache(rows: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "key", value: str = "output") -> tuple[DataFrame, DataFrame]:
    """``rows`` with a value from the cache (key, value), or computed where it has none, and the new entries.

    A null value in the cache counts as missing. Each missing key is computed once.
    """
    good = cache.where(F.col(value).isNotNull()).select(key, value).dropDuplicates([key])
    missing = rows.join(good, key, "left_anti").dropDuplicates([key])
    new = compute(missing).select(key, value)
    return rows.join(good.unionByName(new), key, "left"), new


def parameter_grid(docs: DataFrame, models: list[str], rates: list[float]) -> DataFrame:
    """Every document under every model and rate; the grid is a literal, so nothing is broadcast or shuffled."""
    grid = F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(m).alias("model_name"), F.lit(r).alias("compression_rate")) for i, (m, r) in enumerate((m, r) for m in models for r in rates)])
    return docs.select("*", F.inline(grid))
