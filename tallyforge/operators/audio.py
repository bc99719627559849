"""Waveforms: reading WAV bytes, chunking, evenly spaced crops, padding."""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .streams import draw

RATE = 16_000


def decode_wav(data: bytes) -> list[float]:
    """Mono float samples; an error for other rates; values that are no number become 0."""
    with wave.open(io.BytesIO(data)) as f:
        if f.getframerate() != RATE:
            raise ValueError(f"{f.getframerate()} Hz, {RATE} expected")
        kind = {1: np.uint8, 2: np.int16, 4: np.int32}[f.getsampwidth()]
        raw = np.frombuffer(f.readframes(f.getnframes()), kind).astype(np.float64)
        raw = (raw - 128) / 128 if kind is np.uint8 else raw / float(np.iinfo(kind).max + 1)
        return np.nan_to_num(raw.reshape(-1, f.getnchannels()).mean(axis=1)).tolist()


@pandas_udf(T.ArrayType(T.DoubleType()))
def samples(data: pd.Series) -> pd.Series:
    return data.map(decode_wav)


def chunk_count(length: Column, chunk: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.greatest(length, F.lit(1)) / chunk)).cast("int")


def chunk_spans(rows: DataFrame, length: str, chunk: int, most: int | None = None) -> DataFrame:
    """(chunk_idx, first, last) of each row; with `most` the first ones (evaluation mode)."""
    n = chunk_count(F.col(length), chunk)
    n = F.least(n, F.lit(most)) if most else n
    out = rows.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.withColumn("first", F.col("chunk_idx") * chunk).withColumn("last", F.least((F.col("chunk_idx") + 1) * chunk, F.col(length)))


def crop_starts(length: Column, crop: int, n: int) -> Column:
    """Starts of n crops spread evenly from the first to the last possible one, equal ones once."""
    room = F.greatest(length - crop, F.lit(0))
    if n == 1:
        return F.array(F.bround(room / 2.0, 0).cast("long"))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(room * i / float(n - 1), 0).cast("long")))


def padded(a: Column, width: Column) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0.0), F.greatest(width - F.size(a), F.lit(0)).cast("int")))


def centre_crop(a: Column, most: int) -> Column:
    start = F.floor(F.greatest(F.size(a) - most, F.lit(0)) / 2).cast("int") + 1
    return F.slice(a, start, F.lit(most))


def random_crop(a: Column, most: int, key: Column, seed: int) -> Column:
    """A stretch of at most `most` samples whose start hangs on key and seed, for training."""
    room = F.greatest(F.size(a) - most, F.lit(0))
    start = F.floor(draw(key, "crop", seed) * (room + 1)).cast("int") + 1
    return F.slice(a, start, F.lit(most))


def cropped_and_padded(a: Column, most: int, least: int, key: Column | None = None, seed: int = 0) -> Column:
    """The crop (random with a key, else the centre), filled up with zeros to `least`."""
    return padded(centre_crop(a, most) if key is None else random_crop(a, most, key, seed), F.lit(least))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def augmented(a: Column, key: Column, seed: int, gain: float = 0.0, noise: float = 0.0, dropout: float = 0.0) -> Column:
    """With the given probabilities a gain of -6 to 6 dB, normal noise at 10 to 30 dB below the signal and a silent stretch
    (for more than 4,000 samples); values are clipped to -1 .. 1. All draws hang on key and seed."""
    u = lambda *salt: draw(key, *salt, seed)
    factor = F.when(u("gain?") < gain, F.pow(F.lit(10.0), (u("gain") * 12 - 6) / 20)).otherwise(1.0)

    def normal(i: Column) -> Column:
        r, phi = (draw(F.concat_ws(":", key.cast("string"), i.cast("string")), t, seed) for t in ("r", "phi"))
        return F.sqrt(-2 * F.log(F.greatest(r, F.lit(1e-12)))) * F.cos(2 * F.lit(math.pi) * phi)

    def noisy(x: Column) -> Column:
        rms = F.sqrt(F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v) / F.greatest(F.size(x), F.lit(1))) + 1e-7
        level = F.when(u("noise?") < noise, rms / F.pow(F.lit(10.0), (10 + 20 * u("snr")) / 20)).otherwise(0.0)
        return _let(level, lambda t: F.when(t > 0, F.transform(x, lambda v, i: v + t * normal(i))).otherwise(x))

    def silenced(x: Column) -> Column:
        most = F.least(F.lit(4000), F.greatest(F.lit(401), F.floor(F.size(x) / 8)))
        width = 400 + F.floor(u("width") * (most - 400 + 1))
        ends = _let(width, lambda w: F.struct(F.floor(u("start") * (F.size(x) - w + 1)).alias("at"), w.alias("w")))
        hit = (u("dropout?") < dropout) & (F.size(x) > 4000)
        return _let(F.when(hit, ends), lambda e: F.transform(x, lambda v, i: F.when(e.isNotNull() & (i >= e["at"]) & (i < e["at"] + e["w"]), 0.0).otherwise(F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0)))))

    return _let(_let(_let(factor, lambda g: F.transform(a, lambda v: v * g)), noisy), silenced)


def batch_padded(rows: DataFrame, batch: str, samples_col: str) -> DataFrame:
    """rows with length and the samples filled up to the longest of their batch."""
    longest = rows.groupBy(batch).agg(F.max(F.size(samples_col)).alias("_longest"))
    out = rows.join(longest, batch).withColumn("length", F.size(samples_col))
    return out.withColumn(samples_col, padded(F.col(samples_col), F.col("_longest"))).drop("_longest")


def kept_batches(rows: DataFrame, step: str, rank: str, elements: str, limit: int) -> DataFrame:
    """(step, elements, skipped): a step is skipped on all ranks if the batch of any has more elements than the limit (0: none)."""
    sums = rows.groupBy(step, rank).agg(F.sum(elements).alias("_e")).groupBy(step).agg(F.max("_e").alias("elements"))
    return sums.withColumn("skipped", (F.col("elements") > limit) if limit > 0 else F.lit(False))


def train_window(rows: DataFrame, length: str, chunk: int, most: int, key: str, seed: int) -> DataFrame:
    """chunk_spans() of at most `most` consecutive chunks from a start that hangs on key and seed."""
    n = chunk_count(F.col(length), chunk)
    start = F.floor(draw(F.col(key), "window", seed) * (F.greatest(n - most, F.lit(0)) + 1)).cast("int")
    out = rows.withColumn("chunk_idx", F.explode(F.sequence(start, F.least(start + most, n) - 1)))
    return out.withColumn("first", F.col("chunk_idx") * chunk).withColumn("last", F.least((F.col("chunk_idx") + 1) * chunk, F.col(length)))
