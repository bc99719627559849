"""Orders and mixes of sample streams: round robin, Bernoulli mixes, balanced replay, balanced task orders.

Everything hangs on md5 of keys and a seed, so that orders are the same in every run and engine. Places within a stream
are counted by ranges of the hash, so that no stream goes through one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims


def order_key(key: Column, *salts: object) -> Column:
    """Hexadecimal md5 of the key and the salts."""
    return F.md5(F.concat_ws(":", key.cast("string"), *(s.cast("string") if isinstance(s, Column) else F.lit(str(s)) for s in salts)))


def draw(key: Column, *salts: object) -> Column:
    """A number in [0, 1) from 32 bits of order_key()."""
    return F.conv(F.substring(order_key(key, *salts), 1, 8), 16, 10).cast("double") / float(1 << 32)


def placed(rows: DataFrame, stream: str, key: str, out: str) -> DataFrame:
    """rows with their 0-based place in the order of `key` (hexadecimal text) within `stream`: counts of 4,096 ranges of the
    key, summed up, and places within a range."""
    ranged = rows.withColumn("_range", F.substring(key, 1, 3))
    counts = ranged.groupBy(stream, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(stream).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(stream, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_base"))
    within = Window.partitionBy(stream, "_range").orderBy(key)
    joined = ranged.withColumn("_at", F.row_number().over(within) - 1).join(bases, [stream, "_range"])
    return joined.withColumn(out, F.col("_at") + F.col("_base")).drop("_at", "_base", "_range")


def interleaved(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """rows with `turn`: the round robin over labels takes the rows of turn 0 of all labels, then those of turn 1, and so
    on; a label that has run out drops out. Sort by turn and label_key for the order."""
    keyed = rows.withColumn("order_key", order_key(F.col(key), seed)).withColumn("label_key", order_key(F.col(label), seed))
    return placed(keyed, label, "order_key", "turn")


def bernoulli_mix(first: DataFrame, second: DataFrame, share: float, key: str, seed: int) -> DataFrame:
    """(stream, key, place): both streams, each in a seeded order; every place draws the second with probability `share`,
    and what is left of one when the other has run out follows at the end."""
    spark = first.sparkSession
    both = first.select(key, F.lit(0).alias("stream")).unionByName(second.select(key, F.lit(1).alias("stream")))
    both = placed(both.withColumn("order_key", order_key(F.col(key), "item", seed)), "stream", "order_key", "k")
    n = both.count()
    width = 4096
    slots = spark.range(n).withColumn("stream", (draw(F.col("id"), "slot", seed) < share).cast("int")).withColumn("_block", F.floor(F.col("id") / width))
    counts = slots.groupBy("stream", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("stream").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("stream", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_base"))
    within = Window.partitionBy("stream", "_block").orderBy("id")
    slots = slots.withColumn("_at", F.row_number().over(within) - 1).join(bases, ["stream", "_block"])
    slots = slots.select("stream", (F.col("_at") + F.col("_base")).alias("k"), F.col("id").alias("slot"))
    # places without a slot of their own come after all slots, in their own order
    out = both.join(slots, ["stream", "k"], "left")
    return out.select("stream", key, F.coalesce("slot", n + F.col("k")).alias("place"))


def assigned_by_label(manifests: DataFrame, path: str, label: str, workers: int, seed: int, epoch: int = 0) -> DataFrame:
    """(label, path, worker): the manifests of each label in a seeded order, in turn to the workers; where a label has fewer
    manifests than there are workers, they share them in a circle, so that every worker has one of every label."""
    keyed = manifests.select(label, path).distinct().withColumn("_key", order_key(F.col(path), F.col(label), seed + epoch * 7919))
    at = placed(keyed, label, "_key", "_place")
    counts = at.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    turns = at.join(counts, label)
    # a manifest goes to worker place, or with n < workers to all workers of its place modulo n
    mine = F.when(F.col("_n") >= workers, F.array(F.pmod("_place", F.lit(workers)))).otherwise(F.sequence(F.col("_place"), F.lit(workers - 1).cast("long"), F.col("_n")))
    return turns.withColumn("worker", F.explode(mine)).select(label, path, F.col("worker").cast("int").alias("worker"))


def balanced_tasks(groups: DataFrame, task: str, label: str, seed: int) -> DataFrame:
    """(task, label, turn): tasks by turns over their majority labels, each label in a seeded order; tasks without a label last."""
    keyed = groups.select(task, label).withColumn("_stream", F.coalesce(F.col(label).cast("string"), F.lit(""))).withColumn("order_key", order_key(F.col(task), seed))
    out = placed(keyed, "_stream", "order_key", "turn")
    return out.withColumn("fallback", F.col(label).isNull()).select(task, label, "turn", "fallback", "order_key")


def balanced_replay(rows: DataFrame, key: str, label: str, size: int, prefill: int, seed: int, shuffle: bool = True, parts: int | None = None) -> DataFrame:
    """(part, step, label, sampled): one draw for each row read, once all labels have rows or `prefill` rows were read: a label
    of those with rows, then a row of its buffer of `size` rows. A full buffer overwrites a random place, or in turn
    without shuffle. Each part of the rows is a stream of its own, as each worker's is; its state is the buffers alone."""
    spark = rows.sparkSession
    n = parts or spark.sparkContext.defaultParallelism
    labels = list(range(dims.N))

    def replay(part: int):
        """Takes lists of (key, label) and gives lists of draws."""
        rng, held, read, out = np.random.default_rng([seed, part]), {k: [] for k in labels}, 0, []
        while True:
            got, out = (yield out), []
            for item, y in got:
                read += 1
                if y not in held:
                    continue
                buffer = held[y]
                if len(buffer) < size:
                    buffer.append(item)
                else:
                    buffer[int(rng.integers(size)) if shuffle else read % size] = item
                ready = [k for k in labels if held[k]]
                if len(ready) < len(labels) and read < prefill:
                    continue
                chosen = ready[int(rng.integers(len(ready)))]
                out.append((part, read, chosen, held[chosen][int(rng.integers(len(held[chosen])))]))

    def by_part(batches):
        # a task may hold several parts, one after the other
        current, stream = None, None
        for batch in batches:
            ids = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if ids[a] != current:
                    current, stream = ids[a], replay(int(ids[a]))
                    next(stream)
                out = stream.send(list(zip(batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_pylist(), strict=True)))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["part", "step", "label", "sampled"])

    part = F.pmod(F.conv(F.substring(order_key(F.col(key), "part", seed), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")
    ranged = rows.select(part.alias("part"), F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label"), order_key(F.col(key), seed).alias("o"))
    ranged = ranged.repartition(n, "part").sortWithinPartitions("part", "o")

    return ranged.select("part", "key", "label").mapInArrow(by_part, "part int, step long, label int, sampled long")
