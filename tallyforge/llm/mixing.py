"""Mixing sources to target weights; DataFrame expressions only.

The words of each source form one stream, its documents in a pseudorandom order, packed into blocks of fixed length.
Every output shard draws how many blocks it takes of each source; the draws of a source, counted over all shards, run
through pseudorandom permutations of its block numbers (a new one each time the source is used up), and the blocks are
joined by number.

The draw: each source's target, rounded to blocks, is its number of slots; all slots of all sources are numbered, and a
pseudorandom permutation of the numbers deals them to the shards. So a shard's source counts are a multinomial draw,
conditioned on the sources' totals (a multivariate hypergeometric one): they scatter from shard to shard, and their sums
over all shards meet the targets. Independent draws would miss the target of a source of n blocks by about sqrt(n) blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, words_of

#: Weights by the sources' order, repeating; the mix has this share of all words; a source is used so often at most.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: Words of a block, blocks of an output shard (more where there are very many sources), documents of a prefix bucket.
BLOCK = 32
SHARD_BLOCKS = 32_768
BUCKET_ROWS = 1024
SEED = 60_013
#: Offsets of up to so many documents (some 60 MB) are broadcast to their texts; with more, texts are shuffled by document.
BROADCAST_ROWS = 1_000_000


@dataclass
class Mix:
    """sources (one row each), docs (uid, sid, size, offset in the source's stream, and the carried columns), and the
    drawn blocks (shard, sid, draw, block)."""

    sources: DataFrame
    docs: DataFrame
    draws: DataFrame
    block: int


def targets(sizes: DataFrame) -> DataFrame:
    """(sid, source, source_size, weight, target) from (source, source_size): water-filling in closed form.

    Sources stand in code point order, null last. Those whose limit EPOCHS * source_size is smallest for their weight
    fill up first; the others share what is left by weight. One row for each source goes through one task.
    """
    whole = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("sid", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    out = ranked.withColumn("weight", weights[F.col("sid") % len(WEIGHTS)]).withColumn("most", EPOCHS * F.col("source_size").cast("double"))
    out = out.withColumn("all_words", F.sum("source_size").over(whole)).withColumn("all_weights", F.sum("weight").over(whole))
    before = Window.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = SHARE * F.col("all_words") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    out = out.withColumn("level", left / (F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    free = F.col("most") > F.col("level") * F.col("weight")
    out = out.withColumn("level", F.max(F.when(free, F.col("level"))).over(whole))
    return out.select("sid", "source", "source_size", "weight", F.coalesce(F.least("most", F.col("level") * F.col("weight")), "most").alias("target"))


def _half(value: Column, other: Column, key: Column, radix: Column) -> Column:
    return (value + F.pmod(F.xxhash64(other, key), radix)) % radix


def permuted(index: Column, size: Column, key: Column) -> Column:
    """A permutation of 0 .. size-1 for each key: a Feistel network over the mixed radix (a, b), a * b >= size, walked
    until it falls below size. Fewer than a values lie outside, so a walk has fewer than a steps."""
    a = F.greatest(F.ceil(F.sqrt(size)), F.lit(1)).cast("long")
    b = F.ceil(size / a).cast("long")

    def once(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), (x % b).cast("long")
        left = _half(left, right, F.xxhash64(key, F.lit(1)), a)
        right = _half(right, left, F.xxhash64(key, F.lit(2)), b)
        left = _half(left, right, F.xxhash64(key, F.lit(3)), a)
        right = _half(right, left, F.xxhash64(key, F.lit(4)), b)
        return left * b + right

    first = once(index)
    walk = F.aggregate(F.sequence(F.lit(1).cast("long"), a), first, lambda x, _: F.when(x < size, x).otherwise(once(x)))
    return F.when(first < size, first).otherwise(walk)


def plan(ws: Workspace, docs: DataFrame, size: Column, source: Column, order: Column, carry: list[Column], block: int = BLOCK, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> Mix:
    """Targets, stream offsets and draws. order: a pseudorandom long for each row, the same in every run."""
    slim = docs.select(size.cast("long").alias("size"), source.cast("string").alias("source"), F.xxhash64(order, F.lit(seed)).alias("order"), *carry)
    slim = ws.write(slim.withColumn("uid", F.monotonically_increasing_id()), "sized")  # written, so uids stay
    found = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = ws.write(targets(found.select("source", "source_size")), "sources")
    n_sources, rows = sources.count(), slim.count()

    # Offsets by two levels of prefix sums, so that no source is summed in one task.
    buckets = max(1, -(-rows // BUCKET_ROWS))
    named = slim.select("uid", "size", "source", "order").join(sources.select("sid", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    named = named.withColumn("bucket", F.pmod("order", F.lit(buckets)))
    sums = named.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("words")
    within = Window.partitionBy("sid", "bucket").orderBy("order", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long"))).join(sums, ["sid", "bucket"])
    placed = ws.write(placed.select("uid", "sid", "size", (F.col("offset") + F.col("base")).alias("offset")), "placed")
    small = F.broadcast(placed) if rows <= BROADCAST_ROWS else placed
    placed = slim.drop("source", "size", "order").join(small, "uid")  # what is carried, texts perhaps, is not shuffled for the offsets

    # Slots of each source, by rounding the running total, so that their sum is right; a source is never used more than
    # EPOCHS times, which rounding up alone could lead to.
    per_shard = max(shard_blocks, 16 * n_sources)
    upto = F.round(F.sum("target").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)) / block).cast("long")
    slots = sources.select("sid", F.ceil(F.col("source_size") / block).cast("long").alias("blocks"), upto.alias("upto"))
    slots = slots.withColumn("n", F.least(F.col("upto") - F.coalesce(F.lag("upto").over(Window.orderBy("sid")), F.lit(0).cast("long")), EPOCHS * F.col("blocks")))
    slots = slots.withColumn("base", F.sum("n").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    slots = slots.withColumn("all", F.sum("n").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("n > 0")
    # Long runs of draws are cut before they are expanded, and dealt out: a source may hold a third of them.
    pieces = F.expr("transform(sequence(0L, (n - 1) div 1024), p -> struct(p * 1024 AS lo, least(n, (p + 1) * 1024) - 1 AS hi))")
    draws = slots.select("sid", "blocks", "base", "all", F.explode(pieces).alias("p")).repartition(F.xxhash64("sid", "p.lo"))
    draws = draws.select("sid", "blocks", "base", "all", F.explode(F.sequence("p.lo", "p.hi")).alias("draw"))
    place = permuted(F.col("base") + F.col("draw"), F.col("all"), F.xxhash64(F.lit("slots"), F.lit(seed)))
    draws = draws.withColumn("shard", F.floor(place / per_shard).cast("long"))
    epoch = F.floor(F.col("draw") / F.col("blocks")).cast("long")
    number = permuted(F.col("draw") % F.col("blocks"), F.col("blocks"), F.xxhash64("sid", epoch, F.lit(seed)))
    return Mix(sources, placed, draws.select("shard", "sid", "draw", number.alias("block")), block)


def counts(mix: Mix) -> DataFrame:
    """(shard, sid, n): the source counts that were drawn for each output shard."""
    return mix.draws.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))


def _fragments(mix: Mix) -> DataFrame:
    """docs cut at the block limits: block, and first and last + 1 word within the document."""
    docs = mix.docs.where("size > 0")
    cut = docs.withColumn("block", F.explode(F.expr(f"sequence(offset div {mix.block}, (offset + size - 1) div {mix.block})")))
    first = F.greatest(F.col("block") * mix.block - F.col("offset"), F.lit(0).cast("long"))
    last = F.least((F.col("block") + 1) * mix.block - F.col("offset"), F.col("size"))
    return cut.withColumn("first", first).withColumn("last", last)


def _met(parts: DataFrame, mix: Mix) -> DataFrame:
    """Fragments with the draws of their blocks. Both sides are expanded from small tables, whose sizes say nothing of
    theirs: the hint keeps Spark from broadcasting one."""
    return parts.hint("merge").join(mix.draws.select("sid", "block"), ["sid", "block"])


def mixed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: the words that the mix takes, repeats counted.

    Null and empty texts have no words and are taken 0 times; null sources form a source of their own; repeated rows
    are documents of their own; an empty table gives an empty result. Reruns agree: the order within a source hangs on
    id and text alone.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    text = F.col(text_col).cast("string")
    size = F.size(words_of(text))
    mix = plan(ws, docs, size, F.col(source_col), F.xxhash64(F.col(id_col), text), [F.col(id_col).alias("doc_id")])
    parts = _fragments(mix).select("sid", "block", "uid", (F.col("last") - F.col("first")).alias("n"))
    taken = _met(parts, mix).groupBy("uid").agg(F.sum("n").alias("taken"))
    out = mix.docs.join(taken, "uid", "left").join(mix.sources, "sid")
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mix itself, in documents: one row for each stretch of a document in a drawn block, with docs' columns.

    Texts are cut between words, white space stays with the word before it. Documents without words have nothing
    to be drawn and leave. See mixed_words() for the other odd cases.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    text = F.col(text_col).cast("string")
    carry = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")]
    mix = plan(ws, docs, F.size(words_of(text)), F.col(source_col), F.xxhash64(F.col(id_col), text), carry, block, shard_blocks=shard_blocks)
    tokens = F.split(F.col("_row")[text_col].cast("string"), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    lead = F.when(F.col("_row")[text_col].rlike(r"\A[\x20\x09-\x0D]"), 1).otherwise(0)
    parts = mix.docs.where("size > 0").withColumn("_tokens", tokens).withColumn("_lead", lead)
    parts = _fragments(Mix(mix.sources, parts, mix.draws, block))
    begin = F.when(F.col("first") == 0, F.lit(1)).otherwise(F.col("first").cast("int") + F.col("_lead") + 1)
    until = F.col("last").cast("int") + F.col("_lead")
    parts = parts.withColumn("_text", F.array_join(F.slice("_tokens", begin, until - begin + 1), ""))
    parts = parts.select("sid", "block", F.col("_row").dropFields(text_col).alias("_row") if len(docs.columns) > 1 else F.struct(F.lit(1)).alias("_row"), "_text")
    out = _met(parts, mix)
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    return out.select(*(F.col("_text").cast(kinds[c]).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))
