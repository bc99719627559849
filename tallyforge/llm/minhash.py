"""Near-duplicate groups by min-max hashing.

Every permutation of the 64-bit shingle hashes keeps its minimum and its maximum, so P hash evaluations give 2 P
signature values. Values are cut into bands; sets that agree in a whole band are candidates, and each link that is
used is confirmed on the two whole shingle sets.

Sets, not rows, are the nodes: rows with the same set (exact copies above all) fold into one node before anything is
paired. A bucket is never expanded into all its pairs: each member first meets the bucket's smallest node, the links
are contracted into components, and only members of buckets that still hold several components meet each other, in
blocks that give back no more links than join their components. There the members of a bucket's largest component are
not repeated, and only pairs of different components are looked at. Nothing is capped.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .shared import Workspace, among

#: Members of one block of a bucket in the second round, and shingles of them all (8 bytes each), about.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
#: Up to this many rows (of one id, or of the bits of 64 numbers) are broadcast to pick nodes and the texts of candidates; with
#: more, both sides are shuffled.
BROADCAST_IDS = 1_000_000
#: Standard deviations that a sketch may be off before its pair is left out: about one in 10^6.
SIGMAS = 5.0


@dataclass(frozen=True)
class Plan:
    """rows values to a band, and as many bands as miss a pair of exactly the threshold with at most `miss`."""

    percent: int = 85
    shingle: int = 5
    rows: int = 8
    miss: float = 1.2e-5
    seed: int = 20_011

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log1p(-((self.percent / 100) ** self.rows)))

    @property
    def values(self) -> int:
        return self.rows * self.bands

    @property
    def permutations(self) -> int:
        return (self.values + 1) // 2

    @property
    def lanes(self) -> int:
        """64-bit words of the sketch: two bits of each value."""
        return math.ceil(self.values / 32)

    @property
    def most_apart(self) -> int:
        """Sketch values that may differ between two sets at the threshold."""
        p = 0.75 * (1 - self.percent / 100)
        return math.ceil(self.values * p + SIGMAS * math.sqrt(self.values * p * (1 - p)))


def _words(data, begin, end, spans):
    """Word hashes of the rows, and where each row's words begin and end among them. A long row goes piece by piece."""
    if len(begin) == 1 and end[0] - begin[0] > K.SLICE:
        found = [_words(data, np.array([a]), np.array([b]), spans)[0] if b - a <= K.SLICE else _slice_words(data, np.array([a]), np.array([b]), spans)[0] for a, b in K.pieces(data, int(begin[0]), int(end[0]))]
        words = np.concatenate(found)
        return words, np.zeros(1, np.int64), np.array([len(words)])
    return _slice_words(data, begin, end, spans)


def _slice_words(data, begin, end, spans):
    base = int(begin[0]) if len(begin) else 0
    local = K.lower_table()[data[base : int(end.max(initial=base))]]
    first, last = begin - base, end - base
    wb, we = K.runs(K.space_table()[local], first)
    return spans(local, wb, we), np.searchsorted(wb, first), np.searchsorted(wb, last)


def _grams(words, weights, size):
    """Hashes of all runs of `size` words, worked on in parts."""
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for a in range(0, len(out), K.SLICE):
        b = min(len(out), a + K.SLICE)
        part = np.zeros(b - a, np.uint64)
        for k in range(size):
            part += words[a + k : b + k] * weights[k]
        out[a:b] = K.mix(part)
    return out


def _shingles(data, begin, end, spans, weights, size):
    """Per row of the slice its sorted distinct shingle hashes."""
    words, row_at, row_to = _words(data, begin, end, spans)
    with np.errstate(over="ignore"):
        grams = _grams(words, weights, size)
        sets = []
        for a, b in zip(row_at.tolist(), row_to.tolist(), strict=True):
            if b - a >= size:
                sets.append(np.unique(grams[a : b - size + 1]))
            elif b > a:
                whole = (words[a:b] * weights[: b - a]).sum(dtype=np.uint64) + weights[size + (b - a)]
                sets.append(K.mix(np.array([whole], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


class Signer:
    """Turns Arrow batches of (id columns..., text) into shingle sets and min-max signatures."""

    def __init__(self, plan: Plan):
        self.plan = plan
        self.spans = None

    def _ready(self):
        p = self.plan
        if self.spans is None:
            self.spans = K.Spans(p.seed)
            self.weights = K.stream(p.seed + 1, 2 * p.shingle + 2) | np.uint64(1)
            self.turn = K.stream(p.seed + 2, p.permutations)
            self.times = K.stream(p.seed + 3, p.permutations) | np.uint64(1)
            half = p.permutations // 2
            k = np.arange(p.permutations)
            order = np.empty(2 * p.permutations, np.int64)
            order[0::2] = k  # a minimum ...
            order[1::2] = p.permutations + (k + half) % p.permutations  # ... and another permutation's maximum
            self.order = order[: p.values]
            self.fold = K.stream(p.seed + 4, p.rows) | np.uint64(1)
            self.tag = K.stream(p.seed + 5, p.bands)

    def sets(self, column):
        """Yields (first row, shingle sets) over slices of the column."""
        self._ready()
        data, begin, end = K.utf8(column)
        for i, j in K.slices(begin, end, K.SLICE):
            yield i, _shingles(data, begin[i:j], end[i:j], self.spans, self.weights, self.plan.shingle)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of 2 P values for each non-empty set."""
        p = self.plan
        out = np.empty((len(sets), 2 * p.permutations), np.uint64)
        at = 0
        while at < len(sets):
            to, total = at, 0
            while to < len(sets) and (total == 0 or total + len(sets[to]) <= 32_768):
                total += len(sets[to])
                to += 1
            flat = np.concatenate(sets[at:to])
            offsets = np.zeros(to - at, np.int64)
            np.cumsum([len(s) for s in sets[at : to - 1]], out=offsets[1:])
            work = np.empty_like(flat)
            with np.errstate(over="ignore"):
                for k in range(p.permutations):
                    np.bitwise_xor(flat, self.turn[k], out=work)
                    np.multiply(work, self.times[k], out=work)
                    out[at:to, k] = np.minimum.reduceat(work, offsets)
                    out[at:to, p.permutations + k] = np.maximum.reduceat(work, offsets)
            at = to
        return out

    def keys(self, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys and sketches of signature rows."""
        p = self.plan
        values = signatures[:, self.order]
        with np.errstate(over="ignore"):
            bands = K.mix((values.reshape(len(values), p.bands, p.rows) * self.fold).sum(axis=2, dtype=np.uint64) + self.tag)
        bits = np.zeros((len(values), p.lanes * 32), np.uint64)
        bits[:, : p.values] = (values >> np.uint64(31)) & np.uint64(3)
        shifts = np.arange(32, dtype=np.uint64) * np.uint64(2)
        sketch = (bits.reshape(len(values), p.lanes, 32) << shifts).sum(axis=2, dtype=np.uint64)
        return bands, sketch


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(matrix.reshape(-1).view(np.int64)))


def signed(docs: DataFrame, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, n_shingles, bands, sketch) of every row; digest is null where the set is empty."""
    signer = Signer(plan)

    def sign(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, sets in signer.sets(texts):
                full = [k for k, s in enumerate(sets) if len(s)]
                bands, sketch = signer.keys(signer.signatures([sets[k] for k in full]))
                place = np.full(len(sets), -1)
                place[full] = np.arange(len(full))
                digests = [digest(s) if len(s) else None for s in sets]
                at = pa.array(place, mask=place < 0)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, len(sets)), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), _lists(bands).take(at), _lists(sketch).take(at)],
                    names=["id", "digest", "n_shingles", "bands", "sketch"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(sign, f"id {kind}, digest binary, n_shingles long, bands array<long>, sketch array<long>")


def _packed_texts(docs: DataFrame, plan: Plan) -> DataFrame:
    """(digest, packed) of rows (text): the whole text, compressed, is a third of its set's size."""
    signer = Signer(plan)

    def pack(batches):
        for batch in batches:
            for i, sets in signer.sets(batch.column(0)):
                texts = batch.column(0).slice(i, len(sets)).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in texts], pa.binary())], names=["digest", "packed"])

    return docs.select("text").mapInArrow(pack, "digest binary, packed binary")


def _apart(plan: Plan, left: str, right: str):
    """Number of sketch values that differ."""
    low = F.lit(0x5555555555555555)

    def lane(k):
        x = F.col(left)[k].bitwiseXOR(F.col(right)[k])
        return F.bit_count((x.bitwiseOR(F.shiftright(x, 1))).bitwiseAND(low))

    return reduce(lambda a, b: a + b, (lane(k) for k in range(plan.lanes)))


def _near_enough(plan: Plan, a: str, b: str):
    """Conditions that every pair at the threshold meets: the sizes, exactly, and the sketches."""
    small, large = F.least(f"{a}_n", f"{b}_n"), F.greatest(f"{a}_n", f"{b}_n")
    return (100 * small >= plan.percent * large) & (_apart(plan, f"{a}_sketch", f"{b}_sketch") <= plan.most_apart)


class _Sets:
    """Shingle sets of packed texts, held up to a number of bytes."""

    def __init__(self, signer: Signer, most: int = 24 << 20):
        self.signer, self.most = signer, most
        self.held: dict[int, np.ndarray] = {}
        self.size = 0

    def of(self, node: int, packed) -> np.ndarray:
        """packed: the text as an Arrow scalar, unpacked only if the set is not held."""
        if (found := self.held.get(node)) is None:
            plain = pa.array([zlib.decompress(packed.as_py())], pa.binary())
            found = next(self.signer.sets(plain))[1][0]
            if self.size + found.nbytes > self.most:
                self.held.clear()
                self.size = 0
            self.held[node] = found
            self.size += found.nbytes
        return found

    def linked(self, a: int, pa_: pa.Scalar, b: int, pb: pa.Scalar) -> bool:
        x, y = self.of(a, pa_), self.of(b, pb)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= self.signer.plan.percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """Of pairs (a, b) those whose whole sets reach the threshold."""
    signer = Signer(plan)
    left = texts.select(F.col("node").alias("a"), F.col("packed").alias("pa"))
    right = texts.select(F.col("node").alias("b"), F.col("packed").alias("pb"))

    def confirm(batches):
        sets = _Sets(signer)
        for batch in batches:
            a, b, x, y = batch.columns
            keep = [sets.linked(a[k].as_py(), x[k], b[k].as_py(), y[k]) for k in range(len(batch))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(confirm, "a long, b long")


def _block_links(rows: pa.Table, plan: Plan, sets: _Sets) -> list[tuple[int, int]]:
    """Links that join the components of one block of a bucket, each confirmed; at most one fewer than its rows.

    rows: own (whether the row's own block is this one), rank (its block), minor, node, component, n, bands, sketch,
    packed, band. Minor rows stand in every block and are compared with its own rows, two minor ones in the later of
    their two blocks. A pair is looked at in the bucket of the first band that it shares, unless it is joined already.
    """
    own, rank, minor = (np.asarray(rows.column(k)) for k in ("own", "rank", "minor"))
    n, band = np.asarray(rows.column("n")), rows.column("band")[0].as_py()
    bands = np.asarray(rows.column("bands").combine_chunks().flatten()).reshape(len(n), -1)[:, :band]
    sketch = np.asarray(rows.column("sketch").combine_chunks().flatten()).reshape(len(n), -1).view(np.uint64)
    node, packed = rows.column("node").to_pylist(), rows.column("packed")
    root = rows.column("component").to_numpy().copy()
    number = np.arange(len(n))
    here = rank[own][0] if own.any() else -1
    lanes = np.uint64(0x5555555555555555)
    out = []
    for i in np.flatnonzero(minor).tolist():
        # with own rows that are major, or minor of an earlier (or the same) block and not yet met
        other = own & (root != root[i]) & (~minor | (rank[i] < here) | ((rank[i] == here) & (number > i)))
        other &= 100 * np.minimum(n, n[i]) >= plan.percent * np.maximum(n, n[i])
        at = np.flatnonzero(other)
        at = at[~(bands[at] == bands[i]).any(axis=1)]
        x = sketch[at] ^ sketch[i]
        apart = np.bitwise_count((x | (x >> np.uint64(1))) & lanes).sum(axis=1)
        for j in at[np.argsort(apart, kind="stable")][: int((apart <= plan.most_apart).sum())].tolist():
            if root[j] != root[i] and sets.linked(node[i], packed[i], node[j], packed[j]):
                out.append((node[i], node[j]))
                root[root == root[j]] = root[i]
    return out


def _joined(members: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) between the components of each block of members."""
    signer = Signer(plan)
    names = ["own", "rank", "minor", "node", "component", "n", "bands", "sketch", "packed", "band"]

    def links(held, sets):
        found = _block_links(pa.Table.from_batches(held), plan, sets)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def join(batches):
        sets, held, key = _Sets(signer), [], None
        for batch in batches:
            keys, blocks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if b > a:
                    now = (keys[a], blocks[a])
                    if held and now != key:
                        yield links(held, sets)
                        held = []
                    key = now
                    held.append(batch.slice(a, b - a).select(names))
        if held:
            yield links(held, sets)

    grouped = members.repartition("key", "block").sortWithinPartitions("key", "block", "own", "node")
    return grouped.select("key", "block", *names).mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, plan: Plan | None = None, id_col: str = "doc_id", text_col: str = "text", ws: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Texts are lower-cased (A-Z) and cut at white space; a set holds the distinct runs of plan.shingle words, or the
    whole sequence where there are fewer. Null and empty texts have the empty set, link with nothing, and are their
    own component. Rows with a null id take part: component_id is the smallest non-null id they reach (else null) and
    kept is false. Repeated rows share a component; each copy of the smallest id is kept. Other columns are ignored.
    """
    plan = plan or Plan()
    spark: SparkSession = docs.sparkSession
    ws = ws or Workspace(spark, "minhash")
    sig = ws.write(signed(docs, plan, id_col, text_col), "signatures")
    kind = docs.schema[id_col].dataType.simpleString()
    # Nodes have numbers of their own, which take half the room of a digest wherever they are shuffled.
    nodes = sig.where("digest is not null").groupBy("digest").agg(F.min("id").alias("smallest"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = ws.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = ws.write(sig.select("id", "digest", "n_shingles"), "digests")
    ws.drop(sig)

    # One shuffle of keys and numbers finds the shared keys; a window spills what a key's many members take.
    alike = Window.partitionBy("key")
    members = nodes.select("node", F.explode("bands").alias("key"))
    members = members.select("key", "node", F.count(F.lit(1)).over(alike).alias("m"), F.min("node").over(alike).alias("pivot"))
    buckets = ws.write(members.where("m > 1").select("key", "node", "pivot"), "buckets")
    near = ws.write(among(nodes, buckets.select("node"), "node", ws, BROADCAST_IDS), "near")
    held, nodes = nodes, ws.write(nodes.select("digest", "node", "smallest"), "numbers")
    ws.drop(held)
    labels = {x: near.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch")) for x in "ab"}

    # First round: each member and, of its buckets' smallest nodes, the one with which it shares the most buckets.
    stars = buckets.where("node != pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("bands"))
    stars = stars.groupBy("node").agg(F.min_by("pivot", F.struct(-F.col("bands"), "pivot")).alias("pivot"))
    stars = stars.select(F.col("node").alias("a"), F.col("pivot").alias("b")).join(labels["a"], "a").join(labels["b"], "b")
    first = ws.write(stars.where(_near_enough(plan, "a", "b")).select("a", "b"), "stars")

    # The whole texts of the nodes that any pair may ask for; one row of documents for each.
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = among(chosen, near.select(F.col("smallest").alias("id")), "id", ws, BROADCAST_IDS)
    texts = _packed_texts(chosen, plan).join(near.select("digest", "node"), "digest").dropDuplicates(["digest"]).drop("digest")
    texts = ws.write(texts, "texts")
    edges = ws.write(_confirmed(first, texts, plan), "links")
    labelled = components(ws, edges)

    # Second round: members of buckets that hold several components meet in blocks. The bucket's largest component is
    # major: its members stand in their own block alone; the others' members stand in every block.
    named = buckets.select("key", "node").join(near.select("node", "n"), "node").join(labelled, "node", "left")
    named = ws.write(named.select("key", "node", "n", F.coalesce("component", "node").alias("component")), "named")
    sized = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"))
    sized = sized.groupBy("key").agg(F.max_by("component", F.struct("members", "component")).alias("major"), F.sum("members").alias("of"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    blocks = F.ceil(F.greatest(F.col("of") / BLOCK, F.col("n") / BLOCK_SHINGLES)).cast("int")
    mixed = ws.write(sized.where("parts > 1").select("key", "major", blocks.alias("blocks")), "mixed")
    inside = named.drop("n").join(mixed, "key").join(near.select("node", "n", "bands", "sketch"), "node").join(texts, "node")
    inside = inside.withColumn("band", (F.array_position("bands", F.col("key")) - 1).cast("int"))
    inside = inside.withColumn("minor", F.col("component") != F.col("major"))
    inside = inside.withColumn("rank", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    inside = inside.withColumn("block", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("rank"))))
    inside = inside.withColumn("own", F.col("block") == F.col("rank"))
    more = ws.write(_joined(inside, plan), "more")
    if not more.isEmpty():
        labelled = components(ws, edges.unionByName(more))

    # A row's answer: its node's component, and that component's smallest id.
    final = labelled.join(near.select("node", "smallest"), "node").groupBy("component").agg(F.min("smallest").alias("component_id"))
    final = labelled.join(final, "component").select("node", "component_id")
    reach = nodes.join(final, "node", "left").select("digest", F.coalesce("component_id", "smallest").alias("component_id"))
    reach = ws.write(reach, "reach")  # read back, so that a set that very many rows share is a skewed join that Spark can split
    out = rows.where("digest is not null").join(reach, "digest").select("id", "n_shingles", "component_id")
    out = out.unionByName(rows.where("digest is null").select("id", "n_shingles", F.col("id").alias("component_id")))
    ws.drop(texts)
    return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
