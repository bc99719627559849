"""Substring dedup by content-defined chunks and exact windows of words.

A gear hash rolls over the UTF-8 bytes; a chunk ends where the hash is the largest within REACH bytes on either side, so
cuts hang on nearby bytes alone and an insertion moves only the cuts beside it. Two neighbouring chunks together give a
digest. A digest that several documents hold is kept in the document with the smallest id and marked in the others;
marked chunks that touch form spans, and spans of at least MIN_BYTES are repeated passages.

Chunks lose bytes at either end of a passage, so windows of MIN_WORDS words are compared too, each as one hash over its
bytes. A window that two documents share gives both the same cuts from LEAD bytes after its begin to REACH before its
end, so it can be left out where a digest between these is in no other document; a window without a whole digest there
(short, or periodic and without cuts) is always compared. Spans are the union of both kinds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import Workspace

#: Bytes on either side that a cut must beat (chunks come to about 2 * REACH + 1 bytes), and doublings of the gear hash.
REACH = 12
GEAR_STEPS = 3
MIN_BYTES = 180
MIN_WORDS = 50
#: Bytes after the begin of a shared window from which on its cuts are sure to be shared.
LEAD = REACH + (1 << GEAR_STEPS) + 1
SEED = 70_001


class Chunker:
    def __init__(self, reach: int = REACH, seed: int = SEED):
        self.reach, self.seed = reach, seed
        self.spans = None

    def _ready(self):
        if self.spans is None:
            self.spans = K.Spans(self.seed)
            self.gear = (K.stream(self.seed + 1, 256) >> np.uint64(32)).astype(np.uint32)
            self.pair = K.stream(self.seed + 2, 2) | np.uint64(1)

    def cuts(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Places before which a chunk ends, apart from the rows' own ends; none hangs on a neighbouring row.

        Worked on in ranges, each with the bytes around it on which its cuts hang."""
        n, r = len(data), self.reach
        found = [np.zeros(0, np.int64)]
        for lo in range(0, n, K.SLICE):
            a = max(0, lo - r - (1 << GEAR_STEPS))
            peak = self._peaks(data[a : lo + K.SLICE + r + 1]) + a
            found.append(peak[(peak >= lo) & (peak < lo + K.SLICE)])
        peak = np.concatenate(found)
        row = np.searchsorted(first, peak, side="right") - 1
        sure = (peak - first[row] >= r + (1 << GEAR_STEPS)) & (peak + r < last[row])
        return peak[sure] + 1

    def _peaks(self, data: np.ndarray) -> np.ndarray:
        """Places whose gear hash is the largest within reach on either side."""
        n, r = len(data), self.reach
        gear = self.gear[data]
        for k in range(GEAR_STEPS):
            step = 1 << k
            more = np.zeros_like(gear)
            more[step:] = gear[:-step] << np.uint32(step)
            gear = gear + more
        if n <= 2 * r:
            return np.zeros(0, np.int64)
        top, width = gear, 1
        while width * 2 <= r:
            top = np.maximum(top[:-width], top[width:])
            width *= 2
        if width < r:
            top = np.maximum(top[: len(top) - (r - width)], top[r - width :])
        # top[i]: the largest of gear[i : i + r]
        at = np.arange(r, n - r)
        return at[(gear[r : n - r] > top[: n - 2 * r]) & (gear[r : n - r] >= top[r + 1 : n - r + 1])]

    def chunk(self, column):
        """Yields (first row, next row, digests, ends, offsets): per row the pair digests and the chunk ends in bytes."""
        self._ready()
        data, begin, end = K.utf8(column)
        for i, j in K.slices(begin, end, K.SLICE):
            base, stop = int(begin[i]), int(end[i:j].max())
            local = data[base:stop]
            first, last = begin[i:j] - base, end[i:j] - base
            full = np.flatnonzero(last > first)
            starts = np.concatenate([first[full], self.cuts(local, first[full], last[full])]) if len(full) else np.zeros(0, np.int64)
            starts.sort()
            ends = np.append(starts[1:], len(local))
            row = np.searchsorted(first[full], starts, side="right") - 1
            if len(full):
                final = np.append(row[1:] != row[:-1], True)
                ends[final] = last[full][row[final]]
            with np.errstate(over="ignore"):
                own = self.spans(local, starts, ends) if len(full) else np.zeros(0, np.uint64)
                digests = own * self.pair[0]  # a row's last chunk stands alone
                if len(full):
                    joined = np.flatnonzero(~final)
                    digests[joined] = K.mix(own[joined] * self.pair[0] + own[joined + 1] * self.pair[1])
                    only = final & np.append(True, final[:-1])
                    keep = ~final | only
                else:
                    keep = np.zeros(0, bool)
            counts = np.zeros(j - i, np.int64)
            counts[full] = np.bincount(row, minlength=len(full)) if len(full) else 0
            pairs = np.zeros(j - i, np.int64)
            pairs[full] = np.bincount(row[keep], minlength=len(full)) if len(full) else 0
            offset = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offset(pairs), pa.array(digests[keep].view(np.int64)))
            tails = pa.ListArray.from_arrays(offset(counts), pa.array((ends - first[full][row] if len(full) else ends).astype(np.int32)))
            yield i, j, lists, tails


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, id, text, digests, ends) of every row; an error for ids that are no whole numbers."""
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must hold whole numbers")
    chunker = Chunker()

    def run(batches):
        for batch in batches:
            for i, j, lists, tails in chunker.chunk(batch.column(2)):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), lists, tails], names=["uid", "id", "text", "digests", "ends"])

    slim = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "uid long, id long, text string, digests array<long>, ends array<int>")


SPANS = "spans array<struct<first:int,last:int>>, first_ids array<long>"
WINDOWS = "held array<long>, asked array<struct<hash:long,first:int,last:int>>"


def _list(column, i: int, j: int) -> tuple[np.ndarray, pa.Array]:
    """Of rows [i, j) of a list column: the number of values in each (null: 0), and the values."""
    part = column.slice(i, j - i)
    return np.asarray(part.value_lengths().fill_null(0)).astype(np.int64), part.flatten()


def _packed(rows: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Values in the order of their rows as a list for each of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)


def _structs(**fields: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields))


def _union(rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last of each group of ranges of a row that touch; ranges ascend by row, begin and end."""
    new = np.append(True, (rows[1:] != rows[:-1]) | (begin[1:] > end[:-1])) if len(rows) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(rows))[: len(first)] - 1


def _distinct(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])) if len(rows) else np.zeros(0, bool)
    return rows[new], values[new]


def _compared(rows: DataFrame) -> DataFrame:
    """Of rows (uid, id, key, text, ends, marks): the spans of marked chunks, and the windows still to be compared.

    held are the hashes of windows that a document with a larger id may hold, asked the windows that one with a smaller
    id may hold and no span covers.
    """
    space = K.space_table()

    def piece(batch, i, j, data, first, last, hashes):
        n = j - i
        keys = np.asarray(batch.column(2).slice(i, n))
        n_chunks, ends = _list(batch.column(4), i, j)
        row = np.repeat(np.arange(n), n_chunks)
        ends = np.asarray(ends).astype(np.int64) + first[row]
        head = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
        starts = np.where(head, first[row], np.append(0, ends[:-1])[: len(row)])
        base = np.cumsum(n_chunks) - n_chunks
        n_marks, marks = _list(batch.column(5), i, j)
        owner = np.repeat(np.arange(n), n_marks)
        at = base[owner] + np.asarray(marks.field("pos")).astype(np.int64)
        holder, later = np.asarray(marks.field("first")), np.asarray(marks.field("last")) != keys[owner]
        earlier = holder != keys[owner]

        order = np.argsort(at[earlier])
        at_e, owner_e, holder_e = at[earlier][order], owner[earlier][order], holder[earlier][order]
        begin, end = starts[at_e], ends[np.minimum(at_e + 1, (base + n_chunks - 1)[owner_e])]
        a, b = _union(owner_e, begin, end)
        size = b - a + 1
        long = end[b] - begin[a] >= MIN_BYTES
        a, b, kept = a[long], b[long], np.repeat(long, size)
        span_row, span_begin, span_end = owner_e[a], begin[a], end[b]
        id_row, ids = _distinct(owner_e[kept], holder_e[kept])

        word, stop = K.runs(space[data], first[last > first])
        word_row = np.searchsorted(first, word, side="right") - 1
        w = np.flatnonzero(word_row[MIN_WORDS - 1 :] == word_row[: len(word) - MIN_WORDS + 1]) if len(word) >= MIN_WORDS else np.zeros(0, np.int64)
        lo, hi = word[w], stop[w + MIN_WORDS - 1]
        p, q = np.searchsorted(starts, lo + LEAD), np.searchsorted(ends, hi - REACH, side="right") - 1
        q = np.maximum(p, q)  # digests p .. q - 1 lie between the sure cuts

        def without_gap(places):
            other = np.ones(len(starts) + 1, np.int64)
            other[places] = 0
            gaps = np.append(0, np.cumsum(other))
            return gaps[q] == gaps[p]

        hold = without_gap(at[later])
        covered = np.searchsorted(span_begin, lo, side="right") - 1
        inside = (covered >= 0) & (hi <= np.append(span_end, 0)[covered])
        ask = without_gap(at[earlier]) & ~inside
        need = hold | ask
        value = np.zeros(len(w), np.int64)
        value[need] = hashes(data, lo[need], hi[need]).view(np.int64)
        w_row = word_row[w]
        held_row, held = _distinct(w_row[hold], value[hold])
        rel = lambda x, r: (x - first[r]).astype(np.int32)
        asked = _structs(hash=value[ask], first=rel(lo[ask], w_row[ask]), last=rel(hi[ask], w_row[ask]))
        return [
            pa.array((last - first).astype(np.int32)), pa.array(n_chunks.astype(np.int32)),
            _packed(span_row, n, _structs(first=rel(span_begin, span_row), last=rel(span_end, span_row))), _packed(id_row, n, pa.array(ids)),
            _packed(held_row, n, pa.array(held)), _packed(w_row[ask], n, asked),
        ]

    def run(batches):
        hashes = K.Spans(SEED + 3)
        for batch in batches:
            data, begin, end = K.utf8(batch.column(3))
            for i, j in K.slices(begin, end, K.SLICE):
                base = int(begin[i])
                made = piece(batch, i, j, data[base : int(end[i:j].max())], begin[i:j] - base, end[i:j] - base, hashes)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), *made], names=["uid", "id", "key", "n_bytes", "n_chunks", "spans", "first_ids", "held", "asked"])

    return rows.select("uid", "id", "key", "text", "ends", "marks").mapInArrow(run, f"uid long, id long, key long, n_bytes int, n_chunks int, {SPANS}, {WINDOWS}")


def _joined(rows: DataFrame) -> DataFrame:
    """rows (uid, spans, first_ids, found) with the windows found, (first, last, id), joined to the spans."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            n_spans, spans = _list(batch.column(1), 0, n)
            n_ids, ids = _list(batch.column(2), 0, n)
            n_found, found = _list(batch.column(3), 0, n)
            number = np.arange(n)
            row = np.concatenate([np.repeat(number, n_spans), np.repeat(number, n_found)])
            begin, end = (np.concatenate([np.asarray(spans.field(k)), np.asarray(found.field(k))]) for k in ("first", "last"))
            order = np.lexsort((end, begin, row))
            row, begin, end = row[order], begin[order], end[order]
            # the furthest end so far in the row, so that ends ascend too
            far = np.maximum.accumulate(row * (1 << 32) + end) - row * (1 << 32) if len(row) else end
            a, b = _union(row, begin, far)
            id_row, ids = _distinct(np.concatenate([np.repeat(number, n_ids), np.repeat(number, n_found)]), np.concatenate([np.asarray(ids), np.asarray(found.field("id"))]))
            ranges = _structs(first=begin[a].astype(np.int32), last=far[b].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(row[a], n, ranges), _packed(id_row, n, pa.array(ids))], names=["uid", "spans", "first_ids"])

    return rows.select("uid", "spans", "first_ids", "found").mapInArrow(run, f"uid long, {SPANS}")


def _write(ws: Workspace, df: DataFrame, name: str) -> DataFrame:
    """ws.write, with the shuffles of the step deleted at its end."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return ws.write(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_chunks, spans, first_ids, removed_bytes) of every row.

    spans are the byte ranges [first, last) to remove: passages that a document with a smaller id holds too (first_ids).
    Rows that share an id count as one document, so repeated rows are not copies of each other; a null id counts as
    the largest. Null and empty texts have no chunk. Nothing in a document that only repeats itself is marked.
    """
    ws = Workspace(docs.sparkSession, "chunks")
    table = ws.write(chunked(docs, id_col, text_col).withColumn("key", F.coalesce("id", F.lit((1 << 63) - 1))), "chunks")
    pieces = table.select("key", F.explode("digests").alias("digest"))
    shared = _write(ws, pieces.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first != last"), "shared")
    own = table.select("uid", F.posexplode("digests").alias("pos", "digest"))
    marks = _write(ws, own.join(shared, "digest").groupBy("uid").agg(F.collect_list(F.struct("pos", "first", "last")).alias("marks")), "marks")
    ws.drop(shared)
    compared = _write(ws, _compared(table.join(marks, "uid", "left")), "compared")
    ws.drop(table, marks)

    # Written, so that the windows of a very common passage are a skewed join that Spark can split.
    holders = _write(ws, compared.select("key", F.explode("held").alias("hash")).groupBy("hash").agg(F.min("key").alias("id")), "holders")
    asked = compared.select("uid", "key", F.inline("asked")).join(holders, "hash").where("id < key")
    found = asked.groupBy("uid").agg(F.collect_list(F.struct("first", "last", "id")).alias("found"))
    plain = compared.drop("held", "asked")
    joined = _joined(plain.join(found, "uid")).withColumnsRenamed({"spans": "more", "first_ids": "more_ids"})
    out = plain.join(joined, "uid", "left").withColumn("spans", F.coalesce("more", "spans")).withColumn("first_ids", F.coalesce("more_ids", "first_ids"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return out.select(F.col("id").alias(id_col), F.col("n_bytes").cast("long"), F.col("n_chunks").cast("long"), "spans", "first_ids", removed.alias("removed_bytes"))


def without_spans(text: str | None, spans: list) -> str | None:
    """The text without the byte ranges; half characters at their edges go too."""
    if text is None:
        return None
    raw = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    for first, last in spans:
        out.append(raw[at:first])
        at = last
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "ignore")
