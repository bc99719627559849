"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is a bounded run of words of one partition. Words that no test phrase holds become separators, and a run of
separators one separator, so the index covers exactly the stretches in which a phrase can occur. The suffix array
(prefix doubling, each separator a sentinel of its own) gives the Burrows-Wheeler transform; a wavelet matrix answers
rank; all phrases are searched backwards at once; rows of the suffix array are resolved by walking to a sampled
position; the spans of the occurrences are merged per document.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace, fresh

#: A phrase is this many consecutive words of a test item.
WINDOW = 10
#: Words (after separators are joined) of one shard, and its bytes of text, at most; a document is never cut.
SHARD_WORDS = 1 << 19
SHARD_BYTES = 16 << 20
#: Every so many text positions one suffix position is kept.
SAMPLE = 8
#: Test words that are broadcast at a time; a larger benchmark takes several passes.
BLOCK_WORDS = 2_000_000

#: Bytes of words: digits, letters (A-Z as a-z) and all of UTF-8 beyond ASCII; the others become spaces.
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


@dataclass
class Phrases:
    """Distinct phrases of a block of test items as rows of word numbers (1..), right-aligned, and whose they are."""

    vocabulary: dict[bytes, int]
    matrix: np.ndarray
    length: np.ndarray
    owners: list[list]  # of each phrase, the items that hold it

    @classmethod
    def of(cls, items: list[tuple], window: int = WINDOW) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, dict] = {}
        for item, text in items:
            row = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
            for i in range(max(1, len(row) - window + 1) if row else 0):
                owners.setdefault(tuple(row[i : i + window]), {})[item] = None
        matrix = np.zeros((len(owners), window), np.int32)
        length = np.zeros(len(owners), np.int64)
        for k, phrase in enumerate(owners):
            matrix[k, window - len(phrase) :] = phrase
            length[k] = len(phrase)
        return cls(vocabulary, matrix, length, [list(x) for x in owners.values()])


class WaveletMatrix:
    """Rank of a symbol in an integer sequence, one bit vector for each bit of the symbols."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.levels = []
        now = sequence
        for k in reversed(range(self.bits)):
            bit = ((now >> k) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            before = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            zeros = len(bit) - int(before[-1])
            self.levels.append((k, packed, before, zeros))
            now = np.concatenate([now[~bit], now[bit]])
        self.first = self._walk(np.arange(top + 1), np.zeros(top + 1, np.int64))

    @staticmethod
    def _ones(packed, before, at):
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & mask)

    def _walk(self, symbols, at):
        for k, packed, before, zeros in self.levels:
            ones = self._ones(packed, before, at)
            at = np.where((symbols >> k) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._walk(symbols, at) - self.first[symbols]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text that ends with 0; each 0 ends its suffix and sorts by its position."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    padded = np.concatenate([text.astype(np.int64), np.zeros(depth, np.int64)])
    for k in range(depth):
        alive &= padded[k : k + n] != 0
        key = (key << bits) | np.where(alive, padded[k : k + n], 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)  # begins a group of equal prefixes; a suffix that has ended is a group of its own
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | ~alive[order[1:]] | ~alive[order[:-1]]
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    size = np.diff(np.append(starts, n))
    open_slots = np.flatnonzero(np.repeat(size > 1, size))
    while len(open_slots):
        at = order[open_slots]
        group, following = rank[at], rank[at + depth]
        by = np.lexsort((following, group))
        at, group, following = at[by], group[by], following[by]
        order[open_slots] = at
        same_group = np.zeros(len(at), bool)
        same_group[1:] = group[1:] == group[:-1]
        same = same_group.copy()
        same[1:] &= following[1:] == following[:-1]
        rank_here = open_slots[np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))]
        rank[at] = rank_here
        more = same.copy()
        more[:-1] |= same[1:]
        open_slots = open_slots[more]
        depth *= 2
    return order


class FMIndex:
    """Over word numbers with 0 as separator; text begins and ends with 0."""

    def __init__(self, text: np.ndarray, top: int):
        order = suffix_array(text)
        before = text[order - 1]
        self.wavelet = WaveletMatrix(before, top)
        self.below = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=top + 1), out=self.below[1:])
        self.symbol = before
        self.kept = (order % SAMPLE == 0) | (before == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(self.kept)])
        self.sample = order[self.kept]

    def search(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of right-aligned phrases: row ranges [low, high) of the suffix array."""
        n = len(self.symbol)
        low, high = np.zeros(len(matrix), np.int64), np.full(len(matrix), n, np.int64)
        live = np.arange(len(matrix))
        for column in reversed(range(matrix.shape[1])):
            symbols = matrix[live, column]
            going = symbols > 0
            live, symbols = live[going], symbols[going].astype(np.int64)
            low[live] = self.below[symbols] + self.wavelet.rank(symbols, low[live])
            high[live] = self.below[symbols] + self.wavelet.rank(symbols, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out = np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            done = self.kept[rows]
            out[todo[done]] = self.sample[self.kept_before[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            symbols = self.symbol[rows].astype(np.int64)
            rows = self.below[symbols] + self.wavelet.rank(symbols, rows)
            steps += 1
        return out


def occurrences(numbers: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's documents (word numbers, 0: not in any phrase): document, first word and phrase of each occurrence."""
    none = np.zeros(0, np.int64)
    lengths = np.array([len(x) for x in numbers], np.int64)
    if not len(phrases.matrix) or not lengths.sum():
        return none, none, none
    # One separator before each document, and one at the end.
    flat = np.zeros(int(lengths.sum()) + len(numbers) + 1, np.int32)
    starts = np.cumsum(lengths + 1) - lengths
    for at, x in zip(starts.tolist(), numbers, strict=True):
        flat[at : at + len(x)] = x
    keep = flat != 0
    keep[1:] |= flat[:-1] != 0  # the first separator after each run
    keep[0] = True
    place = np.flatnonzero(keep)
    text = flat[place]
    if len(text) < 3:
        return none, none, none
    index = FMIndex(text, len(phrases.vocabulary))
    low, high = index.search(phrases.matrix)
    count = high - low
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    at = place[index.locate(rows)]
    doc = np.searchsorted(starts, at, side="right") - 1
    return doc, at - starts[doc], phrase


def merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Union of word spans [first, last) that overlap or touch."""
    out: list[tuple[int, int]] = []
    for k in np.argsort(first, kind="stable").tolist():
        a, b = int(first[k]), int(last[k])
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scanner(phrases_of, text_at: int, old: tuple[int, int, int] | None):
    """mapInArrow body; old: places of the columns n_words, spans and items of an earlier pass."""

    def flush(batches, counts, numbers, phrases):
        doc, first, phrase = occurrences(numbers, phrases)
        by = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[by], np.arange(len(numbers) + 1))
        spans, items = [], []
        for k in range(len(numbers)):
            mine = by[cuts[k] : cuts[k + 1]]
            spans.append(merged(first[mine], first[mine] + phrases.length[phrase[mine]]) if len(mine) else [])
            found: dict = {}
            for p in np.unique(phrase[mine]).tolist():
                found.update(dict.fromkeys(phrases.owners[p]))
            items.append(list(found))
        at = 0
        for batch in batches:
            n = batch.num_rows
            own_spans, own_items, own_counts = spans[at : at + n], items[at : at + n], counts[at : at + n]
            columns = list(batch.columns)
            if old:
                own_spans = [merged(*np.array(a + [(x["first"], x["last"]) for x in b], np.int64).reshape(-1, 2).T) for a, b in zip(own_spans, columns[old[1]].to_pylist(), strict=True)]
                own_items = [list(dict.fromkeys([*b, *a])) for a, b in zip(own_items, columns[old[2]].to_pylist(), strict=True)]
                columns = [c for k, c in enumerate(columns) if k not in old]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            made = [pa.array(own_counts, pa.int64()), pa.array([[{"first": a, "last": b} for a, b in s] for s in own_spans], kind), pa.array(own_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[str(k) for k in range(len(columns) + 3)])
            at += n

    def scan(batches):
        phrases = Phrases(*phrases_of.value)
        get = phrases.vocabulary.get
        pending, counts, numbers, kept, held = [], [], [], 0, 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                begin = at
                while at < whole.num_rows and kept < SHARD_WORDS and held < SHARD_BYTES:
                    row = words(whole.column(text_at)[at].as_py())
                    found = np.fromiter(map(get, row, itertools.repeat(0)), np.int32, len(row))
                    counts.append(len(row))
                    numbers.append(found)
                    kept += int(np.count_nonzero(found))
                    held += sum(map(len, row))
                    at += 1
                pending.append(whole.slice(begin, at - begin))
                if kept >= SHARD_WORDS or held >= SHARD_BYTES:
                    yield from flush(pending, counts, numbers, phrases)
                    pending, counts, numbers, kept, held = [], [], [], 0, 0
        if pending:
            yield from flush(pending, counts, numbers, phrases)

    return scan


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Blocks of (item as text or None, text) of at most BLOCK_WORDS words, one at a time in the driver."""
    block, held = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1] or "") // 2 + 1
        if held >= BLOCK_WORDS:
            yield block
            block, held = [], 0
    yield block


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, spans (merged hit spans in words, [first, last)) and items (ids as text, unsorted).

    A word is a run of digits, letters and characters beyond ASCII; A-Z count as a-z. Items of fewer than `window`
    words are one phrase, items without words none. Null and empty texts have no words and no spans. Repeated rows
    are judged alike; repeated items count once by id; an item with a null id hits and appears as a null in items.
    An empty benchmark hits nothing. If docs has columns of these names, the new ones take underscores in front.
    """
    sc = docs.sparkSession.sparkContext
    names = fresh(docs, "n_words", "spans", "items")
    out = docs
    plain = [f for f in docs.schema.fields]
    extra = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))), T.StructField(names[2], T.ArrayType(T.StringType()))]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in plain] + extra)
    text_at = [f.name for f in plain].index(text_col)
    ws, sent = Workspace(docs.sparkSession, "overlaps"), None
    for k, block in enumerate(_blocks(benchmark, item_id, item_text)):
        if sent is not None:  # one pass at a time: its phrases leave the executors before the next ones come
            out = ws.write(out, "pass")
            sent.destroy()
        found = Phrases.of(block, window)
        sent = sc.broadcast((found.vocabulary, found.matrix, found.length, found.owners))  # plain values: executors may lack this module
        old = (len(plain), len(plain) + 1, len(plain) + 2) if k else None
        out = out.mapInArrow(_scanner(sent, text_at, old), schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of find_overlaps for every row; see there for nulls, ties and repeats."""
    found = find_overlaps(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark)
    hit = F.aggregate(F.transform("spans", lambda x: x["last"] - x["first"]), F.lit(0).cast("long"), lambda a, x: a + x)
    ids = F.array_sort(F.filter("items", lambda x: x.isNotNull()))
    return found.select(
        F.col("doc_id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _cut(spans, text: str | None) -> str | None:
    """The text without the words of the spans; what stood between them stays."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    plain = np.frombuffer(raw.translate(_WORD_BYTES), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], plain.astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s in spans:
        out.append(raw[at : begins[s["first"]]])
        at = ends[s["last"] - 1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the hit spans cut out of their texts; every row stays, and rows without hits stay as they are."""
    found = find_overlaps(docs, benchmark, text_col)
    spans = found.columns[-2]
    at = found.columns.index(text_col)
    place = len(found.columns) - 2

    def cut(batches):
        for batch in batches:
            texts = [_cut(s, t) for s, t in zip(batch.column(place).to_pylist(), batch.column(at).to_pylist(), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns[: place - 1], names=[str(k) for k in range(place - 1)])

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    assert spans not in docs.columns
    return found.mapInArrow(cut, schema)
