"""Language identification by mixture inference.

Byte 4-gram counts of every labelled training document, summed by language in Spark, give the likelihood of each word
in each language. A document is a mixture: expectation-maximisation over its words estimates the proportions, for the
best language alone, the best two, and so on; the set with the best likelihood less a penalty for each language wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import bound_batches, fresh

BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 8
#: A further language must raise the log-likelihood by this many times the log of the number of words.
PENALTY = 2.0
#: The model is broadcast; with this many languages it takes 128 MB. More are refused, not dropped.
MOST_LANGUAGES = 512
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Bytes of words as they are (texts come lower-cased), everything else as a space."""
    out = np.full(256, 32, np.uint8)
    out[97:123] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


def _grams(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bucket of the four bytes that end at each byte; the bytes before a document count as spaces."""
    wide = data.astype(np.uint32)
    code = wide.copy()
    for k in (1, 2, 3):
        back = np.full(len(wide), 32, np.uint32)
        back[k:] = wide[:-k]
        for j in range(k):
            at = first + j
            back[at[at < len(back)]] = 32
        code |= back << np.uint32(8 * k)
    code *= np.uint32(2654435761)
    return (code >> np.uint32(16)).astype(np.int64)


def _words(column):
    """Slices of a text column: rows i to j, buckets of all bytes, words as runs, first word of each row."""
    data, begin, end = K.utf8(column)
    table = _letters()
    for i, j in K.slices(begin, end, K.SLICE):
        base, stop = int(begin[i]), int(end[i:j].max())
        local = table[data[base:stop]]
        first, last = begin[i:j] - base, end[i:j] - base
        wb, we = K.runs(local != 32, first)
        grams = _grams(local, first[first < len(local)]) if len(local) else np.zeros(0, np.int64)
        yield i, j, grams, wb, we, np.searchsorted(wb, first), np.searchsorted(wb, last)


def gram_counts(train: DataFrame, text: Column, lang: Column) -> DataFrame:
    """(lang, bucket, n) over all training rows; partitions are summed before the shuffle."""

    def count(batches):
        held: dict[str, np.ndarray] = {}

        def out():
            for name, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, j, grams, wb, we, row_at, row_to in _words(batch.column(0)):
                for k in range(i, j):
                    a, b = row_at[k - i], row_to[k - i]
                    if b > a:
                        own = grams[wb[a] : we[b - 1]]
                        if langs[k] not in held:
                            held[langs[k]] = np.zeros(BUCKETS, np.int64)
                        held[langs[k]] += np.bincount(own, minlength=BUCKETS) if len(own) > 20_000 else 0
                        if len(own) <= 20_000:
                            np.add.at(held[langs[k]], own, 1)
            if len(held) > 64:
                yield from out()
        yield from out()

    bound_batches(train.sparkSession)
    part = train.select(F.lower(text).alias("text"), lang.cast("string").alias("lang")).where("text is not null and lang is not null")
    return part.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order and the log-likelihood of each bucket."""

    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p

    @classmethod
    def fit(cls, train: DataFrame, text: Column, lang: Column) -> Model:
        counts = gram_counts(train, text, lang).persist()
        try:
            languages = sorted(r[0] for r in counts.select("lang").distinct().take(MOST_LANGUAGES + 1))
            if len(languages) > MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
            place = {x: k for k, x in enumerate(languages)}
            table = np.full((len(languages), BUCKETS), SMOOTHING)
            # One row for each language and 1,024 buckets: at most MOST_LANGUAGES x 64 rows.
            packed = counts.groupBy("lang", F.shiftright("bucket", 10).alias("part")).agg(F.collect_list(F.struct("bucket", "n")).alias("x"))
            for row in packed.toLocalIterator():
                at = np.array([(b, n) for b, n in row["x"]], np.int64)
                table[place[row["lang"]], at[:, 0]] += at[:, 1]
        finally:
            counts.unpersist()
        return cls(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def _mix(likelihood: np.ndarray, doc: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document; likelihood: words x languages, rows of a document together."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    length = np.diff(np.append(starts, len(likelihood)))[:, None]
    for _ in range(ROUNDS):
        joint = likelihood * share[doc]
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(joint, starts, axis=0) / length
    total = (likelihood * share[doc]).sum(axis=1)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)), starts)


def infer(model: Model, grams, wb, we, row_at, row_to) -> np.ndarray:
    """Proportions of the selected languages for each row; zeros where a row has no word."""
    shares = np.zeros((len(row_at), len(model.languages)))
    rows = np.flatnonzero(row_to > row_at)
    if not len(rows) or not model.languages:
        return shares
    edges = np.empty(2 * len(wb), np.int64)
    edges[0::2], edges[1::2] = wb, we
    if edges[-1] == len(grams):
        edges = edges[:-1]
    log_word = np.stack([np.add.reduceat(t[grams], edges)[0::2] for t in model.log_p], axis=1).astype(np.float64)
    starts = row_at[rows]
    doc = np.repeat(np.arange(len(rows)), row_to[rows] - starts)
    best = log_word.max(axis=1, keepdims=True)
    likelihood = np.exp(np.maximum(log_word - best, -60.0))
    single = np.add.reduceat(log_word - best, starts, axis=0)
    n = len(model.languages)
    chosen = np.zeros((len(rows), n))
    chosen[np.arange(len(rows)), single.argmax(axis=1)] = 1.0
    fit = single.max(axis=1)
    penalty = PENALTY * np.log1p(row_to[rows] - starts)
    if n > 1:
        every, _ = _mix(likelihood, doc, starts, np.ones((len(rows), n)))
        order = np.argsort(-every, axis=1, kind="stable")
        open_rows = np.arange(len(rows))
        for k in range(2, n + 1):
            allowed = np.zeros((len(open_rows), n))
            np.put_along_axis(allowed, order[open_rows, :k], 1.0, axis=1)
            inside = np.isin(doc, open_rows)
            part_doc = np.searchsorted(open_rows, doc[inside])
            part_starts = np.searchsorted(part_doc, np.arange(len(open_rows)))
            share, found = _mix(likelihood[inside], part_doc, part_starts, allowed)
            better = found - penalty[open_rows] > fit[open_rows]
            open_rows = open_rows[better]
            if not len(open_rows):
                break
            chosen[open_rows] = share[better]
            fit[open_rows] = found[better]
    shares[rows] = chosen
    return shares


def mixture_names(docs: DataFrame) -> tuple[str, ...]:
    """The names of the columns that mixtures() adds to docs: language, score, mixture."""
    return fresh(docs, "lang_pred", "score", "mixture")


def mixtures(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and mixture (array of (lang, share), largest first).

    lang_pred is the language of the largest share (ties: first in order), score its share. Null texts, texts without
    a letter (and all texts where nothing was learned) are `und` with score 0 and an empty mixture; a text whose only
    letters lie outside the words known here falls to the first language by its likelihoods. Every row stays, repeated
    rows are judged alike, and very long texts are read whole. If docs has columns of these names, the new ones take
    underscores in front; use mixture_names(docs).
    """
    names_out = mixture_names(docs)
    low, letter_col = fresh(docs, "lower", "letter")
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p))  # plain values: executors may lack this module

    def predict(batches):
        model = Model(*sent.value)
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            text, letter = batch.column(batch.num_columns - 2), np.asarray(batch.column(batch.num_columns - 1).fill_null(False))
            parts = [infer(model, *x[2:]) for x in _words(text)]
            shares = np.concatenate(parts) if parts else np.zeros((0, len(model.languages)))
            shares[~letter] = 0
            score = shares.max(axis=1, initial=0.0)
            known = score > 0
            label = np.where(known, shares.argmax(axis=1) if shares.shape[1] else 0, len(names) - 1)
            lists = [[{"lang": names[k], "share": float(row[k])} for k in np.argsort(-row, kind="stable") if row[k] > 0] for row in shares]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(names[label].tolist(), pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(lists, kind)],
                names=[str(k) for k in range(batch.num_columns + 1)],
            )

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    text = F.col(text_col)
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    kinds = ("string", "double", "array<struct<lang:string,share:double>>")
    added = ", ".join(f"`{name}` {kind}" for name, kind in zip(names_out, kinds, strict=True))
    return docs.select(*columns, F.lower(text).alias(low), text.rlike(r"\p{L}").alias(letter_col)).mapInArrow(predict, f"{fields}, {added}")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 modulo 3; false for a null id, which is never learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    train = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(lang_col).isNotNull())
    return Model.fit(train, F.col(text_col), F.col(lang_col))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; see mixtures() for the odd cases."""
    found = mixtures(docs.select("doc_id", "text"), learned(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")
