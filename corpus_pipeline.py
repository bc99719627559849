"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Every stage takes all rows that the one before it kept and returns the columns of documents; the last adds the place of
each row. run() writes each stage's result in the shared folder, so that a lost executor never costs a whole pipeline.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import fmindex, langmix, minhash, mixing, sharding
from tallyforge.llm.shared import Workspace, among, fresh, table

#: A text is rejected if its best language has less than this share of it, or if it has no letter.
LEAST_SHARE = 0.5
#: Shingles of five words, similarity 0.8 or more.
NEAR = minhash.Plan(percent=80, rows=7)
#: Words of a block of the mix: most documents stay whole.
MIX_BLOCK = 512
SHARDS = 16

#: The stages learn, permute and draw by hashes that SQL lacks; a brute-force version tests them instead.
ORACLE_SQL = None


def _with_text(docs: DataFrame) -> DataFrame:
    """n_chars after a change of text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


#: Workspaces of earlier stages, which a stage clears once it reads none of them any more.
_left: list[Workspace] = []


def _stage(function):
    """Clears what earlier stages have written for themselves: their results have been written and are docs by now."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _left else []
        for ws in [w for w in _left if not any(w.root.removeprefix("file:").lstrip("/") in f for f in read)]:
            ws.clear()
            _left.remove(ws)
        mark = len(Workspace.open)
        out = function(spark, docs, sf_dir)
        _left.extend(Workspace.open[mark:])
        return out

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts that no language has half of; the others stay as they are."""
    found = langmix.mixtures(docs, langmix.learned(docs))
    lang, score, _ = langmix.mixture_names(docs)
    return found.where((F.col(lang) != langmix.UNKNOWN) & (F.col(score) >= LEAST_SHARE)).select(*docs.columns)


@_stage
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, that of the smallest doc_id (null last), and all texts without words.

    Rows are told apart by a number of their own, so repeated and null ids change nothing: of rows that share a text
    one stays, and rows that share only their id are judged by their texts."""
    ws = Workspace(spark, "dedup")
    (uid, group) = fresh(docs, "uid", "group")
    rows = ws.write(docs.withColumn(uid, F.monotonically_increasing_id()), "rows")
    held = Workspace(spark, "minhash")
    found = minhash.near_duplicates(rows, NEAR, id_col=uid, ws=held).select(uid, F.col("component_id").alias(group))
    found = ws.write(rows.select(uid, "doc_id").join(found, uid), "found")
    held.clear()
    kept = found.groupBy(group).agg(F.min_by(uid, F.struct(F.col("doc_id").isNull(), "doc_id", uid)).alias(uid))
    return among(rows, kept.select(uid), uid, ws, minhash.BROADCAST_IDS).select(*docs.columns)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words of benchmark passages out of the texts; every document stays."""
    return _with_text(fmindex.decontaminate(docs, table(spark, sf_dir, "benchmark"))).select(*docs.columns)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws blocks of the sources to their target shares; one row for each stretch of a document in a drawn block."""
    return _with_text(mixing.mixed_documents(docs, block=MIX_BLOCK)).select(*docs.columns)


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot."""
    return sharding.sharded(docs, SHARDS)


STAGES = [("language ID", language), ("near-dedup", dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ws = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = ws.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
