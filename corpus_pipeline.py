"""A training-corpus pipeline: language ID, toxicity, near-dedup, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import queries
from lectern.llm.common import keep, keep_last, let_go, numbered, recorded, release, small_batches
from lectern.llm.language import UNKNOWN, fit_language_filters, held_out, identify_languages
from lectern.llm.mixing import in_mixed_order, mix_sources
from lectern.llm.neardup import near_duplicates
from lectern.llm.packing import place_pieces, token_pieces
from lectern.llm.toxicity import fit_toxicity, score_toxicity

#: A document stays if its language holds at least this share of its n-grams.
LEAST_LANGUAGE_SCORE = 0.3

#: A stage within: session, documents under names of their own, those names by the names of the columns, folder of the tables.
Inner = Callable[[SparkSession, DataFrame, Mapping[str, str], str], DataFrame]


def on_names_of_its_own(f: Inner) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with the documents' columns renamed while it works, so that they may have any names; columns that the
    documents had come back under their names, and the stage's own columns follow."""

    @wraps(f)
    def go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        names = {f"c{i}": c for i, c in enumerate(docs.columns)}
        out = f(spark, docs.toDF(*names), {c: n for n, c in names.items()}, sf_dir)
        return out.toDF(*[names.get(c, c) for c in out.columns])

    return go


@on_names_of_its_own
def language_id(spark: SparkSession, docs: DataFrame, at: Mapping[str, str], sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) and texts that no language explains.  Each row is judged
    for itself; no rows: no rows; other columns stay, whatever their names."""
    filters = fit_language_filters(docs.where(~held_out(F.col(at["doc_id"]))), at["doc_id"], at["text"], at["lang"])
    scored = identify_languages(docs, filters, at["text"])
    return scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


@on_names_of_its_own
def toxicity(spark: SparkSession, docs: DataFrame, at: Mapping[str, str], sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier takes for toxic.  Null and empty texts are scored like texts without known
    words, and documents without an id like all others; each row is judged for itself, repeated ones too; no rows: no rows;
    other columns stay, whatever their names."""
    labels = queries.table(spark, sf_dir, "labels").select(F.col("doc_id").alias(at["doc_id"]), "toxic")
    known = ~held_out(F.col(at["doc_id"]))
    model = fit_toxicity(docs.where(known), labels.where(known), at["doc_id"], at["text"])
    return score_toxicity(docs, model, at["text"]).where("predicted = 0").select(*docs.columns)


@on_names_of_its_own
def minhash_neardup(spark: SparkSession, docs: DataFrame, at: Mapping[str, str], sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest id (of several rows of this id, one).
    Rows are told apart by number, so documents without an id and different texts under one id are
    judged like all others.  Texts without words have no copies.  No rows: no rows."""
    with recorded() as made:
        rows = numbered(docs)
        groups = near_duplicates(rows, "_row", at["text"]).withColumnRenamed("component_id", "_group").join(rows.select("_row", F.col(at["doc_id"]).alias("_id")), "_row")
        first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
        kept = keep(groups.groupBy("_group").agg(first.alias("f")).select(F.col("f.row").alias("_row")))
        let_go(made, rows, kept)
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


@on_names_of_its_own
def mixing(spark: SparkSession, docs: DataFrame, at: Mapping[str, str], sf_dir: str) -> DataFrame:
    """Puts all documents in the order of the mix, so that readers of the files in turn see the target
    weights; none is dropped.  Null texts have no bytes, documents without a source are of the pool of others, those
    without an id come first in their pool; equal ids are told apart by row.  No rows: no rows."""
    with recorded() as made:
        rows = numbered(docs)
        mixed = keep(mix_sources(rows, queries.WEIGHTS, queries.BLOCK_BYTES, at["doc_id"], at["source"], at["text"], ["_row"]).select("_row", "position"))
        let_go(made, rows, mixed)
    return in_mixed_order(rows, mixed, "_row").select(*docs.columns)


@on_names_of_its_own
def packing(spark: SparkSession, docs: DataFrame, at: Mapping[str, str], sf_dir: str) -> DataFrame:
    """Places the tokens of all documents in sequences.  The pieces of one length take their places in the
    order of the mix, so that the sequences of each pattern follow the target weights.  Files don't carry
    the order for certain, so it is worked out again (from keys and byte counts).  Null texts count as empty (one piece
    of one token); documents without an id or with a repeated one are documents of their own.  No rows: no rows."""
    key = at["doc_id"]
    with recorded() as made:
        rows = numbered(docs.select(key, at["source"], at["text"]))
        pieces = keep(token_pieces(rows, key, at["text"], carry=["_row"]).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
        mixed = mix_sources(rows, queries.WEIGHTS, queries.BLOCK_BYTES, key, at["source"], at["text"], ["_row"]).select("_row", F.col("position").alias("_place"))
        placed = keep(pieces.join(mixed, "_row"))
        let_go(made, placed)
    return place_pieces(placed, key, order=["_place"]).drop("_place", "_row")


STAGES = [("language_id", language_id), ("toxicity", toxicity), ("minhash_neardup", minhash_neardup), ("mixing", mixing), ("packing", packing)]

#: Fitted models and MinHash are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents.  Each result is written and reread, and what its stage kept for itself
    is deleted then, as is the result of the stage before; nothing that another run made is touched.  The last result
    is a kept table too: ``lectern.tables.release(result)`` deletes it."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for _, step in STAGES:
        docs = keep_last(lambda step=step, docs=docs: step(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return docs
