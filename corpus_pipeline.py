"""The corpus pipeline: quality, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs; all but the
last return the columns of documents. Rows that share a doc_id are one document, which stays if any of them does; rows without doc_id pass the two
deduplications and are taken once by the mixing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.llm.common import Scratch, remove_by_ids, table, whole_row
from rowlens.llm.exact_dedup import dedup_exact
from rowlens.llm.mixing import mix
from rowlens.llm.near_dedup import near_dedup
from rowlens.llm.packing import pack_documents
from rowlens.llm.quality import fit_quality, score_quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score of at least 0.7; all of them if there are no labels to learn from.

    Null and empty texts are scored by their statistics; repeated rows score alike, so all of them stay or go. An empty table stays
    empty. Other columns, whatever their names, come back as they were.
    """
    machine = fit_quality(docs, table(spark, sf_dir, "labels"))
    if not machine.rows:
        return docs
    return score_quality(docs, machine, keep_row=True).filter("predicted = 1").select("row.*")


def _gone(found: DataFrame) -> DataFrame:
    """Ids of which no row is kept."""
    return found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("not kept").select("doc_id")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the most code points, then of the smallest id.

    Null, empty and blank texts are equal to each other. All rows of an id stay or go together; rows without an id stay. An empty table stays empty.
    Other columns, whatever their names, come back as they were.
    """
    with Scratch(spark) as s:
        gone = s.keep(_gone(dedup_exact(docs, s)))
    return remove_by_ids(docs, gone, "doc_id")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group linked by five-word shingles at a similarity of 0.8.

    Null, empty and blank texts link with nothing. All rows of an id stay or go together; rows without an id stay. An empty table stays empty.
    Other columns, whatever their names, come back as they were.
    """
    with Scratch(spark) as s:
        gone = s.keep(_gone(near_dedup(docs, s, size=5, percent=80)))
    return remove_by_ids(docs, gone, "doc_id")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies of it.

    Null, empty and blank texts have no words and go; a null source is a source of its own. Of rows that share an id each comes as often as the most
    frequent of them, and rows without an id come once. An empty table stays empty. Other columns, whatever their names, come back as they were.
    """
    with Scratch(spark) as s:
        copies = s.keep(mix(docs, s).groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("copies")))
    # Always a join of sorted sides: the copies of a large corpus are no table to broadcast.
    out = docs.select(F.col("doc_id").alias("id"), whole_row(docs)).join(copies.hint("merge"), "id", "left").withColumn("copies", F.coalesce("copies", F.lit(1)).cast("int"))
    return out.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences. A null text is empty; repeated rows are packed each; a null id is kept; an empty table gives no rows."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: A trained classifier, sampling and a tokenizer cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    with Scratch(spark) as s:
        for name, stage in STAGES[:-1]:
            docs = s.save(stage(spark, docs, sf_dir), name)
            if before is not None:
                s.drop(before)
            before = docs
        return s.keep(STAGES[-1][1](spark, docs, sf_dir))
