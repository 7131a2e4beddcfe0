"""Exact deduplication as a stateful stream.

Documents arrive as a stream of digests. The state, in RocksDB on disk and without expiry, keeps for each digest of the
normalised text the stable id and content locator (file and row) of the best document so far and the size of its group; a later run with the same
state folder goes on from it. Hits are then checked on full bytes, fetched by their locators: every copy's normalised text against that of the
document that stays, so a digest collision cannot drop a document.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, prune_by_ids

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # stores of a stream that has ended are let go this soon
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store takes megabytes before it holds a row
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def run_stream(digests_path: str, schema, scratch: Scratch, checkpoint: str | None = None) -> DataFrame:
    """digest, best (chars, has_id, minus_id, doc_id, file, row), group_size: the state of all digests in files of digests_path new to the checkpoint."""
    spark, out = scratch.spark, scratch.path("state-out")
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        rank = F.struct("chars", F.col("doc_id").isNotNull().alias("has_id"), (-F.col("doc_id")).alias("minus_id"), "doc_id", "file", "row")
        state = spark.readStream.schema(schema).parquet(digests_path).groupBy("digest").agg(F.max(rank).alias("best"), F.count("*").alias("group_size"))

        def emit(df: DataFrame, epoch: int) -> None:  # the same epoch, run again, writes the same folder
            df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

        query = state.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", checkpoint or scratch.path("stream")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.parquet(out).drop("batch")
    if found.agg(F.min("epoch") != F.max("epoch")).first()[0]:  # a digest is updated by each batch that has it: its last state counts
        found = found.groupBy("digest").agg(F.max_by("best", "epoch").alias("best"), F.max("group_size").alias("group_size"))
    return found.drop("epoch")


def dedup_exact(docs: DataFrame, scratch: Scratch, digest=sha256, state_dir: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row of docs.

    docs needs doc_id and text; other columns are ignored. Null texts count as empty, and empty or blank texts are equal
    to each other. Of equal texts the one with the most code points stays, then the smallest doc_id; a null doc_id comes
    last. Rows that share a doc_id are one document: all of them stay if it stays. An empty table gives no rows.
    digest maps the normalised text to its key; a weak one only makes more hits fail the check of full bytes.

    state_dir, a shared folder, keeps the state: a later call with it compares its docs with those of earlier calls too, as far as they
    were there, and reads the texts that hits need by their locators. Documents must then stay in the files they were read from; texts of docs
    that are not read from Parquet files are written to the folder. Without it the state ends with scratch.
    """
    spark, where = docs.sparkSession, state_dir.rstrip("/") if state_dir else scratch.path("state")
    if not _located(docs):
        docs.select("doc_id", "text").write.parquet(at := f"{where}/texts/{uuid.uuid4().hex}")
        docs = spark.read.schema(docs.select("doc_id", "text").schema).parquet(at)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    rows = docs.select("doc_id", digest(normalised(F.col("text"))).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), *place)
    at = f"{where}/digests/{uuid.uuid4().hex}"
    rows.write.parquet(at)
    rows = spark.read.schema(rows.schema).parquet(at)
    if rows.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256" if digest is sha256 else "digest"))
    groups = run_stream(f"{where}/digests/*", rows.schema, scratch, f"{where}/checkpoint")
    here, there = F.struct("file", "row"), F.struct("best.file", "best.row")
    found = rows.join(groups, "digest").select("doc_id", "digest", "chars", here.alias("at"), F.col("best.doc_id").alias("keep_id"), there.alias("keep_at"), "group_size")
    found = scratch.save(found, "found")
    # Full bytes of hits, by their locators: only texts of groups with copies are read again, and a bitmap keeps most others out of the shuffle.
    hits = found.filter("group_size > 1 and at != keep_at").select("at", "keep_at", "digest")
    wanted = hits.select("at").union(hits.select("keep_at")).distinct()
    bodies = lambda df: df.select(F.struct(*place).alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    texts = bodies(docs)
    if state_dir:
        plain = lambda path: re.sub("^file:/+", "/", path)
        known = set(map(plain, docs.inputFiles()))
        earlier = [r[0] for r in hits.select("keep_at.file").distinct().collect() if plain(r[0]) not in known]  # files, as a scan would list them
        if earlier:
            texts = texts.union(bodies(spark.read.schema(docs.select("text").schema).parquet(*earlier)))
    texts = prune_by_ids(texts, wanted, "at").select("at", normalised(F.col("text")).alias("body"))
    checked = texts.join(hits, "at").join(texts.select(F.col("at").alias("keep_at"), F.col("body").alias("kept_body")), "keep_at")
    odd = scratch.save(checked.filter("body != kept_body").select("digest").distinct(), "collisions")
    if not odd.isEmpty():  # a digest collision: its texts are grouped by their bytes
        found = _regroup(docs, found, odd, digest)
    out = found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256" if digest is sha256 else "digest"))


def _located(docs: DataFrame) -> bool:
    """Whether the content of docs can be read again by file and row number."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:  # not read from Parquet files
        return False
    return "_metadata" not in docs.columns


def _regroup(docs: DataFrame, found: DataFrame, odd: DataFrame, digest) -> DataFrame:
    """found with every group that has a collision split by the texts' bytes (of this call's docs)."""
    rest = found.select("doc_id", "digest", "chars", "keep_id", "group_size").join(odd, "digest", "left_anti")
    full = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("body", normalised(F.col("text")))
    full = full.withColumn("digest", digest(F.col("body"))).join(odd, "digest").withColumn("chars", F.length("text").cast("long"))
    best = full.groupBy("digest", "body").agg(F.max(F.struct("chars", F.col("doc_id").isNotNull().alias("has_id"), (-F.col("doc_id")).alias("minus_id"), "doc_id")).alias("best"), F.count("*").alias("group_size"))
    again = full.join(best, ["digest", "body"]).select("doc_id", "digest", "chars", F.col("best.doc_id").alias("keep_id"), "group_size")
    return rest.unionByName(again)
