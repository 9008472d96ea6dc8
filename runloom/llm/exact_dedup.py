"""Exact deduplication by a stateful stream over a disk-backed key store; DataFrame functions only.

The stream reads the table in micro-batches and keeps, per digest and without expiry, the stable
identifier that stays, the number of copies and the locator (file) of the row that stays. State lives
in RocksDB and in its checkpoint in the shared folder, so a lost executor or a restart resumes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runloom.llm.common import ascii_lower, stored, work_folder

#: State on disk; no disk is set aside ahead of use, since there is one store for each partition.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _normal(df: DataFrame) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return df.select("doc_id", text.alias("body")).withColumn("text_sha256", F.sha2(F.col("body").cast("binary"), 256))


def digest_state(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """State after all files: text_sha256, keep_id, group_size, locator."""
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a single file is a source as well as a folder
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    body = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    located = source.select(
        "doc_id", F.col("_metadata.file_path").alias("locator"), F.sha2(body.cast("binary"), 256).alias("text_sha256"))
    state = located.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "locator")).alias("kept"), F.count(F.lit(1)).alias("group_size"))
    updates = work_folder(spark, "dedup-updates")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        query = (state.writeStream.outputMode("update").foreachBatch(keep)
                 .option("checkpointLocation", work_folder(spark, "dedup-state")).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    shape = "text_sha256 string, kept struct<doc_id: bigint, locator: string>, group_size bigint, batch int"
    exists = _any(spark, updates)
    found = spark.read.schema(shape).parquet(updates) if exists else spark.createDataFrame([], shape)
    last = found.groupBy("text_sha256").agg(F.max_by(F.struct("kept", "group_size"), "batch").alias("s"))
    return last.select("text_sha256", F.col("s.kept.doc_id").alias("keep_id"), F.col("s.group_size").alias("group_size"),
                       F.col("s.kept.locator").alias("locator"))


def _any(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def exact_dedup(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, locator.

    Equal means identical after lower-casing A-Z; null counts as empty text. The largest doc_id of a
    group stays. Rows repeated with the same doc_id and text all count in group_size and all carry
    kept where their doc_id is keep_id. An empty table gives no rows; other columns are not read.
    On every hit (group of two or more) the full bytes are compared: the least and the greatest
    text of a digest, which map-side aggregation reduces to one pair a task, must be one;
    rows that share a digest without being equal are grouped anew by their bytes.
    """
    state = stored(digest_state(spark, path, files_per_batch), "dedup-digests")
    docs = _normal(spark.read.parquet(path))
    digests = stored(docs.drop("body"), "dedup-rows").join(state, "text_sha256")
    raw = spark.read.parquet(path).select("doc_id", "text")
    hits = digests.where("group_size > 1").select("doc_id", "text_sha256").distinct()
    body = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    bounds = raw.join(hits, "doc_id").groupBy("text_sha256").agg(F.min(body).alias("low"), F.max(body).alias("high"))
    clash = stored(bounds.where("low != high").select("text_sha256"), "dedup-clashes")
    plain = digests
    if clash.isEmpty():
        parted = None
    else:
        plain = digests.join(clash, "text_sha256", "left_anti")
        same = Window.partitionBy("text_sha256", "body")
        parted = docs.join(clash, "text_sha256").withColumn("keep_id", F.max("doc_id").over(same)).withColumn(
            "group_size", F.count(F.lit(1)).over(same)).withColumn("locator", F.lit(None).cast("string"))
    names = ["doc_id", "text_sha256", "keep_id", "group_size", "locator"]
    both = plain.select(names).unionByName(parted.select(names)) if parted is not None else plain
    return both.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256", "locator")


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(spark, f"{folder}/documents.parquet").drop("locator")


OP9_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""
