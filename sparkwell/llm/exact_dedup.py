"""Operator 3: exact deduplication by stateful streaming, with built-in functions only.

Each row of the input becomes a narrow record: a digest of the text without white space, the row's
id and length, and a locator of its content (file and row in the file). A Structured Streaming
aggregation over these records keeps, for each digest and without expiry, the record that stays and
the number of rows. Its state lies in RocksDB on the executors' disks with checkpoints in the shared
folder, so a later batch of rows goes on from it. A digest that was hit more than once is a
candidate only: the full texts behind it, those of earlier batches fetched by their locators, are
then grouped byte by byte, with map-side combining, so that a group of any size stays cheap, and
rows whose digests collide are told apart.

Defined cases: null text counts as empty; all texts of white space only are equal; a null doc_id
loses against any other and is returned as null; of rows alike in all of this the last in file
order stays, so exactly one row of a group has kept = true; a batch of a state that is sent again
under its name isn't added again; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkwell.llm.common import exists, kept_rows, located, materialize, only_places, scratch, table, text_of

#: The characters that equality leaves out: space and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: Hit digests are broadcast (8 bytes each) up to this count, beyond it they are joined by a shuffle.
BROADCAST_DIGESTS = 200_000

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space ahead of need
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def normalized(text: Column) -> Column:
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha256_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _better() -> Column:
    """Orders rows: the largest stays. Most code points, then the smallest doc_id (null last); ties: the last place."""
    return F.struct(F.col("_len"), (F.col("doc_id").isNotNull()).alias("_has"), F.bitwise_not("doc_id").alias("_neg"))


def run_state(spark: SparkSession, records_path: str, schema, checkpoint: str, out: str) -> None:
    """Feed all records that the checkpoint hasn't seen into the keyed state; append the changed keys of each micro-batch to out."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        state = (
            spark.readStream.schema(schema).parquet(records_path)
            .groupBy("_digest")
            .agg(F.max(F.struct("_best", "_loc")).alias("_top"), F.count(F.lit(1)).alias("_n"))
        )

        def emit(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/_b={batch_id}")

        state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(emit).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dedup(docs: DataFrame, digest=sha256_digest, state_dir: str | None = None, batch: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, __sw_file, __sw_row.

    state_dir: where records, streaming checkpoint and state output stay; a further call with the
    same folder adds its rows to the state and returns the rows of all batches, whose files must
    still be there (None: a new folder, for these rows alone). batch: the name of these rows in the
    state; a job that repeats a batch gives the same name (None: a new one).
    """
    spark = docs.sparkSession
    rows = located(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "__sw_file", "__sw_row")
    root, batch = state_dir or scratch(spark, "dedup-state"), batch or uuid.uuid4().hex
    records = rows.select(
        "doc_id", "__sw_file", "__sw_row", digest(normalized(text_of())).alias("_digest"), F.length(text_of()).cast("long").alias("_len"),
        *([] if digest is sha256_digest else [sha256_digest(normalized(text_of())).alias("_sha")]),
    ).withColumns({"_best": _better(), "_loc": F.struct("__sw_file", "__sw_row", "doc_id")})
    schema = StructType([*records.schema.fields, StructField("batch", StringType())])
    here = f"{root}/records/batch={batch}"
    if not exists(spark, f"{here}/_SUCCESS"):  # what a failed job has left is written anew
        records.write.mode("overwrite").parquet(here)
    records = spark.read.schema(schema).parquet(f"{root}/records")
    run_state(spark, f"{root}/records", schema, f"{root}/checkpoint", f"{root}/groups")
    if exists(spark, f"{root}/groups"):
        changed = spark.read.parquet(f"{root}/groups")
        last = W.partitionBy("_digest").orderBy(F.desc("_batch"))
        groups = changed.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("_digest", "_top", "_n")
    else:
        groups = records.groupBy("_digest").agg(F.max(F.struct("_best", "_loc")).alias("_top"), F.count(F.lit(1)).alias("_n"))
    # as a table of its own, so that the joins with it may split a digest that many rows have
    return _verified(spark, rows, records, materialize(groups, "dedup-groups"), digest, batch)


def _readable(file: str) -> str:
    """The path of a file by its name in _metadata, which is written as a URI; a reader takes a path, with patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(file))


def _contents(spark: SparkSession, rows: DataFrame, records: DataFrame, hits: DataFrame, digest, batch: str) -> DataFrame:
    """__sw_file, __sw_row, _digest and _text of all rows whose digest was hit: of this batch as they are read, of earlier ones by their locators."""
    body = rows.select("__sw_file", "__sw_row", normalized(text_of()).alias("_text")).withColumn("_digest", digest(F.col("_text")))
    if hits.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        key = F.xxhash64("_digest")  # a digest whose key equals that of a hit stays too, and forms groups of its own
        body = body.withColumn("_key", key).join(F.broadcast(hits.select(key.alias("_key")).distinct()), "_key", "left_semi")
    else:
        body = body.join(hits, "_digest", "left_semi")
    body = body.select("__sw_file", "__sw_row", "_digest", "_text")
    before = records.where(F.col("batch") != batch).join(hits, "_digest", "left_semi").select("__sw_file", "__sw_row", "_digest")
    files = [r[0] for r in before.select("__sw_file").distinct().collect()]  # as many as a reader of them has to list
    if not files:
        return body
    older = located(spark.read.parquet(*map(_readable, files)).select("text")).select("__sw_file", "__sw_row", normalized(text_of()).alias("_text"))
    return body.unionByName(only_places(older, before))


def _verified(spark: SparkSession, rows: DataFrame, records: DataFrame, groups: DataFrame, digest, batch: str) -> DataFrame:
    hits = groups.where("_n > 1").select("_digest")
    body = _contents(spark, rows, records, hits, digest, batch)
    # full bytes: one group for each text behind a digest that was hit
    texts = body.groupBy("_digest", "_text").agg(F.count(F.lit(1)).alias("_same"))
    clash = texts.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_digest")
    clash = materialize(clash, "dedup-clash")
    sha = F.col("_digest") if digest is sha256_digest else F.col("_sha")
    row = records.select("doc_id", "__sw_file", "__sw_row", "_digest", sha.alias("text_sha256"), "_best", "_loc")
    done = row.join(groups, "_digest")
    if not clash.isEmpty():
        # different texts under one digest: their rows are grouped by the text itself
        done = done.join(clash, "_digest", "left_anti")
        part = body.join(clash, "_digest", "left_semi").select("__sw_file", "__sw_row", "_text")
        part = part.join(row, ["__sw_file", "__sw_row"])
        best = part.groupBy("_digest", "_text").agg(F.max(F.struct("_best", "_loc")).alias("_top"), F.count(F.lit(1)).alias("_n"))
        done = done.unionByName(part.join(best, ["_digest", "_text"]).drop("_text"), allowMissingColumns=True)
    kept = (F.col("_top._loc.__sw_file") == F.col("__sw_file")) & (F.col("_top._loc.__sw_row") == F.col("__sw_row"))
    return done.select(
        "doc_id", F.col("_top._loc.doc_id").alias("keep_id"), F.col("_n").alias("group_size"), kept.alias("kept"), "text_sha256", "__sw_file", "__sw_row",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row keeps; the columns stay."""
    return kept_rows(docs, dedup)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("__sw_file", "__sw_row")


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as n from documents),
g as (select doc_id, n, row_number() over (partition by n order by length(t) desc, doc_id) as r,
             first_value(doc_id) over (partition by n order by length(t) desc, doc_id) as keep_id,
             count(*) over (partition by n) as group_size from d)
select doc_id, keep_id, group_size, r = 1 as kept, sha256(n) as text_sha256 from g
"""
