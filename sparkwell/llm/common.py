"""What the operators of this subpackage share: tables, shared folders and text helpers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparkwell.shared import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder of the workspace that is open, if any.
_OPEN: ContextVar[str | None] = ContextVar("workspace", default=None)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return new_folder(spark, what)


@contextmanager
def workspace(spark: SparkSession, what: str) -> Iterator[None]:
    """What is materialized inside lies in one folder, which goes at the end, but for tables that outlive it."""
    at = scratch(spark, what)
    token = _OPEN.set(at)
    try:
        yield
    finally:
        _OPEN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a shuffle's files go when the query that wrote them ends, not when the driver collects its garbage.

    For jobs that materialize what they read again; a DataFrame that is run twice writes its shuffles twice.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, what: str, outlives: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives lost executors."""
    at = _OPEN.get()
    path = f"{at}/{what}-{uuid.uuid4().hex}" if at and not outlives else scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()) if fs.exists(at) else []


def text_of(column: str = "text") -> Column:
    """A document's text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine; SPARKWELL_VOCAB_DIR overrides the installed place."""
    if own := os.environ.get("SPARKWELL_VOCAB_DIR"):
        return os.path.join(own, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: Keys (8 bytes each, places 24) are broadcast up to this count, beyond it rows are found by a shuffle alone.
BROADCAST_KEYS = 200_000


def located(docs: DataFrame) -> DataFrame:
    """docs with __sw_file and __sw_row, the place of each row; docs that don't come from files are first written to the shared folder; located docs stay as they are."""
    at = {"__sw_file": F.col("_metadata.file_path"), "__sw_row": F.col("_metadata.row_index")}
    if {*at} <= {*docs.columns}:
        return docs
    try:
        return docs.withColumns(at)
    except AnalysisException:
        return materialize(docs, "located").withColumns(at)


def kept_rows(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without the rows that judge, which gets them located, marks as not kept; the columns stay, whatever their names."""
    names = {}
    for c in docs.columns:
        if c in ("__sw_file", "__sw_row"):
            names[c] = f"{c}_"
            while names[c] in docs.columns:
                names[c] += "_"
    rows = located(docs.withColumnsRenamed(names))
    dropped = judge(rows).where(~F.col("kept")).select("__sw_file", "__sw_row")
    left = rows.join(dropped, ["__sw_file", "__sw_row"], "left_anti")
    return left.select(*(F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns))


def only_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of a located table whose place is in places (__sw_file, __sw_row, each once), with the other columns of places.

    Few places are sent to all rows, with a hash for the file, so that no row is moved; more are found by a shuffle.
    """
    if places.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        key = F.xxhash64("__sw_file", "__sw_row").alias("_key")
        sent = places.select(key, *(F.col(c) for c in places.columns if c != "__sw_file"))
        return rows.withColumn("_key", key).join(F.broadcast(sent), ["_key", "__sw_row"]).drop("_key")
    return rows.join(places, ["__sw_file", "__sw_row"])


def only_nodes(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows (node, ...) whose node stands in pairs (a, b): cut before they move, if the nodes are few."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    return rows.join(F.broadcast(nodes), "node", "left_semi") if nodes.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else rows


def connected(edges: DataFrame, what: str = "components") -> DataFrame:
    """node and label, the smallest node of its component, of the nodes of edges (a, b); each round is written to the shared folder."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("peer")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("peer"))).distinct()
    labels = materialize(both.groupBy("node").agg(F.least(F.min("peer"), F.col("node")).alias("label")), what)
    while True:
        near = both.join(labels.select(F.col("node").alias("peer"), F.col("label").alias("other")), "peer").groupBy("node").agg(F.min("other").alias("other"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = materialize(lower.join(jump, "label").select("node", F.least("label", "far").alias("label"), (F.least("label", "far") < F.col("old")).alias("moved")), what)
        if after.where("moved").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def merged(labels: DataFrame | None, edges: DataFrame, what: str = "components") -> DataFrame | None:
    """labels (node, label) after more edges (a, b): only the graph of the labels that the edges join is searched."""
    if edges.isEmpty():
        return labels
    if labels is None:
        return connected(edges, what)
    known = labels.union(edges.select("a", "a").union(edges.select("b", "b"))).groupBy("node").agg(F.min("label").alias("label"))
    known = materialize(known, what)
    of = lambda c: known.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    between = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
    joined = connected(materialize(between, what), what).select(F.col("node").alias("label"), F.col("label").alias("low"))
    return materialize(known.join(joined, "label", "left").select("node", F.coalesce("low", "label").alias("label")), what)
