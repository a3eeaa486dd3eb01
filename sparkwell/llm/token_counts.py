"""Operator 10: token counts kept up to date by deltas.

Totals of documents, tokens and characters by source, language and tokenizer version are sums of
signed changes: an insert adds its counts, a delete takes them away, a revised count does both. Each
batch of changes is summed first (in map tasks, so that a source with a third of all rows moves as one
row from each) and committed as one small table under the batch's name in the store. A batch that is
already committed is not applied again, so a job may repeat it after a failure; totals add up the
committed batches and nothing else, and compact() folds them into one, which remembers their names.

Defined cases: null text has no tokens; null sources and languages are groups of their own; repeated
rows count each; of exact copies the rows with the smallest doc_id (null last) stay in the query, also
if that id is repeated; groups whose documents are all gone aren't in the totals; an empty batch can be
committed and changes nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm.bpe import BYTE_BPE, encoder
from sparkwell.llm.common import exists, folders, materialize, scratch, table, text_of

GROUP = ["source", "lang", "tokenizer"]
SUMS = ["documents", "tokens", "chars"]
DELTA = "source string, lang string, tokenizer string, documents long, tokens long, chars long"


class Rollup:
    """A store of committed batches in a folder that Spark can reach.

    batches/<name> is one batch, committed once its _SUCCESS is there. folded/totals and folded/names
    are the sums and the names of batches that compact() has put together; they count once folded/done is there.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, batch: str) -> str:
        return f"{self.path}/batches/{quote(batch, safe='')}"

    def _done(self, path: str) -> bool:
        return exists(self.spark, f"{path}/_SUCCESS")

    def _names(self) -> list[str]:
        """Committed batches that aren't folded."""
        return [unquote(x) for x in folders(self.spark, f"{self.path}/batches") if self._done(f"{self.path}/batches/{x}")]

    def _folded(self) -> DataFrame:
        at = f"{self.path}/folded"
        return self.spark.read.schema("batch string").parquet(f"{at}/names") if self._done(f"{at}/done") else self.spark.createDataFrame([], "batch string")

    def committed(self, batch: str) -> bool:
        return self._done(self._at(batch)) or not self._folded().where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes (source, lang, tokenizer, sign, tokens, chars) once; False if the batch was committed before.

        The marker file appears when all is written: a batch that failed midway is written anew.
        """
        if self.committed(batch):
            return False
        sums = changes.groupBy(*GROUP).agg(*(F.sum(F.col("sign") * x).cast("long").alias(n) for n, x in zip(SUMS, (F.lit(1), F.col("tokens"), F.col("chars")), strict=True)))
        sums.write.mode("overwrite").parquet(self._at(batch))
        return True

    def totals(self) -> DataFrame:
        return self._sums(self._names())

    def _sums(self, names: list[str]) -> DataFrame:
        """Totals of what is folded and of these batches."""
        paths = [self._at(n) for n in names]
        if self._done(f"{self.path}/folded/done"):
            paths.append(f"{self.path}/folded/totals")
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        deltas = self.spark.read.schema(DELTA).parquet(*paths)
        return deltas.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS)).where("documents <> 0 or tokens <> 0 or chars <> 0")

    def compact(self, path: str) -> Rollup:
        """A new store with the totals and the names of all batches committed so far; the old one stays as it is.

        Both come from one list of batches, and count together or not at all: a batch that is committed meanwhile
        is in neither, and what a failed call leaves is an empty store.
        """
        new, names = Rollup(self.spark, path), self._names()
        self._sums(names).write.mode("overwrite").parquet(f"{new.path}/folded/totals")
        every = self.spark.createDataFrame([(n,) for n in names], "batch string").union(self._folded())
        every.write.mode("overwrite").parquet(f"{new.path}/folded/names")
        self.spark.range(1).write.mode("overwrite").parquet(f"{new.path}/folded/done")
        return new


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old counts out, new counts in."""
    return deletes(before).unionByName(inserts(after))


def counted(docs: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """source, lang, tokenizer, digest, doc_id, tokens and chars of each row, and both again with white space runs as one space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for b in batches:
            n, m = [], []
            for t, c in zip(b.column("text"), b.column("clean"), strict=True):
                n.append(len(encode(t.as_py())) // 4)
                m.append(n[-1] if c.as_py() is None else len(encode(c.as_py())) // 4)
            keep = ["doc_id", "source", "lang", "digest", "chars", "clean_chars"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(m, pa.int64())], [*keep, "tokens", "clean_tokens"])

    text = text_of()
    clean = F.trim(F.regexp_replace(text, r"\s{2,}|[\t\r\n\f]", " "))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", text.alias("text"), clean.alias("_clean"), F.sha2(text.cast("binary"), 256).alias("digest"))
    rows = rows.withColumns({"chars": F.length("text").cast("long"), "clean_chars": F.length("_clean").cast("long"), "clean": F.when(F.col("_clean") != F.col("text"), F.col("_clean"))}).drop("_clean")
    out = rows.mapInArrow(run, "doc_id long, source string, lang string, digest string, chars long, clean_chars long, tokens long, clean_tokens long")
    return out.withColumn("tokenizer", F.lit(tokenizer))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents: every row in, surplus exact copies out, counts revised after white space is cleaned; the last one sent twice."""
    counts = materialize(counted(table(spark, sf_dir, "documents")), "token-counts")
    raw = counts.select(*GROUP, "tokens", "chars")
    # only copies need their digest's smallest id; as a table of its own, so that the join may split a digest that many rows have
    stays = counts.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"))).alias("_stays"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    marked = counts.join(materialize(stays.select("digest", "_stays"), "token-copies"), "digest", "left").withColumn("_stay", F.col("_stays").isNull() | (F.col("_stays") == F.struct(F.col("doc_id").isNull(), F.col("doc_id"))))
    marked = materialize(marked.select(*GROUP, "tokens", "chars", "clean_tokens", "clean_chars", "_stay"), "token-marked")
    changed = marked.where(F.col("_stay") & ((F.col("tokens") != F.col("clean_tokens")) | (F.col("chars") != F.col("clean_chars"))))
    after = changed.select(*GROUP, F.col("clean_tokens").alias("tokens"), F.col("clean_chars").alias("chars"))
    store = Rollup(spark, scratch(spark, "token-rollup"))
    store.commit("insert", inserts(raw))
    store.commit("delete", deletes(marked.where(~F.col("_stay")).select(*raw.columns)))
    revised = revisions(changed.select(*raw.columns), after)
    store.commit("revise", revised)
    store.commit("revise", revised)
    return store.totals()
