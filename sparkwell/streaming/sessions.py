"""Streams and keyed state: sessions, windows, late data, repeated requests, prefix commits, caches, retention.

Each operator takes a DataFrame and works on a stream and on a table alike, unless it says otherwise.
replay() feeds a table through Structured Streaming once and gives what the stream wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkwell.plans.views import oracle, view
from sparkwell.shared import new_folder


def replay(spark: SparkSession, path: str, operator: Callable[[DataFrame], DataFrame], mode: str = "append", time: str | None = None, key: list[str] | None = None, conf: dict[str, str] | None = None, files: int | None = None) -> DataFrame:
    """Run an operator over the Parquet files of path as a stream until all are read; the rows it wrote.

    time: in append mode, the event time column. A last row far in the future then closes what is
    still open at the end; its own group stays open and isn't written.
    key: in update mode, the columns that name a row, of which the last version is given.
    conf: settings of the session while the stream runs. files: how many files a micro-batch reads (None: all).
    """
    schema = spark.read.parquet(path).schema
    out, at = new_folder(spark, "stream-out"), new_folder(spark, "stream-checkpoint")
    # written as a pattern, the path may be a folder or a single file; a stream takes only folders by name
    reader = spark.readStream.schema(schema) if files is None else spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    rows = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    if time:
        last = spark.range(1).select(*(F.lit("2900-01-01" if f.name == time else None).cast(f.dataType).alias(f.name) for f in schema))
        end = new_folder(spark, "stream-end")
        last.write.parquet(end)
        rows = rows.union(spark.readStream.schema(schema).parquet(end))
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        result = operator(rows)
        written = result.schema

        def emit(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        result.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(emit).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if mode == "update" and key:
        versions = spark.read.schema(StructType([*written.fields, StructField("batch", LongType())])).parquet(out)
        rest = [c for c in written.names if c not in key]
        return versions.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*key, *(F.col("_last")[c].alias(c) for c in rest))
    return spark.read.schema(written).parquet(f"{out}/batch=*")


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums of each event type in windows of event time; late rows beyond the watermark are dropped on a stream."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, key: str, gap: str, late: str | None = None) -> DataFrame:
    """A session ends when nothing happens for the gap."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def once(requests: DataFrame, key: list[str], late: str | None = None) -> DataFrame:
    """Each request key once; on a stream repeats are known for the watermark's time."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if late else requests.dropDuplicates(key)


def conflicts(requests: DataFrame, key: list[str], fingerprint: str) -> DataFrame:
    """Keys that came with more than one fingerprint."""
    return requests.groupBy(*key).agg(F.countDistinct(fingerprint).alias("prints")).where("prints > 1")


def finalize(utterance_ms: Column, silence_ms: Column, p: Column, most_ms: int = 15000, least_silence: int = 400, most_silence: int = 1500, sure: float = 0.6) -> Column:
    """End of an utterance: too long, or silent enough and either likely over or silent for long; without p only silence counts."""
    return (utterance_ms >= most_ms) | ((silence_ms >= least_silence) & (F.coalesce(p >= sure, F.lit(True)) | (silence_ms >= most_silence)))


def committed(hypotheses: DataFrame, agree: int = 2) -> DataFrame:
    """session_id, seq, committed, pending: words on which the last hypotheses of a session agree are committed and never taken back.

    The committed length is the running maximum of the common prefix of the last `agree` hypotheses.
    """
    w = W.partitionBy("session_id").orderBy("seq")
    h = hypotheses.withColumn("w", F.split(F.trim("hypothesis"), r"\s+"))
    common = F.size("w")
    for k in range(1, agree):
        before = F.lag("w", k).over(w)
        same = F.zip_with("w", before, lambda a, b: a.eqNullSafe(b))
        length = F.coalesce(F.array_position(same, False) - 1, F.lit(0))
        length = F.when(F.array_contains(same, False), length).otherwise(F.size(same))
        common = F.least(common, F.when(before.isNull(), 0).otherwise(length))
    h = h.withColumn("_common", common)
    h = h.withColumn("committed", F.max("_common").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return h.select("session_id", "seq", F.least("committed", F.size("w")).alias("committed"), F.greatest(F.size("w") - F.col("committed"), F.lit(0)).alias("pending"))


def ttl_cache(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """requests with hit: the key was inserted less than the time to live before; a hit doesn't extend it.

    Requests of a key are read in order in one pass of a worker that holds one number for each key.
    """
    ordered = requests.select("turn_id", "key", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    n = ordered.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = ordered.repartition(int(n), "key").sortWithinPartitions("key", "at", "turn_id")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live: dict = {}
        for b in batches:
            out = []
            for k, at in zip(b["key"], b["at"], strict=True):
                if k not in live:
                    live.clear()  # rows are sorted by key
                    live[k] = None
                hit = live[k] is not None and at - live[k] < ttl_seconds
                if not hit:
                    live[k] = at
                out.append(hit)
            yield b[["turn_id", "key"]].assign(hit=out)

    return rows.mapInPandas(run, "turn_id long, key string, hit boolean")


def expired(rows: DataFrame, now: Column, days: int, active: DataFrame, key: str) -> DataFrame:
    """Rows older than so many days whose key isn't active."""
    old = rows.where(F.col("ts") < now - F.expr(f"interval {days} days"))
    return old.join(active.select(key).distinct(), key, "left_anti")


def freshness(stages: DataFrame, inputs: DataFrame) -> DataFrame:
    """doc_id, stage, fresh: a stage is fresh if it ended well on the present input."""
    return inputs.join(stages, "doc_id", "left").select("doc_id", "stage", F.coalesce((F.col("input_key") == F.col("seen_key")) & F.col("ok"), F.lit(False)).alias("fresh"))


def admitted(jobs: DataFrame, capacity: int) -> DataFrame:
    """jobs with waiting (jobs submitted before and not yet ended) and admitted (fewer than capacity), within each queue."""
    marks = jobs.select("queue", "job_id", F.col("submitted").alias("at"), F.lit(1).alias("d")).unionByName(jobs.select("queue", "job_id", F.col("ended").alias("at"), F.lit(-1).alias("d")))
    w = W.partitionBy("queue").orderBy("at", "d", "job_id").rowsBetween(W.unboundedPreceding, -1)
    return marks.withColumn("waiting", F.coalesce(F.sum("d").over(w), F.lit(0))).where("d = 1").select("queue", "job_id", "waiting", (F.col("waiting") < capacity).alias("admitted"))


def _events(spark, sf_dir):
    return timed(view(spark, sf_dir, "events"))


def str01_tumbling(spark, sf_dir):
    t = tumbling(_events(spark, sf_dir), "1 hour")
    return t.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def str02_sessions(spark, sf_dir):
    s = sessions(_events(spark, sf_dir), "user_id", "2 hours")
    return s.select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


def str02_sessions_streamed(spark, sf_dir):
    """The same sessions, through the stream's state: each session is written when a row past its end has come, the last ones when the stream ends."""
    s = replay(spark, f"{sf_dir}/events.parquet", lambda e: sessions(timed(e), "user_id", "2 hours", late="1 day"), time="ts")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


def str01_tumbling_streamed(spark, sf_dir):
    t = replay(spark, f"{sf_dir}/events.parquet", lambda e: tumbling(timed(e), "1 day", late="1 hour"), "update", key=["window", "event_type"])
    return t.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def str03_finalize(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    end = finalize(F.col("value") * 100, F.col("event_id") * 7 % 2000, F.when(F.col("event_type") != "error", F.col("event_id") % 10 / 10))
    return e.groupBy("event_type", end.alias("final")).agg(F.count("*").alias("n"))


def str04_prefix_commit(spark, sf_dir):
    """Turns of a conversation as hypotheses that grow: the first words of its system or first message."""
    m = view(spark, sf_dir, "messages")
    base = m.where("turn = 0").select("conv_id", F.col("text").alias("base"))
    words_ = F.split("base", r"\s+")
    n = 3 * (F.col("turn") + 1)
    said = F.concat(F.slice(words_, 1, n.cast("int")), F.when(F.col("turn") % 2 == 1, F.array(F.lit("uh"))).otherwise(F.array().cast("array<string>")))
    h = m.join(base, "conv_id").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.array_join(said, " ").alias("hypothesis"))
    return committed(h)


def str06_utterance_ids(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return view(spark, sf_dir, "events").where("event_type <> 'error'").select("user_id", "event_id", F.row_number().over(w).alias("utterance_id"))


def str07_admission(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    at = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")))
    jobs = e.select(F.col("user_id").alias("queue"), F.col("event_id").alias("job_id"), at.alias("submitted"), (at + F.ceil(F.col("value") * 600)).alias("ended"))
    return admitted(jobs, 3).groupBy("queue", "admitted").agg(F.count("*").alias("n"), F.max("waiting").alias("most"))


def str08_deadlines(spark, sf_dir):
    late = F.col("seconds") > 120
    return view(spark, sf_dir, "turns").groupBy("status").agg(F.count_if(late).alias("late"), F.count_if(~late).alias("delivered"))


def str05_throttle(spark, sf_dir):
    """Partial results of a session go out when the last one is six hours old or more; those in between wait for the next."""
    t = view(spark, sf_dir, "turns").where("seconds >= 3").select("turn_id", "ts", F.col("session_id").cast("string").alias("key"))
    return ttl_cache(t, 21600).groupBy(F.col("key").cast("long").alias("session_id")).agg(F.count_if(~F.col("hit")).alias("sent"), F.count("*").alias("n"))


def str09_ttl_cache(spark, sf_dir):
    t = view(spark, sf_dir, "turns").select("turn_id", "ts", F.concat_ws("|", "session_id", "status").alias("key"))
    return ttl_cache(t, 86400).groupBy("key").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))


def str10_conflicts(spark, sf_dir):
    r = view(spark, sf_dir, "turns").select("session_id", "model_calls", F.col("status").alias("print"))
    return conflicts(r, ["session_id", "model_calls"], "print")


def str10_once_streamed(spark, sf_dir):
    """Keys of requests, each once, by the stream's state."""
    keys = replay(spark, f"{sf_dir}/events.parquet", lambda e: once(timed(e).select("ts", "user_id", "event_type"), ["user_id", "event_type"], late="3650 days"))
    return keys.select("user_id", "event_type")


def str11_retention(spark, sf_dir):
    t = view(spark, sf_dir, "turns")
    gone = expired(t, F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), 10, t.where("status = 'signup' and seconds > 150"), "session_id")
    return gone.groupBy("session_id").agg(F.count("*").alias("n"))


def str12_freshness(spark, sf_dir):
    d = view(spark, sf_dir, "documents")
    stages = view(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("ok")).join(d, "doc_id").select("doc_id", F.lit("extract").alias("stage"), "ok", F.sha1(F.when(F.col("lang") == "en", F.col("text")).otherwise("?")).alias("seen_key"))
    return freshness(stages, d.select("doc_id", F.sha1("text").alias("input_key"))).groupBy("fresh").agg(F.count("*").alias("n"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("str0", "str1"))}

_CACHE = """with recursive q as (select turn_id, session_id || '|' || status as key, cast(floor(epoch(ts)) as bigint) as ts0, row_number() over (partition by session_id, status order by floor(epoch(ts)), turn_id) as r from turns),
 c(key, r, live, hit) as (select key, r, ts0 as live, false from q t where r = 1 union all select t.key, t.r, case when t.ts0 - c.live < 86400 then c.live else t.ts0 end, t.ts0 - c.live < 86400 from c join q t on t.key = c.key and t.r = c.r + 1)
 select key, count(*) filter (where hit) as hits, count(*) as n from c group by all"""

SQL = {
    "str04_prefix_commit": "with h as (select conv_id as session_id, turn as seq, string_split_regex(trim(array_to_string(list_concat(string_split_regex(base, '\\s+')[1:3 * (turn + 1)], case when turn % 2 = 1 then ['uh'] else [] end), ' ')), '\\s+') as w from conversations join (select conv_id, text as base from conversations where turn = 0) using (conv_id)), d as (select session_id, seq, len(w) as n, case when b is null then 0 else least(len(w), coalesce(list_position(list_transform(range(1, greatest(len(w), len(b)) + 1), lambda i: w[i] is not distinct from b[i]), false) - 1, greatest(len(w), len(b)))) end as common from (select *, lag(w) over (partition by session_id order by seq) as b from h)) select session_id, seq, least(k, n) as committed, greatest(n - k, 0) as pending from (select *, max(common) over (partition by session_id order by seq) as k from d)",
    "str02_sessions_streamed": "select user_id, count(*) as sessions, cast(sum(n) as bigint) as events from (select user_id, count(*) as n from (select *, sum(case when ts - b < interval '2 hours' then 0 else 1 end) over (partition by user_id order by ts, event_id) as s from (select *, lag(ts) over (partition by user_id order by ts, event_id) as b from events)) group by user_id, s) group by user_id",
    "str01_tumbling": "select cast(epoch(time_bucket(interval '1 hour', ts)) as bigint) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by all",
    "str01_tumbling_streamed": "select cast(epoch(time_bucket(interval '1 day', ts)) as bigint) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by all",
    "str02_sessions": "select user_id, min(epoch_us(ts)) as first, max(epoch_us(ts)) as last, count(*) as n from (select *, sum(case when ts - b < interval '2 hours' then 0 else 1 end) over (partition by user_id order by ts, event_id) as s from (select *, lag(ts) over (partition by user_id order by ts, event_id) as b from events)) group by user_id, s",
    "str03_finalize": "select event_type, value * 100 >= 15000 or ((event_id * 7 % 2000) >= 400 and (event_type = 'error' or event_id % 10 / 10 >= 0.6 or (event_id * 7 % 2000) >= 1500)) as final, count(*) as n from events group by all",
    "str06_utterance_ids": "select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as utterance_id from events where event_type <> 'error'",
    "str07_admission": "with j as (select user_id as queue, event_id as job_id, cast(floor(epoch(ts)) as bigint) as s, cast(floor(epoch(ts)) as bigint) + cast(ceil(value * 600) as bigint) as e from events), m as (select queue, job_id, s as t, 1 as d from j union all select queue, job_id, e, -1 from j), w as (select *, coalesce(sum(d) over (partition by queue order by t, d, job_id rows between unbounded preceding and 1 preceding), 0) as waiting from m) select queue, waiting < 3 as admitted, count(*) as n, cast(max(waiting) as bigint) as most from w where d = 1 group by all",
    "str08_deadlines": oracle("select status, count(*) filter (where seconds > 120) as late, count(*) filter (where seconds <= 120) as delivered from turns group by all", "turns"),
    "str09_ttl_cache": oracle("select 1", "turns").replace("select 1", "").rstrip() + ", " + _CACHE.removeprefix("with recursive "),
    "str10_conflicts": oracle("select session_id, model_calls, count(distinct status) as prints from turns group by all having count(distinct status) > 1", "turns"),
    "str10_once_streamed": "select distinct user_id, event_type from events",
    "str11_retention": oracle("select session_id, count(*) as n from turns where ts < timestamp '2024-01-15' and session_id not in (select session_id from turns where status = 'signup' and seconds > 150) group by all", "turns"),
    "str12_freshness": "select fresh, count(*) as n from (select d.doc_id, coalesce(l.ok and d.lang = 'en', false) as fresh from documents d left join (select doc_id, max(quality) = 1 as ok from labels group by all) l using (doc_id)) group by all",
}
_SENT = """with recursive q as (select user_id as k, cast(floor(epoch(ts)) as bigint) as s0, row_number() over (partition by user_id order by floor(epoch(ts)), event_id) as r from events where value >= 3),
 c(k, r, live, hit) as (select k, r, s0, false from q t where r = 1 union all select t.k, t.r, case when t.s0 - c.live < 21600 then c.live else t.s0 end, t.s0 - c.live < 21600 from c join q t on t.k = c.k and t.r = c.r + 1)
 select k as session_id, count(*) filter (where not hit) as sent, count(*) as n from c group by all"""
SQL["str05_throttle"] = _SENT
SQL["str09_ttl_cache"] = SQL["str09_ttl_cache"].replace("with ", "with recursive ", 1)
