"""Utterances of sessions: a keyed state machine over frames of speech and silence, in event time.

A session is silent until a frame of speech starts an utterance. While it speaks, the first frame of silence starts a
pause, and speech ends it. The utterance is final when its rules say so (finalize() in sessions.py): it has its
most length, or its pause is long enough, less long where the pause was judged to end a turn (a judgement that comes later
ends it when it comes). All of these are points in event time, so that a session needs no further frame to end: an event-time timer is set for the next of them.

The processor keeps frames until the watermark has passed them and then takes them in the order of their
times. What a session gives so doesn't depend on how its frames are cut into micro-batches, and frames may come out of order
by the watermark's delay. State: one row, and the frames of the delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkwell.plans.views import view
from sparkwell.streaming.sessions import replay

HOUR = 3_600_000


@dataclass(frozen=True)
class Rules:
    """Milliseconds, and shares from 0 to 1. A pause of least_silence ends an utterance if it was judged a turn's end with at least sure, or wasn't judged; one of most_silence ends it anyway.

    Utterances that spoke for less than least_speech, or whose frames are noise to a share of noise or more on average, are dropped.
    """

    most: int = 15_000
    least_silence: int = 400
    most_silence: int = 1_500
    sure: float = 0.6
    least_speech: int = 300
    noise: float = 0.6


@dataclass
class Machine:
    """The state of a session; times in microseconds. step() and pass_() give finished utterances as (id, started, ended, frames, reason)."""

    rules: Rules
    started: int | None = None
    paused: int | None = None
    judged: float | None = None
    frames: int = 0
    noise: float = 0.0
    known: int = 0  # frames with a noise
    last: int = 0  # time of the last frame
    utterances: int = 0  # so far

    def deadline(self) -> int | None:
        """When the utterance is final if nothing else happens: not before what is known of it."""
        if self.started is None:
            return None
        end = self.started + self.rules.most * 1000
        if self.paused is not None:
            wait = self.rules.least_silence if self.judged is None or self.judged >= self.rules.sure else max(self.rules.least_silence, self.rules.most_silence)
            end = min(end, self.paused + wait * 1000)
        return max(end, self.last)

    def pass_(self, now: int) -> Iterator[tuple]:
        """Time goes on to now."""
        end = self.deadline()
        if end is None or now < end:
            return
        spoken = (end if self.paused is None else self.paused) - self.started
        noisy = self.known and self.noise / self.known >= self.rules.noise
        if spoken >= self.rules.least_speech * 1000 and not noisy:
            self.utterances += 1
            yield self.utterances, self.started, end, self.frames, "length" if end >= self.started + self.rules.most * 1000 else "silence"
        self.started = None

    def step(self, at: int, speech: bool | None, judged: float | None, noise: float | None) -> Iterator[tuple]:
        """A frame; speech None says nothing new."""
        yield from self.pass_(at)
        if self.started is None:
            if not speech:
                return
            self.started, self.frames, self.noise, self.known = at, 0, 0.0, 0
        if speech:
            self.paused = self.judged = None
        elif speech is not None:
            self.paused = at if self.paused is None else self.paused
            self.judged = self.judged if judged is None else judged
        self.frames, self.last = self.frames + 1, at
        if noise is not None:
            self.noise += noise
            self.known += 1


_STATE = ["started", "paused", "judged", "frames", "noise", "known", "last", "utterances"]


class UtteranceProcessor(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "started long, paused long, judged double, frames long, noise double, known long, last long, utterances long, timer long")
        self.waiting = handle.getListState("frames", "us long, seq long, speech boolean, judged double, noise double")

    def _wake(self, machine: Machine, timer: int | None, now: int | None, at: int | None) -> None:
        """Keep the machine, with a timer for at if none comes before; now: the timer that is due."""
        timer = None if now is not None and timer is not None and timer <= now else timer
        if at is not None and (timer is None or at < timer):
            self.handle.registerTimer(at)
            timer = at
        self.state.update((*(getattr(machine, c) for c in _STATE), timer))

    def _load(self) -> tuple[Machine, int | None]:
        got = self.state.get() if self.state.exists() else None
        return (Machine(self.rules, *got[:-1]), got[-1]) if got else (Machine(self.rules), None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.us, r.seq, r.speech, r.judged, r.noise) for r in rows]
        if new:
            self.waiting.appendList(new)
            machine, timer = self._load()
            self._wake(machine, timer, None, min(r[0] for r in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        machine, timer = self._load()
        due, later = [], []
        for r in self.waiting.get() if self.waiting.exists() else ():
            (due if r[0] <= now * 1000 else later).append(tuple(r))
        out = [u for us, _, *frame in sorted(due, key=lambda r: (r[0], r[1])) for u in machine.step(us, *frame)]
        out += machine.pass_(now * 1000)
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        ahead = [min(r[0] for r in later)] if later else []
        ahead += [d for d in (machine.deadline(),) if d is not None]
        self._wake(machine, timer, now, min(ahead) // 1000 + 1 if ahead else None)
        return iter([Row(session=key[0], utterance_id=i, started=a, ended=b, frames=n, reason=why) for i, a, b, n, why in out])

    def close(self) -> None:
        pass


_OUT = "session {}, utterance_id long, started long, ended long, frames long, reason string"
#: transformWithState keeps its state in RocksDB.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def utterances(frames: DataFrame, rules: Rules = Rules(), late: str = "10 seconds") -> DataFrame:
    """session, utterance_id (from 1 in each session), started, ended (microseconds), frames and reason (silence or length) of a stream of frames.

    frames: session, at (timestamp), seq (orders frames of one time), speech, judged, noise. A frame without a time is left
    out; frames that come later than the watermark allows are lost, as in all streams; a null session is one of its own.
    """
    kind = dict(frames.dtypes)["session"]
    rows = frames.where("at is not null").select("session", "at", F.unix_micros("at").alias("us"), F.col("seq").cast("long"), "speech", F.col("judged").cast("double"), F.col("noise").cast("double"))
    return rows.withWatermark("at", late).groupBy("session").transformWithState(UtteranceProcessor(rules), _OUT.format(kind), "append", "eventTime")


def frames_of_events(events: DataFrame) -> DataFrame:
    """Users as sessions: clicks, purchases and views are speech, errors are pauses that their value judges, sign-ups pauses without a judgement."""
    speech = F.col("event_type").isin("click", "purchase", "view")
    return events.select(
        F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), speech.alias("speech"),
        F.when(F.col("event_type") == "error", F.least(F.col("value") / 100, F.lit(1.0))).alias("judged"), (F.col("event_id") % 10 / 10).alias("noise"),
    )


#: Rules for events that lie hours apart.
EVENT_RULES = Rules(most=72 * HOUR, least_silence=6 * HOUR, most_silence=24 * HOUR, sure=0.6, least_speech=HOUR, noise=0.6)


def str02_utterances(spark, sf_dir):
    """Utterances of all users, through the stream's state and timers."""
    return replay(spark, f"{sf_dir}/events.parquet", lambda e: utterances(frames_of_events(e), EVENT_RULES, "1 day"), time="ts", conf=STATE)


QUERIES = {"str02_utterances": str02_utterances}

_H = HOUR * 1000
SQL = {
    "str02_utterances": f"""with recursive q as (
 select user_id as k, epoch_us(ts) as t, event_type in ('click', 'purchase', 'view') as speech, case when event_type = 'error' then least(value / 100, 1.0) end as jp, event_id % 10 / 10 as z,
        row_number() over (partition by user_id order by epoch_us(ts), event_id) as r from events where ts is not null
 union all select user_id, 30000000000000000, null, null, null, count(*) + 1 from events where ts is not null group by user_id),
m(k, r, started, paused, jp, n, noise, last, u_start, u_end, u_n, u_spoken, u_noise) as (
 select k, cast(0 as bigint), cast(null as bigint), cast(null as bigint), cast(null as double), cast(0 as bigint), cast(0 as double), cast(0 as bigint), cast(null as bigint), cast(null as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as double) from q where r = 1
 union all
 select k, r, case when s is null and speech then t else s end,
        case when s is null or speech then null else coalesce(paused, t) end,
        case when s is null or speech then null else coalesce(njp, jp) end,
        case when s is null then 1 else n + 1 end, case when s is null then z else noise + z end, t,
        case when closed then started end, case when closed then d end, n, coalesce(paused, d) - started, noise / n
 from (select *, case when closed then null else started end as s from (
  select *, started is not null and t >= d as closed from (
   select m.k, q.r, q.t, q.speech, q.jp as njp, q.z, m.started, m.paused, m.jp, m.n, m.noise,
          greatest(m.last, least(m.started + {72 * _H}, coalesce(m.paused + case when m.jp is null or m.jp >= 0.6 then {6 * _H} else {24 * _H} end, m.started + {72 * _H}))) as d
   from m join q on q.k is not distinct from m.k and q.r = m.r + 1))))
select k as session, row_number() over (partition by k order by u_start) as utterance_id, u_start as started, u_end as ended, u_n as frames,
       case when u_end >= u_start + {72 * _H} then 'length' else 'silence' end as reason
from m where u_start is not null and u_spoken >= {_H} and u_noise < 0.6""",
}
