"""Job events: acceptance, projection on files, a stateful stream, correlation and control."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafmill.operators.audit import drop_stale

EVENT = "job_id string, seq bigint, state string, completed int, total int, phase string, message string, outputs array<string>, error_code string"
#: Per cent of a running file by phase, fixed values; 8 for others.
PHASES = {"reading": 12, "extracting": 58, "writing": 86}
JOB_TIMEOUT_MS, REQUEST_TIMEOUT = 15 * 60 * 1000, "30 seconds"


def has_finished(state: Column, completed: Column, total: Column) -> Column:
    """Whether an event ends its job."""
    return state.isin("cancelled", "timed_out") | (state.isin("succeeded", "failed") & (completed >= total))


def file_events(kind_outcomes: DataFrame, job: str = "job_id", position: str = "position") -> DataFrame:
    """The events that a job's files give, in order, with seq: queued first, then running and the outcome of each file.

    ``kind_outcomes`` has job_id, position (from 0), state (succeeded, failed, cancelled, timed_out). A failed file
    does not stop the next; a cancelled or timed-out one ends the job.
    """
    stop = kind_outcomes.groupBy(job).agg(F.min(F.when(F.col("state").isin("cancelled", "timed_out"), F.col(position))).alias("_stop"), F.count(F.lit(1)).cast("int").alias("total"))
    rows = kind_outcomes.join(stop, job).where(F.col("_stop").isNull() | (F.col(position) <= F.col("_stop")))
    ends = F.col("state").isin("cancelled", "timed_out")
    p = F.col(position).cast("int")
    event = lambda at, state, completed, phase: F.struct(at.cast("bigint").alias("seq"), state.alias("state"), completed.alias("completed"), phase.alias("phase"))
    queued = F.when(p == 0, F.array(event(F.lit(1), F.lit("queued"), F.lit(0), F.lit("queued")))).otherwise(F.array())
    own = F.array(event(2 * p + 2, F.lit("running"), p, F.lit("reading")), event(2 * p + 3, F.col("state"), F.when(ends, p).otherwise(p + 1), F.when(ends, F.col("state")).otherwise(F.lit("done"))))
    return rows.select(job, "total", F.inline(F.concat(queued.cast(own_type()), own.cast(own_type())))).select(job, "seq", "state", "completed", "total", "phase")


def own_type() -> str:
    return "array<struct<seq:bigint,state:string,completed:int,phase:string>>"


def batch_events(batches: DataFrame) -> DataFrame:
    """The two events of a merged job (job_id, total, state): queued, and one outcome for the whole batch."""
    done = F.when(F.col("state") == "succeeded", F.col("total")).otherwise(F.lit(0))
    rows = F.array(F.struct(F.lit(1).alias("seq"), F.lit("queued").alias("state"), F.lit(0).alias("completed")), F.struct(F.lit(2).alias("seq"), F.col("state"), done.alias("completed")))
    return batches.select("job_id", "total", F.inline(rows.cast("array<struct<seq:bigint,state:string,completed:int>>"))).withColumn("phase", F.lit("batch"))


def projected_files(jobs: DataFrame, events: DataFrame, arrival: list[str]) -> DataFrame:
    """(job_id, file_id, state, progress): the files of jobs after all accepted events.

    ``jobs`` has job_id, submitted_ids (array), merged (boolean). An event is accepted if its seq exceeds all that arrived
    before it, up to the one that ends the job. Each event tells something about one
    position, all files, or those from a position on; of each file the last word counts.
    """
    kept = drop_stale(events, "job_id", "seq", arrival)
    ended = kept.groupBy("job_id").agg(F.min(F.when(has_finished(F.col("state"), F.col("completed"), F.col("total")), F.col("seq"))).alias("_end"))
    kept = kept.join(ended, "job_id").where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end"))).drop("_end")
    files = jobs.select("job_id", "merged", F.posexplode("submitted_ids").alias("pos", "file_id"))
    s, done, pos = F.col("state"), F.col("completed"), F.col("pos")
    share = F.when(F.col("total") > 0, F.least(F.lit(95), F.greatest(F.lit(8), F.floor(done / F.col("total") * 90 + 0.5).cast("int")))).otherwise(8)
    word = lambda state, progress: F.struct(state.alias("state"), progress.cast("int").alias("progress"))
    alone = (
        F.when(s.isin("succeeded", "failed") & (pos == done - 1), word(s, F.when(s == "succeeded", 100).otherwise(0)))
        .when(s.isin("cancelled", "timed_out") & (pos >= done), word(s, F.lit(0)))
        .when((s == "running") & (pos == done), word(s, F.when(F.col("phase") == "reading", 12).when(F.col("phase") == "extracting", 58).when(F.col("phase") == "writing", 86).otherwise(8)))
    )
    together = F.when(s == "running", word(s, share)).otherwise(word(s, F.when(s == "succeeded", 100).otherwise(0)))
    told = F.when(s == "queued", word(s, F.lit(0))).when(F.col("merged"), together).otherwise(alone)
    last = files.join(kept, "job_id").select("job_id", "file_id", "seq", told.alias("told")).where("told is not null").groupBy("job_id", "file_id").agg(F.max_by("told", "seq").alias("told"))
    out = files.join(last, ["job_id", "file_id"], "left")
    return out.select("job_id", "file_id", F.coalesce("told.state", F.lit("running")).alias("state"), F.coalesce("told.progress", F.lit(8)).alias("progress"))


def engine_stopped(files: DataFrame) -> DataFrame:
    """``files`` after the engine stopped: what was queued or running has failed."""
    open_ = F.col("state").isin("queued", "running")
    return files.withColumns({"progress": F.when(open_, 0).otherwise(F.col("progress")), "state": F.when(open_, "failed").otherwise(F.col("state"))})


# ---- stream --------------------------------------------------------------------


class Job:
    """The state of one job: last seq, its files, and events that came before it was submitted."""

    def __init__(self, last: int = 0, ids: list[str] | None = None, merged: bool = False, finished: bool = False, early: list[tuple] | None = None):
        self.last, self.ids, self.merged, self.finished, self.early = last, ids, merged, finished, early or []

    def submit(self, ids: list[str], merged: bool) -> Iterator[tuple[str, str, int]]:
        """Begin; the events that came early follow in their order."""
        if self.ids is not None:
            return
        self.ids, self.merged = list(ids), merged
        yield from ((i, "running", 8) for i in self.ids)
        early, self.early = self.early, []
        for event in early:
            yield from self.event(*event)

    def event(self, seq: int, state: str, completed: int, total: int, phase: str | None) -> Iterator[tuple[str, str, int]]:
        """(file, state, progress) that an event changes; nothing for a stale one or after the end."""
        if self.finished:
            return
        if self.ids is None:
            self.early.append((seq, state, completed, total, phase))
            return
        if seq <= self.last:
            return
        self.last = seq
        if state == "queued":
            yield from ((i, state, 0) for i in self.ids)
        elif self.merged:
            share = min(95, max(8, int(completed / total * 90 + 0.5))) if total > 0 else 8
            yield from ((i, state, {"succeeded": 100, "running": share}.get(state, 0)) for i in self.ids)
        elif state in ("succeeded", "failed"):
            yield from ((i, state, 100 if state == "succeeded" else 0) for i in self.ids[completed - 1 : completed] if completed)
        elif state in ("cancelled", "timed_out"):
            yield from ((i, state, 0) for i in self.ids[completed:])
        elif state == "running":
            yield from ((i, state, PHASES.get(phase, 8)) for i in self.ids[completed : completed + 1])
        self.finished = state in ("cancelled", "timed_out") or (state in ("succeeded", "failed") and completed >= total)

    def stop(self, state: str) -> Iterator[tuple[str, str, int]]:
        """End from outside: a timeout, or the engine's end."""
        if not self.finished and self.ids is not None:
            self.finished = True
            yield from ((i, state, 0) for i in self.ids)


_STATE = "last bigint, ids array<string>, merged boolean, finished boolean, early array<struct<seq:bigint,state:string,completed:int,total:int,phase:string>>, begun bigint"
_OUT = "job_id string, seq bigint, file_id string, state string, progress int"


def job_stream(records: DataFrame) -> DataFrame:
    """File updates (job_id, seq, file_id, state, progress) of a stream of records, by job.

    ``records`` has job_id, arrival (orders a job's records of one batch), seq, state, completed, total, phase,
    submitted_ids and merged: a row with submitted_ids submits its job, any other is an event. State is keyed
    by job and goes with the job's last event, or 15 minutes of processing time after its first record, when open files have timed out. Order is
    by sequence number, so no watermark is needed.
    """

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job, begun = Job(), state.getCurrentProcessingTimeMs()
        if state.exists:
            last, ids, merged, finished, early, begun = state.get
            job = Job(last, list(ids) if ids is not None else None, merged, finished, [tuple(e) for e in early or ()])
        out = []
        if state.hasTimedOut:
            out = [(key[0], job.last, *x) for x in job.stop("timed_out")]
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("arrival", kind="stable")
            for r in rows.itertuples(index=False):
                found = job.submit(list(r.submitted_ids), bool(r.merged)) if r.submitted_ids is not None else job.event(int(r.seq), r.state, int(r.completed), int(r.total), r.phase)
                out += [(key[0], job.last, *x) for x in found]
            if job.finished:
                state.remove()
            else:
                state.update((job.last, job.ids, job.merged, job.finished, job.early, begun))
                state.setTimeoutDuration(max(1, begun + JOB_TIMEOUT_MS - state.getCurrentProcessingTimeMs()))
        yield pd.DataFrame(out, columns=["job_id", "seq", "file_id", "state", "progress"])

    columns = ["job_id", "arrival", "seq", "state", "completed", "total", "phase", "submitted_ids", "merged"]
    return records.select(*columns).groupBy("job_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def correlated(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests (id, sent) with their response (id, received) of the next 30 seconds; without one, a null response."""
    a = requests.withWatermark("sent", REQUEST_TIMEOUT)
    b = responses.withColumnRenamed("id", "_id").withWatermark("received", REQUEST_TIMEOUT)
    within = (F.col("id") == F.col("_id")) & (F.col("received") >= F.col("sent")) & (F.col("received") <= F.col("sent") + F.expr(f"INTERVAL {REQUEST_TIMEOUT}"))
    return a.join(b, within, "left_outer").drop("_id")


# ---- control -------------------------------------------------------------------


def run_tagged(spark: SparkSession, job_id: str, lane: str, action):
    """``action()`` under the job's tag and its lane's scheduler pool."""
    sc = spark.sparkContext
    sc.setLocalProperty("spark.scheduler.pool", lane)
    sc.addJobTag(job_id)
    try:
        return action()
    finally:
        sc.removeJobTag(job_id)
        sc.setLocalProperty("spark.scheduler.pool", None)


def cancel(spark: SparkSession, job_id: str | None = None) -> None:
    """Cancel a job's running work, or (without a job, as at a disconnect) all of it."""
    if job_id is None:
        spark.sparkContext.cancelAllJobs()
    else:
        spark.sparkContext.cancelJobsWithTag(job_id)
