"""Job lifecycle over an event stream: the same transformation for batch and stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators import folds

#: How long a job is kept after its creation, and what its events make of it.
TTL_MINUTES = 30
STATES = {"error": "error", "purchase": "done"}


def lifecycle(events: DataFrame) -> DataFrame:
    """Per job (user): events so far, errors, and the state after the latest event."""
    state = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done").otherwise("converting")
    return events.groupBy("user_id").agg(
        F.count("*").alias("n_events"), F.sum((F.col("event_type") == "error").cast("long")).alias("n_errors"),
        F.max_by(state, F.struct("ts", "event_id")).alias("state"),
    )


def expired(events: DataFrame, ttl_minutes: int = 30) -> DataFrame:
    """Jobs whose last event is more than ``ttl_minutes`` before the newest event of all."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    newest = events.agg(F.max("ts").alias("newest"))
    idle = (F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 60_000_000
    return last.crossJoin(F.broadcast(newest)).filter(idle > ttl_minutes).select("user_id")  # newest is one row


def lifecycle_stream(spark: SparkSession, path: str, shared: str) -> DataFrame:
    """Runs ``lifecycle`` as a stream over the files at ``path`` until all are read, and returns its last result."""
    schema = spark.read.parquet(path).schema
    out = f"{shared}/jobs-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(path + "*")  # a pattern, as a table can be one file or a folder

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result")

    query = lifecycle(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/result")


JOB = "user_id long, created timestamp, n_events long, n_errors long, state string, expires timestamp"


def _after(job: list | None, ts: int, kind: str, ttl: int) -> tuple[list, list | None]:
    """(the job after an event at ``ts``, the job that had expired before it). A job is [created, events, errors, state]."""
    gone = None
    if job is not None and ts - job[0] > ttl:
        job, gone = None, job
    if job is None:
        job = [ts, 0, 0, ""]
    return [job[0], job[1] + 1, job[2] + (kind == "error"), STATES.get(kind, "converting")], gone


def jobs(events: DataFrame, ttl_minutes: int = TTL_MINUTES) -> DataFrame:
    """Every job of a table of events (user_id, ts, event_id, event_type): user_id, created, n_events, n_errors, state, expires.

    The first event of a user creates a job, which is dropped once it is older than ``ttl_minutes``; the next event makes another one. Events of a user are
    read in the order of time and id. Events without a time are left out.
    """
    ttl = ttl_minutes * 60_000_000
    rows = events.filter("ts is not null").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event_type", F.lead("event_id").over(_by_user()).isNull().alias("last"))

    def step(state: list, user, us, event, kind, last) -> list[tuple]:
        state[0], gone = _after(state[0], us, kind, ttl)
        return [(user, *job) for job in (gone, state[0] if last else None) if job]

    done = folds.fold_sorted(rows, ["user_id"], ["us", "event_id"], lambda: [None], step, "user_id long, created long, n_events long, n_errors long, state string")
    at = F.timestamp_micros("created")
    return done.select("user_id", at.alias("created"), "n_events", "n_errors", "state", F.timestamp_micros(F.col("created") + ttl).alias("expires"))


def _by_user():
    from pyspark.sql.window import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


_OUT = "user string, created long, n_events long, n_errors long, state string"
_STATE = "jobs array<struct<user:string,created:long,n_events:long,n_errors:long,state:string>>, pending array<struct<us:long,event_id:long,user:string,event_type:string>>"

#: Fixed value: users of a stream are dealt into as many buckets; those of a bucket share a state, so that it is read and written once a batch and not once a user.
BUCKETS = 256


def job_stream(events: DataFrame, ttl_minutes: int = TTL_MINUTES, late_minutes: int = 10, buckets: int = BUCKETS) -> DataFrame:
    """``jobs`` as a stream: a row for each job once the watermark says that it has expired.

    The state of a bucket of users holds their open jobs and the events that the watermark has not reached, which may come in any order; what comes more than
    ``late_minutes`` behind the newest event is dropped. A timer on the event time wakes a bucket in which the next event or expiry is due.
    """
    ttl = ttl_minutes * 60_000_000

    def wake(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, pending = state.get if state.exists else ([], [])
        jobs_ = {j[0]: list(j[1:]) for j in opened}
        waiting = [tuple(p) for p in pending]
        mark = max(state.getCurrentWatermarkMs(), 0) * 1000
        for b in batches:
            waiting += [e for e in zip(b["us"].tolist(), b["event_id"].tolist(), b["user"].tolist(), b["event_type"].tolist(), strict=True) if e[0] > mark]
        waiting.sort(key=lambda e: e[:2])
        out: list[tuple] = []
        n = 0
        for us, _, user, kind in waiting:
            if us > mark:
                break
            jobs_[user], gone = _after(jobs_.get(user), us, kind, ttl)
            out += [(user, *gone)] if gone else []
            n += 1
        waiting = waiting[n:]
        for user in [u for u, j in jobs_.items() if mark - j[0] > ttl]:  # what waits is later than the watermark
            out.append((user, *jobs_.pop(user)))
        if jobs_ or waiting:
            state.update(([(u, *j) for u, j in jobs_.items()], waiting))
            due = min([j[0] + ttl for j in jobs_.values()] + [e[0] - 1 for e in waiting[:1]])
            state.setTimeoutTimestamp(max(due // 1000, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(dict(zip(("user", "created", "n_events", "n_errors", "state"), zip(*out, strict=True), strict=True)))

    at = F.col("ts").cast("timestamp")
    rows = events.filter("ts is not null").select("user_id", at.alias("ts"), F.unix_micros(at).alias("us"), "event_id", "event_type").withWatermark("ts", f"{late_minutes} minutes")
    # As text, users may be missing; a column of numbers with gaps would reach Python as doubles.
    dealt = rows.select(F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"), F.col("user_id").cast("string").alias("user"), "ts", "us", "event_id", "event_type")
    found = dealt.groupBy("bucket").applyInPandasWithState(wake, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    created = F.col("created")
    return found.select(F.col("user").cast("long").alias("user_id"), F.timestamp_micros(created).alias("created"), "n_events", "n_errors", "state", F.timestamp_micros(created + ttl).alias("expires"))


def finished_jobs(spark: SparkSession, path: str, shared: str, ttl_minutes: int = TTL_MINUTES, late_minutes: int = 10, files_each: int | None = None) -> DataFrame:
    """Runs ``job_stream`` over the files at ``path`` until all are read and returns the jobs that have expired by then; each batch adds its own rows."""
    schema = spark.read.parquet(path).schema
    out = f"{shared}/finished-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema)
    if files_each:
        source = source.option("maxFilesPerTrigger", files_each)
    # About five thousand rows a bucket, however large the table is.
    buckets = max(BUCKETS, spark.read.parquet(path).count() // 5_000)
    stream = job_stream(source.parquet(path + "*"), ttl_minutes, late_minutes, buckets)
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").format("parquet").option("path", f"{out}/result").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(JOB).parquet(f"{out}/result")


def answers(found: DataFrame, requests: DataFrame) -> DataFrame:
    """request, code, said: what a request (request, id, action, output) gets, given the jobs (id, status, output).

    Actions: status, metadata and delete need a job; preview and download need one that is done; convert needs one that is not converting and an output that
    is html or text (html without any).
    """
    rows = requests.join(found.select(F.col("id").alias("_id"), F.col("status").alias("_status")), F.col("id") == F.col("_id"), "left")
    action, wanted = F.col("action"), F.coalesce(F.when(F.col("output") != "", F.col("output")), F.lit("html"))
    code = (
        F.when(F.col("_id").isNull(), 404).when((action == "convert") & (F.col("_status") == "converting"), 409).when((action == "convert") & ~wanted.isin("html", "text"), 400)
        .when(action.isin("preview", "download") & (F.col("_status") != "done"), 412).otherwise(200)
    )
    said = F.when(code == 404, "not found").when(code == 409, "already in progress").when(code == 400, "invalid output").when(code == 412, "not complete").when(action == "convert", "converting").when(action == "delete", "deleted").otherwise(F.col("_status"))
    return rows.select("request", code.alias("code"), said.alias("said"))
