"""Download jobs as a state machine over a stream of commands, and the commands that start-up and the timer give.

Jobs are dealt over buckets, and Spark keeps the states of a bucket's jobs under its key, so that thousands of jobs cross to
Python at once. A command that the state does not allow is answered with a refusal and changes nothing, so that the log of
answers tells why a job did not start. With ``every`` a finished or paused job is due that long after its last change, by an
event-time timeout, and starts by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

#: For each command the states in which it is taken, and the state that follows. None: no such job yet.
MOVES: dict[str, tuple[tuple[str | None, ...], str]] = {
    "create": ((None,), "pending"),
    "reset": (("running", "failed"), "completed"),
    "start": (("pending", "paused", "completed", "failed"), "running"),
    "sync": (("paused", "completed"), "running"),
    "complete": (("running",), "completed"),
    "fail": (("running",), "failed"),
    "pause": (("running",), "paused"),
}
RANK = {command: i for i, command in enumerate(MOVES)}
#: States from which a job becomes due.
WAITING = ("completed", "paused")
#: Seconds between two runs of a job, and the newest jobs that a pass over a table looks at.
EVERY, NEWEST = 300, 100
LOG = "job_id long, at long, command string, before string, after string, accepted boolean, reason string, error string"
#: State of a bucket: for each of its jobs the status, the time of its last change and when it is due.
STATE = "job array<bigint>, status array<string>, at array<bigint>, due array<bigint>"
BUCKETS = 4096
#: Times of no change yet, and of a job that is not due.
NEVER = (-(2**63), 2**63 - 1)
#: The states, no such job first; by state and command the state that follows, -1 where it is refused, and the refusal. The last
#: command stands for unknown ones.
STATES = np.array([None, *dict.fromkeys(after for _, after in MOVES.values())], object)
NUMBER = {s: i for i, s in enumerate(STATES)}
AFTER = np.array([[NUMBER[after] if s in allowed else -1 for allowed, after in MOVES.values()] + [-1] for s in STATES])
REFUSED = np.array([["there is no such job" if s is None else "the job is there" if c == "create" else f"the job is {s}" for c in MOVES] + ["unknown command"] for s in STATES], object)
MAIL_CREDENTIALS = ("imap", "oauth")
DEFAULT_CONFIG = '{"folders":[{"name":"INBOX"}],"sync_strategy":"inbox-only","fetch_batch_size":50,"max_age_months":12}'


def _bucket(every: int | None):
    """The machine for the jobs of one bucket: their commands are taken in the order of their times, of equal times in the order
    of MOVES, one command of each job at a time for all of them."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames = [f for f in frames if len(f)]
        ids, status, last, due = _loaded(state)
        if frames:
            rows = pd.concat(frames, ignore_index=True)
            known, (ids, job) = ids, np.unique(np.concatenate((ids, rows["job_id"].to_numpy(np.int64))), return_inverse=True)
            old, job = job[: len(known)], job[len(known) :]
            status, last, due = (_placed(own, old, len(ids), none) for own, none in ((status, 0), (last, NEVER[0]), (due, NEVER[1])))
            yield _answers(rows, ids, job, status, last, due, every)
        mark = state.getCurrentWatermarkMs()
        waited = np.flatnonzero(due <= mark)
        if len(waited):  # a job that waited long enough starts
            own = pd.DataFrame({"job_id": ids[waited], "ms": due[waited], "command": "sync", "error": None})
            yield _answers(own, ids, waited, status, last, due, every)
        there = status > 0
        if there.any():
            state.update((ids[there].tolist(), STATES[status[there]].tolist(), last[there].tolist(), due[there].tolist()))
            first = int(due[there].min())
            if first < NEVER[1]:
                state.setTimeoutTimestamp(max(first - 1, mark + 1))

    return run


def _loaded(state: GroupState) -> tuple[np.ndarray, ...]:
    ids, status, last, due = state.get if state.exists else ([], [], [], [])
    return np.array(ids, np.int64), np.array([NUMBER[s] for s in status], np.int64), np.array(last, np.int64), np.array(due, np.int64)


def _placed(own: np.ndarray, at: np.ndarray, size: int, none: int) -> np.ndarray:
    out = np.full(size, none, np.int64)
    out[at] = own
    return out


def _answers(rows: pd.DataFrame, ids: np.ndarray, job: np.ndarray, status: np.ndarray, last: np.ndarray, due: np.ndarray, every: int | None) -> pd.DataFrame:
    """Answers to ``rows`` (ms, command, error) of the jobs with the places ``job`` in ``ids``. status, time of the last change
    and when a job is due are by place, and change if a command is taken."""
    ms = rows["ms"].to_numpy(np.int64)
    which, names = pd.factorize(rows["command"].to_numpy(object), sort=True, use_na_sentinel=True)
    names, which = np.array([*names, ""], object), which + (len(names) + 1) * (which < 0)
    errors = rows["error"].to_numpy(object)
    rank = np.array([RANK.get(n, len(RANK)) for n in names])[which]
    order = np.lexsort((pd.factorize(errors, sort=True)[0], which, rank, ms, job))
    job, ms, which, rank, errors = (x[order] for x in (job, ms, which, rank, errors))
    first = np.flatnonzero(np.concatenate(([True], job[1:] != job[:-1])))
    nth = np.arange(len(job)) - np.repeat(first, np.diff(np.append(first, len(job))))
    by_turn = np.argsort(nth, kind="stable")
    before, after, older = (np.empty(len(job), np.int64) for _ in range(3))
    for turn in np.split(by_turn, np.cumsum(np.bincount(nth))[:-1]):
        own = job[turn]
        before[turn] = status[own]
        older[turn] = ms[turn] < last[own]
        then = np.where(older[turn], -1, AFTER[status[own], rank[turn]])
        taken = then >= 0
        changed = own[taken]
        status[changed], last[changed] = then[taken], ms[turn][taken]
        due[changed] = np.where(np.isin(status[changed], [NUMBER[s] for s in WAITING]), last[changed] + every * 1000, NEVER[1]) if every is not None else NEVER[1]
        after[turn] = status[own]
    accepted = (older == 0) & (AFTER[before, rank] >= 0)
    reason = np.where((older == 1) & (rank < len(RANK)), "older than the last change", REFUSED[before, rank])
    columns = ids[job], ms, names[which], STATES[before], STATES[after], accepted, np.where(accepted, None, reason), np.where(accepted, errors, None)
    return pd.DataFrame(dict(zip(("job_id", "at", "command", "before", "after", "accepted", "reason", "error"), columns)))


def transitions(commands: DataFrame, late: str = "0 seconds", every: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The log of answers to a stream of commands: job_id, at (timestamp), command, and error of a failure.

    Commands without job or time are left out; what comes later than ``late`` behind the newest is dropped. The jobs of a
    bucket are read and written together, so that ``buckets`` should grow with them."""
    own = commands.where("job_id is not null and at is not null").select("job_id", "at", F.expr("unix_millis(at)").alias("ms"), "command", "error", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket"))
    return own.withWatermark("at", late).groupBy("bucket").applyInPandasWithState(_bucket(every), LOG, STATE, "append", "EventTimeTimeout")


def states(log: DataFrame) -> DataFrame:
    """Each job's state by a log: id, status, updated_at, error_message."""
    last = log.where("accepted").groupBy("job_id").agg(F.max_by(F.struct("after", "error"), F.struct("at", F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair)), F.col("command")), F.lit(0)))).alias("last"), F.max("at").alias("updated_at"))
    return last.select(F.col("job_id").alias("id"), F.col("last.after").alias("status"), "updated_at", F.col("last.error").alias("error_message"))


def due(jobs: DataFrame, newest: int = NEWEST) -> DataFrame:
    """What a pass over the jobs starts: of the newest jobs those that are completed or paused."""
    return jobs.orderBy(F.desc("created_at"), "id").limit(newest).where(F.col("status").isin(*WAITING))


def startup(credentials: DataFrame, jobs: DataFrame, kinds: tuple[str, ...] = MAIL_CREDENTIALS) -> DataFrame:
    """What happens when the application starts, as commands: credential_id, job_id (null: to be made), command, source_state.

    An active mail credential without a job gets one, which is started at once; jobs of the others that are still running or
    failed are reset, so that the next pass takes them."""
    active = credentials.where(F.col("is_active") & F.col("credential_type").isin(*kinds)).select(F.col("id").alias("credential_id"))
    owned = jobs.select(F.col("id").alias("job_id"), "credential_id", "status")
    made = active.join(owned, "credential_id", "left_anti").select("credential_id", F.lit(None).cast("long").alias("job_id"), F.explode(F.array(F.lit("create"), F.lit("start"))).alias("command"))
    made = made.withColumn("source_state", F.when(F.col("command") == "create", DEFAULT_CONFIG))
    reset = owned.where(F.col("status").isin(*MOVES["reset"][0])).join(active, "credential_id", "left_semi")
    return made.unionByName(reset.select("credential_id", "job_id", F.lit("reset").alias("command"), F.lit(None).cast("string").alias("source_state")))
