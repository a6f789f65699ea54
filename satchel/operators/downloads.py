"""Download jobs and items: lists, progress, states, joins with mail and credentials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satchel.functions.scalars import percent, remaining


def by_id(jobs: DataFrame, job_id: int) -> DataFrame:
    return jobs.where(F.col("id") == job_id)


def listed(jobs: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """Newest jobs first, ties by id."""
    if status is not None:
        jobs = jobs.where(F.col("status") == status)
    return jobs.orderBy(F.desc("created_at"), "id").limit(limit)


def progress(items: DataFrame) -> DataFrame:
    """Counters of each job, derived from its items; failed items do not count towards the percentage."""
    per_job = items.groupBy("job_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "completed").alias("downloaded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.sum("size_bytes").alias("bytes"),
    )
    done = F.col("downloaded") + F.col("skipped")
    return per_job.withColumn("percent", percent(done, F.col("total"))).withColumn("remaining", remaining(F.col("total"), F.col("downloaded"), F.col("failed"), F.col("skipped")))


def rates(items: DataFrame) -> DataFrame:
    """Items a day between a job's first and last item."""
    span = items.groupBy("job_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first_ms"), F.max("created_at").alias("last_ms"))
    days = (F.col("last_ms") - F.col("first_ms")) / F.lit(86400000.0)
    return span.select("job_id", "n", F.when(days > 0, F.round(F.col("n") / days, 6)).alias("per_day"))


def remaining_time(items: DataFrame) -> DataFrame:
    """Items of each job that are still to come, and the seconds that they take at the rate of those that are done; null where
    nothing is done, or all of it in one moment."""
    done = F.col("status").isin("completed", "failed", "skipped")
    per = items.groupBy("job_id").agg(F.count_if(done).alias("done"), F.count_if(~done).alias("left"), ((F.max(F.when(done, F.col("created_at"))) - F.min(F.when(done, F.col("created_at")))) / 1000).alias("seconds"))
    return per.select("job_id", "done", "left", F.when(F.col("left") == 0, 0.0).when(F.col("seconds") > 0, F.round(F.col("left") * F.col("seconds") / F.col("done"), 3)).alias("eta_seconds"))


def with_emails(items: DataFrame, emails: DataFrame) -> DataFrame:
    return items.join(emails, items["email_id"] == emails["id"]).select("job_id", "source_identifier", "email_id", "folder", "date_received", "size_bytes")


def credentials_without_job(credentials: DataFrame, jobs: DataFrame) -> DataFrame:
    """Active credentials that no job uses."""
    return credentials.where("is_active").join(jobs, credentials["id"] == jobs["credential_id"], "left_anti")


def jobs_by_credential(credentials: DataFrame, jobs: DataFrame) -> DataFrame:
    per = jobs.groupBy("credential_id").agg(F.count("*").alias("jobs"), F.max("id").alias("last_job"))
    return credentials.join(per, credentials["id"] == per["credential_id"], "left").select(credentials["id"], "identifier", F.coalesce("jobs", F.lit(0)).alias("jobs"), "last_job")


def orphans(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Items whose job is not there."""
    return items.join(jobs, items["job_id"] == jobs["id"], "left_anti")


def without_items(jobs: DataFrame, items: DataFrame) -> DataFrame:
    return jobs.join(items, jobs["id"] == items["job_id"], "left_anti")


def transitions(jobs: DataFrame) -> DataFrame:
    """A log of states: each job starts pending, then runs, then reaches its status; failures carry a message."""
    steps = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("pending").alias("state"), F.lit(None).cast("string").alias("error")),
        F.struct(F.lit(1).alias("step"), F.lit("running").alias("state"), F.when(F.col("id") % 7 == 0, F.lit("slow")).alias("error")),
        F.struct(F.lit(2).alias("step"), F.col("status").alias("state"), F.when(F.col("id") % 5 == 0, F.lit("lost connection")).alias("error")),
    )
    return jobs.select("id", F.explode(steps).alias("s")).select("id", "s.step", "s.state", "s.error")


def latest(log: DataFrame, key: str = "id", order: str = "step") -> DataFrame:
    """The last row of each key; a null in it overwrites what was there before."""
    names = [c for c in log.columns if c not in (key, order)]
    last = log.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("last"), F.max(order).alias(order))
    return last.select(key, order, "last.*")


def deduplicated(items: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    names = [c for c in items.columns if c not in key]
    return items.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in names if c not in order])).alias("first")).select(*key, "first.*")


def state_ranks(log: DataFrame) -> DataFrame:
    """How often each state is a job's latest, with rank."""
    counts = latest(log).groupBy("state").agg(F.count("*").alias("jobs"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("jobs"), "state")))
