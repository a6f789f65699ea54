"""Projects, tasks and the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completion(projects: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks, done tasks and their share for each project."""
    per = tasks.groupBy("project_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"))
    joined = projects.join(per, projects["id"] == per["project_id"], "left")
    total, done = F.coalesce("total", F.lit(0)), F.coalesce("done", F.lit(0))
    return joined.select("id", total.alias("total"), done.alias("done"), F.round(F.when(total > 0, done / total).otherwise(0.0), 6).alias("share"))


def due_within(tasks: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    day = F.lit(as_of).cast("date")
    return tasks.where((F.col("status") != "done") & (F.col("due_date") >= day) & (F.col("due_date") < F.date_add(day, days))).select("id", "status", "priority", "due_date")


def overdue(tasks: DataFrame, as_of: str) -> DataFrame:
    """Open tasks before a day, counted by priority."""
    return tasks.where((F.col("status") != "done") & (F.col("due_date") < F.lit(as_of).cast("date"))).groupBy("priority").agg(F.count("*").alias("n"))


def month_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.trunc("date", "month").alias("month"), "name").agg(F.count("*").alias("n"))


def grid(events: DataFrame, month: str) -> DataFrame:
    """A month's grid of whole weeks from Sunday, with the events of each day."""
    first = F.lit(month).cast("date")
    start = F.date_sub(first, F.dayofweek(first) - 1)
    end = F.date_add(F.last_day(first), 7 - F.dayofweek(F.last_day(first)))
    days = events.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("day"))
    counts = events.where((F.col("date") >= start) & (F.col("date") <= end)).groupBy(F.col("date").alias("day")).agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select("day", (F.dayofweek("day") - 1).alias("weekday"), F.coalesce("n", F.lit(0)).alias("n"), (F.trunc("day", "month") == first).alias("in_month"))


def summary(events: DataFrame, as_of: str) -> DataFrame:
    """Events of the month, of the day, and after it."""
    day = F.lit(as_of).cast("date")
    return events.agg(F.count_if(F.trunc("date", "month") == F.trunc(day, "month")).alias("this_month"), F.count_if(F.col("date") == day).alias("today"), F.count_if(F.col("date") > day).alias("upcoming"))


def linked(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """Tasks linked with projects by the normalised name in ``project_name``; unlinked ones need review."""
    name = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", " ")
    named = projects.select(F.col("id").alias("linked_id"), name(F.col("name")).alias("key"))
    return tasks.withColumn("key", name(F.col("project_name"))).join(named, "key", "left").select("id", "linked_id", F.col("linked_id").isNull().alias("requires_review"))
