"""Assistant sessions: lists, lookups, nested detail and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent(sessions: DataFrame, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest sessions first, ties by id; the status filter is optional."""
    if status is not None:
        sessions = sessions.where(F.col("status") == status)
    return sessions.orderBy(F.desc("started_at"), "id").offset(offset).limit(limit) if offset else sessions.orderBy(F.desc("started_at"), "id").limit(limit)


def by_id(sessions: DataFrame, session_id: int) -> DataFrame:
    """One session; a config that is no JSON is null."""
    return sessions.where(F.col("id") == session_id).withColumn("config", F.to_json(F.try_parse_json("config")))


def messages_of(messages: DataFrame, session_id: int) -> DataFrame:
    return messages.where(F.col("session_id") == session_id).orderBy("created_at", "turn")


def tool_calls_of(calls: DataFrame, session_id: int) -> DataFrame:
    """A session's calls in order; see rejected_calls() for requests that are no JSON. A response that is none is null."""
    if "response" in calls.columns:
        calls = calls.withColumn("response", valid_json("response"))
    own = calls.where((F.col("session_id") == session_id) & F.try_parse_json("request").isNotNull())
    return own.orderBy("created_at", "id")


def rejected_calls(calls: DataFrame) -> DataFrame:
    """Calls whose request is no JSON, with the reason."""
    return calls.where(F.col("request").isNotNull() & F.try_parse_json("request").isNull()).withColumn("reason", F.lit("request is not JSON"))


def detail(sessions: DataFrame, messages: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Sessions with their messages nested in order, and with ``calls`` their tool calls: tool_name, request, response, status,
    execution_time_ms. Calls whose request is no JSON are left out, as in tool_calls_of(); a broken response is null."""
    nested = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "turn", "role", "content"))).alias("messages"))
    out = sessions.join(nested, sessions["id"] == nested["session_id"], "left").drop("session_id")
    if calls is None:
        return out
    told = F.struct("created_at", "id", "tool_name", "request", valid_json("response").alias("response"), "status", "execution_time_ms")
    own = calls.where(F.try_parse_json("request").isNotNull()).groupBy(F.col("session_id").alias("id")).agg(F.array_sort(F.collect_list(told)).alias("tool_calls"))
    own = own.withColumn("tool_calls", F.transform("tool_calls", lambda c: F.struct(*(c[n].alias(n) for n in ("tool_name", "request", "response", "status", "execution_time_ms")))))
    none = F.array().cast(own.schema["tool_calls"].dataType)
    return out.join(own, "id", "left").withColumn("tool_calls", F.coalesce("tool_calls", none))


def valid_json(column: str) -> Column:
    """A text that is JSON, else null."""
    return F.when(F.try_parse_json(column).isNotNull(), F.col(column))


def message_gaps(messages: DataFrame) -> DataFrame:
    """Each message with the characters of the one before it and the seconds since."""
    w = Window.partitionBy("session_id").orderBy("created_at", "turn")
    return messages.select("session_id", "turn", (F.col("created_at") - F.lag("created_at").over(w)).alias("gap"), F.lag("role").over(w).alias("previous_role"))


def tool_latency(calls: DataFrame) -> DataFrame:
    return calls.groupBy("tool_name", "status").agg(F.count("*").alias("calls"), F.min("execution_time_ms").alias("least_ms"), F.max("execution_time_ms").alias("most_ms"))


def token_use(calls: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Tokens and cost of each session; calls: session_id, tokens_in, tokens_out. Prices are for a million tokens."""
    sums = calls.groupBy("session_id").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return sums.withColumn("cost", F.round((F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6, 6))
