"""Writes of single records: sessions, messages, tool calls, jobs, credentials, domain tables.

Times come from the caller, so that runs can be repeated: seconds for sessions, milliseconds for downloads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.sources.store import Store


def _one(store: Store, table: str, **values) -> int:
    """Appends one row under the next id and returns it; writers at the same time get different ones."""
    next_id = store._claim(table, 1)
    row = store.spark.range(1).select(F.lit(next_id).alias("id"), *(F.lit(v).alias(k) for k, v in values.items()))
    store.append(table, row)
    return next_id


def create_session(store: Store, agent: str, prompt: str, now: int, config: str | None = None) -> int:
    """A running session; an absent config is the JSON text null."""
    return _one(store, "agent_sessions", agent_name=agent, user_prompt=prompt, config=config or "null", status="running", started_at=now)


def end_session(store: Store, session: int, now: int, result: str | None = None, error: str | None = None) -> None:
    """Completed with a result, or failed with an error."""
    store.transition("agent_sessions", session, status="completed" if error is None else "failed", ended_at=now, result=result, error=error)


def create_message(store: Store, session: int, role: str, content: str, now: int) -> int:
    return _one(store, "agent_messages", session_id=session, role=role, content=content, created_at=now)


def create_tool_call(store: Store, session: int, tool: str, request: str, now: int) -> int:
    return _one(store, "agent_tool_calls", session_id=session, tool_name=tool, request=request, status="pending", created_at=now)


def end_tool_call(store: Store, call: int, now: int, millis: int | None = None, response: str | None = None, error: str | None = None) -> None:
    store.transition("agent_tool_calls", call, status="completed" if error is None else "failed", completed_at=now, execution_time_ms=millis, response=response, error_details=error)


def create_job(store: Store, source: str, credential: int, state: str, now: int) -> int:
    return _one(store, "download_jobs", source_type=source, credential_id=credential, status="pending", source_state=state, created_at=now, updated_at=now)


def set_job_status(store: Store, job: int, status: str, now: int, error: str | None = None) -> None:
    """The error is overwritten, also by nothing."""
    store.transition("download_jobs", job, status=status, error_message=error, updated_at=now)


def set_source_state(store: Store, job: int, state: str, now: int) -> None:
    store.transition("download_jobs", job, source_state=state, updated_at=now)


def add_credential(store: Store, kind: str, identifier: str, username: str, now: int) -> int:
    """A credential under an identifier that no other has. Secrets are kept elsewhere."""
    if not store.latest("credentials_metadata").where(F.col("identifier") == identifier).isEmpty():
        raise ValueError(f"identifier {identifier} is taken")
    return _one(store, "credentials_metadata", credential_type=kind, identifier=identifier, username=username, is_active=True, created_at=now, updated_at=now)


def update_credential(store: Store, credential: int, now: int, **changes) -> None:
    """Changes what may be changed of a credential; an identifier must not be another's."""
    fixed = set(changes) - {"identifier", "username", "service_name", "port", "use_tls", "notes", "extra_metadata", "last_accessed_at", "is_active"}
    if fixed:
        raise ValueError(f"not to be changed: {', '.join(sorted(fixed))}")
    known = store.latest("credentials_metadata")
    if known.where(F.col("id") == credential).isEmpty():
        raise ValueError(f"no credential {credential}")
    if "identifier" in changes and not known.where((F.col("identifier") == changes["identifier"]) & (F.col("id") != credential)).isEmpty():
        raise ValueError(f"identifier {changes['identifier']} is taken")
    store.transition("credentials_metadata", credential, updated_at=now, **changes)


def delete_message(store: Store, message: int) -> None:
    """A message goes; tool calls that it made stay, without it."""
    gone = store.spark.createDataFrame([(message,)], "id bigint")
    calls = store.read("agent_tool_calls").where(F.col("message_id") == message)
    if not calls.isEmpty():
        # all rows of these calls, of the old version of the table, which stays on disk
        own = store.read("agent_tool_calls").join(calls.select("id").distinct(), "id", "left_semi")
        freed = own.withColumn("message_id", F.when(F.col("message_id") != message, F.col("message_id")))
        store.delete("agent_tool_calls", calls.select("id"))
        store.append("agent_tool_calls", freed)
    store.delete("agent_messages", gone)


def remove_credential(store: Store, credential: int, now: int, hard: bool = False) -> None:
    """Made inactive, or deleted."""
    if hard:
        store.delete("credentials_metadata", store.spark.createDataFrame([(credential,)], "id bigint"))
    else:
        store.transition("credentials_metadata", credential, is_active=False, updated_at=now)


def extended(table: DataFrame, rows: DataFrame) -> DataFrame:
    """A domain table with more rows and maybe more columns; old rows have nulls there."""
    return table.unionByName(rows, allowMissingColumns=True)


def healthy(store: Store) -> bool:
    """Whether the session answers."""
    return store.spark.range(1).count() == 1
