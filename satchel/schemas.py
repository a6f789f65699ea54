"""Explicit schemas and value domains of the personal-data lake.

Times keep the unit of their table family: seconds for assistant sessions, milliseconds for downloads and mail.
"""

from __future__ import annotations

from pyspark.sql import types as T

ADDRESSES = "array<struct<email:string,name:string>>"

TABLES: dict[str, str] = {
    "agent_sessions": "id bigint, agent_name string, provider string, model string, system_prompt string, user_prompt string, config string, status string, started_at bigint, ended_at bigint, result string, error string",
    "agent_messages": "id bigint, session_id bigint, role string, content string, created_at bigint",
    "agent_tool_calls": "id bigint, session_id bigint, message_id bigint, tool_call_id string, tool_name string, request string, response string, status string, created_at bigint, completed_at bigint, execution_time_ms bigint, error_details string",
    "credentials_metadata": "id bigint, credential_type string, identifier string, username string, service_name string, port int, use_tls boolean, notes string, created_at bigint, updated_at bigint, last_accessed_at bigint, is_active boolean, extra_metadata string",
    "download_jobs": "id bigint, source_type string, credential_id bigint, status string, source_state string, error_message string, created_at bigint, updated_at bigint",
    "download_items": "id bigint, job_id bigint, source_identifier string, source_folder string, item_type string, status string, size_bytes bigint, mime_type string, metadata string, error_message string, created_at bigint, updated_at bigint",
    "emails": f"id bigint, download_item_id bigint, uid bigint, folder string, message_id string, subject string, from_address string, from_name string, to_addresses {ADDRESSES}, cc_addresses {ADDRESSES}, bcc_addresses {ADDRESSES}, reply_to string, date_sent bigint, date_received bigint, body_text string, body_html string, is_read boolean, is_flagged boolean, is_draft boolean, is_answered boolean, has_attachments boolean, attachment_count int, size_bytes bigint, thread_id string, labels array<string>, created_at bigint, updated_at bigint",
    "email_attachments": "id bigint, email_id bigint, filename string, content_type string, size_bytes bigint, content_id string, file_path string, checksum string, is_inline boolean, extraction_status string, extracted_text string, created_at bigint, updated_at bigint",
    "projects": "id bigint, name string, description string, status string, tasks_completed int, tasks_total int, deadline date, notifications int, created_at bigint, updated_at bigint",
    "tasks": "id bigint, project_id bigint, title string, description string, status string, priority string, due_date date, assigned_to string, created_at bigint, updated_at bigint",
    "events": "id bigint, name string, description string, project_id bigint, task_id bigint, date date, attendee_user_ids array<bigint>, created_at bigint, updated_at bigint",
    "finance_accounts": "id bigint, account_name string, account_type string, institution string, balance decimal(18,2), currency string",
    "finance_transactions": "id bigint, account_id bigint, date bigint, description string, amount decimal(18,2), category string",
    "travel_destinations": "id bigint, name string, country string, arrival_date bigint, departure_date bigint, budget decimal(18,2)",
    "travel_activities": "id bigint, destination_id bigint, activity_name string, date bigint, cost decimal(18,2), booking_status string",
}

DOMAINS: dict[str, tuple[str, ...]] = {
    "session_status": ("running", "completed", "failed"),
    "message_role": ("user", "assistant", "system", "tool"),
    "tool_call_status": ("pending", "executing", "completed", "failed"),
    "job_status": ("pending", "running", "paused", "completed", "failed", "cancelled"),
    "item_status": ("pending", "downloading", "completed", "failed", "skipped"),
    "source_type": ("imap", "google-drive", "dropbox", "one-drive"),
    "extraction_status": ("pending", "completed", "failed", "skipped"),
    "project_status": ("active", "planning", "on-hold", "completed", "archived"),
    "task_status": ("todo", "in-progress", "review", "done", "cancelled"),
    "priority": ("critical", "high", "medium", "low"),
}



def schema(table: str) -> T.StructType:
    """The explicit schema of a table."""
    return T.StructType.fromDDL(TABLES[table])
