"""Tasks and projects from message text by patterns, and post-processing of recognised spans and model answers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.operators.attachments import bound, exploded
from satchel.schemas import DOMAINS


@dataclass(frozen=True)
class Pattern:
    """A kind of phrase: a regular expression (``group`` of it is the value) or keywords, of which the first that is found is
    the value. With both, a keyword must be anywhere in the text. Around a match one of ``near`` must be and none of ``never``."""

    name: str
    entity: str
    confidence: float
    regex: str = ""
    group: int = 1
    keywords: tuple[str, ...] = ()
    near: tuple[str, ...] = ()
    never: tuple[str, ...] = ()


#: Characters before and after a match that count as its context.
CONTEXT = 50
_DAY = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{1,2}\b|\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2}"
#: Our own expressions, common to Java and RE2. Kinds, confidences, keywords and context words are fixed values.
PATTERNS = (
    Pattern("due_date", "task", 0.9, rf"(?i)\b(?:due|deadline|(?:complete|finish) by)(?: date)?(?: is| by| on|:)* ?({_DAY})", near=("task", "action", "complete"), never=("project deadline",)),
    Pattern("priority", "priority", 0.85, keywords=("urgent", "ASAP", "high priority", "critical", "important"), near=("task", "action", "need"), never=("not urgent", "low priority")),
    Pattern("assignee", "task", 0.8, r"(?i)\bassigned to:? *@?([a-z0-9#]+)", never=("from",)),
    Pattern("numbered", "task", 0.75, r"(?m)^ ?\d+[.)] +([^\n]+)"),
    Pattern("bracket_project", "project", 0.85, r"\[([A-Za-z0-9# _-]+)\]"),
    Pattern("named_project", "project", 0.75, r"(?i)\b(?:for|regarding|about) the ([a-z0-9#]+(?: [a-z0-9#]+){0,4}) project\b"),
    Pattern("meeting", "event", 0.8, rf"(?i)\b(meeting|call|sync|standup|review)(?: with [a-z0-9#]+)?(?: on| at)? +(?:{_DAY})"),
)


def _in_context(text: Column, start: Column, length: Column, p: Pattern) -> Column:
    """Whether the words around the match at ``start`` (from 1) fit."""
    first = F.greatest(start - CONTEXT, F.lit(1))
    context = F.lower(F.substring(text, first, start - first + length + CONTEXT))
    has = lambda words: F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(context, w))
    return (has(p.near) if p.near else F.lit(True)) & (~has(p.never) if p.never else F.lit(True))


def _value(text: Column, p: Pattern) -> Column:
    """The value of the first match of a pattern whose context fits, else null."""
    place = lambda word: F.position(F.lit(word.lower()), F.lower(text))
    if not p.regex:
        return F.coalesce(*(F.when((place(k) > 0) & _in_context(text, place(k), F.lit(len(k)), p), F.lit(k)) for k in p.keywords))
    there = F.exists(F.array(*(F.lit(k.lower()) for k in p.keywords)), lambda k: F.contains(F.lower(text), k)) if p.keywords else F.lit(True)
    if not (p.near or p.never):
        found = F.regexp_extract_all(text, F.lit(p.regex), F.lit(p.group))
        return F.when(there, F.trim(F.get(found, 0)))
    # each match is looked for behind the one before it
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(p.regex), F.lit(p.group)).alias("value"))
    start = F.struct(F.lit(1).alias("at"), F.lit(None).cast("string").alias("value"))

    def step(state: Column, m: Column) -> Column:
        at = F.position(m["whole"], text, state["at"])
        fits = state["value"].isNull() & _in_context(text, at, F.length(m["whole"]), p)
        return F.struct((at + F.length(m["whole"])).alias("at"), F.when(fits, F.trim(m["value"])).otherwise(state["value"]).alias("value"))

    return F.when(there, F.aggregate(both, start, step)["value"])


def matches(messages: DataFrame, text: str = "text", patterns: tuple[Pattern, ...] = PATTERNS, min_confidence: float = 0.0, max_results: int | None = None, only: tuple[str, ...] = ()) -> DataFrame:
    """The first fitting match of each pattern in each message: pattern, entity, value, confidence, requires_review. ``only``
    names the patterns that are looked for, all by default."""
    wanted = [p for p in patterns if p.confidence >= min_confidence and (not only or p.name in only)]
    found = [F.struct(F.lit(p.name).alias("pattern"), F.lit(p.entity).alias("entity"), _value(F.col(text), p).alias("value"), F.lit(p.confidence).alias("confidence")) for p in wanted]
    hits = F.filter(F.array(*found), lambda x: x["value"].isNotNull())
    rows = exploded(messages, hits if max_results is None else F.slice(hits, 1, max_results), text)
    return rows.withColumn("requires_review", F.col("confidence") < 0.8)


def message_text(subject: Column, body: Column) -> Column:
    """What patterns read of a message: its subject, an empty line and its body."""
    return F.concat(F.coalesce(subject, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")))


def phrase_date(text: Column, as_of: Column) -> Column:
    """The date that a phrase names: M/D/YYYY, tomorrow, next week, in N days."""
    absolute = F.try_to_date(F.regexp_extract(text, r"\b(\d{1,2}/\d{1,2}/\d{4})\b", 1), "M/d/yyyy")
    n = F.regexp_extract(text, r"(?i)\bin (\d{1,4}) days?\b", 1)
    return (
        F.when(absolute.isNotNull(), absolute)
        .when(F.regexp_like(text, F.lit(r"(?i)\btomorrow\b")), F.date_add(as_of, 1))
        .when(F.regexp_like(text, F.lit(r"(?i)\bnext week\b")), F.date_add(as_of, 7))
        .when(F.length(n) > 0, F.date_add(as_of, F.when(F.length(n) > 0, n).otherwise("0").cast("int")))
    )


def merged_spans(spans: DataFrame, key: str, gap: int = 2) -> DataFrame:
    """Spans (label, start, stop, score) of a text joined where the next begins at most ``gap`` after the last's end."""
    w = Window.partitionBy(key, "label").orderBy("start", "stop")
    end = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(end.isNull() | (F.col("start") > end + gap), 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    return islands.groupBy(key, "label", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("parts")).drop("island")


def adjusted(confidence: Column, text: Column, context: tuple[str, ...], negations: tuple[str, ...], required: str | None = None) -> Column:
    """Confidence times 1.2 with a context word or 0.8 without, 0.3 with a negation, 0.5 without the required pattern."""
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))
    out = confidence * (F.when(has(context), 1.2).otherwise(0.8) if context else F.lit(1.0))
    out = out * (F.when(has(negations), 0.3).otherwise(1.0) if negations else F.lit(1.0))
    out = out * (F.when(F.regexp_like(text, F.lit(required)), 1.0).otherwise(0.5) if required else F.lit(1.0))
    return F.round(F.least(out, F.lit(1.0)), 6)


#: For each kind of answer its list, the fields of an item, those that it must have, and the values that its status may take.
ANSWERS: dict[str, tuple[str, str, tuple[str, ...], dict[str, tuple[str, ...]]]] = {
    "task": ("tasks", "title:string,description:string,priority:string,due_date:string,assigned_to:string,project_id:bigint", ("title",), {"priority": DOMAINS["priority"]}),
    "project": ("projects", "name:string,description:string,deadline:string,status:string", ("name",), {"status": DOMAINS["project_status"]}),
    "event": ("events", "name:string,description:string,date:string,location:string,attendees:array<string>,project_id:bigint", ("name", "date"), {}),
}


def model_results(answers: DataFrame, kind: str, response: str = "response") -> DataFrame:
    """Tasks, projects or events of model answers (JSON text), with the other columns kept: the item's fields, ``confidence``
    and ``requires_review``.

    An answer of which an item lacks what it must have gives no rows. Confidence is 0.7 by default, unknown priorities and
    statuses are null, attendees that are no text are left out, and results below 0.8 need review."""
    name, fields, needed, domains = ANSWERS[kind]
    shape = f"array<struct<{fields},confidence:double>>"
    found = F.coalesce(F.from_json(response, f"struct<{name}:{shape}>")[name], F.array().cast(shape))
    whole = lambda items: F.forall(items, lambda t: reduce(and_, (t[n].isNotNull() for n in needed)))
    # of an answer that is not whole nothing is taken
    items = bound(found, lambda items: F.when(whole(items), items))
    columns = [f.split(":")[0] for f in fields.replace("array<string>", "strings").split(",")]
    rows = exploded(answers, items, response)
    for column, values in domains.items():
        rows = rows.withColumn(column, F.when(F.col(column).isin(*values), F.col(column)))
    if "attendees" in columns:
        rows = rows.withColumn("attendees", F.coalesce(F.array_compact("attendees"), F.array().cast("array<string>")))
    confidence = F.coalesce("confidence", F.lit(0.7))
    keep = [c for c in answers.columns if c != response]
    return rows.select(*keep, *columns, confidence.alias("confidence"), (confidence < 0.8).alias("requires_review"))


def model_answers(answers: DataFrame, response: str = "response") -> DataFrame:
    """Tasks of model answers by title, priority and due date; see model_results()."""
    return model_results(answers, "task", response).drop("description", "assigned_to", "project_id")


def needs_model(messages: DataFrame, results: DataFrame, key: str, least: float = 0.7) -> DataFrame:
    """Messages for which no cheaper extractor reached the least confidence."""
    sure = results.groupBy(key).agg(F.max("confidence").alias("best")).where(F.col("best") >= least)
    return messages.join(sure, key, "left_anti")


def scored_spans(tokens: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Spans over the threshold from tokens (start, stop, scores by label): one row a token and label."""
    return tokens.select(*[c for c in tokens.columns if c != "scores"], F.explode("scores").alias("label", "score")).where(F.col("score") > threshold)


def recognised(spans: DataFrame, least: dict[str, float], review: float = 0.75) -> DataFrame:
    """Entities of spans whose score reaches their label's least one; those below ``review`` need review."""
    bound = F.create_map(*(F.lit(x) for pair in least.items() for x in pair))
    return spans.where(F.col("score") >= F.try_element_at(bound, F.col("label"))).withColumn("requires_review", F.col("score") < review)
