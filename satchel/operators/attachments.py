"""Typed entities from calendar files and contact cards, with column expressions only.

Input: one row an attachment with filename, content_type and content (text). A file that breaks a rule gives no rows but a
row of rejects(); other files go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALENDAR, CARD = "calendar", "card"
EVENT_CONFIDENCE, CONTACT_CONFIDENCE = 0.98, 0.97
VALUE = r'^[^:"]*(?:"[^"]*"[^:"]*)*:(.*)$'


def route(filename: Column, content_type: Column) -> Column:
    """calendar, card or null. The type is compared in lower case and may have parameters; endings count as written; a
    calendar wins over a card."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    name = F.coalesce(filename, F.lit(""))
    calendar = F.contains(kind, F.lit("text/calendar")) | F.endswith(name, F.lit(".ics"))
    card = F.contains(kind, F.lit("text/vcard")) | F.contains(kind, F.lit("text/x-vcard")) | F.endswith(name, F.lit(".vcf"))
    return F.when(calendar, CALENDAR).when(card, CARD)


def _lines(block: Column) -> Column:
    """Name and value of each line. Only quotes, in which a colon ends no name, need an expression of their own."""

    def line(x: Column) -> Column:
        name = F.upper(F.substring_index(F.substring_index(x, ":", 1), ";", 1))
        plain = F.when(F.contains(x, F.lit(":")), F.substring(x, F.locate(":", x) + 1, F.lit(1 << 30))).otherwise("")
        return F.struct(name.alias("name"), F.when(F.contains(x, F.lit('"')), F.regexp_extract(x, VALUE, 1)).otherwise(plain).alias("value"))

    return F.transform(F.filter(F.split(block, r"\r?\n"), lambda x: F.length(x) > 0), line)


def _first(lines: Column, name: str) -> Column:
    return F.get(F.filter(lines, lambda p: p["name"] == name), 0)["value"]


def ics_time(value: Column) -> Column:
    """A date with time, read as UTC whatever zone it names; null for dates without time and other text."""
    plain = F.translate(value, ":-", "")
    local = F.regexp_extract(plain, r"^(\d{8}T\d{6})", 1)
    return F.when((F.length(local) > 0) & (~F.endswith(plain, F.lit("Z")) | (F.length(plain) >= 16)), F.try_to_timestamp(local, F.lit("yyyyMMdd'T'HHmmss")))


def calendar_events(files: DataFrame, attendees: bool = True, location: bool = True) -> DataFrame:
    """Events of calendar files with key columns kept: position, name, start, description, location, attendees, valid, file_valid.

    A file is valid if each of its events has SUMMARY and a DTSTART with time. The first property of a name counts.
    Attendees are values that begin with ``mailto:`` in lower case, without it.
    """
    unfolded = F.regexp_replace("content", r"\r?\n[ \t]", "")
    blocks = F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT"), F.lit(1))

    def event(p: Column, position: Column) -> Column:
        people = F.transform(F.filter(p, lambda x: (x["name"] == "ATTENDEE") & F.startswith(x["value"], F.lit("mailto:"))), lambda x: F.substring(x["value"], 8, 1 << 30))
        return F.struct(
            position.alias("position"), _first(p, "SUMMARY").alias("name"), bound(_first(p, "DTSTART"), ics_time).alias("start"), _first(p, "DESCRIPTION").alias("description"),
            (_first(p, "LOCATION") if location else F.lit(None).cast("string")).alias("location"), (people if attendees else F.array().cast("array<string>")).alias("attendees"),
        )

    valid = lambda e: e["name"].isNotNull() & e["start"].isNotNull()
    names = ("position", "name", "start", "description", "location", "attendees")

    def told(events: Column) -> Column:
        whole = F.forall(events, valid)
        return F.transform(events, lambda e: F.struct(*(e[n].alias(n) for n in names), valid(e).alias("valid"), whole.alias("file_valid")))

    events = F.transform(F.transform(blocks, _lines), event)
    return exploded(files, bound(events, told), "content")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def exploded(rows: DataFrame, items: Column, *without: str) -> DataFrame:
    """A row for each struct in ``items``, with the other columns but ``without`` kept. Conditions on the structs stay above:
    an outer explode with its null row dropped is not copied below, where the whole of ``items`` would run again."""
    keep = [F.col(f"`{c}`") for c in rows.columns if c not in without]
    return rows.select(*keep, F.explode_outer(items).alias("__item")).where("__item is not null").select(*keep, "__item.*")


def contacts(files: DataFrame) -> DataFrame:
    """Cards of contact files with key columns kept: position, name, email, phone, organization, size (bytes of the card), valid,
    file_valid.

    A card is what follows BEGIN:VCARD; END is not needed. The last line of a kind counts. EMAIL and TEL give the text
    between the first and the second colon. A file is valid if each card has FN.
    """
    def card(text: Column, position: Column) -> Column:
        def read(lines: Column) -> Column:
            def last(prefix: str, extra: str = "") -> Column:
                return F.get(F.reverse(F.filter(lines, lambda x: F.startswith(x, F.lit(prefix)) & (F.contains(x, F.lit(extra)) if extra else F.lit(True)))), 0)

            return F.struct(
                position.alias("position"), F.substring(last("FN:"), 4, 1 << 30).alias("name"), F.get(F.split(last("EMAIL", ":"), ":"), 1).alias("email"),
                F.get(F.split(last("TEL", ":"), ":"), 1).alias("phone"), F.substring(last("ORG:"), 5, 1 << 30).alias("organization"),
                F.octet_length(text).alias("size"),
            )

        return bound(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), read)

    valid = lambda c: c["name"].isNotNull()
    names = ("position", "name", "email", "phone", "organization", "size")

    def told(found: Column) -> Column:
        whole = F.forall(found, valid)
        return F.transform(found, lambda c: F.struct(*(c[n].alias(n) for n in names), valid(c).alias("valid"), whole.alias("file_valid")))

    cards = bound(F.split("content", "BEGIN:VCARD"), lambda parts: F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))))
    return exploded(files, bound(F.transform(cards, card), told), "content")


def valid_files(rows: DataFrame) -> DataFrame:
    """Rows of files all of whose rows are valid."""
    return rows.where("file_valid").drop("valid", "file_valid")


def rejects(rows: DataFrame, key: str) -> DataFrame:
    return rows.where("not valid").groupBy(key).agg(F.count("*").alias("broken")).withColumn("reason", F.lit("a required property is missing or broken"))


def extracted(files: DataFrame, key: str, target: str | None = None, least: float = 0.0, most: int | None = None) -> DataFrame:
    """Events and contacts of a table of attachments as one typed table, with ``evidence`` and its ``span`` in bytes: for a card
    its block, for an event the empty one.

    ``target`` (event or contact) is the only kind wanted, ``least`` the least confidence, ``most`` the most results of a key,
    surest first, then in the order of the file."""
    routed = files.withColumn("kind", route(F.col("filename"), F.col("content_type")))
    single = lambda x: F.lit(x).cast("float")
    span = lambda stop: F.struct(F.lit(0).cast("long").alias("start"), stop.cast("long").alias("stop"))
    found = []
    if target in (None, "event") and least <= EVENT_CONFIDENCE:
        events = valid_files(calendar_events(routed.where(F.col("kind") == CALENDAR)))
        found.append(events.select(key, "position", F.lit("event").alias("data_type"), F.struct("name", "description", F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("date"), "location", "attendees").alias("event"), single(EVENT_CONFIDENCE).alias("confidence"), F.create_map(*map(F.lit, ("name", 1.0, "date", 1.0, "location", 0.95, "attendees", 0.90))).alias("breakdown"), F.concat(F.lit("ICS Event: "), "name").alias("evidence"), span(F.lit(0)).alias("span")))
    if target in (None, "contact") and least <= CONTACT_CONFIDENCE:
        cards = valid_files(contacts(routed.where(F.col("kind") == CARD)))
        found.append(cards.select(key, "position", F.lit("contact").alias("data_type"), F.struct("name", "email", "phone", "organization").alias("contact"), single(CONTACT_CONFIDENCE).alias("confidence"), F.create_map(*map(F.lit, ("name", 1.0, "email", 0.98, "phone", 0.95))).alias("breakdown"), F.concat(F.lit("VCF Contact: "), "name").alias("evidence"), span(F.col("size")).alias("span")))
    if not found:
        return extracted(files.where("false"), key)
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)
    if most is not None:
        w = Window.partitionBy(key).orderBy(F.desc("confidence"), "position")
        rows = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
    return rows.drop("position").withColumn("requires_review", F.lit(False))


def contact_card(name: Column, email: Column, phone: Column, organization: Column) -> Column:
    """Text of a contact card."""
    return F.concat_ws("\n", F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), F.concat(F.lit("FN:"), name), F.concat(F.lit("EMAIL;TYPE=work:"), email), F.concat(F.lit("TEL;TYPE=cell:"), phone), F.concat(F.lit("ORG:"), organization), F.lit("END:VCARD"))


def calendar_file(uid: Column, start: Column, summary: Column, attendees: list[Column]) -> Column:
    """Text of a calendar file with one event, its summary folded over two lines."""
    people = [F.concat(F.lit("ATTENDEE;CN=\"A: b\":"), a) for a in attendees]
    folded = F.concat(F.lit("SUMMARY:"), F.substring(summary, 1, 4), F.lit("\r\n "), F.substring(summary, 5, 1 << 30))
    return F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART;TZID=Europe/Paris:"), start), folded, *people, F.lit("END:VEVENT"), F.lit("END:VCALENDAR"))
