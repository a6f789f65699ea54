"""Occurrences of recurring calendar events inside a window, with the zones that the file names or brings.

A rule (frequency, interval, count, until, days, months) is run lazily from the window's begin on, or from its start where a
count has to be kept, and stops at the window's end, so that an endless rule is as cheap as a short one. Local times become
UTC by the zone blocks of the file, else by the zone's public name; times without zone are UTC.
"""

from __future__ import annotations

import re
from calendar import monthrange
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame

from satchel.session import spread

DAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
FREQUENCIES = ("DAILY", "WEEKLY", "MONTHLY", "YEARLY")
#: Occurrences that leave a task in one batch.
AT_ONCE = 1 << 13


@lru_cache(1 << 12)
def _length(year: int, month: int) -> int:
    return monthrange(year, month)[1]


@dataclass(frozen=True)
class Rule:
    """A recurrence rule. ``days`` are (nth, weekday): nth 0 is every one, negative ones count from the period's end."""

    frequency: str
    interval: int = 1
    count: int | None = None
    until: str = ""
    days: tuple[tuple[int, int], ...] = ()
    month_days: tuple[int, ...] = ()
    months: tuple[int, ...] = ()

    @staticmethod
    def read(text: str) -> Rule:
        """Fails on what it does not know, so that no rule is half obeyed."""
        parts = dict(p.split("=", 1) for p in text.strip().upper().split(";") if p)
        unknown = set(parts) - {"FREQ", "INTERVAL", "COUNT", "UNTIL", "BYDAY", "BYMONTHDAY", "BYMONTH", "WKST"}
        if unknown or parts.get("FREQ") not in FREQUENCIES or parts.get("WKST", "MO") != "MO":
            raise ValueError(f"a rule of another kind: {text}")
        days = [re.fullmatch(r"([+-]?\d+)?(MO|TU|WE|TH|FR|SA|SU)", d) for d in parts.get("BYDAY", "").split(",") if d]
        if None in days:
            raise ValueError(f"days of another kind: {text}")
        numbers = lambda name: tuple(int(x) for x in parts.get(name, "").split(",") if x)
        return Rule(parts["FREQ"], max(1, int(parts.get("INTERVAL", 1))), int(parts["COUNT"]) if "COUNT" in parts else None, parts.get("UNTIL", ""), tuple((int(d[1] or 0), DAYS.index(d[2])) for d in days), numbers("BYMONTHDAY"), numbers("BYMONTH"))

    def _of_span(self, first: date, after: date, start: date, own_day: bool) -> list[date]:
        """Days of a month or year (first to the day before ``after``) that the rule names."""
        span = [first + timedelta(days=i) for i in range((after - first).days)]
        if self.days:
            found = set()
            for nth, weekday in self.days:
                same = [d for d in span if d.weekday() == weekday]
                found |= set(same) if nth == 0 else {same[nth - (nth > 0)]} if abs(nth) <= len(same) else set()
            span = sorted(found)
        if self.month_days:
            span = [d for d in span if d.day in self.month_days or d.day - _length(d.year, d.month) - 1 in self.month_days]
        elif not self.days:
            span = [d for d in span if d.day == start.day and (own_day or d.month == start.month)]
        return span

    def _period(self, n: int, start: date) -> list[date]:
        """Days of the n-th period."""
        k = n * self.interval
        if self.frequency == "DAILY":
            day = start + timedelta(days=k)
            found = [day] if not self.days or day.weekday() in {w for _, w in self.days} else []
            found = self._of_month_days(found)
        elif self.frequency == "WEEKLY":
            monday = start - timedelta(days=start.weekday()) + timedelta(weeks=k)
            found = [monday + timedelta(days=w) for w in sorted({w for _, w in self.days} or {start.weekday()})]
        elif self.frequency == "MONTHLY":
            year, month = divmod(start.year * 12 + start.month - 1 + k, 12)
            first = date(year, month + 1, 1)
            if self.months and first.month not in self.months:
                return []
            return self._of_span(first, (first + timedelta(days=31)).replace(day=1), start, True)
        else:
            year = start.year + k
            if self.months:
                firsts = [date(year, m, 1) for m in sorted(self.months)]
                return [d for f in firsts for d in self._of_span(f, (f + timedelta(days=31)).replace(day=1), start, True)]
            if self.month_days:
                firsts = [date(year, m, 1) for m in range(1, 13)]
                return [d for f in firsts for d in self._of_span(f, (f + timedelta(days=31)).replace(day=1), start, True)]
            return self._of_span(date(year, 1, 1), date(year + 1, 1, 1), start, False)
        return [d for d in found if not self.months or d.month in self.months]

    def _of_month_days(self, days: list[date]) -> list[date]:
        if not self.month_days:
            return days
        return [d for d in days if d.day in self.month_days or d.day - _length(d.year, d.month) - 1 in self.month_days]

    def _skipped(self, start: date, low: date) -> int:
        """Periods that end before ``low``."""
        days = {"DAILY": 1, "WEEKLY": 7, "MONTHLY": 31, "YEARLY": 366}[self.frequency] * self.interval
        return max(0, (low - start).days // days - 1)

    def days_between(self, start: date, low: date, high: date) -> Iterator[tuple[int | None, date]]:
        """Number (from 0; None where none is kept) and day of the occurrences from ``start`` on that are in the window. The
        start itself is the first one, whether the rule names it or not."""
        seen, n = 0, 0 if self.count is not None else self._skipped(start, low)
        if n == 0:
            if low <= start <= high:
                yield 0, start
            seen = 1
        while self.count is None or seen < self.count:
            try:
                found = self._period(n, start)
                if self._begin(n, start) > high:
                    return
            except (ValueError, OverflowError):  # the calendar ends
                return
            for day in found:
                if day <= start:
                    continue
                if self.count is not None and seen >= self.count:
                    return
                if low <= day <= high:
                    yield seen if self.count is not None else None, day
                seen += 1
            n += 1

    def _begin(self, n: int, start: date) -> date:
        k = n * self.interval
        if self.frequency in ("DAILY", "WEEKLY"):
            return start + timedelta(days=k * (7 if self.frequency == "WEEKLY" else 1)) - timedelta(days=start.weekday() if self.frequency == "WEEKLY" else 0)
        year, month = divmod(start.year * 12 + start.month - 1 + k, 12) if self.frequency == "MONTHLY" else (start.year + k, 0)
        return date(year, month + 1, 1)


def local(value: str) -> tuple[datetime, bool]:
    """A time as written, and whether it is UTC; a date is its midnight."""
    plain = value.strip().upper().replace("-", "").replace(":", "")
    form = "%Y%m%dT%H%M%S" if "T" in plain else "%Y%m%d"
    return datetime.strptime(plain.rstrip("Z"), form), plain.endswith("Z")


@dataclass
class Zone:
    """A zone block: its changes as (first local time, offset in seconds, rule)."""

    changes: list[tuple[datetime, int, str]] = field(default_factory=list)

    def offset(self, at: datetime) -> int:
        """The offset of the change that came last before a local time; before all of them that of the first."""
        best = min(self.changes)[:2]
        for first, seconds, rule in self.changes:
            last = first if first <= at else None
            if rule and first <= at:
                known = Rule.read(rule)
                until = min(at.date(), local(known.until)[0].date()) if known.until else at.date()
                for _, day in known.days_between(first.date(), max(first.date(), at.date() - timedelta(days=400)), until):
                    onset = datetime.combine(day, first.time())
                    last = onset if onset <= at else last
            if last is not None and last >= best[0]:
                best = (last, seconds)
        return best[1]


@lru_cache(256)
def _named(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (ValueError, OSError, LookupError):
        return None


def to_utc(at: datetime, zone: str, blocks: dict[str, Zone]) -> datetime:
    if zone in blocks and blocks[zone].changes:
        return at - timedelta(seconds=blocks[zone].offset(at))
    known = _named(zone) if zone else None
    return at.replace(tzinfo=known).astimezone(timezone.utc).replace(tzinfo=None) if known else at


def _properties(text: str) -> Iterator[tuple[str, dict[str, str], str]]:
    """Name, parameters and value of each unfolded line."""
    for line in re.sub(r"\r?\n[ \t]", "", text).splitlines():
        m = re.match(r'([^;:]+)((?:;[^=;:]+=(?:"[^"]*"|[^;:]*))*):(.*)$', line)
        if m:
            yield m[1].upper(), {k.upper(): v.strip('"') for k, v in re.findall(r';([^=;:]+)=("[^"]*"|[^;:]*)', m[2])}, m[3]


def _seconds(offset: str) -> int:
    m = re.fullmatch(r"([+-])(\d\d)(\d\d)(\d\d)?", offset.strip())
    return (1 if m[1] == "+" else -1) * (int(m[2]) * 3600 + int(m[3]) * 60 + int(m[4] or 0))


def occurrences(text: str, low: datetime, high: datetime) -> Iterator[tuple[int, str, datetime, str | None]]:
    """Position and name of each event of a file with its occurrences in UTC from ``low`` to before ``high``, and an error in
    place of the time where an event cannot be read."""
    blocks: dict[str, Zone] = {}
    stack, zone, change, event, events = [], "", {}, None, []
    for name, parameters, value in _properties(text):
        if name == "BEGIN":
            stack.append(value.upper())
            if stack[-1] in ("STANDARD", "DAYLIGHT"):
                change = {}
            elif stack[-1] == "VEVENT":
                event = {"except": []}
        elif name == "END":
            if value.upper() in ("STANDARD", "DAYLIGHT") and {"DTSTART", "TZOFFSETTO"} <= set(change):
                blocks.setdefault(zone, Zone()).changes.append((local(change["DTSTART"])[0], _seconds(change["TZOFFSETTO"]), change.get("RRULE", "")))
            elif value.upper() == "VEVENT" and event is not None:
                events.append(event)
                event = None
            stack = stack[:-1]
        elif stack[-1:] == ["VTIMEZONE"] and name == "TZID":
            zone = value
        elif stack[-1:] in (["STANDARD"], ["DAYLIGHT"]):
            change.setdefault(name, value)
        elif stack[-1:] == ["VEVENT"] and event is not None:
            if name == "EXDATE":
                event["except"] += [(x, parameters.get("TZID", "")) for x in value.split(",")]
            elif name == "DTSTART":
                event.setdefault(name, (value, parameters.get("TZID", "")))
            else:
                event.setdefault(name, value)
    for position, event in enumerate(events):
        title = event.get("SUMMARY", "")
        try:
            value, own = event["DTSTART"]
            start, is_utc = local(value)
            utc = lambda at, z: at if is_utc else to_utc(at, z, blocks)  # noqa: E731, B023
            gone = {local(x)[0] if local(x)[1] else to_utc(local(x)[0], z or own, blocks) for x, z in event["except"]}
            whole_days = {local(x)[0].date() for x, _ in event["except"] if "T" not in x.upper()}
            rule = Rule.read(event["RRULE"]) if event.get("RRULE") else Rule("DAILY", count=1)
            until = None
            if rule.until:
                end, end_utc = local(rule.until)
                until = end + timedelta(days=1) - timedelta(seconds=1) if "T" not in rule.until else end if end_utc else utc(end, own)
            for _, day in rule.days_between(start.date(), (low - timedelta(days=2)).date(), (high + timedelta(days=2)).date()):
                at = utc(datetime.combine(day, start.time()), own)
                if until is not None and at > until:
                    break
                if low <= at < high and at not in gone and day not in whole_days:
                    yield position, title, at, None
        except (KeyError, ValueError, TypeError, OverflowError) as error:
            yield position, title, None, f"{type(error).__name__}: {error}"[:200]


def expanded(files: DataFrame, low: str, high: str, content: str = "content") -> DataFrame:
    """Occurrences of the events of calendar files from ``low`` to before ``high`` (UTC), with the other columns kept: position
    and name of the event, ``at``, and ``error`` (a row without time) for an event whose time or rule cannot be read. Files
    without events, null and empty ones give no rows."""
    keep = [c for c in files.columns if c != content]
    schema = ", ".join([*(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep), "position int, name string, at timestamp, error string"])
    first, last = datetime.fromisoformat(low), datetime.fromisoformat(high)

    def told(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
        own = batch.select(range(len(keep))).take(pa.array(rows, pa.int64()))
        position, name, at, error = zip(*found)
        times = pa.array([None if t is None else t.replace(tzinfo=timezone.utc) for t in at], pa.timestamp("us", "UTC"))
        return pa.RecordBatch.from_arrays([*own.columns, pa.array(position, pa.int32()), pa.array(name, pa.string()), times, pa.array(error, pa.string())], names=[*keep, "position", "name", "at", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                for one in occurrences(text or "", first, last):
                    rows.append(i)
                    found.append(one)
                    if len(rows) == AT_ONCE:
                        yield told(batch, rows, found)
                        rows, found = [], []
            if rows:
                yield told(batch, rows, found)

    return spread(files.select(*[f"`{c}`" for c in keep], f"`{content}`")).mapInArrow(run, schema)
