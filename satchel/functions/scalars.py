"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from satchel.schemas import ADDRESSES, DOMAINS


def masked(c: Column) -> Column:
    """Up to six characters as they are; else the first six and a star for each other, cut to 37 and dots beyond 40."""
    full = F.concat(F.substring(c, 1, 6), F.repeat(F.lit("*"), F.length(c) - 6))
    return F.when(F.length(c) <= 6, c).when(F.length(full) > 40, F.concat(F.substring(full, 1, 37), F.lit("..."))).otherwise(full)


def decoded(c: Column, domain: str, default: str) -> Column:
    """An enum value in lower case with hyphens; unknown text gives the default. ``onedrive`` is read as ``one-drive``."""
    value = F.replace(F.lower(c), F.lit("_"), F.lit("-"))
    value = F.when(value == "onedrive", F.lit("one-drive")).otherwise(value)
    return F.when(value.isin(*DOMAINS[domain]), value).otherwise(F.lit(default))


def addresses(c: Column) -> Column:
    """JSON text as an array of addresses; null and broken JSON give the empty array, entries without address go."""
    return F.filter(F.coalesce(F.from_json(c, ADDRESSES), F.array().cast(ADDRESSES)), lambda a: a["email"].isNotNull())


def percent(done: Column, total: Column) -> Column:
    """Share in percent in single precision; zero without a total."""
    share = (done.cast("float") / total.cast("float")).cast("float")
    return F.when(total > 0, (share * F.lit(100).cast("float")).cast("float")).otherwise(F.lit(0).cast("float"))


def remaining(total: Column, *parts: Column) -> Column:
    """What is left, never below zero."""
    left = total
    for part in parts:
        left = left - part
    return F.greatest(left, F.lit(0))


def credential_identifier(kind: str, user: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.replace(user, F.lit("@"), F.lit("_at_")))


def search_cutoff(as_of: str, months: int | None) -> Column:
    """First day of a mailbox search, a month counting 30 days; no months, no bound."""
    return F.lit(None).cast("date") if months is None else F.date_sub(F.lit(as_of).cast("date"), 30 * months)


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """``{key}`` replaced by values, keys in alphabetical order."""
    for key in sorted(values):
        template = F.replace(template, F.lit("{" + key + "}"), F.coalesce(values[key].cast("string"), F.lit("")))
    return template
