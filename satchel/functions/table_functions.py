"""Parsers of calendar files and contact cards as table functions for SQL: ``SELECT t.* FROM files, LATERAL parse_vcf(content) t``."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="name string, start string, location string")
class ParseIcs:
    """Events with their summary, start as written, and location; a file with an event that lacks one of the first two
    gives no rows."""

    def eval(self, content: str):
        text = re.sub(r"\r?\n[ \t]", "", content or "")
        rows = []
        for block in re.findall(r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT", text):
            found = {}
            for line in re.split(r"\r?\n", block):
                m = re.match(r'([^;:]+)[^:"]*(?:"[^"]*"[^:"]*)*:(.*)$', line)
                if m:
                    found.setdefault(m[1].upper(), m[2])
            rows.append((found.get("SUMMARY"), found.get("DTSTART"), found.get("LOCATION")))
        if all(name is not None and start is not None for name, start, _ in rows):
            yield from rows


@udtf(returnType="name string, email string, phone string, organization string")
class ParseVcf:
    """Contacts; the last line of a kind counts, and a file with a card without FN gives no rows."""

    def eval(self, content: str):
        rows = []
        for card in (content or "").split("BEGIN:VCARD")[1:]:
            found = {}
            for line in map(str.strip, card.splitlines()):
                for kind in ("FN:", "ORG:"):
                    if line.startswith(kind):
                        found[kind] = line[len(kind) :]
                for kind in ("EMAIL", "TEL"):
                    if line.startswith(kind) and ":" in line:
                        found[kind] = line.split(":")[1]
            rows.append(tuple(found.get(k) for k in ("FN:", "EMAIL", "TEL", "ORG:")))
        if all(name is not None for name, *_ in rows):
            yield from rows


def register(spark: SparkSession) -> None:
    spark.udtf.register("parse_ics", ParseIcs)
    spark.udtf.register("parse_vcf", ParseVcf)
