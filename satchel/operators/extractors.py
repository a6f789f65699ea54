"""The extractors by name, run over one batch of messages into one table of typed results.

An extractor is a function from messages, or from their attachments, to rows; which ones run, in what order, and when the
dearer ones are asked at all, is data. Each message goes to the extractors of the next cost only if none before was sure.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.operators import mime
from satchel.operators.keywords import located
from satchel.operators.patterns import message_text, needs_model

VERSION = "1"
RESULTS = ("extractor", "method", "version", "data_type", "value", "confidence", "requires_review")


@dataclass(frozen=True)
class Extractor:
    """``run`` takes messages (key, subject, body_text, raw) and gives key, data_type, value (JSON), confidence, requires_review."""

    name: str
    method: str
    cost: int
    run: Callable[[DataFrame, str], DataFrame]


def _attachments(messages: DataFrame, key: str) -> DataFrame:
    found = mime.entities(mime.parts(messages, (key,)), (key,))
    return found.select(key, "data_type", F.coalesce(F.to_json("event"), F.to_json("contact")).alias("value"), F.col("confidence").cast("double").alias("confidence"), "requires_review")


def _patterns(messages: DataFrame, key: str) -> DataFrame:
    found = located(messages.select(key, message_text(F.col("subject"), F.col("body_text")).alias("text")))
    return found.select(key, F.col("entity").alias("data_type"), F.to_json(F.struct("pattern", "value", "start", "stop")).alias("value"), "confidence", "requires_review")


REGISTRY: dict[str, Extractor] = {}


def register(extractor: Extractor) -> None:
    """Adds an extractor, or replaces the one of its name."""
    REGISTRY[extractor.name] = extractor


register(Extractor("attachments", "attachment-parsing", 0, _attachments))
register(Extractor("patterns", "pattern-based", 1, _patterns))


def extract(messages: DataFrame, key: str, names: tuple[str, ...] | None = None, enough: float | None = None, least: float = 0.0) -> DataFrame:
    """Results of the named extractors (all by default): ``key`` and RESULTS. With ``enough``, messages for which an extractor
    of lower cost was so sure go no further. ``least`` is the least confidence of a result."""
    unknown = set(names or ()) - set(REGISTRY)
    if unknown:
        raise ValueError(f"no such extractor: {', '.join(sorted(unknown))}")
    chosen = sorted((REGISTRY[n] for n in names or REGISTRY), key=lambda e: (e.cost, e.name))
    out: list[DataFrame] = []
    for cost in sorted({e.cost for e in chosen}):
        left = messages if enough is None or not out else needs_model(messages, reduce(DataFrame.unionByName, out), key, enough)
        for e in (e for e in chosen if e.cost == cost):
            told = e.run(left, key).withColumns({"extractor": F.lit(e.name), "method": F.lit(e.method), "version": F.lit(VERSION)})
            out.append(told.select(key, *RESULTS))
    return reduce(DataFrame.unionByName, out).where(F.col("confidence") >= least)
