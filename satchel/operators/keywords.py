"""Words and phrases in texts with their byte offsets, by one automaton over all of them and one pass over each text.

The automaton is built in each task from the words, which are a fixed list; it is never larger than they are. Patterns are
located with it: their context words are looked up among the hits around a match instead of being searched again for each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from satchel.operators.patterns import CONTEXT, PATTERNS, Pattern

try:
    import ahocorasick
except ImportError:  # each word is looked for by itself then, with the same hits
    ahocorasick = None


def lowered(text: str) -> str:
    """Lower case with every letter in its place: letters whose small form is longer stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Words:
    """Finds words in any case. A hit is (start, word number), in code points."""

    def __init__(self, words: tuple[str, ...]):
        self.words = tuple(dict.fromkeys(lowered(w) for w in words if w))
        self.number = {w: i for i, w in enumerate(self.words)}
        self.automaton = None
        if ahocorasick is not None and self.words:
            self.automaton = ahocorasick.Automaton()
            for w, i in self.number.items():
                self.automaton.add_word(w, i)
            self.automaton.make_automaton()

    def hits(self, low: str) -> list[tuple[int, int]]:
        """All hits in a lowered text, by start, then word; words may overlap."""
        if self.automaton is not None:
            return sorted((end + 1 - len(self.words[i]), i) for end, i in self.automaton.iter(low))
        return sorted((m.start(), i) for i, w in enumerate(self.words) for m in re.finditer(f"(?={re.escape(w)})", low))


class Offsets:
    """Byte offsets of code points of a text."""

    def __init__(self, text: str):
        self.text, self.ascii = text, text.isascii()
        self.at, self.bytes = 0, 0

    def __call__(self, i: int) -> int:
        if self.ascii:
            return i
        if i < self.at:
            self.at, self.bytes = 0, 0
        self.bytes += len(self.text[self.at : i].encode())
        self.at = i
        return self.bytes


def spans(messages: DataFrame, words: tuple[str, ...], text: str = "text") -> DataFrame:
    """A row for each place of each word in each text, in any case, overlapping ones too: ``word`` (in lower case), ``start`` and
    ``stop`` (bytes, its end excluded), with the other columns kept. Null texts have none."""
    keep = [c for c in messages.columns if c != text]
    schema = ", ".join([*(f"`{c}` {messages.schema[c].dataType.simpleString()}" for c in keep), "word string, start long, stop long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Words(words)
        for batch in batches:
            rows, names, starts, stops = [], [], [], []
            for i, t in enumerate(batch.column(len(keep)).to_pylist()):
                at = Offsets(t or "")
                for start, w in found.hits(lowered(t or "")):
                    rows.append(i)
                    names.append(found.words[w])
                    starts.append(at(start))
                    stops.append(starts[-1] + len(at.text[start : start + len(found.words[w])].encode()))
            own = batch.select(range(len(keep))).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], names=[*keep, "word", "start", "stop"])

    return messages.select(*[f"`{c}`" for c in keep], f"`{text}`").mapInArrow(run, schema)


class Located:
    """Patterns over one automaton of all their words."""

    def __init__(self, patterns: tuple[Pattern, ...]):
        self.patterns = patterns
        self.words = Words(tuple(w for p in patterns for w in (*p.keywords, *p.near, *p.never)))
        self.regexes = [re.compile(p.regex) if p.regex else None for p in patterns]

    def _fits(self, p: Pattern, places: dict[str, list[int]], start: int, stop: int) -> bool:
        """Whether the words within CONTEXT around a match fit; a word counts if it lies wholly inside."""

        def inside(w: str) -> bool:
            own = places.get(lowered(w), ())
            i = bisect_left(own, start - CONTEXT)
            return i < len(own) and own[i] + len(w) <= stop + CONTEXT

        return (not p.near or any(map(inside, p.near))) and not any(map(inside, p.never))

    def find(self, text: str) -> Iterator[tuple[Pattern, str, int, int]]:
        """The first fitting match of each pattern: value, start and stop in code points."""
        places: dict[str, list[int]] = {}
        for start, w in self.words.hits(lowered(text)):
            places.setdefault(self.words.words[w], []).append(start)
        for p, regex in zip(self.patterns, self.regexes):
            if regex is None:
                for k in p.keywords:
                    own = places.get(lowered(k))
                    if own and self._fits(p, places, own[0], own[0] + len(k)):
                        yield p, k, own[0], own[0] + len(k)
                        break
            elif not p.keywords or any(lowered(k) in places for k in p.keywords):
                for m in regex.finditer(text):
                    if self._fits(p, places, *m.span()):
                        yield p, m[p.group].strip(" "), *m.span()
                        break


def located(messages: DataFrame, text: str = "text", patterns: tuple[Pattern, ...] = PATTERNS, entities: tuple[str, ...] = (), min_confidence: float = 0.0, max_results: int | None = None) -> DataFrame:
    """What patterns.matches() finds, with where it is: ``start`` and ``stop`` of the whole match in bytes, and ``evidence``,
    the words around it.

    ``entities`` names the kinds that are wanted (all by default); ``max_results`` bounds the rows of a message, in the order
    of the patterns. Letters of two cases are told apart as Python does."""
    wanted = tuple(p for p in patterns if p.confidence >= min_confidence and (not entities or p.entity in entities))
    keep = [c for c in messages.columns if c != text]
    names = {"pattern": pa.string(), "entity": pa.string(), "value": pa.string(), "confidence": pa.float64(), "requires_review": pa.bool_(), "start": pa.int64(), "stop": pa.int64(), "evidence": pa.string()}
    schema = ", ".join([*(f"`{c}` {messages.schema[c].dataType.simpleString()}" for c in keep), "pattern string, entity string, value string, confidence double, requires_review boolean, start long, stop long, evidence string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Located(wanted)
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column(len(keep)).to_pylist()):
                at = Offsets(t or "")
                for n, (p, value, start, stop) in enumerate(own.find(t or "")):
                    if max_results is None or n < max_results:
                        rows.append(i)
                        out.append((p.name, p.entity, value, p.confidence, p.confidence < 0.8, at(start), at(stop), t[max(0, start - CONTEXT) : stop + CONTEXT]))
            taken = batch.select(range(len(keep))).take(pa.array(rows, pa.int64()))
            columns = zip(zip(*out), names.values()) if out else (((), kind) for kind in names.values())
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(c, kind) for c, kind in columns)], names=[*keep, *names])

    return messages.select(*[f"`{c}`" for c in keep], f"`{text}`").mapInArrow(run, schema)
