"""Entities for the names in texts: projects, contacts and places that a mention may mean, by similar names.

Names are compared as sets of their three-letter pieces (Jaccard). Candidates meet in the rarest pieces of a name only: two
names of similarity t or more share one of their first n - ceil(t * n) + 1 pieces, in order of rarity, so that no pair of all
names is looked at and none is lost. Equal names are one name from the start, however many mentions and entities bear it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.session import spread

#: Names of this similarity or more are candidates; a mention is linked by itself from AUTO_LINK on, if no other name comes
#: within MARGIN of the best.
CANDIDATE, AUTO_LINK, MARGIN = 0.5, 0.7, 0.05
#: Words of 64 bits in which a name's pieces are noted by their hash.
SIGNATURE = 4
#: Names that have a piece, up to which pairs that meet in it are rows of a join; rows of a block where there are more; pairs and
#: cells of pairs' pieces that are compared together.
RARE, BLOCK, PAIRS, CELLS = 512, 1 << 15, 1 << 19, 1 << 22


def normalised(name: Column) -> Column:
    """Lower case, with single spaces for all that is neither letter nor digit."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def pieces(name: Column) -> Column:
    """Distinct three-letter pieces of a normalised name between spaces; of an empty name none."""
    padded = F.concat(F.lit("  "), name, F.lit(" "))
    return F.when(F.length(name) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of pieces."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _coded(piece: Column) -> Column:
    """A piece's three code points as one number."""
    points = (F.call_function("shiftleft", F.ascii(F.substring(piece, i, 1)).cast("long"), F.lit(21 * (3 - i))) for i in (1, 2, 3))
    return sum(points, F.lit(0))


def _ranked(names: DataFrame, frequency: DataFrame) -> DataFrame:
    """Names with the codes of their pieces (n, piece), rarest first, and their SIGNATURE. A name has as many as letters."""
    each = names.withColumn("piece", F.explode("pieces")).drop("pieces").join(frequency, "piece").withColumn("h", F.pmod(F.xxhash64("piece"), F.lit(64 * SIGNATURE)).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("h") % 64))
    words = (F.bit_or(F.when((F.col("h") / 64).cast("int") == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"bits{w}") for w in range(SIGNATURE))
    kept = (F.any_value(c).alias(c) for c in names.columns if c not in ("name", "pieces"))
    return each.groupBy("name").agg(*kept, F.sort_array(F.collect_list(F.struct("n", F.col("code").alias("piece")))).alias("pieces"), *words)


def _prefixes(ranked: DataFrame, least: float, prefix: str) -> DataFrame:
    n = F.size("pieces")
    first = n - F.ceil(n * least - 1e-9).cast("int") + 1
    own = [F.col(c).alias(f"{prefix}_{c}") for c in ranked.columns if c != "pieces"]
    codes = F.col("pieces.piece").alias(f"{prefix}_pieces")
    return ranked.select(*own, codes, n.alias(f"{prefix}_size"), F.posexplode(F.slice("pieces", F.lit(1), first)).alias(f"{prefix}_at", "p")).select("*", "p.*").drop("p")


def _may_be_similar(least: float) -> Column:
    """Whether two names that met in a piece can still reach ``least``: pieces after the one they met in, if it is their first,
    and bits of one signature that the other lacks, of which each stands for a piece at least that the other lacks."""
    sizes = {p: F.col(f"{p}_size") for p in ("mention", "entity")}
    common = (sizes["mention"] + sizes["entity"]) * ((least - 1e-6) / (1 + least))
    after = F.least(*(n - F.col(f"{p}_at") for p, n in sizes.items()))
    lacks = lambda p, q: sum(F.bit_count(F.col(f"{p}_bits{w}").bitwiseAND(F.bitwise_not(f"{q}_bits{w}"))) for w in range(SIGNATURE))
    return (after >= common) & (lacks("mention", "entity") <= sizes["mention"] - common) & (lacks("entity", "mention") <= sizes["entity"] - common)


class _Side:
    """Rows of one side of a block as arrays, by size: pieces are one after the other, ``at`` is the place of the common one."""

    def __init__(self, rows: pa.Table, prefix: str):
        rows = rows.sort_by(f"{prefix}_size").combine_chunks()
        self.rows = rows
        self.size, self.at = (rows.column(f"{prefix}_{c}").to_numpy().astype(np.int64) for c in ("size", "at"))
        self.bits = [rows.column(f"{prefix}_bits{w}").to_numpy().view(np.uint64) for w in range(SIGNATURE)]
        self.noted = sum(np.bitwise_count(b).astype(np.int64) for b in self.bits)
        self.pieces = rows.column(f"{prefix}_pieces").combine_chunks().flatten().to_numpy()
        self.start = np.cumsum(self.size) - self.size

    def padded(self, which: np.ndarray, fill: int) -> np.ndarray:
        """Pieces of some rows, filled up to the longest."""
        place = np.arange(int(self.size[which].max()))
        inside = place < self.size[which, None]
        return np.where(inside, self.pieces[np.where(inside, self.start[which, None] + place, 0)], fill)


def _met(a: _Side, b: _Side, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of both sides that may be similar, as _may_be_similar() has it: mentions of one size and place at a time."""
    after = b.size - b.at
    kinds, kind = np.unique(np.stack((a.size, a.at)), axis=1, return_inverse=True)
    members = np.split(np.argsort(kind, kind="stable"), np.cumsum(np.bincount(kind))[:-1])
    for (size, at), own in zip(kinds.T.tolist(), members):
        common = np.ceil((size + b.size) * ((least - 1e-6) / (1 + least))).astype(np.int64)
        others = np.flatnonzero(np.minimum(after, size - at) >= common)
        if not len(others):
            continue
        noted, common = (b.noted - b.size + common)[others].astype(np.int16), common[others].astype(np.int16)
        bits = [x[others] for x in b.bits]
        step = max(1, PAIRS // len(others))
        for lo in range(0, len(own), step):
            some = own[lo : lo + step]
            shared = np.zeros((len(some), len(others)), np.int16)
            for x, y in zip(a.bits, bits):
                shared += np.bitwise_count(x[some, None] & y)
            rows, columns = np.nonzero((shared >= noted) & (shared >= (a.noted[some] - size).astype(np.int16)[:, None] + common))
            yield some[rows], others[columns]


def _compared(least: float):
    """Pairs of a block of mentions and one of entities that share a frequent piece: those for which it is the rarest that both
    have, so that a pair comes once, and that reach ``least``."""

    def run(mentions: pa.Table, entities: pa.Table) -> pa.Table:
        a, b = _Side(mentions, "mention"), _Side(entities, "entity")
        found = []
        for rows, others in _met(a, b, least):
            step = max(1, CELLS // int(a.size[rows].max(initial=1) * b.size[others].max(initial=1)))
            for lo in range(0, len(rows), step):
                i, j = rows[lo : lo + step], others[lo : lo + step]
                same = a.padded(i, -1)[:, :, None] == b.padded(j, -2)[:, None, :]
                common = same.sum(axis=(1, 2))
                score = common / (a.size[i] + b.size[j] - common)
                own = np.flatnonzero((same.any(axis=2).argmax(axis=1) == a.at[i]) & (score >= least - 1e-9))
                found.append((i[own], j[own], score[own]))
        i, j, score = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        own = ["mention_name", *(c for c in entities.column_names if c.startswith("entity_") and not c.startswith("entity_bits") and c not in ("entity_pieces", "entity_size", "entity_at"))]
        columns = [a.rows.column("mention_name").take(pa.array(i)), *(b.rows.column(c).take(pa.array(j)) for c in own[1:])]
        return pa.table([*columns, pa.array(score, pa.float64())], names=[*own, "score"])

    return run


def _by_blocks(a: DataFrame, b: DataFrame, least: float, schema: str) -> DataFrame:
    """Pairs that meet in pieces of over RARE names: both sides of a piece are cut into blocks of about BLOCK rows, and each block
    of one side meets each of the other in its own group, which is compared as arrays."""
    counts = a.groupBy("piece").agg(F.count("*").alias("mentions")).join(b.groupBy("piece").agg(F.count("*").alias("entities")), "piece")
    blocks = F.broadcast(counts.select("piece", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("mentions", "entities"))))

    def dealt(rows: DataFrame, prefix: str, own: str, other: str) -> DataFrame:
        placed = rows.join(blocks, "piece").withColumn(own, F.pmod(F.xxhash64(f"{prefix}_name"), F.col(own)).cast("int"))
        group = ("piece", "mentions", "entities")
        copied = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        # a number of tasks by the cores: groups are small in bytes, but dear
        return copied.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, *group).groupBy(*group)

    return dealt(a, "mention", "mentions", "entities").cogroup(dealt(b, "entity", "entities", "mentions")).applyInArrow(_compared(least), schema)


def similar_names(mentions: DataFrame, entities: DataFrame, least: float = CANDIDATE) -> DataFrame:
    """``mention_name``, ``entity_name`` and ``score`` of all pairs of similarity ``least`` or more of two tables of distinct
    normalised names (name); other columns of the entities are kept, with entity_ before their names.

    Pairs that meet are told apart by position and signature; pieces are compared once for each pair that is left. The order of
    pieces is by their frequency, so that pairs which meet in a rare piece need not be looked at in frequent ones."""
    others = [c for c in entities.columns if c != "name"]
    own = [spread(x).withColumn("pieces", pieces(F.col("name"))) for x in (mentions.select("name"), entities)]
    frequency = own[0].select("pieces").unionByName(own[1].select("pieces")).select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count("*").alias("n")).withColumn("code", _coded(F.col("piece")))
    a, b = (_prefixes(_ranked(x, frequency), least, p) for x, p in zip(own, ("mention", "entity")))
    rare = a.where(F.col("n") <= RARE).join(b.where(F.col("n") <= RARE).drop("n"), "piece").where(_may_be_similar(least))
    met = rare.select("mention_name", "entity_name").distinct()
    # pieces come from the names again: made of the columns of the pair, the score would be a condition of the join above
    for x, p in zip(own, ("mention", "entity")):
        met = met.join(x.select(*(F.col(c).alias(f"{p}_{c}") for c in x.columns)), f"{p}_name")
    kept = ["mention_name", "entity_name", *(f"entity_{c}" for c in others)]
    scored = met.select(*kept, similarity(F.col("mention_pieces"), F.col("entity_pieces")).alias("score")).where(F.col("score") >= least - 1e-9)
    schema = ", ".join(f"`{c}` {scored.schema[c].dataType.simpleString()}" for c in scored.columns)
    return scored.unionByName(_by_blocks(*(x.where(F.col("n") > RARE).drop("n") for x in (a, b)), least, schema))


def resolved(mentions: DataFrame, entities: DataFrame, least: float = CANDIDATE, auto_link: float = AUTO_LINK, margin: float = MARGIN) -> DataFrame:
    """Each mention (id, name) with what it may mean among ``entities`` (id, name): ``linked_id``, ``score`` of the best name,
    ``requires_review``, and ``candidates``, best first: entity_id (the least of that name), name, score, entities (how many
    bear the name).

    A mention is linked if its best name reaches ``auto_link``, one entity alone bears it, and no other name is within
    ``margin``. Mentions without name or candidate have none and need review. Repeated mentions get a row each."""
    named = entities.select("id", normalised(F.col("name")).alias("name")).where("name <> ''").groupBy("name").agg(F.min("id").alias("entity_id"), F.count_distinct("id").alias("entities"))
    own = mentions.withColumn("__name", normalised(F.col("name")))
    wanted = own.where("__name <> ''").select(F.col("__name").alias("name")).distinct()
    pairs = similar_names(wanted, named.select("name", F.col("entity_id").alias("id"), F.col("entities").alias("bearers")), least).withColumnRenamed("entity_bearers", "entities")
    listed = pairs.groupBy("mention_name").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "entity_id", F.col("entity_name").alias("name"), "score", "entities"))).alias("found"))
    best, second = F.get("found", 0), F.get("found", 1)
    sure = (best["score"] >= auto_link - 1e-9) & (best["entities"] == 1) & F.coalesce(best["score"] - second["score"] > margin, F.lit(True))
    told = listed.select(F.col("mention_name").alias("__name"), F.when(sure, best["entity_id"]).alias("linked_id"), best["score"].alias("score"), F.transform("found", lambda x: F.struct(*(x[c].alias(c) for c in ("entity_id", "name", "score", "entities")))).alias("candidates"))
    none = F.array().cast(told.schema["candidates"].dataType)
    return own.join(told, "__name", "left").select(*mentions.columns, "linked_id", "score", F.col("linked_id").isNull().alias("requires_review"), F.coalesce("candidates", none).alias("candidates"))
