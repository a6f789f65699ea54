"""Quality rules with robust multivariate outliers.

Each whole text gets counts; texts that pass the base rule give a vector of transformed statistics: the logarithm of the
mean word length, and the square roots of the shares of symbols, repeated lines and repeated words. As most texts have none
of these, a fraction between 0 and 1, drawn from a hash of the text's counts, is added to each count: a count stands for the
interval up to the next one, and the statistics have a scatter that can be estimated. For each language and source the
minimum-covariance-determinant estimate of location and scatter is found by concentration steps: the share ``SUPPORT`` of
rows nearest to the current estimate gives the next one. A step is one aggregation over all rows: rows are binned by their
distance, each bin sums counts and moments, and the least bins that hold the share make the new estimate, so that a task
never holds a group and the outcome does not depend on the order of rows. A row is rejected by its squared Mahalanobis
distance. Statistics of texts have heavy tails, so that the cutoff is not that of normal data: it is what a share ``TAIL`` of
an elliptical t distribution with two degrees of freedom exceeds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.llm.split_join import without_keys
from satchel.llm.store import materialize

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50
SUPPORT = 0.75
TAIL = 0.01
STEPS = 8
#: Groups with fewer rows use their language's rows, or all rows if those are few too.
MIN_GROUP = 50
#: Least standard deviation of a statistic, where the rows of a group agree wholly.
FLOOR = 1e-3
#: Pools whose estimates are broadcast, about 200 bytes each; with more, rows and estimates meet in a salted join.
BROADCAST_POOLS = 50_000
SALTS = 32
#: Bins of the logarithm of squared distances.
BINS = 4096
STATISTICS = ("word_length", "symbols", "duplicate_lines", "repeated_words")
PAIRS = [(i, j) for i in range(len(STATISTICS)) for j in range(i, len(STATISTICS))]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counts(text: str) -> tuple[int, ...]:
    """COUNTS of one whole text; see rules()."""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.translate(None, SPACES)]
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        often, covered = Counter(triples), 0
        for i, triple in enumerate(triples):
            if often[triple] > 1:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def row_identity(key: str, text: str, by: tuple[str, str]) -> Column:
    """The key, which may be null or repeated, and a hash of all that a row is judged by: rows that agree in both are judged alike."""
    return F.struct(F.col(key), F.xxhash64(F.coalesce(F.col(text), F.lit("")), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by)))


def with_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(counts(t.as_py() or "") for t in batch.column("text")))) or [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(c, pa.int64()) for c in columns)], names=[key, "lang", "source", *COUNTS])

    rows = docs.select(F.col(key), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(by, ("lang", "source"))), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def chi_square_quantile(tail: float, dimensions: int) -> float:
    """The value that a chi-square variable of an even number of degrees exceeds with probability ``tail``."""

    def over(x: float) -> float:
        return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dimensions // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if over(middle) > tail else (low, middle)
    return high


def cutoff(tail: float, dimensions: int) -> float:
    """The squared distance that a share ``tail`` of a t distribution with two degrees of freedom exceeds. Divided by the
    dimensions it has an F distribution, whose distribution function is a power where there are two degrees of freedom."""
    share = (1 - tail) ** (2 / dimensions)
    return 2 * share / (1 - share)


def consistency(support: float, dimensions: int) -> float:
    """The factor that makes the scatter of the nearest rows that of all rows, for normal data."""
    cut = chi_square_quantile(1 - support, dimensions)
    low, high = 0.0, 1.0
    for _ in range(60):  # share of a chi-square with two more degrees below the same cut
        middle = (low + high) / 2
        low, high = (low, middle) if chi_square_quantile(1 - middle, dimensions + 2) > cut else (middle, high)
    return support / high


def _distance(prefix: str = "") -> Column:
    gap = [F.col(s) - F.col(f"m{i}") for i, s in enumerate(STATISTICS)]
    return sum((F.lit(1.0 if i == j else 2.0) * F.col(f"p{i}{j}") * gap[i] * gap[j] for i, j in PAIRS), F.lit(0.0))


ESTIMATE = "pool string, " + ", ".join(f"m{i} double" for i in range(len(STATISTICS))) + ", " + ", ".join(f"p{i}{j} double" for i, j in PAIRS)


def _estimate(pool: str, mean: np.ndarray, scatter: np.ndarray) -> dict:
    precision = np.linalg.inv(scatter + FLOOR**2 * np.eye(len(scatter)))
    return {"pool": pool, **{f"m{i}": round(float(m), 9) for i, m in enumerate(mean)}, **{f"p{i}{j}": float(f"{precision[i, j]:.9g}") for i, j in PAIRS}}


def _concentrated(support: float):
    factor = consistency(support, len(STATISTICS))

    def step(bins: pd.DataFrame) -> pd.DataFrame:
        """The next estimate from a group's bins, of which there are BINS at most."""
        bins = bins.sort_values("bin")
        upto = bins["n"].cumsum()
        used = bins[upto.shift(fill_value=0) < support * bins["n"].sum()]
        n = used["n"].sum()
        mean = np.array([used[f"s{i}"].sum() / n for i in range(len(STATISTICS))])
        scatter = np.zeros((len(STATISTICS),) * 2)
        for i, j in PAIRS:
            scatter[i, j] = scatter[j, i] = used[f"q{i}{j}"].sum() / n - mean[i] * mean[j]
        values, vectors = np.linalg.eigh(scatter)
        scatter = vectors @ np.diag(np.maximum(values, 0)) @ vectors.T
        return pd.DataFrame([_estimate(bins["pool"].iloc[0], mean, factor * scatter)])

    return step


def _first(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in rows:
        out = [_estimate(r.pool, np.array(r.middle), np.diag(np.square(1.4826 * np.array(r.spread)))) for r in batch.itertuples()]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ESTIMATE.split(", ")])


def with_pool(rows: DataFrame, pools: DataFrame, n: int) -> DataFrame:
    """``rows`` with the columns of their ``pool`` among ``n``, null where it has none; a pool of any size is spread over tasks."""
    if n <= BROADCAST_POOLS:
        return rows.join(F.broadcast(pools), "pool", "left")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols"), F.lit(SALTS)))
    copies = pools.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["pool", "__salt"], "left").drop("__salt")


def with_statistics(found: DataFrame) -> DataFrame:
    """Rows of with_counts() with STATISTICS."""
    words, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines"))

    def share(count: str, of: Column) -> Column:
        part = F.pmod(F.xxhash64(F.lit(count), *COUNTS), F.lit(1 << 20)) / F.lit(float(1 << 20))
        return F.sqrt((F.col(count) + part) / (of + 1))

    return found.withColumns({"word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), "symbols": share("n_symbols", words), "duplicate_lines": share("n_dup_lines", lines), "repeated_words": share("n_repeat_words", words)})


def estimates(vectors: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """The estimate of each ``pool`` of vectors: means m0.. and the precision matrix p00... The first is made of medians
    and median absolute deviations."""
    n = vectors.select("pool").distinct().count()
    middle = vectors.groupBy("pool").agg(*(F.percentile_approx(s, 0.5, 10000).alias(f"c{i}") for i, s in enumerate(STATISTICS)))
    spread = with_pool(vectors, materialize(middle, "medians"), n).groupBy("pool").agg(F.array(*(F.first(f"c{i}") for i in range(len(STATISTICS)))).alias("middle"), F.array(*(F.percentile_approx(F.abs(F.col(s) - F.col(f"c{i}")), 0.5, 10000) for i, s in enumerate(STATISTICS))).alias("spread"))
    now = materialize(spread.mapInPandas(_first, ESTIMATE), "estimates")
    log = F.log2(F.greatest(F.col("d"), F.lit(2.0**-32)))
    for _ in range(steps):
        binned = with_pool(vectors, now, n).withColumn("d", _distance()).withColumn("bin", F.least(F.greatest(F.floor((log + 32) * 64), F.lit(0)), F.lit(BINS - 1)))
        sums = binned.groupBy("pool", "bin").agg(F.count("*").alias("n"), *(F.sum(s).alias(f"s{i}") for i, s in enumerate(STATISTICS)), *(F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"q{i}{j}") for i, j in PAIRS))
        now = materialize(sums.groupBy("pool").applyInPandas(_concentrated(support), ESTIMATE), "estimates")
    return now


def rules(docs: DataFrame, key: str = "doc_id", text: str = "text", by: tuple[str, str] = ("lang", "source"), support: float = SUPPORT, tail: float = TAIL) -> DataFrame:
    """``key``, COUNTS, ``base_failed``, ``distance`` (squared; null if the base rule failed) and ``kept`` of each row.

    Words are runs of anything but space and the controls 9 to 13. word_chars: their code points. n_symbols: characters of
    #*$%&|<>. n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words in three-word windows that
    come twice or more in the text. Base rule: under 50 words, or over half the words repeated. Null texts are empty and
    fail it. Null languages and sources make a group of their own. Groups of fewer than MIN_GROUP rows are pooled with
    their language, then with all that are left; if these are fewer than MIN_GROUP too, they are kept. No rows give no rows; repeated rows each get the same verdict.
    """
    found = materialize(with_counts(docs, key, text, by), "counts")
    found = found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    found = with_statistics(found)
    vectors = found.where("not base_failed")
    sizes = vectors.groupBy("lang", "source").agg(F.count("*").alias("n"))
    of_lang = sizes.where(F.col("n") < MIN_GROUP).groupBy("lang").agg(F.sum("n").alias("in_lang"))
    own = F.to_json(F.struct("lang", "source"))
    pools = sizes.join(of_lang, "lang", "left").select(own.alias("own"), F.when(F.col("n") >= MIN_GROUP, own).when(F.col("in_lang") >= MIN_GROUP, F.to_json(F.struct("lang"))).otherwise(F.lit("all")).alias("of"), "n")
    pools = materialize(pools, "pools")
    few = (pools.where("of = 'all'").agg(F.sum("n")).first()[0] or 0) < MIN_GROUP
    n, pools = pools.count(), pools.drop("n")
    pooled = lambda rows: with_pool(rows.withColumn("pool", own), pools.withColumnRenamed("own", "pool"), n).drop("pool").withColumnRenamed("of", "pool")
    now = estimates(pooled(vectors).where("pool <> 'all'") if few else pooled(vectors), support)
    # the statistics are cheap to derive, so verdicts come from one pass over the counts, without a join by key
    judged = with_pool(pooled(found), now, n)
    distance = F.when(~F.col("base_failed"), _distance())
    return judged.select(key, *COUNTS, "base_failed", distance.alias("distance"), (~F.col("base_failed") & F.coalesce(distance <= cutoff(tail, len(STATISTICS)), F.lit(True))).alias("kept"))


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``docs`` without the rows that rules() rejects. Each row goes or stays by its own text, language and source, also where
    keys are null or repeated."""
    named = docs.withColumn("__row", row_identity(key, text, by))
    rejected = rules(named, "__row", text, by).where("not kept").select("__row").distinct()
    return without_keys(named, "__row", materialize(rejected, "rejected")).drop("__row")
