"""CSV and JSON files, cloud-style file listings, and schema export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.schemas import TABLES, schema


def import_csv(spark: SparkSession, path: str, table: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """A CSV with header as rows of a table; ``mapping`` renames its columns. Values that do not fit are null."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.withColumnsRenamed(mapping or {})
    return raw.select(*((F.col(f.name) if f.name in raw.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema(table)))


def export(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Rows as CSV with header, JSON lines or Parquet, one file a partition."""
    writer = rows.write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()


def listed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder: path, modificationTime, length, content; content is read only if it is selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def wanted(name: Column, size: Column, extensions: tuple[str, ...] = (), pattern: str | None = None, least: int | None = None, most: int | None = None) -> Column:
    """Filter of files by lower-case extension, pattern and size; absent parts do not filter."""
    out = F.lit(True)
    if extensions:
        out &= F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1)).isin(*extensions)
    if pattern is not None:
        out &= F.regexp_like(name, F.lit(pattern))
    if least is not None:
        out &= size >= least
    if most is not None:
        out &= size <= most
    return out


def exported_schemas() -> dict[str, str]:
    """Every table's schema as JSON, for clients."""
    return {t: schema(t).json() for t in TABLES}
