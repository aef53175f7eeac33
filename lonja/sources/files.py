"""File sources and sinks: typed CSV, memory files, atomic partition replacement, export with a byte-order mark."""

from __future__ import annotations

import glob
import os
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from lonja.session import delete_path


def read_csv(spark: SparkSession, path: str, floats: set[str], ints: set[str]) -> DataFrame:
    """CSV with a header, whose first name may carry a byte-order mark; named columns typed, what does not parse is null."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    num = lambda c: F.replace(F.col(c), F.lit(","), F.lit("."))
    return df.select(*[num(c).try_cast("double").alias(c) if c in floats else num(c).try_cast("double").cast("int").alias(c) if c in ints else F.col(c) for c in df.columns])


def load_memory(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON-lines memory; missing or unreadable files give an empty frame of the schema."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception:  # noqa: BLE001 - a memory that cannot be read is an empty one
        return spark.createDataFrame([], schema)


def replace_version(df: DataFrame, path: str, version: list[str]) -> None:
    """Overwrites the partitions of the versions in the frame and leaves all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*version).parquet(path)


def save_memory(memory: DataFrame, path: str, key: str = "key") -> bool:
    """Writes a memory as JSON lines if it differs from what is there, and tells whether it did. The new one is written beside
    the old one first, so a failure leaves a whole memory."""
    spark = memory.sparkSession
    old = load_memory(spark, path, memory.schema)
    rows = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in memory.columns])
    if not rows(memory).exceptAll(rows(old)).limit(1).count() and not rows(old).exceptAll(rows(memory)).limit(1).count():
        return False
    memory.write.mode("overwrite").json(f"{path}.next")
    spark.read.schema(memory.schema).json(f"{path}.next").write.mode("overwrite").json(path)
    delete_path(spark, f"{path}.next")
    return True


def snapshot_rows(df: DataFrame, key: list[str], payload: list[str], flags: dict[str, Column]) -> DataFrame:
    """Rows of an immutable snapshot: the key, the payload as one JSON text, its hash, and flags (a condition that is null does
    not hold)."""
    text = F.to_json(F.struct(*payload))
    return df.select(*key, text.alias("payload"), F.sha2(text, 256).alias("payload_hash"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])


def append_snapshot(df: DataFrame, path: str) -> None:
    """Adds rows; none that is there is ever changed."""
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, folder: str, stem: str) -> str:
    """One CSV file with a byte-order mark, for spreadsheets: the driver appends the parts one after another, so nothing is
    collected. Raises for an empty frame."""
    parts = f"{folder}/.{stem}.parts"
    df.write.mode("overwrite").option("header", True).csv(parts)
    files = sorted(glob.glob(f"{parts}/part-*.csv"))
    target = f"{folder}/{stem}.csv"
    rows = 0
    with open(target, "w", encoding="utf-8-sig", newline="") as out:
        for f in files:
            with open(f, encoding="utf-8", newline="") as src:
                header = src.readline()
                if header and out.tell() <= 3:
                    out.write(header)
                for line in src:
                    out.write(line)
                    rows += 1
    shutil.rmtree(parts)
    if not rows:
        os.remove(target)
        raise ValueError("there is nothing to export")
    return target


def export_xlsx(df: DataFrame, path: str, most: int = 100_000) -> str:
    """A workbook of at most `most` rows, made at the edge; needs openpyxl."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("openpyxl is not installed") from e
    pdf = df.limit(most + 1).toPandas()
    if len(pdf) > most:
        raise ValueError("too many rows for a workbook")
    pdf.to_excel(path, index=False, freeze_panes=(1, 0))
    return path


class _Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _PagesReader(DataSourceReader):
    """One partition a saved page. Equality and membership of `source` and `page` are taken over: they prune folders and pages
    before anything is read. The folder must be one that all machines see."""

    def __init__(self, options: dict):
        self.root, self.most, self.only = options["path"], int(options.get("max_pages", 0)), {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("source",), ("page",)):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                have = self.only.get(f.attribute[0])
                self.only[f.attribute[0]] = wanted if have is None else have & wanted
            else:
                yield f

    def partitions(self):
        asked = lambda column, name: column not in self.only or name in self.only[column]
        pages = []
        for source in sorted(os.listdir(self.root)):
            if asked("source", source):
                own = sorted(Path(self.root, source).glob("*.html"))
                pages += [p for p in (own[: self.most] if self.most else own) if asked("page", p.stem)]
        return [_Page(str(p)) for p in pages] or [_Page("")]

    def read(self, partition):
        if partition.path:
            p = Path(partition.path)
            yield (p.parent.name, p.stem, p.read_text(encoding="utf-8", errors="replace"))


class SavedPages(DataSource):
    """`spark.read.format("saved_pages").option("max_pages", n).load(folder)`: folder/<source>/<page>.html"""

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return "source string, page string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(self.options)
