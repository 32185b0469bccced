"""Scans of delimited files with preambles, registries, inventories; sinks.

Files are read by Spark's readers only, so any store they reach will do.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.joins import free_names
from tessera.sources.records import join_broken_lines

#: The header stands within so many lines.
HEADER_LINES = 10
#: A file in one part is shorter.
MOST_BYTES = 1 << 40


def file_id(path: Column) -> Column:
    """The assay id in a file name such as AID_123_datatable_all.csv."""
    return F.regexp_extract(path, r"AID_([0-9]+)_", 1)


def folder_label(path: Column, prefix: str = "pubchem_") -> Column:
    """A source label from the folder that holds the file."""
    name = F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), "%20| ", "_"))
    return F.concat(F.lit(prefix), name)


def fields(line: Column, names: list[str]) -> Column:
    """Struct of a CSV line's fields as strings, trimmed; an empty field is null as a missing one is, a quoted empty one is empty."""
    schema = ", ".join(f"`{n}` string" for n in names)
    options = {"quote": '"', "escape": '"', "nullValue": "\0", "emptyValue": "", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    return F.from_csv(line, F.lit(schema), options)


def preamble_csv(spark: SparkSession, paths: str | list[str], sentinel: str = "PUBCHEM_SID", in_parts: bool = False) -> DataFrame:
    """Rows of headered CSV files with lines before and after the header that are no data.

    The header is the first line with ``sentinel`` among the first HEADER_LINES lines of a
    file; rows are those after it whose sentinel column is an integer. Columns are the
    union over all headers, as strings (null where a file lacks one), with _path and
    _line (a number that orders a file's lines). Bytes that are no UTF-8 are replaced.
    Line breaks within quoted fields are left out, and do not end the record.
    ``in_parts``: the folder of files part-<number>-.. is one file, as ``write_lines`` makes it; _path is the folder.
    All lines stay in the tasks that read them.
    """
    at, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    if in_parts:
        start = F.regexp_extract(at, r"/part-([0-9]+)[^/]*$", 1).cast("long") * MOST_BYTES + start
        at = whole_path(at)
    lines = spark.read.text(paths).select("value", at.alias("_path"), start.alias("_block"), F.monotonically_increasing_id().alias("_line"))
    firsts = lines.filter(F.col("_block") % MOST_BYTES == 0).groupBy("_path", "_block").agg(F.min("_line").alias("_first")).collect()  # a row for each file or part
    firsts = {r["_path"]: tuple(r) for r in sorted(firsts, key=lambda r: r["_block"], reverse=True)}
    known = spark.createDataFrame(list(firsts.values()), "_path string, _top long, _first long")
    tops = lines.join(F.broadcast(known), "_path").filter((F.col("_block") == F.col("_top")) & (F.col("_line") - F.col("_first") < HEADER_LINES) & F.col("value").contains(sentinel))
    tops = {r["_path"]: r for r in sorted(tops.collect(), key=lambda r: r["_line"], reverse=True)}  # a few rows for each file; the first line stays
    tops = [(r["_path"], r["_top"], r["_line"], r["value"]) for r in tops.values()]
    heads = sorted({h for *_, h in tops})  # layouts, not files
    if not heads:
        return spark.createDataFrame([], f"_path string, _line long, {sentinel} string")
    known = spark.createDataFrame([(path, block, line, heads.index(h)) for path, block, line, h in tops], "_path string, _top long, _at long, _layout int")
    rows = lines.join(F.broadcast(known), "_path").filter((F.col("_block") > F.col("_top")) | (F.col("_line") > F.col("_at"))).drop("_top", "_at")
    rows = join_broken_lines(rows)
    layouts = [[n.strip().strip('"').lstrip("﻿") for n in h.split(",")] for h in heads]
    rows = rows.withColumns({f"_f{i}": F.when(F.col("_layout") == i, fields(F.col("value"), names)) for i, names in enumerate(layouts)})
    every = dict.fromkeys(n for names in layouts for n in names)
    cell = lambda n: F.coalesce(*(F.col(f"_f{i}.`{n}`") for i, names in enumerate(layouts) if n in names)).alias(n)
    return rows.select("_path", "_line", *map(cell, every)).filter(F.col(sentinel).rlike("^-*[0-9]+$"))


def delimited(spark: SparkSession, path: str, sep: str | None = None, types: dict[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Headered file; without ``sep`` the suffix decides (.tsv: tab, else comma).

    Columns are strings but for those of ``types`` (name -> type); a cell that is not of its
    type is null. Only ``columns`` are returned, in their order, and parsed.
    """
    sep = sep or ("\t" if path.lower().endswith((".tsv", ".txt")) else ",")
    rows = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
    rows = rows.select(*columns) if columns else rows
    types = types or {}
    return rows.select(*(F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in rows.columns))


def with_registry(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with the provenance of their file: registry has aid, source, layer; rows of other files go."""
    return rows.withColumn("aid", file_id(F.col("_path"))).join(F.broadcast(registry), "aid")  # a row for each file


def cap_by_source(df: DataFrame, source: str, order: list[str], n: int) -> DataFrame:
    """Dry run: the first ``n`` rows of each source."""
    w = Window.partitionBy(source).orderBy(*order)
    (place,) = free_names(df, 1)
    return df.withColumn(place, F.row_number().over(w)).filter(F.col(place) <= n).drop(place)


def inventory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Each file's path, id, length and date; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select("path", file_id(F.col("path")).alias("aid"), "length", F.date_format("modificationTime", "yyyy-MM-dd").alias("modified"))


def check_inventory(files: DataFrame, registry: DataFrame, warn_below: int = 1000) -> DataFrame:
    """Registered ids against files: PASS, WARN (small), FAIL (missing or in several places), ORPHAN (not registered)."""
    seen = files.groupBy("aid").agg(F.count("*").alias("files"), F.max("length").alias("length"), F.sort_array(F.collect_list("path")).alias("paths"))
    both = registry.select("aid", F.lit(True).alias("known")).join(seen, "aid", "full_outer")
    status = F.when(F.col("known").isNull(), "ORPHAN").when(F.col("files").isNull() | (F.col("files") > 1), "FAIL").when(F.col("length") < warn_below, "WARN").otherwise("PASS")
    return both.select("aid", F.coalesce("files", F.lit(0)).alias("files"), "length", "paths", status.alias("status"))


def comparable_path(path: Column) -> Column:
    """A path as both the file metadata (encoded) and the file listing (plain) would have it."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(plain, r"^(\w+):/+", "$1:/")


def check_files(rows: DataFrame, files: DataFrame, required: list[str], least_rows: int = 1) -> DataFrame:
    """Each file's path, rows, missing columns and status.

    FAIL: a required column is in none of the file's rows, or the file has no rows; WARN:
    fewer rows than ``least_rows``; else PASS. ``rows``: the scanned rows with _path.
    """
    there = [F.max(F.col(f"`{c}`").isNotNull()).alias(f"_{i}") if c in rows.columns else F.lit(False).alias(f"_{i}") for i, c in enumerate(required)]
    seen = rows.groupBy(comparable_path(F.col("_path")).alias("_at")).agg(F.count("*").alias("rows"), *there)
    lacks = F.array_compact(F.array(*(F.when(~F.coalesce(f"_{i}", F.lit(False)), F.lit(c)) for i, c in enumerate(required))))
    made = files.join(seen, comparable_path(F.col("path")) == F.col("_at"), "left").select("path", F.coalesce("rows", F.lit(0)).alias("rows"), lacks.alias("missing"))
    status = F.when((F.col("rows") == 0) | (F.size("missing") > 0), "FAIL").when(F.col("rows") < least_rows, "WARN").otherwise("PASS")
    return made.withColumn("status", status)


def unregistered(files: DataFrame, registry: DataFrame, excluded: DataFrame) -> DataFrame:
    """Files by aid that no registry row has (ORPHAN) or that are to be left out (EXCLUDED)."""
    left_out = files.join(F.broadcast(excluded.select("aid").distinct()), "aid", "left_semi").withColumn("status", F.lit("EXCLUDED"))  # a row for each file
    orphans = files.join(F.broadcast(registry.select("aid").union(excluded.select("aid")).distinct()), "aid", "left_anti").withColumn("status", F.lit("ORPHAN"))
    return left_out.unionByName(orphans)


def check_columns(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """A row for each external table (name -> table, required columns): name, missing columns, status."""
    made = []
    for name, (df, required) in tables.items():
        lacks = missing_columns(df, required)
        made.append((name, lacks, "FAIL" if lacks else "PASS"))
    return spark.createDataFrame(made, "name string, missing array<string>, status string")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def write_lines(rows: DataFrame, head: list[str], path: str) -> None:
    """Lines (one column) as a text file in parts, a folder: the first part begins with the lines of ``head``, each task writes the rows it has."""
    top = rows.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1)
    top.union(rows).write.text(path)


def whole_path(path: Column) -> Column:
    """The folder of a file in parts; other paths as they are."""
    return F.regexp_replace(path, r"/part-[0-9]+[^/]*$", "")


def whole_files(files: DataFrame) -> DataFrame:
    """An inventory with the parts of a file taken together."""
    made = files.groupBy(whole_path(F.col("path")).alias("path")).agg(F.sum("length").alias("length"), F.max("modified").alias("modified"))
    return made.select("path", file_id(F.col("path")).alias("aid"), "length", "modified")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def materialised(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, written from ``make()`` unless it is there; a write that broke off counts as not there."""
    if not _exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        write_table(make(), path)
    return spark.read.parquet(path)


def export_package(tables: dict[str, DataFrame], folder: str, columns: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Each table as headered CSV in a folder of its name (with ``columns``, only those); name -> path."""
    made = {}
    for name, df in tables.items():
        made[name] = f"{folder.rstrip('/')}/{name}"
        write_csv(df, made[name], (columns or {}).get(name))
    return made


def replace_table(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rewrite the table at ``path`` with ``change(table)``: written beside it, then swapped by renames.

    If the second rename fails the first is undone; a table that a break left under its
    name for the swap (path + "-old") is put back before anything else.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    at, old, fresh = (fs_path(path.rstrip("/") + end) for end in ("", "-old", f"-{uuid.uuid4().hex}"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old):
        if fs.exists(at):
            fs.delete(old, True)
        else:
            fs.rename(old, at)
    write_table(change(spark.read.parquet(path)), fresh.toString())
    if not fs.rename(at, old):
        fs.delete(fresh, True)
        raise OSError(f"{path} could not be moved")
    if not fs.rename(fresh, at):
        fs.rename(old, at)
        fs.delete(fresh, True)
        raise OSError(f"{path} could not be replaced")
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share; deleted when the interpreter ends.

    Only a session on one machine may go without the setting; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
