"""Reading and writing the file formats of the pipeline."""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings that are tried in this order; the last reads any bytes.
ENCODINGS = ("utf-8", "iso-8859-1")


def resolve_column(columns: Sequence[str], *candidates: str) -> str | None:
    """The first column that equals a candidate but for letter case and outer blanks."""
    plain = {c.strip().lower(): c for c in reversed(columns)}
    return next((plain[c.lower()] for c in candidates if c.lower() in plain), None)


#: Bytes of one read, and of a file's beginning that holds its header.
CHUNK = 1 << 20


def each_file(spark: SparkSession, path: str, pattern: str, look: Callable[[BinaryIO], object], kind: str) -> DataFrame:
    """Rows (path, n_bytes, found): what a function finds in each file, read as a stream in a task where the file lies; files may be of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            found = []
            for p in b.column("path").to_pylist():
                own = p.startswith("file:")
                system, place = (fs.LocalFileSystem(), "/" + p.removeprefix("file:").lstrip("/")) if own else fs.FileSystem.from_uri(p)
                with system.open_input_stream(place) as f:
                    found.append(look(f))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], ["path", "n_bytes", "found"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("n_bytes"))
    return files.mapInArrow(run, f"path string, n_bytes bigint, found {kind}")


def _beginning(f: BinaryIO) -> list[str]:
    """The encoding of a CSV file, which needs all of it, and then its beginning."""
    decode, good, head = codecs.getincrementaldecoder("utf-8")(), True, b""
    while chunk := f.read(CHUNK):
        head = head or chunk
        try:
            decode.decode(chunk)
        except UnicodeDecodeError:
            good = False
            break
    try:
        decode.decode(b"", True)
    except UnicodeDecodeError:
        good = False
    name = ENCODINGS[0] if good else ENCODINGS[1]
    return [name, head.decode(name, "ignore").removeprefix("\ufeff")]


def read_exports(spark: SparkSession, path: str, pattern: str = "*.csv", schema: T.StructType | None = None, delimiter: str = ",", name_like: str | None = None, missing: Sequence[str] = ()) -> DataFrame:
    """All CSV files of a folder, every column a string, with source_file; values may hold quotes and line breaks.

    Files that aren't UTF-8 are read as Latin-1. Columns that a file lacks are null in
    its rows. An empty value is null, and so are the listed marks of a missing one; "NA"
    is text unless listed. name_like: a pattern that the whole file name must match.
    """
    files = each_file(spark, path, pattern, _beginning, "array<string>")
    if name_like is not None:
        files = files.where(F.element_at(F.split("path", "/"), -1).rlike(f"^(?:{name_like})$"))
    # headers differ from file to file, so each set of equal headers is read at once
    same: dict[tuple[str, ...], list[str]] = {}
    for r in files.collect():
        header = next(csv.reader(io.StringIO(r.found[1], newline=""), delimiter=delimiter), [])
        same.setdefault((r.found[0], *([] if schema is not None else header)), []).append(r.path)
    out = None
    for (encoding, *_), paths in sorted(same.items()):
        reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", delimiter).option("encoding", encoding)
        if schema is not None:
            reader = reader.schema(schema).option("enforceSchema", False)
        part = reader.csv(paths).withColumn("source_file", F.col("_metadata.file_name"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], schema or "source_file string")
    for mark in missing:
        out = out.select(*(F.nullif(F.col(f"`{c}`"), F.lit(mark)).alias(c) if t == "string" and c != "source_file" else F.col(f"`{c}`") for c, t in out.dtypes))
    return out


def read_typed(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = "\t", header: bool = False) -> DataFrame:
    """Delimited files of known columns and types, without a header unless asked for; a value of another type stops the job."""
    return spark.read.schema(schema).option("sep", delimiter).option("header", header).option("mode", "FAILFAST").csv(path)


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Organisations of a nested JSON array as they stand: ord (in order), id, names (value, types), countries (distinct codes)."""
    raw = spark.read.option("multiLine", True).json(path)
    codes = F.array_distinct(F.filter(F.transform("locations", lambda x: x["geonames_details"]["country_code"]), lambda c: c.isNotNull()))
    return raw.select(F.monotonically_increasing_id().alias("ord"), "id", "names", F.coalesce(codes, F.array().cast("array<string>")).alias("countries"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Institutions of a nested JSON array: one row (id, display, country_code, names) for each institution and country."""
    raw = spark.read.option("multiLine", True).json(path)
    shown = F.filter("names", lambda n: F.array_contains(n["types"], "ror_display"))
    display = F.coalesce(F.get(shown, F.lit(0))["value"], F.get("names", F.lit(0))["value"])
    codes = F.array_distinct(F.transform("locations", lambda x: x["geonames_details"]["country_code"]))
    return raw.select("id", display.alias("display"), F.explode_outer(codes).alias("country_code"), F.transform("names", lambda n: n["value"]).alias("names"))


def read_query_lines(spark: SparkSession, path: str, line_tag: str, field: str) -> DataFrame:
    """Lines of one field from XML query definitions, in their order: rows (source_file, pos, line)."""
    raw = spark.read.format("xml").option("rowTag", line_tag).load(path)
    lines = raw.where(F.col("_field") == field).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.monotonically_increasing_id().alias("at"), F.trim(F.regexp_replace("_VALUE", r"\s+", " ")).alias("line")
    )
    w = Window.partitionBy("source_file").orderBy("at")
    return lines.select("source_file", F.row_number().over(w).alias("pos"), "line")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row (source_file, text) for each file, read whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))


def read_pairs(spark: SparkSession, path: str, mark: str = ":") -> DataFrame:
    """Rows (key, value) of the lines that hold the mark, cut at its first occurrence."""
    t = spark.read.text(path).where(F.col("value").contains(mark))
    parts = F.split("value", f"[{mark}]", 2)
    return t.select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def _digest(f: BinaryIO) -> str:
    h = hashlib.sha256()
    while chunk := f.read(CHUNK):
        h.update(chunk)
    return h.hexdigest()


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Rows (source_file, n_bytes, digest): SHA-256 of each file, of whatever size."""
    return each_file(spark, path, pattern, _digest, "string").select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "n_bytes", F.col("found").alias("digest"))


def checksum_list(digests: DataFrame) -> str:
    """Lines "digest  name" of file_digests, by name; the same files give the same text."""
    rows = digests.select("source_file", "digest").orderBy("source_file").collect()
    return "".join(f"{r.digest}  {r.source_file}\n" for r in rows)


def write_table(df: DataFrame, path: str, kind: str = "csv", one_file: bool = False, bom: bool = False) -> None:
    """Write CSV (with header and doubled quotes), TSV, JSON or Parquet, replacing what was there, so a repeated run leaves one copy.

    bom: begin each CSV file with the mark by which some spreadsheets know UTF-8.
    """
    if bom and kind in ("csv", "tsv"):
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    out = (df.coalesce(1) if one_file else df).write.mode("overwrite")
    if kind in ("csv", "tsv"):
        out.option("header", True).option("escape", '"').option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind == "json":
        out.json(path)
    elif kind == "parquet":
        out.parquet(path)
    else:
        raise ValueError(f"unknown kind of table: {kind}")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as a table of text; more rows than most are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report takes at most {most} rows")
    show = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])
