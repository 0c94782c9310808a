"""Preference records from JSON-lines files."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefdeck.schema import CORRUPT, RECORD_SCHEMA


def path_list(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def check_source_extension(paths: str | Sequence[str]) -> list[str]:
    """The paths as a list; a path that does not end in ``jsonl`` is an error."""
    listed = path_list(paths)
    wrong = [path for path in listed if not path.endswith("jsonl")]
    if wrong:
        raise ValueError(f"expected paths ending in 'jsonl', got {wrong}")
    return listed


def records_from_lines(lines: DataFrame, line: str = "value", strict: bool = False) -> DataFrame:
    """The columns of ``lines`` but ``line``, the fields of RECORD_SCHEMA, and the whole line once more in
    ``_corrupt_record`` where it is no record of that shape.

    Any table with a text column will do. A field that does not fit is NULL, and so are all fields of
    a line that is no JSON object; with ``strict`` such a line fails the job. Every line is parsed as
    a whole, so what is corrupt does not depend on the columns that are read later.
    """
    others = [c for c in lines.columns if c != line]
    if strict:
        parsed = F.from_json(line, RECORD_SCHEMA, {"mode": "FAILFAST"})
        fields = RECORD_SCHEMA.fieldNames()
        read = lines.withColumn("_record", parsed)
        return read.select(*others, *[F.col("_record")[f].alias(f) for f in fields], F.lit(None).cast("string").alias(CORRUPT))
    schema = T.StructType([*RECORD_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    read = lines.withColumn("_record", F.from_json(line, schema, options))
    return read.select(*others, *[F.col("_record")[f].alias(f) for f in schema.fieldNames()])


def invalid_records(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of ``lines`` that are no record of the expected shape: their other columns, ``reason, line``.
    Blank lines are none."""
    annotations = F.get_json_object(CORRUPT, "$.annotations")
    reason = F.when(
        annotations.isNotNull() & ~F.ltrim(annotations).startswith("["), "annotations is not a list"
    ).otherwise("not a record of the expected shape")
    others = [c for c in lines.columns if c != line]
    found = records_from_lines(lines.where(F.trim(line) != ""), line).where(F.col(CORRUPT).isNotNull())
    return found.select(*others, reason.alias("reason"), F.col(CORRUPT).alias("line"))


# Files of a listing that a join may copy to every executor: a few MB of names.
MOST_NAMED_FILES = 50_000


def _one_form(uri: str) -> str:
    """A file's URI with three slashes where it has no authority: Spark writes both forms."""
    scheme, colon, rest = uri.partition(":")
    return f"{scheme}://{rest}" if colon and rest.startswith("/") and not rest.startswith("//") else uri


def _listing(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """The files of each listed path. All paths are listed at once; those that are files themselves are
    recognised by name, and only folders and globs are listed once more, one by one."""
    distinct = list(dict.fromkeys(paths))
    files = {}
    for uri in map(_one_form, spark.read.text(distinct).inputFiles()):
        parts = urlsplit(uri)
        files.setdefault(unquote(parts.path), []).append(uri)
    out = {}
    for path in distinct:
        parts = urlsplit(path)
        name = path if not parts.scheme else unquote(parts.path)
        named = [u for u in files.get(os.path.abspath(name), []) if not parts.netloc or urlsplit(u).netloc == parts.netloc]
        out[path] = named if len(named) == 1 else [*map(_one_form, spark.read.text(path).inputFiles())]
    return out


def _read_sets(spark: SparkSession, sets: Sequence[tuple[str, Sequence[str]]], strict: bool) -> DataFrame:
    """Records of all named sets from one scan over all their paths."""
    checked = [(name, check_source_extension(paths)) for name, paths in sets]
    every = list(dict.fromkeys(path for _, paths in checked for path in paths))
    listing = _listing(spark, every)
    places = [
        (file, name, place)
        for name, paths in checked
        for place, path in enumerate(paths)
        for file in listing[path]
    ]
    known = spark.createDataFrame(places, "_file string, origin string, _place int")
    if len(places) <= MOST_NAMED_FILES:
        known = F.broadcast(known)
    lines = (
        spark.read.text(sorted({unquote(file) for file, _, _ in places}))
        .select(
            "value",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
        .where(F.trim("value") != "")
        .withColumn("_file", F.regexp_replace("file_path", "^([A-Za-z0-9+.-]+):/(?!/)", "$1:///"))
        .join(known, "_file")
    )
    ord_ = F.struct(
        F.col("_place").alias("path"), F.col("file_path").alias("file"), F.col("_block").alias("block"), F.col("_row").alias("row")
    )
    read = records_from_lines(lines, strict=strict)
    return read.select("origin", ord_.alias("ord"), "file_path", *RECORD_SCHEMA.fieldNames(), CORRUPT)


def read_preferences(
    spark: SparkSession,
    paths: str | Sequence[str],
    origin: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """One or many JSONL paths as one set of records, tagged with ``origin`` and ``ord``.

    One scan reads all listed paths, however many; ``ord.path`` is a path's place in the list, from a
    table of files and places. Inside a path (a folder or a glob) files follow their names, and lines
    their splits; a path listed twice is read twice. Lines are parsed by :func:`records_from_lines`,
    so broken ones stand in ``_corrupt_record``.
    """
    listed = path_list(paths)
    return _read_sets(spark, [(origin if origin is not None else ",".join(listed), listed)], strict)


def invalid_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines that are no record of the expected shape: ``file_path, reason, line``."""
    lines = spark.read.text(check_source_extension(paths))
    return invalid_records(lines.select("value", F.col("_metadata.file_path").alias("file_path")))


def read_named_sets(
    spark: SparkSession, sets: Mapping[str, str | Sequence[str]] | str | Sequence[str]
) -> DataFrame:
    """Several data sets in one DataFrame, told apart by ``origin``, from one scan.

    A mapping gives one fused set per name; a single path or a list gives one fused set.
    """
    if not isinstance(sets, Mapping):
        return read_preferences(spark, sets)
    return _read_sets(spark, [(name, path_list(paths)) for name, paths in sets.items()], strict=False)


def read_train_and_eval(
    spark: SparkSession,
    train: Mapping[str, str | Sequence[str]] | str | Sequence[str],
    evaluation: Mapping[str, str | Sequence[str]] | str | Sequence[str] | None,
) -> tuple[DataFrame, DataFrame | None]:
    """Training and evaluation records; equal paths share one scan definition."""
    train_records = read_named_sets(spark, train)
    if evaluation is None:
        return train_records, None
    if evaluation == train:
        return train_records, train_records
    return train_records, read_named_sets(spark, evaluation)


def tag_origin(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One data set *per path*, each tagged with its own path (the evaluation reading of a list)."""
    listed = check_source_extension(paths)
    return read_named_sets(spark, {path: path for path in listed})
