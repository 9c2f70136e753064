"""Transcript files as rows: discovery, splitting, line numbers, pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.variant import is_object
from ..operators.blocks import once, top_n


def _path_text() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")


def inventory(spark: SparkSession, root: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Files below ``root`` without reading them: path, mtime_ms, size."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select(
        F.regexp_replace("path", "^file:(//)?", "").alias("path"),
        F.unix_millis("modificationTime").alias("mtime_ms"),
        F.col("length").alias("size"),
    )


def tool_of_path(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for tool, pattern in reversed(K.TRANSCRIPT_LOCATIONS):
        out = F.when(path.rlike(pattern), F.lit(tool)).otherwise(out)
    return out


def identity_of_path(path: Column, tool: Column) -> Column:
    """Files that are views of one session share an identity."""
    logs = r"/.system_generated/logs/transcript.jsonl"
    antigravity = (
        F.when(path.endswith("/.git/HEAD"), F.concat(F.regexp_replace(path, r"/\.git/HEAD$", ""), F.lit(logs)))
        .when(
            path.endswith(".db"),
            F.concat(F.regexp_replace(path, r"/conversations/([^/]+)\.db$", "/brain/$1"), F.lit(logs)),
        )
        .otherwise(F.regexp_replace(path, r"transcript_full\.jsonl$", "transcript.jsonl"))
    )
    return F.when(tool == "antigravity", antigravity).when(tool == "codex", F.regexp_replace(path, r"\.zst$", "")).otherwise(path)


def discover_files(files: DataFrame) -> DataFrame:
    """Transcript files by harness, one per identity; the plain twin of a compressed file comes first."""
    tagged = files.withColumn("tool", tool_of_path(F.col("path"))).where("tool is not null")
    named = tagged.withColumn("identity", identity_of_path(F.col("path"), F.col("tool")))
    return top_n(named, ["identity"], [(F.col("path") != F.col("identity")).cast("int"), F.col("path")], 1)


def prefer_plain_twin(files: DataFrame) -> DataFrame:
    """Drop ``x.jsonl.zst`` where ``x.jsonl`` exists."""
    plain = files.where(F.col("path").endswith(".jsonl")).select(F.concat("path", F.lit(".zst")).alias("path"))
    return files.join(plain, "path", "left_anti")


def prune_by_mtime(files: DataFrame, since: Column | None) -> DataFrame:
    """Files last written before ``since`` minus two days cannot matter; no ``since`` keeps everything."""
    if since is None:
        return files
    oldest = F.unix_millis(since.cast("timestamp")) - K.MTIME_SLACK_DAYS * K.DAY_MS
    return files.where(F.col("mtime_ms") >= oldest)


def read_lines(spark: SparkSession, paths: str | Sequence[str], since: str | None = None) -> DataFrame:
    """Lines of text files with dense line numbers: file_path, line_no, value.

    Large plain files stay splittable. Within a split, row ids grow by one per line; a per-split count and
    first id (one small row per split) turn them into file-wide line numbers.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if since:
        reader = reader.option("modifiedAfter", since)
    raw = reader.text(paths).select(
        _path_text().alias("file_path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row_id"),
        "value",
    )
    before = Window.partitionBy("file_path").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("file_path", "split_start").agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n")).select(
        "file_path", "split_start", "first_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")
    )
    return raw.join(splits, ["file_path", "split_start"]).select(
        "file_path", (F.col("row_id") - F.col("first_id") + F.col("earlier")).alias("line_no"), "value"
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds ``v`` (VARIANT); blank, malformed and non-object lines drop out."""
    rest = [c for c in lines.columns if c not in ("value", "v")]
    return once(lines.where(F.trim("value") != ""), rest, F.try_parse_json("value").alias("v")).where(is_object(F.col("v")))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The lines ``parse_lines`` skips, for inspection."""
    v = F.try_parse_json("value")
    return lines.where((F.trim("value") != "") & (v.isNull() | ~is_object(v)))


def sniff_format(lines: DataFrame) -> DataFrame:
    """file_path, rollout: a rollout declares itself within the first lines by its parsed type."""
    kind = F.try_variant_get(F.try_parse_json("value"), "$.type", "string")
    hit = F.coalesce(kind.isin("session_meta", "response_item"), F.lit(False))
    return lines.groupBy("file_path").agg(F.max((F.col("line_no") < K.SNIFF_LINES) & hit).alias("rollout"))
