"""Text line sources: NDJSON events, JSON lines, raw lines, compressed files, format detection."""

from __future__ import annotations

import datetime as dt
import gzip
import io
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lanternlog.functions.fields import drop_paths, flatten, let
from lanternlog.functions.projections import safe_base
from lanternlog.functions.text import blank, rstrip, strip
from lanternlog.model import PROMOTED, SHIP_CONSTANTS, SHIP_DROP, TS, column_of


#: Compressed files up to this size are unpacked in a task that reports what is wrong with them; larger gzip files are
#: read by Spark's own reader, piece by piece, and end where they are damaged.
PACKED = 256 << 20
_PIECE = 1 << 18
_PACKED_NAME = r"(?i)\.(gz|zip)$"


def _named(lines: DataFrame) -> DataFrame:
    decoded = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return lines.select(
        F.coalesce(decoded, F.col("_metadata.file_path")).alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("line_no"),
        F.col("value").alias("line"),
    )


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain files, and of gzip files too large to unpack in a task: ``file``, ``line_no`` (sort key), ``line``.

    Plain files are split across tasks; the sort key orders lines within a file
    without numbering them globally. Files whose name starts with a dot are skipped.
    """
    lines = spark.read.option("recursiveFileLookup", "false").option("ignoreCorruptFiles", "true").text(path)
    name, size = F.col("_metadata.file_name"), F.col("_metadata.file_size")
    # conditions on names and sizes choose files before any is opened
    plain = ~name.rlike(_PACKED_NAME)
    large = name.rlike(r"(?i)\.gz$") & (size > PACKED)
    return _named(lines.where(~name.startswith(".") & (plain | large)))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Lines of gzip files and of the first member of each zip archive, and what is wrong with them as rows.

    ``file, line_no, line, error``: one row a line, with a null error, then at most one row a file with a null line and
    the error that ended it. Lines before the damage are there. A file cannot be split, so it is one task; it is unpacked
    in bounded pieces, so neither a member's length nor its lines' number matters.
    """
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,GZ,zip,ZIP}").load(path)
    packed = packed.where((F.col("length") <= PACKED) | F.lower("path").endswith(".zip"))
    return unpacked(packed)


def unpacked(packed: DataFrame) -> DataFrame:
    """``read_archives`` of packed files that are rows (path, content)."""
    rows = packed.select("path", "content").mapInPandas(_unpacked, "file string, row bigint, line string, error string")
    at = F.struct(F.lit(0).cast("bigint").alias("block"), "row")
    return rows.select("file", at.alias("line_no"), "line", "error")


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, content in zip(batch["path"], batch["content"]):
            if name.rsplit("/", 1)[-1].startswith("."):
                continue
            done = 0
            try:
                pieces = _gzip_pieces(content) if name.lower().endswith(".gz") else _zip_pieces(content)
                for lines in _lines_of(pieces):
                    yield _line_frame(name, done, lines)
                    done += len(lines)
            except (OSError, EOFError, RuntimeError, NotImplementedError, zlib.error, zipfile.BadZipFile) as error:
                yield _line_frame(name, done, [None], str(error) or type(error).__name__)


def _gzip_pieces(content: bytes) -> Iterator[bytes]:
    """Unpacked bytes of all members of a gzip file; a file cut short is an error after what there is."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as file:
        while piece := file.read1(_PIECE):
            yield piece


def _zip_pieces(content: bytes) -> Iterator[bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for member in archive.infolist()[:1]:
            with archive.open(member) as file:
                while piece := file.read1(_PIECE):
                    yield piece


def _lines_of(pieces: Iterator[bytes], most: int = 20_000) -> Iterator[list[str]]:
    """Lines in lists of bounded length. What comes before an error comes out before it is raised."""
    open_line: list[bytes] = []
    lines: list[str] = []
    failed: BaseException | None = None
    text = lambda raw: raw.removesuffix(b"\r").decode("utf-8", "replace")
    while True:
        try:
            piece = next(pieces, None)
        except Exception as error:
            failed, piece = error, None
        if piece is None:
            break
        head, *rest = piece.split(b"\n")
        open_line.append(head)
        for line in rest:
            lines.append(text(b"".join(open_line)))
            open_line = [line]
        if len(lines) >= most:
            yield lines
            lines = []
    if open_line and any(open_line):
        lines.append(text(b"".join(open_line)))
    if lines:
        yield lines
    if failed is not None:
        raise failed


def _line_frame(name: str, start: int, lines: list[str | None], error: str | None = None) -> pd.DataFrame:
    return pd.DataFrame({"file": name, "row": range(start, start + len(lines)), "line": lines, "error": error})


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """file, size and hidden (a name that readers skip) of all files of a folder or glob, empty ones too."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for status in fs.globStatus(root) or []:
        for s in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
            name = s.getPath().getName()
            if s.isFile() and not name.endswith(".crc"):
                rows.append((s.getPath().toString(), s.getLen(), name[0] in "._"))
    return spark.createDataFrame(rows, "file string, size bigint, hidden boolean")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain, gzip and zip files of a folder or glob; damaged ones as far as they can be read."""
    archives = read_archives(spark, path).where("error is null").drop("error")
    return read_log_files(spark, path).unionByName(archives)


# Event lines ----------------------------------------------------------------------


def read_eve(spark: SparkSession, path: str, streaming: bool = False, **options: Any) -> DataFrame:
    """Raw NDJSON lines in a column ``value``; feed to ``parse_events``."""
    reader = spark.readStream if streaming else spark.read
    return reader.options(**options).text(path)


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Adds ``status`` and ``fields`` to event lines; blank lines go.

    status is ``event`` for a JSON object, ``scalar`` for any other JSON value and
    ``text`` for the rest; only ``event`` lines have ``fields``.
    """
    text = F.col(column)

    def judged(body: Column) -> Column:
        kind = F.when(body.isNull(), "text").when(F.ltrim(text, F.lit(" \t\r\n")).startswith("{"), "event").otherwise("scalar")
        return F.struct(kind.alias("status"), body.alias("_body"))

    # A line is parsed once, in a generator: filters on what comes out of it stay above it, and only the rows
    # that are left have their leaves looked up.
    one = F.array(let(F.try_parse_json(text), judged))
    others = [F.col(f"`{c}`") for c in lines.columns if c not in ("status", "fields")]
    parsed = lines.select(*others, F.inline(F.when(~blank(text), one)))
    return parsed.withColumn("fields", F.when(F.col("status") == "event", flatten(F.col("_body"), text))).drop("_body")


def with_constants(df: DataFrame, constants: dict[str, Any] | None = None) -> DataFrame:
    """Root-level constants added at shipping time."""
    constants = SHIP_CONSTANTS if constants is None else constants
    return df.withColumns(
        {k: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v) for k, v in constants.items()}
    )


def drop_fields(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    return df.withColumn("fields", drop_paths(F.col("fields"), SHIP_DROP if paths is None else paths))


def promote(df: DataFrame, base: str | Column, event_time: Column, doc_id: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Leaf maps -> documents: typed columns, event day, and the names of malformed values.

    A value that does not fit its promoted type leaves the column null, stays in
    ``fields`` and is listed in ``_malformed``; the document is never dropped. Columns
    named in ``keep`` pass through.
    """
    fields = F.col("fields")
    typed: dict[str, Column] = {}
    for path, dtype in PROMOTED.items():
        variant = F.try_parse_json(fields[path])
        if dtype == "array<string>":
            value = F.coalesce(
                F.try_variant_get(variant, "$", dtype),
                F.filter(F.array(F.try_variant_get(variant, "$", "string")), lambda x: x.isNotNull()),
            )
            value = F.when(fields[path].isNotNull() & (fields[path] != "null"), value)
        elif dtype in ("int", "bigint"):
            value = F.try_variant_get(variant, "$", "string").try_cast("bigint").try_cast(dtype)
        else:
            value = F.try_variant_get(variant, "$", "string").try_cast(dtype)
        typed[column_of(path)] = value
    checks = [
        F.when(fields[p].isNotNull() & (fields[p] != "null") & F.col(column_of(p)).isNull(), F.lit(p))
        for p in PROMOTED
    ]
    docs = df.withColumns({**typed, TS: event_time})
    day = F.to_date(F.col(TS))
    return docs.select(
        F.concat(F.lit(base) if isinstance(base, str) else base, F.lit("-"), F.date_format(TS, "yyyy.MM.dd")).alias("_index"),
        (F.uuid() if doc_id is None else doc_id).alias("_id"),
        day.alias("_day"),
        TS,
        *typed,
        "fields",
        F.filter(F.array(*checks), lambda p: p.isNotNull()).alias("_malformed"),
        *keep,
    )


# Files of unknown format ------------------------------------------------------------


def json_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """JSON-lines ingest: ``fields`` for accepted lines; ``accepted`` is false for the quarantine."""
    parsed = parse_events(lines.withColumn(column, strip(F.col(column))), column)
    return parsed.withColumn("accepted", F.col("status") == "event").drop("status")


def raw_lines(lines: DataFrame, now: dt.datetime | Column, column: str = "line") -> DataFrame:
    """Raw-line ingest: right-stripped non-blank lines as ``message``, one ingest time for all."""
    stamp = now if isinstance(now, Column) else F.lit(now)
    stripped = lines.withColumn("message", rstrip(F.col(column)))
    return stripped.where(F.col("message") != "").withColumn(TS, stamp)


def detect_format(lines: DataFrame) -> DataFrame:
    """One row per file: ``json`` when its first non-blank line is any JSON value, ``cef`` when
    one of its first five raw lines has a CEF header, else ``other``.

    The five-line head is a per-partition top-k before the shuffle, and the first line
    a mergeable aggregate, so the size of a file does not matter.
    """
    order = W.partitionBy("file").orderBy("line_no")
    head = (
        lines.withColumn("_n", F.row_number().over(order))
        .where("_n <= 5")
        .groupBy("file")
        .agg(F.bool_or(F.col("line").rlike(r"CEF:[0-9]+\|")).alias("_cef"))
    )
    first = lines.where(~blank(F.col("line"))).groupBy("file").agg(F.min_by("line", "line_no").alias("_first"))
    is_json = F.try_parse_json("_first").isNotNull()
    return head.join(first, "file", "left").select(
        "file", F.when(is_json, "json").when(F.col("_cef"), "cef").otherwise("other").alias("format")
    )


def plan_ingest(fmt: Column, pipeline: Column, known: Column) -> Column:
    """Strategy of a file: a known explicit pipeline first, then the detected format.

    ``pipeline:<name>``, ``json``, ``cef`` or an ``error: …`` text.
    """
    direct = F.when(fmt.isin("json", "cef"), fmt)
    return (
        F.when(pipeline.isNotNull() & known, F.concat(F.lit("pipeline:"), pipeline))
        .when(direct.isNotNull(), direct)
        .when(pipeline.isNotNull(), F.concat(F.lit("error: unknown pipeline "), pipeline))
        .otherwise(F.lit("error: text needs a pipeline"))
    )


def dataset_of_file(path: Column) -> Column:
    """Dataset base name of an uploaded file."""
    return F.concat(F.lit("logs-"), safe_base(path))
