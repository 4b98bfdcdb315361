"""File admission: scan metadata, size and type checks, names, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intakeloom import fixed_values as fv
from intakeloom.functions import names
from intakeloom.functions.text import strip

MB = 1024 * 1024


def file_info(
    files: DataFrame, name: str = "source", size: str = "file_size", modified: str = "modified"
) -> DataFrame:
    """Name, size, size in MB, extension, MIME type, text or binary, time of change."""
    base = names.base_name(F.col(name))
    mime = names.mime_type(base)
    is_text = F.coalesce(F.startswith(mime, F.lit("text/")), F.lit(False))
    return files.select(
        base.alias("name"),
        F.col(size).alias("size"),
        F.round(F.col(size) / MB, 2).alias("size_mb"),
        names.extension(base).alias("extension"),
        mime.alias("mime_type"),
        is_text.alias("is_text"),
        (~is_text).alias("is_binary"),
        F.col(modified).alias("modified"),
    )


def check_files(
    files: DataFrame,
    expected_type: str | Column | None = None,
    name: str = "source",
    size: str = "file_size",
    max_mb: float = fv.MAX_FILE_MB,
) -> DataFrame:
    """Add file type, MIME type, the list of errors, ``valid`` (no errors) and ``reason``.

    The reason is the first error's kind, '' for none: ``too_large``, ``empty``,
    ``extension`` or ``type``.
    """
    base = names.base_name(F.col(name))
    found = names.file_type(base)
    exceeds = F.format_string(f"File size (%.1fMB) exceeds limit ({max_mb:g}MB)", F.col(size) / MB)
    refused = F.concat(F.lit("File extension '"), names.extension(base), F.lit("' not allowed"))
    tests = {
        "too_large": (F.col(size) > max_mb * MB, exceeds),
        "empty": (F.col(size) == 0, F.lit("File is empty")),
        "extension": (found.isNull(), refused),
    }
    if expected_type is not None:
        wanted = F.lit(expected_type) if isinstance(expected_type, str) else expected_type
        other = F.concat(F.lit("Expected "), wanted, F.lit(" file, but detected "), found)
        tests["type"] = (found != wanted, other)
    kinds = [F.when(test, F.lit(kind)) for kind, (test, _) in tests.items()]
    messages = [F.when(test, message) for test, message in tests.values()]
    return files.withColumns(
        {
            "file_type": found,
            "mime_type": names.mime_type(base),
            "errors": F.array_compact(F.array(*messages)),
            "reason": F.coalesce(*kinds, F.lit("")),
        }
    ).withColumn("valid", F.col("reason") == "")


def admitted(checked: DataFrame) -> DataFrame:
    return checked.filter("valid")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter("NOT valid")


def quarantine(checked: DataFrame, path: str, batch: str) -> None:
    """Write what is known of refused files, one folder for each reason.

    The tests read names and sizes alone, so no content is read for it.  A batch
    of the same name is replaced.  A scan has a partition for every few dozen files;
    they are tested and written by no more tasks than a shuffle has, as each task
    writes a file for each reason.
    """
    known = quarantined(checked).select("doc_id", "source", "file_size", "file_type", "mime_type", "errors", "reason")
    tasks = int(checked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known.coalesce(tasks).write.mode("overwrite").partitionBy("reason").parquet(f"{path}/batch={batch}")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """All refused files with the reason and the batch they came in."""
    schema = (
        "doc_id string, source string, file_size bigint, file_type string, mime_type string, "
        "errors array<string>, batch string, reason string"
    )
    return spark.read.schema(schema).parquet(path)


def expired(
    files: DataFrame, now: Column, hours: float = fv.RETENTION_HOURS, modified: str = "modified"
) -> DataFrame:
    """Files strictly older than the retention time at ``now``."""
    age = F.unix_micros(now) - F.unix_micros(F.col(modified))
    return files.filter(age > int(hours * 3600 * 1_000_000))


def stored_names(
    files: DataFrame, at: Column, name: str = "source", content: str = "content"
) -> DataFrame:
    """Content hash and the collision-free name a file is stored under."""
    return files.withColumns(
        {
            "content_md5": F.md5(F.col(content)),
            "stored_name": names.hashed_name(F.col(name), at, F.col(content)),
        }
    )


def stamped_sources(files: DataFrame, at: Column, name: str = "source") -> DataFrame:
    return files.withColumn(name, names.stamped_name(F.col(name), at))


def pasted_text(texts: DataFrame, at: Column, text: str = "text") -> DataFrame:
    """Inline text as a document: blank text is refused, the name ends in ``.txt``."""
    return texts.filter(F.length(strip(F.col(text))) > 0).withColumns(
        {
            "source": F.concat(
                F.lit("pasted_content_"), F.date_format(at, names.STAMP), F.lit(".txt")
            ),
            "file_size": F.octet_length(F.col(text)).cast("bigint"),
        }
    )
