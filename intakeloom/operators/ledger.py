"""The ledger: an append-only table of processing records and its queries.

A record is one row per version.  An update appends the next version, a delete
appends a tombstone, and :func:`latest` shows what is current.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intakeloom import fixed_values as fv
from intakeloom.functions import jsontext
from intakeloom.functions.text import decode_char_codes
from intakeloom.session import shared_folder

SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("format", T.StringType(), False),
        T.StructField("intent", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("sender", T.StringType()),
        T.StructField("urgency", T.StringType()),
        T.StructField("extracted_fields", T.StringType()),
        T.StructField("processed_by", T.StringType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("processing_time", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("version", T.LongType()),
        T.StructField("is_deleted", T.BooleanType()),
    ]
)


# ------------------------------------------------------------ writing records

# Ids are hashes, so every file's least and greatest id span all of them; a Bloom filter
# in each row group tells which files cannot hold an id that is looked for.
BY_ID = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled#id": "true"}



def record_id(source: Column, content_hash: Column, received_at: Column) -> Column:
    """A key that needs no counter: hash of source, content and arrival."""
    return F.sha2(
        F.concat_ws("\x1f", source, content_hash, F.unix_micros(received_at).cast("string")), 256
    )


def new_records(rows: DataFrame) -> DataFrame:
    """Complete rows to the ledger schema: defaults, first version, not deleted.

    Rows need ``id, source, format, intent, timestamp``; other ledger columns
    are taken when present.
    """
    columns = []
    for field in SCHEMA.fields:
        name = field.name
        if name in rows.columns:
            value = F.col(name)
            if name in fv.LEDGER_DEFAULTS:
                value = F.coalesce(value, F.lit(fv.LEDGER_DEFAULTS[name]))
        elif name in ("created_at", "updated_at"):
            value = F.col("timestamp")
        elif name == "version":
            value = F.lit(1)
        elif name == "is_deleted":
            value = F.lit(False)
        else:
            value = F.lit(fv.LEDGER_DEFAULTS[name])
        columns.append(value.cast(field.dataType).alias(name))
    return rows.select(*columns)


def append(records: DataFrame, path: str, batch: str | None = None) -> None:
    """Add records to the Parquet ledger as a batch of their own, one folder per format.

    A batch of the same name is replaced, so writing it again after a failure
    adds nothing; without a name it is a new one.
    """
    name = batch or uuid.uuid4().hex
    writer = records.write.mode("overwrite").partitionBy("format").options(**BY_ID)
    writer.parquet(f"{path}/batch={name}")


def read(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    """All records, whether a stream or a batch job wrote them; ``but`` names a batch to leave out."""
    schema = T.StructType([*SCHEMA.fields, T.StructField("batch", T.StringType())])
    rows = spark.read.schema(schema).parquet(path)
    return (rows if but is None else rows.where(F.col("batch") != but)).drop("batch")


def clear(spark: SparkSession, path: str) -> None:
    """Empty the ledger: overwrite it with no rows."""
    (
        spark.createDataFrame([], T.StructType([*SCHEMA.fields, T.StructField("batch", T.StringType())]))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("batch", "format")
        .parquet(path)
    )


def compact(ledger: DataFrame, path: str) -> None:
    """Write the current records, sorted by id within each file, as a ledger of their own.

    The ledger read and ``path`` must differ; readers change over when it is done.
    Sorted files let a search for an id skip what cannot hold it.
    """
    current = latest(ledger).repartitionByRange("format", "id").sortWithinPartitions("format", "id")
    append(current, path, "compacted")


# ------------------------------------------------- versions, updates, deletions


def latest(ledger: DataFrame) -> DataFrame:
    """Current version of every record that is not deleted.

    Only records that were changed have versions above 1, so the highest
    version is computed from those rows alone - two narrow columns, combined
    before the shuffle - and joined back.  While changes are few the joined
    side is small and adaptive execution broadcasts it; when it is not, a hot
    record is split by the adaptive skew join.
    """
    changed = (
        ledger.filter("version > 1")
        .groupBy("id")
        .agg(F.max("version").alias("_newest"))
    )
    return (
        ledger.join(changed, "id", "left")
        .filter("version = coalesce(_newest, version)")
        .filter("NOT is_deleted")
        .drop("_newest")
    )


def _of(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the given ids: keys are matched before anything else moves."""
    return ledger.join(ids.select("id").distinct(), "id", "left_semi")


def update(ledger: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """Next versions of the records named by ``changes``.

    Columns of ``changes`` replace the record's own; ids that are unknown or
    deleted change nothing.  Of several changes for an id the greatest by value
    counts.  Append the result to the ledger.
    """
    new = [c for c in changes.columns if c != "id"]
    one = changes.groupBy("id").agg(F.max(F.struct(*new)).alias("_new"))
    replaced = {c: F.col(f"_new.{c}").cast(SCHEMA[c].dataType) for c in new}
    return (
        latest(_of(ledger, changes))
        .join(one, "id")
        .withColumns({**replaced, "updated_at": at, "version": F.col("version") + 1})
        .select(*SCHEMA.names)
    )


def delete(ledger: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Tombstones for the given ids; append them to the ledger."""
    return (
        latest(_of(ledger, ids))
        .withColumns({"updated_at": at, "version": F.col("version") + 1, "is_deleted": F.lit(True)})
        .select(*SCHEMA.names)
    )


def without(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """Current records except the given ids, as a compaction job writes them."""
    return latest(ledger).join(ids.select("id"), "id", "left_anti")


def started(records: DataFrame, at: Column) -> DataFrame:
    """Version that marks work on pending records as begun."""
    return _next(records, at, {"status": F.lit("processing")})


def finished(
    records: DataFrame, at: Column, agent: str, seconds: Column, confidence: Column
) -> DataFrame:
    """Version after success: agent, time and confidence are recorded."""
    return _next(
        records,
        at,
        {
            "status": F.lit("completed"),
            "processed_by": F.lit(agent),
            "processing_time": seconds,
            "confidence_score": confidence,
        },
    )


def failed(records: DataFrame, at: Column, agent: str, message: Column) -> DataFrame:
    """Version after failure; an empty message leaves the old one in place."""
    text = F.when(F.length(message) > 0, message).otherwise(F.col("error_message"))
    return _next(
        records,
        at,
        {"status": F.lit("failed"), "processed_by": F.lit(agent), "error_message": text},
    )


def _next(records: DataFrame, at: Column, values: dict[str, Column]) -> DataFrame:
    return records.withColumns({**values, "updated_at": at, "version": F.col("version") + 1})


def transitions(ledger: DataFrame) -> DataFrame:
    """Each version with the status before it.

    Versions of a record count up by one, so the previous row is an equality
    join on id and version: rows of one record spread over all partitions
    instead of meeting in one window.
    """
    before = ledger.select(
        "id", (F.col("version") + 1).alias("version"), F.col("status").alias("from_status")
    )
    return (
        ledger.select("id", "version", F.col("status").alias("to_status"), "updated_at")
        .join(before, ["id", "version"], "left")
        .select("id", "version", "from_status", "to_status", "updated_at")
    )


# --------------------------------------------------------------------- queries


def by_id(ledger: DataFrame, record: str) -> DataFrame:
    """The record of an id: the files' Bloom filters leave out most row groups."""
    return latest(ledger.filter(F.col("id") == record))


def by_ids(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    return latest(_of(ledger, ids))


def by_status(records: DataFrame, status: str) -> DataFrame:
    return records.filter(F.col("status") == status).orderBy(F.desc("timestamp"), F.desc("id"))


def by_thread(records: DataFrame, thread: str) -> DataFrame:
    return records.filter(F.col("thread_id") == thread).orderBy("timestamp", "id")


def all_threads(records: DataFrame) -> DataFrame:
    """Every thread, oldest record first: one range sort, which splits hot threads."""
    return records.orderBy("thread_id", "timestamp", "id")


def with_positions(records: DataFrame) -> DataFrame:
    """Each record with its ``position`` in its thread, from 1, oldest first.

    One range sort over thread, time and id deals records to tasks, so a thread
    of any length, and a single busy moment of it, spreads over many; a record's
    position is its place in its range plus the thread's records in the ranges
    before.  The sorted records are written to the shared folder, so that both
    sides see the same ranges.
    """
    spark = records.sparkSession
    order = ["thread_id", "timestamp", "id"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = records.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("_number", F.monotonically_increasing_id())
    path = shared_folder(spark, "positions")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    piece = F.shiftright("_number", 33)
    pieces = dealt.groupBy(F.col("thread_id").alias("_thread"), piece.alias("_piece")).agg(
        F.min("_number").alias("_first"), F.count("*").alias("_rows")
    )
    before = Window.partitionBy("_thread").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1
    shifts = pieces.select("_thread", "_piece", shift.alias("_shift"))
    met = F.col("thread_id").eqNullSafe(F.col("_thread")) & (piece == F.col("_piece"))
    position = (F.col("_number") + F.col("_shift")).alias("position")
    return dealt.join(shifts, met).select(*records.columns, position)


def recent(records: DataFrame, limit: int = fv.RECENT_LIMIT) -> DataFrame:
    return records.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def search(records: DataFrame, query: str, limit: int = fv.SEARCH_LIMIT) -> DataFrame:
    """Newest records that contain the query, case ignored; ``%`` and ``_`` are wildcards."""
    pattern = "%" + query.replace("\\", "\\\\") + "%"
    hits = [F.col(c).ilike(pattern) for c in ("source", "intent", "extracted_fields", "sender")]
    return recent(records.filter(reduce(lambda a, b: a | b, hits)), limit)


def total(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("total_records"))


def count_by(records: DataFrame, column: str) -> DataFrame:
    return records.groupBy(column).agg(F.count("*").alias("count"))


def mean_time() -> Column:
    """Mean of the positive processing times to two places, 0 when there is none."""
    positive = F.when(F.col("processing_time") > 0, F.col("processing_time"))
    return F.coalesce(F.round(F.avg(positive), 2), F.lit(0.0))


def average_time(records: DataFrame) -> DataFrame:
    return records.agg(mean_time().alias("avg_processing_time"))


def statistics(records: DataFrame) -> DataFrame:
    """Total, counts by status, format and intent, and mean time in one pass.

    One row per value: ``facet`` says what is counted, ``value`` is null for
    the total, which alone has ``avg_processing_time``.
    """
    facets = ["status", "format", "intent"]
    grouped = records.groupingSets(
        [[F.col(f)] for f in facets] + [[]], *[F.col(f) for f in facets]
    ).agg(
        F.count("*").alias("count"),
        mean_time().alias("_mean"),
        F.grouping_id(*facets).alias("_set"),
    )
    # grouping_id has a 0 bit for the facet that is kept
    kept = {3: "status", 5: "format", 6: "intent"}
    facet = F.lit("total")
    value = F.lit(None).cast("string")
    for set_id, name in kept.items():
        facet = F.when(F.col("_set") == set_id, name).otherwise(facet)
        value = F.when(F.col("_set") == set_id, F.col(name)).otherwise(value)
    counted = grouped.select(
        facet.alias("facet"),
        value.alias("value"),
        "count",
        F.when(F.col("_set") == 7, F.col("_mean")).alias("avg_processing_time"),
    )
    # grouping sets give no total for an empty ledger, so a zero is added in
    zero = records.sparkSession.range(1).select(
        F.lit("total").alias("facet"),
        F.lit(None).cast("string").alias("value"),
        F.lit(0).cast("bigint").alias("count"),
        F.lit(0.0).alias("avg_processing_time"),
    )
    return (
        counted.unionByName(zero)
        .groupBy("facet", "value")
        .agg(
            F.sum("count").alias("count"), F.max("avg_processing_time").alias("avg_processing_time")
        )
    )


def dashboard(records: DataFrame) -> DataFrame:
    """Totals and success rate in percent."""
    done = F.count_if(F.col("status").isin(fv.SUCCESS_STATUSES))
    lost = F.count_if(F.col("status").isin(fv.FAILURE_STATUSES))
    count = F.count("*")
    return records.agg(
        count.alias("total_records"),
        done.alias("successful_processes"),
        lost.alias("failed_processes"),
        F.when(count > 0, F.round(done * 100.0 / F.nullif(count, F.lit(0)), 1))
        .otherwise(F.lit(0.0))
        .alias("success_rate"),
    )


def listing(records: DataFrame, limit: int = fv.RECENT_LIMIT) -> DataFrame:
    """The log view: newest first, inner columns hidden, time and source readable."""
    return recent(records, limit).select(
        "id",
        decode_char_codes(F.col("source")).alias("source"),
        "format",
        "intent",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "urgency",
        "extracted_fields",
        "processed_by",
        "thread_id",
        "confidence_score",
        "status",
        "file_size",
    )


def filtered(records: DataFrame, fmt: str = "All", intent: str = "All") -> DataFrame:
    if fmt != "All":
        records = records.filter(F.col("format") == fmt)
    if intent != "All":
        records = records.filter(F.col("intent") == intent)
    return records


def filter_options(records: DataFrame) -> DataFrame:
    """Distinct formats and intents from one pass over the records."""
    return (
        records.select(
            F.explode(
                F.array(
                    F.struct(F.lit("format").alias("facet"), F.col("format").alias("value")),
                    F.struct(F.lit("intent").alias("facet"), F.col("intent").alias("value")),
                )
            ).alias("option")
        )
        .select("option.*")
        .distinct()
    )


# ----------------------------------------------------------------------- codec


def encode(rows: DataFrame, fields: str) -> DataFrame:
    """Struct or map column to the JSON text the ledger stores."""
    return rows.withColumn(
        "extracted_fields", F.to_json(F.col(fields), {"ignoreNullFields": "false"})
    )


def decode(ledger: DataFrame) -> DataFrame:
    """Ledger rows with defaults filled in and ``fields`` as ``map<string, variant>``.

    Text that is not JSON counts as no fields.
    """
    defaults = {
        name: F.coalesce(F.col(name), F.lit(value).cast(SCHEMA[name].dataType))
        for name, value in fv.LEDGER_DEFAULTS.items()
        if name != "extracted_fields"
    }
    empty = F.create_map().cast("map<string,variant>")
    return ledger.withColumns(
        {
            **defaults,
            "fields": F.coalesce(
                jsontext.fields(jsontext.parse(F.col("extracted_fields"))), empty
            ),
        }
    )
