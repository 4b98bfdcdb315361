"""Documents arrive, are classified, extracted and recorded as they come.

The stream runs the batch plan unchanged and keeps no state, unless documents
delivered twice are to be recorded once: then the hashes of what came within a
watermark are the state.  Each batch is written under a name made of the checkpoint and
the batch's number: a restart that repeats it replaces what it wrote, and batch
jobs add their own changes to the same ledger.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from intakeloom.operators import ledger
from intakeloom.plans.intake import intake_facts, intake_outcomes, ledger_rows, route_and_extract


def record_stream(
    docs: DataFrame,
    received_at: Column,
    ledger_path: str,
    checkpoint_path: str,
    key: str = "doc_id",
    source: str = "source",
    keep: list[str] | None = None,
    once_within: str | None = None,
    facts_path: str | None = None,
    **plan: object,
) -> StreamingQuery:
    """Start a query that appends a ledger record per arriving document.

    It takes what is there and stops (``availableNow``); schedule it again for
    what arrived since.  Paths belong into a folder all executors share.

    With ``once_within``, an interval of received time, a document of the same
    source and content that comes again within it adds no record, also in a
    later batch or a later run.  Only outcomes are compared and kept, never
    texts; state older than the interval is dropped.

    With ``facts_path`` the facts of a batch are written there, never texts, and
    its records are made from them, so that a :func:`reply_stream` need not extract
    them again (:func:`kept_facts`).  It takes no reply tables then.
    """
    arrived = docs.withColumn("_received_at", received_at)
    held = [source, "_received_at", *(keep or [])]
    extract = route_and_extract if facts_path is None else intake_facts
    results = extract(arrived, key=key, keep=held, **plan)
    if once_within is not None:
        timed = results.withWatermark("_received_at", once_within)
        results = timed.dropDuplicatesWithinWatermark([source, "content_md5"])
    name = md5(checkpoint_path.encode()).hexdigest()
    attaches = plan.get("attachment_pages") is not None

    def record(rows: DataFrame, number: int) -> None:
        batch = f"{name}-{number}"
        if facts_path is not None:
            rows.write.mode("overwrite").parquet(f"{facts_path}/batch={batch}")
            rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{facts_path}/batch={batch}")
            rows = intake_outcomes(rows.withColumns(_reply()), key, held, attaches)
        ledger.append(ledger_rows(rows, F.col("_received_at"), key, source), ledger_path, batch)

    return (
        results.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .foreachBatch(record)
        .start()
    )


def kept_facts(spark: SparkSession, facts_path: str) -> DataFrame:
    """The facts :func:`record_stream` keeps, as a stream."""
    schema = spark.read.parquet(facts_path).schema
    return spark.readStream.schema(schema).parquet(facts_path).drop("batch")


def _reply(kind: str | None = None, response: Column | None = None) -> dict[str, Column]:
    """The three columns of replies: null, but for the kind that is given."""
    none = F.lit(None).cast("string")
    return {k: response if k == kind else none for k in ("intent_reply", "mail_reply", "page_reply")}


#: State of joined streams grows with what may still meet: it lies in files below the checkpoint, of which an
#: executor holds this many MB in memory, not in its heap as a whole.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
}

#: Columns of a record that a reply may change.
REPLIED = ["intent", "extracted_fields", "confidence_score", "status", "error_message"]


def reply_stream(
    docs: DataFrame,
    received_at: Column,
    replies: DataFrame,
    ledger_path: str,
    checkpoint_path: str,
    within: str,
    kind: str = "mail_reply",
    key: str = "doc_id",
    source: str = "source",
    keep: list[str] | None = None,
    extracted: bool = False,
    **plan: object,
) -> StreamingQuery:
    """Start a query that changes records when replies to their documents arrive, in whatever batch.

    ``docs`` is the stream :func:`record_stream` records or, with ``extracted``,
    that of the facts it kept, ``replies`` a stream of ``key, response, replied_at``.  Both wait for each other for the interval
    ``within``: facts about documents (never texts) and replies are the state of
    a join, and what is older than the watermark is dropped.  ``kind`` is
    ``intent_reply``, ``mail_reply`` or ``page_reply``.

    A record is changed once: the first reply that meets its document counts,
    further ones within the interval are dropped, and a batch that is repeated
    replaces what it wrote.
    """
    held = [source, "_received_at", *(keep or [])]
    if not extracted:
        docs = intake_facts(docs.withColumn("_received_at", received_at), key=key, keep=held, **plan)
    facts = docs.withWatermark("_received_at", within)
    came = replies.select(
        F.col(key).alias("_reply_to"), F.col("response").alias("_response"), F.col("replied_at").alias("_replied_at")
    ).withWatermark("_replied_at", within)
    interval = F.expr(f"INTERVAL {within}")
    met = (
        (F.col(key) == F.col("_reply_to"))
        & (F.col("_replied_at") >= F.col("_received_at"))
        & (F.col("_replied_at") <= F.col("_received_at") + interval)
    )
    # a stream has one event time, here the document's
    answered = facts.join(came, met).drop("_replied_at", "_reply_to").dropDuplicatesWithinWatermark([key])
    answered = answered.withColumns(_reply(kind, F.col("_response")))
    results = intake_outcomes(answered, key, held)
    records = ledger_rows(results, F.col("_received_at"), key, source)
    name = md5(checkpoint_path.encode()).hexdigest()

    def change(rows: DataFrame, number: int) -> None:
        # what this very batch wrote before a failure is not what it changes
        before = ledger.read(rows.sparkSession, ledger_path, but=f"{name}-{number}")
        # an update reads its changes more than once: kept, so that the state is joined once a batch
        came = rows.select("id", *REPLIED).persist()
        try:
            came.count()  # every partition, as each has state to commit
            ledger.append(ledger.update(before, came, F.current_timestamp()), ledger_path, f"{name}-{number}")
        finally:
            came.unpersist()

    # a query takes its settings when it starts, one that goes on has those it began with in its checkpoint
    conf = docs.sparkSession.conf
    before = {name: conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        conf.set(name, value)
    try:
        return (
            records.writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint_path)
            .trigger(availableNow=True)
            .foreachBatch(change)
            .start()
        )
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
