"""Queries over the ledger and the shared quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from intakeloom.functions import jsontext
from intakeloom.functions.text import sanitize
from intakeloom.operators import ledger, prompts, quality, search_index, summaries
from intakeloom.plans import oracle_text as o
from intakeloom.plans.registry import joined, query, stamp
from intakeloom.plans.views import view
from intakeloom.session import configure, shared_folder
from intakeloom.sources import tables

LEDGER = o.source("ledger")
_COLUMNS = ["id", "source", "format", "intent", "status", "thread_id", "processing_time"]
_SQL_COLUMNS = ", ".join(_COLUMNS) + f", {o.stamp('timestamp')} AS timestamp"


def _records(spark, folder):
    return ledger.new_records(view(spark, folder, "ledger"))


def _shown(records):
    return records.select(*_COLUMNS, stamp("timestamp").alias("timestamp"))


# ---------------------------------------------------------------------- quality

_USERS = """(SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE ' ' END AS segment,
    CASE WHEN c_nationkey > 12 THEN CAST(c_nationkey AS STRING) END AS nation FROM customer)"""


@query(
    "x02_required_fields",
    f"""SELECT c_custkey, e = 0 AND phone AS is_valid, CASE WHEN phone THEN '' ELSE 'phone' END AS missing_fields,
        concat_ws('|', CASE WHEN trim(segment) = '' THEN 'segment' END,
          CASE WHEN nation IS NULL THEN 'nation' END) AS empty_fields,
        round((1.0 - (CASE WHEN phone THEN e ELSE e + 1 END) / 4.0) *
          (0.5 + 0.5 * CASE WHEN phone THEN (4 - e) / 4.0 ELSE (3 - e) / 3.0 END), 6) AS confidence_score
        FROM (SELECT *, c_custkey % 3 = 0 AS phone,
          CAST(trim(segment) = '' AS INT) + CAST(nation IS NULL AS INT) AS e FROM {_USERS})""",
)
def required_fields(spark, folder):
    c = tables.table(spark, folder, "customer")
    segment = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise(" ")
    nation = F.when(F.col("c_nationkey") > 12, F.col("c_nationkey").cast("string"))
    known = [F.lit("name"), F.col("c_name"), F.lit("segment"), segment, F.lit("nation"), nation]
    phone = [F.lit("phone"), F.lit("+1-555-0100")]
    data = F.when(F.col("c_custkey") % 3 == 0, F.create_map(*known, *phone)).otherwise(
        F.create_map(*known)
    )
    checked = c.select("c_custkey", data.alias("data")).withColumn(
        "_check", quality.validate_fields(F.col("data"), ["name", "segment", "nation", "phone"])
    )
    return checked.select(
        "c_custkey",
        "_check.is_valid",
        joined("_check.missing_fields").alias("missing_fields"),
        joined("_check.empty_fields").alias("empty_fields"),
        F.round("_check.confidence_score", 6).alias("confidence_score"),
    )


_FLAT = "regexp_replace(" + o.trim("text") + ", '\\s+', ' ', 'g')"


@query(
    "x03_sanitize",
    f"""SELECT doc_id, md5(f) AS flat_md5,
        CASE WHEN length(f) > 80 THEN rtrim(left(f, 80)) || '...' ELSE f END AS short
        FROM (SELECT doc_id, {_FLAT} AS f FROM documents)""",
)
def sanitized(spark, folder):
    text = F.col("text")
    return tables.table(spark, folder, "documents").select(
        "doc_id", F.md5(sanitize(text)).alias("flat_md5"), sanitize(text, 80).alias("short")
    )


@query(
    "x04_mean_score",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
       round(greatest(0.0, least(1.0, (l_discount + l_tax + l_quantity / 100) / 3)), 6) AS score
       FROM lineitem""",
)
def mean_score(spark, folder):
    factors = F.create_map(
        F.lit("discount"),
        F.col("l_discount"),
        F.lit("tax"),
        F.col("l_tax"),
        F.lit("quantity"),
        F.col("l_quantity") / 100,
    )
    return tables.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(quality.mean_score(factors), 6).alias("score"),
    )


@query(
    "x05_extraction_prompts",
    """SELECT doc_id, md5('List the names.' || chr(10) || chr(10) || 'Text to process:' || chr(10) ||
       text || chr(10) || chr(10) || 'Extracted information:') AS prompt_md5 FROM documents""",
)
def extraction_prompts(spark, folder):
    prompt = prompts.extraction_prompt(F.col("text"), "List the names.")
    return tables.table(spark, folder, "documents").select(
        "doc_id", F.md5(prompt).alias("prompt_md5")
    )


# ----------------------------------------------------------------------- ledger


@query("l01_record_by_id", f"SELECT {_SQL_COLUMNS} FROM {LEDGER} WHERE id = '77'")
def record_by_id(spark, folder):
    return _shown(ledger.by_id(_records(spark, folder), "77"))


@query(
    "l01_records_by_ids",
    f"SELECT {_SQL_COLUMNS} FROM {LEDGER} WHERE id IN (SELECT CAST(doc_id AS STRING) FROM labels)",
)
def records_by_ids(spark, folder):
    wanted = tables.table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return _shown(ledger.by_ids(_records(spark, folder), wanted))


def _versions(spark, folder):
    """Records, the updates of purchases and the deletions of errors, as written."""
    first = _records(spark, folder)
    later = F.lit("2024-02-01 00:00:00").cast("timestamp")
    changes = first.filter("intent = 'order'").select(
        "id", F.lit("failed").alias("status"), F.lit("late").alias("error_message")
    )
    updated = first.unionByName(ledger.update(first, changes, later))
    errors = first.filter("status = 'ERROR'").select("id")
    return updated, updated.unionByName(ledger.delete(updated, errors, later))


@query(
    "l02_update",
    f"""SELECT id, CASE WHEN intent = 'order' THEN 'failed' ELSE status END AS status,
        CASE WHEN intent = 'order' THEN 'late' ELSE '' END AS error_message,
        CAST(CASE WHEN intent = 'order' THEN 2 ELSE 1 END AS BIGINT) AS version FROM {LEDGER}""",
)
def updated(spark, folder):
    changed, _ = _versions(spark, folder)
    return ledger.latest(changed).select("id", "status", "error_message", "version")


@query(
    "l03_updated_at",
    f"""SELECT id, CASE WHEN intent = 'order' THEN '2024-02-01 00:00:00' ELSE {o.stamp('timestamp')} END
        AS updated_at, {o.stamp('timestamp')} AS created_at FROM {LEDGER}""",
)
def updated_at(spark, folder):
    changed, _ = _versions(spark, folder)
    return ledger.latest(changed).select(
        "id", stamp("updated_at").alias("updated_at"), stamp("created_at").alias("created_at")
    )


@query("l04_delete", f"SELECT id, status <> '' AS kept FROM {LEDGER} WHERE status <> 'ERROR'")
def deleted(spark, folder):
    _, rest = _versions(spark, folder)
    return ledger.latest(rest).select("id", (F.col("status") != "").alias("kept"))


@query(
    "l04_compact_without",
    f"SELECT id, format FROM {LEDGER} WHERE id NOT IN (SELECT CAST(doc_id AS STRING) FROM labels)",
)
def compacted(spark, folder):
    gone = tables.table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return ledger.without(_records(spark, folder), gone).select("id", "format")


@query(
    "l05_clear",
    f"SELECT count(*) AS before_clear, CAST(0 AS BIGINT) AS after_clear FROM {LEDGER}",
)
def cleared(spark, folder):
    path = shared_folder(configure(spark), "cleared")
    ledger.append(_records(spark, folder), path)
    counted = shared_folder(spark, "counted")
    ledger.total(ledger.read(spark, path)).write.parquet(counted)
    ledger.clear(spark, path)
    before = spark.read.parquet(counted).select(F.col("total_records").alias("before_clear"))
    after = ledger.total(ledger.read(spark, path)).select(F.col("total_records").alias("after_clear"))
    return before.join(after, F.lit(True))  # one row each


@query("l06_total", f"SELECT count(*) AS total_records FROM {LEDGER}")
def total(spark, folder):
    return ledger.total(_records(spark, folder))


@query("l07_by_status", f"SELECT {_SQL_COLUMNS} FROM {LEDGER} WHERE status = 'failed'")
def by_status(spark, folder):
    return _shown(ledger.by_status(_records(spark, folder), "failed"))


@query("l08_by_thread", f"SELECT {_SQL_COLUMNS} FROM {LEDGER} WHERE thread_id = '8'")
def by_thread(spark, folder):
    return _shown(ledger.by_thread(_records(spark, folder), "8"))


@query(
    "l08_thread_positions",
    f"""SELECT id, thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY timestamp, id) AS position
        FROM {LEDGER}""",
)
def thread_positions(spark, folder):
    return ledger.with_positions(_records(spark, folder)).select("id", "thread_id", "position")


@query("l08_all_threads", f"SELECT {_SQL_COLUMNS} FROM {LEDGER}")
def all_threads(spark, folder):
    return _shown(ledger.all_threads(_records(spark, folder)))


_NEWEST = "ORDER BY l.timestamp DESC, l.id DESC"


@query("l09_recent", f"SELECT {_SQL_COLUMNS} FROM {LEDGER} l {_NEWEST} LIMIT 50")
def recent(spark, folder):
    return _shown(ledger.recent(_records(spark, folder)))


def _count(name: str, column: str):
    @query(name, f"SELECT {column}, count(*) AS count FROM {LEDGER} GROUP BY {column}")
    def run(spark, folder):
        return ledger.count_by(_records(spark, folder), column)


_count("l10_count_by_status", "status")
_count("l11_count_by_format", "format")
_count("l12_count_by_intent", "intent")

_MEAN = "coalesce(round(avg(CASE WHEN processing_time > 0 THEN processing_time END), 2), 0.0)"


@query("l13_average_time", f"SELECT {_MEAN} AS avg_processing_time FROM {LEDGER}")
def average_time(spark, folder):
    return ledger.average_time(_records(spark, folder))


@query(
    "l14_statistics",
    f"""SELECT 'total' AS facet, CAST(NULL AS STRING) AS value, count(*) AS count,
          {_MEAN} AS avg_processing_time FROM {LEDGER}
        UNION ALL SELECT 'status', status, count(*), NULL FROM {LEDGER} GROUP BY status
        UNION ALL SELECT 'format', format, count(*), NULL FROM {LEDGER} GROUP BY format
        UNION ALL SELECT 'intent', intent, count(*), NULL FROM {LEDGER} GROUP BY intent""",
)
def statistics(spark, folder):
    return ledger.statistics(_records(spark, folder))


_CHANGED = f"""(SELECT * REPLACE (CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'reviewed' ELSE status END AS status,
    CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 2.5 ELSE processing_time END AS processing_time)
    FROM {LEDGER} WHERE CAST(id AS BIGINT) % 7 <> 0)"""


@query(
    "l14_summaries",
    f"""SELECT 'total' AS facet, CAST(NULL AS STRING) AS value, count(*) AS count, {_MEAN} AS avg_processing_time FROM {_CHANGED}
        UNION ALL SELECT 'status', status, count(*), NULL FROM {_CHANGED} GROUP BY status
        UNION ALL SELECT 'format', format, count(*), NULL FROM {_CHANGED} GROUP BY format
        UNION ALL SELECT 'intent', intent, count(*), NULL FROM {_CHANGED} GROUP BY intent""",
)
def summarised(spark, folder):
    """Statistics from each batch's differences, after updates and deletions, one batch written twice."""
    path = shared_folder(configure(spark), "summarised")
    paths = f"{path}/ledger", f"{path}/summaries"
    at = F.lit("2024-06-01 00:00:00").cast("timestamp")
    summaries.append(_records(spark, folder), *paths, "first")
    whole = ledger.read(spark, paths[0])
    change = whole.where("CAST(id AS BIGINT) % 5 = 0").select(
        "id", F.lit("reviewed").alias("status"), F.lit(2.5).cast("double").alias("processing_time")
    )
    changed = ledger.update(whole, change, at)
    for _ in range(2):
        summaries.append(changed, *paths, "second")
    gone = whole.where("CAST(id AS BIGINT) % 7 = 0").select("id")
    summaries.append(ledger.delete(ledger.read(spark, paths[0]), gone, at), *paths, "third")
    return summaries.statistics(summaries.read(spark, paths[1]))


def _search(name: str, wanted: str, pattern: str):
    hits = " OR ".join(
        f"{c} ILIKE {o.lit(pattern)}" for c in ("source", "intent", "extracted_fields", "sender")
    )

    @query(name, f"SELECT {_SQL_COLUMNS} FROM {LEDGER} l WHERE {hits} {_NEWEST} LIMIT 20")
    def run(spark, folder):
        return _shown(ledger.search(_records(spark, folder), wanted))


_search("l15_search", "USER12@", "%USER12@%")
_search("l15_search_wildcard", "k%: _7}", "%k%: _7}%")


def _indexed(spark, folder) -> str:
    """The records as a ledger of two batches with its index; some records are changed by the second."""
    path = shared_folder(configure(spark), "indexed")
    records = _records(spark, folder)
    ledger.append(records, f"{path}/ledger", "first")
    search_index.add(records, f"{path}/index", "first")
    # the second version says what the first did, so the given records stay the measure
    change = records.where("CAST(id AS BIGINT) % 50 = 0").select("id", "source")
    at = F.lit("2024-06-01 00:00:00").cast("timestamp")
    update = ledger.update(ledger.read(spark, f"{path}/ledger"), change, at)
    ledger.append(update, f"{path}/ledger", "second")
    written = ledger.read(spark, f"{path}/ledger").where("version > 1")
    search_index.add(written, f"{path}/index", "second")
    return path


def _search_by_index(name: str, wanted: str, pattern: str):
    hits = " OR ".join(
        f"{c} ILIKE {o.lit(pattern)}" for c in ("source", "intent", "extracted_fields", "sender")
    )

    @query(name, f"SELECT {_SQL_COLUMNS} FROM {LEDGER} l WHERE {hits} {_NEWEST} LIMIT 20")
    def run(spark, folder):
        """The same rows as by the scan, from a ledger with an index of triples."""
        path = _indexed(spark, folder)
        index = search_index.read(spark, f"{path}/index")
        return _shown(search_index.search(ledger.read(spark, f"{path}/ledger"), index, wanted))


_search_by_index("l15_indexed_search", "USER12@", "%USER12@%")
_search_by_index("l15_indexed_search_wildcard", "er7%EXAMPLE_com", "%er7%EXAMPLE_com%")


@query(
    "l16_codec",
    f"""SELECT id, TRY_CAST(extracted_fields->>'$.k' AS BIGINT) AS k, 'normal' AS urgency,
        'pending' AS default_status FROM {LEDGER}""",
)
def codec(spark, folder):
    """Drop some columns, decode with defaults, encode again and read a field."""
    rows = view(spark, folder, "ledger").select(
        "id", "source", "format", "intent", "timestamp", "extracted_fields"
    )
    decoded = ledger.decode(ledger.new_records(rows))
    again = ledger.encode(decoded, "fields")
    value = jsontext.parse(F.col("extracted_fields"))
    return again.select(
        "id",
        jsontext.at(value, "k", "bigint").alias("k"),
        "urgency",
        F.col("status").alias("default_status"),
    )


_LIFE = f"""(SELECT id, v AS version, CASE v WHEN 1 THEN 'pending' WHEN 2 THEN 'processing'
      WHEN 3 THEN CASE WHEN status = 'completed' THEN 'completed' ELSE 'failed' END END AS status
    FROM {LEDGER}, (VALUES (1), (2), (3)) t(v) WHERE v < 3 OR status <> 'pending')"""


@query(
    "l17_transitions",
    f"""SELECT from_status, to_status, count(*) AS records FROM (
        SELECT lag(status) OVER (PARTITION BY id ORDER BY version) AS from_status,
          status AS to_status FROM {_LIFE}) GROUP BY 1, 2""",
)
def transitions(spark, folder):
    """Life of every record: pending, processing, completed or failed."""
    given = view(spark, folder, "ledger")
    outcome = given.select("id", F.col("status").alias("_outcome"), "processing_time")
    first = ledger.new_records(given.withColumn("status", F.lit("pending")))
    at = F.col("timestamp")
    begun = ledger.started(first, at)
    ended = begun.drop("processing_time").join(outcome, "id")
    good = ledger.finished(
        ended.filter("_outcome = 'completed'"), at, "json_agent", F.col("processing_time"), F.lit(1.0)
    )
    bad = ledger.failed(
        ended.filter("_outcome NOT IN ('completed', 'pending')"), at, "email", F.lit("no luck")
    )
    names = ledger.SCHEMA.names
    every = (
        first.unionByName(begun.select(*names))
        .unionByName(good.select(*names))
        .unionByName(bad.select(*names))
    )
    return (
        ledger.transitions(every)
        .groupBy("from_status", "to_status")
        .agg(F.count("*").alias("records"))
    )


@query(
    "l18_listing",
    f"""SELECT id, source, format, intent, {o.stamp('timestamp')} AS timestamp, 'normal' AS urgency,
        extracted_fields, processed_by, thread_id, confidence_score, status, file_size
        FROM {LEDGER} l {_NEWEST} LIMIT 50""",
)
def listing(spark, folder):
    return ledger.listing(_records(spark, folder))


@query(
    "l19_decode_source",
    f"SELECT id, source FROM {LEDGER} UNION ALL SELECT CAST(c_custkey AS STRING), c_mktsegment FROM customer",
)
def decoded_sources(spark, folder):
    """Customer segments spelled as character codes next to plain names."""
    coded = tables.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.array_join(
            F.transform(
                F.split("c_mktsegment", "(?<=.)(?=.)"), lambda c: F.ascii(c).cast("string")
            ),
            ",",
        ).alias("source"),
    )
    both = view(spark, folder, "ledger").select("id", "source").unionByName(coded)
    return both.select("id", ledger.decode_char_codes(F.col("source")).alias("source"))


@query(
    "l20_filter",
    f"SELECT {_SQL_COLUMNS} FROM {LEDGER} WHERE format = 'EMAIL' AND intent = 'rfq'",
)
def filtered(spark, folder):
    return _shown(ledger.filtered(_records(spark, folder), "EMAIL", "rfq"))


@query("l20_filter_all", f"SELECT {_SQL_COLUMNS} FROM {LEDGER} WHERE intent = 'order'")
def filtered_by_intent(spark, folder):
    return _shown(ledger.filtered(_records(spark, folder), intent="order"))


@query(
    "l21_filter_options",
    f"""SELECT DISTINCT 'format' AS facet, format AS value FROM {LEDGER}
        UNION SELECT DISTINCT 'intent', intent FROM {LEDGER}""",
)
def filter_options(spark, folder):
    return ledger.filter_options(_records(spark, folder))


@query(
    "l22_dashboard",
    f"""SELECT count(*) AS total_records,
        count(*) FILTER (status = 'completed') AS successful_processes,
        count(*) FILTER (status IN ('failed', 'error', 'ERROR')) AS failed_processes,
        round(count(*) FILTER (status = 'completed') * 100.0 / count(*), 1) AS success_rate FROM {LEDGER}""",
)
def dashboard(spark, folder):
    return ledger.dashboard(_records(spark, folder))
