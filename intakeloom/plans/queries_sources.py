"""Queries over sources, sinks and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intakeloom import fixed_values as fv
from intakeloom.functions import names
from intakeloom.functions.text import decode, decode_lossy, text_encoding
from intakeloom.operators import admission, json_docs, ledger
from intakeloom.plans import oracle_text as o
from intakeloom.plans.intake import intake_of_files
from intakeloom.plans.queries_classify import intake_sql
from intakeloom.plans.registry import joined, query, stamp
from intakeloom.plans.views import view
from intakeloom.session import configure, shared_folder
from intakeloom.sources import files, tables
from intakeloom.streaming.intake import record_stream

FILES = o.source("files")
NOW = "2024-01-08 00:00:00"
_STAMP = "strftime(modified, '%Y%m%d_%H%M%S')"
_STEM = "regexp_replace(source, '\\.[^./]*$', '')"
_TAIL = "regexp_extract(source, '\\.[^./]*$')"


UPLOADS = o.source("uploads")
# Latin-1 where it can hold the text and ASCII cannot, else UTF-8.
_LATIN = r"(regexp_matches(text, '[^\x{00}-\x{7F}]') AND NOT regexp_matches(text, '[^\x{00}-\x{FF}]'))"
_SIZED = f"(SELECT *, {_LATIN} AS latin, CAST(CASE WHEN {_LATIN} THEN length(text) ELSE strlen(text) END AS BIGINT) AS file_size FROM {UPLOADS})"
_PAGED = "regexp_matches(source, '[.]pdf$')"


def _uploaded(spark, folder) -> str:
    """The uploads written as files, some in Latin-1; the folder they are in."""
    text = F.col("text")
    latin = F.rlike(text, F.lit(r"[^\x00-\x7f]")) & ~F.rlike(text, F.lit(r"[^\x00-\xff]"))
    content = F.when(latin, F.encode(text, "ISO-8859-1")).otherwise(text.cast("binary"))
    path = shared_folder(configure(spark), "uploads")
    files.write_files(view(spark, folder, "uploads").withColumn("content", content), path)
    return path


@query(
    "s01_file_scan",
    f"""SELECT source, {o.extension('source')} AS ext, CASE WHEN {_PAGED} THEN 'binary' ELSE 'text' END AS content_type,
        file_size, CASE WHEN NOT {_PAGED} THEN CASE WHEN latin THEN 'latin-1' ELSE 'utf-8' END END AS encoding,
        CASE WHEN NOT {_PAGED} THEN md5(text) END AS text_md5 FROM {_SIZED}""",
)
def file_scan(spark, folder):
    """Files written from the documents, scanned as bytes; texts are decoded."""
    found = files.with_text(files.scan(configure(spark), _uploaded(spark, folder), with_empty=True))
    return found.select(
        "source", "ext", "content_type", "file_size", "encoding", F.md5("text").alias("text_md5")
    )


# Small enough for some of the given documents to exceed it.
_MOST_MB = 0.01
_REASON = f"""CASE WHEN file_size > {_MOST_MB} * 1048576 THEN 'too_large' WHEN file_size = 0 THEN 'empty'
    WHEN {o.case_map(o.extension('source'), fv.FILE_TYPE_BY_EXTENSION)} IS NULL THEN 'extension'
    WHEN regexp_matches(source, '7[.]json$') THEN 'type' ELSE '' END"""
_ADMITTED = o.detected(f"(SELECT doc_id, source, text, CAST(NULL AS STRING) AS known FROM {_SIZED} WHERE {_REASON} = '')")


def _files_taken_in(spark, folder, quarantine: str):
    found = files.scan(configure(spark), _uploaded(spark, folder), with_empty=True)
    paged = view(spark, folder, "uploads").where("source LIKE '%.pdf' AND text <> ''").select(
        F.col("text").cast("binary").alias("utf8"), "text"
    )
    latin = F.rlike("text", F.lit(r"[^\x00-\x7f]")) & ~F.rlike("text", F.lit(r"[^\x00-\xff]"))
    content = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.col("utf8"))
    paged = paged.select(F.md5(content).alias("content_md5"), "text")
    # a list of a kind of its own is expected to be a table of pages
    wanted = F.when(F.rlike("source", F.lit("7[.]json$")), "pdf")
    return intake_of_files(found, quarantine, "uploads", paged, wanted, max_mb=_MOST_MB)


@query(
    "s04_admitted_intake",
    f"""SELECT u.source, i.format, i.route, i.intent, i.success, round(i.confidence_score, 6) AS confidence_score
        FROM {intake_sql(_ADMITTED)} i JOIN {UPLOADS} u ON u.doc_id = i.doc_id""",
)
def admitted_intake(spark, folder):
    """Files from the scan over admission to the outcome of the whole intake."""
    results = _files_taken_in(spark, folder, shared_folder(configure(spark), "quarantine"))
    return results.select(
        "source", "format", "route", "intent", "success", F.round("confidence_score", 6).alias("confidence_score")
    )


@query(
    "s04_quarantine",
    f"SELECT reason, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM (SELECT {_REASON} AS reason, file_size FROM {_SIZED}) WHERE reason <> '' GROUP BY reason",
)
def quarantined_files(spark, folder):
    """Files refused on the way in, read back from the quarantine by reason."""
    path = shared_folder(configure(spark), "quarantine")
    _files_taken_in(spark, folder, path)
    kept = admission.read_quarantine(spark, path)
    return kept.groupBy("reason").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def _encoded(spark, folder) -> DataFrame:
    """Document texts as bytes, Latin-1 where it can hold them and ASCII cannot."""
    docs = tables.table(spark, folder, "documents").select("doc_id", "text")
    text = F.col("text")
    latin = F.rlike(text, F.lit(r"[^\x00-\x7f]")) & ~F.rlike(text, F.lit(r"[^\x00-\xff]"))
    return docs.select(
        "doc_id",
        F.when(latin, F.encode(text, "ISO-8859-1"))
        .otherwise(text.cast("binary"))
        .alias("content"),
    )


@query(
    "s02_decode",
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[^\x{00}-\x{7F}]')
          AND NOT regexp_matches(text, '[^\x{00}-\x{FF}]') THEN 'latin-1' ELSE 'utf-8' END AS encoding,
          md5(text) AS text_md5 FROM documents""",
)
def decoding(spark, folder):
    content = F.col("content")
    return _encoded(spark, folder).select(
        "doc_id",
        text_encoding(content).alias("encoding"),
        F.md5(decode(content)).alias("text_md5"),
    )


@query("s03_lossy_decode", "SELECT doc_id, md5(text || '(') AS text_md5 FROM documents")
def lossy(spark, folder):
    broken = tables.table(spark, folder, "documents").select(
        "doc_id",
        F.concat(
            F.lit(b"\xff"), F.col("text").cast("binary"), F.lit(b"\xc3\x28")
        ).alias("content"),
    )
    return broken.select("doc_id", F.md5(decode_lossy(F.col("content"))).alias("text_md5"))


_TYPE = o.case_map(o.extension("source"), fv.FILE_TYPE_BY_EXTENSION)
_MIME = o.case_map(o.extension("source"), fv.MIME_BY_EXTENSION)


@query(
    "s04_admission",
    f"""SELECT doc_id, file_type, valid, errors FROM (SELECT *, errors = '' AS valid FROM (
      SELECT *, array_to_string(list_filter([
        CASE WHEN file_size > 26214400 THEN
          format('File size ({{:.1f}}MB) exceeds limit (25MB)', file_size / 1024.0 / 1024) END,
        CASE WHEN file_size = 0 THEN 'File is empty' END,
        CASE WHEN file_type IS NULL THEN 'File extension ''' || ext || ''' not allowed' END,
        CASE WHEN file_type <> CASE lang WHEN 'de' THEN 'pdf' ELSE 'email' END THEN
          'Expected ' || CASE lang WHEN 'de' THEN 'pdf' ELSE 'email' END || ' file, but detected '
          || file_type END], lambda e: e IS NOT NULL), '|') AS errors
      FROM (SELECT *, {_TYPE} AS file_type, {o.extension('source')} AS ext FROM {FILES})))""",
)
def admission_check(spark, folder):
    wanted = F.when(F.col("lang") == "de", "pdf").otherwise("email")
    checked = admission.check_files(view(spark, folder, "files"), wanted)
    return checked.select("doc_id", "file_type", "valid", joined("errors").alias("errors"))


@query("s05_file_types", f"SELECT doc_id, {o.extension('source')} AS extension, {_TYPE} AS file_type FROM {FILES}")
def file_types(spark, folder):
    name = F.col("source")
    return view(spark, folder, "files").select(
        "doc_id", names.extension(name).alias("extension"), names.file_type(name).alias("file_type")
    )


@query("s06_mime_types", f"SELECT doc_id, {_MIME} AS mime_type FROM {FILES}")
def mime_types(spark, folder):
    return view(spark, folder, "files").select(
        "doc_id", names.mime_type(F.col("source")).alias("mime_type")
    )


@query(
    "s07_stored_names",
    f"""SELECT doc_id, md5(text) AS content_md5, {_STEM} || '_' || {_STAMP} || '_' ||
        left(md5(text), 8) || {_TAIL} AS stored_name FROM {FILES}""",
)
def stored_names(spark, folder):
    with_bytes = view(spark, folder, "files").withColumn("content", F.col("text").cast("binary"))
    return admission.stored_names(with_bytes, F.col("modified")).select(
        "doc_id", "content_md5", "stored_name"
    )


@query(
    "s08_file_info",
    f"""SELECT source AS name, file_size AS size, round(file_size / 1048576.0, 2) AS size_mb,
        {o.extension('source')} AS extension, {_MIME} AS mime_type,
        coalesce(starts_with({_MIME}, 'text/'), false) AS is_text,
        NOT coalesce(starts_with({_MIME}, 'text/'), false) AS is_binary,
        {o.stamp('modified')} AS modified FROM {FILES}""",
)
def file_info(spark, folder):
    info = admission.file_info(view(spark, folder, "files"))
    return info.withColumn("modified", stamp("modified"))


@query(
    "s09_retention",
    f"""SELECT doc_id, source FROM {FILES}
        WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(modified) > 168 * 3600000000 - 3600000000""",
)
def retention(spark, folder):
    now = F.lit(NOW).cast("timestamp")
    return admission.expired(view(spark, folder, "files"), now, hours=167).select(
        "doc_id", "source"
    )


@query(
    "s09_retention_count",
    f"""SELECT count(*) AS expired_files FROM {FILES}
        WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(modified) > 24 * 3600000000""",
)
def retention_count(spark, folder):
    now = F.lit(NOW).cast("timestamp")
    return admission.expired(view(spark, folder, "files"), now).agg(
        F.count("*").alias("expired_files")
    )


@query(
    "s10_pasted_text",
    f"""SELECT doc_id, 'pasted_content_' || {_STAMP} || '.txt' AS source,
        CAST(strlen(text) AS BIGINT) AS file_size FROM {FILES} WHERE length({o.trim('text')}) > 0""",
)
def pasted(spark, folder):
    texts = view(spark, folder, "files").drop("source", "file_size")
    return admission.pasted_text(texts, F.col("modified")).select("doc_id", "source", "file_size")


@query(
    "s11_ledger_sink",
    f"""SELECT format, count(*) AS records, CAST(sum(file_size) AS BIGINT) AS bytes,
        count(DISTINCT thread_id) AS threads FROM {o.source('ledger')} GROUP BY format""",
)
def ledger_sink(spark, folder):
    """Append to a ledger in the shared folder, read it back, summarise by partition."""
    path = shared_folder(configure(spark), "ledger")
    ledger.append(ledger.new_records(view(spark, folder, "ledger")), path)
    return (
        ledger.read(spark, path)
        .groupBy("format")
        .agg(
            F.count("*").alias("records"),
            F.sum("file_size").alias("bytes"),
            F.countDistinct("thread_id").alias("threads"),
        )
    )


@query(
    "s12_stamped_sources",
    f"SELECT doc_id, {_STEM} || '_' || {_STAMP} || {_TAIL} AS source FROM {FILES}",
)
def stamped(spark, folder):
    return admission.stamped_sources(view(spark, folder, "files"), F.col("modified")).select(
        "doc_id", "source"
    )


_JSONS = f"(SELECT *, {o.json_errors()} AS errors FROM {o.json_parsed(o.source('jsons'))})"


@query(
    "s13_json_lines",
    f"""SELECT schema AS detected_schema, len(errors) = 0 AS valid, count(*) AS documents
        FROM {_JSONS} GROUP BY 1, 2""",
)
def json_lines(spark, folder):
    """Write one document per line, scan the lines back and extract each."""
    path = shared_folder(configure(spark), "lines")
    view(spark, folder, "jsons").select("text").write.text(path)
    read = files.lines(spark, path)
    return (
        json_docs.extract_json(read)
        .groupBy("detected_schema", "valid")
        .agg(F.count("*").alias("documents"))
    )


_PROSE = (
    "(SELECT doc_id, source || '-' || CAST(doc_id AS STRING) || '.txt' AS source, "
    "CAST(NULL AS STRING) AS known, text FROM documents)"
)


_STREAMED = f"""SELECT CASE WHEN ok THEN source ELSE 'error' END AS source,
        CASE WHEN ok THEN 'EMAIL' ELSE 'ERROR' END AS format,
        CASE WHEN ok THEN rule_intent ELSE 'error' END AS intent,
        CASE WHEN ok THEN {o.mail_confidence()} ELSE 0.0::DOUBLE END AS confidence_score,
        CASE WHEN ok THEN 'completed' ELSE 'ERROR' END AS status, 'email' AS processed_by
        FROM (SELECT *, length({o.trim('text')}) >= 10 AS ok FROM {o.mail_parsed(o.ruled(_PROSE))})"""


@query("s14_stream_intake", _STREAMED)
def stream_intake(spark, folder):
    """The documents as a stream of plain-text mails, recorded and read back."""
    arriving = tables.table_stream(spark, folder, "documents").select(
        "doc_id",
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias(
            "source"
        ),
        "text",
    )
    path = shared_folder(spark, "stream")
    running = record_stream(
        arriving,
        F.lit("2024-01-01 00:00:00").cast("timestamp"),
        f"{path}/ledger",
        f"{path}/checkpoint",
    )
    running.awaitTermination()
    return ledger.read(spark, f"{path}/ledger").select(
        "source",
        "format",
        "intent",
        F.round("confidence_score", 6).alias("confidence_score"),
        "status",
        "processed_by",
    )


@query("s14_delivered_twice", _STREAMED)
def delivered_twice(spark, folder):
    """Every file arrives twice, in batches of their own and in two runs; each document is recorded once."""
    path = shared_folder(configure(spark), "twice")
    docs = tables.table(spark, folder, "documents")
    named = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    schema = "doc_id bigint, source string, text string"
    for turn in ("first", "second"):
        docs.select("doc_id", named, "text").write.mode("append").parquet(f"{path}/arrived")
        if turn == "first":
            # as many files a batch as one delivery has, so that batches are as many as deliveries, whatever the size
            files_each = len(spark.read.schema(schema).parquet(f"{path}/arrived").inputFiles())
            docs.where("doc_id % 3 = 0").select("doc_id", named, "text").write.mode("append").parquet(f"{path}/arrived")
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, files_each))
        running = record_stream(
            arriving.parquet(f"{path}/arrived"), at, f"{path}/ledger", f"{path}/checkpoint", once_within="1 day"
        )
        running.awaitTermination()
    return ledger.read(spark, f"{path}/ledger").select(
        "source", "format", "intent", F.round("confidence_score", 6).alias("confidence_score"), "status", "processed_by"
    )


@query(
    "s14_streamed_then_changed",
    """SELECT source || '-' || CAST(doc_id AS STRING) || '.txt' AS source,
        CASE WHEN doc_id % 5 = 0 THEN 'reviewed' ELSE 'completed' END AS status,
        CAST(CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version
        FROM documents WHERE length(trim(text)) >= 10 AND doc_id % 7 <> 0""",
)
def streamed_then_changed(spark, folder):
    """A streamed ledger to which a batch job adds updates, then deletions."""
    arriving = tables.table_stream(spark, folder, "documents").select(
        "doc_id",
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias(
            "source"
        ),
        "text",
    )
    path = shared_folder(spark, "changed")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    record_stream(arriving, at, f"{path}/ledger", f"{path}/checkpoint").awaitTermination()
    number = F.regexp_extract("source", r"-(\d+)[.]txt$", 1).cast("bigint")

    def named(rule):
        rows = ledger.latest(ledger.read(spark, f"{path}/ledger")).where("source <> 'error'")
        return rows.where(rule).select("id")

    change = named(number % 5 == 0).withColumn("status", F.lit("reviewed"))
    whole = ledger.read(spark, f"{path}/ledger")
    ledger.append(ledger.update(whole, change, at), f"{path}/ledger", "review")
    gone = named(number % 7 == 0)
    ledger.append(ledger.delete(ledger.read(spark, f"{path}/ledger"), gone, at), f"{path}/ledger", "gone")
    return (
        ledger.latest(ledger.read(spark, f"{path}/ledger"))
        .where("source <> 'error'")
        .select("source", "status", "version")
    )
