"""Queries over classification and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from intakeloom import fixed_values as fv
from intakeloom.functions import jsontext, names
from intakeloom.functions.text import preview
from intakeloom.operators import classify, ledger, prompts, replies
from intakeloom.plans import oracle_text as o
from intakeloom.plans.intake import ledger_rows, route_and_extract
from intakeloom.plans.registry import query
from intakeloom.plans.views import view
from intakeloom.session import configure, shared_folder
from intakeloom.sources import tables
from intakeloom.streaming.intake import kept_facts, record_stream, reply_stream

MIXED = o.source("mixed")
DETECTED = o.detected(MIXED)
MAILS = o.source("mails")
REPLIES = o.source("replies")
CATEGORIES = ["Invoice", "Complaint", "Order", "Other"]


@query(
    "c01_input_validation",
    f"SELECT doc_id, coalesce(length(response) > 0, false) AS valid FROM {REPLIES}",
)
def input_validation(spark, folder):
    return view(spark, folder, "replies").select(
        "doc_id", classify.is_valid_input(F.col("response")).alias("valid")
    )


@query(
    "c02_format_by_name",
    f"SELECT doc_id, {o.case_map(o.extension('source'), fv.FORMAT_BY_EXTENSION)} AS format FROM {MIXED}",
)
def format_by_name(spark, folder):
    return view(spark, folder, "mixed").select(
        "doc_id", classify.format_of_name(F.col("source")).alias("format")
    )


@query("c03_is_json", f"SELECT doc_id, json_valid({o.trim('text')}) AS is_json FROM {MIXED}")
def is_json(spark, folder):
    return view(spark, folder, "mixed").select(
        "doc_id", jsontext.is_json(F.col("text")).alias("is_json")
    )


@query(
    "c04_mail_marks",
    f"""SELECT doc_id, CAST({o.mail_marks('lower(text)')} AS BIGINT) AS marks,
        {o.mail_marks('lower(text)')} >= 2 AS is_mail FROM {MIXED}""",
)
def mail_marks(spark, folder):
    return (
        view(spark, folder, "mixed")
        .withColumn("marks", classify.mail_marks(F.lower("text")))
        .select("doc_id", "marks", (F.col("marks") >= 2).alias("is_mail"))
    )


@query(
    "c05_content_format",
    f"SELECT doc_id, {o.content_format('text', 'lower(text)')} AS format FROM {MIXED}",
)
def content_format(spark, folder):
    return _formats(spark, folder).select("doc_id", "format")


def _formats(spark, folder, name=None, known=None, table="mixed"):
    docs = view(spark, folder, table).withColumn("_lower", F.lower("text"))
    return classify.with_format(docs, name=name, known=known, to="format")


@query("c06_known_format", f"SELECT doc_id, fmt AS format FROM {DETECTED}")
def known_format(spark, folder):
    return _formats(spark, folder, "source", "known").select("doc_id", "format")


@query(
    "c07_rule_intent",
    f"SELECT doc_id, rule_intent, round(rule_confidence, 6) AS rule_confidence FROM {o.ruled(MIXED)}",
)
def rule_intent(spark, folder):
    lowered = view(spark, folder, "mixed").select("doc_id", F.lower("text").alias("_lower"))
    return classify.with_rule_intent(lowered, "_lower").select(
        "doc_id", "rule_intent", F.round("rule_confidence", 6).alias("rule_confidence")
    )


@query(
    "c08_intent_reply",
    f"SELECT doc_id, reply_intent, reply_confidence FROM {o.intent_replies(REPLIES)}",
)
def intent_reply(spark, folder):
    return (
        view(spark, folder, "replies")
        .withColumns(replies.intent_reply("response"))
        .select("doc_id", "reply_intent", "reply_confidence")
    )


_ARBITRATED = f"""(SELECT m.*, r.reply_intent, r.reply_confidence,
    coalesce(rule_confidence <= 0.7 AND reply_confidence > 0.5, false) AS take
    FROM {o.detected(f"(SELECT *, CAST(NULL AS STRING) AS known FROM {MAILS})")} m
    LEFT JOIN {o.intent_replies(REPLIES)} r ON m.doc_id = r.doc_id)"""


@query(
    "c09_arbitration",
    f"""SELECT doc_id, CASE WHEN take THEN reply_intent ELSE rule_intent END AS intent,
        round(CASE WHEN take THEN reply_confidence ELSE rule_confidence END, 6) AS intent_confidence
        FROM {_ARBITRATED}""",
)
def arbitration(spark, folder):
    lowered = view(spark, folder, "mails").select("doc_id", F.lower("text").alias("_lower"))
    ruled = classify.with_rule_intent(lowered, "_lower").drop("_lower")
    answers = replies.one_reply_each(view(spark, folder, "replies")).withColumns(
        replies.intent_reply("response")
    )
    return classify.with_arbitration(ruled.join(answers, "doc_id", "left")).select(
        "doc_id", "intent", F.round("intent_confidence", 6).alias("intent_confidence")
    )


@query(
    "c09_late_replies",
    f"""SELECT source, CASE WHEN take THEN reply_intent ELSE rule_intent END AS intent,
        CAST(CASE WHEN response IS NULL THEN 1 ELSE 2 END AS BIGINT) AS version
        FROM (SELECT a.*, r.response FROM {_ARBITRATED} a LEFT JOIN {REPLIES} r ON r.doc_id = a.doc_id)""",
)
def late_replies(spark, folder):
    """Mails are recorded as they come; replies of later batches, some twice, change each record once."""
    path = shared_folder(configure(spark), "late")
    mails = view(spark, folder, "mails").select("doc_id", "source", "text", F.col("received_at").cast("timestamp"))
    # a small table of orders is read by one task; dealt out here, the streams' tasks share the extraction
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mails.repartition(tasks, "doc_id").write.parquet(f"{path}/mails")
    at = F.col("received_at")
    answers = view(spark, folder, "replies").where("response IS NOT NULL").join(mails.select("doc_id", "received_at"), "doc_id")
    answers = answers.select("doc_id", "response", (at + F.expr("INTERVAL 3 HOURS")).alias("replied_at"))
    spark.createDataFrame([], answers.schema).write.parquet(f"{path}/replies")

    def arriving(name: str, rows):
        return spark.readStream.schema(rows.schema).parquet(f"{path}/{name}")

    within = "10000 days"
    recording = record_stream(
        arriving("mails", mails), at, f"{path}/ledger", f"{path}/recorded", facts_path=f"{path}/facts"
    )
    recording.awaitTermination()
    for rule in ("doc_id % 2 = 0", "doc_id % 2 = 1 OR doc_id % 4 = 0"):
        answers.where(rule).write.mode("append").parquet(f"{path}/replies")
        replies_to = arriving("replies", answers)
        # what the mails say is extracted once, when they are recorded
        running = reply_stream(
            kept_facts(spark, f"{path}/facts"), at, replies_to, f"{path}/ledger", f"{path}/changed", within, "intent_reply",
            extracted=True,
        )
        running.awaitTermination()
    return ledger.latest(ledger.read(spark, f"{path}/ledger")).select("source", "intent", "version")


@query(
    "c10_routing",
    f"""SELECT target_agent, count(*) AS documents
        FROM (SELECT {o.AGENT} AS target_agent FROM {DETECTED}) GROUP BY target_agent""",
)
def routing(spark, folder):
    return (
        _formats(spark, folder, "source", "known")
        .select(classify.target_agent(F.col("format")).alias("target_agent"))
        .groupBy("target_agent")
        .agg(F.count("*").alias("documents"))
    )


@query(
    "c11_preview",
    """SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '...' END
       AS content_preview FROM documents""",
)
def content_preview(spark, folder):
    return tables.table(spark, folder, "documents").select(
        "doc_id", preview(F.col("text")).alias("content_preview")
    )


_CLASSIFIED = f"""SELECT doc_id, length(text) > 0 AS success,
    CASE WHEN length(text) > 0 THEN lower(fmt) ELSE 'unknown' END AS format,
    CASE WHEN length(text) > 0 THEN rule_intent ELSE 'unknown' END AS intent,
    CASE WHEN length(text) > 0 THEN {o.AGENT} ELSE 'email_agent' END AS target_agent,
    round(CASE WHEN length(text) > 0 THEN rule_confidence ELSE 0 END, 6) AS confidence_score,
    CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '...' END AS content_preview
    FROM {DETECTED}"""


@query("c12_classify", _CLASSIFIED)
def classified(spark, folder):
    return (
        classify.classify(view(spark, folder, "mixed"), name="source", known="known")
        .drop("error")
        .withColumn("confidence_score", F.round("confidence_score", 6))
    )


@query(
    "c12_classify_with_replies",
    f"""SELECT doc_id, lower(fmt) AS format,
        CASE WHEN take THEN reply_intent ELSE rule_intent END AS intent,
        {o.AGENT} AS target_agent,
        round(CASE WHEN take THEN reply_confidence ELSE rule_confidence END, 6) AS confidence_score
        FROM {_ARBITRATED}""",
)
def classified_with_replies(spark, folder):
    verdicts = classify.classify(
        view(spark, folder, "mails"), view(spark, folder, "replies"), name="source"
    )
    return verdicts.select(
        "doc_id",
        "format",
        "intent",
        "target_agent",
        F.round("confidence_score", 6).alias("confidence_score"),
    )


_INTENTS = ", ".join([*fv.INTENT_PHRASES, "unknown"])


@query(
    "c13_intent_prompts",
    f"""SELECT doc_id, 'What is the intent of this ' || fmt || ' document? Intents: {_INTENTS}.'
        || chr(10) || {o.lit(prompts.INTENT_ANSWER)} || chr(10) || chr(10) ||
        CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 1000) || '...' END AS prompt
        FROM {DETECTED} WHERE length(text) > 0 AND rule_confidence <= 0.7""",
)
def intent_prompts(spark, folder):
    docs = view(spark, folder, "mixed")
    judged = classify.with_verdict(docs, name="source", known="known")
    return prompts.unsure_prompts(judged)


@query(
    "c13_mail_prompts",
    f"""SELECT doc_id, 'Extract the key facts of this e-mail.' || chr(10) ||
        {o.lit(prompts.MAIL_ANSWER)} || chr(10) || chr(10) ||
        CASE WHEN length(text) <= 1500 THEN text ELSE left(text, 1500) || '...' END AS prompt
        FROM documents""",
)
def mail_prompts(spark, folder):
    docs = tables.table(spark, folder, "documents")
    return docs.select("doc_id", prompts.mail_prompt(F.col("text")).alias("prompt"))


@query(
    "c13_page_prompts",
    f"""SELECT doc_id, 'Extract the key facts of this ' || document_type || ' document.' || chr(10)
        || {o.lit(prompts.PAGE_ANSWER)} || chr(10) || chr(10) || left(text, 2000) AS prompt
        FROM {o.typed(o.source('papers'))} WHERE document_type <> 'unknown'""",
)
def page_prompts(spark, folder):
    return prompts.page_prompts(view(spark, folder, "papers"))


def _found(text: str) -> str:
    arms = " ".join(
        f"WHEN contains(lower({text}), {o.lit(c.lower())}) THEN {o.lit(c)}" for c in CATEGORIES
    )
    return f"CASE {arms} END"


_ANSWERED = f"(SELECT m.doc_id, m.text, r.response FROM {MAILS} m JOIN {REPLIES} r ON m.doc_id = r.doc_id)"


def _answered(spark, folder):
    docs = view(spark, folder, "mails").select("doc_id", "text")
    return docs.join(view(spark, folder, "replies"), "doc_id")


@query(
    "c14_category_reply",
    f"""SELECT doc_id,
      CASE WHEN obj AND cat IN ('Invoice', 'Complaint', 'Order', 'Other') THEN cat
           WHEN obj AND (found IS NULL OR reasoned) THEN coalesce(found, 'Invoice')
           ELSE coalesce(found, 'Invoice') END AS category,
      round(CASE WHEN obj AND cat IN ('Invoice', 'Complaint', 'Order', 'Other') THEN conf
           WHEN obj AND found IS NOT NULL AND reasoned THEN greatest(0.3, coalesce(conf, 0.5) - 0.1)
           WHEN obj AND found IS NULL THEN 0.3
           WHEN found IS NOT NULL THEN 0.6 ELSE 0.3 END, 6) AS confidence
    FROM (SELECT *, coalesce(json_type(j) = 'OBJECT', false) AS obj, j->>'$.category' AS cat,
        CAST(j->>'$.confidence' AS DOUBLE) AS conf, json_exists(j, '$.reasoning') AS reasoned,
        {_found('text')} AS found
      FROM (SELECT *, CASE WHEN json_valid(part) THEN TRY_CAST(part AS JSON) END AS j
        FROM (SELECT *, CASE WHEN contains(response, '```json')
            THEN {o.trim("regexp_extract(response, '(?s)```json(.*?)```', 1)")}
            ELSE coalesce(nullif(regexp_extract(response, '(?s)\\{{.*\\}}'), ''), response) END AS part
          FROM {_ANSWERED})))""",
)
def category_reply(spark, folder):
    judged = replies.category_reply(F.col("response"), F.col("text"), CATEGORIES)
    return (
        _answered(spark, folder)
        .withColumn("_judged", judged)
        .select(
            "doc_id",
            F.col("_judged.category").alias("category"),
            F.round("_judged.confidence", 6).alias("confidence"),
        )
    )


@query(
    "c15_category_by_keyword",
    f"""SELECT doc_id, coalesce({_found('text')}, 'Invoice') AS category,
        CASE WHEN {_found('text')} IS NULL THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END AS confidence
        FROM {MIXED}""",
)
def category_by_keyword(spark, folder):
    chosen = replies.category_by_keyword(F.col("text"), CATEGORIES)
    return view(spark, folder, "mixed").select(
        "doc_id", chosen["category"].alias("category"), chosen["confidence"].alias("confidence")
    )


@query(
    "c16_category_in_reply",
    f"""SELECT doc_id, coalesce({_found('response')}, 'Invoice') AS category,
        0.8::DOUBLE AS confidence FROM {REPLIES}""",
)
def category_in_reply(spark, folder):
    chosen = replies.category_in_reply(F.col("response"), CATEGORIES)
    return view(spark, folder, "replies").select(
        "doc_id", chosen["category"].alias("category"), chosen["confidence"].alias("confidence")
    )


@query(
    "c17_category_exact",
    f"""SELECT doc_id, CASE WHEN trim(response) IN ('nothing', 'inquiry,abc') THEN trim(response)
        ELSE 'nothing' END AS category, 0.7::DOUBLE AS confidence FROM {REPLIES}""",
)
def category_exact(spark, folder):
    chosen = replies.category_exact(F.col("response"), ["nothing", "inquiry,abc"])
    return view(spark, folder, "replies").select(
        "doc_id", chosen["category"].alias("category"), chosen["confidence"].alias("confidence")
    )


_FILES = f"(SELECT *, CAST(NULL AS STRING) AS known FROM {o.source('files')})"


@query(
    "c18_reroute",
    f"""SELECT doc_id, CASE WHEN f = 'TEXT' AND mime = 'application/pdf' THEN 'pdf'
        WHEN f = 'TEXT' AND mime = 'text/plain' THEN 'email' ELSE lower(f) END AS route
        FROM (SELECT *, {o.content_format('text', 'lower(text)')} AS f,
          {o.case_map(o.extension('source'), fv.MIME_BY_EXTENSION)} AS mime FROM {_FILES})""",
)
def rerouted(spark, folder):
    mime = names.mime_type(F.col("source"))
    return _formats(spark, folder, table="files").select(
        "doc_id", classify.reroute(F.col("format"), mime).alias("route")
    )


def intake_sql(detected: str) -> str:
    """Outcomes of the whole intake of ``detected`` documents."""
    routed = f"""(SELECT *, CASE WHEN coalesce(length(text), 0) = 0 THEN NULL WHEN fmt = 'TEXT' THEN 'email'
        ELSE lower(fmt) END AS route FROM {detected})"""
    mails = f"(SELECT * FROM {o.mail_parsed(f'(SELECT * FROM {routed} WHERE route = $$email$$)')})"
    jsons = f"""(SELECT *, {o.json_errors()} AS errors FROM
        {o.json_parsed(f'(SELECT * FROM {routed} WHERE route = $$json$$)')})"""
    paged = o.page_fields(o.typed(f"(SELECT * EXCLUDE (low) FROM {routed} WHERE route = 'pdf')"))
    return f"""(
      SELECT doc_id, lower(fmt) AS format, route, rule_intent AS intent,
        length({o.trim('text')}) >= 10 AS success,
        CASE WHEN length({o.trim('text')}) >= 10 THEN {o.mail_confidence()} ELSE 0 END AS confidence_score
      FROM {mails}
      UNION ALL
      SELECT doc_id, lower(fmt), route, rule_intent, j IS NOT NULL, {o.JSON_CONFIDENCE} FROM {jsons}
      UNION ALL
      SELECT doc_id, lower(fmt), route, rule_intent, true,
        {o.page_confidence(o.STATISTICS['total_words'], o.FIELD_COUNT, 'false')} FROM {paged}
      UNION ALL
      SELECT doc_id, 'unknown', NULL, 'unknown', false, 0.0 FROM {routed} WHERE route IS NULL
    )"""


INTAKE = intake_sql(DETECTED)


def _intake(spark, folder):
    return route_and_extract(
        view(spark, folder, "mixed"), name="source", known="known", keep=["source"]
    )


@query("c19_route_and_extract", f"SELECT * FROM {INTAKE}")
def intake(spark, folder):
    return _intake(spark, folder).select(
        "doc_id",
        "format",
        "route",
        "intent",
        "success",
        F.round("confidence_score", 6).alias("confidence_score"),
    )


@query(
    "x01_error_rows",
    f"""SELECT format, processed_by, status, count(*) AS records FROM (
        SELECT CASE WHEN success THEN upper(route) ELSE 'ERROR' END AS format,
          CASE route WHEN 'email' THEN 'email' WHEN 'json' THEN 'json_agent'
               WHEN 'pdf' THEN 'pdf_agent' ELSE 'classifier' END AS processed_by,
          CASE WHEN success THEN 'completed' ELSE 'ERROR' END AS status
        FROM {INTAKE} WHERE success OR coalesce(route, '') <> 'json') GROUP BY ALL""",
)
def error_rows(spark, folder):
    """Ledger records of the whole intake, refused documents among them."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return (
        ledger_rows(_intake(spark, folder), at)
        .groupBy("format", "processed_by", "status")
        .agg(F.count("*").alias("records"))
    )
