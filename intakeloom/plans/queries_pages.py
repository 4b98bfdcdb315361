"""Queries over page texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from intakeloom import fixed_values as fv
from intakeloom.operators import pages
from intakeloom.plans import oracle_text as o
from intakeloom.plans.intake import ledger_rows, route_and_extract
from intakeloom.plans.registry import joined, query
from intakeloom.plans.views import view
from intakeloom.sources import tables

PAPERS = o.source("papers")
TYPED = o.typed(PAPERS)
FIELDS = o.page_fields(TYPED)
REPLIES = o.source("replies")
_LISTS = ["line_items", "emails", "phone_numbers", "addresses", "companies"]


def _turns(spark, folder):
    turns = tables.table(spark, folder, "conversations")
    return turns.select("conv_id", (F.col("turn") + 1).alias("page"), "text")


_ASSEMBLED = """(SELECT conv_id, count(*) AS page_count, string_agg(CASE WHEN length(text) > 0 THEN '--- Page ' ||
      CAST(turn + 1 AS STRING) || ' ---' || chr(10) || text END, chr(10) ORDER BY turn, text) AS text
    FROM conversations GROUP BY ALL)"""


@query("p01_assemble", f"SELECT conv_id, page_count, md5(text) AS text_md5 FROM {_ASSEMBLED}")
def assemble(spark, folder):
    """Turns of a conversation as pages of a document."""
    whole = pages.assemble(_turns(spark, folder), "conv_id")
    return whole.select("conv_id", "page_count", F.md5("text").alias("text_md5"))


@query(
    "p02_table_shapes",
    """SELECT c_custkey AS doc_id, CAST(0 AS BIGINT) AS table_index, CAST(2 AS BIGINT) AS rows,
         CAST(3 AS BIGINT) AS columns, c_name AS first_cell FROM customer
       UNION ALL
       SELECT c_custkey, 2, 1, 1, c_mktsegment FROM customer WHERE c_acctbal > 0""",
)
def table_shapes(spark, folder):
    """Three tables per customer: two rows, no rows, and one row for some."""
    row = F.array(F.col("c_name"), F.lit("a"), F.lit("b"))
    none = F.array().cast("array<array<string>>")
    last = F.when(F.col("c_acctbal") > 0, F.array(F.array("c_mktsegment"))).otherwise(none)
    given = tables.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        F.array(F.array(row, F.array(F.lit("x"))), none, last).alias("tables"),
    )
    return pages.table_shapes(given, ["doc_id"]).select(
        "doc_id", "table_index", "rows", "columns", F.get(F.get("data", F.lit(0)), F.lit(0)).alias("first_cell")
    )


def _statistics_of(source: str, key: str) -> str:
    columns = ", ".join(f"{sql} AS {name}" for name, sql in o.STATISTICS.items())
    return f"""SELECT {key}, {columns},
        round((length(text) - (length(text) - length(replace(text, chr(10), ''))))
          / (length(text) - length(replace(text, chr(10), '')) + 1), 6) AS average_line_length
        FROM {source} WHERE length(text) > 0"""


def _statistics(docs, key: str):
    return (
        pages.with_text_statistics(docs)
        .filter("total_characters IS NOT NULL")
        .select(
            key,
            *[c for c in pages.STATISTICS if c != "average_line_length"],
            F.round("average_line_length", 6).alias("average_line_length"),
        )
    )


@query("p03_text_statistics", _statistics_of("documents", "doc_id"))
def text_statistics(spark, folder):
    docs = tables.table(spark, folder, "documents").select("doc_id", "text")
    return _statistics(docs, "doc_id")


@query("p03_web_page_statistics", _statistics_of("(SELECT page_id, html AS text FROM pages)", "page_id"))
def web_page_statistics(spark, folder):
    docs = tables.table(spark, folder, "pages").select("page_id", F.col("html").alias("text"))
    return _statistics(docs, "page_id")


_FIRST = {
    "detected_emails": o.every("text", fv.EMAIL_ADDRESS, 0, "i"),
    "detected_phones": o.every("text", fv.PAGE_PHONE),
    "detected_dates": o.every("text", fv.PAGE_DATE),
    "detected_currencies": o.every("text", fv.PAGE_CURRENCY),
}


@query(
    "p04_first_entities",
    " UNION ALL ".join(
        "SELECT kind, doc_id, "
        + ", ".join(f"array_to_string(({sql})[1:5], '|') AS {n}" for n, sql in _FIRST.items())
        + f" FROM (SELECT '{kind}' AS kind, doc_id, text FROM {src}) WHERE length(text) > 0"
        for kind, src in (("paper", PAPERS), ("prose", "documents"))
    ),
)
def first_entities(spark, folder):
    papers = view(spark, folder, "papers").select(F.lit("paper").alias("kind"), "doc_id", "text")
    prose = tables.table(spark, folder, "documents").select(
        F.lit("prose").alias("kind"), "doc_id", "text"
    )
    found = papers.union(prose).filter(F.length("text") > 0)
    return found.withColumn("_first", pages.first_entities(F.col("text"))).select(
        "kind", "doc_id", *[joined(f"_first.{n}").alias(n) for n in _FIRST]
    )


@query(
    "p05_document_type",
    f"""SELECT 'paper' AS kind, doc_id, document_type FROM {TYPED}
        UNION ALL SELECT 'prose', doc_id, document_type FROM {o.typed('documents')}""",
)
def document_type(spark, folder):
    papers = view(spark, folder, "papers").select(F.lit("paper").alias("kind"), "doc_id", "text")
    prose = tables.table(spark, folder, "documents").select(
        F.lit("prose").alias("kind"), "doc_id", "text"
    )
    lowered = papers.union(prose).withColumn("_lower", F.lower("text"))
    return pages.with_document_type(lowered).select("kind", "doc_id", "document_type")


def _typed(spark, folder):
    docs = view(spark, folder, "papers").withColumn("_lower", F.lower("text"))
    return pages.with_fields(pages.with_document_type(docs))


def _fields(name: str, kind: str, columns: list[str]):
    """Fields of one document type, on the papers of that type."""
    chosen = ", ".join(f"{kind}__{c} AS {c}" for c in columns)

    @query(name, f"SELECT doc_id, {chosen} FROM {FIELDS} WHERE document_type = '{kind}'")
    def run(spark, folder):
        found = _typed(spark, folder).filter(F.col("document_type") == kind)
        return found.select(
            "doc_id",
            *[
                (joined(f"{kind}_fields.{c}") if c in _LISTS else F.col(f"{kind}_fields.{c}")).alias(c)
                for c in columns
            ],
        )


_fields("p06_invoice_fields", "invoice", list(fv.PAGE_FIELDS["invoice"]))
_fields("p07_complaint_fields", "complaint", list(fv.PAGE_FIELDS["complaint"]))
_fields("p08_rfq_fields", "rfq", list(fv.PAGE_FIELDS["rfq"]))
_fields("p09_report_fields", "report", list(fv.PAGE_FIELDS["report"]))
_fields("p10_invoice_specifics", "invoice", ["line_items", "tax_amount"])
_fields("p11_complaint_specifics", "complaint", ["description", "status"])
_fields("p12_rfq_specifics", "rfq", ["requirements", "delivery_terms"])


@query(
    "p13_common_fields",
    " UNION ALL ".join(
        f"SELECT kind, doc_id, {', '.join(f'{sql} AS {n}' for n, sql in o.COMMON.items())} "
        f"FROM (SELECT '{kind}' AS kind, doc_id, text FROM {src})"
        for kind, src in (("paper", PAPERS), ("prose", "documents"))
    ),
)
def common_fields(spark, folder):
    papers = view(spark, folder, "papers").select(F.lit("paper").alias("kind"), "doc_id", "text")
    prose = tables.table(spark, folder, "documents").select(
        F.lit("prose").alias("kind"), "doc_id", "text"
    )
    found = pages.with_common_fields(papers.union(prose))
    return found.select("kind", "doc_id", *[joined(n).alias(n) for n in o.COMMON])


@query(
    "p14_types_without_fields",
    f"""WITH counted AS MATERIALIZED (SELECT document_type, {o.FIELD_COUNT} AS n FROM {FIELDS})
        SELECT document_type, count(*) AS documents, CAST(sum(n) AS BIGINT) AS fields
        FROM counted GROUP BY document_type""",
)
def types_without_fields(spark, folder):
    return (
        _extracted_alone(spark, folder)
        .groupBy("document_type")
        .agg(F.count("*").alias("documents"), F.sum("field_count").alias("fields"))
    )


def _extracted_alone(spark, folder):
    return pages.extract_pages(view(spark, folder, "papers"))


def _extracted(spark, folder):
    docs = view(spark, folder, "papers").withColumn("_tables", F.col("page_count") > 25)
    return pages.extract_pages(docs, view(spark, folder, "replies"), has_tables="_tables")


def _first_of(name: str) -> str:
    """A field whatever the type; types share no document."""
    columns = [f"{k}__{name}" for k in fv.PAGE_FIELDS if name in o.fields_of(k)]
    return f"coalesce({', '.join(columns)}, NULL)"


_SOME = ["date", "amount", "project", "subject", "status", "title"]


@query(
    "p15_composed_fields",
    f"SELECT doc_id, {', '.join(f'{_first_of(n)} AS {n}' for n in _SOME)} FROM {FIELDS}",
)
def composed_fields(spark, folder):
    """Read fields back from the composed JSON."""
    schema = ", ".join(f"{n} string" for n in _SOME)
    return (
        _extracted_alone(spark, folder)
        .select("doc_id", F.from_json("extracted_fields", schema).alias("f"))
        .select("doc_id", "f.*")
    )


_REPLIED = f"""(SELECT *, json_type(rj) = 'OBJECT' AND json_type(rj, '$.extracted_fields') = 'OBJECT' AS sets,
      response IS NOT NULL AND document_type <> 'unknown' AND CASE
        WHEN rj IS NULL THEN true
        WHEN json_type(rj) = 'OBJECT' THEN NOT json_exists(rj, '$.error') AND len(json_keys(rj)) > 0
        WHEN json_type(rj) = 'ARRAY' THEN json_array_length(rj) > 0 AND NOT list_contains(
          [x->>'$' FOR x IN CAST(rj AS JSON[]) IF json_type(x) = 'VARCHAR'], 'error')
        WHEN json_type(rj) = 'VARCHAR' THEN length(rj->>'$') > 0 AND NOT contains(rj->>'$', 'error')
        ELSE false END AS ok
    FROM (SELECT p.*, r.response, CASE WHEN json_valid({o.trim('r.response')}) THEN TRY_CAST(r.response AS JSON) END AS rj
      FROM {FIELDS} p LEFT JOIN {REPLIES} r ON p.doc_id = r.doc_id))"""
_SETS = "coalesce(sets, false)"
_PROJECT = f"CASE WHEN {_SETS} THEN rj->>'$.extracted_fields.project' ELSE {_first_of('project')} END"


@query(
    "p16_reply_merge",
    f"""SELECT doc_id, {_PROJECT} AS project,
        CASE WHEN {_SETS} THEN rj->>'$.extracted_fields.po' END AS po,
        CASE WHEN document_type <> 'unknown' AND length(response) > 0 AND rj IS NULL
          THEN response END AS raw_response FROM {_REPLIED}""",
)
def reply_merge(spark, folder):
    read = F.from_json("extracted_fields", "project string, po string")
    return (
        _extracted(spark, folder)
        .select("doc_id", read.alias("f"), "raw_response")
        .select("doc_id", "f.project", "f.po", "raw_response")
    )


_WORDS = o.STATISTICS["total_words"]
# project is replaced, po is new
_COUNT = f"({o.FIELD_COUNT} + CASE WHEN {_SETS} THEN 1 + CAST({_first_of('project')} IS NULL AS INT) ELSE 0 END)"
_ADVICE = f"""(SELECT *, array_to_string(list_filter([
      CASE WHEN page_count > 20 THEN '{fv.PAGES_MANY}' END,
      CASE WHEN words < 50 THEN '{fv.PAGES_FEW_WORDS}' END,
      CASE WHEN n_fields < 3 THEN '{fv.PAGES_FEW_FIELDS}' END,
      CASE WHEN document_type = 'invoice' AND invoice__amount IS NULL THEN '{fv.PAGES_NO_AMOUNT}' END,
      CASE WHEN document_type = 'complaint' AND complaint__description IS NULL
           THEN '{fv.PAGES_NO_DESCRIPTION}' END,
      CASE WHEN page_count > 25 THEN '{fv.PAGES_TABLES}' END], lambda e: e IS NOT NULL), '|') AS advice
    FROM (SELECT *, {_WORDS} AS words, CAST({_COUNT} AS BIGINT) AS n_fields FROM {_REPLIED}))"""
_RECOMMENDED = f"CASE WHEN advice = '' THEN '{fv.PAGES_DONE}' ELSE advice END"
_CONFIDENCE = o.page_confidence("words", "n_fields", "ok", "page_count > 25")


@query("p17_recommendations", f"SELECT doc_id, {_RECOMMENDED} AS recommendations FROM {_ADVICE}")
def recommendations(spark, folder):
    return _extracted(spark, folder).select(
        "doc_id", joined("recommendations").alias("recommendations")
    )


@query("p18_confidence", f"SELECT doc_id, {_CONFIDENCE} AS confidence_score FROM {_ADVICE}")
def confidence(spark, folder):
    return _extracted(spark, folder).select(
        "doc_id", F.round("confidence_score", 6).alias("confidence_score")
    )


@query(
    "p19_page_records",
    f"""SELECT doc_id, document_type, CASE WHEN length(text) > 0 THEN words END AS total_words,
        n_fields AS field_count, {_RECOMMENDED} AS recommendations,
        {_CONFIDENCE} AS confidence_score, CASE WHEN document_type = 'unknown' THEN 'No page text' END
        AS error FROM {_ADVICE}""",
)
def page_records(spark, folder):
    return _extracted(spark, folder).select(
        "doc_id",
        "document_type",
        "total_words",
        "field_count",
        joined("recommendations").alias("recommendations"),
        F.round("confidence_score", 6).alias("confidence_score"),
        "error",
    )


@query(
    "p19_conversation_records",
    f"""SELECT conv_id, document_type, {_WORDS} AS total_words, CAST({o.FIELD_COUNT} AS BIGINT)
        AS field_count, {o.page_confidence(_WORDS, o.FIELD_COUNT, 'false')} AS confidence_score
        FROM {o.page_fields(o.typed(_ASSEMBLED))}""",
)
def conversation_records(spark, folder):
    """Assembly and extraction in one job."""
    whole = pages.assemble(_turns(spark, folder), "conv_id")
    return pages.extract_pages(whole, key="conv_id").select(
        "conv_id",
        "document_type",
        "total_words",
        "field_count",
        F.round("confidence_score", 6).alias("confidence_score"),
    )


@query(
    "p19_page_ledger",
    f"""SELECT intent, thread_id, count(*) AS records FROM (
        SELECT CASE WHEN length(text) > 0 THEN rule_intent ELSE 'error' END AS intent, thread_id
        FROM {o.ruled(PAPERS)}) GROUP BY 1, 2""",
)
def page_ledger(spark, folder):
    docs = view(spark, folder, "papers")
    results = route_and_extract(docs, keep=["source", "thread_id", "received_at"])
    return (
        ledger_rows(results, F.col("received_at").cast("timestamp"))
        .groupBy("intent", "thread_id")
        .agg(F.count("*").alias("records"))
    )
