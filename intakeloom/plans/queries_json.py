"""Queries over JSON documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from intakeloom import fixed_values as fv
from intakeloom.operators import json_docs
from intakeloom.plans import oracle_text as o
from intakeloom.plans.intake import ledger_rows, route_and_extract
from intakeloom.plans.registry import joined, query
from intakeloom.plans.views import view

JSONS = o.source("jsons")
PARSED = o.json_parsed(JSONS)
FULL = f"(SELECT *, {o.json_errors()} AS errors FROM {PARSED})"

_TEXTS = {
    "invoice_number": "header.invoice_number",
    "invoice_date": "header.invoice_date",
    "due_date": "header.due_date",
    "vendor_company_name": "vendor.company_name",
    "vendor_phone": "vendor.contact.phone",
    "vendor_email": "vendor.contact.email",
    "customer_company_name": "customer.company_name",
    "customer_contact_person": "customer.contact_person",
    "customer_phone": "customer.contact.phone",
    "customer_email": "customer.contact.email",
}


def _number(path: str, inner: str = "inner_j") -> str:
    return f"TRY_CAST({o.json_text(path, inner)} AS DOUBLE)"


def _docs(spark, folder):
    return view(spark, folder, "jsons").select("doc_id", "text")


def _extracted(spark, folder):
    return json_docs.extract_json(_docs(spark, folder))


@query(
    "j01_parse",
    f"SELECT json_valid({o.trim('text')}) AS success, count(*) AS documents FROM {JSONS} GROUP BY 1",
)
def parse(spark, folder):
    return (
        _extracted(spark, folder)
        .groupBy("success")
        .agg(F.count("*").alias("documents"))
    )


@query(
    "j02_unwrap",
    f"""SELECT doc_id, array_to_string(list_sort(json_keys(inner_j)), '|') AS keys
        FROM {PARSED} WHERE j IS NOT NULL""",
)
def unwrap(spark, folder):
    read = json_docs.parsed(_docs(spark, folder)).filter(F.col("value").isNotNull())
    keys = F.map_keys(F.try_variant_get("inner", "$", "map<string,variant>"))
    return read.select("doc_id", joined(keys, sort=True).alias("keys"))


@query("j03_schema", f"SELECT doc_id, schema AS detected_schema FROM {PARSED}")
def schema(spark, folder):
    return _extracted(spark, folder).select("doc_id", "detected_schema")


@query(
    "j04_validation",
    f"SELECT doc_id, len(errors) = 0 AS valid, array_to_string(errors, '|') AS errors FROM {FULL}",
)
def validation(spark, folder):
    return _extracted(spark, folder).select(
        "doc_id", "valid", joined("validation_errors").alias("errors")
    )


@query(
    "j05_invoices",
    f"""SELECT doc_id, {', '.join(f'{o.json_text(p)} AS {n}' for n, p in _TEXTS.items())},
        {_number('summary.total_amount')} AS amount FROM {PARSED} WHERE schema = 'invoice'""",
)
def invoices(spark, folder):
    found = _extracted(spark, folder).filter("detected_schema = 'invoice'")
    return found.select(
        "doc_id", *[F.col(f"invoice.{n}").alias(n) for n in _TEXTS], "invoice.amount"
    )


_LINES = f"""(SELECT doc_id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS item_no
    FROM (SELECT doc_id, CAST(json_extract(inner_j, '$.line_items') AS JSON[]) AS items
      FROM {PARSED} WHERE schema = 'invoice' AND json_type(inner_j, '$.line_items') = 'ARRAY'))"""


@query(
    "j06_line_items",
    f"""SELECT doc_id, CAST(item_no AS BIGINT) AS item_no, {o.json_text('item_id', 'item')} AS item_id,
        {o.json_text('description', 'item')} AS description,
        {_number('quantity', 'item')} AS quantity, {_number('unit_price', 'item')} AS unit_price,
        {_number('total_price', 'item')} AS total_price FROM {_LINES}
        UNION ALL
        SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL FROM {PARSED} WHERE schema = 'invoice'
        AND coalesce(json_type(inner_j, '$.line_items') <> 'ARRAY'
          OR json_array_length(inner_j, '$.line_items') = 0, true)""",
)
def line_items(spark, folder):
    found = _extracted(spark, folder).filter("detected_schema = 'invoice'")
    return json_docs.exploded_line_items(found)


@query(
    "j07_orders",
    f"""SELECT doc_id, {o.json_text('order_id')} AS order_id, {o.json_text('customer')} AS customer,
        CAST(json_array_length(inner_j, '$.items') AS BIGINT) AS item_count,
        {_number('total')} AS total, {o.json_text('status')} AS status
        FROM {PARSED} WHERE schema = 'order'""",
)
def orders(spark, folder):
    found = _extracted(spark, folder).filter("detected_schema = 'order'")
    return found.select(
        "doc_id",
        "order.order_id",
        "order.customer",
        F.size("order.items").alias("item_count"),
        "order.total",
        "order.status",
    )


@query(
    "j08_products",
    f"""SELECT doc_id, {o.json_text('id')} AS id, {o.json_text('name')} AS name,
        {_number('price')} AS price, {o.json_text('category')} AS category,
        {o.json_text('description')} AS description FROM {PARSED} WHERE schema = 'product'""",
)
def products(spark, folder):
    found = _extracted(spark, folder).filter("detected_schema = 'product'")
    return found.select("doc_id", "product.*")


_ANOMALIES = f"CASE WHEN schema = 'unknown' THEN '{fv.NO_FIELDS}' WHEN j IS NOT NULL THEN '' END"
_ADVICE = f"""CASE WHEN j IS NULL THEN ''
    WHEN schema = 'unknown' THEN '{fv.JSON_NOT_VALID}|{fv.JSON_ANOMALY}'
    WHEN len(errors) > 0 THEN '{fv.JSON_NOT_VALID}' ELSE '{fv.JSON_DONE}' END"""


@query("j09_anomalies", f"SELECT doc_id, {_ANOMALIES} AS anomalies FROM {PARSED}")
def anomalies(spark, folder):
    return _extracted(spark, folder).select("doc_id", joined("anomalies").alias("anomalies"))


@query("j10_recommendations", f"SELECT doc_id, {_ADVICE} AS recommendations FROM {FULL}")
def recommendations(spark, folder):
    return _extracted(spark, folder).select(
        "doc_id", joined("recommendations").alias("recommendations")
    )


@query("j11_confidence", f"SELECT doc_id, {o.JSON_CONFIDENCE} AS confidence_score FROM {FULL}")
def confidence(spark, folder):
    return _extracted(spark, folder).select("doc_id", "confidence_score")


@query(
    "j12_json_records",
    f"""SELECT doc_id, j IS NOT NULL AS success, schema AS detected_schema,
        array_to_string(errors, '|') AS errors, {_ANOMALIES} AS anomalies,
        {_ADVICE} AS recommendations, {o.JSON_CONFIDENCE} AS confidence_score,
        CASE WHEN schema = 'invoice' THEN {_number('summary.total_amount')} END AS amount,
        CASE WHEN schema = 'order' THEN {o.json_text('order_id')} END AS order_id,
        CASE WHEN schema = 'product' THEN {_number('price')} END AS price FROM {FULL}""",
)
def json_records(spark, folder):
    return _extracted(spark, folder).select(
        "doc_id",
        "success",
        "detected_schema",
        joined("validation_errors").alias("errors"),
        joined("anomalies").alias("anomalies"),
        joined("recommendations").alias("recommendations"),
        "confidence_score",
        "invoice.amount",
        "order.order_id",
        "product.price",
    )


_TYPED = o.json_parsed(o.source("typed"))
_FIELD_PATHS = {
    "invoice": {**{n: p for n, p in _TEXTS.items()}, "amount": "summary.total_amount"},
    "order": {n: n for n in ("order_id", "customer", "items", "total", "status")},
    "product": {n: n for n in ("id", "name", "price", "category", "description")},
}
_FIELD_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, '{name}' AS field, CAST(json_extract(inner_j, '$.{path}') AS VARCHAR) AS value FROM {_TYPED} WHERE schema = '{schema}'"
    for schema, paths in _FIELD_PATHS.items()
    for name, path in paths.items()
)


@query(
    "j12_value_types",
    f"""SELECT doc_id, field, CASE WHEN value IS NULL THEN 'null' ELSE value END AS value FROM ({_FIELD_ROWS})
        UNION ALL
        SELECT doc_id, 'line_items', '[' || array_to_string(list_transform(CAST(json_extract(inner_j, '$.line_items') AS JSON[]),
          lambda i: '{{' || array_to_string(list_transform(['description', 'item_id', 'quantity', 'total_price', 'unit_price'],
            lambda k: '"' || k || '":' || coalesce(CAST(json_extract(i, '$.' || k) AS VARCHAR), 'null')), ',') || '}}'), ',') || ']'
        FROM {_TYPED} WHERE schema = 'invoice'""",
)
def value_types(spark, folder):
    """Every extracted field as JSON text: numbers, texts, objects, lists and nulls stay what they are."""
    read = json_docs.extract_json(view(spark, folder, "typed"))
    fields = F.try_variant_get(F.try_parse_json("extracted_fields"), "$", "map<string,variant>")
    return read.select("doc_id", F.explode(fields).alias("field", "value")).select(
        "doc_id", "field", F.to_json("value").alias("value")
    )


@query(
    "j12_json_ledger",
    f"""SELECT intent, status, count(*) AS records, sum(confidence_score) AS confidence FROM (
        SELECT rule_intent AS intent, 'completed' AS status, {o.JSON_CONFIDENCE} AS confidence_score
        FROM (SELECT *, {o.json_errors()} AS errors FROM {o.json_parsed(o.ruled(JSONS))})
        WHERE j IS NOT NULL) GROUP BY 1, 2""",
)
def json_ledger(spark, folder):
    """Records per intent; texts that do not parse leave none."""
    docs = view(spark, folder, "jsons")
    results = route_and_extract(docs, keep=["source", "thread_id", "received_at"])
    return (
        ledger_rows(results, F.col("received_at").cast("timestamp"))
        .groupBy("intent", "status")
        .agg(F.count("*").alias("records"), F.sum("confidence_score").alias("confidence"))
    )
