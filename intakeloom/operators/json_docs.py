"""JSON documents: schema detection, validation, projection, scores.

A document is parsed once to VARIANT; everything after reads that value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intakeloom import fixed_values as fv
from intakeloom.functions import jsontext
from intakeloom.functions.stages import computed_once
from intakeloom.functions.text import let

INVALID_JSON = "Invalid JSON format"
JSON_TOO_LONG = "JSON text holds a string too long to be read"


def parsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the parsed ``value`` (null when invalid), its ``entries`` and ``inner``.

    ``inner`` is the object the fields are read from: the value of a single
    wrapper key when that value is an object, else the document itself.
    """
    read = jsontext.with_parsed(docs, "value", F.col(text))
    # each is pinned: a condition on the schema would else repeat all of it for every key it asks for
    keyed = computed_once(read, "entries", jsontext.fields(F.col("value")))
    wrapped = F.when(
        F.size("entries") == 1, jsontext.first_element(F.map_values("entries"))
    )
    unwrapped = computed_once(
        keyed, "nested", let(wrapped, lambda one: F.when(jsontext.fields(one).isNotNull(), one))
    )
    return computed_once(unwrapped, "inner", F.coalesce("nested", "value"))


_ITEM = ("item_id", "description", "quantity", "unit_price", "total_price")
# Where the fields of each schema stand.
_PATHS = {
    "invoice": {
        "invoice_number": "header.invoice_number",
        "invoice_date": "header.invoice_date",
        "due_date": "header.due_date",
        "amount": "summary.total_amount",
        "vendor_company_name": "vendor.company_name",
        "vendor_phone": "vendor.contact.phone",
        "vendor_email": "vendor.contact.email",
        "customer_company_name": "customer.company_name",
        "customer_contact_person": "customer.contact_person",
        "customer_phone": "customer.contact.phone",
        "customer_email": "customer.contact.email",
    },
    "order": {name: name for name in ("order_id", "customer", "items", "total", "status")},
    "product": {name: name for name in ("id", "name", "price", "category", "description")},
}


def _matching_schema(keys: Column) -> Column:
    result = None
    for schema, required in fv.JSON_REQUIRED.items():
        missing = F.array_except(F.array(*[F.lit(k) for k in required]), keys)
        test = F.size(missing) == 0
        result = F.when(test, schema) if result is None else result.when(test, schema)
    return result


def schema_type() -> Column:
    """First schema whose required keys are there: nested object, then top level."""
    nested = F.map_keys(jsontext.fields(F.col("nested")))
    return F.coalesce(
        F.when(nested.isNotNull(), _matching_schema(nested)),
        F.when(F.col("entries").isNotNull(), _matching_schema(F.map_keys("entries"))),
        F.lit("unknown"),
    )


def _checks(schema: str) -> Column:
    inner = F.col("inner")
    tests = []
    for path in [*fv.JSON_REQUIRED[schema], *fv.JSON_NESTED_REQUIRED[schema]]:
        holder, _, key = path.rpartition(".")
        absent = ~jsontext.is_present(inner, path)
        if holder:
            absent = absent & F.coalesce(jsontext.has_type(inner, holder, "object"), F.lit(False))
        tests.append(F.when(absent, F.lit(f"'{path}' is required")))
    for path, kind in fv.JSON_TYPES[schema].items():
        wrong = jsontext.is_present(inner, path) & ~F.coalesce(
            jsontext.has_type(inner, path, kind), F.lit(False)
        )
        tests.append(F.when(wrong, F.lit(f"'{path}' is not of type {kind}")))
    return F.array_compact(F.array(*tests))


def validation_errors(schema: Column) -> Column:
    """All violations of the detected schema, in the order it lists its paths."""
    result = None
    for name in fv.JSON_REQUIRED:
        test = schema == name
        result = F.when(test, _checks(name)) if result is None else result.when(test, _checks(name))
    return result.otherwise(F.array(F.lit(fv.UNKNOWN_SCHEMA)))


def line_items(inner: Column) -> Column:
    """Five fields of each line item; an absent list is empty."""
    items = F.coalesce(
        F.try_variant_get(inner, "$.line_items", "array<variant>"),
        F.array().cast("array<variant>"),
    )
    return F.transform(
        items,
        lambda item: F.struct(
            jsontext.at(item, "item_id").alias("item_id"),
            jsontext.at(item, "description").alias("description"),
            jsontext.at(item, "quantity", "double").alias("quantity"),
            jsontext.at(item, "unit_price", "double").alias("unit_price"),
            jsontext.at(item, "total_price", "double").alias("total_price"),
        ),
    )


def invoice_fields(inner: Column) -> Column:
    def text(path: str) -> Column:
        return jsontext.at(inner, path)

    return F.struct(
        text("header.invoice_number").alias("invoice_number"),
        text("header.invoice_date").alias("invoice_date"),
        text("header.due_date").alias("due_date"),
        jsontext.at(inner, "summary.total_amount", "double").alias("amount"),
        text("vendor.company_name").alias("vendor_company_name"),
        text("vendor.contact.phone").alias("vendor_phone"),
        text("vendor.contact.email").alias("vendor_email"),
        text("customer.company_name").alias("customer_company_name"),
        text("customer.contact_person").alias("customer_contact_person"),
        text("customer.contact.phone").alias("customer_phone"),
        text("customer.contact.email").alias("customer_email"),
        line_items(inner).alias("line_items"),
    )


def order_fields(inner: Column) -> Column:
    return F.struct(
        jsontext.at(inner, "order_id").alias("order_id"),
        jsontext.at(inner, "customer").alias("customer"),
        jsontext.at(inner, "items", "array<variant>").alias("items"),
        jsontext.at(inner, "total", "double").alias("total"),
        jsontext.at(inner, "status").alias("status"),
    )


def product_fields(inner: Column) -> Column:
    return F.struct(
        jsontext.at(inner, "id").alias("id"),
        jsontext.at(inner, "name").alias("name"),
        jsontext.at(inner, "price", "double").alias("price"),
        jsontext.at(inner, "category").alias("category"),
        jsontext.at(inner, "description").alias("description"),
    )


def faithful_fields(schema: Column, inner: Column) -> Column:
    """The projection of the detected schema as JSON text; every value keeps its type and digits.

    An absent key and a JSON null both give null, as does what lies in a value
    that is no object.
    """

    def item(value: Column) -> Column:
        return F.struct(*[jsontext.kept(value, name).alias(name) for name in _ITEM])

    listed = F.coalesce(
        F.try_variant_get(inner, "$.line_items", "array<variant>"), F.array().cast("array<variant>")
    )
    options = {"ignoreNullFields": "false"}
    found = {
        name: F.to_json(F.struct(*[jsontext.kept(inner, path).alias(field) for field, path in paths.items()]), options)
        for name, paths in _PATHS.items()
    }
    invoice = [jsontext.kept(inner, path).alias(field) for field, path in _PATHS["invoice"].items()]
    found["invoice"] = F.to_json(F.struct(*invoice, F.transform(listed, item).alias("line_items")), options)
    result = F.lit("{}")
    for name, text in found.items():
        result = F.when(schema == name, text).otherwise(result)
    return result


def exploded_line_items(invoices: DataFrame, key: str = "doc_id") -> DataFrame:
    """Relational form of the line items; an invoice without any keeps one row."""
    return invoices.select(key, F.posexplode_outer("invoice.line_items").alias("item_no", "item")).select(
        key, "item_no", "item.*"
    )


def recommendations(valid: Column, anomalies: Column) -> Column:
    found = F.array_compact(
        F.array(
            F.when(~valid, F.lit(fv.JSON_NOT_VALID)),
            F.when(F.size(anomalies) > 0, F.lit(fv.JSON_ANOMALY)),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fv.JSON_DONE)))


def confidence(valid: Column, anomalies: Column) -> Column:
    return (
        F.when(~valid, F.lit(0.0)).when(F.size(anomalies) > 0, F.lit(0.5)).otherwise(F.lit(1.0))
    )


def extract_json(docs: DataFrame, text: str = "text") -> DataFrame:
    """The full extraction row of each JSON document, or an error row.

    ``extracted_fields`` holds the projection of the detected schema as JSON
    text, each value as it stands in the document.  ``invoice``, ``order`` and
    ``product`` hold the same as typed columns: texts, and numbers as doubles
    (also those a document writes as texts).
    """
    inner = F.col("inner")
    marked = docs.withColumn("_too_long", jsontext.beyond_parser(F.col(text)))
    read = parsed(marked, text).drop(text)
    success = F.col("value").isNotNull()
    detected = computed_once(read, "detected_schema", F.when(success, schema_type()))
    schema = F.col("detected_schema")
    projected = detected.withColumns(
        {
            "success": success,
            "validation_errors": F.when(success, validation_errors(schema)),
            "invoice": F.when(schema == "invoice", invoice_fields(inner)),
            "order": F.when(schema == "order", order_fields(inner)),
            "product": F.when(schema == "product", product_fields(inner)),
        }
    )
    scored = projected.withColumns(
        {
            "valid": F.size("validation_errors") == 0,
            "anomalies": F.when(
                success,
                F.when(schema == "unknown", F.array(F.lit(fv.NO_FIELDS))).otherwise(
                    F.array().cast("array<string>")
                ),
            ),
        }
    )
    return scored.withColumns(
        {
            "recommendations": F.when(
                success, recommendations(F.col("valid"), F.col("anomalies"))
            ).otherwise(F.array().cast("array<string>")),
            "confidence_score": F.when(
                success, confidence(F.col("valid"), F.col("anomalies"))
            ).otherwise(F.lit(0.0)),
            "extracted_fields": faithful_fields(schema, inner),
            "error": F.when(~success, F.when(F.col("_too_long"), JSON_TOO_LONG).otherwise(INVALID_JSON)),
        }
    ).drop("value", "entries", "nested", "inner", "_too_long")
