"""SQL pieces of the checking queries, made from the fixed values."""

from __future__ import annotations

from intakeloom import fixed_values as fv
from intakeloom.plans.views import oracle_view

BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def extract(x: str, pattern: str, group: int = 0, flags: str = "") -> str:
    prefix = f"(?{flags})" if flags else ""
    return f"regexp_extract({x}, {lit(prefix + pattern)}, {group})"


def every(x: str, pattern: str, group: int = 0, flags: str = "") -> str:
    prefix = f"(?{flags})" if flags else ""
    return f"regexp_extract_all({x}, {lit(prefix + pattern)}, {group})"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def number_of(x: str, pattern: str, flags: str = "") -> str:
    return f"CAST(len({every(x, pattern, 0, flags)}) AS BIGINT)"


def sorted_set(listed: str) -> str:
    return f"array_to_string(list_sort(list_distinct({listed})), '|')"


def ordered_set(listed: str, limit: int) -> str:
    """First distinct values in order of appearance, null when there is none."""
    once = f"list_filter({listed}, lambda x, i: list_position({listed}, x) = i)"
    return f"CASE WHEN len({listed}) > 0 THEN array_to_string(({once})[1:{limit}], '|') END"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def hits(x: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {lit(w)}) AS INT)" for w in words) + ")"


def first_set(x: str, sets: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(x, w)} THEN {lit(k)}" for k, w in sets.items()) + " END"


def source(name: str) -> str:
    return f"({oracle_view(name)})"


def case_map(x: str, table: dict[str, str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {x} {arms} ELSE {default} END"


def extension(x: str) -> str:
    return f"lower(regexp_extract({x}, '[^/.][^/]*(\\.[^./]+)$', 1))"


# --------------------------------------------------------------- classification


def best(src: str, sets: dict[str, list[str]], share: bool, prefix: str) -> str:
    """``src`` (with ``low``) plus ``{prefix}_best`` and ``{prefix}_label``."""
    scores = ", ".join(
        f"{hits('low', w)}{f' / {len(w)}.0::DOUBLE' if share else ''} AS {prefix}_{k}"
        for k, w in sets.items()
    )
    names = [f"{prefix}_{k}" for k in sets]
    arms = " ".join(f"WHEN {prefix}_{k} = {prefix}_best THEN {lit(k)}" for k in sets)
    return (
        f"(SELECT *, CASE {arms} END AS {prefix}_label FROM (SELECT *, "
        f"greatest({', '.join(names)}) AS {prefix}_best FROM (SELECT *, {scores} FROM {src})))"
    )


def ruled(src: str) -> str:
    """``src`` plus ``low``, ``rule_intent`` and ``rule_confidence``."""
    scored = best(f"(SELECT *, lower(text) AS low FROM {src})", fv.INTENT_PHRASES, True, "i")
    return (
        "(SELECT *, CASE WHEN i_best > 0 THEN i_label ELSE 'unknown' END AS rule_intent, "
        f"CASE WHEN i_best > 0 THEN i_best ELSE 0.1::DOUBLE END AS rule_confidence FROM {scored})"
    )


def mail_marks(low: str) -> str:
    return "(" + " + ".join(f"CAST({matches(low, m)} AS INT)" for m in fv.MAIL_MARKS) + ")"


def content_format(text: str, low: str) -> str:
    return (
        f"CASE WHEN json_valid({trim(text)}) THEN 'JSON' WHEN {mail_marks(low)} >= 2 THEN 'EMAIL' "
        "ELSE 'TEXT' END"
    )


def detected(src: str) -> str:
    """``src`` with source, known and text plus rules and ``fmt`` (upper case)."""
    by_name = case_map(extension("source"), fv.FORMAT_BY_EXTENSION)
    return (
        "(SELECT *, CASE WHEN upper(known) IN ('EMAIL', 'JSON', 'PDF') THEN upper(known) "
        f"WHEN coalesce(known, '') = '' AND {by_name} IS NOT NULL THEN {by_name} "
        f"ELSE {content_format('text', 'low')} END AS fmt FROM {ruled(src)})"
    )


AGENT = (
    "CASE fmt WHEN 'PDF' THEN 'pdf_agent' WHEN 'JSON' THEN 'json_agent' ELSE 'email_agent' END"
)

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)$"


def intent_replies(src: str) -> str:
    """``doc_id, response`` plus ``reply_intent`` and ``reply_confidence``."""
    known = ", ".join(lit(k) for k in [*fv.INTENT_PHRASES, "unknown"])
    return f"""(SELECT doc_id, response,
      CASE WHEN ok THEN word ELSE 'unknown' END AS reply_intent,
      CASE WHEN ok AND isnan(num) THEN 0.0::DOUBLE WHEN ok THEN greatest(least(num, 1.0), 0.0)
           ELSE 0.3::DOUBLE END AS reply_confidence
    FROM (SELECT *, coalesce(word IN ({known}) AND num IS NOT NULL, false) AS ok
      FROM (SELECT *, lower(trim(split_part(response, ',', 1))) AS word,
              CASE WHEN regexp_matches(lower(trim(split_part(response, ',', 2))), {lit(_NUMBER)})
                   THEN TRY_CAST(trim(split_part(response, ',', 2)) AS DOUBLE) END AS num
            FROM {src})))"""


# ------------------------------------------------------------------------- mail


def mail_parsed(src: str) -> str:
    """``src`` plus sender, recipient, subject, body from the lines of the text."""

    def last(header: str) -> str:
        size = len(header) + 1
        return (
            f"list_filter(heads, lambda l: starts_with(lower(l), '{header}:'))[-1][{size + 1}:]"
        )

    return f"""(SELECT *,
      nullif(regexp_extract({last('from')}, {lit(fv.EMAIL_ADDRESS)}), '') AS sender,
      nullif(regexp_extract({last('to')}, {lit(fv.EMAIL_ADDRESS)}), '') AS recipient,
      {trim(last('subject'))} AS subject,
      CASE WHEN cut > 0 AND len(ls) > cut THEN array_to_string(ls[cut + 1:], chr(10))
           ELSE text END AS body
    FROM (SELECT *, CASE WHEN cut > 0 THEN ls[:cut - 1] ELSE ls END AS heads
      FROM (SELECT *, coalesce(list_position(ls, ''), 0) AS cut
        FROM (SELECT *, list_transform(string_split(text, chr(10)), lambda l: {trim('l')}) AS ls
              FROM {src}))))"""


ENTITIES = {
    "mentioned_emails": every("text", fv.EMAIL_ADDRESS),
    "phone_numbers": every("text", fv.MAIL_PHONE),
    "mentioned_dates": every("text", fv.MAIL_DATE),
    "monetary_amounts": every("text", fv.MAIL_MONEY),
    "reference_numbers": every("text", fv.MAIL_REFERENCE, 1, "i"),
}

URGENCY = f"coalesce({first_set('lower(text)', fv.URGENCY_WORDS)}, 'medium')"


def mail_confidence(topic: str = "'Unknown'", intent: str = "'Unknown'") -> str:
    given = {
        "sender": "coalesce(length(sender) > 0, false)",
        "subject": "coalesce(length(subject) > 0, false)",
        "topic": f"coalesce(length({topic}) > 0 AND {topic} <> 'Unknown', false)",
        "intent": f"coalesce(length({intent}) > 0 AND {intent} <> 'Unknown', false)",
    }
    total = " + ".join(
        f"CASE WHEN {given[k]} THEN {v}::DOUBLE ELSE 0.0::DOUBLE END"
        for k, v in fv.MAIL_FACTORS.items()
    )
    count = " + ".join(f"CAST({test} AS INT)" for test in given.values())
    return f"round(CASE WHEN {count} = 0 THEN 0.5 ELSE ({total}) / ({count}) END, 6)"


# ------------------------------------------------------------------------- json


def json_parsed(src: str) -> str:
    """``src`` plus ``j``, ``inner_j`` and ``schema`` (null when the text is no JSON)."""

    def has_all(keys: str, schema: str) -> str:
        wanted = "[" + ", ".join(lit(k) for k in fv.JSON_REQUIRED[schema]) + "]"
        return f"list_has_all({keys}, {wanted})"

    nested = " ".join(
        f"WHEN nest IS NOT NULL AND {has_all('json_keys(nest)', s)} THEN {lit(s)}"
        for s in fv.JSON_REQUIRED
    )
    top = " ".join(
        f"WHEN {has_all('json_keys(j)', s)} THEN {lit(s)}" for s in fv.JSON_REQUIRED
    )
    return f"""(SELECT *, coalesce(nest, j) AS inner_j,
      CASE WHEN j IS NULL THEN NULL {nested} WHEN json_type(j) <> 'OBJECT' THEN 'unknown' {top}
           ELSE 'unknown' END AS schema
    FROM (SELECT *, CASE WHEN json_type(j) = 'OBJECT' AND len(json_keys(j)) = 1
              AND json_type(j, '$.' || json_keys(j)[1]) = 'OBJECT'
              THEN json_extract(j, '$.' || json_keys(j)[1]) END AS nest
      FROM (SELECT *, CASE WHEN json_valid({trim('text')}) THEN TRY_CAST(text AS JSON) END AS j
            FROM {src})))"""


_TYPES = {
    "object": "('OBJECT')",
    "array": "('ARRAY')",
    "string": "('VARCHAR')",
    "number": "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')",
}


def json_errors(inner: str = "inner_j") -> str:
    """Errors of the detected schema as a list."""

    def kind(path: str) -> str:
        return f"json_type({inner}, '$.{path}')"

    arms = []
    for schema in fv.JSON_REQUIRED:
        tests = []
        for path in [*fv.JSON_REQUIRED[schema], *fv.JSON_NESTED_REQUIRED[schema]]:
            holder = path.rpartition(".")[0]
            extra = f" AND {kind(holder)} = 'OBJECT'" if holder else ""
            message = lit(f"'{path}' is required")
            tests.append(f"CASE WHEN {kind(path)} IS NULL{extra} THEN {message} END")
        for path, wanted in fv.JSON_TYPES[schema].items():
            message = lit(f"'{path}' is not of type {wanted}")
            tests.append(
                f"CASE WHEN {kind(path)} IS NOT NULL AND {kind(path)} NOT IN {_TYPES[wanted]} "
                f"THEN {message} END"
            )
        listed = f"list_filter([{', '.join(tests)}], lambda e: e IS NOT NULL)"
        arms.append(f"WHEN schema = {lit(schema)} THEN {listed}")
    return f"CASE {' '.join(arms)} WHEN schema = 'unknown' THEN [{lit(fv.UNKNOWN_SCHEMA)}] END"


def json_text(path: str, inner: str = "inner_j") -> str:
    return f"json_extract_string({inner}, '$.{path}')"


JSON_CONFIDENCE = (
    "CASE WHEN j IS NULL OR len(errors) > 0 THEN 0.0::DOUBLE WHEN schema = 'unknown' "
    "THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"
)


# ------------------------------------------------------------------------ pages

STATISTICS = {
    "total_characters": "CAST(length(text) AS BIGINT)",
    "total_words": number_of("text", r"\S+"),
    "total_lines": "CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT)",
    "emails_found": number_of("text", fv.EMAIL_ADDRESS, "i"),
    "phones_found": number_of("text", fv.PAGE_PHONE),
    "dates_found": number_of("text", fv.PAGE_DATE),
    "currencies_found": number_of("text", fv.PAGE_CURRENCY),
}


def typed(src: str) -> str:
    """``src`` plus ``low`` and ``document_type``."""
    scored = best(f"(SELECT *, lower(text) AS low FROM {src})", fv.DOCUMENT_TYPE_WORDS, False, "d")
    return (
        "(SELECT *, CASE WHEN coalesce(length(text), 0) = 0 THEN 'unknown' WHEN d_best > 0 "
        f"THEN d_label ELSE 'general' END AS document_type FROM {scored})"
    )


def page_field(pattern: str) -> str:
    return f"nullif({trim(extract('text', pattern, 1, 'im'))}, '')"


def rest_of_line(pattern: str, limit: int | None = 500) -> str:
    found = trim(extract("text", pattern, 1, "im"))
    cut = f"left({found}, {limit})" if limit else found
    return f"CASE WHEN {extract('text', pattern, 1, 'im')} <> '' THEN {cut} END"


_LINES = (
    "list_transform(list_filter(string_split(text, chr(10)), lambda l: "
    f"{matches('l', fv.ITEM_LINE_PRICE)} AND {any_of('lower(l)', fv.ITEM_LINE_WORDS)}), "
    f"lambda l: {trim('l')})"
)
INVOICE_SPECIFICS = {
    "line_items": f"CASE WHEN len({_LINES}) > 0 THEN array_to_string(({_LINES})[1:10], '|') END",
    "tax_amount": f"nullif({extract('text', fv.INVOICE_TAX, 1, 'i')}, '')",
}
COMPLAINT_SPECIFICS = {
    "description": rest_of_line(fv.COMPLAINT_DESCRIPTION),
    "status": "CASE "
    + " ".join(f"WHEN contains(low, {lit(w)}) THEN {lit(w)}" for w in fv.COMPLAINT_STATUS_WORDS)
    + " END",
}
RFQ_SPECIFICS = {
    "requirements": rest_of_line(fv.RFQ_REQUIREMENTS),
    "delivery_terms": rest_of_line(fv.RFQ_DELIVERY, None),
}
_COMPANIES = (
    f"list_transform({every('text', fv.COMPANY_NAME, 1, 'i')}, lambda c: {trim('c')})"
)
_STREETS = every("text", fv.STREET_ADDRESS)
COMMON = {
    "emails": ordered_set(every("text", fv.EMAIL_ADDRESS), 5),
    "phone_numbers": ordered_set(every("text", fv.PAGE_PHONE), 5),
    "addresses": f"CASE WHEN len({_STREETS}) > 0 THEN array_to_string(({_STREETS})[1:3], '|') END",
    "companies": f"CASE WHEN len({_COMPANIES}) > 0 THEN array_to_string(({_COMPANIES})[1:3], '|') END",
}


def fields_of(kind: str) -> dict[str, str]:
    fields = {name: page_field(p) for name, p in fv.PAGE_FIELDS[kind].items()}
    fields |= {"invoice": INVOICE_SPECIFICS, "complaint": COMPLAINT_SPECIFICS, "rfq": RFQ_SPECIFICS}.get(kind, {})
    return fields | COMMON


def page_fields(src: str) -> str:
    """``src`` with ``document_type`` plus one ``{type}__{field}`` column per field."""
    columns = ", ".join(
        f"CASE WHEN document_type = {lit(kind)} THEN {sql} END AS {kind}__{name}"
        for kind in fv.PAGE_FIELDS
        for name, sql in fields_of(kind).items()
    )
    return f"(SELECT *, {columns} FROM {src})"


FIELD_NAMES = [f"{k}__{n}" for k in fv.PAGE_FIELDS for n in fields_of(k)]
FIELD_COUNT = "(" + " + ".join(f"CAST({n} IS NOT NULL AS INT)" for n in FIELD_NAMES) + ")"


_KNOWN_TYPE = "document_type <> 'unknown'"


def page_confidence(words: str, fields: str, ok: str, tables: str = "false") -> str:
    def bonus(test: str, value: float) -> str:
        return f"CASE WHEN {test} THEN {value}::DOUBLE ELSE 0.0::DOUBLE END"

    return (
        f"round(least(1.0, 0.5::DOUBLE + {bonus(f'coalesce({words}, 0) > 100', 0.2)} + "
        f"least(0.2::DOUBLE, {fields} * 0.05::DOUBLE) + {bonus(_KNOWN_TYPE, 0.1)} + "
        f"{bonus(ok, 0.1)} + {bonus(tables, 0.1)}), 6)"
    )
