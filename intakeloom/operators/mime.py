"""MIME messages: the tree of their parts, decoded payloads, PDF attachments.

A message is cut by its own structure only: a boundary counts where a part's
``Content-Type`` header declares it, inside that part, until it is closed.  Each
level of nesting is one more step over the parts of a row, so parts keep their
depth-first order, a mail is read once and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intakeloom.functions import names
from intakeloom.functions.stages import computed_once
from intakeloom.functions.text import decode_lossy, has, let, null_if_empty

#: Levels of parts within parts that are cut; a part still uncut is marked.
LEVELS = 6

# The first line that is blank or no header ends the headers.
HEADERS_END = r"(?dm)^(?:\n|(?![\x21-\x39\x3B-\x7E]*:|[ \t]|From ).)"

_PARTS = "array<struct<headers:string,body:string,content_type:string,boundary:string,open:boolean>>"
_FILES = "array<struct<file:string,name:string,content_md5:string,file_size:bigint,payload:binary>>"


def header(headers: Column, name: str) -> Column:
    """Value of the first header of a name, null without one; headers are unfolded."""
    found = F.regexp_extract_all(headers, F.lit(rf"(?dim)^{name}:([^\n]*)"), F.lit(1))
    return F.trim(F.get(found, F.lit(0)))


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r'(?s)\A\s*"(.*)"\s*\z', "$1"), r'\\(["\\])', "$1")


_VALUE = r'("(?:[^"\\]|\\["\\])*"|[^;]*)'


def _escaped_bytes(text: Column, sign: str) -> Column:
    """Bytes of a text in which ``sign`` and two hexadecimal digits stand for a byte."""
    mark = sign.encode().hex().upper()

    def piece(part: Column, k: Column) -> Column:
        coded = F.rlike(part, F.lit("^[0-9A-Fa-f]{2}"))
        return (
            F.when(k == 0, F.hex(part))
            .when(coded, F.concat(F.upper(F.left(part, F.lit(2))), F.hex(F.substr(part, F.lit(3)))))
            .otherwise(F.concat(F.lit(mark), F.hex(part)))
        )

    return F.unhex(F.array_join(F.transform(F.split(text, f"[{sign}]", -1), piece), ""))


def _in_charset(value: Column) -> Column:
    """A value ``charset'language'text`` with its bytes read in that character set."""

    def read(pieces: Column) -> Column:
        latin = F.lower(F.get(pieces, F.lit(0))).isin("iso-8859-1", "latin-1", "latin1") & (F.size(pieces) == 3)
        raw = _escaped_bytes(F.element_at(pieces, -1), "%")
        return let(raw, lambda x: F.when(latin, F.decode(x, "ISO-8859-1")).otherwise(decode_lossy(x)))

    return let(F.split(value, "'", 3), read)


def parameter(value: Column, name: str) -> Column:
    """A header's parameter: plain, with a character set, or in numbered pieces."""
    pattern = rf"(?i);\s*{name}(?:(\*)([0-9]{{1,9}})?(\*)?)?\s*=\s*{_VALUE}"
    groups = [F.regexp_extract_all(value, F.lit(pattern), F.lit(k)) for k in (1, 2, 3, 4)]
    pieces = F.transform(
        F.arrays_zip(*[group.alias(n) for group, n in zip(groups, "anzv", strict=True)]),
        lambda x: F.struct(
            F.coalesce(x["n"].try_cast("int"), F.lit(-1)).alias("n"),
            x["a"].alias("a"), x["z"].alias("z"), _unquoted(x["v"]).alias("v"),
        ),
    )

    def read(found: Column) -> Column:
        plain = F.filter(found, lambda x: x["a"] == "")
        whole = F.filter(found, lambda x: (x["a"] == "*") & (x["n"] < 0))
        rest = F.array_sort(F.filter(found, lambda x: x["n"] >= 0))
        text = F.array_join(F.transform(rest, lambda x: x["v"]), "")
        coded = F.exists(rest, lambda x: x["z"] == "*")
        extended = F.when(F.size(whole) > 0, F.get(whole, F.lit(0))["v"]).when(coded, text)
        return (
            F.when(F.size(plain) > 0, F.get(plain, F.lit(0))["v"])
            .when(extended.isNotNull(), _in_charset(extended))
            .when(F.size(rest) > 0, text)
        )

    return null_if_empty(F.trim(let(pieces, read)))


# ------------------------------------------------------------------------ tree


def _parsed(raw: Column, default: Column) -> Column:
    """Messages (an array of texts) as parts: headers, body, type, boundary, and whether there is more inside."""
    cut = F.transform(raw, lambda x: F.struct(x.alias("text"), F.regexp_instr(x, F.lit(HEADERS_END)).alias("at")))
    halves = F.transform(
        cut,
        lambda x: F.struct(
            F.regexp_replace(F.when(x["at"] > 0, F.left(x["text"], x["at"] - 1)).otherwise(x["text"]), r"\n(?=[ \t])", "").alias("headers"),
            F.when(x["at"] > 0, F.regexp_replace(F.substr(x["text"], x["at"]), r"\A\n", "")).otherwise("").alias("body"),
        ),
    )
    typed = F.transform(
        halves, lambda x: F.struct(x["headers"], x["body"], F.coalesce(header(x["headers"], "content-type"), default).alias("type"))
    )

    def part(x: Column) -> Column:
        kind = F.lower(F.trim(F.regexp_extract(x["type"], r"^[^;]*", 0)))
        kind = F.when(F.rlike(kind, F.lit(r"\A[^/]*/[^/]*\z")), kind).otherwise("text/plain")
        return F.struct(x["headers"].alias("headers"), x["body"].alias("body"), x["type"].alias("type"), kind.alias("kind"))

    def opened(x: Column) -> Column:
        declared = F.regexp_extract(x["type"], r'(?i);\s*boundary\s*=\s*("[^"]*"|[^;]*)', 1)
        boundary = F.when(F.startswith(x["kind"], F.lit("multipart/")), null_if_empty(F.rtrim(_unquoted(F.trim(declared)))))
        return F.struct(
            x["headers"].alias("headers"), x["body"].alias("body"), x["kind"].alias("content_type"), boundary.alias("boundary"),
            (F.startswith(x["kind"], F.lit("message/")) & (x["kind"] != "message/delivery-status")).alias("message"),
        )

    def part_of(x: Column) -> Column:
        more = x["boundary"].isNotNull() | x["message"]
        return F.struct(x["headers"].alias("headers"), x["body"].alias("body"), x["content_type"].alias("content_type"), x["boundary"].alias("boundary"), more.alias("open"))

    return F.transform(F.transform(F.transform(typed, part), opened), part_of)


def _inside(part: Column) -> Column:
    """The texts of the parts directly inside a part."""
    sign = F.regexp_replace(part["boundary"], r"([^A-Za-z0-9])", r"\\$1")
    closing = F.concat(F.lit("(?dm)^--"), sign, F.lit(r"--[ \t]*(?:\n|\z)"))
    delimiter = F.concat(F.lit("(?dm)^--"), sign, F.lit(r"[ \t]*(?:\n|\z)"))
    opened = F.get(F.split(part["body"], closing, 2), F.lit(0))
    pieces = F.split(opened, delimiter, -1)
    pieces = F.filter(F.slice(pieces, F.lit(2), F.size(pieces)), lambda x: x != "")
    # the line end before a delimiter belongs to the delimiter
    pieces = F.transform(pieces, lambda x: F.regexp_replace(x, r"\n\z", ""))
    return F.when(part["boundary"].isNotNull(), pieces).otherwise(F.array(part["body"]))


def _cut(part: Column) -> Column:
    """A part and, if it holds parts, those after it."""
    default = F.when(part["content_type"] == "multipart/digest", "message/rfc822").otherwise("text/plain")

    def closed(body: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.array(F.struct(
            part["headers"].alias("headers"), body.alias("body"), part["content_type"].alias("content_type"),
            none.alias("boundary"), F.lit(False).alias("open"),
        ))

    def with_inside(inside: Column) -> Column:
        holds = F.size(inside) > 0
        return F.concat(closed(F.when(~holds, part["body"])), inside)

    return F.when(part["open"], let(_parsed(_inside(part), default), with_inside)).otherwise(F.array(part))


def with_part_tree(docs: DataFrame, text: Column, name: str = "parts", levels: int = LEVELS) -> DataFrame:
    """Add all parts of a message in depth-first order, the message itself first.

    ``headers, body, content_type, boundary, open``; the body of a part that
    holds others is null.  ``open`` is true only for what lies deeper than
    ``levels`` and is left whole.  A null text has no parts.  Lines end in a line
    feed, with or without a carriage return before it.
    """
    lines = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    parts = F.when(lines.isNotNull(), _parsed(F.array(lines), F.lit("text/plain"))).otherwise(F.array().cast(_PARTS))
    docs = computed_once(docs, "_tree", parts)
    more = F.exists("_above", lambda part: part["open"])
    cut = F.when(more, F.flatten(F.transform("_above", _cut))).otherwise(F.col("_above"))
    for _ in range(levels):
        # a step of its own for each level keeps the expressions small
        docs = computed_once(docs.withColumnRenamed("_tree", "_above"), "_tree", cut).drop("_above")
    return docs.withColumnRenamed("_tree", name)


def decoded(body: Column, encoding: Column) -> Column:
    """Bytes of a body by its transfer encoding; null for parts that hold others.

    A dangling base64 character is ignored; texts that are not encoded give
    their UTF-8 bytes.
    """
    symbols = F.regexp_replace(F.regexp_extract(body, r"^[^=]*", 0), r"[^A-Za-z0-9+/]", "")
    whole = F.when(F.length(symbols) % 4 == 1, F.left(symbols, F.length(symbols) - F.lit(1))).otherwise(symbols)
    soft = F.regexp_replace(body, r"=\n|=\z", "")
    return (
        F.when(encoding == "base64", F.unbase64(whole))
        .when(encoding == "quoted-printable", _escaped_bytes(soft, "="))
        .otherwise(body.cast("binary"))
    )


def _file_name(part: Column) -> Column:
    disposition = F.coalesce(header(part["headers"], "content-disposition"), F.lit(""))
    kind = F.coalesce(header(part["headers"], "content-type"), F.lit(""))
    return F.coalesce(parameter(disposition, "filename"), parameter(kind, "name"))


def _payload(part: Column) -> Column:
    encoding = F.lower(F.trim(F.coalesce(header(part["headers"], "content-transfer-encoding"), F.lit("7bit"))))
    return decoded(part["body"], encoding)


def message_parts(docs: DataFrame, text: str = "text", levels: int = LEVELS) -> DataFrame:
    """One row per part of every message: the message itself is part 0, the others follow depth first.

    Adds ``part_no, headers, content_type, disposition, filename, payload`` and
    ``uncut``, true for a part below ``levels`` that holds others.  The payload of
    a part that holds others is null.
    """
    kept = [c for c in docs.columns if c != text]
    rows = with_part_tree(docs, F.col(text), "_parts", levels).select(*kept, F.posexplode("_parts").alias("part_no", "_part"))
    part = F.col("_part")
    return rows.withColumns(
        {
            "headers": part["headers"],
            "content_type": part["content_type"],
            "disposition": F.coalesce(header(part["headers"], "content-disposition"), F.lit("")),
            "filename": _file_name(part),
            "payload": _payload(part),
            "uncut": part["open"],
        }
    ).drop("_part")


# ----------------------------------------------------------------- attachments


def is_pdf_attachment(part: Column) -> Column:
    disposition = F.coalesce(header(part["headers"], "content-disposition"), F.lit(""))
    kind = part["content_type"]
    return F.startswith(kind, F.lit("application/")) & has(kind, "pdf") & has(disposition, "attachment")


def attachment_name(file: Column, source: Column | None) -> Column:
    """The file's name behind the stem of the mail it came with, if that has a name."""
    if source is None:
        return file
    stem = names.stem(names.base_name(source))
    return F.coalesce(F.concat(stem, F.lit("_"), names.stem(file), names.tail(file)), file)


def with_attached_pdfs(
    docs: DataFrame, text: Column, source: Column | None, name: str = "attached", levels: int = LEVELS
) -> DataFrame:
    """Add a message's PDF attachments in their order: file, name, content_md5, file_size, payload.

    A text that is null, or does not say ``attachment``, has none and is not cut.
    """
    could = F.when(F.rlike(text, F.lit(r"(?i)attachment")), text)
    docs = with_part_tree(docs, could, "_parts", levels)
    parts = F.filter("_parts", is_pdf_attachment)
    named = F.transform(parts, lambda x: F.struct(_file_name(x).alias("file"), _payload(x).alias("payload")))
    docs = computed_once(docs, "_files", F.filter(named, lambda x: x["file"].isNotNull() & x["payload"].isNotNull()))
    found = F.transform(
        "_files",
        lambda x: F.struct(
            x["file"].alias("file"),
            attachment_name(x["file"], source).alias("name"),
            F.md5(x["payload"]).alias("content_md5"),
            F.octet_length(x["payload"]).cast("bigint").alias("file_size"),
            x["payload"].alias("payload"),
        ),
    ).cast(_FILES)
    return docs.withColumn(name, found).drop("_parts", "_files")


def pdf_attachments(docs: DataFrame, text: str = "text", source: str | None = "source") -> DataFrame:
    """PDF attachments as documents of their own, in the thread of their mail."""
    found = with_attached_pdfs(docs, F.col(text), F.col(source) if source else None, "_attached")
    rows = found.select(*[c for c in docs.columns if c != text], F.explode("_attached").alias("_file"))
    return rows.withColumns(
        {
            "filename": F.col("_file.file"),
            "attachment_name": F.col("_file.name"),
            "file_size": F.col("_file.file_size"),
            "content_md5": F.col("_file.content_md5"),
            "payload": F.col("_file.payload"),
        }
    ).drop("_file")
