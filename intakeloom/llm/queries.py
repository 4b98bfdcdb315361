"""Registered queries of this package and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intakeloom.llm import (
    bpe,
    collocations,
    jaccard,
    licenses,
    merkle,
    mixing,
    personal,
    quality,
    secrets,
    syncmers,
    templates,
    toxicity,
    voronoi,
)
from intakeloom.llm import features as ft
from intakeloom.llm.shared import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return wrap


MIXING_SQL = r"""
WITH docs AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS place,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
sizes AS (SELECT no_source, source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY ALL),
weighed AS (
  SELECT *, list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY no_source, source) - 1) % 3 + 1 AS INT)) AS weight
  FROM sizes),
levels AS (
  SELECT *, sum(source_size) OVER () * 3
            - coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4 AS left_over,
         sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * 2 AS left_weight
  FROM weighed
  WINDOW f AS (ORDER BY source_size / weight, no_source, source)),
level AS (
  SELECT left_over, left_weight, source_size / weight AS ratio, no_source, source FROM levels
  WHERE left_over * weight <= source_size * 2 * left_weight
  ORDER BY ratio, no_source, source LIMIT 1),
goals AS (
  SELECT s.no_source, s.source, s.source_size,
         CASE WHEN l.left_over IS NULL OR (s.source_size / s.weight, s.no_source, s.source) < (l.ratio, l.no_source, l.source)
              THEN CAST(s.source_size * 2 AS DOUBLE)
              ELSE CAST(l.left_over * s.weight AS DOUBLE) / CAST(l.left_weight AS DOUBLE) END AS target
  FROM levels s LEFT JOIN level l ON true),
units AS (SELECT no_source, source, place, CAST(sum(size) AS BIGINT) AS size FROM docs WHERE size > 0 GROUP BY ALL),
reached AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY no_source, source ORDER BY place) AS BIGINT) AS reached FROM units),
copies AS (
  SELECT r.no_source, r.source, r.place, r.size, t.turn,
         CAST(r.reached + t.turn * g.source_size AS DOUBLE) / g.target AS finish
  FROM reached r JOIN goals g USING (no_source, source) CROSS JOIN (VALUES (0), (1)) t(turn)),
queue AS (
  SELECT *, sum(size) OVER (ORDER BY finish, no_source, source, turn, place ROWS UNBOUNDED PRECEDING) * 2 - size AS middle
  FROM copies),
taken AS (
  SELECT no_source, source, place, count(*) AS times FROM queue
  WHERE middle <= (SELECT sum(source_size) FROM sizes) * 3
  GROUP BY ALL)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, g.source_size, g.target,
       CAST(CASE WHEN d.size > 0 THEN d.size * coalesce(t.times, 0) ELSE 0 END AS BIGINT) AS taken
FROM docs d JOIN goals g USING (no_source, source) LEFT JOIN taken t USING (no_source, source, place)
"""


@query("op3_mixing", MIXING_SQL)
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.mixed(table(spark, folder, "documents")).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).cast("bigint").alias("taken"),
    )


def vocabulary() -> tuple[str, str]:
    """Path of the ranks and the pattern of the public tokenizer the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op5_bpe")
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Number and hash of every document's token ids, and the hash of the decoded bytes."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.digests(documents, *vocabulary())


def judged(frame: DataFrame, score: str, folds: int, held_out: int) -> DataFrame:
    return frame.select(
        "doc_id",
        (ft.fold(F.col("doc_id"), folds) == held_out).alias("held_out"),
        F.col(score).alias("score"),
        (F.col(score) >= 0.5).cast("int").alias("predicted"),
    )


@query("op7_quality")
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = quality.scored(documents, table(spark, folder, "labels"))
    return judged(found, "quality_score", quality.FOLDS, quality.HELD_OUT)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = toxicity.scored(documents, table(spark, folder, "labels"))
    return judged(found, "toxicity_score", toxicity.FOLDS, toxicity.HELD_OUT)


@query("op4_syncmers")
def op4_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    return syncmers.beside_next(table(spark, folder, "documents"))


VORONOI_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.vector, r.vector) AS BIGINT) AS score
  FROM rows q JOIN rows r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""


@query("op1_voronoi", VORONOI_SQL)
def op1_voronoi(spark: SparkSession, folder: str) -> DataFrame:
    """The five rows with the highest inner product to each query row."""
    embeddings = table(spark, folder, "embeddings")
    return voronoi.nearest(embeddings, embeddings.where("vec_id % 50 = 0"))


def spans_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


@query("op10_secrets")
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = F.col("secret_spans")
    base = F.filter(found, lambda x: x["kind"] != "model")
    return secrets.scanned(documents).select(
        "doc_id",
        *[number_of(found, kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(found).alias("spans"),
    )


@query("op9_personal")
def op9_personal(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    spans = F.col("personal_spans")
    base = F.filter(spans, lambda x: x["kind"] != "model")
    return personal.found(documents).select(
        "doc_id",
        *[number_of(spans, kind).alias(f"n_{kind}") for kind in personal.KINDS[:4]],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )


TEMPLATES_SQL = r"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS lines, text FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nth FROM cut),
parsed AS (
  SELECT doc_id, nth, line,
         regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'),
                            '[^\x20\x09-\x0D]+') AS tokens
  FROM lines),
leaves AS (
  SELECT doc_id, nth, line, tokens[:2] AS path, tokens[3:] AS rest, len(tokens) AS n FROM parsed WHERE len(tokens) >= 4),
keys AS (
  SELECT doc_id, nth, n, path, 'all' AS field, rest AS template FROM leaves
  UNION ALL
  SELECT doc_id, nth, n, path, 'but ' || q, list_concat(list_concat(rest[:len(rest) * q // 4], ['<*>']), rest[len(rest) * (q + 1) // 4 + 1:])
  FROM leaves, range(4) r(q) WHERE n >= 8),
recurring AS (
  SELECT n, path, field, template, min(doc_id) AS first FROM keys
  GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
gone AS (
  SELECT DISTINCT doc_id, nth FROM keys JOIN recurring USING (n, path, field, template) WHERE doc_id > first),
stay AS (
  SELECT doc_id, count(*) AS kept, string_agg(line, chr(10) ORDER BY nth) AS text
  FROM lines ANTI JOIN gone USING (doc_id, nth) GROUP BY doc_id)
SELECT c.doc_id, coalesce(len(c.lines), 0) AS n_lines, coalesce(len(c.lines), 0) - coalesce(s.kept, 0) AS n_dropped,
       CASE WHEN c.text IS NOT NULL THEN sha256(coalesce(s.text, '')) END AS text_sha256
FROM cut c LEFT JOIN stay s USING (doc_id)
"""


@query("op2_templates", TEMPLATES_SQL)
def op2_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document, those dropped, and the hash of the text that stays."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return templates.without_recurring(documents).select(
        "doc_id",
        F.col("template_lines").alias("n_lines"),
        F.col("template_dropped").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 90 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, b.y FROM reach r JOIN edges b ON b.x = r.other)
SELECT s.doc_id, CAST(n AS BIGINT) AS n_shingles, min(other) AS component_id
FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, n
"""


@query("op6_jaccard", JACCARD_SQL)
def op6_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Size of every document's shingle set and the component it belongs to."""
    return jaccard.grouped(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id"
    )


MERKLE_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_of),
fields AS (
  SELECT row_number() OVER () AS n, doc_id, source, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         xor(list_reduce(string_split(CAST(doc_id AS VARCHAR), ''), lambda c, x:
           xor(c >> 8, crc_of[CAST(xor(c & 255, ascii(x)) AS BIGINT) + 1]), 4294967295), 4294967295) % 5 = 0 AS hit
  FROM documents, crc_table),
docs AS (
  SELECT n, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' ||
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS changed, hit
  FROM fields),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, n) - 1 AS place,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS rank
  FROM docs),
levels(rank, level, l) AS (
  SELECT rank, 0, list(leaf ORDER BY place) FROM ranked GROUP BY rank
  UNION ALL
  SELECT rank, level + 1, list_transform(range(0, len(l), 16), lambda i: sha256(array_to_string(l[i + 1:i + 16], '')))
  FROM levels WHERE len(l) > 1),
subroots AS (SELECT rank, l[1] AS subroot FROM levels WHERE len(l) = 1),
above(level, l) AS (
  SELECT 0, list(subroot ORDER BY rank) FROM subroots HAVING count(*) > 0
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(l), 16), lambda i: sha256(array_to_string(l[i + 1:i + 16], '')))
  FROM above WHERE len(l) > 1),
met AS (
  SELECT n, level, l, place AS p FROM ranked JOIN levels USING (rank) WHERE len(l) > 1
  UNION ALL
  SELECT n, 100 + above.level, l, rank FROM ranked, above WHERE len(l) > 1),
steps AS (
  SELECT n, row_number() OVER (PARTITION BY n ORDER BY level) AS step,
         l[(p >> (4 * (level % 100 + 1))) * 16 + 1:(p >> (4 * (level % 100 + 1))) * 16 + 16] AS run,
         (p >> (4 * (level % 100))) % 16 AS slot
  FROM met),
folded(n, step, fold) AS (
  SELECT n, 0, CASE WHEN hit THEN changed ELSE leaf END FROM docs
  UNION ALL
  SELECT n, s.step, sha256(array_to_string(run[:slot], '') || fold || array_to_string(run[slot + 2:], ''))
  FROM folded f JOIN steps s USING (n) WHERE s.step = f.step + 1),
ends AS (SELECT n, arg_max(fold, step) AS fold FROM folded GROUP BY n),
proofs AS (
  SELECT n, string_agg(array_to_string(run[:slot], '') || array_to_string(run[slot + 2:], ''), '' ORDER BY step) AS siblings
  FROM steps GROUP BY n)
SELECT doc_id, leaf, subroot, r.root, sha256(coalesce(siblings, '')) AS proof_sha256, fold AS folded_root, fold = r.root AS verified
FROM ranked JOIN subroots USING (rank) JOIN ends USING (n) LEFT JOIN proofs USING (n),
     (SELECT l[1] AS root FROM above WHERE len(l) = 1) r
"""


@query("op11_merkle", MERKLE_SQL)
def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Proof of every document, and whether the document as it may have been tampered with still proves."""
    found = merkle.proofs(table(spark, folder, "documents"), merkle.tampered(5))
    proof = F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def template_values() -> str:
    """The templates as rows of SQL."""
    return ", ".join(
        f"('{one.label}', {one.phrase}, [{', '.join(repr(word) for word in one.words)}], {one.need})"
        for one in licenses.templates()
    )


LICENSES_SQL = rf"""
WITH templates(label, phrase, sequence, need) AS (VALUES {template_values()}),
words AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{licenses.WORD}') AS w
  FROM documents),
blocks AS (
  SELECT n, w, start, list_distinct(w[start + 1:start + {licenses.BLOCK}]) AS held
  FROM words, unnest(range(0, len(w), {licenses.STEP})) s(start)),
met AS (
  SELECT n, label, phrase, start, w, sequence, len(list_intersect(held, sequence)) / len(list_distinct(sequence)) AS containment
  FROM blocks, templates WHERE len(list_intersect(held, sequence)) >= need),
found AS (
  SELECT n, label, phrase, containment, CASE WHEN phrase THEN list_filter(range(start, start + {licenses.STEP}),
    lambda k: w[k + 1:k + len(sequence)] = sequence) END AS places
  FROM met),
sums AS (
  SELECT n, sum(len(places)) AS n_base, min(list_min(places)) AS first_word, max(list_max(places)) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS score
  FROM found WHERE NOT phrase OR len(places) > 0 GROUP BY n)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM words LEFT JOIN sums USING (n)
"""


@query("op12_licenses", LICENSES_SQL)
def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scanned(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
counts AS (
  SELECT lang, size, array_to_string(w[k:k + size - 1], ' ') AS phrase, count(*) AS f
  FROM words, range(1, 5) s(size), unnest(range(1, len(w) - size + 2)) p(k) GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, size, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head,
         array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM counts, range(1, 4) c(k) WHERE k < size),
scores AS (
  SELECT c.lang, c.size, c.phrase, a, h.f AS l, t.f AS r, k, CAST(a AS HUGEINT) * 2000000 // (h.f + t.f) AS score
  FROM cuts c JOIN counts h ON (h.lang, h.phrase) = (c.lang, c.head) JOIN counts t ON (t.lang, t.phrase) = (c.lang, c.tail)),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[k:k + m - 1], ' ') AS phrase, max(f) AS f
  FROM counts, range(2, 4) l(m), range(1, 4) s(k) WHERE m < size AND k + m - 1 <= size GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside i ON (i.lang, i.phrase) = (b.lang, b.phrase)
  WHERE i.f IS NULL OR CAST(i.f AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(t.n AS BIGINT) AS n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""


@query("op13_collocations", COLLOCATIONS_SQL)
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The two thousand best phrases of each language."""
    return collocations.collocations(table(spark, folder, "documents"))
