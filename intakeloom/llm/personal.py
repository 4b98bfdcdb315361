"""Personal data: formats with tests, and boosted trees over further candidates.

Base findings are the matches of four formats that pass a test.  Generators of
high recall propose more spans (addresses written around the at sign, all runs
that look like numbers of some kind); those that overlap no base finding are
scored by gradient-boosted trees over their form and the words before them, and
added where the score reaches a calibrated threshold.  Everything is made of
built-in functions: the trees, once fitted, are an expression too.

* The trees learn from all candidates of all documents: a candidate is positive
  where a base finding overlaps it.  Candidates of one form are one example with
  their number as weight.  With a ``limit`` they learn from at most ``4 * limit``
  candidates (the least hashes of id and start) of at most ``limit`` documents (the
  least id hashes).  The
  features leave out what the tests look at, so the trees judge by form and
  context alone.  The threshold is the least that keeps ``PRECISION`` on the
  quarter kept out of training; without one, or without both classes, nothing is
  added.
* Base findings always stay.  Matches of one kind do not overlap; a match that
  fails its test is dropped and not tried again.  Spans count code points, the
  end exclusive, and are listed by kind, then start.
* A null text counts as empty and has no findings.  Texts are read whole;
  repeated rows are searched each; other columns pass through (a column of the
  result's name is replaced).
* Patterns are written so that no start is tried twice within a run and no
  repetition of a group is kept on the stack, also in very long texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intakeloom.functions.stages import computed_once
from intakeloom.llm.shared import written

KINDS = ("email", "ip", "card", "phone", "model")
# Possessive repetitions: what follows never gives back what they took.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATES = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[\[(]\x20?at\x20?[\])])\x20?[A-Za-z0-9-]{1,64}+"
    r"(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]{1,64}+){1,8}+",
    r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,24}+(?![0-9A-Za-z])",
)
WORDS_BEFORE = {
    "said_phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|whatsapp)",
    "said_card": r"(?i)(?:card|visa|credit|debit|iban|account|payment)",
    "said_mail": r"(?i)(?:mail|contact|write|reach)",
    "said_host": r"(?i)(?:\bip\b|host|addr|server|from)",
    "said_other": r"(?i)(?:order|ref|invoice|id|isbn|version|date|item|no)\b",
}
BEFORE = 24
PRECISION = 0.95
STEPS = 100


def hits(text: Column, pattern: str) -> Column:
    """All matches as (start, end, hit), places in code points."""
    regex = F.lit(pattern)
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, regex, F.lit(0)),
        lambda gap, hit: F.struct(F.length(gap).cast("bigint").alias("gap"), hit.alias("hit")),
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.coalesce(F.length(pair["hit"]), F.lit(0)).cast("bigint")
        one = F.array(F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit")))
        return F.struct(
            end.alias("at"),
            F.when(pair["hit"].isNull(), state["found"]).otherwise(F.concat(state["found"], one)).alias("found"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found"))
    return F.aggregate(pairs, start, step, lambda state: state["found"])


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has the check digit of card numbers."""
    size = F.length(number)
    total = F.aggregate(
        F.sequence(F.lit(1), size),
        F.lit(0),
        lambda total, at: total
        + F.when(
            (size - at) % 2 == 1,
            F.substring(number, at, F.lit(1)).cast("int") * 2
            - F.when(F.substring(number, at, F.lit(1)).cast("int") > 4, 9).otherwise(0),
        ).otherwise(F.substring(number, at, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        size = F.length(digits(hit))
        return F.when(size.between(13, 19), luhn(digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    return F.lit(True)


#: What a text must hold for a pattern to match at all.
NEEDS = {
    "email": lambda text: F.contains(text, F.lit("@")),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]"),
    "card": lambda text: text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda text: text.rlike(r"\+[0-9]"),
}
_SPAN = "struct<kind:string,start:bigint,end:bigint>"
_NO_SPANS = f"array<{_SPAN}>"


def spans_of(text: Column, kind: str) -> Column:
    """The matches of one kind that pass its test."""
    good = F.filter(hits(text, PATTERNS[kind]), lambda x: passes(kind, x["hit"]))
    spans = F.transform(
        good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    )
    return F.when(NEEDS[kind](text), spans).otherwise(F.array().cast(_NO_SPANS))


def base_spans(text: Column) -> Column:
    """The base findings of a text, by kind, then start."""
    return F.concat(*[spans_of(text, kind) for kind in KINDS[:4]])


def overlaps(one: Column, other: Column) -> Column:
    return (one["start"] < other["end"]) & (other["start"] < one["end"])


FEATURES = (
    "size", "digits", "dots", "dashes", "blanks", "brackets", "plus", "at_sign", "letters", "longest", *WORDS_BEFORE
)


def features(text: Column, x: Column) -> Column:
    """Form of a candidate and the words before it, as doubles."""
    hit = x["hit"]
    place = F.greatest(x["start"] - BEFORE, F.lit(0))
    before = F.substring(text, (place + 1).cast("int"), (x["start"] - place).cast("int"))

    def count(pattern: str) -> Column:
        return F.regexp_count(hit, F.lit(pattern)).cast("double")

    longest = F.array_max(F.transform(F.split(hit, "[^0-9]+", -1), lambda run: F.length(run))).cast("double")
    return F.struct(
        F.length(hit).cast("double").alias("size"),
        count("[0-9]").alias("digits"),
        count("[.]").alias("dots"),
        count("-").alias("dashes"),
        count(r"\x20").alias("blanks"),
        count("[()\\[\\]]").alias("brackets"),
        F.startswith(hit, F.lit("+")).cast("double").alias("plus"),
        F.contains(hit, F.lit("@")).cast("double").alias("at_sign"),
        count("[A-Za-z]").alias("letters"),
        longest.alias("longest"),
        *[before.rlike(words).cast("double").alias(name) for name, words in WORDS_BEFORE.items()],
    )


def candidates(text: Column) -> Column:
    """(start, end, hit) of everything a generator proposes; spans of different ones may overlap."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")
    mail = F.when(text.rlike(r"@|[\[(]\x20?at\x20?[\])]"), hits(text, CANDIDATES[0])).otherwise(none)
    number = F.when(text.rlike(r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"), hits(text, CANDIDATES[1])).otherwise(none)
    return F.concat(mail, number)


def _tree(node, row: Column) -> Column:
    """A fitted tree as nested conditions."""
    if "Leaf" in node.getClass().getSimpleName():
        return F.lit(float(node.prediction()))
    split = node.split()
    name = FEATURES[split.featureIndex()]
    return F.when(row[name] <= float(split.threshold()), _tree(node.leftChild(), row)).otherwise(
        _tree(node.rightChild(), row)
    )


class Trees:
    """Boosted trees as an expression, and the score from which a candidate is a finding."""

    def __init__(self, roots: list, weights: list[float]):
        self.roots, self.weights, self.threshold = roots, weights, 2.0

    def score(self, row: Column) -> Column:
        parts = [_tree(root, row) * weight for root, weight in zip(self.roots, self.weights)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(reduce(lambda a, b: a + b, parts) * -2.0))


def fit(documents: DataFrame, limit: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> Trees | None:
    texts = documents.select(
        F.col(f"`{id_col}`").alias("sample_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    if limit is not None:
        ids = texts.select("sample_id").where("sample_id IS NOT NULL").orderBy(F.xxhash64("sample_id"), "sample_id")
        texts = texts.join(F.broadcast(ids.limit(limit).distinct()), "sample_id")
    proposed = computed_once(texts, "candidates", candidates(F.col("text"))).where("size(candidates) > 0")
    marked = F.transform(
        "candidates",
        lambda x: F.struct(
            F.xxhash64("sample_id", x["start"]).alias("spot"),
            F.exists("base", lambda b: overlaps(b, x)).cast("double").alias("label"),
            (F.pmod(F.xxhash64("sample_id", x["start"]), F.lit(4)) == 0).alias("apart"),
            features(F.col("text"), x).alias("row"),
        ),
    )
    order = [*FEATURES, "label", "apart"]
    every = (
        computed_once(proposed, "base", base_spans(F.col("text")))
        .select(F.explode(marked).alias("x"))
        .select("x.spot", "x.label", "x.apart", "x.row.*")
    )
    if limit is not None:
        every = every.orderBy("spot", *order).limit(4 * limit)  # a sample of all lengths and kinds
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    examples = written(
        every.groupBy(*order)
        .agg(F.count("*").cast("double").alias("n"))
        .repartition(tasks, *order)
        .sortWithinPartitions(*order),  # reruns learn from the same rows in the same order
        "personal-examples",
    )
    classes = {
        (row.apart, row.label): row.n for row in examples.groupBy("apart", "label").agg(F.sum("n").alias("n")).collect()
    }  # four rows at most
    if any(classes.get((apart, label), 0) < 2 for apart in (True, False) for label in (0.0, 1.0)):
        return None
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(examples.where("NOT apart"))
    fitted = GBTClassifier(
        featuresCol="vector", labelCol="label", weightCol="n", maxIter=6, maxDepth=3, maxBins=16, seed=5
    ).fit(assembled.select("vector", "label", "n"))
    trees = Trees([tree._java_obj.rootNode() for tree in fitted.trees], list(fitted.treeWeights))
    row = F.struct(*[F.col(name) for name in FEATURES])
    steps = (
        examples.where("apart")
        .groupBy(F.floor(trees.score(row) * STEPS).alias("step"))
        .agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good"))
        .orderBy(F.desc("step"))
        .collect()
    )  # at most STEPS + 1 rows
    n = good = 0.0
    for step in steps:
        n, good = n + step.n, good + step.good
        if step.step * 2 >= STEPS and good / n >= PRECISION:
            trees.threshold = step.step / STEPS
    return trees


def found(
    documents: DataFrame,
    limit: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    spans_col: str = "personal_spans",
) -> DataFrame:
    """``documents`` with the findings of every whole text: kind, start and end."""
    trees = fit(documents, limit, id_col, text_col)
    kept = [F.col(f"`{c}`") for c in documents.columns if c != spans_col]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = computed_once(documents.select(*kept), "personal_base", base_spans(text))
    spans = F.col("personal_base")
    if trees is not None and trees.threshold <= 1:
        rows = computed_once(rows, "personal_more", candidates(text))
        more = F.filter(
            "personal_more",
            lambda x: ~F.exists("personal_base", lambda b: overlaps(b, x))
            & (trees.score(features(text, x)) >= trees.threshold),
        )
        added = F.transform(
            more,
            lambda x: F.struct(F.lit("model").alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
        )
        spans = F.concat(
            spans,
            F.when(F.size("personal_more") > 0, F.array_sort(added)).otherwise(F.array().cast(_NO_SPANS)),
        )
    return rows.select(*kept, spans.alias(spans_col))


def redacted(documents: DataFrame, text_col: str = "text", spans_col: str = "personal_spans") -> DataFrame:
    """``documents`` with every finding in the text replaced by its kind in square brackets.

    Of findings that overlap, the first keeps its name and both go.
    """
    text = F.col(f"`{text_col}`")
    by_start = F.array_sort(
        F.transform(
            spans_col,
            lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")),
        )
    )

    def step(state: Column, x: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int"))
        fresh = x["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(state["done"], gap, F.lit("["), x["kind"], F.lit("]")))
            .otherwise(state["done"])
            .alias("done"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("done"))
    whole = F.aggregate(
        by_start,
        start,
        step,
        lambda s: F.concat(s["done"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))),
    )
    return documents.withColumn(text_col, F.when(F.size(spans_col) > 0, whole).otherwise(text))
