"""Merkle manifest of a table: every row a leaf, a tree for each source, a root over all, and proofs.

The manifest is built level by level: sixteen neighbouring nodes become one
row that links each of them to their parent.  Proofs and checks climb it: a
recursive query takes the leaves of one run together from parent to parent,
appends the siblings met on the way and folds each leaf's own, possibly
tampered, digest into the next one.

* A digest is the lowercase hexadecimal SHA-256 of its inputs put together,
  digests as hexadecimal text.  Tables hold the 32 bytes.
* A leaf covers ``fields`` in their order, each ``-`` for null and else its
  number of UTF-8 bytes, ``:``, its value.  Other columns take no part, whatever
  their names; a null text therefore differs from an empty one.
* Leaves of a source ascend by id, a null id first, ties by digest (equal rows
  have equal digests, so their order cannot be seen).  Sources ascend by UTF-8
  bytes, a null source first; a null source is a source.
* Sixteen neighbours become one node while a source has several; the last run
  may be shorter, even one.  A lone leaf is its source's root as it is, and a
  lone source's root the root of all.  An empty table has no root and no rows.
* Every row gives one proof, repeated rows one each.
* Positions come from a range sort over source, id and digest, counted within
  ranges and added up over them, so that no source is in one task.  Nodes that
  many runs climb through are copied, one copy for ``CLIMBERS`` runs, and a run
  picks its copy by hash.
* Lineage is cut by tables in the folder the cluster shares.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intakeloom.llm.shared import written

FANOUT = 16
CLIMBERS = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: The tree over the sources; no source's tree has this name.
TOP = "*"

LEVEL_LIMIT = "spark.sql.cteRecursionLevelLimit"
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


@dataclass
class Manifest:
    """Tables of a built manifest."""

    #: tree, at (place in the tree), id, leaf, fold (the leaf to be checked)
    leaves: DataFrame
    #: tree, level, at, copy, kids, digest, and the link up: up_tree, up_level, up_at, up_copies, slot
    nodes: DataFrame
    #: runs of leaves that climb together: tree, level, at, copy, seed, ids, leaves, folds, slots
    runs: DataFrame
    #: greatest number of parents above a leaf
    height: int


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def digest_of(kids: Column) -> Column:
    """Digest over digests, given as their bytes put together."""
    return digest(F.lower(F.hex(kids)))


def leaf(**changed: Column) -> Column:
    """Digest of a row, with some fields replaced."""
    return digest(F.concat(*[field(changed.get(name, F.col(name))) for name in FIELDS]))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(every: int = 5) -> Column:
    """The leaf after lower-casing A-Z where ``every`` divides the id's CRC-32; null elsewhere."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return F.when(hit, leaf(text=lowered(F.col("text"))))


def tree_of(source: Column) -> Column:
    """A tree's name; names sort as sources do."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source))


def placed(rows: DataFrame, group: str, order: list[str], ranges: int) -> DataFrame:
    """Rows with ``at``, their place within the group, and ``n``, the group's number of rows.

    A range sort deals groups of any size to tasks; a row's place is its place
    within the range plus the rows of the group in the ranges before.
    """
    salt = "place_salt"  # parts rows that are equal in all that is sorted by
    dealt = rows.withColumn(salt, F.floor(F.rand(7) * 1024))
    dealt = dealt.repartitionByRange(ranges, group, *order, salt).sortWithinPartitions(group, *order, salt)
    number = F.monotonically_increasing_id()
    dealt = written(dealt.drop(salt).select("*", number.alias("number")), "merkle-placed")
    piece = F.shiftright("number", 33)
    pieces = dealt.groupBy(group, piece.alias("piece")).agg(F.min("number").alias("first"), F.count("*").alias("size"))
    before = Window.partitionBy(group).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        F.col(group).alias("piece_group"),
        "piece",
        (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("size").over(Window.partitionBy(group)).alias("n"),
    )
    met = (F.col(group) == F.col("piece_group")) & (piece == F.col("piece"))
    return dealt.join(pieces, met).select(*rows.columns, (F.col("number") + F.col("shift")).alias("at"), "n")


def parent(rows: DataFrame, *more: str) -> DataFrame:
    """Every ``FANOUT`` neighbours of trees with several nodes as one row, which lists them in order."""
    kids = F.array_sort(F.collect_list(F.struct("at", "digest", "runs", *more)))
    up = F.expr(f"at div {FANOUT}").alias("up_at")
    return rows.where("n > 1").groupBy("tree", "n", up).agg(kids.alias("kids"), F.sum("runs").alias("all_runs"))


def put_together(kids: Column, name: str) -> Column:
    return F.aggregate(kids, F.lit(b""), lambda all_, kid: F.concat(all_, kid[name]))


def next_level(linked: DataFrame) -> DataFrame:
    """The parents as rows of the next level."""
    kids = put_together(F.col("kids"), "digest")
    return linked.select(
        "tree",
        F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"),
        F.col("up_at").alias("at"),
        kids.alias("below"),
        digest_of(kids).alias("digest"),
        F.col("all_runs").alias("runs"),
    )


def copies(runs: Column) -> Column:
    return F.ceil(runs / CLIMBERS)


def links(linked: DataFrame, level: int) -> DataFrame:
    """The nodes of a level with their children's digests and the way up."""
    return linked.select("tree", "up_at", "all_runs", F.explode("kids").alias("kid")).select(
        "tree",
        F.lit(level).alias("level"),
        F.col("kid.at").alias("at"),
        F.col("kid.runs").alias("runs"),
        F.col("kid.below").alias("below"),
        F.col("kid.digest").alias("digest"),
        F.col("tree").alias("up_tree"),
        F.lit(level + 1).alias("up_level"),
        "up_at",
        copies(F.col("all_runs")).alias("up_copies"),
        F.pmod(F.col("kid.at"), F.lit(FANOUT)).cast("int").alias("slot"),
    )


def climbed_levels(rows: DataFrame) -> tuple[list[DataFrame], DataFrame, int]:
    """Nodes linked to their parents, the trees' highest nodes, and the number of levels above ``rows``.

    ``rows`` are level 1: tree, n, at, below, digest, runs.
    """
    nodes, tops, level = [], [], 1
    while True:
        tops.append(rows.where("n = 1").select("tree", F.lit(level).alias("level"), "digest", "below", "runs"))
        if rows.where("n > 1").isEmpty():
            return nodes, reduce(DataFrame.unionByName, tops), level
        linked = written(parent(rows, "below"), "merkle-level")
        nodes.append(links(linked, level))
        rows, level = next_level(linked), level + 1


def built(docs: DataFrame, fold: Column | None = None, fanned: int | None = None) -> Manifest:
    """The manifest of ``docs``; ``fold`` is the leaf to check instead of a row's own (null: its own)."""
    spark = docs.sparkSession
    ranges = fanned or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    slim = docs.select(
        tree_of(F.col("source")).alias("tree"),
        F.col("doc_id").alias("id"),
        leaf().alias("leaf"),
        (F.lit(None).cast("binary") if fold is None else fold).alias("fold"),
    )
    slim = slim.select("tree", "id", "leaf", F.coalesce("fold", "leaf").alias("fold"))
    leaves = written(placed(slim, "tree", ["id", "leaf"], ranges), "merkle-leaves")

    # Runs of neighbouring leaves are the lowest nodes and climb together.
    runs = written(
        parent(leaves.select("tree", "n", "at", F.col("leaf").alias("digest"), F.lit(1).alias("runs"), "id", "fold"), "id", "fold"),
        "merkle-runs",
    )
    first = next_level(runs).withColumn("runs", F.lit(1).cast("bigint"))
    nodes, tops, height = climbed_levels(first)

    # Each source's root, or its lone leaf, is a node of the tree over the sources.
    lone = leaves.where("n = 1").select(
        "tree", F.lit(0).alias("level"), F.col("leaf").alias("digest"), F.lit(None).cast("binary").alias("below"), F.lit(1).cast("bigint").alias("runs")
    )
    roots = tops.unionByName(lone)
    # Places of the sources among each other, by the same range sort, in one group.
    ranked = placed(roots.withColumn("all", F.lit(TOP)), "all", ["tree"], ranges)
    ranked = written(ranked, "merkle-roots")
    over = parent(ranked.select(F.lit(TOP).alias("tree"), "n", "at", "digest", "runs", "below", F.col("tree").alias("of"), "level"), "below", "of", "level")
    over = written(over, "merkle-over")
    single = ranked.where("n = 1").select("tree", "level", "digest", "below", "runs")
    above, highest, more = climbed_levels(next_level(over))

    def rooted(rows: DataFrame, level: Column) -> DataFrame:
        """Nodes without a parent."""
        return rows.select(
            "tree", level.cast("int").alias("level"), F.lit(0).cast("bigint").alias("at"), "runs", "below", "digest",
            F.lit(None).cast("string").alias("up_tree"), F.lit(None).cast("int").alias("up_level"),
            F.lit(None).cast("bigint").alias("up_at"), F.lit(None).cast("bigint").alias("up_copies"), F.lit(None).cast("int").alias("slot"),
        )

    joint = over.select("up_at", "all_runs", F.explode("kids").alias("kid")).select(
        F.col("kid.of").alias("tree"), F.col("kid.level").alias("level"), F.lit(0).cast("bigint").alias("at"),
        F.col("kid.runs").alias("runs"), F.col("kid.below").alias("below"), F.col("kid.digest").alias("digest"),
        F.lit(TOP).alias("up_tree"), F.lit(1).alias("up_level"), "up_at",
        copies(F.col("all_runs")).alias("up_copies"), F.pmod(F.col("kid.at"), F.lit(FANOUT)).cast("int").alias("slot"),
    )
    every = [*nodes, joint, *above, rooted(highest, F.col("level")), rooted(single, F.col("level"))]
    linked = reduce(DataFrame.unionByName, every).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies(F.col("runs")) - 1)))
    linked = written(linked, "merkle-nodes")

    # A lone leaf starts at its parent in the tree over the sources.
    alone = leaves.where("n = 1").join(
        linked.where("level = 0").select(F.col("tree").alias("leaf_tree"), "up_tree", "up_level", "up_at", "up_copies", "slot"),
        F.col("tree") == F.col("leaf_tree"),
    )
    seeds = runs.select(
        "tree", F.lit(1).alias("level"), F.col("up_at").alias("at"), F.lit(1).cast("bigint").alias("of"),
        F.col("kids.id").alias("ids"), F.col("kids.digest").alias("leaves"), F.col("kids.fold").alias("folds"),
        F.transform("kids", lambda kid: F.pmod(kid["at"], F.lit(FANOUT)).cast("int")).alias("slots"),
        F.lit(None).cast("binary").alias("subroot"), F.xxhash64("tree", "up_at").alias("seed"),
    ).unionByName(alone.select(
        F.col("up_tree").alias("tree"), F.col("up_level").alias("level"), F.col("up_at").alias("at"), F.col("up_copies").alias("of"),
        F.array("id").alias("ids"), F.array("leaf").alias("leaves"), F.array("fold").alias("folds"), F.array("slot").alias("slots"),
        F.col("leaf").alias("subroot"), F.xxhash64("tree", F.lit(0)).alias("seed"),
    ))
    seeds = seeds.withColumn("copy", F.pmod("seed", F.col("of"))).drop("of")
    return Manifest(leaves, linked, seeds, height + more)


#: Climbs from parent to parent.  ``run`` holds the leaves' own run, ``beside`` the siblings met above it;
#: ``slots`` has each leaf's place in its run at first, one place for all afterwards.
CLIMB = """
WITH RECURSIVE climb (tree, level, at, copy, seed, ids, leaves, own, slots, folds, run, beside, subroot, root) AS (
  SELECT tree, level, at, copy, seed, ids, leaves, slots, slots, folds, CAST(NULL AS BINARY), CAST('' AS BINARY), subroot,
         CASE WHEN tree IS NULL THEN subroot END
  FROM {runs}
  UNION ALL
  SELECT n.up_tree, n.up_level, n.up_at, pmod(c.seed, n.up_copies), c.seed, c.ids, c.leaves, c.own,
         array(n.slot),
         transform(c.folds, (x, k) -> unhex(sha2(CAST(lower(hex(concat(
           substring(n.below, 1, 32 * element_at(c.slots, least(k + 1, size(c.slots)))), x,
           substring(n.below, 32 * element_at(c.slots, least(k + 1, size(c.slots))) + 33)))) AS BINARY), 256))),
         coalesce(c.run, n.below),
         CASE WHEN c.run IS NULL THEN c.beside ELSE concat(c.beside,
           substring(n.below, 1, 32 * c.slots[0]), substring(n.below, 32 * c.slots[0] + 33)) END,
         CASE WHEN c.subroot IS NULL AND (n.up_tree IS NULL OR n.up_tree <> n.tree) THEN n.digest ELSE c.subroot END,
         CASE WHEN n.up_tree IS NULL THEN n.digest END
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.level = n.level AND c.at = n.at AND c.copy = n.copy
)
SELECT ids, leaves, own, folds, run, beside, subroot, root FROM climb WHERE tree IS NULL
"""


def climb(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """Runs of leaves at the root, with their siblings and what their leaves fold to."""
    limits = {LEVEL_LIMIT: str(manifest.height + 4), ROW_LIMIT: "-1"}
    given = {name: spark.conf.get(name, None) for name in limits}
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        return written(spark.sql(CLIMB, runs=manifest.runs, nodes=manifest.nodes), "merkle-climbed")
    finally:
        for name, value in given.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def proofs(docs: DataFrame, fold: Column | None = None) -> DataFrame:
    """For every row its leaf, its source's root, the root, the siblings on its way there and what its leaf folds to.

    ``siblings`` are digests put together, from the leaf's run upwards, left to
    right.  ``verified`` says whether the folded digest equals the root.
    """
    at_root = climb(docs.sparkSession, built(docs, fold))
    own = F.arrays_zip("ids", "leaves", "folds", "own")
    rows = at_root.select("run", "beside", "subroot", "root", F.explode(own).alias("x"))
    siblings = F.expr(
        "concat(substring(coalesce(run, X''), 1, 32 * coalesce(x.own, 0)),"
        " substring(coalesce(run, X''), 32 * coalesce(x.own, 0) + 33), beside)"
    )
    return rows.select(
        F.col("x.ids").alias("doc_id"),
        F.lower(F.hex("x.leaves")).alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"),
        F.lower(F.hex("root")).alias("root"),
        F.lower(F.hex(siblings)).alias("siblings"),
        F.lower(F.hex("x.folds")).alias("folded_root"),
        (F.col("x.folds") == F.col("root")).alias("verified"),
    )
