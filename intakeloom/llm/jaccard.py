"""N-gram Jaccard join with rare-first prefixes, and the groups its links form.

A document's set is its distinct ``SHINGLE``-word shingles (ASCII letters folded,
words between ASCII white space; fewer words are one shingle, none is the empty
set).  Two documents link when ``100 * common >= PERCENT * united``.

1. Equal sets are one class, held from here on by one document.
2. Shingles are ordered rare first.  Rarity is the number of documents in a
   shingle's hash bucket; any order gives the same links, a good one fewer pairs.
   Of ``n`` shingles the first ``n - least overlap + 1`` are the prefix; linked
   sets share a shingle there.
3. Pairs that share a prefix shingle must have sizes that allow a link (length
   filter) and room for the overlap behind the shingle (positional filter).  What
   is left is compared by the number of shingles in each of ``PARTS`` hash ranges:
   the differences add up to no more than the sets differ (suffix filter).
4. Each pair left is verified once, with both whole sets.

A group of near copies shares many shingles; it is never turned into all pairs.
First every set is paired with one at each shared shingle, the one that shares
most of its own prefix.  What these links join is one component, and then only
pairs across components are made, through the components present at a shingle.

* Rows are documents; a null text is the empty set.  Rows with equal sets link,
  whatever their ids, but empty sets link with nothing, not with each other.
* ``component_id`` is the smallest id reachable, the own one included; null ids
  count as larger than all others and give a null component among themselves.
* Documents of any length are taken whole.  Other columns pass through
  ``grouped``, whatever their names.
* Links and components stay in tables; the driver holds the bucket counts
  (``BUCKETS`` numbers) and how many labels changed in a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intakeloom.llm.shared import written

SHINGLE, PERCENT = 3, 90
BUCKETS = 1 << 17
PARTS = 256
TELLING = 8
BROADCAST_ROWS = 200_000  # of 60 bytes
LAST_ID = 2**63 - 1
_REMEMBERED = 300_000

_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_SHIFT = np.uint64(31)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingles:
    """The set of a text as ascending hashes."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.words = _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        count = len(words)
        if not count:
            return np.empty(0, np.uint64)
        if count < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b"\x00".join([b"%d" % count, *words]))], np.uint64)
        hashes = np.fromiter(map(self.words.__getitem__, words), np.uint64, count)
        mixed = np.zeros(count - self.size + 1, np.uint64)
        for k in range(self.size):
            mixed = (mixed ^ (mixed >> _SHIFT)) * _FACTORS[k % 4] + hashes[k : count - self.size + 1 + k]
        mixed = (mixed ^ (mixed >> _SHIFT)) * _FACTORS[3]
        return np.unique(mixed ^ (mixed >> _SHIFT))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Overlap that a set of ``n`` needs with any linked one."""
    return (percent * n + 99) // 100


def alpha(one: Column, other: Column, percent: int) -> Column:
    """Overlap that two sizes need for a link."""
    return F.ceil((one + other) * percent / F.lit(100 + percent))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(13)).astype(np.int64) & (BUCKETS - 1)


def _bucket_counts(documents: DataFrame, size: int) -> np.ndarray:
    """Documents in each hash bucket, counted over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingles(size), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts += np.bincount(_bucket(shingles(text)), minlength=BUCKETS) if text else 0
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], names=["bucket", "docs"])

    rows = documents.select("text").mapInArrow(run, "bucket bigint, docs bigint").groupBy("bucket").sum("docs")
    counts = np.zeros(BUCKETS)
    for bucket, docs in rows.collect():  # BUCKETS rows at most
        counts[bucket] = docs
    return counts


_SKETCH = "id bigint, spot bigint, n bigint, sig binary, prefix array<bigint>, parts binary"


def _sketched(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Size, signature, prefix and part counts of every document."""
    ranks = (np.log2(_bucket_counts(documents, size) + 1) * 2**14).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in batches:
            sizes, sigs, prefixes, parts = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text)
                n = len(found)
                sizes.append(n)
                sigs.append(xxhash.xxh3_128_digest(found.tobytes()))
                if n:
                    keys = (ranks[_bucket(found)] << np.uint64(44)) | (found >> np.uint64(20))
                    first = np.argsort(keys, kind="stable")[: n - least_overlap(n, percent) + 1]
                    prefixes.append(found[first].view(np.int64))
                    in_part = np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=PARTS)
                    parts.append(np.minimum(in_part, 255).astype(np.uint8).tobytes())
                else:
                    prefixes.append(np.empty(0, np.int64))
                    parts.append(b"")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(sigs, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(parts, pa.binary()),
                ],
                names=["id", "spot", "n", "sig", "prefix", "parts"],
            )

    return written(documents.select("id", "spot", "text").mapInArrow(run, _SKETCH), "jaccard-sketch")


def _packed(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [pack((text or "").encode("utf-8", "surrogatepass")) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "spot", "packed"]
            )

    return documents.select("id", "spot", "text").mapInArrow(run, "id bigint, spot bigint, packed binary")


def _suffix_filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose hash ranges differ by no more than linked sets can."""
    parts = classes.select(F.col("sig").alias("part_sig"), "n", "parts")
    both = (
        pairs.join(parts, F.col("a") == F.col("part_sig"))
        .select("a", "b", F.col("n").alias("a_n"), F.col("parts").alias("a_parts"))
        .join(parts, F.col("b") == F.col("part_sig"))
        .select("a", "b", "a_parts", F.col("parts").alias("b_parts"), (F.col("a_n") + F.col("n")).alias("sizes"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, other = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16)
                for k in (2, 3)
            )
            sizes = batch.column(4).to_numpy()
            least = -(-percent * sizes // (100 + percent))
            stay = np.abs(one - other).sum(1) <= sizes - 2 * least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(stay))

    return both.mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, classes: DataFrame, packed: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that link, each compared once with both whole sets."""
    pairs = written(_suffix_filtered(pairs, classes, percent), "jaccard-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    wanted = written(classes.join(needed, "sig").select("sig", "rep.id", "rep.spot"), "jaccard-wanted")
    if wanted.count() <= BROADCAST_ROWS:  # else both sides are shuffled
        wanted = F.broadcast(wanted)
    texts = written(
        packed.join(wanted, ["id", "spot"])
        .groupBy("sig")
        .agg(F.first("packed").alias("packed")),
        "jaccard-texts",
    )
    both = (
        pairs.join(texts.select(F.col("sig").alias("a"), F.col("packed").alias("a_text")), "a")
        .join(texts.select(F.col("sig").alias("b"), F.col("packed").alias("b_text")), "b")
        .select("a", "b", "a_text", "b_text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, unpack = Shingles(size), zstandard.ZstdDecompressor().decompress
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
        for batch in batches:
            stay = []
            for sig, one, other in zip(*(batch.column(k).to_pylist() for k in (1, 3, 2))):
                if last[0] != sig:
                    last = (sig, shingles(unpack(one).decode("utf-8", "surrogatepass")))
                found = shingles(unpack(other).decode("utf-8", "surrogatepass"))
                common = len(np.intersect1d(last[1], found, assume_unique=True))
                stay.append(100 * common >= percent * (len(last[1]) + len(found) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(stay, pa.bool_())
            )

    return written(both.mapInArrow(run, "a binary, b binary"), "jaccard-links")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; the label is the least node of its component.

    Rounds of hooking and jumping: a node takes the least label among its
    neighbours' and then its label's label, until nothing changes.
    """
    edges = written(
        links.select(F.col("a").alias("x"), F.col("b").alias("y"))
        .unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
        .distinct(),
        "jaccard-edges",
    )
    labels = edges.groupBy("x").agg(F.min("y").alias("near")).select(
        F.col("x").alias("node"), F.least("x", "near").alias("label")
    )
    labels = written(labels, "jaccard-labels")
    while True:
        # The least label around each node also hooks the label it has now.
        around = edges.join(labels, edges["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("near"))
        hooks = labels.join(around, labels["node"] == around["x"]).select("node", "label", F.least("label", "near").alias("near"))
        best = (
            hooks.select(F.col("label").alias("who"), "near")
            .unionByName(hooks.select(F.col("node").alias("who"), "near"))
            .groupBy("who")
            .agg(F.min("near").alias("near"))
        )
        hooked = written(
            labels.join(best, labels["node"] == best["who"]).select(
                "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
            ),
            "jaccard-hooked",
        )
        target = hooked.select(F.col("node").alias("label_node"), F.col("label").alias("label_label"))
        jumped = written(
            hooked.join(target, hooked["label"] == target["label_node"]).select(
                "node", "old", F.least("label", "label_label").alias("label")
            ),
            "jaccard-labels",
        )
        changed = jumped.where("old != label").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def _sizes_allow(small: Column, large: Column, percent: int) -> Column:
    return small * 100 >= large * percent


def linked(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows (id, spot, n, sig) and the label of each linked class.

    ``documents`` has the columns id, spot (a hash of the text) and text.
    """
    sketch = _sketched(documents, size, percent)
    classes = written(
        sketch.where("n > 0")
        .groupBy("sig")
        .agg(
            F.first("n").alias("n"),
            F.first("prefix").alias("prefix"),
            F.first("parts").alias("parts"),
            F.min(F.struct("id", "spot")).alias("rep"),
        ),
        "jaccard-classes",
    )
    packed = _packed(documents)
    grams = classes.select("sig", "n", F.posexplode("prefix").alias("place", "gram"))
    # Most shingles are met in one set only, or in sets of sizes too far apart, and go
    # here: a row whose neighbours by size are too small and too large has no partner.
    beside = Window.partitionBy("gram").orderBy("n", "sig")
    postings = written(
        grams.select(
            "gram",
            "sig",
            "n",
            "place",
            F.lag("n").over(beside).alias("before"),
            F.lead("n").over(beside).alias("after"),
        )
        .where(
            F.coalesce(_sizes_allow(F.col("before"), F.col("n"), percent), F.lit(False))
            | F.coalesce(_sizes_allow(F.col("n"), F.col("after"), percent), F.lit(False))
        )
        .drop("before", "after"),
        "jaccard-postings",
    )
    # The set that shares most of its prefix has the fewest words of its own.
    central = postings.groupBy("sig").agg((F.count("*") / F.first("n")).alias("shared"))
    hubs = (
        postings.join(central, "sig")
        .groupBy("gram")
        .agg(F.max(F.struct("shared", "sig", "n", "place")).alias("hub"))
    )

    def fitting(small: str, large: str) -> Column:
        """Length and positional filter of the smaller and the larger set at a shared shingle."""
        n1, n2 = F.col(f"{small}n"), F.col(f"{large}n")
        room = F.least(n1 - F.col(f"{small}place"), n2 - F.col(f"{large}place"))
        return _sizes_allow(n1, n2, percent) & (room >= alpha(n1, n2, percent))

    def pair(one: str, other: str) -> list[Column]:
        return [
            F.least(F.col(one), F.col(other)).alias("a"),
            F.greatest(F.col(one), F.col(other)).alias("b"),
        ]

    starred = postings.join(hubs, "gram").where(F.col("hub.sig") != F.col("sig"))
    stars = (
        starred.where(F.when(F.col("n") <= F.col("hub.n"), fitting("", "hub.")).otherwise(fitting("hub.", "")))
        .select(*pair("hub.sig", "sig"))
        .distinct()
    )
    links = _verified(stars, classes, packed, size, percent)
    labels = components(links)
    labelled = postings.join(labels, postings["sig"] == labels["node"], "left").select(
        "gram", "sig", "n", "place", F.coalesce("label", "sig").alias("component")
    )
    # Where a shingle has several components, one row of a pair is outside the largest.
    several = (
        labelled.groupBy("gram", "component")
        .count()
        .groupBy("gram")
        .agg(F.max(F.struct("count", "component")).alias("largest"), F.count("*").alias("components"))
        .where("components > 1")
        .select("gram", F.col("largest.component").alias("major"))
    )
    open_rows = written(labelled.join(several, "gram"), "jaccard-open")
    # A pair is made at the first shingle both have open; a few of them tell most others.
    first = (
        open_rows.groupBy("sig")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "gram"))), 1, TELLING).alias("first"))
        .join(open_rows, "sig")
        .select(
            "gram",
            "sig",
            "n",
            "place",
            "component",
            (F.col("component") != F.col("major")).alias("minor"),
            F.transform(
                F.filter("first", lambda x: x["place"] < F.col("place")), lambda x: x["gram"]
            ).alias("earlier"),
        )
    )
    left = first.where("minor").select("gram", F.struct("sig", "n", "place", "component", "earlier").alias("l"))
    right = first.select("gram", F.struct("sig", "n", "place", "component", "earlier", "minor").alias("r"))
    rest = (
        left.alias("left")
        .join(
            right.alias("right"),
            (F.col("left.gram") == F.col("right.gram"))
            & (F.col("l.component") != F.col("r.component"))
            & (~F.col("r.minor") | (F.col("l.sig") < F.col("r.sig")))
            & F.when(F.col("l.n") <= F.col("r.n"), fitting("l.", "r.")).otherwise(fitting("r.", "l."))
            & ~F.arrays_overlap("l.earlier", "r.earlier"),
        )
        .select(*pair("l.sig", "r.sig"))
        .distinct()
    )
    more = _verified(rest, classes, packed, size, percent)
    return sketch, components(links.unionByName(more))


def _rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(
        F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LAST_ID)).alias("id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("spot"),
        F.col(f"`{text_col}`").alias("text"),
    )


def _led(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, spot, n, leader) of every row; the leader is the least (id, spot) of its component."""
    sketch, labels = linked(rows, size, percent)
    members = sketch.join(labels, sketch["sig"] == labels["node"], "left").select(
        "id", "spot", "n", F.coalesce("label", "sig").alias("component")
    )
    # A component may hold a third of all rows: partial minima meet, and go out in eight parts.
    leaders = (
        members.where("n > 0")
        .groupBy("component")
        .agg(F.min(F.struct("id", "spot")).alias("leader"))
        .select("component", "leader", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt"))
    )
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id", "spot"), F.lit(8)).cast("int"))
    return salted.join(leaders, ["component", "salt"], "left").select(
        "id", "spot", "n", F.when(F.col("n") > 0, F.col("leader")).otherwise(F.struct("id", "spot")).alias("leader")
    )


def grouped(
    documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""

    def known(value: Column) -> Column:
        return F.when(value != LAST_ID, value)

    return _led(_rows(documents, id_col, text_col), size, percent).select(
        known(F.col("id")).alias("id"),
        F.col("n").alias("n_shingles"),
        known(F.col("leader.id")).alias("component_id"),
    )


def one_of_each(
    documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``documents`` with one row of each component, that of the least id and text hash; empty sets all stay."""
    led = _led(_rows(documents, id_col, text_col), size, percent).where(
        (F.col("leader.id") == F.col("id")) & (F.col("leader.spot") == F.col("spot"))
    )
    keepers = led.groupBy("id", "spot").agg(F.min("n").alias("keeper_n"))
    keepers = keepers.select(F.col("id").alias("keeper_id"), F.col("spot").alias("keeper_spot"), "keeper_n")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    keyed = documents.select(
        F.struct(*columns).alias("keeper_row"),
        F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LAST_ID)).alias("keeper_id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("keeper_spot"),
    )
    kept = keyed.join(keepers, ["keeper_id", "keeper_spot"])
    # Rows equal in id and text lie together now; all but one go, unless their set is empty.
    nth = F.row_number().over(Window.partitionBy("keeper_id", "keeper_spot").orderBy("keeper_id"))
    return kept.withColumn("keeper_nth", nth).where("keeper_nth = 1 OR keeper_n = 0").select("keeper_row.*")
