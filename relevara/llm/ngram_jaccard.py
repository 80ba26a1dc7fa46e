"""N-gram Jaccard join by vertical partitioning.

The shingles have one global order: rare ones first, by document frequency, then by hash.  Two sets
of sizes x and y that reach the threshold t share at least o = t / (1 + t) * (x + y) shingles, so the
first shingle that they share in that order stands before place x - o + 1 in the one set and before
place y - o + 1 in the other.  Only the places before x - ceil(t * x) + 1 can meet any partner: these
prefixes are the fragment of the order in which candidates are sought.  A passage that many texts hold
lies behind the prefixes of all texts that have enough of their own.

A shingle that only one set holds meets nothing.  They are counted in a fragment of the order of
hashes first, over the whole corpus: a set with more of them there than its prefix is long has no
partner and takes no further part; most texts of a corpus end here, after a fragment of their shingles
has travelled.  Frequencies are then those in the sets that are left, which no link leaves out.

Equal sets are one node from the start.  Each member of a shingle's group is paired with the one
that holds the shingle earliest, so near copies never give all their pairs; where a group then holds
several components, the members outside of its largest component are paired with those of other
components whose sizes and places allow a link.  For each candidate pair the overlap is counted
fragment by fragment of the order of hashes and summed per pair.

Defined cases: a null text or one without words has no shingles, is linked with nothing and is
a component by itself; a null doc_id is never a component's id unless it is alone; repeated
rows share a component; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevara.llm.common import checked, drop_rows, forget, released, ship, text_session, written
from relevara.llm.graph import components
from relevara.llm.textvec import buffers, distinct_sets, mix, pieces, shingle_hashes, sums, word_hashes

_SALT = np.uint64(0xA24BAED4963EE407)
#: Fragments of the order of hashes whose overlaps are counted apart when a pair is verified.
PARTS = 4
#: Partners that one copy of a set is compared with; a set with more partners is sent in several copies.
PARTNERS = 256
#: Roots that one row of a text is sent to; a text with more has several rows.
USES = 4096


def shingle_sets(batch: pa.RecordBatch, text: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    words, cut, _, _ = word_hashes(*buffers(batch.column(text)))
    return distinct_sets(*shingle_hashes(words, cut, size))


def set_ids(sets: np.ndarray, off: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit id of each whole set."""
    n = np.diff(off).astype(np.uint64)
    return mix(sums(mix(sets + np.uint64((2 * seed + 1) * int(_SALT) % 2**64)), off) ^ mix(n + np.uint64(seed)))


def profile_batches(batches: Iterator[pa.RecordBatch], size: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, n_shingles, node, check) of (doc_id, text_hash, text)."""
    for whole in batches:
        for batch in pieces(whole, 2):
            sets, off = shingle_sets(batch, 2, size)
            ids = [set_ids(sets, off, s).view(np.int64) for s in (seed, seed + 1000)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(off)), pa.array(ids[0]), pa.array(ids[1])], names=["doc_id", "text_hash", "n_shingles", "node", "check"])


def token_batches(batches: Iterator[pa.RecordBatch], size: int, seed: int, share: float = 1.0) -> Iterator[pa.RecordBatch]:
    """(token, node, n): the shingles of each set in the first ``share`` of the order of hashes, once per batch."""
    below = np.uint64(min(int(share * 2.0**64), 2**64 - 1))
    for whole in batches:
        for batch in pieces(whole, 0):
            sets, off = shingle_sets(batch, 0, size)
            ids, n = set_ids(sets, off, seed), np.diff(off)
            _, first = np.unique(ids, return_index=True)
            use = np.repeat(np.isin(np.arange(len(n)), first), n) & (sets <= below)
            doc = np.repeat(np.arange(len(n)), n)[use]
            yield pa.RecordBatch.from_arrays([pa.array(sets[use].view(np.int64)), pa.array(ids[doc].view(np.int64)), pa.array(n[doc])], names=["token", "node", "n"])


def part_batches(batches: Iterator[pa.RecordBatch], size: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(uses, node, part, n, hashes): each set cut into PARTS ranges of the global order."""
    for whole in batches:
        for batch in pieces(whole, 0):
            sets, off = shingle_sets(batch, 0, size)
            ids, n = set_ids(sets, off, seed).view(np.int64), np.diff(off)
            doc = np.repeat(np.arange(len(n)), n)
            place = doc * PARTS + ((sets >> np.uint64(32)) * np.uint64(PARTS) >> np.uint64(32)).astype(np.int64)
            ends = np.searchsorted(place, np.arange(len(n) * PARTS + 1)).astype(np.int32)
            uses = batch.column(1).take(pa.array(np.repeat(np.arange(len(n)), PARTS)))
            cols = [uses, pa.array(np.repeat(ids, PARTS)), pa.array(np.tile(np.arange(PARTS, dtype=np.int32), len(n))), pa.array(np.repeat(n, PARTS)), pa.ListArray.from_arrays(pa.array(ends), pa.array(sets.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(cols, names=["uses", "node", "part", "n", "hashes"])


def overlap_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (root, slot, part), the root's own first: what each node shares with the root there."""
    head, n_head, last = np.zeros(0, np.uint64), 0, None
    for batch in batches:
        root, slot, node, part, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        lists = batch.column(5)
        off, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        found = []
        for i in range(batch.num_rows):
            at, own = (root[i], slot[i], part[i], node[i]), values[off[i] : off[i + 1]]
            if at == last:
                continue  # a repeated row
            last = at
            if node[i] == root[i]:
                head, n_head = own.copy(), n[i]
            elif len(own) and len(head):
                k = int((head[np.minimum(np.searchsorted(head, own), len(head) - 1)] == own).sum())
                if k:
                    found.append((root[i], node[i], n_head, n[i], k))
        if found:
            cols = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "n_a", "n_b", "k"])


def uses_of(spark: SparkSession, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, uses): for each set in ``pairs`` its document, and the roots it is sent to.

    A root with many partners is a root in several slots, which share the partners; a set with
    many roots has several rows.
    """
    fan = written(spark, pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("slots")))
    others = pairs.join(checked(fan), "a").select(F.col("b").alias("node"), F.col("a").alias("root"), F.pmod(F.xxhash64("b"), F.col("slots")).cast("int").alias("slot"))
    heads = fan.select(F.col("a").alias("node"), F.col("a").alias("root"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    each = written(spark, others.unionByName(heads))
    runs = written(spark, each.groupBy("node").agg(F.ceil(F.count("*") / USES).cast("int").alias("runs")))
    dealt = each.join(checked(runs), "node").withColumn("run", F.pmod(F.xxhash64("root", "slot"), F.col("runs")))
    uses = dealt.groupBy("node", "run").agg(F.collect_list(F.struct("root", "slot")).alias("uses"))
    of = written(spark, classes.select("node", "of").join(checked(runs), "node", "left_semi"))
    out = written(spark, uses.join(checked(of), "node").select("of.*", "uses"))
    forget(spark, fan, each, runs, of)
    return out


def texts_of(docs: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """(text, *columns) of the documents that ``ids`` names by doc_id and text_hash."""
    named = docs.select(F.col("doc_id").cast("long").alias("of_id"), "text")
    ids = checked(ids)
    return named.join(ids, named["of_id"].eqNullSafe(ids["doc_id"]) & (F.xxhash64(F.coalesce(named["text"], F.lit(""))) == ids["text_hash"])).select("text", *columns)


def verified(spark: SparkSession, docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, seed: int, num: int, den: int) -> DataFrame:
    """(a, b) of ``pairs`` that link: partial overlaps of each fragment of the order, summed per pair.

    The sets are made again from the texts and travel once, to the roots of their pairs.
    """
    uses = uses_of(spark, classes, pairs)
    parts = texts_of(docs, uses, "uses").mapInArrow(lambda it: released(part_batches(it, size, seed)), "uses array<struct<root: bigint, slot: int>>, node long, part int, n long, hashes array<long>")
    sent = parts.select(F.inline("uses"), "node", "part", "n", "hashes").repartition("root", "slot", "part")
    ordered = sent.sortWithinPartitions("root", "slot", "part", F.col("node") != F.col("root"), "node")
    partial = ordered.mapInArrow(lambda it: released(overlap_batches(it)), "a long, b long, n_a long, n_b long, k long")
    shared = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("k").alias("k"))
    out = written(spark, shared.filter(den * F.col("k") >= num * (F.col("n_a") + F.col("n_b") - F.col("k"))).select("a", "b"))
    forget(spark, uses)
    return out


def prefix_size(num: int, den: int) -> Column:
    """n - ceil(num / den * n) + 1: the places of a set of n shingles where a link shows."""
    return F.col("n") - F.expr(f"(n * {num} + {den - 1}) div {den}") + 1


def may_link(num: int, den: int) -> Column:
    """Whether sets of na and nb shingles whose first common one stands at pa and pb may link."""
    sizes = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return sizes & ((den + num) * left >= num * (F.col("na") + F.col("nb")))


def set_classes(spark: SparkSession, docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows of all documents, the classes of equal sets, and the seed of their ids."""
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    for seed in range(8):
        rows = written(spark, flat.mapInArrow(lambda it, s=seed: released(profile_batches(it, size, s)), "doc_id long, text_hash long, n_shingles long, node long, check long"))
        of = F.max_by(F.struct("doc_id", "text_hash"), F.coalesce("doc_id", F.lit(-1)))
        found = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.max("n_shingles").alias("n"), of.alias("of"))
        classes = written(spark, found)
        if not classes.filter("c0 <> c1").limit(1).count():
            return rows, classes, seed
        forget(spark, rows, classes)  # two sets with one id: take other ids
    raise RuntimeError("set ids collide under every seed")


def prefixes(spark: SparkSession, docs: DataFrame, classes: DataFrame, size: int, seed: int, num: int, den: int) -> DataFrame:
    """(token, node, n, pos): the shared shingles in the prefix of each set, and their places in it."""
    share = 2 * (den - num) / den  # of texts without a partner, twice as many lone shingles as the prefix has places
    tokens = docs.select("text").mapInArrow(lambda it: released(token_batches(it, size, seed, share)), "token long, node long, n long")
    held = tokens.groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    lone = written(spark, held.filter("node = last").groupBy("node").agg(F.count("*").alias("lone")).join(classes.select("node", "n"), "node").filter(F.col("lone") >= prefix_size(num, den)).select("node"))
    live = written(spark, classes.join(checked(lone), "node", "left_anti").select("of.*"))
    tokens = texts_of(docs, live).mapInArrow(lambda it: released(token_batches(it, size, seed)), "token long, node long, n long")
    tokens = written(spark, tokens)
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    behind = Window.partitionBy("node", "n").orderBy(F.desc("df"), F.desc("token"))
    placed = tokens.join(often, "token").withColumn("pos", F.col("n") - F.dense_rank().over(behind))
    out = written(spark, placed.filter(F.col("pos") < prefix_size(num, den)).select("token", "node", "n", F.col("pos")).distinct())
    forget(spark, lone, live, tokens)
    return out


def star_pairs(prefix: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): each member of a token's group with the one that holds the token earliest."""
    first = prefix.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("c"), F.count("*").alias("members")).filter("members > 1")
    first = first.select("token", F.col("c.node").alias("a"), F.col("c.n").alias("na"), F.col("c.pos").alias("pa"))
    both = prefix.toDF("token", "b", "nb", "pb").join(first, "token")
    return both.filter((F.col("a") != F.col("b")) & may_link(num, den)).select("a", "b").distinct()


def cross_pairs(spark: SparkSession, prefix: DataFrame, label: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): members of a token's group outside of its largest component with those of other components."""
    own = prefix.join(checked(label), "node", "left").select("token", "node", "n", "pos", F.coalesce("label", "node").alias("label"))
    own = written(spark, own)
    sizes = own.groupBy("token", "label").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("token").agg(F.max(F.struct("k", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    mixed = written(spark, mixed.select("token", F.col("top.label").alias("main")))
    some = own.join(checked(mixed), "token")
    x = some.filter("label <> main").select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("label").alias("la"))
    y = some.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("label").alias("lb"))
    found = x.join(y, "token").filter((F.col("la") != F.col("lb")) & may_link(num, den))
    out = written(spark, found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    forget(spark, own, mixed)
    return out


def jaccard_components(spark: SparkSession, docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, text_hash, class_size, linked.

    Texts link when den * |intersection| >= num * |union| of their sets of ``size``-word
    shingles; component_id is the smallest doc_id that links reach.
    """
    text_session(spark)
    rows, classes, seed = set_classes(spark, docs, size)
    prefix = prefixes(spark, docs, classes, size, seed, num, den)

    def links(some: DataFrame) -> DataFrame:
        return verified(spark, docs, classes, some, size, seed, num, den)

    stars = written(spark, star_pairs(prefix, num, den))
    linked = links(stars)
    label = components(spark, linked)
    cross = cross_pairs(spark, prefix, label, num, den)
    seen = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(spark, cross.join(checked(seen), ["a", "b"], "left_anti"))
    if rest.limit(1).count():
        extra = links(rest)
        if extra.limit(1).count():
            label = components(spark, linked.unionByName(extra))
    forget(spark, prefix, stars, cross, rest)
    labelled = written(spark, classes.join(checked(label), "node").select("node", "label", "rep"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    ids = written(spark, labelled.join(checked(least), "label").select("node", "component_id"))
    named = written(spark, classes.join(checked(ids), "node", "left").select("node", "class_size", F.coalesce("component_id", "rep").alias("component_id"), F.col("component_id").isNotNull().alias("linked")))
    own = F.col("n_shingles") == 0
    out = rows.select("doc_id", "text_hash", "n_shingles", "node").join(checked(named.filter("linked OR class_size > 1")), "node", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(own, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
        "text_hash",
        F.when(own, F.lit(1)).otherwise(F.coalesce("class_size", F.lit(1))).cast("long").alias("class_size"),
        F.when(own, F.lit(False)).otherwise(F.coalesce("linked", F.lit(False))).alias("linked"),
    )


def one_of_each(spark: SparkSession, docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id, then the text's hash."""
    rows = written(spark, found.filter("linked OR class_size > 1").select("doc_id", "text_hash", "component_id"))
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("keep")).select(F.col("component_id").alias("c"), "keep")
    both = rows.join(checked(first), F.col("component_id").eqNullSafe(F.col("c")))
    stays = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_hash") == F.col("keep.text_hash"))
    fate = both.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.max(stays.cast("int")).alias("n_kept"))
    return drop_rows(spark, docs, fate.filter("n_kept < n"))


ship(__name__)
