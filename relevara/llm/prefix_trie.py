"""Prefix trie of conversations, built level by level.

Conversations of equal turns are one class, told by its length and an order-bound fingerprint of
240 bits; a class has its smallest conv_id, its number of members and the hash of their ids.  The trie
is built from the root down: at each depth the live classes are grouped by (parent node, next
turn), and a group is a node named by its smallest conv_id.  A node that only one class reaches
begins a chain: its class leaves the levels, and all further nodes of the chain are written at once
from the class's turns.  So there are as many levels as different conversations share turns.  Then leaves
and savings are rolled up by joins of each level with the one above it.

Places of turns come from a sort by ranges of (conv_id, turn) with offsets per range, so that no
conversation, however long, is one task's; ids of a class are put into one hash in order from chunks made by range.

Defined cases: a null conv_id is no conversation; a null turn comes first; turns of one number are ordered by a
hash of role and text, repeated rows are turns of their own; null role or text is empty; a
conversation may have no turns left after rebuilding and then only reaches the root; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevara.llm.common import checked, forget, ship, written

#: Rows of turns, and of conversations, in a range of the sorts.
RANGE, MOST_RANGES = 1 << 16, 1 << 15
#: Longest prefix that a conversation may take from its base.
PREFIX = 3
EMPTY = hashlib.sha256(b"").hexdigest()
LANES = 4


def ranges(rows: int) -> int:
    return min(MOST_RANGES, max(1, -(-rows // RANGE)))


def turn_key(role: Column, text: Column) -> Column:
    """A 256-bit name of a turn: the hash of its role, told apart by its length, and its text."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def word_count(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long")


def numbered(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """(conv, pos, key, words, upto): turns with their place, from 1, and the words up to and with it."""
    slim = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", turn_key(F.col("role"), F.col("text")).alias("key"), word_count(F.col("text")).alias("words"))
    slim = written(spark, slim)
    ranged = slim.repartitionByRange(ranges(slim.count()), "conv", F.col("turn").asc_nulls_first(), "key").withColumn("at", F.spark_partition_id())
    ranged = written(spark, ranged)
    own = Window.partitionBy("conv", "at").orderBy(F.col("turn").asc_nulls_first(), "key").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("nth", F.row_number().over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("run", F.sum("words").over(own))
    # offsets of the ranges that a conversation reaches beyond its first one
    parts = ranged.groupBy("conv", "at").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    before = Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    later = parts.withColumns({"n0": F.sum("n").over(before), "w0": F.sum("w").over(before)}).filter("n0 IS NOT NULL").select("conv", "at", "n0", "w0")
    later = checked(written(spark, later))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    placed = local.join(later, ["conv", "at"], "left")
    return written(spark, placed.select("conv", (F.col("nth") + zero("n0")).cast("long").alias("pos"), "key", "words", (F.col("run") + zero("w0")).alias("upto")))


def rebuilt(spark: SparkSession, turns: DataFrame, base: Column, taken: Column) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first ``taken`` turns replaced by those of its ``base``: (conversations, turns).

    ``base`` and ``taken`` (at most PREFIX) are expressions over ``conv``.  Turns are (conv, pos, key, words, upto),
    conversations (conv, length, total): total - upto + words is the words from a turn to the last one.
    """
    convs = turns.groupBy("conv").agg(F.count("*").alias("own"), F.sum("words").alias("total"), F.max(F.when(F.col("pos") <= taken, F.col("upto"))).alias("head"))
    convs = convs.select("conv", base.cast("long").alias("base"), taken.cast("long").alias("h"), "own", "total", (F.col("total") - F.coalesce("head", F.lit(0))).alias("rest_own"))
    # the first turns of the bases, a row for each base
    first = turns.filter((F.col("pos") <= PREFIX) & (F.col("conv") == base)).groupBy(F.col("conv").alias("b")).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "words"))).alias("first"))
    known = convs.join(first, convs["base"] == first["b"], "left").drop("b")
    prefix = F.slice(F.coalesce("first", F.array().cast(first.schema["first"].dataType)), F.lit(1), F.col("h").cast("int"))
    known = known.withColumn("prefix", prefix).withColumn("k", F.size("prefix").cast("long"))
    known = written(spark, known.select("conv", "h", "k", "own", "total", "rest_own", "prefix"))
    head = known.select("conv", "total", "rest_own", "prefix", F.explode("prefix").alias("t"))
    after = F.aggregate(F.filter("prefix", lambda x: x["pos"] > F.col("t.pos")), F.lit(0).cast("long"), lambda s, x: s + x["words"])
    head = head.select("conv", "t.pos", "t.key", "t.words", (F.col("total") - F.col("rest_own") - after).alias("upto"))
    # own turns move only where the base is shorter than what is taken from it
    moved = checked(known.filter("k <> h").select(F.col("conv").alias("c"), (F.col("h") - F.col("k")).alias("less")))
    tail = turns.filter(F.col("pos") > taken).join(moved, F.col("conv") == F.col("c"), "left")
    tail = tail.select("conv", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "key", "words", "upto")
    every = written(spark, head.unionByName(tail))
    length = known.select("conv", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"), "total")
    return length, every


def id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(print, conv), sorted, as one row for each run of a fingerprint in a batch: (print, first, n, ids)."""
    for b in batches:
        prints, convs = b.column(0).to_pylist(), b.column(1).to_pylist()
        starts = [i for i in range(len(prints)) if not i or prints[i] != prints[i - 1]]
        ends = [*starts[1:], len(prints)]
        data = [",".join(map(str, convs[i:j])).encode() for i, j in zip(starts, ends, strict=True)]
        out = [pa.array([prints[i] for i in starts], pa.binary()), pa.array([convs[i] for i in starts], pa.int64()), pa.array([j - i for i, j in zip(starts, ends, strict=True)], pa.int64()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(out, names=["print", "first", "n", "ids"])


def hashed_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (print, first) as one row for each fingerprint: (rep, n, sha); a hash state is all that is kept."""
    now, rep, n, state = None, 0, 0, None
    for b in batches:
        out: list[tuple] = []
        for p, first, m, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if p != now:
                if state is not None:
                    out.append((rep, n, state.hexdigest()))
                now, rep, n, state = p, first, 0, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids)
            n += m
        yield class_rows(out)
    if state is not None:
        yield class_rows([(rep, n, state.hexdigest())])


def class_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["rep", "n", "sha"])


def classes(spark: SparkSession, length: DataFrame, turns: DataFrame) -> DataFrame:
    """(rep, n, length, total, sha): conversations of equal turns as one, with the hash of their ids in order."""
    placed = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.hex("key")), 256)
    lanes = [F.bit_xor(F.conv(F.substring(placed, 15 * i + 1, 15), 16, 10).cast("long")).alias(f"x{i}") for i in range(LANES)]
    prints = turns.groupBy("conv").agg(*lanes)
    each = length.join(prints, "conv", "left")
    name = F.unhex(F.sha2(F.concat_ws(",", "length", *[F.coalesce(f"x{i}", F.lit(0)) for i in range(LANES)]), 256))
    each = written(spark, each.select(name.alias("print"), "conv", "length", "total"))
    ranged = each.select("print", "conv").repartitionByRange(ranges(each.count()), "print", "conv").sortWithinPartitions("print", "conv")
    chunks = ranged.mapInArrow(id_chunks, "print binary, first long, n long, ids binary")
    whole = chunks.repartition("print").sortWithinPartitions("print", "first").mapInArrow(hashed_chunks, "rep long, n long, sha string")
    sizes = each.select(F.col("conv").alias("rep"), "length", "total")
    return written(spark, whole.join(sizes, "rep"))


def rest() -> Column:
    """Words from a turn to the last one of its conversation."""
    return F.col("total") - F.col("upto") + F.col("words")


def levels(spark: SparkSession, every: DataFrame, turns: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each depth from the root on, and the classes that begin a chain: (rep, n, depth).

    A level is (depth, conv, parent, n_convs, words, end_rep, single, saved_chain); ``saved_chain`` is that of a whole chain.
    """
    root = every.agg(F.min("rep").alias("conv"), F.sum("n").alias("n_convs"), F.max(F.when(F.col("length") == 0, F.col("rep"))).alias("end_rep"))
    root = root.select(F.lit(0).cast("long").alias("depth"), "conv", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words"), "end_rep", F.lit(False).alias("single"), F.lit(0).cast("long").alias("saved_chain"))
    found, chains = [written(spark, root)], None
    top = found[0].first()["conv"]
    live = written(spark, every.filter("length > 0").select("rep", "n", "length", "total", F.lit(top).alias("node")))
    depth = 0
    while live.limit(1).count():
        depth += 1
        here = turns.filter(F.col("pos") == depth).select(F.col("conv").alias("rep"), "key", "words", "upto")
        step = written(spark, live.join(here, "rep"))
        groups = step.groupBy("node", "key").agg(
            F.min("rep").alias("conv"),
            F.sum("n").alias("n_convs"),
            F.max("words").alias("words"),
            F.max(F.when(F.col("length") == depth, F.col("rep"))).alias("end_rep"),
            (F.count("*") == 1).alias("single"),
            F.max((F.col("n") - 1) * rest()).alias("saved_chain"),
        )
        groups = written(spark, groups)
        found.append(groups.select(F.lit(depth).cast("long").alias("depth"), "conv", F.col("node").alias("parent"), "n_convs", "words", "end_rep", "single", "saved_chain"))
        begun = groups.filter("single").select(F.col("conv").alias("rep"), F.col("n_convs").alias("n"), F.lit(depth).cast("long").alias("depth"))
        chains = begun if chains is None else chains.unionByName(begun)
        shared = groups.filter("NOT single").select("node", "key", F.col("conv").alias("child"))
        on = step.filter(F.col("length") > depth).join(checked(shared), ["node", "key"])
        forget(spark, live)
        live = written(spark, on.select("rep", "n", "length", "total", F.col("child").alias("node")))
        forget(spark, step)
    if chains is None:
        chains = spark.createDataFrame([], "rep long, n long, depth long")
    return found, chains


def rolled_up(spark: SparkSession, found: list[DataFrame]) -> DataFrame:
    """All nodes of the levels with n_children, n_leaves and saved_tokens, from the deepest level up."""
    done, below = [], None
    for level in reversed(found):
        own = (F.col("n_convs") - 1) * F.col("words")
        if below is None:
            rows = level.withColumns({"children": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
        else:
            per = below.groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            rows = level.join(checked(written(spark, per)), level["conv"] == F.col("p"), "left").drop("p").na.fill(0, ["children", "leaves", "saved"])
        # of a chain, its first node has one child unless it ends here, one leaf, and the savings of all of it
        goes_on = (F.col("single") & F.col("end_rep").isNull()).cast("long")
        rows = rows.select("depth", "conv", "parent", "n_convs", "end_rep", F.when(F.col("single"), goes_on).otherwise(F.col("children")).alias("n_children"), F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.when(F.col("single"), F.col("saved_chain")).otherwise(own + F.col("saved")).cast("long").alias("saved_tokens"))
        below = written(spark, rows)
        done.append(below)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def prefix_trie(spark: SparkSession, conversations: DataFrame, base: Column | None = None, taken: Column | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role, text.  With ``base`` and ``taken``, expressions over ``conv``, each conversation
    first takes that many turns, at most PREFIX, from its base in place of its own.
    """
    turns = numbered(spark, conversations)
    if turns.limit(1).count() == 0:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    base, taken = F.col("conv") if base is None else base, F.lit(0) if taken is None else taken
    length, all_turns = rebuilt(spark, turns, base, taken)
    every = classes(spark, length, all_turns)
    reps = every.select(F.col("rep").alias("conv"))
    # ranges of depth, so that a level reads few files
    mine = written(spark, all_turns.join(reps, "conv", "left_semi").repartitionByRange(F.col("pos"), F.col("conv")))
    forget(spark, turns, all_turns)
    found, chains = levels(spark, every, mine)
    top = rolled_up(spark, found)
    begun = checked(written(spark, chains).withColumnRenamed("rep", "c"))
    ends = every.select(F.col("rep").alias("c4"), "length", "total")
    tails = mine.join(begun, F.col("conv") == F.col("c")).filter(F.col("pos") > F.col("depth"))
    tails = tails.join(checked(ends), F.col("conv") == F.col("c4"))
    last = F.col("pos") == F.col("length")
    one = F.lit(1).cast("long")
    tails = tails.select(F.col("pos").alias("depth"), "conv", F.col("conv").alias("parent"), F.col("n").alias("n_convs"), F.when(last, F.col("conv")).alias("end_rep"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"), ((F.col("n") - 1) * rest()).alias("saved_tokens"))
    nodes = top.unionByName(tails)
    shas = every.select(F.col("rep").alias("end_rep"), "sha")
    out = ["conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ended = nodes.filter("end_rep IS NOT NULL").join(shas, "end_rep").select(*out, "sha")
    others = nodes.filter("end_rep IS NULL").select(*out, F.lit(EMPTY).alias("sha"))
    return ended.unionByName(others).select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("sha").alias("ends_sha256"))


ship(__name__)
