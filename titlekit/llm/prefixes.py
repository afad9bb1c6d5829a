"""The prefix trie of conversations, summed up by bands of depths.

A node is a different sequence of the first d turns; the root has none. Every turn gets two 64-bit hashes of its role,
text and place, and the hashes of a prefix are the exclusive-ors of those of its turns, so prefixes come from running sums
over ranges of (conversation, place): a conversation of any length is dealt to as many tasks as it needs. A node is known
by its depth and 128 bits, and has its smallest member as representative.

Sums over subtrees go by bands of ``height`` depths. Each node is exploded to its ancestors in its own band only (the
prefixes of its representative, at most ``height``), and the sums are grouped by ancestor. The top nodes of a band are then
complete from the deepest band upwards: each passes its total to the top node above it, one round a band. At last every
complete top node is exploded once to the nodes of the band above it. With a height of at least the square root of the
largest depth neither the rounds nor the rows of one node are more than about that root.

Turns are ordered by turn (null first), then role, then two hashes of role and text; equal turns are interchangeable. A
null role or text is empty. Rows with a null conversation id belong to no conversation and are left out. An empty table
gives an empty result (no root). Extra columns are ignored. Texts need not be valid UTF-8: their bytes are compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlekit.llm.common import col
from titlekit.operators.lookup import lookup_join
from titlekit.operators.vocabulary import numbered
from titlekit.session import materialise

FAMILY = 5
MOST_SHARED = 9
LEAST_HEIGHT = 16
IDS_AT_ONCE = 4096

KEY = ["depth", "x", "y"]
UP = ["up_depth", "up_x", "up_y"]


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(c, place, x, y, bytes, last) of every turn and (c, n) of every conversation.

    A turn has its place in the conversation from 1, hashes of role and text, the bytes of the text, and whether it is the last.
    """
    role = F.coalesce(col(role_col).cast("string"), F.lit("")).cast("binary")
    text = F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = conversations.select(
        col(conv_col).cast("bigint").alias("c"), col(turn_col).alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit("second"), role, text).alias("y"),
        F.octet_length(text).cast("bigint").alias("bytes"), F.monotonically_increasing_id().alias("tie"),
    ).where("c is not null")
    rows = materialise(rows)  # the texts are read once; the place in the input tells equal turns apart
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("x"), F.col("y"), F.col("tie")]
    listed = materialise(numbered(rows, order, "number").select("c", "number", "x", "y", "bytes"))
    convs = materialise(listed.groupBy("c").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")))
    place = F.col("number") - F.col("first") + 1
    placed = lookup_join(listed, convs, ["c"]).select("c", place.alias("place"), "x", "y", "bytes", (place == F.col("n")).alias("last"))
    return placed, convs.select("c", "n")


def branched(listed: DataFrame, convs: DataFrame, family: int = FAMILY, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one, as ``turns`` gives them; turnless ones are in (c, n) too.

    Conversation c has the first h turns of conversation c - c % family (all, if that has fewer; none, if there is none),
    then its own after its first h, where h is the crc32 of c's digits modulo ``most``.
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    own = convs.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % family).alias("base"))
    bases = convs.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    own = own.join(bases.hint("merge"), "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0).cast("bigint"))))
    own = materialise(own.select("c", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))
    kept = lookup_join(listed, own.select("c", "h", "lent", "n"), ["c"]).where("place > h")
    kept = kept.select("c", (F.col("lent") + F.col("place") - F.col("h")).alias("place"), "x", "y", "bytes", "n")
    # a base has at most 2 * family - 1 conversations, and lends the first turns only
    wanted = own.where("lent > 0").select("c", "base", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), "lent")).alias("place"))
    lent = wanted.join(listed.where(F.col("place") < most).drop("last").withColumnRenamed("c", "base").hint("merge"), ["base", "place"])
    both = kept.unionByName(lent.select("c", "place", "x", "y", "bytes", "n"))
    return both.withColumn("last", F.col("place") == F.col("n")).drop("n"), own.select("c", "n")


def prefixes(listed: DataFrame) -> DataFrame:
    """(c, depth, x, y, up_x, up_y, bytes, last): the hashes of every prefix and of the prefix without its last turn.

    Rows are dealt by ranges of (c, place) and written down; a range goes on from the ranges before it by one row.
    """
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = listed.select("c", F.col("place").alias("depth"), F.xxhash64("x", "y", "place").alias("x"), F.xxhash64(F.lit("second"), "y", "x", "place").alias("y"), "bytes", "last")
    ranged = materialise(step.repartitionByRange(parts, "c", "depth").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("c", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("c", "part", F.bit_xor("x").over(before).alias("far_x"), F.bit_xor("y").over(before).alias("far_y")).where("far_x is not null")
    # of the conversations of a range only its first can have begun before it: one row a range at most
    joined = ranged.join(F.broadcast(materialise(carried)), ["c", "part"], "left")
    upto = Window.partitionBy("part", "c").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("bigint")

    def running(own: str, far: str) -> Column:
        return F.bit_xor(own).over(upto).bitwiseXOR(F.coalesce(F.col(far), zero))

    made = joined.select("c", "depth", running("x", "far_x").alias("px"), running("y", "far_y").alias("py"), "x", "y", "bytes", "last")
    return made.select("c", "depth", F.col("px").alias("x"), F.col("py").alias("y"), F.col("px").bitwiseXOR(F.col("x")).alias("up_x"), F.col("py").bitwiseXOR(F.col("y")).alias("up_y"), "bytes", "last")


def ends_digest(ended: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) from (depth, x, y, c): the SHA-256 of each node's ids, ascending, joined by commas.

    Ids are dealt by ranges of (node, id) and joined to pieces of IDS_AT_ONCE, so many equal conversations are spread;
    the pieces of a node run through one digest in order, one piece in memory at a time.
    """
    parts = int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ended.repartitionByRange(parts, *KEY, "c").withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("part", *KEY).orderBy("c"))
    cut = ranged.withColumn("piece", F.floor((place - 1) / IDS_AT_ONCE))
    pieces = cut.groupBy("part", *KEY, "piece").agg(F.sort_array(F.collect_list("c")).alias("ids"))
    pieces = pieces.select(*KEY, F.get("ids", F.lit(0)).alias("first"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            made = []
            for d, x, y, _, ids in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (d, x, y) == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        made.append((*node, digest.hexdigest()))
                    node, digest = (d, x, y), hashlib.sha256()
                digest.update(ids.encode())
            yield listed(made)
        if node is not None:
            yield listed([(*node, digest.hexdigest())])

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[*KEY, "ends_sha256"])

    dealt = pieces.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first")
    return dealt.mapInArrow(digests, "depth bigint, x bigint, y bigint, ends_sha256 string")


def nodes_of(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, x, y, up_x, up_y, c, n_convs, n_ends, bytes) of every node, the root included."""
    zero = F.lit(0).cast("bigint")
    below = paths.groupBy(*KEY).agg(
        F.min("up_x").alias("up_x"), F.min("up_y").alias("up_y"), F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"),
        F.count_if("last").alias("n_ends"), F.max("bytes").alias("bytes"))
    none = F.lit(None).cast("bigint")
    root = convs.groupBy().agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("n") == 0).alias("n_ends")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), none.alias("up_x"), none.alias("up_y"), "c", "n_convs", "n_ends", zero.alias("bytes"))
    return below.unionByName(root)


def rolled_up(nodes: DataFrame, paths: DataFrame, convs: DataFrame, height: int) -> DataFrame:
    """(depth, x, y, n_leaves, saved): sums over the subtree of every node, by bands of ``height`` depths."""
    zero = F.lit(0).cast("bigint")
    band = F.expr(f"depth div {height}")
    along = paths.select("c", *KEY).unionByName(convs.select("c", zero.alias("depth"), zero.alias("x"), zero.alias("y")))
    # at most ``height`` prefixes of one conversation
    chains = along.groupBy("c", band.alias("band")).agg(F.sort_array(F.collect_list(F.struct(*KEY))).alias("chain"))
    chains = materialise(chains)
    own = nodes.select("c", *KEY, band.alias("band"), F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    above = own.where("n_leaves > 0 or saved > 0").join(chains.hint("merge"), ["c", "band"])
    up = F.slice("chain", F.lit(1), (F.col("depth") - F.col("band") * height + 1).cast("int"))
    spread = above.select("n_leaves", "saved", F.explode(up).alias("up")).select("up.*", "n_leaves", "saved")
    # nodes with nothing of their own are there too
    within = materialise(_summed(spread.unionByName(own.select(*KEY, zero.alias("n_leaves"), zero.alias("saved")))))

    # the top nodes of the bands below the first, each with its chain in the band above
    tops = own.where(f"depth > 0 and depth % {height} = 0").select("c", *KEY, (F.col("band") - 1).alias("band"))
    tops = tops.join(within.hint("merge"), KEY).join(chains.hint("merge"), ["c", "band"])
    tops = materialise(tops.select(*KEY, "band", "chain", "n_leaves", "saved"))
    deepest = tops.agg(F.max("band")).first()[0]
    if deepest is None:
        return within
    complete = below = tops.where(F.col("band") == deepest)
    for above_it in range(deepest - 1, -1, -1):
        passed = _summed(below.select(F.get("chain", F.lit(0)).alias("up"), "n_leaves", "saved").select("up.*", "n_leaves", "saved"))
        here = tops.where(F.col("band") == above_it).join(passed.withColumnsRenamed({"n_leaves": "more", "saved": "more_saved"}).hint("merge"), KEY, "left")
        below = materialise(here.select(*KEY, "band", "chain", (F.col("n_leaves") + F.coalesce("more", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved")))
        complete = complete.unionByName(below)
    passed = complete.select("n_leaves", "saved", F.explode("chain").alias("up")).select("up.*", "n_leaves", "saved")
    return _summed(within.unionByName(passed))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def trie(listed: DataFrame, convs: DataFrame, height: int | None = None) -> DataFrame:
    """One row for every node of the conversations (c, place, x, y, bytes, last) with lengths (c, n).

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens
    (over the subtree, a node's members less one times the bytes of its last text), ends_sha256.
    """
    convs = materialise(convs)
    paths = materialise(prefixes(listed))
    nodes = materialise(nodes_of(paths, convs))
    if height is None:
        deepest = convs.agg(F.max("n")).first()[0] or 0
        height = max(LEAST_HEIGHT, math.isqrt(deepest) + 1)
    sums = rolled_up(nodes, paths, convs, height)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    zero = F.lit(0).cast("bigint")
    ended = paths.where("last").select(*KEY, "c")
    ended = ended.unionByName(convs.where("n = 0").select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "c"))
    digests = ends_digest(ended)

    full = nodes.join(sums.hint("merge"), KEY).join(children.hint("merge"), KEY, "left").join(digests.hint("merge"), KEY, "left")
    full = full.withColumns({"up_depth": F.col("depth") - 1, "n_children": F.coalesce("n_children", zero), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))})
    parents = nodes.where("n_ends < n_convs").select(F.col("depth").alias("up_depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("c").alias("parent_conv_id"))
    out = lookup_join(full, parents, UP, "left")
    return out.select(F.col("c").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def conversation_trie(conversations: DataFrame, branch: bool = False, height: int | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of a table of turns; with ``branch`` conversations first take turns from another one (``branched``)."""
    listed, convs = turns(conversations, conv_col, turn_col, role_col, text_col)
    if branch:
        listed, convs = branched(listed, convs)
    return trie(listed, convs, height)
