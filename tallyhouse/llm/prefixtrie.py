"""The trie of shared beginnings of conversations.

Each conversation becomes a chain of SHA-256 digests, one for every prefix; the
prefixes of all conversations are rows, and those that agree in (depth, digest)
are one node. Subtree sums explode to all ancestors. A node belongs to its
smallest member, and the nodes of one member form an unbroken chain down to that
conversation's end: within a chain a running sum from the end is enough, and only
the chain's total is exploded to the ancestors above it. These are prefixes of
the member itself, so all explosions together have at most as many rows as there
are turns, however deep a conversation is.

Nothing is gathered by conversation or by node. Turns are numbered by a range
sort; digests and running sums go by blocks of ``BLOCK`` turns, each begun with
what the blocks before it come to; nodes are counted with partial aggregates; the
ids that end in a node are joined into pieces where they lie sorted, and the
pieces of a node are hashed one after the other, as a stream.

Defined cases: turns are ordered by turn (null first), then role, then text;
repeated rows are turns of their own; null role or text is empty; rows without a
conversation id belong to none and are left out; no conversations, no nodes; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stage

#: Turns of a conversation, or ids that end in a node, that are handled together.
BLOCK = 4096
#: A node with more than one in so many nodes right below it is met by a broadcast.
HEAVY = 1000
#: Words are runs of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, turn_digest, n_words), position from 1 in each
    conversation. Texts are moved once, by ranges of (conv_id, turn), so one long
    conversation is dealt over many tasks; what follows has digests only."""
    empty = F.lit("")
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    small = dealt.select(
        F.col("conv_id").cast("long"), F.spark_partition_id().alias("part"),
        F.unhex(F.sha2(said, 256)).alias("turn_digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            at = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)])) + 1
            if ids[0] == now:
                at[: starts[1] if len(starts) > 1 else len(ids)] += done
            now, done = ids[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "position"])

    bound_batches(conversations.sparkSession)
    rows = stage(small.mapInArrow(place, "conv_id long, part int, turn_digest binary, n_words long, position long"), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("conv_id", "part").agg(F.max("position").alias("n")).withColumn("before", F.sum("n").over(before))
    # only the first conversation of a partition can have begun in an earlier one: one row for each partition at most
    late = F.broadcast(runs.where("before > 0").select("conv_id", "part", "before"))
    return rows.join(late, ["conv_id", "part"], "left").select(
        "conv_id", (F.col("position") + F.coalesce("before", F.lit(0))).alias("position"), "turn_digest", "n_words"
    )


def share_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to begin alike: the first h turns of conversation
    c - c % every (fewer if it has fewer), then c's own after its first h, with h =
    crc32(c) % most. Gives the turns and the ids, of which some may have no turn."""
    sizes = turns.groupBy("conv_id").agg(F.max("position").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = (
        sizes.select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % every).alias("base")).join(bases, "base", "left")
        .select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    )
    plan = stage(plan, "heads")
    own = turns.join(plan, "conv_id").where("position > h").withColumn("position", F.expr("position - h + taken"))
    first = turns.where(f"position < {most} and conv_id % {every} = 0").withColumnRenamed("conv_id", "base")
    heads = plan.where("taken > 0").join(first, "base").where("position <= taken")
    columns = ["conv_id", "position", "turn_digest", "n_words"]
    return own.select(*columns).union(heads.select(*columns)), plan.select("conv_id")


def _chained(size: int):
    """Rows of sorted blocks; ``known`` ones tell the digest at a block's edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, edge = None, b"", None
        for batch in batches:
            out = []
            names = ("conv_id", "block", "position", "known", "turn_digest", "n_words")
            for conv, block, position, known, digest, words in zip(*(batch.column(x).to_pylist() for x in names)):
                if key != (conv, block):
                    key, state, edge = (conv, block), b"", None
                if known:
                    if position == block * size:
                        state = digest
                    else:
                        edge = digest
                    continue
                own = edge if edge is not None else hashlib.sha256(state + digest).digest()
                out.append((conv, position, own, state, words))
                state = own
            if out:
                columns = zip(*out)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "depth", "digest", "parent", "n_words"])

    return run


def prefixes(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, depth, digest, parent, n_words) for every prefix with a turn."""
    block = F.expr(f"(position - 1) div {size}").alias("block")
    rows = turns.select("conv_id", block, "position", F.lit(False).alias("known"), "turn_digest", "n_words")
    long = turns.groupBy("conv_id").agg(F.max("position").alias("n")).where(f"n >= {size}")
    full = rows.join(long, "conv_id").where(f"(block + 1) * {size} <= n")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "turn_digest"))), lambda x: F.hex(x["turn_digest"])), "")
    so_far = Window.partitionBy("conv_id").orderBy("block")
    edges = (
        full.groupBy("conv_id", "block").agg(F.sha2(told, 256).alias("own"))
        .withColumn("edge", F.unhex(F.sha2(F.array_join(F.collect_list("own").over(so_far), ""), 256)))
        .select("conv_id", "block", F.expr(f"(block + 1) * {size}").alias("position"), F.lit(True).alias("known"), F.col("edge").alias("turn_digest"), F.lit(0).cast("long").alias("n_words"))
    )
    both = rows.union(edges).union(edges.withColumn("block", F.col("block") + 1))
    sorted_blocks = both.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "position", F.desc("known"))
    return sorted_blocks.mapInArrow(_chained(size), "conv_id long, depth long, digest binary, parent binary, n_words long")


def _pieces(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def piece() -> pa.RecordBatch:
            values = [[node[0]], [node[1]], [ids[0]], [",".join(map(str, ids))]]
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["depth", "digest", "first", "ids"])

        for batch in batches:
            for at in zip(*(batch.column(x).to_pylist() for x in ("depth", "digest", "conv_id"))):
                if ids and (at[:2] != node or len(ids) >= size):
                    yield piece()
                    ids = []
                node = at[:2]
                ids.append(at[2])
        if ids:
            yield piece()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state, out = None, None, []

    def rows() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["depth", "digest", "ends_sha256"])

    for batch in batches:
        for depth, digest, ids in zip(*(batch.column(x).to_pylist() for x in ("depth", "digest", "ids"))):
            if node != (depth, digest):
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, digest), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) >= 4096:
            yield rows()
            out = []
    if node is not None:
        out.append((*node, state.hexdigest()))
        yield rows()


def end_digests(ends: DataFrame, size: int = BLOCK) -> DataFrame:
    """(depth, digest, ends_sha256) from (depth, digest, conv_id): the hash of
    each node's ids, ascending and comma-joined. A node with very many is dealt by
    ranges of ids; one task then reads its pieces as a stream."""
    dealt = ends.repartitionByRange("depth", "digest", "conv_id").sortWithinPartitions("depth", "digest", "conv_id")
    pieces = dealt.mapInArrow(_pieces(size), "depth long, digest binary, first long, ids string")
    whole = pieces.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "first")
    return whole.mapInArrow(_hashed, "depth long, digest binary, ends_sha256 string")


def _facts(df: DataFrame, **columns: str) -> DataFrame:
    """Rows about nodes in one shape, so that one aggregate brings them together."""
    kinds = {
        "conv_id": "long", "n_convs": "long", "n_words": "long", "n_children": "long", "leaves": "long", "saved": "long",
        "parent_conv_id": "long", "ends_sha256": "string",
    }
    return df.select("depth", "digest", *[F.expr(f"cast({columns.get(k, 'null')} as {t}) {k}") for k, t in kinds.items()])


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """One row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, digest), from ``numbered_turns``.

    ``conversations`` names those without a turn as well; without it, the turns'
    own ids are all. The sums of a node's subtree count the node itself.
    """
    ids = (turns if conversations is None else conversations).select("conv_id").distinct()
    roots = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.unhex(F.lit("")).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n_words"))
    rows = stage(prefixes(turns, size).union(roots), "prefixes")

    alike = rows.groupBy("depth", "digest").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_words").alias("n_words"), F.max("parent").alias("parent")
    )
    alike = stage(alike, "alike")
    links = alike.where("depth > 0").select(F.expr("depth - 1 depth"), F.col("parent").alias("digest"), F.lit(1).alias("child"))
    known = ("conv_id", "n_convs", "n_words", "parent")
    nodes = alike.withColumn("child", F.lit(0)).unionByName(links, True).groupBy("depth", "digest").agg(
        *[F.max(c).alias(c) for c in known], F.sum("child").alias("n_children")
    )
    leaf = F.expr("cast(n_children = 0 as long)").alias("leaves")
    nodes = stage(nodes.select("depth", "digest", *known, "n_children", leaf, F.expr("(n_convs - 1) * n_words saved")), "nodes")

    chains = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"),
        F.min_by("digest", "depth").alias("digest"), F.min_by("parent", "depth").alias("parent"),
    )
    chains = stage(chains, "chains")
    above = rows.select("conv_id", "depth", "digest").join(chains.select("conv_id", "top", "saved", "leaves"), "conv_id").where("depth < top")
    above = above.groupBy("depth", "digest").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))

    block = F.expr(f"depth div {size}").alias("block")
    own = nodes.select("conv_id", block, "depth", "digest", "saved", "leaves")
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    after = own.groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).select(
        "conv_id", "block", F.lit((1 << 62)).alias("depth"), F.lit(None).cast("binary").alias("digest"),
        F.sum("saved").over(later).alias("saved"), F.sum("leaves").over(later).alias("leaves"),
    ).where("saved is not null")
    down = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = own.union(after).select("depth", "digest", F.sum("saved").over(down).alias("saved"), F.sum("leaves").over(down).alias("leaves")).where("digest is not null")

    tops = chains.where("top > 1").select(F.col("top").alias("depth"), "digest", F.expr("top - 1 up"), "parent")
    over = nodes.where("n_children > 0").select(F.col("depth").alias("up"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    # nodes with over a thousandth of all nodes below them are fewer than a thousand: those are broadcast
    often = F.col("n_children") * HEAVY > nodes.count()
    heavy = F.broadcast(over.where(often).drop("n_children"))
    up = tops.join(heavy, ["up", "parent"]).unionByName(tops.join(heavy, ["up", "parent"], "left_anti").join(over.where(~often).drop("n_children"), ["up", "parent"]))
    ends = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "digest")).alias("end")).select("end.depth", "end.digest", "conv_id")

    facts = (
        _facts(nodes, conv_id="conv_id", n_convs="n_convs", n_children="n_children")
        .union(_facts(above, leaves="leaves", saved="saved")).union(_facts(below, leaves="leaves", saved="saved"))
        .union(_facts(up, parent_conv_id="parent_conv_id"))
        .union(_facts(end_digests(ends, size), ends_sha256="ends_sha256"))
    )
    found = facts.groupBy("depth", "digest").agg(
        *[F.max(c).alias(c) for c in ("conv_id", "n_convs", "n_children", "parent_conv_id", "ends_sha256")],
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    root = nodes.where("depth = 0").select("conv_id").first()
    parent = F.when(F.col("depth") == 1, F.lit(root and root[0]).cast("long")).when(F.col("depth") > 1, F.coalesce("parent_conv_id", "conv_id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"), "digest",
    )
