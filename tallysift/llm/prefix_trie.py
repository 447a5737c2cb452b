"""Prefix trie of turn sequences by fixed-length block hashing.

1. A sequence is cut into blocks of ``block`` turns. A turn has two 64-bit hashes of its content and depth; the digest of
   any stretch is the xor of its turns' hashes, so digests of prefixes are running xors over blocks, which can be cut
   anywhere: a sequence of any length is one row per block, gathered nowhere.
2. Sequences are grouped by the digest of all earlier blocks and of the own block: one row per distinct block and what
   precedes it, with its members counted before they are shuffled. Members that end inside a block form a shorter one.
3. Where all members of a prefix share one next block, that block's inner nodes have these very members. Only where
   siblings diverge are blocks refined into turns, and the turns' prefix digests grouped.
4. Sums over a node's subtree need no descent. A node is booked under its smallest member, so a member owns a stretch at
   the end of its path. A subtree's nodes are those its members own, less what its own smallest member owns above it:
   sums over subtrees are sums over members, by steps 2 and 3 again.

The ids of members that end at a node are joined in runs of 4,096 id values, then hashed as a sorted stream: SHA-256 of a
node's list is sequential by nature, but no list is held.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysift.llm.common import small_side, stored

BLOCK = 4
#: Blocks under one running xor, and id values in one joined string.
CHUNK, IDS = 1024, 4096


def content_digest(*parts: str) -> Column:
    """md5 of the parts' md5s, so that parts can't run into each other; null counts as empty."""
    one = [F.md5(F.coalesce(F.col(c), F.lit("")).cast("binary")) for c in parts]
    return F.md5(F.concat(*one).cast("binary"))


def _count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the last column by the row's number among the rows of its sequence in this partition."""
    last, k = None, 0
    for batch in batches:
        if not len(batch):
            continue
        c = batch.column(0).to_numpy()
        new = np.concatenate([[last is None or c[0] != last], c[1:] != c[:-1]])
        at = np.arange(len(c))
        begin = np.maximum.accumulate(np.where(new, at, -1))
        pos = np.where(begin >= 0, at - begin, at + k)
        last, k = c[-1], int(pos[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pos, pa.int64())], names=batch.schema.names)


def positions(turns: DataFrame) -> DataFrame:
    """(c, pos, digest, n_bytes) from (c, turn, digest, n_bytes): numbers from 0 in the order of turn (null first) and
    digest. Ranges of that order are numbered by themselves, so a sequence of any length is spread. Stored."""
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ranges = (turns.repartitionByRange(*order).sortWithinPartitions(*order)
              .select("c", "digest", "n_bytes", F.spark_partition_id().alias("part"), F.lit(0).cast("long").alias("k")))
    local = stored(ranges.mapInArrow(_count_on, ranges.schema), "ranges")
    sizes = local.groupBy("c", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # at most one sequence goes on from one range into the next
    going_on = stored(sizes.select("c", "part", before.alias("before")).where("before IS NOT NULL"), "going_on")
    return (local.join(small_side(going_on), ["c", "part"], "left")
            .select("c", (F.col("k") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "n_bytes"))


def blocks(turns: DataFrame, block: int) -> DataFrame:
    """Rows (c, j, p1, p2, pre, x1, x2, steps) from (c, d, digest, n_bytes), d from 1: digests and bytes of what precedes
    block j, the digest of the block, and its prefixes as ``steps`` (depth, digest, hash and bytes of the last turn, bytes
    before). Stored."""
    # the block is numbered from 0; a sequence's first turn has depth 1
    hashed = turns.select("c", F.expr(f"(d - 1) div {block}").alias("j"), "d", F.xxhash64("digest", "d").alias("u1"),
                          F.xxhash64("d", "digest").alias("u2"), "n_bytes")
    whole = hashed.groupBy("c", "j").agg(
        F.array_sort(F.collect_list(F.struct("d", "u1", "u2", "n_bytes"))).alias("turns"),
        F.bit_xor("u1").alias("x1"), F.bit_xor("u2").alias("x2"), F.sum("n_bytes").alias("b"))
    whole = stored(whole.withColumn("chunk", F.expr(f"j div {CHUNK}")), "blocks")
    inside = Window.partitionBy("c", "chunk").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    chunks = whole.groupBy("c", "chunk").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("b").alias("b"))
    over = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = stored(chunks.select("c", "chunk", F.bit_xor("x1").over(over).alias("h1"), F.bit_xor("x2").over(over).alias("h2"),
                                 F.sum("b").over(over).alias("hb")).where("chunk > 0"), "chunks")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    run = whole.withColumns({"r1": F.bit_xor("x1").over(inside), "r2": F.bit_xor("x2").over(inside), "rb": F.sum("b").over(inside)})
    steps = """transform(turns, (t, i) -> named_struct('d', t.d, 'n_bytes', t.n_bytes, 'u1', t.u1, 'u2', t.u2,
        'z1', aggregate(slice(turns, 1, i + 1), 0L, (a, s) -> a ^ s.u1),
        'z2', aggregate(slice(turns, 1, i + 1), 0L, (a, s) -> a ^ s.u2),
        'before', aggregate(slice(turns, 1, i), 0L, (a, s) -> a + s.n_bytes)))"""
    return stored(run.join(small_side(heads), ["c", "chunk"], "left").select(
        "c", "j", zero("r1").bitwiseXOR(zero("h1")).alias("p1"), zero("r2").bitwiseXOR(zero("h2")).alias("p2"),
        (zero("rb") + zero("hb")).alias("pre"), "x1", "x2", F.expr(steps).alias("steps")), "prefixes")


def nodes(blocked: DataFrame) -> DataFrame:
    """Node rows of depth 1 and more from block rows with the members' values q and leaf: d, k1, k2 (digest of the prefix),
    o1, o2 (of the parent), n_bytes (last turn), pre (bytes above), n, low (smallest member and its q), sum_q, leaves."""
    sums = [F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("sum_q").alias("sum_q"), F.sum("leaves").alias("leaves")]
    kinds = stored(blocked.groupBy("j", "p1", "p2", "x1", "x2").agg(
        F.count("*").alias("n"), F.min(F.struct("c", "q")).alias("low"), F.sum("q").alias("sum_q"), F.sum("leaf").alias("leaves"),
        F.first("steps").alias("steps"), F.first("pre").alias("pre")), "kinds")
    several = stored(kinds.groupBy("j", "p1", "p2").agg(F.count("*").alias("kinds")).where("kinds > 1").drop("kinds"), "several")
    key = [F.col("s.d").alias("d"), F.col("p1").bitwiseXOR(F.col("s.z1")).alias("k1"), F.col("p2").bitwiseXOR(F.col("s.z2")).alias("k2")]
    rest = [F.col("s.u1").alias("u1"), F.col("s.u2").alias("u2"), F.col("s.n_bytes").alias("n_bytes"),
            (F.col("pre") + F.col("s.before")).alias("pre"), "n", "low", "sum_q", "leaves"]

    def unfolded(df: DataFrame) -> DataFrame:
        return df.withColumn("s", F.explode("steps")).select(*key, *rest)

    straight = unfolded(kinds.join(several, ["j", "p1", "p2"], "left_anti"))
    refined = unfolded(kinds.join(several, ["j", "p1", "p2"], "left_semi")).groupBy("d", "k1", "k2").agg(
        F.first("u1").alias("u1"), F.first("u2").alias("u2"), F.first("n_bytes").alias("n_bytes"), F.first("pre").alias("pre"), *sums)
    parent = [F.col("k1").bitwiseXOR(F.col("u1")).alias("o1"), F.col("k2").bitwiseXOR(F.col("u2")).alias("o2")]
    return straight.union(refined).select("d", "k1", "k2", *parent, "n_bytes", "pre", "n", "low", "sum_q", "leaves")


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (d, k1, k2, run, ids) rows to the SHA-256 of each node's joined ids."""
    key, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in key), pa.array([digest.hexdigest()])],
                                          names=["d", "k1", "k2", "ends_sha256"])

    for batch in batches:
        for d, k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if (d, k1, k2) == key:
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                yield row()
            key, digest = (d, k1, k2), hashlib.sha256(ids.encode())
    if key is not None:
        yield row()


def trie(turns: DataFrame, members: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The trie of sequences and where each ends.

    ``turns``: c (long), d (depth from 1, without gaps), digest (of the turn's content), n_bytes. ``members``: every c once
    with its ``length``, those without turns included.

    Nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (summed over the
    subtree: members less one, times n_bytes), ends_sha256, and node_1, node_2: the prefix digest. Membership: conv_id, depth,
    node_1, node_2 of the last turn. No members, no nodes."""
    members = stored(members.select("c", "length"), "members")
    blocked = blocks(turns, block)
    flat = blocked.withColumns({"q": F.lit(0).cast("long"), "leaf": F.lit(0).cast("long")})
    first = stored(nodes(flat).select("d", "k1", "k2", "o1", "o2", "n_bytes", F.col("low.c").alias("c")), "nodes")
    kids = stored(first.groupBy((F.col("d") - 1).alias("d"), F.col("o1").alias("k1"), F.col("o2").alias("k2"))
                  .agg(F.count("*").alias("n_children")), "children")
    owned = (first.join(kids, ["d", "k1", "k2"], "left").groupBy("c")
             .agg(F.sum("n_bytes").alias("owned"), F.sum(F.col("n_children").isNull().cast("long")).alias("leaf")))
    totals = blocked.groupBy("c").agg(F.sum(F.aggregate("steps", F.lit(0).cast("long"), lambda a, s: a + s["n_bytes"])).alias("total"))
    values = stored(members.join(totals, "c", "left").join(owned, "c", "left").select(
        "c", "length", (F.coalesce("total", F.lit(0)) - F.coalesce("owned", F.lit(0))).alias("q"),
        F.coalesce("leaf", F.lit(0)).alias("leaf")), "values")

    below = nodes(blocked.join(values.select("c", "q", "leaf"), "c"))
    zero = F.lit(0).cast("long")
    root = values.agg(F.count("*").alias("n"), F.min(F.struct("c", "q")).alias("low"), F.sum("q").alias("sum_q"),
                      F.sum("leaf").alias("leaves")).where("n > 0")
    root = root.select(zero.alias("d"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("o1"),
                       F.lit(None).cast("long").alias("o2"), zero.alias("n_bytes"), zero.alias("pre"), "n", "low", "sum_q", "leaves")
    every = stored(below.union(root), "nodes")

    last = blocked.withColumn("s", F.element_at("steps", -1)).join(values.select("c", "length"), "c").where("s.d = length")
    ends = last.select("c", F.col("s.d").alias("d"), F.col("p1").bitwiseXOR(F.col("s.z1")).alias("k1"),
                       F.col("p2").bitwiseXOR(F.col("s.z2")).alias("k2"))
    ends = stored(ends.union(values.where("length = 0").select("c", *[zero] * 3)), "ends")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",")
    lists = ends.groupBy("d", "k1", "k2", F.floor(F.col("c") / IDS).alias("run")).agg(ids.alias("ids"))
    hashed = (lists.repartition("d", "k1", "k2").sortWithinPartitions("d", "k1", "k2", "run")
              .mapInArrow(_hash_lists, "d long, k1 long, k2 long, ends_sha256 string"))
    parents = every.select((F.col("d") + 1).alias("d"), F.col("k1").alias("o1"), F.col("k2").alias("o2"),
                           F.col("low.c").alias("parent_conv_id"))
    out = (every.join(parents, ["d", "o1", "o2"], "left").join(kids, ["d", "k1", "k2"], "left").join(hashed, ["d", "k1", "k2"], "left")
           .select(F.col("low.c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
                   F.coalesce("n_children", zero).alias("n_children"),
                   # a trie of the root alone has one leaf, which no member owns
                   F.when((F.col("d") == 0) & F.col("n_children").isNull(), 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
                   (F.col("sum_q") - F.col("low.q") - (F.col("n") - 1) * F.col("pre")).alias("saved_tokens"),
                   F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
                   F.col("k1").alias("node_1"), F.col("k2").alias("node_2")))
    return out, ends.toDF("conv_id", "depth", "node_1", "node_2")


def conversation_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                       text: str = "text") -> DataFrame:
    """(c, pos, digest, n_bytes): the turns of each conversation in order. Turns that share a number are in order of their
    digest. Rows without a conversation id belong to none and are left out; repeated rows are turns of their own."""
    known = conversations.where(F.col(conv_id).isNotNull())
    return positions(known.select(F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("turn"), content_digest(role, text).alias("digest"),
                                  F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes")))


def shared_beginnings(turns: DataFrame, heads: int = 9, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rebuild conversations from (c, pos, digest, n_bytes): each takes the first h turns of conversation c - c % ``every``
    (as many as there are), then its own from the h-th on, h = crc32(decimal c) % ``heads``. Returns the turns (c, d, digest,
    n_bytes) and all conversations with their new lengths. ``turns``: stored or cheap to read again."""
    h = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    sizes = turns.groupBy("c").agg(F.count("*").alias("n"))
    convs = stored(sizes.select("c", "n", (F.col("c") - F.col("c") % every).alias("base"), h.alias("h")), "conversations")
    from_base = convs.select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    convs = stored(convs.join(from_base, "base", "left").select(
        "c", "base", F.when(F.col("c") == F.col("base"), 0).otherwise(F.col("h")).alias("skip"),
        F.when(F.col("c") == F.col("base"), 0).otherwise(F.least("h", F.coalesce("n_base", F.lit(0)))).cast("long").alias("lead"), "n"), "rebuilt")
    members = convs.select("c", (F.col("lead") + F.greatest(F.col("n") - F.col("skip"), F.lit(0))).alias("length"))
    own = turns.join(convs.select("c", "skip", "lead"), "c").where("pos >= skip").select(
        "c", (F.col("lead") + F.col("pos") - F.col("skip") + 1).alias("d"), "digest", "n_bytes")
    near = F.array(*(F.lit(k) for k in range(1 - every, every) if k))
    lent = turns.where((F.col("pos") < heads - 1) & (F.col("c") % every == 0)).select(
        F.col("c").alias("base"), F.explode(near).alias("k"), "pos", "digest", "n_bytes")
    lent = lent.select((F.col("base") + F.col("k")).alias("c"), "base", "pos", "digest", "n_bytes")
    taken = lent.join(convs.select("c", "base", "lead"), ["c", "base"]).where("pos < lead").select(
        "c", (F.col("pos") + 1).alias("d"), "digest", "n_bytes")
    return own.union(taken), members
