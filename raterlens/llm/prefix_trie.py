"""Conversation prefix trie by fixed-length block hashing.

Conversations are cut into blocks of BLOCK turns. A block's digest unites the
digests of its turns and their positions, a prefix's digest those of its
blocks. Conversations are grouped by (digest of the prefix before a block,
digest of the block) first, block after block; a group becomes one row in the
tasks, however many conversations share it. Only where a prefix goes on with
several different blocks are the turn boundaries inside them grouped again;
where all conversations go on with the same block, each boundary in it is a
node with the group's counts.

Texts stay where they are read: a turn travels as 120 bits of its SHA-256 and
its length. Digests of a position are 2 x 64 bits, united by exclusive or.

Sums over subtrees need no walk along the trie:

* A conversation "owns" the nodes of which it is the smallest member; from the
  first one on, all its nodes (its members are members of what lies above).
  A subtree has as many leaves as members that own a childless node.
* A subtree saves, for each member but the owner of its top, the bytes of the
  turns from the top's on that the member doesn't own. Its turns before the
  top are those of the top's own prefix, so this is a sum over members of the
  bytes before their first owned node, less the prefix once a member.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlens.llm.common import split_join
from raterlens.session import cut_lineage

BLOCK = 4
FAMILY = 5       # conversation c starts with turns of c - c % FAMILY
MAX_HEAD = 9     # crc32(c) % MAX_HEAD of them
NODE = ["depth", "key1", "key2"]
GROUP = ["block", "start1", "start2", "digest1", "digest2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0, by turn), two digests of (role, text), bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hexed = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "hash1", "hash2")
    return (conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", hexed.alias("hex"),
        F.octet_length(text).cast("bigint").alias("bytes"))
        .withColumn("hash1", F.conv(F.substring("hex", 1, 15), 16, 10).cast("bigint"))
        .withColumn("hash2", F.conv(F.substring("hex", 16, 15), 16, 10).cast("bigint"))
        .select("conv_id", (F.row_number().over(order) - 1).alias("place"), "hash1", "hash2", "bytes"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id) and their rebuilt turns, as ``turns``."""
    ids = turns.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    heads = ids.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), F.expr(
        f"CAST(crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {MAX_HEAD} AS INT)").alias("h"))
    known = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = cut_lineage(heads.join(known, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")))
    others = heads.filter("base <> conv_id AND taken > 0").select("conv_id", "base", "taken")
    first = turns.filter(F.col("place") < MAX_HEAD).withColumnRenamed("conv_id", "base")
    head = others.join(first, "base").filter("place < taken")
    own = turns.join(heads, "conv_id").filter("base = conv_id OR place >= h").withColumn(
        "place", F.expr("if(base = conv_id, place, taken + place - h)"))
    return heads.select("conv_id"), head.select(*turns.columns).unionByName(own.select(*turns.columns))


def blocks_of(turns: DataFrame) -> DataFrame:
    """Blocks of turns: conv_id, block, size, digest1/2, start1/2 (of the prefix
    before it), before (bytes of that prefix), and of each turn x1_j, x2_j, b_j."""
    at = turns.select(
        "conv_id", "bytes", F.expr(f"place div {BLOCK}").cast("int").alias("block"), (F.col("place") % BLOCK).alias("j"),
        *[F.xxhash64(F.lit(i), "place", "hash1", "hash2").alias(f"x{i}") for i in (1, 2)])
    each = [F.max(F.when(F.col("j") == j, F.col(c))).alias(f"{a}_{j}")
            for j in range(BLOCK) for c, a in (("x1", "x1"), ("x2", "x2"), ("bytes", "b"))]
    cut = at.groupBy("conv_id", "block").agg(
        F.count(F.lit(1)).cast("int").alias("size"), F.bit_xor("x1").alias("digest1"), F.bit_xor("x2").alias("digest2"),
        F.sum("bytes").alias("bytes"), *each)
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    return cut.select(
        "*", *[F.coalesce(F.bit_xor(f"digest{i}").over(ahead), zero).alias(f"start{i}") for i in (1, 2)],
        F.coalesce(F.sum("bytes").over(ahead), zero).alias("before"))


def _boundaries(groups: DataFrame, *columns) -> DataFrame:
    """A row for each turn boundary of each block: the node's key (digest of the
    prefix to it), its parent's, and ``columns`` (functions of the turn's number)."""
    keys = {i: [F.col(f"start{i}")] for i in (1, 2)}
    for i in (1, 2):
        for j in range(BLOCK):
            keys[i].append(keys[i][-1].bitwiseXOR(F.col(f"x{i}_{j}")))
    nodes = [F.struct((F.col("block") * BLOCK + j + 1).alias("depth"), keys[1][j + 1].alias("key1"),
                      keys[2][j + 1].alias("key2"), keys[1][j].alias("up1"), keys[2][j].alias("up2"),
                      *[c(j) for c in columns]) for j in range(BLOCK)]
    return groups.select("*", F.explode(F.slice(F.array(*nodes), F.lit(1), F.col("size"))).alias("node"))


def _bytes_before(j: int):
    return sum((F.col(f"b_{i}") for i in range(j)), F.col("before")).alias("prefix_bytes")


def nodes_of(blocks: DataFrame) -> DataFrame:
    """Nodes of depth 1 and more: depth, key1/2, up1/2, conv_id (the smallest
    member), n_convs, prefix_bytes (of the turns before the last)."""
    each = [f"{a}_{j}" for a in ("x1", "x2", "b") for j in range(BLOCK)]  # equal within a group
    groups = cut_lineage(blocks.groupBy(*GROUP).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        *[F.max(c).alias(c) for c in ["size", "before", *each]]))
    siblings = cut_lineage(groups.groupBy(*GROUP[:3]).agg(F.count(F.lit(1)).alias("siblings")))
    known = split_join(groups, siblings, GROUP[:3])
    split = _boundaries(known, _bytes_before).select("conv_id", "n_convs", "siblings", "node.*")
    alone = split.filter("siblings = 1").drop("siblings")
    diverging = split.filter("siblings > 1").groupBy(*NODE, "up1", "up2", "prefix_bytes").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    return alone.unionByName(diverging)


_KEY = [("depth", pa.int32()), ("key1", pa.int64()), ("key2", pa.int64())]
_LISTS = pa.schema([*_KEY, ("first", pa.int64()), ("ids", pa.string())])
_ENDS = pa.schema([*_KEY, ("ends_sha256", pa.string())])


def _runs(batch, columns: int = 3):
    """Runs of equal keys (the first columns) in a batch: key, from, to."""
    keys = list(zip(*(batch.column(c).to_pylist() for c in range(columns))))
    at = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[at]:
            yield keys[at], at, i
            at = i


def _lists(batches):
    """Ids of each run as one text a batch."""
    for batch in batches:
        ids = batch.column(3).to_pylist()
        rows = [(*key, ids[a], ",".join(map(str, ids[a:b]))) for key, a, b in _runs(batch)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LISTS)], schema=_LISTS)


def _digests(batches):
    """One digest a key from its lists in order, as a stream."""
    key, digest = None, None
    for batch in batches:
        out, lists = [], batch.column(4)
        for k, a, b in _runs(batch):
            if k != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest, sep = k, hashlib.sha256(), b""
            for i in range(a, b):
                digest.update(sep + lists[i].as_py().encode())
                sep = b","
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ENDS)], schema=_ENDS)
    if key is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip((*key, digest.hexdigest()), _ENDS)], schema=_ENDS)


def ends_of(convs: DataFrame) -> DataFrame:
    """Digest of the ordered ids of the conversations that end at each node.
    Many copies of one conversation are listed by several tasks, in ranges of
    ids; one task streams their lists, never holding them together."""
    key = "depth int, key1 bigint, key2 bigint"
    lists = (convs.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
             .mapInArrow(_lists, f"{key}, first bigint, ids string"))
    return (lists.repartition(*NODE).sortWithinPartitions(*NODE, "first")
            .mapInArrow(_digests, f"{key}, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, a row for each node.

    ``conversations`` needs conv_id (integer), turn, role and text; further
    columns are ignored. Conversation c is rebuilt from the first h turns of
    conversation c - c % 5 (h = crc32 of c's decimal digits, modulo 9) and its
    own after its first h. Returns conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256; (conv_id, depth) names
    a node.

    Turns are ordered by turn, null first; ties by the digest of role and
    text, so repeated rows are turns of their own and the result is fixed.
    Null role and text are empty. Rows without a conv_id belong to no
    conversation and are left out. Negative ids keep the sign of c % 5. An
    empty table gives no rows. A very long text is hashed where it is read; of
    a very long conversation a task sorts 40 bytes a turn, on disk if needed.
    """
    turns = cut_lineage(turns_of(conversations))
    ids, again = rebuilt(turns)
    ids = cut_lineage(ids)
    blocks = cut_lineage(blocks_of(again))
    nodes = cut_lineage(nodes_of(blocks))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("key1"),
                             F.col("up2").alias("key2")).agg(F.count(F.lit(1)).alias("n_children"))
    children = cut_lineage(children)
    # of each conversation: its end, the bytes before its first own node, that node's depth, whether it owns a leaf
    zero = F.lit(0).cast("bigint")
    lengths = blocks.groupBy("conv_id").agg(
        F.sum("size").cast("int").alias("depth"), F.bit_xor("digest1").alias("key1"),
        F.bit_xor("digest2").alias("key2"), F.sum("bytes").alias("bytes"))
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("first_own"), F.min("prefix_bytes").alias("shared"))
    leaves = nodes.join(children, NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    convs = cut_lineage(
        ids.join(lengths, "conv_id", "left").join(owned, "conv_id", "left").join(leaves, "conv_id", "left").select(
            "conv_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("key1", zero).alias("key1"),
            F.coalesce("key2", zero).alias("key2"), F.coalesce("shared", "bytes", zero).alias("shared"),
            F.coalesce("first_own", F.coalesce("depth", F.lit(0)) + 1).alias("first_own"),
            F.coalesce("leaf", F.lit(0)).alias("leaf")))
    # sums over the members of each node that don't own it, by blocks again
    member = blocks.drop("before", "bytes").join(convs.select("conv_id", "shared", "first_own", "leaf"), "conv_id")
    parts = [F.sum(F.when(F.col("block") * BLOCK + j + 1 < F.col("first_own"), F.col("shared")).otherwise(0))
             .alias(f"s_{j}") for j in range(BLOCK)]
    each = [f"{a}_{j}" for a in ("x1", "x2") for j in range(BLOCK)]
    sums = member.groupBy(*GROUP).agg(F.sum("leaf").alias("leaves"), *parts,
                                      *[F.max(c).alias(c) for c in ["size", *each]])
    sums = _boundaries(sums, lambda j: F.col(f"s_{j}").alias("shared")).select(
        "node.depth", "node.key1", "node.key2", "leaves", "node.shared")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                     F.sum("leaf").alias("leaves"), F.sum("shared").alias("shared")) \
        .filter("n_convs > 0").select(F.lit(0).alias("depth"), zero.alias("key1"), zero.alias("key2"), "*",
                                      zero.alias("prefix_bytes"))
    rows = (nodes.select(*NODE, "up1", "up2", "conv_id", "n_convs", "prefix_bytes")
            .unionByName(root, True).unionByName(children, True).unionByName(sums, True)
            .unionByName(ends_of(convs), True))
    found = cut_lineage(rows.groupBy(*NODE).agg(
        F.max("up1").alias("up1"), F.max("up2").alias("up2"), F.max("conv_id").alias("conv_id"),
        F.max("n_convs").alias("n_convs"), F.coalesce(F.sum("n_children"), zero).alias("n_children"),
        F.sum("leaves").alias("leaves"),
        (F.sum("shared") - (F.max("n_convs") - 1) * F.max("prefix_bytes")).alias("saved_tokens"),
        F.coalesce(F.max("ends_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
        .withColumn("n_leaves", F.expr("if(n_children = 0, 1L, leaves)")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("key1").alias("up1"), F.col("key2").alias("up2"),
                         F.col("conv_id").alias("parent_conv_id"))
    below = cut_lineage(found.filter("depth > 0"))
    top = found.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    out = split_join(below, above, ["depth", "up1", "up2"]).select(*columns).unionByName(top.select(*columns))
    return out.withColumn("depth", F.col("depth").cast("bigint"))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (  -- CRC-32 of the decimal digits, bit by bit
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
           list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
             lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, x: xor(xor(a, x) >> 1, 3988292384::BIGINT * (xor(a, x) & 1))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
parts AS (
  SELECT h.conv_id, 0 AS half, place, role, text FROM h JOIN t ON t.conv_id = h.base WHERE place < h
  UNION ALL
  SELECT h.conv_id, 1, place, role, text FROM h JOIN t ON t.conv_id = h.conv_id WHERE place >= h),
r AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
         md5(string_agg(md5(length(role) || ':' || role || text), '') OVER w) AS node
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY half, place ROWS UNBOUNDED PRECEDING)),
up AS (
  SELECT conv_id, depth, bytes, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent FROM r
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM h),
n AS (
  SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         any_value(bytes) AS bytes FROM up GROUP BY node),
kids AS (SELECT parent, count(*) AS n_children FROM n GROUP BY 1),
below AS (SELECT DISTINCT a.node AS top, b.node FROM up a JOIN up b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
  SELECT top, CAST(sum(CASE WHEN k.parent IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
         CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens
  FROM below JOIN n ON n.node = below.node LEFT JOIN kids k ON k.parent = below.node GROUP BY 1),
last AS (SELECT conv_id, arg_max(node, depth) AS node FROM up GROUP BY 1),
ends AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM last GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
       coalesce(k.n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM n LEFT JOIN n p ON p.node = n.parent LEFT JOIN kids k ON k.parent = n.node
JOIN sums ON sums.top = n.node LEFT JOIN ends ON ends.node = n.node
"""
