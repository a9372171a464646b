"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of leading turns; its members are the conversations that begin with it. Every turn gets a
digest and every prefix of a conversation the digest of the one before and the turn, so a node is named by one key, and the text
of a turn moves nowhere. Equal conversations are one row from then on.

The trie is peeled from the deepest level: the rows of a level are the nodes that survive from the one below, with their last turn
stripped, and the conversations that end there. They are regrouped by their key, with partial sums in each map task, so
that a turn with which a third of all conversations begin is no hot task; the group is a node, and numbers of members,
children, leaves and saved bytes are sums of what arrives. Each level is a staged table: one shuffle, and no
lineage that grows.

Below the deepest prefix that two different conversations share, every branch is a single conversation. Peeling
begins at that depth; the rest of such a branch needs no regrouping and comes from the row itself. So the rounds are as many as the
shared turns, however long the longest conversation is.

Defined cases: turns stand in the order of their number (null first), then of the digest of role and text; null roles and texts
are empty. Ids are whole numbers; rows whose id is null or none are left out. A repeated row is a turn of its own. A conversation
without turns ends at the root. Empty tables give no node. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.session import stage, staged

#: Neighbouring ids that are written out together before a node's list is digested.
TOGETHER = 512
#: Neighbours whose first turns are shared, and the bound of their number (``shared_heads``).
FAMILY, MOST_SHARED = 5, 9
ROOT = b""
TURN = "struct<key:binary,size:bigint,rest:bigint>"


def _id(name: str) -> Column:
    return F.expr(f"try_cast({name} as bigint)")


def turn_rows(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, pos, digest, size): the turns of each conversation, numbered from 1, without their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the length keeps roles and texts apart
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.select(_id(id_col).alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.where("conv_id is not null").select("conv_id", F.row_number().over(order).alias("pos"), "digest", "size")


def with_ends(turns: DataFrame) -> DataFrame:
    """``turns`` with a row at place 0 for every conversation, so that none is lost when it has no turns."""
    marks = turns.where("pos = 1").select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("size"))
    return turns.unionByName(marks)


def shared_heads(turns: DataFrame) -> DataFrame:
    """Conversations rebuilt to share beginnings: conversation c gets the first h turns of c - c % ``FAMILY`` in place of
    its own first h, with h the CRC-32 of the decimal c modulo ``MOST_SHARED``. Takes and returns (conv_id, pos, digest, size),
    the result with a row at place 0 for each conversation."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    turns = stage(turns, "conversation-turns")
    known = turns.where("pos = 1").select("conv_id")
    heads = turns.where((F.col("pos") < MOST_SHARED) & (F.pmod("conv_id", F.lit(FAMILY)) == 0)).select(
        F.explode(F.sequence(F.col("conv_id"), F.col("conv_id") + (FAMILY - 1))).alias("conv_id"), "pos", "digest", "size"
    )
    heads = heads.where(F.col("pos") <= h).join(known, "conv_id", "left_semi")
    own = turns.where(F.col("pos") > h)
    return own.unionByName(heads).unionByName(with_ends(turns).where("pos = 0"))


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation and place to one row a conversation: (conv_id, depth, turns), a turn being the key of the prefix
    that ends with it, its bytes, and the bytes from it to the end."""
    kind = pa.list_(pa.struct([("key", pa.binary()), ("size", pa.int64()), ("rest", pa.int64())]))
    done: list[tuple] = []
    conv, key, turns = None, b"", []

    def close() -> None:
        rest = 0
        for turn in reversed(turns):
            rest += turn["size"]
            turn["rest"] = rest
        done.append((conv, len(turns), turns))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [[]] * 3
        kinds = (pa.int64(), pa.int32(), kind)
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "depth", "turns"])
        done.clear()
        return out

    for batch in batches:
        for c, digest, size in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            if c != conv:
                if conv is not None:
                    close()
                conv, key, turns = c, b"", []
            if digest is not None:
                key = hashlib.md5(key + bytes.fromhex(digest)).digest()
                turns.append({"key": key, "size": size, "rest": 0})
        if done:
            yield flush()
    if conv is not None:
        close()
    yield flush()


def keyed(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, turns) of (conv_id, pos, digest, size); a task streams over its conversations."""
    dealt = turns.select("conv_id", "pos", "digest", "size").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return dealt.mapInArrow(chain, f"conv_id long, depth int, turns array<{TURN}>")


def _last(turns: str = "turns") -> Column:
    return F.coalesce(F.try_element_at(turns, F.lit(-1))["key"], F.lit(ROOT))


def _stripped(depth: int) -> Column:
    return F.slice("turns", F.lit(1), F.lit(depth))


def digest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part), sorted by key, to (key, sha): the digest of a node's parts joined by commas, taken part by part."""
    key, sha = None, None
    for batch in batches:
        found: list[tuple] = []
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    found.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(part.encode())
        yield _digests(found)
    yield _digests([(key, sha.hexdigest())] if key is not None else [])


def _digests(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[]] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.string()), strict=True)], ["e_key", "sha"])


def ended_at(keyed_rows: DataFrame) -> DataFrame:
    """(e_key, sha): digest of the ascending ids of the conversations that end at a node.

    The list of a node may be as long as the table; it is written out in parts of neighbouring ids, and the parts stream in order through
    the digest, which holds one of them at a time.
    """
    part = F.floor(F.col("conv_id") / TOGETHER)
    parts = keyed_rows.groupBy(_last().alias("key"), part.alias("part")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )
    ordered = parts.repartition("key").sortWithinPartitions("key", "part").select("key", "ids")
    return ordered.mapInArrow(digest_lists, "e_key binary, sha string")


def _distinct(keyed_rows: DataFrame) -> DataFrame:
    """One row for equal conversations: (depth, turns, n, conv_id)."""
    key = _last().alias("key")
    return keyed_rows.groupBy(key, "depth").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns")
    ).drop("key")


def _shared_depth(distinct: DataFrame) -> int:
    """Depth of the deepest prefix that two different conversations have in common; 0 for the root."""
    prefixes = distinct.select(F.posexplode("turns").alias("at", "turn"))
    shared = prefixes.groupBy("turn.key").agg(F.count("*").alias("n"), F.max("at").alias("at")).where("n > 1")
    deepest = shared.agg(F.max("at").alias("at")).first()["at"]
    return 0 if deepest is None else deepest + 1


NODE = ["key", "parent_key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def _branches(distinct: DataFrame, shared: int) -> DataFrame:
    """The nodes of single conversations below the shared depth."""
    long_ones = distinct.where(F.col("depth") > shared)
    at = F.col("at") + 1
    each = long_ones.select("conv_id", "n", "depth", "turns", F.posexplode("turns").alias("at", "turn")).where(F.col("at") >= shared)
    return each.select(
        F.col("turn.key").alias("key"),
        F.when(F.col("at") == 0, F.lit(ROOT)).otherwise(F.get("turns", F.col("at") - 1)["key"]).alias("parent_key"),
        at.cast("int").alias("depth"), "conv_id", F.col("n").alias("n_convs"),
        F.when(at < F.col("depth"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * F.col("turn.rest")).alias("saved_tokens"),
    )


def peel(distinct: DataFrame) -> DataFrame:
    """All nodes (``NODE``) of staged distinct conversations, level by level from the deepest shared one."""
    spark = distinct.sparkSession
    shared = _shared_depth(distinct)
    below = distinct.where(F.col("depth") > shared)
    first_rest = F.get("turns", F.lit(shared))["rest"]
    survivors = below.select(
        _stripped(shared).alias("turns"), F.col("n").alias("n_convs"), "conv_id", F.lit(1).cast("long").alias("child"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * first_rest).alias("saved_tokens"),
    )
    none = F.lit(0).cast("long")
    paths = []
    for depth in range(shared, -1, -1):
        ended = distinct.where(F.col("depth") == depth).select(
            "turns", F.col("n").alias("n_convs"), "conv_id", none.alias("child"), none.alias("n_leaves"), none.alias("saved_tokens")
        )
        level = survivors.unionByName(ended).groupBy(_last().alias("key")).agg(
            F.first("turns").alias("turns"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
            F.sum("child").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"),
        )
        size = F.coalesce(F.try_element_at("turns", F.lit(-1))["size"], none)
        parent = F.when(F.size("turns") > 1, F.try_element_at("turns", F.lit(-2))["key"]).otherwise(F.lit(ROOT)) if depth > 1 else F.lit(ROOT)
        level = stage(
            level.select(
                "key", (F.lit(None).cast("binary") if depth == 0 else parent).alias("parent_key"), F.lit(depth).alias("depth"), "conv_id", "n_convs",
                "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
                (F.col("below") + (F.col("n_convs") - 1) * size).alias("saved_tokens"), "turns",
            ),
            f"trie-level-{depth}",
        )
        paths += staged()[-1:]
        survivors = level.select(
            _stripped(max(depth - 1, 0)).alias("turns"), "n_convs", "conv_id", F.lit(1).cast("long").alias("child"), "n_leaves", "saved_tokens"
        )
    levels = spark.read.schema(level.schema).parquet(*paths).select(*NODE)
    return levels.unionByName(_branches(distinct, shared))


def trie(turns: DataFrame) -> DataFrame:
    """Every node of the conversations given as (conv_id, pos, digest, size), as of ``with_ends(turn_rows(...))``."""
    rows = stage(keyed(turns), "conversation-keys")
    distinct = stage(_distinct(rows), "distinct-conversations")
    nodes = stage(peel(distinct), "trie-nodes")
    parents = nodes.where("n_children > 0").select(F.col("key").alias("p_key"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(parents, nodes["parent_key"] == parents["p_key"], "left")
    ends = ended_at(rows)
    found = found.join(ends, found["key"] == ends["e_key"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def report(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("depth", F.col("depth").cast("long"))
