"""Prefix trie of conversations by van Emde Boas recursion.

A forest of height 2m (a power of two) is cut at depth m: the first m symbols of
every sequence form the upper tries, each distinct cut prefix gets a name, and
what follows a cut prefix goes to the lower trie of that name.  Upper and lower
tries are a forest of height m together and are cut again by the same job, until
each row is one symbol, that is one node; equal rows are merged after every cut.
Totals then go up along the same cuts: first the totals of each block of height
1, 2, 4 ... (upper block plus the lower blocks grafted to its cut nodes), then,
from the highest cuts down, everything below a cut node (its own block plus what
hangs below the block's last nodes).  A forest of height h takes log2(h) cuts
and as many grafts, whatever the number of conversations.

A turn is stood for by an MD5 of role and text; names are MD5s of a tree's name
and the turns up to the cut.

Defined results: rows without a conv_id belong to no conversation; null role or
text counts as empty; turns are ordered by turn (null first), then role, then
text; repeated rows are turns of their own; a conversation without turns is a
member of the root; texts are never cut; an empty table gives no rows; other
columns are ignored.  The turns of one conversation are one array of 40-byte
symbols; no other group is gathered: the ids that end at a node are joined in
runs and hashed as a stream.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage

ROOT = "0" * 32
#: conv_ids in one joined run.
RUN = 4096
_DIGEST, _LENGTH = 32, 8


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its ``turns``: one symbol (digest, text length) a turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    symbol = F.concat(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")), F.lpad(F.hex(F.length("text").cast("long")), _LENGTH, "0"))
    numbered = rows.select("conv_id", F.row_number().over(order).alias("at"), symbol.alias("symbol"))
    listed = numbered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "symbol"))).alias("turns"))
    return listed.select("conv_id", F.col("turns.symbol").alias("turns"))


def share_heads(turns: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of c - c % group
    (none if there is no such conversation), h being crc32(c) % heads."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % group
    lead = turns.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_first"), F.slice("turns", 1, heads - 1).alias("_lead"))
    rows = turns.withColumn("_h", h).withColumn("_first", first).join(lead, "_first", "left")
    own = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    shared = F.when(F.col("_lead").isNull(), F.array().cast("array<string>")).otherwise(F.slice("_lead", F.lit(1), F.col("_h")))
    return rows.select("conv_id", F.concat(shared, own).alias("turns"))


def _name(*parts: Column) -> Column:
    return F.md5(F.concat(*parts))


def _cut(rows: DataFrame, m: int) -> DataFrame:
    """The forest of height 2m → a forest of height m."""
    size = F.size("turns")
    head = F.slice("turns", 1, m)
    name = _name(F.col("tree"), F.array_join(head, ""))
    upper = F.struct(
        "tree", "depth", head.alias("turns"), F.when(size >= m, name).alias("end"), F.when(size <= m, F.col("whole")).alias("whole"))
    lower = F.struct(
        name.alias("tree"), (F.col("depth") + m).alias("depth"), F.slice("turns", F.lit(m + 1), F.greatest(size - m, F.lit(0))).alias("turns"),
        F.col("end"), F.col("whole"))
    parts = rows.select("n", "least", F.explode(F.when(size > m, F.array(upper, lower)).otherwise(F.array(upper))).alias("part"))
    return (parts.select("n", "least", "part.*").groupBy("tree", "depth", "turns", "end")
            .agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("whole").alias("whole")))


def _plus(totals: DataFrame, links: DataFrame, below: DataFrame) -> DataFrame:
    """``totals`` (tree, leaves, saved) plus those of ``below`` over ``links`` (tree, end)."""
    added = links.join(below.withColumnRenamed("tree", "end"), "end").select("tree", "leaves", "saved")
    return totals.unionByName(added).groupBy("tree").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """``sequences`` (conv_id, turns) → one row per distinct prefix: conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    whole = F.md5(F.array_join("turns", ""))
    sequences = cut_lineage(sequences.withColumn("whole", whole), "sequences")
    ends = end_digests(sequences.select("conv_id", F.col("whole").alias("name")))
    rows = sequences.groupBy("turns", "whole").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    rows = cut_lineage(rows.select(F.lit(ROOT).alias("tree"), F.lit(0).alias("depth"), "turns", F.lit(None).cast("string").alias("end"), "whole", "n", "least"), "forest")
    longest, n, least = rows.agg(F.max(F.size("turns")), F.sum("n"), F.min("least")).first()
    if n is None:
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in COLUMNS))
    height = 1
    while height <= longest:
        height *= 2

    # cut: links[g] are the blocks of height g that are full, from their tree to their last nodes
    links = {}
    g = height
    while g > 1:
        g //= 2
        rows = cut_lineage(_cut(rows, g), "forest")
        links[g] = rows.where(F.size("turns") == g).select("tree", "depth", "end")
    length = F.conv(F.substring(F.col("turns")[0], _DIGEST + 1, _LENGTH), 16, 10).cast("long")
    found = rows.where(F.size("turns") == 1)
    children = found.groupBy("tree").agg(F.count("*").alias("n_children"))
    top = spark.range(1).select(F.lit(None).cast("string").alias("parent"), F.lit(ROOT).alias("name"), F.lit(0).alias("depth"), F.lit(n).cast("long").alias("n"),
                                F.lit(least).cast("long").alias("least"), F.lit(0).cast("long").alias("length"), F.md5(F.lit("").cast("binary")).alias("whole"))
    nodes = found.select(F.col("tree").alias("parent"), F.col("end").alias("name"), F.col("depth") + 1, "n", "least", length.alias("length"), "whole")
    nodes = top.union(nodes).join(children.withColumnRenamed("tree", "name"), "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = (F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("length")).alias("saved"))
    nodes = cut_lineage(nodes.select("name", "parent", "depth", "n", "least", "whole", "n_children", *own), "nodes")

    # graft: blocks[g] are the totals of the blocks of height g
    blocks = {1: cut_lineage(nodes.where("parent is not null").select(F.col("parent").alias("tree"), F.col("depth") - 1, "leaves", "saved")
                             .toDF("tree", "depth", "leaves", "saved").groupBy("tree", "depth")
                             .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "blocks")}
    g = 1
    while g < height:
        even = F.col("depth") % (2 * g) == 0
        depth = blocks[g].where(even).select("tree", "depth")
        total = _plus(blocks[g].where(even).drop("depth"), links[g].where(even).drop("depth"), blocks[g].drop("depth"))
        blocks[2 * g] = cut_lineage(total.join(depth, "tree"), "blocks")
        g *= 2
    below = blocks[height].drop("depth")
    while g > 1:
        g //= 2
        odd = F.col("depth") % (2 * g) == g
        below = below.unionByName(cut_lineage(_plus(blocks[g].where(odd).drop("depth"), links[g].where(odd).drop("depth"), below), "below"))

    zero = F.lit(0).cast("long")
    parent = nodes.select(F.col("name").alias("parent"), F.col("least").alias("parent_conv_id"))
    return (nodes.join(below.select(F.col("tree").alias("name"), F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved")), "name", "left")
            .join(parent, "parent", "left").join(ends.withColumnRenamed("name", "whole"), "whole", "left")
            .select(F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
                    F.col("n_children").cast("long").alias("n_children"), (F.col("leaves") + F.coalesce("_leaves", zero)).alias("n_leaves"),
                    (F.col("saved") + F.coalesce("_saved", zero)).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


COLUMNS = [("conv_id", "long"), ("depth", "long"), ("parent_conv_id", "long"), ("n_convs", "long"), ("n_children", "long"),
           ("n_leaves", "long"), ("saved_tokens", "long"), ("ends_sha256", "string")]


def end_digests(members: DataFrame, run: int = RUN) -> DataFrame:
    """name → SHA-256 of its decimal conv_ids, ascending and comma-joined.

    Rows are dealt by ranges of (name, conv_id), so that a name with very many
    members is sorted and joined by many tasks; its digest then reads the joined
    runs one after another."""
    runs_schema = pa.schema([("name", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
    out_schema = pa.schema([("name", pa.string()), ("ends_sha256", pa.string())])

    def joined(batches):
        name, ids, rows = None, [], []
        for batch in batches:
            for this, conv in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist()):
                if this != name or len(ids) == run:
                    if ids:
                        rows.append((name, ids[0], ",".join(map(str, ids))))
                    name, ids = this, []
                ids.append(conv)
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), runs_schema)], schema=runs_schema)
                rows = []
        if ids:
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip((name, ids[0], ",".join(map(str, ids))), runs_schema)], schema=runs_schema)

    def digested(batches):
        name, sha = None, None
        for batch in batches:
            rows = []
            for this, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
                if this == name:
                    sha.update(b"," + ids.encode())
                else:
                    if sha is not None:
                        rows.append((name, sha.hexdigest()))
                    name, sha = this, hashlib.sha256(ids.encode())
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), out_schema)], schema=out_schema)
        if sha is not None:
            yield pa.record_batch([pa.array([name]), pa.array([sha.hexdigest()])], schema=out_schema)

    sorted_members = members.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    runs = sorted_members.mapInArrow(joined, "name string, first long, ids string")
    return runs.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digested, "name string, ends_sha256 string")
