"""Operator 11, a Merkle manifest of a dataset with proofs read from parents' preimages.

A leaf is the sha256 of a row's fields, each ``-`` if null, else its UTF-8 byte
count, ``:`` and the value. Within a group leaves stand in order of ids; runs of
``fanout`` neighbours are hashed level by level until one node, the group's
subroot, is left, and subroots in order of groups are hashed likewise to the root.
Digests are 64 hexadecimal digits, so the preimage of a parent is a string in
which child i takes up the digits from 64 * i on.

Stored are preimages: a band is several levels of a tree, and a block of a band
is a row that holds the preimages of all parents above up to ``SPAN`` neighbouring
nodes. Leaves are written by blocks, blocks join the block of the next band above
them, from the top down, and so each leaf finds the preimages of all its ancestors
by one join of blocks. Its siblings are what is left of each preimage when its own
64 digits are cut out, and a new digest folds to the root by splicing it into that
place, hashing, and splicing the result into the next preimage.

Order of leaves: ids with nulls first, then leaves; of equal rows any. Groups are
in order with null first, by bytes. Groups of any size are cut into blocks, so a
hot group is spread over all tasks. Texts are read once, whole; an empty table has
no rows. Fields are read by name, other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmap.llm.shared import shared_table

#: Nodes below one block at most.
SPAN = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest of a row's fields."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def _levels(fanout: int) -> int:
    """Levels of a band: as many as have at most ``SPAN`` nodes below."""
    levels = 1
    while fanout ** (levels + 1) <= SPAN:
        levels += 1
    return levels


def numbered(nodes: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``nodes`` (part, ...) with ``pos``, their place from 0 within ``part`` in the given order, and ``size``, the number of the part's nodes.

    Rows are sorted by ranges; places follow from a count for each range and part. Equal rows are spread by where they were read.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("part", *order)]
    rows = nodes.withColumn("_spread", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys, F.col("_spread")).sortWithinPartitions(*keys, F.col("_spread")).drop("_spread")
    rows = shared_table(rows.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), label)
    pieces = rows.groupBy("part", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("part")  # a row a range
    pieces = pieces.withColumn("size", F.sum("_n").over(whole)).withColumn("_before", F.sum("_n").over(whole.orderBy("_range")) - F.col("_n"))
    pieces = pieces.select(F.col("part").alias("_part"), F.col("_range").alias("_piece"), "_first", "_before", "size")
    out = rows.join(pieces, (F.col("_range") == F.col("_piece")) & F.col("part").eqNullSafe(F.col("_part")))
    return out.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_first", "_before", "_part", "_range", "_piece")


def blocks_of(nodes: DataFrame, fanout: int) -> DataFrame:
    """Blocks of ``nodes`` (part, size, pos, digest, ...): part, size, block, members (in order), preimages (level, then place), top (the digest above them all).

    A part of one node has a block without levels.
    """
    levels = _levels(fanout)
    span = fanout**levels
    members = F.array_sort(F.collect_list(F.struct("pos", *(c for c in nodes.columns if c not in ("part", "size", "pos")))))
    rows = nodes.groupBy("part", "size", F.expr(f"pos div {span}").alias("block")).agg(members.alias("members"))
    # a band of a larger part has all its levels, that of a smaller one as many as leave one node
    need = F.lit(levels)
    for k in reversed(range(levels)):
        need = F.when(F.col("size") <= fanout**k, k).otherwise(need)
    rows = rows.withColumn("levels", need).withColumn("nodes", F.transform("members", lambda m: m["digest"])).withColumn("preimages", F.expr("cast(array() as array<array<string>>)"))
    for k in range(levels):
        above = F.expr(f"transform(sequence(0, (size(nodes) - 1) div {fanout}), i -> array_join(slice(nodes, int(i * {fanout} + 1), {fanout}), ''))")
        rows = rows.withColumn("_above", F.when(F.col("levels") > k, above))
        rows = rows.withColumn("preimages", F.when(F.col("levels") > k, F.concat("preimages", F.array("_above"))).otherwise(F.col("preimages")))
        rows = rows.withColumn("nodes", F.when(F.col("levels") > k, F.transform("_above", lambda p: F.sha2(p, 256))).otherwise(F.col("nodes"))).drop("_above")
    return rows.withColumn("top", F.get("nodes", F.lit(0))).drop("nodes", "levels")


def _own(fanout: int) -> Column:
    """The path of a member m within its block: the preimage above it and its place there, level by level."""
    return F.expr(f"transform(preimages, (ps, k) -> struct(ps[int((m.pos - block * {fanout ** _levels(fanout)}) div cast(power({fanout}, k + 1) as bigint))] as preimage, int((m.pos div cast(power({fanout}, k) as bigint)) % {fanout}) as slot))")


def ascend(leaves: DataFrame, order: Sequence[str], fanout: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Bands of blocks from the leaves (part, digest, ...) up, and each part's last digest (part, digest)."""
    span = fanout ** _levels(fanout)
    nodes = numbered(leaves, order, label)
    bands: list[DataFrame] = []
    while True:
        bands.append(shared_table(blocks_of(nodes, fanout), f"{label}-band"))
        larger = bands[-1].where(F.col("size") > span)
        if larger.isEmpty():
            break
        # parts of one block are done; the others' tops are the nodes of the next band
        nodes = larger.select("part", F.expr(f"(size + {span - 1}) div {span}").alias("size"), F.col("block").alias("pos"), F.col("top").alias("digest"))
    roots = [band.where(F.col("size") <= span).select("part", F.col("top").alias("digest")) for band in bands]
    return bands, reduce(DataFrame.unionByName, roots)


def descend(bands: Sequence[DataFrame], upper: DataFrame, fanout: int) -> DataFrame:
    """The leaves' blocks with subroot and ``beyond``, the path from the block's top on. upper: (part, subroot, beyond) of each part's last digest."""
    span = fanout ** _levels(fanout)
    upper = upper.select(F.col("part").alias("_part"), "subroot", "beyond")
    above = None
    for band in reversed(bands):  # the last block of a part takes what is above the part, any other what is above its block
        rows = band.where(F.col("size") <= span).join(upper, F.col("part").eqNullSafe(F.col("_part"))).drop("_part")
        if above is not None:
            nodes = above.select("part", "subroot", F.explode("members").alias("m"), "preimages", "beyond", "block")
            nodes = nodes.select(F.col("part").alias("_part"), F.col("m.pos").alias("_block"), "subroot", F.concat(_own(fanout), "beyond").alias("beyond"))
            low = band.where(F.col("size") > span).join(nodes, F.col("part").eqNullSafe(F.col("_part")) & (F.col("block") == F.col("_block")))
            rows = rows.unionByName(low.drop("_part", "_block"))
        above = rows
    return above


def siblings(path: Column) -> Column:
    """What each preimage holds besides the own digest, level by level."""
    return F.transform(path, lambda x: F.concat(x["preimage"].substr(F.lit(1), x["slot"] * 64), x["preimage"].substr(x["slot"] * 64 + 65, F.length(x["preimage"]))))


def folded(digest: Column, path: Column) -> Column:
    """The root to which ``digest`` leads along ``path``: spliced into each preimage, hashed, and on."""
    return F.aggregate(path, digest, lambda d, x: F.sha2(F.concat(x["preimage"].substr(F.lit(1), x["slot"] * 64), d, x["preimage"].substr(x["slot"] * 64 + 65, F.length(x["preimage"]))), 256))


def manifest(rows: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", fanout: int = 2, replaced: dict[str, Column] | None = None) -> DataFrame:
    """id, group, pos (in its group), leaf, subroot, root, siblings (level by level, an empty string where there is none) and path (preimage, slot).

    ``replaced`` gives fields that another copy of the data holds otherwise; new_leaf, folded_root and verified say where they lead.
    """
    if fanout < 2 or fanout > SPAN:
        raise ValueError(f"fanout must be 2 to {SPAN}")
    changed = [(replaced or {}).get(c, F.col(c)) for c in fields]
    leaves = rows.select(F.col(group_col).cast("string").alias("part"), F.col(id_col).alias("id"), leaf_of([F.col(c) for c in fields]).alias("digest"), (leaf_of(changed) if replaced else F.lit(None).cast("string")).alias("new"))
    bands, subroots = ascend(shared_table(leaves, "digests"), ["id", "digest"], fanout, "leaves")  # sampled for ranges, so without texts
    subroots = shared_table(subroots, "subroots")  # a row a group
    groups, tops = ascend(subroots.select(F.lit(None).cast("string").alias("part"), F.col("part").alias("group"), "digest"), ["group"], fanout, "groups")
    top = tops.first()
    none = F.expr("cast(array() as array<struct<preimage: string, slot: int>>)")
    uppers = descend(groups, rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("part"), F.lit(None).cast("string").alias("subroot"), none.alias("beyond")), fanout)
    uppers = uppers.select(F.explode("members").alias("m"), "preimages", "beyond", "block").select(F.col("m.group").alias("part"), F.col("m.digest").alias("subroot"), F.concat(_own(fanout), "beyond").alias("beyond"))
    blocks = descend(bands, uppers, fanout)
    found = blocks.select(F.col("part").alias("group"), "subroot", F.lit(top.digest if top else None).alias("root"), "beyond", "preimages", "block", F.explode("members").alias("m"))
    found = found.select(F.col("m.id").alias("id"), "group", F.col("m.pos").alias("pos"), F.col("m.digest").alias("leaf"), F.coalesce("m.new", "m.digest").alias("new_leaf"), "subroot", "root", F.concat(_own(fanout), "beyond").alias("path"))
    found = found.withColumn("siblings", siblings(F.col("path"))).withColumn("folded_root", folded(F.col("new_leaf"), F.col("path")))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
