"""Applying a stream of inserts, updates and deletes, newest first.

The feed of a file is a linked list of blocks. Its order is found by pointer doubling: each round
joins the blocks reached so far with pointers that jump twice as far, so a chain of n blocks takes
log2(n) rounds and no chain is walked in one task. Then the blocks are processed backwards, from
the newest, in batches of doubling length: keys that a newer batch resolved are taken away by an
anti-join, of the others the first image seen is recorded, be it a row or a tombstone; rows of a
base table that no change touched come last.

The changes of a batch are combined for each key before they are shuffled, so a key with a third of
all changes is a row a batch. Then they are laid out by key once, which all anti-joins share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.session import cut, forget, has_rows


def chain_order(links: DataFrame, heads: DataFrame, space: str, at: str, prev: str, head: str, made: list[DataFrame] | None = None) -> DataFrame:
    """``links`` with ``ord``: the blocks of each space's chain, 0 being the newest.

    The result reads checkpoints; they are added to ``made``, to be forgotten when it is no longer read.

    ``links`` has one row for each (space, at) with the ``prev`` it points to; ``heads`` has one start
    for each space. A chain ends at a null, at a position that names no block, or before a block it has
    visited; spaces whose head names no block have no rows. Rows with a null space or position are none.
    """
    known = links.select(F.col(space).alias("s"), F.col(at).alias("a"), F.col(prev).alias("to")).dropna(subset=["s", "a"])
    # a chain is no longer than its space has blocks, which ends the rounds of rings
    most = known.groupBy("s").agg(F.count(F.lit(1)).alias("most"))
    first = heads.select(F.col(space).alias("s"), F.col(head).alias("a")).dropna().distinct().join(most, "s")
    top = cut(first.select("s", F.lit(None).cast("bigint").alias("from"), "a", F.lit(0).cast("bigint").alias("ord"), "most"))
    reached = [top]
    jump = known.dropna(subset=["to"]).select("s", F.col("a").alias("from"), F.col("to").alias("a"), F.lit(1).cast("bigint").alias("ord"), F.lit(None).cast("bigint").alias("most"))
    jump = cut(jump)
    made = [] if made is None else made
    made += [top, jump]
    while True:
        left = jump
        for part in reached:
            left = left.unionByName(part)
        l, r = left.alias("l"), jump.alias("r")
        met = l.join(r, [F.col("l.s") == F.col("r.s"), F.col("l.a") == F.col("r.from")]).select("l.s", "l.from", "r.a", (F.col("l.ord") + F.col("r.ord")).alias("ord"), "l.most")
        both = cut(met.where("most is null or ord < most"))
        made.append(both)
        top = both.where("most is not null")
        if not has_rows(top):
            break
        reached.append(top)
        jump = both.where("most is null")
    order = reached[0]
    for part in reached[1:]:
        order = order.unionByName(part)
    order = order.groupBy(F.col("s").alias("_s"), F.col("a").alias("_a")).agg(F.min("ord").alias("ord"))
    return links.join(order, [F.col(space) == F.col("_s"), F.col(at) == F.col("_a")]).drop("_s", "_a")


def resolve_newest_first(changes: DataFrame, key: list[str], order: Column, image: list[str], is_delete: Column, within: Column, base: DataFrame | None = None) -> DataFrame:
    """The live rows after all changes: key and image columns of the deciding change of each key.

    ``order`` is 0 for the newest batch position and grows with age; ``within`` decides inside one
    position, the greatest winning; remaining ties (repeated changes) fall to the greatest image.
    ``base`` holds rows older than all changes; of these the untouched ones come out as well. Keys
    with a null are none, in the changes as in the base.
    """
    prepared = changes.select(*key, F.struct(*image).alias("_image"), is_delete.alias("_dead"), order.cast("bigint").alias("_ord"), within.alias("_in")).dropna(subset=[*key, "_ord"])
    # batch 0 is the newest position, batch 1 the next two, batch 2 the next four
    prepared = prepared.withColumn("_batch", F.floor(F.log2(F.col("_ord") + 1)).cast("int"))
    images = prepared.groupBy(*key, "_batch").agg(F.max(F.struct((-F.col("_ord")).alias("o"), "_in", "_dead", "_image")).alias("x")).select(*key, "_batch", "x._dead", "x._image")
    parts = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    images = cut(images.repartition(parts, *key).sortWithinPartitions(*key), keep_layout=True)
    oldest = images.agg(F.max("_batch")).first()[0]
    live = []
    for batch in range(0 if oldest is None else oldest + 1):
        seen = images.where(F.col("_batch") == batch)
        if batch:
            resolved = images.where(F.col("_batch") < batch).select(*key)
            seen = seen.join(resolved.hint("merge"), key, "left_anti")
        live.append(seen.where(~F.col("_dead")).select(*key, "_image.*"))
    if base is not None:
        live.append(base.select(*key, *image).dropna(subset=key).join(images.select(*key), key, "left_anti"))
    if not live:
        return images.select(*key, "_image.*")
    out = live[0]
    for more in live[1:]:
        out = out.unionByName(more)
    return out


def current_entries(xref_blocks: DataFrame, pdf_files: DataFrame) -> DataFrame:
    """The current cross-reference: path, obj, gen, byte_pos, stream_id, idx (-1 for null) of every live object.

    Per path and obj the newest block of the chain from startxref decides, within a block its last
    entry; entries of null kind or null obj change nothing; free ones delete. A block scanned twice at
    one position counts once: the row recorded last, then the greatest block_id. A file with several
    startxref takes the one received last, then the greatest. Files without a startxref, or whose
    startxref names no block, have no entries.
    """
    tie = F.struct(F.coalesce(F.col("recorded_at").cast("string"), F.lit("")), "block_id")
    headers = xref_blocks.dropna(subset=["path", "start_pos"]).groupBy("path", "start_pos").agg(F.max_by(F.struct("prev", "block_id"), tie).alias("h")).select("path", "start_pos", "h.prev", "h.block_id")
    headers = cut(headers)
    heads = pdf_files.dropna(subset=["path", "startxref"]).groupBy("path").agg(F.max_by("startxref", F.struct(F.coalesce(F.col("received_at").cast("string"), F.lit("")), "startxref")).alias("startxref"))
    made = [headers]
    chosen = chain_order(headers, heads, "path", "start_pos", "prev", "startxref", made).select("path", "block_id", "ord")
    entries = (
        xref_blocks.select("path", "block_id", "xrefs")
        .join(chosen, ["path", "block_id"])
        .select("path", "ord", F.posexplode("xrefs").alias("pos", "x"))
        .where(F.col("x.kind").isin("plain", "compressed", "free") & F.col("x.obj").isNotNull())
        .select("path", F.col("x.obj").alias("obj"), "ord", "pos", (F.col("x.kind") == "free").alias("dead"), *[F.coalesce(F.col(f"x.{c}"), F.lit(-1)).alias(c) for c in ("gen", "byte_pos", "stream_id", "idx")])
    )
    live = resolve_newest_first(entries, ["path", "obj"], F.col("ord"), ["gen", "byte_pos", "stream_id", "idx"], F.col("dead"), F.col("pos"))
    forget(*made)  # the changes are laid out by now
    return live
