"""Sharding by balanced label propagation (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import HOT_PARTS, Scratch, checkpoint, n_bytes, partitions

#: Copies of one text fall into at most so many cells; a cell moves as one.
CELLS = 256
#: About so many rows are numbered by one task.
ROWS_PER_BUCKET = 50_000
#: Columns that ``place`` adds.
PLACED = ("size", "text_crc32", "law", "shard", "slot", "cut")


def _numbered(df: DataFrame, by: list[str], order: list[str], n_buckets: int, name: str) -> DataFrame:
    """Number rows from 0 within ``by`` without gathering any group in one task.

    Rows are dealt to hash buckets; bucket counts give each bucket's first number, and
    only the small table of counts is windowed over a whole group.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(name), *order), F.lit(n_buckets)).cast("int"))
    counts = df.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*[F.col(c) for c in by]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_first"))
    inner = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return (
        df.withColumn("_at", F.row_number().over(inner) - 1)
        .join(firsts, [*by, "_bucket"])
        .withColumn(name, (F.col("_first") + F.col("_at")).cast("long"))
        .drop("_bucket", "_first", "_at", "_n")
    )


def _pick(values: list[int], at: Column) -> Column:
    """values[at] for a short list of literals."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (at + 1).cast("int"))


def _move(nodes: DataFrame, room: list[int], n_shards: int, n_buckets: int, turn: int) -> DataFrame:
    """One round: each group asks for the shard with room that holds most of it; quotas admit what fits.

    A shard's room is dealt to
    hash buckets of the groups in proportion to what they ask, so no task sees all who ask for a shard.
    """
    mass = nodes.groupBy("grp", "shard").agg(F.sum("w").alias("mass")).withColumn("rank", F.struct("mass", F.xxhash64("grp", "shard")))
    # A shard with less room than the group's largest cell would hold up the group's moves.
    most = nodes.groupBy("grp").agg(F.max("w").alias("most"))
    roomy = mass.join(most, "grp").where(_pick(room, F.col("shard")) >= F.col("most")).drop("most")
    goal = roomy.groupBy("grp").agg(F.max(F.struct("rank", F.col("shard").alias("to"))).alias("best")).select("grp", F.col("best.to").alias("to"), F.col("best.rank").alias("held"))
    here = mass.join(goal, "grp").where("held > rank").select("grp", "shard", "to")
    whole = nodes.groupBy("grp").agg(F.sum("w").alias("whole"))
    # Cells never leave for a shard that holds less of the group than their own does.
    asks = nodes.join(here, ["grp", "shard"]).join(whole, "grp")
    asks = asks.withColumn("_b", F.pmod(F.xxhash64("grp", F.lit(turn)), F.lit(n_buckets)).cast("int")).select("grp", "salt", "w", "to", "_b", "whole")
    wanted = asks.groupBy("to", "_b").agg(F.sum("w").alias("want"))
    share = wanted.withColumn("all_want", F.sum("want").over(Window.partitionBy("to")))
    quota = F.least(F.col("want"), F.floor(_pick(room, F.col("to")) * (F.col("want") / F.col("all_want"))).cast("long"))
    share = share.select("to", "_b", F.when(F.col("all_want") <= _pick(room, F.col("to")), F.col("want")).otherwise(quota).alias("quota"))
    w = Window.partitionBy("to", "_b").orderBy("whole", "grp", "salt").rowsBetween(Window.unboundedPreceding, 0)
    admitted = asks.withColumn("filled", F.sum("w").over(w)).join(share, ["to", "_b"]).where("filled <= quota").select("grp", "salt", F.col("to").alias("moved"))
    return nodes.join(admitted, ["grp", "salt"], "left").select("grp", "salt", "w", F.coalesce("moved", "shard").alias("shard"))


def shard(docs: DataFrame, *, n_shards: int = 24, rounds: int = 6, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """Put documents into shards whose row counts are at most one apart, keeping equal texts together.

    Returns ``key``, size (bytes + 8), text_crc32, law ('rows'), shard, slot (from 0 without gaps),
    grown_shard (null: this law moves rows freely when shards are added) and cut (the document is
    apart from the shard that holds most copies of its text).

    Documents with equal texts are linked through their text. Copies start dealt evenly; in each round
    every group of copies asks to gather in the shard that holds most of it, quotas admit moves only
    where there is room, and unlinked documents fill what is left, which evens the counts exactly. A
    group larger than a shard fills shards one after another.

    * Null and empty texts are texts like any other, each a group of its own (null takes no bytes).
    * Rows that repeat key and text are copies too and get slots of their own.
    * Fewer rows than shards leave some shards empty; an empty table gives an empty result.
    * Columns other than key and text are ignored. ``row`` names a column of distinct longs that is returned too, by
      which a caller can join the places back to whole rows.

    Texts are read once; after that only (key, size, checksum, 16-byte digest, row number) move.
    Iterations touch only groups of two or more, as cells of copies, and are checkpointed.
    """
    spark = docs.sparkSession
    body = F.col(text)
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (n_bytes(body) + 8).alias("size"),
        F.crc32(F.coalesce(body.cast("binary"), F.lit(b""))).cast("long").alias("text_crc32"),
        F.when(body.isNull(), F.lit(b"null")).otherwise(F.unhex(F.md5(body.cast("binary")))).alias("grp"),
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
    )
    slim = checkpoint(slim.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(CELLS)).cast("int")))
    nodes = slim.groupBy("grp", "salt").agg(F.count(F.lit(1)).alias("w"))
    nodes = checkpoint(nodes.withColumn("whole", F.sum("w").over(Window.partitionBy("grp"))))
    total, linked_rows, linked_cells = nodes.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("whole") > 1, F.col("w"))), F.lit(0)), F.count(F.when(F.col("whole") > 1, 1))).first()
    n_buckets = max(4, -(-total // (n_shards * ROWS_PER_BUCKET)))
    at_once = partitions(spark)  # tasks that number rows side by side
    seats = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]

    # Linked cells start round robin; a cell that finds no seat is broken up with the unlinked rows.
    linked = _numbered(nodes.where("whole > 1").select("grp", "salt", "w"), [], ["grp", "salt"], max(at_once, -(-linked_cells // ROWS_PER_BUCKET)), "_k")
    linked = linked.select("grp", "salt", "w", F.pmod("_k", F.lit(n_shards)).cast("int").alias("shard"))
    w = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    linked = checkpoint(linked)
    loads = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.sum("w").alias("n")).collect()}  # a row a shard
    if any(loads.get(s, 0) > seats[s] for s in range(n_shards)):
        b = F.pmod(F.xxhash64("grp", "salt"), F.lit(n_buckets)).cast("int")
        sums = linked.groupBy("shard", b.alias("_b")).agg(F.sum("w").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        inner = Window.partitionBy("shard", "_b").orderBy("w", "grp", "salt").rowsBetween(Window.unboundedPreceding, 0)
        seated = linked.withColumn("_b", b).withColumn("_in", F.sum("w").over(inner)).join(sums, ["shard", "_b"])
        linked = checkpoint(seated.where(F.col("_before") + F.col("_in") <= _pick(seats, F.col("shard"))).select("grp", "salt", "w", "shard"))
    before = None
    for turn in range(rounds):
        loads = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.sum("w").alias("n")).collect()}
        room = [seats[s] - loads.get(s, 0) for s in range(n_shards)]
        if loads == before or not any(loads.values()):
            break
        before = loads
        linked = checkpoint(_move(linked, room, n_shards, n_buckets, turn))

    # Rows without a cell's shard take the free seats in order; cells and seats match exactly.
    loads = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.sum("w").alias("n")).collect()}
    room = [seats[s] - loads.get(s, 0) for s in range(n_shards)]
    placed = slim.join(linked.select("grp", "salt", F.col("shard").cast("int").alias("shard")), ["grp", "salt"], "left")
    placed = checkpoint(placed)
    free = _numbered(placed.where("shard is null").drop("shard"), [], ["row"], max(at_once, -(-sum(room) // ROWS_PER_BUCKET)), "_k")
    ends, at = [], 0
    for r in room:
        ends.append(at := at + r)
    seat = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("_k"))).cast("int")
    cols = ["doc_id", "size", "text_crc32", "grp", "row", "shard"]
    placed = placed.where("shard is not null").select(*cols).unionByName(free.withColumn("shard", seat).select(*cols))
    placed = checkpoint(placed)
    mass = placed.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("mass"))
    home = mass.groupBy("grp").agg(F.max(F.struct("mass", (-F.col("shard")).alias("less"))).alias("top")).select("grp", (-F.col("top.less")).alias("home"))
    cells = checkpoint(mass.join(home, "grp").select("grp", "shard", "mass", (F.col("shard") != F.col("home")).alias("cut")))
    # Cells of more than a thousandth of all rows are below a thousand: they are sent out, the others meet in a join.
    large = F.col("mass") * HOT_PARTS > total
    hot, cold = cells.where(large).drop("mass"), cells.where(~large & F.col("cut")).drop("mass")
    rest = placed.join(F.broadcast(hot.select("grp", "shard")), ["grp", "shard"], "left_anti").join(cold, ["grp", "shard"], "left")
    marked = placed.join(F.broadcast(hot), ["grp", "shard"]).unionByName(rest)
    out = _numbered(marked, ["shard"], ["doc_id", "row"], max(n_buckets, -(-at_once // n_shards)), "slot")
    return out.select(F.col("doc_id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.coalesce("cut", F.lit(False)).alias("cut"), *([F.col("row").alias(row)] if row else []))


def place(docs: DataFrame, *, n_shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, unchanged, with their size, text_crc32, law, shard, slot and cut.

    Columns of the input named as the added ones are replaced. Nulls, empty texts, repeated rows and empty tables as in
    ``shard``: every row is returned once. Rows are numbered in a written table, then meet their places by that number.
    """
    rows = Scratch(docs.sparkSession).write(docs.drop(*PLACED, "shard_row").withColumn("shard_row", F.monotonically_increasing_id()), "numbered")
    places = checkpoint(shard(rows, n_shards=n_shards, key=key, text=text, row="shard_row").select("shard_row", *PLACED))
    return rows.join(places, "shard_row").drop("shard_row")
