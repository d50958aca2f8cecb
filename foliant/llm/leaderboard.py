"""A leaderboard's change feed: arrival days are replayed through a stateful stream, and each nation's boards are diffed."""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from foliant.llm.common import checkpoint_dir, delete

# The first day, days that nulls are dealt to, days of all batches, how late a line may be, and a board's length.
FIRST_DAY, NULL_DAYS, SPAN, LATE_DAYS, BOARD = 19723, 150, 180, 15, 10
BATCHES = 8
#: Items of a shard: a group of the first stateful step keeps the revenues of so many on average.
SHARD_ITEMS = 1 << 16
#: A shard's revenues are packed into so many entries of its map state, each an array of items and one of cents.
CHUNKS = 16
#: Positive revenues a shard keeps in order beside its board, so that items that leave are replaced without a sort.
RESERVE = 64
#: Rows that a task sums at once before they are shuffled.
SUM_ROWS = 500_000

LINES = "line_batch int, day int, shipped int, nation_id int, item_id long, cents long"
SUMS = "nation_id int, shard int, day int, item_id long, cents long"
SHARD_ROWS = "nation_id int, day int, item_id long, revenue long, on_board boolean"
CHANGES = "nation_id int, arrival_day long, item_id long, change string, old_rank int, new_rank int, revenue long"


# Lines and their batches


def fingerprint(*columns: str) -> Column:
    """CRC-32 of the columns, comma-joined; null is empty."""
    return F.crc32(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))


def nations(vendors: DataFrame) -> DataFrame:
    """(vendor_id, nation_id), a vendor once; those without a nation are left out."""
    return vendors.where("vendor_id is not null and nation_id is not null").groupBy("vendor_id").agg(F.min("nation_id").cast("int").alias("nation_id"))


def prices(items: DataFrame) -> DataFrame:
    """(item_id, each, known), an item once; each: cents, null without a price."""
    return items.where("item_id is not null").groupBy("item_id").agg(F.max(F.floor(100 * F.col("price") + 0.5)).cast("long").alias("each"), F.lit(True).alias("known"))


def prepared(lines: DataFrame, price: DataFrame, nation: DataFrame) -> DataFrame:
    """Every line with its batch, arrival day, shipping day, nation, item (null if there is no such item) and cents.

    Both joins are sort-merge joins of narrow rows, never broadcasts: the tables grow with the lines. ``price`` and ``nation`` are tables that
    have been written, so both sides of a join come straight from a shuffle and adaptive execution splits hot vendors and items.
    """
    h = fingerprint("sale_id", "item_id", "vendor_id", "line_no")
    shipped = F.coalesce(F.unix_date(F.col("shipped_at").cast("date")), (F.lit(FIRST_DAY) + h % NULL_DAYS).cast("int"))
    sign = F.when(F.col("flag") == "swapped", -1).otherwise(1)
    rows = lines.select(
        "vendor_id", "item_id", shipped.alias("shipped"), (h % 7 + F.when(h % 5 == 0, 20).otherwise(0)).cast("int").alias("lag"),
        (F.floor(100 * F.col("amount") + 0.5) * sign).cast("long").alias("own"), F.when(F.col("amount").isNull(), F.col("quantity") * sign).cast("long").alias("pieces"),
    )
    rows = rows.join(nation.hint("merge"), "vendor_id", "left").drop("vendor_id").join(price.hint("merge"), "item_id", "left")
    day = F.col("shipped") + F.col("lag")
    batch = F.greatest(F.lit(1), F.least(F.lit(BATCHES), 1 + F.floor((day - FIRST_DAY) * BATCHES / SPAN))).cast("int")
    cents = F.coalesce("own", F.col("pieces") * F.col("each"), F.lit(0))
    return rows.select(batch.alias("line_batch"), day.alias("day"), "shipped", "nation_id", F.when(F.col("known"), F.col("item_id")).alias("item_id"), cents.cast("long").alias("cents"))


def summed(rows: DataFrame, shards: int) -> DataFrame:
    """Cents by nation, shard, day and item within each task, before the shuffle: what a hot nation or item sends on is
    bounded by its days and items, however many lines it has."""
    keys = ["nation_id", "shard", "day", "item_id"]

    def total(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.Table.from_batches(parts).group_by(keys).aggregate([("cents", "sum")]).rename_columns([*keys, "cents"])
        yield from out.combine_chunks().to_batches(max_chunksize=100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            parts.append(batch)
            n += batch.num_rows
            if n >= SUM_ROWS:
                yield from total(parts)
                parts, n = [], 0
        if parts:
            yield from total(parts)

    shard = F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int")
    return rows.select("nation_id", shard.alias("shard"), "day", "item_id", "cents").mapInArrow(run, SUMS)


# State


class Ranking:
    """Keys (-revenue, item) of positive revenues in order, kept by bisection."""

    def __init__(self, keys: list[tuple[int, int]]):
        self.keys = sorted(keys)

    def remove(self, key: tuple[int, int]) -> bool:
        at = bisect_left(self.keys, key)
        if at < len(self.keys) and self.keys[at] == key:
            del self.keys[at]
            return True
        return False

    def put(self, key: tuple[int, int]) -> None:
        insort(self.keys, key)

    def board(self, most: int = BOARD) -> dict[int, int]:
        """item to revenue of the first keys."""
        return {item: -revenue for revenue, item in self.keys[:most]}


class ShardLedger:
    """Revenues of one nation's items of one shard as arrays, with the best of them in order.

    ``ranking`` holds every positive revenue that is not below ``floor``, the worst key that it held when it was last filled; all
    others are worse. So the board is exact as long as ten are left or nothing lies below the floor; else it is filled again.
    """

    def __init__(self, items: np.ndarray, revenue: np.ndarray, new_items: np.ndarray):
        self.items = np.union1d(items, new_items)
        self.revenue = np.zeros(len(self.items), np.int64)
        self.revenue[np.searchsorted(self.items, items)] = revenue
        self.fill()

    def fill(self) -> None:
        places = np.flatnonzero(self.revenue > 0)
        self.all = len(places) <= RESERVE
        if not self.all:
            least = np.partition(self.revenue[places], len(places) - RESERVE)[len(places) - RESERVE]
            above = places[self.revenue[places] > least]
            ties = places[self.revenue[places] == least][: RESERVE - len(above)]  # items ascend
            places = np.concatenate((above, ties))
        self.ranking = Ranking(list(zip((-self.revenue[places]).tolist(), self.items[places].tolist(), strict=True)))
        self.floor = (0, 0) if self.all else self.ranking.keys[-1]
        self.ranked = np.zeros(len(self.items), bool)
        self.ranked[places] = True

    def add(self, items: np.ndarray, cents: np.ndarray) -> None:
        """One day's sums, an item once."""
        at = np.searchsorted(self.items, items)
        before = self.revenue[at]
        after = before + cents
        self.revenue[at] = after
        for k in np.flatnonzero((before != after) & (self.ranked[at] | ((after > 0) & (-after <= self.floor[0])))).tolist():
            item, place = int(items[k]), at[k]
            if self.ranked[place]:
                self.ranking.remove((-int(before[k]), item))
                self.ranked[place] = False
            key = (-int(after[k]), item)
            if after[k] > 0 and (self.all or key <= self.floor):
                self.ranking.put(key)
                self.ranked[place] = True
        if len(self.ranking.keys) < BOARD and not self.all:
            self.fill()

    def of(self, item: int) -> int:
        return int(self.revenue[np.searchsorted(self.items, item)])


def _chunk(items: np.ndarray) -> np.ndarray:
    return (items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)).astype(np.int64) % CHUNKS


def _gathered(rows: Iterator[pd.DataFrame], columns: list[str]) -> list[np.ndarray]:
    parts = [r[columns] for r in rows]
    return [np.concatenate([p[c].to_numpy() for p in parts]) for c in columns]


def board_diff(day: int, before: list[int], now: list[int], revenue: Callable[[int], int]) -> Iterator[tuple]:
    """(day, item, change, old rank, new rank, revenue) of items whose rank differs between two boards."""
    old, new = {i: k + 1 for k, i in enumerate(before)}, {i: k + 1 for k, i in enumerate(now)}
    for i in dict.fromkeys([*before, *now]):
        if old.get(i) != new.get(i):
            yield day, i, "enter" if i not in old else "exit" if i not in new else "move", old.get(i), new.get(i), revenue(i)


def _changes(nation: int, rows: list[tuple]) -> Iterator[pd.DataFrame]:
    if rows:
        days, items, change, old_rank, new_rank, cents = zip(*rows, strict=True)
        yield pd.DataFrame({
            "nation_id": np.int32(nation), "arrival_day": np.array(days, np.int64), "item_id": np.array(items, np.int64), "change": change,
            "old_rank": pd.array(old_rank, "Int32"), "new_rank": pd.array(new_rank, "Int32"), "revenue": np.array(cents, np.int64),
        })


class _Ledgers(StatefulProcessor):
    """Revenues in a map state, a chunk of items an entry, and the replay of a batch's days over them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revenues = handle.getMapState("revenues", "chunk int", "packed binary")

    def replay(self, rows: Iterator[pd.DataFrame]) -> tuple[ShardLedger, Iterator[int]]:
        """The ledger as it was before the batch, and an iterator that adds one day at each step and gives its number; then state is saved."""
        day, item, cents = (x.astype(np.int64) for x in _gathered(rows, ["day", "item_id", "cents"]))
        order = np.lexsort((item, day))
        day, item, cents = day[order], item[order], cents[order]
        first = np.flatnonzero(np.concatenate(([True], (day[1:] != day[:-1]) | (item[1:] != item[:-1]))))
        day, item, cents = day[first], item[first], np.add.reduceat(cents, first)
        packed = [np.frombuffer(bytes(v[0]), np.int64).reshape(2, -1) for _, v in self.revenues.iterator()]
        known = np.concatenate(packed, axis=1) if packed else np.zeros((2, 0), np.int64)
        ledger = ShardLedger(known[0], known[1], item)

        def days() -> Iterator[int]:
            ends = np.concatenate((np.flatnonzero(day[1:] != day[:-1]) + 1, [len(day)])).tolist()
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                ledger.add(item[a:b], cents[a:b])
                yield int(day[a])
            chunk = _chunk(ledger.items)
            for c in np.unique(_chunk(item)).tolist():
                own = chunk == c
                self.revenues.updateValue((int(c),), (np.stack((ledger.items[own], ledger.revenue[own])).tobytes(),))

        return ledger, days()

    def close(self) -> None:
        pass


class WholeBoards(_Ledgers):
    """Per nation, where its items fit one group: days are replayed over its revenues, and each day's board is diffed with the saved one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.board = handle.getValueState("board", "items binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ledger, days = self.replay(rows)
        saved = self.board.get()
        board, out = np.frombuffer(bytes(saved[0]), np.int64).tolist() if saved is not None else [], []
        for day in days:
            now = list(ledger.ranking.board())
            out += board_diff(day, board, now, ledger.of)
            board = now
        self.board.update((np.array(board, np.int64).tobytes(),))
        yield from _changes(key[0], out)


class ShardBoards(_Ledgers):
    """Per nation and shard of its items: reports what changes on the shard's board, whose ten hold those of the nation's ten that are of the shard.

    A row is an item of the board whose revenue is new, or one that has left it with what it has afterwards.
    """

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ledger, days = self.replay(rows)
        board, out = ledger.ranking.board(), []
        for d in days:
            now = ledger.ranking.board()
            out += [(d, i, r, True) for i, r in now.items() if board.get(i) != r]
            out += [(d, i, ledger.of(i), False) for i in board if i not in now]
            board = now
        if out:
            numbers, items, revenue, there = zip(*out, strict=True)
            yield pd.DataFrame({"nation_id": np.int32(key[0]), "day": np.array(numbers, np.int32), "item_id": items, "revenue": revenue, "on_board": there})


class NationBoards(StatefulProcessor):
    """Per nation: revenues of all items on its shards' boards, and the nation's own board, saved. Each day's board is diffed with the one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revenues = handle.getMapState("revenues", "item_id long", "revenue long")
        self.board = handle.getValueState("board", "items binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        day, item, revenue, there = _gathered(rows, ["day", "item_id", "revenue", "on_board"])
        order = np.argsort(day, kind="stable")
        saved = self.board.get()
        board = np.frombuffer(bytes(saved[0]), np.int64).tolist() if saved is not None else []
        held = {int(k[0]): int(v[0]) for k, v in self.revenues.iterator()}
        before, out, at = dict(held), [], 0
        ranking = Ranking([(-r, i) for i, r in held.items()])
        while at < len(order):
            today, gone = day[order[at]], {}
            while at < len(order) and day[order[at]] == today:
                k = order[at]
                i, r = int(item[k]), int(revenue[k])
                if i in held:
                    ranking.remove((-held.pop(i), i))
                if there[k]:
                    held[i] = r
                    ranking.put((-r, i))
                else:
                    gone[i] = r
                at += 1
            now = list(ranking.board())
            out += board_diff(int(today), board, now, lambda i, gone=gone: held[i] if i in held else gone[i])
            board = now
        for i in before.keys() - held.keys():
            self.revenues.removeKey((i,))
        for i, r in held.items():
            if before.get(i) != r:
                self.revenues.updateValue((i,), (r,))
        self.board.update((np.array(board, np.int64).tobytes(),))
        yield from _changes(key[0], out)

    def close(self) -> None:
        pass


def board_changes(sums: DataFrame, shards: int) -> DataFrame:
    """The stateful part: (nation_id, shard, day, item_id, cents) of one batch of arrival days to changes of nations' boards."""
    if shards == 1:
        return sums.groupBy("nation_id").transformWithStateInPandas(WholeBoards(), CHANGES, "Append", "None")
    own = sums.groupBy("nation_id", "shard").transformWithStateInPandas(ShardBoards(), SHARD_ROWS, "Append", "None")
    return own.groupBy("nation_id").transformWithStateInPandas(NationBoards(), CHANGES, "Append", "None")


# The stream


#: Stateful functions need this store. A start has one batch, so tasks close their stores with it; open ones would pile up on
#: executors, start after start, until maintenance comes round.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Streams that start here take the settings; those that run beside them do not."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _move(spark: SparkSession, source: str, target: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(target).getParent())
    return fs.exists(path(source)) and fs.rename(path(source), path(target))


def changes(lines: DataFrame, items: DataFrame, vendors: DataFrame, *, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Every change of rank on the boards of ten best selling items of each nation, after each arrival day.

    The lines are cut into eight batches of arrival days in the shared folder. A batch's files are moved into the folder that
    a stream reads, and the stream is started anew on one checkpoint: state and what has been read go on from there.
    Tasks sum their lines by nation, day and item. A nation whose items fit one group is one; with more than ``shard_items`` items, groups of
    so many each keep revenues and report changes of their own ten best, and each nation merges those: no task has more than a shard's
    items, or ten rows a shard and day.

    Returns nation_id, arrival_day, item_id, batch, change (enter, exit, move), old_rank, new_rank, revenue (cents, afterwards).

    * A line without a date is dealt to one of 150 days; one without an amount counts its quantity at the item's price, without
      that 0; swapped ones are taken off. Lines of unknown vendors or items, or of vendors without a nation, count only for
      how far the batches have come; lines more than 15 days behind the earlier batches are dropped. Days before the first count to batch 1.
    * Repeated lines count again. Of vendors and items that repeat an id the smallest nation and the highest price hold.
    * Equal revenues rank by the smaller item; revenues of 0 and below are on no board. Empty tables give no rows.
    * Other columns are ignored, whatever their names. The result is read from a new folder under ``spark.checkpoint.dir`` that stays.
    """
    spark = lines.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/foliant-board-{uuid.uuid4().hex}"
    found = []
    for name, table in (("prices", prices(items)), ("nations", nations(vendors))):
        table.write.parquet(f"{root}/{name}")
        found.append(spark.read.schema(table.schema).parquet(f"{root}/{name}"))
    prepared(lines, *found).write.partitionBy("line_batch").option("compression", "zstd").parquet(f"{root}/lines")
    written = spark.read.schema(LINES).parquet(f"{root}/lines")
    latest = {r["line_batch"]: r["latest"] for r in written.groupBy("line_batch").agg(F.max("shipped").alias("latest")).collect()}  # eight rows
    shards = max(1, -(-found[0].count() // shard_items))
    with stateful(spark):
        for b in range(1, BATCHES + 1):
            _move(spark, f"{root}/lines/line_batch={b}", f"{root}/feed/line_batch={b}")
            rows = spark.readStream.schema(LINES).parquet(f"{root}/feed").where("nation_id is not null and item_id is not null")
            if earlier := [latest[k] for k in latest if k < b]:
                rows = rows.where(F.col("shipped") + LATE_DAYS >= max(earlier))
            out = board_changes(summed(rows, shards), shards).withColumn("batch", F.lit(b))
            query = out.writeStream.format("parquet").option("path", f"{root}/changes").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    for gone in ("prices", "nations", "lines", "feed", "checkpoint"):
        delete(spark, f"{root}/{gone}")
    schema = CHANGES.replace("change string", "batch int, change string")
    return spark.read.schema(CHANGES + ", batch int").parquet(f"{root}/changes").select(*[c.split()[0] for c in schema.split(", ")])
