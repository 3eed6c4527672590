"""Resharding by minimum-cost flow: the fewest bytes move from old shards to new capacities."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, new_folder, stored

#: Shards before and after.
OLD_SHARDS, SHARDS = 16, 24
#: A row's number has its file's number above these binary digits, and a block's rows differ in these lowest ones.
FILE_BITS, BLOCK_BITS = 33, 16
#: Documents are placed in classes from large to small: above these shares of their mean size.
CLASSES = (1, 1 / 4, 0)


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Flow from each supply to each capacity at least total cost, by successive shortest paths.

    ``cost(i, j)`` is the price of a byte, not negative. The sums must agree.
    """
    m, n = len(supply), len(capacity)
    if sum(supply) != sum(capacity):
        raise ValueError("supplies and capacities differ in sum")
    flow, left, room = [[0] * n for _ in range(m)], list(supply), list(capacity)
    price = [[cost(i, j) for j in range(n)] for i in range(m)]
    potential = [0] * (m + n)
    while any(left):
        # Dijkstra on reduced costs from all supplies that have something left
        far, back = [float("inf")] * (m + n), [-1] * (m + n)
        heap = []
        for i in range(m):
            if left[i]:
                far[i] = 0 - potential[i] + max(potential)
                heap.append((far[i], i))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            edges = ((m + j, price[u][j]) for j in range(n)) if u < m else ((i, -price[i][u - m]) for i in range(m) if flow[i][u - m])
            for v, c in edges:
                to = d + c + potential[u] - potential[v]
                if to < far[v] - 1e-9:
                    far[v], back[v] = to, u
                    heapq.heappush(heap, (to, v))
        end = min((m + j for j in range(n) if room[j]), key=lambda v: far[v] + potential[v])
        for v in range(m + n):
            potential[v] += min(far[v], far[end])
        path, v = [end], end
        while back[v] >= 0:
            v = back[v]
            path.append(v)
        path.reverse()
        pairs = list(zip(path, path[1:], strict=False))
        much = min(left[path[0]], room[end - m], *(flow[b][a - m] for a, b in pairs if a >= m))
        for a, b in pairs:
            if a < m:
                flow[a][b - m] += much
            else:
                flow[b][a - m] -= much
        left[path[0]] -= much
        room[end - m] -= much
    return flow


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def stay_or_move(i: int, j: int) -> int:
    """Bytes that stay in their shard cost nothing, others one each."""
    return int(i != j)


@dataclass
class Cuts:
    """Where the old shards are cut for documents of one class: of sizes above ``above`` and at most ``upto``.

    ``runs[i]`` has (last row, new shard) for each run of rows of old shard i, in order of row; what stays is the first.
    """

    above: float
    upto: float
    runs: list[list[tuple[int, int]]]


@dataclass
class Plan:
    """What a flow decided: an expression for each row's new shard, and the first row of each old shard that is rewritten."""

    cuts: list[Cuts]
    first_rewritten: list[int]

    def shard(self, size: Column) -> Column:
        """The new shard of a row of the stored table (columns __old and __row) of the given size."""
        whole = F.lit(None).cast("int")
        for c in self.cuts:
            for i, runs in enumerate(c.runs):
                case = F.lit(runs[-1][1]) if runs else F.lit(None)
                for row, j in reversed(runs[:-1]):
                    case = F.when(F.col("__row") <= row, j).otherwise(case)
                whole = F.when((F.col("__old") == i) & (size > c.above) & (size <= c.upto), case).otherwise(whole)
        return whole.cast("int")

    def stays(self) -> Column:
        """Whether a row is in a file of which every row stays."""
        return F.coalesce(*[F.when(F.col("__old") == i, F.col("__row") < row) for i, row in enumerate(self.first_rewritten)])


ALL = (1 << 63) - 1


def _runs(rows: DataFrame, flow: list[list[int]], last: bool) -> list[list[tuple[int, int]]]:
    """Cuts rows (__old, __row, size) along a flow: a row belongs to the transfer that its last byte falls in, or
    its middle byte in the last class. So what stays leaves room for smaller rows to fill.

    The bytes of blocks of rows tell in which block an edge falls; only these few blocks, of
    2 ** BLOCK_BITS rows at most, are sorted. One row for each edge reaches the driver.
    """
    spark = rows.sparkSession
    targets = [sorted((j for j, much in enumerate(row) if much), key=lambda j: (j != i, j)) for i, row in enumerate(flow)]
    edges = [(i, k, sum(flow[i][j] for j in own[: k + 1])) for i, own in enumerate(targets) for k in range(len(own) - 1)]
    found: dict[tuple[int, int], int] = {}
    if edges:
        rows = rows.withColumn("block", F.shiftright("__row", BLOCK_BITS))
        before = F.sum("bytes").over(Window.partitionBy("__old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        blocks = rows.groupBy("__old", "block").agg(F.sum("size").alias("bytes")).withColumn("before", F.coalesce(before, F.lit(0)))
        wanted = F.broadcast(spark.createDataFrame(edges, "__old int, k int, edge long"))  # old and new shards together at most
        hit = stored(blocks.join(wanted, "__old").filter("before <= edge and edge < before + bytes").select("__old", "block", "before", "k", "edge"), "edges")
        inside = F.sum("size").over(Window.partitionBy("__old", "block").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0))
        near = rows.join(F.broadcast(hit.select("__old", "block", "before").distinct()), ["__old", "block"]).withColumn("end", F.col("before") + inside)
        fits = F.col("end") - F.col("size") / 2 < F.col("edge") if last else F.col("end") <= F.col("edge")
        cut = near.drop("before").join(F.broadcast(hit.select("__old", "block", "k", "edge")), ["__old", "block"]).filter(fits)
        found = {(r["__old"], r["k"]): r["row"] for r in cut.groupBy("__old", "k").agg(F.max("__row").alias("row")).collect()}
        # an edge before the first row of its block
        found |= {(r["__old"], r["k"]): (r["block"] << BLOCK_BITS) - 1 for r in hit.collect() if (r["__old"], r["k"]) not in found}
    return [[*((found.get((i, k), ALL), j) for k, j in enumerate(own[:-1])), *((ALL, j) for j in own[-1:])] for i, own in enumerate(targets)]


def _sums(rows: DataFrame, by: Column, n: int) -> list[int]:
    """Bytes of each of n shards; n rows at most reach the driver."""
    found = {r[0]: r[1] for r in rows.groupBy(by.alias("by")).agg(F.sum("size")).collect()}
    return [int(found.get(k) or 0) for k in range(n)]


def size_of(text: str) -> Column:
    """A document's size: the UTF-8 bytes of its text (null: none) plus 8."""
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 8).cast("long")


def reshard(table: DataFrame, old: int, capacities: list[float] | int, text: str = "text", cost=stay_or_move) -> Plan:
    """Plans the new shard of every row of a stored table (columns __old and __row, as ``write_old`` leaves them).

    ``capacities``: relative sizes of the new shards, or their number for equal ones; an old
    shard's bytes may stay if a new shard has its number. A flow of all bytes decides what
    each old shard gives to each new one; the largest class of documents is cut along it, in
    order of row. A flow of the other bytes then fills what room is left, and so on, so that
    a shard misses its capacity by a few of the smallest documents. Null texts, ties and
    repeated rows are rows like any other; an empty table gives a plan for no rows.
    """
    weights = [1.0] * capacities if isinstance(capacities, int) else capacities
    rows = stored(table.select("__old", "__row", size_of(text).alias("size")), "sizes")
    total, mean = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.avg("size"), F.lit(0.0))).first()
    room, upto, cuts = shares(total, weights), float("inf"), []
    for share in CLASSES:
        rest = rows.filter(F.col("size") <= upto)
        supply, above = _sums(rest, F.col("__old"), old), mean * share
        flow = min_cost_flow(supply, trimmed(room, sum(supply)), cost)
        own = rest.filter(F.col("size") > above)
        cuts.append(Cuts(above, upto, _runs(own, flow, share == CLASSES[-1])))
        room = [r - b for r, b in zip(room, _sums(own, Plan(cuts, []).shard(F.col("size")), len(room)), strict=True)]
        upto = above
    stay = [min((c.runs[i][0][0] if c.runs[i][0][1] == i else -1 for c in cuts if c.runs[i]), default=ALL) for i in range(old)]
    return Plan(cuts, [ALL if row == ALL else (row + 1) >> FILE_BITS << FILE_BITS for row in stay])


def shares(total: int, weights: list[float]) -> list[int]:
    """Whole capacities in proportion to the weights, of the given sum."""
    if len(set(weights)) <= 1:
        return even(total, len(weights))
    edges = [round(total * sum(weights[:k]) / sum(weights)) for k in range(len(weights) + 1)]
    return [b - a for a, b in zip(edges, edges[1:], strict=False)]


def trimmed(room: list[int], total: int) -> list[int]:
    """Room lowered evenly from the top to the given sum, where overfull shards left too much elsewhere."""
    room = [max(r, 0) for r in room]
    over = sum(room) - total
    while over > 0:
        open_shards = [k for k, r in enumerate(room) if r]
        for k, cut in zip(open_shards, even(over, len(open_shards)), strict=True):
            took = min(cut, room[k])
            room[k] -= took
            over -= took
    if over < 0:
        room[0] -= over
    return room


def write_old(docs: DataFrame, old_shard: Column, path: str) -> DataFrame:
    """Writes every row into its old shard's folder under ``path``; returns the table reread, with __old, the shard,
    and __row, the row's number: that of the task, and so of the file, and then the row's in it."""
    marked = docs.withColumns({"__row": F.monotonically_increasing_id(), "__old": old_shard.cast("int")})
    marked.write.partitionBy("__old").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(marked.schema).parquet(path)


def rewrite_affected(table: DataFrame, plan: Plan, path: str, text: str = "text") -> DataFrame:
    """Rewrites the old files of which a row moves, and returns the new shards: the other old files, which are left
    alone, and the new ones, reread. Columns: those of the table, __old, and __shard.

    Nothing is shuffled: a task writes its rows to their shards' folders, a few for each old
    shard, as a flow has few transfers. A row's number tells its file's, so that which files
    stay is a range of numbers, which the scan prunes by.
    """
    moved = table.filter(~plan.stays())
    moved.withColumns({"__was": F.col("__old"), "__shard": plan.shard(size_of(text))}).drop("__old").write.partitionBy("__shard").option("compression", "zstd").parquet(path)
    plain = [f for f in table.schema if f.name != "__old"]
    new = table.sparkSession.read.schema(T.StructType([*plain, T.StructField("__was", T.IntegerType()), T.StructField("__shard", T.IntegerType())])).parquet(path)
    stay = table.filter(plan.stays()).withColumn("__shard", F.col("__old"))
    columns = [*(f.name for f in plain), "__old", "__shard", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index")]
    return stay.select(*columns).unionByName(new.withColumnRenamed("__was", "__old").select(*columns))


def slots(shards: DataFrame) -> DataFrame:
    """Adds ``slot``: the rows of the shard's files before (in order of name), and in its file, so gapless from 0."""
    files = stored(shards.groupBy("__shard", "__file").agg(F.count("*").alias("rows")), "manifest")
    before = F.sum("rows").over(Window.partitionBy("__shard").orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("__file", F.coalesce(before, F.lit(0)).alias("__before"))
    return shards.join(broadcast_if_small(stored(files, "files")), "__file").withColumn("slot", (F.col("__before") + F.col("__index")).cast("long"))


def resharded(docs: DataFrame, old_shard: Column, old: int, capacities: list[float] | int, text: str = "text") -> DataFrame:
    """Writes the old shards to the shared folder, rewrites the affected files by the plan, and describes every
    row of the new shards as reread: doc_id, size, text_crc32, old_shard, shard, slot.

    Every row counts by itself: null and repeated doc_ids, and equal rows, are each written
    once. An empty table gives no rows; other columns of docs are written along, those that
    are named like one of ours with an underscore behind.
    """
    spark = docs.sparkSession
    taken = {"__row", "__old", "__was", "__shard", "_metadata"}
    docs = docs.select(*[F.col(f"`{c}`").alias(c + "_" if c in taken else c) for c in docs.columns])
    table = write_old(docs, old_shard, new_folder(spark, "old-shards"))
    shards = rewrite_affected(table, reshard(table, old, capacities, text), new_folder(spark, "new-shards"), text)
    crc = F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32")
    rows = shards.select("doc_id", size_of(text).alias("size"), crc, "__old", "__shard", "__file", "__index")
    return slots(rows).select("doc_id", "size", "text_crc32", F.col("__old").alias("old_shard"), F.col("__shard").alias("shard"), "slot")
