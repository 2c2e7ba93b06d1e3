"""Resharding by minimum-cost flow.

Old shards hold blocks of rows; the flow network has an arc from every old shard to every new one, free from a shard
to itself and one unit a byte otherwise, and the new shards' capacities. Successive shortest paths give the transfers
that move the fewest bytes. Each old shard's bytes, in block order, are then cut at its transfers' boundaries: what
stays comes first. Only rows beyond the first boundary move, and only shards that gain or lose rows are rewritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from vellum.session import cut, shared_dir

OLD_SHARDS, NEW_SHARDS = 12, 16
PLACED = ["doc_id", "size", "text_crc32", "old_shard", "shard", "slot", "moved"]
#: Rows of a block, about.
BLOCK_ROWS = 500
#: Neighbouring blocks that one task rewrites together, as most of them go to one new shard.
CHUNK_BLOCKS = 20


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from each supply to each capacity at the least cost, by successive shortest (Bellman-Ford) paths."""
    if sum(supply) > sum(capacity):
        raise ValueError("more to place than the capacities hold")
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    far = float("inf")
    while any(left):
        # Distances over the residual network from all sources that have supply left.
        dist = [0 if x else far for x in left] + [far] * m
        via = [-1] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + cost[i][j] < dist[n + j]:
                        dist[n + j], via[n + j], changed = dist[i] + cost[i][j], i, True
                    if flow[i][j] and dist[n + j] - cost[i][j] < dist[i]:
                        dist[i], via[i], changed = dist[n + j] - cost[i][j], n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: (dist[n + j], j))
        path, at = [], n + end
        while via[at] >= 0:
            path.append((via[at], at))
            at = via[at]
        amount = min([left[at], room[end], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[at] -= amount
        room[end] -= amount
    return flow


def transfers(old: dict[int, int], new_shards: int, capacity: list[int] | None = None) -> dict[int, list[tuple[int, int]]]:
    """old shard -> [(new shard, bytes)], its own first. Capacities are near equal unless given."""
    total, names = sum(old.values()), sorted(old)
    capacity = capacity or [total * (j + 1) // new_shards - total * j // new_shards for j in range(new_shards)]
    flow = min_cost_flow([old[i] for i in names], capacity, [[int(i != j) for j in range(new_shards)] for i in names])
    return {i: sorted(((j, x) for j, x in enumerate(flow[k]) if x), key=lambda t: (t[0] != i, t[0])) for k, i in enumerate(names)}


def _boundaries(plan: dict[int, list[tuple[int, int]]], old: Column, at: Column) -> Column:
    """The new shard of the byte at this place of its old shard. The plan has a few hundred entries at most."""
    chosen = F.lit(None).cast("int")
    for i, moves in plan.items():
        ends, run = F.lit(moves[-1][0]) if moves else F.lit(i), sum(x for _, x in moves)
        for j, x in reversed(moves):
            ends, run = F.when(at < run, F.lit(j)).otherwise(ends), run - x
        chosen = F.when(old == i, ends).otherwise(chosen)
    return chosen


def _measured(docs: DataFrame, id_col: str, text_col: str, old_shard: Column | None, old_shards: int, *kept: Column) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, hashed) and what else is kept of every row."""
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size")
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32")
    lies = [old_shard.cast("int").alias("old_shard")] if old_shard is not None else []
    row = docs.select(F.col(id_col).alias("doc_id"), size, crc, *lies, *kept).withColumn("hashed", F.xxhash64("doc_id", "size", "text_crc32"))
    dealt = F.pmod("hashed", F.lit(old_shards)).cast("int")
    return row.withColumn("old_shard", F.coalesce("old_shard", dealt) if lies else dealt)


def _blocked(row: DataFrame, blocks: int) -> DataFrame:
    row = row.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "hashed"), F.lit(blocks))).drop("hashed")
    return row.withColumn("chunk", F.expr(f"block div {CHUNK_BLOCKS}"))


def _sharded(row: DataFrame, plan: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """row, whose base is its block's first byte, with shard, and nth: its number from 1 among its block's rows of that shard."""
    block = ["old_shard", "chunk", "block"]
    inside = W.partitionBy(*block).orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = row.withColumn("at", F.col("base") + F.sum("size").over(inside) - F.col("size"))
    placed = placed.withColumn("shard", _boundaries(plan, F.col("old_shard"), F.col("at")))
    return placed.withColumn("nth", F.row_number().over(W.partitionBy(*block, "shard").orderBy("at"))).drop("base", "at")


def _placement(row: DataFrame, new_shards: int, old_shards: int) -> tuple[int, DataFrame, dict[int, list[tuple[int, int]]], DataFrame, DataFrame]:
    """Number of blocks, their first bytes, the plan, the rows' shards, and the first slot of each block in each shard."""
    n = row.count()
    blocks = max(1, n // (BLOCK_ROWS * old_shards))
    row = cut(_blocked(row, blocks))
    sums = cut(row.groupBy("old_shard", "chunk", "block").agg(F.sum("size").alias("bytes")))
    old = {r.old_shard: r.bytes for r in sums.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect()}  # one row per old shard
    plan = transfers(old, new_shards)
    base = sums.withColumn("base", F.sum("bytes").over(W.partitionBy("old_shard").orderBy("block")) - F.col("bytes")).drop("bytes")
    placed = cut(_sharded(row.join(base, ["old_shard", "chunk", "block"]), plan))
    counts = placed.groupBy("shard", "old_shard", "chunk", "block").agg(F.count("*").alias("rows"))
    first = counts.withColumn("first", F.sum("rows").over(W.partitionBy("shard").orderBy("old_shard", "block")) - F.col("rows")).drop("rows")
    return blocks, base, plan, placed, first


def _slotted(placed: DataFrame, first: DataFrame) -> DataFrame:
    return placed.join(first, ["shard", "old_shard", "chunk", "block"]).withColumns({"slot": _slot(), "moved": F.col("shard") != F.col("old_shard")})


def _slot() -> Column:
    return (F.col("first") + F.col("nth") - 1).cast("long")


def _looked_up(row: DataFrame, values: DataFrame, key: Column, name: str) -> DataFrame:
    """row with the value of its key, by one map for each chunk: rows dealt by chunk stay where they are."""
    maps = values.groupBy("old_shard", "chunk").agg(F.map_from_entries(F.collect_list(F.struct(key, name))).alias("_map"))
    return row.join(maps, ["old_shard", "chunk"]).withColumn(name, F.col("_map")[key]).drop("_map")


def reshard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", old_shard: Column | None = None, new_shards: int = NEW_SHARDS, old_shards: int = OLD_SHARDS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, old_shard, shard, slot, moved.

    size is the text's UTF-8 bytes (none for null) plus 1. old_shard: where a row lies now, an expression over docs
    from 0; by default, and where it is null, a hash of the row deals it to one of old_shards. New shards have near equal bytes, each within a
    document of its capacity; slot counts a shard's rows from 0 without gaps. Blocks are hash ranges of a bounded number of rows, so
    that neither a hot id nor a large shard is ordered in one task; equal rows may swap slots between runs. An empty table
    gives no rows.
    """
    *_, placed, first = _placement(_measured(docs, id_col, text_col, old_shard, old_shards), new_shards, old_shards)
    return _slotted(placed, first).select(*PLACED)


def _affected(placed: DataFrame) -> list[int]:
    """The shards that gain or lose rows: at most as many as there are."""
    out = placed.where("shard <> old_shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    return sorted(r.s for r in out.collect())


def _free(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as keep it apart from the columns."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def _write(rows: DataFrame, shard: str, slot: str, emptied: list[int], path: str) -> None:
    """Replace the shards' folders that rows has rows for, and delete those of emptied shards; others stay."""
    spark = rows.sparkSession
    rows.sortWithinPartitions(shard, slot).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)
    for s in emptied:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{shard}={s}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _emptied(placed: DataFrame, affected: list[int]) -> list[int]:
    return sorted(set(affected) - {r.shard for r in placed.select("shard").distinct().collect()})


def rewrite(rows: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", old_shard: Column | None = None) -> list[int]:
    """Write the shards that gain or lose rows under path, one folder each, sorted by slot; returns their numbers.

    rows: the documents placed by reshard(), with its columns and old_shard. Null and repeated ids are rows like others:
    rows of one id, size, CRC and old shard are numbered and meet as many places; as they lie in one old shard, all or none
    of them are written. Folders of shards whose rows all stay are not touched. Where rows has a column shard or slot,
    the place's names begin with an underscore.
    """
    affected = _affected(placed)
    shard, slot = _free("shard", rows.columns), _free("slot", rows.columns)
    key = ["doc_id", "size", "text_crc32", *(["old_shard"] if old_shard is not None else [])]
    nth = F.row_number().over(W.partitionBy(*key).orderBy("size")).alias("nth")
    kept = _measured(rows, id_col, text_col, old_shard, 1, F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")).select(*key, "row", nth).alias("k")
    to = placed.select(*key, "shard", "slot", nth).where(F.col("shard").isin(affected)).alias("t")
    on = [F.col(f"k.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*key, "nth"]]
    moved = kept.join(to, on).select("k.row.*", F.col("t.shard").alias(shard), F.col("t.slot").alias(slot))
    _write(moved.repartition(shard, F.expr(f"{slot} div 100000")), shard, slot, _emptied(placed, affected), path)
    return affected


def resharded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", old_shard: Column | None = None, new_shards: int = NEW_SHARDS, old_shards: int = OLD_SHARDS) -> DataFrame:
    """reshard() with the affected shards written under path: their rows are measured as read back, the others where they lie.

    All columns of docs are written, with slot and old_shard. The text is dealt once, by chunks of neighbouring blocks,
    which is also how it is written; so a shard has a few files for each chunk, and slots rise within a file.
    """
    blocks, base, plan, placed, first = _placement(_measured(docs, id_col, text_col, old_shard, old_shards), new_shards, old_shards)
    slotted, affected = _slotted(placed, first).select(*PLACED), _affected(placed)
    if not affected:
        return slotted
    shard, slot, old = (_free(name, docs.columns) for name in ("shard", "slot", "old_shard"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    whole = _blocked(_measured(docs, id_col, text_col, old_shard, old_shards, row), blocks).where(F.col("old_shard").isin(affected))
    based = _looked_up(whole.repartition("old_shard", "chunk"), base, F.col("block"), "base")
    moved = _looked_up(_sharded(based, plan), first, F.col("block") * F.lit(1 << 20) + F.col("shard"), "first")
    moved = moved.select("row.*", _slot().alias(slot), F.col("old_shard").alias(old), F.col("shard").alias(shard))
    _write(moved, shard, slot, _emptied(placed, affected), path)
    back = docs.sparkSession.read.schema(moved.schema).parquet(path).where(F.col(shard).isin(affected))
    back = _measured(back, id_col, text_col, F.col(old), old_shards, F.col(shard).alias("shard"), F.col(slot).alias("slot"))
    return back.withColumn("moved", F.col("shard") != F.col("old_shard")).select(*PLACED).unionByName(slotted.where(~F.col("shard").isin(affected)))


def scratch(spark: SparkSession) -> str:
    """A new folder for shards in the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/vellum-{uuid.uuid4().hex}/shards"
