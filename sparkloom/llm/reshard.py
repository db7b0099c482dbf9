"""Resharding by minimum-cost flow: equal new shards with the fewest bytes moved, and the files rewritten.

Rows belong to blocks (old shard and a hash of the key), whose sizes are summed
in Spark; at most old shards x BLOCKS sums reach the driver, whatever the number
of rows.  The driver solves a flow from the old shards' sizes to the new shards'
capacities in which a byte that stays costs nothing and a byte that moves costs
one, then realises each amount of the flow with whole blocks, largest first.
The block table, bounded as said, is broadcast: a row finds its new shard by its
old one and the hash of its key, so no join is by key and rows without a key or
with a repeated one move like all others.

Only shards that gain or lose rows are rewritten, into a new folder; the old
files stay until the caller drops them, so a rewrite that breaks off loses
nothing, and a shard that lost all its rows simply has no file.  Rows are never
sorted by shard in one task: a row's slot is its block's first slot plus its
place in the block, files hold ranges of blocks of about FILE_BYTES.

Edge cases: a null text has size 1; null and repeated keys are rows like all
others; an empty table gives no rows and writes no file; further columns are
written as they are, whatever their names; equal rows get slots in either order,
which are the same rows.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .shared import fresh, new_folder

#: Blocks of each old shard; with the number of old shards it bounds what the driver and the broadcast hold.
BLOCKS = 4096
#: Bytes of text in one file of a rewritten shard, about.
FILE_BYTES = 256 << 20
MOVES = T.StructType([T.StructField(n, T.LongType() if n in ("rows", "bytes") else T.IntegerType()) for n in ("old_shard", "block", "rows", "bytes", "shard", "file")])
SLOTS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first_slot", T.LongType())])


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Amounts sent from each source to each sink at the least total cost, by successive shortest paths.

    All supply is sent; sum(capacity) must not be less.  cost(i, j) >= 0.
    """
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("capacities are less than what there is")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    costs = [[cost(i, j) for j in range(m)] for i in range(n)]
    while any(left):
        # Bellman-Ford with a queue over sources 0..n-1 and sinks n..n+m-1; back edges undo flow.
        far = [0 if i < n and left[i] else float("inf") for i in range(n + m)]
        came: list[int] = [-1] * (n + m)
        queue = deque(i for i in range(n) if left[i])
        while queue:
            u = queue.popleft()
            steps = [(n + j, costs[u][j]) for j in range(m)] if u < n else [(i, -costs[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in steps:
                if far[u] + c < far[v]:
                    far[v], came[v] = far[u] + c, u
                    queue.append(v)
        end = min((n + j for j in range(m) if room[j]), key=lambda v: far[v])
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n], *(flow[v][u - n] for u, v in zip(path, path[1:], strict=False) if u >= n))
        for u, v in zip(path, path[1:], strict=False):
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return flow


def solve(blocks: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int, int, int]]:
    """From (old shard, block, rows, bytes) to (old shard, block, rows, bytes, new shard, file of the shard)."""
    blocks = sorted(blocks)
    total = sum(b[3] for b in blocks)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    olds = sorted({b[0] for b in blocks})
    supply = [sum(b[3] for b in blocks if b[0] == o) for o in olds]
    flow = min_cost_flow(supply, capacity, lambda i, j: int(olds[i] != j))
    need = {(olds[i], j): float(x) for i, row in enumerate(flow) for j, x in enumerate(row) if x}
    room = [float(c) for c in capacity]
    where: dict[tuple[int, int], int] = {}
    for old, block, _, size in sorted(blocks, key=lambda b: (-b[3], b[0], b[1])):
        open_ = [j for j in range(shards) if (old, j) in need]
        # A block stays if staying still needs it, else goes where the flow, then the room, lacks most.
        at = max(open_, key=lambda j: (need[old, j] >= size / 2 and room[j] >= size / 2, j == old and need[old, j] >= size, min(need[old, j], room[j]), -j))
        if room[at] < size / 2:
            at = max(range(shards), key=lambda j: (room[j], j == old, -j))
        need[old, at] = need.get((old, at), 0) - size
        room[at] -= size
        where[old, block] = at
    filled, out = [0] * shards, []
    for old, block, rows, size in sorted(blocks, key=lambda b: (b[1], b[0])):
        at = where[old, block]
        out.append((old, block, rows, size, at, filled[at] // FILE_BYTES))
        filled[at] += size
    return out


def by_source(shards: int = 16) -> Column:
    """Where rows stand before: by their source, as a crawl writes them."""
    return F.pmod(F.xxhash64("source"), F.lit(shards)).cast("int")


def _size(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _block(key: str, text: str, blocks: int) -> Column:
    """By key and text, so that rows without a key, or of one key, are dealt as well; only equal rows share a block."""
    return F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit(7)), F.lit(blocks)).cast("int")


def plan(df: DataFrame, old: Column, shards: int, key: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> list[tuple]:
    """(old shard, block, rows, bytes, new shard, file) of every block; old shards x blocks at most."""
    rows = df.select(old.alias("old_shard"), _block(key, text, blocks).alias("block"), _size(text).alias("size"))
    sums = rows.groupBy("old_shard", "block").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()
    return solve([tuple(r) for r in sums], shards)


def affected(moves: list[tuple]) -> set[int]:
    """Shards that gain or lose rows."""
    return {shard for old, _, _, _, new, _ in moves if old != new for shard in (old, new)}


def _placed(df: DataFrame, old: Column, moves: list[tuple], key: str, text: str, blocks: int) -> tuple[DataFrame, str, str]:
    """df with the new shard and its file of each row, and the names of those columns."""
    at, block, shard, part = (fresh(df, x) for x in ("old_shard", "block", "shard", "file"))
    table = df.sparkSession.createDataFrame(moves, MOVES).select(F.col("old_shard").alias(at), F.col("block").alias(block), F.col("shard").alias(shard), F.col("file").alias(part))
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns], old.alias(at), _block(key, text, blocks).alias(block))
    return rows.join(F.broadcast(table), [at, block]).drop(at, block), shard, part


def rewrite(df: DataFrame, old: Column, moves: list[tuple], folder: str, key: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> set[int]:
    """Writes the rows of the affected shards below folder/shard=N, a new folder, and returns their numbers."""
    wanted = affected(moves)
    placed, shard, part = _placed(df, old, moves, key, text, blocks)
    placed = placed.where(F.col(shard).isin(*wanted)) if wanted else placed.limit(0)
    placed.repartition(shard, part).drop(part).write.partitionBy(shard).option("compression", "zstd").parquet(folder)
    return wanted


def rewritten(df: DataFrame, old: Column, moves: list[tuple], folder: str, key: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> tuple[DataFrame, str]:
    """All rows after a rewrite with their shard, and that column's name: affected shards from their new files, others from where they were."""
    placed, shard, part = _placed(df, old, moves, key, text, blocks)
    schema = T.StructType([*df.schema.fields, T.StructField(shard, T.IntegerType())])
    kept = placed.drop(part).where(~F.col(shard).isin(*affected(moves)))
    new = df.sparkSession.read.schema(schema).parquet(folder)
    return (new.unionByName(kept) if len({m[0] for m in moves} - affected(moves)) else new), shard


def reshard(df: DataFrame, old: Column, shards: int = 16, key: str = "doc_id", text: str = "text", blocks: int = BLOCKS, folder: str | None = None) -> DataFrame:
    """Rewrites the affected shards and returns per row, from what is read back: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    folder = folder or new_folder(df.sparkSession, "shards")
    moves = plan(df, old, shards, key, text, blocks)
    rewrite(df, old, moves, folder, key, text, blocks)
    after, shard = rewritten(df, old, moves, folder, key, text, blocks)
    rows = after.select(F.col(key).alias("doc_id"), _size(text).alias("size"), F.crc32(F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))).alias("text_crc32"), F.col(shard).alias("shard"), _block(key, text, blocks).alias("block"))
    held: dict[tuple[int, int], int] = {}
    for _, block, n, _, at, _ in moves:
        held[at, block] = held.get((at, block), 0) + n
    first, slots = [0] * shards, []
    for (at, block), n in sorted(held.items()):
        slots.append((at, block, first[at]))
        first[at] += n
    place = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")) - 1
    table = F.broadcast(df.sparkSession.createDataFrame(slots, SLOTS))
    return rows.withColumn("place", place).join(table, ["shard", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first_slot") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
