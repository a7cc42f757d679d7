"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

Each shard owns ``vnodes`` arcs of a ring of 2**14 places. A document's place is the top bits of xxhash64(doc_id); its home is
the shard of the next virtual node clockwise. Shards hold a bounded number of rows: n // shards, and one more for the
first n % shards of them, so counts are at most one apart. Keys that find their home full continue clockwise to the first virtual node
whose shard has room. Keys of an arc are admitted in ring order, and home keys before passing ones, so few keys move.

Only counts per arc (shards * vnodes rows, a bound set by the parameters) are gathered to plan the overflow: each arc becomes
a few ranges of ranks with a shard and the first slot. Ranks are counted in two levels, ring cells of about ``cell_rows`` rows and rows within a cell,
so no task holds a whole arc. Every row has its own point, so equal texts don't heat a shard.

Edge cases: a null or empty text has size 16 and CRC 0; rows without a doc_id are placed by their text; repeated
rows are separate rows, ordered by text hash; empty table, empty result; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packframe.llm.common import cut, table

RING_BITS = 14
MASK = (1 << 32) - 1


def _mix32(x: int) -> int:
    """A fixed 32-bit scramble, to place virtual nodes."""
    x = (x ^ (x >> 16)) * 0x45D9F3B & MASK
    x = (x ^ (x >> 15)) * 0x2C1B3C6D & MASK
    return x ^ (x >> 16)


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place on the ring, shard), ascending. A virtual node whose place is taken goes to the next free one."""
    if shards * vnodes > 1 << RING_BITS:
        raise ValueError(f"more than {1 << RING_BITS} virtual nodes")
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            x = _mix32(_mix32(s + 1) ^ _mix32(0x9E3779B9 * (v + 1) & MASK)) >> (32 - RING_BITS)
            while x in at:
                x = (x + 1) % (1 << RING_BITS)
            at[x] = s
    return sorted(at.items())


def place(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, past rank, shard, first slot): home keys fill their shard while it has room, arc by arc clockwise; then
    what is left over walks on clockwise, nearest first, until all are placed."""
    room, used, out, waiting = list(room), [0] * len(room), [], []
    for arc, (n, shard) in enumerate(zip(counts, owners, strict=True)):
        take = min(n, room[shard])
        if take:
            out.append((arc, 0, take, shard, used[shard]))
        room[shard] -= take
        used[shard] += take
        if n > take:
            waiting.append([arc, take, n])
    # after the home round a shard with room has no waiting keys; each overflow finds the next open arc clockwise
    for arc, at, n in waiting:
        step = 1
        while at < n:
            if step > len(owners):
                raise ValueError("the shards' room is less than the number of keys")
            shard = owners[(arc + step) % len(owners)]
            if take := min(n - at, room[shard]):
                out.append((arc, at, at + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                at += take
            step += 1
    return out


def assign(docs: DataFrame, shards: int = 40, vnodes: int = 64, cell_rows: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.coalesce(F.when(F.col("doc_id").isNull(), F.xxhash64("text")), F.xxhash64("doc_id")).alias("h"), F.xxhash64("text").alias("text_key"))
    slim = cut(slim, "shard-rows")
    nodes = ring(shards, vnodes)
    n = slim.count()
    fine = max(0, min(40, math.ceil(math.log2(max(1, n / cell_rows))) - RING_BITS))  # bits that split a ring place into cells
    arcs = [bisect.bisect_left(nodes, (x, -1)) % len(nodes) for x in range(1 << RING_BITS)]
    owner = F.from_json(F.lit(json.dumps(arcs)), "array<int>")
    cell = F.shiftrightunsigned("h", 64 - RING_BITS - fine)
    slim = slim.withColumn("cell", cell).withColumn("arc", F.element_at(owner, (F.shiftright("cell", fine) + 1).cast("int")))
    # arc 0 also has the places past the last virtual node; they come after its own, so the order within an arc is by cell
    cells = cut(slim.groupBy("arc", "cell").agg(F.count("*").alias("n")), "shard-cells")
    counts = dict(cells.groupBy("arc").agg(F.sum("n").alias("n")).collect())  # shards * vnodes rows at most
    room = [n // shards + (s < n % shards) for s in range(shards)]
    ranges = place([counts.get(a, 0) for a in range(len(nodes))], [s for _, s in nodes], room)
    if not ranges:
        ranges = [(-1, 0, 0, 0, 0)]
    entry = "array<struct<arc:int,lo:bigint,hi:bigint,shard:int,slot:bigint>>"
    told = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(("arc", "lo", "hi", "shard", "slot"), r, strict=True)) for r in ranges])), entry)))
    told = told.groupBy("arc").agg(F.collect_list(F.struct("lo", "hi", "shard", "slot")).alias("ranges"))
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(told), "arc").select("cell", "base", "ranges")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("h", "doc_id", "text_key"))
    x = slim.withColumn("rank", rank).join(cells, "cell").withColumn("rank", F.col("rank") - 1 + F.col("base"))
    x = x.withColumn("to", F.filter("ranges", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0])
    return x.select("doc_id", "size", "text_crc32", F.col("to")["shard"].alias("shard"), (F.col("to")["slot"] + F.col("rank") - F.col("to")["lo"]).alias("slot"))


def op6_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = assign(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
