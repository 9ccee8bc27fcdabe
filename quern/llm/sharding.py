"""Shards by balanced label propagation (operator 1).

Law ``rows``: the numbers of rows of any two shards differ by at most one. Rows with equal texts are
linked. Linked rows start in shards by hash; in each round a group counts its rows by
shard, ranks those shards, and takes as many of the first as it needs at least (one, if what it has there and the room
that the last round left hold all of it); its rows elsewhere ask to move there, to those with room. A shard admits movers up to its quota of
rows: demand is summed in 1024 classes of a hash (small groups are in one class, so they are
admitted whole, and before rows of large groups), and classes are admitted while they fit. Small groups that are split leave the shards
that refused movers: they take another of their shards, or else any with room. Rounds end when no row moves and no other shard refuses, or
after ``ROUNDS``. Rows without a link, and the few linked ones beyond a quota, then fill up the shards
exactly. Nothing is ordered in one task: places are counted by hash buckets of about ``BUCKET`` rows,
and only the buckets' totals are summed in order. Tables in between and the result have a part for each ``BUCKET`` rows, not one
for each partition of a shuffle: on a local file system without Hadoop's native library each new file starts two processes (chmod).

Null text is of 0 bytes and is linked with empty text. Null and repeated doc_ids are rows like others.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.storage import stored

SHARDS, ROUNDS, CLASSES, BUCKET = 40, 6, 1024, 20_000
GROUP = ("g", "size", "text_crc32")


def numbered(df: DataFrame, key: str, rows: int, name: str) -> DataFrame:
    """``df`` with a gapless number from 0 in each value of ``key``; ``rid`` is unique. rows: about how many rows a key has."""
    buckets = max(1, math.ceil(rows / BUCKET))
    df = df.withColumn("bucket", F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(buckets)))
    counts = df.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(key).orderBy("bucket")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy(key, "bucket").orderBy("rid"))
    return df.join(before, [key, "bucket"]).withColumn(name, (F.col("before") + own - 1).cast("long")).drop("bucket", "before")


def _parts(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many parts, and so files, as ``rows`` rows fill buckets; in fewer, if it has fewer."""
    return df.coalesce(max(1, math.ceil(rows / BUCKET)))


def _of(values: list[int], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), index.cast("int") + 1)


def _move(linked: DataFrame, shards: int, quota: int, round_: int, full: list[int], free: list[int], rooms: list[int], total: int) -> tuple[DataFrame, int, list[int], list[int], list[int]]:
    """One round of propagation: rows with new shards, how many moved, the shards that refused some and that have much room, and each one's room; full, free, rooms: those of the round before; total: rows of the whole table."""
    counts = linked.groupBy(*GROUP, "shard").agg(F.count("*").alias("n"), F.first("k").alias("k"))
    is_small = F.col("k") <= quota // 4
    avoid = is_small & F.col("shard").isin(full) & (F.col("n") < F.col("k")) if free else F.lit(False)
    ranked = counts.withColumn("avoid", avoid).withColumn("r", F.row_number().over(Window.partitionBy(*GROUP).orderBy("avoid", F.desc("n"), F.xxhash64("g", "shard"), "shard")))
    elsewhere = _of(free, F.pmod(F.xxhash64("g", F.lit(round_)), F.lit(len(free)))) if free else F.col("shard")
    # a large group takes shards until its rows there and their room hold all of it
    holds = F.least(F.lit(quota), F.col("n") + _of(rooms, F.col("shard")))
    held = F.sum(holds).over(Window.partitionBy(*GROUP).orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranked.withColumn("held", F.coalesce(held, F.lit(0)))
    taken = F.when(is_small, F.col("r") == 1).otherwise(F.col("held") < F.col("k"))
    place = F.when(F.col("avoid"), elsewhere).otherwise(F.col("shard"))
    wanted = ranked.filter(taken).select(*GROUP, place.alias("shard"), (_of(rooms, place) > 0).alias("open")).groupBy(*GROUP).agg(
        F.sort_array(F.collect_list("shard")).alias("best"), F.sort_array(F.collect_list(F.when(F.col("open"), F.col("shard")))).alias("open")
    ).withColumn("open", F.when(F.size("open") > 0, F.col("open")).otherwise(F.col("best")))
    spread = F.xxhash64("rid", F.lit(round_))
    rows = linked.join(wanted, list(GROUP)).withColumn(
        "to", F.when(F.array_contains("best", F.col("shard")), F.col("shard")).otherwise(F.element_at("open", (F.pmod(spread, F.size("open")) + 1).cast("int")))
    )
    half = lambda h: F.pmod(h, F.lit(CLASSES // 2))
    small = F.when(is_small, half(F.xxhash64("g", F.lit(round_)))).otherwise(half(spread) + CLASSES // 2)
    rows = stored(_parts(rows.drop("best", "open").withColumn("class", small.cast("int")), total), "moves")
    stay = {r.shard: r.n for r in rows.filter("to = shard").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    demand: dict[int, dict[int, int]] = {}
    for r in rows.filter("to != shard").groupBy("to", "class").agg(F.count("*").alias("n")).collect():  # shards x CLASSES rows at most
        demand.setdefault(r.to, {})[r["class"]] = r.n
    cut, moved, refused = [0] * shards, 0, []
    rooms = [quota - stay.get(s, 0) for s in range(shards)]
    for s, by in demand.items():
        for c in range(CLASSES):
            n = by.get(c, 0)
            if n > rooms[s]:
                refused.append(s)
                break
            rooms[s], moved, cut[s] = rooms[s] - n, moved + n, c + 1
    most = max((r for s, r in enumerate(rooms) if s not in refused), default=0)
    roomy = [s for s, r in enumerate(rooms) if s not in refused and r > 0 and 2 * r >= most]
    admitted = F.col("class") < _of(cut, F.col("to"))
    return rows.withColumn("shard", F.when(admitted, F.col("to")).otherwise(F.col("shard"))).drop("to", "class"), moved, sorted(refused), roomy, rooms


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g")
    ).withColumn("rid", F.monotonically_increasing_id())
    base = stored(base, "rows")
    total = base.count()
    groups = base.groupBy(*GROUP).agg(F.count("*").alias("k")).filter("k > 1")
    rows = stored(_parts(base.join(groups, list(GROUP), "left").withColumn("k", F.coalesce("k", F.lit(1).cast("long"))), total), "groups")
    want = [total // shards + (s < total % shards) for s in range(shards)]
    linked = rows.filter("k > 1").withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int"))
    quota = max(1, total // shards)
    full: list[int] = []
    free: list[int] = []
    rooms = [quota] * shards
    for i in range(ROUNDS):
        before = full
        linked, moved, full, free, rooms = _move(linked, shards, quota, i, full, free, rooms, total)
        if not moved and (full == before or not free):
            break
    # a shard keeps its linked rows up to its size; the others join the unlinked rows
    placed = stored(_parts(numbered(linked, "shard", total // shards, "place"), total), "placed")
    stays = placed.filter(F.col("place") < _of(want, F.col("shard"))).drop("place")
    have = {r.shard: r.n for r in stays.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    pool = rows.filter("k = 1").unionByName(placed.filter(F.col("place") >= _of(want, F.col("shard"))).drop("place", "shard"))
    ends, end = [], 0
    for s in range(shards):
        end += want[s] - have.get(s, 0)
        ends.append(end)
    pool = numbered(pool.withColumn("one", F.lit(0)), "one", total, "place").drop("one")
    limits = F.array(*[F.lit(e).cast("long") for e in ends])
    filled = pool.withColumn("shard", F.size(F.filter(limits, lambda e: e <= F.col("place"))).cast("int")).drop("place")
    out = numbered(stored(_parts(stays.unionByName(filled), total), "shards"), "shard", total // shards, "slot")
    return _parts(out, total).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
