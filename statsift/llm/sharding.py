"""Sharding by fixed virtual slots.

Records are hashed into thousands of virtual slots that never change.  The bytes
of each slot are summed, and a small versioned map says which shard holds which
slot.  Growing the number of shards, or evening out their sizes, edits the map;
it never hashes a record anew, and moves only the slots that the edit names.

Law ``bytes``: the shards' sizes are near equal.  The first version of a map deals
slots round; each call loads the last version, moves slots off the shards above the
mean until the sizes are as near as whole slots allow, and stores what it made as
the next version.  A version is a folder that appears whole, once: of two writers the
later one edits what the earlier one stored.

Defined cases: a null text has no bytes and the size of an empty one; a null or
repeated id goes where its hash says, so all rows of an id are in one shard, and the
ranking of a slot's rows is split over tasks; equal rows are ranked in any order;
texts are measured only, however long; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statsift.llm import _common as c

SLOTS = 8192
OVERHEAD = 16
#: The rows of a slot are ranked in so many parts.
PARTS = 64
MAP = "virtual_slot int, shard int, slots int, version int"
#: Times that a writer starts anew from the version that another writer stored meanwhile.
ATTEMPTS = 8
#: Last moves a shard at most, when a map is evened out.
POLISH = 4


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1: slots dealt round."""
    return [s % shards for s in range(slots)]


def rebalance(mapping: list[int], sizes: list[int], shards: int) -> list[int]:
    """The next version of a map: as few slots moved as make the sizes near equal.

    Shards above the mean give up slots, the largest that leave them above it
    first, then their smallest; the freed slots go, largest first, each to the
    shard that is then the smallest; a few single moves follow."""
    new, held, total = list(mapping), [[] for _ in range(shards)], [0] * shards
    free = []
    for slot, shard in enumerate(mapping):
        if shard >= shards:  # a shard that is no more
            new[slot] = slot % shards
        if sizes[slot]:
            held[new[slot]].append(slot)
            total[new[slot]] += sizes[slot]
    mean = sum(total) / shards
    for shard in range(shards):
        stay = []
        for slot in sorted(held[shard], key=lambda s: (-sizes[s], s)):
            if total[shard] - sizes[slot] >= mean:
                free.append(slot)
                total[shard] -= sizes[slot]
            else:
                stay.append(slot)
        if total[shard] > mean:
            free.append(stay[-1])
            total[shard] -= sizes[stay[-1]]
    heap = [(t, shard) for shard, t in enumerate(total)]
    heapq.heapify(heap)
    for slot in sorted(free, key=lambda s: (-sizes[s], s)):
        t, shard = heapq.heappop(heap)
        new[slot] = shard
        heapq.heappush(heap, (t + sizes[slot], shard))
    # then single slots from the largest shard to the smallest, as long as that helps
    held, total = [set() for _ in range(shards)], [0] * shards
    for slot, shard in enumerate(new):
        if sizes[slot]:
            held[shard].add(slot)
            total[shard] += sizes[slot]
    for _ in range(POLISH * shards):
        large, small = total.index(max(total)), total.index(min(total))
        gap = total[large] - total[small]
        slot = min((s for s in held[large] if sizes[s] < gap), key=lambda s: (abs(2 * sizes[s] - gap), s), default=None)
        if slot is None:
            break
        held[large].remove(slot)
        held[small].add(slot)
        total[large] -= sizes[slot]
        total[small] += sizes[slot]
        new[slot] = small
    return new


def last_version(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """The last version of the map in ``path``, if there is one.

    A version that does not hold each of its slots once is an error: hashing by a wrong number
    of slots would move every record."""
    try:
        stored = spark.read.schema(MAP).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    version = stored.agg(F.max("version")).first()[0]
    if version is None:
        return None
    rows = stored.filter(F.col("version") == version).orderBy("virtual_slot").collect()  # a row a slot
    if [r["virtual_slot"] for r in rows] != list(range(rows[0]["slots"])):
        raise ValueError(f"version {version} of the map in {path} does not hold each of its {rows[0]['slots']} slots once")
    return version, [r["shard"] for r in rows]


def store_version(spark: SparkSession, path: str, version: int, mapping: list[int]) -> bool:
    """Store a version whole, under a name of its own; False if another writer has stored it already.

    It is written beside the others and then renamed, which fails where the name is taken."""
    jvm = spark.sparkContext._jvm
    early = f"{path}/_{uuid.uuid4().hex}"
    rows = [(slot, shard, len(mapping)) for slot, shard in enumerate(mapping)]
    spark.createDataFrame(rows, "virtual_slot int, shard int, slots int").coalesce(1).write.parquet(early)
    place = jvm.org.apache.hadoop.fs.Path
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    plainly = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # never over what is there
    try:
        files.rename(place(early), place(f"{path}/version={version}"), plainly)
    except Py4JJavaError as e:
        files.delete(place(early), True)
        if e.java_exception.getClass().getName() == "org.apache.hadoop.fs.FileAlreadyExistsException":
            return False
        raise
    return True


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot``.

    ``slot`` is the row's place in its shard, gapless from 0; ``virtual_slot``
    the one it is hashed to.  ``map_path``: where the map's versions are kept; the
    last one there is edited (its number of slots counts), and the next one is
    appended when this is called.  Without it a new map begins."""
    spark = docs.sparkSession
    map_path = map_path or c.new_path(spark, "slot-map")
    if last_version(spark, map_path) is None:
        store_version(spark, map_path, 1, first_map(shards, slots))
    version, mapping = last_version(spark, map_path)
    slots = len(mapping)
    data = c.utf8("text")
    rows = c.pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.octet_length(data) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part"),
    )
    rows = c.cut(rows, "sized")
    counts = rows.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    counts = c.cut(counts, "slot-counts")  # at most slots x PARTS rows
    held = counts.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()  # one row a slot
    sizes, rows_of = [0] * slots, [0] * slots
    for r in held:
        sizes[r["virtual_slot"]], rows_of[r["virtual_slot"]] = r["bytes"], r["n"]
    for _ in range(ATTEMPTS):
        edited = rebalance(mapping, sizes, shards)
        if store_version(spark, map_path, version + 1, edited):
            mapping = edited
            break
        version, mapping = last_version(spark, map_path)
    else:
        raise RuntimeError(f"other writers stored {ATTEMPTS} versions of the map in {map_path} meanwhile")

    base, placed = [0] * shards, []
    for slot, home in enumerate(mapping):
        placed.append((slot, home, base[home]))
        base[home] += rows_of[slot]
    current = spark.createDataFrame(placed, "virtual_slot int, shard int, base long")  # one row a slot
    before = F.coalesce(F.sum("n").over(Window.partitionBy("virtual_slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.join(F.broadcast(current), "virtual_slot").select("virtual_slot", "part", "shard", (F.col("base") + before).alias("base"))
    place = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("place", place)
        .join(parts, ["virtual_slot", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
        )
    )
