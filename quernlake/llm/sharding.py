"""Sharding by fixed virtual slots.

A record's slot is a hash of its id, for ever; only the small map from slots to shards changes.  The map is stored
under a path of its own, a folder for each version: version 1 gives every shard an equal run of slots, and each rebalancing
loads the newest version and stores an edited one, which moves few slots: from shards with too many bytes, or that
are no more, to those with too few.  Where nothing is to be moved, the version stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.llm.tables import children, fresh, shared_dir

SLOTS, SHARDS, TOLERANCE = 4096, 16, 0.02


def slot(column) -> F.Column:
    """Slot of an id: the first 8 hex digits of the MD5 of its decimal form, modulo the slots; null ids are in slot 0."""
    digits = F.conv(F.substring(F.md5(column.cast("bigint").cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.coalesce(digits % SLOTS, F.lit(0)).cast("int")


def slot_bytes(docs: DataFrame) -> DataFrame:
    """(slot, bytes, records) of the slots that have records; a null text has no bytes."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return docs.select(slot(F.col("doc_id")).alias("slot"), size.alias("size")).groupBy("slot").agg(F.sum("size").cast("bigint").alias("bytes"), F.count("*").alias("records"))


def first_map(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """Shard of each slot in version 1."""
    return [s * shards // slots for s in range(slots)]


def rebalanced(now: list[int], size: dict[int, int], shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[int]:
    """The map with slots moved until no shard exceeds the mean by more than ``tolerance``, or no move helps.

    Slots of shards from ``shards`` on, which are no more, go first, the largest to the emptiest shard.  Then the
    fullest shard gives the emptiest the slot that comes nearest to half of their difference; ties go to the
    least shard and slot.  Other slots without records stay."""
    out = list(now)
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]

    def put(s: int, shard: int) -> None:
        out[s] = shard
        load[shard] += size.get(s, 0)
        if size.get(s, 0):
            held[shard].append(s)

    homeless = []
    for s, shard in enumerate(out):
        if shard < shards:
            put(s, shard)
        else:
            homeless.append(s)
    many = [sum(x == k for x in out) for k in range(shards)]
    for s in sorted(homeless, key=lambda s: (-size.get(s, 0), s)):
        k = min(range(shards), key=lambda k: (load[k], many[k], k))
        many[k] += 1
        put(s, k)
    mean = sum(load) / shards
    while True:
        high = max(range(shards), key=lambda k: (load[k], -k))
        low = min(range(shards), key=lambda k: (load[k], k))
        gap = load[high] - load[low]
        if load[high] <= mean * (1 + tolerance):
            return out
        movable = [s for s in held[high] if size[s] < gap]
        if not movable:
            return out
        s = min(movable, key=lambda s: (abs(gap / 2 - size[s]), s))
        held[high].remove(s)
        held[low].append(s)
        load[high] -= size[s]
        load[low] += size[s]
        out[s] = low


def stored(docs: DataFrame, path: str) -> tuple[int, list[int]] | None:
    """(version, shard of each slot) of the newest whole version under ``path``."""
    versions = [int(name.removeprefix("version-")) for name in children(docs.sparkSession, path) if name.startswith("version-") and "_SUCCESS" in children(docs.sparkSession, f"{path}/{name}")]
    if not versions:
        return None
    rows = docs.sparkSession.read.schema("slot int, shard int").parquet(f"{path}/version-{max(versions):06d}").collect()  # SLOTS rows
    return max(versions), [r["shard"] for r in sorted(rows, key=lambda r: r["slot"])]


def store(docs: DataFrame, path: str, version: int, shard: list[int]) -> None:
    """Versions are never overwritten: of two that store the same one, the second fails."""
    docs.sparkSession.createDataFrame(list(enumerate(shard)), "slot int, shard int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version-{version:06d}")


def slot_map(docs: DataFrame, path: str, shards: int = SHARDS) -> tuple[int, list[int]]:
    """(version, shard of each slot) for the bytes of ``docs``: the newest stored version, edited and stored as the next
    where that moves any slot.  Without a stored one it begins with version 1."""
    found = stored(docs, path)
    if found is None:
        found = 1, first_map(shards)
        store(docs, path, *found)
    version, now = found
    edited = rebalanced(now, {r["slot"]: r["bytes"] for r in slot_bytes(docs).collect()}, shards)  # a row a slot
    if edited != now:
        version, now = version + 1, edited
        store(docs, path, version, now)
    return version, now


def sharded(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """(doc_id, slot, shard, version) of each row under the newest version of the map at ``path``, edited for ``docs``.

    Repeated rows and ids lie together; a null id is in slot 0; an empty table gives no row.  Extra columns are ignored."""
    return placed(docs.select("doc_id", "text"), path, shards).select(F.col("doc_id").cast("bigint").alias("doc_id"), "slot", "shard", "version")


def placed(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """``docs`` with the columns slot, shard and version, of the newest version of the map at ``path``, edited for ``docs``;
    where it has such names already, with ``_`` before.  Rows and nulls stay as they are."""
    names = [fresh(docs, c) for c in ("slot", "shard", "version")]
    version, now = slot_map(docs, path, shards)
    at = slot(F.col("doc_id"))
    return docs.select("*", at.alias(names[0]), F.element_at(F.lit(now), at + 1).alias(names[1]), F.lit(version).alias(names[2]))  # the map is a constant of SLOTS integers


def map_path(docs: DataFrame, name: str) -> str:
    """The place of a named map in the shared folder, the same in each run."""
    return f"{shared_dir(docs.sparkSession)}/slot-maps/{name}"
