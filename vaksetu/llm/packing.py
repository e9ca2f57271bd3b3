"""Problem 7: filling fixed-capacity containers by shortest-pack-first over the length histogram.

Only the histogram of lengths (at most ``capacity`` entries, whatever the number of documents) reaches the driver. There
lengths are placed longest first, each into the pattern with the least filled room that still fits, counts at once
rather than document by document. The patterns then join back to the documents by length and rank.

An item longer than the capacity is cut into full pieces, which fill containers alone, and a rest that is packed as an item.
Items of size 0 need no room and go to pack 0 of each container, as does everything where nothing has a size. A null size
counts as 0. Ties and repeated rows are separate items. An empty table of items or containers gives no rows.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

#: Slices that the ranking of one length is spread over, so that a length that a third of all rows have is no single task.
SLICES = 64


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in one pack, number of packs)] for {length: count}, lengths 1..capacity: new packs are opened for one item each, or
    for as many of a length as fit, whichever ends with fewer packs (smaller items are needed to fill the former)."""
    return min((_placed(histogram, capacity, together) for together in (False, True)), key=lambda found: sum(c for _, c in found))


def _placed(histogram: dict[int, int], capacity: int, together: bool) -> list[tuple[tuple[int, ...], int]]:
    """Lengths longest first, each into the shortest open pattern that has room.

    Open patterns are kept by their filled size; the shortest comes first. A pattern whose packs outnumber the items is
    split, so the number of patterns grows by at most one a step.
    """
    by_fill: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    fills: list[int] = []

    def put(fill: int, pattern: tuple[int, ...], count: int) -> None:
        if fill not in by_fill:
            by_fill[fill] = []
            bisect.insort(fills, fill)
        by_fill[fill].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = fills[0] if fills and fills[0] + length <= capacity else None
            if at is None:
                # nothing open fits
                each = capacity // length if together else 1
                if left >= each:
                    put(length * each, (length,) * each, left // each)
                if left % each:
                    put(length * (left % each), (length,) * (left % each), 1)
                break
            pattern, count = by_fill[at].pop()
            if not by_fill[at]:
                del by_fill[at]
                fills.pop(0)
            used = min(left, count)
            if used < count:
                put(at, pattern, count - used)
            put(at + length, (*pattern, length), used)
            left -= used
    return _joined([(p, c) for packs in by_fill.values() for p, c in packs], capacity)


def _joined(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with packs that fit into one another put together, fullest first with the fullest that fits, until none fit: items
    whose lengths are alike all open packs of their own before."""
    while True:
        by_fill: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for pattern, count in sorted(patterns):
            by_fill.setdefault(sum(pattern), []).append((pattern, count))
        fills = sorted(by_fill)
        done: list[tuple[tuple[int, ...], int]] = []
        merged = False
        while fills:
            fill = fills[-1]
            pattern, count = by_fill[fill].pop()
            if not by_fill[fill]:
                fills.pop()
            at = bisect.bisect_right(fills, capacity - fill) - 1
            if at >= 0:
                other = fills[at]
                partner, times = by_fill[other].pop()
                used = min(count, times)
                if times > used:
                    by_fill[other].append((partner, times - used))
                elif not by_fill[other]:
                    fills.pop(at)
                done.append((tuple(sorted((*pattern, *partner), reverse=True)), used))
                merged = True
                count -= used
            elif 2 * fill <= capacity and count > 1:
                done.append((tuple(sorted(pattern * 2, reverse=True)), count // 2))
                merged = True
                count %= 2
            else:
                done.append((pattern, count))
                count = 0
            if count:
                if fill not in fills:
                    bisect.insort(fills, fill)
                    by_fill[fill] = []
                by_fill[fill].append((pattern, count))
        patterns = done
        if not merged:
            return sorted(patterns)


def _assignments(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, copies of the length in a pack, first pack) of each pattern and length; packs from 1."""
    taken: dict[int, int] = {}
    pack, out = 1, []
    for pattern, count in patterns:
        for length in dict.fromkeys(pattern):
            copies, start = pattern.count(length), taken.get(length, 0)
            out.append((length, start, start + copies * count, copies, pack))
            taken[length] = start + copies * count
        pack += count
    return out


def packed(sizes: DataFrame, containers: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(container, id_col, part, tokens, pack): the pack of every item under every container kind; part counts the pieces of an
    item that is longer than the container, 0 otherwise first. containers: (container, capacity), few rows, capacity above 0.
    """
    spark = sizes.sparkSession
    sizes = cut(sizes.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)).cast("long"), F.lit(0)).alias("n")))
    kinds = sorted({(r["container"], r["capacity"]) for r in containers.select("container", "capacity").where("capacity > 0").collect()}, key=str)
    result = None
    for name, capacity in kinds:
        full = (F.col("n") / capacity).cast("long")
        rest = F.col("n") % capacity
        items = sizes.withColumn("full", F.when(F.col("n") > capacity, full).otherwise(F.lit(0))).withColumn("rest", F.when(F.col("n") > capacity, rest).otherwise(F.col("n")))
        whole = items.where("full > 0").select("id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"), F.lit(capacity).cast("long").alias("len"))
        ends = items.where("rest > 0").select("id", F.col("full").alias("part"), F.col("rest").alias("len"))
        nothing = items.where("n = 0").select("id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("len"), F.lit(0).cast("long").alias("pack"))
        pieces = whole.union(ends).withColumn("slice", F.pmod(F.xxhash64("id", "part"), F.lit(SLICES)))
        counted = pieces.groupBy("len", "slice").agg(F.count("*").alias("c")).collect()  # at most capacity x SLICES rows
        histogram: dict[int, int] = {}
        before = []
        for r in sorted(counted, key=lambda r: (r["len"], r["slice"])):
            before.append((r["len"], r["slice"], histogram.get(r["len"], 0)))
            histogram[r["len"]] = histogram.get(r["len"], 0) + r["c"]
        plan = _assignments(shortest_pack_first(histogram, capacity))
        offsets = spark.createDataFrame(before, "len long, slice long, before long")
        steps = spark.createDataFrame(plan, "len long, lo long, hi long, copies long, first long")
        ranked = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("len", "slice").orderBy("id", "part")) - 1)
        # both small tables are bounded by the capacity, not by the documents: lengths x slices, and about two entries a length
        ranked = ranked.join(F.broadcast(offsets), ["len", "slice"]).withColumn("rank", F.col("nth") + F.col("before"))
        placed = ranked.join(F.broadcast(steps), "len").where("rank >= lo AND rank < hi")
        placed = placed.select("id", "part", "len", (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("copies"))).alias("pack")).union(nothing)
        placed = placed.select(F.lit(name).alias("container"), F.col("id").alias(id_col), "part", F.col("len").alias("tokens"), "pack")
        result = placed if result is None else result.union(placed)
    if result is None:
        return spark.createDataFrame([], f"container string, `{id_col}` long, part long, tokens long, pack long")
    return result


def fill_report(packs: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, capacity, packs, tokens, share_filled) of a packing."""
    used = packs.where("tokens > 0").groupBy("container").agg(F.countDistinct("pack").alias("packs"), F.sum("tokens").alias("tokens"))
    return used.join(F.broadcast(containers.select("container", "capacity")), "container").select(
        "container", "capacity", "packs", "tokens", (F.col("tokens") / (F.col("packs") * F.col("capacity"))).alias("share_filled")
    )
