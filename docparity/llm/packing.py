"""Best-fit packing of documents into sequences, after a Martello-Toth reduction.

Lengths are whole numbers up to the capacity, so an instance of any size *is*
its histogram: at most ``capacity`` counts, whatever the number of documents.
The driver solves the histogram: bins that a reduction proves to be part of an
optimal packing are fixed first, whole multiplicities at a time, then the rest
goes by best fit, longest first. The result is a table of slots (length, range
of ranks -> range of bins), also bounded by the capacity, and every document
finds its bin from its rank among those of its length. Documents never come to the driver.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docparity.llm.common import cut

#: Characters of a sequence: about 2,048 tokens of byte-level BPE.
CAPACITY = 8192
#: Pieces of one length that are ranked together, about; a length that more share falls into parts by hash, so it is no one task's work.
PART_PIECES = 500_000
#: Slots are broadcast up to this many, joined by shuffle beyond.
BROADCAST_SLOTS = 200_000


@dataclass
class _Sizes:
    """Lengths that still have items, ascending, with their counts."""

    count: dict[int, int]
    order: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.order = sorted(s for s, n in self.count.items() if n > 0)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.order[bisect.bisect_left(self.order, size)]

    def largest_fit(self, room: int, without: int) -> int | None:
        """Largest length that fits besides one item of length ``without``."""
        i = bisect.bisect_right(self.order, room) - 1
        while i >= 0:
            s = self.order[i]
            if self.count[s] > (s == without):
                return s
            i -= 1
        return None

    def smallest(self, n: int, without: int, above: int = 0) -> list[int]:
        """The n smallest items longer than ``above``, not counting one of length ``without``; fewer if there are no more."""
        out: list[int] = []
        for s in self.order[bisect.bisect_right(self.order, above) :]:
            out += [s] * min(n - len(out), self.count[s] - (s == without))
            if len(out) == n:
                break
        return out

    def best_pair(self, room: int, without: int) -> tuple[int, int] | None:
        """The two items with the largest sum up to ``room``, the longest first; of equal sums the one with the longer first item."""
        have = [s for s in self.order[: bisect.bisect_right(self.order, room)] if self.count[s] > (s == without)]
        best = max(((s, s) for s in have if 2 * s <= room and self.count[s] - (s == without) >= 2), default=None)
        lo, hi = 0, len(have) - 1
        while lo < hi:
            pair = have[hi], have[lo]
            if sum(pair) > room:
                hi -= 1
                continue
            if best is None or (sum(pair), pair) > (sum(best), best):
                best = pair
            lo += 1
        return best


def _dominating(sizes: _Sizes, item: int, capacity: int) -> list[int] | None:
    """The other items of a bin that dominates every feasible bin with ``item``; None if the criterion proves none.

    A set dominates another if that one's items can be grouped so that each
    group is no longer than an item of its own in the first (Martello and Toth).
    """
    room = capacity - item
    first = sizes.largest_fit(room, item)
    if first is None:
        return []
    if first == room:
        return [first]  # any other filling of the room is one group no longer than ``first``
    small = sizes.smallest(3, item)
    if sum(small[:2]) > room or len(small) < 2:
        return [first]  # no two others fit together
    if len(small) == 3 and sum(small) <= room:
        return None  # three others fit: beyond the criterion
    pair = sizes.best_pair(room, item)
    if pair is None or first >= sum(pair):
        return [first]
    if pair[0] == first:
        over = sizes.smallest(2, item, above=pair[1])
        if len(over) < 2 or sum(over) > room:
            return list(pair)  # every other pair has an item no longer than pair[1]
    return None


def reduced(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """Bins fixed by dominance as (lengths, how many such bins), and the counts left. Repeats until nothing more can be fixed."""
    sizes = _Sizes(dict(histogram))
    fixed: list[tuple[list[int], int]] = []
    again = True
    while again:
        again = False
        for item in reversed(list(sizes.order)):
            while sizes.count.get(item, 0) > 0:
                others = _dominating(sizes, item, capacity)
                if others is None:
                    break
                need: dict[int, int] = {}
                for s in [item, *others]:
                    need[s] = need.get(s, 0) + 1
                # taking items only removes alternatives, so the proof holds while all its items last
                times = min(sizes.count[s] // n for s, n in need.items())
                for s, n in need.items():
                    sizes.take(s, n * times)
                fixed.append(([item, *others], times))
                again = True
    return fixed, {s: n for s, n in sizes.count.items() if n > 0}


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first: each item into the open bin with the least room that takes it. (lengths, how many such bins)."""
    room_of: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}  # room -> groups of equal bins
    rooms: list[int] = []

    def put(room: int, group: tuple[list[tuple[int, int]], int]) -> None:
        if room not in room_of:
            bisect.insort(rooms, room)
            room_of[room] = []
        room_of[room].append(group)

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                whole, rest = divmod(left, each)
                if whole:
                    put(capacity - each * size, ([(size, each)], whole))
                if rest:
                    put(capacity - rest * size, ([(size, rest)], 1))
                break
            room = rooms[i]
            items, bins = room_of[room].pop()
            if not room_of[room]:
                del room_of[room], rooms[i]
            each = room // size
            whole, rest = divmod(left, each)
            if whole >= bins:
                put(room - each * size, ([*items, (size, each)], bins))
                left -= bins * each
                continue
            if whole:
                put(room - each * size, ([*items, (size, each)], whole))
            if rest:
                put(room - rest * size, ([*items, (size, rest)], 1))
            if bins - whole - bool(rest):
                put(room, (items, bins - whole - bool(rest)))
            break
    return [([s for s, n in items for _ in range(n)], bins) for groups in room_of.values() for items, bins in groups]


def slots(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """size, from_rank, to_rank (end excluded), from_bin, each (items of this size a bin), at (offset of the first), fixed."""
    fixed, rest = reduced(histogram, capacity)
    rows, rank, at_bin = [], dict.fromkeys(histogram, 0), 0
    for bins, how in ((fixed, True), (best_fit(rest, capacity), False)):
        for sizes, times in bins:
            at = 0
            for size, each in zip(*np.unique(np.array(sizes), return_counts=True)):
                size, each = int(size), int(each)
                rows.append((size, rank[size], rank[size] + each * times, at_bin, each, at, how))
                rank[size] += each * times
                at += size * each
            at_bin += times
    return pd.DataFrame(rows, columns=["size", "from_rank", "to_rank", "from_bin", "each", "at", "fixed"]).astype(
        {"size": "int64", "from_rank": "int64", "to_rank": "int64", "from_bin": "int64", "each": "int64", "at": "int64", "fixed": "bool"}
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """Assign every character of every document to a place in a sequence of ``capacity`` characters.

    One row a piece: ``doc_id``, ``piece`` (0, 1, ... within the document), ``start`` and
    ``length`` (characters of the source text), ``bin_id``, ``bin_offset`` and ``fixed``
    (true if the reduction fixed the bin). A document longer than the capacity
    is cut into full pieces and a rest; other documents are one piece. Bins
    hold no more than the capacity and no two pieces overlap.

    Null and empty texts need no place: one row with length 0 and null
    ``bin_id``, ``bin_offset`` and ``fixed``. Repeated rows are packed once for each row, and so are
    rows without ``doc_id``. Only ``doc_id`` and the text column are read. An empty
    table gives an empty result. Which of several pieces of one length gets
    which bin follows ``doc_id``.
    """
    n = F.coalesce(F.length(F.col(text)), F.lit(0))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"), F.monotonically_increasing_id().alias("row"))
    count = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int")
    pieces = given.select("doc_id", "n", "row", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"),
        F.least(F.col("n") - F.col("piece").cast("long") * capacity, F.lit(capacity)).alias("length"),
        F.xxhash64("doc_id", "piece", F.when(F.col("doc_id").isNull(), F.col("row"))).alias("hash"),
    )
    pieces = cut(pieces)
    # at most one row for each length up to the capacity
    histogram = {int(s): int(n) for s, n in pieces.where("length > 0").groupBy("length").count().collect()}
    full = pieces.where("length > 0")
    if many := [(s, -(-n // PART_PIECES)) for s, n in histogram.items() if n > PART_PIECES]:
        full = full.join(F.broadcast(docs.sparkSession.createDataFrame(many, "length int, parts long")), "length", "left")
        full = full.withColumn("part", F.pmod("hash", F.coalesce("parts", F.lit(1).cast("long"))).cast("int")).drop("parts")
    else:
        full = full.withColumn("part", F.lit(0))
    full = full.drop("hash")
    counts = cut(full.groupBy("length", "part").agg(F.count("*").alias("n")))
    table = slots(histogram, capacity)
    spark = docs.sparkSession
    slot = spark.createDataFrame(table, "size long, from_rank long, to_rank long, from_bin long, each long, at long, fixed boolean")
    if len(table) <= BROADCAST_SLOTS:
        slot = F.broadcast(slot)
    base = counts.selectExpr("length", "part", "coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0) as base")
    ranked = full.selectExpr("*", "row_number() over (partition by length, part order by doc_id, piece) - 1 as within").join(base, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("within"))
    placed = ranked.join(slot, (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    k = F.col("rank") - F.col("from_rank")
    placed = placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
        (F.col("from_bin") + F.floor(k / F.col("each"))).alias("bin_id"),
        (F.col("at") + k % F.col("each") * F.col("length")).alias("bin_offset"), "fixed",
    )
    nothing = pieces.where("length = 0").selectExpr("doc_id", "piece", "start", "0L as length", "cast(null as long) as bin_id", "cast(null as long) as bin_offset", "cast(null as boolean) as fixed")
    return placed.unionByName(nothing)
