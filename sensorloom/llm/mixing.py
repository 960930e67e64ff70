"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block_docs`` documents. With weight w, block k
(from 1) of a source may not start before slot ``floor((k - 1) / w)`` and must end by ``ceil(k / w)``;
taking the released block with the earliest deadline in each slot meets all deadlines, so after any
number of slots a source is less than one block from its share.

Weights are exact fractions, as whole parts of their common denominator. When a source runs out, a new phase begins in the next slot with the
weights of the others. Each slot depends on those before it, so one task places
all blocks, one after the other, from the number of documents by source, of which there may be any number; documents are numbered within
their source in hash buckets of bounded size, so a hot source is dealt out like others.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered

BUCKET_ROWS = 5_000
BATCH_BLOCKS = 50_000


def turns(parts: Mapping[str, int]) -> Iterator[tuple[str, int]]:
    """Source and block (from 0) of one slot after the other, without end: earliest deadline first among the released, ties by source."""
    q = sum(parts.values())
    waiting = [(0, -(-q // a), s, 1) for s, a in sorted(parts.items()) if a > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, deadline, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, k))
        deadline, s, k = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a deadline was missed")
        yield s, k - 1
        heapq.heappush(waiting, (k * q // parts[s], -(-(k + 1) * q // parts[s]), s, k + 1))
        slot += 1


def period_slots(parts: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period of ``sum(parts)`` slots."""
    out: dict[str, list[int]] = {s: [] for s in parts}
    for slot, (s, _) in enumerate(islice(turns(parts), sum(parts.values()))):
        out[s].append(slot)
    return out


def places(blocks: Mapping[str, int], parts: Mapping[str, int]) -> Iterator[tuple[int, str, int]]:
    """Phase, source and block of each slot until all blocks are used up. A phase ends with the slot in which its first source runs out."""
    left, phase = {s: n for s, n in blocks.items() if n}, 0
    first = dict.fromkeys(left, 0)
    while left:
        for s, k in turns({s: parts[s] for s in left}):
            yield phase, s, first[s] + k
            left[s] -= 1
            if not left[s]:
                break
        first = {s: blocks[s] - n for s, n in left.items()}
        left = {s: n for s, n in left.items() if n}
        phase += 1


class Phase(NamedTuple):
    """``periods`` repeats of so many blocks (``parts``), from block ``first[source]`` of each source and slot ``slot`` on."""

    parts: dict[str, int]
    periods: int
    first: dict[str, int]
    slot: int


def phases(blocks: Mapping[str, int], parts: Mapping[str, int]) -> list[Phase]:
    """What each phase of ``places`` uses up."""
    used: list[Counter] = []
    for phase, s, _ in places(blocks, parts):
        if phase == len(used):
            used.append(Counter())
        used[phase][s] += 1
    out, first, slot = [], Counter(), 0
    for own in used:
        out.append(Phase(dict(own), 1, {s: first[s] for s in own}, slot))
        first += own
        slot += own.total()
    return out


def whole_parts(weights: Mapping[str, float]) -> dict[str, int]:
    """Weights as whole parts of a common denominator, without rounding."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    whole = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * whole) for s, w in exact.items()}


def _schedule(weights: Mapping[str, float], exponent: float, block_docs: int):
    """Batches of source and documents to the slot and the first document's position of each block, worked out in a task as they are read."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = {s: n for batch in batches for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}
        if not counted:
            return
        parts = whole_parts({s: weights.get(s, min(weights.values())) if weights else n**exponent for s, n in counted.items()})
        at, slot, turn = 0, 0, places({s: -(-n // block_docs) for s, n in counted.items()}, parts)
        while some := list(islice(turn, BATCH_BLOCKS)):
            rows = []
            for _, s, k in some:
                rows.append((s, k, slot, at))
                at, slot = at + min(block_docs, counted[s] - k * block_docs), slot + 1
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["s", "block", "slot", "at"])

    return deal


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", *, exponent: float = 0.5, block_docs: int = 16, position: str = "position", slot: str = "slot") -> DataFrame:
    """``docs`` with the place of each document in the mix (``position``, from 0, without gaps) and its block's slot.

    weights: target weight of each source; without, a source of n documents weighs ``n ** exponent``.
    Within a source documents follow a hash of their ids and places in their files. No document is dropped or repeated: the
    targets hold as long as all sources last, then among those that are left.

    Defined cases: a null source is a source of its own; a source without a given weight (or one of 0 or less) weighs as much as
    the least of the given; null and repeated ids are spread and placed like others; an empty table gives an empty
    result. Columns named like the two new ones are replaced; any other names are left alone.
    """
    kept = [c for c in docs.columns if c not in (position, slot)]
    rows, place = numbered(docs)
    named = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    # files written by Spark have a random name after their number
    file = F.regexp_replace(F.col("_metadata.file_name"), "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "") if rows is docs else F.lit("")
    spread = F.shiftrightunsigned(F.xxhash64(F.col(id_col), file, place["row"], F.lit("mix")), 33)
    d = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), named.alias("s"), spread.alias("h"), place["row"].alias("row"))

    counted = cut(d.groupBy("s").agg(F.count("*").alias("n")))
    given = {f"s{k}": w for k, w in (weights or {}).items() if w > 0}
    placed = counted.repartition(1).mapInArrow(_schedule(given, exponent, block_docs), "s string, block bigint, slot bigint, at bigint")

    buckets = (counted.agg(F.max("n")).first()[0] or 0) // BUCKET_ROWS + 1
    d = d.withColumn("bucket", F.shiftright(F.col("h") * buckets, 31).cast("int"))
    sizes = d.groupBy("s", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("s", "bucket", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # the blocks of a bucket travel as one array, so documents are not shuffled again to meet them
    block = lambda rank: F.floor(rank / block_docs)
    own = offsets.select("s", "bucket", "before", F.explode(F.sequence(block(F.col("before")), block(F.col("before") + F.col("n") - 1))).alias("block"))
    own = own.join(placed, ["s", "block"]).groupBy("s", "bucket").agg(F.min("before").alias("before"), F.sort_array(F.collect_list(F.struct("block", "slot", "at"))).alias("places"))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("s", "bucket").orderBy("h", "row"))).join(own, ["s", "bucket"])
    rank = F.col("before") + F.col("rank") - 1
    found = F.get("places", (block(rank) - block(F.col("before"))).cast("int"))
    return d.select("doc.*", (found["at"] + rank % block_docs).alias(position), found["slot"].alias(slot))
