"""Hard-negative mining by a vertical scan of vectors.

Rows are packed into blocks that store their dimensions as columns, with each
column's least and greatest value. For an anchor, a block's columns are read in
the order of the anchor's descending magnitudes. The least and greatest that the
columns not yet read can add bound every row's score; rows that can no longer be among
those wanted leave the candidates, so later columns are read for few rows. What
stays has its exact score.

The anchors are a stated query set: blocks of them meet blocks of all rows. Both
scans keep, for each anchor, only the best rows of a task, and a grouping by anchor keeps the best of
all tasks. Nothing is collected.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, numbered
from .whitening import EXACT, usable

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
LEAST_PERCENT, MOST_PERCENT = 30, 90
#: Rows of a block, anchors of a block, columns read between two looks at the candidates, anchor blocks whose best rows a task holds at once.
BLOCK_ROWS, BLOCK_ANCHORS, STRIDE, HELD = 4096, 128, 8, 32
_PACKED = "length int, block binary"
_ROW = "id bigint, label bigint, file bigint, row bigint, vector array<double>"


def whole(vectors: pa.Array, length: int, scale: int) -> np.ndarray:
    """``floor(scale * entry)``, a column a vector: doubles where every score is a whole number that doubles hold, else Python's whole numbers."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    x = np.ascontiguousarray(np.floor(scale * flat.astype(np.float64)).reshape(-1, length).T)
    if np.abs(x).max(initial=0) ** 2 * length < EXACT:
        return x
    return np.array([[int(v) for v in np.floor(row)] for row in x], object)


def packed(rows: DataFrame, size: int, scale: int, *more: str) -> DataFrame:
    """``length, block``: up to ``size`` rows of one length as pickled columns; those of ``more`` stay lists."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                held.setdefault(length, []).append(batch.filter(pa.array(lengths == length)))
                if sum(b.num_rows for b in held[length]) >= size:
                    yield from blocks(length, held.pop(length))
        for length, own in held.items():
            yield from blocks(length, own)

    def blocks(length: int, own: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(own).combine_chunks()
        for at in range(0, len(table), size):
            part = table.slice(at, size).combine_chunks()
            x = whole(part.column("vector").combine_chunks(), length, scale)
            block = {c: part.column(c).to_numpy() for c in ("label", "file", "row")} | {"none": part.column("id").is_null().to_numpy(), "id": part.column("id").fill_null(0).to_numpy(), "x": x}
            block |= {"low": x.min(1), "high": x.max(1)} | {c: part.column(c).to_pylist() for c in more}
            yield pa.record_batch([pa.array([length], pa.int32()), pa.array([pickle.dumps(block, 5)], pa.binary())], ["length", "block"])

    return rows.mapInArrow(pack, _PACKED)


def best(k: int, score: np.ndarray) -> object:
    """The ``k``-th largest of at least ``k`` scores, else None."""
    return np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else None


def scan(anchor: np.ndarray, block: dict, candidates: np.ndarray, wanted: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates, and their exact scores, that may be among the best ``k`` of a range of scores.

    wanted: ``low, high, floor`` of each range: its ends (None where it is open) and the ``k``-th best
    score found for it so far (None if there are not as many). A row leaves when in every range its bounds lie outside it or under the
    ``k``-th best of what is surely inside; equal scores stay, as ids decide on them.
    """
    x, order = block["x"], np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * block["low"], anchor * block["high"]])[:, order]
    rest = [np.concatenate([np.cumsum(e[::-1])[::-1], e[:1] * 0]) for e in (ends.min(0), ends.max(0))]
    at = np.flatnonzero(candidates)
    score = np.zeros(len(at), x.dtype if x.dtype == anchor.dtype else object)
    own, rows = x, at
    for first in range(0, len(order), STRIDE):
        columns = order[first : first + STRIDE]
        score = score + anchor[columns] @ own[np.ix_(columns, rows)]
        low, high = score + rest[0][first + len(columns) if first + len(columns) < len(order) else -1], score + rest[1][first + len(columns) if first + len(columns) < len(order) else -1]
        stays = np.zeros(len(at), bool)
        for least, most, floor in wanted:
            inside = np.ones(len(at), bool) if least is None else (high >= least) & (low <= most)
            sure = inside if least is None else inside & (low >= least) & (high <= most)
            for bar in (floor, best(k, low[sure])):
                if bar is not None:
                    inside &= high >= bar
            stays |= inside
        at, rows, score = at[stays], rows[stays], score[stays]
        if not len(at):
            break
    return at, score


def searched(rows: DataFrame, anchors: DataFrame, groups: int, k: int, per_range: bool) -> DataFrame:
    """``anchor_file, anchor_row, place, score, id, file, row``: for every anchor (and every range of it) the best ``k`` rows of each task. Ranges are those of the anchors' column ``ranges``; without them the rows of the anchor's own label but itself are searched."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for a_name, a_blob, b_blob in zip(*(batch.column(c).to_pylist() for c in ("name", "anchor", "block")), strict=True):
                block, those = pickle.loads(b_blob), pickle.loads(a_blob)
                if a_name not in held and len(held) >= HELD:
                    yield from told(held)
                found = held.setdefault(a_name, {})
                for i in range(len(those["id"])):
                    same = block["label"] == those["label"][i]
                    if per_range:
                        keys, ranges, fits = range(len(those["ranges"][i])), [(r["low"], r["high"]) for r in those["ranges"][i]], ~same
                    else:
                        keys, ranges, fits = [0], [(None, None)], same & ~((block["file"] == those["file"][i]) & (block["row"] == those["row"][i]))
                    if not fits.any():
                        continue
                    tops = [found.setdefault((int(those["file"][i]), int(those["row"][i]), key), []) for key in keys]
                    wanted = [(low, high, top[-1][0] * -1 if len(top) == k else None) for (low, high), top in zip(ranges, tops, strict=True)]
                    at, score = scan(those["x"][:, i], block, fits, wanted, k)
                    for (low, high, floor), top in zip(wanted, tops, strict=True):
                        here = np.ones(len(at), bool) if low is None else (score >= low) & (score <= high)
                        if floor is not None:
                            here &= score >= floor
                        if here.any():
                            top += [(-int(score[j]), bool(block["none"][m]), int(block["id"][m]), int(block["file"][m]), int(block["row"][m])) for j, m in zip(np.flatnonzero(here), at[here], strict=True)]
                            top.sort()
                            del top[k:]
        yield from told(held)

    def told(held: dict) -> Iterator[pa.RecordBatch]:
        lines = [(*key, -t[0], None if t[1] else t[2], t[3], t[4]) for found in held.values() for key, top in found.items() for t in top]
        held.clear()
        if lines:
            names = ["anchor_file", "anchor_row", "place", "score", "id", "file", "row"]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*lines, strict=True)], names)

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)))
    named = anchors.select("length", F.xxhash64("block").alias("name"), F.col("block").alias("anchor"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("part"))
    pairs = dealt.join(named, ["part", "length"]).select("name", "anchor", "block")
    return pairs.mapInArrow(look, "anchor_file bigint, anchor_row bigint, place bigint, score bigint, id bigint, file bigint, row bigint")


def first(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` by anchor and range, with ``rank`` from 1."""
    order = Window.partitionBy("anchor_file", "anchor_row", "place").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "file", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label_column: str = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT, anchors_of: int = 100, shift_of: int = 7, labels: int = 10) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for every anchor and each of its positives the best negatives.

    An entry counts as ``floor(scale * entry)``, a score is the whole-number inner product with the
    anchor. Anchors are rows whose id is divisible by ``anchors_of``; positives are an anchor's best other rows of
    its label, negatives the best rows of another label whose score is ``least_percent`` to ``most_percent`` hundredths of the positive's. Higher
    scores come first, of equal ones the smaller id, null ids last. Where an id is divisible by ``shift_of``, the
    label first becomes ``(label + 1) % labels``.

    Rows with a null label, a null or empty vector, or null, NaN or infinite entries, take no part. A null id is no anchor
    but may be found. Repeated rows are rows like others: a copy of an anchor is one of its positives, and an anchor that
    stands twice has its lists twice. Vectors of different lengths don't meet. Scores beyond a long are an error, not a
    wrong number. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    given, place = numbered(vectors)
    plain = given.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{column}`").alias("_vector"), F.col(f"`{label_column}`").alias("_label"), place.alias("_place")).where(F.col("_label").isNotNull())
    shifted = F.when(F.col("_id") % shift_of == 0, (F.col("_label") + 1) % labels).otherwise(F.col("_label"))
    rows = usable(plain.withColumn("_key", F.struct("_id", shifted.alias("label"), "_place")), "_key", "_vector")
    rows = rows.select(F.col("id._id").cast("bigint").alias("id"), F.col("id.label").cast("bigint").alias("label"), F.col("id._place.file").alias("file"), F.col("id._place.row").alias("row"), "vector").where(F.size("vector") > 0)
    anchors = rows.where(F.col("id") % anchors_of == 0)
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = packed(rows, BLOCK_ROWS, scale)

    found = cut(first(searched(blocks, packed(anchors, BLOCK_ANCHORS, scale), groups, positives, False), positives))
    share = lambda p: F.lit(p) * F.col("score").cast("decimal(30,0)") / 100
    ends = F.ceil(share(least_percent)).cast("bigint").alias("low"), F.floor(share(most_percent)).cast("bigint").alias("high")
    ranges = found.groupBy("anchor_file", "anchor_row").agg(F.sort_array(F.collect_list(F.struct("rank", *ends))).alias("ranges"))
    ready = anchors.join(ranges, (anchors["file"] == ranges["anchor_file"]) & (anchors["row"] == ranges["anchor_row"])).select(*anchors.columns, "ranges")
    mined = first(searched(blocks, packed(ready, BLOCK_ANCHORS, scale, "ranges"), groups, negatives, True), negatives)

    own = anchors.select(F.col("file").alias("anchor_file"), F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    ids = found.join(own, ["anchor_file", "anchor_row"]).select("anchor_file", "anchor_row", (F.col("rank") - 1).cast("bigint").alias("place"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mined.join(ids, ["anchor_file", "anchor_row", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle_sql() -> str:
    return f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, a.vec_id = r.vec_id AS self,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM (SELECT * FROM r WHERE vec_id % 100 = 0) a, r),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND NOT self
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS "rank",
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {LEAST_PERCENT} * p.positive_score <= 100 * s.score AND 100 * s.score <= {MOST_PERCENT} * p.positive_score
QUALIFY "rank" <= {NEGATIVES}
"""
