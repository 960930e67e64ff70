"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, components.

A text's words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; its set holds
the 64-bit hashes of its distinct runs of ``shingle_words`` words, or of the whole
sequence where it has fewer. Two documents are linked where
``100 * intersection >= threshold * union``, and classes are the connected
components of the links.

1. One pass computes each document's set size, a 128-bit key of the set and
   ``bands`` hashes of its SuperMinHash signature. Equal sets become one node by
   a pre-aggregated grouping, so groups of exact copies cost one row a partition.
2. Nodes that share a band meet in a bucket. A bucket is never expanded into
   pairs: each member is compared with one centre, the member that stands for most
   copies, and the comparison is exact, on the full sets.
3. Members that are not linked with their centre may be linked with each other
   or with a member that is. For sets x and y around a centre c, with
   ``need(z) = t/(100+t) * (|c|+|z|) - |c & z|``, a link of x and y needs
   ``need(x) + need(y) + |c| * (100-t)/(100+t)`` common elements among their
   differences from c. That is a set-overlap join, solved exactly with prefixes
   of the differences (elements outside c first, as these are rare), and only
   between nodes that are not yet in one component. Its candidates are verified
   on the whole differences, which is the same as on the full sets.

Pairs at the threshold share none of the 24 bands with a probability below
4e-6. Elements are 64-bit hashes and set keys have 128 bits; but for their
collisions, every other step is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK_SEPARATED, LOWER, WordHasher, bound_batches, cut, distinct_by_row, list_array, mix, pieces, release, row_sums, shingles, utf8, word_spans
from .graph import components

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _offset(i: int) -> np.uint64:
    return np.uint64(i * int(_STEP) & (1 << 64) - 1)


def superminhash(items: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signatures, rows x ``size``; infinite for rows without items.

    Every item walks a random permutation of the slots; its j-th step offers a
    value in [j, j+1) to its j-th slot. A row is done once all its slots are below the
    next step, which long rows reach after one or two steps.
    """
    rows = len(counts)
    sig = np.full(rows * size, np.inf)
    row = np.repeat(np.arange(rows), counts)
    state = items.astype(np.uint64)
    order = None
    for j in range(size):
        if not len(row):
            break
        draw = mix(state + _offset(2 * j + 1))
        pick = j + ((mix(state + _offset(2 * j + 2)) >> np.uint64(32)) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
        at = np.arange(len(row))
        slot = pick if order is None else order[at, pick]
        np.minimum.at(sig, row * size + slot, (draw >> np.uint64(11)) * 2.0**-53 + j)
        live = (sig.reshape(rows, size).max(axis=1) > j + 1)[row]
        if order is None:
            order = np.tile(np.arange(size, dtype=np.int16), (int(live.sum()), 1))
            order[np.arange(len(order)), pick[live]] = 0
        else:
            order[at, pick] = order[:, j]
            order = order[live]
        row, state = row[live], state[live]
    return sig.reshape(rows, size)


def shingle_sets(data: np.ndarray, off: np.ndarray, hasher: WordHasher, k: int) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    start, end, row = word_spans(low, off, BLANK_SEPARATED)
    words = hasher(low, start, end)
    return distinct_by_row(*shingles(words, np.bincount(row, minlength=len(off) - 1), k))


def set_keys(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 128-bit key of each set: two independent sums of mixed elements, and the size."""
    one = mix(row_sums(mix(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)), counts) + counts.astype(np.uint64))
    two = mix(row_sums(mix(items + np.uint64(0x2545F4914F6CDD1D)), counts) ^ counts.astype(np.uint64))
    return np.stack([one, two], axis=1)


def _key_array(keys: np.ndarray, counts: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(keys).tobytes()
    return pa.array([raw[16 * i : 16 * i + 16] if c else None for i, c in enumerate(counts.tolist())], pa.binary())


def _sketch(shingle_words: int, bands: int, rows: int):
    @F.arrow_udf("struct<n:bigint,key:binary,bands:array<bigint>>")
    def sketch(texts: pa.Array) -> pa.Array:
        hasher, out = WordHasher(), []
        data, off = utf8(texts)
        for i, j in pieces(off):
            items, counts = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], hasher, shingle_words)
            sig = superminhash(items, counts, bands * rows).view(np.uint64).reshape(len(counts), bands, rows)
            h = np.arange(bands, dtype=np.uint64)[None, :] * _STEP
            for r in range(rows):
                h = mix(h * np.uint64(3) + sig[:, :, r])
            some = counts > 0
            banded = list_array(h[some].astype(np.int64).ravel(), np.where(some, bands, 0), pa.int64())
            out.append(pa.StructArray.from_arrays([pa.array(counts, pa.int64()), _key_array(set_keys(items, counts), counts), banded], ["n", "key", "bands"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))]))

    return sketch


def _sets(shingle_words: int):
    @F.arrow_udf("array<bigint>")
    def sets(texts: pa.Array) -> pa.Array:
        hasher, out = WordHasher(), []
        data, off = utf8(texts)
        for i, j in pieces(off):
            items, counts = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], hasher, shingle_words)
            out.append(list_array(items.astype(np.int64), counts, pa.int64()))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))

    return sets


def _usual_tokens(share: int = 8, least: int = 16):
    """Batches of ``c, salt, d`` to ``c, token``: the tokens in an eighth or more of the differences of a batch's rows with one ``c`` and ``salt``, where these are 16 or more. Memory is that of a batch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centre, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            group = np.cumsum(np.concatenate([[False], (centre[1:] != centre[:-1]) | (salt[1:] != salt[:-1])])[: len(centre)])
            around = np.bincount(group) if len(group) else np.zeros(0, np.int64)
            d = batch.column(2)
            of, token = np.repeat(group, np.diff(d.offsets.to_numpy())), d.flatten().to_numpy(zero_copy_only=False)
            large = around[of] >= least
            of, token = of[large], token[large]
            order = np.lexsort((token, of))
            of, token = of[order], token[order]
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (token[1:] != token[:-1])])) if len(of) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(of)))
            first = first[times * share >= around[of[first]]]
            yield pa.RecordBatch.from_arrays([pa.array(centre[np.searchsorted(group, of[first])], pa.int64()), pa.array(token[first], pa.int64())], ["c", "token"])

    return task


def _compared(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``x, c, need, nc, linked, d`` of pairs: ``need`` as in step 3, times ``100 + threshold``, and the elements ``d`` that are in one of the sets only."""
    x = sets.select(F.col("nid").alias("x"), F.col("items").alias("xs"))
    c = sets.select(F.col("nid").alias("c"), F.col("items").alias("cs"))
    both = pairs.join(x, "x").join(c, "c")
    plus, minus = F.array_except("xs", "cs"), F.array_except("cs", "xs")
    both = both.select("x", "c", F.size("xs").cast("long").alias("nx"), F.size("cs").cast("long").alias("nc"), plus.alias("plus"), minus.alias("minus"))
    need = threshold * (F.col("nc") + F.col("nx")) - (100 + threshold) * (F.col("nc") - F.size("minus"))
    return both.select("x", "c", need.alias("need"), "nc", (need <= 0).alias("linked"), F.concat(F.array_sort("plus"), F.array_sort("minus")).alias("d"))


def _with_partner(token: DataFrame, key: list[str], threshold: int) -> DataFrame:
    """The rows of ``token`` that may have a partner: under their key there is a node of the other class, two roots, and room for all that the row and the least need of that class need."""
    whole, base = 100 + threshold, (100 - threshold) * F.col("nc")
    of = lambda f, value, side: f(F.when(F.col("class") == F.col(side), F.col(value))).alias(f"{value}_{side}")
    sides = [of(f, value, side) for f, value in ((F.min, "need"), (F.max, "left")) for side in ("low", "high")]
    shared = token.groupBy(*key).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *sides).where("lo <> hi and need_low is not null and need_high is not null")
    its = lambda value: F.when(F.col("class") == F.col("low"), F.col(f"{value}_high")).otherwise(F.col(f"{value}_low"))
    room = F.least("left", its("left")) * whole >= F.col("need") + its("need") + base
    return token.join(shared, key).where(room).select(*token.columns)


def _around_centres(checked: DataFrame, roots: DataFrame, threshold: int) -> DataFrame:
    """Links ``a, b`` of nodes around one centre that are in different components (step 3).

    Nodes are in classes by their need, so that a prefix is as short as the least need that a
    member of the partner's class has allows: a node has a prefix for each class around its centre, and two nodes
    meet under the pair of their classes. Nodes that are linked with the centre are in one component and
    not compared with each other. Around a centre with many nodes, elements in
    which an eighth of them or more differ from it come last in every prefix. The members of the
    largest component around a centre are compared with those of others only.
    """
    whole = 100 + threshold
    need, base = F.col("need"), (100 - threshold) * F.col("nc")
    kind = F.when(need <= 0, 0).when(need <= base, 1).when(2 * need <= 5 * base, 2).otherwise(3)
    member = checked.select("x", "c", "need", kind.alias("class")).join(roots.select(F.col("node").alias("x"), "root"), "x", "left")
    member = cut(member.select("x", "c", "need", "class", F.coalesce("root", "x").alias("root")))
    # members of a large group lie in parts of some hundreds, in which frequent elements can be told
    by_root = member.groupBy("c", "root").agg(F.count("*").alias("n"), *[F.min(F.when(F.col("class") == k, need)).alias(f"least_{k}") for k in range(4)])
    classes = F.array(*[F.struct(F.lit(k).alias("partner"), F.min(f"least_{k}").alias("its_least")) for k in range(4)])
    open_ = by_root.groupBy("c").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root"))["root"].alias("main"), classes.alias("classes"), F.sum("n").alias("around")).where("roots > 1")
    member = member.join(cut(open_), "c").select("x", "c", "root", "class", "classes", (F.col("root") != F.col("main")).alias("minor"), F.pmod(F.xxhash64("x"), F.floor(F.col("around") / 256) + 1).alias("salt"))
    differ = checked.select("x", "c", "need", "nc", "d").join(member, ["x", "c"])
    differ = cut(differ.repartition("c", "salt").sortWithinPartitions("c", "salt"))

    usual = differ.select("c", "salt", "d").mapInArrow(_usual_tokens(), "c bigint, token bigint").groupBy("c").agg(F.collect_set("token").alias("usual"))
    last = F.coalesce("usual", F.array().cast("array<bigint>"))
    ordered = differ.join(cut(usual), "c", "left").withColumn("d", F.concat(F.array_except("d", last), F.array_intersect("d", last)))
    least = F.greatest(F.lit(1), F.ceil((need + F.col("its_least") + base) / whole))
    each = ordered.select("*", F.inline("classes")).where("its_least is not null and class + partner > 0").withColumn("prefix", (F.size("d") - least + 1).cast("int")).where("prefix > 0")
    own = ["x", "c", "root", "minor", "class", "need", "nc"]
    token = each.select(*own, F.size("d").alias("size"), F.least("class", "partner").alias("low"), F.greatest("class", "partner").alias("high"), F.posexplode(F.slice("d", F.lit(1), F.col("prefix"))).alias("at", "token"))
    token = cut(token.select(*own, "low", "high", "token", (F.col("size") - F.col("at")).alias("left")))
    key = ["c", "token", "low", "high"]
    token = cut(_with_partner(token, key, threshold))
    other = token.select(*key, *[F.col(x).alias(f"its_{x}") for x in ("x", "root", "minor", "class", "need", "left")])
    # the first common element of a link leaves room for all that it needs
    wanted = need + F.col("its_need") + base
    room = F.least("left", "its_left") * whole >= wanted
    once = ~F.col("its_minor") | (F.col("x") < F.col("its_x"))
    pair = token.where("minor").join(other, key).where((F.col("root") != F.col("its_root")) & once & (F.col("class") + F.col("its_class") == F.col("low") + F.col("high")) & room)
    pair = cut(pair.groupBy("x", F.col("its_x").alias("y")).agg(F.min("c").alias("c")))
    y = differ.select(F.col("x").alias("y"), "c", F.col("need").alias("its_need"), F.col("d").alias("its_d"))
    found = pair.join(differ.select("x", "c", "need", "nc", "d"), ["x", "c"]).join(y, ["y", "c"])
    return found.where(F.size(F.array_intersect("d", "its_d")) * whole >= wanted).select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 5, threshold: int = 80, bands: int = 24, rows: int = 4) -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id, kept, text_hash``.

    ``component_id`` is the smallest id reachable over links, ``kept`` whether
    it is the row's own; ``text_hash`` is ``xxhash64`` of the text, to find the row
    again where ids repeat.

    Defined cases: a null or empty text, or one without words, has an empty set and
    is linked with nothing. Rows with a null id are linked by their texts like
    others but never give a component its id; a component of such rows alone has a
    null ``component_id`` and its rows are kept. Repeated rows come back as often
    as they came in, with equal results. Equal ids with different texts are
    different documents of the graph. Other columns of ``docs`` are not read.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sk = cut(src.select("id", F.xxhash64("text").alias("text_hash"), _sketch(shingle_words, bands, rows)("text").alias("s")).select("id", "text_hash", "s.*"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    nodes = sk.where("n > 0").groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("nid"), "key", F.col("first.id").alias("min_id"), F.col("first.text_hash").alias("text_hash"), "copies", "bands"))

    # the centre of a bucket is its most copied member, ties by a hash, so that buckets of like members choose alike
    rank = F.shiftleft(F.least("copies", F.lit((1 << 20) - 1)), 43) + F.shiftrightunsigned(F.xxhash64("key"), 21)
    entries = nodes.select("nid", rank.alias("rank"), F.explode("bands").alias("h"))
    buckets = cut(entries.groupBy("h").agg(F.count("*").alias("size"), F.max_by("nid", "rank").alias("c")).where("size > 1").select("h", "c"))
    stars = cut(entries.select(F.col("nid").alias("x"), "h").join(buckets, "h").where("x <> c").select("x", "c").distinct())

    wanted = stars.select(F.explode(F.array("x", "c")).alias("nid")).distinct().join(nodes.select("nid", "min_id", "text_hash"), "nid")
    text = src.join(wanted, F.col("id").eqNullSafe(F.col("min_id")) & (F.xxhash64("text") == F.col("text_hash")))
    sets = cut(text.select("nid", _sets(shingle_words)("text").alias("items")).groupBy("nid").agg(F.first("items").alias("items")))

    release(src.sparkSession)
    checked = cut(_compared(stars, sets, threshold))
    del text, sets
    release(src.sparkSession)
    links = checked.where("linked").select(F.col("x").alias("a"), F.col("c").alias("b"))
    roots = components(links, rounds=1)  # what it leaves apart is only compared in vain
    more = cut(_around_centres(checked, roots, threshold))
    release(src.sparkSession)
    roots = components(links.union(more))
    release(src.sparkSession)

    linked = nodes.select("nid", "min_id").join(roots, F.col("nid") == F.col("node"))
    linked = linked.join(linked.groupBy("root").agg(F.min("min_id").alias("first")), "root").select("nid", "first")
    label = cut(nodes.select("nid", "key", "min_id").join(linked, "nid", "left").select("key", F.coalesce("first", "min_id").alias("component_id")))
    out = sk.select("id", "n", "key", "text_hash").join(label, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"), "text_hash")
