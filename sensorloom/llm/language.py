"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``order`` bytes is counted on a
bounded sample of labelled texts and then frozen. A byte costs
``-log2`` of its probability in the longest known context; an unseen byte
escapes to the next shorter one (method C: a context with n bytes of d kinds
escapes with d / (n + d)), without the bytes that the longer context has
seen. As the statistics don't change, all of this is worked out once into
a table (context, byte, language) -> bits, and scoring a text is looking up each of
its bytes: the code length of the whole text under every language at once.

Any number of languages is learned: they are taken in blocks with a table each, and
the trees of a block are cut back until all tables together keep within ``TABLE_BYTES``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, pieces, utf8


#: Languages of a table; bytes of all tables together; bytes of all samples together; of the one text of a language that has no shorter one.
BLOCK_LANGS, TABLE_BYTES, SAMPLE_BYTES, ONE_TEXT_BYTES = 32, 256 << 20, 64 << 20, 16 << 20


class NoLabelledText(ValueError):
    """There is nothing to learn from."""


class PpmModel:
    """Frozen code lengths. ``symbol``: byte to symbol, 0 is the start of a text; ``state``: last three symbols to a context; ``bits``: (context * symbols + symbol, language)."""

    def __init__(self, langs: list[str], symbol: np.ndarray, state: np.ndarray, bits: np.ndarray):
        self.langs, self.symbol, self.state, self.bits = langs, symbol, state, bits

    @property
    def size(self) -> int:
        return round(len(self.state) ** (1 / 3))

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in bits of each text (rows) under each language (columns)."""
        n, a = len(off) - 1, self.size
        out = np.zeros((n, len(self.langs)))
        for i, j in pieces(off):
            part, at = self.symbol[data[off[i] : off[j]]], off[i : j + 1] - off[i]
            pad = 3 * (np.repeat(np.arange(j - i), np.diff(at)) + 1)
            line = np.zeros(len(part) + 3 * (j - i), np.int32)
            line[np.arange(len(part)) + pad] = part
            context = self.state[(line[:-3] * a + line[1:-2]) * a + line[2:-1]]
            cost = np.take(self.bits, context.astype(np.int64) * a + line[3:], axis=0)
            starts = at[:-1] + 3 * np.arange(j - i)
            some = np.diff(at) > 0
            if some.any():
                total = np.add.reduceat(cost, starts[some], axis=0, dtype=np.float64)
                out[i:j][some] = total
        return out


def _counts(texts: list[bytes], symbol: np.ndarray, a: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each order 0..3: the distinct context-and-symbol keys of a language's sample, and their counts."""
    line = np.concatenate([np.concatenate([np.zeros(3, np.int64), symbol[np.frombuffer(t, np.uint8)].astype(np.int64)]) for t in texts])
    own = line[3:] > 0
    return {o: np.unique(sum(line[3 - k : len(line) - k] * a**k for k in range(o + 1))[own], return_counts=True) for o in range(4)}


class PpmModels:
    """Models of blocks of languages, in the order of their names."""

    def __init__(self, blocks: list[PpmModel]):
        self.blocks, self.langs = blocks, [x for b in blocks for x in b.langs]

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return np.concatenate([b.lengths(data, off) for b in self.blocks], axis=1)


def fit_blocks(samples: dict[str, list[bytes]], block_langs: int = BLOCK_LANGS, table_bytes: int = TABLE_BYTES) -> PpmModels:
    """A model of any number of languages, in tables of ``table_bytes`` together."""
    langs = sorted(samples)
    parts = [langs[i : i + block_langs] for i in range(0, len(langs), block_langs)]
    return PpmModels([fit_ppm({x: samples[x] for x in part}, most_bytes=table_bytes // len(parts)) for part in parts])


def fit_ppm(samples: dict[str, list[bytes]], min_context: int = 8, most_bytes: int = TABLE_BYTES) -> PpmModel:
    """The frozen model of labelled samples; contexts of fewer than ``min_context`` bytes over all languages are cut off the trees, and more where the table would have over ``most_bytes``."""
    langs = sorted(samples)
    seen = np.zeros(256, bool)
    for texts in samples.values():
        for t in texts:
            seen[np.unique(np.frombuffer(t, np.uint8))] = True
    k = int(seen.sum())
    a = k + 2  # start, the seen bytes, any other byte
    symbol = np.full(256, k + 1, np.int32)
    symbol[seen] = np.arange(1, k + 1)
    grams = {x: _counts(samples[x], symbol, a) for x in langs}

    found = [(np.zeros(1, np.int64), np.full(1, np.inf))]
    for o in range(1, 4):
        keys = np.concatenate([grams[x][o][0] // a for x in langs])
        weight = np.concatenate([grams[x][o][1] for x in langs])
        c, inverse = np.unique(keys, return_inverse=True)
        found.append((c, np.bincount(inverse, weight)) if len(c) else (c, c))
    while True:  # a context occurs at least as often as each longer one: shorter ones stay as long as any that needs them
        contexts = [c[n >= min_context] for c, n in found]
        if len(contexts[1]) == 0 or sum(map(len, contexts)) * a * len(langs) * 4 <= most_bytes:
            break
        min_context *= 2
    first = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
    bits = np.zeros((first[-1], a, len(langs)), np.float32)
    for column, lang in enumerate(langs):
        probability, escaped, counted = None, None, None
        for o, own in enumerate(contexts):
            count = np.zeros((len(own), a))
            keys, n = grams[lang][o]
            at = np.searchsorted(own, keys // a)
            known = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == keys // a) if len(own) else np.zeros(len(keys), bool)
            count[at[known], keys[known] % a] = n[known]
            some = count > 0
            total, kinds = count.sum(1, keepdims=True), some.sum(1, keepdims=True)
            if o == 0:
                below = np.full((1, a), 1 / max(1, 256 - int(kinds[0, 0])))
            else:
                up = np.searchsorted(contexts[o - 1], own % a ** (o - 1))
                rest = np.where(some, 0, counted[up])
                left, sorts = rest.sum(1, keepdims=True), (rest > 0).sum(1, keepdims=True)
                below = np.where(rest > 0, rest / np.maximum(left + sorts, 1), escaped[up] * np.where(sorts > 0, sorts / np.maximum(left + sorts, 1), 1))
            p = np.where(some, count / np.maximum(total + kinds, 1), below * kinds / np.maximum(total + kinds, 1))
            if o:  # a context that this language doesn't have is its next shorter one
                absent = total[:, 0] == 0
                p[absent], below[absent], count[absent] = probability[up][absent], escaped[up][absent], counted[up][absent]
            probability, escaped, counted = p, below, count
            bits[first[o] : first[o + 1], :, column] = -np.log2(np.maximum(p, 2.0**-40))
    bits[:, 0, :] = 0
    state = np.zeros(a**3, np.int32)
    every = np.arange(a**3, dtype=np.int64)
    for o in range(1, 4):
        tail = every % a**o
        at = np.minimum(np.searchsorted(contexts[o], tail), max(len(contexts[o]) - 1, 0))
        if len(contexts[o]):
            hit = contexts[o][at] == tail
            state[hit] = first[o] + at[hit]
    return PpmModel(langs, symbol, state, bits.reshape(-1, len(langs)))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, sample_docs: int = 400, sample_bytes: int = 1_500_000, held_out_of: int = 5) -> PpmModels:
    """Fit on whole texts of at most ``sample_docs`` documents and ``sample_bytes`` bytes of each language, less where all languages' samples would have over ``SAMPLE_BYTES``.

    Only rows count whose text and language are known and whose ``crc32(id) mod
    held_out_of`` is not 0. They are chosen by a hash of id and text, so the choice does not
    depend on the order of rows or on partitions: a count by language gives the share of
    hashes to read, sizes of those in the order of hashes give where the bound is reached, and only
    texts before that place come to the driver. A language all of whose texts are longer than the bound is learned
    from its shortest one. Raises ``NoLabelledText`` if there is no such row, and ``ValueError`` where a language has no text of up to ``ONE_TEXT_BYTES``.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("id").cast("string")) % held_out_of != 0))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("id", "text"), 1)).withColumn("size", F.octet_length("text").cast("long"))
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.struct("size", "h")).alias("least"))
    langs = {r["lang"]: (r["n"], r["least"]) for r in counted.collect()}  # a row for each language
    if not langs:
        raise NoLabelledText("no labelled text to learn from")
    bound = min(sample_bytes, SAMPLE_BYTES // len(langs))
    if too := sorted(x for x, (_, least) in langs.items() if least["size"] > max(bound, ONE_TEXT_BYTES)):
        raise ValueError(f"no text of up to {ONE_TEXT_BYTES} bytes in: {', '.join(too)}")
    top, spark = (1 << 63) - 1, docs.sparkSession
    # both tables of limits have a row for each language, which the driver holds anyway: broadcast, so that no text is shuffled
    share = spark.createDataFrame([(x, top if n <= 2 * sample_docs else top // n * 2 * sample_docs) for x, (n, _) in langs.items()], "lang string, most bigint")
    sized = rows.join(F.broadcast(share), "lang").where((F.col("h") <= F.col("most")) & (F.col("size") <= bound)).select("lang", "h", "size").distinct()
    running = Window.partitionBy("lang").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    sized = sized.select("lang", "h", F.count("*").over(running).alias("docs"), F.sum("size").over(running).alias("bytes"))
    last = sized.where((F.col("docs") <= sample_docs) & (F.col("bytes") <= bound)).groupBy("lang").agg(F.max("h").alias("last"))
    limits = {r["lang"]: (r["last"], bound) for r in last.collect()}
    # where no short text is among the hashes read: the first of the shortest
    wanted = [(x, 0, *limits[x]) if x in limits else (x, least["h"], least["h"], least["size"]) for x, (_, least) in langs.items()]
    wanted = spark.createDataFrame(wanted, "lang string, first bigint, last bigint, longest bigint")
    chosen = rows.join(F.broadcast(wanted), "lang").where(F.col("h").between(F.col("first"), F.col("last")) & (F.col("size") <= F.col("longest")))
    chosen = chosen.select("lang", "h", "text").dropDuplicates(["lang", "h"])  # repeated rows count once
    samples: dict[str, list[bytes]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return fit_blocks(samples)


def predict(model: PpmModel | PpmModels):
    """Column function: text to ``struct<lang_pred, score, bits_per_byte>``."""

    @F.arrow_udf("struct<lang_pred:string,score:double,bits_per_byte:double>")
    def ppm(texts: pa.Array) -> pa.Array:
        data, off = utf8(texts)
        bits = model.lengths(data, off)
        size = np.diff(off)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(best)), best]
        score = 1 / np.exp2(np.maximum(low[:, None] - bits, -200)).sum(axis=1)
        ascii_letter = np.zeros(256, np.int64)
        ascii_letter[65:91] = ascii_letter[97:123] = 1
        sums = np.concatenate([[0], np.cumsum(ascii_letter[data])])
        letter = sums[off[1:]] > sums[off[:-1]]
        for i in np.flatnonzero(~letter & (size > 0)).tolist():
            letter[i] = any(map(str.isalpha, bytes(data[off[i] : off[i + 1]]).decode("utf-8", "replace")))
        names = np.array([*model.langs, "und"], dtype=object)[np.where(letter, best, len(model.langs))]
        per = np.where(size > 0, low / np.maximum(size, 1), 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(per)], ["lang_pred", "score", "bits_per_byte"])

    return ppm


def rejected(found: Column, most_bits: float = 8.0) -> Column:
    """Whether a text has no language: no letter, or more than ``most_bits`` a byte even under the best language, so that spelling out its bytes is shorter."""
    return (found["lang_pred"] == "und") | (found["bits_per_byte"] > most_bits)


def identify(docs: DataFrame, model: PpmModel | PpmModels | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col, held_out, lang_pred, score, bits_per_byte`` of each row; learns from ``docs`` itself unless given a model.

    ``score`` is the posterior probability of the language under equal priors.
    Defined cases: ``und`` with score 0 for a null or empty text or one without a letter;
    a null id is not held out; ties between languages go to the first by name. Rows
    come back one by one, repeated ones too; other columns are not read. A table
    without labelled text, as an empty one, gives ``und`` for every row.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    held_out = F.coalesce(F.crc32(F.col("_id").cast("string")) % 5 == 0, F.lit(False))
    if model is None:
        try:
            model = learn(docs, id_col, text_col, lang_col)
        except NoLabelledText:
            return src.select(F.col("_id").alias(id_col), held_out.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    return src.select("_id", predict(model)("_text").alias("_p")).select(F.col("_id").alias(id_col), held_out.alias("held_out"), "_p.lang_pred", "_p.score", "_p.bits_per_byte")


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
