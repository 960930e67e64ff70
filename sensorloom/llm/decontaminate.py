"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of 128 words that overlap by half, and benchmark
items into parts of at most 64 words, so that a copy of a part lies whole in
a passage. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.

1. Document frequencies of the benchmark's words over half passages of all documents.
   Features are its rare words, and the rarest of each part even if not rare.
2. Randomised SVD of the TF-IDF matrix A of all passages, with the benchmark's parts as
   further rows: each task sums A'(A W) for a random W over its passages, Spark sums those,
   and the small factors give the right singular vectors and values.
3. Cosine search: passages with a feature are projected. An index from words to parts names
   the parts that a passage may hold: to have ``paraphrase`` of a part's words, it must have one of its
   rarest ``1 - paraphrase``. Those over ``min_cosine`` are candidates.
4. Each candidate is checked on its words: longest common subsequence with the part, and
   whether the part's answer, its last words, stands in the passage. A pair counts if the subsequence
   has ``verbatim`` of the part's words, or ``paraphrase`` of them and the answer.

Each pass over the documents is a narrow map. The benchmark is worked through in blocks of
``block_parts`` parts, with three passes over the documents each, and the latent space has ``rank``
dimensions at most; these bound what is sent to the tasks and what the driver factorises. Words that
no part has are no features: they can't help a passage over the check on common words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHasher, bound_batches, pieces, utf8, word_spans
from .licenses import WORD_BYTES

HALF = 64
COLUMNS = 32
MATCHES = "array<struct<item_id:bigint,first_word:bigint,cosine:double,lcs_share:double,answer:boolean>>"


class Settings(NamedTuple):
    min_cosine: float = 0.3
    verbatim: float = 0.8
    paraphrase: float = 0.5
    answer_words: int = 5
    rare: float = 0.005
    rarest_of_part: int = 8
    item_weight: float = 100.0
    rank: int = 256
    oversample: int = 24
    seed: int = 7


class Words:
    """Hashes of words to their numbers, -1 for others; a table of the top bits turns most others away."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.top = np.zeros(1 << 20, bool)
        self.top[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.top[(h >> np.uint64(44)).astype(np.int64)])
        if len(maybe) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            out[maybe] = np.where(self.hashes[at] == h[maybe], self.order[at], -1)
        return out


class Text(NamedTuple):
    """Word numbers of a piece of texts, the row of each word, words by row and where each row starts."""

    token: np.ndarray
    row: np.ndarray
    n: np.ndarray
    start: np.ndarray


def _read(data: np.ndarray, off: np.ndarray, hasher: WordHasher, words: Words) -> Text:
    low = LOWER[data]
    start, end, row = word_spans(low, off, WORD_BYTES)
    n = np.bincount(row, minlength=len(off) - 1)
    return Text(words(hasher(low, start, end)), row, n, np.cumsum(n) - n)


def _passages(text: Text, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and number of each passage with a feature; then passage, feature and count of each entry, by passage: ``(keys, passage, feature, count)``."""
    token = feature[text.token]  # the last entry of feature, for -1, is -1
    at = np.flatnonzero(token >= 0)
    row = text.row[at]
    block = (at - text.start[row]) // HALF
    last = np.maximum(-(-text.n[row] // HALF) - 2, 0)
    keys = np.concatenate([(row << 32) + np.minimum(block, last), ((row << 32) + block - 1)[(block > 0) & (block - 1 < np.minimum(block, last))]])
    own = np.concatenate([token[at], token[at][(block > 0) & (block - 1 < np.minimum(block, last))]])
    size = len(feature)
    names, passage = np.unique(keys, return_inverse=True)
    entry, count = np.unique(passage * size + own, return_counts=True)
    return names, entry // size, entry % size, count


def _weights(passage: np.ndarray, feature: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF entries; each passage has length 1."""
    w = (1 + np.log(count)) * idf[feature]
    norm = np.sqrt(np.bincount(passage, w * w))
    return (w / norm[passage]).astype(np.float32)


def _by_passage(values: np.ndarray, passage: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    return np.add.reduceat(values, first, axis=0)


def _some(passage: np.ndarray, most: int = 1 << 13) -> Iterator[slice]:
    """Slices of about ``most`` entries that end with a passage, so that rows of dense vectors for them stay few; a passage has at most twice ``HALF`` entries."""
    a = 0
    while a < len(passage):
        b = int(np.searchsorted(passage, passage[min(a + most, len(passage)) - 1], side="right"))
        yield slice(a, b)
        a = b


def lcs_length(masks: dict[int, int], width: int, tokens: list[int]) -> int:
    """Longest common subsequence of ``tokens`` and a part of ``width`` words, whose places have a bit each in ``masks``; bit-parallel."""
    ones = (1 << width) - 1
    v = ones
    for t in tokens:
        m = masks.get(t)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & ones
    return width - v.bit_count()


class Sparse(NamedTuple):
    """Rows as entries ``index``, ``value`` from ``start`` on."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        return cls(np.cumsum([0, *(len(i) for i, _ in rows)]), np.concatenate([np.zeros(0, np.int64), *(i for i, _ in rows)]), np.concatenate([np.zeros(0), *(v for _, v in rows)]))

    def dot(self, dense: np.ndarray, step: int = 256) -> np.ndarray:
        """Rows times ``dense``, some rows at a time."""
        n = len(self.start) - 1
        out = np.zeros((n, dense.shape[1]), np.float32)
        for i in range(0, n, step):
            at = self.start[i : i + step + 1]
            some = np.flatnonzero(np.diff(at))
            if len(some):
                out[i + some] = np.add.reduceat(dense[self.index[at[0] : at[-1]]] * self.value[at[0] : at[-1], None], at[some] - at[0], axis=0)
        return out

    def add_transposed(self, dense: np.ndarray, out: np.ndarray, weight: float) -> None:
        """Adds ``weight`` times the transposed rows times ``dense``."""
        for i, row in enumerate(dense):
            at = slice(self.start[i], self.start[i + 1])
            out[self.index[at]] += weight * self.value[at, None] * row


class Part(NamedTuple):
    item_id: int
    words: list[int]


def _parts(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[int, list[bytes]]]:
    """Item and words of each part; the benchmark is read in order of its items, row by row."""
    for item, text in benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(item_col, text_col).orderBy(item_col, text_col).toLocalIterator():
        data = LOWER[np.frombuffer(text.encode(), np.uint8)]
        if not len(data):
            continue
        start, end, _ = word_spans(data, np.array([0, len(data)]), WORD_BYTES)
        words = [data[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        pieces_ = max(1, -(-len(words) // HALF))
        size = -(-len(words) // pieces_)
        for i in range(0, len(words), max(size, 1)):
            yield item, words[i : i + size]


def _frequencies(docs: DataFrame, hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many half passages each word is, and how many there are."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hasher = Words(hashes), WordHasher()
        total, n = np.zeros(len(hashes), np.int64), 0
        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in pieces(off):
                text = _read(data[off[i] : off[j]], off[i : j + 1] - off[i], hasher, words)
                at = np.flatnonzero(text.token >= 0)
                half = (np.cumsum(-(-text.n // HALF)) - -(-text.n // HALF))[text.row[at]] + (at - text.start[text.row[at]]) // HALF
                total += np.bincount(np.unique(half * len(hashes) + text.token[at]) % len(hashes), minlength=len(hashes))
                n += int((-(-text.n // HALF)).sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["word", "n"])

    counted = docs.mapInArrow(task, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(len(hashes), np.int64), 0
    for word, count in counted:
        if word < 0:
            n = count
        else:
            out[word] = count
    return out, n


def _range_sketch(docs: DataFrame, hashes: np.ndarray, feature: np.ndarray, idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """A'(A W) over the passages of all documents."""
    d, k = omega.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hasher, total = Words(hashes), WordHasher(), np.zeros((d, k), np.float32)
        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in pieces(off):
                _, passage, own, count = _passages(_read(data[off[i] : off[j]], off[i : j + 1] - off[i], hasher, words), feature)
                if not len(own):
                    continue
                weight = _weights(passage, own, count, idf)
                for part in _some(passage):
                    f, w, of = own[part], weight[part], passage[part] - passage[part.start]
                    projected = _by_passage(omega[f] * w[:, None], of)
                    order = np.argsort(f, kind="stable")
                    total[np.unique(f)] += _by_passage(projected[of[order]] * w[order, None], f[order])
        some = np.flatnonzero(total.any(axis=1))
        for group in range(k // COLUMNS):
            columns = [pa.array(total[some, group * COLUMNS + c].astype(np.float64)) for c in range(COLUMNS)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), group)), *columns], ["f", "g", *(f"v{c}" for c in range(COLUMNS))])

    spec = "f bigint, g bigint, " + ", ".join(f"v{c} double" for c in range(COLUMNS))
    summed = docs.mapInArrow(task, spec).groupBy("f", "g").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in range(COLUMNS)]).toArrow()
    f, g = summed["f"].to_numpy(), summed["g"].to_numpy()
    out = np.zeros((d, k))
    for c in range(COLUMNS):
        out[f, g * COLUMNS + c] = summed[f"v{c}"].to_numpy()
    return out


def singular_vectors(sketch: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors (columns) from one sketch A'(A W): with Q of its range, T = Q'A'A Q solves T (Q'W) = Q'(A'A W)."""
    q, _ = np.linalg.qr(sketch)
    t = np.linalg.lstsq((q.T @ omega).T, (q.T @ sketch).T, rcond=None)[0].T
    values, vectors = np.linalg.eigh((t + t.T) / 2)
    keep = np.argsort(values)[::-1][:rank]
    return q @ vectors[:, keep[values[keep] > 1e-9 * max(values.max(), 1e-30)]]


def rarest(words: list[int], frequency: np.ndarray, share: float) -> list[int]:
    """The rarest words of a part, of which a passage must have one to have ``share`` of the part's words."""
    count = Counter(words)
    out, left = [], 0
    for t in sorted(count, key=lambda t: (frequency[t], t)):
        if left > len(words) * (1 - share):
            break
        out.append(t)
        left += count[t]
    return out


def _pairs(passage: np.ndarray, feature: np.ndarray, index: Sparse, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Passages and the parts that the index names for their features; each pair once."""
    size = index.start[feature + 1] - index.start[feature]
    of = np.repeat(passage, size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(index.start[feature], size)
    code = np.unique(of * parts + index.index[at])
    return code // parts, code % parts


def _search(hashes: np.ndarray, feature: np.ndarray, idf: np.ndarray, basis: np.ndarray, latent: np.ndarray, index: Sparse, parts: list[Part], s: Settings):
    masks = []
    for p in parts:
        m: dict[int, int] = {}
        for i, t in enumerate(p.words):
            m[t] = m.get(t, 0) | 1 << i
        masks.append(m)

    @F.arrow_udf(MATCHES)
    def search(texts: pa.Array) -> pa.Array:
        words, hasher, out = Words(hashes), WordHasher(), []
        data, off = utf8(texts)
        for i, j in pieces(off):
            text = _read(data[off[i] : off[j]], off[i : j + 1] - off[i], hasher, words)
            names, passage, own, count = _passages(text, feature)
            best: dict[tuple[int, int], dict] = {}
            weight = _weights(passage, own, count, idf) if len(own) else np.zeros(0, np.float32)
            for some in _some(passage):
                first, f, w = int(passage[some.start]), own[some], weight[some]
                point = _by_passage(basis[f] * w[:, None], passage[some] - first)
                norm = np.maximum(np.linalg.norm(point, axis=1, keepdims=True), 1e-12)
                of, part_of = _pairs(passage[some] - first, f, index, len(parts))
                cosine = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", point[of[x : x + 4096]], latent[part_of[x : x + 4096]]) for x in range(0, len(of), 4096))]) / norm[of, 0]
                near = cosine >= s.min_cosine
                tokens_of: dict[int, list[int]] = {}
                for a, b, c in zip((of[near] + first).tolist(), part_of[near].tolist(), cosine[near].tolist(), strict=True):
                    row, number = int(names[a] >> 32), int(names[a] & 0xFFFFFFFF)
                    lo = int(text.start[row]) + number * HALF
                    if a not in tokens_of:
                        tokens_of = {a: text.token[lo : min(lo + 2 * HALF, int(text.start[row] + text.n[row]))].tolist()}
                    tokens, part = tokens_of[a], parts[b]
                    share = lcs_length(masks[b], len(part.words), tokens) / len(part.words)
                    if share < s.paraphrase:
                        continue
                    tail = part.words[-s.answer_words :]
                    answer = any(tokens[x : x + len(tail)] == tail for x, t in enumerate(tokens) if t == tail[0])
                    if share >= s.verbatim or answer:
                        found = {"item_id": part.item_id, "first_word": number * HALF, "cosine": c, "lcs_share": share, "answer": answer}
                        old = best.get((row, part.item_id))
                        if old is None or (share, answer, c) > (old["lcs_share"], old["answer"], old["cosine"]):
                            best[row, part.item_id] = found
            rows: list[list[dict]] = [[] for _ in range(j - i)]
            for (row, _), found in sorted(best.items()):
                rows[row].append(found)
            out += rows
        kind = pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()), ("answer", pa.bool_())])
        return pa.array(out, pa.list_(kind))

    return search


def _index(docs: DataFrame, block: list[tuple[int, list[bytes]]], s: Settings):
    """The search function for a block of benchmark parts, after the two passes that fit it."""
    names = sorted({w for _, words in block for w in words})
    number = {w: i for i, w in enumerate(names)}
    end = np.cumsum([len(w) for w in names])
    hashes = WordHasher()(np.frombuffer(b"".join(names), np.uint8), end - [len(w) for w in names], end)
    parts = [Part(item, [number[w] for w in words]) for item, words in block]
    texts = docs.select("_text")
    frequency, n = _frequencies(texts, hashes)
    chosen = set(np.flatnonzero(frequency <= s.rare * n).tolist())
    for p in parts:
        chosen |= set(sorted(set(p.words), key=lambda t: (frequency[t], t))[: s.rarest_of_part])
    feature = np.full(len(names) + 1, -1)
    feature[sorted(chosen)] = np.arange(len(chosen))
    idf = np.log((1 + n) / (1 + frequency[sorted(chosen)])) + 1e-3

    rank = min(len(parts), s.rank) + s.oversample
    k = -(-rank // COLUMNS) * COLUMNS
    omega = np.random.Generator(np.random.PCG64(s.seed)).standard_normal((len(chosen), k), np.float32)
    own = []
    for p in parts:
        f, count = np.unique(feature[p.words][feature[p.words] >= 0], return_counts=True)
        w = (1 + np.log(count)) * idf[f]
        own.append((f, w / max(np.linalg.norm(w), 1e-12)))
    rows = Sparse.of(own)
    sketch = _range_sketch(texts, hashes, feature, idf, omega)
    rows.add_transposed(rows.dot(omega), sketch, s.item_weight)
    basis = singular_vectors(sketch, omega, rank).astype(np.float32)
    del sketch, omega
    latent = rows.dot(basis)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    named: list[list[int]] = [[] for _ in chosen]
    for i, p in enumerate(parts):
        for t in rarest(p.words, frequency, s.paraphrase):
            if feature[t] >= 0:
                named[feature[t]].append(i)
    index = Sparse.of([(np.array(x, np.int64), np.ones(len(x))) for x in named])
    return _search(hashes, feature, idf, basis, latent, index, parts, s)


def with_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, column: str = "_matches", settings: Settings = Settings(), block_parts: int = 2048) -> DataFrame:
    """``docs`` with a column of the benchmark items that each text holds: item, first word of the passage, cosine, share of the longest common subsequence, answer found.

    Defined cases: null and empty texts, and those without words, hold nothing; benchmark rows
    with a null id or text or without words are ignored, and without any item nothing is
    held; items with equal texts are all reported. Rows and other columns stay as they are, but a column of the
    new one's name is replaced.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("_text"))
    block: list[tuple[int, list[bytes]]] = []
    found = []
    for part in _parts(benchmark, item_col, item_text_col):
        block.append(part)
        if len(block) == block_parts:
            found.append(_index(texts, block, settings)(F.col(text_col)))
            block = []
    if block:
        found.append(_index(texts, block, settings)(F.col(text_col)))
    empty = F.array().cast(MATCHES)
    return docs.withColumn(column, empty if not found else found[0] if len(found) == 1 else F.concat(*found))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """A row for each document and benchmark item that it holds: ``id_col, item_id, first_word, cosine, lcs_share, answer``; cases as in :func:`with_matches`."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body"))
    found = with_matches(src, benchmark, "_body", item_col, item_text_col, **options)
    return found.select(F.col("_id").alias(id_col), F.inline("_matches"))
