"""Scores of texts under a hierarchical Pitman-Yor language model.

A restaurant for each word context, all sharing one parent restaurant, which holds the
words alone and falls back on a uniform base over the vocabulary and one class of
unseen words. Customers of a context are the corpus's bigrams; its tables are the
customers of the parent. Seatings are sampled by Gibbs: in each sweep every dish
of every restaurant draws its number of tables anew, given all others as the sweep before left them,
from the exact conditional (generalised Stirling numbers up to ``TABLE_MOST`` customers, their saddle-point
form on a grid of 129 points above). Predictive probabilities are averaged over the last sweeps.

Layout. Texts become chunks: packed rows of some megabytes with their words as numbers, written
once. Words and bigrams of chunks are dealt by hash to parts; a part adds up the
counts of its own and answers the chunks that asked. So no word, however frequent, is more than one
entry from each chunk, and a context with very many followers spreads over all parts. Bigrams seen once
always have one table: they need no state, and their tables follow from the words' counts. Words and bigrams are told apart by
64-bit hashes; every other step is exact. Nothing but totals reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_SEPARATED, LOWER, PIECE_BYTES, WordHasher, bound_batches, mix, utf8, word_spans, written

CHUNK_BYTES = 8 << 20
HELD_OUT_OF, HELD_OUT_REST = 7, 2
#: Prior strength of both kinds of restaurants; sweeps left out and sweeps averaged.
STRENGTH, BURN_IN, SAMPLES = 1.0, 2, 3
#: Customers of a dish up to which the conditional of its tables is a table of Stirling numbers.
TABLE_MOST = 1024
#: Entries of a part on average, and parts at least.
PART_WORDS, PART_TOKENS, LEAST_PARTS = 1 << 18, 1 << 20, 32
#: In place of whether a text is held out, where it has no id.
NO_ID = 2
#: Hashes that stand for the start of a text, which is a context only, and its end.
BEGIN, END = np.uint64(2**64 - 2), np.uint64(2**64 - 1)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT_OF == HELD_OUT_REST


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0, in as few bytes each as the largest needs, byte by byte through zstandard."""
    x = np.asarray(x).astype(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(x.max(initial=0)) < 1 << 8 * w)
    planes = x.astype(f"<u{width}").view(np.uint8).reshape(len(x), width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, kind: type = np.int64) -> np.ndarray:
    width, raw = blob[0], np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(f"<u{width}").reshape(-1).astype(kind)


def unpacked(column: pa.ChunkedArray, kind: type = np.int64) -> list[np.ndarray]:
    return [unpack(b, kind) for b in column.to_pylist()]


def table(schema: str, rows: list[tuple]) -> pa.Table:
    """An Arrow table of a schema string with whole numbers (``bigint``) and packed columns (``binary``)."""
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table({name: pa.array(c, {"bigint": pa.int64(), "binary": pa.binary()}[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def power_of_two(n: float) -> int:
    return 1 << max(LEAST_PARTS - 1, int(n)).bit_length()


def together(left: DataFrame, right: DataFrame, key: str, f, schema: str) -> DataFrame:
    """``f`` for the rows of both that share a key; schemas are as in ``table``."""
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(f, schema)


# --- texts to chunks

CHUNK = "chunk bigint, ids binary, lengths binary, held binary, words binary, counts binary, line binary, n_words bigint, n_tokens bigint"


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, in pieces of bytes so that memory follows the words."""
    data, off = utf8(texts)
    data, hasher = LOWER[data], WordHasher()
    start, end, row = word_spans(data, off, BLANK_SEPARATED)
    out, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE_BYTES, side="right")))
        out[i:j] = hasher(data[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i])
        i = j
    return np.minimum(out, BEGIN - np.uint64(1)), row


def chunk_of(ids: list[int | None], texts: pa.Array, number: int) -> tuple:
    """A row of ``CHUNK``: its distinct words by hash, then the start and the end; how often each stands in the texts learned from; and its texts as places among them."""
    hashes, row = word_hashes(texts)
    held = np.array([is_held_out(i) for i in ids], bool)
    words, place = np.unique(hashes, return_inverse=True)
    lengths = np.bincount(row, minlength=len(ids)) + 1
    line = np.full(len(hashes) + len(ids), len(words) + 1, np.int64)
    line[np.arange(len(hashes)) + row] = place
    counts = np.bincount(place[~held[row]], minlength=len(words))
    learned = int((~held).sum())
    folded = np.array([0 if i is None else (i << 1) ^ (i >> 63) for i in ids], object).astype(np.uint64)
    state = np.where([i is None for i in ids], NO_ID, held)
    blobs = [pack(x) for x in (folded, lengths, state, np.concatenate([words, [BEGIN, END]]), np.concatenate([counts, [learned, learned]]), line)]
    return number, *blobs, len(words) + 2, len(line)


def chunked(docs: DataFrame, size: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                ids += part.column(0).to_pylist()
                texts.append(part.column(1).cast(pa.large_string()))
                held += int(np.diff(utf8(texts[-1])[1]).sum())
                if held >= size:
                    yield from table(CHUNK, [chunk_of(ids, pa.concat_arrays(texts), number)]).to_batches()
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield from table(CHUNK, [chunk_of(ids, pa.concat_arrays(texts), number)]).to_batches()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, CHUNK)


# --- words

WORD_REQUEST = "part bigint, chunk bigint, words binary, counts binary"
WORD_ANSWER = "part bigint, chunk bigint, ids binary, n_words bigint, n_tokens bigint"


def word_parts(ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and place in it of word numbers, which start at 1; 0 is no word."""
    return (ids - 1) % parts, (ids - 1) // parts


def request_words(parts: int):
    shift = np.uint64(64 - (parts.bit_length() - 1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "counts")), strict=True):
                words, counts = unpack(words, np.uint64), unpack(counts)
                edges = np.searchsorted(words >> shift, np.arange(parts + 1, dtype=np.uint64))
                yield from table(WORD_REQUEST, [(p, chunk, pack(words[a:b]), pack(counts[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]).to_batches()

    return ask


def number_words(parts: int):
    """Numbers of the words that were learned from: by falling count in each part, the start of texts before all in the last. The part's own row has their counts; ``chunk`` is -1."""

    def answer(asked: pa.Table) -> pa.Table:
        part = asked["part"][0].as_py()
        given, counts = unpacked(asked["words"], np.uint64), np.concatenate(unpacked(asked["counts"]))
        words, place = np.unique(np.concatenate(given), return_inverse=True)
        total = np.bincount(place, weights=counts).astype(np.int64)
        order = np.lexsort((words, -total, words != BEGIN))
        order = order[total[order] > 0]
        ids = np.zeros(len(words), np.int64)
        ids[order] = np.arange(len(order)) * parts + part + 1
        edges = np.cumsum([0, *map(len, given)])
        rows = [(part, c, pack(ids[place[a:b]]), 0, 0) for c, a, b in zip(asked["chunk"].to_pylist(), edges, edges[1:], strict=False)]
        real = words[order] != BEGIN
        return table(WORD_ANSWER, [*rows, (part, -1, pack(total[order]), int(real.sum()), int(total[order][real].sum()))])

    return answer


# --- bigrams

PAIR_REQUEST = "part bigint, chunk bigint, u binary, w binary, counts binary"
PAIR_ANSWER = "part bigint, chunk bigint, places binary, u binary, w binary, c binary, once bigint, twice bigint"


def distinct_pairs(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in rising order, and the place of each given pair among them."""
    if max(u.max(initial=0), w.max(initial=0)) < 1 << 32:
        both, place = np.unique(u.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64), return_inverse=True)
        return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64), place
    order = np.lexsort((w, u))
    su, sw = u[order], w[order]
    new = np.concatenate([[True], (su[1:] != su[:-1]) | (sw[1:] != sw[:-1])])
    place = np.empty(len(u), np.int64)
    place[order] = np.cumsum(new) - 1
    return su[new], sw[new], place


def line_pairs(chunk: dict, answers: pa.Table, parts: int) -> tuple[np.ndarray, ...]:
    """Of a chunk with the numbers of its words: distinct known pairs dealt to parts (``u, w, part``), the place of each token's pair among them (-1 without), and each token's words' places in the chunk."""
    answers = answers.sort_by("part")
    ids = np.concatenate(unpacked(answers["ids"]))
    line, lengths = chunk["line"], chunk["lengths"]
    before = np.empty_like(line)
    before[1:] = line[:-1]
    before[np.cumsum(lengths) - lengths] = len(ids) - 2
    u, w = ids[before], ids[line]
    known = (u > 0) & (w > 0)
    us, ws, place = distinct_pairs(u[known], w[known])
    part = (mix(mix(us.astype(np.uint64)) * np.uint64(3) + ws.astype(np.uint64)) >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int64)
    order = np.argsort(part, kind="stable")
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    tokens = np.full(len(line), -1)
    tokens[known] = where[place]
    return us[order], ws[order], part[order], tokens, before


def opened(chunks: pa.Table) -> dict:
    return {c: unpack(chunks[c][0].as_py()) for c in ("line", "lengths", "held")}


def request_pairs(parts: int):
    def ask(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = opened(chunks)
        us, ws, part, tokens, _ = line_pairs(chunk, answers, parts)
        learned = np.repeat(chunk["held"] != 1, chunk["lengths"]) & (tokens >= 0)
        counts = np.bincount(tokens[learned], minlength=len(us))
        edges, name = np.searchsorted(part, np.arange(parts + 1)), chunks["chunk"][0].as_py()
        return table(PAIR_REQUEST, [(p, name, pack(np.diff(us[a:b], prepend=0)), pack(ws[a:b]), pack(counts[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a])

    return ask


def count_pairs(asked: pa.Table) -> pa.Table:
    """Each asked pair's place: 0 where it was not learned from, 1 where it was once, else 2 and more, among the part's pairs of several occurrences, which the row of chunk -1 has."""
    part = asked["part"][0].as_py()
    us = [np.cumsum(x) for x in unpacked(asked["u"])]
    u, w, place = distinct_pairs(np.concatenate(us), np.concatenate(unpacked(asked["w"])))
    c = np.bincount(place, weights=np.concatenate(unpacked(asked["counts"]))).astype(np.int64)
    several = c >= 2
    code = np.where(several, np.cumsum(several) + 1, c)
    edges = np.cumsum([0, *map(len, us)])
    none = pack(np.zeros(0, np.int64))
    rows = [(part, n, pack(code[place[a:b]]), none, none, none, 0, 0) for n, a, b in zip(asked["chunk"].to_pylist(), edges, edges[1:], strict=False)]
    return table(PAIR_ANSWER, [*rows, (part, -1, none, pack(u[several]), pack(w[several]), pack(c[several]), int((c == 1).sum()), int((c == 2).sum()))])


# --- numbers of tables


def log_stirling(discount: float, most: int) -> list[np.ndarray]:
    """``[c][t - 1]``: logarithm of the summed weights of seating c customers at t tables."""
    out = [np.zeros(0), np.zeros(1)]
    for c in range(1, most):
        last, t = out[-1], np.arange(1, c + 1)
        grown = np.append(last + np.log(c - discount * t), -np.inf)
        out.append(np.logaddexp(grown, np.append(-np.inf, last)))
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For positive x."""
    x, shift = x + 8.0, sum(np.log(x + i) for i in range(8))
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def log_stirling_far(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same by the saddle point of its generating function ``((1 - (1 - z)**d) / d)**t / t!``."""
    low, high = np.full(c.shape, -700.0), np.full(c.shape, -1e-12)
    for _ in range(60):  # of log(1 - z): the slope falls from infinity to t
        half = (low + high) / 2
        q = np.exp(half)
        over = t * (1 - q) * d * np.exp(half * (d - 1)) / -np.expm1(half * d) > c
        low, high = np.where(over, half, low), np.where(over, high, half)
    half = (low + high) / 2
    z, g = -np.expm1(half), -np.expm1(half * d) / d
    a, b = z * np.exp(half * (d - 1)) / g, z * z * (1 - d) * np.exp(half * (d - 2)) / g
    return log_gamma(c + 1.0) - log_gamma(t + 1.0) + t * np.log(g) - c * np.log(z) - 0.5 * np.log(2 * np.pi * t * np.maximum(a + b - a * a, 1e-300))


def saddle_error(d: float, c: int, tables: int = 128) -> np.ndarray:
    """What the saddle point misses at few tables, which hardly depends on the customers: by t, from the table's last row; 0 from ``tables`` on."""
    t = np.arange(1.0, min(tables, c))
    return np.concatenate([[0.0], log_stirling(d, c)[c][: len(t)] - log_stirling_far(np.full(len(t), float(c)), t, d), [0.0]])


def sample_tables(rng: np.random.Generator, c: np.ndarray, discount: float, strength: float, others: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Tables of dishes with ``c`` customers, from their conditional given ``others``, the tables of the restaurant's other dishes, and the dish's probability at the parent: weights ``parent**t * prod(strength + discount * (others + j), j < t) * stirling(c, t)``."""
    t = np.minimum(c, 1)
    seatings = log_stirling(discount, int(c[c <= TABLE_MOST].max(initial=1)))
    for n in np.unique(c[(c > 1) & (c <= TABLE_MOST)]).tolist():
        rows, stirling = np.flatnonzero(c == n), seatings[n]
        for i in range(0, len(rows), max(1, (1 << 18) // n)):
            own = rows[i : i + max(1, (1 << 18) // n)]
            if n <= 32:
                # weights of 2, 3, ... tables over that of one
                ratio = parent[own, None] * (strength + discount * (others[own, None] + np.arange(1, n))) * np.exp(np.diff(stirling))
                weight = np.cumsum(np.cumprod(ratio, axis=1), axis=1)
                drawn = rng.random(len(own)) * (1 + weight[:, -1]) - 1
                t[own] = 1 + (drawn >= 0) + (weight[:, :-1] <= drawn[:, None]).sum(1)
                continue
            weight = np.cumsum(np.log(parent[own, None] * (strength + discount * (others[own, None] + np.arange(n)))), axis=1) + stirling
            t[own] = 1 + np.argmax(weight + rng.gumbel(size=weight.shape), axis=1)
    rows = np.flatnonzero(c > TABLE_MOST)
    missed = saddle_error(discount, TABLE_MOST) if len(rows) else None
    for i in range(0, len(rows), 4096):
        own = rows[i : i + 4096]
        n, start, pull = c[own].astype(float)[:, None], (others[own] + strength / discount)[:, None], np.log(parent[own] * discount)[:, None]
        weight = lambda x: x * pull + log_gamma(start + x) + log_stirling_far(n + 0 * x, x, discount) + missed[np.minimum(x, len(missed) - 1).astype(int)]  # noqa: B023, E731
        low, high = np.ones_like(n), n.copy()
        for _ in range(50):
            half = np.floor((low + high) / 2)
            rises = weight(np.minimum(half + 1, n)) > weight(half)
            low, high = np.where(rises, np.minimum(half + 1, n), low), np.where(rises, high, half)
            if (high <= low).all():
                break
        mode = np.clip(low, 2, n - 1)
        bend = np.maximum(2 * weight(mode) - weight(mode + 1) - weight(mode - 1), 1e-12)
        step = np.maximum(1.0, np.ceil(np.minimum(6 / np.sqrt(bend), n) / 64))
        grid = mode + step * np.arange(-64, 65)
        at = np.where((grid >= 1) & (grid <= n), weight(np.clip(grid, 1, n)), -np.inf)
        t[own] = grid[np.arange(len(own)), np.argmax(at + rng.gumbel(size=at.shape), axis=1)].astype(np.int64)
    return t


# --- sweeps

#: A part's pairs (``asker`` -1) with their customers, tables, and tables added over samples; or what it asks of a part of words: the places of its contexts and words there, and in ``c`` and ``t`` how many tables less than customers its pairs have at each.
STATE = "part bigint, asker bigint, u binary, w binary, c binary, t binary, total binary"
ROOT = "part bigint, asker bigint, tables binary, customers binary, root_tables binary, n_customers bigint, n_tables bigint"


def dealt_words(ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each number's place among the distinct ones in the order of parts, and the distinct ones' parts and places in them."""
    if (ids[1:] >= ids[:-1]).all():  # contexts come in order
        new = np.concatenate([np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]])
        distinct, place = ids[new], np.cumsum(new) - 1
    else:
        distinct, place = np.unique(ids, return_inverse=True)
    part, spot = word_parts(distinct, parts)
    order = np.argsort(part, kind="stable")
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    return where[place], part[order], spot[order]


def state_rows(part: int, u: np.ndarray, w: np.ndarray, c: np.ndarray, t: np.ndarray, total: np.ndarray, sides: list[tuple], parts: int) -> list[tuple]:
    """Rows of ``STATE`` of a part; ``sides``: ``dealt_words`` of its contexts and words."""
    saved = [np.bincount(s[0], weights=c - t, minlength=len(s[1])).astype(np.int64) for s in sides]
    edges = [np.searchsorted(s[1], np.arange(parts + 1)) for s in sides]
    rows, none = [(part, -1, *map(pack, (u, w, c, t, total)))], pack(np.zeros(0, np.int64))
    for p in range(parts):
        (a, b), (x, y) = ((e[p], e[p + 1]) for e in edges)
        if b > a or y > x:
            rows.append((p, part, pack(sides[0][2][a:b]), pack(sides[1][2][x:y]), pack(saved[0][a:b]), pack(saved[1][x:y]), none))
    return rows


def first_seating(parts: int):
    """One table a dish."""

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *blobs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                u, w, c = map(unpack, blobs)
                one = np.ones(len(c), np.int64)
                yield from table(STATE, state_rows(part, u, w, c, one, 0 * one, [dealt_words(x, parts) for x in (u, w)], parts)).to_batches()

    return seat


def seat_root(parts: int, sweep: int, seed: int, discount: float, strength: float, vocabulary: int, root_total: int):
    """The parent's seating, from the tables of all contexts, and what the asking parts need of it."""

    def seat(counted: pa.Table, asked: pa.Table) -> pa.Table:
        part, counts = counted["part"][0].as_py(), unpack(counted["ids"][0].as_py())
        tables, customers = counts.copy(), counts.copy()
        columns = [unpacked(asked[c]) for c in ("u", "c", "w", "t")]
        for u, less_u, w, less_w in zip(*columns, strict=True):
            tables[u] -= less_u  # no number stands twice in one row
            customers[w] -= less_w
        if part == parts - 1 and len(customers):
            customers[0] = 0  # the start of a text is no word
        rng = np.random.Generator(np.random.PCG64([seed, sweep, part, 1]))
        # the dish's own tables of the sweep before are small against all others'
        root = sample_tables(rng, customers, discount, strength, np.full(len(customers), max(root_total - 1, 0), float), np.full(len(customers), 1 / (vocabulary + 1)))
        none = pack(np.zeros(0, np.int64))
        rows = [(part, asker, pack(tables[u]), pack(customers[w]), pack(root[w]), 0, 0) for asker, u, w in zip(asked["asker"].to_pylist(), columns[0], columns[2], strict=True)]
        return table(ROOT, [*rows, (part, -1, pack(tables) if len(tables) else none, pack(customers), pack(root), int(customers.sum()), int(root.sum()))])

    return seat


def seat_contexts(parts: int, sweep: int, seed: int, discount: float, strength: float, root: dict, keep: bool):
    """The contexts' seating anew. Added up are the tables that the parent's customers are, so that each sample's probabilities add up to 1."""

    def seat(state: pa.Table, answers: pa.Table) -> pa.Table:
        part = state["part"][0].as_py()
        u, w, c, t, total = (unpack(state[x][0].as_py()) for x in ("u", "w", "c", "t", "total"))
        sides = [dealt_words(x, parts) for x in (u, w)]
        if len(u):
            answers = answers.sort_by("part")
            tables, customers, root_tables = (np.concatenate(unpacked(answers[x])) for x in ("tables", "customers", "root_tables"))
            rng = np.random.Generator(np.random.PCG64([seed, sweep, part, 2]))
            total = total + t if keep else total
            t = sample_tables(rng, c, discount, strength, (tables[sides[0][0]] - t).astype(float), root_probability(customers, root_tables, root)[sides[1][0]])
        return table(STATE, state_rows(part, u, w, c, t, total, sides, parts))

    return seat


def root_probability(customers: np.ndarray, tables: np.ndarray, root: dict) -> np.ndarray:
    """Predictive probability at the parent of words with so many customers and tables there; 0 of both: a word never learned from."""
    base = (root["strength"] + root["discount"] * root["tables"]) / (root["vocabulary"] + 1)
    return (customers - root["discount"] * tables + base) / (root["strength"] + root["customers"])


def discount_of(once: int, twice: int) -> float:
    """Discount from how many types stand once and twice; kept off 0 and 1."""
    return float(min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.5)))


# --- scores

WORD_VALUES = "chunk bigint, part bigint, kind bigint, a binary, b binary"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def answer_words(samples: int, parts: int):
    """To the chunks: of each word its count, then tables as context, customers and tables at the parent of each sample, packed as one line."""

    def answer(asked: pa.Table, found: pa.Table) -> pa.Table:
        part = asked["part"][0].as_py()
        found = found.sort_by("sample")
        lines = [unpack(b) for s in range(samples) for b in (found[c][s].as_py() for c in ("tables", "customers", "root_tables"))]
        lines = np.array([unpack(found["counts"][0].as_py()), *lines])
        lines = np.concatenate([np.zeros((len(lines), 1), np.int64), lines], axis=1)
        rows = []
        for chunk, ids in zip(asked["chunk"].to_pylist(), unpacked(asked["ids"]), strict=True):
            at = np.where(ids > 0, word_parts(ids, parts)[1] + 1, 0)
            rows.append((chunk, part, 0, pack(lines[:, at].reshape(-1)), b""))
        return table(WORD_VALUES, rows)

    return answer


def answer_pairs(samples: int):
    """To the chunks: of each pair its count, and its tables added over the samples."""

    def answer(asked: pa.Table, state: pa.Table) -> pa.Table:
        part = asked["part"][0].as_py()
        c, t, total = (unpack(state[x][0].as_py()) for x in ("c", "t", "total"))
        c, t = np.concatenate([[0, 1], c]), np.concatenate([[0, samples], total + t])
        return table(WORD_VALUES, [(chunk, part, 1, pack(c[x]), pack(t[x])) for chunk, x in zip(asked["chunk"].to_pylist(), unpacked(asked["places"]), strict=True)])

    return answer


def score_chunk(pair_parts: int, discount: float, strength: float, roots: list[dict], train_tokens: int):
    vocabulary = roots[0]["vocabulary"]

    def score(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = opened(chunks)
        kinds = answers["kind"].to_numpy()
        ids, words, pairs = (answers.filter(pa.array(kinds == k)).sort_by("part") for k in (2, 0, 1))
        ids = ids.rename_columns(["chunk", "part", "kind", "ids", "b"])
        *_, tokens, before = line_pairs(chunk, ids, pair_parts)
        line, lengths = chunk["line"], chunk["lengths"]
        values = np.concatenate([unpack(b).reshape(1 + 3 * len(roots), -1) for b in words["a"].to_pylist()], axis=1)
        counts = values[0]
        # the start is a context only
        as_word = counts.copy()
        as_word[-2] = 0
        c, t = (np.concatenate([*unpacked(pairs[x]), [0]]) for x in ("a", "b"))
        p = c[tokens] - discount * t[tokens] / len(roots)
        for s, root in enumerate(roots):
            tables, customers, root_tables = values[1 + 3 * s : 4 + 3 * s]
            p += (strength + discount * tables[before]) * root_probability(customers, root_tables, root)[line] / len(roots)
        p /= strength + counts[before]
        first = np.cumsum(lengths) - lengths
        sums = [np.add.reduceat(x, first) for x in (np.log10(p), np.log10((as_word[line] + 1) / (train_tokens + vocabulary + 1)), (as_word[line] > 0).astype(np.int64))]
        folded = unpack(chunks["ids"][0].as_py(), np.uint64).tolist()
        doc_ids = [None if h == NO_ID else (x >> 1) ^ -(x & 1) for x, h in zip(folded, chunk["held"].tolist(), strict=True)]
        n = len(lengths)
        return pa.table({
            "doc_id": pa.array(doc_ids, pa.int64()), "held_out": pa.array(chunk["held"] == 1), "n_tokens": pa.array(lengths), "n_known": pa.array(sums[2]),
            "train_tokens": pa.array(np.full(n, train_tokens, np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[0]),
        })

    return score


def score_texts(docs: DataFrame, strength: float = STRENGTH, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 1, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Learned from are the texts that are not held out; tokens are words (``A-Z`` lower-cased) and one end a text. ``base_score`` is the
    log10 probability under single words with one added to each count, ``score`` that under the model.

    A null text is empty: its end alone. A null id is never held out, so it is learned from. Repeated rows
    count, and are scored, each. An empty table gives no rows; where nothing is learned from, all probabilities are 1, as there is one class of words.
    Other columns are not read. Discounts of both kinds of restaurants follow from how many types stand once and twice.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    chunks = written(chunked(docs, chunk_bytes), "chunks")
    size = chunks.agg(F.count("*"), F.sum("n_words"), F.sum("n_tokens")).first()
    if not size[0]:
        return spark.createDataFrame([], SCORES)
    parts, pair_parts = power_of_two(size[1] / PART_WORDS), power_of_two(size[2] / PART_TOKENS)

    words = written(chunks.select("chunk", "words", "counts").mapInArrow(request_words(parts), WORD_REQUEST).groupBy("part").applyInArrow(number_words(parts), WORD_ANSWER), "words")
    counted, asked_words = words.where("chunk < 0").select("part", "ids"), words.where("chunk >= 0").select("part", "chunk", "ids")
    vocabulary, train_tokens = (x or 0 for x in words.agg(F.sum("n_words"), F.sum("n_tokens")).first())
    texts = chunks.select("chunk", "ids", "lengths", "held", "line")
    asked = together(texts.drop("ids"), asked_words, "chunk", request_pairs(pair_parts), PAIR_REQUEST)
    pairs = written(asked.groupBy("part").applyInArrow(count_pairs, PAIR_ANSWER), "pairs")
    once, twice = (x or 0 for x in pairs.agg(F.sum("once"), F.sum("twice")).first())
    discount = discount_of(once, twice)
    state = written(pairs.where("chunk < 0").select("part", "u", "w", "c").mapInArrow(first_seating(parts), STATE), "state")

    root = {"strength": strength, "discount": discount, "vocabulary": vocabulary, "tables": vocabulary, "customers": 0}
    roots, kept = [], []
    for sweep in range(burn_in + samples):
        seated = written(together(counted, state.where("asker >= 0"), "part", seat_root(parts, sweep, seed, discount, strength, vocabulary, root["tables"]), ROOT), "root")
        totals = seated.agg(F.sum("n_customers"), F.sum("n_tables")).first()
        root = root | {"customers": totals[0], "tables": totals[1]}
        keep = sweep >= burn_in
        if keep:
            roots.append(root)
            kept.append(seated.where("asker < 0").select("part", F.lit(sweep).cast("bigint").alias("sample"), "tables", "customers", "root_tables"))
        if sweep < burn_in + samples - 1:
            answers = seated.where("asker >= 0").select(F.col("asker").alias("to"), "part", "tables", "customers", "root_tables")
            seat = seat_contexts(parts, sweep, seed, discount, strength, root, keep)
            state = written(state.where("asker < 0").groupBy("part").cogroup(answers.groupBy("to")).applyInArrow(seat, STATE), "state")

    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    found = found.join(counted.withColumnRenamed("ids", "counts"), "part")
    of_words = together(asked_words, found, "part", answer_words(samples, parts), WORD_VALUES)
    of_pairs = together(pairs.where("chunk >= 0").select("part", "chunk", "places"), state.where("asker < 0").select("part", "c", "t", "total"), "part", answer_pairs(samples), WORD_VALUES)
    ids = asked_words.select("chunk", "part", F.lit(2).cast("bigint").alias("kind"), F.col("ids").alias("a"), F.lit(b"").alias("b"))
    return together(texts, of_words.unionByName(of_pairs).unionByName(ids), "chunk", score_chunk(pair_parts, discount, strength, roots, train_tokens), SCORES)
