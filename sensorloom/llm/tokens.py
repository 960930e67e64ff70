"""Token ids of documents in binary files, each document compressed on its own with a shared dictionary.

A folder holds ``dictionary-<sha256>.zdict`` and numbered ``.tok`` files. A file is

    magic, one zstandard frame a document, index, footer

with little-endian fields: the index has the documents' ids (int64, and a byte that is 1 for
a null id), their frames' offsets (uint64, one more than documents) and token counts (uint32); the
footer has the index's offset, the number of documents (uint64 each), the bytes of one
token id (uint8), the dictionary's SHA-256 (32 bytes) and the magic again. So one document is
read with the footer, three index entries and one frame.

The dictionary is trained on the serialised id arrays of a bounded sample of documents; it only changes the
size of the files, never what is read back from them.

Encoding goes by units. Blanks never join two tokens, so texts fall apart at blanks; and in
a stretch of only ASCII without ``'`` and ``<`` and of Latin-1 letters, the
tokenizer's own rules (lower case; runs of letters, single digits, runs of other characters) are
plain byte classes. Each distinct unit of a batch (told by a 64-bit hash) is encoded once by the tokenizer's model, any other
stretch by the whole tokenizer. A tokenizer with other rules than ``RULES`` encodes whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .archives import _Files, write_file
from .common import LOWER, WordHasher, bound_batches, cut, new_folder, pieces, utf8

MAGIC = b"SLTOK001"
FOOTER = 8 + 8 + 1 + 32 + 8
UNIT_LIMIT = 400_000
SAMPLE_TEXT = 1 << 15
_BLANK, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3


#: Normalizer and pre-tokenizer of the files whose texts may be taken apart into units.
RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


def _byte_letters() -> str:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for themselves, the others from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


def _classes() -> np.ndarray:
    kind = np.full(256, _OTHER, np.int8)
    kind[0x80:] = _LETTER
    kind[65:91] = kind[97:123] = _LETTER
    kind[48:58] = _DIGIT
    kind[9:14] = kind[32] = _BLANK
    return kind


class Encoder:
    """``tokenizers`` file with the word rules above; encodes whole batches to ids, row after row."""

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        self.by_units = (stated.get("normalizer"), stated.get("pre_tokenizer")) == RULES and not any(t.get("normalized") for t in stated.get("added_tokens", ()))
        del stated
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.end_id = end_id
        self.kind, self.letters, self.hasher = _classes(), _byte_letters(), WordHasher()
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(UNIT_LIMIT + 2, np.int64)

    def _learn(self, keys: list[int], units: list[bytes], plain: list[bool]) -> None:
        n = len(self.known)
        top = int(self.first[n])
        new: list[int] = []
        for key, unit, simple in zip(keys, units, plain, strict=True):
            if simple:
                text = unit.decode("latin-1") if unit.isascii() else "".join([self.letters[b] for b in unit])
                new += [t.id for t in self.model.tokenize(text)]
            else:
                new += self.tokenizer.encode(unit.decode("utf-8", "replace"), add_special_tokens=False).ids
            self.known[key] = n
            n += 1
            self.first[n] = top + len(new)
        if top + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(new)), np.int32)])
        self.ids[top : top + len(new)] = new

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes; start, end and row of each unit; whether it is plain."""
        kind = self.kind[data]
        head = np.zeros(len(data), bool)
        head[off[:-1][off[:-1] < len(data)]] = True
        prev = np.empty_like(kind)
        prev[:1], prev[1:] = _BLANK, kind[:-1]
        prev[head] = _BLANK
        opens = (kind != _BLANK) & (prev == _BLANK)  # of a stretch between blanks
        stretch = np.cumsum(opens) - 1
        lead = np.zeros(len(data), bool)
        lead[1:] = data[:-1] == 0xC3
        lead &= ~head
        odd = (data == 0x27) | (data == 0x3C) | (data < 0x20) | (data == 0x7F) | ((data >= 0x80) & (data != 0xC3) & ~lead) | (lead & ((data == 0x97) | (data == 0xB7)))
        odd &= kind != _BLANK
        strange = np.zeros(int(stretch[-1]) + 1 if len(data) else 0, bool)
        strange[stretch[odd]] = True
        plain = np.zeros(len(data), bool)
        inside = kind != _BLANK
        plain[inside] = ~strange[stretch[inside]]
        low = np.where(plain, LOWER[data], data)
        low = np.where(plain & lead & (data >= 0x80) & (data <= 0x9E), low + 32, low).astype(np.uint8)
        start = np.flatnonzero(opens | (plain & ((kind != prev) | (kind == _DIGIT))))
        nxt = np.empty_like(kind)
        nxt[-1:], nxt[:-1] = _BLANK, kind[1:]
        tail = off[1:][off[1:] > 0] - 1
        nxt[tail] = _BLANK
        closes = (kind != _BLANK) & ((nxt == _BLANK) | (plain & ((kind != nxt) | (kind == _DIGIT))))
        end = np.flatnonzero(closes) + 1
        return low, start, end, np.searchsorted(off, start, side="right") - 1, plain[start]

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows, one after the other, with the end id after each row; and their number by row."""
        rows = len(off) - 1
        if not self.by_units:
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            end = [] if self.end_id is None else [self.end_id]
            encoded = [[*x.ids, *end] for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.array([t for x in encoded for t in x], np.int32), np.array([len(x) for x in encoded], np.int64)
        low, start, end, row, plain = self.units(data, off)
        keys, at, inverse = np.unique(self.hasher(low, start, end), return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > UNIT_LIMIT:
            self._clear()
            if len(keys) > UNIT_LIMIT:
                self.first = np.zeros(len(keys) + 2, np.int64)
        names = keys.tolist()
        fresh = [i for i, k in enumerate(names) if k not in self.known]
        raw, s, e = low.tobytes(), start[at], end[at]
        self._learn([names[i] for i in fresh], [raw[s[i] : e[i]] for i in fresh], plain[at[fresh]].tolist() if fresh else [])
        unit = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[inverse]
        size = self.first[unit + 1] - self.first[unit]
        total = np.cumsum(size) - size
        ids = self.ids[np.arange(int(size.sum())) + np.repeat(self.first[unit] - total, size)]
        counts = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
        if self.end_id is not None:
            ids = np.insert(ids, np.cumsum(counts), self.end_id)
            counts += 1
        return ids, counts


def _width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def pack_file(ids: Sequence[int | None], frames: Sequence[bytes], tokens: Sequence[int], width: int, sha: bytes) -> bytes:
    offsets = len(MAGIC) + np.concatenate([[0], np.cumsum([len(f) for f in frames])])
    body = MAGIC + b"".join(frames)
    index = np.array([x or 0 for x in ids], "<i8").tobytes() + bytes([x is None for x in ids]) + offsets.astype("<u8").tobytes() + np.array(tokens, "<u4").tobytes()
    return body + index + np.array([len(body), len(ids)], "<u8").tobytes() + bytes([width]) + sha + MAGIC


class TokenFile:
    """A file's index over anything that reads ``(offset, length)``."""

    def __init__(self, read, size: int, dictionary: bytes):
        foot = read(size - FOOTER, FOOTER)
        if foot[-8:] != MAGIC or read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        at, self.n = np.frombuffer(foot[:16], "<u8").tolist()
        if foot[17:49] != hashlib.sha256(dictionary).digest():
            raise ValueError("another dictionary than the file's")
        self.kind = "<u2" if foot[16] == 2 else "<u4"
        self.read, self.at = read, at
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """Id and token ids of the i-th document; reads only what these need."""
        null = self.read(self.at + 8 * self.n + i, 1) == b"\1"
        lo, hi = np.frombuffer(self.read(self.at + 9 * self.n + 8 * i, 16), "<u8").tolist()
        own = int(np.frombuffer(self.read(self.at + 8 * i, 8), "<i8")[0])
        return None if null else own, np.frombuffer(self.zstd.decompress(self.read(lo, hi - lo)), self.kind).astype(np.uint32)


def open_tokens(uri: str, dictionary: bytes) -> TokenFile:
    """A token file at a URI, for reading single documents."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    file = system.open_input_file(path)
    return TokenFile(lambda at, n: file.read_at(n, at), file.size(), dictionary)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str, text_col: str, sample_docs: int, dictionary_bytes: int) -> bytes:
    """Dictionary of at most ``dictionary_bytes`` from whole texts of up to ``SAMPLE_TEXT`` bytes of at most ``sample_docs`` documents, chosen by a hash of their ids; empty if they are too few to train on."""
    n = docs.count()
    share = 1_000_000 if n <= sample_docs else max(1, 1_000_000 * sample_docs // n)
    texts = docs.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share).select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")).where(F.octet_length("_text") <= SAMPLE_TEXT).limit(sample_docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, end_id)
        kind = "<u2" if _width(encoder.tokenizer.get_vocab_size()) == 2 else "<u4"
        for batch in batches:
            data, off = utf8(batch.column(0))
            flat, counts = encoder(data, off)
            parts = np.split(flat.astype(kind), np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in parts], pa.binary())], ["ids"])

    samples = [bytes(r[0]) for r in texts.mapInArrow(encode, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int | None = 2, order_by: Sequence[Column] | None = None, sample_docs: int = 1000, dictionary_bytes: int = 1 << 16, file_bytes: int = 16 << 20) -> DataFrame:
    """Write the files of ``docs`` in the order of ``order_by`` (ascending ids, nulls first); ``file, n_docs, n_tokens, start`` of each.

    ``start`` is the number of ids in all earlier files. The order is made by a range
    partitioning, so no task holds more than its range; only one row a file is summed up in
    one place. Files are closed at ``file_bytes``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    dictionary = train_dictionary(docs, tokenizer, end_id, id_col, text_col, sample_docs, dictionary_bytes)
    sha = hashlib.sha256(dictionary)
    write_file(f"{folder}/dictionary-{sha.hexdigest()}.zdict", dictionary)
    order = list(order_by) if order_by else [F.col(id_col)]
    keyed = docs.select(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    names = [f"_o{i}" for i in range(len(order))]
    # equal keys may spread over ranges in any order: their texts make it one order
    ranged = keyed.withColumn("_tie", F.xxhash64("_text")).repartitionByRange(*names, "_tie").sortWithinPartitions(*names, "_tie")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, end_id)
        width = _width(encoder.tokenizer.get_vocab_size())
        kind = "<u2" if width == 2 else "<u4"
        files = _Files(folder, ".tok", file_bytes)
        zstd = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        ids: list[int | None] = []
        tokens: list[int] = []
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            if files.parts:
                counts = (len(ids), sum(tokens))
                files.parts = [pack_file(ids, files.parts, tokens, width, hashlib.sha256(dictionary).digest())]
                done.append((files.close(), *counts))
                ids.clear()
                tokens.clear()

        for batch in batches:
            data, off = utf8(batch.column(1))
            own = batch.column(0).to_pylist()
            for i, j in pieces(off):
                flat, counts = encoder(data[off[i] : off[j]], off[i : j + 1] - off[i])
                flat, at = flat.astype(kind), 0
                for k, c in enumerate(counts.tolist()):
                    files.add(zstd.compress(flat[at : at + c].tobytes()))
                    at += c
                    ids.append(own[i + k])
                    tokens.append(c)
                    if files.full():
                        close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], ["file", "n_docs", "n_tokens"])

    written = cut(ranged.select("_id", "_text").mapInArrow(task, "file string, n_docs bigint, n_tokens bigint"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


def read_tokens(spark: SparkSession, folder: str, dictionary: bytes) -> DataFrame:
    """``file, place, doc_id, start_in_file, n_tokens, ids_crc32`` of every document, decoded from the files."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = content.as_buffer()
                view = memoryview(raw)
                file = TokenFile(lambda at, n, view=view: bytes(view[at : at + n]), len(view), dictionary)
                n, at = file.n, file.at
                ids = np.frombuffer(raw, "<i8", n, at)
                null = np.frombuffer(raw, np.uint8, n, at + 8 * n).astype(bool)
                offsets = np.frombuffer(raw, "<u8", n + 1, at + 9 * n).tolist()
                tokens = np.frombuffer(raw, "<u4", n, at + 9 * n + 8 * (n + 1)).astype(np.int64)
                crc, counted = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for i in range(n):
                    doc = np.frombuffer(file.zstd.decompress(view[offsets[i] : offsets[i + 1]]), file.kind).astype("<u4")
                    crc[i], counted[i] = zlib.crc32(doc.tobytes()), len(doc)
                if (counted != tokens).any():
                    raise ValueError("a document doesn't have its declared number of tokens")
                name = path.as_py().rpartition("/")[2]
                columns = [pa.array([name] * n, pa.string()), pa.array(np.arange(n)), pa.array(ids, mask=null), pa.array(np.cumsum(counted) - counted), pa.array(counted), pa.array(crc)]
                yield pa.RecordBatch.from_arrays(columns, ["file", "place", "doc_id", "start_in_file", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    return files.select("path", "content").mapInArrow(task, "file string, place bigint, doc_id bigint, start_in_file bigint, n_tokens bigint, ids_crc32 bigint")


def _dictionary_of(spark: SparkSession, folder: str) -> bytes:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "dictionary-*.zdict").load(folder).select("content").collect()
    return bytes(found[0][0]) if found else b""  # Spark doesn't list an empty file


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int | None = 2, order_by: Sequence[Column] | None = None, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token files and return, from the files, ``id_col, start, n_tokens, ids_crc32, file, place`` of each document.

    Ids are whole numbers (other types that Spark can't cast to them stop the job).
    Defined cases: a null or empty text is the end id alone; null ids come first and stay null;
    rows that repeat an id are documents of their own, in the order of their texts' hashes;
    an empty table writes no document and gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    files = cut(write_tokens(docs, folder, tokenizer, id_col, text_col, end_id=end_id, order_by=order_by, **options))
    found = read_tokens(spark, folder, _dictionary_of(spark, folder))
    joined = found.join(files.select("file", "start"), "file")
    return joined.select(F.col("doc_id").alias(id_col), (F.col("start") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32", "file", "place")
