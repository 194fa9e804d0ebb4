"""Token-ID output: length-delimited binary records with masked checksums, and a separate offset index.

A record, little-endian::

    length   u64   bytes of the payload
    check    u32   masked CRC-32 of the eight length bytes
    payload        doc_id i64 | has_id u8 | n u32 | n ids, each u16 (u32 if the tokenizer has more than 65,536 ids)
    check    u32   masked CRC-32 of the payload
    end      u8    line feed

The mask rotates a checksum right by 15 bits and adds 0xA282EAD8, so that a checksum stored in data that is itself
checksummed stays useful. Files are written by Spark's text writer (the line feed is its line end), so they reach any
store Spark can write and a retried task leaves no second copy. Ids ascend over the files in the order of the numbers in their names; documents without an id come
first. The index is a Parquet table (file, record, doc_id, offset, length, start, n_tokens): a reader shuffles its rows and fetches
records by offset, without reading the files in order.

Where the tokenizer file says that it normalises and splits as ``NORMALIZER`` and ``PRE_TOKENIZER`` do, encoding is done word by word: white space never joins two
words then, so each distinct word of a group of texts is encoded once and documents are put together by numpy. With any other file the
library encodes whole texts.

Defined results: null text is empty and gets the end id alone; repeated rows are repeated records; equal ids are ordered by a
hash of the text and, with the same hash, by their place in the input, which also deals rows of one id to several files; an empty table gives an index
without rows; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import words as W
from ledgerloom.llm.arrow import small_batches
from ledgerloom.session import materialize, scratch_path

END_ID = 2
FILE_BYTES = 16 << 20
#: Beyond this many files they grow instead.
MAX_FILES = 1_000_000
FILES_PER_BLOCK = 1000
#: How a tokenizer file has to normalise and split for words to be encoded one by one
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
CACHE_WORDS = 300_000
GROUP_BYTES = 2 << 20
_MARKS = b"!#$%&()*+,-./:;=?@[]^_{|}~"
_HEAD = struct.Struct("<QI")
_PAYLOAD = struct.Struct("<qBI")
_CHECK = struct.Struct("<I")


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record around a payload."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _CHECK.pack(masked(zlib.crc32(length))), payload, _CHECK.pack(masked(zlib.crc32(payload))), b"\n"))


def unframe(data, at: int = 0) -> tuple[memoryview, int]:
    """The payload of the record at an offset and the offset after it; ValueError if a checksum or length is wrong."""
    if at + _HEAD.size > len(data):
        raise ValueError(f"record at {at}: cut off")
    length, check = _HEAD.unpack_from(data, at)
    if check != masked(zlib.crc32(data[at : at + 8])):
        raise ValueError(f"record at {at}: wrong length checksum")
    start, end = at + _HEAD.size, at + _HEAD.size + length
    if end + 5 > len(data):
        raise ValueError(f"record at {at}: cut off")
    payload = data[start:end]
    if _CHECK.unpack_from(data, end)[0] != masked(zlib.crc32(payload)):
        raise ValueError(f"record at {at}: wrong payload checksum")
    if data[end + 4] != 10:
        raise ValueError(f"record at {at}: no end")
    return payload, end + 5


def pack(doc_id: int | None, ids: bytes, n: int) -> bytes:
    return _PAYLOAD.pack(doc_id or 0, doc_id is not None, n) + ids


def unpack(payload) -> tuple[int | None, np.ndarray]:
    """The document's id and its token ids."""
    doc_id, has_id, n = _PAYLOAD.unpack_from(payload)
    body = payload[_PAYLOAD.size :]
    return doc_id if has_id else None, np.frombuffer(body, dtype="<u2" if len(body) == 2 * n else "<u4", count=n)


def _byte_characters() -> dict[int, str]:
    """The character a byte-level vocabulary writes each byte as: itself if it is a visible Latin-1 character, else one from 256 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in visible)}


class WordEncoder:
    """Token ids of single words (no white space in them), kept for the next group.

    A word of lower-case letters is one pre-token that the normaliser leaves alone, so the model is asked directly; so are such letters before a
    run of ASCII marks, which is a pre-token of its own. All other words go through the whole tokenizer."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            form = json.load(f)
        self.by_words = form.get("normalizer") == NORMALIZER and form.get("pre_tokenizer") == PRE_TOKENIZER
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype, self.code = np.dtype("<u4" if wide else "<u2"), "<%dI" if wide else "<%dH"
        self.tokenize, self.cache, self.cache_words = self.tokenizer.model.tokenize, {}, cache_words
        self.bytes_as = _byte_characters()
        self.marks: dict[bytes, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(self.code % len(ids), *ids)

    def _letters(self, word: bytes) -> bytes | None:
        """The ids of a word of lower-case letters in composed form; None for other words."""
        if word.isalpha():  # of bytes: ASCII letters
            if not word.islower():
                return None
            text = word.decode()
        else:
            text = word.decode()
            if not (text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)):
                return None
            text = word.decode("latin-1").translate(self.bytes_as)
        return self._pack([t.id for t in self.tokenize(text)])

    def _mark(self, mark: bytes) -> bytes:
        ids = self.marks.get(mark)
        if ids is None:
            ids = self._pack(self.tokenizer.encode(mark.decode(), add_special_tokens=False).ids)
            if len(self.marks) < 10_000:
                self.marks[mark] = ids
        return ids

    def encode(self, found: list[bytes]) -> list[bytes]:
        """The ids of each word as bytes."""
        if not found:
            return []
        get, room = self.cache.get, self.cache_words - len(self.cache)
        out = [get(w) for w in found]
        rest = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            word = found[k]
            core = word.rstrip(_MARKS)
            ids = get(core) if len(core) < len(word) else None
            if core and ids is None:
                ids = self._letters(core)
            elif core and not core.decode()[-1].isalpha():  # a cached word that ends in another mark would run on into these
                ids = None
            if ids is not None and len(core) < len(word):
                ids += self._mark(word[len(core) :])
            if ids is None:
                rest.append(k)
            out[k] = ids
            if ids is not None and room > 0:
                self.cache[word] = ids
                room -= 1
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([found[k].decode() for k in rest], add_special_tokens=False), strict=True):
            out[k] = self._pack(e.ids)
            if room > 0:
                self.cache[found[k]] = out[k]
                room -= 1
        return out


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the Latin-1 capitals, two bytes each in UTF-8; other capitals are left to the tokenizer."""
    out = W.FOLD[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[capital] += 0x20
    return out


def encode_texts(texts: W.Texts, encoder: WordEncoder, fold: bool) -> Iterator[bytes]:
    """The ids of each row of a group, as bytes. ``fold``: the tokenizer lower-cases, so words are folded first."""
    if not encoder.by_words:
        data, bounds = texts.data.tobytes(), texts.bounds.tolist()
        whole = [data[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for e in encoder.tokenizer.encode_batch_fast(whole, add_special_tokens=False):
            yield encoder._pack(e.ids)
        return
    if fold and b"<|" not in texts.data.tobytes():  # special tokens are matched as written, before the tokenizer lower-cases
        texts = W.Texts(texts.lo, texts.hi, _lower(texts.data), texts.bounds)
    w = W.words(texts, W.NOT_SPACE, np.arange(256, dtype=np.uint8))
    rows = texts.hi - texts.lo
    if not len(w.start):
        yield from [b""] * rows
        return
    _, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
    data = texts.data.tobytes()
    order = np.argsort(first)  # words in the order of their first use: the cache keeps the common ones
    ids = encoder.encode([data[a:b] for a, b in zip(w.start[first[order]].tolist(), w.end[first[order]].tolist(), strict=True)])
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    which = rank[which]
    size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // encoder.dtype.itemsize
    flat = np.frombuffer(b"".join(ids), dtype=encoder.dtype)
    begin = np.cumsum(size) - size
    n = size[which]
    to = np.cumsum(n)
    at = np.arange(to[-1]) + np.repeat(begin[which] - (to - n), n)
    out = flat[at].tobytes()
    ends = np.concatenate([[0], to])[np.searchsorted(w.row, np.arange(rows + 1))] * encoder.dtype.itemsize
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield out[a:b]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, fold: bool = True, file_bytes: int | None = None) -> str:
    """Encodes the documents and writes them below ``path``: record files in ``records``, the index in ``index``.

    ``fold`` is for tokenizers that lower-case their input. Returns ``path``."""
    spark = docs.sparkSession
    sizes = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).head()
    bytes_out = max(int(sizes["b"] or 0), sizes["n"] * 32)  # ids take less room than their text
    files = max(1, bytes_out // (file_bytes or max(FILE_BYTES, bytes_out // MAX_FILES)))

    def run(batches):
        encoder = WordEncoder(tokenizer)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for texts in W.groups(batch.column("text"), GROUP_BYTES):
                out = []
                for k, ids in enumerate(encode_texts(texts, encoder, fold)):
                    ids += end
                    out.append(frame(pack(doc_ids[texts.lo + k].as_py(), ids, len(ids) // encoder.dtype.itemsize))[:-1])  # the writer ends it
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    (
        small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
        .repartitionByRange(files, "doc_id", "hash", "place")
        .sortWithinPartitions("doc_id", "hash", "place")
        .mapInArrow(run, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.mode("overwrite")
        .text(f"{path}/records")
    )
    _index(spark, path).write.mode("overwrite").parquet(f"{path}/index")
    return path


_ROW = "file string, record bigint, doc_id bigint, offset bigint, length bigint, before bigint, n_tokens bigint, ids_crc32 bigint"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files, checksums verified: file, record, doc_id, offset, length, before (ids of the file before it), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data, at, before, rows = memoryview(content.as_buffer()), 0, 0, []
                while at < len(data):
                    payload, after = unframe(data, at)
                    doc_id, ids = unpack(payload)
                    rows.append((name.rsplit("/", 1)[-1], len(rows), doc_id, at, after - at, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at, before = after, before + len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))],
                        names=[f.split()[0] for f in _ROW.split(", ")],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    return small_batches(files).select("path", "content").mapInArrow(run, _ROW)


def _index(spark: SparkSession, path: str) -> DataFrame:
    """The scanned records with ``start``: ids of all records before, over all files in the order of their numbers.

    The files are read once, their rows written. Totals of files are summed in two levels, so no task sees one row a file."""
    return with_starts(materialize(scan(spark, path), "record_rows"))


def with_starts(rows: DataFrame) -> DataFrame:
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # names have at least five digits, so from 100,000 files on their order isn't that of the numbers
    totals = totals.withColumn("number", F.regexp_extract("file", r"^part-(\d+)", 1).cast("bigint"))
    totals = totals.withColumn("block", F.floor(F.col("number") / FILES_PER_BLOCK))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n"))
    w = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("block_start"))
    w = Window.partitionBy("block").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.join(blocks, "block").select("file", (F.col("block_start") + F.coalesce(F.sum("n").over(w), F.lit(0))).alias("file_start"))
    return rows.join(totals, "file").select("file", "record", "doc_id", "offset", "length", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str, chosen: DataFrame | None = None) -> DataFrame:
    """(doc_id, ids) of the records that ``chosen`` rows of the index name (all without it), fetched by offset."""
    index = read_index(spark, path) if chosen is None else chosen
    wanted = index.groupBy("file").agg(F.collect_list("offset").alias("offsets"))  # at most a file's records
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(wanted, "file")

    def run(batches):
        for batch in batches:
            for content, offsets in zip(batch.column("content"), batch.column("offsets"), strict=True):
                data = memoryview(content.as_buffer())
                rows = [unpack(unframe(data, at)[0]) for at in offsets.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tolist() for r in rows], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return small_batches(files).select("content", "offsets").mapInArrow(run, "doc_id bigint, ids array<bigint>")


def digest(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files written (below the shared folder if no path is given)."""
    path = write(docs, path or scratch_path(docs.sparkSession, "records"), tokenizer)
    return read_index(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")
