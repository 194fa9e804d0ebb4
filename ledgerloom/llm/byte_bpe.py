"""Byte-level BPE with the tiktoken library and a local rank file, and its raw-byte decoding.

The rank file is read once on the driver and sent to the tasks by its bytes (a vocabulary, not data), so executors need no copy of it; each Python
worker builds the library's encoder once. A short text goes to the library whole. A text beyond ``PART`` characters is cut first, at
places where the split pattern always starts a new match, so that each part gives the ids it gives inside the text:

* between a word character and ASCII white space after it: every alternative ends before white space, and looks only ahead from there;
* around a run of ``RUN`` white space characters or more (where the library's regex engine runs out of stack). The pattern takes such a run as one
  match; if more text follows, all but the last character, which begins the next match. The match goes to the library as one piece.

A text without such places (one word of any length) stays one part. Decoding joins the bytes of the ids, so it needs no
whole characters at the seams and gives back any text exactly.

Defined results: null text is empty; an empty text has no ids and no bytes; repeated rows are rows of their own; an id outside the vocabulary is an
error in decoding and null ids give null content; an empty table gives an empty table. Other columns ride in the struct ``row`` and cannot clash.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.arrow import small_batches

PART = 100_000
RUN = 1000
# The characters of Unicode's White_Space property, which the split pattern's \s stands for
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{WHITE}]{{{RUN},}}")
_SEAM = re.compile(r"\w(?=[ \t\r\n])")

_encoders: dict[tuple[int, str], object] = {}


def encoder(rank_file: bytes, pattern: str):
    """The library's encoder for the content of a rank file (lines of base64 bytes and rank); built once a process."""
    import tiktoken

    key = (zlib.crc32(rank_file), pattern)
    if key not in _encoders:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def parts(text: str, part: int | None = None) -> Iterator[tuple[str, bool]]:
    """(part, whole): the parts of a text in order; ``whole`` parts are one match of the pattern."""
    part = PART if part is None else part
    at = 0
    for run in _LONG_RUN.finditer(text) if len(text) >= RUN else ():
        yield from ((p, False) for p in _cut(text, at, run.start(), part))
        at = run.end() - (run.end() < len(text))
        yield text[run.start() : at], True
    yield from ((p, False) for p in _cut(text, at, len(text), part))


def _cut(text: str, at: int, end: int, part: int) -> Iterator[str]:
    while end - at > part:
        seam = _SEAM.search(text, at + part - 1, end)
        if seam is None:
            break
        yield text[at : seam.end()]
        at = seam.end()
    if at < end:
        yield text[at:end]


def encode_text(enc, text: str, part: int | None = None) -> list[int]:
    """The ids of a whole text, as the library gives them for all of it."""
    if len(text) <= (PART if part is None else part) and not (len(text) >= RUN and _LONG_RUN.search(text)):
        return enc.encode_ordinary(text)
    out: list[int] = []
    for p, whole in parts(text, part):
        out += enc._encode_single_piece(p) if whole else enc.encode_ordinary(p)
    return out


def _send(df: DataFrame, rank_file: str):
    with open(rank_file, "rb") as f:  # on the driver
        return df.sparkSession.sparkContext.broadcast(f.read())


def _row(df: DataFrame, carry: list[str] | None) -> Column:
    return (F.struct("*") if carry is None else F.struct(*(F.col(f"`{c}`") for c in carry))).alias("row")


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, ids, n_tokens): ids as little-endian unsigned 32-bit integers; row has all columns, or those of ``carry``."""
    sent = _send(docs, rank_file)
    source = small_batches(docs).select(_row(docs, carry), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("row", source.schema["row"].dataType), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value, pattern)
        for batch in batches:
            ids = [np.array(encode_text(enc, t.as_py()), dtype="<u4") for t in batch.column("text")]
            columns = [batch.column("row"), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "ids", "n_tokens"])

    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, rank_file: str, pattern: str, ids: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """(row, content): the bytes that the ids stand for, which are the text's UTF-8 bytes if they came from ``encode``."""
    sent = _send(tokens, rank_file)
    source = small_batches(tokens).select(_row(tokens, carry), F.col(f"`{ids}`").alias("ids"))
    schema = T.StructType([T.StructField("row", source.schema["row"].dataType), T.StructField("content", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value, pattern)
        for batch in batches:
            packed = (i.as_buffer() for i in batch.column("ids"))
            content = [None if i is None else enc.decode_bytes(np.frombuffer(i, dtype="<u4").tolist()) for i in packed]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(content, pa.binary())], names=["row", "content"])

    return source.mapInArrow(run, schema)


def digest(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    encoded = encode(docs, rank_file, pattern, carry=["doc_id"]).select("row.doc_id", "n_tokens", "ids")
    decoded = decode(encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256")), rank_file, pattern, carry=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("row.doc_id", "row.n_tokens", "row.ids_sha256", F.sha2("content", 256).alias("decoded_sha256"))
