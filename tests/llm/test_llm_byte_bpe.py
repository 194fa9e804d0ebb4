"""Byte-level BPE against the library on whole texts."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
BYTES = open(PATH, "rb").read()
SCHEMA = "doc_id bigint, text string, ids string, n_tokens string, content string, row string"


@pytest.fixture(scope="module")
def enc():
    return byte_bpe.encoder(BYTES, PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sS tl1٣\n\t\r \x85\xa0 　\x1c\x1f​éßЯ中😀_-.!"), max_size=60), st.integers(1, 9), st.integers(2, 5))
def test_parts_give_the_same_ids(text, part, run):
    """Cuts at every few characters and runs of white space taken as pieces change nothing."""
    import re

    enc = byte_bpe.encoder(BYTES, PATTERN)
    old = byte_bpe._LONG_RUN, byte_bpe.RUN
    try:
        byte_bpe._LONG_RUN, byte_bpe.RUN = re.compile(f"[{byte_bpe.WHITE}]{{{run},}}"), run
        assert "".join(p for p, _ in byte_bpe.parts(text, part)) == text
        assert byte_bpe.encode_text(enc, text, part) == enc.encode_ordinary(text)
    finally:
        byte_bpe._LONG_RUN, byte_bpe.RUN = old


def test_long_texts(enc):
    rng = random.Random(1)
    words = ["Some", "wörd", "don't", "12345", "...", "\n\n", "  ", "中文", "é" * 30]
    text = " ".join(rng.choice(words) for _ in range(100_000))
    assert len(list(byte_bpe.parts(text))) > 3
    assert byte_bpe.encode_text(enc, text) == enc.encode_ordinary(text)
    for letter in "aé中1.":  # one match, no place to cut
        one = letter * 300_000
        assert byte_bpe.encode_text(enc, one) == enc.encode_ordinary(one)


@pytest.mark.parametrize("white", [" ", "\n", " \n", "\t 　"])
def test_very_long_white_space(enc, white):
    """The library runs out of stack here; the run is one piece, its last character goes with what follows."""
    run = white * (1_500_000 // len(white))
    for text in (run, f"a{run}b", f"a{run}", f"{run}1 {run}!"):
        ids = byte_bpe.encode_text(enc, text)
        assert enc.decode_bytes(ids) == text.encode()
        short = text.replace(run, white * (3000 // len(white)))
        assert byte_bpe.encode_text(enc, short) == enc.encode_ordinary(short)


def test_digest(spark, enc):
    texts = [None, "", " ", "Ab c", "Ab c", "�\u0000x", "a" * 250_000, "<|endoftext|> end", "  \n x" * 60_000, "\r\n" * 50_000 + "z"]
    rows = [(i if i % 3 else None, t, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)] * 2
    got = byte_bpe.digest(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def expected(ident, text):
        ids = enc.encode_ordinary(text or "")
        return ident, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=order) == sorted((expected(*r[:2]) for r in rows), key=order)


def test_operator_keeps_columns_and_decodes(spark):
    docs = spark.createDataFrame([(1, "Text A", "x", "y", "z", "w"), (2, None, None, None, None, None)], SCHEMA)
    tokens = byte_bpe.encode(docs, PATH, PATTERN)
    assert tokens.select("row.*").columns == docs.columns
    back = byte_bpe.decode(tokens.select("ids"), PATH, PATTERN, carry=[])
    assert sorted(bytes(r["content"]) for r in back.collect()) == [b"", b"Text A"]
    none = byte_bpe.decode(spark.createDataFrame([(None,)], "ids binary"), PATH, PATTERN)
    assert none.collect()[0]["content"] is None
    assert byte_bpe.digest(spark.createDataFrame([], SCHEMA), PATH, PATTERN).count() == 0
