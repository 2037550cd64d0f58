"""Blocks of token ids in Spark: coded by BlockCoder.java, the same bytes as in numpy, in a fraction of its time."""

import random
import time
import unicodedata
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from sigscreen.llm import blocks, corpus, encode

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def odd_blocks():
    rng = np.random.default_rng(3)
    prose = rng.zipf(1.3, 2048) % 49_000
    return [prose, rng.integers(0, 2**16, 2048), np.zeros(2048, int), np.tile(rng.integers(0, 2**16, 7), 250), np.full(5, 65535),
            np.arange(1), np.zeros(0, int), np.concatenate([prose[:900], prose[:900]]), np.arange(2000) % 3]


def in_spark(spark, name, raw):
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raw)], "i int, raw binary").coalesce(1)
    return [bytes(r[0]) for r in df.select("i", blocks.coder(spark, name)("raw").alias("x")).orderBy("i").select("x").collect()]


def test_bytes_are_those_of_numpy(spark):
    ids = odd_blocks()
    raw = [b.astype("<u4").tobytes() for b in ids]
    packed = in_spark(spark, "PackBlock", raw)
    assert packed == blocks.pack(ids)
    assert in_spark(spark, "UnpackBlock", packed) == raw
    assert [b.tolist() for b in blocks.unpack(packed)] == [b.tolist() for b in ids]


def test_damage_and_large_ids_are_refused(spark):
    block = blocks.pack([np.arange(500)])[0]
    damaged = [block[:40] + bytes([block[40] ^ 1]) + block[41:], block[:-40], b"TIB0" + block[4:], b"", block[:7] + b"\x7f" + block[8:]]
    for bad in damaged:
        with pytest.raises(Exception, match="damaged|not a block"):
            in_spark(spark, "UnpackBlock", [bad])
    with pytest.raises(Exception, match="below 65536"):
        in_spark(spark, "PackBlock", [np.array([65536], "<u4").tobytes()])


def odd_texts():
    r = random.Random(8)
    common = [chr(i) for i in range(0x250) if unicodedata.category(chr(i)) != "Cs"]
    usual = list("abcdeilmrstvé' '''  \n12.,!-")
    texts = ["".join(r.choices(usual if r.random() < 0.8 else common, k=r.randint(0, 300))) for _ in range(300)]
    return texts + ["we'll 're 'r 'l '' 'S don'T o'ver ''s", "a" * 5000, "b" * 1001, "İstanbul ẞ K", "漢字 and <|endoftext|> it's", "x <| y", "", None,
                    "tail'", "'", " \u0085­", "it's " * 3000]


def test_ids_are_those_of_the_encoder(spark):
    corpus.reachable(spark)
    texts = odd_texts()
    enc = encode.Encoder(open(WORD, encoding="utf-8").read())
    want = [[*enc.texts([t or ""])[0].tolist(), 7] for t in texts]
    table = blocks.word_table(enc.tok, 7)
    df = spark.createDataFrame(list(enumerate(t or "" for t in texts)), "i int, text string")
    got = {r.i: r.ids for r in df.select("i", blocks.coder(spark, "EncodeText", table)("text").alias("ids")).collect()}
    left = [i for i in got if got[i] is None]
    assert all(np.frombuffer(got[i], "<u2").tolist() == want[i] for i in got if i not in left)
    assert sum(i < 300 for i in left) < 100                               # most stay in Java
    assert {t for i, t in enumerate(texts) if i in left} >= {"b" * 1001, "İstanbul ẞ K", "x <| y"}


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_texts_of_both_ways_keep_their_order(spark, path, monkeypatch):
    """Neither pack nor unpack of numpy is asked by a query."""
    def refused(*_):
        raise AssertionError("numpy codes blocks")
    monkeypatch.setattr(blocks, "pack", refused)
    monkeypatch.setattr(blocks, "unpack", refused)
    monkeypatch.setattr(blocks, "ROWS", 7)
    corpus.reachable(spark)
    rows = [(None if i % 50 == 3 else i // 2, t) for i, t in enumerate(odd_texts())]
    library = Tokenizer.from_file(path)
    at = 0
    got = sorted(blocks.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), path).collect(), key=lambda r: r.start)
    # Spark orders texts by their bytes
    order = sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], (x[1] or "").encode()))
    for r, (i, t) in zip(got, order, strict=True):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_blocks_take_a_fraction_of_numpys_time(spark):
    rng = np.random.default_rng(5)
    ids = [rng.zipf(1.3, 2048) % 49_000 for _ in range(300)]
    raw = [b.astype("<u4").tobytes() for b in ids]
    in_spark(spark, "UnpackBlock", in_spark(spark, "PackBlock", raw[:5]))
    began = time.time()
    packed = in_spark(spark, "PackBlock", raw)
    assert in_spark(spark, "UnpackBlock", packed) == raw
    took, began = time.time() - began, time.time()
    assert blocks.pack(ids) == packed
    assert took < (time.time() - began) / 2


def test_empty_table(spark):
    corpus.reachable(spark)
    assert blocks.round_trip(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0
