"""Texts in which the tokenizer's added tokens are written out."""

import zlib

import numpy as np
import pyarrow as pa

from paperloom.llm import common, packing

TEXTS = ["plain words", "one <|endoftext|> two", "", "<|startoftext|>", "a<|endoftext|>b 12<|startoftext|>", "x <|ENDOFTEXT|> y <| endoftext |>", "<|endoftext", "|> last one 3"]


def whole(t):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.word_bpe_path()).encode(t, add_special_tokens=False).ids


def test_added_tokens_are_encoded_as_in_whole_texts():
    assert 49407 in whole(TEXTS[1])
    for texts in (TEXTS, TEXTS[::-1], TEXTS[1:2], TEXTS[:1]):
        ids, begins = packing.Encoder(packing.word_bpe_path()).texts(*common.text_bytes(pa.array(texts)))
        assert begins[-1] == len(ids)
        assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == [whole(t) for t in texts]


def test_pack_with_added_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in packing.pack(docs, packing.word_bpe_path()).collect():
        ids = [*whole(TEXTS[r.doc_id]), 2]
        assert (r.length, r.doc_tokens, r.ids_crc32) == (len(ids), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
