import random

import public_tokenizers
import pytest
import tiktoken

from voltlake.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id bigint, text string, ids string, start string, key string"


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.Tokenizer(f.read(), PATTERN).encoding()._mergeable_ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    parts = ["don't", "l'été", "  ", "\n\n", "\n \n", "12345", "!!!", "'re", "…", "日本語", "\u00a0", "\x1c", "a" * 70, " ", "<|endoftext|>", "\t", "🙂"]
    made = ["".join(rng.choice(parts) for _ in range(n)) for n in (3, 50, 400, 2000)]
    return [None, "", " ", *made, "x" * 5000, " " * 3000, "word " * 3000, "é" * 3000 + " end" * 50]


def test_ids_are_those_of_the_library_and_decode_to_the_text(spark, reference):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts())] + [(3, texts()[3], None, None, None), (None, "null key " * 400, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for chunk, overlap in ((16384, 512), (200, 40), (64, 64)):
        encoded = bpe.encode(docs, RANKS, PATTERN, chunk_chars=chunk, overlap=overlap)
        assert encoded.columns == ["doc_id", "ids"]
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.ids, bytes(r.decoded)) for r in bpe.decode(encoded, RANKS, PATTERN).collect()), key=str)
        want = sorted(((i is None, i or 0, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows), key=str)
        assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert bpe.digests(bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)).collect() == []


def test_null_ids_decode_to_no_bytes(spark):
    assert bytes(bpe.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), RANKS, PATTERN).first().decoded) == b""
