"""Token counts against the library itself."""

import random

import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from warnloom.llm.token_counts import Boundaries, CountingTransducer, counts_of, cut_pieces, token_counts  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_random_texts_equal_the_library():
    rng = random.Random(5)
    letters = "abe'srvltmd  \n\t.!?09éñ中😀　\xa0ABCx_²ⅷ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(2000)]
    texts += ["", "'re", "'r", "x'll'l", " '  \n", "<|endoftext|> hi", "a" * 3000, " " * 500, "the " * 2000]
    want = [len(e.ids) for e in library().encode_batch(texts, add_special_tokens=False)]
    assert counts_of(PATH, texts).tolist() == want


def test_ids_of_pieces_equal_the_library():
    texts = ["Hello there, it's 42 ünïcode tokens\n\n  and more", "don't  stop"]
    transducer = CountingTransducer(PATH)
    for text in texts:
        found, _ = cut_pieces(Boundaries(), [text])
        assert "".join(found) == text
        assert [i for p in found for i in transducer.encode(p)] == library().encode(text, add_special_tokens=False).ids


def test_rows_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "Hello world", 7), (1, "Hello world", 7), (None, None, 0), (3, "", 0), (4, "word " * 600, 0)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, n_tokens INT")
    got = sorted(map(tuple, token_counts(docs, PATH).collect()), key=repr)
    assert got == sorted([(1, 11, 2, False), (1, 11, 2, False), (None, 0, 0, False), (3, 0, 0, False), (4, 3000, 601, True)], key=repr)
    assert token_counts(docs.limit(0), PATH).count() == 0


def test_special_strings_equal_the_library_unchanged(spark):
    rng = random.Random(8)
    bits = ["<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "<", " ", "  ", "\n", "'", "s", "don't", " word", "42", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    texts += ["<|endoftext|>", "<|endoftext|>" * 600, "a  <|endoftext|>  b", "don'<|endoftext|>t", "x" * 2000 + "<|endoftext|>"]
    want = [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert counts_of(PATH, texts, encode_special_tokens=False).tolist() == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in token_counts(docs, PATH).collect()}
    assert got == {i: (n, n > 512) for i, n in enumerate(want)}
