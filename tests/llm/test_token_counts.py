"""Counts against whole texts encoded by the libraries themselves."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bidlake.llm import token_counts as T

JSON = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(JSON)


def plain(texts, tokenizer=LIBRARY):
    return [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def in_pieces(text, size):
    encode, boundary = T.encoder(JSON)
    return sum(encode([p for p in T.pieces(text, boundary, size) if p]))


def test_every_code_point_counts_as_in_the_library():
    encode, _ = T.encoder(JSON)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 40_000):
        texts = [f"a{chr(c)}1 {chr(c)}{chr(c)} .{chr(c)}" for c in points[at:at + 40_000:7]]
        assert encode(texts) == plain(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(
    " \n\t\r\x0b\x1c\x85\xa0\u2003\u200b\u3000ab's'llz19.,<|endoftext|>\xe9\u4e2d\u0301\u0436"),
    max_size=120) | st.text(max_size=80), st.integers(1, 30))
def test_pieces_add_up_to_the_whole(text, size):
    text = text.replace("endo", "<|endoftext|>")
    assert in_pieces(text, size) == plain([text])[0]
    _, boundary = T.encoder(JSON)
    assert "".join(T.pieces(text, boundary, size)) == text


def test_batches_are_balanced_by_bytes():
    _, boundary = T.encoder(JSON)
    texts = ["short"] * 1000 + [None, "", "long words " * 200_000] + ["w" * 300_000]
    made = list(T.batches_of(texts, boundary))
    sizes = [sum(len(p) for p in held) for _, held in made]
    assert max(sizes) < 2 * T.BATCH_BYTES and len(made) > 3
    back = {}
    for rows, held in made:
        for r, p in zip(rows, held, strict=True):
            back[r] = back.get(r, "") + p
    assert back == {k: t for k, t in enumerate(texts) if t}


@pytest.fixture(scope="module")
def hostile():
    long = "Ein langer Satz, 12 Woerter; <|endoftext|> and more. " * 20_000
    return [(1, None), (2, ""), (3, "plain words"), (3, "plain words"), (None, "no id"),
            (4, long), (5, "中文" * 60_000), (6, "<|endoftext|><|endoftext|> x"),
            (7, " \n\t  " * 30_000), (8, "a" * 200_000), (9, "it's we'll жж 10² \U0001f600")]


def test_hostile_texts(spark, texts, hostile):
    got = T.count_tokens(texts(hostile)).collect()
    whole = plain([t or "" for _, t in hostile])
    assert sorted(map(tuple, got), key=str) == sorted(
        [(i, len((t or "").encode()), n, n > 1024)
         for (i, t), n in zip(hostile, whole, strict=True)], key=str)


def test_other_files_are_left_to_their_library(spark, texts, hostile):
    import sentencepiece

    short = [(i, t) for i, t in hostile if len(t or "") < 1000]
    own = Tokenizer.from_file(WORDS)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for path, counts in ((WORDS, plain([t or "" for _, t in short], own)),
                         (PIECES, [len(x) for x in model.encode([t or "" for _, t in short])])):
        got = T.count_tokens(texts(short), path=path, limit=3).collect()
        assert sorted([(r["doc_id"], r["n_tokens"], r["over_limit"]) for r in got], key=str) == \
            sorted([(i, n, n > 3) for (i, _), n in zip(short, counts, strict=True)], key=str)


def test_empty_table(spark, texts):
    got = T.count_tokens(texts([]))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert got.collect() == []


def test_query_equals_whole_texts(spark, sf_small, documents):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"])
           for r in T.op12_token_counts(spark, sf_small).collect()}
    counts = plain([t or "" for _, t in documents])
    assert got == {i: (len((t or "").encode()), n, n > 1024)
                   for (i, t), n in zip(documents, counts, strict=True)}
