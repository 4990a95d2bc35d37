import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bidlake.llm.packing import (
    combinations,
    default_ranks,
    op7_packing,
    pack,
    plan,
    solve,
    token_ids,
)


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def reference_ids(reference, text):
    return reference.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_ids_equal_the_tokenizers_library(reference, text):
    assert token_ids(text, default_ranks()).tolist() == reference_ids(reference, text)


@pytest.mark.parametrize("text", [
    None, "", "<|endoftext|> a<|endoftext|><|endoftext", "  \n\n x  ", "'s 'LL 12 ½ é ñandú 漢字 🙂",
    "a" * 5_000, "ab" * 3_000, " " * 2_000 + "x", "!?" * 900, "   x\t\r\n"])
def test_special_ids(reference, text):
    assert token_ids(text, default_ranks()).tolist() == reference_ids(reference, text)


def check(rows, docs, window, reference):
    ids = {k: reference_ids(reference, t) for k, t in docs}
    fill, cover = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        cover.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for parts in [*fill.values(), *cover.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    assert {k: sum(n for _, n in v) for k, v in cover.items()} == {k: len(v) for k, v in ids.items()}
    sizes = [sum(n for _, n in v) for v in fill.values()]
    assert max(sizes, default=0) <= window
    assert sum(s < window for s in sizes) <= 1  # only the last sequence is padded


def test_whole_table(spark, sf_small, documents, reference):
    check(op7_packing(spark, sf_small).collect(), documents, 1024, reference)


def test_edge_cases(spark, texts, reference):
    docs = [(1, None), (2, ""), (3, "a b c"), (4, " x" * 5_000), (5, "y" * 15), (6, " z" * 15),
            (7, " z" * 16), (8, "<|endoftext|>")] + [(100 + k, " q" * 9) for k in range(30)]
    check(pack(texts(docs), window=16).collect(), docs, 16, reference)
    assert pack(texts([])).count() == 0


def test_repeated_rows(spark, texts):
    rows = pack(texts([(1, " a b c")] * 5 + [(1, " d e"), (None, " f")]), window=4).collect()
    assert sum(r["length"] for r in rows) == 5 * 4 + 3 + 2
    places = [(r["sequence_id"], r["offset"] + k) for r in rows for k in range(r["length"])]
    assert len(set(places)) == len(places)


def test_least_squares_meets_a_histogram_that_combinations_can_meet():
    patterns = combinations(16, np.arange(1, 16))
    assert (patterns.sum(1) == 16).all()
    truth = np.zeros(len(patterns))
    truth[[3, 10, 20]] = [400, 90, 1000]
    counts = np.bincount(patterns.ravel(), weights=np.repeat(truth, 3), minlength=17)
    x = solve(patterns, counts, 3000)
    made = np.bincount(patterns.ravel(), weights=np.repeat(x, 3), minlength=17)
    assert (x >= 0).all() and np.abs(made - counts)[1:].max() < 0.02 * counts[1:].max()


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 15), st.integers(1, 50)))
def test_plan_places_every_rest_once(histogram):
    rows, sequences = plan(histogram, 16)
    for length, n in histogram.items():
        ranks = sorted((a, b) for v, a, b, *_ in rows if v == length)
        assert ranks[0][0] == 0 and ranks[-1][1] == n
        assert all(x[1] == y[0] for x, y in zip(ranks, ranks[1:]))
    used = sum(v * (b - a) for v, a, b, _, _, residual in rows if not residual)
    assert used == 16 * sequences
