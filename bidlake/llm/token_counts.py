"""Token counts of whole texts (operator 12).

Texts go to Python in Arrow batches; only lengths come back. Inside a task:

1. A text longer than ``PIECE_BYTES`` is cut at safe boundaries, places where no token of the
   tokenizer can reach across, so that the counts of the pieces add up to the count of the
   whole. Where no such place is known, a text stays whole; it is never cut elsewhere.
2. Pieces of consecutive texts make batches of about ``BATCH_BYTES``, whatever the number of
   texts: many short texts share a batch, a long one fills several.
3. A batch is encoded at once; the lengths of its pieces are added to their texts' counts.

So what a task holds at a time is one Arrow batch, one batch of pieces and its ids. Nothing is
shuffled; the files' splits, cut by bytes, are the tasks.

Counts are those of the library that belongs to the file: ``tokenizers`` for ``.json``,
``sentencepiece`` for ``.model``; without added special tokens, truncation or padding, special
strings inside a text being tokens or not as the library has it by default. A byte-level BPE
without a normalizer, whose merges stand in the order of its ids, is run by ``tiktoken`` on the
file's own vocabulary: the same counts (compared in the tests, for every code point too) at a
quarter of the time. For other files the library itself is called, in batches.

Safe boundaries are known for such a byte-level BPE: before a space or line feed that follows a
visible character, since a word takes white space only at its front and the pattern looks
ahead only from white space, and special strings hold none. Other files have none here.

Defined results: a null text counts as empty (0 bytes, 0 tokens); empty texts have 0 tokens;
repeated rows and null ids are counted each; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

LIMIT = 1024
#: Longer texts are cut in pieces of about this size.
PIECE_BYTES = 64 << 10
#: Text encoded at once.
BATCH_BYTES = 512 << 10

#: A space or line feed behind a character that is no white space, control or format character.
BOUNDARY = re.compile(
    "(?<=[^\\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff])"
    "[ \n]")
#: The pattern that byte-level BPE files with ``use_regex`` stand for (a fixed value).
BYTE_LEVEL_PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

Lengths = Callable[[list[str]], list[int]]
_ENCODERS: dict[str, tuple[Lengths, re.Pattern | None]] = {}


def byte_characters() -> dict[str, int]:
    """The printable character that byte-level files write for each byte."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a plain byte-level BPE; None if the file is anything else."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not spec.get("normalizer")
             and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
             and split.get("use_regex", True)
             and not any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges",
                                                "continuing_subword_prefix",
                                                "end_of_word_suffix", "byte_fallback"))
             and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or not t["special"]
                         or re.search(r"\s", t["content"]) for t in spec["added_tokens"]))
    if not plain:
        return None
    table = byte_characters()
    ids = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [ids.get(a + b) for a, b in merges]
    special = {t["content"] for t in spec["added_tokens"]}
    words = {w for w in ids if w not in special}
    singles = {w for w in words if len(w) == 1}
    if (any(c not in table for w in words for c in w) or singles != set(table)
            or None in made or made != sorted(set(made)) or len(words) != len(singles) + len(made)
            or max(ids[w] for w in singles) > min(made, default=1 << 32)):
        return None
    return {bytes(table[c] for c in w): ids[w] for w in words}


def encoder(path: str) -> tuple[Lengths, re.Pattern | None]:
    """(lengths of a batch of texts, safe boundary or None); loaded once in each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = load(path)
    return _ENCODERS[path]


def load(path: str) -> tuple[Lengths, re.Pattern | None]:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], None
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ranks = byte_level_ranks(spec)
    if ranks is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        return lambda texts: [
            len(x) for x in whole.encode_batch_fast(texts, add_special_tokens=False)], None
    import tiktoken

    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    own = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks,
                            special_tokens=special)
    return lambda texts: [
        len(own.encode_to_numpy(x, allowed_special="all")) for x in texts], BOUNDARY


def pieces(text: str, boundary: re.Pattern | None, size: int = PIECE_BYTES) -> Iterator[str]:
    """``text`` cut at safe boundaries into pieces of ``size`` characters or little more."""
    start = 0
    while boundary is not None and len(text) - start > size:
        found = boundary.search(text, start + size)
        if found is None:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:]


def batches_of(texts: list[str | None], boundary: re.Pattern | None,
               size: int = BATCH_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, pieces) of about ``size`` bytes (one piece at least)."""
    rows: list[int] = []
    held: list[str] = []
    room = size
    for row, text in enumerate(texts):
        if not text:
            continue
        for piece in pieces(text, boundary):
            rows.append(row)
            held.append(piece)
            room -= len(piece) if piece.isascii() else len(piece.encode())
            if room <= 0:
                yield rows, held
                rows, held, room = [], [], size
    if held:
        yield rows, held


def lengths(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Each row's key, bytes and token count."""
    encode, boundary = encoder(path)
    for batch in batches:
        texts = batch.column(2).to_pylist()
        counts = np.zeros(len(texts), np.int64)
        for rows, held in batches_of(texts, boundary):
            np.add.at(counts, rows, encode(held))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts)], ["key", "n_bytes", "n_tokens"])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(texts: DataFrame, key: str = "doc_id", text: str = "text",
                 path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``texts``: (key, n_bytes, n_tokens, over_limit).

    ``path`` is a tokenizer's file, which all executors can read under that name.
    """
    small_batches(texts.sparkSession)
    file = path or default_path()
    rows = texts.select(
        F.col(key).alias("key"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    counted = rows.mapInArrow(lean(lambda batches: lengths(batches, file)),
                              f"key {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
