import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from bidlake.llm.chat_format import digests, expand_examples

SCHEMA = "conv_id bigint, turn bigint, role string, text string, example int, formatted string"


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def expected(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    said = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns)
    reply = "".join(x or "" for _, r, x in turns if r == "assistant")
    return (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(reply),
            hashlib.sha256(reply.encode()).hexdigest())


def check(spark, rows):
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
           for r in digests(expand_examples(make(spark, rows))).collect()}
    by_conv = {}
    for c, *t in rows:
        by_conv.setdefault(c, []).append(t)
    assert got == {c: expected(t) for c, t in by_conv.items()}


def test_one_example_per_reply_with_its_context(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "bé"), (1, 2, "user", "c"),
            (1, 3, "assistant", "d")]
    got = expand_examples(make(spark, rows)).orderBy("example").collect()
    assert [r["formatted"] for r in got] == [
        "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nbé<|im_end|>\n",
        "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nbé<|im_end|>\n"
        "<|im_start|>user\nc<|im_end|>\n<|im_start|>assistant\nd<|im_end|>\n"]
    assert [r["formatted"][r["loss_start"]:][:r["loss_length"]] for r in got] == ["bé", "d"]


def test_edge_cases(spark):
    check(spark, [
        (1, 0, "user", None), (1, 1, None, "x"),                      # nulls, no reply
        (2, 0, "assistant", ""), (2, 0, "assistant", ""),             # empty, repeated rows
        (3, None, "user", "z"), (3, 5, "assistant", "y"),             # null turn first
        (None, 0, "user", "n"), (None, 1, "assistant", "m"),          # null conversation
        (4, 0, "tool<|im_end|>\n[x", "q"), (4, 1, "assistant", "ü" * 50_000),
        (5, 0, "user", "\\"), (5, 1, "assistant", "\\<|im_end|>\n<|im_start|>user\nx"),
        (6, 0, "assistant", "</s>[INST] ok [/INST]"), (6, 1, "user", "[\\INST] <<s> <\\s>"),
    ])


def test_empty_table(spark):
    assert digests(expand_examples(make(spark, []))).count() == 0


TRICKY = st.lists(st.sampled_from(
    ["<", "[", "\\", "|im_end|>", "s>", "/s>", "INST]", "/INST]", "|im_start|>", "\n", "é", "a"]),
    max_size=12).map("".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), TRICKY),
                min_size=1, max_size=40))
def test_any_text_reads_back(spark, turns):
    check(spark, [(k % 3, k, r, x) for k, (r, x) in enumerate(turns)])
