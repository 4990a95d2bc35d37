"""Chat formatting by prefix-target expansion (operator 9; DataFrame functions only).

Every assistant turn becomes one example: all turns up to and including it, of which only
that reply is trainable. Turns after the last assistant turn (all turns, if there is none)
would be in no example, so a conversation that does not end with an assistant turn gets one
more example holding the whole conversation, with nothing trainable.

Template, per turn::

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

ROLE is URL-encoded, so plain names stay as they are and any other can be read back. Control
strings inside a text get a backslash after their first character, and a backslash is
doubled, so no text can open or close a turn and the text can be restored exactly.

Defined results: a null text or role is empty; turns are ordered by (turn, role, text), a
null turn first; equal rows are kept, each as its own turn; rows with a null conversation id
form one conversation; an empty table gives an empty result. A conversation, which one
example holds as a whole, has to fit into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Strings with a meaning to this template or to other widespread ones (fixed values).
CONTROL = (
    r"(<|\[)"
    r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])"
)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def expand_examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                    role: str = "role", text: str = "text",
                    assistant: str = "assistant") -> DataFrame:
    """One row per example: (conv_id, example, formatted, loss_start, loss_length).

    ``loss_start`` and ``loss_length`` count characters of ``formatted`` (from 0); the span
    is the trainable reply, its end mark excluded.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"),
                 F.coalesce(F.col(text), F.lit("")).alias("x")).alias("row"))
    conversations = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    pieces = conversations.select(
        "conv_id",
        F.transform("rows", lambda x: x["r"] == F.lit(assistant)).alias("trained"),
        F.transform("rows", lambda x: F.concat(
            F.lit(START), F.url_encode(x["r"]), F.lit("\n"))).alias("heads"),
        F.transform("rows", lambda x: escape(x["x"])).alias("bodies"))
    count = F.size("bodies")
    last = F.element_at("trained", -1)
    ends = F.filter(
        F.transform(F.sequence(F.lit(1), count), lambda i: F.when(
            F.element_at("trained", i) | (i == count), i)),
        lambda i: i.isNotNull())
    expanded = pieces.select(
        "conv_id", "trained", "heads", "bodies",
        F.posexplode(ends).alias("example", "upto"))
    whole = F.zip_with(F.slice("heads", 1, F.col("upto")), F.slice("bodies", 1, F.col("upto")),
                       lambda h, b: F.concat(h, b, F.lit(END + "\n")))
    body = F.element_at("bodies", F.col("upto"))
    trained = F.element_at("trained", F.col("upto"))
    formatted = expanded.select(
        "conv_id", "example", F.array_join(whole, "").alias("formatted"),
        F.when(trained, F.length(body)).otherwise(0).alias("loss_length"))
    return formatted.select(
        "conv_id", "example", "formatted",
        F.when(F.col("loss_length") > 0, F.length("formatted") - len(END) - 1
               - F.col("loss_length")).otherwise(0).alias("loss_start"), "loss_length")


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted example, restored."""
    parts = F.regexp_extract_all(
        formatted, F.lit(r"(?s)<\|im_start\|>.*?<\|im_end\|>\n"), F.lit(0))

    def restore(part: Column) -> Column:
        head = F.instr(part, "\n")
        role = F.url_decode(F.substring(part, F.lit(len(START) + 1), head - len(START) - 1))
        text = F.substring(part, head + 1, F.length(part) - head - len(END) - 1)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(parts, restore)


def digests(examples: DataFrame) -> DataFrame:
    """What can be read back from the examples, per conversation."""
    reply = unescape(F.expr("substring(formatted, loss_start + 1, loss_length)"))
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
            "example", reply.alias("reply")))), lambda x: x["reply"]), "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    turns = per.select("conv_id", "formatted_chars", "loss",
                       read_turns(F.col("longest")).alias("turns"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars")


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """Prefix-target examples of all conversations and of conversation -7, whose two turns
    hold control strings of a template; what is read back from them, per conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(expand_examples(turns.unionByName(hostile)))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1
             + length(regexp_replace(replace(text, '\', '\\'),
      '(<|\[)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])', '\1\\\2', 'g')))
           OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                 ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""
