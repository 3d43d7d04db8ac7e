"""Chat formatting with relational operators only: collected turn structs are sorted, adjacent turns of one role are
merged by array aggregation, and blocks are concatenated by Spark expressions.

Layout of one conversation, with OPEN/SEP/CLOSE control strings::

    <|im_start|>role\\ntext[<|im_sep|>text ...]<|im_end|>\\n<|im_start|>...

Inside roles and texts every control string, the escape character and (in roles) the line feed are written as
escapes, so a reader that splits at control strings gets every turn back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
ESC = "\\"
#: String to escape -> its escaped form; the escape character is first when writing and last when reading.
#: The foreign markers are escaped too, so that no reader of another template takes them for its own.
ESCAPES = (
    (ESC, ESC + "e"), (OPEN, ESC + "o"), (SEP, ESC + "p"), (CLOSE, ESC + "c"), ("[/INST]", ESC + "i"), ("[INST]", ESC + "j"), ("</s>", ESC + "s"), ("<s>", ESC + "t"),
)
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(ESC + "n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(ESC + "n"), F.lit("\n")))


def merged_turns(turns: Column) -> Column:
    """array<struct<role, texts: array<string>>> from a sorted array of turns; adjacent turns of a role share a block.

    A block is the slice from a turn whose role differs from the one before to the next such turn."""
    at = F.sequence(F.lit(0), F.size(turns) - 1)
    begins = F.filter(at, lambda i: (i == 0) | ~F.get(turns, i)["role"].eqNullSafe(F.get(turns, i - 1)["role"]))

    def block(begins: Column) -> Column:
        def cut(i: Column, k: Column) -> Column:
            own = F.slice(turns, i + 1, F.coalesce(F.get(begins, k + 1), F.size(turns)) - i)
            return F.struct(F.get(turns, i)["role"].alias("role"), F.transform(own, lambda t: t["text"]).alias("texts"))

        return F.transform(begins, cut)

    return let(begins, block)


def starts_of(lengths: Column) -> Column:
    """Sum of the lengths before each element. Sums grow inside runs of about the root of the number of elements and
    then over the runs, so that no long array is copied for each element."""
    empty = F.array().cast("array<bigint>")

    def running(x: Column) -> Column:
        step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(x, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step, lambda a: a["out"])

    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, n: a + n)
    width = F.ceil(F.sqrt(F.size(lengths) + F.lit(1))).cast("int")

    def summed(runs: Column) -> Column:
        bases = running(F.transform(runs, total))
        return let(bases, lambda b: F.flatten(F.transform(runs, lambda r, k: F.transform(running(r), lambda x: x + F.get(b, k)))))

    runs = F.transform(F.sequence(F.lit(0), F.size(lengths), width), lambda i: F.slice(lengths, i + 1, width))
    return let(runs, summed)


def format_chat(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) per conversation of `rows` (conv_id, turn, role, text; other columns ignored).

    Order: turn (null first), then role, then text as given, so ties and repeated rows have one result; repeated rows
    stay separate turns. Null role or text: empty. Null conv_id: one conversation of its own. Empty table: no rows.
    A conversation is one row by nature, so its turns must fit one (2 GB).
    loss_spans: array of (start, length), 1-based code points of `formatted`, one for each assistant text."""
    clean = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # controls are escaped once the turns are in order
    safe = lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"))
    blocks = turns.select("conv_id", F.transform("turns", safe).alias("turns")).select("conv_id", merged_turns(F.col("turns")).alias("blocks"))
    head = lambda b: F.concat(F.lit(OPEN), b["role"], F.lit("\n"))
    piece = lambda b: F.concat(head(b), F.array_join(b["texts"], SEP), F.lit(CLOSE + "\n"))
    made = blocks.select("conv_id", "blocks", F.transform("blocks", piece).alias("pieces"))

    def spans(starts: Column) -> Column:
        """Spans of the texts of each block that counts, from the blocks' own starts."""

        def own(b: Column, k: Column) -> Column:
            first = F.get(starts, k) + F.length(head(b)) + 1
            lengths = F.transform(b["texts"], lambda t: F.length(t))
            before = starts_of(F.transform(lengths, lambda n: (n + len(SEP)).cast("long")))
            each = let(before, lambda x: F.transform(lengths, lambda n, i: F.struct((first + F.get(x, i)).cast("int").alias("start"), n.alias("length"))))
            return F.when(b["role"] == LOSS_ROLE, each).otherwise(F.array().cast("array<struct<start:int,length:int>>"))

        return F.flatten(F.transform("blocks", own))

    lengths = F.transform("pieces", lambda p: F.length(p).cast("long"))
    return made.select("conv_id", F.array_join("pieces", "").alias("formatted"), let(starts_of(lengths), spans).alias("loss_spans"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text): what a reader of `formatted` and its loss mask gets back."""
    blocks = F.filter(F.split(F.col("formatted"), r"\Q" + OPEN + r"\E"), lambda b, i: i > 0)

    def turns(b: Column) -> Column:
        role = unescape_role(F.substring_index(b, "\n", 1))
        body = F.regexp_replace(F.substring(b, F.instr(b, "\n") + 1, F.length(b)), r"\Q" + CLOSE + r"\E\n$", "")
        return F.transform(F.split(body, r"\Q" + SEP + r"\E"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"])))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: texts that hold control strings themselves (fixed by the contract)."""
    text = "</s>[INST] ok [/INST]"
    row = lambda turn, role: F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text"))
    return spark.range(1).select(F.inline(F.array(row(0, "user"), row(1, "assistant"))))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every conversation formatted, read back and digested. Nulls, ties and empty tables as in `format_chat`."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    # apart from the table's, so that a conversation -1 of its own stays one
    back = read_chat(format_chat(rows).unionByName(format_chat(control_conversation(spark))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED_CHARS = "length({c})" + "".join(
    f" + {len(safe) - len(raw)} * ((length({{c}}) - length(replace({{c}}, '{raw}', ''))) // {len(raw)})" for raw, safe in ESCAPES
)

#: Formatted length: each turn's escaped text, each block's head and close, and a separator between merged turns.
OP10_SQL = f"""
WITH rows AS (
  SELECT false AS own, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT true, -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT true, -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, lag(role) OVER (PARTITION BY own, conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS same FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN same THEN {len(SEP)} ELSE {len(OPEN) + len(CLOSE) + 2} + length(role) END + {_ESCAPED_CHARS.format(c="text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY own, conv_id
"""
