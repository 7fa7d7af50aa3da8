"""Operator 2: chat formatting with typed content parts, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import staged, table

# Fixed values of the template: <s>[INST] role [/INST]text</s> for each turn, [PART type t.p] for each attachment.
OPEN, NAMED, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: What a text must not hold by itself: a control string begins with its first character and one of these after it.
CONTROL = r"(?=/?s>|/?INST\]|PART )"
#: The message role whose text is learned.
LEARNED = "assistant"
#: Tokens that an attachment stands for where its part doesn't say.
EXPANDED = {"image": 256, "audio": 750, "document": 1024}
PART_TYPE = "array<struct<type:string,text:string,ref:string,tokens:int>>"


def escape(text: Column) -> Column:
    """Double each backslash, then put one after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[]){CONTROL}", r"$1\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, rf"([<\[])\\{CONTROL}", "$1"), F.lit("\\\\"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A text as the only part of its turn."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))).cast(PART_TYPE)


def visit(parts: Column, turn: Column) -> Column:
    """Flatten the parts of turn number `turn`: struct of text, spans and attachments.

    Text parts that follow each other are one text, joined before it is escaped, so that no control string arises where
    they meet. Any other part becomes the placeholder [PART type t.p] of turn t and part p, counted from 1 in order,
    and an attachment with that name, its reference and the tokens that it expands to. spans: start and length of the
    texts between the placeholders, those that are empty left out beside others.
    """
    defaults = F.create_map(*[F.lit(x) for kv in EXPANDED.items() for x in kv])
    kind = lambda p: F.coalesce(p["type"], F.lit("text"))
    name = lambda p, i: F.concat(escape(kind(p)), F.lit(" "), turn.cast("string"), F.lit("."), (i + 1).cast("string"))
    held = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("at"), kind(p).alias("type"), name(p, i).alias("placeholder"), p["ref"].alias("ref"), F.coalesce(p["tokens"], defaults[kind(p)], F.lit(1)).alias("tokens"))), lambda a: a["type"] != "text")
    texts = F.transform(parts, lambda p: F.coalesce(p["text"], F.lit("")))
    start = lambda k: F.coalesce(F.get(held, k - 1)["at"] + 1, F.lit(0))
    stop = lambda k: F.coalesce(F.get(held, k)["at"], F.size(parts))
    marked = lambda k: F.coalesce(F.concat(F.lit("[PART "), F.get(held, k)["placeholder"], F.lit("]")), F.lit(""))
    runs = F.transform(F.sequence(F.lit(0), F.size(held)), lambda k: F.struct(escape(F.array_join(F.slice(texts, start(k) + 1, stop(k) - start(k)), "")).alias("text"), marked(k).alias("mark")))
    return F.struct(runs.alias("runs"), F.transform(held, lambda a: a.dropFields("at")).alias("attachments"))


def flattened(content: Column) -> Column:
    """visit()'s runs as struct of text, spans and attachments."""
    text = F.array_join(F.transform(content["runs"], lambda r: F.concat(r["text"], r["mark"])), "")
    none = F.array().cast("array<struct<start:int,length:int,end:int>>")
    placed = F.aggregate(
        content["runs"],
        none,
        lambda done, r: F.concat(done, F.array(F.struct(F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)).alias("start"), F.char_length(r["text"]).alias("length"), (F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)) + F.char_length(r["text"]) + F.char_length(r["mark"])).alias("end")))),
    )
    spans = F.transform(F.filter(placed, lambda x, i: (x["length"] > 0) | (F.size(placed) == 1)), lambda x: F.struct(x["start"], x["length"]))
    return F.struct(text.alias("text"), spans.alias("spans"), content["attachments"].alias("attachments"))


def format_chat(turns: DataFrame) -> DataFrame:
    """A row a conversation of turns (conv_id, turn, role, and parts, or else text).

    segments: the formatted turns in order, which joined are the formatted text; formatted_chars: their characters;
    loss: (segment, start, length), the stretches of each learned turn's texts in its segment, placeholders not among
    them; attachments: the parts that aren't text, in order; expanded_tokens: what these expand to. Turns are ordered by turn, role and content, so
    equal turn numbers and repeated rows have a defined place and all stay. Null turns come first. A null role or text
    is empty, null parts are none. A null conv_id is a conversation of its own. Other columns are ignored. A long
    conversation is one row of its text's length; nothing else grows with it.
    """
    parts = F.coalesce(F.col("parts").cast(PART_TYPE), F.array().cast(PART_TYPE)) if "parts" in turns.columns else text_parts(F.col("text"))
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), parts.alias("parts"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), F.col("role"), F.col("parts")))).alias("turns"))
    visited = held.select("conv_id", F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), visit(t["parts"], i + 1).alias("content"))).alias("turns"))
    seen = visited.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), flattened(t["content"]).alias("content"))).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(NAMED))
    segments = F.transform("turns", lambda t: F.concat(head(t), t["content"]["text"], F.lit(CLOSE)))
    spans = F.transform("turns", lambda t, i: F.transform(t["content"]["spans"], lambda x: F.struct(i.alias("segment"), (F.char_length(head(t)) + x["start"]).alias("start"), x["length"].alias("length"), t["role"].alias("role"))))
    learned = F.transform(F.filter(F.flatten(spans), lambda x: x["role"] == LEARNED), lambda x: x.dropFields("role"))
    out = seen.select("conv_id", segments.alias("segments"), learned.alias("loss"), F.flatten(F.transform("turns", lambda t: t["content"]["attachments"])).alias("attachments"))
    total = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + F.char_length(s))
    return out.select("conv_id", "segments", total.alias("formatted_chars"), "loss", "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"))


def read_turns(segments: Column) -> Column:
    """The turns of formatted segments: role and text, unescaped."""
    return F.transform(
        segments,
        lambda s: F.struct(
            unescape(F.substring_index(F.substr(s, F.lit(len(OPEN) + 1)), NAMED, 1)).alias("role"),
            unescape(F.substr(s, F.instr(s, NAMED) + len(NAMED), F.char_length(s) - F.instr(s, NAMED) - len(NAMED) + 1 - len(CLOSE))).alias("text"),
        ),
    )


def read_loss(segments: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(loss, lambda m: unescape(F.substr(F.get(segments, m["segment"]), m["start"] + 1, m["length"])))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted rows hold, read from them: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = formatted.select("conv_id", "segments", read_turns(F.col("segments")).alias("turns"), F.concat_ws("", read_loss(F.col("segments"), F.col("loss"))).alias("learned"))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    chars = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + F.char_length(s))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        chars.alias("formatted_chars"),
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return digests(staged(format_chat(turns.unionByName(extra)), "chat"))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(replace(role, '\', '\\'), '(</?s>|\[/?INST\]|\[PART )', '\1_', 'g') AS r,
    regexp_replace(replace(text, '\', '\\'), '(</?s>|\[/?INST\]|\[PART )', '\1_', 'g') AS t FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(t) + 22) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
