"""Chat formatting with typed content parts, with DataFrame functions only.

A message is a list of parts: text, image, audio, document. `flatten` visits the parts of a message in order and writes text as it
is (escaped) and everything else as a numbered placeholder, recording for each attachment its kind, reference and the number
of tokens that the placeholder stands for. `formatted` puts the turns of a conversation into one string:

    <turn ROLE>\\n TEXT </turn>\\n

Escaping is reversible: inside roles and texts a backslash becomes `\\\\`, `<` becomes `\\(` and `>` becomes `\\)`, so no text can
hold a control string, and `parsed` splits at control strings without looking inside. Null roles and texts are empty.

Turns are ordered by number, then role, then text (nulls first); repeated rows stay as turns of their own. A null conversation id is a
conversation of its own. Empty tables give an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.registry import query, table

#: Tokens of a placeholder: a fixed number, or so many for each unit (second of audio, page of a document).
TOKENS = {"image": (576, 0), "audio": (2, 25), "document": (8, 512)}
PARTS = "array<struct<type:string,text:string,ref:string,units:double>>"
LEARNED = "assistant"  # the role whose texts the loss covers


def escaped(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\(")), F.lit(">"), F.lit("\\)"))


def unescaped(text: Column) -> Column:
    """Undo `escaped`: halves between double backslashes hold no escaped backslash."""
    halves = F.split(text, r"\\\\", -1)
    plain = F.transform(halves, lambda x: F.replace(F.replace(x, F.lit("\\("), F.lit("<")), F.lit("\\)"), F.lit(">")))
    return F.array_join(plain, "\\")


def text_part(text: Column) -> Column:
    """One text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))).cast(PARTS)


def placeholder_tokens(part: Column) -> Column:
    """Tokens that a part other than text expands to; an unknown type counts as a document."""
    units = F.ceil(F.coalesce(part["units"], F.lit(0.0))).cast("long")
    fixed = lambda kind: F.lit(TOKENS[kind][0]) + F.lit(TOKENS[kind][1]) * units
    kind = part["type"]
    return F.when(kind == "image", fixed("image")).when(kind == "audio", fixed("audio")).otherwise(fixed("document")).cast("long")


def text_tokens(text: Column) -> Column:
    """Words of a text, the unit in which token counts are estimated here."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def flatten(parts: Column) -> Column:
    """Struct of content (escaped text and placeholders), attachments (place, kind, ref, tokens) and n_tokens.

    Null parts count as an empty list, a null part as an empty text.
    """
    parts = F.coalesce(parts, F.array().cast(PARTS))
    is_text = lambda p: F.coalesce(p["type"] == "text", p["type"].isNull())
    others = F.filter(parts, lambda p: ~is_text(p))
    attached = F.transform(others, lambda p, k: F.struct((k + 1).alias("place"), p["type"].alias("kind"), p["ref"].alias("ref"), placeholder_tokens(p).alias("tokens")))

    def visit(state: Column, p: Column) -> Column:
        mark = F.concat(F.lit("<"), escaped(p["type"]), F.lit(" "), (state["n"] + 1).cast("string"), F.lit(">"))
        out = F.when(is_text(p), escaped(p["text"])).otherwise(mark)
        return F.struct(F.concat(state["out"], out).alias("out"), F.when(is_text(p), state["n"]).otherwise(state["n"] + 1).alias("n"))

    content = F.aggregate(parts, F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), visit, lambda s: s["out"])
    tokens = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + F.when(is_text(p), text_tokens(p["text"])).otherwise(placeholder_tokens(p)))
    return F.struct(content.alias("content"), attached.alias("attachments"), tokens.alias("n_tokens"))


def formatted(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """Columns conv, formatted, attachments (turn's place in the conversation, and the attachment), n_tokens."""
    flat = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), flatten(F.col(parts)).alias("f"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "f.content", "f.attachments", "f.n_tokens"))).alias("turns")
    rows = flat.groupBy("conv").agg(turns)
    written = F.transform("turns", lambda t: F.concat(F.lit("<turn "), escaped(t["role"]), F.lit(">\n"), t["content"], F.lit("</turn>\n")))
    attached = F.flatten(F.transform("turns", lambda t, k: F.transform(t["attachments"], lambda a: F.struct(k.alias("turn"), a.alias("attachment")))))
    tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["n_tokens"])
    return rows.select("conv", F.array_join(written, "").alias("formatted"), attached.alias("attachments"), tokens.alias("n_tokens"))


def parsed(text: Column) -> Column:
    """The turns of a formatted string: array of struct(role, content), content still escaped."""
    pieces = F.filter(F.split(text, "</turn>\n", -1), lambda x: x != "")
    role = lambda x: F.substring_index(F.substr(x, F.lit(7)), ">\n", 1)
    return F.transform(pieces, lambda x: F.struct(unescaped(role(x)).alias("role"), F.substr(x, F.length(role(x)) + 9).alias("content")))


def loss_spans(text: Column, role: str = LEARNED) -> Column:
    """Where the loss mask is 1: struct(start, length) in code points of the formatted string, for each text of `role`."""
    pieces = F.filter(F.split(text, "</turn>\n", -1), lambda x: x != "")
    head = F.lit(f"<turn {role}>\n")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        span = F.struct((s["at"] + F.length(head)).alias("start"), (F.length(x) - F.length(head)).alias("length"))
        spans = F.when(F.startswith(x, head), F.array_append(s["spans"], span)).otherwise(s["spans"])
        return F.struct((s["at"] + F.length(x) + 8).alias("at"), spans.alias("spans"))

    return F.aggregate(pieces, state, step, lambda s: s["spans"])


SQL = r"""
WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')) AS e,
         length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) AS r FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(e + r + 16)::BIGINT AS formatted_chars,
       sum(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')))::BIGINT AS n_tokens
FROM f GROUP BY conv_id
"""


@query("op8_content_parts", SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations formatted, then everything read back from the formatted string."""
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id BIGINT, turn INT, role STRING, text STRING")
    rows = table(spark, folder, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", "text")
    done = formatted(rows.unionByName(extra).withColumn("parts", text_part(F.col("text"))))
    spans = F.transform(loss_spans(F.col("formatted")), lambda s: unescaped(F.substr("formatted", s["start"] + 1, s["length"])))
    back = done.select("conv", "formatted", "n_tokens", parsed(F.col("formatted")).alias("turns"), F.array_join(spans, "").alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), unescaped(t["content"]), F.lit("\n"))), "")
    return back.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_tokens",
    )
