"""Chat formatting with typed content parts; DataFrame functions only.

A turn holds parts: text, image, audio, document. A visitor (one conditional per part type)
flattens the parts of a turn in order: text is escaped, every other part becomes its
placeholder, and its reference and expanded token count are recorded in order of appearance.
A turn is written as ``<s>role\\ntext</s>``. Inside roles and texts a backslash is doubled and
a control string gets a backslash after its first character, so that no control string can
come from a text, and dropping each backslash that precedes a character gives the text back.

Turns are joined in chunks of ``CHUNK_TURNS`` before they meet in their conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template, the placeholders of the part types, and
# the tokens that an attachment takes where its part names no number.
OPEN, CLOSE = "<s>", "</s>"
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
DEFAULT_TOKENS = {"image": 576, "audio": 1500, "document": 1024}
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<image>", "<audio>", "<document>"]

CHUNK_TURNS = 64
PARTS = "array<struct<type: string, text: string, ref: string, tokens: int>>"


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "\\[]()/.*+?^$|{}" else c for c in s)


def escaped(text: Column) -> Column:
    """Null is empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    rest = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in CONTROLS)
    return F.regexp_replace(t, rest, r"\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _visited(part: Column) -> Column:
    """The text that stands for a part."""
    out = F.when(part["type"] == "text", escaped(part["text"]))
    for kind, mark in PLACEHOLDERS.items():
        out = out.when(part["type"] == kind, F.lit(mark))
    return out.otherwise(escaped(part["text"]))  # an unknown type counts as text


def _tokens(part: Column) -> Column:
    out = F.lit(0)
    for kind, n in DEFAULT_TOKENS.items():
        out = F.when(part["type"] == kind, F.coalesce(part["tokens"], F.lit(n))).otherwise(out)
    return out


def text_parts(text: Column) -> Column:
    """One text part, for tables whose turns are plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str | None = "text", parts_col: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, segments, attachments, attachment_tokens, n_turns.

    ``segments`` are (text, loss) in order; their texts together are the formatted conversation,
    and ``loss`` marks those that training learns from: what assistants said, without
    the marks around it. ``attachments`` are (turn, type, ref, tokens) in order. Turns are
    ordered by number; turns with one number by role, then content, so that repeated rows stay and
    no order of the input shows. Null roles and texts are empty; a null number comes
    first; null conversations form one. A turn without parts is empty. An empty input gives no rows.
    Other columns are ignored, whatever their names.
    """
    parts = F.col(parts_col).cast(PARTS) if parts_col else text_parts(F.col(text_col))
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.filter(parts, lambda p: p.isNotNull()), F.array().cast(PARTS)).alias("parts"))
    body = F.array_join(F.transform("parts", _visited), "")
    files = F.transform(
        F.filter("parts", lambda p: p["type"].isin(*PLACEHOLDERS)),
        lambda p: F.struct(F.col("turn").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")),
    )
    role = F.regexp_replace(escaped(F.col("role")), "\n", r"\\" + "\n")
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    t = t.select("conv_id", "turn", "role", body.alias("body"), head.alias("head"), files.alias("files"))
    loss = F.col("role") == "assistant"
    spans = F.when(loss, F.array(*[F.struct(c.alias("text"), F.lit(on).alias("loss")) for c, on in ((F.col("head"), False), (F.col("body"), True), (F.lit(CLOSE), False))])).otherwise(
        F.array(F.struct(F.concat("head", "body", F.lit(CLOSE)).alias("text"), F.lit(False).alias("loss")))
    )
    row = F.struct("turn", "role", "body", "files", spans.alias("spans"))
    chunks = t.withColumn("chunk", F.floor(F.coalesce("turn", F.lit(-(2**40))) / CHUNK_TURNS)).groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    chunks = chunks.select(
        "conv_id",
        F.struct(
            "chunk",
            F.size("rows").cast("long").alias("n"),
            F.flatten(F.transform("rows", lambda r: r["spans"])).alias("spans"),
            F.flatten(F.transform("rows", lambda r: r["files"])).alias("files"),
        ).alias("part"),
    )
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("all"))
    return whole.select(
        "conv_id",
        F.flatten(F.transform("all", lambda c: c["spans"])).alias("segments"),
        F.flatten(F.transform("all", lambda c: c["files"])).alias("attachments"),
        F.aggregate(F.flatten(F.transform("all", lambda c: c["files"])), F.lit(0).cast("long"), lambda a, f: a + f["tokens"]).alias("attachment_tokens"),
        F.aggregate("all", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("n_turns"),
    )


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; placeholders stay in the texts."""
    inside = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    own = F.transform(inside, lambda x: F.substr(x, F.lit(len(OPEN) + 1)))
    return F.transform(
        own,
        lambda x: F.struct(
            unescaped(F.regexp_extract(x, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)).alias("role"),
            unescaped(F.regexp_replace(x, r"(?s)^(?:[^\\\n]|\\.)*+\n", "")).alias("text"),
        ),
    )


def _sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from the output: digests of all turns and of the masked text."""
    c = chats.select("conv_id", formatted_text(F.col("segments")).alias("f"), loss_text(F.col("segments")).alias("loss"))
    c = c.select("conv_id", "f", "loss", parsed(F.col("f")).alias("turns"))
    return c.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _sha(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        _sha(F.col("loss")).alias("loss_sha256"),
        F.length("f").cast("long").alias("formatted_chars"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all conversations and one whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(format_chats(turns.unionByName(own)))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(role, '\\', '\\\\', 'g'), '<(/?s>|image>|audio>|document>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS erole,
         regexp_replace(regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'), '<(/?s>|image>|audio>|document>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS etext FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, etext)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, etext) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(8 + length(replace(erole, chr(10), '\' || chr(10))) + length(etext))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
