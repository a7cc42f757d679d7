"""Chat formatting over typed content parts (DataFrame functions only).

A turn holds ordered parts, each of kind text, image, audio or document. The visitor maps a part to a piece of the turn's
body: text is escaped, any other part becomes ``<kind:i>``, i counting attachments over the whole conversation. Each attachment is recorded with its
turn, index, kind, reference and expanded token count (image: patches of 28 x 28 pixels; audio: 25 a second; document: 256 a page; 1 at least).

Template: ``<turn ROLE>BODY</turn>`` and a newline for each turn. In roles and texts ``\\`` is written ``\\b``, ``<`` is ``\\l`` and
``>`` is ``\\g``, so no text can hold a control string, and undoing \\l, \\g, then \\b restores it. loss_spans are the code point
ranges [lo, hi) of the assistant bodies in the formatted string.

A running sum over a conversation's turns gives every turn its offset and its first attachment index, so a long conversation costs no more per turn than a short one. A
formatted conversation is one value; the turns are grouped for that alone.

Edge cases: null text or part list: empty body; null role: empty role; turns tied on number go by role, then text; repeated rows stay separate
turns; null turn numbers come first; rows of a null conv_id form one conversation; an unknown kind is kept as a placeholder of 1 token; empty table, empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packframe.llm.common import table

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
CLOSE = "</turn>\n"


def escape(c: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in (("<", "\\l"), (">", "\\g"), ("\\", "\\b")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def text_part(text: Column) -> Column:
    """A list of one text part."""
    none = F.lit(None)
    fields = (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[none.cast(t).alias(n) for n, t in fields]))


def part_tokens(p: Column) -> Column:
    """The tokens that an attachment expands to."""
    patches = F.ceil(F.coalesce(p["width"], F.lit(1)) / 28) * F.ceil(F.coalesce(p["height"], F.lit(1)) / 28)
    n = F.when(p["kind"] == "image", patches).when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * 25)).when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(1)) * 256)
    return F.greatest(F.lit(1), F.coalesce(n, F.lit(1))).cast("long")


def _is_text(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) == "text"


def visit(parts: Column, first: Column) -> Column:
    """The body of a turn whose attachments are numbered from first on."""
    mark = lambda p, i: F.concat(F.lit("<"), escape(p["kind"]), F.lit(":"), (first + F.size(F.filter(F.slice(parts, 1, i), lambda q: ~_is_text(q)))).cast("string"), F.lit(">"))
    return F.array_join(F.transform(parts, lambda p, i: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(mark(p, i))), "")


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns (conv_id, turn, role, parts) -> conv_id, n_turns, formatted, loss_spans, attachments, attachment_tokens."""
    x = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"))
    x = x.withColumn("n_files", F.size(F.filter("parts", lambda p: ~_is_text(p))))
    x = x.withColumn("tie", F.transform("parts", lambda p: F.coalesce(p["text"], p["ref"], F.lit(""))))
    at = Window.partitionBy("conv_id").orderBy("turn", "role", "tie")
    x = x.withColumn("pos", F.row_number().over(at)).withColumn("first", F.coalesce(F.sum("n_files").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("head", F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">"))).withColumn("body", visit(F.col("parts"), F.col("first")))
    whole = F.char_length("head") + F.char_length("body") + len(CLOSE)
    x = x.withColumn("from", F.coalesce(F.sum(whole).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.char_length("head"))
    x = x.withColumn("span", F.when(F.col("role").isin(*loss_roles), F.struct(F.col("from").alias("lo"), (F.col("from") + F.char_length("body")).alias("hi"))))
    files = F.transform(
        F.filter("parts", lambda p: ~_is_text(p)),
        lambda p, i: F.struct(F.col("pos").alias("turn"), (F.col("first") + i).alias("index"), p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")),
    )
    out = x.withColumn("files", files).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "span", "files"))).alias("t"))
    out = out.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda v: v["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda v: v["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("t", lambda v: v["files"])).alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, f: a + f["tokens"]))


def read_turns(formatted: Column) -> Column:
    """(role, text) of each turn, read back from the formatted string; placeholders stay as they are."""
    pieces = F.split(formatted, "</turn>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len("<turn ") + 1)), ">", 1)).alias("role"), unescape(F.substr(p, F.locate(">", p) + 1)).alias("text")))


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int")))), "")


PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op9_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    x = format_conversations(real.unionByName(probe).withColumn("parts", text_part(F.col("text"))))
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = masked(F.col("formatted"), F.col("loss_spans"))
    return x.select(
        "conv_id",
        "n_turns",
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + length(text) + 15
        + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
