"""Chat formatting from typed content parts, in DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Placeholder of each kind of attachment; every other kind is text.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Every control string of this and other templates holds "<" or "[", so escaped text holds none of them.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
PART_TYPE = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A message of one text part."""
    fields = [F.lit("text"), text, F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit(None)]
    return F.array(F.struct(*fields).cast(PART_TYPE))


def _tokens(part: Column, patch: int, per_second: float, per_page: int) -> Column:
    image = F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch)
    count = F.when(part["kind"] == "image", image).when(part["kind"] == "audio", F.ceil(part["seconds"] * per_second)).when(part["kind"] == "document", F.lit(per_page) * part["pages"])
    return F.greatest(F.coalesce(count.cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))


def format_chat(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
    learn_from: tuple[str, ...] = ("assistant",), patch: int = 28, per_second: float = 25.0, per_page: int = 256,
) -> DataFrame:
    """One row per conversation: its formatted text, loss mask and attachments.

    ``parts`` is an array of ``PART_TYPE``. A visitor walks the parts of a turn in order: text is
    escaped, an attachment becomes its placeholder and is recorded with its reference and the number
    of tokens its placeholder stands for (image patches, audio seconds, pages; 1 if unknown).
    Columns: the conversation key, ``formatted``, ``n_turns``, ``loss_mask`` (spans of text parts of
    the ``learn_from`` roles: turn index, offset in the turn in code points, length),
    ``attachments`` (turn index, place among the attachments of the turn, kind, ref, n_tokens) and
    ``expanded_tokens``.

    Cases: null or empty parts are an empty turn, a null text is empty, a null or unknown kind is
    text, a null role is ''. Turns are ordered by turn (null first), then role and content; repeated
    rows are repeated turns. A null conversation key is one conversation. Other columns are ignored.
    """
    def visit(acc: Column, part: Column) -> Column:
        mark = F.coalesce(*[F.when(part["kind"] == kind, F.lit(mark)) for kind, mark in PLACEHOLDERS.items()])
        shown = F.coalesce(mark, escape(F.coalesce(part["text"], F.lit(""))))
        size = F.char_length(shown)
        none_span, none_att = F.array().cast("array<struct<start:int,n_chars:int>>"), F.array().cast("array<struct<kind:string,ref:string,n_tokens:bigint>>")
        span = F.array(F.struct(acc["at"].alias("start"), size.alias("n_chars")))
        att = F.array(F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), _tokens(part, patch, per_second, per_page).alias("n_tokens")))
        return F.struct(
            (acc["at"] + size).alias("at"), F.concat(acc["body"], shown).alias("body"),
            F.concat(acc["spans"], F.when(mark.isNull(), span).otherwise(none_span)).alias("spans"),
            F.concat(acc["atts"], F.when(mark.isNotNull(), att).otherwise(none_att)).alias("atts"),
        )

    who = escape_role(F.coalesce(F.col(f"`{role}`"), F.lit("")))
    start = F.struct((F.char_length(who) + 2).alias("at"), F.lit("").alias("body"), F.array().cast("array<struct<start:int,n_chars:int>>").alias("spans"), F.array().cast("array<struct<kind:string,ref:string,n_tokens:bigint>>").alias("atts"))
    content = F.coalesce(F.col(f"`{parts}`"), F.array().cast(f"array<{PART_TYPE}>"))
    rows = turns.select(F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").alias("t"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), who.alias("who"), F.aggregate(content, start, visit).alias("v"))
    no_loss = F.array().cast("array<struct<start:int,n_chars:int>>")
    rows = rows.select("c", F.struct("t", "role", F.concat(F.lit(OPEN), "who", F.lit("\n"), "v.body", F.lit(CLOSE)).alias("piece"), F.when(F.col("role").isin(*learn_from), F.col("v.spans")).otherwise(no_loss).alias("spans"), F.col("v.atts").alias("atts")).alias("turn"))
    whole = rows.groupBy("c").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    mask = F.flatten(F.transform("turns", lambda x, i: F.transform(x["spans"], lambda s: F.struct(i.alias("turn_index"), s["start"].alias("start"), s["n_chars"].alias("n_chars")))))
    atts = F.flatten(F.transform("turns", lambda x, i: F.transform(x["atts"], lambda a, j: F.struct(i.alias("turn_index"), j.alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")))))
    out = whole.select(F.col("c").alias(conv), F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), F.size("turns").cast("long").alias("n_turns"), mask.alias("loss_mask"), atts.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["n_tokens"]))


def read_chat(chats: DataFrame) -> DataFrame:
    """Adds what the formatted text says: ``turns`` (role, text) and ``loss_texts``, unescaped."""
    pieces, own = unused(chats, "_pieces"), F.char_length(F.lit(CLOSE))
    cut = chats.withColumn(pieces, F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, F.greatest(F.char_length("formatted"), F.lit(1))))

    def parse(piece: Column) -> Column:
        who = F.substring_index(piece, "\n", 1)
        body = piece.substr(F.char_length(who) + 2, F.char_length(piece) - F.char_length(who) - 1 - own)
        return F.struct(unescape_role(who).alias("role"), unescape(body).alias("text"))

    loss = F.transform("loss_mask", lambda m: unescape(F.get(F.col(pieces), m["turn_index"]).substr(m["start"], m["n_chars"])))
    return cut.withColumns({"turns": F.transform(pieces, parse), "loss_texts": loss}).drop(pieces)


PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = read_chat(format_chat(rows.withColumn("parts", text_part(F.col("text")))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS coded,
  replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') AS who FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, coded)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, coded) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(who) + length(coded))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
