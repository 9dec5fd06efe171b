"""Chat formatting over typed content parts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings that a text may not hold unescaped: any <|name|>, and the turn marks of common templates.
CONTROL = r"([<\[])(~*)(\|[a-z_]+\|>|/?s>|/?INST\])"
ESCAPED = r"([<\[])~(~*)(\|[a-z_]+\|>|/?s>|/?INST\])"
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Kinds of attachments with a placeholder of their own; every other kind is an attachment whose name stands, escaped, before a CLOSE. A PART mark parts two texts that follow each other.
KINDS, OTHER, CLOSE, SPLIT = ("image", "audio", "document"), "<|attachment|>", "<|close|>", "<|part|>"
#: Tokens that an attachment takes once expanded: an image by tiles of 28 x 28 pixels, audio by seconds, a document by pages.
IMAGE_TILE, AUDIO_TOKENS_S, PAGE_TOKENS = 28, 25, 512
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """Put one more ~ behind the first character of every control string, whatever number it has; unescape() takes it out."""
    return F.regexp_replace(text, CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def text_part(text: Column) -> Column:
    """A turn of plain text as an array of one part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def part_tokens(p: Column) -> Column:
    """Tokens that a part's placeholder expands to; 0 for text and unknown sizes."""
    tiles = lambda side: F.ceil(F.coalesce(side, F.lit(0)) / IMAGE_TILE)
    return F.when(p["type"] == "image", tiles(p["width"]) * tiles(p["height"])).when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_TOKENS_S)).when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS).otherwise(F.lit(0)).cast("long")


def visit(parts: Column) -> Column:
    """Flatten a turn's parts in order: text escaped, every other kind a placeholder. No part can write a control string of a turn: kinds come from a fixed list, and another kind's name is escaped as text is."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    known = lambda p: F.coalesce(p["type"].isin(*KINDS), F.lit(False))
    is_text = lambda p: F.coalesce(p["type"] == "text", F.lit(False))

    def part(p: Column, i: Column) -> Column:
        joint = F.when((i > 0) & is_text(F.get(parts, i - 1)), SPLIT).otherwise("")
        text = F.concat(joint, escape(F.coalesce(p["text"], F.lit(""))))
        other = F.concat(F.lit(OTHER), escape(F.coalesce(p["type"], F.lit(""))), F.lit(CLOSE))
        return F.when(is_text(p), text).when(known(p), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(other)

    return F.array_join(F.transform(parts, part), "")


def read_parts(body: Column) -> Column:
    """type and text of the parts in a turn's body: texts unescaped, attachments without text, in order. An empty text beside an attachment leaves no trace."""
    names = "|".join(KINDS)
    pieces = F.split(body, rf"(?=<\|(?:{names}|attachment|part)\|>)|(?<=<\|(?:{names}|close|part)\|>)", -1)
    pieces = F.filter(pieces, lambda x: (x != "") & (x != SPLIT))
    row = lambda kind, text: F.struct(kind.alias("type"), text.alias("text"))
    none = F.lit(None).cast("string")

    def part(x: Column) -> Column:
        kind = F.regexp_extract(x, rf"^<\|({names})\|>$", 1)
        other = F.substring(x, F.lit(len(OTHER) + 1), F.length(x) - len(OTHER + CLOSE))
        return F.when(kind != "", row(kind, none)).when(F.startswith(x, F.lit(OTHER)), row(unescape(other), none)).otherwise(row(F.lit("text"), unescape(x)))

    return F.transform(pieces, part)


def format_chat(turns: DataFrame) -> DataFrame:
    """Format turns (conv_id, turn, role, parts: array of PART) into one row per conversation.

    formatted is, for every turn, TURN role BODY text END. loss_spans holds start (from 1) and length in
    code points of each assistant text in it. attachments lists, in order, turn_no (from 0 within the conversation), type, ref,
    n_tokens of every part that isn't text; n_tokens is their sum.
    Turns are ordered by turn, then role, then content, nulls first; repeated rows stay, each a turn.
    Null role, parts or text count as empty; a null conv_id is a conversation of its own. An empty table gives an empty table; further columns are dropped.
    A conversation is one row of the result and so has to fit into one task; nothing else is gathered.
    """
    seen = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), visit(F.col("parts")).alias("body"), F.transform(F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: ~(p["type"] == "text") | p["type"].isNull()), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("n_tokens"))).alias("att"))
    conv = turns.select("conv_id", seen.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    piece = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY), t["body"], F.lit(END))
    conv = conv.withColumn("pieces", F.transform("ts", piece))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("spans"))
    lens = F.transform("ts", lambda t: F.struct((F.length(F.lit(TURN + BODY)) + F.length(escape(t["role"]))).alias("head"), F.length(t["body"]).alias("body"), (t["role"] == "assistant").alias("loss")))

    def step(acc: Column, t: Column) -> Column:
        span = F.struct((acc["at"] + t["head"] + 1).alias("start"), t["body"].alias("len"))
        return F.struct((acc["at"] + t["head"] + t["body"] + len(END)).alias("at"), F.when(t["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    attached = F.flatten(F.transform("ts", lambda t, i: F.transform(t["att"], lambda a: F.struct(i.alias("turn_no"), a["type"].alias("type"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")))))
    return conv.select("conv_id", F.array_join("pieces", "").alias("formatted"), F.aggregate(lens, start, step, lambda a: a["spans"]).alias("loss_spans"), attached.alias("attachments")).withColumn("n_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add turns (array of role, text), parsed from formatted, parts (of each turn, an array of type, text) and loss_text, all text of parts under the loss mask, unescaped. parts tells a placeholder from a text that reads like one; text is the body as it reads, placeholders included."""
    pieces = F.split("formatted", r"<\|turn\|>", -1)
    turn = F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), lambda s: F.split(s, r"<\|body\|>|<\|end\|>", -1))
    turns = F.transform(turn, lambda s: F.struct(unescape(s[0]).alias("role"), unescape(s[1]).alias("text")))
    said = lambda s: F.array_join(F.transform(read_parts(F.substring(F.col("formatted"), s["start"], s["len"])), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    loss = F.array_join(F.transform("loss_spans", said), "")
    return formatted.withColumns({"turns": turns, "parts": F.transform(turn, lambda s: read_parts(s[1])), "loss_text": loss})
