"""Chat formatting of typed content parts.

A turn is a list of parts: text, image, audio or document. A visitor goes through them in order: text is escaped,
another part becomes a placeholder for each of its expanded tokens and an attachment record. The template puts
marks around turns; the escape makes them impossible inside texts and can be undone. Each conversation becomes a
list of segments, one per turn, with the place of the trained text inside it. Everything is DataFrame
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex_sha256

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
TRAINED = "assistant"
OPEN, SAYS, CLOSE = "<|turn|>", "<|says|>", "<|end|>\n"
# Expanded tokens: an image by patches of 28 pixels, audio by 25 a second, a document by 256 a page; one at least.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 256
ATTACHED = ("image", "audio", "document")


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put inside ``<|``, so that no mark is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undoes ``escape``: each backslash goes and keeps the character behind it."""
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as the parts of a turn; a null text is empty."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"),
            F.lit(None).cast("int").alias("pages"),
        )
    )


def expanded_tokens(part: Column) -> Column:
    """Placeholders of a part: none for text, one at least for an attachment, also of unknown size."""
    image = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    size = (
        F.when(part["type"] == "image", image)
        .when(part["type"] == "audio", F.ceil(part["seconds"] * PER_SECOND))
        .when(part["type"] == "document", part["pages"] * PER_PAGE)
    )
    attached = part["type"].isin(*ATTACHED)
    return F.when(attached, F.greatest(F.coalesce(size, F.lit(1)), F.lit(1))).otherwise(0).cast("long")


def visit(part: Column, place: Column) -> Column:
    """What stands in the output for a part: escaped text, or placeholders. A part of another type is its text.

    A later part that begins with a bar gets a backslash in front, so that no mark arises where two parts meet.
    """
    marks = F.lit("")
    for kind in ATTACHED:
        marks = F.when(part["type"] == kind, F.repeat(F.lit(f"<|{kind}|>"), expanded_tokens(part).cast("int"))).otherwise(marks)
    text = escape(F.coalesce(part["text"], F.lit("")))
    text = F.when((place > 0) & text.startswith("|"), F.concat(F.lit("\\"), text)).otherwise(text)
    return F.when(part["type"].isin(*ATTACHED), marks).otherwise(text)


def formatted_turns(turns: DataFrame, parts: str = "parts") -> DataFrame:
    """(conv_id, turn, role, content, attachments, segment, mask_start, mask_length), a row per turn.

    ``segment`` is the turn as it stands in the output; the mask, in characters of the segment from 0, covers
    the content of trained turns and is empty for others. Null parts are no content.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(OPEN), escape(role), F.lit(SAYS))
    visited = F.array_join(F.transform(parts, visit), "")
    attachments = F.transform(
        F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("part"), i.alias("place"))), lambda x: x["part"]["type"].isin(*ATTACHED)),
        lambda x: F.struct(
            x["place"].alias("place"), x["part"]["type"].alias("type"), x["part"]["ref"].alias("ref"),
            expanded_tokens(x["part"]).alias("tokens"),
        ),
    )
    attachments = F.coalesce(attachments, F.array().cast("array<struct<place:int,type:string,ref:string,tokens:bigint>>"))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), head.alias("head"), F.coalesce(visited, F.lit("")).alias("content"), attachments.alias("attachments")
    )
    trained = F.col("role") == TRAINED
    return rows.select(
        "conv_id",
        "turn",
        "role",
        "content",
        "attachments",
        F.concat("head", "content", F.lit(CLOSE)).alias("segment"),
        F.when(trained, F.length("head")).otherwise(0).alias("mask_start"),
        F.when(trained, F.length("content")).otherwise(0).alias("mask_length"),
    )


def formatted(turns: DataFrame, parts: str = "parts") -> DataFrame:
    """A row per conversation: conv_id, ``segments`` (segment, mask_start, mask_length) by turn, ``text``, the
    attachment references with their expanded tokens, and the sum of these.

    The output of a conversation is one row, so a conversation has to fit into one. Turns of equal number
    stand by role and content, null numbers first; null conv_ids are one conversation; repeated rows are turns
    of their own; null roles are empty. No rows give no rows; other columns are ignored.
    """
    one = F.struct(
        "turn", "role", "content", "segment", "mask_start", "mask_length", "attachments"
    )
    rows = formatted_turns(turns, parts).groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    attached = F.flatten(F.transform("turns", lambda t: t["attachments"]))
    return rows.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t["segment"].alias("segment"), t["mask_start"].alias("mask_start"), t["mask_length"].alias("mask_length"))).alias("segments"),
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("text"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"),
    )


def read_back(output: DataFrame) -> DataFrame:
    """(conv_id, turns, trained): the role and text of every turn out of the formatted text, and the text under
    the mask, both unescaped."""
    blocks = F.filter(F.split("text", F.lit("<\\|turn\\|>"), -1), lambda b: b != "")
    turns = F.transform(
        blocks,
        lambda b: F.struct(
            unescape(F.substring_index(b, SAYS, 1)).alias("role"),
            unescape(F.regexp_extract(b, "(?s)^.*?<\\|says\\|>(.*)<\\|end\\|>\n$", 1)).alias("text"),
        ),
    )
    under = F.transform("segments", lambda s: unescape(F.substring(s["segment"], s["mask_start"] + 1, s["mask_length"])))
    return output.select("conv_id", "text", turns.alias("turns"), F.array_join(under, "").alias("trained"))


def conversation_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    back = read_back(formatted(conversations.withColumn("parts", text_parts(F.col("text")))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        hex_sha256(lines).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        hex_sha256(F.col("trained")).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )
