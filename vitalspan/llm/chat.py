"""Chat formatting with typed content parts, in DataFrame expressions only.

A message is a list of parts. A visitor over the parts turns text into escaped text and images, audio and documents into
placeholders in their order, and records what is attached and how many tokens it expands to. Turns are marked by control
strings; no text can contain one, as escaping breaks up every ``<|`` and can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
IMAGE_PATCH = 28
AUDIO_TOKENS_A_SECOND = 25
PAGE_TOKENS = 1024


def escape(text: Column) -> Column:
    r"""Doubles backslashes, then puts one into each ``<|``: only there an odd run of them stands behind ``<``."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As ``escape``; line feeds, which end a role, become ``<\\>``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\>"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A message that is one text."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def _tokens(part: Column) -> Column:
    """Tokens that an attachment expands to; unknown sizes count as the smallest."""
    patches = lambda size: F.ceil(F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)) / IMAGE_PATCH)
    seconds = F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0))
    return (
        F.when(part["kind"] == "image", patches(part["width"]) * patches(part["height"]))
        .when(part["kind"] == "audio", F.greatest(F.ceil(seconds * AUDIO_TOKENS_A_SECOND), F.lit(1)))
        .otherwise(F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)).cast("long") * PAGE_TOKENS)).cast("long")


def _attached(part: Column) -> Column:
    return F.coalesce(part["kind"].isin("image", "audio", "document"), F.lit(False))


def _place(part: Column) -> Column:
    """What a part leaves in the text; any kind that is no attachment is a text."""
    return F.when(_attached(part), F.concat(F.lit("<|"), part["kind"], F.lit("|>"))).otherwise(
        escape(F.coalesce(part["text"], F.lit(""))))


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """The text with placeholders, and the attachments in order: (part, kind, ref, tokens)."""
    parts = F.coalesce(parts, F.array().cast(PARTS))
    flat = F.array_join(F.transform(parts, _place), "")
    numbered = F.transform(parts, lambda p, i: F.struct(
        i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"), _attached(p).alias("is_attached")))
    kept = F.filter(numbered, lambda p: p["is_attached"])
    return flat, F.transform(kept, lambda p: p.dropFields("is_attached"))


def format_chats(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                 trained: str = "assistant") -> DataFrame:
    """One row a conversation: its id, ``formatted``, ``loss_spans``, ``attachments`` and ``expanded_tokens``.

    ``parts`` is a column of ``PARTS``, or of text, which is one part. ``loss_spans`` are (start, end) in code points, end
    exclusive, of the contents of ``trained`` turns. Turns go by number, then role, then content; null numbers come last;
    null roles and texts are empty; null ids are one conversation; an empty table gives none; other columns are not used.
    A conversation becomes one string, so its turns must fit into a task: it is one training example.
    """
    is_text = turns.schema[parts].dataType.simpleString() == "string"
    message = text_part(F.col(parts)) if is_text else F.col(parts).cast(PARTS)
    flat, attached = flatten_parts(message)
    name = F.coalesce(F.col(role), F.lit(""))
    lines = turns.select(
        F.col(conversation).alias("conversation"),
        F.struct(
            F.col(turn).isNull().alias("last"), F.col(turn).alias("turn"), name.alias("role"), flat.alias("content"),
            attached.alias("attached")).alias("line"))
    grouped = lines.groupBy("conversation").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    head = lambda line: F.concat(F.lit(START), escape_role(line["role"]), F.lit("\n"))
    shaped = grouped.withColumn("pieces", F.transform("lines", lambda x: F.struct(
        head(x).alias("head"), x["content"].alias("content"), (x["role"] == trained).alias("loss"))))
    sized = shaped.withColumn("sizes", F.transform("pieces", lambda p: F.struct(
        F.length(p["head"]).cast("long").alias("head"), F.length(p["content"]).cast("long").alias("content"), p["loss"].alias("loss"))))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    spans = F.aggregate("sizes", empty, lambda state, s: F.struct(
        (state["at"] + s["head"] + s["content"] + len(END)).alias("at"),
        F.when(s["loss"], F.concat(state["spans"], F.array(F.struct(
            (state["at"] + s["head"]).alias("start"), (state["at"] + s["head"] + s["content"]).alias("end")))))
        .otherwise(state["spans"]).alias("spans")))
    files = F.flatten(F.transform("lines", lambda x, i: F.transform(
        x["attached"], lambda a: F.struct(i.alias("turn_index"), a["part"].alias("part"), a["kind"].alias("kind"),
                                          a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return sized.select(
        F.col("conversation").alias(conversation),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["content"], F.lit(END))), "").alias("formatted"),
        spans["spans"].alias("loss_spans"), files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped; placeholders stay as they are."""
    pieces = F.split(formatted, r"\Q<|im_end|>" + "\n" + r"\E")
    whole = F.slice(pieces, 1, F.size(pieces) - 1)
    bare = F.transform(whole, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    return F.transform(bare, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between its spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
