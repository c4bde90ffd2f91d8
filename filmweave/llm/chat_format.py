"""Chat formatting with typed content parts, in column expressions alone.

A visitor goes over each turn's parts in order. Text is escaped and stays; an
image, audio clip or document becomes a placeholder, and a record of it: its number
in the conversation, turn, part, kind, reference, and how many tokens the placeholder
expands to (image: patches; audio: by seconds; document: by pages). Turns are
marked, put together per conversation, and every assistant turn's content is
under the loss mask.

Grammar, with all marks in MARKS::

    conversation  <s> turn*
    turn          [INST] role \\n content [/INST]      any role but "assistant"
                  content </s>                         "assistant"
    content       parts one after another; ``<|text|>`` between two text parts

Escaping: wherever a text has a mark's spelling, with any number of backslashes
after its first character, one more is put there; reading takes one away. No raw
mark is left in a text, and no mark has its first character inside it, so none
can arise where two pieces meet. In roles a line end is written ``<|nl|>``.

The loss mask is a list of spans, each by its turn and by code points within the
conversation and within its turn's piece. A piece ends at its turn's closing mark, so
reading cuts the text once and each span out of its piece: linear in the text.

A conversation is one string in one row, as its format demands; what precedes is
per turn, and turns are placed by a sorted window. Defined results: a null text,
like a null part, is empty; a null role is ''; a null turn comes first; rows of one
turn go by role, then content, and repeated rows are turns of their own; rows with
a null id are one conversation; no rows, no conversation. Parts of an unknown
kind are placeholders of kind "other" with no tokens, and missing sizes make one
token. Very long texts count whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from filmweave.llm.common import stage
from filmweave.session import prepare

#: Kinds of parts that become placeholders.
KINDS = ("image", "audio", "document", "other")
BOS, EOS, OPEN, CLOSE, NEXT_TEXT, LINE = "<s>", "</s>", "[INST]", "[/INST]", "<|text|>", "<|nl|>"
MARKS = (BOS, EOS, OPEN, CLOSE, NEXT_TEXT, LINE, *(f"<|{k}|>" for k in KINDS))
#: Sides of an image patch, audio tokens per second, tokens per page of a document.
PATCH, PER_SECOND, PER_PAGE = 16, 12.5, 1024

_SPELLED = "([<\\[])(\\\\{})(" + "|".join(re.escape(m[1:]) for m in MARKS) + ")"
#: Where a turn's piece ends.
_ENDS = f"(?<={re.escape(EOS)})|(?<={re.escape(CLOSE)})"

PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _SPELLED.format("*"), r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _SPELLED.format("+").replace("(\\\\+)", r"\\(\\*)"), "$1$2$3")


def _tokens(part: Column) -> Column:
    """Tokens that a part's placeholder expands to."""
    patches = lambda side: F.greatest(F.lit(1), F.ceil(F.coalesce(side, F.lit(0)) / PATCH))
    return (
        F.when(part["type"] == "image", patches(part["width"]) * patches(part["height"]))
        .when(part["type"] == "audio", F.greatest(F.lit(1), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND)))
        .when(part["type"] == "document", F.greatest(F.lit(1), F.coalesce(part["pages"], F.lit(0))) * PER_PAGE)
        .otherwise(0)
        .cast("long")
    )


def visit(parts: Column) -> Column:
    """Each part as (kind, shown, ref, tokens): text is escaped, the rest are placeholders."""

    def one(part: Column) -> Column:
        is_text = F.coalesce(part["type"], F.lit("text")) == "text"
        kind = F.when(is_text, "text").when(part["type"].isin(*KINDS), part["type"]).otherwise("other")
        shown = F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))
        return F.struct(kind.alias("kind"), shown.alias("shown"), F.when(~is_text, part["ref"]).alias("ref"), F.when(is_text, 0).otherwise(_tokens(part)).cast("long").alias("tokens"))

    return F.transform(F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")), one)


def text_parts(text: Column) -> Column:
    """A plain text as its only part."""
    names = [("type", F.lit("text")), ("text", text)] + [(n, F.lit(None)) for n in ("ref", "width", "height", "seconds", "pages")]
    return F.array(F.struct(*[c.alias(n) for n, c in names])).cast(f"array<{PART_TYPE}>")


def _content(seen: Column) -> Column:
    """Visited parts as one string, two texts parted by a mark."""
    before = lambda i: F.try_element_at(seen, i)  # noqa: E731  1-based, so ``i`` is the part before number i + 1
    apart = lambda p, i: F.when((i > 0) & (p["kind"] == "text") & (before(F.greatest(i, F.lit(1)))["kind"] == "text"), NEXT_TEXT).otherwise("")
    return F.array_join(F.transform(seen, lambda p, i: F.concat(apart(p, i), p["shown"])), "")


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str | None = "text", parts: str | None = None) -> DataFrame:
    """(conv, formatted, loss, attachments, attachment_tokens) per conversation.

    ``parts`` names a column of typed parts (PART_TYPE); without it ``text`` is the only part.
    ``loss``: (turn number from 0, start in the conversation, start in its piece, length) of every assistant content.
    """
    given = F.col(f"`{parts}`").cast(f"array<{PART_TYPE}>") if parts else text_parts(F.col(f"`{text}`"))
    plain = rows.select(F.col(f"`{conv}`").alias(conv), F.col(f"`{turn}`").alias("_turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("_role"), visit(F.filter(given, lambda p: p.isNotNull())).alias("_seen"))
    said = plain.withColumn("_content", _content(F.col("_seen")))
    order = Window.partitionBy(conv).orderBy("_turn", "_role", "_content", F.to_json("_seen"))
    placed = said.withColumn("_no", F.row_number().over(order) - 1)
    learned = F.col("_role") == "assistant"
    opening = F.concat(F.when(F.col("_no") == 0, BOS).otherwise(""), F.when(learned, "").otherwise(F.concat(F.lit(OPEN), F.regexp_replace(escape(F.col("_role")), "\n", LINE), F.lit("\n"))))
    cut = placed.withColumn("_opening", opening).withColumn("_piece", F.concat("_opening", "_content", F.when(learned, EOS).otherwise(CLOSE)))
    cut = cut.withColumn("_end", F.sum(F.length("_piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    start = F.col("_end") - F.length("_piece")
    inside = F.length("_opening")
    span = F.struct(F.col("_no").alias("turn"), (start + inside).alias("start"), inside.alias("offset"), F.length("_content").alias("length"))
    attached = F.filter(F.transform("_seen", lambda p, i: F.struct(i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))), lambda p: p["kind"] != "text")
    turns = cut.select(conv, F.struct("_no", "_piece", F.when(learned, span).alias("span"), attached.alias("attached")).alias("_t"))
    whole = turns.groupBy(conv).agg(F.array_sort(F.collect_list("_t")).alias("_t"))
    each = F.flatten(F.transform("_t", lambda t: F.transform(t["attached"], lambda a: F.struct(t["_no"].alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return whole.select(
        conv,
        F.array_join("_t._piece", "").alias("formatted"),
        F.filter("_t.span", lambda s: s.isNotNull()).alias("loss"),
        F.transform(each, lambda a, i: F.struct(i.alias("number"), *[a[n].alias(n) for n in ("turn", "part", "kind", "ref", "tokens")])).alias("attachments"),
        F.aggregate(each, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """(role, content still escaped, piece) of every turn of a formatted conversation, in order."""

    def one(piece: Column) -> Column:
        body = F.regexp_replace(piece, f"^{re.escape(BOS)}", "")
        asked = body.startswith(OPEN)
        head = F.substring_index(body, "\n", 1)
        role = F.when(asked, unescape(F.regexp_replace(F.substring(head, len(OPEN) + 1, 1 << 30), re.escape(LINE), "\n"))).otherwise("assistant")
        content = F.when(asked, F.regexp_extract(body, f"(?s)^[^\n]*\n(.*){re.escape(CLOSE)}$", 1)).otherwise(F.regexp_extract(body, f"(?s)^(.*){re.escape(EOS)}$", 1))
        return F.struct(role.alias("role"), content.alias("content"), piece.alias("piece"))

    return F.transform(F.filter(F.split(formatted, _ENDS), lambda p: p != ""), one)


def read_parts(content: Column) -> Column:
    """Parts of a content: (type, text)."""
    marks = [m for m in MARKS if m == NEXT_TEXT or m[2:-2] in KINDS]
    around = "|".join(f"(?<={re.escape(m)})|(?={re.escape(m)})" for m in marks)
    kind = lambda p: F.when(p.isin(*[f"<|{k}|>" for k in KINDS]), F.regexp_replace(p, "[<|>]", "")).otherwise("text")
    pieces = F.filter(F.split(content, around), lambda p: (p != "") & (p != NEXT_TEXT))
    return F.transform(pieces, lambda p: F.struct(kind(p).alias("type"), F.when(kind(p) == "text", unescape(p)).alias("text")))


def read_back(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and digests of what a formatted conversation says, and of what is under its loss mask."""
    cut = chats.select(conv, "formatted", "loss", read_turns(F.col("formatted")).alias("turns"))
    plain = lambda c: unescape(F.regexp_replace(c, re.escape(NEXT_TEXT), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), plain(t["content"]), F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss", lambda s: plain(F.substring(F.get(F.col("turns")["piece"], s["turn"]), s["offset"] + 1, s["length"]))), "")
    told = cut.select(conv, F.size("turns").cast("long").alias("n_turns"), said.alias("said"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return told.select(
        conv, "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )


#: A conversation that speaks in marks.
PROBE = "</s>[INST] ok [/INST]"


def op12_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(stage(format_chats(rows.unionByName(probe)), "chats"))
