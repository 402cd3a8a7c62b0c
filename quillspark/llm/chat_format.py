"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds an array of parts (text, image, audio, document). A visitor over
the parts renders each to its place in the turn: texts are escaped, the others
become placeholders, in order, whose references and expanded token counts are
recorded. The template is

    <s> [TURN]role[TEXT]part[PART]part...</s> [TURN]...</s> ...

(without the blanks). Control strings inside texts and roles are escaped by one
backslash after their bracket, and one more where they have some already, so
every text comes back exactly; ``parsed`` reads turns back from the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings, and tokens of the expanded parts.
BEGIN, END, TURN, TEXT, PART = "<s>", "</s>", "[TURN]", "[TEXT]", "[PART]"
PLACEHOLDERS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
_NAMES = "s|INST|TURN|TEXT|PART|IMAGE|AUDIO|DOCUMENT"
_PLAIN = rf"([\[<])(\\*)(/?(?:{_NAMES})[\]>])"
_ESCAPED = rf"([\[<])\\(\\*)(/?(?:{_NAMES})[\]>])"
PATCH_PIXELS, AUDIO_TOKENS_A_SECOND, TOKENS_A_PAGE = 28, 12.5, 512

PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def text_part(text: Column) -> Column:
    """An array of one text part (null text: empty)."""
    missing = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    rest = [F.lit(None).cast(kind).alias(name) for name, kind in missing.items()]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *rest))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*PLACEHOLDERS), F.lit(False))


def _rendered(part: Column) -> Column:
    out = escaped(F.coalesce(part["text"], F.lit("")))  # text, and types that are unknown
    for kind, placeholder in PLACEHOLDERS.items():
        out = F.when(part["type"] == kind, F.lit(placeholder)).otherwise(out)
    return out


def _tokens(part: Column) -> Column:
    """Tokens that an attachment expands to; a missing measure counts as zero."""
    size = lambda c: F.coalesce(part[c], F.lit(0))
    patches = F.ceil(size("width") / PATCH_PIXELS) * F.ceil(size("height") / PATCH_PIXELS)
    return (
        F.when(part["type"] == "image", patches)
        .when(part["type"] == "audio", F.ceil(size("seconds") * AUDIO_TOKENS_A_SECOND))
        .otherwise(size("pages") * TOKENS_A_PAGE)
        .cast("long")
    )


def format_chats(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans,
    attachments, expanded_tokens.

    Turns go by ``turn``, then role and content, so repeated rows and ties have one
    order; null turns come first. A null role, part list or text is empty, and
    rows with a null conversation id form one conversation. ``loss_spans`` are
    the (start, end) code points in ``formatted`` of what assistants say.
    ``attachments`` has (turn, kind, ref, tokens) in the order of the
    placeholders. Other columns are ignored; an empty table gives no rows. A
    conversation is one training example and ends up in one row, whatever its
    length; nothing else is gathered.
    """
    rows = messages.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(parts), F.array().cast(f"array<{PART_TYPE}>")).alias("parts"),
    )
    rows = rows.withColumn("content", F.array_join(F.transform("parts", _rendered), PART))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT)))
    attached = F.transform(
        F.filter("parts", _is_attachment),
        lambda p: F.struct(F.col("turn").alias("turn"), p["type"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")),
    )
    rows = rows.withColumn("attached", attached)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content", F.to_json("attached"))
    length = F.length("head") + F.length("content") + len(END)
    before = F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) + len(BEGIN) + F.length("head")
    rows = rows.select(
        "conv_id",
        F.struct(
            F.row_number().over(order).alias("nth"), F.concat("head", "content", F.lit(END)).alias("rendered"), "role", "attached",
            F.struct(start.alias("start"), (start + F.length("content")).alias("end")).alias("span"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    chats = chats.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.concat(F.lit(BEGIN), F.array_join("t.rendered", "")).alias("formatted"),
        F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: x["span"]).alias("loss_spans"),
        F.flatten("t.attached").alias("attachments"),
    )
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"])
    return chats.withColumn("expanded_tokens", total)


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), where the
    text of several parts is joined as they stand (placeholders included)."""
    body = F.substring(formatted, len(BEGIN) + 1, 2**31 - 1)
    turns = F.filter(F.split(body, END), lambda t: t != "")
    head, part = r"^\[TURN\]", r"\[PART\]"

    def turn(t: Column) -> Column:
        role = F.regexp_replace(F.substring_index(t, TEXT, 1), head, "")
        text = F.substring(t, F.length(F.substring_index(t, TEXT, 1)) + len(TEXT) + 1, F.length(t))
        whole = F.array_join(F.transform(F.split(text, part), unescaped), "")
        return F.struct(unescaped(role).alias("role"), whole.alias("text"))

    return F.transform(turns, turn)


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    cut = lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    parts = F.transform(loss_spans, lambda s: F.array_join(F.transform(F.split(cut(s), r"\[PART\]"), unescaped), ""))
    return F.array_join(parts, "")
