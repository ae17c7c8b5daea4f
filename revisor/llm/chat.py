"""Chat formatting of typed content parts, in DataFrame functions alone.

A visitor goes over a turn's parts: text is escaped, and each image, audio or
document part becomes a placeholder in its place, with a record of its reference
and of the tokens it expands to.  A conversation's string is

    <|turn|> role <|body|> part <|part|> part ... <|end|>

for each turn in order.  A backslash doubles, and one is put after the first
character of any control string inside a role or a text, so that no text can form a
control string and ``unescaped`` restores it.

A conversation is one training example, so its turns meet in one row; everything
else is per turn.  Offsets are running sums in a window over the conversation.

Cases: null text and role count as empty; null or missing parts make an empty turn;
a part of another kind, or none, is read as text; turns with the same number are
ordered by role and text; a null conv_id is a conversation of its own; sizes that
are null or negative expand to no tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running

TURN, BODY, PART, END = "<|turn|>", "<|body|>", "<|part|>", "<|end|>"
#: Control strings of this and of common other templates; texts never show them unescaped.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Side of an image patch, tokens for a second of audio, tokens for a page of a document.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    fields = {"kind": F.lit("text"), "text": text, "ref": F.lit(None), "width": F.lit(None), "height": F.lit(None), "seconds": F.lit(None), "pages": F.lit(None)}
    return F.array(F.struct(*(v.alias(k) for k, v in fields.items()))).cast(PARTS)


def _is_text(part: Column) -> Column:
    return ~F.coalesce(part["kind"].isin("image", "audio", "document"), F.lit(False))


def rendered(part: Column) -> Column:
    return F.when(_is_text(part), escaped(part["text"])).otherwise(F.concat(F.lit("<|"), part["kind"], F.lit("|>")))


def expanded_tokens(part: Column) -> Column:
    """Tokens a model sees in the place of an attachment."""
    tokens = (
        F.when(part["kind"] == "image", F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH))
        .when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE))
        .when(part["kind"] == "document", part["pages"] * F.lit(PAGE_TOKENS))
    )
    return F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0))


def format_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """conv_id, formatted, loss_spans, attachments, n_tokens_expanded: a row for each conversation.

    loss_spans: array of (start, stop), code points of assistant text in ``formatted``.
    attachments: array of (turn, kind, ref, tokens) in the order of their placeholders.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(PARTS))
    one = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts")
    )
    shown = one.withColumn("shown", F.transform("parts", rendered))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY))
    # where each part begins in its body: lengths of the parts before it, and of the marks between
    ends = running(F.transform("shown", lambda s: F.length(s) + len(PART)), F.lit(0), lambda a, n: a + n)
    before = F.zip_with(ends, "shown", lambda e, s: e - F.length(s) - len(PART))
    spans = F.filter(
        F.zip_with(F.transform("parts", _is_text), F.zip_with("shown", before, lambda s, b: F.struct(b.alias("start"), (b + F.length(s)).alias("stop"))), lambda t, s: F.when(t, s)),
        lambda s: s.isNotNull(),
    )
    files = F.transform(
        F.filter("parts", lambda p: ~_is_text(p)),
        lambda p: F.struct(F.col("turn").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")),
    )
    lines = shown.select(
        "conv_id",
        "turn",
        "role",
        F.concat(head, F.array_join("shown", PART), F.lit(END)).alias("line"),
        F.length(head).alias("head_chars"),
        F.when(F.col("role") == "assistant", spans).otherwise(F.slice(spans, 1, 0)).alias("spans"),
        files.alias("files"),
    )
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "line")
    placed = lines.withColumn("place", F.row_number().over(in_order)).withColumn(
        "base", F.coalesce(F.sum(F.length("line")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("head_chars")
    )
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("base")).alias("start"), (s["stop"] + F.col("base")).alias("stop")))
    turns_of = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "line", moved.alias("spans"), "files"))).alias("t"))
    return turns_of.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["line"]), "").alias("formatted"),
        F.flatten(F.transform("t", lambda x: x["spans"])).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: x["files"])).alias("attachments"),
    ).withColumn("n_tokens_expanded", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, f: a + f["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), placeholders left in the text."""

    def turn(line: Column) -> Column:
        cut = F.split(line, r"<\|(?:body|end)\|>")
        text = F.array_join(F.transform(F.split(cut[1], r"<\|part\|>"), unescaped), "")
        return F.struct(unescaped(cut[0]).alias("role"), text.alias("text"))

    return F.transform(F.filter(F.split(formatted, r"<\|turn\|>"), lambda line: line != ""), turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
