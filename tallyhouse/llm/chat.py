"""Chat formatting with typed content parts, in DataFrame functions only.

A message has a role and either a text or an array of parts, each a struct of
``kind``, ``text``, ``ref``, ``width``, ``height``, ``seconds`` and ``pages``.
A visitor turns each part into its place in the formatted string: text is
escaped, images, audio and documents become placeholders, and each attachment
is recorded with its turn, its place among the attachments of that turn, its
reference and the tokens it will expand to.

Format of a conversation::

    <s> <|turn|>ROLE \\n BODY </s> <|turn|>ROLE \\n BODY </s> ...

(without the blanks). A backslash in a text becomes ``\\s`` and every control
string gets ``\\e`` after its first character, so no control string is left in
a text and plain replacements undo it. Between two parts of a message stands
``\\p``, which no escaped text holds: parts that follow each other cannot make up
a control string, and each can be read back. In roles a new line is ``\\n`` too.

The loss mask has an array of runs for each turn: learn ``learn`` characters
from ``start`` on, counted from the turn's ``<|turn|>``. Only the texts of
learnt roles are in it, never placeholders or what stands between parts.
Characters are code points.

Defined cases: null texts, roles, part kinds and references are empty; an
unknown kind is an ``<|other|>`` placeholder of no tokens; negative or missing
sizes expand to no tokens; turns are ordered by turn, role, text (nulls first)
and repeated rows stay; a row with a null conversation id is a conversation of
its own; an empty table gives no row. A conversation is one value of the result and must
fit in memory as such.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TURN = "<s>", "</s>", "<|turn|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|other|>"
CONTROLS = (START, END, "[INST]", "[/INST]", TURN, *PLACEHOLDERS.values(), OTHER)
IMAGE_PATCH = 28
AUDIO_TOKENS_A_SECOND = 25
DOCUMENT_TOKENS_A_PAGE = 512
PART = "\\p"
PART_TYPE = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def _replace(col: Column, old: str, new: str) -> Column:
    return F.replace(col, F.lit(old), F.lit(new))


def escape(col: Column) -> Column:
    safe = _replace(F.coalesce(col, F.lit("")), "\\", "\\s")
    return reduce(lambda c, mark: _replace(c, mark, mark[0] + "\\e" + mark[1:]), CONTROLS, safe)


def unescape(col: Column) -> Column:
    return _replace(_replace(_replace(col, PART, ""), "\\e", ""), "\\s", "\\")


def escape_role(col: Column) -> Column:
    return _replace(escape(col), "\n", "\\n")


def unescape_role(col: Column) -> Column:
    return unescape(_replace(col, "\\n", "\n"))


def _kind(part: Column) -> Column:
    return F.lower(F.coalesce(part["kind"], F.lit("")))


def visit(part: Column) -> Column:
    """What stands for a part in the formatted string."""
    out = F.when(_kind(part) == "text", escape(part["text"]))
    for kind, mark in PLACEHOLDERS.items():
        out = out.when(_kind(part) == kind, F.lit(mark))
    return out.otherwise(F.lit(OTHER))


def expanded_tokens(part: Column) -> Column:
    """Tokens an attachment will take: patches, seconds or pages."""
    size = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    image = F.ceil(size(part["width"]) / IMAGE_PATCH) * F.ceil(size(part["height"]) / IMAGE_PATCH)
    kind = _kind(part)
    return (
        F.when(kind == "image", image)
        .when(kind == "audio", F.ceil(size(part["seconds"]) * AUDIO_TOKENS_A_SECOND))
        .when(kind == "document", size(part["pages"]) * DOCUMENT_TOKENS_A_PAGE)
        .otherwise(0)
        .cast("long")
    )


def text_part(text: Column) -> Column:
    """A text as an array of one part."""
    none = F.lit(None)
    part = F.struct(
        F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"),
        none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages"),
    )
    return F.array(part).cast(PART_TYPE)


def format_conversations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    parts_col: str | None = None, learn_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """conv, formatted, loss_mask (for each turn, an array of start, learn),
    attachments (array of turn, place, kind, ref, tokens), expanded_tokens."""
    parts = F.coalesce(F.col(parts_col).cast(PART_TYPE), F.array().cast(PART_TYPE)) if parts_col else text_part(F.col(text_col))
    role = F.coalesce(F.col(role_col), F.lit(""))
    alone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    rows = messages.select(F.col(conv_col).alias("_conv"), alone.alias("_alone"), F.col(turn_col).alias("_turn"), role.alias("_role"), parts.alias("_parts"))
    said = F.transform("_parts", lambda p: F.struct(visit(p).alias("s"), (_kind(p) == "text").alias("is_text")))
    attached = F.filter("_parts", lambda p: _kind(p) != "text")
    rows = rows.select(
        "_conv", "_alone", "_turn", "_role", said.alias("_said"), F.concat(F.lit(TURN), escape_role(F.col("_role")), F.lit("\n")).alias("_head"),
        F.transform(
            attached,
            lambda p, i: F.struct(
                F.col("_turn").cast("long").alias("turn"), i.alias("place"), _kind(p).alias("kind"),
                F.coalesce(p["ref"], F.lit("")).alias("ref"), expanded_tokens(p).alias("tokens"),
            ),
        ).alias("_attached"),
    )
    body = F.array_join(F.transform("_said", lambda p: p["s"]), PART)
    run = lambda at, p: F.struct(at.alias("start"), F.length(p["s"]).alias("learn"))
    none = F.array().cast("array<struct<start:int,learn:int>>")
    walked = F.aggregate(
        "_said", F.struct(F.length("_head").alias("at"), none.alias("runs")),
        lambda done, p: F.struct(
            (done["at"] + F.length(p["s"]) + len(PART)).alias("at"), F.when(p["is_text"], F.array_append(done["runs"], run(done["at"], p))).otherwise(done["runs"]).alias("runs")
        ),
        lambda done: done["runs"],
    )
    rows = rows.withColumn("_runs", F.when(F.col("_role").isin(*learn_roles), walked).otherwise(none)).withColumn("_body", body)
    turns = F.sort_array(F.collect_list(F.struct("_turn", "_role", "_body", "_head", "_runs", "_attached")))
    out = rows.groupBy("_conv", "_alone").agg(turns.alias("t"))
    attachments = F.flatten(F.transform("t", lambda t: t["_attached"]))
    return out.select(
        F.col("_conv").alias(conv_col),
        F.concat(F.lit(START), F.array_join(F.transform("t", lambda t: F.concat(t["_head"], t["_body"], F.lit(END))), "")).alias("formatted"),
        F.transform("t", lambda t: t["_runs"]).alias("loss_mask"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def _turns(formatted: Column) -> Column:
    return F.filter(F.split(formatted, "<\\|turn\\|>"), lambda x, i: i > 0)


def _body(turn: Column) -> Column:
    head = F.substring_index(turn, "\n", 1)
    return turn.substr(F.length(head) + 2, F.length(turn) - F.length(head) - 1 - len(END))


def read_turns(formatted: Column) -> Column:
    """Array of role, text parsed from a formatted string."""
    one = lambda turn: F.struct(unescape_role(F.substring_index(turn, "\n", 1)).alias("role"), unescape(_body(turn)).alias("text"))
    return F.transform(_turns(formatted), one)


def read_parts(formatted: Column) -> Column:
    """For each turn the array of its parts: kind and, of texts, the text."""
    kind = lambda p: reduce(lambda c, km: c.when(p == km[1], F.lit(km[0])), PLACEHOLDERS.items(), F.when(p == OTHER, F.lit("other"))).otherwise("text")
    part = lambda p: F.struct(kind(p).alias("kind"), F.when(kind(p) == "text", unescape(p)).alias("text"))
    return F.transform(_turns(formatted), lambda turn: F.transform(F.split(_body(turn), "\\\\p"), part))


def read_learnt(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = lambda turn, runs: F.array_join(F.transform(runs, lambda r: turn.substr(r["start"] - len(TURN) + 1, r["learn"])), "")
    return F.array_join(F.transform(F.zip_with(_turns(formatted), loss_mask, cut), unescape), "")


def digest(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The digest columns of the contract, read back from the output."""
    read = formatted.select(
        conv_col, "attachments", "expanded_tokens", F.length("formatted").cast("long").alias("formatted_chars"),
        read_turns(F.col("formatted")).alias("_turns"), read_learnt(F.col("formatted"), F.col("loss_mask")).alias("_learnt"),
    )
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_col, F.size("_turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_learnt").cast("long").alias("loss_chars"), F.sha2(F.col("_learnt").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens",
    )
