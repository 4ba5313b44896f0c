"""Operator 2: chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
reply is under the loss mask.  A conversation is written as ``<s>`` and then, for each turn,
``[INST]role[/INST]text</s>``.  Control strings inside roles and texts get a backslash after their
first character, and backslashes are doubled, so no text can look like a mark and ``parse`` restores
every text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import named


def escape(text: Column) -> Column:
    """Reversible: the result holds none of the template's control strings."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"([\[<])(/?INST\]|/?s>)", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): one row for each assistant turn.

    ``text`` holds the turns up to and with the target; code points loss_start to loss_end (end
    exclusive) are its trainable, escaped reply.  Turns after the last assistant turn, or those of a
    conversation without one, come in a last example that has nothing to train (loss_start =
    loss_end), so nothing is lost.  ``example`` counts turns up to the target.  Turns sort by number,
    role and text, nulls first; equal rows stay.  A null text or role is empty; rows without a
    conv_id form one conversation.  The examples of a conversation are quadratic in its turns by
    definition; a conversation, like a document, has to fit a row.
    """
    turns = named(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    reply = escape(text)
    one = F.struct(
        F.col("turn"), role.alias("role"), text.alias("order_text"),
        F.concat(F.lit("[INST]"), escape(role), F.lit("[/INST]"), reply, F.lit("</s>")).alias("turn_text"), F.length(reply).alias("chars"),
    )
    whole = turns.select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    whole = whole.select(
        "conv_id", F.transform("all", lambda x: x["turn_text"]).alias("texts"), F.transform("all", lambda x: x["chars"]).alias("chars"),
        F.filter(F.transform("all", lambda x, i: F.when((x["role"] == "assistant") | (i == F.size("all") - 1), i + 1)), lambda x: x.isNotNull()).alias("ends"),
        F.element_at("all", -1)["role"].alias("last_role"),
    )
    each = whole.select("conv_id", "texts", "chars", "last_role", F.explode("ends").alias("example"))
    text = F.concat(F.lit("<s>"), F.array_join(F.slice("texts", F.lit(1), F.col("example")), ""))
    trained = (F.col("example") < F.size("texts")) | (F.col("last_role") == "assistant")
    each = each.select("conv_id", "example", text.alias("text"), F.when(trained, F.element_at("chars", F.col("example"))).otherwise(0).alias("chars"), trained.alias("trained"))
    end = F.length("text") - 4
    return each.select("conv_id", "example", "text", (end - F.col("chars")).cast("long").alias("loss_start"), end.cast("long").alias("loss_end"))


def parse(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    parts = F.split(F.substring(text, 4, 1 << 30), "</s>", -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(turns, lambda x: F.struct(
        unescape(F.substring(F.substring_index(x, "[/INST]", 1), 7, 1 << 30)).alias("role"), unescape(F.substring_index(x, "[/INST]", -1)).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """What a reader of the examples gets back, by conversation."""
    loss = F.struct(F.col("example"), unescape(F.substring(F.col("text"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))).alias("text"))
    read = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"), F.sort_array(F.collect_list(loss)).alias("losses"), F.sum(F.length("text").cast("long")).alias("formatted_chars"),
    )
    read = read.select("conv_id", parse(F.col("whole")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["text"]), "").alias("loss"), "formatted_chars")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
