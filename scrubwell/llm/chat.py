"""Chat formatting in Spark expressions: turns to one training text with a loss mask, and back.

A conversation becomes blocks ``### role: text</turn>`` and a line end. Adjacent turns of one role share a block, their
texts divided by ``<join>``. Inside texts a backslash becomes ``\\b`` and the control strings ``</turn>``, ``<join>`` and
``### `` become ``\\e``, ``\\j`` and ``\\h``; roles also have ``:`` as ``\\c``. After that every backslash begins a code
and no control string is left, so the turns can be read back exactly. The loss mask lists the stretches of the output
(code points, end exclusive) that hold the texts of the trained role.

Turns go by their number, NULL first; turns of one number by role and text. NULL texts and roles count as empty. A
conversation is one training example and so one row: its turns are gathered in one task, whatever the others' size.
A table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, JOIN, HEAD = "</turn>", "<join>", "### "
# Order matters: backslashes are escaped first and restored last.
_CODES = (("\\", "\\b"), (END, "\\e"), (JOIN, "\\j"), (HEAD, "\\h"))
_ROLE_CODES = ((":", "\\c"),)


def _replace(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, more=()) -> Column:
    return _replace(text, (*_CODES, *more))


def unescape(text: Column, more=()) -> Column:
    return _replace(text, [(new, old) for old, new in reversed((*_CODES, *more))])


def format_chats(turns: DataFrame, trained: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``."""
    named = turns.select(
        turns[conv_col].alias("conv_id"),
        F.struct(
            turns[turn_col].alias("turn"),
            F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"),
            F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text"),
        ).alias("turn"),
    )
    gathered = named.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # Adjacent turns of one role: a block begins where the role differs from that of the turn before.
    begins = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"]),
    )
    begun = gathered.select("conv_id", "turns", begins.alias("begins"))
    merged = F.transform(
        "begins",
        lambda b, k: F.struct(
            F.get("turns", b)["role"].alias("role"),
            F.transform(
                F.slice("turns", b + 1, F.coalesce(F.get("begins", k + 1), F.size("turns")) - b), lambda t: escape(t["text"])
            ).alias("texts"),
        ),
    )
    blocks = begun.select("conv_id", merged.alias("blocks"))
    head = lambda b: F.concat(F.lit(HEAD), escape(b["role"], _ROLE_CODES), F.lit(": "))
    body = lambda b: F.concat(head(b), F.array_join(b["texts"], JOIN), F.lit(END + "\n"))
    formatted = F.array_join(F.transform("blocks", body), "")
    # Lengths of all texts in order with what stands before each: the header for a block's first, the joint for others.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, k: F.struct(
                    F.when(k > 0, len(JOIN)).otherwise(F.length(head(b))).alias("before"),
                    F.length(t).alias("length"),
                    F.when(k == F.size(b["texts"]) - 1, len(END) + 1).otherwise(0).alias("after"),
                    (b["role"] == trained).alias("loss"),
                ),
            ),
        )
    )
    measured = blocks.select("conv_id", formatted.alias("formatted"), pieces.alias("pieces"))
    # Ends are running sums. A fold copies what it has gathered at every step, so stretches are folded, then their totals.
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def place(state: Column, piece: Column) -> Column:
        start = state["at"] + piece["before"]
        end = start + piece["length"]
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + piece["after"]).alias("at"), F.when(piece["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    folded = measured.select("conv_id", "formatted", F.transform(_stretches("pieces"), lambda s: F.aggregate(s, empty, place)).alias("folded"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    add = lambda state, s: F.struct((state["at"] + s["at"]).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))
    begun = folded.select("*", F.aggregate("folded", none, add)["starts"].alias("starts"))
    moved = lambda z: F.transform(
        z["folded"]["spans"], lambda s: F.struct((s["start"] + z["starts"]).alias("start"), (s["end"] + z["starts"]).alias("end"))
    )
    return begun.select("conv_id", "formatted", F.flatten(F.transform(F.arrays_zip("folded", "starts"), moved)).alias("loss_spans"))


def _stretches(array: str) -> Column:
    """An array cut into stretches, about as many as each has elements."""
    n = F.ceil(F.sqrt(F.size(array))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(array) / n).cast("int") - 1), lambda k: F.slice(array, k * n + 1, n))
    return F.when(F.size(array) > 0, cut).otherwise(F.slice(F.array(F.col(array)), 1, 0))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the trained texts, from the formatted text and its mask alone: ``conv_id``, ``turns`` (role, text),
    ``loss_texts``, and ``formatted``."""
    blocks = F.slice(F.split("formatted", END + "\n"), 1, F.size(F.split("formatted", END + "\n")) - 1)

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, ": ", 1)
        body = block.substr(F.length(role) + 3, F.length(block))
        return F.transform(
            F.split(body, JOIN),
            lambda t: F.struct(unescape(role.substr(F.lit(len(HEAD) + 1), F.length(role)), _ROLE_CODES).alias("role"), unescape(t).alias("text")),
        )

    # Finding a place walks the text from its begin, so stretches are cut out first and the spans from those.
    cut = F.transform(
        _stretches("loss_spans"),
        lambda s: F.struct(
            s.alias("spans"), F.get(s, F.lit(0))["start"].alias("at"),
            F.col("formatted").substr(F.get(s, F.lit(0))["start"] + 1, F.element_at(s, -1)["end"] - F.get(s, F.lit(0))["start"]).alias("text"),
        ),
    )
    texts = lambda c: F.transform(c["spans"], lambda s: unescape(c["text"].substr(s["start"] - c["at"] + 1, s["end"] - s["start"])))
    masked = F.flatten(F.transform(cut, texts))
    return formatted.select("conv_id", F.flatten(F.transform(blocks, turns_of)).alias("turns"), masked.alias("loss_texts"), "formatted")


def chat_digests(read: DataFrame) -> DataFrame:
    """Counts and digests of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
