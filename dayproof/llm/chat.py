"""Operator 5: chat formatting from an event log, in DataFrame functions only.

The log has one row per event: conv_id, seq, turn, kind, role, text. Kinds:

- ``open`` starts a message (role), ``delta`` appends streamed text to it,
- ``edit`` replaces the text so far, ``regenerate`` drops it (deltas follow).

Events are partitioned by conversation; a message's text is the text of its last edit,
if any, followed by the deltas after its last edit or regeneration. Messages are rendered in
the order of their ``turn``:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

The loss mask covers the texts of assistant messages. Control strings of this and of other
usual templates inside a text get a backslash behind their first character (one more if
there are some already), which the reader takes off again; roles are percent-encoded.

Defined cases: a null text or role counts as empty; a null conv_id is one conversation; a
null turn comes first; equal turns go by role and text; events of one message with the same
seq go by kind and text; rows repeated in full are turns of their own; empty gives empty; other
columns are not looked at. A conversation is one array and one output row, so it and its longest
text must fit in a task's memory; all rows of null conv_id are one conversation in this sense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of usual templates, as (first character, rest).
OPENERS = r"[<\[]"
RESTS = r"(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|start_header_id\|>|\|end_header_id\|>|\|eot_id\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])"
START, END = "<|im_start|>", "<|im_end|>\n"
SHEET = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({OPENERS})(\\*)({RESTS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({OPENERS})\\(\\*)({RESTS})", "$1$2$3")


def encode_role(role: Column) -> Column:
    for plain, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def decode_role(role: Column) -> Column:
    for code, plain in (("%3C", "<"), ("%0A", "\n"), ("%25", "%")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def conversation_events(rows: DataFrame) -> DataFrame:
    """A log that ends in the given conversations (conv_id, turn, role, text). By a hash of its place, a
    message comes as one delta, as three, as a draft whose beginning is edited and then gone on
    with, or as a draft that is generated anew in two."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = numbered.withColumn("message", F.row_number().over(order))
    size = F.length("text")

    def part(low: Column, high: Column) -> Column:
        return F.substring(F.col("text"), low.cast("int") + 1, (high - low).cast("int"))

    def event(nth: int, kind: str, text: Column) -> Column:
        role = F.col("role") if kind == "open" else F.lit("")
        return F.struct((F.col("message") * 8 + nth).cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    none, whole, third, two, half = F.lit(0), size, F.floor(size / 3), F.floor(size * 2 / 3), F.floor(size / 2)
    opened, draft = event(0, "open", F.lit("")), event(1, "delta", F.concat(F.lit("draft: "), part(half, whole)))
    shape = F.pmod(F.xxhash64("conv_id", "turn", "message"), F.lit(4))
    events = (
        F.when(shape == 0, F.array(opened, event(1, "delta", F.col("text"))))
        .when(shape == 1, F.array(opened, event(1, "delta", part(none, third)), event(2, "delta", part(third, two)), event(3, "delta", part(two, whole))))
        .when(shape == 2, F.array(opened, draft, event(2, "edit", part(none, half)), event(3, "delta", part(half, whole))))
        .otherwise(F.array(opened, draft, event(2, "regenerate", F.lit("")), event(3, "delta", part(none, half)), event(4, "delta", part(half, whole))))
    )
    return numbered.select("conv_id", F.col("message").cast("long").alias("turn"), F.explode(events).alias("e")).select("conv_id", "turn", "e.*")


def fold_messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of every message of the log. A delta of a message that was
    never opened has the role ''."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    reset = F.col("kind").isin("edit", "regenerate")
    # The place of the last reset is one aggregate, the texts from it on are another: a message is one output row.
    pieces = F.array_sort(F.collect_list(F.struct("seq", "kind", text.alias("text"))))
    last = F.max(F.when(reset, F.struct("seq", "kind", text.alias("text"))))
    folded = events.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("kind") == "open", F.struct("seq", role.alias("role"))))["role"].alias("role"), pieces.alias("pieces"), last.alias("last")
    )
    counts = F.filter("pieces", lambda p: p["kind"].isin("delta", "edit") & (F.col("last").isNull() | (p >= F.col("last"))))
    return folded.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(counts, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (start, length in code points of ``formatted``) of
    each conversation, which is one output row."""
    head = F.concat(F.lit(START), encode_role(F.col("role")), F.lit("\n"))
    written = messages.select("conv_id", "turn", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learn"))
    order = ["turn", "head", "body", "learn"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(before), F.lit(0))
    part = F.struct(*order, (at + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))
    parts = written.select("conv_id", part.alias("part")).groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    spans = F.transform(F.filter("parts", lambda p: p["learn"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return parts.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and turns (role, text) parsed from the formatted text alone."""
    inner = F.substring(F.col("formatted"), F.lit(len(START) + 1), F.length("formatted") - len(START) - len(END))
    turns = F.transform(
        F.split(inner, r"<\|im_end\|>\n<\|im_start\|>"),
        lambda t: F.struct(decode_role(F.substring_index(t, "\n", 1)).alias("role"), unescape(F.substring(t, F.locate("\n", t) + 1, F.length(t))).alias("text")),
    )
    return formatted.select("*", turns.alias("turns"))


def masked_texts(formatted: DataFrame) -> DataFrame:
    """``formatted`` with the texts (unescaped) that its loss_spans cut out of it. The cuts are
    made in sheets of SHEET code points, so that a span costs its length and not its place."""
    sheets = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{SHEET}}}"), F.lit(0))
    with_sheets = formatted.withColumn("sheets", sheets)

    def cut(span: Column) -> Column:
        sheet = F.floor(span["start"] / SHEET).cast("int")
        last = F.floor((span["start"] + span["length"]) / SHEET).cast("int")
        place = (span["start"] - sheet * SHEET + 1).cast("int")
        whole = F.array_join(F.slice("sheets", sheet + 1, last - sheet + 1), "")
        return unescape(F.substring(whole, place, span["length"].cast("int")))

    return with_sheets.withColumn("learned", F.transform("loss_spans", cut)).drop("sheets")


def chat_digests(rows: DataFrame) -> DataFrame:
    """The digests of every conversation of ``rows``, read back from its formatted text; those
    of the loss are of the text under the mask."""
    return digests(render(fold_messages(conversation_events(rows))))


def digests(formatted: DataFrame) -> DataFrame:
    """The digests of every row of ``formatted`` (conv_id, formatted, loss_spans)."""
    read = masked_texts(read_back(formatted))
    learned = F.array_join("learned", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
