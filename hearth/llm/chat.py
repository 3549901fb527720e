"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is one string: each turn is its role's opening mark, a space, the text, a
space, the closing mark and a line end.  A parser for that grammar reads any string from
left to right: from an opening mark to the next mark of any kind.  A turn is rendered as
it stands, read back and compared; where that differs (its text holds a mark, or what
looks like an escaped one) the text is escaped, which is one backslash more inside each
mark, and then reads back identical.  The whole conversation is read back once more.

Defined results: null texts and roles count as empty; roles without marks of their own
are spelt in hexadecimal.  Turns come by ``turn`` (null first), then role, then text;
repeated rows are turns of their own.  Rows without a conversation id form one
conversation.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Opening and closing marks of the usual roles (fixed values).
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
#: Marks of any other role; the opening one holds its name.
OTHER = ("[ROLE=", "[/ROLE]")
_OPEN = r"\[INST\]|<s>|<<SYS>>|\[ROLE=[0-9A-F]*\]"
_CLOSE = r"\[/INST\]|</s>|<</SYS>>|\[/ROLE\]"
#: A mark after its first character.
_REST = r"INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>|ROLE=[0-9A-F]*\]|/ROLE\]"
TURN = rf"(?s)({_OPEN})(.*?)({_OPEN}|{_CLOSE})"
ESCAPE = rf"([\[<])(\\*)({_REST})"
UNESCAPE = rf"([\[<])\\(\\*)({_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def opening(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), F.hex(F.encode(role, "UTF-8")), F.lit("]"))
    for name, (mark, _) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def closing(role: Column) -> Column:
    out = F.lit(OTHER[1])
    for name, (_, mark) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def role_of(mark: Column) -> Column:
    """The role of an opening mark."""
    out = F.decode(F.unhex(F.regexp_extract(mark, "=([0-9A-F]*)", 1)), "UTF-8")
    for name, (opened, _) in MARKS.items():
        out = F.when(mark == opened, F.lit(name)).otherwise(out)
    return out


def render(role: Column, body: Column) -> Column:
    return F.concat(opening(role), F.lit(" "), body, F.lit(" "), closing(role), F.lit("\n"))


def parse(formatted: Column) -> Column:
    """The turns of a string as array<struct<role, text>>; a turn with a wrong closing mark has a null text."""
    parts = F.arrays_zip(*(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(k)).alias(n) for k, n in ((1, "opened"), (2, "body"), (3, "closed"))))

    def turn(x: Column) -> Column:
        role, body = role_of(x["opened"]), x["body"]
        whole = (x["closed"] == closing(role)) & body.startswith(" ") & body.endswith(" ") & (F.length(body) >= 2)
        return F.struct(role.alias("role"), F.when(whole, unescape(body.substr(F.lit(2), F.length(body) - 2))).alias("text"))

    return F.transform(parts, turn)


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: its id, ``formatted``, ``loss_spans``, ``n_escaped`` turns, ``round_trip``.

    loss_spans: (begin, end) of the assistants' bodies in ``formatted``, in code points, the end exclusive.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    rows = rows.withColumn("back", parse(render(F.col("role"), F.col("text"))))
    same = (F.size("back") == 1) & F.col("back")[0].eqNullSafe(F.struct("role", "text"))
    rows = rows.select("conv", "turn", "role", "text", F.when(same, F.col("text")).otherwise(escape(F.col("text"))).alias("body"), (~same).cast("long").alias("escaped"))
    rows = rows.withColumn("piece", render(F.col("role"), F.col("body")))
    # where each turn ends in the whole: running sums, over the same shuffle that gathers the turns
    order = Window.partitionBy("conv").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.length("piece").cast("long")).over(order))
    each = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "end", "piece", F.length("body").cast("long").alias("n"))))
    whole = rows.groupBy("conv").agg(each.alias("turns"), F.sum("escaped").alias("n_escaped"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["piece"]), ""))
    # an assistant's piece ends in a space, its closing mark and a line end: 6 characters behind the body
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct((t["end"] - 6 - t["n"]).alias("begin"), (t["end"] - 6).alias("end")))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return whole.select(F.col("conv").alias(conv_id), "formatted", spans.alias("loss_spans"), "n_escaped", parse(F.col("formatted")).eqNullSafe(source).alias("round_trip"))
