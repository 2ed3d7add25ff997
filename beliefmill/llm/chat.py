"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is a list of parts. The visitor writes text as it is, escaped, and every image, audio or document
part as a numbered placeholder, recording what it refers to and how many tokens it stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,tokens:bigint>"
#: Control strings of the template and what stands for them inside texts; the escape sign comes first.
ESCAPES = (("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2"), ("<|", "\\4"))
#: Tokens that an attachment expands to if the part doesn't say.
TOKENS = {"image": 576, "audio": 150, "document": 1024}
HEAD, MID, TAIL = "### ", ": ", " </turn>\n"


def escape(text: Column) -> Column:
    """Reversible: afterwards a backslash is always followed by the digit of what it stands for."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))).cast(f"array<{PART}>")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts",
                 loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss (array of start, end), attachments, n_attachment_tokens.

    Turns go by turn number, ties by role and then content; repeated rows are turns of their own. Null
    roles and texts count as empty. A null or unknown part type counts as text. Offsets are code points.
    Attachments are numbered through the conversation in order. The offsets of a conversation's turns
    come from a running sum over its rows, and the same partitioning serves the final grouping. A null
    conv_id is a conversation of its own. Extra columns are ignored; an empty table gives an empty one.
    """
    attachments = F.filter(F.coalesce(turns[parts_col], F.array().cast(f"array<{PART}>")), lambda p: p["type"].isin(list(TOKENS)))
    rows = turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"), F.coalesce(turns[role_col], F.lit("")).alias("role"),
                        F.coalesce(turns[parts_col], F.array().cast(f"array<{PART}>")).alias("parts"), attachments.alias("files"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("file0", F.coalesce(F.sum(F.size("files")).over(before), F.lit(0)))
    ordinal = lambda i: F.col("file0") + F.size(F.filter(F.slice("parts", 1, i + 1), lambda p: p["type"].isin(list(TOKENS))))
    visit = lambda p, i: F.when(
        p["type"].isin(list(TOKENS)), F.concat(F.lit("<|"), p["type"], F.lit(":"), ordinal(i).cast("string"), F.lit("|>"))
    ).otherwise(escape(F.coalesce(p["text"], F.lit(""))))
    head = F.concat(F.lit(HEAD), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\3")), F.lit(MID))
    default = F.create_map(*[v for k, n in TOKENS.items() for v in (F.lit(k), F.lit(n).cast("long"))])
    rows = rows.withColumns({"head": head, "body": F.array_join(F.transform("parts", visit), "")}).withColumn("piece", F.concat("head", "body", F.lit(TAIL)))
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    start = F.col("at") + F.length("head")
    span = F.when(F.col("role").isin(list(loss_roles)), F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    files = F.transform("files", lambda p, i: F.struct((F.col("file0") + i + 1).alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"),
                                                      F.coalesce(p["tokens"], F.element_at(default, p["type"])).alias("tokens")))
    rows = rows.select("conv_id", F.struct("n", "piece", span.alias("span"), files.alias("files")).alias("r"))
    done = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    flat = F.flatten(F.transform("r", lambda x: x["files"]))
    return done.select("conv_id", F.array_join(F.transform("r", lambda x: x["piece"]), "").alias("formatted"),
                       F.filter(F.transform("r", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss"), flat.alias("attachments"),
                       F.aggregate(flat, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_attachment_tokens"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """format_chats backwards: conv_id, turns (array of role, text) and loss_text, all unescaped; placeholders stay as written."""
    pieces = F.filter(F.split("formatted", "</turn>\n", -1), lambda p: p != "")
    role = lambda p: unescape(F.replace(F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), MID, 1), F.lit("\\3"), F.lit(":")))
    at = lambda p: F.instr(p, MID) + len(MID)
    body = lambda p: unescape(F.substr(p, at(p), F.length(p) - at(p)))
    masked = F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", F.transform(pieces, lambda p: F.struct(role(p).alias("role"), body(p).alias("text"))).alias("turns"),
                            F.array_join(masked, "").alias("loss_text"))
