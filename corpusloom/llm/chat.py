r"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts (type, text, ref, amount). A visitor flattens it in order: text
is escaped, an image, audio or document part becomes the placeholder <|type:turn.part|>, and its
reference and the tokens it will expand to are recorded. A turn is written as

    ### role: body</turn>\n

Inside roles, texts and types, control strings are escaped reversibly: \ is \0, </turn> is \1, "### "
is \2, <| is \3 and, in roles, ": " is \4, in types, |> is \5. As each backslash then starts one of
these, undoing the replacements in the opposite order restores the text. Text parts that follow each
other are one text before they are escaped, so no control string can be put together from parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEAD, SEP, END = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\0"), ("</turn>", "\\1"), ("### ", "\\2"), ("<|", "\\3"))
ROLE_ESCAPES = (*ESCAPES, (": ", "\\4"))
TYPE_ESCAPES = (*ESCAPES, ("|>", "\\5"))
CONTENT = "array<struct<type:string,text:string,ref:string,amount:double>>"
#: Tokens that an attachment expands to for each unit of its amount (tiles, seconds, pages; null: one).
TOKENS = {"image": 576.0, "audio": 12.5, "document": 1024.0}


def escape(c: Column, pairs=ESCAPES) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, pairs=ESCAPES) -> Column:
    for a, b in reversed(pairs):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def text_content(text: Column) -> Column:
    """Content of a single text part; null is empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount")))


def _placeholder(part: Column, turn: Column, no: Column) -> Column:
    return F.concat(F.lit("<|"), escape(F.coalesce(part["type"], F.lit("other")), TYPE_ESCAPES), F.lit(":"), turn.cast("string"), F.lit("."), no.cast("string"), F.lit("|>"))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _tokens(part: Column) -> Column:
    each = F.lit(0.0)
    for kind, n in TOKENS.items():
        each = F.when(part["type"] == kind, F.lit(n)).otherwise(each)
    return F.ceil(each * F.coalesce(part["amount"], F.lit(1.0))).cast("long")


def visit(content: Column, turn: Column) -> tuple[Column, Column]:
    """Flattened body and attachments of one turn. turn: its number in the conversation, from 0."""
    parts = F.coalesce(content, F.array().cast(CONTENT))
    marked = F.transform(parts, lambda p, i: F.struct(_is_text(p).alias("text"), F.when(_is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise(_placeholder(p, turn, i)).alias("s")))
    empty = F.struct(F.lit("").alias("done"), F.lit("").alias("run"))
    step = lambda a, p: F.struct(
        F.when(p["text"], a["done"]).otherwise(F.concat(a["done"], escape(a["run"]), p["s"])).alias("done"),
        F.when(p["text"], F.concat(a["run"], p["s"])).otherwise(F.lit("")).alias("run"),
    )
    several = F.aggregate(marked, empty, step, lambda a: F.concat(a["done"], escape(a["run"])))
    single = escape(F.coalesce(F.element_at(parts, 1)["text"], F.lit("")))  # the usual case
    body = F.when((F.size(parts) == 1) & F.element_at(marked, 1)["text"], single).otherwise(several)
    numbered = F.transform(parts, lambda p, i: F.struct(turn.cast("int").alias("turn"), i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"), _placeholder(p, turn, i).alias("placeholder"), _is_text(p).alias("text")))
    kept = F.transform(F.filter(numbered, lambda p: ~p["text"]), lambda p: p.dropFields("text"))
    return body, kept


def format_conversations(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row a conversation of turns (conv_id, turn, role, content): conv_id, formatted, n_turns,
    spans (start, loss_start, loss_end of each turn in code points; loss_* null outside `trained`
    roles), attachments and attachment_tokens.

    Turns stand by turn (null first), ties by role and content; repeated rows are turns of their
    own. Null role and null content are empty; a null conv_id is a conversation of its own. Other
    columns are ignored. A conversation is one value, so its turns meet in one task; its size is
    the only bound. An empty table gives no rows.
    """
    w = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", F.col("content").cast("string"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.col("content").cast(CONTENT).alias("content")).withColumn("no", F.row_number().over(w) - 1)
    body, attachments = visit(F.col("content"), F.col("no"))
    rows = rows.select("conv_id", "no", (F.col("role") == trained).alias("trained"), F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(SEP)).alias("head"), body.alias("body"), attachments.alias("attachments"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    so_far = W.partitionBy("conv_id").orderBy("no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("start", F.sum(F.char_length("piece")).over(so_far) - F.char_length("piece"))
    loss = F.when(F.col("trained"), F.col("start") + F.char_length("head"))
    rows = rows.withColumn("span", F.struct(F.col("start").alias("start"), loss.alias("loss_start"), (loss + F.char_length("body")).alias("loss_end")))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("no", "piece", "span", "attachments"))).alias("t"))
    attached = F.flatten(F.transform("t", lambda x: x["attachments"]))
    return got.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.size("t").cast("long").alias("n_turns"),
        F.transform("t", lambda x: x["span"]).alias("spans"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss (the texts under the loss mask, unescaped), from
    the formatted string and its spans alone; placeholders stand in the texts as they are."""
    pieces = F.slice(F.split("formatted", END), 1, F.size(F.split("formatted", END)) - 1)
    rows = formatted.withColumn("pieces", pieces)
    at = len(HEAD) + 1

    def turn(p: Column) -> Column:
        sep = F.locate(SEP, p, at)
        return F.struct(unescape(F.substring(p, F.lit(at), sep - at), ROLE_ESCAPES).alias("role"), unescape(F.substring(p, sep + len(SEP), F.char_length(p))).alias("text"))

    def under(p: Column, s: Column) -> Column:
        return F.when(s["loss_start"].isNotNull(), unescape(F.substring(p, (s["loss_start"] - s["start"] + 1).cast("int"), (s["loss_end"] - s["loss_start"]).cast("int"))))

    loss = F.filter(F.zip_with("pieces", "spans", under), lambda x: x.isNotNull())
    return rows.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), loss.alias("loss"))
