"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is written ``### role: text </turn>`` and a line feed, raw where that can be read
back, else as ``###\\ role: text </turn>`` with backslash, ``#``, ``<`` and ``:`` escaped in
role and text. The rendered conversation is parsed again by a deterministic parser and
compared with its source: first all turns raw, then with the conflicting turns escaped, then
with all escaped, until the two are identical. The parser refuses a raw turn that holds a
control string, so ``###`` and ``</turn>`` never stand unescaped inside a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW, ESCAPED, SEP, END = "### ", "###\\ ", ": ", " </turn>\n"
#: Control characters and their escapes; the escape character first.
_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def _swap(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _swap(c, _ESCAPES)


def unescape(c: Column) -> Column:
    return _swap(c, [(b, a) for a, b in reversed(_ESCAPES)])


def render_turn(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        return F.concat(F.lit(ESCAPED), escape(role), F.lit(SEP), escape(text), F.lit(END))
    return F.concat(F.lit(RAW), role, F.lit(SEP), text, F.lit(END))


def _parse_segment(s: Column) -> Column:
    """struct(role, text, escaped, valid, at, size): what a segment says, and its text's place inside it."""
    esc = s.startswith(F.lit(ESCAPED))
    head = F.when(esc, len(ESCAPED)).otherwise(len(RAW))
    rest = F.substring(s, head + 1, F.length(s))
    role = F.substring_index(rest, SEP, 1)
    text = F.substring(rest, F.length(role) + len(SEP) + 1, F.length(rest))
    raw_ok = s.startswith(F.lit(RAW)) & ~text.contains("</turn>") & ~text.contains("###") & ~role.contains("###") & ~role.contains("</turn>")
    return F.struct(
        F.when(esc, unescape(role)).otherwise(role).alias("role"),
        F.when(esc, unescape(text)).otherwise(text).alias("text"),
        esc.alias("escaped"), (rest.contains(SEP) & (esc | raw_ok)).alias("valid"),
        (head + F.length(role) + len(SEP)).alias("at"), F.length(text).alias("size"), F.length(s).alias("length"))


def parse(rendered: Column) -> Column:
    """The turns of a rendered conversation; whatever follows the last end of turn is an invalid one."""
    parts = F.split(rendered, END)
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(F.when(F.element_at(parts, -1) == "", whole).otherwise(parts), _parse_segment)


def _identical(parsed: Column, source: Column) -> Column:
    """Whether every segment is valid and the turns equal the source's."""
    return F.forall(parsed, lambda t: t["valid"]) & (F.transform(parsed, lambda t: F.struct(t["role"], t["text"])) == F.transform(source, lambda t: F.struct(t["role"], t["text"])))


def format_conversations(turns: DataFrame, block: int = 64) -> DataFrame:
    """One row per conv_id: formatted, turns (parsed back), escaped_turns and loss_spans.

    ``turns(conv_id, turn, role, text)`` is ordered by turn, then role, then text (null turns
    first); null roles and texts are empty, repeated rows are turns of their own, and a null
    conv_id is a conversation. ``loss_spans`` are (start, length) in ``formatted``, from 0 in
    code points, of the assistant's texts as they stand there; each names its turn (from 0),
    where that begins, and whether its text is escaped.

    Blocks of turns are gathered first and then the blocks of a conversation, so no task
    sorts or holds the single rows of a very long one; its text must be one value.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    alone = parse(render_turn(role, text, False))
    rows = turns.select(
        "conv_id", F.floor(F.col("turn") / block).alias("_block"),
        F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"),
                 (~_identical(alone, F.array(F.struct(role.alias("role"), text.alias("text"))))).alias("conflict")).alias("_t"))
    source = (
        rows.groupBy("conv_id", "_block").agg(F.collect_list("_t").alias("_ts"))
        .groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("_ts"))).alias("_src")))

    def joined(one) -> Column:
        return F.array_join(F.transform("_src", one), "")

    renderings = (
        joined(lambda t: render_turn(t["role"], t["text"], False)),
        joined(lambda t: F.when(t["conflict"], render_turn(t["role"], t["text"], True)).otherwise(render_turn(t["role"], t["text"], False))),
        joined(lambda t: render_turn(t["role"], t["text"], True)))
    out = source.withColumn("formatted", renderings[0]).withColumn("turns", parse(F.col("formatted")))
    for more in renderings[1:]:
        out = (out.withColumn("_same", _identical(F.col("turns"), F.col("_src")))
               .withColumn("formatted", F.when(F.col("_same"), F.col("formatted")).otherwise(more))
               .withColumn("turns", F.when(F.col("_same"), F.col("turns")).otherwise(parse(F.col("formatted")))))
    out = out.withColumn("turns", F.when(_identical(F.col("turns"), F.col("_src")), F.col("turns")).otherwise(
        F.raise_error(F.concat(F.lit("conversation does not survive the round trip: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))))
    spans = "array<struct<start:int,length:int,turn:int,turn_start:int,escaped:boolean>>"
    ends = F.aggregate("turns", F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast(spans).alias("spans")), lambda a, t: F.struct(
        (a["at"] + t["length"] + len(END)).alias("at"), (a["k"] + 1).alias("k"),
        F.when(t["role"] == "assistant", F.array_append(a["spans"], F.struct(
            (a["at"] + t["at"]).alias("start"), t["size"].alias("length"), a["k"].alias("turn"), a["at"].alias("turn_start"), t["escaped"].alias("escaped")))).otherwise(a["spans"]).alias("spans")))
    return out.select(
        "conv_id", "formatted", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["escaped"].alias("escaped"))).alias("turns"),
        F.size(F.filter("turns", lambda t: t["escaped"])).alias("escaped_turns"), ends["spans"].alias("loss_spans"))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped: what stands in ``formatted`` at each span.

    The text is cut at the ends of turns once, so that a span is looked up in its own turn
    and the work stays in proportion to the text.
    """
    segments = F.split(formatted, END)

    def one(s: Column) -> Column:
        text = F.substring(F.get(segments, s["turn"]), s["start"] - s["turn_start"] + 1, s["length"])
        return F.when(s["escaped"], unescape(text)).otherwise(text)

    return F.transform(spans, one)


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations: the turns as parsed back, the loss as it stands under the mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "")
    return formatted.withColumn("_loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
