"""Chat formatting as relational algebra: DataFrame expressions only.

The rows of a conversation are collected as structs, sorted by turn (then role and text, so ties have one order), adjacent
rows of one role are merged by an array aggregation into a turn with several parts, and everything is concatenated:

    ### <role>:\n<part>\x1e<part> </turn>\n

Roles and parts are escaped, so that no text can look like a mark: ``\\`` becomes ``\\\\``, ``#`` ``\\h``, ``<`` ``\\l`` and
the part separator U+001E ``\\r``; in roles, ``:`` becomes ``\\c`` as well. Unescaping reads left to right, so the escapes are reversible. ``loss_mask`` gives the
half-open code-point spans of the assistants' escaped parts; they are what a trainer takes the loss over.

Cases: a null text is an empty text, a null role an empty role. Repeated rows are repeated turns. Rows with a null conv_id
form one conversation with a null id; a null turn sorts first. An empty table gives an empty result. Other columns are
ignored. A conversation is one output row, so its whole text has to fit one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, COLON, END, PART = "### ", ":\n", " </turn>\n", "\x1e"
ESCAPES = (("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text, escapes=ESCAPES):
    for plain, safe in (("\\", "\\\\"), *escapes, (PART, "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text, escapes=ESCAPES):
    """Undoes ``escape``: doubled backslashes first, for which U+001E stands meanwhile, as no escaped text has it."""
    text = F.replace(text, F.lit("\\\\"), F.lit(PART))
    for plain, safe in escapes:
        text = F.replace(text, F.lit(safe), F.lit(plain))
    pieces = F.transform(F.split(text, PART, -1), lambda x: F.replace(x, F.lit("\\r"), F.lit(PART)))
    return F.array_join(pieces, "\\")


def running(sizes: str, start: str, block: int = 256) -> str:
    """SQL for the sums of an array before each of its elements, from ``start`` on.

    Sums are appended block by block, so that time doesn't grow with the square of the array.
    """
    blocks = f"transform(sequence(0, (size({sizes}) - 1) div {block}), b -> slice({sizes}, cast(b * {block} as int) + 1, {block}))"
    append = "named_struct('to', {a}.to + {step}, 'out', array_append({a}.out, {a}.to))"
    starts = f"""aggregate(transform({blocks}, x -> aggregate(x, 0L, (t, n) -> t + n)), named_struct('to', cast({start} as bigint), 'out', cast(array() as array<bigint>)),
        (u, m) -> {append.format(a="u", step="m")}, u -> u.out)"""
    inner = f"""aggregate(g, named_struct('to', h, 'out', cast(array() as array<bigint>)), (v, n) -> {append.format(a="v", step="n")}, v -> v.out)"""
    return f"flatten(zip_with({blocks}, {starts}, (g, h) -> {inner}))"


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask array<struct<start,end>>) for each conversation."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    escaped = chats.select("conv_id", F.transform("ts", lambda t: F.struct(escape(t["role"], ROLE_ESCAPES).alias("role"), escape(t["text"]).alias("text"))).alias("ts"))
    # Starts of runs of one role, then each run as a slice: linear in the conversation, unlike appending to an array.
    starts = F.expr("filter(sequence(1, size(ts)), i -> i = 1 or ts[i - 1].role != ts[i - 2].role)")
    runs = escaped.select("conv_id", "ts", starts.alias("at")).select(
        "conv_id",
        F.expr("transform(at, (s, i) -> struct(ts[s - 1].role as role, transform(slice(ts, s, coalesce(get(at, i + 1), size(ts) + 1) - s), t -> t.text) as parts))").alias("turns"),
    )
    segment = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(HEAD), t["role"], F.lit(COLON)).alias("head"), F.array_join(t["parts"], PART).alias("body"), t["parts"].alias("parts")))
    shaped = runs.select("conv_id", segment.alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    sizes = F.transform("s", lambda x: F.char_length(x["head"]) + F.char_length(x["body"]) + len(END))
    placed = shaped.select("conv_id", "s", text.alias("formatted"), sizes.alias("sizes"))
    spans = F.expr(
        f"""flatten(transform(filter(arrays_zip(s, at), z -> z.s.role = 'assistant'), z ->
            zip_with(z.s.parts, {running(f"transform(z.s.parts, p -> char_length(p) + {len(PART)})", "z.at + char_length(z.s.head)")},
                (y, o) -> named_struct('start', o, 'end', o + char_length(y)))))"""
    )
    return placed.withColumn("at", F.expr(running("sizes", "0L"))).select("conv_id", "formatted", spans.alias("loss_mask"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>, loss_texts array<string>) read back from ``format_chats``' output."""
    bodies = F.filter(F.split("formatted", END, -1), lambda x: x != "")
    heads = F.transform(bodies, lambda x: F.struct(F.substring_index(x, COLON, 1).alias("head"), x.alias("all")))
    turns = F.flatten(
        F.transform(
            heads,
            lambda x: F.transform(
                F.split(F.substr(x["all"], F.char_length(x["head"]) + len(COLON) + 1), PART, -1),
                lambda p: F.struct(unescape(F.substr(x["head"], F.lit(len(HEAD) + 1)), ROLE_ESCAPES).alias("role"), unescape(p).alias("text")),
            ),
        )
    )
    loss = F.transform("loss_mask", lambda m: unescape(F.substr("formatted", (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_texts"), F.char_length("formatted").cast("long").alias("formatted_chars"))
