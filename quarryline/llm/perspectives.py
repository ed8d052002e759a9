"""Chat formatting: the dialogue as each of its participants would have lived it.

For every participant the dialogue is rendered with that speaker as assistant, the
others as named users, and spans of what is to be learned: the assistant's words and
the mark that ends them. DataFrame functions only.

A conversation is cut into blocks of turns by turn number and these into parts of
part_turns turns, each rendered into one row, so that a conversation of any length is
spread over tasks and no row outgrows memory. Usual conversations are one part;
`whole` puts the parts of the others together.

No text and no name can close its turn or open another: between `<`, any number of
backslashes and `|`, one backslash more is put, which is undone by taking it away. In
names, backslashes and line ends are escaped besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_name(name: Column) -> Column:
    """On one line; \\\\, \\n, \\r and \\| stand for a backslash, a line end, a return and a bar after `<`."""
    out = F.replace(name, F.lit("\\"), F.lit("\\\\"))
    for mark, letter in (("\n", "n"), ("\r", "r")):
        out = F.replace(out, F.lit(mark), F.lit("\\" + letter))
    return F.replace(out, F.lit("<|"), F.lit("<\\|"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", fixed_roles: tuple[str, ...] = ("system",), block_turns: int = 1024, part_turns: int = 256) -> DataFrame:
    """(conv_col, perspective, block, part, n_turns, rendered, trained, n_chars): for each
    conversation and participant, the parts of the dialogue in order of block and part.

    trained lists the spans to learn, start:end in code points of rendered, end
    exclusive, joined by commas. fixed_roles speak in everybody's dialogue as
    themselves and take no perspective; a conversation with no other speaker has one
    row with a null perspective and nothing to learn. A null role is the speaker
    "unknown", a null text is empty, a null conversation is one like any other, null
    turns come last, in a block of their own. Turns of equal number are ordered by
    role and text; they are ranked in one task, which sorts on disk if it must. Texts and
    names are escaped (see above). Other columns are ignored.
    """
    said = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("who"),
        escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
        F.floor(F.col(turn_col) / block_turns).cast("long").alias("block"),
    )
    rank = F.row_number().over(Window.partitionBy("conv", "block").orderBy(F.asc_nulls_last("turn"), "who", "text"))
    parts = (
        said.withColumn("k", rank)
        .withColumn("part", ((F.col("k") - 1) / part_turns).cast("int"))
        .groupBy("conv", "block", "part")  # part_turns rows at most
        .agg(F.sort_array(F.collect_list(F.struct("k", "who", "text"))).alias("turns"))
    )
    fixed = F.col("who").isin(*fixed_roles) if fixed_roles else F.lit(False)
    speakers = said.filter(~fixed).groupBy("conv").agg(F.sort_array(F.collect_set("who")).alias("speakers")).withColumnRenamed("conv", "of")
    views = parts.join(speakers, F.col("conv").eqNullSafe(F.col("of")), "left").select("conv", "block", "part", "turns", F.explode_outer("speakers").alias("me"))

    def mine(x: Column) -> Column:
        return F.coalesce(x["who"] == F.col("me"), F.lit(False))

    def head(x: Column) -> Column:
        as_fixed = x["who"].isin(*fixed_roles) if fixed_roles else F.lit(False)
        return F.concat(F.lit(OPEN), F.when(mine(x), F.lit("assistant")).when(as_fixed, x["who"]).otherwise(F.concat(F.lit("user name="), escaped_name(x["who"]))), F.lit("\n"))

    pieces = F.transform("turns", lambda x: F.struct(mine(x).alias("mine"), head(x).alias("head"), F.concat(x["text"], F.lit(CLOSE)).alias("body")))
    cut = views.select("conv", "block", "part", "me", pieces.alias("p"))
    # Each piece's end, by one pass that adds up lengths.
    ends = F.aggregate("p", F.array().cast("array<long>"), lambda acc, x: F.concat(acc, F.array((F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")) + F.char_length(x["head"]) + F.char_length(x["body"])).cast("long"))))
    spans = F.transform(F.filter(F.zip_with("p", "ends", lambda x, e: F.struct(x["mine"].alias("mine"), (e - F.char_length(x["body"])).alias("a"), (e - 1).alias("b"))), lambda x: x["mine"]), lambda x: F.concat_ws(":", x["a"].cast("string"), x["b"].cast("string")))
    return cut.withColumn("ends", ends).select(
        F.col("conv").alias(conv_col), F.col("me").alias("perspective"), "block", "part", F.size("p").cast("long").alias("n_turns"),
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"])), "").alias("rendered"), F.array_join(spans, ",").alias("trained"),
        F.element_at("ends", -1).alias("n_chars"),
    )


def whole(parts: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, perspective, n_turns, rendered, trained, n_chars): the parts that rotate
    made put together, a row for each conversation and participant. A rendering must fit
    a row, so longer dialogues than some hundred megabytes are for their parts only."""
    order = F.struct(F.col("block").isNull().alias("last"), "block", "part", "n_turns", "rendered", "trained", "n_chars")
    rows = parts.groupBy(conv_col, "perspective").agg(F.sort_array(F.collect_list(order)).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def shifted(acc: Column, x: Column) -> Column:
        moved = F.transform(F.filter(F.split(x["trained"], ","), lambda s: s != ""), lambda s: F.array_join(F.transform(F.split(s, ":"), lambda n: (n.cast("long") + acc["at"]).cast("string")), ":"))
        return F.struct((acc["at"] + x["n_chars"]).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    spans = F.aggregate("p", start, shifted, lambda acc: F.array_join(acc["spans"], ","))
    total = lambda name: F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x[name]).alias(name)
    return rows.select(conv_col, "perspective", total("n_turns"), F.array_join(F.transform("p", lambda x: x["rendered"]), "").alias("rendered"), spans.alias("trained"), total("n_chars"))
