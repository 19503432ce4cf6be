"""Multi-party perspective rotation of conversations, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"
#: Characters of a dialogue that begin in one row. Only longer dialogues go on in further rows.
PART_CHARS = 1 << 20
#: Turn numbers that are summed up together on the way to a message's place, and leading digits of the digests by which the messages of a turn are.
SPAN_TURNS, DIGITS = 4_096, 3


def escaped(text: Column) -> Column:
    """The text with a backslash put in between ``<`` and ``|``, and one more where there are some, so that it holds no mark and the old text can be read from it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def header_name(role: Column) -> Column:
    """A role as it stands in a header: each of ``<``, ``|``, ``>`` and line ends in it is ``_``."""
    return F.regexp_replace(role, r"[<|>\r\n]", "_")


def rotate_perspectives(messages: DataFrame, shared_role: str = "system") -> DataFrame:
    """One row for each message under each perspective of its conversation.

    The participants of a conversation are the distinct roles that speak in it, other than
    ``shared_role`` (context that all see) and null. From the perspective of a participant, their own messages are
    the assistant's, the others are those of users named after their roles, shared ones stay as they are, and messages
    without a role come from a user without a name. ``rendered`` is the message with its header and end mark;
    its characters from mask_start (inclusive) to mask_end (exclusive) are trained on: the text and end
    mark of the perspective's own messages, and nothing, ``0, 0``, of others. Texts and names are escaped, so that none forges a
    header or an end. The rows of a perspective in the order of turn are its dialogue (see ``dialogues``). No conversation meets in one
    task here: participants come from an aggregate that combines before its shuffle, and join back on conv_id.

    Null and empty texts are empty messages, very long ones are rendered whole. Null turns sort first and null conv_ids are one conversation. Repeated rows are
    each rendered; a conversation with only shared messages has no perspective and gives no rows, nor does an
    empty table. digest tells the messages of one turn apart, whoever's perspective it is. Columns other than conv_id, turn, role and text play no part.
    """
    said = messages.select("conv_id", "turn", "role", escaped(F.coalesce("text", F.lit(""))).alias("text"))
    speakers = said.where(F.col("role").isNotNull() & (F.col("role") != shared_role)).select(F.col("conv_id").alias("speaker_conv"), F.col("role").alias("perspective")).distinct()
    rows = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("speaker_conv")))
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    shared = F.coalesce(F.col("role") == shared_role, F.lit(False))
    name = F.when(~own & ~shared, F.col("role"))
    chat_role = F.when(own, "assistant").when(shared, shared_role).otherwise("user")
    header = F.concat(F.lit("<|"), chat_role, F.coalesce(F.concat(F.lit(" name="), header_name(name)), F.lit("")), F.lit("|>\n"))
    rendered = F.concat(header, F.col("text"), F.lit(END))
    return rows.select(
        "conv_id",
        "perspective",
        "turn",
        F.md5(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), "text")).alias("digest"),
        chat_role.alias("chat_role"),
        name.alias("name"),
        rendered.alias("rendered"),
        F.when(own, F.length(header)).otherwise(0).cast("long").alias("mask_start"),
        F.when(own, F.length(rendered)).otherwise(0).cast("long").alias("mask_end"),
    )


def dialogues(rotated: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Rotated messages put together: (conv_id, perspective, part, start, n_messages, rendered, masks).

    A dialogue is the rendered messages of a perspective in the order of turn, null turns first, those of one turn in the order of their digests. It is one row,
    part 0, unless it is longer than ``part_chars`` characters: a message stands in part place / part_chars, place being the dialogue's characters before it, so a part holds that many characters and what its last
    message has beyond them, however many messages, turns or repeats a conversation (one without an id, say) has; a very long message is not cut. start is the place of the part's first
    message. masks are the trained ranges, in characters of the part.

    No conversation meets in one task: repeated messages are counted before they are dealt, places are sums of numbers over spans of turns, then over turns and leading digits of digests,
    then over the messages of one turn that share those digits, and only what begins in one part is gathered.
    """
    size = F.length("rendered").cast("long")
    span = F.coalesce(F.floor(F.col("turn") / SPAN_TURNS), F.lit(-(2**62))).alias("span")
    keyed = rotated.select("conv_id", "perspective", span, "turn", F.substring("digest", 1, DIGITS).alias("leading"), "digest", "rendered", "mask_start", "mask_end")
    bucket = F.struct("conv_id", "perspective", "turn", "leading").alias("bucket")  # never null as a whole, so that it joins by plain equality
    # numbers only
    sizes = keyed.groupBy("conv_id", "perspective", "span", "turn", "leading").agg(F.sum(size).alias("size"))
    spans = sizes.groupBy("conv_id", "perspective", "span").agg(F.sum("size").alias("size"))
    before = lambda *order: F.coalesce(F.sum("size").over(Window.partitionBy("of").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    spans = spans.withColumn("of", F.struct("conv_id", "perspective")).select(F.struct("conv_id", "perspective", "span").alias("of_span"), before("span").alias("base"))
    within = sizes.withColumn("of", F.struct("conv_id", "perspective", "span")).select("of", bucket.alias("of_bucket"), before(F.col("turn").asc_nulls_first(), "leading").alias("at"))
    bases = within.join(spans, F.col("of") == F.col("of_span")).select("of_bucket", (F.col("base") + F.col("at")).alias("base"))
    # messages
    distinct = keyed.groupBy("conv_id", "perspective", "turn", "leading", "digest", "rendered", "mask_start", "mask_end").agg(F.count("*").alias("copies")).withColumn("bucket", bucket)
    own = F.sum(size * F.col("copies")).over(Window.partitionBy("bucket").orderBy("digest", "rendered", "mask_start", "mask_end").rowsBetween(Window.unboundedPreceding, -1))
    placed = distinct.withColumn("own", F.coalesce(own, F.lit(0).cast("long"))).join(bases, F.col("bucket") == F.col("of_bucket"))
    every = placed.select("conv_id", "perspective", "rendered", "mask_start", "mask_end", (F.col("base") + F.col("own")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    every = every.withColumn("place", F.col("first") + F.col("copy") * size)
    message = F.struct("place", "rendered", (F.col("mask_start") + F.col("place")).alias("start"), (F.col("mask_end") + F.col("place")).alias("end"))
    part = F.floor(F.col("place") / part_chars).alias("part")
    parts = every.groupBy("conv_id", "perspective", part).agg(F.array_sort(F.collect_list(message)).alias("m")).withColumn("start", F.col("m")[0]["place"])
    trained = F.transform(F.filter("m", lambda x: x["end"] > x["start"]), lambda x: F.struct((x["start"] - F.col("start")).alias("start"), (x["end"] - F.col("start")).alias("end")))
    return parts.select("conv_id", "perspective", "part", "start", F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda x: x["rendered"]), "").alias("rendered"), trained.alias("masks"))
