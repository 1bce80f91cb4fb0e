"""Chat formatting by quotation linking.

Lines that begin with '>' marks are quotes, nested as deep as they have marks.
Runs of lines at one depth are quoted passages.  A passage is known by its units, all normalised (marks
off, white space squeezed, lower case) and hashed: the whole, its paragraphs and its lines, and
the windows of ``GRAM`` words of the whole, so that quotes which a mailer wrapped anew or
someone cut are found too.  Units are joined with those of messages' own words in the same
conversation.  The original of a unit is the earliest message that holds it; of one shorter than
``SHORT`` characters, which many may hold, the nearest earlier one.  Windows count for an
original only if it holds half of the passage's windows at least.  A quoting message replies to the
earlier original that its outermost linked quotes cover most (by characters; of equal ones the latest).

Replies form threads: ``thread`` is the turn a chain of replies began with and ``depth`` its length,
found by pointer doubling.  ``position`` is the place in reply order - conversations by
id, threads by their first turn, each reply after what it answers, branch by branch.  It comes from
ranking the tour around each thread (into a message, through its replies, out of it) by pointer
jumping, so a row carries one number and no path, however deep a thread is.  Quotes and
attribution lines are removed from ``body``.

A null text counts as empty, with an empty body; a message without quotes or with
quotes found nowhere begins a thread.  Repeated rows stay, each with the same link:
links are one per (conv_id, turn).  Rows without a conv_id or turn are not linked.  Columns other than the
four that are named are not returned.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MARKS = r"^((?:[ \t]*>)+)"
ATTRIBUTION = r"(?i)^\s*(?:on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb\b.*|el\b.*\bescribió)\s*:\s*$"
SHORT = 8  # normalised units below it ("ok", "yes") mean the nearest earlier holder
GRAM = 5
BLOCK = 256


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\s>]+", " ")))


def parsed(text: Column) -> tuple[Column, Column]:
    """(lines, depths): each line without its marks, and how many marks it had."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", ""), "\n")
    depths = F.transform(lines, lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), r"[^>]", "")))
    bare = F.transform(lines, lambda x: F.regexp_replace(x, MARKS + r"[ \t]?", ""))
    return bare, depths


def with_quotes(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with ``body`` (own lines) and ``quotes``: (depth, passage, lines) of each quoted run."""
    bare, depths = parsed(F.col(text))
    staged = messages.withColumn("__lines", bare).withColumn("__depths", depths).withColumn("__n", F.size("__lines"))
    own = F.filter(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: (F.get("__depths", i) == 0) & ~(
        (F.coalesce(F.get("__depths", i + 1), F.lit(0)) > 0) & F.get("__lines", i).rlike(ATTRIBUTION)))
    starts = F.filter(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: (i == 0) | (F.get("__depths", i) != F.get("__depths", i - 1)))
    staged = staged.withColumn("__starts", F.when(F.array_max("__depths") > 0, starts).otherwise(F.array().cast("array<int>")))
    runs = F.transform("__starts", lambda s, k: F.struct(
        F.get("__depths", s).alias("depth"),
        F.slice("__lines", s + 1, F.coalesce(F.get("__starts", k + 1), F.col("__n")) - s).alias("lines")))
    return (staged.withColumn("body", F.trim(F.array_join(F.transform(own, lambda i: F.get("__lines", i)), "\n")))
            .withColumn("quotes", F.filter(runs, lambda r: r["depth"] > 0))
            .drop("__lines", "__depths", "__n", "__starts"))


def units(lines: Column) -> Column:
    """array<(hash, weight, gram)> of a passage's lines, each unit once: whole, paragraphs, lines and windows of words."""
    blank = F.transform(lines, lambda x: F.when(F.trim(F.regexp_replace(x, r"[\s>]+", " ")) == "", F.lit("\0")).otherwise(x))
    paragraphs = F.split(F.array_join(blank, "\n"), "(?:\n?\0\n?)+")
    exact = F.array_distinct(F.transform(F.concat(F.array(F.array_join(lines, " ")), paragraphs, lines), normalised))
    exact = F.transform(F.filter(exact, lambda u: u != ""), lambda u: F.struct(
        F.md5(u.cast("binary")).alias("hash"), F.length(u).alias("weight"), F.lit(False).alias("gram")))
    words = F.split(normalised(F.array_join(lines, " ")), " ")
    windows = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) >= GRAM, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(w) - (GRAM - 1)), lambda i: F.array_join(F.slice(w, i, GRAM), " ")))).otherwise(F.slice(w, 1, 0))), 0)
    return F.concat(exact, F.transform(windows, lambda u: F.struct(
        F.md5(F.concat(F.lit("gram "), u).cast("binary")).alias("hash"), F.floor(F.length(u) / GRAM).cast("int").alias("weight"), F.lit(True).alias("gram"))))


def beside(rows: DataFrame, group: list[str], order: str, later: bool) -> DataFrame:
    """Different (group, order) with ``beside``: the next later, or nearest earlier, value of the group.

    In blocks of ``BLOCK`` values and over the blocks, so that no task sorts one large group.
    """
    block = F.floor(F.col(order) / BLOCK)
    one = rows.select(*group, order).distinct().withColumn("__b", block)
    inside, over = Window.partitionBy(*group, "__b").orderBy(order), Window.partitionBy(*group).orderBy("__b")
    edge = F.min(order) if later else F.max(order)
    step = F.lead if later else F.lag
    edges = one.groupBy(*group, "__b").agg(edge.alias("__edge"))
    edges = edges.withColumn("__over", step("__edge").over(over)).drop("__edge")
    near = one.withColumn("__in", step(order).over(inside))
    return near.join(edges, [*group, "__b"]).select(*group, order, F.coalesce("__in", "__over").alias("beside"))


def links(parsed_messages: DataFrame) -> DataFrame:
    """(conv_id, turn, depth, reply_to, weight): the original each depth of quotes covers most."""
    keyed = parsed_messages.where("conv_id is not null and turn is not null")
    quoting = keyed.where(F.size("quotes") > 0)
    quoted = quoting.select("conv_id", "turn", F.explode("quotes").alias("q")).select(
        "conv_id", "turn", F.col("q.depth").alias("depth"), F.explode(units(F.col("q.lines"))).alias("u"))
    quoted = quoted.select("conv_id", "turn", "depth", "u.*").distinct()
    # Only conversations that quote need an index; the earliest holder of a hash is one row.
    held = keyed.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    held = held.select("conv_id", "turn", F.explode(units(F.split("body", "\n"))).alias("u")).select("conv_id", "turn", "u.*")
    is_short = (F.col("weight") < SHORT) & ~F.col("gram")
    original = held.where(~is_short).groupBy("conv_id", "hash").agg(F.min("turn").alias("reply_to"))
    long = quoted.where(~is_short).join(original, ["conv_id", "hash"]).where("reply_to < turn")
    # Short units: quoting turns among the holding ones, each with the nearest holder before it.
    places = held.where(is_short).select("conv_id", "hash", (F.col("turn") * 2 + 1).alias("at")).union(
        quoted.where(is_short).select("conv_id", "hash", (F.col("turn") * 2).alias("at")))
    holders = held.where(is_short).select("conv_id", "hash", (F.col("turn") * 2 + 1).alias("at")).distinct()
    near = nearest_before(places, holders)
    short = quoted.where(is_short).withColumn("at", F.col("turn") * 2).join(near, ["conv_id", "hash", "at"]).select(
        *long.columns[:2], "turn", "depth", "weight", "gram", "reply_to")
    met = long.unionByName(short)
    whole = quoted.where("gram").groupBy("conv_id", "turn", "depth").agg(F.count("*").alias("n"))
    covered = met.groupBy("conv_id", "turn", "depth", "reply_to").agg(
        F.sum(F.when(~F.col("gram"), F.col("weight")).otherwise(0)).alias("exact"), F.sum(F.when(F.col("gram"), F.col("weight")).otherwise(0)).alias("loose"),
        F.count_if("gram").alias("grams"))
    covered = covered.join(whole, ["conv_id", "turn", "depth"], "left").withColumn(
        "weight", F.col("exact") + F.when(2 * F.col("grams") >= F.col("n"), F.col("loose")).otherwise(0)).where("weight > 0")
    return covered.groupBy("conv_id", "turn", "depth").agg(
        F.max_by("reply_to", F.struct("weight", "reply_to")).alias("reply_to"), F.max("weight").alias("weight"))


def nearest_before(places: DataFrame, holders: DataFrame) -> DataFrame:
    """(conv_id, hash, at, reply_to): the turn of the last holder before each even place."""
    marked = places.distinct().withColumn("__b", F.floor(F.col("at") / BLOCK)).withColumn("__h", F.when(F.col("at") % 2 != 0, F.col("at")))
    group = ["conv_id", "hash"]
    inside = Window.partitionBy(*group, "__b").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    edges = marked.groupBy(*group, "__b").agg(F.max("__h").alias("__edge")).withColumn("__over", F.max("__edge").over(over)).drop("__edge")
    near = marked.withColumn("__in", F.max("__h").over(inside)).where("at % 2 = 0").join(edges, [*group, "__b"])
    found = near.withColumn("__at", F.coalesce("__in", "__over")).where("__at is not null")
    return found.select(*group, "at", F.floor(F.col("__at") / 2).cast("long").alias("reply_to"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, thread, depth) of every linked message, by pointer doubling."""
    state = written(replies.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "chat-threads")
    while True:
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("__up"), F.col("depth").alias("__more"))
        step = state.join(up, ["conv_id", "thread"], "left")
        moved = written(step.select("conv_id", "turn", "reply_to", F.coalesce("__up", "thread").alias("thread"),
                                    (F.col("depth") + F.coalesce("__more", F.lit(0))).alias("depth"), F.col("__up").isNotNull().alias("__moved")), "chat-threads")
        state = moved.drop("__moved")
        if moved.where("__moved").isEmpty():
            return state


def tour_ranks(placed: DataFrame) -> DataFrame:
    """(conv_id, turn, left): how many messages of its thread a message and those after it in reply order are.

    Each message has an arc into it (side 0) and one out of it (side 1); an arc points at the
    next of the tour.  Pointers jump until all have passed the end, counting the arcs into messages.
    """
    roots = placed.select("conv_id", F.col("thread").alias("turn")).distinct()
    first = placed.groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    sibling = beside(placed, ["conv_id", "reply_to"], "turn", later=True).withColumnRenamed("beside", "sibling")
    nodes = placed.select("conv_id", "turn", "reply_to").unionByName(roots.withColumn("reply_to", F.lit(None).cast("long")))
    nodes = nodes.join(first, ["conv_id", "turn"], "left").join(sibling.drop("reply_to"), ["conv_id", "turn"], "left")
    into = nodes.select("conv_id", "turn", F.lit(0).alias("side"), F.coalesce("child", "turn").alias("to"),
                        F.when(F.col("child").isNotNull(), 0).otherwise(1).alias("to_side"), F.lit(1).cast("long").alias("left"))
    out = nodes.select("conv_id", "turn", F.lit(1).alias("side"), F.coalesce("sibling", "reply_to").alias("to"),
                       F.when(F.col("sibling").isNotNull(), 0).otherwise(1).alias("to_side"), F.lit(0).cast("long").alias("left"))
    state = written(into.unionByName(out), "chat-tour")
    while not state.where("to is not null").isEmpty():
        ahead = state.select("conv_id", F.col("turn").alias("to"), F.col("side").alias("to_side"),
                             F.col("to").alias("__to"), F.col("to_side").alias("__side"), F.col("left").alias("__left"))
        moved = state.where("to is not null").join(ahead, ["conv_id", "to", "to_side"]).select(
            "conv_id", "turn", "side", F.col("__to").alias("to"), F.col("__side").alias("to_side"), (F.col("left") + F.col("__left")).alias("left"))
        state = written(moved.unionByName(state.where("to is null")), "chat-tour")
    return state.where("side = 0").select("conv_id", "turn", "left")


def with_position(rows: DataFrame, order: list, name: str = "position") -> DataFrame:
    """``rows`` with their dense place in an order: sorted in ranges, numbered in each, ranges added up."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ordered = written(ordered, "chat-ordered")
    sizes = {r.p: r.n for r in ordered.groupBy(F.shiftright("__id", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    before, at = [], 0
    for p in sorted(sizes):
        before.append((p, at))
        at += sizes[p]
    starts = rows.sparkSession.createDataFrame(before, "__p long, __before long")
    placed = ordered.withColumn("__p", F.shiftright("__id", 33)).join(F.broadcast(starts), "__p")
    return placed.select(*rows.columns, (F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def reply_ordered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """One row per message: ids, role, body, quote counts, ``reply_to``, ``thread``, ``depth`` and ``position`` in reply order."""
    own = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    messages = written(with_quotes(own).drop("text"), "chat-messages")
    out = messages.select("conv_id", "turn", "role", "body", F.size("quotes").cast("long").alias("n_quotes"),
                          F.coalesce(F.array_max(F.transform("quotes", lambda q: q["depth"])), F.lit(0)).cast("long").alias("quote_depth"))
    found = written(links(messages), "chat-links")
    outermost = found.groupBy("conv_id", "turn").agg(F.min_by("reply_to", "depth").alias("reply_to"))
    placed = threads(outermost)
    out = out.join(placed, ["conv_id", "turn"], "left").join(tour_ranks(placed), ["conv_id", "turn"], "left")
    out = out.select("conv_id", "turn", "role", "body", "n_quotes", "quote_depth", "reply_to",
                     F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "left")
    # By thread and place too, so that one large conversation is no one task.
    order = [F.col("conv_id"), F.col("thread"), F.col("left").desc(), F.col("turn"), F.col("role"), F.col("body")]
    return with_position(out, order).drop("left")
