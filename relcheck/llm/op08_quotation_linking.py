"""Chat formatting by quotation linking, with DataFrame operations only.

A line that begins with `>` signs (blanks and tabs among them allowed) is quoted,
at the level of their number. A passage is a run of quoted lines of one level in a
message; blank quoted lines cut it into paragraphs. Passages, paragraphs and lines
are normalised (quote signs off, all white space to single spaces, so that it is
no matter where lines were wrapped, lower case) and hashed.

The original of a passage is the first earlier turn of the same conversation that
holds it as a whole in its own text: as a paragraph, as all that stands between
its quotes or, for at least `LEAST` words or two lines, as words in a row. A
passage that none holds is looked up by paragraphs in the same way, and what is
left by lines; only what the conversation doesn't have is looked for anywhere, as
a whole, by paragraphs, by lines. Each line then votes for the original found for
it, and the passage is linked to the message with most votes. A message answers the
original, in its own conversation, of its passages at the shallowest linked level.

Reply order puts each message behind the one it answers: an answer stands in the
place of the message at the root of its thread, then come the depth in the thread
and the turn. Roots are found by doubling the distance looked back in each round.
All joins are on keys that aggregation has made unique on one side, and positions
are counted in two levels: in ranges of the whole order, and over the ranges that a
conversation has rows in. So neither a common line nor a long conversation or thread
is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import forget, stored

#: Words that are no chance find within a text; also those by which places in texts are found.
LEAST = 5


def _depth(line: Column) -> Column:
    mark = F.regexp_extract(line, r"^[ \t>]*", 0)
    return F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))


def _folded(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _normal(line: Column) -> Column:
    return _folded(F.regexp_replace(line, r"^[ \t]*>[ \t>]*", ""))


def quoted_passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, own, passage, part, level, pos, words, h): the quoted lines of messages(conv_id, turn, text) that aren't blank."""
    quoting = messages.filter(F.col("text").rlike(r"(?m)^[ \t]*>"))
    lines = quoting.select("conv_id", "turn", "text", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("conv_id", "turn", F.xxhash64("text").alias("own"), "pos", _depth(F.col("line")).alias("level"), _normal(F.col("line")).alias("words"))
    message = Window.partitionBy("conv_id", "turn", "own").orderBy("pos")
    lines = lines.withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(message), F.lit(-1))).cast("int"))
    lines = lines.withColumn("passage", F.sum("new").over(message)).withColumn("part", F.sum((F.col("words") == "").cast("int")).over(message))
    return lines.filter("level > 0 and words <> ''").select("conv_id", "turn", "own", "passage", "part", "level", "pos", "words", F.xxhash64("words").alias("h"))


def _runs(quoted: DataFrame, *key: str) -> DataFrame:
    """(conv_id, turn, own, *key, h, n, start, found): each passage or paragraph; found is whether to look for its n words in a row."""
    lines = F.array_sort(F.collect_set(F.struct("pos", "words")))  # a repeated message is one
    runs = quoted.groupBy("conv_id", "turn", "own", *key).agg(lines.alias("lines"))
    runs = runs.withColumn("all", F.split(F.array_join(F.col("lines.words"), " "), " ")).withColumn("n", F.size("all"))
    found = (F.col("n") >= LEAST) | (F.size("lines") > 1)
    return runs.select("conv_id", "turn", "own", *key, F.xxhash64("all").alias("h"), "n", F.xxhash64(F.slice("all", 1, LEAST)).alias("start"), found.alias("found"))


def _in_a_row(blocks: DataFrame, runs: DataFrame) -> DataFrame:
    """(h, conv_id, from_turn) for the runs that are words in a row of blocks(conv_id, turn, block) of their conversation."""
    wanted = stored(runs.filter("found").select("conv_id", "start", "n").distinct(), "wanted")
    blocks = blocks.join(wanted.select("conv_id").distinct(), "conv_id", "left_semi")
    blocks = blocks.select("conv_id", "turn", F.xxhash64("block").alias("b"), F.split(_folded(F.col("block")), " ").alias("all")).dropDuplicates(["conv_id", "turn", "b"])
    places = None
    for k in range(2, LEAST + 1):
        starts = F.transform(F.sequence(F.lit(1), F.size("all") - (k - 1)), lambda i: F.xxhash64(F.slice("all", i, k)))  # noqa: B023
        some = blocks.filter(F.size("all") >= k).select("conv_id", "turn", "b", F.posexplode(starts).alias("i", "start"))
        some = some.join(wanted.filter(F.col("n") == k if k < LEAST else F.col("n") >= k), ["conv_id", "start"])
        places = some if places is None else places.union(some)
    placed = places.select("conv_id", "turn", "b", "i", "n").join(blocks, ["conv_id", "turn", "b"]).filter(F.col("i") + F.col("n") <= F.size("all"))
    return placed.groupBy(F.xxhash64(F.slice("all", F.col("i") + 1, F.col("n"))).alias("h"), "conv_id").agg(F.min("turn").alias("from_turn"))


def _whole(messages: DataFrame, runs: DataFrame, *key: str) -> DataFrame:
    """(conv_id, turn, own, *key, here, there) for each run: the first earlier turn that holds it, the first (conv_id, from_turn) elsewhere."""
    blocks = messages.select("conv_id", "turn", F.explode(F.split("text", r"(?md)^[ \t]*>.*$")).alias("block")).filter(r"block rlike '\\S'")
    pieces = F.array_distinct(F.transform(F.concat(F.array("block"), F.split("block", r"\n\s*\n")), lambda x: F.xxhash64(F.split(_folded(x), " "))))
    own = blocks.select("conv_id", "turn", F.explode(pieces).alias("h")).join(runs.select("h").distinct(), "h", "left_semi")
    first = stored(own.groupBy("h", "conv_id").agg(F.min("turn").alias("from_turn")), "wholes")
    anywhere = first.groupBy("h").agg(F.min(F.struct("conv_id", "from_turn")).alias("any"))
    near = first.union(_in_a_row(blocks, runs)).groupBy("h", "conv_id").agg(F.min("from_turn").alias("from_turn"))
    found = runs.join(near, ["h", "conv_id"], "left").join(anywhere, "h", "left")
    here, there = F.when(F.col("from_turn") < F.col("turn"), F.col("from_turn")), F.when(F.col("any.conv_id") != F.col("conv_id"), F.col("any"))
    return found.select("conv_id", "turn", "own", *key, here.alias("here"), there.alias("there"))


def passage_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, level, from_conv, from_turn, n_lines) for each linked passage."""
    quoted = stored(quoted_passages(messages), "quoted")
    own = messages.select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line")).filter(_depth(F.col("line")) == 0)
    own = own.select("conv_id", "turn", _normal(F.col("line")).alias("words")).filter("words <> ''").select("conv_id", "turn", F.xxhash64("words").alias("h"))
    own = own.join(quoted.select("h").distinct(), "h", "left_semi")
    first = stored(own.groupBy("h", "conv_id").agg(F.min("turn").alias("from_turn")), "originals")
    anywhere = first.groupBy("h").agg(F.min(F.struct("conv_id", "from_turn")).alias("any"))
    near = quoted.join(first, ["h", "conv_id"], "left").join(anywhere, "h", "left")
    near = near.withColumn("here", F.when(F.col("from_turn") < F.col("turn"), F.col("from_turn"))).withColumn("there", F.when(F.col("any.conv_id") != F.col("conv_id"), F.col("any")))
    for key in (["passage", "part"], ["passage"]):
        whole = _whole(messages, stored(_runs(quoted, *key), "runs"), *key).withColumnsRenamed({"here": "whole_here", "there": "whole_there"})
        near = near.join(whole, ["conv_id", "turn", "own", *key], "left")
        near = near.withColumn("here", F.coalesce("whole_here", "here")).withColumn("there", F.coalesce("whole_there", "there")).drop("whole_here", "whole_there")
    here = F.col("here").isNotNull()
    near = near.select("conv_id", "turn", "own", "passage", "level", F.when(here, F.col("conv_id")).otherwise(F.col("there.conv_id")).alias("from_conv"), F.when(here, F.col("here")).otherwise(F.col("there.from_turn")).alias("from_turn"))
    votes = near.filter("from_conv is not null").groupBy("conv_id", "turn", "own", "passage", "level", "from_conv", "from_turn").agg(F.count("*").alias("n_lines"))
    # Most lines first; of equals one of the same conversation, then the earliest.
    rank = F.struct((-F.col("n_lines")).alias("fewer"), (F.col("from_conv") != F.col("conv_id")).alias("elsewhere"), "from_conv", "from_turn", "n_lines")
    best = votes.groupBy("conv_id", "turn", "own", "passage", "level").agg(F.min(rank).alias("b"))
    return best.select("conv_id", "turn", "passage", "level", "b.from_conv", "b.from_turn", "b.n_lines")


def _roots(answers: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) of answers(conv_id, turn, parent_turn)."""
    at = stored(answers.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")), "roots")
    while True:
        up = at.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        if at.join(up, ["conv_id", "root_turn"], "left_semi").isEmpty():
            return at
        joined = at.join(up, ["conv_id", "root_turn"], "left")
        after = stored(joined.select("conv_id", "turn", F.coalesce("next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "roots")
        forget(at)
        at = after


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, parent_turn, depth, position, formatted), a row for each message.

    conversations has conv_id long, turn long, role string and text string. body is
    the text without quoted lines, and without blank lines at its ends if any line
    went; a null text is empty. parent_turn is the turn answered, null if none is
    linked; depth is the number of answers up to the thread's root; position counts
    a conversation's messages in reply order from 0. formatted is role and body in
    chat form. Repeated (conv_id, turn) are one message as far as links go, and have
    positions of their own. Messages without conv_id or turn link to nothing; those
    without conv_id are ordered together, those without turn come first. An empty
    table gives no rows; texts may be of any length; other columns aren't looked at.
    """
    messages = conversations.select(*[conversations[c] for c in ("conv_id", "turn", "role")], F.coalesce(conversations["text"], F.lit("")).alias("text"))
    links = passage_links(messages.filter("conv_id is not null and turn is not null").select("conv_id", "turn", "text"))
    links = links.filter("from_conv = conv_id")
    # The shallowest level, then most lines, then the earliest original.
    answers = links.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("n_lines")).alias("n"), "from_turn")).alias("b")).select("conv_id", "turn", F.col("b.from_turn").alias("parent_turn"))
    answers = stored(answers, "answers")
    threads = answers.join(_roots(answers), ["conv_id", "turn"])

    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: _depth(x) == 0), "\n")
    quoting = F.col("text").rlike(r"(?m)^[ \t]*>")
    body = F.when(quoting, F.regexp_replace(kept, r"^\s*\n|\n\s*$", "")).otherwise(F.col("text"))
    rows = messages.select("conv_id", "turn", "role", body.alias("body")).join(threads, ["conv_id", "turn"], "left")
    rows = rows.withColumn("root", F.coalesce("root_turn", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    order = ["conv_id", "root", "depth", "turn", "role"]
    # Bodies only tell rows apart that are equal in all else; their beginnings do to deal them out.
    dealt = rows.withColumn("_begin", F.substring("body", 1, 64)).repartitionByRange(*order, "_begin").sortWithinPartitions(*order, "body").drop("_begin")
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("at", 33))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("conv_id", "part").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    parts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "least", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    dealt = dealt.join(parts, dealt["conv_id"].eqNullSafe(parts["c"]) & (dealt["part"] == parts["p"]))
    text = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"))
    return dealt.select("conv_id", "turn", "role", "body", "parent_turn", "depth", (F.col("before") + F.col("at") - F.col("least")).alias("position"), text.alias("formatted"))
