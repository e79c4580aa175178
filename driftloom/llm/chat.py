"""Quotation linking: nested quotes joined to the messages they come from; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, small
from .mixing import ranked

#: A line's quote marks: one or more ">", each after at most three blanks.
MARKS = r"^(?:[ \t]{0,3}>)+"
#: Every line of so many characters is matched.
LEAST_LINE = 1


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n", -1)


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[ \t]", ""))


def normalised(passage: Column) -> Column:
    """Lower case, each run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(passage), r"[\s ]+", " "))


def _plain(line: Column) -> Column:
    return F.regexp_replace(line, MARKS + r"[ \t]?", "")


def parsed(messages: DataFrame) -> DataFrame:
    """messages with `body` (text without quotes) and `quotes`, an array of (level, passage).

    A passage is a run of lines of one level. Work on a text is linear in its length and stays in its row.
    """
    with_lines = messages.withColumn("_lines", _lines(F.col("text")))
    canon = F.transform("_lines", lambda x: F.when(_level(x) > 0, F.concat(F.repeat(F.lit(">"), _level(x)), F.lit(" "), _plain(x))).otherwise(F.concat(F.lit("|"), x)))
    with_lines = with_lines.withColumn("_text", F.array_join(canon, "\n"))
    # possessive loops run in constant stack, however long the passage
    passages = F.regexp_extract_all("_text", F.lit(r"(?m)^(>+) [^\n]*+(?:\n\1 [^\n]*+)*+"), F.lit(0))
    quotes = F.transform(passages, lambda p: F.struct(F.length(F.regexp_extract(p, "^>+", 0)).alias("level"), F.regexp_replace(p, r"(?m)^>+ ", "").alias("passage")))
    body = F.regexp_replace(F.array_join(F.transform(F.filter("_lines", lambda x: _level(x) == 0), lambda x: x), "\n"), r"^\s+|\s+$", "")
    return with_lines.withColumns({"quotes": quotes, "body": F.when(F.col("text").isNull(), F.lit(None)).otherwise(body)}).drop("_lines", "_text")


def _said(passage: Column) -> Column:
    """Hashes of the lines that are not blank, in order."""
    return F.transform(F.filter(F.transform(F.split(passage, "\n"), normalised), lambda x: x != ""), lambda x: F.xxhash64(x))


def windows(df: DataFrame, longest: int) -> tuple[DataFrame, list[str]]:
    """df with columns _w0, _w1, ...: item i of _wj is a hash of the 2**j lines of `_said` from i on.

    A run of k lines is told by its first and its last 2**j lines, 2**j being the greatest power up to k, so that a
    run costs the same however long it is.
    """
    df, names, size = df.withColumn("_w0", F.col("_said")), ["_w0"], 1
    while 2 * size <= longest:
        old, step = names[-1], F.lit(size)
        made = F.transform(F.col(old), lambda x, i: F.xxhash64(x, F.get(old, i + step)))
        df = df.withColumn(f"_w{len(names)}", F.slice(made, F.lit(1), F.greatest(F.size(old) - step, F.lit(0))))
        names.append(f"_w{len(names)}")
        size *= 2
    return df, names


def _run(names: list[str], start: Column, k: Column) -> Column:
    """Hash of the k lines from `start` on, k being at least 2."""
    out = F.lit(None).cast("long")
    for j, name in enumerate(names):
        whole = F.xxhash64(k, F.get(name, start), F.get(name, start + k - F.lit(1 << j)))
        out = F.when(k >= 1 << j, whole).otherwise(out) if j else F.when(k >= 1, whole)
    return out


def runs_of_lines(read: DataFrame, spoken: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The quoted passages of several lines, (conv_id, turn, row, nth, level, hash), and such runs in bodies, (conv_id, turn, hash).

    A body gives its runs of the lengths that its own conversation quotes; blank lines between lines don't count.
    """
    asked = read.select("conv_id", "turn", "row", F.posexplode("quotes").alias("nth", "q")).select("conv_id", "turn", "row", "nth", "q.level", _said(F.col("q.passage")).alias("_said"))
    asked = settle(asked.withColumn("k", F.size("_said")).filter("k > 1"), "runs")
    longest = asked.agg(F.max("k")).first()[0]
    if longest is None:
        return None
    asked, names = windows(asked, longest)
    asked = asked.select("conv_id", "turn", "row", "nth", "level", "k", _run(names, F.lit(0), F.col("k")).alias("hash"))
    lengths = settle(asked.select(F.col("conv_id").alias("_c"), "k").distinct(), "lengths")
    bodies, names = windows(spoken.select("conv_id", "turn", _said(F.coalesce("body", F.lit(""))).alias("_said")).filter(F.size("_said") > 1), longest)
    bodies = bodies.join(small(lengths, lengths.count()), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.size("_said") >= F.col("k")))
    starts = F.sequence(F.lit(0), F.size("_said") - F.col("k"))
    said = bodies.select("conv_id", "turn", F.explode(F.transform(starts, lambda i: _run(names, i, F.col("k")))).alias("hash"))
    return asked.drop("k"), said


def _hashes(passage: Column) -> Column:
    """Hash of the whole passage first, then of its paragraphs and its lines."""
    parts = F.concat(F.array(passage), F.split(passage, r"\n[ \t]*\n"), F.filter(F.split(passage, "\n"), lambda x: F.length(x) >= LEAST_LINE))
    kept = F.filter(F.transform(parts, normalised), lambda x: x != "")
    return F.array_distinct(F.transform(kept, lambda x: F.xxhash64(x)))


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, n_linked, parent_turn, root_turn, depth, position) of every message.

    Quoted passages are hashed after normalising and joined to the first message of the conversation that says them
    (in its body, not in a quote), if it comes before: as all of it, a paragraph, a line of any length or a run of
    consecutive lines. A message replies to the latest such origin of its outermost
    quotes, a whole passage counting before a line; without one it starts a thread. text has no quotes. position
    orders a conversation thread by thread, each reply after the message it answers.

    Origins are one row for each hash and conversation, made by a minimum combined before the shuffle; a long
    conversation is neither gathered nor sorted in one task. Threads are followed by pointer jumping, in as many
    rounds as the logarithm of the deepest reply chain.

    A null text stays null and quotes nothing; null ids are a conversation of their own; rows repeated in conv_id and
    turn share their thread and take places one after another. An empty table gives no rows; other columns are ignored.
    """
    read = parsed(messages.select("conv_id", "turn", "role", "text"))
    said = read.select("conv_id", "turn", F.explode(_hashes(F.coalesce("body", F.lit("")))).alias("hash"))
    marked = read.withColumn("row", F.xxhash64("role", "text"))
    quoted = marked.filter(F.size("quotes") > 0).select("conv_id", "turn", "row", F.posexplode("quotes").alias("nth", "q"))
    quoted = quoted.select("conv_id", "turn", "row", "nth", "q.level", F.posexplode(_hashes(F.col("q.passage"))).alias("part", "hash"))
    runs = runs_of_lines(marked.filter(F.size("quotes") > 0), read)
    if runs is not None:
        quoted = quoted.unionByName(runs[0].withColumn("part", F.lit(0)))
        said = said.unionByName(runs[1])
    quoted = settle(quoted, "quotes")
    links = marked.select("conv_id", "turn", "row").limit(0).selectExpr("*", "0L n_linked", "cast(null as bigint) parent_turn")
    if not quoted.isEmpty():
        asked = quoted.select(F.col("conv_id").alias("_c"), F.col("hash").alias("_h")).distinct()
        n = asked.count()
        origins = said.join(small(asked, n), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h")), "left_semi")
        origins = origins.groupBy(F.col("conv_id").alias("_c"), F.col("hash").alias("_h")).agg(F.min("turn").alias("origin"))
        met = quoted.join(small(origins, n), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h"))).filter("origin < turn")
        # by passage: its best origin; by message: the best of the least level
        by_passage = met.groupBy("conv_id", "turn", "row", "nth").agg(F.min(F.struct("level", F.least("part", F.lit(1)).alias("part"), (-F.col("origin")).alias("back"))).alias("best"))
        links = by_passage.groupBy("conv_id", "turn", "row").agg(F.count("*").alias("n_linked"), (-F.min("best").getField("back")).alias("parent_turn"))
        links = settle(links, "links")
    roots = threads(links)
    left = marked.select("conv_id", "turn", "role", F.col("body").alias("text"), F.size("quotes").cast("long").alias("n_quotes"), "row")
    keyed = links.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("row").alias("_r"), "n_linked", "parent_turn").dropDuplicates(["_c", "_t", "_r"])
    out = left.join(keyed, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("row") == F.col("_r")), "left").drop("_c", "_t", "_r")
    out = out.join(roots.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "root_turn", "depth"), F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")), "left").drop("_c", "_t")
    out = out.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"), "root_turn": F.coalesce("root_turn", "turn"), "depth": F.coalesce("depth", F.lit(0)).cast("long")})
    placed = ranked(out, F.struct("conv_id", "root_turn", "turn", "row"))
    first = placed.groupBy(F.col("conv_id").alias("_c")).agg(F.min("rank").alias("_first"))
    placed = placed.join(first, F.col("conv_id").eqNullSafe(F.col("_c")))
    return placed.select("conv_id", "turn", "role", "text", "n_quotes", "n_linked", "parent_turn", "root_turn", "depth", (F.col("rank") - F.col("_first")).alias("position"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) of every message that replies to another, by pointer jumping."""
    state = links.groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("root_turn")).withColumn("depth", F.lit(1).cast("long"))
    state = settle(state, "threads")
    while True:
        up = state.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("root_turn").alias("_up"), F.col("depth").alias("_more"))
        next_ = state.join(up, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("root_turn") == F.col("_t")), "left")
        moved = next_.filter("_up is not null").limit(1).count()
        if not moved:
            return state
        state = settle(next_.select("conv_id", "turn", F.coalesce("_up", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")), "threads")
