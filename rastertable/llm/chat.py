r"""Operator 7: chat formatting by quotation linking, in DataFrame operations only.

A line's quote level is the number of '>' that begin it (single spaces between them are allowed). Passages are lines without their
marks, in lower case and with runs of white space as one space; their hashes join a quoted passage to the latest earlier
message of its conversation that has it unquoted. There are four kinds, and a message is linked by the first kind of which one is found: lines of
``LEAST_CHARS`` characters or more; adjacent lines of one level joined (a quotation that is wrapped at another width); sentences of such
joined lines with as many characters (a quotation of a part of a line or paragraph); shorter lines. A message replies to the
message that has most of its passages quoted at the lowest level that is found at all, the later one if equal.

A quotation that is cut within a sentence, or shortened by "[...]", has none of these. Messages that no kind links are asked again by
shingles of ``SHINGLE`` words of their joined lines (in scripts without spaces, of as many characters), each joined to the latest earlier message that
has it unquoted; shingles with a mark of omission do not count. The parent is the message that has most of the shingles of the lowest level at
which some message has at least half. Cuts of fewer words are not found.

A conversation's order is thread by thread (by first message), in a thread by depth of reply, then by turn; a message without
a found quotation begins a thread, so a conversation without quotations keeps its turns. Quoted lines, and a line that ends
in "wrote:" just before one, are left out. Messages are formatted one by one and joined in segments of ``SEGMENT`` messages.

Null conv_ids are one conversation, null turns come first, null roles are "user", null texts are empty. Equal turns are ordered by role and
text; equal rows are kept. A message never links to its own turn or a later one. Other columns are not read; an empty table gives no
rows. Sums and ranks within a conversation run over ranges or stretches, so no task holds a conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertable.llm.shared import written

LEAST_CHARS = 12
#: Messages of a conversation that one row of the result joins.
SEGMENT = 32
#: Turns of a stretch, within which the latest earlier message is searched at once.
STRETCH = 256
#: Words of a shingle, by which cut quotations are linked.
SHINGLE = 5
_MARKS = r"^(?: ?>)+"
#: A text with a line that begins with a mark.
_QUOTES = r"(?m)^ ?>"
_SENTENCE_END = r"(?<=[.!?])\s+|(?<=[。！？])"
#: A word: a character of a script without spaces, or a run of other characters.
_WORD = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]|[^ \x{3040}-\x{30FF}\x{3400}-\x{9FFF}]+"
_OMISSION = r"^[\[(]?(?:\.\.\.|…)[\])]?$"


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), " ", ""))


def normalised(line: Column) -> Column:
    """A line without its quote marks, lower case, white space runs as one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _MARKS, "")), r"\s+", " "))


def unquoted(text: Column) -> Column:
    """A text without quoted lines and the attribution before them."""
    lines = F.split(text, "\n", -1)
    quoted = lambda line: line.rlike(_MARKS)
    kept = F.filter(lines, lambda line, i: ~quoted(line) & ~(line.rlike(r"wrote:\s*$") & quoted(F.coalesce(F.try_element_at(lines, i + 2), F.lit("")))))
    return F.btrim(F.array_join(kept, "\n"), F.lit(" \t\r\n"))


def messages(table: DataFrame) -> DataFrame:
    """conv, turn, role, text without nulls but for conv and turn; key tells the messages of a turn apart."""
    rows = table.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64("role", "text"))


def _blocks(rows: DataFrame) -> DataFrame:
    """(conv, turn, key, lines, blocks) of each message of a turn that is not null; a block is adjacent lines of one level, joined."""
    line = lambda x: F.struct(quote_level(x).alias("level"), normalised(x).alias("body"))
    lines = rows.where(F.col("turn").isNotNull()).select("conv", "turn", "key", F.transform(F.split("text", "\n", -1), line).alias("lines"))
    at = lambda i: F.get("lines", i)
    begins = lambda i: (i == 0) | (at(i).body == "") | (at(i - 1).body == "") | (at(i).level != at(i - 1).level)
    begun = lines.withColumn("first", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), begins))
    length = lambda i, n: F.coalesce(F.get("first", n + 1), F.size("lines")) - i
    joined = lambda i, n: F.array_join(F.transform(F.slice("lines", i + 1, length(i, n)), lambda x: x.body), " ")
    blocks = F.transform("first", lambda i, n: F.struct(F.lit(1).alias("kind"), at(i).level.alias("level"), joined(i, n).alias("body")))
    return begun.select("conv", "turn", "key", "lines", blocks.alias("blocks"))


def passages(rows: DataFrame) -> DataFrame:
    """(conv, turn, key, kind, level, passage): the hashed passages of each message of a turn that is not null."""
    single = F.transform("lines", lambda x: F.struct(F.when(F.length(x.body) >= LEAST_CHARS, 0).otherwise(3).alias("kind"), x.level.alias("level"), x.body.alias("body")))
    cut = lambda b: F.filter(F.split(b.body, _SENTENCE_END), lambda s: F.length(s) >= LEAST_CHARS)
    sentences = F.flatten(F.transform("blocks", lambda b: F.transform(cut(b), lambda s: F.struct(F.lit(2).alias("kind"), b.level.alias("level"), s.alias("body")))))
    each = _blocks(rows).select("conv", "turn", "key", F.explode(F.concat(single, "blocks", sentences)).alias("p")).select("conv", "turn", "key", "p.*")
    return each.where("body <> ''").select("conv", "turn", "key", "kind", "level", F.xxhash64("kind", "body").alias("passage"))


def shingles(rows: DataFrame) -> DataFrame:
    """(conv, turn, key, kind, level, passage): as ``passages``, the hashed shingles of the joined lines, as kind 4."""
    each = _blocks(rows).select("conv", "turn", "key", F.explode("blocks").alias("b"))
    each = each.select("conv", "turn", "key", F.lit(4).alias("kind"), "b.level", F.regexp_extract_all("b.body", F.lit(_WORD), F.lit(0)).alias("words")).where(F.size("words") >= SHINGLE)
    word = lambda i: F.get("words", i)
    whole = F.filter(F.sequence(F.lit(0), F.size("words") - SHINGLE), lambda i: ~F.exists(F.slice("words", i + 1, SHINGLE), lambda w: w.rlike(_OMISSION)))
    hashed = F.transform(whole, lambda i: F.xxhash64(*[word(i + k) for k in range(SHINGLE)]))
    return each.select("conv", "turn", "key", "kind", "level", F.explode(F.array_distinct(hashed)).alias("passage"))


def _sources(rows: DataFrame, quoted: DataFrame, parts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``quoted`` with source: the latest earlier turn of which ``parts`` has the passage unquoted.

    Originals and quotations of a passage are one table; within a stretch of turns a window finds the last original before,
    and a second window over the stretches' last originals finds those of earlier stretches.
    """
    origin = parts(rows).where("level = 0").select("conv", "turn", "passage").distinct()
    #: A turn's source does not depend on its messages, so turns of very many messages are one row here.
    asked = quoted.select("conv", "passage", "turn").distinct()
    origin = written(origin.join(asked.select(F.col("conv").alias("c"), F.col("passage").alias("p")).distinct(), (F.col("conv").eqNullSafe(F.col("c"))) & (F.col("passage") == F.col("p")), "left_semi"), "chat-originals")
    both = asked.withColumn("origin", F.lit(None).cast("long")).unionByName(origin.withColumn("origin", F.col("turn")))
    both = both.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    within = Window.partitionBy("conv", "passage", "stretch").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)  # at most two rows a turn
    near = both.withColumn("near", F.max("origin").over(within)).where("origin IS NULL")
    ends = both.groupBy("conv", "passage", "stretch").agg(F.max("origin").alias("last"))
    before = Window.partitionBy("conv", "passage").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("conv").alias("c"), F.col("passage").alias("p"), F.col("stretch").alias("s"), F.max("last").over(before).alias("far"))
    met = near.join(ends, F.col("conv").eqNullSafe(F.col("c")) & (F.col("passage") == F.col("p")) & (F.col("stretch") == F.col("s")))
    sources = met.select(F.col("conv").alias("c"), F.col("passage").alias("p"), F.col("turn").alias("t"), F.coalesce("near", "far").alias("source")).where("source is not null")
    return quoted.join(sources, F.col("conv").eqNullSafe(F.col("c")) & (F.col("passage") == F.col("p")) & (F.col("turn") == F.col("t"))).drop("c", "p", "t")


def _parents(named: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(conv, turn, key, parent) from the sources of each message's passages; with ``totals`` a source must have half of a level's passages."""
    votes = named.groupBy("conv", "turn", "key", "kind", "level", "source").agg(F.count("*").alias("n"))
    if totals is not None:
        all_ = totals.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("key").alias("k"), F.col("level").alias("l"), "total")
        votes = votes.join(all_, F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("key") == F.col("k")) & (F.col("level") == F.col("l"))).where("2 * n >= total")
    return votes.groupBy("conv", "turn", "key").agg(F.min_by("source", F.struct("kind", "level", -F.col("n"), -F.col("source"))).alias("parent"))


def links(rows: DataFrame) -> DataFrame:
    """(conv, turn, key, parent): the turn that each message with a found quotation replies to.

    Messages that quote are worked off first and written; originals are sought among all messages after that, in one more pass.
    Shingles are made only of the conversations that have a quoting message without a parent by then.
    """
    quoting = rows.where(F.col("text").rlike(_QUOTES))
    quoted = written(passages(quoting).where("level > 0").distinct(), "chat-quoted")
    if quoted.isEmpty():
        return quoted.select("conv", "turn", "key", F.lit(None).cast("long").alias("parent"))
    found = written(_parents(_sources(rows, quoted, passages)), "chat-found")
    named = found.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("key").alias("k"))
    missed = quoting.join(named, F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("key") == F.col("k")), "left_anti")
    cut = written(shingles(missed).where("level > 0").distinct(), "chat-cut")
    if cut.isEmpty():
        return found
    their = rows.join(cut.select(F.col("conv").alias("c")).distinct(), F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    return found.unionByName(_parents(_sources(their, cut, shingles), cut.groupBy("conv", "turn", "key", "level").agg(F.count("*").alias("total"))))


def threads(rows: DataFrame) -> DataFrame:
    """``rows`` with parent, root (the first turn of the thread) and depth.

    Turns point to the turn they reply to; pointers double until all reach a first turn. Only linked turns take part. If
    messages share a turn, the turn's pointer is that of the message with the earliest parent.
    """
    found = written(links(rows), "chat-links")
    up = written(found.groupBy("conv", "turn").agg(F.min("parent").alias("root")).withColumn("depth", F.lit(1).cast("long")), "chat-up")
    while True:
        ahead = up.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("next"), F.col("depth").alias("more"))
        stepped = up.join(ahead, F.col("conv").eqNullSafe(F.col("c")) & (F.col("root") == F.col("t")), "left")
        if stepped.where("next is not null").isEmpty():
            break
        up = written(stepped.select("conv", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "chat-up")
    parents = found.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("key").alias("k"), "parent")
    roots = up.select(F.col("conv").alias("c2"), F.col("turn").alias("t2"), "root", "depth")
    out = rows.join(parents, F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("key") == F.col("k")), "left")
    out = out.join(roots, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("turn") == F.col("t2")), "left")
    linked = F.col("parent").isNotNull()
    return out.select("conv", "turn", "role", "text", "key", "parent", F.when(linked, F.col("root")).otherwise(F.col("turn")).alias("root"), F.when(linked, F.col("depth")).otherwise(0).alias("depth"))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with position: the row's number, from 0, in its group by ``order``.

    Rows are dealt in ranges of group and order; a position is the number within a range plus the group's rows in the ranges before.
    """
    dealt = written(rows.repartitionByRange(group, *order).withColumn("range", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy(group, "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col(group).alias("g"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy(group, "range").orderBy(*order)) - 1
    out = dealt.withColumn("own", own).join(bases, F.col(group).eqNullSafe(F.col("g")) & (F.col("range") == F.col("r")))
    return out.withColumn("position", F.col("base") + F.col("own")).drop("own", "base", "g", "r", "range")


def conversations(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, position, parent, depth, content): the messages in reply order, without quotations."""
    placed = ranked(threads(messages(table)), "conv", ["root", "depth", "turn", "role", "key"])
    return placed.select(F.col("conv").alias("conv_id"), "turn", "role", "position", "parent", "depth", unquoted(F.col("text")).alias("content"))


def formatted(table: DataFrame) -> DataFrame:
    """(conv_id, segment, n_messages, n_linked, chat): segments of each conversation as one text."""
    rows = conversations(table).withColumn("segment", F.floor(F.col("position") / SEGMENT))
    one = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "content", F.lit("<|im_end|>\n"))
    parts = F.sort_array(F.collect_list(F.struct("position", one.alias("message"))))  # at most SEGMENT messages
    return rows.groupBy("conv_id", "segment").agg(F.count("*").alias("n_messages"), F.count("parent").alias("n_linked"), F.array_join(F.transform(parts, lambda p: p.message), "").alias("chat"))
