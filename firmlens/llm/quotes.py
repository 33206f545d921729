"""Quotation linking: nested quotes of messages are joined to the messages they come from, and conversations are put in reply order.

1. Lines are split by quote level (``>`` marks). Runs of one level are passages; what is left is the message's own text.
2. Own texts (whole, and each line) and passages (whole, and each line) are hashed after normalising.
3. A hash is answered by the latest earlier message of the conversation that has it, else by the first message of another.
4. A passage goes to the message that answers most of its characters; a message replies to the one its outermost quotes go to.
5. Replies form trees; their pre-order is ranked by pointer doubling over the tour of each tree.

Nothing emits pairs: a key's own texts and questions are merged in order of turn, in blocks of turns with a carried maximum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.llm.common import lookup
from firmlens.session import cut_lineage

_LEVEL = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
# Verbs of lines that introduce a quote, and the words that such lines begin a date with.
_VERBS = "wrote|writes|said|schrieb|écrit|escribió"
_VERB_LAST, _VERB = re.compile(rf"\b(?:{_VERBS})\s*:$", re.IGNORECASE), re.compile(rf"\b(?:{_VERBS})\b", re.IGNORECASE)
_DATE = re.compile(r"(?:on|am|le|el)\b", re.IGNORECASE)
LAST_CHARS = 40
#: turns that one task puts in order at most, for one key
TURNS = 1024
PARSED = "own string, passages array<struct<level:int,text:string>>, introduced array<string>"


def introduces(line: str) -> bool:
    """Whether a line has the shape of an attribution: its verb right before the colon at its end, or a date, a digit and the verb."""
    line = line.strip()
    if not line.endswith(":"):
        return False
    return bool(_VERB_LAST.search(line[-LAST_CHARS:]) or (_DATE.match(line) and any(c.isdigit() for c in line) and _VERB.search(line)))


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """Own text and quoted passages (level, text). Lines that introduce a deeper quote belong to neither."""
    return parsed_parts(text)[:2]


def parsed_parts(text: str | None) -> tuple[str, list[tuple[int, str]], list[str]]:
    """Own text, quoted passages, and the lines that introduce a deeper quote, in order."""
    lines = []
    for line in (text or "").split("\n"):
        m = _LEVEL.match(line)
        lines.append((m[1].count(">"), line[m.end() :].strip()) if m else (0, line.rstrip()))
    own, passages, run, run_level = [], [], [], 0
    deeper = 0  # level of the next line that is not blank, read from the end
    keep = []
    for level, content in reversed(lines):
        keep.append(not (content and deeper > level and introduces(content)))
        if content:
            deeper = level
    keep.reverse()
    for (level, content), kept in zip(lines, keep):
        if level != run_level:
            if run_level and any(run):
                passages.append((run_level, "\n".join(run).strip("\n")))
            run, run_level = [], level
        if kept:
            (run if level else own).append(content)
    if run_level and any(run):
        passages.append((run_level, "\n".join(run).strip("\n")))
    return "\n".join(own).strip("\n"), passages, [content for (_, content), kept in zip(lines, keep) if not kept]


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _keys(text: Column) -> Column:
    """(hash, weight) of a text and of each of its lines, without blanks and repeats."""
    parts = F.filter(F.transform(F.concat(F.array(text), F.split(text, "\n")), normalised), lambda p: p != "")
    return F.transform(F.array_distinct(parts), lambda p: F.struct(F.md5(p.cast("binary")).alias("hash"), F.char_length(p).alias("weight")))


def latest_before(rows: DataFrame, keys: Sequence[str], order: str, value: str, out: str, turns: int = TURNS) -> DataFrame:
    """(keys, order, out) for rows that ask (``value`` null): the value of the answering row with the largest smaller order.

    Rows must be few per (keys, order). A key's rows are put in order in blocks of ``turns``; blocks carry their maximum on.
    """
    pair = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    rows = rows.withColumn("block", F.floor(F.col(order) / turns))
    top = rows.where(F.col(value).isNotNull()).groupBy(*keys, "block").agg(F.max(pair).alias("top"))
    every = rows.select(*keys, "block").distinct().join(top, [*keys, "block"], "left")
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("carried", F.max("top").over(before)).drop("top")
    inside = Window.partitionBy(*keys, "block").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    found = rows.join(carried, [*keys, "block"]).withColumn("near", F.max(F.when(F.col(value).isNotNull(), pair)).over(inside))
    return found.where(F.col(value).isNull()).select(*keys, order, F.coalesce("near.v", "carried.v").alias(out))


def following(rows: DataFrame, key: str, order: str, value: str, out: str, turns: int = TURNS) -> DataFrame:
    """``rows`` with the value of the next row of the key, in order; blocks of ``turns`` as above. Column ``first`` tells the key's first row."""
    rows = rows.withColumn("block", F.floor(F.col(order) / turns))
    inside = Window.partitionBy(key, "block").orderBy(order, value)
    heads = rows.groupBy(key, "block").agg(F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("head"))
    blocks = Window.partitionBy(key).orderBy("block")
    heads = heads.select(key, "block", F.lead("head.v").over(blocks).alias("next_head"), (F.row_number().over(blocks) == 1).alias("first_block"))
    placed = rows.withColumns({"near": F.lead(value).over(inside), "nth": F.row_number().over(inside)}).join(heads, [key, "block"])
    return placed.withColumns({out: F.coalesce("near", "next_head"), "first": F.col("first_block") & (F.col("nth") == 1)}).drop("block", "near", "nth", "next_head", "first_block")


def messages(conversations: DataFrame) -> DataFrame:
    """Parsed messages (m, part, conv, turn, role, own, passages, introduced), written once; m numbers the rows."""

    @F.pandas_udf(PARSED)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [parsed_parts(t if isinstance(t, str) else None) for t in texts]
            yield pd.DataFrame({"own": [o for o, _, _ in found], "passages": [[{"level": n, "text": t} for n, t in p] for _, p, _ in found], "introduced": [i for _, _, i in found]})

    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn"), F.col("role"), parsed("text").alias("p"))
    return cut_lineage(rows.select(F.monotonically_increasing_id().alias("m"), F.spark_partition_id().alias("part"), "conv", "turn", "role", "p.own", "p.passages", "p.introduced"))


def links(rows: DataFrame) -> DataFrame:
    """(m, passage, level, hash, to): the message that each quoted passage of ``messages`` goes to, null if none has it."""
    said = rows.select("m", "conv", "turn", F.explode(_keys(F.col("own"))).alias("k")).select("m", "conv", "turn", "k.hash")
    asked = rows.select("m", "part", "conv", "turn", F.posexplode("passages").alias("passage", "p"))
    whole = asked.select("m", "passage", "p.level", F.md5(normalised(F.col("p.text")).cast("binary")).alias("whole"))
    asked = cut_lineage(asked.select("m", "part", "conv", "turn", "passage", F.explode(_keys(F.col("p.text"))).alias("k")).select("m", "part", "conv", "turn", "passage", "k.*"))
    wanted = asked.select("hash").distinct()
    # only hashes that somebody asks for; one answer per conversation, hash and turn
    said = said.join(wanted, "hash", "left_semi").groupBy("conv", "hash", "turn").agg(F.max("m").alias("who"))
    said = cut_lineage(said)
    questions = asked.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "hash", "turn").distinct().withColumn("who", F.lit(None).cast("long"))
    near = latest_before(said.where("conv IS NOT NULL AND turn IS NOT NULL").unionByName(questions), ["conv", "hash"], "turn", "who", "near")
    answered = lookup(asked, "part", ["conv", "hash", "turn"], near)
    # the first message of the two smallest conversations, so that one of them is not the asker's; null turns come last
    known = said.where("conv IS NOT NULL").select("hash", F.struct("conv", F.col("turn").isNull().alias("late"), "turn", "who").alias("by"))
    first = cut_lineage(known.groupBy("hash").agg(F.min("by").alias("first")))
    others = lookup(known.withColumn("part", F.pmod(F.xxhash64("by.conv"), F.lit(256)).cast("int")), "part", ["hash"], first).where("by.conv <> first.conv")
    answers = first.join(others.groupBy("hash").agg(F.min("by").alias("second")), "hash", "left")
    answered = lookup(answered, "part", ["hash"], answers)
    # anybody else's message, if no earlier one of the conversation has it
    elsewhere = F.when(F.col("first.conv").eqNullSafe(F.col("conv")), F.col("second.who")).otherwise(F.col("first.who"))
    answered = answered.select("m", "passage", "weight", F.coalesce("near", elsewhere).alias("to")).where("to IS NOT NULL")
    votes = answered.groupBy("m", "passage", "to").agg(F.sum("weight").alias("votes"))
    best = votes.groupBy("m", "passage").agg(F.max_by("to", F.struct("votes", "to")).alias("to"))
    return whole.join(best, ["m", "passage"], "left").select("m", "passage", "level", F.col("whole").alias("hash"), "to")


def preorder(nodes: DataFrame, turns: int = TURNS) -> DataFrame:
    """(m, root, position, depth) of forests given by (m, turn, parent): children in order of turn, a node before its children."""
    children = following(nodes.where("parent IS NOT NULL").select("m", "turn", "parent"), "parent", "turn", "m", "sibling", turns)
    firsts = children.where("first").select(F.col("parent").alias("m"), F.col("m").alias("child"))
    tree = nodes.select("m", "parent").join(firsts, "m", "left").join(children.select("m", "sibling"), "m", "left")
    # the tour enters a node (2m) and leaves it (2m + 1); entering counts
    enter = tree.select((F.col("m") * 2).alias("at"), F.coalesce(F.col("child") * 2, F.col("m") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("enters"), F.lit(1).cast("long").alias("climb"))
    leave = tree.select((F.col("m") * 2 + 1).alias("at"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("enters"), F.lit(-1).cast("long").alias("climb"))
    # only trees with more than one node need a tour; the last step of a tour is the leaving of its root
    alone = tree.where("parent IS NULL AND child IS NULL").select("m", F.col("m").alias("root"), F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("depth"))
    busy = tree.where("parent IS NOT NULL OR child IS NOT NULL").select((F.col("m") * 2).alias("at"))
    tour = enter.unionByName(leave).join(busy.unionByName(busy.select((F.col("at") + 1).alias("at"))), "at", "left_semi").withColumn("end", F.when(F.col("next").isNull(), F.col("at")))
    tour = cut_lineage(tour)
    while not tour.where("next IS NOT NULL").isEmpty():
        ahead = tour.select(F.col("at").alias("next"), F.col("next").alias("next2"), F.col("enters").alias("enters2"), F.col("climb").alias("climb2"), F.col("end").alias("end2"))
        moved = tour.where("next IS NOT NULL").join(ahead, "next")
        moved = moved.select("at", F.col("next2").alias("next"), (F.col("enters") + F.col("enters2")).alias("enters"), (F.col("climb") + F.col("climb2")).alias("climb"), F.col("end2").alias("end"))
        tour = cut_lineage(moved.unionByName(tour.where("next IS NULL")))
    # steps from here to the end of the tour, compared with those of the root
    ranked = tour.where("at % 2 = 0").select((F.col("at") / 2).cast("long").alias("m"), "enters", "climb", ((F.col("end") - 1) / 2).cast("long").alias("root"))
    sizes = ranked.where("m = root").select("root", F.col("enters").alias("size"))
    spread = ranked.withColumn("part", F.pmod(F.xxhash64("m"), F.lit(256)).cast("int"))
    tours = lookup(spread, "part", ["root"], sizes).select("m", "root", (F.col("size") - F.col("enters")).alias("position"), (-F.col("climb")).alias("depth"))
    return alone.unionByName(tours)


def reply_order(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, own_text (without quotes), introduced (lines that announce its quotes), n_quotes, n_linked, reply_conv and reply_turn (the message it
    replies to), thread_turn (turn of the first message of its reply tree), position in the tree's pre-order (0 first) and depth.

    Reading a conversation by (thread_turn, position) gives every message before its replies. A message replies to the message that
    its outermost quotes go to; of several, the one most of them go to, then the latest. Only earlier messages of the same
    conversation make trees; a quote from another conversation gives reply_conv and reply_turn and leaves the message a root.

    Null text is empty. Messages with null conv_id or turn are not searched in their conversation and stay roots. Repeated rows
    are messages of their own; of messages with the same turn, the one read last answers. Texts of any length are read line by line,
    whole. An empty table gives an empty result.
    Other columns are not read.
    """
    rows = messages(conversations)
    found = cut_lineage(links(rows))
    counts = found.groupBy("m").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("to").alias("n_linked"))
    votes = found.where("to IS NOT NULL").groupBy("m", "level", "to").agg(F.count(F.lit(1)).alias("votes"))
    target = votes.groupBy("m").agg(F.max_by("to", F.struct((-F.col("level")).alias("level"), "votes", "to")).alias("to"))
    places = rows.select(F.col("m").alias("to"), F.col("conv").alias("reply_conv"), F.col("turn").alias("reply_turn"))
    target = lookup(target.withColumn("part", F.pmod(F.xxhash64("m"), F.lit(256)).cast("int")), "part", ["to"], places).drop("part")
    replies = rows.select("m", "conv", "turn").join(target, "m", "left")
    parent = F.when((F.col("reply_conv") == F.col("conv")) & (F.col("reply_turn") < F.col("turn")), F.col("to"))
    nodes = cut_lineage(replies.withColumn("parent", parent))
    order = preorder(nodes.select("m", "turn", "parent"))
    roots = lookup(order.withColumn("part", F.pmod(F.xxhash64("m"), F.lit(256)).cast("int")), "part", ["root"], rows.select(F.col("m").alias("root"), F.col("turn").alias("thread_turn")))
    out = rows.select("m", "role", "own", "introduced").join(nodes, "m").join(roots.select("m", "position", "depth", "thread_turn"), "m").join(counts, "m", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("conv").alias("conv_id"), "turn", "role", F.col("own").alias("own_text"), "introduced", F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"),
        "reply_conv", "reply_turn", "thread_turn", "position", "depth",
    )
