"""Quotation linking against plain Python: parsing, links, reply order."""

import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from firmlens.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(
    "text, own, passages",
    [
        (None, "", []),
        ("", "", []),
        ("hello\nyou", "hello\nyou", []),
        ("> a\n> b\nmine", "mine", [(1, "a\nb")]),
        ("top\nOn Monday X wrote:\n> a\n>> b\n> > c\n> d\nend", "top\nend", [(1, "a"), (2, "b\nc"), (1, "d")]),
        ("X wrote:\n\n> Y wrote:\n>> deep\n> a", "", [(2, "deep"), (1, "a")]),
        (">\n> \n", "", []),
        ("a > b", "a > b", []),
        ("he wrote:\nnot a quote", "he wrote:\nnot a quote", []),
    ],
)
def test_parse(text, own, passages):
    assert quotes.parse(text) == (own, passages)


def norm(text):
    return re.sub(r"\s+", " ", text).strip().lower()


def parts(text):
    return {norm(p): len(norm(p)) for p in [text, *text.split("\n")] if norm(p)}


def brute(rows):
    """rows: (conv, turn, text) with unique (conv, turn); gives {(conv, turn): (reply, thread_turn, position, depth, n_linked)}."""
    parsed = {(c, t): quotes.parse(x) for c, t, x in rows}
    said = defaultdict(list)
    for key, (own, _) in parsed.items():
        for p in parts(own):
            said[p].append(key)
    parent, reply, linked = {}, {}, {}
    for key, (_, passages) in parsed.items():
        votes, linked[key] = defaultdict(int), 0
        for level, text in passages:
            score = defaultdict(int)
            for p, weight in parts(text).items():
                near = [k for k in said[p] if k[0] == key[0] and k[1] < key[1]]
                first = min(said[p], default=None)
                to = max(near) if near else first if first and first[0] != key[0] else None
                if to:
                    score[to] += weight
            if score:
                to = max(score, key=lambda k: (score[k], order[k]))
                linked[key] += 1
                votes[(-level, to)] += 1
        if votes:
            reply[key] = max(votes, key=lambda v: (v[0], votes[v], order[v[1]]))[1]
            if reply[key][0] == key[0] and reply[key][1] < key[1]:
                parent[key] = reply[key]
    children, out = defaultdict(list), {}
    for key in sorted(parsed):
        children[parent.get(key)].append(key)

    for root in children[None]:
        stack, n = [(root, 0)], 0
        while stack:
            key, depth = stack.pop()
            out[key] = (reply.get(key), root[1], n, depth, linked[key])
            n += 1
            stack += [(k, depth + 1) for k in reversed(children[key])]
    return out


order = {}


def threads(seed, conversations=12, most=25):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        texts = []
        for t in range(rng.randint(1, most)):
            own = "\n".join(f"line {rng.randrange(400)} of {c}" if rng.random() < 0.9 else "ok" for _ in range(rng.randint(1, 4)))
            quoted = ""
            if texts and rng.random() < 0.6:
                source = rng.choice(texts)
                lines = source.split("\n")
                if rng.random() < 0.3:
                    lines = lines[: rng.randint(1, len(lines))]
                quoted = "Somebody wrote:\n" + "\n".join("> " + line for line in lines) + "\n"
            elif rng.random() < 0.1 and rows:
                quoted = "\n".join("> " + line for line in rng.choice(rows)[2].split("\n")) + "\n"
            texts.append(quoted + own)
            rows.append((c, t, texts[-1]))
    return rows


@pytest.mark.parametrize("seed, turns", [(1, 1024), (2, 3)])
def test_reply_order(spark, monkeypatch, seed, turns):
    monkeypatch.setattr(quotes, "TURNS", turns)
    monkeypatch.setattr(quotes.latest_before, "__defaults__", (turns,))
    monkeypatch.setattr(quotes.preorder, "__defaults__", (turns,))
    rows = threads(seed)
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], SCHEMA).coalesce(1).withColumn("own", F.lit(1))
    order.clear()
    order.update({(c, t): n for n, (c, t, _) in enumerate(rows)})
    got = {(r.conv_id, r.turn): r for r in quotes.reply_order(frame).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for key, (reply, thread, position, depth, linked) in want.items():
        r = got[key]
        assert (r.reply_conv, r.reply_turn) == (reply or (None, None)), key
        assert (r.thread_turn, r.position, r.depth, r.n_linked) == (thread, position, depth, linked), key
        assert ">" not in r.own_text


def test_deep_chain_and_hot_line(spark):
    rows = [(1, 0, "user", "start 0")] + [(1, t, "user", f"> start {t - 1}\nok\nstart {t}") for t in range(1, 300)]
    got = {r.turn: r for r in quotes.reply_order(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert all((got[t].reply_turn, got[t].position, got[t].depth) == (t - 1 if t else None, t, t) for t in range(300))


def test_edges(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "b"), (None, 1, "user", "> b"), (2, None, None, "> a"), (3, 0, "user", None), (3, 1, "user", "")]
    got = quotes.reply_order(spark.createDataFrame(rows, SCHEMA))
    found = got.collect()
    assert len(found) == len(rows) and all(r.depth == 0 and r.position == 0 for r in found)
    assert [(r.reply_conv, r.reply_turn) for r in found if r.conv_id == 2] == [(1, 0)]
    assert quotes.reply_order(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_to_other_conversations(spark):
    # null conversations, later repeats in the asker's own one and null turns don't take the place of the original
    cases = [(None, 0, "b"), (1, 0, "b"), (2, 0, "> b"), (3, 0, "> c"), (3, 1, "c"), (4, 0, "c"), (5, 0, "c"), (6, None, "d"), (6, 4, "d"), (7, 0, "> d"), (None, 9, "> c")]
    rows = [(c, t, "user", x) for c, t, x in cases]
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in quotes.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k] for k in [(2, 0), (3, 0), (7, 0), (None, 9)]] == [(1, 0), (4, 0), (6, 4), (3, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_follow_the_contract(spark, seed):
    rng = random.Random(seed)
    # one line quoted, one line said, out of few, so that lines repeat in and between conversations
    rows = [(c, t, rng.randrange(60) if rng.random() < 0.5 else None, rng.choice([rng.randrange(60), 0])) for c in [None, *range(12)] for t in range(15)]
    frame = spark.createDataFrame([(c, t, "user", ("" if q is None else f"> line {q}\n") + f"line {own}") for c, t, q, own in rows], SCHEMA)
    said = defaultdict(list)
    for c, t, _, own in rows:
        if c is not None:
            said[own].append((c, t))
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in quotes.reply_order(frame.repartition(3)).collect()}
    for c, t, q, _ in rows:
        near = [k for k in said[q] if k[0] == c and k[1] < t]
        other = [k for k in said[q] if k[0] != c]
        assert got[c, t] == (max(near) if near else min(other, default=(None, None))), (c, t)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = quotes.reply_order(table)
    assert got.count() == table.count() and got.where("depth > 0 OR position > 0").count() == 0


@pytest.mark.parametrize(
    "line, want",
    [
        ("As Tom said in 1990, the law is:", False), ("Tom wrote:", True), ("On 3 May 2020, tom@x.org wrote :", True), ("Am 3. Mai schrieb Tom:", True), ("Le 3 mai, Ann a écrit :", True),
        ("he wrote: no", False), ("El martes 4 escribió Ana:", True), ("On balance he said what the law is:", False), ("", False), (":", False), ("SAID:", True),
    ],
)
def test_lines_that_introduce(line, want):
    assert quotes.introduces(line) == want


def test_own_sentences_stay_and_long_lines_are_linear():
    own, passages, introduced = quotes.parsed_parts("As Tom said in 1990, the law is:\n> a\nOn 1 May X wrote:\n> b")
    assert own == "As Tom said in 1990, the law is:" and passages == [(1, "a"), (1, "b")] and introduced == ["On 1 May X wrote:"]
    start = time.perf_counter()
    quotes.parsed_parts("on 1 " + "said " * 400_000 + ":\n> a")
    assert time.perf_counter() - start < 3


def test_whole_table_quoted(spark):
    """Every message of the given table quotes the one before it, and a third of all messages quote the same hot line."""
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").where("text IS NOT NULL")
    rows = sorted((r.conv_id, r.turn, r.role, r.text) for r in given.distinct().collect())
    made, want, n = [], {}, 0
    for (c, t, role, text), before in zip(rows, [None, *rows]):
        n += 1
        own = f"reply {n}: " + text.replace("\n", " ")
        if before and before[0] == c:
            said = made[-1][3].split("\n")[-1]
            own = f"On day {n} {before[2]} wrote:\n> {said}\n" + (f"> hot line for all\n{own}" if n % 3 == 0 else own)
            want[c, t] = (before[1], n % 3 == 0)
        made.append((c, t, role, own))
    docs = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").repartition(8)
    got = {(r.conv_id, r.turn): r for r in quotes.reply_order(docs).collect()}
    assert len(got) == len(made) and len(want) > 50
    for (c, t), r in got.items():
        assert r.own_text.startswith("reply ") and r.n_quotes == ((c, t) in want) and len(r.introduced) == ((c, t) in want)
        if (c, t) in want:
            assert (r.reply_conv, r.reply_turn) == (c, want[c, t][0]) and len(r.introduced) == 1
    for c in {k[0] for k in got}:
        own = sorted((r for k, r in got.items() if k[0] == c), key=lambda r: r.turn)
        assert [r.position for r in own] == list(range(len(own))) and [r.depth for r in own] == list(range(len(own)))
