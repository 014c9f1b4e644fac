"""Quotation linking on random conversations with nested quotes: Spark, SQL and plain Python give the same."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from relcheck.llm import op08_quotation_linking as op08
from relcheck.llm.queries import QUERIES, SQL

LEAST_LONG = -(2**63)


def conversations(seed, n_conv=30, n_turns=9):
    """Messages that quote whole messages, paragraphs, wrapped parts, single lines, of this conversation or another, at several levels."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Über", "A", "b."]
    rows, all_texts = [], []
    for c in range(n_conv):
        texts = []
        for t in range(rng.randint(1, n_turns)):
            parts = []
            for _ in range(rng.randint(0, 3)):
                source = rng.choice(texts) if texts and rng.random() < 0.7 else rng.choice(all_texts) if all_texts else "none"
                lines = source.split("\n")
                kind = rng.random()
                if kind < 0.4:
                    a = rng.randrange(len(lines))
                    lines = lines[a : a + rng.randint(1, 4)]
                elif kind < 0.7:
                    flat = re.sub(r"(?m)^[ \t]*>.*$", "", source).split()
                    a = rng.randrange(len(flat)) if flat else 0
                    flat, width = flat[a : a + rng.randint(1, 12)], rng.randint(1, 5)
                    lines = [" ".join(flat[i : i + width]) for i in range(0, len(flat), width)]
                mark = rng.choice(["> ", ">", " > ", ">> "])
                parts.append("\n".join(mark + x for x in lines))
                if rng.random() < 0.7:
                    parts.append("\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 3))))
            text = "\n".join(parts) or " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
            texts.append(text)
            rows.append((c, t, rng.choice(["user", "assistant"]), text))
            if rng.random() < 0.05:
                rows.append(rows[-1])
        all_texts += texts
    return rows


def folded(text):
    return re.sub(r"\s+", " ", text).strip(" ").lower()


def links(rows):
    """{(conv, turn): parent turn}, by loops over all messages."""
    messages = sorted(set((c, t, x) for c, t, _, x in rows))
    own, runs = {}, {}
    for c, t, text in messages:
        level = lambda line: re.match(r"[ \t>]*", line)[0].count(">")
        lines = [(level(x), folded(re.sub(r"^[ \t]*>[ \t>]*", "", x))) for x in text.split("\n")]
        blocks = [b for b in re.split(r"(?m)^[ \t]*>.*$", text) if re.search(r"\S", b)]
        own[c, t] = ({w for n, w in lines if n == 0 and w}, {folded(p) for b in blocks for p in [b, *re.split(r"\n\s*\n", b)]}, [folded(b) for b in blocks])
        passages, last, part = [], None, 0
        for n, w in lines:
            if n != last:
                passages.append((n, []))
            last, part = n, part + (w == "")
            if n and w:
                passages[-1][1].append((w, part))
        runs[c, t] = [p for p in passages if p[1]]

    def places(c, t, test):
        """The first earlier turn here that passes, the first message anywhere, unless that is here."""
        here = [u for (d, u) in sorted(own) if d == c and test(own[d, u], True)]
        anywhere = [k for k in sorted(own) if test(own[k], False)]
        return here[0] if here and here[0] < t else None, anywhere[0] if anywhere and anywhere[0][0] != c else None

    def whole(c, t, lines):
        text = " ".join(lines)
        found = len(lines) > 1 or len(text.split(" ")) >= 5
        return places(c, t, lambda m, near: text in m[1] or (near and found and any(f" {text} " in f" {b} " for b in m[2])))

    out = {}
    for (c, t), passages in runs.items():
        won = []
        for n, lines in passages:
            votes = {}
            all_ = whole(c, t, [w for w, _ in lines])
            for w, part in lines:
                some = whole(c, t, [x for x, p in lines if p == part])
                one = places(c, t, lambda m, _: w in m[0])  # noqa: B023
                here, there = (next((p[i] for p in (all_, some, one) if p[i] is not None), None) for i in (0, 1))
                to = (c, here) if here is not None else there
                if to is not None:
                    votes[to] = votes.get(to, 0) + 1
            if votes:
                best = min(votes, key=lambda k: (-votes[k], k[0] != c, k))
                if best[0] == c:
                    won.append((n, -votes[best], best[1]))
        if won:
            out[c, t] = min(won)[2]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, tmp_path, seed):
    rows = conversations(seed)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    df, r = QUERIES["op8_quotation_linking"](spark, str(tmp_path)), duck.sql(SQL["op8_quotation_linking"])
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    assert got == sorted(map(repr, r.project(", ".join(columns)).fetchall()))
    want = links(rows)
    found = {(c, t): p for c, t, p in r.project("conv_id, turn, parent_turn").fetchall() if p is not None}
    assert found == want and len(want) > 40


def test_long_thread_and_odd_rows(spark):
    rows = [(LEAST_LONG, LEAST_LONG, "u", "first of all lines"), (LEAST_LONG, 5, "u", "> first of all lines\nyes")]
    rows += [(1, 0, "u", "root line of the thread")] + [(1, i, "u", f"> root line of the thread\nanswer {i}") for i in range(1, 400)]
    rows += [(2, None, None, f"text {i % 7}") for i in range(300)] + [(None, 1, "u", "x")] * 3 + [(3, 0, "u", "long " * 200_000)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, position string, root int")
    got = op08.reply_ordered(table).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    assert all(sorted(r.position for r in found) == list(range(len(found))) for found in by.values())
    assert [(r.turn, r.parent_turn, r.depth) for r in sorted(by[1], key=lambda r: r.position)] == [(0, None, 0)] + [(i, 0, 1) for i in range(1, 400)]
    assert [(r.turn, r.parent_turn) for r in sorted(by[LEAST_LONG], key=lambda r: r.position)] == [(LEAST_LONG, None), (5, LEAST_LONG)]
    assert [r.body for r in sorted(by[2], key=lambda r: r.position)] == sorted(f"text {i % 7}" for i in range(300))
    assert op08.reply_ordered(table.limit(0)).count() == 0
    assert op08.reply_ordered(table).agg(F.max("depth")).first()[0] == 1
