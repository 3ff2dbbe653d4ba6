"""Quotation linking on planted conversations, against its SQL."""

import random
import re
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import quotes
from tessera.llm.sql import SQL

SCHEMA = "conv_id long, turn long, role string, text string, hash string, unit string, level int, part int"


def both(spark, rows):
    df = spark.createDataFrame([(*r, "k", "u", 1, 2) for r in rows], SCHEMA).repartition(3)
    con = duckdb.connect()
    con.register("conversations", pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows], pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))
    got = quotes.reply_ordered(df)
    columns = ["conv_id", "turn", "role", "text", "n_quoted", "parent_turn", "depth", "position"]
    assert got.columns == columns
    want = con.execute("SELECT " + ", ".join(columns) + " FROM (" + SQL["op2_quotation_linking"] + ")").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def planted(n_conversations=25, seed=1):
    """Replies that quote whole messages, paragraphs or lines, at any depth, in other spacing and case, with quotes of quotes and lines that many messages share."""
    rng, rows = random.Random(seed), []
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split())
    for c in range(n_conversations):
        said: list[list[str]] = []
        for t in range(rng.randrange(2, 14)):
            own = [" ".join(word() for _ in range(rng.randrange(1, 7))) if rng.random() < 0.8 else rng.choice(["", "Thanks!", "+1"]) for _ in range(rng.randrange(1, 6))]
            lines = []
            if said and rng.random() < 0.75:
                old = rng.choice(said)
                lo = rng.randrange(len(old))
                part = old[lo : rng.randrange(lo, len(old)) + 1] if rng.random() < 0.6 else old
                if rng.random() < 0.4:
                    part = ["   ".join(x.split(" ")).upper() for x in part]
                lines = [rng.choice(["> ", ">", " > "]) + x for x in part]
                if rng.random() < 0.3:
                    lines = [x if rng.random() < 0.5 else ">" + x for x in lines]
                if rng.random() < 0.3:
                    lines.insert(rng.randrange(len(lines) + 1), ">> " + word())
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["\n", "\r\n"]).join([*own[:1], *lines, *own[1:]] if rng.random() < 0.3 else [*lines, *own])))
            said.append(own)
    return rows


def test_planted_quotations(spark):
    rows = planted()
    rows += [(0, 3, "user", "again"), rows[5], rows[5], (None, 1, "user", "x"), (None, 1, "user", "> x"), (3, None, "user", "> y"), (90, 0, "user", None), (90, 1, "user", ""), (90, 2, "u", ">\n> \n>>"), (91, 7, None, "a b\nc"), (91, 9, "u", "> A  b c"), (91, 8, "u", "> c")]
    got, want = both(spark, rows)
    assert got == want
    assert sum(r[5] is not None for r in got) > 60 and max(r[6] for r in got) >= 4 and sum(r[4] for r in got) > 150


def brute_parents(rows):
    """Each message's parent, message by message."""

    def units(lines):
        runs, last = [], None
        for line in lines:
            signs = re.match(r"(?:[ \t]{0,3}>)+[ \t]?", line)
            level, plain = (signs[0].count(">") if signs else 0), " ".join(line[signs.end() if signs else 0 :].lower().split())
            if plain and last == level:
                runs[-1][1].append(plain)
            elif plain:
                runs.append((level, [plain]))
            last = level if plain else None
        out = defaultdict(set)
        for level, said in runs:
            out[level] |= {" ".join(said), *said}
        if out[0]:
            out[0].add(" ".join(" ".join(said) for level, said in runs if level == 0))
        return out

    messages = defaultdict(lambda: defaultdict(set))
    for c, t, _, text in rows:
        for level, found in units(re.split("\r?\n", text or "")).items():
            messages[c, t][level] |= found
    parents = {}
    for (c, t), mine in messages.items():
        for level in sorted(mine, reverse=True):
            shared = {u: len(mine[level] & other[0]) for (d, u), other in messages.items() if level and c == d and c is not None and None not in (t, u) and u < t}
            if any(shared.values()):
                parents[c, t] = max(u for u in shared if shared[u] == max(shared.values()))
    return parents


@pytest.mark.parametrize("rare", [quotes.RARE, 1, 0])
def test_parents_against_brute_force(spark, monkeypatch, rare):
    """Also with most or all units hot."""
    monkeypatch.setattr(quotes, "RARE", rare)
    rows = planted(12, seed=7)
    rows += [(80, 0, "u", "A\nB\nC"), (80, 1, "a", "A\nB"), (80, 2, "u", "> A\n> B\n> C\nyes"), (80, 3, "a", "> A\n> B\nno"), (80, 4, "u", "x\nA\n\nB"), (80, 5, "u", "> gone\n>> x\n>>> C"), (80, 6, "u", ">> B\n> A\n> C")]
    rows += [(81, t, "u", "+1" if t % 3 else f"> +1\n> thanks\n+1\nthanks {t % 5}\nthanks") for t in range(60)]
    parsed = quotes.parse(spark.createDataFrame([(*r, "k", "u", 1, 2) for r in rows], SCHEMA).repartition(3))
    got = {(r.conv_id, r.turn): r.parent for r in quotes.reply_links(parsed).collect()}
    assert got == brute_parents(rows) and (got[80, 2], got[80, 3], got[80, 5]) == (0, 1, 4)
    assert {(r.level, r.parent) for r in quotes.quote_links(parsed).where("conv_id = 80 and turn = 5").collect()} == {(2, 4), (3, 0)}


def test_a_long_chain_and_a_wide_thread(spark):
    chain = [(1, 0, "u", "m0")] + [(1, t, "u", f"> m{t - 1}\nm{t}") for t in range(1, 70)]
    wide = [(2, 0, "u", "root")] + [(2, t, "u", f"> root\nw{t}") for t in range(1, 40)] + [(2, 40 + t, "u", f"> w{t}\nz") for t in range(1, 40, 3)]
    got, want = both(spark, chain + wide)
    assert got == want and max(r[6] for r in got) == 69
    order = [r.turn for r in quotes.reply_ordered(spark.createDataFrame([(*r, "k", "u", 1, 2) for r in wide], SCHEMA)).orderBy("position").select("turn").collect()]
    assert order[:5] == [0, 1, 41, 2, 3]


def test_a_passage_is_found_whatever_its_wrapping(spark):
    rows = [(1, 0, "u", "one two three\nfour five"), (1, 1, "u", "one two three four"), (1, 2, "u", "> one two\n> three four five\nyes"), (1, 3, "u", "> one two three\n> four\nno")]
    df = spark.createDataFrame([(*r, "k", "u", 1, 2) for r in rows], SCHEMA)
    assert {r.turn: r.parent_turn for r in quotes.reply_ordered(df).collect()} == {0: None, 1: None, 2: 0, 3: 1}
    assert quotes.reply_ordered(df.limit(0)).count() == 0


def test_units_meet_by_text_not_by_hash_alone(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    got = quotes.reply_links(quotes.parse(spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "u", "> b"), (1, 2, "u", "> a")], "conv_id long, turn long, role string, text string"))).collect()
    assert [(r.turn, r.parent) for r in got] == [(2, 0)]
