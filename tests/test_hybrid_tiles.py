"""What hybrid scores move between tasks."""

import itertools

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import hybrid


def test_every_tile_is_numbered_once():
    blocks = 7
    assert sorted(hybrid._tile(k) for k in range(blocks * (blocks + 1) // 2)) == [(i, j) for i in range(blocks) for j in range(i, blocks)]


def test_memories_are_stored_once_whatever_the_number_of_blocks(spark):
    rows = [(i, [f"k{i % 3}"], [], "x", [1.0, 0.0]) for i in range(40)] + [(None, ["k0"], [], "x", [1.0, 0.0])]
    given = spark.createDataFrame(rows, "id long, kw array<string>, ev array<string>, answer string, v array<double>")
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 3 == b % 3}
    for size in (3, 10, 100):
        found = hybrid.pairs(given, size)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # blocks are read, not shuffled to tiles
        assert {(r.a, r.b) for r in found.collect()} == want and found.count() == len(want)
    assert hybrid.pairs(given.limit(0)).count() == 0 == hybrid.links(given.limit(0), 0.1).count()


def test_pairs_by_table(spark):
    """Both ways of all pairs that share a word, each combination scored once for a tile and none for a pair, whatever the blocks."""
    rows = [(i, [f"w{i % 4}", f"v{i % 3}"][: i % 3], ["x", "y"][: i % 2 + 1] if i % 5 else []) for i in range(60)] + [(None, ["w0"], [])]
    given = spark.createDataFrame(rows, "id long, kw array<string>, kinds array<string>")
    score = lambda shared, n, a, b: round(shared / n + 10 * len(a & b) + 100 * bool(b), 9)
    want = {(a, b): score(len(set(x) & set(y)), len(x), set(p), set(q)) for (a, x, p), (b, y, q) in itertools.permutations(rows[:-1], 2) if set(x) & set(y)}
    for size in (7, 25, 100):
        found = hybrid.by_table(given, score, size)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = found.collect()
        assert "Exchange" not in plan and len(got) == len(want) and {(r.a, r.b): r.score for r in got} == want
    assert hybrid.by_table(given.limit(0), score).count() == 0


def test_half_up_is_round(spark):
    x = [0.1234565, 2.5e-7, -0.0000015, 1 / 3, 0.0, 5e-7, 12345.6789015]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6).alias("r")).collect()
    assert [r.r for r in got] == [text.half_up(v, 6) for v in x]
