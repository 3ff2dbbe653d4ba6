"""The shared memory's fold against one that goes event by event, over any cut of the log, and what agents see of it."""

import random

from pyspark.sql import functions as F

from tessera.operators.stored import folder
from tessera.streaming import ingest, shared_memory


def events_of(seed=1, sessions=6):
    rng, rows = random.Random(seed), []
    for s in range(sessions):
        for task in range(2):
            for seq in range(rng.randrange(6, 14)):
                op = rng.choice(["write", "write", "handoff", "resolve"])
                agent = rng.choice(["a", "a", "b"])
                rows.append((f"s{s}", task, seq, op, f"{op}{s}.{task}.{seq}", agent, agent if op == "handoff" else None, "c" if op == "handoff" else None, rng.choice(["session", "working"]), None if op == "resolve" else rng.choice([0.5, 0.7, 0.96]), None if op == "resolve" else f"m{len(rows)}"))
    return rows


def by_hand(rows):
    out, marks = {}, {}
    for s, t in sorted({r[:2] for r in rows}):
        version, written = 0, []
        for r in sorted(x for x in rows if x[:2] == (s, t)):
            _, _, _, op, node, agent, _, _, _, confidence, message = r
            version += 1
            if op == "resolve":
                marks[node] = "resolved"
                order = sorted(written, key=lambda w: (-w[0], -w[1]))
                for i, w in enumerate(order):
                    marks[w[2]] = "rejected" if i else "selected"
                if order:
                    confidence, message = min(0.98, max(0.7, order[0][0] + 0.04)), order[0][3]
            elif op == "write" and agent == "a":
                written.append((confidence, version, node, message))
            out[node] = (version, None if confidence is None else round(confidence, 6), message)
    return {n: (*v, marks.get(n)) for n, v in out.items()}


def run(spark, rows, cuts, again=False):
    frame = spark.createDataFrame(rows, shared_memory.EVENT)
    log = ingest.Log(spark, folder(frame), frame.schema)
    work = shared_memory.folding(log, F.col("agent") == "a")

    def process(batch, number):
        work(batch, number)
        if again:
            work(batch, number)

    ingest.replay(log, [frame.where((F.col("seq") >= a) & (F.col("seq") < b)) for a, b in zip(cuts, cuts[1:], strict=False)], process)
    return shared_memory.memories(log)


def plain(df):
    return {r.node: (r.version, None if r.confidence is None else round(r.confidence, 6), r.message, r.conflict_status) for r in df.collect()}


def test_any_cut_of_the_log_gives_the_same_memories(spark):
    rows = [r for r in events_of() if r[3] != "resolve" or r[2] >= 3]
    want = by_hand(rows)
    assert plain(run(spark, rows, [0, 99])) == want and {"selected", "rejected", "resolved"} <= {v[3] for v in want.values()}
    assert plain(run(spark, rows, [0, 2, 5, 99], again=True)) == want


def test_what_an_agent_sees(spark):
    memory = lambda node, version, layer="session", target=None, status=None, source=None, op="write", task=0: ("s", task, version, op, node, "a", source, target, layer, 0.9, "m", version, status, None)
    rows = [memory("old", 1), memory("new", 2), memory("work", 3, layer="working"), memory("mine", 4, target="u", source="a", op="handoff"), memory("theirs", 5, target="v", source="a", op="handoff"), memory("gone", 6, status="rejected"), memory("won", 7, status="selected"), memory("other", 8, task=1)]
    df = spark.createDataFrame(rows, shared_memory.MEMORY + ", conflict_status string, resolution string")
    seen = lambda **k: {r.node for r in shared_memory.visible(df, **k).collect()}
    assert seen() == {"old", "new", "work", "mine", "theirs", "won", "other"}
    assert seen(layers=["session"], agent="u", task=0) == {"old", "new", "mine", "won"}
    assert seen(agent="u", latest=True) == {"work", "mine", "won", "other"} and seen(source="a") == {"mine", "theirs"}
    assert seen(include_rejected=True, statuses=["rejected", "selected"]) == {"gone", "won"}
