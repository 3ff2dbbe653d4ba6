"""URL language models, ball-tree hard negatives and whitening, each against a brute-force version."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import balltree, urls, whitening
from tessera.llm.sql import SQL
from tessera.llm.vectors import finite_rows

# -- URLs


def url_pages(n=400):
    rng = random.Random(3)
    rows = [(-1, None), (-2, ""), (-3, "no scheme/x"), (-4, "http://com"), (-5, "HTTP://A.COM/x?://b"), (-6, "x://WWW.Example.com/en/a#/y"), (-7, "http://www.example.com/EN/"), (-8, "http://notexample.com/en/"), (-9, "http://example.com/en"), (None, "http://é.net/es/ß"), (None, "http://é.net/es/ß"), (-10, "http://a.net/es?"), (-11, "http://a.com:80/x"), (-12, "http://q.org/" + "long" * 5000), (-13, "://\n/x\ny")]
    for i in range(n):
        end = rng.choice(["com", "net", "org"])
        rows.append((i, f"http://{rng.choice(['a', 'b.c', 'www.example', 'example'])}.{end}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randrange(40)}"))
    return rows


def brute_urls(rows, order=urls.ORDER):
    parsed = []
    for i, u in rows:
        u = u or ""
        _, sign, rest = u.partition("://")
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]) if sign else ""
        tail = rest[cut:] if sign else ""
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fit = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        parsed.append((i, u, host, path, *max(fit, key=lambda f: len(f[0]), default=(None, None))))
    part = {}
    for _, u, _, _, _, v in parsed:
        part[u] = "judge" if v is None else ("test " if hashlib.md5(u.encode()).hexdigest()[0] in "012" else "train ") + v
    pages = Counter(r[1] for r in parsed)

    def grams(u):
        s = "\x02" * order + u + "\x03"
        return [s[i : i + order + 1] for i in range(len(u) + 1)]

    symbols = {g[-1] for u in part for g in grams(u)}
    counts = {v: [defaultdict(Counter) for _ in range(order + 1)] for v in ("allow", "block")}
    for u, p in part.items():
        if p.startswith("train"):
            for g in grams(u):
                for k in range(order + 1):
                    counts[p[6:]][k][g[order - k : -1]][g[-1]] += pages[u]

    def chance(v, g):
        p = 1 / (len(symbols) + 1)
        for k in range(order + 1):
            seen = counts[v][k].get(g[order - k : -1])
            if seen:
                p = (seen[g[-1]] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    bits = {g: round((math.log(chance("allow", g)) - math.log(chance("block", g))) * urls.NAT) for u, p in part.items() if not p.startswith("train") for g in grams(u)}
    score = {u: sum(bits[g] for g in grams(u)) // (len(u) + 1) for u, p in part.items() if not p.startswith("train")}
    tested = [(score[u] // urls.BIN, p[5:], pages[u]) for u, p in part.items() if p.startswith("test")]
    na, nr = (sum(n for _, v, n in tested if v == want) for want in ("allow", "block"))
    least = 0
    if na and nr:
        gain = {t: sum(n for b, v, n in tested if v == "allow" and b >= t) / na - sum(n for b, v, n in tested if v == "block" and b >= t) / nr for t, _, _ in tested}
        low = min(t for t in gain if gain[t] == max(gain.values()))
        least = (low + max((t + 1 for t in gain if t < low), default=low)) * urls.BIN // 2
    return [(i, h, p, r, v or ("allow" if score[u] >= least else "block")) for i, u, h, p, r, v in parsed]


def url_frame(spark, rows):
    return spark.createDataFrame([(i, u, "c", "c", 1, "c") for i, u in rows], "page_id long, url string, u string, host string, n int, g string").repartition(3)


@pytest.mark.parametrize("n", [400, 0])
def test_urls_against_brute_force_and_sql(spark, n):
    rows = url_pages(n)
    columns = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted(map(tuple, urls.judge(url_frame(spark, rows)).select(columns).collect()), key=repr)
    assert got == sorted(brute_urls(rows), key=repr)
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    assert sorted(con.execute(f"select {', '.join(columns)} from ({SQL['op11_url_language_models']})").fetchall(), key=repr) == got


def test_urls_of_an_empty_table_and_without_rules(spark):
    assert urls.judge(url_frame(spark, [])).collect() == []
    got = urls.judge(url_frame(spark, [(1, "http://a.com/"), (2, None)]), rules=()).collect()
    assert {(r.page_id, r.rule, r.verdict, r.log_ratio) for r in got} == {(1, None, "allow", 0.0), (2, None, "allow", 0.0)}


def test_common_grams_meet_by_broadcast(spark):
    """One url in most rows: its grams are hot, as is the url itself."""
    rows = [(i, "http://a.org/same") for i in range(300)] + url_pages(60)
    got = sorted(map(tuple, urls.judge(url_frame(spark, rows)).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    assert got == sorted(brute_urls(rows), key=repr)


def test_the_models_tell_hosts_apart(spark):
    """Hosts without a rule go with those that they look like."""
    rng = random.Random(1)
    pages = [(i, f"http://{rng.choice('abc')}{rng.randrange(99)}.good-news.com/fr/{i}") for i in range(300)] + [(i, f"http://x{rng.randrange(99)}.casino-win.net/es/{i}") for i in range(300, 600)]
    asked = [(1000 + i, f"http://m{i}.good-news.org/it/{i}") for i in range(20)] + [(2000 + i, f"http://m{i}.casino-win.org/it/{i}") for i in range(20)]
    got = {r.page_id: r.verdict for r in urls.judge(url_frame(spark, pages + asked)).collect()}
    assert all(got[i] == ("allow" if i < 2000 else "block") for i, _ in asked)


# -- vectors


def test_finite_rows():
    column = pa.array([[1.0, 2.0], None, [1.0, None], [], [float("nan"), 1.0], [3.0, float("inf")], [5.0], [4.0, 4.0]], pa.list_(pa.float32()))
    got = {m.shape[1]: (rows.tolist(), m.tolist()) for rows, m in finite_rows(column)}
    assert got == {0: ([3], [[]]), 1: ([6], [[5.0]]), 2: ([0, 7], [[1.0, 2.0], [4.0, 4.0]])}


def brute_negatives(rows, every=50, positives=5, negatives=3, low=50, high=95):
    kept = [(i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, [math.floor(256 * c) for c in v]) for i, v, l in rows if l is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1]))
    out = []
    for a, (i, label, x) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y)), b, j, m) for b, (j, m, y) in enumerate(kept) if b != a))
        for s, _, j, m in [t for t in scored if t[3] == label][:positives]:
            inside = [t for t in scored if t[3] != label and low * -s <= 100 * -t[0] <= high * -s][:negatives]
            out += [(i, j, k + 1, t[2], -s, -t[0]) for k, t in enumerate(inside)]
    return sorted(out, key=repr)


def vector_rows(n, dims=6, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.standard_normal(dims) + (i % 3)).astype(np.float32).tolist(), int(rng.integers(0, 10)) if i % 2 else 4) for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same, 4) for i in range(40)] + [(n + 40 + i, same, 5) for i in range(40)]  # ties
    rows += [(100, same, 4), (100, same, 4), (None, same, 5), (None, same, 4), (n + 90, None, 4), (n + 91, [1.0, None, 2.0, 1.0, 1.0, 1.0], 4), (n + 92, [float("nan")] * dims, 4), (n + 93, [float("inf")] * dims, 1), (n + 94, same, None), (n + 95, [0.0] * dims, 3), (n + 96, [], 4), (n + 97, [2.0, 1.0], 4), (n + 98, same + [9.0], 5)]
    return rows


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 7, "c", 1) for i, v, l in rows], "vec_id long, embedding array<float>, label int, rid int, x string, score int").repartition(3)


def negatives_of(spark, rows):
    return sorted(map(tuple, balltree.hard_negatives(balltree.vectors(vector_frame(spark, rows), 256, 7)).collect()), key=repr)


@pytest.mark.parametrize("size", [balltree.BLOCK_BYTES, 2000])
def test_hard_negatives(spark, monkeypatch, size):
    monkeypatch.setattr(balltree.best_rows, "__defaults__", (size,))
    monkeypatch.setattr(balltree.chunks, "__defaults__", (100 if size == 2000 else balltree.CHUNK_BYTES,))
    rows = vector_rows(300)
    got = negatives_of(spark, rows)
    assert got == brute_negatives(rows) and len(got) > 20


def test_hard_negatives_of_few_rows(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (50, [1.0], 1)], [(None, [1.0], 1), (None, None, None)]):
        assert negatives_of(spark, rows) == brute_negatives(rows)


def test_hard_negatives_of_huge_vectors(spark):
    rows = [(0, [1e30, 1.0], 2), (1, [1e30, 3.0], 1), (2, [1e30, -1.0], 1), (50, [1e12, 1e12], 1), (51, [1e12, 1e11], 1), (52, [7e11, 7e11], 2)]
    got = negatives_of(spark, rows)  # beyond 63 bits all scores are equal
    assert all(abs(r[4]) < 1 << 63 and abs(r[5]) < 1 << 63 for r in got)


def test_balls_bound_products_and_are_pruned():
    rng = np.random.default_rng(4)
    x = np.floor(256 * np.concatenate([rng.standard_normal((2000, 8)) * 0.1 + c for c in 3 * rng.standard_normal((10, 8))])).astype(np.int64)
    tree, q = balltree.BallTree(x), x[::400]

    def check(node):
        mine = tree.order[node.start : node.end]
        s, mid, reach = q @ x[mine].T, q @ node.centre, node.radius * np.linalg.norm(q, axis=1)
        assert (s <= (mid + reach)[:, None] + 1e-6).all() and (s >= (mid - reach)[:, None] - 1e-6).all()
        for c in node.children:
            check(c)

    check(tree.root)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    wide = np.full((len(q), 1), balltree._LEAST)
    asked = balltree.Queries(np.arange(len(q)) - 1000, np.zeros(len(q), np.int64), q, wide, -wide)
    best, done = balltree.search(tree, x, np.arange(len(x)), asked, np.arange(len(q)), 3)
    s = q @ x.T
    for i in range(len(q)):
        want = np.lexsort((np.arange(len(x)), -s[i]))[:3]
        assert best.rid[i].tolist() == want.tolist() and best.score[i].tolist() == s[i][want].tolist()
    assert done < 0.5 * s.size
    window = balltree.Queries(asked.rid, asked.label, q, s.max(axis=1)[:, None] // 3, s.max(axis=1)[:, None] // 2)
    best, less = balltree.search(tree, x, np.arange(len(x)), window, np.arange(len(q)), 3)
    for i in range(len(q)):
        inside = [j for j in np.lexsort((np.arange(len(x)), -s[i])) if window.lo[i, 0] <= s[i, j] <= window.hi[i, 0]][:3]
        assert [r for r in best.rid[i].tolist() if r < 1 << 62] == inside
    assert less < s.size


# -- whitening


def brute_whitening(rows, k=8):
    kept = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    most = max(Counter(len(v) for _, v in kept).items(), key=lambda t: (t[1], t[0]))[0]
    kept = [r for r in kept if len(r[1]) == most]
    n, x = len(kept), np.array([v for _, v in kept], object)
    sums = x.sum(axis=0)
    num = n * x - sums
    c = (num / n).astype(float)
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [r[0] for r in kept], n, np.square(num).sum(axis=1).tolist(), c @ u / np.sqrt(e), e / np.trace(v)


def white_rows(decay, n=300, dims=40):
    rng = np.random.default_rng(1)
    v = (rng.standard_normal((n, dims)) * decay ** np.arange(dims)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (n, None), (n + 1, [None] * dims), (n + 2, [float("nan")] * dims), (n + 3, [float("-inf")] * dims), (n + 4, []), (n + 5, [1.0, 2.0])]
    return rows


def white_frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, 4, "c") for i, v in rows], "vec_id long, embedding array<float>, n int, dims int, x string").repartition(3)


@pytest.mark.parametrize("decay", [0.8, 0.99])
def test_whitening_against_brute_force(spark, decay):
    rows = white_rows(decay)
    ids, n, deviation, white, explained = brute_whitening(rows)
    got = defaultdict(dict)
    out = whitening.whiten(white_frame(spark, rows)).collect()
    assert len(out) == 8 * n and {r.n for r in out} == {n}
    sign = {}
    for r in sorted(out, key=lambda r: (r.component, repr(r.vec_id))):
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        got[r.vec_id].setdefault(r.component, []).append((r.deviation, r.whitened))
    for k in range(8):
        for i, dev, w in zip(ids, deviation, white[:, k], strict=True):
            assert all(d == dev for d, _ in got[i][k + 1])
            sign.setdefault(k, math.copysign(1, w * got[i][k + 1][0][1]) if abs(w) > 1e-3 else None)
            if sign[k] is None:
                del sign[k]
                continue
            assert all(abs(v - sign[k] * w) < 1e-8 for _, v in got[i][k + 1])


def test_subspace_iteration_certifies_and_grows_its_block():
    rng = np.random.default_rng(0)
    u = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    for values, whole in ((0.7 ** np.arange(200), False), (1 - np.arange(200) / 1e4, True)):
        v = (u * values) @ u.T
        e, q, passes, block = whitening.subspace_iteration(lambda x, v=v: v @ x, 200, 8)
        assert np.allclose(e, values[:8], rtol=1e-11) and np.abs(v @ q - q * e).max() < 1e-12
        assert (block == 200) == whole and 2 < passes < 40


def test_whitening_of_few_rows(spark):
    assert whitening.whiten(white_frame(spark, [])).collect() == []
    assert whitening.whiten(white_frame(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(white_frame(spark, [(1, [1.0, 2.0])])).collect() == []
    got = whitening.whiten(white_frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [2.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.deviation, round(abs(r.whitened), 9), round(r.explained, 9)) for r in got) == [(1, 1, 2048**2, round(2**0.5, 9), 1.0), (2, 1, 1024**2, round(0.5**0.5, 9), 1.0), (3, 1, 1024**2, round(0.5**0.5, 9), 1.0)]


def test_deviations_beyond_64_bits_are_null(spark):
    got = whitening.whiten(white_frame(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])])).collect()
    assert got and all(r.deviation is None for r in got)
    assert np.array_equal(whitening._numerators(np.array([[1 << 43]]), 1 << 30, [5]), np.array([[(1 << 73) - 5]], object))


def test_results_do_not_depend_on_the_rows_of_a_batch(spark):
    rows = white_rows(0.9)
    one = whitening.whiten(white_frame(spark, rows).coalesce(1)).agg(F.max(F.abs("whitened"))).first()[0]
    assert abs(one - whitening.whiten(white_frame(spark, rows)).agg(F.max(F.abs("whitened"))).first()[0]) < 1e-9
