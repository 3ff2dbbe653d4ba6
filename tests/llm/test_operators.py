"""Each operator against a brute-force version, with nulls, empty and very long texts, ties, repeated rows, empty tables and columns of clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import blocks, bpe, decontam, flac, jaccard, quality, quotes, records, suffix, toxicity, warc
from tessera.llm.shared import shared_dir, without

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, key string, n long, token long, id long, label string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    rng = random.Random(5)
    base, passage = words(rng, 160), words(rng, 90)
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, "   \n"), (6, "two words"), (7, "Two  WORDS"), (8, words(rng, 3000)), (None, base), (None, None)]
    for i in range(10, 22):
        w = base.split()
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    for i in range(30, 36):
        rows.append((i, f"{words(rng, 40)} {passage} {words(rng, 40)}"))
    rows += [(40, "ab " * 400), (41, "éà" * 300 + " x"), (42, "éà" * 300 + " y"), (43, words(rng, 100) + " " + "ab " * 300)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, "l") for i, t in rows], SCHEMA).repartition(3)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    smallest = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return sorted(((d, len(sets[i]), smallest[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def test_jaccard_join(spark):
    rows = corpus()
    got = jaccard.similar_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == brute_components(rows)
    assert jaccard.similar_components(frame(spark, [])).count() == 0


def test_jaccard_join_loses_no_link_in_a_hot_group(spark):
    rng = random.Random(9)
    base, rows = words(rng, 60).split(), []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(6)}"
        rows.append((i, " ".join(w)))
    got = jaccard.similar_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == brute_components(rows)


def test_keep_one_keeps_one_row_of_each_component(spark):
    rows = corpus()
    kept = jaccard.keep_one(frame(spark, rows))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    ids = [r.doc_id for r in kept.collect()]
    groups = {d: c for d, _, c in brute_components(rows) if d is not None}
    assert sorted(i for i in ids if i is not None) == sorted({c for c in groups.values()})
    assert ids.count(None) == 1  # the one without text; the other is a copy of document 1


def brute_repeats(rows, length=400):
    seen = defaultdict(int)
    raws = [(t or "").encode() for _, t in rows]
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] += 1
    out = []
    for (d, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup(spark):
    rows = corpus()
    got = suffix.digest(frame(spark, rows))
    assert rows_of(got.drop("text")) == brute_repeats(rows)
    assert rows_of(got.select("doc_id", "text")) == sorted(((d, t or "") for d, t in brute_passages(rows)), key=repr)
    assert suffix.digest(frame(spark, [])).count() == 0


def test_suffix_dedup_of_periodic_texts_and_short_strings(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))) + "xyz" * rng.randrange(0, 30)) for i in range(60)]
    got = rows_of(suffix.digest(frame(spark, rows), 48).drop("text"))
    assert got == brute_repeats(rows, 48)


def brute_passages(rows, length=50):
    """The texts without the words that a run of `length` words covers which starts anywhere else."""
    seen, cut = defaultdict(int), [[(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t in rows]
    for w in cut:
        for i in range(len(w) - length + 1):
            seen[tuple(x for *_, x in w[i : i + length])] += 1
    out = []
    for (d, t), w in zip(rows, cut, strict=True):
        raw, gone, whole = (t or "").encode(), set(), sum(x == t for _, x in rows) > 1
        for i in range(len(w) - length + 1):
            if seen[tuple(x for *_, x in w[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        cut_bytes = {b for x in gone for b in range(w[x][0], w[x + 1][0] if x + 1 in gone else w[x][1])}
        out.append((d, None if t is None else "" if whole and gone else bytes(b for i, b in enumerate(raw) if i not in cut_bytes).decode()))
    return sorted(out, key=repr)


def test_suffix_dedup_of_words(spark):
    rng = random.Random(12)
    passage = words(rng, 60)
    rows = [*corpus(), (70, passage), (71, f"x {passage} y"), (72, "\n".join(passage.split())), (73, " ".join(passage.split()[:49])), (74, passage.upper()), (75, "q " * 49), (76, "r " * 120)]
    got = suffix.remove(frame(spark, rows), 50, unit="word")
    assert rows_of(got.select("doc_id", "text")) == brute_passages(rows)
    assert rows_of(suffix.remove(frame(spark, rows[:40]), 3, unit="word").select("doc_id", "text")) == brute_passages(rows[:40], 3)
    assert suffix.remove(frame(spark, []), 50, unit="word").count() == 0


def test_suffix_remove_keeps_columns_and_nulls(spark):
    rows = corpus()
    cut = {(r.doc_id, r.text) for r in suffix.remove(frame(spark, rows)).collect()}
    assert (3, None) in cut and (1, "") in cut and (6, "two words") in cut
    assert all("é" not in (t or "") for d, t in cut if d in (41, 42))


def test_multikey_order_sorts_like_bytes():
    rng = np.random.default_rng(3)
    m = rng.integers(0, 3, (300, 16)).astype(np.uint8)
    group = rng.integers(0, 4, 300)
    order = suffix.multikey_order(m.view(">u8"), group)
    assert [(group[i], m[i].tobytes()) for i in order] == sorted((g, r.tobytes()) for g, r in zip(group.tolist(), m, strict=True))


BENCHMARK = "item_id long, text string, doc_id long"


def brute_hits(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for i, q in items:
            v = cut(q)
            if i is None or not v:
                continue
            for a in range(max(1, len(v) - 12)):
                g = v[a : a + 13]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit.update(range(p, p + len(g)))
                        found.add(i)
        out.append((d, len(w), len(hit), len(found), decontam.sha256_of_ids(list(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def items_for(rows):
    texts = [t for _, t in rows if t and len(t) > 300]
    return [(1, " ".join(texts[0].split()[10:40])), (10, " ".join(texts[-1].split()[:20]).upper()), (2, "two words"), (2, "nowhere at all"), (3, None), (4, "..."), (None, texts[0]), (5, "ab")]


@pytest.mark.parametrize("query_bytes", [1 << 20, 40])
def test_decontamination(spark, query_bytes):
    rows = corpus()
    items = items_for(rows)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], BENCHMARK)
    assert rows_of(decontam.digest(decontam.decontaminate(frame(spark, rows), b, query_bytes=query_bytes))) == brute_hits(rows, items)


def test_decontamination_of_and_with_nothing(spark):
    none = spark.createDataFrame([], BENCHMARK)
    assert {r.contaminated for r in decontam.digest(decontam.decontaminate(frame(spark, corpus()), none)).collect()} == {False}
    assert decontam.decontaminate(frame(spark, []), spark.createDataFrame([(1, "a b", 1)], BENCHMARK)).count() == 0
    rows = corpus()
    items = items_for(rows)
    kept = decontam.keep_clean(frame(spark, rows), spark.createDataFrame([(i, t, 1) for i, t in items], BENCHMARK))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(d or -1 for d, *_, bad in brute_hits(rows, items) if not bad)


def test_proximity_matches():
    text = "a x b y c z z z c b a"
    vocabulary, term = np.unique(text.split(), return_inverse=True)
    number = {w: i for i, w in enumerate(vocabulary)}
    order = np.argsort(term, kind="stable")
    terms, counts = np.unique(term, return_counts=True)
    frequency = np.bincount(term)
    near = lambda q, span: decontam.near_matches(terms, counts, order.astype(np.uint32), [number[w] for w in q.split()], frequency, span)
    assert near("a b c", 5) == [(0, 4), (8, 10)]
    assert near("a b c", 3) == [(8, 10)]
    assert near("a y", 3) == []


def test_proximity_of_benchmark_windows(spark):
    rows = [(1, "a x b x c y"), (2, "a b c"), (3, "c c A x x b"), (4, "a"), (5, "b c"), (6, "a x x x x b c"), (7, None), (8, "q a b a c b z c a"), (8, "q a b a c b z c a"), (9, "d e f x e d")]
    items = [(1, "a b c"), (2, "d e f g"), (2, "d e"), (3, "C b a b"), (4, "..."), (5, None), (None, "a b"), (6, "a")]
    for span, window, query_bytes in ((5, 3, 1 << 20), (4, 13, 3)):
        want = set()
        for d, t in rows:
            w = (t or "").lower().split()
            for item, q in items:
                v = re.findall("[a-z]+", (q or "").lower())
                for need in [set(v[a : a + window]) for a in range(max(1, len(v) - window + 1)) if v and item is not None]:
                    spans = [(i, j) for i in range(len(w)) for j in range(i, min(i + span, len(w))) if need <= set(w[i : j + 1])]
                    want |= {(d, item, i, j) for i, j in spans if (i + 1, j) not in spans and (i, j - 1) not in spans}
        b = spark.createDataFrame([(i, t, 1) for i, t in items], BENCHMARK)
        got = decontam.proximity(frame(spark, rows), b, span, window, query_bytes).select("doc_id", "item_id", "first", "last")
        assert rows_of(got) == sorted(want, key=repr) and len(want) > 15
    assert decontam.proximity(frame(spark, rows), spark.createDataFrame([], BENCHMARK)).count() == 0


TEXTS = ["", None, "don't  we'll\tI'M x_1 ÀÉ é", "<|startoftext|>hi<|endoftext|>there <|b|> <|StartOfText|>", "語義 记忆 42 ½ ²", "İstanbul ΣΑΣ ẞ ×5÷3", "a" * 3000, "ab" * 700 + "!!?", "\x00\x01\x7f a\x1cb", "👩‍👩‍👧 🙂🙂", "a\u0085b 　c", "ﬁx Å", "word " * 500]


def test_bpe_is_the_librarys(spark):
    tok = Tokenizer.from_file(WORD_BPE)
    want = []
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((i, len(ids), sha, hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    df = frame(spark, list(enumerate(TEXTS)))
    assert rows_of(bpe.round_trip(df, WORD_BPE)) == sorted(want, key=repr)
    decoded = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, WORD_BPE), WORD_BPE).collect()}
    assert decoded[2] == tok.decode(tok.encode(TEXTS[2], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.round_trip(frame(spark, []), WORD_BPE).count() == 0


def test_bpe_of_runs_of_any_length(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("etaoinshrdlu", k=n)) for n in (8192, 8193, (1 << 20) + 1)] + ["x " + "é" * 6000 + "=-" * 5000, "a" * 8191]
    tok = Tokenizer.from_file(WORD_BPE)
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, list(enumerate(texts))), WORD_BPE).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_token_records_round_trip(spark):
    tok = Tokenizer.from_file(WORD_BPE)
    rows = [*enumerate(TEXTS), (3, "again"), (None, "no id")]
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = records.write(frame(spark, rows), WORD_BPE)
    assert rows_of(records.read(manifest)) == sorted(want, key=repr)
    assert records.read(records.write(frame(spark, []), WORD_BPE)).count() == 0


def test_broken_records_raise():
    raw, offset, size = records.frame([7, None], np.array([1, 2, 3]), np.array([0, 2, 3]), 2)
    assert [(d, i.tolist()) for d, i in records.parse(raw, offset, size)] == [(7, [1, 2]), (None, [3])]
    broken = bytearray(raw)
    broken[25] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(records.parse(bytes(broken), offset, size))


def test_flac_round_trip_and_seeking():
    texts = ["", "a" * 5000, "The quick brown fox. " * 300, bytes(range(128)).decode() * 20]
    payloads = flac.padded(*blocks.text_bytes(pa.array(texts)))
    payloads += [np.random.default_rng(0).integers(0, 256, 576 * 3).astype(np.uint8), (128 + 100 * np.sin(np.arange(5760) / 9)).astype(np.uint8), np.repeat(np.array([0, 255], np.uint8), 288)]
    for lpc in (0, 1, 8):
        streams = flac.encode(payloads, lpc)
        assert all((a == b).all() for a, b in zip(flac.decode(streams), payloads, strict=True))
    assert (flac.decode_range(streams[2], 3000, 700) == payloads[2][3000:3700]).all()
    assert len(flac.decode_range(streams[2], len(payloads[2]) - 5, 700)) == 5
    broken = bytearray(streams[2])
    broken[len(broken) // 2] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(broken)])


def test_flac_tries_every_fixed_order():
    rng = np.random.default_rng(1)
    waves = {4: 100 * np.sin(np.arange(576) * 2 * np.pi / 12), 3: 100 * np.sin(np.arange(576) * 2 * np.pi / 36), 1: np.cumsum(rng.integers(-1, 2, 576)), 0: rng.integers(-9, 10, 576)}
    payloads = [np.rint(w + 128).astype(np.uint8) for w in waves.values()]
    streams = flac.encode(payloads, 0)
    assert [s[flac.Stream(s).audio + 6] >> 1 for s in streams] == [0b001000 | order for order in waves]
    assert all((a == b).all() for a, b in zip(flac.decode(streams), payloads, strict=True))


def test_flac_frame_numbers():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 2_000_000):
        raw = flac._frame_number(n)
        assert flac._read_number(raw, 0) == (n, len(raw))


def test_media_column(spark):
    rows = corpus()
    got = {}
    for r in flac.describe(flac.store(frame(spark, rows))).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, t in rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (max(1, math.ceil(len(raw) / 576)) * 576 - len(raw))
        assert any((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for r in got[d])
    assert got[1][0][2:] == got[2][0][2:]  # equal texts
    assert flac.describe(flac.store(frame(spark, []))).count() == 0


def test_pcm_blocks_of_the_media_column(spark):
    rows = [*corpus(), (50, "é" * 400000)]
    stored = flac.store(frame(spark, rows))
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (max(1, math.ceil(len(raw) / 576)) * 576 - len(raw))
        want += [(d, i, p[i : i + 576]) for i in range(0, len(p), 576)]
    blocks = flac.pcm_blocks(stored)
    assert rows_of(blocks.select("doc_id", "first_sample", F.col("pcm"))) == sorted(want, key=repr)
    a, b = 70_000, 71_500  # by their offsets alone
    found = blocks.where(f"doc_id = 50 and first_sample between {a // 576 * 576} and {b}").orderBy("first_sample").collect()
    assert b"".join(r.pcm for r in found)[a % 576 :][: b - a] == ("é" * 400000).encode()[a:b] and len(found) == 4
    assert {r.media_sha256 for r in found} == {r.media_sha256 for r in flac.describe(stored.where("doc_id = 50")).collect()}
    assert flac.pcm_blocks(flac.store(frame(spark, []))).count() == 0
    files = [tuple(r) for r in flac.write_pcm(stored).collect()]
    for d, t, a, b in ((50, "é" * 400000, 300_001, 600_007), (50, "é" * 400000, 799_990, 900_000), (8, dict(rows)[8], 5, 3000), (8, dict(rows)[8], 7, 7)):
        assert b"".join(flac.read_samples(*f, d, a, b) for f in files).rstrip(b"\xff") == t.encode()[a:b]


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u\r\nv", ""), (5, "http://é", "é" * 5000), (5, "http://é", "é" * 5000), (None, "n", "<p>x</p>"), (6, "w", "WARC/1.1\r\n\r\n\r\n")]
    df = spark.createDataFrame([(*p, "k", 1) for p in pages], "page_id long, url string, html string, key string, salt int").repartition(2)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        same = [p for p, _, x in pages if (x or "").encode() == raw and p is not None]
        chosen = max(same, default=None)
        want.append((i, len(raw), warc.digest(raw), "response" if i == chosen else "revisit", None if i == chosen else chosen))
    assert rows_of(warc.dedup_round_trip(df)) == sorted(want, key=repr)
    assert warc.dedup_round_trip(df.limit(0)).count() == 0
    assert {r.record_type for r in warc.dedup_round_trip(df, min_bytes=1 << 30).collect()} == {"response"}


def test_warc_members_are_gzip_files_of_their_own(spark):
    df = spark.createDataFrame([(i, f"http://{i}", "<p>" + "x" * i) for i in range(20)], "page_id long, url string, html string")
    m = warc.normalise(warc.write_monolithic(warc.assign_roles(df))).collect()
    from tessera.llm import files

    for r in m:
        raw = files.read(r.path)
        for line in files.read(r["index"]).decode().splitlines():
            at, size, kind, page, _ = line.split("\t")
            assert zlib.decompress(raw[int(at) : int(at) + int(size)], 31).startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode())
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records(iter([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"])))


def labelled(spark, n=600):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        t = words(rng, 30)
        if not good:
            t = " | ".join(t.split()).upper()
        if i % 5 == 0:
            t += " awful"
        docs.append((i, t))
        labels.append((i, int(good), int(i % 5 == 0), 1))
    docs += [(n, None), (n + 1, ""), (None, "w1 w2")]
    labels += [(n, None, None, 1), (None, 1, 1, 1), (0, int(0 % 3 > 0), 1, 1)]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score int")


def test_quality_classifier(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for i, r in rows.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
    unseen = [r for i, r in rows.items() if i is not None and i < 600 and r.held_out]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in unseen) / len(unseen) > 0.97
    assert rows[600].score == rows[601].score
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows.values())
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_without_labels_of_two_classes(spark):
    docs, labels = labelled(spark, 30)
    assert {round(r.score, 6) for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    ones = quality.score(docs, quality.train(docs, labels.where("quality = 1"))).agg(F.min("score")).first()[0]
    assert ones > 0.9


def test_dual_coordinate_descent_finds_a_separating_model():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    y = np.array([1, 1, 0, 0])
    w, b = quality.dual_coordinate_descent(rows, y, np.ones(4), 100.0, 200)
    assert all((w[r].sum() * quality.weight(2) + b > 0) == (v == 1) for r, v in zip(rows, y, strict=True))


def test_toxicity_chain(spark):
    docs, labels = labelled(spark)
    rows = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    unseen = [r for i, r in rows.items() if i is not None and i < 600 and r.held_out]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in unseen) / len(unseen) > 0.97
    assert rows[600].score == rows[601].score
    none = toxicity.score(docs, toxicity.train(docs, labels.limit(0)))
    assert {round(r.score, 6) for r in none.collect()} == {0.5}
    alone = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels.drop("quality"))).collect()}
    assert sum(alone[r.doc_id].predicted == int(r.doc_id % 5 == 0) for r in unseen) / len(unseen) > 0.97  # labels that settle one category alone


def test_chain_feeds_out_of_fold_probabilities(monkeypatch):
    rng = np.random.default_rng(5)
    n, size = 60, 40
    texts = [np.unique(rng.integers(0, size, 8)) for _ in range(n)]
    x, off = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    y = np.stack([rng.integers(0, 2, n), rng.integers(0, 2, n)], 1).astype(float)
    y[::7, 0] = np.nan
    seen = []
    real = toxicity.fit_link

    def watched(x, off, before, y, size):
        seen.append((off, before, y))
        return real(x, off, before, y, size, epochs=3)

    monkeypatch.setattr(toxicity, "fit_link", watched)
    monkeypatch.setattr(toxicity, "LEAST_Z", 0.0)
    chain = toxicity.fit_chain(x, off, y, ("a", "b"), size)
    plain = lambda m, t, odds: 1 / (1 + math.exp(-(sum(m.words[w] for w in t) + sum(e * o for e, o in zip(m.earlier, odds, strict=True)) + m.bias)))
    odds = lambda p: math.log(min(max(p, 1e-3), 0.999) / (1 - min(max(p, 1e-3), 0.999)))
    known = [i for i in range(n) if not math.isnan(y[i, 0])]
    folds = []
    for f in range(3):
        mine = [i for i in known if i % 3 != f]
        xs = [texts[i] for i in mine]
        folds.append(real(np.concatenate(xs), np.concatenate([[0], np.cumsum([len(t) for t in xs])]), np.zeros((len(mine), 0)), y[mine, 0].astype(int), size, epochs=3))
    want = [plain(folds[i % 3], texts[i], []) for i in range(n)]
    assert len(seen) == 5 and np.allclose(seen[-1][1][:, 0], want)
    p = chain.probabilities(x, off)
    for i, t in enumerate(texts):
        a = plain(chain.links[0], t, [])
        assert np.allclose(p[i], [a, plain(chain.links[1], t, [odds(a)])])


def test_support_vectors_against_plain_python():
    rng = random.Random(6)
    rows = [sorted(rng.sample(range(12), rng.randrange(1, 6))) for _ in range(30)]
    y = [int(sum(r) % 3 > 0) for r in rows]
    ratio = []
    for j in range(12):
        count = lambda v: 1 + sum(j in r for r, c in zip(rows, y, strict=True) if c == v)  # noqa: B023, E731
        total = lambda v: 12 + sum(len(r) for r, c in zip(rows, y, strict=True) if c == v)
        ratio.append(math.log(count(1) / total(1)) - math.log(count(0) / total(0)))
    got = quality.log_count_ratios([np.array(r) for r in rows], np.array(y), 12)
    assert np.allclose(got, ratio)
    scaled = [{j: ratio[j] * quality.weight(len(r)) for j in r} for r in rows]
    share, sign = sum(y) / len(y), [1 if c else -1 for c in y]
    most = [0.5 / share if c else 0.5 / (1 - share) for c in y]
    w, bias = quality.dual_coordinate_descent([np.array(r) for r in rows], np.array(y), got, 1.0, 3000)
    plain, b, dual = [0.0] * 12, 0.0, [0.0] * len(rows)
    for _ in range(6000):  # each dual variable in turn, exactly
        for i, v in enumerate(scaled):
            step = min(max(dual[i] - (sign[i] * (sum(plain[j] * u for j, u in v.items()) + b) - 1) / (sum(u * u for u in v.values()) + 1), 0), most[i]) - dual[i]
            dual[i] += step
            b += step * sign[i]
            for j, u in v.items():
                plain[j] += step * sign[i] * u
    assert np.allclose(w, [plain[j] * ratio[j] for j in range(12)], atol=0.02) and abs(b - bias) < 0.02


def test_quotation_linking(spark):
    m = [
        (1, 0, "user", "How does it work?\nPlease tell."), (1, 1, "assistant", "> How does  IT work?\nIt merges pairs."), (1, 2, "user", "Unrelated."),
        (1, 3, "user", "> It merges pairs.\n>> How does it work?\nThanks"), (1, 4, "user", "> nobody said this\nhm"), (2, 0, "user", None), (2, 1, "user", "> How does it work?"), (2, 2, "user", ">\n> \n"),
        (None, 1, "user", "x"), (3, None, "user", "y"), (1, 2, "user", "Unrelated."),
    ]
    df = spark.createDataFrame([(*r, "k", 1) for r in m], "conv_id long, turn long, role string, text string, hash string, level int")
    rows = {(r.conv_id, r.turn): r for r in quotes.reply_ordered(df).collect()}
    assert rows[1, 1].parent_turn == 0 and rows[1, 3].parent_turn == 1 and rows[1, 4].parent_turn is None and rows[2, 1].parent_turn is None
    assert rows[1, 3].text == "Thanks" and rows[1, 3].depth == 2 and rows[1, 3].n_quoted == 2
    order = [r.turn for r in quotes.reply_ordered(df).where("conv_id = 1").orderBy("position").collect()]
    assert order == [0, 1, 3, 2, 2, 4]
    chat = {r.conv_id: r.messages for r in quotes.conversations(quotes.reply_ordered(df)).collect()}
    assert [x.content for x in chat[1]][:3] == ["How does it work?\nPlease tell.", "It merges pairs.", "Thanks"]
    assert quotes.reply_ordered(df.limit(0)).count() == 0


def test_shared_folder_follows_the_session(spark):
    assert shared_dir(spark).startswith("file:")
    df = frame(spark, [(1, "a"), (1, "b"), (None, "a"), (2, None)])
    keys = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    from tessera.llm.shared import row_key

    assert sorted((r.doc_id or 0, r.text) for r in without(df, keys.select(*[c.alias(n) for n, c in row_key().items()])).collect()) == [(0, "a"), (1, "b")]
