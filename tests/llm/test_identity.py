"""Values that share a hash, long words, and clashing column names."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.test_blocks import twins
from tests.llm.test_operators import WORD_BPE, brute_components, brute_hits, frame, rows_of
from tokenizers import Tokenizer

from tessera.llm import blocks, bpe, decontam, jaccard, records


@pytest.fixture
def one_hash(monkeypatch):
    """All hashes are equal: what still tells values apart compares bytes."""
    monkeypatch.setattr(blocks.Rolling, "ranges", lambda self, start, end: np.zeros(len(start), np.uint64))


def test_parts_of_one_hash_get_their_own_ids(one_hash):
    def spell(buf, start, end):
        return np.concatenate([buf[a:b].astype(np.int64) for a, b in zip(start, end, strict=True)]), end - start

    cache = bpe.PartCache()
    for texts in (["ab cd ab", "", "cd ef"], ["cd cd", "ab gh abc"], ["x" * 300 + " ab"]):
        ids, at = bpe.encode_distinct(*blocks.text_bytes(pa.array(texts)), spell, cache)
        assert [bytes(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)] == [t.replace(" ", "").encode() for t in texts]


def test_terms_of_one_hash_are_told_apart(one_hash):
    buf, off = blocks.text_bytes(pa.array(["ab cd AB", "ef cd"]))
    start, end, _, hashes = decontam._terms(buf, off)
    known = decontam.Vocabulary(buf, start[:3], end[:3], hashes[:3])
    assert len(known) == 2 and known(buf, start, end, hashes).tolist() == [0, 1, 0, -1, 1]


@pytest.mark.parametrize("turned", [False, True])
def test_long_words_that_used_to_share_a_hash(spark, turned):
    rows = [(i, w + tail) for i, (w, tail) in enumerate((w, t) for size in (1024, 2048) for w in twins(size) for t in ("", " and more words here"))]
    rows = rows[::-1] if turned else rows
    tok = Tokenizer.from_file(WORD_BPE)
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, rows).coalesce(1), WORD_BPE).collect()}
    counts = {r.doc_id: r.n_tokens for r in records.read(records.write(frame(spark, rows), WORD_BPE)).collect()}
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) and counts[i] == len(ids) + 1
    assert rows_of(jaccard.similar_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id")) == brute_components(rows)
    items = [(1, rows[0][1]), (2, rows[-1][1])]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(decontam.digest(decontam.decontaminate(frame(spark, rows), b))) == brute_hits(rows, items)


def test_tokens_keep_64_bits_at_every_partition_setting():
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    for bits in (4, 9, 16):
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
        names, cut = np.unique(bucket, return_index=True)
        cut = np.append(cut, len(h))
        packed = [(int(b), *jaccard._pack(h[x:y], bits), bytes(2 * (y - x))) for b, x, y in zip(names, cut[:-1], cut[1:], strict=True)]
        table = pa.table([pa.array(c) for c in zip(*packed, strict=True)], ["bucket", "counts", "middle", "low", "rows"])
        assert (jaccard._unpack(table)[0] == h).all()


def test_a_word_of_two_megabytes(spark):
    word = "".join(random.Random(3).choices("etaoinshrdlu", k=2 << 20))
    ids = Tokenizer.from_file(WORD_BPE).encode(word, add_special_tokens=False).ids
    r = bpe.round_trip(frame(spark, [(1, word)]), WORD_BPE).first()
    assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_columns_named_like_the_keys_stay(spark):
    rows = [(1, "a b c d e f", "mine", "m1", 5), (2, "a b c d e f", "mine2", "m2", 6), (3, "q r s", "mine3", None, 7), (4, None, None, "m4", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _text string, _row int")
    assert rows_of(jaccard.keep_one(df)) == sorted((rows[i] for i in (0, 2, 3)), key=repr)
    b = spark.createDataFrame([(1, "Q r s")], "item_id long, text string")
    assert rows_of(decontam.keep_clean(df, b)) == sorted((rows[i] for i in (0, 1, 3)), key=repr)


def test_long_items_go_in_pieces(spark):
    rng = random.Random(8)
    item = " ".join(f"t{rng.randrange(50)}" for _ in range(300))
    rows = [(i, " ".join(item.split()[i * 20 : i * 20 + 14 + i % 3])) for i in range(15)] + [(20, item)]
    b = spark.createDataFrame([(1, item), (2, " ".join(item.split()[:13]))], "item_id long, text string")
    want = brute_hits(rows, [(r.item_id, r.text) for r in b.collect()])
    for size in (32 * 40, 1 << 20):
        assert rows_of(decontam.digest(decontam.decontaminate(frame(spark, rows), b, query_bytes=size))) == want
