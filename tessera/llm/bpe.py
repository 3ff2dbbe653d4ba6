"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves' left ends; leaf i of the tree holds (rank << log2(leaves) | i) of the pair that starts at
symbol i, so the root holds the leftmost of the lowest-ranked pairs. A merge changes three leaves; each is carried to the
root in log2(leaves) steps; the word is done when the root holds no mergeable pair. Words of one size class are worked on
side by side, a tree each in one numpy array; very long ones, of which few fit into a run, one after the other.

Texts are cut at ASCII white space, which no piece of the supported tokenizers crosses; each distinct part of a block of
texts is encoded once. Normalising and splitting are the tokenizer's own components, so their Unicode tables are too.

Defined results: null and empty texts have no ids; any text encodes, as all bytes are symbols; repeated rows stay; other
columns of the input, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from .blocks import DIGESTED, NOT_SPACE, Rolling, blocks, byte_class, differing, gather_ranges, spans

NONE = np.int64(1 << 62)
#: Lanes of one lockstep run times leaves; keeps a run's trees in the processor's cache.
LANE_LEAVES = 1 << 17
#: Words of more leaves are worked on one by one: too few of them fit into a run to share its steps.
LONG = 1 << 13
#: Bytes of text in a block: more of them share their parts.
TEXT_BLOCK = 2 << 20
#: Parts made of these bytes alone hold no white space, control or special token and so need no care of their own.
_CLEAN = byte_class((0x21, 0x7E), (0x80, 0xBF), (0xC3, 0xC9))


class PairTable:
    """(left id, right id) -> merge rank by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(4 * len(left) + 1))))
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(1 << self.bits, -1, np.int64)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):  # each round, the first of those that want a free slot gets it
            free = self.keys[slot[todo]] == np.iinfo(np.uint64).max
            _, at = np.unique(np.where(free, slot[todo], -1 - todo), return_index=True)
            won = at[free[at]]
            self.keys[slot[todo[won]]], self.ranks[slot[todo[won]]] = key[todo[won]], todo[won]
            left_over = np.ones(len(todo), bool)
            left_over[won] = False
            todo = todo[left_over]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], -1)
        todo = np.flatnonzero((found != key) & (found != np.iinfo(np.uint64).max))
        slot, key = slot[todo], key[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot]
            hit = found == key
            out[todo[hit]] = self.ranks[slot[hit]]
            go = ~hit & (found != np.iinfo(np.uint64).max)
            todo, slot, key = todo[go], slot[go], key[go]
        return out


class SegmentTreeBPE:
    """A tokenizer file of kind BPE over bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.tokenizer = spec["model"], Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        self.normalizer: normalizers.Normalizer = self.tokenizer.normalizer
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        of_char = {shown.pre_tokenize_str(chr(b))[0][0][-1]: b for b in range(128)}  # a byte's stand-in character, where it is itself a text
        letters = {}
        for lead in range(0xC2, 0xF5):  # other bytes: from characters that hold them
            for c in {0xC2: range(0x80, 0xC0), 0xC3: range(0xC0, 0x100)}.get(lead, [{0xE0: 0x800, 0xF0: 0x10000}.get(lead, ((lead & 0x1F) << 6) if lead < 0xE0 else ((lead & 0xF) << 12) if lead < 0xF0 else ((lead & 7) << 18))]):
                if 0xD800 <= c < 0xE000:
                    continue
                for b, s in zip(chr(c).encode(), shown.pre_tokenize_str(chr(c))[0][0], strict=True):
                    letters[s] = b
        of_char |= letters
        self.first = np.full(256, -1, np.int64)
        self.last = np.full(256, -1, np.int64)
        for s, b in of_char.items():
            self.first[b], self.last[b] = vocab.get(s, -1), vocab.get(s + suffix, -1)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = PairTable(np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges]))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        size = max([*vocab.values(), *self.specials.values()]) + 1
        tokens = [b""] * size
        for t, i in [*vocab.items(), *self.specials.items()]:
            tokens[i] = t.encode()
        self.tokens = np.array(tokens, object)
        self.cache = PartCache()
        self.special_pattern = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")

    # -- one word after the other's merges, all words of a size class side by side

    def _lockstep(self, sym: np.ndarray, size: np.ndarray) -> None:
        """Merge the words in the rows of sym (ids; row r has size[r]) in place; what a merge swallows becomes -1."""
        lanes, leaves = sym.shape
        bits = leaves.bit_length() - 1
        inner = sym.ravel()
        at = np.arange(lanes * leaves)
        nxt, prev = at + 1, at - 1
        pos = np.arange(leaves)
        tree = np.full((lanes, 2 * leaves), NONE)
        has = pos[None, :-1] + 1 < size[:, None]
        rank = np.full(has.shape, -1, np.int64)
        rank[has] = self.rank(sym[:, :-1][has], sym[:, 1:][has])
        tree[:, leaves : 2 * leaves - 1] = np.where(rank >= 0, (rank << bits) | pos[:-1], NONE)
        level = leaves // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        flat = tree.ravel()

        def put(lane: np.ndarray, p: np.ndarray, value: np.ndarray | np.int64) -> None:
            node = p + leaves
            flat[lane * 2 * leaves + node] = value
            base = lane * 2 * leaves
            for _ in range(bits):
                node = node >> 1
                flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])

        lane = np.arange(lanes)
        while True:
            root = flat[lane * 2 * leaves + 1]
            lane, root = lane[root < NONE], root[root < NONE]
            if not len(lane):
                return
            p = root & (leaves - 1)
            at, end = lane * leaves + p, lane * leaves + size[lane]
            gone = nxt[at]
            inner[at], inner[gone] = self.merged[root >> bits], -1
            after, before = nxt[gone], prev[at]
            nxt[at] = after
            more = after < end
            prev[after[more]] = at[more]
            fresh = np.full(len(lane), NONE)
            r = self.rank(inner[at[more]], inner[after[more]])
            fresh[more] = np.where(r >= 0, (r << bits) | p[more], NONE)
            put(lane, gone - lane * leaves, NONE)
            put(lane, p, fresh)
            left = before >= lane * leaves
            r = self.rank(inner[before[left]], inner[at[left]])
            q = before[left] - lane[left] * leaves
            put(lane[left], q, np.where(r >= 0, (r << bits) | q, NONE))

    def _alone(self, sym: np.ndarray) -> None:
        """_lockstep for one word: the same tree, climbed only as far as a node's value changes."""
        n = len(sym)
        bits = (n - 1).bit_length()
        leaves = 1 << bits
        none = int(NONE)
        tree = array("q", [none]) * (2 * leaves)
        flat = np.frombuffer(tree, np.int64)
        rank = self.rank(sym[:-1], sym[1:])
        flat[leaves : leaves + n - 1] = np.where(rank >= 0, (rank << bits) | np.arange(n - 1), NONE)
        level = leaves // 2
        while level:
            flat[level : 2 * level] = np.minimum(flat[2 * level : 4 * level : 2], flat[2 * level + 1 : 4 * level : 2])
            level //= 2
        inner, nxt, prev = array("q", sym.tobytes()), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        merged, known = self.merged.tolist(), {}

        def key(a: int, b: int, i: int) -> int:
            r = known.get((a, b))
            if r is None:
                r = known[a, b] = int(self.rank(np.array([a]), np.array([b]))[0])
            return (r << bits) | i if r >= 0 else none

        def put(p: int, value: int) -> None:
            node = p + leaves
            while tree[node] != value:
                tree[node] = value
                if node == 1:
                    return
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1

        while (root := tree[1]) != none:
            p = root & (leaves - 1)
            gone = nxt[p]
            inner[p], inner[gone] = merged[root >> bits], -1
            after, before = nxt[gone], prev[p]
            nxt[p] = after
            put(gone, none)
            if after < n:
                prev[after] = p
                put(p, key(inner[p], inner[after], p))
            else:
                put(p, none)
            if before >= 0:
                put(before, key(inner[before], inner[p], before))
        sym[:] = np.frombuffer(inner, np.int64)

    def words(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one word after the other, number of ids of each word) of the byte ranges."""
        n = end - start
        total = np.concatenate([[0], np.cumsum(n)])
        flat = self.first[buf[gather_ranges(start, n)]]
        some = n > 0
        flat[total[1:][some] - 1] = self.last[buf[end[some] - 1]]
        leaves = np.where(n < 2, 0, 1 << np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64))
        for width in np.unique(leaves[leaves > 0]):
            mine = np.flatnonzero(leaves == width)
            if width > LONG:
                for w in mine.tolist():
                    self._alone(flat[total[w] : total[w + 1]])
                continue
            step = max(1, LANE_LEAVES // int(width))
            for lo in range(0, len(mine), step):
                w = mine[lo : lo + step]
                col = np.arange(width)
                inside = col[None, :] < n[w][:, None]
                at = (total[w][:, None] + col)[inside]
                sym = np.full(inside.shape, -1, np.int64)
                sym[inside] = flat[at]
                self._lockstep(sym, n[w])
                flat[at] = sym[inside]
        kept = flat >= 0
        counts = np.add.reduceat(np.append(kept, False), np.minimum(total[:-1], len(kept)), dtype=np.int64) if len(n) else np.zeros(0, np.int64)
        counts[~some] = 0
        return flat[kept], counts

    # -- texts

    def _pieces(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(UTF-8 bytes, starts, ends, number of blanks before) of the pieces of a normalised text without special tokens."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.flatnonzero((raw & 0xC0) != 0x80)
        char = np.append(char, len(raw))
        places = [x for _, x in self.split.pre_tokenize_str(text)]
        place = np.array(places, np.int64).reshape(-1, 2)
        start, end = char[place[:, 0]], char[place[:, 1]]
        return raw, start, end, np.searchsorted(np.flatnonzero(raw == 32), start)

    def _parts(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each part) of parts without ASCII white space."""
        size = end - start
        inside = gather_ranges(start, size)
        bad = ~_CLEAN[buf[inside]]
        bad |= (buf[inside] == 0x3C) | (buf[inside] == 0x7C)  # < and |, of special tokens
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        dirty = np.add.reduceat(bad, begin) > 0 if len(size) else np.zeros(0, bool)
        clean = np.flatnonzero(~dirty)
        raws, starts, ends, owners, base = [], [], [], [], 0
        fixed: list[tuple[int, int, int]] = []  # (part, place among its sections, special id)
        order: list[np.ndarray] = []

        def add(text: str, owner: int | np.ndarray, section: int) -> None:
            nonlocal base
            raw, s, e, blanks = self._pieces(text)
            raws.append(raw)
            starts.append(s + base)
            ends.append(e + base)
            owners.append(owner[blanks] if isinstance(owner, np.ndarray) else np.full(len(s), owner))
            order.append(np.full(len(s), section))
            base += len(raw)

        if len(clean):
            gap = np.full(int(size[clean].sum()) + len(clean), 32, np.uint8)
            to = np.concatenate([[0], np.cumsum(size[clean] + 1)[:-1]])
            gap[gather_ranges(to, size[clean])] = buf[gather_ranges(start[clean], size[clean])]
            text = self.normalizer.normalize_str(gap[:-1].tobytes().decode())
            if text.count(" ") == len(clean) - 1:
                add(text, clean, 0)
            else:
                dirty[:] = True
        for k in np.flatnonzero(dirty).tolist():
            text = buf[start[k] : end[k]].tobytes().decode("utf-8", "replace")
            lo, section = 0, 0
            for m in self.special_pattern.finditer(text):
                add(self.normalizer.normalize_str(text[lo : m.start()]), k, section)
                fixed.append((k, section + 1, self.specials[m[0]]))
                lo, section = m.end(), section + 2
            add(self.normalizer.normalize_str(text[lo:]), k, section)
        if not raws:
            return np.zeros(0, np.int64), np.zeros(len(size), np.int64)
        ids, n = self.words(np.concatenate(raws), np.concatenate(starts), np.concatenate(ends))
        owner, section = np.concatenate(owners), np.concatenate(order)
        if fixed:
            f = np.array(fixed, np.int64)
            ids, n = np.concatenate([ids, f[:, 2]]), np.concatenate([n, np.ones(len(f), np.int64)])
            owner, section = np.concatenate([owner, f[:, 0]]), np.concatenate([section, f[:, 1]])
        begin = np.cumsum(n) - n
        by = np.lexsort((section, owner))  # stable: pieces of a section stay in order
        ids = ids[gather_ranges(begin[by], n[by])]
        return ids, np.bincount(owner, weights=n, minlength=len(size)).astype(np.int64)

    def encode_block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts."""
        return encode_distinct(buf, off, self._parts, self.cache)

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(self.tokens[ids].tolist())


class PartCache:
    """Bytes and ids of short parts seen before, found by a hash and compared byte by byte; emptied when it would pass `most` parts. It saves time only."""

    def __init__(self, most: int = 2_000_000):
        self.most = most
        self.keys, self.ids, self.raw = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.begin, self.count, self.raw_begin, self.size = (np.zeros(0, np.int64) for _ in range(4))

    def find(self, keys: np.ndarray, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the key is, or -1; whether the bytes are the same there)."""
        if not len(self.keys):
            return np.full(len(keys), -1), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        same = known & (self.size[at] == size)
        k = np.flatnonzero(same)
        same[k] = ~differing(buf, start[k], self.raw, self.raw_begin[at[k]], size[k])
        return np.where(known, at, -1), same

    def add(self, keys: np.ndarray, raw: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Sorted keys that aren't there yet; the parts' bytes and ids lie one after the other."""
        if len(keys) + len(self.keys) > self.most:
            self.__init__(self.most)
        at = np.searchsorted(self.keys, keys)
        new = {"keys": keys, "begin": len(self.ids) + np.cumsum(count) - count, "count": count, "raw_begin": len(self.raw) + np.cumsum(size) - size, "size": size}
        for name, values in new.items():
            setattr(self, name, np.insert(getattr(self, name), at, values))
        self.ids, self.raw = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.raw, raw])


def encode_distinct(buf: np.ndarray, off: np.ndarray, encode, cache: PartCache | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of texts; encode(buf, starts, ends) -> (ids, counts) sees each distinct white-space-free part once.

    Parts of one hash are compared with the first of them, and with the cache's; those of other bytes are encoded by themselves.
    """
    cache = PartCache() if cache is None else cache
    start, end, row = spans(buf, off, NOT_SPACE)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    keys, first, part = np.unique(Rolling(buf).ranges(start, end), return_index=True, return_inverse=True)
    size = end - start
    other = size != size[first][part]
    k = np.flatnonzero(~other & (np.arange(len(part)) != first[part]))
    other[k] = differing(buf, start[k], buf, start[first[part[k]]], size[k])
    odd = np.flatnonzero(other)
    at, same = cache.find(keys, buf, start[first], size[first])
    todo = np.flatnonzero(~same)
    old = len(cache.ids)
    begin, count = np.zeros(len(keys) + len(odd), np.int64), np.zeros(len(keys) + len(odd), np.int64)
    hit = np.flatnonzero(same)
    begin[hit], count[hit] = cache.begin[at[hit]], cache.count[at[hit]]
    fresh, ids = np.concatenate([first[todo], odd]), cache.ids
    if len(fresh):
        new_ids, n = encode(buf, start[fresh], end[fresh])
        slots = np.concatenate([todo, len(keys) + np.arange(len(odd))])
        begin[slots], count[slots] = old + np.cumsum(n) - n, n
        ids = np.concatenate([ids, new_ids.astype(np.int32)])
        kept = todo[(at[todo] < 0) & (size[first[todo]] < DIGESTED)]
        cache.add(keys[kept], buf[gather_ranges(start[first[kept]], size[first[kept]])], size[first[kept]], ids[gather_ranges(begin[kept], count[kept])], count[kept])
    which = np.where(other, len(keys) + np.cumsum(other) - 1, part)
    total = np.bincount(row, weights=count[which], minlength=len(off) - 1).astype(np.int64)
    return ids[gather_ranges(begin[which], count[which])], np.concatenate([[0], np.cumsum(total)])


_models: dict[str, SegmentTreeBPE] = {}


def model(path: str) -> SegmentTreeBPE:
    """The tokenizer at path, loaded once by each worker."""
    if path not in _models:
        _models[path] = SegmentTreeBPE(path)
    return _models[path]


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in blocks(batches, "text", TEXT_BLOCK):
            ids, at = model(path).encode_block(buf, off)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


#: Bytes by kind, of texts whose pieces can be counted without the library: 1 letter, 2 digit, 3 other visible sign.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:0xC0] = _KIND[0xC3] = 1
_KIND[[0x27, 0x3C, 0x7C]] = 0  # apostrophes begin contractions; < and | begin special tokens


def library_parts(tok: Tokenizer):
    """encode_distinct's encoder by the library itself.

    Parts of ASCII and Latin-1 letters, digits and signs go as one text, whose ids are dealt back by the number of pieces
    in each part and the ends of words among the ids; all others go alone.
    """
    size = tok.get_vocab_size()
    ends = np.array([(tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def alone(raw: bytes, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
        parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        return [x.ids for x in tok.encode_batch_fast(parts, add_special_tokens=False)]

    def encode(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, n = buf.tobytes(), end - start
        first = np.cumsum(n) - n
        b = buf[gather_ranges(start, n)]
        kind = _KIND[b]
        odd = kind == 0
        odd[1:] |= (b[:-1] == 0xC3) & ((b[1:] == 0x97) | (b[1:] == 0xB7))  # the signs for times and divided by
        plain = np.add.reduceat(odd, first, dtype=np.int64) == 0
        new = np.ones(len(b), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        new[first] = True
        pieces = np.add.reduceat(new, first, dtype=np.int64)[plain]
        text = np.full(int(n[plain].sum()) + len(pieces), 32, np.uint8)
        text[gather_ranges(np.cumsum(n[plain] + 1) - n[plain] - 1, n[plain])] = b[np.repeat(plain, n)]
        ids = np.array(tok.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, np.int64)
        last = np.flatnonzero(ends[ids])
        if len(last) != pieces.sum():  # a file with other pieces than counted here
            plain[:] = False
            ids, last, pieces = ids[:0], last[:0], pieces[:0]
        count = np.zeros(len(n), np.int64)
        edge = np.concatenate([[-1], last])[np.cumsum(pieces)] if len(pieces) else last
        count[plain] = np.diff(edge, prepend=-1)
        rest = np.flatnonzero(~plain)
        if not len(rest):
            return ids, count
        others = alone(raw, start[rest], end[rest])
        count[rest] = [len(x) for x in others]
        out = np.zeros(int(count.sum()), np.int64)
        at = np.cumsum(count) - count
        out[gather_ranges(at[plain], count[plain])] = ids
        out[gather_ranges(at[rest], count[rest])] = np.fromiter(chain.from_iterable(others), np.int64)
        return out, count

    return encode


_libraries: dict[str, tuple] = {}


def library(path: str) -> tuple:
    """(encoder, cache, number of ids) of the library's tokenizer at path, kept by each worker."""
    if path not in _libraries:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _libraries[path] = library_parts(tok), PartCache(), tok.get_vocab_size()
    return _libraries[path]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text, of encode()'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [model(path).decode(np.array(x or [], np.int64)).decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of ids as little-endian uint32) and decoded_sha256, without moving ids between processes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for rows, buf, off in blocks(batches, "text", TEXT_BLOCK):
            ids, at = bpe.encode_block(buf, off)
            words, raw = bpe.tokens[ids], ids.astype("<u4")
            cut = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in cut]), pa.array([hashlib.sha256(b" ".join(words[a:b].tolist())).hexdigest() for a, b in cut]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
