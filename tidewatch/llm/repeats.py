"""Exact repeats of long byte strings by prefix-free parsing.

Parsing: a rolling hash over 16 bytes marks triggers; phrases run from trigger to trigger and overlap in them, so equal
stretches of text have equal phrases. Dictionary: the distinct phrases with their counts. A string of `length` bytes that
holds a phrase that occurs once in the corpus cannot repeat. Phrases of about 64 bytes rule out most positions; what is
left is parsed again into phrases of about 8 bytes, which leaves little but true repeats and their ends.

Order: a position is a pair of a suffix of the phrase that it lies in and the parse that follows. All positions of one
phrase end form a block; blocks with equal bytes up to `length` past their last position are neighbours in corpus
order over their whole extent, so one class name settles all of their positions. For blocks that stand alone (the ends
of a repeat), together with one block of each settled class that begins with the same trigger, positions are ordered:
in every shard the suffix arrays of its dictionary and of its parse combine into the order of its positions, and equal
neighbours are classes. Only equality to the depth `length` matters between shards, so their classes meet by a 128-bit
name of the first `length` bytes instead of a global rank: a rank would put all positions of a hot passage in one
range of a sort, while names are summed in each shard before they are dealt out.

Texts are dealt out once whole, and once more only for documents that still have open positions.

Defined results: a null or empty text has 0 bytes and loses none; texts shorter than `length` lose none; very long
texts are read whole; repeated rows are copies, so all of their strings of `length` bytes repeat; a null doc_id is a
document like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import forget, keyed, map_batches, tidy, written
from tidewatch.llm.shingles import mix, powers

LENGTH = 400
SLICE = 2_000_000
#: Text bytes whose phrases are counted before they are dealt out.
PHRASE_SLICE = 8_000_000
#: Text bytes of a shard whose open positions are ordered at once.
SHARD = 1_000_000
#: Bytes that are hashed at once, so that the arrays stay in a core's cache.
CHUNK = 1 << 17
_M = 0x9E3779B1
_RANDOM = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
_WIDE = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(powers(2)[1])
#: What takes a power of the base back to 1, and its own powers within a chunk.
_BACK = pow(_BASE, -1, 1 << 64)
_BACKS = np.cumprod(np.append(np.uint64(1), np.full(CHUNK - 1, _BACK, np.uint64)))


def shape(length: int) -> tuple[int, int, int, int]:
    """Bytes of a trigger, mean distances of triggers in the coarse and the fine parse, bytes that join blocks."""
    return (16, 64, 8, 48) if length >= 200 else (max(2, length // 8), max(2, length // 6), 2, length // 2)


def rolling(values: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash (32 bits) of every `gram` neighbouring values, by doubling."""
    n, part, size, out, done = len(values) - gram + 1, values, 1, None, 0
    power = lambda k: np.uint32(pow(_M, k, 1 << 32))
    while True:
        if gram & size:
            here = part[done : done + n]
            out = here if out is None else out + here * power(done)
            done += size
        if done >= gram:
            return out
        ahead = part[size:] * power(size)
        ahead += part[:-size]
        part, size = ahead, size * 2


def parses(raw: list[bytes], length: int, *aparts: int) -> list[list[np.ndarray]]:
    """Starts of the triggers of each text, for each mean distance. Triggers are the strings of least hash, so those of
    a larger distance are among those of a smaller one and all come from one pass."""
    gram = shape(length)[0]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw]).tolist()
    least, spots, hashes = np.uint32((1 << 32) // min(aparts)), [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
    for a in range(0, len(data) - gram + 1, CHUNK):
        h = rolling(_RANDOM[data[a : a + CHUNK + gram - 1]], gram)
        at = np.flatnonzero(h < least)
        spots.append(at + a)
        hashes.append(h[at])
    spot, hash_ = np.concatenate(spots), np.concatenate(hashes)
    out = []
    for apart in aparts:
        at = spot[hash_ < np.uint32((1 << 32) // apart)]
        cut = np.searchsorted(at, ends).tolist()
        own = [at[a:b] - (end - len(r)) for a, b, end, r in zip([0, *cut], cut, ends, raw, strict=False)]
        out.append([x[x + gram <= len(r)] for x, r in zip(own, raw, strict=True)])
    return out


def triggers(raw: list[bytes], length: int, apart: int) -> list[np.ndarray]:
    return parses(raw, length, apart)[0]


def phrase_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], starts and ends ascending: differences of a polynomial's sums, moved to power 0.
    A phrase that is taken for another one only leaves positions open, so no result hangs on these hashes."""
    low, high, so_far = np.empty(len(start), np.uint64), np.empty(len(end), np.uint64), np.uint64(0)
    chunks = range(0, len(data) + 1, CHUNK)
    for a in chunks:
        part = data[a : a + CHUNK]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_WIDE[part] * powers(CHUNK)[: len(part)], out=sums[1:])
        sums *= np.uint64(pow(_BASE, a, 1 << 64))
        sums += so_far
        so_far = sums[-1]
        for spots, out in ((start, low), (end, high)):
            i, j = np.searchsorted(spots, [a, a + CHUNK]).tolist()
            out[i:j] = sums[spots[i:j] - a]
    back = np.array([pow(_BACK, a, 1 << 64) for a in chunks], np.uint64)
    return mix((high - low) * _BACKS[start % CHUNK] * back[start // CHUNK])


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def inside(at: np.ndarray, ranges: list[tuple[int, int]] | None, length: int, gram: int) -> np.ndarray:
    """Numbers of the phrases (k: from trigger k to trigger k + 1) that meet a string starting in a range."""
    if len(at) < 2:
        return np.empty(0, np.int64)
    if ranges is None:
        return np.arange(len(at) - 1)
    a = np.array([x for x, _ in ranges], np.int64)
    b = np.array([y for _, y in ranges], np.int64) + length
    spot = np.searchsorted(b, at[:-1], "right")
    ok = spot < len(a)
    ok[ok] = a[spot[ok]] < at[1:][ok] + gram
    return np.flatnonzero(ok)


def _pairs(ranges: list | None) -> list[tuple[int, int]] | None:
    return None if ranges is None else sorted((r["a"], r["b"]) for r in ranges)


def _phrase_rows(length: int, apart: int):
    """Rows of three kinds w. 1: a phrase h that occurs once in the slice, at start s of document k. 2: a phrase that
    occurs more often in the slice, once for all. 0: the starts of such phrases in document k."""
    gram = shape(length)[0]

    def rows(cols: dict[str, list]) -> dict[str, list]:
        raw = [_bytes(t) for t in cols["text"]]
        ranges = cols.get("ranges") or [None] * len(raw)
        none = np.empty(0, np.int64)
        docs, starts, ends = [none], [none], [none]
        first = np.cumsum([0, *(len(r) for r in raw)])
        for d, (r, at, own) in enumerate(zip(raw, triggers(raw, length, apart), ranges, strict=True)):
            if len(r) >= length:
                n = inside(at, _pairs(own), length, gram)
                docs.append(np.full(len(n), d, np.int64))
                starts.append(at[n])
                ends.append(at[n + 1] + gram)
        d, s, e = np.concatenate(docs), np.concatenate(starts), np.concatenate(ends)
        h = phrase_hashes(np.frombuffer(b"".join(raw), np.uint8), s + first[d], e + first[d]).view(np.int64)
        k = np.array(cols["k"], np.int64)
        each, which, count = np.unique(h, return_inverse=True, return_counts=True)
        one, more = count[which] == 1, each[count > 1]
        cut = np.flatnonzero(np.diff(d[~one])) + 1
        lists = np.split(s[~one], cut) if not one.all() else []
        owners = d[~one][np.concatenate([[0], cut])] if lists else np.empty(0, np.int64)
        n, m, c = int(one.sum()), len(more), len(lists)
        return {
            "w": np.repeat(np.array([1, 2, 0], np.int32), [n, m, c]),
            "h": np.concatenate([h[one], more, np.zeros(c, np.int64)]),
            "k": np.concatenate([k[d[one]], np.zeros(m, np.int64), k[owners]]),
            "s": np.concatenate([s[one], np.zeros(m + c, np.int64)]).astype(np.int32),
            "own": [None] * (n + m) + lists,
        }

    return rows


def open_ranges(size: int, at: np.ndarray, repeated: np.ndarray | None, ranges: list[tuple[int, int]] | None, length: int) -> list[tuple[int, int]]:
    """Ranges of positions, within those given, whose strings hold no phrase that occurs once."""
    n = size - length + 1
    if n <= 0:
        return []
    gram = shape(length)[0]
    known = inside(at, ranges, length, gram)
    often = np.zeros(size + 1, bool)
    if repeated is not None:
        often[np.minimum(repeated, size)] = True
    once = known[~often[at[known]]]
    # Strings that hold such a phrase start at lo or later and before hi; both ascend, so what is free lies between them.
    lo, hi = np.maximum(at[once + 1] + gram - length, 0), np.minimum(at[once] + 1, n)
    ok = lo < hi
    a, b = np.append(0, hi[ok]), np.append(lo[ok], n)
    ok = a < b
    free = list(zip(a[ok].tolist(), (b[ok] - 1).tolist(), strict=True))
    if ranges is None:
        return free
    out, k = [], 0
    for x, y in ranges:
        while k < len(free) and free[k][1] < x:
            k += 1
        j = k
        while j < len(free) and free[j][0] <= y:
            out.append((max(free[j][0], x), min(free[j][1], y)))
            j += 1
    return out


def pieces(data: bytes, at: np.ndarray, ranges: list[tuple[int, int]], length: int) -> tuple[np.ndarray, np.ndarray, list[int], list[bytes]]:
    """First and last positions, hashes of the bytes at the first trigger or 0, class names: open ranges cut at triggers."""
    near = shape(length)[3]
    a, b = np.array(ranges, np.int64).reshape(-1, 2).T
    first = np.searchsorted(at, a)
    size = np.searchsorted(at, b) - first + 1
    head = np.cumsum(size) - size
    start = np.append(at, 1 << 60)[np.arange(size.sum()) + np.repeat(first - head, size)]
    j = start.copy()
    j[head + size - 1] = b
    i = np.roll(j, 1) + 1
    i[head] = a
    # Positions from which the joining bytes lie beyond the string have no key.
    far = np.minimum(np.maximum(i, start - length + near), j + 1)
    x, y = np.stack([i, far], 1).ravel(), np.stack([far - 1, j], 1).ravel()
    spot = np.stack([np.full(len(start), -1), start], 1).ravel()
    ok = x <= y
    x, y, spot = x[ok], y[ok], spot[ok]
    keys = [xxhash.xxh3_64_intdigest(data[s : s + near]) >> 1 | 1 if s >= 0 else 0 for s in spot.tolist()]
    return x, y, keys, [xxhash.xxh3_128_digest(data[s:e]) for s, e in zip(x.tolist(), (y + length).tolist(), strict=True)]


def joined_places(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (text, first, last) of the places from a to b of texts d, in order, where one begins as another ends."""
    new = np.append(True, (d[1:] != d[:-1]) | (a[1:] != b[:-1] + 1))[: len(d)]
    return d[new], a[new], b[np.append(new[1:], True)[: len(d)]]


_RANGES = "array<struct<a: int, b: int>>"


def _parse_rows(length: int):
    coarse = shape(length)[1]

    def rows(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: cols[c] for c in ("doc_id", "kd", "kh", "k")} | {"n_bytes": [], "sha": [], "text": [], "ranges": []}
        raw = [_bytes(t) for t in cols["text"]]
        for text, r, at, seen in zip(cols["text"], raw, triggers(raw, length, coarse), cols["seen"], strict=True):
            found = open_ranges(len(r), at, seen, None, length)
            out["n_bytes"].append(len(r))
            out["sha"].append(None if found else hashlib.sha256(r).hexdigest())
            out["text"].append(text if found else None)
            out["ranges"].append([{"a": a, "b": b} for a, b in found])
        return out

    return rows


def _piece_rows(length: int):
    """Blocks of the slice, one row for each name with its number n in the slice: a block that is alone here, or one that
    stands for all; and runs of positions that are settled in the slice, without a name."""
    _, coarse, fine, _ = shape(length)

    def rows(cols: dict[str, list]) -> dict[str, list]:
        raw = [_bytes(t) for t in cols["text"]]
        cuts = parses(raw, length, max(2, coarse // 2), fine)
        none = np.empty(0, np.int64)
        owners, firsts, lasts, keys, found = [none], [none], [none], [], []
        for d, (r, at, small, seen, ranges) in enumerate(zip(raw, *cuts, cols["seen"], cols["ranges"], strict=True)):
            left = open_ranges(len(r), small, seen, _pairs(ranges), length)
            if left:
                x, y, key, name = pieces(r, at, left, length)
                owners.append(np.full(len(x), d, np.int64))
                firsts.append(x)
                lasts.append(y)
                keys += key
                found += name
        owner, a, b = np.concatenate(owners), np.concatenate(firsts), np.concatenate(lasts)
        number: dict[bytes, int] = {}
        own = np.array([number.setdefault(name, len(number)) for name in found], np.int64)
        one, count = np.unique(own, return_index=True)[1], np.bincount(own)
        settled = count[own] > 1
        d, x, y = joined_places(owner[settled], a[settled], b[settled])
        who, blank = np.append(owner[one], d), [None] * len(d)
        return {
            "name": [*number, *blank],
            "kd": np.array(cols["kd"], np.int64)[who],
            "kh": np.array(cols["kh"], np.int64)[who],
            "a": np.append(a[one], x),
            "b": np.append(b[one], y),
            "h": [keys[k] for k in one.tolist()] + blank,
            "n": count.tolist() + blank,
        }

    return rows


def _ranks(parse: np.ndarray, depth: int) -> np.ndarray:
    """Suffix ranks of the parse to a depth in phrases, by prefix doubling: its suffix array, inverted."""
    rank, k = np.unique(parse, return_inverse=True)[1].astype(np.int64) + 1, 1
    while k < depth and k < len(rank):
        ahead = np.concatenate([rank[k:], np.zeros(min(k, len(rank)), np.int64)])
        rank = np.unique(rank * (len(rank) + 1) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        k *= 2
    return rank


def shard_order(raw: list[bytes], places: list[np.ndarray], length: int) -> tuple[np.ndarray, list[bool]]:
    """Corpus order of some positions (text, start) of a shard's texts, and whether each equals the one before to the depth `length`.

    Phrases run from trigger to trigger; the dictionary is sorted, the parse is its ranks. A position is its phrase
    suffix, up to and with the next trigger string, and the parse after it: no such suffix is a prefix of another, so
    ordering by the suffix array of the dictionary (of the suffixes that are asked for), then by that of the parse, is
    the order of the corpus.
    """
    gram, coarse, _, _ = shape(length)
    cuts, heads, number, parse = [], [], {}, []
    for r, at in zip(raw, triggers(raw, length, coarse), strict=True):
        heads.append(len(parse))
        cuts.append(at)
        last = 0
        for c in at.tolist():
            parse.append(number.setdefault(r[last : c + gram], len(number)))
            last = c
        parse += [number.setdefault(r[last:], len(number)), -1]
    spot = {phrase: k for k, phrase in enumerate(sorted(number))}
    by_id = np.array([spot[p] for p in number] + [-1], np.int64)
    after = _ranks(by_id[np.array(parse, np.int64)], length)
    none = np.empty(0, np.int64)
    owners, starts, follows, tail = [none], [none], [none], []
    for d, (r, at) in enumerate(zip(raw, places, strict=True)):
        nxt = np.searchsorted(cuts[d], at)
        ends = np.append(cuts[d] + gram, len(r))[nxt]
        long_ = ends - at >= length
        owners.append(np.full(len(at), d, np.int64))
        starts.append(at)
        follows.append(np.where(long_, 0, after[heads[d] + nxt + 1]))
        tail += [r[i:e] for i, e in zip(at.tolist(), np.where(long_, at + length, ends).tolist(), strict=True)]
    place = {t: k for k, t in enumerate(sorted(set(tail)))}
    order = np.lexsort((np.concatenate(follows), np.array([place[t] for t in tail], np.int64)))
    owner, start = np.concatenate(owners)[order], np.concatenate(starts)[order]
    strings = (raw[d][i : i + length] for d, i in zip(owner.tolist(), start.tolist(), strict=True))
    same = [False, *(x == y for x, y in pairwise(strings))][: len(order)]
    return np.stack([owner, start], 1), same


def _window_rows(length: int):
    """Classes of equal positions in the shard: name x and number n, with the place of a position that is alone; and
    runs of positions that are settled in the shard, without a name."""

    def rows(cols: dict[str, list]) -> dict[str, list]:
        raw = [_bytes(t) for t in cols["text"]]
        places, weights = [], []
        for todo in cols["todo"]:
            spans = sorted((p["a"], p["b"], p["w"]) for p in todo)
            places.append(np.concatenate([np.arange(a, b + 1) for a, b, _ in spans]))
            weights.append(np.repeat([w for _, _, w in spans], [b - a + 1 for a, b, _ in spans]))
        if not places:
            return {c: [] for c in ("x", "kd", "kh", "a", "b", "n")}
        order, same = shard_order(raw, places, length)
        d, i = order.T
        # Positions ascend in each text, so the number of one is found by its place.
        all_ = np.concatenate([p | k << 32 for k, p in enumerate(places)])
        w = np.concatenate(weights)[np.searchsorted(all_, i | d << 32)]
        first = np.flatnonzero(~np.array(same, bool))
        size = np.diff(np.append(first, len(d)))
        xs = [xxhash.xxh3_128_digest(raw[k][s : s + length]) for k, s in order[first].tolist()]
        # A position alone in the shard is one row that serves both ends; those of a class of more are settled.
        single = (size == 1) & (w[first] == 1)
        done = np.repeat(size > 1, size) & (w == 1)
        settled = np.sort(i[done] | d[done] << 32)
        e, a, b = joined_places(settled >> 32, settled & 0xFFFFFFFF, settled & 0xFFFFFFFF)
        no = np.append(~single, np.zeros(len(e), bool))
        who = np.append(d[first], e)
        may = lambda values: np.ma.MaskedArray(values, no)
        return {
            "x": xs + [None] * len(e),
            "kd": may(np.array(cols["kd"], np.int64)[who]),
            "kh": may(np.array(cols["kh"], np.int64)[who]),
            "a": may(np.append(i[first], a)),
            "b": may(np.append(i[first], b)),
            "n": np.append(np.add.reduceat(w, first), np.zeros(len(e), np.int64)),
        }

    return rows


def joined_runs(runs: np.ndarray | None, length: int) -> list[tuple[int, int]]:
    """Byte spans that strings starting in runs (first position in the upper half of a long, last in the lower) cover."""
    if runs is None or not len(runs):
        return []
    v = np.unique(runs)
    a, b = v >> 32, np.maximum.accumulate((v & 0xFFFFFFFF) + length)
    cut = np.flatnonzero(a[1:] > b[:-1])
    return list(zip(a[np.concatenate([[0], cut + 1])].tolist(), b[np.append(cut, len(b) - 1)].tolist(), strict=True))


def _kept_rows(length: int):
    def rows(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
        for text, sha, runs in zip(cols["text"], cols["sha"], cols["runs"], strict=True):
            merged = joined_runs(runs, length)
            if text is not None:
                raw, end, digest = _bytes(text), 0, hashlib.sha256()
                for a, b in merged:
                    digest.update(raw[end:a])
                    end = b
                digest.update(raw[end:])
                sha = digest.hexdigest()
            out["n_removed"].append(sum(b - a for a, b in merged))
            out["n_spans"].append(len(merged))
            out["kept_sha256"].append(sha)
            out["spans"].append([{"start": a, "end": b} for a, b in merged])
        return out

    return rows


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def _often(texts: DataFrame, length: int, apart: int) -> DataFrame:
    """k, seen: starts of the phrases that occur twice or more. Phrases that a slice repeats are settled in the slice, so
    a hot passage is a row for each slice and not for each document that holds it."""
    found = written(map_batches(texts, _phrase_rows(length, apart), "w int, h long, k long, s int, own array<int>", "text", PHRASE_SLICE))
    often = found.where("w > 0").groupBy("h").agg(F.sum("w").alias("n")).where("n > 1").select("h")
    far = found.where("w = 1").select("h", "k", "s").join(often, "h", "left_semi").groupBy("k").agg(F.collect_list("s").alias("far"))
    near = found.where("w = 0").groupBy("k").agg(F.flatten(F.collect_list("own")).alias("near"))
    none = F.expr("cast(array() AS array<int>)")
    seen = written(far.join(near, "k", "full").select("k", F.concat(F.coalesce("far", none), F.coalesce("near", none)).alias("seen")))
    forget(found)
    return seen


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of docs with the byte spans that strings of `length` bytes found elsewhere cover."""
    _, coarse, fine, _ = shape(length)
    docs = keyed(docs).withColumn("k", F.xxhash64("kd", "kh"))
    seen = _often(docs.select("k", "text"), length, coarse)
    joined = docs.join(seen, "k", "left").select("doc_id", "kd", "kh", "k", "text", "seen")
    parsed = written(map_batches(joined, _parse_rows(length), f"doc_id long, kd long, kh long, k long, n_bytes long, sha string, text string, ranges {_RANGES}", "text", SLICE, ("seen",)))
    forget(seen)
    some = parsed.where("text IS NOT NULL")
    seen = _often(some.select("k", "text", "ranges"), length, fine)
    joined = some.join(seen, "k", "left").select("kd", "kh", "text", "ranges", "seen")
    blocks = written(map_batches(joined, _piece_rows(length), "name binary, kd long, kh long, a int, b int, h long, n int", "text", SLICE, ("seen",)))
    forget(seen)
    # Any block of a class stands for it: their bytes are equal.
    sums = blocks.where("name IS NOT NULL").groupBy("name").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("kd", "kh", "a", "b", "h")))
    classes = written(sums)
    alone = classes.where("n = 1")
    others = classes.where("n > 1").join(alone.select("h").distinct(), "h", "left_semi")
    todo = alone.select("kd", "kh", "a", "b", F.lit(1).alias("w")).union(others.select("kd", "kh", "a", "b", F.lit(2).alias("w")))
    todo = todo.groupBy("kd", "kh").agg(F.collect_list(F.struct("a", "b", "w")).alias("todo"))
    texts = some.select("kd", "kh", "text").join(todo, ["kd", "kh"])
    windows = written(map_batches(texts, _window_rows(length), "x binary, kd long, kh long, a int, b int, n long", "text", SHARD))
    shards = windows.where("x IS NOT NULL")
    twice = shards.groupBy("x").agg(F.sum("n").alias("n")).where("n > 1").select("x")
    single = shards.where("a IS NOT NULL").join(twice, "x", "left_semi").select("kd", "kh", "a", "b")
    whole = blocks.where("n = 1").join(classes.where("n > 1").select("name"), "name", "left_semi").select("kd", "kh", "a", "b")
    local = blocks.where("name IS NULL").select("kd", "kh", "a", "b").union(windows.where("x IS NULL").select("kd", "kh", "a", "b"))
    runs = whole.union(single).union(local)
    runs = runs.groupBy("kd", "kh").agg(F.collect_list(F.expr("shiftleft(cast(a AS long), 32) | b")).alias("runs"))
    # Documents without open positions are finished and pass by the join.
    closed = parsed.where("text IS NULL").select("doc_id", "n_bytes", "text", "sha", F.expr("cast(NULL AS array<long>)").alias("runs"))
    open_ = some.join(runs, ["kd", "kh"], "left").select("doc_id", "n_bytes", "text", "sha", "runs")
    tidy(docs.sparkSession)
    return map_batches(closed.union(open_), _kept_rows(length), RESULT, "text", numbers=("runs",))
