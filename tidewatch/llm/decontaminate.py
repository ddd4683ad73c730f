"""Benchmark decontamination by suffix arrays over the training text.

Each bounded slice of a partition is a shard. Its documents become one sequence of word numbers, and a suffix array of
it, to the depth of a window, is built (sparse: suffixes whose first two words stand together nowhere in the benchmark
can match nothing of two words or more and are left out). Every benchmark suffix is then binary-searched in the shard's
array, one word deeper at a time, all suffixes at once: that gives its longest verbatim match and the locations. A
suffix that reaches the window's length marks its locations as hit, and the search goes on past the window, a word at a
time over the suffixes that are left, until no benchmark suffix goes further: that is the longest verbatim match of each
location. Shards need no exchange, so there is no shuffle.

The benchmark is the stated query set: it goes to the workers in blocks of a bounded number of words, one pass for each
block; between passes the result so far is written, so one block is held at once and any benchmark fits. Training documents are read whole and none is left out.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. An item's windows are its runs of 10
words; an item of fewer words is one window.

Defined results: null and empty texts have no words, so no hits; repeated rows each get a row; items without words are
ignored, repeated items count once by id; an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_batches, written

WINDOW = 10
#: Benchmark words that one pass hands to the workers.
BLOCK_WORDS = 2_000_000
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c <= 96 or 123 <= c <= 127 else c for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8; all separators are ASCII, so splitting bytes is exact."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Block:
    """Benchmark items prepared for search."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        at: dict[bytes, int] = {}
        owners: list[set[str]] = []
        rows: list[np.ndarray] = []
        places: list[list[int]] = []
        whole: list[int] = []
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                row = np.array(ids[i : i + window], np.int64)
                k = at.setdefault(row.tobytes(), len(rows))
                if k == len(rows):
                    rows.append(row)
                    owners.append(set())
                    places.append([])
                owners[k].add(item)
                places[k].append(len(whole) + i)
            whole += [*ids, -2]
        #: All items, each ended by -2, and where each window stands in them.
        self.whole = np.array(whole, np.int64)
        self.places = [np.array(p, np.int64) for p in places]
        self.owners = [sorted(o) for o in owners]
        self.length = np.array([len(r) for r in rows], np.int64)
        self.queries = np.full((len(rows), window), -1, np.int64)
        for i, r in enumerate(rows):
            self.queries[i, : len(r)] = r
        v = len(self.number)
        two = self.queries[self.length >= 2]
        self.pairs = np.unique(two[:, 0] * v + two[:, 1]) if len(two) else np.empty(0, np.int64)
        self.single = np.unique(self.queries[self.length == 1, 0]) if len(rows) else np.empty(0, np.int64)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For a shard of word numbers (-1: not in the benchmark, or a document's end).

        Gives the suffix array, and for each query the longest match in words and its interval of the array.
        """
        n, v, w = len(text), len(self.number), self.window
        padded = np.concatenate([text, np.full(w, -1, np.int64)])
        first, second = padded[:n], padded[1 : n + 1]
        key = np.where((first >= 0) & (second >= 0), first * v + second, -1)
        able = np.zeros(n, bool)
        if len(self.pairs):
            spot = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            able = self.pairs[spot] == key
        if len(self.single):
            able |= np.isin(first, self.single)
        at = np.flatnonzero(able)
        columns = [padded[at + d] for d in range(w)]
        order = np.lexsort(columns[::-1])
        suffixes = at[order]
        group = np.zeros(len(suffixes), np.int64)  # number of the suffix's first d words, ascending
        mine = np.zeros(len(self.queries), np.int64)
        lo, hi = np.zeros(len(mine), np.int64), np.full(len(mine), len(suffixes), np.int64)
        longest, live = np.zeros(len(mine), np.int64), np.ones(len(mine), bool)
        for d in range(w):
            column = columns[d][order] + 1
            keys = group * (v + 1) + column
            q = np.flatnonzero(live & (self.length > d))
            if not len(q) or not len(suffixes):
                break
            wanted = mine[q] * (v + 1) + self.queries[q, d] + 1
            a, b = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
            ok = b > a
            live[q[~ok]] = False
            q, a, b = q[ok], a[ok], b[ok]
            lo[q], hi[q], longest[q] = a, b, d + 1
            new = np.concatenate([[0], np.cumsum(np.diff(keys) != 0)])
            mine[q], group = new[a], new
        return suffixes, longest, lo, hi


    def deepen(self, text: np.ndarray, found: list[tuple[int, np.ndarray]]) -> dict[int, int]:
        """Longest verbatim match in words of each location of full windows: found has a window's number and its
        locations in the shard. Locations and benchmark suffixes that have the same words so far are a group; each round
        reads one word more of both and keeps the groups that go on."""
        depth = {int(p): len(self.queries[q][self.queries[q] >= 0]) for q, at in found for p in at}
        full = [(q, at) for q, at in found if self.length[q] == self.window]
        if not full:
            return depth
        p = np.concatenate([at for _, at in full]).astype(np.int64)
        g = np.repeat(np.arange(len(full)), [len(at) for _, at in full])
        b = np.concatenate([self.places[q] for q, _ in full])
        h = np.repeat(np.arange(len(full)), [len(self.places[q]) for q, _ in full])
        d, v = self.window, len(self.number) + 3
        while len(p) and len(b):
            here = g * v + np.where(p + d < len(text), text[np.minimum(p + d, len(text) - 1)], -1) + 2
            there = h * v + np.where(b + d < len(self.whole), self.whole[np.minimum(b + d, len(self.whole) - 1)], -2) + 2
            # A word that isn't in the benchmark is -1 in the shard, an item's end -2 in the benchmark: they meet nothing.
            groups = np.intersect1d(here[(here - 2) % v < v - 2], there[there % v != 0])
            on, off = np.isin(here, groups), np.isin(there, groups)
            p, g = p[on], np.searchsorted(groups, here[on])
            b, h = b[off], np.searchsorted(groups, there[off])
            d += 1
            depth.update(dict.fromkeys(p.tolist(), d))
        return depth


def read_shard(texts: list[str | None], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each followed by -1, and where each text starts (with the end)."""
    parts, starts, at = [], [0], 0
    get = number.get
    for t in texts:
        w = words(t)
        at += len(w) + 1
        parts.append(np.fromiter((get(x, -1) for x in w), np.int64, len(w)))
        parts.append(np.array([-1]))
        starts.append(at)
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), np.array(starts, np.int64)


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[Block]:
    items: list[tuple[str, str | None]] = []
    size, first = 0, True
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    for r in rows.toLocalIterator():
        items.append((r["i"] or "", r["t"]))
        size += len(words(r["t"]))
        if size >= most:
            yield Block(items)
            items, size, first = [], 0, False
    if items or first:
        yield Block(items)


_SPANS = "array<struct<start: long, end: long>>"


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    block_words: int = BLOCK_WORDS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans of hit words (merged), items that occur, longest verbatim match
    (of any length, from two words on), the longest one that holds a window with its first place, and the columns `keep`."""
    spark = docs.sparkSession
    kept = ", ".join(f"`k_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"doc_id long, text string, n_words long, spans {_SPANS}, items array<string>, longest long, longest_hit long, longest_at long" + (kept and f", {kept}")
    out = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.expr(f"cast(array() as {_SPANS})").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
        F.lit(0).cast("long").alias("longest"),
        F.lit(0).cast("long").alias("longest_hit"),
        F.lit(None).cast("long").alias("longest_at"),
        *(F.col(f"`{c}`").alias(f"k_{c}") for c in keep),
    )
    shared = None
    for block in _blocks(benchmark, item_col, text_col, block_words):
        if shared:
            out = written(out)
            shared.unpersist()
        shared = spark.sparkContext.broadcast(block)

        def rows(cols: dict[str, list], shared=shared) -> dict[str, list]:
            b: Block = shared.value
            ids, starts = read_shard(cols["text"], b.number)
            suffixes, longest, lo, hi = b.search(ids)
            doc_of = np.searchsorted(starts, suffixes, "right") - 1
            spans: list[list[tuple[int, int]]] = [[] for _ in cols["doc_id"]]
            items: list[set[str]] = [set(i) for i in cols["items"]]
            full = np.flatnonzero((longest == b.length) & (longest > 0)).tolist()
            for q in full:
                for k in range(lo[q], hi[q]):
                    d = int(doc_of[k])
                    s = int(suffixes[k] - starts[d])
                    spans[d].append((s, s + int(b.length[q])))
                    items[d].update(b.owners[q])
            depth = np.zeros(len(suffixes), np.int64)
            for q in np.argsort(longest, kind="stable").tolist():
                depth[lo[q] : hi[q]] = longest[q]
            most = np.array(cols["longest"], np.int64)
            np.maximum.at(most, doc_of, depth)
            best, where = list(cols["longest_hit"]), list(cols["longest_at"])
            for p, n in sorted(b.deepen(ids, [(q, suffixes[lo[q] : hi[q]]) for q in full]).items()):
                d = int(np.searchsorted(starts, p, "right")) - 1
                if n > best[d]:
                    best[d], where[d] = n, p - int(starts[d])
            old = [[(s["start"], s["end"]) for s in x] for x in cols["spans"]]
            merged: list[list[dict[str, Any]]] = [
                [{"start": s, "end": e} for s, e in _merge(x, y)] for x, y in zip(old, spans, strict=True)
            ]
            return {
                **cols, "n_words": (np.diff(starts) - 1).tolist(), "spans": merged,
                "items": [sorted(i) for i in items], "longest": np.maximum(most, best).tolist(), "longest_hit": best, "longest_at": where,
            }

        out = map_batches(out, rows, schema, "text")
    return out


def digest_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts and digests of the hits in every document."""
    return find_hits(docs, benchmark).select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "longest_hit",
        "longest_at",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with the columns of docs."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    clean = find_hits(docs, benchmark, keep=rest).where(F.size("spans") == 0)
    return clean.select(*(F.col(f"`k_{c}`").alias(c) if c in rest else F.col(c) for c in docs.columns))
