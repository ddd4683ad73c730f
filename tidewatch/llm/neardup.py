"""Near duplicates by BagMinHash.

A document is the multiset of its 5-word shingles. Each (shingle, weight) is a hierarchy of Poisson processes over the
discretised weight axis: the level for (0, 1] has rate 1, the level for (2^(j-1), 2^j] has rate 2^(j-1). A point has a
time, a register and a place on the weight axis; it counts if its place is below the weight. Each of 128 registers
keeps its earliest point, so two documents agree in a register with probability equal to their weighted Jaccard
similarity. Bands of 4 registers give candidates; a pair is a link if the exact multiset overlap (sum of minima over
sum of maxima) is 0.8 or more. Classes are the connected components of the links.

Copies never make pairs: documents of one multiset are one node. Every bucket has a hub, the member whose buckets are
largest in sum: the text that a family of copies was made from shares most bands with all of them. A node is compared
with the hub that it shares most bands with. Buckets that still hold more than one component are gathered to clusters
(components over shared buckets), and within a cluster all nodes of different components are compared in blocks: a task
gets two blocks of bounded size, multiplies their shingle incidence matrices, which gives all overlaps exactly, and
returns links only. Blocks that lie in a cluster's largest component aren't compared with each other. So no link
between candidates is lost, no bucket is capped, and no group's pairs are listed.
A pair at similarity s shares a band with probability 1 - (1 - s^4)^32: over 0.9999999 from 0.8 on.

Defined results: a null or empty text, or one without words, is in a class of its own; a text of under 5 words is one
shingle; very long texts are read whole; repeated rows are copies; a null doc_id is a document like others (its class
id is the least non-null id, else null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import keyed, map_batches, written
from tidewatch.llm.shingles import mix, shingle, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
#: Members and shingles of a block of a cluster, and shingles that are multiplied at once.
BLOCK, BLOCK_ITEMS, COLUMNS = 256, 400_000, 8192
#: Text bytes that are hashed at once.
SLICE = 1_500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_U = [np.uint64(x) for x in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03)]


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def bag(text_shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(text_shingles, return_counts=True)


def signature(items: np.ndarray, weights: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """BagMinHash registers (64 bits each) of a multiset; items are distinct hashes, weights whole numbers from 1."""
    seeds, rates, lows, caps = [mix(items ^ _U[0])], [np.ones(len(items))], [np.zeros(len(items))], [weights]
    low, level = 1.0, 1
    while (more := weights > low).any():
        n = int(more.sum())
        seeds.append(mix(items[more] ^ mix(np.array([level], np.uint64) + _U[0])))
        rates.append(np.full(n, low))
        lows.append(np.full(n, low))
        caps.append(weights[more])
        low, level = low * 2, level + 1
    seed, rate, low_, cap = map(np.concatenate, (seeds, rates, lows, caps))
    limit = 7.0 * m / float(weights.sum())
    first = -np.log(_uniform(mix(seed + _GOLD))) / rate
    while True:
        on = first < limit
        s, r, lo, c = seed[on], rate[on], low_[on], cap[on]
        if len(s):
            mean = float(r.max()) * limit
            k = int(mean + 7 * mean**0.5 + 9)
            while True:
                step = s[:, None] + _GOLD * np.arange(1, k + 1, dtype=np.uint64)
                drawn = mix(step)
                t = np.cumsum(-np.log(_uniform(drawn)), axis=1) / r[:, None]
                if (t[:, -1] >= limit).all():
                    break
                k *= 2
            ok = t < limit
            if (lo > 0).any():
                place = np.where(lo[:, None] > 0, lo[:, None] * (1 + _uniform(mix(drawn ^ _U[1]))), 0.0)
                ok &= place < c[:, None]
            times, points = t[ok], drawn[ok]
            order = np.argsort(times, kind="stable")
            register = (mix(points[order] ^ _U[2]) % np.uint64(m)).astype(np.int64)
            found, at = np.unique(register, return_index=True)
            if len(found) == m:
                return points[order][at]
        limit *= 2


def bands(sig: np.ndarray) -> np.ndarray:
    """A hash of each band's registers and its number."""
    x = sig.reshape(-1, ROWS)
    h = np.arange(1, len(x) + 1, dtype=np.uint64) * _GOLD
    for i in range(ROWS):
        h = mix(h ^ x[:, i]) + _U[0]
    return h


def coded(text_shingles: np.ndarray) -> np.ndarray:
    """The multiset as a set: the n-th copy of a shingle is an item of its own. Sorted, so overlaps are intersections."""
    s = np.sort(text_shingles)
    if not len(s):
        return s
    first = np.concatenate([[True], s[1:] != s[:-1]])
    copy = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    return np.sort(np.where(copy > 0, mix(s + copy.astype(np.uint64) * _GOLD), s))


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two coded bags."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return min(len(x), len(y)) / max(len(x), len(y), 1)  # an upper bound, below the threshold
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same / (len(x) + len(y) - same) if len(x) else 0.0


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Similarities of all pairs of two lists of coded bags, by multiplying incidence matrices a stretch of shingles at
    a time; shingles of one bag alone are left out, as they add to no overlap."""
    bags = left + right
    sizes = np.array([len(x) for x in bags], np.int64)
    owner = np.repeat(np.arange(len(bags)), sizes)
    _, column, count = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
    shared = count > 1
    ok = shared[column]
    owner, column = owner[ok], (np.cumsum(shared) - 1)[column[ok]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    same = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((len(bags), COLUMNS), np.float32)
        x[owner[a:b], column[a:b] - at] = 1.0
        same += x[: len(left)] @ x[len(left) :].T
    total = sizes[: len(left), None] + sizes[None, len(left) :] - same
    return same / np.maximum(total, 1)


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between nodes of different components in two blocks: one for each node and other component."""
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    left = pdf[pdf["block"] == i]
    right = pdf[pdf["block"] == j]
    read = lambda x: [np.frombuffer(b, np.uint64) for b in x["bag"]]
    near = overlaps(read(left), read(right)) >= THRESHOLD if len(left) and len(right) else np.zeros((0, 0), bool)
    (an, ac), (bn, bc) = ((x["node"].tolist(), x["comp"].tolist()) for x in (left, right))
    out, seen = [], set()
    for r, c in zip(*np.nonzero(near), strict=True):
        if ac[r] != bc[c] and (an[r], bc[c]) not in seen:
            seen.add((an[r], bc[c]))
            out.append((an[r], bn[c]))
    return pd.DataFrame(out, columns=["a", "b"])


def _signed(cols: dict[str, list]) -> dict[str, list]:
    words, at = word_hashes(cols["text"])
    out: dict[str, list] = {"doc_id": cols["doc_id"], "kd": cols["kd"], "kh": cols["kh"], "n": [], "node": [], "bands": []}
    for i in range(len(at) - 1):
        s = np.sort(shingle(words[at[i] : at[i + 1]], SHINGLE))
        out["n"].append(len(s))
        if not len(s):
            out["node"].append(None)
            out["bands"].append(None)
            continue
        out["node"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
        out["bands"].append(bands(signature(*bag(s))).tobytes())
    return out


def _bags(cols: dict[str, list]) -> dict[str, list]:
    words, at = word_hashes(cols["text"])
    return {"node": cols["node"], "bag": [coded(shingle(words[a:b], SHINGLE)).tobytes() for a, b in zip(at, at[1:], strict=False)]}


def _verified(cols: dict[str, list]) -> dict[str, list]:
    ok = [overlap(a, b) >= THRESHOLD for a, b in zip(cols["bag_a"], cols["bag_b"], strict=True)]
    return {c: [v for v, k in zip(cols[c], ok, strict=True) if k] for c in ("a", "b")}


def _unpack(cols: dict[str, list]) -> dict[str, list]:
    return {"node": cols["node"], "bands": [np.frombuffer(b, np.int64).tolist() for b in cols["bands"]]}


def components(edges: DataFrame) -> DataFrame:
    """node, comp (least node of its component) for all nodes that edges (a, b) join with another one.

    A round maps every node to the least of itself and its neighbours, and the edges with it; an edge whose ends meet is
    gone. So a family around a hub is settled in two rounds, and a later round joins only the edges that are left. Nodes
    are digests, so their order is random and a path loses a share of its nodes in each round. Labels are handed down
    from the last round to the first. Each round is written to the shared folder.
    """
    ends = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    left, rounds = written(ends(edges)), []
    while not rounds or left.limit(1).count():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rounds.append(written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))))
        to = lambda n: rounds[-1].select(F.col("node").alias(n), F.col("comp").alias(f"c{n}"))
        left = written(ends(left.join(to("a"), "a").join(to("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    labels = rounds.pop()
    for up in reversed(rounds):
        top = labels.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        labels = written(up.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))
    return labels


def _spanning(star: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what distinct (node, hub) pairs connect: each node with its least hub, and that hub with
    the node's others. Members of one family mostly have the same hubs, so few edges are left."""
    least = star.groupBy("node").agg(F.min("hub").alias("least"))
    hubs = star.join(least, "node").where("hub != least").select(F.col("least").alias("a"), F.col("hub").alias("b"))
    return least.select(F.col("node").alias("a"), F.col("least").alias("b")).union(hubs.distinct())


def _contract(comps: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Components after adding edges."""
    if comps is None:
        return components(edges)
    c = lambda n: comps.select(F.col("node").alias(n), F.col("comp").alias(f"c{n}"))
    up = edges.join(c("a"), "a", "left").join(c("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(up.where("a != b")).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    old = comps.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    new = top.select(F.col("comp").alias("node"), F.col("top").alias("comp")).join(comps, "node", "left_anti")
    return written(old.union(new))


class Groups:
    """The steps from documents to classes; every table is written once and read by the later ones."""

    def __init__(self, docs: DataFrame):
        self.docs = keyed(docs)
        self.signed = written(map_batches(self.docs, _signed, "doc_id long, kd long, kh long, n long, node binary, bands binary", "text", SLICE))
        some = self.signed.where("node IS NOT NULL")
        self.nodes = written(some.groupBy("node").agg(F.min(F.struct("kd", "kh")).alias("rep"), F.min("bands").alias("bands"), F.min("n").alias("n")))
        listed = map_batches(self.nodes.select("node", "bands"), _unpack, "node binary, bands array<long>", "bands")
        member = listed.select("node", F.explode("bands").alias("band"))
        full = member.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
        shared = written(member.join(full, "band"))
        score = shared.groupBy("node").agg(F.sum("size").alias("score"))
        top = shared.join(score, "node").groupBy("band").agg(F.max(F.struct("score", "node")).alias("top"))
        self.members = written(shared.join(top, "band").select("band", "node", F.col("top.node").alias("hub")))
        self.bags = self._bags()

    def _bags(self) -> DataFrame:
        """Bags of the nodes that share a bucket; the documents' texts are dealt out once."""
        needed = self.members.select("node").distinct().join(self.nodes.select("node", "rep"), "node").select("node", F.col("rep.kd").alias("kd"), F.col("rep.kh").alias("kh"))
        text = self.docs.select("kd", "kh", "text").join(needed, ["kd", "kh"]).dropDuplicates(["kd", "kh", "node"])
        return written(map_batches(text.select("node", "text"), _bags, "node binary, bag binary", "text", SLICE))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""
        left = self.bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
        right = self.bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
        both = pairs.select("a", "b").join(left, "a").join(right, "b")
        return written(map_batches(both, _verified, "a binary, b binary", "bag_b", 8_000_000))

    def components(self) -> DataFrame | None:
        """node, comp of all nodes that have a link; None if there are none."""
        star = self.members.where("node != hub").groupBy("node", "hub").count()
        best = star.groupBy("node").agg(F.max(F.struct("count", "hub")).alias("m"))
        links = self.verify(best.select(F.least("node", "m.hub").alias("a"), F.greatest("node", "m.hub").alias("b")).distinct())
        comps = _contract(None, links) if links.limit(1).count() else None
        rest = self._between(comps)
        if rest is None or not rest.limit(1).count():
            return comps
        return _contract(comps, rest)

    def _between(self, comps: DataFrame | None) -> DataFrame | None:
        """Links between components that share a bucket."""
        at = self.members.join(comps, "node", "left") if comps is not None else self.members.withColumn("comp", F.lit(None).cast("binary"))
        at = at.select("band", "node", "hub", F.coalesce("comp", "node").alias("comp"))
        split = at.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("band")
        at = written(at.join(split, "band").select("node", "hub", "comp").distinct())
        if not at.limit(1).count():
            return None
        cluster = components(_spanning(at.where("node != hub").select("node", "hub").distinct()))
        member = at.select("node", "comp").distinct().join(cluster.withColumnRenamed("comp", "cluster"), "node").join(self.nodes.select("node", "n"), "node")
        member = written(member)
        size = member.groupBy("cluster", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("items"))
        whole = size.groupBy("cluster").agg(F.max(F.struct("rows", "comp", "items")).alias("m"), F.sum("rows").alias("rows"), F.sum("items").alias("items"))
        blocks = lambda rows, items: F.ceil(F.greatest(rows / BLOCK, items / BLOCK_ITEMS)).cast("int")
        whole = whole.select("cluster", F.col("m.comp").alias("largest"), blocks(F.col("rows") - F.col("m.rows"), F.col("items") - F.col("m.items")).alias("mixed"), blocks(F.col("m.rows"), F.col("m.items")).alias("own"))
        # Other components stand in the first blocks, the largest one in the rest; a node's hash names its block. The
        # few numbers of each cluster are written, so that the join with a hot cluster can be split.
        whole = written(whole.where("mixed > 0"))
        spot = F.expr("abs(hash(node) DIV 2)")
        dealt = member.join(whole, "cluster").withColumn("block", F.when(F.col("comp") == F.col("largest"), F.col("mixed") + spot % F.col("own")).otherwise(spot % F.col("mixed")))
        last = F.when(F.col("block") < F.col("mixed"), F.col("mixed") + F.col("own")).otherwise(F.col("mixed")) - 1
        dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), last)))
        dealt = dealt.select("cluster", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "comp").join(self.bags, "node")
        return written(dealt.groupBy("cluster", "i", "j").applyInPandas(_block_links, "a binary, b binary"))

    def classes(self) -> DataFrame:
        """doc_id, kd, kh, n, key of the class (null without words)."""
        comps = self.components()
        own = self.signed.select("doc_id", "kd", "kh", "n", "node")
        if comps is None:
            return own.select("doc_id", "kd", "kh", "n", F.col("node").alias("class_key"))
        return own.join(comps, "node", "left").select("doc_id", "kd", "kh", "n", F.coalesce("comp", "node").alias("class_key"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least doc_id of its class), class_size (rows), n_shingles."""
    rows = written(Groups(docs).classes())
    size = rows.where("class_key IS NOT NULL").groupBy("class_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    out = rows.join(size, "class_key", "left")
    return out.select(
        "doc_id",
        F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"),
        F.coalesce("rows", F.lit(1)).cast("long").alias("class_size"),
        F.col("n").alias("n_shingles"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each class (that of the least doc_id), with the columns of docs."""
    rows = written(Groups(docs).classes())
    keep = rows.where("class_key IS NOT NULL").groupBy("class_key").agg(F.min(F.struct("kd", "kh")).alias("k")).select("k.kd", "k.kh")
    wide = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("kd"),
        F.xxhash64(F.col("text").cast("string")).alias("kh"),
    )
    found = wide.join(keep, ["kd", "kh"]).dropDuplicates(["kd", "kh"]).select("row.*")
    none = wide.join(rows.where("class_key IS NULL").select("kd", "kh").distinct(), ["kd", "kh"]).select("row.*")
    return found.unionByName(none)
