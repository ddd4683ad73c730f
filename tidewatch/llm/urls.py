"""URL filters as a sort-merge range join.

Hosts are written label-reversed with a dot after each label (`m.example.org` -> `org.example.m.`), so a rule's host
and all its subdomains are one interval of keys. Within a host, a rule's path prefix is again an interval. Rules and
URLs are swept in key order; a stack holds the rule hosts whose intervals are open, which nest. For each open host the
URL's path is located among the sorted rule paths, whose nesting (also found by a stack) leads to the longest prefix.
Of all rules that fit, the longest (host and path characters together, then host) decides; equal rules: block wins.

Up to BLOCK_RULES rules (they are counted first) go to all workers, and URLs are swept where they are: no shuffle. More
rules are a table like the URLs: both are cut into ranges of keys, a rule going to every range that its interval meets
(a range's border lies in no more intervals than its host has labels), both sides are sorted in each range and swept in
one merge. A host with many URLs is spread over several ranges, to which its rules go.

Defined results: a null URL, or one without `://`, has empty host and path and fits only rules that its empty host
could, so none; an empty table gives no rows; very long URLs are read whole; repeated rows each get a row; a URL that no rule fits gets the default
verdict (allow) and a null rule; null or empty rule hosts are ignored; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_batches

#: Rules that are handed to all workers; more are joined by ranges.
BLOCK_RULES = 200_000
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    at += 3
    end = min((i for c in "/?#" if (i := url.find(c, at)) >= 0), default=len(url))
    stop = min((i for c in "?#" if (i := url.find(c, end)) >= 0), default=len(url))
    return url[at:end].translate(_LOWER), url[end:stop]


def host_key(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.split("."))) if host else ""


class PathRules:
    """Sorted path prefixes of one rule host, each with the prefix that encloses it."""

    def __init__(self, rules: dict[str, tuple[str, str]]):
        self.paths = sorted(rules)
        self.rules = [rules[p] for p in self.paths]
        self.up: list[int] = []
        stack: list[int] = []
        for i, p in enumerate(self.paths):
            while stack and not p.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.up.append(stack[-1] if stack else -1)
            stack.append(i)

    def longest(self, path: str) -> tuple[str, str] | None:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.up[i]
        return self.rules[i] if i >= 0 else None


class RuleBlock:
    """A block of rules (host, path, verdict) prepared for sweeps."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        by: dict[str, dict[str, tuple[str, str]]] = {}
        for host, path, verdict in rules:
            host = (host or "").translate(_LOWER)
            if not host:
                continue
            own, path = by.setdefault(host_key(host), {}), path or ""
            if own.get(path, ("", ""))[1] != "block":
                own[path] = (host + path, verdict)
        self.keys = sorted(by)
        self.paths = [PathRules(by[k]) for k in self.keys]

    def sweep(self, urls: list[tuple[str, str, int]]) -> Iterator[tuple[int, tuple[str, str]]]:
        """(position, rule) for (key, path, position) in sorted order: one merge of both sorted sides."""
        stack: list[int] = []
        nxt = 0
        for key, path, at in urls:
            while nxt < len(self.keys) and self.keys[nxt] <= key:
                while stack and not self.keys[nxt].startswith(self.keys[stack[-1]]):
                    stack.pop()
                stack.append(nxt)
                nxt += 1
            while stack and not key.startswith(self.keys[stack[-1]]):
                stack.pop()
            best: tuple[tuple[int, int], tuple[str, str]] | None = None
            for s in stack:
                if rule := self.paths[s].longest(path):
                    rank = (len(rule[0]), len(self.keys[s]))
                    if best is None or rank > best[0]:
                        best = (rank, rule)
            if best:
                yield at, best[1]


SCHEMA = "page_id long, host string, path string, rule string, verdict string"
_ROW = "part int, key string, kind int, path string, host string, verdict string, page_id long"


def _swept(default: str, block: Broadcast) -> Callable[[dict[str, list]], dict[str, list]]:
    """One batch of URLs against all rules."""

    def rows(cols: dict[str, list]) -> dict[str, list]:
        split = [split_url(u) for u in cols["url"]]
        rule: list[str | None] = [None] * len(split)
        verdict = [default] * len(split)
        for at, (name, say) in block.value.sweep(sorted((host_key(h), p, i) for i, (h, p) in enumerate(split))):
            rule[at], verdict[at] = name, say
        return {"page_id": cols["page_id"], "host": [h for h, _ in split], "path": [p for _, p in split], "rule": rule, "verdict": verdict}

    return rows


def _split_rows(cols: dict[str, list]) -> dict[str, list]:
    split = [split_url(u) for u in cols["url"]]
    return {"page_id": cols["page_id"], "key": [host_key(h) for h, _ in split], "host": [h for h, _ in split], "path": [p for _, p in split]}


def _rule_rows(cols: dict[str, list]) -> dict[str, list]:
    host = [(h or "").translate(_LOWER) for h in cols["host"]]
    return {"key": [host_key(h) for h in host], "host": host, "path": [p or "" for p in cols["path"]], "verdict": cols["verdict"]}


def _merge(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, key and kind (rules before URLs): a stack of the rule hosts whose intervals are open."""
    schema = pa.schema([(c.split()[0], pa.int64() if "long" in c else pa.string()) for c in SCHEMA.split(", ")])
    part: int | None = None
    stack: list[tuple[str, PathRules]] = []
    new: dict[str, tuple[str, str]] = {}
    key_of_new = ""

    def open_new() -> None:
        nonlocal new
        if new:
            while stack and not key_of_new.startswith(stack[-1][0]):
                stack.pop()
            stack.append((key_of_new, PathRules(new)))
            new = {}

    for batch in batches:
        cols = batch.to_pydict()
        out: dict[str, list] = {f.name: [] for f in schema}
        for p, key, kind, path, host, say, page in zip(*(cols[c] for c in ("part", "key", "kind", "path", "host", "verdict", "page_id")), strict=True):
            if p != part:
                part, stack, new = p, [], {}
            if kind == 0:
                if key != key_of_new:
                    open_new()
                    key_of_new = key
                if new.get(path, ("", ""))[1] != "block":
                    new[path] = (host + path, say)
                continue
            open_new()
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            found = [(len(r[0]), len(k), r) for k, rules in stack if (r := rules.longest(path))]
            name, verdict = max(found)[2] if found else (None, default)
            for c, v in zip(out, (page, host, path, name, verdict), strict=True):
                out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


#: Keys that are looked at for each range's border.
PER_RANGE = 50


def _range_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    spark = pages.sparkSession
    urls = map_batches(pages, _split_rows, "page_id long, key string, host string, path string", "url")
    known = map_batches(rules, _rule_rows, "key string, host string, path string, verdict string", "host").where("key <> ''")
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = urls.count()
    # Borders only say where rows go, so they may come from a sample of the keys, of a stated size.
    seen = sorted(r[0] for r in urls.select("key").sample(fraction=min(1.0, 2 * PER_RANGE * ranges / max(n, 1)), seed=1).limit(4 * PER_RANGE * ranges).collect())
    borders = F.array(*(F.lit(seen[k * len(seen) // ranges]) for k in range(1, ranges))) if seen else F.expr("cast(array() AS array<string>)")
    below = lambda key: F.size(F.filter(borders, lambda b: b < key))
    upto = lambda key: F.size(F.filter(borders, lambda b: b <= key))
    # A key that is a border several times has that many ranges to itself.
    own = F.when(upto(F.col("key")) > below(F.col("key")), below(F.col("key")) + F.pmod(F.xxhash64("page_id", "path"), upto(F.col("key")) - below(F.col("key")) + 1)).otherwise(below(F.col("key")))
    left = urls.select(own.cast("int").alias("part"), "key", F.lit(1).alias("kind"), "path", "host", F.lit(None).cast("string").alias("verdict"), "page_id")
    last = F.concat("key", F.lit("\U0010ffff"))
    right = known.select(F.explode(F.sequence(below(F.col("key")), below(last))).alias("part"), "key", F.lit(0).alias("kind"), "path", "host", "verdict", F.lit(None).cast("long").alias("page_id"))
    both = left.unionByName(right).repartition(ranges, "part").sortWithinPartitions("part", "key", "kind")
    return both.mapInArrow(lambda batches: _merge(batches, default), SCHEMA)


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    block_rules: int = BLOCK_RULES,
) -> DataFrame:
    """One row per row of pages: host, path, the deciding rule and the verdict. rules: host, path, verdict."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    known = rules.select(*(F.col(c).cast("string").alias(c) for c in ("host", "path", "verdict")))
    some = [(r["host"], r["path"], r["verdict"]) for r in known.limit(block_rules + 1).collect()]
    if len(some) > block_rules:
        return _range_join(own, known, default)
    shared = pages.sparkSession.sparkContext.broadcast(RuleBlock(some))
    return map_batches(own, _swept(default, shared), SCHEMA, "url")
