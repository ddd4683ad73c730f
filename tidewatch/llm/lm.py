"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as sorted hash arrays, mapped by workers.

A token is a 64-bit hash of a word (A-Z lower-cased) or the end of a text; n-grams start with begin marks, so each token
has one n-gram of the full order. Slices of the training texts (about 8 MB) count their distinct n-grams and send them to
shards: a grid of the last word's and the context's leading hash bits, so a hot word is dealt over a row and a hot context
over a column. A shard merges equal n-grams, writes their sorted hashes and counts as one file, and passes partial sums to
the next lower order: one more left neighbour and the raw count for the suffix; total, and how many words follow once,
twice and more often, for the context. The next order is merged in the same way. Nothing but eight numbers by order comes
to the driver.

Scoring maps the files: a slice's distinct n-grams are sorted by shard and hash, so pages are read in order and once, and
workers of one machine share them. The folder must therefore be one that every worker reaches as a path (the cluster's
shared folder, or a mounted one given by name). Probability of w after h, with D the order's discount for a count (by
Chen and Goodman), a the count (of left neighbours below the full order):

    p(w | h) = (a(hw) - D(a)) / sum(a(h.)) + sum(D(a(h.))) / sum(a(h.)) * p(w | h shortened)

and 1 / (V + 1) below the single words: one share for each known word and one for all unknown words. Where a discount has
no counts to be taken from, 0.5, 1 and 1.5 stand for the three.

Defined results: a null or empty text is its end alone; a null id hashes like an empty one; very long texts are counted
and scored whole; repeated rows count and are scored each; equal words share counts whatever the text; without training
texts N and V are 0 and every token has probability 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
import os
import re
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import forget, map_batches, slices, work_dir, written
from tidewatch.llm.shingles import mix, word_hashes

ORDER = 2
#: Text that is counted at once and that is scored at once, in bytes; text for each shard; bits of the least number of shards.
SLICE_BYTES, SCORE_BYTES, SHARD_BYTES, LEAST_BITS = 8_000_000, 3_000_000, 16_000_000, 9
#: Text whose words are hashed in one array operation, in characters.
HASH_CHARS = 1_000_000
#: Of 7 remainders of an id's checksum, the one whose texts are held out.
FOLDS, HELD_OUT = 7, 2
BEGIN, END = np.uint64(0x5BF03635D1C93A41), np.uint64(0xA3EC647659359ACD)
_LINK = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Sums of an n-gram below the full order: raw count, left neighbours, total after it, words after it once, twice, more.
SUMS = 6
STATS = ("raw", "words", "total", "kinds", "n1", "n2", "n3", "n4")


def sequence(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts with order - 1 begin marks before each, the places of the tokens, tokens by text."""
    hashed, n = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    ends = np.cumsum([len(t or "") for t in texts])
    cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, HASH_CHARS), side="right")
    for i, j in itertools.pairwise(dict.fromkeys([0, *cuts.tolist(), len(texts)])):
        words, bounds = word_hashes([(t or "").encode().translate(_LOWER).decode() for t in texts[i:j]])
        hashed.append(words)
        n.append(np.diff(bounds))
    words, n = np.concatenate(hashed), np.concatenate(n)
    start = np.cumsum(n + order) - (n + order)
    out = np.full(int((n + order).sum()), BEGIN, np.uint64)
    out[np.arange(len(words)) + np.repeat(start + order - 1 - (np.cumsum(n) - n), n)] = words
    out[start + n + order - 1] = END
    places = np.arange(int((n + 1).sum())) + np.repeat((order - 1) * np.arange(1, len(n) + 1), n + 1)
    return out, places, n + 1


def grams(seq: np.ndarray, places: np.ndarray, k: int) -> list[np.ndarray]:
    """Words of the k-gram that ends at each place, one array for each of the k."""
    return [seq[places - j] for j in range(k - 1, -1, -1)]


def chain(words: list[np.ndarray]) -> np.ndarray:
    """Hash of k-grams."""
    return functools.reduce(lambda h, w: mix(h * _LINK + w), words)


def shard_of(words: list[np.ndarray], bits: int) -> np.ndarray:
    """Leading bits of the last word's hash, then of the context's."""
    if len(words) == 1:
        return (words[0] >> np.uint64(64 - bits)).astype(np.int64)
    low = bits // 2
    row, col = words[-1] >> np.uint64(64 - bits + low), chain(words[:-1]) >> np.uint64(64 - low)
    return ((row << np.uint64(low)) | col).astype(np.int64)


def merged(words: list[np.ndarray], sums: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Hashes in order, words and sums of the distinct k-grams."""
    h = chain(words)
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    total = np.add.reduceat(sums[order], first) if len(h) else sums
    return h[first], [w[order[first]] for w in words], total


BLOCK = "shard int, last binary, runs binary, rest binary, sums binary, stats array<long>"
_ARROW = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("last", "runs", "rest", "sums")), ("stats", pa.list_(pa.int64()))])


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte, the high bytes together, as they are mostly 0."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _integers(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def blocks(words: list[np.ndarray], sums: np.ndarray, bits: int) -> dict[str, list]:
    """Distinct k-grams by shard, in each ordered by the last word, which is written once for its run."""
    shard, last = shard_of(words, bits), words[-1]
    order = np.lexsort((last, shard))
    shard, last, sums = shard[order], last[order], sums[order]
    rest = np.stack([w[order] for w in words[:-1]], 1) if len(words) > 1 else np.empty((len(last), 0), np.uint64)
    new = np.concatenate([[True], (last[1:] != last[:-1]) | (shard[1:] != shard[:-1])]) if len(last) else np.empty(0, bool)
    found, start = np.unique(shard, return_index=True)
    out: dict[str, list] = {name: [] for name in _ARROW.names}
    for s, i, j in zip(found.tolist(), start, [*start[1:], len(shard)], strict=True):
        at = np.flatnonzero(new[i:j])
        out["shard"].append(s)
        out["last"].append(last[i:j][at].tobytes())
        out["runs"].append(_planes(np.diff(at, append=j - i).astype(np.uint32)))
        out["rest"].append(rest[i:j].tobytes())
        out["sums"].append(_planes(sums[i:j]))
        out["stats"].append(None)
    return out


def unpacked(table: pa.Table, k: int, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Words and sums of all blocks of a table."""
    last, rest, sums = [np.empty(0, np.uint64)], [np.empty((0, k - 1), np.uint64)], [np.empty((0, width), np.int64)]
    for a, r, x, s in zip(*(table[c].to_pylist() for c in ("last", "runs", "rest", "sums")), strict=True):
        last.append(np.repeat(np.frombuffer(a, np.uint64), _integers(r, np.uint32)))
        rest.append(np.frombuffer(x, np.uint64).reshape(-1, k - 1) if k > 1 else np.empty((len(last[-1]), 0), np.uint64))
        sums.append(_integers(s, np.int64).reshape(-1, width))
    whole = np.concatenate(rest)
    return [*(np.ascontiguousarray(whole[:, j]) for j in range(k - 1)), np.concatenate(last)], np.concatenate(sums)


def fields(k: int, order: int) -> list[tuple[str, type]]:
    """What the file of a shard holds of each k-gram, one array after the other."""
    own = [("hash", np.uint64)] + ([("raw", np.int64)] if k == 1 else []) + [("count", np.float32)]
    return own + ([("total", np.float32), ("spare", np.float32)] if k < order else [])


class Model(NamedTuple):
    """A trained model: where its files are, and a few numbers. discounts: by order, for counts 0, 1, 2 and more."""

    folder: str
    order: int
    bits: int
    tokens: int = 0
    words: int = 0
    unigrams: int = 0
    spare: float = 0.0
    discounts: tuple[tuple[float, ...], ...] = ()


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, ...]:
    if not (n1 and n2 and n3):
        return 0.0, 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return 0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3


def mapped_folder(path: str) -> str:
    """A folder as a path of the file system."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        raise ValueError("the model is mapped into memory: name a folder that is mounted on every worker")
    return path


def _save(folder: str, k: int, shard: int, arrays: list[np.ndarray]) -> None:
    """Write a shard's file whole or not at all, so that a repeated task does no harm."""
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{k}-{shard}-{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        for a in arrays:
            f.write(a.tobytes())
    os.replace(own, f"{folder}/{k}-{shard}")


def _merge(table: pa.Table, k: int, above: tuple[float, ...], model: Model) -> pa.Table:
    """One shard of the k-grams: its file, its numbers, and what it has for the order below."""
    top = k == model.order
    hashes, words, sums = merged(*unpacked(table, k, 1 if top else SUMS))
    raw = sums[:, 0]
    count = raw if top else sums[:, 1]
    held = {"hash": hashes, "raw": raw, "count": count}
    if not top:
        held |= {"total": sums[:, 2], "spare": sums[:, 3:] @ np.array(above[1:])}
    _save(model.folder, k, table["shard"][0].as_py(), [held[name].astype(kind) for name, kind in fields(k, model.order)])
    stats = [raw.sum(), (raw > 0).sum(), count.sum(), (count > 0).sum(), *((count == n).sum() for n in (1, 2, 3, 4))]
    out: dict[str, list] = {name: [] for name in _ARROW.names}
    if k > 1:
        real = count > 0
        words, count, raw = [w[real] for w in words], count[real], raw[real]
        after, before = np.zeros((len(count), SUMS), np.int64), np.zeros((len(count), SUMS), np.int64)
        before[:, 0], before[:, 1] = raw, 1
        after[:, 2] = count
        after[np.arange(len(count)), 2 + np.minimum(count, 3)] = 1
        below = [np.concatenate([words[j + 1], words[j]]) for j in range(k - 1)]
        out = blocks(*merged(below, np.concatenate([before, after]))[1:], model.bits)
    for name in _ARROW.names:
        out[name].append([int(x) for x in stats] if name == "stats" else -1 if name == "shard" else None)
    return pa.table([pa.array(out[f.name], f.type) for f in _ARROW], schema=_ARROW)


def _merger(k: int, above: tuple[float, ...], model: Model) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _merge(table, k, above, model)


def train(docs: DataFrame, order: int = ORDER, text_col: str = "text", folder: str | None = None) -> Model:
    """Count the n-grams of all texts and write the model below folder (the session's shared folder if none is named)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, math.ceil(math.log2(size / SHARD_BYTES))) if size > SHARD_BYTES else LEAST_BITS
    model = Model(f"{mapped_folder(folder or work_dir(spark))}/tidewatch-{uuid.uuid4().hex}", order, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                seq, places, _ = sequence(part["text"].to_pylist(), order)
                words = grams(seq, places, order)
                _, words, n = merged(words, np.ones((len(places), 1), np.int64))
                out = blocks(words, n, bits)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _ARROW], schema=_ARROW)

    found, above, by_order = docs.mapInArrow(count, BLOCK), (0.0,) * 4, {}
    for k in range(order, 0, -1):
        done = written(found.groupBy("shard").applyInArrow(_merger(k, above, model), BLOCK))
        if k < order:
            forget(source)  # noqa: F821 - the table that the round before has written
        source = done
        own = done.where(F.col("stats").isNotNull())
        sums = own.agg(*(F.sum(F.get("stats", F.lit(j))).alias(name) for j, name in enumerate(STATS))).first()
        by_order[k] = s = {name: sums[name] or 0 for name in STATS}
        above = discounts(*(s[f"n{j}"] for j in (1, 2, 3, 4)))
        by_order[k]["discounts"] = above
        found = done.where(F.col("stats").isNull())
    forget(source)
    one = by_order[1]
    spare = one["n1"] * above[1] + one["n2"] * above[2] + (one["kinds"] - one["n1"] - one["n2"]) * above[3]
    given = tuple(by_order[k]["discounts"] for k in range(1, order + 1))
    return model._replace(tokens=one["raw"], words=one["words"], unigrams=one["total"], spare=float(spare), discounts=given)


@functools.lru_cache(maxsize=4096)
def shard_file(folder: str, k: int, order: int, shard: int) -> dict[str, np.ndarray] | None:
    """The arrays of a shard, mapped; None if it has no k-grams."""
    path = f"{folder}/{k}-{shard}"
    if not os.path.exists(path):
        return None
    raw, own = np.memmap(path, np.uint8, "r"), fields(k, order)
    n, at, out = len(raw) // sum(np.dtype(t).itemsize for _, t in own), 0, {}
    for name, kind in own:
        out[name] = raw[at : at + n * np.dtype(kind).itemsize].view(kind)
        at += n * np.dtype(kind).itemsize
    return out


def look_up(model: Model, words: list[np.ndarray], names: tuple[str, ...]) -> list[np.ndarray]:
    """Fields of k-grams, 0 where the model has none. Each distinct one is looked up once, in the order of the files."""
    k = len(words)
    found, at, back = np.unique(chain(words), return_index=True, return_inverse=True)
    shard = shard_of([w[at] for w in words], model.bits)
    order = np.argsort(shard, kind="stable")
    out = {name: np.zeros(len(found), kind) for name, kind in fields(k, model.order) if name in names}
    first = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for i, j in zip(first, [*first[1:], len(order)], strict=True):
        held = shard_file(model.folder, k, model.order, int(shard[order[i]]))
        if held is None or not len(held["hash"]):
            continue
        probe = found[order[i:j]]
        place = np.minimum(np.searchsorted(held["hash"], probe), len(held["hash"]) - 1)
        hit = held["hash"][place] == probe
        for name in names:
            out[name][order[i:j][hit]] = held[name][place[hit]]
    return [out[name][back] for name in names]


def token_scores(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of all texts its count in training and its probability; and tokens by text."""
    seq, places, n = sequence(texts, model.order)

    def kept(count: np.ndarray, k: int) -> np.ndarray:
        cut = np.array(model.discounts[k - 1])[np.minimum(count, 3).astype(np.int64)]
        return np.maximum(count - cut, 0.0)

    raw, count = look_up(model, grams(seq, places, 1), ("raw", "count"))
    p = np.full(len(places), 1.0 / (model.words + 1))
    if model.unigrams:
        p = (kept(count.astype(np.float64), 1) + model.spare * p) / model.unigrams
    for k in range(2, model.order + 1):
        words = grams(seq, places, k)
        total, spare = (x.astype(np.float64) for x in look_up(model, words[:-1], ("total", "spare")))
        count = look_up(model, words, ("count",))[0].astype(np.float64)
        seen = total > 0
        p[seen] = (kept(count[seen], k) + spare[seen] * p[seen]) / total[seen]
    return raw, p, n


def held_out(ident: Column) -> Column:
    """Whether an id's texts are not learned from."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every whole text. No shuffle."""
    ident = F.col(f"`{id_col}`").cast("long")
    plain = docs.select(ident.alias("doc_id"), held_out(ident).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def rows(cols: dict[str, list]) -> dict[str, list]:
        raw, p, n = token_scores(model, cols["text"])
        start = np.cumsum(n) - n
        base = np.log10((raw + 1) / (model.tokens + model.words + 1))
        by_text = lambda x: np.add.reduceat(x, start)  # noqa: E731 - each text has a token, its end
        total = by_text(np.log10(p))
        return {
            "doc_id": cols["doc_id"],
            "held_out": cols["held_out"],
            "n_tokens": n,
            "n_known": by_text((raw > 0).astype(np.int64)),
            "train_tokens": [model.tokens] * len(n),
            "base_score": by_text(base),
            "score": total,
            "perplexity": 10 ** (-total / n),
        }

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return map_batches(plain, rows, schema, "text", SCORE_BYTES)


def score_corpus(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Train on the texts that are not held out and score all."""
    return score(docs, train(docs.where(~held_out(F.col(f"`{id_col}`").cast("long"))), order, text_col, folder), id_col, text_col)
