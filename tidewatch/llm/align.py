"""Alignment of two tokenizers over whole texts: common cuts, overlapping token pairs, and their counts in the corpus.

The texts of an Arrow batch are laid end to end with their byte offsets. Both token sequences give end positions; one
bincount of all ends tells where one ends (a link ends there: each pair of overlapping tokens shares exactly one stretch
between neighbouring ends) and where both do (a group ends there). Prefix sums of these marks give each link its two
tokens, each token its group, and, taken at the documents' offsets, each document its counts.

Corpus counts: a slice of documents (about 8 MB of text) has each of its id pairs once, with the number of its documents
that hold it. Those are summed by pair; a slice then fetches the counts of its own pairs only, so that what is shuffled
follows the number of slices times the pairs in a slice, not the links. Documents meet the fetched counts by slice, a
bounded group. No table of pairs is broadcast and no document is encoded twice.

Defined results: a null or empty text, and one whose tokens do not give back a space and the text in both vocabularies,
has no tokens: zeros and an empty digest. Very long texts are aligned whole; repeated rows each get a row and each count
as a document; ties for the highest count of an A id all count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.llm.bpe import byte_letters
from tidewatch.llm.common import slices, written

#: Text aligned by one call, and text whose documents share one list of pairs, in bytes.
BATCH_BYTES, SLICE_BYTES = 2_000_000, 8_000_000
#: Fixed value: the word pattern of byte-level vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokens:
    """The bytes of each token id, end to end with offsets."""

    def __init__(self, names: list[bytes]):
        self.letters = np.frombuffer(b"".join(names), np.uint8)
        self.sizes = np.array([len(n) for n in names], np.int64)
        self.offset = np.cumsum(self.sizes) - self.sizes

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.letters[np.repeat(self.offset[ids] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]


class ByteVocabulary(Tokens):
    """A byte-level BPE file of the tokenizers library, applied to a space and the text; special tokens are plain text.

    Where the ids are in the order of the merges, they serve tiktoken as ranks, which gives the same tokens three times as
    fast; else the library encodes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        vocab: dict[str, int] = {n: i for n, i in spec["model"]["vocab"].items() if n not in special}
        letter = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        names = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            names[i] = b"".join(letter[c] for c in name)
        super().__init__(names)
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        split = spec["pre_tokenizer"]
        plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not spec["normalizer"]
        if plain and merged == sorted(merged):
            import tiktoken

            ranks = {n: i for i, n in enumerate(names) if n}
            found = tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.ids = lambda text: found.encode_to_numpy(" " + text, disallowed_special=())
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            library.no_truncation()
            library.no_padding()
            self.ids = lambda text: library.encode(" " + text, add_special_tokens=False).ids


class PieceVocabulary(Tokens):
    """A sentencepiece model, which adds the leading space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)

        def spelling(piece: str) -> bytes:
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

        super().__init__([spelling(model.id_to_piece(i)) for i in range(model.vocab_size())])
        self.ids = model.encode


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Tokens:
    return (ByteVocabulary if path.endswith(".json") else PieceVocabulary)(path)


def _listed(vocab: Tokens, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each text has."""
    got = [np.asarray(vocab.ids(t), np.int64) if t else np.empty(0, np.int64) for t in texts]
    return np.concatenate([*got, np.empty(0, np.int64)]), np.array([len(g) for g in got], np.int64)


def _exact(vocab: Tokens, ids: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """For each text, whether its tokens' bytes are the text's."""
    spelled, whole = vocab.spelled(ids), np.frombuffer(b"".join(raw), np.uint8)
    ends = np.concatenate([[0], np.cumsum(vocab.sizes[ids])])[np.cumsum(counts)]
    sizes = np.array([len(r) for r in raw], np.int64)
    ok = np.diff(ends, prepend=0) == sizes
    if ok.all():
        wrong = np.concatenate([[0], np.cumsum(spelled != whole)])[np.cumsum(sizes)]
        return np.diff(wrong, prepend=0) == 0
    for k in np.flatnonzero(ok):
        ok[k] = spelled[ends[k] - sizes[k] : ends[k]].tobytes() == raw[k]
    return ok


def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 to most, right-aligned with a column for a separator, and which columns are used."""
    width = len(str(most))
    n = np.arange(most + 1)
    place = 10 ** np.arange(width - 1, -1, -1)
    digits = np.zeros((most + 1, width + 1), np.uint8)
    digits[:, :width] = n[:, None] // place % 10 + 48
    used = np.ones((most + 1, width + 1), bool)
    used[:, : width - 1] = n[:, None] >= place[:-1]
    return digits, used


@functools.lru_cache(maxsize=4)
def decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    return _decimals(most)


class Aligned:
    """The alignment of a list of texts.

    n_a, n_b, n_groups, n_links: by text. groups: the written groups of a text. a, b, text_of: ids and text of each link.
    """

    def __init__(self, texts: list[str | None], va: Tokens, vb: Tokens):
        plain = [t or "" for t in texts]
        raw = [(" " + t).encode() if t else b"" for t in plain]
        a, na = _listed(va, plain)
        b, nb = _listed(vb, plain)
        ok = _exact(va, a, na, raw) & _exact(vb, b, nb, raw)
        if not ok.all():
            a, b = a[np.repeat(ok, na)], b[np.repeat(ok, nb)]
            na, nb = na * ok, nb * ok
        self.n_a, self.n_b = na, nb
        sizes = np.array([len(r) for r in raw], np.int64) * ok
        n, stop = int(sizes.sum()), np.cumsum(sizes)
        ends_a, ends_b = np.cumsum(va.sizes[a]), np.cumsum(vb.sizes[b])
        hits = np.bincount(np.concatenate([ends_a, ends_b]), minlength=n + 1)
        both = hits == 2
        before = lambda ends: np.cumsum(np.bincount(ends, minlength=n + 1))  # noqa: E731 - ends at or before a byte
        of_a, of_b, groups, links = before(ends_a), before(ends_b), np.cumsum(both), np.cumsum(hits > 0)
        self.n_groups, self.n_links = np.diff(groups[stop], prepend=0), np.diff(links[stop], prepend=0)
        cuts = np.flatnonzero(hits)
        self.a, self.b = a[of_a[cuts - 1]], b[of_b[cuts - 1]]
        self.text_of = np.repeat(np.arange(len(texts)), self.n_links)
        # Tokens in the order of writing: the A tokens of a group, then its B tokens.
        at = np.flatnonzero(both)
        group_a, group_b = groups[ends_a - 1], groups[ends_b - 1]
        place_a = np.arange(len(a)) + np.concatenate([[0], of_b[at]])[group_a]
        place_b = np.arange(len(b)) + of_a[at][group_b]
        ids, after = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[place_a], ids[place_b] = a, b
        comma, bar, semicolon = b",|;"
        after[place_a] = np.where(both[ends_a], bar, comma)
        after[place_b] = np.where(both[ends_b], semicolon, comma)
        digits, used = decimals(max(len(va.sizes), len(vb.sizes)))
        shown, mask = digits[ids], used[ids]
        shown[:, -1] = after
        self._shown = shown[mask]
        self._shown_to = np.concatenate([[0], np.cumsum(mask.sum(1))])[np.cumsum(na + nb)]

    def groups(self, k: int) -> bytes:
        """The groups of text k as a1,a2|b1;a3|b2,b3."""
        start = self._shown_to[k - 1] if k else 0
        return self._shown[start : max(start, self._shown_to[k] - 1)].tobytes()

    def pairs(self, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, id pair (a * size_b + b) and number of links of each pair that a text has."""
        span = int(self.a.max(initial=0) + 1) * size_b
        key, times = np.unique(self.text_of * span + self.a * size_b + self.b, return_counts=True)
        return key // span, key % span, times


ALIGNED = "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, times binary, pairs array<long>, docs array<long>"


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, digest, and its pairs as places in its slice's list (`at`, 32 bits each) with their
    numbers of links. The first document of a slice carries the list (`pairs`) and how many documents hold each (`docs`)."""
    arrow = to_arrow_schema(T._parse_datatype_string(ALIGNED))
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = vocabulary(path_a), vocabulary(path_b)
        slice_no = TaskContext.get().partitionId() << 32
        for batch in batches:
            for whole in slices(batch, "text", SLICE_BYTES):
                cols: dict[str, list] = {f.name: [] for f in arrow}
                text_of, pair, times = [], [], []
                for part in slices(whole, "text", BATCH_BYTES):
                    ids, texts = part.to_pydict().values()
                    got = Aligned(texts, va, vb)
                    t, p, n = got.pairs(len(vb.sizes))
                    text_of.append(t + len(cols["doc_id"]))
                    pair.append(p)
                    times.append(n.astype(np.uint32))
                    cols["doc_id"] += ids
                    for name in ("n_a", "n_b", "n_groups", "n_links"):
                        cols[name] += getattr(got, name).tolist()
                    cols["groups_sha256"] += [hashlib.sha256(got.groups(k)).hexdigest() if got.n_a[k] else "" for k in range(len(ids))]
                found, at, held = np.unique(np.concatenate(pair), return_inverse=True, return_counts=True)
                rows, at, all_times = len(cols["doc_id"]), at.astype(np.uint32), np.concatenate(times)
                to = np.searchsorted(np.concatenate(text_of), np.arange(rows + 1))
                cols["slice"] = [slice_no] * rows
                cols["at"] = [at[i:j].tobytes() for i, j in zip(to, to[1:], strict=False)]
                cols["times"] = [all_times[i:j].tobytes() for i, j in zip(to, to[1:], strict=False)]
                cols["pairs"], cols["docs"] = [found] + [None] * (rows - 1), [held] + [None] * (rows - 1)
                slice_no += 1
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    return plain.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """a, b, pair, n (documents that hold the pair linked) and best (no pair of its a has more)."""
    listed = aligned.where(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("x.pairs", "x.docs")
    n = listed.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n")).withColumns({"a": F.expr(f"pair DIV {size_b}"), "b": F.col("pair") % size_b})
    most = n.groupBy("a").agg(F.max("n").alias("most"))
    return n.join(most, "a").select("a", "b", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def score_links(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document: its counts, n_best and count_sum. aligned and counts are read more than once, so both should be
    written tables."""
    arrow = to_arrow_schema(T._parse_datatype_string(RESULT))
    wanted = aligned.where(F.col("pairs").isNotNull()).select(F.col("slice").alias("of"), F.explode("pairs").alias("pair"))
    fetched = wanted.join(counts.select("pair", "n", "best"), "pair").select("of", "pair", "n", "best")
    rows = aligned.select("slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times")

    def score(docs: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found["pair"].to_numpy())
        n, best = (found[c].to_numpy(zero_copy_only=False)[order].astype(np.int64) for c in ("n", "best"))
        best_of, sum_of = [], []
        for at, times in zip(docs["at"].to_pylist(), docs["times"].to_pylist(), strict=True):
            at, times = np.frombuffer(at, np.uint32), np.frombuffer(times, np.uint32).astype(np.int64)
            best_of.append(int((best[at] * times).sum()))
            sum_of.append(int((n[at] * times).sum()))
        cols = {c: docs[c] for c in docs.column_names} | {"n_best": pa.array(best_of, pa.int64()), "count_sum": pa.array(sum_of, pa.int64())}
        return pa.table([cols[f.name].cast(f.type) for f in arrow], schema=arrow)

    return rows.groupBy("slice").cogroup(fetched.groupBy("of")).applyInArrow(score, RESULT)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Alignment counts and digests of every whole text, with corpus-wide counts of its linked id pairs."""
    aligned = written(align_documents(docs, path_a, path_b, id_col, text_col))
    counts = written(pair_counts(aligned, len(vocabulary(path_b).sizes)))
    return score_links(aligned, counts)
