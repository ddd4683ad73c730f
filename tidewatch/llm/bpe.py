"""Exact BPE encoding by backtracking over longest matches, and decoding by an offset table.

For each word an Aho-Corasick pass gives the longest vocabulary token that starts at every position. The encoder takes
longest tokens from the left; a token may follow another only if merging would really have left that boundary, which a
pair-compatibility check answers by undoing merges on both sides. Where no token fits, it steps back to the longest
shorter prefix. Each position is ruled out at most once, so the time is linear in the word. Words are cached in a table
of bounded size. Special strings in a text become their special ids, as the library does by default.

Defined results: a null text is empty and has no tokens; very long texts are encoded whole, repeated rows each get a
row, other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_batches

#: Words kept in a worker's cache before it starts anew.
CACHE_WORDS = 400_000


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


#: The word pattern for texts of Latin-1 letters; the general one is in WordBPE.
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


class Words(dict):
    """Word to its ids as text, of bounded size."""

    def __init__(self, bpe: WordBPE):
        self.bpe = bpe

    def __missing__(self, w: str) -> str:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[w] = got = self.bpe.word(w)
        return got


class WordBPE:
    """A vocabulary of byte letters with word ends, as JSON of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        #: Symbols of a word: chr(byte), and chr(256 + byte) for its last byte.
        letter = {c: b for b, c in enumerate(byte_letters())}
        names = [""] * size
        keys: dict[str, int] = {}
        for name, i in vocab.items():
            names[i] = name
            last = bool(self.end) and name.endswith(self.end)
            codes = [letter[c] for c in (name[: -len(self.end)] if last else name)]
            if last and codes:
                codes[-1] += 256
            keys["".join(map(chr, codes))] = i
        for name, i in self.special.items():
            names[i] = name
        self.length = [0] * size
        for k, i in keys.items():
            self.length[i] = len(k)
        #: Longest token that is a proper prefix of a token; -1 if none.
        self.shorter = [-1] * size
        for k, i in keys.items():
            self.shorter[i] = next((keys[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in keys), -1)
        #: rank: order of the merge that makes a token, -1 for single symbols. parts: the pair that it merges.
        self.rank = [-1] * size
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            t, p = vocab[a + b], (vocab[a], vocab[b])
            self.rank[t], self.parts[t], self.made[p] = r, p, r
        self.find = ahocorasick.Automaton()
        for k, i in keys.items():
            self.find.add_word(k, (len(k), i))
        self.find.make_automaton()
        #: Decoding: token i is letters[offset[i]:offset[i + 1]], a space after it.
        shown = [(n + " ").encode() for n in names]
        self.letters = np.frombuffer(b"".join(shown), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(s) for s in shown])])
        self.words = Words(self)
        self.fits: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+", regex.V1
        )
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves a boundary between the two tokens."""
        key = (left, right)
        if (known := self.fits.get(key)) is not None:
            return known
        rank, parts = self.rank, self.parts
        limit, ok = float("inf"), True
        a, b = left, right
        while True:
            r = self.made.get((a, b))
            if r is not None and r < limit:
                ok = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            # The later of the two merges had not happened yet; pairs that were made at its time or before count. Of
            # two merges of the same rank the left one comes first.
            if ra > rb:
                limit, a = ra, parts[a][1]
            else:
                limit, b = rb + 1, parts[b][0]
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def encode_symbols(self, word: str) -> list[int]:
        n = len(word)
        best = [-1] * (n + 1)
        for end, (k, i) in self.find.iter(word):  # ends ascend, so the last token found for a start is its longest
            best[end - k + 1] = i
        out: list[int] = []
        shut = set()
        length, shorter, fits = self.length, self.shorter, self.fits
        at, token, last = 0, best[0], -1
        while at < n:
            while True:
                stop = at + length[token]
                if stop not in shut:
                    ok = True if last < 0 else fits.get((last, token))
                    if ok or ok is None and self.compatible(last, token):
                        out.append(token)
                        at, last, token = stop, token, best[stop]
                        break
                if shorter[token] >= 0:
                    token = shorter[token]
                    continue
                shut.add(at)
                token = out.pop()
                last = out[-1] if out else -1
                at -= length[token]
                break
        return out

    def word(self, w: str) -> str:
        """The ids of one word, in decimal, joined by spaces."""
        s = w.encode().decode("latin-1")
        return " ".join(map(str, self.encode_symbols(s[:-1] + chr(ord(s[-1]) + 256) if self.end else s)))

    def plain(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # such a text is in NFC already
            found = LATIN.findall(text.lower())
        except UnicodeEncodeError:
            found = self.split.findall(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())
        return list(map(self.words.__getitem__, found))

    def ids_text(self, text: str) -> str:
        """The ids of a text, in decimal, joined by spaces."""
        if self.marks is None or not self.marks.search(text):
            return " ".join(self.plain(text))
        out: list[str] = []
        for part in self.marks.split(text):
            out += [str(self.special[part])] if part in self.special else self.plain(part)
        return " ".join(out)

    def encode(self, text: str) -> np.ndarray:
        return np.fromstring(self.ids_text(text), np.int64, sep=" ")

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """Tokens joined by one space, in UTF-8: the library's result for a vocabulary without a decoder."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        out = []
        for i in range(0, len(ids), 1 << 20):
            part = ids[i : i + (1 << 20)]
            start, size = self.offset[part], self.offset[part + 1] - self.offset[part]
            ends = np.cumsum(size)
            out.append(self.letters[np.repeat(start - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)[:-1]


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _from(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the token ids of every whole text. No shuffle."""

    def rows(cols: dict[str, list]) -> dict[str, list]:
        bpe = load(path)
        return {"doc_id": cols["doc_id"], "ids": [bpe.encode(t or "").tolist() for t in cols["text"]]}

    return map_batches(_from(docs, id_col, text_col), rows, "doc_id long, ids array<int>", "text")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the decoded text of every row of ids."""

    def rows(cols: dict[str, list]) -> dict[str, list]:
        bpe = load(path)
        return {"doc_id": cols["doc_id"], "text": [bpe.decode([] if i is None else i).decode() for i in cols["ids"]]}

    return map_batches(encoded.select("doc_id", "ids"), rows, "doc_id long, text string", "ids")


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of encoding every whole text and decoding it again."""

    def rows(cols: dict[str, list]) -> dict[str, list]:
        bpe = load(path)
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in cols["text"]:
            shown = bpe.ids_text(text or "")
            ids = np.fromstring(shown, np.int64, sep=" ")
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(shown.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return out

    return map_batches(_from(docs, id_col, text_col), rows, SCHEMA, "text")
