"""Fill-in-middle: cut a text at two token boundaries and put its middle last.

A text is decoded to an array of code points. Letters A-Z and a-z have one class; a token ends after each code point of
the other class and wherever a letter is followed by none, so neighbouring classes are compared once for the whole text.
flatnonzero gives the boundaries, the two chosen ranks index them, and the three slices are encoded again. Ranks and form
come from a hash of the seed and the id, so a recomputed task gives the same rows.

Forms: psm is <P>prefix<S>suffix<M>middle, spm is <S>suffix<P>prefix<M>middle, plain is the text itself. Marks can't arise
across a cut (each starts with the only `<` that it has), so the first mark of each kind parts an output again.

Defined results: a null text is empty, and an empty text stays plain; so does a text that holds a mark. A null id hashes
like an empty one. Very long texts are cut like others, repeated rows each get a row (the same one for the same id and
text), an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_batches

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts, those from this on stay plain; of 100 others, those below this are written suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = "1"


class Infill(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def token_ends(codes: np.ndarray) -> np.ndarray:
    """Where the tokens `[A-Za-z]+|[^A-Za-z]` of an array of code points end, after a leading 0."""
    letter = ((codes | 32) >= 97) & ((codes | 32) <= 122)
    inside = letter.copy()
    inside[:-1] &= letter[1:]
    inside[-1:] = False
    return np.concatenate([[0], np.flatnonzero(~inside) + 1])


def infill(text: str | None, doc_id: int | None, seed: str = SEED) -> Infill:
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = token_ends(codes)
    n = len(ends) - 1
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or h3 % 100 >= PLAIN_FROM or any(m in text for m in MARKS):
        return Infill(n, "plain", None, None, text)
    a, b = (int(ends[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (codes[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, b), (b, len(codes))))
    p, s, m = MARKS
    if h4 % 100 < SPM_BELOW:
        return Infill(n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}")
    return Infill(n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}")


def restore(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    p, s, m = MARKS
    head, middle = output.split(m, 1)
    if form == "psm":
        prefix, suffix = head.removeprefix(p).split(s, 1)
    else:
        suffix, prefix = head.removeprefix(s).split(p, 1)
    return prefix + middle + suffix


def _from(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def transform(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every whole text. No shuffle."""

    def rows(cols: dict[str, list]) -> dict[str, list]:
        made = [infill(t, i, seed) for i, t in zip(cols["doc_id"], cols["text"], strict=True)]
        return {"doc_id": cols["doc_id"]} | {f: [getattr(x, f) for x in made] for f in Infill._fields}

    return map_batches(_from(docs, id_col, text_col), rows, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", "text")


def restored(transformed: DataFrame) -> DataFrame:
    """doc_id, text: what the outputs of transform() were made of."""

    def rows(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "text": [restore(o, f) for o, f in zip(cols["output"], cols["form"], strict=True)]}

    return map_batches(transformed.select("doc_id", "form", "output"), rows, "doc_id long, text string", "output")


def digest_infills(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Form, sizes and digests of the output and of the text rebuilt from it."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def rows(cols: dict[str, list]) -> dict[str, list]:
        made = [infill(t, i, seed) for i, t in zip(cols["doc_id"], cols["text"], strict=True)]
        out = {"doc_id": cols["doc_id"]} | {f: [getattr(x, f) for x in made] for f in Infill._fields[:-1]}
        return out | {"output_sha256": [sha(x.output) for x in made], "restored_sha256": [sha(restore(x.output, x.form)) for x in made]}

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return map_batches(_from(docs, id_col, text_col), rows, schema, "text")
