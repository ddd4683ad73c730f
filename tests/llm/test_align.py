"""Alignment of two tokenizers against loops over single tokens and the libraries' own results."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.conftest import SF
from tidewatch.llm import align
from tidewatch.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EDGE = [
    None, "", " ", "a", "Hello world, hello", "  lead  and trail  ", "x\n\n\ty", "▁ is a space", "<|endoftext|> </s> <unk>", "é é ﬁ ﻿ \x00",
    "\U0001f600\U0001f468‍\U0001f469 ok", "日本語のテキスト", "a" * 5000, " " * 3000, "word " * 20_000, "same text here", "same text here", "1234567890 12", "don't we'll",
]


def libraries():
    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    letter = {c: b for b, c in enumerate(byte_letters())}
    sp = sentencepiece.SentencePieceProcessor(model_file=B)

    def of_a(text):
        ids = ta.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(letter[c] for c in ta.id_to_token(i)) for i in ids]

    def of_b(text):
        ids = sp.encode(text)
        spelled = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
        return ids, [spelled(sp.id_to_piece(i)) for i in ids]

    return of_a, of_b


def plainly(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups of each text."""
    of_a, of_b = libraries()
    out, links_of = [], []
    for text in texts:
        (a, xa), (b, xb) = (of_a(text), of_b(text)) if text else (([], []), ([], []))
        if text and not b"".join(xa) == b"".join(xb) == b" " + text.encode():
            a = b = xa = xb = []
        i = j = at_a = at_b = 0
        links, groups, ga, gb = [], [], [], []
        while i < len(a):
            links.append((a[i], b[j]))
            ea, eb = at_a + len(xa[i]), at_b + len(xb[j])
            if ea <= eb:
                ga.append(a[i])
                i, at_a = i + 1, ea
            if eb <= ea:
                gb.append(b[j])
                j, at_b = j + 1, eb
            if ea == eb:
                groups.append((ga, gb))
                ga, gb = [], []
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), shown))
        links_of.append(links)
    count = Counter(p for links in links_of for p in set(links))
    most: dict[int, int] = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    return [(*o[:4], sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), o[4]) for o, links in zip(out, links_of, strict=True)]


def digested(rows):
    return [(*r[:6], hashlib.sha256(r[6].encode()).hexdigest() if r[0] else "") for r in rows]


def result(df):
    return sorted(tuple(-1 if v is None else v for v in (r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect())


def test_aligned_equals_loops():
    va, vb = align.vocabulary(A), align.vocabulary(B)
    got, want = align.Aligned(EDGE, va, vb), plainly(EDGE)
    for k, w in enumerate(want):
        assert (got.n_a[k], got.n_b[k], got.n_groups[k], got.n_links[k], got.groups(k).decode()) == (*w[:4], w[6]), EDGE[k]
    assert want[7][:4] == (0, 0, 0, 0)  # a text with the piece model's own mark for spaces
    assert align.Aligned([], va, vb).n_a.tolist() == [] and align.Aligned([None, ""], va, vb).n_links.tolist() == [0, 0]


@pytest.mark.parametrize("order", ["merges", "others"])
def test_ids_equal_the_library(order, tmp_path):
    """Also for a vocabulary whose ids are not in the order of its merges."""
    path = A
    if order == "others":
        import json

        spec = json.load(open(A, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        x, y = ("".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"][:2])
        vocab[x], vocab[y] = vocab[y], vocab[x]
        path = str(tmp_path / "v.json")
        json.dump(spec, open(path, "w", encoding="utf-8"))
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    for text in EDGE:
        if text:
            assert list(align.ByteVocabulary(path).ids(text) if order == "merges" else align.vocabulary(path).ids(text)) == library.encode(" " + text, add_special_tokens=False).ids


def test_whole_table_over_slices(spark, monkeypatch):
    """Small slices, so that counts come from many of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    rows = docs.collect()
    monkeypatch.setattr(align, "SLICE_BYTES", 40_000)
    monkeypatch.setattr(align, "BATCH_BYTES", 9_000)
    want = sorted((r.doc_id, *w) for r, w in zip(rows, digested(plainly([r.text for r in rows])), strict=True))
    assert result(align.align(docs, A, B)) == want


def test_edges_repeats_and_odd_columns(spark):
    rows = [(i if i % 5 else None, t, 1, "x") for i, t in enumerate(EDGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `slice` long, `pairs.n` string")
    want = sorted((-1 if r[0] is None else r[0], *w) for r, w in zip(rows, digested(plainly(EDGE)), strict=True))
    assert result(align.align(docs, A, B)) == want
    assert result(align.align(docs.where("false"), A, B)) == []
    assert result(align.align(docs.where("doc_id IS NULL AND text IS NULL"), A, B)) == [(-1, 0, 0, 0, 0, 0, 0, "")]
