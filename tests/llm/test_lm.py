"""The Kneser-Ney model against counting with dictionaries over strings."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import SF
from tidewatch.llm import lm

EDGE = [None, "", " ", "a", "A a  Á á", "same text here", "same text here", "x\x0by\x0cz \x00 \x1c", "the cat sat on the mat the cat sat", "é\U0001f600 end", "word " * 3000, "b a b a b b a"]


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


class Plain:
    """Modified Kneser-Ney, order by order, with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        raw = Counter()
        self.unigram = Counter()
        for t in texts:
            seq = ["<"] * (order - 1) + tokens(t)
            self.unigram.update(tokens(t))
            raw.update(tuple(seq[i : i + order]) for i in range(len(seq) - order + 1))
        self.n, self.v = sum(self.unigram.values()), len(self.unigram)
        self.count = {order: raw}
        for k in range(order - 1, 0, -1):
            self.count[k] = Counter(g[1:] for g in self.count[k + 1])
        self.cut, self.after, self.sums = {}, {}, {}
        for k, count in self.count.items():
            n = Counter(count.values())
            if n[1] and n[2] and n[3]:
                y = n[1] / (n[1] + 2 * n[2])
                self.cut[k] = [0] + [j - (j + 1) * y * n[j + 1] / n[j] for j in (1, 2, 3)]
            else:
                self.cut[k] = [0, 0.5, 1.0, 1.5]
            after = self.after[k] = defaultdict(list)
            for g, c in count.items():
                after[g[:-1]].append(c)

    def p(self, gram):
        if not gram:
            return 1 / (self.v + 1)
        lower = self.p(gram[1:])
        k = len(gram)
        context, cut = gram[:-1], self.cut[k]
        if context not in self.after[k]:
            return lower
        if context not in self.sums:
            after = self.after[k][context]
            self.sums[context] = sum(after), sum(cut[min(x, 3)] for x in after)
        total, spare = self.sums[context]
        c = self.count[k].get(gram, 0)
        return (max(c - cut[min(c, 3)], 0) + spare * lower) / total

    def scores(self, text):
        seq = ["<"] * (self.order - 1) + tokens(text)
        score = sum(math.log10(self.p(tuple(seq[i : i + self.order]))) for i in range(len(seq) - self.order + 1))
        known = [self.unigram[t] for t in tokens(text)]
        base = sum(math.log10((c + 1) / (self.n + self.v + 1)) for c in known)
        return len(known), sum(c > 0 for c in known), self.n, base, score


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def compare(df, rows, order):
    plain = Plain([t for i, t in rows if not held(i)], order)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted(((i, held(i), *plain.scores(t)) for i, t in rows), key=key)
    got = sorted((tuple(r)[:7] for r in df.collect()), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=2e-6, atol=1e-9)
    return plain


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_model_equals_dictionaries(spark, order):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(1000 + i, t) for i, t in enumerate(EDGE)] + [(None, "no id here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert any(held(i) for i, _ in rows)
    plain = compare(lm.score_corpus(docs, order), rows, order)
    words = [*plain.unigram, "never seen"]
    for context in [(), *(g[:-1] for g in list(plain.count[order])[:5])]:
        assert abs(sum(plain.p((*context, w)) for w in words) - 1) < 1e-9


def test_whole_table_in_small_slices(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(lm, "SLICE_BYTES", 60_000)
    monkeypatch.setattr(lm, "SCORE_BYTES", 40_000)
    compare(lm.score_corpus(docs), [tuple(r) for r in docs.collect()], lm.ORDER)


def test_edges_and_odd_columns(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(EDGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `stats.n` string, shard long")
    compare(lm.score_corpus(docs), [r[:2] for r in rows], lm.ORDER)
    assert lm.score_corpus(docs.where("false")).collect() == []
    only = docs.where(lm.held_out(docs.doc_id))
    assert only.count() and {(r.train_tokens, r.base_score, r.score) for r in lm.score_corpus(only).collect()} == {(0, 0.0, 0.0)}


def test_score_tells_text_from_noise(spark):
    """Held-out texts are likelier than the single-word base has them, and likelier than their words shuffled."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = lm.score_corpus(docs).where("held_out AND n_tokens > 50").collect()
    assert len(got) > 10 and sum(r.score for r in got) > sum(r.base_score for r in got)
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)


def test_folder_must_be_a_path():
    assert lm.mapped_folder("file:///a/b") == lm.mapped_folder("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        lm.mapped_folder("hdfs://host/a")
