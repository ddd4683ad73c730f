"""Fill-in-middle against a form of it that uses strings and a regular expression only."""

import hashlib
import re

import pytest

from tests.conftest import SF
from tidewatch.llm import infill

EDGE = [None, "", " ", "a", "word word", "<P> held", "x<M>y", "a<S", "<", "<<P<", ">P<", "é\U0001f600\x00z  end\r\n", "[`{@", "ab" * 90_000, "1 " * 50_000, "same", "same"]


def plainly(text, doc_id):
    text = text or ""
    parts = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(parts), "plain", None, None, text
    a, b = sorted((h1 % (len(parts) + 1), h2 % (len(parts) + 1)))
    pre, mid, suf = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h4 % 100 < 20:
        return len(parts), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(parts), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("text", EDGE[:13] + ["<P" * 40, "P><S" * 30])
def test_infill_equals_strings_and_restores(text):
    forms = set()
    for i in [None, -5, *range(300)]:
        got = infill.infill(text, i)
        assert tuple(got) == plainly(text, i)
        assert infill.restore(got.output, got.form) == (text or "")
        forms.add(got.form)
    assert forms == ({"plain", "psm", "spm"} if text and not re.search("<[PSM]>", text) else {"plain"})


def test_whole_table_and_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in infill.transform(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(t, i)
    assert {r.doc_id: r.text for r in infill.restored(infill.transform(docs)).collect()} == {i: t or "" for i, t in texts.items()}


def test_edges_repeats_and_odd_columns(spark):
    rows = [(i, t, 1, "o") for i, t in enumerate(EDGE)] + [(None, "no id here", 2, "o"), (3, "a", 1, "o"), (3, "other text", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.n` long, output string").withColumnsRenamed({"a.n": "n.form"})
    got = sorted((tuple(x or "" for x in r) for r in infill.digest_infills(docs).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        *head, out = plainly(t, i)
        want.append(tuple(x or "" for x in (i, *head, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
    assert got == sorted(want, key=str)
    assert infill.digest_infills(docs.where("false")).collect() == []
