"""Operators on pages, URLs, secrets, chats, benchmark windows, BPE and quality rules against brute force."""

import hashlib
import json
import random
import re
import string
import time
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SF
from tidewatch.llm import bpe, chat, common, decontaminate, html, quality, queries, secrets, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long, url string, rule string"


def docs_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "u", "r") for i, t in zip(ids, texts, strict=True)], DOC)


def rows(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is not None, r[key]))


EDGE = [None, "", " ", "a", "x " * 3000, "same text here", "same text here", "é\U0001f600\x00   end"]


# --- HTML ----------------------------------------------------------------------------------------------------------


def test_extract_article_only():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a>Home</a></nav>"
        "<header><p>Site, header.</p></header><div class='cookie-notice'>We use cookies.</div><div class=ad>Buy, now.</div>"
        "<article><h1>Title &amp; more</h1><p><b>First   para\n of text, long enough.<br><p>Second &eacute;, one.</p><p>Ok.</p>"
        "<form><p>Mail: <input></p></form></article><aside class=sidebar><p>Other, stories.</p></aside>"
        "<section id=comments><p>Great, post.</p></section><footer>&copy; x</footer></body></html>"
    )
    assert html.extract(page) == "Title & more\nFirst para of text, long enough.\nSecond é, one.\nOk."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- x", "</p></p>", "<script>", "<div>" * 3000])
def test_extract_defined_on_junk(page):
    assert isinstance(html.extract(page), str)


def test_extract_without_article_tag():
    page = "<body><div class=menu><a>a</a></div><div><p>" + "Words, of text. " * 20 + "</p><p>Short.</p></div><footer>f</footer></body>"
    assert html.extract(page) == ("Words, of text. " * 20).strip() + "\nShort."


def test_extract_keeps_all_scored_blocks():
    long = ("Words, of text. " * 30).strip()
    two = f"<body><div class=text><p>{long}</p></div><div class=text><p>{long} b</p></div></body>"
    assert html.extract(two) == f"{long}\n{long} b"
    plain = f"<body><h1>Head</h1><p>{long[:300].strip()}</p><blockquote>{long[:400].strip()}</blockquote></body>"
    assert html.extract(plain) == f"Head\n{long[:300].strip()}\n{long[:400].strip()}"


def test_extract_recovers_from_layout_words():
    long = ("Words, of text. " * 30).strip()
    for page in (
        f"<div class='content-sidebar-wrap'><main><p>{long}</p></main></div>",
        f"<div class='layout has-sidebar'><p>{long}</p></div>",
        f"<article data-title='Hidden gems' data-slug=hidden-x><p>{long}</p></article>",
        f"<div data-id=menu><p>{long}</p></div>",
        f"<article><svg width=1 /><p>{long}</p></article><svg></svg>",
        f"<datalist><option value=a><option value=b></datalist><article><p>{long}</p></article>",
    ):
        assert html.extract(page) == long
    assert html.extract(f"<p>{long} <math><mi>x</mi></math></p>") == long + " x"


# --- URLs ----------------------------------------------------------------------------------------------------------


PROSE = "<p>The river was long, and the boats went slowly along it; nobody knew why, but they did.</p>"


@pytest.mark.parametrize(
    "page,want,lost",
    [
        ('<div class="layout with-sidebar"><article><h1>Head</h1>{}</article><aside>Side</aside></div>', ["Head"], ["Side"]),
        ('<header>Site</header><header class="entry-header"><h1>Headline</h1></header><div class="entry-content">{}</div>', ["Headline"], ["Site"]),
        ("<div><a href=a>One</a> <a href=b>Two</a> <a href=c>A long link, with commas, too</a></div><article>{}</article>", [], ["One", "commas"]),
        ("<article><p>Sum of <math><mi>x</mi></math> and more, so it goes on.</p>{}</article>", ["Sum of x and more"], []),
        ('<main>{}<section class="comments"><p>Nice post, thanks a lot, really good.</p></section></main>', [], ["Nice post"]),
        ('<table><tr><td><font>{}</font></td></tr></table><form><p>Subscribe now, please.</p></form>', [], ["Subscribe"]),
        ("<article><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></article>", ["One", "Two"], []),
    ],
)
def test_extract_templates(page, want, lost):
    whole = "<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav>" + page.replace("{}", PROSE * 4) + "<footer>Foot</footer></body></html>"
    got = html.extract(whole)
    assert got.count("The river was long") == (4 if "{}" in page else 0)
    assert all(w in got for w in want) and not any(w in got for w in [*lost, "Home", "Foot"])


def test_the_threshold_selects(monkeypatch):
    page = f"<body><nav>Home</nav><article><h1>Head</h1>{PROSE * 4}</article><footer>Foot</footer></body>"
    assert "Foot" not in html.extract(page)
    monkeypatch.setattr(html, "ALPHA", 0.0)
    assert "Foot" in html.extract(page)


LONG = "<p>" + "The river was long, and the boats went slowly along it; nobody knew why, but they did. " * 3 + "</p>"
UNMARKED = {
    "copyright": f"<div><h1>Head</h1>{LONG * 4}<p>Ok.</p></div><div>Copyright 2020 Foo</div>",
    "beside an article": f"<article><h1>Head</h1>{LONG * 4}<p>Ok.</p></article><div>Copyright 2020 Foo</div>",
    "menu": f"<ul><li>Home<li>News<li>Shop</ul><div><h1>Head</h1>{LONG * 4}<p>Ok.</p></div><div>Imprint</div>",
    "menu of blocks": f"<div><span>Home</span></div><div>News</div><div><h1>Head</h1>{LONG * 4}<p>Ok.</p></div>",
    "comments": f"<article><h1>Head</h1>{LONG * 4}<p>Ok.</p></article><section id=discussion><p>I liked this, thanks a lot.</p></section>",
    "short comments": f"<div><h1>Head</h1>{LONG * 4}<p>Ok.</p></div><section id=discussion><p>I liked this, thanks.</p></section>",
}


def constant_scores(found, able):
    return np.array([float(ok and linked < html.LINKED * len(t)) for (_, t, linked), ok in zip(found, able, strict=True)])


@pytest.mark.parametrize("page", UNMARKED.values(), ids=UNMARKED)
def test_ratios_decide_where_no_word_does(page, monkeypatch):
    want = ["Head", *[LONG[3:-4].strip()] * 4, "Ok."]
    assert html.extract(f"<body>{page}</body>").split("\n") == want
    monkeypatch.setattr(html, "path_scores", constant_scores)
    assert html.extract(f"<body>{page}</body>").split("\n") != want


def test_ratios_find_articles_of_the_table_without_marks(monkeypatch):
    pages = pq.read_table(f"{SF}/pages.parquet")["html"].to_pylist()
    lines = lambda t: set(t.split("\n"))

    def found() -> tuple[float, float]:
        """Shares of the article's lines found and of the lines found that are the article's, menus and marks made div."""
        plain = [re.sub(r"<(/?)(article|footer|nav)\b", r"<\1div", p).replace(' class="ad"', "") for p in pages]
        both = [(lines(html.extract(p)), w) for p, w in zip(plain, want, strict=True)]
        hit = sum(len(g & w) for g, w in both)
        return hit / sum(len(w) for _, w in both), hit / sum(len(g) for g, _ in both)

    want = [lines(html.extract(p)) for p in pages]
    recall, precision = found()
    monkeypatch.setattr(html, "path_scores", constant_scores)
    assert recall == 1.0 and precision > found()[1] + 0.03


def test_ambiguous_words_inside_an_article():
    aside = "<p>Trains, of course, went by the river as well.</p>"
    page = lambda words: html.extract(f"<article><h1>Head</h1>{LONG * 2}<div class='{words}'>{aside}</div>{LONG * 2}</article>")
    assert "Trains" in page("rail-transport") and "Trains" in page("legal_history wide")
    assert "Trains" not in page("rail") and "Trains" not in page("right-rail") and "Trains" not in page("sidebar wide")


BROKEN = {
    "no bracket": "<a href=x ", "quote": '<a "', "value": '<a b="', "two quotes": "<a b=\"><a b='>", "nested": "<div>x", "inline": "<b>x ", "comment": "<!--",
    "object": "<object>x", "option": "<option>x", "paragraph": "<p>x, y.", "items": "<ul><li>x", "bracket": "<", "reference": "&", "ends": "<b></i>",
}


@pytest.mark.parametrize("part", BROKEN.values(), ids=BROKEN)
def test_a_megabyte_of_broken_markup_takes_seconds(part):
    began = time.perf_counter()
    whole = html.extract(f"<p>{LONG}</p>" + part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 10 and whole.startswith("The river")


def test_ends_are_matched_within_borders():
    assert html.extract("<span><div><b>a, b.</span> c, d.</div>") == "a, b. c, d."
    assert html.extract('<p title="a > b">Text, here.</p><p title=">More, text.</p>') == "Text, here.\nMore, text."
    assert html.extract("<ul><li>One, a.<ul><li>Two, b.</ul><li>Three, c.</ul>") == "One, a.\nTwo, b.\nThree, c."


def test_very_long_pages_and_clashing_columns(spark):
    long = "<article>" + PROSE * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "u", long, "t", 5, "q")], "page_id long, url string, html string, text string, n_chars long, `a.b` string")
    assert [(r.page_id, r.n_chars) for r in html.extract_pages(df).collect()] == [(1, (len(PROSE) - 6) * 20_000 - 1)]


def test_pages_query_on_edges(spark):
    df = spark.createDataFrame([(1, "u", None), (1, "u", PROSE), (1, "u", PROSE), (None, None, "")], "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in html.extract_pages(df).collect()) == [0, 0, len(PROSE) - 7, len(PROSE) - 7]
    assert html.extract_pages(df.limit(0)).count() == 0


def brute_rule(url, rules):
    host, path = urls.split_url(url)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[3:] if fits else (None, "allow")


@pytest.mark.parametrize("block", [2, 1000])
def test_urls_match_brute_force(spark, block):
    rnd = random.Random(3)
    hosts = ["org", "example.org", "m.example.org", "com", "x.com", "ample.org", "example.org.com", ""]
    paths = ["", "/", "/e", "/es/", "/es/1", "/en/12", "/fr/"]
    rules = [(rnd.choice(hosts[:-1]), rnd.choice(paths), rnd.choice(["allow", "block"])) for _ in range(12)]
    pages = [f"http{rnd.choice(['', 's'])}://{rnd.choice(hosts).upper()}{rnd.choice(paths)}{rnd.choice(['', '?a=/es/', '#b'])}" for _ in range(150)]
    pages += [None, "", "nothing", "://", "http://?x", "http://x.com:80/fr/"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    rule_df = spark.createDataFrame(rules, "host string, path string, verdict string")
    for r in rows(urls.filter_urls(df, rule_df, block_rules=block), "page_id"):
        assert (r["rule"], r["verdict"]) == brute_rule(pages[r["page_id"]], rules), pages[r["page_id"]]
        assert (r["host"], r["path"]) == urls.split_url(pages[r["page_id"]])


def test_urls_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r["verdict"] for r in rows(urls.filter_urls(df, none), "page_id")] == ["allow"]
    assert urls.filter_urls(df.limit(0), none).count() == 0


# --- decontamination -------------------------------------------------------------------------------------------------


def brute_hits(text, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    plain = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = plain(text), set(), set()
    for item, t in items:
        b = plain(t)
        for k in range(max(1, len(b) - 9)) if b else ():
            win = b[k : k + 10]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [15, 10**6])
def test_hits_match_brute_force(spark, block):
    rnd = random.Random(5)
    vocab = ["the", "of", "été", "a1", "x", "Y", "zz"]
    said = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, said(n)) for i, n in enumerate([1, 2, 9, 10, 11, 25, 0])] + [(50, None), (51, "...")]
    texts = [*EDGE, *(said(rnd.randint(0, 60)) for _ in range(40)), said(30) + ". " + items[5][1].upper() + " " + said(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_hits(docs_of(spark, texts), bench, block_words=block)
    for r in rows(out):
        n = sum(s["end"] - s["start"] for s in r["spans"])
        got = (r["n_words"], n, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), n > 0)
        assert got == brute_hits(texts[r["doc_id"]], items)


def test_longest_match(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    out = rows(decontaminate.find_hits(docs_of(spark, ["x one two three four y", "none"]), bench))
    assert [r["longest"] for r in out] == [4, 0] and not any(r["spans"] for r in out)
    assert decontaminate.digest_hits(docs_of(spark, ["a"]).limit(0), bench).count() == 0
    kept = decontaminate.remove_contaminated(docs_of(spark, ["a b", None]), bench.limit(0))
    assert kept.columns == docs_of(spark, ["a"]).columns and kept.count() == 2


def brute_longest(text, items):
    """Longest run of item words in the text that holds a whole window, and its first place."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    plain = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, best = plain(text), (0, None)
    for _, t in items:
        b = plain(t)
        for i in range(len(w)):
            for k in range(len(b)):
                n = 0
                while i + n < len(w) and k + n < len(b) and w[i + n] == b[k + n]:
                    n += 1
                if (n >= 10 or 0 < len(b) == n) and (n > best[0] or n == best[0] and i < best[1]):
                    best = (n, i)
    return best


@pytest.mark.parametrize("block", [30, 10**6])
def test_longest_hits_match_brute_force(spark, block):
    rnd = random.Random(11)
    vocab = ["the", "of", "été", "a1", "x"]
    said = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, said(n)) for i, n in enumerate([3, 12, 40, 40, 90])]
    items.append((9, items[4][1][30:200] + " " + said(20)))
    texts = [*EDGE]
    for _ in range(25):
        _, t = rnd.choice(items[2:])
        w = t.split()
        k = rnd.randint(0, 15)
        texts.append(f"{said(4)} {' '.join(w[k : k + rnd.randint(8, 60)])} {said(6)} {' '.join(w[:12])}")
    out = decontaminate.find_hits(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    for r in rows(out):
        assert (r["longest_hit"], r["longest_at"]) == brute_longest(texts[r["doc_id"]], items)


# --- secrets ---------------------------------------------------------------------------------------------------------


def test_secret_spans():
    hexed = "0123456789abcdef01234567"
    base, spans = secrets.scan(f'API_Key: "{hexed}" AKIA{"A1" * 8} pwd = "kX9!vQ2#zL7m"; short token=abc')
    assert [(k, b - a) for a, k, b in base] == [(0, len('API_Key: "') + 24), (2, 24), (1, 20)]
    assert [b - a for a, k, b in spans if k == 3] == [24, 12]
    assert set(base) <= set(spans)


def test_secret_constants_and_concatenation():
    spans = secrets.literal_spans('k1 = "Zx81mQpL"\nk2 = "v93hKs0t"\nclient_secret = k1 + k2\ncolor = "Zx81mQpL"\n')
    assert len(spans) == 2
    assert not secrets.literal_spans('password = "${DB_PASSWORD}"\ncolour = "f3ef4d6b2755a36d"\n')


def test_secret_bare_values():
    for line in ("export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG", "db_pwd: k7Xq9ZpL2m", "DB_PWD=9f8Kq2LmZx71\n", "db.pwd = k7Xq9ZpL2m"):
        found = [line[a:b] for a, b, _ in secrets.literal_spans(line)]
        assert found == [line.strip().replace(": ", "=").replace(" = ", "=").split("=")[1]]
    assert not secrets.literal_spans("token = get_token()\npwd = os.environ\ncolour: k7Xq9ZpL2m\n")


def test_secret_pem_spaces_and_long():
    pem = "-----BEGIN PRIVATE KEY-----\\nMIIEvQ9x\\n-----END PRIVATE KEY-----\\n"
    long = "aZ3k" * 2000
    cases = (("private_key", pem), ("passphrase", "correct horse battery staple"), ("token", long), ("x" * 200 + "_pwd", "k7Xq9ZpL2m"))
    for name, value in cases:
        text = f'"{name}": "{value}"'
        assert [text[a:b] for a, b, _ in secrets.literal_spans(text)] == [value]
    many = "pwd = " + " + ".join(f'"k{i}Xq"' for i in range(100))
    assert len(secrets.literal_spans(many)) == 100


def test_secret_escapes_and_triple_quotes():
    found = lambda t: [t[a:b] for a, k, b in secrets.scan(t)[1] if k == 3]
    assert found('secret_key = "abc\\"Zx81mQpLq"') == ['abc\\"Zx81mQpLq']
    assert found('api_key = """\nZx81mQpLq77\n"""') == ["Zx81mQpLq77"]
    long = "aB3$" * 3000
    assert found(f'db_password = "{long}"') == [long]


def planted(rnd: random.Random) -> tuple[str, list[str]]:
    """A configuration or source text and the literals in it that belong to sensitive names."""
    key = lambda n=10: "".join(rnd.sample(string.ascii_letters, n)) + str(rnd.randrange(100, 1000))
    out, want = [], []
    for k in range(12):
        a, b = key(), key()
        name = rnd.choice(["db_pwd", "client_secret", "apiKey", "auth_token", "PASSWORD", "signing.key", "credential"])
        plain = rnd.choice(["colour", "host_name", "title", "path"])
        pad, q = " " * rnd.choice([0, 1, 45]), rnd.choice("\"'")
        line, found = rnd.choice([
            (f"{name}{pad}={pad}{q}{a}{q}", [a]),
            (f'"{name}"{pad}:{pad}"{a}",', [a]),
            (f"{name} := {q}{a}{q};", [a]),
            (f"export {name.replace('.', '_')}={a}", [a]),
            (f"{name} = ({q}{a}{q} {q}{b}{q})", [a, b]),
            (f"{name} = (\n    {q}{a}{q}\n    {q}{b}{q}\n)", [a, b]),
            (f"{name} = {q}{a}{q} +\n    {q}{b}{q}", [a, b]),
            (f"{name}: >\n  {a}\n  {b}\nend: 1", [a, b]),
            (f"set {name} {q}{a}{q}", [a]),
            (f"<{name}>{a}</{name}>", [a]),
            (f'<property name="{name}" value="{a}"/>', [a]),
            (f'String {name} = new String("{a}");', [a]),
            (f"c{k}: {a}\n{name}: c{k}", [a]),
            (f"c{k} = {q}{a}{q}\n{name} = c{k}", [a]),
            (f"c{k} = {q}{a}{q}\n{name} = f{q}{{c{k}}}{b}{q}", [a, b]),
            (f"{plain}{pad}= {q}{a}{q}", []),
            (f"<{plain}>{a}</{plain}>", []),
            (f"set {plain} {q}{a}{q}", []),
            (f"{name} = os.getenv({q}{a}{q})", []),
            (f"{name} = table[{q}{a}{q}]", []),
            (f"{name} = f{q}{{unknown}}{q}", []),
            (f"{name} = f{q}{{unknown}}{a}{q}", [a]),
            (f"{name} = unknown + {q}{a}{q}", [a]),
            (f"{name} = {q}${{{a}}}{q}", []),
            (f"if {name} == {q}{a}{q}:", []),
            ("it's a line, of words; they're here: nothing to see", []),
        ])
        out.append(line)
        want += found
    return "\n".join(out) + "\n", want


def test_planted_literals_are_found_and_no_others():
    rnd = random.Random(11)
    for _ in range(300):
        text, want = planted(rnd)
        assert sorted(text[a:b] for a, b, _ in secrets.literal_spans(text)) == sorted(want), text


@pytest.mark.parametrize(
    "part",
    ['pwd = pwd + "ab1c"\n', "pwd = pwd + pwd\n", "a=", "pwd=(", "pwd='", 'pwd="""', "pwd=a1 ", "<pwd>a", "pwd: >\n", "pwd = a + ", "pwd = new ", "a.", "set a b ", "pwd \t "],
)
def test_half_a_megabyte_of_statements_takes_seconds(part):
    began = time.perf_counter()
    secrets.scan('pwd = "ab1cdEf" ' + part * (1000 if "pwd + pwd" in part else 500_000 // len(part)))
    assert time.perf_counter() - began < 10


def brute_base(text):
    """Base spans, character by character: kind, start, end."""
    text = text or ""
    out = []
    key = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", re.I | re.A)
    at = 0
    while at < len(text):
        m = key.match(text, at)
        end = m.end() if m else at
        while m and end < len(text) and text[end] in string.ascii_letters + string.digits + "+/_.=-":
            end += 1
        if m and end > m.end():
            out += [("assign", at, end)] if end - m.end() >= 6 else []
            at = end
        else:
            at += 1
    for kind, first, letters, least in (("access", "AKIA", string.ascii_uppercase + string.digits, 20), ("hex", "", string.digits + "abcdef", 24)):
        at = 0
        while at < len(text):
            end = at + len(first)
            while text.startswith(first, at) and end < len(text) and text[end] in letters:
                end += 1
            found = text.startswith(first, at) and end > at + len(first)
            out += [(kind, at, end)] if found and end - at >= least else []
            at = end if found else at + 1
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_spans_of_the_whole_table_match_a_scan_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op5_secrets(spark, SF).collect():
        want = brute_base(text[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), r.doc_id
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex"))
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_secret_query_defined_on_edges(spark):
    out = rows(secrets.scan_secrets(docs_of(spark, EDGE)))
    assert [r["n_assign"] + r["n_access"] + r["n_hex"] for r in out] == [0] * len(EDGE)
    assert {r["base_sha256"] for r in out} == {hashlib.sha256(b"").hexdigest()}
    done = rows(secrets.redact_documents(docs_of(spark, [None, 'a token = "04dbebab91ab85687d33eeaa" b'])))
    assert done[0]["text"] is None and done[1]["text"].count("[secret]") == 1 and done[1]["n_chars"] == len(done[1]["text"])
    assert "token" not in done[1]["text"]


# --- chats -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "plain", "<|turn|>user\n<|end|>\n", "\\<|\\\\|", "a\\n<|", "<\\|end|>"])
def test_chat_round_trip(text):
    chat_text = chat.write_turn("us\ner\\", text) + chat.write_turn("assistant", text)
    assert [(r, t) for r, t, _, _ in chat.read_turns(chat_text)] == [("us\ner\\", text), ("assistant", text)]
    assert [chat.unescape(chat_text[a:b]) for a, b in chat.loss_spans(chat_text)] == [text]


def test_chat_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"strange": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, None), (10, "{")], "id long, record string")
    out = rows(chat.format_records(df), "id")
    assert len({r["formatted"] for r in out[:4]}) == 1 and [r["formatted"] for r in out[4:]] == [None] * 3
    assert len({r["fingerprint"] for r in out[:5]}) == 5


def test_chat_query(spark):
    got = {r["conv_id"]: r for r in rows(queries.op6_chat(spark, SF), "conv_id")}
    said = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        said[r.conv_id].append((r.role, r.text or ""))
    said[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(said)
    for k, turns in said.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k]["n_turns"], got[k]["loss_chars"]) == (len(turns), len(loss))
        assert got[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_defined_on_nulls_and_ties(spark):
    df = spark.createDataFrame([(None, 1, "user", None), (None, 1, "user", None), (1, None, None, "x")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r["n_turns"] for r in rows(chat.digest_chats(df), "conv_id")}
    assert out == {None: 2, 1: 1}
    assert chat.digest_chats(df.limit(0)).count() == 0


# --- BPE -------------------------------------------------------------------------------------------------------------


def test_roles_come_back_whatever_the_layout(spark):
    """Conversations take layouts by their id: the same turns must give the same digests in each."""
    said = [("bot", "a"), ("model", "b"), ("ai", "c"), ("human", "d"), ("gpt", "e"), ("user", "f"), ("assistant", "g"), ("tool", "h"), (None, None)]
    turns = spark.createDataFrame([(c, k, r, t, "x") for c in range(8) for k, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string, `a.record` string")
    got = chat.digest_chats(chat.canonical_turns(queries.chat_records(turns))).collect()
    want = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in said).encode()).hexdigest()
    assert len(got) == 8 and {(r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {(want, 1, hashlib.sha256(b"g").hexdigest())}


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.WordBPE(path), Tokenizer.from_file(path)


def test_bpe_matches_the_library(both, spark):
    own, lib = both
    rnd = random.Random(1)
    letters = "abcdefghijklmnopqrst'  \n\tAÉÇé́ΣςİſK\x1c\x85​᠎ 日本12٣½Ⅷ&%#<|>\U0001f600ǅ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rnd.choice("aehinort") for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    texts += ["a" * 4000, "&" * 3000, "x<|endoftext|>y <|startoftext|>", "", "it's we'LL"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = own.encode(text).tolist()
        assert ids == e.ids, text[:80]
        assert own.decode(ids).decode() == lib.decode(e.ids, skip_special_tokens=False)


def test_bpe_query_edges(both, spark):
    _, lib = both
    path = public_tokenizers.path("word_bpe_49k.json")
    for r in rows(bpe.digest_documents(docs_of(spark, EDGE), path)):
        ids = lib.encode(EDGE[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    encoded = bpe.encode_documents(docs_of(spark, EDGE), path)
    assert bpe.decode_documents(encoded, path).count() == len(EDGE)


# --- quality ---------------------------------------------------------------------------------------------------------


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    again = {j for v in windows.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed


def test_quality_matches_brute_force(spark):
    rnd = random.Random(2)
    texts = [*EDGE, *("".join(rnd.choice(["a ", "b ", "é", "\n", "\n\n", "\x0b", "% ", " ", "c d\n"]) for _ in range(rnd.randint(0, 300))) for _ in range(60))]
    for r in rows(quality.rate_documents(docs_of(spark, texts))):
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == brute_quality(texts[r["doc_id"]])
    assert quality.rate_documents(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_quality_rejects_text_of_another_language(spark):
    rnd = random.Random(6)
    common = quality.COMMON
    said = lambda lang: " ".join(rnd.choice(common[lang]) if rnd.random() < 0.5 else "w" + rnd.choice("abcdefgh") * rnd.randint(2, 6) for _ in range(300))
    texts = [said("en") for _ in range(40)] + [said("fr")]
    out = rows(quality.rate_documents(docs_of(spark, texts).withColumn("lang", F.lit("en"))))
    assert [r["kept"] for r in out] == [True] * 40 + [False] and out[-1]["js_words"] > quality.MAX_WORD_DISTANCE > max(r["js_words"] for r in out[:-1])
    unknown = rows(quality.rate_documents(docs_of(spark, texts).withColumn("lang", F.lit("xx"))))
    assert all(r["kept"] and r["js_words"] is None for r in unknown)


def test_quality_rejects_symbol_text_and_keeps_prose(spark):
    rnd = random.Random(4)
    words = ["the", "river", "stone", "of", "light", "and", "a", "window", "under", "grey"]
    prose = [" ".join(rnd.choice(words) + rnd.choice("abcdefgh") for _ in range(300)) for _ in range(30)]
    junk = " ".join(f"{rnd.choice(words)}{rnd.randint(0, 9)}%%%" + "#" * 8 for _ in range(300))
    out = rows(quality.rate_documents(docs_of(spark, [*prose, junk])))
    assert [r["kept"] for r in out] == [True] * 30 + [False]
    kept = quality.keep_documents(docs_of(spark, [*prose, junk]))
    assert kept.count() == 30 and kept.columns == docs_of(spark, ["a"]).columns


# --- stages on odd tables ----------------------------------------------------------------------------------------------


def test_stages_keep_odd_columns_and_bear_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [None, "", long, long, "the river and the light " * 3, 'token = "Zx81mQpLq77"']
    docs = docs_of(spark, texts, [1, None, 3, 3, 5, 6])
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.col("source").alias(c) for c in ("a.b", "kd", "kh", "k", "row", "class_key", "k_text", "bins", "spans", "items", "c")))
    for df in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert set(out.columns) == set(odd.columns), name
            got = out.collect()
            assert name != "secrets" or len(got) == df.count()
            assert all(r["a.b"] == r["source"] for r in got)
        assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == df.count()


def test_work_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError):
        common.work_dir(Session())


# --- SQL -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    plain = lambda table: sorted(tuple(str(v) for v in r) for r in table)
    assert plain(tuple(r[c] for c in names) for r in got.collect()) == plain(want.select(*names).fetchall())
