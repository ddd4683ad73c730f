"""Secret scans by assignment-aware lexing.

A lexer reads pairs of a name and an expression out of source and configuration text: `name = literal`, `name: literal`,
`"name": "literal"`, `name := literal`, `export NAME=literal`, `set name literal`, `<name>literal</name>`,
`name="..." value="..."` and YAML blocks (`name: >` with indented lines). A small grammar reads the expression: literals
(quoted, with escapes, in triple quotes also over lines) and names, joined by + or side by side, also over line ends
after + and in brackets, calls that only convert a literal (`new String("...")`), f-strings and templates, whose
pieces are literals and whose placeholders are names. A name that is bound to no literal adds nothing. A bare value goes to the next blank, quote, comma, semicolon or bracket, and has a digit
unless the line is only NAME=value. Constants are followed (`k = "..."` then `api_key = k`, also `k + "..."`). Each
literal is scored by the sensitivity of the name that it finally reaches, its length and its entropy. Spans of fixed
patterns (assign, access, hex) are always reported; the lexer adds spans of kind `literal`.

A joined constant keeps its two parts and their letter counts, so that text grown in a loop takes linear time.

Defined results: a null text is empty and has no spans; very long texts are read whole; repeated rows each get their
own row; spans with one start are in the order of their kinds; an empty table gives no rows; other columns of the input
are ignored, or kept as they are where documents are rewritten.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_batches

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Names that make a literal sensitive, with their weight.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 2.5, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0,
    "accesskey": 3.0, "privatekey": 3.0, "credential": 2.5, "authorization": 2.0, "bearer": 2.0, "auth": 1.5,
    "signingkey": 3.0, "encryptionkey": 3.0, "clientsecret": 3.0, "connectionstring": 2.0,
}
#: name and operator; an expression follows.
STATEMENT = re.compile(r"""(?<![\w.$-])["']?(?P<name>[A-Za-z_$][\w.$-]*+)["']?[ \t]*+(?P<op>:=|=>|=(?!=)|:(?![:/]))""")
#: The other forms of a name with its value.
COMMAND = re.compile(r"""^[ \t]*+(?:set|setx|setenv|export|define)[ \t]++(?P<name>[A-Za-z_$][\w.$-]*+)[ \t]++(?=["'\w])""", re.M)
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:-]*+)(?:[ \t\n][^<>]*+)?+>(?P<value>[^<>]++)</(?P=name)[ \t]*+>")
PAIR = re.compile(r"""\b(?:name|key)=(["'])(?P<name>[\w.$-]++)\1\s++value=(["'])(?P<value>[^"'\n]*+)\3""")
QUOTED = re.compile(
    r"""(?P<prefix>[A-Za-z]{0,2})(?:\"\"\"(?P<d3>(?:[^\\"]|\\.|"(?!""))*+)\"\"\"|\'\'\'(?P<s3>(?:[^\\']|\\.|'(?!''))*+)\'\'\'"""
    r"""|"(?P<d>(?:[^"\\\n]|\\.)*+)"|'(?P<s>(?:[^'\\\n]|\\.)*+)'|`(?P<b>[^`\n]*+)`)""",
    re.S,
)
PREFIXES = frozenset(["", *"frbuFRBU", "rb", "br", "fr", "rf", "Rb", "bR", "RB", "BR"])
REFERENCE = re.compile(r"([A-Za-z_$][\w.$]*+)(?=[ \t]*+(?:[+;,)\]}\r\n#]|\Z))")
#: A call that only converts its literal.
CALL = re.compile(r"(?:new[ \t]++)?+(?:\w+\.)*(?:String|SecretString|SecretStr|SecureString|Secret|StringBuilder|NSString|Text|str|bytes|char|b64decode)\(")
HOLE = re.compile(r"\$?\{([^{}]*)\}")
BLOCK = re.compile(r"[ \t]*+[|>][+-]?\d?[+-]?[ \t]*+(?:#[^\n]*+)?\r?\n")
_ESCAPE = re.compile(r"\\(.)", re.S)
#: A bare value goes to the next blank, quote, comma, semicolon or bracket; a call or an index is none.
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
CALLED = frozenset("([")
#: What is left of a line NAME=value, as in .env files.
LINE = re.compile(r"([^\s\"'`,;(){}\[\]<>]++)[ \t]*+\r?$", re.M)
EXPORT = re.compile(r"(?:export[ \t]++)?")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
BLANK = re.compile(r"[ \t]*+")
ANY_BLANK = re.compile(r"(?:\s|\\\r?\n)*+")
PLUS = re.compile(r"(?:[ \t]|\\?\r?\n)*+\+(?:\s|\\\r?\n)*+")
_NO_KEY = re.compile(r"\$\{|<[^>]*>|\*{3}|%\(|\s\s|^\s|\s$|[^\S ]")
#: A literal is reported from this score on.
THRESHOLD = 4.0


def name_weight(name: str) -> float:
    plain = re.sub(r"[^a-z0-9]", "", name.lower())
    return max((w for k, w in SENSITIVE.items() if k in plain), default=0.0)


def literal_score(name: str, literal: str) -> float:
    """Name weight, plus entropy; 0 for what can't be a key (short, white space, placeholders)."""
    return Literal(0, len(literal), literal).score(name)


class Literal:
    """A literal of a text, or two values joined. Letters are counted when first asked for; those of a join at once."""

    __slots__ = ("parts", "start", "end", "value", "known", "passed")

    def __init__(self, start: int, end: int, value: str, parts: tuple[Literal, Literal] | None = None):
        self.start, self.end, self.value, self.parts, self.passed = start, end, value, parts, False
        self.known: tuple[int, Counter] | None = None
        if parts:
            (k, c), (l, d) = parts[0].counted(), parts[1].counted()
            self.known = max(k, l), c + d

    def counted(self) -> tuple[int, Counter]:
        """Kind and letter counts. 0 may be a key; 1 words with single blanks; 2 no key; 3 a private key."""
        if not self.known:
            v = self.value
            kind = 3 if PEM.search(v) else 2 if _NO_KEY.search(v) else int(" " in v)
            self.known = kind, Counter(v)
        return self.known

    def score(self, name: str) -> float:
        w = name_weight(name)
        if not w:
            return 0.0
        kind, chars = self.counted()
        n = chars.total()
        if kind == 3:
            return w + 4.0
        if n < 6 or kind == 2 or kind == 1 and "passphrase" not in re.sub(r"[^a-z]", "", name.lower()):
            return 0.0
        bits = -sum(c / n * math.log2(c / n) for c in chars.values())
        return w + min(bits, 4.0) * min(n, 16) / 16

    def leaves(self) -> list[Literal]:
        """Literals of the value that no earlier call has given."""
        out, todo = [], [self]
        while todo:
            v = todo.pop()
            if v.passed:
                continue
            v.passed = True
            if v.parts:
                todo += v.parts
            else:
                out.append(v)
        return out


#: kind (lit, ref, bare or line), start, end, value
Operand = tuple[str, int, int, str]


def quoted(text: str, m: re.Match) -> list[Operand]:
    """A quoted literal, or the pieces and names of an f-string or template."""
    g = m.lastgroup
    a, value = m.start(g), m[g]
    if g in ("d3", "s3"):  # in triple quotes, the blank space around the literal is layout
        a, value = a + len(value) - len(value.lstrip()), value.strip()
    if not ("f" in m["prefix"].lower() or g == "b" and "${" in value) or "{" not in value:
        return [("lit", a, a + len(value), _ESCAPE.sub(r"\1", value))]
    out: list[Operand] = []
    at = 0
    for hole in HOLE.finditer(value):
        out += [("lit", a + at, a + hole.start(), value[at : hole.start()]), ("ref", a + hole.start(1), a + hole.end(1), hole[1].strip())]
        at = hole.end()
    return [o for o in [*out, ("lit", a + at, a + len(value), value[at:])] if o[3]]


def expression(text: str, at: int) -> list[Operand]:
    """Operands joined by + or side by side from a place on; within brackets, line ends are blanks."""
    out: list[Operand] = []
    depth, at = 0, BLANK.match(text, at).end()
    while at < len(text):
        if text[at] == "(" or (call := CALL.match(text, at)):
            at, depth = at + 1 if text[at] == "(" else call.end(), depth + 1
            at = ANY_BLANK.match(text, at).end()
            continue
        m = QUOTED.match(text, at)
        if m and m["prefix"] in PREFIXES:
            out += quoted(text, m)
        elif m := REFERENCE.match(text, at):
            out.append(("ref", m.start(), m.end(), m[1]))
        else:
            break
        at = m.end()
        while depth and (end := ANY_BLANK.match(text, at).end()) < len(text) and text[end] == ")":
            at, depth = end + 1, depth - 1
        if p := PLUS.match(text, at):
            at = p.end()
            continue
        at = (ANY_BLANK if depth else BLANK).match(text, at).end()
        # The next literal may stand beside this one.
        if not out or out[-1][0] != "lit" or not (m := QUOTED.match(text, at)) or m["prefix"] not in PREFIXES:
            break
    return out


def block(text: str, line: int, at: int) -> list[Operand]:
    """Lines of a YAML block: those indented deeper than the line of its name."""
    indent = BLANK.match(text, line).end() - line
    out: list[Operand] = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        value = text[at:end].strip()
        a = at + len(text[at:end]) - len(text[at:end].lstrip())
        if value and a - at <= indent:
            break
        out += [("lit", a, a + len(value), value)] if value else []
        at = end + 1
    return out


def lex(text: str) -> list[tuple[str, list[Operand]]]:
    """(name, operands) in the order of the text."""
    found: list[tuple[int, str, list[Operand]]] = []
    line = before = first = 0
    low = high = last = -1  # the last run of bare characters, and the place of its last digit (-1: no value)
    for m in STATEMENT.finditer(text):
        if (end := text.rfind("\n", before, m.start("name"))) >= 0:
            line = end + 1
        if end >= 0 or not before:
            first = EXPORT.match(text, line).end()
        before, ops = m.start("name"), []
        if m["op"] == "=" and first == m.start() and m.end() == m.end("name") + 1 and (o := LINE.match(text, m.end())):
            ops = [("line", o.start(1), o.end(1), o[1])]
        elif m["op"] == ":" and (o := BLOCK.match(text, m.end())):
            ops = block(text, line, o.end())
        else:
            ops = expression(text, m.end())
            at = BLANK.match(text, m.end()).end()
            if not ops and at < len(text) and text[at] != "=":
                if not low <= at < high and (o := BARE.match(text, at)):
                    low, high = o.span()
                    last = max((i for i in range(low, high) if text[i].isdigit()), default=-1) if text[high : high + 1] not in CALLED else -1
                if low <= at < high and at <= last:
                    ops = [("bare", at, high, "")]
        found.append((m.start("name"), m["name"], ops))
    for m in COMMAND.finditer(text):
        ops = expression(text, m.end())
        if (o := LINE.match(text, m.end())) and (not ops or ops[0][0] == "ref"):
            ops = [("bare", o.start(1), o.end(1), o[1])]
        found.append((m.start("name"), m["name"], ops))
    for form in (ELEMENT, PAIR):
        for m in form.finditer(text):
            value = m["value"].strip()
            a = m.start("value") + len(m["value"]) - len(m["value"].lstrip())
            found.append((m.start("name"), m["name"], [("lit", a, a + len(value), value)]))
    return [(name, ops) for _, name, ops in sorted(found, key=lambda f: f[0]) if ops]


def is_bare_key(kind: str, value: str) -> bool:
    """Whether an unquoted value that no name is bound to is a literal: in code, most are names, which seldom hold digits."""
    digits = sum(c.isdigit() for c in value)
    return kind == "line" or (digits >= 3 and len(value) >= 16 if kind == "ref" and "." in value else digits > 0)


def literal_spans(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that reach a sensitive name, directly or through constants; the score is that of
    the first name that is high enough."""
    bound: dict[str, Literal | tuple[int, int]] = {}
    found: dict[tuple[int, int], float] = {}
    taken = -1  # end of the last bare value reported: what is bare inside it is part of it
    for name, ops in lex(text):
        if ops[0][0] == "bare":
            _, a, b, _ = ops[0]
            bound[name] = (a, b)
            if b > taken and name_weight(name) and (score := Literal(a, b, text[a:b]).score(name)) >= THRESHOLD:
                taken, found[a, b] = b, max(score, found.get((a, b), 0.0))
            continue
        whole: Literal | None = None
        for kind, a, b, value in ops:
            known = bound.get(value) if kind != "lit" else None
            if isinstance(known, tuple):
                known = bound[value] = Literal(*known, text[slice(*known)])
            if kind == "lit" or known is None and len(ops) == 1 and is_bare_key(kind, value):
                known = Literal(a, b, value)
            if known:
                whole = Literal(0, 0, "", (whole, known)) if whole else known
        if not whole:
            continue
        bound[name] = whole
        score = whole.score(name)
        if score >= THRESHOLD:
            for v in whole.leaves():
                if v.end > v.start:
                    found.setdefault((v.start, v.end), score)
    return sorted((a, b, s) for (a, b), s in found.items())


_HINTS = ("pass", "secret", "token", "key", "pwd", "credential", "auth", "bearer", "connection")


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each as (start, kind index, end), sorted."""
    text = text or ""
    low = text.lower()
    base: list[tuple[int, int, int]] = []
    extra: list[tuple[int, int, int]] = []
    if any(h in low for h in _HINTS) and ("=" in text or ":" in text):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        extra = [(a, 3, b) for a, b, _ in literal_spans(text)]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    return base, sorted(base + extra)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"


def _rows(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
    out["doc_id"] = cols["doc_id"]
    for text in cols["text"]:
        base, spans = scan(text)
        n = Counter(k for _, k, _ in spans)
        for k, c in enumerate(("n_assign", "n_access", "n_hex", "n_literal")):
            out[c].append(n[k])
        out["base_sha256"].append(hashlib.sha256(shown(base).encode()).hexdigest())
        out["spans"].append(shown(spans))
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs with counts and spans (code points, end exclusive). No shuffle."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(own, _rows, SCHEMA, "text")


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with every reported span, overlaps merged, replaced by `mark`."""
    out, end = [], 0
    for a, _, b in scan(text)[1]:
        if b <= end:
            continue
        if a >= end:
            out += [text[end:a], mark]
        end = b
    return "".join([*out, text[end:]])


def redact_documents(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """documents with secrets replaced in text and n_chars set anew where the text changed; null texts stay null."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]

    def rows(cols: dict[str, list]) -> dict[str, list]:
        text = [t and redact(t, mark) for t in cols["text"]]
        out = {**{c: cols[c] for c in rest}, "text": text}
        if "n_chars" in cols:
            out["n_chars"] = [n if a == b else len(b) for n, a, b in zip(cols["n_chars"], cols["text"], text, strict=True)]
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, rows, schema, "text")
