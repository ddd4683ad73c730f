"""Chat formatting by schema fingerprints.

A record's layout is the set of its nested field paths (array elements as `[]`); the sorted paths' hash is its
fingerprint. A table of declarative mappings, keyed by fingerprint, says where turns, roles and texts stand in that
layout; applying one needs no code per layout. Canonical turns (role, text) are then written in one template:

    <|turn|>ROLE\\nTEXT<|end|>\\n

Inside roles and texts a backslash is written `\\\\`, `<|` is `<\\|`, and a line end inside a role is `\\n`, so no text
can look like a turn mark and the original comes back exactly. The loss mask covers the text of assistant turns.

Tables of turns go the same way: each row is a record of some layout, is read by its fingerprint's mapping, and the turns
that come out are put in order by conversation, turn and place in the record.

Defined results: null texts and roles are empty; ties in the turn number are ordered by role, then text; repeated rows
are repeated turns; null turn numbers come first; a null conversation id is a conversation of its own; very long texts
are kept whole; an empty table has no conversations; other columns are ignored. Layouts without a mapping become
records with a null `turns` and the fingerprint, so that nothing is lost silently.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_batches

TURN, END = "<|turn|>", "<|end|>\n"
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if role else text


def unescape(text: str, role: bool = False) -> str:
    return _ESCAPED.sub(lambda m: "\n" if role and m[1] == "n" else m[1], text)


def write_turn(role: str, text: str) -> str:
    return f"{TURN}{escape(role, True)}\n{escape(text)}{END}"


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the escaped text in `formatted`."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn mark at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        yield unescape(formatted[at + len(TURN) : line], True), unescape(formatted[line + 1 : end]), line + 1, end
        at = end + len(END)


def loss_spans(formatted: str, trained: tuple[str, ...] = ("assistant",)) -> list[tuple[int, int]]:
    return [(a, b) for role, _, a, b in read_turns(formatted) if role in trained]


# --- layouts ---------------------------------------------------------------------------------------------------------


def field_paths(value: Any, at: str = "") -> set[str]:
    """Nested field paths of a record; array elements are `[]`, leaves count without their values."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: Names that the from-value layout uses for the canonical roles; other layouts have roles as they are.
SPOKEN = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
#: Declarative mappings: the layout's paths, then either `turns` (list, role and text fields; `roles`, its names) or `parts`
#: (role and the fields whose non-empty texts are joined by a blank line).
LAYOUTS: list[dict[str, Any]] = [
    {"paths": {"role", "text"}, "row": ("role", "text")},
    {"paths": {"turn.speaker", "turn.body.content"}, "row": ("turn.speaker", "turn.body.content")},
    {"paths": {"messages[].role", "messages[].content"}, "turns": ("messages", "role", "content")},
    {"paths": {"conversations[].from", "conversations[].value"}, "turns": ("conversations", "from", "value"), "roles": SPOKEN},
    {"paths": {"prompt", "response"}, "parts": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"paths": {"prompt", "completion"}, "parts": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"paths": {"question", "answer"}, "parts": [("user", ["question"]), ("assistant", ["answer"])]},
    {"paths": {"instruction", "output"}, "parts": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"paths": {"instruction", "input", "output"}, "parts": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"paths": {"system", "prompt", "response"}, "parts": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
]
MAPPINGS = {fingerprint(m["paths"]): m for m in LAYOUTS}


def canonical(record: dict[str, Any]) -> tuple[str, list[tuple[str, str]] | None]:
    """The fingerprint and the turns; None where no mapping is known."""
    print_ = fingerprint(field_paths(record))
    m = MAPPINGS.get(print_)
    if m is None:
        return print_, None
    if "row" in m:
        role, text = (reduce(lambda v, k: v[k], at.split("."), record) for at in m["row"])
        return print_, [(role or "", text or "")]
    if "turns" in m:
        name, role, text = m["turns"]
        names = m.get("roles", {})
        return print_, [(names.get(t[role], t[role]) or "", t[text] or "") for t in record[name]]
    joined = [(role, "\n\n".join(record[f] for f in fields if record[f])) for role, fields in m["parts"]]
    return print_, [(r, t) for r, t in joined if t or r != "system"]


def format_records(records: DataFrame, id_col: str = "id", json_col: str = "record") -> DataFrame:
    """Records of any known layouts, as JSON, to formatted chats: id, fingerprint, n_turns, formatted, loss (spans)."""

    def rows(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": cols["id"], "fingerprint": [], "n_turns": [], "formatted": [], "loss": []}
        for raw in cols["record"]:
            try:
                record = json.loads(raw or "null")
            except ValueError:
                record = None
            print_, turns = canonical(record if isinstance(record, dict) else {})
            chat = None if turns is None else "".join(write_turn(r, t) for r, t in turns)
            out["fingerprint"].append(print_)
            out["n_turns"].append(None if turns is None else len(turns))
            out["formatted"].append(chat)
            out["loss"].append(None if chat is None else [{"start": a, "end": b} for a, b in loss_spans(chat)])
        return out

    own = records.select(F.col(id_col).cast("long").alias("id"), F.col(json_col).cast("string").alias("record"))
    schema = "id long, fingerprint string, n_turns long, formatted string, loss array<struct<start: long, end: long>>"
    return map_batches(own, rows, schema, "record")


# --- tables with a row for each turn ---------------------------------------------------------------------------------

DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Reader:
    """Reads one formatted conversation as it is written, turn by turn, and keeps digests only."""

    def __init__(self, conv: int | None):
        self.conv, self.n, self.loss, self.chars = conv, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text, a, b in read_turns(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                inside = unescape(formatted[a:b])
                self.loss += len(inside)
                self.masked.update(inside.encode())

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def canonical_turns(records: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", json_col: str = "record") -> DataFrame:
    """conv_id, turn, at (place in the record), role, text, fingerprint of all turns of records of known layouts, as JSON.

    A record without a mapping, or that is no JSON object, is one row with null role and text. No shuffle.
    """

    def rows(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("conv_id", "turn", "at", "role", "text", "fingerprint")}
        for conv, turn, raw in zip(cols["conv_id"], cols["turn"], cols["record"], strict=True):
            try:
                record = json.loads(raw or "null")
            except ValueError:
                record = None
            print_, turns = canonical(record if isinstance(record, dict) else {})
            for k, (role, text) in enumerate([(None, None)] if turns is None else turns):
                for c, v in zip(out, (conv, turn, k, role, text, print_), strict=True):
                    out[c].append(v)
        return out

    own = records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(json_col).cast("string").alias("record"))
    return map_batches(own, rows, "conv_id long, turn long, at long, role string, text string, fingerprint string", "record")


def turn_rows(turns: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows in order: each conversation is in one partition, sorted by turn, place in its record, role and text.

    A conversation is one record and its digests are sequential, so it stays in one task; but it streams through it a
    batch at a time and is never collected, so that its length is not bounded by memory.
    """
    own = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        (F.col("at").cast("long") if "at" in turns.columns else F.lit(0)).alias("at"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = own.repartition(parts, "conv_id") if parts else own.repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "at", "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn number in the chat, formatted: the template's text of each turn, in order within conv_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = [object(), 0]
        for b in batches:
            cols = b.to_pydict()
            out: dict[str, list] = {"conv_id": cols["conv_id"], "at": [], "formatted": []}
            for conv, role, text in zip(cols["conv_id"], cols["role"], cols["text"], strict=True):
                now = [conv, now[1] + 1] if conv == now[0] else [conv, 0]
                out["at"].append(now[1])
                out["formatted"].append(write_turn(role, text))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("formatted", pa.string())]))

    return turn_rows(turns).mapInArrow(run, "conv_id long, at long, formatted string")


def digest_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted turns."""
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    types = [pa.string() if "string" in c else pa.int64() for c in DIGESTS.split(", ")]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reader | None = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], schema=schema)

        for b in batches:
            done = []
            cols = b.to_pydict()
            for conv, text in zip(cols["conv_id"], cols["formatted"], strict=True):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.row())
                    now = _Reader(conv)
                now.feed(text)
            yield made(done)
        if now:
            yield made([now.row()])

    return format_turns(turns).select("conv_id", "formatted").mapInArrow(run, DIGESTS)
