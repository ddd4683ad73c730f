"""DuckDB SQL with the same rows as the text queries that SQL can express."""

from __future__ import annotations

from tidewatch.llm import quality

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP3 = f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url ELSE '' END AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, say) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT page_id, host, path, rh || rp AS rule, say, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
  FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, h.host, h.path, f.rule, coalesce(say, 'allow') AS verdict FROM h LEFT JOIN f ON f.page_id = h.page_id AND k = 1"""

_pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP4 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_pattern}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_pattern}') AS w FROM benchmark),
bp AS (SELECT item, i AS j, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
bw AS (SELECT DISTINCT item, n, win FROM bp),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON bw.n = dw.n AND bw.win = dw.win),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1),
m AS (SELECT doc_id, item, i, dw.n, i - j AS g, i - row_number() OVER (PARTITION BY doc_id, item, i - j ORDER BY i) AS island FROM dw JOIN bp ON bp.n = dw.n AND bp.win = dw.win),
l AS (SELECT doc_id, min(i) AS i, max(n) + count(*) - 1 AS size FROM m GROUP BY doc_id, item, g, island),
lo AS (SELECT doc_id, max(size) AS longest, arg_min(i, (-size, i)) - 1 AS longest_at FROM l GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, coalesce(longest, 0)::BIGINT AS longest_hit, longest_at::BIGINT AS longest_at, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN lo USING (doc_id)"""

_esc = lambda c: f"replace(replace({c}, '\\', '\\\\'), '<|', '<\\|')"
OP6 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len("<|turn|>") + 1 + len("<|end|>") + 1} + length(replace({_esc("role")}, chr(10), '\\n')) + length({_esc("text")}))::BIGINT AS formatted_chars FROM c GROUP BY 1"""


def _js(p: tuple[str, ...]) -> str:
    """Jensen-Shannon distance of counts c and r_c, base 2."""
    a, b = " + ".join(p), " + ".join(f"r_{c}" for c in p)
    part = []
    for c in p:
        x, y = f"({c}::DOUBLE / nullif({a}, 0))", f"(r_{c}::DOUBLE / nullif({b}, 0))"
        for m, n in ((x, y), (y, x)):
            part.append(f"CASE WHEN {m} > 0 THEN {m} * log2(2 * {m} / ({m} + {n})) ELSE 0 END / 2")
    return f"sqrt(greatest({' + '.join(part)}, 0))"


_words = ", ".join(f"'{w}'" for w in quality.WORDS)
_lists = "CASE lang " + " ".join(f"WHEN '{lang}' THEN [{', '.join(f"'{w}'" for w in ws)}]" for lang, ws in quality.COMMON.items()) + " END"
_bins = ", ".join(f"len(list_filter(c, lambda x: x = m[{k - 1}])) AS w{k}" for k in range(2, len(quality.BINS)))


def _js_bins() -> tuple[str, str, str]:
    """Both totals of the word bins, with the pseudo-counts, and their Jensen-Shannon distance from totals nw and rw."""
    k = len(quality.BINS)
    n, m = (" + ".join(f"{pre}{c}" for c in quality.BINS) + f" + {quality.SMOOTH * k}" for pre in ("", "r_"))
    part = []
    for c in quality.BINS:
        x, y = f"(({c} + {quality.SMOOTH}) / nw)", f"((r_{c} + {quality.SMOOTH}) / rw)"
        part += [f"{x} * log2(2 * {x} / ({x} + {y}))", f"{y} * log2(2 * {y} / ({x} + {y}))"]
    return n, m, f"sqrt(greatest(({' + '.join(part)}) / 2, 0))"


_nw, _rw, _jw = _js_bins()
_gone = lambda pattern: f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))"
OP9 = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
  list_filter(string_split(regexp_replace(lower(t), '[^a-zß-ÿ]+', ' ', 'g'), ' '), lambda x: x IN ({_words})) AS c, {_lists} AS m FROM d),
q AS (SELECT doc_id, lang, len(w) AS n_words, length(t) AS n_chars, {_gone("[\\x20\\x09-\\x0D]+")} AS c_space, {_gone("[#*$%&|<>]+")} AS c_symbol, {_gone("[a-z]+")} AS c_lower, {_gone("[A-Z]+")} AS c_upper,
  {_gone("[0-9]+")} AS c_digit, {_gone("[^\\x00-\\x7F]+")} AS c_high, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(c) AS n_common, {_bins} FROM w),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
m AS (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM m GROUP BY 1),
a AS (SELECT q.*, n_chars - c_space - c_symbol - c_lower - c_upper - c_digit - c_high AS c_punct, greatest(0, n_words - n_common) AS w0, n_common - {" - ".join(quality.BINS[2:])} AS w1, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM q LEFT JOIN rep USING (doc_id)),
ref AS (SELECT lang, {", ".join(f"sum({c}) AS r_{c}" for c in (*quality.CHARS, *quality.BINS))} FROM a WHERE NOT base_failed GROUP BY 1),
b AS (SELECT *, {_nw} AS nw, {_rw} AS rw FROM a LEFT JOIN ref USING (lang)),
j AS (SELECT *, CASE WHEN n_chars >= {quality.MIN_CHARS} AND {" + ".join(f"r_{c}" for c in quality.CHARS)} >= {quality.MIN_REFERENCE_CHARS} THEN {_js(quality.CHARS)} END AS jc,
  CASE WHEN n_words >= {quality.MIN_WORDS} AND {" + ".join(f"r_{c}" for c in quality.BINS)} >= {quality.MIN_REFERENCE_WORDS} AND lang IN ({", ".join(f"'{k}'" for k in quality.COMMON)}) THEN {_jw} END AS jw FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, (n_chars - c_space)::BIGINT AS word_chars, c_symbol::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(jc, 0) <= {quality.MAX_CHAR_DISTANCE} AND coalesce(jw, 0) <= {quality.MAX_WORD_DISTANCE} AS kept, round(jc, 6) AS js_chars, round(jw, 6) AS js_words FROM j"""

_h = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
OP13 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, {_h} FROM d),
k AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
c AS (SELECT *, array_to_string(list_slice(w, 1, a), '') AS pre, array_to_string(list_slice(w, a + 1, b), '') AS mid, array_to_string(list_slice(w, b + 1, n), '') AS suf FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(pre || mid || suf) AS restored_sha256 FROM c"""

ORACLE = {"op3_urls": OP3, "op4_decontamination": OP4, "op6_chat": OP6, "op9_quality": OP9, "op13_infill": OP13}
