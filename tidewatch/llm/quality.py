"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's character-class histogram, and its histogram over its language's common words (a bin for each, case folded and
without punctuation, one for the other languages' common words and one for the rest; half a word is added to each bin),
are compared with those of its
language, taken over all documents of that language that pass the base rules, by the Jensen-Shannon distance (base 2, so
0 to 1). A document is rejected if a distance exceeds its limit; documents with too few characters or words for a
histogram, or whose language has too little text for a reference or no list of common words, are not judged by that
distance. Fixed base rules come
first: fewer than 50 words, or more than half of all words in 3-word windows that the document repeats.

Counts of a document are computed in one pass without a shuffle and written; the references are sums by language
(partial sums first, so a hot language costs nothing), joined back to rows that are a few numbers each.

Defined results: a null or empty text has no words and fails the base rules; very long texts are read whole; repeated
rows each get a row; a null language is a language of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import written

#: Common words by language.
COMMON = {
    "en": "the of and to in is that it for was on with as by at be this are from or".split(),
    "fr": "le la les de des et un une du en est que qui dans pour par sur au avec pas".split(),
    "de": "der die das und in den von zu mit ist des ein eine für auf im dem nicht als auch".split(),
    "es": "el la los las de que y en un una por con no para es se lo su al del".split(),
}
SYMBOLS = "#*$%&|<>"
#: Limits of the distances, and the least characters and words of a document and of a language's reference.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.55
MIN_CHARS, MIN_WORDS, MIN_REFERENCE_CHARS, MIN_REFERENCE_WORDS = 200, 50, 20_000, 4_000
#: Added to each bin of a word histogram.
SMOOTH = 0.5
#: Languages whose references (a few numbers each) are broadcast; beyond, both sides are dealt out.
MAX_BROADCAST = 10_000
_SPACES = " \t\n\x0b\x0c\r"
CHARS = ("c_lower", "c_upper", "c_digit", "c_space", "c_symbol", "c_punct", "c_high")
#: Bins of the word histogram: all other words, other languages' common words, then the language's list (one length).
WORDS = tuple(sorted({w for ws in COMMON.values() for w in ws}))
BINS = tuple(f"w{k}" for k in range(len(COMMON["en"]) + 2))


def _less(text: Column, pattern: str) -> Column:
    """Characters of text in runs of a pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: the rules' counts, both histograms and the columns `keep`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    kept = [F.col(f"`{c}`").alias(f"k_{c}") for c in keep]
    names = [f"`k_{c}`" for c in keep]
    q = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(lang, F.lit("")).alias("lang"), text.alias("t"), *kept)
    q = q.select(
        "doc_id", "lang", "t", *names,
        F.array_remove(F.split("t", "[ \\t-\\r]+", -1), "").alias("w"),
        F.expr("filter(split(t, '\\n', -1), x -> x rlike '[^ \\\\t-\\\\r]')").alias("lines"),
        F.length("t").cast("long").alias("n_chars"),
        (F.length("t") - F.length(F.translate("t", _SPACES, ""))).cast("long").alias("c_space"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("c_symbol"),
        _less(F.col("t"), "[a-z]+").cast("long").alias("c_lower"),
        _less(F.col("t"), "[A-Z]+").cast("long").alias("c_upper"),
        _less(F.col("t"), "[0-9]+").cast("long").alias("c_digit"),
        _less(F.col("t"), "[^\\x00-\\x7F]+").cast("long").alias("c_high"),
    )
    q = q.withColumns(
        {
            "n": F.size("w"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "g": F.expr("CASE WHEN size(w) < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END"),
            "ca": F.filter(F.split(F.regexp_replace(F.lower("t"), "[^a-zß-ÿ]+", " "), " "), lambda x: x.isin(*WORDS)),
        }
    )
    # Only documents that repeat a window pay for the sort.
    q = q.withColumn(
        "s", F.expr("CASE WHEN size(array_distinct(g)) = size(g) THEN NULL ELSE sort_array(transform(g, (x, i) -> struct(x AS h, i AS i))) END")
    )
    q = q.withColumn("d", F.expr("transform(filter(s, (x, k) -> (k > 0 AND s[k - 1].h = x.h) OR (k < size(s) - 1 AND s[k + 1].h = x.h)), x -> x.i)"))
    q = q.withColumn("n_repeat_words", F.expr("CASE WHEN d IS NULL THEN 0L ELSE cast(size(array_distinct(concat(d, transform(d, x -> x + 1), transform(d, x -> x + 2)))) AS bigint) END"))
    q = q.withColumns(
        {
            "n_words": F.col("n").cast("long"),
            "word_chars": F.col("n_chars") - F.col("c_space"),
            "n_symbols": F.col("c_symbol"),
            "c_punct": F.col("n_chars") - sum((F.col(c) for c in CHARS if c != "c_punct"), F.lit(0)),
        }
    )
    marked = ", ".join(f"'{lang}', array({', '.join(f"' {w} '" for w in ws)})" for lang, ws in COMMON.items())
    # The common words alone, each between two blanks of its own, so that a bin's count is what its removal takes.
    q = q.withColumns({"n_common": F.size("ca"), "c": F.concat(F.lit(" "), F.array_join("ca", "  "), F.lit(" "))})
    q = q.withColumn("m", F.expr(f"coalesce(try_element_at(map({marked}), lang), cast(array() AS array<string>))")).withColumn("l", F.length("c"))
    q = q.withColumn("bins", F.expr("transform(m, k -> cast((l - length(replace(c, k, ''))) DIV length(k) AS bigint))"))
    q = q.withColumn("n_own", F.expr("aggregate(bins, 0L, (x, y) -> x + y)"))
    rest = F.array(F.greatest(F.lit(0), F.col("n_words") - F.col("n_common")), F.col("n_common") - F.col("n_own"))
    q = q.withColumn("bins", F.when(F.size("m") > 0, F.concat(rest, "bins")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return q.select(
        "doc_id", "lang", *names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_chars", *CHARS, "bins"
    )


def js_distance(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms given as counts; null if either is empty."""
    total = [reduce(lambda a, b: a + b, x).cast("double") for x in (p, q)]

    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(F.lit(2.0) * a / (a + b))).otherwise(0.0)

    shares = [[F.try_divide(c.cast("double"), t) for c in x] for x, t in zip((p, q), total, strict=True)]
    parts = [(half(a, b) + half(b, a)) / 2 for a, b in zip(*shares, strict=True)]
    value = F.sqrt(F.greatest(reduce(lambda a, b: a + b, parts), F.lit(0.0)))
    return F.when((total[0] > 0) & (total[1] > 0), value)


def js_of_bins(p: Column, q: Column, n: Column, m: Column) -> Column:
    """The same of two arrays of counts with totals n and m, which include the SMOOTH that is added to each bin."""
    half = lambda a, b: a * F.log2(F.lit(2.0) * a / (a + b))
    both = F.zip_with(p, q, lambda x, y: F.struct(((x + SMOOTH) / n).alias("a"), ((y + SMOOTH) / m).alias("b")))
    total = F.aggregate(both, F.lit(0.0), lambda s, x: s + (half(x["a"], x["b"]) + half(x["b"], x["a"])) / 2)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def judge(counts: DataFrame) -> DataFrame:
    """Adds js_chars, js_words and kept. counts is read twice, so it should be a written table."""
    own = counts.where(~F.col("base_failed")).groupBy(F.col("lang").alias("r_lang"))
    sums = own.agg(*(F.sum(c).alias(f"r_{c}") for c in CHARS), F.array(*(F.sum(F.get("bins", F.lit(k))) for k in range(len(BINS)))).alias("r_bins"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    sums = written(sums.withColumn("r_words", total("r_bins")))
    few = sums.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    both = counts.join(F.broadcast(sums) if few else sums, F.col("lang") == F.col("r_lang"), "left")
    cols = lambda names, pre="": [F.col(pre + c) for c in names]
    chars = sum(cols(CHARS, "r_"), F.lit(0))
    more = SMOOTH * len(BINS)
    both = both.withColumns({"own_words": total("bins") + more, "ref_words": F.col("r_words") + more})
    both = both.withColumns(
        {
            "js_chars": F.when((F.col("n_chars") >= MIN_CHARS) & (chars >= MIN_REFERENCE_CHARS), js_distance(cols(CHARS), cols(CHARS, "r_"))),
            "js_words": F.when((F.col("n_words") >= MIN_WORDS) & (F.col("r_words") >= MIN_REFERENCE_WORDS), js_of_bins(F.col("bins"), F.col("r_bins"), F.col("own_words"), F.col("ref_words"))),
        }
    )
    far = (F.coalesce("js_chars", F.lit(0.0)) > MAX_CHAR_DISTANCE) | (F.coalesce("js_words", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return both.withColumn("kept", ~F.col("base_failed") & ~far)


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_chars", "js_words")


def rate_documents(docs: DataFrame) -> DataFrame:
    """The rules' counts and verdict for every row of docs."""
    rated = judge(written(document_counts(docs)))
    return rated.withColumns({c: F.round(c, 6) for c in ("js_chars", "js_words")}).select(*RESULT)


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    rated = judge(written(document_counts(docs, keep=tuple(docs.columns))))
    return rated.where("kept").select(*(F.col(f"`k_{c}`").alias(c) for c in docs.columns))
