"""Repeats, near duplicates, shared passages and the pipeline against brute force."""

import cProfile
import hashlib
import pstats
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_text_operators import EDGE, docs_of, rows
from tidewatch.llm import chains, neardup, repeats
from tidewatch.llm.shingles import shingle, word_hashes


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check_repeats(spark, texts, length):
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(repeats.repeated_spans(docs_of(spark, texts), length))]
    assert got == brute_repeats(texts, length)


def test_repeats_small_alphabet(spark):
    rnd = random.Random(8)
    texts = [*EDGE, *("".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 120))) for _ in range(40))]
    texts += [texts[9][:50] + "z" + texts[10][5:70], texts[12], "ab" * 100, "ab" * 70 + "c", "q" * 300]
    check_repeats(spark, texts, 24)


def test_repeats_of_400_bytes(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 9)))
    said = lambda n: " ".join(word() for _ in range(n))
    shared = [said(90), said(70), said(130)]
    texts = [said(rnd.randint(0, 60)) + rnd.choice(shared)[rnd.randint(0, 120) :] + said(rnd.randint(0, 60)) for _ in range(30)]
    texts += [shared[0] + shared[0], shared[1][:400], shared[1][:399], "na" * 700, "na" * 500 + said(9), None, "", shared[2][:500] + "x" + shared[2][501:]]
    check_repeats(spark, texts, 400)


@pytest.mark.parametrize("length,letters", [(24, "ab"), (40, "abcdefgh "), (400, "etaoin shrdlu")])
def test_shard_arrays_combine_into_corpus_order(length, letters):
    rnd = random.Random(4)
    said = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    shared = said(length * 4)
    raw = []
    for _ in range(12):
        k = rnd.randint(0, length)
        raw.append((said(rnd.randint(0, length * 3)) + shared[k : k + rnd.randint(0, length * 3)] + rnd.choice(letters) * rnd.randint(0, length * 2)).encode())
    order, same = repeats.shard_order(raw, [np.arange(max(0, len(r) - length + 1)) for r in raw], length)
    keys = [raw[d][i : i + length] for d, i in order]
    assert keys == sorted(keys)
    assert same == [False, *(a == b for a, b in zip(keys, keys[1:], strict=False))]


def test_a_hot_passage_is_one_row_for_each_slice(spark):
    """Blocks that a slice repeats are settled there: a name goes to the join once, whatever number of documents hold it."""
    rnd = random.Random(5)
    said = lambda n: "".join(rnd.choice("etaoin shrdlu") for _ in range(n))
    hot, length = said(1500), 400
    texts = [said(100) + hot + said(100) for _ in range(40)] + [said(300) + hot[:700]]
    cols = {"text": texts, "kd": list(range(41)), "kh": [0] * 41, "seen": [range(len(t)) for t in texts]}
    cols["ranges"] = [[{"a": 100, "b": 1200}]] * 40 + [[{"a": 300, "b": 600}]]
    got = repeats._piece_rows(length)(cols)
    names = [x for x in got["name"] if x is not None]
    assert len(names) == len(set(names)) < 1200
    # Every position of the passage is settled, as one run for each document; a block alone in the slice is left open.
    runs = [r for r in zip(got["kd"], got["a"], got["b"], got["n"], strict=True) if r[3] is None]
    assert [d for d, *_ in runs] == list(range(41))
    counts = [n for n in got["n"] if n is not None]
    assert min(counts) == 1 and max(counts) == 41
    for parts in (1, 7):
        df = docs_of(spark, texts).repartition(parts)
        found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeated_spans(df, length).collect()}
        assert [found[k] for k in sorted(found)] == brute_repeats(texts, length)


def test_positions_of_a_shard_cost_few_calls():
    """Names, counts and places of a shard's positions against brute force, with few calls of Python for each."""
    rnd, length = random.Random(6), 400
    said = lambda n: "".join(rnd.choice("etaoin shrdlu") for _ in range(n))
    shared = said(900)
    texts = [said(rnd.randint(400, 900)) + shared[rnd.randint(0, 300) :] + said(50) for _ in range(12)]
    cols = {"text": texts, "kd": list(range(50, 62)), "kh": [7] * 12}
    cols["todo"] = [[{"a": 300, "b": len(t) - length, "w": 1}, {"a": 10, "b": 20, "w": 2}] for t in texts]
    calls = cProfile.Profile()
    got = calls.runcall(repeats._window_rows(length), cols)
    places = [(d, i, p["w"]) for d, todo in enumerate(cols["todo"]) for p in todo for i in range(p["a"], p["b"] + 1)]
    assert pstats.Stats(calls).total_calls < 9 * len(places)
    sums = Counter()
    for d, i, w in places:
        sums[texts[d][i : i + length]] += w
    listed = {c: pa.array(got[c]).to_pylist() for c in ("kd", "kh", "a", "b", "n")}
    found = list(zip(got["x"], *(listed[c] for c in ("kd", "a", "b", "n")), strict=True))
    assert sorted(n for x, *_, n in found if x) == sorted(sums.values())
    once = {(d + 50, i) for d, i, w in places if w == 1 and sums[texts[d][i : i + length]] == 1}
    assert {(d, a) for x, d, a, _, _ in found if x and d is not None} == once
    runs = {(d, i) for x, d, a, b, _ in found if not x for i in range(a, b + 1)}
    assert runs == {(d + 50, i) for d, i, w in places if w == 1} - once and set(listed["kh"]) == {7, None}


def test_phrase_hashes_tell_phrases_at_any_place():
    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 100, 2 * repeats.CHUNK + 40).astype(np.uint8)
    data[repeats.CHUNK - 30 : repeats.CHUNK + 30] = data[100:160]
    data[-60:] = data[100:160]
    data[5000:7000] = 97
    start = np.sort(np.concatenate([rnd.integers(0, len(data) - 70, 20_000), [100, repeats.CHUNK - 30, len(data) - 60]]))
    end = start + np.where(data[start] == 97, 60, 7)
    end[-1] = len(data)
    start, end = start[np.argsort(end, kind="stable")], np.sort(end)
    start, end = start[start == np.maximum.accumulate(start)], end[start == np.maximum.accumulate(start)]
    assert {100, repeats.CHUNK - 30, len(data) - 60} <= set(start.tolist())
    names = [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    hashes = repeats.phrase_hashes(data, start, end).tolist()
    assert len(set(names)) == len(set(hashes)) == len(set(zip(names, hashes, strict=True)))


def test_open_ranges_against_every_position():
    rnd, length = random.Random(2), 40
    for _ in range(200):
        text = "".join(rnd.choice("abcdef ") for _ in range(rnd.randint(0, 300))).encode()
        gram = repeats.shape(length)[0]
        at = repeats.triggers([text], length, 6)[0]
        often = np.array([x for x in at.tolist() if rnd.random() < 0.9], np.int64)
        once = [(a, b + gram) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False) if a not in often]
        n = len(text) - length + 1
        free = {i for i in range(n) if not any(a >= i and b <= i + length for a, b in once)}
        given = [(x, x + rnd.randint(0, 40)) for x in range(rnd.randint(0, 50), max(n - 41, 0), 60)]
        for ranges in (None, given):
            want = free if ranges is None else {i for i in free if any(a <= i <= b for a, b in ranges)}
            got = repeats.open_ranges(len(text), at, often, ranges, length)
            assert sorted(i for a, b in got for i in range(a, b + 1)) == sorted(want)


def test_repeated_rows_are_copies(spark):
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(900))
    df = docs_of(spark, [text, text, "other"], [5, 5, 6])
    assert [r["n_removed"] for r in rows(repeats.repeated_spans(df))] == [900, 900, 0]
    assert repeats.repeated_spans(df.limit(0)).count() == 0


# --- near duplicates -------------------------------------------------------------------------------------------------


def words_bag(text):
    w, at = word_hashes([text])
    return Counter(shingle(w[at[0] : at[1]], 5).tolist())


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(texts):
    bags = [words_bag(t) for t in texts]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def family():
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(8):
        base = [rnd.choice(words) for _ in range(rnd.choice([40, 120, 300]))]
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    return [*EDGE, *texts, texts[3], "one two three", "one two  three", "same words again " * 30, "same words again " * 36]


def test_near_duplicates_match_brute_force(spark, family):
    want = brute_classes(family)
    got = rows(neardup.near_duplicates(docs_of(spark, family)))
    assert [r["class_id"] for r in got] == want
    size = Counter(want)
    assert [r["class_size"] for r in got] == [size[c] for c in want]


def test_chain_of_links_is_one_class(spark):
    base = [f"t{i}" for i in range(200)]
    texts = []
    for i in range(12):  # neighbours are near, ends are far apart
        texts.append(" ".join(base))
        base[i * 15] = f"new{i}"
        base[i * 15 + 7] = f"other{i}"
    want = brute_classes(texts)
    assert len(set(want)) == 1
    assert [r["class_id"] for r in rows(neardup.near_duplicates(docs_of(spark, texts)))] == want


def test_components_join_only_the_edges_that_are_left(spark, monkeypatch):
    """A path, a star and single edges: least nodes by hand, and fewer edges in every round."""
    digest = [hashlib.blake2b(bytes([k % 256, k // 256]), digest_size=16).digest() for k in range(700)]
    edges = [(k, k + 1) for k in range(300)] + [(301, k) for k in range(302, 600)] + [(k, k + 1) for k in range(600, 700, 2)] + [(5, 5)]
    sizes = []

    def counted(df, real=neardup.written):
        out = real(df)
        if out.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(neardup, "written", counted)
    got = neardup.components(spark.createDataFrame([(digest[a], digest[b]) for a, b in edges], "a binary, b binary")).collect()
    least = lambda ks: min(digest[k] for k in ks)
    want = {digest[k]: least(range(301)) for k in range(301)} | {digest[k]: least(range(301, 600)) for k in range(301, 600)}
    want |= {digest[k]: least((k // 2 * 2, k // 2 * 2 + 1)) for k in range(600, 700)}
    assert {bytes(r.node): bytes(r.comp) for r in got} == want and len(got) == len(want)
    assert sizes[0] == 648 and sizes[-1] == 0 and sizes == sorted(set(sizes), reverse=True) and sum(sizes) < 3 * 648


def test_signature_estimates_weighted_jaccard():
    rnd = np.random.default_rng(3)
    items = rnd.integers(1, 2**63, 60, dtype=np.uint64)
    for _ in range(3):
        a, b = rnd.integers(0, 9, 60), rnd.integers(0, 9, 60)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        same = []
        for salt in range(60):
            x = items ^ np.uint64(salt * 7919 + 1)
            same.append((neardup.signature(x[a > 0], a[a > 0]) == neardup.signature(x[b > 0], b[b > 0])).mean())
        assert abs(np.mean(same) - true) < 0.03


def test_one_of_each_keeps_columns_and_rows(spark, family):
    df = docs_of(spark, [*family, family[20]], [*range(len(family)), 20])
    out = neardup.one_of_each(df)
    assert out.columns == df.columns
    want = brute_classes(family)
    empty = [i for i, t in enumerate(family) if not (t or "").split()]
    assert sorted(r.doc_id for r in out.collect()) == sorted({*want} | set(empty))
    assert neardup.near_duplicates(df.limit(0)).count() == 0


# --- passages --------------------------------------------------------------------------------------------------------


def test_chains_are_collinear_and_best():
    line = [(i * 8, 100 + i * 8) for i in range(10)]
    noise = [(3, 500), (40, 20), (75, 900)]
    best = chains.chain(line + noise)[0]
    assert best == line


def test_align_counts_gaps_and_ends():
    a = np.arange(100, dtype=np.uint32)
    b = a.copy()
    b[50] = 999
    assert chains.align(a, b, [(20, 20), (70, 70)]) == (0, 100, 0, 100, 99)


def test_chains_start_again_after_a_long_gap():
    far = [(i, 1000 + i) for i in range(0, 200, 8)]
    near = [(268 + i, 1268 + i + 3 * (i > 24)) for i in range(0, 64, 8)]
    assert chains.chain(far + near)[1] == near
    assert chains.chain(near)[0] == near


def test_chain_below_the_limit_gives_its_parts():
    a = np.arange(180, dtype=np.uint32)
    b = np.concatenate([a[:60], np.arange(900, 945, dtype=np.uint32), a[105:]])
    assert chains.passages(a, b, [(0, 0, 60), (105, 105, 75)])[0][:2] == (0, 60)


@pytest.mark.parametrize("size", [50, 100])
def test_passages_edited_down_to_the_limit(spark, size):
    rnd = random.Random(size)
    said = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    even = [[i for i in range(size) if i % step == 2] for step in (5, 8)]
    drawn = [rnd.sample(range(2, size - 2), size * share // 100) for share in (10, 15, 19) for _ in range(10)]
    texts = []
    for at in even + drawn:
        passage = said(size)
        fuzzy = [f"new{i}" if i in at else w for i, w in enumerate(passage)]
        texts += [said(30) + passage + said(30), said(20) + fuzzy + said(40)]
    out = rows(chains.shared_passages(docs_of(spark, [" ".join(t) for t in texts])))
    found = {r["doc_id"] for r in out if r["ref_doc_id"] == r["doc_id"] - 1}
    assert found == set(range(1, len(texts), 2))


def test_passages_found_and_clean_left_alone(spark):
    rnd = random.Random(6)
    words = [f"v{i}" for i in range(5000)]
    said = lambda n: [rnd.choice(words) for _ in range(n)]
    passage = said(60)
    fuzzy = list(passage)
    for i in (20, 41):
        fuzzy[i] = "changed"
    texts = [said(80) + passage + said(30), said(10) + fuzzy + said(90), said(200), said(55), None, []]
    texts.append(list(texts[2]))
    df = docs_of(spark, [None if t is None else " ".join(t) for t in texts])
    out = rows(chains.shared_passages(df))
    assert [(r["doc_id"], r["ref_doc_id"]) for r in out] == [(1, 0), (6, 2)]
    assert (out[0]["start_word"], out[0]["end_word"], out[0]["ref_start_word"]) == (10, 70, 80) and out[0]["n_match"] == 58
    assert (out[1]["end_word"], out[1]["similarity"]) == (200, 1.0)
    assert chains.shared_passages(df.limit(0)).count() == 0


def shares_run(texts, size=50):
    """Documents with a run of `size` words that another document holds too."""
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        w = (t or "").split()
        for k in range(len(w) - size + 1):
            holders[tuple(w[k : k + size])].add(i)
    return {i for d in holders.values() if len(d) > 1 for i in d}


def test_a_partner_is_kept_though_both_sides_are_in_other_passages(spark):
    """a is like p and b like q over all their words, p and q are not alike: the passage of a and b links them."""
    a = [f"w{k}" for k in range(60)]
    p = [f"p{k}" if k % 6 == 0 else w for k, w in enumerate(a)]
    b = [f"b{k}" if k % 10 == 3 else w for k, w in enumerate(a)]
    q = [f"q{k}" if k % 6 == 1 else w for k, w in enumerate(b)]
    got = rows(chains.shared_passages(docs_of(spark, [" ".join(x) for x in (p, q, b, a)])))
    links = {tuple(sorted((r["doc_id"], r["ref_doc_id"]))) for r in got}
    ids = [r["doc_id"] for r in rows(docs_of(spark, list("pqba")))]
    assert {(ids[0], ids[3]), (ids[1], ids[2]), (ids[2], ids[3])} <= links
    assert list(chains.long_chains([(0, 0, 60)])) == [[(0, 0, 60)]]  # whatever other partners cover


@pytest.mark.parametrize("parts", [1, 4])
def test_parts_of_a_passage_are_not_reported_beside_it(spark, parts):
    """Texts that repeat two words 90 times meet each other shifted by every number of repeats; one of another end is apart."""
    rnd = random.Random(31)
    said = lambda n: [f"q{rnd.randrange(10**6)}" for _ in range(n)]
    again, other = ["over", "again"] * 90, said(60)
    texts = [said(20) + again + said(30) + other, said(7) + again + said(12) + other + said(3), said(40), said(9) + again[:120] + said(5)]
    df = docs_of(spark, [" ".join(t) for t in texts]).repartition(parts, "doc_id")
    got = defaultdict(list)
    for r in rows(chains.shared_passages(df)):
        got[tuple(sorted((r["doc_id"], r["ref_doc_id"])))].append(r["n_match"])
    one, two, _, four = (r["doc_id"] for r in rows(docs_of(spark, list("abcd"))))
    assert sorted(got[one, two]) == [60, 180] and all(min(v) >= 50 for v in got.values())
    assert sum(len(v) for k, v in got.items() if four in k) <= 2 * 2 and any(four in k for k in got)
    assert chains.outermost([(0, 50, 0, 50, 50), (0, 50, 0, 50, 49), (5, 60, 0, 50, 50), (10, 60, 0, 50, 50), (10, 40, 3, 33, 30)]) == [(0, 50, 0, 50, 50), (5, 60, 0, 50, 50)]


def test_no_exact_passage_is_lost(spark):
    """Lines that recur in ever new cuts, so that the seeds of a passage have many first holders."""
    rnd = random.Random(21)
    lines = [[f"l{k}w{i}" for i in range(rnd.randint(12, 40))] for k in range(12)]
    texts = []
    for _ in range(60):
        body = [w for k in rnd.choices(range(12), k=3) for w in lines[k]] if rnd.random() < 0.7 else []
        texts.append(" ".join([f"x{rnd.random()}" for _ in range(rnd.randint(0, 30))] + body + [f"y{rnd.random()}" for _ in range(20)]))
    words = [w for line in lines[:4] for w in line]
    texts += [" ".join(words[:36]), " ".join(words[25:60]), " ".join(words[:60] + ["b"]), " ".join(["c"] + words[:60])]
    found = rows(chains.shared_passages(docs_of(spark, texts).repartition(5)))
    assert shares_run(texts) <= {r["doc_id"] for r in found} | {r["ref_doc_id"] for r in found}
    for r in found:
        a, b = texts[r["doc_id"]].split()[r["start_word"] : r["end_word"]], texts[r["ref_doc_id"]].split()[r["ref_start_word"] : r["ref_end_word"]]
        assert max(len(a), len(b)) >= 50 and 2 * r["n_match"] >= 0.8 * (len(a) + len(b)) and r["doc_id"] != r["ref_doc_id"]


def test_passages_past_the_first_margin_and_odd_rows(spark):
    rnd = random.Random(3)
    said = lambda n: [f"q{rnd.randrange(10**6)}" for _ in range(n)]
    core = said(520)
    sparse = [f"z{i}" if i % 4 == 3 and i > 120 else w for i, w in enumerate(core)]
    texts = [" ".join(core), " ".join(sparse), None, "", " ".join(said(40_000) + core[:60]), "a b c"]
    df = docs_of(spark, texts, [1, 2, None, None, 7, 8]).repartition(6)
    found = rows(chains.shared_passages(df))
    by = {frozenset((r["doc_id"], r["ref_doc_id"])): r for r in found}
    assert by[frozenset((1, 2))]["end_word"] >= 515 and any(7 in k for k in by) and all(k <= {1, 2, 7} for k in by)


def test_longest_common_subsequence():
    rnd = random.Random(2)
    for _ in range(50):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(25))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
        assert chains._lcs(a, b) == row[-1]


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(10)
    words = [a + b for a in "the river stone light window".split() for b in "abcdefghijklmnop"]
    said = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    clean = [said(120) for _ in range(40)]
    item = said(12)
    texts = [*clean, "short", clean[0], clean[1] + " extra", clean[2] + "x " + item + ".", said(90) + ' token = "04dbebab91ab85687d33eeaaf9ac699e"']
    docs = docs_of(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = defaultdict(list)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, str(tmp_path))
        assert set(out.columns) == set(docs.columns)
        out.write.parquet(str(tmp_path / f"s{i}"))
        at = spark.read.parquet(str(tmp_path / f"s{i}"))
        seen[name] = sorted(r.doc_id for r in at.collect())
    assert seen["quality"] == [*range(40), 41, 42, 43, 44]
    assert seen["near_duplicates"] == [*range(40), 43, 44] or seen["near_duplicates"] == [*range(40), 44]
    assert seen["decontamination"] == [*range(40), 44]
    assert "04dbebab" not in " ".join(r.text for r in at.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 41


def test_a_slice_never_holds_more_documents_than_a_place_can_name(spark):
    """Many short texts in one large Arrow batch; the passage's holder comes after the 65,536th."""
    rnd = random.Random(11)
    said = lambda n: [f"p{rnd.randrange(10**6)}" for _ in range(n)]
    passage = said(80)
    texts = ["one"] * 69_990 + [" ".join(said(5) + passage)] + ["two"] * 20
    setting, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(setting, "200000")
    try:
        ids = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        other = spark.createDataFrame([(900_000, " ".join(said(7) + passage + said(3)))], "doc_id long, text string").coalesce(1)
        df = ids.union(other)
        found = rows(chains.shared_passages(df))
        size = df.select("doc_id", "text").mapInArrow(chains._pack, chains._ddl(chains._SLICE)).selectExpr("size(size) AS n").collect()
    finally:
        spark.conf.set(setting, old)
    assert sum(r.n for r in size) == len(texts) + 1 and max(r.n for r in size) <= chains.SLICE_DOCS
    assert [{r["doc_id"], r["ref_doc_id"]} for r in found] == [{69_990, 900_000}]
