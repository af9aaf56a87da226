"""The other numbered operators on small tables: brute force, round trips, and rows that are null, empty, long, tied, repeated."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.llm import langid, lattice, linededup, minhash, quality, queries, rules, topk, warc
from faultline.plans.runtime import fresh_path

EXTRA = "doc_id long, text string, lang string, n long, rep string, bucket int, rank int, score double, component string, h long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", 1, 1, 0.5, "y", 7) for i, t, lang in rows], EXTRA).repartition(3)


WORDS = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta", "iota", "zeta", "rho", "tau"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


# --- rules ---------------------------------------------------------------------------------------------------------------


def test_rules_measure_apply_and_ablate(spark):
    texts = [None, "", "  \n\t", "one", "a b c a b c", "x " * 5000, "same line\nsame line\nother", "été # é", prose(1, 80), prose(1, 80), "$ " * 60]
    rows = rules.apply_policy(rules.ledger(table(spark, [(i, t, None) for i, t in enumerate(texts)])), "v1").collect()
    by = {r.doc_id: r for r in rows}
    assert len(by) == len(rows) == len(texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(zip(w, w[1:], w[2:]))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        covered = {k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        assert (by[i].n_words, by[i].word_chars, by[i].n_repeat_words, by[i].n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert by[i].kept == (by[i].fail_bits == 0)
    led = spark.createDataFrame(rows)
    got = {r.rule: (r.fails, r.alone) for r in rules.ablations(led, "v1").collect()}
    for k, name in enumerate(rules.RULES):
        assert got[name] == (sum(r.fail_bits >> k & 1 for r in rows), sum(r.fail_bits == 1 << k for r in rows))
    assert rules.ledger(table(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("n", [40_000, 1_600_000])
def test_rules_count_repeats_of_long_texts_exactly(spark, n):
    text = " ".join([*map(str, range(n)), "7", "8", "9"])  # one window twice
    assert [r.n_repeat_words for r in rules.measure(table(spark, [(1, text, None)])).collect()] == [6]


def test_rules_plan_has_no_python(spark):
    plan = queries.op6_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


# --- language ------------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy_and_edge_rows(spark):
    rows = queries.op1_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.rejected for r in rows]) < 0.01
    train = table(spark, [(1, "the quick brown fox jumps over the dog " * 9, "en"), (2, "der schnelle braune fuchs springt " * 9, "de"), (3, None, "en"), (4, "hm", None)])
    d = langid.fit(train)
    assert set(d) == {"en", "de"}
    odd = table(spark, [(0, "\u0301\u2764\ufe0f 1", None), (1, None, None), (2, "", None), (3, "12 $% 7", None), (4, "the brown fox jumps over", None), (4, "the brown fox jumps over", None), (5, "der braune fuchs springt " * 20_000, None)])
    got = sorted((r.doc_id, r.lang_pred, r.rejected) for r in langid.predict(odd, d).collect())
    assert got == [*[(i, "und", True) for i in range(4)], (4, "en", False), (4, "en", False), (5, "de", False)]
    assert langid.fit(train.limit(0)) == {} and langid.predict(odd, {}).where("lang_pred = 'und'").count() == 7
    assert langid.predict(odd.limit(0), d).count() == 0


def test_language_equals_a_loop_and_rejects_what_was_not_learned(spark):
    import zstandard as z

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    d = langid.fit(docs)
    r = random.Random(4)
    strange = ["".join(r.choice(letters) for _ in range(n)) for letters in ("bcdfghjklmnpqrstvwxz ", "абвгдежзиклмнопрстуф ", "日本語中文字的是不了人 ") for n in (40, 200, 900, 4000)]
    got = {x.doc_id: x for x in langid.predict(table(spark, [(i, t, None) for i, t in enumerate(strange)]), d).collect()}
    assert all(x.rejected for x in got.values())

    def size(data, content):  # the plain library, a block at a time
        level = langid.SHORT_LEVEL if len(data) <= langid.SHORT else langid.LEVEL
        c = z.ZstdCompressor(level=level, dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(data[i : i + langid.BLOCK])) for i in range(0, len(data), langid.BLOCK))

    some = docs.where("doc_id % 7 = 0")
    text = {x.doc_id: x.text for x in some.collect()}
    for x in langid.predict(some, d).collect():
        if text[x.doc_id]:
            sizes = [size(text[x.doc_id].lower().encode(), c) for c in d.values()]
            assert abs(min(sizes) - sizes[list(d).index(x.lang_pred)]) <= 2 and abs(x.margin - (1 - min(sizes) / sorted(sizes)[1])) < 0.05


# --- top-k ---------------------------------------------------------------------------------------------------------------


def brute_top(vectors, ids, k):
    out = []
    for q in ids:
        best = {}
        for i, v in vectors:
            if i != q:
                s = int(np.dot(dict(vectors)[q], v))
                best[i] = max(best.get(i, s), s)
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


@pytest.mark.parametrize("kind", ["random", "equal", "few", "zero"])
def test_topk_is_exact(spark, kind):
    r = np.random.default_rng(3)
    n = 3 if kind == "few" else 400
    x = r.integers(-9, 9, (n, 6)) if kind != "zero" else np.zeros((n, 6), int)
    if kind == "equal":
        x[50:300] = x[0]
    vectors = [(int(i), [int(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in vectors], "vec_id long, v array<long>, score string").repartition(3)
    got = topk.search(df, df.where("vec_id % 50 = 0"), 5, cells=4, block_rows=64, query_rows=4).collect()
    assert sorted((a.query_id, a["rank"], a.vec_id, a.score) for a in got) == brute_top(vectors, range(0, n, 50), 5)


def test_topk_leaves_out_bad_vectors_and_takes_empty_tables(spark):
    bad = [(0, [0.5, 0.25]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (50, [-0.001, 1.0])]
    df = spark.createDataFrame(bad, "vec_id long, e array<float>").select("vec_id", topk.quantised(F.col("e")).alias("v"))
    assert {r.vec_id: r.v for r in df.where("v is not null").collect()} == {0: [128, 64], 50: [-1, 256]}
    assert [(r.query_id, r.vec_id, r.score) for r in topk.search(df, df.where("vec_id = 0")).collect()] == [(0, 50, -128 + 64 * 256)]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    assert topk.search(df.unionByName(df), df.where("vec_id = 0").unionByName(df.where("vec_id = 0"))).count() == 1


# --- near duplicates -----------------------------------------------------------------------------------------------------


def brute_classes(rows, width=5, threshold=0.8):
    bags = {}
    for i, t in rows:
        w = (t or "").lower().split()
        k = min(width, len(w))
        bags[i] = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else None
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(bags), 2):
        x, y = bags[a], bags[b]
        if x and y:
            both = sum((x & y).values())
            if both / (sum(x.values()) + sum(y.values()) - both) >= threshold:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in bags}


def near_rows():
    r = random.Random(5)
    rows, i = [], 0
    for g in range(6):
        base = prose(g, 120).split()
        for _ in range(8):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            rows.append((i, " ".join(w)))
            i += 1
    chain = prose(77, 200).split()
    for k in range(12):  # each like the next, the ends unlike: one group by its links
        rows.append((i, " ".join(chain[k * 6 : k * 6 + 120])))
        i += 1
    for t in [None, None, "", "  ", "short", "short", "two words", "Two Words", "a b c a b c a b c a b c", "a b c a b c a b c", "z " * 30_000, "z " * 29_000]:
        rows.append((i, t))
        i += 1
    return rows


@pytest.mark.parametrize("block_rows", [256, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block_rows)
    rows = near_rows()
    docs = table(spark, [(i, t, None) for i, t in [*rows, rows[0]]])
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    for wa, wb in ((1, 1), (3, 1), (5, 8)):
        agree, truth = [], []
        for _ in range(60):
            base = r.integers(0, 1 << 62, 200).astype(np.uint64)
            a, b = np.concatenate([np.repeat(base[:150], wa), base[150:180]]), np.concatenate([np.repeat(base[:150], wb), base[170:]])
            s = minhash.signatures([a, b], 125)
            agree.append((s[0] == s[1]).mean())
            truth.append(minhash.similarity(minhash.bag(a), minhash.bag(b)))
        assert abs(np.mean(agree) - np.mean(truth)) < 0.02


# --- lines ---------------------------------------------------------------------------------------------------------------


def test_line_dedup_keeps_one_of_each_group(spark):
    a, b = prose(11, 40), prose(12, 40)
    near = a[:-1] + "q"
    assert linededup.normalise("Ab,  12cd\t") == "ab 0cd"
    texts = [(1, f"{a}\nshort one\n{b}"), (2, f"{a.upper()}!\nshort one"), (3, near), (4, None), (5, ""), (6, f"{b}\n{b}"), (7, "x y z w v " * 4000), (7, "x y z w v " * 4000), (None, b)]
    docs = table(spark, [(i, t, None) for i, t in texts])
    for clash in ("ld_id", "ld_hash", "ld_drop", "ld_lines"):
        docs = docs.withColumn(clash, F.lit("own"))
    rows = linededup.dedup_lines(docs).collect()
    got = sorted(((r.doc_id, r.text, r.ld_lines, r.ld_removed) for r in rows), key=str)
    want = [(None, b, 1, 0), (1, f"{a}\nshort one", 3, 1), (2, "", 2, 2), (3, "", 1, 1), (4, None, 0, 0), (5, "", 1, 0), (6, "", 2, 2), *[(7, "x y z w v " * 4000, 1, 0)] * 2]
    assert got == sorted(want, key=str)
    assert all((r.ld_id, r.ld_hash, r.ld_drop) == ("own",) * 3 for r in rows)
    assert linededup.dedup_lines(table(spark, []).limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c", max_size=14), st.text(alphabet="ab c", max_size=14))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert linededup.edit_distance(a, b) == row[-1]


def test_fingerprints_equal_a_loop():
    texts = ["", "One two three four five 11 2234\n\nshort\n", "ONE, two; three four five: 3 44", "x " * 700 + "\na b c d e", "\n\n", "é à ü ö ñ", "a b c d f\n**\n  "]
    text, line, keys, prints, chars, other = linededup.fingerprints(texts)
    every = [(i, n, linededup.normalise(x)) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n"))]
    want = [w for w in every if w[2]]
    assert list(zip(text.tolist(), line.tolist())) == [w[:2] for w in want] and chars.tolist() == [len(w[2]) for w in want]
    assert list(zip(*map(np.ndarray.tolist, other))) == [w[:2] for w in every if not w[2]]
    assert [x[:2] for x in zip(*linededup.signs_only(texts, *other))] == [(6, 1)]
    by_key = {}
    for k, w in zip(map(tuple, keys.tolist()), want):
        assert by_key.setdefault(k, w[2]) == w[2]
    assert len(by_key) == len({w[2] for w in want})
    # a word alone has its own bits; a line has its words' majority, each weighing its bytes
    word = lambda w: np.unpackbits(linededup.fingerprints([w])[3].view(np.uint8)).astype(int)
    for p, (_, _, t) in zip(prints, want):
        weights = [min(len(w.encode()), linededup.HEAVIEST) for w in t.split()]
        bits = sum(word(w) * n for w, n in zip(t.split(), weights))
        assert (np.packbits(2 * bits > sum(weights)) == p.view(np.uint8)).all()


def test_long_words_are_cut_and_told_apart():
    long = "".join(chr(0x4E00 + random.Random(3).randrange(9000) + 7 * i) for i in range(80))
    prints = linededup.fingerprints([long, long[:50] + "x" + long[50:], long[::-1]])[3]
    apart = [int(np.bitwise_count(prints[0] ^ p).sum()) for p in prints]
    assert apart[0] == 0 and apart[1] <= linededup.APART < apart[2]
    pieces = linededup.fingerprints([long, " ".join(long)])[2]
    assert (pieces[0] != pieces[1]).any()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40), st.text(max_size=40))
def test_letters_bound_the_edit_distance(a, b):
    kinds = [np.frombuffer(linededup.letters(x), np.uint8)[None] for x in (a, b)]
    assert linededup.apart_at_least(*kinds)[0] <= linededup.edit_distance(a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "abc", "bca", "d"]), min_size=1, max_size=12), st.lists(st.sampled_from(["a", "bb", "abc", "bca", "d"]), min_size=1, max_size=12))
def test_edit_bound_is_a_bound(x, y):
    a, b = " ".join(x), " ".join(y)
    bound = linededup.edit_bound(x, y, 10**6)
    assert bound >= linededup.edit_distance(a, b) and (bound > 0 or a == b)
    if linededup.similar(a, b, 0.7):
        assert 1 - linededup.edit_distance(a, b) / max(len(a), len(b)) >= 0.7 - 1e-9


def test_many_pairs_of_lines_are_compared_as_single_ones(monkeypatch):
    r = np.random.default_rng(6)
    line = lambda n: "".join(r.choice(list("abc dß漢😀"), n))
    a = [line(int(n)) for n in r.integers(1, 900, 300)] + [line(157) for _ in range(40)]
    # edits all over a line, and at one of its ends as many as the threshold allows, one more and one less
    b = ["".join(c for c in x if r.random() > 0.09) or "a" for x in a[:150]] + [x + line(max(0, len(x) // 9 + i % 3 - 1)) for i, x in enumerate(a[150:300])] + [x + line(17) for x in a[300:]]
    want = np.array([linededup.edit_distance(x, y) for x, y in zip(a, b)])
    for most in (60, 64, 100):
        some = [i for i in range(len(a)) if abs(len(a[i]) - len(b[i])) <= most]
        got = linededup.edit_distances([a[i] for i in some], [b[i] for i in some], most)
        assert ((got == want[some]) | ((got > most) & (want[some] > most))).all()
    a, b, want = [*a, "", "ab"], [*b, "", ""], [*want, 0, 2]
    # what is compared at once is not compared alone
    alone = []
    monkeypatch.setattr(linededup, "similar", lambda x, y, t, f=linededup.similar: alone.append(x) or f(x, y, t))
    got = linededup.similar_pairs(a, b, 0.9)
    assert got.tolist() == [d <= int(0.1 * max(len(x), len(y)) + 1e-9) for x, y, d in zip(a, b, want)] and 0 < got.sum() < len(got)
    assert len(alone) < len(a)


@pytest.mark.parametrize("first_only", [True, False])
def test_near_rows_equal_a_loop(first_only):
    r = np.random.default_rng(5)
    bucket, n, copies = r.integers(0, 30, 300), r.integers(50, 90, 300), r.integers(1, 40, 300)
    order = np.sort(linededup.order_keys(bucket[:, None], n, copies, 0.9)[:, 0])
    prints = r.integers(0, 1 << 20, (300, 2)).astype(np.uint64)
    groups = None if first_only else r.integers(0, 40, 300)
    size = order & 65535
    length = (np.log(size) / -np.log(0.9)).astype(int)
    want = set()
    for k in range(10, 300):
        met = False
        for c in (0, 1):
            for i in range(k):
                if order[i] >> 27 == order[k] >> 27 and length[k] - length[i] == c and not (met and first_only):
                    apart = int(np.bitwise_count(prints[i] ^ prints[k]).sum())
                    if apart <= linededup.APART and min(size[i], size[k]) >= 0.9 * max(size[i], size[k]) and (groups is None or groups[i] != groups[k]):
                        want.add((i, k))
                        met = True
    got = [p for x in linededup.near_rows(order, prints, 10, 0.9, first_only, groups) for p in zip(*map(np.ndarray.tolist, x))]
    assert want and len(got) == len(set(got)) and set(got) == want


TEMPLATE = "the user {} opened the shared document named {} from the main menu of the old client at night"


def template_lines(n, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9)))
    return list(dict.fromkeys(TEMPLATE.format(word(), word()) for _ in range(n)))


@pytest.mark.parametrize("bucket", [linededup.BUCKET, 100])
def test_lines_of_one_template_are_all_linked(spark, monkeypatch, bucket):
    # many lines alike to some degree, few of them alike enough: near fingerprints must not stop the search
    monkeypatch.setattr(linededup, "BUCKET", bucket)
    monkeypatch.setattr(linededup, "PART", 64 if bucket == 100 else linededup.PART)
    lines = template_lines(700)
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 10])) for i in range(0, len(lines), 10)], "doc_id long, text string").repartition(4)
    near = lambda x, y: linededup.edit_distance(x, y, int(0.1 * max(len(x), len(y)) + 1e-9)) <= int(0.1 * max(len(x), len(y)) + 1e-9)
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [(i, k) for k in range(len(lines)) for i in range(k) if abs(len(lines[i]) - len(lines[k])) <= 9 and near(lines[i], lines[k])]
    for i, k in links:
        a, b = sorted((find(i), find(k)))
        root[b] = a
    want = sum(find(i) != i for i in range(len(lines)))
    removed = sum(r.ld_removed for r in linededup.dedup_lines(docs).collect())
    assert len(links) > want / 2 and 0.95 * want <= removed <= want


def brute_lines(lines, threshold=0.9):
    """All pairs of lines, shortest first, at edit similarity ``threshold`` or more."""
    n = np.array([len(x) for x in lines])
    letters = np.stack([np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) % 512, minlength=512) for x in lines]).astype(np.int16)
    for i in range(len(lines)):
        to = np.searchsorted(n, n[i] / threshold + 1e-9, "right")
        more = letters[i + 1 : to] - letters[i]
        bound = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
        for k in (np.flatnonzero(bound <= (1 - threshold) * n[i + 1 : to] + 1e-9) + i + 1).tolist():
            most = (1 - threshold) * len(lines[k]) + 1e-9
            if linededup.edit_distance(lines[i], lines[k], int(most)) <= most:
                yield i, k


def test_line_dedup_recall_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), "text")
    texts = {r.doc: (r.text or "").split("\n") for r in rows.collect()}
    named = linededup.line_groups(rows)[1].collect()
    group = {linededup.normalise(texts[r["first"]["doc"]][r["first"]["line"]]): r["group"] for r in named}
    lines = sorted({x for t in texts.values() for x in map(linededup.normalise, t)} - {""}, key=lambda x: (len(x), x))
    lines = [x for x in lines if len(x) >= 10]
    pairs = list(brute_lines(lines))
    found = [group.get(lines[i], i) == group.get(lines[k], -k) for i, k in pairs]
    assert len(pairs) > 250 and np.mean(found) >= 0.9
    # groups hold together by similar pairs alone
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, k in pairs:
        root[find(i)] = find(k)
    together = {}
    for i, x in enumerate(lines):
        if x in group:
            assert together.setdefault(group[x], find(i)) == find(i)


def planted(words, kind, seed=0):
    """A line of ``words`` words and an edited copy at edit similarity 0.9 or more: one word changed, one in twelve, or 5 % of its signs."""
    r = random.Random(f"{words} {kind} {seed}")
    while True:
        a = ["".join(r.choice("etaoinshrdlucmfwyp") for _ in range(r.randint(3, 8))) for _ in range(words)]
        b = list(a)
        for _ in range({"word": 1, "words": max(1, words // 12)}.get(kind, 0)):
            b[r.randrange(words)] = "".join(r.choice("etaoinshrdlucmfwyp") for _ in range(5))
        a, b = " ".join(a), " ".join(b)
        if kind == "signs":
            b = "".join(r.choice("etaoins") if c != " " and r.random() < 0.05 else c for c in a)
        if a != b and 1 - linededup.edit_distance(a, b) / max(len(a), len(b)) >= 0.9:
            return a, b


def test_line_dedup_takes_short_lines_and_lines_without_spaces(spark):
    long = "".join(chr(0x4E00 + random.Random(7).randrange(3000) + i) for i in range(60))
    texts = [f"Subscribe now\n{long}\n***\n\n}}", f"subscribe, now!\n\n***\n{long}\n---\n }}", f"{long[:-1]}x\nsubscribe later\n*** \n \n"]
    got = {r.doc_id: (r.text, r.ld_removed) for r in linededup.dedup_lines(table(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert got == {0: (texts[0], 0), 1: ("\n---", 4), 2: ("subscribe later\n \n", 2)}


def test_short_lines_are_all_found(spark):
    # a line of 9 characters and one of 10; words that one edit makes wholly different; edits all over a line of up to 68 characters
    r, texts = random.Random(5), ["abcdefghi", "abcdefghij", "internationalisation", "internationalizations"]
    some = lambda n: "".join(r.choice("etaoinshrdlu ") for _ in range(n))
    for n in [*range(9, 63)] * 3:
        a = linededup.normalise("x" + some(n - 2) + "y")
        edited = list(a)
        for _ in range(max(1, int(0.1 * len(a)))):
            i, change = r.randrange(1, len(edited) - 1), r.randrange(3)
            edited[i : i + (change > 0)] = [] if change == 2 else [r.choice("etaoinshrdlu")]
        texts += [a, linededup.normalise("".join(edited))]
    lines = sorted(set(texts), key=lambda x: (len(x), x))
    pairs = list(brute_lines([x for x in lines if len(x) >= 9]))
    assert len(pairs) > 100
    rows = table(spark, [(i, t, None) for i, t in enumerate(texts)]).select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), "text")
    group = {texts[x["first"]["doc"]]: x["group"] for x in linededup.line_groups(rows)[1].collect()}
    names = [x for x in lines if len(x) >= 9]
    assert [(names[i], names[k]) for i, k in pairs if names[i] not in group or group[names[i]] != group.get(names[k])] == []
    # of a pair the longer line has the least length
    group = {texts[x["first"]["doc"]]: x["group"] for x in linededup.line_groups(rows, min_chars=21)[1].collect()}
    assert group["internationalisation"] == group["internationalizations"] and "abcdefghij" not in group


@pytest.mark.parametrize("threshold", [0.8, 0.9, 0.95])
def test_similar_lines_share_a_segment(threshold):
    classes, r = linededup.short_classes(threshold), random.Random(11)
    assert all(b[0] == a[1] + 1 for a, b in zip(classes, classes[1:]) if threshold == 0.9) and max(c[2] for c in classes) == linededup.EDITS
    seen = 0
    for _ in range(1500):
        n = r.choice([x for c in classes for x in range(c[0], c[1] + 1)])
        a = "".join(r.choice("abcdefgh") for _ in range(n))
        b = list(a)
        for _ in range(r.randint(1, linededup.EDITS)):
            i, change = r.randrange(len(b)), r.randrange(3)
            b[i : i + (change > 0)] = [] if change == 2 else [r.choice("abcdefgh")]
        x, y = sorted((a, "".join(b)), key=len)
        most = int((1 - threshold) * len(y) + 1e-9)
        if len(x) != n or linededup.edit_distance(x, y) > most:
            continue
        seen += 1
        at, key, own = linededup.segments([x, y], classes, threshold)
        assert set(key[(at == 0) & own].tolist()) & set(key[(at == 1) & ~own].tolist())
        u, v = linededup._steps(np.stack([np.frombuffer(linededup.letters(z), np.uint8) for z in (x, y)])).view(np.uint64)
        assert max(np.bitwise_count(u & ~v).sum(), np.bitwise_count(v & ~u).sum()) <= most
    assert seen > 100


def test_line_dedup_finds_planted_edits(spark):
    pairs = [planted(n, kind, k) for n in (20, 30, 50, 100) for kind in ("word", "words") for k in range(40)]
    rows = [(2 * i + j, t, None) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    got = {r.doc_id: r.ld_removed for r in linededup.dedup_lines(table(spark, rows)).collect()}
    assert not any(got[2 * i] for i in range(len(pairs)))
    assert np.mean([got[2 * i + 1] for i in range(len(pairs))]) >= 0.9


# --- quality -------------------------------------------------------------------------------------------------------------


def brute_kneser_ney(texts):
    """Modified Kneser-Ney of order ORDER in plain Python: symbol and history to probability."""
    order = quality.ORDER
    alphabet = {c for t in texts for c in t}
    start, other = "\0s", "\0o"
    top = Counter()
    for t in texts:
        s = [start] * (order - 1) + list(t)
        top.update(tuple(s[i : i + order]) for i in range(len(t)))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    total, n = sum(counts[1].values()), len(alphabet) + 1
    discounts, contexts = {}, {}
    for k in range(2, order + 1):
        of = Counter(counts[k].values())
        if of[1] and of[2]:
            y = of[1] / (of[1] + 2 * of[2])
            discounts[k] = [min(max(i - (i + 1) * y * of[i + 1] / of[i] if of[i] else 0.5 * i, 0.05), 0.95 * i) for i in (1, 2, 3)]
        else:
            discounts[k] = [0.5, 0.75, 0.9]
        for g, c in counts[k].items():
            x = contexts.setdefault(g[:-1], [0, 0.0])
            x[0] += c
            x[1] += discounts[k][min(c, 3) - 1]

    def p(gram):
        if len(gram) == 1:
            return (counts[1][gram] + 0.5) / (total + 0.5 * n)
        below = p(gram[1:])
        if gram[:-1] not in contexts:
            return below
        c, (all_, off) = counts[len(gram)][gram], contexts[gram[:-1]]
        return (max(c - discounts[len(gram)][min(c, 3) - 1], 0) if c else 0) / all_ + off / all_ * below

    def log10(text):
        s = [start] * (order - 1) + [c if c in alphabet else other for c in text]
        return sum(np.log10(p(tuple(s[i : i + order]))) for i in range(len(text)))

    return p, log10, [*alphabet, other]


def test_quality_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "CHUNK_CHARS", 300)
    trusted = [prose(k, 30) for k in range(6)] + ["日本語の文章です" * 5, "éàü " * 9, "", "a"]
    sample = spark.createDataFrame([(t,) for t in trusted], "text string").repartition(3)
    model = quality.fit(sample)
    p, log10, alphabet = brute_kneser_ney(trusted)
    for history in (("a", "l", "p"), ("\0s", "\0s", "\0s"), ("語", "の", "文"), ("q", "q", "q")):
        assert np.isclose(sum(p((*history, c)) for c in alphabet), 1)
    texts = [prose(3, 10), prose(40, 25), "日本文", "完全に違う", "a" * 3000, "x", "", None, "beta1 beta1", "beta1 beta1"]
    rows = quality.perplexities(table(spark, [(i // 2, t, "en") for i, t in enumerate(texts)]), model).collect()
    got = sorted((r.doc_id, r.n_symbols, round(r.log10_p, 6)) for r in rows)
    assert got == sorted((i // 2, len(t or ""), round(float(log10(t or "")), 6) + 0.0) for i, t in enumerate(texts))


def test_quality_separates(spark):
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet").collect()
    kept = {r.doc_id: r.kept for r in queries.op5_quality_classifier(spark, at).collect()}
    assert np.mean([kept[r.doc_id] for r in labels if r.quality == 1 and not r.toxic]) > 0.98
    assert np.mean([kept[r.doc_id] for r in labels if r.quality == 0]) < 0.3


def test_quality_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, [(1, "the cat sat on the mat " * 20, "en"), (2, "the dog sat on the log " * 20, None), (3, "$$$$####" * 40, "en"), (4, None, "en"), (5, "", None), (6, "the cat sat", "xx"), (6, "the cat sat", "xx"), (7, "日本" * 5000, "en")])
    got = sorted((r.doc_id, r.kn_kept, r.n_symbols) for r in quality.classify(docs, labels).collect())
    assert [g[:2] for g in got] == [(1, True), (2, True), (3, False), (4, False), (5, False), (6, True), (6, True), (7, False)]
    assert got[3][2] == got[4][2] == 0 and got[-1][2] == 10_000
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.doc_id: r.kn_kept for r in quality.classify(docs, labels.limit(0)).collect()}[3]


# --- WARC ----------------------------------------------------------------------------------------------------------------


def test_warc_salvages_after_damage(spark, tmp_path):
    import gzip

    def record(n, payload):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:%d>\r\nWARC-Page-ID: %d\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, n, hashlib.sha1(payload).hexdigest().encode(), len(block), block)

    records = [record(i, b"payload %d " % i * 50) for i in range(8)]
    plain = bytearray(b"".join(records))
    second, fifth = len(records[0]), sum(map(len, records[:4]))
    plain[second + 300] ^= 1  # a flipped bit in record 1
    del plain[fifth + 20 : fifth + 60]  # record 4 loses its headers
    members = [gzip.compress(r) for r in records]
    bad = bytearray(members[3])
    bad[len(bad) // 2] ^= 255
    zipped = b"".join(members[:3]) + bytes(bad) + b"junk" + b"".join(members[4:7]) + members[7][:-5]
    for name, data, lost in (("plain", bytes(plain), {1, 4}), ("zipped", zipped, {3, 7}), ("empty", b"", set(range(8))), ("noise", b"noise WARC/1.1\r\n", set(range(8)))):
        rows = list(warc.salvage(data))
        assert {int(h["warc-page-id"]) for _, _, reason, h, _ in rows if not reason} == set(range(8)) - lost
        at = 0
        for start, end in sorted({(a, b) for a, b, *_ in rows}):  # records and gaps tile the file
            assert start == at
            at = end
        assert at == len(data)
        (tmp_path / name).write_bytes(data)
    got = warc.read(spark, str(tmp_path)).collect()
    assert Counter(r.kind for r in got) == {"response": 12, "gap": 5}
    assert all(r.reason and r.gap_end > r.at for r in got if r.kind == "gap")


def test_warc_round_trip(spark):
    long = "é" * 700
    pages = [(1, "http://a", long), (2, "b\r\nX: y", long), (3, None, "tiny"), (4, "d", "tiny"), (5, "e", None), (6, "f", ""), (7, "g", "\r\n\r\nWARC/1.1\r\n" * 200), (8, "h", "x" * 300_000), (9, "i", long), (None, "z", "q")]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, digest string, size int").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(df, per_file=2).collect()}
    assert sorted(got) == list(range(1, 10))
    for i, _, html in pages[:-1]:
        data = (html or "").encode()
        revisit = i in (1, 2)
        assert got[i].kind == ("revisit" if revisit else "response") and got[i].refers_to == (9 if revisit else None)
        assert got[i].payload_length == len(data) and got[i].digest == hashlib.sha1(data).hexdigest() and got[i].payload == (None if revisit else data)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_repeated_ids_and_many_revisits_equal_a_loop(spark):
    r = random.Random(8)
    texts = ["%d " % k * 600 for k in range(6)] + ["small", "", None]
    pages = [(r.randrange(40), f"u{i}", r.choice(texts)) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    largest = {}
    for i, _, t in pages:
        largest[t] = max(largest.get(t, i), i)
    want = []
    for i, u, t in pages:
        data = (t or "").encode()
        again = len(data) >= 1000 and i < largest[t]
        want.append((i, u, "revisit" if again else "response", largest[t] if again else None, len(data), hashlib.sha1(data).hexdigest()))
    rows = warc.resolve(warc.round_trip(df, per_file=7)).collect()
    assert sorted(map(str, want)) == sorted(str((x.page_id, x.url, x.kind, x.refers_to, x.payload_length, x.digest)) for x in rows)


def test_warc_loses_one_record_to_a_flipped_byte(spark, tmp_path):
    pages = [(i, f"u{i}", f"page {i} " * (50 + 40 * i)) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "a"))
    files = [p for p in (tmp_path / "a").iterdir() if p.name.startswith("part")]
    assert len(files) == 1
    data = files[0].read_bytes()
    for k in (4, 2, 1):
        bad = bytearray(data)
        bad[len(data) // k - 40] ^= 255
        (tmp_path / "b").write_bytes(bad)
        rows = warc.read(spark, str(tmp_path / "b")).collect()
        assert Counter(r.kind for r in rows) == {"response": 59, "gap": 1}
    # archives end by bytes too, and a long record stands alone; ordinary tools read them
    warc.write(df.withColumn("html", F.repeat("html", F.lit(20))), str(tmp_path / "c"), file_bytes=200_000)
    import gzip

    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "c").iterdir() if p.name.startswith("part")]
    assert len(sizes) > 5 and max(sizes) < 600_000 and warc.read(spark, str(tmp_path / "c")).count() == 60


def test_members_end_in_a_zero_byte():
    import gzip
    import zlib

    for size in (10, 1 << 24, (1 << 24) + 5, 3 << 24):
        data = warc.members([b"x" * size, b"y"]) if size < 1 << 20 else warc.members([b"x" * size])
        assert gzip.decompress(data + b"\0")[:size] == b"x" * size
        z = zlib.decompressobj(31)
        assert len(z.decompress(data + b"\0")) == size


def test_warc_recovers_the_records_before_damage_in_a_member(tmp_path):
    import gzip

    def record(n):
        payload = random.Random(n).randbytes(1000)
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, hashlib.sha1(payload).hexdigest().encode(), len(block), block)

    body = b"".join(map(record, range(30)))
    data = bytearray(gzip.compress(body))
    data[len(data) // 2] ^= 255
    rows = list(warc.salvage(bytes(data) + gzip.compress(record(40))))
    got = [h["warc-record-id"] for *_, reason, h, _ in rows if not reason]
    assert 10 <= len(got) - 1 < 20 and got == [*(f"<urn:x:{n}>" for n in range(len(got) - 1)), "<urn:x:40>"]
    assert sum(bool(reason) for *_, reason, _, _ in rows) >= 1


# --- scores --------------------------------------------------------------------------------------------------------------


def test_lattice_forward_sums_all_segmentations(spark):
    pieces = [b" ", b"a", b"b", b" a", b"ab", b"aba", b"ba"]
    p = np.array([0.2, 0.1, 0.15, 0.2, 0.1, 0.05, 0.2])
    net = lattice.Lattice(pieces, np.log(p))
    value = dict(zip(pieces, p))

    def total(s):
        return 1.0 if not s else sum(value[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in value)

    words = [b"a", b"ab", b"abab", b"bba", b"aba" * 4]
    assert np.allclose(np.exp(net.log_probs(words)), [total(b" " + w) for w in words])


def test_lattice_scores_equal_brute_force(spark, monkeypatch):
    import math

    monkeypatch.setattr(lattice, "FREQUENT", 6)  # most words by the join
    rows = [(0, "The cat THE dog", None), (1, None, None), (2, "", None), (3, "the cat É é", None), (4, "cat " * 3000, None), (4, "cat " * 3000, None), (5, "zzz" * 2000, None), (6, "dog", None)]
    docs = table(spark, rows)
    model = queries.model_path("piece_bpe_32k.model")
    got = lattice.score(docs, model, F.col("doc_id") < 5).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t, _ in rows}
    c = Counter(w for i, _, _ in rows if i < 5 for w in tokens[i])
    n, v = sum(c.values()), len(c)
    net = lattice.existing_vocabulary(model)
    u = (sum(x == 1 for w, x in c.items() if w) + 1) / (n + 1)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        want = 0.0
        for w in t:
            lat = net.log_probs([w])[0] if w else -math.inf
            p = (1 - u) * c[w] / n + u * math.exp(lat)
            want += math.log10(p) if p > 0 else (lat + math.log(u)) / math.log(10)
        assert math.isclose(r.score, want, rel_tol=1e-6)
    assert lattice.score(docs.limit(0), model, F.col("doc_id") < 5).count() == 0


# --- queries with SQL ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{at}/{t}.parquet')")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, at)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, ([r[c] for c in want.columns] for r in got.collect()))) == sorted(map(str, map(list, want.fetchall())))


def test_quality_learns_from_every_trusted_document(spark):
    docs = spark.range(50_400).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    assert quality.trusted(docs, labels).count() == 50_400
