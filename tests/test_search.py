"""Terms in texts, source search and stack lines: against plain Python, at many terms, and on odd rows."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.operators import frames, logs, rules, search
from faultline.operators.terms import contained_terms


@pytest.mark.parametrize("shard", [3, 1000])
def test_terms_equal_contains(spark, shard):
    r = random.Random(2)
    terms = sorted({"".join(r.choice("abé ") for _ in range(r.randrange(1, 5))) for _ in range(60)} | {"", "\n"})
    texts = [(i % 40, "".join(r.choice("abé \n") for _ in range(r.randrange(30)))) for i in range(80)] + [(50, None), (51, ""), (52, "ab" * 20_000)]
    want = sorted((i, t) for i, x in texts if x is not None for t in terms if t in x)
    got = contained_terms(spark.createDataFrame(texts, "log_id int, text string"), spark.createDataFrame([(t,) for t in [*terms, None, terms[3]]], "term string"), "log_id", shard_terms=shard, pack_chars=500)
    assert sorted(map(tuple, got.collect())) == want


def test_a_hundred_thousand_keywords(spark):
    modes = spark.range(100_001).selectExpr("concat('m', id % 3) as mode", "'s' as sub", "concat('key', id, '.') as keyword")
    texts = spark.createDataFrame([(1, "KEY7. key70. key99999."), (2, "none"), (3, None), (4, "key100000.")], "log_id int, text string")
    got = {(x.log_id, x.mode, x.hits) for x in rules.keyword_fault_modes(texts, modes).collect()}
    assert got == {(1, "m1", 2), (1, "m0", 1), (4, "m1", 1)}


PATTERNS = {"plain": "token", "rare": "zz q (token|def) zz", "either": "(alpha|beta)gamma", "run": r"ab+c\s*=\s*xyz", "class": "[xyz]oo bar", "short": "q", "maybe": "(?:abc)?def", "case": "(?i)TOKEN", "any": ".*", "anchor": "^start of", "java": r"\p{Lu}end"}


def test_search_equals_a_scan(spark):
    r = random.Random(8)
    words = ["token", "alphagamma", "betagamma", "abbbc = xyz", "xoo bar", "q", "def", "abcdef", "TOKEN", "start of", "Éend", "zz", ""]
    files = [(f"f{i:03d}", "\n".join(" ".join(r.choice(words) for _ in range(3)) for _ in range(8))) for i in range(60)] + [("none", None), ("empty", ""), ("crlf", "a\r\ntoken\r\n")]
    files += [("hot", "token\n" * 300)]
    df = spark.createDataFrame(files, "file string, text string")
    index = search.trigram_index(df).cache()
    got = search.search_source(df, PATTERNS, limit=40, index=index).collect()
    for name, pattern in PATTERNS.items():
        own = re.compile(pattern.replace(r"\p{Lu}", "[A-ZÉ]"))
        hits = sorted((f, k, line) for f, text in files if text is not None for k, line in enumerate(re.split(r"\r?\n", text), 1) if own.search(line))
        assert sorted((x.file, x.line, x.text) for x in got if x.pattern_id == name) == hits[:40], name
        assert {x.truncated for x in got if x.pattern_id == name} <= {len(hits) >= 40}
    read = {x.pattern_id: x.files_read for x in search.files_read(df, index, PATTERNS).collect()}
    assert read.get("rare", 0) < 30 and read["any"] == len(files)
    index.unpersist()


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["abc", "a(bc|de)f", "(ab)+c", "ab?cde", "[ab]cd", "a{2}bcd", "a(b|)cde", "ab.de", "(?:abc|d)e", "abc$", r"a\db", "x|abcd", "(a|b)(c|d)(e|f)"]), st.text(alphabet="abcdef1x", max_size=9))
def test_trigrams_are_in_every_match(pattern, text):
    if re.search(pattern, text):
        grams = {text[i : i + 3] for i in range(len(text) - 2)}
        assert any(s <= grams for s in search.required_trigrams(pattern))


def test_definitions_and_references(spark):
    df = spark.createDataFrame([("a.cc", "int draw(int x) {\n  redraw(1);\n  draw;\n}"), ("b.cc", "void f() { draw(2); }")], "file string, text string")
    assert [(x.file, x.line) for x in search.search_source(df, search.definition_patterns(["draw"])).orderBy("file", "line").collect()] == [("a.cc", 1), ("b.cc", 1)]
    assert [(x.file, x.line) for x in search.search_source(df, search.reference_patterns(["draw"])).orderBy("file", "line").collect()] == [("a.cc", 1), ("a.cc", 3), ("b.cc", 1)]


LINES = [
    ("#00 pc 000000000001a2b4  /system/lib64/libc.so (abort+164) (BuildId: ab12cd34)", ("libc.so", "abort", 164, "ab12cd34")),
    ("#00 pc 00000000004926b4 /data/app/x/lib/arm64/libmap_v7_6_6.so[f0040528c6875de8345d6e3dc7109cc1af4ee389]", ("libmap_v7_6_6.so", None, None, "f0040528c6875de8345d6e3dc7109cc1af4ee389")),
    ("#00 pc 000000000073bcdc /data/app/lib/arm64/libcore.so [arm64-v8a::1cf7a8708f9a04a37f85cdffa7983068]", ("libcore.so", None, None, "1cf7a8708f9a04a37f85cdffa7983068")),
    ("#01 pc 00000000000012ab  [anon:dalvik-DEX data] (com.app.Main.run+16)", ("[anon:dalvik-DEX data]", "com.app.Main.run", 16, None)),
    ("native: #02 pc 0abc /x/base.apk!libq.so (offset 0x1000) (std::vector<int, std::allocator<int> >::at(unsigned long)+8)", ("libq.so", "std::vector<int, std::allocator<int> >::at(unsigned long)", 8, None)),
    ("#03 pc 0abc /memfd:jit-cache (deleted) (deleted)", ("memfd:jit-cache", None, None, None)),
    ("0   App   0x0000000100abc123 0x100000000 + 43981", ("App", None, 43981, None)),
    ("1 1 App 0x100abc E7A5C3D0-1111-2222-3333-444455556666 + 77", ("App", None, 77, None)),
    ("2   libdispatch.dylib  0x18afca000 + 9072", ("libdispatch.dylib", None, 9072, None)),
    ("3   CoreFoundation   +[NSException raise:] + 12", ("CoreFoundation", "+[NSException raise:]", 12, None)),
    ("#0 at f (a.js:1:2)", ("a.js", "f", None, None)),
    ("at f (file.js:10:5)", ("file.js", "f", None, None)),
    ("    at (pages/Index.ets:3:4)", ("Index.ets", None, None, None)),
    ("  at com.app.Main.run(Main.java:42)", (None, "com.app.Main.run", None, None)),
    ("  at com.app.Main.go(Native Method)", (None, "com.app.Main.go", None, None)),
    ("map_plugin  0x10ae3b7c8  walk_navi::CRoute::GetLegSize", ("map_plugin", "walk_navi::CRoute::GetLegSize", None, None)),
    ("demo.exe!CrashDemo::run+0x2a", ("demo.exe", "CrashDemo::run", 42, None)),
    ("    #4 0x55d5 (/usr/bin/app+0xff) (BuildId: aa11bb22)", ("app", None, 255, "aa11bb22")),
    ("    #5 0x55d5 in main /src/a.cc:10:3", (None, "main", None, None)),
    ("#6 0x7fff2041 12 libsystem_c.dylib 0x7fff2041 abort + 120", ("libsystem_c.dylib", "abort", 120, None)),
]


def test_every_form_of_stack_lines(spark):
    other = ["13 total frames", "hello world", "0123456789abcdef 0011 2233 + 4", "", "x0 0000000000000000 x1 0000000000000001", None]
    rows = [(1, i, t) for i, (t, _) in enumerate(LINES)] + [(2, i, t) for i, t in enumerate(other)]
    got = {x.line_no: (x.library, x.function, x.offset, x.build_id) for x in logs.parse_frames(spark.createDataFrame(rows, "log_id int, line_no int, text string")).collect() if x.log_id == 1}
    for i, (text, want) in enumerate(LINES):
        assert got.get(i) == want, text
    assert logs.parse_frames(spark.createDataFrame(rows, "log_id int, line_no int, text string")).where("log_id = 2").count() == 0


def test_stacks_carry_their_type(spark):
    text = "READ of size 4\n#0 0x1 in a /x.c:1\nfreed by thread T0\n#0 0x2 in b /x.c:2\npreviously allocated by\n#0 0x3 in c /x.c:3\ndeallocated by thread 7\n#0 0x4 in d /x.c:4"
    got = frames.crash_frames(logs.explode_lines(spark.createDataFrame([(1, text), (2, "#0 0x9 in z /x.c:1")], "log_id int, content string"))).collect()
    assert {(x.log_id, x.function, x.stack_type, x.pos) for x in got} == {(1, "a", "read", 0), (1, "b", "freed", 1), (1, "c", "allocated", 2), (2, "z", "read", 0)}


def test_memory_subtypes(spark):
    texts = ["", "x OutOfMemoryError jetsam", "Jetsam", "jetsams", "EXC_RESOURCE x MEMORY", "ENOMEM", "onTrimMemory PSS: 1.5 MB Threads: 7", "didReceiveMemoryWarning", "Dalvik Heap 20 KB FDs=12", "low_memory"]
    facts = spark.createDataFrame([(0, "oom_kill", None), (1, "mixed_oom_crash", None), (3, None, "OOM"), (8, "memory_pressure", None)], "log_id int, log_kind string, category string")
    ind = logs.memory_indicators(spark.createDataFrame(list(enumerate(texts)), "log_id int, content string"))
    got = {x.log_id: x for x in logs.memory_subtype(ind, facts).collect()}
    assert [got[i].memory_subtype for i in range(10)] == ["oom_kill", "mixed_oom_with_crash", "system_oom_kill", "oom_category", "system_oom_kill", "native_alloc_failure", "memory_pressure", "memory_pressure", "memory_pressure", "memory_pressure"]
    assert (got[6].pss, got[6].pss_unit, got[6].pss_bytes, got[6].thread_count) == (1.5, "M", 1572864, 7) and (got[8].java_heap_bytes, got[8].fd_count) == (20480, 12)
    assert logs.memory_subtype(ind).where("log_id = 0").first().memory_subtype == "memory_related"


def test_hash_embedding_equals_counts(spark):
    import numpy as np
    import xxhash

    from faultline.operators import retrieval

    texts = ["Alpha beta alpha", "", None, "...", "é été " * 4000, "beta Alpha alpha"]
    rows = retrieval.hash_embed(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", 32).orderBy("i").collect()
    for x, t in zip(rows, texts):
        want = np.zeros(32)
        for w in re.split(r"[^a-zA-Z0-9_]+", (t or "").lower()):
            if w:
                h = xxhash.xxh64_intdigest(w.encode(), seed=42)
                want[(h - (1 << 64) if h >> 63 else h) % 32] += 1
        assert np.allclose(x.embedding, want / (np.linalg.norm(want) or 1), atol=1e-6)
    assert rows[0].embedding == rows[5].embedding


def test_suites_and_traces(spark, tmp_path):
    import json

    from faultline.sources import readers

    (tmp_path / "m.json").write_text(json.dumps({"cases": [{"id": "a", "expected": 1}, {"id": "b", "expected": 2}]}))
    (tmp_path / "reports" / "a").mkdir(parents=True)
    (tmp_path / "reports" / "a" / "00_run_summary.json").write_text(json.dumps({"status": "done"}))
    got = {x.case_id: x for x in readers.read_suite(spark, str(tmp_path / "m.json"), str(tmp_path / "reports")).collect()}
    assert (got["a"].status, got["a"].summary.status, got["b"].status) == ("ok", "done", "missing_report")
    spark.createDataFrame([(1, 5)], "callchain_id long, heap_size long").write.parquet(str(tmp_path / "native_hook.parquet"))
    hook = readers.read_trace(spark, str(tmp_path), ("native_hook",))["native_hook"].first()
    assert (hook.ipid, hook.itid, hook.end_ts, hook.heap_size) == (0, 0, None, 5)


def test_frames_in_unknown_json(spark):
    from faultline.sources import jsonframes

    f = '{"func": "a", "path": "/x/liba.so", "line_number": "7"}'
    texts = ["no json", "{}", "[]", "5", "[1, 2]", f"[{f}]", f'[{f}, {{"id": 1}}]', f'{{"b": {{"k": [{f}]}}, "a": {{"k": [{f}, 3, {f}]}}}}', '{"x": ' * 8 + f"[{f}]" + "}" * 8, '{"x": ' * 9 + f"[{f}]" + "}" * 9, None, '{"a": [{"function": null}]}']
    got = [(x.log_id, x.depth, x.path, x.pos, x.function, x.library, x.line) for x in jsonframes.json_frames(spark.createDataFrame(list(enumerate(texts)), "log_id int, content string")).collect()]
    assert sorted(got, key=lambda g: (g[0], g[3])) == [(5, 0, "", 0, "a", "liba.so", 7), (7, 2, "/a/k", 0, "a", "liba.so", 7), (7, 2, "/a/k", 1, "a", "liba.so", 7), (8, 8, "/x" * 8, 0, "a", "liba.so", 7), (11, 1, "/a", 0, None, None, None)]
    assert {g[0] for g in got} == {5, 7, 8, 11}


def test_a_single_search_looks_up_only_what_is_asked(spark):
    df = spark.createDataFrame([("a", "token here\r\nno"), ("b", "to\nken"), ("c", None), ("d", "x token y")], "file string, text string")
    got = {(x.gram, x.file) for x in search.asked_trigrams(df, {"t": "token", "any": "."}).collect()}
    assert got == {(g, f) for g in ("tok", "oke", "ken") for f in ("a", "d")} | {("ken", "b")}
    found = search.search_source(df, {"t": "token", "any": "."})
    assert sorted(x.file for x in found.where("pattern_id = 't'").collect()) == ["a", "d"]
    assert search.asked_trigrams(df, {"any": "."}).count() == 0


def test_json_lists_stay_in_their_row(spark, monkeypatch, capsys):
    from faultline.sources import jsonframes

    write = jsonframes.materialize

    def shown(df, label):
        df.explain()
        return write(df, label)

    monkeypatch.setattr(jsonframes, "materialize", shown)
    texts = ['[1, {"func": null, "name": " f "}, {"FUNC": 1}, {"line": "7", "func": ""}]', '{"b": [{"file": "x"}], "a": {"c": 1}}', '{"a": [[], [{"pc": 1}], [{"pc": 2, "image": {"k": 1}}, 5]]}', "[]", "3", "{", None]
    got = jsonframes.json_frames(spark.createDataFrame(list(enumerate(texts)), "log_id int, content string")).collect()
    assert sorted((r.log_id, r.depth, r.path, r.pos, r.function, r.file, r.module, r.line, r.address) for r in got) == [(0, 0, "", 0, "f", None, None, None, None), (0, 0, "", 1, None, None, None, None, None), (0, 0, "", 2, None, None, None, 7, None), (1, 1, "/b", 0, None, "x", None, None, None), (2, 2, "/a/2", 0, None, None, '{"k":1}', None, "2")]
    assert "Exchange" not in capsys.readouterr().out
