"""The pipeline's stages on the smallest tables: decisions take effect, columns stay, and the last stage packs all that is left."""

import math
import random
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from faultline.llm import langid, linededup, minhash, quality
from faultline.llm.queries import model_path
from test_operators import brute_classes, brute_kneser_ney, brute_lines

AT = "/root/testdata/sf0.001"


def test_stages_apply_their_decisions(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    labels = spark.read.parquet(f"{AT}/labels.parquet")
    left = {r.doc_id: r for r in docs.collect()}
    now = docs
    for (name, stage), judge in zip(corpus_pipeline.STAGES, ("quality", "language", "lines", "near", "pack"), strict=True):
        out = stage(spark, now, AT)
        if judge == "pack":
            rows = out.collect()
            by_doc, by_seq = {}, {}
            for r in rows:
                by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
                by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert set(by_doc) == set(left)
            for parts in by_doc.values():
                assert sum(p[1] for p in parts) == parts[0][2] and sorted(p[0] for p in parts)[0] == 0
            assert all(sorted(p)[0][0] == 0 and sum(n for _, n in p) in (2048, sum(n for _, n in by_seq[max(by_seq)])) for p in by_seq.values())
            assert sum(r.length for r in rows) > 0
            break
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        rows = {r.doc_id: r for r in out.collect()}
        before = now.collect()
        if judge == "quality":
            keep = {r.doc_id for r in quality.classify(now, labels).collect() if r.kn_kept}
        elif judge == "language":
            keep = {r.doc_id for r in langid.label(now, langid.fit(now)).collect() if not r.rejected}
            assert np.mean([rows[r.doc_id].lang == r.lang for r in before if r.doc_id in rows]) > 0.97
        elif judge == "lines":
            made = {r.doc_id: r for r in linededup.dedup_lines(now).collect()}
            keep = {k for k, r in made.items() if not r.ld_removed or r.text.strip()}
            assert all(rows[k].text == made[k].text and rows[k].n_chars == len(made[k].text) for k in rows)
        else:
            keep = {r.class_id for r in minhash.near_duplicates(now).collect()}
        assert set(rows) == keep
        if judge != "lines":
            assert all(rows[r.doc_id].text == r.text for r in before if r.doc_id in rows)
        left, now = rows, spark.createDataFrame(list(rows.values()), docs.schema)


def test_stages_take_odd_rows(spark):
    schema = spark.read.parquet(f"{AT}/documents.parquet").schema
    prose = "Then the other thing that was there and the one with her hand on it. " * 9
    rows = [(1, prose, "en", "s", 1), (1, prose, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, prose * 300, None, "s", 1), (None, prose, "en", None, 1)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, AT)
        want = {"quality classifier": [1, 1, 4, None], "language identification": [1, 1, 4, None], "line deduplication": [None, 2, 3, 4], "near-duplicate removal": [1, 1, 2, 3, 4, None], "packing": None}[name]
        if want:
            assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(want, key=str), name
        else:
            rows_ = out.collect()
            assert {r.doc_id for r in rows_} == {1, 2, 3, 4, None} and sum(r.length for r in rows_ if r.doc_id in (2, 3)) == 2, name
        assert stage(spark, docs.limit(0), AT).count() == 0, name
    near = corpus_pipeline.near_duplicate_stage(spark, docs, AT).collect()
    assert sorted((r.doc_id for r in near), key=str) == [1, 1, 2, 3, 4, None]


def small_corpus():
    r = random.Random(12)
    word = lambda: "".join(r.choice(("an", "re", "the", "in", "on", "st", "er", "al")) for _ in range(r.randint(1, 3)))
    wort = lambda: "".join(r.choice(("sch", "ein", "ung", "der", "ich", "aus", "bei", "zu")) for _ in range(r.randint(1, 3)))
    line = lambda make, n: " ".join(make() for _ in range(n))
    shared = line(word, 60)
    rows = []
    for i in range(60):
        make, lang = ((word, "en"), (wort, "de"))[i % 2]
        lines = [line(make, 40) for _ in range(4)]
        if i % 6 == 0:
            lines.insert(1, shared.replace(" ", " ", 1) if i % 12 else " ".join(["other", *shared.split(" ")[1:]]))
        rows.append((i, "\n".join(lines), lang, "s", 0))
    for i in range(60, 66):  # near copies, one word changed
        words = rows[i - 60][1].replace("\n", " ").split(" ")
        words[20] = "changed"
        rows.append((i, " ".join(words), rows[i - 60][2], "s", 0))
    rows += [(66, "$#% &*! " * 60, "en", "s", 0), (67, "qxzj" * 90, "en", "s", 0), (68, None, "en", "s", 0), (69, "", "de", "s", 0)]
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(i, 1, 0) for i in range(1, 60, 4)] + [(66, 0, 0)]
    return rows, labels


def test_stages_equal_plain_python(spark, tmp_path):
    rows, labels = small_corpus()
    schema = spark.read.parquet(f"{AT}/documents.parquet").schema
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, at = dict(corpus_pipeline.STAGES), str(tmp_path)
    now = {r[0]: r[1] for r in rows}
    lang = {r[0]: r[2] for r in rows}

    def run(name, texts):
        docs = spark.createDataFrame([(i, t, lang[i], "s", len(t or "")) for i, t in texts.items()], schema).repartition(3)
        return docs, stages[name](spark, docs, at).collect()

    # quality: a plain model of the trusted texts that are trained on, quantiles of the others
    docs, got = run("quality classifier", now)
    good = [i for i, q, _ in labels if q == 1]
    held = {x.i for x in spark.createDataFrame([(i,) for i in good], "i long").where(F.pmod(F.xxhash64(F.lit(7), "i"), F.lit(4)) == 0).collect()}
    _, log10, _ = brute_kneser_ney([now[i] for i in good if i not in held])
    cost = {i: -log10(t) / len(t) for i, t in now.items() if t}
    asks = held if len(held) >= 20 else set(good)
    limits = {}
    for name in ("en", "de"):
        values = sorted(cost[i] for i in asks if lang[i] == name and len(now[i]) >= 200)
        limits[name] = values[max(0, math.ceil(0.99 * len(values)) - 1)] + 0.05
    now = {i: t for i, t in now.items() if t and cost[i] <= limits[lang[i]] + 1 / math.sqrt(len(t))}
    assert {r.doc_id: r.text for r in got} == now and 66 not in now and set(good) <= set(now)
    # language: the plain compressor with the same dictionaries
    docs, got = run("language identification", now)
    d = langid.fit(docs)

    def sizes(t):
        data, out = t.lower().encode(), []
        level = langid.SHORT_LEVEL if len(data) <= langid.SHORT else langid.LEVEL
        for content in d.values():
            c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
            out.append(sum(len(c.compress(data[i : i + langid.BLOCK])) for i in range(0, len(data), langid.BLOCK)))
        return out

    assert {r.doc_id: r.lang for r in got} == {i: min(zip(sizes(t), d))[1] for i, t in now.items()}
    # lines: all pairs by edit distance
    _, got = run("line deduplication", now)
    places = [(i, k, linededup.normalise(x)) for i in sorted(now) for k, x in enumerate(now[i].split("\n"))]
    lines = sorted({p[2] for p in places}, key=lambda x: (len(x), x))
    group = {x: x for x in lines}
    for a, b in brute_lines(lines):
        old, new = group[lines[b]], group[lines[a]]
        group = {x: new if g == old else g for x, g in group.items()}
    seen, kept = set(), {i: [] for i in now}
    for i, k, x in places:
        if group[x] not in seen:
            seen.add(group[x])
            kept[i].append(now[i].split("\n")[k])
    now = {i: "\n".join(x) for i, x in kept.items() if x}
    assert {r.doc_id: (r.text, r.n_chars) for r in got} == {i: (t, len(t)) for i, t in now.items()}
    # near duplicates: all pairs of bags
    _, got = run("near-duplicate removal", now)
    classes = brute_classes(list(now.items()))
    now = {i: t for i, t in now.items() if classes[i] == i}
    assert {r.doc_id: r.text for r in got} == now and not {60, 61, 62} & set(now)
    # packing: the library's ids of each text, each cut where its windows end
    _, got = run("packing", now)
    library = Tokenizer.from_file(model_path("word_bpe_49k.json"))
    own = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in now.items()}
    for i, ids in own.items():
        parts = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))]
        assert [p[2] for p in parts] == [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n, _ in parts] and sum(p[1] for p in parts) == len(ids)
    stream = sorted((r.sequence_id * 2048 + r.offset, r.length) for r in got)
    assert [p for p, _ in stream] == [sum(n for _, n in stream[:k]) for k in range(len(stream))]
