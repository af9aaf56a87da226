"""The operators' queries over the given tables: each applies one operator, with production settings, to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import centroids, collocations, langid, lattice, linededup, minhash, packing, pieces, quality, rules, secretscan, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(key: Column, n: int) -> Column:
    """A row's fold: crc32 of its id as text, mod n."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    found = langid.predict(docs, langid.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode(table(spark, sf_dir, "documents"), model_path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v")).where("v is not null")
    return topk.search(rows, rows.where("vec_id % 50 = 0"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_symbols", "log10_p", F.when(F.col("n_symbols") > 0, F.pow(F.lit(10.0), -F.col("log10_p") / F.col("n_symbols"))).alias("perplexity"), F.pow(F.lit(10.0), "kn_limit").alias("threshold"), F.col("kn_kept").alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), "v1")
    base = F.col("fail_bits").bitwiseAND(F.lit(rules.mask("base")).cast("bigint")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "fail_bits", "n_lines", "n_letters", "n_upper")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "ld_lines", "ld_removed")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), model_path("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "boundary")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.resolve(warc.round_trip(table(spark, sf_dir, "pages")))
    return rows.select("page_id", F.col("payload_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "url")


def op10_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 10) == 0
    rows = lattice.score(docs, model_path("piece_bpe_32k.model"), ~held_out)
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("secret_spans")
    count = lambda kind: F.size(secretscan.of_kind(spans, kind)).cast("long").alias(f"n_{kind}")
    base = secretscan.joined(secretscan.of_kind(spans, *secretscan.SHAPES))
    rows = secretscan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *[count(k) for k in secretscan.SHAPES], F.sha2(base, 256).alias("base_sha256"), secretscan.joined(spans).alias("spans"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _secret_sql() -> str:
    """Matches from what lies between them; windows one by one, each counted from its characters."""
    shapes = {
        "assign": (r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)", 2, 8),
        "access": (r"AKIA[A-Z0-9]+", 0, 16),
        "hex": (r"[0-9a-f]{32,}", 0, 32),
    }
    places = "select doc_id, {kind} as kind, list_sum(list_transform(ps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) as s, ms[i] as m, gs[i] as g from (select doc_id, ps, ms, gs, unnest(range(1, len(ms) + 1)) as i from (select doc_id, regexp_split_to_array(t, '{p}') as ps, regexp_extract_all(t, '{p}') as ms, regexp_extract_all(t, '{p}', {g}) as gs from d))"
    base = " union all ".join(f"select doc_id, {k} as k, kind, s, s + length(m) as e from ({places.format(kind=repr(kind), p=p, g=g)}) where length(g) >= {least}" for k, (kind, (p, g, least)) in enumerate(shapes.items()))
    tests = {"digit": "[0-9]", "letter": "[A-Za-z]", "lower": "[a-z]", "upper": "[A-Z]"}
    parts, w = [], secretscan.WINDOW
    for k, (kind, (chars, bits, needs)) in enumerate(secretscan.CLASSES.items(), len(shapes)):
        allowed = " or ".join(f"regexp_full_match(m, '{p}')" for p in secretscan.ALLOW)
        held = " and ".join(f"regexp_matches(x, '{tests[n]}')" for n in needs)
        cost = f"list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: {secretscan.COST}[length(x) - length(replace(x, c, '')) + 1]))"
        parts.append(f"""
        r{k} as (select doc_id, s as o, m from ({places.format(kind=repr(kind), p=f"{chars}{{{w},}}", g=0)}) where not ({allowed})),
        x{k} as (select doc_id, o, o + i as s, substr(m, i + 1, {w}) as x from (select doc_id, o, m, unnest(range(0, length(m) - {w - 1})) as i from r{k})),
        y{k} as (select doc_id, o, s, s - coalesce(lag(s) over (partition by doc_id, o order by s), -{w + 1}) > {w} as fresh from x{k} where {cost} <= {secretscan.most_cost(bits)} and {held}),
        z{k} as (select doc_id, {k} as k, '{kind}' as kind, min(s) as s, max(s) + {w} as e from (select *, sum(fresh::int) over (partition by doc_id, o order by s) as n from y{k}) group by doc_id, o, n),
        f{k} as (select * from f{k - 1} union all select * from z{k} where not exists (select 1 from f{k - 1} f where f.doc_id = z{k}.doc_id and f.s <= z{k}.s and z{k}.e <= f.e)),""")
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents),
        f{len(shapes) - 1} as materialized ({base}),{"".join(parts)}
        a as (select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex, string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e) filter (k < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e) as spans from f{len(shapes) + len(parts) - 1} group by doc_id)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (doc_id)"""


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_exact_topk": op3_exact_topk,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_lattice_scores": op10_lattice_scores,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_secret_scan": op12_secret_scan,
    "op13_centroid_clusters": op13_centroid_clusters,
}


def _centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds one after the other, each as its centroids and its assignment."""
    steps = [f"""
        e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        c0 as (select row_number() over (order by sha256('2:' || vec_id), v)::int - 1 as c, v from e qualify c < {k}),"""]
    near = "select vec_id, v, (best).c as c, (best).d as d from (select e.vec_id, e.v, min(struct_pack(d := list_sum(list_transform(list_zip(e.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, c := c{i}.c)) as best from e, c{i} group by e.vec_id, e.v, e.rowid)"
    for i in range(rounds + 1):
        steps.append(f"a{i} as materialized ({near.format(i=i)}),".replace("e.rowid", "e.vec_id"))
        if i < rounds:
            steps.append(f"""
        s{i} as (select c, p, sum(x)::hugeint as s, count(*)::hugeint as n from (select c, unnest(v) as x, unnest(range(1, 65)) as p from a{i}) group by c, p),
        m{i} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by p) as v from s{i} group by c),
        c{i + 1} as materialized (select c{i}.c, coalesce(m{i}.v, c{i}.v) as v from c{i} left join m{i} using (c)),""")
    return f"""with {"".join(steps)}
        z as (select c, sum(d)::bigint as i from a{rounds} group by c)
        select vec_id, c as cluster, d as distance, z.i as cluster_inertia, (select sum(i) from z)::bigint as inertia, sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256 from a{rounds} join z using (c) join c{rounds} using (c)"""


ORACLES = {
    "op3_exact_topk": """
        with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5
    """,
    "op11_phrase_collocations": r"""
        with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
        w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
        g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase, count(*) as f from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (values (1), (2), (3)) x(k)) group by all),
        n as (select lang, sum(f)::bigint as n from g where k = 1 group by lang),
        c as (select * from g where k > 1 and f >= 10),
        t as (select c.*, j, array_to_string(string_split(phrase, ' ')[:j], ' ') as x, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') as y from c, (values (1), (2)) z(j) where j < k),
        s as (select t.lang, t.phrase, t.f as a, j, gx.f as l, gy.f as r, (1000000::hugeint * t.f * t.f // (gx.f::hugeint * gy.f))::bigint as score from t join g gx on gx.lang = t.lang and gx.phrase = x join g gy on gy.lang = t.lang and gy.phrase = y),
        b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
        o as (select lang, f, unnest([string_split(phrase, ' ')[1:2], string_split(phrase, ' ')[2:3]]) as q from c where k = 3),
        h as (select lang, array_to_string(q, ' ') as phrase, max(f) as f from o group by all),
        r as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, encode(phrase)) as rank from b left join h using (lang, phrase) where h.f is null or 100 * h.f < 50 * a)
        select lang, rank, phrase, a, l, r.r as r, n, score from r join n using (lang) where rank <= 2000
    """,
    "op12_secret_scan": _secret_sql(),
    "op13_centroid_clusters": _centroid_sql(),
    "op9_warc": """
        with p as (select page_id, url, coalesce(html, '') as h from pages),
        d as (select page_id, url, strlen(h)::bigint as payload_bytes, sha1(h) as payload_digest from p),
        m as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as original from d)
        select page_id, payload_bytes, payload_digest, case when original > page_id then 'revisit' else 'response' end as record_type, case when original > page_id then original end as refers_to, coalesce(url, '') as url from m
    """,
    "op6_quality_rules": r"""
        with d as (select doc_id, coalesce(text, '') as t from documents),
        w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
        g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
        r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) where c > 1),
        p as (select doc_id, count(*) as n from (select distinct doc_id, unnest([i, i + 1, i + 2]) as q from r) group by doc_id),
        m as (select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(p.n, 0) as n_repeat_words, len(ls) as n_lines, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) as n_letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) as n_upper from w left join p using (doc_id)),
        f as (select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (100 * n_symbols > 10 * word_chars)::bigint + 8 * (2 * n_dup_lines > n_lines)::bigint + 16 * (word_chars > 20 * n_words or word_chars < 2 * n_words)::bigint + 32 * (2 * n_upper > n_letters)::bigint + 64 * (10 * n_letters < 6 * word_chars)::bigint as fail_bits from m)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept, fail_bits, n_lines, n_letters, n_upper from f
    """,
}
