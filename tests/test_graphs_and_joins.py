"""Graph loops, range and as-of joins against brute force on random tables."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import graphs, joins, retrieval, vectors
from faultline.plans import doubling
from faultline.plans.components import connected_components
from faultline.sources import readers


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: find(k) for k in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_cycles_and_blockers(spark):
    r = random.Random(4)
    edges = sorted({(r.randrange(7), r.randrange(7)) for _ in range(16)})
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    want = set()

    def walk(path):
        for n in out[path[-1]]:
            if n == path[0]:
                want.add((*path, n))
            elif n > path[0] and n not in path:
                walk([*path, n])

    for s in range(7):
        walk([s])
    df = spark.createDataFrame([(1, a, b) for a, b in edges] + [(2, 1, 2), (2, 2, 3)], "log_id int, src int, dst int")
    got = graphs.dependency_cycles(df, 7).collect()
    assert {tuple(g.cycle) for g in got if g.log_id == 1} == want and not [g for g in got if g.log_id == 2]
    three = spark.createDataFrame([(1, "A", "B"), (1, "B", "C"), (1, "C", "A")], "log_id int, src string, dst string")
    assert [c.cycle for c in graphs.dependency_cycles(three).collect()] == [["A", "B", "C", "A"]]
    assert graphs.deadlocks(three).first().cycle == ["A", "B", "C", "A"]
    six = [(1, i, (i + 1) % 6) for i in range(6)]
    assert {c.truncated for c in graphs.dependency_cycles(spark.createDataFrame([*six, (1, 0, 0)], "log_id int, src int, dst int"), 3).collect()} == {True}
    assert [(len(c.cycle), c.truncated) for c in graphs.dependency_cycles(spark.createDataFrame(six, "log_id int, src int, dst int"), 3).collect()] == [(7, False)]
    chain = spark.createDataFrame([(1, "a", "b", 0), (1, "a", "z", 1), (1, "b", "c", 0), (2, "a", "b", 0), (2, "b", "a", 0)], "log_id int, src string, dst string, ord int")
    starts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "q"), (1, None)], "log_id int, start string")
    got = {(r.log_id, r.blocker, r.last_node, r.steps, r.deadlocked) for r in graphs.root_blocker(chain, starts).collect()}
    assert got == {(1, "c", "c", 2, False), (2, "a", "b", 1, True), (3, "q", "q", 0, False)}


@pytest.mark.parametrize("seed", [1])
def test_blockers_equal_walks(spark, seed):
    r = random.Random(seed)
    to = {i: r.randrange(60) for i in range(60) if r.random() < 0.9}
    want = {}
    for s in range(60):
        seen, at = [], s
        while at not in seen and at in to:
            seen.append(at)
            at = to[at]
        want[s] = (at, seen[-1], len(seen) - 1, True) if at in seen else (at, at, len(seen), False)
    edges = spark.createDataFrame([(1, a, b, 0) for a, b in to.items()], "log_id int, src int, dst int, ord int")
    starts = spark.createDataFrame([(1, s) for s in range(60)], "log_id int, start int")
    assert {x.start: (x.blocker, x.last_node, x.steps, x.deadlocked) for x in graphs.root_blocker(edges, starts).collect()} == want


def strong(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            for m in out[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return seen

    sets = {n: reach(n) for n in {x for e in edges for x in e}}
    return {n: min(m for m in s if n in sets[m]) for n, s in sets.items() if n in s}


@pytest.mark.parametrize("seed", [1, 3])
def test_strong_components_equal_brute_force(spark, seed):
    r = random.Random(seed)
    n = [12, 30, 60, 90][seed]
    edges = {(r.randrange(n), r.randrange(n)) for _ in range(int(n * [1.2, 1.5, 1.0, 1.1][seed]))}
    edges |= {(i, i + 1) for i in range(200, 240)} | {(240, 220), (5, 200), (300, 300)}  # a chain into a ring, a self loop
    rows = [(1, a, b) for a, b in edges] + [(1, None, 3), (1, 3, None)] + [(1, *next(iter(edges)))]
    got = {x.node: x.component for x in graphs.mutual_waits(spark.createDataFrame(rows, "log_id int, src int, dst int")).collect()}
    assert got == strong(edges)
    assert graphs.mutual_waits(spark.createDataFrame([], "log_id int, src int, dst int")).count() == 0


def test_one_cycle_of_many_nodes_is_whole(spark):
    n = 100_000
    order = list(range(n))
    random.Random(1).shuffle(order)
    rows = spark.range(n).selectExpr("1 as log_id", "id as i")
    place = spark.createDataFrame(list(enumerate(order)), "i long, node long")
    nxt = place.selectExpr(f"(i + {n} - 1) % {n} as i", "node as dst")
    edges = rows.join(place, "i").join(nxt, "i").select("log_id", F.col("node").alias("src"), "dst").unionByName(spark.range(1, 5000).selectExpr("1 as log_id", "-id as src", "-id + 1 as dst"))
    found = graphs.dependency_cycles(edges).collect()
    assert len(found) == 1 and not found[0].truncated and len(found[0].cycle) == n + 1
    at = order.index(0)
    assert found[0].cycle == order[at:] + order[:at] + [0]


def test_heap_graph_equals_brute_force(spark):
    r = random.Random(9)
    n = 25
    edges = sorted({(r.randrange(n), r.randrange(n)) for _ in range(30)})
    size = {i: r.randrange(0, 50) for i in range(n)}
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for m in out[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    nodes = spark.createDataFrame([(0, i, f"n{i}", "object", size[i]) for i in range(n)], "snapshot_id int, node int, name string, type string, self_size long")
    e = spark.createDataFrame([(0, a, b, k) for k, (a, b) in enumerate(edges)], "snapshot_id int, src int, dst int, ord int")
    want = {i: s for i in range(n) if (s := sum(size[k] for k in reach(i))) > 0}
    assert {x.node: x.retained_size for x in graphs.heap_retained(nodes, e).collect()} == want
    roots = [i for i in range(n) if i not in {b for _, b in edges}] or [0]
    dist, level = {i: 0 for i in roots}, roots
    while level:
        level = [b for a in level for b in sorted(out[a]) if b not in dist and not dist.update({b: dist[a] + 1})]
    assert {x.node: x.distance for x in graphs.heap_distance(nodes, e).collect()} == dist


def test_heap_snapshot_to_clusters(spark):
    text = '{"snapshot":{"meta":{"node_fields":["type","name","id","self_size","edge_count"],"node_types":[["object","string"]],"edge_fields":["type","name_or_index","to_node"],"edge_types":[[]]}},"nodes":[0,0,1,1,1, 0,1,2,5,1, 1,2,3,14,0],"edges":[0,0,5, 0,0,10],"strings":["GlobalHandler","retained","value"]}'
    nodes, edges = readers.heap_snapshot_to_graph(spark.createDataFrame([(7, text)], "snapshot_id int, content string"))
    assert {(e.src, e.dst) for e in edges.collect()} == {(0, 1), (1, 2)}
    got = {c.name: c for c in graphs.heap_clusters(nodes, edges).collect()}
    assert got["GlobalHandler"].retained_size == 20 and got["retained"].fault_mode == "JS-FM-01" and got["value"].chain == ["GlobalHandler", "retained", "value"] and got["value"].distance == 2
    a = spark.createDataFrame([("x", "t", 60), ("y", "t", 5)], "name string, type string, retained_size long")
    b = spark.createDataFrame([("x", "t", 20)], "name string, type string, retained_size long")
    assert {(r.name, r.change, r.delta) for r in graphs.diff_heap(a, b).collect()} == {("x", "grown", 40), ("y", "new", 5)}


def test_merge_chains(spark):
    rows = [(0, "a", "t", 10, ["r", "m", "x"]), (1, "b", "t", 30, ["m", "x"]), (2, "c", "t", 5, ["r", "m", "y"]), (3, "d", "t", 7, ["q"]), (4, "e", "t", 1, ["r", "m", "x"]), (5, "f", "t", 2, [])]
    got = {tuple(r.representative_chain): (r.instance_count, r.total_retained_size, r.name) for r in graphs.merge_chains(spark.createDataFrame(rows, "cluster_id int, name string, type string, retained_size long, chain array<string>")).collect()}
    assert got == {("r", "m", "x"): (3, 41, "b"), ("r", "m", "y"): (1, 5, "c"), ("q",): (1, 7, "d"), (): (1, 2, "f")}


def test_range_join_equals_brute_force(spark):
    r = random.Random(3)
    spans = []
    for i in range(60):
        lo = r.randrange(0, 1 << r.choice([14, 30, 63]))
        spans.append((i % 3, i, lo, min(lo + r.choice([1, 4096, 1 << 22, 1 << 40, 1 << 62]), (1 << 64) - 1)))
    points = [(k % 3, k, r.choice([p for s in spans for p in (s[2], s[3] - 1, s[3], s[2] + 7)])) for k in range(150)]
    dec = lambda rows, i: [tuple(__import__("decimal").Decimal(v) if j in i else v for j, v in enumerate(row)) for row in rows]
    p = spark.createDataFrame(dec(points, {2}), "log_id int, point_id int, va decimal(20,0)")
    s = spark.createDataFrame(dec(spans, {2, 3}), "log_id int, ord int, start decimal(20,0), end decimal(20,0)")
    got = sorted((x.point_id, x.ord) for x in joins.range_join(p, s, ["log_id"], "va", "start", "end").collect())
    assert got == sorted((k, i) for log, k, va in points for l2, i, lo, hi in spans if log == l2 and lo <= va < hi)
    plan = joins.range_join(p, s, ["log_id"], "va", "start", "end")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_map_addresses_prefers_executable_then_first(spark):
    from decimal import Decimal as D

    points = spark.createDataFrame([(1, 0, D(150)), (1, 1, D(1)), (2, 2, D(150))], "log_id int, point_id int, va decimal(20,0)")
    maps = spark.createDataFrame([(1, 0, D(100), D(200), False, D(0), "a"), (1, 1, D(100), D(200), True, D(50), "b"), (1, 2, D(120), D(160), True, D(0), "c")], "log_id int, ord int, start decimal(20,0), end decimal(20,0), executable boolean, file_offset decimal(20,0), path string")
    hits = joins.map_addresses(points, maps)
    assert {(r.point_id, r.path) for r in hits.collect()} == {(0, "b"), (1, None), (2, None)}
    assert joins.module_offsets(hits, maps).where("point_id = 0").first().offset == 100


@pytest.mark.parametrize("nearest", [False, True])
def test_asof_equals_brute_force(spark, nearest):
    r = random.Random(5)
    marks = sorted({(k % 2, r.randrange(500)) for k in range(40)})
    points = [(k % 2, k, r.randrange(500)) for k in range(80)]
    f = spark.createDataFrame([(str(b), i, o) for b, i, o in points], "build_id string, i int, offset long")
    s = spark.createDataFrame([(str(b), o, f"s{o}") for b, o in marks], "build_id string, symbol_start long, symbol string")
    want = {}
    for b, i, o in points:
        ok = [m for k, m in marks if k == b and (nearest or m <= o) and abs(o - m) <= 9]
        best = min(ok, key=lambda m: (abs(o - m), m > o), default=None)
        want[i] = None if best is None else f"s{best}"
    assert {x.i: x.symbol for x in joins.symbolize(f, s, 9, nearest).collect()} == want


def test_retained_sizes_of_chains_and_of_shared_parts(spark):
    n = 3000
    chain = graphs.heap_retained(spark.range(n).selectExpr("0 as snapshot_id", "id as node", "1L as self_size"), spark.range(n - 1).selectExpr("0 as snapshot_id", "id as src", "id + 1 as dst"))
    assert chain.where(f"retained_size <> {n} - node").count() == 0 and chain.count() == n
    # one part that all others hold, and a cycle above it
    edges = [(0, i, 1000) for i in range(500)] + [(0, 1000, 1001), (0, 0, 1), (0, 1, 2), (0, 2, 0)]
    nodes = [(0, i, 1) for i in range(500)] + [(0, 1000, 5), (0, 1001, 7), (0, 2000, 0)]
    got = {x.node: x.retained_size for x in graphs.heap_retained(spark.createDataFrame(nodes, "snapshot_id int, node int, self_size long"), spark.createDataFrame(edges, "snapshot_id int, src int, dst int")).collect()}
    assert got == {**{i: 13 for i in range(3, 500)}, 0: 15, 1: 15, 2: 15, 1000: 12, 1001: 7}


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_nearest_vectors_equal_all_pairs(spark, spread):
    r = np.random.default_rng(4)
    centres = r.normal(0, 4, (20, 6))
    x = [(i, (centres[i % 20] + r.normal(0, spread, 6)).round(3).tolist()) for i in range(900)]
    x += [(900 + i, x[0][1]) for i in range(60)] + [(2000, None), (2001, [1.0]), (2002, [float("nan")] * 6)]  # a hot vector
    table = spark.createDataFrame(x, "pattern_id long, embedding array<double>")
    asked = table.where("pattern_id % 9 = 0").withColumnRenamed("pattern_id", "query_id")
    good = {i: v for i, v in x if v and len(v) == 6 and v == v and not np.isnan(v).any()}
    for n in (1, 7):
        want = {}
        for q in [i for i in good if i % 9 == 0]:
            best = sorted((round(float(((np.array(v) - good[q]) ** 2).sum()), 6), i) for i, v in good.items())[:n]
            want |= {(q, k): p for k, (_, p) in enumerate(best, 1)}
        got = retrieval.vector_topk(asked, table, n, pivots=40, block_rows=50, pack_rows=30)
        assert {(y.query_id, y.rank): y.pattern_id for y in got.collect()} == want
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    work = vectors.search_work(vectors.ball_search(asked, table, 5, pivots=40)).agg(F.sum("computed")).first()[0]
    pairs = len(good) * len([i for i in good if i % 9 == 0])
    assert spread > 1 or work < pairs / 5
    assert retrieval.vector_topk(asked, table.limit(0)).count() == 0 and retrieval.vector_topk(asked.limit(0), table).count() == 0


def test_vectors_alike_in_distance_are_sent_once(spark, monkeypatch):
    """Where nothing can be left out, a query was written once for each ball, and a task held all of these."""
    r = np.random.default_rng(3)
    x = [(i, r.normal(0, 1, 40).tolist()) for i in range(400)]
    table = spark.createDataFrame(x, "pattern_id long, embedding array<double>")
    asked = table.where("pattern_id % 20 = 0").withColumnRenamed("pattern_id", "query_id")
    write, rows = vectors.materialize, []

    def counted(df, label):
        out = write(df, label)
        if label == "visits":
            rows.append(out.count())
        return out

    monkeypatch.setattr(vectors, "materialize", counted)
    got = retrieval.vector_topk(asked, table, 3, pivots=30, block_rows=60, pack_rows=8)
    want = {(q, k): p for q, v in x[::20] for k, (_, p) in enumerate(sorted((round(float(((np.array(v) - w) ** 2).sum()), 6), i) for i, w in x)[:3], 1)}
    assert {(y.query_id, y.rank): y.pattern_id for y in got.collect()} == want
    assert rows and max(rows) <= 20


def test_vectors_that_round_to_one_distance_tie_by_id(spark):
    table = spark.createDataFrame([(1, [5.0, 5.0]), (3, [1.0, 1.00001]), (10, [1.0, 1.0])], "pattern_id long, embedding array<double>")
    got = retrieval.vector_topk(table.where("pattern_id = 10").withColumnRenamed("pattern_id", "query_id"), table, 1)
    assert [(x.pattern_id, x.distance) for x in got.collect()] == [(3, 0.0)]


def test_flat_trees_are_raked_and_not_compressed(spark, monkeypatch):
    from faultline.plans import strong

    def never(*_):
        raise AssertionError("compressed")

    monkeypatch.setattr(strong, "to_ends", never)
    edges = spark.createDataFrame([(0, f"c{i}", f"o{i}") for i in range(6)] + [(0, f"o{i}", f"p{i % 2}") for i in range(6)], "k int, src string, dst string")
    assert strong.strong_components(edges, ["k"]).count() == 0


def test_pointer_rounds_broadcast_no_table(spark, monkeypatch, capsys):
    """A broadcast goes through the driver; rounds of a loop would send their whole tables there."""
    write = doubling.scratch

    def shown(df, label):
        df.explain()
        return write(df, label)

    monkeypatch.setattr(doubling, "scratch", shown)
    ring = spark.createDataFrame([(0, i, (i + 1) % 5) for i in range(5)], "log_id int, node long, to long")
    assert doubling.cycle_places(ring, ["log_id"]).count() == 5
    plans = capsys.readouterr().out
    assert "SortMergeJoin" in plans and "BroadcastHashJoin" not in plans


def test_retained_sizes_without_cycles_join_no_parts(spark, monkeypatch):
    # shared leaves under chains, an end that is no node, an edge that repeats; the table of parts is left out where no cycle is
    joined = []
    monkeypatch.setattr(graphs, "dealt", lambda x, f=graphs.dealt: joined.append(x.columns) or f(x))
    nodes = spark.createDataFrame([(0, n, s) for n, s in [("a", 1), ("b", 2), ("b", 2), ("c", 3), ("x", 10), ("y", 0), ("z", 5)]], "snapshot_id int, node string, self_size long")
    edges = spark.createDataFrame([(0, *e) for e in [("a", "b"), ("b", "x"), ("b", "x"), ("c", "x"), ("c", "y"), ("a", "y"), ("c", "w"), (None, "x"), ("z", None)]], "snapshot_id int, src string, dst string")
    got = {r.node: r.retained_size for r in graphs.heap_retained(nodes, edges).collect()}
    assert got == {"a": 15, "b": 14, "c": 13, "x": 10, "z": 5}
    assert len(joined) <= 5
    some = graphs.heap_retained(nodes, edges, nodes.where("node in ('a', 'y')")).collect()
    assert [(r.node, r.retained_size) for r in some] == [("a", 15)]
