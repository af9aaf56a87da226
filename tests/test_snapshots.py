"""Heap snapshots read in many splits."""

import json
import random

import pytest

from faultline.sources import readers, snapshots


def snapshot(n, seed):
    rnd = random.Random(seed)
    strings = [rnd.choice(["", "a,b", 'say "x"', "back\\", "line\nbreak", "[1,2]", '"nodes":[', "é漢", "],", "plain"]) + str(i) for i in range(n)]
    counts = [rnd.randint(0, 3) for _ in range(n)]
    nodes = [x for i in range(n) for x in (rnd.randint(0, 3), i, i, rnd.randint(0, 9000), counts[i])]
    edges = [x for _ in range(sum(counts)) for x in (rnd.randint(0, 1), 0, rnd.randint(0, n + 2) * 5)]
    meta = {"node_fields": ["type", "name", "id", "self_size", "edge_count"], "node_types": [["hidden", "object", "string"], "string"], "edge_fields": ["type", "name_or_index", "to_node"]}
    return {"snapshot": {"meta": meta, "node_count": n}, "nodes": nodes, "edges": edges, "trace_tree": [], "strings": strings}


def rows_of(df, drop=()):
    return sorted(repr([r[c] for c in sorted(df.columns) if c not in drop]) for r in df.collect())


@pytest.mark.parametrize("indent,ascii_", [(None, True), (1, False)])
def test_splits_give_the_graph_of_the_parsed_file(spark, tmp_path, indent, ascii_):
    docs = {f"{n}.heapsnapshot": json.dumps(snapshot(n, n), indent=indent, ensure_ascii=ascii_) for n in (1, 7, 400)}
    for name, text in docs.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "other.heapsnapshot").write_text('{"a": [1, 2]}')
    (tmp_path / "empty.heapsnapshot").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        nodes, edges = snapshots.read_graph(spark, str(tmp_path))
        got_nodes, got_edges = rows_of(nodes), rows_of(edges)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = spark.createDataFrame([(f"file:{tmp_path}/{name}", text) for name, text in docs.items()], "snapshot_id string, content string")
    want_nodes, want_edges = readers.heap_snapshot_to_graph(whole)
    assert got_nodes == rows_of(want_nodes)
    assert got_edges == rows_of(want_edges)
