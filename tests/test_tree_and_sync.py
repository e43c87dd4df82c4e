import pytest
from pyspark.sql import functions as F

from lamina.functions import nested
from lamina.operators import tree
from lamina.streaming import sync

OBJECT = {"subNode1": {"subSubNode1": "text", "subSubNode2": {}}, "subNode2": {"subSubNode3": {"subSubSubNode1": "text"}, "subSubNode4": {}}, "subNode3": "text"}


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(tree.nodes_of(OBJECT), tree.NODE_SCHEMA)


def test_tree_paths_and_leaves(nodes):
    assert tree.expand(nodes).count() == 9
    assert {"/".join(r.path) for r in tree.cells(nodes).collect()} == {"root/subNode1/subSubNode1", "root/subNode1/subSubNode2", "root/subNode2/subSubNode3/subSubSubNode1", "root/subNode2/subSubNode4", "root/subNode3"}
    assert tree.expand(nodes, path=["root", "subNode1", "subSubNode1"]).count() == 3
    assert tree.roots(nodes).first().id == "root"


def test_tree_back_to_an_object(nodes):
    import json

    assert json.loads(tree.nested(nodes).first().value) == OBJECT


def test_shared_subtrees_have_a_path_for_each_occurrence(spark):
    twice = spark.createDataFrame(tree.nodes_of({"a": {"x": 1}, "b": {"x": 1}}), tree.NODE_SCHEMA)
    assert {"/".join(r.path) for r in tree.cells(twice).collect()} == {"root/a/x", "root/b/x"}


def test_prune(spark):
    df = spark.createDataFrame([('{"a":{"b":1,"c":"x"},"d":2}',), ("{}",), (None,)], "v string")
    got = [r[0] for r in df.select(nested.prune(F.col("v"), ["a", "c"])).collect()]
    assert got == ['{"a":{"c":"x"}}', "{}", None]


def test_dedup_forgets_after_two_generations(spark, tmp_path):
    """With a size of 3: a b c, a again is held back, d e f, and then a counts as new."""
    refs = ["a", "b", "c", "a", "d", "e", "f", "g", "a"]
    rows = [("/r", "peer", r, "c1", n, n + 1 + (n > 5), None) for n, r in enumerate(refs)]
    spark.createDataFrame(rows, sync.PAYLOAD).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sync.PAYLOAD).parquet(str(tmp_path / "in"))
    out = sync.receive(stream, "me", 3)
    query = out.writeStream.format("memory").queryName("received").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("received").collect()
    new = [r.r for r in got if r.kind == "ref"]
    assert new.count("b") == 1 and new.count("a") == 2 and len([r for r in got if r.kind == "ack"]) == len(new)
    # a repeated ref is dropped before its number is looked at, so the one after it starts a gap
    assert [(r.seq, r.after_seq) for r in got if r.kind == "gap"] == [(5, 3), (8, 6)]


def test_observers():
    seen, o = [], sync.Observers()
    o.notify("/r", "early")
    o.register("/r", seen.append)
    o.register("/r", lambda _: 1 / 0)
    o.notify("/r", "late")
    assert seen == ["early", "late"] and len(o.errors) == 1
    o.unregister("/r")
    o.notify("/r", "none")
    assert seen == ["early", "late"]
