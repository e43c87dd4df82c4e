"""Merkle trees: nodes (_hash, id, isParent, children, meta) expanded, addressed and hashed level by level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.hashing import HASH, canonical, hash_of, row_hash
from lamina.sources.scratch import new_path, stored
from lamina.sources.store import all_equal

MAX_DEPTH = 1000
#: Ends the place of a node: above every position among siblings.
LAST = 2**31 - 1
NODE_SCHEMA = T.StructType([T.StructField(HASH, T.StringType()), T.StructField("id", T.StringType()), T.StructField("isParent", T.BooleanType()), T.StructField("children", T.ArrayType(T.StringType())), T.StructField("meta", T.StringType())])


def child_edges(nodes: DataFrame) -> DataFrame:
    """(parent, child) for every listed child."""
    return nodes.select(F.col(HASH).alias("parent"), F.explode("children").alias("child"))


def roots(nodes: DataFrame) -> DataFrame:
    """Nodes that no node lists as a child."""
    return nodes.join(child_edges(nodes).select(F.col("child").alias(HASH)), HASH, "left_anti")


def expand(nodes: DataFrame, start: DataFrame | None = None, path: Sequence[str] | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, _hash, path, depth): one row for each occurrence of a node below the start nodes (roots by default).

    With a path, nodes at each of its levels must bear its ids; below its end everything is kept. A node
    that several parents share appears once per way to it.
    """
    first = start if start is not None else roots(nodes)
    steps = F.array(*map(F.lit, path)) if path else F.array().cast("array<string>")
    begin = first.select(F.col(HASH).alias("root"), HASH, F.array("id").alias("path"), F.lit(0).alias("depth"), "children", steps.alias("steps"))
    begin = begin.where((F.size("steps") == 0) | (F.get("steps", F.lit(0)) == F.get("path", F.lit(0))))
    nodes_ = nodes.select(F.col(HASH).alias("node"), "id", F.col("children").alias("next"))
    return nodes.sparkSession.sql(
        f"""WITH RECURSIVE walk(root, node, path, depth, children, steps) MAX RECURSION LEVEL {int(max_depth)} AS (
              SELECT root, `{HASH}`, path, depth, children, steps FROM {{begin}}
              UNION ALL
              SELECT w.root, n.node, concat(w.path, array(n.id)), w.depth + 1, n.next, w.steps
              FROM (SELECT root, path, depth, steps, explode(children) AS child FROM walk) w JOIN {{nodes}} n ON w.child = n.node
              WHERE w.depth + 1 >= size(w.steps) OR n.id = get(w.steps, w.depth + 1))
            SELECT root, node AS `{HASH}`, path, depth FROM walk LIMIT ALL""",
        begin=begin,
        nodes=nodes_,
    )


def find(nodes: DataFrame, where: Mapping[str, object], path: Sequence[str] | None = None) -> DataFrame:
    """The node of a where, `path` and `place` with it; children before their parent in the order of `place`.

    More than one match is an error, none gives no rows. Without a path the node comes alone. With one its
    nodes must bear the path's ids level by level, and all below its end comes along (all, for an empty path).
    """
    found = nodes.where(all_equal(where)) if where else nodes
    if found.limit(2).count() > 1:
        raise ValueError(f"several trees for {dict(where)}: ask for one")
    if path is None:
        return found.withColumns({"path": F.array("id"), "place": F.array(F.lit(LAST))})
    placed = _with_places(expand(nodes, found, path), nodes)
    return nodes.join(placed, HASH)


def _with_places(walked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(_hash, path, place) of one expanded tree: the positions of a node's ancestors and of itself among their siblings.

    A number above all positions ends each, so that a node sorts after what lies below it. Siblings bear
    different ids; where they do not, the first position counts.
    """
    at = nodes.select(F.col(HASH).alias("parent"), F.posexplode("children").alias("pos", "child"))
    ids = nodes.select(F.col(HASH).alias("child"), F.col("id").alias("child_id"))
    held = stored(walked.select(HASH, "path", "depth"), "walk")
    own = held.select(F.col("path").alias("above"), F.col(HASH).alias("parent")).join(at, "parent").join(ids, "child")
    own = own.select(F.concat("above", F.array("child_id")).alias("path"), F.col("child").alias(HASH), "pos").groupBy("path", HASH).agg(F.min("pos").alias("pos"))
    steps = own.select("path", HASH, "pos").join(held, ["path", HASH])
    # every node takes the positions of the prefixes of its path: as many rows as it is deep
    prefixes = held.select("path", HASH, F.explode(F.sequence(F.lit(1), F.size("path"))).alias("n")).select("path", HASH, "n", F.slice("path", 1, F.col("n")).alias("prefix"))
    places = steps.groupBy(F.col("path").alias("prefix")).agg(F.min("pos").alias("pos"))
    joined = prefixes.join(places, "prefix", "left").groupBy("path", HASH).agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("pos", F.lit(0)).alias("pos")))).alias("p"))
    return joined.select(HASH, "path", F.concat(F.transform("p", lambda x: x["pos"]), F.array(F.lit(LAST))).alias("place"))


def cells(nodes: DataFrame, start: DataFrame | None = None, path: Sequence[str] | None = None) -> DataFrame:
    """(root, path, meta) of the leaves: expanded nodes none of whose children is in the expansion."""
    walked = expand(nodes, start, path)
    inner = walked.where("depth > 0").select("root", F.slice("path", 1, F.size("path") - 1).alias("path")).distinct()
    leaves = walked.join(inner, ["root", "path"], "left_anti")
    return leaves.join(nodes.select(HASH, "meta"), HASH).select("root", "path", "meta")


def nested(nodes: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(root, path, value): every node's canonical JSON of what lies below it, folded from the deepest level up."""
    walked = stored(expand(nodes, start).join(nodes.select(HASH, "id", "meta", F.size("children").alias("n")), HASH), "walk")
    deepest = walked.agg(F.max("depth")).first()[0] or 0
    level = walked.where(F.col("depth") == deepest).select("root", "path", "id", _leaf_value().alias("value"))
    for depth in range(deepest - 1, -1, -1):
        entry = F.concat(F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(":"), F.col("value"))
        folded = level.groupBy("root", F.slice("path", 1, depth + 1).alias("path")).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}")).alias("below"))
        level = stored(walked.where(F.col("depth") == depth).join(folded, ["root", "path"], "left").select("root", "path", "id", F.coalesce("below", _leaf_value()).alias("value")), "level")
    return level.select("root", "path", "value")


def _leaf_value():
    return F.when(F.col("meta").isNull(), F.lit("{}")).otherwise(F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json("meta"), "$.value", "variant")), F.col("meta")))


def merkle(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """Content hashes of a tree given as edges (parent, child) and node texts (id, text), bottom-up by level.

    A node's hash is over its text and the sorted hashes of its children; a level is hashed when all of
    its children are, so there are as many rounds as the tree is deep. Each level is written once to the
    shared folder and read from there by the next ones, so that plans stay short and a lost executor
    costs one level at most.
    """
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "merkle")
    total = leaves.count()
    own = leaves.join(edges.select(F.col("parent").alias("id")), "id", "left_anti").select("id", row_hash(T.StructType([leaves.schema["text"]])).alias("hash"))
    own.write.parquet(path)
    known = 0
    while (n := spark.read.schema(own.schema).parquet(path).count()) < total:
        if n == known:
            raise ValueError("edges do not form trees")
        known, done = n, spark.read.schema(own.schema).parquet(path)
        waiting = edges.join(done.select(F.col("id").alias("parent")), "parent", "left_anti")
        hashed = waiting.join(done.select(F.col("id").alias("child"), "hash"), "child", "left")
        ready = hashed.groupBy("parent").agg(F.count("*").alias("n"), F.count("hash").alias("known"), F.array_sort(F.collect_list("hash")).alias("children")).where("n = known")
        kinds = T.StructType([T.StructField("children", T.ArrayType(T.StringType())), leaves.schema["text"]])
        ready.select(F.col("parent").alias("id"), "children").join(leaves, "id").select("id", row_hash(kinds).alias("hash")).write.mode("append").parquet(path)
    return spark.read.schema(own.schema).parquet(path)


def nodes_of(value: Mapping, name: str = "root") -> list[dict]:
    """Nodes of a nested object, root last; for what a user passes in, before it becomes rows.

    A value becomes a leaf with meta {"value": value}; an empty object is a parent without children.
    """
    out: dict[str, dict] = {}

    def add(id_: str, own: object) -> str:
        if isinstance(own, Mapping):
            node = {"id": id_, "isParent": True, "children": [add(k, v) for k, v in own.items()], "meta": None}
        else:
            node = {"id": id_, "isParent": False, "children": [], "meta": canonical({"value": own})}
        hash_ = hash_of(node)
        out.setdefault(hash_, {HASH: hash_, **node})
        return hash_

    add(name, value)
    return list(out.values())
