"""Near-duplicate records with small edits: PartEnum set-similarity self-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import profiles as pf
from termloom.llm.partenum import similar_sets
from termloom.plans.lineage import cut, store

_FORM = ["l1", "l2", "m1", "m2"]


def profile_table(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("bigint"), F.lit(None).cast("string"), F.col(text_col).cast("string"))
    return store(rows.mapInArrow(pf.profiler(shingle), pf.PROFILE_SCHEMA), "profiles")


def same_form(a: str, b: str):
    """SQL condition that two aliased rows have one form."""
    return F.expr(f"({a}.l1 = {b}.l1 and {a}.l2 = {b}.l2) or ({a}.m1 <=> {b}.m1 and {a}.m2 <=> {b}.m2 and {a}.m1 is not null)")


def text_nodes(profiles: DataFrame) -> DataFrame:
    """(node, s1, s2, form, n): one row per different text with a shingle set; node = smallest id."""
    rows = profiles.where("size > 0")
    return cut(rows.groupBy("s1", "s2", *_FORM).agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")))


def node_pairs(profiles: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): nodes whose sets are similar and whose forms differ, a < b, each pair once."""
    sets = similar_sets(profiles, threshold)
    digests = profiles.select("id", "s1", "s2")
    many = nodes.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1")
    within = many.select("s1", "s2", F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    across = (
        sets.join(digests.select(F.col("id").alias("a"), "s1", "s2"), "a")
        .join(digests.select(F.col("id").alias("b"), F.col("s1").alias("t1"), F.col("s2").alias("t2")), "b")
        .select("s1", "s2", "t1", "t2")
    )
    x = nodes.select("s1", "s2", F.struct("node", *_FORM).alias("x"))
    y = nodes.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.struct("node", *_FORM).alias("y"))
    pairs = within.union(across).join(x, ["s1", "s2"]).join(y, ["t1", "t2"])
    inside = F.expr("s1 = t1 and s2 = t2")
    pairs = pairs.where(~same_form("x", "y") & (~inside | F.expr("x.node < y.node")))
    return cut(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")))


def _members(profiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, node) of every row whose node stands for more than itself, and of all others."""
    rows = profiles.where("size > 0").select("id", "s1", "s2", *_FORM).alias("r")
    same = F.expr(" and ".join(f"r.{c} <=> n.{c}" for c in ["s1", "s2", *_FORM]))
    return rows.join(nodes.alias("n"), same).select("r.id", "n.node")


def near_pairs(docs: DataFrame, id_col: str = "ordinal", text_col: str = "text", *, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(a, b): every pair of rows with similar texts that are not the same in form, a < b.

    Similar: intersection over union of the sets of ``shingle``-word runs of at least
    ``threshold``.  The join runs on different texts only; copies are put back at the end, so a
    huge group of copies never meets itself.

    Null and empty texts, and texts of fewer than ``shingle`` words, are in no pair.  Rows with a
    null id are left out; rows that repeat an id count as one record per different text and are
    not paired with themselves.  An empty table gives no rows; other columns are ignored.
    """
    profiles = profile_table(docs, id_col, text_col, shingle)
    nodes = text_nodes(profiles)
    pairs = node_pairs(profiles, nodes, threshold)
    involved = cut(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"))
    members = cut(_members(profiles, nodes.join(involved, "node", "left_semi")))
    x = members.select(F.col("node").alias("a"), F.col("id").alias("x"))
    y = members.select(F.col("node").alias("b"), F.col("id").alias("y"))
    rows = pairs.join(x, "a").join(y, "b").where("x != y")
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's connected component.

    Alternating star contraction: every round links a node's neighbours straight to its smallest
    one, so rounds grow with the logarithm of a component's size and no component is gathered.
    ``edges``: (a, b) with a != b.
    """
    stars = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = stars.union(stars.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(small.union(low.withColumnRenamed("m", "v")).where("u != v").distinct())
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).union(stars.select("v", "v").distinct())


def near_classes(docs: DataFrame, id_col: str = "ordinal", text_col: str = "text", *, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, class_id, links) of every row with a non-null id.

    ``links``: different texts that are similar to the row's own (as in :func:`near_pairs`).
    ``class_id``: smallest id among the rows whose texts are linked, directly or through others,
    or have the same shingle set and form.  Rows without a shingle set are classes of their own.
    """
    profiles = profile_table(docs, id_col, text_col, shingle)
    nodes = text_nodes(profiles)
    pairs = node_pairs(profiles, nodes, threshold)
    labels = connected(pairs)
    links = pairs.select("a").union(pairs.select("b")).groupBy("a").agg(F.count(F.lit(1)).alias("links")).withColumnRenamed("a", "node")
    members = _members(profiles, nodes).join(labels, "node", "left").join(links, "node", "left")
    linked = members.select("id", F.coalesce("label", "node").alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
    alone = profiles.where("size = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    return linked.union(alone)
