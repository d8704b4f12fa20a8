"""Concept trees: edges, root-to-node paths, path texts, trees from code prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sortkeys
from ..functions.text import short_id
from ..session import written


def build_tree(concepts: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Concepts (id, pref_label, broader, notation) → edges (parent, id, label, notation, hits).

    ``parent`` is NULL for top concepts. Children stay rows: a parent may have any number of them.
    """
    nodes = concepts.where("pref_label IS NOT NULL").select(
        F.col("broader").alias("parent"),
        "id",
        F.col("pref_label").alias("label"),
        F.coalesce(F.regexp_replace("notation", "^[a-z]+(?=[0-9])", ""), F.lit("")).alias("notation"),
    )
    if hits is None:
        return nodes
    counts = hits.select(F.col("key").alias("_k"), F.col("doc_count").alias("_n"))
    joined = nodes.join(counts, F.col("id") == F.col("_k"), "left")
    return joined.withColumn("hits", F.coalesce("_n", F.lit(0).cast("bigint"))).drop("_k", "_n")


def children_count(tree: DataFrame) -> DataFrame:
    return tree.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("children"))


def paths(tree: DataFrame) -> DataFrame:
    """(id, path): ids from the top concept to the node, for every node.

    Each round doubles the known stretch above a node, so a tree of depth d needs log2(d) joins, and
    there is no limit to d. A stretch that meets a node twice is in a circle and is closed. A node that
    no top concept reaches (unknown parent, circle) has itself as path.
    """
    start = tree.select(
        "id", F.array("id").alias("path"), F.col("parent").alias("up"), F.lit(True).alias("sound")
    )
    state = written(start, "paths")
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select(
            F.col("id").alias("_id"), F.col("path").alias("_path"), F.col("up").alias("_up"),
            F.col("sound").alias("_sound"),
        )
        # Finished nodes take no part in the join.
        done = state.where("up IS NULL")
        open_nodes = state.where("up IS NOT NULL").join(above, F.col("up") == F.col("_id"), "left")
        moved = open_nodes.select(
            "id",
            F.concat(F.coalesce("_path", F.array().cast("array<string>")), "path").alias("path"),
            F.col("_up").alias("up"),
            (F.col("_id").isNotNull() & F.col("sound") & F.coalesce("_sound", F.lit(False))).alias("sound"),
        )
        circle = F.size(F.array_distinct("path")) < F.size("path")
        closed = moved.select(
            "id", F.when(circle, F.array("id")).otherwise(F.col("path")).alias("path"),
            F.when(~circle, F.col("up")).alias("up"), (F.col("sound") & ~circle).alias("sound"),
        )
        state = written(done.unionByName(closed), "paths")
    whole = F.col("sound") & F.col("up").isNull()
    return state.select("id", F.when(whole, F.col("path")).otherwise(F.array("id")).alias("path"))


def path_text(paths_df: DataFrame, labels: DataFrame, with_n: str = "n") -> DataFrame:
    """(id, text): ``label (n100) > label (n110)``; a path is as long as the tree is deep."""
    steps = paths_df.select("id", F.posexplode("path").alias("pos", "node"))
    names = labels.select(F.col("k").alias("_k"), F.col("v").alias("_label"))
    named = steps.join(names, F.col("node") == F.col("_k"), "left")
    step = F.concat(F.coalesce("_label", "node"), F.lit(f" ({with_n}"), short_id(F.col("node")), F.lit(")"))
    texts = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", step.alias("t")))).alias("s"))
    return texts.select("id", F.array_join(F.transform("s", lambda x: x["t"]), " > ").alias("text"))


def tree_from_codes(communes: DataFrame, base: str = "") -> DataFrame:
    """Edges from commune codes: (parent, id, label, notation).

    ``communes``: code, part, label, association, district. A part lies under its commune; a commune
    under its association (first 5 places of the code), this under the district (first 3), and what has
    no district stands on top. ``sets.dedupe_across_parents`` settles a node with several parents.
    """
    def uri(code: Column) -> Column:
        return F.concat(F.lit(base + "n"), code)

    def missing(name: str) -> Column:
        return F.coalesce(F.trim(name) == "", F.lit(True))

    has_part, has_district, has_assoc = ~missing("part"), ~missing("district"), ~missing("association")
    notation = F.concat(F.col("code"), F.coalesce("part", F.lit("")))
    district_code, assoc_code = F.substring("code", 1, 3), F.substring("code", 1, 5)
    district_label = F.when(F.lower("district").contains("kreis"), F.col("district")).otherwise(
        F.concat("district", F.lit(", Landkreis"))
    )

    def edge(parent: Column, code: Column, label: Column) -> Column:
        return F.struct(
            parent.alias("parent"), uri(code).alias("id"), label.alias("label"), code.alias("notation")
        )

    top = F.lit(None).cast("string")
    in_assoc = ~has_part & has_district & has_assoc
    own_parent = (
        F.when(has_part, uri(F.col("code")))
        .when(in_assoc, uri(assoc_code))
        .when(has_district, uri(district_code))
    )
    edges = F.array(
        edge(own_parent, notation, F.col("label")),
        F.when(~has_part & has_district, edge(top, district_code, district_label)),
        F.when(
            in_assoc,
            edge(uri(district_code), assoc_code, F.concat("association", F.lit(", Verbandsgemeinde"))),
        ),
    )
    return (
        communes.select(F.explode(F.filter(edges, lambda e: e.isNotNull())).alias("e"))
        .select("e.*")
        .distinct()
    )


def register(concepts: DataFrame, label: str = "pref_label") -> DataFrame:
    """Flat alphabetical list, district numerals in numeric order."""
    return concepts.where(F.col(label).isNotNull()).orderBy(*register_order(label))


def register_order(label: str = "pref_label") -> list[Column]:
    return [sortkeys.district(F.col(label)).asc(), F.asc(label), F.asc("id")]


def orphans(tree: DataFrame) -> DataFrame:
    """Nodes whose parent is not in the tree."""
    known = tree.select(F.col("id").alias("_known"))
    return tree.where("parent IS NOT NULL").join(known, F.col("parent") == F.col("_known"), "left_anti")
