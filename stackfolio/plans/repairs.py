"""Repairs of broken ids in catalogue entries. Each gives the changed records only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import (
    heading_of_place, region_of, repaired_agent, repaired_heading, spatial_candidate,
)
from ..naming import Namespaces

NS = Namespaces()


def _changed(df: DataFrame, id_col: str, column: str, new: Column, distinct: bool = True) -> DataFrame:
    """Rows whose list really changed, with the list made distinct."""
    rows = df.select(id_col, column, new.alias("_new")).where(~F.col("_new").eqNullSafe(F.col(column)))
    return rows.select(id_col, (F.array_distinct("_new") if distinct else F.col("_new")).alias(column))


def repair_headings(df: DataFrame, id_col: str, chains: str, ns: Namespaces = NS) -> DataFrame:
    """Authority ids written ``…nX`` in heading chains (list of lists)."""
    new = F.transform(F.col(chains), lambda c: F.transform(c, lambda v: repaired_heading(v, ns)))
    return _changed(df, id_col, chains, new)


def repair_agents(df: DataFrame, id_col: str, agents: str, ns: Namespaces = NS) -> DataFrame:
    """Local headings written as authority ids in a list of agents."""
    return _changed(df, id_col, agents, F.transform(F.col(agents), lambda v: repaired_agent(v, ns)))


def repair_places(df: DataFrame, id_col: str, places: str, tree_ids: DataFrame, ns: Namespaces = NS) -> DataFrame:
    """Old place notations and authority ids that are nodes of the spatial tree become that node.

    Only candidates are looked up; records without a hit are not touched at all.
    """
    items = df.select(id_col, F.posexplode(places).alias("_pos", "_value")).withColumn(
        "_candidate", spatial_candidate(F.col("_value"), ns)
    )
    known = tree_ids.select(F.col("id").alias("_node")).distinct()
    # An old notation is rewritten only if its node exists.
    hits = items.where("_candidate IS NOT NULL").join(known, F.col("_candidate") == F.col("_node")).select(
        F.col(id_col).alias("_rec"), F.struct(F.col("_value"), F.col("_candidate")).alias("_pair")
    )
    maps = hits.groupBy("_rec").agg(F.map_from_entries(F.array_distinct(F.collect_list("_pair"))).alias("_map"))
    joined = df.select(id_col, places).join(maps, F.col(id_col) == F.col("_rec"))
    new = F.transform(F.col(places), lambda v: F.coalesce(F.try_element_at("_map", v), v))
    return joined.select(id_col, F.array_distinct(new).alias(places))


def split_places(df: DataFrame, id_col: str, places: str, headings: str, ns: Namespaces = NS) -> DataFrame:
    """``_r30_ _2071807nX_``: the region stays a place, the rest becomes the first heading if it is new."""
    new_places = F.transform(F.col(places), lambda v: F.coalesce(region_of(v, ns), v))
    added = F.filter(F.transform(F.col(places), lambda v: heading_of_place(v, ns)), lambda v: v.isNotNull())
    return _places_to_headings(df, id_col, places, headings, new_places, added)


# Three places whose authority record was replaced by a node of the spatial tree.
REPLACED_PLACES = {"4680138-8": "4116352n7", "4108134-1": "4766893n3", "4028839-0": "4028836n5"}


def replace_places(df: DataFrame, id_col: str, places: str, headings: str, ns: Namespaces = NS, table: dict[str, str] = REPLACED_PLACES) -> DataFrame:
    """Replaced places; the old one becomes the first heading if it is new."""
    pairs = {ns.authority + old: ns.spatial + new for old, new in table.items()}
    known = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    new_places = F.transform(F.col(places), lambda v: F.coalesce(F.try_element_at(known, v), v))
    added = F.filter(F.col(places), lambda v: F.try_element_at(known, v).isNotNull())
    return _places_to_headings(df, id_col, places, headings, new_places, added)


def _places_to_headings(df: DataFrame, id_col: str, places: str, headings: str, new_places: Column, added: Column) -> DataFrame:
    old = F.coalesce(F.col(headings), F.array().cast("array<string>"))
    fresh = F.array_except(F.reverse(F.array_distinct(added)), old)
    rows = df.select(id_col, F.col(places).alias("_before"), new_places.alias("_after"), F.concat(fresh, old).alias(headings))
    return rows.where(~F.col("_before").eqNullSafe(F.col("_after"))).select(
        id_col, F.array_distinct("_after").alias(places), headings
    )


def wider_places(fields: DataFrame, ns: Namespaces = NS, replaced: dict[str, str] = REPLACED_PLACES) -> DataFrame:
    """Rows (place, broader) learned from title records that give both: input of ``broaden_places``.

    ``fields``: (rec_id, seq, tag, value). The first authority place and the first wider notation of a
    record make one row; repeated rows count once.
    """
    values = fields.where(F.col("tag").startswith("f31") & ~F.col("value").rlike("^_r(..)_$"))
    coded = r"^_r[0-9]{2}_ _([0-9]*)n([0-9]|X)_$"
    place = F.regexp_replace("value", coded, ns.authority + "$1-$2")
    place = F.regexp_replace(place, r"^_r[0-9]{2}_ _([0-9]*)_$", ns.authority + "$1")
    for old, new in replaced.items():
        place = F.when(place == ns.authority + old, ns.authority + new.replace("n", "-")).otherwise(place)
    wide = F.regexp_replace("value", r"^_r(96|99)_ _([0-9]*(n([0-9]|X)?))_$", ns.spatial + "$2")
    wide = F.when(~wide.rlike("^_r(96|99)_"), F.regexp_replace(wide, "^_r([0-9]{2})_ _.+_$", ns.spatial + "$1"))
    rows = values.select("rec_id", "seq", place.alias("place"), wide.alias("wide"))

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).startswith("http"), F.col("seq")))

    return (
        rows.groupBy("rec_id").agg(first("place").alias("place"), first("wide").alias("broader"))
        .where("place IS NOT NULL")
        .select("place", "broader")
        .distinct()
    )
