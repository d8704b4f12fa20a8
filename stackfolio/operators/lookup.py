"""Lookups and other joins.

No join carries a broadcast hint: adaptive execution broadcasts a lookup table whose real size is
small, and splits a skewed probe side otherwise. Lookup tables are (k, v) with one row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import rows_of


def unique_keys(table: DataFrame) -> DataFrame:
    """(k, v) with one row per key: the last by column ``o`` where there is one, else the greatest value."""
    return table.groupBy("k").agg((F.max_by("v", "o") if "o" in table.columns else F.max("v")).alias("v"))


def unique_rows(table: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """(key, values) with one row per key: the last by column ``o`` where there is one, else the greatest."""
    row = F.struct(*values)
    return table.groupBy(key).agg((F.max_by(row, "o") if "o" in table.columns else F.max(row)).alias("_row")).select(key, "_row.*")


def lookup(
    df: DataFrame, column: str, table: DataFrame, on_miss: str = "keep",
    default: str | None = None, out: str | None = None,
) -> DataFrame:
    """Replace a value by its mapped value. On a miss: ``keep`` it, ``delete`` it, or ``default``."""
    probe = unique_keys(table).select(F.col("k").alias("_k"), F.col("v").alias("_v"))
    hit = df.join(probe, F.col(column) == F.col("_k"), "left")
    miss = {"keep": F.col(column).cast("string"), "delete": F.lit(None), "default": F.lit(default)}[on_miss]
    # A value that is itself missing stays missing.
    value = F.when(F.col(column).isNotNull(), F.coalesce(F.col("_v"), miss))
    name = out or column
    kept = [c for c in df.columns if c != name]
    order = df.columns if name in df.columns else [*df.columns, name]
    return hit.select(*kept, value.alias(name)).select(*order)


def lookup_chain(
    df: DataFrame, column: str, steps: Sequence[tuple[DataFrame, Callable[[Column], Column]]],
    out: str | None = None,
) -> DataFrame:
    """Several tables in turn; each is probed with the (re-spelled) result of the one before."""
    name = out or column
    if name != column:
        df = df.withColumn(name, F.col(column))
    for table, spell in steps:
        df = lookup(df.withColumn(name, spell(F.col(name))), name, table)
    return df


def lookup_any(df: DataFrame, column: str, tables: Sequence[DataFrame], out: str) -> DataFrame:
    """First table that knows the value, NULL if none does."""
    for i, table in enumerate(tables):
        probe = unique_keys(table).select(F.col("k").alias(f"_k{i}"), F.col("v").alias(f"_v{i}"))
        df = df.join(probe, F.col(column) == F.col(f"_k{i}"), "left")
    value = F.coalesce(*[F.col(f"_v{i}") for i in range(len(tables))])
    return df.withColumn(out, value).drop(*[f"_{x}{i}" for i in range(len(tables)) for x in "kv"])


def lookup_array(
    df: DataFrame, id_col: str, array_col: str, table: DataFrame, on_miss: str = "keep",
    out: str | None = None,
) -> DataFrame:
    """Look up each list item; order and rows without items stay.

    Items are looked up in long form and come back to their record; ``id_col`` must be unique. The
    items of one record were one row before, so a group is never larger than a row was.
    """
    name = out or array_col
    items = rows_of(df, [id_col], array_col, "_item", "_pos")
    found = lookup(items, "_item", table, on_miss)
    lists = (
        found.where("_item IS NOT NULL")
        .groupBy(id_col)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_item"))).alias("_pairs"))
        .select(F.col(id_col).alias("_id"), F.transform("_pairs", lambda p: p["_item"]).alias("_list"))
    )
    joined = df.join(lists, F.col(id_col) == F.col("_id"), "left")
    kept = [c for c in df.columns if c != name]
    order = df.columns if name in df.columns else [*df.columns, name]
    empty = F.array().cast("array<string>")
    value = F.when(F.col(array_col).isNotNull(), F.coalesce("_list", empty))
    return joined.select(*kept, value.alias(name)).select(*order)


def lookup_wide(df: DataFrame, column: str, table: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Several values of one key in one join."""
    probe = unique_rows(table, key, values).withColumnRenamed(key, "_k")
    return df.join(probe, F.col(column) == F.col("_k"), "left").drop("_k")


def link_out(records: DataFrame, id_col: str, key_col: str, feeds: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Links to other sites from many feeds (k, url, name), in feed order, as ``same_as`` list.

    All feeds are one table and one join. The number of links per record is at most one per feed.
    """
    ranked = [
        feed.select("k", F.col("url").alias("id"), "name", F.lit(rank).alias("feed_rank"))
        for rank, (_, feed) in enumerate(feeds)
    ]
    table = reduce(DataFrame.unionByName, ranked)
    # The last row of a key wins within a feed, then one list per key.
    single = table.groupBy("k", "feed_rank").agg(F.max(F.struct("id", "name")).alias("link"))
    lists = single.groupBy("k").agg(
        F.array_sort(F.collect_list(F.struct("feed_rank", "link"))).alias("_links")
    )
    links = F.transform(
        F.coalesce("_links", F.array()),
        lambda x: F.struct(
            x["link"]["id"].alias("id"), F.struct(x["link"]["name"].alias("name")).alias("collection")
        ),
    )
    joined = records.join(lists.withColumnRenamed("k", "_k"), F.col(key_col) == F.col("_k"), "left")
    return joined.withColumn("same_as", F.when(F.col("_links").isNotNull(), links)).drop("_k", "_links")


def redirect_ids(df: DataFrame, column: str, old_new: DataFrame) -> DataFrame:
    """Outdated ids to their successors, one hop."""
    return lookup(df, column, old_new.toDF("k", "v"))


def keep_used(table: DataFrame, ids: DataFrame, key: str = "k", id_col: str = "id") -> DataFrame:
    used = ids.select(F.col(id_col).alias("_used"))
    return table.join(used, F.col(key) == F.col("_used"), "left_semi")


def missing_from(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    known = other.select(F.col(other_key or key).alias("_known"))
    return df.join(known, F.col(key) == F.col("_known"), "left_anti")


def merge_by_id(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two record sets into one row per id. Shared columns: the left value first."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    other = right.select(F.col(key).alias("_id"), *[F.col(c).alias(f"_r_{c}") for c in right.columns if c != key])
    joined = left.join(other, F.col(key) == F.col("_id"), "full_outer")
    out = [F.coalesce(F.col(key), F.col("_id")).alias(key)]
    out += [
        (F.coalesce(F.col(c), F.col(f"_r_{c}")) if c in shared else F.col(c)).alias(c)
        for c in left.columns if c != key
    ]
    out += [F.col(f"_r_{c}").alias(c) for c in right.columns if c != key and c not in shared]
    return joined.select(*out)


def merge_external(
    internal: DataFrame, external: DataFrame, key: str, from_external: Sequence[str] = (),
    drop_internal: Sequence[str] = ("type",), drop_external: Sequence[str] = ("described_by",),
) -> DataFrame:
    """Own record over a foreign base record.

    Lists: foreign items then own ones. Single values: the own value if there is one. ``from_external``
    always come from the foreign record. Own records without a foreign one stay as they are.
    """
    kinds = {f.name: f.dataType.typeName() for f in internal.schema.fields}
    base_columns = [c for c in external.columns if c != key and c not in drop_external]
    base = external.select(F.col(key).alias("_id"), *[F.col(c).alias(f"_e_{c}") for c in base_columns])
    joined = internal.join(base, F.col(key) == F.col("_id"), "left")
    found = F.col("_id").isNotNull()
    out = [F.col(key)]
    for name in dict.fromkeys([*base_columns, *[c for c in internal.columns if c != key]]):
        own = F.col(name) if name in internal.columns else None
        ext = F.col(f"_e_{name}") if name in base_columns else None
        if own is None:
            value = ext
        elif name in from_external:
            value = F.when(found, ext).otherwise(own) if ext is not None else own
        elif name in drop_internal:
            value = F.when(found, ext).otherwise(own) if ext is not None else F.when(~found, own)
        elif ext is None:
            value = own
        elif kinds[name] == "array":
            value = F.when(own.isNull(), ext).when(ext.isNull(), own).otherwise(F.concat(ext, own))
        else:
            value = F.coalesce(own, ext)
        out.append(value.alias(name))
    return joined.select(*out)


def self_label(df: DataFrame, ref_col: str, labels: DataFrame, id_col: str, label_col: str, out: str = "label") -> DataFrame:
    """Label of a reference into the same record set; the reference itself if there is none."""
    probe = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    joined = df.join(probe, F.col(ref_col) == F.col("_id"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_label"), F.col(ref_col).cast("string"))).drop("_id", "_label")


def alias_ids(df: DataFrame, rec_id: str, id_columns: Sequence[str]) -> DataFrame:
    """(alias_id, rec_id) for every id that a record has."""
    ids = F.array_distinct(F.filter(F.array(*[F.col(c).cast("string") for c in id_columns]), lambda v: v.isNotNull()))
    return df.select(F.explode(ids).alias("alias_id"), F.col(rec_id).alias("rec_id"))


def resolve_any_id(df: DataFrame, rec_id: str, id_columns: Sequence[str], ids: DataFrame, ask: str = "id") -> DataFrame:
    """(asked id, rec_id): a record is found by any of its ids."""
    return (
        ids.select(F.col(ask).cast("string").alias("asked"))
        .distinct()
        .join(alias_ids(df, rec_id, id_columns), F.col("asked") == F.col("alias_id"))
        .select("asked", "rec_id")
    )


def local_link(refs: DataFrame, url_col: str, resource_base: str, local_base: str, catalogue: DataFrame, remote: DataFrame) -> DataFrame:
    """Outgoing catalogue links become local ones when the record exists here.

    ``catalogue``: (rec_id) of the local set; ``remote``: (remote_id, local_id) of foreign records that
    name their local twin.
    """
    remote_id = F.regexp_extract(F.col(url_col), f"^{resource_base}([^#]+)", 1)
    asked = refs.withColumn("_ref", F.nullif(remote_id, F.lit("")))
    here = catalogue.select(F.col("rec_id").cast("string").alias("_here"))
    twin = remote.select(F.col("remote_id").cast("string").alias("_twin"), F.col("local_id").cast("string").alias("_local"))
    joined = asked.join(here, F.col("_ref") == F.col("_here"), "left").join(
        twin, F.col("_ref") == F.col("_twin"), "left"
    )
    target = F.coalesce("_here", "_local")
    return joined.withColumn(
        "link", F.coalesce(F.concat(F.lit(local_base), target), F.col(url_col))
    ).drop("_ref", "_here", "_twin", "_local")


def holding_links(items: DataFrame, item_col: str, templates: DataFrame, labels: DataFrame) -> DataFrame:
    """Item URI ``…items/<record>:<isil>:…`` → ISIL, record id, catalogue URL and library label.

    Label of ``DE-x-y`` when unknown: label of ``DE-x`` and the ISIL; else the ISIL itself.
    """
    inner = F.split(F.regexp_extract(item_col, r"items/(.+)$", 1), ":")
    parts = items.select(
        "*", F.get(inner, F.lit(0)).alias("record_id"), F.regexp_replace(F.get(inner, F.lit(1)), "#!$", "").alias("isil")
    )
    main = F.when(F.size(F.split("isil", "-")) == 3, F.regexp_extract("isil", r"^(.*)-[^-]*$", 1))
    own = labels.select(F.col("k").alias("_o"), F.col("v").alias("_ol"))
    up = labels.select(F.col("k").alias("_u"), F.col("v").alias("_ul"))
    site = templates.select(F.col("k").alias("_t"), F.col("v").alias("_template"))
    joined = (
        parts.withColumn("_main", main)
        .join(site, F.col("isil") == F.col("_t"), "left")
        .join(own, F.col("isil") == F.col("_o"), "left")
        .join(up, F.col("_main") == F.col("_u"), "left")
    )
    parent = F.concat(F.coalesce("_ul", "_main"), F.lit(": "), "isil")
    label = F.coalesce("_ol", F.when(F.col("_main").isNotNull(), parent), "isil")
    return joined.select(
        *items.columns, "record_id", "isil",
        F.replace("_template", F.lit("{id}"), F.col("record_id")).alias("url"),
        label.alias("library"),
    )


def crosswalk(ids: DataFrame, id_col: str, mapping: DataFrame) -> DataFrame:
    """Ids of one catalogue to ids of another, by a snapshot table (k, v); unknown ids are left out."""
    table = mapping.select(F.col("k").alias("_k"), F.col("v").alias("mapped_id"))
    return ids.join(table, F.col(id_col) == F.col("_k")).drop("_k")


def compare_outputs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Differences between two sets of the same records: (id, column, left_value, right_value)."""
    columns = [c for c in left.columns if c in right.columns and c != key]
    a = left.select(F.col(key).alias("_a"), *[F.col(c).cast("string").alias(f"_a_{c}") for c in columns])
    b = right.select(F.col(key).alias("_b"), *[F.col(c).cast("string").alias(f"_b_{c}") for c in columns])
    pairs = F.array(
        *[
            F.when(
                ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")),
                F.struct(F.lit(c).alias("column"), F.col(f"_a_{c}").alias("left_value"), F.col(f"_b_{c}").alias("right_value")),
            )
            for c in columns
        ]
    )
    joined = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    return joined.select(
        F.coalesce("_a", "_b").alias(key),
        F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("d"),
    ).select(key, "d.*")


def within_polygon(points: DataFrame, lat: str, lon: str, polygon: Sequence[tuple[float, float]]) -> DataFrame:
    """Points inside one search area given as (lat, lon) corners.

    The box comparison is pushed to the scan; the crossing test is plain arithmetic, so the filter
    stays in generated code and nothing is joined.
    """
    y, x = F.col(lat), F.col(lon)
    lats, lons = [p[0] for p in polygon], [p[1] for p in polygon]
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y1 == y2:
            continue
        hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (F.lit(x2 - x1) * (y - y1) / F.lit(y2 - y1) + x1))
        crossings = crossings + F.when(hit, 1).otherwise(0)
    return points.where(y.between(min(lats), max(lats)) & x.between(min(lons), max(lons))).where(crossings % 2 == 1)


def replace_notation(df: DataFrame, id_col: str, array_col: str, successors: DataFrame) -> DataFrame:
    """Outdated notations of a list to their successors; only records that really changed."""
    new = lookup_array(df.select(id_col, array_col), id_col, array_col, successors, out="_new")
    return new.where(~F.col("_new").eqNullSafe(F.col(array_col))).select(id_col, F.col("_new").alias(array_col))


def broaden_places(
    df: DataFrame, id_col: str, places: str, headings: str, broader: DataFrame,
    keep_as_heading: str, always_heading: Sequence[str] = (), extra: DataFrame | None = None,
) -> DataFrame:
    """Places to one or more broader notations (``a ; b``); changed records only.

    A place also becomes the first heading when one of its broader notations matches
    ``keep_as_heading``, or it is in ``always_heading`` or in ``extra``, unless it is a heading already.
    """
    items = rows_of(df, [id_col], places, "_place", "_pos")
    table = broader.select(F.col("k").alias("_k"), F.split("v", " ; ").alias("_broader"))
    hit = items.join(table, F.col("_place") == F.col("_k"), "left")
    if extra is not None:
        more = extra.select(F.col("k").alias("_x")).distinct()
        hit = hit.join(more, F.col("_place") == F.col("_x"), "left")
    else:
        hit = hit.withColumn("_x", F.lit(None).cast("string"))
    by_notation = F.exists("_broader", lambda b: b.rlike(f"^(?:{keep_as_heading})$"))
    known = F.col("_k").isNotNull()
    as_heading = (known & (F.coalesce(by_notation, F.lit(False)) | F.col("_place").isin(*always_heading))) | F.col("_x").isNotNull()
    grouped = hit.groupBy(id_col).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "_pos",
                    F.coalesce("_broader", F.array("_place")).alias("_new"),
                    F.when(as_heading, F.col("_place")).alias("_add"),
                )
            )
        ).alias("_rows"),
        F.max(known).alias("_changed"),
    ).where("_changed")
    new_places = F.array_distinct(F.flatten(F.transform("_rows", lambda r: r["_new"])))
    added = F.filter(F.transform("_rows", lambda r: r["_add"]), lambda v: v.isNotNull())
    changed = grouped.select(F.col(id_col).alias("_id"), new_places.alias("_places"), F.reverse(F.array_distinct(added)).alias("_added"))
    joined = df.join(changed, F.col(id_col) == F.col("_id"))
    old = F.coalesce(F.col(headings), F.array().cast("array<string>"))
    fresh = F.array_except("_added", old)
    return joined.select(id_col, F.col("_places").alias(places), F.concat(fresh, old).alias(headings))


def add_variants(agents: DataFrame, rec_id: str, idn: str, variants: DataFrame, excluded: str = "Spitzenorgan") -> DataFrame:
    """Variant names of agents from enrichment rows (rec_id, idn, pos, label, relation) of their record.

    One row per (agent, label) with the first position; rows of the excluded relation are no variants.
    Lists are not built here, so an agent may have any number of variants. (Inside one MARC row,
    ``plans.marc_agents`` does the same on arrays.)
    """
    usable = variants.where(~F.coalesce(F.col("relation") == excluded, F.lit(False)))
    once = usable.groupBy(F.col("rec_id").alias("_r"), F.col("idn").alias("_i"), F.col("label").alias("alt_label")).agg(
        F.min("pos").alias("variant_pos")
    )
    same = (F.col(rec_id) == F.col("_r")) & (F.col(idn) == F.col("_i"))
    return agents.join(once, same).drop("_r", "_i")


def link_scripts(fields: DataFrame) -> DataFrame:
    """Fields with a link ``880-nn`` joined to their twin in another script.

    ``fields``: (rec_id, tag, link, value), where ``link`` is subfield 6. The twin is a field 880 whose
    link is ``ttt-nn/code``. Result: (rec_id, tag, value, script, other_value).
    """
    twin = fields.where("tag = '880'").select(
        F.col("rec_id").alias("_r"),
        F.concat(F.lit("880-"), F.regexp_extract("link", r"^\d{3}-(\d{2})", 1)).alias("_key"),
        F.regexp_extract("link", r"^\d{3}-\d{2}/(.*)$", 1).alias("script"),
        F.col("value").alias("other_value"),
    )
    base = fields.where("tag <> '880' AND link IS NOT NULL")
    same = (F.col("rec_id") == F.col("_r")) & (F.regexp_extract("link", r"^(880-\d{2})", 1) == F.col("_key"))
    return base.join(twin, same).select("rec_id", "tag", "value", "script", "other_value")
