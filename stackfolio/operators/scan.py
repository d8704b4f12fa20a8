"""Ordered work over groups of any size: numbering, running values, neighbours.

A window per group would pull a group that holds a third of all rows into one task. Here a group with
more than ``CHUNK_ROWS`` rows and more than one in ``CUTS`` of all rows is cut into ``CUTS`` chunks: a
sketch of its order (a sorted sample of bounded size) gives the bounds once, and a row's chunk is an
expression of its order columns. Each chunk is worked on alone, and one row per chunk carries the values
over chunk borders. There are fewer than ``CUTS`` such groups, so the bounds (a struct per chunk) and
the borders (a row per chunk) may be broadcast: less than ``CUTS`` squared of each, whatever the table.

All is one plan: the rows are exchanged once, nothing is written, and no job runs while it is built.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_ROWS = 1 << 20
CUTS = 512
SAMPLE = 16 * CUTS  # rows of a group that give its bounds, about
CHUNK, GROUP, PLACE = "_chunk", "_group", "_place"
EXACT = (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.DecimalType)


def order_place(df: DataFrame, order: Sequence[Column]) -> Column:
    """A struct that rises as the sort order does; it ends before a column that cannot be turned round."""
    column = type(F.lit(0))
    parts = []
    for c in order:
        node = c._jc.node()
        if node.getClass().getSimpleName() != "SortOrder":
            node = F.asc(c)._jc.node()
        value = column(df.sparkSession._jvm.org.apache.spark.sql.Column(node.child()))
        falling = "Descending" in node.sortDirection().toString()
        kind = df.select(value).schema[0].dataType
        if falling and not isinstance(kind, EXACT):
            break
        if falling and isinstance(kind, T.DateType):
            value = F.unix_date(value)
        elif falling and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = F.unix_micros(value.cast("timestamp"))
        elif falling and isinstance(kind, T.BooleanType):
            value = value.cast("int")
        if falling:
            value = -value if isinstance(kind, T.DecimalType) else F.bitwise_not(value)
        last = "NullsLast" in node.nullOrdering().toString()
        parts += [value.isNull() if last else value.isNotNull(), value]
    return F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]) if parts else F.struct(F.lit(0).alias("p0"))


def _same(keys: Sequence[str], side: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{side}{i}")) for i, k in enumerate(keys)])


def _bounds(df: DataFrame, keys: Sequence[str], chunk_rows: int) -> DataFrame:
    """The groups to be cut: their keys (_h0, …), a number, and the places where chunks begin."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    enough = F.greatest(F.lit(chunk_rows), sizes.agg(F.sum("_n")).scalar() / CUTS)
    large = sizes.where(F.col("_n") > enough).select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], "_n")
    if keys:
        large = large.withColumn(GROUP, F.row_number().over(Window.orderBy(*[f"_h{i}" for i in range(len(keys))])))
        rows = df.join(F.broadcast(large), _same(keys, "_h"))
    else:
        rows = df.withColumn("_n", large.select("_n").scalar()).where("_n IS NOT NULL").withColumn(GROUP, F.lit(1))
    few = F.pmod(F.xxhash64(PLACE), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("_n")
    names = [f"_h{i}" for i in range(len(keys))]
    sample = rows.where(few).groupBy(*names, GROUP).agg(F.sort_array(F.collect_list(PLACE)).alias("_all"))
    step = F.ceil(F.size("_all") / CUTS)
    return sample.select(*names, GROUP, F.filter("_all", lambda _, i: (i > 0) & (i % step == 0)).alias("_bounds"))


def _chunk_of(bounds: Column, place: Column) -> Column:
    """How many bounds are not behind the place: a binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(CUTS.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= place, at + step).otherwise(at))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    number: str | None = None,
    count: str | None = None,
    sums: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ordered values per group. ``order`` must be total within a group.

    ``number``: 1, 2, …; ``count``: size of the group; ``sums``/``lasts``: {new column: column} running
    sum / last value that is not NULL, the current row included; ``previous``/``following``: value of
    the row before / after. Groups of up to ``chunk_rows`` rows are not cut.
    """
    keys, sums, lasts = list(keys), sums or {}, lasts or {}
    previous, following = previous or {}, following or {}
    rows = df.withColumn(PLACE, order_place(df, order))
    bounds = _bounds(rows, keys, chunk_rows)
    numbered = F.col(GROUP).cast("long") * (2 * CUTS) + _chunk_of(F.col("_bounds"), F.col(PLACE))
    chunk = F.when(F.col(GROUP).isNotNull(), numbered).otherwise(F.lit(0)).alias(CHUNK)
    if keys:
        marked = rows.join(F.broadcast(bounds), _same(keys, "_h"), "left")
        cut = rows.join(F.broadcast(bounds), _same(keys, "_h"))
    else:
        marked = rows.withColumn("_bounds", bounds.select("_bounds").scalar()).withColumn(GROUP, F.lit(1))
        marked = marked.withColumn(GROUP, F.when(F.col("_bounds").isNotNull(), F.col(GROUP)))
        cut = marked.where(F.col("_bounds").isNotNull())
    parts = [CHUNK, *keys]
    within = Window.partitionBy(*parts).orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def worked(placed: DataFrame) -> DataFrame:
        """Values inside the chunks."""
        local = placed.withColumn("_n", F.row_number().over(within))
        for out, name in sums.items():
            local = local.withColumn(f"_s_{out}", F.sum(name).over(running))
        for out, name in lasts.items():
            local = local.withColumn(f"_l_{out}", F.last(name, ignorenulls=True).over(running))
        return local

    local = worked(marked.select(*df.columns, chunk))
    for out, name in previous.items():
        local = local.withColumn(f"_p_{out}", F.lag(name).over(within))
    for out, name in following.items():
        local = local.withColumn(f"_f_{out}", F.lead(name).over(within))
    if following or count:
        local = local.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*parts)))

    # one row for each chunk of the groups that are cut; then what comes before and behind it
    place = F.col("_n")
    ends = [F.count(F.lit(1)).alias("_rows")]
    ends += [F.sum(name).alias(f"_cs_{out}") for out, name in sums.items()]
    ends += [F.max_by(f"_l_{out}", place).alias(f"_cl_{out}") for out in lasts]
    ends += [F.max_by(name, place).alias(f"_cp_{out}") for out, name in previous.items()]
    ends += [F.min_by(name, place).alias(f"_cf_{out}") for out, name in following.items()]
    borders = worked(cut.select(*df.columns, GROUP, chunk)).groupBy(*parts, GROUP).agg(*ends)
    across = Window.partitionBy(GROUP)
    ordered = across.orderBy(CHUNK)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum("_rows").over(before).alias("_before"), F.sum("_rows").over(across).alias("_total")]
    carried += [F.sum(f"_cs_{out}").over(before).alias(f"_cs_{out}") for out in sums]
    carried += [F.last(f"_cl_{out}", ignorenulls=True).over(before).alias(f"_cl_{out}") for out in lasts]
    carried += [F.lag(f"_cp_{out}").over(ordered).alias(f"_cp_{out}") for out in previous]
    carried += [F.lead(f"_cf_{out}").over(ordered).alias(f"_cf_{out}") for out in following]
    offsets = borders.select(F.col(CHUNK).alias("_at"), *carried)
    joined = local.join(F.broadcast(offsets), F.col(CHUNK) == F.col("_at"), "left")

    out = [F.col(c) for c in df.columns]
    if number:
        out.append((F.coalesce("_before", F.lit(0)) + F.col("_n")).cast("bigint").alias(number))
    if count:
        out.append(F.coalesce("_total", "_size").cast("bigint").alias(count))
    for name in sums:
        total = F.coalesce(F.col(f"_cs_{name}"), F.lit(0)) + F.coalesce(F.col(f"_s_{name}"), F.lit(0))
        out.append(total.alias(name))
    for name in lasts:
        out.append(F.coalesce(f"_l_{name}", f"_cl_{name}").alias(name))
    for name in previous:
        out.append(F.when(F.col("_n") == 1, F.col(f"_cp_{name}")).otherwise(F.col(f"_p_{name}")).alias(name))
    for name in following:
        out.append(
            F.when(F.col("_n") == F.col("_size"), F.col(f"_cf_{name}")).otherwise(F.col(f"_f_{name}")).alias(name)
        )
    return joined.select(*out)


def volume_number(fields: DataFrame, key: str, order: str, is_start: Column, out: str = "volume") -> DataFrame:
    """Running number of the current volume within a record of a long field table."""
    marked = fields.withColumn("_start", F.when(is_start, 1).otherwise(0))
    return scan(marked, [key], [F.col(order)], sums={out: "_start"}).drop("_start")


def parent_title(fields: DataFrame, key: str, order: str, title: Column, out: str = "parent_title") -> DataFrame:
    """Last title seen so far within a record of a long field table."""
    marked = fields.withColumn("_title", title)
    return scan(marked, [key], [F.col(order)], lasts={out: "_title"}).drop("_title")


def neighbours(hits: DataFrame, keys: Sequence[str], order: Sequence[Column], id_col: str) -> DataFrame:
    """Previous and next hit, position and number of hits of each query or user."""
    return scan(
        hits, keys, order, number="position", count="total",
        previous={"prev_id": id_col}, following={"next_id": id_col},
    )


def batch_number(df: DataFrame, order: Sequence[Column], size: int = 1000) -> DataFrame:
    """Consecutive batches of ``size`` records over the whole table."""
    numbered = scan(df, [], order, number="row_no")
    return numbered.withColumn("batch", F.floor((F.col("row_no") - 1) / size).cast("bigint"))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Position in sort order as a column."""
    return scan(df, keys, order, number=out)


def latest_per_id(log: DataFrame, id_col: str, version: Column, keep: Sequence[str] | None = None) -> DataFrame:
    """Newest row per id, rows without id dropped. One partial-combining aggregate, no window."""
    rest = [c for c in (keep or log.columns) if c != id_col]
    newest = F.max_by(F.struct(*rest), version).alias("_row")
    return (
        log.where(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(newest)
        .select(id_col, "_row.*")
    )


def first_event_only(events: Column, **info: Column) -> Column:
    """Put fields into the first event of a list only; the others stay as they are."""
    def set_fields(event: Column, place: Column) -> Column:
        for name, value in info.items():
            event = event.withField(name, F.when(place == 0, value).otherwise(event[name]))
        return event

    return F.transform(events, set_fields)
