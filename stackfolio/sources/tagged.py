"""Tagged legacy export: one line is one record, ``[/]`` divides it into four-character tag + value.

A line is split inside its own row, volumes included, so decoding needs no shuffle and no window,
however many volumes a record has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import rows_of

NONSORT = "¬"
NO_ID = "Can't get ID from input"
BROKEN = "Segment without tag"


def read_lines(spark: SparkSession, path: str, charset: str = "IBM437") -> DataFrame:
    """Text lines of a legacy charset. The text source stays splittable; bytes are decoded after it."""
    lines = spark.read.text(path)
    if charset.upper() in ("UTF-8", "UTF8"):
        return lines
    return lines.select(_decoded(F.col("value").cast("binary"), charset).alias("value"))


def _decoded(value: Column, charset: str) -> Column:
    """Text of bytes. A charset of single bytes is read as Latin-1 and translated by its table of 256
    characters; others must be known to Spark's ``decode``."""
    table = bytes(range(256)).decode(charset, "replace")
    if len(table) != 256:
        return F.decode(value, charset)
    pairs = [(chr(code), letter) for code, letter in enumerate(table) if chr(code) != letter]
    source, target = ("".join(side) for side in zip(*pairs)) if pairs else ("", "")
    return F.translate(F.decode(value, "ISO-8859-1"), source, target)


def _segments(line: Column) -> Column:
    return F.filter(F.split(line, r"\[/\]"), lambda s: s != "")


def checked_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines → (source, line, rec_id, problem); ``problem`` is NULL for a good record."""
    clean = lines.select(F.col(column).alias("source"), F.replace(F.col(column), F.lit(NONSORT), F.lit("")).alias("line"))
    # Split once; the steps below read the parts.
    cells = clean.select("source", "line", F.split("line", r"\[/\]").alias("cells"))
    head = F.trim(F.get("cells", F.lit(1)))
    problem = F.when(~F.coalesce(head.startswith("#00 "), F.lit(False)), NO_ID).when(
        F.exists("cells", lambda s: (s != "") & (F.length(s) < 4)), BROKEN
    )
    return cells.select("source", "line", F.substr(head, F.lit(5)).alias("rec_id"), problem.alias("problem"))


def rejected_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are no record, with the reason."""
    return checked_lines(lines, column).where("problem IS NOT NULL").select("source", "problem")


def _explode(records: DataFrame) -> DataFrame:
    """(rec_id, segments) → (rec_id, seq, tag, value)."""
    rows = rows_of(records, ["rec_id"], "segments", "segment", "pos")
    name = F.substring("segment", 1, 4)
    tag = F.regexp_replace(
        F.regexp_replace(name, "#([^ ]{2}) ", "f$1_"), "#([^ ]{3})", "f$1"
    )
    return rows.select(
        "rec_id",
        (F.col("pos") + 1).alias("seq"),
        tag.alias("tag"),
        F.substr("segment", F.lit(5)).alias("value"),
    )


def decode_tagged(lines: DataFrame, column: str = "value", volumes: bool = True) -> DataFrame:
    """Lines → fields (rec_id, seq, tag, value); multi-volume lines give one record per volume."""
    checked = checked_lines(lines, column)
    if volumes:
        return _explode(split_volumes(checked))
    return _explode(checked.select("rec_id", F.when(F.col("problem").isNull(), _segments(F.col("line"))).alias("segments")))


def read_tagged(spark: SparkSession, path: str, charset: str = "IBM437") -> DataFrame:
    return decode_tagged(read_lines(spark, path, charset))


def split_volumes(records: DataFrame) -> DataFrame:
    """``checked_lines`` → (rec_id, segments), one row per good record or volume.

    The title before the volume marker ``#36 sm`` is carried to each following ``#01 `` volume. Lines
    with a problem give no row: their list of pieces is NULL. (A filter would be pushed below the
    checks, which would then be done twice.)
    """
    framed = F.concat(F.regexp_replace("line", r"(\[/\])+$", ""), F.lit("[/]"))
    mark = F.locate("[/]#36 sm[/]", F.col("framed"))
    head = F.when(F.col("mark") > 0, F.expr("substring(framed, 1, mark - 1)")).otherwise(F.col("framed"))
    tail = F.when(F.col("mark") > 0, F.expr("substring(framed, mark + 3)"))
    titles = F.filter("head_segments", lambda s: s.startswith("#20 "))
    parts = (
        records.select("rec_id", "problem", framed.alias("framed"))
        .select("rec_id", "problem", "framed", mark.alias("mark"))
        .select(
            "rec_id",
            _segments(head).alias("head_segments"),
            F.when(
                F.col("problem").isNull(), F.split(F.coalesce(tail, F.lit("")), r"\[/\](?=#01 )")
            ).alias("pieces"),
            F.col("framed").contains("#36 sbd").alias("has_volume_type"),
            F.col("framed").contains("#88 ").alias("is_periodical"),
        )
        .select(
            "*",
            F.substr(F.try_element_at(titles, F.lit(-1)), F.lit(5)).alias("parent_title"),
            (F.size("pieces") > 1).alias("has_volumes"),
        )
    )
    kept = ["rec_id", "head_segments", "has_volume_type", "is_periodical", "parent_title", "has_volumes"]
    parts = rows_of(parts, kept, "pieces", "piece", "n")
    piece = _segments(F.col("piece"))
    kind = F.when(
        F.col("has_volumes") & F.col("has_volume_type"),
        F.array(F.when(F.col("is_periodical"), "#36tPeriodical").otherwise("#36tMultiVolumeBook")),
    ).otherwise(F.array().cast("array<string>"))
    volume_id = F.concat("rec_id", F.lit("b"), "n")
    label = F.substr(F.get(piece, F.lit(0)), F.lit(5))
    opening = F.array(
        F.concat(F.lit("#00 "), volume_id),
        F.concat(F.lit("#20u"), "parent_title"),
        F.concat(F.lit("#20 "), "parent_title", F.lit(" : "), label),
    )
    return parts.select(
        F.when(F.col("n") == 0, F.col("rec_id")).otherwise(volume_id).alias("rec_id"),
        F.when(F.col("n") == 0, F.concat("head_segments", piece, kind))
        .otherwise(F.concat(opening, piece))
        .alias("segments"),
    ).select("rec_id", F.filter("segments", lambda s: s.isNotNull()).alias("segments"))


def tagged_line(rec_id: Column, *segments: Column) -> Column:
    """Compose a line from tag+value columns; missing segments are left out."""
    return F.concat(
        F.lit("[/]"), F.concat_ws("[/]", F.concat(F.lit("#00 "), rec_id), *segments), F.lit("[/]")
    )
