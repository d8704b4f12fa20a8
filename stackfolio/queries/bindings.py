"""Library-shaped records derived from the input tables. Every derivation is row by row."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREE = "http://example.org/tree#"


def text(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def concepts(t) -> DataFrame:
    """Concept tree region → nation → customer: (id, pref_label, broader, notation)."""
    def level(df: DataFrame, letter: str, key: str, label: str, up: Column) -> DataFrame:
        return df.select(
            text(TREE + letter, key).alias("id"), F.col(label).alias("pref_label"), up.alias("broader"),
            text(letter, key).alias("notation"),
        )

    return (
        level(t.region, "r", "r_regionkey", "r_name", F.lit(None).cast("string"))
        .unionByName(level(t.nation, "n", "n_nationkey", "n_name", text(TREE + "r", "n_regionkey")))
        .unionByName(level(t.customer, "c", "c_custkey", "c_name", text(TREE + "n", "c_nationkey")))
    )


def isbn12(key: Column) -> Column:
    return F.concat(F.lit("978"), F.lpad(key.cast("string"), 9, "0"))


class MarcField(NamedTuple):
    """A data field of a made MARC record: SQL expressions of its subfields, and when it is there."""

    tag: str
    indicators: str
    subs: tuple[tuple[str, str], ...]
    when: str | None

    def struct(self) -> str:
        """NULL subfields are left out later, the field when ``when`` fails."""
        pairs = ", ".join(f"named_struct('code', '{code}', 'value', {value})" for code, value in self.subs)
        field = f"named_struct('tag', '{self.tag}', 'ind1', '{self.indicators[0]}', 'ind2', '{self.indicators[1]}', 'subs', array({pairs}))"
        return f"CASE WHEN {self.when} THEN {field} END" if self.when else field


def _field(tag: str, indicators: str, *subs: tuple[str, str], when: str | None = None) -> MarcField:
    return MarcField(tag, indicators, subs, when)


# Fields of the MARC record of an order: u is the first letter of the priority, s the status, c the
# customer, k the order, y the year.
MARC_FIELDS = [
    _field("016", "7 ", ("a", "concat('1', k, '- X')"), ("2", "'DE-600'"), when="s = 'F'"),
    _field("020", "  ", ("a", "concat('978-', lpad(k, 9, '0'), '-0')"), when="s = 'O'"),
    _field("022", "  ", ("a", "concat('1234-', lpad(c, 4, '0'))"), when="s = 'F'"),
    _field("024", "7 ", ("a", "concat('10.1/', k)"), ("2", "'doi'"), when="u = '1'"),
    _field("035", "  ", ("a", "concat('(OCoLC)', k)")),
    _field("035", "  ", ("a", "concat('(DE-605)HT', k)")),
    _field("041", "  ", ("a", "'fre'"), ("a", "'mul'"), when="u = '2'"),
    _field("082", "0 ", ("a", "concat(u, '00')"), ("2", "'22'")),
    _field("084", "  ", ("a", "concat('A', u)"), ("2", "'rvk'")),
    _field("084", "  ", ("a", "concat('place_99_o', u, '_')")),
    _field("084", "  ", ("a", "concat('NP ', u, '600')"), ("2", "'rvk'"), when="s = 'F'"),
    _field("100", "1 ", ("a", "concat('Customer ', c, ', A.')"), ("d", "concat('v43-', u)"), ("0", "concat('(DE-588)11', c, 'x')"), ("0", "concat('(DE-101)', c)")),
    _field("245", "10", ("6", "'880-01'"), ("a", "concat('Order <', p, '> & more /')"), ("b", "concat('status ', s, ' /')"), ("c", "concat('by ', c)"),
           ("n", "IF(s = 'P', concat('Vol. ', u), NULL)"), ("p", "IF(s <> 'O', 'A part.', NULL)")),
    _field("246", "1 ", ("a", "concat('Also <<', k, '>>')"), when="s = 'P'"),
    _field("250", "  ", ("a", "concat(u, '. ed. /')")),
    _field("264", " 1", ("a", "concat('[Town ', u, '] :')"), ("b", "concat('Firm ', c, ',')"), ("c", "concat('[', y, ']')")),
    _field("264", "31", ("a", "'Current'"), ("c", "concat('ca. ', y, '-')"), when="s = 'F'"),
    _field("300", "  ", ("a", "concat(u, ' Seiten :')"), ("b", "'Ill. ;'"), ("c", "'21 cm'"), ("e", "IF(u = '5', '1 CD', NULL)")),
    _field("490", "0 ", ("a", "concat('Series ', u)"), ("v", "concat(u, ' ;')"), when="s = 'O'"),
    _field("500", "  ", ("a", "concat('Note ', u)")),
    _field("500", "  ", ("a", "concat('In: Journal ', u)"), when="u = '3'"),
    _field("520", "  ", ("a", "concat('<p>About ', p, '</p>')")),
    _field("533", "  ", ("a", "'Online'"), ("b", "'Place'"), ("c", "'Agency,'"), ("d", "'2001-2004'"), when="u = '4'"),
    _field("540", "  ", ("u", "'http://creativecommons.org/licenses/by/4.0'"), when="u = '1'"),
    _field("600", "14", ("a", "concat('Free ', u)"), ("x", "'Sub'")),
    _field("650", " 0", ("a", "concat('Loc ', u)")),
    _field("650", " 7", ("a", "concat('Fast ', u)"), ("2", "'fast'"), when="u = '2'"),
    _field("650", " 7", ("a", "concat('Topic ', u)"), ("0", "concat('(DE-588)4', c, '-1')"), ("B", "concat('GND-', c)")),
    _field("655", " 7", ("a", "CASE u WHEN '1' THEN 'Festschrift' WHEN '2' THEN 'CD' WHEN '3' THEN 'Website' ELSE 'Statistik' END")),
    _field("689", "00", ("a", "'Mainz'"), ("D", "'g'"), ("0", "concat('(DE-588)4036-', u)")),
    _field("689", "01", ("a", "concat('Person ', c)"), ("b", "'II.'"), ("D", "'p'"), ("d", "'1850-1912'")),
    _field("689", "10", ("a", "concat('Event ', u)"), ("n", "'2'"), ("c", "'Trier'"), ("D", "'f'"), when="s = 'P'"),
    _field("700", "1 ", ("a", "concat('Helper ', c)"), ("e", "CASE u WHEN '1' THEN 'Herausgeber' WHEN '2' THEN 'Übersetzer' WHEN '3' THEN 'unklar' END")),
    _field("710", "2 ", ("a", "concat('Body ', c)"), ("b", "'Unit'"), ("4", "'isb'"), ("4", "'pbl'")),
    _field("711", "2 ", ("a", "'Congress'"), ("n", "u"), ("d", "y"), ("c", "'Trier'"), when="s = 'P'"),
    _field("773", "08", ("i", "'Enthalten in'"), ("t", "concat('Host <<', u, '>>')"), ("w", "concat('(DE-603)', c)"), ("q", "concat('1', u, '.')"), when="s = 'P'"),
    _field("776", "08", ("i", "'Erscheint auch als Online'"), ("t", "'Other'"), ("z", "concat('978-', lpad(k, 9, '0'), '-0')"), when="s = 'O'"),
    _field("780", "00", ("t", "concat('Vorg. ---> Old ', u)"), ("w", "concat('(DE-600)', c)"), when="s = 'F'"),
    _field("830", " 0", ("a", "concat('Traced ', u)"), ("w", "concat('(DE-605)HT', c)"), ("v", "u"), when="s = 'O'"),
    _field("856", "40", ("u", "concat('http://example.org/o/', k)"), ("3", "CASE u WHEN '1' THEN 'Inhaltsverzeichnis' WHEN '2' THEN 'Volltext' WHEN '3' THEN 'Inhaltstext' END"),
           ("x", "CASE u WHEN '4' THEN 'Verlag' WHEN '5' THEN 'EZB' END"), ("z", "IF(u = '4', 'kostenfrei', NULL)"), ("7", "IF(u = '1', '0', NULL)")),
    _field("880", "10", ("6", "'245-01/(N'"), ("a", "concat('Kyr ', u)")),
    _field("912", "  ", ("a", "CASE u WHEN '1' THEN 'ZDB-30-PQE' WHEN '2' THEN 'ZDB-OERSI' WHEN '3' THEN 'vd18' ELSE 'ZDB-x' END")),
    _field("924", "  ", ("b", "IF(s = 'P', 'DE-36', 'DE-77')"), ("g", "concat('K ', c, '/', y)")),
    _field("GGN", "  ", ("B", "concat('GND-', c)"), ("a", "concat('Variant <<', u, '>>')")),
    _field("GPN", "  ", ("B", "concat('GND-', c)"), ("a", "concat('Other Name ', c)"), ("c", "'Dr.'")),
    _field("GSI", "  ", ("B", "concat('GND-', c)"), ("a", "concat('0000-', c)"), ("2", "'orcid'"), when="s = 'O'"),
    _field("GST", "  ", ("B", "concat('GND-', c)"), ("a", "'Top'"), ("i", "'Spitzenorgan'")),
]
MARC_008 = (
    "concat(date_format(o_orderdate, 'yyMMdd'), IF(s = 'F', 'c', 's'), y, IF(s = 'F', '9999', '    '), 'gw ', "
    "IF(s = 'F', IF(u = '2', 'm', 'u'), '#'), '  ', IF(s = 'F', 'p', ' '), ' ', IF(u = '3', 'o', ' '), IF(u = '4', 'b', ' '), '   ', "
    "' ', IF(u = '5', '1', '0'), '0 0  ', CASE WHEN s = 'P' THEN 'und' WHEN u = '1' THEN 'eng' ELSE 'ger' END, '  ')"
)


# every subfield of every made record, one row each
MARC_SUBFIELDS = """
f AS (
  SELECT 'o' || o_orderkey AS rec_id, CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS s, o_orderpriority AS p,
    substring(o_orderpriority, 1, 1) AS u, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders
), subfields AS (SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT rec_id, '{f.tag}' AS tag, '{code}' AS code, {value} AS value FROM f WHERE {f.when or 'true'}"
    for f in MARC_FIELDS for code, value in f.subs
) + ") WHERE value IS NOT NULL)"


def marc_rows(t) -> DataFrame:
    """One MARC record per order: (rec_id, leader, control, data)."""
    orders = t.wide("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    base = orders.selectExpr(
        "cast(o_orderkey AS string) AS k", "cast(o_custkey AS string) AS c", "o_orderstatus AS s", "o_orderpriority AS p",
        "substring(o_orderpriority, 1, 1) AS u", "cast(year(o_orderdate) AS string) AS y", "o_orderdate",
    )
    return base.selectExpr(
        "concat('o', k) AS rec_id",
        "concat('00000n', CASE s WHEN 'O' THEN 'am' WHEN 'F' THEN 'as' ELSE 'em' END, ' a2200000 c', IF(u = '1', 'a', ' '), '4500') AS leader",
        "array(named_struct('tag', '001', 'value', concat('o', k)), named_struct('tag', '007', 'value', IF(u = '2', 'ss foo', 'tu')), "
        f"named_struct('tag', '008', 'value', {MARC_008})) AS control",
        f"transform(filter(array({', '.join(f.struct() for f in MARC_FIELDS)}), f -> f IS NOT NULL), f -> named_struct('tag', f.tag, 'ind1', f.ind1, 'ind2', f.ind2, "
        "'subs', filter(f.subs, x -> x.value IS NOT NULL))) AS data",
    )
