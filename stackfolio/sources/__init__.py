from .lookups import (
    inline_lookup, parse_beacon, parse_lookup, parse_skos, read_beacon, read_communes_csv,
    read_lookup, read_register_csv, read_skos, register_entries, skos_labels, unread_skos,
)
from .marcxml import marc_fields, parse_marcxml, read_marcxml, to_marcxml
from .records import mine_ids, parse_ndjson, read_ndjson, select_entity
from .tagged import decode_tagged, read_lines, read_tagged, rejected_lines, split_volumes, tagged_line

__all__ = [
    "decode_tagged", "inline_lookup", "marc_fields", "mine_ids", "parse_beacon", "parse_lookup",
    "parse_marcxml", "parse_ndjson", "parse_skos", "read_beacon", "read_communes_csv", "read_lines",
    "read_lookup", "read_marcxml", "read_ndjson", "read_register_csv", "read_skos", "read_tagged",
    "register_entries", "rejected_lines", "select_entity", "skos_labels", "split_volumes",
    "tagged_line", "to_marcxml", "unread_skos",
]
