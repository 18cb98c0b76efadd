"""Schemas of the relational tables that a parse gives."""

from __future__ import annotations

SPAN = "struct<start: bigint, end: bigint>"
SEGMENT = "struct<start: bigint, end: bigint, padding: int>"

#: A row a node, in pre-order: a node's subtree is the rows from node_id up to subtree_end.
NODES = (
    "doc_id bigint, node_id int, parent_id int, subtree_end int, depth int, ord int, family string, type string, "
    "start bigint, end bigint, level int, kind string, marker string, padding int, tight boolean, spread boolean, "
    "checked boolean, email boolean, angle boolean, cjk boolean, trailing_newline boolean, align array<string>, "
    f"spans map<string, {SPAN}>, segments map<string, array<{SEGMENT}>>, lazy array<{SPAN}>"
)
BLANKS = "doc_id bigint, ord int, start bigint, end bigint, loosening boolean"
DIAGNOSTICS = "doc_id bigint, kind string, start bigint, end bigint, message string"
