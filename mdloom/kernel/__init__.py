"""The parse of one document."""

from __future__ import annotations

from .blocks import Blocks
from .constructs import Constructs
from .inlines import Inlines
from .tree import Node


def parse(source: bytes, constructs: Constructs | None = None, inlines: bool | frozenset[str] = True) -> tuple[Node, Blocks]:
    """The tree of a document, and the block parser with its blank lines and labels; ``inlines`` may name the blocks whose insides are parsed."""
    constructs = constructs or Constructs.markdown()
    blocks = Blocks(source, constructs)
    root = blocks.parse()
    if inlines:
        todo = [root]
        while todo:
            node = todo.pop()
            lines = node.segments.get("text")
            if lines is not None:
                if inlines is True or node.type in inlines:
                    node.kids = Inlines(source, lines, constructs, blocks.labels, blocks.footnotes).nodes()
            else:
                todo += node.kids
    return root, blocks
