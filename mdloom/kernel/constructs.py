"""Which constructs a parse recognises."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Constructs:
    """Switches of the grammar; the defaults are those for general Markdown."""

    autolink: bool = True
    code_indented: bool = True
    html_flow: bool = True
    html_text: bool = True
    gfm_autolink_literal: bool = True
    gfm_footnote: bool = True
    gfm_strikethrough: bool = True
    gfm_strikethrough_single_tilde: bool = False
    gfm_table: bool = True
    gfm_task_list_item: bool = True
    math_flow: bool = True
    math_text: bool = True
    math_text_single_dollar: bool = False
    liquid: bool = True
    wiki_link: bool = True
    container_directive: bool = True

    @staticmethod
    def markdown() -> Constructs:
        return Constructs()

    @staticmethod
    def gfm() -> Constructs:
        return replace(Constructs(), math_flow=False, math_text=False, liquid=False, wiki_link=False, container_directive=False)

    @staticmethod
    def commonmark() -> Constructs:
        off = {f.name: False for f in fields(Constructs) if f.name.startswith("gfm_")}
        return replace(Constructs.gfm(), **off)

    @staticmethod
    def mdx() -> Constructs:
        raise NotImplementedError("MDX is not supported")
