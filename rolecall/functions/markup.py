"""Elements of HTML pages by simple selectors, in one pass over each page, in Arrow batches."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without content, and those that an opening tag of the same row closes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "p": {"p"}}
_WITHIN = {"tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "li": {"ul", "ol"}, "option": {"select"}, "dt": {"dl"}, "dd": {"dl"}, "p": {"div", "td", "li", "article", "section"}}


class Pick(NamedTuple):
    """A field: of the first element that ``selector`` fits, an attribute, or its whole text. ``pieces``: each piece of text is trimmed before they are joined."""

    selector: str
    attribute: str = ""
    pieces: bool = True


class _Step(NamedTuple):
    """One part of a selector: ``tag.class#id``, of which any may be missing."""

    tag: str
    needs: tuple[tuple[str, str], ...]

    def fits(self, tag: str, attributes: dict[str, str]) -> bool:
        return self.tag in ("", tag) and all(v in attributes.get(k, "").split() if k == "class" else attributes.get(k) == v for k, v in self.needs)


def _steps(selector: str) -> tuple[_Step, ...]:
    return tuple(
        _Step(re.match(r"[\w-]*", part)[0].lower(), tuple(("class" if sign == "." else "id", name) for sign, name in re.findall(r"([.#])([\w-]+)", part)))
        for part in selector.split()
    )


class _Open(NamedTuple):
    tag: str
    attributes: dict[str, str]
    texts: list
    items: list


class _Picker(HTMLParser):
    """Collects the items of a page: for each element that ``item`` fits, the text or attribute of each field's first element in it."""

    def __init__(self, item: tuple[_Step, ...], fields: dict[str, tuple[Pick, tuple[_Step, ...]]]):
        super().__init__(convert_charrefs=True)
        self.item, self.fields = item, fields
        self.stack: list[_Open] = []
        self.found: list[dict[str, str]] = []

    def _fits(self, steps: tuple[_Step, ...], above: int) -> bool:
        """Whether the last open element fits the last step, and its ancestors down to place ``above`` the others, in order."""
        k = len(self.stack) - 1
        if not steps[-1].fits(self.stack[k].tag, self.stack[k].attributes):
            return False
        left = list(steps[:-1])
        while left and (k := k - 1) >= above:
            if left[-1].fits(self.stack[k].tag, self.stack[k].attributes):
                left.pop()
        return not left

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.stack and self.stack[-1].tag in _CLOSES.get(tag, ()):
            self.stack.pop()
        self._close_within(tag)
        given = {k: v or "" for k, v in reversed(attrs)}
        over = self.stack[-1] if self.stack else _Open("", {}, [], [])
        self.stack.append(_Open(tag, given, list(over.texts), list(over.items)))
        here = self.stack[-1]
        for start, values in here.items:
            for name, (pick, steps) in self.fields.items():
                if name not in values and self._fits(steps, start):
                    values[name] = given.get(pick.attribute, "") if pick.attribute else []
                    if not pick.attribute:
                        here.texts.append((values[name], pick.pieces))
        if self._fits(self.item, 0):
            values: dict = {name: given.get(pick.attribute, "") for name, (pick, _) in self.fields.items() if pick.selector == "" and pick.attribute}
            self.found.append(values)
            here.items.append((len(self.stack), values))
        if tag in _VOID:
            self.stack.pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _close_within(self, tag: str) -> None:
        """Closes what an opening ``tag`` ends further out, as a row does the open cell with all in it."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag in _WITHIN.get(tag, (self.stack[k].tag,)):
                return
            if self.stack[k].tag in _CLOSES[tag]:
                del self.stack[k:]

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return

    def handle_data(self, data: str) -> None:
        for texts, pieces in self.stack[-1].texts if self.stack else ():
            texts.append(data.strip() if pieces else data)

    def result(self) -> str:
        return json.dumps([{k: v if isinstance(v, str) else "".join(v) for k, v in values.items()} for values in self.found])


def pick(html: Column, item: str, fields: dict[str, Pick]) -> Column:
    """A JSON array with an object for each element that ``item`` fits, in order; null for a null page.

    Selectors are ``tag``, ``.class`` and ``#id`` in any combination, and blanks between
    an ancestor's and its descendant's. A field that no element has is left out of the
    object. References in texts and attributes are resolved; of repeated attributes
    the first counts; rows, cells and list items may lack their end tags.
    """
    wanted, steps = {name: (p, _steps(p.selector) if p.selector else (_Step("\0", ()),)) for name, p in fields.items()}, _steps(item)

    @F.pandas_udf("string")
    def picked(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            if page is None:
                out.append(None)
                continue
            parser = _Picker(steps, wanted)
            parser.feed(page)
            parser.close()
            out.append(parser.result())
        return pd.Series(out, dtype=object)

    return picked(html)
