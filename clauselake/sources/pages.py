"""Web pages as blocks, by a table function that is joined laterally: headings, texts and table grids."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags whose content is no text, and tags that end a block of text.
HIDDEN = ("script", "style", "noscript", "template", "head")
BREAKS = ("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form header hr html legend li main nav ol option p pre section select summary ul h1 h2 h3 h4 h5 h6").split()
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: A cell covers at most so many rows and columns, whatever its page says.
MOST_SPAN = 1000
_CELLS = "array<struct<text:string,row:int,col:int,rowspan:int,colspan:int>>"
BLOCKS = f"idx int, kind string, level int, text string, n_rows int, n_cols int, cells {_CELLS}"


def _span(value: str | None) -> int:
    return min(MOST_SPAN, max(1, int(value))) if value and value.strip().isdecimal() else 1


def place(rows: list[list[tuple[str, int, int]]]) -> tuple[int, list[tuple[str, int, int, int, int]]]:
    """(columns, cells (text, row, col, rowspan, colspan)): each cell at the first free place of its row.

    A cell reaches no further down than the table does.
    """
    taken: dict[int, set[int]] = {}
    cells = []
    for r, row in enumerate(rows):
        at = 0
        for text, down, across in row:
            down = min(down, len(rows) - r)
            while at in taken.get(r, ()):
                at += 1
            cells.append((text, r, at, down, across))
            for below in range(r, r + down):
                taken.setdefault(below, set()).update(range(at, at + across))
            at += across
        taken.pop(r, None)
    return max((c + across for _, _, c, _, across in cells), default=0), cells


class _Blocks(HTMLParser):
    """Collects (kind, level, text, rows) in reading order; a table within a cell is text of that cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int | None, str, list | None]] = []
        self._said: list[str] = []
        self._level: int | None = None
        self._hidden: list[str] = []
        self._tables = 0
        self._rows: list[list[tuple[str, int, int]]] = []
        self._cell: list | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self._said).split())
        self._said = []
        if text:
            self.found.append(("heading" if self._level else "text", self._level, text, None))

    def _end_cell(self) -> None:
        if self._cell is not None:
            said, down, across = self._cell
            self._rows[-1].append((" ".join("".join(said).split()), down, across))
            self._cell = None

    def _end_table(self) -> None:
        self._end_cell()
        self._tables = 0
        self.found.append(("table", None, "", self._rows))
        self._rows = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body" and "head" in self._hidden:  # a head that was not closed
            self._hidden = []
        if self._hidden or tag in HIDDEN:
            if tag in HIDDEN:
                self._hidden.append(tag)
            return
        if tag == "table":
            if not self._tables:
                self._flush()
            self._tables += 1
        elif self._tables == 1 and tag == "tr":
            self._end_cell()
            self._rows.append([])
        elif self._tables == 1 and tag in ("td", "th"):
            self._end_cell()
            if not self._rows:
                self._rows.append([])
            spans = dict(attrs)
            self._cell = [[], _span(spans.get("rowspan")), _span(spans.get("colspan"))]
        elif self._cell is not None:
            self._cell[0].append(" ")
        elif not self._tables and tag in BREAKS:
            self._flush()
            self._level = int(tag[1]) if tag in HEADINGS else None

    def handle_endtag(self, tag: str) -> None:
        if self._hidden:
            if tag in self._hidden:
                del self._hidden[self._hidden.index(tag) :]
        elif tag == "table" and self._tables:
            self._tables -= 1
            if not self._tables:
                self._end_table()
        elif self._tables == 1 and tag in ("td", "th", "tr"):
            self._end_cell()
        elif self._cell is not None:
            self._cell[0].append(" ")
        elif not self._tables and tag in BREAKS:
            self._flush()
            self._level = None

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            if self._cell is not None:
                self._cell[0].append(data)
            elif not self._tables:
                self._said.append(data)

    def done(self) -> list[tuple[str, int | None, str, list | None]]:
        self.close()
        if self._tables:
            self._end_table()
        self._flush()
        return self.found


@F.udtf(returnType=BLOCKS, useArrow=True)
class PageBlocks:
    """One row for each block of a page."""

    def eval(self, html: str) -> Iterator[tuple]:
        if html is None:
            return
        parser = _Blocks()
        parser.feed(html)
        for idx, (kind, level, text, rows) in enumerate(parser.done()):
            if rows is None:
                yield idx, kind, level, text, None, None, None
            else:
                n_cols, cells = place(rows)
                yield idx, kind, None, "", len(rows), n_cols, [dict(zip(("text", "row", "col", "rowspan", "colspan"), c, strict=True)) for c in cells]


def page_blocks(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without their HTML, with a row for each block: idx, kind (heading, text, table), level, text, n_rows, n_cols, cells.

    White space is made single spaces; scripts, styles and heads are left out. Inline tags
    part no text. Cells that are not closed end where the next one begins, and tables where
    the page ends; a table inside a cell is that cell's text. Null pages have no rows.
    """
    return pages.lateralJoin(PageBlocks(F.col(html_col).outer())).drop(html_col)
