"""HTML extraction by layout-aware rendering.

A small tree builder reads tags, comments and raw text, supplies implied end
tags (``p``, ``li``, ``dt``/``dd``, table parts, options, ...) and moves
stray table text before its table. Visibility rules hide what a page does not
show: head, scripts, styles and templates; ``hidden`` attributes; closed
``details`` and ``dialog``; what inline styles and style-sheet rules (tag,
class and id selectors with descendant and child combinators; not siblings,
attributes or pseudo-classes) say of ``display`` and ``visibility``, by
importance, specificity and order. Tags and text that may
not stand in head end it. All other text is emitted, laid
out as blocks with spacing, lists with markers and indents, preformatted text
as it stands, and table cells in aligned columns. A column is as wide as its
widest cell, unless that cell alone would fill the others with spaces far
beyond the column's text; what stands beside a line that is wider than its
column goes to the next line, so that columns stay aligned.

Edge cases: a null page renders to empty text; malformed or unclosed markup
never fails and costs one pass; elements nested deeper than ``MAX_DEPTH``
join their ancestor at that depth and keep their text; repeated rows each
give their own row; an empty table gives an empty result; further columns are
not read. Pages of any length are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketry.llm.words import slices

MAX_DEPTH = 256
#: Spaces that a column may be filled with: per line and per character of its text.
PAD_LINE = 128
PAD_TEXT = 4
MAX_SPAN = 1000
#: Answers on selectors and ancestors that are kept at a time.
MEMO = 500_000
INDENT_LEVELS = 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head title script style template link meta base iframe noembed noframes datalist rp object audio video canvas".split())
#: Blocks; those in SPACED have a blank line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table hr figure fieldset menu".split())
BLOCK = SPACED | frozenset("html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup "
                           "legend li main nav search section summary optgroup option caption xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd xmp".split())
#: What a start tag closes, and the elements beyond which it does not look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
SCOPE = frozenset("table td th caption html button object template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr colgroup".split())
SECTIONS = ("thead", "tbody", "tfoot")

NEXT = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|([!?/]))")
ATTR = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)?(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")
#: What may stand in head, and in a noscript there; anything else ends head.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
IN_HEAD_NOSCRIPT = frozenset("basefont bgsound link meta noframes style".split())
HTML_SPACE = " \t\n\r\f"
#: Values that a declaration must have to count; the global ones go for all.
GLOBAL = frozenset("inherit initial unset revert revert-layer".split())
VALUES = {
    "display": GLOBAL | frozenset("none contents block inline inline-block flow flow-root list-item run-in flex inline-flex grid inline-grid math ruby "
                                  "ruby-base ruby-text table inline-table table-row table-cell table-column table-caption table-row-group "
                                  "table-header-group table-footer-group table-column-group -webkit-box -webkit-inline-box -webkit-flex "
                                  "-webkit-inline-flex".split()),
    "visibility": GLOBAL | {"visible", "hidden", "collapse"},
    "content-visibility": GLOBAL | {"visible", "hidden", "auto"},
}
SELECTOR = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][\w-]+)*)$", re.I)
COMBINATOR = re.compile(r"(\s*>\s*|\s+)")


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None = None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up


# ---- tree -------------------------------------------------------------------

def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on and the position after the tag's end."""
    attrs: dict[str, str] = {}
    n = len(page)
    while at < n and page[at] != ">":
        m = ATTR.match(page, at)
        if m.end() == at:
            at += 1  # a stray quote or equals sign
            continue
        at = m.end()
        if m[1]:
            value = next((g for g in m.groups()[1:] if g is not None), "")
            attrs.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return attrs, at + 1


def build(page: str) -> Node:
    root = Node("#root", {})
    stack = [root]

    def leave_head() -> None:
        if stack[-1].tag == "noscript" and stack[-2].tag == "head":
            stack.pop()
        if stack[-1].tag == "head":
            stack.pop()

    def text(data: str) -> None:
        if not data:
            return
        if stack[-1].tag in ("head", "noscript") and data.strip(HTML_SPACE):
            leave_head()
        if stack[-1].tag in TABLE_PARTS and data.strip():
            k = max(i for i, x in enumerate(stack) if x.tag == "table") if any(x.tag == "table" for x in stack) else 0
            if k:  # stray table text goes before its table
                stack[k - 1].kids.insert(len(stack[k - 1].kids) - 1, data)
                return
        stack[-1].kids.append(data)

    def close(tags: set, stop: frozenset | set) -> None:
        """Close up to the outermost open element of ``tags`` within ``stop``."""
        found = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stop:
                break
            if stack[i].tag in tags:
                found = i
        if found:
            del stack[found:]

    def open_(tag: str, attrs: dict[str, str]) -> None:
        if tag not in (IN_HEAD_NOSCRIPT if stack[-1].tag == "noscript" else IN_HEAD):
            leave_head()
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", *SECTIONS):
            open_("tr", {})
        node = Node(tag, attrs, stack[-1])
        stack[-1].kids.append(node)
        if tag not in VOID and len(stack) < MAX_DEPTH:
            stack.append(node)

    at, n = 0, len(page)
    while at < n:
        m = NEXT.search(page, at)
        if m is None:
            text(_unescape(page[at:]))
            break
        text(_unescape(page[at:m.start()]))
        if m[3]:  # comment
            if page.startswith(("<!-->", "<!--->"), m.start()):
                at = page.index(">", m.start()) + 1
                continue
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
        elif m[4]:  # doctype, processing instruction or bogus end tag
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
        else:
            tag = m[2].lower()
            attrs, at = _attributes(page, m.end())
            if at > n:
                break  # the page ends within a tag
            if not m[1]:
                open_(tag, attrs)
                if tag in RAW and stack[-1].tag == tag:
                    end = _raw_end(page, tag, at)
                    data = page[at:end]
                    stack[-1].kids.append(html.unescape(data) if tag in ("textarea", "title") else data)
                    stack.pop()
                    at = n if end == n else page.find(">", end) + 1 or n
                elif tag == "plaintext":
                    stack[-1].kids.append(page[at:])
                    at = n
            elif tag == "br":
                leave_head()
                stack[-1].kids.append(Node("br", {}))
            elif tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].kids.append(Node("p", {}, stack[-1]))
            else:
                _end_tag(stack, tag)
    return root


def _raw_end(page: str, tag: str, at: int) -> int:
    m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
    return m.start() if m else len(page)


def _unescape(data: str) -> str:
    return html.unescape(data) if "&" in data else data


def _end_tag(stack: list[Node], tag: str) -> None:
    """Close the nearest open element of that name; inline end tags do not
    close blocks, and nothing closes across a table cell but table parts."""
    walls = {"table"} if tag in TABLE_PARTS or tag in ("td", "th", "caption") else {"table", "td", "th", "caption"}
    for i in range(len(stack) - 1, 0, -1):
        open_tag = stack[i].tag
        if open_tag == tag:
            del stack[i:]
            return
        if open_tag in walls or (tag not in BLOCK and tag not in TABLE_PARTS and tag not in ("td", "th") and open_tag in BLOCK):
            return


# ---- visibility -------------------------------------------------------------

Compound = tuple[str, frozenset, frozenset]  # tag (or none), classes, ids
#: Chains of parents and children from the element itself outwards, each chain from its innermost compound.
Selector = list[list[Compound]]
Rule = tuple[Selector, tuple, dict]


def _declared(body: str) -> dict[str, tuple[bool, str]]:
    """(important, value) of the declarations of ``VALUES`` that win within a block."""
    out: dict[str, tuple[bool, str]] = {}
    for part in body.lower().split(";"):
        name, _, value = part.partition(":")
        name = name.strip()
        if name in VALUES:
            value, _, mark = value.partition("!")
            words, important = value.split(), mark.strip() == "important"
            if words and VALUES[name].issuperset(words) and important >= out.get(name, (False, ""))[0]:
                out[name] = (important, "none" if "none" in words else words[0])
    return out


def visibility_rules(root: Node) -> dict[str, list[Rule]]:
    """Style-sheet rules on visibility as (selector, (specificity, position),
    declarations), by one id, class or tag that their element needs."""
    out: dict[str, list[Rule]] = {}
    todo, n = [root], 0
    while todo:
        node = todo.pop()
        if isinstance(node, Node):
            if node.tag == "style":
                for selector, marks, declared in _rules("".join(k for k in node.kids if isinstance(k, str))):
                    n += 1
                    tag, classes, ids = selector[0][0]
                    key = f"#{min(ids)}" if ids else f".{min(classes)}" if classes else tag or "*"
                    out.setdefault(key, []).append((selector, (*marks, n), declared))
            todo.extend(reversed(node.kids))
    return out


def _selector(text: str) -> tuple[Selector, tuple[int, int, int]] | None:
    """A selector and its specificity; None if it is of a kind that is not read."""
    parts = COMBINATOR.split(text)
    chains: Selector = [[]]
    n_ids = n_classes = n_tags = 0
    for part in reversed(parts):
        if not part.strip():
            chains.append([])
            continue
        if part.strip() == ">":
            continue
        m = SELECTOR.match(part)
        if not m or not m[0]:
            return None
        marks = re.findall(r"([.#])([\w-]+)", m[2])
        classes, ids = (frozenset(x for k, x in marks if k == kind) for kind in ".#")
        tag = "" if m[1] in (None, "*") else m[1].lower()
        n_ids, n_classes, n_tags = n_ids + sum(k == "#" for k, _ in marks), n_classes + sum(k == "." for k, _ in marks), n_tags + bool(tag)
        chains[-1].append((tag, classes, ids))
    return (chains, (n_ids, n_classes, n_tags)) if all(chains) else None


def _is(node: Node, compound: Compound) -> bool:
    tag, classes, ids = compound
    if node.tag == "#root":  # stands for the html and body that a page leaves out
        return tag in ("html", "body") and not classes and not ids
    return (not tag or tag == node.tag) and (not classes or classes <= set(node.attrs.get("class", "").split())) and (not ids or ids <= {node.attrs.get("id", "")})


def _chain(node: Node | None, chain: list[Compound]) -> Node | None:
    """The outermost element of a chain of parents that starts at ``node``."""
    for k, compound in enumerate(chain):
        if k:
            node = node.up
        if node is None or not _is(node, compound):
            return None
    return node


def _within(selector: Selector, k: int, node: Node | None, memo: dict) -> bool:
    """Whether the chains from the k-th on fit ``node`` and what is above it."""
    if k == len(selector):
        return True
    if node is None:
        return False
    key = (id(selector), k, id(node))
    known = memo.get(key)
    if known is None:
        top = _chain(node, selector[k])
        known = (top is not None and _within(selector, k + 1, top.up, memo)) or _within(selector, k, node.up, memo)
        if len(memo) >= MEMO:
            memo.clear()
        memo[key] = known
    return known


def _selects(selector: Selector, node: Node, memo: dict) -> bool:
    top = _chain(node, selector[0])
    return top is not None and _within(selector, 1, top.up, memo)


def _rules(sheet: str) -> list[Rule]:
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)
    out, at = [], 0
    while (brace := sheet.find("{", at)) >= 0:
        selectors = sheet[at:brace].rpartition(";")[2].strip()
        if selectors.startswith("@"):  # conditional rules do not count; skip the block
            depth, at = 1, brace + 1
            for m in re.compile("[{}]").finditer(sheet, at):
                depth += 1 if m[0] == "{" else -1
                at = m.end()
                if not depth:
                    break
            else:
                break
            continue
        end = sheet.find("}", brace)
        declared = _declared(sheet[brace + 1:end if end >= 0 else len(sheet)])
        if declared:
            for s in selectors.split(","):
                read = _selector(s.strip())
                if read:
                    out.append((*read, declared))
        if end < 0:
            break
        at = end + 1
    return out


def _shown(node: Node, seen: bool, rules: dict[str, list[Rule]], memo: dict) -> tuple[bool, bool]:
    """(takes part in layout, its own text is visible): of each property the
    important, inline, more specific, later declaration counts."""
    attrs, tag = node.attrs, node.tag
    if tag in HIDDEN or (tag == "input" and attrs.get("type", "").lower() == "hidden"):
        return False, False
    best: dict[str, tuple[tuple, str]] = {}

    def offer(declared: dict[str, tuple[bool, str]], inline: bool, rank: tuple) -> None:
        for name, (important, value) in declared.items():
            if name not in best or (important, inline, rank) >= best[name][0]:
                best[name] = ((important, inline, rank), value)

    if rules:
        classes, name = set(attrs.get("class", "").split()), attrs.get("id", "")
        for key in (tag, "*", f"#{name}", *(f".{c}" for c in classes)):
            for selector, rank, declared in rules.get(key, ()):
                if _selects(selector, node, memo):
                    offer(declared, False, rank)
    if attrs.get("style"):
        offer(_declared(attrs["style"]), True, ())
    value = {name: v for name, (_, v) in best.items()}
    display = value.get("display", "revert")
    if display.startswith("revert"):  # what the browser's own sheet says
        display = "none" if "hidden" in attrs or (tag == "dialog" and "open" not in attrs) else "inline"
    until_found = attrs.get("hidden", "").strip().lower() == "until-found"
    if display == "none" or value.get("content-visibility") == "hidden" or until_found:
        return False, False
    own = value.get("visibility")
    if own in ("hidden", "collapse"):
        return True, False
    return True, seen or own in ("visible", "initial")


# ---- layout -----------------------------------------------------------------

class Box:
    """Lines of text under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # blank lines owed before the next text
        self.levels = 0
        self.marker = ""
        self.space = False

    def put(self, data: str, keep: bool) -> None:
        if keep:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self._add(first)
            for part in rest:
                self.lines.append("".join(self.line).rstrip())
                self.line = []
                self._add(part, owed=False)
            return
        words = SPACE.sub(" ", data)
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        if (self.space or words[0] == " ") and self.line:
            self.line.append(" ")
        self.space = words[-1] == " "
        self._add(words.strip(" "))

    def _add(self, data: str, owed: bool = True) -> None:
        if not data:
            return
        if not self.line:
            if owed and self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            indent = "  " * min(INDENT_LEVELS, self.levels)
            self.line.append(indent[:max(0, len(indent) - len(self.marker))] + self.marker if self.marker else indent)
            self.marker = ""
        self.line.append(data)

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        if self.marker:
            self._add(" ")
        self.end_line()
        return self.lines


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def lines(self) -> list[str]:
        """Rows with their cells in columns, two spaces apart."""
        taken: dict[int, int] = {}  # column: rows that a cell from above still fills
        grid: list[list[tuple[int, int, list[str]]]] = []
        sizes: dict[int, list[int]] = {}  # column: widths of the lines of its own cells
        spans: dict[tuple[int, int], int] = {}  # (columns across, first column): widest line
        for row in self.rows:
            placed, col = [], 0
            for text, across, down in row:
                while taken.get(col, 0) > 0:
                    col += 1
                placed.append((col, across, text))
                for c in range(col, col + across):
                    if down > 1:
                        taken[c] = down
                if across == 1:
                    sizes.setdefault(col, []).extend(map(len, text))
                elif text:
                    spans[across, col] = max(spans.get((across, col), 0), *map(len, text))
                col += across
            grid.append(placed)
            taken = {c: n - 1 for c, n in taken.items() if n > 1}
        width = {c: _column_width(w) for c, w in sizes.items()}
        for (across, col), wide in sorted(spans.items()):
            used = [width[c] for c in range(col, col + across) if width.get(c)]
            more = wide - sum(used) - 2 * max(0, len(used) - 1)
            if more > 0:  # the last column takes what the others lack
                c = col + across - 1
                more -= 0 if width.get(c) or not used else 2
                if more * len(grid) <= PAD_LINE * len(grid) + PAD_TEXT * wide:
                    width[c] = width.get(c, 0) + max(0, more)
        last = max((p[-1][0] + p[-1][1] for p in grid if p), default=0)
        start, x = [], 0
        for c in range(last + 1):
            start.append(x)
            x += width[c] + 2 if width.get(c) else 0
        out = []
        for placed in grid:
            for k in range(max((len(t) for _, _, t in placed), default=0)):
                line = ""
                for col, _, text in placed:
                    if k < len(text) and text[k]:
                        if line and len(line) + 2 > start[col]:
                            out.append(line.rstrip())
                            line = ""
                        line = line.ljust(start[col]) + text[k]
                out.append(line.rstrip())
        return out


def _column_width(sizes: list[int]) -> int:
    """The widest line to which the others can be filled within the bound."""
    sizes = sorted(sizes)
    most, filled, width = PAD_LINE * len(sizes) + PAD_TEXT * sum(sizes), 0, 0
    for n, size in enumerate(sizes):
        filled += n * (size - width)
        if filled > most:
            break
        width = size
    return width


def _number(value: str | None, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", value or "")
    return int(m[1]) if m else default


def render(page: str) -> str:
    """The visible text of a page."""
    root = build(page)
    rules = visibility_rules(root)
    memo: dict = {}
    boxes, tables, lists = [Box()], [], []
    # A stack of (node or text, its text is visible, preformatted, leave function).
    todo: list = [(root, True, False, None)]
    while todo:
        node, seen, pre, leave = todo.pop()
        if leave is not None:
            leave()
            continue
        box = boxes[-1]
        if isinstance(node, str):
            if seen:
                box.put(node, pre)
            continue
        shown, seen = _shown(node, seen, rules, memo)
        if not shown:
            continue
        tag = node.tag
        pre = pre or tag in ("pre", "textarea", "xmp", "plaintext") or "white-space:pre" in node.attrs.get("style", "").replace(" ", "").lower()
        after = None
        if tag == "br":
            if box.line:
                box.end_line()
            elif box.lines:
                box.gap += 1
            continue
        if tag == "input":
            if seen and node.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                box.put(" " + node.attrs.get("value", "") + " ", False)
            continue
        if tag == "table":
            box.block(1)
            tables.append(Table())

            def after(box: Box = box) -> None:
                for line in tables.pop().lines():
                    if line:
                        box.put(line, True)
                    box.end_line()
                box.block(1)
        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag in ("td", "th") and tables:
            boxes.append(Box())

            def after(table: Table = tables[-1], attrs: dict = node.attrs) -> None:
                across = min(MAX_SPAN, max(1, _number(attrs.get("colspan"), 1)))
                down = min(MAX_SPAN, max(1, _number(attrs.get("rowspan"), 1)))
                if not table.rows:
                    table.rows.append([])
                table.rows[-1].append((boxes.pop().done(), across, down))
        elif tag == "caption" and tables:
            box.block(0)
            after = box.end_line
        elif tag in ("ul", "ol", "menu"):
            box.block(0 if lists and box.levels else 1)
            step = -1 if "reversed" in node.attrs else 1
            lists.append([tag, _number(node.attrs.get("start"), 1 if step > 0 else sum(isinstance(k, Node) and k.tag == "li" for k in node.kids)), step])
            box.levels += 1

            def after(box: Box = box) -> None:
                lists.pop()
                box.levels -= 1
                box.block(0 if lists and box.levels else 1)
        elif tag == "li":
            box.block(0)
            if lists and lists[-1][0] == "ol":
                lists[-1][1] = _number(node.attrs.get("value"), lists[-1][1])
                box.marker = f"{lists[-1][1]}. "
                lists[-1][1] += lists[-1][2]
            else:
                box.marker = "- "

            def after(box: Box = box) -> None:
                box.end_line()
                box.marker = ""
        elif tag == "dd":
            box.block(0)
            box.levels += 1

            def after(box: Box = box) -> None:
                box.end_line()
                box.levels -= 1
        elif tag in BLOCK:
            gap = 1 if tag in SPACED else 0
            box.block(gap)
            after = lambda box=box, gap=gap: box.block(gap)
        kids = node.kids
        if tag == "details" and "open" not in node.attrs:
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        elif pre and tag == "pre" and kids and isinstance(kids[0], str) and kids[0].startswith("\n"):
            kids = [kids[0][1:], *kids[1:]]
        if after is not None:
            todo.append((None, seen, pre, after))
        todo.extend((k, seen, pre, None) for k in reversed(kids))
    lines = boxes[0].done()
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col, text, n_chars`` for every row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = [render(p) if p else "" for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["id", "text", "n_chars"])

    out = rows.mapInArrow(work, f"id {rows.schema[0].dataType.simpleString()}, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), "text", "n_chars")
