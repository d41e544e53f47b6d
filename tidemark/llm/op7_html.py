"""Text of web pages as a reader sees it.

A page's tags build a tree, with the end tags that HTML lets authors leave out; what is not shown (head,
scripts, elements hidden by an attribute, their style, or a rule of the page's own style sheets that names them by
element, class, id or attribute, alone or within, in or behind others, and holds on a screen) is left out. The tree is then laid out: blocks on lines of their own, paragraphs
and headings with an empty line around them, list items with their marks and indents, table rows on a line
with cells aligned in columns, preformatted text as it is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas datalist noembed noframes title".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address form li dt dd figcaption details summary legend center dialog tr td th caption thead tbody tfoot".split())
#: Laid out on lines of their own, though they may stand in a paragraph.
LINES = frozenset("option optgroup text".split())
#: What can stand in a head; anything else ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: What isn't shown within an element of another language.
WITHIN = {"svg": frozenset("defs desc metadata symbol clippath mask pattern marker".split()), "math": frozenset("annotation annotation-xml".split())}
_SECTIONS = frozenset("thead tbody tfoot".split())
#: What a start tag closes, and the elements beyond which it closes nothing.
_CELL, _ROW = frozenset(("td", "th")), frozenset(("tr",))
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (_CELL, frozenset(("table",)) | _ROW), "th": (_CELL, frozenset(("table",)) | _ROW), "tr": (_CELL | _ROW, frozenset(("table",))), "option": (frozenset(("option",)), frozenset(("select",))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (_CELL | _ROW | frozenset(("thead", "tbody", "tfoot")), frozenset(("table",)))),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_CSS = re.compile(r"@(?P<at>[\w-]+)(?P<condition>[^{};]*)(?P<opens>[;{])|(?P<selectors>[^{}@;]+)\{(?P<body>[^{}]*)\}|(?P<closes>\})")
_ONE = re.compile(r"(?:[\w-]+|\*)?(?:[.#][\w-]+|\[[\w-]+(?:=(?:\"[^\"]*\"|'[^']*'|[\w-]+))?\])*")
_HAS = re.compile(r"\[([\w-]+)(=)?[\"']?([^\"'\]]*)[\"']?\]")
_BETWEEN = re.compile(r"(\s*[>+]\s*|\s+)")
#: The screen that media rules are judged by, in pixels.
SCREEN = {"width": 1280.0, "height": 720.0}
_SIZE = re.compile(r"(min|max)-(width|height)\s*:\s*([\d.]+)(px|em|rem)?")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)", re.I)
#: Inputs whose value a reader sees.
_TYPED = frozenset(("", "text", "search", "url", "tel", "email", "number", "date", "time", "month", "week", "datetime-local", "submit", "button", "reset"))
_BUTTONS = frozenset(("submit", "button", "reset"))
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "gone", "inner", "name", "veil")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.inner = name, attrs, []
        #: Not there with all that is in it; veil: True or False if it says whether it can be seen, else as its parent.
        self.gone = name in UNSEEN or (name == "dialog" and "open" not in attrs) or "hidden" in attrs
        self.veil: bool | None = None


def _declared(style: str) -> dict[str, str]:
    return {k.lower(): v.lower() for k, v in _DECLARED.findall(style)}


def _on_screen(condition: str) -> bool:
    """Whether one of a media rule's queries holds on the screen; one with a feature that isn't known doesn't."""

    def feature(text: str) -> bool:
        if m := _SIZE.fullmatch(text):
            size = float(m[3]) * (1 if m[4] in (None, "px") else 16) if m[3].count(".") < 2 and m[3] != "." else 0.0
            return SCREEN[m[2]] >= size if m[1] == "min" else SCREEN[m[2]] <= size
        return re.sub(r"\s", "", text) in ("orientation:landscape", "prefers-color-scheme:light", "color", "hover:hover", "hover", "pointer:fine")

    def one(text: str) -> bool:
        named = re.match(r"(?:(not|only)\s+)?([a-z]+)?", text)
        holds = named[2] in (None, "all", "screen") and all(map(feature, map(str.strip, re.findall(r"\(([^()]*)\)", text))))
        return holds != (named[1] == "not")

    return any(one(q.strip()) for q in condition.lower().split(","))


def _rules(sheets: list[str]) -> list[tuple]:
    """(weight, steps, what is declared) of each selector that counts; later ones win.

    A step: (element, classes, ids, attributes, how it stands to the step before: "" for the first, " " within, ">" in, "+" behind).
    """
    out = []
    for sheet in sheets:
        counts = [True]
        for m in _CSS.finditer(_COMMENT.sub("", sheet)):
            if m["opens"] == "{":
                kind, condition = m["at"].lower(), m["condition"].strip()
                inner = _on_screen(condition) if kind == "media" else kind == "layer" or (kind == "supports" and not condition.lower().startswith("not"))
                counts.append(counts[-1] and inner)
            elif m["closes"]:
                counts = counts[:-1] or [True]
                counts[0] = True
            elif m["selectors"] and counts[-1] and (found := _declared(m["body"])):
                out += [(*one, found) for one in map(_steps, m["selectors"].split(",")) if one]
    return sorted(out, key=lambda r: r[0])


def _steps(selector: str) -> tuple | None:
    parts = _BETWEEN.split(selector.strip())
    if not all(one and _ONE.fullmatch(one) for one in parts[::2]):
        return None
    steps, weight = [], (0, 0, 0)
    for one, how in zip(parts[::2], ["", *(p.strip() or " " for p in parts[1::2])], strict=True):
        has = frozenset((k.lower(), v if eq else None) for k, eq, v in _HAS.findall(one))
        bare = re.sub(r"\[[^\]]*\]", "", one)
        classes, ids = (frozenset(re.findall(rf"{mark}([\w-]+)", bare)) for mark in (r"\.", "#"))
        name = re.match(r"[\w-]*", bare)[0].lower()
        steps.append((name, classes, ids, has, how))
        weight = tuple(a + b for a, b in zip(weight, (len(ids), len(classes) + len(has), bool(name)), strict=True))
    return weight, tuple(steps)


def _met(rules: list[tuple], node: Node, above: frozenset, parent: frozenset, left: frozenset) -> tuple[frozenset, dict[str, str]]:
    """The steps (rule, step) that end at an element, and what the rules that do declare.

    above, parent, left: steps that end at any element around it, at the one it is in, at the one before it. So a page costs its
    elements times its rules' steps, however deep it is.
    """
    a, met, found = node.attrs, set(), {}
    own = frozenset(a.get("class", "").split())
    for r, (_, steps, says) in enumerate(rules):
        for i, (name, classes, ids, has, how) in enumerate(steps):
            if how and (r, i - 1) not in (above if how == " " else parent if how == ">" else left):
                continue
            if name in ("", node.name) and classes <= own and ids <= {a.get("id")} and all(k in a and v in (None, a[k]) for k, v in has):
                if i + 1 < len(steps):
                    met.add((r, i))
                else:
                    found.update(says)
    return frozenset(met), found


def _styled(root: Node, sheets: list[str]) -> None:
    """Sets gone and veil of each element by style sheets and its own style."""
    rules, none = _rules(sheets), frozenset()
    met = _style(rules, root, none, none, none)
    work = [(root, met, met)]
    while work:
        node, above, parent = work.pop()
        left = none
        for x in node.inner:
            if isinstance(x, Node):
                left = _style(rules, x, above, parent, left)
                work.append((x, above if left <= above else above | left, left))


def _style(rules: list[tuple], node: Node, above: frozenset, parent: frozenset, left: frozenset) -> frozenset:
    met, found = _met(rules, node, above, parent, left) if rules else (frozenset(), {})
    if "style" in node.attrs:
        found = found | _declared(node.attrs["style"])
    node.gone = node.gone or found.get("display") == "none"
    if "visibility" in found:
        node.veil = {"hidden": True, "collapse": True, "visible": False}.get(found["visibility"])
    return met


def tree(page: str) -> Node:
    """The page's elements and texts; end tags that are left out are put in, stray ones ignored."""
    root = Node("html", {})
    stack, raw_to, sheets = [root], 0, []
    for t in _TOKEN.finditer(page):
        if t.start() < raw_to:
            continue
        text, name = t["text"], t["name"]
        if text is not None or t["cdata"] is not None:
            words = html.unescape(text) if text is not None else t["cdata"]
            if stack[-1].name == "head" and words.strip():
                stack.pop()
            if stack[-1].name not in ("svg", "g") or not any(n.name == "svg" for n in stack):
                stack[-1].inner.append(words)
        elif name is None:
            continue
        elif t["end"]:
            name = name.lower()
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth and not (name not in BLOCK and any(n.name in ("td", "th", "table") for n in stack[depth + 1 :])):
                del stack[depth:]
        else:
            name = name.lower()
            attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(t["attrs"])} if t["attrs"] else {}
            if stack[-1].name == "head" and name not in IN_HEAD:
                stack.pop()
            if name in _CELL or name in _ROW or name in _SECTIONS or name in ("caption", "colgroup"):
                _close(stack, frozenset(("caption", "colgroup")), frozenset(("table",)))
            if name in CLOSES:
                _close(stack, *CLOSES[name])
            elif name in BLOCK:
                _close(stack, frozenset(("p",)), BLOCK - {"p"})
            if name == "body":
                _close(stack, frozenset(("head",)), frozenset())
            if name in _CELL and (stack[-1].name == "table" or stack[-1].name in _SECTIONS):
                row = Node("tr", {})
                stack[-1].inner.append(row)
                stack.append(row)
            if any(name in hidden and any(n.name == k for n in stack) for k, hidden in WITHIN.items()):
                attrs["hidden"] = ""
            node = Node(name, attrs)
            stack[-1].inner.append(node)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, t.end())
                raw_to = end.end() if end else len(page)
                node.inner.append(page[t.end() : end.start() if end else len(page)])
                if name == "style":
                    sheets.append(node.inner[0])
            elif name not in VOID and not t["attrs"].endswith("/"):
                stack.append(node)
    _styled(root, sheets)
    return root


def _close(stack: list[Node], names: frozenset[str], beyond: frozenset[str]) -> None:
    """Closes the open elements of these names, down to the first that nothing is closed beyond."""
    cut = len(stack)
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in beyond:
            break
        if stack[i].name in names:
            cut = i
    del stack[cut:]


class _Page:
    """Lines as they are laid out; a line is closed by a block's border."""

    def __init__(self):
        self.lines, self.line, self.indent, self.mark, self.gap = [], [], "", "", False

    def put(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.split("\n")
            self.line.append(first)
            for x in rest:
                self.end(True)
                self.line.append(x)
        else:
            self.line.append(_SPACE.sub(" ", text))

    def end(self, even_empty: bool = False, keep: bool = False) -> None:
        text = "".join(self.line)
        if not keep:
            text = re.sub(" +", " ", text).strip(" ")
        self.line = []
        if text or even_empty:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            self.lines.append((self.indent + self.mark + text).rstrip())
            if self.mark:
                self.indent, self.mark = self.indent + " " * len(self.mark), ""


def rendered(page: str) -> str:
    """The visible text of a page; an empty page, or one that shows nothing, gives an empty text."""
    out = _Page()
    _lay(tree(page), out, False)
    out.end()
    return "\n".join(out.lines).strip("\n")


def _lay(top: Node, out: _Page, keep: bool, veil: bool = False) -> None:
    # a loop with its own stack: pages may nest deeper than Python's calls
    work: list[tuple] = [("open", top, keep, 0, veil)]
    while work:
        step, node, keep, number, veil = work.pop()
        if step == "text":
            if not veil:
                out.put(node, keep)
            continue
        if step == "close":
            out.end(keep=keep)
            out.indent, out.mark = number
            out.gap = out.gap or node.name in SPACED
            continue
        if node.gone:
            continue
        veil = veil if node.veil is None else node.veil
        if node.name == "br":
            out.end(True)
        elif node.name == "hr":
            out.end()
            out.gap = True
        elif node.name == "img":
            out.put("" if veil else node.attrs.get("alt", ""), False)
        elif node.name == "input":
            shown = not veil and node.attrs.get("type", "").lower() in _TYPED
            hint = "" if node.attrs.get("type", "").lower() in _BUTTONS else node.attrs.get("placeholder", "")
            out.put((node.attrs.get("value", "") or hint) if shown else "", False)
        elif node.name == "table" and _is_grid(node):
            out.end()
            out.gap = True
            for line in _grid(node, veil):
                out.line = [line]
                out.end(keep=True)
            out.gap = True
        else:
            if node.name in BLOCK or node.name in LINES:
                out.end()
                out.gap = out.gap or (node.name in SPACED and not (node.name in ("ul", "ol") and out.indent))
                work.append(("close", node, keep or node.name == "pre", (out.indent, ""), veil))
                if node.name == "li":
                    out.mark = f"{number}. " if number else "- "
                elif node.name in ("dd", "blockquote"):
                    out.indent += "  "
            keep, count = keep or node.name in ("pre", "textarea"), 0
            inner = []
            if node.name == "optgroup" or (node.name == "option" and not node.inner):
                inner += [("text", node.attrs.get("label", ""), False, 0, veil), ("open", Node("br", {}), False, 0, veil)]
            for x in node.inner if node.name != "details" or "open" in node.attrs else [x for x in node.inner if isinstance(x, Node) and x.name == "summary"][:1]:
                if isinstance(x, str):
                    inner.append(("text", x, keep, 0, veil))
                else:
                    if x.name == "li" and node.name == "ol":
                        start = node.attrs.get("start", "1")
                        count = count + 1 if count else (int(start) if re.fullmatch(r"\d{1,9}", start) else 1) or 1
                        if re.fullmatch(r"[1-9]\d{0,8}", x.attrs.get("value", "")):
                            count = int(x.attrs["value"])
                    inner.append(("open", x, keep, count if x.name == "li" else 0, veil))
            work.extend(reversed(inner))


def _rows(table: Node, veil: bool) -> list[list[tuple[Node, bool]]]:
    """The cells of each row, with whether what is in them is veiled unless it says otherwise."""
    rows, below = [], lambda node, veil: veil if node.veil is None else node.veil
    for part in table.inner:
        if isinstance(part, Node) and not part.gone:
            inner = below(part, veil)
            for row in part.inner if part.name in _SECTIONS else [part]:
                if isinstance(row, Node) and row.name == "tr" and not row.gone:
                    rows.append([(c, below(row, inner)) for c in row.inner if isinstance(c, Node) and c.name in _CELL and not c.gone])
    return [r for r in rows if r]


#: What may stand in the parts of a table that is laid out as a grid.
_PARTS = {"table": _SECTIONS | {"caption", "colgroup", "col", "tr"}, **dict.fromkeys(_SECTIONS, _ROW), "tr": _CELL, "colgroup": frozenset(("col",)), "col": frozenset()}


def _is_grid(table: Node) -> bool:
    """A table whose cells hold no table and that has nothing but rows (and captions), each at its place."""
    work, n = [(table, False)], 0
    while work:
        node, in_cell = work.pop()
        for x in node.inner:
            if isinstance(x, str):
                if not in_cell and x.strip():
                    return False
            elif x.name == "table" or not (in_cell or x.name in _PARTS[node.name]):
                return False
            else:
                inside = in_cell or x.name in _CELL or x.name == "caption"
                n += inside
                work.append((x, inside))
    return n > 0


def _span(cell: Node, name: str, most: int) -> int:
    given = cell.attrs.get(name, "1")
    return min(int(given), most) if re.fullmatch(r"\d{1,6}", given) and int(given) else 1


def _grid(table: Node, veil: bool) -> list[str]:
    """A line for each row of the cells' text, columns padded to the widest cell that spans just one.

    A cell of several rows stands in its first; its columns stay empty in the others.
    """

    def text(cell: Node, veil: bool) -> str:
        own, veil = _Page(), veil if cell.veil is None else cell.veil
        for x in cell.inner:
            if isinstance(x, str):
                own.put("" if veil else x, False)
            else:
                _lay(x, own, False, veil)
        own.end()
        return " ".join(" ".join(own.lines).split())

    lines = [text(x, veil) for x in table.inner if isinstance(x, Node) and x.name == "caption" and not x.gone]
    rows, filled = [], {}  # filled: by column, how many rows a cell above still fills
    for cells in _rows(table, veil):
        row, at, held = [], 0, {k: n for k, n in filled.items() if n > 0}
        filled = {k: n - 1 for k, n in held.items()}
        for c, veiled in cells:
            while at in held:
                at += 1
            span, down = _span(c, "colspan", 1000), _span(c, "rowspan", 65534)
            row.append((at, span, text(c, veiled)))
            if down > 1:
                filled.update(dict.fromkeys(range(at, at + span), down - 1))
            at += span
        rows.append(row)
    widths: dict[int, int] = {}
    for row in rows:
        for at, span, t in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), len(t))
    begins, reach = {}, 0
    for k in range(max((at + span for row in rows for at, span, _ in row), default=0)):
        begins[k] = reach
        reach += widths.get(k, 0) + 2
    for row in rows:
        line = ""
        for at, _, t in row:
            line = line.ljust(begins[at]) if len(line) <= begins[at] else line + "  "
            line += t
        lines.append(line.rstrip())
    return [x for x in lines if x]


def with_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with `text`, which replaces a column of that name.

    A null page counts as empty. Rows are rendered one by one, so ties, repeated rows and empty tables need
    nothing special; broken markup is read as far as it goes, and no visible text is cut. Of style sheets, rules within
    others (@media) and selectors that look at more than the element itself don't count.
    """

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(rendered)

    return pages.drop("text").withColumn("text", text(F.coalesce(F.col(column), F.lit(""))))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "text")
