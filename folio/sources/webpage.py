"""HTML sources: a forgiving tree builder, table grids, and a CommonMark renderer with tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

from folio.sources import markup
from folio.sources.base import EXPANDED, Budget, Converter, Document, Limits, Source, bounded
from folio.sources.charset import codec_of, decode, normalized

# Fixed values of HTML: elements by what the parser and the renderer do with them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
BLOCK = CLOSES_P | set("body caption dd dt head html li optgroup option tbody td tfoot th thead tr".split())
HIDDEN = set("head script style link meta noscript iframe input textarea template title".split())
HEADINGS = {f"h{k}": k for k in range(1, 7)}
NESTING = set("blockquote ul ol menu".split())
CODE = set("code var samp kbd tt".split())
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*"}
#: Block quotes and lists deeper than this are shown at the deepest level kept; elements deeper than DEEPEST go into that one.
MOST_NESTED, DEEPEST = 8, 200
# Clamps of spans, and what a copy of a cell is charged.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
NODE_COST, BYTE_COST = 64, 16

_SPACE = re.compile(r"[ \t\n\r\f]+")
_BREAK = "\x01"  # a hard line break until white space is collapsed
_ESCAPED = re.compile(r"([\\`*\[\]])|(?<![^\W_])(_)|(_)(?![^\W_])|(<)(?=[A-Za-z/!?])")
_LINE_START = re.compile(r"(?m)^(#{1,6}(?= |$)|>|[-+](?= |$)|=+$|-{3,}$|~~~)|^(\d{1,9})([.)])(?= |$)")


class Node:
    """An element with its children, which are nodes and strings; home: the children it is one of."""

    __slots__ = ("tag", "attrs", "children", "home")

    def __init__(self, tag: str, attrs: list[tuple[str, str | None]] = ()):
        self.tag, self.children, self.home = tag, [], None
        self.attrs: dict[str, str] = {}
        for k, v in attrs:
            self.attrs.setdefault(k, v or "")

    def elements(self) -> Iterator[Node]:
        return (c for c in self.children if isinstance(c, Node))

    def walk(self) -> Iterator[Node]:
        """This element and all below it, outermost first."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(list(node.elements())))


class _Tree(HTMLParser):
    """Builds a tree from tags as they come: what browsers imply is implied, and open formatting goes on in the next block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("body")
        self.open = [self.root]
        self.active: list[Node | None] = []  # open formatting; None where a cell begins

    # What an open element of the first set ends, up to one of the second.
    IMPLIED = {
        "li": ({"li"}, {"ul", "ol", "menu"}),
        "dt": ({"dt", "dd"}, {"dl"}),
        "dd": ({"dt", "dd"}, {"dl"}),
        "option": ({"option"}, {"select"}),
        "tr": ({"tr", "td", "th", "caption"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}),
        **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"})),
    }

    def _pop_to(self, k: int) -> None:
        for node in self.open[k:]:
            if node.tag in ("td", "th", "caption") and None in self.active:
                while self.active.pop() is not None:
                    pass
        del self.open[k:]

    def _find(self, tags: set[str], stop: set[str]) -> int | None:
        """Place of the innermost open element of tags within one of stop."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                return k
            if self.open[k].tag in stop:
                return None
        return None

    def _outermost(self, tags: set[str], stop: set[str]) -> int | None:
        found = None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in stop:
                break
            found = k if self.open[k].tag in tags else found
        return found

    def _reopen(self) -> None:
        """Formatting that a block's end closed goes on here."""
        here = {id(n) for n in self.open}
        begin = len(self.active)
        while begin and self.active[begin - 1] is not None and id(self.active[begin - 1]) not in here:
            begin -= 1
        for k in range(begin, len(self.active)):
            old = self.active[k]
            node = Node(old.tag, list(old.attrs.items()))
            self._append(node)
            self.open.append(node)
            self.active[k] = node

    def _remember(self, node: Node) -> None:
        """Formatting that goes on in later blocks; of alike elements the last three do, as browsers have it."""
        begin = max((k for k, n in enumerate(self.active) if n is None), default=-1) + 1
        alike = [k for k in range(begin, len(self.active)) if self.active[k].tag == node.tag and self.active[k].attrs == node.attrs]
        if len(alike) > 2:
            del self.active[alike[0]]
        self.active.append(node)

    def _append(self, child: Node | str) -> None:
        """Adds to the innermost element; what may not stand in a table goes before it."""
        at = len(self.open) - 1
        parent = self.open[at]
        fits = isinstance(child, Node) and child.tag in ("caption", "colgroup", "col", "thead", "tbody", "tfoot", "tr", "td", "th", "script", "style", "template")
        if parent.tag in ("table", "thead", "tbody", "tfoot", "tr") and not fits:
            if isinstance(child, str) and not child.strip():
                return
            while at and self.open[at].tag != "table":
                at -= 1
            home = self.open[at].home
            home.insert(home.index(self.open[at]), child)
        else:
            home = self.open[min(at, DEEPEST)].children
            home.append(child)
        if isinstance(child, Node):
            child.home = home

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "head", "body"):
            return
        if tag in CLOSES_P and (k := self._find({"p"}, {"button", "td", "th", "caption"})):
            self._pop_to(k)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._pop_to(len(self.open) - 1)
        if tag in self.IMPLIED:
            ended, stop = self.IMPLIED[tag]
            if (k := self._outermost(ended, stop)) is not None:
                self._pop_to(k)
            if tag == "li" and (k := self._find({"p"}, stop)):
                self._pop_to(k)
        if tag in ("tr", "td", "th") and self._outermost({"table"}, set()) is None:
            return
        if tag == "tr" and self.open[-1].tag == "table":
            self._push(Node("tbody"))
        if tag in ("td", "th") and self.open[-1].tag != "tr":
            self.handle_starttag("tr", [])
        if tag == "a" and (k := next((k for k, n in enumerate(self.active) if n is not None and n.tag == "a" and n in self.open), None)) is not None:
            self.handle_endtag("a")
        if tag not in BLOCK:
            self._reopen()
        node = Node(tag, attrs)
        self._append(node)
        if tag not in VOID:
            self.open.append(node)
            if tag in FORMATTING:
                self._remember(node)
            elif tag in ("td", "th", "caption"):
                self.active.append(None)

    def _push(self, node: Node) -> None:
        self._append(node)
        self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            return self.handle_starttag("br", [])
        if tag in ("html", "body"):
            return
        stop = set() if tag in ("table", "tr", "td", "th", "thead", "tbody", "tfoot") else {"td", "th", "caption", "table"}
        if tag in ("td", "th", "tr", "thead", "tbody", "tfoot"):
            stop = {"table"}
        k = self._find(set(HEADINGS) if tag in HEADINGS else {tag}, stop)
        if tag in FORMATTING:
            gone = next((n for n in reversed(self.active) if n is None or n.tag == tag), None)
            if gone is not None:
                self.active.remove(gone)
        if k is not None:
            self._pop_to(k)

    def handle_data(self, data: str) -> None:
        if data:
            if data.strip() and self.open[-1].tag not in HIDDEN:
                self._reopen()
            self._append(data)


def parse(text: str) -> Node:
    tree = _Tree()
    tree.feed(text)
    tree.close()
    return tree.root


def meta_charset(data: bytes) -> str | None:
    """The charset of the first <meta> before <body> that declares one, as its attribute or as a content type."""
    found: list[str] = []

    class Scan(HTMLParser):
        done = False

        def handle_starttag(self, tag, attrs):
            if tag == "body":
                self.done = True
            if tag != "meta" or self.done or found:
                return
            a = {k: v or "" for k, v in reversed(attrs)}
            name = a.get("charset", "")
            if not name and a.get("http-equiv", "").lower() == "content-type":
                param = re.search(r";\s*charset\s*=\s*(\"[^\"]*\"|[^\s;]+)", a.get("content", ""), re.I)
                name = param[1].strip('"') if param else ""
            if name:
                found.append(name)

    scan = Scan()
    text = data.decode("latin-1")
    for at in range(0, len(text), 1 << 16):
        scan.feed(text[at : at + (1 << 16)])
        if found or scan.done:
            break
    return found[0] if found else None


def limit_nesting(root: Node) -> None:
    """Block quotes and lists below the deepest level kept become plain blocks, as do the items of such lists."""
    stack = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        for child in node.elements():
            below = depth + (child.tag in NESTING)
            if below > MOST_NESTED and child.tag in NESTING:
                for item in child.elements() if child.tag != "blockquote" else ():
                    item.tag = "div" if item.tag == "li" else item.tag
                child.tag = "div"
            stack.append((child, below))


def span_value(raw: str | None) -> int | None:
    """The digits that a span begins with, after space and a plus sign; None without any."""
    found = re.match(r"[ \t\n\r\f]*\+?(\d+)", raw or "", re.A)
    return int(found[1][:9]) if found else None


def table_rows(table: Node) -> list[tuple[list[Node], int]]:
    """(cells, rows from this one to the end of its group) of each row; rows directly under the table that follow each other are a group."""
    groups: list[list[Node]] = []
    loose = False
    for child in table.elements():
        if child.tag == "tr":
            if not loose:
                groups.append([])
            groups[-1].append(child)
            loose = True
        elif child.tag in ("thead", "tbody", "tfoot"):
            groups.append([r for r in child.elements() if r.tag == "tr"])
            loose = False
    return [([c for c in r.elements() if c.tag in ("td", "th")], len(g) - k) for g in groups for k, r in enumerate(g)]


def spans(cell: Node, left: int) -> tuple[int, int]:
    """(columns, rows) of a cell, clamped; 0 rows reach to the end of the row group, which has `left` rows, and no cell crosses it."""
    across, down = span_value(cell.attrs.get("colspan")), span_value(cell.attrs.get("rowspan"))
    down = 1 if down is None else left if down == 0 else min(down, MOST_ROWS)
    return 1 if across is None else min(max(across, 1), MOST_COLUMNS), min(max(down, 1), left)


def copy_cost(cell: Node, base: int) -> int:
    """What a copy of a cell is charged: its nodes, the bytes of their names, texts and attributes, and for links and images those of the base address."""
    total = 0
    for n in cell.walk():
        texts = [c for c in n.children if isinstance(c, str)]
        size = len(n.tag) + sum(len(k.encode()) + len(v.encode()) for k, v in n.attrs.items()) + sum(len(t.encode()) for t in texts)
        total += NODE_COST * (1 + len(texts)) + BYTE_COST * (size + (base if n.tag in ("a", "img") else 0))
    return total


def grid(table: Node, budget: Budget, base: int = 0) -> list[list[Node | None]]:
    """Rows of equal width in which a spanning cell stands in each of its places; the copies are charged before any is made."""
    rows = table_rows(table)
    shapes = [[(c, *spans(c, left)) for c in cells] for cells, left in rows]
    cost = area = width = active = 0
    ends = [0] * (len(rows) + 1)
    for i, cells in enumerate(shapes):
        for c, across, down in cells:
            active += across
            ends[i + down] += across
            area += across * down
            if across * down > 1:
                cost += copy_cost(c, base) * (across * down - 1)
        width = max(width, active)
        active -= ends[i + 1]
    budget.charge(cost + NODE_COST * max(len(rows) * width - area, 0))
    out: list[list[Node | None]] = []
    below: dict[int, tuple[Node, int]] = {}  # by column, the cell that reaches into further rows, and how many
    for cells in shapes:
        line = {k: c for k, (c, _) in below.items()}
        below = {k: (c, n - 1) for k, (c, n) in below.items() if n > 1}
        k = 0
        for c, across, down in cells:
            while k in line:
                k += 1
            for x in range(k, k + across):
                line[x] = c
                if down > 1:
                    below[x] = c, down - 1
                else:
                    below.pop(x, None)
            k += across
        out.append([line.get(x) for x in range(max(line, default=-1) + 1)])
    width = max(map(len, out), default=0)
    return [r + [None] * (width - len(r)) for r in out]


class Renderer:
    def __init__(self, limits: Limits, base_url: str | None):
        self.base, self.limits, self.budget = base_url or "", limits, Budget(EXPANDED, limits.expanded)
        self.grids: dict[int, list[list[Node | None]]] = {}
        self.with_block: set[int] = set()
        self.with_table: set[int] = set()

    def prepare(self, root: Node) -> None:
        """What lies below each element, and grids of the tables that hold no table, in the order in which tables end."""
        for node in reversed(list(root.walk())):
            below = [id(c) for c in node.elements()]
            if node.tag in BLOCK and node.tag not in HIDDEN or any(k in self.with_block for k in below):
                self.with_block.add(id(node))
            table_below = any(k in self.with_table for k in below)
            if node.tag == "table" and not table_below:
                self.grids[id(node)] = grid(node, self.budget, len(self.base.encode()))
            if node.tag == "table" or table_below:
                self.with_table.add(id(node))

    def address(self, raw: str) -> str:
        target = urljoin(self.base, raw.strip()) if self.base else raw.strip()
        return f"<{target}>" if re.search(r"[\s()<>]", target) else target

    # Inline content

    def text(self, raw: str) -> str:
        return _ESCAPED.sub(lambda m: "\\" + m[0], _SPACE.sub(" ", raw.replace(_BREAK, "")))

    def inline(self, children: list) -> str:
        parts = []
        for c in children:
            if isinstance(c, str):
                parts.append(self.text(c))
            elif c.tag not in HIDDEN:
                parts.append(self.element(c))
        return "".join(parts)

    def element(self, node: Node) -> str:
        tag = node.tag
        if tag == "br":
            return _BREAK
        if tag == "img":
            return self.image(node)
        if tag in CODE:
            return self.code(node)
        inner = self.inline(node.children)
        if tag in MARKS:
            return self.marked(inner, MARKS[tag])
        if tag == "a":
            return self.anchor(node, inner)
        return f" {inner} " if tag in BLOCK else inner

    def marked(self, inner: str, mark: str) -> str:
        core = inner.strip(" " + _BREAK)
        if not core:
            return inner
        lead, tail = inner[: inner.index(core)], inner[inner.index(core) + len(core) :]
        return f"{lead}{mark}{core}{mark}{tail}"

    def anchor(self, node: Node, inner: str) -> str:
        label, href = " ".join(inner.replace(_BREAK, " ").split()), node.attrs.get("href")
        if not label or href is None:
            return inner
        lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
        return f"{lead}[{label}]({self.address(href)}{self.title(node)}){tail}"

    def image(self, node: Node) -> str:
        src = node.attrs.get("src", "")
        alt = " ".join(self.text(node.attrs.get("alt", "")).split())
        return f"![{alt}]({self.address(src)}{self.title(node)})" if src else ""

    def title(self, node: Node) -> str:
        title = " ".join(node.attrs.get("title", "").split()).replace('"', '\\"')
        return f' "{title}"' if title else ""

    def plain(self, node: Node) -> str:
        parts, stack = [], [node]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                parts.append(n)
            elif n.tag == "br":
                parts.append("\n")
            else:
                stack.extend(reversed(n.children))
        return "".join(parts)

    def code(self, node: Node) -> str:
        raw = _SPACE.sub(" ", self.plain(node)).strip()
        if not raw:
            return ""
        longest = max(map(len, re.findall("`+", raw)), default=0)
        ticks = "`" * (longest + 1)
        pad = " " if raw[0] == "`" or raw[-1] == "`" else ""
        return f"{ticks}{pad}{raw}{pad}{ticks}"

    def flow(self, inner: str) -> str:
        """A paragraph's lines: white space collapsed, hard breaks in place."""
        lines = [" ".join(x.split(" ")).strip() for x in re.sub(" +", " ", inner).split(_BREAK)]
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        joined = "  \n".join(lines)
        return _LINE_START.sub(lambda m: f"{m[2]}\\{m[3]}" if m[2] else "\\" + m[1], joined)

    # Blocks

    def is_block(self, node: Node | str) -> bool:
        return not isinstance(node, str) and node.tag not in HIDDEN and id(node) in self.with_block

    def blocks(self, children: list) -> list[str]:
        out: list[str] = []
        run: list = []

        def flush() -> None:
            if paragraph := self.flow(self.inline(run)):
                out.append(paragraph)
            run.clear()

        for c in children:
            if self.is_block(c):
                flush()
                out.extend(b for b in self.block(c) if b)
            else:
                run.append(c)
        flush()
        return out

    def block(self, node: Node) -> list[str]:
        tag = node.tag
        if tag in HEADINGS:
            line = " ".join(self.inline(node.children).replace(_BREAK, " ").split())
            return [f"{'#' * HEADINGS[tag]} {line}"] if line else []
        if tag == "hr":
            return ["* * *"]
        if tag == "pre":
            return self.preformatted(node)
        if tag == "blockquote":
            inner = "\n\n".join(self.blocks(node.children))
            return ["\n".join(f"> {x}" if x else ">" for x in inner.split("\n"))] if inner else []
        if tag in ("ul", "ol", "menu"):
            return self.list_(node)
        if tag == "table" and id(node) in self.grids:
            return self.table(node)
        return self.blocks(node.children)

    def preformatted(self, node: Node) -> list[str]:
        raw = self.plain(node)
        raw = raw[1:] if raw.startswith("\n") else raw
        raw = raw.rstrip("\n")
        if not raw.strip():
            return []
        names = " ".join(n.attrs.get("class", "") for n in node.walk())
        found = re.search(r"\b(?:language|lang)-([\w+#-]+)", names)
        ticks = markup.fence_for(raw)
        return [f"{ticks}{found[1] if found else ''}\n{raw}\n{ticks}"]

    def list_(self, node: Node) -> list[str]:
        start = span_value(node.attrs.get("start"))
        number = 1 if start is None else start
        items, loose, extra = [], False, []
        for c in node.children:
            if isinstance(c, Node) and c.tag == "li":
                parts = self.blocks(c.children)
                sublists = sum(isinstance(x, Node) and x.tag in ("ul", "ol", "menu") for x in c.children)
                loose |= any(isinstance(x, Node) and x.tag == "p" for x in c.children) and len(parts) > 1
                marker = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                tight = "\n" if len(parts) - sublists <= 1 else "\n\n"
                inner = tight.join(parts)
                pad = " " * len(marker)
                lines = inner.split("\n")
                if inner:
                    items.append("\n".join([marker + lines[0], *(pad + x if x else "" for x in lines[1:])]))
            elif not isinstance(c, str) or c.strip():
                extra.extend(self.blocks([c]))
        return [x for x in (("\n\n" if loose else "\n").join(items), *extra) if x]

    def table(self, node: Node) -> list[str]:
        rows = self.grids[id(node)]
        known: dict[int, str] = {}
        lines = []
        for r in rows:
            cells = []
            for c in r:
                if c is None:
                    cells.append("")
                    continue
                if id(c) not in known:
                    known[id(c)] = self.cell(c)
                cells.append(known[id(c)])
            lines.append("| " + " | ".join(cells) + " |")
        captions = [" ".join(self.inline(c.children).split()) for c in node.elements() if c.tag == "caption"]
        if not rows or not rows[0]:
            return [c for c in captions if c]
        lines.insert(1, "|" + "---|" * len(rows[0]))
        size = sum(len(x.encode()) + 1 for x in lines) - 1
        Budget("output", self.limits.output).charge(size)
        return ["\n".join(lines), *(c for c in captions if c)]

    def cell(self, node: Node) -> str:
        inner = "\n\n".join(self.blocks(node.children)).replace("  \n", "\n")
        inner = re.sub("\n+", "<br />", inner.strip())
        return re.sub(r"(\\*)\|", lambda m: m[1] + "|" if len(m[1]) % 2 else m[1] + "\\|", inner)


def to_markdown(text: str, limits: Limits, base_url: str | None = None) -> str:
    root = parse(text)
    limit_nesting(root)
    renderer = Renderer(limits, base_url)
    renderer.prepare(root)
    return normalized("\n\n".join(renderer.blocks(root.children)))


def html(fallback: str | None = None) -> Converter:
    """Markdown of a page. A declared charset counts if it is known, else that of a <meta>, of which UTF-16 means UTF-8."""

    def convert(source: Source, limits: Limits) -> Document:
        declared = source.charset
        if codec_of(declared) is None:
            declared = meta_charset(source.data)
            if (codec_of(declared) or "").startswith("utf-16"):
                declared = "utf-8"
        text = decode(source.data, declared, fallback)
        if not text.strip(markup.SPACES):
            return Document()
        return bounded(to_markdown(text, limits, source.base_url), limits)

    return convert
