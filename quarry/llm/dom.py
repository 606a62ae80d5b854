"""Page source to a small tree of block elements with their text runs."""
from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/<>]*)((?:"[^"]*"|'[^']*'|[^<>])*+)>|<[!?][^>]*(?:>|\Z)|<(?=/?[A-Za-z])[^<]*\Z""", re.S)
_ATTR = re.compile(r"""([A-Za-z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# fixed values: HTML element classes
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead
tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript iframe svg head title textarea select option datalist button".split())
RAW = frozenset("script style textarea title noscript iframe".split())
HEAD = frozenset("base link meta title style script noscript template".split())
ENDS_SAME = frozenset("option button select".split())  # a second one ends the first
CLOSES_P = BLOCKS - {"body", "html"}
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


@dataclass
class Node:
    tag: str
    words: str  # class, id and role, lower case
    parent: int
    runs: list[tuple[int, str, int]] = field(default_factory=list)  # place in the page, text, its link characters


def tags(source: str) -> list[tuple]:
    """(start, end, name, is an end tag, attributes, is empty) of every tag in
    page order; a raw element is one tag with its content, a comment has the
    name ''."""
    out, pos = [], 0
    while m := _TOKEN.search(source, pos):
        pos = m.end()
        name = (m.group(2) or "").lower()
        if name in RAW and not m.group(1):
            end = re.compile(rf"</{name}\s*>", re.I).search(source, pos)
            pos = end.end() if end else len(source)
        attrs = m.group(3) or ""
        out.append((m.start(), pos, name, bool(m.group(1)), attrs, name in VOID or attrs.endswith("/")))
    return out


def hidden_ranges(source: str, found: list[tuple]) -> tuple[dict[int, int], dict[int, int]]:
    """(start tag -> the tag up to which its hidden element reaches, end tag ->
    its start tag), both as places in ``found``.

    A hidden element ends at its own end tag; an option, button or select also
    at the next one, a head at <body> or the first block.  One left open (its
    enclosing block or the page ends first) reaches no further than the next
    block, so that it never takes the text behind it along."""
    until: dict[int, int] = {}
    opens: dict[int, int] = {}
    stack: list[tuple[str, int]] = [("html", -1)]  # blocks and hidden elements; "" is one that ended inside others
    is_open: Counter = Counter()
    first: dict[int, int] = {}  # hidden element -> first block in it; of a head also the first text or other element
    waiting: list[int] = []
    head, last = -1, 0

    def pop(at: int):
        name, i = stack.pop()
        is_open[name] -= 1
        if name in HIDDEN:
            until[i] = min(at, first.get(i, at))
        while not stack[-1][0]:
            stack.pop()

    def up_to(name: str, at: int) -> int:
        while stack[-1][0] != name:
            pop(at)
        i = stack[-1][1]
        pop(at)
        return i

    for k, (start, end, name, is_end, _, empty) in enumerate(found):
        if head >= 0:
            if source[last:start].strip():
                first.setdefault(head, k - 1)
            elif name and not is_end and name not in HEAD:
                first.setdefault(head, k)
        last = end
        if is_end:
            if is_open[name] and name in HIDDEN:
                i = up_to(name, k)
                until[i] = k
                opens[k] = i
            elif is_open[name] and name in BLOCKS:
                up_to(name, k)
            if name == "head":
                head = -1
            continue
        if name in BLOCKS:
            if head >= 0 and is_open["head"]:
                up_to("head", k)
            head = -1
            for i in waiting:
                first.setdefault(i, k)
            waiting.clear()
            if name in CLOSES_P and stack[-1][0] == "p":
                pop(k)
            while stack[-1][0] in SAME.get(name, ()):
                pop(k)
            if name in ("html", "body") or empty:
                continue
        elif name not in HIDDEN or name in RAW or empty:
            continue
        elif name in ENDS_SAME and is_open[name]:
            at = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name)
            i = stack[at][1]
            if at == len(stack) - 1:
                pop(k)
            else:
                until[i] = min(k, first.get(i, k))
                stack[at] = ("", -1)
                is_open[name] -= 1
        if name in HIDDEN:
            waiting.append(k)
            if name == "head":
                head = k
        stack.append((name, k))
        is_open[name] += 1
    while len(stack) > 1:
        pop(len(found))
    return until, opens


def tree(source: str) -> list[Node]:
    """Block elements in page order; node 0 is the page itself.  Inline markup
    melts into the text of the block around it, scripts, styles and the like
    are left out, a tag that the page's end cuts off is markup."""
    nodes, stack = [Node("html", "", -1)], [0]
    open_tags: list[str] = ["html"]
    is_open: Counter = Counter()
    text: list[str] = []
    links, in_link, place, pos = 0, 0, 0, 0
    found = tags(source)
    until, opens = hidden_ranges(source, found)
    depth: dict[int, int] = {}  # hidden element -> blocks open around it
    shown = 0  # text before a tag of a lower place is hidden

    def flush():
        nonlocal links, place
        if text:
            s = " ".join("".join(text).split())
            text.clear()
            if s:
                nodes[stack[-1]].runs.append((place, s, min(links, len(s))))
                place += 1
        links = 0

    def said(raw: str, k: int):
        nonlocal links
        if raw and k >= shown:
            t = html.unescape(raw) if "&" in raw else raw
            text.append(t)
            if in_link:
                links += len(t.strip())

    def close(to: int):
        flush()
        is_open.subtract(open_tags[to:])
        del stack[to:]
        del open_tags[to:]

    for k, (start, end, name, is_end, attributes, empty) in enumerate(found):
        said(source[pos:start], k)
        pos = end
        if not name:
            continue
        if is_end:
            if name in BLOCKS and is_open[name]:
                for i in range(len(open_tags) - 1, 0, -1):
                    if open_tags[i] == name:
                        close(i)
                        break
            elif name == "a":
                in_link = max(0, in_link - 1)
            elif k in opens:
                if depth[opens[k]] < len(stack):
                    close(depth[opens[k]])
            elif name == "br":
                said(" ", k)
            continue
        if name in RAW:
            if name != "title":
                said(" ", k)
            continue
        if name in BLOCKS:
            if name in CLOSES_P and open_tags[-1] == "p":
                close(len(stack) - 1)
            while open_tags[-1] in SAME.get(name, ()):
                close(len(stack) - 1)
            flush()
            if name in ("html", "body") or empty:
                continue
            attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attributes)}
            words = " ".join(attrs.get(k, "") for k in ("class", "id", "role")).lower()
            nodes.append(Node(name, words, stack[-1]))
            stack.append(len(nodes) - 1)
            open_tags.append(name)
            is_open[name] += 1
            in_link = 0
        elif name == "a":
            in_link += 1
        elif name == "br":
            said(" ", k)
        elif k in until:
            shown = max(shown, until[k] + 1)
            depth[k] = len(stack)
    said(source[pos:], len(found))
    flush()
    return nodes
