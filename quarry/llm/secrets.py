"""Secret scans by assignment-aware lexing.

Base spans come from three fixed patterns.  The method then reads every
assignment in the text (``name = "..."``, ``name: '...'``, ``"name": "..."``,
``name := a + "b"``, ``NAME=value``, ``name: type = "..."``,
``config["name"] = "..."``, ``setName("...")``, ``<add key="name" value="..."/>``,
``name: |`` with the value on the next line, ``a, b = "...", "..."``) into a target name and terms: literals (with or
without a prefix such as ``b``) and names, joined by ``+`` or by standing next
to each other, on the line, behind a line that ends in ``+`` or a backslash, or
in parentheses; the values of a list are read one by one.  Literals assigned to
a name are its constant; a name on a right-hand side stands for its constant
(first to last, as in the text), so ``part = "..."; api_key = "sk_" + part``
finds both literals.  A literal is reported (kind ``literal``) if its target's
name is sensitive and its value scores at least ``THRESHOLD``: length,
character classes and entropy count for it, placeholder words and harmless name
parts (``token_count``) against it.

Constants refer to each other.  A value's length, characters and ends are kept,
not the value itself, and scores are handed from targets back to the literals
they consist of, latest first, so chains of constants of any length cost time
in proportion to their terms.

Every step is linear in the text: operators are searched first, and the name
and the terms are read in windows around them.

Defined cases: a null or empty text has no spans; repeated rows each give
their spans; an empty table gives an empty result.
"""
from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from quarry.llm.spans import Span, covers, scan

BASE = ("assign", "access", "hex")
ADDED = ("literal",)
THRESHOLD = 0.6

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINT = re.compile(rb"pass|secret|token|api", re.I)

_OPERATOR = re.compile(r":=|=>|[=:]|(?<![A-Za-z0-9_])(?:set|with)_?([A-Za-z][A-Za-z0-9_]{0,80})[ \t]*\(")
_PAIR_LEFT = re.compile(r"""(?:key|name|id)[ \t]*=[ \t]*(["'])([^"'\n]+)\1[ \t]+value[ \t]*$""", re.I)
_BLOCK_SCALAR = re.compile(r"[ \t]*[|>][+-]?[ \t]*\r?\n[ \t]+([^ \t\r\n][^\r\n]*)")
_NAMES_LEFT = re.compile(r"[ \t]*([A-Za-z_][A-Za-z0-9_]*(?:[ \t]*,[ \t]*[A-Za-z_][A-Za-z0-9_]*)+)[ \t]*")
_NAME_LEFT = re.compile(r"""(?:^|[^A-Za-z0-9_.-])["']?([A-Za-z_][A-Za-z0-9_.-]*)["']?[ \t]*$""")
_KEY_LEFT = re.compile(r"""[A-Za-z0-9_)\]][ \t]*\[[ \t]*(?:[A-Za-z]{0,2}(["'])([^"'\n\[\]]+)\1|:?([A-Za-z_][A-Za-z0-9_.]*))[ \t]*\][ \t]*$""")
_INDEX_LEFT = re.compile(r"""(?:^|[^A-Za-z0-9_.-])([A-Za-z_][A-Za-z0-9_.-]*)[ \t]*\[[ \t]*[0-9]*[ \t]*\][ \t]*$""")
_STRING = r"""(?:[bBfFrRuUL@$]|[bB][rR]|[rR][bB]|[fF][rR]|[rR][fF]|u8)?(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)"""
_TYPE = r"""[&*]*[A-Za-z_][A-Za-z0-9_.]*(?:\[[^\]\n=]*\]+|<[^<>\n=]*>+)?(?:[ \t]*\|[ \t]*[A-Za-z_][A-Za-z0-9_.]*(?:\[[^\]\n=]*\]+)?)*[?!]?"""
_TYPED = re.compile(rf"[ \t]*{_TYPE}[ \t]*=(?![=>])")
_TYPE_ALONE = re.compile(rf"[ \t]*{_TYPE}[ \t]*")
_BLOCK = re.compile(r"(?:^|[^A-Za-z0-9_])(?:if|elif|while|for|case|else|with|except|lambda|when)[ \t(][^\n]*$")  # a colon that opens a block
_TERM = re.compile(rf"""[ \t]*(?:{_STRING}|([A-Za-z_][A-Za-z0-9_.]*)(?![A-Za-z0-9+/=-])|([A-Za-z0-9+/_=.-]{{6,}}))""")
_LITERAL = re.compile(rf"""[ \t]*{_STRING}""")
_OPEN = re.compile(r"[ \t]*[(\[]")
_CLOSE = re.compile(r"[ \t\r\n]*[)\]]")
_SPACE = re.compile(r"[ \t\r]*")
_COMMENT = re.compile(r"#|//")
_CONTINUED = re.compile(r"[ \t]*\\\r?\n")
_NEXT_LINE = re.compile(r"[ \t]*\\?[ \t]*\r?\n[ \t]*")
_TARGET = re.compile(r"[ \t]*(?::|=)")  # a string before it is a name
_PLUS = re.compile(r"[ \t]*(?:\\?\r?\n[ \t]*)?\+(?![+=])")
_COMMA = re.compile(r"[ \t\r\n]*,")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
NAME_WINDOW = 160  # a longer name is no name

# fixed values: name parts that make a target sensitive, or harmless after all
SENSITIVE = {"password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "credential", "credentials", "auth", "bearer", "privatekey"}
SENSITIVE_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("client", "secret"), ("auth", "key"), ("encryption", "key"), ("signing", "key")}
HARMLESS = {"count", "counts", "max", "min", "length", "len", "type", "hint", "field", "label", "name", "url", "uri", "path", "file", "policy", "expires", "ttl", "limit"}
PLACEHOLDERS = ("example", "changeme", "change_me", "your", "placeholder", "dummy", "xxxx", "todo", "none", "null", "true", "false", "${", "{{", "<")


def sensitive(name: str) -> bool:
    parts = [p.lower() for p in _PART.findall(name.rsplit(".", 1)[-1])]
    if any(p in HARMLESS for p in parts):
        return False
    return any(p in SENSITIVE for p in parts) or any(x in SENSITIVE_PAIRS for x in zip(parts, parts[1:]))


_CLASSES = tuple(map(re.compile, ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")))


class Value:
    """What a score needs of a string, put together from its parts."""
    __slots__ = ("n", "chars", "classes", "bad", "head", "tail")
    EDGE = max(map(len, PLACEHOLDERS)) - 1

    def __init__(self, value: str):
        low = value.lower()
        self.n, self.chars = len(value), Counter(value)
        self.classes = frozenset(i for i, c in enumerate(_CLASSES) if c.search(value))
        self.bad = " " in value or any(p in low for p in PLACEHOLDERS)
        self.head, self.tail = low[:self.EDGE], low[-self.EDGE:]

    @classmethod
    def join(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        out = cls("")
        for x in parts:
            seam = out.tail + x.head
            out.bad = out.bad or x.bad or any(p in seam for p in PLACEHOLDERS)
            out.head, out.tail = (out.head + x.head)[:cls.EDGE], (out.tail + x.tail)[-cls.EDGE:]
            out.classes |= x.classes
            out.n += x.n
            for c, k in x.chars.items():
                out.chars[c] += k
            if out.n > 1 << 50:  # constants that double: the shares of the characters count
                out.n /= 1 << 20
                out.chars = Counter({c: k / (1 << 20) for c, k in out.chars.items()})
        return out

    def score(self) -> float:
        if self.n < 6 or self.bad:
            return 0.0
        entropy = -sum(c / self.n * math.log2(c / self.n) for c in self.chars.values())
        return min(1.0, 0.2 + 0.15 * (len(self.classes) - 1) + 0.1 * min(self.n / 10, 3) + 0.1 * max(0.0, entropy - 2))


def score(value: str) -> float:
    """0 to 1: how much a literal looks like a generated secret."""
    return Value(value).score()


def _target(text: str, lo: int, at: int) -> str | None:
    """The name that the operator at ``at`` assigns to."""
    left = text[lo:at]
    if pair := _PAIR_LEFT.search(left):
        return pair.group(2)
    if text[at] == "=" and ":" in left:
        name, _, kind = left.rpartition(":")
        if _TYPE_ALONE.fullmatch(kind) and not _BLOCK.search(name):
            if m := _NAME_LEFT.search(name.rstrip("?!")):
                return m.group(1)
    if left.rstrip(" \t").endswith("]"):
        if m := _KEY_LEFT.search(left):
            return m.group(2) or m.group(3)
        if m := _INDEX_LEFT.search(left):
            return m.group(1)
    m = _NAME_LEFT.search(left)
    return m.group(1) if m else None


class _Gaps:
    """Ends of white space with line breaks and comments (inside brackets and
    behind a plus); every line is read once."""

    def __init__(self, text: str):
        self.text, self.known, self.line_end = text, {}, -1
        self.dead: set[int] = set()  # places behind a bracket where no value starts

    def end(self, pos: int) -> int:
        breaks, text = [], self.text
        while True:
            pos = _SPACE.match(text, pos).end()
            if _COMMENT.match(text, pos):
                if pos >= self.line_end:
                    self.line_end = text.find("\n", pos) % (len(text) + 1)
                at = self.line_end
            else:
                at = pos
            if text[at:at + 1] != "\n":
                break
            if at in self.known:
                pos = self.known[at]
                break
            breaks.append(at)
            pos = at + 1
        self.known.update(dict.fromkeys(breaks, pos))
        return pos


def _values(text: str, pos: int, gaps: _Gaps) -> tuple[list[list[tuple]], int]:
    """([[(value or name, start, end, is a name), ...], ...], end): the terms
    behind an operator, a list for every value of a sequence."""
    depth, values, terms = 0, [], []
    seen = []
    while m := _OPEN.match(text, pos):
        depth, pos = depth + 1, gaps.end(m.end())
        seen.append(pos)
        if pos in gaps.dead:
            return [], pos
    m = _TERM.match(text, pos)
    if not m and not depth and (line := _CONTINUED.match(text, pos)):
        m = _LITERAL.match(text, line.end())
    if not m:
        gaps.dead.update(seen)
    while m and m.lastindex:
        g = m.lastindex
        terms.append((m.group(g), m.start(g), m.end(g), g == 4))
        pos, m = m.end(), None
        while depth and (c := _CLOSE.match(text, pos)):
            depth, pos = depth - 1, c.end()
        gap = gaps.end(pos) if depth else pos
        if depth and (c := _COMMA.match(text, gap)):
            values.append(terms)
            terms = []
            m = _TERM.match(text, gaps.end(c.end()))
            continue
        if plus := _PLUS.match(text, gap):
            at = gaps.end(plus.end())
            while o := _OPEN.match(text, at):
                depth, at = depth + 1, gaps.end(o.end())
            m = _TERM.match(text, at)
        elif g <= 3:  # a literal next to a literal
            line = _NEXT_LINE.match(text, gap)
            for at in (gap, line.end()) if line else (gap,):
                m = _LITERAL.match(text, at)
                if m and not _TARGET.match(text, m.end()):
                    break
                m = None
    if terms:
        values.append(terms)
    return values, pos


def _listed(text: str, pos: int) -> list[tuple]:
    """Terms divided by commas, without brackets (none if there is one only)."""
    out = []
    while (m := _TERM.match(text, pos)) and m.lastindex:
        g = m.lastindex
        out.append((m.group(g), m.start(g), m.end(g), g == 4))
        comma = _COMMA.match(text, m.end())
        if not comma:
            break
        pos = comma.end()
    return out if len(out) > 1 else []


def assignments(text: str):
    """(name, values as in ``_values``) in text order."""
    end, gaps = 0, _Gaps(text)
    for op in _OPERATOR.finditer(text):
        at = op.start()
        if op.group(1):  # a call that sets something to one literal
            m = _LITERAL.match(text, op.end())
            if at >= end and m and _CLOSE.match(text, m.end()):
                end = m.end()
                yield op.group(1), [[(m.group(m.lastindex), m.start(m.lastindex), m.end(m.lastindex), False)]]
            continue
        if at < end or text[at:at + 3] == "://" or text[at:at + 2] == "==" or text[at - 1:at] in ("=", "!", "<", ">"):
            continue
        lo = max(0, at - NAME_WINDOW, text.rfind("\n", max(0, at - NAME_WINDOW), at) + 1)
        if op.group() == ":" and (typed := _TYPED.match(text, op.end(), op.end() + NAME_WINDOW)) and not _BLOCK.search(text[lo:at]):
            bracket = _OPEN.match(text, typed.end())
            if _LITERAL.match(text, gaps.end(bracket.end()) if bracket else typed.end()):
                continue  # its operator is the = behind the type
        names = op.group() == "=" and "," in text[lo:at] and _NAMES_LEFT.fullmatch(text, lo, at)
        if names and (got := _listed(text, op.end())):
            for name, value in zip(re.split(r"[ \t]*,[ \t]*", names.group(1)), got):
                yield name, [[value]]
            end = got[-1][2]
            continue
        name = _target(text, lo, at)
        if not name:
            continue
        if op.group() == ":" and (block := _BLOCK_SCALAR.match(text, op.end())):
            end = block.end()
            yield name, [[(block.group(1).rstrip(), block.start(1), block.start(1) + len(block.group(1).rstrip()), False)]]
            continue
        values, pos = _values(text, op.end(), gaps)
        if values:
            end = pos
            yield name, values


def literals(text: str) -> list[Span]:
    known: dict[str, int] = {}
    nodes: list[tuple[Value, list]] = []  # value, its parts: (start, end) of a literal or an earlier node
    best: list[float] = []
    for name, values in assignments(text):
        judged, made = sensitive(name), []
        for terms in values:
            parts = []
            for value, a, b, is_name in terms:
                if is_name and value in known:
                    parts.append((nodes[known[value]][0], known[value]))
                elif not is_name or re.search("[0-9]", value):
                    # a name without a constant is a bare value if it has digits (NAME=value)
                    parts.append((Value(value), (a, b)))
            if parts:
                nodes.append((Value.join([v for v, _ in parts]), [p for _, p in parts]))
                s = nodes[-1][0].score() if judged else 0.0
                best.append(s if s >= THRESHOLD else 0.0)
                made.append(len(nodes) - 1)
        if len(made) > 1:
            nodes.append((Value.join([nodes[i][0] for i in made]), made))
            best.append(0.0)
        if made:
            known[name] = len(nodes) - 1
    out: dict[tuple[int, int], float] = {}
    for i in range(len(nodes) - 1, -1, -1):
        if best[i]:
            for p in nodes[i][1]:
                if isinstance(p, int):
                    best[p] = max(best[p], best[i])
                elif p[0] < p[1]:
                    out[p] = max(out.get(p, 0.0), best[i])
    return [("literal", a, b, s) for (a, b), s in sorted(out.items())]


def secrets(text: str) -> list[Span]:
    """All spans of a text; base spans have score 1."""
    out: list[Span] = []
    if _HINT.search(text.encode("utf-8", "surrogatepass")):
        out += [("assign", m.start(), m.end(), 1.0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), 1.0) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), 1.0) for m in _HEX.finditer(text)]
    if "=" in text or ":" in text:
        inside = covers([(a, b) for _, a, b, _ in out])
        out += [x for x in literals(text) if not inside(x[1], x[2])]
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end, score) for every row."""
    return scan(docs, secrets, id_col, text_col)
