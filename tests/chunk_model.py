"""A plain model of the splitting rule, on lists of strings; the
library works on spans."""
from __future__ import annotations

from collections.abc import Callable, Sequence


def _split_keep(text: str, sep: str) -> list[str]:
    if sep == "":
        return [c for c in text]
    parts = text.split(sep)
    out = [parts[0]] + [sep + p for p in parts[1:]]
    return [p for p in out if p != ""]


def _merge(pieces: list[str], size: int, overlap: int, length) -> list[str]:
    docs: list[str] = []
    cur: list[str] = []
    total = 0
    for d in pieces:
        n = length(d)
        if total + n > size and cur:
            doc = "".join(cur).strip()
            if doc:
                docs.append(doc)
            while total > overlap or (total + n > size and total > 0):
                total -= length(cur[0])
                cur = cur[1:]
        cur.append(d)
        total += n
    doc = "".join(cur).strip()
    if doc:
        docs.append(doc)
    return docs


def model_split(text: str, size: int, overlap: int, separators: Sequence[str],
               length: Callable[[str], int] = len) -> list[str]:
    """Chunks of one text."""
    if text is None:
        return []
    sep = separators[-1] if separators else ""
    rest: list[str] = []
    for i, s in enumerate(separators):
        if s == "":
            sep = s
            break
        if s in text:
            sep = s
            rest = list(separators[i + 1:])
            break
    out: list[str] = []
    good: list[str] = []
    for piece in _split_keep(text, sep):
        if length(piece) < size:
            good.append(piece)
            continue
        if good:
            out.extend(_merge(good, size, overlap, length))
            good = []
        if not rest:
            out.append(piece)
        else:
            out.extend(model_split(piece, size, overlap, rest, length))
    if good:
        out.extend(_merge(good, size, overlap, length))
    return out
