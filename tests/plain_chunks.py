"""Markdown chunks in plain Python: what the library's column expressions are held against."""

from __future__ import annotations

import re
from itertools import groupby

from tessera.functions import text as T

_HEADING = re.compile(r"(#{1,6})\s+(.*)$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")


class _Fence:
    """Whether the lines so far have left a code fence open."""

    def __init__(self) -> None:
        self.mark = ""

    def turns(self, line: str) -> bool:
        """True if this line opens or closes a fence."""
        m = _FENCE.match(line)
        if not m:
            return False
        mark, info = m[1], m[2]
        if self.mark:
            if mark[0] != self.mark[0] or len(mark) < len(self.mark) or info.strip(" \t"):
                return False
            self.mark = ""
            return True
        if mark[0] == "`" and "`" in info:
            return False
        self.mark = mark
        return True


def sections(text: str) -> list[tuple[str, str]]:
    """(breadcrumb, block) in order; each heading outside code begins a block."""
    fence, path, crumb = _Fence(), [], ""
    blocks: list[tuple[str, list[str]]] = [("", [])]
    for line in text.splitlines():
        inside = bool(fence.mark)
        m = None if fence.turns(line) or inside else _HEADING.match(line)
        if m:
            path = [(n, t) for n, t in path if n < len(m[1])] + [(len(m[1]), m[2].strip())]
            crumb = " > ".join(t for _, t in path)
            blocks.append((crumb, []))
        blocks[-1][1].append(line)
    return [(c, b) for c, ls in blocks if (b := "\n".join(ls)).strip()]


def code_and_prose(block: str) -> list[tuple[str, bool]]:
    """Stretches of a block and whether they are fenced code; an open fence runs to the end."""
    fence, marked, part = _Fence(), [], 0
    for line in block.splitlines():
        was = bool(fence.mark)
        turned = fence.turns(line)
        if turned and not was:
            part += 1
        marked.append((part, was or turned, line))
        if turned and was:
            part += 1
    runs = [("\n".join(x[2] for x in g), code) for (_, code), g in groupby(marked, key=lambda x: x[:2])]
    return [(s, code) for s, code in runs if code or s.strip()]


def split_markdown(text: str, size: object = T.CHUNK_SIZE, overlap: object = T.CHUNK_OVERLAP) -> list[tuple[str, str]]:
    """(text, breadcrumb) of each chunk: a section if it fits, else its code whole and
    its prose in overlapping windows, of which a short last one joins its neighbour."""
    size, overlap = T.clamped(size, overlap)
    out = []
    for crumb, block in sections(text):
        block = block.strip()
        if len(block) <= size:
            out.append((block, crumb))
            continue
        for part, code in code_and_prose(block):
            part = part.strip()
            if code or len(part) <= size:
                out.append((part, crumb))
                continue
            pieces = [part[i : i + size] for i in range(0, len(part), max(size - overlap, 1))]
            if len(pieces) > 1 and len(pieces[-1]) < T.SHORT_TAIL:
                pieces[-2:] = ["".join(pieces[-2:])]
            out += [(p, crumb) for p in pieces]
    return [(t, c) for t, c in out if t.strip()]
