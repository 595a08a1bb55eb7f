"""HTML pages as sequences of text blocks: a lenient reader for whole pages, of which nothing is dropped.

A block is the text between two block-level boundaries; formulas, drawings and what stands in for other media are part of
their line.  Each keeps its path of open elements (names, with their class
and id words), and how much of its text stands in links.  Comments, doctypes and the contents of scripts, styles and
other raw elements are no text.  Character references are decoded once, white space becomes one space.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements that stay inside a line of text; every other one ends the block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr "
    "math mi mn mo mtext mrow msup msub msubsup mfrac msqrt mroot mover munder mstyle semantics annotation svg g text tspan object canvas audio video picture map".split()
)
RAW = frozenset("script style template textarea title iframe head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of the first kind ends an open one of the second at once.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_P_ENDS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")


@dataclass
class Block:
    path: tuple[str, ...]
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    out: list[Block] = []
    names: list[str] = []  # the open elements
    paths: list[tuple[str, ...]] = [()]  # the path at each depth, class and id words included
    open_now: dict[str, int] = {}
    now, at = Block(()), 0

    def text(s: str) -> None:
        if not s:
            return
        s = html.unescape(s) if "&" in s else s
        now.parts.append(s)
        if open_now.get("a"):
            now.linked += len(s.strip())

    def end_block() -> None:
        nonlocal now
        if any(p and not p.isspace() for p in now.parts):
            out.append(now)
        now = Block(paths[-1])

    def pop(n: int) -> None:
        while len(names) > n:
            open_now[names.pop()] -= 1
            paths.pop()

    while True:
        m = _TOKEN.search(page, at)
        text(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag; one that nothing opened is passed over
            if open_now.get(name):
                k = len(names) - 1 - names[::-1].index(name)
                if name not in INLINE or any(x not in INLINE for x in names[k:]):
                    if name in INLINE:
                        continue  # an inline end tag does not end the blocks inside it
                    end_block()
                pop(k)
                now.path = paths[-1] if not now.parts else now.path
                if name not in INLINE:
                    now = Block(paths[-1])
            elif name == "p":
                end_block()
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            if name == "head":
                continue
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            now.parts.append(" ")
            continue
        if name in INLINE:
            if name not in VOID:
                names.append(name)
                paths.append((*paths[-1], name))
                open_now[name] = open_now.get(name, 0) + 1
            continue
        end_block()
        for closed in CLOSES.get(name, ()):
            if open_now.get(closed):
                k = len(names) - 1 - names[::-1].index(closed)
                if not {"ul", "ol", "dl", "table", "select"} & set(names[k + 1 :]):
                    pop(k)
        if name in _P_ENDS and open_now.get("p"):
            pop(len(names) - 1 - names[::-1].index("p"))
        if name not in VOID:
            own = [w.lower() for a, b, c in _NAMES.findall(m[3]) for w in _WORD.findall(a or b or c)]
            names.append(name)
            paths.append((*paths[-1], name, *(f".{w}" for w in own)))
            open_now[name] = open_now.get(name, 0) + 1
        now = Block(paths[-1])
    end_block()
    return out
