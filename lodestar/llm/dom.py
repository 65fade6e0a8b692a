"""A small, forgiving HTML reader: a tree of elements, and its blocks of text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img button input svg math object canvas audio video iframe mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover munderover mstyle semantics".split())
CLOSES = {"p": frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

#: What a page's text is cut at.  A quote opens a value only after "=", and only if it is closed somewhere.
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![A-Za-z]))[^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"']+)))?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    """children holds nodes and strings, in page order."""

    tag: str
    attributes: str
    parent: Node | None
    depth: int
    children: list = field(default_factory=list)

    def words(self) -> str:
        """The class, id and role of the element."""
        return " ".join(a or b or c for n, a, b, c in _ATTRIBUTE.findall(self.attributes) if n.lower() in ("class", "id", "role")).lower() if self.attributes else ""

    def hidden(self) -> bool:
        low = self.attributes.lower()
        return bool(low) and (re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", low) is not None or "display:none" in low.replace(" ", ""))


def _tail(attributes: str) -> str:
    """The end of a tag's attributes without space or quotes: with "=", an unquoted value."""
    return attributes[max(attributes.rfind(c) for c in " \t\n\r\f\"'") + 1 :]


def parse(page: str) -> Node:
    """The tree of a page.  Unclosed and stray tags are put up with; the text of raw elements is left out."""
    root = Node("#root", "", None, 0)
    stack, count = [root], {"#root": 1}
    at, end = 0, len(page)

    def close(i: int) -> None:
        for n in stack[i:]:
            count[n.tag] -= 1
        del stack[i:]

    while (m := _TOKEN.search(page, at)) is not None:  # from where the last token ended, as raw elements hold no tokens
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if count.get(tag) and tag != "#root":
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        while tag in CLOSES.get(stack[-1].tag, ()):
            close(len(stack) - 1)
        if tag not in INLINE and count.get("p") and tag in CLOSES["p"]:  # a block ends an open paragraph, also below open inline elements
            i = len(stack) - 1
            while stack[i].tag in INLINE:
                i -= 1
            if stack[i].tag == "p":
                close(i)
        new = Node(tag, m[3], stack[-1], len(stack))
        stack[-1].children.append(new)
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            shut = page.find(">", stop.start()) if stop else -1
            at = shut + 1 if shut >= 0 else end
        elif tag not in VOID and (not m[3].endswith("/") or "=" in _tail(m[3])):
            stack.append(new)
            count[tag] = count.get(tag, 0) + 1
    if at < end:
        stack[-1].children.append(page[at:])
    return root


def plain(text: str) -> str:
    """Character references decoded, white space made single, ends trimmed."""
    return _SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()


def elements(root: Node) -> list[Node]:
    """All elements in page order, the root first; parents come before their children."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return out


def blocks(root: Node, kept) -> list[str]:
    """The text of the kept elements, one string for each block.

    kept: whether an element's own text stays, by id().  A line break or an inline element
    doesn't end a block; any other element does.
    """
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if text := plain("".join(now)):
            out.append(text)
        now.clear()

    stack: list = [(root, True)]
    while stack:
        item, keep = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if keep:
                now.append(item)
        elif item.tag in RAW:
            continue
        elif item.tag in ("br", "wbr"):
            now.append(" ")
        else:
            keep = kept(item)
            block = item.tag not in INLINE
            if block:
                flush()
                stack.append((None, True))
            stack.extend((c, keep) for c in reversed(item.children))
    flush()
    return out
