"""A small HTML tree over the standard parser, and selections in it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_STEP = re.compile(r"([a-z0-9]*)((?:\.[\w-]+)*)((?:\[[^\]]+\])*)$")
_TEST = re.compile(r"\[([\w-]+)(?:(\^|\*)?=[\"']?([^\"'\]]*)[\"']?)?\]")


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self, separator: str = "") -> str:
        parts = (c if isinstance(c, str) else c.text(separator) for c in self.children if isinstance(c, str) or c.tag not in ("script", "style"))
        return re.sub(r"\s+", " ", separator.join(p for p in parts if p)).strip()

    def _is(self, step: str) -> bool:
        m = _STEP.match(step)
        if not m or m[1] and m[1] != self.tag or not set(m[2].split(".")[1:]) <= set(self.attrs.get("class", "").split()):
            return False
        for name, kind, value in _TEST.findall(m[3]):
            own = self.attrs.get(name)
            if own is None or kind == "^" and not own.startswith(value) or kind == "*" and value not in own or not kind and value and own != value:
                return False
        return True

    def all(self, selector: str) -> list[Node]:
        """Nodes below this one that match any of the comma-separated chains of steps."""
        chains = [c.split() for c in selector.split(",")]
        return [n for n in self.walk() if any(n._matches(c, self) for c in chains)]

    def _matches(self, chain: list[str], top: Node) -> bool:
        if not self._is(chain[-1]):
            return False
        node, rest = self.parent, chain[:-1]
        while rest and node is not None:
            if node._is(rest[-1]):
                rest = rest[:-1]
            node = node.parent
        return not rest

    def first(self, *selectors: str) -> Node | None:
        return next((n for s in selectors for n in self.all(s)), None)

    def next_of(self, tag: str) -> Node | None:
        """The next sibling of a kind."""
        mine = self.parent.children if self.parent else []
        at = next((i for i, c in enumerate(mine) if c is self), len(mine))
        return next((c for c in mine[at + 1 :] if isinstance(c, Node) and c.tag == tag), None)

    def up(self, n: int) -> Node:
        node = self
        for _ in range(n):
            node = node.parent or node
        return node


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(page: str | None) -> Node:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


def anchors(page: str | None) -> list[tuple[str, str]]:
    return [(a.attrs.get("href", ""), a.text(" ")) for a in parse(page).all("a")]
