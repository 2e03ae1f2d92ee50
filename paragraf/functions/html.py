"""A small HTML tree on the standard library's tokenizer, with the end tags that HTML lets authors leave out."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HEAD = set("title meta link script style base noscript template".split())
_ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A tag on the left ends open ones on the right, up to the nearest of the scopes.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), **{t: ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}) for t in ("tbody", "thead", "tfoot")}}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """This node and all below, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if n is not self and n.tag in tags)

    def first(self, *tags: str) -> Node | None:
        return next(self.find(*tags), None)

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                out.append(item)
            else:
                todo += reversed(item.children)
        return "".join(out)

    def closest(self, tag: str) -> Node | None:
        node: Node | None = self
        while node and node.tag != tag:
            node = node.parent
        return node


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.html = Node("html", {}, None)
        self.head, self.body = Node("head", {}, self.html), Node("body", {}, self.html)
        self.html.children = [self.head, self.body]
        self.open, self.begun = [self.head], False

    def _in_body(self) -> None:
        if not self.begun:
            self.begun, self.open = True, [self.body]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "head"):
            return
        if tag == "body":
            self._in_body()
            self.body.attrs = values | self.body.attrs
            return
        if not self.begun and tag not in _HEAD:
            self._in_body()
        if tag in _ENDS_P:
            self._close({"p"}, {"button", "table", "td", "th"})
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        node = Node(tag, values, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self._in_body()
        elif tag == "p" and self.begun and not any(n.tag == "p" for n in self.open):
            self.handle_starttag("p", [])
            self.open.pop()
        else:
            self._close({tag}, set())

    def _close(self, tags: set[str], scopes: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                # the outermost of them that the scope holds
                while k > 1 and self.open[k - 1].tag in tags and self.open[k].tag != "p":
                    k -= 1
                del self.open[k:]
                return
            if self.open[k].tag in scopes:
                return

    def handle_data(self, data: str) -> None:
        if not self.begun and len(self.open) == 1:
            if not data.strip():
                return
            self._in_body()
        self.open[-1].children.append(data)


    def parse_html_declaration(self, i: int) -> int:
        # In HTML a marked section is no more than a comment, whatever its keyword.
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)


def tree(markup: str) -> Node:
    """The html node of a page; there always are a head and a body. ValueError if the tokenizer gives up."""
    builder = _Builder()
    try:
        builder.feed(markup)
        builder.close()
    except AssertionError as e:
        raise ValueError(f"markup that cannot be read: {e}") from e
    return builder.html
