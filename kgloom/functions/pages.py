"""Main text of HTML pages, on a small tree made by the standard parser.

Noise is pruned: scripts, notices and the like by tag and class, other nodes by words in their
names unless they look like a container of text, and hidden nodes. Of the content containers
and the body the one with the best score of its blocks is taken (the first of equals), without
a tail of references and without a long preface before numbered chapters. Null pages give
null, empty ones empty texts; broken markup is closed at the end; a page without any block
gives all its text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.functions import constants as K

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_PUNCTUATION = re.compile(r"[.!?;:,，。！？；：]")
_LEADING, _TRAILING, _ONLY, _NUMBERED = (re.compile(x) for x in (K.LEADING_REFERENCES, K.TRAILING_REFERENCES, K.ONLY_REFERENCES, K.NUMBERED))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def text(self, between: str = " ") -> str:
        """The pieces of text below, without outer blanks."""
        out: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if x := x.strip():
                    out.append(x)
            else:
                stack.extend(reversed(x.children))
        return between.join(out)

    def walk(self):
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                yield x
                stack.extend(reversed(x.children))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        x = self.at
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None and x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def page_space(text: str) -> str:
    """Plain spaces, runs of blanks as one, at most one empty line."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\r\f\v]+", " ", text.replace("\xa0", " "))).strip()


def _content(node: Node) -> int:
    """The place of a content container in the order they are tried, or -1."""
    classes, role, name = node.attrs.get("class", "").split(), node.attrs.get("role"), node.attrs.get("id")
    tests = [node.tag == "article", node.tag == "main", role == "main", *[c in classes for c in K.CONTENT_CLASSES], *[name == i for i in K.CONTENT_IDS]]
    return tests.index(True) if True in tests else -1


def _holds_text(node: Node) -> bool:
    """Whether a node looks like a container of text, whatever its name says."""
    if node.tag in K.PROTECTED_TAGS:
        return True
    tags = [x.tag for x in node.walk() if x is not node]
    paragraphs = tags.count("p")
    return paragraphs >= 3 or (paragraphs >= 1 and any(t in ("h1", "h2", "h3") for t in tags))


def _certain_noise(node: Node) -> bool:
    if node.tag in K.NOISE_TAGS or any(c in K.NOISE_CLASSES for c in node.attrs.get("class", "").split()):
        return True
    if node.tag != "nav":
        return False
    up = node.parent
    while up is not None and up.tag != "header":
        up = up.parent
    return up is not None


def is_noise(node: Node) -> bool:
    """Whether names or styles give a node away as no part of the text."""
    a = node.attrs
    names = [v.lower() for k in ("id", "class", "role", "aria-label") for v in (a.get(k, "").split() if k == "class" else [a.get(k, "")])]
    if any(w in n for n in names for w in K.NOISE_WORDS):
        return not _holds_text(node)
    style = re.sub(r"\s+", "", a.get("style", "").lower())
    return "hidden" in a or a.get("aria-hidden") == "true" or any(x in style for x in K.HIDDEN_STYLES)


def prune(root: Node) -> None:
    """Drops the noise: the certain first, then the rest from the top down."""
    for test in (_certain_noise, is_noise):
        stack = [root]
        while stack:
            x = stack.pop()
            for c in [c for c in x.children if isinstance(c, Node)]:
                if test(c):
                    x.children.remove(c)
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node))


def line_form(text: str) -> str:
    """A block without reference marks and without blanks before or after marks."""
    t = _TRAILING.sub(r"\1", _LEADING.sub("", page_space(text)))
    t = re.sub(r"([(\[{“‘])\s+", r"\1", re.sub(r"\s+([,.;:!?%)\]}”’])", r"\1", t))
    return t.strip(" -|")


def contents_like(text: str) -> bool:
    """Whether a block is a line or table of contents."""
    marks = len(_PUNCTUATION.findall(text))
    if len(_NUMBERED.findall(text)) >= 2:
        return marks <= 2
    return re.match(r"^\d+(?:\.\d+)*\s+\S", text) is not None and len(text) <= 160 and marks == 0


def blocks(node: Node) -> list[str]:
    """The texts of the blocks below a node that say something; list items of 24 letters and more; no repeat of the one before."""
    out: list[str] = []
    for x in node.walk():
        if x is node or x.tag not in K.BLOCK_TAGS:
            continue
        t = line_form(x.text())
        empty = not t or _ONLY.fullmatch(t) or contents_like(t) or t.startswith(K.DISCARDED_STARTS) or (x.tag == "li" and len(t) < 24)
        if not empty and not (out and out[-1] == t):
            out.append(t)
    return out


def _body_of(found: list[str]) -> list[str]:
    """Blocks without a tail of references, and without a preface of eight or more before five numbered chapters."""
    said = False
    for i, t in enumerate(found):
        title = re.sub(r"^[^a-z一-鿿]+|[^a-z一-鿿]+$", "", page_space(t).lower())
        if i >= 2 and said and title in K.TAIL_TITLES:
            found = found[:i]
            break
        said = said or len(t) >= 40 or _PUNCTUATION.search(t) is not None
    chapters = [i for i, t in enumerate(found) if re.match(r"^\d+\.\s+\S", t)]
    return found[chapters[0] :] if len(chapters) >= 5 and chapters[0] >= 8 else found


def _score(found: list[str]) -> int:
    text = "\n".join(found)
    return len(text) + 6 * len(_PUNCTUATION.findall(text)) + 8 * sum(len(t) >= 80 for t in found)


def main_text(html: str | None) -> str | None:
    if html is None:
        return None
    root = parse(html)
    prune(root)
    nodes = list(root.walk())
    body = next((i for i, x in enumerate(nodes) if x.tag == "body"), 0)  # a page without a body is one
    tried = sorted((k, i) for i, x in enumerate(nodes) if (k := _content(x)) >= 0) + [(99, body)]
    best, top = "", -1
    for _, i in tried:
        found = _body_of(blocks(nodes[i]))
        if (score := _score(found)) > top:
            best, top = "\n\n".join(found), score
    return page_space(best or root.text("\n"))


@F.pandas_udf(T.StringType())
def main_text_udf(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)
