"""HTML fields as Arrow-batched column functions over the standard-library parser.

Only the tree walk is Python: addresses, link policy, dates and hashing stay in JVM expressions.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template", "rt", "rp"}
SEMANTIC_DROP = "script,style,noscript,nav,footer,form,.people-list"
WATCH_DROP = "script,style,nav,footer,form,noscript"
LINK_DROP = "script,style,nav,footer,header,form,noscript"
BLOCKS = ("p", "li", "dd")
LABEL_LENGTH, CONTEXT_LENGTH = 80, 1000  # longest label that needs its block, and longest block


class Node:
    __slots__ = ("tag", "attrs", "items", "parent", "gone")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.items, self.parent = tag, {k: v or "" for k, v in attrs}, [], parent
        self.gone = False  # dropped with all below it

    def walk(self):
        """Elements below this one in document order; pages may nest to any depth."""
        rest = [iter(self.items)]
        while rest:
            for item in rest[-1]:
                if isinstance(item, Node) and not item.gone:
                    yield item
                    rest.append(iter(item.items))
                    break
            else:
                rest.pop()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")
        self.open = Counter()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs, self.at)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.at.items.append(Node(tag, attrs, self.at))

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return  # closes nothing; looking for it would climb the whole tree
        while self.at.tag != tag:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[tag] -= 1
        self.at = self.at.parent

    def handle_data(self, data):
        if self.at.items and isinstance(self.at.items[-1], str):
            self.at.items[-1] += data
        else:
            self.at.items.append(data)

    def handle_comment(self, data):
        self.at.items.append(None)  # a comment separates the texts around it


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"""([#.]?)([\w-]+)|\[([\w-]+)(?:=["']?([^"'\]]*)["']?)?\]""")


@lru_cache(maxsize=1000)
def _compiled(selector: str) -> tuple:
    """Alternatives of a selector: each a tuple of (is a direct child, conditions) from left to right."""
    out = []
    for part in selector.split(","):
        steps, child = [], False
        for word in part.replace(">", " > ").split():
            if word == ">":
                child = True
            else:
                steps.append((child, tuple(_SIMPLE.findall(word))))
                child = False
        out.append(tuple(steps))
    return tuple(out)


def _fits(node: Node, conditions: tuple) -> bool:
    for mark, name, attr, value in conditions:
        if mark == "." and name not in node.attrs.get("class", "").split():
            return False
        if mark == "#" and node.attrs.get("id") != name:
            return False
        if not mark and name and node.tag != name.lower():
            return False
        if attr and (attr not in node.attrs or (value and node.attrs[attr] != value)):
            return False
    return True


def _advance(node: Node, chains: tuple, own: tuple, above: tuple) -> tuple:
    """Which leading steps of each chain end at ``node``: one bit a step. ``own`` are its parent's
    bits, ``above`` those of the parent and all its ancestors together."""
    out = []
    for steps, parent, ancestors in zip(chains, own, above):
        bits = 0
        for k, (child, conditions) in enumerate(steps):
            before = k == 0 or (parent if child else ancestors) >> (k - 1) & 1
            if before and _fits(node, conditions):
                bits |= 1 << k
        out.append(bits)
    return tuple(out)


def matches(node: Node, selector: str):
    """Elements below ``node`` that a selector finds, in document order, in one pass.

    Ancestors of ``node`` count for descendant and child steps.
    """
    chains = _compiled(selector)
    wanted = [1 << (len(steps) - 1) for steps in chains]
    line, up = [], node
    while up is not None and up.tag:
        line.append(up)
        up = up.parent
    own = above = (0,) * len(chains)
    for one in reversed(line):
        own = _advance(one, chains, own, above)
        above = tuple(a | o for a, o in zip(above, own))
    rest = [(iter(node.items), own, above)]
    while rest:
        items, own, above = rest[-1]
        for item in items:
            if isinstance(item, Node) and not item.gone:
                bits = _advance(item, chains, own, above)
                rest.append((iter(item.items), bits, tuple(a | o for a, o in zip(above, bits))))
                if any(b & w for b, w in zip(bits, wanted)):
                    yield item
                break
        else:
            rest.pop()


def select(node: Node, selector: str) -> list[Node]:
    return list(matches(node, selector))


def first(node: Node, selector: str) -> Node | None:
    return next(matches(node, selector), None)


def drop(node: Node, selector: str) -> Node:
    for n in select(node, selector):
        n.gone = True
    return node


def show_templates(node: Node) -> Node:
    """Make published accordion content readable."""
    for n in node.walk():
        if n.tag == "template":
            n.tag = "div"
    return node


def texts(node: Node):
    """Stripped texts below an element in document order, without hidden parts."""
    rest = [iter(node.items)]
    while rest:
        for item in rest[-1]:
            if isinstance(item, Node):
                if item.tag not in HIDDEN and not item.gone:
                    rest.append(iter(item.items))
                    break
            elif item and (plain := item.strip()):
                yield plain
        else:
            rest.pop()


def text(node: Node, glue: str = "\n") -> str:
    return glue.join(texts(node))


def squeeze(value: str) -> str:
    return re.sub(r"[ \t]+", " ", value).strip()


def semantic(node: Node) -> str:
    return squeeze(text(drop(show_templates(node), SEMANTIC_DROP)))


# --- column functions -----------------------------------------------------------------------
def _series(fn, column: Column, returns: str) -> Column:
    @F.pandas_udf(returns)
    def apply(values: pd.Series) -> pd.Series:
        return values.map(fn, na_action="ignore").astype(object)

    return apply(column)


def clean_html(column: Column) -> Column:
    """Readable text of an HTML fragment; plain text passes through trimmed."""

    def one(value):
        if "<" not in value:
            return value.strip()
        return squeeze(text(drop(parse(value), "script,style,noscript")))

    return F.coalesce(_series(one, column, "string"), F.lit(""))


def unescaped(column: Column) -> Column:
    """Text with its entities decoded; JVM side unless there is one."""
    return F.when(column.contains("&"), _series(unescape, F.when(column.contains("&"), column), "string")).otherwise(column)


def semantic_text(column: Column, selector: str | None = None) -> Column:
    """Text without executable and navigation parts, with accordions; null if the part is missing."""

    def one(value):
        root = parse(value)
        node = first(root, selector) if selector else root
        return None if node is None else semantic(node)

    return _series(one, column, "string")


def watched_text(column: Column, selector: str = "main, article") -> Column:
    """Main text for change detection; null when the main element is missing."""

    def one(value):
        node = first(parse(value), selector)
        return None if node is None else text(drop(node, WATCH_DROP))

    return _series(one, column, "string")


def fields(column: Column, selectors: dict[str, str], scope: str | None = None) -> Column:
    """Map of name to the text of the first element its selector finds."""

    def one(value):
        root = parse(value)
        node = first(root, scope) if scope else root
        found = {k: first(node, s) for k, s in selectors.items()} if node else {}
        return {k: text(n, " ") for k, n in found.items() if n is not None}

    return _series(one, column, "map<string,string>")


def element_texts(column: Column, selector: str) -> Column:
    return _series(lambda v: [text(n, " ") for n in select(parse(v), selector)], column, "array<string>")


LABELLED = "struct<labels:array<string>,text:string>"


def labelled_text(column: Column, selector: str) -> Column:
    """``element_texts`` and ``semantic_text`` of an HTML text, which is parsed once for both."""

    def one(value):
        root = parse(value)
        labels = [text(n, " ") for n in select(root, selector)]  # before anything is dropped
        return labels, semantic(root)

    @F.pandas_udf(LABELLED)
    def apply(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if v is None else one(v) for v in values], columns=["labels", "text"])

    return apply(column)


CARD = "array<struct<position:int,href:string,title:string,text:string,date_label:string,status_label:string,open_label:string>>"


def cards(column: Column, config: dict) -> Column:
    """Catalogue cards of a page in page order, by the selectors of a source's configuration.

    A card without a link keeps an empty address; the caller decides what that means.
    """

    def label(card, key):
        node = first(card, config[key]) if config.get(key) else None
        return text(node, " ") if node is not None else ""

    def one(value):
        main = first(parse(value), config.get("selector", "main, article, #content"))
        rows = []
        for position, card in enumerate(select(main, config["card_selector"]) if main else []):
            link = card if config.get("link_is_card") else first(card, config["link_selector"])
            href = link.attrs.get("href", "") if link is not None else ""
            named = first(card, config["title_selector"]) if config.get("title_selector") else link
            title = text(named, " ") if named is not None else ""
            labels = [label(card, k) for k in ("date_selector", "status_selector", "open_date_selector")]
            rows.append((position, href, title, semantic(card), *labels))
        return rows

    return _series(one, column, CARD)


LINK = "struct<position:int,href:string,label:string,context:string,image:boolean>"
PART = f"struct<title:string,text:string,links:array<{LINK}>>"
FLAT = f"struct<text:string,links:array<{LINK}>>"


def _block_texts(links: list[Node]) -> dict[Node, str | None]:
    """For each link the text of its own paragraph or list item; null in blocks of more than two links."""
    if not links:
        return {}
    root = links[0]
    while root.parent is not None:
        root = root.parent
    block, order, count = {root: None}, [], Counter()  # block: the nearest one at or above a node
    for node in root.walk():
        inside = block[node.parent]
        if node.tag == "a" and "href" in node.attrs and inside is not None:
            count[inside] += 1
        block[node] = node if node.tag in BLOCKS else inside
        if block[node] is node:
            order.append(node)
    for node in reversed(order):  # what a block holds, the block around it holds too
        count[block[node.parent]] += count[node]
    around = {}
    for link in links:
        own = block[link.parent]
        if own is not None and count[own] <= 2 and own not in around:
            around[own] = text(own, " ")
    return {link: around.get(block[link.parent]) for link in links}


def _readable(body: Node, links: list, context_length: int = CONTEXT_LENGTH) -> str:
    """Readable text of an element; its raw links and pictures are added to ``links``.

    A link with a short label keeps the text of its block, if that is no longer than ``context_length``.
    """
    drop(show_templates(body), LINK_DROP)
    found = select(body, "a[href]")
    around = _block_texts(found)
    for link in found:
        label, context = text(link, " "), around[link]
        keep = context is not None and len(label) <= LABEL_LENGTH and len(context) <= context_length
        links.append((len(links), link.attrs["href"], label, context if keep else None, False))
    for picture in select(body, "img[src]"):
        links.append((len(links), picture.attrs["src"], picture.attrs.get("alt", ""), None, True))
    return text(body)


def document_part(column: Column, title_length: int = 1000) -> Column:
    """Title (at most ``title_length`` characters), readable text and raw links of an HTML document."""

    def one(value):
        root = parse(value)
        named = first(root, "title")
        body = first(root, "main, article, #main-content, #content") or first(root, "body") or root
        links = []
        return (text(named, " ")[:title_length] if named else "", _readable(body, links), links)

    @F.pandas_udf(PART)
    def apply(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in values], columns=["title", "text", "links"])

    return apply(column)


_ADDRESS = re.compile(r"https?://[^\s<>\"']+")
_LABEL_KEYS = {"url": ("text", "title"), "href": ("text",)}  # address key: keys of its label


def _inner(value: str):
    """The JSON that a string holds, or None."""
    if value.lstrip()[:1] not in ("{", "["):
        return None
    try:
        return json.loads(value)
    except (ValueError, RecursionError):
        return None


def _named_addresses(path: str, entry: dict):
    for key, labels in _LABEL_KEYS.items():
        if isinstance(entry.get(key), str):
            yield entry[key], str(next((entry[k] for k in labels if k in entry), path))


def _listed(document) -> tuple[str, list]:
    """Lines and links of a decoded JSON document. Open values wait on a stack, the next one on top."""
    lines, links = [], []
    waiting = [("", document)]
    while waiting:
        path, value = waiting.pop()
        if isinstance(value, str) and (held := _inner(value)) is not None:
            value = held
        below = []
        if isinstance(value, dict):
            links += [(len(links) + i, href, label, None, False) for i, (href, label) in enumerate(_named_addresses(path, value))]
            below = [(f"{path}.{key}" if path else key, child) for key, child in value.items()]
        elif isinstance(value, list) and value:
            below = [(f"{path}[{place}]", child) for place, child in enumerate(value)]
        elif isinstance(value, str):
            links += [(len(links) + i, href.rstrip(".,);"), path, None, False) for i, href in enumerate(_ADDRESS.findall(value))]
            lines.append(f"{path}: " + (_readable(parse(value), links) if "<" in value else value))
        else:
            lines.append(f"{path}: " + json.dumps(value, ensure_ascii=False))
        waiting += reversed(below)
    return "\n".join(lines), links


def json_lines(column: Column) -> Column:
    """``path: value`` lines of a JSON text at any depth, and the addresses found in it.

    A text that is no JSON is one line without a path.
    """

    def one(value):
        try:
            return _listed(json.loads(value))
        except (ValueError, RecursionError):
            return value, []

    @F.pandas_udf(FLAT)
    def apply(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if v is None else one(v) for v in values], columns=["text", "links"])

    return apply(column)


# Stand-ins for the two escapes that could end a string early, from the private use area.
_BACKSLASH, _QUOTE = "\ue000", "\ue001"


def json_references(column: Column) -> Column:
    """Every key and scalar of a JSON text, as strings: what a notice may refer to.

    Built-in functions alone: once escaped quotes are out of the way, the text falls into quoted
    strings and bare words at any depth. Nulls count for nothing; truth values are capitalised.
    """
    plain = F.replace(F.replace(column, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    words = F.array_distinct(F.regexp_extract_all(plain, F.lit('"[^"]*"|[^\\s\\[\\]{},:"]+'), 0))
    words = F.transform(words, lambda w: F.when(w == "true", '"True"').when(w == "false", '"False"').otherwise(w))
    kept = F.filter(words, lambda w: w != "null")
    joined = F.replace(F.replace(F.array_join(kept, ","), F.lit(_BACKSLASH), F.lit("\\\\")), F.lit(_QUOTE), F.lit('\\"'))
    return F.array_sort(F.array_distinct(F.from_json(F.concat(F.lit("["), joined, F.lit("]")), "array<string>")))
