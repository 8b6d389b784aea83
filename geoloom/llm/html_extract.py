"""Main text of web pages by consensus host paths.

Every page's containers are scored by the text they hold outside links and outside parts that aren't content. Scripts,
styles, menus and controls never are. Page headers and footers, sidebars, notices, adverts, forms and reader comments are
suspected by tag, role or words in class and id, and then judged by what they hold: a part around an article, around the
page's heading and half of its prose, or, if only a word inside a longer name makes it suspect, around half of the prose,
is content, and so are the headings of an article. No page that has prose is left without text. A page votes for the path
of its best container, written as tags with classes from the root on, digits generalised; of a very long path the digest
stands for it. Spark sums the votes by host and path; each host's winning path then picks the containers that its pages'
texts are taken from. A page without such a container falls back on its own best one.

Blocks are separated by one space, runs of white space inside a block become one space, character references are
decoded. A null or empty page, or one without text, gives an empty text. A null url belongs to the host "". Repeated
pages are handled each. Time and memory are linear in a page's length, however deep or broken its markup is. Broken markup
is read as far as it goes: missing end tags end with their parents, a head where the body begins. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values of HTML and of common page layouts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg title textarea select canvas audio video".split())
HEAD = frozenset("base link meta noscript script style template title".split())
NEVER = frozenset("nav button dialog menu fieldset label input annotation annotation-xml".split()) | RAW
SUSPECT = frozenset("header footer aside form".split())
SUSPECT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover semantics".split())
CONTAINERS = frozenset("body main article section div td center".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promos promotion promotions banner sidebar aside menu navbar nav navigation breadcrumb breadcrumbs header masthead footer foot cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist respond replies reply disqus related recommended recommendations teaser teasers widget toolbar pagination pager copyright legal search form".split()
)
COMMENTS = frozenset("comment comments commentlist respond replies reply disqus".split())
#: Names that begin so tell of a page's state, not of a part.
STATES = frozenset("has with without no not is are hide hidden show js can".split())
#: Words that inside an article or main part name its own parts.
OWN = frozenset("header masthead legal search form foot".split())
_TAG = re.compile(r"""<!--.*?(?:-->|$)|<(?:!|\?)[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"[0-9]+")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSERS = frozenset().union(*CLOSED_BY.values())
SHARE = 0.8
#: Around a container others are taken in that add at least this share of its text, with at most this share of links.
ADDED, LINKED = 0.05, 0.3
#: Share of a page's prose from which on a suspect part is content.
MOST = 0.5
_PATH = 2000


class Node:
    __slots__ = ("tag", "label", "digest", "parent", "block", "suspect", "noise", "within", "parts", "prose", "holds", "headed", "text", "linked")

    def __init__(self, tag: str, label: str, parent: "Node | None", suspect: int, never: bool = False):
        self.tag, self.label, self.parent = tag, label, parent
        #: 0, or a mixture of LOOSE, PLAIN and READERS; noise: never content, or found not to be
        self.suspect, self.noise = suspect, never
        #: whether an article or main part is around it
        self.within = parent is not None and (parent.within or (parent.tag in ("article", "main") and not parent.suspect))
        #: stands for the labels from the root to here
        self.digest = b"" if parent is None else parent.digest if not label else _digest(parent.digest, label)
        #: the nearest node that isn't inline, itself included
        self.block = parent.block if parent is not None and tag in INLINE else self
        self.parts: list = []  # texts and nodes in page order
        #: text outside links, suspect parts included; whether an article or main part, or a heading, is inside
        self.prose, self.holds, self.headed = 0, False, False
        self.text = self.linked = 0

    def path(self) -> str:
        """The labels of the containers from the root to here, or their digest if they are long."""
        labels, size, node = [], 0, self
        while node is not None and size <= _PATH:
            if node.label:
                labels.append(node.label)
                size += len(node.label) + 1
            node = node.parent
        return "".join(f">{x}" for x in reversed(labels)) if size <= _PATH else "#" + self.digest.hex()


#: Suspect by a word inside a longer name, by tag, role or a plain name, as comments of readers.
LOOSE, PLAIN, READERS = 1, 2, 4


def _suspicion(tag: str, names: str, role: str, within: bool) -> int:
    """Why a node may not be content."""
    if tag in ("html", "body", "main"):
        return 0
    out = PLAIN if role in SUSPECT_ROLES or (tag in SUSPECT and not (within and tag == "header")) else 0
    for name in names.split():
        words = [w.lower() for w in _NAME_PARTS.findall(name)]
        if not words or words[0] in STATES:
            continue
        own = within and (len(words) > 1 or tag == "p")  # as article-header, search-results or a paragraph of class legal
        found = [w for w in words if w in NOISE and not (own and w in OWN)]
        if found and not (tag == "article" and not COMMENTS.intersection(found)):
            out |= (PLAIN if len(words) == 1 else LOOSE) | (READERS if COMMENTS.intersection(found) else 0)
    return out


def _digest(parent: bytes, label: str) -> bytes:
    return hashlib.blake2b(label.encode("utf-8", "replace"), digest_size=12, key=parent).digest()


def path_digest(path: str) -> bytes:
    if path.startswith("#"):
        return bytes.fromhex(path[1:])
    out = b""
    for label in path.split(">")[1:]:
        out = _digest(out, label)
    return out


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all containers of a page outside noise, with the lengths of their texts."""
    root = Node("", "", None, 0)
    at, here, containers = 0, root, []
    end, last = len(page), page.rfind(">")
    depth: Counter = Counter()  # open elements by tag
    closes: dict[str, int] = {}  # the last end tag of each raw tag

    def leave(node: Node) -> Node:
        """Closes all elements up to node; its parent is open then."""
        nonlocal here
        while here is not node:
            depth[here.tag] -= 1
            here = here.parent
        depth[node.tag] -= 1
        return node.parent

    while at < end:
        m = _TAG.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        tag = (m[2] or m[5] or "").lower() if m else ""
        until = m.start() if m else end
        if here.tag == "head" and (page[at:until].strip() or (tag and not (m[1] or m[4]) and tag not in HEAD)):
            here = leave(here)  # a head ends where something stands that can't be in it
        if until > at:
            here.parts.append(page[at:until])
        if m is None:
            break
        at = m.end()
        if not tag:
            continue
        if m[1] or m[4]:
            if depth[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.parent
                here = leave(node)
            continue
        if tag in _CLOSERS and here.block.parent is not None and tag in CLOSED_BY.get(here.block.tag, ()):
            here = leave(here.block)  # an open paragraph or item ends where its successor begins, with the inline tags in it
        if tag in VOID:
            if tag not in INLINE:
                here.parts.append(" ")
            continue
        if tag in RAW:
            if tag not in closes:
                closes[tag] = max((x.start() for x in re.finditer(rf"</{re.escape(tag)}\s*>", page, re.I)), default=-1)
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at) if closes[tag] >= at else None
            if close:
                at = close.end()
                continue
            if tag in ("script", "style", "textarea", "title"):
                break  # nothing after an open raw text is markup
        attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(m[3] or m[6] or "")}
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        label = _DIGITS.sub("#", ".".join([tag, *sorted(set(attrs.get("class", "").split()))])).replace(">", "") if tag in CONTAINERS else ""
        never = tag in NEVER or tag == "head"
        node = Node(tag, label, here, 0 if never else _suspicion(tag, names, attrs.get("role", "").lower(), here.within or (here.tag in ("article", "main") and not here.suspect)), never)
        here.parts.append(node)
        depth[tag] += 1
        if tag in CONTAINERS:
            containers.append(node)
        here = node
    _weigh(root)
    _judge(root)
    _measure(root)
    return root, [c for c in containers if not c.noise]


def _weigh(root: Node) -> None:
    """Prose, articles and headings of every node outside what is never content."""
    stack = [(root, False, iter(root.parts))]
    while stack:
        node, linked, parts = stack[-1]
        for part in parts:
            if isinstance(part, str):
                if not linked:
                    node.prose += len(part) - part.count(" ") - part.count("\n")
            elif not part.noise:
                stack.append((part, linked or part.tag == "a", iter(part.parts)))
                break
        else:
            stack.pop()
            if stack:
                above = stack[-1][0]
                above.prose += node.prose
                above.holds |= node.holds or (node.tag in ("article", "main") and not node.suspect)
                above.headed |= node.headed or node.tag == "h1"


def _judge(root: Node) -> None:
    """Makes noise of the suspect parts that hold too little to be content, and of all that is inside noise."""
    whole = root.prose

    def content(node: Node) -> bool:
        if node.holds:
            return True
        if node.prose < MOST * whole or node.suspect & READERS:
            return False
        return node.headed or node.suspect == LOOSE

    # where all prose is suspect it is taken all the same, comments of readers last
    for may_stay in (content, lambda node: not node.suspect & READERS, lambda node: True):
        if _sweep(root, may_stay) or not whole:
            break


def _sweep(root: Node, content) -> int:
    """Sets noise by what ``content`` says of suspect parts; returns the characters of prose outside noise."""
    kept, stack = 0, [(root, False, False)]
    while stack:
        node, lost, linked = stack.pop()
        for part in node.parts:
            if isinstance(part, str):
                if not lost and not linked:
                    kept += len(part.strip())
                continue
            never = part.tag in NEVER or part.tag == "head"
            part.noise = lost or never or bool(part.suspect and not content(part))
            stack.append((part, part.noise, linked or part.tag == "a"))
    return kept


def _measure(root: Node) -> None:
    stack = [(root, False, iter(root.parts))]
    while stack:
        node, linked, parts = stack[-1]
        for part in parts:
            if isinstance(part, str):
                n = len(part) - part.count(" ")
                node.text += n
                node.linked += n * linked
            elif not part.noise:
                stack.append((part, linked or part.tag == "a", iter(part.parts)))
                break
        else:
            stack.pop()
            if stack:
                stack[-1][0].text += node.text
                stack[-1][0].linked += node.linked


def scored(root: Node, containers: list[Node]) -> list[tuple[float, Node]]:
    """Containers by score, best first: the innermost one with most of the page's text outside links, or an article or
    main part around it, or else the containers around it as far as they add prose; the score is its share of that
    text."""
    whole = root.text - root.linked
    if whole <= 0:
        return []
    full = [c for c in containers if c.text - c.linked >= SHARE * whole]
    best = full[-1] if full else max(containers, key=lambda c: c.text - 2 * c.linked, default=None)
    if best is None:
        return []
    node = best
    while node is not None:
        if node.tag in ("article", "main") and not node.noise:
            best = node
            break
        node = node.parent
    else:
        node = best.parent
        while node is not None and node.tag not in ("body", "html", ""):
            more, links = node.text - best.text, node.linked - best.linked
            if node.label and not node.noise and more >= ADDED * best.text and links <= LINKED * more:
                best = node
            node = node.parent
    return [((best.text - best.linked) / whole, best)]


def text_of(nodes: list[Node]) -> str:
    """Text of the nodes outside noise; blocks joined by one space."""
    out: list[str] = []
    for top in nodes:
        stack = [iter(top.parts)]
        tags = [top.tag]
        out.append(" ")
        while stack:
            for part in stack[-1]:
                if isinstance(part, str):
                    out.append(_html.unescape(part))
                elif not part.noise:
                    if part.tag not in INLINE:
                        out.append(" ")
                    stack.append(iter(part.parts))
                    tags.append(part.tag)
                    break
            else:
                stack.pop()
                if tags.pop() not in INLINE:
                    out.append(" ")
    return " ".join("".join(out).split())


def extract(page: str, path: str | None) -> str:
    root, containers = parse(page)
    chosen: list[Node] = []
    if path:
        digest = path_digest(path)
        chosen = [c for c in containers if c.digest == digest]  # no container lies in another one on the same path
        if not any(c.text for c in chosen):
            chosen = []
    if not chosen:
        chosen = [c for _, c in scored(root, containers)] or [root]
    return text_of(chosen)


def _votes(batches):
    votes: Counter = Counter()
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.int64())])

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], schema=schema)
        votes.clear()
        return out

    for batch in common.small(batches):
        for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
            for share, c in scored(*parse(page or "")):
                votes[host, c.path()] += round(1000 * share)  # whole numbers: sums don't depend on their order
        if len(votes) > 100_000:
            yield rows()
    yield rows()


def _extract(batches):
    for batch in common.small(batches):
        texts = [extract(page or "", path) for page, path in zip(batch["html"].to_pylist(), batch["path"].to_pylist())]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_of(url) -> "F.Column":
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def paths(pages: DataFrame) -> DataFrame:
    """host, path: the winning path of each host; ties go to the first in order."""
    summed = common.map_arrow(pages.select("host", "html"), _votes, "host string, path string, votes bigint").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return summed.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("w")).select("host", "w.path")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    won = common.materialize(paths(pages), "paths")
    texts = common.map_arrow(pages.join(common.bounded(won, 200_000), "host", "left").select("page_id", "url", "html", "path"), _extract, "page_id bigint, url string, text string")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
