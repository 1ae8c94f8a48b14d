"""Main text of web pages by consensus of a host's pages.

1. Each page is read once into blocks of text and the containers around them. A container's score is the text of its
   blocks less their link text, less what looks like page furniture inside it, with a slight preference for depth and
   for ``article`` and ``main``.
2. A page votes for its best containers' paths: tags and classes from the root, with digits in class names replaced.
   The best gets a whole vote, each further one a quarter of the one before.
   Votes are summed by host and path in Spark, after each batch has summed its own; the host's path is the one with
   most votes (ties: the first by text).
3. Each page is read again and the text is taken from the containers on its host's path. A page without such a
   container, or without text in it, uses its own best container.

Furniture inside the winning container (menus, asides, forms, adverts, notices, reader comments, hidden parts) is left
out. Tags and roles tell it; a class name or id only makes an element a suspect, by its words and not if it tells of a
state (``has-sidebar``, ``comments-off``). A suspect that holds the article, a heading of the first order or nearly all text
of the page isn't furniture, and one under an ambiguous name (``social``, ``share``) only if it is short or mostly links. Null or empty html gives an empty text. A null url, or one without a host, belongs to the host ''. Repeated rows
are pages like any others (they vote each). An empty table gives an empty result. Other columns are ignored. No page
is cut; memory is one batch of pages. The table of winning paths is broadcast if it has at most ``BROADCAST_HOSTS``
rows and joined by a shuffle otherwise.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settle, task_batches

BROADCAST_HOSTS = 50_000

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|object)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CONTAINER = frozenset("html body main article section div td center".split())
#: An opening tag of the key closes an open element of the value, unless one of SCOPE lies between.
CLOSES = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option"}
SCOPE = frozenset("ul ol dl table article section div body main".split())
FURNITURE_TAGS = frozenset("head header nav footer aside form button dialog menu fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Words of class names and ids that name furniture by themselves, and those that articles are about as well.
NAMED = re.compile(
    r"ads?|adverts?|advertis\w*|sponsor\w*|promos?|banner|sidebar|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|cookies?|consent|gdpr|notices?"
    r"|popup|newsletter|subscribe|comments?|commentlist|disqus|widgets?|toolbar|pagination|pager|login|signup", re.I,
)
AMBIGUOUS = re.compile(r"promotions?|alerts?|modal|overlay|subscription|share|sharing|social|related|recommend\w*|replies|reply|respond|header|search", re.I)
#: Words that make a name tell of a state ("has-sidebar", "comments-off") or a subject ("share-of-income"), not of a part.
STATES = frozenset("has have no not non with without off on of is are and or the for free open opened closed enabled disabled hidden collapsed active".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: An element under an ambiguous name is furniture if its text is shorter than this or a third of it is links.
SHORT = 140
#: Elements of running text: their classes don't make them furniture.
TEXT_TAGS = frozenset("html body article main p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split())
#: Characters of a path; the upper part of a longer one is replaced by its digest.
PATH = 400
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
DIGITS = re.compile(r"\d+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


SURE = -1


def suspicion(names: str) -> int:
    """2 if a class name or id names furniture, 1 if one may, 0 if none does."""
    found = 0
    for name in names.split():
        words = WORDS.findall(name)
        if not any(w.lower() in STATES for w in words):
            # "side-bar" and "nav-bar" are their words together.
            some = [*words, *[a + b for a, b in zip(words, words[1:], strict=False)]]
            found = max(found, 2 if any(map(NAMED.fullmatch, some)) else 1 if any(map(AMBIGUOUS.fullmatch, some)) else 0)
    return found


class Page:
    """Blocks in page order as (container, text, letters in links, furniture?) and containers as (parent, path, depth, tag).

    While it is read, a block's last field is SURE, 0, or the number of the innermost suspect (an element whose names
    sound like furniture) that it is in; what a suspect holds decides about it once the page is known.
    """

    def __init__(self, html: str):
        self.nodes: list[tuple[int, str, int, str]] = [(-1, "", 0, "")]
        self.blocks: list[tuple[int, str, int, int]] = []
        self.suspects: list[list] = [[0, 2, False]]  # the suspect around, its suspicion, whether it holds an article
        stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, container, furniture, inside a link
        parts: list[str] = []
        link, at = 0, 0

        def flush() -> None:
            nonlocal link
            if parts:
                text = "".join(parts)
                if "&" in text:
                    text = unescape(text)
                if text := " ".join(text.split()):
                    self.blocks.append((stack[-1][1], text, link, stack[-1][2]))
                parts.clear()
            link = 0

        def cut(depth: int) -> None:
            if any(x[0] not in INLINE for x in stack[depth:]) or stack[depth - 1][1:3] != stack[-1][1:3]:
                flush()
            del stack[depth:]

        def find(tag: str, scope: frozenset = frozenset()) -> int:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    return i
                if stack[i][0] in scope:
                    break
            return 0

        for m in MARKUP.finditer(html):
            if m.start() > at:
                parts.append(html[at : m.start()])
                if stack[-1][3]:
                    link += m.start() - at
            at = m.end()
            if m[3] is None:
                continue
            tag = m[3].lower()
            if tag == "br":
                parts.append(" ")
            elif m[2]:
                if i := find(tag):
                    cut(i)
                elif tag not in INLINE:
                    flush()
            elif tag in VOID:
                if tag == "hr":
                    flush()
            else:
                inline = tag in INLINE
                if not inline:
                    if i := find("p", SCOPE):
                        cut(i)
                    if tag in CLOSES and (i := max(find(tag, SCOPE - {tag}), find(CLOSES[tag], SCOPE - {CLOSES[tag]}))):
                        cut(i)
                    flush()
                self.open(tag, m[4], stack, flush)
                if m[4].endswith("/") and inline:
                    stack.pop()
        if at < len(html):
            parts.append(html[at:])
        flush()
        self.judge()

    def judge(self) -> None:
        """Decides about suspects: never one that holds an article or nearly all text; an ambiguous one by its length and links."""
        size, links = [0] * len(self.suspects), [0] * len(self.suspects)
        for _, text, link, mark in self.blocks:
            if mark != SURE:
                size[mark] += len(text)
                links[mark] += link
        for k in range(len(size) - 1, 0, -1):
            size[self.suspects[k][0]] += size[k]
            links[self.suspects[k][0]] += links[k]
        guilty = [False] * len(size)
        for k, (around, suspected, article) in enumerate(self.suspects):
            own = k > 0 and not article and 10 * size[k] <= 9 * size[0] and (suspected == 2 or size[k] < SHORT or 3 * links[k] >= size[k])
            guilty[k] = own or guilty[around]
        self.blocks = [(node, text, link, mark == SURE or guilty[mark]) for node, text, link, mark in self.blocks]

    def open(self, tag: str, attributes: str, stack: list, flush) -> None:
        _, node, furniture, linked = stack[-1]
        names = ""
        if furniture != SURE and tag in FURNITURE_TAGS:
            furniture = SURE
        elif furniture > 0 and tag in ("article", "main", "h1"):
            k = furniture
            while k:
                self.suspects[k][2] = True
                k = self.suspects[k][0]
        if attributes and not attributes.isspace():
            got = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attributes)}
            names = got.get("class", "")
            if furniture != SURE:
                if "hidden" in got or got.get("aria-hidden") == "true" or got.get("role") in FURNITURE_ROLES or HIDDEN.search(got.get("style", "")):
                    furniture = SURE
                    flush()
                elif tag not in TEXT_TAGS and (suspected := suspicion(f"{names} {got.get('id', '')}")):
                    self.suspects.append([furniture, suspected, False])
                    furniture = len(self.suspects) - 1
                    flush()
        if tag in CONTAINER:
            step = ".".join([tag, *sorted({DIGITS.sub("#", x) for x in names.split()})])
            _, above, depth, _ = self.nodes[node]
            if len(above) > PATH:
                above = "#" + hashlib.sha256(above.encode("utf-8", "surrogatepass")).hexdigest()
            self.nodes.append((node, f"{above}>{step}", depth + 1, tag))
            node = len(self.nodes) - 1
        stack.append((tag, node, furniture, linked or tag == "a"))

    def scores(self) -> list[float]:
        own = [0.0] * len(self.nodes)
        for node, text, link, furniture in self.blocks:
            own[node] += -0.5 * len(text) if furniture else len(text) - 2.0 * min(link, len(text))
        for i in range(len(own) - 1, 0, -1):
            own[self.nodes[i][0]] += own[i]
        out = []
        for (_, _, depth, last), score in zip(self.nodes, own, strict=True):
            out.append(score * (1 + 0.01 * depth + 0.1 * (last in ("article", "main"))) if score > 0 else score)
        return out

    def votes(self) -> list[tuple[str, int]]:
        """Paths with their votes in millionths, as far as there is a whole millionth."""
        best: dict[str, float] = defaultdict(float)
        for (_, path, _, _), score in zip(self.nodes, self.scores(), strict=True):
            if path and score > best[path]:
                best[path] = score
        top = sorted(((s, p) for p, s in best.items() if s > 0), key=lambda x: (-x[0], x[1]))
        return [(p, vote) for k, (_, p) in enumerate(top) if (vote := 1_000_000 >> 2 * k)]

    def text(self, path: str | None) -> str:
        chosen = {i for i, node in enumerate(self.nodes) if node[1] == path} if path else set()
        found = self.inside(chosen)
        if not found:
            scores = self.scores()
            found = self.inside({max(range(len(scores)), key=lambda i: (scores[i], -i))})
        if not found:
            found = [b[1] for b in self.blocks if not b[3]]
        return "\n".join(found)

    def inside(self, chosen: set[int]) -> list[str]:
        held = [False] * len(self.nodes)
        for i, (parent, *_) in enumerate(self.nodes):
            held[i] = i in chosen or parent >= 0 and held[parent]
        return [text for node, text, _, furniture in self.blocks if held[node] and not furniture]


def count_votes(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in task_batches(batches, "main_text"):
        sums: dict[tuple[str, str], int] = defaultdict(int)
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            for path, vote in Page(html.as_py() or "").votes():
                sums[host, path] += vote
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["host", "path", "votes"])


def extract(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in task_batches(batches, "main_text"):
        texts = [Page(html.as_py() or "").text(path) if html.is_valid else "" for html, path in zip(batch.column("html"), batch.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), batch.column("path")], names=["page_id", "url", "text", "n_chars", "path"])


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path with most votes of each host."""
    votes = pages.select(host_of("url").alias("host"), "html").transform(map_arrow, count_votes, "host string, path string, votes long")
    summed = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path (the host's; null if no page of the host had text)."""
    winners = settle(host_paths(pages))
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    with_path = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", host_of("url").alias("host")).join(winners, "host", "left")
    return with_path.select("page_id", "url", "html", "path").transform(map_arrow, extract, "page_id long, url string, text string, n_chars long, path string")
