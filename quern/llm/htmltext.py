"""Main text of web pages by template deduction over equivalence classes, within the roles of elements.

1. A page is a sequence of differentiated tokens: tags by the path of their elements and their classes, stretches of text by path and whole text.
2. Tokens of a host that share one occurrence vector - as often as each other on every page - form an equivalence class, if enough of the
host's pages have them. Pages whose text is equal by roles alone are one page here, so that copies of a page are no evidence.
3. Classes hold page by page. Ordered: a class's tokens come in its order, round by round; of one that comes once and out of order, the longest
part in order holds. Nested: a round that straddles tokens of the class around it is cut there into pieces.
4. A text is template if its class holds there with a tag of the same piece before it and one after. All other text lies in the slots between.
5. Roles: a block in a menu, header, footer, sidebar, notice, advert, form or comment section goes, by fixed lists of tags, class words and
roles; on a page with an article (or else a main) element only the blocks inside it count.
6. Of these, a block outside articles goes if all its text is template. Authors repeat themselves, so inside an article a box goes only as a whole: an element
(other than a paragraph, heading or the like without a class) whose tag and texts are of one piece of a class of `least_inside` pages.
An article of which nothing would be left stays. The others, block by block in page order, are the main text.

An occurrence vector is held as the XOR of a hash of (page, count) over the pages, so classes come from one aggregation
whose partial sums combine on the map side; nothing is gathered by host except templates, which are bounded by a page's
tokens over the support. Templates are joined to pages by host: broadcast up to a number of tokens, beyond it by a join on (host, salt).

Null or empty html gives the empty text; a null url has the host ''; a host with one page has no template, and its page is
cut by the roles of elements alone; repeated page ids each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, slices, texts

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|(\Z))""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[\s_-]+")

# Kinds of elements.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math canvas audio video object select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var ruby rt rp label br wbr img td th".split())
AWAY = frozenset("nav header footer aside form head button dialog menu fieldset".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",)}
SCOPE = frozenset("ul ol dl table tbody thead tfoot html body article main section div nav aside header footer form blockquote".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr blockquote pre figcaption caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
NAMES = frozenset(
    "nav navbar navigation menu menubar submenu sidebar side aside footer foot header masthead topbar ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments reply replies respond disqus widget toolbar search form copyright".split()
)


SHOWN = 240  # characters of a token's label that are kept for display; tokens are told apart by the hash of the whole


def _away(name: str, attrs: str, inside: bool) -> bool:
    """Whether the element's place is not the main text's."""
    if name in ("article", "main", "body", "html"):
        if name != "article" or not attrs:
            return False
    elif name in AWAY:
        return not (name == "header" and inside)
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key in ("class", "id"):
            words = [w for w in _WORDS.split(value) if w]
            if name == "article" and words and words[0] not in ("comment", "reply", "ad", "advert", "promo", "related"):
                continue
            if not NAMES.isdisjoint(words):
                return True
    return False


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@lru_cache(100_000)
def _tag(*parts) -> int:
    return _hash(*parts)


def _classes(attrs: str) -> str:
    """The words of the class attribute, sorted."""
    return next((" ".join(sorted(m[2].strip("\"'").lower().split())) for m in _ATTR.finditer(attrs) if m[1].lower() == "class" and m[2]), "")


def clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


TAG, TEXT = 0, 1


class Page:
    """Tokens, blocks and boxes of a page.

    tokens: (hash, kind) in page order, labels: theirs for display; blocks: (text, in an article, in a main, away, places of its text tokens);
    boxes: (place of its tag, its first block, the one after its last) of elements inside articles, inner ones first."""

    def __init__(self, source: str):
        self.tokens: list[tuple[int, int]] = []
        self.labels: list[tuple] = []
        self.blocks: list[tuple[str, bool, bool, bool, list[int]]] = []
        self.boxes: list[tuple[int, int, int]] = []
        self.stack: list[tuple] = []  # name, away, hash of the path, classes, and of a possible box: the place of its tag and its first block
        self.parts: list[str] = []
        self.places: list[int] = []
        at = 0
        while m := _TOKEN.search(source, at):
            self.text(source[at : m.start()])
            at = m.end()
            if (name := m[2]) is None:
                continue
            if m[4] is not None:  # the page ends inside a tag
                break
            name = name.lower()
            if m[1]:
                self.end(name)
                continue
            self.start(name, m[3])
            if name in RAW and not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else len(source)
        else:
            self.text(source[at:])
        self.flush()
        self.close(0)

    def inside(self, name: str) -> bool:
        return any(e[0] == name for e in self.stack)

    def text(self, raw: str) -> None:
        if not raw:
            return
        if not raw.isspace() and (text := clean(raw)):
            self.places.append(len(self.tokens))
            self.token(_hash(self.path(), text), TEXT, text)
        self.parts.append(raw)

    def token(self, value: int, kind: int, *label: str) -> None:
        self.tokens.append((value, kind))
        self.labels.append((self.stack[-1][0] if self.stack else "", *label))

    def path(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def flush(self) -> None:
        if self.parts and (text := clean("".join(self.parts))):
            self.blocks.append((text, self.inside("article"), self.inside("main"), any(e[1] for e in self.stack), self.places))
        self.parts, self.places = [], []

    def start(self, name: str, attrs: str) -> None:
        if name in RAW:
            return
        if name in INLINE:
            if name in ("br", "td", "th"):
                self.parts.append(" ")
            return
        self.flush()
        if name in CLOSES_P:
            self.pop("p", SCOPE)
        for other in SAME.get(name, ()):
            self.pop(other, SCOPE)
        away = _away(name, attrs, self.inside("article"))
        if name in VOID:
            return
        path, classes = _tag(self.path(), name), _classes(attrs)
        box = self.inside("article") and (classes != "" or name not in FLOW)
        self.stack.append((name, away, path, classes, len(self.tokens) if box else -1, len(self.blocks)))
        self.token(_tag("<", path, classes, away), TAG, "<", classes)

    def pop(self, name: str, scope: frozenset) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                self.close(i)
                return
            if self.stack[i][0] in scope:
                return

    def end(self, name: str) -> None:
        if name in INLINE or name in RAW or name in VOID:
            return
        self.flush()
        i = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name), -1)
        if i >= 0:
            self.token(_tag("</", self.path(), name, self.stack[i][3]), TAG, "</", name)
            self.close(i)

    def close(self, i: int) -> None:
        """Ends the i-th open element and those in it."""
        while len(self.stack) > i:
            *_, place, first = self.stack.pop()
            if place >= 0 and first < len(self.blocks):
                self.boxes.append((place, first, len(self.blocks)))

    def main_text(self, template: Template | None = None, least_inside: int = 3) -> str:
        """Blocks of the slots that count, one to a line."""
        article = any(b[1] and not b[3] for b in self.blocks)
        kept = [i for i, b in enumerate(self.blocks) if not b[3] and (b[1] or not article)]
        if not article:
            kept = [i for i in kept if self.blocks[i][2]] or kept
        if template is not None and template.classes:
            held = template.held(self.tokens)
            if article:
                there, gone = set(kept), set()
                for place, first, end in self.boxes:
                    piece = held.get(place)
                    if piece is not None and template.pages[piece[0]] >= least_inside:
                        own = [i for i in range(first, end) if i in there]
                        if all(held.get(p) == piece for i in own for p in self.blocks[i][4]):
                            gone.update(own)
                kept = [i for i in kept if i not in gone] or kept
            else:
                kept = [i for i in kept if any(p not in held for p in self.blocks[i][4])]
        return "\n".join(self.blocks[i][0] for i in kept)


class Template:
    """The equivalence classes of a host: (name, the name of the one around it or -1, pages, hashes of its tokens in order)."""

    def __init__(self, classes):
        names = {c[0]: i for i, c in enumerate(classes)}
        self.parents = [names.get(c[1], -1) for c in classes]
        self.pages = [c[2] for c in classes]
        self.classes = [list(c[3]) for c in classes]
        self.rank = {token: (i, r) for i, c in enumerate(self.classes) for r, token in enumerate(c)}
        self.size = len(self.rank)

    def held(self, tokens: list[tuple[int, int]]) -> dict[int, tuple[int, int, int]]:
        """The pieces (class, round, slot of the class around it) that hold on a page, by the places of their tags and of the texts between these."""
        found: dict[int, list[tuple[int, int]]] = {}
        for place, (token, _) in enumerate(tokens):
            if (known := self.rank.get(token)) is not None:
                found.setdefault(known[0], []).append((place, known[1]))
        places: dict[int, list[int]] = {}
        for c, at in found.items():
            n = len(self.classes[c])
            if len(at) % n == 0 and all(r == i % n for i, (_, r) in enumerate(at)):
                places[c] = [p for p, _ in at]
            elif len({r for _, r in at}) == len(at):
                places[c] = _in_order(at)
        out = {}
        for c, at in places.items():
            around = places.get(self.parents[c], [])
            pieces: dict[tuple, list[int]] = {}
            for i, p in enumerate(at):
                pieces.setdefault((c, i // len(self.classes[c]), bisect_left(around, p)), []).append(p)
            for piece, own in pieces.items():
                tags = [p for p in own if tokens[p][1] == TAG]
                if len(tags) > 1:
                    out.update((p, piece) for p in own if tags[0] <= p <= tags[-1])
        return out


def _in_order(at: list[tuple[int, int]]) -> list[int]:
    """The places of a longest part of (place, rank) whose ranks grow."""
    ranks: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, (_, r) in enumerate(at):
        k = bisect_left(ranks, r)
        before.append(ends[k - 1] if k else -1)
        ranks[k : k + 1], ends[k : k + 1] = [r], [i]
    out, i = [], ends[-1]
    while i >= 0:
        out.append(at[i][0])
        i = before[i]
    return out[::-1]


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _prepared(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    return pages.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{url}`").alias("_url"), F.col(f"`{html}`").cast("string").alias("_text"), host(F.col(f"`{url}`")).alias("_host"))


def page_tokens(pages: DataFrame, labels: bool = False) -> DataFrame:
    """(host, a, b, tokens) of each page with another text by roles, which a and b are hashes of; pages: from _prepared."""
    schema = "_host string, a long, b long, tokens array<struct<token: long, n: int, place: double, label: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            a, b, every = [], [], []
            for source in texts(batch, "_text"):
                page = Page(source)
                digest = hashlib.blake2b(page.main_text().encode("utf-8", "replace"), digest_size=16).digest()
                a.append(int.from_bytes(digest[:8], "little", signed=True))
                b.append(int.from_bytes(digest[8:], "little", signed=True))
                found: dict[int, list] = {}
                for i, (token, _) in enumerate(page.tokens):
                    if token in found:
                        found[token][1] += 1
                    else:
                        found[token] = [token, 1, i / len(page.tokens), " ".join(page.labels[i])[:SHOWN] if labels else None]
                every.append(list(found.values()))
            flat = list(zip(*(t for tokens in every for t in tokens))) or [()] * 4
            members = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, MEMBER)], fields=list(MEMBER))
            offsets = [0]
            for tokens in every:
                offsets.append(offsets[-1] + len(tokens))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), members)
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists], names=["_host", "a", "b", "tokens"])

    # of pages that differ by template alone the same one wherever the rows lie
    return pages.mapInArrow(run, schema).groupBy("_host", "a", "b").agg(F.min_by("tokens", F.xxhash64("tokens")).alias("tokens"))


MEMBER = pa.struct([("token", pa.int64()), ("n", pa.int32()), ("place", pa.float64()), ("label", pa.string())])


def deduce(pages: DataFrame, support: float = 0.5, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The valid classes of each host: their tokens by place, and the class in whose span each nests (-1: none)."""
    return _deduce(_prepared(pages, key, url, html), support, labels=True)


def _deduce(prepared: DataFrame, support: float, labels: bool = False) -> DataFrame:
    every = checkpoint(page_tokens(prepared, labels))
    sizes = every.groupBy("_host").agg(F.count("*").alias("all"))
    counts = every.select("_host", "a", "b", F.inline("tokens")).groupBy("_host", "token").agg(
        F.min("label").alias("label"), F.bit_xor(F.xxhash64("a", "b", "n")).alias("vector"), F.count("*").alias("pages"), F.sum("n").alias("times"), F.sum("place").alias("place")
    )
    tokens = counts.join(sizes, "_host").where((F.col("pages") >= 2) & (F.col("pages") >= support * F.col("all")))
    member = F.struct((F.col("place") / F.col("pages")).alias("place"), F.col("token").alias("token"), F.col("label").alias("label"))
    classes = tokens.groupBy("_host", "vector", "pages", "times").agg(F.sort_array(F.collect_list(member)).alias("tokens"))  # bounded: a page's tokens / support
    span = F.struct(F.element_at("tokens", 1).getField("place").alias("first"), F.element_at("tokens", -1).getField("place").alias("last"), F.col("vector").alias("vector"), F.col("pages").alias("pages"), F.col("times").alias("times"), F.col("tokens").alias("tokens"))
    hosts = classes.groupBy("_host").agg(F.collect_list(span).alias("all"))

    def parent(c, every):
        wider = F.filter(every, lambda o: (o["first"] < c["first"]) & (o["last"] > c["last"]))
        return F.coalesce(F.array_min(F.transform(wider, lambda o: F.struct((o["last"] - o["first"]).alias("w"), o["vector"].alias("v")))).getField("v"), F.lit(-1))

    nested = F.transform("all", lambda c: F.struct(c["vector"].alias("class"), c["pages"].alias("pages"), c["times"].alias("times"), parent(c, F.col("all")).alias("parent"), c["tokens"].alias("tokens")))
    return hosts.select(F.col("_host").alias("host"), F.explode(nested).alias("c")).select("host", "c.*")


def extract(pages: DataFrame, support: float = 0.5, key: str = "page_id", url: str = "url", html: str = "html", broadcast_tokens: int = 200_000, salts: int = 64, least_inside: int = 3) -> DataFrame:
    """Rows of key, url, text and template_size: the number of template tokens that the page's host has."""
    p = _prepared(pages, key, url, html)
    member = F.struct(F.col("class"), F.col("parent"), F.col("pages"), F.transform("tokens", lambda t: t["token"]).alias("tokens"))
    templates = checkpoint(_deduce(p, support).groupBy("host").agg(F.collect_list(member).alias("_template")))
    total = templates.agg(F.sum(F.size(F.flatten("_template.tokens")))).first()[0] or 0
    t = templates.withColumnRenamed("host", "_host")
    if total <= broadcast_tokens:
        joined = p.join(F.broadcast(t), "_host", "left")
    else:
        salted = t.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = p.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int")).join(salted, ["_host", "_salt"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for batch in slices(batches, "_text"):
            out, sizes = [], []
            lists = batch.column(3)
            for i, (h, source) in enumerate(zip(batch.column(4).to_pylist(), texts(batch, "_text"))):
                if h not in known:
                    known = known if len(known) < 1000 else {}
                    known[h] = Template([tuple(c.values()) for c in lists[i].as_py() or ()])
                out.append(Page(source).main_text(known[h], least_inside))
                sizes.append(known[h].size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(sizes, pa.int32())], names=[key, url, "text", "template_size"])

    return joined.select("_key", "_url", "_text", "_template", "_host").mapInArrow(run, f"`{key}` {kinds['_key']}, `{url}` {kinds['_url']}, text string, template_size int")
