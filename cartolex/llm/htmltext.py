"""Main text of pages by deduction of their host's template.

A page is a sequence of structure tokens (an element with its path and classes)
and blocks of text. Tokens of a host whose occurrence vectors over its pages are
equal form an equivalence class. Classes that occur once a page on most pages are
valid; nested by their paths they are the host's template, and the innermost
template token around a block is the block's slot. Slots that the template or
the markup shows to be something else (menus, page headers and footers,
sidebars, notices, adverts, forms, reader comments, or the same text on every
page, or mostly links) are left out; what remains is the article. Article and
main elements are a hint: on a page with text in them, text elsewhere is out, and
text in them is judged by its slot. A block whose own tokens repeat on a page, as
paragraphs do, counts for the slot around them.

Vectors are compared by two sums over pages of a mixed hash of the page and the
token's count on it, so a host of any size is counted map-side and costs one row
per token. Pages find their host's slots by a broadcast where all slots are below
``SMALL`` bytes, which moves no page; else pages and slots are dealt by host, and
those of large hosts by salted hosts, and a worker reads a host's slots before its
pages.

Defined cases: a null or empty page has no text; markup that is not closed ends
with the page; a null or unparsable url is the host ""; repeated rows are pages
of their own, each counted; a null id is kept as null; extra columns are dropped;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared

SMALL, LARGE, MOST_LARGE = 16 << 20, 20_000, 10_000  # bytes of slots; pages of a large host; large hosts

# Element names of the HTML standard, and words that name what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math textarea select option iframe object canvas audio video title button datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
OUTSIDE = frozenset("nav footer aside form dialog head menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices notification alert sidebar side rail nav navbar navigation menu breadcrumb breadcrumbs pager pagination footer comment comments reply replies disqus respond share sharing social related recommended newsletter subscribe subscription signup popup modal overlay widget widgets skip toolbar".split())
HEADER_NAMES = frozenset("header masthead topbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*?)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PART = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")


class Block:
    """Text of one block: its path of (element, outside the article), whether it is in article or main, its length in links."""

    __slots__ = ("path", "outside", "inside", "parts", "linked")

    def __init__(self, path, outside, inside):
        self.path, self.outside, self.inside, self.parts, self.linked = path, outside, inside, [], 0

    def text(self) -> str:
        return _BLANK.sub(" ", "".join(self.parts)).strip()


def _kind(name: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """(token of an element, whether it is outside the article)"""
    label, words, role, hidden = name, set(), "", False
    for key, value in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "class" and value:
            label += "." + ".".join(sorted(value.split()))
        if key in ("class", "id"):
            words.update(_PART.findall(value))
        role = value if key == "role" else role
        hidden = hidden or key == "hidden" and value in ("", "hidden")
    outside = hidden or name in OUTSIDE or role in ROLES or bool(words & NAMES) and name not in ("body", "html", "article", "main")
    if not inside and name not in ("body", "html", "article", "main"):
        outside = outside or name == "header" or bool(words & HEADER_NAMES)
    return label, outside


def parse(page: str) -> tuple[list[str], list[Block]]:
    """(paths of elements in order, blocks of text in order)"""
    stack: list[tuple[str, str, bool, bool]] = []  # name, path, outside, inside
    paths, blocks, block, at, n = [], [], None, 0, len(page)

    def add(text: str) -> None:
        nonlocal block
        if not text:
            return
        path, outside, inside = stack[-1][1:] if stack else ("", False, False)
        if block is None:
            block = Block(path, outside, inside)
            blocks.append(block)
        elif outside != block.outside:
            block = Block(path, outside, inside)
            blocks.append(block)
        block.parts.append(text)
        if any(s[0] == "a" for s in stack):
            block.linked += len(text.strip())

    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            add(entities.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name not in INLINE:
            block = None
        if m[1]:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if name in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else n if name in ("script", "style", "title", "textarea") else at
            continue
        if name in VOID:
            continue
        if name in CLOSES_P and any(s[0] == "p" for s in stack):
            while stack.pop()[0] != "p":
                pass
        if name in ("li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
            stack.pop()
        path, outside, inside = stack[-1][1:] if stack else ("", False, False)
        label, own = _kind(name, m[3], inside)
        path = f"{path}/{label}"
        if name not in INLINE:
            paths.append(path)
        if m[3].endswith("/") and name not in ("p", "div", "span", "a", "li", "section", "article"):
            continue
        stack.append((name, path if name not in INLINE else (stack[-1][1] if stack else ""), outside or own, inside or name in ("article", "main")))
    return paths, blocks


def _hash(*x) -> int:
    s = "\0".join(map(str, x)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True)


def _mixed(page: int, count: int) -> int:
    """64 bits of a page and a count on it."""
    x = (page ^ count * 0x9E3779B97F4A7C15) & _ALL
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & _ALL
    x = (x ^ x >> 29) * 0xA0761D6478BD642F & _ALL
    return x ^ x >> 32


_ALL = (1 << 64) - 1


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_TOKENS = "host string, path string, pages long, high_sum long, low_sum long, one boolean, chars long, linked long, low long, high long, inside boolean"


def candidates(blocks: list[Block]) -> list[tuple[Block, str]]:
    """The blocks that the markup does not rule out, with their text: on a page with text in article or main, those in it."""
    said = [(b, t) for b in blocks if not b.outside and (t := b.text())]
    own = any(b.inside for b, _ in said)
    return [(b, t) for b, t in said if b.inside or not own]


def innermost(path: str, known) -> str:
    """The nearest of the path and those around it that is in ``known``; the root is "" always."""
    while path and path not in known:
        path = path.rpartition("/")[0]
    return path


def _tokens(batches):
    """Rows of structure tokens, summed over a batch. A block counts for the innermost token around it that is once on its page."""
    for b in batches:
        found: dict[tuple, list] = {}
        for page, url, text in zip(*(b.column(c).to_pylist() for c in ("key", "host", "html")), strict=True):
            paths, blocks = parse(text or "")
            if not paths and not blocks:
                continue
            counts: dict[str, int] = {"": 1}
            for p in paths:
                counts[p] = counts.get(p, 0) + 1
            once = {p for p, c in counts.items() if c == 1}
            texts: dict[str, list[tuple[Block, str]]] = {}
            for k, t in candidates(blocks):
                texts.setdefault(innermost(k.path, once), []).append((k, t))
            for p, c in counts.items():
                own = texts.get(p, [])
                row = found.setdefault((url, p), [0, 0, 0, True, 0, 0, (1 << 63) - 1, -(1 << 63), False])
                print_, here = _hash(*(t for _, t in own)), _mixed(page, c)
                row[0] += 1
                row[1] += here >> 32
                row[2] += here & 0xFFFFFFFF
                row[3] &= c == 1
                row[4] += sum(len(t) for _, t in own)
                row[5] += sum(k.linked for k, _ in own)
                row[6], row[7] = min(row[6], print_), max(row[7], print_)
                row[8] |= any(k.inside for k, _ in own)
        rows = [(u, p, *v) for (u, p), v in found.items()]
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [f.split()[0] for f in _TOKENS.split(", ")])


def slots_of(tokens: list[dict]) -> dict[str, bool]:
    """Whether the text in each template token of a host is left out, from the host's tokens (path, valid, pages, chars, linked, low, high, inside).

    Text of a token that is not valid is that of the innermost valid token around
    it. A slot is constant if each of the tokens whose text it has is on all of its
    pages with the same text. Slots in article or main are judged as the others,
    but where that would leave out all of them, as on a host of one repeated page,
    the element decides and they stay.
    """
    valid = {t["path"]: t["pages"] for t in tokens if t["valid"]}
    slots = {p: [0, 0, n >= 3, False] for p, n in valid.items()}  # chars, linked, constant, inside
    for t in tokens:
        if t["chars"]:
            p = innermost(t["path"], valid)
            own = slots.setdefault(p, [0, 0, False, False])
            own[0] += t["chars"]
            own[1] += t["linked"]
            own[2] &= t["low"] == t["high"] and t["pages"] == valid.get(p)
            own[3] |= t["inside"]
    out = {p: chars > 0 and (constant or 2 * linked > chars) for p, (chars, linked, constant, _) in slots.items()}
    inside = [p for p, s in slots.items() if s[3]]
    return out | dict.fromkeys(inside, False) if all(out[p] for p in inside) else out


_SLOTS = "host string, slots array<struct<path: string, out: boolean>>"


def _slots(batches):
    for b in batches:
        out = [[{"path": p, "out": o} for p, o in slots_of(tokens).items()] for tokens in b.column("tokens").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(out, pa.list_(pa.struct([("path", pa.string()), ("out", pa.bool_())])))], ["host", "slots"])


def templates(pages: DataFrame) -> DataFrame:
    """host, and ``slots``: its template tokens as (path, whether text in that slot is left out). ``pages``: key, host, html."""
    token = _shared.map_arrow(pages, _tokens, _TOKENS).groupBy("host", "path").agg(
        F.sum("pages").alias("pages"), F.sum("high_sum").alias("high_sum"), F.sum("low_sum").alias("low_sum"), F.bool_and("one").alias("one"), F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("inside").alias("inside"),
    )
    # Classes: tokens of a host of one vector. Valid: once a page, on at least half of the pages (those of the host's most frequent class).
    classes = token.groupBy("host", "high_sum", "low_sum").agg(
        F.max("pages").alias("support"), F.bool_and("one").alias("once"),
        F.collect_list(F.struct("path", "chars", "linked", "low", "high", "pages", "inside")).alias("tokens"),
    )
    host_ = classes.groupBy("host").agg(F.max("support").alias("all"), F.collect_list(F.struct("support", "once", "tokens")).alias("classes"))
    valid = lambda c: c["once"] & (2 * c["support"] >= F.col("all"))
    tokens = F.flatten(F.transform("classes", lambda c: F.transform(c["tokens"], lambda t: t.withField("valid", valid(c)))))
    # A token that is neither valid nor has text decides nothing.
    tokens = F.filter(tokens, lambda t: t["valid"] | (t["chars"] > 0))
    return _shared.map_arrow(host_.select("host", tokens.alias("tokens")), _slots, _SLOTS)


def article(page: str, slots: dict[str, bool]) -> str:
    """The blocks that lie in slots of the article, joined by spaces."""
    out = [t for b, t in candidates(parse(page)[1]) if not slots.get(innermost(b.path, slots), False)]
    return " ".join(out)


_RESULT = "page_id long, url string, text string, n_chars long"


def _result(page, url, out: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([page, url, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [f.split()[0] for f in _RESULT.split(", ")])


def _by_broadcast(slots):
    def run(batches):
        for b in batches:
            out = [article(text, slots.value.get(h, {})) for text, h in zip(b.column("html").to_pylist(), b.column("host").to_pylist(), strict=True)]
            yield _result(b.column("page_id"), b.column("url"), out)

    return run


def _by_host(batches):
    """Rows sorted by host, salt and kind: a host's slots (kind 0) before its pages."""
    now, slots = None, {}
    for b in batches:
        out, rows = [], []
        for i, (key, kind, text) in enumerate(zip(zip(b.column("host").to_pylist(), b.column("salt").to_pylist(), strict=True), b.column("kind").to_pylist(), b.column("html").to_pylist(), strict=True)):
            if key != now:
                now, slots = key, {}
            if kind == 0:
                slots |= {s["path"]: s["out"] for s in b.column("slots")[i].as_py() or ()}
            else:
                rows.append(i)
                out.append(article(text, slots))
        at = pa.array(rows, pa.int64())
        yield _result(b.column("page_id").take(at), b.column("url").take(at), out)


def extract(pages: DataFrame, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = _shared.materialize(templates(own.select(F.xxhash64("page_id", "url", "html").alias("key"), "host", "html")), "slots")
    size = found.agg(F.sum(F.octet_length("host") + F.aggregate("slots", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s["path"]) + 8))).first()[0] or 0
    if size <= small:
        slots = spark.sparkContext.broadcast({r["host"]: {s["path"]: s["out"] for s in r["slots"] or ()} for r in found.toLocalIterator()})
        return _shared.map_arrow(own, _by_broadcast(slots), _RESULT)
    # Hosts with more than their share of pages, MOST_LARGE at most, are dealt in salted parts.
    counts = own.groupBy("host").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(large, -(-total // MOST_LARGE))
    parts = counts.where(F.col("n") > share).select("host", F.ceil(F.col("n") / share).cast("int").alias("parts"))
    salted = lambda df, salt: df.join(F.broadcast(parts), "host", "left").withColumn("salt", salt(F.coalesce("parts", F.lit(1)))).drop("parts")
    rows = salted(own, lambda n: F.pmod(F.xxhash64("page_id", "url"), n).cast("int")).withColumn("kind", F.lit(1))
    heads = salted(found, lambda n: F.explode(F.sequence(F.lit(0), n - 1))).withColumn("kind", F.lit(0))
    both = rows.unionByName(heads, allowMissingColumns=True).select("host", "salt", "kind", "page_id", "url", "html", "slots")
    return _shared.map_arrow(both.repartition("host", "salt").sortWithinPartitions("host", "salt", "kind"), _by_host, _RESULT)


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
