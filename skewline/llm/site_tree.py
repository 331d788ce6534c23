"""Main text of web pages with a site style tree.

Pages of one host are merged into a tree: an element is known by its path of tags, classes and ids. For each element the
tree holds how its pages present it (the sequence of its children's tags, repeats joined) and which text blocks it holds.
Importance is entropy: an element that all pages present alike, or a block that nearly all of them repeat, says nothing;
for an element both are composed as (1 - g^l) presentation + g^l content, l being its number of presentations, g 0.9.
A host's say grows with its pages: importance is averaged with what elements of the same tag, classes and id, in a parent of
the same, have on all hosts, which counts as `BACKING` pages, so a host of one page is judged by the others. There every host
counts alike, up to once, and one more says that all is important.

A branch or block goes by its log-odds: what the tree says (`tree_odds`, from -3 to 5) and what the page says of itself, as a
prior. Elements with the tags or roles of menus, headers, footers, side bars, forms and notices, and link lists, start so low
that no importance lifts them; those that only a class or id names so start at `NAMED`, and stay if they are important and
hold most of the page's text, with all of its articles; those of an article, or the main element, start at `ARTICLE`. Where articles hold most of
the text, what lies outside them starts at `OUTSIDE`. Pages of a host that say the same, by their articles or else as a
whole, count as one page in the tree; where more than half of an article's text would be low, its pages are near copies of
each other, and all of it stays.

Scale: pages are parsed where they are; copies are folded, and counts of (host, element, what it shows) added up, on the
map side first, and dealt by what a page says and by element, so a host with a third of all pages is spread. The table of low
branches is broadcast only up to `MAX_BROADCAST` rows; beyond it each host's list goes once to every `HOST_PAGES` pages of it,
and pages stream past it.

Defined results: a null page or one without text gives an empty string; a null or odd url belongs to the host named by
the empty string; a null id stays null; repeated rows get a row each; an empty table gives an empty table; other columns
are not looked at. White space in a block, no-break spaces included, becomes one space; `<br>` is white space.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DECAY = 0.9
#: Pages that the average over all hosts counts as.
BACKING = 2.0
#: Priors, in log-odds.
NAMED = -6.0
MOST_OF_THE_TEXT = 3.0
ARTICLE = 2.0
OUTSIDE = -5.5
#: Importance that is listed: of branches, since it may still meet a low prior, and of blocks.
LISTED_BRANCH = 0.8
LISTED_BLOCK = 0.4
MAX_BROADCAST = 100_000
HOST_PAGES = 20_000
LINK_SHARE = 0.6
MOST = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select button object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: A start tag of the key ends an open element of the value, up to one of `WALLS`.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = frozenset("ul ol dl table article section main div body html aside nav header footer form td th".split())
DROPPED = frozenset("nav aside footer form dialog menu head".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog status".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets related recommended share sharing social notice notices cookie cookies consent gdpr alert banner popup modal overlay subscribe subscription newsletter signup login comment comments commentlist discussion reply replies respond disqus pagination pager toc skip".split()
)
#: Words that turn a name into a remark about its element: "has-sidebar" is none.
REMARKS = frozenset("has with without no not is enabled disabled free layout".split())
#: Names of parts that an article has itself.
OF_AN_ARTICLE = frozenset({"header", "masthead", "banner"})
ARTICLE_NAMES = frozenset({"article", "main"})

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def tree_odds(importance: float) -> float:
    return 8 * importance - 3


class Element:
    """`gone` says that no importance lifts the element or one around it; `named`, that its class or id names it as no content."""

    __slots__ = ("children", "gone", "in_article", "named", "own", "path", "tag")

    def __init__(self, tag: str, path: str, own: str, gone: bool, named: bool, in_article: bool):
        self.tag, self.path, self.own, self.gone, self.named, self.in_article = tag, path, own, gone, named, in_article
        self.children: list[str] = []


class Block:
    __slots__ = ("linked", "owner", "parts", "trail")

    def __init__(self, owner: Element, trail: tuple[Element, ...]):
        self.owner, self.trail, self.parts, self.linked = owner, trail, [], 0

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.parts)).split())


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def _is_gone(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    return attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"


def _is_named(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether a class or the id, as a whole or by its first or last word, names what isn't content."""
    if tag in ("body", "html"):
        return False
    for name in [*attributes.get("class", "").split(), attributes.get("id", "")]:
        words = [w.lower() for w in _NAME.findall(name)]
        if words and not REMARKS.intersection(words):
            found = NAMES.intersection((words[0], words[-1], "".join(words)))
            if found - (OF_AN_ARTICLE if in_article else frozenset()):
                return True
    return False


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks in page order, and the elements that hold them. Unclosed and crossed tags end where their parents do."""
    root = Element("", "", "", False, False, False)
    stack, elements, blocks = [root], [root], []
    block: Block | None = None
    at, links = 0, 0

    def text(part: str) -> None:
        nonlocal block
        if not part:
            return
        if block is None:
            if part.isspace():
                return
            block = Block(stack[-1], tuple(stack))
            blocks.append(block)
        block.parts.append(part)
        if links:
            block.linked += len(part)

    def close(n: int) -> None:
        nonlocal block
        if len(stack) > n:
            del stack[n:]
            block = None

    while True:
        m = _TOKEN.search(page, at)
        text(page[at : m.start() if m else len(page)])
        if not m:
            return blocks, elements
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ends, raw = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if tag == "a":
            links = 0 if ends else 1
            continue
        if ends:
            if tag in BLOCK:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                block = None
            continue
        if tag in RAW and not (raw or "").rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag in ("script", "style") or end:
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if tag not in BLOCK or tag == "hr":
            if tag in ("hr",):
                block = None
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in WALLS:
                    break
        if tag in ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ENDS[tag]:
                    close(i)
                    break
                if stack[i].tag in WALLS - ENDS[tag] and not (tag == "tr" and stack[i].tag in ("td", "th")):
                    break
        block = None
        parent = stack[-1]
        if tag in ("html", "body") and any(e.tag == tag for e in stack):
            continue
        attributes = _attributes(raw)
        own = tag + "".join(f".{c}" for c in sorted(attributes.get("class", "").split())) + (f"#{attributes['id']}" if attributes.get("id") else "")
        gone = parent.gone or _is_gone(tag, attributes, parent.in_article)
        is_article = not gone and (tag in ARTICLE_NAMES or attributes.get("role") == "main" or bool({"article", "post", "entry"}.intersection(attributes.get("class", "").lower().split())))
        element = Element(tag, f"{parent.path}>{own}", f"{parent.path.rpartition('>')[2]}>{own}", gone, _is_named(tag, attributes, parent.in_article), parent.in_article or is_article)
        if not parent.children or parent.children[-1] != own:
            parent.children.append(own)
        stack.append(element)
        elements.append(element)


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


def host_of(url: str | None) -> str:
    m = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _prior(e: Element) -> float:
    return NAMED if e.named else ARTICLE if e.in_article else 0.0


def page_nodes(page: str) -> tuple[int, list[tuple[int, int, bool, int]]]:
    """What a page says, hashed (its article, or all of it without one), and (element, what it shows, whether that is a block, its own and its parent's tag, classes and id) of its own part of the tree, in order."""
    blocks, elements = parse(page)
    shown = [(b.owner, b.text()) for b in blocks if not b.owner.gone]
    article = [t for e, t in shown if e.in_article and t]
    out = {(_hash(e.path), _hash(" ".join(e.children)), False, _hash(e.own)) for e in elements if e.children and not e.gone}
    out |= {(_hash(e.path), _hash(t), True, _hash(e.own)) for e, t in shown}
    return _hash("\n".join(article or [t for _, t in shown])), sorted(out)


Low = dict[tuple[int, int], float]


def main_text(page: str, low: Low) -> str:
    """The page without branches and blocks of low log-odds; `low` has the importance of (element, 0) for branches and (element, block) for blocks, where it isn't high."""
    blocks, _ = parse(page)
    shown = [(b, t) for b in blocks if not b.owner.gone and (t := b.text())]
    total, within, articles = sum(len(t) for _, t in shown), Counter(), Counter()
    lists: Counter[str] = Counter()
    linked: Counter[str] = Counter()
    for b, t in shown:
        for e in b.trail:
            within[id(e)] += len(t)
            if b.owner.in_article:
                articles[id(e)] += len(t)
        if b.owner.tag == "li":
            lists[b.owner.path] += len(t)
            linked[b.owner.path] += min(len(t), b.linked)
    in_articles = sum(len(t) for b, t in shown if b.owner.in_article)
    keys: dict[str, int] = {}

    def key(e: Element) -> int:
        if e.path not in keys:
            keys[e.path] = _hash(e.path)
        return keys[e.path]

    branch: dict[int, bool] = {}

    def stays(e: Element) -> bool:
        if id(e) not in branch:
            whole = within[id(e)] > MOST * total and articles[id(e)] == in_articles
            most = MOST_OF_THE_TEXT if e.named and whole else 0.0
            branch[id(e)] = _prior(e) + most + tree_odds(low.get((key(e), 0), 1.0)) > 0
        return branch[id(e)]

    shown = [(b, t) for b, t in shown if all(stays(e) or (e.in_article and not e.named) for e in b.trail)]
    is_low = [low and _prior(b.owner) + (MOST_OF_THE_TEXT if b.owner.named else 0.0) + tree_odds(low.get((key(b.owner), _hash(t)), 1.0)) <= 0 for b, t in shown]
    article = [len(t) for b, t in shown if b.owner.in_article]
    copied = 2 * sum(len(t) for (b, t), x in zip(shown, is_low, strict=True) if x and b.owner.in_article) > sum(article)
    has_most = sum(article) > MOST * sum(len(t) for _, t in shown)
    out = []
    for (b, t), x in zip(shown, is_low, strict=True):
        e = b.owner
        if e.in_article:
            if not x or copied:
                out.append(t)
            continue
        listed = e.tag == "li" and linked[e.path] > LINK_SHARE * lists[e.path]
        if not x and not listed and (OUTSIDE if has_most else 0.0) + tree_odds(1.0) > 0:
            out.append(t)
    return "\n".join(out)


def tree_counts(pages: DataFrame) -> DataFrame:
    """(host, element, shows, is_block, own, n): distinct pages of a host by what an element of theirs shows.

    Pages of a host that say the same are one, that with the least nodes in order.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[str, int], list] = {}
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                says, nodes = page_nodes(page or "")
                key = (host_of(url), says)
                held[key] = min(held.get(key, nodes), nodes)
            flat = list(zip(*(x for nodes in held.values() for x in nodes))) or [[]] * 4
            kinds = {"element": pa.int64(), "shows": pa.int64(), "is_block": pa.bool_(), "own": pa.int64()}
            nodes = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, kinds.values(), strict=True)], names=list(kinds))
            ends = pa.array([0, *accumulate(map(len, held.values()))], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.string()), pa.array([x for _, x in held], pa.int64()), pa.ListArray.from_arrays(ends, nodes)], names=["host", "says", "nodes"])

    rows = pages.select("url", "html").mapInArrow(count, "host string, says bigint, nodes array<struct<element: bigint, shows: bigint, is_block: boolean, own: bigint>>")
    distinct = rows.groupBy("host", "says").agg(F.min("nodes").alias("nodes"))
    return distinct.select("host", F.explode("nodes").alias("node")).select("host", "node.*").groupBy("host", "element", "shows", "is_block", "own").agg(F.count(F.lit(1)).alias("n"))


def low_branches(counts: DataFrame) -> DataFrame:
    """(host, element, shows, importance): branches (shows 0) and blocks whose importance isn't high."""
    counts = written(counts)
    log = lambda c: F.log(F.col(c).cast("double"))
    # Of an element: pages with a presentation are pages with the element; entropies to the base of their number.
    styles = counts.filter("NOT is_block").groupBy("host", "element", "own").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("l"), F.sum(F.col("n") * log("n")).alias("nlogn"))
    styles = styles.withColumn("presentation", F.when(F.col("m") > 1, 1 - F.col("nlogn") / (F.col("m") * log("m"))).otherwise(1.0))
    blocks = counts.filter("is_block")
    # Of a block: the pages of its host that show the element at all, at least those with the commonest block.
    totals = written(blocks.groupBy("host", "element", "own").agg(F.sum("n").alias("all_blocks"), F.max("n").alias("most")))
    hosts = counts.filter("NOT is_block").groupBy("host").agg(F.max("n").alias("pages"))
    totals = totals.join(written(hosts), "host", "left").withColumn("pages", F.greatest(F.coalesce("pages", "most"), "most"))
    totals = written(totals.withColumn("m", F.least("pages", "all_blocks")))
    repeated = blocks.filter("n > 1").join(totals.drop("own"), ["host", "element"])
    repeated = repeated.withColumn("importance", F.when(F.col("m") > 1, 1 - log("n") / log("m")).otherwise(1.0))
    lost = repeated.groupBy("host", "element").agg(F.sum(F.col("n") * (1 - F.col("importance"))).alias("lost"))
    content = totals.join(lost, ["host", "element"], "left").select("host", "element", "own", F.col("m").alias("pages"), (1 - F.coalesce("lost", F.lit(0.0)) / F.col("all_blocks")).alias("content"))
    decay = F.pow(F.lit(DECAY), F.coalesce("l", F.lit(0)).cast("double"))
    whole = styles.join(content, ["host", "element", "own"], "full")
    whole = whole.withColumn("importance", (1 - decay) * F.coalesce("presentation", F.lit(1.0)) + decay * F.coalesce("content", F.lit(1.0)))
    # What elements of the same name have on all hosts.
    whole = written(whole.withColumn("weight", F.greatest(F.coalesce("m", F.lit(0)), F.coalesce("pages", F.lit(0))).cast("double") - 1))
    vote = F.col("weight") / (F.col("weight") + BACKING)
    alike = lambda c: ((F.sum(vote * F.coalesce(c, F.lit(1.0))) + 1) / (F.sum(vote) + 1)).alias(f"usual_{c}")
    usual = written(whole.groupBy("own").agg(alike("importance"), alike("content")))
    backed = lambda value, weight, back: (F.col(weight) * F.col(value) + BACKING * F.col(back)) / (F.col(weight) + BACKING)
    elements = whole.join(usual, "own").select("host", "element", F.lit(0).cast("long").alias("shows"), backed("importance", "weight", "usual_importance").alias("importance"))
    repeated = repeated.withColumn("weight", F.col("m").cast("double") - 1).join(usual, "own")
    low_blocks = repeated.select("host", "element", "shows", backed("importance", "weight", "usual_content").alias("importance"))
    return written(low_blocks.filter(F.col("importance") < LISTED_BLOCK).union(elements.filter(F.col("importance") < LISTED_BRANCH)))


def extract(pages: DataFrame, max_broadcast: int = MAX_BROADCAST, host_pages: int = HOST_PAGES) -> DataFrame:
    """(page_id, url, text string, n_chars long)."""
    low = low_branches(tree_counts(pages))
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars bigint"

    def batch_of(ids: pa.Array, urls: pa.Array, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if low.count() <= max_broadcast:
        by_host: dict[str, Low] = {}
        for host, element, shows, importance in low.toPandas().itertuples(index=False):
            by_host.setdefault(host, {})[element, shows] = importance
        sent = pages.sparkSession.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                urls, html = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                yield batch_of(batch.column(0), batch.column(1), [main_text(p or "", known.get(host_of(u), {})) for u, p in zip(urls, html, strict=True)])

        return pages.select("page_id", "url", "html").mapInArrow(run, schema)

    def run_past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by host and part, its list first."""
        at, known = None, {}
        for batch in batches:
            texts, keep = [], []
            for i, (host, part, nodes, html) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "part", "low", "html")), strict=True)):
                if nodes is not None:
                    at, known = (host, part), {(x["element"], x["shows"]): x["importance"] for x in nodes}
                    continue
                keep.append(i)
                texts.append(main_text(html or "", known if at == (host, part) else {}))
            take = pa.array(keep, pa.int64())
            yield batch_of(batch.column(batch.schema.get_field_index("page_id")).take(take), batch.column(batch.schema.get_field_index("url")).take(take), texts)

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    parts = written(rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / host_pages).alias("parts")))
    lists = low.groupBy("host").agg(F.collect_list(F.struct("element", "shows", "importance")).alias("low")).join(parts, "host")
    lists = lists.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "low")
    dealt = rows.join(parts, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
    both = dealt.unionByName(lists, allowMissingColumns=True)
    return both.repartition("host", "part").sortWithinPartitions("host", "part", F.desc_nulls_last(F.size("low"))).mapInArrow(run_past, schema)
