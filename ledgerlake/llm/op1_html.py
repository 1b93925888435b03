"""Main text of web pages by equivalence-class template deduction.

Pages of one host share templates. A page is a sequence of tokens: tags, told apart by the
path of elements they stand in, and runs of text, told apart by path and words. Tokens with
equal occurrence vectors over all pages of the host (on which pages, how often on each) form
an equivalence class. A token is valid in its class if it has the same place among the tokens
of the class on every page. Classes nest as their tags do: a run of text whose vector is that
of an element around it stands there whenever the element does, so it belongs to the template, like
a notice within every article. Everything else is a slot.

What the slots of an element hold on an average page of the host, text in links counted
against it and an article's counted ``ARTICLE`` times, tells which element holds the text: of the
elements on a page the one with the most, or the article around it. Its blocks are the page's text, without those that are the
template's; but if most of what an element holds is the template's, the pages are copies of
each other and it stays. Elements that are menus, headers, footers, sidebars, notices,
adverts, forms, articles within articles (reader comments) or so named are no candidates.

Copies of a page count once. Vectors are compared by 128 bits that are added up by exclusive
or, so counting is a partial aggregate, and no task holds a host: pages are read twice, once
for tokens, once with the templates. Templates are sent to all executors if they are
few; else they meet their host's pages in groups of about ``GROUP`` pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm import common

#: Pages that differ, on which text must stand to be the template's.
SUPPORT = 3
#: What an article holds counts so many times when elements are compared: on a host with few pages its tag is all there is to go by.
ARTICLE = 8
#: Pages that meet their host's template in one task, where templates aren't sent to all.
GROUP = 64

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_SPACE = re.compile(r"\s+")

#: Elements by what they are in a page.
RAW = frozenset("script style noscript template svg iframe textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("head nav header footer aside form button select option menu dialog script style noscript template svg iframe textarea title object".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe signup sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs header footer masthead copyright "
    "comment comments reply replies respond disqus share sharing social related recommended pagination pager login search form".split()
)
MAIN = frozenset(("article", "main"))

TOKENS = "site long, row long, same long, tokens array<struct<t: long, n: int, above: long, size: long, text: boolean>>"
TEMPLATE = "site long, t long, x long, y long, mean double"


@lru_cache(maxsize=200_000)
def token_of(path: str, words: str = "") -> int:
    """The number of a tag (by its path) or of a run of text."""
    return xxhash.xxh64_intdigest(f"{path}\0{words}") - (1 << 63)


@dataclass
class Node:
    """An open element; ``drop``: it or an ancestor is boilerplate; ``article``: it is in an article; ``link``: in a link."""

    tag: str
    path: str
    drop: bool = False
    article: bool = False
    link: bool = False


@dataclass
class Run:
    """A run of text, references decoded; ``block``: which block of the page it belongs to."""

    node: Node
    text: str
    block: int

    @property
    def words(self) -> str:
        return " ".join(self.text.split())


@dataclass
class Page:
    """What isn't dropped: the number of each element path, and runs of text, in order."""

    tags: Counter = field(default_factory=Counter)
    runs: list[Run] = field(default_factory=list)
    order: list[Run | str] = field(default_factory=list)


def _attributes(tag: str, source: str) -> tuple[bool, str]:
    """(whether the element is boilerplate, its name in a path): the tag and the first word of its class or id."""
    name = tag
    if tag in DROPPED:
        return True, name
    if not source or tag in ("html", "body"):
        return False, name
    for key, *values in _ATTRIBUTE.findall(source):
        key, value = key.lower(), next(filter(None, values), "").lower()
        if key == "hidden" and not value:
            return True, name
        if key == "role" and value in DROPPED_ROLES:
            return True, name
        if key == "role" and value == "main":
            name = "main"
        if key in ("class", "id"):
            words = [w for w in re.split(r"[^a-z]+", value) if w]
            unwanted = DROPPED_NAMES if tag not in MAIN else {"comment", "comments", "reply", "ad", "advert", "sponsored"}
            if any(w in unwanted for w in words):
                return True, name
            if words and name == tag:
                name = f"{tag}.{words[0]}"
    return False, name


def above(path: str) -> str:
    return path.rpartition("/")[0]


def tokenize(source: str) -> Page:
    """The elements and text of a page in order; unclosed elements are closed as HTML does."""
    page = Page()
    stack, block, at = [Node("", "")], 0, 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        at = m.end()
        closing, tag = m[1], (m[2] or "").lower()
        top = stack[-1]
        if not tag:
            if (m[0][0] != "<" or m[0] == "<") and not top.drop:
                run = Run(top, entities.unescape(m[0]), block)
                page.runs.append(run)
                page.order.append(run)
            continue
        if tag not in INLINE and tag != "br":
            block += 1
        if tag == "br" and not top.drop:
            page.runs.append(Run(top, " ", block))
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag not in INLINE:
            closes = {tag} if tag in ("li", "tr", "option") else {"td", "th"} if tag in ("td", "th") else {"dt", "dd"} if tag in ("dt", "dd") else {"p"}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE and stack[i].tag != "p":
                    break
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
            at = end.end() if end else len(source)
            continue
        top = stack[-1]
        if tag in INLINE:
            stack.append(Node(tag, top.path, top.drop or (bool(m[3]) and _attributes(tag, m[3])[0]), top.article, top.link or tag == "a"))
            continue
        drop, name = _attributes(tag, m[3])
        node = Node(tag, f"{top.path}/{name}", top.drop or drop or (tag == "article" and top.article), top.article or tag == "article", top.link)
        stack.append(node)
        if not node.drop:
            page.tags[node.path] += 1
            page.order.append(node.path)
    return page


def slots(page: Page, template: Iterable[int] = ()) -> Counter:
    """By path the length of the text directly in it that isn't the template's; text in links counts against it."""
    out: Counter = Counter()
    for run in page.runs:
        words = run.words
        if words and token_of(run.node.path, words) not in template:
            out[run.node.path] += -len(words) if run.node.link else len(words)
    return out


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each page in order: how often they stand there, in what element, and how much text they are or hold directly."""
    struct = pa.struct([("t", pa.int64()), ("n", pa.int32()), ("above", pa.int64()), ("size", pa.int64()), ("text", pa.bool_())])
    for batch in batches:
        out, same = [], []
        for source in common.rows_of(batch, "html"):
            page = tokenize(source or "")
            size, counts, own = slots(page), Counter(), {}
            for item in page.order:
                if isinstance(item, str):
                    token = token_of(item)
                    own.setdefault(token, (token_of(above(item)), size[item], False))
                elif words := item.words:
                    token = token_of(item.node.path, words)
                    place, length, text = own.get(token, (token_of(item.node.path), 0, True))
                    own[token] = (place, length - len(words) if item.node.link else length + len(words), text)
                else:
                    continue
                counts[token] += 1
            out.append([{"t": t, "n": n, "above": own[t][0], "size": own[t][1], "text": own[t][2]} for t, n in counts.items()])
            same.append(xxhash.xxh64_intdigest(repr(list(counts.items()))) - (1 << 63))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.int64()), pa.array(out, pa.list_(struct))], ["site", "row", "same", "tokens"])


def templates(rows: DataFrame) -> DataFrame:
    """The templates of ``rows(site, row, html)``: (site, t, x, y, mean).

    Of tags on two pages or more: their occurrence vector (x, y), and the mean of what the slots directly in
    them and in their children hold. Of text that may be the template's (mean null): its vector, which is
    that of a valid tag.
    """
    pages = common.cut(rows.select("site", "row", "html").mapInArrow(_tokens, TOKENS)).dropDuplicates(["site", "same"])
    flat = common.cut(pages.select("site", "row", F.posexplode("tokens").alias("pos", "v")).select("site", "row", "pos", "v.*"))
    vector = [F.bit_xor(F.xxhash64(F.lit(i), "row", "n")).alias(c) for i, c in enumerate("xy")]
    token = common.cut(flat.groupBy("site", "t", "above", "text").agg(F.count("*").alias("pages"), F.sum("size").alias("size"), *vector).where("pages > 1"))
    own = ["site", "x", "y"]
    tags, maybe = token.where("not text"), token.where(f"text and pages >= {SUPPORT}")
    maybe = common.cut(maybe.join(tags.select(*own).distinct(), own, "left_semi"))
    member = common.cut(token.join(maybe.select(*own).distinct(), own, "left_semi"))
    # Valid: the same place within the class on every page.
    place = F.row_number().over(Window.partitionBy("site", "row", "x", "y").orderBy("pos"))
    placed = common.join_checked(flat.select("site", "row", "pos", "t"), member.select("site", "t", "x", "y"), ["site", "t"], "inner").withColumn("place", place)
    valid = common.cut(placed.groupBy("site", "t").agg((F.min("place") == F.max("place")).alias("valid")).where("valid").select("site", "t"))
    framed = member.where("not text").join(valid, ["site", "t"], "left_semi").select(*own).distinct()
    text = common.cut(maybe.join(valid, ["site", "t"], "left_semi").join(framed, own, "left_semi"))
    fixed = text.groupBy("site", F.col("above").alias("t")).agg(F.sum("size").alias("fixed"))
    held = tags.join(fixed, ["site", "t"], "left").withColumn("held", F.col("size") - F.coalesce("fixed", F.lit(0)))
    inner = held.groupBy("site", F.col("above").alias("t")).agg(F.sum("held").alias("inner"))
    mean = ((F.col("held") + F.coalesce("inner", F.lit(0))) / F.col("pages")).alias("mean")
    of_tags = held.join(inner, ["site", "t"], "left").select("site", "t", "x", "y", mean)
    return common.cut(of_tags.unionByName(text.select("site", "t", "x", "y", F.lit(None).cast("double").alias("mean"))))


@dataclass
class Template:
    """Of a host: by tag its vector and mean, by text its vector."""

    tags: dict[int, tuple[int, int, float]] = field(default_factory=dict)
    texts: dict[int, tuple[int, int]] = field(default_factory=dict)

    def add(self, t: int, x: int, y: int, mean: float | None) -> None:
        if mean is None:
            self.texts[t] = (x, y)
        else:
            self.tags[t] = (x, y, mean)

    def has(self, run: Run) -> bool:
        """Whether a run's vector is that of an element around it."""
        if not self.texts or (vector := self.texts.get(token_of(run.node.path, run.words))) is None:
            return False
        path = run.node.path
        while path:
            if self.tags.get(token_of(path), ())[:2] == vector:
                return True
            path = above(path)
        return False


def _article(path: str) -> str | None:
    """The outermost article or main element of a path."""
    parts = path.split("/")
    for i, part in enumerate(parts):
        if part.partition(".")[0] in MAIN:
            return "/".join(parts[: i + 1])
    return None


def main_text(source: str | None, template: Template) -> str:
    """The main text of a page."""
    page = tokenize(source or "")
    fixed = {id(run) for run in page.runs if template.has(run)}
    held = slots(page, {token_of(r.node.path, r.words) for r in page.runs if id(r) in fixed})
    own: Counter = Counter()
    for path, size in held.items():
        own[path] += size
        own[above(path)] += size
    score = {path: known[2] if (known := template.tags.get(token_of(path))) else own[path] for path in set(own) | set(page.tags)}
    score = {path: value * ARTICLE if value > 0 and _article(path) else value for path, value in score.items()}
    if not score:
        return ""
    best = max(score, key=lambda path: (score[path], -len(path), path))
    article = _article(best)
    root = best if article is None else article
    inside = [r for r in page.runs if r.node.path == root or r.node.path.startswith(f"{root}/")]
    if article is None:  # menus of links without a name
        inside = [r for r in inside if (template.tags.get(token_of(r.node.path)) or (0, 0, own[r.node.path]))[2] > 0]
    size = Counter()
    for run in inside:
        size[id(run) in fixed] += len(run.words)
    copies = size[True] > size[False]
    blocks: dict[int, list[Run]] = {}
    for run in inside:
        blocks.setdefault(run.block, []).append(run)
    texts = []
    for _, runs in sorted(blocks.items()):
        if copies or any(r.words and id(r) not in fixed for r in runs):
            texts.append(_SPACE.sub(" ", "".join(r.text for r in runs)).strip())
    return "\n\n".join(filter(None, texts))


OUT = "page_id long, url string, text string, n_chars long"


def _extracted(batch: pa.RecordBatch | pa.Table, template_of) -> dict[str, pa.Array]:
    columns = (batch.column(c).to_pylist() for c in ("html", "site"))
    texts = [main_text(source, template_of(site)) for source, site in zip(*columns)]
    return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}


def extract(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of ``rows(page_id, url, html, site, row)`` with the templates ``found`` (already cut)."""
    none = Template()
    if found.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:
        by: dict[int, Template] = {}
        for site, *entry in found.collect():
            by.setdefault(site, Template()).add(*entry)
        sent = rows.sparkSession.sparkContext.broadcast(by)

        @common.kernel
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pydict(_extracted(batch, lambda site: sent.value.get(site, none)))

        return rows.select("page_id", "url", "html", "site").mapInArrow(run, OUT)
    groups = common.cut(rows.groupBy("site").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("g")))
    dealt = common.join_checked(rows, groups, "site").withColumn("part", F.pmod(F.xxhash64("row"), F.col("g")).cast("int")).select("page_id", "url", "html", "site", "part")
    spread = common.join_checked(found, groups, "site", "inner").select("site", "t", "x", "y", "mean", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("part"))

    def run_group(group: pa.Table, entries: pa.Table) -> pa.Table:
        template = Template()
        for entry in zip(*(entries.column(c).to_pylist() for c in ("t", "x", "y", "mean"))):
            template.add(*entry)
        return pa.table(_extracted(group, lambda _: template))

    return dealt.groupBy("site", "part").cogroup(spread.groupBy("site", "part")).applyInArrow(run_group, OUT)


def sites(pages: DataFrame) -> DataFrame:
    """``pages`` as (page_id, url, html, site, row): a number for each host and each row."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    typed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return typed.withColumn("site", F.xxhash64(host)).withColumn("row", F.monotonically_increasing_id())


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html, ...)``.

    Null html is an empty page, and a page without text has an empty one. Rows without url
    are pages of one host. Rows that repeat an id are pages of their own. Of elements that hold
    equally much the outermost is taken. Other columns are ignored; no rows: no rows.
    """
    rows = sites(pages)
    return extract(rows, templates(rows.select("site", "row", "html")))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(common.table(spark, sf_dir, "pages"))
