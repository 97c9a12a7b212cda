"""Main text of web pages by consensus of their host.

Each page scores its containers: the share of the page's running text (link
text discounted, boilerplate subtrees left out) that lies below each.  Its
choice, the article or main element around most of the text, or else the
deepest container with all of it, is a vote for a generalised path of tags and
classes without digits.  Votes are counted per host in Spark; the winning path
of a host is then what its pages are extracted by, and a page that has less
than COVER of its own choice there keeps that.  What only a class word or a
form makes boilerplate counts as text where it holds most of the page's; reader
comments and lists of related pages never do.  A name counts as a whole: of
"share-price" the price is what it means.

Defined results: a null or empty page, or one without text, gives the empty
string; a null url belongs to a host of its own (the empty one); repeated pages
each vote; ties go to more text, then to the smaller path; a very long page is
parsed in one pass, held by the task that reads it; an empty table gives an
empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.llm._scratch import written

SHARE = 0.7
#: Share of a page's own choice that the path of its host must hold.
COVER = 0.9
RAW = "script|style|noscript|template|textarea|iframe|svg|math|xmp|noembed|noframes|title"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+>(?<!/>).*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body center div main section table tbody td tr".split())
WHOLE = frozenset(("article", "main"))
#: Elements that a start tag ends, if the innermost open block is one of them.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
BOILERPLATE_TAGS = frozenset("aside button dialog footer head header input menu nav object select".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification"
    " alert popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets"
    " related recommended recommendations share sharing social comment comments disqus respond replies footer header masthead copyright legal login"
    " search pagination pager toolbar complementary contentinfo reply commentlist discussion feedback outbrain taboola".split()
)
#: Of these, words that also stand in names of other things: they count where the name has no other meaning.
AMBIGUOUS = frozenset(
    "ad ads alert aside banner discussion feedback footer form header legal login menu modal notice notices notification notifications popup promo promotion"
    " reply respond search share sharing social sponsor subscribe subscription widget widgets".split()
)
#: Words that name a reader's or an editor's extras and nothing else; what they name is left out however long it is.
FIRM = frozenset("comment comments commentlist disqus replies respond related recommended recommendations outbrain taboola".split())
#: Words of a name that say what a thing looks like or where it stands.
PLAIN = frozenset(
    "area article bar block blog body bottom box btn button buttons class col column container content desktop div entry fixed form global group heading icon icons id"
    " inner item items left link links list main mobile outer page panel post primary reader right row secondary section site slot sticky text thread title top unit"
    " user wrap wrapper".split()
)
#: Words of a name that say whether a thing is there, not what it is.
STATE = frozenset("allow closed disabled enabled free has have hide is no not open show with without".split())


class Node:
    __slots__ = ("tag", "path", "good", "parent", "boiler", "soft", "firm", "link", "container", "depth")

    def __init__(self, tag: str, label: str, parent: Node | None, boiler: bool, soft: bool = False, firm: bool = False):
        self.tag, self.parent = tag, parent
        self.path = f"{parent.path}/{label}" if parent else label
        self.boiler = boiler or bool(parent and parent.boiler)
        self.soft = soft
        self.firm = firm or bool(parent and parent.firm)
        self.link = tag == "a" or bool(parent and parent.link)
        self.container = parent.container if parent else None
        self.depth = parent.depth + 1 if parent else 0
        if tag in CONTAINER:
            self.container = self
        self.good = 0


def meaning(names: str) -> tuple[bool, bool]:
    """Whether one of an element's names means boilerplate, and whether it can mean nothing else."""
    soft = firm = False
    for name in names.split():
        parts = {x for x in re.split(r"[^a-z]+", name) if x}
        if parts & STATE or not parts & BOILERPLATE_WORDS:
            continue
        known = parts <= BOILERPLATE_WORDS | PLAIN
        soft |= known or bool(parts & (BOILERPLATE_WORDS - AMBIGUOUS))
        firm |= known and bool(parts & FIRM)
    return soft, firm


def parse(page: str) -> tuple[list[Node], list[tuple[Node, int, str]]]:
    """Nodes, and the runs of text outside boilerplate as (innermost node, number of its block, text)."""
    root = Node("html", "html", None, False)
    open_, nodes, runs = [root], [root], []
    at, block = 0, 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not open_[-1].boiler:
            runs.append((open_[-1], block, page[at : m.start()]))
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            block += 1
        if m[2]:  # an end tag
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
            continue
        if tag == "html":
            continue
        if tag in VOID:
            if tag == "br":
                runs.append((open_[-1], block, " "))
            continue
        if tag in BLOCK:
            for k in range(len(open_) - 1, 0, -1):  # an open paragraph ends where a block begins
                if open_[k].tag == "p":
                    del open_[k:]
                    break
                if open_[k].tag in BLOCK:
                    break
            ending = ENDS.get(tag, ())
            while ending and len(open_) > 1:
                k = len(open_) - 1
                while k > 0 and open_[k].tag not in BLOCK:
                    k -= 1
                if k == 0 or open_[k].tag not in ending:
                    break
                del open_[k:]
        names, hidden = "", False
        if m[4]:
            found = [(k.lower(), a or b or c) for k, a, b, c in NAMED.findall(m[4])]
            names = " ".join(v for _, v in found).lower()
            hidden = bool(HIDDEN.search(m[4]))
            label = ".".join([tag, *sorted(set(re.sub(r"\d+", "", " ".join(v for k, v in found if k == "class").lower()).split()))])
        else:
            label = tag
        soft, firm = meaning(names) if names and tag not in ("body", "html") else (False, False)
        node = Node(tag, label, open_[-1], hidden or tag in BOILERPLATE_TAGS, soft or tag == "form", firm and tag not in WHOLE)
        nodes.append(node)
        if not m[4] or not m[4].endswith("/") or tag in BLOCK:
            open_.append(node)
    if at < len(page) and not open_[-1].boiler:
        runs.append((open_[-1], block, page[at:]))
    return nodes, without_soft(nodes, runs)


def running(node: Node, text: str) -> int:
    return 0 if node.link else len(text.strip())


def without_soft(nodes: list[Node], runs: list[tuple[Node, int, str]]) -> list[tuple[Node, int, str]]:
    """The runs outside elements that a class word or a form makes boilerplate, save those that hold most of the text; comments and the like never do."""
    if not any(node.soft for node in nodes):
        return runs
    runs = [run for run in runs if not run[0].firm]
    held = dict.fromkeys(nodes, 0)
    for node, _, text in runs:
        held[node] += running(node, text)
    for node in reversed(nodes):  # children come after their parents
        if node.parent:
            held[node.parent] += held[node]
    for node in nodes:
        node.soft = (node.soft and 2 * held[node] <= held[nodes[0]]) or bool(node.parent and node.parent.soft)
    return [run for run in runs if not run[0].soft]


def choose(nodes: list[Node], runs: list[tuple[Node, int, str]]) -> Node | None:
    """The article around the deepest container with SHARE of the text; without one, the deepest container with all text."""
    total = 0
    for node, _, text in runs:
        n = running(node, text)
        if n:
            total += n
            home = node.container or nodes[0]
            home.good += n
    if not total:
        return None
    best = nodes[0]
    for node in reversed(nodes):  # children come after their parents
        if node.parent:
            node.parent.good += node.good
    for node in nodes:
        if (node.container is node or node is nodes[0]) and node.good >= SHARE * total and node.depth >= best.depth:
            best = node
    x = best
    while x:
        if x.tag in WHOLE:
            return x
        if (x.container is x or x is nodes[0]) and x.good > best.good:
            best = x
        x = x.parent
    return best


def below(node: Node, path: str) -> bool:
    return node.path == path or node.path.startswith(path + "/")


def text_at(runs: list[tuple[Node, int, str]], path: str) -> str:
    """Blocks below the path, in page order."""
    blocks: list[str] = []
    last, parts = None, []
    for node, block, text in [*runs, (None, -1, "")]:
        if block != last:
            done = " ".join("".join(parts).split())
            if done:
                blocks.append(done)
            last, parts = block, []
        if node and below(node, path):
            parts.append(html.unescape(text))
    return "\n".join(blocks)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, chars = [], [], []
        for host, page in zip(batch.column(0), batch.column(1), strict=True):
            best = choose(*parse(page.as_py() or ""))
            if best:
                hosts.append(host.as_py())
                paths.append(best.path)
                chars.append(best.good)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(chars, pa.int64())], names=["host", "path", "chars"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, path in zip(batch.column(2), batch.column(3), strict=True):
            nodes, runs = parse(page.as_py() or "")
            own = choose(nodes, runs)
            at = path.as_py() if path.is_valid else None
            if own and (at is None or sum(running(n, t) for n, _, t in runs if below(n, at)) < COVER * own.good):
                at = own.path
            texts.append("" if at is None else text_at(runs, at))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(vote_host, path): the path of each host with most votes, stored."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "html")
    votes = rows.mapInArrow(_votes, "host string, path string, chars long").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    first = Window.partitionBy("host").orderBy(F.desc("n"), F.desc("chars"), "path")
    return written(votes.withColumn("k", F.row_number().over(first)).filter("k = 1").select(F.col("host").alias("vote_host"), "path"), "page-paths")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page.

    The winners are stored before the join, so Spark knows their size and
    broadcasts them only below its threshold; else it shuffles the pages and
    splits hot hosts.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    chosen = rows.join(winning_paths(pages), F.col("host") == F.col("vote_host"), "left").select("page_id", "url", "html", "path")
    kind = pages.schema["page_id"].dataType.simpleString()
    return chosen.mapInArrow(_texts, f"page_id {kind}, url string, text string")


def op6_page_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
