"""Main text of web pages, with removal of what a site repeats on its pages.

Every element's subtree has a hash of its tags, attributes and text, inside a page's article as well. Spark counts for each
host on how many distinct pages a subtree occurs, and subtrees that recur on at least five pages of the host are deleted. The block that
holds most of a page's text is none of them, nor is the prose of a near copy of other pages. Articles may share passages, so paragraphs, headings and items inside an article must recur on more pages than boxes, lists and links. What is
left gives blocks of text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.support import small_batches
from opslens.operators.joins import join_lookup
from opslens.session import stored

#: A subtree is a template if it is on at least so many distinct pages of its host, however large the host is.
LEAST_PAGES = 5
#: Prose and items inside an article are templates from this share of the host's pages on.
PROSE_SHARE = 0.5
#: Most templates that are sent to all tasks: 36 MB.
MOST_BROADCAST = 1 << 22
#: Shortest subtree, in characters of text, that is counted: a lone dot may well recur.
LEAST_TEXT = 2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Never part of the main text.
DROPPED = frozenset("head nav footer aside form button select input textarea svg canvas audio video object menu dialog".split()) | RAW
#: Words of class, id or role that name what is not the main text. They are weak evidence: see ``named_out``.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer masthead "
    "menu modal nav navbar navigation newsletter notice notices popup promo related share sharing sidebar skip social sponsor sponsored "
    "subscribe subscription toolbar widget complementary contentinfo search".split()
)
#: Those that tell of a paragraph, heading or item as well.
NAMES_OF_LINES = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies newsletter promo share sharing "
    "social sponsor sponsored subscribe subscription".split()
)
#: Those of readers' comments, and words that name them only where there are such elements inside.
COMMENTS = frozenset("comment comments disqus".split())
TALK = frozenset("discussion replies reply responses response".split())
#: Paragraphs and the like, and parts of lists and tables: articles may share one of them.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre summary figcaption caption dt".split())
ITEMS = frozenset("li dd tr td th tbody thead tfoot hgroup".split())
#: Never a template, though what is in it may be one.
NEVER = frozenset("html body head main article".split()) | RAW
#: Characters of own text from which on a block is taken for a paragraph.
PARAGRAPH = 80
#: Start tags that end an open element of the same group.
ENDS_P = BLOCK - {"body", "caption", "dd", "dt", "head", "html", "legend", "option", "optgroup", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot select article section div body td th blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']*(?:\"[^\"]*\"|'[^']*'))*?[^>\"']*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Element:
    tag: str
    attributes: str
    parent: int
    parts: list = field(default_factory=list)  # text, or the number of a child


def parse(html: str) -> list[Element]:
    """The elements in order of their start tags; the first is the whole page. Missing end tags are inferred."""
    tree = [Element("", "", -1)]
    now, at = 0, 0

    def close(tags: set | frozenset, scope: frozenset) -> int:
        i = now
        while i > 0 and tree[i].tag not in tags:
            if tree[i].tag in scope:
                return now
            i = tree[i].parent
        return tree[i].parent if i > 0 else now

    while True:
        found = _TOKEN.search(html, at)
        if found is None:
            break
        if found.start() > at:
            tree[now].parts.append(html[at : found.start()])
        at = found.end()
        ending, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not name:
            continue
        tag = name.lower()
        if ending:
            before, now = now, close({tag}, frozenset())
            if tag == "p" and now == before:  # the end of no paragraph is an empty one
                tree[now].parts.append(len(tree))
                tree.append(Element("p", "", now))
            continue
        if tag in ENDS_P:
            now = close({"p"}, SCOPES)
        if tag in SIBLINGS:
            now = close(SIBLINGS[tag], SCOPES - SIBLINGS[tag] if tag not in ("td", "th") else frozenset({"table"}))
        tree[now].parts.append(len(tree))
        tree.append(Element(tag, attributes, now))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]|\Z", re.I).search(html, at)
            tree[-1].parts.append(html[at : end.start()])
            at = html.find(">", end.start()) + 1 or len(html)
        elif tag not in VOID and not attributes.endswith("/"):
            now = len(tree) - 1
    if at < len(html):
        tree[now].parts.append(html[at:])
    return tree


def words_of(element: Element) -> set[str]:
    """Words of class, id and role: as they are, without hyphens, and their parts between hyphens and underscores."""
    found: set[str] = set()
    for names in _NAMED.findall(element.attributes) if element.attributes else ():
        for word in " ".join(names).lower().split():
            found.update((word, word.replace("-", "").replace("_", ""), *re.split("[-_]", word)))
    return found


def named_out(tree: list[Element]) -> list[bool]:
    """Which elements are not main text by their names.

    A name needs evidence beside it. It never tells of the block that holds most of the page's text (three quarters for
    comments, which may be longer than the article; a list of several goes in any case); a paragraph, heading or item
    goes by few names only; and a discussion is one of readers if there are comments in it.
    """
    sizes = [sum(len("".join(p.split())) for p in e.parts if isinstance(p, str)) for e in tree]
    names = [words_of(e) if e.attributes and e.tag not in ("html", "body") else set() for e in tree]
    comments = [0] * len(tree)  # elements named as comments directly below
    within = [False] * len(tree)  # whether there are any below
    for i in range(len(tree) - 1, 0, -1):
        above = tree[i].parent
        if tree[i].tag not in DROPPED:
            sizes[above] += sizes[i]
        if COMMENTS & names[i]:
            comments[above] += 1
        within[above] |= within[i] or bool(COMMENTS & names[i])
    out = []
    for i, e in enumerate(tree):
        known = NAMES_OF_LINES if e.tag in PROSE or e.tag in ITEMS else NAMES
        named = bool(known & names[i]) or (bool(TALK & names[i]) and within[i])
        large = 4 * sizes[i] > 3 * sizes[0] if COMMENTS & names[i] else 2 * sizes[i] > sizes[0]
        out.append(named and (not large or (comments[i] > 1 and sizes[i] < sizes[0])))
    return out


def measure(tree: list[Element], by_name: bool = True) -> tuple[list[bool], list[bool], list[int]]:
    """For each element: whether it is left out itself, whether something around it is, and its characters of text
    without what is left out below it. A form may hold a whole page, so an article within one counts."""
    named = named_out(tree) if by_name else [False] * len(tree)
    out = [e.tag in DROPPED or n for e, n in zip(tree, named)]
    away = [False] * len(tree)
    sizes = [sum(len("".join(p.split())) for p in e.parts if isinstance(p, str)) for e in tree]
    for i in range(1, len(tree)):
        above = tree[i].parent
        away[i] = away[above] or (out[above] and (tree[above].tag != "form" or named[above]))
    for i in range(len(tree) - 1, 0, -1):
        if not out[i]:
            sizes[tree[i].parent] += sizes[i]
    if by_name and not sizes[0]:
        return measure(tree, False)  # names alone do not empty a page
    return out, away, sizes


def _around(tree: list[Element], i: int) -> list[int]:
    """The element and all it lies in, from the page down."""
    path = []
    while i >= 0:
        path.append(i)
        i = tree[i].parent
    return path[::-1]


def _outermost(tree: list[Element], found: list[int]) -> list[int]:
    held = set(found)
    return [i for i in found if not held.intersection(_around(tree, i)[:-1])]


def article(tree: list[Element], measured: tuple | None = None) -> list[int]:
    """Where the main text is: the article elements, else the main elements, else the whole page.

    Those without text, and those in or of what is left out (a teaser in an aside, a reader's comment) do not count
    unless the page has no other text. Of several, the element around them all is taken, or each of them in page order
    if that is the body. A main element that holds more text beside its articles than in them is taken itself.
    """
    out, away, sizes = measured or measure(tree)
    kinds = [[i for i, e in enumerate(tree) if sizes[i] and is_one(e)] for is_one in (lambda e: e.tag == "article", lambda e: e.tag == "main" or 'role="main"' in e.attributes)]
    articles, mains = (_outermost(tree, [i for i in kind if not (out[i] or away[i])]) for kind in kinds)
    found = articles or mains
    if not found:
        return [0] if sizes[0] else _outermost(tree, kinds[0] or kinds[1]) or [0]
    paths = [_around(tree, i) for i in found]
    shared = [same[0] for same in zip(*paths) if len(set(same)) == 1]
    for i in mains if articles else []:
        if i in shared and sizes[i] > 2 * sum(sizes[k] for k in articles):
            return [i]
    return [shared[-1]] if len(found) == 1 or tree[shared[-1]].tag not in ("", "html", "body") else found


def _lone(tree: list[Element]) -> list[bool]:
    """Whether an element stands for itself: not one inside a line of text, a paragraph or a heading."""
    lone = [False] * len(tree)
    holds = [True] + [False] * (len(tree) - 1)  # what is directly below may stand for itself
    for i in range(1, len(tree)):
        one = tree[i]
        within = holds[one.parent]
        lone[i] = within or (one.tag in BLOCK and tree[one.parent].tag not in PROSE)
        holds[i] = lone[i] and one.tag not in PROSE and not any(isinstance(p, str) and p.strip() for p in one.parts)
    return lone


def subtree_hashes(tree: list[Element], host: str) -> dict[int, int]:
    """A 64-bit hash, by host, of each element with all below it, if it has text and stands for itself."""
    seed = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))
    hashes: dict[int, int] = {}
    sizes = [0] * len(tree)
    for i in range(len(tree) - 1, 0, -1):
        one, content = tree[i], []
        for part in one.parts:
            if isinstance(part, int):
                content.append(str(hashes[part]))
                sizes[i] += sizes[part]
            else:
                text = " ".join(part.split())
                content.append(f"={text}")
                sizes[i] += len(text)
        data = "\0".join([one.tag, one.attributes, *content])
        hashes[i] = xxhash.xxh64_intdigest(data.encode("utf-8", "surrogatepass"), seed) - (1 << 63)
    lone = _lone(tree)
    return {i: h for i, h in hashes.items() if lone[i] and sizes[i] >= LEAST_TEXT and tree[i].tag not in NEVER}


def needs_more(tree: list[Element], roots: list[int]) -> list[bool]:
    """Whether an element is, or is in, prose or an item inside an article: a template at a higher share only."""
    inside, more = [False] * len(tree), [False] * len(tree)
    for i in roots if roots != [0] else []:
        inside[i] = True
    for i in range(1, len(tree)):
        above = tree[i].parent
        more[i] = inside[above] and (more[above] or tree[i].tag in PROSE or tree[i].tag in ITEMS)
        inside[i] |= inside[above]
    return more


def text_of(tree: list[Element], root: int, drop: frozenset | set = frozenset(), out: list[bool] | None = None) -> str:
    """Blocks below ``root`` in page order, one a line, without the elements of ``drop`` and those left ``out``."""
    out = measure(tree)[0] if out is None else out
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(line)).split())
        line.clear()
        if text:
            blocks.append(text)

    todo: list = [(root, 0)]
    while todo:
        i, k = todo.pop()
        one = tree[i]
        if k == 0:
            if i != root and (out[i] or (one.tag == "header" and not root) or i in drop):
                if one.tag in BLOCK:
                    flush()
                continue
            if one.tag in BLOCK:
                flush()
            elif one.tag == "br":
                line.append(" ")
        while k < len(one.parts) and not isinstance(one.parts[k], int):
            line.append(one.parts[k])
            k += 1
        if k < len(one.parts):
            todo += [(i, k + 1), (one.parts[k], 0)]
        elif one.tag in BLOCK:
            flush()
    flush()
    return "\n".join(blocks)


def candidates(tree: list[Element], roots: list[int], measured: tuple, host: str) -> dict[int, int]:
    """The subtree hashes without the main text's own elements and the blocks that hold most of the page's text."""
    sizes = measured[2]
    most = sum(sizes[i] for i in roots) / 2
    return {i: h for i, h in subtree_hashes(tree, host).items() if sizes[i] <= most and i not in roots}


def recurring(tree: list[Element], roots: list[int], measured: tuple, hashes: dict[int, int], known: set, wide: set) -> set[int]:
    """The elements that are templates: those of a hash in ``known``, or in ``wide`` for prose and items of an article.

    A page most of whose prose recurs is a near copy of others and keeps it all: what holds no prose goes alone. A
    block with a paragraph's worth of text of its own counts as prose here, and all text does where there is none.
    """
    if not known:
        return set()
    more = needs_more(tree, roots)
    found = {i for i, h in hashes.items() if h in (wide if more[i] else known)}
    if not found:
        return found
    out, _, sizes = measured
    prose = [0] * len(tree)
    gone = [0] * len(tree)  # characters of prose in templates
    for by_tag in (True, False):
        for i in range(len(tree) - 1, -1, -1):
            one = tree[i]
            below = [part for part in one.parts if isinstance(part, int) and not out[part]]
            if not by_tag or one.tag in PROSE or (one.tag in BLOCK and sum(len(p) for p in one.parts if isinstance(p, str)) >= PARAGRAPH):
                prose[i] = sizes[i]
            else:
                prose[i] = sum(prose[part] for part in below)
            gone[i] = prose[i] if i in found else sum(gone[part] for part in below)
        if any(prose[i] for i in roots):
            break
    if 2 * sum(gone[i] for i in roots) <= sum(prose[i] for i in roots):
        return found
    return {i for i in found if not prose[i]}


def chosen(hashes: dict[int, int], known: np.ndarray, wide: np.ndarray) -> tuple[set, set]:
    """Which of a page's hashes are among the sorted ``known`` ones, and which of those are wide."""
    own = np.fromiter(hashes.values(), np.int64, len(hashes))
    at = np.searchsorted(known, own)
    here = at < len(known)
    here[here] = known[at[here]] == own[here]
    return set(own[here].tolist()), set(own[here][wide[at[here]]].tolist())


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def page_hashes(pages: DataFrame) -> DataFrame:
    """``page, host, hashes`` for each distinct page of a host: copies are one page. The hash 0 is the page's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for host, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tree = parse(html or "")
                measured = measure(tree)
                found.append([0, *set(candidates(tree, article(tree, measured), measured, host).values())])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["page", "host", "hashes"])

    rows = small_batches(pages.select("page", "host", "html")).mapInArrow(run, "page long, host string, hashes array<long>")
    return rows.groupBy("page").agg(F.first("host").alias("host"), F.first("hashes").alias("hashes"))


def templates(found: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``hash, wide``: the subtrees on ``least_pages`` or more distinct pages of their host, and whether they are on
    ``PROSE_SHARE`` of its pages. ``found`` is what ``page_hashes`` returns."""
    counted = found.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    counted = stored(counted.where((F.col("n") >= least_pages) | (F.col("hash") == 0)))
    total = counted.where("hash = 0").select("host", F.col("n").alias("pages"))
    many = join_lookup(counted.where("hash <> 0"), total, "host")
    return many.select("hash", (F.col("n") >= F.lit(PROSE_SHARE) * F.col("pages")).alias("wide"))


def extract(
    pages: DataFrame, least_pages: int = LEAST_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_broadcast: int = MOST_BROADCAST
) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    A null page counts as empty, and a null url as a host of its own name (the empty one). Ids and urls may be null
    or repeat; each row is a page. Further columns are ignored; an empty table gives an empty result. Up to
    ``most_broadcast`` templates are sent to all tasks; more are joined to the pages that hold them.
    """
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    rows = rows.withColumn("page", F.xxhash64("host", "html"))
    found = page_hashes(rows)
    known = stored(templates(found, least_pages))
    if known.count() <= most_broadcast:
        local = known.orderBy("hash").toArrow()
        sent = pages.sparkSession.sparkContext.broadcast((local["hash"].to_numpy(), local["wide"].to_numpy()))
        given = rows.select("page_id", "url", "html", "host")
    else:
        sent = None
        held = join_lookup(found.select("page", F.explode("hashes").alias("hash")), known, "hash")
        held = held.groupBy("page").agg(F.collect_list("hash").alias("hashes"), F.collect_list(F.when(F.col("wide"), F.col("hash"))).alias("wide"))
        given = join_lookup(rows, stored(held), "page", "left").select("page_id", "url", "html", "host", "hashes", "wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            lists = [batch.column(k).to_pylist() for k in range(2, batch.num_columns)]
            for html, host, *own in zip(*lists):
                tree = parse(html or "")
                measured = measure(tree)
                roots = article(tree, measured)
                hashes = candidates(tree, roots, measured, host) if sent or own[0] else {}
                known, wide = chosen(hashes, *sent.value) if sent else map(set, (own[0] or (), own[1] or ()))
                gone = recurring(tree, roots, measured, hashes, known, wide)
                texts.append("\n".join(filter(None, (text_of(tree, root, gone, measured[0]) for root in roots))))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return small_batches(given).mapInArrow(run, f"page_id {id_type}, url {url_type}, text string, n_chars long")
