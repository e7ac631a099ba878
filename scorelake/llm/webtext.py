"""Main text of web pages by consensus of the pages of a host.

Every page is read into blocks of text, each with the path of its container: the tags from the body
down, with classes and short ids freed of digits; an id of three words or more names the page and is left out. A
container is scored by the running text that stands in it (long blocks with little link text count, blocks of menus,
headers, footers, notices and the like don't). The pages of a host vote in Spark with their shares of the score, and the
host's paths are ranked by votes (by the path's number on a tie). Each page is then read again and gives the text under the
best ranked path that holds half of what its own best container holds; a path around that container
must add a quarter to its text.

Names mark an element word by word. A class such as ``has-sidebar`` or ``layout-sidebar-right`` says what stands
beside the text and marks nothing. A mark is doubtful if its last word names content (``search-result-page``) or if it is a
form: an element so marked is text if it holds more running text than all that is unmarked. ``main``, and an ``article`` in a
doubtful element, are never marked from outside.

Null and empty pages have an empty text. A page of whose host's paths none holds enough (or without a host) gives the
text of its own best container (the greater path number on a tie). Repeated rows are read each; extra columns are ignored. Time and memory are
linear in the length of a page, however its tags nest or fail to end.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import in_arrow, table, written
from scorelake.llm.registry import register
from scorelake.llm.urls import split_url

#: Elements whose content is never text, read up to their end tag.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold main text, and names that mark a container as such.
SKIP = frozenset("nav footer aside button select option menu dialog fieldset datalist map head".split())
SKIP_WORD = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|menu\w*|nav\w*|breadcrumbs?|sidebar\w*|side|footer\w*|foot|masthead|"
    r"cookies?\w*|consent|notices?|gdpr|popup\w*|modal\w*|overlay|comments?|commentlist|respond|replies|disqus\w*|social\w*|share(?:s|r|bar|buttons?|links?|daddy|this)?|sharing|related\w*|"
    r"recommend\w*|newsletter\w*|subscri\w*|login|signup|search\w*|widgets?|toolbar|pagination|pager|skip-?links?|outbrain|taboola|topbar)", re.I)
#: A class or id with one of these words tells how the page is laid out.
LAYOUT = frozenset("has no not with without layout".split())
#: Where a name ends with one of these (but for a place), what it marks is in doubt.
CONTENT = frozenset("article content entry main page post result results story text wrap wrapper container inner body".split())
PLACE = frozenset("left right top bottom first last main wide".split())
SKIP_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN_NAME = re.compile(r"[-_.#](?:article\w*|main|content|post|entry|story|body|text)(?:$|[-_.#~])", re.I)
#: An open element of these ends where another of the list begins.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Block elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())

MARK = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
RAW_END = {t: re.compile(rf"</{t}\s*(?:>|\Z)", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"""(?i)(?:^|\s)(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

class Page:
    """The elements of a page, by number: parent, part of the path, number of the path, whether they are containers; and its blocks of text."""

    def __init__(self):
        self.parent, self.step, self.key, self.holder = [-1], [""], [0], [0]
        self.blocks: list[tuple[int, str, int, int, int]] = []  # element, text, characters of links, mark, element in doubt

    def add(self, parent: int, step: str) -> int:
        n = len(self.parent)
        self.parent.append(parent)
        self.step.append(step)
        self.key.append(xxhash.xxh64_intdigest(step, self.key[parent] & MASK) - (1 << 63))
        self.holder.append(n if _tag(step) in CONTAINERS else self.holder[parent])
        return n

    def path(self, n: int) -> str:
        out = []
        while n > 0:
            out.append(self.step[n])
            n = self.parent[n]
        return "/".join(reversed(out))


#: Marks of an element: text, text if there is little else, no text.
PLAIN, DOUBT, MARKED = 0, 1, 2
MASK = (1 << 64) - 1


def name_mark(name: str) -> int:
    """The mark that one class or id sets."""
    words = [w for w in re.split(r"[-_]+", name.lower()) if w]
    if not any(SKIP_WORD.fullmatch(w) for w in words) and not SKIP_WORD.fullmatch(name):
        return PLAIN
    if any(w in LAYOUT for w in words):
        return PLAIN
    while len(words) > 1 and (words[-1] in PLACE or words[-1].isdigit()):
        words.pop()
    return DOUBT if words[-1] in CONTENT else MARKED


def _step(tag: str, attributes: str) -> tuple[str, int]:
    """An element's part of a path, and its mark."""
    name, mark = "", MARKED if tag in SKIP else DOUBT if tag == "form" else PLAIN
    if attributes:
        for a in ATTRIBUTE.finditer(attributes):
            key, value = a[1].lower(), entities.unescape(a[2] or a[3] or a[4] or "").strip()
            if key in ("class", "id"):
                if key == "class" or len(re.split(r"[-_]+", value)) < 3:
                    name += ("." if key == "class" else "#") + "-".join(re.sub(r"\d+", "", value.lower()).split())
                if tag not in ("body", "html", "article", "main"):
                    mark = max([mark, *map(name_mark, value.split())])
            elif key == "role":
                mark = MARKED if value.lower() in SKIP_ROLE else mark
                name += "~main" if value.lower() in ("main", "article") else ""
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
                mark = MARKED
    return tag + name.replace("/", ""), mark


def read(page: str) -> Page:
    """The elements and blocks of text of a page, in page order."""
    out = Page()
    stack: list[tuple[str, int, int, int, bool]] = []  # tag, element, mark, element in doubt, whether its tag or a hidden state marks it
    parts: list[str] = []
    links = linked = 0
    last_end = page.rfind(">")  # behind it no tag ends
    open_tags: dict[str, int] = defaultdict(int)
    blocks_open = mains = 0

    def flush() -> None:
        nonlocal links
        if not parts:
            return
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            element, mark, doubt = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else (0, PLAIN, 0)
            out.blocks.append((element, text, links, mark, doubt))
        links = 0

    def pop(to: int) -> None:
        nonlocal linked, mains
        for t, *_ in stack[to:]:
            linked -= t == "a"
            mains -= t in ("article", "main")
            open_tags[t] -= 1
            if t not in INLINE:
                flush()
        del stack[to:]

    at = 0
    while at < len(page):
        m = MARK.search(page, at) if at <= last_end else None
        text = page[at:m.start()] if m else page[at:]
        if text:
            if "&" in text:
                text = text.replace("&amp;", "&") if text.count("&") == text.count("&amp;") else entities.unescape(text)
            parts.append(text)
            if linked > 0:
                links += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[4] or m[7] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1] or m[3] or m[6]:  # end tag
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None) if open_tags[tag] else None
            if k is not None and not (tag in INLINE and any(t not in INLINE for t, *_ in stack[k:])):
                pop(k)
            elif tag == "p" or tag == "br":
                flush()
            continue
        attributes = m[5] or m[8] or ""
        if tag in RAW:
            if not attributes.endswith("/"):
                end = RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if tag in ("br", "hr", "img"):
            if tag == "hr":
                flush()
            parts.append(" ")
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            flush()
            for wanted in ((CLOSES[tag],) if tag in CLOSES else ()) + ((("p",),) if tag in ENDS_P else ()):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in wanted:
                        pop(k)
                        break
                    if stack[k][0] not in INLINE and stack[k][0] not in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):
                        break
        if attributes.endswith("/") and tag in INLINE:
            continue
        step, mark = _step(tag, attributes)
        if tag == "header" and not mains:
            mark = MARKED
        above, before, doubt, firm = (stack[-1][1], stack[-1][2], stack[-1][3], stack[-1][4]) if stack else (0, PLAIN, 0, False)
        if "~main" in step or tag == "main" or tag == "article" and before == DOUBT:
            before, doubt = (MARKED, doubt) if firm else (PLAIN, 0)  # a name around it doesn't mark it
        element = above if tag in INLINE else out.add(above, step)
        doubt = doubt or (element if max(mark, before) == DOUBT else 0)
        stack.append((tag, element, max(mark, before), doubt, firm or tag in SKIP or mark == MARKED and ("hidden" in attributes or "style" in attributes)))
        linked += tag == "a"
        mains += tag in ("article", "main")
        open_tags[tag] += 1
    flush()
    return _settled(out)


def _running(text: str, links: int) -> int:
    n = len(text) - 2 * links
    return n if n >= 25 else 0


def _settled(page: Page) -> Page:
    """Doubtful elements that hold more running text than all that is unmarked are text, others are not."""
    plain = sum(_running(t, n) for _, t, n, mark, _ in page.blocks if mark == PLAIN)
    held: dict[int, int] = defaultdict(int)
    for _, t, n, mark, doubt in page.blocks:
        if mark == DOUBT:
            held[doubt] += _running(t, n)
    page.blocks = [(e, t, n, PLAIN if mark == DOUBT and held[doubt] > plain else mark, doubt) for e, t, n, mark, doubt in page.blocks]
    return page


CONTAINERS = frozenset("body article main section div td center blockquote".split())


def _tag(step: str) -> str:
    return re.split(r"[.#~]", step, maxsplit=1)[0]


def containers(page: Page) -> dict[int, tuple[float, int]]:
    """Path number -> score and an element of each container: the running text in it, half of that of containers right in it, more if its name says so."""
    score: dict[int, float] = defaultdict(float)
    element: dict[int, int] = {}
    for e, text, links, mark, _ in page.blocks:
        running = _running(text, links)
        if mark or not e or not running:
            continue
        gain = running * (1.0 + min(text.count(","), 10) / 10)
        own = page.holder[e]
        outer = page.holder[page.parent[own]] if own else 0
        for n, part in ((own, gain), (outer, gain / 2)):
            if n or n == own:
                score[page.key[n]] += part
                element.setdefault(page.key[n], n)
    out = {}
    for key, s in score.items():
        last = page.step[element[key]]
        if _tag(last) in ("article", "main") or "~main" in last or MAIN_NAME.search(last):
            s *= 3
        out[key] = (s, element[key])
    return out


def under(page: Page, key: int | None) -> str:
    """Text of the blocks in the containers with this path number; of all blocks for None."""
    inside = [key is None] * len(page.parent)
    inside[0] = key is None or key == page.key[0]
    for n in range(1, len(inside)):
        inside[n] = inside[n] or inside[page.parent[n]] or page.key[n] == key
    return " ".join(t for e, t, _, mark, _ in page.blocks if not mark and inside[e])


def best_of(scores: dict[int, tuple[float, int]]) -> int | None:
    return max(scores, key=lambda p: (scores[p][0], p)) if scores else None


#: A host's path counts on a page if it holds this share of the score of the page's best container; one around that, if it
#: adds this share of running text to it.
FAIR, ADDED = 0.5, 0.25


def chosen(page: Page, scores: dict[int, tuple[float, int]], paths: list[int]) -> int | None:
    """The first of the host's paths that counts on the page, or that of the page's own best container."""
    best = best_of(scores)
    if best is None:
        return None
    held = [0] * len(page.parent)
    for e, text, links, mark, _ in page.blocks:
        held[e] += 0 if mark else _running(text, links)
    for n in range(len(held) - 1, 0, -1):
        held[page.parent[n]] += held[n]
    around, n = set(), page.parent[scores[best][1]]
    while n > 0:
        around.add(n)
        n = page.parent[n]
    for p in paths:
        if p in scores and scores[p][0] >= FAIR * scores[best][0]:
            e = scores[p][1]
            if p == best or e not in around or held[e] >= (1 + ADDED) * held[scores[best][1]]:
                return p
    return best


def votes(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Per host and path the sum of the pages' votes, ranked: ``host``, ``paths``."""
    host, _ = split_url(url)

    def run(batches):
        tally: dict[tuple[str, int], float] = defaultdict(float)
        for b in batches:
            for h, page in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                scores = containers(read(page.as_py() or ""))
                whole = sum(s for s, _ in scores.values())
                for p, (s, _) in scores.items():
                    tally[h, p] += s / whole
            if len(tally) > 100_000:
                yield _tally(tally)
                tally.clear()
        if tally:
            yield _tally(tally)

    def _tally(t):
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in t]), pa.array([p for _, p in t], pa.int64()), pa.array([round(v * 1e6) for v in t.values()], pa.int64())], ["host", "path", "votes"])
    cast = pages.select(host.alias("host"), F.col(html).alias("html")).where("host <> '' and html <> ''").mapInArrow(run, "host string, path long, votes long")
    ranked = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    # Paths with less than a tenth of the host's best votes are no choice of the host.
    best = ranked.groupBy("host").agg(F.max("votes").alias("best"))
    return (ranked.join(best, "host").where(F.col("votes") * 10 >= F.col("best")).groupBy("host")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))), lambda x: x.path).alias("paths")))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and the ``path`` it came from, per row."""
    winners = written(votes(pages, url, html))
    host, _ = split_url(url)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    rows = rows.join(winners, "host", "left").select("page_id", "url", "html", "paths")
    kind = dict(rows.dtypes)["page_id"]

    def run(batch):
        texts, used = [], []
        for page, paths in zip(batch.column("html"), batch.column("paths").to_pylist(), strict=True):
            found = read(page.as_py() or "")
            scores = containers(found)
            key = chosen(found, scores, paths or [])
            text = under(found, key)
            path = found.path(scores[key][1]) if scores else None
            texts.append(text or "")
            used.append(path)
        yield batch.select(["page_id", "url"]).append_column("text", pa.array(texts, pa.string())).append_column("path", pa.array(used, pa.string()))
    return in_arrow(rows, run, f"page_id {kind}, url string, text string, path string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


register("op6_html_text", op6)
