"""Main text of web pages: a maximum-scoring run of tokens.

A page is one sequence of tokens: words score positive, tags negative, and a
linear scan finds the contiguous run with the highest sum.  What a tag costs is
learned from labelled pages, apart for tags within an article, within a main
element, of other elements with most of the page's words, and elsewhere: the more often a kind of tag lies outside the main text,
the more it costs.  Elements that never hold main text (scripts, menus,
forms, and what a whole word of their class or id calls an advert, a notice, a
comment, ...) are left out before the scan, wherever they are, unless such a
class or id is on an element with most of the page's words.  A header within an
article or main element that holds a heading is part of the text.

Inside the run, block elements separate blocks; character references are
decoded, white space in a block becomes one space, blocks are joined by line
breaks.

A page needs only itself: there is no shuffle, and time is linear in its length.

Defined results: a null or empty page has an empty text; a page without words
too; of equal runs the first is taken; repeated rows each get their result;
further columns are ignored.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .cluster import pick

# Elements by what they do to text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("aside button canvas datalist dialog embed footer form head header iframe input map menu nav noscript object option script select style svg template textarea title video audio".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words in a class, id or role that say an element isn't main text.
AWAY = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies discussion disqus footer form header login masthead menu menubar modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related respond "
    "replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget alert consent gdpr legal disclaimer skip toc".split()
)
#: Words beside them that only say where such an element is or how it looks.
SHAPES = frozenset("area bar block bottom box btn button container holder items left list outer panel region right section slot small top unit wrap wrapper".split())
#: Those that name what readers reply, and those that a part of a text may be about; the parts, and their headings, that have ids for links to them.
REPLIES = frozenset("comment comments discussion disqus replies respond".split())
SUBJECTS = frozenset("ad ads adv advert adverts advertisement advertising alert banner consent cookie cookies disclaimer discussion form gdpr header legal login menu navigation newsletter notice notices promo related replies respond search share sharing signup skip social sponsor sponsored subscribe widget".split())
#: Those of an article's header, which stays if it holds a heading.
HEADERS = frozenset(("header", "masthead", "banner"))
PARTS = frozenset("a b blockquote code dd dl dt em figure h1 h2 h3 h4 h5 h6 i li ol p pre section span strong table td th tr ul".split())

#: Words that a unit of log odds against a tag costs, and what every tag costs at least.
SCALE, LEAST = 6.0, 0.05

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*+)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


def _away(name: str, attributes: str) -> str | None:
    """Why an element isn't main text: "always", "named", "header", or "replies", which may be longer than what they reply to; None if it may be."""
    if name in NEVER:
        return "header" if name == "header" else "always"
    if "=" not in attributes or name in ("html", "body", "article", "main"):
        return None
    for m in _NAMED.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").split():
            parts = {x.lower() for x in _PART.findall(token) if not x.isdigit()}
            own = parts & AWAY
            # The whole token names what the element is; the id of a part of a text, or of its heading, names its subject.
            if own and parts <= AWAY | SHAPES and not (m[1].lower() == "id" and name in PARTS and own <= SUBJECTS):
                return "replies" if own & REPLIES else "header" if own <= HEADERS else "named"
    return None


def _sizes(page: str) -> tuple[list[int], list[int], list[int]]:
    """Ends of the pieces of text of a page outside of elements that never hold main text, the words so far, and those within article and main."""
    ends, words, marked = [0], [0], [0]
    at, never, inside = 0, Counter(), 0

    def add(start: int, stop: int) -> None:
        n = len(page[start:stop].split())
        ends.append(stop)
        words.append(words[-1] + n)
        marked.append(marked[-1] + (n if inside else 0))

    while m := _TOKEN.search(page, at):
        if m.start() > at and not any(never.values()):
            add(at, m.start())
        at = m.end()
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        name = (name or "").lower()
        if name in RAW and not slash:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else len(page)
        elif name in NEVER - RAW - VOID and not (attributes or "").endswith("/"):
            never[name] = max(0, never[name] + (-1 if slash else 1))
        elif name in ("article", "main"):
            inside = max(0, inside + (-1 if slash else 1))
    if at < len(page):
        add(at, len(page))
    return ends, words, marked


def tokens(page: str) -> list[tuple[str, str]]:
    """("text", piece), ("open", name), ("close", name) in page order; ("skip", name) stands for an element left out."""
    out: list[tuple[str, str]] = []
    at, end = 0, len(page)
    tags: dict[str, tuple[list[int], list[int], list[int], dict[int, list[int]]]] = {}
    sizes: list = []
    headings: list[int] | None = None
    inside = {"article": 0, "main": 0}

    def past(name: str, start: int) -> int | None:
        """Where the element opened just before ``start`` ends; None if it is never closed."""
        if name not in tags:
            starts, stops, depths, ends = [], [], [0], {}
            for m in re.finditer(rf"</?{re.escape(name)}(?=[\s/>])[^>]*+>", page, re.I):
                closes = m[0][1] == "/"
                if closes:
                    ends.setdefault(depths[-1] - 1, []).append(len(starts))
                starts.append(m.start())
                stops.append(m.end())
                depths.append(depths[-1] + (-1 if closes else 0 if name in RAW else 1))
            tags[name] = starts, stops, depths, ends
        starts, stops, depths, ends = tags[name]
        # The element's end is the first tag behind it that brings the depth below what it is there.
        first = bisect.bisect_left(starts, start)
        below = ends.get(depths[first] - 1, [])
        i = bisect.bisect_left(below, first)
        return stops[below[i]] if i < len(below) else None

    def holds_most(start: int, stop: int, why: str) -> bool:
        """Whether an element holds most of the page's words (of replies, all but a tenth), and no more words of article and main are outside of it."""
        if not sizes:
            sizes.extend(_sizes(page))
        ends, words, marked = sizes
        a, b = bisect.bisect_right(ends, start) - 1, bisect.bisect_right(ends, stop) - 1
        own, inner = words[b] - words[a], marked[b] - marked[a]
        return own > (0.9 if why == "replies" else 0.5) * words[-1] and marked[-1] - inner <= inner

    while at < end:
        if not (m := _TOKEN.search(page, at)):
            out.append(("text", page[at:]))
            break
        if m.start() > at:
            out.append(("text", page[at : m.start()]))
        at = m.end()
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in inside and not (attributes or "").endswith("/"):
            inside[name] = max(0, inside[name] + (-1 if slash else 1))
        if slash:
            out.append(("close", name))
        elif name in VOID or attributes.endswith("/"):
            out.append(("open", name))
        elif why := _away(name, attributes or ""):
            stop = past(name, at)
            if stop is None and name in RAW:
                stop = end
            if why == "header" and stop and any(inside.values()):
                if headings is None:
                    headings = [h.start() for h in re.finditer(r"<h[1-6](?=[\s/>])", page, re.I)]
                if bisect.bisect_left(headings, at) < bisect.bisect_left(headings, stop):
                    out.append(("open", name))
                    continue
            if why != "always" and name not in NEVER and stop and holds_most(at, stop, why):
                out.append(("open", name))
                continue
            out.append(("skip", name))
            at = stop or at
        else:
            out.append(("open", name))
    return out


def within(found: list[tuple[str, str]]) -> list[str]:
    """For each token where it is: in an article or a main element, whose own tags are outside of it; a tag of another element there that holds more than half of all words is "wide"."""
    out, depth, words, opened, pairs = [], {"article": 0, "main": 0}, 0, {}, []
    for i, (kind, said) in enumerate(found):
        if kind == "close" and said in depth:
            depth[said] = max(0, depth[said] - 1)
        out.append("article" if depth["article"] else "main" if depth["main"] else "")
        if kind == "open" and said in depth:
            depth[said] += 1
        if kind == "text":
            words += len(said.split())
        elif kind == "open" and said not in VOID:
            opened.setdefault(said, []).append((i, words))
        elif kind == "close" and opened.get(said):
            start, before = opened[said].pop()
            pairs.append((start, i, words - before))
    for start, end, held in pairs:
        if 2 * held > words and not out[start] and not out[end]:
            out[start] = out[end] = "wide"
    return out


class Weights:
    """What a word earns and each kind of tag costs, by where it is."""

    def __init__(self, word: float, tag: dict[str, float], other: float, inner: float = LEAST):
        self.word, self.tag, self.other, self.inner = word, tag, other, inner

    def cost(self, kind: str, name: str, where: str = "") -> float:
        own = self.tag.get(f"{where} {kind} {name}".lstrip())
        if own is None:
            own = self.cost(kind, name) if where == "wide" else -self.inner if where else self.other
        return own


def train(labelled: list[tuple[str, str]], word: float = 1.0) -> Weights:
    """Weights from pages with their main text marked by the two comments <!--main--> and <!--/main-->.

    A tag's cost is the log odds, add-one, of lying outside or at the edge of the marked part, at least a small cost.
    """
    inside, outside = Counter(), Counter()
    for page, _ in labelled:
        before, _, rest = page.partition("<!--main-->")
        main, _, after = rest.partition("<!--/main-->")
        parts = [tokens(part) for part in (before, main, after)]
        where = within([x for part in parts for x in part])
        for part, count in zip(parts, (outside, inside, outside)):
            here, where = where[: len(part)], where[len(part) :]
            texts = [i for i, (kind, _) in enumerate(part) if kind == "text"] or [0]
            for i, (w, (kind, x)) in enumerate(zip(here, part)):
                if kind != "text":
                    (count if w != "wide" or texts[0] < i < texts[-1] else outside)[f"{w} {kind} {x}".lstrip()] += 1
    tag = {}
    for k in inside.keys() | outside.keys():
        odds = math.log((outside[k] + 1) / (inside[k] + 1))
        tag[k] = -max(LEAST, SCALE * odds)
    return Weights(word, tag, -2.0)


def main_run(found: list[tuple[str, str]], weights: Weights, where: list[str] | None = None) -> tuple[int, int]:
    """First and past-the-last token of the best run: one linear scan; without ``where`` no tag is in a special place."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, ((kind, said), place) in enumerate(zip(found, where or [""] * len(found))):
        score = weights.word * len(said.split()) if kind == "text" else weights.cost(kind, said, place)
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, span = total, (start, i + 1)
    return span


def _breaks(token: tuple[str, str]) -> bool:
    kind, said = token
    return kind != "text" and said in BLOCKS


def extract(page: str | None, weights: Weights) -> str:
    """The main text of one page."""
    if not page:
        return ""
    found = tokens(page)
    first, last = main_run(found, weights, within(found))
    # Whole blocks: an inline tag at the edge of the run may cost more than the words behind it.
    while first < last and first > 0 and not _breaks(found[first - 1]):
        first -= 1
    while first < last < len(found) and not _breaks(found[last]):
        last += 1
    blocks, own = [], []
    for kind, said in [*found[first:last], ("close", "p")]:
        if kind == "text":
            own.append(said)
        elif kind == "skip" and said not in BLOCKS:
            continue
        elif said in BLOCKS or kind == "skip":
            block = " ".join(entities.unescape("".join(own)).split())
            if block:
                blocks.append(block)
            own = []
        elif said in ("br", "wbr", "img"):
            own.append(" " if said == "br" else "")
    return "\n".join(blocks)


def labelled_pages() -> list[tuple[str, str]]:
    """Pages with their main text marked, written here by rule: usual layouts, with and without elements that say what they are.

    Each layout comes with flat main text, and with main text in nested elements: before, between and behind the paragraphs.
    """
    line = "Some words of a paragraph that goes on for a while, as paragraphs do."
    out = []
    for k in range(84):
        flat, j = k < 24, k % 24
        block = "p" if flat else ("div", "p", "section", "div")[k // 2 % 4]
        paragraphs = [f"<{block}>{line} {'More of it. ' * ((i * 7 + j) % 5)}{'<b>Bold words</b> and <a href=/x>a link</a>.' if i % 3 == 0 else ''}</{block}>" for i in range(2 + j % 6)]
        links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(4 + j % 7))
        title = "A heading of the page"
        box = ("article", "main", "div", "section")[k % 4]
        top = (f"<nav><ul>{links}</ul></nav>", f"<div><ul>{links}</ul></div>", f"<table><tr><td><a href=/>Home</a></td><td>{links}</td></tr></table>")[k % 3]
        foot = ("<footer>&copy; Somebody</footer>", "<div><ul><li><a href=/>Imprint</a></li></ul></div>", "<div>All rights reserved</div>")[k % 3]
        items = "".join(f"<li>{line} <a href=/{i}>A link</a> and more.</li>" for i in range(3 + j % 5 if flat else 4))
        quote = f"<blockquote>{line}</blockquote><h2>{title}</h2><table><tr><td>{line}</td><td>A cell</td></tr></table>"
        more = (f"<ul>{items}</ul>" if k % 2 or not flat else "") + (quote if k % 3 == 1 or not flat else "")
        if flat:
            main = f"<h1>{title}</h1>{''.join(paragraphs)}{more}"
        else:
            more += f"<ul>{items}</ul>"
            figure = f"<figure><div><img src=/x></div><figcaption>{line}</figcaption></figure>"
            code = f"<div><pre><code><span>words</span> of <span>code</span></code></pre></div><p><em>{line}</em> <strong>and</strong> <i>more</i> <span>of <code>it</code></span><br>{line}</p>"
            between = "<div class=ad>Buy this now</div>" * 3 + ("<div class=ad>Buy this now</div>", "<aside>See also</aside>", "<form>Your mail</form>", "<script>1</script>", "<nav>Contents</nav>")[k % 5]
            dl = f"<dl><dt>{title}</dt><dd>{line}</dd></dl>"
            sections = "".join(f"<section><h2>{title}</h2>{x}</section>" for x in (paragraphs[0], "".join(paragraphs[1:] * (3 + (j > 8)))))
            main = (
                f"<h1>{title}</h1><div>{figure}{sections}{between}{code}{between}{more}</div>",
                f"<div><h1>{title}</h1></div><div>{''.join(paragraphs * 6)}</div>{between}<div>{dl}{figure}</div>{more}",
                f"<section><h1>{title}</h1></section><div>{figure}{sections}{between}{code}{between}<section>{more}</section><div>{line}</div></div>",
            )[k // 3 % 3]
            if box == "main":
                main = (main, f"<article>{main}</article>", f"<h1>{title}</h1><article>{main}</article><article>{''.join(paragraphs)}</article>")[k // 4 % 3]
        inner = f"<div><ul>{links}</ul></div>" if box == "main" and not flat else ""  # a menu in the main element
        out.append((f"<html><body>{top}<div class=ad>Buy this now</div><{box}>{inner}<!--main-->{main}<!--/main--></{box}>{foot}</body></html>", main))
    return out


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = weights or train(labelled_pages())

    def run(batches):
        for batch in W.slices(batches, 2):
            texts = [extract(page, weights) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
