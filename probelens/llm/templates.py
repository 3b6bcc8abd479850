"""Main text of web pages by template deduction over the pages of a host (equivalence classes, Arasu and Garcia-Molina, 2003).

Tokens of a page are its elements by path (tags with their class, id and role from the root on; digits count as one sign)
and its text blocks by path and content. Pass 1 adds up for each host and token on how many pages it occurs, how often,
and its *occurrence vector*: the sum over pages of a hash of the page times the occurrences there. Tokens of one vector
are a class. The skeleton is the class of what is once on each page. Other classes that are on half of the pages, and on
three, are kept where they hold an element and nest into one place of the skeleton; all of them are the template, and a
text in one of them is the template's own, not the page's. Elements that occur once a page make the slots. The main slot is
found by going down from the root while one slot has half of the words that are neither fixed nor in an element made for
something else. Pass 2 reads every page again and takes the main slot's remaining text.

Elements made for something else: navigation, footers, forms and the like by tag; by the words of class, id and role;
lists of links; what follows a heading of reader comments. Such an element counts all the same if it holds an article, or
the page's first heading and half of the page's words.

A page whose host has fewer than three pages, or that lacks its host's main slot, is cut by its own words in the same way.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.llm.common import written
from probelens.llm.urlfilter import parts

#: comments, declarations, and tags with their attributes
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>", re.S)
_NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# fixed values: element kinds
RAW = frozenset("script style noscript template textarea iframe svg math object canvas audio video select title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
SLOTS = frozenset("article body center div html main section table tbody td tr".split())
LISTS = frozenset("div dl menu ol section table td ul".split())
ELSEWHERE = frozenset("aside button dialog footer form head header input label menu nav search".split())
# fixed values: words of class, id and role names
NAMES = frozenset("""ad ads advert advertisement adverts advertising alert aside banner breadcrumb breadcrumbs byline comment commentaries commentlist comments
complementary consent contentinfo cookie cookies copyright discussion disqus feedback footer form gdpr header hidden legal login masthead menu modal
nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promoted promotion recommended related replies reply
respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toc toolbar topbar widget widgets""".split())
# fixed values: headings of reader comments
COMMENTS = re.compile(r"(?:\d+\s+)?(?:(?:reader|user)\s+)?(?:comments?|replies|kommentare?|commentaires?|comentarios?|leave a (?:reply|comment)|join the discussion|schreiben sie einen kommentar|laisser un commentaire|deja un comentario)\s*(?:\(?\d+\)?)?\s*:?", re.I)
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
#: a tag that the end of the page cuts off
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
#: what a start tag ends, and up to where
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
#: share of the pages of a host on which the template's tokens are, and pages at least
SUPPORT, LEAST = 0.5, 3
#: a list of links has at least this share of its words in links
LINKS = 0.66


class Page:
    """The elements and text blocks of a page.

    Element i: token[i] (hash of its path), up[i] (the element around it), tag[i], away[i] (made for something else),
    words[i], linked[i] (words of its text, and those in links). A block: (element, text, token).
    """

    def __init__(self, html: str):
        self.token, self.up, self.tag, self.away, self.words, self.linked, self.links = [0], [-1], [""], [False], [0], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(html)
        for i in range(len(self.token) - 1, 0, -1):
            for of in (self.words, self.linked, self.links):
                of[self.up[i]] += of[i]
        self._judge()

    def _read(self, html: str) -> None:
        stack, parts, linked, at, links = [0], [], 0, 0, 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    i = next(x for x in reversed(stack) if not x or self.tag[x] in BLOCKS)
                    n = text.count(" ") + 1
                    self.words[i] += n
                    self.linked[i] += min(linked, n)
                    self.blocks.append((i, text, xxhash.xxh64_intdigest(text, self.token[i])))
            linked = 0

        def put(text: str) -> None:
            nonlocal linked
            if text:
                parts.append(text)
                if links:
                    linked += len(text.split())

        def pop_to(k: int) -> None:
            nonlocal links
            for x in stack[k:]:
                links -= self.tag[x] == "a"
            del stack[k:]

        while m := _MARKUP.search(html, at):
            put(html[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if tag in BLOCKS:
                flush()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        pop_to(k)
                        break
                    if tag not in BLOCKS and self.tag[stack[k]] in BLOCKS:
                        break
                continue
            if tag in RAW:
                end = _ENDS[tag].search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag in VOID:
                put(" " if tag == "br" else "")
                continue
            if tag in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == "p":
                        pop_to(k)
                        break
                    if self.tag[stack[k]] in BLOCKS:
                        break
                ended, until = ENDS.get(tag, ((), ()))
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] in ended:
                        pop_to(k)
                        break
                    if self.tag[stack[k]] in until:
                        break
            elif tag == "a" and links:
                k = max(k for k in range(len(stack)) if self.tag[stack[k]] == "a")
                pop_to(k)
            own = self._open(tag, m[3], stack[-1])
            if tag == "a":
                links += 1
                self.links[stack[-1]] += 1
            stack.append(own)
        put(_CUT_OFF.sub("", html[at:]))
        flush()

    def _open(self, tag: str, rest: str, up: int) -> int:
        label, away, named = tag, tag in ELSEWHERE, False
        if rest and not rest.isspace():
            got = [(k.lower(), a or b or c) for k, a, b, c in _NAMED.findall(rest)]
            if got:
                label += "".join(f" {k}={re.sub(r'[0-9]+', '#', ' '.join(sorted(v.split())))}" for k, v in sorted(got))
                if tag not in ("html", "body", "main"):
                    named = any(w.lower() in NAMES for k, v in got if k != "itemprop" for w in _WORDS.findall(v))
                if any(k == "role" and v.lower() == "main" or k == "itemprop" and v.lower() == "articlebody" for k, v in got):
                    tag, away, named = "main", False, False
            away = away or bool(_HIDDEN.search(rest))
        i = len(self.token)
        inside = up
        while inside > 0 and self.tag[inside] not in ("article", "main"):
            inside = self.up[inside]
        if tag == "header" and inside > 0 and not named:
            away = False  # an article's own heading
        self.token.append(xxhash.xxh64_intdigest(label, self.token[up]))
        self.up.append(up)
        self.tag.append(tag)
        self.away.append(away or named)
        for of in (self.words, self.linked, self.links):
            of.append(0)
        return i

    def _judge(self) -> None:
        n, total = len(self.token), self.words[0]
        holds, head = [False] * n, [False] * n
        heads = [i for i in range(n) if self.tag[i] == "h1"][:1]
        for i in range(n - 1, 0, -1):
            holds[i] |= self.tag[i] in ("article", "main") and not self.away[i]
            holds[self.up[i]] |= holds[i]
        for i in heads:
            while i >= 0:
                head[i], i = True, self.up[i]
        for i in range(1, n):
            lists = self.tag[i] in LISTS and self.links[i] > 1 and self.linked[i] > LINKS * self.words[i]
            own = (self.away[i] or lists) and not holds[i] and not (head[i] and 2 * self.words[i] >= total)
            self.away[i] = own or self.away[self.up[i]]
        ended: dict[int, int] = {}  # element -> block from which reader comments fill the rest of it
        for b, (i, text, _) in enumerate(self.blocks):
            if len(text) < 60 and not self.away[i] and self.tag[i] != "h1" and COMMENTS.fullmatch(text):
                of = self.up[i] if self.tag[i] != "div" else i
                rest = sum(t.count(" ") + 1 for j, t, _ in self.blocks[b:] if of in self.inside(j))
                if 2 * rest < total:
                    ended.setdefault(of, b)
        self._ended = ended

    def inside(self, i: int) -> Iterator[int]:
        while i >= 0:
            yield i
            i = self.up[i]

    def kept(self, fixed: frozenset = frozenset()) -> list[tuple[int, str]]:
        """(element, text) of the blocks that are neither in an element made for something else nor the template's."""
        out = []
        for b, (i, text, token) in enumerate(self.blocks):
            if self.away[i] or token in fixed or any(self._ended.get(x, b + 1) <= b for x in self.inside(i)):
                continue
            out.append((i, text))
        return out


def _masses(page: Page, kept: list[tuple[int, str]]) -> list[int]:
    out = [0] * len(page.token)
    for i, text in kept:
        out[i] += text.count(" ") + 1
    for i in range(len(out) - 1, 0, -1):
        out[page.up[i]] += out[i]
    return out


def _descend(children: dict, mass: dict, tag: dict, root) -> object:
    """From the root down while one slot has half of the words, or an article a fifth of them."""
    at = root
    while True:
        below = sorted((c for c in children.get(at, ()) if tag[c] in SLOTS and mass[c] > 0), key=lambda c: (-mass[c], str(c)))
        named = [c for c in below if tag[c] in ("article", "main") and 5 * mass[c] >= mass[at]]
        if named:
            at = named[0]
        elif below and 2 * mass[below[0]] >= mass[at]:
            at = below[0]
        else:
            return at


def _text(page: Page, main: int | None, fixed: frozenset) -> str:
    """The main slot's text; main: its token, or None."""
    slots = {i for i in range(len(page.token)) if page.token[i] == main and not page.away[i]} if main is not None else set()
    within = lambda kept, of: [text for i, text in kept if any(x in of for x in page.inside(i))]
    if slots:
        out = within(page.kept(fixed), slots) or within(page.kept(), slots)  # nothing left: the page is what recurs
    else:
        kept = page.kept(fixed) or page.kept()
        mass = _masses(page, kept)
        children: dict[int, list[int]] = {}
        for i in range(1, len(page.token)):
            children.setdefault(page.up[i], []).append(i)
        best = _descend(children, dict(enumerate(mass)), dict(enumerate(page.tag)), 0)
        alike = {i for i in range(len(page.token)) if page.token[i] == page.token[best] and page.up[i] == page.up[best]} if best else {0}
        out = within(kept, alike)
    return "\n\n".join(out)


TOKENS = "host string, token long, text boolean, up long, tag string, pages long, times long, va long, vb long, words long"
#: tokens that a task adds up before it passes them on
HELD = 200_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages (host, url, html) -> TOKENS, added up within some hundred thousand tokens. Token 0 counts the host's pages."""
    held: dict[tuple, list] = {}  # up, tag, pages, times, va, vb, words

    def packed() -> pd.DataFrame:
        rows = [(host, _signed(t), text, _signed(up), *rest) for (host, t, text), (up, *rest) in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=[x.split()[0] for x in TOKENS.split(", ")])

    for pdf in batches:
        for host, url, html in zip(pdf["host"], pdf["url"], pdf["html"]):
            page, own = Page(html or ""), {}
            mark = xxhash.xxh64_intdigest(html or "", xxhash.xxh64_intdigest(url or ""))
            mass = _masses(page, page.kept())
            for i, token in enumerate(page.token):
                if not page.away[i]:
                    got = own.setdefault((host, token, False), [page.token[page.up[i]] if i else 0, page.tag[i], 0, 0])
                    got[2] += 1
                    got[3] += mass[i]
            for i, text, token in page.blocks:
                if not page.away[i]:
                    got = own.setdefault((host, token, True), [page.token[i], "", 0, 0])
                    got[2] += 1
                    got[3] += text.count(" ") + 1
            for key, (up, tag, times, words) in own.items():
                total = held.setdefault(key, [up, tag, 0, 0, 0, 0, 0])
                total[2] += 1
                total[3] += times
                total[4] += (mark & 0x7FFFFFFF) * times  # two sums of 31 bits stay exact
                total[5] += (mark >> 33) * times
                total[6] += words
            if len(held) > HELD:
                yield packed()
    yield packed()


def deduce(rows: list) -> tuple[int | None, list[int]]:
    """(token of the main slot or None, tokens of the template's texts) from one host's tokens that are frequent."""
    by = {(r["token"], r["text"]): r for r in rows}
    element = {r["token"]: r for r in rows if not r["text"]}
    skeleton = (element[0]["va"], element[0]["vb"])  # once on each page
    classes: dict[tuple, list] = {}
    for r in rows:
        classes.setdefault((r["va"], r["vb"]), []).append(r)
    fixed = set()
    for vector, own in classes.items():
        if all(r["text"] for r in own):
            continue
        around = set()
        for r in own:
            up = r["up"]
            while up in element and (element[up]["va"], element[up]["vb"]) != skeleton:
                up = element[up]["up"]
            around.add(up)
        if len(around) == 1 or vector == skeleton:
            fixed |= {r["token"] for r in own if r["text"]}
    mass = {t: r["words"] for t, r in element.items()}
    for t in fixed:
        r = by[(t, True)]
        up = r["up"]
        while up in element:
            mass[up] -= r["words"]
            if not up:
                break
            up = element[up]["up"]
    children: dict[int, list[int]] = {}
    for t, r in element.items():
        if t and r["times"] == r["pages"]:
            children.setdefault(r["up"], []).append(t)
    main = _descend(children, mass, {t: r["tag"] for t, r in element.items()}, 0)
    return (main if main else None), sorted(fixed)


def templates(pages: DataFrame, support: float = SUPPORT, least: int = LEAST) -> DataFrame:
    """pages(host, url, html) -> (host, main, fixed): the template of each host with ``least`` pages; main: the main slot's token, or none."""
    keys = ("host", "token", "text")
    found = pages.select("host", "url", "html").mapInPandas(_tokens, TOKENS)
    total = found.groupBy(*keys).agg(F.min("up").alias("up"), F.min("tag").alias("tag"), *[F.sum(c).alias(c) for c in ("pages", "times", "va", "vb", "words")])
    total = written(total.where(F.col("pages") >= least), "tokens")
    hosts = total.where("token = 0 and not text").select("host", F.col("pages").alias("_n"))
    often = total.join(hosts, "host").where(F.col("pages") >= support * F.col("_n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        main, fixed = deduce(pdf.to_dict("records"))
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "main": [[] if main is None else [main]], "fixed": [fixed]})

    # a host's frequent tokens are at most as many as a page has, over the support
    return often.groupBy("host").applyInPandas(run, "host string, main array<long>, fixed array<long>")


def main_text(pages: DataFrame, url: str = "url", html: str = "html", max_sent_bytes: int = 32 << 20) -> DataFrame:
    """pages(url, html) -> its columns but html, and text: the main text, blocks joined by an empty line.

    A row for each row; null and empty pages, and pages without main text, have an empty text. A null url, or one without
    ://, is of the host ''. Inside a block white space is one space and references are decoded. Nothing is cut or capped.
    Templates up to max_sent_bytes are sent to the tasks; beyond, pages and templates are joined by host.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in (html, "text")]
    rows = pages.select(F.struct(F.lit(0).alias("_"), *kept).alias("row"), parts(url)[0].alias("host"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    found = written(templates(rows.select("host", "url", "html")), "templates")
    whole = lambda df, text: df.select(*[F.col("row")[c].alias(c) for c in kept], text.alias("text"))
    size = found.agg(F.sum(F.size("fixed") * 8 + F.length("host") + 200)).first()[0] or 0  # one number

    def cut(known, own: Iterator[tuple]) -> pd.Series:
        out = []
        for host, page, *inline in own:
            main, fixed = ([int(x) % 2**64 for x in own] if own is not None else [] for own in (known.get(host, ((), ())) if known is not None else inline))
            out.append(_text(Page(page), main[0] if main else None, frozenset(fixed)) if page else "")
        return pd.Series(out, dtype=object)

    if size <= max_sent_bytes:
        sent = spark.sparkContext.broadcast({r["host"]: (r["main"], r["fixed"]) for r in found.collect()})

        @F.pandas_udf("string")
        def text(host: pd.Series, page: pd.Series) -> pd.Series:
            return cut(sent.value, zip(host, page))

        return whole(rows, text("host", "html"))

    @F.pandas_udf("string")
    def joined(host: pd.Series, page: pd.Series, main: pd.Series, fixed: pd.Series) -> pd.Series:
        return cut(None, zip(host, page, main, fixed))

    return whole(rows.join(found, "host", "left"), joined("host", "html", "main", "fixed"))
