"""HTML extraction (operator 8): consensus host paths."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import join_small, saved, table

# Elements by their role, and words in class, id or role that mark what is not article text.
CONTAINERS = set("html body main article section div td th tr table tbody ul ol dl nav header footer aside form fieldset figure blockquote details dialog center".split())
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd pre hr br address figcaption summary caption thead tfoot legend option".split())
NEVER = set("nav footer aside form head menu dialog button select iframe object svg canvas template noscript audio video".split())
VOID = set("br hr img input meta link area base col embed source track wbr".split())
NOISE = set("ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert modal popup overlay paywall nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets related recommended share sharing social newsletter subscribe subscription signup login comment comments reply replies respond discussion disqus footer masthead topbar toolbar pagination pager search complementary contentinfo skip toc tags".split())
#: Words that say of a name how its thing is laid out, not what it is: a name means what stands before them.
SHELL = set("container containers wrapper wrap inner outer box boxes block section area list items item holder panel bar group row col column columns grid content body main text title heading head header left right top bottom primary secondary mobile desktop link links button buttons btn icon form post posts article articles story stories thread feed".split())
#: A name with one of these says what a thing has or stands beside.
BESIDE = set("has with no without not below above under after before".split())
TEXT_WORDS = set("content article post entry story body text main".split())
# Names of a container that holds one whole article, unless one of the others says that it holds the page's layout.
UNIT, AROUND = set("article post entry story".split()), set("layout wrapper container page".split())
#: Blocks whose id names what they are about, as the target of a link; what readers' words are called, also as articles.
ABOUT, READERS = set("h1 h2 h3 h4 h5 h6 p li dt dd pre summary caption figcaption address".split()), set("comment comments reply replies".split())
#: Elements that are never marked: the page itself.
WHOLE = set("html body main".split())

HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Elements that a block closes if they are still open (a paragraph: by any block), and where that search ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, "thead": {"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, "tfoot": {"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}}
CLOSES |= dict.fromkeys(HEADINGS, HEADINGS)
SCOPE = set("table ul ol dl select".split())

# A quote has a meaning only after the sign that gives an attribute its value; unquoted values end at white space, < or >.
_ATTRS = r"(?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s<>\"'][^\s<>]*+)?+)*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>script|style|textarea|title|noscript|iframe|template)\b{_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>{_ATTRS})>",
    re.S | re.I,
)
ATTR = re.compile(r"(?:^|(?<=[\s/\"']))([^\s=<>/\"']+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))")
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: Paths of a host that its pages choose from, and the share of a page's best score from which a container gets a vote.
#: A page that has none of these paths is read by its own best container.
PATHS, SHARE = 8, 0.5
#: A path is boilerplate if so many different pages of a host have it for each text that it holds there, and no fewer
#: than as many pages.
REPEATED = 5


class Page:
    """One walk over a page: containers (number of the path, parent, boilerplate or not, bonus, the highest article and the
    highest main around it or itself, whether repetition may make it boilerplate: in no article) and text blocks in page
    order.

    A path is a hash of its parent's and its own name, so a container's memory does not grow with its depth.
    """

    def __init__(self, source: str):
        self.paths, self.parent, self.noise, self.bonus = [0], [-1], [False], [1.0]
        self.article, self.main, self.plain = [0], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters inside links
        # Open blocks: tag, the container it is or stands in, boilerplate or not.  How many of each tag are open spares
        # the search for one that is not.
        self.stack, self.open = [("", 0, False)], {}
        # An inline element that is boilerplate: its tag, how many of it are open, and the depth of the stack around it.
        self.mute = None
        text, linked, in_link, at = [], 0, False, 0

        def close():
            nonlocal text, linked
            _, container, hush = self.stack[-1]
            words = " ".join("".join(text).split())
            if words and not hush:
                self.blocks.append((container, words, linked))
            text, linked = [], 0

        for m in TOKEN.finditer(source):
            if m.start() > at and not self.mute:
                run = html.unescape(source[at : m.start()])
                text.append(run)
                linked += len(run) if in_link else 0
            at, tag = m.end(), (m["tag"] or "").lower()
            if not tag:
                continue
            if tag == "a":
                in_link = not m["end"]
            if tag not in BLOCKS and tag not in NEVER:
                self._inline(tag, m["attrs"], m["end"])
                continue
            if tag == "br":
                text.append(" ")
                continue
            close()
            if m["end"]:
                if self.open.get(tag):
                    while self._pop() != tag:
                        pass
                continue
            if self.stack[-1][0] == "p":
                self._pop()
            self._imply(CLOSES.get(tag, ()))
            if tag not in VOID:
                self._push(tag, m["attrs"])
        if at < len(source) and not self.mute:
            text.append(html.unescape(source[at:]))
        close()
        del self.stack, self.open, self.mute

    def _inline(self, tag: str, attrs: str, end: str) -> None:
        if self.mute:
            if tag == self.mute[0]:
                self.mute[1] += -1 if end else tag not in VOID
                if not self.mute[1]:
                    self.mute = None
        elif not end and attrs and tag not in VOID and not attrs.endswith("/") and self._names(tag, attrs)[0]:
            self.mute = [tag, 1, len(self.stack)]

    def _pop(self) -> str:
        tag = self.stack.pop()[0]
        self.open[tag] -= 1
        if self.mute and len(self.stack) < self.mute[2]:
            self.mute = None
        return tag

    def _imply(self, ends) -> None:
        """Closes what a new block ends without saying so, up to the table or list that holds both."""
        if not any(self.open.get(t) for t in ends):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k][0]
            if tag in SCOPE:
                return
            if tag in ends and not any(t in ends for t, _, _ in self._below(k)):
                while len(self.stack) > k:
                    self._pop()
                return

    def _below(self, k: int):
        """The open blocks under the k-th, down to a table or list."""
        for j in range(k - 1, 0, -1):
            if self.stack[j][0] in SCOPE:
                return
            yield self.stack[j]

    def _push(self, tag: str, attrs: str) -> None:
        noisy, name, bonus, unit = self._names(tag, attrs)
        _, up, hush = self.stack[-1]
        hush = hush or self.mute is not None
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag not in CONTAINERS and tag not in NEVER:
            self.stack.append((tag, up, hush or noisy))
            return
        head = tag == "header" and not self.open.get("article") and not self.open.get("main")
        self.paths.append(xxh64_intdigest(name, self.paths[up]))
        self.parent.append(up)
        self.noise.append(hush or noisy or head or tag in NEVER)
        self.bonus.append(bonus)
        here = len(self.paths) - 1
        self.article.append(self.article[up] or (here if unit else 0))
        self.main.append(self.main[up] or (here if tag == "main" else 0))
        self.plain.append(not self.article[here] and tag not in WHOLE)
        self.stack.append((tag, here, self.noise[here]))

    @staticmethod
    def _names(tag: str, attrs: str) -> tuple[bool, str, float, bool]:
        """Whether the attributes mark boilerplate; the tag with its classes, figures generalised; the score's factor;
        whether it holds an article as a whole."""
        classes, words, noisy = [], set(), False
        for m in ATTR.finditer(attrs or ""):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "style":
                noisy = noisy or bool(HIDDEN.search(value))
            if name not in ("class", "id", "role"):
                continue
            for one in value.split():
                parts = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower()) if w]
                words.update(parts)
                kind = Page._kind(parts)
                if kind in NOISE and not (name == "id" and tag in ABOUT) and (tag != "article" or kind in READERS):
                    noisy = True
            if name == "class":
                classes = sorted(re.sub(r"\d+", "#", c) for c in value.lower().split())
        if not noisy and attrs and "hidden" in attrs.lower():
            noisy = bool(re.search(r"(?:^|[\s/])hidden(?:[\s/]|$)", ATTR.sub(lambda m: " hidden " if m[1].lower() == "hidden" else " ", attrs), re.I))
        noisy = noisy and tag not in WHOLE
        bonus = 2.0 if tag in ("article", "main") or words & TEXT_WORDS else 1.0
        unit = tag == "article" or (tag not in WHOLE and bool(words & UNIT) and not words & AROUND)
        return noisy, ".".join([tag, *classes]), bonus, unit

    @staticmethod
    def _kind(parts: list[str]) -> str:
        """What a name's thing is: its last word that doesn't tell of layout alone."""
        return next((w for w in reversed(parts) if w not in SHELL), "") if BESIDE.isdisjoint(parts) else ""

    def drop(self, boilerplate: set[int]) -> None:
        """Marks the containers of these paths, and all in them, as boilerplate."""
        for c in range(1, len(self.paths)):
            self.noise[c] = self.noise[c] or self.noise[self.parent[c]] or (self.plain[c] and self.paths[c] in boilerplate)

    def digests(self) -> tuple[int, dict[int, int]]:
        """A number for the page's text, and one for each path's: the text directly in its containers."""
        every, of = [], {}
        for c, text, _ in self.blocks:
            if not self.noise[c]:
                every.append(text)
                if self.plain[c]:
                    of.setdefault(self.paths[c], []).append(text)
        number = lambda texts: xxh64_intdigest("\n".join(texts))
        return number(every), {p: number(t) for p, t in of.items()}

    def scores(self) -> dict[int, float]:
        """Each path's score: unlinked text directly in it, and half of what its inner containers score."""
        score = [0.0] * len(self.paths)
        for c, text, linked in self.blocks:
            if not self.noise[c]:
                score[c] += max(0, len(text) - 2 * linked)
        for c in range(len(score) - 1, 0, -1):
            score[self.parent[c]] += 0.5 * score[c]
        out: dict[int, float] = {}
        for c in range(1, len(score)):
            if not self.noise[c] and score[c] > 0:
                out[self.paths[c]] = out.get(self.paths[c], 0) + score[c] * self.bonus[c]
        return out

    def text(self, path: int) -> str:
        """The blocks of all containers of a path and of the articles around them, boilerplate inside them left out; of the
        rest of <main>, the blocks that are not mostly links."""
        whole, wide = [False] * len(self.paths), [False] * len(self.paths)
        for c in range(1, len(whole)):
            if self.paths[c] == path:
                whole[c] = True
                if not self.noise[c]:
                    whole[self.article[c]] = wide[self.main[c]] = True
        whole[0] = wide[0] = False
        for c in range(1, len(whole)):
            whole[c], wide[c] = whole[c] or whole[self.parent[c]], wide[c] or wide[self.parent[c]]
        return " ".join(t for c, t, linked in self.blocks if not self.noise[c] and (whole[c] or (wide[c] and len(t) > 2 * linked)))


def main_text(source: str | None, voted: list[int] | None, boilerplate: list[int] | None = None) -> str:
    """Text of the voted path that the page has and that holds text, in the order of the votes; else of its own best."""
    if not source:
        return ""
    page = Page(source)
    page.drop({p % (1 << 64) for p in boilerplate or []})
    scores = page.scores()
    for path in voted or []:
        path %= 1 << 64
        if path in scores and (found := page.text(path)):
            return found
    return page.text(max(scores, key=lambda p: (scores[p], p))) if scores else " ".join(t for c, t, _ in page.blocks if not page.noise[c])


def _host():
    return F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame, paths: int = PATHS) -> DataFrame:
    """(host, paths, repeated): the numbers of up to ``paths`` paths of each host, by the sum of the shares that its pages
    give them, and those of its boilerplate, which get no votes.

    A path is boilerplate if it holds the same texts over and over: at least ``REPEATED`` times as many different pages
    as different texts.  Copies of a page are one page here.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        signed = lambda x: x - (x >> 63 << 64)
        names = ["host", "path", "share", "page", "text"]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for host, source in zip(b.column("host").to_pylist(), b.column("html")):
                page = Page(source.as_py() or "")
                found, (whole, texts) = page.scores(), page.digests()
                best = max(found.values(), default=0)
                for path in found.keys() | texts.keys():
                    share = round(1000 * found[path] / best) if found.get(path, 0) >= SHARE * best > 0 else 0
                    text = texts.get(path)
                    for column, x in zip(out, (host, signed(path), share, signed(whole), None if text is None else signed(text))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), *[pa.int64()] * 4))], names)

    each = pages.select("host", "html").mapInArrow(run, "host string, path long, share long, page long, text long")
    # Copies are brought together first: what is counted are different pages and different texts.
    each = each.groupBy("host", "path", "page", "text").agg(F.sum("share").alias("share"))
    counted = each.groupBy("host", "path", "text").agg(F.sum("share").alias("share"), F.count("*").alias("pages"))
    counted = counted.groupBy("host", "path").agg(F.sum("share").alias("votes"), F.sum(F.when(F.col("text").isNotNull(), F.col("pages"))).alias("pages"), F.count("text").alias("texts"))
    repeated = F.coalesce(F.col("pages") >= REPEATED * F.col("texts"), F.lit(False)) & (F.col("texts") > 0)
    counted = saved(counted.withColumn("repeated", repeated).filter("repeated or votes > 0").select("host", "path", "votes", "repeated"))
    ranked = counted.filter("not repeated").withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).filter(F.col("rank") <= paths)
    known = ranked.unionByName(counted.filter("repeated").withColumn("rank", F.lit(None).cast("int")))
    chosen = F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "path"))))
    return known.groupBy("host").agg(F.transform(chosen, lambda x: x["path"]).alias("paths"), F.array_sort(F.collect_list(F.when(F.col("repeated"), F.col("path")))).alias("repeated"))


def extract(pages: DataFrame, *, paths: int = PATHS) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Every page's containers are scored and vote for their generalised tag-class paths (figures in class names become #);
    the votes are summed per host and path; each page is then read again by its host's ``paths`` most voted paths, the first
    that it has, and by its own best container if it has none of them.  From there the text is taken of the whole article
    (or, without links, <main>) around, so headings and parts in containers of other names are not lost.

    Left out at any depth: navigation, page headers, footers, asides, forms, scripts, styles, what is hidden, inline
    elements too, of which a class, id or role names adverts, notices, menus or comments (by its last word that does not
    tell of layout: ``comments-container`` is comments, ``related-work`` is not related), and paths that hold the same
    texts over a host's pages.  Headings and paragraphs are not judged by their ids.

    Null or empty html: empty text.  Null or odd url: hosts null and empty vote as hosts of their own.  Repeated rows: a
    row each.  Very long pages are read whole, in memory that grows with their length alone; cut-off markup is read as far
    as it goes.  Ties: paths of equal votes by number.  Empty table: no rows.  Other columns are ignored, whatever their names.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", _host())
    known = saved(votes(pages, paths))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = [main_text(s.as_py(), p, r) for s, p, r in zip(b.column("html"), b.column("paths").to_pylist(), b.column("repeated").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return join_small(pages, known, ["host"]).select("page_id", "url", "html", "paths", "repeated").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
