"""Main text of web pages by consensus of their host's pages.

Each page is read once into blocks of text and the elements that contain them. A block's characters,
less twice those in links, count for the element it stands in, and half for the next one out; all elements of a page that
hold text vote for their paths, the tags and classes from the root with digits generalised.
Votes are summed for each host in Spark, and every page is read again: elements on the host's winning
path give the text. From there the article is completed outwards, as an article may have its parts in containers of
their own: of every element around the winner, below the page's body, its own text is taken, and what else it contains,
if that isn't mostly links; all that an article or main element contains is taken. A page on which the winning path holds less than LEAST_PART of what
its own best elements hold has another layout, and takes its own.

Menus, footers, sidebars, dialogs and hidden elements, known by their tag, role or hiding, are left out with all
they contain, and so is a header outside of an article or main element; inside it holds the headline and stays.
An element that a class or id names like a notice, an advert, a sidebar or reader comments and like nothing else (`related-posts`, but not
`related-work`), or a form, is suspect: text counts PENALTY for each suspect element around it, and the vote decides. Suspect elements inside of
what is taken are left out; one that wins itself, as it may on a host whose pages have their article in it, is taken.
A page takes suspect elements of its own only if its host's path is suspect.

Reading takes time in proportion to the page, whatever its nesting and its stray tags.

Defined cases: null or empty html gives an empty text; pages without host are a host; html that
breaks off is read as far as it goes, an unfinished tag or comment is dropped; <br> is white space,
not the end of a block; a page whose every element is left out has an empty text; of paths with equal votes the
one with the greater hash wins; texts and nesting may be of any length and depth; repeated rows each get a result;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripmill.llm.common import cut_table, partitions, scope, small_batches
from stripmill.llm.urls import host_of

#: The part of the best elements' text that the host's must have.
LEAST_PART = 0.4
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*(?=>|\Z)|[^>]*)(>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: What a block counts for each suspect element around it.
PENALTY = 0.05
#: What these contain is not markup, and never text of the page.
RAW = frozenset("script style noscript template iframe textarea title svg select annotation annotation-xml".split())
LEFT_OUT = frozenset("head nav header footer aside menu dialog button".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog toolbar".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th figcaption caption summary address".split())
BLOCK = LEAF | LEFT_OUT | frozenset("html body div article section main form ul ol dl table thead tbody tfoot tr figure details fieldset center hgroup".split())
OUTERMOST = frozenset(("", "html", "body"))
VOID = frozenset("br img hr input meta link area base col embed source track wbr param".split())
#: An element that opens ends an open one of these, unless one of the others stands between.
ENDS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "body": (("head",), ("body",))}
#: End tags that reach out of a table's cell.
OUT_OF_CELLS = frozenset("tr table tbody thead tfoot body html".split())
#: Elements that hold nothing but the article, as far as their parts aren't left out or suspect.
WHOLE = frozenset(("article", "main"))
#: Parts of class names and ids that make an element suspect.
WORDS = re.compile(
    r"ad|ads|adv|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w*|nav\w*|menus?|breadcrumbs?|sidebar\w*|side|aside|widgets?|related|recommend\w*|share|sharing|social|comment\w*|repl(?:y|ies)|respond|disqus|footer|foot|header|masthead|topbar|login|signup|register|pagination|pager|toolbar|hidden|skip|search",
    re.I,
)
#: Parts that may stand beside these and say nothing of what an element holds.
PLAIN = frozenset("area bar block blocks box btn button buttons column col container bottom center content form frame group header footer holder icon icons inner item items label left link links list main middle outer page panel post posts primary right row secondary section site slot text title top unit view wrap wrapper thread threads user users reader readers message messages policy".split())
#: Class names that say what an element holds, whatever else it is called; and parts of names that tell of a state.
CONTENT = frozenset("article content main post entry story body text".split())
STATES = frozenset("has with without no is on off xs sm md lg xl".split())


def suspect(names: str) -> bool:
    """Whether an element's classes and id name it like something that is not the article: a name all of whose parts are WORDS
    or PLAIN, one of WORDS among them."""
    names = names.lower().split()
    if any(n in CONTENT for n in names):
        return False
    parts = [[q for q in (p.rstrip("0123456789") for p in re.split(r"[_-]+", n)) if q] for n in names]
    known = lambda n: all(p in PLAIN or WORDS.fullmatch(p) for p in n) and any(WORDS.fullmatch(p) for p in n)
    return any(not STATES.intersection(n) and known(n) for n in parts)


def path_key(path: str, above: int = 0) -> int:
    """A 63-bit hash of a path, from that of the path above it."""
    for name in path.strip("/").split("/"):
        above = xxhash.xxh64_intdigest(name, above) >> 1
    return above


class Page:
    """Blocks of a page's text and the elements around them."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.parent, self.keys, self.leaf, self.outermost, self.whole = [-1], [0], [False], [True], [False]
        self.suspects = [0]  # suspect elements around each element, itself included
        self._stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element, left out
        self._open_at: dict[str, list[int]] = {}  # places in the stack by tag
        self._parts: list[str] = []
        self._linked, self._link, self._articles = 0, False, 0
        self._read(html or "")

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((self._stack[-1][1], text, self._linked))
            self._parts, self._linked = [], 0

    def _text(self, data: str) -> None:
        if data and not self._stack[-1][2]:
            data = unescape(data)
            self._parts.append(data)
            if self._link:
                self._linked += len(data)

    def _read(self, html: str) -> None:
        at = 0
        while True:
            m = TOKEN.search(html, at)
            if m is None:
                break
            self._text(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
            elif not m[4]:
                break  # the page ends within a tag
            elif tag in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif tag not in VOID:
                self._open(tag, m[3])
            elif tag != "wbr":
                self._text(" ")
        self._text(html[at:])
        self._flush()

    def _open(self, tag: str, attributes: str) -> None:
        if tag not in BLOCK:
            self._link |= tag == "a"
            return
        self._flush()
        self._link = False
        if self._stack[-1][0] == "p":
            self._drop(len(self._stack) - 1)
        if tag in ENDS:
            ended, between = (max(map(self._last, tags)) for tags in ENDS[tag])
            if ended > between:
                self._drop(ended)
        _, above, out = self._stack[-1]
        name, doubtful = tag, tag == "form"
        if not out:
            out = tag in LEFT_OUT and not (tag == "header" and self._articles)
            if attributes.strip():
                has = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
                out = out or "hidden" in has or has.get("aria-hidden") == "true" or has.get("role", "").lower() in LEFT_OUT_ROLES or bool(re.search(r"display\s*:\s*none", has.get("style", "")))
                doubtful = doubtful or has.get("role", "").lower() in ("form", "note") or tag not in ("html", "body") and suspect(f"{has.get('class', '')} {has.get('id', '')}")
                if has.get("class"):
                    name += "." + ".".join(sorted(set(re.sub(r"\d+", "#", has["class"]).replace("/", "|").lower().split())))
        if not out:
            self.parent.append(above)
            self.keys.append(path_key(name, self.keys[above]))
            self.leaf.append(tag in LEAF)
            self.outermost.append(tag in OUTERMOST)
            self.whole.append(tag in WHOLE)
            self.suspects.append(self.suspects[above] + doubtful)
            above = len(self.keys) - 1
            self._articles += tag in WHOLE
        self._open_at.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, above, out))

    def _last(self, tag: str) -> int:
        """Place in the stack of the innermost open element of a tag, or 0."""
        places = self._open_at.get(tag)
        return places[-1] if places else 0

    def _drop(self, at: int) -> None:
        """Ends the open elements from a place in the stack on."""
        while len(self._stack) > at:
            tag, _, out = self._stack.pop()
            self._open_at[tag].pop()
            self._articles -= tag in WHOLE and not out

    def _close(self, tag: str) -> None:
        if tag not in BLOCK:
            if tag == "a":
                self._link = False
            elif tag == "br":
                self._text(" ")
            return
        self._flush()
        self._link = False
        at = self._last(tag)
        # an end tag in a table's cell or in what is left out does not reach beyond it
        if at and (tag in OUT_OF_CELLS or tag in ("td", "th") or at > max(self._last("td"), self._last("th"))):
            self._drop(at)

    def scores(self) -> dict[int, tuple[float, float]]:
        """Score of each element that holds text, and the part of it that is its own text."""
        out: dict[int, tuple[float, float]] = {}
        for element, text, linked in self.blocks:
            worth = max(0, len(text) - 2 * linked) * PENALTY ** self.suspects[element]
            if self.leaf[element]:
                element = self.parent[element]
            for part, own in ((1.0, 1.0), (0.5, 0.0)):
                if element > 0:
                    score, direct = out.get(element, (0.0, 0.0))
                    out[element] = score + part * worth, direct + own * worth
                    element = self.parent[element]
        return out

    def best(self) -> list[tuple[float, int, float, int]]:
        """Scores, paths, own scores and suspect elements around the page's elements that hold text, best first; an element
        outside comes after."""
        found = sorted(((s, k, own) for k, (s, own) in self.scores().items() if s > 0), reverse=True)
        return [(s, self.keys[k], own, self.suspects[k]) for s, k, own in found]

    def within(self, *paths: str | int) -> list[str]:
        """Blocks inside the elements on any of the paths, in page order, but for suspect ones inside of these."""
        return self._inside({path_key(p) if isinstance(p, str) else p for p in paths})

    def _inside(self, paths: set[int]) -> list[str]:
        inside = [False] * len(self.keys)
        for k in range(1, len(self.keys)):
            above = self.parent[k]
            inside[k] = self.keys[k] in paths or inside[above] and self.suspects[k] == self.suspects[above]
        return [text for element, text, _ in self.blocks if inside[element]]

    def _completed(self, path: int) -> list[str]:
        """Blocks inside the elements on the path, and what belongs to the same article around them."""
        worth = [0] * len(self.keys)
        for element, text, linked in self.blocks:
            worth[element] += max(-len(text), len(text) - 2 * linked)
        for k in range(len(self.keys) - 1, 0, -1):
            worth[self.parent[k]] += worth[k]
        # all: an element is taken with what it contains; some: with its own text and parts that aren't mostly links
        all_, some = [False] * len(self.keys), [False] * len(self.keys)
        for k in range(1, len(self.keys)):
            if self.keys[k] == path:
                all_[k] = True
                above = self.parent[k]
                while above > 0 and not some[above] and not self.outermost[above] and self.suspects[above] == self.suspects[k]:
                    some[above] = True
                    above = self.parent[above]
        for k in range(1, len(self.keys)):
            above = self.parent[k]
            if not all_[k] and self.suspects[k] == self.suspects[above]:
                all_[k] = all_[above] or some[above] and not some[k] and (self.leaf[k] or worth[k] > 0)
            if some[k] and self.whole[k]:
                all_[k] = True
        return [text for element, text, _ in self.blocks if all_[element] or some[element]]

    def text(self, host_path: str | int | None, doubtful: bool = True) -> str:
        """doubtful: whether suspect elements may be the page's own."""
        if isinstance(host_path, str):
            host_path = path_key(host_path)
        best = next((x for x in self.best() if doubtful or not x[3]), None)
        own = self._completed(best[1]) if best else [text for element, text, _ in self.blocks if not self.suspects[element]]
        found = self._completed(host_path) if host_path is not None else []
        if not found or sum(map(len, found)) < LEAST_PART * sum(map(len, own)):
            found = own
        return "\n".join(found)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, int, bool], float] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            best = Page(html.as_py()).best()
            for score, path, _, suspects in best:
                votes[host, path, suspects > 0] = votes.get((host, path, suspects > 0), 0.0) + score / best[0][0]
        if votes:
            hosts, paths, doubtful = zip(*votes)
            columns = [pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(doubtful, pa.bool_()), pa.array(votes.values(), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["host", "path", "doubtful", "votes"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        won = zip(batch.column(2), *(batch.column(k).to_pylist() for k in (3, 4)))
        texts = [Page(html.as_py()).text(path, doubtful is not False) for html, path, doubtful in won]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    spark = pages.sparkSession
    small_batches(spark)
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), F.col("html").cast("string").alias("html"))
    with scope(spark) as keep:
        votes = rows.select("host", "html").mapInArrow(_voted, "host string, path long, doubtful boolean, votes double").groupBy("host", "path")
        votes = votes.agg(F.round(F.sum("votes"), 6).alias("votes"), F.max("doubtful").alias("doubtful"))
        top = votes.groupBy(F.col("host").alias("at")).agg(F.max(F.struct("votes", "path", "doubtful")).alias("top"))
        # hosts with more than their share of the pages are few, so the rest can be shuffled by host
        pages_of = rows.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("many"))
        share = max(1000, rows.count() // (4 * partitions(spark)))
        won = top.select(F.col("at").alias("of"), "top.path", "top.doubtful")
        won = keep(cut_table(won.join(pages_of, F.col("of") == F.col("h")).withColumn("hot", F.col("many") > share).drop("h", "many")))
    hot = won.where("hot").select(F.col("of").alias("hot_host"), F.struct("path", "doubtful").alias("x"))
    cold = won.where("not hot").select("of", F.struct("path", "doubtful").alias("y"))
    met = rows.join(F.broadcast(hot), F.col("host") == F.col("hot_host"), "left")
    spread = F.when(F.col("hot_host").isNotNull(), F.concat(F.lit("/"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("host"))  # no host has a slash
    met = met.withColumn("by", spread).join(cold, F.col("by") == F.col("of"), "left").withColumn("w", F.coalesce("x", "y"))
    return met.select("page_id", "url", "html", "w.path", "w.doubtful").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
