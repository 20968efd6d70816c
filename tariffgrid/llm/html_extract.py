"""Main text of web pages: block rules in two passes."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffgrid.llm.common import prepare, read_table
from tariffgrid.llm.quality_rules import STOP_WORDS

#: Elements whose content is never text; that start and end a block; that are no part of an article.
SILENT = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas audio video head title select option button textarea datalist".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset("br td th wbr img input".split())
OUTSIDE = frozenset("nav footer aside dialog menu search".split())
CONTENT = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that tell a part that is no article text; those of them whose parts hold prose of their own.
HINT = re.compile(
    r"ads?|adverts?|advertis\w*|banner|breadcrumbs?|comments?|commentlist|consent|contentinfo|cookies?|copyright|discussions?|disqus|footer|gdpr|guestbook|header|login|masthead|menu|nav(?:s|bar|box|links|list|menu|igation)?|modal|newsletter|"
    r"notices?|pager|pagination|popup|promos?|promotion|related|repl(?:y|ies)|respond|responses|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|talkback|teaser|toolbar|widgets?|complementary"
)
PROSE = re.compile(
    r"ads?|adverts?|advertis\w*|comments?|commentlist|consent|cookies?|copyright|discussions?|disqus|footer|gdpr|guestbook|modal|newsletter|popup|promos?|promotion|repl(?:y|ies)|respond|responses|sponsor\w*|talkback"
)
#: Words before `header` that say it is an article's own, which holds its title.
OWN = frozenset("article entry post story".split())
#: Words that may follow such a word and name a piece of the part; words before it that say the element isn't the part.
PARTS = frozenset(
    "area articles bar bars block blocks body bottom box boxes btn button buttons card cards container content count cta feed field footer form group head header heading holder icon icons inner input item items label "
    "law leaderboard left link links list lists menu message nav notice outer panel placement policy popup post posts preferences right row section settings slot stories text thread title toggle tools top unit widget widgets wrap wrapper".split()
)
NOT = frozenset("has have hide is no non not with without".split())
#: Letters that are not Latin ones; those of scripts without spaces, two of which count as a word; ends and joints of sentences.
_OTHER = re.compile(r"[\u0370-\u1dff\u2c00-\u2dff\u3040-\ud7ff\uf900-\ufdff\ufe70-\ufeff\uff66-\uffdc\U00010000-\U0001e8ff\U00020000-\U0003ffff]")
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_SENTENCE = re.compile(r"[.!?,;:](?=[\s\"')\]]|$)|[。！？、，．；։؟،۔।॥።…]")
#: Words for each of which prose in a language without known stop words has an end or a joint of a sentence.
SENTENCE_WORDS = 20
#: Words and densities of the first pass.
LONG, SHORT, LINKS, STOPS = 25, 10, 0.5, 0.08
_STOP = frozenset(w for ws in STOP_WORDS.values() for w in ws)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


@lru_cache(1 << 14)
def hint_of(value: str) -> str | None:
    """The word of a class, id or role that tells it is no article text: the last of one of its names, but for words of a piece of that part."""
    for name in value.lower().split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        for k in range(len(words) - 1, -1, -1):
            if HINT.fullmatch(words[k]) and not NOT & set(words[:k]):
                if words[k] == "header" and k and words[k - 1] in OWN:
                    break
                return words[k]
            if words[k] not in PARTS and not words[k][0].isdigit():
                break
    return None


def prose_figures(text: str) -> tuple[int, float]:
    """Words of a text and the share of stop words among them.

    Scripts without spaces have a word for two letters. Where few of the words are known,
    as in another language, ends and joints of sentences stand in for stop words.
    """
    words = text.lower().split()
    n, stops = len(words), sum(w.strip(".,;:!?\"'()") in _STOP for w in words)
    if not text.isascii() and 2 * len(_OTHER.findall(text)) > len(text) - n:
        n = max(n, len(_UNSPACED.findall(text)) // 2)
    if stops < STOPS * n and n >= LONG and len(_SENTENCE.findall(text)) * SENTENCE_WORDS >= n:
        return n, STOPS
    return n, stops / n


def _hint(tag: str, attributes: str, in_article: bool) -> str | None:
    """As hint_of, for an element; ids of headings, and of sections of an article, are anchors named for what they hold."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() == "id" and (re.fullmatch("h[1-6]", tag) or in_article and tag == "section"):
            continue
        if found := hint_of("".join(values)):
            return found
    return None


@dataclass
class Block:
    text: str
    words: int
    link_share: float
    stop_share: float
    outside: bool
    #: Number of the article or main element about it; 0 for none.
    content: int
    good: bool | None = None
    #: Number of the innermost element about it that a hint says is no article text; -1 for none.
    hint: int = -1
    in_article: bool = False
    title: bool = False


@dataclass
class _Open:
    tag: str
    outside: bool
    silent: bool
    content: int
    link: bool = False
    hint: int = -1
    in_article: bool = False
    title: bool = False


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    contents: int = 0
    #: The word of each hinted element, and the next one about it; the innermost one about each article, main and h1.
    hinted: list[str] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    about: list[tuple[str, int]] = field(default_factory=list)

    def top(self) -> _Open:
        return self.stack[-1] if self.stack else _Open("", False, False, 0)

    def text(self, raw: str) -> None:
        at = self.top()
        if not at.silent and raw:
            self.parts.append(raw)
            if at.link:
                self.links += len(html.unescape(raw).strip())

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                words, stops = prose_figures(text)
                at = self.top()
                self.blocks.append(Block(text, words, min(1.0, self.links / len(text)), stops, at.outside, at.content, hint=at.hint, in_article=at.in_article, title=at.title))
        self.parts, self.links = [], 0

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag in SPACED:
            self.text(" ")
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            self.imply(tag)
        up, hint, own_header = self.top(), self.top().hint, False
        if attributes and tag not in ("html", "body", "article", "main") and not (tag == "header" and up.content):
            word = _hint(tag, attributes, up.in_article)
            own_header = tag == "header" and word is None and any(OWN & set(re.split(r"[\s_-]+", "".join(v).lower())) for _, *v in _ATTRIBUTE.findall(attributes))
        else:
            word = None
        if word is None and tag == "form":
            word = tag  # a form about the whole page is none
        if word is not None:
            self.above.append(hint)
            hint = len(self.hinted)
            self.hinted.append(word)
        outside = up.outside or tag in OUTSIDE or (tag == "header" and not up.content and not own_header) or bool(attributes and _HIDDEN.search(attributes))
        content = up.content
        if tag in CONTENT:
            self.contents += 1
            content = self.contents
        if (tag in CONTENT or tag == "h1") and not outside:
            self.about.append((tag, hint))
        self.stack.append(_Open(tag, outside, up.silent or tag in SILENT, content, up.link or tag == "a", hint, up.in_article or tag == "article", up.title or tag == "h1"))

    def imply(self, tag: str) -> None:
        """A new paragraph, item or cell ends an open one of its kind, up to the next container."""
        stops = {"p": BLOCKS, "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}.get(tag, ("table", "select"))
        same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag in same:
                del self.stack[k:]
                return
            if self.stack[k].tag in stops:
                return

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag in SPACED:
            self.text(" ")
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if self.stack[k].tag in CONTENT | {"body", "html"} and tag not in BLOCKS:
                return

    def inside(self, hints: list[int]) -> list[int]:
        """How many of these places are inside each hinted element: elements stand after those about them, so one pass from the last sums up."""
        n = [0] * len(self.hinted)
        for k in hints:
            if k >= 0:
                n[k] += 1
        for k in range(len(n) - 1, -1, -1):
            if self.above[k] >= 0:
                n[self.above[k]] += n[k]
        return n

    def hints_taken(self) -> list[bool]:
        """For each hinted element whether its text is no article's, by its own hint or by one about it.

        A hint holds, but not if it is about most of the page's prose, unless it is of the part itself:
        it is the part's own if the word tells so (comments, say), or if articles are outside,
        but not if a main element or a first heading is inside.
        """
        prose = [b.hint for b in self.blocks if not b.outside and (b.in_article or b.link_share <= LINKS) and b.words >= LONG and b.stop_share >= STOPS]
        articles = [k for tag, k in self.about if tag in CONTENT]
        of_prose, of_articles, of_marks = self.inside(prose), self.inside(articles), self.inside([k for tag, k in self.about if tag != "article"])
        taken = []
        for k, word in enumerate(self.hinted):
            most = 2 * of_prose[k] > len(prose)
            whole = of_marks[k] > 0 or bool(articles) and of_articles[k] == len(articles)
            holds = not (whole and (most or articles and not prose) or most and not articles and not PROSE.fullmatch(word))
            taken.append(holds or self.above[k] >= 0 and taken[self.above[k]])
        return taken


def read_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with what the rules look at."""
    reader, at = _Reader(), 0
    while (m := _TAG.search(page, at)) is not None:
        reader.text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0] == "<![CDATA[" and (end := page.find("]]>", at)) >= 0:
                reader.text(html.escape(page[at:end]))
                at = end + 3
            continue
        if m[1]:
            reader.close(tag)
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        reader.open(tag, m[3])
    reader.text(page[at:])
    reader.flush()
    taken = reader.hints_taken()
    for block in reader.blocks:
        block.outside = block.outside or block.hint >= 0 and taken[block.hint]
    return reader.blocks


def _in_link_list(blocks: list[Block], i: int) -> bool:
    """Whether a block of links stands in a row of three or more."""
    row = [0 <= j < len(blocks) and blocks[j].link_share > LINKS for j in range(i - 2, i + 3)]
    return any(all(row[k : k + 3]) for k in range(3))


def classify(blocks: list[Block]) -> list[Block]:
    """Decide each block: first by its own figures, then short ones by their neighbours.

    Links tell nothing inside an article, and in a main element only where they stand in a
    row. Where articles hold most of the page's prose, prose beside them is none of theirs (it may be
    readers' comments under any name), but a first heading is.
    """
    prose = [b for b in blocks if not b.outside and b.words >= LONG and b.stop_share >= STOPS and (b.in_article or b.link_share <= LINKS)]
    articles = 2 * sum(b.words for b in prose if b.in_article) > sum(b.words for b in prose)
    for i, b in enumerate(blocks):
        if b.outside or not b.in_article and b.link_share > LINKS and (not b.content or _in_link_list(blocks, i)):
            b.good = False
        elif articles and not b.content:
            b.good = b.title
        elif b.words >= LONG and b.stop_share >= STOPS:
            b.good = True
        elif not b.content and (b.words >= LONG or b.words >= SHORT and b.stop_share < STOPS):
            b.good = False
        # Else it is ambiguous: short, or odd words inside an article.
    decided = [i for i, b in enumerate(blocks) if b.good is not None]
    after = [None] * (len(blocks) + 1)
    for i in range(len(blocks) - 1, -1, -1):
        after[i] = i if blocks[i].good is not None else after[i + 1]
    known = {i: blocks[i].good for i in decided}
    before: int | None = None
    for i, b in enumerate(blocks):
        if i in known:
            before = i
            continue
        if b.content:  # within an article only what it holds can decide
            near = [j for j in (before, after[i]) if j is not None and blocks[j].content == b.content and not blocks[j].outside]
            b.good = not near or any(known[j] for j in near if abs(i - j) == min(abs(i - k) for k in near))
        else:
            near = [j for j in (None if b.title else before, after[i]) if j is not None]  # a title belongs to what follows
            b.good = bool(near) and all(known[j] for j in near)
    return blocks


def main_text(page: str | None) -> str:
    """The article of a page: its good blocks, two newlines between them."""
    return "\n\n".join(b.text for b in classify(read_blocks(page or "")) if b.good)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row of pages, from its whole html.

    Defined results: null and empty html give an empty text; broken markup is read as far
    as it goes; repeated rows are each read; null ids and urls are carried; extra columns
    are ignored; an empty table gives no rows.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"]
            )

    narrow = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("html to read"))
    return narrow.mapInArrow(run, narrow.select(id_col, url_col).schema.add("text", "string").add("n_chars", "long"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(read_table(spark, sf_dir, "pages"))
