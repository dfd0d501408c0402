"""Main text of web pages as the maximum-scoring run of words and tags.

A page is a sequence of words and tags. A word has a positive score, a tag a negative one;
their sizes come from labelled pages, those whose markup says where the article is. A word
counts by the block it stands in and by whether it is in a link, a tag by its name, and both by
their side of the article, if the page marks one. One scan finds the run with the largest sum, and
the text of this run is returned. A gap in an article, such as a table of links, has positive words
on labelled pages, so the run goes on behind it.

Elements that never hold main text (menus, sidebars, forms, scripts and the like, by tag name,
role, or a whole name of their class or id) have no words and score as tags alone. A class name
counts if it is one of the marks, or marks with words of place (`sidebar-left`), so `no-sidebar` or
`comment-policy` mark nothing. No class name drops the first article of a page or what is around it,
and inside an article none drops a paragraph, heading, quote or list item.
"""

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import bounded_batches

# Labelled pages that the weights are fitted on.
SAMPLE_PAGES = 500

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""",
    re.S,
)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[a-z0-9]+")
_LABEL = re.compile(r"<(?:article|main)(?=[\s/>])", re.I)

RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
NEVER = frozenset(
    "head nav footer aside form script style noscript template svg iframe object select button "
    "textarea input dialog menu title canvas audio video map fieldset datalist".split()
)
# Words of class, id or role that mark an element as no main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "complementary cookie cookies consent contentinfo disqus dialog disclaimer footer menu modal nav navbar navigation "
    "newsletter notice notices pagination popup promo promotion related search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe toolbar widget".split()
)
# Words that say where such an element is or what it is built of.
PLACES = frozenset(
    "site page main left right top bottom upper lower area box block wrapper wrap container list item items slot unit "
    "section primary secondary global inner outer row col column bar header panel group links".split()
)
# What a page's header is called outside of an article.
HEADERS = frozenset("header masthead topbar".split())
# Elements of running text, which no class name drops inside an article.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
# Marks of articles that are comments or teasers, if they follow the first one.
LATER = frozenset("comment comments reply related teaser promo sponsored ad".split())
KNOWN = frozenset(
    "article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th tbody thead "
    "blockquote pre figure figcaption header address body html a b i em strong span br hr img".split()
)
# Before any page is seen: counts of (inside, outside) that are added to every feature.
PRIOR = 2.0

Token = tuple[str, int, str, int]  # feature, words, text, block


def _names(attributes: str) -> Iterator[list[str]]:
    """The words of every class name, id and role."""
    for value in _MARK.findall(attributes):
        for name in value.strip("\"'").lower().split():
            yield _PART.findall(name)


def _marked(attributes: str, marks: frozenset = MARKS) -> bool:
    if not attributes:
        return False
    for words in _names(attributes):
        if any(word in marks for word in words) and all(word in marks or word in PLACES or word.isdigit() for word in words):
            return True
    return marks is MARKS and bool(_HIDDEN.search(attributes))


def tokens(html: str, everything: bool = False) -> Iterator[tuple[str, str, bool]]:
    """`(feature, text, inside)`: tags with empty text, and runs of text; `inside` an article.

    A text's feature tells its block and whether it is in a link. The empty text of a block tag
    ends a block. `everything` reads elements that never hold main text like others, for the
    labelled pages tell from them what stands outside of an article.
    """
    # A tag ends at the last ">" at the latest, so no search for one runs past it.
    at, end = 0, html.rfind(">") + 1
    blocks = ["body"]
    opened: Counter = Counter()  # names in `blocks` and in `skipped`
    skipped: list[str] = []  # open elements below and with the one that has no main text
    wraps = False  # whether it was chosen by a class name, and may be wrapped around the article
    links = articles = seen = 0
    labelled = bool(_LABEL.search(html))

    def side() -> str:
        return "" if not labelled else " in" if articles else " out"

    def dropped(name: str, attributes: str) -> bool:
        """Whether an element never holds main text."""
        if name in NEVER:
            return True
        if name in ("body", "html"):
            return False
        if name in ("article", "main"):
            return seen > 0 and _marked(attributes, LATER)
        if not articles and (name == "header" and len(blocks) == 1 or _marked(attributes, HEADERS)):
            return True
        return not (articles and name in TEXT) and _marked(attributes)

    while at < len(html):
        m = _TAG.search(html, at, end) if at < end else None
        stop = m.start() if m else len(html)
        if not m and (comment := html.find("<!--", at)) >= 0:
            stop = comment
        if stop > at and not skipped:
            text = html[at:stop]
            yield f"word {'link' if links else blocks[-1]}{side()}", text, articles > 0
        if not m:
            return
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        closing, name, attributes = bool(m[1] or m[4]), name.lower(), m[3] or m[6] or ""
        if skipped and wraps and not closing and name in ("article", "main") and not seen:
            # What seemed to be a part beside the article is around it.
            skipped.clear()
            for key in [key for key in opened if isinstance(key, tuple)]:
                del opened[key]
        if skipped:
            if closing:
                if opened["-", name]:
                    while True:
                        opened["-", last := skipped.pop()] -= 1
                        if last == name:
                            break
            elif name not in VOID and not attributes.endswith("/"):
                if name in RAW:
                    at = _raw_end(html, name, at)
                elif not (name == skipped[-1] and name in ("p", "li", "tr", "td", "dt", "dd", "option")):
                    skipped.append(name)
                    opened["-", name] += 1
            continue
        if not closing and everything and name in RAW:
            at = _raw_end(html, name, at)
            continue
        if not closing and not everything and dropped(name, attributes):
            if name in RAW:
                at = _raw_end(html, name, at)
            elif name not in VOID and not attributes.endswith("/"):
                skipped.append(name)
                opened["-", name] += 1
                wraps = name not in NEVER
            yield "tag none", "", articles > 0
            continue
        if name in ("article", "main"):
            articles = max(0, articles - 1) if closing else articles + 1
            seen += not closing
        feature = f"tag {name if name in KNOWN else 'other'}{side()}"
        if name == "a":
            links = 0 if closing else 1
        elif name not in INLINE and name not in VOID:
            block = name if name in KNOWN else "other"
            if closing:
                while opened[block] and len(blocks) > 1:
                    opened[last := blocks.pop()] -= 1
                    if last == block:
                        break
            elif name not in ("html", "body"):
                if blocks[-1] == "p":
                    opened[blocks.pop()] -= 1
                blocks.append(block)
                opened[block] += 1
        yield feature, "" if name not in INLINE else "\0", articles > 0


def _raw_end(html: str, name: str, at: int) -> int:
    """The place behind the end tag of an element whose content is no markup."""
    m = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
    return m.end() if m else len(html)


def counted(html: str) -> Counter:
    """Words and tags of a labelled page by `(feature, inside the article)`."""
    out: Counter = Counter()
    for feature, text, inside in tokens(html, everything=True):
        count = len(text.split()) if feature.startswith("word") else 1
        out[feature, inside] += count
        # Pages that mark no article have features without a side.
        out[feature.removesuffix(" in").removesuffix(" out"), inside] += count
    return out


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Score by feature: words up to 1, tags below 0 and the lower the rarer they are inside."""
    # An element without main text is no end of a region: its words are gone already.
    out = {"tag none": -0.02}
    for feature in {f for f, _ in counts}:
        inside = counts.get((feature, True), 0) + PRIOR
        outside = counts.get((feature, False), 0) + PRIOR / 10
        share = inside / (inside + outside)
        # A word that is mostly outside costs little: the tags around it tell more.
        out[feature] = max(2 * share - 1, -0.5) if feature.startswith("word") else -0.02 - (1 - share) ** 2
    return out


def fit(
    pages: DataFrame,
    url_column: str = "url",
    html_column: str = "html",
    sample: int = SAMPLE_PAGES,
) -> dict[str, float]:
    """Weights from the labelled ones of about `sample` pages, which their hash chooses.

    A page is labelled if it has an article or main element. Features are fixed in number, so
    counts of every task are small, whatever the number of pages is.
    """
    html = F.col(html_column).cast("string")
    every = max(1, pages.count() // sample)
    chosen = pages.where(F.pmod(F.xxhash64(F.col(url_column), html), F.lit(every)) == 0)
    chosen = chosen.select(html.alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                total += counted(value.as_py())
        yield pa.RecordBatch.from_pydict(
            {"feature": [f for f, _ in total], "inside": [i for _, i in total], "n": list(total.values())},
            schema=pa.schema([("feature", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]),
        )

    counts = chosen.mapInArrow(run, "feature string, inside boolean, n bigint")
    rows = counts.groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_of({(r["feature"], r["inside"]): r["n"] for r in rows})


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The main text of a page: blocks in page order, joined by single spaces."""
    if not html:
        return ""
    best = total = 0.0
    span, start = (0, 0), 0
    parts: list[str] = []
    default = {" in": 1.0, " out": -0.5}
    for feature, text, _ in tokens(html):
        if total <= 0:
            total, start = 0.0, len(parts)
        if feature.startswith("word"):
            words = len(text.split())
            unknown = default.get(feature[feature.rfind(" ") :], 1.0)
            total += words * weights.get(feature, unknown)
            parts.append(text)
        else:
            words = 0
            total += weights.get(feature, -0.1)
            parts.append("" if text else " ")
        if words and total >= best and total > 0:
            best, span = total, (start, len(parts))
    text = "".join(part if part == " " else unescape(part) for part in parts[span[0] : span[1]])
    return " ".join(text.split())


def extract(
    pages: DataFrame,
    weights: dict[str, float],
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """One row `(id, url, text)` per page.

    A NULL or empty page has an empty text, as has one without a run of positive score. Pages
    are read one by one: NULL and repeated ids stay.
    """
    kind = dict(pages.dtypes)[id_column]

    def run(batches):
        for batch in batches:
            texts = [main_text(value.as_py(), weights) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"]
            )

    rows = bounded_batches(pages).select(
        F.col(id_column).alias("id"),
        F.col(url_column).cast("string").alias("url"),
        F.col(html_column).cast("string").alias("html"),
    )
    return rows.mapInArrow(run, f"id {kind}, url string, text string")
