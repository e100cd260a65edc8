"""Main text of web pages from flat blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. Each has its words, the share of them inside links, the same of its two
neighbours, and whether markup calls its region main (1), boilerplate (-1), something between or nothing (0); a tree trained on a small labelled table keeps or drops it.
"""

from __future__ import annotations

import html
import json
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import text_batches
from talus.llm.trees import tree_column

#: One piece of markup: comment, declaration, tag whose values are quoted right after the equals sign or not at all, or text.
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=\s*[^\s\"'>][^\s>]*|[\"'=])*+)(?:>|\Z)|[^<]+|<", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
#: An element that closes itself; a slash at the end of an unquoted value, as of a link, is part of the value.
CLOSED = re.compile(r"(?:^|[\s\"'])/$")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Fixed names of HTML.
RAW = {"script", "style", "textarea", "title"}
#: Their contents aren't text of the page; one that is never closed is a tag like any other.
EMBEDDED = {"noscript", "template", "svg", "math", "iframe", "object", "canvas", "select", "option", "datalist"}
FOREIGN = {"svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Regions by tag and by the words of class, id and role.
MAIN_TAGS, BOILER_TAGS = {"article", "main"}, {"nav", "footer", "aside", "header", "button", "fieldset", "dialog", "menu", "head"}
#: What may stand in a head: any other tag ends it, whether its end tag is there or not.
HEAD_TAGS = {"title", "meta", "link", "script", "style", "base", "noscript", "template", "head"}
#: Tags that hold an article's own text: a name makes them a doubtful part of it, not boilerplate.
TEXT_TAGS = {"p", "blockquote", "q", "pre", "figure", "figcaption", "table", "dl"}
#: Words at the start or end of a name by which it says how something is shown or filed, not what it is.
FILED, STATES = {"has", "with", "without", "no", "is", "tag", "category", "format", "type", "status", "show", "hide"}, {
    "open", "opened", "close", "closed", "active", "inactive", "enabled", "disabled", "visible", "expanded", "collapsed", "loaded", "fixed", "sticky", "on", "off"}
#: What makes social a name of buttons; beside any other word it is a subject.
SOCIAL = {"social", "media", "share", "sharing", "links", "link", "icons", "icon", "buttons", "button", "bar", "follow", "nav", "menu", "list"}
MAIN_NAMES = {"article", "main", "content", "post", "entry", "story", "body", "text"}
BOILER_NAMES = {
    "ad", "ads", "adv", "advert", "advertisement", "sponsor", "sponsored", "promo", "promoted", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "sidebar", "cookie", "cookies", "consent",
    "popup", "modal", "overlay", "subscribe", "newsletter", "signup", "login", "sharing", "related", "recommended", "comment",
    "comments", "replies", "respond", "disqus", "toolbar", "pagination", "pager", "copyright", "gdpr", "complementary", "contentinfo",
}
#: Names that also occur on parts of an article: there they only are a hint, and so they are beside a main name.
WEAK_NAMES = {"side", "banner", "header", "widget", "notice", "alert", "share", "reply", "tags", "legal", "disclaimer", "search", "skip", "rail"}
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "region", "heading", "list", "marks")
BLOCK_TYPE = "struct<text:string," + ",".join(f"{n}:double" for n in FEATURES) + ">"


def _names(value: str) -> tuple[bool, bool, bool]:
    """Whether the words of a class, id or role name boilerplate, something doubtful, main text. A word counts as a whole token says it."""
    boiler = weak = main = False
    for token in value.split():
        parts = [w.lower() for w in NAME_PART.findall(token)]
        if len(parts) > 1 and (parts[0] in FILED or parts[-1] in STATES):
            continue
        own = set(parts)
        bad = bool(own & BOILER_NAMES) or "social" in own and own <= SOCIAL
        boiler |= bad
        weak |= bool(own & WEAK_NAMES)
        main |= bool(own & MAIN_NAMES) and not bad
    return boiler, weak, main


def _region(tag: str, attributes: str) -> str:
    """'boiler', 'form', 'weak', 'main', 'article', 'hidden' or '' for what a tag says of its contents."""
    plain = "boiler" if tag in BOILER_TAGS else "form" if tag == "form" else "article" if tag in MAIN_TAGS else ""
    if not attributes.strip():
        return plain
    values = []
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return "hidden"
        if key in ("class", "id", "role"):
            values.append(value)
    boiler, weak, main = _names(" ".join(values))
    if plain == "boiler" or tag in ("body", "html", "main"):
        return plain or ("main" if main else "")
    if tag == "article":
        return "boiler" if boiler and not main else "article"
    if boiler:
        return "weak" if tag in TEXT_TAGS else "boiler"
    if weak:
        return "" if main else "weak"
    return plain or ("main" if main else "")


class _Open:
    """The elements that are open at a place of a page, and how many of each tag and region: nothing walks the stack but to close."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str]] = []
        self.tags: Counter[str] = Counter()
        self.regions: Counter[str] = Counter()
        self.headings = 0
        #: Of those that decide for all inside them, from the outermost: which, and how many doubtful ones are round it.
        self.decisive: list[tuple[str, int, int]] = []

    def enter(self, tag: str, region: str) -> None:
        self.stack.append((tag, region))
        self.tags[tag] += 1
        self.regions[region] += 1
        self.headings += tag in HEADINGS
        if region in ("boiler", "article"):
            self.decisive.append((region, self.regions["weak"], self.regions["form"]))

    def leave(self, tag: str) -> None:
        """Close the innermost element of a tag and all inside it; a tag that isn't open closes nothing."""
        while self.tags[tag]:
            name, region = self.stack.pop()
            self.tags[name] -= 1
            self.regions[region] -= 1
            self.headings -= name in HEADINGS
            if region in ("boiler", "article"):
                self.decisive.pop()
            if name == tag:
                return

    def region(self) -> float:
        """-1 boilerplate, -0.5 perhaps, 0 unknown, 0.5 a part of the main text that may be none, 1 main text.

        The innermost of boilerplate and main tags decides; a name of main text inside boilerplate doesn't.
        """
        kind, weak, _ = self.decisive[-1] if self.decisive else ("", 0, 0)
        if kind == "boiler":
            return -1.0
        main = kind == "article" or self.regions["main"] > 0
        return (0.5 if main else -0.5) if self.regions["weak"] > weak else float(main)

    def in_form(self) -> bool:
        """Whether a form is round this place, inside what decides for it."""
        return self.regions["form"] > (self.decisive[-1][2] if self.decisive else 0)

    def inside_main(self) -> bool:
        return self.regions["main"] > 0 or self.regions["article"] > 0


def blocks(page: str) -> list[tuple]:
    """(text, *FEATURES) of each block with text, in page order; markup, scripts and styles are gone.

    Time grows with the page's length only: neither deep nesting nor unclosed elements are walked again for each block.
    """
    out: list[tuple[str, int, int, float, int, int, bool]] = []  # text, words, linked words, region, heading, list, in a form
    now, text, unclosed = _Open(), [], set()
    linked, kind = 0, ""

    def flush() -> None:
        nonlocal linked
        if text:
            words = html.unescape("".join(text)).split()
            if words and not now.regions["hidden"]:
                out.append((" ".join(words), len(words), min(linked, len(words)), now.region(), int(kind in HEADINGS or now.headings > 0), int(now.tags["li"] > 0), now.in_form()))
            text.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        m = PIECE.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] == "<" and len(piece) > 1:
                continue
            if now.tags["head"] and not piece.isspace():
                now.leave("head")
            if not now.regions["hidden"]:
                text.append(piece)
                if now.tags["a"]:
                    linked += len(piece.split())
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            elif tag == "br":
                text.append(" ")
            now.leave(tag)
            continue
        if tag in FOREIGN and m[0].endswith("/>"):
            continue
        if now.tags["head"] and tag not in HEAD_TAGS:
            flush()
            now.leave("head")
        if tag in RAW or tag in EMBEDDED and tag not in unclosed:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            if close or tag in RAW:
                at = close.end() if close else size
                if tag not in FOREIGN:
                    flush()
                continue
            unclosed.add(tag)
        if tag in VOID:
            if tag in INLINE:
                text.append(" " if tag == "br" else "")
            else:
                flush()
            continue
        if tag not in INLINE:
            flush()
            kind = tag
            near = [t for t, _ in now.stack[-6:]]
            if tag in ("p", "tr", "td", "dt", "dd", "li"):
                if tag in near and next(t for t in reversed(near) if t in (tag, "ul", "ol", "table", "dl")) == tag:
                    now.leave(tag)
            elif tag not in HEADINGS and "p" in near:
                now.leave("p")
        region = _region(tag, m[3] or "")
        if region == "boiler" and tag == "header" and now.inside_main():
            region = ""  # the heading of the article itself
        if not CLOSED.search(m[3] or ""):
            now.enter(tag, region)
    flush()
    rows = []
    # A form round most of the page's text is the page, and words and links decide; any other holds no text of it.
    free, formed = (sum(b[1] for b in out if b[3] > -1 and b[6] == f) for f in (False, True))
    for k, (words, n, l, region, head, item, form) in enumerate(out):
        if form and formed <= free:
            region = -1.0
        before, after = (out[j][1:3] if 0 <= j < len(out) else (0, 0) for j in (k - 1, k + 1))
        marks = sum(words.count(c) for c in ".!?")
        rows.append((
            words, float(n), l / n, float(before[0]), before[1] / max(1, before[0]), float(after[0]), after[1] / max(1, after[0]),
            region, float(head), float(item), float(marks),
        ))
    return rows


def labelled(pages: int = 300, seed: int = 3) -> list[list[float]]:
    """A small labelled table: features and label of the blocks of made-up pages whose parts are known."""
    rng = random.Random(seed)

    def prose(low: int, high: int) -> str:
        return " ".join(rng.choice(["river", "stone", "market", "when", "the", "of", "green", "old", "they", "went"]) for _ in range(rng.randint(low, high))) + "."

    def menu(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{prose(1, 3)[:-1]}</a></li>' for k in range(n)) + "</ul>"

    rows: list[list[float]] = []
    for _ in range(pages):
        bad, good = (lambda t: t.replace(".", "xbadx."), lambda t: t.replace(".", "xgoodx."))
        tree = rng.random()
        inner = f"<h1>{good(prose(1, 9))}</h1>" + "".join(
            rng.choice([f"<p>{good(prose(1, 2))}</p>", f"<p>{good(prose(1, 9))}</p>", f"<p>{good(prose(8, 120))}</p>", f"<p><b>{good(prose(20, 80))}</b> <a href=x>{prose(1, 3)[:-1]}</a></p>",
                        f"<h2>{good(prose(1, 6))}</h2>", f"<ul><li>{good(prose(2, 20))}</li><li>{good(prose(2, 20))}</li></ul>", f"<blockquote>{good(prose(5, 40))}</blockquote>"])
            for _ in range(rng.randint(1, 9))
        )
        ad = f'<div class="{rng.choice(["ad", "banner", "cookie-notice", "promo"])}">{bad(prose(2, 40))}</div>'
        links = re.sub(r">([a-z ]+)</a>", r">\1xbadx</a>", menu(rng.randint(3, 9)))
        if rng.random() < 0.15:  # nothing but a short article
            inner = "".join(f"<p>{good(prose(1, 12))}</p>" for _ in range(rng.randint(1, 3)))
            rows += [[*map(float, f), 1.0] for _, *f in blocks(f"<article>{inner}</article>")]
            continue
        if rng.random() < 0.6:  # names that say little inside an article
            inner += f'<div class="{rng.choice(["side", "notice", "legal", "alert", "rail", "disclaimer"])}"><p>{good(prose(*rng.choice([(6, 30), (20, 80)])))}</p></div>'
        if rng.random() < 0.4:
            inner += f'<div class="{rng.choice(["share", "tags", "widget", "reply"])}">{links}</div>'
        if tree < 0.5:
            inner = inner.replace("</p>", "</p>" + (ad if rng.random() < 0.1 else ""), 1)
            body = f"<article>{inner}</article>" if rng.random() < 0.7 else f'<div class="post-content">{inner}</div>'
        else:  # no hint of where the main text is: words and links decide
            text = "".join(f"<p>{good(prose(*rng.choice([(25, 120), (25, 120), (3, 24)])))}</p>" for _ in range(rng.randint(3, 8)))
            body = f"<div><h1>{good(prose(2, 9))}</h1>{text}</div>"
            ad = "" if rng.random() < 0.5 else ad
        side = f'<aside><h3>{bad(prose(1, 4))}</h3>{re.sub(r">([a-z ]+)</a>", r">\1xbadx</a>", menu(4))}<p>{bad(prose(3, 40))}</p></aside>'
        talk = f'<section id="comments"><h3>{bad(prose(1, 3))}</h3><p>{bad(prose(3, 60))}</p></section>'
        top = rng.choice([f"<nav>{links}</nav>", f"<header>{bad(prose(1, 8))}{links}</header>", f"<div>{links}</div>"])
        foot = rng.choice([f"<footer>{bad(prose(2, 14))}</footer>", f'<div class="footer">{bad(prose(2, 14))}</div>', f"<div>{links}</div><div>{bad(prose(2, 8))}</div>"])
        page = top + (ad if rng.random() < 0.8 else "") + body + (side if rng.random() < 0.4 else "") + (talk if rng.random() < 0.4 else "") + (foot if rng.random() < 0.8 else "")
        rows += [[*map(float, f), float("xbadx" not in t)] for t, *f in blocks(page) if "xbadx" in t or "xgoodx" in t]
    return rows


@lru_cache(maxsize=4)
def block_tree(spark: SparkSession, depth: int = 6):
    """A decision tree for blocks, fitted on the labelled table."""
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(labelled())), F.lit("array<array<double>>"))).alias("x"))
    table = rows.select(*(F.col("x")[k].alias(n) for k, n in enumerate((*FEATURES, "label")))).coalesce(1)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=4, seed=1).fit(table)


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (kept blocks joined by an empty line), n_chars.

    Null and empty html give an empty text; null ids and urls and repeated rows keep their rows; extra columns are not
    looked at. Markup that ends too early is read as far as it goes. A page is done in its row: nothing is shuffled.
    """
    spark = pages.sparkSession
    text_batches(spark, 256)
    kind = pa.struct([("text", pa.string()), *((n, pa.float64()) for n in FEATURES)])
    names = [f.name for f in kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, b, strict=True)) for b in blocks(p)] if p else [] for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(kind))], names=["page_id", "url", "blocks"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    cut = source.mapInArrow(run, f"page_id long, url string, blocks array<{BLOCK_TYPE}>")
    root = block_tree(spark)._call_java("rootNode")
    kept = F.filter("blocks", lambda b: tree_column(root, [b[n] for n in FEATURES]) > 0.5)
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return cut.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
