"""Landed HTML -> text, title and date.

Pages whose markup the regular expressions below read exactly stay in the JVM.  The rest (nested
or unclosed noise elements, several ``article`` elements, rare entities, odd quoting, other content
elements) go to a small tree reader in an Arrow-batched function, which sees NULL for every page
the JVM already answered and therefore costs nothing for those.
"""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from feedmill import fixed_values as fv
from feedmill.functions.dates import iso_date

# Entities the JVM path decodes, "&amp;" last; any other one sends the page to the tree reader.
_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", "\u00a0"),
    ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&hellip;", "…"), ("&amp;", "&"),
)
_KNOWN = "|".join(name[1:-1] for name, _ in _ENTITIES)
_OTHER_ENTITY = rf"&(?!(?:{_KNOWN});)[a-zA-Z#]"
_COMMENT = r"(?s)<!--.*?-->"
_TAG = r"<[a-zA-Z/!?][^>]*>"
# A tag whose quotes do not pair up before its first ">".
_ODD_TAG = r"""[a-zA-Z][^>"]*(?:"[^">]*"[^>"]*)*"[^">]*>|[a-zA-Z][^>"']*'[^'>"]*>"""
_BLANKS = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_LINE_END = r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_KEEPS_PARAGRAPH = frozenset("button caption object table td th".split())


def _elements(names: tuple[str, ...]) -> str:
    return rf"(?is)<({'|'.join(names)})\b[^>]*>.*?</\1\s*>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` mentions it."""
    return F.transform(F.array(value), use).getItem(0)


def _decoded(text: Column) -> Column:
    plain = text
    for name, char in _ENTITIES:
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.when(text.contains("&"), plain).otherwise(text)


def _pieces(text: Column, separator: str) -> Column:
    """The non-blank pieces between matches of ``separator``, decoded and stripped."""
    stripped = F.transform(F.split(text, separator), lambda piece: F.btrim(_decoded(piece), F.lit(_BLANKS)))
    return F.filter(stripped, lambda piece: piece != "")


def _nodes(markup: Column, joined_by: str) -> Column:
    """Text nodes, each stripped, blanks dropped, joined."""
    return F.array_join(_pieces(markup, _TAG), joined_by)


def _without(html: Column, names: tuple[str, ...], put: str) -> Column:
    return F.regexp_replace(F.regexp_replace(html, _COMMENT, put), _elements(names), put)


def _left_over(names: tuple[str, ...]) -> str:
    """Signs that removing elements by expression was not what a tree would have done."""
    return rf"/?(?:{'|'.join(names)})\b|!--|!\[CDATA"


def _puzzling(markup: Column, names: tuple[str, ...]) -> Column:
    """True when the page needs the tree reader."""
    return markup.rlike(rf"(?i)<(?:{_left_over(names)}|{_ODD_TAG})|{_OTHER_ENTITY}")


def _meta_tag(html: Column, attribute: str, value: str) -> Column:
    """The first meta tag with ``attribute="value"``, '' without one."""
    return F.regexp_extract(html, rf"""(?is)<meta\b(?=[^>]*\b{attribute}\s*=\s*["']{value}["'])[^>]*>""", 0)


def _attribute(tag: Column, name: str) -> Column:
    """Decoded value of a tag's attribute, NULL when missing or empty."""
    quoted = rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    value = F.concat(F.regexp_extract(tag, quoted, 1), F.regexp_extract(tag, quoted, 2))
    return _let(value, lambda v: F.when(v != "", _decoded(v)))


def _meta_title(tag: Column) -> Column:
    """Content of a title's meta tag; empty stays empty, only a missing attribute has the default."""
    given = tag.rlike(r"""(?is)\bcontent\s*=\s*(?:"[^"]*"|'[^']*')""")
    return F.coalesce(_attribute(tag, "content"), F.when(given, F.lit("")), F.lit(fv.NO_TITLE))


# --- JVM path -----------------------------------------------------------------------------


def _article_text(body: Column) -> Column:
    """Stripped lines of an article element's content, NULL when it holds more articles or too little text."""
    text = F.array_join(_pieces(body, rf"{_TAG}|\n"), "\n")
    single = ~body.rlike(r"(?i)</?article\b")
    return F.when(single, _let(text, lambda t: F.when(F.length(t) > fv.PAGE_TEXT_MIN_CHARS, t)))


def _jvm_main_text(html: Column) -> Column:
    """Text of the page's single article element, NULL when the tree reader is needed."""
    body = r"(?is)<article\b[^>]*>(.*)</article\s*>"
    return _let(
        _without(html, fv.PAGE_NOISE_TAGS, "<!>"),
        lambda m: F.when(~_puzzling(m, fv.PAGE_NOISE_TAGS), _let(F.regexp_extract(m, body, 1), _article_text)),
    )


def _jvm_title(html: Column) -> Column:
    """Title by h1, social meta tags, title element; NULL when the tree reader is needed."""
    heading = r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"
    title = r"(?is)<title\b[^>]*>(.*?)</title\s*>"

    def text(fragment: Column) -> Column:
        return F.when(~_puzzling(fragment, ("h1", "title")), _nodes(fragment, ""))

    def pick(markup: Column) -> Column:
        og, twitter = _meta_tag(markup, "property", "og:title"), _meta_tag(markup, "name", "twitter:title")
        return (
            F.when(markup.rlike(rf"(?i)<(?:{_left_over(fv.PLAIN_TEXT_NOISE_TAGS)})"), F.lit(None))
            .when(markup.rlike(heading), _let(F.regexp_extract(markup, heading, 1), text))
            .when(_puzzling(markup, ("h1",)), F.lit(None))
            .when(og != "", _meta_title(og))
            .when(twitter != "", _meta_title(twitter))
            .when(markup.rlike(title), _let(F.regexp_extract(markup, title, 1), text))
            .otherwise(F.lit(fv.NO_TITLE))
        )

    return _let(_without(html, fv.PLAIN_TEXT_NOISE_TAGS, "<!>"), pick)


def _jvm_plain_text(html: Column) -> Column:
    """All text outside script and style, one trimmed phrase per line; NULL for the tree reader."""

    def text(markup: Column) -> Column:
        return F.array_join(_pieces(F.regexp_replace(markup, _TAG, ""), rf"{_LINE_END}|  "), "\n")

    return _let(
        _without(html, fv.PLAIN_TEXT_NOISE_TAGS, ""),
        lambda m: F.when(~_puzzling(m, fv.PLAIN_TEXT_NOISE_TAGS), text(m)),
    )


# --- tree reader --------------------------------------------------------------------------


class _Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def walk(self, skip: frozenset[str]):
        """This node and its descendants in page order, leaving out ``skip`` elements."""
        waiting: list[_Node | str] = [self]
        while waiting:
            found = waiting.pop()
            yield found
            if isinstance(found, _Node):
                waiting += [k for k in reversed(found.kids) if (k.tag not in skip if isinstance(k, _Node) else k)]

    def texts(self, skip: frozenset[str]) -> list[str]:
        return [t for t in self.walk(skip) if isinstance(t, str)]

    def joined(self, skip: frozenset[str], separator: str) -> str:
        return separator.join(t.strip() for t in self.texts(skip) if t.strip())

    def nodes(self, skip: frozenset[str], tag: str) -> list["_Node"]:
        return [n for n in self.walk(skip) if isinstance(n, _Node) and n.tag == tag]


class _TreeReader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Node("", {})]

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_PARAGRAPH:
            self._end_paragraph()
        node = _Node(tag, dict(attrs))
        self.open[-1].kids.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def _end_paragraph(self):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in _KEEPS_PARAGRAPH:
                return
            if self.open[depth].tag == "p":
                del self.open[depth:]
                return

    def handle_startendtag(self, tag, attrs):
        self.open[-1].kids.append(_Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        kids = self.open[-1].kids
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)

    def handle_comment(self, data):
        self.open[-1].kids.append(None)


def _tree(html: str) -> _Node:
    reader = _TreeReader()
    reader.feed(html)
    reader.close()
    return reader.open[0]


def _lines(text: str, separator: str = "\n") -> str:
    return separator.join(line.strip() for line in text.split("\n") if line.strip())


def _has_content_class(node: _Node) -> bool:
    classes = (node.attrs.get("class") or "").lower()
    return any(word in classes for word in fv.CONTENT_CLASS_WORDS)


def tree_main_text(root: _Node) -> str:
    """Main text by content element, else paragraphs, else body [X6]."""
    skip = frozenset(fv.PAGE_NOISE_TAGS)
    candidates = (
        root.nodes(skip, "article")[:1],
        [n for n in root.nodes(skip, "div") if _has_content_class(n)][:1],
        root.nodes(skip, "main")[:1],
    )
    for found in candidates:
        text = _lines(found[0].joined(skip, "\n")) if found else ""
        if len(text) > fv.PAGE_TEXT_MIN_CHARS:
            return text
    paragraphs = root.nodes(skip, "p")
    if paragraphs:
        return "\n\n".join(t for t in (p.joined(skip, "") for p in paragraphs) if t)
    bodies = root.nodes(skip, "body")
    return bodies[0].joined(skip, "\n") if bodies else ""


def tree_title(root: _Node) -> str:
    """Title by h1, og:title, twitter:title, title [X7]."""
    skip = frozenset(fv.PLAIN_TEXT_NOISE_TAGS)
    metas = root.nodes(skip, "meta")
    headings = root.nodes(skip, "h1")
    if headings:
        return headings[0].joined(skip, "")
    for attribute, value in (("property", "og:title"), ("name", "twitter:title")):
        for meta in metas:
            if meta.attrs.get(attribute) == value:
                return fv.NO_TITLE if meta.attrs.get("content") is None else meta.attrs["content"]
    titles = root.nodes(skip, "title")
    return titles[0].joined(skip, "") if titles else fv.NO_TITLE


def tree_plain_text(root: _Node) -> str:
    """All text outside script and style, one trimmed phrase per line [X5]."""
    text = "".join(root.texts(frozenset(fv.PLAIN_TEXT_NOISE_TAGS)))
    return "\n".join(p.strip() for line in text.splitlines() for p in line.split("  ") if p.strip())


def tree_document_title(root: _Node) -> str:
    """Text of the title element, untouched [X5]."""
    titles = root.nodes(frozenset(), "title")
    return "".join(titles[0].texts(frozenset())) if titles else ""


def tree_snippet(root: _Node) -> str:
    """Text nodes joined by one blank [X9]."""
    return root.joined(frozenset(fv.SNIPPET_NOISE_TAGS), " ")


def _tree_udf(read):
    @F.pandas_udf(T.StringType())
    def apply(pages: pd.Series) -> pd.Series:
        return pages.map(lambda html: None if html is None else read(_tree(html)))

    return apply


_main_text_udf = _tree_udf(tree_main_text)
_title_udf = _tree_udf(tree_title)
_plain_text_udf = _tree_udf(tree_plain_text)
_document_title_udf = _tree_udf(tree_document_title)
_snippet_udf = _tree_udf(tree_snippet)


@F.pandas_udf(T.StringType())
def _unescape_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: None if text is None else unescape(text))


def _with(pages: DataFrame, html: str, out: str, fast: Column, slow) -> DataFrame:
    """``pages`` with ``out``; the fast answer is a column of its own, so it is computed once."""
    first = f"_{out}_jvm"
    answered = pages.withColumn(first, fast)
    tree = slow(F.when(F.col(first).isNull(), F.col(html)))
    return answered.withColumn(out, F.coalesce(first, tree)).drop(first)


def with_main_text(pages: DataFrame, html: str = "html", out: str = "page_text") -> DataFrame:
    """Main content of every page [X6]."""
    return _with(pages, html, out, _jvm_main_text(F.col(html)), _main_text_udf)


def with_title(pages: DataFrame, html: str = "html", out: str = "title") -> DataFrame:
    """Title of every page [X7]."""
    return _with(pages, html, out, _jvm_title(F.col(html)), _title_udf)


def with_plain_text(pages: DataFrame, html: str = "html", out: str = "content") -> DataFrame:
    """Every visible text of a page, one phrase per line [X5]."""
    return _with(pages, html, out, _jvm_plain_text(F.col(html)), _plain_text_udf)


def with_document_title(pages: DataFrame, html: str = "html", out: str = "title") -> DataFrame:
    """Content of the title element as it stands, '' without one [X5]."""
    element = F.regexp_extract(F.col(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    fast = _let(element, lambda e: F.when(~_puzzling(e, ("title",)) & ~e.contains("<"), _decoded(e)))
    return _with(pages, html, out, fast, _document_title_udf)


def published_date(html: Column) -> Column:
    """First readable date among the publication meta tags and the time element [X8]."""
    time_tag = r"(?is)<time\b[^>]*\bdatetime\s*=[^>]*>"

    def dated(tag: Column, attribute: str) -> Column:
        return _let(_attribute(tag, attribute), iso_date)

    def first_date(markup: Column) -> Column:
        return F.coalesce(
            dated(_meta_tag(markup, "property", "article:published_time"), "content"),
            dated(_meta_tag(markup, "name", "publish_date"), "content"),
            dated(F.regexp_extract(markup, time_tag, 0), "datetime"),
        )

    return _let(_without(html, fv.PLAIN_TEXT_NOISE_TAGS, "<!>"), first_date)


def with_snippet_text(rows: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """Feed snippet -> text nodes joined by one blank [X9]."""
    fast = _let(
        _without(F.col(content), fv.SNIPPET_NOISE_TAGS, "<!>"),
        lambda m: F.when(~_puzzling(m, ("script", "style", "video")), _nodes(m, " ")),
    )
    return _with(rows, content, out, fast, _snippet_udf)


def snippet_method(content: Column) -> Column:
    """How :func:`snippet_text` got its text: parsed, or the raw value kept."""
    return F.when(content.isNull(), F.lit(fv.RAW_METHOD)).otherwise(F.lit(fv.SNIPPET_METHOD))


def _raw_markdown(html: Column) -> Column:
    blocks = r"(?i) ?</?(?:p|div|article|section|main|ul|ol|h[1-6]|body|html)\b[^>]*> ?"
    text = _without(html, fv.PAGE_NOISE_TAGS, "")
    text = F.regexp_replace(text, r"(?is)<head\b.*?</head\s*>", "")
    text = F.regexp_replace(text, r"\s+", " ")
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?i) ?<h{level}\b[^>]*> ?", f"\n\n{'#' * level} ")
    text = F.regexp_replace(text, r"(?i) ?<li\b[^>]*> ?", "\n- ")
    text = F.regexp_replace(text, r"(?i) ?<br\b[^>]*> ?", "\n")
    text = F.regexp_replace(text, blocks, "\n\n")
    return F.regexp_replace(F.regexp_replace(text, _TAG, ""), r"\n\n+", "\n\n")


def with_markdown(pages: DataFrame, html: str = "html", out: str = "markdown") -> DataFrame:
    """Headings, paragraphs, list items and line breaks of a page as Markdown [X10, subset].

    Only texts with entities beyond the usual ones are decoded in Python.
    """
    raw, first = f"_{out}_raw", f"_{out}_jvm"
    text = F.col(raw)
    staged_text = pages.withColumn(raw, _raw_markdown(F.col(html))).withColumn(
        first, F.when(~text.rlike(_OTHER_ENTITY), _decoded(text))
    )
    rest = _unescape_udf(F.when(F.col(first).isNull(), text))
    return staged_text.withColumn(out, F.btrim(F.coalesce(first, rest), F.lit(_BLANKS))).drop(raw, first)
