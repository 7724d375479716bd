"""Builders of block and inline elements.

Every builder returns a list of elements (``array<struct>``): the element,
followed by its children. Content comes in one of three ways: a text, a list of
elements (``children``), or a list of lists (``parts``, given as a Python list of
list columns or as one column). Text goes into the element's own content;
children follow one level deeper with orders from 0, which :func:`assemble
<folia.functions.lists.assemble>` settles later. The ``..._element`` builders
return a single element in place of a list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folia.functions.lists import live, renumbered
from folia.schema import LIST_DDL, attributes, element, empty_list

Text = Column | str | None


def _text(value: Text) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(value).cast("string")


def _joined(parts: Column | list[Column]) -> Column:
    """A list of lists as one list without nulls."""
    if isinstance(parts, list):
        return live(F.concat(*[F.coalesce(p, empty_list()) for p in parts])) if parts else empty_list()
    return live(F.flatten(F.filter(F.coalesce(parts, F.array().cast(f"array<{LIST_DDL}>")), lambda p: p.isNotNull())))


def _under(children: Column, base, relative: bool = True) -> Column:
    """Children moved below ``base``: the shallowest to one level deeper, or all of them if not ``relative``."""
    own = live(F.coalesce(children, empty_list()))
    level = lambda b: F.coalesce(b["level"], F.lit(1))
    base = base if isinstance(base, Column) else F.lit(base)
    shift = base + 1 - F.array_min(F.transform(own, level))
    return renumbered(F.transform(own, lambda b: b.withField("level", ((level(b) + shift) if relative else base + 1).cast("int"))))


def _build(kind: str, element_type: str, text: Text, children: Column | None, parts, attrs: Column, base=1, exact: bool = False, child_content: tuple = (None, None)) -> Column:
    """``child_content``: the element's own content over ``children`` and over ``parts``."""
    if children is not None:
        return F.concat(F.array(element(kind, element_type, child_content[0], base, attrs=attrs)), _under(children, base, not exact))
    if parts is not None:
        return F.concat(F.array(element(kind, element_type, child_content[1], base, attrs=attrs)), _under(_joined(parts), base))
    return F.array(element(kind, element_type, text if isinstance(text, Column) else F.lit(text), base, attrs=attrs))


# ---- blocks ----


def heading(rank, text: Text = None, children: Column | None = None, parts=None) -> Column:
    """A heading; a null rank leaves the attribute out."""
    return _build("block", "heading", text, children, parts, attributes(heading_level=_text(rank)))


def heading_element(text: Text, rank) -> Column:
    return element("block", "heading", _text(text), attrs=attributes(heading_level=_text(rank)))


def paragraph(text: Text = None, children: Column | None = None, parts=None, texts: Column | None = None) -> Column:
    """A paragraph; ``texts``: an array of strings, each of which becomes an inline text."""
    if texts is not None:
        inlines = F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t, i: element("inline", "text", t, 2, order=i))
        return F.concat(F.array(element("block", "paragraph", None)), inlines)
    return _build("block", "paragraph", text, children, parts, attributes())


def plain(text: Text = None, children: Column | None = None, parts=None) -> Column:
    """A text run without a paragraph's spacing; ``children`` all go one level deeper, whatever theirs was."""
    return _build("block", "plain", text, children, parts, attributes(), exact=True)


def code(text: Text = None, language: Text = None, children: Column | None = None, parts=None) -> Column:
    return _build("block", "code", text, children, parts, attributes(language=_text(language)))


def blockquote(text: Text = None, level=None, children: Column | None = None, parts=None) -> Column:
    """A quotation. ``level`` is the depth of the element for texts and ``parts``; over ``children`` it is always 1."""
    base = F.lit(1) if level is None or children is not None else (level if isinstance(level, Column) else F.lit(level))
    return _build("block", "blockquote", text, children, parts, attributes(), base)


def blockquote_element(text: Text, level) -> Column:
    return element("block", "blockquote", _text(text), level)


def list_of(items: Column | None = None, ordered=False, parts=None) -> Column:
    """A list of strings (``items``) or of built items (``parts``).

    Items of strings have level 2 and orders from 1, and a null item is empty.
    Built items go one level deeper than they were, with orders from 0, and the
    list carries ``ordered`` alone.
    """
    flag = F.coalesce(ordered if isinstance(ordered, Column) else F.lit(ordered), F.lit(False))
    said = flag.cast("string")
    if parts is not None:
        deeper = F.transform(_joined(parts), lambda b: b.withField("level", (F.coalesce(b["level"], F.lit(1)) + 1).cast("int")))
        return F.concat(F.array(element("block", "list", None, attrs=attributes(ordered=said))), renumbered(deeper))
    kind = F.when(flag, "ordered").otherwise("bullet")
    made = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda t, i: element("block", "list_item", F.coalesce(t, F.lit("")), 2, attrs=attributes(ordered=said), order=i + 1))
    return F.concat(F.array(element("block", "list", None, attrs=attributes(ordered=said, list_type=kind))), made)


def list_element(items: Column, ordered=False) -> Column:
    """The old shape: a list whose content is a JSON array of its items."""
    said = F.coalesce(ordered if isinstance(ordered, Column) else F.lit(ordered), F.lit(False)).cast("string")
    escaped = lambda t: F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.coalesce(t, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    content = F.concat(F.lit("["), F.array_join(F.transform(items, escaped), ","), F.lit("]"))
    return element("block", "list", content, encoding="json", attrs=attributes(ordered=said))


def list_item(text: Text = None, ordered=False, children: Column | None = None, parts=None) -> Column:
    said = F.coalesce(ordered if isinstance(ordered, Column) else F.lit(ordered), F.lit(False)).cast("string")
    return _build("block", "list_item", text, children, parts, attributes(ordered=said), exact=True)


def hr() -> Column:
    return F.array(element("block", "hr", ""))


def metadata(text: Text) -> Column:
    return F.array(element("block", "metadata", _text(text), encoding="yaml"))


def _picture(kind: str, src: Text, alt: Text, title: Text, source: Column) -> Column:
    return F.array(element(kind, "image", F.coalesce(_text(alt), F.lit("")), attrs=attributes(src=source, alt=_text(alt), title=_text(title))))


def image(src: Text, alt: Text = None, title: Text = None) -> Column:
    """An image; its source is always given, empty if null."""
    return _picture("block", src, alt, title, F.coalesce(_text(src), F.lit("")))


def raw(text: Text, format: Text = "html") -> Column:  # noqa: A002
    return F.array(element("block", "raw", _text(text), attrs=attributes(format=F.coalesce(_text(format), F.lit("html")))))


def div(children: Column | None = None, id: Text = None, class_: Text = None, parts=None) -> Column:  # noqa: A002
    return _build("block", "div", None, children, parts, attributes(id=_text(id), class_=_text(class_)))


def section(rank, title: Text = None, children: Column | None = None, parts=None, inlines=None) -> Column:
    """A heading with what belongs to it.

    ``children`` or ``parts`` keep their levels and are numbered from 1. With
    ``inlines`` (a list of lists) the heading has no content of its own; they
    all become its children at level 2, numbered from 0. A null rank is 2, or 1
    with ``inlines``.
    """
    given = (rank if isinstance(rank, Column) else F.lit(rank)).cast("int")
    head = lambda content, default: F.array(element("block", "heading", content, attrs=attributes(heading_level=F.coalesce(given, F.lit(default)).cast("string"))))
    if inlines is not None:
        return F.concat(head(None, 1), renumbered(F.transform(_joined(inlines), lambda b: b.withField("level", F.lit(2)))))
    top = head(F.coalesce(_text(title), F.lit("")), 2)
    if children is None and parts is None:
        return top
    return F.concat(top, renumbered(live(F.coalesce(children, empty_list())) if parts is None else _joined(parts), 1))


# ---- inlines ----


def _inline(element_type: str, text: Text, children: Column | None, parts, attrs: Column | None = None, parts_attrs: Column | None = None) -> Column:
    attrs = attributes() if attrs is None else attrs
    if children is None and parts is not None and parts_attrs is not None:
        attrs = parts_attrs
    return _build("inline", element_type, F.coalesce(_text(text), F.lit("")), children, parts, attrs, child_content=("", None))


def text(value: Text) -> Column:
    return _inline("text", value, None, None)


def space() -> Column:
    return F.array(element("inline", "space", ""))


def softbreak() -> Column:
    return F.array(element("inline", "softbreak", ""))


def linebreak() -> Column:
    return F.array(element("inline", "linebreak", ""))


def _style(name: str):
    def build(value: Text = None, children: Column | None = None, parts=None) -> Column:
        return _inline(name, value, children, parts)

    build.__name__ = name
    build.__doc__ = f"An inline of type {name}."
    return build


bold = _style("bold")
italic = _style("italic")
strikethrough = _style("strikethrough")
superscript = _style("superscript")
subscript = _style("subscript")
smallcaps = _style("smallcaps")
underline = _style("underline")
note = _style("note")


def inline_code(value: Text) -> Column:
    return _inline("code", value, None, None)


def math(value: Text, display=False) -> Column:
    shown = F.when(F.coalesce(display if isinstance(display, Column) else F.lit(display), F.lit(False)), "block").otherwise("inline")
    return _inline("math", value, None, None, attributes(display=shown))


def math_element(value: Text, display=False) -> Column:
    """The old shape, encoded as LaTeX."""
    shown = F.when(F.coalesce(display if isinstance(display, Column) else F.lit(display), F.lit(False)), "block").otherwise("inline")
    return element("inline", "math", _text(value), encoding="latex", attrs=attributes(display=shown))


def link(href: Text, value: Text = None, title: Text = None, children: Column | None = None, parts=None) -> Column:
    return _inline("link", value, children, parts, attributes(href=_text(href), title=_text(title)), attributes(href=_text(href)))


def inline_image(src: Text, alt: Text = None, title: Text = None) -> Column:
    return _picture("inline", src, alt, title, _text(src))


def quoted(value: Text = None, quote_type: Text = "double", children: Column | None = None, parts=None) -> Column:
    """A quotation within a line; over ``parts`` the type of quotes isn't given."""
    return _inline("quoted", value, children, parts, attributes(quote_type=F.coalesce(_text(quote_type), F.lit("double"))), attributes())


def cite(key: Text) -> Column:
    return _inline("cite", key, None, None, attributes(key=_text(key)))


def cite_element(key: Text, prefix: Text = None, suffix: Text = None) -> Column:
    return element("inline", "cite", _text(key), attrs=attributes(key=_text(key), prefix=_text(prefix), suffix=_text(suffix)))


def span(value: Text = None, id: Text = None, class_: Text = None, children: Column | None = None, parts=None) -> Column:  # noqa: A002
    return _inline("span", value, children, parts, attributes(id=_text(id), class_=_text(class_)) if children is None else attributes())


def raw_inline(value: Text, format: Text = "html") -> Column:  # noqa: A002
    return _inline("raw", value, None, None, attributes(format=F.coalesce(_text(format), F.lit("html"))))


# ---- short names ----


class short:
    """One- and two-letter names for builders, as in HTML."""

    @staticmethod
    def _heading(rank: int):
        return staticmethod(lambda content=None, **more: heading(rank, content, **more))

    @staticmethod
    def doc(parts) -> Column:
        """Assembles a list of lists."""
        return renumbered(_joined(parts))

    page = doc
    p, blockquote, bq, li, hr, div = map(staticmethod, (paragraph, blockquote, blockquote, list_item, hr, div))
    text, b, strong, i, em, code, s, sup, sub, span, math = map(staticmethod, (text, bold, bold, italic, italic, inline_code, strikethrough, superscript, subscript, span, math))
    h1, h2, h3, h4, h5, h6 = (staticmethod(lambda content=None, _r=r, **more: heading(_r, content, **more)) for r in range(1, 7))

    @staticmethod
    def pre(language: Text, content: Text) -> Column:
        return code(content, language)

    @staticmethod
    def ul(items: Column) -> Column:
        return list_of(items, False)

    @staticmethod
    def ol(items: Column) -> Column:
        return list_of(items, True)

    @staticmethod
    def img(src: Text, alt: Text = None) -> Column:
        return image(src, alt)

    @staticmethod
    def a(url: Text, content: Text) -> Column:
        return link(url, content)


setattr(short, "del", staticmethod(strikethrough))
