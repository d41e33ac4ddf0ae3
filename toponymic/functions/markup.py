"""Page fields cut out of markup with built-in regex expressions.

Articles and paragraph text are parsed (``operators.article_markup``); these column
expressions read single elements and attributes of pages (title, language, heading). The
patterns avoid look-arounds so the SQL oracle can use the same text in RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from toponymic.functions.words import col_of

# HTML block-level elements that close an open paragraph-like element.
BLOCK_TAGS = ("address|article|aside|blockquote|body|dd|details|dialog|div|dl|dt|fieldset|"
              "figcaption|figure|footer|form|h[1-6]|header|hgroup|hr|html|li|main|nav|ol|p|pre|"
              "section|table|ul")

# Entities decoded in text, '&amp;' last so '&amp;lt;' stays '&lt;'.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&amp;", "&")]

NOISE = r"(?is)<script(\s[^>]*)?>.*?</script\s*>|<style(\s[^>]*)?>.*?</style\s*>|<!--.*?-->"
ANY_TAG = r"<[^>]*>"


def open_tag(tag: str) -> str:
    return rf"(?i)<{tag}(\s[^>]*)?>"


def cut_after(tag: str) -> str:
    """From the end of an element's content to the end of the fragment."""
    return rf"(?is)(</{tag}\s*>|</?({BLOCK_TAGS})(\s[^>]*)?/?>).*\z"


def element_pattern(tag: str) -> str:
    """First element ``tag``: group 1 = attributes, group 2 = content (lazy, to the first
    closing tag or the end of the input)."""
    return rf"(?is)<{tag}(\s[^>]*)?>(.*?)(</{tag}\s*>|\z)"


def attribute_pattern(attr: str) -> str:
    """Group 2: the value with its quotes (either mark may stand inside the other)."""
    return rf"""(?is)(^|\s){attr}\s*=\s*("[^"]*"|'[^']*')"""


def decode_entities(s: Column) -> Column:
    for entity, char in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(char))
    return s


def inner_text(fragment: Column) -> Column:
    return decode_entities(F.regexp_replace(fragment, ANY_TAG, ""))


def first_element(markup: str | Column, tag: str) -> Column:
    """The first ``tag`` element (whole match), or null when absent."""
    m = F.regexp_extract(col_of(markup), element_pattern(tag), 0)
    return F.when(m != "", m)


def element_content(element: Column, tag: str) -> Column:
    return F.regexp_extract(element, element_pattern(tag), 2)


def element_attrs(element: Column, tag: str) -> Column:
    return F.regexp_extract(element, element_pattern(tag), 1)


def start_tag_attrs(markup: str | Column, tag: str) -> Column:
    """Attribute text of the first ``tag`` start tag ('' when it has none or is absent);
    reads the start tag only, not the element."""
    return F.regexp_extract(col_of(markup), rf"(?is)<{tag}(\s[^>]*)?>", 1)


def attribute(attrs: Column, attr: str) -> Column:
    """Value of ``attr`` in an attribute string, or null."""
    quoted = F.regexp_extract(attrs, attribute_pattern(attr), 2)
    return F.when(quoted != "", F.substring(quoted, 2, F.length(quoted) - 2))


def first_text(markup: str | Column, tag: str) -> Column:
    """Text of the first ``tag`` element, or null when there is none."""
    el = first_element(markup, tag)
    return F.when(el.isNotNull(), inner_text(element_content(el, tag)))
