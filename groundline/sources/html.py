"""Text of HTML pages by the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements whose content is no text, elements that end a line, elements without an end tag.
SILENT = frozenset("script style noscript head".split())
BLOCKS = frozenset("p div li tr h1 h2 h3 h4 h5 h6 br".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.quiet: list[str] = []

    def handle_starttag(self, tag, attrs):
        # an unclosed head ends where the body begins
        if tag == "body" and "head" in self.quiet:
            self.quiet.clear()
        if tag in SILENT and tag not in VOID:
            self.quiet.append(tag)
        elif tag == "br" and not self.quiet:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if self.quiet and tag in self.quiet:
            while self.quiet.pop() != tag:
                pass
        elif tag in BLOCKS and tag != "br" and not self.quiet:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.quiet:
            self.parts.append(data)


def page_text(html: str | None) -> str | None:
    """Text nodes joined by blanks, a line break behind every block element; white space is not yet normalised."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return " ".join(parser.parts)


@F.pandas_udf(StringType())
def raw_text(html: pd.Series) -> pd.Series:
    return html.map(page_text)
