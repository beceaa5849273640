"""An allow-list filter for HTML, as an Arrow function over a text column."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What may stay.
TAGS = frozenset("p br strong em ul ol li h1 h2 h3 h4 blockquote code pre a".split())
ATTRIBUTES = ("href", "title")
SCHEMES = ("http:", "https:", "mailto:")
_SILENT = frozenset(("script", "style"))


class _Filter(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if tag not in TAGS or self.silent:
            return
        kept = ""
        if tag == "a":
            for name, value in attrs:
                value = "".join(ch for ch in value or "" if ch >= " ").strip()
                if name == "title" or name == "href" and value.lower().startswith(SCHEMES):
                    kept += f' {name}="{escape(value)}"'
            kept += ' rel="noopener noreferrer"'
        self.out.append(f"<{tag}{kept}>")
        if tag != "br":
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in self.open and not self.silent:
            while True:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data):
        if not self.silent:
            self.out.append(escape(data, quote=False))


def clean(html: str | None) -> str:
    if not html:
        return ""
    parser = _Filter()
    parser.feed(html)
    parser.close()
    return "".join(parser.out) + "".join(f"</{t}>" for t in reversed(parser.open))


def sanitize_html(html: Column) -> Column:
    return F.pandas_udf(lambda rows: rows.map(clean), T.StringType())(html)
