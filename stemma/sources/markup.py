"""HTML pages to text, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def html_text(c: Column) -> Column:
    """Text of a page: scripts, styles and comments go, blocks become lines, entities become characters."""
    dropped = F.regexp_replace(c, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    broken = F.regexp_replace(dropped, r"(?i)<br\s*/?>|</?(p|div|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|title|nav)\b[^>]*>", "\n")
    bare = F.regexp_replace(broken, r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[ \t]+", " "), r"\s*\n\s*", "\n"), F.lit(" \n"))
