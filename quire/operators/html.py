"""HTML pages: links, headings, main text, link resolution and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Entities that occur in text.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def body(html: Column) -> Column:
    """Without scripts, styles, comments, navigation and advertisements."""
    for tag in ("script", "style", "nav", "header", "footer", "aside"):
        html = F.regexp_replace(html, rf"(?s)<{tag}[ >].*?</{tag}>", "")
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r'(?s)<div class="ad">.*?</div>', "")


def markdown(html: Column) -> Column:
    """Headings, paragraphs, quotes, items and inline marks as markdown."""
    text = body(html)
    for tag, mark in (("h1", "## "), ("h2", "### "), ("h3", "#### "), ("h4", "##### "), ("blockquote", "> "), ("li", "- "), ("p", "")):
        text = F.regexp_replace(text, rf"<{tag}(?: [^>]*)?>", f"\n\n{mark}")
    text = F.regexp_replace(text, r"([a-z])-<br ?/?>([a-z])", "$1$2")
    for pattern, mark in ((r"<br ?/?>", "\n"), (r"</?(?:b|strong)>", "**"), (r"</?(?:i|em)>", "*"), (r"</?code>", "`"), (r"<[^>]+>", "")):
        text = F.regexp_replace(text, pattern, mark)
    return F.trim(F.regexp_replace(F.regexp_replace(unescape(text), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), F.lit(" \t\n\r"))


#: A link with any attributes, its target in double, single or no quotes, its label with any tags inside.
LINK = r"""(?is)<a(?:\s[^>]*)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)[^>]*>(.*?)</a\s*>"""


def plain(html: Column) -> Column:
    """The text of a fragment: tags gone, entities read."""
    return unescape(F.regexp_replace(html, r"<[^>]*>", ""))


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, label of every link."""
    found = F.arrays_zip(*(F.regexp_extract_all("html", F.lit(LINK), k).alias(name) for k, name in ((1, "href"), (2, "label"))))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("pos", "a"))
    return rows.select("page_id", "url", "pos", unescape(F.regexp_replace("a.href", r"""^["']|["']$""", "")).alias("href"), plain(F.col("a.label")).alias("label"))


def title(html: Column) -> Column:
    """The text of the first h1, whatever its attributes and inner tags; empty without one."""
    return plain(F.regexp_extract(html, r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>", 1))


def without_dots(path: Column) -> Column:
    """A path with `.` and `..` resolved: a fold over its steps."""
    def put(kept: Column, step: Column) -> Column:
        return F.when(step == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(step == ".", kept).otherwise(F.concat(kept, F.array(step)))

    steps = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), r"(^|/)(\.\.?)$", "$1$2/"), "/")
    return F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), put), "/"))


def resolve(url: Column, href: Column) -> Column:
    """An absolute link, against the page's address without its query and fragment; null for scripts; fragments are kept,
    `.` and `..` resolved (A10)."""
    origin, path = F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1), F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", "")
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    return (F.when(F.lower(href).startswith("javascript:"), None).when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(url, "^([a-z]+:)", 1), href))
            .when(href == "", F.regexp_replace(url, "#.*$", "")).when(href.startswith("#"), F.concat(F.regexp_replace(url, "#.*$", ""), href)).when(href.startswith("?"), F.concat(origin, path, href))
            .otherwise(F.concat(origin, without_dots(F.concat(F.when(href.startswith("/"), "").otherwise(folder), F.regexp_replace(href, r"[?#].*$", ""))), tail)))


def first_labels(found: DataFrame) -> DataFrame:
    """The first label of each target."""
    return found.groupBy("href").agg(F.min(F.struct("page_id", "pos", "label")).alias("m"), F.count("*").alias("n")).select("href", F.col("m.label").alias("label"), "n")


def validation(found: DataFrame, targets: DataFrame, target: str, samples: int = 50) -> DataFrame:
    """Links, resolved ones and samples of those that lead nowhere."""
    hits = found.join(targets.select(F.col(target).alias("_t")).distinct(), F.col("href") == F.col("_t"), "left")
    return hits.groupBy("page_id").agg(F.count("*").alias("links"), F.sum(F.col("_t").isNotNull().cast("long")).alias("resolved"), F.concat_ws(",", F.slice(F.array_sort(F.collect_set(F.when(F.col("_t").isNull(), F.col("href")))), 1, samples)).alias("missing"))


def tables(html: Column) -> Column:
    """Rows of cells, each padded to the widest row."""
    rows = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda c: F.replace(F.trim(F.regexp_replace(c, "<[^>]+>", "")), F.lit("|"), F.lit("\\|"))))
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))), "\n")


def print_pages(docs: DataFrame, key: str, order: str, html: str) -> DataFrame:
    """Virtual pages at page anchors, numbered over the whole book; an item without anchors is one page."""
    parts = F.filter(F.split(html, r'(?=<[a-z]+ [^>]*id="page_?(?:[0-9]+|[ivxlcdm]+)")'), lambda x: F.trim(x) != "")
    rows = docs.select(key, order, F.posexplode(parts).alias("part", "content"))
    return rows.withColumn("page", F.row_number().over(Window.partitionBy(key).orderBy(order, "part")))
