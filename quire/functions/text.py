"""Text normalisation as Column expressions (family C)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLANKS = " \t\n\r"
#: Controls other than tab, line feed and carriage return.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
CJK = r"[\x{4E00}-\x{9FFF}]"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def rewrite(c: Column, *rules: tuple[str, str]) -> Column:
    """Ordered regular-expression rewrites."""
    return reduce(lambda x, rule: F.regexp_replace(x, rule[0], rule[1]), rules, c)


def collapse(c: Column, book: bool = False) -> Column:
    """One line, single blanks, no blank before , . ; : ! ? ' (C01)."""
    return strip(rewrite(F.regexp_replace(c, CONTROL, " ") if book else c, (r"[ \t\r\n\f]+", " "), (r" ([,.;:!?'])", "$1")))


def pdf_block(c: Column) -> Column:
    """Soft hyphens and controls in words go, `x- y` is joined, a glued footnote number is split off."""
    return collapse(rewrite(c, ("­", ""), (rf"(?<=[A-Za-z]){CONTROL}(?=[A-Za-z])", ""), (CONTROL, " "), (r"([a-z])- ([a-z])", "$1$2"), (r"([a-z][.!?])([0-9]{1,3})$", "$1 $2")))


#: Regnal numerals that are split from a name.
REGNAL = "II|III|IV|V|VI|VII|VIII|IX|X|XI|XII|XIII|XIV|XV|XVI|XVII|XVIII|XIX|XX|XXI|XXII|XXIII"


def ingest_cleanup(c: Column) -> Column:
    """Soft hyphens, glued regnal numerals, glued surname particles, blanks."""
    return rewrite(c, ("­", ""), (rf"([a-z]{{3}})({REGNAL})\b", "$1 $2"), (r"(?<=[a-z])(de|van|von|della)(?=[A-Z])", " $1 "), (r"[ \t]{2,}", " "))


def repair(c: Column) -> Column:
    """Extraction artefacts: a single consonant cut off its word, orphan notes, double blanks, blank lines.
    Ordinary one- and two-letter words stay apart."""
    return rewrite(c, (r"(?<![\p{L}'])([b-hj-z]) ([a-z]{3,})(?![\p{L}\p{N}_])", "$1$2"), (r"\. y\.(?=\s|$)", "."), (r"(?m)^\s*y\.\s*$", ""), (r"([A-Za-z])  +([A-Za-z])", "$1 $2"), (r"\n{3,}", "\n\n"))


def footnote_space(c: Column) -> Column:
    """A blank before a trailing reference of 1 to 3 digits."""
    return F.regexp_replace(c, r"([A-Za-z][.,;!?]?)([0-9]{1,3})$", "$1 $2")


def one_heading(title: Column, text: Column) -> Column:
    """Exactly one H1: all are dropped, then the title goes in front."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^#[ \t]"))
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.regexp_replace(F.array_join(kept, "\n"), r"^\n+", ""))


def term_key(c: Column) -> Column:
    """Quotes folded, glued numerals and camel case split, last punctuation gone, lower case (C10, without NFKC)."""
    return F.lower(strip(rewrite(F.translate(c, "‘’“”", "''\"\""), (r"([a-z])([A-Z0-9])", "$1 $2"), (r"[ \t\n]+", " "), (r"[.,;:!?]+$", ""))))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normalisation, for which there is no built-in."""
    return s.str.normalize("NFKC")


def content_id(kind: str, page: Column, marker: Column, text: Column) -> Column:
    """The kind and 20 hex digits of a SHA-256 over its parts (C11)."""
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.concat_ws("\u001f", F.lit(kind), page.cast("string"), marker, text), 256), 1, 20))


def slug(c: Column, width: int = 56) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, width)


def chapter_id(index: Column, title: Column) -> Column:
    """ch-007-the-title."""
    return F.concat(F.lit("ch-"), F.lpad(index.cast("string"), 3, "0"), F.lit("-"), slug(title))


def fingerprint(version: str, glossary: Column, instruction: Column, text: Column) -> Column:
    """16 hex digits over all that a chunk's result depends on."""
    return F.substring(F.sha2(F.concat_ws("\n", F.lit(version), glossary, instruction, text), 256), 1, 16)


def letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z]"))


def cjk(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CJK))


def detect_rule(c: Column) -> Column:
    """zh-cn if the first 4000 characters hold 40 CJK characters that are a fifth of all letters; else null."""
    head = F.substring(c, 1, 4000)
    return F.when((cjk(head) >= 40) & (cjk(head) >= 0.2 * (cjk(head) + letters(head))), "zh-cn")


def language_family(code: Column) -> Column:
    return F.lower(F.split(F.coalesce(code, F.lit("")), "[-_]")[0])


def operation(mode: Column, source: Column, target: Column) -> Column:
    """translate, preserve or convert."""
    same = language_family(source) == language_family(target)
    return F.when(mode != "auto", mode).when(same & (F.lower(source) != F.lower(target)), "convert").when(same, "preserve").otherwise("translate")


def strip_gloss(output: Column, source: Column) -> Column:
    """`English(gloss)` becomes its gloss where the output has more glosses than its source (C17)."""
    gloss = r"[A-Za-z][A-Za-z ]*[(\x{FF08}]([\x{4E00}-\x{9FFF}]+)[)\x{FF09}]"
    # a gloss is counted by its end: looking for its beginning takes quadratic time in runs of letters without one
    end = F.lit(r"[A-Za-z] *[(\x{FF08}][\x{4E00}-\x{9FFF}]+[)\x{FF09}]")
    return F.when(F.regexp_count(output, end) > F.regexp_count(source, end), F.regexp_replace(output, gloss, "$1")).otherwise(output)


def cut_appendix(c: Column) -> Column:
    """Text in front of an echoed glossary with mapping lines."""
    return F.regexp_replace(c, r"(?s)\n+(?:#+ *)?(?:Glossary|Terminology)[^\n]*\n+(?:[-*] )?[^\n]+(?:=>|->|\x{2192})[^\n]+.*$", "")


def strip_notice(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!-- fail-open.*?-->\n?(?:> [^\n]*\n?)?", "")


def file_stem(path: Column) -> Column:
    """Base name without suffix, blanks collapsed, lower case (C20)."""
    return F.lower(strip(rewrite(path, (r"^.*[/\\]", ""), (r"\.[A-Za-z0-9]+$", ""), (r"[ _\t]+", " "))))


def page_ranges(pages: Column) -> Column:
    """Sorted distinct integers as `1-3, 7`."""
    zero = F.expr("array(struct(cast(null as bigint) as a, cast(null as bigint) as b))")
    grown = F.aggregate(F.array_sort(F.array_distinct(pages)), zero, lambda acc, p: F.when(F.element_at(acc, -1)["b"] == p - 1, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), p.cast("bigint").alias("b"))))).otherwise(F.concat(acc, F.array(F.struct(p.cast("bigint").alias("a"), p.cast("bigint").alias("b"))))))
    return F.array_join(F.transform(F.filter(grown, lambda r: r["a"].isNotNull()), lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("-", r["a"], r["b"]))), ", ")


def without_watermarks(c: Column, marks: str = r"(?i)(?:oceanofpdf|z-lib|libgen)[a-z.]*") -> Column:
    """Lines that are only a scrape site's mark or a stray rule go; marks inside lines are cut out."""
    kept = F.filter(F.split(c, "\n"), lambda x: ~strip(x).rlike(rf"^(?:#+\s*)?(?:{marks}|[-_*=]{{3,}})$"))
    return F.regexp_replace(F.array_join(kept, "\n"), marks, "")


def without_repeated_headings(c: Column) -> Column:
    """A heading that equals the one before, with only blanks between, goes (C08): a fold that keeps the last line."""
    zero = F.expr("struct(array('') as out, '' as last)")

    def put(acc: Column, x: Column) -> Column:
        s = F.lower(strip(x))
        again = s.rlike("^#{1,6} ") & (s == acc["last"])
        return F.struct(F.when(again, acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"), F.when(s == "", acc["last"]).otherwise(s).alias("last"))

    out = F.aggregate(F.split(c, "\n"), zero, put)["out"]
    return F.array_join(F.slice(out, 2, F.size(out)), "\n")


def cover_only(c: Column) -> Column:
    """The first image of a cover, nothing else."""
    return F.regexp_extract(c, r"(!\[[^\]]*\]\([^)]*\))", 1)


def exclusion_keys(*fields: Column) -> Column:
    """Titles, authors and publishers, whole and in parts of four characters or more."""
    given = F.filter(F.array(*fields), lambda x: x.isNotNull())
    parts = F.flatten(F.transform(given, lambda x: F.concat(F.array(x), F.split(x, r"\s*[:—–|-]\s*"))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, term_key), lambda x: F.length(x) >= 4)))


def for_translation(title: Column, markdown: Column) -> Column:
    """A chapter's text under its title, image paths relative, placeholder titles left out."""
    body = F.regexp_replace(markdown, r"\]\((?:/[^)]*/|\./)?(images/[^)]*)\)", "]($1)")
    return F.when(title.isNull() | title.rlike(r"(?i)^(?:untitled|chapter [0-9]+|section [0-9]+)$"), body).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), body))
