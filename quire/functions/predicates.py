"""Classification predicates as Column expressions (family D). Ordered rules are coalesced `when`s: the first that holds decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import CJK, CONTROL, cjk, letters, strip


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    return F.coalesce(*[F.when(c, v if isinstance(v, Column) else F.lit(v)) for c, v in rules], F.lit(default))


def words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^ \t\n\r]+"))


def page_number_like(c: Column) -> Column:
    return strip(c).rlike(r"^(?:[0-9]+|[ivxlcdmIVXLCDM]+)$")


def running_text_like(c: Column) -> Column:
    """Short enough to be a running header: 90 characters, 12 words, a letter, no structure."""
    return (F.length(c) <= 90) & (words(c) <= 12) & c.rlike("[A-Za-z]") & ~c.rlike(r"^(?:#|!\[|\||[-*] |[0-9]+[.)] )")


def block_type(c: Column) -> Column:
    """heading, image, table, list, footnote or plain."""
    s = strip(c)
    return first_match([(s.rlike(r"^#{1,6}[ \t]"), "heading"), (s.rlike(r"^!\[[^\]]*\]\([^)]*\)$"), "image"), (s.rlike(r"^\|.*\|$") | s.rlike(r" \| .* \| "), "table"),
                        (s.rlike(r"^(?:[-*+]|[0-9]{1,3}[.)])[ \t]"), "list"), (s.rlike(r"^(?:\[\^|[0-9]{1,3}[ \t]+[A-Z])"), "footnote")], "plain")


def formula_like(c: Column) -> Column:
    """A broken formula."""
    s, symbol = strip(c), r"[=+*/^_<>|]"
    n, alnum = F.regexp_count(s, F.lit(symbol)), F.regexp_count(s, F.lit("[A-Za-z0-9]"))
    return ((F.length(s) <= 1) & (n > 0)) | ((F.length(s) <= 12) & (n > 0) & ~s.rlike("[A-Za-z]{2}")) | ((F.length(s) <= 24) & (n >= F.greatest(F.lit(2), alnum)))


def note_line(c: Column) -> Column:
    return c.rlike(r"^(?:[0-9]+|\*|†|‡)[ \t]+")


def footnote_heavy(c: Column) -> Column:
    """40 characters and two marker lines among the first 32, or one marker line of 72 characters."""
    lines = F.slice(F.split(c, "\n"), 1, 32)
    marked = F.size(F.filter(lines, note_line))
    return (F.length(c) >= 40) & ((marked >= 2) | ((F.size(lines) == 1) & (marked == 1) & (F.length(c) >= 72)))


#: Title part and chapter kind, in order; the first that a title contains decides.
TITLE_HINTS = (
    ("cover", "cover"), ("half title", "cover"), ("title page", "cover"),
    ("copyright", "front_matter"), ("imprint", "front_matter"), ("dedication", "front_matter"), ("epigraph", "front_matter"), ("preface", "front_matter"), ("foreword", "front_matter"),
    ("acknowledg", "front_matter"), ("introduction", "front_matter"), ("list of contributors", "front_matter"), ("list of abbreviations", "front_matter"), ("editorial board", "front_matter"),
    ("note on the text", "apparatus"), ("translator's note", "apparatus"), ("notes on transcription", "apparatus"), ("notes on dates", "apparatus"), ("notes on the text", "apparatus"),
    ("abbreviations", "apparatus"), ("glossary", "apparatus"), ("editorial note", "apparatus"),
    ("table of contents", "toc"), ("contents", "toc"), ("list of figures", "toc"), ("list of tables", "toc"), ("list of maps", "toc"), ("list of illustrations", "toc"),
    ("bibliography", "bibliography"), ("references", "bibliography"), ("works cited", "bibliography"), ("further reading", "bibliography"),
    ("index", "index"), ("appendix", "appendix"), ("annex", "appendix"),
)
#: The chapter kind that a page kind speaks for.
PAGE_TO_CHAPTER = {"toc": "toc", "references": "bibliography", "index": "index", "notes_heavy": "apparatus", "back_matter": "apparatus", "front_matter": "front_matter", "table_heavy": "narrative", "body": "narrative", "visual_only": "cover"}
#: Kinds that aren't translated.
UNTRANSLATED = ("cover", "toc", "apparatus", "bibliography", "index", "appendix")


def title_kind(title: Column) -> Column:
    t = F.lower(strip(title))
    return first_match([(t.contains(part), kind) for part, kind in TITLE_HINTS])


def chapter_kind(title: Column, majority: Column, explicit: Column | None = None, preserved: Column | None = None) -> Column:
    """Explicit kind, preserved resources, title, most frequent page kind, narrative."""
    by_page = F.create_map(*[F.lit(x) for kv in PAGE_TO_CHAPTER.items() for x in kv])[majority]
    parts = [explicit] if explicit is not None else []
    if preserved is not None:
        parts.append(F.when(preserved, F.lit("apparatus")))
    return F.coalesce(*parts, title_kind(title), by_page, F.lit("narrative"))


def translatable(kind: Column, translate: Column, preserve: Column, resource: Column) -> Column:
    """False if told so, if a preserved resource, or by kind."""
    return F.coalesce(translate, F.lit(True)) & ~(F.coalesce(preserve, F.lit(False)) & F.coalesce(resource, F.lit(False))) & ~kind.isin(*UNTRANSLATED)


#: Weights of the reasons for which a block may be bad OCR.
OCR_WEIGHTS = {"control_character_density": 0.65, "symbol_density": 0.25, "fragmented_tokens": 0.40, "impossible_word_join": 0.55, "out_of_page_bbox": 0.55, "figure_overlap": 0.25, "table_overlap": 0.25,
               "header_overlap": 0.15, "footer_overlap": 0.20, "scan_artifact_overlap": 0.25, "evidence_disagreement": 0.45}


#: Characters that are neither letters, digits nor white space; of these, the ones that prose seldom has.
PUNCTUATION = r"[^\p{L}\p{N}\p{Z}\s]"
SYMBOL = r"[^\p{L}\p{N}\p{Z}\s'’.,;:!?–—()\[\]-]"


def ocr_reasons(text: Column, overlaps: Column | None = None, outside: Column | None = None, evidence: Column | None = None) -> Column:
    """The reason codes that hold, as an array."""
    n = F.greatest(F.length(text), F.lit(1))
    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    fragments = F.size(F.filter(tokens, lambda x: x.rlike(r"^[\p{Nd}:/.-]{1,8}$")))
    holds = {
        "control_character_density": F.regexp_count(text, F.lit(CONTROL)) / n >= 0.02,
        "symbol_density": (F.regexp_count(text, F.lit(SYMBOL)) / n >= 0.06) | (F.regexp_count(text, F.lit(PUNCTUATION)) / n >= 0.20),
        "fragmented_tokens": (F.size(tokens) > 0) & (fragments / F.greatest(F.size(tokens), F.lit(1)) >= 0.45),
        "impossible_word_join": text.rlike(r"\b(?:of|and|the|in|to|for)[A-Z][a-z]{2,}"),
    }
    if outside is not None:
        holds["out_of_page_bbox"] = outside
    if overlaps is not None:
        holds |= {f"{x}_overlap": F.array_contains(overlaps, x) for x in ("figure", "table", "header", "footer", "scan_artifact")}
    if evidence is not None:
        # two texts without words agree; case doesn't count
        mine, theirs = (F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)(\w+)"), 1)) for x in (text, evidence))
        union = F.size(F.array_union(mine, theirs))
        holds["evidence_disagreement"] = evidence.isNotNull() & (union > 0) & (F.size(F.array_intersect(mine, theirs)) / F.greatest(union, F.lit(1)) < 0.25)
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in holds.items()]), lambda x: x.isNotNull())


def ocr_score(reasons: Column) -> Column:
    """The weights' sum in hundredths, 100 at most: whole numbers, so that the cut-offs are exact."""
    weight = F.create_map(*[x for k, v in OCR_WEIGHTS.items() for x in (F.lit(k), F.lit(round(100 * v)))])
    return F.least(F.lit(100), F.aggregate(reasons, F.lit(0), lambda a, x: a + weight[x]))


def ocr_verdict(score: Column) -> Column:
    return first_match([(score >= 82, "suspect_ocr"), (score >= 55, "review")], "reading")


def untranslated(source: Column, output: Column) -> Column:
    """The output of a translation into Chinese is still in Latin letters."""
    a, c, n = letters(output), cjk(output), F.length(source)
    return first_match([(letters(source) < 300, False), ((c < 80) & (a > 250), True), ((n < 1000) & (c >= 160), False), (c >= 1000, False)], None).isin(True) | (
        first_match([(letters(source) < 300, False), ((c < 80) & (a > 250), False), ((n < 1000) & (c >= 160), False), (c >= 1000, False)], True) & (a / F.greatest(a + c, F.lit(1)) > 0.72))


def incomplete(source: Column, output: Column) -> Column:
    return (F.length(source) >= 1200) & (cjk(output) + F.floor(letters(output) * 35 / 100) < 0.18 * F.length(source))


def mixed_words(c: Column) -> Column:
    """Words of 4 or more lower-case letters in lines that hold CJK characters."""
    return F.aggregate(F.filter(F.split(c, "\n"), lambda x: x.rlike(CJK) & ~x.rlike(r"^[#!|]")), F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(r"\b[a-z]{4,}\b")))


def quality_error(source: Column, output: Column) -> Column:
    """The first reason not to accept a translation."""
    meta = sum((F.lower(output).contains(x)).cast("int") for x in ("as an ai", "i cannot", "here is the translation", "please provide", "i'm sorry"))
    return first_match([(meta >= 2, "meta_response"), (untranslated(source, output), "untranslated"), (incomplete(source, output), "incomplete"), (mixed_words(output) >= 18, "mixed_language")])


def error_class(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *parts: F.greatest(*[m.contains(x).cast("int") for x in parts]) == 1
    return first_match([(has("401", "403", "invalid api key", "quota exceeded"), "permanent"), (has("429", "rate limit", "timeout", "timed out", "overloaded", "529", "connection"), "transient"), (m != "", "retryable")])


#: Chapter lines, first pattern that matches, and its confidence.
CHAPTER_LINES = ((r"^(?i:chapter)[ \t]+[0-9]+", 0.9), (r"^(?i:chapter)[ \t]+[IVXLCDM]+", 0.9), (r"^(?i:part)[ \t]+(?:[0-9]+|[IVXLCDM]+)", 0.85), (r"^[0-9]{1,2}[.][ \t]+[A-Z]", 0.8), (r"^[IVXLCDM]+[.][ \t]+[A-Z]", 0.7), (r"^[A-Z][A-Z ]{4,60}$", 0.5))


def chapter_line(c: Column) -> Column:
    """Confidence that a line starts a chapter; null if it doesn't."""
    s = strip(c)
    return F.when(F.length(s) <= 100, first_match([(s.rlike(p), v) for p, v in CHAPTER_LINES]))


def toc_line(c: Column) -> Column:
    return strip(c).rlike(r"\.{2,}[ \t]*[0-9]+$|^[0-9]+[ \t]+[A-Z].*[0-9]+$")
