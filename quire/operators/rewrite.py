"""Splitting and checking of translated text: media islands, nested splitting, terms, polish gates, suggestions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import predicates as P
from quire.functions import text as T


def media_segments(blocks: DataFrame, key: str) -> DataFrame:
    """Islands of text and single media, in order."""
    w = Window.partitionBy(key).orderBy("pos")
    media = P.block_type(F.col("text")).isin("image", "table")
    rows = blocks.withColumn("kind", F.when(media, "media").otherwise("text"))
    new = (F.col("kind") == "media") | F.coalesce(F.lag("kind").over(w) != F.col("kind"), F.lit(True))
    rows = rows.withColumn("segment", F.sum(new.cast("int")).over(w) - 1)
    return rows.groupBy(key, "segment", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


_LEVELS = ("\n\n", "\n", r"(?<=[.!?。！？]) ", " ")


def split_down(text: str, most: int, level: int = 0) -> list[str]:
    """Parts of `most` characters at most: by paragraph, then line, sentence, word, and last by force."""
    if len(text) <= most:
        return [text] if text else []
    if level == len(_LEVELS):
        return [text[i : i + most] for i in range(0, len(text), most)]
    joint = " " if level == 2 else _LEVELS[level]
    out: list[str] = []
    for part in re.split(_LEVELS[level], text):
        if out and len(out[-1]) + len(joint) + len(part) <= most:
            out[-1] += joint + part
        else:
            out.extend(split_down(part, most, level + 1) if len(part) > most else [part] if part else [])
    return out


def fixed_chunks(text: str, size: int = 10_000) -> list[str]:
    """Chunks of about `size` that end with a sentence or paragraph within a tenth of it."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            low = at + size - size // 10
            window = text[low : at + size + size // 10]
            hit = re.search(r"\n\n|[.!?。！？](?=\s)", window)
            end = low + hit.end() if hit else end
        out.append(text[at:end])
        at = end
    return out


def gloss_pollution(source: Column, output: Column) -> Column:
    """More glosses than the source has, and at least three."""
    gloss = r"[A-Za-z]{2}[(\x{FF08}][\x{4E00}-\x{9FFF}]+[)\x{FF09}]"
    n = F.regexp_count(output, F.lit(gloss))
    return (n >= 3) & (n > F.regexp_count(source, F.lit(gloss)))


def non_prose(c: Column) -> Column:
    """Images, captions and links make up a segment."""
    s = T.strip(c)
    linked = F.length(F.array_join(F.regexp_extract_all(s, F.lit(r"(!?\[[^\]]*\]\([^)]*\))"), 1), ""))
    return (s == "") | (linked * 10 >= F.length(s) * 6) | s.rlike(r"^(?i:figure|fig\.|table|map|plate)\s+[0-9IVX]+")


def bad_candidate(c: Column) -> Column:
    """Why a phrase can't be a term; null if it can."""
    return P.first_match([(c.rlike(r"[<>\[\]{}|*_`]"), "markup"), (c.rlike(r"^(?:See|Cf|Ibid|Vol|No|Ed|Eds|Trans)\b"), "bibliographic"), (c.rlike(r"\b[IVX] [a-z]"), "malformed_numeral"), (c.rlike(r"^(?:When|While|Although|Because|If|As|After|Before|Since)\b"), "clause_lead"),
                          (c.rlike(r"(?i)\b(?:of|and|the|in|on|for|from|with|to|at|by|or|as|an|a)$"), "dangling"), (c.rlike(r"(?i)^\S+ centur(?:y|ies)$"), "century"), (c.rlike(r"(?i)^(?:far|near|middle|upper|lower|central|northern|southern|eastern|western) (?:east|west|north|south|africa|asia|europe)$"), "compass")])


def rewrite_ok(source: Column, candidate: Column) -> Column:
    """A rewrite isn't empty, no refusal, and has CJK characters as its source's letters ask for."""
    low, n = F.lower(candidate), T.letters(source)
    return (T.strip(candidate) != "") & ~low.rlike(r"i cannot|i can't|as an ai|i'm sorry") & ((n < 40) | (T.cjk(candidate) >= F.greatest(F.lit(12), F.floor(n / 8))))


def polish_reject(before: Column, after: Column) -> Column:
    """Why a polished line isn't taken; null if it is."""
    images = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"(!\[[^\]]*\]\([^)]*\))"), 1), "")
    notes = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"(\[\^?[0-9]+\])"), 1), "")
    return P.first_match([(T.strip(after) == "", "empty"), (P.block_type(before) != P.block_type(after), "structural"), (T.cjk(after) * 100 < T.cjk(before) * 82, "cjk_drop"), (F.length(after) * 100 < F.length(before) * 62, "length_drop"),
                          (F.lower(after).rlike(r"^(?:here is|note:|translation:)"), "commentary"), (images(before) != images(after), "image_change"), (notes(before) != notes(after), "footnote_change")])


def hard_term(enforcement: Column, updated_by: Column) -> Column:
    return F.coalesce(enforcement == "hard", F.coalesce(updated_by, F.lit("")) != "user")


def missing_targets(pairs: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Terms of a text whose target its translation lacks (F09); they are joined by the text's key."""
    return selected.join(pairs.select(key, "translated"), key).where(~F.contains("translated", "target")).drop("translated")


def substituted(text: Column, terms: Column) -> Column:
    """Source forms that were left over become their targets, one after the other."""
    return F.aggregate(terms, text, lambda acc, t: F.replace(acc, t["source"], t["target"]))


def merge_suggestions(candidates: DataFrame, suggestions: DataFrame, locked: DataFrame) -> DataFrame:
    """Suggested targets, but not for locked terms."""
    lock = locked.select("source").distinct().withColumn("_l", F.lit(True))
    new = suggestions.groupBy("source").agg(F.max_by("target", "seq").alias("_t"))
    out = candidates.join(lock, "source", "left").join(new, "source", "left")
    return out.withColumn("target", F.when(F.col("_l"), F.col("target")).otherwise(F.coalesce("_t", "target"))).drop("_l", "_t")


def rewrite_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Each link's output file by its path, its fragment kept."""
    path, fragment = F.regexp_extract("href", "^([^#]*)", 1), F.regexp_extract("href", "(#.*)$", 1)
    out = links.withColumn("_p", path).join(files.select(F.col("path").alias("_p"), "output"), "_p", "left")
    return out.withColumn("target", F.when(F.col("output").isNotNull(), F.concat("output", fragment)).otherwise(F.col("href"))).drop("_p", "output")


def byline(lines: Iterable[str]) -> list[str]:
    """`by` and the names after it as one line."""
    out: list[str] = []
    pending: list[str] | None = None
    for x in lines:
        if x.strip().lower() == "by":
            pending = []
        elif pending is not None and re.fullmatch(r"[A-Z][\w.'-]*(?: [A-Z][\w.'-]*){0,3}", x.strip()):
            pending.append(x.strip())
        else:
            if pending is not None:
                out.append("By " + " ".join(pending) if pending else "by")
                pending = None
            out.append(x)
    if pending is not None:
        out.append("By " + " ".join(pending) if pending else "by")
    return out


def merge_boundaries(rows: list[tuple[int, float, int, str]]) -> list[tuple[int, float, int, str]]:
    """Boundaries (page, y, priority, title) in order; neighbours on a page that are as good as equal become one, with
    the higher priority's place and a title (H09)."""
    out: list[tuple[int, float, int, str]] = []
    for page, y, priority, title in sorted(rows):
        if out and out[-1][0] == page and (abs(out[-1][1] - y) < 0.5 or (title and out[-1][3] == title)):
            old = out[-1]
            best, other = ((page, y, priority, title), old) if priority > old[2] else (old, (page, y, priority, title))
            out[-1] = (*best[:3], best[3] or other[3])
        else:
            out.append((page, y, priority, title))
    return out


def toc_entries(lines: list[str]) -> list[tuple[str, int]]:
    """Titles and printed pages: inline entries, else title and page on lines of their own; the first parser with
    three entries, else the longest; nothing twice (E11)."""
    inline = [(m[1].strip(" ."), int(m[2])) for x in lines if (m := re.fullmatch(r"\s*(.*?\S)[ .]*[ .]([0-9]{1,4})\s*", x)) and re.search(r"[A-Za-z]", m[1])]
    stacked = [(a.strip(), int(b)) for a, b in zip(lines, lines[1:], strict=False) if re.search(r"[A-Za-z]", a) and re.fullmatch(r"\s*[0-9]{1,4}\s*", b)]
    found = next((p for p in (inline, stacked) if len(p) >= 3), max((inline, stacked), key=len))
    once: dict[tuple[str, int], tuple[str, int]] = {}
    for title, page in found:
        once.setdefault((title.lower(), page), (title, page))
    return list(once.values())


def span_batches(lengths: Column, most: int, marker: int) -> Column:
    """Greedy groups of spans joined by a marker: an array of (size, parts)."""
    from quire.operators.lines import chunk_sizes

    return chunk_sizes(lengths, most, marker)


def translated_notes(spans: Column, translate) -> Column:
    """Prose spans translated, citations copied, joined (K05). `translate` maps a Column to a Column."""
    return F.array_join(F.transform(spans, lambda s: F.when(s["kind"] == "prose", translate(s["text"])).otherwise(s["text"])), "")


def table_needs_translation(c: Column) -> Column:
    return (T.cjk(c) < 40) & (T.letters(c) > 200) & c.rlike(r"(?m)^\|")


def batches(rows: DataFrame, order: str, key: str, size: int = 10) -> DataFrame:
    """Batch numbers of terms in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size))


def lenient_json(text: str):
    """The first JSON value in a model's answer, fenced or not; None if there is none."""
    for m in re.finditer(r"[\[{]", text or ""):
        try:
            return json.JSONDecoder().raw_decode(text, m.start())[0]
        except ValueError:
            continue
    return None


def translation_input(chapters: DataFrame) -> DataFrame:
    """Chapters that are translated, image lines replaced by a placeholder."""
    return chapters.where("translate").withColumn("markdown", F.regexp_replace("markdown", r"(?m)^!\[[^\]]*\]\([^)]*\)$", "[image]"))


def suspicious_pages(quarantined: DataFrame, chapters: DataFrame) -> DataFrame:
    """Unresolved quarantine rows and fallback images in translated chapters."""
    images = chapters.where("translate").select("chapter_id", F.explode(F.regexp_extract_all("markdown", F.lit(r"(!\[[^\]]*\]\([^)]*fallback[^)]*\))"), 1)).alias("evidence")).withColumn("violation", F.lit("fallback_image"))
    return quarantined.where("resolution is null").select("chapter_id", F.col("text").alias("evidence"), F.lit("unresolved_ocr").alias("violation")).unionByName(images)
