"""Drafts between translation and review: page filters, aligned parts, adoption, marks, resets, fallbacks, salvage, rewrites
(E10, H19, H20, K07, K12, K13, L05, L09, L15, L17)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T
from quire.operators.lines import lines
from quire.operators.rewrite import split_down
from quire.operators.translate import Translator

#: The sizes to which a refused chunk is cut, one after the other.
SPLITS = (2800, 1400, 900, 500, 240)
#: What machine suggestions leave on a candidate.
SUGGESTED = ("target_suggestion", "suggestion_confidence", "suggestion_note", "suggestion_source")
_WORD = r"(?>[A-Za-z][A-Za-z'’-]{1,30}(?![A-Za-z]))"
#: Words of two letters or more; the group is empty for one within two characters of a bracket.
_FREE_WORD = rf"(?<![A-Za-z])(?:(?:(?<=[(（])|(?<=[(（].)){_WORD}|{_WORD}(?=[)）]|.[)）])|({_WORD}))"
_GLOSS = r"([A-Za-z][A-Za-z'’\-/]*(?:\s+[A-Za-z][A-Za-z'’\-/]*){0,6})\s*[（(][\x{4E00}-\x{9FFF}][^（）()A-Za-z]{0,80}[）)]"


def pages_between(chapters: DataFrame, pages: DataFrame, book: str) -> DataFrame:
    """Pages from a chapter's first to its last, whichever of the two is the greater (H19). chapters: page_start,
    page_end; one that is null or below 1 leaves the chapter without pages. pages: page."""
    low, high = F.least("page_start", "page_end"), F.greatest("page_start", "page_end")
    known = chapters.where((F.col("page_start") >= 1) & (F.col("page_end") >= 1)).withColumns({"_low": low, "_high": high})
    return known.join(pages, book).where(F.col("page").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def aligned_parts(segments: DataFrame) -> DataFrame:
    """A row for each part of a segment, numbered from 0; without parts its whole texts are the only one.
    segments: source, translation, parts (array of source and translation)."""
    whole = F.array(F.struct("source", "translation"))
    parts = F.when(F.size("parts") > 0, F.transform("parts", lambda p: F.struct(p["source"].alias("source"), p["translation"].alias("translation")))).otherwise(whole)
    rest = [c for c in segments.columns if c not in ("source", "translation", "parts")]
    return segments.select(*rest, F.posexplode(parts).alias("part", "_p")).select(*rest, "part", "_p.source", "_p.translation")


def adopt_pending(candidates: DataFrame, active: DataFrame, decisions: DataFrame) -> DataFrame:
    """What becomes of open candidates when translation begins (L05): source, target, outcome (confirmed, or skipped without a
    suggestion). Rejected terms (by the last decision or as entered) and those that are active with a target stay as they
    are. candidates: source, target_suggestion, pos; active: source, target, status; decisions: source, status, seq."""
    last = decisions.groupBy("source").agg(F.max_by("status", "seq").alias("_last"))
    held = active.groupBy("source").agg(
        F.max((F.col("status") == "rejected").cast("int")).alias("_no"), F.max(((F.col("status") == "active") & (F.trim("target") != "")).cast("int")).alias("_yes"))
    named = candidates.select(F.trim("source").alias("source"), F.trim("target_suggestion").alias("target"), "pos").where("source <> ''")
    # The first suggestion of a term is adopted; further candidates of it find it active.
    first = named.groupBy("source").agg(F.min(F.when(F.col("target") != "", F.struct("pos", "target"))).getField("target").alias("target"))
    open_ = first.join(last, "source", "left").join(held, "source", "left").where("coalesce(_last, '') <> 'rejected' and coalesce(_no, 0) = 0 and coalesce(_yes, 0) = 0")
    return open_.select("source", "target", F.when(F.col("target").isNull(), "skipped").otherwise("confirmed").alias("outcome"))


def chapter_marks(marks: DataFrame, segments: DataFrame, *keys: str) -> DataFrame:
    """One mark a segment: the title last given, the id first given, in the segments' order (L09). marks: segment_id,
    title, mark_id, seq; blank titles and unknown segments are left out. segments: segment_id, segment_index."""
    titled = marks.withColumn("title", F.trim("title")).where("title <> ''")
    one = titled.groupBy(*keys, "segment_id").agg(F.min_by("mark_id", "seq").alias("mark_id"), F.max_by("title", "seq").alias("title"), F.count("*").alias("writes"))
    return one.join(segments, [*keys, "segment_id"])


def place_marks(marks: DataFrame, book: str, near: float = 0.05) -> DataFrame:
    """Marks on pages in order of arrival; one that is nearer than `near` to a kept mark of its page goes (L09). marks: page,
    y, seq. Equal places are merged before the shuffle, as only the first can stay; a page's places are then one fold."""
    first = marks.groupBy(book, "page", "y").agg(F.min("seq").alias("seq"))
    rows = F.array_sort(F.collect_list(F.struct("seq", "y")))
    grouped = first.groupBy(book, "page").agg(rows.alias("_r"))
    none = F.slice("_r", 1, 0)
    kept = F.aggregate("_r", none, lambda have, r: F.when(F.exists(have, lambda h: F.abs(h["y"] - r["y"]) < near), have).otherwise(F.concat(have, F.array(r))))
    return grouped.select(book, "page", F.inline(kept))


def without_suggestions(candidates: DataFrame, fields: tuple[str, ...] = SUGGESTED) -> DataFrame:
    """Candidates whose suggestions are null again; what was adopted or rejected is another table and stays."""
    return candidates.withColumns({c: F.lit(None).cast(t) for c, t in candidates.dtypes if c in fields})


def reset_review(candidates: DataFrame, active: DataFrame, decisions: DataFrame, keep_suggestions: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables as they were before any decision."""
    return candidates if keep_suggestions else without_suggestions(candidates), active.where("false"), decisions.where("false")


def passthrough(chapters: DataFrame) -> DataFrame:
    """Chapters as their own translation (L17): one top heading where the chapter is in the contents, a line feed at the
    end, blank ones empty. chapters: chapter_index, title, markdown, toc."""
    title = F.when(F.coalesce(F.col("title"), F.lit("")) == "", F.concat(F.lit("Chapter "), F.col("chapter_index").cast("string"))).otherwise(F.col("title"))
    body = T.strip(F.coalesce("markdown", F.lit("")))
    headed = F.when(F.coalesce("toc", F.lit(True)), T.strip(T.one_heading(title, body))).otherwise(body)
    return chapters.withColumns({"title": title, "markdown": F.when(body == "", "").otherwise(F.concat(headed, F.lit("\n"))), "translator": F.lit("skipped")})


def polish_lines(docs: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Lines with CJK characters, outside structure, that hold a foreign phrase before its gloss or one of `words` outside
    brackets (E10): doc_id, line (from 1), text, suspects."""
    stripped = lines(docs).select("doc_id", (F.col("pos") + 1).alias("line"), T.strip(F.col("line")).alias("text"))
    prose = stripped.where(F.col("text").rlike(T.CJK) & ~F.col("text").rlike(r"^(?:#|!\[|\||>|```)"))
    free = F.transform(F.regexp_extract_all("text", F.lit(_FREE_WORD), F.lit(1)), lambda w: F.regexp_replace(w, r"^['’-]+|['’-]+$", ""))
    gloss = F.transform(F.regexp_extract_all("text", F.lit(_GLOSS), F.lit(1)), F.trim)
    listed = F.array_except(F.filter(free, lambda w: w.isin(*words)), gloss)
    return prose.withColumn("suspects", F.concat(gloss, listed)).where(F.size("suspects") > 0)


Accept = Callable[[str, str], str | None]


def filled(source: str, output: str) -> str | None:
    """The plainest acceptance: something was said."""
    return None if output.strip() else "empty"


def _in_parts(text: str, translator: Translator, accept: Accept, sizes: tuple[int, ...]) -> str | None:
    """The text translated in parts of the first size; what is refused is cut to the next, until no size is left."""
    if not sizes:
        return None
    out = []
    for part in split_down(text, sizes[0]):
        said, problem = _said(part, translator, accept)
        if problem:
            said = _in_parts(part, translator, accept, sizes[1:])
            if said is None:
                return None
        out.append(said.strip())
    return "\n\n".join(out)


def _said(text: str, translator: Translator, accept: Accept) -> tuple[str, str | None]:
    try:
        said = translator(text)
    except ValueError as problem:
        return "", str(problem) or "refused"
    return said, accept(text, said)


def kept_source(index: int, text: str, problem: str) -> str:
    """The source under a notice, for review."""
    return f"<!-- fail-open chunk={index} reason={json.dumps(problem, ensure_ascii=False)} -->\n> Not translated: {problem}\n\n{text}"


def with_fallback(chunks: DataFrame, translators: tuple[Translator, ...], accept: Accept = filled, sizes: tuple[int, ...] = SPLITS) -> DataFrame:
    """`chunks` (index, text and more) with translated, attempt and problem (K12). Each translator in turn gets the whole
    text, then its parts in shrinking sizes; if none is accepted, the source stays under a notice. Row by row, so a lost
    task does only its own chunks again."""
    columns = [c for c in chunks.columns if c not in ("translated", "attempt", "problem")]

    def one(index: int, text: str) -> tuple[str, str, str | None]:
        problem = None
        for n, translator in enumerate(translators):
            said, found = _said(text, translator, accept)
            if not found:
                return said, f"whole:{n}", None
            problem = problem or found
            said = _in_parts(text, translator, accept, sizes)
            if said:
                return said, f"parts:{n}", None
        return kept_source(index, text, problem or "no translator"), "kept", problem or "no translator"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [one(i, t or "") for i, t in zip(pdf["index"], pdf["text"], strict=True)]
            yield pdf.assign(**{c: [d[k] for d in done] for k, c in enumerate(("translated", "attempt", "problem"))})

    kinds = ", ".join(f"`{c}` {t}" for c, t in chunks.select(*columns).dtypes)
    return chunks.select(*columns).mapInPandas(run, f"{kinds}, translated string, attempt string, problem string")


def salvage(chunks: DataFrame, cache: DataFrame, translators: tuple[Translator, ...], book: str, most: int = 20, accept: Accept = filled, sizes: tuple[int, ...] = SPLITS) -> tuple[DataFrame, DataFrame]:
    """(salvaged, failures): the earliest `most` missing chunks of each book in order, up to its first that no translator
    does (K13). cache: book and index of chunks that are there."""
    gone = chunks.join(cache.select(book, "index").distinct(), [book, "index"], "left_anti")
    early = gone.withColumn("_n", F.row_number().over(Window.partitionBy(book).orderBy("index"))).where(F.col("_n") <= most).drop("_n")
    done = with_fallback(early, translators, accept, sizes)
    stop = F.min(F.when(F.col("attempt") == "kept", F.col("index"))).over(Window.partitionBy(book))
    upto = done.withColumn("_stop", stop)
    return upto.where("_stop is null or index < _stop").drop("_stop", "problem"), upto.where("index = _stop").select(book, "index", "problem")


def rewrite_requests(decisions: DataFrame, segments: DataFrame, terms: DataFrame, translator: Translator) -> DataFrame:
    """Candidates for open rewrite decisions that carry a comment (K07): segment_id, candidate, problem. A candidate that lacks
    the target of a term is asked for once more. decisions: segment_id, action, status, comment; segments: segment_id,
    source_text, translated_text; terms: segment_id, source, target, those that were selected for the segment."""
    asked = decisions.where("action = 'model_rewrite' and status in ('open', 'requested') and trim(comment) <> ''").select("segment_id", F.trim("comment").alias("comment"))
    chosen = terms.join(asked.select("segment_id").distinct(), "segment_id", "left_semi").distinct().groupBy("segment_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("source", "target")))).alias("terms"))
    rows = asked.join(segments.select("segment_id", "source_text", "translated_text"), "segment_id").join(chosen, "segment_id", "left")
    rows = rows.withColumns({"source_text": T.strip(F.coalesce("source_text", F.lit(""))), "translated_text": T.strip(F.coalesce("translated_text", F.lit("")))})

    def one(comment: str, source: str, now: str, given: str | None) -> tuple[str | None, str | None]:
        if not source:
            return None, "empty source"
        wanted = json.loads(given) if isinstance(given, str) else []
        ask = lambda draft, note: translator("\n\n".join(x for x in (source, draft, note) if x))
        draft = ask(now, comment)
        lacks = [t for t in wanted if t["target"] not in draft]
        if lacks:
            draft = ask(draft, comment + "\n" + "; ".join(f"{t['source']} => {t['target']}" for t in lacks))
            lacks = [t for t in wanted if t["target"] not in draft]
        return draft, "missing terms: " + ", ".join(t["source"] for t in lacks) if lacks else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [one(*row) for row in pdf[["comment", "source_text", "translated_text", "terms"]].itertuples(index=False)]
            yield pd.DataFrame({"segment_id": pdf["segment_id"], "candidate": [d[0] for d in done], "problem": [d[1] for d in done]})

    kind = dict(rows.dtypes)["segment_id"]
    return rows.mapInPandas(run, f"segment_id {kind}, candidate string, problem string").withColumn("candidate", T.strip_notice(F.col("candidate")))


def note_cluster(blocks: DataFrame, book: str, marker: Column) -> DataFrame:
    """Blocks with `notes`: whether a block belongs to the cluster of notes at its chapter's end (B11). It begins at the first
    marker in the last 55 % (and not among the first four blocks) that two more follow at least; chapters of fewer
    than six blocks have none. blocks: pos."""
    order = Window.partitionBy(book).orderBy("pos")
    after = order.rowsBetween(0, Window.unboundedFollowing)
    is_marker = F.coalesce(marker, F.lit(False)).cast("int")
    out = blocks.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy(book)), "_m": is_marker})
    out = out.withColumn("_after", F.sum("_m").over(after))
    begins = (F.col("_m") == 1) & (F.col("_n") >= 6) & (F.col("_i") >= F.greatest(F.lit(4), F.floor(F.col("_n") * 45 / 100))) & (F.col("_after") >= 3)
    out = out.withColumn("_start", F.min(F.when(begins, F.col("_i"))).over(Window.partitionBy(book)))
    return out.withColumn("notes", F.coalesce(F.col("_i") >= F.col("_start"), F.lit(False))).drop("_i", "_n", "_m", "_after", "_start")
