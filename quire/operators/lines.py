"""Blocks and lines: splitting, packing, repeated-line removal, reflow."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import predicates as P
from quire.functions.text import strip


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, pos (from 0) and line of every text."""
    return docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def blocks(docs: DataFrame, *keep: str) -> DataFrame:
    """Blocks parted by blank lines, but not by those inside ``` fences: a running fence parity, then islands."""
    rows = lines(docs, *keep)
    order = Window.partitionBy("doc_id").orderBy("pos")
    fence = strip(F.col("line")).startswith("```")
    inside = (F.sum(fence.cast("int")).over(order) - fence.cast("int")) % 2 == 1
    rows = rows.withColumn("_blank", (strip(F.col("line")) == "") & ~inside & ~fence)
    rows = rows.withColumn("block", F.sum(F.col("_blank").cast("int")).over(order)).where(~F.col("_blank"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id", *keep, "block").agg(F.min("pos").alias("pos"), text.alias("text"))


def chunk_sizes(parts: Column, most: int, joint: int = 2) -> Column:
    """Greedy filling of ordered parts: an array of (size, parts) of each chunk; a part costs its length plus the
    joint, and a part that is too long begins a chunk of its own (E03 without cutting of parts)."""
    zero = F.expr("array(struct(0 as size, 0 as parts))")

    def put(acc: Column, part: Column) -> Column:
        last, cost = F.element_at(acc, -1), F.length(part) + joint
        grown = F.struct((last["size"] + cost).alias("size"), (last["parts"] + 1).alias("parts"))
        new = F.struct(cost.alias("size"), F.lit(1).alias("parts"))
        return F.when((last["parts"] > 0) & (last["size"] + cost > most), F.concat(acc, F.array(new))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown)))

    return F.filter(F.aggregate(parts, zero, put), lambda c: c["parts"] > 0)


#: A sentence: up to its closing marks and quotes, or to the end.
SENTENCE = re.compile(r"""(?s).+?(?:[.!?。！？]+["'”’)]*(?:\s+|$)|$)""")
IMAGE = re.compile(r"(?s)!\[[^\]]*]\([^)]+\)")


def fenced_blocks(text: str) -> Iterator[str]:
    """Blocks parted by blank lines, but not by those inside ``` fences."""
    held, fenced = [], False
    for line in text.splitlines():
        mark = line.strip().startswith("```")
        fenced ^= mark
        if line.strip() or fenced or mark:
            held.append(line)
        elif held:
            yield "\n".join(held).strip()
            held = []
    if held:
        yield "\n".join(held).strip()


def whole_block(block: str) -> bool:
    """Fences, images and tables are never cut."""
    rows = [r for r in map(str.strip, block.splitlines()) if r]
    table = len(rows) > 1 and all(r[0] == r[-1] == "|" for r in rows)
    return table or (block.startswith("```") and block.endswith("```")) or bool(IMAGE.fullmatch(block))


def cut_block(block: str, most: int) -> Iterator[str]:
    """A block by its sentences (where it is only one, by its lines), joined by a blank while they fit in `most`."""
    if whole_block(block):
        yield block
        return
    units = [u for u in (m.group().strip() for m in SENTENCE.finditer(block)) if u]
    if len(units) == 1 and "\n" in block:
        units = [u for u in map(str.strip, block.splitlines()) if u]
    held = ""
    for unit in units:
        if held and len(held) + 1 + len(unit) > most:
            yield held
            held = unit
        else:
            held = f"{held} {unit}" if held else unit
    if held:
        yield held


def chunk_texts(text: str | None, most: int) -> Iterator[str]:
    """Blocks filled in order into chunks of at most `most` characters, each block counted with its blank line. A block that
    alone is too long is cut if no chunk is open, else it is a chunk of its own (E03)."""
    held, size = [], 0
    for block in fenced_blocks(text or ""):
        cost = len(block) + 2
        if held and size + cost > most:
            yield "\n\n".join(held)
            held, size = [], 0
        elif not held and cost > most:
            yield from cut_block(block, most)
            continue
        held.append(block)
        size += cost
    if held:
        yield "\n\n".join(held)


def chunks(docs: DataFrame, most: int = 5000) -> DataFrame:
    """doc_id, chunk (dense from 0), text, chars of every document (E03, E15). The filling depends on all blocks before, so it runs over
    Arrow batches, document by document: linear in the text, no shuffle, one chunk in memory beside its document."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                texts = list(chunk_texts(batch["text"][at].as_py(), most))
                if texts:
                    ids = batch["doc_id"].take(pa.array([at] * len(texts)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "chunk", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, chunk int, text string").withColumn("chars", F.length("text"))


def without_running_text(rows: DataFrame, least: int = 3) -> DataFrame:
    """kept and repeated flags of lines: a short line seen `least` times in its document goes (G03). The counts
    are aggregated before they are joined, so one frequent line is no task's load."""
    key = F.lower(strip(F.col("line")))
    seen = rows.groupBy("doc_id", key.alias("_key")).agg(F.count("*").alias("_n"))
    out = rows.withColumn("_key", key).join(seen, ["doc_id", "_key"])
    return out.withColumn("repeated", (F.col("_n") >= least) & P.running_text_like(F.col("line"))).drop("_key", "_n")


def reflowed(rows: DataFrame) -> DataFrame:
    """Paragraph number of each line: a plain line continues the previous plain one unless that ends a sentence
    or this begins like a new paragraph (H05)."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    before, line = F.lag(strip(F.col("line"))).over(order), strip(F.col("line"))
    joins = before.isNotNull() & (P.block_type(before) == "plain") & (P.block_type(line) == "plain") & ~before.rlike(r"[.!?:]['\")]*$") & line.rlike("^[a-z]")
    return rows.withColumn("paragraph", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(order) - 1)


#: Patterns of extraction defects; the last four block an import.
DEFECTS = {"orphan_footnote_y": r"(?m)\. y\.|^[ \t]*y\.[ \t]*$", "midword_space": r"(?:^|[^A-Za-z'])[b-hj-z] [a-z]{3,}", "glued_words": r"formalsystems",
           "replacement_character": "�", "soft_hyphen": "­", "hyphenated_line_break": r"[A-Za-z]-[ \t]*\n[ \t]*[A-Za-z]", "control_character": r"[\x00-\x08\x0B\x0C\x0E-\x1F]"}
BLOCKING = ("replacement_character", "soft_hyphen", "hyphenated_line_break", "control_character")


def defects(docs: DataFrame) -> DataFrame:
    """doc_id, defect, n, blocking of every defect that occurs."""
    counts = F.array(*[F.struct(F.lit(k).alias("defect"), F.regexp_count("text", F.lit(p)).cast("long").alias("n"), F.lit(k in BLOCKING).alias("blocking")) for k, p in DEFECTS.items()])
    return docs.select("doc_id", F.inline(counts)).where("n > 0")


def defect_evidence(docs: DataFrame, defect: str, most: int = 100) -> DataFrame:
    """Line number, nearest heading before and excerpt of a defect's lines, `most` a document."""
    rows = lines(docs)
    order = Window.partitionBy("doc_id").orderBy("pos")
    heading = F.last(F.when(F.col("line").rlike(r"^#{1,6} "), F.col("line")), ignorenulls=True).over(order)
    hit = rows.withColumn("heading", heading).where(F.col("line").rlike(DEFECTS[defect]))
    at = F.regexp_instr("line", F.lit(DEFECTS[defect]))
    return hit.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("doc_id", "pos", "heading", F.expr("1").alias("_x"), at.alias("at"), "line").select(
        "doc_id", "pos", "heading", F.substring("line", F.greatest(F.col("at") - 48, F.lit(1)), F.lit(97)).alias("excerpt"))


def segment_plan(docs: DataFrame, most: int = 5000) -> DataFrame:
    """Segments of each document: sections break at headings of level 2 and deeper, sections are packed, and
    segments are numbered `doc:seg0001` with a role (E04)."""
    rows = lines(docs)
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("section", F.sum(F.col("line").rlike(r"^#{2,6} ").cast("int")).over(order))
    parts = rows.groupBy("doc_id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("_p"))
    cut = parts.select("doc_id", "section", F.posexplode(chunk_sizes(F.col("_p"), most)).alias("piece", "_c"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "piece"))
    return cut.withColumn("segment_index", number).select("doc_id", "segment_index", F.concat_ws(":", "doc_id", F.concat(F.lit("seg"), F.lpad(F.col("segment_index").cast("string"), 4, "0"))).alias("segment_id"), "section", F.col("_c.size").alias("chars"), F.col("_c.parts").alias("parts"))


def footnotes(docs: DataFrame) -> DataFrame:
    """doc_id, marker, body of note lines, first of each marker."""
    rows = lines(docs).where(P.note_line(F.col("line")))
    rows = rows.select("doc_id", "pos", F.regexp_extract("line", r"^([0-9]+|\*|†|‡)[ \t]+(.*)$", 1).alias("marker"), F.regexp_extract("line", r"^([0-9]+|\*|†|‡)[ \t]+(.*)$", 2).alias("body"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "marker").orderBy("pos"))).where("_n = 1").drop("_n", "pos")


def spans(c: Column) -> Column:
    """Prose and citation parts of a note; their concatenation is the note."""
    at = F.regexp_instr(c, F.lit(r"(?:See |Cf\. |Ibid\.|pp?\. [0-9])"))
    return F.when(at <= 1, F.array(F.struct(F.when(at == 1, F.lit("citation")).otherwise(F.lit("prose")).alias("kind"), c.alias("text")))).otherwise(
        F.array(F.struct(F.lit("prose").alias("kind"), F.substring(c, F.lit(1), at - 1).alias("text")), F.struct(F.lit("citation").alias("kind"), F.substring(c, at, F.length(c)).alias("text"))))
