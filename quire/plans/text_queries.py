"""Queries of the text, predicate and line operators over `documents`, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import predicates as P
from quire.functions import text as T
from quire.operators import lines as L
from quire.sources import tables as S

LINES = "SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL"
STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
LINE = STRIP.format("line")
RUNNING = "(length(line) <= 90 AND len(regexp_extract_all(line, '[^ \\t\\n\\r]+')) <= 12 AND regexp_matches(line, '[A-Za-z]') AND NOT regexp_matches(line, '^(?:#|!\\[|\\||[-*] |[0-9]+[.)] )'))"
BLOCK_TYPE = f"""CASE WHEN regexp_matches({LINE}, '^#{{1,6}}[ \\t]') THEN 'heading' WHEN regexp_matches({LINE}, '^!\\[[^\\]]*\\]\\([^)]*\\)$') THEN 'image'
  WHEN regexp_matches({LINE}, '^\\|.*\\|$') OR regexp_matches({LINE}, ' \\| .* \\| ') THEN 'table' WHEN regexp_matches({LINE}, '^(?:[-*+]|[0-9]{{1,3}}[.)])[ \\t]') THEN 'list'
  WHEN regexp_matches({LINE}, '^(?:\\[\\^|[0-9]{{1,3}}[ \\t]+[A-Z])') THEN 'footnote' ELSE 'plain' END"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents")


def line_cleanup_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.without_running_text(L.lines(docs(spark, sf_dir), "source"))
    rows = rows.withColumn("gone", F.col("repeated") | P.page_number_like(F.col("line")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.col("gone").cast("long")).alias("dropped"), F.sum(F.when(~F.col("gone"), F.length("line")).otherwise(0)).cast("long").alias("kept_chars"))


def char_class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", T.letters(t).cast("long").alias("letters"), T.cjk(t).cast("long").alias("cjk"), F.regexp_count(t, F.lit("[0-9]")).cast("long").alias("digits"), P.words(t).cast("long").alias("words"),
                                      F.length(t).cast("long").alias("chars"), P.untranslated(t, t).alias("untranslated"), P.incomplete(t, t).alias("incomplete"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.split("text", "\n")[0]
    return docs(spark, sf_dir).select("doc_id", T.content_id("note", F.col("doc_id"), F.col("source"), F.col("text")).alias("content_id"), T.chapter_id(F.col("doc_id") % 1000, title).alias("chapter_id"),
                                      T.fingerprint("v1", F.lit("[]"), F.col("lang"), F.col("text")).alias("fingerprint"), F.sha2("text", 256).alias("text_sha256"))


def whitespace_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.collapse(F.col("text"), book=True).alias("clean")).select("doc_id", F.length("clean").cast("long").alias("chars"), F.md5("clean").alias("digest"))


def term_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.term_key(F.split("text", "\n")[0]).alias("term_key"), T.slug(F.col("text")).alias("slug"))


def block_type_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.lines(docs(spark, sf_dir), "source").withColumn("block_type", P.block_type(F.col("line")))
    return rows.groupBy("source", "block_type").agg(F.count("*").alias("n"), F.sum(F.length("line")).cast("long").alias("chars"))


def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    rows = L.lines(docs(spark, sf_dir)).withColumns({"formula": P.formula_like(line), "note": P.note_line(line), "page_number": P.page_number_like(line), "toc": P.toc_line(line)})
    return rows.groupBy("doc_id").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("formula", "note", "page_number", "toc")])


#: Beginnings of lines that the rules of ocr_reasons catch.
SPOILT = ("", "forMen ", "inTo ", "\u0001\u0002 ", "12:30 4-5 6/7 8. 9 10 ", "$$ ## == ", "-- ,, ;; :: !! ")


def ocr_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoilt = F.element_at(F.array(*(F.lit(x) for x in SPOILT)), (F.col("pos") % len(SPOILT) + 1).cast("int"))
    rows = L.lines(docs(spark, sf_dir)).withColumn("line", F.when(F.col("pos") % 2 == 0, F.concat(spoilt, F.col("line"))).otherwise(F.concat(spoilt, F.substring("line", 1, 20))))
    evidence = F.when(F.col("pos") % 3 == 0, F.upper("line")).when(F.col("pos") % 3 == 1, F.lit("other words"))
    rows = rows.withColumn("reasons", P.ocr_reasons(F.col("line"), evidence=evidence)).withColumn("score", P.ocr_score(F.col("reasons")))
    return rows.withColumn("verdict", P.ocr_verdict(F.col("score"))).groupBy("verdict").agg(F.count("*").alias("n"), F.sum("score").cast("long").alias("total_score"), F.sum(F.size("reasons")).cast("long").alias("reasons"))


def running_text_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.without_running_text(L.lines(docs(spark, sf_dir)))
    return rows.where("repeated").groupBy("doc_id").agg(F.count("*").alias("removed"), F.sum(F.length("line")).cast("long").alias("removed_chars"))


def note_line_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.lines(docs(spark, sf_dir)).where(T.strip(F.col("line")) != "")
    out = rows.groupBy("doc_id").agg(F.sum(P.note_line(F.col("line")).cast("long")).alias("notes"), F.count("*").alias("lines"))
    return out.withColumn("footnote_heavy", F.col("notes") * 100 > F.col("lines") * 18)


def reflow_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reflowed(L.lines(docs(spark, sf_dir))).groupBy("doc_id").agg(F.count("*").alias("lines"), (F.max("paragraph") + 1).cast("long").alias("paragraphs"))


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.chunks(docs(spark, sf_dir), 300).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("chars").cast("long").alias("size"), F.md5("text").alias("digest"))


def chunk_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumn("c", L.chunk_sizes(F.split("text", "\n"), 1200))
    return d.groupBy("source").agg(F.count("*").alias("chapters"), F.sum(F.length("text")).cast("long").alias("chars"), F.sum(F.size("c")).cast("long").alias("chunks"), F.max(F.size("c")).cast("long").alias("most"))


def segment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.segment_plan(docs(spark, sf_dir), 800).groupBy("doc_id").agg(F.count("*").alias("segments"), F.max("segment_id").alias("last_id"), F.sum("parts").cast("long").alias("lines"))


def ingest_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.defects(docs(spark, sf_dir)).groupBy("defect").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), F.max(F.col("blocking").cast("int")).alias("blocking"))


def chapter_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = docs(spark, sf_dir).select("doc_id", F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x in ("Preface", "Chapter One", "List of Maps", "Index of names", "Further Reading", "Notes on dates", "Annex")]), (F.col("doc_id") % 7 + 1).cast("int")), F.split("text", "\n")[0]).alias("title"),
                                      F.when(F.col("doc_id") % 2 == 0, "body").otherwise("references").alias("majority"))
    kinds = titles.withColumn("kind", P.chapter_kind(F.col("title"), F.col("majority")))
    return kinds.withColumn("translate", P.translatable(F.col("kind"), F.lit(None).cast("boolean"), F.lit(False), F.lit(False))).groupBy("kind", "translate").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def chapter_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.lines(docs(spark, sf_dir)).withColumn("line", F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Chapter 3 ", "Part IV ", "12. A", "IX. B", "CHAPTER XI", "")]), (F.col("pos") % 6 + 1).cast("int")), "line"))
    return rows.withColumn("c", (P.chapter_line(F.col("line")) * 100).cast("int")).groupBy("c").agg(F.count("*").alias("n")).select(F.coalesce("c", F.lit(-1)).alias("confidence_pct"), "n")


def input_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "book").when(F.col("doc_id") % 3 == 1, "magazine").otherwise("auto").alias("profile"), (F.col("doc_id") % 2000).alias("pages"), (F.length("text").cast("long") * 40000).alias("bytes"), F.length("text").alias("chars"), (F.col("doc_id") % 900).alias("images"))
    return S.input_gate(made).select("doc_id", F.coalesce("gate_reason", F.lit("ok")).alias("gate"), "gate_ok", "warn")


def bounded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 5 documents of each source: a report of bounded size."""
    top = Window.partitionBy("source").orderBy("doc_id")
    return docs(spark, sf_dir).withColumn("n", F.row_number().over(top)).where("n <= 5").groupBy("source").agg(T.page_ranges(F.collect_list("doc_id")).alias("ranges"), F.concat_ws(",", F.array_sort(F.collect_list("doc_id"))).alias("ids"))


def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each text (B04, I07): the smallest id, pre-aggregated by hash, so copies meet as one row."""
    return docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("content")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def duplicate_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first earlier match: same content, else same normalised title."""
    keyed = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("content"), F.md5(T.collapse(F.split("text", "\n")[0])).alias("title"))
    same = keyed.groupBy("content").agg(F.min("doc_id").alias("first_content"))
    titled = keyed.groupBy("title").agg(F.min("doc_id").alias("first_title"))
    out = keyed.join(same, "content").join(titled, "title")
    return out.select("doc_id", F.when(F.col("first_content") < F.col("doc_id"), F.col("first_content")).when(F.col("first_title") < F.col("doc_id"), F.col("first_title")).alias("match"),
                      F.when(F.col("first_content") < F.col("doc_id"), "content").when(F.col("first_title") < F.col("doc_id"), "title").alias("reason")).where("reason is not null")


def profile_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword presence by profile and source, and the winning profile (G17's shape, on words of the data)."""
    keys = {"humanities": ("thinal", "hist", "war"), "social": ("mark", "tion", "thstand"), "science": ("theor", "tabl", "enorm")}
    t = F.lower("text")
    hits = docs(spark, sf_dir).select("source", *[sum(t.contains(w).cast("long") for w in ws).alias(k) for k, ws in keys.items()])
    out = hits.groupBy("source").agg(*[F.sum(k).alias(k) for k in keys])
    ranked = F.array_sort(F.array(*[F.struct((-F.col(k)).alias("s"), F.lit(k).alias("k")) for k in keys]))
    return out.withColumn("_r", ranked).select("source", *keys, F.col("_r")[0]["k"].alias("profile"), (F.col("_r")[1]["s"] - F.col("_r")[0]["s"]).alias("margin"))


def grouping_sets_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass counts by language, by source and over all."""
    joined = docs(spark, sf_dir).join(S.table(spark, sf_dir, "labels"), "doc_id").select("lang", "source", "quality")
    return joined.cube("lang", "source").agg(F.count("*").alias("cases"), F.sum("quality").cast("long").alias("passed"), F.grouping_id().cast("long").alias("level")).where("level <> 0").select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "cases", "passed", "level")


def storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and two-way orphans of documents and labels."""
    a, b = docs(spark, sf_dir).select("doc_id", F.octet_length("text").alias("bytes")), S.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"))
    both = a.join(b, a.doc_id == b.label_id, "full_outer")
    return both.agg(F.count("doc_id").alias("books"), F.sum("bytes").cast("long").alias("bytes"), F.sum(F.col("label_id").isNull().cast("long")).alias("unlabelled"), F.sum(F.col("doc_id").isNull().cast("long")).alias("orphans"))


def decision_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as decisions: approved text replaces the text, rejected and open ones keep it."""
    joined = docs(spark, sf_dir).join(S.table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "open").when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("resolved")
    shown = F.when(F.col("status").isin("approved", "resolved"), F.concat(F.lit("approved: "), "text")).otherwise(F.col("text"))
    return joined.withColumn("status", status).select("doc_id", "status", F.md5(shown).alias("shown"))


def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark (F08's lookup): 8-word shingles join by hash, then the
    count of shared shingles decides; no text meets every passage."""
    def shingles(df: DataFrame, key: str) -> DataFrame:
        w = F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda x: x != "")
        grams = F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.md5(F.array_join(F.slice("w", i, 8), " ")))
        return df.select(key, w.alias("w")).where(F.size("w") >= 8).select(key, F.explode(F.array_distinct(grams)).alias("g"))

    hits = shingles(docs(spark, sf_dir), "doc_id").join(shingles(S.table(spark, sf_dir, "benchmark"), "item_id"), "g")
    return hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


QUERIES = {f.__name__: f for f in (line_cleanup_rollup, char_class_profile, stable_ids, whitespace_normalised, term_keys, block_type_hist, noise_filter, ocr_assessment, running_text_removed, note_line_ratio, reflow_islands, chunk_pack, chunk_estimates,
                                   segment_plan, ingest_defects, chapter_kinds, chapter_line_scan, input_gate, bounded_samples, dedupe_keep_first, duplicate_match, profile_keywords, grouping_sets_report, storage_stats, decision_overlay, benchmark_containment)}

CTRL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"
SLUG = "substr(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 56)"
COLLAPSE = "trim(regexp_replace(regexp_replace({}, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ([,.;:!?''])', '\\1', 'g'), ' ' || chr(9) || chr(10) || chr(13))"
PACK = """WITH RECURSIVE l AS (SELECT doc_id, source, length(text) AS chars, list_transform(string_split(text, chr(10)), lambda x: length(x) + 2) AS costs FROM documents),
 w AS (SELECT doc_id, 1 AS i, 0 AS chunk, costs[1] AS size, 1 AS parts, costs FROM l
   UNION ALL SELECT doc_id, i + 1, CASE WHEN size + costs[i + 1] > {0} THEN chunk + 1 ELSE chunk END, CASE WHEN size + costs[i + 1] > {0} THEN costs[i + 1] ELSE size + costs[i + 1] END, CASE WHEN size + costs[i + 1] > {0} THEN 1 ELSE parts + 1 END, costs FROM w WHERE i < len(costs)),
 packed AS (SELECT doc_id, chunk, max(size) AS size, max(parts) AS parts FROM w GROUP BY ALL) """
#: Chunks by the rule itself: blocks between blank lines outside fences, filled in order; a block that is too long and meets no open
#: chunk goes by its sentences, or by its lines if it is one sentence.
CHUNKS = r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
 f AS (SELECT *, starts_with(trim(line, E' \t\r'), '```') AS mark, sum(starts_with(trim(line, E' \t\r'), '```')::int) OVER (PARTITION BY doc_id ORDER BY pos) AS marks FROM l),
 b AS (SELECT *, NOT mark AND marks % 2 = 0 AND trim(line, E' \t\r') = '' AS blank FROM f), i AS (SELECT *, sum(blank::int) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM b),
 blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS k, t, length(t) + 2 AS cost FROM (SELECT doc_id, island, trim(string_agg(line, chr(10) ORDER BY pos), E' \t\r\n') AS t FROM i WHERE NOT blank GROUP BY ALL)),
 units0 AS (SELECT *, list_filter(list_transform(regexp_extract_all(t, '(?s).+?(?:[.!?。！？]+["''”’)]*(?:\s+|$)|$)'), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') AS s FROM blocks WHERE cost > {0}),
 units AS (SELECT doc_id, k, CASE WHEN (starts_with(t, '```') AND ends_with(t, '```')) OR regexp_full_match(t, '(?s)!\[[^\]]*\]\([^)]+\)') THEN [t] WHEN len(s) = 1 AND contains(t, chr(10)) THEN list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, E' \t\r')), lambda x: x <> '') ELSE s END AS s FROM units0),
 cut AS (SELECT doc_id, k, s, 1 AS n, s[1] AS held, []::varchar[] AS done FROM units UNION ALL SELECT doc_id, k, s, n + 1, CASE WHEN length(held) + 1 + length(s[n + 1]) > {0} THEN s[n + 1] ELSE held || ' ' || s[n + 1] END, CASE WHEN length(held) + 1 + length(s[n + 1]) > {0} THEN list_append(done, held) ELSE done END FROM cut WHERE n < len(s)),
 parts AS (SELECT doc_id, k, list_append(done, held) AS parts FROM cut WHERE n = len(s)),
 step AS (SELECT doc_id, 0 AS k, 0 AS size, []::varchar[] AS held, []::varchar[] AS flushed FROM (SELECT DISTINCT doc_id FROM blocks)
   UNION ALL SELECT p.doc_id, b.k, CASE WHEN len(p.held) = 0 AND b.cost > {0} THEN 0 WHEN len(p.held) > 0 AND p.size + b.cost > {0} THEN b.cost ELSE p.size + b.cost END,
    CASE WHEN len(p.held) = 0 AND b.cost > {0} THEN [] WHEN len(p.held) > 0 AND p.size + b.cost > {0} THEN [b.t] ELSE list_append(p.held, b.t) END,
    CASE WHEN len(p.held) = 0 AND b.cost > {0} THEN parts.parts WHEN len(p.held) > 0 AND p.size + b.cost > {0} THEN [array_to_string(p.held, chr(10) || chr(10))] ELSE [] END
   FROM step p JOIN blocks b ON b.doc_id = p.doc_id AND b.k = p.k + 1 LEFT JOIN parts ON parts.doc_id = b.doc_id AND parts.k = b.k),
 ends AS (SELECT doc_id, k, unnest(flushed) AS t, generate_subscripts(flushed, 1) AS j FROM step UNION ALL SELECT doc_id, k + 1, array_to_string(held, chr(10) || chr(10)), 1 FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1) WHERE len(held) > 0),
 numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS chunk, t FROM ends)"""
REPEATED = f"""l AS ({LINES}), s AS (SELECT doc_id, lower({LINE}) AS k, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT l.*, n >= 3 AND {RUNNING} AS repeated FROM l JOIN s ON s.doc_id = l.doc_id AND s.k = lower({LINE}))"""
HINTS = " ".join(f"WHEN contains(lower(title), '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for p, k in P.TITLE_HINTS)
DEFECT_SQL = " UNION ALL ".join(f"SELECT '{k}' AS defect, {int(k in L.BLOCKING)} AS blocking, len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS n FROM documents" for k, p in L.DEFECTS.items())

SPOILT_SQL = "([" + ", ".join(f"'{x}'" for x in SPOILT) + "])"

ORACLES = {
    "line_cleanup_rollup": f"WITH {REPEATED}, g AS (SELECT *, repeated OR regexp_matches({LINE}, '^(?:[0-9]+|[ivxlcdmIVXLCDM]+)$') AS gone FROM r) SELECT doc_id, count(*) AS lines, sum(gone::int)::bigint AS dropped, sum(CASE WHEN gone THEN 0 ELSE length(line) END)::bigint AS kept_chars FROM g GROUP BY doc_id",
    "char_class_profile": """WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS letters, len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}]')) AS cjk, len(regexp_extract_all(text, '[0-9]')) AS digits, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS words, length(text) AS chars FROM documents)
  SELECT *, CASE WHEN letters < 300 THEN false WHEN cjk < 80 AND letters > 250 THEN true WHEN chars < 1000 AND cjk >= 160 THEN false WHEN cjk >= 1000 THEN false ELSE letters / greatest(letters + cjk, 1) > 0.72 END AS untranslated, chars >= 1200 AND cjk + floor(letters * 35 / 100) < 0.18 * chars AS incomplete FROM c""",
    "stable_ids": f"""SELECT doc_id, 'note-' || substr(sha256(concat_ws(chr(31), 'note', doc_id::varchar, source, text)), 1, 20) AS content_id, 'ch-' || lpad((doc_id % 1000)::varchar, 3, '0') || '-' || {SLUG.format("string_split(text, chr(10))[1]")} AS chapter_id, substr(sha256(concat_ws(chr(10), 'v1', '[]', lang, text)), 1, 16) AS fingerprint, sha256(text) AS text_sha256 FROM documents""",
    "whitespace_normalised": f"""WITH c AS (SELECT doc_id, {COLLAPSE.format(f"regexp_replace(text, '{CTRL}', ' ', 'g')")} AS clean FROM documents) SELECT doc_id, length(clean) AS chars, md5(clean) AS digest FROM c""",
    "term_keys": f"""SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(translate(string_split(text, chr(10))[1], '‘’“”', '''''""'), '([a-z])([A-Z0-9])', '\\1 \\2', 'g'), '[ \\t\\n]+', ' ', 'g'), '[.,;:!?]+$', ''), ' ' || chr(9) || chr(10) || chr(13))) AS term_key, {SLUG.format("text")} AS slug FROM documents""",
    "block_type_hist": f"WITH l AS ({LINES}) SELECT source, {BLOCK_TYPE} AS block_type, count(*) AS n, sum(length(line))::bigint AS chars FROM l GROUP BY ALL",
    "noise_filter": f"""WITH l AS ({LINES}), f AS (SELECT doc_id, line, {LINE} AS s FROM l), g AS (SELECT *, len(regexp_extract_all(s, '[=+*/^_<>|]')) AS sy, len(regexp_extract_all(s, '[A-Za-z0-9]')) AS al FROM f)
  SELECT doc_id, sum(((length(s) <= 1 AND sy > 0) OR (length(s) <= 12 AND sy > 0 AND NOT regexp_matches(s, '[A-Za-z]{{2}}')) OR (length(s) <= 24 AND sy >= greatest(2, al)))::int)::bigint AS formula, sum(regexp_matches(line, '^(?:[0-9]+|\\*|†|‡)[ \\t]+')::int)::bigint AS note,
  sum(regexp_matches(s, '^(?:[0-9]+|[ivxlcdmIVXLCDM]+)$')::int)::bigint AS page_number, sum(regexp_matches(s, '\\.{{2,}}[ \\t]*[0-9]+$|^[0-9]+[ \\t]+[A-Z].*[0-9]+$')::int)::bigint AS toc FROM g GROUP BY doc_id""",
    "ocr_assessment": f"""WITH l0 AS ({LINES}), l AS (SELECT pos, {SPOILT_SQL}[pos % {len(SPOILT)} + 1] || CASE WHEN pos % 2 = 0 THEN line ELSE substring(line, 1, 20) END AS line FROM l0),
  e AS (SELECT pos, line, list_distinct(regexp_extract_all(lower(line), '[\\pL\\pM\\p{{Nd}}_]+')) AS mine, CASE pos % 3 WHEN 0 THEN list_distinct(regexp_extract_all(lower(upper(line)), '[\\pL\\pM\\p{{Nd}}_]+')) WHEN 1 THEN ['other', 'words'] END AS theirs FROM l),
  f AS (SELECT mine, theirs, line, greatest(length(line), 1) AS n, list_filter(regexp_split_to_array(line, '[\\s\\x0b\\x85\\pZ]+'), lambda x: x <> '') AS tok FROM e),
  h AS (SELECT len(regexp_extract_all(line, '{CTRL}')) / n >= 0.02 AS a, (len(regexp_extract_all(line, '[^\\pL\\pN\\pZ\\s\\x0b''’.,;:!?–—()\\[\\]-]')) / n >= 0.06 OR len(regexp_extract_all(line, '[^\\pL\\pN\\pZ\\s\\x0b]')) / n >= 0.20) AS b,
    len(tok) > 0 AND len(list_filter(tok, lambda x: regexp_matches(x, '^[\\p{{Nd}}:/.-]{{1,8}}$'))) / greatest(len(tok), 1) >= 0.45 AS c, regexp_matches(line, '\\b(?:of|and|the|in|to|for)[A-Z][a-z]{{2,}}') AS d, theirs IS NOT NULL AND len(list_distinct(mine || theirs)) > 0 AND len(list_intersect(mine, theirs)) / greatest(len(list_distinct(mine || theirs)), 1) < 0.25 AS g FROM f),
  s AS (SELECT a::int + b::int + c::int + d::int + g::int AS k, least(100, 65 * a::int + 25 * b::int + 40 * c::int + 55 * d::int + 45 * g::int) AS score FROM h)
  SELECT CASE WHEN score >= 82 THEN 'suspect_ocr' WHEN score >= 55 THEN 'review' ELSE 'reading' END AS verdict, count(*) AS n, sum(score)::bigint AS total_score, sum(k)::bigint AS reasons FROM s GROUP BY 1""",
    "running_text_removed": f"WITH {REPEATED} SELECT doc_id, count(*) AS removed, sum(length(line))::bigint AS removed_chars FROM r WHERE repeated GROUP BY doc_id",
    "note_line_ratio": f"WITH l AS ({LINES}), g AS (SELECT doc_id, sum(regexp_matches(line, '^(?:[0-9]+|\\*|†|‡)[ \\t]+')::int)::bigint AS notes, count(*) AS lines FROM l WHERE {LINE} <> '' GROUP BY doc_id) SELECT *, notes * 100 > lines * 18 AS footnote_heavy FROM g",
    "reflow_islands": f"""WITH l AS ({LINES}), t AS (SELECT doc_id, pos, {LINE} AS s, {BLOCK_TYPE} AS kind FROM l), b AS (SELECT *, lag(s) OVER w AS before, lag(kind) OVER w AS before_kind FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  j AS (SELECT *, before IS NOT NULL AND before_kind = 'plain' AND kind = 'plain' AND NOT regexp_matches(before, '[.!?:][''")]*$') AND regexp_matches(s, '^[a-z]') AS joins FROM b) SELECT doc_id, count(*) AS lines, sum((NOT joins)::int)::bigint AS paragraphs FROM j GROUP BY doc_id""",
    "chunk_pack": CHUNKS.format(300) + " SELECT doc_id, chunk, length(t) AS size, md5(t) AS digest FROM numbered",
    "chunk_estimates": PACK.format(1200) + ", n AS (SELECT doc_id, count(*) AS c FROM packed GROUP BY 1) SELECT source, count(*) AS chapters, sum(chars)::bigint AS chars, sum(c)::bigint AS chunks, max(c) AS most FROM l JOIN n USING (doc_id) GROUP BY source",
    "segment_plan": PACK.format(800) + "SELECT doc_id, count(*) AS segments, doc_id::varchar || ':seg' || lpad(count(*)::varchar, 4, '0') AS last_id, sum(parts)::bigint AS lines FROM packed GROUP BY doc_id",
    "ingest_defects": f"SELECT defect, sum(n)::bigint AS n, count(*) AS docs, max(blocking) AS blocking FROM ({DEFECT_SQL}) WHERE n > 0 GROUP BY defect",
    "chapter_kinds": f"""WITH t AS (SELECT doc_id, (['Preface','Chapter One','List of Maps','Index of names','Further Reading','Notes on dates','Annex'])[(doc_id % 7 + 1)::int] || ' ' || string_split(text, chr(10))[1] AS title, CASE WHEN doc_id % 2 = 0 THEN 'narrative' ELSE 'bibliography' END AS byp FROM documents), k AS (SELECT doc_id, CASE {HINTS} ELSE byp END AS kind FROM t)
  SELECT kind, kind NOT IN ('cover','toc','apparatus','bibliography','index','appendix') AS translate, count(*) AS n, sum(doc_id)::bigint AS ids FROM k GROUP BY ALL""",
    "chapter_line_scan": f"""WITH l AS ({LINES}), m AS (SELECT (['Chapter 3 ','Part IV ','12. A','IX. B','CHAPTER XI',''])[(pos % 6 + 1)::int] || line AS line FROM l), s AS (SELECT {LINE} AS s FROM m),
  c AS (SELECT CASE WHEN length(s) > 100 THEN -1 WHEN regexp_matches(s, '^(?i:chapter)[ \\t]+[0-9]+') THEN 90 WHEN regexp_matches(s, '^(?i:chapter)[ \\t]+[IVXLCDM]+') THEN 90 WHEN regexp_matches(s, '^(?i:part)[ \\t]+(?:[0-9]+|[IVXLCDM]+)') THEN 85 WHEN regexp_matches(s, '^[0-9]{{1,2}}[.][ \\t]+[A-Z]') THEN 80 WHEN regexp_matches(s, '^[IVXLCDM]+[.][ \\t]+[A-Z]') THEN 70 WHEN regexp_matches(s, '^[A-Z][A-Z ]{{4,60}}$') THEN 50 ELSE -1 END AS confidence_pct FROM s) SELECT confidence_pct, count(*) AS n FROM c GROUP BY 1""",
    "input_gate": """WITH m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'book' WHEN 1 THEN 'magazine' ELSE 'auto' END AS profile, doc_id % 2000 AS pages, length(text) * 40000 / 1048576.0 AS mb, length(text) AS chars, doc_id % 900 AS images FROM documents), g AS (SELECT * FROM (VALUES ('auto', 160, 320, 40.0, 80.0), ('magazine', 140, 220, 50.0, 100.0), ('book', 800, 1500, 60.0, 120.0)) v(profile, wp, mp, wm, mm)),
  r AS (SELECT doc_id, CASE WHEN pages > mp THEN 'too_many_pages' WHEN mb > mm THEN 'too_large' WHEN chars < greatest(400, 30 * pages) AND images >= greatest(12, pages) THEN 'image_only' END AS reason, pages > least(wp, 0.8 * mp) OR mb > least(wm, mm) AS warn FROM m JOIN g USING (profile)) SELECT doc_id, coalesce(reason, 'ok') AS gate, reason IS NULL AS gate_ok, warn FROM r""",
    "bounded_samples": """WITH t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents QUALIFY n <= 5), i AS (SELECT *, doc_id - n AS island FROM t), r AS (SELECT source, min(doc_id) AS a, max(doc_id) AS b FROM i GROUP BY source, island)
  SELECT source, string_agg(CASE WHEN a = b THEN a::varchar ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges, (SELECT string_agg(doc_id::varchar, ',' ORDER BY doc_id) FROM t WHERE t.source = r.source) AS ids FROM r GROUP BY source""",
    "dedupe_keep_first": "SELECT sha256(text) AS content, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "duplicate_match": f"""WITH k AS (SELECT doc_id, sha256(text) AS c, md5({COLLAPSE.format("string_split(text, chr(10))[1]")}) AS t FROM documents), m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS fc, min(doc_id) OVER (PARTITION BY t) AS ft FROM k) SELECT doc_id, CASE WHEN fc < doc_id THEN fc ELSE ft END AS match, CASE WHEN fc < doc_id THEN 'content' ELSE 'title' END AS reason FROM m WHERE fc < doc_id OR ft < doc_id""",
    "profile_keywords": """WITH h AS (SELECT source, sum(contains(lower(text), 'thinal')::int + contains(lower(text), 'hist')::int + contains(lower(text), 'war')::int)::bigint AS humanities, sum(contains(lower(text), 'mark')::int + contains(lower(text), 'tion')::int + contains(lower(text), 'thstand')::int)::bigint AS social, sum(contains(lower(text), 'theor')::int + contains(lower(text), 'tabl')::int + contains(lower(text), 'enorm')::int)::bigint AS science FROM documents GROUP BY source),
  r AS (SELECT *, list_sort([{'s': -humanities, 'k': 'humanities'}, {'s': -social, 'k': 'social'}, {'s': -science, 'k': 'science'}]) AS x FROM h) SELECT source, humanities, social, science, x[1].k AS profile, x[2].s - x[1].s AS margin FROM r""",
    "grouping_sets_report": "SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS cases, sum(quality)::bigint AS passed, grouping(lang, source)::bigint AS level FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())",
    "storage_stats": "SELECT count(d.doc_id) AS books, sum(strlen(text))::bigint AS bytes, sum((l.doc_id IS NULL)::int)::bigint AS unlabelled, sum((d.doc_id IS NULL)::int)::bigint AS orphans FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
    "decision_overlay": "WITH s AS (SELECT d.doc_id, text, CASE WHEN quality IS NULL THEN 'open' WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'resolved' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, status, md5(CASE WHEN status IN ('approved', 'resolved') THEN 'approved: ' || text ELSE text END) AS shown FROM s",
    "benchmark_containment": """WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM benchmark),
  sg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM s WHERE len(w) >= 8)), bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8)) SELECT doc_id, item_id, count(*) AS shared FROM sg JOIN bg USING (g) GROUP BY ALL""",
}
