"""Queries of the text rewrites and line predicates that clean a book's text (families C, D, E), each with its SQL.

The lines of `documents` get fixed prefixes and suffixes in turn, so that every rule meets texts that it changes; a document's
result is the digest of all its rewritten lines in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.functions import text as T
from quire.operators import lines as L
from quire.operators import rewrite as R
from quire.sources import tables as S


def decorated(spark: SparkSession, sf_dir: str, before: tuple[str, ...], after: tuple[str, ...]) -> DataFrame:
    """doc_id, pos, line: prefixes and suffixes follow each other from line to line."""
    def pick(values: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.col("pos") % len(values) + 1).cast("int"))

    rows = L.lines(S.table(spark, sf_dir, "documents"))
    return rows.withColumn("line", F.concat(pick(before), F.col("line"), pick(after)))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def decorated_sql(before: tuple[str, ...], after: tuple[str, ...]) -> str:
    def pick(values: tuple[str, ...]) -> str:
        return f"([{', '.join(map(quoted, values))}])[pos % {len(values)} + 1]"

    return (f"d AS (SELECT doc_id, pos, {pick(before)} || line || {pick(after)} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, "
            "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL))")


def digest(rows: DataFrame, value: Column) -> DataFrame:
    """doc_id and the MD5 of the values of its lines, in order."""
    made = rows.select("doc_id", F.struct("pos", value.alias("x")).alias("s")).groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return made.select("doc_id", F.md5(F.array_join(F.transform("s", lambda s: s["x"]), "\n")).alias("digest"))


def digest_sql(value: str, source: str = "d") -> str:
    return f"SELECT doc_id, md5(string_agg({value}, chr(10) ORDER BY pos)) AS digest FROM {source} GROUP BY doc_id"


def text_of(rows: DataFrame) -> DataFrame:
    """doc_id and text: the lines of a document put together again."""
    made = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("s"))
    return made.select("doc_id", F.array_join(F.transform("s", lambda s: s["line"]), "\n").alias("text"))


TEXTS = "t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM d GROUP BY doc_id)"
ST = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"

NOTES = ("",), ("", "12", ".7", " word3", "1234")
GLUED = ("", "the Kingde Lyon, "), ("", " LouisXIV wrote", " MariadeMedici", " co\u00adop  two", " HenriIVth")
ARTEFACTS = ("", "a b cold wind ", "He saw t hem "), ("", " done. y.", "  two  blanks")
HEADINGS = ("", "# ", "## ", "# "), ("",)
SAME = ("", "## Part\n\n## Part\n", "# One\n## One\n# one"), ("",)
IMAGES = ("", "![a](images/a.png) ", "[x](/b/images/c.png) "), ("", " ![b](./images/d.png)")
GLOSSES = ("", "King(国王) and Queen（女王） and Duke(公爵) ", "Duke(公爵) "), ("",)
MARKS = ("", "oceanofpdf.com ", "### z-lib.org", "----", "LIBGEN text "), ("", "", "***")
LISTED = ("", "12 Note ", "* star ", "- item ", "| a | b |"), ("",)


def footnote_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decorated(spark, sf_dir, *NOTES), T.footnote_space(F.col("line")))


def ingest_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decorated(spark, sf_dir, *GLUED), T.ingest_cleanup(F.col("line")))


def artefact_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decorated(spark, sf_dir, *ARTEFACTS), T.repair(F.col("line")))


def single_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = text_of(decorated(spark, sf_dir, *HEADINGS))
    return d.select("doc_id", F.md5(T.one_heading(F.concat(F.lit("Title "), F.col("doc_id")), F.col("text"))).alias("digest"))


def repeated_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = text_of(decorated(spark, sf_dir, *SAME)).select("doc_id", T.without_repeated_headings(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


def cover_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_of(decorated(spark, sf_dir, *IMAGES)).select("doc_id", T.cover_only(F.col("text")).alias("cover"))


def language_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("doc_id") % 5 == 0, "preserve").otherwise("auto")
    target = F.element_at(F.array(*map(F.lit, ("en-GB", "en", "zh-cn", "de_AT"))), (F.col("doc_id") % 4 + 1).cast("int"))
    d = S.table(spark, sf_dir, "documents").select("doc_id", T.operation(mode, F.col("lang"), target).alias("operation"), T.detect_rule(F.concat(F.repeat(F.lit("国王"), (F.col("doc_id") % 300).cast("int")), F.col("text"))).alias("detected"))
    return d.groupBy("operation", "detected").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def gloss_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decorated(spark, sf_dir, *GLOSSES).withColumn("source", F.when(F.col("pos") % 2 == 0, "Duke(公爵)").otherwise(""))
    kept = digest(d, T.strip_gloss(F.col("line"), F.col("source")))
    bad = d.groupBy("doc_id").agg(F.sum(R.gloss_pollution(F.col("source"), F.col("line")).cast("long")).alias("polluted"))
    return kept.join(bad, "doc_id")


def appendix_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.element_at(F.array(F.lit(""), F.lit("\n\n## Glossary of terms\n\n- king => 国王\nmore"), F.lit("\nTerminology\nking: none"), F.lit("\n\nGlossary\nking -> 国王\nqueen -> 女王")), (F.col("doc_id") % 4 + 1).cast("int"))
    notice = F.when(F.col("doc_id") % 3 == 0, "<!-- fail-open: kept -->\n> source shown\n").otherwise("")
    d = S.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.strip_notice(T.cut_appendix(F.concat(notice, F.col("text"), extra))).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


def file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.substring(F.split("text", "\n")[0], 1, 40)
    path = F.element_at(F.array(F.concat(F.lit("/books/"), head, F.lit(".EPUB")), F.concat(F.lit("C:\\in\\My__Book "), head), F.concat(head, F.lit("  v2.tar.gz"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return S.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.file_stem(path).alias("stem"))


def translation_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.element_at(F.array(F.lit("Untitled"), F.lit("Chapter 12"), F.lit("A Real Title"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int"))
    d = text_of(decorated(spark, sf_dir, *IMAGES))
    return d.select("doc_id", F.md5(T.for_translation(title, F.col("text"))).alias("digest"))


def watermarks_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = text_of(decorated(spark, sf_dir, *MARKS)).select("doc_id", T.without_watermarks(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


def note_heavy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = text_of(decorated(spark, sf_dir, *LISTED))
    return d.select("doc_id", P.footnote_heavy(F.col("text")).alias("heavy"))


def non_prose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.when(F.col("pos") % 4 == 1, F.substring("line", 1, 30)).otherwise(F.col("line"))
    d = decorated(spark, sf_dir, ("", "![a](images/a.png)", "Figure 12 ", "Table x "), ("",)).withColumn("line", short)
    return d.groupBy("doc_id").agg(F.sum(R.non_prose(F.col("line")).cast("long")).alias("skipped"), F.count("*").alias("lines"))


def rewrite_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.element_at(F.array(F.lit(""), F.lit("I cannot do that"), F.repeat(F.lit("国王"), 5), F.repeat(F.lit("国王"), 40)), (F.col("pos") % 4 + 1).cast("int"))
    d = decorated(spark, sf_dir, ("",), ("",)).withColumn("ok", R.rewrite_ok(F.col("line"), answer))
    return d.groupBy("doc_id").agg(F.sum(F.col("ok").cast("long")).alias("ok"), F.count("*").alias("lines"))


def polish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decorated(spark, sf_dir, ("", "国王国王 ", "- ", "![a](b) ", "see [3] "), ("",))
    after = F.element_at(F.array(F.col("line"), F.lit(""), F.substring("line", 1, 30), F.concat(F.lit("Note: "), F.col("line")), F.regexp_replace("line", r"\[3\]|!\[a\]\(b\)|国", "x"), F.concat(F.lit("- "), F.col("line"))), (F.col("pos") % 6 + 1).cast("int"))
    return d.groupBy(F.coalesce(R.polish_reject(F.col("line"), after), F.lit("taken")).alias("reason")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def hard_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("item_id") % len(v) + 1).cast("int"))
    terms = S.table(spark, sf_dir, "benchmark").withColumns({"enforcement": pick("hard", "soft", None, None), "updated_by": pick("user", "model", None)})
    return terms.groupBy("enforcement", "updated_by").agg(F.count("*").alias("n"), F.sum(R.hard_term(F.col("enforcement"), F.col("updated_by")).cast("long")).alias("hard"))


def fenced_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decorated(spark, sf_dir, ("", "\n", "```\n", "\n", ""), ("", "\n\n"))
    return L.blocks(text_of(d)).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.max(F.length("text")).cast("long").alias("longest"), F.sum("pos").cast("long").alias("starts"))


def media_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decorated(spark, sf_dir, ("", "", "![a](b.png)", "| a | ", ""), ("", "", "", " | b |"))
    short = F.when(F.col("pos") % 5 == 2, "![a](b.png)").otherwise(F.col("line"))
    made = R.media_segments(d.select("doc_id", "pos", short.alias("text")), "doc_id")
    return made.groupBy("doc_id", "kind").agg(F.count("*").alias("segments"), F.sum(F.length("text")).cast("long").alias("chars"), F.max("segment").cast("long").alias("last"))


QUERIES = {f.__name__: f for f in (footnote_spacing, ingest_cleanup, artefact_repair, single_heading, repeated_headings, cover_images, language_operations, gloss_checks, appendix_cut, file_stems, translation_input,
                                   watermarks_removed, note_heavy_blocks, non_prose_lines, rewrite_validation, polish_gate, hard_terms, fenced_blocks, media_islands)}

CJK = "len(regexp_extract_all({}, '[\\x{{4E00}}-\\x{{9FFF}}]'))"
GLOSS = "[A-Za-z][A-Za-z ]*[(（]([\\x{4E00}-\\x{9FFF}]+)[)）]"
POLLUTED = "[A-Za-z]{2,}[(（][\\x{4E00}-\\x{9FFF}]+[)）]"
KIND = ("CASE WHEN regexp_matches({0}, '^#{{1,6}}[ \\t]') THEN 'heading' WHEN regexp_matches({0}, '^!\\[[^\\]]*\\]\\([^)]*\\)$') THEN 'image' WHEN regexp_matches({0}, '^\\|.*\\|$') OR regexp_matches({0}, ' \\| .* \\| ') THEN 'table' "
        "WHEN regexp_matches({0}, '^(?:[-*+]|[0-9]{{1,3}}[.)])[ \\t]') THEN 'list' WHEN regexp_matches({0}, '^(?:\\[\\^|[0-9]{{1,3}}[ \\t]+[A-Z])') THEN 'footnote' ELSE 'plain' END")
EXTRAS = r"[E'', E'\n\n## Glossary of terms\n\n- king => 国王\nmore', E'\nTerminology\nking: none', E'\n\nGlossary\nking -> 国王\nqueen -> 女王']"
MARK = "(?i:oceanofpdf|z-lib|libgen)(?i:[a-z.]*)"


def joined(pattern: str) -> str:
    return f"array_to_string(regexp_extract_all({{}}, '{pattern}'), '')"


PICTURES, REFS = joined("!\\[[^\\]]*\\]\\([^)]*\\)"), joined("\\[\\^?[0-9]+\\]")

# where a pattern looks at the character behind it, its SQL doubles the characters between words first: RE2 has no lookaround
ORACLES = {
    "footnote_spacing": f"WITH {decorated_sql(*NOTES)} " + digest_sql("regexp_replace(line, '([A-Za-z][.,;!?]?)([0-9]{1,3})$', '\\1 \\2', 'g')"),
    "ingest_cleanup": f"WITH {decorated_sql(*GLUED)} " + digest_sql(f"regexp_replace(regexp_replace(regexp_replace(replace(line, chr(173), ''), '([a-z]{{3}})({T.REGNAL})\\b', '\\1 \\2', 'g'), '([a-z])(de|van|von|della)([A-Z])', '\\1 \\2 \\3', 'g'), '[ \\t]{{2,}}', ' ', 'g')"),
    "artefact_repair": f"WITH {decorated_sql(*ARTEFACTS)} " + digest_sql("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '([^\\pL\\pN_''])', '\\1\\1', 'g'), '(^|[^\\pL''])([b-hj-z])  ([a-z]{3,})([^\\pL\\pN_]|$)', '\\1\\2\\3\\4', 'g'), '([^\\pL\\pN_''])[^\\pL\\pN_'']', '\\1', 'g'), '\\. y\\.(\\s|$)', '.\\1', 'g'), '(?m)^\\s*y\\.\\s*$', '', 'g'), '([A-Za-z])  +([A-Za-z])', '\\1 \\2', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"),
    "single_heading": f"WITH {decorated_sql(*HEADINGS)}, k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT regexp_matches(line, '^#[ \\t]')) AS t FROM d GROUP BY 1) SELECT doc_id, md5('# Title ' || doc_id || chr(10) || chr(10) || regexp_replace(coalesce(t, ''), '^\\n+', '')) AS digest FROM k",
    "repeated_headings": f"""WITH {decorated_sql(*SAME)}, {TEXTS}, x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t), s AS (SELECT *, lower({ST.format('line')}) AS s FROM x),
 n AS (SELECT doc_id, pos, lag(s) OVER (PARTITION BY doc_id ORDER BY pos) = s AND regexp_matches(s, '^#{{1,6}} ') AS again FROM s WHERE s <> ''), k AS (SELECT s.doc_id, string_agg(line, chr(10) ORDER BY s.pos) AS t FROM s LEFT JOIN n ON n.doc_id = s.doc_id AND n.pos = s.pos WHERE NOT coalesce(again, false) GROUP BY 1)
 SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM k""",
    "cover_images": f"WITH {decorated_sql(*IMAGES)}, {TEXTS} SELECT doc_id, regexp_extract(text, '(!\\[[^\\]]*\\]\\([^)]*\\))', 1) AS cover FROM t",
    "language_operations": f"""WITH b AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'preserve' ELSE 'auto' END AS mode, (['en-GB', 'en', 'zh-cn', 'de_AT'])[doc_id % 4 + 1] AS target, substring(repeat('国王', (doc_id % 300)::int) || text, 1, 4000) AS head FROM documents),
 f AS (SELECT *, lower(regexp_split_to_array(coalesce(lang, ''), '[-_]')[1]) = lower(regexp_split_to_array(target, '[-_]')[1]) AS same, {CJK.format('head')} AS c, len(regexp_extract_all(head, '[A-Za-z]')) AS l FROM b)
 SELECT CASE WHEN mode <> 'auto' THEN mode WHEN same AND lower(lang) <> lower(target) THEN 'convert' WHEN same THEN 'preserve' ELSE 'translate' END AS operation, CASE WHEN c >= 40 AND c >= 0.2 * (c + l) THEN 'zh-cn' END AS detected, count(*) AS n, sum(doc_id)::bigint AS ids FROM f GROUP BY ALL""",
    "gloss_checks": f"""WITH {decorated_sql(*GLOSSES)}, s AS (SELECT *, CASE WHEN pos % 2 = 0 THEN 'Duke(公爵)' ELSE '' END AS source FROM d),
 g AS (SELECT *, len(regexp_extract_all(line, '{GLOSS}')) > len(regexp_extract_all(source, '{GLOSS}')) AS more, len(regexp_extract_all(line, '{POLLUTED}')) AS n, len(regexp_extract_all(source, '{POLLUTED}')) AS m FROM s)
 SELECT doc_id, md5(string_agg(CASE WHEN more THEN regexp_replace(line, '{GLOSS}', '\\1', 'g') ELSE line END, chr(10) ORDER BY pos)) AS digest, sum((n >= 3 AND n > m)::int)::bigint AS polluted FROM g GROUP BY 1""",
    "appendix_cut": f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN E'<!-- fail-open: kept -->\\n> source shown\\n' ELSE '' END || text || ({EXTRAS})[doc_id % 4 + 1] AS t FROM documents WHERE text IS NOT NULL),
 c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?s)\\n+(?:#+ *)?(?:Glossary|Terminology)[^\\n]*\\n+(?:[-*] )?[^\\n]+(?:=>|->|→)[^\\n]+.*$', '', 'g'), '(?s)<!-- fail-open.*?-->\\n?(?:> [^\\n]*\\n?)?', '', 'g') AS t FROM x) SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM c""",
    "file_stems": f"""WITH h AS (SELECT doc_id, substring(string_split(text, chr(10))[1], 1, 40) AS h FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, (['/books/' || h || '.EPUB', 'C:\\in\\My__Book ' || h, h || '  v2.tar.gz'])[doc_id % 3 + 1] AS p FROM h)
 SELECT doc_id, lower({ST.format("regexp_replace(regexp_replace(regexp_replace(p, '^.*[/\\\\]', '', 'g'), '\\.[A-Za-z0-9]+$', '', 'g'), '[ _\\t]+', ' ', 'g')")}) AS stem FROM p""",
    "translation_input": f"""WITH {decorated_sql(*IMAGES)}, {TEXTS}, b AS (SELECT doc_id, (['Untitled', 'Chapter 12', 'A Real Title', NULL])[doc_id % 4 + 1] AS title, regexp_replace(text, '\\]\\((?:/[^)]*/|\\./)?(images/[^)]*)\\)', '](\\1)', 'g') AS body FROM t)
 SELECT doc_id, md5(CASE WHEN title IS NULL OR regexp_matches(title, '^(?i:untitled|chapter [0-9]+|section [0-9]+)$') THEN body ELSE '# ' || title || chr(10) || chr(10) || body END) AS digest FROM b""",
    "watermarks_removed": f"""WITH {decorated_sql(*MARKS)}, k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT regexp_matches({ST.format('line')}, '^(?:#+\\s*)?(?:{MARK}|[-_*=]{{3,}})$')) AS t FROM d GROUP BY 1),
 c AS (SELECT doc_id, regexp_replace(coalesce(t, ''), '{MARK}', '', 'g') AS t FROM k) SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM c""",
    "note_heavy_blocks": f"""WITH {decorated_sql(*LISTED)}, {TEXTS}, l AS (SELECT doc_id, text, string_split(text, chr(10))[1:32] AS l FROM t), m AS (SELECT *, len(list_filter(l, lambda x: regexp_matches(x, '^(?:[0-9]+|\\*|†|‡)[ \\t]+'))) AS m FROM l)
 SELECT doc_id, length(text) >= 40 AND (m >= 2 OR (len(l) = 1 AND m = 1 AND length(text) >= 72)) AS heavy FROM m""",
    "non_prose_lines": f"""WITH {decorated_sql(("", "![a](images/a.png)", "Figure 12 ", "Table x "), ("",))}, s AS (SELECT doc_id, {ST.format("CASE WHEN pos % 4 = 1 THEN substring(line, 1, 30) ELSE line END")} AS s FROM d)
 SELECT doc_id, sum((s = '' OR length({joined("!?\\[[^\\]]*\\]\\([^)]*\\)").format('s')}) * 10 >= length(s) * 6 OR regexp_matches(s, '^(?i:figure|fig\\.|table|map|plate)\\s+[0-9IVX]+'))::int)::bigint AS skipped, count(*) AS lines FROM s GROUP BY 1""",
    "rewrite_validation": f"""WITH {decorated_sql(("",), ("",))}, a AS (SELECT *, (['', 'I cannot do that', repeat('国王', 5), repeat('国王', 40)])[pos % 4 + 1] AS a, len(regexp_extract_all(line, '[A-Za-z]')) AS n FROM d)
 SELECT doc_id, sum(({ST.format('a')} <> '' AND NOT regexp_matches(lower(a), 'i cannot|i can''t|as an ai|i''m sorry') AND (n < 40 OR {CJK.format('a')} >= greatest(12, n // 8)))::int)::bigint AS ok, count(*) AS lines FROM a GROUP BY 1""",
    "polish_gate": f"""WITH {decorated_sql(("", "国王国王 ", "- ", "![a](b) ", "see [3] "), ("",))}, p AS (SELECT doc_id, line AS b, ([line, '', substring(line, 1, 30), 'Note: ' || line, regexp_replace(line, '\\[3\\]|!\\[a\\]\\(b\\)|国', 'x', 'g'), '- ' || line])[pos % 6 + 1] AS a FROM d),
 k AS (SELECT *, {KIND.format(ST.format('b'))} AS kb, {KIND.format(ST.format('a'))} AS ka FROM p),
 r AS (SELECT doc_id, CASE WHEN {ST.format('a')} = '' THEN 'empty' WHEN kb <> ka THEN 'structural' WHEN {CJK.format('a')} * 100 < {CJK.format('b')} * 82 THEN 'cjk_drop' WHEN length(a) * 100 < length(b) * 62 THEN 'length_drop' WHEN regexp_matches(lower(a), '^(?:here is|note:|translation:)') THEN 'commentary'
  WHEN {PICTURES.format('b')} <> {PICTURES.format('a')} THEN 'image_change' WHEN {REFS.format('b')} <> {REFS.format('a')} THEN 'footnote_change' ELSE 'taken' END AS reason FROM k) SELECT reason, count(*) AS n, sum(doc_id)::bigint AS ids FROM r GROUP BY 1""",
    "hard_terms": "WITH b AS (SELECT (['hard', 'soft', NULL, NULL])[item_id % 4 + 1] AS enforcement, (['user', 'model', NULL])[item_id % 3 + 1] AS updated_by FROM benchmark) SELECT enforcement, updated_by, count(*) AS n, sum((coalesce(enforcement = 'hard', false) OR (enforcement IS NULL AND coalesce(updated_by, '') <> 'user'))::int)::bigint AS hard FROM b GROUP BY ALL",
    "fenced_blocks": f"""WITH {decorated_sql(("", chr(10), "```" + chr(10), chr(10), ""), ("", chr(10) + chr(10)))}, {TEXTS}, x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM t),
 f AS (SELECT *, starts_with({ST.format('line')}, '```') AS mark, sum(starts_with({ST.format('line')}, '```')::int) OVER (PARTITION BY doc_id ORDER BY pos) AS marks FROM x), b AS (SELECT *, NOT mark AND marks % 2 = 0 AND {ST.format('line')} = '' AS blank FROM f),
 i AS (SELECT *, sum(blank::int) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM b), g AS (SELECT doc_id, min(pos) AS pos, length(string_agg(line, chr(10) ORDER BY pos)) AS n FROM i WHERE NOT blank GROUP BY doc_id, island)
 SELECT doc_id, count(*) AS blocks, max(n) AS longest, sum(pos)::bigint AS starts FROM g GROUP BY 1""",
    "media_islands": f"""WITH {decorated_sql(("", "", "![a](b.png)", "| a | ", ""), ("", "", "", " | b |"))}, s AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 2 THEN '![a](b.png)' ELSE line END AS text FROM d), k AS (SELECT *, CASE WHEN {KIND.format(ST.format('text'))} IN ('image', 'table') THEN 'media' ELSE 'text' END AS kind FROM s),
 n AS (SELECT *, kind = 'media' OR coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) <> kind, true) AS new FROM k), i AS (SELECT *, sum(new::int) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS segment FROM n),
 g AS (SELECT doc_id, segment, kind, length(string_agg(text, chr(10) || chr(10) ORDER BY pos)) AS n FROM i GROUP BY ALL) SELECT doc_id, kind, count(*) AS segments, sum(n)::bigint AS chars, max(segment)::bigint AS last FROM g GROUP BY ALL""",
}
