"""The terminology funnel: phrases, statistics, scores, cut-off, overlap suppression."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PHRASE = r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,4}"
CONNECTED = r"[A-Z][a-z]+ (?:of|and) (?:the )?[A-Z][a-z]+"
#: Substrings that mark a term of the domain.
DOMAIN_MARKERS = ("act", "policy", "capitalism", "corporation", "corporate", "shareholder", "primacy", "board", "governance", "economic", "economy", "finance", "financial", "regulation", "regulatory", "federal", "commission", "institution",
                  "stakeholder", "equity", "market", "labor", "union", "tax", "fiscal", "monetary", "democracy", "republic", "amendment", "statute", "legislation")
EVENT_MARKERS = ("revolution", "war", "campaign", "massacre", "famine", "dynasty", "movement", "reform", "opening")


@dataclass(frozen=True)
class Policy:
    person_penalty: float = 1.0
    fragment_penalty: float = 3.0
    index_weight: float = 2.0
    least_score: float = 3.0
    least_words: int = 2


#: Policies by profile.
POLICIES = {"humanities": Policy(0.0, 3.0, 2.5), "social": Policy(1.0, 3.0, 2.0), "science": Policy(1.5, 2.0, 3.0), "logic": Policy(0.5, 2.0, 3.5, 2.0, 1)}


def candidates(docs: DataFrame, book: str = "source") -> DataFrame:
    """book, doc_id, phrase, n: capitalised phrases and connected ones, counted in each document."""
    found = F.concat(F.regexp_extract_all("text", F.lit(f"({PHRASE})"), 1), F.regexp_extract_all("text", F.lit(f"({CONNECTED})"), 1))
    return docs.select(book, "doc_id", F.explode(found).alias("phrase")).groupBy(book, "doc_id", "phrase").agg(F.count("*").alias("n"))


def statistics(found: DataFrame, book: str = "source") -> DataFrame:
    """Per canonical key: occurrences, chapters and the most frequent spelling's variants (G15). Documents are
    already distinct rows, so chapters are a plain sum."""
    by_doc = found.withColumn("key", F.lower("phrase")).groupBy(book, "key", "doc_id").agg(F.sum("n").alias("n"), F.collect_set("phrase").alias("v"))
    return by_doc.groupBy(book, "key").agg(F.sum("n").alias("occurrences"), F.count("*").alias("chapters"), F.size(F.array_distinct(F.flatten(F.collect_set("v")))).alias("variants"), F.min(F.col("v")[0]).alias("_any"), F.min(F.array_min("v")).alias("phrase")).drop("_any")


def score(policy: Policy, in_index: Column | None = None) -> Column:
    """Points of a candidate in tenths, whole numbers."""
    p, occ, ch, words = F.col("phrase"), F.col("occurrences"), F.col("chapters"), F.size(F.split("phrase", " "))
    low = F.lower(p)
    marks = sum(low.contains(m).cast("int") for m in DOMAIN_MARKERS)
    event = F.greatest(*[low.contains(m).cast("int") for m in EVENT_MARKERS]) == 1
    person = p.rlike(r"^[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}$") & ~event & (marks == 0)
    points = F.when(occ >= 8, 60).when(occ >= 4, 40).when(occ >= 2, 20).otherwise(-20) + F.when(ch >= 4, 50).when(ch >= 2, 30).otherwise(-15) + F.least(F.lit(40), 15 * marks)
    two = F.when(event, 15).when(person, -round(10 * policy.person_penalty)).otherwise(-5)
    points += F.when(words == 1, 25).when(words >= 3, 20).otherwise(two)
    points += F.when(p.rlike("(?:Press|University|Institute)$"), -40).otherwise(0)
    points += F.when((words == 2) & (marks == 0) & (occ <= 3) & (ch <= 2), -30).otherwise(0)
    if in_index is not None:
        points += F.when(in_index, round(10 * policy.index_weight)).otherwise(0)
    return points


def ranked(scored: DataFrame, policy: Policy, chars: Column, book: str = "source") -> DataFrame:
    """The candidates that are shown (H14, I01): cut off below the best score less 4 where there are over 30,
    ordered by score, occurrences and spelling, and limited by the book's length."""
    every = Window.partitionBy(book)
    order = every.orderBy(F.desc("score"), F.desc("occurrences"), "key")
    good = scored.where(F.col("score") >= round(10 * policy.least_score))
    good = good.withColumns({"_n": F.count("*").over(every), "_top": F.max("score").over(every), "rank": F.row_number().over(order)})
    cut = F.when(F.col("_n") <= 30, round(10 * policy.least_score)).otherwise(F.greatest(F.lit(round(10 * policy.least_score)), F.least(F.lit(65), F.col("_top") - 40)))
    limit = F.least(F.lit(200), F.greatest(F.lit(20), 20 + F.floor(chars / 12000)))
    return good.where(((F.col("score") >= cut) | (F.col("rank") <= 15)) & (F.col("rank") <= limit)).drop("_n", "_top")


def without_contained(terms: DataFrame, book: str = "source") -> DataFrame:
    """Drops a term if a kept longer one contains its words in a row, with 60 % of its occurrences and as many
    chapters (H13). A book has 200 terms at most by now, so a group is bounded."""
    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept = pdf.sort_values("rank"), []
        for r in pdf.itertuples():
            padded = f" {r.key} "
            if not any(padded in f" {k.key} " and k.key != r.key and k.occurrences * 5 >= r.occurrences * 3 and k.chapters >= r.chapters for k in kept):
                kept.append(r)
        return pdf[pdf["key"].isin([k.key for k in kept])]

    return terms.groupBy(book).applyInPandas(keep, terms.schema)


def select_terms(text: str, terms: list[str], most: int = 20) -> list[tuple[int, str]]:
    """Terms in a text, longest first, spans that don't overlap, by position."""
    low, taken, out = text.lower(), [], []
    for t in sorted(terms, key=lambda t: (-len(t), t)):
        at = low.find(t.lower())
        while at >= 0:
            end = at + len(t)
            edge = (at == 0 or not low[at - 1].isalnum()) and (end == len(low) or not low[end].isalnum())
            if edge and all(end <= a or at >= b for a, b in taken):
                taken.append((at, end))
                out.append((at, t))
                break
            at = low.find(t.lower(), at + 1)
    return sorted(out)[:most]


def merge_variants(entries: DataFrame, key: str) -> DataFrame:
    """One row a key: the user's row if there is one, else the first; evidence united."""
    best = F.min(F.struct((F.col("updated_by") != "user").cast("int").alias("o"), "seq", "source", "target")).alias("b")
    return entries.groupBy(key).agg(best, F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence")).select(key, "b.source", "b.target", "evidence")
