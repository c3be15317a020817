"""Loading relations: parquet tables, JSON artifacts, append-only event logs, zip containers; input gates."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Page and size limits by profile (warn pages, max pages, warn MB, max MB).
GATES = {
    "auto": (160, 320, 40.0, 80.0),
    "magazine": (140, 220, 50.0, 100.0),
    "book": (800, 1500, 60.0, 120.0),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dispatch(path: Column) -> Column:
    """Which reader a path goes to; null if there is none."""
    p = F.lower(path)
    return F.when(p.endswith(".epub"), "epub").when(p.endswith(".pdf"), "pdf")


def event_log(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """An append-only JSON-lines log. Strict logs fail on a malformed line, others skip it."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def log_tail(log: DataFrame, seq: str, limit: int) -> DataFrame:
    return log.orderBy(F.desc(seq)).limit(limit)


def input_gate(inputs: DataFrame) -> DataFrame:
    """gate_ok, gate_reason, warn of inputs (profile, pages, bytes, chars, images)."""
    limits = F.create_map(*[x for name, v in GATES.items() for x in (F.lit(name), F.struct(F.lit(min(v[0], 0.8 * v[1])).alias("warn_pages"), F.lit(v[1]).alias("max_pages"), F.lit(min(v[2], 0.8 * v[3])).alias("warn_mb"), F.lit(v[3]).alias("max_mb")))])
    lim, mb = limits[F.col("profile")], F.col("bytes") / (1024 * 1024)
    reason = (F.when(F.col("pages") > lim["max_pages"], "too_many_pages").when(mb > lim["max_mb"], "too_large")
              .when((F.col("chars") < F.greatest(F.lit(400), 30 * F.col("pages"))) & (F.col("images") >= F.greatest(F.lit(12), F.col("pages"))), "image_only"))
    return inputs.withColumns({"gate_reason": reason, "gate_ok": reason.isNull(), "warn": (F.col("pages") > lim["warn_pages"]) | (mb > lim["warn_mb"])})


def soft_page_limit(pages: DataFrame, key: str, page: str, n: int) -> DataFrame:
    """The first n pages of each document."""
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(page))).where(F.col("_n") <= n).drop("_n")


_OPF = "{http://www.idpf.org/2007/opf}"


def spine(content: bytes) -> list[tuple[int, str, str]]:
    """(position, path, XHTML) of an EPUB's spine; encrypted members and paths that leave the archive are errors."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if any(i.flag_bits & 1 for i in z.infolist()):
            raise ValueError("encrypted archive")
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in root.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(opf))
        base = posixpath.dirname(opf)
        hrefs = {e.get("id"): e.get("href") for e in package.iter(f"{_OPF}item")}
        out = []
        for k, ref in enumerate(package.iter(f"{_OPF}itemref")):
            href = hrefs.get(ref.get("idref"))
            if href is None:
                continue
            path = posixpath.normpath(posixpath.join(base, href))
            if path.startswith(("..", "/")):
                raise ValueError(f"path leaves the archive: {href}")
            out.append((k, path, z.read(path).decode("utf-8", "replace")))
        return out


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """path, spine_idx, href, xhtml of every EPUB under `path`."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *x) for p, c in zip(pdf["path"], pdf["content"], strict=True) for x in spine(c)]
            yield pd.DataFrame(rows, columns=["path", "spine_idx", "href", "xhtml"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content").mapInPandas(run, "path string, spine_idx int, href string, xhtml string")
