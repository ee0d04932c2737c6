"""Texts and files read into regions with locators; offsets count UTF-16 code units of the decoded text.

Text, CSV, TSV, JSON and HTML are read by expressions; EPUB, DOCX and PDF, which need a parser, by a
Python function over Arrow batches.  Every source gives a coverage row, also one that can't be read.
"""

from __future__ import annotations

import csv
import html
import io
import json
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from attestry.functions.text import utf16_length

_BREAK = r"\r\n|\r|\n"


def _region_id(digest: Column, locator: Column) -> Column:
    return F.concat(F.lit("region_"), F.substring(F.sha2(F.concat_ws("\x00", digest, locator), 256), 1, 24))


def lines(sources: DataFrame) -> DataFrame:
    """(source_version_id, ord, start, end, text): the non-blank lines of ``sources`` (source_version_id, text).

    LF, CRLF and CR end lines; blank lines are counted but not returned.  A line's offsets are found
    from the lengths of the lines and breaks before it.
    """
    parts = F.split("text", _BREAK)
    # As split() drops nothing (limit -1), there is one break fewer than lines.
    breaks = F.regexp_extract_all(F.col("text"), F.lit(f"({_BREAK})"), F.lit(1))
    lens = F.zip_with(parts, F.concat(breaks, F.array(F.lit(""))), lambda a, b: utf16_length(a) + F.length(b))
    s = sources.where("text is not null").select("source_version_id", F.posexplode(F.arrays_zip(parts.alias("t"), lens.alias("n"))).alias("pos", "x"))
    w = Window.partitionBy("source_version_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("start", F.coalesce(F.sum("x.n").over(w), F.lit(0)).cast("long"))
    text = F.col("x.t")
    return s.where(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) != "").select(
        "source_version_id", (F.col("pos") + 1).cast("long").alias("ord"), "start", (F.col("start") + utf16_length(text)).alias("end"), text.alias("text"))


def marked(regions: DataFrame, sources: DataFrame, begin: str = r"\*\*\* ?START OF [^\n]*?\*\*\*", stop: str = r"\*\*\* ?END OF [^\n]*?\*\*\*") -> DataFrame:
    """``regions`` with ``segment``: before, within or after the marked work; all ``work`` unless both marks stand in order."""
    at = sources.select("source_version_id", F.regexp_instr("text", F.lit(begin)).alias("_b"), F.length(F.regexp_substr("text", F.lit(begin))).alias("_bl"), F.regexp_instr("text", F.lit(stop)).alias("_e"), "text")
    both = (F.col("_b") > 0) & (F.col("_e") >= F.col("_b") + F.col("_bl"))
    first, last = utf16_length(F.expr("substring(text, 1, _b - 1 + _bl)")), utf16_length(F.expr("substring(text, 1, _e - 1)"))
    at = at.select("source_version_id", F.when(both, first).alias("_from"), F.when(both, last).alias("_to"))
    seg = F.when(F.col("end") <= F.col("_from"), "front-matter").when(F.col("start") >= F.col("_to"), "back-matter").otherwise("work")
    return regions.join(at, "source_version_id").withColumn("segment", seg).drop("_from", "_to")


def paragraphs(pages: DataFrame, id: str, html_text: str) -> DataFrame:
    """(id, pos, text): the paragraphs of HTML pages, without scripts, styles, drawings and navigation.

    Block elements end lines, other tags vanish, entities are decoded, white space is squeezed.
    """
    c = F.col(html_text)
    c = F.regexp_replace(c, r"(?is)<!--.*?-->|<(script|style|nav|svg|head)\b[^>]*>.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr|/blockquote|/section|/article|p|div|li|tr|h[1-6])\b[^>]*>", "\n")
    c = decoded(F.regexp_replace(c, r"<[^>]*>", ""))
    rows = pages.select(F.col(id).alias("id"), F.posexplode(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")).alias("pos", "text"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), "text")


# Named entities read without leaving the JVM; &amp; comes last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&rsquo;": "’", "&lsquo;": "‘", "&ldquo;": "“", "&rdquo;": "”"}


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if x else x)


def decoded(c: Column) -> Column:
    """Entities decoded: common names by expressions, texts with numeric or rare ones by the standard library."""
    plain = c
    for name, char in ENTITIES.items():
        plain = F.replace(plain, F.lit(name), F.lit(char))
    plain = F.replace(plain, F.lit("&amp;"), F.lit("&"))
    rare = c.rlike(r"&(?!(?:nbsp|lt|gt|quot|apos|mdash|ndash|hellip|rsquo|lsquo|ldquo|rdquo|amp);)#?[A-Za-z0-9]+;")
    return F.when(rare, _unescape(c)).otherwise(plain)


def csv_rows(spark: SparkSession, path: str, sep: str = ",", quoted: bool = True) -> DataFrame:
    """(row, text, cells): each record after the header as ``header: value; ...``; rows count from 2."""
    r = spark.read.option("header", True).option("sep", sep).option("quote", '"' if quoted else "").option("escape", '"' if quoted else "\\")
    d = r.option("multiLine", quoted).option("mode", "PERMISSIVE").csv(path)
    cells = F.array(*[F.struct(F.lit(c).alias("header"), F.coalesce(F.col(f"`{c}`"), F.lit("")).alias("value")) for c in d.columns])
    d = d.select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_i"), cells.alias("cells"))
    w = Window.partitionBy("file_path").orderBy("file_block_start", "_i")
    return d.select("file_path", (F.row_number().over(w) + 1).alias("row"), F.array_join(F.transform("cells", lambda c: F.concat(c["header"], F.lit(": "), c["value"])), "; ").alias("text"), "cells")


@F.pandas_udf(T.BooleanType())
def _is_json(s: pd.Series) -> pd.Series:
    """Whether each text is one JSON document and nothing behind it, which the parsing expressions let pass."""
    def one(x):
        try:
            json.loads(x)
        except (ValueError, RecursionError, TypeError):
            return False
        return True

    return s.map(one)


def json_lines(sources: DataFrame) -> DataFrame:
    """(source_version_id, valid, ord, start, end, text): lines of JSON documents; invalid ones give one row without a line."""
    v = sources.select("source_version_id", "text", _is_json("text").alias("valid"))
    good = lines(v.where("valid")).withColumn("valid", F.lit(True))
    bad = v.where("not valid").select("source_version_id", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("valid"))
    return good.select("source_version_id", "valid", "ord", "start", "end", "text").unionByName(bad)


def _xml_text(node) -> str:
    return re.sub(r"\s+", " ", "".join(node.itertext())).strip()


def docx_paragraphs(content: bytes, limit: int) -> list[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        info = z.getinfo("word/document.xml")
        if info.file_size > limit:
            raise ValueError("document larger than the limit")
        root = ElementTree.fromstring(z.read(info))
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    texts = ["".join(t.text or "" for t in p.iter(f"{ns}t")).strip() for p in root.iter(f"{ns}p")]
    return [(f"docx-paragraph:{i + 1}", t) for i, t in enumerate(texts) if t]


def epub_paragraphs(content: bytes, limit: int) -> list[tuple[str, str]]:
    """Paragraphs in reading order: the package's spine, each chapter's blocks."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > limit:
            raise ValueError("archive larger than the limit")
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in box.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(opf))
        items = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item")}
        spine = [items.get(e.get("idref")) for e in package.iter() if e.tag.endswith("}itemref")]
        out = []
        for n, href in enumerate(h for h in spine if h):
            page = z.read(posixpath.normpath(posixpath.join(posixpath.dirname(opf), href))).decode("utf-8", "replace")
            page = re.sub(r"(?is)<!--.*?-->|<(script|style|nav|svg|head)\b[^>]*>.*?</\1\s*>", " ", page)
            page = re.sub(r"(?i)</?(?:br|p|div|h[1-6]|li|tr|blockquote|section)\b[^>]*>", "\n", page)
            texts = [re.sub(r"\s+", " ", html.unescape(t)).strip() for t in re.sub(r"<[^>]*>", "", page).split("\n")]
            out += [(f"epub-chapter:{n + 1}:{href}:{i + 1}", t) for i, t in enumerate([t for t in texts if t])]
    return out


def pdf_pages(content: bytes, limit: int) -> list[tuple[str, str]]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise NotImplementedError("no PDF reader is installed") from e
    return [(f"pdf-page:{i + 1}", t.strip()) for i, p in enumerate(PdfReader(io.BytesIO(content)).pages) if (t := p.extract_text() or "").strip()]


def _table_rows(rows, kind: str) -> list[tuple[str, str]]:
    """Records after the header as ``header: value; ...``; rows count from 2; missing values are empty, further ones left out."""
    rows = [r for r in rows if r]
    header = rows[0] if rows else []
    return [(f"{kind}:{i + 2}", "; ".join(f"{h}: {r[j] if j < len(r) else ''}" for j, h in enumerate(header))) for i, r in enumerate(rows[1:])]


def _decoded(content: bytes, limit: int) -> str:
    if len(content) > limit:
        raise ValueError("file larger than the limit")
    return content.decode("utf-8", "replace")


def csv_records(content: bytes, limit: int) -> list[tuple[str, str]]:
    """Quoted cells may hold separators, line breaks and doubled quotes."""
    return _table_rows(csv.reader(io.StringIO(_decoded(content, limit), newline="")), "csv-row")


def tsv_records(content: bytes, limit: int) -> list[tuple[str, str]]:
    """Nothing is quoted; empty lines are no records."""
    return _table_rows((line.split("\t") for line in re.split(r"\r?\n", _decoded(content, limit)) if line), "csv-row")


_PARSERS = {"docx": docx_paragraphs, "epub": epub_paragraphs, "pdf": pdf_pages, "csv": csv_records, "tsv": tsv_records}
#: Read as lines; those of the first row may mark where the work begins and ends.
MARKED = ("txt", "text", "md", "markdown", "log")
LINED = (*MARKED, "xml", "json", "jsonl")
PAGES = ("html", "htm", "xhtml")


def files(spark: SparkSession, path: str, limit: int = 50_000_000) -> tuple[DataFrame, DataFrame]:
    """(regions, coverage) of the files below ``path``, see ``dispatched``."""
    return dispatched(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), limit)


def versions(raw: DataFrame) -> DataFrame:
    """(path, source_version_id, ext): each file's version, which is its digest, and its extension."""
    return raw.select("path", F.concat(F.lit("srcv_"), F.substring(F.sha2("content", 256), 1, 32)).alias("source_version_id"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"))


def dispatched(raw: DataFrame, limit: int = 50_000_000) -> tuple[DataFrame, DataFrame]:
    """(regions, coverage) of files (path, content), read by their extensions; what isn't known is ``unreadable``.

    Lines of texts, logs, XML and valid JSON; lines of JSON lines; rows of CSV and TSV; paragraphs of
    HTML, DOCX and EPUB; pages of PDF.  Texts with marks of a work have segments.  Files with the same
    content and extension are one source.  A file that can't be parsed or exceeds ``limit`` bytes
    unpacked is covered as ``partial``, ``unreadable`` or ``deferred`` with the reason, and never stops the others.
    """
    own = raw.select("content", F.sha2("content", 256).alias("digest"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext")).groupBy("digest", "ext").agg(F.first("content").alias("content"))
    own = own.withColumn("version", F.concat(F.lit("srcv_"), F.substring("digest", 1, 32))).withColumn("source_version_id", F.concat_ws("/", "version", "ext"))
    key = own.select("source_version_id", "version", "digest", "ext")
    text = own.where(F.col("ext").isin(*LINED, *PAGES)).select("source_version_id", "ext", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    broken = F.when(F.col("ext") == "json", ~_is_json("text")).otherwise(False)
    lined = text.where(F.col("ext").isin(*LINED) & ~broken)
    kind = F.when(F.col("ext") == "jsonl", "json-line").otherwise("text-line")
    marks = text.where(F.col("ext").isin(*MARKED))
    ln = lines(lined.select("source_version_id", "text")).join(key.select("source_version_id", "ext"), "source_version_id")
    work = marked(ln.where(F.col("ext").isin(*MARKED)), marks).unionByName(ln.where(~F.col("ext").isin(*MARKED)).withColumn("segment", F.lit("work")))
    a = work.select("source_version_id", kind.alias("kind"), "ord", "start", F.col("end").cast("long").alias("end"), "text", F.concat_ws(":", kind, "ord", "start", "end").alias("locator"), "segment")
    none = F.lit(None).cast("long")
    para = paragraphs(text.where(F.col("ext").isin(*PAGES)), "source_version_id", "text")
    h = para.select(F.col("id").alias("source_version_id"), F.lit("html-paragraph").alias("kind"), (F.col("pos") + 1).alias("ord"), none.alias("start"), none.alias("end"), "text", F.concat_ws(":", F.lit("html-paragraph"), (F.col("pos") + 1)).alias("locator"), F.lit("work").alias("segment"))

    def parse(batches):
        for b in batches:
            rows = []
            for v, ext, content in zip(b["source_version_id"], b["ext"], b["content"]):
                try:
                    for i, (loc, t) in enumerate(_PARSERS[ext](bytes(content), limit)):
                        rows.append((v, ext, i + 1, t, loc, None))
                except ValueError as e:
                    rows.append((v, ext, None, None, None, f"deferred: {e}"))
                except Exception as e:  # noqa: BLE001 - a broken file is covered, not fatal
                    rows.append((v, ext, None, None, None, f"unreadable: {type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source_version_id", "ext", "ord", "text", "locator", "problem"]).astype({"ord": "Int64"})

    got = own.where(F.col("ext").isin(*_PARSERS)).select("source_version_id", "ext", "content").mapInPandas(parse, "source_version_id string, ext string, ord long, text string, locator string, problem string")
    p = got.where("problem is null").select("source_version_id", F.regexp_extract("locator", "^([a-z-]+)", 1).alias("kind"), "ord", none.alias("start"), none.alias("end"), "text", "locator", F.lit("work").alias("segment"))
    regions = a.unionByName(h).unionByName(p).join(key, "source_version_id")
    n = regions.groupBy("source_version_id").agg(F.count(F.lit(1)).alias("regions"))
    problem = got.where("problem is not null").groupBy("source_version_id").agg(F.first("problem").alias("problem"))
    invalid = text.where(broken).select("source_version_id", F.lit("partial: invalid JSON").alias("problem"))
    cover = key.join(n, "source_version_id", "left").join(problem.unionByName(invalid), "source_version_id", "left")
    known = F.col("ext").isin(*_PARSERS, *LINED, *PAGES)
    state = F.when(~known, "unreadable").when(F.col("problem").isNotNull(), F.regexp_extract("problem", "^([a-z]+)", 1)).otherwise("ready")
    coverage = cover.select(F.col("version").alias("source_version_id"), "ext", state.alias("state"), F.when(~known, F.concat(F.lit("unsupported format: "), "ext")).otherwise(F.col("problem")).alias("reason"), F.coalesce("regions", F.lit(0)).alias("regions"))
    return regions.select(F.col("version").alias("source_version_id"), _region_id(F.col("digest"), F.col("locator")).alias("region_id"), "kind", "ord", "start", "end", "text", "locator", "segment", "ext"), coverage
