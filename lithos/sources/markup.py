"""Article markup: parsing abstracts and full texts, and chunks.

Parsing runs in Arrow batches; a document that cannot be parsed gives an error row, not a
failed job. Element text is joined with blanks and compacted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ABSTRACT = "id string, pmid string, title string, journal string, year string, abstract string, error string"
ARTICLE = "id string, title string, abstract array<string>, sections array<struct<title:string,paras:array<string>>>, error string"


def inner(element) -> str:
    return " ".join(" ".join(element.itertext()).split()) if element is not None else ""


def articles_in(xml: str, tags: tuple[str, ...]) -> list:
    root = ET.fromstring(xml)
    return [root] if root.tag in tags else [e for e in root.iter() if e.tag in tags]


def abstract_fields(a) -> dict:
    year = inner(a.find(".//JournalIssue/PubDate/Year")) or inner(a.find(".//PubDate/MedlineDate"))[:4]
    parts = [inner(x) for x in a.findall(".//Abstract/AbstractText")]
    return {"pmid": inner(a.find(".//PMID")), "title": inner(a.find(".//ArticleTitle")) or inner(a.find(".//BookTitle")), "journal": inner(a.find(".//Journal/Title")), "year": year, "abstract": " ".join(x for x in parts if x)}


def parse_abstracts(rows: DataFrame, id_col: str = "id", xml_col: str = "xml") -> DataFrame:
    """One row per article or book article in each XML text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, xml in zip(b["id"], b["xml"], strict=True):
                try:
                    out += [{"id": key, **abstract_fields(a), "error": None} for a in articles_in(xml or "", ("PubmedArticle", "PubmedBookArticle"))]
                except ET.ParseError as e:
                    out.append(dict.fromkeys(("pmid", "title", "journal", "year", "abstract")) | {"id": key, "error": str(e)})
            yield pd.DataFrame(out, columns=["id", "pmid", "title", "journal", "year", "abstract", "error"])

    return rows.select(F.col(id_col).cast("string").alias("id"), F.col(xml_col).alias("xml")).mapInPandas(run, ABSTRACT)


def article_parts(xml: str) -> list[dict]:
    try:
        found = articles_in(xml, ("article",))
    except ET.ParseError:
        # a damaged batch: take each article that is whole
        found = []
        for m in re.finditer(r"<article\b.*?</article>", xml, re.S):
            try:
                found.append(ET.fromstring(m.group()))
            except ET.ParseError:
                continue
        if not found:
            raise
    out = []
    for a in found:
        sections = [{"title": inner(s.find("title")), "paras": [t for p in s.findall("p") if (t := inner(p))]} for s in a.iterfind(".//body//sec")]
        out.append({"title": inner(a.find(".//article-title")), "abstract": [t for p in a.iterfind(".//abstract//p") if (t := inner(p))], "sections": [s for s in sections if s["paras"]]})
    return out


def parse_articles(rows: DataFrame, id_col: str = "id", xml_col: str = "xml") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, xml in zip(b["id"], b["xml"], strict=True):
                try:
                    out += [{"id": key, **x, "error": None} for x in article_parts(xml or "")]
                except ET.ParseError as e:
                    out.append(dict.fromkeys(("title", "abstract", "sections")) | {"id": key, "error": str(e)})
            yield pd.DataFrame(out, columns=["id", "title", "abstract", "sections", "error"])

    return rows.select(F.col(id_col).cast("string").alias("id"), F.col(xml_col).alias("xml")).mapInPandas(run, ARTICLE)


def chunks(articles: DataFrame) -> DataFrame:
    """pmcid, section, para_idx, text, chunk_key: up to three abstract paragraphs, then the
    sections with case-like titles or, if there are none, all of them (P21)."""
    case = F.filter("sections", lambda s: T.is_case_title(s["title"]))
    used = F.when(F.size(case) > 0, case).otherwise(F.col("sections"))
    paras = lambda title, ps: F.transform(ps, lambda p, i: F.struct(title.alias("section"), i.alias("para_idx"), p.alias("text")))
    every = F.concat(paras(F.lit("Abstract"), F.slice("abstract", 1, 3)), F.flatten(F.transform(used, lambda s: paras(F.coalesce(F.nullif(s["title"], F.lit("")), F.lit("UNKNOWN")), s["paras"]))))
    rows = articles.where("error is null").select(F.col("id").alias("pmcid"), F.inline(every))
    return rows.withColumn("chunk_key", F.concat_ws("|", "pmcid", "section", F.col("para_idx").cast("string")))
