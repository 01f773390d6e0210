"""Readers. Columnar and text formats use Spark's own readers; documents that need a parser pass as binary files through mapInPandas."""

from __future__ import annotations

import io
import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_page, xml_format


def table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet; filters and columns reach the scan."""
    reader = spark.read
    return (reader.schema(schema) if schema else reader).parquet(path)


def query(spark: SparkSession, sql: str, limit: int = 100, **views: DataFrame) -> DataFrame:
    """The caller's SQL over named views, with a limit."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql).limit(limit)


def json_rows(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a JSON array: bad ones, which don't fit the schema, are kept apart and not lost."""
    items = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("item"))
    checked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = items.select("item", F.from_json("item", checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.where("r._bad is null").select(*[F.col("r")[f.name].alias(f.name) for f in schema]), rows.where("r._bad is not null").select(F.col("item").alias("_bad"))


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None, required: list[str] = (), index: bool = False) -> DataFrame:
    """CSV with a header; missing required columns raise; index drops the first column."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if lacking := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns missing in {path}: {', '.join(lacking)}")
    return df.drop(df.columns[0]) if index else df


def wide_vectors(spark: SparkSession, path: str, key: str = "dataset_id") -> DataFrame:
    """A parquet file of one column for each dimension; the first column must be the key."""
    df = spark.read.parquet(path)
    if df.columns[0] != key:
        raise ValueError(f"the first column must be {key}")
    return df.select(key, F.array(*[F.col(f"`{c}`").cast("float") for c in df.columns[1:]]).alias("embedding"))


def vectors(spark: SparkSession, path: str, where: dict[str, str] | None = None) -> DataFrame:
    """Vectors, those whose metadata have the given values."""
    df = spark.read.parquet(path)
    for k, v in (where or {}).items():
        df = df.where(F.col("metadata")[k] == v)
    return df


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, stem, length, modified for each file; contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return df.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), "length", F.col("modificationTime").alias("modified"))


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return df.select("path", F.md5("content").alias("file_hash"), F.sha2("content", 256).alias("sha256"))


Parser = Callable[[bytes], list[str]]


def pages(spark: SparkSession, path: str, parsers: list[Parser], pattern: str = "*.pdf") -> DataFrame:
    """path, pages, parser (its place; null: none could), error. Parsers are tried in order; no pages or only blank
    ones count as a failure. A file that fails is a row with an error, not a failed job."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, content in zip(batch["path"], batch["content"]):
                got, used, errors = None, None, []
                for n, parser in enumerate(parsers):
                    try:
                        found = parser(bytes(content))
                        if any(x.strip() for x in found):
                            got, used = found, n
                            break
                        errors.append(f"{n}: empty")
                    except Exception as e:  # a broken file is a result
                        errors.append(f"{n}: {e}")
                out.append((p, got, used, "; ".join(errors) or None))
            yield pd.DataFrame(out, columns=["path", "pages", "parser", "error"]).astype({"parser": "Int32"})

    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return df.mapInPandas(run, "path string, pages array<string>, parser int, error string")


def form_feed_pages(content: bytes) -> list[str]:
    """Pages of extracted plain text, parted by form feeds; blank pages are kept, so numbers stay right."""
    return content.decode("utf-8", "replace").split("\f")


def pdf_parsers() -> list[Parser]:
    """The PDF parsers that are installed, in the order in which to try them; pages() tries the next where one fails or finds no text."""
    out: list[Parser] = []
    try:
        import fitz

        out.append(lambda content: [p.get_text() for p in fitz.open(stream=content, filetype="pdf")])
    except ImportError:
        pass
    try:
        from pdfminer.high_level import extract_text

        out.append(lambda content: form_feed_pages(extract_text(io.BytesIO(content)).removesuffix("\f").encode()))
    except ImportError:
        pass
    return out


def with_recognition(parser: Parser, render: Callable[[bytes, int], bytes], readers: list[Callable[[bytes], str]]) -> Parser:
    """A parser that reads blank pages from their pictures: render(content, page from 0) draws one, and the readers are tried in order until one
    finds text. A reader that fails counts as one that finds none. Pages that stay blank are kept, so numbers stay right."""
    def read(content: bytes, page: int) -> str:
        picture = render(content, page)
        for reader in readers:
            try:
                if (found := reader(picture)) and found.strip():
                    return found
            except Exception:  # the next reader may do better
                continue
        return ""

    return lambda content: [p if p.strip() else read(content, n) for n, p in enumerate(parser(content))]


def element_pages(elements: DataFrame) -> DataFrame:
    """path, page, ordinal, text -> path, pages: blocks joined by blank lines."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n\n")
    by_page = elements.groupBy("path", "page").agg(joined("text").alias("text"))
    return by_page.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]).alias("pages"))


def splice_pages(original: str, other: str, candidates: str):
    """Pages with the candidates (numbers from 1) taken from another reading; cut to the shorter list."""
    n = F.least(F.size(original), F.size(other))
    return F.transform(F.slice(F.col(original), F.lit(1), n), lambda x, i: F.when(F.array_contains(candidates, i + 1), F.get(F.col(other), i)).otherwise(x))


def candidate_pages(documents: DataFrame, key: str, column: str, words: str, share: float = 0.35) -> DataFrame:
    """key, page (from 1): pages that are not blank and lie in the last `share` or match a pattern."""
    rows = documents.select(key, F.size(column).alias("n"), F.posexplode(column).alias("i", "text"))
    late = F.col("i") >= F.floor(F.col("n") * (1 - share))
    return rows.where((F.trim("text") != "") & (late | F.col("text").rlike(words))).select(key, (F.col("i") + 1).alias("page"))


def xml_text(rows: DataFrame, column: str) -> DataFrame:
    """rows with text: all text nodes, stripped, joined by a blank, cleaned; and format. Broken XML has its tags stripped."""
    @F.pandas_udf("string")
    def nodes(xml: pd.Series) -> pd.Series:
        def of(x: str | None) -> str | None:
            try:
                return None if x is None else " ".join(t.strip() for t in ET.fromstring(x).itertext() if t.strip())
            except ET.ParseError:
                return None
        return xml.map(of)

    stripped = F.regexp_replace(F.col(column), "(?s)<[^>]*>", " ")
    return rows.withColumn("text", clean_page(F.coalesce(nodes(column), stripped))).withColumn("format", xml_format(column))


_SECTION = T.ArrayType(T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("level", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("kind", "title", "text")]]))


@F.pandas_udf(_SECTION)
def xml_sections(xml: pd.Series) -> pd.Series:
    """Sections of TEI (abstract and divisions) and JATS (abstract and nested sections, each once); else one whole section."""
    def name(e: ET.Element) -> str:
        return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""

    def own_text(e: ET.Element, nested: tuple[str, ...]) -> str:
        parts = [e.text or ""]
        for c in e:
            parts += [] if name(c) in (*nested, "title", "head") else [" ".join(c.itertext())]
            parts.append(c.tail or "")
        return " ".join(" ".join(parts).split())

    def of(x: str | None) -> list[dict]:
        try:
            root = ET.fromstring(x or "")
        except ET.ParseError:
            return []
        out: list[dict] = []

        def walk(e: ET.Element, level: int) -> None:
            for c in e:
                if name(c) in ("abstract", "sec", "div"):
                    title = next((" ".join(" ".join(t.itertext()).split()) for t in c if name(t) in ("title", "head")), "")
                    kind = c.get("type") or c.get("sec-type") or ("abstract" if name(c) == "abstract" else title)
                    out.append({"ordinal": len(out), "level": level, "kind": kind, "title": title, "text": own_text(c, ("sec", "div"))})
                    walk(c, level + 1)
                else:
                    walk(c, level)

        walk(root, 1)
        return out or [{"ordinal": 0, "level": 1, "kind": "other", "title": "Full Document", "text": " ".join(" ".join(root.itertext()).split())}]

    return xml.map(of)


def config(path: str, required: tuple[str, ...] = ("vector_store",)) -> dict:
    """Settings of a JSON file (or YAML, if a reader is installed)."""
    with open(path) as f:
        if path.endswith(".json"):
            out = json.load(f)
        else:
            import yaml

            out = yaml.safe_load(f)
    if lacking := [k for k in required if k not in out]:
        raise KeyError(f"settings missing in {path}: {', '.join(lacking)}")
    return out


def too_broad(pattern: str, ordinary: tuple[str, ...] = ("the", "results", "2020", "table 1", "data")) -> bool:
    """Whether a pattern matches ordinary words."""
    import re

    return any(re.fullmatch(pattern.replace(r"\b", ""), w) for w in ordinary)


def pattern_table(patterns: dict[str, str]) -> dict[str, str]:
    """Anchored patterns as word-bounded ones, without those that are too broad."""
    bounded = {k: rf"\b{p.removeprefix('^').removesuffix('$')}\b" for k, p in patterns.items()}
    return {k: p for k, p in bounded.items() if not too_broad(p)}


def registry(spark: SparkSession, path: str) -> dict[str, str]:
    """Patterns of a registry file, JSON of name -> {"pattern": ...}: anchored ones word-bounded, without those that are too broad. A
    registry is a stated, small table: its patterns become expressions."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<pattern: string>>")).alias("name", "entry"))
    return pattern_table({r["name"]: r["pattern"] for r in entries.select("name", "entry.pattern").where("pattern is not null").collect()})


def docx_pages(content: bytes) -> list[str]:
    """Paragraphs of a word-processor file, as one page."""
    import zipfile

    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    return ["\n".join("".join(t.text or "" for t in p.iter() if name(t) == "t") for p in root.iter() if name(p) == "p")]


def xlsx_pages(content: bytes) -> list[str]:
    """Sheets of a spreadsheet, a page each: cells parted by tabs, rows by line ends."""
    import re
    import zipfile

    z = zipfile.ZipFile(io.BytesIO(content))
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter() if name(t) == "t") for s in ET.fromstring(z.read("xl/sharedStrings.xml")) if name(s) == "si"]
    out = []
    for sheet in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1])):
        rows = []
        for row in (e for e in ET.fromstring(z.read(sheet)).iter() if name(e) == "row"):
            cells = []
            for c in row:
                value = "".join(t.text or "" for t in c.iter() if name(t) in ("v", "t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            rows.append("\t".join(cells))
        out.append("\n".join(rows))
    return out


#: Parsers of office files by extension.
OFFICE = {"docx": docx_pages, "xlsx": xlsx_pages}


def office(spark: SparkSession, path: str) -> DataFrame:
    """pages() of all office files in a folder, each kind by its parser."""
    out = None
    for kind, parser in OFFICE.items():
        df = pages(spark, path, [parser], f"*.{kind}")
        out = df if out is None else out.union(df)
    return out
