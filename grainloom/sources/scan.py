"""Scans: CSV, JSON and object folders, databases, HTTP pages, and a manifest of them."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import Refused
from ..state import shared_dir
from .infer import infer, typed


def csv(spark: SparkSession, path: str, types: bool = True) -> DataFrame:
    """A header and rows; all values are looked at for the types."""
    text = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("multiLine", False).csv(path)
    return typed(text, infer(text)) if types else text


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested fields as a_b, arrays as JSON text, names that begin with two underscores dropped."""

    def leaves(schema: T.StructType, at: str, name: str) -> Iterator:
        for f in schema.fields:
            if f.name.startswith("__"):
                continue
            col, own = f"{at}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, f"{col}.", f"{own}{separator}")
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                yield F.to_json(F.col(col)).alias(own)
            else:
                yield F.col(col).alias(own)

    return df.select(*leaves(df.schema, "", ""))


def json_rows(spark: SparkSession, path: str, record_path: str | None = None) -> DataFrame:
    """Records of JSON lines, or of the array at record_path (a.b) of whole documents: a missing key is an error, null has no records."""
    if record_path is None:
        return flatten(spark.read.json(path))
    docs = spark.read.option("multiLine", True).json(path)
    at: T.DataType = docs.schema
    for part in record_path.split("."):
        if not isinstance(at, T.StructType) or part not in at.names:
            raise Refused(f"no {record_path!r} in {path}")
        at = at[part].dataType
    if not isinstance(at, T.ArrayType):
        return flatten(docs.select(F.inline(F.array(f"{record_path}.*"))).limit(0))
    return flatten(docs.select(F.explode(F.col(record_path)).alias("r")).select("r.*"))


def objects(spark: SparkSession, prefix: str) -> DataFrame:
    """CSV, JSON and JSONL files of a folder with the union of their columns, all text, and the file of each row."""
    parts = []
    for kind in ("csv", "json", "jsonl"):
        reader = spark.read.option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", True)
        try:
            df = reader.option("header", True).csv(prefix) if kind == "csv" else reader.option("multiLine", kind == "json").json(prefix)
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # no such files
                raise
            continue
        flat = flatten(df.withColumn("_object", F.col("_metadata.file_path")))
        parts.append(flat.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in flat.columns)))
    if not parts:
        raise Refused(f"no CSV or JSON files under {prefix}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of a database whose driver is on the class path; give partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()


def jdbc_options(url: str, query: str, **options: str) -> dict[str, str]:
    """The query as a table, since Spark's query option and partitionColumn rule each other out."""
    parallel = [x for x in ("partitionColumn", "lowerBound", "upperBound", "numPartitions") if x in options]
    if parallel and len(parallel) < 4:
        raise Refused(f"a parallel read needs all of partitionColumn, lowerBound, upperBound and numPartitions; it has {', '.join(parallel)}")
    return {"url": url, "dbtable": f"({query.strip().rstrip(';')}) source", **options}


def kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A bounded read of a topic: value as text with its offset and key; needs the connector on the class path."""
    df = spark.read.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "endingOffsets": "latest", **options}).load()
    return df.select(F.col("value").cast("string").alias("value"), F.col("offset").alias("_offset"), F.col("key").cast("string").alias("_key"))


def since(df: DataFrame, cursor: str, last: str | None) -> DataFrame:
    """Rows after the last cursor, compared as text; rows without a cursor are kept."""
    if last is None:
        return df
    c = F.col(cursor).cast("string")
    return df.where((c > last) | c.isNull() | (c == ""))


def next_page(how: str, url: str, page: dict, n: int, size: int, options: dict[str, str]) -> str | None:
    """Where the next page is; a link to another host is refused. By offset and page, one with fewer rows than size is the last; 0 if only an empty one is."""
    at = urllib.parse.urlsplit(url)
    if how == "none" or (how in ("offset", "page") and n < max(1, size)):
        return None
    if how == "odata":
        to = page.get("@odata.nextLink") or page.get("odata.nextLink")
        to = urllib.parse.urljoin(url, to) if to else None
        if to and urllib.parse.urlsplit(to).netloc != at.netloc:
            raise Refused(f"the next page is on another host: {to}")
        return to
    query = dict(urllib.parse.parse_qsl(at.query))
    if how == "cursor":
        token = page.get(options.get("cursor_field", "next_cursor"))
        if not token or not n:
            return None
        query[options.get("cursor_param", "cursor")] = str(token)
    elif how == "offset":
        name = options.get("offset_param", "offset")
        query[name] = str(int(query.get(name, 0)) + n)
    elif how == "page":
        name = options.get("page_param", "page")
        query[name] = str(int(query.get(name, 1)) + 1)
    else:
        raise Refused(f"unknown pagination {how!r}")
    return urllib.parse.urlunsplit(at._replace(query=urllib.parse.urlencode(query)))


def fetched(url: str, headers: dict[str, str], tries: int = 4, wait: Callable[[float], None] = time.sleep) -> bytes:
    """A page; 429 and 5xx are tried again, after as long as the host asks for."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500 or k == tries - 1:
                raise
            after = e.headers.get("Retry-After", "")
            wait(float(after) if after.isdigit() else 0.25 * 2**k)
    raise AssertionError


class HttpPages(DataSource):
    """Records of a paged JSON interface as rows (page, record JSON). Option urls: one start for each partition, by lines.

    By offset and page, pages are read until one is empty; if page_size is given and a page has had that size, until one has less.
    A read that would have to end before the last page, at max_pages or since a link leads back, is refused.
    """

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "page int, record string"

    def reader(self, schema) -> HttpReader:
        return HttpReader(dict(self.options))


class HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.options["urls"].split("\n") if u.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        o = self.options
        headers = {"Accept": "application/json"}
        if "bearer" in o:
            headers["Authorization"] = f"Bearer {o['bearer']}"
        if "header" in o:
            k, _, v = o["header"].partition(":")
            headers[k.strip()] = v.strip()
        url, n, seen = partition.value, 0, set()
        most, size, full = int(o.get("max_pages", "100000")), int(o.get("page_size", "0")), False
        pause = 1 / float(o.get("requests_per_second", "4"))
        while url:
            if url in seen:
                raise Refused(f"the pages lead back to {url}: the rows are incomplete")
            seen.add(url)
            page = json.loads(fetched(url, headers))
            rows = page
            for part in [x for x in o.get("record_path", "").split(".") if x]:
                if not isinstance(rows, dict) or part not in rows:
                    raise Refused(f"no {o['record_path']!r} in {url}")
                rows = rows[part]
            rows = rows if isinstance(rows, list) else [] if rows is None else [rows]
            if rows and n >= most:
                raise Refused(f"more than max_pages={most} pages at {partition.value}: the rows are incomplete")
            for r in rows:
                yield n, json.dumps(r)
            n += 1
            full = full or len(rows) >= size
            url = next_page(o.get("pagination", "none"), url, page if isinstance(page, dict) else {}, len(rows), size if full else 0, o)
            time.sleep(pause if url else 0)


def http(spark: SparkSession, urls: list[str], **options: str) -> DataFrame:
    """Records of the pages as flat columns of text and numbers; the schema is the union over all records.

    Pages are fetched once: the records are written to the shared folder before their schema is read.
    """
    spark.dataSource.register(HttpPages)
    rows = spark.read.format("http_pages").options(urls="\n".join(urls), **options).load()
    path = f"{shared_dir(spark)}/http-{uuid.uuid4().hex}"
    rows.select("record").write.text(path)
    return flatten(spark.read.json(path))


FACTORIES: dict[str, Callable[..., DataFrame]] = {
    "csv": csv,
    "json": json_rows,
    "jsonl": json_rows,
    "s3": objects,
    "objects": objects,
    "jdbc": jdbc,
    "mysql": jdbc,
    "mssql": jdbc,
    "kafka": kafka,
    "http": http,
    "odata": lambda spark, urls, **o: http(spark, urls, pagination="odata", record_path="value", **o),
}


def manifest(path: str, env: dict[str, str] | None = None) -> list[dict]:
    """Sources of a YAML list; ${NAME} stands for the environment, and one that isn't set is an error."""
    env = dict(os.environ) if env is None else env

    def value(m: re.Match) -> str:
        if m[1] not in env:
            raise Refused(f"{m[1]} isn't set")
        return env[m[1]]

    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(re.sub(r"\$\{(\w+)\}", value, f.read())) or {}
    out = doc.get("sources") or []
    for s in out:
        if not s.get("name") or s.get("type") not in FACTORIES:
            raise Refused(f"source {s.get('name')!r}: unknown type {s.get('type')!r}")
    return out


def opened(spark: SparkSession, source: dict) -> DataFrame:
    return FACTORIES[source["type"]](spark, **(source.get("config") or {}))
