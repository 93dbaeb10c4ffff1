"""Directory scans, and texts and images of the files found."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXCLUDED_DIRS, IMAGE_EXTENSIONS, TEXT_EXTENSIONS, EngineConfig
from ..session import ship
from . import readers


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def allowed(path: Column, size: Column, extensions: tuple[str, ...] = TEXT_EXTENSIONS, most: int = EngineConfig.max_file_bytes) -> Column:
    """Of a known kind, not over the size limit, and in no folder that is left out."""
    dirs = F.split(path, r"[/\\]")
    kept = ~F.arrays_overlap(F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0))), F.array(*map(F.lit, EXCLUDED_DIRS)))
    return extension(path).isin(*extensions) & (size <= most) & kept


def relative(path: Column, root: str) -> Column:
    """The path below a root folder, which may be given with or without a scheme."""
    bare = urlparse(root).path if "://" in root or root.startswith("file:") else root
    return F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), "^" + "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in bare.rstrip("/")) + "/", "")


def folders(spark: SparkSession, root: str) -> list[str]:
    """The folders at and below a root, without those that are left out; a root that is a file stands for itself. Names only, as any listing holds them."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    if fs.getFileStatus(at).isFile():
        return [root]
    out, todo = [], [at]
    while todo:
        folder = todo.pop()
        out.append(folder.toString())
        try:
            todo += [s.getPath() for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName() not in EXCLUDED_DIRS]
        except Exception:  # noqa: BLE001  a folder that can't be read is skipped
            continue
    return sorted(out)


def _glob(extensions: tuple[str, ...]) -> str:
    """File names with these endings, in either letter case."""
    return "{" + ",".join("*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x) for x in extensions) + "}"


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = TEXT_EXTENSIONS, c: EngineConfig = EngineConfig(), content: bool = True) -> DataFrame:
    """(path, source, size, modified[, content]) of the files below a folder, recursively; source is the relative path.

    Unreadable files are skipped. Folders that are left out aren't listed, files of other kinds are dropped by name and too large
    ones by size before anything is read; without ``content`` nothing is. A root that doesn't exist has no files.
    """
    ship(spark)
    at = folders(spark, root)
    schema = "path string, modificationTime timestamp, length long, content binary"
    if at:
        files = spark.read.format("binaryFile").option("pathGlobFilter", _glob(extensions)).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(at)
    else:
        files = spark.createDataFrame([], schema)
    rows = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return rows.filter((F.col("size") <= c.max_file_bytes) & allowed(relative(F.col("path"), root), F.col("size"), extensions, c.max_file_bytes)).withColumn("source", relative(F.col("path"), root))


def read_files(spark: SparkSession, paths: list[str], extensions: tuple[str, ...] = TEXT_EXTENSIONS, c: EngineConfig = EngineConfig()) -> DataFrame:
    """(path, size, content) of named files of known kinds and sizes; missing ones are skipped."""
    jvm = spark.sparkContext._jvm
    fs = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    there = [p.toString() for p in fs if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)]
    if not there:
        return spark.createDataFrame([], "path string, size long, content binary")
    files = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(there)
    return files.filter((F.col("length") <= c.max_file_bytes) & extension(F.col("path")).isin(*extensions)).select("path", F.col("length").alias("size"), "content")


def scan_images(spark: SparkSession, root: str, c: EngineConfig = EngineConfig()) -> DataFrame:
    """(image_path, file_name, source_doc, mtime_ns) of the images below a folder."""
    x = scan(spark, root, IMAGE_EXTENSIONS, c, content=False)
    parts = F.split("source", "/")
    return x.select(F.col("source").alias("image_path"), F.element_at(parts, -1).alias("file_name"), F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("").alias("source_doc"), (F.unix_micros("modified") * 1000).alias("mtime_ns"))


def texts(files: DataFrame, pdf: list[readers.Plugin] = (), recognise: readers.Plugin | None = None, needs=None) -> DataFrame:
    """(source, text, markdown) of scanned files; files that can't be read give an empty text."""

    def run(batches):
        for b in batches:
            got = [readers.extract(s, d or b"", pdf, recognise, needs) for s, d in zip(b.column("source").to_pylist(), b.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("source"), pa.array([t for t, _ in got], pa.string()), pa.array([m for _, m in got])], names=["source", "text", "markdown"])

    return files.select("source", "content").mapInArrow(run, "source string, text string, markdown boolean")


def pages(html: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, title, text) of fetched pages; null pages give the title and address only."""

    def run(batches):
        for b in batches:
            urls = b.column("url").to_pylist()
            got = [readers.page_content(h or "", u or "") for h, u in zip(b.column("html").to_pylist(), urls)]
            yield pa.RecordBatch.from_arrays([b.column("url"), pa.array([t for t, _ in got], pa.string()), pa.array([x for _, x in got], pa.string())], names=["url", "title", "text"])

    return html.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "url string, title string, text string")


def fetch(url: str, timeout: int = 30) -> str:
    """The HTML of one address; raises on any error."""
    import urllib.request

    if not url.startswith(("http://", "https://")):
        raise ValueError(f"not a web address: {url}")
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (compatible; lodestone)"}), timeout=timeout) as r:
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


def page_ranges(documents: DataFrame, most: int = 200) -> DataFrame:
    """(id, segment, first_page, last_page): the pages of each document (id, pages) in ranges of at most ``most``; without pages no row."""
    n = F.ceil(F.col("pages") / most)
    x = documents.filter("pages > 0").select("id", "pages", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("segment"))
    return x.select("id", "segment", (F.col("segment") * most + 1).alias("first_page"), F.least((F.col("segment") + 1) * most, F.col("pages")).cast("long").alias("last_page"))


def fit_ranges(first: int, last: int, size_of, most_bytes: int) -> list[tuple[int, int]]:
    """Halves a range of pages until each part is within the size; a single page over it is an error. size_of(first, last) gives bytes."""
    if size_of(first, last) <= most_bytes:
        return [(first, last)]
    if first == last:
        raise ValueError(f"page {first} alone is over the limit")
    middle = (first + last) // 2
    return fit_ranges(first, middle, size_of, most_bytes) + fit_ranges(middle + 1, last, size_of, most_bytes)


def local_path(uri: str) -> str:
    return unquote(urlparse(uri).path) if uri.startswith("file:") else uri
