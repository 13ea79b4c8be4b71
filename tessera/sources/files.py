"""Source folders as a table of documents."""

from __future__ import annotations

import importlib.util
import re
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import chats, markup

# What is read, and what is noise.
PLAIN, HTML, ORG, BINARY = (".md", ".txt"), (".html", ".htm"), (".org", ".org_archive"), (".pdf", ".docx")
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".webp", ".tiff")
NOISE, CHAT_EXPORTS = ("desktop.ini", "thumbs.db"), ("conversations.json",)

_DOC = "array<struct<path:string,content:string,tags:string>>"


def supported_suffixes() -> list[str]:
    """Image suffixes are read if the optional OCR package is there."""
    return sorted({*PLAIN, *HTML, *ORG, *BINARY} | (set(IMAGES) if importlib.util.find_spec("rapidocr_onnxruntime") else set()))


def readable(name: str) -> bool:
    return name.lower() in CHAT_EXPORTS or name.lower().endswith(tuple(supported_suffixes()))


def optional_readers() -> dict[str, bool]:
    """Kinds of files that need a package of their own, and whether it is there."""
    there = lambda m: importlib.util.find_spec(m) is not None
    return {"pdf": there("pypdf"), "images": there("rapidocr_onnxruntime"), "docx": True}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _pdf(raw: bytes) -> str | None:
    try:
        import pypdf
    except ImportError:
        return None
    import io

    try:
        return "\n\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(raw)).pages)
    except Exception:  # a file that the reader can't read is left out
        return None


def _ocr(raw: bytes) -> str | None:
    try:
        from rapidocr_onnxruntime import RapidOCR
    except ImportError:
        return None
    found, _ = RapidOCR()(raw)
    return "\n".join(x[1] for x in found) if found else None


def to_text(name: str, raw: bytes) -> str | None:
    """The Markdown of a file that is parsed as a whole, by its suffix; None if it can't be read."""
    kind = "." + name.lower().rpartition(".")[2]
    if kind in HTML:
        html = markup.decode_html(raw)
        return None if html is None else markup.html_to_markdown(html)
    return {".docx": markup.docx_to_text, ".pdf": _pdf}.get(kind, _ocr if kind in IMAGES else lambda _: None)(raw)


def _parse(names: pa.Array, contents: pa.Array) -> pa.Array:
    return pa.array([None if raw is None else to_text(name, raw) for name, raw in zip(names.to_pylist(), contents.to_pylist(), strict=True)], pa.string())


def decoded(path: Column, content: Column) -> Column:
    """array<struct<path, content, tags>> of a file's documents: text, notes and chat exports by
    column expressions, all else by a parser that gets only such files' bytes."""
    name = F.substring_index(path, "/", -1)
    chat, kind = F.lower(name).isin(*CHAT_EXPORTS), suffix(path)
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    parsed = F.arrow_udf(_parse, "string")(name, F.when(~chat & ~kind.isin(*PLAIN, *ORG), content))
    whole = F.when(kind.isin(*PLAIN), text).when(kind.isin(*ORG), chats.org_to_markdown(text)).otherwise(parsed)
    one = F.filter(F.array(F.struct(path.alias("path"), whole.alias("content"), F.lit(None).cast("string").alias("tags"))), lambda d: T.strip(d["content"]) != "")
    many = F.transform(chats.conversations(F.when(chat, text)), lambda c: F.struct(F.concat(path, F.lit("::"), c["title"]).alias("path"), c["content"].alias("content"), F.lit("chatlog").alias("tags")))
    return F.when(chat, F.coalesce(many, F.expr(f"CAST(array() AS {_DOC})"))).otherwise(one)


def plain_path(uri: Column) -> Column:
    return F.url_decode(F.replace(F.regexp_replace(uri, r"^file:/*", "/"), F.lit("+"), F.lit("%2B")))


def wanted(path: Column, root: str) -> Column:
    """Neither in a hidden folder below the root nor noise, and of a kind that is read."""
    below = F.substring(path, len(root.rstrip("/")) + 2, 1 << 20)
    name = F.substring_index(path, "/", -1)
    hidden = F.exists(F.slice(F.split(below, "/"), F.lit(1), F.greatest(F.size(F.split(below, "/")) - 1, F.lit(0))), lambda p: p.startswith("."))
    noise = name.startswith("~$") | name.startswith("._") | F.lower(name).isin(*NOISE)
    return ~hidden & ~noise & (suffix(path).isin(*supported_suffixes()) | F.lower(name).isin(*CHAT_EXPORTS))


def documents_of(read: DataFrame) -> DataFrame:
    """path, content, hash, tags, links, mtime, chunk_size, chunk_overlap of decoded files (path, raw text, …)."""
    text = F.col("raw")
    meta = T.front_matter(text)
    body = T.body(text)
    tags = F.coalesce(F.col("given_tags"), F.when(meta["tags"].isNull(), F.lit("")).otherwise(T.tag_list(meta["tags"])))
    chat = F.col("given_tags").isNotNull()
    return read.select(
        "path",
        F.when(chat, text).otherwise(body).alias("content"),
        T.file_hash(text).alias("hash"),
        tags.alias("tags"),
        F.when(chat, F.lit("")).otherwise(T.wikilinks(body)).alias("links"),
        "mtime",
        "chunk_size",
        "chunk_overlap",
    )


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store Spark reads."""
    fs, p = _hadoop(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def _left_out(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """(folders, files) below a root whose names begin with _, which Spark's listing leaves out."""
    fs, p = _hadoop(spark, root)
    folders, files = [], []
    if not fs.exists(p):
        return folders, files
    if fs.getFileStatus(p).isFile():
        return folders, [root] if p.getName().startswith("_") else files
    at = re.sub(r"([\\*?\[\]{}])", r"\\\1", root)
    for _ in range(100):
        glob = lambda name: fs.globStatus(_hadoop(spark, f"{at}/{name}")[1]) or []  # noqa: B023,E731
        for s in glob("_*"):
            (folders if s.isDirectory() else files).append(s.getPath().toString())
        at += "/*"
        if not len(glob("")):
            break
    return folders, files


def _binary(spark: SparkSession, root: str) -> DataFrame:
    """path, content, modificationTime, length of all files below a root."""
    folders, alone = _left_out(spark, root)
    listed = spark.read.format("binaryFile").options(recursiveFileLookup=True, __globPaths__=False)
    out = listed.load(root) if root not in alone else None
    for f in folders:
        out = out.unionByName(listed.load(f))
    if alone:  # no reader of Spark takes such a name, so the driver reads these files one by one
        util, rows = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils, []
        for f in alone:
            fs, p = _hadoop(spark, f)
            stream, status = fs.open(p), fs.getFileStatus(p)
            raw = bytes(util.readFullyToByteArray(stream)) if status.getLen() else b""
            stream.close()
            rows.append((f, raw, datetime.fromtimestamp(status.getModificationTime() / 1000), status.getLen()))
        more = spark.createDataFrame(rows, "path string, content binary, modificationTime timestamp, length long")
        out = more if out is None else out.select(more.columns).unionByName(more)
    return out.select("path", "content", "modificationTime", "length")


def scan(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Documents of source folders ({path, chunk_size?, chunk_overlap?}); of a file in
    two sources the first counts.  Listing and reading are Spark's binaryFile source."""
    found = None
    for i, s in enumerate(sources):
        root = str(s["path"]).rstrip("/")
        bare = root.removeprefix("file://")
        one = (
            _binary(spark, root)
            .select(plain_path(F.col("path")).alias("path"), "content", F.col("modificationTime").cast("double").alias("mtime"))
            .where(wanted(F.col("path"), bare))
            .select("path", "content", "mtime", F.lit(i).alias("nth"), F.lit(s.get("chunk_size")).cast("int").alias("chunk_size"), F.lit(s.get("chunk_overlap")).cast("int").alias("chunk_overlap"))
        )
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "path string, content string, hash string, tags string, links string, mtime double, chunk_size int, chunk_overlap int")
    if len(sources) > 1:
        found = found.groupBy("path").agg(F.min_by(F.struct("content", "mtime", "nth", "chunk_size", "chunk_overlap"), "nth").alias("f")).select("path", "f.*")
    read = found.select(F.explode(decoded(F.col("path"), F.col("content"))).alias("d"), "mtime", "chunk_size", "chunk_overlap")
    return documents_of(read.select(F.col("d.path").alias("path"), F.col("d.content").alias("raw"), F.col("d.tags").alias("given_tags"), "mtime", "chunk_size", "chunk_overlap"))


def raw_notes(spark: SparkSession, root: str) -> DataFrame:
    """path, text, mtime of the Markdown files below a root, as they stand; bytes that are no UTF-8 are replaced."""
    read = _binary(spark, root.rstrip("/")).select(plain_path(F.col("path")).alias("path"), "content", F.col("modificationTime").cast("double").alias("mtime"))
    below = F.substring("path", len(root.rstrip("/").removeprefix("file://")) + 2, 1 << 20)
    kept = read.where(suffix(F.col("path")).isin(".md", ".markdown") & ~below.rlike(r"(?:^|/)\.") & ~F.substring_index("path", "/", -1).startswith("~$"))
    return kept.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "mtime")


def load_one(spark: SparkSession, path: str, chunk_size: int | None = None, chunk_overlap: int | None = None) -> DataFrame:
    """The document of one file; no row if there is nothing but front matter."""
    docs = scan(spark, [{"path": path, "chunk_size": chunk_size, "chunk_overlap": chunk_overlap}])
    return docs.where(T.strip(F.col("content")) != "")
