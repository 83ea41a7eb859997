"""Files as tables: a recursive scan, readers by extension, and what a corpus leaves out and why.

A reader never gives an empty text for a file that it could not read: every row carries a status, and ``require_read``
fails the job on the rows that no reader took.
"""

from __future__ import annotations

import importlib.util
import io
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestia.functions import text as T
from attestia.operators import provenance

# Extensions of sources, those whose text an engine must extract, and those of drafts.
EXTENSIONS = (".txt", ".xml", ".md", ".html", ".htm", ".pdf", ".docx", ".doc")
EXTRACTED = (".pdf", ".docx", ".doc")
DRAFTS = (".md", ".txt", ".docx")
# Characters below which a text layer is none, characters of a page, and pages from which these are asked.
LEAST_TEXT, LEAST_PAGE, PAGES = 200, 40, 3
#: Part of the key of cached texts: raise it whenever a reader changes what it gives.
READER_VERSION = 1
#: Parts of a DOCX package that hold text, beside its body.
DOCX_PARTS = ("document", "footnote", "endnote", "header", "footer")
READ = "text string, status string, reason string, form boolean, pages int"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def walk(spark: SparkSession, roots: list[str], extensions: tuple[str, ...] = EXTENSIONS, skip_dirs: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, ext, modificationTime, length, content) of the files under the roots, each path once.

    Left out are folders that are named or begin with a dot, lock files (``~$``) and other extensions. A root that is not
    there gives no rows. Contents are read only where a later plan asks for them.
    """
    there = [r for r in map(lambda r: _qualified(spark, r), roots) if r]
    if not there:
        return spark.createDataFrame([], "path string, name string, ext string, modificationTime timestamp, length long, content binary")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there)
    # a scan leaves out files without a byte, the listing does not
    listed = [(unquote(p).replace("file:///", "file:/"),) for p in found.inputFiles()]
    empty = spark.createDataFrame(listed, "path string").join(found.select("path"), "path", "left_anti")
    found = found.unionByName(empty.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
    named = found.select("path", base_name(F.col("path")).alias("name"), extension(F.col("path")).alias("ext"), "modificationTime", "length", "content")
    below = F.lit(False)
    for root in there:  # only folders below a root count
        folders = F.split(F.regexp_extract(F.substring("path", len(root) + 2, 1 << 20), "^(.*)/[^/]*$", 1), "/")
        below |= (F.col("path") == root) | F.col("path").startswith(root + "/") & ~F.exists(folders, lambda d: d.startswith(".") | d.isin(list(skip_dirs)))
    return named.where(below & F.col("ext").isin(*extensions) & ~F.col("name").startswith("~$")).dropDuplicates(["path"])


def _qualified(spark: SparkSession, root: str) -> str | None:
    """A root's full path as file listings give it; None where it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(path).getPath().toString() if system.exists(path) else None


def ordered(files: DataFrame) -> DataFrame:
    """files with doc_ord, their number in order of the whole path; a listing of files, so of moderate size."""
    return files.withColumn("doc_ord", F.row_number().over(Window.orderBy("path")).cast("long"))


def engines() -> dict[str, bool]:
    """The optional readers that this machine has."""
    return {name: importlib.util.find_spec(name) is not None for name in ("pypdf", "fitz")}


def docx_text(content: bytes) -> str:
    """The body's paragraphs, then the text of every part that holds some, tables, notes and headers included."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "word/document.xml" in z.namelist():
            body = ElementTree.fromstring(z.read("word/document.xml"))
            out += ["".join(t.text or "" for t in p.iter(f"{word}t")) for p in body.iter(f"{word}p")]
        for name in z.namelist():
            if name.endswith(".xml") and any(part in name for part in DOCX_PARTS):
                out.append(re.sub(r"<[^>]+>", " ", z.read(name).decode("utf-8", "replace")))
    return "\n".join(out)


def docx_light(content: bytes) -> str:
    """The text nodes of a DOCX body, joined by spaces; empty where the package cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return " ".join(re.findall(r"<w:t[^>]*>([^<]*)</w:t>", z.read("word/document.xml").decode("utf-8", "replace")))
    except (zipfile.BadZipFile, KeyError):
        return ""


def form_values(fields: dict) -> str:
    """The filled fields of a form by name; signatures, containers and unticked boxes are no text."""
    told = []
    for name, field in fields.items():
        value = field.get("/V")
        if str(field.get("/FT") or "") != "/Sig" and isinstance(value, (str, int, float)) and str(value).strip() not in ("", "/Off"):
            told.append(f"{name} = {str(value).strip().lstrip('/')}")
    return "\n".join([f"[FORM FIELDS: {len(told)} filled]", *told]) if told else ""


def _pdf(content: bytes) -> tuple:
    """Both engines' texts where both are there, the better one kept; missing engines are a status of their own."""
    texts, form, pages = [], "", 0
    if engines()["pypdf"]:
        import pypdf

        reader = pypdf.PdfReader(io.BytesIO(content))
        pages = len(reader.pages)
        texts.append("\n".join(p.extract_text() or "" for p in reader.pages))
        form = form_values(reader.get_fields() or {})
    if engines()["fitz"]:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            pages = doc.page_count
            texts.append("\n".join(p.get_text() for p in doc))
    if not texts:
        return None, "missing_reader", "no PDF engine: nothing was read", False, None
    best = texts[0] if len(texts) == 1 else chosen(*texts)[0]
    return "\n".join(filter(None, [best, form])), "read", "", bool(form), pages


def _extract(ext: str, content: bytes) -> tuple:
    try:
        if ext == ".pdf":
            return _pdf(content)
        if ext == ".docx":
            return docx_text(content), "read", "", False, None
        return None, "unreadable", f"no reader for {ext}", False, None
    except Exception as e:  # noqa: BLE001 - whatever a broken file does becomes its status
        return None, "unreadable", type(e).__name__, False, None


def chosen(primary: str, other: str) -> tuple[str, str]:
    """``choose`` for two strings."""
    tokens = lambda s: len(re.findall("[A-Za-z]+", s))
    p, o, tp, to = len(primary.strip()), len(other.strip()), tokens(primary), tokens(other)
    if p < LEAST_TEXT <= o:
        return other, "dead"
    if not p or not o:
        return primary, ""
    if o > 1.3 * p and to > 1.3 * tp:
        return other, "truncated"
    if p > 1.3 * o and tp > 1.3 * to:
        return primary, ""
    return (other, "split words") if tp > 1.15 * to else (primary, "")


def choose(primary: Column, other: Column) -> Column:
    """struct(text, reason): which of two extractions of the same pages to keep. A dead one loses; one that lacks over a
    third of characters and tokens is truncated; one with over 1.15 times the tokens has words split."""
    p, o = (F.char_length(T.strip(F.coalesce(c, F.lit("")))) for c in (primary, other))
    tp, to = T.alpha_tokens(primary), T.alpha_tokens(other)
    reason = (
        F.when((p < LEAST_TEXT) & (o >= LEAST_TEXT), "dead").when((p == 0) | (o == 0), "").when((o > p * 1.3) & (to > tp * 1.3), "truncated")
        .when((p > o * 1.3) & (tp > to * 1.3), "").when(tp > to * 1.15, "split words").otherwise("")
    )
    return F.struct(F.when(reason != "", other).otherwise(primary).alias("text"), reason.alias("reason"))


def no_text_layer(text: Column, pages: Column, form: Column) -> Column:
    """A scan or a stub: under 200 characters, or from three pages on under 40 a page; a filled form is neither."""
    n = F.char_length(T.strip(F.coalesce(text, F.lit(""))))
    thin = (F.coalesce(pages, F.lit(0)) >= PAGES) & (n / F.greatest(F.coalesce(pages, F.lit(1)), F.lit(1)) < LEAST_PAGE)
    return ~F.coalesce(form, F.lit(False)) & ((n < LEAST_TEXT) | thin)


def read_any(files: DataFrame) -> DataFrame:
    """(path, name, ext, modificationTime, length, text, status, reason, form, pages) of files of ``walk``.

    status is read, missing_reader or unreadable; text is null unless read. Texts are UTF-8, what is not becomes U+FFFD.
    Markup goes from XML and HTML, links and escapes from Markdown, page marks from all.
    """
    head = ["path", "name", "ext", "modificationTime", "length"]
    plain = files.where(~F.col("ext").isin(*EXTRACTED))
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    marked = F.when(F.col("ext").isin(".xml", ".html", ".htm"), T.html_text(raw)).otherwise(raw)
    text = T.strip_page_marks(marked)
    text = F.when(F.col("ext") == ".md", T.clean_markdown(text)).otherwise(text)
    flat = plain.select(*head, text.alias("text"), F.lit("read").alias("status"), F.lit("").alias("reason"), F.lit(False).alias("form"), F.lit(None).cast("int").alias("pages"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *_extract(e, bytes(c))) for p, e, c in zip(frame["path"], frame["ext"], frame["content"])]
            yield pd.DataFrame(rows, columns=["path", "text", "status", "reason", "form", "pages"]).astype({"pages": "Int32"})

    packed = files.where(F.col("ext").isin(*EXTRACTED))
    read = packed.select("path", "ext", "content").mapInPandas(run, "path string, " + READ)
    return flat.unionByName(packed.select(*head).join(read, "path"))


def require_read(read: DataFrame) -> DataFrame:
    """read as it is, but the job fails on a file for which a reader is missing: that is not a file without text."""
    told = F.concat(F.lit("not read, so nothing in it was examined: "), "path", F.lit(" ("), "reason", F.lit(")"))
    return read.withColumn("status", F.when(F.col("status") == "missing_reader", F.raise_error(told)).otherwise(F.col("status")))


def corpus_text(read: DataFrame) -> DataFrame:
    """read with text as a corpus holds it: without marks of scraping, normalised."""
    return read.withColumn("text", T.normalise(T.strip_scrape(F.col("text"))))


def audit(read: DataFrame, derived: str | None = provenance.DERIVED, stamps: tuple[str, ...] = (provenance.STAMP,)) -> DataFrame:
    """read with bucket and indexed. Buckets: derived (by name, or stamped as output), unreadable, stub (an extracted
    format of under 200 characters), empty, placeholder, short (indexed all the same) and indexed."""
    n = F.char_length(T.strip(F.coalesce(F.col("text"), F.lit(""))))
    ours = provenance.stamped(F.col("text"), stamps)
    if derived:
        ours |= F.col("name").rlike("(?iu)" + derived)
    bucket = (
        F.when(ours, "derived").when(F.col("status") != "read", "unreadable").when(F.col("ext").isin(*EXTRACTED) & (n < LEAST_TEXT), "stub").when(n == 0, "empty")
        .when(provenance.placeholder(F.col("text")), "placeholder").when(n < LEAST_TEXT, "short").otherwise("indexed")
    )
    return read.withColumn("bucket", bucket).withColumn("indexed", F.col("bucket").isin("short", "indexed"))


def advice(audited: DataFrame) -> DataFrame:
    """(bucket, files, advice): what a reader of the audit should do about each bucket."""
    told = {
        "derived": "our own work; it proves nothing", "unreadable": "install the reader, or convert the file", "stub": "run OCR, or fetch another format",
        "empty": "fetch it again", "placeholder": "the download failed; fetch it again", "short": "indexed; look whether it is whole", "indexed": "",
    }
    text = F.create_map(*[F.lit(x) for pair in told.items() for x in pair])[F.col("bucket")]
    return audited.groupBy("bucket").agg(F.count("*").alias("files")).withColumn("advice", text)


def cached(files: DataFrame, cache: str, version: int = READER_VERSION) -> DataFrame:
    """``read_any`` of files with a Parquet cache of extracted texts, keyed by path, time, length and reader version.

    Only files whose key is not there are read; texts of under 200 characters are never cached, as they may be failures.
    """
    spark, key = files.sparkSession, ["path", "modificationTime", "length"]
    if _qualified(spark, cache) is None:
        fresh = read_any(files)
        fresh.where(F.char_length("text") >= LEAST_TEXT).withColumn("version", F.lit(version)).write.parquet(cache)
        return read_any(files)
    held = spark.read.parquet(cache).where(F.col("version") == version).drop("version")
    missing = files.join(held.select(*key), key, "left_anti")
    read_any(missing).where(F.char_length("text") >= LEAST_TEXT).withColumn("version", F.lit(version)).write.mode("append").parquet(cache)
    now = spark.read.parquet(cache).where(F.col("version") == version).drop("version")
    known = now.join(files.select(*key), key, "left_semi")
    return known.unionByName(read_any(files.join(now.select(*key), key, "left_anti")))


def last_answers(events: DataFrame, key: str, order: str) -> DataFrame:
    """(key, text): the text blocks after a conversation's last tool call, joined by line ends.

    events: (key, order, block, kind, text), one row for each block of an answer, of side chains none; kind is text or
    tool_use. Conversations without text after the last call give an empty text.
    """
    place = F.struct(order, "block")
    last = F.max(F.when(F.col("kind") == "tool_use", place)).over(Window.partitionBy(key))
    after = events.withColumn("__last", last).withColumn("__late", F.col("__last").isNull() | (place > F.col("__last")))
    texts = F.collect_list(F.when(F.col("__late") & (F.col("kind") == "text"), F.struct(place.alias("at"), "text")))
    return after.groupBy(key).agg(F.array_join(F.transform(F.array_sort(texts), lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))


def transcript_events(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, block, kind, text) of JSONL transcripts: the blocks of assistants' records that are no side chain."""
    block = "array<struct<type:string,text:string>>"
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    parsed = lines.withColumn("x", F.from_json("value", f"type string, isSidechain boolean, message struct<content:{block}>"))
    own = parsed.where("x.type = 'assistant' AND NOT coalesce(x.isSidechain, false)")
    return own.select("file", "line", F.posexplode("x.message.content").alias("block", "b")).select("file", "line", "block", F.col("b.type").alias("kind"), F.col("b.text").alias("text"))


FIELDS = "file string, engine string, page int, y double, x double, name string, value string, ftype string"


def _fields(engine: str, content: bytes) -> list[tuple]:
    """(page, y, x, name, value, kind) of a form's widgets; only one engine knows where they stand. A ticked box is [X]."""
    if engine == "fitz":
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            return [(p.number + 1, float(w.rect.y0), float(w.rect.x0), w.field_name, _value(w.field_value), w.field_type_string or "?") for p in doc for w in p.widgets() or [] if w.field_name]
    import pypdf

    found = pypdf.PdfReader(io.BytesIO(content)).get_fields() or {}
    kept = [(n, f) for n, f in found.items() if str(f.get("/FT") or "") != "/Sig" and isinstance(f.get("/V") or "", (str, int, float))]
    return [(0, None, None, n, _value(f.get("/V")), str(f.get("/FT") or "?")) for n, f in kept]


def _value(v) -> str:
    text = "" if v is None else str(v).removeprefix("/")
    return {"true": "[X]", "false": "", "off": ""}.get(text.lower(), text)


def form_fields(files: DataFrame, engine: str) -> DataFrame:
    """(file, engine, page, y, x, name, value, ftype) of the widgets of PDF forms, by one of the engines pypdf and fitz.

    Files of one name in several folders are read once, the first by path; a file that cannot be read has one row whose
    kind is READ_ERROR; an engine that is not there is an error, as a form without fields would be a false finding.
    """
    if not engines()[engine]:
        raise ModuleNotFoundError(f"{engine} is not installed: no form was read")
    first = files.where(F.col("ext") == ".pdf").groupBy("name").agg(F.min_by(F.struct("path", "content"), "path").alias("x")).select("name", "x.content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["name"], frame["content"]):
                try:
                    rows += [(name, engine, *f) for f in _fields(engine, bytes(content))]
                except Exception as e:  # noqa: BLE001 - whatever a broken form does becomes its row
                    rows.append((name, engine, 0, None, None, "", type(e).__name__, "READ_ERROR"))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FIELDS.split(", ")])

    return first.mapInPandas(run, FIELDS)


META = "url string, sha256 string, trust string, model_in_path boolean, address string, fetched_at string"


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, text, sha256, url, claimed_trust, model_in_path, address) of landed files, each with what the file
    beside it (``name.meta.json``) says; without one, nothing is known and the digest is that of the bytes."""
    landed = walk(spark, [folder], (*EXTENSIONS, ".json"))
    metas = landed.where(F.col("name").endswith(".meta.json"))
    told = metas.select(F.regexp_replace("path", r"\.meta\.json$", "").alias("path"), F.from_json(F.col("content").cast("string"), META).alias("m"))
    own = landed.where(F.col("ext").isin(*EXTENSIONS))
    read = read_any(own).select("path", "name", "text").join(own.select("path", F.sha2("content", 256).alias("__sha")), "path")
    rows = read.join(told, "path", "left")
    return rows.select(
        "path", "name", "text", F.coalesce("m.sha256", "__sha").alias("sha256"), F.col("m.url").alias("url"), F.coalesce("m.trust", F.lit("unknown")).alias("claimed_trust"),
        F.coalesce("m.model_in_path", F.lit(False)).alias("model_in_path"), F.col("m.address").alias("address"),
    )
