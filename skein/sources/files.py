"""Files as documents: types from extensions, texts with an encoding fallback, tables as text, vector stores as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type of a file by its extension.
TYPES = {
    "pdf": ["pdf"],
    "text": ["txt"],
    "markdown": ["md", "markdown", "mdown"],
    "rtf": ["rtf"],
    "image": ["png", "jpg", "jpeg", "heic", "heif", "tiff", "tif", "gif", "bmp", "webp"],
    "code": [
        "swift", "py", "pyw", "pyx", "js", "mjs", "cjs", "ts", "tsx", "java", "class", "cpp", "cc", "cxx", "c++", "c", "h", "m", "mm", "go", "rs", "rb", "php",
        "html", "htm", "css", "scss", "sass", "less", "json", "jsonc", "xml", "yaml", "yml", "sql", "sh", "bash", "zsh", "fish", "kt", "kts", "scala", "clj",
        "ex", "exs", "elm", "hs", "lua", "pl", "r", "dart", "vim",
    ],
    "office": ["doc", "docx", "xls", "xlsx", "ppt", "pptx", "pages", "numbers", "key"],
    "csv": ["csv"],
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def detect_type(path: Column) -> Column:
    out = F.lit("unknown")
    for kind, names in TYPES.items():
        out = F.when(extension(path).isin(names), kind).otherwise(out)
    return out


#: What can be wrong with a file, and what is said of it.
ERRORS = {
    "unsupported_format": "Unsupported document format",
    "pdf_load_failed": "Failed to load PDF document",
    "empty_document": "Document contains no text",
    "image_only_pdf": "PDF contains only images",
    "rtf_parse_failed": "Failed to parse RTF document",
    "file_not_found": "File not found at specified location",
    "unsupported_encoding": "Document encoding not supported",
    "corrupted_file": "File appears to be corrupted",
    "image_load_failed": "Failed to load image file",
    "ocr_failed": "OCR text recognition failed",
    "legacy_office_format": "Legacy Office format detected",
    "office_format_needs_conversion": "Office document detected",
    "iwork_extraction_failed": "iWork document support is limited",
}
#: Code points above which a text is only marked, and below which, too.
LONG, SHORT = 10_000_000, 50
#: Extractors of types that need a library: type -> Column of the content. None is installed; a session may add its own.
EXTRACTORS: dict = {}
#: How the contents of images and zipped packages begin, in hexadecimal.
IMAGE_SIGNS = {"png": "89504E47", "jpg": "FFD8FF", "jpeg": "FFD8FF", "gif": "47494638", "bmp": "424D", "tif": "49492A00|4D4D002A", "tiff": "49492A00|4D4D002A", "webp": "52494646", "heic": ".{8}66747970", "heif": ".{8}66747970"}


def dispatch(spark: SparkSession, path: str) -> DataFrame:
    """path, type, text, error, warning of whole files, none left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return extracted(raw)


def dispatch_paths(spark: SparkSession, paths: DataFrame, root: str) -> DataFrame:
    """dispatch() of the files of paths (path) below root; a path without a file has the error file_not_found."""
    found = dispatch(spark, root)
    out = paths.select("path").join(found, "path", "left").withColumn("type", detect_type(F.col("path")))
    return out.withColumn("error", F.when(F.col("text").isNull() & F.col("error").isNull(), "file_not_found").otherwise(F.col("error")))


def extracted(raw: DataFrame) -> DataFrame:
    """path, type, text, error, warning of raw (path, content), a table or a stream; other columns are carried.

    UTF-8, or Latin-1 where the bytes of a text, code or table are not UTF-8; an unknown type must be UTF-8. Rich text gives
    its plain text, tables their rows as lines. Types with an extractor of the session go through it; without one an image,
    a PDF or a package has the error that says what is in the way, and the error of its content where it isn't even one."""
    kind, ext = detect_type(F.col("path")), extension(F.col("path"))
    head = F.hex(F.substring("content", 1, 12))
    begins = lambda sign: head.rlike(f"^({sign})")
    utf = F.try_validate_utf8(F.col("content").cast("string"))
    either = F.coalesce(utf, F.decode("content", "ISO-8859-1"))
    text = F.when(kind.isin("text", "markdown", "code"), either).when(kind == "csv", table_text(either))
    text = text.when((kind == "rtf") & begins("7B5C727466"), rich_text(either)).when(kind == "unknown", utf)
    for name, extract in EXTRACTORS.items():
        text = text.when(kind == name, extract(F.col("content")))
    carried = [c for c in raw.columns if c not in ("path", "content")]
    image = F.lit(False)
    for e, sign in IMAGE_SIGNS.items():
        image = image | ((ext == e) & begins(sign))
    got = F.trim(text, F.lit(" \n\t\r"))
    old, zipped = ext.isin("doc", "xls", "ppt"), begins("504B0304")
    office = F.when(old, "legacy_office_format").when(~zipped, "corrupted_file").when(ext.isin("pages", "numbers", "key"), "iwork_extraction_failed").otherwise("office_format_needs_conversion")
    none = F.when(kind == "pdf", F.when(begins("25504446"), "image_only_pdf").otherwise("pdf_load_failed"))
    none = none.when(kind == "image", F.when(image, "ocr_failed").otherwise("image_load_failed")).when(kind == "office", office)
    none = none.when(kind == "rtf", "rtf_parse_failed").when(kind == "unknown", F.when(head.rlike("00"), "unsupported_format").otherwise("unsupported_encoding"))
    empty = F.when(kind == "pdf", "image_only_pdf").when(kind == "image", "ocr_failed").otherwise("empty_document")
    error = F.when(got.isNull(), F.when(F.col("content").isNull(), "file_not_found").otherwise(none)).when(got == "", empty)
    n = F.char_length(got)
    warning = F.when(n < SHORT, "short").when(n > LONG, "too_large")
    return raw.select("path", kind.alias("type"), got.alias("text"), error.alias("error"), F.when(error.isNull(), warning).alias("warning"), *carried)


#: Code page 1252 is Latin-1 but for these places.
CONTROLS = bytes(range(0x80, 0xA0)).decode("latin-1")
SIGNS = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
#: Control words of rich text that hide what their group holds.
HIDDEN = r"\{\\(\*|fonttbl|colortbl|stylesheet|info|pict)[^{}]*(\{[^{}]*\}[^{}]*)*\}"


def rich_text(text: Column) -> Column:
    """Rich text without groups of settings, control words and braces; paragraphs end lines. \\'hh is a byte of code page 1252,
    \\uN a UTF-16 unit whose stand-in (one character or one \\'hh) is left out; units that make a pair are joined."""
    bare = F.regexp_replace(F.regexp_replace(text, HIDDEN, ""), r"\\(par|line)\b ?", "\n")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\\tab\b ?", "\t"), r"\\([{}\\])", "\u0001$1")
    # escapes and what stands between them, in order
    parts = F.regexp_extract_all(bare, F.lit(r"(?s)\\u-?[0-9]+ ?(?:\\'[0-9a-fA-F]{2}|[^\\{}\u0001])?|\\'[0-9a-fA-F]{2}|\u0001.|\\[a-z]+-?[0-9]* ?|\\[^a-z]|[{}\r]|[^\\{}\r\u0001]+"), F.lit(0))

    def unit(p: Column) -> Column:
        return F.lpad(F.hex(F.pmod(F.regexp_extract(p, "^.u(-?[0-9]+)", 1).cast("int"), F.lit(65536))), 4, "0")

    def said(p: Column) -> Column:
        byte = F.translate(F.decode(F.unhex(F.substr(p, F.lit(3))), "ISO-8859-1"), CONTROLS, SIGNS)
        return F.when(p.rlike(r"^\\u-?[0-9]"), F.concat(F.lit("\u0002"), unit(p))).when(p.startswith("\\'"), byte).when(p.startswith("\u0001"), F.substr(p, F.lit(2))).when(p.rlike(r"^[\\{}\r]"), F.lit("")).otherwise(p)

    joined = F.array_join(F.transform(parts, said), "")
    # runs of UTF-16 units become text together, so that pairs are whole
    runs = F.regexp_extract_all(joined, F.lit("(?s)(?:\u0002[0-9A-F]{4})+|[^\u0002]+"), F.lit(0))
    plain = lambda r: F.when(r.startswith("\u0002"), F.decode(F.unhex(F.replace(r, F.lit("\u0002"), F.lit(""))), "UTF-16BE")).otherwise(r)
    return F.trim(F.array_join(F.transform(runs, plain), ""))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, type, text of the files without error."""
    return dispatch(spark, path).filter("error IS NULL").select("path", "type", "text")


def table_text(text: Column) -> Column:
    """A delimited file as sentences: its columns, then `Row i: name: value | ...`. Tabs part cells if the header has one."""
    lines = F.filter(F.split(text, r"\r?\n", -1), lambda x: x != "")
    by = F.when(F.contains(F.get(lines, F.lit(0)), F.lit("\t")), "\t").otherwise(",")
    head = F.transform(F.split(F.get(lines, F.lit(0)), by, -1), F.trim)
    rows = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda line, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), F.array_join(F.zip_with(head, F.split(line, by, -1), lambda k, v: F.concat(F.coalesce(k, F.lit("")), F.lit(": "), F.trim(F.coalesce(v, F.lit(""))))), " | ")))
    return F.concat(F.lit("Table with columns: "), F.array_join(head, ", "), F.lit("\n\n"), F.array_join(rows, "\n"))


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vectors (id, embedding, ...) as JSON lines, one file a task."""
    df.write.mode(mode).json(path)


def read_vectors(spark: SparkSession, path: str, schema: str = "vec_id long, embedding array<float>, label int") -> DataFrame:
    """The whole lines of the store written by write_vectors; the schema is given, so no pass infers it. Others: rejects()."""
    return lines(spark, path, schema).filter("r._corrupt IS NULL").select("r.*").drop("_corrupt")


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """value, r: each line and what it holds; r._corrupt is the line where it is broken."""
    read = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return spark.read.text(path).filter("value <> ''").select("value", read.alias("r"))


def rejects(spark: SparkSession, path: str, schema: str = "vec_id long, embedding array<float>, label int") -> DataFrame:
    """line: the broken lines of a store."""
    return lines(spark, path, schema).filter("r._corrupt IS NOT NULL").select(F.col("value").alias("line"))
