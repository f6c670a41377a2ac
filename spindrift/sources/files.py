"""Files and blobs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SUPPORTED = ("pptx", "pdf", "png", "jpg", "jpeg", "webp", "gif", "tiff", "tif", "bmp")


def corpus(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """(path, modified_at, size, content, suffix) of the supported files below a folder; without `content`, a mere listing."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    columns = ["path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), *(["content"] if content else [])]
    return df.select(*columns, suffix.alias("suffix")).where(F.col("suffix").isin(*SUPPORTED))


def kind(suffix: Column) -> Column:
    """The extractor that a suffix goes to."""
    return F.when(suffix == "pptx", "pptx").when(suffix == "pdf", "pdf").otherwise("image")


#: What every extractor gives for a picture.
PICTURES = "path string, source_type string, slide_index int, page_index int, title string, body string, notes string, author string, created_at timestamp, modified_at timestamp, dated boolean, picture binary"
SLIDES = "path string, slide_index int, title string, body string, notes string"


def extracted(files: DataFrame) -> DataFrame:
    """One row (PICTURES) per picture of each file, by its kind's extractor; a file that can't be read gives none.

    A picture's times are the document's own (`dated`); where it has none, the file's. PDF needs PyMuPDF: without it a PDF is an error.
    """

    def run(batches):
        import pandas as pd

        columns = [c.split()[0] for c in PICTURES.split(", ")]
        for b in batches:
            out = []
            for r in b.itertuples():
                for row in _EXTRACTORS[r.kind](r.content):
                    out.append({"path": r.path, "source_type": r.kind, **row, "created_at": row.get("created_at") or (r.modified_at if r.kind == "image" else None), "modified_at": row.get("modified_at") or r.modified_at, "dated": row.get("created_at") is not None})
            yield pd.DataFrame(out, columns=columns).astype(object).where(lambda d: d.notna(), None)

    return files.select("path", kind(F.col("suffix")).alias("kind"), "modified_at", "content").mapInPandas(run, PICTURES)


def slide_texts(files: DataFrame) -> DataFrame:
    """(path, slide_index, title, body, notes) of every slide of the presentations among `files`."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for r in b.itertuples():
                for n, s in enumerate(_slides(r.content)[1], 1):
                    out.append((r.path, n, s["title"], s["body"], s["notes"]))
            yield pd.DataFrame(out, columns=["path", "slide_index", "title", "body", "notes"]).astype(object)

    return files.where("suffix = 'pptx'").select("path", "content").mapInPandas(run, SLIDES)


def _slides(content: bytes) -> tuple[dict, list[dict]]:
    import zipfile
    from xml.etree.ElementTree import ParseError

    from . import pptx

    try:
        return pptx.read(content)
    except (zipfile.BadZipFile, ParseError, KeyError, AttributeError):  # not a presentation
        return {}, []


def _pptx(content: bytes):
    about, slides = _slides(content)
    for n, s in enumerate(slides, 1):
        for picture in s.pop("pictures"):
            yield {**about, "slide_index": n, **s, "picture": picture}


def _pdf(content: bytes):
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for n, page in enumerate(doc, 1):
            text = page.get_text().strip()
            title = next((line.strip() for line in text.splitlines() if line.strip()), None)
            for image in page.get_images(full=True):
                yield {"page_index": n, "title": title, "notes": text[:1500], "author": (doc.metadata or {}).get("author") or None, "picture": doc.extract_image(image[0])["image"]}


def _image(content: bytes):
    from . import exif

    tags = exif.read(content)
    yield {"author": tags.get("artist"), "created_at": tags.get("taken_at"), "picture": content}


_EXTRACTORS = {"pptx": _pptx, "pdf": _pdf, "image": _image}


def ids_of(listing: DataFrame) -> DataFrame:
    """(image_id, path, modified_at): ids are the stems of file names."""
    return listing.select(F.regexp_replace(T.basename("path"), r"\.[^.]+$", "").alias("image_id"), "path", "modified_at")
