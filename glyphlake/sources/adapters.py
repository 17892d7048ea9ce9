"""Optional adapters for PDF files and page images. They need libraries that may be absent; nothing else imports this module.

Each takes the library as a parameter too, which the tests use for stand-ins.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

try:
    import fitz
except ImportError:
    fitz = None
try:
    from PIL import Image
except ImportError:
    Image = None

PDF_PAGES = "path string, page int, pages int, text string, width double, height double, fonts array<string>, error string"


PDF_FONTS = "path string, page int, xref int, name string, type string, encoding string, to_unicode boolean"
PDF_TRACE = "path string, page int, spans array<struct<font string, chars array<struct<ucs string, gid string, bbox array<double>>>>>"


def _need(library, name: str):
    if library is None:
        raise RuntimeError(f"{name} is not installed")
    return library


def pdf_pages(files: DataFrame, library=None) -> DataFrame:
    """One row a page of files (path, content). A file that does not open gives one row with an error; a page that fails is left out."""
    pdf = _need(library or fitz, "PyMuPDF")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    book = pdf.open(stream=content, filetype="pdf")
                except Exception as e:
                    rows.append((path, None, 0, None, None, None, [], str(e)))
                    continue
                for k in range(book.page_count):
                    try:
                        page = book[k]
                        rows.append((path, k + 1, book.page_count, page.get_text(), page.rect.width, page.rect.height, [f[3] for f in page.get_fonts()], ""))
                    except Exception:
                        continue
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in PDF_PAGES.split(", ")])

    return files.select("path", "content").mapInPandas(run, PDF_PAGES)


def pdf_fonts(files: DataFrame, library=None) -> DataFrame:
    """The fonts of each page of files (path, content): name, type, encoding, and whether the font has a ToUnicode table."""
    pdf = _need(library or fitz, "PyMuPDF")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                book = pdf.open(stream=content, filetype="pdf")
                for k in range(book.page_count):
                    rows += [(path, k + 1, f[0], f[3], f[2], f[5], "/ToUnicode" in book.xref_object(f[0])) for f in book[k].get_fonts()]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in PDF_FONTS.split(", ")])

    return files.select("path", "content").mapInPandas(run, PDF_FONTS)


def pdf_trace(files: DataFrame, library=None) -> DataFrame:
    """(path, page, spans): the drawn glyphs of each page of files (path, content), for decode.traced_glyphs, which leaves malformed ones out."""
    pdf = _need(library or fitz, "PyMuPDF")

    def glyph(char) -> dict:
        part = lambda k: char[k] if len(char) > k else None
        number = lambda x: float(x) if isinstance(x, (int, float)) else None
        return {"ucs": str(part(0)), "gid": str(part(1)), "bbox": [number(x) for x in part(3) or ()]}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                book = pdf.open(stream=content, filetype="pdf")
                for k in range(book.page_count):
                    spans = [{"font": str(s.get("font") or ""), "chars": [glyph(c) for c in s.get("chars") or []]} for s in book[k].get_texttrace()]
                    yield pd.DataFrame({"path": [path], "page": [k + 1], "spans": [spans]})

    return files.select("path", "content").mapInPandas(run, PDF_TRACE)


def rendered(files: DataFrame, zoom: float = 2.0, library=None) -> DataFrame:
    """(path, page, image): pages of (path, content, page) as PNG; a page outside the file gives the middle one."""
    pdf = _need(library or fitz, "PyMuPDF")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            images = []
            for content, page in zip(frame["content"], frame["page"]):
                book = pdf.open(stream=content, filetype="pdf")
                at = page - 1 if 1 <= page <= book.page_count else book.page_count // 2
                images.append(book[int(at)].get_pixmap(matrix=pdf.Matrix(zoom, zoom)).tobytes("png"))
            yield pd.DataFrame({"path": frame["path"], "page": frame["page"], "image": images})

    return files.select("path", "content", "page").mapInPandas(run, "path string, page int, image binary")


def cropped(images: DataFrame, library=None) -> DataFrame:
    """(id, image): images (id, image, left, top, right, bottom) cut to their boxes, as PNG."""
    pictures = _need(library or Image, "Pillow")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for r in frame.itertuples():
                out = io.BytesIO()
                pictures.open(io.BytesIO(r.image)).crop((r.left, r.top, r.right, r.bottom)).save(out, "PNG")
                made.append(out.getvalue())
            yield pd.DataFrame({"id": frame["id"], "image": made})

    return images.mapInPandas(run, "id string, image binary")
