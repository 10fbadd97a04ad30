"""Files as documents and documents as files: upload checks, text of txt, docx and pdf files, plain and docx rendering.

PDF text needs an installed reader (pypdf or fitz); without one a PDF file becomes a row with its problem, not an error.
"""

from __future__ import annotations

import io
import re
import textwrap
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "path string, text string, pages int, problem string"
_MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def upload_problem(name: Column, size: Column, formats: tuple[str, ...], most: int) -> Column:
    """Why a file is refused: 'empty', 'format' or 'too large'; null if it isn't."""
    suffix = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), "[.]([^.]+)$", 1))
    return F.when(size == 0, "empty").when(~suffix.isin(*formats), "format").when(size > most, "too large")


def docx_text(data: bytes) -> str:
    """SRC-4: paragraphs, then table rows with their cells joined by a bar."""
    import xml.etree.ElementTree as ET

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{{{_MAIN}}}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{{{_MAIN}}}t"))
    paragraphs = [text(p) for p in body.findall(f"{{{_MAIN}}}p")]
    rows = [" | ".join(text(c).strip() for c in r.findall(f"{{{_MAIN}}}tc")) for r in body.iter(f"{{{_MAIN}}}tr")]
    return "\n".join(paragraphs + rows)


def docx_bytes(text: str) -> bytes:
    """A minimal single-column docx file of the lines of a text."""
    lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
    parts = {
        "[Content_Types].xml": '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<?xml version="1.0"?><w:document xmlns:w="{_MAIN}"><w:body>{lines}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def pdf_bytes(text: str, width: int = 95, rows: int = 60) -> bytes:
    """A single-column PDF file of the lines of a text, in one of the fonts every reader has; long lines are wrapped at spaces."""
    lines = [piece for line in text.split("\n") for piece in (textwrap.wrap(line, width, drop_whitespace=False) or [""])]
    pages = [lines[i : i + rows] for i in range(0, len(lines), rows)] or [[]]
    sign = lambda x: x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Kids[{kids}]/Count {len(pages)}>>".encode(), b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"]
    for i, page in enumerate(pages):
        body = b"BT /F1 10 Tf 12 TL 50 780 Td\n" + b"".join(b"(" + sign(x) + b") Tj T*\n" for x in page) + b"ET"
        objects.append(f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Resources<</Font<</F1 3 0 R>>>>/Contents {5 + 2 * i} 0 R>>".encode())
        objects.append(f"<</Length {len(body)}>>stream\n".encode() + body + b"\nendstream")
    out, places = b"%PDF-1.4\n", []
    for n, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{n} 0 obj".encode() + o + b"endobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer<</Size {len(objects) + 1}/Root 1 0 R>>\nstartxref\n{len(out)}\n%%EOF".encode()


def _pdf_text(data: bytes) -> tuple[str, int]:
    try:
        import pypdf

        pages = pypdf.PdfReader(io.BytesIO(data)).pages
        return "\n".join(p.extract_text() or "" for p in pages), len(pages)
    except ImportError:
        import fitz

        with fitz.open(stream=data, filetype="pdf") as d:
            return "\n".join(p.get_text() for p in d), len(d)


def _read(path: str, data: bytes) -> tuple[str | None, int | None, str | None]:
    suffix = path.rpartition(".")[2].lower()
    if not data:
        return None, None, "empty"
    try:
        if suffix == "txt":
            text, pages = data.decode("utf-8", "replace"), None
        elif suffix == "docx":
            text, pages = docx_text(data), None
        elif suffix == "pdf":
            text, pages = _pdf_text(data)
        else:
            return None, None, "format"
    except ImportError:
        return None, None, "no pdf reader installed"
    except Exception as e:  # noqa: BLE001 - a broken file is a row, whatever its reader raises
        return None, None, f"unreadable: {type(e).__name__}"
    return text, pages or max(1, len(text) // 3500), None if text.strip() else "no text"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: path, text, pages, problem: one row a file below `path`; refused and broken files have their problem and no text. The source doesn't list files of no bytes."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *_read(p, d)) for p, d in zip(b["path"], b["content"])]
            yield pd.DataFrame(rows, columns=["path", "text", "pages", "problem"]).astype({"pages": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, _SCHEMA)


def render_files(df: DataFrame, name: str, text: str, kind: str = "docx") -> DataFrame:
    """SNK-6: name, content BINARY: each text as the bytes of a docx, txt or pdf file."""
    import pandas as pd

    make = {"docx": docx_bytes, "pdf": pdf_bytes, "txt": lambda t: t.encode("utf-8")}.get(kind)
    if make is None:
        raise ValueError(f"unknown format {kind}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "content": [make(t) for t in b["text"]]})

    return df.select(F.col(name).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(run, "name string, content binary")


def read_reference(spark: SparkSession, path: str, column: str, schema: str) -> DataFrame:
    """SRC-1: rows of the array `column` of a JSON reference file, under an explicit schema; a missing file is an error."""
    if not re.search(r"\.json$", path):
        raise ValueError(f"{path} is no JSON file")
    raw = spark.read.schema(f"`{column}` array<struct<{schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select(F.inline(column))
