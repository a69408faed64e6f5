"""PDF files made of page images."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import send_package


def images_to_pdf(pages: list[tuple[bytes, int, int]]) -> bytes:
    """A PDF 1.4 file with one JPEG image ``(jpeg, width, height)`` filling each page."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>\n", b""]
    kids = []
    for jpeg, width, height in pages:
        image, content, page = len(objects) + 1, len(objects) + 2, len(objects) + 3
        kids.append(f"{page} 0 R")
        draw = f"q {width} 0 0 {height} 0 0 cm /Im0 Do Q\n".encode()
        head = f"<< /Type /XObject /Subtype /Image /Width {width} /Height {height} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode /Length {len(jpeg)} >>\nstream\n"
        objects.append(head.encode() + jpeg + b"\nendstream\n")
        objects.append(f"<< /Length {len(draw)} >>\nstream\n".encode() + draw + b"endstream\n")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width} {height}] /Resources << /XObject << /Im0 {image} 0 R >> >> /Contents {content} 0 R >>\n".encode())
    objects[1] = f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(kids)}] >>\n".encode()
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for number, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%bendobj\n" % (number, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1)
    out += b"".join(b"%010d 00000 n \n" % place for place in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table))


def write_pdfs(pages: DataFrame) -> DataFrame:
    """``(doc_id, pdf)`` of pages ``(doc_id, page_no, jpeg, width, height)``."""

    @F.pandas_udf("binary")
    def built(documents: pd.Series) -> pd.Series:
        return pd.Series([images_to_pdf([(bytes(p["jpeg"]), int(p["width"]), int(p["height"])) for p in d]) for d in documents], dtype="object")

    send_package(pages.sparkSession)
    # documents come to Python in Arrow batches, which are bounded in bytes; pages without a number come last
    page = F.struct(F.col("page_no").isNull().alias("none"), "page_no", "jpeg", "width", "height")
    documents = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(page)).alias("p"))
    return documents.select("doc_id", built(F.transform("p", lambda p: F.struct(p["jpeg"], p["width"], p["height"]))).alias("pdf"))
