"""A Spark data source for .xlsx sheets and a small writer, on the standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_sheet(content: bytes, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """The rows of one sheet as text cells; shared, inline and plain values alike."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        strings = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                strings.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = [s.get("name") for s in book.find("m:sheets", _NS)]
        at = sheets.index(sheet) if isinstance(sheet, str) else sheet
        files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        for row in ElementTree.fromstring(z.read(files[at])).iter(f"{{{_NS['m']}}}row"):
            out: list[str | None] = []
            for i, c in enumerate(row.findall("m:c", _NS)):
                place = _column(c.get("r")) if c.get("r") else i
                out += [None] * (place + 1 - len(out))
                value = c.find("m:v", _NS)
                if c.get("t") == "s" and value is not None:
                    out[place] = strings[int(value.text)]
                elif c.get("t") == "inlineStr":
                    out[place] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif value is not None:
                    out[place] = value.text
            yield out


def read_xlsx(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """Sheets of one or more workbooks as text columns, one task a file; the first row names them.

    The header comes from the first file; other files' columns are matched by name."""
    files = spark.read.format("binaryFile").load(path)
    head = next(iter(read_sheet(files.orderBy("path").select("content").first().content, sheet)))
    names = [h for h in head if h]
    schema = StructType([StructField(n, StringType()) for n in names])

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content").to_pylist():
                lines = read_sheet(content, sheet)
                head = next(lines, [])
                place = {h: i for i, h in enumerate(head) if h}
                body = list(lines)
                yield pa.RecordBatch.from_arrays([pa.array([r[place[n]] if n in place and place[n] < len(r) else None for r in body], pa.string()) for n in names], names)

    return files.select("content").mapInArrow(rows, schema)


def write_xlsx(path: str, sheets: dict[str, DataFrame], most: int = 1_000_000) -> None:
    """Small report tables as a workbook; one with more rows than a sheet can have is an error."""
    strip = lambda v: re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(sheets)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(n)) + "</Types>")
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS["m"]}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(s)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, s in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(n)) + "</Relationships>")
        for i, df in enumerate(sheets.values()):
            lines = [df.columns, *df.limit(most + 1).toLocalIterator()]
            if len(lines) > most + 1:
                raise ValueError(f"a sheet has room for {most} rows")
            body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(strip(v))}</t></is></c>' if v is not None else "<c/>" for v in line) + "</row>" for line in lines)
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<?xml version="1.0"?><worksheet xmlns="{_NS["m"]}"><sheetData>{body}</sheetData></worksheet>')
