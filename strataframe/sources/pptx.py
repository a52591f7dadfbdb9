"""Pages as office presentations: one slide with a background picture and its elements in manifest order. Written with zipfile, no office library."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMU, LONG_SIDE, MIN_SIDE, MAX_SIDE = 914_400, 13.333, 1.0, 56.0
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
MAIN = "application/vnd.openxmlformats-officedocument.presentationml."


def layout(width: int, height: int) -> tuple[float, float]:
    """Inches of a page: 13.333 on the long side unless the short one would be under an inch."""
    ratio = max(width, height) / min(width, height)
    long, short = (LONG_SIDE, LONG_SIDE / ratio) if LONG_SIDE / ratio >= MIN_SIDE else (ratio * MIN_SIDE, MIN_SIDE)
    if long > MAX_SIDE:
        raise ValueError("the page's sides differ too much")
    return (long, short) if width >= height else (short, long)


def _relations(rows: list[tuple[str, str, str]]) -> str:
    body = "".join(f'<Relationship Id="{i}" Type="{KIND}{k}" Target={quoteattr(t)}/>' for i, k, t in rows)
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>'


def presentation(width: int, height: int, elements: list[dict], background: bytes | None = None) -> bytes:
    """elements: dicts with x, y, w, h and text (with font_px, colour) or shape (fill, stroke), in the order in which they are drawn."""
    wide, high = layout(width, height)
    x_emu, y_emu = wide * EMU / width, high * EMU / height
    emu = lambda e: tuple(round(e[k] * s) for k, s in (("x", x_emu), ("y", y_emu), ("w", x_emu), ("h", y_emu)))
    place = lambda e: '<a:xfrm><a:off x="{}" y="{}"/><a:ext cx="{}" cy="{}"/></a:xfrm>'.format(*emu(e))
    body = ""
    if background is not None:
        whole = place({"x": 0, "y": 0, "w": width, "h": height})
        body += f'<p:pic><p:nvPicPr><p:cNvPr id="2" name="background"/><p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="rId2"/><a:stretch><a:fillRect/></a:stretch></p:blipFill><p:spPr>{whole}<a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr></p:pic>'
    for k, e in enumerate(elements):
        name = f'<p:nvSpPr><p:cNvPr id="{k + 3}" name={quoteattr(str(e.get("id", k)))}/><p:cNvSpPr/><p:nvPr/></p:nvSpPr>'
        if e.get("text") is not None:
            size = round(e.get("font_px", 14) * high * 72 / height * 100)
            lines = "".join(f'<a:p><a:r><a:rPr sz="{size}"><a:solidFill><a:srgbClr val="{e.get("colour", "23394D")}"/></a:solidFill></a:rPr><a:t>{escape(t)}</a:t></a:r></a:p>' for t in e["text"].split("\n"))
            body += f'<p:sp>{name}<p:spPr>{place(e)}<a:prstGeom prst="rect"><a:avLst/></a:prstGeom><a:noFill/></p:spPr><p:txBody><a:bodyPr wrap="none" lIns="0" tIns="0" rIns="0" bIns="0"/>{lines}</p:txBody></p:sp>'
        else:
            fill = f'<a:solidFill><a:srgbClr val="{e.get("fill", "FFFFFF")}"/></a:solidFill>'
            body += f'<p:sp>{name}<p:spPr>{place(e)}<a:prstGeom prst="{e.get("shape", "rect")}"><a:avLst/></a:prstGeom>{fill}</p:spPr></p:sp>'
    tree = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
    spaces = f'xmlns:a="{A}" xmlns:r="{R}" xmlns:p="{P}"'
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    blank = f"<p:cSld><p:spTree>{tree}</p:spTree></p:cSld>"
    colours = "".join(f'<a:{n}><a:srgbClr val="{v}"/></a:{n}>' for n, v in [("dk1", "000000"), ("lt1", "FFFFFF"), ("dk2", "23394D"), ("lt2", "EEEEEE"), *((f"accent{i}", "4472C4") for i in range(1, 7)), ("hlink", "0563C1"), ("folHlink", "954F72")])
    fonts = '<a:majorFont><a:latin typeface="Arial"/><a:ea typeface=""/><a:cs typeface=""/></a:majorFont><a:minorFont><a:latin typeface="Arial"/><a:ea typeface=""/><a:cs typeface=""/></a:minorFont>'
    plain = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>'
    effects = "<a:effectStyle><a:effectLst/></a:effectStyle>"
    formats = f"<a:fillStyleLst>{plain * 3}</a:fillStyleLst><a:lnStyleLst>{f'<a:ln>{plain}</a:ln>' * 3}</a:lnStyleLst><a:effectStyleLst>{effects * 3}</a:effectStyleLst><a:bgFillStyleLst>{plain * 3}</a:bgFillStyleLst>"
    order = 'bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"'
    kinds = [("/ppt/presentation.xml", MAIN + "presentation.main+xml"), ("/ppt/slides/slide1.xml", MAIN + "slide+xml"), ("/ppt/slideLayouts/slideLayout1.xml", MAIN + "slideLayout+xml"), ("/ppt/slideMasters/slideMaster1.xml", MAIN + "slideMaster+xml"), ("/ppt/theme/theme1.xml", "application/vnd.openxmlformats-officedocument.theme+xml")]
    files: dict[str, str | bytes] = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/>' + "".join(f'<Override PartName="{n}" ContentType="{t}"/>' for n, t in kinds) + "</Types>",
        "_rels/.rels": _relations([("rId1", "officeDocument", "ppt/presentation.xml")]),
        "ppt/presentation.xml": f'{head}<p:presentation {spaces}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst><p:sldId id="256" r:id="rId2"/></p:sldIdLst><p:sldSz cx="{round(wide * EMU)}" cy="{round(high * EMU)}"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _relations([("rId1", "slideMaster", "slideMasters/slideMaster1.xml"), ("rId2", "slide", "slides/slide1.xml")]),
        "ppt/slides/slide1.xml": f"{head}<p:sld {spaces}><p:cSld><p:spTree>{tree}{body}</p:spTree></p:cSld></p:sld>",
        "ppt/slides/_rels/slide1.xml.rels": _relations([("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml")] + [("rId2", "image", "../media/background.png")] * (background is not None)),
        "ppt/slideLayouts/slideLayout1.xml": f"{head}<p:sldLayout {spaces}>{blank}</p:sldLayout>",
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": _relations([("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")]),
        "ppt/slideMasters/slideMaster1.xml": f'{head}<p:sldMaster {spaces}>{blank}<p:clrMap {order}/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>',
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": _relations([("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml"), ("rId2", "theme", "../theme/theme1.xml")]),
        "ppt/theme/theme1.xml": f'{head}<a:theme xmlns:a="{A}" name="plain"><a:themeElements><a:clrScheme name="plain">{colours}</a:clrScheme><a:fontScheme name="plain">{fonts}</a:fontScheme><a:fmtScheme name="plain">{formats}</a:fmtScheme></a:themeElements></a:theme>',
    }
    if background is not None:
        files["ppt/media/background.png"] = background
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)  # the same input gives the same bytes
    return out.getvalue()


def presentations(elements: DataFrame, width: int, height: int, key: str = "slide_id") -> DataFrame:
    """(slide_id, content) from rows (slide_id, place, x, y, w, h, text): a page's elements are bounded and gathered by the JVM."""
    columns = [c for c in elements.columns if c != key]
    pages = elements.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", *(c for c in columns if c != "place")))).alias("e"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [presentation(width, height, own) for own in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], [key, "content"])

    return pages.mapInArrow(rows, f"{key} long, content binary")
