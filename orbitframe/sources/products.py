"""Product headers: the XML segment of a NITF file, its metadata as columns, and what a product supports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnreadableProduct

# Places and widths of the header's fields; the largest XML segment that is read.
_AT, MAX_XML = 354, 64 << 20
CALIBRATIONS = {"sigma0": "SigmaZeroSFPoly", "beta0": "BetaZeroSFPoly", "gamma0": "GammaZeroSFPoly", "rcs": "RCSSFPoly"}


def segments(head: bytes) -> list[tuple[str, int, int]]:
    """(kind, offset of its data, length) of the image, graphic, text and data-extension segments of a NITF 2.1 header."""
    if head[:9] != b"NITF02.10":
        raise UnreadableProduct("not a NITF 2.1 file")
    at = _AT

    def number(width: int) -> int:
        nonlocal at
        text = head[at : at + width]
        at += width
        if len(text) < width or not text.strip().isdigit():
            raise UnreadableProduct("the header ends early or holds no number")
        return int(text)

    length = number(6)
    out, place = [], length
    for kind, header, data in (("image", 6, 10), ("graphic", 4, 6), ("reserved", 0, 0), ("text", 4, 5), ("des", 4, 9)):
        count = number(3)
        for _ in range(count if header else 0):
            h, d = number(header), number(data)
            out.append((kind, place + h, d))
            place += h + d
    return out


def find_xml(read, size_limit: int = MAX_XML) -> str:
    """The first data extension that holds SICD XML; read(offset, length) gives bytes."""
    for kind, offset, length in segments(read(0, 65_536)):
        if kind != "des":
            continue
        if length > size_limit:
            raise UnreadableProduct(f"a segment of {length} bytes is too large")
        body = read(offset, length)
        if b"<SICD" in body[:4096]:
            return body.decode("utf-8", "replace").strip("\x00 \n")
    raise UnreadableProduct("no XML segment")


def headers(files: DataFrame, open_at: Callable[[str], Callable[[int, int], bytes]] | None = None) -> DataFrame:
    """path, xml and error of files(path); each file by itself, unreadable ones with their reason.

    open_at gives a reader of byte ranges for a path (archive.RangeReader over the caller's client), so that only headers are read, however
    large the products.  Without it files needs a column content, for small products that are rows already.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, content in zip(pdf["path"], pdf["path"] if open_at else pdf["content"], strict=True):
                try:
                    rows.append((path, find_xml(open_at(path) if open_at else lambda a, n, c=content: bytes(c[a : a + n])), None))
                except UnreadableProduct as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "xml", "error"])

    return files.select("path", *([] if open_at else ["content"])).mapInPandas(run, "path string, xml string, error string")


def parsed(rows: DataFrame) -> DataFrame:
    """rows(xml) with calibrations, noise_level, incidence and azimuth, by XPath over the XML without namespaces."""
    plain = F.regexp_replace(F.regexp_replace("xml", r'\sxmlns(:\w+)?="[^"]*"', ""), r"<(/?)\w+:", "<$1")
    out = rows.withColumn("_x", plain)
    have = F.filter(F.array(*[F.when(F.xpath_boolean("_x", F.lit(f"//Radiometric/{tag}")), F.lit(k)) for k, tag in CALIBRATIONS.items()]), lambda x: x.isNotNull())
    text = lambda path: F.nullif(F.xpath_string("_x", F.lit(path)), F.lit(""))
    return out.withColumn("calibrations", have).withColumn("noise_level", text("//Radiometric/NoiseLevel/NoiseLevelType")).withColumn("incidence", text("//SCPCOA/IncidenceAng").try_cast("double")).withColumn("azimuth", text("//SCPCOA/AzimAng").try_cast("double")).drop("_x")


def capability(calibration: str | None = None, noise_subtract: bool = False, noise_model: str = "measured", rtc: bool = False) -> tuple[Column, Column]:
    """(supported, reason) over calibrations, noise_level, incidence, azimuth and error; the first thing missing is the reason."""
    reason = F.when(F.col("error").isNotNull(), F.concat(F.lit("unreadable: "), F.col("error")))
    if calibration is not None:
        if calibration not in CALIBRATIONS:
            raise ValueError(f"unknown calibration {calibration!r}")
        reason = reason.when(~F.coalesce(F.array_contains("calibrations", calibration), F.lit(False)), F.lit(f"no {calibration} calibration"))
    if noise_subtract and noise_model == "measured":
        reason = reason.when(F.coalesce("noise_level", F.lit("")) != "ABSOLUTE", F.lit("no absolute noise level"))
    if rtc:
        reason = reason.when(F.col("incidence").isNull() | F.col("azimuth").isNull(), F.lit("no look geometry"))
    reason = reason.otherwise(F.lit(None).cast("string"))
    return reason.isNull(), reason


def preflight(products: DataFrame, **wanted) -> DataFrame:
    """A verdict for each of products, in their order if they have `seq`."""
    ok, reason = capability(**wanted)
    out = products.withColumn("supported", ok).withColumn("reason", reason).withColumn("error_scope", F.when(F.col("error").isNotNull(), F.lit("product")).when(~ok, F.lit("measurement")))
    return out.orderBy("seq") if "seq" in products.columns else out


def rollup(verdicts: DataFrame) -> DataFrame:
    """Counts by verdict, header bytes read, and product bytes (null if no size is known)."""
    return verdicts.agg(F.count_if("supported").alias("supported"), F.count_if(~F.col("supported") & F.col("error").isNull()).alias("refused"), F.count_if(F.col("error").isNotNull()).alias("unreadable"), F.sum("product_bytes").alias("product_bytes"), F.sum(F.when(~F.col("supported"), F.col("product_bytes"))).alias("bytes_avoided"))
