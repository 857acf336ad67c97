"""Pages as images: when to recognise their text, what images may come in, and results that are kept for replays."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import text_quality

ENOUGH = 0.65  # fixed: the quality of text that needs no recognition
SIDE, PIXELS, FRAMES = 32_768, 50_000_000, 256  # fixed: bounds of an image
# How files of each extension begin.
BEGINNINGS = {"png": b"\x89PNG\r\n\x1a\n", "jpg": b"\xff\xd8\xff", "jpeg": b"\xff\xd8\xff", "gif": b"GIF8", "tif": b"II*\x00", "tiff": b"II*\x00", "bmp": b"BM", "webp": b"RIFF"}


def needs_recognition(text: Column, mode: str = "auto") -> Column:
    """Whether a page's text must be recognised: never, always, or where its own text is poor."""
    if mode not in ("off", "auto", "always"):
        raise ValueError("off, auto or always")
    return F.lit(mode == "always") if mode != "auto" else text_quality(text) < ENOUGH


def image_fault(extension: str, data: bytes) -> str | None:
    """Why an image must not come in, or None. Sizes are read from PNG headers; other formats by their beginnings alone."""
    if not data.startswith(BEGINNINGS.get(extension.lower(), b"\x00\x00never")):
        return "its content isn't of its extension"
    if extension.lower() == "png":
        if len(data) < 24:
            return "it is cut off"
        width, height = struct.unpack(">II", data[16:24])
        if max(width, height) > SIDE or width * height > PIXELS:
            return "it is too large"
    return None


def recognised(pages: DataFrame, engine: Callable[[bytes], str], mode: str = "auto", text: str = "text", image: str = "image") -> DataFrame:
    """pages with their text, recognised by the engine where it is needed; the engine sees no other page."""
    need = needs_recognition(F.col(text), mode)
    run = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else engine(x)), "string")
    wanted = pages.where(need).withColumn("recognised", run(F.col(image)))
    rest = pages.where(~need).withColumn("recognised", F.lit(None).cast("string"))
    return wanted.unionByName(rest).withColumn(text, F.coalesce("recognised", text)).withColumn("recognised", F.col("recognised").isNotNull())


def extraction_key(sha256: str, component: str, version: str, settings: dict) -> str:
    """The name under which a component's result for a content is kept."""
    body = {"component": component, "settings": settings, "sha256": sha256, "version": version}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def with_kept(wanted: DataFrame, kept: DataFrame | None, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(results of all wanted keys, new ones to keep): make sees only keys that aren't kept. Both have key and result."""
    new = make(wanted if kept is None else wanted.join(kept.select("key"), "key", "left_anti")).select("key", "result")
    return (new if kept is None else kept.join(wanted.select("key"), "key", "left_semi").select("key", "result").unionByName(new)), new
