"""Files as tables: graph documents, records, sidecars, images, PDFs, vocabularies."""

from __future__ import annotations

import glob
import hashlib
import json
import os
import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.functions.naming import base_of_name
from taxaflow.functions.patterns import BUILT_IN_GENERA

IMAGE_TYPES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "ppm", "pgm")
GRAPH = "metadata struct<version:string,date:string,sources:array<string>,changelog:array<string>>, nodes array<struct<id:string,label:string,properties:string>>, relationships array<struct<type:string,start_node_id:string,end_node_id:string,properties:string>>"


def graph_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON document {metadata, nodes, relationships}; properties stay JSON text."""
    doc = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    nodes = doc.select(F.inline("nodes")).withColumn("name", F.get_json_object("properties", "$.name"))
    edges = doc.select(F.inline("relationships")).select(F.col("start_node_id").alias("src"), "type", F.col("end_node_id").alias("dst"), "properties")
    return nodes, edges


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; blank lines are skipped, lines break at CR and LF only."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _listing(spark: SparkSession, path: str, pattern: str, recursive: bool, content: bool) -> DataFrame:
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    df = r.load(path)
    return df if content else df.select("path", "length", "modificationTime")


def any_case(extensions: tuple[str, ...]) -> str:
    """A glob that takes the extensions in any case, each file once."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def images(spark: SparkSession, path: str, recursive: bool = False, content: bool = True) -> DataFrame:
    """(path, length, modificationTime[, content]) of the images of a folder."""
    return _listing(spark, path, any_case(IMAGE_TYPES), recursive, content)


def grouped_images(spark: SparkSession, root: str, top: str = "RAIZ") -> DataFrame:
    """Images below ``root`` with ``sampling_point``: the first folder below it, ``top`` for those in it."""
    df = images(spark, root, True, False)
    rel = F.regexp_replace("path", r"^.*?" + "\\Q" + os.path.basename(root.rstrip("/")) + "\\E/", "")
    return df.withColumn("sampling_point", F.when(rel.contains("/"), F.substring_index(rel, "/", 1)).otherwise(top))


def pdfs(spark: SparkSession, path: str, part: str | None = None, content: bool = False) -> DataFrame:
    """PDFs of a folder, with ``stem``; ``part`` keeps those whose stem holds it, in any case."""
    df = _listing(spark, path, any_case(("pdf",)), False, content).withColumn("stem", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))
    return df if part is None else df.filter(F.lower("stem").contains(part.lower()))


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``files`` (path, name) with ``sidecar``: the JSON of the base id, else of the same stem, else null.

    ``sidecars`` has (stem, json); of several with one stem the smallest text is taken.
    """
    s = sidecars.groupBy("stem").agg(F.min("json").alias("json"))
    f = files.withColumn("_stem", F.regexp_replace("name", r"\.[^.]*$", "")).withColumn("_base", base_of_name(F.col("_stem")))
    f = f.join(s.select(F.col("stem").alias("_base"), F.col("json").alias("_a")), "_base", "left").join(s.select(F.col("stem").alias("_stem"), F.col("json").alias("_b")), "_stem", "left")
    return f.withColumn("sidecar", F.coalesce("_a", "_b")).drop("_stem", "_base", "_a", "_b")


# --- decoding ----------------------------------------------------------------


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of a PNG of 8 or 16 bits, not interlaced: grey, RGB, with alpha, or palette."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if head is None or head[6] or head[2] not in (8, 16):
        raise ValueError("kind of PNG that is not read")
    w, h, depth, colour = head[:4]
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    bpp = c * depth // 8
    raw, line = zlib.decompress(body), w * bpp
    out, up = np.zeros((h, line), np.uint8), np.zeros(line, np.int32)
    for y in range(h):
        f = raw[y * (line + 1)]
        row = np.frombuffer(raw, np.uint8, line, y * (line + 1) + 1).astype(np.int32)
        if f == 2:
            row = (row + up) & 255
        elif f == 1:
            row = (np.cumsum(row.reshape(-1, bpp), 0) & 255).ravel()
        elif f:
            row = row.copy()
            for i in range(line):
                a, b = (row[i - bpp] if i >= bpp else 0), up[i]
                if f == 3:
                    p = (a + b) // 2
                else:
                    q = up[i - bpp] if i >= bpp else 0
                    e = a + b - q
                    p = min((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - q), 2, q))[2]
                row[i] = (row[i] + p) & 255
        out[y], up = row, row
    a = out.view(">u2").astype(np.uint16) if depth == 16 else out
    a = a.reshape(h, w, c)
    if palette is not None:
        return palette[a[..., 0]]
    return a[..., 0] if c in (1, 2) else a[..., :3]


def encode_png(img: np.ndarray) -> bytes:
    """A grey or RGB image as PNG."""
    a = np.ascontiguousarray(img, np.uint8)
    h, w = a.shape[:2]
    rows = np.concatenate((np.zeros((h, 1), np.uint8), a.reshape(h, -1)), 1).tobytes()
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if a.ndim == 2 else 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def decode_pnm(data: bytes) -> np.ndarray:
    """Pixels of a binary PGM (P5) or PPM (P6) of 8 bits."""
    head, at = [], 0
    while len(head) < 4:
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        if data[at:end].startswith(b"#"):
            at = data.index(b"\n", at) + 1
            continue
        if end > at:
            head.append(data[at:end])
        at = end + 1
    w, h = int(head[1]), int(head[2])
    a = np.frombuffer(data, np.uint8, w * h * (3 if head[0] == b"P6" else 1), at)
    return a.reshape((h, w, 3) if head[0] == b"P6" else (h, w))


def decode(data: bytes) -> np.ndarray:
    """Pixels of an image file: PNG, PGM and PPM here, others through Pillow where it is installed."""
    if data[:4] == b"\x89PNG":
        return decode_png(data)
    if data[:2] in (b"P5", b"P6"):
        return decode_pnm(data)
    try:
        import io

        from PIL import Image
    except ImportError as e:
        raise ValueError("no reader for this kind of image is installed") from e
    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def rasters(files: DataFrame) -> DataFrame:
    """(path, height, width, channels, data, error) of files (path, content); error is null where it was read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, d in zip(b["path"], b["content"], strict=True):
                try:
                    a = decode(bytes(d))
                    rows.append((p, a.shape[0], a.shape[1], 1 if a.ndim == 2 else a.shape[2], np.ascontiguousarray(a).tobytes(), None))
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    rows.append((p, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "channels", "data", "error"]).astype({c: "Int32" for c in ("height", "width", "channels")})

    return files.select("path", "content").mapInPandas(run, "path string, height int, width int, channels int, data binary, error string")


# --- PDFs (the reader library is optional) ----------------------------------


def has_pdf_reader() -> bool:
    try:
        import fitz  # noqa: F401
    except ImportError:
        return False
    return True


def pdf_pages(files: DataFrame, most: int = 500, least_px: int = 300, dpi: int = 300) -> DataFrame:
    """(pdf, page, text, blocks, images, error) of PDFs (stem, content).

    Blocks are text blocks of up to ``most`` signs with their box; images are
    the embedded ones of at least ``least_px`` a side, each reference once, or
    the page drawn at ``dpi`` if there is none. Without the reader library each
    PDF gives one row with an error.
    """
    schema = "pdf string, page int, text string, blocks array<struct<block_no:int,x0:double,y0:double,x1:double,y1:double,text:string>>, images array<struct<xref:int,height:int,width:int,data:binary>>, error string"

    def read(stem: str, content: bytes) -> list[tuple]:
        try:
            import fitz
        except ImportError:
            return [(stem, None, None, None, None, "no PDF reader is installed")]
        out = []
        try:
            doc = fitz.open(stream=content, filetype="pdf")
            for no, page in enumerate(doc, 1):
                blocks = [{"block_no": i, "x0": float(b[0]), "y0": float(b[1]), "x1": float(b[2]), "y1": float(b[3]), "text": b[4].strip()} for i, b in enumerate(page.get_text("blocks")) if b[6] == 0 and 0 < len(b[4].strip()) < most]
                pics, seen = [], set()
                for ref in page.get_images(full=True):
                    if ref[0] not in seen and min(ref[2], ref[3]) >= least_px:
                        seen.add(ref[0])
                        p = fitz.Pixmap(fitz.csRGB, fitz.Pixmap(doc, ref[0]))
                        pics.append({"xref": ref[0], "height": p.height, "width": p.width, "data": bytes(p.samples)})
                if not pics:
                    p = page.get_pixmap(dpi=dpi, alpha=False)
                    pics.append({"xref": 0, "height": p.height, "width": p.width, "data": bytes(p.samples)})
                out.append((stem, no, page.get_text(), blocks, pics, None))
        except Exception as e:  # noqa: BLE001
            out.append((stem, None, None, None, None, str(e)[:200]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for s, c in zip(b["stem"], b["content"], strict=True) for r in read(s, bytes(c))]
            yield pd.DataFrame(rows, columns=["pdf", "page", "text", "blocks", "images", "error"]).astype({"page": "Int32"})

    return files.select("stem", "content").mapInPandas(run, schema)


def recognised_text(images_: DataFrame) -> DataFrame:
    """(path, text) read from images by an optional library; text null where it isn't installed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import pytesseract
        except ImportError:
            pytesseract = None
        for b in batches:
            out = []
            for p, h, w, c, d in zip(b["path"], b["height"], b["width"], b["channels"], b["data"], strict=True):
                text = None
                if pytesseract is not None and d is not None:
                    a = np.frombuffer(d, np.uint8).reshape((h, w) if c == 1 else (h, w, c))
                    text = pytesseract.image_to_string(a)
                out.append((p, text))
            yield pd.DataFrame(out, columns=["path", "text"])

    return images_.select("path", "height", "width", "channels", "data").mapInPandas(run, "path string, text string")


# --- vocabularies ------------------------------------------------------------


class Vocabulary:
    """A controlled list of genera with where it came from; bounded by what one list can hold."""

    MOST = 100_000

    def __init__(self, names, source: str, path: str | None = None):
        self.names = sorted({n.strip() for n in names if isinstance(n, str) and n.strip()})
        if len(self.names) > self.MOST:
            raise ValueError(f"a vocabulary has at most {self.MOST} names; join a table instead")
        self.snapshot = {"source": source, "hash": hashlib.sha256(json.dumps(self.names).encode()).hexdigest()[:12], "size": len(self.names), "path": path}

    def __contains__(self, name: str) -> bool:
        return name in set(self.names)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n,) for n in self.names], "name string")

    @classmethod
    def built_in(cls) -> Vocabulary:
        return cls(BUILT_IN_GENERA, "fallback")

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        """A snapshot with the list under ``genera`` or ``generos``."""
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        return cls(d.get("genera") or d.get("generos") or [], "snapshot", path)

    @classmethod
    def from_sqlite(cls, path: str) -> Vocabulary:
        """Of the tables genera, genus, taxa the first that is there; its column name, else nome."""
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
            there = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
            table = next((t for t in ("genera", "genus", "taxa") if t in there), None)
            if table is None:
                raise ValueError(f"no table of genera in {path}")
            cols = {r[1] for r in con.execute(f"PRAGMA table_info({table})")}
            col = "name" if "name" in cols else "nome"
            return cls([r[0] for r in con.execute(f"SELECT {col} FROM {table}")], "sqlite", path)

    @classmethod
    def best(cls, snapshot: str | None = None, database: str | None = None) -> Vocabulary:
        """A snapshot before a database before the built-in list; what isn't there is passed over."""
        if snapshot and os.path.isfile(snapshot):
            return cls.from_json(snapshot)
        if database and os.path.isfile(database):
            return cls.from_sqlite(database)
        return cls.built_in()


def files_in(path: str, pattern: str) -> list[str]:
    return sorted(glob.glob(os.path.join(path, pattern)))
