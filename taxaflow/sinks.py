"""Tables as files: records, predictions, images, reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.operators.similarity import markdown, rollup_counts


def replace(df: DataFrame, path: str) -> None:
    """Writes ``df`` in place of what is at ``path``, which must not be an input of ``df``."""
    df.write.mode("overwrite").parquet(path)


def by_type(records: DataFrame, path: str, column: str = "image_type") -> None:
    """Records routed to one folder per type."""
    records.write.mode("overwrite").partitionBy(column).json(path)


def index(records: DataFrame, path: str, append: bool = True) -> None:
    """Records as JSON lines."""
    records.write.mode("append" if append else "overwrite").json(path)


def lines(rows: DataFrame, path: str) -> None:
    """Tagged records (label, properties as JSON text) as lines of JSON."""
    rows.select(F.concat(F.lit('{"label":'), F.to_json(F.array("label")).substr(F.lit(2), F.length(F.to_json(F.array("label"))) - 2), F.lit(',"properties":'), "properties", F.lit("}")).alias("value")).write.mode("overwrite").text(path)


def results(rows: DataFrame, path: str) -> None:
    """One JSON object per row, null fields written out, with two blanks of indent: ``path`` is a folder of text files."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def predictions_csv(rows: DataFrame, path: str) -> None:
    """Predictions as CSV with a header, confidence with four digits."""
    rows.withColumn("confidence", F.format_string("%.4f", "confidence")).write.mode("overwrite").option("header", True).csv(path)


def images(crops: DataFrame, folder: str, name: str = "name") -> None:
    """PNG files of crops (name, crop_h, crop_w, crop), written by the executors to a folder they share."""
    from taxaflow.sources.readers import encode_png

    def write(rows) -> None:
        import numpy as np

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            img = np.frombuffer(r["crop"], np.uint8).reshape(r["crop_h"], r["crop_w"])
            part = os.path.join(folder, f".{r[name]}.part")
            with open(part, "wb") as f:
                f.write(encode_png(img))
            os.replace(part, os.path.join(folder, r[name]))  # a task run twice leaves one whole file

    crops.select(name, "crop_h", "crop_w", "crop").foreachPartition(write)


def summary(rows: DataFrame, path: str, group: str, item: str) -> None:
    """A Markdown summary per group; as many lines as there are groups by items."""
    counts = rollup_counts(rows, group, item).collect()
    with open(path, "w", encoding="utf-8") as f:
        f.write(markdown(counts, group, item))


def in_chunks(df: DataFrame, send, size: int = 50) -> None:
    """Calls ``send`` on the executors with lists of at most ``size`` rows, for stores that take transactions."""

    def run(rows) -> None:
        chunk = []
        for r in rows:
            chunk.append(r)
            if len(chunk) == size:
                send(chunk)
                chunk = []
        if chunk:
            send(chunk)

    df.foreachPartition(run)
