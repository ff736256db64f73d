"""``.npy`` matrices as frames.

Headers are read first; files are then cut into row slices that tasks read by offset, so one very
large array is shared by many tasks and none is ever held whole. A slice of a matrix stored by columns
is read column by column.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.skew import expand_range
from seqloom.sources.storage import open_random

SLICE_ROWS = 8192
_SHAPES = (
    "path string, dtype string, rows long, width long, by_column boolean, data_offset long, error string"
)


def _header(path: str) -> dict:
    row = dict.fromkeys(_columns(_SHAPES)) | {"path": path}
    try:
        with open_random(path) as source:
            start = source.read(12)
            # two bytes of length in version 1, four in later ones, then the header itself
            size = 10 + int.from_bytes(start[8:10], "little")
            if start[6:7] > b"\x01":
                size = 12 + int.from_bytes(start[8:12], "little")
            head = io.BytesIO(start + source.read(max(0, size - len(start))))
        version = np.lib.format.read_magic(head)
        read = (
            np.lib.format.read_array_header_1_0
            if version == (1, 0)
            else np.lib.format.read_array_header_2_0
        )
        shape, fortran, dtype = read(head)
        if len(shape) not in (1, 2) or dtype.hasobject:
            raise ValueError(f"unsupported array layout {shape} {dtype}")
        row.update(
            dtype=str(dtype),
            rows=int(shape[0]),
            width=int(shape[1]) if len(shape) == 2 else 1,
            by_column=bool(fortran and len(shape) == 2),
            data_offset=size,
        )
    except (OSError, ValueError) as exc:
        row["error"] = str(exc)
    return row


def array_shapes(listing: DataFrame) -> DataFrame:
    """``path, dtype, rows, width, by_column, data_offset, error`` from the headers alone."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = pd.DataFrame([_header(p) for p in batch["path"]], columns=_columns(_SHAPES))
            yield frame.astype({"rows": "Int64", "width": "Int64", "data_offset": "Int64"})

    return listing.select("path").mapInPandas(read, _SHAPES)


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def read_arrays(
    listing: DataFrame, slice_rows: int = SLICE_ROWS, skip_damaged: bool = False
) -> DataFrame:
    """``path, t, features``: one row per matrix row, at single precision.

    A file whose header cannot be read fails the job. With ``skip_damaged`` such files give no rows;
    ``array_shapes`` names them and their errors.
    """
    shapes = array_shapes(listing)
    if skip_damaged:
        shapes = shapes.where(F.col("error").isNull())
    else:
        stop = F.raise_error(F.concat_ws(": ", "path", "error")).cast("long")
        shapes = shapes.withColumn("rows", F.when(F.col("error").isNull(), F.col("rows")).otherwise(stop))
    shapes = shapes.where(F.col("rows") > 0)
    slices = expand_range(
        shapes, F.ceil(F.col("rows") / slice_rows), "slice", ["path"], block=1
    ).select("path", "dtype", "rows", "width", "by_column", "data_offset", "slice")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch.itertuples(index=False):
                first = part.slice * slice_rows
                count = min(slice_rows, part.rows - first)
                dtype = np.dtype(part.dtype)
                # a run is what lies together in the file: the slice itself, or its part of one column
                runs, run = (part.width, count) if part.by_column else (1, count * part.width)
                step = part.rows if part.by_column else 0
                skip = first if part.by_column else first * part.width
                raw = []
                with open_random(part.path) as source:
                    for i in range(runs):
                        source.seek(part.data_offset + (i * step + skip) * dtype.itemsize)
                        raw.append(np.frombuffer(source.read(run * dtype.itemsize), dtype))
                values = np.concatenate(raw).astype(np.float32)
                matrix = values.reshape((count, part.width), order="F" if part.by_column else "C")
                yield pd.DataFrame(
                    {"path": part.path, "t": np.arange(first, first + count), "features": list(matrix)}
                )

    return slices.mapInPandas(read, "path string, t long, features array<float>")
