"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.session import shared_folder

# The bytes that separate words, and the same set for Java patterns.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x09-\x0D ]"


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only, whatever the locale and script."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(column: Column) -> Column:
    """Words of a text: runs without white space. Null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(column, F.lit("")), SPACE_CLASS + "+"), "")


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text with A-Z lower-cased (bytes methods touch ASCII only)."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def map_batches(df: DataFrame, schema: str, task: Callable[[], Callable[[dict[str, list]], Iterable[dict]]]) -> DataFrame:
    """``mapInArrow`` for functions of plain columns.

    ``task()`` runs once per task and returns a function that turns the columns of a batch
    into one or more dicts of output columns (lists, or arrays that Arrow accepts).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = task()
        for columns in _slices(batches):
            for out in handle(columns):
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type) for f, x in ((f, out[f.name]) for f in target)],
                    schema=target,
                )

    return df.mapInArrow(run, schema)


# Arrow bytes that a function gets at once (or one row), so that Python objects stay bounded.
SLICE_BYTES = 4 << 20


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(SLICE_BYTES, batch.nbytes))
        for at in range(0, max(1, batch.num_rows), rows):
            part = batch.slice(at, rows)
            yield {name: part.column(i) for i, name in enumerate(part.schema.names)}


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: compressed, and read by column, unlike a checkpoint.

    The folder stays until its owner clears it.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_bytes(path: str) -> bytes:
    """A small file of the driver, such as a vocabulary; its content is sent to the tasks."""
    with open(path, "rb") as file:
        return file.read()
