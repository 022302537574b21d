"""Reading records of unknown schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions.text import file_stem
from recordloom.operators.ordering import global_index
from recordloom.session import stored

_MAP = "map<string,string>"
_ESCAPES = re.compile(r"\\.", re.DOTALL)
_TOKENS = re.compile(r'\\.|["{}\[\],]', re.DOTALL)


def _last_wins(raw: Column) -> Column:
    """A repeated JSON key keeps its last value."""
    entries = F.map_entries(raw)
    kept = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]),
    )
    return F.map_from_entries(kept)


def parse_json_object(text: Column | str) -> Column:
    """K9: JSON object to a map; broken or missing text gives an empty map."""
    column = F.col(text) if isinstance(text, str) else text
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.coalesce(_last_wins(F.from_json(column, _MAP)), empty)


def dataset_name(name: str | None, source_file: Column | str) -> Column:
    """The given dataset name, else the file stem."""
    return F.lit(name) if name else file_stem(source_file)


def _scan_blocks(pieces: DataFrame, schema: str, start, handle) -> DataFrame:
    """Stream ``pieces(source_file, block, value)`` of every byte range in order.

    ``start(file, block)`` gives the state of a range, ``handle(state, piece, out)`` changes it
    and appends rows; ``handle(state, None, out)`` ends the range.
    """

    def run(batches):
        current, state = None, None
        for batch in batches:
            out = []
            for at, value in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                if at != current:
                    if current is not None:
                        handle(state, None, out)
                    current, state = at, start(*at)
                handle(state, value, out)
            yield from _rows(out)
        if current is not None:
            out = []
            handle(state, None, out)
            yield from _rows(out)

    def _rows(out):
        import pyarrow as pa

        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return pieces.mapInArrow(run, schema)


def _range_effects(pieces: DataFrame) -> DataFrame:
    """(source_file, block, flips, outside, inside, first): what a byte range does to the lexer.

    ``flips`` tells whether it ends in another string state than it begins in; ``outside`` and
    ``inside`` are the changes of depth if it begins outside or inside a string; ``first`` is its
    first character.
    """

    def start(file, block):
        return {"at": (file, block), "inside": [False, True], "depth": [0, 0], "first": ""}

    def handle(state, piece, out):
        if piece is None:
            out.append((*state["at"], state["inside"][0], *state["depth"], state["first"]))
            return
        state["first"] = state["first"] or piece.lstrip("\ufeff \t\r\n")[:1]
        parts = (_ESCAPES.sub("", piece) if "\\" in piece else piece).split('"')
        net = [sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in parts[i::2]) for i in (0, 1)]
        for i in (0, 1):
            inside = state["inside"][i]
            ends = inside != (len(parts) % 2 == 0)
            state["depth"][i] += net[1 if inside else 0] - (0 if ends else 1)
            state["inside"][i] = ends

    return _scan_blocks(pieces, "source_file string, block long, flips boolean, outside int, inside int, first string", start, handle)


def _elements(pieces: DataFrame, starts: dict) -> DataFrame:
    """(source_file, block, number, whole, text): elements of the arrays by their number in the range, and the pieces of those that cross its borders.

    ``starts`` has (inside a string, depth, depth of the elements) at the start of every range.
    """

    def start(file, block):
        inside, depth, base = starts[file, block]
        # Outside the outermost brackets nothing is left, but for the start of the file.
        return {"at": (file, block), "inside": inside, "depth": depth, "base": base, "over": block > 0 and depth < max(base, 1), "text": [], "number": 0, "whole": False}

    def cut(state, out):
        out.append((*state["at"], state["number"], state["whole"], "".join(state["text"])))
        state["text"], state["whole"] = [], True

    def handle(state, piece, out):
        if piece is None:
            if not state["over"]:
                state["whole"] = False
                cut(state, out)
            # The last row of a range tells how many separators it has.
            out.append((*state["at"], state["number"], None, None))
            return
        if state["over"]:
            return
        piece += "}"
        begin, base, depth, inside = 0, state["base"], state["depth"], state["inside"]
        for token in _TOKENS.finditer(piece):
            c = token.group()
            if c == '"':
                inside = not inside
            elif inside or c[0] == "\\":
                continue
            elif c in "{[":
                depth += 1
                if depth == 1 and base == 1 and c == "[":
                    begin = token.end()
            elif c in "}]":
                depth -= 1
                if depth < base or depth == base == 0:
                    end = token.end() if base == 0 else token.start()
                    state["text"].append(piece[begin:end])
                    cut(state, out)
                    state.update(over=True, depth=depth, inside=inside)
                    return
            elif depth == base == 1:
                state["text"].append(piece[begin : token.start()])
                cut(state, out)
                state["number"] += 1
                begin = token.end()
        state["text"].append(piece[begin:])
        state.update(depth=depth, inside=inside)

    return _scan_blocks(pieces, "source_file string, block long, number long, whole boolean, text string", start, handle)


def read_records(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """JSON files, each an array of objects (or one object), to records.

    Files are read by byte ranges. What a range does to a JSON lexer (in a string or not, depth)
    is a function of its state at the start; these functions, one row a range, are composed in
    file order, so every range then finds the borders of its elements by itself. Only elements
    that cross a border are put together. Elements that are no objects are skipped, but count.
    """
    # Files of one name in several folders are different files.
    place = F.concat_ws("\0", "_metadata.file_path", "_metadata.file_name")
    pieces = spark.read.text(path, lineSep="}").select(place.alias("source_file"), F.col("_metadata.file_block_start").alias("block"), "value")
    starts, state = {}, {}
    for r in sorted(_range_effects(pieces).collect(), key=lambda r: (r["source_file"], r["block"])):
        inside, depth, base = state.get(r["source_file"], (False, 0, 1 if r["first"] == "[" else 0))
        starts[r["source_file"], r["block"]] = (inside, depth, base)
        state[r["source_file"]] = (inside != r["flips"], depth + r["inside" if inside else "outside"], base)
    found = stored(_elements(pieces, starts))
    earlier = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = found.filter("text IS NULL").select("source_file", "block", F.coalesce(F.sum("number").over(earlier), F.lit(0)).alias("before"))
    found = found.filter("text IS NOT NULL").join(F.broadcast(counts), ["source_file", "block"])  # one row a range
    found = found.select("source_file", "block", (F.col("before") + F.col("number")).alias("record_index"), "whole", "text")
    crossing = found.filter(~F.col("whole")).groupBy("source_file", "record_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("text")
    )
    every = found.filter("whole").select("source_file", "record_index", "text").unionByName(crossing)
    return (
        every.withColumn("source_file", F.split("source_file", "\0")[1])
        .withColumn("raw", F.from_json("text", _MAP))
        .filter("raw is not null")
        .select(dataset_name(dataset, "source_file").alias("dataset"), "source_file", "record_index", _last_wins(F.col("raw")).alias("raw"))
    )


def read_json_lines(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """JSON lines, splittable. The record index follows (file, byte block, line order)."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        F.col("value"),
    )
    indexed = global_index(rows, ["source_file", "_block", "_line"], "record_index")
    return indexed.select(
        dataset_name(dataset, "source_file").alias("dataset"),
        "source_file",
        "record_index",
        parse_json_object("value").alias("raw"),
    )


def as_text(df: DataFrame, name: str) -> Column:
    """One column as text. Doubles print as decimals of two digits, timestamps at midnight as dates."""
    kind = df.schema[name].dataType.simpleString()
    if kind in ("double", "float"):
        return F.col(name).cast("decimal(18,2)").cast("string")
    if kind.startswith("timestamp"):
        midnight = F.date_format(name, "HH:mm:ss") == "00:00:00"
        return F.when(midnight, F.date_format(name, "yyyy-MM-dd")).otherwise(F.col(name).cast("string"))
    if kind.startswith(("array", "map", "struct")):
        return F.to_json(name)
    return F.col(name).cast("string")


def records_from_table(
    df: DataFrame, dataset: str, order_by: str | list[str], columns: list[str] | None = None
) -> DataFrame:
    """S3: rows of a table to records; the index is the row's rank in the unique ``order_by``."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    columns = columns or df.columns
    narrow = df.select(*dict.fromkeys([*keys, *columns]))
    indexed = global_index(narrow, keys, "record_index")
    pairs = [item for c in columns for item in (F.lit(c), as_text(df, c))]
    return indexed.select(
        F.lit(dataset).alias("dataset"),
        F.lit(dataset).alias("source_file"),
        F.col("record_index").cast("bigint").alias("record_index"),
        F.create_map(*pairs).alias("raw"),
    )
