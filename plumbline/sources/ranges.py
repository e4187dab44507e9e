"""Large JSON documents and CSV files read by byte ranges, each of which any task can take.

A file is read in the splits that Spark makes of it. What a split does to the reader's
state is found without knowing where it begins: whether it turns strings inside out, and
how much deeper it leads when it begins outside a string and when it begins inside one.
Those changes, one small row a split, are put one after the other, which gives every
split the state it begins in; a second pass then cuts each split at the commas and
brackets of one level, and only pieces of elements that cross a border are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.session import keep

#: A split is handed on in lines that end with it; a value after it can't be escaped.
MARK = ","
QUOTE, ESCAPE, COMMA = 34, 92, 44
STEPS = np.zeros(256, np.int8)
STEPS[[ord("["), ord("{")]] = 1
STEPS[[ord("]"), ord("}")]] = -1
STRUCTURE = STEPS != 0
STRUCTURE[COMMA] = True
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 13]] = True
#: Parts of a document: beyond its brackets, at the first level, and below the level cut.
BEYOND, FIRST, BELOW = 0, 1, 2

CHANGE = "file string, block long, size long, file_size long, turns int, outside int, inside int"
SEGMENT = "file string, block long, part int, kind int, members int, items int, ended boolean, whole boolean, value string"


def _splits(spark: SparkSession, files: list[str], mark: str = MARK) -> DataFrame:
    """(file, block, file_size, value): the bytes of all splits in order, ends included."""
    lines = spark.read.option("lineSep", mark).text(files)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.concat("value", F.lit(mark)).alias("value"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, np.ndarray]]:
    """(file, block, file_size, bytes) of the rows of one split in a batch."""
    blocks, sizes = batch.column("block").to_numpy(), batch.column("file_size").to_numpy()
    names = batch.column("file").dictionary_encode()
    codes = names.indices.to_numpy()
    new = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
    values = batch.column("value").cast(pa.large_string())
    _, places, data = values.buffers()
    places = np.frombuffer(places, np.int64, len(values) + 1, values.offset * 8)
    data = np.frombuffer(data, np.uint8)
    for a, b in zip([0, *new], [*new, len(values)], strict=True):
        yield names.dictionary[int(codes[a])].as_py(), int(blocks[a]), int(sizes[a]), data[places[a] : places[b]]


def unquoted(data: np.ndarray, inside: int) -> tuple[np.ndarray, int]:
    """Places of brackets and commas outside strings, and whether the end is inside one."""
    quotes = np.flatnonzero(data == QUOTE)
    if len(quotes) and (data == ESCAPE).any():
        places = np.arange(len(data))
        last = np.maximum.accumulate(np.where(data != ESCAPE, places, -1))
        before = np.where(quotes > 0, quotes - 1 - last[quotes - 1], 0)
        quotes = quotes[before % 2 == 0]
    found = np.flatnonzero(STRUCTURE[data])
    within = (np.searchsorted(quotes, found) + inside) % 2
    return found[within == 0], (len(quotes) + inside) % 2


def changes(spark: SparkSession, files: list[str]) -> DataFrame:
    """A row a split: its size and what it does to the state in which it is begun."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, list[int]] = {}
        for batch in batches:
            for file, block, file_size, data in _runs(batch):
                size, _, turns, outside, inside = state.get((file, block), (0, 0, 0, 0, 0))
                steps = []
                for begin in (0, 1):
                    found, end = unquoted(data, begin)
                    steps.append(int(STEPS[data[found]].sum()))
                    turned = end ^ begin
                if turns:
                    steps.reverse()
                state[file, block] = [size + len(data), file_size, turns ^ turned, outside + steps[0], inside + steps[1]]
        rows = [(*key, size, whole, *rest) for key, (size, whole, *rest) in state.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.string(), *[pa.int64()] * 3, *[pa.int32()] * 3]
        names = ["file", "block", "size", "file_size", "turns", "outside", "inside"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return _splits(spark, files).mapInArrow(scan, CHANGE)


def starts(found: DataFrame) -> dict[tuple[str, int], tuple[int, int, int]]:
    """(inside a string, depth, surplus) at the beginning of each split.

    The driver holds a row a split, as it does of any read. Surplus is 1 where the last
    split has one mark more than its file has bytes.
    """
    out, sizes = {}, {}
    file, inside, depth = None, 0, 0
    for r in found.orderBy("file", "block").collect():
        if r["file"] != file:
            file, inside, depth = r["file"], 0, 0
        out[file, r["block"]] = (inside, depth)
        depth += r["inside"] if inside else r["outside"]
        inside ^= r["turns"]
        sizes[file] = sizes.get(file, 0) + r["size"] - (0 if file in sizes else r["file_size"])
    return {key: (*state, int(sizes[key[0]] != 0)) for key, state in out.items()}


def segments(spark: SparkSession, files: list[str], level: int) -> DataFrame:
    """Documents cut at the commas and brackets of levels up to ``level`` (1 or 2).

    Every byte is in one row. members counts the commas at the first level before it in
    its split, items those at the second; ended tells that the row has its comma or
    bracket at its end, whole that it began after another one.
    """
    begins = starts(changes(spark, files))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[tuple, list[int]] = {}
        for batch in batches:
            for file, block, _, data in _runs(batch):
                inside, depth, part, members, items = now.get((file, block)) or [*begins[file, block][:2], 0, 0, 0]
                found, end = unquoted(data, inside)
                steps = STEPS[data[found]].astype(np.int64)
                after = depth + np.cumsum(steps)
                lower = np.minimum(after, after - steps)  # of the two levels that a bracket parts
                comma = steps == 0
                cuts = np.where(comma, (after >= 1) & (after <= level), (lower >= 0) & (lower < level))
                at = found[cuts]
                first, second = comma[cuts] & (after[cuts] == 1), comma[cuts] & (after[cuts] == 2)
                kinds = np.minimum((after - steps)[cuts], level)
                depth_end = int(after[-1]) if len(after) else depth
                offsets = np.concatenate([[0], at + 1, [len(data)]])
                n = len(at) + 1
                before = lambda x: np.concatenate([[0], np.cumsum(x)])
                ended = np.arange(n) < n - 1
                whole = ended & (np.arange(n) > 0)
                text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * n),
                        pa.array(np.full(n, block, np.int64)),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(np.concatenate([kinds, [max(0, min(depth_end, level))]]).astype(np.int32)),
                        pa.array((members + before(first)).astype(np.int32)),
                        pa.array((items + before(second)).astype(np.int32)),
                        pa.array(ended),
                        pa.array(whole),
                        text.cast(pa.string()),
                    ],
                    names=[f.split()[0] for f in SEGMENT.split(", ")],
                )
                now[file, block] = [end, depth_end, part + 1, members + int(first.sum()), items + int(second.sum())]

    return _counted(keep(_splits(spark, files).mapInArrow(scan, SEGMENT)))


def _counted(out: DataFrame) -> DataFrame:
    """Adds the commas of earlier splits, which are a row a split."""
    sums = out.groupBy("file", "block").agg(F.max("members").alias("m"), F.max("items").alias("i")).collect()
    rows, totals = [], {}
    for r in sorted(sums, key=lambda r: (r["file"], r["block"])):
        m, i = totals.get(r["file"], (0, 0))
        rows.append((r["file"], r["block"], m, i))
        totals[r["file"]] = (m + r["m"], i + r["i"])
    earlier = out.sparkSession.createDataFrame(rows, "file string, block long, m long, i long")
    out = out.join(earlier, ["file", "block"])
    return out.withColumns({"members": F.col("members") + F.col("m"), "items": F.col("items") + F.col("i")}).drop("m", "i")


def _text(value: Column, ended: Column) -> Column:
    """Without the comma or bracket at its end, and without white space around it."""
    return X.strip(F.when(ended, F.expr("left(value, char_length(value) - 1)")).otherwise(value))


def joined(rows: DataFrame, *key: str) -> DataFrame:
    """(file, *key, value): pieces of one element put together; whole ones stay where they are."""
    keys = ["file", *key]
    ready = rows.filter("whole").select(*keys, _text(F.col("value"), F.lit(True)).alias("value"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "part", "ended", "value")))
    crossing = rows.filter("not whole").groupBy(*keys).agg(pieces.alias("p"))
    crossing = crossing.select(*keys, F.array_join("p.value", "").alias("value"), F.element_at("p.ended", -1).alias("ended"))
    return ready.union(crossing.select(*keys, _text(F.col("value"), F.col("ended")).alias("value")))


# ---- CSV ----------------------------------------------------------------------------

LINE = "\n"
#: A cell in quotes begins where a cell begins; two quotes inside it are one.
QUOTED = re.compile(rb'(?:(?<=[,\n])|\A)"(?:[^"]|"")*+("|\Z)')
REST = re.compile(rb'\A(?:[^"]|"")*+("|\Z)')


def record_ends(data: np.ndarray, inside: int) -> tuple[np.ndarray, int]:
    """Places of line breaks that end a record, and whether the end is inside quotes.

    data begins where a line begins, inside a cell in quotes or not.
    """
    breaks = np.flatnonzero(data == 10)
    if not inside and not (data == QUOTE).any():
        return breaks, 0
    text, begins, ends, at, end = data.tobytes(), [], [], 0, 0
    if inside:
        found = REST.match(text)
        begins, ends, at, end = [0], [found.end()], found.end(), int(not found.group(1))
    for found in QUOTED.finditer(text, at):
        begins.append(found.start())
        ends.append(found.end())
        end = int(not found.group(1))
    cell = np.searchsorted(np.array(begins, np.int64), breaks, "right") - 1
    within = (cell >= 0) & (breaks < np.array([*ends, 0], np.int64)[cell])
    return breaks[~within], end


def _quote_starts(spark: SparkSession, files: list[str]) -> dict[tuple[str, int], int]:
    """Whether each split begins inside a cell in quotes; the driver holds a row a split."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, list[int]] = {}
        for batch in batches:
            for file, block, _, data in _runs(batch):
                ends = [record_ends(data, begin)[1] for begin in (0, 1)]
                state[file, block] = [ends[now] for now in state.get((file, block), (0, 1))]
        rows = [(*key, *ends) for key, ends in state.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32()]
        names = ["file", "block", "outside", "inside"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    found = _splits(spark, files, LINE).mapInArrow(scan, "file string, block long, outside int, inside int")
    out: dict[tuple[str, int], int] = {}
    file, now = None, 0
    for r in found.orderBy("file", "block").collect():
        file, now = r["file"], 0 if r["file"] != file else now
        out[file, r["block"]] = now
        now = r["inside"] if now else r["outside"]
    return out


def csv_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, number, value) of all records that aren't empty, without their line break."""
    begins = _quote_starts(spark, files)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[tuple, list[int]] = {}
        for batch in batches:
            for file, block, _, data in _runs(batch):
                inside, part, number = now.get((file, block)) or [begins[file, block], 0, 0]
                at, end = record_ends(data, inside)
                offsets = np.concatenate([[0], at + 1, [len(data)]]).astype(np.int64)
                n = len(at) + 1
                ended = np.arange(n) < n - 1
                text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
                columns = [
                    pa.array([file] * n),
                    pa.array(np.full(n, block, np.int64)),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.full(n, FIRST, np.int32)),
                    pa.array((number + np.arange(n)).astype(np.int32)),
                    pa.array(np.zeros(n, np.int32)),
                    pa.array(ended),
                    pa.array(ended & ((np.arange(n) > 0) | (not inside))),
                    text.cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SEGMENT.split(", ")])
                now[file, block] = [end, part + 1, number + n - 1]

    rows = _counted(keep(_splits(spark, files, LINE).mapInArrow(scan, SEGMENT)))
    # what follows the last break of a batch is empty, unless the batch ends inside quotes
    rows = rows.filter("whole or value <> ''")
    pieces = F.array_sort(F.collect_list(F.struct("block", "part", "value")))
    crossing = rows.filter("not whole").groupBy("file", "members").agg(pieces.alias("p"))
    out = rows.filter("whole").select("file", "members", "value").union(
        crossing.select("file", "members", F.array_join("p.value", "").alias("value"))
    )
    # Windows line breaks become plain ones, inside cells too
    plain = F.when(F.col("value").endswith("\r\n"), F.replace("value", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("value"))
    bare = F.when(plain.endswith("\n"), F.expr("left(value, char_length(value) - 1)")).otherwise(F.col("value"))
    out = out.withColumn("value", plain).withColumn("value", bare)
    return out.select("file", F.col("members").alias("number"), "value").filter("value <> ''")
