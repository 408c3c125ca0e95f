"""Files that are one top-level JSON array of objects, read by many tasks a file.

Spark's text source splits a file at every '}', in blocks of
spark.sql.files.maxPartitionBytes. A first pass sums each block: how it changes
depth, and whether it ends inside a string, for both ways it may begin. A prefix
scan over these small rows gives every block's true start. A second pass then
cuts out the objects of each block as it streams through it; only the pieces at
block edges are shuffled, to be put together.

A '}' never follows a backslash in valid JSON, so no escape crosses a fragment.
Files may be compressed (one block then) and lie wherever Spark reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.sources.staging import staged

#: A row a block is broadcast up to here (about 64 bytes each); beyond, blocks are joined by a shuffle.
BROADCAST_BLOCKS = 100_000

#: Rows of a batch that are Python objects at a time, and characters of objects that wait to be written.
PART, WAITING = 100, 1_000_000

_ESCAPE = re.compile(r"\\.", re.S)
_LEAD = re.compile(r"[\s,]*")
_NOTHING = re.compile(r"[\s,]*\]?\s*\Z")


def _step(fragment: str, inside: bool) -> tuple[bool, int]:
    """(inside a string at the end, change of depth) of a fragment without its '}'."""
    parts = (_ESCAPE.sub("", fragment) if "\\" in fragment else fragment).split('"')
    bare = "".join(parts[inside::2])
    return (len(parts) - 1 + inside) % 2 == 1, bare.count("{") + bare.count("[") - bare.count("]")


def _fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, at, value): the texts between '}' in the order of the file."""
    raw = spark.read.option("lineSep", "}").text(path)
    where = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return raw.select(*where, F.monotonically_increasing_id().alias("at"), "value")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches in parts of PART rows, so that few texts at a time are Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, PART):
            yield b.slice(i, PART)


def _rows(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    for b in _parts(batches):
        yield from zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("file", "block", "value", *more)), strict=True)


_SUMMARY = "file string, block long, first string, last string, inside0 boolean, depth0 long, least0 long, inside1 boolean, depth1 long, least1 long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: for a start outside (0) and inside (1) a string, the end's state, the depth's change and its least value after any '}' but the last."""
    names = [c.split()[0] for c in _SUMMARY.split(", ")]

    def closed() -> pa.RecordBatch:
        out = [*key, first, last]
        for s in states:
            out += s
        return pa.RecordBatch.from_pylist([dict(zip(names, out, strict=True))], schema=schema)

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.string()), ("last", pa.string())] + [f for h in "01" for f in ((f"inside{h}", pa.bool_()), (f"depth{h}", pa.int64()), (f"least{h}", pa.int64()))])
    key = None
    for file, block, value in _rows(batches):
        if key != (file, block):
            if key:
                yield closed()
            key, first = (file, block), value.lstrip("﻿ \t\r\n")[:1]
            states, seen = [[False, 0, None], [True, 0, None]], False
        last = value.rstrip()[-1:]
        for s in states:
            if seen and not s[0]:
                s[2] = s[1] if s[2] is None else min(s[1], s[2])
            s[0], change = _step(value, s[0])
            s[1] += change - (not s[0])
        seen = True
    if key:
        yield closed()


_STARTS = "file string, block long, inside boolean, depth long, ends boolean, edge long"


def _scan(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Each block's true start from the summaries of its file in order, with the number of the edge piece it begins in."""
    file = None
    for r in rows:
        if r["file"] != file:
            file, inside, depth, edge = r["file"], False, 0, 0
        h = "1" if inside else "0"
        least, inside_after, after = r[f"least{h}"], r[f"inside{h}"], depth + r[f"depth{h}"]
        ends = (least is not None and depth + least == 1) or (not inside_after and after == 1)
        yield file, r["block"], inside, depth, ends, edge, r["first"], r["last"], inside_after, after
        inside, depth, edge = inside_after, after, edge + ends


def block_starts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, inside, depth, ends, edge) of every block; an error if a file is no array."""
    whole = staged(_fragments(spark, path).mapInArrow(_summaries, _SUMMARY), "array-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        out: list[tuple] = []
        for r in _scan(rows):
            out.append(r)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=schema)

    ddl = _STARTS + ", first string, last string, inside_after boolean, depth_after long"
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])
    names = schema.names
    by_file = whole.repartition("file").sortWithinPartitions("file", "block")
    starts = staged(by_file.mapInArrow(run, ddl), "array-starts")
    # A file's last fragment has no '}', yet one is counted: an array ends at -1, as does a file of blanks.
    ends = starts.groupBy("file").agg(F.min_by("first", "block").alias("first"), *(F.max_by(c, "block").alias(c) for c in ("last", "inside_after", "depth_after")))
    bad = ends.filter("inside_after or depth_after <> -1 or concat(first, last) not in ('[]', '')").select("file").head()
    if bad:
        raise ValueError(f"{bad['file']} is not a JSON array of objects")
    return starts.select(*(c.split()[0] for c in _STARTS.split(", ")))


def _objects(batches: Iterator[pa.RecordBatch], edges: bool) -> Iterator[pa.RecordBatch]:
    """The pieces at block edges (file, edge, block, text), or the objects between them (text)."""
    schema = pa.schema([("file", pa.string()), ("edge", pa.int64()), ("block", pa.int64()), ("text", pa.string())])
    out: list[dict] = []
    key, held, waiting = None, [], 0

    def piece(closed: bool) -> dict:
        nonlocal waiting
        text = "".join(held)
        waiting += len(text)
        return {"file": key[0], "edge": edge, "block": key[1], "text": text + "}" if closed else text}

    for file, block, value, inside0, depth0, edge0 in _rows(batches, "inside", "depth", "edge"):
        if key != (file, block):
            if key and edges:
                out.append(piece(False))
            key, inside, depth, edge, held, head = (file, block), inside0, depth0, edge0, [], True
        inside, change = _step(value, inside)
        depth += change - (not inside)
        held.append(value)
        if not inside and depth == 1:
            if edges == head:
                out.append(piece(True))
            if head:
                head, edge = False, edge + 1
            held = []
        else:
            held.append("}")  # of the object's inside, or of a string
        if len(out) >= 1000 or waiting >= WAITING:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, waiting = [], 0
    if key and edges:
        out.append(piece(False))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece without the brackets and commas before it; nothing for what holds no object."""
    for b in _parts(batches):
        out = []
        for edge, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if edge == 0:
                text = text.lstrip("﻿ \t\r\n")
                text = text.removeprefix("[")
            text = text[_LEAD.match(text).end() :]
            if text.startswith("{"):
                out.append(text)
            elif not _NOTHING.match(text.removesuffix("}")):
                raise ValueError("an array holds something other than objects")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def json_array_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value): the text of every object of the arrays in path, in no order.

    An error if a file is no array or holds anything but objects. An empty file
    holds none. Memory: one object at a time, besides Arrow's batches.
    """
    starts = block_starts(spark, path)
    fragments = _fragments(spark, path)
    keyed = starts.select("file", "block", "inside", "depth", "edge")
    if starts.count() <= BROADCAST_BLOCKS:
        marked = fragments.join(F.broadcast(keyed), ["file", "block"])  # keeps the order of the scan
    else:
        marked = fragments.join(keyed.hint("merge"), ["file", "block"]).sortWithinPartitions("file", "block", "at")
    ddl = "file string, edge long, block long, text string"
    between = marked.mapInArrow(lambda x: _objects(x, False), ddl).select("edge", "text")
    at_edges = marked.mapInArrow(lambda x: _objects(x, True), ddl)
    pieces = F.array_sort(F.collect_list(F.struct("block", "text")))
    stitched = at_edges.groupBy("file", "edge").agg(F.concat_ws("", F.transform(pieces, lambda p: p["text"])).alias("text"))
    return between.unionByName(stitched.select("edge", "text")).mapInArrow(_clean, "value string")


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """The objects as rows of schema, as Spark's own JSON reader makes them of lines; what doesn't parse is null."""
    return json_array_texts(spark, path).select(F.from_json("value", schema).alias("_r")).select("_r.*")


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON array a partition; nulls are written, an empty partition is []."""
    each = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for b in _parts(batches):
            lines = []
            for text in b.column(0).to_pylist():
                lines.append(before + text)
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], ["value"])

    each.mapInArrow(run, "value string").write.mode(mode).text(path)
