"""Files whose records don't end at line breaks, read by many tasks: CSV with breaks in quoted cells, and JSON arrays.

Spark splits a text file anywhere, so a task doesn't know whether its block begins inside a quoted cell, or how deep
inside a JSON document. A first pass over the text finds, of each block and for each state that it may begin in, the state it ends
in. These are functions that compose, so the driver gets a few numbers for each block, as it holds of each block that a
scan reads anyway, and combines them to the state in which each block really begins. A second pass then cuts blocks at true
borders of records. What two blocks or more share comes out in fragments, at most two from a block; these few are
joined by the block in which their record begins, and everything else stays where it was read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError

Place = tuple[str, int]  # a file and where in it a block begins


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, block (its first byte) and text of what stands between separators, in order within each block."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))


def _by_block(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[Place, pa.Array]]:
    """Runs of pieces of one block; a block's runs follow each other."""
    for b in it:
        files, blocks = b.column("file"), b.column("block")
        new = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1])).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for first, end in zip(cuts, cuts[1:], strict=False):
            if end > first:
                yield (files[first].as_py(), blocks[first].as_py()), b.column("text").slice(first, end - first)


def _in_order(found: dict[Place, object]) -> Iterator[tuple[Place, object, bool]]:
    """Blocks with what is known of them, file by file, and whether each is its file's first one."""
    last = None
    for place in sorted(found):
        yield place, found[place], place[0] != last
        last = place[0]


_FRAGMENTS = "file string, owner bigint, block bigint, part int, text string"
_RECORDS = "file string, block bigint, place bigint, text string"


def _whole(parts: DataFrame, joint: str) -> DataFrame:
    """The records of fragments: those of a file with the same owner, the block in which the record begins."""
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "part", "text"))), lambda x: x["text"]), joint)
    of = parts.groupBy("file", "owner").agg(texts.alias("text"))
    return of.select("file", F.col("owner").alias("block"), F.lit(2**62).alias("place"), "text")  # behind the block's other records


# CSV: at the beginning of a line a reader is either between records or inside a quoted cell.


def open_after(line: str, is_open: bool) -> bool:
    """Whether a quoted cell is open behind a line, if one was (or wasn't) before it.

    A quote opens a cell at its beginning only; in a quoted cell two quotes stand for one; what follows the
    closing quote up to the comma is text.
    """
    at = 0
    while True:
        if not is_open:
            if line[at : at + 1] != '"':
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        is_open = True
        quote = line.find('"', at)
        if quote < 0:
            return True
        if line[quote + 1 : quote + 2] == '"':
            at = quote + 2
            continue
        is_open = False
        at = line.find(",", quote + 1) + 1
        if not at:
            return False


def _bytes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all lines, without breaks, and where each line begins and the last one ends."""
    lines = lines.cast(pa.large_string())
    ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(lines) else np.empty(0, np.uint8)
    return data, ends - ends[0]


def _states_behind(lines: pa.Array, is_open: bool) -> np.ndarray:
    """Whether a quoted cell is open behind each of some lines.

    Where every quote that opens a cell stands at its beginning, each quote opens or closes: a number of quotes says all. Lines
    with stray quotes are followed one by one.
    """
    data, ends = _bytes(lines)
    quotes = np.flatnonzero(data == ord('"'))
    states = (np.searchsorted(quotes, ends[1:]) + is_open) % 2 == 1
    opening = quotes[int(is_open) :: 2]
    before = data[opening - 1]
    if ((before == ord(",")) | (before == ord('"')) | np.isin(opening, ends)).all():
        return states
    for k, line in enumerate(lines.to_pylist()):
        is_open = states[k] = open_after(line, is_open) if '"' in line else is_open
    return states


def _follow(lines: pa.Array, is_open: bool) -> tuple[bool, bool]:
    """The state behind some lines, and whether a record ends at the end of one of them."""
    states = _states_behind(lines, is_open)
    return (bool(states[-1]), not states.all()) if len(states) else (is_open, False)


def _line_states(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, for a beginning between records and inside a quoted cell: the state at its end, and whether a record ends in it."""
    found: dict[Place, list[tuple[bool, bool]]] = {}
    for place, lines in _by_block(it):
        known = found.setdefault(place, [(False, False), (True, False)])
        for s, (state, closed) in enumerate(known):
            after, more = _follow(lines, state)
            known[s] = (after, closed or more)
    rows = [(f, b, s[0][0], s[0][1], s[1][0], s[1][1]) for (f, b), s in found.items()]
    yield _batch(rows, _STATES)


_STATES = "file string, block bigint, open0 boolean, ends0 boolean, open1 boolean, ends1 boolean"
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _slices(place: Place, numbers: np.ndarray, data: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Records with these numbers: what stands between consecutive ends in data."""
    n = len(numbers)
    texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([place[0]] * n, pa.string()), pa.array(np.full(n, place[1])), pa.array(numbers), texts], ["file", "block", "place", "text"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, place and text of each record of CSV files but their headers; (file, block, place) is their order.

    Lines end with a line feed, or a carriage return before one; blank lines between records are skipped, inside quoted cells
    they stay. A quoted cell that isn't closed by the end of its file is an error, raised at once.
    """
    lines = pieces(spark, path, "\n")
    found = {(r.file, r.block): ((r.open0, r.ends0), (r.open1, r.ends1)) for r in lines.mapInArrow(_line_states, _STATES).collect()}
    begins: dict[Place, tuple[bool, int, int]] = {}  # is a cell open at the beginning, the owner of what goes on, and of what is open at the end
    is_open, owner, before = False, 0, None
    for place, states, is_first in _in_order(found):
        if is_first and is_open:
            break
        head, began_open = owner, is_open
        is_open, ends = states[is_open]
        if not began_open or ends:
            owner = place[1]
        begins[place] = (began_open, head, owner)
        before = place[0]
    if is_open:
        raise SourceError(f"{before}: a quoted cell doesn't end")

    def cut(want_fragments: bool):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, line, is_open, held, began, went_on = None, 0, False, [], 0, False
            fragments: list[tuple] = []

            def end_block() -> None:
                if held:  # a record goes on in the next block
                    fragments.append((place[0], begins[place][1 if went_on else 2], place[1], 0, b"".join(held).decode()))

            for here, lines in _by_block(it):
                if here != place:
                    end_block()
                    place, line, held = here, 0, []
                    is_open = went_on = begins[here][0]  # went_on: what is held began in an earlier block
                data, at = _bytes(lines)
                data = np.insert(data, at[1:], ord("\n"))
                states = _states_behind(lines, is_open)
                last = np.flatnonzero(~states)
                if not len(last):
                    began = began if held else line
                    held.append(data.tobytes())
                else:
                    ends = at[last + 1] + last + 1
                    first = b"".join([*held, data[: ends[0]].tobytes()]).decode()
                    if went_on:
                        fragments.append((place[0], begins[place][1], place[1], 0, first))
                    elif not want_fragments:
                        yield _batch([(*place, began if held else line, first)], _RECORDS)
                    if len(last) > 1 and not want_fragments:
                        yield _slices(place, line + last[:-1] + 1, data, ends)
                    went_on, began = False, line + int(last[-1]) + 1
                    rest = data[ends[-1] :].tobytes()
                    held = [rest] if rest else []
                line += len(lines)
                is_open = bool(states[-1])
            end_block()
            if want_fragments:
                yield _batch(fragments, _FRAGMENTS)

        return run

    records = lines.mapInArrow(cut(False), _RECORDS)
    if any(began_open for began_open, _, _ in begins.values()):
        records = records.unionByName(_whole(lines.mapInArrow(cut(True), _FRAGMENTS), ""))
    text = F.regexp_replace("text", r"\r?\n?\z", "")
    is_header = (F.col("block") == 0) & (F.col("place") == 0)
    return records.where(~is_header).withColumn("text", text).where(F.trim("text") != "")


# JSON: pieces end with closing braces, which no escape can stand before; a state is the depth, and whether a string is open.

def _structure(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte: quotes up to it (mod 2), its step in depth, and whether it may be a border of elements."""
    data = np.frombuffer(re.sub(rb"\\.", b"..", data, flags=re.DOTALL), np.uint8)
    quotes = np.cumsum(data == ord('"')) & 1
    opens, closes = (data == ord("[")) | (data == ord("{")), (data == ord("]")) | (data == ord("}"))
    return quotes, opens.astype(np.int8) - closes.astype(np.int8), (data == ord(",")) | (data == ord("[")) | (data == ord("]"))


def _levels(depth: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The level that a border stands for: of a bracket that of the array's elements."""
    return depth + (step < 0)


_DEPTHS = "file string, block bigint, flips bigint, deeper0 bigint, deeper1 bigint, borders0 array<bigint>, borders1 array<bigint>, begins string"


def _json_states(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: whether it has an odd number of quotes, and for a beginning outside and inside a string the change of
    depth and the relative levels that have borders; and its first characters."""
    found: dict[Place, list] = {}
    for place, texts in _by_block(it):
        known = found.setdefault(place, [0, [0, 0], [set(), set()], ""])
        data = _joined(texts)
        quotes, step, border = _structure(data)
        for s in (0, 1):
            outside = quotes == (s ^ known[0])
            deeper = np.cumsum(np.where(outside, step, 0)) + known[1][s]
            known[2][s].update(np.unique(_levels(deeper, step)[outside & border]).tolist())
            known[1][s] = int(deeper[-1]) if len(deeper) else known[1][s]
        known[0] ^= int(quotes[-1]) if len(quotes) else 0
        known[3] = known[3] or data[:64].decode(errors="replace").lstrip("\ufeff \t\r\n")[:1]
    yield _batch([(f, b, k[0], *k[1], sorted(k[2][0]), sorted(k[2][1]), k[3]) for (f, b), k in found.items()], _DEPTHS)


def _joined(texts: pa.Array) -> bytes:
    return "".join(f"{t}}}" for t in texts.to_pylist()).encode()


def json_elements(spark: SparkSession, path: str) -> DataFrame | None:
    """file, block, place and text of each element of JSON files that hold one array each, (file, block, place) being
    their order; None if a file holds something else. An array that doesn't end is an error, raised at once."""
    rows = pieces(spark, path, "}")
    found = {(r.file, r.block): r for r in rows.mapInArrow(_json_states, _DEPTHS).collect()}
    begins: dict[Place, tuple[int, int, int, int]] = {}  # in a string, depth, the owner of what goes on, and of what is open at the end
    in_string = depth = owner = 0
    file = None

    def check() -> None:
        if file is not None and (in_string or depth not in (0, -1)):  # the last piece may end without a brace
            raise SourceError(f"{file}: the array doesn't end")

    for place, states, is_first in _in_order(found):
        if is_first:
            check()
            file, in_string, depth, owner = place[0], 0, 0, 0
            if states.begins != "[":
                return None
        has_border = (1 - depth) in (states.borders1 if in_string else states.borders0)
        head, owner = owner, place[1] if has_border else owner
        begins[place] = (in_string, depth, head, owner)
        depth += states.deeper1 if in_string else states.deeper0
        in_string ^= states.flips
    check()

    def cut(want_fragments: bool):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, in_string, depth, tail, number, went_on, fragments = None, 0, 0, [], 0, False, []

            def end_block() -> None:
                if place is not None and b"".join(tail).strip():
                    fragments.append((place[0], begins[place][2 if went_on else 3], place[1], 0 if went_on else 1, b"".join(tail).decode()))

            for here, texts in _by_block(it):
                if here != place:
                    end_block()
                    place, (in_string, depth), number, tail, went_on = here, begins[here][:2], 0, [], True
                data = _joined(texts)
                quotes, step, border = _structure(data)
                outside = quotes == in_string
                deep = np.cumsum(np.where(outside, step, 0)) + depth
                at = np.flatnonzero(outside & border & (_levels(deep, step) == 1))
                brackets = at[np.frombuffer(data, np.uint8)[at] == ord("[")]
                if len(brackets) > (place[1] == 0 and went_on) or len(brackets) and brackets[0] != at[0]:
                    raise ValueError(f"{place[0]}: more than one array")
                if len(at):
                    first = b"".join([*tail, data[: at[0]]]).decode()
                    if went_on and place[1]:
                        fragments.append((place[0], begins[place][2], place[1], 0, first))
                    elif not went_on and not want_fragments:
                        yield _batch([(*place, number, first + ",")], _RECORDS)
                    if len(at) > 1 and not want_fragments:
                        yield _slices(place, number + 1 + np.arange(len(at) - 1), np.frombuffer(data, np.uint8), at + 1)
                    number += len(at)
                    tail, went_on = [], False
                last = int(at[-1]) + 1 if len(at) else 0
                if len(deep) and deep[-1] > 0 or not len(at):
                    tail.append(data[last:])
                elif data[last:].strip() not in (b"", b"}"):
                    raise ValueError(f"{place[0]}: something follows the array")
                if len(deep):
                    depth, in_string = int(deep[-1]), in_string ^ int(quotes[-1])
            end_block()
            if want_fragments:
                yield _batch(fragments, _FRAGMENTS)

        return run

    # Each text ends with the border behind it; an empty array has one blank text.
    records = rows.mapInArrow(cut(False), _RECORDS).withColumn("text", F.expr("left(text, length(text) - 1)")).where(F.col("text").rlike(r"\S"))
    if any(place[1] for place in begins):
        parts = rows.mapInArrow(cut(True), _FRAGMENTS)
        records = records.unionByName(_whole(parts, "").where(F.col("text").rlike(r"\S")))
    return records
