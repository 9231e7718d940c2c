"""Tag/value files of any size, lexed by many tasks.

A file comes as blocks of whole lines (:func:`file_blocks`, or any table of keys, ``block`` and ``text``).  What a block
means depends on all blocks before it: a text field or a quoted value may be open, a tag may wait for its value, a loop
may be anywhere between its tags or values.  So the work is done in two passes:

* every block is lexed from every state a lexer can be in, and what it does to a reader in any state becomes one short
  row, a map from states to states (:func:`state_maps`);
* the maps of a file are applied one after the other, which gives every block the state it really begins in
  (:func:`entry_states`); a file of a terabyte has some ten thousand maps;
* every block is read once more, from its own state, and gives its rows (:func:`category_rows`).  A row or value that
  crosses the border of two blocks is given in pieces, and the few pieces are put together by a grouping.

The rows are those of :func:`atomweave.sources.cif.category_rows`, whatever the cuts.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from . import cif

#: States of the lexer at the start of a block: between tokens, or inside a value of one of three kinds.
LEXERS = ("plain", "text", "single", "double")
#: What ends a value that is open; a quote ends it before white space or where the block ends, as a line break follows.
CLOSING = {"text": re.compile(r"\n;"), "single": re.compile(r"'(?=[ \t\r\n]|\Z)"), "double": re.compile(r'"(?=[ \t\r\n]|\Z)')}
#: States of the reader: outside of loops, after a tag, among the tags of a loop, among its values.
IDLE, TAG, HEAD, BODY = "idle", "tag", "head", "body"
ENTRY_STATES = {IDLE: (IDLE,), TAG: (TAG, None, None), HEAD: (HEAD, True, ()), BODY: (BODY, True, (), 0)}
#: Place of a value that is still open at the end of its block: the last one there.
LAST = (1 << 31) - 1

PIECES = ("kind string, ordinal bigint, category string, row bigint, items map<string,string>, width int, "
          "cells array<struct<at:int,block:bigint,item:string,value:string>>, item string, value string, at_block bigint, at int, part bigint")


def file_blocks(spark: SparkSession, paths: str | Sequence[str], larger_than: int = -1) -> DataFrame:
    """``file``, ``block``, ``text`` and file ``size`` of files of more than ``larger_than`` bytes, as Spark splits them
    (``spark.sql.files.maxPartitionBytes``).

    The lines of one split are one block; a block is in a worker's memory as a whole.
    """
    lines = spark.read.text(paths, lineSep="\n").where(F.col("_metadata.file_size") > larger_than).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(key: tuple, parts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array(["\n".join(parts)]),
                                               pa.array([key[2]], pa.int64())], ["file", "block", "text", "size"])
        key, parts = None, []
        for batch in batches:
            for file, block, size, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (file, block, size) != key:
                    if parts:
                        yield whole(key, parts)
                    key, parts = (file, block, size), []
                parts.append(value)
        if parts:
            yield whole(key, parts)

    return lines.mapInArrow(joined, "file string, block bigint, text string, size bigint")


def read(spark: SparkSession, paths: str | Sequence[str], large: int = 64 << 20, categories: Sequence[str] | None = None) -> DataFrame:
    """Category rows of files of any size: those of more than ``large`` bytes are lexed in blocks, others whole.

    The size is known from the listing, so neither reader opens the other's files.
    """
    size = F.col("_metadata.file_size")
    whole = spark.read.text(paths, wholetext=True).where(size <= large).select(F.col("_metadata.file_path").alias("file"), "value")
    blocks = file_blocks(spark, paths, large)
    return cif.category_rows(whole, categories=categories).unionByName(category_rows(blocks, categories=categories))


class Lexer:
    """Tokens of one block from a given state: ``carried`` is what an open value gets from this block, ``state`` the
    state at the end of the block."""

    def __init__(self, text: str, state: str):
        self.text, self.state, self.carried, self.at, self.begun = text, state, None, 0, 0
        if state != "plain":
            hit = CLOSING[state].search(text)
            self.carried = text if hit is None else text[:hit.start()]
            self.at = len(text) if hit is None else hit.end()
            self.state = state if hit is None else "plain"

    def lines(self) -> Iterator[list[tuple[str, bool]] | list[str]]:
        """Tokens of a line after the other; a list of plain strings has no tag and no keyword in it."""
        text, at, size = self.text, self.at, len(self.text)
        while at < size:
            self.begun = at
            end = text.find("\n", at)
            end = size if end < 0 else end
            line = text[at:end]
            even = line.replace("\t", " ").replace("\r", " ")
            if "'" not in line and '"' not in line and "#" not in line and line[:1] != ";" and even.isascii() and even.isprintable():
                words = even.split()
                if words:  # keywords and tags have a low line
                    yield words if "_" not in line else [(word, False) for word in words]
                at = end + 1
                continue
            at, start, found = size, at, []
            for match in cif.TOKEN.finditer(text, start):
                kind = match.lastgroup
                if kind is not None:
                    found.append((match.group(kind), kind != "word"))
                    if kind != "word" and match.end(kind) == match.end():  # nothing closes it
                        self.state = kind
                if match.end() >= end:
                    at = match.end()
                    break
            yield found


class Trace:
    """Runs of a block that begins between tokens: numbers of values in a row, and tags and keywords between them.

    For every line it is known where its tokens stand, so a lexer that comes from another state takes the rest
    from here as soon as it begins a line that this one began too.
    """

    def __init__(self, text: str):
        lexer, count = Lexer(text, "plain"), 0
        self.runs: list[int | str] = []
        self.begun, self.place, self.before = array("q"), array("q"), array("q")
        for line in lexer.lines():
            self.begun.append(lexer.begun)
            self.place.append(len(self.runs))
            self.before.append(count)
            count = self._add(line, count)
        if count:
            self.runs.append(count)
        self.state = lexer.state

    def _add(self, line: list, count: int) -> int:
        if line and isinstance(line[0], str):
            return count + len(line)
        for run in line_runs(line):
            if isinstance(run, int):
                count += run
            else:
                self.runs += [count, run] if count else [run]
                count = 0
        return count

    def started_in(self, lexer: Lexer) -> Iterator[int | str]:
        """Runs of the same block from another state of the lexer."""
        for line in lexer.lines():
            at = bisect_left(self.begun, lexer.begun)
            if at < len(self.begun) and self.begun[at] == lexer.begun:
                rest = self.runs[self.place[at]:]
                if self.before[at]:
                    rest[0] -= self.before[at]
                yield from rest
                lexer.state = self.state
                return
            yield from line_runs(line)


def line_runs(line: list) -> Iterator[int | str]:
    """Numbers of values, tags and keywords of a line."""
    if line and isinstance(line[0], str):
        yield len(line)
        return
    for token, quoted in line:
        yield token if cif.ends_section(token, quoted) else 1


def is_tag(token: str) -> bool:
    return len(token) > 1 and token[0] == "_"


class Effect:
    """What a block does to a reader in one state: ``state`` afterwards, and the loops that ended in it.

    A state that begins with what the reader brings along has True in second place; ``entered`` is the loop of the
    entry state, once it has ended, ``ended`` has (loops, rows) of each wanted category, ``value`` who owns the last value.
    """

    def __init__(self, state: tuple, wanted: frozenset | None):
        self.state, self.wanted, self.entered, self.value, self.closed = state, wanted, None, "entry", 0
        self.ended: dict[str, list[int]] = {}

    def step(self, run: int | str) -> None:
        kind = self.state[0]
        if isinstance(run, int):
            self.value = None
            if kind == TAG:
                self.value, self.state = ["single", *self.state[1:]] if run == 1 else None, (IDLE,)
            elif kind == HEAD:
                self.value, self.state = "cell", (BODY, self.state[1], self.state[2], run)
            elif kind == BODY:
                self.value, self.state = "cell", (*self.state[:3], self.state[3] + run)
            return
        if kind == TAG:  # any token is a tag's value
            self.value, self.state = None, (IDLE,)
            return
        if kind == HEAD and is_tag(run):
            self.state = (HEAD, self.state[1], (*self.state[2], run))
            return
        if kind in (HEAD, BODY):
            self.close()
        self.state = (HEAD, False, ()) if run.lower() == "loop_" else (TAG, *cif.split_tag(run)) if is_tag(run) else (IDLE,)

    def close(self) -> None:
        _, brought, tags, *rest = self.state
        cells = rest[0] if rest else 0
        self.closed += 1
        if brought:
            self.entered = [list(tags), cells]
        else:
            count(self.ended, [cif.split_tag(t) for t in tags], cells, self.wanted)


def count(ended: dict[str, list[int]], tags: list[tuple[str, str]], cells: int, wanted: frozenset | None) -> None:
    """Note a loop that has ended; of atom_site only the first counts."""
    if not tags or wanted is not None and tags[0][0] not in wanted:
        return
    entry = ended.setdefault(tags[0][0], [0, 0])
    if tags[0][0] != "atom_site" or not entry[0]:
        entry[1] += cells // len(tags)
    entry[0] += 1


def state_map(text: str, wanted: frozenset | None) -> dict:
    """For every state of the lexer: its state at the end, and the block's effect on a reader in any state."""
    found, trace = {}, Trace(text)
    for start in LEXERS:
        lexer = Lexer(text, start)
        effects = {name: Effect(state, wanted) for name, state in ENTRY_STATES.items()}
        merged: dict[str, str] = {}
        for run in trace.runs if start == "plain" else trace.started_in(lexer):
            for name, effect in effects.items():
                if name not in merged:
                    effect.step(run)
            # a reader that began in a tag or outside of loops is soon as good as the other
            if TAG not in merged and effects[TAG].state == effects[IDLE].state and not effects[TAG].ended and not effects[IDLE].ended:
                merged[TAG] = IDLE
        found[start] = {"end": trace.state if start == "plain" else lexer.state, "effects": {name: [list(e.state), e.entered, e.ended, e.value, e.closed] for name, e in (
            (name, effects[merged.get(name, name)]) for name in effects)}}
        if TAG in merged and effects[IDLE].value is None and effects[TAG].value is not None:
            found[start]["effects"][TAG][3] = effects[TAG].value
    return found


def resolve(entry: dict, effects: dict, end: str, wanted: frozenset | None, block: int) -> dict:
    """The state behind a block, from the one before it and the block's map."""
    kind = entry["state"][0]
    state, entered, ended, value, closed = effects[kind]
    rows = dict(entry["rows"])
    total = entry["total"]

    def add(ended: dict[str, list[int]]) -> int:
        made = 0
        for category, (_, n) in ended.items():
            if category == "atom_site" and category in rows:
                continue
            rows[category] = rows.get(category, 0) + n
            made += n
        return made

    if entered is not None:
        tags, cells = list(entry["state"][1]) + [list(cif.split_tag(t)) for t in entered[0]], cells_of(entry) + entered[1]
        last: dict[str, list[int]] = {}
        count(last, [tuple(t) for t in tags], cells, wanted)
        total += add(last)
    total += add(ended)
    if state[0] == TAG:
        now = [TAG, *(state[1:] if state[1] is not None else entry["state"][1:])]
    elif state[0] in (HEAD, BODY):
        tags = [list(cif.split_tag(t)) for t in state[2]]
        now = [state[0], (list(entry["state"][1]) if state[1] else []) + tags]
        if state[0] == BODY:
            now.append(state[3] + (cells_of(entry) if state[1] else 0))
    else:
        now = [IDLE]
    if value == "entry":
        value = entry["value"]
    elif isinstance(value, list):
        value = [*(value if value[1] is not None else ["single", *entry["state"][1:3]]), block]
    return {"lexer": end, "state": now, "rows": rows, "total": total, "value": value, "loops": entry["loops"] + closed, "tail": ""}


def cells_of(entry: dict) -> int:
    return entry["state"][2] if entry["state"][0] == BODY else 0


START = {"lexer": "plain", "state": [IDLE], "rows": {}, "total": 0, "value": None, "loops": 0, "tail": ""}


class Reader:
    """Rows of one block from its entry state, as pieces (see :data:`PIECES`)."""

    def __init__(self, text: str, block: int, entry: dict, wanted: frozenset | None, items: Mapping[str, Sequence[str]] | None = None):
        self.text, self.block, self.wanted, self.items = text + entry["tail"], block, wanted, items or {}
        self.rows, self.total = dict(entry["rows"]), entry["total"]
        self.entry, self.place, self.loops = entry, 0, entry["loops"]
        self.tags: list[tuple[str, str]] = []
        self.cells, self.used, self.pending = 0, False, []
        self.border = False  # the pending row has cells elsewhere

    def keeps(self, category: str) -> bool:
        return self.wanted is None or category in self.wanted

    def open_body(self, cells: int = 0) -> None:
        category = self.tags[0][0] if self.tags else ""
        self.used = bool(self.tags) and self.keeps(category) and not (category == "atom_site" and category in self.rows)
        self.names = [item for _, item in self.tags]
        self.cells, self.first_row = cells, self.rows.get(category, 0)
        kept = self.items.get(category)
        self.needed = [(i, n) for i, n in enumerate(self.names) if kept is None or n in kept]
        self.border = bool(self.tags) and cells % len(self.tags) > 0

    def whole_row(self, line: list) -> Sequence[str] | None:
        """The values of a line that is one row, no part of which lies in another line or block."""
        if not self.used or self.pending or len(line) != len(self.names) or self.cells % len(line):
            return None
        if isinstance(line[0], str):
            return line
        if any(not quoted and cif.ends_section(token, quoted) for token, quoted in line):
            return None
        return [token for token, _ in line]

    def row_piece(self) -> tuple:
        width, category = len(self.names), self.tags[0][0]
        number = (self.cells - 1) // width
        ordinal, row = self.total + number, self.first_row + number
        if len(self.pending) == width and not self.border:
            return ("row", ordinal, category, row, {n: self.pending[i][1] for i, n in self.needed}, None, None, None, None, None, None, None)
        cells = [{"at": at, "block": self.block, "item": self.names[at], "value": value} for at, value in self.pending]
        return ("cells", ordinal, category, row, None, width, cells, None, None, self.loops, None, None)

    def close_loop(self, ended: bool = True) -> Iterator[tuple]:
        if self.used and self.pending:
            self.border = True
            yield self.row_piece()
        self.pending = []
        self.loops += ended
        if ended and self.used:
            category, made = self.tags[0][0], self.cells // len(self.tags)
            self.rows[category] = self.first_row + made
            self.total += made

    def single(self, tag: Sequence[str], value: str, still_open: bool) -> Iterator[tuple]:
        if self.keeps(tag[0]):
            self.place += 1
            yield ("single", None, tag[0], None, None, None, None, tag[1], value.lstrip() if still_open else value.strip(), self.block,
                   LAST if still_open else self.place, self.block if still_open else None)

    def carried(self, lexer: Lexer) -> Iterator[tuple]:
        """What this block adds to a value that began in an earlier one."""
        owner = self.entry["value"]
        if owner == "cell":
            if self.used:
                number = self.cells - 1
                at, row = number % len(self.names), number // len(self.names)
                yield ("cells", self.total + row, self.tags[0][0], self.first_row + row, None, len(self.names),
                       [{"at": at, "block": self.block, "item": self.names[at], "value": lexer.carried}], None, None, self.loops, None, None)
        elif owner and self.keeps(owner[1]):
            yield ("single", None, owner[1], None, None, None, None, owner[2], lexer.carried, owner[3], LAST, self.block)

    def pieces(self) -> Iterator[tuple]:
        kind, *rest = self.entry["state"]
        if kind in (HEAD, BODY):
            self.tags = [tuple(t) for t in rest[0]]
        if kind == BODY:
            self.open_body(rest[1])
        tag = rest if kind == TAG else None
        lexer = Lexer(self.text, self.entry["lexer"])
        if lexer.carried is not None:
            yield from self.carried(lexer)
        for line in lexer.lines():
            if kind == BODY and line and not self.border and lexer.state == "plain" and (values := self.whole_row(line)) is not None:
                number = self.cells // len(line)
                self.cells += len(line)
                yield ("row", self.total + number, self.tags[0][0], self.first_row + number, {n: values[i] for i, n in self.needed},
                       None, None, None, None, None, None, None)
                continue
            if kind == BODY and line and isinstance(line[0], str) and self.used:
                for token in line:
                    self.pending.append((self.cells % len(self.names), token))
                    self.cells += 1
                    if self.cells % len(self.names) == 0:
                        yield self.row_piece()
                        self.pending, self.border = [], False
                continue
            last = len(line) - 1
            for i, hit in enumerate(line):
                token, quoted = hit if isinstance(hit, tuple) else (hit, False)
                still_open = i == last and lexer.state != "plain"
                if kind == TAG:
                    yield from self.single(tag, token, still_open)
                    kind = IDLE
                    continue
                section = cif.ends_section(token, quoted)
                if kind == HEAD and section and is_tag(token):
                    self.tags.append(cif.split_tag(token))
                    continue
                if kind == HEAD:
                    self.open_body()
                    kind = BODY
                if kind == BODY and not section:
                    if self.used:
                        self.pending.append((self.cells % len(self.names), token))
                        self.cells += 1
                        self.border |= still_open
                        if self.cells % len(self.names) == 0:
                            yield self.row_piece()
                            self.pending, self.border = [], False
                    continue
                if kind == BODY:
                    yield from self.close_loop()
                    kind = IDLE
                if section:
                    kind = HEAD if token.lower() == "loop_" else TAG if is_tag(token) else IDLE
                    self.tags, tag = ([], None) if kind == HEAD else (self.tags, cif.split_tag(token) if kind == TAG else None)
        if kind == BODY:
            yield from self.close_loop(ended=False)


def state_maps(blocks: DataFrame, keys: Sequence[str], wanted: frozenset | None) -> DataFrame:
    """Keys, ``block``, ``size``, and ``map`` and ``bytes`` of every block (keys, ``block``, ``size``, ``text``)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(len(keys) + 2)[i].as_py()
                columns = [c.slice(i, 1) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([json.dumps(state_map(text, wanted))]), pa.array([len(text.encode())], pa.int64())],
                                                     names=[*keys, "block", "size", "map", "bytes"])
    return blocks.mapInArrow(read, _fields(blocks, [*keys, "block", "size"]) + ", map string, bytes bigint")


def _fields(df: DataFrame, names: Iterable[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def entry_states(maps: DataFrame, keys: Sequence[str], wanted: frozenset | None) -> DataFrame:
    """Keys, ``block`` and the ``state`` it begins in; the row without a block has the state at the end of the file."""
    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        state, states = START, []
        for block, own in zip(table.column("block").to_pylist(), table.column("map").to_pylist(), strict=True):
            states.append(json.dumps(state))
            effect = json.loads(own)[state["lexer"]]
            state = resolve(state, effect["effects"], effect["end"], wanted, block)
        kind, *rest = state["state"]
        if kind in (HEAD, BODY):  # the end of the file ends a loop
            ended: dict[str, list[int]] = {}
            count(ended, [tuple(t) for t in rest[0]], cells_of(state), wanted)
            for category, (_, made) in ended.items():
                if category != "atom_site" or category not in state["rows"]:
                    state["rows"][category] = state["rows"].get(category, 0) + made
                    state["total"] += made
        if sum(table.column("bytes").to_pylist()) == table.column("size")[0].as_py():  # the file ends with a line break
            states[-1] = json.dumps(json.loads(states[-1]) | {"tail": "\n"})
        states.append(json.dumps(state))
        first = [table.column(k).combine_chunks().take(pa.array([0] * len(states))) for k in keys]
        return pa.Table.from_arrays([*first, pa.array(table.column("block").to_pylist() + [None], pa.int64()), pa.array(states)],
                                    names=[*keys, "block", "state"])
    # a map is a short row, so adaptive execution would walk the states of most files in one task
    tasks = int(maps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return maps.repartition(tasks, *keys).groupBy(*keys).applyInArrow(walk, _fields(maps, [*keys, "block"]) + ", state string")


def category_rows(blocks: DataFrame, keys: Sequence[str] = cif.KEY, categories: Sequence[str] | None = None,
                  items: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows of ``blocks`` (keys, ``block``, ``text``): keys, ``ordinal``, ``category``, ``row``, ``items``, as
    :func:`atomweave.sources.cif.category_rows` gives them for the whole files; of the loops of a category in ``items`` only
    the items named there.  The states of the blocks, which are read twice, are staged.

    The texts of a file, joined by line breaks in the order of ``block``, are the file, but for the line break at its
    end where the file's ``size`` in bytes, a column that may be missing, tells that there is one.  A block holds whole
    lines; a null text is none.  ``blocks`` is read twice, so it should be files or a written table.
    """
    keys = list(keys)
    wanted = None if categories is None else frozenset(categories)
    size = F.col("size").cast("long") if "size" in blocks.columns else F.lit(None).cast("long")
    # a line break stands before every block, so that all that begins a line is seen where it stands; the first is white space
    source = blocks.where("text IS NOT NULL").select(*keys, F.col("block").cast("long").alias("block"), size.alias("size"),
                                                     F.concat(F.lit("\n"), "text").alias("text"))
    only = None if items is None else {category: frozenset(kept) for category, kept in items.items()}
    states = stage(entry_states(state_maps(source, keys, wanted), keys, wanted), "cif-states")
    started = source.join(states, [*keys, "block"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, *(part.strip().split(" ")[0] for part in re.split(r", (?![^<]*>)", PIECES))]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.int32(),
                 pa.list_(pa.struct([("at", pa.int32()), ("block", pa.int64()), ("item", pa.string()), ("value", pa.string())])),
                 pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64()]

        def packed(batch: pa.RecordBatch, i: int, rows: list[tuple]) -> pa.RecordBatch:
            own = [batch.column(k).take(pa.array([i] * len(rows))) for k in range(len(keys))]
            columns = list(zip(*rows, strict=True))
            columns[4] = [None if items is None else list(items.items()) for items in columns[4]]
            return pa.RecordBatch.from_arrays([*own, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                block, text, state = (batch.column(len(keys) + k)[i].as_py() for k in range(3))
                held = []
                for piece in Reader(text, block, json.loads(state), wanted, only).pieces():
                    held.append(piece)
                    if len(held) >= cif.BATCH_ROWS:
                        yield packed(batch, i, held)
                        held = []
                if held:
                    yield packed(batch, i, held)

    pieces = started.select(*keys, "block", "text", "state").mapInArrow(read, _fields(source, keys) + ", " + PIECES)
    return _assembled(pieces, states, keys, only or {})


def _is_one_of(kept: frozenset) -> Callable[[Column, Column], Column]:
    return lambda name, _: name.isin(*kept)


def _assembled(pieces: DataFrame, states: DataFrame, keys: list[str], only: Mapping[str, frozenset]) -> DataFrame:
    """Whole rows, rows put together from cells of several blocks, and one row of the single values of each category."""
    pieces = stage(pieces, "cif-pieces")
    whole = pieces.where("kind = 'row'").select(*keys, "ordinal", "category", "row", "items")

    parts = F.array_sort(F.flatten(F.collect_list("cells")))  # by column, then by block
    split = pieces.where("kind = 'cells'").groupBy(*keys, "category", "row", "at_block").agg(  # the loop's number
        F.first("ordinal").alias("ordinal"), F.first("width").alias("width"), parts.alias("cells"))
    values = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda at: F.struct(
        F.element_at(F.filter("cells", lambda c: c["at"] == at), 1)["item"].alias("key"),
        F.array_join(F.transform(F.filter("cells", lambda c: c["at"] == at), lambda c: c["value"]), "").alias("value")))
    complete = split.where(F.size(F.array_distinct(F.transform("cells", lambda c: c["at"]))) == F.col("width"))
    last_wins = F.filter(F.transform(values, lambda kv, i: F.struct(kv["key"].alias("key"), kv["value"].alias("value"), i.alias("i"))),
                         lambda kv: ~F.exists(F.slice(values, kv["i"] + 2, F.lit(LAST)), lambda later: later["key"] == kv["key"]))
    glued = complete.select(*keys, "ordinal", "category", "row", F.map_from_entries(
        F.transform(last_wins, lambda kv: F.struct(kv["key"], kv["value"]))).alias("items"))
    for category, kept in only.items():
        glued = glued.withColumn("items", F.when(F.col("category") != category, F.col("items")).otherwise(
            F.map_filter("items", _is_one_of(kept))))

    singles = pieces.where("kind = 'single'")
    closed = singles.where("part IS NULL").select(*keys, "category", "item", "at_block", "at", "value")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "value"))), lambda p: p["value"]), "")
    crossing = singles.where("part IS NOT NULL").groupBy(*keys, "category", "item", "at_block", "at").agg(
        F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("value"))
    place = F.struct("at_block", "at")
    latest = closed.unionByName(crossing).groupBy(*keys, "category", "item").agg(F.max_by("value", place).alias("value"), F.min(place).alias("place"))
    grouped = latest.groupBy(*keys, "category").agg(F.array_sort(F.collect_list(F.struct("place", "item", "value"))).alias("found"), F.min("place").alias("place"))
    ends = states.where("block IS NULL").select(*keys, F.from_json("state", "rows map<string,long>, total long").alias("end"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("place")) - 1
    single_rows = grouped.withColumn("_n", order).join(ends, keys).select(
        *keys, (F.col("end.total") + F.col("_n")).alias("ordinal"), "category",
        F.coalesce(F.try_element_at("end.rows", F.col("category")), F.lit(0)).cast("long").alias("row"),
        F.map_from_entries(F.transform("found", lambda f: F.struct(f["item"], f["value"]))).alias("items"))
    return whole.unionByName(glued).unionByName(single_rows)


register_pickle_by_value(sys.modules[__name__])
