"""Self-describing tag/value files as category rows.

Reading is spread over files: each file is one input row and one unit of tokenising.  The only Python
in the executors is the tokenizer; rows leave it as maps in Arrow batches of bounded size, and every
projection after that is a Spark expression.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("file",)
CATEGORIES = ("atom_site", "entry", "struct", "exptl", "refine", "struct_conf", "struct_sheet_range", "ma_qa_metric")

METADATA_ITEMS = {"atom_site": ("pdbx_pdb_model_num",)}

# Text items of an atom row.
TEXT_ITEMS = ("group_pdb type_symbol label_atom_id auth_atom_id label_alt_id label_comp_id auth_comp_id label_asym_id "
              "auth_asym_id pdbx_pdb_ins_code").split()

ROW_SCHEMA = "ordinal bigint, category string, row bigint, items map<string,string>"
BATCH_ROWS = 4096

# A text field between lines that start with ';', a comment, a quoted value (closed by its quote before
# white space), or a word.
TOKEN = re.compile(
    r"^;(?P<text>.*?)(?:\n;|\Z)"
    r"|#[^\n]*"
    r"|'(?P<single>.*?)(?:'(?=[ \t\r\n]|\Z)|\Z)"
    r"|\"(?P<double>.*?)(?:\"(?=[ \t\r\n]|\Z)|\Z)"
    r"|(?P<word>[^ \t\r\n]+)",
    re.MULTILINE | re.DOTALL)


def whole_words(line: str) -> list[tuple[str, bool]] | None:
    """Values of a line whose quoted values have no blanks in them and which has no comment, else None."""
    found = []
    for word in line.split(" "):
        first = word[:1]
        if first == "'" or first == '"':
            if len(word) < 2 or word[-1] != first:
                return None
            found.append((word[1:-1], True))
        elif first == "#":
            return None
        elif word:
            found.append((word, False))
    return found


class Tokens:
    """Values of a text in order, each with whether it was quoted.

    Lines without comments, text fields and quoted blanks, nearly all of a file, are split into words
    at once; the pattern only works through the others.
    """

    def __init__(self, text: str):
        self.text, self.at, self.held, self.next = text, 0, [], 0

    def __iter__(self) -> Tokens:
        return self

    def __next__(self) -> tuple[str, bool]:
        while self.next == len(self.held):
            if self.at >= len(self.text):
                raise StopIteration
            self.held, self.next = self.line(), 0
        self.next += 1
        return self.held[self.next - 1]

    def ahead(self) -> tuple[str, int]:
        """The rest of the line that comes next, and where it ends."""
        end = self.text.find("\n", self.at)
        end = len(self.text) if end < 0 else end
        return self.text[self.at:end], end

    def line(self) -> list[tuple[str, bool]]:
        line, end = self.ahead()
        even = line.replace("\t", " ").replace("\r", " ")
        if line[:1] != ";" and even.isascii() and even.isprintable():
            if "'" not in line and '"' not in line and "#" not in line:
                found = [(word, False) for word in even.split()]
            else:
                found = whole_words(even)
            if found is not None:
                self.at = end + 1
                return found
        start, self.at, found = self.at, len(self.text), []
        for match in TOKEN.finditer(self.text, start):
            kind = match.lastgroup
            if kind is not None:
                found.append((match.group(kind), kind != "word"))
            if match.end() >= end:
                self.at = match.end()
                break
        return found

    def rows(self, width: int) -> Iterator[list[str]]:
        """Values of the lines that come next, as long as each is ``width`` of them; without ``_`` none of them ends a loop."""
        text, size = self.text, len(self.text)
        while self.next == len(self.held) and self.at < size:
            end = text.find("\n", self.at)
            end = size if end < 0 else end
            line = text[self.at:end]
            if "\t" in line or "\r" in line:
                line = line.replace("\t", " ").replace("\r", " ")
            if "_" in line or line[:1] == ";" or not (line.isascii() and line.isprintable()):
                return
            words = line.split()
            if len(words) != width:
                return
            if "'" in line or '"' in line or "#" in line:
                for i, word in enumerate(words):
                    first = word[0]
                    if first == "'" or first == '"':
                        if len(word) < 2 or word[-1] != first:
                            return
                        words[i] = word[1:-1]
                    elif first == "#":
                        return
            self.at = end + 1
            yield words


def tokens(text: str) -> Iterator[tuple[str, bool]]:
    return Tokens(text)


SECTION_STARTS = frozenset("_lLsSdD")


def ends_section(token: str, quoted: bool) -> bool:
    if quoted:
        return False
    lower = token.lower()
    return ((len(token) > 1 and token[0] == "_") or lower in ("loop_", "stop_")
            or lower.startswith(("data_", "save_")))


def split_tag(tag: str) -> tuple[str, str]:
    category, _, item = tag[1:].lower().partition(".")
    return category, item


def rows_of(text: str, wanted: Iterable[str] | None = None, items: Mapping[str, Sequence[str]] | None = None) -> Iterator[tuple[str, int, dict]]:
    """``(category, row, {item: value})`` of one file; of loops of a category in ``items`` only the items named there.

    A loop gives one row per complete set of values, an unfinished last row is left out; single
    values of a category together give its row 0.  Only the first atom_site loop counts.
    """
    keep = None if wanted is None else set(wanted)
    single: dict[str, dict] = {}
    next_row: dict[str, int] = {}
    stream = Tokens(text)
    token = next(stream, None)
    while token is not None:
        value, quoted = token
        if not quoted and value.lower() == "loop_":
            tags = []
            token = next(stream, None)
            while token is not None and not token[1] and len(token[0]) > 1 and token[0][0] == "_":
                tags.append(split_tag(token[0]))
                token = next(stream, None)
            category = tags[0][0] if tags else ""
            names = [item for _, item in tags]
            used = bool(tags) and (keep is None or category in keep)
            used = used and not (category == "atom_site" and category in next_row)
            row, cells = next_row.get(category, 0), []
            needed = [(i, n) for i, n in enumerate(names) if items is None or category not in items or n in items[category]]
            every = len(needed) == len(names)
            for token in chain((token,), stream) if token is not None else ():
                word, quoted = token
                if not quoted and word[0] in SECTION_STARTS and ends_section(word, quoted):
                    break
                if used:
                    cells.append(word)
                    if len(cells) == len(names):
                        yield category, row, dict(zip(names, cells)) if every else {n: cells[i] for i, n in needed}
                        row += 1
                        for cells in stream.rows(len(names)):
                            yield category, row, dict(zip(names, cells)) if every else {n: cells[i] for i, n in needed}
                            row += 1
                        cells = []
            else:
                token = None
            if used:
                next_row[category] = row
            continue
        if not quoted and len(value) > 1 and value[0] == "_":
            category, item = split_tag(value)
            token = next(stream, None)
            if token is not None and (keep is None or category in keep):
                single.setdefault(category, {})[item] = token[0].strip()
        token = next(stream, None)
    for category, found in single.items():
        yield category, next_row.get(category, 0), found


def read_texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per file: ``(file, value)``."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def category_rows(texts: DataFrame, keys: Sequence[str] = KEY, text: str = "value",
                  categories: Sequence[str] | None = None, items: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Category rows of many files: keys, ``ordinal`` (order in the file), ``category``, ``row``, ``items``.

    All categories, or only the named ones; ``CATEGORIES`` are those the functions here read.  Of the loops of a
    category in ``items`` only the items named there; ``METADATA_ITEMS`` are those :func:`metadata` reads.
    """
    names = list(keys)
    source = texts.select(*names, F.col(text).alias("_text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name in names)
    wanted = None if categories is None else tuple(categories)
    only = None if items is None else {category: tuple(kept) for category, kept in items.items()}
    items_type = pa.map_(pa.string(), pa.string())

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            texts_column = batch.column(len(names))
            for at in range(batch.num_rows):
                text_value = texts_column[at].as_py()
                if text_value is None:
                    continue
                key = [c[at].as_py() for c in columns]
                pending: list = []
                ordinal = 0

                def flush():
                    data = [pa.array([k] * len(pending), type=c.type) for k, c in zip(key, columns)]
                    data.append(pa.array([p[0] for p in pending], type=pa.int64()))
                    data.append(pa.array([p[1] for p in pending], type=pa.string()))
                    data.append(pa.array([p[2] for p in pending], type=pa.int64()))
                    ends, names_flat, values_flat = [0], [], []
                    for _, _, _, items in pending:
                        names_flat.extend(items.keys())
                        values_flat.extend(items.values())
                        ends.append(len(names_flat))
                    data.append(pa.MapArray.from_arrays(
                        pa.array(ends, type=pa.int32()), pa.array(names_flat, type=pa.string()),
                        pa.array(values_flat, type=pa.string())).cast(items_type))
                    return pa.RecordBatch.from_arrays(data, names=[*names, "ordinal", "category", "row", "items"])

                for category, row, items in rows_of(text_value, wanted, only):
                    pending.append((ordinal, category, row, items))
                    ordinal += 1
                    if len(pending) >= BATCH_ROWS:
                        yield flush()
                        pending = []
                if pending:
                    yield flush()

    return source.mapInArrow(tokenise, f"{fields}, {ROW_SCHEMA}")


def cells(rows: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Category rows as single cells ``(category, row, item, value)``."""
    return rows.select(*keys, "category", "row", F.explode("items").alias("item", "value"))


def item(name: str) -> Column:
    """Value of an item, null when absent or one of the null marks ``.`` and ``?``."""
    value = F.try_element_at("items", F.lit(name))
    return F.when(~value.isin(".", "?"), value)


def atom_sites(rows: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Atom rows projected by item name; author numbering is preferred, rows without coordinates invalid."""
    # One map lookup per item.  Null marks are no numbers, no record name and no symbol, so only text
    # items have to be checked for them; that keeps the generated code small enough to be compiled.
    def raw(name: str) -> Column:
        return F.try_element_at("items", F.lit(name))

    numbers = {"x": "cartn_x", "y": "cartn_y", "z": "cartn_z", "_occupancy": "occupancy", "_b": "b_iso_or_equiv"}
    integers = {"_auth_seq": "auth_seq_id", "_label_seq": "label_seq_id", "_model": "pdbx_pdb_model_num"}
    sites = rows.where(F.col("category") == "atom_site").select(
        *keys, F.col("row").alias("line_no"),
        *[raw(n).try_cast("double").alias(c) for c, n in numbers.items()],
        *[raw(n).try_cast("int").alias(c) for c, n in integers.items()],
        *[raw(n).alias(f"_{n}") for n in TEXT_ITEMS])

    def text(*names: str, default: str = "") -> Column:
        return F.coalesce(*[F.when(~F.col(f"_{n}").isin(".", "?"), F.col(f"_{n}")) for n in names], F.lit(default))

    return sites.select(
        *keys, "line_no", (F.upper("_group_pdb").eqNullSafe("HETATM")).alias("is_hetatm"),
        text("auth_atom_id", "label_atom_id").alias("padded_name"), text("auth_atom_id", "label_atom_id").alias("name"),
        F.substring(text("label_alt_id", default=" "), 1, 1).alias("alt_loc"),
        text("auth_comp_id", "label_comp_id").alias("res_name"), text("auth_asym_id", "label_asym_id").alias("chain_id"),
        F.coalesce("_auth_seq", "_label_seq", F.lit(0)).alias("res_seq"),
        F.substring(text("pdbx_pdb_ins_code", default=" "), 1, 1).alias("ins_code"),
        "x", "y", "z", F.coalesce("_occupancy", F.lit(1.0)).alias("occupancy"),
        F.coalesce("_b", F.lit(0.0)).alias("b_factor"), F.coalesce("_type_symbol", F.lit("")).alias("symbol"),
        F.coalesce("_model", F.lit(1)).alias("model_no"), F.lit(False).alias("break_before"),
        (F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).alias("is_valid"))


def metadata(rows: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Identifier, title, method, resolution, prediction flag and model count of each file."""
    def latest(category: str, name: str) -> Column:
        value = item(name)
        return F.max_by(value, F.when((F.col("category") == category) & value.isNotNull(), F.col("ordinal")))

    model = F.when(F.col("category") == "atom_site", item("pdbx_pdb_model_num").try_cast("int"))
    found = rows.groupBy(*keys).agg(
        latest("entry", "id").alias("identifier"), latest("struct", "title").alias("title"),
        latest("exptl", "method").alias("method"),
        latest("refine", "ls_d_res_high").try_cast("double").alias("resolution"),
        F.bool_or(F.col("category") == "ma_qa_metric").alias("_metric"),
        F.greatest(F.lit(1), F.coalesce(F.max(model), F.lit(1))).alias("num_models"))
    predicted = (F.col("_metric") | F.coalesce(F.upper("identifier").startswith("AF-"), F.lit(False))
                 | F.coalesce(F.upper("title").contains("ALPHAFOLD"), F.lit(False)))
    return found.withColumn("is_prediction", predicted).drop("_metric")


def secondary_ranges(rows: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Ranges of both secondary-structure categories in file order."""
    kind_of = F.upper(F.coalesce(F.try_element_at("items", F.lit("conf_type_id")), F.lit("HELX")))
    conf = (F.when(kind_of.startswith("HELX"), "Helix")
            .when(kind_of.startswith("STRN") | kind_of.startswith("SHEET"), "Sheet")
            .when(kind_of.startswith("TURN") | kind_of.startswith("BEND"), "Turn"))
    kind = F.when(F.col("category") == "struct_conf", conf).otherwise(F.lit("Sheet"))

    def either(stem: str) -> Column:
        return F.coalesce(F.try_element_at("items", F.lit(stem.format("auth"))),
                          F.try_element_at("items", F.lit(stem.format("label"))))

    return (rows.where(F.col("category").isin("struct_conf", "struct_sheet_range"))
            .select(*keys, "ordinal", kind.alias("kind"), F.trim(either("beg_{}_asym_id")).alias("chain_id"),
                    F.coalesce(either("beg_{}_seq_id").try_cast("int"), F.lit(0)).alias("first_seq"),
                    F.coalesce(either("end_{}_seq_id").try_cast("int"), F.lit(0)).alias("last_seq"),
                    either("beg_{}_seq_id").isNotNull().alias("_b"), either("end_{}_seq_id").isNotNull().alias("_e"))
            .where(F.col("kind").isNotNull() & F.col("chain_id").isNotNull() & F.col("_b") & F.col("_e"))
            .drop("_b", "_e"))


register_pickle_by_value(sys.modules[__name__])
