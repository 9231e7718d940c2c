"""Licences named in texts: notice phrases, identifier tags, and licence expressions.

An Aho-Corasick automaton runs once over the words of a whole batch and finds all phrases and tags.  Behind a tag
stands an expression of identifiers joined by ``and``, ``or``, ``with`` and parentheses; a shunting-yard parser turns
it into postfix order and evaluates it: of alternatives the freest holds, of a conjunction the strictest, and an
exception loosens its licence by one step.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, query, table
from .spans import spans
from .words import buffers, chunks

WORDS = np.zeros(256, dtype=bool)
WORDS[48:58] = WORDS[65:91] = WORDS[97:123] = WORDS[128:] = True

#: Steps of strictness, as shares of one.
FREE, WEAK, STRONG, CLOSED = 0.25, 0.5, 0.75, 1.0
#: Phrases whose places are counted.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases.
NOTICES = {
    "affero general public license": "agpl", "lesser general public license": "lgpl", "library general public license": "lgpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "european union public licence": "eupl",
    "apache license": "apache", "mit license": "mit", "isc license": "isc", "boost software license": "bsl", "zlib license": "zlib",
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd", "2 clause bsd": "bsd", "3 clause bsd": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense", "no rights reserved": "cc0", "cc0 1 0": "cc0",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "cc by sa": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd",
    "public domain": "public-domain", "unauthorized copying": "proprietary", "proprietary and confidential": "proprietary",
}
#: Words before an expression; the sign has to follow at once, blanks aside.
TAGS = {"spdx license identifier": ("spdx", ":"), "license": (":", "="), "licence": (":", "=")}
#: Strictness by label.
STEPS = {
    "mit": FREE, "apache": FREE, "bsd": FREE, "isc": FREE, "zlib": FREE, "bsl": FREE, "unlicense": FREE, "cc0": FREE, "public-domain": FREE,
    "cc-by": FREE, "mpl": WEAK, "lgpl": WEAK, "epl": WEAK, "eupl": WEAK, "cc-by-sa": WEAK, "gpl": STRONG, "agpl": STRONG, "cc-by-nc": STRONG,
    "cc-by-nd": STRONG, "reserved": CLOSED, "proprietary": CLOSED, "unlisted": CLOSED,
}
#: Identifiers begin so; the first that fits names the label.
IDENTIFIERS = ("cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by", "cc0", "unlicense", "apache", "mit", "bsd", "isc", "zlib", "bsl", "mpl", "lgpl",
               "agpl", "gpl", "epl", "eupl")
_TOKEN = re.compile(rb"[ \t]*(?:([()])|([a-z0-9][a-z0-9.+:-]*))")
_RANK = {"or": 1, "and": 2, "with": 3}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """All phrases and tags, as words between blanks."""
    found = ahocorasick.Automaton()
    for phrase, label in (NOTICES | BASE).items():
        found.add_word(f" {phrase} ", (len(phrase.split(" ")), label, phrase in BASE, ()))
    for phrase, signs in TAGS.items():
        found.add_word(f" {phrase} ", (len(phrase.split(" ")), "", False, signs))
    found.make_automaton()
    return found


def label_of(identifier: str) -> str:
    """Label of an identifier; 'unlisted' if it begins like none that is known."""
    plain = identifier.rstrip("+")
    return next((name for name in IDENTIFIERS if plain == name or plain.startswith(name + "-")), "unlisted")


def tokens(line: bytes) -> list[str]:
    """Identifiers, operators and parentheses from the start of a lower-case line as far as they go."""
    found, at = [], 0
    while hit := _TOKEN.match(line, at):
        found.append((hit[1] or hit[2].rstrip(b".:")).decode())
        at = hit.end()
    return found


def postfix(found: list[str]) -> list[str]:
    """Shunting-yard: the longest expression at the start of the tokens, in postfix order; empty if there is none.

    ``with`` binds before ``and``, ``and`` before ``or``, equal operators to the left.  Reading ends where no
    expression goes on (two identifiers in a row); an operator without a right side or open parentheses are no expression.
    """
    out, waiting, operand = [], [], True  # operand: an identifier or an opening parenthesis comes next
    for token in found:
        if operand and token == "(":
            waiting.append(token)
        elif operand and token not in _RANK and token != ")":
            out.append(token)
            operand = False
        elif not operand and token in _RANK:
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        elif not operand and token == ")" and "(" in waiting:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        else:
            break
    if operand or "(" in waiting:
        return []
    return out + waiting[::-1]


def evaluate(order: list[str]) -> tuple[float, set[str], str] | None:
    """Strictness, labels and canonical text of an expression in postfix order; None if an exception has no licence."""
    stack: list[tuple[float, set[str], str, int]] = []
    for token in order:
        if token not in _RANK:
            label = label_of(token)
            stack.append((STEPS[label], {label}, token, 4))
            continue
        (b, right, said, bound), (a, left, text, loose) = stack.pop(), stack.pop()
        if token == "with":
            if bound < 4 or loose < 4:  # an exception stands between two identifiers
                return None
            stack.append((max(FREE, a - 0.25), left, f"{text} with {said}", 3))
        else:
            text, said = (f"({x})" if k < _RANK[token] else x for x, k in ((text, loose), (said, bound)))
            stack.append(((min if token == "or" else max)(a, b), left | right, f"{text} {token} {said}", _RANK[token]))
    return stack[0][:3] if stack else None


FINDINGS = "array<struct<word:long,label:string,step:double,base:boolean,expression:string>>"
_KIND = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("step", pa.float64()), ("base", pa.bool_()), ("expression", pa.string())]))


def scan(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, list[list[tuple]]]:
    """Number of words and findings of each of some texts."""
    found = spans(offsets, data, WORDS)
    texts = len(offsets) - 1
    n_words = np.bincount(found.owner, minlength=texts)
    results: list[list[tuple]] = [[] for _ in range(texts)]
    if not len(found.start):
        return n_words, results
    first_word = np.cumsum(n_words) - n_words
    fresh = np.append(True, found.owner[1:] != found.owner[:-1])  # a text's first word has a line end before it too
    at = found.at + np.arange(len(found.at)) + 1 + 2 * (np.cumsum(fresh) - 1)  # blanks around words, a line end between texts
    line = np.full(int(at[-1] + found.length[-1] + 1), 32, np.uint8)
    line[at[fresh][1:] - 2] = 10
    line[np.repeat(at - found.at, found.length) + np.arange(len(found.data))] = found.data
    for end, (size, label, base, signs) in automaton().iter(line.tobytes().decode("latin-1")):
        last = int(np.searchsorted(at, end, side="left")) - 1
        owner, word = int(found.owner[last]), last - size + 1
        place = word - int(first_word[owner])
        if not signs:
            results[owner].append((place, label, STEPS[label], base, None))
            continue
        behind, stop = int(found.start[last] + found.length[last]), int(offsets[owner + 1])
        while behind < stop and data[behind] in (32, 9):
            behind += 1
        if behind < stop and chr(data[behind]) in signs:
            rest, size = data[behind + 1:stop], 256
            while size < len(rest) and not np.isin(rest[:size], (10, 13)).any():
                size *= 2
            text = re.split(rb"[\r\n]", rest[:size].tobytes(), maxsplit=1)[0].lower().lstrip(b" \t\"'")
            value = evaluate(postfix(tokens(text)))
            if value and ("spdx" in signs or "unlisted" not in value[1]):  # prose follows the other tags too
                results[owner] += [(place, name, value[0], False, value[2]) for name in sorted(value[1])]
    return n_words, results


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, text) to (key, n_words, findings)."""
    for batch in batches:
        offsets, data = buffers(batch.column(1))
        for first, last in chunks(offsets):
            n_words, found = scan(offsets[first:last + 1] - offsets[first], data[offsets[first]:offsets[last]])
            rows = [[dict(zip(("word", "label", "step", "base", "expression"), hit, strict=True)) for hit in hits] for hits in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(n_words, pa.int64()), pa.array(rows, _KIND)],
                                             ["id", "n_words", "findings"])


def licenses(rows: DataFrame, key: Column, text: Column) -> DataFrame:
    """``id``, ``n_words`` and ``findings`` of every row: what names a licence, where (words from 0) and how strict it is.

    Words are runs of A-Z, a-z, 0-9 and non-ASCII characters, A-Z lower-cased; words of a phrase stand in a row, whatever is between
    them.  ``base`` marks the phrases of :data:`BASE`; ``expression`` is the canonical form of an expression behind a
    tag, with one finding for each of its labels.  A null text is empty; null keys and equal rows stay as they
    are; other columns are ignored; an empty table gives no rows.  Whole texts are read; one of more than half a
    megabyte is scanned on its own and needs some 40 bytes of a worker's memory a byte.
    """
    named = rows.select(key.alias("id"), text.alias("text"))
    return named.mapInArrow(scan_batches, f"id {named.schema['id'].dataType.simpleString()}, n_words long, findings {FINDINGS}")


@query("op13_licenses")
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document; ``score`` is the strictness of its strictest finding, 0 without any."""
    bounded_batches(spark)
    found = licenses(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
    base = F.filter("findings", lambda x: x["base"])
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["label"]))), ",")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["word"])).alias("first_word"), F.array_max(F.transform(base, lambda x: x["word"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("findings")).alias("labels"),
        F.coalesce(F.array_max(F.transform("findings", lambda x: x["step"])), F.lit(0.0)).alias("score"))
