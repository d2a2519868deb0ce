"""License scans: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser evaluates expressions.

Texts are lower-cased (A-Z), and every byte outside words becomes one space; the automaton runs over these words, so a
phrase is found wherever its words stand consecutively. Where an identifier tag is found, the expression after it in the
original text is parsed with AND, OR, WITH and brackets, and evaluated to a licence family: OR takes the freer side, AND
the stricter, WITH an exception loosens strong copyleft to weak and changes no other family, an unknown one least of all.

Defined results: a null or empty text, or one without words, has no places, null first and last words, empty labels and
score 0. Overlapping places all count. A malformed expression gives the identifiers it names and no family. Repeated rows
get equal results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import arrow_text as tx
from tidemark.llm.shared import configure

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notice phrases of the method's own.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit-notice",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution": "cc",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "boost software license": "bsl",
    "unlicense": "unlicense",
}
TAGS = ("spdx license identifier", "license identifier")
_TAG = re.compile(r"(?:SPDX-)?License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
#: Families from freest to strictest, and whose identifiers are a key, or a key with more after a hyphen.
FAMILIES = ("public-domain", "permissive", "weak-copyleft", "strong-copyleft", "unknown")
WEAK, STRONG = 2, 3
FAMILY_OF = {"cc0": 0, "unlicense": 0, "0bsd": 0, "mit": 1, "apache": 1, "bsd": 1, "isc": 1, "zlib": 1, "bsl": 1, "cc-by-sa": 3, "cc-by": 1, "lgpl": 2, "mpl": 2, "epl": 2, "cddl": 2, "agpl": 3, "gpl": 3}
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RANK = {"or": 1, "and": 2, "with": 3}


def family_of(identifier: str) -> int:
    """The family's place in FAMILIES: that of the longest key that is the identifier, or the part of it before a hyphen."""
    name = identifier.lower().removesuffix("+")
    return max(((len(k), v) for k, v in FAMILY_OF.items() if name == k or name.startswith(f"{k}-")), default=(0, 4))[1]


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: operands and operators in postfix order; ValueError if it isn't an expression."""
    out: list[str] = []
    held: list[str] = []
    want_operand = True
    for token in re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*", expression):
        low = token.lower()
        if low in _RANK:
            if want_operand:
                raise ValueError(f"operand missing before {token}")
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[low]:
                out.append(held.pop())
            held.append(low)
            want_operand = True
        elif token == "(":
            if not want_operand:
                raise ValueError("operator missing before (")
            held.append(token)
        elif token == ")":
            if want_operand:
                raise ValueError("operand missing before )")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError("( missing")
            held.pop()
        else:
            if not want_operand:
                break  # prose after the expression
            out.append(token)
            want_operand = False
    if want_operand or "(" in held:
        raise ValueError("incomplete expression")
    return out + held[::-1]


def evaluate(expression: str) -> tuple[set[str], str | None]:
    """Identifiers (lower-cased) and the family of the whole; family None if the expression is malformed."""
    try:
        postfix = to_postfix(expression)
    except ValueError:
        return {t.lower() for t in re.findall(r"[A-Za-z0-9][A-Za-z0-9.+:-]*", expression) if family_of(t) < 4}, None
    stack: list[int] = []
    names: set[str] = set()
    for k, token in enumerate(postfix):
        if token not in _RANK:
            exception = k + 1 < len(postfix) and postfix[k + 1] == "with"
            if not exception:
                names.add(token.lower())
            stack.append(family_of(token))
            continue
        b, a = stack.pop(), stack.pop()
        stack.append(min(a, b) if token == "or" else max(a, b) if token == "and" else WEAK if a == STRONG else a)
    return names, FAMILIES[stack[0]]


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrases, kind in ((BASE, "base"), (NOTICES, "notice"), (dict.fromkeys(TAGS, "tag"), "tag")):
        for phrase, label in phrases.items():
            out.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
    out.make_automaton()
    return out


def scan(text: str, machine: ahocorasick.Automaton) -> tuple[int, int, int | None, int | None, str, str, float, str | None]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, family."""
    words = text.encode().translate(_WORDS).split()
    line = f" {b' '.join(words).decode()} "
    places: list[int] = []
    base, labels, family, tagged = set(), set(), None, False
    for end, (kind, label, length) in machine.iter(line):
        if kind == "base":
            places.append(end - length)
            base.add(label)
        elif kind == "notice":
            labels.add(label)
        else:
            tagged = True
    if tagged:
        for expression in _TAG.findall(text):
            names, found = evaluate(expression)
            labels |= {f"id:{n}" for n in names}
            if found is not None:
                family = found if family is None else max(family, found, key=FAMILIES.index)
        if family:
            labels.add(f"family:{family}")
    first = line.count(" ", 0, min(places)) if places else None
    last = line.count(" ", 0, max(places)) if places else None
    evidence = len(places) + len(labels - base) + 2 * (family is not None)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1 - 0.5**evidence, family


def scan_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document with places, labels, score and license_family."""
    configure(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "license_family"]
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]

    def run(batches):
        machine = automaton()
        for batch in batches:
            for part, data, at in tx.chunks(batch, "t"):
                found = [scan(t.decode(), machine) for t in tx.text_list(data, at)]
                yield pa.RecordBatch.from_arrays([tx.column(part, "i"), *(pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), types, strict=True))], ["i", *names])

    out = docs.mapInArrow(run, f"i {docs.schema['i'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, license_family string")
    return out.withColumnRenamed("i", id_col)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
