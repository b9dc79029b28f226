"""Fuzzy search for short license notices.

A notice that may hold k edits is split into k + 1 pieces, one of which any match must hold exactly
(pigeonhole). An Aho-Corasick automaton of all pieces finds these seeds in one pass; around them
the regex library's bounded-error matching verifies the notice and counts edits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean, plus

#: Phrases that count exactly, word by word, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices searched with edits: label of each.
NOTICES = {
    "general public license": "gpl",
    "all rights reserved": "reserved",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "apache license version": "apache",
    "licensed under the apache license": "apache",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
}
#: One edit for so many characters of a notice.
CHARS_AN_EDIT = 9

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def allowed(notice: str) -> int:
    return max(1, len(notice) // CHARS_AN_EDIT)


def split(notice: str) -> list[tuple[int, str]]:
    """(offset, piece) of the edits + 1 pieces."""
    n = allowed(notice) + 1
    at = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(at, at[1:], strict=False)]


class Scanner:
    def __init__(self, notices: dict[str, str] = NOTICES, base: dict[str, str] = BASE):
        import ahocorasick
        import regex

        self.notices, self.base = notices, base
        self.seeds = ahocorasick.Automaton()
        where: dict[str, list[tuple[str, int]]] = {}
        for n in notices:
            for at, piece in split(n):
                where.setdefault(piece, []).append((n, at))
        for piece, uses in where.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()
        self.exact = {p: re.compile(f"(?<= ){re.escape(p)}(?= )") for p in base}
        self.fuzzy = {n: regex.compile(f"(?e)(?<= )(?:{regex.escape(n, literal_spaces=True)}){{e<={allowed(n)}}}(?= )") for n in notices}

    def scan(self, text: str | None) -> tuple[int, list[int], list[str], list[tuple[str, str, int, int, int]]]:
        """Number of words; starts of base phrases; their labels; notices found as (notice, label,
        first word, last word, edits)."""
        # bytes above 7F are word characters, so one character a byte will do
        words = (text or "").encode().translate(_TABLE).split()
        flat = " " + b" ".join(words).decode("latin-1") + " "
        starts: list[tuple[int, str]] = [(m.start(), p) for p, r in self.exact.items() if p in flat for m in r.finditer(flat)]
        windows: dict[str, list[list[int]]] = {}
        for end, (length, uses) in self.seeds.iter(flat):
            for n, at in uses:
                a = end - length + 1 - at - allowed(n) - 1
                b = a + len(n) + 2 * allowed(n) + 2
                known = windows.setdefault(n, [])
                if known and a <= known[-1][1] and b >= known[-1][0]:
                    known[-1] = [min(a, known[-1][0]), max(b, known[-1][1])]
                else:
                    known.append([a, b])
        found = []
        for n, known in windows.items():
            for a, b in _merged(known):
                for m in self.fuzzy[n].finditer(flat, max(0, a), min(len(flat), b)):
                    found.append((n, m.start(), m.end(), sum(m.fuzzy_counts)))
        if not starts and not found:
            return len(words), [], [], []
        spaces = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), np.uint8) == 32)
        word = lambda at: int(np.searchsorted(spaces, at)) - 1
        spans = [(n, self.notices[n], word(a), word(b - 1), e) for n, a, b, e in sorted(found, key=lambda x: (x[1], x[2], x[0]))]
        return len(words), sorted(word(a) for a, _ in starts), sorted({self.base[p] for _, p in starts}), spans


def _merged(windows: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


NEW = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<notice:string,label:string,first_word:bigint,last_word:bigint,edits:bigint>>"


def scan_licenses(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """docs (text and any other columns) with counts, labels, score and spans of license notices.

    Words are runs of ASCII letters, digits and characters above 7F, ASCII lower-cased. n_base
    counts all places of base phrases; first_word and last_word are the least and greatest start,
    null without one. labels holds the base labels and those of notices found with edits; score is
    the largest share of a match's characters that needed no edit (1 for base phrases, 0 for none).
    Null texts are empty: 0 words, empty labels. Columns of docs named like those added are
    replaced. An empty table gives no rows.
    """
    names = T.StructType.fromDDL(NEW).names
    docs = docs.drop(*names)
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("notice", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(notices)
        for b in lean(batches):
            rows = []
            for text in b.column(at):
                n, starts, base, spans = s.scan(text.as_py())
                best = max([1.0 if starts else 0.0, *(1 - e / len(x) for x, _, _, _, e in spans)])
                labels = sorted({*base, *(x[1] for x in spans)})
                keys = ("notice", "label", "first_word", "last_word", "edits")
                rows.append((n, len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(base), ",".join(labels), best, [dict(zip(keys, x, strict=True)) for x in spans]))
            if rows:
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [*b.schema.names, *names])

    return docs.mapInArrow(scan, plus(docs.schema, NEW))
