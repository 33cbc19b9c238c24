"""License scan by conditional compression.

Documents that hold a cue word of licensing are read as words, so line breaks and
comment marks do not part a notice. Where a window of the document shares so many word
pairs with a template that this may stand there, the template is aligned: the least
number of template words that are missing and of words that are added in between. A
passage without a difference is ``exact``, one that differs in up to ``ALTERED`` of the
template's words is ``altered``; others are not reported. Every confirmed passage is
reported that holds a cue and does not overlap a better one, however many a line has:
that which has the most words in common less the differences, of equals that with the
longer template, then that whose template as a raw zstandard dictionary makes the
compressed passage smaller by most. Templates are short notices, source headers and full
texts. Every license that an SPDX tag names is a row of its own, ``exact``.

Defined results: null and empty texts give no rows, nor do empty tables; repeated rows
give rows each; start and length are those of the passage, in characters.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.license_forms import more_forms

#: Short notices by which texts state their license, and the words that announce one.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Released under the ISC License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Reserved": "All rights reserved.",
}
CUES = r"licen[sc]e|copyright|rights\s+reserved|public\s+domain|source\s+code\s+form|\bcc0\b|permission\s+(?:is|to)\b|hereby\s+granted|redistribut|as\s+is\b|free\s+software|without\s+(?:any\s+)?warrant|general\s+public|\bspdx-"

#: Share of words in which an altered notice may differ, and the level of compression.
ALTERED, LEVEL = 0.25, 3
SCHEMA = "doc_id long, start int, length int, license string, status string, reduction double, missing_words int, added_words int"

#: Every wording that is looked for, with its license.
FORMS = list(TEMPLATES.items()) + more_forms()

_CUE = re.compile(CUES, re.IGNORECASE)
_WORD = re.compile(r"[0-9A-Za-z]+(?:[.-][0-9A-Za-z]+)*")
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*", re.IGNORECASE)
#: An expression: names joined by operators, in brackets; an exception that follows WITH is no license.
_NAME = r"[ \t]*(?P<open>\(?[ \t(]*)(?P<name>[A-Za-z0-9][A-Za-z0-9.:-]*\+?)[ \t)]*"
_STATED = re.compile(_NAME), re.compile(r"(?P<how>AND|OR|WITH)\b" + _NAME, re.IGNORECASE)
_VERSIONS = re.compile(r"(?:-only|-or-later|\+)$", re.IGNORECASE)
_ONE, _FAR = 1 << 32, 1 << 31


def _compressor(text: str | None) -> zstandard.ZstdCompressor:
    more = {} if text is None else {"dict_data": zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)}
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False, **more)


@cache
def _compressors() -> tuple[zstandard.ZstdCompressor, list[zstandard.ZstdCompressor]]:
    return _compressor(None), [_compressor(text) for _, text in FORMS]


def reduction(block: str, form: int) -> float:
    """Share by which the form as a dictionary reduces the block's compressed size."""
    plain, given = _compressors()
    data = block.lower().encode()
    return 1 - len(given[form].compress(data)) / len(plain.compress(data))


def rank(block: str) -> list[tuple[float, str]]:
    """Reduction of the block's compressed size by each license's best form, the largest first."""
    found: dict[str, float] = {}
    for form, (name, _) in enumerate(FORMS):
        found[name] = max(found.get(name, -1.0), reduction(block, form))
    return sorted(((r, name) for name, r in found.items()), key=lambda x: (-x[0], x[1]))


class _Form:
    """A form's words as numbers, and where each of them stands."""

    def __init__(self, words: list[int]) -> None:
        self.n, self.most = len(words), int(ALTERED * len(words))
        at = defaultdict(list)
        for i, w in enumerate(words):
            at[w].append(i)
        self.at = {w: np.array(places) for w, places in at.items()}
        # what is kept of the form are at most most + 1 runs, so as many pairs less are whole
        self.window, self.pairs = self.n + self.most, max(self.n - 2 * self.most - 1, 1)

    def regions(self, shared: np.ndarray, words: int) -> list[tuple[int, int]]:
        """Runs of words in which some window shares enough pairs; ``shared``: whether the pair that begins at a word is one of the form."""
        size = max(min(self.window, words) - 1, 1)
        if len(shared) < size:
            return []
        total = np.concatenate([[0], np.cumsum(shared)])
        good = np.flatnonzero(total[size:] - total[:-size] >= self.pairs)
        if not len(good):
            return []
        cuts = np.flatnonzero(np.diff(good) > size) + 1
        return [(int(g[0]), min(int(g[-1]) + size + 1, words)) for g in np.split(good, cuts)]

    def align(self, words: list[int]) -> list[tuple[int, int, int]]:
        """Start, end and differences of the passages that are the form with ``most`` differences at most, the best of each start."""
        steps = np.arange(self.n + 1, dtype=np.int64) * _ONE
        last = steps + _FAR
        best: dict[int, tuple[int, int]] = {}
        for j, w in enumerate(words):
            # differences in the upper half, in the lower one what orders equals by the latest start
            now = last + _ONE
            places = self.at.get(w)
            if places is not None:
                now[places + 1] = np.minimum(now[places + 1], last[places])
            now[0] = _FAR - (j + 1)
            last = np.minimum.accumulate(now - steps) + steps
            end = int(last[-1])
            cost, start = end >> 32, _FAR - (end & (_ONE - 1))
            if cost <= self.most and start <= j and (start not in best or cost < best[start][0]):
                best[start] = cost, j + 1
        return [(start, end, cost) for start, (cost, end) in best.items()]


@cache
def _index() -> tuple[dict[str, int], list[_Form], np.ndarray, np.ndarray]:
    """Numbers of the forms' words, the forms, all their word pairs in order, and which form has which pair."""
    number: dict[str, int] = {}
    texts = [[number.setdefault(w.lower(), len(number)) for w in _WORD.findall(text)] for _, text in FORMS]
    pairs = [{a << 32 | b for a, b in zip(t, t[1:], strict=False)} for t in texts]
    known = np.array(sorted(set().union(*pairs)), np.int64)
    return number, [_Form(t) for t in texts], known, np.array([np.isin(known, np.array(sorted(p), np.int64)) for p in pairs])


def _candidates(text: str, places: list[tuple[int, int]], words: np.ndarray, taken: np.ndarray) -> list[tuple]:
    """Passages outside of what is taken that some form confirms: order, start, end, form, missing and added words."""
    _, forms, known, has = _index()
    numbers = np.where(taken, -1, words)
    codes = np.where((numbers[:-1] >= 0) & (numbers[1:] >= 0), numbers[:-1] << 32 | numbers[1:], -1)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    hit = known[at] == codes
    if not hit.any():
        return []
    possible = has[:, np.unique(at[hit])].sum(1)
    found = []
    for f, form in enumerate(forms):
        if possible[f] == 0:
            continue
        for begin, end in form.regions(has[f][at] & hit, len(words)):
            for a, b, cost in form.align(numbers[begin:end].tolist()):
                a, b = a + begin, b + begin
                missing = (cost + form.n - (b - a)) // 2
                first, last = places[a][0], places[b - 1][1]
                if not taken[a:b].any() and _CUE.search(text, first, last):
                    order = (-(form.n - missing - cost), -form.n, -reduction(text[first:last], f), a, f)
                    found.append((order, a, b, f, missing, cost - missing))
    return found


def passages(text: str) -> list[tuple[int, int, str, str, float, int, int]]:
    """Start, length, license, status, reduction, missing and added words of every notice, in order."""
    number = _index()[0]
    spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    tags = _tags(text)
    if len(spans) < 2:
        return tags
    words = np.array([number.get(text[a:b].lower(), -1) for a, b in spans], np.int64)
    taken, found = np.zeros(len(words), bool), []
    while True:  # again, as what overlapped a better passage may be one without the shared words
        before = len(found)
        for order, a, b, f, missing, added in sorted(_candidates(text, spans, words, taken)):
            if not taken[a:b].any():
                taken[a:b] = True
                first, last = spans[a][0], spans[b - 1][1]
                found.append((first, last - first, FORMS[f][0], "altered" if missing + added else "exact", -order[2], missing, added))
        if len(found) == before:
            return sorted(found + tags)


def _tags(text: str) -> list[tuple]:
    """Rows of the licenses that SPDX tags name."""
    plain = _compressor(None)
    names = {name.lower(): name for name, _ in FORMS}
    found = []
    for tag in _TAG.finditer(text):
        one, how = _STATED[0].match(text, tag.end()), None
        while one:
            if how != "WITH":
                stated = one["name"].rstrip(".:")
                base = _VERSIONS.sub("", stated)
                name = names.get(base.lower(), stated)
                block = text[tag.start() : one.end("name")].lower().encode()
                given = _compressor(f"SPDX-License-Identifier: {stated}")
                gain = 1 - len(given.compress(block)) / len(plain.compress(block))
                found.append((one.start("name"), len(stated), name, "exact", gain, 0, 0))
            one = _STATED[1].match(text, one.end())
            how = one and one["how"].upper()
    return found


def identify(block: str) -> tuple[str, str, float, int, int] | None:
    """License, status, reduction, missing and added words of the longest notice of a block, if there is one."""
    found = max(passages(block), key=lambda x: x[1], default=None)
    return found and found[2:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice of each document."""

    def run(batches):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
        for batch in batches:
            rows = [(doc_id.as_py(), *p) for doc_id, text in zip(batch.column(0), batch.column(1), strict=True) for p in passages(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    # texts without a cue never leave the JVM
    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike("(?i)" + CUES))
    return some.mapInArrow(run, SCHEMA)
