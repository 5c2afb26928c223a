"""License scans by conditional compression.

A text is seen as its words, whatever its lines.  Every template has anchors, so many of its
words that a run within the tolerance holds at least one of them.  Around each anchor lies a block in which a run of
each template fits.  Templates are ranked by how much smaller the run that they align with becomes with the template
as a raw zstandard dictionary, and confirmed by the exact wording: the one with the fewest differences
within the tolerance is the licence of its run.  The words before and after the run are searched on,
until no template is left.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .tools import id_of, text_of

# Short notices of public licences, by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# The wording of the licences themselves, or of the longer headers that they ask for.
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software,",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Anchors of last resort.
_COMMON = frozenset("a an and any are as at be by can do for form free from have in is it may not of on or other so such that the this to under use used version with without work you".split())
#: Every template of TEMPLATES has one of these; a line without them can't be a notice.
CANDIDATE = r"(?i)licen[sc]e|public domain|copyright"
_WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def anchors_of(templates: dict[str, str], tolerance: float) -> dict[str, set[str]]:
    """Of each template, words that can't all be missing from a run within the tolerance: the most particular first."""
    words = {n: words_of(t) for n, t in templates.items()}
    among = Counter(w for x in words.values() for w in set(x))
    out = {}
    for n, x in words.items():
        times, got, held = Counter(x), 0, set()
        for w in sorted(times, key=lambda w: (w in _COMMON or len(w) == 1, among[w], -len(w), w)):
            if got > tolerance * len(x):
                break
            held.add(w)
            got += times[w]
        out[n] = held
    return out


def differences(template: list[str], block: list[str]) -> tuple[int, int, int, list[str]]:
    """Words of the template that are missing or changed in the best run of the block, the run's first word and the one
    after its last, and the differing words (-: missing, +: added)."""
    match = difflib.SequenceMatcher(None, template, block, autojunk=False)
    same = [m for m in match.get_matching_blocks() if m.size]
    if not same:
        return len(template), 0, 0, [f"-{w}" for w in template]
    # the run of the block that lies about the longest match, as long as the template
    main = max(same, key=lambda m: m.size)
    start = max(0, main.b - main.a)
    end = min(len(block), start + len(template) + 2)
    ops = difflib.SequenceMatcher(None, template, block[start:end], autojunk=False).get_opcodes()
    while ops and ops[-1][0] == "insert":
        ops.pop()
    first = start
    while ops and ops[0][0] == "insert":
        first = start + ops[0][4]
        ops.pop(0)
    last = start + (ops[-1][4] if ops else 0)
    wrong, notes = 0, []
    for op, a, b, c, d in ops:
        if op != "equal":
            wrong += max(b - a, d - c)
            notes += [f"-{w}" for w in template[a:b]] + [f"+{w}" for w in block[start + c : start + d]]
    return wrong, first, last, notes


class Scanner:
    """Templates as raw-content dictionaries."""

    def __init__(self, templates: dict[str, str], tolerance: float, level: int = 3, winners: int = 4):
        self.names = sorted(templates)
        self.words = {n: words_of(templates[n]) for n in self.names}
        self.tolerance, self.winners = tolerance, winners
        self.alone = zstandard.ZstdCompressor(level=level)
        make = lambda t: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(" ".join(words_of(t)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        self.given = {n: make(templates[n]) for n in self.names}
        self.seen: dict[str, tuple | None] = {}
        self.times = {n: Counter(w) for n, w in self.words.items()}
        self.owners: dict[str, list[str]] = {}
        for n, held in anchors_of(templates, tolerance).items():
            for w in held:
                self.owners.setdefault(w, []).append(n)

    def enough(self, name: str, words: list[str]) -> bool:
        """Whether the words hold as many of the template's as a run within the tolerance does."""
        mine, least = self.times[name], len(self.words[name]) * (1 - self.tolerance)
        return sum(min(k, mine[w]) for w, k in Counter(w for w in words if w in mine).items()) >= least

    def around(self, words: list[str], i: int, lo: int, hi: int, name: str) -> tuple[int, int]:
        """The part of words[lo:hi] where a run of the template with word i lies."""
        reach = int(len(self.words[name]) * (1 + self.tolerance)) + 2
        return max(lo, i - reach), min(hi, i + reach + 1)

    def best(self, words: list[str], i: int, lo: int, hi: int) -> tuple | None:
        """(licence, bytes saved, differing words, their list, first word, word after the last) of the run around an anchor."""
        if not any(self.enough(n, words[slice(*self.around(words, i, lo, hi, n))]) for n in self.owners[words[i]]):
            return None
        found = []
        for n in self.names:
            a, b = self.around(words, i, lo, hi, n)
            if self.enough(n, words[a:b]):
                wrong, first, last, notes = differences(self.words[n], words[a:b])
                if wrong <= self.tolerance * len(self.words[n]):
                    data = " ".join(words[a + first : a + last]).encode()
                    saved = len(self.alone.compress(data)) - len(self.given[n].compress(data))
                    found.append((wrong / len(self.words[n]), -saved, n, wrong, notes, a + first, a + last))
        if not found:
            return None
        _, saved, n, wrong, notes, first, last = min(found)
        return n.partition("#")[0], -saved, wrong, notes, first, last

    def search(self, words: list[str]) -> list[tuple]:
        """All runs of the words that are within the tolerance of a template, in order."""
        out, open_parts = [], [(0, len(words))]
        while open_parts:
            lo, hi = open_parts.pop()
            for i in range(lo, hi):
                got = self.best(words, i, lo, hi) if words[i] in self.owners else None
                if got and got[5] > got[4]:
                    out.append(got)
                    open_parts += [(lo, got[4]), (got[5], hi)]
                    break
        return sorted(out, key=lambda x: x[4])

    def rank(self, block: list[str]) -> list[tuple[int, str]]:
        """Bytes saved by each template, most first; equal savings in order of name."""
        data = " ".join(block).encode()
        size = len(self.alone.compress(data))
        return sorted(((size - len(self.given[n].compress(data)), n) for n in self.names), key=lambda x: (-x[0], x[1]))

    def classify(self, line: str) -> tuple | None:
        """(licence, bytes saved, differing words, their list) of a line, or None."""
        if line in self.seen:
            return self.seen[line]
        block = words_of(line)
        found = None
        ranked = [x for x in self.rank(block) if x[0] > 0] if block else []
        if ranked:
            # all whose saving is not far below the best are compared word by word; fewest differences win
            close = [x for k, x in enumerate(ranked) if k < self.winners or x[0] >= ranked[0][0] - 4]
            checked = [(wrong, k, n, saved, notes) for k, (saved, n) in enumerate(close) for wrong, _, _, notes in [differences(self.words[n], block)]]
            wrong, _, n, saved, notes = min(checked)
            if wrong <= self.tolerance * len(self.words[n]):
                found = (n, saved, wrong, notes)
        if len(self.seen) > 50_000:
            self.seen.clear()
        self.seen[line] = found
        return found


_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saved_bytes", pa.int32()), ("differences", pa.int32()), ("differing_words", pa.string())])


def _scan(templates: dict[str, str], tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, tolerance)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                if scanner.owners.keys().isdisjoint(words):
                    continue
                at = [m.span() for m in _WORD.finditer(text)]
                for name, saved, wrong, notes, first, last in scanner.search(words):
                    out.append({"doc_id": doc_id, "start": at[first][0], "end": at[last - 1][1], "license": name, "saved_bytes": saved, "differences": wrong, "differing_words": " ".join(notes)})
            yield pa.RecordBatch.from_pylist(out, schema=_FOUND)

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, tolerance: float = 0.25) -> DataFrame:
    """A row per licence notice: doc_id, start and end of its wording in characters, license, saved_bytes, differences, differing_words.

    templates: by licence; what follows a # in its name isn't told, so that a licence can have several.
    tolerance: differing words allowed, as a share of the template's.  Null
    and empty texts have no notice.  Repeated rows each give their notices;
    an empty table gives none.
    """
    templates = templates or TEMPLATES | {f"{n}#text": t for n, t in TEXTS.items()}
    rows = docs.select(id_of(docs, id_col).alias("doc_id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(_scan(templates, tolerance), "doc_id long, start long, end long, license string, saved_bytes int, differences int, differing_words string")
