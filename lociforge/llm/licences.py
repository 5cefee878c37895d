"""Licence scans by conditional compression.

A block of text that leads to a licence cue, from a line, a sentence or the word where a template holding the cue would
begin, is compressed alone and with each template as a raw zstandard
dictionary. Templates are ranked by the bytes they save; those that save enough are compared with the block word by word,
and the one whose wording differs least, if by few enough words, is the finding. Words with digits may not differ: a notice
of another version is another notice.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts_of

#: The wording of the notices that are looked for.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
#: Every template has one of these in its first line.
CUES = r"(?i)licen[sc]e|free software|permission|redistribution|rights\s+reserved|copyright"
_SENTENCE = re.compile(r"[.!?:;]\s+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_words(text: str) -> list[str]:
    """Lower-cased words without punctuation at their ends."""
    return [w for x in _WORD.findall(text.lower()) if (w := x.strip(".,;:()\"'[]*#/"))]


def _cue_kind(cue: str) -> str:
    """Spellings of a cue in one form."""
    return " ".join(cue.lower().split()).replace("licence", "license")


def changed_words(a: list[str], b: list[str]) -> int:
    """Words to be put in, taken out or replaced to make b of a; all of both where a word of a that holds a digit is among them."""
    ops = [op for op in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op[0] != "equal"]
    if any(c.isdigit() for _, i, j, _, _ in ops for w in a[i:j] for c in w):
        return len(a) + len(b)
    return sum(max(i2 - i1, j2 - j1) for _, i1, i2, j1, j2 in ops)


class Scanner:
    def __init__(self, templates: dict[str, str], min_saved: float, max_changed: float):
        import zstandard as z

        self.plain = z.ZstdCompressor(level=3, write_content_size=False)
        self.min_saved, self.max_changed, self.cue = min_saved, max_changed, re.compile(CUES)
        self.templates = []
        for name, text in templates.items():
            d = z.ZstdCompressionDict(text.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
            self.templates.append((name, plain_words(text), len(_WORD.findall(text)), z.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False)))

        self.cue_at: dict[str, dict[int, list]] = {}  # by cue: words before it in a template, templates
        for t, text in zip(self.templates, templates.values(), strict=True):
            starts = [m.start() for m in _WORD.finditer(text)]
            for m in self.cue.finditer(text):
                same = self.cue_at.setdefault(_cue_kind(m.group()), {}).setdefault(bisect_right(starts, m.start()) - 1, [])
                if t not in same:
                    same.append(t)

    def at(self, text: str, start: int, templates: list | None = None) -> tuple | None:
        """The finding at a word start: (name, end of the block, its bytes alone, saved bytes, changed words, their share).

        Blocks are ranked at a template's length; the wording is compared with as many words more as may be changed."""
        templates = self.templates if templates is None else templates
        ends: dict[int, int] = {}
        longest = max(n + int(self.max_changed * len(words)) for _, words, n, _ in templates)
        for i, m in enumerate(_WORD.finditer(text, start), 1):
            ends[i] = m.end()
            if i == longest:
                break
        ranked = []
        for name, words, n, packer in templates:
            alone, saved = self.sizes(text[start : ends[min(n, len(ends))]], packer)
            if saved >= self.min_saved * alone:
                ranked.append((saved / alone, saved, name, words, n, packer))
        ranked.sort(key=lambda x: (-x[0], -x[1], x[2]))
        best = None
        for rank, (_, _, name, words, n, packer) in enumerate(ranked):
            tried = sorted({min(n + more, len(ends)) for more in range(int(self.max_changed * len(words)) + 1)})
            changed, n = min((changed_words(words, plain_words(text[start : ends[k]])), k) for k in tried)
            key = changed / len(words), -len(words), rank
            if changed <= self.max_changed * len(words) and (best is None or key < best[0]):
                best = key, name, n, packer, changed
        if best is None:
            return None
        (share, *_), name, n, packer, changed = best
        return name, ends[n], *self.sizes(text[start : ends[n]], packer), changed, share

    def sizes(self, block: str, packer) -> tuple[int, int]:
        """Bytes of a block compressed alone, and how many the template saves."""
        alone = len(self.plain.compress(raw := block.encode()))
        return alone, alone - len(packer.compress(raw))

    def before(self, text: str, floor: int, cue: int, n: int) -> list[int]:
        """Starts of the word that holds the cue and of up to n words before it, the nearest first."""
        size = 512
        while True:
            low = max(floor, cue - size)
            starts = [x.start() for x in _WORD.finditer(text, low, cue + 1)]
            if low == floor or len(starts) > n + 1:  # the first may be cut in two
                return starts[::-1][: n + 1]
            size *= 2

    def scan(self, text: str) -> Iterator[tuple]:
        """(start, *finding) for every cue that isn't inside an earlier finding: of the starts that lead to it the one with
        the least share of changed words."""
        done = floor = 0
        for m in self.cue.finditer(text):
            if m.start() < done:
                continue
            line = max(done, text.rfind("\n", done, m.start()) + 1)
            before = text[line : m.start()]
            sentence = max((x.end() for x in _SENTENCE.finditer(before)), default=0)
            done = m.end()
            best = None
            for s in sorted({line + sentence, line + len(before) - len(before.lstrip())}, reverse=True):  # the nearest first
                if (found := self.at(text, s)) and (best is None or found[-1] < best[-1]):
                    best = s, *found
            if best is None or best[-1]:
                by_offset = self.cue_at.get(_cue_kind(m.group()), {})
                starts = self.before(text, floor, m.start(), max(by_offset, default=0))
                for k in sorted(by_offset):
                    if k < len(starts) and (found := self.at(text, starts[k], by_offset[k])) and (best is None or found[-1] < best[-1]):
                        best = starts[k], *found
            if best:
                yield best[:-1]
                done = floor = max(done, best[2])


def scan_licences(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_saved: float = 0.25, max_changed: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per finding: doc_id, start (code points before it), licence, block_bytes (compressed alone), saved_bytes,
    changed_words.

    Of templates that differ alike the longest is the finding, then the one that saves most. Whole texts are searched, from each line, sentence or template's first word that leads to a cue. Null and empty texts have no finding, nor
    do texts without cues, which don't leave Spark; null ids stay; rows with the same id are searched one by one; of
    templates that save alike the first by name goes first; an empty table gives no rows; other columns are not read.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").where(F.col("text").rlike(CUES))
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("licence", pa.string()), ("block_bytes", pa.int64()), ("saved_bytes", pa.int64()), ("changed_words", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_saved, max_changed)
        for batch in batches:
            found = []
            for doc, raw in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                found += [(doc, s, name, alone, saved, changed) for s, name, _, alone, saved, changed in scanner.scan(raw.decode())]
            cols = zip(*found, strict=True) if found else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], schema=pa.schema(kinds))

    return arrow_map(rows, run, "doc_id long, start long, licence string, block_bytes long, saved_bytes long, changed_words long")
