"""License scans by conditional compression.

A block is a line that holds license wording with up to NEAR short lines on either side. Each candidate block is compressed with zstandard
alone and with each license template as raw dictionary; the fall in size per byte of the smaller text ranks the templates. The
TOP best are confirmed by their exact wording: block and template are cut into lower-case words, the template's best place in the block is aligned,
and the inserted, missing and changed words are listed. A template is confirmed as exact when nothing differs, as a variant when
at most VARIANT of its words do and no word that must stay (names and versions) differs, and rejected otherwise.

All rows and whole texts are scanned in one pass; templates are a small constant; nothing is shuffled, so copies and hot sources need no care. Null and empty
texts have no blocks; a table without rows gives none; repeated rows are reported each, under the same id; ties in rank go to
the longer template, then to the name; other columns are ignored. Positions are code points, ends exclusive.
"""
from __future__ import annotations

import difflib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketframe.llm import texts
from marketframe.llm.registry import query, table

# Wording of license notices, and the words of each that must not differ.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    "Apache-2.0-header": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                          "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache", "2.0")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "public", "3")),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "public", "2")),
    "GPL-3.0-header": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                       "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                       ("gnu", "general", "public", "3")),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", ("gnu", "lesser", "3")),
    "MIT": ("Released under the MIT License.", ("mit",)),
    "MIT-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                  '(the "Software"), to deal in the Software without restriction', ("free", "charge")),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met", ("redistribution",)),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", ("cc", "by", "4.0")),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", ("cc", "by", "sa", "4.0")),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", ("cc", "by", "nc", "4.0")),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", ("cc", "by", "nd", "4.0")),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights: CC0 1.0.", ("cc0",)),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2.0")),
    "Proprietary": ("All rights reserved.", ("rights", "reserved")),
}
# Byte patterns that make a line a candidate (lower case).
CUES = (b"licen", b"copyright", b"permission is", b"all rights reserved", b"redistribution and use", b"spdx", b"(c) ", b"creative commons", b"free software")
TOP, VARIANT, NEAR = 5, 0.25, 2
#: bytes of a neighbouring line that may belong to a notice
SHORT = 160
LEVEL = 3
#: length of a window in a long block, in spans that the longest notice may take
WINDOW = 10
#: lines longer than this many bytes are cut around their cues, in overlapping pieces that cover every cue
LINE = 2048
WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*|[^\W\d_]+[0-9]*")
OUT = ("doc_id long, start long, end long, license string, verdict string, reduction double, n_missing int, n_added int, differences string")


class Scanner:
    """Compressors per template, made once per task."""

    def __init__(self, templates=None):
        self.templates = templates or TEMPLATES
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.with_dict, self.words, self.sizes = {}, {}, {}
        for name, (text, _) in self.templates.items():
            raw = text.lower().encode()
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.with_dict[name] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
            self.words[name], self.sizes[name] = WORD.findall(text.lower()), len(raw)

    def rank(self, block: str) -> list[tuple[float, str]]:
        """Templates by the bytes they save, per byte of the smaller of block and template; the best first."""
        raw = block.lower().encode()
        alone = len(self.plain.compress(raw))
        saved = [((alone - len(c.compress(raw))) / min(len(raw), self.sizes[name]), name) for name, c in self.with_dict.items()]
        return sorted(((s, n) for s, n in saved if s > 0), key=lambda x: (-round(x[0], 6), -self.sizes[x[1]], x[1]))

    def confirm(self, block: str, name: str):
        """(verdict, start, end, missing, added, differences) of the template in the block; None if the wording differs too much."""
        spans = [(m.group(), m.start(), m.end()) for m in WORD.finditer(block.lower())]
        own, want = [w for w, _, _ in spans], self.words[name]
        match = difflib.SequenceMatcher(None, own, want, autojunk=False)
        parts = [b for b in match.get_matching_blocks() if b.size]
        if not parts:
            return None
        # the run of matches around the longest one; words outside it belong to the text
        main = max(parts, key=lambda b: b.size)
        parts = [b for b in parts if abs((b.a - b.b) - (main.a - main.b)) <= len(want) // 2]
        first, last = parts[0].a, parts[-1].a + parts[-1].size
        held = sum(b.size for b in parts)
        kept = {w for b in parts for w in want[b.b:b.b + b.size]}
        missing, added = len(want) - held, (last - first) - held
        if not set(self.templates[name][1]) <= kept or missing + added > VARIANT * len(want):
            return None
        notes = []
        for op, a0, a1, b0, b1 in difflib.SequenceMatcher(None, own[first:last], want, autojunk=False).get_opcodes():
            if op != "equal":
                notes.append(f"-{' '.join(want[b0:b1])}+{' '.join(own[first:last][a0:a1])}")
        return ("exact" if not missing and not added else "variant", spans[first][1], spans[last - 1][2], missing, added, ";".join(notes))

    def scan(self, block: str):
        """Confirmed licenses of a block, each place by its best template.

        A block of many notices is taken in windows, so that time follows its length: what ends in the last part of a window, which
        may hold the beginning of a longer notice, is left to the next one, which begins there.
        """
        reach = 2 * max(self.sizes.values())
        out, at = [], 0
        while len(block) - at > WINDOW * reach:
            here = [(name, saved, (got[0], got[1] + at, got[2] + at, *got[3:])) for name, saved, got in self._scan(block[at:at + WINDOW * reach])]
            sure = [x for x in here if x[2][2] <= at + (WINDOW - 1) * reach]
            out += sure
            at = max([at + (WINDOW - 1) * reach - reach, *[x[2][2] for x in sure]])
        return out + [(name, saved, (got[0], got[1] + at, got[2] + at, *got[3:])) for name, saved, got in self._scan(block[at:])]

    def _scan(self, block: str):
        """The licenses of a window. What is found is blanked and the rest ranked again."""
        out = []
        while True:
            found = []
            for saved, name in self.rank(block)[:TOP]:
                got = self.confirm(block, name)
                if got:
                    found.append((got[3] + got[4] > 0, -(got[2] - got[1]), -saved, name, saved, got))
            if not found:
                return sorted(out, key=lambda x: x[2][1])
            *_, name, saved, got = min(found)
            out.append((name, saved, got))
            block = block[:got[1]] + " " * (got[2] - got[1]) + block[got[2]:]


def _blocks(chunk: texts.Chunk):
    """(row, start byte, end byte) of candidate blocks: lines with a cue and NEAR lines around them, joined where they touch."""
    low = texts.LOWER[chunk.data].tobytes()
    cues = sorted({m.start() for cue in CUES for m in re.finditer(re.escape(cue), low)})
    if not cues:
        return
    feeds = np.flatnonzero(chunk.data == 10)
    edges = np.unique(np.concatenate([chunk.offsets, feeds + 1]))
    edges = edges[edges <= len(low)]
    spans: list[list[int]] = []
    for at in cues:
        row = int(np.searchsorted(chunk.offsets, at, side="right")) - 1
        i = int(np.searchsorted(edges, at, side="right")) - 1
        first, last = i, min(i + 1, len(edges) - 1)
        for _ in range(NEAR):       # notices run over lines of moderate length; a long paragraph next to one is not part of it
            first -= first > 0 and edges[first] - edges[first - 1] <= SHORT
            last += last + 1 < len(edges) and edges[last + 1] - edges[last] <= SHORT
        a, b = int(edges[first]), int(edges[last])
        a, b = max(a, int(chunk.offsets[row]), at - LINE), min(b, int(chunk.offsets[row + 1]), at + LINE)
        while a < at and low[a] & 0xC0 == 0x80:
            a += 1
        while b < len(low) and b > at and low[b] & 0xC0 == 0x80:
            b -= 1
        if spans and spans[-1][0] == row and a <= spans[-1][2]:
            spans[-1][2] = max(b, spans[-1][2])
        else:
            spans.append([row, a, b])
    yield from spans


def _scan(batches, templates=None):
    scanner = Scanner(templates)
    names = [x.split()[0] for x in OUT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        ids, rows, seen = batch.column("doc_id").cast(pa.int64()), [], {}
        for chunk in texts.chunks(batch.column("text")):
            points = None
            for row, a, b in _blocks(chunk):
                points = chunk.code_points() if points is None else points
                block = chunk.text(a, b)
                if block not in seen:
                    if len(seen) > 5000:
                        seen.clear()
                    seen[block] = scanner.scan(block)
                base = int(points[a] - points[chunk.offsets[row]])
                for name, saved, (verdict, start, end, missing, added, notes) in seen[block]:
                    rows.append((ids[chunk.first + row].as_py(), base + start, base + end, name, verdict, round(saved, 6), missing, added, notes))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)


def scan(docs: DataFrame, templates=None) -> DataFrame:
    """One row per confirmed license notice."""
    return docs.select("doc_id", "text").mapInArrow(lambda b: _scan(b, templates), OUT)


@query("op2_license_compression")
def op2_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
