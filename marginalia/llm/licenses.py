"""Operator 6: licence scans by sentence rules.

Known licence sentences, as words without case and punctuation, have identifiers.  A text's words are read once; where a
sentence may start (a line's start, after a full stop, colon or semicolon, or after a known sentence), the longest known sentence that
follows becomes its identifier, wherever its lines are wrapped.  Runs of identifiers (at most GAP other words between two, copyright
lines not counted) are matched against the ordered rules: at each place the first rule whose sequence follows wins
and takes its sentences.

Defined cases: null and empty texts have no match; a text may match many times, each match is a row; repeated rows are scanned each;
very long texts are scanned whole, batches of them are cut by bytes; other columns are dropped, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import slices

#: Sentences of public licences and the usual notices; * stands for the holders' names, at most HOLDERS words.
SENTENCES = {
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "SPDX-License-Identifier: MIT"],
    "mit-title": ["The MIT License (MIT)", "The MIT License", "MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "apache-notice": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "apache-header": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl-grant-3": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-grant-2": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorsement": ["Neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission."],
    "mpl-grant": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl-notice": ["Licensed under the Mozilla Public License, Version 2.0", "Released under the Mozilla Public License, Version 2.0", "Licensed under the Mozilla Public License 2.0", "Released under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "lgpl-grant-3": [f"This {x} is free software{c} you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation{d} either version 3 of the License, or (at your option) any later version." for x, c, d in (("library", ";", ";"), ("program", ":", ","))],
    "lgpl-grant-21": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl-warranty": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "lgpl3-notice": ["Licensed under the GNU Lesser General Public License, version 3", "Released under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "agpl-grant-3": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3-notice": ["Licensed under the GNU Affero General Public License, version 3", "Released under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain."],
    "unlicense-notice": ["Released under the Unlicense", "Licensed under the Unlicense", "SPDX-License-Identifier: Unlicense"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "cc-by-nc-4-notice": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "Released under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-4-notice": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "Released under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc0-notice": ["Released under CC0 1.0", "Licensed under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
}
#: rule, licence, identifiers in order; the first that fits wins.
RULES = (
    ("mit-text", "MIT", ("mit-title", "mit-grant", "mit-condition", "as-is")),
    ("mit-text-untitled", "MIT", ("mit-grant", "mit-condition", "as-is")),
    ("mit-permission", "MIT", ("mit-grant",)),
    ("apache-2-header", "Apache-2.0", ("apache-header", "apache-copy", "apache-as-is")),
    ("apache-2-short-header", "Apache-2.0", ("apache-header",)),
    ("gpl-3-header", "GPL-3.0-or-later", ("gpl-grant-3", "gpl-warranty")),
    ("gpl-3-grant", "GPL-3.0-or-later", ("gpl-grant-3",)),
    ("gpl-2-header", "GPL-2.0-or-later", ("gpl-grant-2", "gpl-warranty")),
    ("gpl-2-grant", "GPL-2.0-or-later", ("gpl-grant-2",)),
    ("lgpl-3-header", "LGPL-3.0-or-later", ("lgpl-grant-3", "lgpl-warranty")),
    ("lgpl-3-grant", "LGPL-3.0-or-later", ("lgpl-grant-3",)),
    ("lgpl-2-1-header", "LGPL-2.1-or-later", ("lgpl-grant-21", "lgpl-warranty")),
    ("lgpl-2-1-grant", "LGPL-2.1-or-later", ("lgpl-grant-21",)),
    ("agpl-3-header", "AGPL-3.0-or-later", ("agpl-grant-3", "gpl-warranty")),
    ("agpl-3-grant", "AGPL-3.0-or-later", ("agpl-grant-3",)),
    ("mpl-2-header", "MPL-2.0", ("mpl-grant",)),
    ("unlicense-text", "Unlicense", ("unlicense-grant",)),
    ("bsd-3", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorsement")),
    ("bsd-2", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("isc-text", "ISC", ("isc-grant",)),
    ("mit-notice", "MIT", ("mit-notice",)),
    ("apache-2-notice", "Apache-2.0", ("apache-notice",)),
    ("gpl-3-notice", "GPL-3.0-only", ("gpl3-notice",)),
    ("cc-by-nc-4-notice", "CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("cc-by-4-notice", "CC-BY-4.0", ("cc-by-4-notice",)),
    ("cc0-notice", "CC0-1.0", ("cc0-notice",)),
    ("mpl-2-notice", "MPL-2.0", ("mpl-notice",)),
    ("lgpl-3-notice", "LGPL-3.0-only", ("lgpl3-notice",)),
    ("agpl-3-notice", "AGPL-3.0-only", ("agpl3-notice",)),
    ("unlicense-notice", "Unlicense", ("unlicense-notice",)),
)
GAP, HOLDERS = 12, 40
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
COPYRIGHT = re.compile(r"\W*(?:copyright\b|\(c\)|©|all rights reserved)", re.IGNORECASE)
END = re.compile(r"[\n.;:!?]")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def form_of(sentence: str) -> tuple[str, ...]:
    return tuple(w for k, part in enumerate(sentence.split("*")) for w in ["*"] * (k > 0) + words_of(part))


KNOWN: dict[tuple[str, ...], list[tuple[tuple[str, ...], str]]] = {}
for _name, _forms in SENTENCES.items():
    for _form in map(form_of, _forms):
        KNOWN.setdefault(_form[:2], []).append((_form, _name))
for _forms in KNOWN.values():
    _forms.sort(key=lambda x: -len(x[0]))


def _starts(forms: list[tuple[str, ...]], depth: int = 4) -> str:
    """A pattern of the first words of the forms, whatever stands between two words."""
    if depth == 0 or any(not f or f[0] == "*" for f in forms):
        return ""
    by: dict[str, list[tuple[str, ...]]] = {}
    for f in forms:
        by.setdefault(f[0], []).append(f[1:])
    rest = {w: _starts(fs, depth - 1) for w, fs in sorted(by.items())}
    return "(?:" + "|".join(re.escape(w) + (r"[\W_]+" + r if r else "") for w, r in rest.items()) + ")"


#: The first words of the known sentences; texts with none of these are not read.  What the matcher takes always passes.
ANCHORS = "(?<![a-z0-9])" + _starts([f for forms in KNOWN.values() for f, _ in forms])


def _length(words: list[str], form: tuple[str, ...]) -> int:
    """Of the words from the start of a form, how many it takes; 0: it doesn't follow."""
    k = form.index("*") if "*" in form else len(form)
    if tuple(words[:k]) != form[:k]:
        return 0
    if k == len(form):
        return k
    tail = form[k + 1 :]
    return next((at + len(tail) for at in range(k + 1, k + 1 + HOLDERS) if tuple(words[at : at + len(tail)]) == tail), 0)


def sentences(text: str) -> list[tuple[str, int, int, int, int]]:
    """(identifier, start, end, first word, word after) of the known sentences of a whole text, in order."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is two letters would move places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spots = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
    out, i, free = [], 0, True
    while i < len(spots):
        begins = free or END.search(low, spots[i - 1][2], spots[i][1]) is not None
        free = False
        if begins and i + 1 < len(spots):
            for form, name in KNOWN.get((spots[i][0], spots[i + 1][0]), ()):
                if n := _length([w for w, _, _ in spots[i : i + len(form) + HOLDERS]], form):
                    out.append((name, spots[i][1], spots[i + n - 1][2], i, i + n))
                    i, free = i + n, True
                    break
            else:
                i += 1
            continue
        i += 1
    return out


def between(text: str) -> int:
    """Words of a stretch between two sentences, without lines of copyright holders."""
    return sum(len(words_of(line)) for line in text.split("\n") if not COPYRIGHT.match(line))


def scan(text: str | None) -> list[tuple[str, str, int, int, str]]:
    """(licence, rule, start, end, identifiers) of every match."""
    found, out, at = sentences(text or ""), [], 0
    while at < len(found):
        for rule, licence, ids in RULES:
            part = found[at : at + len(ids)]
            if tuple(p[0] for p in part) == ids and all(b[3] - a[4] <= GAP or between(text[a[2] : b[1]]) <= GAP for a, b in zip(part, part[1:], strict=False)):
                out.append((licence, rule, part[0][1], part[-1][2], " ".join(ids)))
                at += len(ids)
                break
        else:
            at += 1
    return out


def scans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, match, license, rule, start, end, sentences): a row for each match.  A map without any shuffle."""
    kind = dict(docs.dtypes)[id]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128, 1):
            row, hits = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for n, hit in enumerate(scan(t)):
                    row.append(k)
                    hits.append((n, *hit))
            kinds = [("match", pa.int32()), ("license", pa.string()), ("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sentences", pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array([h[i] for h in hits], t) for i, (_, t) in enumerate(kinds))], names=[id, *(n for n, _ in kinds)])

    likely = docs.where(F.lower(F.col(text)).rlike(ANCHORS)).select(id, text)
    return likely.mapInArrow(work, f"`{id}` {kind}, match int, license string, rule string, start long, end long, sentences string")
