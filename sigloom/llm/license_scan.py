"""License scans by conditional compression: which template makes a block cheapest to write down."""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from .words import small_batches

#: Disclaimers, which follow the conditions.
MIT_DISCLAIMER = (
    'The Software is provided "as is", without warranty of any kind, express or implied, including but not '
    "limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no "
    "event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in"
    " an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the "
    "use or other dealings in the Software."
)
ISC_DISCLAIMER = (
    'The software is provided "as is" and the author disclaims all warranties with regard to this software '
    "including all implied warranties of merchantability and fitness. In no event shall the author be liable for "
    "any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of "
    "use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of "
    "or in connection with the use or performance of this software."
)
BSD_DISCLAIMER = (
    'This software is provided by the copyright holders and contributors "as is" and any express or implied '
    "warranties, including, but not limited to, the implied warranties of merchantability and fitness for a "
    "particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any "
    "direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, "
    "procurement of substitute goods or services; loss of use, data, or profits; or business interruption) "
    "however caused and on any theory of liability, whether in contract, strict liability, or tort (including "
    "negligence or otherwise) arising in any way out of the use of this software, even if advised of the "
    "possibility of such damage."
)
#: The wording of licenses and of the notices that name them.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT notice": "Released under the MIT License.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero"
        " General Public License as published by the Free Software Foundation, either version 3 of the License, or"
        " (at your option) any later version."
    ),
    "LGPL-3.0-or-later": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation, either version 3 of the License, or"
        " (at your option) any later version."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
        "or (at your option) any later version."
    ),
    "LGPL-2.0-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Library General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version."
    ),
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1 notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
        "to this work."
    ),
    "CC0-1.0 notice": "Licensed under CC0 1.0.",
    "CC-BY-NC-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."
    ),
    "CC-BY-ND-4.0": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."
    ),
    "CC-BY-ND-4.0 notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International "
        "License."
    ),
    "CC-BY-NC-SA-4.0 notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International "
        "License."
    ),
    "CC-BY-NC-ND-4.0 notice": "Licensed under CC BY-NC-ND 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
ADVERTISING = (
    "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: "
    "This product includes software developed by the copyright holder. "
)
TEMPLATES["BSD-4-Clause"] = TEMPLATES["BSD-3-Clause"].replace("3. Neither", f"{ADVERTISING}4. Neither")
#: Whole texts: the conditions above with their disclaimers.
DISCLAIMERS = {"MIT": MIT_DISCLAIMER, "ISC": ISC_DISCLAIMER} | {f"BSD-{n}-Clause": BSD_DISCLAIMER for n in (2, 3, 4)}
TEMPLATES |= {f"{name} whole": f"{TEMPLATES[name]} {end}" for name, end in DISCLAIMERS.items()}
#: Words that tell licenses apart: none may be missing or extra.
DECIDING = frozenset(
    "affero lesser nc nd sa noncommercial noderivatives noderivs sharealike commercial derivatives alike cc0 zero only later "
    "advertising neither endorse not mit isc bsd apache mozilla gnu creative".split()
)
#: What goes on after a shorter license in a longer one: where most of it follows, the text is not the shorter one.
NEITHER = TEMPLATES["BSD-3-Clause"][TEMPLATES["BSD-3-Clause"].index("Neither") :]
FURTHER = {"BSD-2-Clause": (ADVERTISING, NEITHER), "BSD-3-Clause": (ADVERTISING,)}
#: The share of a clause's words that make it that clause.
CLAUSE_SHARE = 0.5
CUES = ("licen", "copyright", "permission", "redistribut", "warrant", "free software", "public domain", "conditions", "as is")
CUE = re.compile("|".join(CUES), re.IGNORECASE)
#: The largest share of a template's words that a block may lack, change or add between them.
MOST_DIFFERENT = 0.2
#: Characters that are compressed at once: with more, a dictionary's own parameters weigh more than what it saves.
PIECE = 4096
#: Common words in fewer than so many, so far off from the rest, are chance.
STRAY = 3
LEVEL = 3
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return [m.group().lower() for m in WORDS.finditer(text)]


def wording(template: list[str], block: list[str]) -> tuple[list[str], list[str], tuple[int, int]]:
    """The template's words that the block lacks, the block's own words among the common ones, and where those lie.

    A few common words far off on either side are chance and count as lacking.
    """
    steps = difflib.SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    same = [i for i, x in enumerate(steps) if x[0] == "equal"]

    def stray(i: int, j: int) -> bool:
        gap = max(steps[i][3], steps[j][3]) - min(steps[i][4], steps[j][4])
        return steps[i][2] - steps[i][1] < STRAY and gap >= STRAY

    while len(same) > 1 and stray(same[0], same[1]):
        same.pop(0)
    while len(same) > 1 and stray(same[-1], same[-2]):
        same.pop()
    if not same:
        return template, [], (0, 0)
    first, last = steps[same[0]], steps[same[-1]]
    inner = steps[same[0] : same[-1] + 1]
    missing = [*template[: first[1]], *template[last[2] :]]
    missing += [w for kind, a, b, _, _ in inner if kind in ("delete", "replace") for w in template[a:b]]
    extra = [w for kind, _, _, a, b in inner if kind in ("insert", "replace") for w in block[a:b]]
    return missing, extra, (first[3], last[4])


def lacking(need: Counter, there: Counter) -> int:
    """How many of the needed words are not there at all: no wording can lack fewer."""
    return sum(n - there[w] for w, n in need.items() if n > there[w])


class Scanner:
    """The templates with a compressor each."""

    def __init__(self, templates: dict[str, str]):
        make = lambda **k: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **k)
        raw = lambda t: zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.plain = make()
        self.given = {name: make(dict_data=raw(t)) for name, t in templates.items()}
        self.words = {name: words_of(t) for name, t in templates.items()}
        self.counts = {name: Counter(w) for name, w in self.words.items()}

    def saved(self, block: str, names) -> dict[str, float]:
        """The share that each template saves of the block; of overlapping pieces of a long block, the most."""
        best = dict.fromkeys(names, -1.0)
        for at in range(0, max(len(block) - PIECE // 2, 1), PIECE // 2):
            data = block[at : at + PIECE].encode()
            alone = len(self.plain.compress(data))
            for name in best:
                best[name] = max(best[name], (alone - len(self.given[name].compress(data))) / alone)
        return best

    def rank(self, block: str) -> list[tuple[float, str]]:
        """(share saved, template), best first; equal shares by name."""
        return sorted(((share, name) for name, share in self.saved(block, self.given).items()), key=lambda x: (-x[0], x[1]))

    def wordings(self, own: list[str]) -> list[tuple]:
        """(words in common less those in excess, template, missing, extra, (first, last)) of every wording among the words.

        A wording has at most 1.2 times its template's words, so windows of
        1.4 times as many at steps of 0.2 times as many hold each one whole.
        Only windows without enough of the template's words are passed over. A
        window that cuts a wording short may name it too, with fewer words.
        """
        out = []
        there = Counter(own)
        for name, want in self.words.items():
            allowed = int(MOST_DIFFERENT * len(want))
            need = self.counts[name]
            if lacking(need, there) > allowed:
                continue
            step = max(allowed, 1)
            size = len(want) + allowed + step
            for at in range(0, max(len(own) - len(want) - allowed, 1), step):
                part = own[at : at + size]
                if lacking(need, Counter(part)) > allowed:
                    continue
                missing, extra, (first, last) = wording(want, part)
                if len(missing) + len(extra) <= allowed and self.same_license(missing, extra):
                    if any(self.follows(clause, own[at + last :]) for clause in FURTHER.get(name, ())):
                        continue
                    out.append((len(want) - len(missing) - len(extra), name, missing, extra, (at + first, at + last)))
        return out

    def follows(self, clause: str, after: list[str]) -> bool:
        """Whether a clause comes next, at its own place: right after, with room for as many other words."""
        want = words_of(clause)
        steps = difflib.SequenceMatcher(None, want, after[: 2 * len(want)], autojunk=False).get_matching_blocks()
        return sum(x.size for x in steps if x.size >= STRAY) >= CLAUSE_SHARE * len(want)

    def same_license(self, missing: list[str], extra: list[str]) -> bool:
        """No number and no deciding word may differ: versions and clauses tell licenses apart."""
        return not any(w.isdigit() or w in DECIDING for w in missing + extra)

    def winners(self, text: str, hits: list[tuple]) -> list[tuple]:
        """(start, end, license, saved, missing, extra) of the wordings that stay among (common, name, missing, extra, start, end).

        Wordings that overlap are one block. All templates are ranked by what
        they save of it as raw dictionaries, and the best-ranked one whose
        wording is confirmed wins, at its longest place; wordings that overlap
        it go. What is left of the block is ranked again.
        """
        out = []
        todo = sorted(hits, key=lambda x: (x[4], x[5]))
        while todo:
            block, end = [todo[0]], todo[0][5]
            for x in todo[1:]:
                if x[4] < end:
                    block.append(x)
                    end = max(end, x[5])
            todo = todo[len(block) :]
            ranked = self.rank(text[block[0][4] : end])
            order = {name: (i, max(share, 0.0)) for i, (share, name) in enumerate(ranked)}
            best = min(block, key=lambda x: (order[x[1]][0], -x[0], x[4]))
            _, name, missing, extra, start, stop = best
            out.append((start, stop, name, order[name][1], missing, extra))
            todo = sorted([x for x in block if x[5] <= start or x[4] >= stop] + todo, key=lambda x: (x[4], x[5]))
        return out

    def scan(self, text: str) -> list[tuple]:
        """(start, end, license, saved, missing, extra) of each candidate block; license is null if no wording fits.

        Every cue is looked at with as many words on both sides as the longest
        wording has. Where wordings overlap, what their templates save as
        dictionaries decides (``winners``). What is left of a line between wordings, and has a cue of its own, is a block without
        a license; of a long line, the words about its cues.
        """
        places = [(m.start(), m.end()) for m in WORDS.finditer(text)]
        starts = [x[0] for x in places]
        reach = int(max(map(len, self.words.values()), default=1) * (1 + MOST_DIFFERENT)) + 1
        cues = [(m.start(), m.end()) for m in CUE.finditer(text)]
        regions: list[list[int]] = []
        for start, _ in cues:
            at = max(bisect.bisect_right(starts, start) - 1, 0)
            low, high = max(at - reach, 0), min(at + reach, len(places))
            if regions and low <= regions[-1][1]:
                regions[-1][1] = high
            else:
                regions.append([low, high])
        hits = []
        for low, high in regions:
            own = [text[a:b].lower() for a, b in places[low:high]]
            hits += [(*x[:4], places[low + x[4][0]][0], places[low + x[4][1] - 1][1]) for x in self.wordings(own)]
        out = self.winners(text, hits)
        taken = sorted((x[0], x[1]) for x in out)
        ends = [x[1] for x in taken]
        left: list[list[int]] = []
        for start, end in cues:
            i = bisect.bisect_right(ends, start)
            if i < len(taken) and taken[i][0] < end:
                continue
            at = max(bisect.bisect_right(starts, start) - 1, 0)
            low = max(text.rfind("\n", 0, start) + 1, ends[i - 1] if i else 0, starts[max(at - reach, 0)] if places else 0)
            high = text.find("\n", end)
            high = min(
                len(text) if high < 0 else high,
                taken[i][0] if i < len(taken) else len(text),
                places[at + reach][1] if at + reach < len(places) else len(text),
            )
            low, high = min(low, start), max(high, end)
            if left and low < left[-1][1]:
                left[-1][1] = max(high, left[-1][1])
            else:
                left.append([low, high])
        for low, high in left:
            ranked = self.rank(text[low:high])
            out.append((low, high, None, max(ranked[0][0], 0.0) if ranked else 0.0, [], []))
        return sorted(out, key=lambda x: x[:2])


def license_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per candidate block: doc_id, start and end (code points), license, saved, missing, extra.

    Every text with a cue is looked at, about each of its cues. ``saved`` is
    the share of the block's compressed size that the winning template (of a
    block without a license, the best one) saves as a raw dictionary. Null and
    empty texts have no blocks. Templates that save the same go by name. Repeated rows repeat their blocks. Other columns are
    not read.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for batch in small_batches(batches, "text"):
            rows = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if text and CUE.search(text):
                    rows += [(i, *x) for x in scanner.scan(text)]
            columns = list(zip(*rows)) or [()] * 7
            words = pa.list_(pa.string())
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.float64(), words, words]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"]])
    for name, kind in (("start", T.LongType()), ("end", T.LongType()), ("license", T.StringType()), ("saved", T.DoubleType())):
        schema = schema.add(name, kind)
    schema = schema.add("missing", T.ArrayType(T.StringType())).add("extra", T.ArrayType(T.StringType()))
    return rows.mapInArrow(run, schema)
