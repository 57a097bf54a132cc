"""Licence scan with a positional index of rare words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transcript_jobs.llm.batches import text_blocks

# Phrases that are found wherever their words stand one after the other, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices that may be worded a little differently, their label, and phrases that must stand in them.
NOTICES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("lgpl", "this library is licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "this program is licensed under the gnu affero general public license", ["affero general public license"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software foundation"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "conditions are met"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
]
# Longer parts of licences, their label, and phrases that must stand in them.
BODIES = [
    (
        "gpl-notice",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program.",
        ["free software foundation", "in the hope that it will be useful"],
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        ["except in compliance with the license", "governing permissions and limitations"],
    ),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ["to deal in the software without restriction", "copies or substantial portions"],
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        ["with or without fee", "the author disclaims all warranties"],
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ["redistribution and use", "must retain the above copyright notice", "in binary form must reproduce"],
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
        ["in no event will the authors be held liable", "alter it and redistribute it freely"],
    ),
    (
        "gpl-3.0",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. "
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. "
        "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
        ["free copyleft license for software and other kinds of works", "gnu general public license"],
    ),
    (
        "gpl-3.0",
        "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice; "
        "keep intact all notices stating that this License and any non-permissive terms added in accord with section 7 apply to the code; "
        "keep intact all notices of the absence of any warranty; and give all recipients a copy of this License along with the Program.",
        ["convey verbatim copies", "non permissive terms added in accord with section 7"],
    ),
    (
        "gpl-2.0",
        "The licenses for most software are designed to take away your freedom to share and change it. "
        "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
        ["your freedom to share and change it", "gnu general public license"],
    ),
    (
        "gpl-2.0",
        "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy "
        "an appropriate copyright notice and disclaimer of warranty; keep intact all the notices that refer to this License and to the absence of any warranty; "
        "and give any other recipients of the Program a copy of this License along with the Program.",
        ["copy and distribute verbatim copies of the program", "notices that refer to this license"],
    ),
    (
        "lgpl",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
        ["gnu lesser general public license", "supplemented by the additional permissions"],
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version.",
        ["gnu lesser general public license", "free software foundation"],
    ),
    (
        "agpl",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, "
        "specifically designed to ensure cooperation with the community in the case of network server software.",
        ["gnu affero general public license", "cooperation with the community"],
    ),
    (
        "agpl",
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network "
        "(if your version supports such interaction) an opportunity to receive the Corresponding Source of your version",
        ["interacting with it remotely through a computer network", "corresponding source of your version"],
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ["mozilla public license", "copy of the mpl was not distributed with this file"],
    ),
    (
        "mpl-2.0",
        "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License. "
        "You must inform recipients that the Source Code Form of the Covered Software is governed by the terms of this License, and how they can obtain a copy of this License.",
        ["covered software in source code form", "governed by the terms of this license"],
    ),
    (
        "apache-2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license "
        "to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        ["each contributor hereby grants to you", "derivative works in source or object form"],
    ),
    (
        "cc-by-4.0",
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License (\"Public License\").",
        ["exercising the licensed rights", "creative commons attribution 4 0 international public license"],
    ),
    (
        "cc-by-sa-4.0",
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License (\"Public License\").",
        ["exercising the licensed rights", "creative commons attribution sharealike 4 0 international public license"],
    ),
    (
        "cc-by-nc-4.0",
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License (\"Public License\").",
        ["exercising the licensed rights", "creative commons attribution noncommercial 4 0 international public license"],
    ),
    (
        "cc0-1.0",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, "
        "including all related and neighboring rights, to the extent allowed by law.",
        ["dedicated the work to the public domain", "related and neighboring rights"],
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ["free and unencumbered software", "released into the public domain"],
    ),
    (
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
        ["any person or organization obtaining a copy", "accompanying documentation covered by this license"],
    ),
    (
        "epl-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        ["accompanying materials are made available under the terms", "eclipse public license"],
    ),
]

#: A to Z become small, digits and all bytes outside ASCII stay, whatever separates words becomes a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


@dataclass(frozen=True)
class Template:
    """A licence's words; how many words they may be shifted (``slack``), and the part of their weight that must be found (``share``)."""

    label: str
    words: list[bytes]
    exact: bool
    slack: int
    share: float
    keys: list[list[bytes]] = field(default_factory=list)


def templates(slack: int = 4, share: float = 0.6) -> list[Template]:
    """Phrases stand word for word. The words of a notice may be shifted by ``slack`` or a tenth of its length, and a part may be missing."""
    found = [Template(label, words_of(phrase), True, 0, 1.0) for phrase, label in PHRASES.items()]
    for label, text, keys in NOTICES + BODIES:
        words = words_of(text)
        found.append(Template(label, words, False, max(slack, len(words) // 10), share, [words_of(k) for k in keys]))
    return found


class RareIndex:
    """Looks up a text's rarest licence words and meets what templates say about their places."""

    def __init__(self, idf: dict[bytes, float], templates: list[Template]):
        self.idf, self.templates = idf, templates
        self.weights = [sum(idf[w] for w in t.words) for t in templates]
        self.needed = [set(t.words) if t.exact else {w for k in t.keys for w in k} for t in templates]
        self.vocabulary = {w for t in templates for w in t.words}
        # A template is looked at only where its rarest mandatory word is.
        self.postings: dict[bytes, list[int]] = {}
        for t, needed in enumerate(self.needed):
            self.postings.setdefault(max(needed, key=lambda w: (idf[w], w)), []).append(t)

    def anchors(self, t: int, present: set[bytes]) -> tuple[list[int], float]:
        """Places in the template of the text's words of highest IDF, and the weight of those that must agree.

        As many words are taken as are needed for the others, with any one of the
        taken, to stay under the weight asked for: so two must agree at every place.
        A template whose present words weigh too little has none.
        """
        template, need = self.templates[t], self.templates[t].share * self.weights[t] * (1 - 1e-9)
        order = sorted((i for i, w in enumerate(template.words) if w in present), key=lambda i: (-self.idf[template.words[i]], template.words[i], i))
        rest = sum(self.idf[template.words[i]] for i in order)
        if rest < need:
            return [], 0.0
        highest = self.idf[template.words[order[0]]]
        for taken, i in enumerate(order, 1):
            rest -= self.idf[template.words[i]]
            if rest + highest < need:
                return order[:taken], need - rest
        return order, need

    def candidates(self, t: int, anchors: list[int], need: float, at: dict[bytes, list[int]]) -> Iterator[int]:
        """Starts about which anchors of the weight needed agree, in order."""
        template, steps = self.templates[t], Counter()
        for i in anchors:
            weight, until = self.idf[template.words[i]], None
            for place in at[template.words[i]]:
                low, high = place - i - template.slack, place - i + template.slack + 1
                if until is None or low > until:
                    if until is not None:
                        steps[until] -= weight
                    steps[low] += weight
                until = high
            steps[until] -= weight
        agreed, before, least = 0.0, 0, need - 1e-9 * self.weights[t]
        for here in sorted(steps):
            if agreed >= least:
                yield from range(before, here)
            agreed, before = agreed + steps[here], here

    def notice(self, t: int, words: list[bytes], s: int) -> tuple[float, int] | None:
        """Share of the weight found near its places, and how many words stand just there, if the text at ``s`` is the notice."""
        template, slack = self.templates[t], self.templates[t].slack
        window = words[max(0, s - slack) : max(0, s + len(template.words) + slack)]
        if not all(_stands(key, window) for key in template.keys):
            return None
        near, just = 0.0, 0
        for i, w in enumerate(template.words):
            if w in words[max(0, s + i - slack) : max(0, s + i + slack + 1)]:
                near += self.idf[w]
                just += 0 <= s + i < len(words) and words[s + i] == w
        share = near / self.weights[t]
        return (min(share, 1.0), just) if share >= template.share - 1e-9 else None

    def places(self, words: list[bytes]) -> list[tuple[str, int, bool, float]]:
        """(label, first word, whether a phrase, share of the weight found) of all verified places."""
        present = self.vocabulary.intersection(words)
        asked = sorted(t for w in present for t in self.postings.get(w, ()))
        chosen = {t: a for t in asked if self.needed[t] <= present and (a := self.anchors(t, present))[0]}
        if not chosen:
            return []
        at: dict[bytes, list[int]] = {self.templates[t].words[i]: [] for t, (anchors, _) in chosen.items() for i in anchors}
        for place, word in enumerate(words):
            if word in at:
                at[word].append(place)
        found = []
        for t, (anchors, need) in chosen.items():
            template = self.templates[t]
            n = len(template.words)
            starts = self.candidates(t, anchors, need, at)
            if template.exact:
                found += [(template.label, s, True, 1.0) for s in starts if s >= 0 and words[s : s + n] == template.words]
                continue
            ranked = sorted((-v[1], -v[0], s) for s in starts if (v := self.notice(t, words, s)))
            kept: set[int] = set()
            for _, share, s in ranked:
                if not any(s + d in kept for d in range(1 - n, n)):
                    kept.add(s)
                    found.append((template.label, max(0, s), False, -share))
        return sorted(found, key=lambda p: (p[1], not p[2], p[0], -p[3]))


def _stands(key: list[bytes], window: list[bytes]) -> bool:
    n = len(key)
    return any(window[i : i + n] == key for i, w in enumerate(window) if w == key[0])


def rarity(docs: DataFrame, text_col: str = "text") -> dict[bytes, float]:
    """Inverse document frequency of the templates' words over all documents (a count for each word of the templates, whatever the corpus)."""
    vocabulary = {w for t in templates() for w in t.words}
    rows = docs.select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        n = 0
        for block in text_blocks(batches):
            for text in block.column(0).to_pylist():
                seen.update(vocabulary.intersection(words_of(text)))
                n += 1
        seen[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen]), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counts = {r[0].encode(): r[1] for r in rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n")).collect()}
    total = counts.get(b"", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1e-6 for w in vocabulary}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find licence phrases and notices in whole texts.

    Words weigh what they tell: their inverse document frequency over all documents.
    A template's posting stands under its rarest mandatory word, so that a text meets
    only templates whose word it has, however many there are. Of each text the licence words of highest weight are looked up, the places where
    templates would have to begin are met by relative position, and where words of
    enough weight agree, at least two, the place is verified: phrases word for word,
    notices by their mandatory key phrases and most of their weight near its places.
    No place is lost by the lookup: words left out weigh too little to make one.
    Returns ``id_col``, ``n_words`` and ``places`` (array of ``label, first_word,
    phrase, share``, in order of ``first_word``), a row for each row.

    All places of a phrase count. Places of one notice that overlap are one: that of
    the most words just in place, then of the greatest share, then the first; places
    of different templates may overlap.

    Null and empty texts have no words and no places; repeated rows and null ids pass
    through; other columns are ignored. Two scans, no shuffle of texts.
    """
    index = docs.sparkSession.sparkContext.broadcast(RareIndex(rarity(docs, text_col), templates()))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    place = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("phrase", pa.bool_()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            counts, found = [], []
            for text in block.column(1).to_pylist():
                words = words_of(text)
                counts.append(len(words))
                found.append([dict(zip(("label", "first_word", "phrase", "share"), p)) for p in index.value.places(words)])
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(place))], ["id", "n_words", "places"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, places array<struct<label:string,first_word:long,phrase:boolean,share:double>>").withColumnRenamed("id", id_col)
