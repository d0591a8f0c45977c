"""License scans: normalised sentences become known sentences' identifiers, and runs of these match ordered rules."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, load, per_batch, small_batches

#: Licence names as notices write them, with their SPDX identifiers.
NAMES = {
    "MIT": ["mit license", "mit licence", "mit", "expat license", "terms of the mit license"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0", "apache 2 0 license", "apache license v2 0", "terms of the apache license version 2 0"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2", "gpl version 2", "gplv2", "gpl 2 0"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3", "gpl version 3", "gplv3", "gpl 3 0", "gnu gpl v3"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "lgpl version 2 1", "lgplv2 1"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "lgpl version 3", "lgplv3"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "agpl version 3", "agplv3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mpl 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license", "2 clause bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license", "3 clause bsd license", "modified bsd license"],
    "ISC": ["isc license"],
    "Unlicense": ["unlicense"],
    "BSL-1.0": ["boost software license version 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v2 0"],
    "Zlib": ["zlib license"],
    "WTFPL": ["wtfpl"],
    "CC0-1.0": ["cc0 1 0", "cc0", "cc0 1 0 universal"],
    **{
        f"CC-{kind}-{version}": [f"cc {words} {spelt}", f"creative commons {words} {spelt}", f"creative commons {long} {spelt} international license", f"creative commons {long} {spelt} license"]
        for kind, words, long in [
            ("BY", "by", "attribution"), ("BY-SA", "by sa", "attribution sharealike"), ("BY-ND", "by nd", "attribution noderivatives"),
            ("BY-NC", "by nc", "attribution noncommercial"), ("BY-NC-SA", "by nc sa", "attribution noncommercial sharealike"),
            ("BY-NC-ND", "by nc nd", "attribution noncommercial noderivatives")]
        for version, spelt in [("3.0", "3 0"), ("4.0", "4 0")]
    },
}
#: What stands before a name in a notice of one sentence.
LEADS = [
    f"{subject}{verb} under {article}"
    for subject in ("", "this work is ", "this file is ", "this code is ", "this software is ", "this project is ", "this program is ", "this text is ", "this document is ", "code is ", "content is ", "text is ", "it is ")
    for verb in ("licensed", "licenced", "released", "distributed", "available", "made available", "published", "provided")
    for article in ("", "the ", "a ", "an ")
]
#: Sentences of licence texts and headers, in the order of each licence, normalised.
TEXTS = {
    "MIT": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "ISC": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "BSD-3-Clause": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "BSD-2-Clause": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "Apache-2.0": [
        "licensed under the apache license version 2 0 the license",
        "you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at",
    ],
    "GPL-3.0-or-later": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "GPL-2.0-or-later": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ],
    "MPL-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ],
    "Unlicense": [
        "this is free and unencumbered software released into the public domain",
    ],
}

#: A part ends at a line feed or after a mark that white space follows; a sentence is one part or several.
MARKS = ".!?;:"
END = re.compile(r"(?<=[.!?;:])[^\S\n]+|\n+")
NOT_WORD = re.compile(r"[^a-z0-9]+")
#: Every known sentence has one of these; texts without them are not split.
HINTS = ("licen", "released", "distributed", "available", "published", "provided", "permission", "redistribut", "copyright", "public domain", "obtain")
#: Unknown sentences that may lie between two sentences of a rule.
GAP = 1


def normalised(sentence: str) -> str:
    return NOT_WORD.sub(" ", sentence.lower()).strip()


class Rules:
    """Identifiers of known sentences, and rules in the order in which they are tried: longer ones first."""

    def __init__(self):
        self.number: dict[str, int] = {}
        rules: list[tuple[str, tuple[int, ...]]] = []
        for name, sentences in TEXTS.items():
            rules.append((name, tuple(self.number.setdefault(s, len(self.number)) for s in sentences)))
        for name, spelt in NAMES.items():
            for words in spelt:
                sentences = [f"{lead}{words}" for lead in LEADS] + [f"spdx license identifier {normalised(name)}", f"license {words}"]
                for sentence in dict.fromkeys(sentences):
                    if sentence not in self.number:
                        self.number[sentence] = len(self.number)
                        rules.append((name, (self.number[sentence],)))
        self.sorted = sorted(self.number)
        rules.sort(key=lambda rule: -len(rule[1]))
        self.starting: dict[int, list[tuple[str, tuple[int, ...]]]] = {}
        for name, ids in rules:
            self.starting.setdefault(ids[0], []).append((name, ids))

    def begins(self, words: str) -> bool:
        """Whether a known sentence goes on after these words."""
        at = bisect_left(self.sorted, f"{words} ")
        return at < len(self.sorted) and self.sorted[at].startswith(f"{words} ")

    def sentences(self, text: str) -> Iterator[tuple[int, int, int]]:
        """``(identifier or -1, start, end)`` of each sentence that has words.

        A known sentence may hold marks and be wrapped: it is the longest run of parts with its words. The parts between
        known ones are a sentence each, but lines that only a line feed parts are one.
        """
        parts, start, apart = [], 0, True
        for mark in (*END.finditer(text), None):
            end = mark.start() if mark else len(text)
            if words := normalised(text[start:end]):
                parts.append((words, start, end, apart))
                apart = bool(mark) and (text[start:end].rstrip()[-1:] in MARKS or mark.group().count("\n") > 1)
            else:
                apart = True
            start = mark.end() if mark else end
        at, unknown = 0, None
        while at < len(parts):
            words, start, end, apart = parts[at]
            number, last, following = self.number.get(words, -1), at, at + 1
            while following < len(parts) and self.begins(words):
                words = f"{words} {parts[following][0]}"
                if words in self.number:
                    number, last = self.number[words], following
                following += 1
            if number < 0 and unknown and not apart:
                unknown = (-1, unknown[1], end)
            else:
                if unknown:
                    yield unknown
                unknown = (-1, start, end) if number < 0 else None
            if number >= 0:
                yield number, start, parts[last][2]
            at = last + 1
        if unknown:
            yield unknown

    def match(self, text: str) -> list[tuple[str, int, int]]:
        """``(licence, start, end)`` of the rules met, from left to right, none within another."""
        lower = text.lower()
        if not any(hint in lower for hint in HINTS):
            return []
        found = list(self.sentences(text))
        out, at = [], 0
        while at < len(found):
            for name, ids in self.starting.get(found[at][0], ()):
                end, gap = at, 0
                place = 1
                while place < len(ids) and end + 1 < len(found) and gap <= GAP:
                    end += 1
                    if found[end][0] == ids[place]:
                        place, gap = place + 1, 0
                    else:
                        gap += 1
                if place == len(ids):
                    out.append((name, found[at][1], found[end][2]))
                    at = end
                    break
            at += 1
        return out


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, and matches, an array of (license, start, end) in characters of the text.

    Null and empty texts have no matches; whole texts are read. Ids may be null or repeat, other columns are not looked
    at. Nothing is shuffled; the rules are of one size and built in each worker.
    """
    small_batches(docs.sparkSession)

    def scanning():
        rules = Rules()
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        def one(batch: pa.RecordBatch):
            found = [[{"license": n, "start": s, "end": e} for n, s, e in rules.match(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], ["id", "matches"])

        return one

    rows = id_and_text(docs, id_col, text_col)
    schema = f"id {dict(rows.dtypes)['id']}, matches array<struct<license:string,start:int,end:int>>"
    return rows.mapInArrow(per_batch(scanning), schema).withColumnRenamed("id", id_col)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(load(spark, sf_dir, "documents")).select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"))


#: The notices that the synthetic documents hold are lines of their own.
SQL = """
WITH lines AS (
    SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents
), found AS (
    SELECT doc_id, CASE line
        WHEN 'Licensed under the Apache License, Version 2.0.' THEN 'Apache-2.0'
        WHEN 'Released under the MIT License.' THEN 'MIT'
        WHEN 'This work is licensed under the GNU General Public License, version 3.' THEN 'GPL-3.0-only'
        WHEN 'Licensed under CC BY-NC 4.0.' THEN 'CC-BY-NC-4.0' END AS license
    FROM lines
)
SELECT doc_id, count(license) AS n_matches, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses
FROM found GROUP BY doc_id
"""
