"""Operator 4: licence scans by sentence rules.

A text is cut into sentences, a sentence is normalised (case, punctuation, comment
marks, spacing) and looked up among known licence sentences; what remains of a
document is the sequence of identifiers with their places. Rules are tried in order:
a rule is a sequence of identifiers that must follow each other with few other
sentences between, and an identifier counts for the first rule that takes it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm import textcore as tc
from tallyglass.llm.common import doc_columns

# fixed values: sentences of public licences and of notices that name one
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "as-is-mit": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",),
    "mit-name": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License.", "License: MIT", "SPDX-License-Identifier: MIT"),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "isc-name": ("SPDX-License-Identifier: ISC", "Licensed under the ISC License."),
    "bsd-redistribution": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd-endorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "bsd2-name": ("SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    "bsd3-name": ("SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    "apache-name": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "SPDX-License-Identifier: Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    "apache-comply": ("you may not use this file except in compliance with the License.",),
    "apache-as-is": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",),
    "gpl3-name": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "gpl3-grant": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "gpl2-name": ("SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under the GNU General Public License, version 2."),
    "gpl2-grant": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "gpl-warranty": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "lgpl21-grant": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "lgpl3-grant": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "lgpl21-name": ("SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later", "Licensed under the GNU Lesser General Public License, version 2.1."),
    "lgpl3-name": ("SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later", "Licensed under the GNU Lesser General Public License, version 3."),
    "agpl3-grant": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "agpl3-name": ("SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later", "Licensed under the GNU Affero General Public License, version 3."),
    "mpl-name": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "cc-by-name": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc-name": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa-name": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "cc0-name": ("SPDX-License-Identifier: CC0-1.0", "Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "reserved": ("All rights reserved.", "All rights are reserved."),
}

#: Rules in order: (licence, sequence of identifiers). Full texts come before notices that only name a licence.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-grant", "mit-notice", "as-is-mit")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-name", "apache-comply", "apache-as-is")),
    ("AGPL-3.0", ("agpl3-grant",)),
    ("LGPL-3.0", ("lgpl3-grant",)),
    ("LGPL-2.1", ("lgpl21-grant",)),
    ("GPL-3.0", ("gpl3-grant", "gpl-warranty")),
    ("GPL-2.0", ("gpl2-grant", "gpl-warranty")),
    ("GPL-3.0", ("gpl3-grant",)),
    ("GPL-2.0", ("gpl2-grant",)),
    ("GPL-3.0", ("gpl3-name",)),
    ("GPL-2.0", ("gpl2-name",)),
    ("AGPL-3.0", ("agpl3-name",)),
    ("LGPL-3.0", ("lgpl3-name",)),
    ("LGPL-2.1", ("lgpl21-name",)),
    ("MIT", ("mit-name",)),
    ("ISC", ("isc-name",)),
    ("BSD-2-Clause", ("bsd2-name",)),
    ("BSD-3-Clause", ("bsd3-name",)),
    ("Apache-2.0", ("apache-name",)),
    ("MPL-2.0", ("mpl-name",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-name",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-name",)),
    ("CC-BY-4.0", ("cc-by-name",)),
    ("CC0-1.0", ("cc0-name",)),
    ("Unlicense", ("public-domain",)),
    ("All-Rights-Reserved", ("reserved",)),
)
#: Rules that hold only where no other does: reserved rights beside a licence belong to its copyright line.
ONLY_ALONE = frozenset({"All-Rights-Reserved"})
#: Other sentences that may stand between two of a rule.
MAX_GAP = 3

_WORD = re.compile(r"[0-9a-z]+(?:[.+-][0-9a-z]+)*|[^\x00-\x7f]+")
_CUT = re.compile(r"(?<=[.!?;:])[ \t]+|[\r\n]+")
_TRIGGER = re.compile(r"licen[sc]e|permission|redistribut|notice|waive|public[^0-9a-z]+domain|warrant|free[^0-9a-z]+software|rights[^0-9a-z]+(?:are[^0-9a-z]+)?reserved|software[^0-9a-z]+is[^0-9a-z]+provided|endorse", re.I)


def normalise(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


_KNOWN: dict[str, str] = {}
for _id, _forms in SENTENCES.items():
    for _form in _forms:
        _KNOWN[normalise(_form)] = _id
#: First words of known sentences, and the words that a sentence may have: both are exact filters.
_FIRST = {k.split(" ", 1)[0] for k in _KNOWN} | {"copyright"}
_LONGEST = max(map(len, _KNOWN))

#: The endorsement clause with the name of any holder.
_ENDORSE = re.compile(r"neither the name of (?:\S+ ){1,20}nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission")
#: Reserved rights of any named holder, in one sentence with the copyright.
_RESERVED = re.compile(r"copyright (?:\S+ ){1,40}all rights reserved[.]?")


def _known(sentence: str) -> str | None:
    """The identifier of a normalised sentence."""
    if sentence.startswith("copyright ") and _RESERVED.fullmatch(sentence):
        return "reserved"
    if sentence.startswith("neither the name of ") and _ENDORSE.fullmatch(sentence):
        return "bsd-endorse"
    return _KNOWN.get(sentence)


def recognise(text: str | None) -> list[tuple[int, str]]:
    """(place among the text's pieces, identifier) of the known sentences, in order.

    Pieces are cut at ends of sentences and lines; a sentence may be one piece or go on over the next ones.
    """
    if not text or _TRIGGER.search(text) is None:
        return []
    pieces = [n for n in map(normalise, _CUT.split(text)) if n]
    found, i = [], 0
    while i < len(pieces):
        if pieces[i].split(" ", 1)[0] in _FIRST:
            joined, best = "", None
            for j in range(i, len(pieces)):
                joined = f"{joined} {pieces[j]}" if joined else pieces[j]
                if len(joined) > _LONGEST:
                    break
                if (known := _known(joined)) is not None:
                    best, name = j, known
            if best is not None:
                found.append((i, best, name))
                i = best + 1
                continue
        i += 1
    # places count sentences: pieces inside a known sentence are one
    out, shift = [], 0
    for a, b, name in found:
        out.append((a - shift, name))
        shift += b - a
    return out


def match(sequence: list[tuple[int, str]]) -> list[str]:
    """The licences of the rules that match, in order of the rules; an identifier counts once.

    From each place a rule looks ahead no farther than ``MAX_GAP`` allows, so the time grows with the sequence.
    """
    free = [True] * len(sequence)
    names = {name for _, name in sequence}
    out = []
    for licence, rule in RULES:
        if not names.issuperset(rule) or (licence in ONLY_ALONE and out):
            continue
        for start, (_, name) in enumerate(sequence):
            if name != rule[0] or not free[start]:
                continue
            used = [start]
            for wanted in rule[1:]:
                reach = sequence[used[-1]][0] + MAX_GAP + 1
                at = used[-1] + 1
                while at < len(sequence) and sequence[at][0] <= reach and not (free[at] and sequence[at][1] == wanted):
                    at += 1
                if at == len(sequence) or sequence[at][0] > reach:
                    break
                used.append(at)
            if len(used) == len(rule) and not (licence in ONLY_ALONE and out):
                for u in used:
                    free[u] = False
                out.append(licence)
    return out


_RESULT = T.StructType([T.StructField("sentences", T.ArrayType(T.StringType())), T.StructField("licences", T.ArrayType(T.StringType()))])


@F.arrow_udf(_RESULT)
def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in tc.trimmed(batches):
        sentences, licences = [], []
        for text in tc.each_text(column):
            found = recognise(text.decode()) if text else []
            sentences.append([name for _, name in found])
            licences.append(match(found))
        kind = pa.list_(pa.string())
        yield pa.StructArray.from_arrays([pa.array(sentences, kind), pa.array(licences, kind)], names=["sentences", "licences"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifiers in order) and licences (by rule, then place) for each row of ``docs``.

    * A null or empty text has none; a text without any of the words that licence sentences have isn't cut at all.
    * A known sentence may be wrapped over any number of lines; of sentences that begin at one place the longest is taken.
    * Rules that could take one identifier: the first in order has it, and of its places the earliest.
    * A text of any length is scanned whole, in time that grows with its length.
    * Repeated rows get equal results; an empty table gives no rows; other columns are ignored.
    """
    return doc_columns(docs).withColumn("__s", _scan("text")).select("doc_id", "__s.*")


def op4(spark: SparkSession, d: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{d}/documents.parquet"))
    return out.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentence_ids"), F.array_join(F.array_sort(F.array_distinct("licences")), ",").alias("licences"))


QUERIES = {"op4_license_scan": op4}
