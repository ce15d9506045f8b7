"""Licence recognition: known sentences are given identifiers, then ordered rules are matched on the identifiers."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# Known licence sentences in normalised form (lower case, words and digits only), by identifier.
SENTENCES = {
    "MIT-RELEASED": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"],
    "MIT-TITLE": ["the mit license", "mit license"],
    "MIT-GRANT": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"],
    "MIT-NOTICE": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "AS-IS": ["the software is provided as is without warranty of any kind", "this software is provided as is without warranty of any kind"],
    "APACHE-2-LICENSED": ["licensed under the apache license version 2 0", "licensed under apache 2 0"],
    "APACHE-2-TITLE": ["apache license version 2 0 january 2004"],
    "APACHE-2-BASIS": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"],
    "APACHE-2-COMPLY": ["you may not use this file except in compliance with the license"],
    "GPL-3-LICENSED": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "licensed under the gpl version 3"],
    "GPL-2-LICENSED": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "GPL-FREE": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "GPL-EITHER-3": ["either version 3 of the license or at your option any later version"],
    "GPL-EITHER-2": ["either version 2 of the license or at your option any later version"],
    "AGPL-FREE": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"],
    "LGPL-FREE": [f"this {x} is free software you can redistribute it and or modify it under the terms of the gnu {y} general public license" for x in ("library", "program") for y in ("lesser", "library")],
    "LGPL-LICENSED": ["licensed under the gnu lesser general public license"],
    "MPL-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "BSD-REDISTRIBUTE": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSD-SOURCE": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSD-BINARY": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BSD-WARRANTY": [f"this software is provided by the copyright {x} and contributors as is and any express or implied warranties" for x in ("holders", "owners")],
    "ISC-GRANT": [f"permission to use copy modify and {x} this software for any purpose with or without fee is hereby granted" for x in ("or distribute", "distribute")],
    "BSL-GRANT": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "EPL-TERMS": ["this program and the accompanying materials are made available under the terms of the eclipse public license"],
    "SPDX-MIT": ["spdx license identifier mit"],
    "SPDX-APACHE-2": ["spdx license identifier apache 2 0"],
    "SPDX-GPL-2": ["spdx license identifier gpl 2 0"],
    "SPDX-GPL-3": ["spdx license identifier gpl 3 0"],
    "BSD-ENDORSE": ["may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BSD-3-LICENSED": ["licensed under the bsd 3 clause license"],
    "CC-BY-NC-4": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-SA-4": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CC-BY-4": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CC0": ["this work is dedicated to the public domain", "licensed under cc0 1 0"],
    "UNLICENSE": ["this is free and unencumbered software released into the public domain"],
    "ALL-RIGHTS": ["all rights reserved"],
}
# Ordered licence rules. A rule matches if its identifiers appear in this order; the first rule that
# matches at a place wins, and the identifiers that it takes are used up.
RULES = [
    ("MIT", ("MIT-GRANT", "MIT-NOTICE", "AS-IS")),
    ("BSD-3-Clause", ("BSD-REDISTRIBUTE", "BSD-ENDORSE")),
    ("BSD-2-Clause", ("BSD-REDISTRIBUTE",)),
    ("GPL-3.0-or-later", ("GPL-FREE", "GPL-EITHER-3")),
    ("GPL-2.0-or-later", ("GPL-FREE", "GPL-EITHER-2")),
    ("Apache-2.0", ("APACHE-2-LICENSED", "APACHE-2-COMPLY", "APACHE-2-BASIS")),
    ("Apache-2.0", ("APACHE-2-LICENSED", "APACHE-2-COMPLY")),
    ("Apache-2.0", ("APACHE-2-LICENSED",)),
    ("Apache-2.0", ("APACHE-2-TITLE",)),
    ("MIT", ("MIT-RELEASED",)),
    ("MIT", ("MIT-GRANT",)),
    ("MIT", ("MIT-TITLE",)),
    ("GPL-3.0", ("GPL-3-LICENSED",)),
    ("GPL-2.0", ("GPL-2-LICENSED",)),
    ("GPL", ("GPL-FREE",)),
    ("AGPL-3.0-or-later", ("AGPL-FREE", "GPL-EITHER-3")),
    ("AGPL", ("AGPL-FREE",)),
    ("LGPL", ("LGPL-FREE",)),
    ("LGPL", ("LGPL-LICENSED",)),
    ("ISC", ("ISC-GRANT",)),
    ("BSL-1.0", ("BSL-GRANT",)),
    ("EPL", ("EPL-TERMS",)),
    ("MIT", ("SPDX-MIT",)),
    ("Apache-2.0", ("SPDX-APACHE-2",)),
    ("GPL-2.0", ("SPDX-GPL-2",)),
    ("GPL-3.0", ("SPDX-GPL-3",)),
    ("MPL-2.0", ("MPL-2",)),
    ("BSD-3-Clause", ("BSD-3-LICENSED",)),
    ("CC-BY-NC-4.0", ("CC-BY-NC-4",)),
    ("CC-BY-SA-4.0", ("CC-BY-SA-4",)),
    ("CC-BY-4.0", ("CC-BY-4",)),
    ("CC0-1.0", ("CC0",)),
    ("Unlicense", ("UNLICENSE",)),
    ("Proprietary", ("ALL-RIGHTS",)),
]
# A sentence without any of these cannot be a known one.
TRIGGERS = ("licen", "permission", "warrant", "notice", "redistribut", "domain", "version", "reserved", "mozilla", "apache", "cc0")

# Text goes on after a line feed, unless the next line has no letter or digit; a stop after a single letter ("v. 2")
# ends nothing.
_SENTENCE_END = re.compile(r"(?<!\b[^\W_])[.!?]+(?=\s|$)|\n(?=[^\S\n]*(?:[^\w\n]|_)*(?:\n|$))")
_TRIGGER = re.compile("|".join(TRIGGERS))
_OTHER = re.compile(r"[\W_]+")


def normalised(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences that hold a letter or digit; one ends at ., ! or ? before white space, or before a line without either.

    A sentence may be wrapped over lines; the signs with which lines of a comment begin fall away when it is normalised.
    """
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    return [(a, b) for a, b in zip([0, *ends], [*ends, len(text)], strict=True) if any(map(str.isalnum, text[a:b]))]


class Recogniser:
    """Identifiers of known sentences in normalised text: the longest known ones that start earliest, not overlapping."""

    def __init__(self, known: dict[str, list[str]] = SENTENCES):
        self.automaton = ahocorasick.Automaton()
        for name, forms in known.items():
            for form in forms:
                if not _TRIGGER.search(form):
                    raise ValueError(f"no trigger in {form!r}")
                self.automaton.add_word(f" {form} ", (name, len(form) + 2))
        self.automaton.make_automaton()

    def identify(self, sentence: str) -> list[str]:
        found = sorted((end - n + 1, -n, name) for end, (name, n) in self.automaton.iter(f" {normalised(sentence)} "))
        out, free = [], 0
        for start, n, name in found:
            if start >= free:
                out.append(name)
                free = start - n - 1  # the space between two sentences belongs to both
        return out


def licences(ids: Sequence[str], rules: Sequence[tuple[str, tuple[str, ...]]] = RULES) -> list[str]:
    """Licences in the order of their first sentence."""
    places: dict[str, list[int]] = {}
    for at, name in enumerate(ids):
        places.setdefault(name, []).append(at)
    # for each place in these lists, the first free one from there on
    free = {name: list(range(len(x) + 1)) for name, x in places.items()}

    def after(name: str, at: int) -> int | None:
        """The first free place of an identifier behind ``at``."""
        if name not in places:
            return None
        jump, i = free[name], bisect_right(places[name], at)
        while jump[i] != i:
            jump[i] = i = jump[jump[i]]
        return places[name][i] if i < len(places[name]) else None

    out, used = [], set()
    for first, name in enumerate(ids):
        if first in used:
            continue
        for licence, need in rules:
            if need[0] != name:
                continue
            taken = [first]
            for want in need[1:]:
                at = after(want, taken[-1])
                if at is None:
                    break
                taken.append(at)
            else:
                out.append(licence)
                used.update(taken)
                for at in taken:
                    i = bisect_right(places[ids[at]], at) - 1
                    free[ids[at]][i] = i + 1
                break
    return out


def scan(text: str, recogniser: Recogniser) -> tuple[int, list[tuple[int, int, str]]]:
    """Number of sentences, and (start, end, identifier) of the known ones."""
    spans = sentences(text)
    low = text.lower()
    if not _TRIGGER.search(low):
        return len(spans), []
    found = []
    for a, b in spans:
        part = text[a:b]
        if _TRIGGER.search(part.lower()):
            found += [(a, b, name) for name in recogniser.identify(part)]
    return len(spans), found


def recognised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_sentences, n_licence_sentences, sentence_ids and licences (in order, comma-joined), spans, for every row.

    spans: start:end of each sentence that holds a known one, in code points. Known sentences may stand among other
    words of a sentence, and be wrapped over lines. Null and empty texts have no sentences; the whole text is read;
    repeated rows and null keys each get a row; an empty table gives an empty result; other columns are not read.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recogniser = Recogniser()
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                n, found = scan(t or "", recogniser)
                ids = [x[2] for x in found]
                rows.append((n, len(ids), ",".join(ids), ",".join(licences(ids)), ",".join(f"{a}:{b}" for a, b, _ in found)))
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[key, "n_sentences", "n_licence_sentences", "sentence_ids", "licences", "spans"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, n_sentences long, n_licence_sentences long, sentence_ids string, licences string, spans string")
