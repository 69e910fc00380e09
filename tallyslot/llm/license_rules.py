"""License scans by sentence rules: sentences become identifiers, identifier sequences are matched to ordered rules.

A text is cut into sentences (at line breaks between paragraphs, and at . ; : ! ? before white space), each is
normalised (lower case, only letters and digits, single blanks, years and holders of copyright lines and version
numbers in one form) and looked up among the known licence sentences. A sentence over several lines that is not
known is looked up line by line. The identifiers of a text, in order, are matched against the rules, the longest
first; between two identifiers of a rule at most GAP unknown sentences may stand. What a rule matches is used up;
a known sentence that no rule uses is reported as unmatched.

Defined cases. Null and empty texts have no sentences and no licence. A licence stated twice counts once. Every
input row gives one row; other columns are never read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tallyslot.llm.common import annotate

GAP = 2

# Sentences of public licences and licence notices, normalised, under identifiers of our own.
SENTENCES = {
    "apache2-notice": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license"],
    "apache2-copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2.0"],
    "apache2-comply": ["you may not use this file except in compliance with the license"],
    "as-is-basis": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ],
    "gpl3-notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl2-notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl-free": ["this program is free software"],
    "gpl3-terms": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "gpl2-terms": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"
    ],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "mit-notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit-include": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-warranty": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "bsd-grant": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    ],
    "bsd-source": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    ],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "bsd-names": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    ],
    "cc-by-4": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa-4": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc-4": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "mpl2-notice": ["this source code form is subject to the terms of the mozilla public license v 2.0"],
    "copyright-line": ["copyright year"],
    "reserved": ["all rights reserved"],
}

# Public licence names by their rules; of rules that fit at a place the longest, then the first, counts.
RULES = [
    ("MIT", ["mit-grant", "mit-include", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-include"]),
    ("MIT", ["mit-notice"]),
    ("Apache-2.0", ["apache2-notice", "apache2-comply", "apache2-copy", "as-is-basis"]),
    ("Apache-2.0", ["apache2-notice", "apache2-comply"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-2.0-only", ["gpl2-notice"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("Proprietary", ["copyright-line", "reserved"]),
]
IDENTIFIERS = {s: i for i, ss in SENTENCES.items() for s in ss}
#: Every known sentence holds one of these, so a text without them has no known sentence.
TRIGGERS = ("licens", "permi", "copyright", "redistribut", "rights reserved", "warrant", "free software")
assert all(any(t in s for t in TRIGGERS) for s in IDENTIFIERS)

PARAGRAPHS = re.compile(r"\n[ \t\r]*\n")
SENTENCE = re.compile(r"(?<=[.;:!?])\s+")
OTHER = re.compile(r"[^a-z0-9.]+|\.(?![0-9])|(?<![0-9])\.")
COPYRIGHT = re.compile(r"^(?:copyright )(?:c )?[0-9]{4}\b.*$")


def normalised(sentence: str) -> str:
    s = " ".join(OTHER.sub(" ", sentence.lower()).split())
    return COPYRIGHT.sub("copyright year", s)


def identified(text: str) -> list[str | None]:
    """An identifier, or None, for each sentence of a text in order."""
    out: list[str | None] = []
    for paragraph in PARAGRAPHS.split(text):
        for sentence in SENTENCE.split(paragraph):
            found = IDENTIFIERS.get(normalised(sentence))
            if found is None and "\n" in sentence:
                out.extend(IDENTIFIERS.get(normalised(line)) for line in sentence.split("\n"))
            else:
                out.append(found)
    return out


def fits(ids: list[str | None], at: int, rule: list[str]) -> int | None:
    """The place after the rule's last identifier, if the rule fits at ``at``."""
    for want in rule:
        skipped = 0
        while at < len(ids) and ids[at] is None and want != rule[0] and skipped < GAP:
            at, skipped = at + 1, skipped + 1
        if at >= len(ids) or ids[at] != want:
            return None
        at += 1
    return at


BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1]))


def matched(ids: list[str | None]) -> tuple[list[str], list[str]]:
    """Licences in the order found, and known sentences that no rule uses."""
    found, unused, at = [], [], 0
    while at < len(ids):
        if ids[at] is None:
            at += 1
            continue
        for name, rule in BY_LENGTH:
            end = fits(ids, at, rule)
            if end is not None:
                if name not in found:
                    found.append(name)
                at = end
                break
        else:
            unused.append(ids[at])
            at += 1
    return found, unused


def score(texts: list[str | None]) -> dict:
    rows = []
    for t in texts:
        low = t.lower() if t else ""
        if any(w in low for w in TRIGGERS):
            ids = identified(t)
            found, unused = matched(ids)
            rows.append((",".join(found), len(found), sum(i is not None for i in ids), ",".join(unused)))
        else:
            rows.append(("", 0, 0, ""))
    return dict(zip(("licenses", "n_licenses", "n_known", "unmatched"), zip(*rows, strict=True), strict=True))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, licenses (comma-joined, in order), n_licenses, n_known (known sentences), unmatched of every text."""
    return annotate(docs, lambda: score, "licenses string, n_licenses long, n_known long, unmatched string", text, keep)
