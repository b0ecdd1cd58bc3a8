"""Licence recognition by sentences.

A text is cut into sentences, however its lines are wrapped, each normalised to lower-case letters and digits; known
licence sentences have identifiers, and ordered rules name the identifier sequences that make a licence. All of it is one projection:
the sentence table and the rules are fixed lists of a few hundred entries, so nothing is joined or shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Known sentences, as normalised, by identifier.
SENTENCES = {
    1: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    2: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    3: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    4: "licensed under the apache license version 2 0",
    5: "licensed under the apache license version 2 0 the license",
    6: "you may not use this file except in compliance with the license",
    7: "you may obtain a copy of the license at http www apache org licenses license 2 0",
    8: "released under the mit license",
    9: "licensed under the mit license",
    10: "this work is licensed under the gnu general public license version 3",
    11: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    12: "licensed under cc by nc 4 0",
    13: "licensed under cc by 4 0",
    14: "licensed under cc by sa 4 0",
    15: "this work is licensed under a creative commons attribution 4 0 international license",
    16: "all rights reserved",
    17: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    18: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    19: "this work is dedicated to the public domain under cc0 1 0",
    20: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    21: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    22: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    23: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    24: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    25: "see the gnu general public license for more details",
    26: "you should have received a copy of the gnu general public license along with this program",
    27: "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    28: "you may obtain a copy of the license at",
    29: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    30: "see the license for the specific language governing permissions and limitations under the license",
    31: "this project is licensed under the mit license",
    35: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    36: "this is free and unencumbered software released into the public domain",
    37: "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    38: "this source code form is subject to the terms of the mozilla public license v",
    39: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    40: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    41: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    42: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    43: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    44: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    45: "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    46: "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
    47: "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    48: "this software is provided as is without any express or implied warranty",
    49: "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    50: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    52: "the gnu general public license is a free copyleft license for software and other kinds of works",
    53: "the licenses for most software and other practical works are designed to take away your freedom to share and change the works",
    54: "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users",
    55: "by contrast the gnu general public licenses are intended to guarantee your freedom to share and change free software to make sure the software is free for all its users",
    56: "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    57: "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    58: "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    59: "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
    60: "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software",
    61: "contributor version means the combination of the contributions of others if any used by a contributor and that particular contributor s contribution",
    51: "in no event will the authors be held liable for any damages arising from the use of this software",
}

#: Licences by the names that notices give them.
NAMES = {
    "the mit license": "MIT",
    "the apache license version 2 0": "Apache-2.0",
    "the apache license 2 0": "Apache-2.0",
    "the bsd 2 clause license": "BSD-2-Clause",
    "the bsd 3 clause license": "BSD-3-Clause",
    "the bsd license": "BSD",
    "the isc license": "ISC",
    "the mozilla public license 2 0": "MPL-2.0",
    "the mozilla public license version 2 0": "MPL-2.0",
    "the eclipse public license 2 0": "EPL-2.0",
    "the boost software license version 1 0": "BSL-1.0",
    "the gnu general public license version 2": "GPL-2.0-only",
    "the gnu general public license version 3": "GPL-3.0-only",
    "the gnu lesser general public license version 3": "LGPL-3.0-only",
    "the gnu affero general public license version 3": "AGPL-3.0-only",
    "the unlicense": "Unlicense",
    "cc by 4 0": "CC-BY-4.0",
    "cc by sa 4 0": "CC-BY-SA-4.0",
    "cc by nc 4 0": "CC-BY-NC-4.0",
    "a creative commons attribution 4 0 international license": "CC-BY-4.0",
    "a creative commons attribution sharealike 4 0 international license": "CC-BY-SA-4.0",
    "a creative commons attribution noncommercial 4 0 international license": "CC-BY-NC-4.0",
}

#: How notices lead to the name.
LEADS = ("licensed under", "released under", "this project is licensed under", "this software is licensed under", "this work is licensed under", "this program is licensed under", "this code is released under", "distributed under")

#: Identifiers that are deprecated, and what they stand for.
DEPRECATED = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}
#: How a line with an identifier begins.
TAG = "spdx license identifier "

_NOTICES = {f"{lead} {name}": licence for name, licence in NAMES.items() for lead in LEADS}
_TAGGED = {*NAMES.values(), *DEPRECATED.values(), "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "CC0-1.0", "Zlib", "WTFPL"}
_NOTICES |= {TAG + re.sub("[^a-z0-9]+", " ", name.lower()): DEPRECATED.get(name, name) for name in sorted(_TAGGED | set(DEPRECATED))}
_OWN = {s: i for i, s in SENTENCES.items()}
_IDS = {s: _OWN.get(s, 1000 + k) for k, s in enumerate(_NOTICES)}
SENTENCES |= {i: s for s, i in _IDS.items()}

#: Rules in order of precedence, a licence and the identifiers that follow each other. Notices come last.
RULES = (
    ("MIT", (1, 2, 3, 20)),
    ("MIT", (1, 2, 3)),
    ("BSD-3-Clause", (17, 21, 22, 23)),
    ("BSD-2-Clause", (17, 21, 22)),
    ("Apache-2.0", (5, 6, 7)),
    ("Apache-2.0", (27,)),
    ("GPL-3.0-or-later", (11, 18)),
    ("GPL-2.0-or-later", (43, 18)),
    ("AGPL-3.0-or-later", (42, 18)),
    ("LGPL-2.1-or-later", (40, 50)),
    ("LGPL-3.0-or-later", (41, 50)),
    ("GPL-3.0-only", (52, 53)),
    ("AGPL-3.0-only", (56, 53)),
    ("Apache-2.0", (58, 59)),
    ("MPL-2.0", (60, 61)),
    ("Unlicense", (36, 37)),
    ("Zlib", (48, 51)),
    ("Apache-2.0", (5, 6)),
    ("MIT", (1, 2)),
    ("MIT", (1,)),
    ("GPL-3.0-or-later", (11,)),
    ("GPL-2.0-or-later", (43,)),
    ("AGPL-3.0-or-later", (42,)),
    ("LGPL-2.1-or-later", (40,)),
    ("LGPL-3.0-or-later", (41,)),
    ("GPL-3.0-only", (10,)),
    ("Apache-2.0", (5,)),
    ("GPL-3.0-only", (52,)),
    ("AGPL-3.0-only", (56,)),
    ("GPL-2.0-only", (54,)),
    ("LGPL-2.1-only", (55,)),
    ("LGPL-3.0-only", (57,)),
    ("Apache-2.0", (58,)),
    ("MPL-2.0", (60,)),
    ("ISC", (35,)),
    ("Unlicense", (36,)),
    ("MPL-2.0", (38,)),
    ("EPL-2.0", (44,)),
    ("BSL-1.0", (47,)),
    ("WTFPL", (49,)),
    ("CC0-1.0", (19,)),
    ("CC0-1.0", (45,)),
    ("CC0-1.0", (46,)),
    ("BSD", (16, 17)),
    ("BSD", (17,)),
    ("proprietary", (16,)),
    *((licence, (_IDS[s],)) for s, licence in _NOTICES.items() if _IDS[s] != 10),
)


#: Between sentences, in place of white space after a full stop, exclamation or question mark, or the colon before conditions, and of lines without letters and digits.
CUT = "\x01"
BLANK, STOP = r"\n[^a-z0-9]*\n", r"([.!?]|conditions:|met:)[ \t\r\n]+"
#: The number or letter of a clause is no sentence.
NUMBER = "^([0-9]{1,2}|[a-z])$"
#: A notice inside a longer sentence; longer names come first.
INSIDE = rf"\b(?:licensed|released|distributed) under (?:{'|'.join(sorted(NAMES, key=lambda n: (-len(n), n)))})\b"
#: What joins the identifiers of an expression, with the marker for the words that belong to one, and an exception to it.
JOINED, LATER, MARK, EXCEPT = " (?:or|and) ", " or later", " orlater", " with .*"


def most_words(known) -> int:
    """A known sentence has at most so many words, and so many lines."""
    return max((len(s.split()) for s in known), default=1)


def sentences(text: Column, known=tuple(SENTENCES.values())) -> Column:
    """Normalised sentences: cut at blank lines and at white space after a full stop, exclamation or question mark, or
    the colon that conditions follow; the number or letter of a clause is left out. A notice inside a longer sentence takes its
    place, and a line with an expression of identifiers gives one sentence for each.

    Lines of a sentence are joined where they make a known one, with or without the lines before it, such as a
    title; other lines stay apart, so that a notice on a line of its own is found as well.
    """
    cut = F.regexp_replace(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BLANK, CUT), STOP, f"$1{CUT}")
    plain = lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    lines = F.transform(F.split(cut, CUT), lambda s: F.filter(F.transform(F.split(s, "\n"), plain), lambda x: x != ""))
    def units(a: Column) -> Column:
        from_ = lambda i: F.array_join(F.slice(a, i, F.size(a)), " ")
        starts = F.filter(F.sequence(F.greatest(F.size(a) - most_words(known) + 1, F.lit(1)), F.size(a) - 1), lambda i: from_(i).isin(*known))
        whole = F.transform(F.array(F.get(starts, F.lit(0))), lambda i: F.when(i.isNull(), a).otherwise(F.concat(F.slice(a, 1, i - 1), F.array(from_(i)))))
        return F.when(F.size(a) < 2, a).otherwise(F.flatten(whole))

    return F.flatten(F.transform(F.filter(F.flatten(F.transform(lines, units)), lambda s: ~s.rlike(NUMBER)), lambda s: _parts(s, known)))


def _parts(s: Column, known) -> Column:
    """A sentence that isn't known gives way to the notices inside it, a line with several identifiers to one for each."""
    tag = lambda x: F.concat(F.lit(TAG), F.regexp_replace(F.replace(x, F.lit(MARK), F.lit(LATER)), EXCEPT, ""))
    tags = F.transform(F.split(F.replace(F.substr(s, F.lit(len(TAG) + 1)), F.lit(LATER), F.lit(MARK)), JOINED), tag)
    inside = F.regexp_extract_all(s, F.lit(INSIDE), F.lit(0))
    return F.when(s.isin(*known), F.array(s)).when(F.startswith(s, F.lit(TAG)), tags).when(s.rlike(INSIDE), inside).otherwise(F.array(s))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[int, str] = SENTENCES, rules=RULES) -> DataFrame:
    """``id_col, n_sentences, n_known, n_matches, licenses``: one row per input row.

    A rule matches where its identifiers are those of sentences in a row. A match counts unless one of its
    sentences belongs to a match of a rule that comes earlier in order. ``licenses`` joins the distinct licences
    of the matches that count, sorted, with commas; it is empty for texts without any, and for null and empty
    texts. Sentences whose letters are not ASCII keep their ASCII part only. Repeated rows and null ids are
    kept; further columns are ignored.
    """
    table = F.create_map(*[F.lit(x) for i, s in known.items() for x in (s, i)])
    book = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("name"), F.array(*map(F.lit, ids)).alias("ids")) for i, (name, ids) in enumerate(rules)])
    rows = docs.select(F.col(id_col).alias("id"), sentences(F.col(text_col), tuple(known.values())).alias("s"))
    coded = F.transform("s", lambda s, i: F.struct(i.alias("pos"), F.when(s.isin(*known.values()), F.try_element_at(table, s)).alias("sid")))
    rows = rows.select("id", F.size("s").cast("long").alias("n_sentences"), F.filter(coded, lambda e: e["sid"].isNotNull()).alias("e"))
    rows = rows.withColumn("at", F.map_from_entries("e")).withColumn("book", F.when(F.size("e") > 0, book))

    def here(e: Column) -> Column:
        fits = F.filter("book", lambda r: F.forall(F.transform(r["ids"], lambda x, i: F.try_element_at(F.col("at"), e["pos"] + i).eqNullSafe(x)), lambda ok: ok))
        return F.transform(fits, lambda r: F.struct(e["pos"].alias("start"), (e["pos"] + F.size(r["ids"])).alias("end"), r["ord"].alias("ord"), r["name"].alias("name")))

    rows = rows.withColumn("m", F.when(F.size("e") > 0, F.flatten(F.transform("e", here))))
    stands = F.filter("m", lambda c: ~F.exists("m", lambda d: (d["ord"] < c["ord"]) & (d["start"] < c["end"]) & (c["start"] < d["end"])))
    rows = rows.select("id", "n_sentences", F.size("e").cast("long").alias("n_known"), stands.alias("m"))
    names = F.array_sort(F.array_distinct(F.transform("m", lambda c: c["name"])))
    return rows.select(
        F.col("id").alias(id_col),
        "n_sentences",
        "n_known",
        F.coalesce(F.size("m"), F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.array_join(names, ","), F.lit("")).alias("licenses"),
    )
