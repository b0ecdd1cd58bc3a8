"""The corpus operators against brute force, on small and awkward tables."""

import base64
import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import minhash, quality, warc
from corpusloom.llm.components import components, forest
from corpusloom.llm.decontaminate import decontaminate
from corpusloom.llm.exact_dedup import exact_dedup
from corpusloom.llm.language_model import language_model_scores
from corpusloom.llm.licenses import license_scan
from corpusloom.llm.line_dedup import line_dedup
from corpusloom.llm.packing import pack
from corpusloom.llm.shingling import Shingler, overlaps
from corpusloom.llm.token_counts import token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, kept string, words string, n long, row long"


def awkward(seed=1, copies=40):
    """Copies, near copies, shared lines, null, empty and long texts, repeated rows and ids."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5)))
    texts = [None, "", " \n\t ", "one", "two words", "A B C D", "a b c d", "ends in line\n\n", "dup\ndup\nDUP", "Ünï Côdé"]
    base = [word() for _ in range(120)]
    passage = " ".join(word() for _ in range(60))
    for _ in range(copies):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = word()
        texts.append("\n".join(" ".join(w[i : i + 40]) for i in range(0, 120, 40)))
    texts += [" ".join(base).upper()] * 3 + ["\n".join([" ".join(word() for _ in range(30)), passage, "tail " + word()]) for _ in range(20)]
    texts.append(" ".join(word() for _ in range(30_000)))
    rows = [(i, t, "x", "k", "w", 1, 2) for i, t in enumerate(texts)]
    return [*rows, rows[12], (None, "no id\nline", "x", "k", "w", 1, 2), (None, None, "x", "k", "w", 1, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOW)) if x]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def similar(a, b):
    n = len(a & b)
    return n > 0 and 100 * n >= 75 * (len(a) + len(b) - n)


def test_exact_dedup(docs, empty):
    rows = awkward()
    norm = lambda t: (t or "").translate(LOW)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    got = exact_dedup(docs).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for r in rows:
        g = groups[norm(r[1])]
        keep = max((x for x in g if x is not None), default=None)
        want[r[0], keep, len(g), r[0] == keep, hashlib.sha256(norm(r[1]).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, got)) == want
    assert exact_dedup(empty).count() == 0


@pytest.mark.parametrize("sizes", [(768, 1_500_000), (16, 4000)])
def test_near_duplicates(docs, empty, monkeypatch, sizes):
    monkeypatch.setattr(minhash, "BLOCK_SETS", sizes[0])
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", sizes[1])
    rows = {r[0]: shingle_set(r[1]) for r in awkward() if r[0] is not None}
    label = {i: i for i in rows}
    changed = True
    pairs = [(a, b) for a in rows for b in rows if a < b and similar(rows[a], rows[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(awkward())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(rows[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(empty).count() == 0


def test_line_dedup(docs, empty):
    rows = sorted({(math.inf if r[0] is None else r[0], r[1]) for r in awkward() if r[1] is not None})
    lines = [(i, j, shingle_set(x)) for i, t in rows for j, x in enumerate(t.split("\n"))]
    gone = {(i, j) for n, (i, j, s) in enumerate(lines) if s and any(similar(s, q) for _, _, q in lines[:n])}
    got = line_dedup(docs)
    assert set(got.columns) == {*docs.columns, "n_lines", "n_removed"}
    for r in got.collect():
        i = math.inf if r["doc_id"] is None else r["doc_id"]
        source = next(t for d, t in [(math.inf if x[0] is None else x[0], x[1]) for x in awkward()] if d == i and (t is None) == (r["text"] is None))
        if source is None:
            assert r["text"] is None and r["n_removed"] == 0
        else:
            parts = source.split("\n")
            assert r["text"] == "\n".join(x for j, x in enumerate(parts) if (i, j) not in gone), i
            assert r["n_removed"] == sum((i, j) in gone for j in range(len(parts))) and r["n_lines"] == len(parts)
    assert line_dedup(empty).count() == 0


def test_decontamination(spark, docs, empty):
    rows = awkward()
    long = rows[15][1].split()
    items = [(1, " ".join(long[20:50])), (2, "two WORDS"), (3, "one"), (4, None), (5, ""), (6, " ".join(long[20:50])), (7, "never seen words of ten and more in any of them"), (10, " ".join(long[40:52]))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, kept string")
    words = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW)) if w]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[s : s + 10])].add(str(i))
    want = collections.Counter()
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[x]
        want[r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    assert collections.Counter(map(tuple, decontaminate(docs, bench).collect())) == want
    assert sum(k[5] for k in want) > 10
    assert decontaminate(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate(docs, bench.where("false")).collect())
    assert set(decontaminate(docs, bench, keep=("text", "kept")).columns) >= {"text", "kept"}


def test_token_counts(docs, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = collections.Counter((r[0], len((r[1] or "").encode()), n(r[1]), n(r[1]) > 1024) for r in awkward())
    path = f"file://{tmp_path}/cache"
    assert collections.Counter(map(tuple, token_counts(docs, BPE, path).collect())) == want
    cached = docs.sparkSession.read.parquet(path).count()
    assert docs.sparkSession.read.parquet(path).select("digest").distinct().count() == len({r[1] or "" for r in awkward()})
    assert collections.Counter(map(tuple, token_counts(docs, BPE, path).collect())) == want
    assert docs.sparkSession.read.parquet(path).count() == cached  # nothing was encoded again
    assert token_counts(empty, BPE).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    got = pack(docs, BPE).collect()
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024
    padding = sum(1024 - n for n in ends.values() if n & (n - 1))
    assert padding < 0.02 * sum(ends.values())
    ids = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in awkward() if r[0] not in (None, 12)}
    for i, tokens in ids.items():
        at = 0
        for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]):
            part = tokens[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(tokens) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(tokens)
    assert pack(empty, BPE).count() == 0


def test_warc_round_trip(spark, folder):
    rnd = random.Random(3)
    html = lambda: "<html>" + " ".join(rnd.choice(["<p>", "körper", "text", "</p>"]) for _ in range(300)) + "</html>"
    pages = [(i, f"https://x.org/{i}", html()) for i in range(60)] + [(100, None, None), (101, "u\r\nX: y", ""), (102, "u", "same"), (103, "u", "same"), (104, "u", "SAME")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload string")
    manifest = warc.write_archives(df, f"{folder}/w")
    got = {r["page_id"]: r for r in warc.read_archives(spark, manifest, f"{folder}/w").collect()}
    last = {}
    for i, _, h in pages:
        last[h or ""] = i
    assert len(got) == len(pages)
    for i, u, h in pages:
        raw, r = (h or "").encode(), got[i]
        response = last[h or ""] == i
        assert r["record_type"] == ("response" if response else "revisit") and r["refers_to"] == (None if response else last[h or ""])
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r["payload"] == (raw if response else b"")
    assert {r["record_type"] for r in warc.roundtrip(df, f"{folder}/v", minimum=5).where("page_id in (102, 103)").collect()} == {"response"}
    first = open(manifest.orderBy("path").first()["path"], "rb").read(4)
    assert struct.unpack("<I", first)[0] == 0x184D2A5D
    assert warc.roundtrip(df.where("false"), f"{folder}/e").count() == 0


def test_dictionary_is_built_and_used():
    records = [f"<html><head><title>{i}</title></head>{'<p>the same boilerplate of every page</p>' * 20}{i * 7919}</html>".encode() for i in range(400)]
    import io

    packed = warc.archive(records)
    assert struct.unpack("<II", packed[:8])[1] > 100
    assert list(warc.frames(io.BytesIO(packed))) == records


@pytest.mark.parametrize("sizes", [(3, 5), (1, 40), (200, 3), (2, 300_000)])
def test_small_archives_have_a_dictionary_too(sizes):
    import io

    records = [f"{i}:".encode() + bytes(random.Random(i).choices(range(97, 105), k=sizes[1])) * 4 for i in range(sizes[0])]
    packed = warc.archive(records)
    raw = warc.build_dictionary(records)
    assert (len(raw) > 0) == (sum(map(len, records)) >= 64) and len(raw) <= max(64, sum(map(len, records)) // 8)
    assert list(warc.frames(io.BytesIO(packed))) == records


def test_warc_null_ids_and_repeats(spark, folder):
    rows = [(None, "u", "body"), (None, None, None), (5, "u", "body"), (5, "u", "body"), (3, "u", "body")]
    got = warc.roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{folder}/n").collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in got) == [(0, "response", 0, 0), (0, "response", 0, 4), (3, "revisit", 5, 4), (5, "response", 0, 4), (5, "response", 0, 4)]


def test_filter_in_turns_and_items_in_blocks(docs, spark, monkeypatch):
    """A filter of several turns and items of several blocks give the same rows."""
    rows = lambda df: collections.Counter(map(tuple, df.collect()))
    docs = docs.where("length(text) < 10000")
    want = rows(exact_dedup(docs))
    monkeypatch.setattr("corpusloom.llm.exact_dedup.BITS_PER_ROW", 4096)
    assert rows(exact_dedup(docs, filter_bytes=3 * 4096)) == want
    bench = spark.createDataFrame([(i, t) for i, t, *_ in awkward()[12:40]], "item_id long, text string")
    assert rows(decontaminate(docs, bench, block_bytes=100_000)) == rows(decontaminate(docs, bench))


def test_groups_are_joined_hot_or_not(spark):
    from corpusloom.llm.common import join_groups, stored

    rows = stored(spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)], "id long, key string"), "rows")
    groups = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "groups")
    want = {r["key"]: r["n"] for r in groups.collect()}
    got = join_groups(rows, groups, "key", "n").collect()
    assert len(got) == 3000 and all(r["n"] == want[r["key"]] for r in got)


def test_license_edges(spark, empty):
    long = "word " * 200_000 + "\nReleased under the MIT License.\n"
    rows = [(1, long, "a"), (1, long, "a"), (None, "SPDX-License-Identifier: BSD-3-Clause", "b"), (2, "(c)", "c")]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()
    assert sorted((str(r["doc_id"]), r["n_matches"], r["licenses"]) for r in got) == [("1", 1, "MIT"), ("1", 1, "MIT"), ("2", 0, ""), ("None", 1, "BSD-3-Clause")]
    assert license_scan(empty).count() == 0


def test_licenses(spark):
    from corpusloom.llm.licenses import SENTENCES

    rows = [
        (1, "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License. All rights reserved."),
        (2, "Licensed under the Apache License, Version 2.0 (the \"License\"); \nnothing"),
        (3, ". ".join(s for i, s in SENTENCES.items() if i < 4)),
        (4, None),
        (5, ""),
        (6, "A note. Released under the MIT License. LICENSED UNDER CC BY-NC 4.0. Released under the MIT License."),
    ]
    got = {r["doc_id"]: (r["n_matches"], r["licenses"]) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, "Apache-2.0,proprietary"), 2: (1, "Apache-2.0"), 3: (1, "MIT"), 4: (0, ""), 5: (0, ""), 6: (3, "CC-BY-NC-4.0,MIT")}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""


@pytest.mark.parametrize("width", [40, 78, 10_000])
@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_wrapped_licenses(spark, width, mark):
    import textwrap

    wrap = lambda t: "\n".join(mark + x for p in t.split("\n\n") for x in [*textwrap.wrap(p, width), ""])
    rows = [
        (1, wrap(MIT)),
        (2, "MIT License\nCopyright (c) 2020 A\n" + wrap(MIT).replace("\n", "\r\n")),
        (3, "Copyright (c) 2020, A\nAll rights reserved.\n\n" + wrap(BSD)),
        (4, wrap(GPL)),
        (5, wrap(APACHE)),
        (6, "Read me\nThis project is licensed under the MIT License."),
        (8, "Copyright (c) 2021, B\n\n" + wrap(BSD3)),
        (9, wrap(LGPL)),
        (10, wrap(MPL)),
        (11, "Copyright B\n\n" + wrap(ISC)),
        (7, "Copyright A.\nAll rights reserved.\n" + "\n".join("word" for _ in range(500))),
    ]
    got = {r["doc_id"]: (r["n_matches"], r["licenses"]) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, "MIT"), 2: (1, "MIT"), 3: (1, "BSD-2-Clause"), 4: (1, "GPL-3.0-or-later"), 5: (1, "Apache-2.0"), 6: (1, "MIT"), 7: (1, "proprietary"), 8: (1, "BSD-3-Clause"), 9: (1, "LGPL-2.1-or-later"), 10: (1, "MPL-2.0"), 11: (1, "ISC")}


def test_license_texts_tags_and_notices_inside_sentences(spark):
    import textwrap

    gpl3 = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.

  The licenses for most software and other practical works are designed
to take away your freedom to share and change the works.  By contrast,
"""
    apache = """                                 Apache License
                           Version 2.0, January 2004

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

      "Licensor" shall mean the copyright owner or entity authorized by
      the copyright owner that is granting the License.
"""
    mpl = textwrap.fill('1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.', 60)
    rows = [
        (1, gpl3, "GPL-3.0-only"),
        (2, apache, "Apache-2.0"),
        (3, "# SPDX-License-Identifier: MIT OR Apache-2.0\ncode", "Apache-2.0,MIT"),
        (4, "// SPDX-License-Identifier: GPL-2.0\nint x;", "GPL-2.0-only"),
        (5, "The code is licensed under the MIT license, see LICENSE.", "MIT"),
        (6, "SPDX-License-Identifier: (GPL-2.0-or-later OR LGPL-2.1-or-later) AND MIT", "GPL-2.0-or-later,LGPL-2.1-or-later,MIT"),
        (7, "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only"),
        (8, mpl, "MPL-2.0"),
        (9, "It isn't clear what is licensed under the mitigation plan, or under the MIT licenses.", ""),
        (10, "Parts are licensed under the BSD 3-Clause License and parts released under the Apache License, Version 2.0, as said.", "Apache-2.0,BSD-3-Clause"),
        (11, "SPDX-License-Identifier: NOASSERTION", ""),
    ]
    got = {r["doc_id"]: r["licenses"] for r in license_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {i: names for i, _, names in rows}


def test_language_model(spark, docs, empty):
    rows = awkward()
    tokens = [(r[0], [x for x in re.split("[\x20\x09-\x0d]+", (r[1] or "").translate(LOW)) if x] + [None]) for r in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in tokens if not held(i) for w in t)
    total, types = sum(counts.values()), len(counts)
    got = language_model_scores(docs).collect()
    want = sorted((str(i), held(i), len(t), sum(w in counts for w in t), total, round(sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in t), 6)) for i, t in tokens)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert language_model_scores(empty).count() == 0


def test_score_equals_enumeration(spark, docs):
    """Every token's probability by plain loops over all classes and words; over all words it sums to one."""
    from corpusloom.llm import language_model as lm

    training = docs.where(~lm.held_out(docs.doc_id))
    model, vocabulary = lm.fit(training)
    counts = {np.uint64(r["word"] & (2**64 - 1)): r["c"] for r in vocabulary.collect()}
    index = {w: i for i, w in enumerate(model.words.tolist())}
    assert sum(counts.values()) == model.total and len(counts) == model.types and 0 < model.discount < 1 and model.weights.any() and model.inner.any()
    shingler = Shingler()
    members = collections.defaultdict(list)
    for i in range(len(model.words)):
        members[int(model.classes[i])].append(i)

    def softmax(z):
        z = np.exp(z.astype(np.float64))
        return z / z.sum()

    def outcomes(places, t):
        """Probabilities by word in the context of token ``t``, and that of one unknown word."""
        own = np.array([*places[: t + 1]])
        outer, _ = model.features(own, np.array([len(own)]))
        of_class = softmax(model.weights[outer[:, t]].sum(0) + model.bias)
        out = {}
        for c, words in members.items():
            own[t] = words[0]
            _, rows = model.features(own, np.array([len(own)]))
            slots = softmax(model.inner[rows[:, t]].sum(0) + model.inner_bias[c])
            whole = collections.Counter()
            for w in words:
                whole[model.slots[w]] += int(model.counts[w])
            for w in words:
                out[np.uint64(model.words[w])] = of_class[c] * slots[model.slots[w]] * model.counts[w] / whole[model.slots[w]]
        rare = {w: c for w, c in counts.items() if int(w) not in index}
        for w, c in rare.items():
            out[w] = of_class[lm.RARE] * (c - model.discount) / sum(rare.values())
        mass = model.discount * len(rare) / sum(rare.values()) if rare else 1.0
        return out, of_class[lm.RARE] * mass / model.unseen

    got = collections.defaultdict(list)
    for r in lm.score(docs, model, vocabulary).collect():
        got[r["doc_id"]].append(r["score"])
    for doc_id, text, *_ in awkward()[:45]:
        a, _, _ = shingler.words([text or ""])
        tokens = [*a[:12], lm.END] if len(a) > 12 else [*a, lm.END]
        places = [index.get(int(w), lm.OTHER) for w in tokens]
        want = 0.0
        for t, w in enumerate(tokens[: len(a)] if len(a) > 12 else tokens):
            p, unknown = outcomes(places, t)
            assert abs(sum(p.values()) + unknown * model.unseen - 1) < 1e-4
            want += math.log10(p.get(w, unknown))
        if len(a) <= 12:
            assert any(abs(x - want) < 1e-3 for x in got[doc_id]), doc_id


def test_no_word_occurs_twice(spark):
    """Singletons aren't worth more than unknown words, whatever the counts of counts."""
    rows = [(i, f"w{2 * i} w{2 * i + 1}") for i in range(1, 60)]
    r = {x["doc_id"]: x for x in language_model_scores(spark.createDataFrame([*rows, (1000, "q r"), (1001, "s t")], "doc_id long, text string")).collect()}
    known = [x["score"] for x in r.values() if x["n_known"] == 3]
    odd = [x["score"] for x in r.values() if x["n_known"] == 1]
    assert known and odd and min(known) >= max(odd) - 1e-6


@pytest.mark.parametrize("width", [64, 16])
def test_training_step_equals_a_plain_one(width):
    from corpusloom.llm import language_model as lm

    assert lm.CLASSES == 64
    rng = np.random.default_rng(3)
    rows = rng.zipf(1.3, (4, 500)) % 300
    label = rng.integers(0, width, 500)
    weights = rng.normal(size=(1024, width)).astype(np.float32)
    squares = rng.random(len(weights)).astype(np.float32)
    bias = rng.normal(size=(500, width)).astype(np.float32)
    want, sums = weights.astype(np.float64), squares.astype(np.float64)
    z = np.exp(sum(want[r] for r in rows) + bias)
    error = z / z.sum(1, keepdims=True) - np.eye(width)[label]
    for own in rows:
        for row in np.unique(own):
            e = error[own == row]
            g = e.sum(0) / len(e) ** 0.5
            sums[row] += (g * g).mean()
            want[row] -= lm.STEP / len(rows) / sums[row] ** 0.5 * g
    lm.take_step(rows, label, weights, squares, bias)
    assert np.allclose(weights, want, atol=1e-4) and np.allclose(squares, sums, rtol=1e-4, atol=1e-4)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    counts = np.array([3, 0, 1, 4])
    scores, move = rng.normal(size=8), rng.normal(size=(2, 2))
    marginal, pairs = quality.forward_backward(scores, counts, move)
    want, both, at = [], np.zeros((2, 2)), 0
    for n in counts:
        if not n:
            continue
        paths = [[(m >> k) & 1 for k in range(n)] for m in range(2**n)]
        w = np.array([math.exp(sum(scores[at + k] * p[k] for k in range(n)) + sum(move[p[k]][p[k + 1]] for k in range(n - 1))) for p in paths])
        w /= w.sum()
        want += [sum(x for x, p in zip(w, paths) if p[k]) for k in range(n)]
        for x, p in zip(w, paths):
            for k in range(n - 1):
                both[p[k], p[k + 1]] += x
        at += n
    assert np.allclose(marginal, want) and np.allclose(pairs, both)


def test_quality(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"])
    good = lambda: "\n".join(" ".join(word() for _ in range(20)).capitalize() + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(word().upper() + "!!" for _ in range(20)) for _ in range(4))
    rows = [(i, good() if i % 3 else bad(), "k") for i in range(240)]
    docs = spark.createDataFrame([*rows, (900, None, "k"), (901, "", "k"), (902, " \n", "k"), (None, good(), "k"), rows[0]], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.quality(docs, model, keep=("kept",)).collect()
    assert len(got) == 245 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 240)
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i in [*range(240), 900, 901, 902] if zlib.crc32(str(i).encode()) % 4 == 2}
    assert quality.quality(docs.where("false"), model).count() == 0 and quality.scores(["Word here. " * 200_000], model).shape == (1,)
    none = quality.train(docs, labels.where("false"))
    assert {r["score"] for r in quality.quality(docs, none).collect()} == {0.5}


def test_shingles_and_overlaps():
    s = Shingler()
    texts = ["A b C d e f", "a b c d e f", "x", "", " \n ", "a b c d e", "é\x0bÉ z"]
    sets = s.text_sets(texts)
    assert np.array_equal(sets[0], sets[1]) and [len(x) for x in sets] == [2, 2, 1, 0, 0, 1, 1] and np.isin(sets[5], sets[0]).all()
    rng = np.random.default_rng(0)
    many = [np.unique(rng.integers(0, 500, 200).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in many] for a in many]
    off = ~np.eye(20, dtype=bool)
    assert (overlaps(many) == np.array(want))[off].all() and (overlaps(many[:5], many[5:]) == np.array(want)[:5, 5:]).all()


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert all(label[n] == x for n, x in got.items()) and all(label[n] == n for n in label if n not in got)
    u, v = forest(np.array([3, 2, 9]), np.array([2, 1, 8]))
    assert dict(zip(u.tolist(), v.tolist())) == {2: 1, 3: 1, 9: 8}


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
        assert docs.columns == list(p.COLUMNS)
        assert 0 < docs.count() <= seen, name
        seen = docs.count()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = p.run(spark, d)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids
    near = minhash.near_duplicates(docs)
    assert near.where("not kept").count() == 0
    assert decontaminate(docs, spark.read.parquet(f"{d}/benchmark.parquet")).where("contaminated").count() == 0


def test_registration():
    import __spark_entry__ as e

    names = set(e.queries())
    assert all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 11)) and "pipeline" in names



def test_quality_keeps_the_seam_between_documents(spark):
    """A good training document followed by a bad one, with lines that only these classes have: marginals fall at the seam."""
    good = "\n".join(f"plain words about the matter number {i} and what follows from it." for i in range(6))
    bad = "\n".join(f"%%% ### {i} $$$ !!! &&& *** |||" for i in range(6))
    docs = [(i, good if i % 2 else bad) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.train(df, spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int"))
    both = spark.createDataFrame([(1, good), (2, bad), (3, good + "\n" + bad), (4, ""), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.quality(both, model).collect()}
    share = len(good) / (len(good) + len(bad))
    assert got[1] > 0.95 and got[2] < 0.05 and abs(got[3] - share) < 0.15
    assert got[4] == got[5] and 0 <= got[4] <= 1


def test_exact_dedup_reads_each_turn_of_its_filter_alone(spark, docs, monkeypatch):
    from corpusloom.llm import exact_dedup as ed

    seen = []
    plain = ed.stored
    monkeypatch.setattr(ed, "stored", lambda df, name, made=None: (seen.append(df._jdf.queryExecution().executedPlan().toString()) if name == "bloom-tested" else None, plain(df, name, made))[1])
    monkeypatch.setattr(ed, "BITS_PER_ROW", 4096)
    rows = sorted(map(str, exact_dedup(docs, filter_bytes=3 * 4096).collect()))
    assert len(seen) > 1 and all(p.count("PartitionFilters: [isnotnull(turn") == 2 for p in seen)
    assert len(rows) == docs.count()
