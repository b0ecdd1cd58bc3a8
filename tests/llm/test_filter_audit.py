"""The filter audit against filters that are really applied, one order after the other."""

import collections
import itertools
import math
import random
import re

from corpusloom.llm.filter_audit import filter_audit, lattice

SCHEMA = "doc_id long, text string, lang string, n long, kept string, failed int, part string"
LABELS = "doc_id long, quality int, toxic int, n int"


def failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        f
        for f, bad in {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search(r"[#$%&*|]", text),
        }.items()
        if bad
    }


def brute(rows, labels):
    texts = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            texts[r[1] or ""].append(r[0])
    marks = lambda i, at: i is not None and any(m[0] == i and m[at] == 1 for m in labels)
    docs = []
    for r in rows:
        fails = failed(r[1] or "") | ({"E"} if r[0] is not None and min(texts[r[1] or ""]) < r[0] else set())
        docs.append((r[2] or "", fails, marks(r[0], 1), marks(r[0], 2)))
    out, shares = {}, collections.Counter()
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            own = list(left)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                fails = [d for d in own if f in d[1]]
                shares[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def table(seed=4):
    rnd = random.Random(seed)
    texts = [None, "", " \t\n", "a", "A#", "É" * 40, "ß" * 50 + "A", "x y" * 3]
    for _ in range(60):
        words = [rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(rnd.choice([5, 199, 200, 260]))]
        words = [w + str(i) if rnd.random() < 0.7 else w for i, w in enumerate(words)]
        texts.append(rnd.choice([" ", "\n", "\x0b "]).join(words) + rnd.choice(["", "", " X" * 50, " |"]))
    texts += texts[:30]
    rows = [(i, t, rnd.choice(["en", "de", None, ""]), 1, "k", 3, "p") for i, t in enumerate(texts)]
    rows += [rows[20], (rows[20][0], rows[20][1], "zz", 1, "k", 3, "p"), (None, texts[20], "en", 1, "k", 3, "p"), (None, None, "de", 1, "k", 3, "p")]
    rows.append((500, " ".join(f"word{i}" for i in range(50_000)), "en", 1, "k", 3, "p"))
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None]), 9) for i in range(0, 90, 2)] + [(20, 1, 0, 9), (20, 0, 1, 9), (None, 1, 1, 9), (9999, 1, 1, 9)]
    return rows, labels


def collected(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_equals_filters_applied_in_every_order(spark):
    rows, labels = table()
    df = filter_audit(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(labels, LABELS))
    want = brute(rows, labels)
    assert collected(df) == want and df.count() == len(want)


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert filter_audit(none, labels).count() == 0
    got = collected(filter_audit(spark.createDataFrame([(1, None, None, 1, "", 1, "")], SCHEMA), labels))
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_lattice_counts_paths():
    for n in (1, 3, 5):
        for state, f, forward, backward in lattice(n):
            k = state.bit_count()
            assert not state >> f & 1 and forward == math.factorial(k) and backward == math.factorial(n - k - 1)
