"""Terms against texts and the search index, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from corpusloom.functions.text import apply_glossary, trigrams
from corpusloom.operators import substrings
from corpusloom.operators.substrings import apply_glossary_table, contained_terms
from corpusloom.sources.search_index import SearchIndex, write_search_index

ODD = ["a.b*c", "x$1y", r"q\Ew", r"back\\slash", "(paren)", "über weg", "日本語", "naïve", "İstanbul", "tab\tin", "🙂🙃🙂"]


def test_trigrams_are_those_of_all_substrings(spark):
    texts = ["", "ab", "abc", "abcabc\nx", "日本語です", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(trigrams(F.col("t"))).collect()
    for t, (g,) in zip(texts, got):
        assert sorted(g) == sorted({t[i : i + 3] for i in range(len(t) - 2)} if t else [])


def test_terms_of_all_kinds_are_found(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcd é") for _ in range(rnd.randint(1, 7)))
    hay = [(i, " ".join(rnd.choice([word(), rnd.choice(ODD)]) for _ in range(8))) for i in range(40)] + [(99, ""), (100, None), (7, "second row of an id abcd")]
    terms = sorted({word() for _ in range(150)} | set(ODD) | {"ab", "é"} - {""})
    got = contained_terms(spark.createDataFrame(hay, "id long, hay string"), spark.createDataFrame([(t,) for t in terms], "word string"), few=5)
    assert sorted(set(map(tuple, got.collect()))) == sorted({(i, t) for i, h in hay for t in terms if h and t in h})


def test_a_glossary_table_equals_one_term_after_the_other(spark):
    rnd = random.Random(5)
    # no term begins or ends inside another, and no target holds a source: the order of terms then doesn't matter
    sources = [f"Qx{''.join(rnd.choice('abcdef') for _ in range(rnd.randint(2, 6)))}Zx" for _ in range(120)] + [o for o in ODD if o not in ("İstanbul",)]
    terms = {s.lower(): (s, f"<{i}$\\{i}>") for i, s in enumerate(sources)}
    texts = [(i, " ".join(rnd.choice([rnd.choice(sources), rnd.choice(sources).upper(), "plain", "words"]) for _ in range(12)), "k") for i in range(30)] + [(77, "", "k"), (78, None, "k"), (79, "nothing here", "k")]
    df = spark.createDataFrame(texts, "id long, t string, kept string")
    got = apply_glossary_table(df, spark.createDataFrame(list(terms.values()), "source string, target string"), "t", "glossed")
    want = df.withColumn("glossed", apply_glossary(F.col("t"), list(terms.values())))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_longer_terms_come_first_and_dirty_terms_go(spark):
    df = spark.createDataFrame([(1, "New York and new york city, YORK")], "id long, t string")
    terms = [(" york ", "Y"), ("New York City", "NYC"), ("new york", "NY"), ("NEW YORK", "other"), ("", "x"), ("and", "")]
    got = apply_glossary_table(df, spark.createDataFrame(terms, "source string, target string"), "t", "g").first().g
    assert got == "other and NYC, Y"


def test_the_plan_does_not_grow_with_the_terms(spark):
    df = spark.createDataFrame([(1, "text")], "id long, t string")
    size = lambda n: len(apply_glossary_table(df, spark.range(n).select(F.concat(F.lit("term"), "id").alias("source"), F.lit("t").alias("target")), "t", "g")._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(10_000) - size(200)) < 200


def test_indexed_search_equals_a_scan(spark, folder):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeé語") for _ in range(rnd.randint(1, 6)))
    papers = [(i, f"200{rnd.randint(1, 4)}-0{rnd.randint(1, 9)}-01", " ".join(word() for _ in range(15)), f"S{i % 3}", i) for i in range(300)] + [(900, "bad", "abc", "S", 1), (901, None, "abc", "S", 1)]
    df = spark.createDataFrame(papers, "id long, published string, title string, source string, importance long")
    write_search_index(df, f"{folder}/i", block=40)
    index = SearchIndex(spark, f"{folder}/i")
    for query in ("abc", "ABc de", "a", "éé 語", "cab s1", "zzz", "", "bcd eab"):
        for years in (None, ["2002"], ["2001", "2003"], ["1999"]):
            want = {p[0] for p in papers if p[1] and re.match(r"\d{4}-", p[1]) and (years is None or p[1][:4] in years) and all(w in f"{p[2]} {p[3]}".lower() for w in query.lower().split())}
            assert {r.id for r in index.search(query, years).collect()} == want, (query, years)
    one = index._table("postings", ["2002"])
    assert {re.search(r"part=(\d+)", f)[1] for f in one.inputFiles()} == {"2002"} and {r.year for r in one.select("year").distinct().collect()} == {"2002"}
    assert one.select(F.max(F.size("ids"))).first()[0] <= 80
    plan = index.candidates(["abc", "bcd"])._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan
    # a year that is indexed again is replaced, the others stay
    write_search_index(df.where("published like '2002%' and id % 2 = 0"), f"{folder}/i", block=40)
    again = SearchIndex(spark, f"{folder}/i")
    assert {r.id for r in again.search("abc", ["2002"]).collect()} == {r.id for r in index.search("abc", ["2002"]).where("id % 2 = 0").collect()}
    assert {r.id for r in again.search("abc", ["2001"]).collect()} == {r.id for r in index.search("abc", ["2001"]).collect()}


def test_postings_hold_the_trigrams_of_code_points_alone(spark, folder):
    texts = {1: "a🙂b🙃", 2: "b🙃a🙂b", 3: "xy", 4: "", 5: "a🙂b a🙂b"}
    papers = [(i, "2001-01-01", t, "", 0) for i, t in texts.items()]
    write_search_index(spark.createDataFrame(papers, "id long, published string, title string, source string, importance long"), f"{folder}/i")
    rows = SearchIndex(spark, f"{folder}/i")._table("postings", None).collect()
    want = {}
    for i, t in texts.items():
        for g in {t[k : k + 3] for k in range(len(t) - 2)}:
            want.setdefault(g, []).append(i)
    assert {(r.year, r.block, r.gram): r.ids for r in rows} == {("2001", 0, g): sorted(ids) for g, ids in want.items()} and len(rows) == len(want)


def test_terms_of_all_lengths_are_looked_for_in_one_scan(spark):
    """Places are met by hashes, not as strings of as many characters as the longest term has; texts that hold the mark of hits are walked as well."""
    texts = [(1, "abc abcdef abcdefghi ünder 𝒳𝒳𝒳 xyz"), (2, f"ABCDEF{substrings.MARK}xyzabc"), (3, ""), (4, None)]
    df = spark.createDataFrame(texts, "id long, t string")
    glossary = spark.createDataFrame([(w, f"<{w[:2]}{i}>") for i, w in enumerate(["abc", "abcdef", "abcdefghi", "ünder", "𝒳𝒳𝒳", "xy"] + [f"other{n}" for n in range(120)])], "source string, target string")
    terms = glossary.select(F.col("source").alias("word"))
    found = contained_terms(df.select("id", F.lower("t").alias("hay")), terms)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp_extract_all" not in plan
    assert sorted(map(tuple, found.collect())) == sorted((i, r.word) for i, t in texts if t for r in terms.collect() if r.word in t.lower())
    got = {r.id: r.g for r in apply_glossary_table(df, glossary, "t", "g").collect()}
    assert got == {1: "<ab0> <ab1> <ab2> <ün3> <𝒳𝒳4> <xy5>z", 2: f"<ab1>{substrings.MARK}<xy5>z<ab0>", 3: "", 4: None}
