"""Operators on small inputs: merges against a sequential model, sources on literal documents, streams against batch twins."""

import base64
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import classify, joins, merge, stats
from corpusloom.plans import queries as plans
from corpusloom.plans.adapters import AS_OF, ops_e, papers_o
from corpusloom.plans.dictionary import TOPICS
from corpusloom.sources import feeds, html_pages, sinks
from corpusloom.streaming import user_state

from .conftest import DATA

PAPER = "id string, seq long, title string, source_type string, doi string, abstract string, published string, importance long, categories array<string>, tags array<string>, last_seen string"


def sequential_merge(existing, incoming):
    """The merge as a loop over rows."""
    key = lambda t: "".join(c for c in (t or "").casefold() if c.isalnum())
    merged, index = {}, {}
    for r in existing:
        merged[r["id"]] = dict(r)
    for r in existing:
        if key(r["title"]):
            index[key(r["title"])] = r["id"]
    for r in incoming:
        k = key(r["title"])
        target = (index.get(k) if k else None) or r["id"]
        if target in merged:
            old = merged[target]
            front, back = (r, old) if r["source_type"] == "journal" or old["source_type"] != "journal" else (old, r)
            new = {c: front[c] if front[c] is not None else back[c] for c in r}
            new["id"] = target
            new["doi"] = old["doi"] or r["doi"]
            new["abstract"] = r["abstract"] or old["abstract"]
            new["last_seen"] = r["last_seen"] or old["last_seen"]
            new["importance"] = max(old["importance"], r["importance"])
            new["categories"] = list(dict.fromkeys(old["categories"] + r["categories"]))[:4]
            new["tags"] = list(dict.fromkeys(old["tags"] + r["tags"]))[:10]
            merged[target] = new
        else:
            merged[target] = dict(r)
        if k:
            index[k] = target
    return merged


@pytest.mark.parametrize("seed", range(3))
def test_merge_matches_a_sequential_model(spark, seed):
    rnd = random.Random(seed)

    def row(i):
        return {
            "id": f"p{rnd.randint(0, 12)}",
            "seq": i,
            "title": rnd.choice(["One", "two!", "TWO", "Three", "!!!", "---", "Four"]),
            "source_type": rnd.choice(["journal", "preprint", ""]),
            "doi": rnd.choice(["", "10.1/a", "10.1/b"]),
            "abstract": rnd.choice(["", "text", "other"]),
            "published": rnd.choice(["2024-01-01", "2024-02-01", None]),
            "importance": rnd.randint(0, 100),
            "categories": rnd.sample("abcdef", rnd.randint(0, 3)),
            "tags": rnd.sample("uvwxyz", rnd.randint(0, 3)),
            "last_seen": rnd.choice(["", "d1", "d2"]),
        }

    old, new = [row(i) for i in range(15)], [row(i) for i in range(15, 45)]
    want = sequential_merge(old, new)
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], PAPER)
    got = {r["id"]: r.asDict() for r in merge.merge_records(frame(old), frame(new)).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for c in ("doi", "abstract", "importance", "categories", "tags", "last_seen", "title", "published"):
            assert (got[k][c] or None) == (w[c] or None), (k, c)


def test_merging_the_same_batch_again_changes_nothing(spark):
    p = papers_o(spark, DATA).drop("url", "authors", "source_short").limit(300)
    once = merge.merge_records(p.where("seq % 2 = 0"), p.where("seq % 2 = 1"))
    again = merge.merge_records(once, p.where("seq % 2 = 1"))
    assert sorted(map(str, once.drop("seq").collect())) == sorted(map(str, again.drop("seq").collect()))


def test_years_are_the_sums_of_their_months(spark):
    y = stats.year_stats(papers_o(spark, DATA, arrays=False)).collect()
    months = {r["year"]: 0 for r in y if r["level"] == 1}
    for r in y:
        if r["level"] == 0:
            months[r["year"]] += r["count"]
    assert months == {r["year"]: r["count"] for r in y if r["level"] == 1}
    assert sum(months.values()) == next(r["count"] for r in y if r["level"] == 3)


def test_terms_need_boundaries(spark):
    hit = lambda t, term: spark.createDataFrame([(t,)], "t string").select(classify.term_hit(F.lower("t"), term)).first()[0]
    assert not hit("a significant step", "NIF") and hit("at NIF", "NIF") and hit("B(E2) values", "b(e2)") and hit("beta \n decay", "beta decay") and not hit("beta-decay", "beta decay")


PHYSICS = classify.Topics(
    topics=(
        classify.Topic("fusion", "Fusion", ("tokamak", "stellarator", "ITER", "nuclear fusion"), 20),
        classify.Topic("decay", "Decay", ("half-life", "branching ratio", "branching fraction", "beta-delayed", "decay spectroscopy"), 25),
        classify.Topic("structure", "Structure", ("level scheme", "quadrupole moment", "gamma spectroscopy", "shell"), 30),
        classify.Topic("ai", "AI", ("machine learning", "artificial-intelligence", "machine"), 5),
        classify.Topic("detectors", "Detectors", ("silicon detector", "data acquisition"), 15),
        classify.Topic("experiment", "Experiment", ("measured at",), 28),
        classify.Topic("general", "General", ("nucleus",), 1),
    ),
    priority_terms=("first observation", "upper limit"),
    strong_gate=("neutron-rich",),
    physics_gate=("physics", "quantum"),
    ai_gate=("plasma", "detector"),
    ai_methods=("machine learning", "deep learning"),
    gates={
        "decay": classify.Gate(strong=("beta-delayed",), context=("isotope", "nuclei", "spectroscopy"), core_sources=("physical review c",), excluded=("meson", "lepton")),
        "structure": classify.Gate(strong=("level scheme",), context=("isotope", "nuclei"), excluded=("galaxy", "dark matter")),
    },
    general="general",
    source_fallbacks=((("physical review c",), "general"),),
)


def test_classification_of_physics_records(spark):
    rows = [
        ("ai", "Machine learning in a silicon detector", "An artificial-intelligence workflow for data acquisition.", "x", None),
        ("fusion", "Neutron diagnostics for ITER plasmas", "Nuclear\n fusion performance", "x", None),
        ("decay", "Beta-delayed neutron emission", "The half-life is given.", "x", None),
        ("prior", "A generic study of a nucleus", "", "Physical Review C", ["general"]),
        ("default", "Level scheme of an isotope", "Gamma spectroscopy reveals shell evolution.", "arXiv nucl-ex", ["experiment"]),
        ("meson", "Lepton-flavor violating meson decays", "An upper limit on the branching fraction is measured at LHCb.", "Physical Review Letters", None),
        ("galaxy", "Galaxy clustering quadrupole moment", "Isotope-free dark matter", "Monthly Notices", None),
        ("none", "Traffic", "", "Physical Review C", None),
        ("shell", "eggshells and machines", None, None, None),
    ]
    r = spark.createDataFrame(rows, "id string, title string, abstract string, source string, default_categories array<string>").withColumn("weight", F.lit(5))
    got = {x["id"]: x for x in classify.reclassify(r, PHYSICS).collect()}
    cats = {k: x["categories"] for k, x in got.items()}
    assert set(cats["ai"]) == {"ai", "detectors"} and got["ai"]["tags"] == ["machine learning", "artificial-intelligence", "machine", "silicon detector", "data acquisition"]
    assert cats["fusion"] == ["fusion"] and got["fusion"]["tags"] == ["ITER", "nuclear fusion"] and cats["decay"] == ["decay"]
    assert cats["prior"] == ["general"] and "experiment" not in cats["prior"] and got["prior"]["classification_confidence"] == 0.56
    assert cats["default"] == ["structure", "experiment"] and got["default"]["methods"] == ["experimental"]
    assert cats["meson"] == ["experiment"] and cats["galaxy"] == ["frontiers"] and cats["none"] == ["general"] and cats["shell"] == ["frontiers"]
    assert got["meson"]["importance"] == 40 + 28 + 8 + 2 and any(x.startswith("突破性表述") for x in got["meson"]["score_reasons"])


def test_terms_by_one_pattern_equal_terms_one_by_one(spark):
    rnd = random.Random(8)
    parts = ["a", "ab", "abc", "b c", "b", "bc", "a-b", "a b c", "c", "(x", "é", "x y", "x"]
    terms = sorted({rnd.choice(["", "a ", "b-"]) + p for p in parts for _ in range(2)})
    texts = ["".join(rnd.choice([*parts, " ", "  ", "-", ".", "\n"]) for _ in range(rnd.randint(0, 14))) for _ in range(300)]
    low = F.lower("t")
    one = F.array_compact(F.array(*[F.when(classify.term_hit(low, t), F.lit(t)) for t in terms]))
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", one.alias("a"), classify.term_hits(low, terms).alias("b")).collect():
        assert r["a"] == r["b"], r["t"]


def test_relevance_by_mode(spark):
    rows = [("Urban traffic", "Road networks", "filtered", False), ("Neutron-rich nuclei", "", "filtered", True), ("First observation of cancer", "in cells", "filtered", False), ("First observation", "A quantum phase", "filtered", True), ("Deep learning for advertising", "", "important-ai", False), ("Machine learning for plasma", "", "important-ai", True), ("Anything", None, "all", True)]
    got = spark.createDataFrame(rows, "t string, a string, m string, want boolean").select("t", "want", classify.relevant(F.col("t"), F.col("a"), F.col("m"), PHYSICS).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_notice_relevance_and_labels(spark):
    rows = [("理论物理专款项目指南", "", "", True), ("癌症防治项目的通知", "", "", False), ("Call for proposals", "", "beam", True), ("Call for proposals", "nuclear medicine", "beam", False), ("Medicine days", "", "beam", False), ("Physics medicine", "", "beam", False), ("物理 call", "nuclear medicine", "beam", True), ("项目指南", "", "", False)]
    c = classify.notice_relevant(F.col("t"), F.col("s"), F.lit(""), F.col("c"), ("癌症", "medicine"), ("物理",), ("beam",), ("society",))
    assert all(r["want"] == r["got"] for r in spark.createDataFrame(rows, "t string, s string, c string, want boolean").select("*", c.alias("got")).collect())
    rules = (("Society", ("核学会", "nuclear society")), ("Series", ("NED20",)))
    said = spark.createDataFrame([("第二十三届年会（NED2026）中国核学会主办",), ("School for young scientists",)], "t string").select(classify.notice_labels(F.col("t"), rules).alias("l")).collect()
    assert [r["l"] for r in said] == [["Society", "Series"], []]


def test_many_terms_equal_few(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
    hay = spark.createDataFrame([(i, " ".join(word() for _ in range(8))) for i in range(50)], "id long, hay string")
    terms = spark.createDataFrame([(w,) for w in {word() for _ in range(60)}], "word string")
    few, many = (sorted(map(tuple, joins.contained_terms(hay, terms, few=n).collect())) for n in (100, 10))
    assert few and few == many


def test_related_items_in_blocks(spark, monkeypatch):
    rnd = random.Random(6)
    pick = lambda n, k: rnd.sample([f"v{i}" for i in range(n)], rnd.randint(0, k))
    rows = [(i, rnd.choice(["2020-01-01", "2020-01-02", None]), rnd.choice(["s", "t", None]), pick(5, 3), [x.upper() for x in pick(9, 3)], [*pick(40, 4), None]) for i in range(120)]
    r = spark.createDataFrame(rows, "id long, published string, source string, categories array<string>, tags array<string>, authors array<string>")
    want = set()
    for a in rows[:30]:
        scored = []
        for b in rows:
            n = sum(w * len(set(x) & set(y) - {None}) for w, x, y in zip((5, 3, 4, 1), (a[3], a[4], a[5], [a[2]]), (b[3], b[4], b[5], [b[2]])))
            if n and b[0] != a[0]:
                scored.append((n, b[1] or "", b[0]))
        scored.sort(key=lambda s: s[2])
        scored.sort(key=lambda s: s[:2], reverse=True)
        want |= {(a[0], k + 1, s[2], s[0]) for k, s in enumerate(scored[:6])}
    monkeypatch.setattr(joins, "ROWS", 16)
    monkeypatch.setattr(joins, "COMMON", 4)
    monkeypatch.setattr(joins, "AT_ONCE", 11)
    for anchors in (8192, 7):
        monkeypatch.setattr(joins, "ANCHORS", anchors)
        assert {tuple(x) for x in joins.related_items(r.where("id < 30"), r).collect()} == want


def test_related_items_of_copies(spark, monkeypatch, tmp_path):
    """Thirty copies of each record meet no anchor more often than seven do, in all tiles together, and the results are those of all pairs."""
    rnd = random.Random(8)
    pick = lambda c, n, k: sorted(rnd.sample([f"{c}{i}" for i in range(n)], rnd.randint(1, k)))
    kinds = [(rnd.choice("st"), pick("c", 6, 3), pick("t", 6, 3), pick("a", 25, 2)) for _ in range(40)]
    rows = [(i, rnd.choice(["2020-01-01", "2020-01-02", None]), *kinds[i % 40]) for i in range(1200)]
    r = spark.createDataFrame([*rows, (None, "2021-01-01", *kinds[0])], "id long, published string, source string, categories array<string>, tags array<string>, authors array<string>")
    want = set()
    for a in rows[::50]:
        scored = [(sum(w * len(set(x) & set(y)) for w, x, y in zip((1, 5, 3, 4), ([a[2]], *a[3:]), ([b[2]], *b[3:]))), b[1] or "", -b[0]) for b in rows if b[0] != a[0]]
        want |= {(a[0], n + 1, -s[2], s[0]) for n, s in enumerate(sorted(scored, reverse=True)[:6]) if s[0]}
    plain, met = joins._tile, str(tmp_path)

    def counted(*given):
        run = plain(*given)

        def counts(anchors, records):
            with open(f"{met}/{anchors.num_rows}-{records.num_rows}-{id(anchors)}-{random.random()}", "w"):
                return run(anchors, records)

        return counts

    monkeypatch.setattr(joins, "_tile", counted)
    monkeypatch.setattr(joins, "ROWS", 64)
    monkeypatch.setattr(joins, "LEAST", 8)
    assert {tuple(x) for x in joins.related_items(r.where("id % 50 = 0"), r).collect()} == want
    pairs = [int(a) * int(b) for a, b in (f.name.split("-")[:2] for f in tmp_path.iterdir())]
    assert len(pairs) > 4 and 0 < sum(pairs) <= len(rows[::50]) * 40 * 7


def test_best_window_after_a_title(spark):
    text = "Menu Call one | skip Call ONE Search the site downloads. call one The deadline to be submitted is near. Call one later deadline"
    got = spark.createDataFrame([("Call one", text), ("", text), (None, text), ("absent", text), ("a\\E(b", "x a\\E(b y")], "t string, v string").select(html_pages.best_window(F.col("t"), F.col("v"), 60).alias("w")).collect()
    assert [r["w"] for r in got][:4] == [" The deadline to be submitted is near. Call one later deadline"[:60].strip(), "", "", ""]


def test_feeds(spark):
    rss = "<rss><channel><item><title>A\x02 b</title><description>&lt;p&gt;x <i>y</i>&lt;/p&gt;</description><link>https://e.org/1</link><pubDate>Mon, 01 Jun 2026 10:00:00 GMT</pubDate></item><item><title>no link</title></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>C</title><link rel="self" href="https://e.org/s"/><link href="https://arxiv.org/abs/2401.1"/><summary>der text</summary><author><name>X, Y and Z</name></author></entry></feed>'
    items = feeds.feed_items(spark.createDataFrame([("r", rss), ("a", atom), ("bad", "<x"), ("none", None)], "source string, xml string"))
    rows = {r["source"]: r for r in items.collect()}
    assert set(rows) == {"r", "a"} and rows["r"]["title"] == "A b" and rows["r"]["summary"] == "x y" and rows["a"]["url"] == "https://arxiv.org/abs/2401.1"
    s = spark.createDataFrame([("a", "nucl-th", "all", 5, ["german"], 1)], "source string, category string, mode string, weight int, default_categories array<string>, limit int")
    paper = feeds.papers_from_arxiv(items, s, TOPICS).first()
    assert paper["arxiv_id"] == "2401.1" and paper["authors"] == ["X", "Y", "Z"] and "german" in paper["categories"]
    news = feeds.news_from_feed(items.where("source = 'r'"), s.withColumn("source", F.lit("r")), TOPICS, exempt=("r",)).collect()
    assert [n["published"] for n in news] == ["2026-06-01"]


def test_crossref(spark):
    work = {"DOI": "10.1/A", "title": ["Der <i>Titel</i>"], "abstract": "<p>und</p>", "author": [{"given": "Jane", "family": "Doe"}, {"family": "Roe"}], "published": {"date-parts": [[2024, 3]]}, "published-online": {"date-parts": [[2024]]}, "page": "3-7", "license": [{"URL": "u"}, {}]}
    raw = spark.read.schema(feeds.CROSSREF).json(spark.sparkContext.parallelize([json.dumps({"source": "j", "message": {"items": [work, {"title": []}]}})]))
    s = spark.createDataFrame([("j", "J", "all", 5, None)], "source string, short string, mode string, weight int, default_categories array<string>")
    p = feeds.papers_from_crossref(raw, s, TOPICS).collect()
    assert len(p) == 1
    p = p[0]
    assert (p["title"], p["abstract"], p["authors"], p["citation_authors"], p["published"], p["numpages"], p["publisher_licenses"]) == ("Der Titel", "und", ["Jane Doe", "Roe"], ["Doe, Jane", "Roe"], "2024-01-01", "5", ["u"])
    assert p["url"] == "https://doi.org/10.1/A" and p["score_reasons"]


def test_events(spark):
    event = lambda i, title, **k: {"id": str(i), "title": title, "description": "<p>About <script>no</script>beams</p>", "startDate": {"date": f"2026-0{i}-01"}, **k}
    raw = spark.createDataFrame([("s", json.dumps({"results": [event(1, "Physics one"), event(2, "Physics two", creationDate={"date": "2025-01-01"}), event(3, "Chess"), event(4, "Physics one", url="https://x.org/event/1/")]}))], "source string, json string")
    s = spark.createDataFrame([("s", "https://x.org", ["Physics"], ["two x"], False, 2)], "source string, base string, include array<string>, exclude array<string>, match_description boolean, limit int")
    rows = feeds.notices_from_events(raw, s).collect()
    assert [(r["url"], r["published"], r["content"]) for r in sorted(rows, key=lambda r: r["event_start"])] == [("https://x.org/event/1/", "2026-01-01", "About beams"), ("https://x.org/event/2/", "2025-01-01", "About beams")]


def test_events_are_read_by_one_worker(spark):
    """However many texts are cleaned and whatever filters use them, a task has one call of Python; texts come out as the scalar functions give them."""
    titles = ["Caf\u00e9 &amp; <b>beams</b>", "\uff22\uff25\uff21\uff2d\uff33\u2003\u00a0x", "a \u00a8 BEAMS \x85 b", "none", None, "", "Beams &lt;i&gt; &copy 1"]
    places = [("R&amp;D", None, " <i>x</i> "), (None, None, None), ("a", "b", "c"), ("", "", "")]
    events = [{"id": str(i), "title": t, "description": f"<p>About {d}</p>", "organizer": f" O\u2028{t} ", **dict(zip(("location", "room", "address"), places[i % 4])), "startDate": {"date": "2026-01-01"}} for i, (t, d) in enumerate((t, d) for t in titles for d in ("&amp;amp; beams", "<script>beams</script>none"))]
    raw = spark.createDataFrame([(s, json.dumps({"results": events})) for s in ("s", "t", "u")], "source string, json string")
    s = spark.createDataFrame([("s", "https://x.org", ["BEAMS"], ["none"], True, None), ("t", "https://x.org", ["beams"], None, False, None), ("u", "https://x.org", None, None, None, None)], "source string, base string, include array<string>, exclude array<string>, match_description boolean, limit int")
    notices = feeds.notices_from_events(raw, s)
    assert notices._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1
    flat = spark.createDataFrame([(int(e["id"]), e["title"], e["description"], e["organizer"], e["location"], e["room"], e["address"]) for e in events], "id int, title string, description string, organizer string, location string, room string, address string")
    title, content = text.clean_text(F.col("title")), feeds.fragment_text("description")
    want = {r["id"]: r for r in flat.select("id", title.alias("t"), content.alias("c"), text.nfkc_lower(title).alias("n"), text.nfkc_lower(F.concat_ws(" ", title, content)).alias("b"), text.clean_text(F.col("organizer")).alias("o"), text.clean_text(F.concat_ws(" ", "location", "room", "address")).alias("l")).collect()}
    held = {"s": lambda r: "beams" in r["b"] and "none" not in r["t"].lower(), "t": lambda r: "beams" in r["n"], "u": lambda r: True}
    got = {(r["source"], r["url"], r["title"], r["content"], r["organizer"], r["location"]) for r in notices.collect()}
    assert got == {(k, f"https://x.org/event/{i}/", r["t"], r["c"], r["o"], r["l"]) for k, f in held.items() for i, r in want.items() if r["t"] and f(r)} and len(got) > 12


def test_citation_exports(spark):
    body = "A measured spectrum of neutron rich nuclei is reported in this work"
    texts = [("bib", f"@article{{x, abstract = {{{body} {{A}}}}, }}"), ("ris", f"TY  - JOUR\r\nAB  - {body}\r\n more\r\nER  - "), ("end", f"%T x\n%X {body}"), ("xml", f"<a><abstract><p>{body}</p></abstract></a>"), ("none", None), ("short", "AB  - no")]
    got = {r["id"]: r["abstract"] for r in feeds.citation_export_abstracts(spark.createDataFrame([(i, "T", t) for i, t in texts], "id string, title string, text string")).collect()}
    assert got == {"bib": body + " {A}", "ris": body + " more", "end": body, "xml": body}


def test_inverted_index(spark):
    x = spark.createDataFrame([({"detector": [2], "A": [0], "nuclear": [1], "works.": [3], "late": [100001]},)], "m map<string,array<int>>")
    assert x.select(feeds.abstract_from_inverted_index(F.col("m"))).first()[0] == "A nuclear detector works."


def test_pages(spark):
    caption = "<figcaption>Measured result</figcaption>"
    html = f"""<html><head><meta name="citation_doi" content="doi:10.1/X"><meta name="description" content="short"><meta property="citation_abstract" content="{'An abstract of some length. ' * 4}"></head>
    <body><h1>The <b>title</b></h1><script>var a="<h2>no</h2>"</script><p>Seen &amp; read</p><a href="/c.ris">Download citation</a><a href="https://evil.org/x.bib">cite</a><a href="/r?flavour=references">citation</a>
    <figure><img src="data:x"><img src="f1.png">{caption}</figure><figure><img src="f2.png"><figcaption>Courtesy of X</figcaption></figure></body></html>"""
    pages = spark.createDataFrame([(1, "https://arxiv.org/html/1/", html), (2, None, None), (3, "x", "<a href='y'>broken")], "page_id long, url string, html string")
    links = html_pages.html_links(pages).collect()
    assert [(r["page_id"], r["url"]) for r in links][:1] == [(1, "https://arxiv.org/c.ris")]
    meta = {r["page_id"]: r for r in html_pages.html_page_metadata(pages).collect()}
    assert meta[1]["headings"] == ["The title"] and "no" not in meta[1]["visible"].split() and meta[2]["visible"] == ""
    assert {r["page_id"]: r["links"] for r in html_pages.citation_links(pages).collect()}[1] == ["https://arxiv.org/c.ris"]
    papers = spark.createDataFrame([("a", "10.1/x", "Title", 1, "https://creativecommons.org/licenses/by/4.0/"), ("b", "10.1/other", "Title", 1, "")], "id string, doi string, title string, page_id long, license string")
    assert [r["id"] for r in html_pages.publisher_abstracts(papers, html_pages.scholarly_meta(pages)).collect()] == ["a"]
    figures = html_pages.figure_candidates(papers, pages).collect()
    assert [(r["id"], r["url"], r["score"]) for r in figures] == [("a", "https://arxiv.org/html/1/f1.png", 26)]


def test_snapshots(spark):
    def body(payload, encoding):
        raw = json.dumps(payload).encode()
        raw = gzip.compress(raw) if encoding.startswith("gzip") else raw
        return f"text <!-- v1 -->\n<!-- x-encoding:{encoding} -->\n```text\n{base64.b64encode(raw).decode()}\n```"

    good = {"personal": {"notes": {"a": "n"}, "unknown": 1}, "evil": 2}
    rows = [(1, "Owner", "sync: 1", body({}, "base64")), (2, "OWNER", "sync: 2", body(good, "gzip-base64")), (3, "other", "sync: 3", body({}, "base64")), (4, "owner", "sync: 4", "<!-- v1 --> nothing"), (5, "owner", "sync", "<!-- v1 --> <!-- x-encoding:base64 --> ```text !!! ```")]
    got = feeds.state_from_issues(spark.createDataFrame(rows, "seq long, login string, title string, body string").where("login != 'Owner'"), "owner", "sync", "<!-- v1 -->").collect()
    assert [r["state"]["personal"]["notes"] for r in got] == [{"a": "n"}]


def test_translations(spark):
    raw = spark.createDataFrame([('{"items": {"a": {"title_zh": "标题"}}}',)], "json string")
    assert [tuple(r) for r in feeds.translations_table(raw).collect()] == [("a", "标题", None)]


def test_shards_are_overwritten_month_by_month(spark, folder):
    p = papers_o(spark, DATA)
    sinks.write_month_shards(p, f"{folder}/s")
    n = spark.read.parquet(f"{folder}/s").count()
    sinks.write_month_shards(p.where("published like '1996-02%'").limit(1), f"{folder}/s")
    back = spark.read.parquet(f"{folder}/s")
    assert back.where("year = 1996 and month = 2").count() == 1 and back.count() == n - p.where("published like '1996-02%'").count() + 1
    sinks.build_search_index(p, f"{folder}/i")
    assert spark.read.parquet(f"{folder}/i").count() == p.count()


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_depend_on_the_partitions(spark, partitions):
    p = papers_o(spark, DATA)
    one = stats.month_stats(p.repartition(partitions)).collect()
    assert sorted(map(str, one)) == sorted(map(str, stats.month_stats(p).collect()))


def _stream(spark, df, path):
    df.repartition(4).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_folded_stream_equals_batch(spark, folder):
    ops = ops_e(spark, DATA).limit(800)
    source = user_state.fold_user_ops_stream(_stream(spark, ops, f"{folder}/ops"))
    q = source.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("append").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = user_state.settled(spark.read.parquet(f"{folder}/out"))
    want = user_state.fold_user_ops(ops)
    cols = ["user", "type", "item_id", "active", "text", "keywords", "seq"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_incremental_ingest_equals_batch(spark, folder):
    e = spark.read.parquet(f"{DATA}/events.parquet").select((F.col("user_id") % 40).alias("id"), "ts")
    empty = user_state.sightings(e.where("false"))
    state = {"now": empty}

    def write(df, n):
        df.write.mode("overwrite").parquet(f"{folder}/cat{n}")
        state["now"] = spark.read.parquet(f"{folder}/cat{n}")

    q = user_state.ingest_incremental(_stream(spark, e, f"{folder}/e"), lambda: state["now"], write).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, state["now"].collect())) == sorted(map(str, user_state.sightings(e).collect()))


def test_daily_counts_stream(spark, folder):
    e = spark.read.parquet(f"{DATA}/events.parquet").select("ts")
    s = user_state.daily_counts(_stream(spark, e, f"{folder}/e"), "400 days")
    q = s.writeStream.outputMode("update").foreachBatch(lambda b, i: b.withColumn("i", F.lit(i)).write.mode("append").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{folder}/out").groupBy("day").agg(F.max_by("n", "i").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, user_state.daily_counts(e).collect()))


def test_reconcile_merges_legacy_drafts(spark):
    schema = "user long, updated_at string, legacy boolean, favorites map<string,string>, notes map<string,string>, keywords array<string>"
    remote = spark.createDataFrame([(1, "2026-01-01T00:00:00Z", False, {"a": "r", "b": "r"}, {}, ["X"]), (2, "2026-01-02T00:00:00Z", False, {}, {}, ["R"])], schema)
    local = spark.createDataFrame([(1, "", True, {"a": "l"}, {"n": "l"}, ["x", "Y"]), (2, "2026-01-03T00:00:00Z", False, {}, {}, ["L"])], schema)
    got = {r["user"]: r for r in user_state.reconcile_state(remote, local).collect()}
    assert got[1]["favorites"] == {"a": "l", "b": "r"} and got[1]["keywords"] == ["X", "Y"] and got[1]["from"] == "merged"
    assert got[2]["keywords"] == ["L"] and got[2]["from"] == "local"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert AS_OF and len(plans.QUERIES) > 80
