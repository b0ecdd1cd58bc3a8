"""Sources, sinks and snapshots as queries: feeds, exports and pages are built of the given rows, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations
from ..operators import filters, joins, ranking
from ..sources import feeds, html_pages, sinks
from ..streaming import user_state
from .adapters import NOTICES_O, OPS_E, PAPERS_D, PAPERS_O, PRIORITIES, notices_o, ops_e, papers_d, papers_o, read, scratch
from .dictionary import TOPICS
from .queries import C, _sql_count, _sql_unescape, query

_SOURCES = [(f"src{i}", f"S{i}", "filtered" if i % 3 == 1 else "all") for i in range(50)]
_CLEAN = rf"trim(regexp_replace({_sql_unescape("regexp_replace(text, '<[^>]+>', ' ', 'g')")}, '[\s\p{{Z}}]+', ' ', 'g'))"
_GATE = f"({_sql_count('t', TOPICS.strong_gate)} > 0 or ({_sql_count('t', TOPICS.priority_terms)} > 0 and {_sql_count('t', TOPICS.physics_gate)} > 0))"
_FILTERED = "cast(substr(source, 4) as integer) % 3 = 1"


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _sources(spark, **more):
    s = spark.createDataFrame(_SOURCES, "source string, short string, mode string").withColumns({"weight": F.lit(4), "default_categories": F.lit(None).cast("array<string>")})
    return s.withColumns({k: F.lit(v) for k, v in more.items()})


@query(f"""
with x as (select doc_id, source, 'Paper ' || doc_id || ' ' || lang title, {_CLEAN} abstract, case when doc_id % 5 = 0 then '' else '10.3/' || doc_id end doi,
  case when doc_id % 2 = 0 then '2020-' || lpad(cast(doc_id % 12 + 1 as varchar), 2, '0') || '-' || lpad(cast(doc_id % 28 + 1 as varchar), 2, '0') else '2019-01-01' end published, lang from documents),
y as (select *, lower(title || ' ' || abstract) t from x)
select substr(sha1(case when doi <> '' then 'doi|' || doi else lower(title) || '|' || published || '|s' || substr(source, 4) end), 1, 16) id, title, abstract, 'Ann ' || lang || ';Roe' authors, lang || ', Ann;Roe' citation_authors, published, doi,
  case when doi = '' then '' else 'https://doi.org/' || doi end url, 'https://e.org/by' licenses, cast(doc_id % 9 + 1 as varchar) numpages, case when abstract = '' then 'missing' else 'full' end abstract_status
from y where not ({_FILTERED}) or {_GATE}
""")
def s1_crossref_papers(spark, d):
    i = C("doc_id")
    day = lambda *p: F.struct(F.array(F.array(*p)).alias("date-parts"))
    work = F.struct(
        F.when(i % 5 != 0, _text("10.3/", i)).alias("DOI"),
        F.array(_text("<b>Paper</b> ", i, " ", C("lang"))).alias("title"),
        _text("<p>", C("text"), "</p>").alias("abstract"),
        F.array(F.struct(F.lit("Ann").alias("given"), C("lang").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("Roe").alias("family"))).alias("author"),
        F.when(i % 2 == 0, day(F.lit(2020), (i % 12 + 1).cast("int"), (i % 28 + 1).cast("int"))).alias("published-online"),
        day(F.lit(2019)).alias("published-print"),
        _text("100-", 100 + i % 9).alias("page"),
        F.array(F.struct(F.lit("https://e.org/by").alias("URL")), F.struct(F.lit("").alias("URL"))).alias("license"),
    )
    raw = read(spark, d, "documents").select(F.to_json(F.struct("source", F.struct(F.array(work).alias("items")).alias("message"))).alias("j"))
    p = feeds.papers_from_crossref(raw.select(F.from_json("j", feeds.CROSSREF).alias("r")).select("r.*"), _sources(spark), TOPICS)
    return p.select("id", "title", "abstract", F.array_join("authors", ";").alias("authors"), F.array_join("citation_authors", ";").alias("citation_authors"), "published", "doi", "url", F.array_join("publisher_licenses", ";").alias("licenses"), "numpages", "abstract_status")


@query(rf"""
select cast(doc_id as varchar) source, 0 pos, 'Doc ' || doc_id title, {_CLEAN} summary, '2020-01-01' published, lang creator, 'https://e.org/' || doc_id url from documents
union all select cast(doc_id as varchar), 1, 'Second', '', '', '', 'guid-' || doc_id from documents
""")
def s2_feed_items(spark, d):
    i = C("doc_id")
    escaped = F.replace(F.replace(F.replace(C("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    first = _text("<item><title>Doc <i>", i, "</i></title><description>", escaped, "</description><link rel='self' href='no'/><link>https://e.org/", i, "</link><pubDate>2020-01-01</pubDate><author><name>", C("lang"), "</name></author></item>")
    xml = _text("<rss\x01><channel>", first, "<item><title>Second</title><guid>guid-", i, "</guid></item><item><link>https://no.title/</link></item></channel></rss>")
    return feeds.feed_items(read(spark, d, "documents").select(i.cast("string").alias("source"), xml.alias("xml"))).drop("rights")


@query(f"""
with x as (select doc_id, source, 'Title ' || doc_id title, {_CLEAN} abstract, lang from documents), y as (select *, lower(title || ' ' || abstract) t from x)
select substr(sha1('arxiv|2001.' || doc_id), 1, 16) id, '2001.' || doc_id arxiv_id, title, lang || ';Y;Z' authors, 'https://arxiv.org/pdf/2001.' || doc_id pdf_url, '2020-02-03' published, case when doc_id % 2 = 0 then 'reusable' else 'source_restricted' end rights_status from y
where not ({_FILTERED}) or {_GATE}
""")
def s3_arxiv_papers(spark, d):
    i = C("doc_id")
    rights = F.when(i % 2 == 0, "http://creativecommons.org/licenses/by/4.0/").otherwise("http://arxiv.org/licenses/nonexclusive-distrib/1.0/")
    items = read(spark, d, "documents").select(
        "source", i.cast("int").alias("pos"), _text("Title ", i).alias("title"), _text("arXiv:2001.", i, "v1 Announce Type: new Abstract: ", C("text")).alias("summary"), F.lit("Mon, 3 Feb 2020 00:00:00 GMT").alias("published"),
        _text(C("lang"), ", Y and Z").alias("creator"), _text("https://arxiv.org/abs/2001.", i).alias("url"), rights.alias("rights"),
    )
    p = feeds.papers_from_arxiv(items, _sources(spark, category="nucl-th", limit=6), TOPICS)
    return p.select("id", "arxiv_id", "title", F.array_join("authors", ";").alias("authors"), "pdf_url", "published", "rights_status")


@query(f"""
with x as (select doc_id, source, lower('News ' || doc_id || ' ' || text) t from documents where doc_id % 100 < 80)
select substr(sha1('news|https://n.org/' || doc_id), 1, 16) id, 'News ' || doc_id title, '2020-05-06' published from x where source = 'src0' or {_GATE}
""")
def s4_news(spark, d):
    i = C("doc_id")
    none = F.lit("")
    items = read(spark, d, "documents").select("source", (i % 100).cast("int").alias("pos"), _text("News ", i).alias("title"), C("text").alias("summary"), F.lit("2020/5/6").alias("published"), none.alias("creator"), _text("https://n.org/", i).alias("url"), none.alias("rights"))
    return feeds.news_from_feed(items, _sources(spark).drop("short", "mode"), TOPICS, exempt=("src0",)).select("id", "title", "published")


@query("""
with x as (select doc_id, source, case when doc_id % 3 = 0 then 'https://x.org/e/' || doc_id else 'https://x.org/event/' || doc_id || '/' end url, cast(date '2001-01-01' + cast(doc_id as integer) as varchar) event_start,
  'Meeting ' || doc_id || ' ' || lang title, 'About ' || lang content from documents where lang <> 'fr' and not contains('meeting ' || doc_id || ' ' || lang, '13'))
select source, url, title, content, event_start, event_start published from x qualify row_number() over (partition by source order by event_start desc) <= 40
""")
def s5_events(spark, d):
    i = C("doc_id")
    day = F.struct(F.date_add(F.to_date(F.lit("2001-01-01")), i.cast("int")).cast("string").alias("date"))
    event = F.struct(i.cast("string").alias("id"), _text("Meeting ", i, " <b>", C("lang"), "</b>").alias("title"), _text("<p>About <script>no</script>", C("lang"), "</p>").alias("description"), F.when(i % 3 == 0, _text("https://x.org/e/", i)).alias("url"), day.alias("startDate"))
    raw = read(spark, d, "documents").select("source", F.to_json(F.struct(F.array(event, event).alias("results"))).alias("json"))
    s = _sources(spark, base="https://x.org", match_description=True, limit=40).withColumns({"include": F.array(F.lit("about en"), F.lit("about de"), F.lit("about es")), "exclude": F.array(F.lit("13"))})
    return feeds.notices_from_events(raw, s.drop("short", "mode", "weight", "default_categories")).select("source", "url", "title", "content", "event_start", "published")


@query("""
with x as (select doc_id, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) t, cast(date '2001-01-01' + cast(doc_id % 5000 as integer) as varchar) d from documents where doc_id % 3 > 0)
select doc_id as id, substr(trim(d || ' — ' || d || ' ' || substr(t, 1, 6000)), 1, 900) summary, substr(t, 1, 6000) as content, d as published, d as event_start, 'Event ' || doc_id heading from x
""")
def s9_event_details(spark, d):
    i, docs = C("doc_id"), read(spark, d, "documents")
    notices = docs.select(i.alias("id"), F.when(i % 3 == 0, _text("https://other.org/event/", i)).otherwise(_text("https://Indico.lab.org/event/", i, "/page?x=1")).alias("url"))
    day = F.struct(F.date_add(F.to_date(F.lit("2001-01-01")), (i % 5000).cast("int")).cast("string").alias("date"))
    escaped = F.replace(F.replace(F.replace(C("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    event = F.struct(_text("Event ", i).alias("title"), escaped.alias("description"), day.alias("startDate"), day.alias("endDate"))
    exports = docs.select(_text("https://indico.lab.org/export/event/", i, ".json").alias("url"), F.to_json(F.struct(F.array(event).alias("results"))).alias("json"))
    return feeds.event_details(notices, exports).select("id", "summary", "content", "published", "event_start", "heading")


def _page(*parts):
    return _text("<html><head>", *parts, "</body></html>")


@query("""
select doc_id id, 'An abstract in ' || lang || ' of document ' || doc_id || ', and long enough to be taken for one' abstract from documents where doc_id % 4 in (0, 2)
""")
def s11_publisher_abstracts(spark, d):
    i = C("doc_id")
    said = _text("An abstract in ", C("lang"), " of document ", i, ", and long enough to be taken for one")
    # By DOI: 0 equal, 1 another; without one by title: 2 equal, 3 another.
    doi = F.when(i % 4 == 0, _text("doi:10.5/", i)).when(i % 4 == 1, "10.5/other")
    meta = F.concat_ws("", _text("<meta name='citation_title' content='", F.when(i % 4 == 3, "qqqq").otherwise(_text("Title ", i)), "'>"), F.concat(F.lit("<meta name='citation_doi' content='"), doi, F.lit("'>")))
    x = read(spark, d, "documents").select(i.alias("page_id"), F.lit("https://e.org/").alias("url"), _page(meta, "<meta name='description' content='short'><meta property='dc.description' content='too short as well'><meta name='eprints.abstract' content='", said, "'></head><body>").alias("html"))
    papers = read(spark, d, "documents").select(i.alias("id"), F.when(i % 4 < 2, _text("https://doi.org/10.5/", i)).otherwise("").alias("doi"), _text("Title ", i).alias("title"), i.alias("page_id"))
    return html_pages.publisher_abstracts(papers, html_pages.scholarly_meta(x))


@query("select doc_id id, 'The abstract in ' || lang || ' of document ' || doc_id || ' {is} long enough to be a valid one' abstract from documents")
def s12_citation_exports(spark, d):
    i = C("doc_id")
    said = _text("The abstract in ", C("lang"), " of document ", i, " {is} long enough to be a valid one")
    words = F.split(said, " document ")
    blob = (
        F.when(i % 4 == 0, _text("@article{k,\n title = {T},\n Abstract = {", said, "},\n year = {2020} }"))
        .when(i % 4 == 1, _text("TY  - JOUR\r\nAB  - ", words[0], "\r\n  document ", words[1], "\r\nER  - \r\n"))
        .when(i % 4 == 2, _text("%T T\n%X ", said, "\n%D 2020"))
        .otherwise(_text("<r><title>T</title><abstract><p>", said, "</p></abstract></r>"))
    )
    return feeds.citation_export_abstracts(read(spark, d, "documents").select(i.alias("id"), F.lit("T").alias("title"), blob.alias("text")))


@query("""
select doc_id id, r.rank, 'https://arxiv.org/html/' || doc_id || r.src url, r.caption || ' ' || lang caption, r.score from documents, (values (1, '/f2.png', 'Measured result', 25), (2, '/f1.png', 'Detector setup', 21)) r(rank, src, caption, score) where doc_id % 3 <> 0
""")
def s14_f15_figures(spark, d):
    i = C("doc_id")
    figure = lambda src, said: _text(f"<figure><img src='data:x'><img src='{src}'><figcaption>", said, " ", C("lang"), "</figcaption></figure>")
    html = _page("</head><body>", figure("f1.png", "Detector setup"), figure("f2.png", "Measured result"), figure("f3.png", "Courtesy of"), figure("f4.png", "Theory curve"), "<figure><img src='f5.png'></figure>")
    x = read(spark, d, "documents")
    pages = x.select(i.alias("page_id"), _text("https://arxiv.org/html/", i, "/").alias("url"), html.alias("html"))
    papers = x.select(i.alias("id"), F.when(i % 3 != 0, "https://creativecommons.org/licenses/by/4.0/").otherwise("").alias("license"), i.alias("page_id"))
    return html_pages.figure_candidates(papers, pages).drop("rank_reason")


_RISK = "(?i)" + "|".join(citations.CAPTION_RISKS)


@query(f"select doc_id, case when regexp_matches(text, '{_RISK}') or text = '' then 'https://arxiv.org/a.png' else 'https://arxiv.org/a.png https://export.arxiv.org/d.png' end kept from documents")
def c11_f14_clean_figures(spark, d):
    figure = lambda url, said: F.struct(F.lit(url).alias("url"), said.alias("caption"))
    figures = F.array(figure("https://arxiv.org/a.png", F.lit("A result")), figure("http://arxiv.org/b.png", F.lit("x")), figure("https://other.org/c.png", F.lit("y")), figure("https://export.arxiv.org/d.png", C("text")), figure("https://arxiv.org/e.png", F.lit("")))
    return read(spark, d, "documents").select("doc_id", F.array_join(F.transform(citations.clean_figures(figures), lambda f: f["url"]), " ").alias("kept"))


@query("""
select doc_id page_id, case when doc_id % 2 = 0 then 'https://e.org/x/' || doc_id || '.ris https://link.springer.com/' || lang || '.bib' else 'https://e.org/x/' || doc_id || '.ris https://link.springer.com/' || lang || '.bib https://www.sciencedirect.com/sdfe/arp/cite?pii=S' || doc_id || '&format=application%2Fx-research-info-systems&withabstract=true' end links from documents
""")
def f13_citation_links(spark, d):
    i = C("doc_id")
    html = _page("</head><body><a href='", i, ".ris'>Export</a><a href='", i, ".ris'>again</a><a href='/r?flavour=references'>Citation</a><a href='https://evil.org/a.bib'>cite</a><a href='https://link.springer.com/", C("lang"), ".bib'>BibTeX</a><a href='https://e.org/about'>About</a>")
    x = read(spark, d, "documents").select(i.alias("page_id"), F.when(i % 2 == 0, _text("https://e.org/x/y")).otherwise(_text("https://e.org/x/y?from=/pii/S", i)).alias("url"), html.alias("html"))
    return html_pages.citation_links(x).select("page_id", F.array_join("links", " ").alias("links"))


@query("select 'Owner' as login, text note, 'w' || lang as keywords from documents where doc_id = (select max(doc_id) from documents)")
def s15_snapshots(spark, d):
    state = F.to_json(F.struct(F.struct(F.create_map(F.lit("a"), C("text")).alias("notes"), F.array(_text("w", C("lang"))).alias("keywords"), F.lit(1).alias("unknown")).alias("personal")))
    body = _text("About <!-- v1 -->\n<!-- x-encoding:base64 -->\n```text\n", F.base64(state.cast("binary")), "\n```")
    x = read(spark, d, "documents").select(C("doc_id").alias("seq"), F.lit("Owner").alias("login"), _text("sync: ", C("doc_id")).alias("title"), body.alias("body"))
    s = feeds.state_from_issues(x, "owner", "sync", "<!-- v1 -->")
    return s.select("login", F.try_element_at("state.personal.notes", F.lit("a")).alias("note"), F.array_join("state.personal.keywords", ",").alias("keywords"))


@query("select 'd' || doc_id id, text title_zh from documents")
def s16_translations(spark, d):
    j = F.to_json(F.struct(F.create_map(_text("d", C("doc_id")), F.struct(C("text").alias("title_zh"))).alias("items")))
    return feeds.translations_table(read(spark, d, "documents").select(j.alias("json"))).select("id", "title_zh")


@query(f"with {PAPERS_O} select cast(substr(published, 1, 4) as integer) as year, cast(substr(published, 6, 2) as integer) as month, count(*) n, min(id) first_id, max(published) last_day from papers_o group by 1, 2")
def s17_month_shards(spark, d):
    path = scratch(spark, "shards")
    sinks.write_month_shards(papers_o(spark, d), path)
    return spark.read.parquet(path).groupBy(C("year").cast("int").alias("year"), C("month").cast("int").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("published").alias("last_day"))


@query(f"with {PAPERS_D} select id, substr(published, 1, 7) as month from papers_d where contains(lower(abstract), 'license')")
def j8_load_matches(spark, d):
    """The shards are a table by month, of which the matched months are read."""
    p, path = papers_d(spark, d).withColumn("month", F.substring("published", 1, 7)), scratch(spark, "months")
    p.repartitionByRange("month").write.partitionBy("month").parquet(path)
    shards = spark.read.schema(p.schema).parquet(path)
    return joins.load_matches(filters.search(p, "license", C("abstract")).select("month", "id"), shards).select("id", "month")


@query(f"""
with {PAPERS_O}, l as (select max(published) m from papers_o), p as (select o.* from papers_o o, l where published = m or (select count(*) from papers_o, l where published = m) < 4) select id from p order by importance desc, published desc, id limit 4
""")
def w5_digest_news(spark, d):
    return ranking.digest_latest(papers_o(spark, d, arrays=False), 4).select("id")


@query(f"with {NOTICES_O} select id from notices_o order by published desc, id limit 30")
def w11_home_news(spark, d):
    return ranking.home_news(notices_o(spark, d)).select("id")


@query(f"with {PAPERS_O} select o.id from papers_o o left join prio on prio.id = o.id order by contains(title, '77') desc, coalesce(priority, 0) desc, importance desc, published desc, o.id limit 40")
def w10_by_importance(spark, d):
    p = papers_o(spark, d)
    return ranking.order_results(p, "importance", F.contains("title", F.lit("77")), PRIORITIES).limit(40).select("id")


@query(f"with {PAPERS_O} select id from papers_o order by contains(title, '77') desc, published desc, importance desc, id limit 40")
def w10_newest(spark, d):
    p = papers_o(spark, d)
    return ranking.order_results(p, "newest", F.contains("title", F.lit("77")), PRIORITIES).limit(40).select("id")


@query(f"""
with {OPS_E}, s as (select user_, cast(max(ts) filter (seq % 2 = 0) as varchar) ra, cast(max(ts) filter (seq % 2 = 1) as varchar) la, count(*) filter (seq % 2 = 0) r, count(*) filter (seq % 2 = 1) l from ops_e group by 1),
o as (select user_, case when user_ % 5 = 0 and l > 0 then 'merged' when l > 0 and (r = 0 or date_trunc('second', cast(la as timestamp)) > date_trunc('second', cast(ra as timestamp))) then 'local' when r = 0 then 'local' else 'remote' end origin from s),
m as (select user_, type_, item_id, max(seq) filter (seq % 2 = 0) r, max(seq) filter (seq % 2 = 1) l from ops_e group by 1, 2, 3),
e as (select user_, type_, item_id, case origin when 'merged' then coalesce(l, r) when 'local' then l else r end v from m join o using (user_)),
w as (select user_, unnest(string_split(keywords, ',')) k, seq % 2 side from ops_e where keywords <> ''),
k as (select user_, string_agg(distinct k, ',' order by k) words from w join o using (user_) where origin = 'merged' or (origin = 'local') = (side = 1) group by 1)
select o.user_ as user, origin as from_, coalesce((select string_agg(item_id || '=' || v, ',' order by item_id) from e where e.user_ = o.user_ and type_ = 'favorite' and v is not null), '') favorites,
  coalesce((select string_agg(item_id || '=' || v, ',' order by item_id) from e where e.user_ = o.user_ and type_ = 'note' and v is not null), '') notes, coalesce(words, '') keywords
from o left join k on k.user_ = o.user_
""")
def t5_reconcile_state(spark, d):
    o = user_state.clean_ops(ops_e(spark, d))

    def snapshot(side: int):
        mine = o.where(C("seq") % 2 == side)
        last = mine.groupBy("user", "type", "item_id").agg(F.max("seq").cast("string").alias("v"))
        entries = lambda kind: F.map_from_entries(F.collect_list(F.when(C("type") == kind, F.struct("item_id", "v"))))
        maps = last.groupBy("user").agg(entries("favorite").alias("favorites"), entries("note").alias("notes"))
        words = mine.groupBy("user").agg(F.max("ts").cast("string").alias("updated_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("keywords")))).alias("keywords"))
        return words.join(maps, "user").withColumn("legacy", C("user") % 5 == 0)

    r = user_state.reconcile_state(snapshot(0), snapshot(1))
    said = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias(c)
    return r.select("user", C("from").alias("from_"), said("favorites"), said("notes"), F.array_join(F.array_sort("keywords"), ",").alias("keywords"))
