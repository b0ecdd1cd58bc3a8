"""The given tables in the shape of records: in Spark, and as SQL with the same definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch  # noqa: F401  for the queries

PRIORITIES = {"ECONOMY": 4, "LARGE": 20, "MEDIUM": 12, "PROMO": 30, "SMALL": 8, "STANDARD": 16}
UNFOCUSED = ("ECONOMY", "SMALL")
GROUPS = {"1-URGENT": "beam", "2-HIGH": "funding", "3-MEDIUM": "funding"}
AS_OF = "2001-07-15"
OP_TYPES = {"click": "favorite", "view": "ignored", "purchase": "note", "signup": "keywords", "error": "queue"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers_o(spark: SparkSession, sf_dir: str, arrays: bool = True) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = lambda n: (k % n).cast("string")
    p = o.join(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left").select(
        k.alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("published"),
        F.col("o_orderpriority").alias("source"),
        F.substring("o_orderpriority", 1, 1).alias("source_short"),
        F.when(F.col("o_orderstatus") == "F", "journal").when(F.col("o_orderstatus") == "O", "preprint").otherwise("").alias("source_type"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("10.1/"), text(9000))).alias("doi"),
        ((k * 7) % 101).alias("importance"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("abstract "), k.cast("string"))).alias("abstract"),
        F.concat(F.lit("Order "), text(12000)).alias("title"),
        F.concat(F.lit("https://example.org/"), k.cast("string")).alias("url"),
        F.array(F.coalesce("c_name", F.lit(""))).alias("authors"),
        k.alias("seq"),
    )
    if not arrays:
        return p
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    lists = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set("p_type")).alias("categories"), F.sort_array(F.collect_set("p_brand")).alias("tags"))
    none = F.array().cast("array<string>")
    return p.join(lists, "id", "left").withColumns({"categories": F.coalesce("categories", none), "tags": F.coalesce("tags", none)})


PAPERS_O = """papers_o as (
  select o_orderkey id, strftime(o_orderdate, '%Y-%m-%d') published, o_orderpriority source, substr(o_orderpriority, 1, 1) source_short,
    case o_orderstatus when 'F' then 'journal' when 'O' then 'preprint' else '' end source_type,
    case when o_orderkey % 5 = 0 then '' else '10.1/' || cast(o_orderkey % 9000 as varchar) end doi, (o_orderkey * 7) % 101 importance,
    case when o_orderkey % 3 = 0 then '' else 'abstract ' || cast(o_orderkey as varchar) end abstract,
    'Order ' || cast(o_orderkey % 12000 as varchar) title, 'https://example.org/' || cast(o_orderkey as varchar) url,
    coalesce(c_name, '') author, o_orderkey seq
  from orders left join customer on o_custkey = c_custkey
), cats as (select distinct l_orderkey id, p_type category from lineitem join part on l_partkey = p_partkey),
tags as (select distinct l_orderkey id, p_brand tag from lineitem join part on l_partkey = p_partkey),
prios(category, priority) as (values """ + ", ".join(f"('{k}', {v})" for k, v in PRIORITIES.items()) + """),
prio as (select id, max(priority) priority from cats join prios using (category) group by 1)"""


def completed_months(papers: DataFrame) -> DataFrame:
    m = papers.groupBy(F.substring("published", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return m.where("n % 2 = 0").select("month")


COMPLETED = "completed as (select substr(published, 1, 7) as month from papers_o group by 1 having count(*) % 2 = 0)"


def notices_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers_o(spark, sf_dir, arrays=False)
    day = F.to_date("published")
    group = F.lit("meetings")
    for source, g in GROUPS.items():
        group = F.when(F.col("source") == source, g).otherwise(group)
    return p.withColumns(
        {
            "deadline": F.when(F.col("id") % 7 == 0, "").otherwise(F.date_add(day, (F.col("id") % 60 - 20).cast("int")).cast("string")),
            "first_seen": F.date_add(day, 1).cast("string"),
            "group": group,
        }
    )


NOTICES_O = PAPERS_O + """, notices_o as (
  select *, case when id % 7 = 0 then '' else cast(cast(published as date) + cast(id % 60 - 20 as integer) as varchar) end deadline,
    cast(cast(published as date) + 1 as varchar) first_seen,
    case source """ + " ".join(f"when '{k}' then '{v}'" for k, v in GROUPS.items()) + """ else 'meetings' end grp from papers_o
)"""


def papers_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    return d.select(
        i.alias("id"),
        F.substring_index("text", ".", 1).alias("title"),
        F.col("text").alias("abstract"),
        "source",
        "lang",
        F.date_add(F.to_date(F.lit("2001-01-01")), ((i * 13) % 9000).cast("int")).cast("string").alias("published"),
        (50 * F.coalesce("quality", F.lit(0)) + i % 50).cast("long").alias("importance"),
        F.col("quality"),
        F.when(i % 6 == 0, "").otherwise(F.concat(F.lit("10.2/"), (i % 700).cast("string"))).alias("doi"),
        i.alias("seq"),
    )


PAPERS_D = """papers_d as (
  select doc_id id, split_part(text, '.', 1) title, text abstract, source, lang, cast(date '2001-01-01' + cast((doc_id * 13) % 9000 as integer) as varchar) published,
    50 * coalesce(quality, 0) + doc_id % 50 importance, quality, case when doc_id % 6 = 0 then '' else '10.2/' || cast(doc_id % 700 as varchar) end doi, doc_id seq
  from documents left join labels using (doc_id)
)"""

#: The title key of these tables, whose titles hold no compatibility characters.
TITLE_KEY = r"substr(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]', '', 'g'), 1, 220)"


def ops_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    kind = F.lit("")
    for a, b in OP_TYPES.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    on = F.col("event_id") % 4 != 0
    return e.select(
        F.col("event_id").cast("string").alias("op_id"),
        F.col("user_id").alias("user"),
        "ts",
        F.concat(F.lit("item"), k).alias("item_id"),
        kind.alias("type"),
        on.alias("active"),
        F.when(on, F.concat(F.lit(" note "), k)).otherwise("  ").alias("text"),
        F.when(on, F.array(F.lit("Alpha"), F.concat(F.lit("word"), (F.col("event_id") % 7).cast("string")), F.lit(" alpha "))).otherwise(F.array().cast("array<string>")).alias("keywords"),
        F.col("event_id").alias("seq"),
    )


OPS_E = """ops_e as (
  select cast(event_id as varchar) op_id, user_id as user_, ts, 'item' || json_extract_string(props, '$.k') item_id,
    case event_type """ + " ".join(f"when '{a}' then '{b}'" for a, b in OP_TYPES.items()) + """ end as type_, event_id % 4 <> 0 active,
    case when event_id % 4 <> 0 then 'note ' || json_extract_string(props, '$.k') else '' end text_,
    case when event_id % 4 <> 0 then 'Alpha,word' || cast(event_id % 7 as varchar) else '' end keywords, event_id seq from events
), last_ops as (
  select * from ops_e qualify row_number() over (partition by user_, type_, item_id order by ts desc, seq desc) = 1
), state as (
  select * from last_ops where case when type_ in ('favorite', 'ignored') then active when type_ = 'note' then text_ <> '' when type_ = 'keywords' then keywords <> '' else true end
)"""


def runs_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    return e.select(F.col("ts").alias("run_at"), F.col("event_type").alias("kind"), (F.col("user_id") % 20).cast("string").alias("name"), (i % 9 != 0).alias("ok"), (i % 37).alias("count"), (i % 1000).alias("duration_ms"), i.alias("seq"))


RUNS_E = "runs_e as (select ts run_at, event_type kind, cast(user_id % 20 as varchar) name, event_id % 9 <> 0 ok, event_id % 37 count_, event_id % 1000 duration_ms, event_id seq from events)"
