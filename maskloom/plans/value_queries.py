"""Queries of scalar functions: ranges, dates, maps, masks, keys, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import generalise as G
from ..functions import text as T
from ..functions import variants as V
from ..operators.alias import number_aliases, with_aliases
from .tables import inline, table, values_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _range_sql(col: str, limit: int, source: str, key: str) -> str:
    w = f"CASE WHEN {col} >= {limit} THEN 5000000 ELSE 1000000 END"
    return f"""SELECT {key}, CAST(floor({col} / ({w})) * ({w}) AS BIGINT) AS low, CAST(floor({col} / ({w})) * ({w}) AS BIGINT) + ({w}) AS high,
      format('{{:,}}', CAST(floor(floor({col} / ({w})) * ({w}) / 10000) AS BIGINT)) || '万～' || format('{{:,}}', CAST(floor((floor({col} / ({w})) * ({w}) + ({w})) / 10000) AS BIGINT)) || '万円' AS label
      FROM (SELECT {key}, {source} AS {col} FROM orders)"""


def _amount(spark, sf_dir, limit):
    v = F.col("o_totalprice") * 50
    low, high = G.bucket_bounds(v, G.estimate_width(v, limit))
    return table(spark, sf_dir, "orders").select("o_orderkey", low.alias("low"), high.alias("high"), G.amount_range(v, limit).alias("label"))


@query(_range_sql("v", 5_000_000, "o_totalprice * 50", "o_orderkey"))
def bucket_estimate(spark, sf_dir):
    return _amount(spark, sf_dir, 5_000_000)


@query(_range_sql("v", 10_000_000, "o_totalprice * 50", "o_orderkey"))
def bucket_cost(spark, sf_dir):
    return _amount(spark, sf_dir, 10_000_000)


@query("SELECT c_custkey, CAST(floor(c_acctbal * 100 / 100000) * 10 AS BIGINT) || '万円台' AS band FROM customer")
def bucket_salary(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", G.salary_band(F.col("c_acctbal") * 100).alias("band"))


@query("""SELECT l_discount, count(*) AS n, CAST(floor((CASE WHEN l_discount <= 1 THEN l_discount * 100 ELSE l_discount END) / 10) * 10 AS BIGINT) AS rate,
  CAST(floor((CASE WHEN l_discount <= 1 THEN l_discount * 100 ELSE l_discount END) / 10) * 10 AS BIGINT) || '％台' AS band FROM lineitem GROUP BY 1""")
def bucket_rate(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_discount").agg(F.count("*").alias("n"))
    return n.select("l_discount", "n", G.rate_floor(F.col("l_discount")).alias("rate"), G.rate_band(F.col("l_discount")).alias("band"))


@query("""SELECT year(o_orderdate) || '年' || month(o_orderdate) || '月第' || (CASE WHEN day(o_orderdate) <= 3 THEN 1 ELSE (day(o_orderdate) - 4) // 7 + 2 END) || '週' AS week,
  count(*) AS n FROM orders GROUP BY 1""")
def bucket_week(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(G.week_bucket(F.col("o_orderdate")).alias("week")).agg(F.count("*").alias("n"))


@query("SELECT (year(l_shipdate) // 10 * 10) || '年代' AS decade, count(*) AS n FROM lineitem GROUP BY 1")
def bucket_decade(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(G.decade(F.year("l_shipdate"), "年代不明").alias("decade")).agg(F.count("*").alias("n"))


_TYPES = (("BRASS", "metal"), ("STEEL", "metal"), ("COPPER", "metal"), ("NICKEL", "metal"), ("TIN", "metal"))


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN contains(p_type, '{a}') THEN '{b}'" for a, b in _TYPES) + " ELSE p_type END AS general FROM part")
def generalise_part_type(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", G.first_contained(F.col("p_type"), _TYPES, F.col("p_type")).alias("general"))


_DEPTS = [(1, "第一営業部"), (2, "Finance Team"), (3, "南工場"), (4, "広報課"), (5, "商品開発室"), (6, "総務部"), (7, "")]


@query("SELECT id, CASE " + " ".join(f"WHEN contains(dept, '{a}') THEN '{b}'" for a, b in G.DEPARTMENTS) + " ELSE regexp_replace(dept, '(部|課|室)$', '') END AS external, CASE WHEN dept = '南工場' THEN '工場' ELSE dept END AS analysis FROM " + values_sql(_DEPTS, "id, dept"))
def generalise_department(spark, sf_dir):
    d = inline(spark, _DEPTS, "id int, dept string")
    return d.select("id", G.department(F.col("dept"), False).alias("external"), G.department(F.col("dept"), True).alias("analysis"))


_ROLES = [(1, "代表取締役"), (2, "営業部長"), (3, "担当"), (4, "CFO"), (5, "主任"), (6, "一般"), (7, "")]


@query("SELECT id, CASE WHEN regexp_matches(r, '代表|取締役|CFO|CEO|COO') THEN '経営者' WHEN regexp_matches(r, '部長|課長|主任|工場長') THEN '管理職' WHEN r = '担当' THEN '担当者' ELSE r END AS role FROM " + values_sql(_ROLES, "id, r"))
def generalise_role(spark, sf_dir):
    return inline(spark, _ROLES, "id int, r string").select("id", G.role(F.col("r")).alias("role"))


_PHONES = [(1, "03-1234-5678"), (2, "090 1234 5678"), (3, "+81-90-1234-5678"), (4, "+81 3 1234 5678"), (5, "0612345678"), (6, "123"), (7, "080-1111-2222")]
_PHONE_MASKS = {1: "03-XXXX-5678", 2: "090-XXXX-5678", 3: "+81-90-XXXX-5678", 4: "03-XXXX-5678", 5: "061-XXX-5678", 6: "電話番号", 7: "080-XXXX-2222"}
_PHONE_KINDS = {1: "landline_phone", 2: "mobile_phone", 3: "mobile_phone", 4: "landline_phone", 5: "landline_phone", 6: "landline_phone", 7: "mobile_phone"}


@query("SELECT * FROM " + values_sql([(i, _PHONE_MASKS[i], _PHONE_KINDS[i]) for i, _ in _PHONES], "id, masked, kind"))
def mask_phones(spark, sf_dir):
    p = inline(spark, _PHONES, "id int, phone string")
    return p.select("id", G.mask_phone(F.col("phone"), True).alias("masked"), G.phone_class(F.col("phone"), True).alias("kind"))


@query(r"SELECT c_custkey, substr(regexp_replace(c_name, '[^0-9]', '', 'g'), 1, 3) || '-XXXX' AS masked FROM customer")
def mask_postal_codes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", G.mask_postal(F.col("c_name"), True).alias("masked"))


@query(r"SELECT s_suppkey, repeat('*', greatest(12, length(regexp_replace(s_name, '[^0-9]', '', 'g')))) AS masked FROM supplier")
def mask_personal_numbers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", G.mask_personal_number(F.col("s_name"), True).alias("masked"))


_KEYS = [(1, "email", " Ann+News@Example.COM "), (2, "email", "broken"), (3, "company", "ACME Corp"), (4, "ip", "10.0.0.A"), (5, "name", "Lee 部長"), (6, "text", " keep Me ")]


@query("""SELECT id, CASE kind WHEN 'email' THEN CASE WHEN contains(v, '@') THEN split_part(split_part(lower(trim(v)), '@', 1), '+', 1) || '@' || split_part(lower(trim(v)), '@', 2) ELSE lower(trim(v)) END
  WHEN 'company' THEN lower(trim(v)) WHEN 'ip' THEN lower(trim(v)) WHEN 'name' THEN regexp_replace(regexp_replace(v, '\\s', '', 'g'), '(さん|様|殿|氏|部長|課長|係長|主任)$', '') ELSE trim(v) END AS norm_key FROM """.replace("\\\\", "\\") + values_sql(_KEYS, "id, kind, v"))
def alias_keys(spark, sf_dir):
    return inline(spark, _KEYS, "id int, kind string, v string").select("id", T.alias_key(F.col("kind"), F.col("v")).alias("norm_key"))


_MISSING = [(1, "なし"), (2, "N/A"), (3, "n/a"), (4, " - "), (5, "山田"), (6, "Ｎ／Ａ"), (7, "該当 なし"), (8, "")]


@query("SELECT id, id IN (1, 2, 4, 6, 7) AS missing FROM " + values_sql(_MISSING, "id, v"))
def missing_values(spark, sf_dir):
    return inline(spark, _MISSING, "id int, v string").select("id", T.is_missing(F.col("v")).alias("missing"))


_PLACE = [(1, "個人001"), (2, "個人001様"), (3, "mail003@example.invalid"), (4, "個人01"), (5, "法人120担当"), (6, "Acme")]


@query("SELECT id, id IN (1, 2, 3, 5) AS placeholder FROM " + values_sql(_PLACE, "id, v"))
def placeholder_values(spark, sf_dir):
    return inline(spark, _PLACE, "id int, v string").select("id", T.is_placeholder(F.col("v")).alias("placeholder"))


_NUMBERS = [(1, "1,200円"), (2, "12%"), (3, "abc"), (4, " 3.5 "), (5, ""), (6, "-7")]


@query("SELECT id, TRY_CAST(regexp_replace(regexp_replace(trim(v), '[,円]', '', 'g'), '%$', '') AS DOUBLE) AS number FROM " + values_sql(_NUMBERS, "id, v"))
def parse_numbers(spark, sf_dir):
    return inline(spark, _NUMBERS, "id int, v string").select("id", T.number(F.col("v")).alias("number"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(regexp_extract(strftime(o_orderdate, '%Y-%m-%d'), '((?:19|20)[0-9]{2})', 1) AS INTEGER) AS year FROM orders")
def stringify_dates(spark, sf_dir):
    day = T.stringify(F.col("o_orderdate"), "timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), G.year_of(day).alias("year"))


@query("""SELECT p_brand, CASE WHEN p_size > 0 THEN 'あり' ELSE 'なし' END AS dependents, CASE left(p_type, 1) WHEN 'A' THEN '高評価' WHEN 'B' THEN '標準' WHEN 'C' THEN '要支援' ELSE '評価情報あり' END AS rating,
  count(*) AS n FROM part GROUP BY 1, 2, 3""")
def rating_and_dependents(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", G.dependents(F.col("p_size")).alias("dependents"), G.rating(F.left("p_type", F.lit(1))).alias("rating"))
    return p.groupBy("p_brand", "dependents", "rating").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, '個人' || CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END AS alias
  FROM (SELECT c_custkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS no FROM customer)""")
def alias_by_first_seen(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("scope"), F.lit("name").alias("kind"), F.col("c_custkey").alias("ord"), "c_name")
    c = c.withColumn("norm_key", T.alias_key(F.col("kind"), F.col("c_name"), True))
    return with_aliases(c, ["scope"]).select("c_custkey", "alias")


@query("""WITH f AS (SELECT o_custkey AS k, min(o_orderkey) AS ord FROM orders GROUP BY 1),
  e AS (SELECT k, ord, 0 AS taken FROM f UNION ALL SELECT NULL, o_orderkey, 1 FROM orders WHERE o_orderkey % 100 = 0),
  n AS (SELECT *, row_number() OVER (ORDER BY ord, taken, k) AS no FROM e)
  SELECT CAST(k AS VARCHAR) AS norm_key, CAST(no AS INTEGER) AS alias_no FROM n WHERE taken = 0""")
def alias_extra_allocations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    firsts = o.groupBy(F.col("o_custkey").cast("string").alias("norm_key")).agg(F.min("o_orderkey").alias("ord")).withColumn("kind", F.lit("customer_id"))
    extra = o.filter("o_orderkey % 100 = 0").select(F.lit("customer_id").alias("kind"), F.col("o_orderkey").alias("ord"))
    return number_aliases(firsts, [], extra).select("norm_key", "alias_no")


_KINDS = [(1, "email", "a@b.co"), (2, "postal_code", "123-4567"), (3, "secret", "sk-123"), (4, "rating", "A"), (5, "dependents", "2"), (6, "salary_50k", "345000"), (7, "rate_10", "0.25"), (8, "birth_date", "1984-05-01"), (9, "care_info", "腰痛あり"), (10, "project", "X"), (11, "personal_number", "123412341234"), (12, "reception_datetime", "2024-05-12")]
_WANT = {1: "mail007@example.invalid", 2: "123-XXXX", 3: "********", 4: "高評価", 5: "あり", 6: "30万円台", 7: "20％台", 8: "1980年代", 9: "身体的配慮あり", 10: "別名007", 11: "************", 12: "2024年5月第3週"}


@query("SELECT * FROM " + values_sql([(i, _WANT[i]) for i, _, _ in _KINDS], "id, replacement"))
def replacement_by_kind(spark, sf_dir):
    r = G.replacement(F.col("kind"), F.col("v"), F.lit("別名007"), analysis=True)
    return inline(spark, _KINDS, "id int, kind string, v string").select("id", r.alias("replacement"))


@query()
def text_similarity(spark, sf_dir):
    """Similarity of pairs of benchmark texts by matching blocks."""
    b = table(spark, sf_dir, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(nxt, "item_id").select("item_id", T.sequence_ratio(F.col("text"), F.col("other")).alias("ratio"))


_VARIANTS = [(1, "name", "髙橋 一郎"), (2, "name", "サトウ ハナコ"), (3, "organization", "株式会社 みらい"), (4, "phone", "090-1234-5678"), (5, "email", "Ann+x@B.example"), (6, "phone", "+81-80-1111-2222")]
_WRITTEN = {
    1: ["髙橋", "髙橋 一郎", "髙橋一郎", "高橋", "高橋 一郎", "高橋一郎"],
    2: ["SATO", "SATO HANAKO", "Sato", "Sato Hanako", "さとう はなこ", "さとうはなこ", "サトウ", "サトウ ハナコ", "サトウハナコ"],
    3: ["みらい", "株式会社 みらい", "株式会社みらい"], 4: ["+81-90-1234-5678", "090-1234-5678", "09012345678"],
    5: ["Ann+x@B.example", "ann+x@b.example", "ann@b.example"], 6: ["+81-80-1111-2222", "08011112222", "818011112222"],
}


@query("SELECT * FROM " + values_sql([(i, w) for i, ws in _WRITTEN.items() for w in ws], "id, variant"))
def value_variants(spark, sf_dir):
    v, k = F.col("v"), F.col("kind")
    found = F.when(k == "name", V.name_variants(v)).when(k == "organization", V.organization_variants(v)).when(k == "phone", V.phone_variants(v)).otherwise(V.email_variants(v))
    return inline(spark, _VARIANTS, "id int, kind string, v string").select("id", F.explode(found).alias("variant"))


@query("SELECT * FROM " + values_sql([(1, "顧客042と競合企業、番号は下4桁がXXXX")], "id, text"))
def generic_rewrites(spark, sf_dir):
    return inline(spark, [(1, "C0042と競合B社、番号は下4桁が1234")], "id int, text string").select("id", V.rewrite_generic(F.col("text")).alias("text"))
