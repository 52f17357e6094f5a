"""Queries of the scalar functions, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from almoneda.functions import scalar as S
from almoneda.plans.registry import query
from almoneda.plans.testbind import CPV_DIM, contracts, cpv_code, cpv_dim, table, with_contracts

_LEAF = "lpad(CAST(p_size AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0')"
_BUCKET = """CASE WHEN {a} IS NULL OR {a} <= 0 THEN NULL WHEN {a} < 1000 THEN 'b00' WHEN {a} >= 1e8 THEN 'b14'
  ELSE 'b' || lpad(CAST(least(CAST(floor(15 * (ln({a}) - ln(1000.0)) / (ln(100000000.0) - ln(1000.0))) AS INTEGER), 14) AS VARCHAR), 2, '0') END"""


@query("url_last_segment", "SELECT page_id, regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) AS segment FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", S.last_segment("url").alias("segment"))


@query("object_uuid", """WITH h AS (SELECT o_orderkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('https://placsp.id/' || o_orderkey)) AS h FROM orders)
SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (CAST('0x' || substr(h, 17, 1) AS INTEGER) & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.object_uuid(F.col("o_orderkey").cast("string")).alias("uuid"))


@query("budget_bucket", with_contracts(f"SELECT sid, {_BUCKET.format(a='budget_amount')} AS bucket FROM contracts"))
def _(spark, d):
    return contracts(spark, d).select("sid", S.budget_bucket("budget_amount").alias("bucket"))


@query("backfill_buckets", with_contracts(f"SELECT sid, {_BUCKET.format(a='budget_amount')} AS budget_bucket, strftime(publication_ts, '%Y-%m') AS pub_month, strftime(deadline_ts, '%Y-%m') AS deadline_month FROM contracts"))
def _(spark, d):
    return contracts(spark, d).select("sid", S.budget_bucket("budget_amount").alias("budget_bucket"), F.date_format("publication_ts", "yyyy-MM").alias("pub_month"), F.date_format("deadline_ts", "yyyy-MM").alias("deadline_month"))


@query("backfill_diff", with_contracts(f"SELECT sid, {_BUCKET.format(a='budget_amount')} AS budget_bucket FROM contracts WHERE {_BUCKET.format(a='budget_amount')} IS DISTINCT FROM CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {_BUCKET.format(a='budget_amount * 1.5')} END"))
def _(spark, d):
    from almoneda.ingest import changed_only

    old = F.when(F.col("o_orderkey") % 3 != 0, S.budget_bucket(F.col("budget_amount") * 1.5))
    c = contracts(spark, d).withColumns({"stored": old, "budget_bucket": S.budget_bucket("budget_amount")})
    return changed_only(c, {"budget_bucket": "stored"}).select("sid", "budget_bucket")


@query("budget_bucket_edges", """SELECT 'b' || lpad(CAST(i AS VARCHAR), 2, '0') AS bucket, CASE WHEN i = 0 THEN 0.0 ELSE round(exp(ln(1000.0) + i * (ln(1e8) - ln(1000.0)) / 15), 2) END AS low,
  CASE WHEN i = 14 THEN NULL ELSE round(exp(ln(1000.0) + (i + 1) * (ln(1e8) - ln(1000.0)) / 15), 2) END AS high FROM range(15) r(i)""")
def _(spark, d):
    from almoneda.facets import budget_edges

    return budget_edges(spark).select("bucket", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))


@query("log_scale_pos", with_contracts("SELECT sid, round((ln(least(greatest(coalesce(nullif(budget_amount, 0), 1000.0), 1000.0), 1e8)) - ln(1000.0)) / (ln(1e8) - ln(1000.0)), 6) AS pos FROM contracts"))
def _(spark, d):
    return contracts(spark, d).select("sid", F.round(S.log_scale_pos("budget_amount"), 6).alias("pos"))


@query("log_scale_value", "SELECT event_id, floor(exp(ln(1000.0) + least(greatest(value / 100, 0), 1) * (ln(1e8) - ln(1000.0))) + 0.5) AS amount FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.log_scale_value(F.col("value") / 100).alias("amount"))


@query("pub_month", "SELECT event_id, strftime(ts, '%Y-%m') AS month FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.month_of(F.concat(F.lit("publicado "), F.col("ts").cast("string"))).alias("month"))


_DATES = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN ' ' || strftime(ts, '%Y-%m-%d') ELSE 'no-es-fecha' END"


@query("date_normalize", f"SELECT event_id, CASE WHEN contains(s, 'T') THEN s WHEN regexp_matches(s, '^\\s*\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN regexp_extract(s, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) || 'T00:00:00Z' END AS iso FROM (SELECT event_id, {_DATES} AS s FROM events)")
def _(spark, d):
    kind, day = F.pmod("event_id", F.lit(4)), F.date_format("ts", "yyyy-MM-dd")
    text = F.when(kind == 0, F.concat(day, F.lit("Z"))).when(kind == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 2, F.concat(F.lit(" "), day)).otherwise("no-es-fecha")
    return table(spark, d, "events").select("event_id", S.normalize_date(text).alias("iso"))


@query("money_format", "SELECT o_orderkey, format('{:,.2f}', o_totalprice) || ' EUR' AS money FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.money("o_totalprice").alias("money"))


@query("money_es", "SELECT o_orderkey, CASE WHEN abs(round(o_totalprice)) < 10000 THEN CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) ELSE replace(format('{:,}', CAST(round(o_totalprice) AS BIGINT)), ',', '.') END || ' €' AS money FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.money_es("o_totalprice").alias("money"))


_NIF = "' b-' || lpad(CAST(s_suppkey AS VARCHAR), 2, '0') || '.318.9' || (s_suppkey % 7) || ' '"


@query("normalize_nif", f"SELECT s_suppkey, nullif(upper(regexp_replace({_NIF}, '[\\s.\\-]', '', 'g')), '') AS nif FROM supplier")
def _(spark, d):
    raw = F.concat(F.lit(" b-"), F.lpad(F.col("s_suppkey").cast("string"), 2, "0"), F.lit(".318.9"), F.pmod("s_suppkey", F.lit(7)).cast("string"), F.lit(" "))
    return table(spark, d, "supplier").select("s_suppkey", S.normalize_nif(raw).alias("nif"))


_NAMES = ("{n}, S.L.L.", "{n} S.A.", "UTE {n}", "I B M {n} sociedad", "S.L.", "{n} y Cía. Ñandú", "A 1 B C {n} s.l.")


@query("normalize_name", """WITH n AS (SELECT s_suppkey, upper(CASE s_suppkey % 7 WHEN 0 THEN s_name || ', S.L.L.' WHEN 1 THEN s_name || ' S.A.' WHEN 2 THEN 'UTE ' || s_name WHEN 3 THEN 'I B M ' || s_name || ' sociedad'
    WHEN 4 THEN 'S.L.' WHEN 5 THEN s_name || ' y Cía. Ñandú' ELSE 'A 1 B C ' || s_name || ' s.l.' END) AS name FROM supplier),
w AS (SELECT s_suppkey, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT s_suppkey, list_filter(string_split_regex(regexp_replace(name, '[^A-Z0-9ÁÉÍÓÚÜÑ]', ' ', 'g'), ' +'), lambda x: x <> '') AS ws FROM n)),
l AS (SELECT *, length(w) = 1 AND NOT regexp_matches(w, '[0-9]') AS lone FROM w),
r AS (SELECT *, sum(CASE WHEN lone AND coalesce(before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY s_suppkey ORDER BY i) AS run FROM (SELECT *, lag(lone) OVER (PARTITION BY s_suppkey ORDER BY i) AS before FROM l)),
m AS (SELECT s_suppkey, run, string_agg(w, '' ORDER BY i) AS w FROM r GROUP BY s_suppkey, run),
k AS (SELECT s_suppkey, string_agg(w, ' ' ORDER BY run) FILTER (w NOT IN ('SL','SLU','SLL','SA','SAU','SCA','SC','SLP','SLNE','SCOOP','COOP','SRL','SAL','AIE','UTE')) AS kept, string_agg(w, ' ' ORDER BY run) AS whole FROM m GROUP BY s_suppkey)
SELECT s_suppkey, coalesce(kept, whole) AS name FROM k""")
def _(spark, d):
    n, k = F.col("s_name"), F.pmod("s_suppkey", F.lit(7))
    raw = F.when(k == 99, n)
    for i, pattern in enumerate(_NAMES):
        a, _, b = pattern.partition("{n}")
        raw = raw.when(k == i, F.concat(F.lit(a), n, F.lit(b)) if "{n}" in pattern else F.lit(pattern))
    return table(spark, d, "supplier").select("s_suppkey", S.normalize_name(raw).alias("name"))


@query("is_ute", "SELECT s_suppkey, s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 AS ute FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey")
    name = F.when(k % 5 == 0, F.concat(F.lit(" ute "), F.col("s_name"))).otherwise(F.col("s_name"))
    nif = F.when(k % 3 == 0, F.concat(F.lit("u"), k.cast("string"))).when(k % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("B"), k.cast("string")))
    return table(spark, d, "supplier").select("s_suppkey", S.is_ute(name, nif).alias("ute"))


@query("cpv_level", f"SELECT p_partkey, CAST(greatest(length(rtrim(rpad(string_split({_LEAF}, '-')[1], 8, '0'), '0')), 2) AS INTEGER) AS lvl FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.cpv_level(F.expr(cpv_code())).cast("int").alias("lvl"))


@query("cpv_prefix", f"SELECT p_partkey, substr(x, 1, greatest(length(rtrim(x, '0')), 2)) AS prefix FROM (SELECT p_partkey, rpad(replace(substr({_LEAF}, 1, 2 + CAST(p_partkey % 7 AS INTEGER)) || '-' || (p_partkey % 10), '-', ''), 8, '0') AS x FROM part)")
def _(spark, d):
    code = F.concat(F.expr(f"substring({cpv_code()}, 1, 2 + cast(p_partkey % 7 as int))"), F.lit("-"), F.pmod("p_partkey", F.lit(10)).cast("string"))
    return table(spark, d, "part").select("p_partkey", S.cpv_prefix(code).alias("prefix"))


@query("cpv_ancestors", f"""WITH {CPV_DIM}, a AS (SELECT c.code, a.code AS up, a.label, length(rtrim(a.code, '0')) AS lvl FROM cpv_dim c JOIN cpv_dim a
  ON a.code IN (SELECT rpad(substr(c.code, 1, CAST(n AS INTEGER)), 8, '0') FROM range(2, 8) r(n) WHERE n < greatest(length(rtrim(c.code, '0')), 2)) AND a.code <> c.code)
SELECT code, string_agg(label, ' > ' ORDER BY up) AS path FROM a GROUP BY code""")
def _(spark, d):
    from almoneda.hierarchy import cpv_ancestors

    return cpv_ancestors(cpv_dim(spark, d))


@query("cpv_children", f"""WITH {CPV_DIM}, l AS (SELECT code, greatest(length(rtrim(code, '0')), 2) AS lvl FROM cpv_dim)
SELECT p.code AS parent, c.code AS child FROM l p JOIN l c ON c.lvl = p.lvl + 1 AND substr(c.code, 1, CAST(p.lvl AS INTEGER)) = substr(p.code, 1, CAST(p.lvl AS INTEGER)) WHERE p.lvl < 8""")
def _(spark, d):
    from almoneda.hierarchy import cpv_children

    return cpv_children(cpv_dim(spark, d))


@query("cpv_miller", f"""WITH {CPV_DIM}, l AS (SELECT code, label, greatest(length(rtrim(code, '0')), 2) AS lvl FROM cpv_dim)
SELECT 0 AS col, code, label FROM l WHERE lvl = 2 UNION ALL SELECT 1, code, label FROM l WHERE lvl = 3 AND substr(code, 1, 2) = '11' UNION ALL SELECT 2, code, label FROM l WHERE lvl = 4 AND substr(code, 1, 3) = '110' UNION ALL SELECT 3, code, label FROM l WHERE lvl = 5 AND substr(code, 1, 4) = '1100'""")
def _(spark, d):
    from almoneda.hierarchy import miller_columns

    return miller_columns(cpv_dim(spark, d), ["11000000", "11000000", "11000000"], levels=[2, 3, 4])


@query("cpv_typeahead", f"WITH {CPV_DIM} SELECT code, label FROM cpv_dim WHERE starts_with(code, '11') OR contains(lower(label), 'ring') ORDER BY code LIMIT 40")
def _(spark, d):
    from almoneda.hierarchy import cpv_typeahead

    return cpv_typeahead(cpv_dim(spark, d), ["11", "ring"])


@query("cpv_typeahead_indexed", f"WITH {CPV_DIM} SELECT code, label FROM cpv_dim WHERE starts_with(code, '12') OR contains(lower(label), 'ring') OR contains(lower(label), 'ol') ORDER BY code LIMIT 40")
def _(spark, d):
    """The same by postings of pieces of the labels."""
    from almoneda.store import workspace
    from almoneda.substring import Typeahead

    return Typeahead(spark, workspace(spark, "typeahead")).build(cpv_dim(spark, d)).search(["12", "RING", "ol"])


@query("nuts_truncate", with_contracts("SELECT sid, CASE WHEN length(nuts) >= 5 THEN 3 ELSE 2 END AS lvl, substr(nuts, 1, 4) AS nuts2, substr(nuts, 1, 5) AS nuts3 FROM contracts"))
def _(spark, d):
    return contracts(spark, d, "nuts").select("sid", S.nuts_level("nuts").alias("lvl"), S.nuts_truncate("nuts", 2).alias("nuts2"), S.nuts_truncate("nuts", 3).alias("nuts3"))


@query("choropleth_shade", with_contracts("""SELECT nuts, n, CAST(CASE WHEN n <= 0 THEN 0 ELSE least(floor(least(1.0, ln(n + 1) / ln(max(n) OVER () + 1)) * 5), 4) END AS INTEGER) AS shade FROM (SELECT nuts, count(*) AS n FROM contracts WHERE nuts IS NOT NULL GROUP BY nuts)"""))
def _(spark, d):
    counts = contracts(spark, d, "nuts").filter("nuts IS NOT NULL").groupBy("nuts").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("most")))).select("nuts", "n", S.shade("n", "most").alias("shade"))  # one row on the right


@query("compact_count", "SELECT o_orderkey, CASE WHEN v >= 1e6 THEN printf('%.1fM', floor(v / 1e5) / 10) WHEN v >= 1e3 THEN printf('%.1fk', floor(v / 1e2) / 10) ELSE CAST(CAST(v AS BIGINT) AS VARCHAR) END AS n FROM (SELECT o_orderkey, CAST(floor(o_totalprice / pow(10, o_orderkey % 5)) AS BIGINT) * CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE 1 END AS v FROM orders)")
def _(spark, d):
    n = F.floor(F.col("o_totalprice") / F.pow(F.lit(10.0), F.col("o_orderkey") % 5)).cast("long") * F.when(F.col("o_orderkey") % 7 == 0, 100).otherwise(1)
    return table(spark, d, "orders").select("o_orderkey", S.compact_count(n).alias("n"))


@query("linear_pos", "SELECT event_id, least(greatest((value - 10) / 40, 0), 1) AS pos FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.linear_pos("value", F.lit(10.0), F.lit(50.0)).alias("pos"))


@query("density_path", """WITH e AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT event_type, day, n, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS k, greatest(max(n) OVER (PARTITION BY event_type), 1) AS top FROM e),
x AS (SELECT *, floor(i * 1000.0 / nullif(k - 1, 0) + 0.5) / 10 AS px, floor(200 - n * 200.0 / top + 0.5) / 10 AS py FROM p)
SELECT event_type, CASE WHEN max(k) < 2 THEN '' ELSE 'M 0.0 20.0 ' || string_agg('L ' || CAST(CAST(px AS DECIMAL(9,1)) AS VARCHAR) || ' ' || CAST(CAST(py AS DECIMAL(9,1)) AS VARCHAR), ' ' ORDER BY day) || ' L 100.0 20.0 Z' END AS path FROM x GROUP BY event_type""")
def _(spark, d):
    e = table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    series = e.groupBy("event_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "n"))), lambda x: x["n"]).alias("counts"))  # one entry a day
    return series.select("event_type", S.density_path("counts").alias("path"))


@query("date_presets", """SELECT event_id, strftime(t - INTERVAL 1 MONTH, '%Y-%m-%d') AS month_from, strftime(t - INTERVAL 3 MONTH, '%Y-%m-%d') AS quarter_from, strftime(t - INTERVAL 1 YEAR, '%Y-%m-%d') AS year_from,
  strftime(t + INTERVAL 1 DAY, '%Y-%m-%d') AS due_1d, strftime(t + INTERVAL 7 DAY, '%Y-%m-%d') AS due_7d, strftime(t + INTERVAL 14 DAY, '%Y-%m-%d') AS due_14d, strftime(t + INTERVAL 1 MONTH, '%Y-%m-%d') AS due_1m FROM (SELECT event_id, CAST(ts AS DATE) AS t FROM events)""")
def _(spark, d):
    t = F.to_date("ts")
    return table(spark, d, "events").select(
        "event_id", *[F.date_format(F.add_months(t, n), "yyyy-MM-dd").alias(c) for n, c in ((-1, "month_from"), (-3, "quarter_from"), (-12, "year_from"), (1, "due_1m"))],
        *[F.date_format(F.date_add(t, n), "yyyy-MM-dd").alias(f"due_{n}d") for n in (1, 7, 14)],
    )


@query("month_grid", """SELECT strftime(m, '%Y-%m') AS month, strftime(m, '%Y-%m-%d') AS first_day, strftime(last_day(m), '%Y-%m-%d') AS last_day FROM (SELECT unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS m
  FROM (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders)) ORDER BY m DESC LIMIT 36""")
def _(spark, d):
    from almoneda.facets import month_grid

    span = table(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    return month_grid(span, 36).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("month_axis", """SELECT 'past' AS axis, strftime(m, '%Y-%m') AS month, strftime(m, '%Y-%m-%d') AS day_from, strftime(last_day(m), '%Y-%m-%d') AS day_to FROM (SELECT unnest(generate_series(DATE '2023-07-01', DATE '2026-06-01', INTERVAL 1 MONTH)) AS m)
UNION ALL SELECT 'next', strftime(m, '%Y-%m'), strftime(m, '%Y-%m-%d'), strftime(last_day(m), '%Y-%m-%d') FROM (SELECT unnest(generate_series(DATE '2026-06-01', DATE '2027-11-01', INTERVAL 1 MONTH)) AS m)""")
def _(spark, d):
    from almoneda.facets import month_axes

    return month_axes(spark, "2026-06-15").withColumns({c: F.col(c).cast("string") for c in ("day_from", "day_to")})


@query("is_offpeak", "SELECT event_id, hour(ts) >= 22 OR hour(ts) < 7 AS offpeak FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.is_offpeak("ts").alias("offpeak"))


@query("spanish_number", "SELECT o_orderkey, round(o_totalprice, 2) AS amount FROM orders")
def _(spark, d):
    spanish = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return table(spark, d, "orders").select("o_orderkey", S.spanish_number(F.concat(F.lit("Importe: "), spanish, F.lit(" euros"))).alias("amount"))


@query("clean_text", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS cleaned FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", S.clean_text("text").alias("cleaned"))


@query("classify_links", """WITH l AS (SELECT page_id, unnest(['Pliego Administrativo ' || page_id, 'Anexo', 'Pliego Técnico ' || page_id, 'PPT ' || page_id]) AS name, unnest([0, 1, 2, 3]) AS i FROM pages),
k AS (SELECT *, CASE WHEN contains(lower(name), 'administrativ') OR contains(lower(name), 'pcap') THEN 'PCAP' WHEN contains(lower(name), 'técnic') OR contains(lower(name), 'tecnic') OR contains(lower(name), 'ppt') THEN 'PPT' END AS kind FROM l)
SELECT page_id, min_by(name, i) FILTER (kind = 'PCAP') AS pcap_first, max_by(name, i) FILTER (kind = 'PPT') AS ppt_last FROM k GROUP BY page_id""")
def _(spark, d):
    page = F.col("page_id").cast("string")
    names = F.array(F.concat(F.lit("Pliego Administrativo "), page), F.lit("Anexo"), F.concat(F.lit("Pliego Técnico "), page), F.concat(F.lit("PPT "), page))
    of = lambda kind: F.filter(names, lambda n: S.link_kind(n) == kind)
    return table(spark, d, "pages").select("page_id", F.get(of("PCAP"), F.lit(0)).alias("pcap_first"), F.try_element_at(of("PPT"), F.lit(-1)).alias("ppt_last"))


@query("token_hash", "SELECT user_id, sha256('token-' || user_id) AS token_hash FROM (SELECT DISTINCT user_id FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("user_id").distinct().select("user_id", F.sha2(F.concat(F.lit("token-"), F.col("user_id").cast("string")).cast("binary"), 256).alias("token_hash"))


@query("json_roundtrip", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, '{\"k\":' || (props ->> '$.k') || '}' AS again FROM events")
def _(spark, d):
    parsed = F.from_json("props", "k long")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"), F.coalesce(F.to_json(parsed), F.lit("{}")).alias("again"))


@query("llm_json_clean", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '{}' ELSE '{\"k\":' || (props ->> '$.k') || '}' END AS answer FROM events")
def _(spark, d):
    answer = F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.pmod("event_id", F.lit(3)) == 1, F.col("props")).otherwise("no JSON here")
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_parse_json(S.strip_fences(answer)), F.parse_json(F.lit("{}"))).cast("string").alias("answer"))


@query("like_rank_lookup", """SELECT event_id, CAST(1 + (event_id % 3) AS INTEGER) AS result_rank, CAST(list_extract([0.9, 0.8, 0.7], CAST(1 + (event_id % 3) AS INTEGER)) AS DOUBLE) AS result_score FROM events WHERE event_type = 'click' AND event_id % 4 < 3
UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_type = 'click' AND event_id % 4 = 3""")
def _(spark, d):
    from almoneda.state import snapshot_position

    shown = F.array(*[F.struct(F.lit(x).alias("id"), F.lit(i + 1).alias("rank"), F.lit(s).cast("double").alias("score")) for i, (x, s) in enumerate((("a", 0.9), ("b", 0.8), ("c", 0.7)))])
    liked = F.when(F.pmod("event_id", F.lit(4)) == 3, "zz").otherwise(F.get(F.array(*map(F.lit, "abc")), F.pmod("event_id", F.lit(3)).cast("int")))
    e = table(spark, d, "events").filter("event_type = 'click'").withColumn("hit", snapshot_position(shown, liked))
    return e.select("event_id", F.col("hit.rank").alias("result_rank"), F.col("hit.score").alias("result_score"))


@query("first_matching_url", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE url || '/GetDocumentByIdServlet?x=1' END AS doc_url FROM pages")
def _(spark, d):
    urls = F.array(F.col("url"), F.when(F.pmod("page_id", F.lit(3)) == 0, F.col("url")).otherwise(F.concat("url", F.lit("/GetDocumentByIdServlet?x=1"))), F.concat("url", F.lit("/z")))
    return table(spark, d, "pages").select("page_id", S.first_matching(urls, "GetDocumentByIdServlet").alias("doc_url"))


@query("exists_array_pred", with_contracts("SELECT sid FROM contracts WHERE len(list_filter(coalesce(cpv, []), lambda x: contains(x, '99'))) > 0"))
def _(spark, d):
    return contracts(spark, d, "cpv").filter(F.exists("cpv", lambda u: F.contains(u, F.lit("99")))).select("sid")


@query("render_summary", with_contracts("""SELECT sid, concat_ws(' ', 'Contrato de ' || contract_type_code || ': Contrato ' || sid || '.', 'Órgano de contratación: ' || contracting_authority || ' (' || nuts_label || ').', 'Expediente: E-' || sid || '.',
  'Importes: presupuesto base ' || format('{:,.2f}', budget_amount) || ' EUR.', CASE WHEN len(cpv) > 0 THEN 'CPV: ' || array_to_string(cpv, ', ') || '.' END, 'Procedimiento: ' || procedure_code || '.', 'Estado: ' || status_code || '.',
  'Lugar de ejecución: ' || nuts_label || '.', 'Fecha de publicación: ' || strftime(publication_ts, '%Y-%m-%d') || '.') AS content FROM contracts"""))
def _(spark, d):
    from almoneda.render import render_summary

    c = contracts(spark, d, "customer", "nuts", "cpv").withColumns({
        "title": F.concat(F.lit("Contrato "), "sid"), "expediente": F.concat(F.lit("E-"), "sid"), "contract_type": F.lit(None).cast("string"), "org_top_level": F.col("nuts_label"), "estimated_value": F.lit(None).cast("double"),
        "awarded_amount": F.lit(None).cast("double"), "procedure": F.lit(""), "status_label": F.lit(None).cast("string"), "adjudicatario": F.lit(None).cast("string"), "funding_program": F.lit(""), "publication_date": F.date_format("publication_ts", "yyyy-MM-dd"),
    })
    return c.select("sid", render_summary().alias("content"))


@query("render_json", with_contracts("""SELECT sid, '{"title":"Contrato ' || sid || '","status_code":"' || status_code || '","contract_type_code":"' || contract_type_code || '","budget_amount":' || CAST(CAST(floor(budget_amount) AS BIGINT) AS VARCHAR)
  || CASE WHEN len(cpv) > 0 THEN ',"cpv":["' || array_to_string(cpv, '","') || '"]' ELSE '' END || '}' AS doc FROM contracts"""))
def _(spark, d):
    from almoneda.render import render_json

    c = contracts(spark, d, "customer", "cpv").withColumn("budget_amount", F.floor("budget_amount").cast("long")).withColumns({"title": F.concat(F.lit("Contrato "), "sid"), "adjudicatario": F.lit(None).cast("string"), "city": F.lit("")})
    return c.select("sid", render_json(["title", "status_code", "contract_type_code", "budget_amount", "cpv", "adjudicatario", "city"], always=["title", "status_code"]).alias("doc"))


@query("result_card", with_contracts("""SELECT sid, 'Contrato ' || sid AS title, coalesce(nullif(nuts_label, ''), nuts) AS location, array_to_string(coalesce(cpv, [])[1:8], ',') AS cpv8, CASE WHEN contracting_authority <> nuts_label THEN nuts_label END AS parent_org FROM contracts"""))
def _(spark, d):
    from almoneda.render import result_card

    c = contracts(spark, d, "customer", "nuts", "cpv").withColumns({"title": F.lit(""), "expediente": F.concat(F.lit("Contrato "), "sid"), "org_top_level": F.col("nuts_label"), "city": F.lit(None).cast("string")})
    return c.select("sid", *result_card())
