"""The engine's queries over the supplied tables, each with the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import bands, evidence, history, matching, scoring, series, stats, text
from ..session import shared_dir, staged
from ..streaming import events, findings

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _touches(spark, d):
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity").join(orders, "l_orderkey")


CHURN = "select l_partkey path, count(*) commits, sum(l_quantity) added, count(distinct o_custkey) authors from lineitem join orders on l_orderkey = o_orderkey group by 1"


@query(CHURN)
def churn_by_part(spark, d):
    return history.churn(_touches(spark, d), "l_partkey", "o_custkey", "l_quantity")


@query("select l_partkey path, count(*) commits, p_size weight, count(*) * p_size score from lineitem join orders on l_orderkey = o_orderkey join part on p_partkey = l_partkey where p_size > 0 group by 1, 3 having count(*) > 1 order by score desc, path limit 25")
def hotspots(spark, d):
    weights = _t(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("weight"))
    return history.hotspots(history.churn(_touches(spark, d), "l_partkey", "o_custkey", "l_quantity"), weights)


def _coupling_sql(path: str, support: int, confidence: float) -> str:
    return f"""with own as (select distinct l_orderkey c, {path} p from lineitem), small as (select * from own where c in (select c from own group by c having count(*) <= 30)),
    n as (select p, count(*) n from small group by p), pairs as (select x.p a, y.p b, count(*) co_changes from small x join small y on x.c = y.c and x.p < y.p group by 1, 2 having count(*) >= {support})
    select a, b, co_changes, round(co_changes / least(na.n, nb.n), 6) confidence from pairs join n na on na.p = a join n nb on nb.p = b where co_changes / least(na.n, nb.n) >= {confidence}"""


@query(_coupling_sql("l_suppkey", 25, 0.05))
def change_coupling(spark, d):
    return history.coupling(_t(spark, d, "lineitem"), "l_orderkey", "l_suppkey", support=25, confidence=0.05)


@query(_coupling_sql("l_partkey", 3, 0.0))
def change_coupling_parts(spark, d):
    return history.coupling(_t(spark, d, "lineitem"), "l_orderkey", "l_partkey", support=3, confidence=0.0)


@query(f"select count(*) files, count(*) filter (commits >= 3) settled, count(*) filter (commits >= 3 and authors = 1) single_author, count(*) filter (commits >= 5) busy from ({CHURN})")
def ownership_concentration(spark, d):
    return history.ownership(history.churn(_touches(spark, d), "l_partkey", "o_custkey", "l_quantity"))


def _lines(spark, d):
    return text.source_lines(_t(spark, d, "documents"), "doc_id", "text")


LINES = "lines as (select doc_id path, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) line_no from documents), norm as (select path, line_no, t, trim(regexp_replace(t, '\\s+', ' ', 'g')) line from lines)"
TRIVIAL = "(regexp_matches(line, '^[\\[\\](){};,]*$') or regexp_matches(line, '^(else|try|end|return|pass|break|continue)[:;{]?$'))"


@query(f"with {LINES} select path, count(*) n_lines, count(*) filter ({TRIVIAL}) n_trivial, count(distinct line) n_distinct from norm group by 1")
def line_normalise(spark, d):
    norm = _lines(spark, d).withColumn("line", text.collapse(F.col("text")))
    return norm.groupBy("path").agg(F.count("*").alias("n_lines"), F.count_if(text.trivial(F.col("line"))).alias("n_trivial"), F.countDistinct("line").alias("n_distinct"))


@query("select source, avg(case when n_chars <= 1200 then 0.0 when n_chars <= 2000 then 0.25 when n_chars <= 8000 then 0.5 when n_chars <= 14000 then 0.75 else 1.0 end) pressure, count(n_chars) units, count(*) filter (n_chars > 8000) failing, count(*) filter (n_chars > 2000 and n_chars <= 8000) warning from documents group by 1")
def line_bands(spark, d):
    docs = _t(spark, d, "documents").withColumn("status", bands.status(F.col("n_chars"), 2000, 8000)).withColumn("_k", F.struct("source"))
    counts = docs.groupBy("source").agg(F.count_if(F.col("status") == "fail").alias("failing"), F.count_if(F.col("status") == "warn").alias("warning"))
    return bands.pressure(docs, ["source"], {"n_chars": (2000, 8000)}).join(counts, "source")


WINDOWS = f"""{LINES}, useful as (select * from norm where line <> '' and not regexp_matches(line, '^(//|#|/\\*|\\*|"|'')')),
 w as (select path, line_no, list(line) over (partition by path order by line_no rows between current row and 3 following) ls from useful),
 blocks as (select path, line_no, md5(array_to_string(ls, chr(10))) block from w where len(ls) = 4 and len(list_distinct(ls)) > 1 and len(list_filter(ls, lambda x: not (regexp_matches(x, '^[\\[\\](){{}};,]*$') or regexp_matches(x, '^(else|try|end|return|pass|break|continue)[:;{{]?$')))) > 0),
 wins as (select * from blocks where block in (select block from blocks group by block having count(*) > 1))"""


@query(f"with {WINDOWS}, f as (select block, count(*) places, count(distinct path) files, min(path) first_path from wins group by 1) select f.block, places, files, first_path, (select min(line_no) from wins where wins.block = f.block and wins.path = f.first_path) first_line from f")
def clone_windows(spark, d):
    return text.clone_counts(text.clone_windows(_lines(spark, d), 4))


@query(f"""with recursive {WINDOWS}, runs as (select *, case when line_no - lag(line_no) over (partition by path order by line_no, block) <= 4 then 0 else 1 end nw from wins),
 isl as (select block, path, line_no, path || '#' || sum(nw) over (partition by path order by line_no, block rows unbounded preceding) i from runs),
 links as (select distinct x.block a, y.block b from isl x join isl y on x.i = y.i), reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
 comp as (select a block, min(b) g from reach group by a), spans as (select g, i, max(line_no) - min(line_no) + 4 span from isl join comp using (block) group by 1, 2)
 select comp.g group_id, count(distinct isl.block) n_blocks, count(distinct path) files, count(*) places, any_value(s.span) span from isl join comp using (block) join (select g, max(span) span from spans group by g) s on s.g = comp.g group by comp.g""")
def clone_groups(spark, d):
    return text.clone_groups(text.clone_windows(_lines(spark, d), 4), 4)


SHINGLES = "select distinct {key} k, array_to_string(w[i:i + {k} - 1], ' ') s from (select {key}, w, unnest(range(1, len(w) - {k} + 2)) i from (select {key}, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') w from {table}) where len(w) >= {k})"
SIX = SHINGLES.format(key="doc_id", k=6, table="documents")


@query(f"""with sh as ({SIX}), n as (select k, count(*) n from sh group by k), kept as (select s from sh group by s having count(*) between 2 and 12),
 cand as (select x.k a, y.k b from sh x join sh y on x.s = y.s and x.k < y.k where x.s in (select s from kept) group by 1, 2 having count(*) >= 3),
 com as (select a, b, count(*) c from cand join sh x on x.k = a join sh y on y.k = b and y.s = x.s group by 1, 2),
 sc as (select a, b, c / (na.n + nb.n - c) sim from com join n na on na.k = a join n nb on nb.k = b where c / (na.n + nb.n - c) >= 0.8),
 sides as (select a, b, sim, a own, b other from sc union all select a, b, sim, b, a from sc)
 select distinct a, b, round(sim, 6) similarity from (select *, row_number() over (partition by own order by sim desc, other) r from sides) where r = 1""")
def near_duplicates(spark, d):
    return text.similar_pairs(_t(spark, d, "documents"), "doc_id", "text", 6)


@query(f"""with sh as ({SHINGLES.format(key="doc_id", k=8, table="documents")}), it as ({SHINGLES.format(key="item_id", k=8, table="benchmark")}), n as (select k, count(*) total from it group by 1)
 select sh.k as key, it.k item, count(*) matched, any_value(total) total from sh join it using (s) join n on n.k = it.k group by 1, 2 having count(*) >= 0.5 * any_value(total)""")
def contamination(spark, d):
    return text.shared_passages(_t(spark, d, "documents"), "doc_id", "text", _t(spark, d, "benchmark"), "item_id", "text")


TERMS = "t as (select doc_id k, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) term from documents)"


@query(f"with {TERMS}, once as (select term from t group by term having count(*) = 1) select k as key, count(*) rare from t where term in (select term from once) group by 1")
def rare_terms(spark, d):
    found = text.terms(_t(spark, d, "documents"), "doc_id", "text")
    return found.groupBy("term").agg(F.count("*").alias("n"), F.min("key").alias("key")).filter("n = 1").groupBy("key").agg(F.count("*").alias("rare"))


@query(f"with {TERMS}, d as (select distinct doc_id k, lower(regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*')) name from documents), n as (select term, count(*) n from t group by 1) select k as key, name, coalesce(n, 0) occurs from d left join n on term = name where coalesce(n, 0) <= 1")
def dead_terms(spark, d):
    docs = _t(spark, d, "documents")
    declared = docs.select(F.col("doc_id").alias("key"), F.lower(F.regexp_extract("text", "[A-Za-z_][A-Za-z0-9_]*", 0)).alias("name")).distinct()
    return text.dead_terms(declared, text.terms(docs, "doc_id", "text"))


RULES = [("address", "[a-z0-9.]+@[a-z0-9.]+"), ("number", "[0-9]{1,3}(\\.[0-9]{1,3}){3}"), ("secret", "(?i)password|secret|token"), ("licence", "(?i)licen[cs]e|copyright")]


@query(f"with {LINES} " + " union all ".join(f"select {i} rule_no, '{n}' as rule, path, line_no, substr(trim(t), 1, 180) as text from norm where regexp_matches(t, '{p}')" for i, (n, p) in enumerate(RULES)))
def risk_matches(spark, d):
    return text.rule_matches(_lines(spark, d), RULES)


@query("with p as (select lang concern, source package, count(distinct doc_id) files, min(doc_id) example from documents group by 1, 2), m as (select concern, count(*) packages from p group by 1 having count(*) > 1) select concern, packages, package, files, example from p join m using (concern)")
def divergent_idioms(spark, d):
    return text.divergent(_t(spark, d, "documents"), "lang", "source", "doc_id")


@query("select lang, count(*) n from documents where doc_id in (select doc_id from labels) group by 1")
def pairing_semi(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))


@query("select lang, count(*) n from documents where doc_id not in (select doc_id from labels) group by 1")
def pairing_anti(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


@query("select distinct p_brand path, p_partkey start, p_size lines from part p where exists (select 1 from lineitem join part q on q.p_partkey = l_partkey where q.p_brand = p.p_brand and l_partkey + l_linenumber >= p.p_partkey and l_partkey + l_linenumber < p.p_partkey + p.p_size and l_quantity >= 45)")
def changed_range_semi(spark, d):
    part = _t(spark, d, "part")
    changed = _t(spark, d, "lineitem").filter("l_quantity >= 45").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("path"), (F.col("l_partkey") + F.col("l_linenumber")).alias("line"))
    return bands.touched(part.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("start"), F.col("p_size").alias("lines")), changed)


@query("select p_partkey, 'size' criterion, p_size::double as value, 40.0::double allowed from part where p_size > 40 union all select p_partkey, 'price', p_retailprice, 1500.0::double from part where p_retailprice > 1500")
def limit_breaches(spark, d):
    return bands.breaches(_t(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")), ["p_partkey"], {"size": 40, "price": 1500})


@query("select doc_id, coalesce(nullif(quality, 0), case when n_chars > 500 then 1 end)::int quality, coalesce(nullif(toxic, 0), case when n_chars > 900 then 2 end)::int toxic from labels join documents using (doc_id) where coalesce(nullif(quality, 0), case when n_chars > 500 then 1 end) is not null and coalesce(nullif(toxic, 0), case when n_chars > 900 then 2 end) is not null")
def complete_criteria(spark, d):
    labels = _t(spark, d, "labels").select("doc_id", F.expr("nullif(quality, 0)").alias("quality"), F.expr("nullif(toxic, 0)").alias("toxic"))
    built = _t(spark, d, "documents").select("doc_id", F.expr("case when n_chars > 500 then 1 end").alias("quality"), F.expr("case when n_chars > 900 then 2 end").alias("toxic"))
    return bands.complete_criteria(labels, built, ["doc_id"], ["quality", "toxic"])


COMBINED = """m as (select event_type concept, user_id unit, event_id % 3 tool, cast(value * 100 as bigint)::double as value, event_id seq from events),
 x as (select *, count(*) over (partition by concept, unit, tool) n, row_number() over (partition by concept, unit, tool order by seq) k from m),
 c as (select concept, case when n > 1 then unit || '@' || tool || '#' || k else unit::varchar end unit, avg(value) as value, min(value) low, max(value) high, count(distinct tool) n_tools from x group by 1, 2)"""


def _combined(spark, d):
    return bands.corroborate(_t(spark, d, "events").select(F.col("event_type").alias("concept"), F.col("user_id").alias("unit"), (F.col("event_id") % 3).alias("tool"), F.round(F.col("value") * 100).cast("double").alias("value"), F.col("event_id").alias("seq")))


@query(f"with {COMBINED} select concept, unit, round(value, 4) as value, low, high, n_tools from c")
def corroborate(spark, d):
    return _combined(spark, d).withColumn("value", F.round("value", 4))


@query(f"with {COMBINED} select concept, count(*) units, count(*) filter (n_tools = 1) single, round(avg(case when n_tools > 1 then (high - low) / coalesce(nullif(abs(value), 0.0), 1.0) end), 6) spread from c group by 1")
def agreement(spark, d):
    return bands.agreement(_combined(spark, d)).withColumn("spread", F.round("spread", 6))


@query("select r.source, max(case when r.i = floor(r.n * 0.5) then n_chars end) median, max(case when r.i = floor(r.n * 0.9) then n_chars end) p90, max(n_chars) largest from (select source, n_chars, row_number() over (partition by source order by n_chars) - 1 i, count(*) over (partition by source) n from documents) r group by 1")
def index_quantiles(spark, d):
    return bands.index_quantiles(_t(spark, d, "documents"), "source", "n_chars")


@query("select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 ordinal from orders")
def ordinals(spark, d):
    return matching.ordinals(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


SEGMENTS = "s as (select *, sum(nw) over (partition by user_id order by ts, event_id rows unbounded preceding) segment from (select *, case when lag(event_type) over w = event_type or row_number() over w = 1 then 0 else 1 end nw from events window w as (partition by user_id order by ts, event_id)))"


def _segments(spark, d):
    return series.segments(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])


@query(f"with {SEGMENTS} select user_id, segment::bigint segment, any_value(event_type) event_type, count(*) scans from s group by 1, 2")
def segments(spark, d):
    return _segments(spark, d).groupBy("user_id", "segment").agg(F.first("event_type").alias("event_type"), F.count("*").alias("scans"))


def _daily(spark, d):
    return _t(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("found"))


DAILY = "d as (select user_id, ts::date as day, list_sort(list(distinct event_type)) found from events group by 1, 2)"


@query(f"with {DAILY}, x as (select user_id, found, lag(found) over (partition by user_id order by day) b from d) select user_id, count(*) scans, sum(coalesce(len(list_filter(found, lambda v: not list_contains(b, v))), 0))::bigint introduced, sum(coalesce(len(list_filter(b, lambda v: not list_contains(found, v))), 0))::bigint cleared from x group by 1".replace("coalesce(len(list_filter(found", "case when b is null then 0 else 1 end * coalesce(len(list_filter(found"))
def debt_velocity(spark, d):
    return series.velocity(_daily(spark, d), ["user_id"], ["day"], "found")


@query("with w as (select user_id, date_trunc('week', ts) as wk, event_type from events group by 1, 2, 3), n as (select user_id, count(distinct wk) n from w group by 1) select user_id, event_type fingerprint from w join n using (user_id) group by 1, 2, n having count(*) = n")
def stability(spark, d):
    weekly = _t(spark, d, "events").groupBy("user_id", F.date_trunc("week", "ts").alias("week")).agg(F.collect_set("event_type").alias("found"))
    return series.stable(weekly, ["user_id"], "week", "found")


@query("""with x as (select user_id, count(*) n, arg_min(value, event_id) f, arg_max(value, event_id) l from events group by 1) select user_id, f as first, l as last,
 case when n < 2 or f is null or l is null then 'unknown' when f - 5 <= l + 5 and l - 5 <= f + 5 then 'indistinguishable' when l > f then 'improved' else 'worsened' end verdict from x""")
def trajectory(spark, d):
    events = _t(spark, d, "events").select("user_id", "event_id", "value", (F.col("value") - 5).alias("low"), (F.col("value") + 5).alias("high"))
    return series.trajectory(events, ["user_id"], ["event_id"], "value", "low", "high")


@query("""with y as (select o_custkey, year(o_orderdate) y, count(*) p, count(*) filter (o_orderpriority like '1%') f from orders group by 1, 2), x as (select o_custkey, arg_min(p, y) p0, arg_max(p, y) p1, arg_min(f, y) f0, arg_max(f, y) f1 from y group by 1)
 select o_custkey, case when p1 = 0 or p0 = 0 then 'unknown' when p1 > p0 * 1.05 and f1 / p1 > f0 / p0 then 'growing, worse' when p1 > p0 * 1.05 then 'growing, holding' when f1 / p1 > f0 / p0 then 'steady, worse' else 'steady, holding' end verdict from x""")
def growth(spark, d):
    yearly = _t(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("p"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("f"))
    return series.growth(yearly, ["o_custkey"], ["y"], "p", "f")


@query(f"with {SEGMENTS}, m as (select user_id, event_id, value, value - lag(value) over (partition by user_id, segment order by ts, event_id) moved from s) select verdict, count(*) n from (select case when moved is null then 'first' when abs(moved) < 0.05 then 'within' when moved > 0 then 'up' else 'down' end verdict from m) group by 1")
def run_movement(spark, d):
    return series.movement(_segments(spark, d), ["user_id", "segment"], ["ts", "event_id"], "value").groupBy("verdict").agg(F.count("*").alias("n"))


@query("with r as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r from events), p as (select user_id, event_type, max(case when r = 2 then value end) before, max(case when r = 1 then value end) as after from r where r <= 2 group by 1, 2) select * from p where before - after > 0.05")
def ratchet(spark, d):
    return series.ratchet(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "value")


@query("""with pr as (select distinct user_id, ts::date as day, event_type from events), sc as (select user_id, day, row_number() over (partition by user_id order by day) n from (select distinct user_id, day from pr)), l as (select user_id, max(n) ln from sc group by 1),
 h as (select user_id, event_type, n, ln, lead(n) over (partition by user_id, event_type order by n) nx from pr join sc using (user_id, day) join l using (user_id))
 select user_id, event_type, count(*) seen, count(*) filter (coalesce(nx, ln + 1) > n + 1) cleared, count(*) filter (nx > n + 1) returned from h group by 1, 2""")
def recurrence(spark, d):
    presence = _t(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type").distinct()
    return series.recurrence(presence, presence.select("user_id", "day"), ["user_id"], "day", "event_type")


def _in_turns(spark, rows, turn, turns, follow):
    """``rows`` appended to a log in ``turns`` writes (``turn``: the number of a row's write), each followed by a call of ``follow`` with the log as a stream; the last call's result."""
    folder = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    for n in range(turns):
        rows.filter(turn == n).write.mode("append").parquet(f"{folder}/log")
        out = follow(spark.readStream.schema(rows.schema).parquet(f"{folder}/log"), f"{folder}/stream")
    return out


@query(SQL["recurrence"])
def recurrence_stream(spark, d):
    own = _t(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type").distinct()
    days = own.groupBy("user_id", "day").agg(F.array_sort(F.collect_set("event_type")).alias("findings"))
    log = days.select(F.col("user_id").cast("string").alias("series"), F.row_number().over(Window.partitionBy("user_id").orderBy("day")).cast("long").alias("scan"), "findings")
    log = staged(log, "scans")  # each turn reads it
    longest = log.agg(F.max("scan")).first()[0] or 1
    found = _in_turns(spark, log, F.floor((F.col("scan") - 1) * 3 / longest), 3, findings.presence)
    ends = log.groupBy("series").agg(F.max("scan").alias("last"))
    return findings.live_recurrence(found, ends).select(F.col("series").cast("long").alias("user_id"), F.col("finding").alias("event_type"), "seen", "cleared", "returned")


@query(SQL["ratchet"])
def ratchet_stream(spark, d):
    place = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("/"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    log = _t(spark, d, "events").select(F.col("user_id").alias("series"), F.col("event_type").alias("name"), place.alias("place"), "value", F.col("ts").cast("timestamp").cast("long").alias("at"))
    first, last = log.agg(F.min("at"), F.max("at")).first()
    states = _in_turns(spark, log, F.floor((F.col("at") - (first or 0)) * 2 / max(1, (last or 0) - (first or 0) + 1)), 2, findings.latest)
    return findings.live_ratchet(states).select(F.col("series").cast("long").alias("user_id"), F.col("name").alias("event_type"), "before", "after")


@query("select event_id, user_id from (select *, row_number() over w - 1 r, count(*) over (partition by user_id) n from events window w as (partition by user_id order by ts, event_id)) where r % greatest(1, ceil((n - 1) / 9)) = 0 or r = n - 1")
def compact(spark, d):
    return series.compact(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], 10).select("event_id", "user_id")


@query("with c as (select user_id, event_id, v, sum((v is null)::int) over (partition by user_id order by ts, event_id rows unbounded preceding) run from (select *, case when event_id % 7 <> 0 then event_id end v from events)) select user_id, run::bigint run, count(*) n, arg_min(v, event_id) as first, arg_max(v, event_id) as last from c where v is not null group by 1, 2")
def null_runs(spark, d):
    points = _t(spark, d, "events").withColumn("v", F.expr("case when event_id % 7 <> 0 then event_id end"))
    out = series.runs(points, ["user_id"], ["ts", "event_id"], "v")
    return out


HALVES = """c as (select 'd' || doc_id fingerprint, md5(text) digest, source || n_chars as label, lang || (n_chars // 50) place from documents where doc_id % 2 = 0), k as (select 'd' || doc_id fingerprint, md5(text) digest, source || n_chars as label, lang || (n_chars // 50) place from documents where doc_id % 2 = 1),
 c1 as (select *, row_number() over (partition by digest order by fingerprint) n from c), k1 as (select *, row_number() over (partition by digest order by fingerprint) n from k), m1 as (select c1.fingerprint a, k1.fingerprint b, 1 tier from c1 join k1 using (digest, n)),
 c2 as (select *, row_number() over (partition by label order by fingerprint) n from c where fingerprint not in (select a from m1)), k2 as (select *, row_number() over (partition by label order by fingerprint) n from k where fingerprint not in (select b from m1)), m2 as (select c2.fingerprint a, k2.fingerprint b, 2 tier from c2 join k2 using (label, n)),
 c3 as (select *, row_number() over (partition by place order by fingerprint) n from c where fingerprint not in (select a from m1 union all select a from m2)), k3 as (select *, row_number() over (partition by place order by fingerprint) n from k where fingerprint not in (select b from m1 union all select b from m2)), m3 as (select c3.fingerprint a, k3.fingerprint b, 3 tier from c3 join k3 using (place, n)),
 m as (select * from m1 union all select * from m2 union all select * from m3)"""


def _halves(spark, d):
    found = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("fingerprint"), F.md5("text").alias("digest"), F.concat("source", F.col("n_chars").cast("string")).alias("label"), F.concat("lang", F.expr("n_chars div 50").cast("string")).alias("place"))
    current, known = (found.filter(F.col("doc_id") % 2 == r).drop("doc_id") for r in (0, 1))
    return current, known, matching.tiered_match(current, known, [["digest"], ["label"], ["place"]])


@query(f"with {HALVES} select a current, b known, tier from m")
def tiered_match(spark, d):
    return _halves(spark, d)[2]


@query(f"with {HALVES} select fingerprint, 'introduced' change from c where fingerprint not in (select a from m) union all select fingerprint, 'cleared' from k where fingerprint not in (select b from m)")
def baseline_diff(spark, d):
    return matching.baseline_diff(*_halves(spark, d))


@query("select coalesce(c.p, n.p) path, case when c.p is not null and n.p is not null then 'in-scope' when c.p is not null then 'out-of-scope' else 'unaddressed' end as scope from (select distinct l_partkey p from lineitem where l_quantity >= 49) c full join (select p_partkey p from part where p_size > 25) n on c.p = n.p")
def scope_conformance(spark, d):
    return matching.conformance(_t(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("path")), _t(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("path")))


@query("select l_partkey part, count(*) filter (l_returnflag = 'A' and l_linestatus = 'F' and l_quantity > 20) added, count(*) filter (l_returnflag = 'R' and l_linestatus = 'F' and l_quantity > 20) removed from lineitem group by 1 having removed > added")
def oracle_weakening(spark, d):
    lines = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.expr("case l_returnflag when 'A' then '+' when 'R' then '-' end").alias("side"), "l_linestatus", "l_quantity")
    return matching.weakened(lines, "part", "side", (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 20))


ASPECTS = """raw as (select c_nationkey nation, count(*) n, count(*) filter (o_orderpriority like '1%') u, count(*) filter (o_orderstatus = 'F') f, count(*) filter (o_totalprice > 300000) b from orders join customer on c_custkey = o_custkey group by 1),
 a as (select nation, 'file_size' aspect, round(5 * 4.35 / (u / n / 0.0871 + 4.35), 4) score, 'measured' state from raw union all select nation, 'duplication', round(5 * 4.35 / (f / n / 0.2973 + 4.35), 4), 'measured' from raw
 union all select nation, 'declaration_size', round(5 * 4.35 / (b / n / 0.0944 + 4.35), 4), case when nation % 5 = 0 then 'unknown' else 'measured' end from raw union all select nation, 'test_presence', case when u / n <= 0.15 then 1.5 when u / n <= 0.2 then 3.5 else 5.0 end, case when nation % 7 = 0 then 'not_applicable' else 'measured' end from raw)"""


def _aspects(spark, d):
    orders = _t(spark, d, "orders").join(_t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    raw = orders.groupBy("nation").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("u"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_totalprice") > 300000).alias("b"))
    rate = lambda c: F.col(c) / F.col("n")
    nat = F.col("nation")
    rows = [("file_size", F.round(scoring.curve(rate("u") / 0.0871), 4), F.lit("measured")), ("duplication", F.round(scoring.curve(rate("f") / 0.2973), 4), F.lit("measured")), ("declaration_size", F.round(scoring.curve(rate("b") / 0.0944), 4), F.when(nat % 5 == 0, "unknown").otherwise("measured")), ("test_presence", scoring.steps(rate("u"), [(0.15, 1.5), (0.2, 3.5)], 5.0), F.when(nat % 7 == 0, "not_applicable").otherwise("measured"))]
    return raw.select("nation", F.explode(F.array(*[F.struct(F.lit(a).alias("aspect"), s.alias("score"), t.alias("state")) for a, s, t in rows])).alias("x")).select("nation", "x.*")


WEIGHTS = "w(category, aspect, weight) as (values " + ", ".join(f"('{c}', '{a}', {x}::double)" for c, own in scoring.CATEGORIES.items() for a, x in own.items()) + ")"
ROLL = "round(sum(weight * case when state = 'measured' then score else {} end) / sum(weight) + 1e-9, 4)"
CATS = f"cat as (select nation, category, {ROLL.format(4.0)} score, {ROLL.format(0.0)} low, {ROLL.format(5.0)} high from a join w using (aspect) where state <> 'not_applicable' group by 1, 2)"


@query(f"with {ASPECTS}, {WEIGHTS}, {CATS} select * from cat")
def rollup_score(spark, d):
    return scoring.rollup(_aspects(spark, d), ["nation"])


@query(f"with {ASPECTS}, {WEIGHTS}, {CATS}, o as (select nation, round(avg(score) + 1e-9, 4) score, round(avg(low) + 1e-9, 4) low, round(avg(high) + 1e-9, 4) high from cat group by 1) select *, case when low >= 4.8 then 'A+' when low >= 4.5 then 'A' when low >= 4 then 'B' when low >= 3 then 'C' when low >= 2 then 'D' else 'F' end grade from o")
def grade(spark, d):
    return scoring.overall(scoring.rollup(_aspects(spark, d), ["nation"]), ["nation"]).withColumn("grade", scoring.letter(F.col("low")))


@query(f"""with {ASPECTS}, {WEIGHTS}, {CATS}, o as (select nation, round(avg(score) + 1e-9, 4) base from cat group by 1), sc as (select a.nation, s.aspect scenario, a.aspect, case when a.aspect = s.aspect then 5.0 else score end score, case when a.aspect = s.aspect and state <> 'not_applicable' then 'measured' else state end state from a cross join (select distinct aspect from a) s),
 c2 as (select nation, scenario, category, {ROLL.format(4.0)} score from sc join w using (aspect) where state <> 'not_applicable' group by 1, 2, 3) select nation, scenario aspect, round(round(avg(score) + 1e-9, 4) - any_value(base), 4) delta from c2 join o using (nation) group by 1, 2""")
def counterfactual_delta(spark, d):
    return scoring.counterfactual(_aspects(spark, d), ["nation"])


@query("select p_type, p_partkey, p_size, class_paths from (select *, row_number() over (partition by p_type order by p_size desc, p_partkey) r from part) join (select p_type, count(distinct p_brand) class_paths from part group by 1) using (p_type) where r = 1")
def one_per_class(spark, d):
    return series.one_per_class(_t(spark, d, "part"), "p_type", [F.desc("p_size"), F.col("p_partkey")], "p_brand").select("p_type", "p_partkey", "p_size", "class_paths")


@query("select round(median(l_quantity), 4) l_quantity, round(median(l_discount), 4) l_discount from lineitem")
def median_reference(spark, d):
    return stats.references(_t(spark, d, "lineitem"), ["l_quantity", "l_discount"])


RANKED = "r as (select toxic, n_chars, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2 rk from labels join documents using (doc_id))"


@query(f"with {RANKED}, s as (select count(*) filter (toxic = 1) n1, count(*) filter (toxic = 0) n0, sum(rk) filter (toxic = 1) r1 from r), t as (select sum(k * k * k - k) ties from (select count(*)::double k from r group by n_chars)), x as (select n1, n0, r1 - n1 * (n1 + 1) / 2 u, ties, n1 + n0 n from s, t) select n1, n0, u, round((abs(u - n1 * n0 / 2) - 0.5) / sqrt(n1 * n0 / 12.0 * (n + 1 - ties / (n * (n - 1)))) * sign(u - n1 * n0 / 2), 6) z from x")
def mann_whitney_u(spark, d):
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("toxic", "n_chars")
    return stats.mann_whitney(rows, "n_chars", "toxic")


@query("with r as (select rank() over (order by o_custkey) + (count(*) over (partition by o_custkey) - 1) / 2 x, rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2 y from orders) select round(corr(x, y), 6) rho from r")
def spearman(spark, d):
    return stats.spearman(_t(spark, d, "orders").select("o_custkey", "o_totalprice"), "o_custkey", "o_totalprice")


_HEX = "list_sum(list_transform(range(1, 8), lambda q: (strpos('0123456789abcdef', substr(h, q, 1)) - 1) * (16 ** (7 - q))::bigint))"


@query(f"""with v as (select c_nationkey g, c_acctbal::double v, row_number() over (partition by c_nationkey order by c_acctbal) - 1 i from customer), n as (select g, count(*) n, median(v) med from v group by 1),
 p as (select g, n, draw, unnest(range(1, n + 1)) j from (select g, n, unnest(range(1, 41)) draw from n)), h as (select g, draw, n, md5('7:' || g || ':' || draw || ':' || j) h from p),
 m as (select h.g, draw, median(v.v) m from (select g, draw, ({_HEX})::bigint % n i from h) h join v on v.g = h.g and v.i = h.i group by 1, 2)
 select n.g c_nationkey, round(med + 1e-9, 4) as median, low, high from n join (select g, round(quantile_cont(m, 0.025) + 1e-9, 4) low, round(quantile_cont(m, 0.975) + 1e-9, 4) high from m group by 1) b on b.g = n.g""")
def bootstrap_median(spark, d):
    return stats.bootstrap_median(_t(spark, d, "customer"), "c_nationkey", "c_acctbal", draws=40)


@query("select k, count(*) n from (select (props::json ->> 'k')::bigint k from events) group by 1")
def json_props(spark, d):
    return _t(spark, d, "events").select(F.from_json("props", "k bigint").getField("k").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


PAGE_PATH = "regexp_replace(url, '^[a-z]+://[^/]*/?', '')"


def _page_paths(spark, d):
    return _t(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/?", "").alias("path"))


@query(f"select page_id, {PAGE_PATH} path, regexp_matches('/' || {PAGE_PATH}, '/a[^/]*/') or regexp_matches('/' || {PAGE_PATH}, '[.]pdf$') or contains('/' || {PAGE_PATH} || '/', '/news/') excluded from pages")
def path_exclusion(spark, d):
    return _page_paths(spark, d).withColumn("excluded", paths.is_excluded(F.col("path"), ["a*/", "*.pdf", "news"]))


@query(f"select page_id, regexp_matches(lower({PAGE_PATH}), '(^|/)(tests|test|__tests__|spec|specs|acceptance|e2e)/|(^|/)test[_.][^/]*$|[.]pf$|(_test|[.]test|[.]spec|_spec)([.][^./]*)?$') is_test from pages")
def test_paths(spark, d):
    return _page_paths(spark, d).select("page_id", paths.is_test_path(F.col("path")).alias("is_test"))


@query("select event_type, date_trunc('day', ts) \"start\", count(*) records, round(sum(value), 4) total from events group by 1, 2")
def event_windows_stream(spark, d):
    counts = events.windowed(events.log_stream(spark, d, "events.parquet"), ["event_type"], late="60 days")
    return events.drained(counts, ["event_type", "start"]).withColumn("total", F.round("total", 4))


@query("select event_type from events group by 1 having count(distinct user_id) = (select count(distinct user_id) from events)")
def covered_by_all(spark, d):
    return evidence.covered_by_all(_t(spark, d, "events"), "user_id", "event_type")


@query("select source, (select count(distinct lang) from documents) - count(distinct lang) missing from documents group by 1")
def missing_languages(spark, d):
    return evidence.missing_from(_t(spark, d, "documents"), "source", "lang")


@query("select distinct o_custkey c_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def unresolved_references(spark, d):
    refs = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return evidence.unresolved(refs, _t(spark, d, "customer").filter("c_acctbal > 0"), "c_custkey")


@query("select lang, count(*) unread from documents where doc_id not in (select doc_id from labels) group by 1")
def unread_by_language(spark, d):
    return evidence.unread(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id", "lang")


_TYPES = ("click", "purchase", "view")


@query("select user_id, " + ", ".join(f"arg_max(value, event_id) filter (where event_type = '{t}') \"{t}\"" for t in _TYPES) + " from events group by 1")
def last_write_pivot(spark, d):
    return evidence.last_write(_t(spark, d, "events"), "user_id", "event_type", "value", "event_id", list(_TYPES))


@query("select conv_id from conversations group by 1 having count(distinct case when role in ('system', 'user') then role end) < 2")
def refused_groups(spark, d):
    return evidence.refused(_t(spark, d, "conversations"), "conv_id", "role", ["system", "user"])


@query(
    """with w as (select o_orderpriority, o_orderstatus, files, row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey) r
    from orders join (select l_orderkey, count(*) files from lineitem group by 1) on l_orderkey = o_orderkey)
    select o_orderpriority, count(*) fixes, median(files) median_files, round(avg(case when files > 4 then 1.0 else 0.0 end) + 1e-9, 6) broad_share
    from w where r <= 300 and o_orderstatus = 'F' group by 1 having count(*) >= 5"""
)
def fix_breadth(spark, d):
    files = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("files"))
    commits = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate").join(files, "o_orderkey")
    return evidence.fix_breadth(commits, "o_orderpriority", [F.desc("o_orderdate"), F.col("o_orderkey")], F.col("o_orderstatus") == "F", "files", broad=4)


@query(
    """select o_orderstatus, count(*) compared, count(*) filter (where a = b) agreed, round(count(*) filter (where a = b) / count(*) + 1e-9, 6) rate
    from (select l_orderkey, count(*) a, max(l_linenumber) b from lineitem group by 1) join orders on o_orderkey = l_orderkey group by 1"""
)
def measurer_agreement(spark, d):
    lines = _t(spark, d, "lineitem")
    a = lines.groupBy("l_orderkey").agg(F.count("*").alias("n")).join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    return evidence.agreement(a, lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n")), ["l_orderkey"], "n", "o_orderstatus")


@query("select case when p_size >= 40 then 'high' when p_size >= 20 then 'medium' when p_size >= 10 then 'low' else 'none' end severity, count(*) n from part group by 1")
def severity_histogram(spark, d):
    return evidence.histogram(_t(spark, d, "part"), "p_size", {"low": 10, "medium": 20, "high": 40})


@query("select source, count(distinct lang) versions from documents group by 1 having count(distinct lang) > 1")
def mixed_versions(spark, d):
    return evidence.mixed_versions(_t(spark, d, "documents"), "source", "lang")


@query("select l_suppkey, p_brand, count(distinct p_partkey) packages from lineitem join part on p_partkey = l_partkey where p_size >= 10 and p_retailprice >= 950 group by 1, 2")
def import_concerns(spark, d):
    part = _t(spark, d, "part")
    imports = _t(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey"))
    return evidence.concerns(imports, part.filter("p_retailprice >= 950"), part.filter("p_size < 10"), "l_suppkey", "p_partkey", "p_brand")


@query(
    """select tool, coalesce(sum(n), 0)::bigint files, case when coalesce(sum(n), 0) > 0 then 'runs' else 'no file in its languages' end reason
    from (values ('a', 'en'), ('a', 'fr'), ('b', 'de'), ('c', 'xx')) t(tool, l) left join (select lang, count(*) n from documents group by 1) on lang = l group by 1"""
)
def runnable_tools(spark, d):
    tools = spark.createDataFrame([("a", ["en", "fr"]), ("b", ["de"]), ("c", ["xx"])], "tool string, languages array<string>")
    return evidence.runnable(tools, _t(spark, d, "documents").select("lang", F.lit(1).alias("n")), "tool", "languages", "lang", "n")


@query(
    """select l_orderkey, l_linenumber, 'discounted' rule from lineitem where l_discount > 0.09
    union all select l_orderkey, l_linenumber, 'returned in bulk' from lineitem where l_returnflag = 'R' and l_quantity >= 48"""
)
def broken_rules(spark, d):
    rules = {"discounted": F.col("l_discount") > 0.09, "returned in bulk": (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 48)}
    return evidence.broken(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], rules)


@query("select doc_id, coalesce(quality, 1 - n_chars % 2)::bigint quality, case when quality is null then 'built-in' else 'external' end origin from documents left join labels using (doc_id)")
def verdict_overlay(spark, d):
    own = _t(spark, d, "documents").select("doc_id", (1 - F.col("n_chars") % 2).alias("quality"))
    return evidence.overlay(own, _t(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality")), ["doc_id"], "quality")


@query("select p_partkey, p_name from part where p_size = 7 and starts_with(p_type, 'S')")
def selected_items(spark, d):
    return evidence.select_items(_t(spark, d, "part"), ("p_type",), p_size=7, p_type="S").select("p_partkey", "p_name")


@query(
    """select l_orderkey, l_linenumber, 'l_quantity' criterion, l_quantity "value", 30.0 - l_quantity remaining from lineitem where l_returnflag = 'R'
    union all select l_orderkey, l_linenumber, 'l_tax', l_tax, 0.05 - l_tax from lineitem where l_returnflag = 'R'"""
)
def remaining_budgets(spark, d):
    return evidence.limits(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"l_quantity": 30, "l_tax": 0.05}, F.col("l_returnflag") == "R")


@query("select event_id, event_type || ':' || user_id || ':' || strftime(ts, '%Y-%m-%d') || '#' || row_number() over (partition by event_type, user_id, strftime(ts, '%Y-%m-%d') order by event_id) fingerprint from events")
def finding_fingerprints(spark, d):
    rows = _t(spark, d, "events").select("event_id", "event_type", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return evidence.fingerprints(rows, "event_type", "user_id", "day", "event_id").select("event_id", "fingerprint")


_NATION_ASPECTS = "select c_nationkey, count(*) n, round(avg(c_acctbal) + 1e-9, 2) balance, count(distinct c_mktsegment) segments from customer group by 1"


def _nation_aspects(spark, d):
    return _t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal") + 1e-9, 2).alias("balance"), F.count_distinct("c_mktsegment").alias("segments"))


@query(f"select c_nationkey, n, case when n >= 6 then balance end balance, case when n >= 60 then segments end segments from ({_NATION_ASPECTS})")
def undersupported_aspects(spark, d):
    return evidence.blanked(_nation_aspects(spark, d), "n", {"balance": 6, "segments": 60})


@query(
    f"""with a as (select c_nationkey, case when n >= 60 then segments end segments, n - n n from ({_NATION_ASPECTS}))
    select c_nationkey, 'segments' field, case when segments is null then 'missing' when segments = 0 then 'zero' else 'measured' end state from a
    union all select c_nationkey, 'n', 'zero' from a"""
)
def evidence_states(spark, d):
    rows = evidence.blanked(_nation_aspects(spark, d), "n", {"segments": 60}).withColumn("n", F.col("n") - F.col("n"))
    return evidence.states(rows, ["c_nationkey"], ["segments", "n"])


@query(
    """select l_suppkey, case when sum(l_tax) filter (where l_linenumber = 7) is not null then round(sum(l_tax) filter (where l_linenumber = 7) + 1e-9, 4)
    when count(*) > 60 then 1.0 else round((count(*) filter (where l_returnflag = 'R') + 0.3 * count(*) filter (where l_returnflag = 'A')) / count(*) + 1e-9, 4) end pressure from lineitem group by 1"""
)
def dimension_pressures(spark, d):
    counts = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.sum(F.when(F.col("l_linenumber") == 7, F.col("l_tax"))) + 1e-9, 4).alias("band"), F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.count_if(F.col("l_returnflag") == "A").alias("warned")
    )
    return counts.select("l_suppkey", F.round(evidence.pressure(F.col("band"), F.col("n") > 60, F.col("failed"), F.col("warned"), F.col("n")) + F.when(F.col("band").isNull(), 1e-9).otherwise(0.0), 4).alias("pressure"))


@query(
    """select c_nationkey, case when n < 3 or balance is null then least_letter else raw end grade from
    (select *, case when low >= 4 then 'A' when low >= 3 then 'B' else 'C' end raw, case when low >= 3 then 'B' else 'C' end least_letter from (select c_nationkey, count(*) n, case when count(*) >= 6 then 1 end balance, count(distinct c_mktsegment) low from customer group by 1))"""
)
def capped_grades(spark, d):
    rows = _t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_distinct("c_mktsegment").alias("low"))
    raw = F.when(F.col("low") >= 4, "A").when(F.col("low") >= 3, "B").otherwise("C")
    return rows.select("c_nationkey", evidence.capped(raw, (F.col("n") < 3) | (F.col("n") < 6)).alias("grade"))


@query(
    """select source, case when unread * 5 >= n then 'insufficient' when n < 45 or langs < 4 then 'incomplete' else 'complete' end sufficiency,
    concat_ws(', ', case when n < 45 then 'few files' end, case when langs < 4 then 'languages missing' end) reasons
    from (select source, count(*) n, count(*) filter (where n_chars < 200) unread, count(distinct lang) langs from documents group by 1)"""
)
def sufficiency(spark, d):
    rows = _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 200).alias("unread"), F.count_distinct("lang").alias("langs"))
    out = evidence.sufficiency(rows, F.col("unread") / F.col("n"), {"few files": F.col("n") < 45, "languages missing": F.col("langs") < 4})
    return out.select("source", "sufficiency", F.concat_ws(", ", "reasons").alias("reasons"))


@query("select p_partkey, case when p_size > 45 then 'major' when p_partkey in (select l_partkey from lineitem where l_quantity = 50) then 'escalated' end reason from part")
def withheld_items(spark, d):
    escalated = _t(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return evidence.withheld(_t(spark, d, "part"), escalated, "p_partkey", F.col("p_size") > 45).select("p_partkey", "reason")


@query("select source from documents group by 1 having count(*) filter (where lang = 'en') >= 2 and count(*) filter (where lang = 'en') > count(*) filter (where lang = 'fr') and count(*) > count(*) filter (where lang in ('en', 'fr'))")
def asset_directories(spark, d):
    return evidence.asset_directories(_t(spark, d, "documents"), "source", "lang", ["en"], ["fr"])


_ROLE = "count(*) units, count(*) filter (n_chars > 6000) size_fail, count(*) filter (n_chars > 2000 and n_chars <= 6000) size_warn, avg(case when n_chars <= 1200 then 0.0 when n_chars <= 2000 then 0.25 when n_chars <= 6000 then 0.5 when n_chars <= 10000 then 0.75 when n_chars is not null then 1.0 end) size_pressure, count(*) filter (w > 900) words_fail, count(*) filter (w > 300 and w <= 900) words_warn, avg(case when w <= 180 then 0.0 when w <= 300 then 0.25 when w <= 900 then 0.5 when w <= 1500 then 0.75 when w is not null then 1.0 end) words_pressure"


@query(f"""with u as (select lang, source like '%3' t, n_chars, case when doc_id % 7 <> 0 then len(string_split(text, ' ')) end w from documents)
 select lang, case when grouping(t) = 1 then 'all' when t then 'test' else 'production' end as role, {_ROLE} from u group by grouping sets ((lang), (lang, t))""")
def counts_by_role(spark, d):
    docs = _t(spark, d, "documents").withColumn("w", F.when(F.col("doc_id") % 7 != 0, F.size(F.split("text", " "))))
    return bands.counts_by_role(docs, ["lang"], F.col("source").endswith("3"), {"size": ("n_chars", 2000, 6000), "words": ("w", 300, 900)})


_RENAMES = "(select l_orderkey::bigint * 10 + l_linenumber s, 'p' || (l_partkey % 60) old, 'p' || (l_suppkey % 60) as new from lineitem where l_partkey % 60 <> l_suppkey % 60)"


@query(f"""with recursive r as (select s, old, min(new) as new from {_RENAMES} group by 1, 2), e as (select old p, s, 1 leaves, old, new from r union all select new, s, 0, old, new from r),
 x as (select *, min(case when leaves = 1 then s end) over (partition by p order by s, leaves desc rows between 1 following and unbounded following) t, row_number() over (partition by p order by s, leaves desc) n from e),
 nx as (select old, s, new, t from x where leaves = 0), walk(p, pl, t) as (select x.p, nx.new, nx.t from x join nx on nx.old = x.p and nx.s = x.s where x.leaves = 1 and x.n = 1 union all select walk.p, nx.new, nx.t from walk join nx on nx.old = walk.pl and nx.s = walk.t)
 select p as old, pl as new from walk where t is null and p <> pl""")
def rename_map(spark, d):
    rows = _t(spark, d, "lineitem").select((F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("p"), F.col("l_partkey") % 60).alias("old"), F.concat(F.lit("p"), F.col("l_suppkey") % 60).alias("new"))
    return matching.rename_map(rows)


from . import code_catalogue, report_catalogue, score_catalogue  # noqa: E402, F401  register their queries here
