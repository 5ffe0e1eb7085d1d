"""Queries of ordered lists, work items, tails, readers and sniffers over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import reports, stats, text
from ..session import shared_dir
from ..sources import readers, sinks
from ..sources import tool_reports as reports_source
from .catalogue import _t, query


@query("select path, lines, place, n_total from (select source || '/' || doc_id path, n_chars lines, row_number() over (order by n_chars desc, string_split(source || '/' || doc_id, '/')) place, count(*) over () n_total from documents where source is not null) where place <= 25")
def largest_files(spark, d):
    rows = _t(spark, d, "documents").filter("source is not null").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("lines"))
    return reports.largest_files(rows)


@query("""with c as (select p_brand block, p_type path, p_partkey start, p_size lines from part), n as (select block, count(*) n, max(lines) lines from c group by 1), best as (select *, row_number() over (order by n desc, lines desc, block) place, count(*) over () n_total from n),
 few as (select *, row_number() over (partition by block order by path, start) r from c)
 select b.block, n, b.lines, place, n_total, (select string_agg(path || ':' || start, ' ' order by path, start) from few f where f.block = b.block and r <= 10) locations from best b where place <= 25""")
def clone_list(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_brand").alias("block"), F.col("p_type").alias("path"), F.col("p_partkey").alias("start"), F.col("p_size").alias("lines"))
    return reports.clone_list(rows).withColumn("locations", F.array_join(F.transform("locations", lambda x: F.concat_ws(":", x["path"], x["start"].cast("string"))), " "))


_RULES = ["error", "view", "click"]


@query("select rule, path, line, place, n_total from (select event_type rule, user_id path, event_id line, row_number() over (order by list_position(['error', 'view', 'click'], event_type), user_id, event_id) place, count(*) over () n_total from events where event_type in ('error', 'view', 'click')) where place <= 100")
def risk_list(spark, d):
    rows = _t(spark, d, "events").filter(F.col("event_type").isin(*_RULES)).select(F.col("event_type").alias("rule"), F.col("user_id").alias("path"), F.col("event_id").alias("line"))
    return reports.rule_findings(rows, _RULES)


@query("select a, b, co_changes, confidence, place, n_total from (select *, row_number() over (order by co_changes desc, confidence desc, '[''' || a || ''', ''' || b || ''']') place, count(*) over () n_total from (select c_mktsegment a, 'n' || c_nationkey b, count(*) co_changes, round(avg(c_acctbal) / 10000 + 1e-9, 2) confidence from customer group by 1, 2)) where place <= 25")
def coupled_list(spark, d):
    rows = _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b")).agg(F.count("*").alias("co_changes"), F.round(F.avg("c_acctbal") / 10000 + 1e-9, 2).alias("confidence"))
    return reports.coupled(rows)


@query("select source, arg_max(lang, (n, lang)) dimension, max(n) / 12.0::double pressure from (select source, lang, count(*) n from documents where lang is not null group by 1, 2) group by 1 having max(n) > 12")
def worst_dimension(spark, d):
    counts = _t(spark, d, "documents").filter("lang is not null").groupBy("source", F.col("lang").alias("dimension")).agg(F.count("*").alias("n"))
    return reports.worst_dimension(counts.select("source", "dimension", reports.normalised(F.col("n").cast("double"), F.lit(12.0)).alias("pressure")), "source")


_PRICES = [("oversized-declaration", 4, 2, 0.4), ("oversized-file", 3, 3, 0.2), ("risk-pattern", 5, 1, 0.7), ("competing-libraries", 2, 4, 0.1)]
_ITEMS = """items as (select 'oversized-declaration' class, 'p' || p_partkey path, p_name label, (p_size + 4 * (p_partkey % 9))::double severity from part where p_size > 30
 union all select 'oversized-file', 's' || s_suppkey, 's' || s_suppkey, s_suppkey::double from supplier union all select 'risk-pattern', 'c' || c_custkey, c_name, 1.0 from customer where c_custkey % 10 = 0 union all select 'competing-libraries', n_name, n_name, 1.0 from nation)"""


@query(f"""with {_ITEMS}, prices(class, risk, effort, worth) as (values {', '.join(f"('{c}', {r}, {e}, {w}::double)" for c, r, e, w in _PRICES)}), b as (select *, case when risk >= 3 and effort < 3 then 'quick-win' when risk >= 3 then 'major-project' when effort < 3 then 'fill-in' else 'reconsider' end band from items join prices using (class))
 select class, path, label, severity, worth, band, list_position(['quick-win', 'major-project', 'fill-in', 'reconsider'], band) band_rank, case when row_number() over (partition by class order by severity desc, path, label) = 1 then worth end class_worth from b where band <> 'reconsider'""")
def work_order(spark, d):
    part, supplier, customer, nation = (_t(spark, d, x) for x in ("part", "supplier", "customer", "nation"))
    items = reports.all_items(
        reports.items_of_declarations(part.filter("p_size > 30").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.col("p_name").alias("name"), F.col("p_size").alias("lines"), (F.col("p_partkey") % 9).alias("cyclomatic"))),
        reports.items_of_files(supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("path"), F.col("s_suppkey").alias("lines"))),
        reports.items_of_findings(customer.filter("c_custkey % 10 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("path"), F.col("c_name").alias("message"), F.lit(1).alias("line")), "risk-pattern"),
        reports.items_of_findings(nation.select(F.col("n_name").alias("path"), F.col("n_name").alias("message"), F.lit(1).alias("line")), "competing-libraries"),
    )
    return reports.work_order(items, spark.createDataFrame(_PRICES, "class string, risk int, effort int, worth double")).drop("line")


@query("with h as (select l_partkey path, count(*) commits from lineitem group by 1 order by count(*) * (l_partkey % 7) desc, l_partkey limit 25) select p_partkey path, 'f' || p_size fingerprint, 10 * coalesce(case when p_size % 10 = 0 then p_size // 10 end, 0) + coalesce(commits, 0) exposure from part left join h on h.path = p_partkey")
def exposed_items(spark, d):
    churn = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("commits")).withColumn("score", F.col("commits") * (F.col("path") % 7))
    returns = spark.range(1, 6).select(F.concat(F.lit("f"), F.col("id") * 10).alias("fingerprint"), F.col("id").alias("returned"))
    items = _t(spark, d, "part").select(F.col("p_partkey").alias("path"), F.concat(F.lit("f"), "p_size").alias("fingerprint"))
    return reports.exposed(items, churn, returns).select("path", "fingerprint", "exposure")


_POLICY = [("returned-to-none", "^R$", "^N$"), ("any-to-accepted", ".", "^A$")]


@query("select case when k = 1 then 'returned-to-none' else 'any-to-accepted' end as rule, l_orderkey path, l_linenumber line, l_returnflag actual, nxt required from (select *, unnest([1, 2]) k from (select l_orderkey, l_linenumber, l_returnflag, lead(l_returnflag) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) nxt from lineitem)) where l_returnflag <> nxt and ((k = 1 and l_returnflag = 'R' and nxt = 'N') or (k = 2 and nxt = 'A'))")
def policy_breaks(spark, d):
    from pyspark.sql import Window

    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("actual"), F.lead("l_returnflag").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("required"))
    return reports.policy_breaks(rows, _POLICY)


@query("select distinct p_partkey path from part where p_partkey not in (select l_partkey from lineitem where l_linenumber < 3)")
def unknown_paths(spark, d):
    return reports.unknown_paths(_t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path")), _t(spark, d, "lineitem").filter("l_linenumber < 3").select(F.col("l_partkey").cast("string").alias("path"))).select(F.col("path").cast("long").alias("path"))


_SCANS = "d as (select user_id, ts::date as day, list_sort(list(distinct event_type)) found, sum(value) total, count(*) % 2 kind from events group by 1, 2), s as (select *, case when kind = lag(kind) over w or lag(kind) over w is null then 0 else 1 end nw from d window w as (partition by user_id order by day)), g as (select *, (sum(nw) over (partition by user_id order by day rows unbounded preceding))::bigint segment from s)"


def _scans(spark, d):
    return _t(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("found"), F.sum("value").alias("total"), (F.count("*") % 2).alias("kind"))


@query(f"with {_SCANS}, l as (select user_id, max(segment) segment from g group by 1), e as (select user_id, count(*) n, round(arg_min(total, day), 4) as first, round(arg_max(total, day), 4) as last from g join l using (user_id, segment) group by 1) select *, case when n < 2 then 'none' when last > first then 'up' when last < first then 'down' else 'flat' end direction from e")
def latest_tail(spark, d):
    out = reports.tail(_scans(spark, d).withColumn("total", F.round("total", 4)), ["user_id"], ["day"], "total", ["kind"])
    return out.select("user_id", "n", "first", "last", "direction")


@query(f"with {_SCANS}, x as (select *, lag(found) over (partition by user_id, segment order by day) b from g) select user_id, segment, count(*) scans, round(arg_min(total, day), 4) as first, round(arg_max(total, day), 4) as last, sum(case when b is null then 0 else len(list_filter(found, lambda v: not list_contains(b, v))) end)::bigint introduced, sum(case when b is null then 0 else len(list_filter(b, lambda v: not list_contains(found, v))) end)::bigint cleared from x group by 1, 2")
def trend_report(spark, d):
    return reports.trend_report(_scans(spark, d).withColumn("total", F.round("total", 4)), ["user_id"], ["day"], ["kind"], "total", "found").select("user_id", "segment", "scans", "first", "last", "introduced", "cleared")


@query("with r as (select toxic, n_chars from labels join documents using (doc_id)), e as (select max(lo) lo, min(hi) hi from (select min(n_chars) lo, max(n_chars) hi from r group by toxic)) select toxic, count(*) n, min(n_chars) lo, max(n_chars) hi from r, e where n_chars between e.lo and e.hi group by 1")
def size_band(spark, d):
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("toxic", "n_chars")
    return reports.size_band(rows, "toxic", "n_chars").groupBy("toxic").agg(F.count("*").alias("n"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))


@query("select coalesce(a.p_partkey, b.p_partkey) path, coalesce(a.h, b.h) hash from (select p_partkey, p_size h from part where p_partkey % 3 <> 0) a full join (select p_partkey, p_size + (p_partkey % 5 = 0)::int h from part where p_partkey % 4 <> 0) b on a.p_partkey = b.p_partkey and a.h = b.h where a.h is null or b.h is null")
def changed_state(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("int").alias("hash"))
    return reports.changed_state(part.filter("path % 3 <> 0"), part.filter("path % 4 <> 0").withColumn("hash", F.col("hash") + (F.col("path") % 5 == 0).cast("int")))


_BREAKS = ["\n", "\r\n", "\r", "\u2028", "\x0b", "\x0c", "\x85"]


@query("""select doc_id, len(regexp_extract_all(t, '\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]')) + case when t = '' or regexp_matches(t, '[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]\\z') then 0 else 1 end n_lines
 from (select doc_id, replace(coalesce(text, ''), chr(10), [chr(10), chr(13) || chr(10), chr(13), chr(8232), chr(11), chr(12), chr(133)][doc_id % 7 + 1]) || case when doc_id % 3 = 0 then chr(13) else '' end t from documents)""")
def split_lines(spark, d):
    """Whole texts with breaks of every kind in place of their own; a break at the end, which every third text gets, begins no line."""
    brk = F.element_at(F.array(*map(F.lit, _BREAKS)), (F.col("doc_id") % 7 + 1).cast("int"))
    whole = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), brk), F.when(F.col("doc_id") % 3 == 0, "\r").otherwise(""))
    rows = _t(spark, d, "documents")
    return rows.select("doc_id", F.size(text.split_lines(whole)).alias("n_lines"))


@query("select 'src/f' || p_partkey || '.ts' path, p_size line, p_partkey % 80 + 1 as column, 'TS2345' code, 'A' || p_partkey % 4 actual, p_brand required from part where p_size % 3 = 0")
def compiler_diagnostics(spark, d):
    rows = _t(spark, d, "part")
    line = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("src\\f"), "p_partkey", F.lit(".ts("), "p_size", F.lit(","), F.col("p_partkey") % 80 + 1, F.lit("): error TS2345: Argument of type 'A"), F.col("p_partkey") % 4, F.lit("' is not assignable to parameter of type '"), "p_brand", F.lit("'."))).otherwise(F.lit("Found 3 errors."))
    files = rows.select(F.col("p_partkey").cast("string").alias("file"), F.concat(line, F.lit("\nnote\n"), line).alias("text"))
    return readers.diagnostics(files).select("path", "line", "column", "code", "actual", "required")


@query("select 's' || s_suppkey file, 3 + s_suppkey % 4 as no, 1 + s_suppkey % 4 width, 3 wanted from supplier where s_suppkey % 4 <> 2 union all select 's' || s_suppkey, 9 + s_suppkey % 4, 3, 2 from supplier")
def ragged_tables(spark, d):
    rows = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    blank = F.expr("repeat('\n', cast(k % 4 as int))")
    text_ = F.concat(blank, F.lit("| a | b | c |\n|---|:-:|--|\n"), F.expr("concat('|', repeat(' x |', cast(1 + k % 4 as int)), '\n')"), F.lit("|1|2\\|2|3|\n\nprose\n\n| p | q |\n| 1 | 2 | 3 |\n"))
    return readers.ragged_rows(readers.table_rows(rows.select(F.concat(F.lit("s"), "k").alias("file"), text_.alias("text"))))


@query("select p_partkey path, metric, case metric when 'lines' then p_size else case metric when 'complexity' then p_partkey % 20 else p_size % 4 end end::double as value from part, (values ('lines'), ('complexity'), ('parameters')) m(metric) where p_size > 0")
def csv_metrics(spark, d):
    rows = _t(spark, d, "part").select(F.lit("r.csv").alias("file"), F.concat_ws(",", "p_size", F.col("p_partkey") % 20, F.lit(7), F.col("p_size") % 4, F.lit(9), F.lit('"f@1-9@x"'), F.col("p_partkey").cast("string"), F.lit('"f, g"'), F.lit("x"), F.lit(1), F.lit(9)).alias("text"))
    return readers.csv_metrics(rows).select(F.col("path").cast("long").alias("path"), "metric", "value")


@query("select n, c as commit from (select o_orderkey::varchar c, row_number() over (order by o_orderkey) n from orders) where (n - 1) % 10 = 0 and c not in (select o_orderkey::varchar from orders where o_orderstatus = 'F')")
def commits_to_measure(spark, d):
    orders = _t(spark, d, "orders")
    log = stats.numbered(orders.select("o_orderkey"), "o_orderkey").select(F.col("o_orderkey").cast("string").alias("commit"), "n")
    return readers.commits_to_measure(log, orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("commit")), 10)


@query("""select tool, rule, level, count(*) n, sum(line) lines, min(path) first_path, min(message) first_message from (
 select 'orders' tool, o_orderpriority as rule, null as level, 'o/' || o_custkey path, o_orderkey line, 'status ' || o_orderstatus message from orders
 union all select 'scan' || s_nationkey, 'r' || (s_suppkey % 3), case when s_acctbal < 0 then 'error' else 'warning' end, 's/' || s_suppkey, s_suppkey + 1, 'phone "' || s_name || '"' from supplier
 union all select 'lint', null, null, 'c/' || c_custkey || '.py', nullif(c_custkey, 0), c_mktsegment from customer) group by 1, 2, 3""")
def tool_reports(spark, d):
    """Reports of three kinds are written from the tables and read back as one source: lines of JSON, SARIF documents of a tool each, and lines of text."""
    folder = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    orders, supplier, customer = (_t(spark, d, n) for n in ("orders", "supplier", "customer"))
    item = F.to_json(F.struct(F.concat(F.lit("o/"), "o_custkey").alias("file"), F.struct(F.col("o_orderkey").alias("row")).alias("at"), F.concat(F.lit("status "), "o_orderstatus").alias("text"), F.col("o_orderpriority").alias("code")))
    orders.select(item.alias("value")).write.text(f"{folder}/orders")
    findings = supplier.select(F.concat(F.lit("scan"), "s_nationkey").alias("tool"), F.concat(F.lit("r"), F.col("s_suppkey") % 3).alias("rule"), F.concat(F.lit('phone "'), "s_name", F.lit('"')).alias("message"), F.concat(F.lit("s/"), "s_suppkey").alias("path"), (F.col("s_suppkey") + 1).alias("line"), F.when(F.col("s_acctbal") < 0, "fail").otherwise("warn").alias("status"))
    # A document holds the results of a tool among 5,000 keys.
    driver = F.to_json(F.struct(F.struct(F.col("tool").alias("name")).alias("driver")))
    results = sinks.sarif_results(findings.withColumn("document", F.floor(F.col("line") / 5000)), "tool", "document").groupBy("tool", "document").agg(F.concat_ws(",", F.collect_list("result")).alias("results"))
    documents = results.select("tool", F.concat(F.lit('{"runs":[{"tool":'), driver, F.lit(',"results":['), "results", F.lit("]}]}")).alias("value"))
    documents.write.partitionBy("tool").option("maxRecordsPerFile", 1).text(f"{folder}/sarif")
    customer.select(F.concat(F.lit("c/"), "c_custkey", F.lit(".py:"), "c_custkey", F.lit(": "), "c_mktsegment").alias("value")).write.text(f"{folder}/lint")
    read = lambda name, kind, **more: reports_source.tool_reports(spark, f"{folder}/{name}", kind, tool=name, **more)
    rows = read("orders", "jsonl", keys="file,at.row,text", splitBytes=1 << 20).unionByName(read("sarif", "sarif")).unionByName(read("lint", "text", splitBytes=1 << 20))
    return rows.groupBy("tool", "rule", "level").agg(F.count("*").alias("n"), F.sum("line").alias("lines"), F.min("path").alias("first_path"), F.min("message").alias("first_message"))


def _tracks_sql(scans: int) -> str:
    """What follows the rows of ``h`` (g, no, id, fingerprint, rule, path, line) through so many scans, ending with ``r`` (g, no, track)."""
    kept, parts = "fingerprint, rule, path, line", ["s0 as (select g, 0::bigint track, fingerprint, rule, path, line from h where false)"]
    for n in range(1, scans + 1):
        parts.append(f"h{n} as materialized (select * from h where no = {n})")
        left, free = f"h{n}", f"s{n - 1}"
        for i, keys in enumerate(reports.TRACK_TIERS):
            k = ", ".join(keys)
            number = "row_number() over (partition by g, {k} order by line nulls first, fingerprint nulls first, {last}) n"
            parts.append(f"x{n}_{i} as materialized (select g, id, track from (select g, {k}, id, {number.format(k=k, last='id')} from {left}) a join (select g, {k}, track, {number.format(k=k, last='track')} from {free}) b using (g, {k}, n))")
            parts.append(f"l{n}_{i} as materialized (select * from {left} anti join x{n}_{i} using (g, id)), f{n}_{i} as materialized (select * from {free} anti join x{n}_{i} using (g, track))")
            left, free = f"l{n}_{i}", f"f{n}_{i}"
        taken = " union all ".join(f"select * from x{n}_{i}" for i in range(len(reports.TRACK_TIERS)))
        parts.append(f"t{n} as materialized ({taken} union all select g, id, coalesce(c, 0) + row_number() over (partition by g order by id) - 1 from {left} left join (select g, count(*) c from s{n - 1} group by 1) using (g))")
        parts.append(f"now{n} as materialized (select g, no, track, {kept} from h{n} join t{n} using (g, id)), s{n} as materialized (select g, track, {kept} from s{n - 1} anti join now{n} using (g, track) union all select g, track, {kept} from now{n})")
    return ", ".join(parts) + ", r as (" + " union all ".join(f"select g, no, track, fingerprint from now{n}" for n in range(1, scans + 1)) + ")"


@query(f"""with h as materialized (select *, row_number() over (order by g, path, line, fingerprint, rule) id from (select event_type as g, (day(ts) - 1) // 5 + 1 no, user_id || ':' || floor(value)::bigint fingerprint, 'r' || user_id % 3 as rule, 'u' || user_id // 10 path, hour(ts) line from events)), {_tracks_sql(6)}
 select g series, track, count(*) scans, min(no) as first, max(no) as last, min(fingerprint) label from r group by 1, 2""")
def finding_tracks(spark, d):
    """The events of each type as findings of a scan every five days, followed as tracks: how often each stood, from when to when."""
    ts, user = F.col("ts"), F.col("user_id")
    rows = _t(spark, d, "events").select(F.col("event_type").alias("series"), F.floor((F.dayofmonth(ts) - 1) / 5 + 1).alias("scan"), F.concat(user.cast("string"), F.lit(":"), F.floor("value").cast("string")).alias("fingerprint"), F.concat(F.lit("r"), user % 3).alias("rule"), F.concat(F.lit("u"), F.floor(user / 10).cast("string")).alias("path"), F.hour(ts).alias("line"))
    return reports.tracks(rows, "series").groupBy(F.col("by").alias("series"), "track").agg(F.count("*").alias("scans"), F.min("scan").alias("first"), F.max("scan").alias("last"), F.min("fingerprint").alias("label"))
