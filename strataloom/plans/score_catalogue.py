"""Queries of the scorer over summaries made from the supplied tables, with SQL that is written from the same fixed values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration, scoring, workorder
from ..operators import scorecard as sc
from ..operators.reports import BANDS
from .catalogue import _t, query

_FIELDS = {
    # name: (SQL, Spark expression) over one customer's orders; some are null, some zero.
    "files": "count(*) * 20",
    "declarations": "count(*) * 100",
    "production_declarations": "case when k % 11 <> 0 then count(*) * 100 - count(*) * (k % 5) * 8 end",
    "file_band_pressure": "case when k % 7 <> 0 then (k % 9) * 0.02 end",
    "declaration_band_pressure": "(k % 6) * 0.015",
    "duplicate_blocks": "case when k % 13 <> 1 then (k % 4) * count(*) end",
    "risk_findings": "(k % 3) * 2",
    "gate_failures": "case when k % 10 = 3 then 1 else 0 end",
    "coupled_pairs": "(k % 5)",
    "hotspots": "(k % 4)",
    "files_changed": "case when k % 8 <> 5 then (k % 3) * 40 end",
    "single_author_files": "(k % 7)",
    "settled_files": "case when k % 6 = 0 then 0 else 10 end",
    "test_files": "case when k % 9 = 2 then null when k % 9 = 4 then 0 else 5 end",
    "dead_declarations": "(k % 4)",
    "near_duplicates": "(k % 5) * 3",
    "divergent_concerns": "case when k % 17 <> 3 then k % 4 end",
    "file_failures": "(k % 2)",
    "file_warnings": "(k % 3)",
    "declaration_failures": "0",
    "declaration_warnings": "(k % 5)",
    "coverage_percent": "case when k % 2 = 0 then 60 + k % 40 end",
    "has_readme": "k % 12 <> 1",
    "has_changelog": "case when k % 14 <> 2 then k % 3 = 0 end",
    "has_docs": "k % 2 = 1",
    "unpaired_hotspot": "k % 4 = 3",
}
_SUMMARY = "select k, " + ", ".join(f"{v} {k}" for k, v in _FIELDS.items()) + " from (select o_custkey k from orders) group by k"


def summary(spark, d):
    rows = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("_n"))
    return rows.select("k", *[F.expr(v.replace("count(*)", "_n")).alias(name) for name, v in _FIELDS.items()])


def _d(name: str) -> str:
    return f"({name})::double"


def _shown(value: str) -> str:
    return f"round(greatest(0.0, least(5.0, {value})) + 1e-9, 1)"


def _ladder(rate: str, name: str) -> str:
    ladder, floor = sc.LADDERS[name]
    return f"case when {rate} is null then null " + " ".join(f"when {rate} <= {c} then {s}::double" for c, s in ladder) + f" else {floor}::double end"


def _share(a: str, b: str) -> str:
    return f"(case when {_d(b)} > 0 then {_d(a)} / {_d(b)} end)"


_PRESSURES = {"file_size": _d("file_band_pressure"), "declaration_size": _d("declaration_band_pressure"), "duplication": _share("duplicate_blocks", "files"), "risk_patterns": _share("risk_findings", "files"), "policy_gates": _share("gate_failures", "files")}
_CURVES = {k: f"case when {p} is not null then {_shown(f'greatest(0.0, least(5.0, 5 * 4.35 / ({p} / {sc.REFERENCES[k]} + 4.35)))')} end" for k, p in _PRESSURES.items()}
_ASPECTS = _CURVES | {
    "change_coupling": _ladder(_share("coupled_pairs", "files_changed"), "history"),
    "churn_hotspots": _ladder(_share("hotspots", "files_changed"), "history"),
    "knowledge_concentration": _ladder(_share("single_author_files", "settled_files"), "knowledge_concentration"),
    "test_presence": "case when test_files = 0 then 0.0 when test_files is not null then " + _ladder("(case when declarations > 0 then (declarations - production_declarations)::double / declarations end)", "test_presence") + " end",
    "dead_code": _ladder(_share("dead_declarations", "production_declarations"), "dead_code"),
    "near_duplication": _ladder(_share("near_duplicates", "production_declarations"), "near_duplication"),
    "idiom_consistency": _ladder(_d("divergent_concerns"), "idiom_consistency"),
    "documentation": "case when has_readme is null or has_changelog is null or has_docs is null then null when has_readme then 3.0::double + has_changelog::int + has_docs::int when has_changelog or has_docs then 1.5::double else 0.5::double end",
    "test_effectiveness": f"case when coverage_percent is not null then {_shown('coverage_percent::double / 20')} end",
}
_GONE = {"test_effectiveness": "coverage_percent is null", "knowledge_concentration": "coalesce(settled_files = 0, false)", "change_coupling": "coalesce(files_changed = 0, false)", "churn_hotspots": "coalesce(files_changed = 0, false)"}


def _category(name: str, price: float) -> str:
    weight = {a: f"(case when {_GONE[a]} then 0.0 else {w} end)::double" if a in _GONE else f"{w}::double" for a, w in scoring.CATEGORIES[name].items()}
    value = "(" + " + ".join(f"coalesce(a_{a}, {price}::double) * {w}" for a, w in weight.items()) + ") / (" + " + ".join(weight.values()) + ")"
    if name == "testability":
        untested = f"(case when test_files is null then {str(price <= 0).lower()} else test_files = 0 end)"
        value = f"case when {untested} then least({value}, 2.0) when coalesce(unpaired_hotspot, false) then least({value}, 4.0) else {value} end"
    return _shown(value)


def _overall(price: float) -> str:
    return _shown("(" + " + ".join(_category(c, price) for c in scoring.CATEGORIES) + ") / 5")


_RATE = "coalesce(case when {of} > 0 then {a}::double / {of} when {of} = 0 and {a} is not null then 0.0 end, 'infinity'::double)"
_READINGS = {
    "file_fail": _RATE.format(a="file_failures", of="files"), "decl_fail": _RATE.format(a="declaration_failures", of="declarations"), "file_warn": _RATE.format(a="file_warnings", of="files"), "decl_warn": _RATE.format(a="declaration_warnings", of="declarations"),
    "duplication": f"coalesce({_PRESSURES['duplication']}, 'infinity'::double)", "risk": f"coalesce({_PRESSURES['risk_patterns']}, 'infinity'::double)", "gates": "coalesce(gate_failures::double, 'infinity'::double)",
}


def _holds(level: int) -> str:
    return " and ".join(f"{v} <= {sc.CEILINGS[k][level]}" for k, v in _READINGS.items())


_BLOCKERS = "array_to_string(list_sort(list_filter([" + ", ".join(f"case when {v} > {sc.CEILINGS[k][1]} then '{k}' end" for k, v in _READINGS.items()) + "], lambda x: x is not null)), ',')"
_CARDS = f"""s as ({_SUMMARY}), a as (select *, {', '.join(f'{v} a_{k}' for k, v in _ASPECTS.items())} from s),
 o as (select *, {_overall(4.0)} overall, {_overall(0.0)} low, {_overall(5.0)} high from a)"""


_MISSING = "list_sort(list_filter([" + ", ".join(f"case when a_{a} is null and not {_GONE.get(a, 'false')} then '{a}' end" for a in _ASPECTS) + "], lambda x: x is not null))"
_CAPPED = f"case when test_files = 0 then 'no tests' when len({_MISSING}) > 0 then 'unmeasured: ' || array_to_string({_MISSING}, ', ') end"
_LETTER = f"case when low >= 4.8 and {_holds(0)} then 'A+' when low >= 4.5 and {_holds(1)} then 'A' when low >= 4.0 then 'B' when low >= 3.0 then 'C' when low >= 2.0 then 'D' else 'F' end"


@query(f"with {_CARDS}, g as (select *, {_LETTER} letter, {_CAPPED} capped from o) select k, overall, low, high, case when capped is not null and letter in ('A+', 'A') then 'B' else letter end grade, capped, {_BLOCKERS} blockers from g")
def scorecard(spark, d):
    return sc.scorecard(summary(spark, d)).select("k", "overall", "low", "high", "grade", "capped", F.array_join("blockers", ",").alias("blockers"))


@query("with " + _CARDS + " select k, " + ", ".join(f"a_{a}" for a in _ASPECTS) + " from a")
def aspect_scores(spark, d):
    return sc.scorecard(summary(spark, d)).select("k", *[f"a_{a}" for a in _ASPECTS])


@query("with " + _CARDS + " select k, " + ", ".join(f"{_category(c, 4.0)} c_{c}" for c in scoring.CATEGORIES) + " from a")
def category_scores(spark, d):
    return sc.scorecard(summary(spark, d)).select("k", *[f"c_{c}" for c in scoring.CATEGORIES])


def _pillar(name: str) -> str:
    xs = "[" + ", ".join(f"a_{a}" for a in sc.PILLARS[name]) + "]"
    return f"round(list_avg(list_filter({xs}, lambda x: x is not null)) + 1e-9, 2)"


@query(f"with {_CARDS} select k, pillar, score, case when score is null then 'unmeasured' when score >= 3.5 and k % 5 >= 3 then 'sustained' when score >= 3.5 then 'unguarded' when k % 5 >= 3 then 'recovering' else 'exposed' end posture from (" + " union all ".join(f"select k, '{p}' pillar, {_pillar(p)} score from a" for p in sc.PILLARS) + ")")
def pillar_report(spark, d):
    rows = sc.pillars(sc.scorecard(summary(spark, d)), F.col("k") % 5)
    return rows.select("k", F.explode(F.array(*[F.struct(F.lit(p).alias("pillar"), F.col(f"p_{p}").alias("score"), F.col(f"posture_{p}").alias("posture")) for p in sc.PILLARS])).alias("x")).select("k", "x.*")


@query(f"with {_CARDS} select k, {_shown('least(low, coalesce(other, low)) - more')} low, {_shown('greatest(high, coalesce(other, high)) + more')} high from (select *, case when k % 3 = 0 then (k % 50) / 10.0 end other, coalesce(case when k % 4 = 0 then 0.4 end, 0.0) * 0.5 + case when k % 5 = 0 then 0.1 else 0.0 end more from o)")
def widened_bounds(spark, d):
    k = F.col("k")
    low, high = sc.widened(F.col("low"), F.col("high"), F.when(k % 3 == 0, (k % 50) / 10.0), F.when(k % 4 == 0, 0.4), k % 5 == 0)
    return sc.scorecard(summary(spark, d)).select("k", low.alias("_l"), high.alias("_h")).select("k", F.col("_l").alias("low"), F.col("_h").alias("high"))


@query("with s as (" + _SUMMARY + ") select k, array_to_string(list_sort(list_filter([" + ", ".join(f"case when coalesce({p}, 0) < {n} then '{p}' end" for p, n in sc.FLOORS.items()) + "], lambda x: x is not null)), ',') thin from s")
def thin_populations(spark, d):
    return summary(spark, d).select("k", F.array_join(sc.thin_populations(), ",").alias("thin"))


@query("select k, " + ", ".join(f"round(n * {h} * (40 + k % 30) + 1e-9, 2) {name}" for name, h in (("low", 0.25), ("base", 1.0), ("high", 2.0))) + " from (select o_custkey k, count(*) n from orders group by 1)")
def economic_impact(spark, d):
    rows = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return rows.select("k", *[v.alias(name) for name, v in sc.economics(F.col("n"), 40 + F.col("k") % 30).items()])


_WORK = [c for c in workorder.CLASSES if c[3] or c[0] == "unpaired-hotspot"]
_LESS = ", ".join(f"case when cls = '{c[0]}' then greatest(0, {c[3]} - m) else {c[3]} end as {c[3]}" for c in _WORK if c[4])
_ITEMS = "select o_custkey k, [" + ", ".join(f"'{c[0]}'" for c in _WORK) + f"][(o_orderkey + l_linenumber * l_partkey) % {len(_WORK)} + 1] cls, 'p' || l_partkey path, l_linenumber line, l_quantity severity from orders join lineitem on l_orderkey = o_orderkey"
_SCENARIOS = f"""s as ({_SUMMARY}), it as ({_ITEMS}), n as (select k, cls, count(*) n from it group by 1, 2), sc as (select s.* replace ({_LESS}), cls, n, kind from s join (select k, cls, n, unnest([0, 1, n]) m, unnest([0, 1, 2]) kind from n) x using (k)),
 a as (select *, {', '.join(f'{v} a_{k}' for k, v in _ASPECTS.items())} from sc), o as (select k, cls, n, kind, {_overall(4.0)} overall from a),
 w as (select k, cls, any_value(n) class_count, round(greatest(0, max(overall) filter (kind = 1) - max(overall) filter (kind = 0)), 3) delta, round(greatest(0, max(overall) filter (kind = 2) - max(overall) filter (kind = 0)), 3) class_delta from o group by 1, 2)"""


def _items(spark, d):
    touched = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k")).join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    cls = F.element_at(F.array(*[F.lit(c[0]) for c in _WORK]), ((F.col("o_orderkey") + F.col("l_linenumber") * F.col("l_partkey")) % len(_WORK) + 1).cast("int"))
    return touched.select("k", cls.alias("class"), F.concat(F.lit("p"), "l_partkey").alias("path"), F.col("l_linenumber").cast("long").alias("line"), F.concat(F.lit("p"), "l_partkey").alias("label"), F.col("l_quantity").cast("double").alias("severity"), F.lit(None).cast("array<string>").alias("sites"))


@query(f"with {_SCENARIOS} select k, cls as class, class_count, delta, class_delta from w")
def class_worths(spark, d):
    return workorder.worths(_items(spark, d), sc.scorecard(summary(spark, d)), ["k"]).select("k", "class", "class_count", "delta", "class_delta")


@query(f"""with {_SCENARIOS}, b(cls, band, rank) as (values {', '.join(f"('{c[0]}', '{_b}', {_r})" for c in _WORK for _r, _b in enumerate(BANDS) if _b == ('quick-win' if c[1] >= 3 > c[2] else 'major-project' if c[1] >= 3 else 'fill-in' if c[2] < 3 else 'reconsider'))}),
 p as (select it.k, it.cls, path, line, severity, class_delta, row_number() over (partition by it.k order by rank, class_delta desc, severity desc, path, it.cls, line) place from it join w on w.k = it.k and w.cls = it.cls join b on b.cls = it.cls where band <> 'reconsider')
 select k, cls as class, count(*) n, min(place) first_place, sum(place)::bigint places, max(class_delta) worth from p group by 1, 2""")
def work_places(spark, d):
    rows = workorder.work_order(_items(spark, d), sc.scorecard(summary(spark, d)), ["k"])
    return rows.groupBy("k", "class").agg(F.count("*").alias("n"), F.min("place").alias("first_place"), F.sum("place").alias("places"), F.max(F.col("class_delta")).alias("worth"))


_DRAWS, _SEED = 12, 7
_REFITTED = ", ".join(f"case when {p} is not null and r_{k} > 0 then {_shown(f'greatest(0.0, least(5.0, 5 * c / ({p} / r_{k} + c)))')} end a_{k}" for k, p in _PRESSURES.items())
_FIXED = ", ".join(f"{v} a_{k}" for k, v in _ASPECTS.items() if k not in _PRESSURES)
_MEDIAN20 = "round(median(round({overall} * 10)) * 2)"
_REFITS = f"""s as materialized ({_SUMMARY}), nb as (select *, row_number() over (order by k) i from s),
 picks as (select draw, (('0x' || substr(md5('{_SEED}:' || draw || ':' || i), 1, 13))::bigint % (select count(*) from s)) + 1 i from nb, range(1, {_DRAWS + 1}) d(draw) union all select 0, i from nb),
 rows as materialized (select draw, nb.*, {_FIXED} from picks join nb using (i)),
 refs as materialized (select draw, count(*) n, {', '.join(f"round(median({p}) + 1e-9, 4) r_{k}" for k, p in _PRESSURES.items() if k != calibration.UNIT)}, {sc.REFERENCES[calibration.UNIT]}::double r_{calibration.UNIT} from rows group by 1),
 b as (select draw, 0 step, {calibration.LOW}::double lo, {calibration.HIGH}::double hi from refs union all
  select draw, step + 1, case when m < 80 - 1e-9 then c else lo end, case when m < 80 - 1e-9 then hi else c end from (select draw, step, c, lo, hi, {_MEDIAN20.format(overall=_overall(4.0))} m from (select *, {_REFITTED} from (select *, (lo + hi) / 2 c from b where step < {calibration.STEPS}) join refs using (draw) join rows using (draw)) group by all)),
 e as (select draw, (lo + hi) / 2 fin from b where step = {calibration.STEPS}),
 flat as (select draw, min(slot) a, max(slot) z from (select draw, slot, {_MEDIAN20.format(overall=_overall(4.0))} m from (select *, {_REFITTED} from (select draw, slot, fin + slot * {calibration.STRIDE}::double c from e, range(-{calibration.PLATEAU}, {calibration.PLATEAU + 1}) r(slot)) join refs using (draw) join rows using (draw)) group by 1, 2) where abs(m - 80) < 1e-9 group by 1),
 fits as (select draw, n, coalesce(round((round(fin + a * {calibration.STRIDE}::double + 1e-9, 4) + round(fin + z * {calibration.STRIDE}::double + 1e-9, 4)) / 2 + 1e-9, 4), round(fin + 1e-9, 4)) constant, {', '.join(f"r_{k}" for k in _PRESSURES)} from e join refs using (draw) left join flat using (draw))"""


@query(f"with recursive {_REFITS}, o as (select constant, row_number() over (order by constant, draw) - 1 place, count(*) over () n from fits where draw > 0), ends as (select count(*) draws, (select constant from fits where draw = 0) measured, max(constant) filter (place = floor(n * 0.025)) low, max(constant) filter (place = floor(n * 0.975)) high from o) select *, measured < low or measured > high outside from fits, ends")
def refitted_constants(spark, d):
    """The customers' summaries as a corpus, drawn again twelve times: references and constant of each draw (0: the corpus itself), beside the interval of the constant."""
    fits = calibration.refits(summary(spark, d), "k", _DRAWS, _SEED)
    return fits.crossJoin(calibration.interval(fits)).select("draw", "n", "constant", *[f"r_{k}" for k in _PRESSURES], "draws", "measured", "low", "high", "outside")  # the interval is one row
