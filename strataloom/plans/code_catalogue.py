"""Queries over source files that are written from the supplied tables, so that SQL can say what has to be found in them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import code, complexity, incremental
from ..session import shared_dir
from .catalogue import SQL, _t, query

# Of part: id, k (0 to 4 branches) and language. Each text is written line by line; the SQL beside it counts lines and branches.
_TEXTS = {
    0: ("py", "def work_{id}(x):\n", "    if x > 1 and x:\n        x += 1  # if for while\n", "    return x\n"),
    1: ("ts", "export function work_{id}(x: number) {{\n", "  if (x > 1 && x) {{\n    x += 1; // if for while\n  }}\n", '  return x + "while";\n}}\n'),
    2: ("java", "@Entity(name = \"x\")\npublic class W{id} {{\n  private Map<String, Integer> work(int x) {{\n", "    if (x > 1) {{\n      x += 1; /* while */\n    }}\n", "    return null;\n  }}\n}}\n"),
    3: ("go", "package w\n\nfunc (s *Box) Work{id}(x int) int {{\n", "\tif x > 1 || x < 0 {{\n\t\tx++\n\t}}\n", "\treturn x\n}}\n"),
    4: ("rs", "impl<T> Show for Box<T> {{\n    pub fn work_{id}(&self, x: i32) -> i32 {{\n", "        if x > 1 {{\n            x += 1; // while\n        }}\n", "        x\n    }}\n}}\n"),
    5: ("sh", "work_{id}() {{\n", "  if [ -f x ]; then\n    echo for while\n  fi\n", "}}\n"),
}


def _sources(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).cast("int").alias("k"))
    path, text = F.lit(None), F.lit(None)
    for n, (suffix, head, branch, tail) in _TEXTS.items():
        here = F.col("id") % 6 == n
        begin, end = head.replace("{{", "{").replace("}}", "}").split("{id}"), tail.replace("}}", "}")
        path = F.when(here, F.concat(F.lit("src/w"), "id", F.lit(f".{suffix}"))).otherwise(path)
        text = F.when(here, F.concat(F.lit(begin[0]), "id", F.lit(begin[1]), F.expr(f"repeat({_sql(branch.replace('{{', '{').replace('}}', '}'))}, k)"), F.lit(end))).otherwise(text)
    return rows.select(path.alias("path"), text.alias("text"))


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("\n", "\\n").replace("\t", "\\t").replace("'", "\\'") + "'"


_PARTS = "p as (select p_partkey id, p_size % 5 k, p_partkey % 6 l, 'src/w' || p_partkey || case p_partkey % 6 when 0 then '.py' when 1 then '.ts' when 2 then '.java' when 3 then '.go' when 4 then '.rs' else '.sh' end path from part)"
_DECLARED = f"""{_PARTS}, declared as (
 select path, 1 s, 2 * k + 2 e, 'work_' || id name, 'function' kind, 1 + 2 * k cyclomatic, 2 * k cognitive from p where l = 0
 union all select path, 1, 3 * k + 3, 'work_' || id, 'function', 1 + 2 * k, 3 * k from p where l = 1
 union all select path, 2, 3 * k + 6, 'W' || id, 'class', 1 + k, 3 * k from p where l = 2
 union all select path, 3, 3 * k + 5, 'work', 'function', 1 + k, 2 * k from p where l = 2
 union all select path, 3, 3 * k + 5, 'Box.Work' || id, 'function', 1 + 2 * k, 3 * k from p where l = 3
 union all select path, 2, 3 * k + 4, 'Box::work_' || id, 'function', 1 + k, 2 * k from p where l = 4
 union all select path, 1, 3 * k + 2, 'work_' || id, 'function', 1 + k, k from p where l = 5)"""


@query(f"with {_DECLARED} select path, s, e, name, kind, cyclomatic, cognitive, e - s + 1 n_lines from declared")
def code_declarations(spark, d):
    return code.declarations(_sources(spark, d)).select("path", F.col("start").alias("s"), F.col("end").alias("e"), "name", "kind", "cyclomatic", "cognitive", F.col("lines").alias("n_lines"))


@query(SQL["code_declarations"])
def incremental_declarations(spark, d):
    """Two runs over a tree that changes: a third of the files are others in the first one; the second parses these alone and gives all rows."""
    store, now = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", _sources(spark, d)
    before = now.withColumn("text", F.when(F.pmod(F.xxhash64("path"), F.lit(3)) == 0, F.concat(F.lit("\n"), "text")).otherwise(F.col("text")))
    for tree in (before, now):
        rows = incremental.declarations(tree, store)
    return rows.select("path", F.col("start").alias("s"), F.col("end").alias("e"), "name", "kind", "cyclomatic", "cognitive", F.col("lines").alias("n_lines"))


_SMALL = {"function": {"lines": (8, 13), "cyclomatic": (5, 8), "cognitive": (6, 10)}, "class": {"lines": (9, 15)}}


@query(
    f"""with {_DECLARED} select kind, status, count(*) n, sum(cyclomatic)::bigint points from (select *, e - s + 1 n_lines, case when kind = 'class' then case when e - s + 1 > 15 then 'fail' when e - s + 1 > 9 then 'warn' else 'pass' end
 when e - s + 1 > 13 or cyclomatic > 8 or cognitive > 10 then 'fail' when e - s + 1 > 8 or cyclomatic > 5 or cognitive > 6 then 'warn' else 'pass' end status from declared) group by 1, 2"""
)
def declaration_status(spark, d):
    rows = code.declarations(_sources(spark, d)).withColumn("status", code.status(limits=_SMALL))
    return rows.groupBy("kind", "status").agg(F.count("*").alias("n"), F.sum("cyclomatic").alias("points"))


@query(f"with {_PARTS} select path, 1 + case l when 0 then 2 * k + 2 when 1 then 3 * k + 3 when 2 then 3 * k + 6 when 3 then 3 * k + 5 when 4 then 3 * k + 5 else 3 * k + 2 end n_lines, case when l = 5 then k else 0 end n_while from p")
def masked_code(spark, d):
    return code.masked_lines(_sources(spark, d)).groupBy("path").agg(F.count("*").alias("n_lines"), F.count_if(F.contains("masked", F.lit("while"))).alias("n_while"))


_GO = complexity.BRANCHES["go"]


@query(f"select doc_id, sum(len(regexp_extract_all(t, '{_GO}')))::bigint points from (select doc_id, unnest(string_split(text, chr(10))) t from documents where text is not null) group by 1")
def branch_counts(spark, d):
    lines = _t(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    return lines.groupBy("doc_id").agg(F.sum(F.regexp_count("t", F.lit(_GO))).alias("points"))


@query("select 'lib/p' || p_partkey || '.py' path, '_helper_' || p_partkey name, case when p_partkey % 4 = 1 then 3 else 1 end s from part where p_partkey % 3 <> 0 and p_partkey % 5 <> 0")
def unused_declarations(spark, d):
    """A third of the helpers are called elsewhere, a fifth have a decorator above them, a quarter something else."""
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("id"))
    above = F.when(F.col("id") % 5 == 0, "@route\n\n").when(F.col("id") % 4 == 1, "x = 1\n\n").otherwise("")
    own = parts.select(F.concat(F.lit("lib/p"), "id", F.lit(".py")).alias("path"), F.concat(above, F.lit("def _helper_"), "id", F.lit("(a):\n    return a\n")).alias("text"))
    callers = parts.filter("id % 3 = 0").select(F.concat(F.lit("lib/c"), "id", F.lit(".py")).alias("path"), F.concat(F.lit("import m\nprint(f'{m._helper_"), "id", F.lit("(1)}')\n")).alias("text"))
    tests = parts.select(F.concat(F.lit("tests/t"), "id", F.lit(".py")).alias("path"), F.concat(F.lit("def _in_test_"), "id", F.lit("():\n    pass\n")).alias("text"))
    files = own.union(callers).union(tests)
    return code.unused_declarations(code.declarations(files), files).select("path", "name", F.col("start").alias("s"))


@query("with n as (select n_nationkey id from nation) select 'src/n' || id || '.ts' path, 'close,open_' || id names from n where id % 3 = 0")
def operation_sets(spark, d):
    rows = _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    listed = F.when(F.col("id") % 3 == 1, F.lit('["close"]')).otherwise(F.concat(F.lit('["close", "open_'), "id", F.lit('"]')))
    described = F.when(F.col("id") % 3 == 2, F.lit("")).otherwise(F.concat(F.lit('  open_'), "id", F.lit(': "opens",\n')))
    text = F.concat(F.lit('if (op === "open_'), "id", F.lit('") run();\nswitch (op) { case "close": stop(); }\nif ('), listed, F.lit('.includes(op)) allow();\nconst about = {\n'), described, F.lit('  close: "closes",\n};\n'))
    files = rows.select(F.concat(F.lit("src/n"), "id", F.lit(".ts")).alias("path"), text.alias("text"))
    return code.operation_sets(files).select("path", F.array_join("names", ",").alias("names"))


@query("select 'tests/test_' || p_partkey || '.py' path, 4 line, 'assert total(3) == price * ' || (p_size % 7) what from part where p_partkey % 4 = 0")
def computed_expectations(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 7).alias("n"))
    right = F.when(F.col("id") % 4 == 0, F.concat(F.lit("price * "), "n")).when(F.col("id") % 4 == 1, F.lit("2 * 60")).when(F.col("id") % 4 == 2, F.lit("other + 1")).otherwise(F.lit('"a" + price'))
    text = F.concat(F.lit("def test_total():\n    price = 2\n    other = total(4)\n    assert total(3) == "), right, F.lit("\n"))
    files = rows.select(F.concat(F.lit("tests/test_"), "id", F.lit(".py")).alias("path"), text.alias("text"))
    return code.computed_expectations(files).select("path", "line", F.col("text").alias("what"))


_PASTED = "case doc_id % 4 when 0 then coalesce(text, '') when 1 then concat(coalesce(text, ''), chr(10), '@@ -1,2 +3 @@', chr(10), ' a') when 2 then concat('--- a', chr(10), coalesce(text, ''), chr(10), '+++ c') else concat('+', replace(coalesce(text, ''), chr(10), concat(chr(10), '-')), chr(10), ' ', chr(10), '-b @@ -1 +1 @@') end"


@query(f"select doc_id, regexp_matches(t, '(?m)^@@ -\\d+(,\\d+)? \\+\\d+(,\\d+)? @@') or (regexp_matches(t, '(?m)^--- ') and regexp_matches(t, '(?m)^\\+\\+\\+ ')) is_diff, len(ls) > 0 and len(list_filter(ls, lambda x: not regexp_matches(x, '^[+-]'))) = 0 is_fragment from (select doc_id, t, list_filter(regexp_split_to_array(t, '\\r\\n|[\\n\\r]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '') ls from (select doc_id, {_PASTED} t from documents))")
def pasted_diffs(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.expr(_PASTED).alias("t"))
    return rows.select("doc_id", code.is_unified_diff("t").alias("is_diff"), code.is_diff_fragment("t").alias("is_fragment"))


@query(f"with {_DECLARED}, members as (select path, s, e, name, kind from declared where kind = 'function'), spans as (select path, 1 s, 40 e, 'Outer' name from p union all select path, 2, 3 * k + 7, 'Inner' from p where l = 2) select path, s, case when exists (select 1 from spans x where x.path = m.path and x.s < m.s and m.e <= x.e) then (select arg_max(x.name, x.s) from spans x where x.path = m.path and x.s < m.s and m.e <= x.e) || '.' || name else name end name from members m")
def qualified_members(spark, d):
    declared = code.declarations(_sources(spark, d)).filter("kind = 'function'").select("path", "start", "end", "name", "kind")
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("k"))
    files = _sources(spark, d).select("path").withColumn("id", F.regexp_extract("path", r"w(\d+)\.", 1).cast("long")).join(parts.hint("merge"), "id")
    spans = files.select("path", F.lit(1).alias("start"), F.lit(40).alias("end"), F.lit("Outer").alias("name")).union(files.filter("id % 6 = 2").select("path", F.lit(2), (F.col("k") * 3 + 7).cast("int"), F.lit("Inner")))
    return code.qualified(declared, spans, ".").select("path", F.col("start").alias("s"), "name")


@query(
    f"""with {_DECLARED}, graded as (select *, e - s + 1 n_lines, case when kind = 'class' then 'pass' when e - s + 1 > 13 or cyclomatic > 8 or cognitive > 10 then 'fail' when e - s + 1 > 8 or cyclomatic > 5 or cognitive > 6 then 'warn' else 'pass' end st from declared where kind = 'function')
 select path, s, st, (select count(*) from graded where st <> 'pass') n_total from graded where st <> 'pass' order by case st when 'fail' then 0 else 1 end, cyclomatic desc, n_lines desc, path, s limit 50"""
)
def worst_functions(spark, d):
    declared = code.declarations(_sources(spark, d)).filter("kind = 'function'")
    return code.function_hotspots(declared, limits=_SMALL).select("path", F.col("start").alias("s"), F.col("status").alias("st"), "n_total")
