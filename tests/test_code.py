"""Recognisers, masks and token streams on small sources of every language; operators over files."""

import textwrap

import pytest

from pyspark.sql import functions as F

from strataloom.functions import lexing, streams
from strataloom.functions.declarations import measured
from strataloom.operators import code, complexity

SAMPLES = {
    "a.py": ('class Box:\n    def get(self, k):\n        def inner():\n            return f"{k if k else 0} if"\n        if k and k > 1:\n            for i in k:\n                pass\n        elif k:\n            return 2\n        return """\nif while\n"""\n', [("Box", 1, 12, 6), ("get", 2, 12, 6), ("inner", 3, 4, 2)]),
    "a.js": ("const add = (a, b) => a + b;\nexport default class Shop {\n  #price = 3;\n  async total(items) {\n    return items.map((x) => { return x ?? 1; });\n  }\n  get tax() { return /a?b{2}/.test(this.x) ? 1 : 2; }\n}\ndescribe(\"x\", () => {\n  run();\n});\n", [("add", 1, 1, 1), ("Shop", 2, 8, 3), ("total", 4, 6, 2), ("tax", 7, 7, 2)]),
    "a.ts": ("interface Shape {\n  area(): number;\n}\ntype F = (x: number) => void;\ndeclare function gone(): void;\nexport const f = async (x?: string): Promise<void> => {\n  if (x) { go(); }\n};\n", [("f", 6, 8, 2)]),
    "A.java": ("@Service(\"x\")\npublic abstract class A<T extends B> {\n  @Override public Map<String, List<T>> all() { return null; }\n  abstract void later(int x);\n  A(int x) {\n    call(x);\n    for (int i : y) { if (i > 0 || x > 1) continue; }\n  }\n  enum Kind { ONE, TWO }\n}\n", [("A", 2, 10, 4), ("all", 3, 3, 1), ("later", 4, 4, 1), ("A", 5, 8, 4), ("Kind", 9, 9, 1)]),
    "a.c": ("#define MAX(a) ((a) > 0 ? a : 0)\nint proto(int a);\nstruct point {\n  int x;\n};\nstatic int *find(struct point *p, int n)\n{\n  /* if (x) { */\n  while (n--) if (p[n].x == '{') return &p[n].x;\n  return 0;\n}\n", [("point", 3, 5, 1), ("find", 6, 11, 3)]),
    "a.cpp": ("namespace ns {\nclass Foo : public Bar {\n public:\n  explicit Foo(int x) : x_(x) { if (x) go(); }\n  virtual void pure() = 0;\n  ~Foo();\n};\nFoo::~Foo() { }\ntemplate <typename T> T Foo::get() const {\n  return a ? b : c;\n}\n}\n", [("Foo", 2, 7, 2), ("Foo", 4, 4, 2), ("Foo::~Foo", 8, 8, 1), ("Foo::get", 9, 11, 2)]),
    "a.cs": ("namespace N {\n  [Serializable]\n  public record Person(string Name) {\n    [Obsolete(\"if\")] public int Age(int? v) => v ?? 0;\n    public string Full { get { return Name; } }\n    public async Task<int> Run() {\n      foreach (var x in y) { await Go(x); }\n      return 1;\n    }\n  }\n}\n", [("Person", 3, 10, 3), ("Age", 4, 4, 2), ("Run", 6, 9, 2)]),
    "a.swift": ("protocol P {\n  func needed()\n}\nextension Store {\n  func add(_ x: Int?) -> Int {\n    guard let x = x else { return 0 }\n    return x\n  }\n}\nfinal class Box {\n  init(a: Int) { self.a = a }\n}\n", [("P", 1, 3, 1), ("Store.add", 5, 8, 2), ("Box", 10, 12, 1), ("init", 11, 11, 1)]),
    "a.kt": ("data class Point(val x: Int) {\n  companion object {\n    fun of(s: String?) = s?.let { Point(1) } ?: Point(0)\n  }\n  fun Int.twice(): Int {\n    return when (this) {\n      1 -> 2\n      else -> 3\n    }\n  }\n}\nabstract class Q {\n  abstract fun none()\n}\n", [("Point", 1, 11, 3), ("Companion", 2, 4, 2), ("of", 3, 3, 2), ("Int.twice", 5, 10, 2), ("Q", 12, 14, 1)]),
    "a.go": ("type ID string\ntype Set[T any] struct {\n\tm map[T]bool\n}\nfunc (s *Set[T]) Add(x T) {\n\tselect {\n\tcase <-c:\n\t}\n}\nfunc Map[T any](xs []T) []T { return xs }\n", [("Set", 2, 4, 1), ("Set.Add", 5, 9, 2), ("Map", 10, 10, 1)]),
    "a.rs": ("#[derive(Debug)]\npub struct Unit;\npub enum E { A, B }\nimpl<'a> fmt::Display for E {\n    fn fmt(&self, f: &mut F) -> R {\n        match self { E::A => x?, _ => y }\n    }\n}\ntrait T {\n    fn required(&self);\n    fn given(&self) -> char { '{' }\n}\n", [("E", 3, 3, 1), ("E::fmt", 5, 7, 3), ("T", 9, 12, 1), ("T::given", 11, 11, 1)]),
    "a.php": ("<html>function no() { if (x) {} }</html>\n<?php\nabstract class A {\n    # if (x)\n    public static function make(?int $x): static {\n        return $x ?: match(true) { default => 1 };\n    }\n    abstract function later();\n}\nfunction top() { }\n?>\n", [("A", 3, 9, 3), ("A::make", 5, 7, 3), ("top", 10, 10, 1)]),
    "a.rb": ("module M\n  class A\n    def self.make(x)\n      x.each do |y|\n        puts \"if\" if y\n      end\n    end\n    def ok? = true\n    def run\n      v = if @a then 1 else 2 end\n      while v do v -= 1 end\n    end\n  end\nend\n", [("M", 1, 14, 4), ("A", 2, 13, 4), ("A.make", 3, 7, 2), ("A#ok?", 8, 8, 1), ("A#run", 9, 12, 3)]),
    "a.sh": ("say() { echo for you; }\nfunction deploy\n{\n  cat <<EOF\nif then {\nEOF\n  case \"$1\" in\n    start|stop) run ;;\n    *) exit 1 ;;\n  esac\n  [ -f x ] || exit 1 # if\n}\n", [("say", 1, 1, 1), ("deploy", 2, 12, 3)]),
    "a.f90": ("module m\ninterface\n  subroutine ext(a)\n  end subroutine ext\nend interface\ntype point\n  real :: x\nend type point\ncontains\n  pure integer function f(n) result(r)\n    if (n > 0 .and. n < 9) then ! if\n      r = 1\n    else\n      r = 2\n    end if\n    do 10 i = 1, n\n10  continue\n  end function f\nend module m\n", [("m", 1, 19, 4), ("point", 6, 8, 1), ("f", 10, 18, 4)]),
    "a.f": ("C     if comment\n      SUBROUTINE S(N)\n      IF (N .GT. 0 .AND.\n     &    N .LT. 9) THEN\n        N = 1\n      END IF\n      END\n", [("S", 2, 7, 3)]),
    "a.cob": ("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. X.\n       PROCEDURE DIVISION.\n       MAIN-PARA.\n           IF A > 1 OR B\n               DISPLAY 'IF'\n           END-IF.\n      * IF COMMENT\n       NEXT-PARA.\n           PERFORM MAIN-PARA UNTIL DONE.\n           STOP RUN.\n", [("MAIN-PARA", 4, 8, 3), ("NEXT-PARA", 9, 11, 2)]),
}


@pytest.fixture(scope="module")
def sampled(spark):
    files = spark.createDataFrame([(p, t) for p, (t, _) in SAMPLES.items()], "path string, text string")
    return code.declarations(files).collect()


@pytest.mark.parametrize("path", sorted(SAMPLES))
def test_declarations(sampled, path):
    got = [(r["name"], r["start"], r["end"], r["cyclomatic"]) for r in sampled if r["path"] == path]
    assert sorted(got) == sorted(SAMPLES[path][1])


@pytest.mark.parametrize("path", sorted(x for x in SAMPLES if x not in ("a.f", "a.cob")))
def test_masks_keep_every_place(path):
    text = SAMPLES[path][0]
    masked = lexing.masked(text, lexing.language_of(path))
    assert [len(x) for x in masked.split("\n")] == [len(x) for x in text.split("\n")]
    assert all(a == b or a == " " for a, b in zip(masked, text))


def test_unfinished_sources_do_no_harm():
    for path, (text, _) in SAMPLES.items():
        for cut in range(0, len(text), 7):
            assert all(1 <= r["start"] <= r["end"] for r in measured(path, text[:cut]))
    assert measured("a.txt", "if") == [] and measured("a.py", "") == [] and measured("b.py", "def broken(:\n    if x:\n        pass\ny = 1\n")[0]["end"] == 3


def scored(spark, bodies):
    """Cognitive complexity of (language, masked lines)."""
    rows = spark.createDataFrame([(i, language, None, lines) for i, (language, lines) in enumerate(bodies)], "i int, language string, weight int, body array<string>")
    return [r["cognitive"] for r in complexity.measured(rows).orderBy("i").collect()]


def test_cognitive_nests(spark):
    flat = "def f(a):\n" + "    if a:\n        pass\n" * 3
    deep = "def f(a):\n    if a:\n        if a:\n            if a:\n                pass\n"
    files = spark.createDataFrame([("a.py", flat), ("b.py", deep)], "path string, text string")
    assert [r["cognitive"] for r in code.declarations(files).orderBy("path").collect()] == [3, 6]
    cases = [
        ("fortran", ["if (a) then", "  do i = 1, 2", "    if (b) x = 1", "  end do", "end if"], 1 + 2 + 3),
        ("fortran", ["end if", "if (a .and. b) then", "else", "end if", "if (c) x = 1"], 2 + 1 + 1),  # what closes too much is no debt
        ("shell", ["if a; then", "  for x in y; do b && c; done", "else d; fi"], 1 + 2 + 1 + 1),
        ("shell", ["echo if; then time while x; do", "if a; then if b; then c; fi; fi", "done"], 1 + 2 + 3),
        ("cobol", ["IF A", "  PERFORM UNTIL B", "    X", "  END-PERFORM", "ELSE Y.", "IF C Z."], 1 + 2 + 1 + 1),
        ("js", ["function f(a)", "{", "  if (a && b) {", "    for (;;) { while (x) y(); }", "  } else if (c) {", "  }", "}"], 3 + 6 + 3),
        ("java", ["}", "void f() {", "if (a) {", "if (b) {}", "}", "}"], 2 + 3),
        ("go", [], 0),
    ]
    assert scored(spark, [c[:2] for c in cases]) == [c[2] for c in cases]


def test_words_of_the_shell_count_where_commands_begin(spark):
    cases = [("if a; then", ["if"]), ("echo if while", []), ("a && if b || c; fi", ["&&", "if", "||", "fi"]), ("else time if x", ["else", "if"]), ("iffy; done", ["done"]), ("", []), ("then then for x", ["for"]), ("$(while x", ["while"]), ("do do", [])]
    got = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(complexity.shell_words(F.col("t"))).collect()
    assert [list(r[0]) for r in got] == [w for _, w in cases]


def test_tokens_are_renamed():
    a = streams.tokens("    def f(x, y):\n        return x + 'a' * 3\n", "python")
    assert a == streams.tokens("def g(u, v):\n    return u + 'b' * 7\n", "python") and "V0" in a and "S" in a and "L" in a
    assert streams.tokens("", "js", ["if (a) return b + 12;"]) == ["if", "(", "V0", ")", "return", "V1", "+", "L", ";"]
    assert streams.tokens("x = (", "python") == []


def body(name: str, parameter: str, extra: str = "") -> str:
    steps = "".join(f"    if {parameter} > {i}:\n        {parameter} = {parameter} {'+-*/'[i % 4]} {i}\n" for i in range(12))
    return f"def {name}({parameter}):\n{steps}{extra}    return {parameter}\n"


def test_similar_bodies(spark):
    other = "def other(a, b):\n" + "".join(f"    for x{i} in a:\n        while b:\n            b.pop(x{i})\n" for i in range(9)) + "    return b\n"
    files = spark.createDataFrame([("src/a.py", body("one", "x")), ("src/b.py", body("two", "y") + other), ("src/c.py", body("three", "z", "    z = z[0]\n")), ("tests/test_a.py", body("four", "w")), ("src/d.py", "def tiny(x):\n    return x\n"), ("src/e.py", None)], "path string, text string")
    rows = code.declarations(files)
    got = {(r["left"]["name"], r["right"]["name"]): r["similarity"] for r in code.similar_bodies(rows).collect()}
    assert got == {("one", "two"): 1.0}  # in three the added line takes part in too many of the few distinct runs
    assert code.similar_bodies(rows.limit(0)).count() == 0
    many = spark.createDataFrame([(f"src/m{i}.py", body(f"f{i}", "x")) for i in range(13)], "path string, text string")
    assert code.similar_bodies(code.declarations(many)).count() == 0  # thirteen holders propose nothing


def test_files_without_text_and_readability(spark):
    files = spark.createDataFrame([("a.py", None), ("b.py", ""), ("c.py", "def f(:"), ("d.js", "+function f() {\n+}\n"), ("e.js", "@@ -1 +1 @@\n"), ("f.js", "let x = '@@ -1 +1 @@'\n")], "path string, text string")
    assert {r["path"]: r["readable"] for r in code.is_readable(files).collect()} == {"a.py": True, "b.py": True, "c.py": False, "d.js": False, "e.js": False, "f.js": True}
    assert code.declarations(files).filter("path in ('a.py', 'b.py')").count() == 0


def test_tests_that_work_out_what_they_expect(spark):
    text = textwrap.dedent("""
        def test_a():
            qty = 3
            expected = qty * 2
            assert total([1]) == expected
            result = total(qty)
            assert result == qty + 1
            plain = total([2])
            assert plain + 1 == total([3])
            self.assertEqual(total([1]), a.b - 1)
            assert total(1) == 2 * 60
    """)
    files = spark.createDataFrame([("tests/test_x.py", text), ("src/x.py", text), ("tests/test_y.py", "def (")], "path string, text string")
    assert [(r["path"], r["line"]) for r in code.computed_expectations(files).orderBy("line").collect()] == [("tests/test_x.py", 5), ("tests/test_x.py", 7), ("tests/test_x.py", 10)]


def test_files_of_one_task_are_read_in_several_and_handed_on_in_batches(spark):
    rows = [(f"src/w{i}.py", "def f():\n    pass\n" if i % 3 else None) for i in range(600)]
    files = spark.createDataFrame(rows, "path string, text string").coalesce(1)
    masked = code.masked_lines(files)
    assert masked.rdd.getNumPartitions() >= 4
    assert masked.count() == 400 * 3 + 200
    sizes = masked.mapInArrow(lambda batches: (b.select(["line_no"]).slice(0, 1) for b in batches), "line_no int").count()
    assert sizes <= masked.rdd.getNumPartitions()
