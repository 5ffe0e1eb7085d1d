"""An audit of a small tree, from files to page."""

from strataloom.audit import audit, markdown, risk_findings


def test_an_audit_of_a_small_tree(spark, tmp_path):
    body = "".join(f"    if x > {i}:\n        x = x {'+-*/'[i % 4]} {i}\n" for i in range(20))
    sources = {
        "README.md": "hello\n", "src/a.py": f"def big(x):\n{body}    return x\n\n\ndef _unused():\n    return 1\n", "src/b.py": f"def copy(y):\n{body.replace('x', 'y')}    return y\n# TODO later\nassert True\n",
        "src/c.go": "package c\n\nfunc Run(x int) int {\n\tif x > 1 {\n\t\treturn 2\n\t}\n\treturn 1\n}\n", "tests/test_a.py": "def test_a():\n    assert big(1) == 1\n", "out/skip.py": "def skipped():\n    pass\n", "src/latin.py": "# é\nx = 1\n",
    }
    for name, content in sources.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content.encode("latin-1"))
    tables = audit(spark, f"file://{tmp_path}", ["out/"])
    assert {(r["path"], r["valid"]) for r in tables["files"].collect()} == {("src/a.py", True), ("src/b.py", True), ("src/c.go", True), ("tests/test_a.py", True), ("src/latin.py", False)}
    assert {(r["name"], r["status"]) for r in tables["declarations"].collect()} == {("big", "fail"), ("copy", "fail"), ("_unused", "pass"), ("Run", "pass"), ("test_a", "pass")}
    assert [r["name"] for r in tables["unused"].collect()] == ["_unused"] and {r["rule"] for r in tables["risks"].collect()} == {"debt-marker", "vacuous-assertion"}
    assert [(r["left"]["name"], r["right"]["name"]) for r in tables["similar"].collect()] == [("big", "copy")]
    row = tables["summary"].first()
    assert (row["files"], row["declarations"], row["production_declarations"], row["test_files"], row["has_readme"], row["has_changelog"], row["has_docs"], row["files_changed"]) == (5, 5, 4, 1, True, False, False, None)
    card = tables["card"].first()
    assert card["low"] < card["overall"] < card["high"] and "decl_fail" in card["blockers"]
    page = markdown(tables)
    assert page.startswith(f"# Grade {card['grade']}") and "| src/a.py | big |" in page and "_unused" in page


def test_rules_look_at_their_suffixes_alone(spark):
    lines = spark.createDataFrame([("a.js", 1, "assert True"), ("a.py", 2, "return rows[: 50]"), ("a.py", 3, "return d.get('x', 0)"), ("b.txt", 4, "fixme"), ("a.py", 5, "assert x == x"), ("a.py", 6, None)], "path string, line_no int, text string")
    assert sorted((r["rule"], r["line"]) for r in risk_findings(lines).collect()) == [("absence-as-zero", 3), ("debt-marker", 4), ("silent-truncation", 2), ("vacuous-assertion", 5)]


def test_a_tree_without_sources(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    card = audit(spark, f"file://{tmp_path}")["card"].first()
    assert card["files"] == 0 and card["grade"] in "ABCDF"
