"""Expected values worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from diffloom.functions import normalize as nz
from diffloom.functions import text as tx
from diffloom.operators import files as fo
from diffloom.operators import rules

NESTED = """
def busy():
    if a:
        for x in y:
            if b:
                pass
            else:
                pass
    return 1
"""


def measured(spark, content):
    return fo.measure(spark.createDataFrame([(1, content)], "file_id int, content string")).first()


@pytest.mark.parametrize(
    "content, expected",
    [("def simple(): return 1", 1), (NESTED, 5), ("elif", 3), ("format", 2), ("IF Else", 3), ("if\n" * 80, 50)],
)
def test_keyword_complexity(spark, content, expected):
    assert measured(spark, content)["complexity_score"] == expected


def test_duplicate_line_ratio(spark):
    twin = "def area(a, b):\n    total = a * b\n    total = total + 1\n    print(total, a)\n    return total\n"
    assert measured(spark, twin + twin)["duplication_score"] == pytest.approx(5 / 10)
    assert measured(spark, twin)["duplication_score"] == 0.0  # fewer than ten lines
    assert measured(spark, "short\n" * 20)["duplication_score"] == 0.0  # only long lines count
    assert measured(spark, "")["duplication_score"] == 0.0
    assert measured(spark, "a line of more than ten\n" * 12)["duplication_score"] == pytest.approx(11 / 12)


@pytest.mark.parametrize(
    "lines, complexity, duplication, expected",
    [(100, 5, 0.1, 96), (500, 20, 0.8, 44), (300, 10, 0.0, 100), (5000, 50, 1.0, 10), (349, 11, 0.02, 98)],
)
def test_maintainability(evaluate, lines, complexity, duplication, expected):
    score = tx.maintainability(F.col("l"), F.col("c"), F.col("d"))
    assert evaluate(score, "l int, c int, d double", l=lines, c=complexity, d=duplication) == expected


def functions_of(spark, content):
    rows = rules.function_table(spark.createDataFrame([(1, content)], "file_id int, content string")).collect()
    return {r["function_name"]: r["length"] for r in rows}


def test_function_lengths(spark):
    code = "def short():\n    return 1\n\nclass A:\n    def method(self):\n        x = 1\n\n        return x\n\ntop = 1\n"
    assert functions_of(spark, code) == {"short": 3, "method": 5}


def test_function_lengths_nested_repeated_and_last(spark):
    code = "def a():\n    x\n    def b():\n        y\n    z\ndef a():\n    1\n    2\n    3"
    # The nested def closes a; z closes b; the last a wins and runs to the end.
    assert functions_of(spark, code) == {"b": 2, "a": 4}
    assert functions_of(spark, "no functions\nhere") == {}


def test_code_blocks(evaluate):
    code = "import x\n\ndef a():\n    1\n  \nclass B:\n    def c(self):\n        2\nvar\nlet z = 1"
    blocks = evaluate(tx.code_blocks(tx.lines(F.col("x"))), x=code)
    assert blocks == ["import x", "def a():\n    1", "class B:", "    def c(self):\n        2\nvar", "let z = 1"]
    assert evaluate(tx.code_blocks(tx.lines(F.col("x"))), x=" \n\n") == []


def test_strip_covers_all_whitespace(evaluate):
    assert evaluate(tx.strip(F.col("x")), x="\t\x0b\u00a0\u2003a b\u3000\r\x1f") == "a b"


def test_code_text(evaluate):
    text = tx.code_text(tx.lines(F.col("x")))
    assert evaluate(text, x="  a \n\n\t b\n") == "a b"
    assert len(evaluate(text, x="word \n" * 400)) == 1999
    limited = tx.code_text(tx.lines(F.col("x")), 512)
    assert len(evaluate(limited, x="word \n" * 400)) == 512


def test_word_jaccard(evaluate):
    score = tx.word_jaccard(tx.words(F.col("a")), tx.words(F.col("b")))

    def of(a, b):
        return evaluate(score, "a string, b string", a=a, b=b)

    assert of("", "  ") == 1.0
    assert of("a", "") == 0.0
    assert of("The cat the", "a CAT\u2003sat") == pytest.approx(1 / 4)


def test_content_hash(evaluate):
    digest = evaluate(tx.content_hash(F.col("x")), x="abc")
    assert digest == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_summary_line(evaluate):
    line = tx.summary_line(*[F.col(c) for c in ("n", "t", "m", "c", "i", "a", "r")])
    schema = "n string, t string, m double, c int, i int, a int, r int"
    assert evaluate(line, schema, n="x.py", t="python", m=72.5, c=2, i=3, a=4, r=1) == (
        "**x.py** (python) | Maintainability: 72/100 | ⚠️ 2 critical issues | +4/-1 lines"
    )
    assert evaluate(line, schema, n="x", t=None, m=0.0, c=0, i=0, a=4, r=0) == "**x** (unknown) | ✅ No issues found"


FINDINGS = [
    ('query = "SELECT * FROM users WHERE id = " + user_id', ["sql_injection"]),
    ("select from where = no plus", []),
    ("insert into t values (" + "1, " * 5 + ") +", ["sql_injection"]),
    ("where x from + select =", []),
    ("element.innerHTML \u00a0= text", ["xss"]),
    ("document.write(x); eval(y)", ["xss"]),
    ('token = "abc"', ["sensitive_data"]),
    ("PASSWORD='x'", ["sensitive_data"]),
    ("api_key =", ["sensitive_data"]),
    ("token = ''", []),
]


@pytest.mark.parametrize("line, expected", FINDINGS)
def test_security_rules(spark, line, expected):
    files = spark.createDataFrame([(1, "python", "x\n" + line)], "file_id int, language string, content string")
    found = rules.scan_lines(files, rules.SECURITY_RULES).collect()
    assert sorted(r["type"] for r in found) == expected
    assert all(r["line"] == 2 for r in found)


def test_long_line_costs_linear_time(spark):
    line = "select from where = " * 20_000
    files = spark.createDataFrame([(1, "python", line)], "file_id int, language string, content string")
    assert rules.scan_lines(files, rules.SECURITY_RULES).count() == 0
    assert rules.scan_lines(files.withColumn("content", F.concat("content", F.lit("+"))), rules.SECURITY_RULES).count() == 1


def test_lint_rules(spark):
    rows = [
        (1, "python", "def f(a):\n" + "x" * 89 + "\ndef g() -> int:\n  def h ( b ) :"),
        (2, "javascript", "var x = 1; console.log(x)\nlet vary = 2\nmyvar x"),
        (3, "go", "var x\n" + "x" * 200),
    ]
    files = spark.createDataFrame(rows, "file_id int, language string, content string")
    found = {(r["file_id"], r["line"], r["rule_id"]) for r in rules.language_lint(files).collect()}
    assert found == {
        (1, 1, "python.return_type"), (1, 2, "python.line_length"), (1, 4, "python.return_type"),
        (2, 1, "script.var"), (2, 1, "script.console_log"),
    }


def test_suggestions(evaluate):
    def kinds(make, text):
        return [s["type"] for s in evaluate(make(F.col("x")), x=text)]

    assert kinds(rules.python_suggestions, "from a import *\ntry:\nexcept:") == ["import", "exception_handling"]
    assert kinds(rules.python_suggestions, "except:\nexcept Exception:") == []
    assert kinds(rules.script_suggestions, "a == b") == ["comparison"]
    assert kinds(rules.script_suggestions, "a == b; c === d") == []


@pytest.mark.parametrize(
    "path, expected",
    [("main.py", "python"), ("app.js", "javascript"), ("component.tsx", "typescript"), ("style.css", "css"),
     ("README.md", "markdown"), ("unknown.xyz", "unknown"), ("Makefile", "unknown"), ("a/B.PY", "python")],
)
def test_language(evaluate, path, expected):
    assert evaluate(nz.language(F.col("x")), x=path) == expected


def test_file_parts(evaluate):
    assert evaluate(nz.file_extension(F.col("x")), x="a.b/c") == "b/c"
    assert evaluate(nz.file_extension(F.col("x")), x="dir/file") is None
    assert evaluate(nz.file_name(F.col("x")), x="a/b/c.py") == "c.py"
