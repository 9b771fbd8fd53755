"""Text cleaning against textwrap, str and written-out results."""

import textwrap

from pyspark.sql import functions as F

from gradespark.functions import rtf, text

CASES = [
    "", " ", "\n\n", "x", "```python\nx = 1\n```", "```PY\ny\n```\n", "  ```\n  z\n  ```  ", "```java\nq\n```", "a\n```python\nb\n```",
    "    def f():\n\treturn 1\n", "  a\n   b\n\n    \n  c", "\ta\n\t  b", "\u00a0x\u00a0", "\u2003 y \u2003", "a\r\nb\rc", "a\u0085b", "a\x0bb\x0cc",
    "a\x1cb\x1dc\x1ed\x1fe", "a\u2028b\u2029c", "\x1f lead and trail \x1c", "x\\ny\\tz", "if __name__ == '__main__':\n  run()",
    "def f(): pass\nif  __name__==\"__main__\" :\n  f()\n\u0085 more", "import doctest\n  doctest.testmod()\nx", "import  doctest \n\n\tdoctest.testmod()\n",
    "a\n \n", "trail\n```   \n\n", "one\n\n\n", "\n  \n   a\n  b  \n", "  \t mixed\n  \tb", "tail\n \n ```", "``````", "```python x\n```",
]


def fences(x):
    """Opening and closing fence taken off by hand."""
    body = x.lstrip()
    tags = [t for t in ("```python", "```py", "```") if body.lower().startswith(t)]
    for tag in tags:
        rest = body[len(tag) :]
        blank = rest[: len(rest) - len(rest.lstrip())]
        if "\n" in blank:
            x = rest[blank.rindex("\n") + 1 :]
            break
    body = x.rstrip()
    if body.endswith("```"):
        kept = body[:-3].rstrip()
        blank = body[len(kept) : -3]
        if "\n" in blank:
            x = kept + blank[: blank.index("\n")]
    return x


CLEANED = {
    "": "", " \n ": "", "x = 1": "x = 1", "```python\n    a\n      b\n```": "a\n  b", "  ```PY\nx\n```  ": "x",
    "    def f():\n        return 1": "def f():\n        return 1", "def f():\\n\\treturn 1": "def f():\n\treturn 1",
    "```\n\ta\n\t\tb\n```": "a\n\tb", "```java\nq\n```": "```java\nq",
}
EXTRACTED = {
    "": "", "x": "x", "def f(): pass\nif __name__ == '__main__':\n  f()\nmore": "def f(): pass",
    'a\nif  __name__=="__main__" :\n  f()': "a", "a\\nb": "a\nb", "import doctest\n  doctest.testmod()\nx": "x",
    "a\nimport  doctest \n\n\tdoctest.testmod()\nb\nimport doctest\ndoctest.testmod()": "a\n\nb",
    "```python\nx = 1\n```": "x = 1", "if __name__ == 'other':\n  f()": "if __name__ == 'other':\n  f()", "x\nimport doctest": "x\nimport doctest",
}


def check(spark, mine, theirs):
    rows = spark.createDataFrame([(c,) for c in CASES], "t string")
    got = [r[0] for r in rows.select(mine(F.col("t"))).collect()]
    assert [(c, g, theirs(c)) for c, g in zip(CASES, got) if g != theirs(c)] == []


def test_strip(spark):
    check(spark, text.strip, str.strip)


def test_blank(spark):
    check(spark, text.is_blank, lambda x: not x.strip())
    assert spark.range(1).select(text.is_blank(F.lit(None).cast("string"))).first()[0] is True


def test_fences(spark):
    check(spark, text.strip_code_fences, fences)


def test_dedent(spark):
    check(spark, text.dedent, textwrap.dedent)


def literal(spark, function, cases):
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in rows.select(function(F.col("t"))).collect()] == list(cases.values())


def test_clean(spark):
    literal(spark, text.clean_completion, CLEANED)


def test_extract(spark):
    literal(spark, text.extract_functions, EXTRACTED)


def test_split_lines(spark):
    check(spark, text.split_lines, str.splitlines)


def test_tokens_dropped(spark):
    all_tokens = text.DROPPED_TOKENS + text.KEPT_TOKENS
    assert len(all_tokens) == 22
    row = spark.range(1).select(text.drop_special_tokens(F.lit("a" + "".join(all_tokens) + "b")), text.count_token(F.lit("<|im_end|>x<|im_end|>"), "<|im_end|>")).first()
    assert row[0] == "a" + "".join(text.KEPT_TOKENS) + "b" and row[1] == 2


def test_rtf(spark):
    B = "\\"
    cases = {
        B + "u1055?" + B + "u1088?": "\u041f\u0440",
        B + "u-3913?": chr(65536 - 3913),
        B + "u55357?" + B + "u56832?": "\U0001f600",
        "x" + B + "u55357? y": "x\ufffd y",
        B + "u56832?" + B + "u55357?" + B + "u56832?": "\ufffd\U0001f600",
        "{" + B + "fonttbl a b}rest": "rest",
        "{" + B + "fonttbl a\nb}rest": "a\nbrest",
        B + "par one" + B + "fs24 two": "onetwo",
        "{plain} {braces}": "plain braces",
        "": "",
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in rows.select(rtf.rtf_to_text(F.col("t"))).collect()]
    assert got == list(cases.values())
