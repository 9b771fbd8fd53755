"""Text cleaning for completions, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The whitespace of Python's str methods is Unicode White_Space
# (\s under the U flag) plus the four separators x1c-x1f.
_SPACE = r"[\s\x1c-\x1f]"
_NOT_AFTER_SPACE = r"(?<![\s\x1c-\x1f])"

# Line ends of str.splitlines.
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Code fences, main block and doctest block of a completion.
_FENCE_OPEN = rf"(?iU)\A{_SPACE}*```(?:py(?:thon)?)?{_SPACE}*\n"
_FENCE_CLOSE = rf"(?U)\n{_SPACE}*+```{_SPACE}*+\z"
_MAIN_BLOCK = (
    rf"(?sU)if{_SPACE}+__name__{_SPACE}*=={_SPACE}*['\"]__main__['\"]{_SPACE}*:.*"
)
_DOCTEST_BLOCK = rf"(?U)import{_SPACE}+doctest{_SPACE}*\n{_SPACE}*doctest\.testmod\(\)"

# The 22 added tokens; the first 14 are dropped when decoding.
DROPPED_TOKENS = [
    "<|endoftext|>",
    "<|im_start|>",
    "<|im_end|>",
    "<|object_ref_start|>",
    "<|object_ref_end|>",
    "<|box_start|>",
    "<|box_end|>",
    "<|quad_start|>",
    "<|quad_end|>",
    "<|vision_start|>",
    "<|vision_end|>",
    "<|vision_pad|>",
    "<|image_pad|>",
    "<|video_pad|>",
]
KEPT_TOKENS = [
    "<tool_call>",
    "</tool_call>",
    "<|fim_prefix|>",
    "<|fim_middle|>",
    "<|fim_suffix|>",
    "<|fim_pad|>",
    "<|repo_name|>",
    "<|file_sep|>",
]
FIRST_TOKEN_ID = 151643


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated, and written into the plan, once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fill(template: str, *values: Column) -> Column:
    """``template`` with its ``%s`` filled in, by plain concatenation."""
    first, *rest = template.split("%s")
    return F.concat(F.lit(first), *[x for value, part in zip(values, rest) for x in (value, F.lit(part))])


def _any_of(tokens: list[str]) -> str:
    return "|".join(t.replace("|", r"\|") for t in tokens)


def lstrip(text: Column) -> Column:
    """Drop leading whitespace in Python's sense."""
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+", "")


def rstrip(text: Column) -> Column:
    """Drop trailing whitespace in Python's sense."""
    # The lookbehind lets only the first character of a blank run start a
    # match, so long blank runs inside a text stay linear.
    return F.regexp_replace(text, rf"(?U){_NOT_AFTER_SPACE}{_SPACE}++\z", "")


def strip(text: Column) -> Column:
    """Drop whitespace at both ends in Python's sense."""
    return rstrip(lstrip(text))


def is_blank(text: Column) -> Column:
    """True for NULL, empty and whitespace-only text."""
    return F.coalesce(~text.rlike(rf"(?U)[^\s\x1c-\x1f]"), F.lit(True))


def strip_code_fences(code: Column) -> Column:
    """Drop one opening and one closing Markdown fence."""
    return F.regexp_replace(F.regexp_replace(code, _FENCE_OPEN, ""), _FENCE_CLOSE, "")


def dedent(text: Column) -> Column:
    """Remove the whitespace prefix that all non-blank lines share."""
    def cut(lines: Column) -> Column:
        indents = F.transform(
            F.filter(lines, lambda line: line != ""),
            lambda line: F.regexp_extract(line, r"\A[ \t]*", 0),
        )
        return let(
            let(indents, margin),
            lambda n: F.array_join(
                F.transform(lines, lambda line: F.substring(line, n + 1, F.length(line))), "\n"
            ),
        )

    def margin(indents: Column) -> Column:
        # The prefix common to all strings is the one common to the smallest
        # and the largest of them.
        extremes = F.concat(F.array_min(indents), F.lit("|"), F.array_max(indents))
        shared = F.regexp_extract(extremes, r"\A([ \t]*)[ \t]*\|\1", 1)
        return F.length(F.coalesce(shared, F.lit("")))

    lines = F.transform(
        F.split(text, "\n", -1), lambda line: F.regexp_replace(line, r"\A[ \t]+\z", "")
    )
    return let(lines, cut)


def unescape_newlines(text: Column) -> Column:
    """Turn the two characters backslash-n into a line feed."""
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def unescape(text: Column) -> Column:
    """Turn literal backslash-n and backslash-t into the control characters."""
    return F.replace(unescape_newlines(text), F.lit("\\t"), F.lit("\t"))


def clean_completion(text: Column) -> Column:
    """The cleaning every decoded completion goes through."""
    return unescape(strip(dedent(strip_code_fences(strip(text)))))


def extract_functions(text: Column) -> Column:
    """Keep the code in front of a main block, without doctest calls and fences."""
    code = F.regexp_replace(unescape_newlines(text), _MAIN_BLOCK, "")
    code = F.regexp_replace(code, _DOCTEST_BLOCK, "")
    return strip(strip_code_fences(code))


def split_lines(text: Column) -> Column:
    """``str.splitlines`` as an array of lines."""
    return let(
        F.split(text, _LINE_END, -1),
        lambda lines: F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines),
    )


def drop_special_tokens(text: Column) -> Column:
    """Remove the tokens a decoder skips; the other added tokens stay."""
    return F.regexp_replace(text, _any_of(DROPPED_TOKENS), "")


def count_token(text: Column, token: str) -> Column:
    """How often one added token occurs."""
    return F.regexp_count(text, F.lit(_any_of([token])))


def token_table(spark: SparkSession) -> DataFrame:
    """(token, id, special): the added tokens, numbered without gaps."""
    tokens = DROPPED_TOKENS + KEPT_TOKENS
    rows = [(t, FIRST_TOKEN_ID + i, t in DROPPED_TOKENS) for i, t in enumerate(tokens)]
    return spark.createDataFrame(rows, "token string, id int, special boolean")
