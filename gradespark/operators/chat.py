"""Conversations as chat-formatted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The markers and texts of the chat format.
START = "<|im_start|>"
END = "<|im_end|>\n"
DEFAULT_SYSTEM = "You are a helpful assistant."
TOOLS_INTRO = (
    "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
    "You are provided with function signatures within <tools></tools> XML tags:\n<tools>"
)
TOOLS_OUTRO = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments "
    "within <tool_call></tool_call> XML tags:\n<tool_call>\n"
    '{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
)

# Turn numbers whose messages are put in order together. Only the cost depends
# on it: what meets at the edges of such ranges is found through their ends.
TURNS = 4096

CALLS_TYPE = "array<struct<name:string,arguments:string>>"


def _call(call: Column) -> Column:
    return F.concat(
        F.lit('\n<tool_call>\n{"name": "'), F.coalesce(call["name"], F.lit("")), F.lit('", "arguments": '),
        F.coalesce(call["arguments"], F.lit("")), F.lit("}\n</tool_call>"),
    )


def _message(first: Column, before: Column, after: Column) -> Column:
    """Text of one message, given whether it is the first and the roles next to it."""
    role, text, calls = F.col("role"), F.coalesce("text", F.lit("")), F.col("tool_calls")
    has_calls = F.coalesce(F.size(calls) > 0, F.lit(False))
    plain = F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))
    calling = F.concat(
        F.lit(START), role, F.when(text != "", F.concat(F.lit("\n"), text)).otherwise(""),
        F.array_join(F.transform(calls, _call), ""), F.lit(END),
    )
    is_tool = lambda other: F.coalesce(other == "tool", F.lit(False))
    answer = F.concat(
        F.when(is_tool(before), "").otherwise(START + "user"),
        F.lit("\n<tool_response>\n"), text, F.lit("\n</tool_response>"),
        F.when(is_tool(after), "").otherwise(END),
    )
    return (
        F.when(first & (role == "system"), F.lit(""))
        .when((role == "user") | (role == "system") | ((role == "assistant") & ~has_calls), plain)
        .when(role == "assistant", calling)
        .when(role == "tool", answer)
        .otherwise("")
    )


def _opening(tools: Column | None) -> Column:
    """The system block before the first message, which replaces the default if it is a system message."""
    system = F.when(F.col("role") == "system", F.coalesce("text", F.lit(""))).otherwise(DEFAULT_SYSTEM)
    block = F.concat(F.lit(START + "system\n"), system, F.lit(END))
    if tools is None:
        return block
    with_tools = F.concat(
        F.lit(START + "system\n"), system, F.lit(TOOLS_INTRO),
        F.array_join(F.transform(tools, lambda tool: F.concat(F.lit("\n"), tool)), ""),
        F.lit(TOOLS_OUTRO + END),
    )
    return F.when(F.coalesce(F.size(tools) > 0, F.lit(False)), with_tools).otherwise(block)


def render(
    messages: DataFrame,
    *,
    tools: Column | None = None,
    generation_prompt: bool = False,
    turns: int = TURNS,
) -> DataFrame:
    """Rows (conv_id, turn, text), one for each message; in order of ``turn`` they join to the conversation's text.

    ``messages``: conv_id, turn (unique in its conversation; any numbers, NULL
    comes first), role, text (NULL is empty) and optionally tool_calls (name, arguments as JSON).
    ``tools`` is an array of JSON signatures. The first message carries the
    system block, the last one the generation prompt.
    """
    if "tool_calls" not in messages.columns:
        messages = messages.withColumn("tool_calls", F.lit(None).cast(CALLS_TYPE))
    # Ranges of turns keep a long conversation out of one task. A range learns
    # the roles next to it from the ends of the conversation's other ranges.
    ranged = messages.select("conv_id", "turn", "role", "text", "tool_calls", F.coalesce(F.floor(F.col("turn") / turns).cast("bigint"), F.lit(-(1 << 62))).alias("_range"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    ends = ranged.groupBy("conv_id", "_range").agg(F.min_by("role", place).alias("_first"), F.max_by("role", place).alias("_last"))
    order = Window.partitionBy("conv_id").orderBy("_range")
    ends = ends.select(
        F.col("conv_id").alias("_conv"), F.col("_range").alias("_of"), F.lag("_last").over(order).alias("_before"), F.lead("_first").over(order).alias("_after"),
        (F.row_number().over(order) == 1).alias("_opens"), F.lead("_range").over(order).isNull().alias("_closes"),
    )
    joined = ranged.join(ends, ranged["conv_id"].eqNullSafe(F.col("_conv")) & (F.col("_range") == F.col("_of")))
    inside = Window.partitionBy("conv_id", "_range").orderBy("turn")
    marked = joined.select(
        "conv_id", "turn", "role", "text", "tool_calls",
        F.coalesce(F.lag("role").over(inside), "_before").alias("_prev"), F.coalesce(F.lead("role").over(inside), "_after").alias("_next"),
        ((F.row_number().over(inside) == 1) & F.col("_opens")).alias("_is_first"),
        (F.lead(F.lit(True)).over(inside).isNull() & F.col("_closes")).alias("_is_last"),
    )
    text = F.concat(F.when(F.col("_is_first"), _opening(tools)).otherwise(""), _message(F.col("_is_first"), F.col("_prev"), F.col("_next")))
    if generation_prompt:
        text = F.concat(text, F.when(F.col("_is_last"), START + "assistant\n").otherwise(""))
    return marked.select("conv_id", "turn", text.alias("text"))
