"""Generation settings of runs, as maps of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default settings and those of a greedy run.
DEFAULTS = {
    "max_new_tokens": "400",
    "do_sample": "true",
    "temperature": "0.6",
    "top_k": "40",
    "pad_token_id": "151643",
    "eos_token_id": "151643",
}
GREEDY = {"do_sample": "false", "temperature": "0.0", "top_k": "1", "top_p": "1.0"}


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _overlay(below: Column, above: Column) -> Column:
    """Both maps; a key of ``above`` wins."""
    free = F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k))
    return F.map_concat(free, above)


def _given(config: Column) -> Column:
    """The settings that have a value; no map counts as an empty one."""
    empty = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    return F.map_filter(F.coalesce(config, empty), lambda k, v: v.isNotNull())


def effective_config(config: Column, input_length: Column | None = None) -> Column:
    """Defaults under the given settings, and ``max_length`` for a known prompt."""
    merged = _overlay(_literal_map(DEFAULTS), _given(config))
    if input_length is None:
        return merged
    limit = input_length.cast("bigint") + F.element_at(merged, "max_new_tokens").cast("bigint")
    return _overlay(merged, F.create_map(F.lit("max_length"), limit.cast("string")))


def greedy_config(config: Column) -> Column:
    """The settings with sampling switched off; beams only where they were set."""
    greedy = _overlay(config, _literal_map(GREEDY))
    return F.transform_values(greedy, lambda k, v: F.when(k == "num_beams", F.lit("1")).otherwise(v))
