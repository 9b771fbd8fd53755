"""License scans: ordered rules with a keyword in front of each, overlaps resolved by priority.

A text becomes its lower-cased words, each between blanks of its own. A rule
is a priority, a label, a keyword and a regular expression over such words. Its
expression only runs where all words that it needs occur, and none runs on
texts without any keyword. A detection inside a stronger one (higher priority, or the same
and longer) is suppressed. Everything is one projection of built-in functions.
"""

from __future__ import annotations

import json
from collections import Counter
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradespark.llm.common import narrow

# Phrases and labels of the base scan.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# What licenses are called, as words; "x?" may be missing, "x|y" is either.
NAMES = {
    "apache-2.0": ["apache software? license|licence version? v?|v2? 2 0", "apache software? license|licence v?|version? 2", "apache 2 0 license|licence?", "apache2"],
    "apache-1.1": ["apache software? license|licence version? 1 1"],
    "apache": ["apache software? license|licence"],
    "mit": ["mit license|licence", "mit x11 license|licence", "expat license|licence", "x11 license|licence"],
    "bsd-2-clause": ["bsd 2 clause license|licence?", "2|two clause bsd license|licence?", "simplified bsd license|licence", "freebsd license|licence"],
    "bsd-3-clause": ["bsd 3 clause license|licence?", "3|three clause bsd license|licence?", "new|revised|modified bsd license|licence"],
    "bsd-4-clause": ["bsd 4 clause license|licence?", "4|four clause bsd license|licence?", "original bsd license|licence"],
    "bsd": ["bsd license|licence", "bsd style license|licence"],
    "gpl-3.0": ["gnu? general public license|licence version?|v? 3|v3 0?", "gnu? gpl version?|v? 3|v3 0?", "gplv3"],
    "gpl-2.0": ["gnu? general public license|licence version?|v? 2|v2 0?", "gnu? gpl version?|v? 2|v2 0?", "gplv2"],
    "gpl-any": ["gnu general public license|licence", "gnu gpl", "general public license|licence"],
    "lgpl-3.0": ["gnu? lesser general public license|licence version?|v? 3|v3 0?", "gnu? lgpl version?|v? 3|v3 0?", "lgplv3"],
    "lgpl-2.1": ["gnu? lesser general public license|licence version?|v? 2|v2 1", "gnu? lgpl version?|v? 2|v2 1"],
    "lgpl": ["gnu? lesser|library general public license|licence", "gnu? lgpl"],
    "agpl-3.0": ["gnu? affero general public license|licence version?|v? 3|v3 0?", "gnu? agpl version?|v? 3|v3 0?", "agplv3"],
    "agpl": ["gnu? affero general public license|licence"],
    "gfdl": ["gnu? free documentation license|licence version? 1? 1|2|3?"],
    "mpl-2.0": ["mozilla public license|licence version?|v? 2 0?", "mpl 2 0"],
    "mpl-1.1": ["mozilla public license|licence version?|v? 1 1"],
    "mpl": ["mozilla public license|licence"],
    "epl-2.0": ["eclipse public license|licence version?|v? 2 0?"],
    "epl-1.0": ["eclipse public license|licence version?|v? 1 0?"],
    "cddl": ["common development and distribution license|licence version? 1? 0|1?"],
    "cpl": ["common public license|licence version? 1? 0?"],
    "eupl": ["european union public license|licence version?|v? 1? 1|2?"],
    "isc": ["isc license|licence"],
    "zlib": ["zlib libpng? license|licence"],
    "artistic-2.0": ["artistic license|licence version? 2 0?"],
    "artistic": ["artistic license|licence"],
    "boost-1.0": ["boost software license|licence version? 1? 0?"],
    "python": ["python software foundation license|licence", "psf license|licence"],
    "php": ["php license|licence version? 3? 0|01?"],
    "ruby": ["ruby license|licence"],
    "perl": ["same terms as perl itself?"],
    "openssl": ["openssl license|licence"],
    "ms-pl": ["microsoft public license|licence"],
    "ms-rl": ["microsoft reciprocal license|licence"],
    "ofl-1.1": ["sil? open font license|licence version? 1? 1?"],
    "odbl": ["open database license|licence version?|v? 1? 0?"],
    "unlicense": ["the unlicense", "unlicense license|licence"],
    "wtfpl": ["do what the fuck you want to public license|licence", "wtfpl license|licence?"],
    "cc0": ["cc0 1? 0?", "creative commons zero", "cc zero"],
    "cc-by-nc-nd": ["cc by nc nd 1|2|3|4? 0|5?", "creative commons attribution noncommercial noderivatives|noderivs 4|3? 0?"],
    "cc-by-nc-sa": ["cc by nc sa 1|2|3|4? 0|5?", "creative commons attribution noncommercial sharealike 4|3? 0?"],
    "cc-by-nc": ["cc by nc 1|2|3|4? 0|5?", "creative commons attribution noncommercial|non commercial? 4|3? 0?"],
    "cc-by-nd": ["cc by nd 1|2|3|4? 0|5?", "creative commons attribution noderivatives|noderivs 4|3? 0?"],
    "cc-by-sa": ["cc by sa 1|2|3|4? 0|5?", "creative commons attribution sharealike|share alike? 4|3? 0?"],
    "cc-by": ["cc by 1|2|3|4? 0|5?", "creative commons attribution 4|3? 0?"],
    "cc": ["creative commons license|licence"],
    "public-domain": ["in|into|to the public domain", "public domain dedication"],
    "reserved": ["all rights reserved"],
    "proprietary": ["proprietary and confidential", "proprietary license|licence", "unauthorized copying of this file"],
}
# Identifiers that stand in for a name behind "SPDX-License-Identifier".
IDENTIFIERS = [
    "apache-2.0", "mit", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later",
    "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0-only", "lgpl-3.0-or-later", "agpl-3.0-only", "agpl-3.0-or-later", "mpl-2.0", "epl-2.0", "isc",
    "zlib", "bsl-1.0", "unlicense", "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0", "ofl-1.1", "wtfpl", "0bsd",
]
# How a license is granted; the name follows.
GRANTS = [
    "licensed|released|distributed|published|available|provided under the? terms? of? the?",
    "subject to the? terms? of? the?", "governed by the? terms? of? the?",
]
# Words that hint at a license without naming one.
HINTS = {
    "grant": ["permission is hereby granted free of charge", "redistribution and use in source and binary forms", "licensed under the? following|terms?"],
    "warranty": ["without warranties or conditions of any kind", "as is without warranty of any kind", "without any warranty"],
    "copyright": ["copyright c? holders?", "copyright c 1|2?", "copyright"],
    "license-file": ["see the? license|licence file? for", "license|licence agreement", "end user license|licence agreement"],
}
#: Priorities, the strongest first, and how sure a detection of each makes.
GRANT, IDENTIFIER, NAME, HINT = range(4)
SURE = (1.0, 0.95, 0.8, 0.3)
#: A rule looks for the first of these that its own words contain; texts without any are passed over.
KEYWORDS = ["licen", "cc", "rights", "spdx", "gpl", "apache2", "apache", "domain", "commons", "mpl", "bsd", "perl", "warrant", "permission", "redistribution",
            "copyright", "proprietary", "unauthorized", "wtfpl"]


def _pattern(words: str) -> str:
    out = ""
    for word in words.split():
        either, optional = word.rstrip("?"), word.endswith("?")
        group = f" (?:{either.replace('?', '')}) " if "|" in either else f" {either} "
        out += f"(?:{group})?" if optional else group
    return out


def _keyword(words: str) -> str:
    """A keyword that every match has: from a word that is neither optional nor a choice, or that all choices share."""
    for key in KEYWORDS:
        for word in words.split():
            if not word.endswith("?") and all(key in w for w in word.split("|")):
                return key
    raise ValueError(f"no keyword in {words!r}")


def _needed(words: str) -> list[str]:
    """The words that every match has, each between its blanks."""
    return [f" {w} " for w in dict.fromkeys(words.split()) if not w.endswith("?") and "|" not in w]


def rules() -> list[dict]:
    """All rules in their order: a stronger one comes first. What a rule needs is listed with the rarest word first."""
    named = [(label, words) for label, several in NAMES.items() for words in several]
    out = [(GRANT, label, f"{grant} {words}") for grant, (label, words) in product(GRANTS, named)]
    out += [(IDENTIFIER, name, f"spdx license|licence identifier {' '.join(name.replace('.', '-').split('-'))}") for name in IDENTIFIERS]
    out += [(NAME, label, words) for label, words in named]
    out += [(HINT, label, words) for label, several in HINTS.items() for words in several]
    often = Counter(w for _, _, words in out for w in _needed(words))
    return [
        {"rank": p, "label": label, "keyword": _keyword(words), "needs": sorted(_needed(words), key=lambda w: (often[w], w)), "pattern": _pattern(words)}
        for p, label, words in out
    ]


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _base(words: Column) -> list[Column]:
    """Count, first and last word, and labels of the base phrases in a text of words between blanks."""
    spread = {p: "".join(f" {w} " for w in p.split()) for p in BASE}
    ordinal = lambda end: ((F.length(end) - F.length(F.replace(end, F.lit(" "), F.lit("")))) / 2).cast("bigint")
    count = sum((F.regexp_count(words, F.lit(s)) for s in spread.values()), F.lit(0)).cast("bigint")
    first = [F.when(F.locate(s, words) > 0, ordinal(F.substring(words, F.lit(1), F.locate(s, words) - 1))) for s in spread.values()]
    back = {s: F.locate(s[::-1], F.reverse(words)) for s in spread.values()}
    last = [F.when(at > 0, ordinal(F.substring(words, F.lit(1), F.length(words) - at - len(s) + 1))) for s, at in back.items()]
    labels = F.array_sort(F.array_compact(F.array(*[F.when(F.contains(words, F.lit(s)), F.lit(BASE[p])) for p, s in spread.items()])))
    return [count.alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"), labels.alias("base")]


def _detections(words: Column, table: Column) -> Column:
    """Kept detections: labels, and the strongest priority."""
    # Places of a rule: what stands between its matches, and the matches, add up to them.
    spans = lambda r: F.aggregate(
        F.arrays_zip(F.regexp_extract_all(words, r["pattern"], F.lit(0)).alias("m"), F.split(words, r["pattern"]).alias("p")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,rank:int,label:string>>").alias("out")),
        lambda acc, z: F.struct(
            (acc["at"] + F.length(z["p"]) + F.coalesce(F.length(z["m"]), F.lit(0))).alias("at"),
            F.when(z["m"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(
                (acc["at"] + F.length(z["p"])).alias("s"), (-(acc["at"] + F.length(z["p"]) + F.length(z["m"]))).alias("e"),
                r["rank"].alias("rank"), r["label"].alias("label")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    found = F.array_sort(F.flatten(F.transform(F.filter(table, lambda r: F.forall(r["needs"], lambda w: F.contains(words, w))), spans)))
    # In order of start, then of length, then of priority: an interval can only lie in one that came before.
    ends = F.array(*[F.lit(0)] * len(SURE))
    empty = F.struct(ends.alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(len(SURE)).alias("best"))

    def take(acc: Column, d: Column) -> Column:
        inside = F.exists(F.slice(acc["ends"], F.lit(1), d["rank"] + 1), lambda end: end >= -d["e"])
        reach = F.transform(acc["ends"], lambda end, k: F.when(k == d["rank"], F.greatest(end, -d["e"])).otherwise(end))
        kept = F.struct(reach.alias("ends"), F.array_union(acc["labels"], F.array(d["label"])).alias("labels"), F.least(acc["best"], d["rank"]).alias("best"))
        return F.when(inside, acc).otherwise(kept)

    return F.aggregate(found, empty, take, lambda acc: F.struct(acc["labels"], acc["best"]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row per input row.

    Words are runs of letters and digits; all characters beyond ASCII belong to words. A null text is
    empty. ``labels`` are those of the base phrases and of the detections that
    are not suppressed; ``score`` is the sureness of the strongest (0 without any, that of a name for
    a base phrase alone). Ids may be null or repeat.
    """
    rows = narrow(docs, {"doc_id": F.col(id_col).cast("bigint"), "text": F.coalesce(F.col(text_col).cast("string"), F.lit(""))})
    table = F.from_json(F.lit(json.dumps(rules())), "array<struct<rank:int,label:string,keyword:string,needs:array<string>,pattern:string>>")
    gap, word = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    keys = sorted({r["keyword"] for r in rules()})
    roots = [k for k in keys if not any(o != k and o in k for o in keys)]

    def scanned(low: Column) -> Column:
        words = F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(low, gap, " ")), F.lit(" "), F.lit("  ")), F.lit(" "))
        result = lambda w: F.struct(*_base(w), _detections(w, table).alias("found"))
        gate = F.contains(low, F.lit(roots[0]))
        for root in roots[1:]:
            gate = gate | F.contains(low, F.lit(root))
        return F.when(gate, _let(words, result))

    out = rows.select("doc_id", F.regexp_count("text", F.lit(word)).cast("bigint").alias("n_words"), _let(F.lower("text"), scanned).alias("r"))
    base = F.coalesce(F.col("r.base"), F.array().cast("array<string>"))
    labels = F.array_sort(F.array_union(base, F.coalesce(F.col("r.found.labels"), F.array().cast("array<string>"))))
    sure = F.element_at(F.array(*map(F.lit, [*SURE, 0.0])), F.coalesce(F.col("r.found.best"), F.lit(len(SURE))) + 1)
    return out.select(
        "doc_id", "n_words", F.coalesce("r.n_base", F.lit(0).cast("bigint")).alias("n_base"), F.col("r.first_word").alias("first_word"),
        F.col("r.last_word").alias("last_word"), F.concat_ws(",", base).alias("base_labels"), F.concat_ws(",", labels).alias("labels"),
        F.when(F.size(base) > 0, F.greatest(sure, F.lit(SURE[NAME]))).otherwise(sure).alias("score"))

def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The scan in DuckDB's SQL, over the same rules."""
    table = ",\n  ".join(f"({r['rank']}, {_sql(r['label'])}, [{', '.join(map(_sql, r['needs']))}], {_sql(r['pattern'])})" for r in rules())
    phrases = ", ".join(f"({_sql(p)}, {_sql(label)}, {len(p.split())})" for p, label in BASE.items())
    sure = f"list_extract([{', '.join(f'{s}e0' for s in SURE)}], min(rank) + 1)"
    return rf"""with d as (
  select doc_id, row_number() over () as row, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents
), t as materialized (select *, ' ' || array_to_string(w, '  ') || ' ' as s from d),
rules(rank, label, needs, pattern) as (values
  {table}),
base(phrase, label, size) as (values {phrases}),
b as (
  select row, label, i - 1 as place from (select row, w, unnest(range(1, len(w) + 1)) as i from t where contains(s, ' cc ') or contains(s, ' general ') or contains(s, ' rights ')) x
  join base on array_to_string(w[i:i + size - 1], ' ') = phrase
), bases as (
  select row, count(*) as n, min(place) as first, max(place) as last, string_agg(distinct label, ',' order by label) as labels, list(distinct label) as names from b group by row
), m as (
  select row, rank, label, regexp_extract_all(s, pattern) as m, string_split_regex(s, pattern) as p from t join rules on list_bool_and(list_transform(needs, lambda n: contains(s, n)))
), f as (
  select row, rank, label, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as s, length(m[i]) as n
  from (select *, unnest(range(1, len(m) + 1)) as i from m) x
), k as (
  select * from f where not exists (select 1 from f e where e.row = f.row and e.s <= f.s and e.s + e.n >= f.s + f.n
    and (e.rank < f.rank or e.rank = f.rank and ((e.s, e.n) <> (f.s, f.n) or e.label < f.label)))
), g as (select row, list(distinct label) as names, {sure} as sure from k group by row)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_base, first as first_word, last as last_word, coalesce(bases.labels, '') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.names, []), coalesce(g.names, [])))), ',') as labels,
  greatest(coalesce(sure, 0.0e0), case when n > 0 then {SURE[NAME]}e0 else 0.0e0 end) as score
from t left join bases using (row) left join g using (row)"""
