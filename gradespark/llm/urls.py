"""Allow or block URLs: rules first, then a logistic regression on hashed character n-grams.

Everything is built-in functions on columns. The regression is trained from a
small labelled table: its rows become one row of arrays, in which each step of
gradient descent is a fold. What it learns is one array of weights, which the
projection over all pages reads as a literal; there is no join and no shuffle.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradespark.llm.common import narrow, settled

#: What is done with pages of a host and all its subdomains below a path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
BUCKETS = 16_384
SIZES = (3, 4)
#: Most labelled rows that a model is fitted on: those with the smallest hashes of their URLs.
MAX_LABELLED = 2_000
STEPS, RATE, RIDGE = 400, 4.0, 3e-4
_PARTS = "://([^/?#]*)([^?#]*)"
_OTHER, _DIGITS = "[^a-z0./_-]", "0+"

# Labelled examples: invented hosts of the kinds that corpus builders keep and drop. Pages of both
# kinds have the same prefixes and paths in turn, so that only their names tell them apart.
ALLOWED = """
daily-herald.example cityobserver.example morningpost.example.com stateuniversity.example libraryofscience.example.org oldcollege.example
docs.opentools.example wiki.gardeners.example commons.example.net kitchentable.example travelnotes.example.com woodworker.example
forum.cyclists.example stadtanzeiger.example kleinstadt.example.org schulportal.example kunsthaus.example nordsee.example.net
lejournal.example bibliotheque.example.com grandmere.example elcorreo.example universidad.example.org recetario.example
healthservice.example valley-hospital.example.com weatheroffice.example sharedrepos.example.net mapservice.example trainschedule.example
parliament.example district-court.example.org oldbooks.example birdwatch.example.com chessclub.example footballdaily.example
theaterplan.example orchester.example.net astronomie.example landscape.example.com bookseller.example hardwarestore.example
languagecourse.example.org storytime.example farmersunion.example harbour.example.com mountainhut.example openlectures.example
geology.example tennis.example.net insectbook.example oceancurrents.example helpinghands.example.org architekten.example
poets.example vinoteca.example.com inventors.example kindergarten.example dentist.example.net coast.example
theatre.example thesaurus.example.com philosophy.example nation-stories.example station.example.org statistics.example
weavers.example tion.linguists.example.com here.there.example cheap-trains.example free-courses.example.net better-gardens.example
adsorption.example roads.example.com track-and-field.example winter.example pillow.example.org card-catalogue.example
"""
BLOCKED = """
casino-royal.example best-casino.example.com casino-online.example vip-casino.example.net casino-spins.example.org win-casino.example
big-bets.example.com sure-bets.example bets-today.example.org online-bets.example poker-cash.example.com free-spins.example
jackpot-win.example cheap-meds.example.com pills-online.example diet-pills.example.net buy-pills.example.org cheap-viagra.example
viagra-shop.example no-prescription-meds.example.com pills-cheap.example sleeping-pills.example.net banner-track.example ads-network.example.com
track-ads.example popup-ads.example.org ads-banner.example click-ads.example.com ads-server.example tracker-ads.example.net
hot-sex-cams.example xxx-videos.example.com porn-tube.example sex-dating.example.org adult-cams.example free-porn.example
easy-loans.example payday-loans.example.com quick-cash-win.example make-money-fast.example.net crypto-doubler.example bitcoin-win.example
replica-watches.example.com fake-bags-cheap.example cracked-keygen.example warez-free.example.org login-verify.example gift-cards-win.example
lottery-win.example.net win-prize-now.example free-bets-bonus.example casino-bets.example.com adult-xxx.example pills-meds.example
"""
_PREFIXES, _PATHS = ("", "www.", "m.", "blog."), ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/{}/index.html", "/", "/en/{}/page")


def _examples() -> list[tuple[str, str]]:
    found = []
    for verdict, hosts in (("allow", ALLOWED.split()), ("block", BLOCKED.split())):
        for i, host in enumerate(hosts):
            for k in (i, i + 2):
                found.append((f"https://{_PREFIXES[k % len(_PREFIXES)]}{host}{_PATHS[k % len(_PATHS)].format(100 + 37 * i)}", verdict))
    return found


@dataclass(frozen=True)
class Model:
    """``bias`` and a weight for every bucket of n-grams; above one half a score means block."""

    bias: float
    weights: tuple[float, ...]


def _as_text(url: Column) -> Column:
    return F.coalesce(url.cast("string"), F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_as_text(url), _PARTS, 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_as_text(url), _PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (null: none); of equally long ones that of the longer host, then block."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for does, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"), r[0])):
        name, below = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(below)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(does)).otherwise(verdict)
    return rule, verdict


def buckets_of(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of host and path, runs of digits taken as 0, other than ``a-z . / _ -`` as ``~``."""

    def grams(text: Column, tag: str) -> Column:
        plain = F.translate(text, string.ascii_uppercase + "123456789", string.ascii_lowercase + "0" * 9)
        chars = F.filter(F.split(F.concat(F.lit("^^"), F.regexp_replace(F.regexp_replace(plain, _OTHER, "~"), _DIGITS, "0"), F.lit("$$")), ""), lambda c: c != "")
        # Held once per URL: what a lambda reads from outside is computed again for each of its elements.
        at = lambda c, n: F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.md5(F.concat(F.lit(tag), *[F.get(c, i + k) for k in range(n)])))
        return F.flatten(F.transform(F.array(chars), lambda c: F.concat(*[at(c, n) for n in SIZES])))

    bucket = lambda h: F.conv(F.substring(h, 1, 4), 16, 10).cast("int") % BUCKETS
    return F.array_distinct(F.transform(F.concat(grams(host, "h"), grams(path, "p")), bucket))


def learn(labelled: DataFrame, url_col: str = "url", verdict_col: str = "verdict") -> Model:
    """Fit the regression on ``labelled`` rows whose verdict is allow or block and whose URL is not null.

    At most ``MAX_LABELLED`` distinct rows take part, those with the smallest
    hashes. Without any the model allows everything.
    """
    rows = narrow(labelled, {"url": F.col(url_col).cast("string"), "verdict": F.col(verdict_col).cast("string")})
    rows = rows.where(F.col("url").isNotNull() & F.col("verdict").isin("allow", "block")).distinct()
    rows = rows.orderBy(F.md5("url"), "url", "verdict").limit(MAX_LABELLED)
    rows = rows.select(F.struct(F.md5("url").alias("h"), "url", "verdict", buckets_of(host_of(F.col("url")), path_of(F.col("url"))).alias("b")).alias("e"))
    table = rows.groupBy().agg(F.array_sort(F.collect_list("e")).alias("e"))
    table = settled(table).select(
        F.col("e.b").alias("b"), F.transform("e.verdict", lambda v: F.when(v == "block", 1.0).otherwise(0.0)).alias("y"),
        F.transform("e.b", lambda b: 1 / F.sqrt(F.size(b))).alias("unit"), F.array_sort(F.array_distinct(F.flatten("e.b"))).alias("words"))
    table = settled(table)
    # By row the places of its buckets among those that occur, and by bucket the rows that hold it.
    table = table.select("y", "unit", "words", F.transform("b", lambda b: F.transform(b, lambda x: F.array_position("words", x).cast("int") - 1)).alias("held"),
                         F.transform("words", lambda x: F.filter(F.transform("b", lambda b, i: F.when(F.array_contains(b, x), i)), lambda i: i.isNotNull())).alias("in"))
    table = settled(table)
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, x: s + f(x))

    def step(w: Column, _: Column) -> Column:
        """One step down the mean logistic loss; the bias is the last of ``w`` and free of the ridge."""
        guess = lambda b, i: 1 / (1 + F.exp(-F.get(w, F.size("words")) - F.get("unit", i) * total(b, lambda k: F.get(w, k))))
        left = F.transform("held", lambda b, i: (F.get("y", i) - guess(b, i)) / F.size("y"))
        pull = lambda r, x, j: F.when(j == F.size("words"), total(r, lambda v: v)).otherwise(
            total(F.get("in", j), lambda e: F.get(r, e) * F.get("unit", e)) - RIDGE * x)
        return F.flatten(F.transform(F.array(left), lambda r: F.transform(w, lambda x, j: x + RATE * pull(r, x, j))))

    start = F.array_repeat(F.lit(0.0), F.size("words") + 1)
    found = table.where(F.size("y") > 0).select("words", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("w")).first()
    weights = [0.0] * BUCKETS
    if found is None:
        return Model(-100.0, tuple(weights))
    for bucket, weight in zip(found.words, found.w):
        weights[bucket] = weight
    return Model(found.w[-1], tuple(weights))


def score(model: Model, host: Column, path: Column) -> Column:
    """Probability, by the model, that the URL is one to block."""
    weights = F.expr(f"array({', '.join(f'{w!r}D' for w in model.weights)})")  # a literal once it is optimised
    sums = F.transform(F.array(buckets_of(host, path)), lambda held: F.aggregate(held, F.lit(0.0), lambda s, b: s + F.get(weights, b), lambda s: s / F.sqrt(F.size(held))))
    return 1 / (1 + F.exp(-F.lit(model.bias) - F.get(sums, 0)))


def judge(pages: DataFrame, model: Model, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` of every row, nulls and repeated rows included.

    The verdict is that of the longest rule whose host is the URL's or a parent
    of it and whose path begins the URL's; without one the model's: block from a
    score of one half on. A null URL, or one without ``://``, has an empty host
    and path. ``score`` is the model's, to six places, for rows with a rule too.
    """
    rows = narrow(pages, {"page_id": id_col, "url": url_col}).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("score", F.round(score(model, F.col("host"), F.col("path")), 6))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def _values() -> str:
    return ", ".join(f"('{u}', '{v}')" for u, v in _examples())


def examples(spark: SparkSession) -> DataFrame:
    """Pages of the labelled hosts as ``(url, verdict)``: two of each, under different prefixes and paths."""
    return spark.sql(f"select * from values {_values()} as t(url, verdict)")


def _oracle() -> str:
    lower = lambda c: f"translate({c}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts = lambda c: f"{lower(f'regexp_extract(coalesce({c}, $$$$), $${_PARTS}$$, 1)')} as host, regexp_extract(coalesce({c}, ''), '{_PARTS}', 2) as path"

    def grams(c: str, tag: str) -> str:
        text = f"('^^' || regexp_replace(regexp_replace(translate({c}, '{string.ascii_uppercase}123456789', '{string.ascii_lowercase}000000000'), '{_OTHER}', '~', 'g'), '{_DIGITS}', '0', 'g') || '$$')"
        return " || ".join(f"list_transform(range(len({text}) - {n - 1}), lambda i: md5('{tag}' || substr({text}, i + 1, {n})))" for n in SIZES)

    held = f"list_distinct(list_transform({grams('host', 'h')} || {grams('path', 'p')}, lambda h: ('0x' || h[1:4])::int % {BUCKETS})) as b"
    rules = sorted(RULES, key=lambda r: len(r[1]), reverse=True)
    fits = [f"when (host = '{t[: t.index('/')]}' or suffix(host, '.{t[: t.index('/')]}')) and prefix(path, '{t[t.index('/') :]}') then" for _, t in rules]
    case = lambda k: f"case {' '.join(f'{f} {chr(39)}{r[k]}{chr(39)}' for f, r in zip(fits, rules))} end"
    total = lambda c, f: f"coalesce(list_sum(list_transform({c}, {f})), 0)"
    guess = f"1 / (1 + exp(-w[len(words) + 1] - unit[i] * {total('held[i]', 'lambda k: w[k]')}))"
    left = f"list_transform(range(1, len(y) + 1), lambda i: (y[i] - {guess}) / len(y)) as r"
    move = f"case when j > len(words) then list_sum(r) else {total('rows[j]', 'lambda e: r[e] * unit[e]')} - {RIDGE} * w[j] end"
    return f"""
with recursive l as (
  select *, row_number() over (order by md5(url), url, verdict) as i, {held} from (select distinct url, verdict, {parts('url')} from (values {_values()}) t(url, verdict))
), e as (select i, unnest(b) as b from l), n as (select b, row_number() over (order by b) as j from (select distinct b from e)), x as (
  select (select list(case verdict when 'block' then 1.0::double else 0 end order by i) from l) as y,
    (select list(1 / sqrt(len(b)) order by i) from l) as unit, (select list(b order by j) from n) as words,
    (select list(js order by i) from (select i, list(j) as js from e join n using (b) group by i)) as held,
    (select list(is_ order by j) from (select j, list(i order by i) as is_ from e join n using (b) group by j)) as rows
), t(step, w) as (
  select 0, list_transform(range(len(words) + 1), lambda i: 0::double) from x
  union all
  select step + 1, list_transform(range(1, len(w) + 1), lambda j: w[j] + {RATE} * ({move})) from (select t.*, x.*, {left} from t, x where step < {STEPS})
), m as (select w[len(w)] as bias, map_from_entries(list_transform(range(1, len(w)), lambda j: {{'k': words[j], 'v': w[j]}})) as weights from t, x where step = {STEPS}),
p as (select page_id, host, path, {held} from (select page_id, {parts('url')} from pages)),
d as (select any_value(b) as b, host, path from p group by host, path),
ds as (select host, path, round(1 / (1 + exp(-bias - {total('b', 'lambda k: coalesce(weights[k], 0)')} / sqrt(len(b)))), 6) as score from d, m)
select page_id, host, path, {case(1)} as rule, coalesce({case(0)}, case when score >= 0.5 then 'block' else 'allow' end) as verdict, score
from p join ds using (host, path)
"""


ORACLE = _oracle()
