"""Quality rules with thresholds that adapt to each language and source (operator 13): DataFrame functions only.

Each rule is a rate of a document. A sketch of a rate counts rows by value, rounded down to three digits: sketches of
any parts of the corpus merge by adding counts, in any order and with the same result, a quantile read from one is off
by less than 1 %, and one has at most some 900 counts for each power of ten. Quartiles of a cell (language, source)
give its fences; a cell with few rows uses the merged sketch of its language, a language with few rows that of all.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.lineage import materialize
from .places import group_key
from .texts import WS, dealt

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SALTS = 16


@dataclass
class Rules:
    """Fixed floor of a text, and how far a rate may lie beyond the quartiles of its cell."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    reach: int = 3          # quartile ranges beyond a quartile
    least_rows: int = 30    # rows a cell needs for fences of its own
    #: rate: what it may always lie beyond a quartile, so that a cell of equal values does not reject the next value
    slack: dict[str, int] = field(default_factory=lambda: {"length": 60, "symbols": 50, "doubled": 150, "repeats": 150, "lines": 400, "capitals": 60})
    two_sided: tuple[str, ...] = ("length",)


def let(value, body):
    """body(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words, window: int):
    """Words in windows that the text has twice or more: windows sorted, equal neighbours, places covered."""
    places = F.sequence(F.lit(0), F.size(words) - window)
    grams = F.array_sort(F.transform(places, lambda i: F.struct(F.array_join(F.slice(words, i + 1, window), " ").alias("gram"), i.alias("i"))))
    gram = lambda s, j: F.get(s, j)["gram"]
    twice = lambda s: F.array_sort(F.filter(F.transform(s, lambda x, j: F.when(
        F.coalesce(x["gram"] == gram(s, j - 1), F.lit(False)) | F.coalesce(x["gram"] == gram(s, j + 1), F.lit(False)), x["i"])), lambda i: i.isNotNull()))
    covered = lambda starts: F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + window - F.greatest(a["end"], i)).alias("n"), (i + window).alias("end")))["n"]
    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(grams, lambda s: covered(twice(s))))


def features(docs: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, l, s, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rates), written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    without = lambda chars: F.char_length(F.translate("text", chars, ""))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, WS, "") != "")
    of_words = let(words, lambda w: F.struct(
        F.size(w).alias("n"), _repeated(w, rules.window).alias("repeated"),
        F.aggregate(F.transform(w, lambda x, j: F.coalesce(x == F.get(w, j - 1), F.lit(False)).cast("int")), F.lit(0), lambda a, x: a + x).alias("doubled")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    rows = dealt(docs.select("doc_id", group_key("lang").alias("l"), group_key("source").alias("s"), text.alias("text")))
    big = lambda c: c.cast("bigint")
    out = rows.select(
        "doc_id", "l", "s", of_words.alias("w"), of_lines.alias("x"), big(without(WS)).alias("word_chars"),
        big(F.char_length("text") - without(SYMBOLS)).alias("n_symbols"), big(F.char_length("text") - without(CAPITALS)).alias("n_capitals"))
    return materialize(out.select("doc_id", "l", "s", big(F.col("w.n")).alias("n_words"), "word_chars", "n_symbols", big(F.col("x.dup")).alias("n_dup_lines"),
                                  big(F.col("w.repeated")).alias("n_repeat_words"), big(F.col("w.doubled")).alias("n_doubled"), "n_capitals", big(F.col("x.n")).alias("n_lines")), "features")


def rated(rows: DataFrame, rules: Rules) -> DataFrame:
    """features() with base_failed and the rates, whole numbers."""
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    rate = {
        "length": "100 * word_chars div n_words", "symbols": "1000 * n_symbols div n_words", "doubled": "1000 * n_doubled div n_words",
        "repeats": "1000 * n_repeat_words div n_words", "lines": "1000 * n_dup_lines div n_lines", "capitals": "1000 * n_capitals div word_chars"}
    # a text that fails has no rates; the others have words, and so have lines and characters
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumns({f"r_{k}": F.when(~F.col("base_failed"), F.expr(v)) for k, v in rate.items()})


def sketches(rows: DataFrame, rules: Rules) -> DataFrame:
    """(l, s, rule, value, n): the sketch of every rule in every cell, over all texts that pass the floor."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"r_{k}").alias("value")) for k in rules.slack])).alias("r")
    unit = F.expr("cast(power(10, greatest(0, length(cast(r.value as string)) - 3)) as bigint)")
    values = rows.filter("NOT base_failed").select("l", "s", each).select("l", "s", "r.rule", F.expr("r.value").alias("v"), unit.alias("u"))
    return values.groupBy("l", "s", "rule", F.expr("v div u * u").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *cell: str) -> DataFrame:
    """The sketches of larger cells."""
    return sketch.groupBy(*cell, "rule", "value").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *cell: str) -> DataFrame:
    """(*cell, rule, rows, low, high): the quartiles of each sketch; a window sees the counts of one sketch."""
    w = Window.partitionBy(*cell, "rule")
    run = sketch.withColumn("up_to", F.sum("n").over(w.orderBy("value"))).withColumn("rows", F.sum("n").over(w))
    at = lambda p: F.min(F.when(100 * F.col("up_to") >= p * F.col("rows"), F.col("value")))
    return run.groupBy(*cell, "rule").agg(F.first("rows").alias("rows"), at(25).alias("low"), at(75).alias("high"))


def fences(sketch: DataFrame, rules: Rules) -> DataFrame:
    """(l, s, least_<rate>, most_<rate>): one row for each cell, with the rates it accepts."""
    own = quartiles(sketch, "l", "s")
    lang = quartiles(merged(sketch, "l"), "l").select("l", "rule", *[F.col(c).alias(f"l_{c}") for c in ("rows", "low", "high")])
    every = quartiles(merged(sketch)).select("rule", *[F.col(c).alias(f"a_{c}") for c in ("low", "high")])
    all_ = own.join(lang, ["l", "rule"]).join(every, "rule")
    use = lambda c: F.when(F.col("rows") >= rules.least_rows, F.col(c)).when(F.col("l_rows") >= rules.least_rows, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    slack = F.create_map(*[F.lit(x) for kv in rules.slack.items() for x in kv])[F.col("rule")]
    far = rules.reach * (F.col("b") - F.col("a")) + slack
    rows = all_.select("l", "s", "rule", use("low").alias("a"), use("high").alias("b")).select("l", "s", "rule", (F.col("a") - far).alias("least"), (F.col("b") + far).alias("most"))
    one = lambda k, c: F.max(F.when(F.col("rule") == k, F.col(c))).alias(f"{c}_{k}")
    return rows.groupBy("l", "s").agg(*[one(k, c) for k in rules.slack for c in ("least", "most")])


def judge(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each row.

    Null and empty texts have no words and fail. Null languages and sources are cells of their own. Repeated rows count
    as often as they are given. A table without rows gives none. Other columns are ignored. Texts are read once; the
    join with the fences moves short rows, salted, so a source of a third of all rows is dealt out.
    """
    rules = rules or Rules()
    rows = rated(features(docs, rules), rules)
    limits = materialize(fences(sketches(rows, rules), rules), "fences").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    inside = lambda k: (F.col(f"r_{k}") <= F.col(f"most_{k}")) & ((F.col(f"r_{k}") >= F.col(f"least_{k}")) if k in rules.two_sided else F.lit(True))
    kept = reduce(lambda a, b: a & b, [inside(k) for k in rules.slack], ~F.col("base_failed"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    return salted.join(limits, ["l", "s", "salt"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"))


_RULES = Rules()
_RATES = {"length": "100 * word_chars // n_words", "symbols": "1000 * n_symbols // n_words", "doubled": "1000 * n_doubled // n_words",
          "repeats": "1000 * n_repeat_words // n_words", "lines": "1000 * n_dup_lines // n_lines", "capitals": "1000 * n_capitals // word_chars"}


def _sql() -> str:
    k = _RULES
    values = ", ".join(f"('{r}', {s}, {str(r in k.two_sided).lower()})" for r, s in k.slack.items())
    rates = " UNION ALL ".join(f"SELECT doc_id, row, l, s, '{r}' AS rule, {x} AS value FROM b WHERE NOT base_failed" for r, x in _RATES.items())
    return rf"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce('1' || lang, '0') AS l, coalesce('1' || source, '0') AS s, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT row, unnest(range(len(words) - {k.window - 1})) AS i,
             unnest(list_transform(range(len(words) - {k.window - 1}), lambda i: array_to_string(words[i + 1 : i + {k.window}], ' '))) AS gram FROM w WHERE len(words) >= {k.window}),
twice AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, gram) > 1),
covered AS (SELECT row, count(DISTINCT i + o) AS n FROM twice, range({k.window}) offsets(o) GROUP BY row),
f AS (SELECT w.row, doc_id, l, s, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
             coalesce(list_sum(list_transform(range(1, len(words)), lambda i: (words[i] = words[i + 1])::INT)), 0)::BIGINT AS n_doubled
      FROM w LEFT JOIN covered USING (row)),
b AS (SELECT *, n_words < {k.min_words} OR 100 * n_repeat_words > {k.max_repeat_percent} * n_words AS base_failed FROM f),
r AS ({rates}),
k AS (SELECT l, s, rule, value // pow(10, greatest(0, length(value::VARCHAR) - 3))::BIGINT * pow(10, greatest(0, length(value::VARCHAR) - 3))::BIGINT AS value FROM r),
q AS (SELECT l, s, rule, count(*) AS rows, quantile_disc(value, 0.25) AS low, quantile_disc(value, 0.75) AS high FROM k GROUP BY GROUPING SETS ((l, s, rule), (l, rule), (rule))),
c AS (SELECT own.l, own.s, own.rule,
             CASE WHEN own.rows >= {k.least_rows} THEN own.low WHEN lang.rows >= {k.least_rows} THEN lang.low ELSE every.low END AS low,
             CASE WHEN own.rows >= {k.least_rows} THEN own.high WHEN lang.rows >= {k.least_rows} THEN lang.high ELSE every.high END AS high
      FROM q own JOIN q lang ON lang.l = own.l AND lang.s IS NULL AND lang.rule = own.rule JOIN q every ON every.l IS NULL AND every.rule = own.rule WHERE own.s IS NOT NULL),
o AS (SELECT DISTINCT row FROM r JOIN c USING (l, s, rule) JOIN (VALUES {values}) v(rule, slack, two_sided) USING (rule)
      WHERE value > high + {k.reach} * (high - low) + slack OR (two_sided AND value < low - {k.reach} * (high - low) - slack))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o.row IS NULL AS kept
FROM b LEFT JOIN o ON o.row = b.row
"""


SQL = _sql()
