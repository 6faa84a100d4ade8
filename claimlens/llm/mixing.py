"""Mixing sources to target weights by iterative proportional fitting (operator 2)."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

from ..operators.lineage import materialize

#: Topics by the first phrase a text holds, in this order; the rest is `prose`. A parameter of the operator.
TOPICS = (("licence", ("Licensed under", "licensed under", "the MIT License")), ("contact", ("@", "+1 (")), ("secret", ("password", "token =")), ("web", ("http://", "https://", "www.")))
MARGINALS = ("source", "lang", "topic")


@dataclass
class Mix:
    """Target share of a value in a marginal is proportional to its tokens to this power: 1 leaves it, 0 levels all."""

    source: float = 0.5
    lang: float = 0.7
    topic: float = 0.6
    share: float = 0.5  # expected tokens of the sample over all tokens
    rounds: int = 20  # of the SQL form, which can't go on until the masses settle
    scaling: int = 12  # likewise: rounds that bring the expected tokens to `share` where probabilities reach 1


#: Masses have settled once a round moves none by more than this part of its smallest target.
SETTLED = 1e-10
#: Safety bound of rounds of either loop; reaching it raises.
MOST = 1000


def topic_of(text, topics=TOPICS):
    out = F.lit("prose")
    for name, phrases in reversed(topics):
        found = F.lit(False)
        for p in phrases:
            found = found | F.contains(text, F.lit(p))
        out = F.when(found, F.lit(name)).otherwise(out)
    return out


def tokens_of(text):
    """Words between ASCII blanks, one at least."""
    t = F.translate(text, "\t\n\x0b\f\r", "     ")
    # words are the places where a blank or the beginning is followed by something else
    return F.greatest(F.size(F.array_remove(F.split(t, " "), "")), F.lit(1)).cast("bigint")


def described(docs: DataFrame, topics=TOPICS, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), named("source"), named("lang"), topic_of(text, topics).alias("topic"), tokens_of(text).alias("tokens"), *more)


def rake(rows: DataFrame, mix: Mix) -> DataFrame:
    """(source, lang, topic, tokens, mass, probability) of the cells that hold documents.

    mass starts as the cell's tokens; each step scales it so that one marginal meets its targets, in turn, until a round
    changes no mass any more. Then every marginal meets its targets, unless no masses on these cells can (a source of
    one language whose targets differ, say): the masses settle on a cycle of steps, the last of which meets topic, and
    the largest relative miss is given as a warning. Cells are few next to documents; every round is partial sums over
    them and is written to the shared folder.
    """
    cur = materialize(rows.groupBy(*MARGINALS).agg(F.sum("tokens").cast("double").alias("tokens")), "cells")
    total = cur.agg(F.sum("tokens")).first()[0] or 0.0
    for m in MARGINALS:
        t = cur.groupBy(m).agg(F.pow(F.sum("tokens"), F.lit(float(getattr(mix, m)))).alias("p"))
        all_p = t.agg(F.sum("p")).first()[0] or 1.0
        cur = cur.join(t.select(m, (F.col("p") / F.lit(all_p) * F.lit(total)).alias(f"to_{m}")), m)
    cur = materialize(cur.withColumn("mass", F.col("tokens")), "targets")
    names = cur.columns
    least_to = F.least(*[F.col(f"to_{m}") for m in MARGINALS])
    for _ in range(MOST):
        cur = cur.withColumns({"was": F.col("mass"), "miss": F.lit(0.0)})
        for m in MARGINALS:
            now = cur.groupBy(m).agg(F.sum("mass").alias("now"))
            by = F.col(f"to_{m}") / F.col("now")
            cur = cur.join(now, m).withColumns({"mass": F.col("mass") * by, "miss": F.greatest("miss", F.abs(1 / by - 1))}).select(*names, "was", "miss")
        seen = Observation()
        moved = F.max(F.abs(F.col("mass") - F.col("was")) / least_to).alias("moved")
        cur = materialize(cur.observe(seen, moved, F.max("miss").alias("miss")), "raked").select(*names)
        if (seen.get["moved"] or 0.0) <= SETTLED:
            break
    else:
        raise RuntimeError(f"masses haven't settled after {MOST} rounds")
    if (seen.get["miss"] or 0.0) > 1e-6:
        warnings.warn(f"no masses meet all targets: the largest relative miss is {seen.get['miss']:.3g}", stacklevel=2)
    scale = mix.share
    wanted = mix.share * total
    for _ in range(MOST):
        full = F.col("mass") * F.lit(scale) >= F.col("tokens")
        row = cur.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("mass"))).alias("rest")).first()
        if not row["rest"]:
            break
        new = (wanted - row["full"]) / row["rest"]
        if abs(new - scale) <= 1e-12 * scale:
            break
        scale = new
    else:
        raise RuntimeError(f"the expected tokens haven't settled after {MOST} rounds")
    return cur.withColumn("probability", F.least(F.col("mass") * F.lit(scale) / F.col("tokens"), F.lit(1.0)))


def ticket(doc_id):
    """A number in [0, 1) from the id alone, so a document keeps its ticket in any run and partitioning."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def weigh(docs: DataFrame, mix: Mix | None = None, *more: str) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, mass, probability, kept, *more), a row for each row of docs.

    mass is the raked token weight of the document, so masses add up to the targets; a document is kept if its ticket
    is under its probability. Null source or lang is the value ''; a null or empty text is one token; null ids share
    the ticket of ''; repeated rows have one fate. `more` names columns to carry along; others
    are ignored.
    """
    mix = mix or Mix()
    rows = described(docs, TOPICS, *more)
    cells = rake(described(docs), mix).select(*MARGINALS, F.col("tokens").alias("cell_tokens"), "mass", "probability")
    # cells may be many where sources are; the hot ones are split by the join, which knows their sizes
    out = rows.join(cells, list(MARGINALS))
    return out.select(
        "doc_id", "source", "lang", "topic", "tokens", F.round(F.col("mass") / F.col("cell_tokens") * F.col("tokens"), 3).alias("mass"),
        F.round("probability", 6).alias("probability"), (ticket(F.col("doc_id")) < F.round("probability", 12)).alias("kept"), *more,
    )


def _sql(mix: Mix) -> str:
    case = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{p}')" for p in ps) + f" THEN '{n}'" for n, ps in TOPICS) + " ELSE 'prose' END"
    out = [f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, source, lang, {case} AS topic, greatest(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')), 1)::BIGINT AS tokens FROM d),
c0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, sum(tokens)::DOUBLE AS mass FROM r GROUP BY ALL),
total AS (SELECT sum(tokens) AS total FROM c0)"""]
    for m in MARGINALS:
        out.append(f"p_{m} AS (SELECT {m}, pow(sum(tokens), {getattr(mix, m)}) AS p FROM c0 GROUP BY ALL), t_{m} AS MATERIALIZED (SELECT {m}, p / (SELECT sum(p) FROM p_{m}) * total AS target FROM p_{m}, total)")
    n = 0
    for _ in range(mix.rounds):
        for m in MARGINALS:
            out.append(f"c{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, mass * target / sum(mass) OVER (PARTITION BY {m}) AS mass FROM c{n} JOIN t_{m} USING ({m}))")
            n += 1
    out.append(f"s0 AS (SELECT {mix.share}::DOUBLE AS s)")
    for i in range(mix.scaling):
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT coalesce(({mix.share} * sum(tokens) - sum(CASE WHEN mass * s >= tokens THEN tokens ELSE 0 END)) / nullif(sum(CASE WHEN mass * s >= tokens THEN 0 ELSE mass END), 0), any_value(s)) AS s FROM c{n}, s{i})")
    return ",\n".join(out) + f"""
SELECT doc_id, source, lang, topic, r.tokens, round(mass / c.tokens * r.tokens, 3) AS mass, round(least(mass * s / c.tokens, 1.0), 6) AS probability,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < round(least(mass * s / c.tokens, 1.0), 12) AS kept
FROM r JOIN c{n} c USING (source, lang, topic), s{mix.scaling}
"""


SQL = _sql(Mix())
