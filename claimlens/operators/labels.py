"""Rule labels and text blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from .lineage import materialize
from .ranks import chunked_rank


def label_posts(texts: DataFrame, key: str, lexicon=()) -> DataFrame:
    t = F.col("text")
    return texts.select(
        key, T.stance(t).alias("stance"), T.sentiment(t).alias("sentiment"), T.outrage(t).alias("outrage_score"), T.topic(t).alias("topic_label"),
        *([T.lexicon_density(t, lexicon).alias("outrage_density")] if lexicon else []))


def sentiment_share(posts: DataFrame, period: str = "day") -> DataFrame:
    """Share of each sentiment per period; posts without one stay in the denominator."""
    share = lambda s: F.round(F.count(F.when(F.col("sentiment") == s, 1)) / F.count(F.lit(1)), 4).alias(s + "_share")
    return posts.groupBy(F.date_trunc(period, "created_at").alias("period")).agg(
        F.count(F.lit(1)).alias("posts"), share("negative"), share("positive"), share("neutral"))


def term_weights(texts: DataFrame, key: str, dim: int = 384) -> DataFrame:
    """(key, pos, x): hashed TF-IDF of each text, scaled to length 1; places without a term are left out.

    A term goes to the place named by the first 32 bits of its MD5; the weight is tf * ln((N + 1) / (df + 1)). Counts are
    written once, since they are read for df, weights and lengths: words are split and hashed in one pass.
    """
    words = texts.select(key, F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("w")).filter("w <> ''")
    place = F.pmod(F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    tf = materialize(words.groupBy(key, place.alias("pos")).agg(F.count(F.lit(1)).alias("tf")), "term-counts")
    df = tf.groupBy("pos").agg(F.count(F.lit(1)).alias("df"))  # at most `dim` rows
    n = texts.agg(F.count(F.lit(1)).alias("n"))  # one row
    weight = F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1))
    rows = tf.join(F.broadcast(df), "pos").crossJoin(F.broadcast(n)).select(key, "pos", weight.alias("x"))
    norm = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return rows.join(norm, key).select(key, "pos", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0).alias("x"))


def text_vectors(texts: DataFrame, key: str, dim: int = 384) -> DataFrame:
    """(key, embedding): the same weights as whole vectors, one for each text; a text without words is the zero vector."""
    found = term_weights(texts, key, dim).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "x"))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return texts.select(key).join(found, key, "left").select(key, at.alias("embedding"))


def cluster_statements(posts: DataFrame, cluster: str) -> DataFrame:
    """Earliest text of each cluster and the default label."""
    return posts.groupBy(cluster).agg(F.min_by("text", F.struct("created_at", "post_id")).alias("statement")).withColumn("topic_label", F.lit(T.DEFAULT_TOPIC))


def cluster_texts(posts: DataFrame, cluster: str) -> DataFrame:
    """(cluster, position, post_id, text): all texts of a cluster from the earliest on; a caller who wants a sample filters on position."""
    ranked = chunked_rank(posts.select(cluster, "created_at", "post_id", "text"), [cluster], ["created_at", "post_id"], F.to_date("created_at"))
    return ranked.select(cluster, F.col("rn").alias("position"), "post_id", "text")


def cap_segments(segments: DataFrame, maximum: int | None = None) -> DataFrame:
    """Per claim: repeated names dropped (first kept), ranked from 0; with `maximum`, only so many are kept."""
    firsts = segments.groupBy("claim_id", "segment_name").agg(F.min("position").alias("position"))
    w = Window.partitionBy("claim_id").orderBy("position", "segment_name")
    ranked = firsts.withColumn("rank", F.row_number().over(w) - 1)
    return ranked if maximum is None else ranked.filter(F.col("rank") < maximum)


def grounding_block(rows: DataFrame, key: str, order: str, note: str | None = None) -> DataFrame:
    """One text block per key from its few retrieved fault lines, in retrieval order."""
    line = F.concat(
        F.lit("- ["), "community_name", F.lit("] "), "grievance_theme",
        F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise(""))
    lines = rows.select(key, F.col(order).alias("o"), line.alias("line"))
    block = lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("block"))
    if note:
        block = block.withColumn("block", F.concat("block", F.lit("\n- [Additional context] " + note)))
    return block


def grounding_summary(fault_lines: DataFrame, topics: DataFrame) -> DataFrame:
    """(part, id, line): a line for every fault line (part 1) and topic (part 2)."""
    l = fault_lines.select(F.lit(1).alias("part"), F.col("fault_line_id").cast("bigint").alias("id"), F.concat(F.lit("- "), "community_name", F.lit(": "), "grievance_theme").alias("line"))
    return l.unionByName(topics.select(F.lit(2).alias("part"), F.col("topic_id").cast("bigint").alias("id"), F.col("name").alias("line")))


def summary_block(rows: DataFrame, max_lines: int, max_topics: int) -> DataFrame:
    """The overview as one text, of the first lines by id that the caller asks for."""
    few = rows.filter("part = 1").orderBy("id").limit(max_lines).unionByName(rows.filter("part = 2").orderBy("id").limit(max_topics))

    def joined(part, sep):
        mine = F.filter(F.sort_array(F.collect_list(F.struct("part", "id", "line"))), lambda x: x["part"] == part)
        return F.array_join(F.transform(mine, lambda x: x["line"]), sep)

    # The headings of the two parts.
    return few.agg(joined(1, "\n").alias("l"), joined(2, ", ").alias("t")).select(
        F.concat_ws("\n\n", F.when(F.col("l") != "", F.concat(F.lit("Known community fault lines:\n"), "l")),
                    F.when(F.col("t") != "", F.concat(F.lit("Active topics: "), "t"))).alias("block"))
