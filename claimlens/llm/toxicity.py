"""Toxicity by class-conditional Kneser-Ney models (operator 6).

Each class has a model of words and bigrams over continuation counts that interpolates with the model both classes share,
so an expression too rare to tell weighs about the same in both. Every word and bigram is scored. How much a ratio of a
given size is worth for a whole text is fitted on labelled rows the counts have not seen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, ByteType, LongType, StringType, StructField, StructType

from ..operators.lineage import materialize
from .texts import dealt, numbers, partitions, slices, texts_of

CUTOFF = 0.3
DISCOUNTS = (0.5, 0.75, 0.9)  # of counts 1, 2 and over, where too few counts are there to estimate them
#: log-likelihood ratios are told apart in steps of one nat; a text is described by its words' shares of the steps
STEPS = (-4.0, -3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
BINS = len(STEPS) + 1
EVEN = STEPS.index(0.0) + 1
FOLDS = 4  # by crc32 of the id: 0 and 1 give counts, 3 calibrates, 2 is never learned from
BLOOM_BITS = 1 << 23
SENT = 4_000_000  # entries (9 bytes each) that tasks get whole, the commonest; the others are joined, with the same result
RIDGE = 1.0
#: ASCII letters lower-cased, other ASCII but digits to blanks; bytes of longer characters stay
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def fold(column: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _grams(texts: list[bytes]):
    """(words of each text, document, word hash, bigram key, hash of the word before that) of every word.

    Hashes have 32 bits; a bigram key is the word's hash and then that of the word before it, 0 at the start of a text.
    """
    parts = [t.translate(PLAIN).split() for t in texts]
    count = np.fromiter(map(len, parts), np.int64, len(parts))
    h32 = xxhash.xxh32_intdigest
    w = np.fromiter((h32(x) for p in parts for x in p), np.uint64, int(count.sum()))
    doc = np.repeat(np.arange(len(parts)), count)
    before = np.roll(w, 1)
    if len(w):
        before[np.concatenate(([True], doc[1:] != doc[:-1]))] = 0
    left = np.where(before == 0, np.uint64(0), np.roll(before, 1))
    return count, doc, w, (w << np.uint64(32)) | before, left


def _labelled_bits(labels: DataFrame) -> np.ndarray:
    """A Bloom filter of the labelled ids, of fixed size. It only spares the shuffle of texts without a label."""
    bit = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(BLOOM_BITS)) for i in range(2)]
    rows = labels.filter("doc_id IS NOT NULL").select(F.explode(F.array(*bit)).alias("bit"))
    words = rows.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[np.asarray(words.column(0))] = np.asarray(words.column(1))
    return out


def labelled(docs: DataFrame, labels: DataFrame, folds: tuple[int, ...]) -> DataFrame:
    """(text, toxic) of the labelled documents of some folds; ids labelled twice take the larger label."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    bits = _labelled_bits(marks)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(fold().isin(*folds))
    rows = dealt(rows.withColumns({f"b{i}": F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(BLOOM_BITS)) for i in range(2)}))

    def run(batches):
        for part in slices(batches, limit=16 << 20):
            ok = np.ones(part.num_rows, bool)
            for c in ("b0", "b1"):
                b = numbers(part, c)
                ok &= (bits[b // 64] >> (b % 64)) & 1 == 1
            if ok.any():
                yield part.select(["doc_id", "text"]).filter(pa.array(ok))

    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # labels grow with the documents, so they are never sent to every task: one plan at every size
    return rows.mapInArrow(run, "doc_id bigint, text string").join(marks.hint("merge"), "doc_id").select("text", "toxic")


def _word(key: str):
    return F.shiftrightunsigned(key, 32)


def _before(key: str):
    return F.col(key).bitwiseAND(F.lit(0xFFFFFFFF))


def class_counts(rows: DataFrame) -> DataFrame:
    """(kind, key, ct, co, nt, no, ns): counts over all labelled texts, toxic and ordinary.

    kind 2: a bigram; c is how often it occurs, n how many different words stand before it (the start of a text is one).
    kind 1: a word; c is how often it occurs and n how many different words it follows (its continuation count).
    ns counts these for both classes together.
    """

    def run(batches):
        for part in slices(batches):
            toxic = numbers(part, "toxic") > 0
            _, doc, w, key, left = _grams(texts_of(part))
            if not len(w):
                continue
            order = np.lexsort((left, key))
            key, left = key[order], left[order]
            s = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (left[1:] != left[:-1]))))
            n = np.diff(np.concatenate((s, [len(key)])))
            t = np.add.reduceat(toxic[doc[order]].astype(np.int64), s)
            yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), pa.array(left[s].view(np.int64)), pa.array(t), pa.array(n - t)], names=["key", "left", "t", "o"])

    # dealt out by the second word, so its rows meet in few tasks. The commonest word has some 3 % of all rows: it and
    # the others are split further, by the first word, as soon as a task's share is less than that
    n = partitions(rows.sparkSession)
    raw = rows.mapInArrow(run, "key bigint, left bigint, t bigint, o bigint")
    cell = F.pmod(F.xxhash64(_word("key"), F.pmod(F.xxhash64(_before("key")), F.lit(max(1, n // 32)))), F.lit(4 * n)).cast("int")
    # both sums stay in the cell's task: no second shuffle
    triples = raw.withColumn("cell", cell).repartition(n, "cell").groupBy("cell", "key", "left").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    sums = [F.sum("t").alias("ct"), F.sum("o").alias("co"), F.count_if(F.col("t") > 0).alias("nt"), F.count_if(F.col("o") > 0).alias("no"), F.count(F.lit(1)).alias("ns")]
    pairs = materialize(triples.groupBy("cell", "key").agg(*sums).drop("cell"), "bigrams")
    one = lambda c: F.sum(F.col(c))
    words = pairs.groupBy(_word("key").alias("key")).agg(one("ct").alias("ct"), one("co").alias("co"), F.count_if(F.col("ct") > 0).alias("nt"), F.count_if(F.col("co") > 0).alias("no"), F.count(F.lit(1)).alias("ns"))
    return pairs.select(F.lit(2).alias("kind"), "*").unionByName(words.select(F.lit(1).alias("kind"), "*"))


@dataclass
class Model:
    """Steps of the log-likelihood ratios of words and bigrams, sorted by key, and the calibration of a text's score.

    The commonest entries are arrays that tasks get. `table` (kind, key, one, two) holds all entries where there are more,
    and `filter` is a Bloom filter of those that are not in the arrays; it only spares the join of words no model knows.
    """

    words: np.ndarray
    word_step: np.ndarray
    pairs: np.ndarray
    pair_step: np.ndarray
    unknown: int = EVEN  # step of a word without counts
    weights: list[float] = field(default_factory=lambda: [-2.0] + [0.0] * (2 * BINS))
    prior: float = 0.1  # score of a text without words
    table: DataFrame | None = None
    filter: np.ndarray | None = None


def discounts(once: int, twice: int, three: int, four: int) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2, and 3 or more, from how many entries have the counts 1 to 4."""
    n = (once, twice, three, four)
    if min(n) == 0:
        return DISCOUNTS
    y = once / (once + 2 * twice)
    return tuple(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), float(i)) for i in (1, 2, 3))


def ratio_table(counts: DataFrame) -> tuple[DataFrame, float] | None:
    """((kind, key, n, one, two) of every word and bigram, ratio of a word without counts); None without both classes.

    one, two: log P(toxic) - log P(ordinary) of the word, and of the word after the one before it. With n the
    continuation counts of a class or of both (shared), D their discounts and g the mass these set free,
        shared(w) = (n(w) - D) / n + g / words          P_c(w) = (n_c(w) - D) / n_c + g_c shared(w)
        shared(w | h) = (n(h w) - D) / n(h) + g(h) shared(w)
        P_c(w | h) = (n_c(h w) - D) / n_c(h) + g_c(h) shared(w | h) P_c(w) / shared(w).
    A bigram neither class has gets the ratio of its word. n is how often an entry occurs.
    """
    sides = ("nt", "no", "ns")
    sums = [F.sum(s).alias(s) for s in sides] + [F.count_if(F.col(s) == i).alias(f"{s}{i}") for s in sides for i in (1, 2, 3, 4)] + [F.count_if(F.col(s) > 0).alias(f"{s}v") for s in sides]
    total = {r["kind"]: r for r in counts.groupBy("kind").agg(*sums).collect()}
    if 1 not in total or not total[1]["nt"] or not total[1]["no"]:
        return None
    off = {(k, s): discounts(*(r[f"{s}{i}"] for i in (1, 2, 3, 4))) for k, r in total.items() for s in sides}

    def left(kind, s, c=None):
        """What the discount leaves of a count."""
        c, d = F.col(c or s), off[kind, s]
        return F.greatest(c - F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2]), F.lit(0.0))

    one = total[1]
    freed = {s: (off[1, s][0] * one[f"{s}1"] + off[1, s][1] * one[f"{s}2"] + off[1, s][2] * (one[f"{s}v"] - one[f"{s}1"] - one[f"{s}2"])) / one[s] for s in sides}
    def orders(c):
        """Shared and class probabilities of a word from its counts in columns c."""
        low = left(1, "ns", c["ns"]) / one["ns"] + freed["ns"] / (one["nsv"] + 1.0)
        return low, {s: left(1, s, c[s]) / one[s] + freed[s] * low for s in ("nt", "no")}

    _, p = orders({s: s for s in sides})
    words = counts.filter("kind = 1").select("key", (F.col("ct") + F.col("co")).alias("n"), (F.log(p["nt"]) - F.log(p["no"])).alias("one"))
    unknown = math.log(freed["nt"] / freed["no"])

    # bigrams meet counts, not probabilities, and neither word is a column of its own: small numbers pack well in a shuffle
    pairs = counts.filter("kind = 2").select("key", (F.col("ct") + F.col("co")).alias("c"), *sides)
    heads = pairs.groupBy(_before("key").alias("h")).agg(*[F.sum(s).alias(f"h{s}") for s in sides], *[F.count_if(F.col(s) == i).alias(f"h{s}{i}") for s in sides for i in (1, 2)], *[F.count_if(F.col(s) > 2).alias(f"h{s}3") for s in sides])
    seconds = counts.filter("kind = 1").select(F.col("key").alias("w"), *[F.col(s).alias(f"w{s}") for s in sides])
    b = pairs.join(seconds, _word("key") == F.col("w")).drop("w").join(heads, _before("key") == F.col("h")).drop("h")
    low, p = orders({s: f"w{s}" for s in sides})
    b = b.withColumns({"s1": low, "pnt": p["nt"], "pno": p["no"], **{f"g{s}": sum(off[2, s][i - 1] * F.col(f"h{s}{i}") for i in (1, 2, 3)) for s in sides}})
    b = b.withColumn("s2", (left(2, "ns") + F.col("gns") * F.col("s1")) / F.col("hns"))
    low = lambda s: F.col("s2") * F.col(f"p{s}") / F.col("s1")
    side = lambda s: F.when(F.col(f"h{s}") > 0, (left(2, s) + F.col(f"g{s}") * low(s)) / F.col(f"h{s}")).otherwise(low(s))
    two = b.select(F.lit(2).alias("kind"), "key", F.col("c").alias("n"), (F.log("pnt") - F.log("pno")).alias("one"), (F.log(side("nt")) - F.log(side("no"))).alias("two"))
    return words.select(F.lit(1).alias("kind"), "key", "n", "one", F.lit(None).cast("double").alias("two")).unionByName(two), unknown


def _step(ratio):
    return sum((ratio >= s).cast("int") for s in STEPS).cast("byte")


def fit_ratios(counts: DataFrame, sent: int = SENT) -> Model:
    """All entries of the models as steps. Up to `sent` of the commonest are arrays; with more, all stay a table as well."""
    none = np.zeros(0, np.uint64)
    fitted = ratio_table(counts)
    if fitted is None:
        return Model(none, none.astype(np.int8), none, none.astype(np.int8))
    entries, unknown = fitted
    entries = materialize(entries.select("kind", "key", F.floor(4 * F.log2("n")).cast("int").alias("often"), _step(F.col("one")).alias("one"), _step(F.col("two")).alias("two")).filter("kind = 1 OR one != two"), "entries")
    # a bigram whose step is its word's is left out: one that isn't found takes its word's step anyway
    # how many entries are this common: some 200 rows; a bigram is never commoner than its word
    sizes = sorted(entries.groupBy("often").count().collect(), reverse=True)
    cut, room, rest = None, sent, False
    for often, n in sizes:
        if n > room:
            rest = True
            break
        cut, room = often, room - n
    hot = entries.filter(F.col("often") >= (cut if cut is not None else 1 << 30))
    model = Model(*_sides(hot.filter("kind = 1").select("key", F.col("one").alias("step"))), *_sides(hot.filter("kind = 2").select("key", F.col("two").alias("step"))))
    model.unknown = int(np.digitize(unknown, STEPS))
    if rest:
        model.table = entries.drop("often")
        cold = entries.filter(F.col("often") < (cut if cut is not None else 1 << 30))
        model.filter = _filter(cold, sum(n for o, n in sizes if cut is None or o < cut))
    return model


def _sides(entries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = entries.toArrow()
    key = t.column("key").to_numpy().view(np.uint64)
    by = np.argsort(key)
    return key[by], t.column("step").to_numpy()[by]


def _filter_bits(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in a filter of 2**bits bits."""
    shift = np.uint64(64 - bits)
    return tuple((((key ^ (key >> np.uint64(29))) * np.uint64(odd)) >> shift).astype(np.int64) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def _filter(entries: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the entries' keys, eight bits an entry and 32 MB at most; a fuller one lets more words be joined."""
    bits = min(28, max(16, (8 * n - 1).bit_length()))

    def run(batches):
        for batch in batches:
            at = np.concatenate(_filter_bits(batch.column(0).to_numpy().view(np.uint64), bits))
            word, row = np.unique(at // 64, return_inverse=True)
            if len(word):
                value = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(value, row, np.uint64(1) << (at % 64).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "bits"])

    words = entries.select("key").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _maybe(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    ok = np.ones(len(key), bool)
    for at in _filter_bits(key, (64 * len(table)).bit_length() - 1):
        ok &= (table[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
    return ok


def _find(table: np.ndarray, value: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x, value[at].astype(np.int64)


def steps_of(texts: list[bytes], model: Model):
    """(words in each step at both orders, words of each text, asked): asked words are left to the join.

    asked is (text, bigram key, step of the word or -1, times); the step is -1 where the word itself has to be asked for.
    """
    count, doc, w, key, _ = _grams(texts)
    has, one = _find(model.words, model.word_step, w)
    one = np.where(has, one, model.unknown)
    also, two = _find(model.pairs, model.pair_step, key)
    two = np.where(also, two, one)
    ask = np.zeros(len(w), bool)
    if model.filter is not None:
        # a bigram is in the model only if its word is, so a word that is in neither part settles its bigram
        word_cold = ~has & _maybe(model.filter, w)
        ask = word_cold | (has & ~also & _maybe(model.filter, key))
    stay = ~ask
    at = doc[stay] * (2 * BINS)
    n = 2 * BINS * len(count)
    shape = np.bincount(at + one[stay], minlength=n) + np.bincount(at + BINS + two[stay], minlength=n)
    d, k, s = doc[ask], key[ask], np.where(has[ask], one[ask], -1)
    order = np.lexsort((k, d))
    d, k, s = d[order], k[order], s[order]
    cut = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))) if len(k) else np.zeros(0, np.int64)
    return shape.reshape(-1, 2 * BINS).astype(np.int64), count, (d[cut], k[cut], s[cut], np.diff(np.concatenate((cut, [len(k)]))))


def _lists(values: pa.Array, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), values)


def with_steps(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (None: all) of docs with __steps (words in each step of order 1, then of order 2) and __words."""
    keep = docs.columns if keep is None else keep
    joined = model.table is not None
    if joined:
        docs, keep = docs.withColumn("__row", F.monotonically_increasing_id()), [*keep, "__row"]
    fields = [docs.schema[c] for c in keep]
    asked = StructType([StructField("key", LongType()), StructField("one", ByteType()), StructField("n", LongType())])
    schema = StructType([*fields, StructField("__steps", ArrayType(LongType())), StructField("__words", LongType())])
    if joined:
        schema = schema.add("__asked", ArrayType(asked))
    own = text in keep and docs.schema[text].dataType == StringType()  # no second copy of a text that is kept
    source = text if own else "__text"
    docs = docs.select(*keep) if own else docs.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches):
        for part in slices(batches, source):
            shape, count, (d, key, one, n) = steps_of([t or b"" for t in texts_of(part, source)], model)
            out = [*part.columns[:len(keep)], _lists(pa.array(shape.ravel()), np.full(len(count), 2 * BINS)), pa.array(count.astype(np.int64))]
            if joined:
                flat = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(one.astype(np.int8)), pa.array(n.astype(np.int64))], names=["key", "one", "n"])
                out.append(_lists(flat, np.bincount(d, minlength=len(count))))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    if not joined:
        return dealt(docs).mapInArrow(run, schema)
    # executors get the arrays only: the table stays a plan of the driver
    table, model = model.table, Model(model.words, model.word_step, model.pairs, model.pair_step, model.unknown, filter=model.filter)
    rows = materialize(dealt(docs).mapInArrow(run, schema), "steps")
    asked = rows.select("__row", F.explode("__asked").alias("a")).select("__row", "a.key", F.col("a.one").alias("mine"), "a.n")
    words = table.filter("kind = 1").select(F.col("key").alias("w"), F.col("one").alias("alone"))
    pairs = table.filter("kind = 2").select("key", "one", "two")
    unknown = F.lit(model.unknown)
    known = asked.filter("mine >= 0").join(pairs.select("key", "two"), "key", "left").select("__row", "n", F.col("mine").alias("one"), F.coalesce("two", "mine").alias("two"))
    rare = asked.filter("mine < 0").join(pairs, "key", "left").withColumn("w", _word("key")).join(words, "w", "left")
    rare = rare.select("__row", "n", F.coalesce("one", "alone", unknown).alias("one"), F.coalesce("two", "alone", unknown).alias("two"))
    add = [F.coalesce(F.sum(F.when(F.col(c) == i, F.col("n"))), F.lit(0)) for c in ("one", "two") for i in range(BINS)]
    more = known.unionByName(rare).groupBy("__row").agg(F.array(*add).alias("__more"))
    steps = F.coalesce(F.zip_with("__steps", "__more", lambda a, b: a + b), F.col("__steps"))
    return rows.drop("__asked").join(more, "__row", "left").withColumn("__steps", steps).drop("__more", "__row")


def calibrate(rows: DataFrame) -> tuple[list[float], float]:
    """(weights, toxic share): logistic weights of a text's steps from (__steps, __words, toxic) of all calibration rows.

    Newton steps, each one sum over all rows in Spark. Inputs are roots of the words' shares, so length does not count.
    """
    rows = materialize(rows.filter("__words > 0").select("__steps", "__words", (F.col("toxic") > 0).cast("int").alias("y")), "calibration")
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    default = Model.__dataclass_fields__
    if not n:
        return default["weights"].default_factory(), default["prior"].default
    size = 2 * BINS + 1

    def sums(f):
        def run(batches):
            total = np.zeros(0)
            for b in batches:
                if b.num_rows:
                    x = np.asarray(b.column(0).flatten()).reshape(-1, 2 * BINS) / np.asarray(b.column(1))[:, None]
                    part = f(np.sqrt(x), np.asarray(b.column(2)).astype(float))
                    total = total + part if len(total) else part
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

        got = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(got)])

    first, second = sums(lambda x, y: np.concatenate((x.sum(0), (x * x).sum(0)))).reshape(2, -1) / n
    scale = np.sqrt(np.maximum(second - first**2, 0)) + 1e-6

    def newton(w):
        def f(x, y):
            z = np.concatenate((np.ones((len(x), 1)), (x - first) / scale), axis=1)
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            return np.concatenate((z.T @ (p - y), (z.T @ (z * (p * (1 - p))[:, None])).ravel()))

        return f

    ridge = np.diag([1e-3] + [RIDGE] * (size - 1))
    w = np.zeros(size)
    for _ in range(30):
        got = sums(newton(w))
        step = np.linalg.solve(got[size:].reshape(size, size) + ridge, got[:size] + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    plain = w[1:] / scale
    return [float(w[0] - plain @ first), *(float(v) for v in plain)], bad / n


def train(docs: DataFrame, labels: DataFrame, sent: int = SENT) -> Model:
    """Counts from folds 0 and 1, calibration from fold 3; every labelled row of these folds counts."""
    model = fit_ratios(class_counts(labelled(docs, labels, (0, 1))), sent)
    model.weights, model.prior = calibrate(with_steps(labelled(docs, labels, (3,)), model, keep=["toxic"]))
    return model


def score_column(model: Model):
    w = model.weights
    logit = sum((F.sqrt(F.col("__steps")[i] / F.col("__words")) * w[i + 1] for i in range(2 * BINS)), F.lit(w[0]))
    return F.when(F.col("__words") > 0, 1 / (1 + F.exp(-logit))).otherwise(F.lit(float(model.prior)))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs.

    Null texts, empty ones and ones without words have no evidence and get the toxic share of the calibration rows. Null
    doc_id is in the fold of the empty string. Labels, lang, source and doc_id are never inputs of a score. Rows that repeat
    an id are scored each by its own text; ids labelled twice take the larger label. Other columns are ignored.
    """
    s = score_column(model)
    rows = with_steps(docs, model, keep=["doc_id"])
    return rows.select("doc_id", (fold() == 2).alias("held_out"), s.alias("score"), (s >= CUTOFF).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs whose score stays under the cutoff."""
    return with_steps(docs, model).filter(score_column(model) < CUTOFF).select(*docs.columns)
