"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Samples in a fingerprint: the likeness of two is the share of equal samples, within 1/sqrt(4 * SAMPLES) of the truth.
SAMPLES = 48


def log_sample(term: Column, weight: Column, k: int) -> Column:
    """The logarithm of a term's k-th sample under a weight.

    r and c are Gamma(2, 1), the step t puts the logarithm of the weight on a grid of
    width r at a random shift, and the value depends on the weight through t alone:
    the least of a document's values is equal in two documents if and only if the
    same term wins with the same t, which has the probability of their generalised
    Jaccard similarity.
    """
    first, second = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    bits = lambda h, shift, n: (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << n) - 1)).cast("double") + 0.5) / F.lit(float(1 << n))
    r = -F.log(bits(first, 0, 21) * bits(first, 21, 21))
    shift = bits(first, 42, 21)
    c = -F.log(bits(second, 0, 32) * bits(second, 32, 32))
    t = F.floor(F.log(weight.cast("double")) / r + shift)
    return F.log(c) - r * (t.cast("double") - shift + F.lit(1.0))


def samples_of(counts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """The ``samples`` least values over the rows (``keys``, term, weight) of each key, as columns s0, s1, ..."""
    return counts.groupBy(*keys).agg(*[F.min(log_sample(F.col("term"), F.col("weight"), k)).alias(f"s{k}") for k in range(samples)])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two arrays; two empty documents are alike, an empty and another one are not."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    share = F.aggregate(pairs, F.lit(0), lambda n, x: n + x).cast("double") / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(share)


def as_text(samples: Column) -> Column:
    """The samples in 8 hexadecimal digits each; an empty document's is empty."""
    return F.coalesce(F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), ""), F.lit(""))


def ordered_cuts(docs: DataFrame, key: str, n: int) -> list[int]:
    """At most ``n - 1`` ascending values that cut ``key`` into pieces of about as many rows."""
    return sorted(set(docs.select(F.percentile_approx(key, [k / n for k in range(1, n)] or [0.5], 4 * n)).head()[0] or []))


def piece(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are not above ``key``."""
    if not cuts:
        return F.lit(0)
    wide = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    below = lambda options: F.size(F.filter(options, lambda c: c <= key))
    coarse = below(F.array(*[F.lit(g[0]) for g in groups]))
    fine = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * wide + below(F.get(fine, F.greatest(coarse - 1, F.lit(0)))))


def even_cuts(sizes: list[tuple[int, int]], n: int) -> list[int]:
    """The first keys of all but the first of at most ``n`` runs of pieces (first key, bytes) that are about as large in bytes."""
    whole, before, cuts, last = sum(size for _, size in sizes) or 1, 0, [], 0
    for first, size in sizes:
        # A piece belongs to the run in which its middle lies.
        run = (2 * before + size) * n // (2 * whole)
        if before and run > last:
            cuts.append(first)
        last = run
        before += size
    return cuts


def labels_apart(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that hashing deals to as many different ones of ``n`` partitions."""
    tried = spark.range(20 * n).select(F.col("id").cast("int").alias("label"))
    found = tried.groupBy(F.pmod(F.hash("label"), F.lit(n)).alias("part")).agg(F.min("label").alias("label")).collect()
    # Twenty tries each leave a partition out once in 500 million; its bucket then shares one.
    return [*(r["label"] for r in found), *range(20 * n, 21 * n - len(found))]


def small_table(spark: SparkSession, rows: list[tuple[int, int]], names: tuple[str, str]) -> DataFrame:
    """A table of literal pairs of long and int."""
    pairs = F.array(*[F.struct(F.lit(a).cast("long").alias(names[0]), F.lit(b).cast("int").alias(names[1])) for a, b in rows])
    return spark.range(1).select(F.inline(pairs))


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts, compared with each other and with the next document.

    A document's terms are its lower-case words between white space, weighted by how
    often they occur. The edited text has the last half of the characters (rounded
    down) replaced by as many from the start of the next document in ascending order
    of ``id_col``; after the last comes the first.

    Returns ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, a row for each row. Null texts are empty; an empty text
    has an empty fingerprint, like that of another empty text (1.0) and unlike any
    other (0.0). Ids are integers of any size; a type of another kind raises. Null ids
    come first; rows of one id are ordered by text. Other columns are ignored. An
    empty table gives no rows.

    Texts are shuffled once, into buckets of consecutive ids that hold about as many
    bytes, each in a partition of its own; the first document of each bucket is also
    sent to the bucket before it. Counting terms and taking minima then stay within
    the tasks: no term or source meets in one place. Rows of one id share a bucket.
    """
    spark = docs.sparkSession
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold integers")
    # A null id takes the least key; ``known`` tells it from an id of that value.
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.col(id_col).isNotNull().alias("known"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Eight pieces of like row counts for a bucket are measured and joined: a number that is a setting.
    fine = ordered_cuts(rows, "key", 8 * n)
    sizes = rows.groupBy(piece(F.col("key"), fine).alias("piece")).agg(F.min("key").alias("key"), F.sum(F.octet_length("text") + 1).alias("size")).collect()
    sizes = sorted((r["key"], r["size"]) for r in sizes)
    starts = even_cuts(sizes, n)
    labels = labels_apart(spark, n)
    rows = rows.withColumn("home", F.get(F.array(*map(F.lit, labels)), piece(F.col("key"), starts)))
    firsts = [key for key, _ in sizes[:1]] + starts
    ahead = small_table(spark, [(firsts[(i + 1) % len(firsts)], labels[i]) for i in range(len(firsts))] or [(0, -1)], ("key", "before"))
    places = F.array(F.struct(F.col("home").alias("bucket"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest")))
    sent = rows.join(F.broadcast(ahead), "key", "left").select("key", "known", "text", F.inline(F.filter(places, lambda p: p["bucket"].isNotNull())))
    # Said here, as joins on the bucket would say it in some of the later steps alone, which then shuffle for themselves.
    sent = sent.where(F.col("bucket").isNotNull())
    by_id = Window.partitionBy("bucket").orderBy("guest", "key", "known", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    seen = sent.repartition(n, "bucket").select("bucket", "guest", "key", "known", "text", F.row_number().over(by_id).alias("row"), F.lead("text").over(by_id).alias("next"))
    seen = seen.withColumn("edited", F.when(~F.col("guest"), F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))))

    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))
    words = seen.select("bucket", "row", F.inline(sides)).select("bucket", "row", "side", F.explode(F.split(F.lower("body"), r"(?U)\s+")).alias("word"))
    terms = words.where(F.col("word") != "").select("bucket", "row", "side", F.xxhash64("word").alias("term"))
    counts = terms.groupBy("bucket", "row", "side", "term").agg(F.count("*").alias("weight"))
    least = samples_of(counts, ["bucket", "row", "side"], samples)
    prints = least.select("bucket", "row", "side", F.array(*[f"s{k}" for k in range(samples)]).alias("s"))

    about = seen.select("bucket", "row", "guest", "key", "known", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    own = about.join(prints.where("side = 0").select("bucket", "row", F.col("s").alias("own")), ["bucket", "row"], "left")
    both = own.join(prints.where("side = 1").select("bucket", "row", F.col("s").alias("changed")), ["bucket", "row"], "left")
    both = both.withColumn("following", F.lead("own").over(Window.partitionBy("bucket").orderBy("row")))
    return both.where(~F.col("guest")).select(
        F.when(F.col("known"), F.col("key")).cast(docs.schema[id_col].dataType).alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
