"""Mixing sources to target weights by temperature.

Each source's share of all tokens is raised to an exponent and normalised: 1
keeps the shares, 0 makes all sources equal. The exponent is found by bisection:
from 1 it is lowered until the weights have a target entropy (as a share of the
most possible), and raised again, if need be, until no source is repeated more
often than a limit.
Weights times a token budget give each source its tokens.

They are realised as block permutations. Every epoch of a source is a permutation
of its documents by a seeded hash. Whole epochs take every document; the last,
partial one takes documents in its order while they fit the source's budget. To
find that cut, hashes are grouped in ``BLOCKS`` blocks of each source: blocks are
summed (partial aggregates, so a source may hold any share of the rows), the
block in which the budget ends is found from their running sums, and only that
block's documents are summed one by one. What the driver sees, and what is
broadcast to the documents, is one row for each source, at most ``MAX_SOURCES``
(more is an error: such a column is an id, not a source). Documents themselves
are not shuffled.

``place`` (0 to 1) orders the mix: sorting by it interleaves the sources in their
weights, epoch after epoch.

Without a budget it is the least at which every source is used once at least:
no document is lost, smaller sources repeat.

Defined results: a null source is a source. Null text has no tokens. A source
without tokens has weight 0 and is used once. Documents that share id and text
share their hash and are taken or left together; equal cuts are inclusive. Columns
named epoch, place, n_tokens are replaced, others kept. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwise.llm.common import materialize, set_aside, table

#: Entropy wanted, as a share of the logarithm of the number of sources; most times that a source may be used.
TARGET_ENTROPY, MAX_REPEATS = 0.998, 2.0
SEED, BLOCKS, MAX_SOURCES = 17, 4096, 100_000
#: Halvings of the range of exponents, 0 to 1.
HALVINGS = 60
RESULTS = ("n_tokens", "epoch", "place")
_UNIT = float(16**15)


def weights(tokens: list[float], exponent: float) -> list[float]:
    """Normalised powers of the token shares; sources without tokens have weight 0."""
    total = sum(tokens)
    powers = [(t / total) ** exponent if t else 0.0 for t in tokens]
    whole = sum(powers)
    return [p / whole for p in powers]


def entropy(shares: list[float]) -> float:
    return -sum(w * math.log(w) for w in shares if w)


def repeats(tokens: list[float], shares: list[float], budget: float | None) -> list[float]:
    """How often each source is used: its tokens of the budget over its own; without a budget, once at least."""
    often = [w / t if t else 0.0 for w, t in zip(shares, tokens)]
    least = min((x for x in often if x), default=1.0)
    return [x / least if budget is None else x * budget for x in often]


def find_exponent(tokens: list[float], target_entropy: float | None, max_repeats: float | None, budget: float | None = None) -> float:
    """Bisection: the largest exponent up to 1 whose weights have the target entropy, or the next above it that keeps the limit.

    Entropy and the largest repetition both fall as the exponent grows. Without a
    target it is the smallest that keeps the limit. A target beyond equal weights
    gives 0; a limit that even the plain shares break (a large budget) gives 1.
    """
    some = [t for t in tokens if t]
    if not some or (target_entropy is None and max_repeats is None):
        return 1.0

    def enough(exponent: float) -> bool:
        return entropy(weights(some, exponent)) >= target_entropy * math.log(len(some))

    def seldom(exponent: float) -> bool:
        return max(repeats(some, weights(some, exponent), budget)) <= max_repeats

    def bisect(low: float, high: float, goes_up) -> tuple[float, float]:
        for _ in range(HALVINGS):
            middle = (low + high) / 2
            low, high = (middle, high) if goes_up(middle) else (low, middle)
        return low, high

    found = 0.0
    if target_entropy is not None:
        found = 1.0 if enough(1.0) else bisect(0.0, 1.0, enough)[0]
    if max_repeats is not None and not seldom(found):
        found = bisect(found, 1.0, lambda x: not seldom(x))[1]
    return found


def _unit(epoch, key):
    """Uniform numbers from 0 to 16**15 - 1 for an epoch (column) and a document's key."""
    text = F.concat_ws("|", F.lit(str(SEED)), epoch.cast("string"), key)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _key(doc_id: str, text: str):
    return F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit(""))))


def _tokens(text: str):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def plan(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", target_entropy: float | None = TARGET_ENTROPY,
         max_repeats: float | None = MAX_REPEATS, budget: float | None = None) -> DataFrame:
    """A row for each source: __source, tokens, weight, often (times used), epochs (whole ones), cut (last hash of the partial one)."""
    spark = docs.sparkSession
    slim = materialize(docs.select(F.col(source).alias("s"), _key(doc_id, text).alias("key"), _tokens(text).alias("t")), "tokens")
    totals = slim.groupBy("s").agg(F.sum("t").alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    tokens = [float(r.t) for r in totals]
    if not any(tokens):
        return spark.createDataFrame([(r.s, 0, 0.0, 1.0, 1, -1) for r in totals], _plan_schema(docs, source))
    shares = weights(tokens, find_exponent(tokens, target_entropy, max_repeats, budget))
    often = repeats(tokens, shares, budget)
    rows = []
    for r, w, x in zip(totals, shares, often):
        whole = int(x + 1e-9)
        rows.append((r.s, r.t, w, x, whole, max(0.0, (x - whole) * r.t)) if r.t else (r.s, 0, 0.0, 1.0, 1, 0.0))
    sources = F.broadcast(spark.createDataFrame(rows, _plan_schema(docs, source, "rest double")))

    # The cut of the partial epoch: first the block, then the document.
    hashed = slim.join(sources.select(F.col("__source"), "epochs", "rest"), F.col("s").eqNullSafe(F.col("__source"))).filter("rest > 0")
    hashed = hashed.withColumn("u", _unit(F.col("epochs"), F.col("key")))
    hashed = hashed.withColumn("b", F.floor(F.col("u") / F.lit(_UNIT / BLOCKS))).select("s", "t", "rest", "u", "b")
    sums = hashed.groupBy("s", "rest", "b").agg(F.sum("t").alias("t"), F.max("u").alias("u"))
    upto = F.sum("t").over(Window.partitionBy("s").orderBy("b"))  # at most BLOCKS rows a source
    sums = materialize(sums.withColumn("upto", upto).select("s", "b", "u", "rest", (F.col("upto") - F.col("t")).alias("before"), "upto"), "blocks")
    cut = sums.filter("before <= rest AND upto > rest").groupBy(F.col("s").alias("cs")).agg(F.min("b").alias("cb"), F.min_by("before", "b").alias("before"))
    inside = hashed.join(F.broadcast(cut), F.col("s").eqNullSafe(F.col("cs")) & (F.col("b") == F.col("cb")))
    upto = F.sum("t").over(Window.partitionBy("s").orderBy("u"))  # one block's documents, equal hashes together
    last = (inside.withColumn("upto", F.col("before") + upto).filter("upto <= rest").select("s", "u")
            .union(sums.filter("upto <= rest").select("s", "u")).groupBy(F.col("s").alias("ls")).agg(F.max("u").alias("cut")))
    found = sources.join(F.broadcast(last), F.col("__source").eqNullSafe(F.col("ls")), "left")
    return materialize(found.select("__source", "tokens", "weight", "often", "epochs", F.coalesce("cut", F.lit(-1)).alias("cut")), "mix-plan")


def _plan_schema(docs: DataFrame, source: str, last: str = "cut long") -> str:
    return f"__source {docs.schema[source].dataType.simpleString()}, tokens long, weight double, often double, epochs int, {last}"


def mix(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", **targets) -> DataFrame:
    """``docs``, each row as often as its source's plan has it, with n_tokens, epoch (from 0) and place."""
    of = F.broadcast(plan(docs, source, doc_id, text, **targets).select("__source", F.col("often").alias("__often"), F.col("epochs").alias("__epochs"), F.col("cut").alias("__cut")))
    columns = [c for c in docs.columns if c not in RESULTS]
    key = F.col("__key")
    rows = (docs.withColumn("__key", _key(doc_id, text)).withColumn("__n", _tokens(text))
            .join(of, F.col(source).eqNullSafe(F.col("__source"))))
    copies = F.col("__epochs") + F.when(_unit(F.col("__epochs"), key) <= F.col("__cut"), 1).otherwise(0)
    rows = rows.withColumn("__copies", copies).filter("__copies > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    place = (F.col("__epoch") + _unit(F.col("__epoch"), key) / F.lit(_UNIT)) / F.col("__often")
    return rows.select(*columns, F.col("__n").alias("n_tokens"), F.col("__epoch").alias("epoch"), place.alias("place"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "n_tokens", "epoch", "place")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents, repeated as the weights want it (every document once at least), in order of place."""
    docs, columns = set_aside(docs, ("doc_id", "source", "text"))
    # Copies of a row without another id have one place; the row number only spreads them over the ranges.
    return mix(docs).orderBy("place", F.monotonically_increasing_id()).select(*columns)


#: The bisection for the entropy is a recursion; the limit without a budget has a closed form.
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
                  coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS t FROM d GROUP BY source),
l AS (SELECT list(t::DOUBLE / n) AS p, {TARGET_ENTROPY} * ln(count(*)) AS wanted FROM s, (SELECT sum(t) AS n FROM s) WHERE t > 0),
h AS (SELECT 0 AS i, 0.0::DOUBLE AS low, 2.0::DOUBLE AS high FROM l
      UNION ALL
      SELECT i + 1, CASE WHEN enough THEN a ELSE low END, CASE WHEN enough THEN (CASE WHEN i = 0 THEN a ELSE high END) ELSE a END
      FROM (SELECT i, low, high, a, ln(list_sum(list_transform(p, lambda x: x ** a))) - a * list_sum(list_transform(p, lambda x: x ** a * ln(x))) / list_sum(list_transform(p, lambda x: x ** a)) >= wanted AS enough
            FROM (SELECT *, (low + high) / 2 AS a FROM h) , l) WHERE i <= {HALVINGS}),
a1 AS (SELECT low AS a FROM h WHERE i = {HALVINGS} + 1),
a2 AS (SELECT greatest(a, coalesce(1 - ln({MAX_REPEATS}) / nullif(ln(list_max(p) / list_min(p)), 0), 0)) AS a FROM a1, l),
w AS (SELECT source, t, CASE WHEN t > 0 THEN (max(t) OVER () / t) ** (1 - a) ELSE 1.0 END AS often FROM s, a2),
q AS (SELECT *, floor(often + 1e-9)::INTEGER AS epochs, CASE WHEN t > 0 THEN greatest(0.0, (often - floor(often + 1e-9)) * t) ELSE 0.0 END AS rest FROM w),
u AS (SELECT d.*, often, epochs, rest, ('0x' || substr(md5('{SEED}|' || epochs || '|' || key), 1, 15))::BIGINT AS u FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
c AS (SELECT *, rest > 0 AND sum(n_tokens) OVER (PARTITION BY source ORDER BY u) <= rest AS part FROM u),
x AS (SELECT *, unnest(generate_series(0, epochs + part::INTEGER - 1))::INTEGER AS epoch FROM c)
SELECT doc_id, source, n_tokens, epoch, (epoch + ('0x' || substr(md5('{SEED}|' || epoch || '|' || key), 1, 15))::BIGINT / {_UNIT}) / often AS place FROM x
"""
