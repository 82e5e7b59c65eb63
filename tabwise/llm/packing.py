"""Best-fit packing by bin completion.

Pieces have at most ``capacity`` tokens, so their lengths form a histogram of at
most ``capacity`` entries however many pieces there are. Only this histogram
comes to the driver. There, bin completion works on counts: take the longest
remaining length, enumerate the undominated fillings of the space beside it (a
filling is dominated if one of its lengths could be exchanged for a longer one
that still fits, or if another length could be added), branch on those of least
waste, and prune a branch as soon as its waste exceeds that of the best packing
found so far, or if the bound ``ceil(total / capacity)`` is met. The incumbent is
first-fit decreasing. A filling is used as often as its lengths last, so the plan
is a list of patterns (lengths, how often), a few for each length.

The pieces are then numbered within their length (in shards, so that one length
may hold any share of the rows) and each number is looked up in the plan: that
gives its sequence and its place there. Nothing else passes through the driver
and no task sees more than a shard of one length.

Defined results: null text is empty (one piece: the end id). Lengths that are
null or below 1 get no sequence (null); over ``capacity`` is an error. Pieces of
equal length are interchangeable; ties and repeated rows are ordered by nothing
else than the columns, so repeated rows may exchange places. Empty table: no
row. Columns of the input named sequence_id or offset are replaced; all others
are kept.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwise.llm.common import materialize, offsets, steps, table, text_bytes
from tabwise.llm.tokens import TOKENIZER, encoder, tokenizer_file, with_end

CAPACITY, END_ID = 2048, 0
#: Fillings that a step of the branch-and-bound keeps open, and most steps (patterns taken, also again).
BRANCHES, MAX_STEPS = 3, 20_000
#: Rows of one length that are numbered together, about.
SHARD_ROWS = 100_000


# --- the plan: bin completion on a histogram -------------------------------------------------------------------------

def fillings(lengths: list[int], counts: dict[int, int], space: int, most: int) -> list[tuple[int, ...]]:
    """Up to ``most`` undominated fillings of ``space``, least waste first, then fewest and longest pieces.

    lengths: those with pieces left, ascending. Depth first by descending
    length: at each depth the longest piece that fits, then those that leave room
    for another (any other is dominated by the longest); one or two pieces that
    close the gap exactly end the branch.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = 16 * most

    def free(size: int, taken: tuple[int, ...]) -> bool:
        return counts.get(size, 0) > taken.count(size)

    def extend(left: int, longest: int, taken: tuple[int, ...]) -> None:
        nonlocal budget
        budget -= 1
        top = bisect_right(lengths, min(left, longest)) - 1
        while top >= 0 and not free(lengths[top], taken):
            top -= 1
        if top < 0 or lengths[top] == left:
            found.append((0, (*taken, left)) if top >= 0 else (left, taken))
            return
        for i in range(top, -1, -1):
            size = lengths[i]
            if 2 * size < left:
                break
            if free(size, taken) and free(left - size, (*taken, size)):
                found.append((0, (*taken, size, left - size)))
                return
        tried, at = 0, top
        while at >= 0 and tried < 4 and budget > 0 and sum(w == 0 for w, _ in found) < most:
            if free(lengths[at], taken):
                extend(left - lengths[at], lengths[at], (*taken, lengths[at]))
                tried += 1
            at = min(at, bisect_right(lengths, left - lengths[0])) - 1

    if lengths:
        extend(space, space, ())
    found.sort(key=lambda x: (x[0], len(x[1]), [-p for p in x[1]]))
    return list(dict.fromkeys(tuple(sorted(p, reverse=True)) for _, p in found))[:most]


def first_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """The incumbent: longest first, each completed with the longest piece that fits, on counts."""
    counts, plan = dict(histogram), []
    left = sorted(counts)
    while left:
        pieces, room = [], capacity
        used: dict[int, int] = {}
        at = len(left) - 1
        while at >= 0:
            size = left[at]
            n = min(room // size, counts[size] - used.get(size, 0))
            if n:
                pieces += [size] * n
                used[size] = used.get(size, 0) + n
                room -= n * size
            at = min(at, bisect_right(left, room)) - 1
        times = min(counts[s] // n for s, n in used.items())
        plan.append((times, tuple(pieces)))
        for s, n in used.items():
            counts[s] -= n * times
            if not counts[s]:
                left.remove(s)
    return plan


def bin_completion(histogram: dict[int, int], capacity: int, branches: int = BRANCHES, max_steps: int = MAX_STEPS) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (how often, lengths in descending order) that hold every piece once, in as few sequences as found."""
    histogram = {int(s): int(n) for s, n in histogram.items() if n > 0}
    if histogram and (min(histogram) < 1 or max(histogram) > capacity):
        raise ValueError("lengths must be 1 to capacity")
    total = sum(s * n for s, n in histogram.items())
    bound = -(-total // capacity)
    best = first_fit_decreasing(histogram, capacity)
    fewest = sum(t for t, _ in best)
    counts, left, waste, used = dict(histogram), sorted(histogram), 0, 0
    taken: list[tuple[int, tuple[int, ...], list[tuple[int, ...]]]] = []  # pattern, how often, fillings not yet tried

    def take(pieces: tuple[int, ...], others: list[tuple[int, ...]]) -> None:
        nonlocal waste, used
        need = {p: pieces.count(p) for p in pieces}
        times = min(counts[s] // n for s, n in need.items())
        for s, n in need.items():
            counts[s] -= n * times
            if not counts[s]:
                left.remove(s)
        waste, used = waste + times * (capacity - sum(pieces)), used + times
        taken.append((times, pieces, others))

    def undo() -> list[tuple[int, ...]]:
        nonlocal waste, used
        times, pieces, others = taken.pop()
        for s in pieces:
            if not counts[s]:
                insort(left, s)
            counts[s] += times
        waste, used = waste - times * (capacity - sum(pieces)), used - times
        return others

    for _ in range(max_steps):
        if fewest == bound:
            break
        if left and waste <= (fewest - 1) * capacity - total:  # else no packing from here beats the incumbent
            size = left[-1]
            counts[size] -= 1
            options = fillings([x for x in left if x <= capacity - size and counts[x]], counts, capacity - size, branches) or [()]
            counts[size] += 1
            options = [(size, *f) for f in options]
        else:
            if not left and used < fewest:
                best, fewest = [(t, p) for t, p, _ in taken], used
            options = []
            while taken and not options:
                options = undo()
            if not options:
                break
        take(options[0], options[1:])
    return best


def places(plan: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """The plan as intervals of the numbers 0, 1, .. of the pieces of each length: sorted by (length, first)."""
    rows, next_of, sequence = [], {}, 0
    for times, pieces in plan:
        at, i = 0, 0
        while i < len(pieces):
            size = pieces[i]
            n = sum(p == size for p in pieces)
            first = next_of.get(size, 0)
            rows.append((size, first, n, sequence, at))
            next_of[size] = first + n * times
            at, i = at + n * size, i + n
        sequence += times
    rows.sort()
    return dict(zip(("length", "first", "each", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 5).T.copy()))


# --- the operator ----------------------------------------------------------------------------------------------------

def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, branches: int = BRANCHES, max_steps: int = MAX_STEPS,
         order: tuple[str, ...] = ()) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is written to the shared folder first, as its lengths are read twice."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    private = {c: f"__p{i}" for i, c in enumerate(names)}  # so that no column meets a name used here
    pieces = materialize(pieces.drop("sequence_id", "offset").toDF(*private.values()), "pieces")
    columns, length, order = list(private.values()), private[length], [private[c] for c in order]
    known = F.col(length) >= 1
    seen = pieces.filter(known).groupBy(F.least(F.col(length), F.lit(capacity + 1)).cast("long").alias("length")).agg(F.count("*").alias("n")).collect()
    histogram = {r.length: r.n for r in seen}  # at most capacity + 1 rows
    plan = places(bin_completion(histogram, capacity, branches, max_steps))

    shards = max(1, -(-max(histogram.values(), default=0) // SHARD_ROWS))
    order = order or columns
    numbered = (pieces.withColumn("__shard", F.when(known, F.pmod(F.xxhash64(*order), F.lit(shards))))
                .withColumn("__n", F.when(known, F.row_number().over(Window.partitionBy(length, "__shard").orderBy(*order)) - 1)))
    size = pieces.filter(known).groupBy(F.col(length).alias("__length"), F.pmod(F.xxhash64(*order), F.lit(shards)).alias("__shard")).agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy("__length").orderBy("__shard")) - F.col("__rows")
    base = size.select(F.col("__length").alias("__l"), F.col("__shard").alias("__s"), before.alias("__before"))  # a row for each length and shard
    numbered = (numbered.join(base, (F.col(length) == F.col("__l")) & (F.col("__shard") == F.col("__s")), "left")
                .withColumn("__n", F.col("__n") + F.col("__before")).drop("__shard", "__l", "__s", "__before"))

    span = max(histogram.values(), default=0) + 1
    keys = plan["length"] * span + plan["first"]

    def place(batches):
        for batch in batches:
            number, n = batch.column("__n"), batch.num_rows
            missing = number.is_null().to_numpy(zero_copy_only=False)
            at = number.fill_null(0).to_numpy(zero_copy_only=False)
            sizes = np.where(missing, 0, batch.column("__size").fill_null(0).to_numpy(zero_copy_only=False))
            i = np.maximum(np.searchsorted(keys, sizes * span + at, side="right") - 1, 0)
            if len(keys):
                k = at - plan["first"][i]
                sequence = plan["sequence"][i] + k // plan["each"][i]
                offset = plan["offset"][i] + k % plan["each"][i] * sizes
            else:
                sequence = offset = np.zeros(n, np.int64)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64(), mask=missing), pa.array(offset, pa.int64(), mask=missing)],
                                             names=[*columns, "sequence_id", "offset"])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return numbered.withColumn("__size", F.col(length).cast("long")).mapInArrow(place, schema).toDF(*names, "sequence_id", "offset")


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, doc_id: str = "doc_id",
                 text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit) of the pieces of every document."""
    path = tokenizer_file(tokenizer)

    def run(batches):
        encode = encoder(path).encode
        for batch in steps(batches, "__text"):
            ids, counts = with_end(*encode(batch.column("__text").to_pylist()), end_id)
            n_pieces = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), n_pieces)
            piece = np.arange(len(doc)) - np.repeat(offsets(n_pieces)[:-1], n_pieces)
            start = piece * capacity
            length = np.minimum(counts[doc] - start, capacity)
            at = 4 * (offsets(counts)[:-1][doc] + start)
            data = ids.view(np.uint8).data
            parts = [data[a:b] for a, b in zip(at, at + 4 * length)]
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                       pa.array([zlib.crc32(p) for p in parts], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array([bytes(p) for p in parts], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(F.col(text)).alias("__text")).mapInArrow(run, schema)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces with their sequence and place."""
    return pack(token_pieces(table(spark, sf_dir, "documents")), order=("doc_id", "piece", "ids_crc32"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of the documents."""
    return pack(token_pieces(docs), order=("doc_id", "piece", "ids_crc32"))
