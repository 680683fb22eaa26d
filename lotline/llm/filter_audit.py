"""How filters interact: what each removes in every order, and its Shapley share."""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, forget, written

#: The filters, in the order of their bits.
LETTERS = "ABCDE"


def failures(text: Column) -> dict[str, Column]:
    """What makes a text fail each filter that looks at it alone."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the filters that they fail (bit i: letter i).

    Texts are read once; what is shuffled of a document is a digest of its text,
    its id and its mask. The least id of a text is a minimum that is combined
    before its shuffle and written, so that both sides of the join are plain
    exchanges, whose hot keys Spark can split.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = sum((F.when(c, 1 << LETTERS.index(x)).otherwise(0) for x, c in failures(text).items()), F.lit(0))
    slim = written(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), bits.alias("mask")), "audit")
    first = written(slim.groupBy("same").agg(F.min("doc_id").alias("first")), "audit-first")
    marks = labels.groupBy("doc_id").agg(*(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c) for c in ("quality", "toxic")))
    full = slim.join(first, "same").join(marks, "doc_id", "left")
    repeat = F.coalesce((F.col("first") < F.col("doc_id")).cast("int"), F.lit(0)) * (1 << LETTERS.index("E"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = written(full.groupBy("part", (F.col("mask") + repeat).alias("mask")).agg(F.count("*").alias("n"), n("quality").alias("good"), n("toxic").alias("toxic")), "audit-masks")
    forget(slim, first)
    return out


class Removal:
    """The multilinear polynomial of how many documents filters remove.

    At a corner, x_i is 1 where filter i is used and else 0, and the value is
    the number of documents that fail any filter used. coefficient[T] belongs to
    the product of the x_i whose bits are in T.
    """

    def __init__(self, counts: dict[int, int], filters: int):
        self.filters = filters
        self.coefficient = [0] * (1 << filters)
        # n (1 - (1 - x_1)...(1 - x_k)), multiplied out, for each mask
        for t in range(1, 1 << filters):
            over = sum(n for m, n in counts.items() if m & t == t)
            self.coefficient[t] = over if t.bit_count() % 2 else -over

    def at(self, corner: int) -> int:
        return sum(a for t, a in enumerate(self.coefficient) if t & corner == t)

    def derivative(self, i: int) -> list[int]:
        """Coefficients by powers of t of the derivative by x_i, where all x are t."""
        out = [0] * self.filters
        for t, a in enumerate(self.coefficient):
            if t >> i & 1:
                out[t.bit_count() - 1] += a
        return out

    def shapley(self, i: int) -> Fraction:
        """The mean, over all orders, of what filter i removes: the integral of its derivative along the diagonal."""
        return sum((Fraction(a, k + 1) for k, a in enumerate(self.derivative(i))), Fraction(0))


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def orders(part: str, counts: list[dict], letters: str = LETTERS) -> list[tuple]:
    """A row of RESULT for each order of the filters and each step of it."""
    k = len(letters)
    total = sum(c["n"] for c in counts)
    docs, good, toxic = (Removal({c["mask"]: c[x] for c in counts}, k) for x in ("n", "good", "toxic"))
    every = (1 << k) - 1
    corner = [(docs.at(s), good.at(s), toxic.at(s)) for s in range(every + 1)]
    share = [docs.shapley(i) * factorial(k) for i in range(k)]
    assert all(s.denominator == 1 for s in share)
    rows = []
    for order in permutations(range(k)):
        used = 0
        for step, i in enumerate(order, 1):
            then = used | 1 << i
            gone, was_good, was_toxic = (b - a for a, b in zip(corner[used], corner[then]))
            alone = corner[every][0] - corner[every & ~(1 << i)][0]
            rows.append((part, "".join(letters[j] for j in order), step, total - corner[then][0], gone, corner[1 << i][0] - gone, alone, was_good, was_toxic, int(share[i])))
            used = then
    return rows


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """RESULT for each part (value of lang; null: empty string), order and step.

    Rows are reduced to at most 32 counts a part, combined before the shuffle;
    the polynomials stand on these. The parts are dealt over the tasks, so there
    may be many. shapley is the sum over all 120 orders, exact.

    Null texts count as empty, so they fail A alone and are equal to empty ones.
    A repeated row is no copy of itself: E looks for a smaller doc_id, and rows
    without doc_id neither fail it nor make others fail. Where labels has more
    rows of one doc_id, a 1 in any of them counts; null labels count as 0. No
    documents, no rows. Other columns of docs are ignored.
    """
    kind = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[t]) for n, t in (x.split() for x in RESULT.split(", "))])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                columns = zip(*orders(r["part"], r["counts"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, kind)], schema=kind)

    return masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts")).mapInArrow(run, RESULT)
