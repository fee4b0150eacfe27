"""Frequency of every term and short phrase: suffix-sorted n-gram counting.

Every position of a line gives the suffix that starts there, cut to ``max_terms`` terms. Suffixes are
routed by their first term, sorted in reverse lexicographic order, and read once with a stack that
holds one open prefix per length: when a prefix ends, its counts are complete and leave the stack.

Record sets are kept as first-occurrence marks: within its record, the first suffix with a given prefix
carries the record for that length. The marks add up to the exact number of distinct records of each
prefix, so equal suffixes may be merged before they travel, and a term that fills a third of all lines
reaches the sort as one row per batch and second term. Routing adds a small salt from the second term,
which splits hot first terms; the few prefixes of length one that are split by it are summed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slots

#: Parts that the suffixes of one first term are spread over.
SALTS = 16


def _lines(items: DataFrame, src: str, ord: str, item_id: str, line: str, weight: str) -> DataFrame:
    """``line`` (also null), number of records and summed weight; a record delivered twice counts once."""
    lone = F.when(F.col(src).isNull() | F.col(ord).isNull(), F.col(item_id))
    rows = items.select(F.col(src).alias("s"), F.col(ord).alias("o"), lone.alias("i"), F.col(line).alias("line"), F.coalesce(F.col(weight).cast("long"), F.lit(1)).alias("w"))
    once = rows.groupBy("s", "o", "i", "line").agg(F.min("w").alias("w"))
    return once.groupBy("line").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


def _schema(k: int) -> str:
    return ", ".join([f"t{i} string" for i in range(k)] + ["occ bigint"] + [f"rec{i} bigint" for i in range(k)])


def _suffixes(k: int):
    names = [f"t{i}" for i in range(k)] + ["occ"] + [f"rec{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            pieces = pc.split_pattern(rb.column(0), " ")
            row = pc.list_parent_indices(pieces).to_numpy()
            flat = pc.list_flatten(pieces)
            full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
            row, flat = row[full], flat.filter(pa.array(full))
            if not len(row):
                continue
            n, w = (rb.column(i).to_numpy().astype(np.int64) for i in (1, 2))
            coded = flat.dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            size = len(coded.dictionary)
            at = [code]  # the term at each later place of the suffix, ``size`` beyond the line's end
            for d in range(1, k):
                nxt = np.full(len(code), size, np.int64)
                nxt[:-d] = np.where(row[d:] == row[:-d], code[d:], size)
                at.append(nxt)
            prefix, marks = code, []
            for d in range(k):
                if d:
                    prefix = np.unique(prefix * (size + 1) + at[d], return_inverse=True)[1]
                marks.append(np.zeros(len(code), np.int64))
                first = np.unique(row * (int(prefix.max()) + 1) + prefix, return_index=True)[1]
                first = first[at[d][first] < size]
                marks[d][first] = n[row[first]]
            group, where, place = np.unique(prefix, return_index=True, return_inverse=True)
            sums = [np.zeros(len(group), np.int64) for _ in range(k + 1)]
            np.add.at(sums[0], place, w[row])
            for d in range(k):
                np.add.at(sums[d + 1], place, marks[d])
            terms = []
            for d in range(k):
                i = at[d][where]
                terms.append(coded.dictionary.take(pa.array(i, mask=i == size)))
            yield pa.RecordBatch.from_arrays([*terms, *map(pa.array, sums)], names=names)

    return run


def _stack(k: int):
    """Reads suffixes in reverse lexicographic order; gives each prefix once per task with its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[tuple, int, int] | None] = [None] * k  # open prefix, occurrences, records by length

        def out(terms: list[str], n: int, occ, rec) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(np.full(len(terms), n, np.int32)), pa.array(occ, pa.int64()), pa.array(rec, pa.int64())], names=["term", "n_terms", "occurrences", "records"])

        for rb in batches:
            if not rb.num_rows:
                continue
            occ = rb.column(k).to_numpy()
            change = np.zeros(rb.num_rows, bool)
            change[0] = True
            for d in range(k):
                col = rb.column(d)
                if rb.num_rows > 1:
                    a, b = col.slice(1), col.slice(0, rb.num_rows - 1)
                    same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False))
                    change[1:] |= ~same
                starts = np.flatnonzero(change)
                o = np.add.reduceat(occ, starts)
                r = np.add.reduceat(rb.column(k + 1 + d).to_numpy(), starts)
                there = col.is_valid().to_numpy(zero_copy_only=False)[starts]
                cols = [rb.column(i).take(pa.array(starts)) for i in range(d + 1)]
                head = tuple(c[0].as_py() for c in cols)
                if stack[d] is not None:
                    if stack[d][0] == head:
                        o[0] += stack[d][1]
                        r[0] += stack[d][2]
                    elif stack[d][0][-1] is not None:
                        yield out([" ".join(stack[d][0])], d + 1, [stack[d][1]], [stack[d][2]])
                stack[d] = (tuple(c[-1].as_py() for c in cols), int(o[-1]), int(r[-1]))
                done = np.flatnonzero(there[:-1])
                if len(done):
                    picked = [c.take(pa.array(done)) for c in cols]
                    text = picked[0] if d == 0 else pc.binary_join_element_wise(*picked, " ")
                    yield pa.RecordBatch.from_arrays([text.cast(pa.string()), pa.array(np.full(len(done), d + 1, np.int32)), pa.array(o[done]), pa.array(r[done])], names=["term", "n_terms", "occurrences", "records"])
        for d in range(k):
            if stack[d] is not None and stack[d][0][-1] is not None:
                yield out([" ".join(stack[d][0])], d + 1, [stack[d][1]], [stack[d][2]])

    return run


def term_statistics(items: DataFrame, *, max_terms: int = 2, only: int | None = None, rare_below: int = 3, common_above: float = 0.01, src: str = "src", ord: str = "ord", item_id: str = "item_id", line: str = "line", weight: str = "cnt") -> DataFrame:
    """``term``, ``n_terms``, ``occurrences``, ``records`` and ``mark`` of every phrase of up to ``max_terms`` terms.

    A term is a non-empty piece between U+0020 blanks, compared exactly; a longer phrase is written with
    single blanks. Occurrences are weighted (a null weight counts 1), records are distinct (src, ord).
    ``mark`` is ``rare`` below ``rare_below`` records, ``common`` above the share ``common_above`` of all
    records, null lines included, else null. Null, empty and blank lines hold no terms. ``only`` keeps
    the phrases of one length.
    """
    lines = cut(_lines(items, src, ord, item_id, line, weight))
    total = lines.agg(F.sum("n")).first()[0] or 0
    k = max_terms
    suffixes = lines.where(F.col("line").isNotNull()).select("line", "n", "w").mapInArrow(_suffixes(k), _schema(k))
    route = [F.col("t0")] + ([F.pmod(F.hash("t1"), F.lit(SALTS))] if k > 1 else [])
    order = [F.col(f"t{i}").desc_nulls_last() for i in range(k)]
    counts = suffixes.repartition(slots(items.sparkSession), *route).sortWithinPartitions(*order).mapInArrow(_stack(k), "term string, n_terms int, occurrences bigint, records bigint")
    if only is not None:
        counts = counts.where(F.col("n_terms") == only)
    if k > 1 and only in (None, 1):  # the salt may have split phrases of one term
        counts = counts.groupBy("term", "n_terms").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(total * common_above), "common")
    return counts.withColumn("mark", mark)
