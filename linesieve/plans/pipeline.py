"""A whole run: lines in, mode and method applied, lines or counts out."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import family as family_of
from ..functions.sizing import BloomParams, bloom_params
from ..operators import bloom, exact, model, scaling
from ..options import LEAST_CAPACITY, DedupOptions
from ..sources.text import line_key

#: Least lines of a sub-filter of a scaling filter, as long as no capacity is given.
SCALING_CAPACITY = 1_000_000


def estimated_capacity(lines: DataFrame, key: str) -> int:
    """Distinct keys, by a sketch with 2% standard error and a tenth added."""
    n = lines.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    return max(LEAST_CAPACITY, int(n * 1.1))


def filter_params(lines: DataFrame, key: str, options: DedupOptions) -> BloomParams:
    capacity = estimated_capacity(lines, key) if options.capacity == "auto" else int(options.capacity)
    return bloom_params(capacity, options.error_rate)


def run(lines: DataFrame, options: DedupOptions | None = None) -> DataFrame:
    """``line`` and ``ord`` of the chosen lines (``cnt`` too for counts), in no particular order.

    ``lines`` has ``ord`` (unique) and ``line``, and ``had_newline`` for ``strict_newline``; further columns
    are ignored. Duplicates are all later occurrences; groups, once and counts have one row per key.
    With ``load_model`` only lines count that the saved filter doesn't know (duplicates: the others, too);
    with ``save_model`` as well, the saved filter goes on with the lines and is saved again, else a new
    one is saved. A result is taken from the filter as it was before.
    Sort by ``ord`` at the sink if the input order is wanted.
    """
    o = options or DedupOptions()
    if o.method == "auto":
        o = replace(o, method="exact")
    key = line_key(F.col("line"), F.col("had_newline") if o.strict_newline else None, o.max_line_bytes)
    plain = not o.strict_newline and o.max_line_bytes is None
    rows = lines.select("ord", "line", *([] if plain else [key.alias("_key")]))
    k = "line" if plain else "_key"
    result = None
    if o.load_model and o.mode in ("counts", "groups", "once"):  # of lines that the saved filter doesn't know
        rows = model.unknown(rows, k, o.load_model)
    if o.mode == "counts":
        out = exact.counts(rows, k, "ord")
    elif o.mode == "groups":
        out = exact.repeated_keys(rows, k, "ord")
    elif o.mode == "once":
        out = exact.single_keys(rows, k, "ord")
    elif o.load_model:
        out = model.incremental_unique(rows, k, "ord", o.load_model)
    elif o.method == "exact":
        out = exact.first_occurrences(rows, k, "ord")
    elif o.method == "scaling":
        # Few sub-filters, however many lines there are.
        capacity = max(SCALING_CAPACITY, estimated_capacity(rows, k) // 8) if o.capacity == "auto" else int(o.capacity)
        result = scaling.scaling_unique(rows, k, "ord", capacity, o.error_rate, family_of(o.family))
        out = result.accepted.drop("level")
    else:
        params = filter_params(rows, k, o)
        family = family_of(o.family)
        if o.method == "partitioned":
            each = bloom_params(max(LEAST_CAPACITY, -(-params.entries // o.num_buckets)), o.error_rate)
            out = bloom.partitioned_unique(rows, k, "ord", each, o.num_buckets, family)
        else:
            out = bloom.unique(rows, k, "ord", params, family)
    if o.save_model and o.load_model:
        model.extended(lines.select("ord", "line", *([] if plain else [key.alias("_key")])), k, "ord", o.load_model, o.save_model)
    elif o.save_model and result is not None:
        model.save_scaling(result, o.save_model, o.family, int(rows.agg(F.max("ord")).first()[0] or 0), error=o.error_rate)
    elif o.save_model:
        params = filter_params(rows, k, o)
        top = rows.agg(F.max("ord")).first()[0] or 0
        model.save(bloom.build(rows, k, "ord", params, family_of(o.family)), o.save_model, params, o.family, int(top))
    if o.mode == "duplicates":  # everything that the chosen method doesn't emit
        out = rows.join(out.select(F.col("ord").alias("_first")), F.col("ord") == F.col("_first"), "left_anti").select("line", "ord")
    elif not plain:
        out = out.join(rows.select(F.col("ord").alias("_o"), "line"), F.col("ord") == F.col("_o")).drop("_o", "_key")
    if o.limit is not None:
        out = out.orderBy("ord").limit(o.limit)
    return out.select("line", "ord", *(["cnt"] if "cnt" in out.columns else []))
