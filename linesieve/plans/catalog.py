"""Named queries over the test tables, each over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, validate
from ..functions.hashing import Md5, Murmur3
from ..functions.sizing import BloomParams, bloom_params, level_error, scaling_params
from ..operators import bloom, counting, exact, model, scaling, stats
from ..options import LEAST_CAPACITY, MOST_FILE_CAPACITY, file_capacity_column
from ..runtime import shared_folder
from ..sources.text import column_lines, line_key, read_lines
from ..streaming import dedup

MD5 = Md5()
#: Error rate of the filters that are sized for their input, a filter far too small for its input, and sizes for small tables.
ERROR, SMALL = 0.01, bloom_params(1000, 0.1)
EVENT_FILTER, ACCEPTED_FILTER = bloom_params(1000, 0.01), bloom_params(10_000, 0.01)
EVENT_SLICES = scaling_params(1000, 0.01)
BUCKETS = 16
PREFIX = 255
#: Published answers of MurmurHash3 x64 128 with seed 0.
MURMUR_ANSWERS = [("", "0000000000000000", "0000000000000000"), ("hello", "cbd8a7b341bd9b02", "5b1e906a48ae1d19"), ("The quick brown fox jumps over the lazy dog", "e34bbc7bbc071b6c", "7a433ca9c49a9347")]
#: Room for the lines of a text below the number of its document.
LINE_ROOM = 2**32
SCALING_CASES = [(1000, 0.5), (1000, 0.01), (100_000, 0.01), (1_000_000, 0.01), (1_000_000, 0.001)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``line_no`` (from 1), ``ord`` and ``line`` of every line of every document text."""
    lines = column_lines(table(spark, sf_dir, "documents"), "text", "doc_id", "source")
    return lines.withColumn("ord", F.col("doc_id") * LINE_ROOM + F.col("line_no"))


def sized(lines: DataFrame, key: str = "line", parts: int = 1) -> BloomParams:
    """A filter (of ``parts`` equal ones) for all distinct keys of a relation, counted exactly."""
    return bloom_params(max(LEAST_CAPACITY, -(-lines.select(key).distinct().count() // parts)), ERROR)


def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"))


def uniq_lines(spark, sf_dir):
    """Each distinct line with the order of its first occurrence."""
    return exact.first_occurrences(document_lines(spark, sf_dir), "line", "ord")


def uniq_docs(spark, sf_dir):
    """B1: whole documents, the first of each text; the null text is one key."""
    return exact.unique_rows(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "text", "doc_id").select("doc_id", "lang")


def uniq_work_lines(spark, sf_dir):
    """B1 over the largest table, hot lines and nulls included."""
    return exact.first_occurrences(table(spark, sf_dir, "work_item_t").select("line", "item_id"), "line", "item_id")


def dup_lines(spark, sf_dir):
    """Every occurrence but the first."""
    return exact.repeats(document_lines(spark, sf_dir), "line", "ord").select("ord", "line")


def dup_groups(spark, sf_dir):
    """Repeated lines, one row each."""
    return exact.repeated_keys(document_lines(spark, sf_dir), "line", "ord")


def once_lines(spark, sf_dir):
    """Lines that occur once."""
    return exact.single_keys(document_lines(spark, sf_dir), "line", "ord").select("line", "ord")


def line_counts(spark, sf_dir):
    """Occurrences of each line."""
    return exact.counts(document_lines(spark, sf_dir), "line", "ord")


def work_line_totals(spark, sf_dir):
    """C9 with weights: rows and recorded counts of each work line."""
    return exact.counts(table(spark, sf_dir, "work_item_t"), "line", "item_id", weight="cnt")


def top_dups(spark, sf_dir):
    """The 100 most frequent lines, ties by line."""
    return exact.top_repeated(document_lines(spark, sf_dir), "line", "ord", 100)


def result_flags(spark, sf_dir):
    """P5: 1 for a first occurrence, 0 for a repeat."""
    lines = document_lines(spark, sf_dir).select("ord", "line")
    firsts = exact.first_occurrences(lines, "line", "ord").select(F.col("ord").alias("first"))
    return lines.join(firsts, F.col("ord") == F.col("first"), "left").select("ord", F.col("first").isNotNull().cast("int").alias("cnt"))


def strict_line_counts(spark, sf_dir):
    """L2: a final line without newline is another key."""
    rows = table(spark, sf_dir, "work_item_t").select("item_id", line_key(F.col("line"), F.coalesce("had_newline", F.lit(True))).alias("key"))
    return exact.counts(rows, "key", "item_id").select("key", "cnt", F.col("item_id").alias("first_item"))


def dedup_stats(spark, sf_dir):
    """A1, A2: counters over all document lines."""
    return stats.line_statistics(document_lines(spark, sf_dir), "line")


def dedup_stats_by_lang(spark, sf_dir):
    """A2 per language."""
    return stats.line_statistics(table(spark, sf_dir, "documents").select("lang", "text"), "text", ["lang"])


def run_rates(spark, sf_dir):
    """Throughput and share of duplicates of the reported runs."""
    total, dup = F.col("total_lines"), F.col("duplicate_lines")
    share = F.when(total > 0, dup / total).otherwise(0.0)
    return table(spark, sf_dir, "run_statistics").select("run_id", F.round(stats.throughput(total, F.col("processing_time")), 3).alias("throughput"), F.round(share, 6).alias("duplicate_share"))


def truncated_lines(spark, sf_dir):
    """Byte prefixes of over-long lines, in hex."""
    lines = table(spark, sf_dir, "work_item_t").select("item_id", "line").where(F.octet_length("line") > PREFIX)
    return lines.select("item_id", F.lower(F.hex(formats.prefix_bytes(F.col("line"), PREFIX))).alias("prefix"))


def truncated_uniq(spark, sf_dir):
    """L3: first occurrences of lines cut to a byte prefix of 64, counted by the prefix in hex."""
    key = F.lower(F.hex(formats.prefix_bytes(F.col("line"), 64))).alias("prefix")
    return exact.counts(table(spark, sf_dir, "work_item_t").select("item_id", key), "prefix", "item_id")


def json_escape(spark, sf_dir):
    """O4."""
    return table(spark, sf_dir, "work_item_t").select("item_id", formats.json_escaped(F.col("line")).alias("escaped"))


def csv_escape(spark, sf_dir):
    """O3."""
    return table(spark, sf_dir, "documents").select("doc_id", formats.csv_quoted(F.col("text")).alias("quoted"))


def tsv_text(spark, sf_dir):
    """O1, O2: a line as it is."""
    return uniq_work_lines(spark, sf_dir).select("line")


def valid_paths(spark, sf_dir):
    """S8 over the work lines, many of which are paths."""
    return table(spark, sf_dir, "work_item_t").select("item_id", validate.valid_path_column(F.col("line")).alias("valid"))


def valid_filenames(spark, sf_dir):
    """S9."""
    return table(spark, sf_dir, "work_item_t").select("item_id", validate.valid_filename_column(F.col("line")).alias("valid"))


def bloom_info(spark, sf_dir):
    """Sizes of the listed filters (a small fixed table)."""
    listed = table(spark, sf_dir, "filter_info").select("entries", "error").distinct().collect()
    got = bloom.info(spark, [bloom_params(r["entries"], r["error"]) for r in listed])
    return got.withColumn("bpe", F.round("bpe", 6))


def capacity_estimates(spark, sf_dir):
    """The capacity chosen for a file of each document's size."""
    capacity = file_capacity_column(F.octet_length("text").cast("bigint"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", capacity.alias("capacity"))


def bloom_positions(spark, sf_dir):
    """H3, H4: positions of each accepted line."""
    at = MD5.positions(F.col("line"), ACCEPTED_FILTER.hashes, ACCEPTED_FILTER.bits)
    return table(spark, sf_dir, "accepted_lines").select("line_id", F.posexplode(at).alias("i", "pos")).select("line_id", F.col("i").cast("bigint").alias("i"), "pos")


def bloom_uniq_lines(spark, sf_dir):
    """A sequential filter, bit by bit, sized for the distinct lines."""
    lines = document_lines(spark, sf_dir)
    return bloom.unique(lines, "line", "ord", sized(lines), MD5)


def bloom_uniq_small_filter(spark, sf_dir):
    """B4 with false positives."""
    return bloom.unique(document_lines(spark, sf_dir), "line", "ord", SMALL, MD5)


def bloom_bits(spark, sf_dir):
    """The filter itself."""
    lines = document_lines(spark, sf_dir)
    return bloom.build(lines, "line", "ord", sized(lines), MD5)


def _probe(spark, sf_dir) -> tuple[DataFrame, DataFrame, BloomParams]:
    lines = document_lines(spark, sf_dir).select("ord", "line", "source")
    main = F.coalesce(F.col("source") == "wiki_main", F.lit(False))
    params = sized(lines.where(main))
    return bloom.build(lines.where(main), "line", "ord", params, MD5), lines.where(~main).select("ord", "line"), params


def bloom_probe(spark, sf_dir):
    """Lines of other sources that the filter of one source knows."""
    model_, rest, params = _probe(spark, sf_dir)
    return bloom.semi(rest, "line", model_, params, MD5)


def bloom_anti(spark, sf_dir):
    """Lines of other sources that the filter doesn't know."""
    model_, rest, params = _probe(spark, sf_dir)
    return bloom.anti(rest, "line", model_, params, MD5)


def bloom_fpr(spark, sf_dir):
    """A3: lines lost by the filter."""
    lines = document_lines(spark, sf_dir)
    return bloom.measured_error(lines, "line", "ord", sized(lines), MD5)


def partitioned_bloom_uniq(spark, sf_dir):
    """Independent filters by bucket."""
    bucket = (F.conv(F.substring(F.md5(F.col("line").cast("binary")), 31, 2), 16, 10).cast("int") % BUCKETS).cast("int")
    lines = document_lines(spark, sf_dir)
    return bloom.partitioned_unique(lines, "line", "ord", sized(lines, parts=BUCKETS), BUCKETS, MD5, bucket)


def cbf_count_est(spark, sf_dir):
    """C4: estimated frequency of event keys, saturating at 15."""
    keys = event_keys(spark, sf_dir)
    return counting.estimates(keys, "key", counting.counters(keys, "key", EVENT_FILTER, MD5), EVENT_FILTER, MD5)


def cbf_prior_count(spark, sf_dir):
    """Count before each row."""
    lines = document_lines(spark, sf_dir)
    return counting.prior_counts(lines, "line", "ord", sized(lines), MD5).select("ord", "prior")


def cbf_insertions(spark, sf_dir):
    """Insertions in all, and those that seemed new."""
    lines = document_lines(spark, sf_dir)
    return counting.insertion_statistics(counting.prior_counts(lines, "line", "ord", sized(lines), MD5))


def cbf_contains(spark, sf_dir):
    """Event keys that a counting filter over all events but errors knows."""
    keys = event_keys(spark, sf_dir)
    known = counting.counters(keys.where("event_type <> 'error'"), "key", EVENT_FILTER, MD5)
    return counting.contains(keys, "key", known, EVENT_FILTER, MD5)


def sliced_counters(spark, sf_dir):
    """Counters of a sliced filter, one slice a hash function."""
    return counting.counters(event_keys(spark, sf_dir), "key", EVENT_SLICES, MD5)


def sliced_after_remove(spark, sf_dir):
    """Event keys that a sliced filter still knows after the error events were removed from it."""
    keys = event_keys(spark, sf_dir)
    plus = counting.counters(keys, "key", EVENT_SLICES, MD5)
    minus = counting.counters(keys.where("event_type = 'error'"), "key", EVENT_SLICES, MD5, sign=-1)
    return counting.contains(keys, "key", counting.merged(plus, minus), EVENT_SLICES, MD5)


def counter_faults(spark, sf_dir):
    """C14: counters beyond 15, and below zero after the error events were removed twice."""
    keys = event_keys(spark, sf_dir)
    plus = counting.counters(keys, "key", EVENT_SLICES, MD5)
    minus = counting.counters(keys.where("event_type = 'error'"), "key", EVENT_SLICES, MD5, sign=-1)
    return counting.faults(counting.merged(plus, minus, minus))


def cbf_after_remove(spark, sf_dir):
    """Estimates after the rows of one event type were removed again."""
    keys = event_keys(spark, sf_dir)
    plus = counting.counters(keys, "key", EVENT_FILTER, MD5)
    minus = counting.counters(keys.where("event_type = 'error'"), "key", EVENT_FILTER, MD5, sign=-1)
    return counting.estimates(keys, "key", counting.merged(plus, minus), EVENT_FILTER, MD5)


def scaling_sizes(spark, sf_dir):
    """Parameters of the first sub-filters of several scaling filters."""
    rows = []
    for capacity, error in SCALING_CASES:
        for level in range(4):
            p = scaling_params(capacity, level_error(error, level))
            rows.append((capacity, error, level, p.hashes, p.per_hash))
    return spark.createDataFrame(rows, "capacity bigint, error double, level int, hashes int, per_hash bigint")


def _scaled(spark, sf_dir) -> scaling.ScalingResult:
    lines = document_lines(spark, sf_dir).select("line", "ord")
    n = lines.select("line").distinct().count()
    return scaling.scaling_unique(lines, "line", "ord", max(LEAST_CAPACITY, n // 2), ERROR, MD5)


def scaling_uniq(spark, sf_dir):
    """A scaling filter with room for half the lines in a sub-filter, and the sub-filter of each line."""
    return _scaled(spark, sf_dir).accepted


def scaling_levels(spark, sf_dir):
    """Lines held by each sub-filter, and the highest order in it."""
    return _scaled(spark, sf_dir).accepted.groupBy("level").agg(F.count("*").alias("lines"), F.max("ord").alias("last_ord"))


def scaling_after_remove(spark, sf_dir):
    """Counters left in each sub-filter after its lines of up to 20 characters were removed by their order."""
    got = _scaled(spark, sf_dir)
    counts = scaling.scaling_counters(got.accepted, "line", got.levels, MD5)
    left = scaling.scaling_remove(counts, got.accepted.where(F.length("line") <= 20).select("line", "ord"), "line", "ord", got.levels, MD5)
    return left.groupBy("level").agg(F.count("*").alias("positions"), F.sum("n").cast("bigint").alias("counters"))


def model_new_lines(spark, sf_dir):
    """A filter of the first half of the accepted lines is saved, loaded and extended by the rest; work lines unknown to it."""
    accepted = table(spark, sf_dir, "accepted_lines").select("line", F.col("line_id").alias("ord"))
    path, top = shared_folder(spark, "model"), accepted.agg(F.max("ord")).first()[0] or 0
    first = accepted.where(F.col("ord") <= top // 2)
    model.save(bloom.build(first, "line", "ord", ACCEPTED_FILTER, MD5), path, ACCEPTED_FILTER, "md5", top // 2)
    model.extend(accepted.where(F.col("ord") > top // 2), "line", "ord", path, top)
    return model.incremental_unique(table(spark, sf_dir, "work_item_t").select("line", "item_id"), "line", "item_id", path)


def file_lines(spark, sf_dir):
    """Accepted lines written to text files and read again, numbered over all files."""
    path = shared_folder(spark, "lines")
    table(spark, sf_dir, "accepted_lines").repartitionByRange(4, "line_id").sortWithinPartitions("line_id").select("line").write.text(path, lineSep="\n")
    return read_lines(spark, path).select("ord", "line", "had_newline")


def murmur_halves(spark, sf_dir):
    """H1, H2: MurmurHash3 against its published answers."""
    keys = spark.createDataFrame([(k,) for k, _, _ in MURMUR_ANSWERS], "key string")
    a, b = Murmur3(0).halves(F.col("key"))
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return keys.select("key", digits(a).alias("first"), digits(b).alias("second"))


def union_uniq(spark, sf_dir):
    """Set union: first occurrences over accepted lines and work lines."""
    a = table(spark, sf_dir, "accepted_lines").select("line", F.col("line_id").alias("ord"))
    b = table(spark, sf_dir, "work_item_t").select("line", (F.col("item_id") + 1_000_000_000_000).alias("ord"))
    return exact.first_occurrences(a.unionByName(b), "line", "ord")


def incremental_new(spark, sf_dir):
    """G11, exact: work lines that aren't among the accepted lines."""
    return exact.new_rows(table(spark, sf_dir, "work_item_t").select("line", "item_id"), table(spark, sf_dir, "accepted_lines"), "line", "item_id")


def approx_distinct(spark, sf_dir):
    """Approximate distinct lines of each source file, by a sketch."""
    return table(spark, sf_dir, "work_item_t").groupBy("src").agg(F.approx_count_distinct("line", 0.02).alias("distinct_lines"))


def stream_uniq(spark, sf_dir):
    """Event keys read as a stream to its end, exactly deduplicated."""
    path = f"{sf_dir}/events.parquet"
    # a pattern, since a stream reads folders and patterns but no single file
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    keys = dedup.unique_stream(events.select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key")), "key")
    out = shared_folder(spark, "stream-uniq")
    keys.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string").parquet(f"{out}/rows")


_NO_QUERIES = ("table", "sized", "read_lines", "file_capacity_column", "document_lines", "event_keys", "queries", "oracle_sql", "shared_folder", "column_lines", "line_key", "bloom_params", "level_error", "scaling_params")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and n not in _NO_QUERIES and n[0] != "_"}


_LINES = """lines as (
    select doc_id, source, line_no, doc_id * 4294967296 + line_no as ord, line from (
        select doc_id, source, unnest(l) as line, unnest(range(1, len(l) + 1)) as line_no
        from (select doc_id, source, string_split(text, chr(10)) as l from documents where text is not null)))"""
_FIRSTS = f"{_LINES}, firsts as (select line, min(ord) as ord from lines group by line)"


def _bits(rows: str, parts: int = 1) -> str:
    """SQL: bits of a filter (of ``parts`` equal ones) for the distinct lines of a relation."""
    bpe = bloom_params(LEAST_CAPACITY, ERROR).bpe
    return f"(select cast(floor(greatest({LEAST_CAPACITY}, (count(distinct line) + {parts - 1}) // {parts}) * {bpe!r}::double) as bigint) from {rows})"


def _positions(rows: str, key: str, hashes: int, bits: int | str, keep: str, sliced: bool = False) -> str:
    """SQL: ``keep`` columns and one ``pos`` per hash function of each row."""
    return f"""(select distinct {keep}, (a % m + i * (b % m)) % m{' + i * m' if sliced else ''} as pos from (
        select {keep}, ('0x' || substr(md5({key}), 1, 15))::bigint as a, ('0x' || substr(md5({key}), 16, 15))::bigint as b, {bits} as m, unnest(range(0, {hashes})) as i from {rows}))"""


_HASHES = bloom_params(LEAST_CAPACITY, ERROR).hashes


def _bloom_unique(hashes: int, bits: int | str) -> str:
    return f"""with {_FIRSTS}, own as (select distinct o from (select pos, min(ord) as o from {_positions('firsts', 'line', hashes, bits, 'ord')} group by pos))
        select line, ord from firsts where ord in (select o from own)"""


def _hits() -> str:
    bits = _bits("main")
    return f"""{_LINES},
        main as (select line, min(ord) as ord from lines where coalesce(source = 'wiki_main', false) group by line),
        rest as (select ord, line from lines where not coalesce(source = 'wiki_main', false)),
        bits as (select distinct pos from {_positions('main', 'line', _HASHES, bits, 'ord')}),
        hit as (select line from {_positions('(select distinct line from rest)', 'line', _HASHES, bits, 'line')} q left join bits on q.pos = bits.pos group by line having count(*) = count(bits.pos))"""


def _event_spots(hashes: int, bits: int, sliced: bool = False) -> str:
    return f"""keys as (select user_id || '|' || event_type as key, event_type from events),
        spots as (select * from {_positions('(select distinct key from keys)', 'key', hashes, bits, 'key', sliced)})"""


def _event_counters(weights: str) -> str:
    return f"c as (select key, sum({weights}) as c from keys group by key), n as (select pos, cast(sum(c) as bigint) as n from spots join c using (key) group by pos)"


def _scaled_sql() -> str:
    """SQL: up to four sub-filters, one after another: ``accepted`` with line, ord and level."""
    steps, rest = [], "firsts"
    for k in range(4):
        e = level_error(ERROR, k)
        hashes = scaling_params(LEAST_CAPACITY, e).hashes
        slots = f"(select cast(ceil(cap * {abs(math.log(e))!r}::double / ({hashes} * {math.log(2) ** 2!r}::double)) as bigint) from size)"
        steps.append(f"""own{k} as materialized (select pos, min(ord) as o from {_positions(rest, 'line', hashes, slots, 'ord', True)} group by pos),
            new{k} as materialized (select line, ord, row_number() over (order by ord) as r from {rest} where ord in (select o from own{k})),
            last{k} as materialized (select case when count(*) >= cap - 1 then max(case when r = cap - 1 then ord end) else 9223372036854775807 end as t from new{k}, size group by cap union all select 9223372036854775807 where not exists (select 1 from new{k})),
            later{k} as materialized (select line, ord from {rest} where ord > (select t from last{k})),
            seen{k} as materialized (select ord from {_positions(f'later{k}', 'line', hashes, slots, 'ord', True)} q left join (select pos from own{k} where o <= (select t from last{k})) f using (pos) group by ord having count(*) = count(f.pos)),
            rest{k} as materialized (select line, ord from later{k} where ord not in (select ord from seen{k}))""")
        rest = f"rest{k}"
    taken = " union all ".join(f"select line, ord, {k}::int as level from new{k} where ord <= (select t from last{k})" for k in range(4))
    return f"with {_FIRSTS}, size as (select greatest({LEAST_CAPACITY}, count(*) // 2) as cap from firsts), {', '.join(steps)}, accepted as materialized ({taken})"


def _scaled_counters() -> str:
    parts = []
    for k in range(4):
        e = level_error(ERROR, k)
        hashes = scaling_params(LEAST_CAPACITY, e).hashes
        slots = f"(select cast(ceil(cap * {abs(math.log(e))!r}::double / ({hashes} * {math.log(2) ** 2!r}::double)) as bigint) from size)"
        parts.append(f"select {k}::int as level, pos, count(*) as n from {_positions(f'(select * from accepted where level = {k} and length(line) > 20)', 'line', hashes, slots, 'ord', True)} group by pos")
    return f"{_scaled_sql()} select level, count(*) as positions, cast(sum(n) as bigint) as counters from ({' union all '.join(parts)}) group by level"


def _estimates(weights: str) -> str:
    return f"with {_event_spots(EVENT_FILTER.hashes, EVENT_FILTER.bits)}, {_event_counters(weights)} select key, cast(least(min(greatest(n, 0)), 15) as int) as estimate from spots join n using (pos) group by key"


def _priors() -> str:
    return f"""with {_LINES}, spots as (select ord, pos, row_number() over (partition by pos order by ord) - 1 as n from {_positions('lines', 'line', _HASHES, _bits('lines'), 'ord')}),
        priors as (select ord, cast(least(min(n), 15) as int) as prior from spots group by ord)"""


def oracle_sql() -> dict[str, str]:
    ok_path = "strlen(line) > 0 and strlen(line) < 4096 and line <> '..' and regexp_full_match(line, '[ -~]*') and not contains(line, '../') and not contains(line, '/..') and not contains(line, '//')"
    bad = " and ".join(f"not contains(line, '{c}')" for c in validate.BAD_IN_NAME)
    ok_name = f"strlen(line) > 0 and strlen(line) < 255 and not starts_with(line, '.') and upper(line) not in ('CON', 'PRN', 'AUX', 'NUL') and {bad}"
    calm, twice = ("case when event_type = 'error' then 0 else 1 end", "case when event_type = 'error' then -1 else 1 end")
    cases = ", ".join(f"({c}, {e!r}::double)" for c, e in SCALING_CASES)
    return {
        "uniq_lines": f"with {_FIRSTS} select line, ord from firsts",
        "uniq_docs": "select doc_id, lang from documents where doc_id in (select min(doc_id) from documents group by text)",
        "uniq_work_lines": "select line, min(item_id) as item_id from work_item_t group by line",
        "dup_lines": f"with {_FIRSTS} select ord, line from lines where ord not in (select ord from firsts)",
        "dup_groups": f"with {_LINES} select line, count(*) as cnt, min(ord) as ord from lines group by line having count(*) > 1",
        "once_lines": f"with {_LINES} select line, min(ord) as ord from lines group by line having count(*) = 1",
        "line_counts": f"with {_LINES} select line, count(*) as cnt, min(ord) as ord from lines group by line",
        "work_line_totals": "select line, cast(sum(coalesce(cnt, 1)) as bigint) as cnt, min(item_id) as item_id from work_item_t group by line",
        "top_dups": f"with {_LINES} select line, count(*) as cnt, min(ord) as ord from lines group by line order by cnt desc, line nulls first limit 100",
        "result_flags": f"with {_FIRSTS} select ord, cast(ord in (select ord from firsts) as int) as cnt from lines",
        "strict_line_counts": "select key, count(*) as cnt, min(item_id) as first_item from (select item_id, line || case when coalesce(had_newline, true) then chr(10) else '' end as key from work_item_t) group by key",
        "dedup_stats": f"with {_LINES} select count(*) as total_lines, count(distinct line) as unique_lines, count(*) - count(distinct line) as duplicate_lines from lines",
        "dedup_stats_by_lang": "select lang, cast(sum(c) as bigint) as total_lines, count(*) as unique_lines, cast(sum(c) - count(*) as bigint) as duplicate_lines from (select lang, text, count(*) as c from documents group by lang, text) group by lang",
        "run_rates": "select run_id, round(case when processing_time > 0 then total_lines / processing_time else 0 end, 3) as throughput, round(case when total_lines > 0 then duplicate_lines / total_lines else 0 end, 6) as duplicate_share from run_statistics",
        "truncated_lines": f"select item_id, lower(hex(encode(line)[1:{PREFIX}])) as prefix from work_item_t where strlen(line) > {PREFIX}",
        "truncated_uniq": "select prefix, count(*) as cnt, min(item_id) as item_id from (select item_id, lower(hex(encode(line)[1:64])) as prefix from work_item_t) group by prefix",
        "json_escape": r"""select item_id, replace(replace(replace(replace(replace(line, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') as escaped from work_item_t""",
        "csv_escape": """select doc_id, '"' || replace(replace(text, '"', '""'), chr(10), ' ') || '"' as quoted from documents""",
        "tsv_text": "select distinct line from work_item_t",
        "valid_paths": f"select item_id, coalesce({ok_path}, false) as valid from work_item_t",
        "valid_filenames": f"select item_id, coalesce({ok_name}, false) as valid from work_item_t",
        "bloom_info": """select entries, error, cast(floor(entries * e) as bigint) as bits, round(e, 6) as bpe, cast(ceil(floor(entries * e) / 8) as bigint) as bytes, cast(ceil(ln(2) * e) as int) as hashes
            from (select distinct entries, error, -ln(error) / (ln(2) * ln(2)) as e from filter_info)""",
        "capacity_estimates": "select doc_id, cast(greatest(1000, least(10000000, strlen(text) // 20 * 3 // 2)) as bigint) as capacity from documents where text is not null",
        "bloom_positions": f"""select line_id, i, (a % {ACCEPTED_FILTER.bits} + i * (b % {ACCEPTED_FILTER.bits})) % {ACCEPTED_FILTER.bits} as pos from (
            select line_id, unnest(range(0, {ACCEPTED_FILTER.hashes})) as i, ('0x' || substr(md5(line), 1, 15))::bigint as a, ('0x' || substr(md5(line), 16, 15))::bigint as b from accepted_lines)""",
        "bloom_uniq_lines": _bloom_unique(_HASHES, _bits("firsts")),
        "bloom_uniq_small_filter": _bloom_unique(SMALL.hashes, SMALL.bits),
        "bloom_bits": f"with {_FIRSTS} select pos, min(ord) as min_order from {_positions('firsts', 'line', _HASHES, _bits("firsts"), 'ord')} group by pos",
        "bloom_probe": f"with {_hits()} select ord, line from rest where line in (select line from hit)",
        "bloom_anti": f"with {_hits()} select ord, line from rest where line not in (select line from hit)",
        "bloom_fpr": f"with {_FIRSTS}, own as (select distinct o from (select pos, min(ord) as o from {_positions('firsts', 'line', _HASHES, _bits("firsts"), 'ord')} group by pos)) select count(*) as distinct_lines, count(o) as emitted_lines, count(*) - count(o) as lost_lines from firsts left join own on ord = o",
        "partitioned_bloom_uniq": f"""with {_FIRSTS}, own as (select distinct o from (select bucket, pos, min(ord) as o from {_positions('(select ord, line, (' + "'0x' || substr(md5(line), 31, 2))::int % " + str(BUCKETS) + ' as bucket from firsts)', 'line', _HASHES, _bits("firsts", BUCKETS), 'ord, bucket')} group by bucket, pos))
            select line, ord from firsts where ord in (select o from own)""",
        "cbf_count_est": _estimates("1"),
        "cbf_prior_count": f"{_priors()} select ord, prior from priors",
        "cbf_insertions": f"{_priors()} select count(*) as total_insertions, count_if(prior = 0)::bigint as unique_insertions from priors",
        "cbf_after_remove": _estimates("case when event_type = 'error' then 0 else 1 end"),
        "scaling_sizes": f"""select capacity::bigint as capacity, error, level::int as level, hashes::int as hashes, cast(ceil(capacity * abs(ln(e)) / (hashes * ln(2) * ln(2))) as bigint) as per_hash from (
            select capacity, error, level, e, cast(ceil(log2(1 / e)) as bigint) as hashes from (
                select capacity, error, level, error * pow(0.5, level + 1) as e from (values {cases}) t(capacity, error), (values (0), (1), (2), (3)) v(level)))""",
        "cbf_contains": f"with {_event_spots(EVENT_FILTER.hashes, EVENT_FILTER.bits)}, {_event_counters(calm)} select key from spots join n using (pos) group by key having min(n) > 0",
        "sliced_counters": f"with {_event_spots(EVENT_SLICES.hashes, EVENT_SLICES.per_hash, True)}, {_event_counters('1')} select pos, n from n",
        "sliced_after_remove": f"with {_event_spots(EVENT_SLICES.hashes, EVENT_SLICES.per_hash, True)}, {_event_counters(calm)} select key from spots join n using (pos) group by key having min(n) > 0",
        "counter_faults": f"with {_event_spots(EVENT_SLICES.hashes, EVENT_SLICES.per_hash, True)}, {_event_counters(twice)} select count_if(n > 15)::bigint as overflows, count_if(n < 0)::bigint as underflows from n",
        "scaling_uniq": f"{_scaled_sql()} select * from accepted",
        "scaling_levels": f"{_scaled_sql()} select level, count(*) as lines, max(ord) as last_ord from accepted group by level",
        "scaling_after_remove": _scaled_counters(),
        "model_new_lines": f"""with known as (select distinct pos from {_positions('accepted_lines', 'line', ACCEPTED_FILTER.hashes, ACCEPTED_FILTER.bits, 'line_id')}),
            firsts as (select line, min(item_id) as item_id from work_item_t group by line),
            hit as (select item_id from {_positions("(select coalesce(line, chr(0) || 'null') as k, item_id from firsts)", 'k', ACCEPTED_FILTER.hashes, ACCEPTED_FILTER.bits, 'item_id')} q left join known using (pos) group by item_id having count(*) = count(known.pos))
            select line, item_id from firsts where item_id not in (select item_id from hit)""",
        "file_lines": "select row_number() over (order by line_id) as ord, line, true as had_newline from accepted_lines",
        "murmur_halves": "select * from (values " + ", ".join(f"('{k}', '{a}', '{b}')" for k, a, b in MURMUR_ANSWERS) + ") t(key, first, second)",
        "union_uniq": "select line, min(ord) as ord from (select line, line_id as ord from accepted_lines union all select line, item_id + 1000000000000 from work_item_t) group by line",
        "incremental_new": "select line, min(item_id) as item_id from work_item_t where line is null or line not in (select line from accepted_lines) group by line",
        "stream_uniq": "select distinct user_id || '|' || event_type as key from events",
    }
