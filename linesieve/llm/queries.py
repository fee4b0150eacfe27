"""The queries of this subpackage: each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import heavy_hitters as hh
from . import encoding, key_filter, mixing, packing, toxicity
from .common import shared_folder
from .history import LineHistory
from .key_filter import HISTORY
from .term_counts import term_statistics
from .tokens import with_sizes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled(_table(spark, sf_dir, "work_item_t")).select(F.col("id").alias("item_id"))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.repaired(_table(spark, sf_dir, "work_item_t")).withColumnRenamed("id", "item_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = term_statistics(_table(spark, sf_dir, "work_item_t"), max_terms=1)
    return terms.where("mark is not null").select("term", "mark")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_statistics(_table(spark, sf_dir, "work_item_t"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = key_filter.seen_before(_table(spark, sf_dir, "work_item_t"), _table(spark, sf_dir, "accepted_lines"))
    return seen.where("seen").select(F.col("id").alias("item_id"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_filter.answer_rates(_table(spark, sf_dir, "work_item_t"), _table(spark, sf_dir, "accepted_lines"))


def p3_rates_8bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with fingerprints of 8 bits, which do answer wrongly now and then."""
    return key_filter.answer_rates(_table(spark, sf_dir, "work_item_t"), _table(spark, sf_dir, "accepted_lines"), bits=8)


def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted lines are ingested first, then one batch after another; each batch meets only what is stored."""
    history = LineHistory(spark, shared_folder(spark, "line-history"))
    history.accept(_table(spark, sf_dir, "accepted_lines"), "accepted", id_col="line_id", batch=HISTORY)
    parts = history.accept_batches(_table(spark, sf_dir, "work_item_t"))
    return history.verdicts(parts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeats(spark, sf_dir).where("exact or near").select(F.col("id").alias("item_id"))


def p4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeats(spark, sf_dir).select(F.col("id").alias("item_id"), "exact", "near")


#: p5: a line is heavy from this share of the grand total on.
HEAVY_SHARE = 1 / 400


def _heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "work_item_t")
    lone = F.when(F.col("src").isNull() | F.col("ord").isNull(), F.col("item_id"))
    return hh.heavy_hitters(items.withColumn("_lone", lone), "line", "cnt", ["src", "ord", "_lone"], share=HEAVY_SHARE)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heavy(spark, sf_dir).select("line")


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heavy(spark, sf_dir).select("line", "total", F.round("estimate").cast("long").alias("estimate"), "grand_total")


def _sizes(spark: SparkSession, sf_dir: str, **keep: str) -> DataFrame:
    return with_sizes(_table(spark, sf_dir, "documents"), keep=keep)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir), _table(spark, sf_dir, "containers"))


def p6_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)


def p6_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.unused(_placed(spark, sf_dir), _table(spark, sf_dir, "containers"))


#: p7: how far the share of a source may be from its target, so that a rare source doesn't decide the size of the mixture.
MIX_TOLERANCE = 0.03


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf_dir, source="source"), _table(spark, sf_dir, "mix_targets"), tolerance=MIX_TOLERANCE)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_mixed(spark, sf_dir), _table(spark, sf_dir, "mix_targets"))


def p7_tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total that each tolerance allows."""
    return mixing.tradeoff(_sizes(spark, sf_dir, source="source"), _table(spark, sf_dir, "mix_targets"), (0.0, 0.0025, 0.005, 0.01, 0.02, 0.05, 0.1, 1.0))


def _scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "review_labels"))
    return toxicity.scored(docs, model, keep={"source": "source"}), model.threshold


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, threshold = _scores(spark, sf_dir)
    return scores.where(F.col("score") >= threshold).select(F.col("id").alias("doc_id"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rates(*_scores(spark, sf_dir))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)[0].select(F.col("id").alias("doc_id"), "source", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name[:1] == "p" and name[1:2].isdigit() and callable(f)}


_ONCE = "select src, ord, any_value(line) as line, any_value(cnt) as cnt from work_item_t group by src, ord"


def oracle_sql() -> dict[str, str]:
    terms = f"""
            once as ({_ONCE}),
            lists as (select row_number() over () as r, coalesce(cnt, 1) as w, list_filter(string_split(line, ' '), lambda x: x <> '') as t from once where line is not null),
            places as (select r, w, t, unnest(range(1, len(t) + 1)) as i from lists)"""
    mark = "case when records < 3 then 'rare' when records > 0.01 * (select count(*) from once) then 'common' end"
    return {
        "p2_found": f"""
            with {terms}, counts as (select t[i] as term, count(distinct r) as records from places group by 1)
            select * from (select term, {mark} as mark from counts) where mark is not null""",
        "p2_terms": f"""
            with {terms},
            phrases as (select r, w, t[i] as term, 1 as n_terms from places union all select r, w, t[i] || ' ' || t[i + 1], 2 from places where i < len(t)),
            counts as (select term, cast(n_terms as int) as n_terms, cast(sum(w) as bigint) as occurrences, count(distinct r) as records from phrases group by 1, 2)
            select *, {mark} as mark from counts""",
        "p3_found": """
            select w.item_id from work_item_t w
            join (select line, min(item_id) as first_id from work_item_t where line is not null group by line) f on w.line = f.line
            where w.item_id > f.first_id or w.line in (select line from accepted_lines)""",
        "p5_found": f"""
            with once as (select line, coalesce(cnt, 1) as w from ({_ONCE}) where line is not null)
            select line from once group by line having sum(w) * 400 >= (select sum(w) from once)""",
    }
