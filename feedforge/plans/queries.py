"""Registered queries over the logical tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedforge.functions import lists as L
from feedforge.functions import scalars as S
from feedforge.functions import text as X
from feedforge.operators import ann, bm25, bootstrap, diversity, doc_vectors, evaluate, features, history, labelling, popularity, ranking, sampling, split, validate, vectors
from feedforge.operators import describe as D
from feedforge.plans import runner
from feedforge.plans import tables as T
from feedforge.streaming.popularity import windowed_popularity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with {T.SQL}\n{sql.strip()}" if views and not sql.lstrip().lower().startswith("with") else (f"with {T.SQL}, {sql.strip()[5:]}" if views else sql.strip())
        return f

    return register


def r6(c: str | F.Column, name: str | None = None) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6).alias(name or c)


DAYS = "(select max(t) as m from impressions)"
SPLIT = f"""with d as (select i.*, m from impressions i, {DAYS}),
sp as (select *, case when t >= m - interval 180 day then 'test' when t >= m - interval 360 day then 'val' else 'train' end as split from d)
"""


def _split(spark: SparkSession, d: str) -> DataFrame:
    return split.temporal_split(T.impressions(spark, d), "t", 180, 180)


# --- splits and popularity


@query(
    SPLIT
    + """, e as (select unnest(inview) as item, unnest(labels) as label from sp where split = 'train'),
st as (select item, count(*) as n_inviews, nullif(sum(label), 0)::bigint as n_clicks from e group by item)
select p_partkey as item, n_inviews, n_clicks from part left join st on item = p_partkey"""
)
def popularity_train(spark: SparkSession, d: str) -> DataFrame:
    return popularity.train_popularity(T.articles(spark, d), _split(spark, d), "item").select("item", "n_inviews", "n_clicks")


@query(SPLIT + "select count(*) filter (split = 'train') as n_train, count(*) filter (split = 'val') as n_val, count(*) filter (split = 'test') as n_test from sp")
def temporal_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return split.split_counts(_split(spark, d))


@query(
    """with g as (select row_id, count(*) over (order by t) - 1 as g, count(*) over () as n from impressions)
select row_id, case when g / n < 0.8 then 'train' when g / n < 0.8 + 0.1 then 'val' else 'test' end as split from g"""
)
def temporal_split_fallback(spark: SparkSession, d: str) -> DataFrame:
    return split.temporal_split(T.impressions(spark, d), "t", 0, 2).select("row_id", "split")


@query("select row_id, row_number() over (order by t, row_id) - 1 as row_index from impressions")
def row_index(spark: SparkSession, d: str) -> DataFrame:
    return split.with_row_index(T.impressions(spark, d), "t", "row_id").select("row_id", "row_index")


@query(
    SPLIT
    + """, e as (select unnest(inview) as item from sp where split = 'train'), st as (select item, count(*) as n from e group by item),
a as (select p_partkey as item, coalesce(n, 0) + 1.0 as pop from part left join st on item = p_partkey)
select item, round((pop / sum(pop) over ())::double, 9) as p from a"""
)
def popularity_smoothed(spark: SparkSession, d: str) -> DataFrame:
    pop = popularity.train_popularity(T.articles(spark, d), _split(spark, d), "item")
    return popularity.smoothed_popularity(pop).select("item", F.round("p", 9).alias("p"))


@query("select item, round((count(*) / (select count(*) from impressions))::double, 9) as popularity from (select unnest(inview) as item from impressions) group by item")
def item_popularity(spark: SparkSession, d: str) -> DataFrame:
    return popularity.item_popularity(T.impressions(spark, d), "inview").select("item", F.round("popularity", 9).alias("popularity"))


@query(
    """select value, n, round(n / sum(n) over (), 6) as share, round(sum(n) over (order by n desc, value rows unbounded preceding) / sum(n) over (), 6) as cumulative_share
from (select p_type as value, count(*) as n from part group by 1)"""
)
def value_counts_cumshare(spark: SparkSession, d: str) -> DataFrame:
    return popularity.value_shares(T.articles(spark, d), "category").select("value", "n", r6("share"), r6("cumulative_share"))


@query("select value, round(sum(w), 6) as weight from (select unnest(inview) as value, 1.0::double / len(inview) as w from impressions) group by value")
def distribution_items(spark: SparkSession, d: str) -> DataFrame:
    return popularity.weighted_distribution(T.impressions(spark, d), "inview").select("value", r6("weight"))


@query("select item, round((1 / row_number() over (order by p_retailprice desc, item))::double, 9) as score from (select p_partkey as item, p_retailprice from part)")
def sort_based_score(spark: SparkSession, d: str) -> DataFrame:
    parts = T.read(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_retailprice")
    return popularity.sort_based_score(parts, "p_retailprice", "item").select("item", F.round("score", 9).alias("score"))


# --- lists and labels


@query(
    """with c as (select *, list_filter(list_zip(inview, labels), lambda z: z[2] = 1) as z from impressions)
select row_id, i - 1 as pos, (list_contains(list_transform(z, lambda x: x[1]), inview[i]))::int as label from (select *, unnest(range(1, len(inview) + 1)) as i from c)"""
)
def labels_exploded(spark: SparkSession, d: str) -> DataFrame:
    imp = T.impressions(spark, d).withColumn("clicked", L.clicked_of(F.col("inview"), F.col("labels")))
    made = imp.select("row_id", F.posexplode(L.binary_labels(F.col("inview"), F.col("clicked"))).alias("pos", "label"))
    return made.withColumn("pos", F.col("pos").cast("long"))


@query("select row_id, coalesce(array_to_string(list_transform(list_filter(list_zip(inview, labels), lambda z: z[2] = 1), lambda z: z[1]), ','), '') as clicked from impressions")
def gt_clicked(spark: SparkSession, d: str) -> DataFrame:
    return T.impressions(spark, d).select("row_id", F.array_join(L.clicked_of(F.col("inview"), F.col("labels")), ",").alias("clicked"))


CLICKED = "with c as (select *, list_transform(list_filter(list_zip(inview, labels), lambda z: z[2] = 1), lambda z: z[1]) as clicked from impressions)\n"


def _clicked(spark: SparkSession, d: str) -> DataFrame:
    return T.impressions(spark, d).withColumn("clicked", L.clicked_of(F.col("inview"), F.col("labels")))


@query(CLICKED + "select row_id, array_to_string(list_filter(inview, lambda x: not list_contains(clicked, x)), ',') as negatives from c")
def negatives_only(spark: SparkSession, d: str) -> DataFrame:
    return _clicked(spark, d).select("row_id", F.array_join(L.without(F.col("inview"), F.col("clicked")), ",").alias("negatives"))


@query(CLICKED + "select row_id, len(inview)::int as n from c where len(inview) - len(clicked) >= 2")
def inview_min_negatives(spark: SparkSession, d: str) -> DataFrame:
    return labelling.filter_min_negatives(_clicked(spark, d), 2).select("row_id", F.size("inview").alias("n"))


@query("select row_id from impressions where len(inview) >= 3 and len(inview) <= 5")
def inview_length_bounds(spark: SparkSession, d: str) -> DataFrame:
    return labelling.filter_max_length(labelling.filter_min_length(T.impressions(spark, d), "inview", 3), "inview", 5).select("row_id")


@query("with k as (select row_id, list_filter(inview, lambda x: x >= 1 and x <= 50) as l from impressions) select row_id, case when len(l) > 0 then array_to_string(l, ',') end as kept from k")
def filter_list_elements(spark: SparkSession, d: str) -> DataFrame:
    allowed = F.sequence(F.lit(1).cast("long"), F.lit(50).cast("long"))
    return T.impressions(spark, d).select("row_id", F.array_join(L.keep_listed(F.col("inview"), allowed), ",").alias("kept"))


@query("select p_partkey as item, case when p_type in ('STANDARD', 'SMALL') then p_type end as category from part", views=False)
def filter_scalar_elements(spark: SparkSession, d: str) -> DataFrame:
    return T.articles(spark, d).select("item", L.keep_scalar(F.col("category"), ["STANDARD", "SMALL"]).alias("category"))


@query("select row_id, array_to_string(list_concat(list_transform(range(greatest(3 - len(inview), 0)), lambda x: 0), inview[-3:]), ',') as padded, array_to_string(inview[-3:], ',') as last from impressions")
def history_truncate_pad(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("inview")
    return T.impressions(spark, d).select("row_id", F.array_join(L.pad_left(c, 3, F.lit(0).cast("long")), ",").alias("padded"), F.array_join(L.tail(c, 3), ",").alias("last"))


@query("select row_id, len(list_distinct(inview))::int as n from impressions")
def distinct_lists(spark: SparkSession, d: str) -> DataFrame:
    return T.impressions(spark, d).select("row_id", F.size(F.array_distinct("inview")).alias("n"))


@query("select row_id, i as chunk, array_to_string(inview[i * 2 + 1 : i * 2 + 2], ',') as items from (select row_id, inview, unnest(range(0, ((len(inview) + 1) // 2)::bigint)) as i from impressions)")
def list_chunks(spark: SparkSession, d: str) -> DataFrame:
    each = T.impressions(spark, d).select("row_id", F.posexplode(L.chunks(F.col("inview"), 2)).alias("chunk", "c"))
    return each.select("row_id", F.col("chunk").cast("long").alias("chunk"), F.array_join("c", ",").alias("items"))


@query("select row_id, i - 1 as pos, round(i / len(inview), 6) as linear, round((len(inview) - i + 1) / len(inview), 6) as reversed from (select *, unnest(range(1, len(inview) + 1)) as i from impressions)")
def decay_linear(spark: SparkSession, d: str) -> DataFrame:
    z = F.arrays_zip(L.linear_decay(F.col("inview")).alias("linear"), L.linear_decay(F.col("inview"), False).alias("reversed"))
    return T.impressions(spark, d).select("row_id", F.posexplode(z).alias("pos", "z")).select("row_id", F.col("pos").cast("long").alias("pos"), r6(F.col("z")["linear"], "linear"), r6(F.col("z")["reversed"], "reversed"))


@query("select row_id, i - 1 as pos, round(pow(0.5::double, len(inview) - i), 6) as weight from (select *, unnest(range(1, len(inview) + 1)) as i from impressions)")
def decay_exponential(spark: SparkSession, d: str) -> DataFrame:
    each = T.impressions(spark, d).select("row_id", F.posexplode(L.exponential_decay(F.col("inview"))).alias("pos", "weight"))
    return each.select("row_id", F.col("pos").cast("long").alias("pos"), r6("weight"))


@query(
    """with v as (select vec_id, embedding as e, range(1, len(embedding) + 1) as w from embeddings)
select vec_id, round(list_sum(list_transform(list_zip(e, w), lambda z: z[1]::double * (z[2] / len(e)::double))), 5) as total from v""",
    views=False,
)
def decay_weighted_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = F.transform("embedding", lambda x: F.array(x.cast("double")))
    scaled = L.scale_nested(e, L.linear_decay(e))
    return T.read(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(F.flatten(scaled), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("select row_id, pos, row_number() over (partition by row_id order by score desc, pos desc)::int as rank from shown")
def rank_by_score(spark: SparkSession, d: str) -> DataFrame:
    s = T.shown(spark, d).groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "score"))), lambda x: x["score"]).alias("s"))
    return s.select("row_id", F.posexplode(L.rank_by_score(F.col("s"))).alias("pos", "rank")).withColumn("pos", F.col("pos").cast("long"))


@query("select p_partkey as item, p_name || ' ' || p_brand as text from part", views=False)
def concat_columns(spark: SparkSession, d: str) -> DataFrame:
    return T.articles(spark, d).select("item", L.concat_columns(F.col("title"), F.col("subcategory")).alias("text"))


@query("select row_id, array_to_string(list_transform(list_sort(list_transform(list_zip(inview, range(len(inview))), lambda z: [md5('7|' || row_id || '|' || z[2]), z[1]::varchar])), lambda z: z[2]), ',') as items from impressions")
def shuffled_lists(spark: SparkSession, d: str) -> DataFrame:
    return T.impressions(spark, d).select("row_id", F.array_join(L.shuffled(F.col("inview"), F.lit(7), F.col("row_id")), ",").alias("items"))


@query(
    """with e as (select row_id, generate_subscripts(inview, 1) as pos, unnest(inview) as item from impressions)
select row_id, string_agg(coalesce(p_type, 'none'), ',' order by pos) as categories from e left join part on p_partkey = item group by row_id"""
)
def map_list_ids(spark: SparkSession, d: str) -> DataFrame:
    return labelling.map_list_ids(T.impressions(spark, d), "row_id", "inview", T.articles(spark, d), "item", "category", F.lit("none")).select("row_id", F.array_join("inview", ",").alias("categories"))


@query("select row_id, string_agg(score::int::varchar, ',' order by pos) as scores from shown group by row_id")
def attach_scores(spark: SparkSession, d: str) -> DataFrame:
    s = T.shown(spark, d)
    rows = s.select("row_id").distinct()
    return labelling.attach_scores(rows, s, "row_id").select("row_id", F.array_join(F.transform("scores", lambda x: x.cast("int").cast("string")), ",").alias("scores"))


# --- joins, keys and deduplication


@query("select o_custkey as user_id, min(o_orderkey) as row_id from orders join (select o_custkey as c, min(o_orderdate) as m from orders group by 1) on c = o_custkey and m = o_orderdate group by 1", views=False)
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    o = T.read(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("row_id"), "o_orderdate")
    return labelling.dedup_first(o, "user_id", "o_orderdate", "row_id").select("user_id", "row_id")


@query("select c_nationkey as key, count(distinct c_mktsegment) as n from customer group by 1 having count(distinct c_mktsegment) > 1", views=False)
def conflicting_keys(spark: SparkSession, d: str) -> DataFrame:
    return labelling.conflicting_keys(T.read(spark, d, "customer"), "c_nationkey", "c_mktsegment").select(F.col("c_nationkey").alias("key"), "n")


@query("select o_orderkey as row_id, c_custkey is not null as is_known_user from orders left join (select * from customer where c_acctbal > 0) on c_custkey = o_custkey", views=False)
def known_users(spark: SparkSession, d: str) -> DataFrame:
    known = T.read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    o = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("user_id"))
    return labelling.known_users(o, known).select("row_id", "is_known_user")


@query("select o_custkey as user_id, dense_rank() over (order by o_custkey) - 1 as ix from (select distinct o_custkey from orders)", views=False)
def user_int_mapping(spark: SparkSession, d: str) -> DataFrame:
    return labelling.id_index(T.read(spark, d, "orders").select(F.col("o_custkey").alias("user_id")), "user_id")


@query("select distinct id from (select unnest(inview) as id from impressions union all select user_id from impressions) where id is not null")
def unique_ids_union(spark: SparkSession, d: str) -> DataFrame:
    return labelling.unique_ids(T.impressions(spark, d), "inview", "user_id")


@query(
    """select 0::bigint as ix, null::bigint as item, 0.0::double as first, 0.0::double as last union all
select row_number() over (order by vec_id), vec_id, round(embedding[1]::double, 6), round(embedding[64]::double, 6) from embeddings""",
    views=False,
)
def lookup_with_unknown(spark: SparkSession, d: str) -> DataFrame:
    made = labelling.lookup_with_unknown(T.vectors(spark, d), "item", "vector")
    return made.select("ix", "item", r6(F.element_at("vector", 1), "first"), r6(F.element_at("vector", -1), "last"))


# --- histories


@query(
    """with e as (select event_id, user_id, ts, case when event_type in ('click', 'view') then event_id end as item from events)
select event_id, coalesce(array_to_string(list_filter(list(item) over (partition by user_id order by ts, event_id rows between 5 preceding and 1 preceding), lambda x: x is not null), ','), '') as history from e""",
    views=False,
)
def history_dynamic(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").withColumn("item", F.when(F.col("event_type").isin("click", "view"), F.col("event_id")))
    return history.dynamic_history(e, 5, "user_id", "item", "ts", "event_id").select("event_id", F.array_join("history", ",").alias("history"))


@query(
    """with e as (select user_id, ts, event_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events, (select min(ts) + (max(ts) - min(ts)) / 2 as mid from events) where ts < mid)
select user_id, string_agg(event_id::varchar, ',' order by ts, event_id) as events_fixed, count(*) as n from e where rn <= 3 group by user_id""",
    views=False,
)
def history_fixed(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    mid = e.agg(((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2).alias("m")).first()["m"]
    kept = history.fixed_history(e.withColumn("us", F.unix_micros("ts").cast("double")), mid, 3, "user_id", "us", "event_id", "value")
    return kept.select("user_id", F.array_join("event_id_fixed", ",").alias("events_fixed"), F.size("value_fixed").cast("long").alias("n"))


ASOF = """with a as (select i.row_id, c.item, i.t, c.click_time, row_number() over (partition by i.row_id order by click_time desc, seq desc) as rn
from impressions i join clicks c on c.user_id = i.user_id and c.click_time < i.t),
h as (select *, count(*) over (partition by row_id) - rn as pos from a where rn <= 5)
"""


def _asof(spark: SparkSession, d: str) -> DataFrame:
    imp = T.impressions(spark, d).withColumnRenamed("t", "impression_time")
    return history.as_of_history(imp, T.clicks(spark, d), 5, row="row_id", item="item")


def _asof_lists(spark: SparkSession, d: str) -> DataFrame:
    imp = T.impressions(spark, d).withColumnRenamed("t", "impression_time")
    return history.as_of_lists(imp, T.clicks(spark, d), 5, row="row_id", item="item")


@query(ASOF + "select row_id, item, pos, (epoch_us(t) - epoch_us(click_time)) / 1000000.0::double as recency from h")
def history_asof_lastn(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d).select("row_id", "item", "pos", "recency")


@query(ASOF + "select row_id, coalesce(l, '') as history from impressions left join (select row_id, string_agg(item::varchar, ',' order by pos) as l from h group by row_id) using (row_id)")
def history_lists(spark: SparkSession, d: str) -> DataFrame:
    return history.with_lists(T.impressions(spark, d), _asof_lists(spark, d), "row_id").select("row_id", F.array_join("history", ",").alias("history"))


@query("select user_id, row_id as impression_id, unnest(inview)::varchar as article_id, null::double as recency from impressions")
def long_history(spark: SparkSession, d: str) -> DataFrame:
    imp = T.impressions(spark, d).select("user_id", F.col("row_id").alias("impression_id"), F.col("t").alias("impression_time"), F.col("inview").cast("array<string>").alias("history"))
    return history.long_history(imp).select("user_id", "impression_id", "article_id", "recency")


# --- rankings and metrics


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_inview(T.shown(spark, d).select("row_id", "pos", "item", "label"), T.candidates(spark, d))


@query("select row_id, pos, round(score, 6) as score, rank::int as rank, retrieved from ranked")
def inview_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("row_id", "pos", r6("score"), "rank", "retrieved")


@query(
    """with t as (select row_id, label, rank() over (partition by row_id order by score) + (count(*) over (partition by row_id, score) - 1) / 2 as tr from ranked),
s as (select row_id, sum(tr) filter (label = 1) as r, sum(label) as p, count(*) - sum(label) as n from t group by row_id)
select row_id, round((r - p * (p + 1) / 2) / nullif(p * n, 0), 6)::double as auc from s"""
)
def auc_tied(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.accuracy(_ranked(spark, d)).select("row_id", r6("auc"))


@query("select row_id, round(1 / min(rank) filter (label = 1), 6)::double as mrr from ranked group by row_id")
def mrr_first(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.accuracy(_ranked(spark, d)).select("row_id", r6("mrr"))


@query(
    """with x as (select row_id, sum(case when label = 1 and rank <= 5 then 1 / log2(rank + 1) else 0 end) as d5, sum(case when label = 1 and rank <= 10 then 1 / log2(rank + 1) else 0 end) as d10, sum(label) as p from ranked group by row_id)
select row_id, case when p > 0 then round(d5 / list_sum(list_transform(range(1, least(p, 5)::bigint + 1), lambda i: 1 / log2(i + 1))), 6) end as ndcg_5,
case when p > 0 then round(d10 / list_sum(list_transform(range(1, least(p, 10)::bigint + 1), lambda i: 1 / log2(i + 1))), 6) end as ndcg_10 from x"""
)
def ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.accuracy(_ranked(spark, d)).select("row_id", r6("ndcg_5"), r6("ndcg_10"))


@query(
    """with t as (select *, row_number() over (partition by row_id order by p desc, pos desc) as rank, rank() over (partition by row_id order by p) + (count(*) over (partition by row_id, p) - 1) / 2 as tr,
  row_number() over (partition by row_id order by label desc, pos) as ir, (p >= 0.5)::int as hard, greatest(least(p, 1 - 1e-11), 1e-11) as cp from shown),
r as (select row_id, (sum(tr) filter (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) as auc,
  sum(label / rank) / nullif(sum(label), 0) as mrr,
  sum(case when rank <= 5 then (pow(2, label) - 1) / log2(rank + 1) else 0 end) / nullif(sum(case when ir <= 5 then (pow(2, label) - 1) / log2(ir + 1) else 0 end), 0) as ndcg,
  avg(-(label * ln(cp) + (1 - label) * ln(1 - cp))) as log_loss, sqrt(avg(pow(label - p, 2))) as rmse, avg((label = hard)::int) as accuracy,
  coalesce(2 * sum(label * hard) / nullif(sum(label) + sum(hard), 0), 0) as f1 from t group by row_id)
select round(avg(auc), 6) as auc, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg, round(avg(log_loss), 6) as log_loss, round(avg(rmse), 6) as rmse, round(avg(accuracy), 6) as accuracy, round(avg(f1), 6) as f1 from r"""
)
def toolbox_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.toolbox_metrics(T.shown(spark, d).withColumnRenamed("label", "y"), "row_id")
    return m.select(*[r6(c) for c in m.columns])


@query("select a.row_id, round((sum((a.p > b.p)::int) / count(*))::double, 6) as auc from shown a join shown b on a.row_id = b.row_id and a.label = 1 and b.label = 0 group by a.row_id")
def auc_strict(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.strict_auc(T.shown(spark, d).withColumnRenamed("label", "y"), "row_id").filter("auc is not null").select("row_id", r6("auc"))


@query("select row_id, round(coalesce(1 / min(rank) filter (label = 1), 1), 6)::double as rr from ranked group by row_id")
def reciprocal_rank(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.reciprocal_rank(_ranked(spark, d), "row_id").select("row_id", r6("rr"))


ILD = """with c as (select row_id, coalesce(p_type, '__UNKNOWN__') as cat, count(*) as n from cand_a left join part on p_partkey = item group by all)
select row_id, round(case when sum(n) < 2 then 0 else 1 - sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) end, 6)::double as ild from c group by row_id"""


@query(ILD)
def ild_category(spark: SparkSession, d: str) -> DataFrame:
    items = T.candidates(spark, d).join(T.articles(spark, d), "item", "left")
    return evaluate.category_diversity(items, "row_id", "category").select("row_id", r6("ild"))


POP = "pop as (select item, n / sum(n) over () as p from (select p_partkey as item, count(row_id) + 1.0::double as n from part left join shown on item = p_partkey group by 1))"


def _pop(spark: SparkSession, d: str) -> DataFrame:
    n = T.shown(spark, d).groupBy("item").agg(F.count(F.lit(1)).alias("n_inviews"))
    return popularity.smoothed_popularity(T.articles(spark, d).join(n, "item", "left").withColumn("n_clicks", F.lit(None).cast("long")))


@query(f"with {POP} select row_id, round(coalesce(avg(-log2(p)), 0), 6) as novelty from cand_a left join pop using (item) group by row_id")
def novelty_smoothed(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.novelty(T.candidates(spark, d), _pop(spark, d), "row_id", "item").select("row_id", r6("novelty"))


@query(
    """select round(count(distinct item) / (select count(*) from part), 6)::double as article_coverage, round(count(distinct p_type) / (select count(distinct p_type) from part), 6)::double as category_coverage
from cand_a left join part on p_partkey = item where rank <= 2"""
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    c = evaluate.coverage(T.candidates(spark, d).filter("rank <= 2"), T.articles(spark, d), "item", "category")
    return c.select(r6("article_coverage"), r6("category_coverage"))


@query(
    f"""with {POP}, t as (select row_id, label, rank, rank() over (partition by row_id order by score) + (count(*) over (partition by row_id, score) - 1) / 2 as tr from ranked),
m as (select row_id, (sum(tr) filter (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) as auc, 1 / min(rank) filter (label = 1) as mrr from t group by row_id),
nv as (select row_id, coalesce(avg(-log2(p)), 0) as novelty from cand_a left join pop using (item) group by row_id),
hn as (select i.row_id, count(c.item) as n from impressions i left join clicks c on c.user_id = i.user_id and c.click_time < i.t group by 1),
w as (select hn.n = 0 as cold, auc, mrr, coalesce(novelty, 0) as novelty from hn left join m using (row_id) left join nv using (row_id))
select 'all' as slice, count(*) as n, round(avg(auc), 6) as auc, round(avg(mrr), 6) as mrr, round(avg(novelty), 6) as novelty from w union all
select case when cold then 'cold' else 'warm' end, count(*), round(avg(auc), 6), round(avg(mrr), 6), round(avg(novelty), 6) from w group by 1"""
)
def evaluation_slices(spark: SparkSession, d: str) -> DataFrame:
    imp, clicks = T.impressions(spark, d), T.clicks(spark, d)
    rows = history.clicks_before(imp, clicks, time="t", row="row_id").select(F.col("__row").alias("row_id"), F.col("__n").alias("n_history"))
    m = evaluate.evaluate(_ranked(spark, d), rows, T.articles(spark, d), _pop(spark, d), T.candidates(spark, d))
    return m.select("slice", "n", r6("auc"), r6("mrr"), r6("novelty"))


@query("with c as (select p_type, count(*)::double as f from part group by 1) select round(count(*) * (pow(sum(f), 2) - sum(f * f)) / (pow(sum(f), 2) * (count(*) - 1)), 6) as dispersion from c", views=False)
def index_of_dispersion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.index_of_dispersion(T.articles(spark, d), "category").select(r6("dispersion"))


@query("select (select round(avg(p_retailprice), 6) from (select p_retailprice from part order by 1 limit 10)) as lowest, (select round(avg(p_retailprice), 6) from (select p_retailprice from part order by 1 desc limit 10)) as highest", views=False)
def bounded_mean(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.bounded_mean(T.read(spark, d, "part"), "p_retailprice", 10).select(r6("lowest"), r6("highest"))


@query()
def bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.accuracy(_ranked(spark, d)).select(F.lit("auc").alias("metric"), "row_id", "auc")
    return bootstrap.mean_ci(m, "metric", "row_id", "auc", runs=200)


POISSON = "+".join(f"(u >= {c!r})::int" for c in bootstrap.poisson_steps())


@query(
    """with t as (select row_id, label, rank() over (partition by row_id order by score) + (count(*) over (partition by row_id, score) - 1) / 2 as tr from ranked),
s as (select row_id, sum(tr) filter (label = 1) as r, sum(label) as p, count(*) - sum(label) as n from t group by row_id),
a as (select row_id, (r - p * (p + 1) / 2) / nullif(p * n, 0) as auc from s),
d as (select auc, run, ('0x' || substr(md5('42|' || row_id || '|' || run), 1, 8))::bigint::double / 4294967296.0::double as u from a, (select unnest(range(1, 51)) as run) where auc is not null),
m as (select run, sum((%s) * auc) / nullif(sum(%s), 0) as m from d group by run)
select 'auc' as metric, round((select avg(auc) from a), 6) as value, round(quantile_cont(m, 0.025), 6) as ci_low, round(quantile_cont(m, 0.975), 6) as ci_high from m"""
    % (POISSON, POISSON)
)
def bootstrap_poisson(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.accuracy(_ranked(spark, d)).select(F.lit("auc").alias("metric"), "row_id", "auc")
    return bootstrap.poisson_ci(m, "metric", "row_id", "auc", runs=50).select("metric", r6("value"), r6("ci_low"), r6("ci_high"))


# --- lexical retrieval

STOP = ", ".join(f"('{w}')" for w in X.STOPWORDS)
# each text is cut once and its words are joined with the stop words, as lists of words would be searched word by word
WORDS = """select {id}, lower(w) as term from (select {id}, unnest(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+')) as w from {table}) where length(w) > 1"""
BM25 = f"""with stop(term) as (values {STOP}), tok as ({WORDS.format(id="doc_id", table="documents")}),
tf as (select doc_id, term, count(*) as tf from tok anti join stop using (term) group by all),
dl as (select doc_id, coalesce(sum(tf), 0) as dl from documents left join tf using (doc_id) group by doc_id),
n as (select count(*) as n, avg(dl) as avgdl from dl), df as (select term, count(*) as df from tf group by term),
raw as (select term, df, ln((n - df + 0.5) / (df + 0.5)) + 1 as raw from df, n), idf as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
qt as (select distinct item_id, term from ({WORDS.format(id="item_id", table="benchmark")}) anti join stop using (term)),
hit as (select item_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as score from qt join tf using (term) join idf using (term) join dl using (doc_id), n group by all),
top as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from hit where score <> 0)
"""


def _index(spark: SparkSession, d: str) -> bm25.Bm25Index:
    return bm25.build_index(T.read(spark, d, "documents"), "doc_id", "text")


# of its own, with no part that it does not need
DF_IDF = f"""with stop(term) as (values {STOP}), w as (select doc_id, lower(w) as term from (select doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) as w from documents where text is not null)),
df as (select term, count(distinct doc_id) as df from w where length(term) > 1 and term not in (select term from stop) group by term),
raw as (select term, df, ln((n - df + 0.5) / (df + 0.5)) + 1 as raw from df cross join (select count(*) as n from documents) n)
select term, df, round(case when raw < 0 then 0.25 * m else raw end, 6) as idf from raw cross join (select avg(raw) as m from raw) m"""


@query(DF_IDF, views=False)
def bm25_df_idf(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).terms.select("term", "df", r6("idf"))


@query(BM25 + "select item_id, doc_id, round(score, 6) as score, rank::int as rank from top where rank <= 10")
def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    found = bm25.search(_index(spark, d), T.read(spark, d, "benchmark"), "item_id", "text", 10, zero_fill=False).withColumnRenamed("doc_ix", "doc_id")
    return found.select("item_id", "doc_id", r6("score"), "rank")


@query(
    BM25
    + """, best as (select * from top where rank <= 50), nq as (select item_id, count(best.doc_id) as n from benchmark left join best using (item_id) group by 1),
free as (select nq.item_id, d.doc_id, n + row_number() over (partition by nq.item_id order by d.doc_id) as rank from nq, documents d where not exists (select 1 from best b where b.item_id = nq.item_id and b.doc_id = d.doc_id) and n < 50)
select item_id, doc_id, round(score, 6) as score, rank::int as rank from best union all select item_id, doc_id, 0.0, rank::int from free where rank <= 50"""
)
def bm25_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    return bm25.search(_index(spark, d), T.read(spark, d, "benchmark"), "item_id", "text", 50).withColumnRenamed("doc_ix", "doc_id").select("item_id", "doc_id", r6("score"), "rank")


@query("select doc_id, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+'))::int as n_tokens, case when coalesce(text, '') = '' then 0 else len(string_split(text, ' ')) end::int as n_words from documents", views=False)
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"), False)).alias("n_tokens"), X.word_count(F.col("text")).alias("n_words"))


@query(
    CLICKED
    + """, k as (select row_id, list(item order by rank) as cands from cand_a where rank <= 3 group by row_id)
select round(avg(len(list_filter(clicked, lambda x: list_contains(coalesce(cands, []), x))) / len(clicked)), 6) as recall_3, count(*) as n from c left join k using (row_id) where len(clicked) > 0"""
)
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    lists = T.candidates(spark, d).groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"]).alias("cands"))
    rows = _clicked(spark, d).filter(F.size("clicked") > 0).join(lists, "row_id", "left").withColumn("cands", F.coalesce("cands", F.array().cast("array<bigint>")))
    return rows.agg(r6(F.avg(bm25.recall(F.col("clicked"), F.col("cands"), 3)), "recall_3"), F.count(F.lit(1)).alias("n"))


@query(ASOF + "select row_id, string_agg(p_name, ' ' order by pos) as query from (select * from h where pos >= (select max(pos) from h h2 where h2.row_id = h.row_id) - 1) x join part on p_partkey = item group by row_id")
def history_queries(spark: SparkSession, d: str) -> DataFrame:
    return bm25.history_queries(_asof(spark, d), T.articles(spark, d), 2, "row_id", "item", "title").select("row_id", "query")


# --- vectors


@query(
    """with v as (select vec_id, case when vec_id % 11 = 3 then null when vec_id % 7 = 2 then [] when vec_id % 5 = 1 then embedding[1:60] when vec_id % 13 = 4 then list_transform(embedding, lambda x: case when x > 0 then 'nan'::float else x end) else embedding end as e from embeddings
union all select vec_id, embedding from embeddings where label = 3)
select count(*) as n, count(*) filter (e is null) as n_missing, count(*) filter (len(e) = 0) as n_empty, (max(len(e)) - min(len(e)))::int as size_spread,
count(*) filter (len(list_filter(e, lambda x: isnan(x) or isinf(x))) > 0) as n_not_finite, count(*) - count(distinct vec_id) as n_repeated from v""",
    views=False,
)
def vector_validation(spark: SparkSession, d: str) -> DataFrame:
    """Problems that are planted by rule into the whole table."""
    e, i = F.col("embedding"), F.col("vec_id")
    spoilt = F.transform(e, lambda x: F.when(x > 0, F.lit(float("nan")).cast("float")).otherwise(x))
    bad = F.when(i % 11 == 3, None).when(i % 7 == 2, F.array().cast("array<float>")).when(i % 5 == 1, F.slice(e, 1, 60)).when(i % 13 == 4, spoilt).otherwise(e)
    whole = T.read(spark, d, "embeddings")
    both = whole.select(i.alias("item"), bad.alias("vector")).unionByName(whole.filter("label = 3").select(i.alias("item"), e.alias("vector")))
    return vectors.vector_problems(both, "item", "vector")


@query(
    ASOF
    + """, e as (select row_id, embedding from h join embeddings on vec_id = item), n as (select row_id, count(*) as n from e group by 1),
x as (select row_id, generate_subscripts(embedding, 1) as p, unnest(embedding)::double as x from e), m as (select row_id, p, avg(x) as x from x group by all),
u as (select row_id, p, x / sqrt(sum(x * x) over (partition by row_id)) as x from m)
select hh.row_id, coalesce(n, 0) as n_used, round(u.x, 5) as first from (select distinct row_id from h) hh left join n using (row_id) left join u on u.row_id = hh.row_id and p = 1"""
)
def pooled_user_vector(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.pool_lists(_asof_lists(spark, d), T.vectors(spark, d), "row_id", "history", "item", "vector")
    return v.select("row_id", "n_used", F.round(F.element_at("vector", 1), 5).alias("first"))


@query(
    """with s as (select a.vec_id as query_id, b.vec_id as item, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, embeddings b where a.vec_id % 10 = 0),
t as (select *, row_number() over (partition by query_id order by score desc, item) as rank from s) select query_id, item, score, rank::int as rank from t where rank <= 10""",
    views=False,
)
def inner_product_top10(spark: SparkSession, d: str) -> DataFrame:
    v = T.vectors(spark, d)
    q = v.filter("item % 10 = 0").select(F.col("item").alias("query_id"), "vector")
    return vectors.top_k(q, v, "query_id", "item", 10).select("query_id", "item", "score", "rank")


@query(
    """with a as (select a.row_id, 1 - list_cosine_similarity(x.embedding::double[], y.embedding::double[]) as dist from cand_a a join cand_a b on a.row_id = b.row_id and a.item <> b.item join embeddings x on x.vec_id = a.item join embeddings y on y.vec_id = b.item)
select i.row_id, round(avg(dist), 5) as diversity from (select distinct row_id from cand_a) i left join a using (row_id) group by 1"""
)
def ild_embedding(spark: SparkSession, d: str) -> DataFrame:
    lists = T.candidates(spark, d).groupBy("row_id").agg(F.collect_list("item").alias("items"))
    return vectors.pairwise_distance(lists, T.vectors(spark, d), "row_id", "items", "item").select("row_id", F.round("diversity", 5).alias("diversity"))


@query(
    ASOF
    + """, z as (select c.row_id, 1 - list_cosine_similarity(x.embedding::double[], y.embedding::double[]) as dist from cand_a c join h on c.row_id = h.row_id join embeddings x on x.vec_id = c.item join embeddings y on y.vec_id = h.item)
select i.row_id, round(avg(dist), 5) as serendipity from (select distinct row_id from cand_a) i left join z using (row_id) group by 1"""
)
def serendipity(spark: SparkSession, d: str) -> DataFrame:
    lists = T.candidates(spark, d).groupBy("row_id").agg(F.collect_list("item").alias("items"))
    both = history.with_lists(lists, _asof_lists(spark, d), "row_id")
    return vectors.serendipity(both, T.vectors(spark, d), "row_id", "items", "history", "item").select("row_id", F.round("serendipity", 5).alias("serendipity"))


@query(
    """with e as (select label || '/' || vec_id // 500 as slate, vec_id, embedding::double[] as v from embeddings),
d as (select a.slate, a.vec_id as x, b.vec_id as y, 1 - list_cosine_similarity(a.v, b.v) as d from e a join e b on a.slate = b.slate and a.vec_id < b.vec_id),
t as (select p.slate, (p.d + q.d + r.d) / 3 as diversity from d p join d q on p.slate = q.slate and p.y = q.x join d r on p.slate = r.slate and r.x = p.x and r.y = q.y),
b as (select slate, count(*) as n_lists, min(diversity) as lowest, max(diversity) as highest from t group by slate)
select slate, n, coalesce(n_lists, 0) as n_lists, round(lowest, 6) as lowest, round(highest, 6) as highest from (select slate, count(*) as n from e group by slate) left join b using (slate)""",
    views=False,
)
def diversity_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Of all lists of three that can be drawn from slates of neighbouring ids of a label."""
    e = T.read(spark, d, "embeddings").select(F.concat_ws("/", "label", F.expr("vec_id div 500")).alias("slate"), F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    return diversity.diversity_bounds(e, "slate", 3, exact=True).select("slate", "n", "n_lists", r6("lowest"), r6("highest"))


@query()
def document_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen components of every document's weighted words."""
    found = doc_vectors.document_vectors(T.read(spark, d, "documents"), "doc_id", "text", 16)
    return found.select("doc_id", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


@query()
def vector_index_top10(spark: SparkSession, d: str) -> DataFrame:
    """Each hundredth vector against an inverted file of all, with its recall against the exact search."""
    v = T.vectors(spark, d)
    q = v.filter("item % 100 = 0").select(F.col("item").alias("query_id"), "vector")
    found = ann.search(ann.build_index(v, "item"), q, "query_id", 10).persist()
    measured = ann.recall(found, vectors.top_k(q, v, "query_id", "item", 10), "query_id")
    return found.join(measured, "query_id").select("query_id", "item", "score", "rank", "recall")


@query(
    CLICKED
    + """, bad as (select distinct row_id from (select row_id, unnest(clicked) as x from c) where x not in (select vec_id from embeddings))
select row_id from c where len(clicked) > 0 and row_id in (select row_id from cand_b) and row_id not in (select row_id from bad)"""
)
def fair_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = T.candidates(spark, d, "b").select("row_id").distinct()
    return validate.fair_rows(_clicked(spark, d), rows, T.vectors(spark, d), "row_id", "clicked", "item").select("row_id")


# --- fusion, export and checks

FUSED = """with na as (select row_id, item, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0 end as s from cand_a window w as (partition by row_id)),
nb as (select row_id, item, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0 end as s from cand_b window w as (partition by row_id)),
f as (select s.row_id, s.pos, 0.5 * coalesce(na.s, -1) + 0.5 * coalesce(nb.s, -1) as fused from shown s left join na using (row_id, item) left join nb using (row_id, item)),
g as (select *, row_number() over (partition by row_id order by fused desc, pos) as fused_rank from f)
"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    methods = {"a": (T.candidates(spark, d), 0.5), "b": (T.candidates(spark, d, "b"), 0.5)}
    return ranking.fuse(T.shown(spark, d).select("row_id", "pos", "item"), methods)


@query(FUSED + "select row_id, pos, round(fused, 6) as fused, fused_rank::int as fused_rank from g")
def fusion_rank(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("row_id", "pos", r6("fused"), "fused_rank")


@query(FUSED + "select row_id, row_id || chr(9) || '[' || string_agg(fused_rank::varchar, ',' order by pos) || ']' as line from g group by row_id")
def submission_lines(spark: SparkSession, d: str) -> DataFrame:
    return ranking.submission_lines(_fused(spark, d).withColumn("name", F.col("row_id")), "row_id", "name")


@query(
    CLICKED
    + """, k as (select row_id, list(item order by rank) as cands, list(score order by rank) as scores from cand_a group by row_id),
p as (select c.row_id + (case when c.row_id % 17 = 5 then 10000000000 else 0 end) as row_id, case when c.row_id % 5 = 0 then 'test' else 'val' end as split,
  case when c.row_id % 7 = 1 then [] else clicked end as gt, case when c.row_id % 6 = 2 then list_concat(cands, cands[1:1]) when c.row_id % 9 = 3 then list_concat([-c.row_id], cands[2:]) else cands end as cands,
  case when c.row_id % 8 = 4 then list_transform(scores, lambda x: 'inf'::double) else scores end as scores from c join k using (row_id)),
q as (select * from p union all select * from p where row_id % 10 = 7),
o as (select distinct x from (select unnest(cands) as x from q) where x not in (select p_partkey from part))
select count(*) - count(distinct q.row_id) as repeated_rows, count(*) filter (q.split <> 'val') as other_split, count(*) filter (len(cands) <> len(scores)) as unequal_lengths,
count(*) filter (len(cands) <> len(list_distinct(cands))) as repeated_candidates, count(*) filter (len(list_filter(scores, lambda x: isinf(x) or isnan(x))) > 0) as scores_not_finite,
(select count(*) from o) as outside_catalog, count(*) filter (c.row_id is null) as unknown_rows, count(*) filter (c.row_id is not null and gt <> clicked) as other_truth from q left join c using (row_id)"""
)
def validation_violations(spark: SparkSession, d: str) -> DataFrame:
    """Violations of every kind that are planted by rule into the whole candidates."""
    imp, i = T.impressions(spark, d), F.col("row_id")
    lists = T.candidates(spark, d).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "score"))).alias("s"))
    items, scores = F.transform("s", lambda x: x["item"]), F.transform("s", lambda x: x["score"])
    spoilt = F.when(i % 6 == 2, F.concat(items, F.slice(items, 1, 1))).when(i % 9 == 3, F.concat(F.array(-i), F.slice(items, 2, 1000))).otherwise(items)
    planted = _clicked(spark, d).join(lists, "row_id").select(
        (i + F.when(i % 17 == 5, 10_000_000_000).otherwise(0)).alias("row_id"),
        F.when(i % 5 == 0, "test").otherwise("val").alias("split"),
        F.when(i % 7 == 1, F.array().cast("array<bigint>")).otherwise(F.col("clicked")).alias("gt_clicked"),
        spoilt.alias("candidates"),
        F.when(i % 8 == 4, F.transform(scores, lambda x: F.lit(float("inf")))).otherwise(scores).alias("scores"),
    )
    cand = planted.unionByName(planted.filter("row_id % 10 = 7"))
    return validate.candidate_problems(cand, imp, T.articles(spark, d), "val", "row_id", "item")


@query("select count(*) filter (len(inview) <> len(case when row_id % 4 = 1 then labels[2:] else labels end)) as n from impressions")
def unequal_lengths(spark: SparkSession, d: str) -> DataFrame:
    cut = F.when(F.col("row_id") % 4 == 1, F.slice("labels", 2, 1000)).otherwise(F.col("labels"))
    return validate.unequal_lengths(T.impressions(spark, d).withColumn("labels", cut), "inview", "labels")


@query(
    ASOF
    + """, hx as (select row_id, string_agg(ix::varchar, ',' order by pos) as hist_ix from h join (select p_partkey, row_number() over (order by p_partkey) as ix from part) on p_partkey = item group by 1),
sx as (select row_id, string_agg(ix::varchar, ',' order by pos) as cand_ix, string_agg(label::varchar, ',' order by pos) as labels from shown join (select p_partkey, row_number() over (order by p_partkey) as ix from part) on p_partkey = item group by 1)
select i.row_id, dense_rank() over (order by user_id) - 1 as user_ix, coalesce(hist_ix, '') as hist_ix, cand_ix, sx.labels from impressions i left join hx using (row_id) join sx using (row_id)"""
)
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    hist = history.with_lists(T.impressions(spark, d), _asof_lists(spark, d), "row_id")
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    out = features.feature_table(hist, T.articles(spark, d), "row_id", item="item")
    return out.select("row_id", "user_ix", joined("hist_ix"), joined("cand_ix"), joined("labels"))


# --- sampling and partitions


@query("select o_orderkey as row_id from (select o_orderkey, row_number() over (partition by o_custkey order by md5('42|' || o_orderkey), o_orderkey) as rn from orders) where rn <= 2", views=False)
def sample_per_user(spark: SparkSession, d: str) -> DataFrame:
    return sampling.down_sample(T.read(spark, d, "orders"), 2, "o_custkey", 42, "o_orderkey").select(F.col("o_orderkey").alias("row_id"))


@query("select row_id, array_to_string(list_transform(list_sort(list_transform(list_zip(inview, range(len(inview))), lambda z: [md5('5|' || row_id || '|' || z[2]), z[1]::varchar]))[1:2], lambda z: z[2]), ',') as items from impressions where len(inview) >= 2")
def list_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = T.impressions(spark, d).filter(F.size("inview") >= 2)
    return rows.select("row_id", F.array_join(sampling.sample_list(F.col("inview"), 2, 5, F.col("row_id")), ",").alias("items"))


@query(
    CLICKED
    + """, e as (select row_id, list_filter(inview, lambda x: not list_contains(clicked, x)) as neg, unnest(clicked) as click from c)
select row_id, click, case when len(neg) > 0 then array_to_string(list_transform(range(0, 4), lambda i: neg[('0x' || substr(md5('9|' || row_id || '|' || click || '|' || i), 1, 8))::bigint % len(neg) + 1]), ',') || ',' || click end as items from e"""
)
def negative_sampling(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.negative_samples(_clicked(spark, d), 4, 9, "row_id")
    return rows.select("row_id", F.element_at("clicked", 1).alias("click"), F.array_join("inview", ",").alias("items"))


@query("select o_orderkey as row_id, case when row_number() over (order by md5('1|' || o_orderkey)) <= floor(count(*) over () * 0.3) then 'first' else 'second' end as part from orders", views=False)
def split_fraction(spark: SparkSession, d: str) -> DataFrame:
    o = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    return split.fraction_split(o, S.digest_order(1, F.col("row_id")), 0.3)


@query("select o_orderkey as row_id, least((row_number() over (order by md5('1|' || o_orderkey)) - 1) // (count(*) over () // 7), 6) as chunk from orders", views=False)
def split_chunks(spark: SparkSession, d: str) -> DataFrame:
    o = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    return split.chunk_split(o, S.digest_order(1, F.col("row_id")), 7)


@query("select o_orderkey as row_id, ((row_number() over (order by md5('1|' || o_orderkey)) - 1) // ceil(count(*) over () / 7)::bigint)::bigint as part from orders", views=False)
def split_even(spark: SparkSession, d: str) -> DataFrame:
    o = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    return split.even_split(o, S.digest_order(1, F.col("row_id")), 7)


@query("select o_orderkey as row_id, (row_number() over (order by o_totalprice, o_orderkey) - 1) // ceil(count(*) over () / 7)::bigint as part from orders", views=False)
def split_even_by_number(spark: SparkSession, d: str) -> DataFrame:
    o = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    return split.even_split(o, F.struct("o_totalprice", "row_id"), 7).select("row_id", "part")


@query("select c_custkey as user_id, least((row_number() over (order by c_mktsegment, c_name) - 1) // (count(*) over () // 9), 8) as chunk from customer", views=False)
def split_chunks_by_text(spark: SparkSession, d: str) -> DataFrame:
    c = T.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment", "c_name")
    return split.chunk_split(c, F.struct("c_mktsegment", "c_name"), 9).select("user_id", "chunk")


@query("select event_id, case when row_number() over (order by ts, event_id) <= floor(count(*) over () * 0.8) then 'first' else 'second' end as part from events", views=False)
def split_fraction_by_time(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").select("event_id", "ts")
    return split.fraction_split(e, F.struct("ts", "event_id"), 0.8).select("event_id", "part")


# --- descriptive statistics


@query("select round(count(distinct case when k = 1 then x end) / count(distinct x), 6)::double as overlap from (select 1 as k, o_custkey as x from orders union all select 2, user_id from events)", views=False)
def overlap_ratio(spark: SparkSession, d: str) -> DataFrame:
    a, b = T.read(spark, d, "orders").select(F.col("o_custkey").alias("x")), T.read(spark, d, "events").select(F.col("user_id").alias("x"))
    return D.overlap_ratio(a, b, "x").select(r6("overlap"))


@query(
    """with v as (select 'n_chars' as metric, n_chars::double as x from documents union all select 'n_bytes', strlen(text)::double from documents)
select metric, count(x) as n, round(avg(x), 4) as mean, round(stddev_samp(x), 4) as std, min(x) as low, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.75) as q3, max(x) as high from v group by metric""",
    views=False,
)
def describe_lengths(spark: SparkSession, d: str) -> DataFrame:
    docs = T.read(spark, d, "documents").select("n_chars", F.octet_length("text").alias("n_bytes"))
    m = D.describe(docs, "n_chars", "n_bytes")
    return m.select("metric", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "low", "q1", "median", "q3", "high")


@query("select 'lang' as \"column\", count(distinct lang) as n from documents union all select 'source', count(distinct source) from documents", views=False)
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.distinct_counts(T.read(spark, d, "documents"), "lang", "source")


@query("select user_id, arg_min(event_type, ts) as event_type from events group by 1", views=False)
def first_in_group(spark: SparkSession, d: str) -> DataFrame:
    return D.first_in_group(T.read(spark, d, "events"), "user_id", "event_type", "ts")


@query("select epoch_us(min(t)) as first, epoch_us(max(t)) as last from impressions")
def time_bounds(spark: SparkSession, d: str) -> DataFrame:
    return D.time_bounds(T.impressions(spark, d), "t").select(F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))


@query("select min(list_min(inview)) as first, max(list_max(inview)) as last from impressions")
def list_bounds(spark: SparkSession, d: str) -> DataFrame:
    return D.list_time_bounds(T.impressions(spark, d), "inview")


@query("select p_partkey as item, round(greatest(coalesce(p_retailprice / (select max(p_retailprice) from part), 0), 1e-4), 6) as scaled from part", views=False)
def max_scaled(spark: SparkSession, d: str) -> DataFrame:
    return D.max_scaled(T.read(spark, d, "part"), "p_retailprice", "scaled").select(F.col("p_partkey").alias("item"), r6("scaled"))


@query("select event_id, (props->>'$.k')::int as k from events", views=False)
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("select epoch_us(time_bucket(interval 1 hour, ts)) as window_start, event_type, count(*) as n from events group by all", views=False)
def popularity_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_popularity(T.read(spark, d, "events")).select(F.unix_micros("window_start").alias("window_start"), "event_type", "n")


FINGERPRINTED = {"documents": "doc_id lang n_chars source text", "labels": "doc_id quality toxic", "conversations": "conv_id role text turn", "benchmark": "item_id text", "nation": "n_name n_nationkey n_regionkey"}
_CELLS = {t: ", ".join(f"coalesce({c}::varchar, chr(30))" for c in cols.split()) for t, cols in FINGERPRINTED.items()}
_LANES = " || ".join(f"printf('%08x', (coalesce(sum(('0x' || substr(h, {8 * i + 1}, 8))::bigint), 0) % 4294967296)::bigint)" for i in range(4))


@query(" union all ".join(f"select '{t}' as name, count(*) as n, {_LANES} as digest from (select md5(concat_ws(chr(31), {cells})) as h from {t})" for t, cells in _CELLS.items()), views=False)
def table_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    each = [runner.table_fingerprint(T.read(spark, d, t)).select(F.lit(t).alias("name"), "n", "digest") for t in FINGERPRINTED]
    return reduce(DataFrame.unionByName, each)


def queries() -> dict[str, Query]:
    import feedforge.plans.helper_queries  # noqa: F401  registers more

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
