"""Registered queries of filters, parsers, list helpers, feature tables and evaluation reports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedforge.functions import lists as L
from feedforge.functions import scalars as S
from feedforge.functions import text as X
from feedforge.operators import bm25, bootstrap, evaluate, features, frames, history, vectors
from feedforge.plans import queries as Q
from feedforge.plans import tables as T
from feedforge.plans.queries import ASOF, CLICKED, _asof, _clicked, query, r6
from feedforge.plans.stages import repeated_ids
from feedforge.sources.readers import join_vectors

# --- filters and partitions


@query("select event_id from events where value >= 20", views=False)
def read_time_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return frames.at_least(T.read(spark, d, "events"), "value", 20).select("event_id")


@query("select doc_id from documents where length(text) > 0", views=False)
def nonempty_texts(spark: SparkSession, d: str) -> DataFrame:
    return frames.with_text(T.read(spark, d, "documents"), "text").select("doc_id")


@query("select event_id, case when ts::date < (select max(ts)::date from events) - 7 then 'train' else 'test' end as part from events", views=False)
def day_split(spark: SparkSession, d: str) -> DataFrame:
    old, new = frames.last_days(T.read(spark, d, "events"), "ts", 7)
    return old.select("event_id", F.lit("train").alias("part")).unionByName(new.select("event_id", F.lit("test").alias("part")))


@query("select c_custkey as user_id, coalesce(c_acctbal > 0, false) as flagged from customer", views=False)
def boolean_split(spark: SparkSession, d: str) -> DataFrame:
    yes, no = frames.split_by(T.read(spark, d, "customer"), F.col("c_acctbal") > 0)
    return yes.select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("flagged")).unionByName(no.select(F.col("c_custkey").alias("user_id"), F.lit(False).alias("flagged")))


@query("select event_id, case when event_type in ('view', 'click') then 'article' else 'front' end as page from events", views=False)
def null_split(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").withColumn("article", F.when(F.col("event_type").isin("view", "click"), F.col("user_id")))
    front, article = frames.split_null(e, "article")
    return front.select("event_id", F.lit("front").alias("page")).unionByName(article.select("event_id", F.lit("article").alias("page")))


@query("select c_custkey as id, c_name as name, null::varchar as brand from customer union all select p_partkey, null, p_brand from part", views=False)
def stacked_tables(spark: SparkSession, d: str) -> DataFrame:
    people = frames.rename_known(T.read(spark, d, "customer"), {"c_custkey": "id", "c_name": "name", "absent": "gone"}).select("id", "name")
    return frames.stack([people, T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))])


@query("select p_partkey as item, i from (select p_partkey, unnest(range(p_size % 4)) as i from part)", views=False)
def repeated_rows(spark: SparkSession, d: str) -> DataFrame:
    p = frames.repeat_rows(T.read(spark, d, "part"), F.col("p_size") % 4)
    return p.groupBy("p_partkey", "p_size").count().select(F.col("p_partkey").alias("item"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("i"))


@query("select o_orderkey as row_id from (select o_orderkey, row_number() over (order by md5('3|' || o_orderkey), o_orderkey) as rn, count(*) over () as n from orders) where rn <= floor(n * 0.2)", views=False)
def frame_sample(spark: SparkSession, d: str) -> DataFrame:
    return frames.fraction(T.read(spark, d, "orders"), 0.2, 3, "o_orderkey").select(F.col("o_orderkey").alias("row_id"))


@query("select o_orderkey as row_id, row_number() over (order by md5('8|' || o_orderkey), o_orderkey) - 1 as place from orders", views=False)
def shuffled_rows(spark: SparkSession, d: str) -> DataFrame:
    o = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    return frames.numbered(o, F.struct(S.digest_order(8, F.col("row_id")), "row_id"), "place")


@query("select p_partkey as item from part order by p_retailprice desc, p_partkey limit 20", views=False)
def top_slate(spark: SparkSession, d: str) -> DataFrame:
    return frames.top_slate(T.read(spark, d, "part"), "p_partkey", "p_retailprice", 20).select(F.col("p_partkey").alias("item"))


PRIME = frames.PRIME


def _round(i: int, inner: str) -> str:
    """SQL of one round of the slates' permutation over a query with high and low."""
    v = f"(({'low' if i % 2 == 0 else 'high'} + k[{i + 1}]) % {PRIME})"
    t = f"(({v} * {v} % {PRIME} * {v} + k[{i + 1}]) % {PRIME})"
    high, low = (f"(high + {t}) % a", "low") if i % 2 == 0 else ("high", f"(low + {t}) % b")
    return f"select user_id, i, k, n, a, b, {high} as high, {low} as low from ({inner})"


PERMUTED = "select user_id, i, k, n, a, b, x // b as high, x % b as low from w where x >= n or first"
for _i in range(frames.ROUNDS):
    PERMUTED = _round(_i, PERMUTED)
KEYS = ", ".join(f"('0x' || substr(h, {8 * j + 1}, 8))::bigint % {PRIME}" for j in range(frames.ROUNDS))


@query(
    f"""with recursive r as (select p_partkey as item, row_number() over (order by md5('11|' || p_partkey), p_partkey) - 1 as ix from part),
m as (select count(*) as n, greatest(1, floor(sqrt(count(*))))::bigint as a from part), n as (select n, a, (n + a - 1) // a as b from m),
u as (select c_custkey as user_id, sha256('11|' || c_custkey) as h from customer),
w as (select user_id, i, [{KEYS}] as k, n, a, b, i as x, true as first from u, n, (select unnest(range(5)) as i where true)
union all select user_id, i, k, n, a, b, high * b + low, false from ({PERMUTED}))
select user_id, string_agg(item::varchar, ',' order by i) as slate from w join r on x = ix where not first group by user_id""",
    views=False,
)
def random_slates(spark: SparkSession, d: str) -> DataFrame:
    users = T.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return frames.random_slates(T.articles(spark, d), "item", users, "user_id", 5, 11).select("user_id", F.array_join("slate", ",").alias("slate"))


@query("select user_id, count(*) - 1 as n_repeated from impressions group by user_id having count(*) > 1")
def repeated_names(spark: SparkSession, d: str) -> DataFrame:
    """Repeats of each user; their sum is what `repeated_ids` counts."""
    rows = T.impressions(spark, d).select(F.col("row_id").alias("impression_row_id"), F.col("user_id").cast("string").alias("impression_id"))
    total = repeated_ids(rows)
    per = T.impressions(spark, d).groupBy("user_id").agg((F.count(F.lit(1)) - 1).alias("n_repeated")).filter("n_repeated > 0")
    same = per.agg(F.sum("n_repeated").alias("s")).crossJoin(total.withColumnRenamed("n_repeated", "t")).filter("s = t")
    return per.crossJoin(same.select("t")).drop("t")


# --- parsing and scalar formulas


@query("select o_orderkey as row_id, epoch_us(case when o_orderkey % 2 = 0 then o_orderdate + interval 5 minute else o_orderdate end + to_seconds(case when o_orderkey % 2 = 0 then 0 else o_orderkey % 60 end)) as us from orders", views=False)
def two_format_times(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate").cast("timestamp")
    minute = F.date_format(t + F.expr("interval 5 minutes"), "M/d/yyyy h:mm a")
    second = F.date_format(F.timestamp_micros(F.unix_micros(t) + (F.col("o_orderkey") % 60) * 1_000_000), "M/d/yyyy h:mm:ss a")
    text = F.when(F.col("o_orderkey") % 2 == 0, minute).otherwise(second)
    return T.read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.unix_micros(X.two_format_time(text)).alias("us"))


@query("select row_id, array_to_string(list_transform(inview, lambda x: 'N-' || x), ' ') as ids, array_to_string(labels, ',') as labels from impressions")
def impression_tokens(spark: SparkSession, d: str) -> DataFrame:
    imp = T.impressions(spark, d)
    raw = F.array_join(F.zip_with("inview", "labels", lambda i, y: F.concat_ws("-", F.lit("N"), i.cast("string"), y.cast("string"))), "  ")
    parsed = imp.select("row_id", X.impression_tokens(raw).alias("z"))
    return parsed.select("row_id", F.array_join(F.transform("z", lambda z: z["id"]), " ").alias("ids"), F.array_join(F.transform("z", lambda z: z["label"]), ",").alias("labels"))


@query("select doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as n from documents", views=False)
def split_words(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "documents").select("doc_id", F.size(X.words_or_empty(F.regexp_replace("text", r"[^\S\n\t\r\f ]", "x"))).cast("long").alias("n"))


@query("select p_partkey as item, p_name || ';' || p_brand || ';' || p_type as forms, 'Q' || p_partkey || case when p_size > 25 then ',B' || p_size else '' end as ids from part", views=False)
def entity_parse(spark: SparkSession, d: str) -> DataFrame:
    one = lambda i, *forms: F.struct(i.alias("WikidataId"), F.array(*forms).alias("SurfaceForms"))
    title = F.to_json(F.array(one(F.concat(F.lit("Q"), F.col("p_partkey")), F.col("p_name"), F.col("p_brand"))))
    body = F.to_json(F.array(one(F.when(F.col("p_size") > 25, F.concat(F.lit("B"), F.col("p_size"))).otherwise(""), F.col("p_type"))))
    forms = F.array_join(X.entity_forms(title, body), ";")
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("item"), forms.alias("forms"), F.array_join(X.entity_ids(title, body), ",").alias("ids"))


@query(
    """select p_partkey as item, round(p_size / 50.0::double * 2 - 1, 6) as scaled, greatest(least(p_size / 50.0::double, 1 - 1e-11), 1e-11) as clipped, (p_size >= 25)::int as big,
case p_type when 'STANDARD' then 'A' when 'SMALL' then 'B' else 'MSC' end as code, (p_size * (p_size - 1) * (p_size - 2) / 6)::double as threes,
(p_partkey // 86400) || ' days ' || (p_partkey // 3600 % 24) || ':' || (p_partkey // 60 % 60) || ':' || (p_partkey % 60) as took from part""",
    views=False,
)
def scalar_formulas(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return T.read(spark, d, "part").select(
        F.col("p_partkey").alias("item"),
        r6(S.scale_range(size.cast("double"), F.lit(0.0), F.lit(50.0), -1.0, 1.0), "scaled"),
        S.clip_probability(size / F.lit(50.0)).alias("clipped"),
        S.to_binary(size, 25).alias("big"),
        S.map_value(F.col("p_type"), {"STANDARD": "A", "SMALL": "B"}, "MSC").alias("code"),
        S.combinations(size, 3).alias("threes"),
        S.duration_text(F.col("p_partkey")).alias("took"),
    )


@query("select ts::date::varchar as day, round(count(*) filter (event_type <> 'click') / nullif(count(*) filter (event_type = 'click'), 0), 6)::double as ratio from events group by 1", views=False)
def negatives_by_day(spark: SparkSession, d: str) -> DataFrame:
    click = F.count_if(F.col("event_type") == "click")
    days = T.read(spark, d, "events").groupBy(S.date_part(F.col("ts")).cast("string").alias("day"))
    return days.agg(r6(S.positives_ratio(click, F.count(F.lit(1)) - click), "ratio"))


@query(
    """select row_id, array_to_string(list_distinct_sorted, ',') as different, array_to_string(list_concat(inview, [-1]), ',') as appended, inview[-1:][1] as last, inview[1] as first, len(inview) as zeros,
array_to_string(list_filter(list_transform(inview, lambda x: case when x % 2 = 0 then x end), lambda x: x is not null), ',') as known, array_to_string(list_filter(inview, lambda x: x in (1, 2, 3, 5, 8)), ',') as keyed
from (select *, list_sort(list_distinct(inview)) as list_distinct_sorted from impressions)"""
)
def list_helpers(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("inview")
    keys = F.map_from_arrays(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3, 5, 8)]), F.array(*[F.lit(0)] * 5))
    return T.impressions(spark, d).select(
        "row_id",
        F.array_join(F.array_sort(L.distinct(c)), ",").alias("different"),
        F.array_join(L.append(c, F.lit(-1).cast("long")), ",").alias("appended"),
        F.get(L.last(c), F.lit(0)).alias("last"),
        L.first_element(c).alias("first"),
        F.size(L.zeros_like(c)).cast("long").alias("zeros"),
        F.array_join(L.drop_nulls(F.transform(c, lambda x: F.when(x % 2 == 0, x))), ",").alias("known"),
        F.array_join(L.keys_in(c, keys), ",").alias("keyed"),
    )


# --- joins of vectors and histories


@query("select p_partkey as item, embedding is not null as covered, round(embedding[2]::double, 6) as second from part left join embeddings on vec_id = p_partkey", views=False)
def joined_vectors(spark: SparkSession, d: str) -> DataFrame:
    found = join_vectors(T.articles(spark, d).select("item"), T.vectors(spark, d), "item")
    return found.select("item", F.col("vector").isNotNull().alias("covered"), r6(F.get("vector", F.lit(1)), "second"))


@query(
    """with e as (select row_id, embedding from (select row_id, unnest(inview) as item from impressions) join embeddings on vec_id = item)
select row_id, round(avg(embedding[1]::double), 5) + 0.0 as first, round(avg(embedding[64]::double), 5) + 0.0 as last from e group by row_id"""
)
def entity_mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.entity_mean(T.impressions(spark, d), T.vectors(spark, d), "row_id", "inview", "item", "vector")
    cell = lambda i, name: (F.round(F.element_at("vector", i), 5) + 0.0).alias(name)
    return v.select("row_id", cell(1, "first"), cell(-1, "last"))


@query(
    """with m as (select min(ts) + (max(ts) - min(ts)) / 2 as mid from events), h as (select user_id, string_agg(event_id::varchar, ',' order by ts, event_id) as past from events, m where ts < mid group by user_id)
select e.event_id, past from events e left join h using (user_id) where ts >= (select mid from m)""",
    views=False,
)
def fixed_history_join(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    mid = e.agg(F.min("us") + F.floor((F.max("us") - F.min("us")) / 2)).first()[0]
    past = history.fixed_history(e, mid, None, "user_id", "us", "event_id")
    joined = history.join_history(e.filter(F.col("us") >= mid), past, "user_id")
    return joined.select("event_id", F.array_join("event_id_fixed", ",").alias("past"))


# --- feature tables


@query(
    ASOF
    + """, ix as (select p_partkey, row_number() over (order by p_partkey) as ix from part),
hx as (select row_id, list(ix order by pos) as hist from h join ix on p_partkey = item group by 1)
select s.row_id, s.pos, ix.ix as cand_ix, s.label, array_to_string(list_concat(list_transform(range(4 - len(coalesce(hist[-4:], []))), lambda x: 0), coalesce(hist[-4:], [])), ',') as hist_ix
from shown s join ix on p_partkey = s.item left join hx using (row_id)"""
)
def features_unrolled(spark: SparkSession, d: str) -> DataFrame:
    hist = history.with_lists(T.impressions(spark, d), Q._asof_lists(spark, d), "row_id")
    table = features.feature_table(hist, T.articles(spark, d), "row_id", item="item")
    wide = features.unrolled(features.fixed_width(table, 4), "row_id")
    return wide.select("row_id", F.col("pos").cast("long").alias("pos"), "cand_ix", "label", F.array_join("hist_ix", ",").alias("hist_ix"))


# --- evaluation

RANKED3 = "k as (select row_id, list(item order by rank) as cands from cand_a where rank <= 3 group by row_id)"


@query(
    CLICKED
    + f""", {RANKED3}, hn as (select i.row_id, count(c.item) as n from impressions i left join clicks c on c.user_id = i.user_id and c.click_time < i.t group by 1),
r as (select c.row_id, case when row_id % 2 = 0 then 'val' else 'test' end as split, hn.n = 0 as cold, len(list_filter(clicked, lambda x: list_contains(coalesce(cands, []), x))) / len(clicked) as recall
  from c left join k using (row_id) join hn using (row_id) where len(clicked) > 0)
select s.split, s.slice, count(r.row_id) as n, round(avg(recall), 6) as recall from (select * from (values ('val'), ('test')) a(split), (values ('cold'), ('warm')) b(slice)) s
left join r on r.split = s.split and r.cold = (s.slice = 'cold') group by 1, 2"""
)
def recall_cold_warm(spark: SparkSession, d: str) -> DataFrame:
    lists = T.candidates(spark, d).filter("rank <= 3").groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"]).alias("candidates"))
    n = history.clicks_before(T.impressions(spark, d), T.clicks(spark, d), time="t", row="row_id").select(F.col("__row").alias("row_id"), F.col("__n").alias("n_history"))
    rows = _clicked(spark, d).join(lists, "row_id", "left").join(n, "row_id")
    rows = rows.withColumns({"candidates": F.coalesce("candidates", F.array().cast("array<bigint>")), "split": F.when(F.col("row_id") % 2 == 0, "val").otherwise("test")})
    return bm25.recall_by_history(rows, 3, gt="clicked").withColumn("recall", F.round("recall", 6))


HISTORY_SLICES = """hn as (select i.row_id, count(c.item) as n from impressions i left join clicks c on c.user_id = i.user_id and c.click_time < i.t group by 1),
sl as (select row_id, 'all' as slice from hn union all select row_id, case when n = 0 then 'cold' else 'warm' end from hn)"""


@query(
    f"""with {HISTORY_SLICES}, x as (select distinct slice, row_id, item from cand_a join sl using (row_id)),
u as (select row_id, run, ('0x' || substr(md5('42|' || row_id || '|' || run), 1, 8))::bigint::double / 4294967296.0::double >= {bootstrap.poisson_steps(1)[0]!r} as hit from (select distinct row_id from cand_a), (select unnest(range(1, 41)) as run)),
s as (select slice, run, count(distinct case when hit then item end) / (select count(*) from part) as share from x join u using (row_id) group by all)
select slice, round(any_value(v.value), 6)::double as value, round(quantile_cont(share, 0.025), 6) as ci_low, round(quantile_cont(share, 0.975), 6) as ci_high
from s join (select slice, count(distinct item) / (select count(*) from part) as value from x group by 1) v using (slice) group by slice"""
)
def coverage_intervals(spark: SparkSession, d: str) -> DataFrame:
    # a row draws once, before its slices and items
    n = history.clicks_before(T.impressions(spark, d), T.clicks(spark, d), time="t", row="row_id")
    rows = n.select(F.col("__row").alias("row_id"), F.when(F.col("__n") == 0, "cold").otherwise("warm").alias("slice"))
    drawn = bootstrap.poisson_weights(rows, "row_id", 40, 42).select("row_id", "slice", F.col("__drawn").alias("drawn"))
    shown = T.candidates(spark, d).select("row_id", "item").join(drawn, "row_id").withColumn("slice", F.explode(F.array(F.lit("all"), "slice")))
    size = T.articles(spark, d).agg(F.count_distinct("item").alias("size"))
    ci = bootstrap.coverage_ci(shown, "slice", "row_id", "item", size, runs=40, drawn="drawn")
    return ci.select("slice", r6("value"), r6("ci_low"), r6("ci_high"))


REPORT = f"""with {Q.POP}, {HISTORY_SLICES},
tied as (select row_id, label, rank, rank() over (partition by row_id order by score) + (count(*) over (partition by row_id, score) - 1) / 2 as tr from ranked),
sums as (select row_id, sum(label)::bigint as pos, (sum(tr) filter (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) as auc, 1 / min(rank) filter (label = 1) as mrr,
sum(case when label = 1 and rank <= 5 then 1 / log2(rank + 1) else 0 end) as d5, sum(case when label = 1 and rank <= 10 then 1 / log2(rank + 1) else 0 end) as d10 from tied group by row_id),
acc as (select *, case when pos > 0 then d5 / list_sum(list_transform(range(1, least(pos, 5) + 1), lambda i: 1 / log2(i + 1))) end as n5,
case when pos > 0 then d10 / list_sum(list_transform(range(1, least(pos, 10) + 1), lambda i: 1 / log2(i + 1))) end as n10 from sums),
cats as (select row_id, p_type, count(*) as c from cand_a left join part on p_partkey = item group by all),
dv as (select row_id, case when sum(c) < 2 then 0 else 1 - sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) end as ild from cats group by row_id),
nv as (select row_id, coalesce(avg(-log2(p)), 0) as novelty from cand_a left join pop using (item) group by row_id),
each as (select slice, row_id, unnest(['auc', 'mrr', 'ndcg_5', 'ndcg_10', 'ild', 'novelty']) as metric, unnest([auc, mrr, n5, n10, coalesce(ild, 0), coalesce(novelty, 0)]) as value
from sl left join acc using (row_id) left join dv using (row_id) left join nv using (row_id)),
known as (select * from each where value is not null),
dr as (select row_id, run, ('0x' || substr(md5('42|' || row_id || '|' || run), 1, 8))::bigint::double / 4294967296.0::double as u from hn, (select unnest(range(1, 65)) as run)),
wt as (select row_id, run, {Q.POISSON} as w from dr),
means as (select slice, metric, run, sum(w * value) / nullif(sum(w), 0) as m from known join wt using (row_id) group by all),
seen as (select distinct slice, row_id, item, p_type from cand_a join sl using (row_id) left join part on p_partkey = item),
size as (select count(distinct p_partkey) as parts, count(distinct p_type) as types from part),
shares as (select slice, run, count(distinct case when w > 0 then item end) / any_value(parts) as of_items, count(distinct case when w > 0 then p_type end) / any_value(types) as of_types from seen join wt using (row_id), size group by all),
cover as (select slice, 'article_coverage' as metric, run, of_items as m from shares union all select slice, 'category_coverage', run, of_types from shares),
whole as (select slice, count(distinct item) / any_value(parts) as of_items, count(distinct p_type) / any_value(types) as of_types from seen, size group by slice),
ns as (select slice, count(*) as n from sl group by slice),
vals as (select slice, metric, count(*) as n, avg(value) as value from known group by all union all
select slice, 'article_coverage', n, of_items from whole join ns using (slice) union all select slice, 'category_coverage', n, of_types from whole join ns using (slice)),
ci as (select slice, metric, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from (select * from means union all select * from cover) group by all)
select slice, metric, n, round(value, 9)::double as value, round(lo, 9) as ci_low, round(hi, 9) as ci_high from vals join ci using (slice, metric)"""


@query(REPORT)
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    n = history.clicks_before(T.impressions(spark, d), T.clicks(spark, d), time="t", row="row_id").select(F.col("__row").alias("row_id"), F.col("__n").alias("n_history"))
    report = evaluate.evaluation_report(Q._ranked(spark, d), n, T.articles(spark, d), Q._pop(spark, d), T.candidates(spark, d), runs=64)
    nine = [F.round(c, 9).alias(c) for c in ("value", "ci_low", "ci_high")]
    return report.select("slice", "metric", "n", *nine)


GRADED = "g as (select row_id, pos, p, label * (1 + pos % 3) as y from shown)"


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return T.shown(spark, d).select("row_id", "pos", "p", (F.col("label") * (1 + F.col("pos") % 3)).alias("y"))


@query(
    f"""with {GRADED}, r as (select *, row_number() over (partition by row_id order by p desc, pos desc) as a, row_number() over (partition by row_id order by y desc, pos) as b from g),
x as (select row_id, sum(case when a <= 4 then (pow(2, y) - 1) / log2(a + 1) else 0 end) as dcg, sum(case when b <= 4 then (pow(2, y) - 1) / log2(b + 1) else 0 end) as best from r group by row_id)
select row_id, round(dcg, 6) as dcg, round(dcg / nullif(best, 0), 6) as ndcg from x"""
)
def ndcg_graded(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.dcg(_graded(spark, d), "row_id", 4).select("row_id", r6("dcg"), r6("ndcg"))


@query(
    """with s as (select row_id, sqrt(avg(pow(label - p, 2))) as rmse, avg((label = (p >= 0.4)::int)::int) as acc from shown group by row_id)
select 'rmse' as metric, round(avg(rmse), 6) as value from s union all select 'accuracy', round(avg(acc), 6) from s"""
)
def metric_suite(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.metric_suite(T.shown(spark, d).withColumnRenamed("label", "y"), "row_id", ["rmse", "accuracy"], threshold=0.4)
    return m.select("metric", r6("value"))


@query(
    """with o as (select label, p, row_number() over (order by row_id, pos) - 1 as i, sum(label) over () as n from shown), c as (select *, i // n::bigint as chunk from o),
t as (select chunk, label, rank() over (partition by chunk order by p) + (count(*) over (partition by chunk, p) - 1) / 2 as tr from c),
a as (select (sum(tr) filter (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) as auc from t group by chunk)
select round(avg(auc), 6) as auc from a"""
)
def auc_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    flat = T.shown(spark, d).select(F.struct("row_id", "pos").alias("o"), F.col("label").alias("y"), "p")
    return evaluate.chunked_auc(flat, "o").select(r6("auc"))


@query("select row_id, round(avg(p_retailprice), 4) as mean from (select row_id, unnest(inview) as item from impressions) left join part on p_partkey = item group by row_id")
def list_means(spark: SparkSession, d: str) -> DataFrame:
    prices = T.read(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_retailprice")
    return evaluate.list_mean(T.impressions(spark, d), "inview", prices, "row_id", "item", "p_retailprice").select("row_id", F.round("mean", 4).alias("mean"))


@query("select count(distinct item) as n, round(count(distinct item) / (select count(*) from part), 6)::double as share from cand_a")
def distinct_share(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.distinct_share(T.candidates(spark, d), "item", T.articles(spark, d)).select("n", r6("share"))


@query(f"with {Q.POP}, e as (select row_id, unnest(list_filter(inview, lambda x: x % 2 = 0)) as item from impressions) select i.row_id, round(avg(-log2(p)), 6) as novelty from impressions i left join e using (row_id) left join pop using (item) group by 1")
def novelty_of_lists(spark: SparkSession, d: str) -> DataFrame:
    even = T.impressions(spark, d).withColumn("inview", F.filter("inview", lambda x: x % 2 == 0))
    return evaluate.list_novelty(even, "inview", Q._pop(spark, d), "row_id", "item").select("row_id", r6("novelty"))
