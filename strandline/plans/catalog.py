"""Named plans over the driver tables, and the SQL they are held against.

The site matrix: site = l_partkey, sample = l_linenumber, beta = mean discount
scaled into (0, 1); groups A = samples 1-4 and B = 5-7 (cases); chromosome =
p_partkey div 50, position = 100 p_partkey + p_size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.stats import correlation_p, dot, m_value
from strandline.operators import connect, graph, intervals, motifs, ordering, regions, resampling, scoring, simulate
from strandline.plans import finder

GROUPS = {"A": [0, 1, 2, 3], "B": [4, 5, 6]}
TEST = {"strong": connect.Test(0.9, "strong", 140, 0.25), "weak": connect.Test(0.5, "weak", 140, 0.25)}
WIDTH = 2000

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plan(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        PLANS[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PLANS["seed_runs"](spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("site"), F.col("l_linenumber").cast("long").alias("sample")).agg((F.avg("l_discount") * 9.8 + 0.01).alias("beta"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("site"), F.floor(F.col("p_partkey") / 50).cast("long").alias("chr"), (F.col("p_partkey") * 100 + F.col("p_size")).alias("pos"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connect.pack(cells(spark, sf_dir), sites(spark, sf_dir), list(range(1, 8)))


def the_edges(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return connect.edges(packed(spark, sf_dir), GROUPS, "B", "A", TEST[mode])


def windows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 50).cast("long").alias("chr"), (F.col("p_partkey") * 100).alias("start"), (F.col("p_partkey") * 100 + F.col("p_size") * 4).alias("end"))


def genes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    start = F.col("s_suppkey") * 1900
    return s.select(F.col("s_suppkey").alias("id"), F.floor(start / 5000).cast("long").alias("chr"), start.alias("start"), (start + 700 + F.col("s_nationkey") * 20).alias("end"))


def _near(e: str, n: int) -> str:
    """SQL that rounds as the plans do: no negative zero."""
    return f"case when round({e}, {n}) = 0 then 0.0::double else round({e}, {n}) end"


_CELL = "cell as (select l_partkey as site, l_linenumber as smp, avg(l_discount) * 9.8 + 0.01 as b from lineitem group by 1, 2)"
_SITE = "st as (select p_partkey as site, cast(floor(p_partkey / 50) as bigint) as chr, p_partkey * 100 + p_size as pos from part)"
_M = f"{_CELL}, {_SITE}, m as (select st.site, st.chr, st.pos, s.smp, case when s.smp <= 4 then 'A' else 'B' end as g, b, coalesce(log2(b / (1 - b + 1e-6) + 1e-6), 0) as mv from st cross join range(1, 8) s(smp) left join cell on cell.site = st.site and cell.smp = s.smp)"
_PAIR = f"""{_M}, nx as (select site, chr, pos, lead(site) over (partition by chr order by pos) as nsite, lead(pos) over (partition by chr order by pos) as npos from st),
 pr as (select nx.site, x.g, count(*) as n, covar_pop(x.mv, y.mv) / (case when stddev_pop(x.mv) > 1e-9 and stddev_pop(y.mv) > 1e-9 then stddev_pop(x.mv) * stddev_pop(y.mv) end) as r
        from nx join m x on x.site = nx.site join m y on y.site = nx.nsite and y.smp = x.smp group by 1, 2),
 pp as (select site, g, r, case when n = 4 then 1 - least(1.0, abs(r)) else 1 - 2 / pi() * asin(least(1.0, abs(r))) end as p from pr),
 dl as (select site, avg(case when g = 'B' then b end) - avg(case when g = 'A' then b end) as d from m group by 1)"""


def _edge_sql(mode: str) -> str:
    t = TEST[mode]
    limit = t.max_pval / 2 if mode == "strong" else t.max_pval
    passed = "fa = '' and fb = ''" if mode == "strong" else "fa = '' or fb = ''"
    failing = "case when fa <> '' then 'A' else 'B' end" if mode == "strong" else "concat_ws(';', case when fa <> '' then 'A' end, case when fb <> '' then 'B' end)"
    return f"""{_PAIR}, w as (select nx.*, a.p as pa, b.p as pb, dl.d,
   case when a.r is null then 'na r' when a.p > {limit} then 'pval>max_pval' else '' end as fa,
   case when b.r is null then 'na r' when b.p > {limit} then 'pval>max_pval' else '' end as fb,
   nsite is null as is_last, coalesce(npos - pos > {t.max_distance}, false) as far, coalesce(abs(dl.d) >= {t.rescue_delta}, false) as resc
   from nx left join pp a on a.site = nx.site and a.g = 'A' left join pp b on b.site = nx.site and b.g = 'B' left join dl on dl.site = nx.nsite),
 e as (select site, chr, pos, nsite as next_site, not is_last and not far and (resc or ({passed})) as connected,
   case when not is_last and not far and not resc then greatest(pa, pb) end as pval,
   case when is_last then 'end-of-input' when far then 'exceeded max distance' when resc then 'abs(delta_beta)>=force_connect_delta_beta' when {passed} then '' when fa <> '' then fa else fb end as reason,
   case when not is_last and not far and not resc and not ({passed}) then {failing} end as failing, d as delta from w)"""


def _edge_plan(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = the_edges(spark, sf_dir, mode)
        return e.select("site", "chr", "pos", "next_site", "connected", F.round("pval", 7).alias("pval"), "reason", "failing", F.round("delta", 7).alias("delta"))

    return run


for _mode in ("strong", "weak"):
    PLANS[f"edges_{_mode}"] = _edge_plan(_mode)
    ORACLES[f"edges_{_mode}"] = f"with {_edge_sql(_mode)} select site, chr, pos, next_site, connected, {_near("pval", 7)} as pval, reason, failing, {_near("delta", 7)} as delta from e"

_RUNS = f"""{_edge_sql("weak")}, i as (select *, coalesce(sum(case when connected then 0 else 1 end) over (partition by chr order by pos rows between unbounded preceding and 1 preceding), 0) as run from e),
 r as (select chr, cast(run as bigint) as run, min(site) as start_seed, max(site) as end_seed, min(pos) as start, max(pos) as "end", count(*) as seeds_num, avg(case when connected then pval end) as p from i group by 1, 2 having count(*) >= 2)"""


@plan(f"with {_CELL} select site, cast(smp as bigint) as sample, round(b, 9) as beta from cell")
def beta_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("site", "sample", F.round("beta", 9).alias("beta"))


@plan(f"with {_CELL} select site, cast(smp as bigint) as sample, {_near("log2(b / (1 - b + 1e-6) + 1e-6)", 7)} as m from cell")
def mvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("site", "sample", F.round(m_value(F.col("beta")), 7).alias("m"))


@plan(f"with {_PAIR} select site, g as grp, {_near("r", 7)} as r, {_near("p", 7)} as p from pp")
def pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = connect.adjacent(connect.units(packed(spark, sf_dir), GROUPS).drop("beta")).where("next_site is not null")
    rows = F.array(*(F.struct(F.lit(g).alias("grp"), dot(F.col(f"unit_{g}"), F.col(f"next_unit_{g}")).alias("r"), F.lit(len(k)).alias("n")) for g, k in GROUPS.items()))
    x = pairs.select("site", F.explode(rows).alias("x")).select("site", "x.*")
    p = F.when(F.col("n") == 4, correlation_p(F.col("r"), 2)).otherwise(correlation_p(F.col("r"), 1))
    return x.select("site", "grp", F.round("r", 7).alias("r"), F.round(p, 7).alias("p"))


@plan(f'with {_RUNS} select chr, run, start_seed, end_seed, start, "end", seeds_num, {_near("p", 6)} as pval from r')
def seed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.runs(the_edges(spark, sf_dir, "weak")).select("chr", "run", "start_seed", "end_seed", "start", "end", "seeds_num", F.round("connection_corr_pval", 6).alias("pval"))


@plan("""with x as (select cast(floor(p_partkey / 50) as bigint) as chr, p_partkey * 100 as s, p_partkey * 100 + p_size * 4 as e from part),
 y as (select *, max(e) over (partition by chr order by s, e rows between unbounded preceding and 1 preceding) as reach from x),
 z as (select *, sum(case when reach is null or s > reach + 1 then 1 else 0 end) over (partition by chr order by s, e rows unbounded preceding) as i from y)
 select chr, min(s) as start, max(e) as "end", count(*) as merged from z group by chr, i""")
def merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.merge_intervals(windows_of(spark, sf_dir))


_BOUND = f"""{_edge_sql("weak")}, n as (select *, row_number() over (partition by chr order by pos) as site_idx from e),
 bd as (select *, max(case when not connected then site_idx end) over (partition by chr order by pos rows unbounded preceding) as prev_failed,
        min(case when not connected then site_idx end) over (partition by chr order by pos rows between current row and unbounded following) as next_failed from n)"""


@plan(f"with {_BOUND} select site, chr, site_idx, prev_failed, next_failed from bd")
def boundary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.boundaries(the_edges(spark, sf_dir, "weak")).select("site", "chr", "site_idx", "prev_failed", "next_failed")


@plan(f"""with {_BOUND}, sd as (select chr, site, site_idx, prev_failed, next_failed from bd),
 x as (select sd.chr, sd.site as seed, coalesce(p.prev_failed, 0) + 1 as start_idx, sd.next_failed as end_idx from sd left join bd p on p.chr = sd.chr and p.site_idx = sd.site_idx - 1)
 select x.chr, x.seed, start_idx, end_idx, a.pos as start_pos, b.pos as end_pos, end_idx - start_idx + 1 as sites_num
 from x join bd a on a.chr = x.chr and a.site_idx = start_idx join bd b on b.chr = x.chr and b.site_idx = end_idx""")
def expand_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = the_edges(spark, sf_dir, "weak")
    seeds = sites(spark, sf_dir).select("chr", F.col("site").alias("start_seed"), F.col("site").alias("end_seed"))
    return regions.expand(seeds, e).select("chr", F.col("start_seed").alias("seed"), "start_idx", "end_idx", "start_pos", "end_pos", "sites_num")


_STATS = f"""{_CELL}, ss as (select site, avg(case when smp > 4 then b end) as cb, avg(case when smp <= 4 then b end) as kb, stddev_samp(case when smp > 4 then b end) as cs, stddev_samp(case when smp <= 4 then b end) as ks,
 count(case when smp > 4 then b end) as cn, count(case when smp <= 4 then b end) as kn from cell group by 1)"""


@plan(f"with {_STATS} select site, round(cb, 7) as cases_beta, round(kb, 7) as controls_beta, round(cs, 7) as cases_sd, round(ks, 7) as controls_sd, cn as cases_num, kn as controls_num, {_near("cb - kb", 7)} as delta_beta from ss")
def site_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = regions.site_stats(cells(spark, sf_dir).withColumn("is_case", F.col("sample") > 4))
    return s.select("site", *(F.round(c, 7).alias(c) for c in ("cases_beta", "controls_beta", "cases_sd", "controls_sd")), "cases_num", "controls_num", F.round("delta_beta", 7).alias("delta_beta"))


@plan(f"""with {_STATS} select cast(floor(p_partkey / 20) as bigint) as region, round(case when count(cb - kb) = count(*) then median(abs(cb - kb)) * sign(sum(sign(cb - kb))) end, 6) as delta_beta,
 count(*) as sites_num, {_near("min(cb - kb)", 6)} as min_delta, {_near("max(cb - kb)", 6)} as max_delta from part left join ss on ss.site = p_partkey group by 1""")
def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = regions.site_stats(cells(spark, sf_dir).withColumn("is_case", F.col("sample") > 4))
    m = sites(spark, sf_dir).join(s, "site", "left").withColumn("region", F.floor(F.col("site") / 20).cast("long"))
    return regions.region_stats(m).select("region", F.round("delta_beta", 6).alias("delta_beta"), "sites_num", F.round("min_delta", 6).alias("min_delta"), F.round("max_delta", 6).alias("max_delta"))


_IV = """a as (select p_partkey as id, cast(floor(p_partkey / 50) as bigint) as chr, p_partkey * 100 as s, p_partkey * 100 + p_size * 4 as e from part),
 b as (select s_suppkey as id, cast(floor(s_suppkey * 1900 / 5000) as bigint) as chr, s_suppkey * 1900 as s, s_suppkey * 1900 + 700 + s_nationkey * 20 as e from supplier)"""


@plan(f"""with {_IV} select a.id as a_id, b.id as b_id, a.chr, greatest(a.s, b.s) as start, least(a.e, b.e) as "end" from a join b on a.chr = b.chr and a.s <= b.e and b.s <= a.e""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlaps(windows_of(spark, sf_dir), genes_of(spark, sf_dir), WIDTH)


@plan(f"""with {_IV} select a.id, string_agg(distinct cast(b.id as varchar), ',' order by cast(b.id as varchar)) as genes from a left join b on a.chr = b.chr and a.s <= b.e and b.s <= a.e group by 1""")
def gene_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.annotate(windows_of(spark, sf_dir), genes_of(spark, sf_dir).withColumnRenamed("id", "symbol"), WIDTH)


@plan(f"""with {_IV} select b.id, greatest(count(a.id), 1) as background from b left join a on a.chr = b.chr and a.s between b.s and b.e group by 1""")
def overlap_count_min1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.background_counts(genes_of(spark, sf_dir), windows_of(spark, sf_dir).withColumn("end", F.col("start")), WIDTH)


@plan(f"""with {_IV}, x as (select a.id, b.id as span, row_number() over (partition by a.id order by (floor((a.s + a.e) / 2) between b.s and b.e) desc, least(a.e, b.e) - greatest(a.s, b.s) desc, b.id) as k
 from a join b on a.chr = b.chr and a.s <= b.e and b.s <= a.e) select id, span from x where k = 1""")
def span_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.assign_spans(windows_of(spark, sf_dir), genes_of(spark, sf_dir), WIDTH)


def _union_sql(x: str) -> str:
    return f"""(select chr, min(s) as s, max(e) as e from (select *, sum(case when reach is null or s > reach + 1 then 1 else 0 end) over (partition by chr order by s, e rows unbounded preceding) as i
 from (select *, max(e) over (partition by chr order by s, e rows between unbounded preceding and 1 preceding) as reach from {x})) group by chr, i)"""


@plan(f"""with {_IV}, u as {_union_sql("a")}, v as {_union_sql("b")}, h as (select a.id as x, b.id as y from a join b on a.chr = b.chr and a.s <= b.e and b.s <= a.e),
 q as (select (select count(distinct x) from h) as tp, (select count(*) from a) as na, (select count(distinct y) from h) as ht, (select count(*) from b) as nb,
 (select sum(least(u.e, v.e) - greatest(u.s, v.s) + 1) from u join v on u.chr = v.chr and u.s <= v.e and v.s <= u.e) as both_bp, (select sum(e - s + 1) from u) as bu, (select sum(e - s + 1) from v) as bv)
 select tp, round(tp / na, 9) as prec, round(ht / nb, 9) as recall, round(both_bp / bu, 9) as bp_prec, round(both_bp / bv, 9) as bp_recall, round(both_bp / (bu + bv - both_bp), 9) as bp_jaccard from q""")
def overlap_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = intervals.overlap_metrics(windows_of(spark, sf_dir), genes_of(spark, sf_dir), WIDTH)
    return m.select("tp", *(F.round(c, 9).alias(c) for c in m.columns if c != "tp"))


@plan(f"""with {_PAIR}, x as (select nx.chr, pp.site, p from pp join nx on nx.site = pp.site where g = 'A' and p is not null),
 y as (select *, p * count(*) over (partition by chr) / row_number() over (partition by chr order by p, site) as q from x)
 select chr, site, {_near("p", 6)} as p, round(least(1.0, min(q) over (partition by chr order by p desc, site desc rows unbounded preceding)), 6) as fdr from y""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = connect.adjacent(connect.units(packed(spark, sf_dir), {"A": GROUPS["A"]}).drop("beta")).where("next_site is not null")
    p = correlation_p(dot(F.col("unit_A"), F.col("next_unit_A")), 2)
    x = pairs.select("chr", "site", p.alias("p")).where("p is not null")
    return ordering.benjamini_hochberg(x, "chr", "p", "site").select("chr", "site", F.round("p", 6).alias("p"), F.round("fdr", 6).alias("fdr"))


_EV = "ev as (select user_id, epoch_us(ts) as t from events)"


@plan(f"with {_EV}, x as (select user_id, t, event_gap > 21600000000 as new from (select *, t - lag(t) over (partition by user_id order by t) as event_gap from ev)) select user_id, t, cast(sum(case when new then 1 else 0 end) over (partition by user_id order by t rows unbounded preceding) as bigint) as cluster from x")
def cluster_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return ordering.clusters_by_gap(e, "user_id", "t", 21600000000)


@plan(f"""with {_EV}, g as (select user_id, (t - lag(t) over (partition by user_id order by t)) / 1e6 as gap from ev), s as (select user_id, list_sort(list(gap)) as v from g where gap is not null group by 1),
 h as (select user_id, v, len(v) as n, (len(v) + 1/3) * 0.95 + 1/3 as h from s)
 select user_id, round(greatest(2500.0, least(500000.0, 1.5 * (v[greatest(1, least(n, floor(h)))::int] + (h - floor(h)) * (v[greatest(1, least(n, floor(h) + 1))::int] - v[greatest(1, least(n, floor(h)))::int])))), 5) as threshold from h""")
def gap_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    g = e.withColumn("gap", (F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t"))) / 1e6).where("gap is not null")
    return ordering.gap_threshold(g, "user_id", "gap", high=500000.0).select("user_id", F.round("threshold", 5).alias("threshold"))


@plan("select user_id, round(1.4826 * mad(value), 6) as mad from events group by 1")
def mad_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    mid = e.groupBy("user_id").agg(F.median("value").alias("mid"))
    return e.join(mid, "user_id").groupBy("user_id").agg(F.round(F.median(F.abs(F.col("value") - F.col("mid"))) * 1.4826, 6).alias("mad"))


@plan("select p_partkey, p_brand, rk from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rk from part) where rk <= 10")
def topk_per_chr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.top_k(table(spark, sf_dir, "part"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 10).select("p_partkey", "p_brand", F.col("rk").cast("long").alias("rk"))


@plan("select c_custkey, cast((row_number() over (partition by c_mktsegment order by c_custkey) - 1) % 5 as bigint) as fold from customer")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.stratified_folds(table(spark, sf_dir, "customer"), "c_mktsegment", [F.col("c_custkey")], 5).select("c_custkey", "fold")


@plan("select l_partkey, l_linenumber, cast(sum(l_quantity) as double) as total, count(*) as collapsed from lineitem group by 1, 2")
def collapse_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.sum("l_quantity").cast("double").alias("total"), F.count(F.lit(1)).alias("collapsed"))


@plan("""with n as (select case when n_nationkey < 20 then 'chr' || (n_nationkey + 1) else ['chrX', 'chrY', 'chrM', 'chrMT', 'chrUn'][n_nationkey - 19] end as chr from nation)
 select chr, row_number() over (order by try_cast(replace(chr, 'chr', '') as int) is null, coalesce(try_cast(replace(chr, 'chr', '') as int), 0), case chr when 'chrX' then 1 when 'chrY' then 2 when 'chrM' then 3 when 'chrMT' then 4 else 9 end, chr) as place from n""")
def natural_chr_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.col("n_nationkey")
    chrom = F.when(n < 20, F.concat(F.lit("chr"), (n + 1).cast("string"))).otherwise(F.element_at(F.array(*map(F.lit, ("chrX", "chrY", "chrM", "chrMT", "chrUn"))), F.greatest(n - 19, F.lit(1))))
    x = table(spark, sf_dir, "nation").select(chrom.alias("chr"))
    return x.select("chr", F.row_number().over(Window.orderBy(ordering.natural_key(F.col("chr")))).cast("long").alias("place"))


@plan("select p_partkey, 'chr' || (p_size % 22) as chr, cast(p_partkey * 1000 as bigint) as start, cast(p_partkey * 1000000 as bigint) as \"end\" from part")
def parse_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("chr"), (F.col("p_size") % 22).cast("string"), F.lit(":"), F.col("p_partkey").cast("string"), F.lit("kb-"), F.col("p_partkey").cast("string"), F.lit("Mb"))
    return table(spark, sf_dir, "part").select("p_partkey", ordering.parse_region(text).alias("r")).select("p_partkey", "r.*")


_SEQ = """q as (select doc_id, lang, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as t from documents),
 w as (select doc_id, lang, substr(t, k, 12) as seq from (select doc_id, lang, t, unnest(range(1, len(t) - 10)) as k from q where len(t) >= 12) where substr(t, k + 5, 2) in ('CG', 'GC'))"""


@plan(f"""with {_SEQ}, o as (select doc_id, case when substr(seq, 6, 1) = 'G' then translate(seq, 'ACGT', 'TGCA') else seq end as one from w),
 r as (select doc_id, case when substr(one, 6, 1) <> 'C' and substr(one, 7, 1) = 'G' then reverse(translate(one, 'ACGT', 'TGCA')) else one end as oriented from o)
 select doc_id, oriented, count(*) as n from r group by 1, 2""")
def motif_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select("doc_id", motifs.oriented(F.col("seq"), 5).alias("oriented")).groupBy("doc_id", "oriented").agg(F.count(F.lit(1)).alias("n"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of 12 letters about every CG or GC of every whole text."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    seq = F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(motifs.windows(seq, 5, ("CG", "GC"))).alias("seq"))


@plan(f"""with {_SEQ}, s as (select lang, k as place, substr(seq, k, 1) as b from w cross join range(1, 13) t(k)),
 c as (select lang, place, count(*) as n, sum((b = 'A')::int) / count(*) as a, sum((b = 'C')::int) / count(*) as c, sum((b = 'G')::int) / count(*) as g, sum((b = 'T')::int) / count(*) as t from s group by 1, 2)
 select lang, place, round(a, 9) as f_a, round(c, 9) as f_c, round(g, 9) as f_g, round(t, 9) as f_t, case when a = greatest(a, c, g, t) then 'A' when c = greatest(a, c, g, t) then 'C' when g = greatest(a, c, g, t) then 'G' else 'T' end as base from c""")
def pwm_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = motifs.pwm(_sequences(spark, sf_dir), "lang", "seq", 12)
    return p.select("lang", "place", *(F.round(c, 9).alias(c) for c in ("f_a", "f_c", "f_g", "f_t")), "base")


@plan(f"with {_CELL} select l.site, l.smp as sample, {_near("l.b - (r.i + r.s * l.smp)", 9)} as residual from (select site, cast(smp as bigint) as smp, b from cell) l join (select site, regr_intercept(b, smp) as i, regr_slope(b, smp) as s, count(*) as n from cell group by 1) r using (site) where n = 7")
def ols_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = connect.design_basis([{"x": k} for k in range(1, 8)], ["x"])
    x = packed(spark, sf_dir).select("site", F.posexplode(connect.residual(F.col("beta"), basis)).alias("p", "residual"))
    return x.select("site", (F.col("p") + 1).cast("long").alias("sample"), F.round(F.col("residual") + 0.0, 9).alias("residual"))


_VEC = """v as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
 u as (select id, flatten(list_transform(range(0, 16), lambda k: list_transform(list_slice(e, 4 * k + 1, 4 * k + 4), lambda z: z / sqrt(list_sum(list_transform(list_slice(e, 4 * k + 1, 4 * k + 4), lambda q: q * q)))))) as vec from v),
 pr as (select a.id as id1, b.id as id2, list_sum(list_transform(range(1, 65), lambda i: a.vec[i] * b.vec[i])) / 16 as sim from u a join u b on a.id < b.id),
 hit as (select * from pr where sim >= 0.375)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen unit vectors of four from each embedding, in place of a matrix's places."""
    place = lambda k: F.transform(F.slice("embedding", 4 * k + 1, 4), lambda z: z.cast("double"))
    unit = lambda p: F.transform(F.array(F.sqrt(F.aggregate(p, F.lit(0.0), lambda s, z: s + z * z))), lambda n: F.transform(p, lambda z: z / n))[0]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(*(unit(place(k)) for k in range(16))).alias("vec"))


@plan(f"with {_VEC} select id1, id2, round(sim, 6) as sim from hit")
def motif_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.similar_pairs(vectors(spark, sf_dir), 0.375, 16).select("id1", "id2", F.round("sim", 6).alias("sim"))


@plan(f"""with {_VEC}, s as (select vec_id as id, label as score from embeddings)
 select case when a.score >= b.score then id1 else id2 end as index1, case when a.score >= b.score then id2 else id1 end as index2, round(sim, 6) as sim from hit join s a on a.id = id1 join s b on b.id = id2
 union all select id2, id1, round(sim, 6) from hit join s a on a.id = id1 join s b on b.id = id2 where a.score = b.score""")
def oriented_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("score"))
    return graph.oriented(graph.similar_pairs(vectors(spark, sf_dir), 0.375, 16), scores).select("index1", "index2", F.round("sim", 6).alias("sim"))


def _least_label_sql(rounds: int) -> str:
    """SQL that hands the least label on to neighbours so many times, which reaches every end of a component of that diameter."""
    steps = [f"m{k + 1} as (select m{k}.id, least(any_value(m{k}.root), min(o.root)) as root from m{k} join g on g.a = m{k}.id join m{k} o on o.id = g.b group by m{k}.id)" for k in range(rounds)]
    return ", ".join(["m0 as (select distinct a as id, a as root from g)", *steps]) + f" select id, root from m{rounds}"


@plan(f"""with e as (select distinct l_orderkey * 2 as a, l_partkey * 2 + 1 as b from lineitem), g as materialized (select a, b from e union all select b, a from e), {_least_label_sql(16).replace(" as (select m", " as materialized (select m")}""")
def motif_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return graph.components(x.select((F.col("l_orderkey") * 2).alias("id1"), (F.col("l_partkey") * 2 + 1).alias("id2"))).select("id", "root")


@plan(f"""with {_IV}, n as (select b.id, greatest(count(a.id), 1) as background, b.e - b.s as size from b left join a on a.chr = b.chr and a.s between b.s and b.e group by 1, 3)
 select id, background, cast(ceil(size / 100.0 / background * 3) as bigint) as seeds_num_adj from n""")
def adjusted_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = genes_of(spark, sf_dir)
    n = intervals.background_counts(genes, windows_of(spark, sf_dir).withColumn("end", F.col("start")), WIDTH).join(genes, "id")
    return n.select("id", "background", F.ceil((F.col("end") - F.col("start")) / 100.0 / F.col("background") * 3).cast("long").alias("seeds_num_adj"))


@plan("select user_id, round((value - min(value) over ()) / greatest(max(value) over () - min(value) over (), 1e-10), 7) as scaled, event_id from events")
def min_max_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    span = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # one row
    return e.crossJoin(F.broadcast(span)).select("user_id", F.round((F.col("value") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-10)), 7).alias("scaled"), "event_id")


@plan("""with p as (select l_orderkey, l_linenumber, (l_discount * 100 + 0.5) / (l_quantity + 1) as p from lineitem) select l_orderkey, l_linenumber, round(p, 7) as share, round(ln(least(1 - 1e-6, greatest(1e-6, p)) / (1 - least(1 - 1e-6, greatest(1e-6, p)))), 6) as logit from p""")
def smoothed_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = simulate.share(F.col("l_discount") * 100, F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(p, 7).alias("share"), F.round(simulate.logit(p), 6).alias("logit"))


@plan("""with x as (select p_partkey, p_brand, p_retailprice as pos, min(p_retailprice) over (partition by p_brand) as f, max(p_retailprice) over (partition by p_brand) as l from part),
 y as (select *, greatest(l - f, 1) as w from x), z as (select *, greatest(l + 0.2 * w - (f - 0.2 * w), 1.0) / 2 as half, f - 0.2 * w as a from y)
 select p_partkey, round(case when f = l then 1 else pow(1 - pow(least(1.0, abs(pos - (a + half)) / half), 4), 4) end, 6) as effect from z""")
def effect_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w, pos = Window.partitionBy("p_brand"), F.col("p_retailprice")
    x = table(spark, sf_dir, "part").withColumn("f", F.min(pos).over(w)).withColumn("l", F.max(pos).over(w))
    return x.select("p_partkey", F.round(simulate.profile(pos, F.col("f"), F.col("l")), 6).alias("effect"))


@plan("""with k as (select *, row_number() over (partition by p_brand order by p_size desc, p_partkey) as place from part), c as (select p_brand, max(p_retailprice) as best from part group by 1),
 o as (select p_brand, row_number() over (order by best desc, p_brand) as rank from c) select k.p_brand, p_partkey, rank from k join o on o.p_brand = k.p_brand where rank <= 5 and place <= 3""")
def topk_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part")
    best = p.groupBy("p_brand").agg(F.max("p_retailprice").alias("best"))  # a row per component
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("best"), "p_brand")).cast("long")).where("rank <= 5")
    return ordering.top_k(p, "p_brand", [F.desc("p_size"), F.col("p_partkey")], 3).join(best, "p_brand").select("p_brand", "p_partkey", "rank")


_CNT = "select l_partkey // 50 as chr, l_partkey * 100 as pos, l_linenumber as sample, sum(cast(round(l_discount * l_quantity) as bigint)) as m, sum(cast(l_quantity as bigint)) as cov from lineitem group by 1, 2, 3"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(F.floor(F.col("l_partkey") / 50).cast("long").alias("chr"), (F.col("l_partkey") * 100).alias("pos"), F.col("l_linenumber").alias("sample")).agg(
        F.sum(F.round(F.col("l_discount") * F.col("l_quantity")).cast("long")).alias("m"), F.sum(F.col("l_quantity").cast("long")).alias("cov"))


@plan(f"""with c as ({_CNT}), d as (select distinct chr, pos from c), x as (select chr, pos, case when coalesce(pos - lag(pos) over (partition by chr order by pos) > 100, true) then pos end as f from d)
 select chr, pos, concat_ws(':', chr, max(f) over (partition by chr order by pos)) as cluster from x""")
def simulation_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.loci(counts(spark, sf_dir), 100)


def _sheet(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, "A" if s <= 4 else "B", s > 4) for s in range(1, 8)], "sample long, grp string, is_case boolean")


@plan()
def find_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = finder.Options(max_pval=0.5, mode="weak", rescue_delta=0.25, max_distance=140, bridge_seeds=0, bridge_sites=0, min_sites=2, statistic="mean")
    st = sites(spark, sf_dir)
    return finder.find_regions(cells(spark, sf_dir), st, st.select("site"), _sheet(spark), o, width=WIDTH)


@plan(f"""with {_M}, t as (select site, chr, count(b) as n, case when stddev_pop(mv) * stddev_pop((g = 'B')::int) > 1e-12 then covar_pop(mv, (g = 'B')::int) / (stddev_pop(mv) * stddev_pop((g = 'B')::int)) end as r,
 avg(case when g = 'B' then b end) - avg(case when g = 'A' then b end) as d from m where b is not null group by 1, 2),
 s as (select *, least(1.0, abs(r)) as sn, sqrt(1 - least(1.0, abs(r)) ** 2) as cs, asin(least(1.0, abs(r))) as th from t where n >= 3 and r is not null and d is not null),
 p as (select site, chr, d, greatest(0.0, case n when 3 then 1 - 2 / pi() * th when 4 then 1 - sn when 5 then 1 - 2 / pi() * (th + sn * cs) when 6 then 1 - sn * (1 + cs * cs / 2) else 1 - 2 / pi() * (th + sn * cs * (1 + 2.0 / 3 * cs * cs)) end) as pval from s),
 y as (select *, pval * count(*) over (partition by chr) / row_number() over (partition by chr order by pval, site) as q from p),
 z as (select *, least(1.0, min(q) over (partition by chr order by pval desc, site desc rows unbounded preceding)) as fdr, -log10(pval + 2.2250738585072014e-308) * abs(d) as raw from y)
 select site, chr, {_near("d", 9)} as delta_beta, {_near("pval", 6)} as pval, {_near("fdr", 6)} as fdr, {_near("(raw - min(raw) over ()) / greatest(max(raw) over () - min(raw) over (), 1e-10)", 6)} as score from z""")
def marker_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = finder.marker_test(cells(spark, sf_dir), sites(spark, sf_dir), _sheet(spark), fdr=None)
    return t.select("site", "chr", F.round(F.col("delta_beta") + 0.0, 9).alias("delta_beta"), *(F.round(c, 6).alias(c) for c in ("pval", "fdr", "score")))


@plan(f"with {_edge_sql('weak').replace('avg(case when', 'median(case when')} select site, connected, reason, {_near('delta', 9)} as delta from e")
def rescue_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = connect.edges(packed(spark, sf_dir), GROUPS, "B", "A", replace(TEST["weak"], statistic="median"))
    return e.select("site", "connected", "reason", F.round(F.col("delta") + 0.0, 9).alias("delta"))


@plan()
def score_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("chr"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("start"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("end"), F.col("value").alias("score"))
    return scoring.blocks(e, scoring.Gap(low=2_500, high=500_000))


@plan()
def svm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).withColumn("region", F.floor(F.col("site") / 20).cast("long"))
    dealt = ordering.stratified_folds(_sheet(spark), "is_case", [F.col("sample")], 3)
    return scoring.score_regions(c.join(F.broadcast(dealt), "sample").select("region", "site", "sample", m_value(F.col("beta")).alias("value"), "is_case", "fold"))


@plan()
def perm_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = packed(spark, sf_dir).select("site", "chr", "pos", connect.group_values(F.col("beta"), GROUPS["A"]).alias("x"))
    pairs = connect.adjacent(x).where("next_site is not null").select("chr", "site", F.lit("A").alias("grp"), "x", F.col("next_x").alias("y"))
    return resampling.empirical_pvalues(pairs, resampling.Empirical()).select("chr", "site", "grp", "pval")


@plan()
def simulate_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.simulate(counts(spark, sf_dir), [5, 6, 7], simulate.Simulation(regions=20, max_gap=100))[1]


@plan()
def augment_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.augmented(counts(spark, sf_dir), ["new_1", "new_2"])
