"""The queries that the entry module registers: each operator on a table of like shape, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import tri, urls, versions
from .operators import answer, applicability, audit, claims, conflicts, evaluate, graph, identity, intervals, mapping, ranges, replay, repository, revisions
from .plans.skew import on_distinct
from .plans.staging import staged
from .sources import records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def day(ts: str) -> Column:
    return F.unix_date(F.col(ts).cast("date")).cast("long")


def tri_text(c: Column) -> Column:
    return tri.tri_name(c)


# -- revisions and change logs ------------------------------------------------------------------------------------------


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.latest(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], ["user_id", "event_id", "event_type", "value"])


@query("select sha256(text) as signature, min(doc_id) as first, count(*) as copies from documents group by 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.content_duplicates(table(spark, sf_dir, "documents"), F.sha2("text", 256), F.col("doc_id"))


@query("select source, count(distinct sha256(text)) as variants from documents group by 1 having count(distinct sha256(text)) > 1")
def content_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.content_variants(table(spark, sf_dir, "documents"), "source", F.sha2("text", 256))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct(micros("ts").alias("us"), F.col("event_id"))
    terminal = F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "signup", "active")
    return revisions.change_state(table(spark, sf_dir, "events"), "user_id", at, terminal)


_STATES_SQL = """select user_id, count(*) as changes, max(epoch_us(ts)) as latest_us,
  arg_max(case event_type when 'error' then 'rejected' when 'signup' then 'active' end, row(ts, event_id)) filter (event_type in ('error', 'signup')) as terminal_state,
  max(epoch_us(ts)) filter (event_type in ('error', 'signup')) as terminal_us from events group by 1"""


@query(_STATES_SQL)
def change_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("user_id", "changes", F.col("latest.us").alias("latest_us"), "terminal_state", F.col("terminal_at.us").alias("terminal_us"))


@query(f"""with s as ({_STATES_SQL}), r as (select o_custkey as user_id, max(epoch_us(o_orderdate)) as modified from orders group by 1),
  c as (select c_custkey as user_id, case when c_acctbal < 0 then 'rejected' else 'active' end as status, coalesce(modified, 0) as modified from customer left join r on c_custkey = r.user_id)
  select user_id, status, modified, changes, case when status = 'rejected' then 'record_status_rejected' when terminal_state = 'rejected' then 'terminal_history_rejected'
  when latest_us > greatest(modified, 1706000000000000) then 'stale_after_history' else 'current' end as decision from c left join s using (user_id)""")
def freshness_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max(micros("o_orderdate")).alias("modified"))
    records = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") < 0, "rejected").otherwise("active").alias("status"))
    records = records.join(changed, "user_id", "left").withColumn("modified", F.coalesce("modified", F.lit(0).cast("long")))
    out = revisions.freshness(records, _states(spark, sf_dir), "user_id", F.col("modified"), F.col("status"), F.col("latest.us"), F.col("terminal_state"), F.lit(1706000000000000))
    return out.select("user_id", "status", "modified", "changes", "decision")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def quarantine_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return revisions.without(customers, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""with log as (select user_id, json_extract_string(props, '$.k') as k, row(ts, event_id) as moment, event_type from events),
  s as (select user_id, k, max(moment) filter (event_type in ('signup', 'purchase')) as a, max(moment) filter (event_type = 'error') as r from log group by 1, 2)
  select user_id, k from s where a is not null and (r is null or a > r)""")
def active_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    kind = F.col("event_type")
    return revisions.active_after(log, ["user_id", "k"], F.struct("ts", "event_id"), kind.isin("signup", "purchase"), kind == "error").select("user_id", "k")


@query("""with n as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders), o as (select o_custkey as k, 'override' as origin, o_totalprice as value from n where r = 1 and o_orderpriority in ('1-URGENT', '2-HIGH'))
  select k, origin, value from o where value > 50000 union all select c_custkey, 'base', c_acctbal from customer where not exists (select 1 from o where o.k = c_custkey)""")
def override_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit("override").alias("origin"), F.col("o_totalprice").alias("value"), "o_orderpriority", "o_orderdate", "o_orderkey")
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("base").alias("origin"), F.col("c_acctbal").alias("value"), F.lit("").alias("o_orderpriority"), F.lit(None).cast(over.schema["o_orderdate"].dataType).alias("o_orderdate"), F.lit(0).cast("long").alias("o_orderkey"))
    trusted = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return revisions.with_overrides(base, over, ["k"], trusted, [F.col("o_orderdate"), F.col("o_orderkey")], F.col("value") > 50000).select("k", "origin", "value")


@query("select cast(event_id % 7 as int) as shard, count(*) as n, min(event_id) as low, max(event_id) as high, count(*) = (max(event_id) - min(event_id)) // 7 + 1 as dense from events group by 1")
def shard_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.shard_gaps(table(spark, sf_dir, "events"), F.col("event_id"), 7)


# -- intervals and runs ------------------------------------------------------------------------------------------------


def _spans(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(key, "l_returnflag", day("l_shipdate").alias("lo"), (day("l_shipdate") + F.col("l_quantity").cast("long")).alias("hi"))


_SPANS = "select *, cast(l_shipdate as date) - date '1970-01-01' as lo, cast(l_shipdate as date) - date '1970-01-01' + cast(l_quantity as bigint) as hi from lineitem"


def _merged(key: str, source: str) -> str:
    return f"""select {key}, min(lo) as lo, max(hi) as hi, count(*) as parts from (select *, sum(fresh) over (partition by {key} order by lo, hi rows unbounded preceding) as island from
      (select *, case when lo > max(hi) over w or max(hi) over w is null then 1 else 0 end as fresh from {source} window w as (partition by {key} order by lo, hi rows between unbounded preceding and 1 preceding))) group by {key}, island"""


@query(f"with s as ({_SPANS}) select l_suppkey, cast(lo as bigint) as lo, cast(hi as bigint) as hi, parts from ({_merged('l_suppkey', 's')})")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(_spans(spark, sf_dir, "l_suppkey"), ["l_suppkey"], "lo", "hi")


@query(f"""with s as ({_SPANS}), l as (select * from s where l_returnflag = 'A'), r as (select * from s where l_returnflag = 'R'), a as ({_merged('l_partkey', 'l')}), b as ({_merged('l_partkey', 'r')}),
  na as (select l_partkey, count(*) as n from a group by 1), nb as (select l_partkey, count(*) as n from b group by 1),
  h as (select a.l_partkey, count(*) as hits, count(distinct row(a.lo, a.hi)) filter (a.lo >= b.lo and a.hi <= b.hi) as ai, count(distinct row(b.lo, b.hi)) filter (b.lo >= a.lo and b.hi <= a.hi) as bi
    from a join b on a.l_partkey = b.l_partkey and a.lo <= b.hi and b.lo <= a.hi group by 1)
  select coalesce(na.l_partkey, nb.l_partkey) as l_partkey, case when na.n is null or nb.n is null then 'one_sided' when coalesce(ai, 0) = na.n and coalesce(bi, 0) = nb.n then 'equal'
    when coalesce(bi, 0) = nb.n then 'left_broader' when coalesce(ai, 0) = na.n then 'right_broader' when hits > 0 then 'partial_overlap' else 'disjoint' end as relation
  from na full join nb on na.l_partkey = nb.l_partkey left join h on h.l_partkey = coalesce(na.l_partkey, nb.l_partkey)""")
def interval_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir, "l_partkey")
    return intervals.set_relation(s.where("l_returnflag = 'A'"), s.where("l_returnflag = 'R'"), ["l_partkey"], "lo", "hi")


@query(f"with s as ({_SPANS}) select a.l_partkey, count(*) as overlaps from s a join s b on a.l_partkey = b.l_partkey and a.lo <= b.hi and b.lo <= a.hi where a.l_returnflag = 'A' and b.l_returnflag = 'N' group by 1")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir, "l_partkey")
    return intervals.overlapping(s.where("l_returnflag = 'A'"), s.where("l_returnflag = 'N'"), ["l_partkey"], "lo", "hi").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("overlaps"))


@query("""select user_id, case when bad then 'error' else 'fine' end as verdict, min(event_id) as first_id, max(event_id) as last_id, count(*) as length from
  (select *, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, bad order by ts, event_id) as run from (select *, event_type = 'error' as bad from events)) group by user_id, bad, run""")
def verdict_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "error", "error").otherwise("fine"))
    return found.select("user_id", "verdict", F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"), "length")


@query("""select o_orderkey, o_custkey, lag(o_orderkey) over w as previous_o_orderkey, lead(o_orderkey) over w as next_o_orderkey from orders window w as (partition by o_custkey, year(o_orderdate) order by o_orderdate, o_orderkey)""")
def neighbour_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("series", F.year("o_orderdate"))
    return intervals.neighbours(orders, ["o_custkey", "series"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "o_custkey", "previous_o_orderkey", "next_o_orderkey")


@query("""select l_orderkey, l_linenumber, l_partkey, case when hi < lo then 'inverted_bounds' when hi = lo and not (li and ui) then 'degenerate_empty_range' else 'ok' end as state from
  (select *, l_linenumber as lo, cast(l_quantity as int) as hi, l_returnflag = 'A' as li, l_linestatus = 'F' as ui from lineitem)""")
def range_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = intervals.range_state(F.col("l_linenumber"), F.col("l_returnflag") == "A", F.col("l_quantity").cast("int"), F.col("l_linestatus") == "F")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", state.alias("state"))


# -- versions ----------------------------------------------------------------------------------------------------------


def _part_version() -> Column:
    return F.concat_ws(".", F.col("p_size"), F.col("p_partkey") % 10, F.col("p_partkey") % 7)


_PART_VERSION = "concat_ws('.', p_size, p_partkey % 10, p_partkey % 7)"


@query(f"""select p_partkey, {_PART_VERSION} as version, case when row(p_size, p_partkey % 10, p_partkey % 7) < row(25, 5, 0) then -1 when row(p_size, p_partkey % 10, p_partkey % 7) > row(25, 5, 0) then 1 else 0 end as compared from part""")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = _part_version()
    return table(spark, sf_dir, "part").select("p_partkey", version.alias("version"), versions.compare(version, F.lit("v25.5"), "dotted").alias("compared"))


@query("""with r as (select p_brand, min(p_size) + 5 as lo, max(p_size) - 5 as hi from part group by 1)
  select p_partkey, p_brand, case when p_partkey % 11 = 0 then 'UNKNOWN' when row(p_size, p_partkey % 10, p_partkey % 7) >= row(lo, 0, 0) and row(p_size, p_partkey % 10, p_partkey % 7) < row(hi, 3, 0) then 'TRUE' else 'FALSE' end as truth from part join r using (p_brand)""")
def version_range_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("version", F.when(F.col("p_partkey") % 11 == 0, "n/a").otherwise(_part_version()))
    ranges = part.groupBy("p_brand").agg((F.min("p_size") + 5).cast("string").alias("lower"), F.concat(F.max("p_size") - 5, F.lit(".3")).alias("upper"))
    key, lower, upper = (versions.dotted_key(F.col(c)) for c in ("version", "lower", "upper"))
    truth = versions.evaluate_segment(F.lit("range"), key, F.lit(None), lower, F.lit(True), upper, F.lit(False))
    return part.join(ranges, "p_brand").select("p_partkey", "p_brand", tri_text(truth).alias("truth"))


_LETTERS = ("", "a", "m", "z", "za", "zb", "ab", "BA")


@query(f"""with v as (select p_partkey, [p_size, p_partkey % 10, p_partkey % 7] || case p_partkey % 8 when 0 then [0] when 1 then [1] when 2 then [13] when 3 then [26] when 4 then [27] when 5 then [28] when 6 then [1, 2] else [2, 1] end as k from part)
  select p_partkey, case when k < [25, 5, 0, 27] then -1 when k > [25, 5, 0, 27] then 1 else 0 end as compared from v""")
def openssl_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.element_at(F.array(*[F.lit(x) for x in _LETTERS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", versions.compare(F.concat(_part_version(), letters), F.lit("25.5.0za"), "openssl").alias("compared"))


_SUFFIXES = ("", "rc1", "-beta", "_p2", " Final", "x3.0", "-rc-1")


@query("""with v as (select p_partkey, [p_size, p_partkey % 10] as k, case p_partkey % 7 when 0 then [0, 0] when 1 then [-10, 1] when 2 then [-30, 0] when 3 then [10, 2] when 4 then [0, 0] when 5 then [5, 3] else [-10, 1] end as s from part)
  select p_partkey, case when k || s < [25, 5, -10, 1] then -1 when k || s > [25, 5, -10, 1] then 1 else 0 end as compared from v""")
def fallback_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(x) for x in _SUFFIXES]), (F.col("p_partkey") % 7 + 1).cast("int"))
    version = F.concat(F.lit("v"), F.concat_ws(".", "p_size", F.col("p_partkey") % 10), suffix)
    return table(spark, sf_dir, "part").select("p_partkey", versions.compare(version, F.lit("release 25_5 RC 1"), "dotted").alias("compared"))


_KINDS = ("*", "-", "N/A", "All versions", ">= 1.2", "1.2.X", "20240131", "ab12cd34", "r1234", "1.2 beta", "1.2-beta", "")


@query("""select p_partkey, ['any_token', 'not_applicable', 'not_applicable', 'all_token', 'range_expression', 'branch_wildcard', 'exact', 'source_control', 'source_control', 'opaque', 'exact', 'missing'][p_partkey % 12 + 1] as kind,
  case p_partkey % 3 when 0 then case when p_size >= 3 then p_size || '.' || p_partkey % 10 else p_size || '.' || p_partkey % 10 || '.' || p_partkey % 7 end end as branch from part""")
def version_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (k % 12 + 1).cast("int"))
    profile = versions.profile_for(F.lit(""), F.when(k % 3 == 0, "openssl_toolkit").when(k % 3 == 1, "imagemagick").otherwise("other"), F.lit(False))
    return table(spark, sf_dir, "part").select("p_partkey", versions.version_kind(text).alias("kind"), versions.branch_key(F.concat(_part_version(), F.lit("b")), profile).alias("branch"))


@query("select series, count(*) as n from (select regexp_extract('release-' || concat_ws('.', p_size, p_partkey % 10, p_partkey % 7), '(\\d+\\.\\d+)(?:[.\\d]*)$', 1) as series from part) group by 1")
def release_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat(F.lit("release-"), _part_version())
    return table(spark, sf_dir, "part").groupBy(versions.release_series(tag).alias("series")).agg(F.count(F.lit(1)).alias("n"))


# -- three values, assertions, states ----------------------------------------------------------------------------------


@query("""with x as (select p_partkey, case p_partkey % 4 when 0 then true when 1 then case when p_size > 25 then null else p_size > 10 end when 2 then p_type = 'SMALL' else null end as a,
    case when p_size % 3 = 0 then null else p_retailprice > 1000 end as b from part)
  select p_partkey, case when a and b then 'TRUE' when not (a and b) then 'FALSE' else 'UNKNOWN' end as both_hold, case when a or b then 'TRUE' when not (a or b) then 'FALSE' else 'UNKNOWN' end as either_holds,
    case when a is null and b is null then 'size,type' when a is null then 'type' when b is null then 'size' else '' end as unknown_axes from x""")
def kleene_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    stated = F.when(k == 0, "ANY").when(k == 3, "UNKNOWN").otherwise("SET")
    values = F.when(k == 1, F.array(F.lit(True).cast("string"))).otherwise(F.array(F.lit("SMALL")))
    asked = F.when(k == 1, (F.col("p_size") > 10).cast("string")).otherwise(F.col("p_type"))
    state = F.when((k == 1) & (F.col("p_size") > 25), "UNKNOWN").otherwise("EXACT")
    a = applicability.scope_axis(state, asked, stated, values)
    b = F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("boolean")).otherwise(F.col("p_retailprice") > 1000)
    both, names = applicability.scope({"type": a, "size": b})
    return table(spark, sf_dir, "part").select("p_partkey", tri_text(both).alias("both_hold"), tri_text(tri.tri_or(a, b)).alias("either_holds"), F.array_join(F.array_sort(names), ",").alias("unknown_axes"))


def _assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
        F.when((F.col("l_linestatus") == "O") & (quantity < 10), F.lit(None).cast("boolean")).otherwise(quantity > 25).alias("holds"),
        F.element_at(F.array(F.lit("nvd"), F.lit("cna"), F.lit("model")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("source"),
        F.when(F.col("l_returnflag") == "A", "affected").when(F.col("l_returnflag") == "R", "unaffected").otherwise("unknown").alias("polarity"),
    )


_ASSERTIONS = """select *, case when l_linestatus = 'O' and l_quantity < 10 then null else l_quantity > 25 end as holds, case l_suppkey % 3 when 0 then 'nvd' when 1 then 'cna' else 'model' end as source,
  case l_returnflag when 'A' then 'affected' when 'R' then 'unaffected' else 'unknown' end as polarity from lineitem"""


@query(f"""with a as ({_ASSERTIONS}), g as (select l_partkey, coalesce(bool_or(holds), false) as et, bool_or(holds is null) as eu from a where l_returnflag <> 'N' group by 1)
  select l_returnflag, case when t is null then 'UNKNOWN' when t then 'TRUE' else 'FALSE' end as truth, count(*) as n from
   (select l_returnflag, case when l_returnflag = 'N' and holds and coalesce(eu, false) then null else holds end as t from a left join g using (l_partkey) where not (l_returnflag = 'N' and coalesce(et, false))) group by 1, 2""")
def default_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = applicability.apply_default_closure(_assertions(spark, sf_dir), ["l_partkey"], F.col("l_returnflag") == "N", F.col("holds"))
    return closed.groupBy("l_returnflag", tri_text(F.col("truth")).alias("truth")).agg(F.count(F.lit(1)).alias("n"))


@query("""with x as (select l_orderkey, l_linenumber, ['ANY', 'EXACT', 'SET', 'NOT_APPLICABLE', 'UNKNOWN'][l_partkey % 5 + 1] as stated, ['ANY', 'EXACT', 'NOT_APPLICABLE', 'UNKNOWN'][l_suppkey % 4 + 1] as asked, l_orderkey % 3 as value, case l_partkey % 5 when 1 then [l_partkey % 3] else [0, 2] end as held from lineitem),
  t as (select *, case stated when 'ANY' then 'TRUE' when 'UNKNOWN' then 'UNKNOWN' when 'NOT_APPLICABLE' then case asked when 'NOT_APPLICABLE' then 'TRUE' when 'EXACT' then 'FALSE' else 'UNKNOWN' end
    else case asked when 'EXACT' then case when list_contains(held, value) then 'TRUE' else 'FALSE' end when 'NOT_APPLICABLE' then 'FALSE' else 'UNKNOWN' end end as narrow from x)
  select l_orderkey, l_linenumber, narrow, case when stated in ('EXACT', 'SET') and asked = 'ANY' then 'TRUE' else narrow end as wide from t""")
def scope_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    asked = F.element_at(F.array(*map(F.lit, ("ANY", "EXACT", "NOT_APPLICABLE", "UNKNOWN"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    stated = F.element_at(F.array(*map(F.lit, ("ANY", "EXACT", "SET", "NOT_APPLICABLE", "UNKNOWN"))), (p % 5 + 1).cast("int"))
    held = F.when(p % 5 == 1, F.array((p % 3).cast("string"))).otherwise(F.array(F.lit("0"), F.lit("2")))
    of = lambda broad: tri_text(applicability.scope_axis(asked, (F.col("l_orderkey") % 3).cast("string"), stated, held, broad))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", of(False).alias("narrow"), of(True).alias("wide"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as assertions about their orders."""
    c, null = F.col, F.lit(None).cast("boolean")
    at = lambda values, key, n: F.element_at(F.array(*map(F.lit, values)), (c(key) % n + 1).cast("int"))
    version = F.when((c("l_linestatus") == "O") & (c("l_quantity") < 10), null).otherwise(c("l_quantity") > 25)
    facts = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        at(("nvd_cpe", "cna_structured", "llm_description", "osv"), "l_suppkey", 4).alias("source_family"),
        F.when(c("l_returnflag") == "A", "affected").when(c("l_returnflag") == "R", "unaffected").otherwise("unknown").alias("polarity"),
        F.when(c("l_linenumber") == 7, False).when(c("l_linenumber") == 6, null).otherwise(True).alias("role"),
        F.when(c("l_partkey") % 13 == 0, False).when(c("l_partkey") % 13 == 1, null).otherwise(True).alias("scope"),
        (c("l_partkey") % 17 != 0).alias("configuration"), version.alias("version"),
        F.when(version.isNull(), "version_unknown").when(version, "version_in_range").when(c("l_suppkey") % 5 == 0, "version_not_applicable").otherwise("version_out_of_range").alias("version_reason"),
        F.when((c("l_orderkey") % 31 == 0) & (c("l_linenumber") == 1), "conflict_review").otherwise("none").alias("reconciliation"),
        F.when(c("l_partkey") % 7 == 0, "potentially_affected").otherwise("affected").alias("max_result_state"), (c("l_suppkey") % 9 == 0).alias("identity_provisional"),
    )
    return facts.withColumn("predicate", tri.tri_and(c("role"), c("scope"), c("configuration"), c("version")))


_EVIDENCE = """select *, role and scope and configuration and version as predicate, case when version is null then 'version_unknown' when version then 'version_in_range' when l_suppkey % 5 = 0 then 'version_not_applicable' else 'version_out_of_range' end as version_reason from
  (select l_orderkey, l_linenumber, l_partkey, l_suppkey, ['nvd_cpe', 'cna_structured', 'llm_description', 'osv'][l_suppkey % 4 + 1] as source_family, case l_returnflag when 'A' then 'affected' when 'R' then 'unaffected' else 'unknown' end as polarity,
   case l_linenumber when 7 then false when 6 then null else true end as role, case l_partkey % 13 when 0 then false when 1 then null else true end as scope, l_partkey % 17 <> 0 as configuration,
   case when l_linestatus = 'O' and l_quantity < 10 then null else l_quantity > 25 end as version, l_orderkey % 31 = 0 and l_linenumber = 1 as under_review, l_partkey % 7 = 0 as capped, l_suppkey % 9 = 0 as aliased from lineitem)"""
_RESULTS = f"""select l_orderkey, source_family, case when bool_or(predicate is true and polarity = 'affected') and bool_or(predicate is true and polarity = 'unaffected') then 'conflict' when bool_or(predicate is true and polarity = 'affected') then 'affected'
  when bool_or(predicate is true and polarity = 'unaffected') then 'unaffected' when bool_or(predicate is null and polarity <> 'unaffected') then 'unknown' when bool_and(version is false) then 'out_of_range' end as result
  from ({_EVIDENCE}) where role is distinct from false and scope is distinct from false and configuration group by 1, 2"""


@query(f"""select l_orderkey, source_family, result from (select distinct l_orderkey, source_family from ({_EVIDENCE})) left join ({_RESULTS}) using (l_orderkey, source_family)""")
def source_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applicability.source_results(_evidence(spark, sf_dir), ["l_orderkey"])


@query(f"""with e as ({_EVIDENCE}), r as ({_RESULTS}),
  s as (select o_orderkey, case when o_orderstatus = 'P' then 'rejected' when o_orderkey % 10 = 3 then 'unenriched' else 'enriched' end as enrichment, o_custkey % 6 = 0 as prov, ['prefer_latest_cpe', 'accept_added_range', null, null, null][o_custkey % 5 + 1] as action, 'basis_' || o_custkey % 3 as basis, n.result as nvd, c.result as cna
    from orders left join r n on n.l_orderkey = o_orderkey and n.source_family = 'nvd_cpe' left join r c on c.l_orderkey = o_orderkey and c.source_family = 'cna_structured'),
  f as (select *, coalesce(nvd in ('affected', 'unaffected', 'out_of_range'), false) as nd, coalesce(cna in ('affected', 'unaffected', 'out_of_range'), false) as cd from s),
  k as (select f.o_orderkey, count(*) as n, count(*) filter (predicate is true and polarity = 'affected') as y, count(*) filter (predicate is true and polarity = 'unaffected') as x, count(*) filter (predicate is null and polarity <> 'unaffected') as u,
      bool_or(capped or aliased) filter (predicate is true and polarity = 'affected') as weak, bool_or(aliased) filter (predicate is true and polarity = 'affected') as al, count(*) filter (scope is false or not configuration) as ruled, count(*) filter (version is false and scope is distinct from false and configuration) as ranged,
      bool_and(version_reason = 'version_not_applicable') filter (version is false and scope is distinct from false and configuration) as na, list(distinct version_reason) filter (predicate is true and polarity = 'affected') as wy, list(distinct version_reason) filter (predicate is true and polarity = 'unaffected') as wx,
      list(distinct version_reason) filter (predicate is null and polarity <> 'unaffected') as wu, list(distinct version_reason) filter (version is false and scope is distinct from false and configuration) as wr
    from f join e on l_orderkey = o_orderkey where not ((nd or cd) and source_family = 'llm_description') group by 1),
  v as (select f.*, k.*, (select bool_or(under_review and predicate is distinct from false) from e where l_orderkey = f.o_orderkey) as review, exists (select 1 from e where l_orderkey = f.o_orderkey) as present, nd and cd and (nvd = 'affected') <> (cna = 'affected') as odds from f left join k on k.o_orderkey = f.o_orderkey),
  z as (select o_orderkey, case when enrichment = 'rejected' then ['insufficient_data', 'rejected_upstream'] when not present then ['product_only_observation', 'no_active_assertion'] when review then ['conflict_review', 'authoritative_source_conflict']
    when nvd = 'conflict' or cna = 'conflict' then ['conflict_review', 'source_family_internal_conflict']
    when odds and action = 'prefer_latest_cpe' then [case nvd when 'affected' then 'affected' when 'unaffected' then 'not_affected_asserted' else 'not_affected_out_of_range' end, 'history_latest_cpe_' || nvd, basis]
    when odds and action = 'accept_added_range' then ['affected', 'history_added_range_accepted', basis] when odds then ['conflict_review', 'nvd_cna_result_conflict'] when y > 0 and x > 0 then ['conflict_review', 'active_polarity_conflict']
    when x > 0 then ['not_affected_asserted'] || list_sort(wx) when y > 0 and (prov or weak) then ['potentially_affected'] || list_sort(wy || case when al then ['identity_alias_provisional'] else [] end) when y > 0 then ['affected'] || list_sort(wy) when u > 0 then ['potentially_affected'] || list_sort(wu)
    when ranged > 0 and ranged + ruled = n then [case when na then 'not_applicable' else 'not_affected_out_of_range' end] || list_sort(wr) when ruled > 0 then ['not_applicable', 'scope_or_configuration_false'] when enrichment = 'unenriched' then ['insufficient_data', 'nvd_unenriched'] else ['product_only_observation', 'no_positive_assertion'] end as o from v)
  select o_orderkey, o[1] as state, array_to_string(o[2:], '|') as reasons from z""")
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    action = F.when(k % 5 == 0, "prefer_latest_cpe").when(k % 5 == 1, "accept_added_range")
    enrichment = F.when(F.col("o_orderstatus") == "P", "rejected").when(F.col("o_orderkey") % 10 == 3, "unenriched").otherwise("enriched")
    subjects = table(spark, sf_dir, "orders").select("o_orderkey", enrichment.alias("enrichment"), (k % 6 == 0).alias("provisional"), action.alias("history_action"), F.concat(F.lit("basis_"), k % 3).alias("history_basis"))
    out = applicability.finalize(_evidence(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey"), subjects, ["o_orderkey"])
    return out.select("o_orderkey", "state", F.array_join("reasons", "|").alias("reasons"))


@query("select o_orderkey, state, n from (select l_orderkey as o_orderkey, case when bool_or(not holds) then 'FALSE' when count(holds) < count(*) then 'UNKNOWN' else 'TRUE' end as state, count(*) as n from (" + _ASSERTIONS + ") group by 1)")
def kleene_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assertions(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(tri_text(tri.tri_all(F.col("holds"))).alias("state"), F.count(F.lit(1)).alias("n"))


@query("""with x as (select l_partkey, l_returnflag, row([1, 3, 0, 2][l_suppkey % 4 + 1], [2, 2, 1, 2][l_suppkey % 4 + 1], least(l_linenumber - 1, 3), [0, 4, 3, 2][l_orderkey % 4 + 1], [2, 1, 0][l_partkey % 2 + l_suppkey % 2 + 1], l_orderkey % 3, least(cast(l_quantity as int) // 20, 2)) as rank from lineitem),
  b as (select l_partkey, max(rank) filter (l_returnflag = 'A') as a, max(rank) filter (l_returnflag = 'R') as u from x group by 1)
  select l_partkey, case when a is null and u is null then null when u is null then 'affected_only' when a is null then 'unaffected_only' when a[4] > 0 and u[4] = 0 then 'affected_wins' when a[4] = 0 and u[4] > 0 then 'unaffected_wins'
    when a[5] = 2 and u[5] = 0 then 'affected_wins' when a[5] = 0 and u[5] = 2 then 'unaffected_wins' when a > u then 'affected_wins' when u > a then 'unaffected_wins' else 'conflict_review' end as winner from b""")
def evidence_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    at = lambda values, index: F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))
    rank = applicability.evidence_rank(
        at(("nvd_cpe", "cna_structured", "llm_description", "osv"), c("l_suppkey") % 4), at(("UNSPECIFIED", "EXACT", "BOUNDED_RANGE", "UNBOUNDED_RANGE"), c("l_orderkey") % 4),
        at(("DIRECT_UPSTREAM", "DIRECT_ALTERNATIVE_PRODUCT", "BUNDLED_COMPONENT"), c("l_partkey") % 2 + c("l_suppkey") % 2), c("l_linenumber").cast("int") - 1, (c("l_orderkey") % 3).cast("int"), (c("l_quantity").cast("int") / 20).cast("int"),
    )
    polarity = F.when(c("l_returnflag") == "A", "affected").when(c("l_returnflag") == "R", "unaffected").otherwise("unknown")
    ranked = table(spark, sf_dir, "lineitem").select("l_partkey", polarity.alias("polarity"), rank.alias("rank"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("ordinal"))
    best = applicability.preferred(ranked, ["l_partkey"], "polarity", "rank", "ordinal")
    return best.select("l_partkey", applicability.evidence_winner(c("affected"), c("unaffected")).alias("winner"))


@query("""select l_partkey, l_returnflag, l_linestatus, count(*) as assertions, count(distinct l_suppkey % 10) as sources, array_to_string(list_sort(list_distinct(list(l_suppkey % 10)))[:3], ',') as examples from lineitem group by 1, 2, 3""")
def corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "lineitem").withColumn("origin", F.col("l_suppkey") % 10)
    return applicability.corroboration(marked, ["l_partkey"], ["l_returnflag", "l_linestatus"], "origin", 3).select("l_partkey", "l_returnflag", "l_linestatus", "assertions", "sources", F.array_join("examples", ",").alias("examples"))


@query("""with leaf as (select c_nationkey, case when c_acctbal < -990 then null else c_acctbal > 9990 end as t from customer),
  n1 as (select n_nationkey, n_regionkey, case when bool_or(t) then true when count(t) < count(*) then null when count(*) > 0 then false end as t from nation join leaf on c_nationkey = n_nationkey group by 1, 2),
  n2 as (select n_regionkey, case when n_nationkey % 5 = 0 then not t else t end as t from n1)
  select n_regionkey as region, case when bool_or(not t) then 'FALSE' when count(t) < count(*) then 'UNKNOWN' else 'TRUE' end as truth from n2 group by 1""")
def graph_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("tree_id"), F.col("n_nationkey").alias("node"), F.lit(-1).alias("parent"), F.lit(1).alias("level"), F.lit("OR").alias("operator"), (F.col("n_nationkey") % 5 == 0).alias("negate"))
    root = nation.select("tree_id").distinct().select("tree_id", F.lit(-1).alias("node"), F.lit(-2).alias("parent"), F.lit(0).alias("level"), F.lit("AND").alias("operator"), F.lit(False).alias("negate"))
    balance = F.col("c_acctbal")
    leaves = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("parent"), F.when(balance < -990, F.lit(None).cast("boolean")).otherwise(balance > 9990).alias("truth"))
    leaves = leaves.join(nation.select("tree_id", F.col("node").alias("parent")), "parent").select("tree_id", "parent", "truth")
    return applicability.evaluate_tree(nation.unionByName(root), leaves, 1).select(F.col("tree_id").alias("region"), tri_text(F.col("truth")).alias("truth"))


# -- ranges, conflicts, answers ------------------------------------------------------------------------------------------


def _text(c: Column) -> Column:
    return c.cast("string")


@query("""with x as (select l_orderkey, l_linenumber, cast(l_quantity as int) as q, cast(l_partkey % 50 as int) as p, (l_orderkey + l_linenumber) % 8 as k from lineitem)
  select l_orderkey, l_linenumber, case k when 6 then 'UNPARSED' when 7 then 'EXPLICIT_ALL' when 5 then 'BRANCH_RANGE' when 1 then 'UNBOUNDED_RANGE' when 4 then 'UNBOUNDED_RANGE' else 'BOUNDED_RANGE' end as version_class,
    case k when 0 then q || '.0' when 2 then cast(q as varchar) when 3 then cast(q as varchar) end as lower, case k when 0 then true when 2 then true when 3 then false end as lower_inclusive,
    case k when 0 then (q + p) || '.0' when 1 then cast(q as varchar) when 2 then cast(q + p as varchar) when 3 then cast(q + 5 as varchar) when 4 then cast(least(p, q) as varchar) end as upper,
    case k when 0 then false when 1 then true when 2 then false when 3 then false when 4 then p < q end as upper_inclusive, case when k = 5 then q || '.x' end as exact, case when k = 6 then 'invalid_comparator_expression' end as error from x""")
def compile_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p, k = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 50).cast("int"), (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    version = F.when(k == 0, F.concat(q, F.lit(".0"))).when(k == 1, "0").when(k == 2, F.concat(F.lit(">= "), q, F.lit(" , < "), q + p)).when(k == 3, F.concat(F.lit(">"), q)).when(k == 4, F.concat(F.lit("<"), q)).when(k == 5, F.concat(q, F.lit(".x"))).when(k == 6, F.concat(F.lit("== "), q)).otherwise("All")
    below = F.when(k == 0, F.concat(q + p, F.lit(".0"))).when(k == 3, F.concat(F.lit("< "), q + 5))
    upto = F.when(k == 1, _text(q)).when(k == 4, F.concat(F.lit("<="), p))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", version.alias("v"), below.alias("below"), upto.alias("upto"))
    found = ranges.compile_stated(lines, F.col("v"), F.col("below"), F.col("upto"), F.lit(None).cast("string"), F.lit("tool"))
    return found.select("l_orderkey", "l_linenumber", *[f"segment.{c}" for c in ("version_class", "lower", "lower_inclusive", "upper", "upper_inclusive", "exact", "error")])


@query("""with x as (select l_orderkey, l_linenumber, cast(l_quantity as int) as q, cast(l_partkey % 50 as int) as p, (l_orderkey + l_linenumber) % 6 as k from lineitem)
  select l_orderkey, l_linenumber, ['CPE_ANY_UNCORROBORATED', 'NOT_APPLICABLE', 'EXACT', 'BOUNDED_RANGE', 'UNBOUNDED_RANGE', 'UNSPECIFIED'][k + 1] as version_class, case when k = 3 then cast(q as varchar) end as lower, case when k = 3 then true end as lower_inclusive,
    case k when 3 then cast(q + p as varchar) when 4 then cast(q as varchar) end as upper, case k when 3 then false when 4 then true end as upper_inclusive, case when k = 2 then q || '.' || p end as exact, case when k in (1, 2, 3) then 'bounded' else 'unbounded' end as breadth from x""")
def compile_cpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p, k = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 50).cast("int"), (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    name = F.when(k == 1, "-").when(k == 2, F.concat_ws(".", q, p)).when(k == 5, "").otherwise("*")
    none = F.lit(None).cast("string")
    segment = ranges.compile_cpe(name, F.when(k == 3, _text(q)), none, F.when(k == 4, _text(q)), F.when(k == 3, _text(q + p)), F.lit("tool"))
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", segment.alias("s"))
    return found.select("l_orderkey", "l_linenumber", *[f"s.{c}" for c in ("version_class", "lower", "lower_inclusive", "upper", "upper_inclusive", "exact", "breadth")])


@query("""with x as (select l_orderkey, l_linenumber, l_linenumber as a, cast(l_quantity as int) + 10 as u, l_linenumber + l_partkey % 3 as c1, l_linenumber + 20 as c2 from lineitem),
  t as (select *, list_filter([{'at': c1, 'st': 'unaffected'}, {'at': c2, 'st': 'affected'}], lambda z: z['at'] < u and z['at'] > a) as k, case when c1 = a then 'unaffected' else 'affected' end as s0 from x),
  w as (select l_orderkey, l_linenumber, [a] || list_transform(k, lambda z: z['at']) as lo, list_transform(k, lambda z: z['at']) || [u] as hi, [s0] || list_transform(k, lambda z: z['st']) as st from t)
  select l_orderkey, l_linenumber, unnest(st) as status, cast(unnest(lo) as varchar) as lower, cast(unnest(hi) as varchar) as upper from w""")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, empty = F.col("l_linenumber"), F.lit(None).cast("string")
    steps = F.array(F.struct(_text(n + F.col("l_partkey") % 3).alias("at"), F.lit("unaffected").alias("status")), F.struct(_text(n + 20).alias("at"), F.lit("Affected").alias("status")))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _text(n).alias("v"), _text(F.col("l_quantity").cast("int") + 10).alias("below"), steps.alias("steps"))
    found = ranges.compile_stated(lines, F.col("v"), F.col("below"), empty, empty, F.lit("tool"), F.col("steps.at"))
    split = ranges.with_changes(found, F.col("segment"), F.lit("affected"), F.col("steps"))
    return split.select("l_orderkey", "l_linenumber", F.explode("pieces").alias("x")).select("l_orderkey", "l_linenumber", "x.status", "x.lower", "x.upper")


def _open_ranges(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    """Lines as ranges of versions: some without an end, ends open or closed."""
    lo, hi = F.col("l_linenumber") * 5, F.col("l_linenumber") * 5 + 1 + F.col("l_quantity").cast("int") % 12
    low_text, high_text = F.when(F.col("l_suppkey") % 7 > 0, _text(lo)), F.when(F.col("l_suppkey") % 11 > 0, _text(hi))
    key = lambda c: F.when(c.isNotNull(), versions.dotted_key(c))
    lower, upper = ranges.lower_end(key(low_text), F.col("l_suppkey") % 2 == 0), ranges.upper_end(key(high_text), F.col("l_suppkey") % 3 == 0)
    return table(spark, sf_dir, "lineitem").select(*keys, "l_returnflag", lower.alias("lower"), upper.alias("upper"), low_text.alias("lower_text"), high_text.alias("upper_text"))


_OPEN_RANGES = """select *, case when l_suppkey % 7 > 0 then 2 * 5 * l_linenumber + l_suppkey % 2 else -1000000 end as lo, case when l_suppkey % 11 > 0 then 2 * (l_linenumber * 5 + 1 + cast(l_quantity as int) % 12) - case when l_suppkey % 3 = 0 then 0 else 1 end else 1000000 end as hi from lineitem"""


def _merged_open(keys: str, source: str) -> str:
    """Ends as whole numbers: twice the version, an open end one inside; ranges one apart touch."""
    return f"""select {keys}, min(lo) as lo, max(hi) as hi, count(*) as parts from (select *, sum(fresh) over (partition by {keys} order by lo, hi rows unbounded preceding) as island from
      (select *, case when max(hi) over w is null or lo > max(hi) over w + 1 then 1 else 0 end as fresh from {source} window w as (partition by {keys} order by lo, hi rows between unbounded preceding and 1 preceding))) group by {keys}, island"""


def _relation_sql(keys: str, left: str, right: str) -> str:
    return f"""select {keys}, case when na = ia and nb = ib then 'equal' when na = ia then 'right_broader' when nb = ib then 'left_broader' when meet then 'partial_overlap' else 'disjoint' end as relation from
      (select {keys}, count(distinct (a.lo, a.hi)) as na, count(distinct (b.lo, b.hi)) as nb, count(distinct (a.lo, a.hi)) filter (b.lo <= a.lo and b.hi >= a.hi) as ia, count(distinct (b.lo, b.hi)) filter (a.lo <= b.lo and a.hi >= b.hi) as ib,
        bool_or(greatest(a.lo, b.lo) <= case when a.lo <= b.lo then a.hi else b.hi end + 1) as meet from {left} a join {right} b using ({keys}) group by {keys})"""


@query(f"with r as ({_OPEN_RANGES}), m as ({_merged_open('l_partkey', 'r')}) select l_partkey, count(*) as ranges, count(*) filter (lo = -1000000) as open_below, count(*) filter (hi = 1000000) as open_above, cast(max(parts) as bigint) as most_parts from m group by 1")
def range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = ranges.merge_ranges(_open_ranges(spark, sf_dir, ["l_partkey"]), ["l_partkey"])
    return merged.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("ranges"), F.count_if(F.col("lower.rank") == 0).alias("open_below"), F.count_if(F.col("upper.rank") == 2).alias("open_above"), F.max("parts").alias("most_parts"))


@query(f"with r as ({_OPEN_RANGES}), x as (select * from r where l_returnflag = 'A'), y as (select * from r where l_returnflag = 'R'), a as ({_merged_open('l_partkey', 'x')}), b as ({_merged_open('l_partkey', 'y')}) {_relation_sql('l_partkey', 'a', 'b')}")
def range_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _open_ranges(spark, sf_dir, ["l_partkey"])
    return ranges.range_relation(r.where("l_returnflag = 'A'"), r.where("l_returnflag = 'R'"), ["l_partkey"])


_VENDORS = ("acme", "acme_inc", "bolt_labs", "cargo")
_PRODUCTS = ("tool", "tool_suite", "open_tool", "gear")


def _at(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    named = _open_ranges(spark, sf_dir, keys).withColumn("vendor", _at(_VENDORS, F.col("l_suppkey") % 4)).withColumn("product", _at(_PRODUCTS, F.col("l_partkey") % 4))
    mine = named.where("l_returnflag <> 'R'").withColumn("item", F.concat_ws(":", "vendor", "product"))
    theirs = named.where("l_returnflag = 'R'").withColumn("blocker", F.when(F.col("l_quantity") > 48, "unsupported_version_token"))
    theirs = theirs.select("l_orderkey", "vendor", "product", "blocker", *[F.when(F.col("blocker").isNull(), F.col(c)).alias(c) for c in ("lower", "upper", "lower_text", "upper_text")])
    blocked = F.max(F.when(F.col("l_quantity") < 3, "unparsed_expression"))
    stated = mine.groupBy("l_orderkey", "item", "vendor", "product").agg(F.bool_or(F.col("l_linenumber") == 7).alias("inverted"), blocked.alias("blocker"))
    matches = conflicts.identity_matches(stated, theirs.select("l_orderkey", "vendor", "product").distinct(), "l_orderkey")
    return conflicts.pair_verdicts(stated, mine.where("l_quantity >= 3").select("l_orderkey", "item", "lower", "upper", "lower_text", "upper_text"), theirs, matches, "l_orderkey")


_CONFLICTS = f"""n as (select *, ['acme', 'acme_inc', 'bolt_labs', 'cargo'][l_suppkey % 4 + 1] as v, ['tool', 'tool_suite', 'open_tool', 'gear'][l_partkey % 4 + 1] as p, list_filter([['acme'], ['acme'], ['bolt'], ['cargo']][l_suppkey % 4 + 1] || [['tool'], ['tool', 'suite'], ['tool'], ['gear']][l_partkey % 4 + 1], lambda z: true) as w from ({_OPEN_RANGES})),
  c as (select l_orderkey, v || ':' || p as item, v, p, any_value(w) as w, bool_or(l_linenumber = 7) as inverted, bool_or(l_quantity < 3) as blocked from n where l_returnflag <> 'R' group by 1, 2, 3, 4), t as (select *, l_quantity > 48 as bad from n where l_returnflag = 'R'),
  h as (select distinct c.l_orderkey, c.item, t.v as tv, t.p as tp, case when c.v = t.v and c.p = t.p then 0 when c.p = t.p then 1 when c.v = t.v then 2 when len(list_intersect(c.w, t.w)) in (len(c.w), len(t.w)) then 3 end as lv from c join t using (l_orderkey)),
  e as (select * from (select *, min(lv) over (partition by l_orderkey, item) as best from h where lv is not null) where lv = best),
  lr as (select l_orderkey, v || ':' || p as item, lo, hi from n where l_returnflag <> 'R' and l_quantity >= 3), rr as (select e.l_orderkey, e.item, t.lo, t.hi, t.bad from e join t on t.l_orderkey = e.l_orderkey and t.v = e.tv and t.p = e.tp), good as (select * from rr where not bad),
  ma as ({_merged_open('l_orderkey, item', 'lr')}), mb as ({_merged_open('l_orderkey, item', 'good')}), rel as ({_relation_sql('l_orderkey, item', 'ma', 'mb')}),
  pv as (select l_orderkey, item, ['exact', 'product_only', 'vendor_only', 'loose', 'none'][coalesce(lv, 4) + 1] as level, case when lv is null then null when inverted then 'cna_inverted_default_status' when blocked then 'cna_unparsed_expression' when not exists (select 1 from lr where lr.l_orderkey = c.l_orderkey and lr.item = c.item) then 'cna_no_affected_versions'
      when exists (select 1 from rr where rr.l_orderkey = c.l_orderkey and rr.item = c.item and bad) then 'cpe_unsupported_version_token' end as undecidable, case relation when 'left_broader' then 'cna_broader' when 'right_broader' then 'cpe_broader' else relation end as relation
    from c left join (select distinct l_orderkey, item, lv from e) using (l_orderkey, item) left join rel using (l_orderkey, item)),
  pairs as (select l_orderkey, item, level, case when level = 'none' then null when undecidable is not null then 'undecidable' else relation end as verdict, undecidable from pv)"""


@query(f"with {_CONFLICTS} select l_orderkey, item, level, verdict, undecidable from pairs")
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflict_pairs(spark, sf_dir)


@query(f"""with {_CONFLICTS}, g as (select l_orderkey, max(list_position(['exact', 'product_only', 'vendor_only', 'loose', 'none'], level)) as lv, bool_or(level in ('product_only', 'loose', 'none')) as vc, bool_or(level in ('vendor_only', 'loose', 'none')) as pc,
    min(list_position(['scheme_mismatch', 'disjoint', 'partial_overlap', 'cna_broader', 'cpe_broader', 'equal'], verdict)) filter (verdict <> 'undecidable') as vd, bool_or(undecidable is not null) as undecidable from pairs group by 1)
  select l_orderkey, ['exact', 'product_only', 'vendor_only', 'loose', 'none'][lv] as level, case when vc and pc then 'vendor_and_product' when vc then 'vendor_only' when pc then 'product_only' else 'none' end as identity_conflict,
    ['scheme_mismatch', 'disjoint', 'partial_overlap', 'cna_broader', 'cpe_broader', 'equal'][vd] as verdict, coalesce(vd < 6, false) as version_conflict, coalesce(vd < 4, false) as hard_conflict, undecidable from g""")
def conflict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.record_summary(_conflict_pairs(spark, sf_dir), "l_orderkey")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as stored assertions about their parts."""
    c, empty = F.col, F.lit(None).cast("string")
    q, k = c("l_quantity").cast("int"), (c("l_orderkey") + c("l_linenumber")) % 5
    openssl = c("l_partkey") % 4 == 0
    number = lambda n: F.when(openssl, F.concat_ws(".", F.lit("1"), c("l_suppkey") % 3, n)).otherwise(_text(n))
    version = F.when(k == 0, number(q)).when(k == 1, number(c("l_linenumber"))).when(k == 2, "0").when(k == 3, "*").otherwise(F.lit("n/a"))
    below = F.when(k == 1, number(c("l_linenumber") + q)).when(k == 2, number(q))
    axis = F.when(c("l_suppkey") % 5 == 0, "SET").when(c("l_suppkey") % 5 == 1, "UNKNOWN").otherwise("ANY")
    role = _at(("DIRECT_UPSTREAM", "DOWNSTREAM_PACKAGE", "UNRESOLVED", "REQUIRED_PLATFORM"), F.when(c("l_linenumber") < 6, c("l_linenumber") % 2).otherwise(c("l_linenumber") - 4))
    lines = table(spark, sf_dir, "lineitem").select(
        c("l_partkey").alias("product"), (c("l_orderkey") % 4).alias("subject"), _text(c("l_suppkey") % 2).alias("claim_group"), (c("l_linenumber") == 3).alias("is_default"), version.alias("v"), below.alias("below"), F.when(openssl, "openssl").otherwise("tool").alias("name"),
        F.when(c("l_orderkey") % 2 == 0, "complete").otherwise("partial").alias("branch_coverage"), role.alias("cpe_match_role"), (c("l_partkey") % 17 != 0).alias("configuration"), axis.alias("part_state"), F.array(F.lit("a"), F.lit("o")).alias("part_values"),
        _at(("nvd_cpe", "cna_structured", "llm_description", "osv"), c("l_suppkey") % 4).alias("source_family"), F.when(c("l_returnflag") == "A", "affected").when(c("l_returnflag") == "R", "unaffected").otherwise("unknown").alias("polarity"),
        F.lit("none").alias("reconciliation"), F.lit("affected").alias("max_result_state"), (c("l_suppkey") % 9 == 0).alias("identity_provisional"),
    )
    said = {"v": c("v"), "below": c("below"), "name": c("name")}
    return on_distinct(lines, said, lambda df: ranges.compile_stated(df, c("v"), c("below"), empty, empty, c("name")), "segment", F.xxhash64("product", "subject"))


@query("""with x as (select l_partkey as product, l_orderkey % 4 as subject, l_suppkey % 2 as grp, l_linenumber = 3 as isd, cast(l_quantity as int) as q, l_linenumber as ln, (l_orderkey + l_linenumber) % 5 as k, l_partkey % 4 = 0 as ssl, l_suppkey % 3 as br, l_orderkey % 2 = 0 as complete, l_suppkey % 4 as src, l_returnflag as pol,
    case when l_linenumber = 6 then null when l_linenumber = 7 then false else true end as role, l_partkey % 17 <> 0 as conf, l_suppkey % 5 as ax, l_suppkey % 9 = 0 as prov from lineitem),
  b as (select *, case when ssl and k in (0, 1, 2) then case k when 2 then br * 1000 + q when 0 then br * 1000 + q else br * 1000 + ln end end as bkey from x),
  s as (select *, min('1.' || br || '.' || (bkey - br * 1000)) over g as fb, max('1.' || br || '.' || (bkey - br * 1000)) over g as lb, case when bkey is not null then '1.' || br || '.' || (bkey - br * 1000) end as sb from b window g as (partition by product, subject, grp)),
  r as (select o_orderkey as request, o_custkey as product, cast(floor(o_totalprice) as bigint) % 50 as rq, o_custkey % 3 as rb, ['EXACT', 'ANY', 'NOT_APPLICABLE'][o_orderkey % 3 + 1] as st, case when o_orderkey % 2 = 0 then 'o' else 'h' end as val from orders),
  m as (select *, case when ssl then '1.' || rb || '.' || rq end as mb from r join s using (product)),
  v as (select *, case when k = 3 then 'T explicit_all' when k = 4 then 'F version_not_applicable' when k = 0 then case when rq = q and (not ssl or rb = br) then 'T exact_match' else 'F exact_mismatch' end
      when ssl and mb <> sb and mb < fb and not complete then 'U branch_below_coverage' when ssl and mb <> sb and not (mb < fb) and not (mb > lb and sb = lb) and not complete then 'U branch_lateral_uncovered' when ssl and mb <> sb and not (mb < fb) and not (mb > lb and sb = lb) then 'F branch_outside_complete_coverage'
      when k = 1 and (case when ssl then rb * 1000 else 0 end) + rq < (case when ssl then br * 1000 else 0 end) + ln then 'F lower_bound_not_met' when k = 1 and (case when ssl then rb * 1000 else 0 end) + rq >= (case when ssl then br * 1000 else 0 end) + ln + q then 'F upper_bound_exceeded'
      when k = 2 and (case when ssl then rb * 1000 else 0 end) + rq >= (case when ssl then br * 1000 else 0 end) + q then 'F upper_bound_exceeded' else 'T range_match' end as ver,
    case when ax = 0 then case st when 'EXACT' then val = 'o' when 'NOT_APPLICABLE' then false end when ax = 1 then null else true end as scope from m),
  w as (select *, case ver[1] when 'T' then true when 'F' then false end as vt, ver[3:] as why from v), z as (select *, role and scope and conf and vt as pred from w),
  d as (select *, bool_or(pred is true) filter (not isd) over g as answered, bool_or(pred is null) filter (not isd) over g as opened from z window g as (partition by request, subject, grp)),
  f as (select request, subject, src, pol, role, scope, conf, vt, prov, case when isd and pred and coalesce(opened, false) then null else pred end as pred, case when isd and pred and coalesce(opened, false) then 'explicit_coverage_unknown' else why end as why from d where not (isd and coalesce(answered, false))),
  sr as (select request, subject, src, case when bool_or(pred is true and pol = 'A') and bool_or(pred is true and pol = 'R') then 'conflict' when bool_or(pred is true and pol = 'A') then 'affected' when bool_or(pred is true and pol = 'R') then 'unaffected' when bool_or(pred is null and pol <> 'R') then 'unknown' when bool_and(vt is false) then 'out_of_range' end as res
    from f where role is distinct from false and scope is distinct from false and conf group by 1, 2, 3),
  u as (select q.request, q.subject, n.res as nvd, c.res as cna, coalesce(n.res in ('affected', 'unaffected', 'out_of_range'), false) as nd, coalesce(c.res in ('affected', 'unaffected', 'out_of_range'), false) as cd, exists (select 1 from f where f.request = q.request and f.subject = q.subject) as present
    from (select distinct request, subject from z) q left join sr n on n.request = q.request and n.subject = q.subject and n.src = 0 left join sr c on c.request = q.request and c.subject = q.subject and c.src = 1),
  a as (select f.request, f.subject, count(*) as n, count(*) filter (pred is true and pol = 'A') as y, count(*) filter (pred is true and pol = 'R') as x, count(*) filter (pred is null and pol <> 'R') as o, bool_or(prov) filter (pred is true and pol = 'A') as weak, count(*) filter (scope is false or not conf) as ruled, count(*) filter (vt is false and scope is distinct from false and conf) as ranged,
      bool_and(why = 'version_not_applicable') filter (vt is false and scope is distinct from false and conf) as na, list(distinct why) filter (pred is true and pol = 'A') as wy, list(distinct why) filter (pred is true and pol = 'R') as wx, list(distinct why) filter (pred is null and pol <> 'R') as wo, list(distinct why) filter (vt is false and scope is distinct from false and conf) as wr
    from f join u on u.request = f.request and u.subject = f.subject where not ((nd or cd) and src = 2) group by 1, 2),
  e as (select u.request, u.subject, case when not present then ['product_only_observation', 'no_active_assertion'] when nvd = 'conflict' or cna = 'conflict' then ['conflict_review', 'source_family_internal_conflict'] when nd and cd and (nvd = 'affected') <> (cna = 'affected') then ['conflict_review', 'nvd_cna_result_conflict'] when y > 0 and x > 0 then ['conflict_review', 'active_polarity_conflict']
      when x > 0 then ['not_affected_asserted'] || list_sort(wx) when y > 0 and weak then ['potentially_affected'] || list_sort(wy || ['identity_alias_provisional']) when y > 0 then ['affected'] || list_sort(wy) when o > 0 then ['potentially_affected'] || list_sort(wo)
      when ranged > 0 and ranged + ruled = n then [case when na then 'not_applicable' else 'not_affected_out_of_range' end] || list_sort(wr) when ruled > 0 then ['not_applicable', 'scope_or_configuration_false'] when u.subject = 3 then ['insufficient_data', 'nvd_unenriched'] else ['product_only_observation', 'no_positive_assertion'] end as out from u left join a on a.request = u.request and a.subject = u.subject)
  select request, subject, out[1] as state, array_to_string(out[2:], '|') as reasons from e""")
def applicability_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = staged(_stored(spark, sf_dir), "assertions")
    c = F.col
    asked = F.when(c("o_custkey") % 4 == 0, F.concat_ws(".", F.lit("1"), c("o_custkey") % 3, c("o_totalprice").cast("long") % 50)).otherwise(_text(c("o_totalprice").cast("long") % 50))
    requests = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("request"), c("o_custkey").alias("product"), asked.alias("version"), _at(("EXACT", "ANY", "NOT_APPLICABLE"), c("o_orderkey") % 3).alias("part_state"), F.when(c("o_orderkey") % 2 == 0, "o").otherwise("h").alias("part_value"))
    subjects = spark.range(4).select(c("id").alias("subject"), F.when(c("id") == 3, "unenriched").otherwise("enriched").alias("enrichment"), F.lit(False).alias("provisional"), F.lit(None).cast("string").alias("history_action"), F.lit(None).cast("string").alias("history_basis"))
    return answer.answers(requests, stored, subjects, ["part"]).select("request", "subject", "state", F.array_join("reasons", "|").alias("reasons"))


# -- names and graphs --------------------------------------------------------------------------------------------------


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = table(spark, sf_dir, "part").select("p_name").distinct()
    return name.union(name.select(F.regexp_replace(F.upper("p_name"), " ", "-"))).union(name.select(F.regexp_replace("p_name", " ", ""))).toDF("name")


@query("""with n as (select distinct p_name as name from part), v as (select name from n union select replace(upper(name), ' ', '-') from n union select replace(name, ' ', '') from n),
  k as (select name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as key from v) select a.name as a, b.name as b, a.key from k a join k b on a.key = b.key and a.name < b.name""")
def separator_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.separator_aliases(_spellings(spark, sf_dir), "name")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))


_PAIRS = """with w as (select distinct w from (select unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as w from benchmark) where length(w) >= 5), p as (select a.w as a, b.w as b from w a join w b on a.w < b.w where abs(length(a.w) - length(b.w)) <= 1 and levenshtein(a.w, b.w) = 1)"""


@query(f"{_PAIRS} select * from p")
def one_edit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.one_edit_pairs(_words(spark, sf_dir), "word")


@query(f"""{_PAIRS}, g as (select a, b, list_distinct(list_transform(range(1, length(a)), lambda i: a[i:i+1])) as x, list_distinct(list_transform(range(1, length(b)), lambda i: b[i:i+1])) as y from p)
  select a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) as similarity from g""")
def bigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_edit_pairs(spark, sf_dir).select("a", "b", F.round(T.bigram_jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"""{_PAIRS.replace('with w', 'with recursive w')}, e as (select a, b from p union select b, a from p), r(node, label) as (select a, a from e union select e.b, r.label from r join e on e.a = r.node)
  select node, min(label) as component from r group by 1""")
def alias_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(one_edit_pairs(spark, sf_dir))


@query(f"""{_PAIRS.replace('with w', 'with recursive w')}, e as (select a, b from p union select b, a from p), r(node, label) as (select a, a from e union select e.b, r.label from r join e on e.a = r.node), c as (select node, min(label) as component from r group by 1)
  select component, count(*) as size, case when count(*) > 3 then 'review_size' else 'accepted' end as status from c group by 1""")
def component_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.component_summary(alias_components(spark, sf_dir), largest=3)


@query(f"{_PAIRS} select a, b from p where a in (select a from p group by 1 having count(*) = 1) and b in (select b from p group by 1 having count(*) = 1)")
def mutual_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mutually_unique(one_edit_pairs(spark, sf_dir)).select("a", "b")


@query(f"""{_PAIRS}, e as (select a, b from p union select b, a from p), g as (select a, b, list_distinct(list_transform(range(1, length(a)), lambda i: a[i:i+1])) as x, list_distinct(list_transform(range(1, length(b)), lambda i: b[i:i+1])) as y from e),
  s as (select a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) as score from g), o as (select *, row_number() over w as rank, lead(score) over w as nxt, max(score) over (partition by a) as best from s window w as (partition by a order by score desc, b))
  select a, b, score, cast(rank as int) as rank, coalesce(best - max(nxt) filter (rank = 1) over (partition by a) < 0.025, false) as ambiguous from (select * from o where score >= best - 0.15)""")
def score_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = one_edit_pairs(spark, sf_dir)
    both = pairs.union(pairs.select("b", "a")).toDF("a", "b").withColumn("score", F.round(T.bigram_jaccard(F.col("a"), F.col("b")), 6))
    return identity.with_margin(both, ["a"], "b").select("a", "b", "score", "rank", "ambiguous")


@query("""with n as (select distinct p_name as name from part), v as (select name from n union select replace(upper(name), ' ', '-') from n union select replace(name, ' ', '') from n
    union select name[2] || name[1] || name[3:] from n union select array_to_string(list_reverse(string_split(name, ' ')), ' ') from n),
  q as (select name as query, trim(regexp_replace(lower(trim(name)), '[^a-z0-9_]+', '_', 'g'), '_') as k from v), c as (select name as entry, trim(regexp_replace(lower(trim(name)), '[^a-z0-9_]+', '_', 'g'), '_') as e from n),
  s as (select query, entry, case when query = entry then 0 when k = e then 1 when replace(k, '_', '') = replace(e, '_', '') then 2 when list_sort(list_filter(string_split(k, '_'), lambda t: t <> '')) = list_sort(list_filter(string_split(e, '_'), lambda t: t <> '')) then 3
    when length(k) >= 5 and length(e) >= 5 and abs(length(k) - length(e)) <= 1 and (levenshtein(k, e) = 1 or (length(k) = length(e) and damerau_levenshtein(k, e) = 1)) then 4 end as tier from q, c where abs(length(k) - length(e)) <= 3),
  b as (select query, min(tier) as tier from s group by 1) select query, entry, tier from s join b using (query, tier)""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    slips = catalogue.select(F.concat(F.substring("name", 2, 1), F.substring("name", 1, 1), F.substring("name", 3, 100)).alias("name"))
    turned = catalogue.select(F.array_join(F.reverse(F.split("name", " ")), " ").alias("name"))
    return identity.resolve(_spellings(spark, sf_dir).union(slips).union(turned), catalogue)


@query(f"""{_PAIRS.replace('with w', 'with recursive w')}, t as (select a, b, cast(length(a) % 3 + 1 as int) as tier from p), e as (select a, b, tier from t union select b, a, tier from t), starts as (select distinct a as node from p),
  r(start, node, tier, length) as (select node, node, 0, 0 from starts union select r.start, e.b, greatest(r.tier, e.tier), r.length + 1 from r join e on e.a = r.node where r.length < 4),
  o as (select *, row_number() over (partition by start, node order by tier, length) as k from r) select start, node, tier, length from o where k = 1""")
def best_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = one_edit_pairs(spark, sf_dir).withColumn("tier", (F.char_length("a") % 3 + 1).cast("int"))
    return graph.best_paths(pairs, pairs.select(F.col("a").alias("node")).distinct(), 4)


@query("""with l as (select l_orderkey, l_suppkey % 7 as v, p_name as p from lineitem join part on l_partkey = p_partkey where l_returnflag = 'A'), r as (select l_orderkey, l_suppkey % 7 as v, p_name as p from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R'),
  x as (select l.l_orderkey, min(case when l.v = r.v and l.p = r.p then 0 when l.p = r.p then 1 when l.v = r.v then 2 else 4 end) as k from l join r using (l_orderkey) group by 1)
  select l_orderkey, case k when 0 then 'exact' when 1 then 'product_only' when 2 then 'vendor_only' else 'none' end as level from x""")
def match_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    named = named.select("l_orderkey", "l_returnflag", (F.col("l_suppkey") % 7).alias("vendor"), T.ascii_key(F.col("p_name")).alias("product"))
    return identity.match_level(named.where("l_returnflag = 'A'"), named.where("l_returnflag = 'R'"), "l_orderkey")


@query("""with x as (select distinct user_id, cast(ts as date) - date '1970-01-01' as d, event_type from events) select a.event_type as left_item, b.event_type as right_item, count(*) as n from x a join x b using (user_id, d) where a.event_type < b.event_type group by 1, 2""")
def pair_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.cooccurring(table(spark, sf_dir, "events").withColumn("d", day("ts")), ["user_id", "d"], "event_type", examples=0).select("left_item", "right_item", "n")


@query("""with e as (select l_partkey, l_suppkey, l_linenumber as rank, case when l_returnflag = 'R' then 'rejected' when l_returnflag = 'A' then 'accepted' else 'review' end as status, l_linestatus = 'F' as strict, l_orderkey from lineitem)
  select l_partkey, l_suppkey, case when bool_or(status = 'rejected') then 'rejected' else arg_min(status, row(rank, status)) end as status, min(rank) as rank, bool_or(strict) as strict, count(*) as evidence_count, array_to_string(list_sort(list_distinct(list(l_orderkey)))[:2], ',') as evidence from e group by 1, 2""")
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    evidence = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_linenumber").alias("rank"), F.when(flag == "R", "rejected").when(flag == "A", "accepted").otherwise("review").alias("status"), (F.col("l_linestatus") == "F").alias("strict"), "l_orderkey")
    merged = identity.merged_edges(evidence, ["l_partkey", "l_suppkey"], "rank", "status", "strict", "l_orderkey", most=2)
    return merged.withColumn("evidence", F.array_join("evidence", ","))


_BRANDS = ("acme", "acme_inc", "acme_labs", "a_c_me", "bolt_project", "core", "poc_tool", "microsoft")
_BRAND_PRODUCTS = ("acme", "bolt", "ac_me", "core", "windows_10_version_1809", "windows_10_1809_server_core_installation", "gnu_image_program", "gip")


@query("""with x as (select p_partkey, ['acme', 'acme_inc', 'acme_labs', 'a_c_me', 'bolt_project', 'core', 'poc_tool', 'microsoft'][p_partkey % 8 + 1] as v, ['acme', 'bolt', 'ac_me', 'core', 'windows_10_version_1809', 'windows_10_1809_server_core_installation', 'gnu_image_program', 'gip'][p_size % 8 + 1] as p from part)
  select p_partkey, case when v = p then 'exact' when replace(v, '_', '') = replace(p, '_', '') then 'separator' when v = 'acme_inc' and p in ('acme', 'ac_me') then 'legal_root' when v = 'acme_labs' and p in ('acme', 'ac_me') or v = 'bolt_project' and p = 'bolt' then 'org_root' end as relation,
    case when v = 'microsoft' and p like 'windows%' then case when p like '%version%' then 'windows_10_1809' else 'windows_10_1809' end else p end as rewritten, v in ('core', 'poc_tool') as generic from x""")
def brand_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, p = _at(_BRANDS, F.col("p_partkey") % 8), _at(_BRAND_PRODUCTS, F.col("p_size") % 8)
    named = table(spark, sf_dir, "part").select("p_partkey", v.alias("v"), p.alias("p"))
    return named.select("p_partkey", T.self_brand(F.col("v"), F.col("p")).alias("relation"), T.rewritten_product(F.col("v"), F.col("p")).alias("rewritten"), T.is_generic(F.col("v")).alias("generic"))


_ROOT_KEYS = ("acme", "acme_inc", "acme_labs", "gnu_image_program", "gip", "server", "poc_inc", "core_systems")


@query("""with n as (select p_partkey as node, p_partkey % 97 as scope, ['a', 'o'][p_size % 2 + 1] as part, ['acme', 'acme_inc', 'acme_labs', 'gnu_image_program', 'gip', 'server', 'poc_inc', 'core_systems'][p_partkey % 8 + 1] as k from part),
  d as (select node, scope, part, 'A2_LEGAL_SUFFIX' as alias_class, 'acme' as t from n where k = 'acme_inc' union all select node, scope, part, 'A3_ORG_SUFFIX', case k when 'acme_labs' then 'acme' else 'core' end from n where k in ('acme_labs', 'core_systems')
    union all select node, scope, part, 'B1_ACRONYM', case k when 'acme_inc' then 'ai' when 'acme_labs' then 'al' when 'gnu_image_program' then 'gip' when 'core_systems' then 'cs' end from n where k in ('acme_inc', 'acme_labs', 'gnu_image_program', 'core_systems'))
  select d.node, n.node as target, alias_class from d join n on n.scope = d.scope and n.part = d.part and n.k = d.t""")
def root_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select(k.alias("node"), (k % 97).alias("scope"), _at(("a", "o"), F.col("p_size") % 2).alias("part"), _at(_ROOT_KEYS, k % 8).alias("key"))
    return identity.root_candidates(nodes)


@query("""with n as (select p_partkey as node, case when p_partkey % 3 = 0 then 'microsoft' else 'other' end as v, p_size % 4 as part, case p_partkey % 4 when 0 then 'windows_10_version_' || p_partkey % 300 when 1 then 'windows_10_' || p_partkey % 300 when 2 then 'windows_10_' || p_partkey % 300 || '_server_core_installation' else 'windows_11_version_' || p_partkey % 300 || '_edition_server_core_installation' end as p,
    case p_partkey % 4 when 3 then 'windows_11_' else 'windows_10_' end || p_partkey % 300 as w from part), r as (select node, v, part, case v when 'microsoft' then w else p end as k from n)
  select x.node as a, y.node as b from r x join r y using (v, part, k) where x.node < y.node""")
def rewrite_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    n = k % 300
    name = F.when(k % 4 == 0, F.concat(F.lit("windows_10_version_"), n)).when(k % 4 == 1, F.concat(F.lit("windows_10_"), n)).when(k % 4 == 2, F.concat(F.lit("windows_10_"), n, F.lit("_server_core_installation"))).otherwise(F.concat(F.lit("windows_11_version_"), n, F.lit("_edition_server_core_installation")))
    nodes = table(spark, sf_dir, "part").select(k.alias("node"), F.when(k % 3 == 0, "microsoft").otherwise("other").alias("vendor"), (F.col("p_size") % 4).alias("part"), name.alias("product"))
    # At scale many parts share a name here, which real catalogues don't.
    return identity.rewrite_aliases(nodes, guard=1 << 20)


@query("""with c as (select l_linenumber % 2 as axis, least(l_partkey % 40, l_suppkey % 40) as a, greatest(l_partkey % 40, l_suppkey % 40) as b, 'c' || l_orderkey % 5 as class_code, case l_linenumber when 1 then 'manual_registry' when 2 then 'identity_hard_distinct' when 3 then 'product_relation' else 'other' end as origin,
    ['algorithm_accepted', 'bounded_heuristic', 'inclusive_provisional', 'inclusive_candidate', 'review_candidate', 'unheard'][l_orderkey % 6 + 1] as confidence, l_orderkey * 10 + l_linenumber as n from lineitem where l_quantity > 45 and l_linenumber > 1),
  p as (select *, case origin when 'manual_registry' then 100 when 'identity_hard_distinct' then 90 when 'product_relation' then 80 else case confidence when 'algorithm_accepted' then 70 when 'bounded_heuristic' then 60 when 'inclusive_provisional' then 55 when 'inclusive_candidate' then 50 when 'review_candidate' then 10 else 20 end end as priority from c where a <> b)
  select axis, a, b, class_code, origin, confidence, priority from (select *, row_number() over (partition by axis, a, b order by priority desc, n) as k from p) where k = 1""")
def classified_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    n = c("l_linenumber")
    origin = F.when(n == 1, "manual_registry").when(n == 2, "identity_hard_distinct").when(n == 3, "product_relation").otherwise("other")
    cases = table(spark, sf_dir, "lineitem").where("l_quantity > 45 and l_linenumber > 1").select(
        (n % 2).alias("axis"), (c("l_partkey") % 40).alias("left"), (c("l_suppkey") % 40).alias("right"), F.concat(F.lit("c"), c("l_orderkey") % 5).alias("class_code"), origin.alias("origin"),
        _at(("algorithm_accepted", "bounded_heuristic", "inclusive_provisional", "inclusive_candidate", "review_candidate", "unheard"), c("l_orderkey") % 6).alias("confidence"), (c("l_orderkey") * 10 + n).alias("arrival"),
    )
    return identity.classified_pairs(cases, "arrival")


@query("""select l_orderkey, 's' || l_suppkey % 3 as series, max('v' || cast(l_quantity as int)) as fixed from lineitem where l_returnflag <> 'N' and l_linenumber % 4 > 0 group by 1, 2""")
def fixed_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    said = F.when(c("l_returnflag") == "A", "ok").when(c("l_returnflag") == "N", "not an ancestor")
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("s"), c("l_suppkey") % 3).alias("series"), F.when(c("l_linenumber") % 4 > 0, F.concat(F.lit("v"), c("l_quantity").cast("int"))).alias("fixed"), said.alias("verification"))
    return intervals.fixed_by_series(found, ["l_orderkey"])


@query("""with r as (select l_orderkey, l_linenumber, case l_linenumber % 5 when 0 then 'no-version' when 1 then 'exact' when 2 then 'upper' when 3 then 'lower' else 'bounded' end as shape from lineitem where l_quantity > 25), g as (select l_orderkey, count(*) as n, count(distinct shape) as k, any_value(shape) as s from r group by 1)
  select o_orderkey, case when n is null then '0' when n = 1 then '1' when n <= 3 then '2-3' else '4+' end as bindings, case when o_custkey % 3000 <= 512 then '<=512' when o_custkey % 3000 <= 1024 then '513-1024' when o_custkey % 3000 <= 2048 then '1025-2048' else '2049+' end as length, case when n is null then 'empty-bindings' when k = 1 then s else 'mixed' end as shape from orders left join g on o_orderkey = l_orderkey""")
def record_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 5
    text = lambda cond, value: F.when(cond, F.lit(value))
    span = F.struct(text(n.isin(1, 3, 4), "1").alias("start"), (n != 0).alias("start_inclusive"), F.when(n == 1, "1").when(n.isin(2, 4), "9").alias("end"), F.lit(True).alias("end_inclusive"))
    bound = table(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit("v").alias("vendor"), F.array(span).alias("version_ranges"))).alias("bindings"))
    records_of = table(spark, sf_dir, "orders").join(bound, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return records_of.select("o_orderkey", replay.stratum(F.col("bindings"), F.repeat(F.lit("x"), (F.col("o_custkey") % 3000).cast("int"))).alias("s")).select("o_orderkey", "s.*")


# -- repositories and URLs ---------------------------------------------------------------------------------------------


@query("""with x as (select regexp_extract(url, '//([^/:?#]+)', 1) as host, regexp_extract(url, '//[^/]+/([a-z]+)', 1) as product, count(*) as n from pages group by 1, 2), r as (select *, rank() over (partition by product order by n desc) as k from x)
  select product, case when count(*) filter (k = 1) = 1 then min(host) filter (k = 1) end as host, count(*) as claimants, case when count(*) filter (k = 1) = 1 then 'accepted' else 'tie' end as status from r group by 1""")
def repo_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host"), F.get(urls.path_parts(F.col("url")), F.lit(0)).alias("product")).agg(F.count(F.lit(1)).alias("n"))
    return mapping.single_claims(claims, "product", "host", [F.col("n").desc()])


@query("select page_id, regexp_extract(url, '//([^/:?#]+)', 1) as host, regexp_extract(url, '//[^/?#]+([^?#]*)', 1) as path, len(list_filter(string_split(regexp_extract(url, '//[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')) as depth from pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host(url).alias("host"), urls.path(url).alias("path"), F.size(urls.path_parts(url)).cast("long").alias("depth"))


@query("""select page_id, case when page_id % 3 = 2 then null else 'own' || (page_id % 5) || '@tool' || (page_id % 11) end as repository, case when page_id % 3 = 0 then substr(md5(url), 1, 12) end as commit_id from pages""")
def repository_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    base = F.concat(F.lit("https://github.com/Own"), k % 5, F.lit("/Tool"), k % 11)
    made = F.when(k % 3 == 0, F.concat(base, F.lit("/commit/"), F.substring(F.md5("url"), 1, 12))).when(k % 3 == 1, F.concat(base, F.lit(".git"))).otherwise(F.concat(F.lit("https://github.com/topics/t"), k))
    return table(spark, sf_dir, "pages").select("page_id", urls.repository(made).alias("repository"), urls.commit_id(made).alias("commit_id"))


@query("""select p_partkey, 'a' as part, lower(p_brand) as vendor, replace(p_name, ' ', ':') as product, cast(p_size as varchar) as version from part""")
def cpe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    cpe = F.concat(F.lit("cpe:2.3:a:"), F.lower("p_brand"), F.lit(":"), F.regexp_replace("p_name", " ", r"\\:"), F.lit(":"), F.col("p_size"), F.lit(":*:*:*:*:*:*:*"))
    parts = urls.cpe_parts(cpe)
    return table(spark, sf_dir, "part").select("p_partkey", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("part", "vendor", "product", "version"))])


@query("""select o_orderpriority, o_orderstatus as best_method, n as evidence, k as candidates from (select *, row_number() over (partition by o_orderpriority order by n desc, o_orderstatus desc) as r, count(*) over (partition by o_orderpriority) as k
  from (select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1, 2)) where r = 1""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return mapping.best_candidate(found, ["o_orderpriority"], F.lit(0), F.col("n"), "o_orderstatus").select("o_orderpriority", "best_method", "evidence", "candidates")


@query("""with a as (select distinct c_custkey as k from customer), b as (select distinct o_custkey as k from orders), c as (select distinct o_custkey as k from orders join lineitem on l_orderkey = o_orderkey), d as (select distinct o_custkey as k from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R')
  select 0 as position, 'customer' as stage, (select count(*) from a) as survivors, cast(0 as bigint) as dropped union all select 1, 'ordered', (select count(*) from b), (select count(*) from a where k not in (select k from b))
  union all select 2, 'shipped', (select count(*) from c), (select count(*) from b where k not in (select k from c)) union all select 3, 'returned', (select count(*) from d), (select count(*) from c where k not in (select k from d))""")
def stage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    shipped = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_custkey").alias("k")
    return mapping.funnel([("customer", table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))), ("ordered", orders.select(k)), ("shipped", shipped.select(k)), ("returned", shipped.where("l_returnflag = 'R'").select(k))], "k")


# -- claims and bindings -----------------------------------------------------------------------------------------------

_ROLE_VENDORS = ("acme", "debian", "oracle", "ubuntu", "bolt")
_ROLE_PRODUCTS = ("tool", "debian_linux", "linux", "gear")


@query("""with x as (select l_orderkey, l_linenumber, l_returnflag <> 'N' as vul, ['a', 'o', 'h'][l_partkey % 3 + 1] as part, ['acme', 'debian', 'oracle', 'ubuntu', 'bolt'][l_suppkey % 5 + 1] as v, ['tool', 'debian_linux', 'linux', 'gear'][l_partkey % 4 + 1] as p, ['*', '-', '', 'pro'][l_linenumber % 4 + 1] as ed, l_linenumber from lineitem),
  st as (select distinct l_orderkey, ['acme', 'debian', 'oracle', 'ubuntu', 'bolt'][l_suppkey % 5 + 1] as v, ['tool', 'debian_linux', 'linux', 'gear'][l_partkey % 4 + 1] as p from lineitem where l_linenumber = 1),
  r as (select x.*, case when not vul and part = 'h' then 'REQUIRED_HARDWARE' when not vul then 'REQUIRED_PLATFORM' when v in ('debian', 'oracle', 'ubuntu') and p in ('debian_linux', 'linux') then 'DOWNSTREAM_DISTRIBUTION' when st.v is not null then 'DIRECT_UPSTREAM' when v in ('debian', 'ubuntu') then 'DOWNSTREAM_PACKAGE' else 'UNRESOLVED' end as role
    from x left join st using (l_orderkey, v, p))
  select l_orderkey, l_linenumber, role, case ed when '*' then 'ANY' when '-' then 'NOT_APPLICABLE' when '' then 'UNKNOWN' else 'EXACT' end as edition, case when role like 'DOWNSTREAM%' then v || ':' || p else 'ANY' end as distribution from r""")
def claim_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    matches = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_returnflag") != "N").alias("vulnerable"), _at(("a", "o", "h"), c("l_partkey") % 3).alias("part"), _at(_ROLE_VENDORS, c("l_suppkey") % 5).alias("vendor_key"), _at(_ROLE_PRODUCTS, c("l_partkey") % 4).alias("product_key"),
        _at(("*", "-", "", "pro"), c("l_linenumber") % 4).alias("edition"),
    )
    found = claims.with_roles(matches, matches.where("l_linenumber = 1"), ["l_orderkey"])
    axes = claims.cpe_axes({"vendor": c("vendor_key"), "product": c("product_key"), "edition": c("edition")}, c("role"))
    return found.select("l_orderkey", "l_linenumber", "role", axes["edition"]["state"].alias("edition"), F.when(axes["distribution"]["state"] == "EXACT", F.get(axes["distribution"]["values"], F.lit(0))).otherwise("ANY").alias("distribution"))


@query("""with g as (select l_orderkey, count(*) filter (l_returnflag = 'A') as np, count(*) filter (l_returnflag = 'R') as nc, list_sort(list_distinct(list(['', '*', '-', 'x', 'y', 'z'][case when l_linenumber = 7 then 2 when l_partkey % 9 = 0 then 3 when l_suppkey % 2 = 0 then 1 else cast(l_partkey % 3 + 4 as int) end]))) as s from lineitem group by 1),
  f as (select *, list_filter(s, lambda z: z <> '') as t from g)
  select o_orderkey, case when o_orderstatus = 'P' then 'rejected' when np > 0 then 'nvd_enriched' when nc > 0 then 'cna_only' else 'unenriched' end as enrichment, case when coalesce(len(t), 0) = 0 then 'UNKNOWN' when list_contains(t, '*') then 'ANY' when t = ['-'] then 'NOT_APPLICABLE' when len(t) = 1 then 'EXACT' else 'SET' end as axis,
    case when coalesce(len(t), 0) = 0 or list_contains(t, '*') or t = ['-'] then '' else array_to_string(t, ',') end as held from orders left join f on o_orderkey = l_orderkey""")
def enrichment_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    value = F.when(c("l_linenumber") == 7, "*").when(c("l_partkey") % 9 == 0, "-").when(c("l_suppkey") % 2 == 0, "").otherwise(_at(("x", "y", "z"), c("l_partkey") % 3))
    facts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(c("l_returnflag") == "A").alias("p"), F.bool_or(c("l_returnflag") == "R").alias("c"), F.collect_set(value).alias("s"))
    joined = table(spark, sf_dir, "orders").join(facts, c("o_orderkey") == c("l_orderkey"), "left")
    axis = claims.set_axis(F.coalesce("s", F.array().cast("array<string>")))
    kind = claims.enrichment_class(F.when(c("o_orderstatus") == "P", "Rejected").otherwise("Analyzed"), F.coalesce("p", F.lit(False)), F.coalesce("c", F.lit(False)))
    return joined.select("o_orderkey", kind.alias("enrichment"), axis["state"].alias("axis"), F.array_join(axis["values"], ",").alias("held"))


@query("""with s as (select l_orderkey, l_linenumber, cast(l_quantity as int) % 6 + 4 as up, l_linestatus = 'F' as inc from lineitem where l_returnflag = 'A'), n as (select l_orderkey, count(distinct up) as lines from s group by 1),
  p as (select l_orderkey, cast(l_quantity as int) % 6 + 4 as up, l_linestatus = 'F' as inc, case when l_suppkey % 5 > 0 then cast(l_partkey % 8 as int) end as lo, l_suppkey % 2 = 0 as li from lineitem where l_returnflag <> 'A'),
  l as (select l_orderkey, up, inc, bool_or(lo is null) as open, count(distinct (lo, li)) filter (lo < up) as k, min(lo) filter (lo < up) as lo, min(li) filter (lo < up) as li from p group by 1, 2, 3)
  select l_orderkey, l_linenumber, cast(up as varchar) as upper, case when lines >= 2 and k = 1 and not open then cast(lo as varchar) end as lower, case when lines >= 2 and k = 1 and not open then li end as lower_inclusive from s join n using (l_orderkey) left join l using (l_orderkey, up, inc)""")
def lent_lower_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    lines = table(spark, sf_dir, "lineitem").withColumn("upper", _text(c("l_quantity").cast("int") % 6 + 4)).withColumn("upper_inclusive", c("l_linestatus") == "F")
    theirs = lines.where("l_returnflag <> 'A'").select("l_orderkey", F.concat("upper", F.lit(".0")).alias("upper"), "upper_inclusive", F.when(c("l_suppkey") % 5 > 0, _text(c("l_partkey") % 8)).alias("lower"), (c("l_suppkey") % 2 == 0).alias("lower_inclusive"))
    mine = lines.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "upper", "upper_inclusive")
    return claims.lend_lower_ends(mine, theirs, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "upper", "lower", "lower_inclusive")


_ARTIFACTS = ("tool", "go_driver", "python_driver", "driver", "engine", "cli_tool", "java_binding")


@query("""with x as (select p_partkey, ['tool', 'go_driver', 'python_driver', 'driver', 'engine', 'cli_tool', 'java_binding'][p_partkey % 7 + 1] as a, ['tool', 'go_driver', 'python_driver', 'driver', 'engine', 'cli_tool', 'java_binding'][p_size % 7 + 1] as b from part),
  y as (select *, list_sort(list_filter(string_split(a, '_'), lambda t: t in ('tool', 'driver', 'cli', 'binding'))) as ra, list_sort(list_filter(string_split(b, '_'), lambda t: t in ('tool', 'driver', 'cli', 'binding'))) as rb, list_filter(string_split(a, '_'), lambda t: t in ('go', 'python', 'java')) as la, list_filter(string_split(b, '_'), lambda t: t in ('go', 'python', 'java')) as lb from x)
  select p_partkey, case when len(ra) > 0 and len(rb) > 0 and ra <> rb then 'artifact_role_mismatch' when len(ra) > 0 and len(rb) = 0 then 'repo_is_distinct_artifact' when (list_contains(ra || rb, 'driver') or list_contains(ra || rb, 'binding')) and len(la) > 0 and len(lb) > 0 and not list_has_any(la, lb) then 'artifact_language_mismatch' end as reason from y""")
def artifact_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", repository.artifact_conflict(_at(_ARTIFACTS, F.col("p_partkey") % 7), _at(_ARTIFACTS, F.col("p_size") % 7)).alias("reason"))


def _bound(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Parts as products, some owners' repositories of the same names, and lines as references from one to the other."""
    c, name = F.col, T.ascii_key(F.col("p_name"))
    part = table(spark, sf_dir, "part")
    products = part.select(c("p_partkey").alias("product_id"), F.concat(F.lit("own"), c("p_partkey") % 60).alias("vendor_key"), F.concat(name, F.lit("_"), c("p_size") % 5).alias("product_key"), _at(("a", "*", "unknown", "o"), c("p_partkey") % 4).alias("part"))
    repositories = products.where("product_id % 3 = 0").select("vendor_key", "product_key").distinct().select(F.concat_ws("@", "vendor_key", "product_key").alias("repo_key"), c("vendor_key").alias("owner_key"), c("product_key").alias("name_key"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(c("l_partkey").alias("product_id"), F.concat(F.lit("own"), c("l_suppkey") % 60).alias("owner_key")).distinct()
    evidence = lines.join(products.select("product_id", c("product_key").alias("name_key")), "product_id").join(repositories, ["owner_key", "name_key"]).select("repo_key", "product_id")
    members = products.where("product_id % 2 = 0").select((c("product_id") % 40).alias("cluster_id"), "product_id")
    return {"products": products, "repositories": repositories, "evidence": evidence, "members": members}


_BOUND = """pr as (select p_partkey as product_id, 'own' || p_partkey % 60 as vendor_key, replace(p_name, ' ', '_') || '_' || p_size % 5 as product_key, ['a', '*', 'unknown', 'o'][p_partkey % 4 + 1] as part from part),
  re as (select distinct vendor_key || '@' || product_key as repo_key, vendor_key as owner_key, product_key as name_key from pr where product_id % 3 = 0),
  ev as (select distinct re.repo_key, pr.product_id from lineitem join pr on pr.product_id = l_partkey join re on re.owner_key = 'own' || l_suppkey % 60 and re.name_key = pr.product_key where l_returnflag = 'A'),
  me as (select product_id % 40 as cluster_id, product_id from pr where product_id % 2 = 0), ca as (select repo_key, product_id from re join pr on owner_key = vendor_key and name_key = product_key)"""
_PART_OK = "(x.part = y.part or ('o' not in (x.part, y.part)) or ('o' in (x.part, y.part) and '*' in (x.part, y.part)))"


@query(f"with {_BOUND} select repo_key, product_id, 'exact_pair' as method from ca")
def exact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bound(spark, sf_dir)
    return repository.exact_pairs(b["repositories"], b["products"])


@query(f"""with {_BOUND} select distinct ca.repo_key, y.product_id, ca.product_id as anchor_id, m.cluster_id, case when list_has_any(string_split(re.name_key, '_'), ['tool', 'cli']) then 'x' end as reason
  from ca join me m on m.product_id = ca.product_id join me n on n.cluster_id = m.cluster_id and n.product_id <> m.product_id join pr x on x.product_id = ca.product_id join pr y on y.product_id = n.product_id join re on re.repo_key = ca.repo_key
  where exists (select 1 from ev join me using (product_id) where ev.repo_key = ca.repo_key and me.cluster_id = m.cluster_id) and not ((x.product_id + y.product_id) % 14 = 0 and abs(x.product_id - y.product_id) = 40) and {_PART_OK}""")
def cluster_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bound(spark, sf_dir)
    a = F.col("product_id")
    blocked = b["products"].select(a.alias("a"), (a + 40).alias("b")).where("(a + b) % 14 = 0")
    return repository.cluster_expansion(repository.exact_pairs(b["repositories"], b["products"]), b["members"], b["evidence"], blocked, b["products"], b["repositories"])


@query(f"""with {_BOUND}, cp as (select ca.*, cast(product_id % 3 as int) as priority, cast(product_id % 7 as bigint) as evidence, product_id % 5 > 0 as independent from ca), so as (select product_key from cp join pr using (product_id) where length(product_key) >= 4 group by 1 having count(distinct repo_key) = 1),
  bs as (select 'own' || v as va, 'own' || w as vb, case when (v + w) % 3 = 0 then 'curated_vendor_alias:list' else 'strict_vendor_cluster' end as basis from (select unnest(range(60)) as v) , (select unnest(range(60)) as w) where v <> w and v % 10 = w % 10),
  mt as (select cp.repo_key, cp.product_id as anchor_id, y.product_id, cp.priority, cp.evidence, x.vendor_key as av, re.owner_key as ov, y.vendor_key as yv from cp join pr x on x.product_id = cp.product_id join so on so.product_key = x.product_key join pr y on y.product_key = x.product_key join re on re.repo_key = cp.repo_key
    where cp.independent and {_PART_OK} and not exists (select 1 from ca c2 where c2.repo_key = cp.repo_key and c2.product_id = y.product_id) and not exists (select 1 from ev where ev.product_id = y.product_id and ev.repo_key <> cp.repo_key)),
  sc as (select mt.*, case when yv in (av, ov) then 6 else 0 end as exact_rank, b.basis, case when b.basis like 'curated%' then 7 when b.basis is not null then 5 end as rk from mt left join bs b on b.vb = yv and b.va in (av, ov)),
  bb as (select repo_key, product_id, anchor_id, priority, evidence, max(case when coalesce(rk, 0) > exact_rank then row(rk, basis) when exact_rank > 0 then row(6, 'vendor_exact') end) as top from sc group by all having max(coalesce(rk, exact_rank)) > 0 or max(exact_rank) > 0),
  oo as (select *, row_number() over (partition by repo_key, product_id order by top[1] desc, priority desc, evidence desc, top[2] desc, anchor_id desc) as k from bb)
  select repo_key, product_id, anchor_id, top[2] as basis from oo where k = 1""")
def product_key_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = _bound(spark, sf_dir), F.col
    candidates = repository.exact_pairs(b["repositories"], b["products"]).select("repo_key", "product_id", (c("product_id") % 3).cast("int").alias("priority"), (c("product_id") % 7).cast("long").alias("evidence"), (c("product_id") % 5 > 0).alias("independent"))
    vendors = spark.range(60).select(c("id").alias("v"), (c("id") % 10).alias("k"))
    pairs = vendors.join(vendors.select(c("v").alias("w"), "k"), "k").where("v <> w")
    keys = b["products"].select("product_key").distinct()
    basis = F.when((c("v") + c("w")) % 3 == 0, "curated_vendor_alias:list").otherwise("strict_vendor_cluster")
    named = pairs.select(F.concat(F.lit("own"), "v").alias("vendor_a"), F.concat(F.lit("own"), "w").alias("vendor_b"), basis.alias("basis"))
    # A pair of vendors is known for the products that either sells.
    sold = b["products"].select(c("vendor_key").alias("vendor_b"), "product_key").distinct()
    return repository.product_key_bridge(candidates, b["products"], b["repositories"], b["evidence"], named.join(sold, "vendor_b").join(keys, "product_key"))


_BINDINGS = "select 'r' || l_suppkey % 40 as repo_key, 'CVE-' || (2000 + l_orderkey % 20) || '-' || lpad(cast(l_orderkey as varchar), 4, '0') as cve_id, l_partkey as product_id, l_linenumber % 3 = 0 as review, l_linenumber = 5 as provisional from lineitem"


def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    name = F.concat(F.lit("CVE-"), c("l_orderkey") % 20 + 2000, F.lit("-"), F.when(F.length(_text(c("l_orderkey"))) >= 4, _text(c("l_orderkey"))).otherwise(F.lpad(_text(c("l_orderkey")), 4, "0")))
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("r"), c("l_suppkey") % 40).alias("repo_key"), name.alias("cve_id"), c("l_partkey").alias("product_id"), (c("l_linenumber") % 3 == 0).alias("review"), (c("l_linenumber") == 5).alias("provisional"), "l_quantity", "l_returnflag", "l_suppkey")


_BINDINGS = _BINDINGS.replace("lpad(cast(l_orderkey as varchar), 4, '0')", "case when length(cast(l_orderkey as varchar)) >= 4 then cast(l_orderkey as varchar) else lpad(cast(l_orderkey as varchar), 4, '0') end")
_RANGE_ROWS = _BINDINGS.replace("from lineitem", ", case l_returnflag when 'A' then 'affected' else 'unaffected' end as polarity, case when l_quantity > 40 then cast(l_quantity as int) || '' end as exact, case when l_quantity < 20 then cast(l_quantity as int) || '.0' end as lo, case when l_quantity < 30 then (cast(l_quantity as int) + 5) || '' end as hi, l_suppkey % 2 = 0 as li, l_suppkey % 3 = 0 as hinc from lineitem")


def _range_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    return _bindings(spark, sf_dir).select(
        "repo_key", "cve_id", "product_id", F.when(F.col("l_returnflag") == "A", "affected").otherwise("unaffected").alias("polarity"), F.when(F.col("l_quantity") > 40, _text(q)).alias("exact"),
        F.when(F.col("l_quantity") < 20, F.concat(q, F.lit(".0"))).alias("lower"), (F.col("l_suppkey") % 2 == 0).alias("lower_inclusive"), F.when(F.col("l_quantity") < 30, _text(q + 5)).alias("upper"), (F.col("l_suppkey") % 3 == 0).alias("upper_inclusive"),
    )


@query(f"select repo_key, cve_id, bool_and(review) as all_review, bool_or(review) as any_review, bool_or(provisional) as any_provisional, count(distinct product_id) as paths from ({_BINDINGS}) group by 1, 2")
def repo_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.repo_view(_bindings(spark, sf_dir))


@query(f"""with b as (select distinct repo_key, cve_id, product_id from ({_BINDINGS})), v as ({_RANGE_ROWS})
  select b.repo_key, b.cve_id, b.product_id, count(v.polarity) as ranges, count(*) filter (v.polarity = 'affected') as affected_ranges, max(case when v.polarity = 'affected' and (lo is not null or hi is not null or exact is not null) then 1 else 0 end) as bounded
  from b left join (select * from v where product_id % 3 > 0) v on v.cve_id = b.cve_id and v.product_id = b.product_id group by 1, 2, 3""")
def version_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.version_summary(_bindings(spark, sf_dir), _range_rows(spark, sf_dir).where("product_id % 3 > 0"))


@query(f"""with b as (select distinct repo_key, cve_id, product_id from ({_BINDINGS})), v as (select distinct cve_id, product_id, case when exact is not null then '=' || exact when lo is null and hi is null then '*' else coalesce(lo || case when li then ' <= ' else ' < ' end, '') || 'v' || coalesce(case when hinc then ' <= ' else ' < ' end || hi, '') end as t from ({_RANGE_ROWS}) where polarity = 'affected')
  select repo_key, b.cve_id, b.product_id, coalesce(string_agg(t, ' | ' order by t), '') as texts from b left join v on v.cve_id = b.cve_id and v.product_id = b.product_id group by 1, 2, 3""")
def range_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bindings = _bindings(spark, sf_dir).select("repo_key", "cve_id", "product_id").distinct()
    return repository.with_ranges(bindings, _range_rows(spark, sf_dir)).select("repo_key", "cve_id", "product_id", F.array_join("texts", " | ").alias("texts"))


@query(f"""with b as (select distinct repo_key, cve_id from ({_BINDINGS})) select repo_key, cve_id, cast(k as int) as rank, total from (select *, row_number() over (partition by repo_key order by cast(cve_id[5:8] as int) desc, cast(cve_id[10:] as bigint) desc) as k, count(*) over (partition by repo_key) as total from b) where k <= 5""")
def newest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    bindings = _bindings(spark, sf_dir).select("repo_key", "cve_id").distinct()
    return repository.first_per_group(bindings, ["repo_key"], [c.desc() for c in repository.record_order(F.col("cve_id"))], 5)


@query(f"""with {_BOUND}, q as (select p_partkey, case p_partkey % 3 when 0 then 'own' || p_partkey % 60 || '@' || replace(p_name, ' ', '_') || '_' || p_size % 5 when 1 then 'OWN' || p_partkey % 60 || '@' || replace(p_name, ' ', '-') || '-' || p_size % 5 else 'no at sign' end as asked from part),
  d as (select distinct asked from q where asked like '%@%') select asked, min(repo_key) as repo_key from d join re on owner_key = lower(split_part(asked, '@', 1)) and name_key = replace(split_part(asked, '@', 2), '-', '_') group by 1""")
def found_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    plain = F.concat(F.lit("own"), k % 60, F.lit("@"), F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_size") % 5)
    other = F.concat(F.lit("OWN"), k % 60, F.lit("@"), F.regexp_replace("p_name", " ", "-"), F.lit("-"), F.col("p_size") % 5)
    asked = table(spark, sf_dir, "part").select(F.when(k % 3 == 0, plain).when(k % 3 == 1, other).otherwise("no at sign").alias("asked")).distinct()
    return repository.find_repositories(asked, _bound(spark, sf_dir)["repositories"])


# -- text and records --------------------------------------------------------------------------------------------------


@query("select doc_id, case when strpos(text, 'the ') > 0 then strpos(text, 'the ') - 1 when strpos(lower(text), 'the ') > 0 then strpos(lower(text), 'the ') - 1 end as start from documents")
def grounded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.grounded_start(F.col("text"), F.lit("the ")).cast("long").alias("start"))


@query("""select doc_id, len(f) as found, coalesce(list_aggregate(f, 'min'), '') as first_found from (select doc_id, list_distinct(regexp_extract_all(text, '([0-9]+\\.[0-9]+(?:\\.[0-9]+)*)', 1)) as f from documents)""")
def pattern_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([0-9]+\.[0-9]+(?:\.[0-9]+)*)"), 1))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("found"), F.coalesce(F.array_min(found), F.lit("")).alias("first_found"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_valid(props) as valid from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.expr("try_parse_json(props) is not null").alias("valid"))


@query("select l_orderkey, string_agg(distinct l_returnflag, '|' order by l_returnflag) as flags, count(*) as n from lineitem group by 1")
def string_agg_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.expr("listagg(distinct l_returnflag, '|') within group (order by l_returnflag)").alias("flags"), F.count(F.lit(1)).alias("n"))


@query("""select p_name, count(*) as n from lineitem join part on l_partkey = p_partkey where p_name like '%bolt%' group by 1 order by n desc, p_name limit 5""")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey").join(table(spark, sf_dir, "part").where(F.col("p_name").like("%bolt%")), F.col("l_partkey") == F.col("p_partkey"))
    return evaluate.top_groups(lines, "p_name", 5)


# -- evaluation --------------------------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


_LABELLED = "select doc_id, lang, source, n_chars, quality, toxic from documents join labels using (doc_id)"


def _rates_sql(source: str) -> str:
    f = lambda b: f"round(coalesce((1 + {b}) * p * r / nullif({b} * p + r, 0), 0), 6)"
    return f"select tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, {f(0.25)} as f05, {f(1)} as f1, {f(4)} as f2, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) as jaccard from (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r from {source})"


@query(_rates_sql(f"(select count(*) filter (quality = 1 and n_chars > 1000) as tp, count(*) filter (quality <> 1 and n_chars > 1000) as fp, count(*) filter (quality = 1 and n_chars <= 1000) as fn from ({_LABELLED}))"))
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = evaluate.with_rates(evaluate.confusion(_labelled(spark, sf_dir), F.col("quality") == 1, F.col("n_chars") > 1000))
    return rates.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f05", "f1", "f2", "jaccard")])


@query("""with c as (select l_orderkey, list(distinct l_suppkey) filter (l_returnflag <> 'N') as g, list(distinct l_suppkey) filter (l_quantity > 15) as p from lineitem group by 1),
  x as (select l_orderkey, len(list_intersect(coalesce(g, []), coalesce(p, []))) as tp, len(coalesce(p, [])) as np, len(coalesce(g, [])) as ng from c)
  select l_orderkey, tp, np - tp as fp, ng - tp as fn, round(coalesce(tp / nullif(np, 0), 0), 6) as precision, round(coalesce(tp / nullif(ng, 0), 0), 6) as recall, np = tp and ng = tp as exact from x""")
def case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir)
    return evaluate.set_metrics(cases, "gold", "predicted").select("l_orderkey", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "exact")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") != "N", supplier)).alias("gold"), F.collect_set(F.when(F.col("l_quantity") > 15, supplier)).alias("predicted"))


@query("""with c as (select l_orderkey, list(distinct l_suppkey) filter (l_returnflag <> 'N') as g, list(distinct l_suppkey) filter (l_quantity > 15) as p from lineitem group by 1),
  x as (select len(list_intersect(coalesce(g, []), coalesce(p, []))) as tp, len(coalesce(p, [])) as np, len(coalesce(g, [])) as ng from c), m as (select count(*) as cases, cast(sum(tp) as bigint) as tp, cast(sum(np - tp) as bigint) as fp, cast(sum(ng - tp) as bigint) as fn,
  avg(coalesce(tp / nullif(np, 0), 0)) as mp, avg(cast(np - ng as double)) as bias, avg(abs(np - ng)) as mae, sqrt(avg((np - ng) * (np - ng))) as rmse from x)
  select cases, tp, fp, fn, round(mp, 6) as macro_precision, round(bias, 6) as bias, round(mae, 6) as mae, round(rmse, 6) as rmse, round(tp / (tp + fp), 6) as precision from m""")
def aggregate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = evaluate.aggregate_cases(evaluate.set_metrics(_cases(spark, sf_dir), "gold", "predicted"))
    return total.select("cases", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("macro_precision", "bias", "mae", "rmse", "precision")])


@query(f"""select lang, source, n, good, cast(level as int) as level, round(good / n, 6) as rate from (select lang, source, count(*) as n, count(*) filter (quality = 1) as good, grouping(lang) * 2 + grouping(source) as level from ({_LABELLED}) group by grouping sets ((), (lang), (source), (lang, source)))""")
def rates_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.grouped_rates(_labelled(spark, sf_dir), ["lang", "source"], F.col("quality") == 1).withColumn("rate", F.round("rate", 6))


@query("""select o_orderstatus, count(*) as total, count(*) filter (h = 'HIGH') as n_high, count(*) filter (h = 'LOW') as n_low, round(count(*) filter (h = 'HIGH') / count(*), 6) as share_high, round(count(*) filter (h = 'LOW') / count(*), 6) as share_low
  from (select *, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'HIGH' when o_orderpriority = '5-LOW' then 'LOW' else 'MID' end as h from orders) group by 1""")
def conflict_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    out = evaluate.matrix(table(spark, sf_dir, "orders").withColumn("h", F.when(p.isin("1-URGENT", "2-HIGH"), "HIGH").when(p == "5-LOW", "LOW").otherwise("MID")), "o_orderstatus", "h", ["HIGH", "LOW"])
    return out.select("o_orderstatus", "total", "n_high", "n_low", F.round("share_high", 6).alias("share_high"), F.round("share_low", 6).alias("share_low"))


@query(f"""with o as (select doc_id, quality as v from ({_LABELLED}) where n_chars > 800), n as (select doc_id, case when n_chars > 1500 then 1 else 0 end as v from ({_LABELLED}) where n_chars < 5000)
  select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.v is null then 'added' when n.v is null then 'removed' when o.v = n.v then 'same' else 'changed' end as change from o full join n on o.doc_id = n.doc_id""")
def prediction_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _labelled(spark, sf_dir)
    new = x.where("n_chars < 5000").select("doc_id", F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("v"))
    return evaluate.prediction_difference(x.where("n_chars > 800").select("doc_id", F.col("quality").alias("v")), new, ["doc_id"], "v").select("doc_id", "change")


@query("""select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, quantile_disc(value, 0.9) as p90_disc, round(corr(value, event_id), 6) as correlation from events group by 1""")
def distribution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.distribution(table(spark, sf_dir, "events"), ["event_type"], "value", "event_id")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p50", "p90")], "p90_disc", F.round("correlation", 6).alias("correlation"))


# -- audits ------------------------------------------------------------------------------------------------------------


@query("""select 'line_quantity' as audit, count(*) filter (not l_quantity between 1 and 50) as violations from lineitem union all select 'line_discount', count(*) filter (not l_discount <= 0.05) from lineitem
  union all select 'line_key', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) union all select 'order_customer', count(*) from orders where o_custkey not in (select c_custkey from customer)
  union all select 'line_order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'label_document', count(*) from labels where doc_id not in (select doc_id from documents)""")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return audit.all_audits([
        audit.domain_audits(lines, {"line_quantity": F.col("l_quantity").between(1, 50), "line_discount": F.col("l_discount") <= 0.05}),
        audit.key_audit("line_key", lines, ["l_orderkey", "l_linenumber"]),
        audit.reference_audit("order_customer", orders, "o_custkey", table(spark, sf_dir, "customer"), "c_custkey"),
        audit.reference_audit("line_order", lines, "l_orderkey", orders, "o_orderkey"),
        audit.reference_audit("label_document", table(spark, sf_dir, "labels"), "doc_id", table(spark, sf_dir, "documents"), "doc_id"),
    ])


@query("select 'returned_share' as gate, round(count(*) filter (l_returnflag = 'R') / count(*), 6) as share, count(*) filter (l_returnflag = 'R') / count(*) >= 0.3 as passed from lineitem")
def ratio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.ratio_gate(table(spark, sf_dir, "lineitem"), "returned_share", F.col("l_returnflag") == "R", 0.3).withColumn("share", F.round("share", 6))


_STORED_AUDIT = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, ['nvd_cpe', 'cna_structured', 'llm_description', 'osv'][l_suppkey % 4 + 1] as fam, ['active', 'conflict_review', 'unparsed_review'][l_partkey % 3 + 1] as rec, case when l_linenumber < 4 then 'potentially_affected' when l_linenumber < 6 then 'affected' end as cap,
  ['EXACT', 'CPE_ANY_UNCORROBORATED', 'UNSPECIFIED', 'BOUNDED_RANGE'][l_orderkey % 4 + 1] as cls, l_quantity > 30 as idx, case when l_partkey % 5 > 0 then l_partkey end as claim, case l_linenumber % 4 when 0 then 'DOWNSTREAM_PACKAGE' when 1 then 'UNRESOLVED' when 2 then 'DIRECT_UPSTREAM' end as role, case when l_suppkey % 3 > 0 then 'b' end as basis,
  l_returnflag = 'N' as isd, case when l_linestatus = 'F' then 'unknown' else 'unaffected' end as ds, case when l_partkey % 7 > 0 then 'x' end as dr, l_suppkey % 2 = 0 as di, l_partkey % 11 > 0 as vul, case l_returnflag when 'A' then 'affected' else 'unknown' end as pol, l_linenumber % 3 as rf, case when l_orderkey % 2 = 0 then '*' else '1' end as cv from lineitem"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    text = lambda cond, value: F.when(cond, value)
    return table(spark, sf_dir, "lineitem").select(
        _at(("nvd_cpe", "cna_structured", "llm_description", "osv"), c("l_suppkey") % 4).alias("source_family"), _at(("active", "conflict_review", "unparsed_review"), c("l_partkey") % 3).alias("reconciliation"),
        F.when(c("l_linenumber") < 4, "potentially_affected").when(c("l_linenumber") < 6, "affected").alias("max_result_state"), _at(("EXACT", "CPE_ANY_UNCORROBORATED", "UNSPECIFIED", "BOUNDED_RANGE"), c("l_orderkey") % 4).alias("version_class"),
        (c("l_quantity") > 30).alias("indexed"), text(c("l_partkey") % 5 > 0, c("l_partkey")).alias("llm_claim"), F.when(c("l_linenumber") % 4 == 0, "DOWNSTREAM_PACKAGE").when(c("l_linenumber") % 4 == 1, "UNRESOLVED").when(c("l_linenumber") % 4 == 2, "DIRECT_UPSTREAM").alias("role"),
        text(c("l_suppkey") % 3 > 0, F.lit("b")).alias("role_basis"), (c("l_returnflag") == "N").alias("is_default"), F.when(c("l_linestatus") == "F", "unknown").otherwise("unaffected").alias("default_status"), text(c("l_partkey") % 7 > 0, F.lit("x")).alias("default_raw"),
        (c("l_suppkey") % 2 == 0).alias("default_inferred"), (c("l_partkey") % 11 > 0).alias("vulnerable"), F.when(c("l_returnflag") == "A", "affected").otherwise("unknown").alias("polarity"), (c("l_linenumber") % 3).alias("range_fields"),
        _at(("EXACT", "CPE_ANY_UNCORROBORATED", "UNSPECIFIED", "BOUNDED_RANGE"), c("l_orderkey") % 4).alias("claim_class"), F.when(c("l_orderkey") % 2 == 0, "*").otherwise("1").alias("claim_version"), (c("l_partkey") % 13).alias("comparison"), (c("l_partkey") % 13 + (c("l_suppkey") % 50 == 0).cast("int")).alias("reconciled_comparison"),
    )


@query(f"""with s as ({_STORED_AUDIT}), v as (select count(*) filter (fam = 'llm_description' and rec in ('active', 'conflict_review') and (cap is distinct from 'potentially_affected' or idx or claim is null)) as a1, count(*) filter (cls = 'CPE_ANY_UNCORROBORATED' and cap is distinct from 'potentially_affected') as a2, count(*) filter (cls = 'CPE_ANY_UNCORROBORATED' and idx) as a3,
    count(*) filter (role like 'DOWNSTREAM%' and idx) as a4, count(*) filter (role = 'UNRESOLVED' and idx) as a5, count(*) filter (fam = 'nvd_cpe' and rec in ('active', 'conflict_review') and (role is null or basis is null)) as a6, count(*) filter (cls = 'UNSPECIFIED' and idx) as a7, count(*) filter (fam = 'cna_structured' and isd and ds = 'unknown') as a8,
    count(*) filter (not vul and pol = 'affected') as a9, count(*) filter (fam = 'cna_structured' and dr is null and di and ds = 'unaffected') as b1, count(*) filter (fam = 'nvd_cpe' and cv = '*' and case when rf = 0 then cls <> 'CPE_ANY_UNCORROBORATED' else cls not in ('BOUNDED_RANGE', 'UNBOUNDED_RANGE', 'UNPARSED') end) as b2, count(*) filter (l_suppkey % 50 = 0) as b3 from s)
  select unnest(['A-LLM-VERSION-BINDING', 'A-CPE-ANY-CEILING', 'A-CPE-ANY-INDEX', 'A-CPE-ROLE-UPSTREAM', 'A-CPE-ROLE-UNRESOLVED', 'A-CPE-ROLE-COVERAGE', 'A-UNSPECIFIED-INDEX', 'A-DEFAULTSTATUS-UNKNOWN-ASSERTION', 'A-CONFIG-VULNERABLE-FALSE', 'A-DEFAULTSTATUS-OMITTED', 'A-CPE-RANGE-FIELDS', 'A-IDENTITY-ROLE-RECONCILIATION-DRIFT']) as audit, unnest([a1, a2, a3, a4, a5, a6, a7, a8, a9, b1, b2, b3]) as violations from v
  union all select 'A-CNA-SCOPE-COVERAGE', cast(count(*) filter (cls = 'EXACT') < 0.95 * count(*) as bigint) from s where fam = 'cna_structured' and rec <> 'unparsed_review' union all select 'A-CPE-ROLE-RESOLUTION', cast(count(*) filter (role = 'UNRESOLVED') > 0.9 * count(*) as bigint) from s where fam = 'nvd_cpe' and rec <> 'unparsed_review'""")
def assertion_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _audited(spark, sf_dir)
    counted = F.col("reconciliation") != "unparsed_review"
    return audit.all_audits([
        audit.assertion_audits(a),
        audit.share_audit("A-CNA-SCOPE-COVERAGE", a.where((F.col("source_family") == "cna_structured") & counted), F.col("version_class") == "EXACT", least=0.95),
        audit.share_audit("A-CPE-ROLE-RESOLUTION", a.where((F.col("source_family") == "nvd_cpe") & counted), F.col("role") == "UNRESOLVED", most=0.9),
    ])


@query("""with s as (select l_linenumber as n, l_partkey as p, l_suppkey as u, cast(l_quantity as int) as q, l_orderkey as o from lineitem),
  v as (select count(*) filter (p % 9 = 0) as a, count(*) filter (u % 8 = 0) as b, count(*) filter (n % 2 = 0 and ((q % 2 = 0 and o % 3 = 0) or (q % 3 = 0 and o % 5 = 0))) as c, count(*) filter ((p % 6 = 1 and o % 3 <> 0) or (p % 10 = 1 and o % 5 <> 0)) as d from s)
  select unnest(['A-VERSION-EXACT-COMPARATOR', 'A-WILDCARD-KIND', 'A-CPE-RANGE-SEGMENTS', 'A-COMPARATOR-BOUND']) as audit, unnest([a, b, c, d]) as violations from v""")
def segment_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    p, q, o = c("l_partkey"), c("l_quantity").cast("int"), c("l_orderkey")
    segments = table(spark, sf_dir, "lineitem").select(
        F.when(p % 9 == 0, "<1").otherwise("1").alias("exact"), F.when(o % 3 != 0, F.when(p % 6 == 1, "1=").otherwise("1")).alias("lower"), F.when(o % 5 != 0, F.when(p % 10 == 1, ">2").otherwise("2")).alias("upper"), F.when(c("l_suppkey") % 8 == 0, "wildcard").otherwise("exact").alias("version_kind"),
        F.when(c("l_linenumber") % 2 == 0, "BOUNDED_RANGE").otherwise("EXACT").alias("claim_class"), (q % 2 == 0).alias("start_stated"), (q % 3 == 0).alias("end_stated"),
    )
    return audit.segment_audits(segments)


@query("""with e as (select l_partkey as p, l_suppkey as s, l_linenumber as n, l_orderkey as o from lineitem), v as (select count(*) filter (p % 8 = 0 or s % 9 = 0) as a, count(*) filter (s % 9 = 0 or o % 6 = 0 or n = 7 or p % 5 = 0) as b, count(*) filter (p % 8 <> 0 and p % 8 = 1 and n % 2 = 0) as c from e)
  select unnest(['A-ALIAS-MISSING-EVIDENCE', 'A-ALIAS-BASIS-ENVELOPE', 'A-ALIAS-E4-ACCEPTED']) as audit, unnest([a, b, c]) as violations from v""")
def alias_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, null = F.col, F.lit(None).cast("string")
    p = c("l_partkey")
    basis = F.to_json(F.struct(
        F.when(c("l_orderkey") % 6 == 0, "other").otherwise("bounded_evidence_v1").alias("format"), F.array(F.lit("x"), F.lit("y")).alias("evidence"), F.when(p % 5 == 0, 1).otherwise(2).alias("evidence_count"),
        F.when(c("l_linenumber") == 7, 16).otherwise(32).alias("evidence_examples_limit"), F.lit(False).alias("evidence_truncated"),
    ))
    edges = table(spark, sf_dir, "lineitem").select(F.when(p % 8 == 0, null).when(p % 8 == 1, "E4").otherwise("E1").alias("tier"), F.when(c("l_linenumber") % 2 == 0, "accepted").otherwise("review").alias("status"), F.when(c("l_suppkey") % 9 == 0, F.lit("")).otherwise(basis).alias("basis"))
    return audit.alias_audits(edges)


@query("""with m as (select l_orderkey as cluster, l_linenumber as node, case when l_orderkey % 4 = 0 then 'review' else 'ok' end as st, l_orderkey % 3 = 0 as strict from lineitem where l_orderkey % 2 = 0), k as (select distinct l_orderkey as cluster, l_orderkey * 10 + l_linenumber as node from lineitem where l_orderkey % 2 = 0),
  e as (select l_orderkey as cluster, case when l_quantity > 45 then 'review' else 'accepted' end as status, l_returnflag = 'A' as strict from lineitem where l_orderkey % 2 = 0), d as (select distinct l_orderkey * 10 + 1 as a, l_orderkey * 10 + l_linenumber as b from lineitem where l_linenumber > 1 and l_quantity > 40)
  select 'A-ALIAS-HARD-DISTINCT-CLUSTER' as audit, count(*) as violations from d join k x on x.node = a join k y on y.node = b where x.cluster = y.cluster union all select 'A-ALIAS-NONACCEPTED-IN-CLUSTER', count(*) from e where status <> 'accepted'
  union all select 'A-ALIAS-OVERSIZE-NOT-REVIEW', count(*) from (select cluster from m group by 1 having count(distinct node) > 4 and min(st) = 'ok') union all select 'A-ALIAS-STRICT-CONTAMINATION', count(*) from (select cluster from m where strict group by 1) where cluster in (select cluster from e where not strict)""")
def cluster_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("l_orderkey")
    lines = table(spark, sf_dir, "lineitem")
    even = lines.where("l_orderkey % 2 = 0")
    members = even.select(o.alias("cluster"), (o * 10 + F.col("l_linenumber")).alias("node"), F.when(o % 4 == 0, "review").otherwise("ok").alias("review_state"), (o % 3 == 0).alias("strict")).distinct()
    edges = even.select(o.alias("cluster"), F.when(F.col("l_quantity") > 45, "review").otherwise("accepted").alias("status"), (F.col("l_returnflag") == "A").alias("strict"))
    pairs = lines.where("l_linenumber > 1 and l_quantity > 40").select((o * 10 + 1).alias("a"), (o * 10 + F.col("l_linenumber")).alias("b")).distinct()
    return audit.cluster_audits(members, edges, pairs, largest=4)


@query("""select case when count(*) filter (l_quantity > 49) > 0 then 'draft' else 'published' end as state, array_to_string(list_filter([case when count(*) filter (l_discount > 0.09) > 0 then 'discount' end, case when count(*) filter (l_quantity > 49) > 0 then 'quantity' end], lambda x: x is not null), ',') as failed from lineitem""")
def publish_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.domain_audits(table(spark, sf_dir, "lineitem"), {"quantity": F.col("l_quantity") <= 49, "discount": F.col("l_discount") <= 0.09, "key": F.col("l_orderkey").isNotNull()})
    return audit.publish_state(found).select("state", F.array_join("failed", ",").alias("failed"))


@query("""select l_orderkey, l_linenumber, l_linenumber % 2 = 0 as vulnerable, case when k = 3 then null when k = 2 then 'cpe:2.3:a:v:p' || l_partkey || ':*:*:*:*:*:*:*:*' else 'cpe:2.3:a:v:p' || l_partkey || ':' || q || ':*:*:*:*:*:*:*' end as criteria, case when k = 0 then cast(q as varchar) end as start_including, case k when 1 then (q + 1) || '' when 2 then cast(q as varchar) end as end_including,
  case when k = 0 then (q + 2) || '' end as end_excluding, case when k = 3 then 'unsupported_version_phrase' end as problem from (select *, cast(l_quantity as int) as q, l_orderkey % 5 as k from lineitem)""".replace("l_linenumber % 2 = 0 as vulnerable", "case when k <> 3 then l_linenumber % 2 = 0 end as vulnerable"))
def history_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = F.col("l_quantity").cast("int"), F.col("l_orderkey") % 5
    tail = F.when(k == 0, F.concat(F.lit(" versions from (including) "), q, F.lit(" up to (excluding) "), q + 2)).when(k == 1, F.concat(F.lit(" versions up to (including) "), q + 1)).when(k == 2, " (and previous)").when(k == 3, " versions before that").otherwise("")
    line = F.concat(F.lit("OR\n  "), F.when(F.col("l_linenumber") % 2 == 0, "*").otherwise(""), F.lit("cpe:2.3:a:v:p"), "l_partkey", F.lit(":"), q, F.lit(":*:*:*:*:*:*:*"), tail)
    found = urls.prose_matches(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("text")), F.col("text"))
    return found.select("l_orderkey", "l_linenumber", "vulnerable", "criteria", "start_including", "end_including", "end_excluding", "problem")


# -- nested records ----------------------------------------------------------------------------------------------------


def _cve(key: str) -> Column:
    return F.concat(F.lit("CVE-2024-"), F.lpad(F.col(key).cast("string"), 7, "0"))


_CVE = "'CVE-2024-' || lpad(cast({} as varchar), 7, '0')"


def _record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as nested JSON records, a few of them broken."""
    bound = F.col("l_quantity").cast("int").cast("string")
    versions_of = F.array(F.struct(F.lit("0").alias("version"), F.when(F.col("l_returnflag") == "A", "affected").otherwise("unaffected").alias("status"), F.when(F.col("l_linestatus") == "F", bound).alias("lessThan"), F.when(F.col("l_linestatus") != "F", bound).alias("lessThanOrEqual")))
    item = F.struct((F.col("l_suppkey") % 7).cast("string").alias("vendor"), F.col("l_partkey").cast("string").alias("product"), versions_of.alias("versions"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    leaf = F.struct((k % 2 == 0).alias("vulnerable"), F.lit("cpe:2.3:a:v:p:1:*:*:*:*:*:*:*").alias("criteria"))
    node = F.struct(F.when(k % 5 == 0, "AND").otherwise("odd").alias("operator"), (k % 7 == 0).alias("negate"), F.array(leaf, leaf).alias("cpeMatch"))
    body = F.struct(
        F.when(k % 97 != 0, F.when(k % 89 == 0, F.lit("oops")).otherwise(F.lower(_cve("o_orderkey")))).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("lastModified"), F.col("o_orderstatus").alias("vulnStatus"),
        F.array(F.struct(F.lit("s").alias("source"), F.col("items").alias("affectedData"))).alias("affected"), F.array(F.struct(F.lit("AND").alias("operator"), F.array(node).alias("nodes"))).alias("configurations"),
    )
    return orders.select(F.when(k % 101 == 0, "not json").otherwise(F.to_json(F.struct(body.alias("cve")))).alias("value"), F.lit("memory").alias("source_file"))


@query(f"""with x as (select *, case when o_orderkey % 101 = 0 then 'invalid_json' when o_orderkey % 97 = 0 then 'missing_id' when o_orderkey % 89 = 0 then 'invalid_id' end as error from orders)
  select case when error is null then {_CVE.format('o_orderkey')} when error = 'invalid_id' then 'OOPS' end as cve_id, case when o_orderkey % 101 <> 0 then epoch_us(o_orderdate) end as modified_us, case when o_orderkey % 101 <> 0 then o_orderstatus end as status, error from x""")
def record_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.records(_record_lines(spark, sf_dir)).select("cve_id", "modified_us", "status", "error")


_GOOD = "l_orderkey in (select o_orderkey from orders) and l_orderkey % 101 <> 0 and l_orderkey % 97 <> 0 and l_orderkey % 89 <> 0"


@query(f"""select {_CVE.format('l_orderkey')} as cve_id, vendor, product, status, kind, upper, upper_inclusive, count(*) as n from (select l_orderkey, cast(l_suppkey % 7 as varchar) as vendor, cast(l_partkey as varchar) as product,
  case when l_returnflag = 'A' then 'affected' else 'unaffected' end as status, 'range' as kind, cast(cast(l_quantity as int) as varchar) as upper, l_linestatus <> 'F' as upper_inclusive from lineitem where {_GOOD}) group by all""")
def affected_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.records(_record_lines(spark, sf_dir)).where("error is null")
    segments = records.version_entries(records.affected(found))
    return segments.groupBy("cve_id", "vendor", "product", "status", "kind", "upper", "upper_inclusive").agg(F.count(F.lit(1)).alias("n"))


@query(f"""select {_CVE.format('o_orderkey')} as cve_id, case when o_orderkey % 7 = 0 then case when o_orderkey % 2 = 0 then 'FALSE' else 'TRUE' end else case when o_orderkey % 2 = 0 then 'TRUE' else 'FALSE' end end as truth, cast(2 as bigint) as leaves
  from orders where o_orderkey % 101 <> 0 and o_orderkey % 97 <> 0 and o_orderkey % 89 <> 0""")
def configuration_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Staged, as each level of the trees reads it again.
    found = staged(records.records(_record_lines(spark, sf_dir)).where("error is null").select("cve_id", "record"), "configurations")
    nodes, leaves = records.configuration_leaves(found)
    named = F.concat_ws("#", "cve_id", "tree")
    nodes, leaves = nodes.withColumn("tree_id", named), leaves.withColumn("tree_id", named)
    root = applicability.evaluate_tree(nodes.select("tree_id", "node", "parent", "level", "operator", "negate"), leaves.select("tree_id", "parent", F.col("vulnerable").alias("truth")), 1)
    counts = leaves.groupBy("tree_id").agg(F.count(F.lit(1)).alias("leaves"))
    return root.join(counts, "tree_id").select(F.split_part("tree_id", F.lit("#"), F.lit(1)).alias("cve_id"), tri_text(F.col("truth")).alias("truth"), "leaves")


_EVENT_NAMES = ("CVE Rejected", "CVE Unrejected", "CVE Deleted", "CVE Restored", "CVE Status Change", "Modified Analysis", "Not CVE Rejected")


@query(f"""with x as (select *, event_id % 7 as k, event_id % 5 as d from events), t as (select *, case when k in (0, 2) then 'rejected' when k in (1, 3) then 'active' when k = 4 and d in (1, 2) then 'rejected' when k = 4 and d = 3 then 'active' end as terminal from x)
  select {_CVE.format('user_id')} as cve_id, count(*) as changes, count(*) filter (terminal = 'rejected') as rejections, count(*) filter (terminal = 'active') as returns from t group by user_id""")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    name = F.element_at(F.array(*map(F.lit, _EVENT_NAMES)), (k % 7 + 1).cast("int"))
    detail = lambda kind, value: F.struct(F.lit(kind).alias("type"), F.lit(value).alias("newValue"))
    # The first status detail with a value decides, and only in a status change.
    details = F.when(k % 5 == 1, F.array(detail("Reference", "Rejected"), detail("Vuln Status", " REJECTED "))).when(k % 5 == 2, F.array(detail("CVE Status", ""), detail("CVE Status", "Withdrawn"), detail("CVE Status", "Analyzed")))
    details = details.when(k % 5 == 3, F.array(detail("Status", "Analyzed"), detail("Status", "Rejected"))).when(k % 5 == 4, F.array(detail("CPE", "Rejected"))).otherwise(F.array(detail("Status", "")))
    change = F.struct(_cve("user_id").alias("cveId"), name.alias("eventName"), k.cast("string").alias("cveChangeId"), F.col("ts").cast("string").alias("created"), details.alias("details"))
    events = table(spark, sf_dir, "events").select(F.to_json(F.struct(change.alias("change"))).alias("value"))
    log = records.changes(events.union(events))
    return log.groupBy("cve_id").agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("terminal") == "rejected").alias("rejections"), F.count_if(F.col("terminal") == "active").alias("returns"))


@query("""with base as (select distinct 'k' || c_custkey as cve_id, unnest(['v1', 'v2', 'v3'])  as value from customer),
  ch as (select 'k' || o_custkey as cve_id, epoch_us(o_orderdate) as at_us, ['Added', 'Removed', 'Changed'][o_orderkey % 3 + 1] as action, case when o_orderkey % 3 > 0 then 'v' || o_orderkey % 7 else '' end as old, case when o_orderkey % 3 <> 1 then 'v' || o_orderkey % 5 else '' end as new, o_orderkey from orders),
  op as (select cve_id, value, 0 as at_us, '' as action, '' as old, '' as new, 0 as ph, true as there, cast(null as bigint) as id from base union all select cve_id, old, at_us, action, old, new, 0, false, o_orderkey from ch where action <> 'Added' union all select cve_id, new, at_us, action, old, new, 1, true, o_orderkey from ch where action <> 'Removed'),
  w as (select *, coalesce(lag(there) over o, false) as before, row_number() over (partition by cve_id, value order by at_us desc, action desc, old desc, new desc, id desc nulls last, ph desc) = 1 as final from op window o as (partition by cve_id, value order by at_us, action, old, new, id nulls first, ph)),
  a as (select cve_id, count(distinct id) filter (there <> before) as applied, count(*) filter (not there and not before) as unmatched from w where id is not null group by 1), l as (select cve_id, string_agg(value, ',' order by value) as ranges from w where final and there group by 1)
  select 'k' || c_custkey as cve_id, coalesce(ranges, '') as ranges, coalesce(applied, 0) as applied, coalesce(unmatched, 0) as unmatched from customer left join a on a.cve_id = 'k' || c_custkey left join l on l.cve_id = 'k' || c_custkey""")
def replayed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    base = table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("cve_id"), F.lit('["v1", "v2", "v3"]').alias("ranges"))
    old, new = F.when(k % 3 > 0, F.concat(F.lit("v"), k % 7)), F.when(k % 3 != 1, F.concat(F.lit("v"), k % 5))
    log = table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), "o_custkey").alias("cve_id"), micros("o_orderdate").alias("at_us"), _at(("Added", "Removed", "Changed"), k % 3).alias("action"), old.alias("old_value"), new.alias("new_value"))
    edited = replay.replay_ranges(base, log)
    return edited.select("cve_id", F.array_join(F.from_json("ranges", "array<string>"), ",").alias("ranges"), "applied", "unmatched")


@query("""with g as (select l_suppkey as g, l_suppkey % 3 as s, count(*) as n from lineitem group by 1, 2), r as (select *, (row_number() over (partition by s order by n desc, g) - 1) % 10 as t from g) select cast(g as varchar) as "group", cast(case when t < 5 then t else 9 - t end as int) as part from r""")
def stratified_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("group"), (F.col("l_suppkey") % 3).alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    return replay.balanced_parts(groups, 5, "stratum").select(F.col("group").cast("string").alias("group"), "part")


@query("""with recursive b as (select distinct l_orderkey, l_partkey from lineitem where l_quantity = 50 and l_returnflag = 'A'), e as (select distinct x.l_orderkey as a, y.l_orderkey as b from b x join b y using (l_partkey)), r(node, label) as (select a, a from e union select e.b, r.label from r join e on e.a = r.node)
  select cast(node as varchar) as l_orderkey, cast(min(label) as varchar) as "group" from r group by node""")
def leakage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.record_groups(table(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_returnflag = 'A'"), "l_orderkey", ["l_partkey"])
