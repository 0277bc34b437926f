"""Queries of the grammar over the TPC-H-like tables, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .expr import NA, Call, f
from .functions.conditional import across, between, case_match, case_when, coalesce, if_all, if_any, if_else, is_in, is_na, na_if, near, pick
from .functions.math import abs, as_character, as_double, as_integer, as_logical, ceiling, exp, floor, log, log2, log10, pmax, pmin, round, sqrt
from .functions.summary import IQR, all, any, first, last, mad, max, mean, median, min, n, n_distinct, nth, quantile, sd, sum, var
from .functions.window import consecutive_id, cumall, cumany, cume_dist, cummax, cummean, cummin, cumsum, dense_rank, desc, lag, lead, min_rank, ntile, percent_rank, row_number
from .operators.bind import bind_cols, bind_rows
from .operators.groups import group_by, group_keys, group_vars, n_groups, ungroup
from .operators.joins import anti_join, closest, cross_join, full_join, inner_join, join_by, left_join, nest_join, overlaps, right_join, semi_join, within
from .operators.rows import arrange, distinct, filter, mutate, pull, relocate, rename, rename_with, select
from .operators.sets import intersect, setdiff, symdiff, union, union_all
from .operators.slices import slice_head, slice_max, slice_min, slice_sample, slice_tail
from .operators.summarise import add_count, count, reframe, summarise, tally
from .sources import read_parquet
from .table import Table
from .tidyselect import all_of, any_of, contains, ends_with, everything, last_col, matches, num_range, starts_with, where
from .types import is_character, is_double, is_integer, is_logical, is_numeric

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of tables: its parameters name the tables it reads."""

    def register(fn):
        names = fn.__code__.co_varnames[: fn.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*(read_parquet(spark, f"{sf_dir}/{t}.parquet") for t in names)).to_spark()

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_extendedprice), 6) AS price, round(avg(l_discount), 6) AS discount
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(lineitem: Table) -> Table:
    import datetime

    return (
        lineitem
        >> filter(f.l_shipdate <= datetime.datetime(1998, 9, 2))
        >> mutate(net=f.l_extendedprice * (1 - f.l_discount))
        >> group_by(f.l_returnflag, f.l_linestatus)
        >> summarise(n=n(), qty=sum(f.l_quantity), revenue=round(sum(f.net), 2), price=round(mean(f.l_extendedprice), 6), discount=round(mean(f.l_discount), 6), _groups="drop")
        >> arrange(f.l_returnflag, f.l_linestatus)
    )


@query("""
SELECT c_mktsegment, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def segment_revenue(lineitem: Table, orders: Table, customer: Table) -> Table:
    return (
        lineitem
        >> select(f.l_orderkey, f.l_extendedprice, f.l_discount)
        >> inner_join(orders >> select(f.o_orderkey, f.o_custkey), by={"l_orderkey": "o_orderkey"})
        >> inner_join(customer >> select(f.c_custkey, f.c_mktsegment), by={"o_custkey": "c_custkey"})
        >> summarise(n=n(), revenue=round(sum(f.l_extendedprice * (1 - f.l_discount)), 2), _by=f.c_mktsegment)
    )


@query("SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orders_without_lineitems(orders: Table, lineitem: Table) -> Table:
    return orders >> anti_join(lineitem, by={"o_orderkey": "l_orderkey"})


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def customers_with_orders(customer: Table, orders: Table) -> Table:
    return customer >> semi_join(orders, by={"c_custkey": "o_custkey"})


@query("""
SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name
FROM nation FULL JOIN (SELECT r_regionkey + 1 AS r_regionkey, r_name FROM region) ON n_regionkey = r_regionkey""")
def nation_region_full(nation: Table, region: Table) -> Table:
    return nation >> full_join(region >> mutate(r_regionkey=as_integer(f.r_regionkey + 1)), by={"n_regionkey": "r_regionkey"}, keep=True)


@query("""
SELECT coalesce(n_regionkey, r_regionkey) AS n_regionkey, n_name, r_name
FROM (SELECT * FROM nation WHERE n_nationkey < 7) RIGHT JOIN region ON n_regionkey = r_regionkey""")
def nation_region_right(nation: Table, region: Table) -> Table:
    return nation >> filter(f.n_nationkey < 7) >> select(f.n_regionkey, f.n_name) >> right_join(region, by={"n_regionkey": "r_regionkey"})


@query("SELECT a.r_name AS \"r_name.x\", b.r_name AS \"r_name.y\" FROM region a CROSS JOIN region b")
def region_pairs(region: Table) -> Table:
    return region >> select(f.r_name) >> cross_join(region >> select(f.r_name))


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r <= 3""")
def top3_orders_per_customer(orders: Table) -> Table:
    return orders >> slice_max(f.o_totalprice, n=3, _by=f.o_custkey) >> select(f.o_custkey, f.o_orderkey, f.o_totalprice)


@query("""
SELECT p_brand, p_partkey, p_size FROM (
  SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part) WHERE r <= 2""")
def min_ties(part: Table) -> Table:
    return part >> slice_min(f.p_size, n=2, _by=f.p_brand) >> select(f.p_brand, f.p_partkey, f.p_size)


@query("""
SELECT user_id, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS b FROM events)
WHERE a <= 2 OR b <= 1""")
def event_ends(events: Table) -> Table:
    ordered = events >> arrange(f.ts)
    return bind_rows(ordered >> slice_head(n=2, _by=f.user_id), ordered >> slice_tail(n=1, _by=f.user_id)) >> distinct(f.user_id, f.event_id)


@query("""
SELECT event_id, user_id, sum(value) OVER w AS total, avg(value) OVER w AS average, min(value) OVER w AS least, max(value) OVER w AS most,
       lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS before, lead(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY ts) AS after
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)""".replace("sum(value) OVER w AS total, avg(value) OVER w AS average", "round(sum(value) OVER w, 6) AS total, round(avg(value) OVER w + 0.0000001, 5) AS average"))
def running_value(events: Table) -> Table:
    return (
        events
        >> arrange(f.ts)
        >> group_by(f.user_id)
        >> mutate(total=round(cumsum(f.value), 6), average=round(cummean(f.value) + 0.0000001, 5), least=cummin(f.value), most=cummax(f.value), before=lag(f.value), after=lead(f.value, 2, default=-1.0))
        >> ungroup()
        >> select(f.event_id, f.user_id, f["total":"after"])
    )


@query("""
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS position, rank() OVER w AS low, dense_rank() OVER w AS dense,
       CASE WHEN count(*) OVER (PARTITION BY event_type) = 1 THEN 'nan'::DOUBLE ELSE percent_rank() OVER w END AS percent, cume_dist() OVER w AS cume,
       ntile(4) OVER (PARTITION BY event_type ORDER BY value, ts) AS quarter
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)""")
def event_ranks(events: Table) -> Table:
    return (
        events
        >> arrange(f.ts)
        >> mutate(position=row_number(), _by=f.user_id)
        >> mutate(low=min_rank(f.value), dense=dense_rank(f.value), percent=percent_rank(f.value), cume=cume_dist(f.value), quarter=ntile(f.value, 4), _by=f.event_type)
        >> select(f.event_id, f["position":"quarter"])
    )


@query("""
WITH marked AS (
  SELECT user_id, ts, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) OR row_number() OVER (PARTITION BY user_id ORDER BY ts) = 1 THEN 1 ELSE 0 END AS fresh FROM events
), runs AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT user_id, CAST(max(run) AS BIGINT) AS runs FROM runs GROUP BY user_id""")
def event_runs(events: Table) -> Table:
    return events >> arrange(f.ts) >> summarise(runs=max(consecutive_id(f.event_type)), _by=f.user_id)


@query("""
SELECT p_brand, quantile_cont(p_retailprice, 0.1) AS low, median(p_retailprice) AS middle, quantile_cont(p_retailprice, 0.9) AS high FROM part GROUP BY p_brand""")
def price_quantiles(part: Table) -> Table:
    return part >> summarise(low=quantile(f.p_retailprice, 0.1), middle=median(f.p_retailprice), high=quantile(f.p_retailprice, 0.9), _by=f.p_brand)


@query("""
SELECT p_brand, round(quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25), 6) AS spread, round(1.4826 * mad(p_retailprice), 6) AS deviation,
       round(stddev_samp(p_retailprice), 6) AS sd, round(var_samp(p_retailprice), 4) AS var FROM part GROUP BY p_brand""")
def price_spread(part: Table) -> Table:
    return part >> summarise(spread=round(IQR(f.p_retailprice), 6), deviation=round(mad(f.p_retailprice), 6), sd=round(sd(f.p_retailprice), 6), var=round(var(f.p_retailprice), 4), _by=f.p_brand)


@query("""
SELECT l_returnflag, p AS prob, quantile_cont(l_quantity, 0.25) AS q FROM lineitem, (SELECT 0.25 AS p) GROUP BY ALL
UNION ALL SELECT l_returnflag, 0.5, quantile_cont(l_quantity, 0.5) FROM lineitem GROUP BY ALL
UNION ALL SELECT l_returnflag, 0.75, quantile_cont(l_quantity, 0.75) FROM lineitem GROUP BY ALL""".replace("p AS prob", "CAST(p AS DOUBLE) AS prob").replace(", 0.5, quant", ", 0.5::DOUBLE, quant").replace(", 0.75, quant", ", 0.75::DOUBLE, quant"))
def reframe_quartiles(lineitem: Table) -> Table:
    return lineitem >> reframe(prob=[0.25, 0.5, 0.75], q=quantile(f.l_quantity, [0.25, 0.5, 0.75]), _by=f.l_returnflag)


@query("""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN 'now' WHEN '5-LOW' THEN 'later' ELSE 'soon' END AS due,
       nullif(o_orderstatus, 'O') AS closed, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, o_orderstatus IN ('F', 'P') AS done FROM orders""")
def priority_recode(orders: Table) -> Table:
    return (
        orders
        >> mutate(due=case_match(f.o_orderpriority, (["1-URGENT", "2-HIGH"], "now"), ("5-LOW", "later"), _default="soon"), closed=na_if(f.o_orderstatus, "O"))
        >> mutate(status=coalesce(f.closed, "open"), done=is_in(f.o_orderstatus, ["F", "P"]))
        >> select(f.o_orderkey, f.due, f.closed, f.status, f.done)
    )


@query("""
SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size BETWEEN 11 AND 30 THEN 'medium' ELSE 'large' END AS bucket,
       CASE WHEN p_retailprice > 1000 THEN 'dear' ELSE 'cheap' END AS price, abs(p_size - 25) < 1.5 AS central FROM part""")
def size_bucket(part: Table) -> Table:
    return (
        part
        >> mutate(bucket=case_when((f.p_size <= 10, "small"), (between(f.p_size, 11, 30), "medium"), _default="large"), price=if_else(f.p_retailprice > 1000, "dear", "cheap"), central=near(f.p_size, 25, tol=1.5))
        >> select(f.p_partkey, f.bucket, f.price, f.central)
    )


@query("""
SELECT event_id, o_orderkey FROM events e LEFT JOIN orders o ON user_id = o_custkey AND ts >= o_orderdate
  AND o_orderdate = (SELECT max(o_orderdate) FROM orders p WHERE p.o_custkey = e.user_id AND p.o_orderdate <= e.ts)""")
def last_order_before_event(events: Table, orders: Table) -> Table:
    return events >> left_join(orders, by=join_by(f.user_id == f.o_custkey, closest(f.ts >= f.o_orderdate))) >> select(f.event_id, f.o_orderkey)


@query("""
WITH c AS (SELECT user_id, ts AS click_ts, event_id AS click_id FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT event_id, click_id FROM p JOIN c ON p.user_id = c.user_id AND p.ts > click_ts
  AND click_ts = (SELECT max(click_ts) FROM c d WHERE d.user_id = p.user_id AND d.click_ts < p.ts)""")
def click_before_purchase(events: Table) -> Table:
    clicks = events >> filter(f.event_type == "click") >> select(f.user_id, click_ts=f.ts, click_id=f.event_id)
    return events >> filter(f.event_type == "purchase") >> inner_join(clicks, by=join_by("user_id", closest(f.ts > f.click_ts))) >> select(f.event_id, f.click_id)


BANDS = "(VALUES ('a', 900.0, 1100.0), ('b', 1000.0, 1300.0), ('c', 1300.0, 1301.0), ('d', 0.0, 100.0)) t(band, lo, hi)"


def bands(part: Table) -> Table:
    """Four price bands, made in place from the first parts."""
    return (
        part
        >> arrange(f.p_partkey)
        >> slice_head(n=4)
        >> mutate(band=["a", "b", "c", "d"], lo=[900.0, 1000.0, 1300.0, 0.0], hi=[1100.0, 1300.0, 1301.0, 100.0], _keep="none")
    )


@query(f"SELECT p_partkey, band FROM part JOIN {BANDS} ON p_retailprice BETWEEN lo AND hi")
def price_band_range(part: Table) -> Table:
    return part >> inner_join(bands(part), by=join_by(between(f.p_retailprice, f.lo, f.hi))) >> select(f.p_partkey, f.band)


@query(f"SELECT p_partkey, band FROM part JOIN {BANDS} ON p_retailprice - 20 <= hi AND p_retailprice + 20 >= lo")
def price_band_overlaps(part: Table) -> Table:
    return part >> mutate(xl=f.p_retailprice - 20, xu=f.p_retailprice + 20) >> inner_join(bands(part), by=join_by(overlaps(f.xl, f.xu, f.lo, f.hi))) >> select(f.p_partkey, f.band)


@query(f"SELECT p_partkey, band FROM part LEFT JOIN {BANDS} ON p_retailprice - 20 >= lo AND p_retailprice + 20 <= hi")
def price_band_within(part: Table) -> Table:
    return part >> mutate(xl=f.p_retailprice - 20, xu=f.p_retailprice + 20) >> left_join(bands(part), by=join_by(within(f.xl, f.xu, f.lo, f.hi))) >> select(f.p_partkey, f.band)


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_brands(part: Table) -> Table:
    return part >> distinct(f.p_brand, f.p_type)


@query("SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_type")
def count_types(part: Table) -> Table:
    return part >> count(f.p_type) >> inner_join(part >> summarise(brands=n_distinct(f.p_brand), _by=f.p_type), by="p_type")


@query("SELECT s_suppkey, s_nationkey, count(*) OVER (PARTITION BY s_nationkey) AS n, round(sum(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS balance FROM supplier")
def add_count_nation(supplier: Table) -> Table:
    return supplier >> add_count(f.s_nationkey) >> add_count(f.s_nationkey, wt=f.s_acctbal, name="balance") >> mutate(balance=round(f.balance, 4)) >> select(f.s_suppkey, f.s_nationkey, f.n, f.balance)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def tally_status(orders: Table) -> Table:
    return orders >> group_by(f.o_orderstatus) >> tally()


def _nations(customer: Table, supplier: Table):
    return customer >> filter(f.c_acctbal > 0) >> select(nation=f.c_nationkey), supplier >> filter(f.s_acctbal > 5000) >> select(nation=f.s_nationkey)


_C, _S = "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 0", "SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal > 5000"


@query(f"{_C} UNION {_S}")
def cust_supp_nations_union(customer: Table, supplier: Table) -> Table:
    x, y = _nations(customer, supplier)
    return x >> union(y)


@query(f"{_C} UNION ALL {_S}")
def cust_supp_nations_union_all(customer: Table, supplier: Table) -> Table:
    x, y = _nations(customer, supplier)
    return x >> union_all(y)


@query(f"{_C} INTERSECT {_S}")
def cust_supp_nations_intersect(customer: Table, supplier: Table) -> Table:
    x, y = _nations(customer, supplier)
    return x >> intersect(y)


@query(f"{_C} EXCEPT {_S}")
def cust_supp_nations_setdiff(customer: Table, supplier: Table) -> Table:
    x, y = _nations(customer, supplier)
    return x >> setdiff(y)


@query(f"(({_C}) EXCEPT ({_S})) UNION (({_S}) EXCEPT ({_C}))")
def cust_supp_nations_symdiff(customer: Table, supplier: Table) -> Table:
    x, y = _nations(customer, supplier)
    return x >> symdiff(y)


@query("SELECT s_suppkey FROM (SELECT *, avg(s_acctbal) OVER (PARTITION BY s_nationkey) AS m FROM supplier) WHERE s_acctbal > m")
def above_group_mean(supplier: Table) -> Table:
    return supplier >> group_by(f.s_nationkey) >> filter(f.s_acctbal > mean(f.s_acctbal)) >> ungroup() >> select(f.s_suppkey)


@query("SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS above FROM orders")
def share_of_total(orders: Table) -> Table:
    return (
        orders
        >> mutate(total=sum(f.o_totalprice), share=round(f.o_totalprice / f.total, 9), _by=f.o_custkey)
        >> mutate(above=round(f.o_totalprice - mean(f.o_totalprice), 4))
        >> select(f.o_orderkey, f.share, f.above)
    )


@query("""
SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def nested_lines(orders: Table, lineitem: Table) -> Table:
    from pyspark.sql import functions as F

    nested = orders >> select(f.o_orderkey) >> nest_join(lineitem >> select(f.l_orderkey, f.l_partkey), by={"o_orderkey": "l_orderkey"}, name="items")
    return nested.but(nested.df.withColumn("lines", F.size("items").cast("bigint"))) >> select(f.o_orderkey, f.lines)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(((l_partkey % -7) + CASE WHEN l_partkey % -7 <> 0 THEN -7 ELSE 0 END) AS BIGINT) AS remainder,
  CAST(floor(l_partkey / -7.0) AS BIGINT) AS quotient, l_quantity / (l_linenumber - 1) AS ratio, power(l_discount, 2) AS squared,
  ln(l_discount) AS logged, floor(l_extendedprice) AS down, ceil(l_extendedprice) AS up, round_even(l_quantity / 4, 0) AS rounded,
  least(l_discount, l_tax) AS low, greatest(l_discount, l_tax) AS high, sqrt(l_quantity) AS root, CAST(abs(l_linenumber - 4) AS BIGINT) AS distance
FROM lineitem""")
def math_suite(lineitem: Table) -> Table:
    return (
        lineitem
        >> mutate(
            remainder=f.l_partkey % -7, quotient=f.l_partkey // -7, ratio=f.l_quantity / (f.l_linenumber - 1), squared=f.l_discount**2, logged=log(f.l_discount),
            down=floor(f.l_extendedprice), up=ceiling(f.l_extendedprice), rounded=round(f.l_quantity / 4), low=pmin(f.l_discount, f.l_tax), high=pmax(f.l_discount, f.l_tax),
            root=sqrt(f.l_quantity), distance=abs(f.l_linenumber - 4),
        )
        >> select(f.l_orderkey, f.l_linenumber, f.l_partkey, f.l_suppkey, f["remainder":"distance"])
    )


@query("""
SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_custkey AS DOUBLE) AS real, CAST(o_custkey AS VARCHAR) AS text,
  CASE WHEN o_custkey % 2 <> 0 THEN 'TRUE' ELSE 'FALSE' END AS flag, TRY_CAST(TRY_CAST(o_orderpriority AS DOUBLE) AS BIGINT) AS none FROM orders""")
def cast_suite(orders: Table) -> Table:
    return (
        orders
        >> mutate(whole=as_integer(f.o_totalprice), real=as_double(f.o_custkey), text=as_character(f.o_custkey), flag=as_character(as_logical(f.o_custkey % 2)), none=as_integer(f.o_orderpriority))
        >> select(f.o_orderkey, f["whole":"none"])
    )


@query("""
SELECT user_id, bool_or(value > 90) AS some, bool_and(value > 1) AS every, arg_min(event_id, ts) AS opening, arg_max(event_id, ts) AS closing,
  (SELECT event_id FROM events x WHERE x.user_id = e.user_id ORDER BY ts LIMIT 1 OFFSET 1) AS second, count(DISTINCT event_type) AS types FROM events e GROUP BY user_id""")
def any_all_flags(events: Table) -> Table:
    return events >> arrange(f.ts) >> summarise(some=any(f.value > 90), every=all(f.value > 1), opening=first(f.event_id), closing=last(f.event_id), second=nth(f.event_id, 2), types=n_distinct(f.event_type), _by=f.user_id)


@query("""
SELECT '1' AS source, c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT '2', s_suppkey, s_name, NULL FROM supplier""")
def bind_parties(customer: Table, supplier: Table) -> Table:
    return bind_rows(customer >> select(key=f.c_custkey, name=f.c_name, segment=f.c_mktsegment), supplier >> select(key=f.s_suppkey, name=f.s_name), _id="source")


@query("SELECT r_regionkey, r_name, n_name FROM region JOIN (SELECT n_nationkey, n_name FROM nation) ON r_regionkey = n_nationkey")
def bound_columns(region: Table, nation: Table) -> Table:
    return bind_cols(region >> arrange(f.r_regionkey), nation >> arrange(f.n_nationkey) >> slice_head(n=5) >> select(f.n_name))


@query("SELECT r_name AS R_NAME, r_regionkey AS region FROM region")
def renamed_region(region: Table) -> Table:
    return region >> rename(region=f.r_regionkey) >> relocate(f.region, _after=f.r_name) >> rename_with(str.upper, starts_with("r_"))


@query("SELECT p_size, p_retailprice FROM part")
def numeric_part_columns(part: Table) -> Table:
    return part >> select(where(is_numeric) & ~ends_with("key"))


@query("""
SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity_mean, max(l_quantity) AS l_quantity_max, round(avg(l_tax), 6) AS l_tax_mean, max(l_tax) AS l_tax_max FROM lineitem GROUP BY l_returnflag""")
def across_summary(lineitem: Table) -> Table:
    return lineitem >> select(f.l_returnflag, f.l_quantity, f.l_tax) >> summarise(across(everything(), {"mean": lambda x: round(mean(x), 6), "max": max}), _by=f.l_returnflag)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_discount > 0.09 OR l_tax > 0.07) AND l_quantity > 10 AND l_extendedprice > 10")
def if_any_all_filter(lineitem: Table) -> Table:
    return (
        lineitem
        >> filter((f.l_discount > 0.09) | (f.l_tax > 0.07))
        >> filter(if_all(["l_quantity", "l_extendedprice"], lambda x: x > 10), ~if_any(["l_quantity", "l_extendedprice"], is_na))
        >> select(f.l_orderkey, f.l_linenumber, f.l_quantity)
    )


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand, p_size) AS place FROM part")
def pick_rank(part: Table) -> Table:
    return part >> mutate(place=dense_rank(pick(f.p_brand, f.p_size))) >> select(f.p_partkey, f.place)


@query("SELECT s_nationkey FROM supplier GROUP BY s_nationkey")
def supplier_groups(supplier: Table) -> Table:
    return supplier >> group_by(f.s_nationkey) >> group_keys()


@query("SELECT o_custkey, CAST(floor(count(*) * 0.5) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING floor(count(*) * 0.5) > 0")
def sampled_orders(orders: Table) -> Table:
    return orders >> slice_sample(prop=0.5, seed=7, _by=f.o_custkey) >> count(f.o_custkey)


@query("SELECT event_id, bool_and(value > 5) OVER w AS still, bool_or(value > 95) OVER w AS ever FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)")
def running_logic(events: Table) -> Table:
    return events >> arrange(f.ts) >> mutate(still=cumall(f.value > 5), ever=cumany(f.value > 95), _by=f.user_id) >> select(f.event_id, f.still, f.ever)


@query("SELECT p_partkey, exp(p_size / 100.0) AS e, log2(p_size) AS two, log10(p_size) AS ten FROM part")
def log_suite(part: Table) -> Table:
    return part >> mutate(e=exp(f.p_size / 100.0), two=log2(f.p_size), ten=log10(f.p_size)) >> select(f.p_partkey, f.e, f.two, f.ten)


@query("SELECT p_brand, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY p_brand ORDER BY high DESC")
def extremes(part: Table) -> Table:
    return part >> summarise(low=min(f.p_size), high=max(f.p_size), _by=f.p_brand) >> arrange(desc(f.high))



@query("SELECT p_name, p_brand, p_type, p_partkey, p_size, p_retailprice FROM part")
def columns_by_name(part: Table) -> Table:
    return part >> select(contains("NAME"), matches("^p_(brand|type)$"), all_of(["p_partkey"]), any_of(["p_size", "absent"]), last_col())


@query("SELECT p_partkey, p_brand, p_size FROM part")
def columns_left_out(part: Table) -> Table:
    return part >> select(-f.p_type, -(contains("price") | all_of("p_name")))


@query("SELECT o_orderkey, o_totalprice AS x1, o_totalprice * 2 AS x2, o_totalprice * 10 AS x10 FROM orders")
def numbered_columns(orders: Table) -> Table:
    return orders >> mutate(x1=f.o_totalprice, x10=f.o_totalprice * 10, x2=f.o_totalprice * 2) >> select(f.o_orderkey, num_range("x", [1, 2, 3, 10]))


@query("SELECT p_partkey, p_size FROM part")
def integer_columns(part: Table) -> Table:
    return part >> select(where(is_integer))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def double_columns(lineitem: Table) -> Table:
    return lineitem >> select(f.l_orderkey, f.l_linenumber, f.l_partkey, where(is_double))


@query("SELECT p_partkey, p_brand FROM part")
def character_columns(part: Table) -> Table:
    return part >> select(f.p_partkey, where(is_character) & ~ends_with("e"))


@query("SELECT event_id, value > 50 AS high, value < 5 AS low FROM events")
def logical_columns(events: Table) -> Table:
    return events >> mutate(high=f.value > 50, low=f.value < 5) >> select(f.event_id, where(is_logical))


@query("SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM (SELECT *, rank() OVER (ORDER BY c_acctbal DESC) AS r FROM customer) WHERE r <= 3)")
def orders_of_pulled_customers(orders: Table, customer: Table) -> Table:
    return orders >> filter(is_in(f.o_custkey, customer >> slice_max(f.c_acctbal, n=3) >> pull(f.c_custkey)))


@query("SELECT n_nationkey, (SELECT count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)) AS groups, 'c_nationkey c_mktsegment' AS vars FROM nation")
def groups_of_customers(nation: Table, customer: Table) -> Table:
    grouped = customer >> group_by(f.c_nationkey, f.c_mktsegment)
    return nation >> mutate(groups=grouped >> n_groups(), vars=" ".join(grouped >> group_vars())) >> select(f.n_nationkey, f.groups, f.vars)


def _statuses(orders: Table):
    marked = orders >> mutate(status=na_if(f.o_orderstatus, "O")) >> select(f.o_orderkey, f.status)
    return marked, marked >> summarise(size=n(), _by=f.status)


_MARKED = "WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders), s AS (SELECT status, count(*) AS size FROM o GROUP BY status) SELECT o_orderkey, o.status, size FROM o"


@query(f"{_MARKED} LEFT JOIN s ON o.status IS NOT DISTINCT FROM s.status")
def missing_keys_match(orders: Table) -> Table:
    marked, sizes = _statuses(orders)
    return marked >> left_join(sizes, by="status")


@query(f"{_MARKED} LEFT JOIN s ON o.status = s.status")
def missing_keys_never_match(orders: Table) -> Table:
    marked, sizes = _statuses(orders)
    return marked >> left_join(sizes, by="status", na_matches="never")


@query("SELECT n_nationkey, (SELECT min(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS opening, (SELECT max(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS closing FROM nation")
def first_and_last_match(nation: Table, customer: Table) -> Table:
    ordered, by = customer >> arrange(f.c_custkey), {"n_nationkey": "c_nationkey"}
    return (
        nation
        >> select(f.n_nationkey)
        >> left_join(ordered >> select(f.c_nationkey, opening=f.c_custkey), by=by, multiple="first")
        >> left_join(ordered >> select(f.c_nationkey, closing=f.c_custkey), by=by, multiple="last")
    )


@query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def checked_relationship(nation: Table, region: Table) -> Table:
    return nation >> left_join(region, by={"n_regionkey": "r_regionkey"}, relationship="many-to-one", unmatched="error")


@query("SELECT a.n_regionkey, a.n_name AS n_name_a, b.n_name AS n_name_b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def suffixed_pairs(nation: Table) -> Table:
    names = nation >> select(f.n_regionkey, f.n_name)
    return names >> inner_join(names, by="n_regionkey", suffix=("_a", "_b"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, s_name FROM part JOIN supplier ON p_size = s_suppkey")
def keys_of_two_widths(part: Table, supplier: Table) -> Table:
    return part >> select(f.p_partkey, f.p_size) >> inner_join(supplier >> select(f.s_suppkey, f.s_name), by={"p_size": "s_suppkey"})


_BEFORE = "WITH b AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)"


@query(f"""
{_BEFORE} SELECT user_id, CAST(NULL AS DOUBLE) AS total, round(coalesce(sum(before), 0), 6) AS known, max(before) AS most, count(*) - count(before) AS gaps,
  CASE WHEN bool_or(before > 90) THEN true END AS some, CASE WHEN NOT bool_and(before > 5) THEN false END AS every FROM b GROUP BY user_id HAVING count(before) > 0""")
def missing_values_summarised(events: Table) -> Table:
    """Each user's first event has nothing before it: a sum over it is missing, and so are any() and all() unless the rest decides."""
    return (
        events
        >> arrange(f.ts)
        >> mutate(before=lag(f.value), _by=f.user_id)
        >> filter(n() > 1, _by=f.user_id)
        >> summarise(total=sum(f.before), known=round(sum(f.before, na_rm=True), 6), most=max(f.before, na_rm=True), gaps=sum(is_na(f.before)), some=any(f.before > 90), every=all(f.before > 5), _by=f.user_id)
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN 'nan'::DOUBLE ELSE 1.0 END AS ratio, l_linenumber = 1 AS gone, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE 1.0 END AS filled FROM lineitem""")
def not_a_number(lineitem: Table) -> Table:
    return lineitem >> mutate(ratio=(f.l_linenumber - 1) / (f.l_linenumber - 1)) >> mutate(gone=is_na(f.ratio), filled=coalesce(f.ratio, 0.0)) >> select(f.l_orderkey, f.l_linenumber, f.l_partkey, f["ratio":"filled"])


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS dear FROM orders")
def missing_by_choice(orders: Table) -> Table:
    return orders >> mutate(dear=if_else(f.o_totalprice > 100000, f.o_totalprice, NA)) >> select(f.o_orderkey, f.dear)


@query("SELECT p_brand, round(sum(ln(p_size)), 6) AS volume FROM part GROUP BY p_brand")
def users_own_summary(part: Table) -> Table:
    """A summary that the library lacks, given as a Spark aggregate."""
    from pyspark.sql import functions as F

    logs = Call("logs", "summary", lambda mask, v: F.sum(F.log(v.col.cast("double"))), [f.p_size])
    return part >> summarise(volume=round(logs, 6), _by=f.p_brand)
