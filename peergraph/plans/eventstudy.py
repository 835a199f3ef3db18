"""Event-study queries: users are companies, signups their announcements, days of ``events`` the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergraph.operators import events as es
from peergraph.sources.scratch import table


def _events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _calendar(spark, sf_dir) -> DataFrame:
    from peergraph.operators.ranking import positions

    days = _events(spark, sf_dir).select(F.to_date("ts").alias("date")).distinct().where(F.dayofweek("date").isin(2, 3, 4, 5, 6))
    return positions(days, [F.col("date")], "day")


def _filings(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type = 'signup'")
    e = e.select(F.col("user_id").alias("firm"), F.col("event_id").alias("accession"), F.col("ts").alias("accepted"), F.date_sub(F.to_date("ts"), 2).alias("report_date"))
    return es.day_zero(e, _calendar(spark, sf_dir))


def daily_values(spark, sf_dir) -> DataFrame:
    """(ticker, day, v): a user's total value on a calendar day, in thousandths."""
    days = _calendar(spark, sf_dir)
    return _events(spark, sf_dir).join(F.broadcast(days), F.to_date("ts") == F.col("date")).groupBy(F.col("user_id").alias("ticker"), "day").agg(
        (F.sum(F.floor(F.col("value") * 1000 + 0.5)) / F.lit(1000.0)).alias("v")
    )


def _series(spark, sf_dir) -> DataFrame:
    """(ticker, day, e): a user's total value on a calendar day less the mean of all users that day."""
    daily = daily_values(spark, sf_dir)
    mean = daily.groupBy("day").agg(F.avg("v").alias("m"))
    return daily.join(F.broadcast(mean), "day").select("ticker", "day", (F.col("v") - F.col("m")).alias("e"))


def _announced(spark, sf_dir) -> DataFrame:
    firms = _events(spark, sf_dir).select(F.col("user_id").alias("firm")).distinct()
    return es.build_events(_filings(spark, sf_dir), firms)[0]


def session_label(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", es.session(es.local_time(F.col("ts"))).alias("session"))


def early_close_sessions(spark, sf_dir):
    """Sessions where every tenth calendar day closes at 13:00, and the day that an announcement then counts for."""
    e = _events(spark, sf_dir).where("event_type = 'signup'").select(F.col("user_id").alias("firm"), F.col("event_id").alias("accession"), F.col("ts").alias("accepted"), F.lit(None).cast("date").alias("report_date"))
    days = _calendar(spark, sf_dir)
    early = days.where("day % 10 = 0").select("date", F.lit(13).alias("close_hour"))
    return es.day_zero(e, days, early).select("accession", "session", "day0")


def day_zero_asof(spark, sf_dir):
    return _filings(spark, sf_dir).select("accession", "session", "day0", "moved")


def event_dedupe(spark, sf_dir):
    firms = _events(spark, sf_dir).select(F.col("user_id").alias("firm")).distinct().where("firm % 5 <> 0")
    return es.build_events(_filings(spark, sf_dir), firms)[1]


def window_car(spark, sf_dir):
    return es.window_sums(_series(spark, sf_dir), 0, 1).select("ticker", "day", (F.round("car", 4) + 0.0).alias("car"))


def own_event_overlap(spark, sf_dir):
    """Event pairs and pairs of companies by whether the partner reacts to an own event."""
    car = es.window_sums(_series(spark, sf_dir), 0, 1)
    own = table(_announced(spark, sf_dir).select("firm", "day0"), "announced")
    mine = own.join(car.select(F.col("ticker").alias("firm"), F.col("day").alias("day0")), ["firm", "day0"]).withColumnRenamed("day0", "day")
    other = es.own_event_overlap(car.select(F.col("ticker").alias("partner"), F.col("day").alias("day0")), own, 0, 1).withColumnRenamed("day0", "day")
    sums = es.meetings(mine, other, 5).agg(*[F.sum(c).alias(c) for c in ("n", "gone", "to_gone", "to_kept")])
    row = lambda overlap, n, pairs: F.struct(F.lit(overlap).alias("overlap"), n.alias("n"), pairs.alias("n_pairs"))
    both = F.array(row(True, F.col("gone"), F.col("to_gone")), row(False, F.col("n") - F.col("gone"), F.col("to_kept")))
    return sums.select(F.inline(both)).where("n > 0")


def event_moments(spark, sf_dir):
    m = es.block_moments(*_sides(spark, sf_dir))
    return m.select("firm", "partner", "n", *[(F.round(c, 3) + 0.0).alias(c) for c in ("sx", "sxx", "sy", "sxy")])


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(firm, day, x) of announcers and (partner, day, y) of those without an own event: their pairs are the event pairs that do not overlap."""
    car = es.window_sums(_series(spark, sf_dir), 0, 1)
    own = _announced(spark, sf_dir).select("firm", "day0")
    mine = own.join(car.select(F.col("ticker").alias("firm"), F.col("day").alias("day0"), F.col("car").alias("x")), ["firm", "day0"])
    other = es.own_event_overlap(car.select(F.col("ticker").alias("partner"), F.col("day").alias("day0"), F.col("car").alias("y")), own, 0, 1).where("not overlap")
    return mine.select("firm", F.col("day0").alias("day"), "x"), other.select("partner", F.col("day0").alias("day"), "y")


def _grouped(spark, sf_dir) -> DataFrame:
    """Moments by whether two companies are at most 5 apart and their sum is even."""
    return es.cell_moments(*_sides(spark, sf_dir), 5)


def group_slopes(spark, sf_dir):
    sums = _grouped(spark, sf_dir)
    return sums.select("cell", "n", F.round(es.slope(), 4).alias("slope"))


def news_transfer(spark, sf_dir):
    """Events against all other days, by cell."""
    event = _grouped(spark, sf_dir).select("cell", *[F.col(c).alias(f"e_{c}") for c in ("n", "sx", "sxx", "sy", "sxy")])
    car = es.window_sums(_series(spark, sf_dir), 0, 1)
    quiet = car.join(_announced(spark, sf_dir).select(F.col("firm").alias("ticker"), F.col("day0").alias("day")), ["ticker", "day"], "left_anti")
    a = quiet.select(F.col("ticker").alias("firm"), "day", F.col("car").alias("x"))
    b = quiet.select(F.col("ticker").alias("partner"), "day", F.col("car").alias("y"))
    normal = es.cell_moments(a, b, 5).select("cell", *[F.col(c).alias(f"q_{c}") for c in ("n", "sx", "sxx", "sy", "sxy")])
    return event.join(normal, "cell").select("cell", F.round(es.transfer("e_", "q_"), 4).alias("transfer"))


def spill_regression(spark, sf_dir):
    """Interacted slopes from the cell moments."""
    coef = es.interacted_slopes(_grouped(spark, sf_dir), ["near", "even"])
    return spark.createDataFrame([(k, None if v is None else round(v, 5)) for k, v in coef.items()], "name string, value double")


def day_profile(spark, sf_dir):
    return es.day_profile(_series(spark, sf_dir), _announced(spark, sf_dir)).select(F.coalesce(F.col("offset").cast("string"), F.lit("rest")).alias("day_offset"), F.round("mean_abs", 4).alias("mean_abs"))


def winsorized_moves(spark, sf_dir):
    w = es.winsorized(es.window_sums(_series(spark, sf_dir), 0, 1), "car", 0.01)
    return w.agg(F.round(F.min("car"), 4).alias("lo"), F.round(F.max("car"), 4).alias("hi"), F.count(F.lit(1)).alias("n"))


def placebo_slopes(spark, sf_dir):
    """The slope at day zero and at shifted days."""
    car = es.window_sums(_series(spark, sf_dir), 0, 1)
    shifts = F.explode(F.array(*[F.lit(s) for s in (-20, -10, 0, 10, 20)])).alias("shift")
    own = _announced(spark, sf_dir).select("firm", "day0", shifts).withColumn("day", F.col("day0") + F.col("shift"))
    x = own.join(car.select(F.col("ticker").alias("firm"), "day", F.col("car").alias("x")), ["firm", "day"])
    # all partners of a day by their count and sum, less the firm itself
    days = car.groupBy("day").agg((F.count(F.lit(1)) - 1).cast("double").alias("n"), F.sum("car").alias("y"))
    p, v, y = F.col("n"), F.col("x"), F.col("y") - F.col("x")
    m = x.join(F.broadcast(days), "day").where("n > 0").groupBy("shift").agg(
        F.sum(p).alias("n"), F.sum(v * p).alias("sx"), F.sum(v * v * p).alias("sxx"), F.sum(y).alias("sy"), F.sum(v * y).alias("sxy")
    )
    return m.select("shift", "n", F.round(es.slope(), 4).alias("slope"))


def spill_examples(spark, sf_dir):
    """The ten largest moves with at most two partners per event."""
    from pyspark.sql import Window

    mine, other = _sides(spark, sf_dir)
    y, largest = F.round("y", 4), Window.partitionBy("day0").orderBy(F.desc(F.abs("y")), "partner")
    # one of a day's three largest may be the announcer itself
    three = other.select("partner", F.col("day").alias("day0"), y.alias("y")).withColumn("r", F.row_number().over(largest)).where("r <= 3").drop("r")
    p = mine.select("firm", F.col("day").alias("day0"), F.round("x", 4).alias("x")).join(F.broadcast(three), "day0").where("firm <> partner").select("firm", "partner", "day0", "x", "y")
    w = Window.partitionBy("firm", "day0").orderBy(F.desc(F.abs("y")), "partner")
    top = p.withColumn("r", F.row_number().over(w)).where("r <= 2").drop("r")
    return top.orderBy(F.desc(F.abs("x")), F.desc(F.abs("y")), "firm", "partner", "day0").limit(10)


QUERIES = {
    f.__name__: f
    for f in (
        session_label, early_close_sessions, day_zero_asof, event_dedupe, window_car, own_event_overlap, event_moments, group_slopes, news_transfer, spill_regression,
        day_profile, winsorized_moves, placebo_slopes, spill_examples,
    )
}

STUDY = """
cal as (select date, row_number() over (order by date) - 1 as day from (select distinct ts::date as date from events) where dayofweek(date) between 1 and 5),
loc as (select event_id as accession, user_id as firm, ts as accepted, timezone('America/New_York', timezone('UTC', ts)) as local, ts::date - 2 as report from events where event_type = 'signup'),
sess as (select *, case when hour(local) >= 16 then 'after' when hour(local) * 60 + minute(local) < 570 then 'pre' else 'intraday' end as session from loc),
firsts as (
  select *, coalesce((select min(day) from cal where case when session = 'after' then date > local::date else date >= local::date end), -1) as own,
         coalesce((select min(day) from cal where date >= report), -1) as told,
         (local::date - report between 1 and 4) and report not in (select date from cal) and session <> 'pre' as use
  from sess
), filed as (
  select accession, firm, accepted, session, use and told <> own as moved, case when (case when use then told else own end) >= 1 then (case when use then told else own end) else -1 end::bigint as day0 from firsts
), announced as (select distinct firm, day0 from filed where day0 >= 0),
daily as (select user_id as ticker, day, sum(floor(value * 1000 + 0.5)::bigint)::double / 1000 as v from events join cal on ts::date = date group by all),
series as (select ticker, day, v - avg(v) over (partition by day) as e from daily),
car as (
  select ticker, day, car from (
    select ticker, day, sum(e) over w as car, count(*) over w as n from series
    window w as (partition by ticker order by day range between current row and 1 following)) where n = 2
), pairs as (
  select a.firm, c.ticker as partner, a.day0, m.car as x, c.car as y,
         exists (select 1 from announced o where o.firm = c.ticker and o.day0 between a.day0 - 1 and a.day0 + 1) as overlap
  from announced a join car m on m.ticker = a.firm and m.day = a.day0 join car c on c.day = a.day0 and c.ticker <> a.firm
), moments as (
  select firm, partner, count(*)::double as n, sum(x) as sx, sum(x * x) as sxx, sum(y) as sy, sum(x * y) as sxy from pairs where not overlap group by all
), celled as (select *, case when abs(firm - partner) <= 5 then '1' else '0' end || case when (firm + partner) % 2 = 0 then '1' else '0' end as cell from moments)"""

ORACLES = {
    "session_label": """
select event_id, case when hour(l) >= 16 then 'after' when hour(l) * 60 + minute(l) < 570 then 'pre' else 'intraday' end as session
from (select event_id, timezone('America/New_York', timezone('UTC', ts)) as l from events)""",
    "early_close_sessions": """
with cal as (select date, row_number() over (order by date) - 1 as day from (select distinct ts::date as date from events) where dayofweek(date) between 1 and 5),
l as (select event_id as accession, timezone('America/New_York', timezone('UTC', ts)) as t from events where event_type = 'signup'),
s as (select accession, t::date as d, case when hour(t) >= case when cal.day % 10 = 0 then 13 else 16 end then 'after' when hour(t) * 60 + minute(t) < 570 then 'pre' else 'intraday' end as session from l left join cal on cal.date = t::date),
z as (select *, (select min(day) from cal where case when session = 'after' then date > d else date >= d end) as own from s)
select accession, session, case when own >= 1 then own else -1 end::bigint as day0 from z""",
    "day_zero_asof": f"with {STUDY} select accession, session, day0, moved from filed",
    "event_dedupe": f"""with {STUDY} select outcome, count(*) as n from (
  select case when firm % 5 = 0 then 'no_returns' when day0 < 0 then 'outside'
              when row_number() over (partition by firm, day0 order by accepted, accession) > 1 then 'duplicate' else 'event' end as outcome from filed) group by outcome""",
    "window_car": f"with {STUDY} select ticker, day, round(car, 4) + 0.0::double as car from car",
    "own_event_overlap": f"with {STUDY} select overlap, count(*) as n, count(distinct (firm, partner)) as n_pairs from pairs group by overlap",
    "event_moments": f"with {STUDY} select firm, partner, n, round(sx, 3) + 0.0::double as sx, round(sxx, 3) + 0.0::double as sxx, round(sy, 3) + 0.0::double as sy, round(sxy, 3) + 0.0::double as sxy from moments",
    "group_slopes": f"with {STUDY} select cell, sum(n) as n, round((sum(sxy) - sum(sx) * sum(sy) / sum(n)) / (sum(sxx) - sum(sx) * sum(sx) / sum(n)), 4) as slope from celled group by cell",
    "day_profile": f"""with {STUDY}, near as (select firm as ticker, day0 + o as day, o::int as "offset" from announced, unnest(range(-3, 6)) t(o))
select "offset"::varchar as day_offset, round(avg(abs(e)), 4) as mean_abs from near join series using (ticker, day) group by "offset"
union all select 'rest', round(avg(abs(e)), 4) from series where (ticker, day) not in (select (ticker, day) from near)""",
    "winsorized_moves": f"""with {STUDY} select round(quantile_cont(car, 0.01), 4) as lo, round(quantile_cont(car, 0.99), 4) as hi, count(*) as n from car""",
    "placebo_slopes": f"""with {STUDY}, m as (
  select s::int as shift, count(*)::double as n, sum(a.car) as sx, sum(a.car * a.car) as sxx, sum(b.car) as sy, sum(a.car * b.car) as sxy
  from announced, unnest([-20, -10, 0, 10, 20]) t(s), car a, car b where a.ticker = firm and a.day = day0 + s and b.day = a.day and b.ticker <> firm group by s)
select shift, n, round((sxy - sx * sy / n) / (sxx - sx * sx / n), 4) as slope from m""",
    "spill_examples": f"""with {STUDY}, p as (select firm, partner, day0, round(x, 4) as x, round(y, 4) as y from pairs where not overlap),
r as (select *, row_number() over (partition by firm, day0 order by abs(y) desc, partner) as r from p)
select firm, partner, day0, x, y from r where r <= 2 order by abs(x) desc, abs(y) desc, firm, partner, day0 limit 10""",
}
