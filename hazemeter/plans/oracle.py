"""Plain SQL answers for the registered queries, to be run by another engine.

Each statement is written from the definitions, over raw readings and without the
tricks of the DataFrame operators: windows are range joins, streaks are
subqueries, probes pair every batch with every earlier arrival.
"""

from __future__ import annotations

from hazemeter.params import DAY, DEFAULTS, HOUR, MINUTE
from hazemeter.plans.fixtures import BATCH_MS, BATCH_READINGS, ODD, ODD_EVERY, SHIFT, T0

STEP = DEFAULTS.step_ms
TEN_MIN = 10 * MINUTE

# Rows of (concentration from, index from, concentration to, index to).
_PM25 = [
    (0, 0, 12, 50), (12, 50, 12.1, 51), (12.1, 51, 35.4, 100), (35.4, 100, 35.5, 101),
    (35.5, 101, 55.4, 150), (55.4, 150, 55.5, 151), (55.5, 151, 150.4, 200),
    (150.4, 200, 150.5, 201), (150.5, 201, 250.4, 300), (250.4, 300, 250.5, 301),
    (250.5, 301, 350.4, 400), (350.4, 400, 350.5, 401), (350.5, 401, 500.4, 500),
    (500.4, 500, 500.5, 501), (500.5, 501, 99999.9, 999),
]
_PM10 = [
    (0, 0, 54, 50), (54, 50, 55, 51), (55, 51, 154, 100), (154, 100, 155, 101),
    (155, 101, 254, 150), (254, 150, 255, 151), (255, 151, 354, 200), (354, 200, 355, 201),
    (355, 201, 424, 300), (424, 300, 425, 301), (425, 301, 504, 400), (504, 400, 505, 401),
    (505, 401, 604, 500), (604, 500, 605, 501), (605, 501, 99999, 999),
]


def _f(x) -> str:
    return f"cast({x} as float)"


def _index(v: str, rows) -> str:
    parts = [f"when {v} <= {_f(0)} then 0"]
    for x0, y0, x1, y1 in rows:
        slope = f"({_f(y1 - y0)} / ({_f(x1)} - {_f(x0)}))"
        parts.append(
            f"when {v} <= {_f(x1)} then cast(floor(cast({slope} * ({v} - {_f(x0)}) + {_f(y0)} as double) + 0.5) as integer)"
        )
    return f"case {' '.join(parts)} else 999 end"


def pm25(v: str) -> str:
    return _index(f"(cast(floor({_f(v)} * {_f(10)}) as float) / {_f(10)})", _PM25)


def pm10(v: str) -> str:
    return _index(f"cast(floor({_f(v)}) as float)", _PM10)


def _huge(col: str, usual: str, kind: str) -> str:
    """Readings of 10 ** 15 and more count as infinite, positive ones before negative ones."""
    return f"case when max({col}) >= 1e15 then 'Infinity'::{kind} when min({col}) <= -1e15 then '-Infinity'::{kind} else {usual} end"


def _sum(col: str) -> str:
    """To nine decimals, whole and broken parts apart."""
    part = lambda x: f"sum(cast(case when abs({col}) < 1e15 then {x} else 0 end as decimal(38,9)))"
    return f"cast({part(f'trunc({col})')} + {part(f'{col} - trunc({col})')} as double)"


def _mean(col: str) -> str:
    return _huge(col, f"cast({_sum(col)} / count(*) as float)", "float")


def _total(col: str) -> str:
    return _huge(col, _sum(col), "double")


def _reading(value: str, side: int) -> str:
    """A value with the odd ones in place."""
    cases = " ".join(f"when {rest} then '{pair[side]}'::double" for rest, pair in ODD.items())
    return f"case event_id % {ODD_EVERY} {cases} else {value} end"


def _slice(t: str, step: int = STEP, origin: int = 0) -> str:
    return f"({t} - ((({t} - {origin}) % {step}) + {step}) % {step})"


# Polygons of the nations and the containment test, edge by edge.
_LAT = "cast(47.013 + (event_id % 80) / 10.0 as float)"
_LON = "cast(6.017 + (user_id % 95) / 10.0 as float)"
_GEO = {
    "pts": f"select distinct {_LAT} as lat, {_LON} as lon from events",
    "box": """
        select n_nationkey as i, printf('%05d', n_nationkey) as zipcode,
               case when n_nationkey = 1 then 'NATION_0' else n_name end as city,
               cast(47.0 as double) + cast(1.6 as double) * (n_nationkey // 5) as s,
               cast(6.0 as double) + cast(1.8 as double) * (n_nationkey % 5) as w from nation""",
    "seg": """
        select i, w as x0, s as y0, w + 1.8::double as x1, s as y1 from box
        union all select i, w + 1.8::double, s, w + 1.8::double, s + 1.6::double from box where i % 2 = 0
        union all select i, w + 1.8::double, s + 1.6::double, w, s + 1.6::double from box where i % 2 = 0
        union all select i, w + 1.8::double, s, w, s + 1.6::double from box where i % 2 = 1
        union all select i, w, s + 1.6::double, w, s from box""",
    "hits": """
        select p.lat, p.lon, g.i from pts p join seg g
          on (g.y0 > p.lat::double) <> (g.y1 > p.lat::double)
         and p.lon::double < (g.x1 - g.x0) * (p.lat::double - g.y0) / (g.y1 - g.y0) + g.x0
        group by all having count(*) % 2 = 1""",
    "placed": """
        select lat, lon, min(zipcode) as zipcode, arg_min(city, zipcode) as city
        from hits join box using (i) group by all""",
}


# Number of the nested batch an event is delivered in.
_CHUNK = (
    f"(case when ms >= {T0} then event_id - (select min(event_id) from ev where ms >= {T0}) "
    f"else event_id end) // {BATCH_READINGS}"
)


class Base:
    """Common table expressions for one way of reading the events."""

    def __init__(
        self, wide=False, late=False, located=False, active=DEFAULTS.active_ms, step=STEP, size=DAY, origin=0, odd=False
    ):
        city = "user_id" if wide else "user_id % 20"
        delay = " + (case when event_id % 50 = 7 then 1 else 0 end)" if late else ""
        seq = "cast(floor(({0} - {1}) / {2}.0) as bigint)".format(
            f"(case when ms >= {T0} then ms else ms + {SHIFT} end)", T0, BATCH_MS
        ) + delay
        if located:
            seq = _CHUNK
        shifted = f"(case when ms >= {T0} then ms else ms + {SHIFT} end)"
        self.ctes: dict[str, str] = {}
        self.ctes["ev"] = "select *, epoch_us(ts) // 1000 as ms from events"
        self.ctes["rd"] = f"""
            select cast({city} as varchar) as city, event_id as pos, event_type,
                   {_reading('value', 0) if odd else 'value'} as p1, {_reading('value * 0.25', 1) if odd else 'value * 0.25'} as p2,
                   case when ms >= {T0} then 'current' else 'lastyear' end as period, {shifted} as ts_ms,
                   {seq} as seq
            from ev"""
        watermarks_of = "rd"
        if located:  # single-precision readings, cities from geometry, watermarks from all readings
            watermarks_of = "everywhere"
            self.ctes["everywhere"] = self.ctes.pop("rd")
            for part in _GEO:
                self.ctes[part] = _GEO[part]
            self.ctes["rd"] = f"""
                select p.city, e.pos, cast(cast(e.p1 as float) as double) as p1,
                       cast(cast(e.p2 as float) as double) as p2, e.period, e.ts_ms, e.seq
                from everywhere e join events v on v.event_id = e.pos join placed p
                  on p.lat = {_LAT} and p.lon = {_LON}"""
        self.ctes["hd"] = f"""
            select seq, coalesce(max_by(ts_ms, pos) filter (where period = 'current'), max_by(ts_ms, pos)) as wm
            from {watermarks_of} group by seq"""
        self.ctes["adv"] = """
            select seq, wm from hd h where not exists (select 1 from hd e where e.seq < h.seq and e.wm > h.wm)"""
        self.ctes["arr"] = "select city, period, seq, max(ts_ms) as max_ts from rd group by all"
        self.ctes["probes"] = f"""
            select h.seq, h.wm, a.city, a.period from adv h join arr a on a.seq <= h.seq
            group by all having max(a.max_ts) >= h.wm - {active}"""
        self.ctes["bounds"] = f"""
            select a.city, a.period, a.seq, greatest(max(p.wm), min(f.origin)) as bound
            from arr a left join probes p on p.city = a.city and p.period = a.period and p.seq < a.seq
            join (select city, period, {_slice('arg_min(ts_ms, (seq, pos))', step, origin)} as origin
                  from rd group by all) f on f.city = a.city and f.period = a.period
            group by a.city, a.period, a.seq"""
        self.ctes["kept"] = """
            select r.* from rd r join bounds b on b.city = r.city and b.period = r.period and b.seq = r.seq
            where r.ts_ms >= b.bound"""
        self.ctes["slices"] = f"""
            select city, period, {_slice('ts_ms', step, origin)} + {step} as slice_end,
                   {_total('p1')} as s1, {_total('p2')} as s2, count(*) as n
            from kept group by all"""
        self.ctes["ends"] = f"""
            select city, period, slice_end as e from slices
            union select city, period, slice_end + {step} from slices"""
        self.ctes["snap"] = f"""
            select city, period, ts_ms, greatest({pm25('m2')}, {pm10('m1')}) as aqi,
                   {pm10('m1')} as aqi_p1, {pm25('m2')} as aqi_p2
            from (select g.city, g.period, g.e as ts_ms, {_mean('k.p1')} as m1, {_mean('k.p2')} as m2
                  from ends g join kept k on k.city = g.city and k.period = g.period
                       and k.ts_ms >= g.e - {size} and k.ts_ms < g.e
                  group by all)"""
        self.ctes["w4"] = f"""
            select seq, city, period, ts_ms, greatest({pm25('m2')}, {pm10('m1')}) as aqi,
                   {pm10('m1')} as aqi_p1, {pm25('m2')} as aqi_p2
            from (select p.seq, p.city, p.period, p.wm as ts_ms, {_mean('k.p1')} as m1, {_mean('k.p2')} as m2
                  from probes p join kept k on k.city = p.city and k.period = p.period
                       and k.ts_ms >= p.wm - {size} and k.ts_ms < p.wm
                  group by all having max(k.ts_ms) >= p.wm - {active})"""
        self.ctes["m5"] = f"""
            select w.seq, w.city, w.period, w.ts_ms,
                   coalesce(cast(sum(s.aqi) as double) / count(s.aqi), cast(w.aqi as double)) as aqi,
                   w.aqi_p1, w.aqi_p2
            from w4 w left join snap s on s.city = w.city and s.period = w.period
                 and s.ts_ms > w.ts_ms - {5 * DAY} and s.ts_ms <= w.ts_ms
            group by w.seq, w.city, w.period, w.ts_ms, w.aqi, w.aqi_p1, w.aqi_p2"""
        self.ctes["imp"] = """
            select c.seq, c.city, c.ts_ms,
                   case when c.aqi < 0 or l.aqi < 0 then -1.0::double else l.aqi - c.aqi end as improvement,
                   c.aqi_p1, c.aqi_p2
            from m5 c join m5 l on l.city = c.city and l.ts_ms = c.ts_ms and l.seq = c.seq
            where c.period = 'current' and l.period = 'lastyear'"""
        self.ctes["vals"] = """
            select null::bigint as seq, *, false as is_probe from snap
            union all by name select *, true as is_probe from w4"""
        self.ctes["cur"] = """
            select *, aqi between 0 and 50 as good from vals where period = 'current'"""
        self.ctes["bad"] = """
            select a.city, a.ts_ms, max(b.ts_ms) as last_bad
            from (select distinct city, ts_ms from cur) a
            left join cur b on b.city = a.city and b.ts_ms <= a.ts_ms and not b.good
            group by all"""
        self.ctes["since"] = """
            select d.city, d.ts_ms, min(g.ts_ms) as good_since
            from bad d left join cur g on g.city = d.city and g.good and g.ts_ms <= d.ts_ms
                 and g.ts_ms > coalesce(d.last_bad, -1)
            group by all"""
        self.ctes["strk"] = """
            select c.seq, c.city, c.ts_ms as ts_last, s.good_since
            from cur c join since s on s.city = c.city and s.ts_ms = c.ts_ms where c.is_probe"""

    def sql(self, last: str, select: str) -> str:
        """``select`` with every table expression up to ``last``."""
        names = list(self.ctes)
        used = names[: names.index(last) + 1]
        return "with " + ", ".join(f"{n} as ({self.ctes[n]})" for n in used) + " " + select


def _width(wm: str, origin: int) -> str:
    return f"cast(least(greatest({wm} - {origin}, 0) // 14, {7 * DAY // 14}) as integer)"


def _bucket(streak: str, width: str) -> str:
    inside = f"least(least({streak}, {7 * DAY}) // {width}, 13)"
    return f"cast(case when {width} > 0 and {streak} is not null then {inside} else 0 end as integer)"


def _milli(x: str) -> str:
    return f"cast(floor({x} * 1000.0 + 0.5) as integer)"


def _top(k: int) -> str:
    return f"""
        select seq as batch_seq_id, position, city, {_milli('improvement')} as avg_improvement,
               {_milli('aqi_p1')} as current_p1, {_milli('aqi_p2')} as current_p2
        from (select *, cast(row_number() over (partition by seq order by improvement desc, city) as integer) as position
              from imp where improvement >= 0) where position <= {k}"""


def _streak_buckets(origin: int) -> str:
    return f"""
        select seq, city, ts_last, good_since, {_width('ts_last', origin)} as width,
               {_bucket('(ts_last - good_since)', _width('ts_last', origin))} as bucket
        from strk"""


def _histogram(origin: int) -> str:
    share = f"cast({_f('n')} / {_f('total')} as float) * {_f(1000)}"
    return f"""
        select h.seq as batch_seq_id, cast(b.i * {_width('h.wm', origin)} as integer) as bucket_from,
               cast((b.i + 1) * {_width('h.wm', origin)} as integer) as bucket_to,
               coalesce(cast(floor(cast({share} as double) + 0.5) as integer), 0) as bucket_percent
        from hd h cross join (select unnest(range(14)) as i) b
        left join (select seq, bucket, count(*) as n from ({_streak_buckets(origin)}) group by all) c
               on c.seq = h.seq and c.bucket = b.i
        left join (select seq, count(*) as total from strk group by all) t on t.seq = h.seq"""


def _answers(origin: int) -> str:
    """Both results, with a row for batches without a ranking."""
    return f"""
        select 'q1' as question, h.seq as batch_seq_id, city, position as a, avg_improvement as b,
               current_p1 as c, current_p2 as d from (select distinct seq from hd) h
        left join ({_top(20)}) t on t.batch_seq_id = h.seq
        union all
        select 'q2', batch_seq_id, null, bucket_from, bucket_to, bucket_percent, null
        from ({_histogram(origin)})"""


def statements() -> dict[str, str]:
    plain, wide = Base(), Base(wide=True, active=12 * HOUR)
    late, odd = Base(late=True), Base(odd=True)
    custom = Base(step=15 * MINUTE, size=6 * HOUR, origin=MINUTE)
    origin, origin_wide = DEFAULTS.histogram_origin_ms, T0
    ev = plain.ctes["ev"]
    per_batch = f"""
        with ev as ({ev}), b as (select {_CHUNK} as seq_id, ms >= {T0} as cur from ev)
        select seq_id, seq_id = (select max(seq_id) from b) as last,
               cast(count(*) filter (where cur) as integer) as n_current,
               cast(count(*) filter (where not cur) as integer) as n_lastyear
        from b group by seq_id"""
    located = Base(located=True, active=6 * HOUR)
    places = "with " + ", ".join(f"{name} as ({sql})" for name, sql in _GEO.items())
    near_in_time = plain.sql("rd", f"""
        select c.city, c.pos, l.pos as r_pos, l.ts_ms - c.ts_ms as apart from rd c join rd l
          on c.city = l.city and l.ts_ms between c.ts_ms - {10 * MINUTE} and c.ts_ms + {25 * MINUTE}
        where c.period = 'current' and l.period = 'lastyear'""")
    out = {
        "aqi_pm25": f"select event_id, {pm25('value * 2')} as aqi from events",
        "aqi_pm10": f"select event_id, {pm10('value * 2')} as aqi from events",
        "aqi_combined": f"select event_id, greatest({pm25('value * 0.5')}, {pm10('value')}) as aqi from events",
        "aqi_good": f"select event_id, greatest({pm25('value * 0.25')}, {pm10('value')}) <= 50 as good from events",
        "slice_align": f"with ev as ({ev}) select event_id, {_slice('ms', STEP, T0)} as slice_start from ev",
        "slice_membership": f"""
            with ev as ({ev}), s as (select event_id, ms, ms - ms % {HOUR} + {20 * MINUTE} as a,
                                            ms - ms % {HOUR} + {40 * MINUTE} as b from ev)
            select event_id, cast(case when ms < a then -1 when ms < b then 0 else 1 end as integer) as side from s""",
        "ts_normalize": """
            with m as (select event_id, epoch_us(ts) as us from events)
            select event_id, us // 1000000 * 1000 + us % 1000000 * 1000 // 1000000 as ts_ms,
                   us // 1000000 * 1000 + us % 1000000 * 1000 // 1000 as ts_ms_micros from m""",
        "utc_time": f"with ev as ({ev}) select event_id, make_timestamp(ms * 1000) as utc from ev",
        "period_shift": plain.sql("rd", "select pos, period, ts_ms from rd"),
        "period_split": plain.sql("rd", "select period, seq, count(*) as n, min(ts_ms) as first_ts, max(ts_ms) as last_ts from rd group by all"),
        "batch_limit": f"select * from ({per_batch}) where seq_id in (select seq_id from ({per_batch}) order by seq_id limit 20)",
        "ordered_prefix": f"""
            with ev as ({ev}),
                 b as (select event_type as feed, (ms - {T0 - 14 * DAY}) // {HOUR} as seq_id, count(*) as n from ev group by all),
                 k as (select *, row_number() over (partition by feed order by seq_id) as rn from b)
            select feed, seq_id, n from k where rn - 1 = seq_id and seq_id < 500""",
        "flatten_batches": located.sql("everywhere", """
            select r.seq, row_number() over (partition by r.seq, r.period order by r.pos) - 1 as pos, r.period, r.ts_ms,
                   cast(cast(r.p1 as float) as double) as p1, cast(cast(r.p2 as float) as double) as p2
            from everywhere r"""),
        "batch_watermark": located.sql("hd", "select seq, wm, wm as flat_wm from hd"),
        "watermark_guard": plain.sql("hd", f"select seq, wm from hd where wm <= {T0 + 7 * DAY}"),
        "active_probes": plain.sql("probes", "select seq, wm, city, period from probes"),
        "active_probes_wide": wide.sql("probes", "select seq, wm, city, period from probes"),
        "late_drop": late.sql("kept", "select city, period, seq, pos, ts_ms from kept"),
        "late_slice_sums": late.sql("slices", """
            select city, period, slice_end, s1 as sum_p1, s2 as sum_p2, n from slices"""),
        "q1_results_flat": wide.sql("imp", f"""
            select h.seq as batch_seq_id, t.* exclude (batch_seq_id) from (select distinct seq from hd) h
            left join ({_top(20)}) t on t.batch_seq_id = h.seq"""),
        "q1_located": located.sql("imp", _top(20)),
        "q2_located": located.sql("strk", _histogram(origin_wide)),
        "streamed_answers": located.sql("strk", _answers(origin_wide)),
        "point_in_polygon": f"{places} select lat, lon, zipcode, city from placed",
        "city_lookup_distinct": f"""
            {places} select event_id as pos, p.city from events join placed p
              on p.lat = {_LAT} and p.lon = {_LON}""",
        "interval_join_exact": plain.sql("slices", """
            select c.city, c.slice_end as ts_ms, c.n as n, l.n as r_n from slices c join slices l
              on c.city = l.city and c.slice_end = l.slice_end
            where c.period = 'current' and l.period = 'lastyear'"""),
        "interval_join_range": near_in_time,
        "interval_join_streamed": near_in_time,
        "released_feeds": f"""
            with b as ({per_batch}), top as (select max(seq_id) as top from b),
            cases(together, part, feed, until) as (
              select false, 0, 'a', top // 2 + 1 from top union all select false, 0, 'b', top // 3 from top
              union all select true, 0, 'a', top // 3 from top union all select true, 0, 'b', top // 3 from top
              union all select false, 2, 'a', top + 1 from top union all select false, 2, 'b', top - 1 from top
              union all select true, 2, 'a', top - 1 from top union all select true, 2, 'b', top - 1 from top)
            select together, cast(part as integer) as part, feed, seq_id, cast(n_current as bigint) as current, cast(n_lastyear as bigint) as lastyear
            from b, cases where seq_id < until""",
        "state_kept": located.sql("kept", f"""
            , low as (select (max(wm) - {DAY} - {STEP}) // {DAY} as day from adv where seq < (select max(seq) from hd))
            select city, period, ts_ms // {DAY} as day, count(*) as n from kept
            where ts_ms // {DAY} >= (select day from low) group by all"""),
        "q1_results_json": wide.sql("imp", f"""
            , top as ({_top(20)})
            select h.seq as batch_seq_id, cast(coalesce(t.list, '[]') as varchar) as topkimproved
            from (select distinct seq from hd) h
            left join (select batch_seq_id, cast(to_json(list(struct_pack(position, city, avg_improvement, current_p1, current_p2) order by position)) as varchar) as list
                       from top group by batch_seq_id) t on t.batch_seq_id = h.seq"""),
        "slice_sums": odd.sql("slices", "select city, period, slice_end, s1 as sum_p1, s2 as sum_p2, n from slices"),
        "aqi24_snapshots_odd": odd.sql("snap", "select * from snap"),
        "aqi24_at_watermark_odd": odd.sql("w4", "select * from w4"),
        "avg_aqi_odd": odd.sql("rd", f"""
            select city, period, greatest({pm25('m2')}, {pm10('m1')}) as aqi
            from (select city, period, {_mean('p1')} as m1, {_mean('p2')} as m2 from rd group by all)"""),
        "slice_densify": plain.sql("slices", f"""
            select g.city, g.period, g.slice_end, coalesce(s.n, 0) as n, coalesce(s.s1, 0) as sum_p1
            from (select city, period, unnest(range(min(slice_end), max(slice_end) + 1, {STEP})) as slice_end
                  from slices group by city, period) g
            left join slices s on s.city = g.city and s.period = g.period and s.slice_end = g.slice_end"""),
        "avg_aqi_by_city": plain.sql("rd", f"""
            select city, period, greatest({pm25('m2')}, {pm10('m1')}) as aqi
            from (select city, period, {_mean('p1')} as m1, {_mean('p2')} as m2 from rd group by all)"""),
        "aqi24_snapshots": plain.sql("snap", "select * from snap"),
        "aqi24_custom_window": custom.sql("snap", "select * from snap"),
        "aqi24_at_watermark": plain.sql("w4", "select * from w4"),
        "aqi24_at_watermark_wide": wide.sql("w4", "select * from w4"),
        "aqi24_no_history": plain.sql("w4", f"""
            , buys as (select * from rd where event_type = 'purchase'),
            known as (
              select seq, city, period, ts_ms, greatest({pm25('m2')}, {pm10('m1')}) as aqi,
                     {pm10('m1')} as aqi_p1, {pm25('m2')} as aqi_p2
              from (select p.seq, p.city, p.period, p.wm as ts_ms, {_mean('k.p1')} as m1, {_mean('k.p2')} as m2
                    from probes p join buys k on k.city = p.city and k.period = p.period
                         and k.ts_ms >= p.wm - {DAY} and k.ts_ms < p.wm
                    group by all having max(k.ts_ms) >= p.wm - {TEN_MIN}))
            select seq, city, period, ts_ms, aqi, aqi_p1, aqi_p2 from known
            union all
            select p.seq, p.city, p.period, p.wm, -1, 0, 0 from probes p
            where not exists (select 1 from buys b where b.city = p.city and b.period = p.period and b.seq <= p.seq)"""),
        "aqi24_all": plain.sql("vals", "select seq, city, period, ts_ms, aqi, aqi_p1, aqi_p2, is_probe from vals"),
        "aqi5d": wide.sql("m5", "select * from m5"),
        "aqi5d_cold_start": wide.sql("m5", f"""
            select m.*, exists (select 1 from snap s where s.city = m.city and s.period = m.period
                                and s.ts_ms > m.ts_ms - {5 * DAY} and s.ts_ms <= m.ts_ms) as is_mean from m5 m"""),
        "results_sink": wide.sql("strk", _answers(origin_wide)),
        "archive_replay": f"select * from ({per_batch}) where seq_id >= 10",
        "locations_cached": """
            select lpad(cast(n_nationkey as varchar), 5, '0') as zipcode,
                   case when n_nationkey = 1 then 'NATION_0' else n_name end as city, 1::integer as n_rings,
                   cast(case when n_nationkey % 2 = 0 then 5 else 4 end as integer) as n_points from nation""",
        "released_batches": located.sql("everywhere", """
            , r as (select seq, period, row_number() over (partition by seq, period order by pos) - 1 as pos from everywhere),
            top as (select max(seq) as top from r),
            rule as (select 'gap' as rule, top * 3 // 4 as until from top union all select 'last', top // 2 + 1 from top union all select 'cap', 7)
            select rule, seq, period, count(*) as n, cast(sum(pos) as bigint) as places from r, rule
            where seq < until and not (period = 'current' and seq % 5 = 0 and pos % 10 = 0)
            group by all"""),
        "aqi_improvement": wide.sql("imp", "select * from imp"),
        "q1_top50": plain.sql("imp", _top(50)),
        "q1_topk_wide": wide.sql("imp", _top(20)),
        "good_streak": plain.sql("since", """
            select c.city, c.ts_ms, c.is_probe, case when c.good then s.good_since end as good_since
            from cur c join since s on s.city = c.city and s.ts_ms = c.ts_ms"""),
        "streak_at_watermark": wide.sql("strk", "select * from strk"),
        "streak_bucket": wide.sql("strk", _streak_buckets(origin_wide)),
        "bucket_width": plain.sql("hd", f"select seq, wm, {_width('wm', T0)} as width, {_width('wm', origin)} as full_width from hd"),
        "q2_histogram": plain.sql("strk", _histogram(origin)),
        "q2_histogram_wide": wide.sql("strk", _histogram(origin_wide)),
    }
    return {name: " ".join(sql.split()) for name, sql in out.items()}
