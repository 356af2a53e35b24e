"""The registered queries again as DuckDB SQL, written from the definitions."""

from __future__ import annotations

DAY_GAP = 86400
TWO_DAY_GAP = 172800
# Days that move the log over the end of a month.
MONTH_SHIFT = 16
# Every such event is sent with the last file of the feed.
DELAYED = 50
THREE_POINTS = [(121.3, 31.2), (121.4, 31.3), (121.35, 31.25)]


def _e(value: float) -> str:
    """A double literal; plain decimals would be DECIMAL."""
    return f"{value!r}::double"


_GCJ = """
raw as (
  select 'U' || lpad(cast(user_id as varchar), 5, '0') as obd_id, event_id, ts,
    case when kind >= 98 then 200e0 when kind = 97 then 110e0
      else 121e0 + (user_id % 40) * 2e-2 + ((event_id * 7919) % 1000) * 5e-5 end as wlng,
    308e-1 + (user_id % 25) * 3e-2 + ((event_id * 104729) % 1000) * 5e-5 as wlat
  from (select *, cast(json_extract_string(props, '$.k') as int) as kind from events)
),
shifted as (
  select *, wlng - 105e0 as x, wlat - 35e0 as y, radians(wlat) as phi from raw
  where wlng between 72004e-3 and 1378347e-4 and wlat between 8293e-4 and 558281e-4
),
metres as (
  select *,
    300e0 + x + 2 * y + 1e-1 * x * x + 1e-1 * x * y + 1e-1 * sqrt(abs(x))
      + (20e0 * sin(6 * pi() * x) + 20e0 * sin(2 * pi() * x) + 20e0 * sin(pi() * x)
         + 40e0 * sin(pi() * x / 3) + 150e0 * sin(pi() * x / 12) + 300e0 * sin(pi() * x / 30)) * 2 / 3 as east,
    -100e0 + 2 * x + 3 * y + 2e-1 * y * y + 1e-1 * x * y + 2e-1 * sqrt(abs(x))
      + (20e0 * sin(6 * pi() * x) + 20e0 * sin(2 * pi() * x) + 20e0 * sin(pi() * y)
         + 40e0 * sin(pi() * y / 3) + 160e0 * sin(pi() * y / 12) + 320e0 * sin(pi() * y / 30)) * 2 / 3 as north,
    1 - 669342162296594323e-20 * sin(phi) * sin(phi) as bend
  from shifted
),
converted as (
  select obd_id, event_id, ts,
    round(wlng + degrees(east / (6378245e0 / sqrt(bend) * cos(phi))), 6) as lng,
    round(wlat + degrees(north / (6378245e0 * (1 - 669342162296594323e-20) / (bend * sqrt(bend)))), 6) as lat
  from metres
),
kept as (
  select * from converted
  where lng > 1195e-1 and lng < 1235e-1 and lat > 305e-1 and lat < 325e-1
)"""


def _base(gap: int) -> str:
    return f"""with recursive {_GCJ},
breaks as (
  select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by obd_id order by ts, event_id)
    > {gap}000000 then 1 else 0 end as opens
  from kept
),
numbered as (
  select *, cast(sum(opens) over (partition by obd_id order by ts, event_id rows unbounded preceding) as int) as r
  from breaks
),
pts as materialized (
  select obd_id, r, obd_id || ' r' || r as trip_id,
    cast(max(ts) over (partition by obd_id, r) as date) as day,
    row_number() over (partition by obd_id, r order by ts, event_id) - 1 as seq, event_id, ts, lng, lat
  from numbered
)"""


def _haversine(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    return (
        f"(2 * 6371000e0 * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) "
        f"* cos(radians({lat2})) * pow(sin((radians({lng2}) - radians({lng1})) / 2), 2))))"
    )


def _apart(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    return f"sqrt(pow({lng1} - {lng2}, 2) + pow({lat1} - {lat2}, 2))"


_FEATURES = f""",
chunked as (
  select *, seq // 75 as chunk, count(*) over (partition by trip_id, seq // 75) as chunk_n,
    lead(lng) over c as lng2, lead(lat) over c as lat2
  from pts window c as (partition by trip_id, seq // 75 order by seq)
),
headed as (
  select *,
    case when lng2 is null then 0e0 else (degrees(atan2(lng2 - lng, lat2 - lat)) + 360) % 360 end as heading,
    case when lng2 is null then 0e0 else {_haversine('lng', 'lat', 'lng2', 'lat2')} end as hop_next
  from chunked
),
turned as (
  select *, coalesce(lag(hop_next) over c, 0e0) as hop_prev,
    case when lng2 is null or lag(heading) over c is null then 0e0 else heading - lag(heading) over c end as nhc
  from headed window c as (partition by trip_id, chunk order by seq)
),
featured as (
  select *, sum(nhc) over (partition by trip_id, chunk order by seq rows between 3 preceding and 3 following) as ahc,
    hop_prev + hop_next as nd, (seq % 75) // 6 as segment
  from turned
),
segments as (
  select trip_id, chunk, segment, any_value(chunk_n) as chunk_n,
    (sum(hop_prev) - arg_min(hop_prev, seq)) * (arg_min(nhc, seq) + sum(abs(nhc))) / count(*) as seg_raw
  from featured group by all
),
weighed as (
  select *, case when sum(seg_raw) over w <> 0 then seg_raw / sum(seg_raw) over w else seg_raw end as seg_w
  from segments window w as (partition by trip_id, chunk)
),
budgeted as (
  select *, cast(floor(seg_w * (case when chunk_n <= 25 then chunk_n // 8 else chunk_n // 25 end)) as bigint) as headcount
  from weighed
),
ranked as (
  select f.*, b.headcount, row_number() over (partition by f.trip_id, f.chunk, f.segment
    order by nd * (abs(nhc) + abs(ahc)) desc, seq) as place
  from featured f join budgeted b using (trip_id, chunk, segment)
),
firsts as (
  select trip_id, chunk, arg_min(lng, seq) as flng, arg_min(lat, seq) as flat
  from ranked where place <= headcount group by all
),
simplified as (
  select k.obd_id, k.r, k.trip_id, k.day, k.seq, k.ts, k.lng, k.lat
  from ranked k left join firsts f using (trip_id, chunk)
  where chunk_n < 5 or (chunk = 0 and chunk_n <= 5) or place <= headcount
    or (seq % 75 = 0 and (f.flng is null or f.flng <> k.lng or f.flat <> k.lat))
)"""


def _values(query, name: str = "q") -> str:
    rows = ", ".join(f"({i}, {_e(x)}, {_e(y)})" for i, (x, y) in enumerate(query))
    return f"{name}(qseq, qlng, qlat) as (values {rows})"


def query_rows(batch) -> str:
    rows = []
    for qid, points, day, k in batch:
        for i, (x, y) in enumerate(points):
            d = "cast(null as date)" if day is None else f"date '{day}'"
            rows.append(f"({qid}, {i}, {_e(x)}, {_e(y)}, {d}, {k})")
    return "queries(qid, qseq, qlng, qlat, day, k) as (values " + ", ".join(rows) + ")"


_D = _apart("p.lng", "p.lat", "q.qlng", "q.qlat")

# Exact answers of a query batch.
_BATCH = f""",
per_point as (
  select q.qid, q.qseq, q.k, p.trip_id, min({_D}) as d
  from queries q join pts p on q.day is null or q.day = p.day group by all
),
scores as (
  select qid, k, trip_id, round(sum(exp(-d)), 9) as sim from per_point group by all
),
answers as (
  select *, row_number() over (partition by qid order by sim desc, trip_id) as rank from scores
)"""

# The lam nearest points of each query point, and what follows from them.
_NEAREST = f""",
close as (
  select q.*, p.trip_id, p.seq, p.lng, p.lat, round({_D}, 12) as d,
    row_number() over (partition by qid, qseq order by round({_D}, 12), p.trip_id, p.seq) as nn
  from asked q join pts p on q.day is null or q.day = p.day
  qualify nn <= lam
),
scanned as (select qid, qseq, trip_id, min(d) as d from close group by all),
radii as (select qid, qseq, max(d) as r, count(*) as returned from close group by all)"""


def _chain(name: str, steps: str) -> str:
    """``{name}``(qid, trip_id, best): best sum over non-decreasing choices of a step (by ``pos``) per query point."""
    over = "(partition by qid, trip_id order by pos rows unbounded preceding)"
    return f"""
{name}_chain as (
  select qid, trip_id, pos, qseq, max(gain) over {over} as best from {steps} where qseq = 0
  union all
  select qid, trip_id, pos, qseq, max(total) over {over}
  from (select s.qid, s.trip_id, s.pos, s.qseq, s.gain + c.best as total
        from {name}_chain c join {steps} s on s.qid = c.qid and s.trip_id = c.trip_id and s.pos = c.pos and s.qseq = c.qseq + 1)
),
{name} as (
  select c.qid, c.trip_id, max(best) as best from {name}_chain c
  join (select qid, max(qseq) as last from queries group by qid) z on z.qid = c.qid and z.last = c.qseq group by all
)"""


def _line(px, py, ax, ay, bx, by) -> str:
    return (
        f"case when {ax} = {bx} and {ay} = {by} then {_apart(px, py, ax, ay)} else "
        f"abs(({bx} - {ax}) * ({ay} - {py}) - ({ax} - {px}) * ({by} - {ay})) / {_apart(ax, ay, bx, by)} end"
    )


def _outline(source: str, epsilon: str) -> str:
    away = _line("p.lng", "p.lat", "a.lng", "a.lat", "b.lng", "b.lat")
    return f""",
pieces as (
  select trip_id, min(seq) as s, max(seq) as e from {source} group by trip_id
  union all
  select f.trip_id, case when half = 0 then f.s else f.far['at'] end, case when half = 0 then f.far['at'] else f.e end
  from (
    select i.trip_id, i.s, i.e, max({{'top': {away}, 'back': -p.seq, 'at': p.seq}}) as far
    from pieces i
    join {source} p on p.trip_id = i.trip_id and p.seq > i.s and p.seq < i.e
    join {source} a on a.trip_id = i.trip_id and a.seq = i.s
    join {source} b on b.trip_id = i.trip_id and b.seq = i.e
    group by i.trip_id, i.s, i.e
  ) f, (values (0), (1)) halves(half)
  where f.far['top'] > {epsilon}
),
outlined as (select trip_id, s as seq from pieces union select trip_id, e from pieces)"""


def _gain(i: int) -> str:
    x, y = THREE_POINTS[i]
    return f"exp(-{_apart('lng', 'lat', _e(x), _e(y))})"


_GAINS = f""",
gains as (
  select trip_id, seq, count(*) over (partition by trip_id) as n,
    {_gain(0)} as e1, {_gain(1)} as e2, {_gain(2)} as e3 from pts
)"""

_RUN = "over (partition by trip_id order by seq rows unbounded preceding)"
_PRIOR = "over (partition by trip_id order by seq rows between unbounded preceding and 1 preceding)"


def _lcss_match(i: int) -> str:
    x, y = THREE_POINTS[i]
    return f"(abs(p.lng - {_e(x)}) <= 1e-1 and abs(p.lat - {_e(y)}) <= 1e-1)"


_LCSS = f""",
walk as (
  select trip_id, cast(-1 as bigint) as seq, 0 as a, 0 as b, 0 as c from pts where seq = 0
  union all
  select trip_id, seq, a2, b2, case when m3 then b + 1 else greatest(c, b2) end
  from (
    select *, case when m2 then a + 1 else greatest(b, a2) end as b2
    from (
      select w.trip_id, p.seq, w.a, w.b, w.c, case when {_lcss_match(0)} then 1 else w.a end as a2,
        {_lcss_match(1)} as m2, {_lcss_match(2)} as m3
      from walk w join pts p on p.trip_id = w.trip_id and p.seq = w.seq + 1
    )
  )
),
lcss as (
  select trip_id, n, case when n = 1 then 0e0 else 1 - c / least(n, 3) end as value
  from walk join (select trip_id, count(*) as n from pts group by all) using (trip_id) where seq = n - 1
)"""


def _foot(a: str, b: str, p: str, axis: str) -> str:
    span = f"(pow({b}x - {a}x, 2) + pow({b}y - {a}y, 2))"
    dot = f"(({b}x - {a}x) * ({p}x - {a}x) + ({b}y - {a}y) * ({p}y - {a}y))"
    return f"case when {span} = 0 then {a}{axis} else {a}{axis} + {dot} / {span} * ({b}{axis} - {a}{axis}) end"


def _seg(a: str, b: str) -> str:
    return _apart(f"{a}x", f"{a}y", f"{b}x", f"{b}y")


# The longest trip as the query; the tables of the measures row by row and column by column.
_BY_TRIP = """,
q as (
  select seq as qseq, lng as qlng, lat as qlat from pts
  where trip_id = (select trip_id from pts group by trip_id order by count(*) desc, trip_id limit 1)
),
len_of as (select trip_id, count(*) as n from pts group by trip_id)"""

_LCSS_BY_TRIP = f"""{_BY_TRIP},
rows_of as (
  select p.trip_id, cast(-1 as bigint) as i, q.qseq as j, 0 as v from (select distinct trip_id from pts) p, q
  union all
  select trip_id, i, j, max(cell) over (partition by trip_id order by j rows unbounded preceding)
  from (
    select w.trip_id, w.i + 1 as i, w.j, greatest(w.v, lag(w.v, 1, 0) over (partition by w.trip_id order by w.j)
      + (abs(p.lng - q.qlng) <= 1e-1 and abs(p.lat - q.qlat) <= 1e-1)::int) as cell
    from rows_of w join pts p on p.trip_id = w.trip_id and p.seq = w.i + 1 join q on q.qseq = w.j
  )
)
select trip_id, round(case when n = 1 then 0e0 else 1 - max(v) / least(n, (select count(*) from q)) end, 9) as value
from rows_of join len_of using (trip_id) where i = n - 1 group by trip_id, n order by 2, 1 limit 20"""

_ORDERED_BY_TRIP = f"""{_BY_TRIP},
columns_of as (
  select trip_id, seq, cast(-1 as bigint) as j, 0e0 as best from pts
  union all
  select trip_id, seq, j, max(total) over (partition by trip_id order by seq rows unbounded preceding)
  from (
    select c.trip_id, c.seq, c.j + 1 as j, c.best + exp(-{_apart('p.lng', 'p.lat', 'q.qlng', 'q.qlat')}) as total
    from columns_of c join q on q.qseq = c.j + 1 join pts p on p.trip_id = c.trip_id and p.seq = c.seq
  )
)
select trip_id, round(max(best), 9) as value from columns_of
where j = (select max(qseq) from q) group by trip_id order by 2 desc, 1 limit 20"""

# r = head of the trip, v = its next point; s = head of the query, t = its next point.
_EDWP = f""",
len as (select trip_id, count(*) as n from pts group by all),
edwp as (
  select trip_id, cast(1 as bigint) as i, 1 as j, lng as rx, lat as ry,
    (select qlng from q where qseq = 0) as sx, (select qlat from q where qseq = 0) as sy, 0e0 as cost, false as done
  from pts where seq = 0
  union all
  select trip_id,
    case when last then i when by_r and new_r then i else i + 1 end,
    case when last then j when by_r or not new_s then j + 1 else j end,
    case when by_r and new_r then ax else vx end, case when by_r and new_r then ay else vy end,
    case when not by_r and new_s then zx else tx end, case when not by_r and new_s then zy else ty end,
    cost + case when vx is null and tx is null then 0 when tx is null then ({_seg('r', 's')} + {_seg('v', 's')}) * {_seg('r', 'v')}
      when vx is null then ({_seg('s', 'r')} + {_seg('t', 'r')}) * {_seg('s', 't')}
      when by_r then cost_r else cost_s end,
    last
  from (
    select *, vx is null or tx is null as last, cost_r < cost_s as by_r,
      not (ax = rx and ay = ry) and not (ax = vx and ay = vy) as new_r,
      not (zx = sx and zy = sy) and not (zx = tx and zy = ty) as new_s
    from (
      select *, ({_seg('r', 's')} + {_seg('a', 't')}) * ({_seg('r', 'a')} + {_seg('s', 't')}) as cost_r,
        ({_seg('r', 's')} + {_seg('z', 'v')}) * ({_seg('s', 'z')} + {_seg('r', 'v')}) as cost_s
      from (
        select *, {_foot('r', 'v', 't', 'x')} as ax, {_foot('r', 'v', 't', 'y')} as ay,
          {_foot('s', 't', 'v', 'x')} as zx, {_foot('s', 't', 'v', 'y')} as zy
        from (
          select w.*, p.lng as vx, p.lat as vy, q.qlng as tx, q.qlat as ty
          from edwp w left join pts p on p.trip_id = w.trip_id and p.seq = w.i
          left join q on q.qseq = w.j where not w.done
        )
      )
    )
  )
),
edited as (select trip_id, cost as value from edwp where done)"""


def _intended(features: str) -> str:
    """The simplification with n / 15 points of chunks of 26 to 44, and heading changes within half a turn."""
    change, turned = "heading - lag(heading) over c", "(heading - lag(heading) over c + 180e0) % 360e0"
    wrapped = f"(case when {turned} < 0 then ({turned} + 360e0) % 360e0 else {turned} end) - 180e0"
    rate = "when chunk_n <= 25 then chunk_n // 8"
    assert f"else {change} end" in features and rate in features
    return features.replace(f"else {change} end", f"else {wrapped} end").replace(rate, f"{rate} when chunk_n < 45 then chunk_n // 15")


def oracle_sql(batch, split_batch) -> dict[str, str]:
    """SQL by query name; ``batch`` and ``split_batch`` are the literal query batches."""
    day, two_day = _base(DAY_GAP), _base(TWO_DAY_GAP)
    q = _values(THREE_POINTS)
    rows, split_rows = query_rows(batch), query_rows(split_batch)
    single = f"""{day}, {q},
      scores as (
        select trip_id, round(sum(exp(-d)), 9) as sim
        from (select q.qseq, p.trip_id, min({_D}) as d from q cross join pts p group by all) group by trip_id
      )"""
    asked = f"{day}, {rows}, asked as (select *, 20 as lam from queries){_NEAREST}"
    bounds = f"""{asked},
      bounds as (
        select c.qid, c.trip_id, count(s.d) as seen,
          coalesce(sum(exp(-s.d)), 0) as lb,
          coalesce(sum(exp(-s.d)), 0) + coalesce(sum(case when s.d is null then exp(-r.r) end), 0) as ub
        from (select distinct qid, trip_id from scanned) c
        join radii r on r.qid = c.qid
        left join scanned s on s.qid = c.qid and s.qseq = r.qseq and s.trip_id = c.trip_id
        group by c.qid, c.trip_id
      )"""
    edge_day = f"{day}, {_values(THREE_POINTS)}"
    sample = """,
      lengths as (select trip_id, any_value(day) as day, count(*) as n from pts group by trip_id),
      drawn as (
        select *, row_number() over (partition by n order by md5(trip_id), trip_id) as pick
        from lengths where n between 2 and 10 qualify pick <= 10
      )"""
    answers = f"{day}, {rows}{_BATCH}"
    longest_trip = "(select trip_id from pts group by trip_id order by count(*) desc, trip_id limit 1)"
    return {
        "gcj_clean": f"with {_GCJ} select obd_id, event_id, ts, lng, lat from kept",
        "country_filter": f"with {_GCJ} select obd_id, event_id, wlng as lng, wlat as lat from shifted",
        "trips": f"{day} select trip_id, r, seq, event_id, lng, lat from pts",
        "trips_short_gap": f"{_base(1500)} select trip_id, r, seq, event_id, day from pts",
        "trip_catalog": f"{day} select obd_id, r, trip_id, day, count(*) as n from pts group by all",
        "trip_day": f"{day} select day, count(distinct trip_id) as trips, count(*) as points from pts group by day",
        "known_users": f"""{day} select distinct u.obd_id from raw u where obd_id in (select obd_id from pts)""",
        "user_trips": f"""{day} select r, trip_id, day, count(*) as n from pts
            where obd_id = (select min(obd_id) from pts) group by all""",
        "trip_fetch": f"{day} select seq, lng, lat from pts where trip_id = {longest_trip}",
        "trip_polylines": f"""{day} select trip_id, count(*) as n, round(min(lng), 6) as first_lng from
            (select trip_id, first_value(lng) over (partition by trip_id order by seq) as lng from pts) group by trip_id""",
        "path_length": f"""{day} select trip_id, count(*) as n, round(coalesce(sum(hop), 0), 4) as length_m from (
            select trip_id, {_haversine('lng', 'lat', 'lead(lng) over w', 'lead(lat) over w')} as hop
            from pts window w as (partition by trip_id order by seq)) group by trip_id""",
        "headings": f"""{two_day}{_FEATURES} select trip_id, seq, chunk, round(heading, 6) + 0e0 as heading, round(nhc, 6) + 0e0 as nhc,
            round(ahc, 6) + 0e0 as ahc, round(abs(nhc) + abs(ahc), 6) as hc, round(nd, 4) as nd from featured""",
        "segment_weights": f"""{two_day}{_FEATURES} select trip_id, chunk, segment, round(seg_w, 9) as seg_w, headcount
            from budgeted""",
        "ts_simplify": f"{two_day}{_FEATURES} select trip_id, day, seq, lng, lat from simplified",
        "ts_simplify_intended": f"{two_day}{_intended(_FEATURES)} select trip_id, day, seq, lng, lat from simplified",
        "dp_simplify": f"{two_day}{_outline('pts', '1e-2')} select trip_id, seq, lng, lat from outlined join pts using (trip_id, seq)",
        "simplified_by_day": f"""{two_day}{_FEATURES} select 'shanghai' as city, day, count(*) as points,
            count(distinct trip_id) as trips from simplified group by day""",
        "ingest_two_cities": f"""{two_day}{_FEATURES} select city, day, count(*) as points,
            count(distinct trip_id) as trips from simplified, (values ('pudong'), ('shanghai')) c(city) group by city, day""",
        "ingest_two_months": f"""{two_day}{_FEATURES},
            kept_of as (select trip_id, count(*) as kept from simplified group by trip_id),
            whole as (select trip_id, obd_id, r, day, count(*) as points, max(seq) as last_seq from pts group by all)
            select trip_id, obd_id, r, day + {MONTH_SHIFT} as day, points, last_seq, kept from whole left join kept_of using (trip_id)""",
        "kbct_ingested": f"""{two_day}{_FEATURES}, {q},
            scores as (
              select trip_id, round(sum(exp(-d)), 9) as sim
              from (select q.qseq, p.trip_id, min({_D}) as d from q cross join simplified p group by all) group by trip_id
            )
            select trip_id, sim from scores order by sim desc, trip_id limit 5""",
        "point_index": f"""{day} select day, cast(floor(lng / 5e-3) as bigint) as cx, cast(floor(lat / 5e-3) as bigint) as cy,
            count(*) as n from pts group by all""",
        "kept_by_month": f"""with {_GCJ} select strftime(ts, '%Y-%m') as month, count(*) as points,
            count(distinct obd_id) as users from kept group by all""",
        "raw_csv_scan": f"""with {_GCJ} select obd_id, epoch(date_trunc('second', ts))::bigint as epoch, wlng as lng, wlat as lat
            from raw""",
        "raw_log_rejects": f"""with {_GCJ},
            judged as (
              select event_id, case event_id % 25 when 0 then 'user' when 5 then 'coordinates' when 10 then 'coordinates'
                when 15 then 'time' when 20 then 'time' end as reason from raw
            )
            select reason, count(*) as lines, min(event_id) as first_event, max(event_id) as last_event from judged group by reason""",
        "request_decode": f"""{day} select trip_id || '#' || (seq // 75) as req_id, seq % 75 as qseq, lng as qlng, lat as qlat
            from pts""",
        "trip_length_hist": f"""{day} select n, count(*) as trips from (select trip_id, count(*) as n from pts group by all) group by n""",
        "trip_similarity": f"{single} select trip_id, sim from scores",
        "kbct": f"{single} select trip_id, sim from scores order by sim desc, trip_id limit 5",
        "kbct_batch": f"{answers} select qid, rank, trip_id, sim from answers where rank <= k",
        "kbct_pruned": f"{answers} select qid, rank, trip_id, sim from answers where rank <= k",
        "kbct_lambda": f"{answers} select qid, rank, trip_id, sim from answers where rank <= k",
        "kbct_raw_points": f"""{day}{_FEATURES}, {q},
            scores as (
              select trip_id, round(sum(exp(-d)), 9) as sim
              from (select q.qseq, p.trip_id, min({_D}) as d from q cross join simplified p group by all) group by trip_id
            ),
            best as (select * from scores order by sim desc, trip_id limit 3)
            select trip_id, sim, seq, lng, lat from best join pts using (trip_id)""",
        "kbct_split": f"""{day}, {split_rows},
            per_point as (
              select q.qid, q.qseq % 2 as part, q.qseq, q.k, p.trip_id, min({_D}) as d
              from queries q cross join pts p group by all
            ),
            parts as (
              select * from (select qid, part, k, trip_id, round(sum(exp(-d)), 9) as sim from per_point group by all)
              qualify row_number() over (partition by qid, part order by sim desc, trip_id) <= k
            ),
            merged as (select qid, trip_id, round(sum(sim), 9) as sim from parts group by all)
            select qid, row_number() over (partition by qid order by sim desc, trip_id) as rank, trip_id, sim from merged""",
        "kbct_by_trip": f"""{day},
            chosen as (select * from pts where trip_id = {longest_trip}){_outline('chosen', '1e-4')},
            q as (select seq as qseq, lng as qlng, lat as qlat from chosen join outlined using (trip_id, seq)),
            scores as (
              select trip_id, round(sum(exp(-d)), 9) as sim
              from (select q.qseq, p.trip_id, min({_D}) as d from q cross join pts p group by all) group by trip_id
            )
            select trip_id, sim from scores order by sim desc, trip_id limit 3""",
        "knn_points": f"{asked} select qid, qseq, nn, trip_id, seq, round(d, 9) as d from close",
        "range_join": f"""{day}, {rows} select qid, qseq, trip_id, seq, round({_D}, 9) as d
            from queries q join pts p on (q.day is null or q.day = p.day) and {_D} <= 5e-2""",
        "knn_indexed": f"{asked} select qid, qseq, nn, trip_id, seq, round(d, 9) as d from close",
        "range_indexed": f"""{day}, {rows} select qid, qseq, trip_id, seq, round({_D}, 9) as d
            from queries q join pts p on (q.day is null or q.day = p.day) and {_D} <= 5e-2""",
        "candidates": f"{asked} select distinct qid, trip_id from scanned",
        "lower_bound": f"{bounds} select qid, trip_id, seen, round(lb, 9) as lb from bounds",
        "upper_bound": f"{bounds} select qid, trip_id, round(ub, 9) as ub from bounds",
        "kth_lower_bound": f"""{bounds} select qid, round(lb, 9) as kth_lb from (
            select *, row_number() over (partition by qid order by lb desc, trip_id) as rank from bounds)
            join (select distinct qid, k from queries) using (qid) where rank = k""",
        "ub_unscanned": f"{asked} select qid, round(sum(exp(-r)), 9) as ub_ns from radii group by qid",
        "lambda_budget": f"""{day}, {rows}, asked as (select *, k as lam from queries){_NEAREST},
            rates as (
              select qid, qseq, k, lam, count(*) over (partition by qid) as m,
                r / (2 * lam) * exp(-r) as decay, returned / lam as ratio
              from radii join asked using (qid, qseq)
            )
            select qid, qseq, k, lam as prev, cast(floor(lam + m * k * 2 * (5e-1 * decay / sum(decay) over (partition by qid)
              + 5e-1 * ratio / sum(ratio) over (partition by qid))) as int) as lam from rates""",
        "sim_ordered": f"""{day}{_GAINS},
            one as (select *, max(e1) {_RUN} as m1 from gains),
            two as (select *, max(e2 + m1) {_RUN} as m2 from one)
            select trip_id, round(max(e3 + m2), 9) as value from two group by trip_id""",
        "ordered_topk": f"""{day}{_GAINS},
            one as (select *, max(e1) {_RUN} as m1 from gains),
            two as (select *, max(e2 + m1) {_RUN} as m2 from one)
            select trip_id, round(max(e3 + m2), 9) as value from two group by trip_id order by 2 desc, 1 limit 20""",
        "sim_ordered_rec": f"""{day}{_GAINS},
            sums as (select *, sum(e1) {_RUN} as s1, sum(e2) {_RUN} as s2, sum(e3) {_RUN} as s3 from gains),
            first_turn as (select *, greatest(0, max(s1 - s2) {_RUN}) as t1 from sums),
            second_turn as (select *, greatest(0, max(t1 + s2 - s3) {_RUN}) as t2 from first_turn)
            select trip_id, round(t2 + s3, 9) as value from second_turn where seq = n - 1""",
        "sim_ordered_dp": f"""{day}{_GAINS},
            sums as (select *, coalesce(sum(e2) filter (where seq > 0) {_RUN}, 0) as s2,
              coalesce(sum(e3) filter (where seq > 0) {_RUN}, 0) as s3 from gains),
            turn as (select *, max(s2 - s3) {_RUN} as t from sums)
            select trip_id, round((t + s3) / n, 9) as value from turn where seq = n - 1""",
        "sim_ordered_par": f"""{day}{_GAINS},
            sums as (select *, sum(e1) {_RUN} as s1, sum(e2) {_RUN} as s2, sum(e3) {_RUN} as s3 from gains),
            first_turn as (select *, max(s1 - (s2 - e2)) {_RUN} as t1 from sums),
            second_turn as (select *, max(t1 + s2 - (s3 - e3)) {_RUN} as t2 from first_turn)
            select trip_id, round(t2 + s3, 9) as value from second_turn where seq = n - 1""",
        "ordered_bounds": f"""{asked},
            reached as (
              select c.qid, c.trip_id, c.seq, c.lng, c.lat from close c group by all
            ),
            steps as (
              select f.qid, f.trip_id, f.seq, q.qseq, exp(-{_apart('f.lng', 'f.lat', 'q.qlng', 'q.qlat')}) as gain
              from reached f join queries q using (qid)
            ),
            chain as (
              select qid, trip_id, seq, qseq, max(gain) over w as best from steps where qseq = 0
              window w as (partition by qid, trip_id order by seq rows unbounded preceding)
              union all
              select qid, trip_id, seq, qseq, max(total) over (partition by qid, trip_id order by seq rows unbounded preceding)
              from (select s.qid, s.trip_id, s.seq, s.qseq, s.gain + c.best as total
                    from chain c join steps s on s.qid = c.qid and s.trip_id = c.trip_id and s.seq = c.seq and s.qseq = c.qseq + 1)
            ),
            lows as (
              select c.qid, c.trip_id, max(best) as lb from chain c
              join (select qid, max(qseq) as last from queries group by qid) z on z.qid = c.qid and z.last = c.qseq group by all
            )
            select l.qid, l.trip_id, round(l.lb, 9) as lb,
              round(l.lb + coalesce(sum(case when s.d is null then exp(-r.r) end), 0), 9) as ub
            from lows l join radii r on r.qid = l.qid
            left join scanned s on s.qid = l.qid and s.qseq = r.qseq and s.trip_id = l.trip_id
            group by l.qid, l.trip_id, l.lb""",
        "ordered_enclosed": f"""{asked},
            reached as (select c.qid, c.trip_id, c.seq, c.lng, c.lat from close c group by all),
            known as (
              select f.qid, f.trip_id, 2 * f.seq + 1 as pos, q.qseq, exp(-{_apart('f.lng', 'f.lat', 'q.qlng', 'q.qlat')}) as gain
              from reached f join queries q using (qid)
            ),
            places as (
              select qid, trip_id, 2 * seq as pos from (
                select *, lag(seq, 1, -1) over (partition by qid, trip_id order by seq) as before from reached)
              where seq > before + 1
              union all select qid, trip_id, 2 * max(seq) + 2 from reached group by all
            ),
            thought as (
              select * from known
              union all select p.qid, p.trip_id, p.pos, r.qseq, exp(-r.r) from places p join radii r on r.qid = p.qid
            ),{_chain('lows', 'known')},{_chain('highs', 'thought')}
            select l.qid, l.trip_id, round(l.best, 9) as lb, round(h.best, 9) as ub from lows l join highs h using (qid, trip_id)""",
        "ordered_batch": f"""{day}, {rows},
            steps as (
              select q.qid, p.trip_id, p.seq as pos, q.qseq, exp(-{_D}) as gain from queries q join pts p on q.day is null or q.day = p.day
            ),{_chain('scored', 'steps')},
            best as (select qid, trip_id, round(best, 9) as value from scored)
            select qid, rank, trip_id, value
            from (select *, row_number() over (partition by qid order by value desc, trip_id) as rank from best)
            join (select distinct qid, k from queries) using (qid) where rank <= k""",
        "lcss": f"{day}{_LCSS} select trip_id, round(value, 9) as value from lcss",
        "lcss_topk": f"""{day}{_LCSS} select trip_id, round(value, 9) as value from lcss order by 2, 1 limit 20""",
        "edwp": f"{edge_day}{_EDWP} select trip_id, round(value, 9) as value from edited",
        "edwp_topk": f"{edge_day}{_EDWP} select trip_id, round(value, 9) as value from edited order by 2, 1 limit 20",
        "ordered_by_trip": f"{day}{_ORDERED_BY_TRIP}",
        "lcss_by_trip": f"{day}{_LCSS_BY_TRIP}",
        "edwp_by_trip": f"{day}{_BY_TRIP}{_EDWP} select trip_id, round(value, 9) as value from edited order by 2, 1 limit 20",
        "query_sample": f"{day}{sample} select trip_id, day, n, pick from drawn",
        "kbct_accuracy": f"""{day}{sample},
            queries as (
              select n * 10 + pick - 1 as qid, p.seq as qseq, p.lng as qlng, p.lat as qlat, p.day, 8 as k
              from drawn join pts p using (trip_id)
            ){_BATCH},
            sizes as (select qid, count(*) as m from queries group by qid),
            means as (
              select qid, w.k, avg(sim) as mean_sim from answers a, (values (3), (4), (5), (6), (7), (8)) w(k)
              where rank <= w.k group by all
            )
            select m, k, count(*) as queries, round(avg(mean_sim / m), 6) as accuracy, round(avg(mean_sim), 6) as mean_sim
            from means join sizes using (qid) group by all""",
        "answer_requests": f"""{day}{sample},
            queries as (
              select trip_id as qid, p.seq as qseq, p.lng as qlng, p.lat as qlat, case when n % 2 = 1 then p.day end as day, 3 as k
              from drawn join pts p using (trip_id) where n between 3 and 5 and pick <= 2
            ){_BATCH},
            lines as (select trip_id, count(*) as n, round(arg_min(lng, seq), 6) as first_lng from pts group by trip_id)
            select qid as req_id, rank, trip_id, sim, n, first_lng from answers join lines using (trip_id) where rank <= k""",
        "stream_trip_summary": f"""{_base(1500)},
            spans as (select obd_id, r, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from pts group by all)
            select obd_id, first_ts, last_ts, n from spans""",
        "stream_numbering": f"""with {_GCJ},
            sent as (select *, case when event_id % {DELAYED} = 0 then 3 else least((day(ts) - 1) // 8, 3) end as part from kept),
            told as (select *, coalesce(part = 3 and ts < max(ts) filter (part < 3) over (partition by obd_id), false) as late from sent),
            breaks as (
              select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by obd_id order by ts, event_id) > {DAY_GAP}000000
                then 1 else 0 end as opens from told where not late
            ),
            numbered as (
              select *, cast(sum(opens) over (partition by obd_id order by ts, event_id rows unbounded preceding) as int) as r from breaks
            )
            select obd_id, event_id, r, row_number() over (partition by obd_id, r order by ts, event_id) - 1 as seq, late from numbered
            union all select obd_id, event_id, null, null, late from told where late""",
        "stream_index": f"""{day} select day, cast(floor(lng / 5e-3) as bigint) as cx, cast(floor(lat / 5e-3) as bigint) as cy,
            count(*) as n from pts group by all""",
    }
