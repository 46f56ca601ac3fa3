"""The registered queries in SQL, over the same tables.

Written from the definitions rather than from the jobs: whole partitions instead of pieces, self
joins instead of sweeps. Building blocks are common table expressions; each query names the ones
it needs.
"""

from __future__ import annotations

# One report per (type, supplier, tick): a supplier drives, a tick is 20 s.
_REPORTS = """
select type, tick * 20 as simulated_time, vid, speed, xway, lane, dir, seg,
  case when stopped = 1 then seg * 5280 + 1000 + cast(floor(vid / 25) as int) * 10
       else seg * 5280 + (tick * 37 + vid * 101) % 5280 end as pos
from (
  select *,
    case when stopped = 1 then cast(floor(tick / 40) as int) % 10
         when vid % 4 < 3 then cast(floor(tick / 20) as int) % 10
         else cast(vid + floor((tick + vid) / 36) as int) % 10 end as seg,
    case when stopped = 1 then 1 else (vid + tick) % 5 end as lane
  from (
    select *,
      case when vid % 25 in (0, 1) and tick % 40 between 5 and 14 or vid % 25 = 2 and tick % 40 between 7 and 16
             or vid % 25 in (5, 6) and tick % 40 between 25 and 30 or vid % 25 in (7, 8) and tick >= 350
           then 1 else 0 end as stopped,
      cast(floor(vid / 100) as int) as xway, cast(floor(vid / 25) as int) % 2 as dir
    from (
      select case when l_linenumber = 7 then 2 else 0 end as type,
        cast(l_suppkey as int) as vid, cast(l_orderkey % 360 as int) as tick,
        cast(max(l_quantity) as int) + (cast(floor((l_orderkey % 360) / 20) as int) % 3) * 15
          as speed
      from lineitem group by 1, 2, 3, l_orderkey % 360) a) b) c
"""

_MINUTE = "cast(floor(simulated_time / 60) as int) + 1"


def _run_blocks(seg: str, trace: str, prefix: str = "") -> dict[str, tuple[list[str], str]]:
    """Runs of equal position, and the stops among them."""
    return {
        f"{prefix}run_rows": (["pos"], f"""
            select *, sum(brk) over (partition by {trace} order by simulated_time) as run
            from (select *, case when lag(pos) over w = pos and lag(seg) over w = seg
                                  and lag(xway) over w = xway then 0 else 1 end as brk,
                         lead(simulated_time) over w as t_next
                  from pos window w as (partition by {trace} order by simulated_time)) r"""),
        f"{prefix}numbered": ([f"{prefix}run_rows"], f"""
            select *, row_number() over (partition by {trace}, run order by simulated_time) as rn
            from {prefix}run_rows"""),
        f"{prefix}stops": ([f"{prefix}numbered"], f"""
            select vid, {seg}, pos,
              max(case when rn = 5 then lane end) as lane,
              max(case when rn = 5 then simulated_time end) as t0,
              arg_max(coalesce(t_next, -1), simulated_time) as t_after,
              max(simulated_time) as t_last, count(*) as n
            from {prefix}numbered
            group by {', '.join(dict.fromkeys(['vid', *seg.split(', '), 'pos', *trace.split(', ')]))}, run
            having count(*) >= 5"""),
    }


def _accident_blocks(seg: str, prefix: str = "") -> dict[str, tuple[list[str], str]]:
    """Accidents as the merged pairwise overlaps of stops; segment accidents; upstream scope.
    Open ends are 2147483647 until the last step."""
    up = "unnest([0, 1, 2, 3, 4])"
    if "dir" in seg:
        moved, keep = "case when dir = 1 then seg + i else seg - i end", "xway, dir"
    else:
        moved, keep = "seg - i", "xway"

    def merged(source: str, by: str) -> str:
        return f"""
            select {by}, min(t0) as t0, max(t1) as t1
            from (select *, sum(fresh) over (partition by {by} order by t0, t1) as grp
                  from (select *, case when t0 <= max(t1) over (partition by {by} order by t0, t1
                                        rows between unbounded preceding and 1 preceding)
                                   then 0 else 1 end as fresh
                        from {source}) f) g
            group by {by}, grp"""

    on = " and ".join(f"a.{c} = b.{c}" for c in (*seg.split(", "), "lane", "pos"))
    cols = ", ".join(f"a.{c}" for c in (*seg.split(", "), "lane", "pos"))
    place = f"{seg}, lane, pos"
    return {
        f"{prefix}closed_stops": ([f"{prefix}stops"], f"""
            select vid, {place}, t0, case when t_after < 0 then 2147483647 else t_after end as t1
            from {prefix}stops"""),
        f"{prefix}shared": ([f"{prefix}closed_stops"], f"""
            select {cols}, greatest(a.t0, b.t0) as t0, least(a.t1, b.t1) as t1
            from {prefix}closed_stops a join {prefix}closed_stops b
              on {on} and (a.vid < b.vid or (a.vid = b.vid and a.t0 < b.t0))
             and a.t0 < b.t1 and b.t0 < a.t1"""),
        f"{prefix}acc_pos": ([f"{prefix}shared"], merged(f"{prefix}shared", place)),
        f"{prefix}acc_seg": ([f"{prefix}acc_pos"], merged(f"{prefix}acc_pos", seg)),
        f"{prefix}scope": ([f"{prefix}acc_seg"], f"""
            select {seg}, t0, t1 from (
              select {keep}, {moved} as seg, t0, t1
              from (select *, {up} as i from {prefix}acc_seg) u) m where seg >= 0"""),
    }


def _stats_blocks(seg: str, prefix: str = "") -> dict[str, tuple[list[str], str]]:
    return {
        f"{prefix}vm": (["pos"], f"""
            select {seg}, {_MINUTE} as minute, vid, count(*) as n,
              arg_min(speed, simulated_time)
                + (sum(speed) - count(*) * arg_min(speed, simulated_time)) / 2.0 as v
            from pos group by {seg}, {_MINUTE}, vid"""),
        f"{prefix}sm": ([f"{prefix}vm"], f"""
            select {seg}, minute, avg(v) as a, count(*) as n
            from {prefix}vm group by {seg}, minute"""),
        f"{prefix}stats": ([f"{prefix}sm"], f"""
            select {seg}, minute,
              round(coalesce(avg(a) over (partition by {seg} order by minute
                range between 4 preceding and 1 preceding), 0), 9) as lav,
              cast(coalesce(sum(n) over (partition by {seg} order by minute
                range between 1 preceding and 1 preceding), 0) as bigint) as nov
            from {prefix}sm"""),
        f"{prefix}toll": ([f"{prefix}stats"], f"""
            select {seg}, minute, cast(trunc(lav) as int) as lav, nov,
              cast(case when lav >= 40 or nov <= 50 then 0
                   else 2 * (nov - 50) * (nov - 50) end as bigint) as toll
            from {prefix}stats"""),
    }


def _entry_block(seg: str) -> str:
    return f"""
        select vid, simulated_time, speed, xway, lane, dir, seg, pos, {_MINUTE} as minute
        from pos qualify row_number() over (partition by {seg}, vid order by simulated_time) = 1"""


def _enriched_block(entries: str, toll: str, scope: str, seg: str) -> str:
    same = " and ".join(f"s.{c} = e.{c}" for c in seg.split(", "))
    return f"""
        select e.*, coalesce(t.lav, 0) as lav, coalesce(t.nov, 0) as nov,
          coalesce(t.toll, 0) as toll,
          exists (select 1 from {scope} s where {same}
                  and s.t0 < e.simulated_time and e.simulated_time < s.t1) as in_accident
        from {entries} e left join {toll} t using ({seg}, minute)"""


_SEG = "xway, seg"
_DSEG = "xway, dir, seg"

# name -> (blocks it reads, text)
BLOCKS: dict[str, tuple[list[str], str]] = {
    "reports": ([], _REPORTS),
    "pos": (["reports"], "select * from reports where type = 0"),
    **_stats_blocks(_SEG),
    **_stats_blocks(_DSEG, "d_"),
    **_run_blocks(_SEG, "vid"),
    **_run_blocks(_SEG, "xway, seg, vid", "s_"),
    **_run_blocks(_DSEG, "vid", "d_"),
    **_accident_blocks(_SEG),
    **_accident_blocks(_SEG, "s_"),
    **_accident_blocks(_DSEG, "d_"),
    "entries": (["pos"], _entry_block(_SEG)),
    "d_entries": (["pos"], _entry_block(_DSEG)),
    "crossings": (["pos"], f"""
        select vid, simulated_time, speed, xway, lane, dir, seg, pos, {_MINUTE} as minute
        from (select *, lag(seg) over w as pseg, lag(xway) over w as pxway from pos
              window w as (partition by vid order by simulated_time)) l
        where pseg is null or pseg <> seg or pxway <> xway"""),
    "enriched": (["entries", "toll", "scope"], _enriched_block("entries", "toll", "scope", _SEG)),
    "x_enriched": (["crossings", "toll", "scope"],
                   _enriched_block("crossings", "toll", "scope", _SEG)),
    "d_enriched": (["d_entries", "d_toll", "d_scope"],
                   _enriched_block("d_entries", "d_toll", "d_scope", _DSEG)),
    "signals": (["scope"], """
        select xway, seg, t0 as t, true as is_new from scope
        union select xway, seg, t1, false from scope where t1 < 2147483647"""),
    "acc_vehicles": (["acc_pos", "closed_stops"], """
        select a.xway, a.seg, a.lane, a.pos, a.t0, a.t1, s.vid, s.t0 as stop_t0, s.t1 as stop_t1
        from acc_pos a join closed_stops s
          on a.xway = s.xway and a.seg = s.seg and a.lane = s.lane and a.pos = s.pos
         and s.t0 < a.t1 and a.t0 < s.t1"""),
}


def sql(body: str, *blocks: str) -> str:
    """`body` with the blocks it reads, and those these read, in front."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for other in BLOCKS[name][0]:
                need(other)
            order.append(name)

    for b in blocks:
        need(b)
    return "with " + ",\n".join(f"{n} as ({BLOCKS[n][1]})" for n in order) + f"\n{body}"


def end(column: str = "t1") -> str:
    """An open end as null."""
    return f"cast(nullif({column}, 2147483647) as int) as {column}"


REPORT_COLS = "type, simulated_time, vid, speed, xway, lane, dir, seg, pos"


def notice_sql(enriched: str = "enriched") -> str:
    return f"""
        select 0 as kind, vid, simulated_time as t, lav,
          case when in_accident then 0 else toll end as toll,
          cast(null as int) as seg, cast(null as int) as pos from {enriched}
        union all
        select 1, vid, simulated_time, null, null, seg, pos
        from {enriched} where in_accident and lane <> 4"""


def queries_sql() -> dict[str, str]:
    first_half = "simulated_time < 3600"
    out = {
        # Sources and formats
        "read_raw": sql("""
            select type, simulated_time as time, vid, speed, xway, lane, dir, seg, pos, 0 as qid,
              0 as sinit, 0 as send, 0 as dow, 0 as tod, 0 as day from reports""", "reports"),
        "parse_wire": sql(f"""
            select {REPORT_COLS},
              cast(1700000000000 + cast(simulated_time as bigint) * 1000 as bigint) as wall_ms
            from pos""", "pos"),
        "quarantine": sql("""
            select concat_ws(',', type, 1700000000000 + cast(simulated_time as bigint) * 1000, vid,
              'x' || speed, xway, lane, dir, seg, pos, simulated_time, 0, 0, 0, 0, 0, 0) as value
            from reports where type = 2""", "reports"),
        "to_wire": sql("""
            select concat_ws(',', type, 1700000000000 + cast(simulated_time as bigint) * 1000, vid,
              speed, xway, lane, dir, seg, pos, simulated_time, 0, 0, 0, 0, 0, 0) as value
            from reports""", "reports"),
        "union_sources": sql(f"select {REPORT_COLS} from reports", "reports"),
        "account_requests": sql(f"""
            select {REPORT_COLS}, vid * 10 + lane as qid, seg as sinit, (seg + 3) % 10 as send,
              vid % 7 + 1 as dow, {_MINUTE} as tod, vid % 69 + 1 as day,
              1700000000000 + cast(simulated_time as bigint) * 1000 as wall_ms
            from reports where type = 2""", "reports"),
        "one_per_second": sql(f"""
            select {REPORT_COLS} from (select * replace (
              case when type = 0 then least(speed, speed + vid % 3 - 1) else speed end as speed) from reports)""", "reports"),
        "write_by_block": sql(f"""
            select {REPORT_COLS}, cast((xway + floor(seg / 4)) % 8 as int) as block
            from pos""", "pos"),
        "segment_key": sql("""
            select distinct xway, seg, concat_ws('_', xway, seg) as key, xway as key_xway,
              seg as key_seg from pos""", "pos"),
        "segment_block": sql("""
            select xway, seg, cast((xway + floor(seg / 4)) % 8 as int) as block, count(*) as n
            from pos group by xway, seg""", "pos"),
        "tap": sql("select xway, seg, minute, lav, nov, toll from toll", "toll"),
        # Selection and counts
        "positions": sql(f"select {REPORT_COLS} from pos", "pos"),
        "route_by_type": sql("select type, count(*) as n from reports group by type", "reports"),
        "segment_counts": sql("select xway, seg, count(*) as n from pos group by xway, seg", "pos"),
        "minute_of": sql(f"select vid, simulated_time, {_MINUTE} as minute from pos", "pos"),
        # Statistics and tolls
        "vehicle_minute_speed": sql("select xway, seg, minute, vid, v, n from vm", "vm"),
        "segment_minute_avg": sql("select xway, seg, minute, round(a, 6) as a from sm", "sm"),
        "segment_minute_count": sql("""
            select xway, seg, cast(floor(simulated_time / 60) as int) + 1 as minute,
              count(distinct vid) as n from pos group by 1, 2, 3""", "pos"),
        "segment_nov": sql("""
            select m.xway, m.seg, m.minute, cast(coalesce(p.n, 0) as bigint) as nov
            from sm m left join sm p
              on p.xway = m.xway and p.seg = m.seg and p.minute = m.minute - 1""", "sm"),
        "segment_lav": sql("""
            select m.xway, m.seg, m.minute, round(coalesce(avg(p.a), 0), 6) as lav
            from sm m left join sm p on p.xway = m.xway and p.seg = m.seg
              and p.minute between m.minute - 4 and m.minute - 1
            group by m.xway, m.seg, m.minute""", "sm"),
        "segment_lav_compat": sql("""
            select m.xway, m.seg, m.minute, round(coalesce(avg(p.a), 0), 6) as lav
            from sm m left join sm p on p.xway = m.xway and p.seg = m.seg and p.minute < m.minute
              and not exists (select 1 from sm q where q.xway = p.xway and q.seg = p.seg
                              and q.minute = p.minute + 5 and q.minute <= m.minute)
            group by m.xway, m.seg, m.minute""", "sm"),
        "segment_stats": sql("select xway, seg, minute, round(lav, 6) as lav, nov from stats",
                             "stats"),
        "segment_toll": sql("select xway, seg, minute, lav, nov, toll from toll", "toll"),
        # Stops and accidents
        "same_position_runs": sql("""
            select vid, xway, seg, pos, count(*) as n, min(simulated_time) as t_first,
              max(simulated_time) as t_last
            from run_rows group by vid, xway, seg, pos, run""", "run_rows"),
        "stopped_vehicles": sql("select vid, xway, seg, pos, t0, n from stops", "stops"),
        "stop_intervals": sql(f"select vid, xway, seg, lane, pos, t0, {end()} from closed_stops",
                              "closed_stops"),
        "stop_intervals_by_segment": sql(
            f"select vid, xway, seg, lane, pos, t0, {end()} from s_closed_stops", "s_closed_stops"),
        "stop_intervals_pair_gap": sql("""
            select vid, xway, seg, lane, pos, t0,
              case when t_after < 0 then t_last + 31 else least(t_after, t_last + 31) end as t1
            from stops""", "stops"),
        "accidents_by_position": sql(
            f"select xway, seg, lane, pos, t0, {end()} from acc_pos", "acc_pos"),
        "accident_vehicles": sql(f"""
            select xway, seg, lane, pos, t0, {end()}, count(distinct vid) as involved
            from acc_vehicles group by all""", "acc_vehicles"),
        "segment_accidents": sql(f"select xway, seg, t0, {end()} from acc_seg", "acc_seg"),
        "segment_accidents_by_segment": sql(
            f"select xway, seg, t0, {end()} from s_acc_seg", "s_acc_seg"),
        "upstream_scope": sql(f"select xway, seg, t0, {end()} from scope", "scope"),
        "accident_signals": sql("select xway, seg, t, is_new from signals", "signals"),
        "accident_flags": sql("""
            select xway, seg, cast(floor(t / 60) as int) + 1 as minute, bool_or(is_new) as is_new,
              bool_or(not is_new) as is_cleared from signals group by 1, 2, 3""", "signals"),
        "accident_resignals": sql("""
            select distinct p.xway, p.seg, p.pos, p.vid, p.simulated_time
            from pos p join acc_vehicles v
              on p.xway = v.xway and p.seg = v.seg and p.pos = v.pos and p.vid = v.vid
             and p.simulated_time > v.stop_t0 and p.simulated_time < v.stop_t1
             and p.simulated_time > v.t0 and p.simulated_time < v.t1""", "acc_vehicles", "pos"),
        "accident_timeline": sql("""
            select m.xway, m.seg, m.minute, cast(coalesce(s.t0, -1) as int) as acc_start,
              cast(case when s.t1 <= m.t then s.t1 else 2147483647 end as int) as acc_clear,
              coalesce(s.t0 < m.t and m.t < s.t1, false) as has_accident
            from (select xway, seg, minute, (minute - 1) * 60 as t from sm) m
            asof left join (select xway, seg, t0, max(t1) as t1 from scope group by 1, 2, 3) s
              on m.xway = s.xway and m.seg = s.seg and m.t >= s.t0""", "sm", "scope"),
        # Entries and vehicle state
        "new_vehicles": sql("""
            select vid, simulated_time, speed, xway, lane, dir, seg, pos from entries""",
                            "entries"),
        "segment_crossings": sql("""
            select vid, simulated_time, speed, xway, lane, dir, seg, pos from crossings""",
                                 "crossings"),
        "new_vehicles_ttl": sql("""
            select vid, simulated_time, speed, xway, lane, dir, seg, pos
            from (select *, lag(simulated_time) over (partition by xway, seg, vid
                                                      order by simulated_time) as before
                  from pos) l
            where before is null or simulated_time - before > 600""", "pos"),
        "vehicles_retained": sql("""
            select xway, seg, vid, simulated_time
            from (select xway, seg, vid, max(simulated_time) as simulated_time
                  from pos group by 1, 2, 3) v
            join (select xway, seg, max(simulated_time) as high from pos group by 1, 2) h
              using (xway, seg)
            where simulated_time >= high - 60""", "pos"),
        "new_vehicles_batch": sql(f"""
            select vid, simulated_time, speed, xway, lane, dir, seg, pos from entries
            where not ({first_half})""", "entries"),
        "state_upsert": sql("""
            select xway, seg, vid, max(simulated_time) as simulated_time,
              arg_max(speed, simulated_time) as speed, arg_max(lane, simulated_time) as lane,
              arg_max(pos, simulated_time) as pos from pos group by 1, 2, 3""", "pos"),
        "segment_high_time": sql("""
            select xway, seg, max(simulated_time) as high_time from pos group by 1, 2""", "pos"),
        # As-of joins and notifications
        "asof_stats": sql("""
            select s.xway, s.seg, s.minute, round(s.lav, 6) as lav, s.nov, a.t as signal_t, a.is_new
            from (select *, (minute - 1) * 60 as t from stats) s
            asof left join (select xway, seg, t, bool_or(is_new) as is_new
                            from signals group by 1, 2, 3) a
              on s.xway = a.xway and s.seg = a.seg and s.t >= a.t""", "stats", "signals"),
        "asof_toll": sql("""
            select p.vid, p.simulated_time, p.xway, p.seg, t.lav, t.nov, t.toll
            from pos p asof left join (select *, (minute - 1) * 60 as since from toll) t
              on p.xway = t.xway and p.seg = t.seg and p.simulated_time >= t.since""",
                         "pos", "toll"),
        "enriched_entries": sql("""
            select vid, simulated_time, xway, seg, lane, minute, lav, nov, toll, in_accident
            from enriched""", "enriched"),
        "toll_notifications": sql("""
            select 0 as kind, vid, simulated_time as t, lav,
              case when in_accident then 0 else toll end as toll from enriched""", "enriched"),
        "accident_notifications": sql("""
            select 1 as kind, vid, simulated_time as t, seg, pos from enriched
            where in_accident and lane <> 4""", "enriched"),
        "notifications": sql(notice_sql(), "enriched"),
        "notifications_crossing": sql(notice_sql("x_enriched"), "x_enriched"),
        "notifications_by_direction": sql(notice_sql("d_enriched"), "d_enriched"),
        "notifications_delayed": sql("""
            select 1 as kind, e.vid, e.simulated_time as t, e.seg, e.pos from crossings e
            where lane <> 4 and exists (
              select 1 from scope s where s.xway = e.xway and s.seg = e.seg
                and s.t0 < e.simulated_time and e.simulated_time < s.t1
                and e.minute >= cast(floor(s.t0 / 60) as int) + 1 + 1)""", "crossings", "scope"),
    }
    out["vehicle_latest"] = out["state_upsert"]

    # Streams end in the same results.
    out["s_file_source"] = out["union_sources"]
    out["s_new_vehicles"] = out["new_vehicles"]
    out["s_new_vehicles_ttl"] = out["new_vehicles_ttl"]
    out["s_accidents"] = out["accident_signals"]
    out["s_accidents_by_segment"] = out["segment_accidents_by_segment"]
    out["s_segment_lav_compat"] = out["segment_lav_compat"]
    out["s_notifications"] = out["notifications"]
    out["s_replay"] = sql("""
        select cast(floor(simulated_time / 2400) as int) as batch, count(*) as n,
          min(simulated_time) as t_min, max(simulated_time) as t_max
        from reports group by 1""", "reports")
    out["s_metrics"] = sql("""
        select cast(floor(simulated_time / 2400) as int) as batch, count(*) as reports,
          count(*) filter (where type = 0) as positions from reports group by 1""", "reports")
    out["s_latency"] = sql("select count(*) as n, true as in_order from entries", "entries")
    out["s_minute_stats"] = sql("select xway, seg, minute, round(a, 6) as a, n from sm", "sm")
    out["s_segment_stats"] = sql("""
        select xway, seg, minute, round(s.lav, 6) as lav, s.nov, t.toll
        from stats s join toll t using (xway, seg, minute)""", "stats", "toll")
    out["s_vehicles_in_state"] = sql("select xway, seg, vid, simulated_time from entries", "entries")
    out["s_stops_in_state"] = sql("""
        select vid, xway, seg, lane, pos, t0 from closed_stops where t0 < 1880 and t1 >= 1880""", "closed_stops")
    out["state_table"] = out["state_upsert"]
    out["s_late_updates"] = out["s_minute_stats"]
    out["segment_stats_bucketed"] = out["segment_stats"]
    out["s_late"] = sql(f"select type, {_MINUTE} as minute, count(*) as n from pos group by 1, 2",
                        "pos")
    out["s_restart"] = sql("""
        select 0 as kind, vid, simulated_time as t, xway, seg, lane, pos from entries
        union all select 1, vid, t0, xway, seg, lane, pos from stops""", "entries", "stops")
    out["s_sink_csv"] = out["s_sink_foreach"] = sql("""
        select kind, vid, cast(1700000000000 + cast(t as bigint) * 1000 as bigint)
            as report_wall_ms,
          cast(case when kind = 0 then lav else seg end as int) as x,
          cast(case when kind = 0 then toll else pos end as int) as y
        from (""" + notice_sql() + ") n", "enriched")
    return out
