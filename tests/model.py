"""The rules as a plain fold over a few reports, to check the jobs against."""

from __future__ import annotations

from collections import defaultdict

OPEN = 10**9


def minute(t):
    return t // 60 + 1


def segment(r, rules):
    return (r["xway"], r["dir"], r["seg"]) if rules.direction_aware else (r["xway"], r["seg"])


def stats(reports, rules):
    """{(segment, minute): (lav, nov)}"""
    speeds = defaultdict(lambda: defaultdict(list))
    for r in sorted(reports, key=lambda r: r["simulated_time"]):
        speeds[segment(r, rules), minute(r["simulated_time"])][r["vid"]].append(r["speed"])
    mean, count = {}, {}
    for k, by_vid in speeds.items():
        vs = [v[0] + sum(s - v[0] for s in v) / 2 for v in by_vid.values()]
        mean[k], count[k] = sum(vs) / len(vs), len(vs)
    out = {}
    for seg, m in speeds:
        if rules.lav_keep_stale:
            # Minutes as they come; a minute goes when the one past its history comes.
            kept = {}
            for k in sorted(k for s, k in speeds if s == seg and k <= m):
                kept.pop(k - rules.lav_minutes - 1, None)
                past = list(kept.values())
                kept[k] = mean[seg, k]
        else:
            past = [mean[seg, k] for k in range(m - rules.lav_minutes, m) if (seg, k) in mean]
        lav = sum(past) / len(past) if past else 0.0
        out[seg, m] = (round(lav, 9), count.get((seg, m - 1), 0))
    return out


def stops(reports, rules):
    """[(vid, segment, lane, pos, t0, t1)]"""
    traces = defaultdict(list)
    for r in sorted(reports, key=lambda r: r["simulated_time"]):
        by = (r["vid"],) if rules.stop_scope == "vehicle" else (r["vid"], segment(r, rules))
        traces[by].append(r)
    out = []
    for trace in traces.values():
        run = []
        for r in [*trace, None]:
            place = r and (segment(r, rules), r["pos"])
            if run and place != (segment(run[0], rules), run[0]["pos"]):
                if len(run) >= rules.stop_reports:
                    fifth = run[rules.stop_reports - 1]
                    end = r["simulated_time"] if r else OPEN
                    if rules.pair_gap is not None:
                        end = min(end, run[-1]["simulated_time"] + rules.pair_gap + 1)
                    out.append((fifth["vid"], segment(fifth, rules), fifth["lane"], fifth["pos"],
                                fifth["simulated_time"], end))
                run = []
            if r:
                run.append(r)
    return out


def covered(intervals, depth):
    """Maximal intervals at which at least `depth` of the given ones are open."""
    out, start = [], None
    for t in sorted({t for i in intervals for t in i}):
        deep = sum(a <= t < b for a, b in intervals) >= depth
        if deep and start is None:
            start = t
        elif not deep and start is not None:
            out.append((start, t))
            start = None
    return out


def scope(reports, rules):
    """[(segment, t0, t1)] of the segments an accident concerns."""
    places = defaultdict(list)
    for vid, seg, lane, pos, t0, t1 in stops(reports, rules):
        places[seg, lane, pos].append((t0, t1))
    segments = defaultdict(list)
    for (seg, _, _), intervals in places.items():
        segments[seg] += covered(intervals, 2)
    out = []
    for seg, intervals in segments.items():
        ahead = rules.direction_aware and seg[1] == 1
        for i in range(rules.upstream + 1):
            s = seg[-1] + i if ahead else seg[-1] - i
            if s >= 0:
                out += [((*seg[:-1], s), t0, t1) for t0, t1 in covered(intervals, 1)]
    return out


def entries(reports, rules):
    out, seen, last = [], {}, {}
    for r in sorted(reports, key=lambda r: r["simulated_time"]):
        seg, vid, t = segment(r, rules), r["vid"], r["simulated_time"]
        if rules.entry_mode == "crossing":
            new = last.get(vid) != seg
        else:
            before = seen.get((vid, seg))
            new = before is None or (
                rules.vehicle_ttl is not None and t - before > rules.vehicle_ttl
            )
        seen[vid, seg], last[vid] = t, seg
        if new:
            out.append(r)
    return out


def notices(reports, rules):
    """[(kind, vid, t, lav, toll, seg, pos)]"""
    table, concerned, out = stats(reports, rules), scope(reports, rules), []
    for r in entries(reports, rules):
        t, seg = r["simulated_time"], segment(r, rules)
        lav, nov = table[seg, minute(t)]
        over = nov - rules.free_nov
        toll = rules.toll_factor * over**2 if lav < rules.free_speed and over > 0 else 0
        warned = any(
            s == seg and t0 < t < t1 and minute(t) >= minute(t0) + rules.notice_delay_minutes
            for s, t0, t1 in concerned
        )
        out.append((0, r["vid"], t, int(lav), 0 if warned else toll, None, None))
        if warned and r["lane"] != rules.exit_lane:
            out.append((1, r["vid"], t, None, None, r["seg"], r["pos"]))
    return out
