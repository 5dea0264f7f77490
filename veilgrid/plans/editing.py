"""Registered queries on editing, detection, issue lists, views and exports, with the same in DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from veilgrid.functions import views as V
from veilgrid.operators import detect, export, issues, lookups, masks, pictures, rasters, temporal, tilestore, tracking
from veilgrid.plans.catalog import _ALL, _FIXED, _FOLD, _PARTS, _REPAIRED, _TIME, DET, H, ORACLES, QUERIES, W, fixed_frames, query, sql
from veilgrid.sources import frames, shared, tables, workspaces

__all__ = ["ORACLES", "QUERIES"]

FACE_COLUMNS = ("x", "y", "w", "h", "conf")


def rect():
    return F.struct("x", "y", "w", "h")


def faces_by_frame(det):
    face = F.struct("face_idx", *FACE_COLUMNS)
    return det.groupBy("video_id", "frame_index").agg(F.sort_array(F.collect_list(face)).alias("faces"))


# Rectangles and views.


@query
def rect_clamp(spark, d):
    moved = V.offset_rect(rect(), F.lit(-90.0), F.lit(-60.0))
    c = V.clamp_rect(moved, F.lit(320.0), F.lit(90.0))
    return tables.detections(spark, d).select("video_id", "frame_index", "face_idx", c["x"].alias("x"), c["y"].alias("y"), c["w"].alias("w"), c["h"].alias("h"))


sql("rect_clamp", """select video_id, frame_index, face_idx, greatest(0, x-90) x, greatest(0, y-60) y, greatest(0, least(320, x-90+w)-greatest(0, x-90)) w, greatest(0, least(90, y-60+h)-greatest(0, y-60)) h from detections""".replace("(0,", "(0.0::double,").replace("(320,", "(320.0::double,").replace("(90,", "(90.0::double,"), *DET)


@query
def rect_scale(spark, d):
    factor = F.when(F.col("video_id") % 2 == 0, 1.00005).otherwise(0.4)
    s = V.scale_rect(rect(), factor, factor)
    return tables.detections(spark, d).select("video_id", "frame_index", "face_idx", *(s[c].alias(c) for c in "xywh"))


sql("rect_scale", "select video_id, frame_index, face_idx, x*f x, y*f y, w*f w, h*f h from (select *, case when video_id%2=0 then 1.0::double else 0.4::double end f from detections)", *DET)


@query
def letterbox(spark, d):
    """Where a click on the 900 x 700 box lands in the image, and a face in the box."""
    e = tables.events(spark, d).select("event_id", (F.col("event_id") * 37 % 900).cast("double").alias("px"), (F.col("event_id") * 53 % 700).cast("double").alias("py"))
    p = V.from_letterbox(F.col("px"), F.col("py"), 900.0, 700.0, float(W), float(H))
    back = V.to_letterbox(V.rect(p["x"], p["y"], F.lit(64.0), F.lit(32.0)), 900.0, 700.0, float(W), float(H))
    return e.select("event_id", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"), F.round(back["x"], 6).alias("bx"), F.round(back["y"], 6).alias("by"), F.round(back["w"], 6).alias("bw"))


sql("letterbox", """select event_id, round(case when inside then ix end, 6) x, round(case when inside then iy end, 6) y, round(case when inside then ox+ix*s end, 6) bx, round(case when inside then oy+iy*s end, 6) as by, round(64.0::double*s, 6) bw
    from (select *, ix>=0 and iy>=0 and ix<1280 and iy<720 inside from (select *, (event_id*37%900-ox)/s ix, (event_id*53%700-oy)/s iy from (select *, (900-1280*s)/2 ox, (700-720*s)/2 oy from (select event_id, least(900/1280.0::double, 700/720.0::double) s from events))))""")  # fmt: skip


@query
def frame_moves(spark, d):
    key = F.element_at(F.array(*map(F.lit, ("left", "right", "up", "down", "home", "end"))), (F.col("event_id") % 6 + 1).cast("int"))
    e = tables.video_of(tables.events(spark, d).select("event_id")).join(tables.video_meta(spark, d), "video_id")
    return e.select("event_id", V.moved(F.col("frame_index"), key, F.col("event_id") % 4 == 1, F.col("fps"), F.col("total_frames")).cast("bigint").alias("frame"))


sql("frame_moves", """select event_id, cast(greatest(0, least(n-1, case k when 0 then f-st when 1 then f+st when 2 then f+sec when 3 then f-sec when 4 then 0 else n-1 end)) as bigint) frame
    from (select event_id, event_id%6 k, event_id//8 f, case when event_id%4=1 then 10 else 1 end st, cast(round_even(fps,0) as bigint) sec, total_frames n from events join video_meta on video_id=event_id%8)""", "video_meta")  # fmt: skip


@query
def frame_seconds(spark, d):
    s = tables.frame_spine(spark, d).join(tables.video_meta(spark, d).select("video_id", "total_frames"), "video_id")
    at = V.frame_at_x((F.col("frame_index") % 1100).cast("double"), 1000.0, F.lit(1.5), F.lit(4.0), F.col("fps"), F.col("total_frames"))
    return s.select("video_id", "frame_index", V.seconds_of(F.col("frame_index"), F.col("fps")).alias("seconds"), at.cast("bigint").alias("at_x"))


sql("frame_seconds", "select s.video_id, frame_index, frame_index/s.fps as seconds, cast(least(total_frames-1, floor((1.5::double+4.0::double*least(1.0::double, (frame_index%1100)/1000.0::double))*s.fps)) as bigint) at_x from spine s join video_meta m using(video_id)", "video_meta", "spine")


@query
def timeline_wheel(spark, d):
    e = tables.events(spark, d).select("event_id", (F.col("event_id") % 50 / 2.0).alias("start"), (1.0 + F.col("event_id") % 7).alias("span"), ((F.col("event_id") % 5 - 2) / 2.0).alias("delta"), (F.col("event_id") % 11 / 10.0).alias("anchor"))
    to = V.wheeled(F.col("start"), F.col("span"), F.lit(20.0), F.col("delta"), F.col("anchor"), F.col("event_id") % 3 != 0)
    return e.select("event_id", F.round(to["start"], 9).alias("start"), F.round(to["span"], 9).alias("span"))


sql("timeline_wheel", """select event_id, round(case when dl=0 then st when z then greatest(0.0::double, least(greatest(0.0::double, 20-ns), st+sp*a-ns*a)) else greatest(0.0::double, least(greatest(0.0::double, 20-sp), st-dl*(sp/10))) end, 9) as start, round(case when dl<>0 and z then ns else sp end, 9) span
    from (select *, greatest(0.05::double, least(20.0::double, sp*case when dl>0 then 0.85::double else 1.15::double end)) ns from (select event_id, event_id%50/2.0::double st, cast(1+event_id%7 as double) sp, (event_id%5-2)/2.0::double dl, least(1.0::double, event_id%11/10.0::double) a, event_id%3<>0 z from events))""")  # fmt: skip


@query
def timeline_slots(spark, d):
    m = tables.video_meta(spark, d)
    frames = V.slot_frames(950.0, F.lit(2.0), F.lit(9.5), F.col("fps"), F.col("total_frames"))
    return m.select("video_id", F.posexplode(frames).alias("slot", "frame")).select("video_id", "slot", F.col("frame").cast("bigint").alias("frame"))


sql("timeline_slots", "select video_id, cast(k as int) slot, cast(greatest(0, least(total_frames-1, floor((2.0::double+7.5::double*((k*(950/9.0::double)+950/9.0::double*0.5)/950.0::double))*fps))) as bigint) frame from video_meta cross join (select unnest(range(9)) k)", "video_meta")


@query
def grid_lines(spark, d):
    e = tables.events(spark, d).select("event_id", (F.col("event_id") % 997 / 3.0).alias("start"))
    lines = V.grid_seconds(F.col("start"), F.col("start") + 0.7 + F.col("event_id") % 13)
    return e.select("event_id", F.explode(lines).alias("at")).select("event_id", F.round("at", 9).alias("at"))


sql("grid_lines", """select event_id, round(unnest(range(cast(ceil(st/step) as bigint), cast(floor(en/step) as bigint)+2))*step, 9) as at from (select *, case when n<=1 then p when n<=2 then 2*p when n<=5 then 5*p else 10*p end step from
    (select *, raw/p n from (select *, pow(10.0::double, floor(log10(greatest(raw, 1e-9)))) p from (select *, greatest(0.0001::double, en-st)/12 raw from (select event_id, event_id%997/3.0::double st, event_id%997/3.0::double+0.7::double+event_id%13 en from events)))))""")  # fmt: skip


# Texts and settings.


@query
def eta_texts(spark, d):
    ms = F.col("event_id") * F.col("event_id") % 20_000_000
    return tables.events(spark, d).select("event_id", V.eta_text(ms).alias("eta"), V.age_text(ms).alias("age"))


_S = "(select event_id, event_id*event_id%20000000//1000 s from events)"
sql("eta_texts", f"""select event_id, case when s>=3600 then concat(s//3600, '시간 ', s//60%60, '분 ', s%60, '초') when s>=60 then concat(s//60, '분 ', s%60, '초') else concat(s, '초') end eta,
    case when s>=60 then concat(s//60, '분 ', s%60, '초') else concat(s, '초') end age from {_S}""")  # fmt: skip


@query
def status_line(spark, d):
    """By job the last processed frame and how long ago that was, at the end of all samples."""
    s = tables.samples(spark, d)
    last = s.groupBy("job_id").agg(F.max_by("progress", F.struct("t_ms", "seq")).alias("frame"), F.max("t_ms").alias("at")).join(F.broadcast(s.agg(F.max("t_ms").alias("now"))))
    return last.select("job_id", V.status_text(F.col("frame"), F.lit(40_000), F.col("now") - F.col("at")).alias("status"))


sql("status_line", """select job_id, concat('마지막 처리: ', frame+1, '/40000 · 업데이트 ', case when s>=60 then concat(s//60, '분 ', s%60, '초') else concat(s, '초') end, ' 전') status from
    (select job_id, arg_max(progress, (t_ms, seq)) frame, ((select max(t_ms) from samples)-max(t_ms))//1000 s from samples group by job_id)""", "samples")  # fmt: skip


@query
def position_texts(spark, d):
    s = tables.frame_spine(spark, d).join(tables.video_meta(spark, d).select("video_id", "total_frames"), "video_id")
    frame, total = F.col("frame_index"), F.col("total_frames")
    return s.select("video_id", "frame_index", V.position_text(frame, total).alias("position"), V.percent(frame, total, True).alias("detect_pct"), V.percent(frame, total, False).alias("export_pct"))


sql("position_texts", "select s.video_id, frame_index, concat(frame_index+1, ' / ', total_frames) as position, cast(least(100, round_even(frame_index*100.0::double/greatest(1,total_frames-1),0)) as int) detect_pct, cast(least(100, round_even(frame_index*100.0::double/greatest(1,total_frames),0)) as int) export_pct from spine s join video_meta m using(video_id)", "video_meta", "spine")


@query
def setting_clamps(spark, d):
    e = tables.events(spark, d)
    raw = F.col("event_id") % 140 / 100.0 - 0.2
    return e.select("event_id", V.threshold(raw).alias("threshold"), V.radius_setting((F.col("event_id") % 60).cast("int")).alias("radius"), V.detect_every((F.col("event_id") % 9 - 1).cast("int"), F.col("event_id") % 2 == 0).alias("every"), F.size(V.thread_choices((F.col("event_id") % 40).cast("int"))).alias("choices"), masks.nearest_option(raw, [0.25, 0.5, 0.75, 1.0], 1.0).alias("ratio"))


sql("setting_clamps", """select event_id, cast(greatest(0.01::double, least(0.99::double, raw)) as float) threshold, cast(greatest(6, least(40, event_id%60)) as int) radius, cast(case when event_id%2=0 then greatest(1, event_id%9-1) else 1 end as int) every,
    cast(len(list_filter([1,2,4,6,8,12,16,24,32], lambda c: c<=greatest(1,event_id%40))) + case when list_contains([1,2,4,6,8,12,16,24,32], greatest(1,event_id%40)) then 0 else 1 end as int) choices,
    case when abs(raw-0.25)<0.0001 then 0.25::double when abs(raw-0.5)<0.0001 then 0.5::double when abs(raw-0.75)<0.0001 then 0.75::double else 1.0::double end ratio from (select event_id, event_id%140/100.0::double-0.2::double raw from events)""")  # fmt: skip


@query
def library_names(spark, d):
    made = F.element_at(F.array(*map(F.lit, ("libavcodec.61.dylib", "avutil", "LIBswscale.DYLIB", ".hidden", "libx.y.z"))), (F.col("event_id") % 5 + 1).cast("int"))
    named = tables.events(spark, d).select(V.library_name(made).alias("name"))
    return named.groupBy("name").count().orderBy(F.length("name"), "name").withColumnRenamed("count", "n")


sql("library_names", "select name, count(*) n from (select ['avcodec', 'avutil', 'swscale', '.hidden', 'x'][event_id%5+1] as name from events) group by name")


# Detection.


@query
def faces_by_area(spark, d):
    return detect.filter_faces(tables.detections(spark, d), None, W, H).select("video_id", "frame_index", "face_idx")


sql("faces_by_area", "select video_id, frame_index, face_idx from detections where w*h >= 0.001*1280*720 and w/h between 0.5 and 2.0", *DET)


@query
def search_region(spark, d):
    """The search region of every frame: the box around its faces, or all of it."""
    return detect.region_of_faces(tables.frame_spine(spark, d), tables.detections(spark, d), W, H)


def _sides(low: str, high: str, size: int, a: str, b: str) -> str:
    """Both ends of a side of the search region, 64 pixels apart at least."""
    pad = f"greatest(greatest(1.0::double, {high}-{low})*0.35::double, 32.0::double)"
    begin, stop = f"greatest(0.0::double, {low}-{pad})", f"least({size}.0::double, {high}+{pad})"
    grown = f"least({size}.0::double, greatest(0.0::double, {begin}-(64.0::double-({stop}-{begin}))/2)+64.0::double)"
    return f"case when {stop}-{begin} < 64 then greatest(0.0::double, {grown}-64.0::double) else {begin} end {a}, case when {stop}-{begin} < 64 then {grown} else {stop} end {b}"


sql("search_region", f"""select s.video_id, s.frame_index, coalesce(a, 0) x, coalesce(e, 0) y, coalesce(c-a, 1280) w, coalesce(g-e, 720) h from spine s left join (select video_id, frame_index, {_sides('x0', 'x1', 1280, 'a', 'c')}, {_sides('y0', 'y1', 720, 'e', 'g')} from
    (select video_id, frame_index, min(x) x0, min(y) y0, max(x+w) x1, max(y+h) y1 from detections group by all)) using(video_id, frame_index)""", *DET, "video_meta", "spine")  # fmt: skip


@query
def region_first(spark, d):
    return detect.region_first(tables.frame_spine(spark, d), tables.detections(spark, d), W, H)


_REGIONS = f"""regions as materialized (select video_id, frame_index+1 frame_index, a, e, c-a w, g-e h from (select video_id, frame_index, {_sides('x0', 'x1', 1280, 'a', 'c')}, {_sides('y0', 'y1', 720, 'e', 'g')} from
    (select video_id, frame_index, min(x) x0, min(y) y0, max(x+w) x1, max(y+h) y1 from detections group by all)) where c-a>=64 and g-e>=64 and not (c-a>=1280*0.9::double and g-e>=720*0.9::double)),
    searched as (select s.video_id, s.frame_index, r.w is not null attempt, coalesce(bool_or(f.x+f.w/2 between r.a and r.a+r.w and f.y+f.h/2 between r.e and r.e+r.h), false) hit, cast(round_even(r.w*r.h,0) as bigint) area
    from spine s left join regions r using(video_id, frame_index) left join detections f on f.video_id=s.video_id and f.frame_index=s.frame_index group by s.video_id, s.frame_index, r.w, r.h, r.a, r.e)"""
sql("region_first", "select * from searched", *DET, "video_meta", "spine", recursive=_REGIONS)


@query
def region_summary(spark, d):
    return detect.region_summary(detect.region_first(tables.frame_spine(spark, d), tables.detections(spark, d), W, H))


sql("region_summary", "select video_id, cast(sum(cast(attempt as int)) as bigint) attempts, cast(sum(cast(attempt and hit as int)) as bigint) hits, cast(sum(cast(not (attempt and hit) as int)) as bigint) fallbacks, round_even(sum(area) filter (attempt)/count(*) filter (attempt), 0) avg_area from searched group by all", *DET, "video_meta", "spine", recursive=_REGIONS)


@query
def hold_last(spark, d):
    """Detection every fourth frame, held between; at once while nothing is held."""
    held = detect.hold_last(temporal.frames(tables.frame_spine(spark, d), tables.detections(spark, d).withColumn("stored", F.lit(False))), 4)
    return held.select("video_id", "frame_index", "detected", "held_from", F.coalesce(F.size("faces"), F.lit(0)).alias("faces"))


sql("hold_last", "select h.video_id, h.frame_index, detected, held held_from, coalesce(t.n, 0) as faces from h left join tally t on t.video_id=h.video_id and t.frame_index=h.held where h.frame_index >= 0", *DET, "video_meta", "spine", recursive="""tally as materialized (select s.video_id, s.frame_index, cast(count(f.conf) as int) n from spine s left join detections f using(video_id, frame_index) group by all),
    h as (select video_id, cast(-1 as bigint) frame_index, false detected, cast(null as bigint) held from video_meta union all
    select t.video_id, t.frame_index, t.frame_index%4=0 or h.held is null, case when t.frame_index%4=0 or h.held is null then case when t.n>0 then t.frame_index end else h.held end from h join tally t on t.video_id=h.video_id and t.frame_index=h.frame_index+1)""")  # fmt: skip


# Issue lists.


def edited_frames(spark, d):
    return tables.events(spark, d).where("event_id % 7 = 3").selectExpr("event_id % 8 video_id", "event_id div 8 frame_index").distinct()


_EDITED = ", edited as (select distinct event_id%8 video_id, event_id//8 frame_index from events where event_id%7=3)"


def repaired_sql(name: str, body: str, more: str = "") -> None:
    sql(name, body, *_ALL, recursive=_FOLD + _FIXED + _REPAIRED + _EDITED + more)


@query
def issues_resolved(spark, d):
    found = temporal.issues(fixed_frames(spark, d))
    return issues.merged(issues.resolved(found, edited_frames(spark, d)))


repaired_sql("issues_resolved", "select distinct video_id, frame_index from issues i where not exists (select 1 from edited e where e.video_id=i.video_id and e.frame_index=i.frame_index)")


@query
def issue_list(spark, d):
    found = temporal.issues(fixed_frames(spark, d))
    return issues.entries(issues.shown(found, ["noface", "flicker"]), tables.video_meta(spark, d), edited_frames(spark, d), hide_resolved=True)


_LISTED = "(select i.*, m.fps, e.video_id is not null resolved from issues i join video_meta m on m.video_id=i.video_id left join edited e on e.video_id=i.video_id and e.frame_index=i.frame_index where issue <> 'lowconf')"
repaired_sql("issue_list", f"select video_id, frame_index, issue, case issue when 'noface' then '얼굴 없음' else '연속 끊김' end label, {_TIME} time_text, resolved, not resolved visible from {_PARTS.format(_LISTED)}")


@query
def issue_at_or_after(spark, d):
    found = temporal.issues(fixed_frames(spark, d))
    targets = tables.events(spark, d).selectExpr("event_id % 8 video_id", "event_id div 8 * 3 target")
    return issues.first_at_or_after(found, targets)


repaired_sql("issue_at_or_after", """select t.video_id, t.target, case when len(later.l)>0 then later.l[1] end first_after, f.al[1] as first from (select event_id%8 video_id, event_id//8*3 target from events) t left join
    (select video_id, list_sort(list(distinct frame_index)) al from issues group by all) f using(video_id), lateral (select list_filter(f.al, lambda q: q>=t.target) l) later""")


# The mask store.


def change_log(spark, d):
    det = tables.detections(spark, d).drop("stored")
    faces = faces_by_frame(det)
    e = tables.video_of(tables.events(spark, d).select("event_id"))
    op = F.when(F.col("event_id") % 331 == 5, masks.CLEAR).when(F.col("event_id") % 5 == 0, masks.MASK).when(F.col("event_id") % 11 == 0, masks.REMOVE).otherwise(masks.FACES)
    # A frame is written twice: once as detected, and again by the event of the mirrored frame.
    two = e.select("event_id", "video_id", (F.col("frame_index") - F.col("frame_index") % 3).alias("frame_index"), op.alias("op"))
    sized = two.withColumns({"width": F.lit(W), "height": F.when(F.col("event_id") % 13 == 0, 0).otherwise(H), "seq": F.col("event_id")})
    return sized.join(faces, ["video_id", "frame_index"], "left").select("video_id", "frame_index", "seq", "op", "faces", "width", "height")


_LOG = """log as (select event_id%8 video_id, event_id//8-event_id//8%3 frame_index, event_id seq, case when event_id%331=5 then 'clear' when event_id%5=0 then 'mask' when event_id%11=0 then 'remove' else 'faces' end op, case when event_id%13=0 then 0 else 720 end h from events),
    counted as (select video_id, frame_index, count(*) n from detections group by all), live as (select l.*, coalesce(c.n, 0) n from log l left join (select video_id, max(seq) cut from log where op='clear' group by all) k using(video_id) left join counted c on c.video_id=l.video_id and c.frame_index=l.frame_index where op<>'clear' and (cut is null or seq>cut)),
    state as (select video_id, frame_index, bool_or(op='mask') stored, arg_max(case when op='faces' and h>0 then n else 0 end, seq) as faces from live group by all)"""


@query
def mask_store(spark, d):
    state = masks.after_changes(change_log(spark, d))
    return state.select("video_id", "frame_index", "stored", F.coalesce(F.size("faces"), F.lit(0)).cast("bigint").alias("faces"))


sql("mask_store", "select video_id, frame_index, stored, faces from state where stored or faces>0", *DET, recursive=_LOG)


@query
def unprocessed_frames(spark, d):
    state = masks.after_changes(change_log(spark, d))
    return masks.unprocessed(tables.frame_spine(spark, d).select("video_id", "frame_index"), state.where("stored"), state.where("faces is not null"))


sql("unprocessed_frames", "select video_id, frame_index from spine s where not exists (select 1 from state t where (stored or faces>0) and t.video_id=s.video_id and t.frame_index=s.frame_index)", *DET, "video_meta", "spine", recursive=_LOG)


@query
def repaired_confidences(spark, d):
    """Every third frame has lost its list of confidences, every ninth its least one too."""
    f = faces_by_frame(tables.detections(spark, d))
    given = F.when(F.col("frame_index") % 3 > 0, masks.confidences_only(F.col("faces")))
    least = F.when(F.col("frame_index") % 9 > 0, F.array_min(masks.confidences_only(F.col("faces"))))
    return f.select("video_id", "frame_index", F.posexplode(masks.repaired_confidences(F.col("faces"), given, least)).alias("face_idx", "conf"))


sql("repaired_confidences", "select video_id, frame_index, face_idx, case when frame_index%3>0 then conf when frame_index%9>0 then min(conf) over (partition by video_id, frame_index) else cast(1.0 as float) end conf from (select *, cast(row_number() over (partition by video_id, frame_index order by face_idx)-1 as int) face_idx_ from detections) ".replace("video_id, frame_index, face_idx, case", "video_id, frame_index, face_idx_ face_idx, case"), *DET)


def saved_workspaces(spark, d):
    o = tables.opens(spark, d).withColumn("mode", F.when(F.col("seq") % 3 == 0, "Auto").otherwise("Manual"))
    latest = o.groupBy("path", "mode").agg(F.max("seq").alias("seq"))
    return latest.withColumn("indices", F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (F.col("seq") * (k + 3) % 50).cast("int"))))


def mask_folder(spark, d):
    o = tables.opens(spark, d).withColumn("mode", F.when(F.col("seq") % 3 == 0, "Auto").otherwise("Manual"))
    return o.select("path", "mode", (F.col("seq") % 29).cast("int").alias("mask_index")).distinct()


_WS = """o as (select *, case when seq%3=0 then 'Auto' else 'Manual' end mode from opens), ws as (select path, mode, max(seq) seq from o group by all),
    idx as (select distinct path, mode, seq, cast(seq*(k+3)%50 as int) mask_index from ws cross join (select unnest(range(10)) k)), files as (select distinct path, mode, cast(seq%29 as int) mask_index from o)"""


@query
def workspace_masks(spark, d):
    return masks.load_masks(saved_workspaces(spark, d), mask_folder(spark, d))


sql("workspace_masks", "select path, mode, mask_index from idx i where exists (select 1 from files f where lower(f.path)=lower(i.path) and f.mode=i.mode and f.mask_index=i.mask_index)", "opens", recursive=_WS)


@query
def workspace_lookup(spark, d):
    asked = tables.opens(spark, d).select(F.upper("path").alias("path"), F.lit("AUTO").alias("mode")).distinct()
    return masks.first_workspace(saved_workspaces(spark, d), asked)


sql("workspace_lookup", "select a.p asked_path, 'AUTO' asked_mode, min(w.seq) seq, arg_min(w.path, w.seq) path, arg_min(w.mode, w.seq) as mode from (select distinct upper(path) p from opens) a join ws w on lower(w.path)=lower(a.p) and lower(w.mode)='auto' group by all", "opens", recursive=_WS)


@query
def workspace_save(spark, d):
    """The mask files after the workspaces of odd ``seq`` are saved anew."""
    ws = saved_workspaces(spark, d)
    files, _ = masks.save_workspace(mask_folder(spark, d), ws.drop("indices"), ws.where("seq % 2 = 1"))
    return files


sql("workspace_save", "select path, mode, mask_index from files f where not exists (select 1 from ws where seq%2=1 and lower(ws.path)=lower(f.path) and ws.mode=f.mode) union all select path, mode, mask_index from idx where seq%2=1", "opens", recursive=_WS)


@query
def workspace_remove(spark, d):
    """Workspaces left when the paths that fell out of the recent ones take theirs with them."""
    return masks.without_paths(saved_workspaces(spark, d).drop("indices"), masks.evicted(tables.opens(spark, d)))


sql("workspace_remove", "select path, mode, seq from ws where lower(path) in (select lower(path) from opens group by 1 order by max(seq) desc limit 5)", "opens", recursive=_WS)


@query
def snapshot_restore(spark, d):
    e = tables.video_of(tables.events(spark, d).select("event_id")).join(tables.video_meta(spark, d), "video_id")
    made = e.select("event_id", "total_frames", "fps", (F.col("event_id") % 40 - 3.0).alias("view_start"), (F.col("event_id") % 9 - 1.0).alias("span"), (F.col("event_id") % 3000 - 20).alias("selected"))
    return masks.restored(made, 10.0).select("event_id", "view_start", "span", F.col("selected").cast("bigint").alias("selected"))


sql("snapshot_restore", "select event_id, greatest(0.0::double, least(vs, greatest(0.0::double, total_frames/fps-sp))) view_start, sp span, cast(greatest(0, least(event_id%3000-20, total_frames-1)) as bigint) selected from (select *, event_id%40-3.0::double vs, case when event_id%9-1<=0 then 10.0::double else event_id%9-1.0::double end sp from events join video_meta on video_id=event_id%8)", "video_meta")


@query
def settings_saved(spark, d):
    e = tables.events(spark, d).select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 100 / 100.0).alias("detection"), F.when(F.col("event_id") % 40 == 7, (F.col("event_id") % 50).cast("double")).alias("radius"))
    return masks.settings(e, {"detection": 0.3, "radius": 24.0})


sql("settings_saved", "select user_id, coalesce(arg_max(event_id%100/100.0::double, event_id) filter (event_id%3=0), 0.3::double) detection, coalesce(arg_max(cast(event_id%50 as double), event_id) filter (event_id%40=7), 24.0::double) radius from events group by all")


@query
def undo_log(spark, d):
    a = tables.video_of(tables.events(spark, d).select("event_id")).select("video_id", F.expr("frame_index div 40").alias("frame_index"), F.col("event_id").alias("seq"), (F.col("event_id") * 11 % 7 > 3).alias("undo"))
    return masks.not_undone(a).select("video_id", "frame_index", "seq")


sql("undo_log", "select video_id, frame_index, unnest(s) seq from st where last", recursive="""acts as materialized (select event_id%8 video_id, event_id//8//40 frame_index, event_id seq, event_id*11%7>3 undo, row_number() over (partition by event_id%8, event_id//8//40 order by event_id) i, lead(event_id) over (partition by event_id%8, event_id//8//40 order by event_id) is null last from events),
    st as (select video_id, frame_index, i, last, case when undo then [] else [seq] end s from acts where i=1 union all select a.video_id, a.frame_index, a.i, a.last, case when undo then st.s[1:len(st.s)-1] else list_append(st.s, a.seq) end from st join acts a on a.video_id=st.video_id and a.frame_index=st.frame_index and a.i=st.i+1)""")  # fmt: skip


# Exports and resuming.


@query
def stream_probe(spark, d):
    e = tables.events(spark, d).select(F.col("event_id").alias("video_id"), F.when(F.col("event_id") % 4 == 0, 0).otherwise(30000).alias("avg_num"), F.lit(1001).alias("avg_den"), F.when(F.col("event_id") % 8 == 0, 0).otherwise(25).alias("r_num"), F.lit(1).alias("r_den"), F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("event_id") * 100).alias("duration"), F.lit(1).alias("tb_num"), F.lit(90000).alias("tb_den"), F.when(F.col("event_id") % 10 == 0, 0).otherwise(F.col("event_id") * 1234).alias("file_duration_us"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id")).alias("nb_frames"))
    return export.probed(e)


sql("stream_probe", """select video_id, fps, cast(floor(secs*fps) as bigint) total_frames, secs duration_s, cast(case when nb>0 then nb when known is not null and secs>0 then round_even(secs*known,0) else 0 end as bigint) export_frames from
    (select *, coalesce(known, 30.0::double) fps from (select event_id video_id, case when event_id%4<>0 then 30000/1001.0::double when event_id%8<>0 then 25.0::double end known, case when event_id%5<>0 and event_id>0 then event_id*100*(1/90000.0::double) when event_id%10<>0 then event_id*1234/1e6::double else 0.0::double end secs, case when event_id%3=0 then 0 else event_id end nb from events))""")  # fmt: skip


@query
def read_from(spark, d):
    m = tables.video_meta(spark, d)
    starts = m.select("video_id", F.floor(F.col("total_frames") / 3 / F.col("fps") * 90000).alias("at"))
    return export.read_from(tables.frame_pts(spark, d), starts)


sql("read_from", "select p.* from frame_pts p join video_meta m using(video_id) where pts >= floor(total_frames/3.0::double/fps*90000)", "video_meta", "frame_pts")


@query
def encoder_choice(spark, d):
    pick = lambda of, by: F.element_at(F.array(*map(F.lit, of)), (by % len(of) + 1).cast("int"))
    asked = tables.events(spark, d).select(F.col("event_id").alias("job_id"), pick(("mp4", "webm"), F.col("event_id")).alias("container"), pick(("h264", "vp9", "prores"), F.col("event_id")).alias("codec"), pick(("yuv420p", "yuv444p", "bgra"), F.expr("event_id div 3")).alias("pix_fmt"))
    containers = spark.createDataFrame([("mp4", "h264"), ("mp4", "prores"), ("webm", "vp9")], "container string, codec string")
    encoders = spark.createDataFrame([("h264", ["yuv420p", "yuv444p"]), ("vp9", None)], "codec string, pix_fmts array<string>")
    return export.encoder_choice(asked, containers, encoders)


sql("encoder_choice", """select job_id, chosen, case when chosen='vp9' or f in ('yuv420p','yuv444p') then f else 'yuv420p' end pix_fmt, reason from (select *, case when reason is null then c else 'h264' end chosen from (select job_id, c, f, case when not ((k='mp4' and c in ('h264','prores')) or (k='webm' and c='vp9')) then 'container' when c='prores' then 'encoder' end reason from
    (select event_id job_id, ['mp4','webm'][event_id%2+1] k, ['h264','vp9','prores'][event_id%3+1] c, ['yuv420p','yuv444p','bgra'][event_id//3%3+1] f from events)))""")  # fmt: skip


@query
def audio_negotiation(spark, d):
    rates, formats = F.array(F.lit(48000), F.lit(44100), F.lit(32000)), F.array(F.lit("fltp"), F.lit("s16"))
    rate, fmt = (F.col("event_id") % 5 * 11025).cast("int"), F.when(F.col("event_id") % 2 == 0, "s16").otherwise("u8")
    listed = F.when(F.col("event_id") % 7 > 0, rates)
    e = tables.events(spark, d)
    return e.select("event_id", export.negotiated(listed, rate, last=True).alias("rate"), export.negotiated(formats, fmt, last=False).alias("fmt"), export.audio_choice(F.col("event_id") % 3 == 0, F.col("event_id") % 4 > 0).alias("audio"))


sql("audio_negotiation", "select event_id, cast(case when event_id%7=0 or event_id%5*11025 in (48000,44100,32000) then event_id%5*11025 else 32000 end as int) rate, case when event_id%2=0 then 's16' else 'fltp' end fmt, case when event_id%3=0 then 'copy' when event_id%4>0 then 'aac' else 'drop' end audio from events")


@query
def output_names(spark, d):
    choice = F.element_at(F.array(F.lit("overwrite"), F.lit("save_as"), F.lit("cancel")), (F.col("seq") % 3 + 1).cast("int"))
    o = tables.opens(spark, d)
    return o.select("seq", export.output_name(F.col("path"), F.col("seq") % 4 > 0, choice, F.when(F.col("seq") % 50 == 1, 10_000).otherwise(F.col("seq") % 9 + 1)).alias("name"))


sql("output_names", "select seq, case when seq%4=0 or seq%3=0 then concat(b, '_blur.mp4') when seq%3=1 then case when seq%50=1 then concat(b, '_blur.mp4') else concat(b, '_blur (', seq%9+1, ').mp4') end end as name from (select seq, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) b from opens)", "opens")


@query
def export_plan(spark, d):
    det = tables.detections(spark, d)
    return export.export_plan(tables.frame_spine(spark, d), det.where("stored"), det)


sql("export_plan", "select s.video_id, s.frame_index, case when st.video_id is not null then 'stored' when n>0 then 'faces' else 'copy' end source, case when st.video_id is null then coalesce(n,0) else 0 end as faces from spine s left join stored st using(video_id, frame_index) left join (select video_id, frame_index, count(*) n from detections group by all) c using(video_id, frame_index)", *DET, "video_meta", "spine", "stored")


@query
def resume_frames(spark, d):
    m = tables.video_meta(spark, d)
    resume = m.select("video_id", F.when(F.col("video_id") % 3 == 0, -1).otherwise(F.expr("total_frames div 2")).alias("resume_index"))
    return export.still_to_do(tables.frame_spine(spark, d), tables.detections(spark, d), resume)


sql("resume_frames", "select video_id, frame_index from spine s join video_meta m using(video_id) where frame_index >= case when video_id%3=0 then 0 else m.total_frames//2 end and not exists (select 1 from detections t where t.video_id=s.video_id and t.frame_index=s.frame_index)", *DET, "video_meta", "spine")


@query
def resume_prompts(spark, d):
    e = tables.events(spark, d)
    auto, done, at = F.col("event_id") % 2 == 0, F.col("event_id") % 5 == 0, F.col("event_id") % 4
    busy = export.busy_progress(F.col("event_id") % 6 == 0, F.lit(10), F.col("event_id") % 4 == 0, F.lit(20), F.col("event_id") % 3 == 0, F.lit(30))
    return e.select("event_id", export.resume_needed(auto, done, at).alias("resume"), busy.alias("busy"))


sql("resume_prompts", "select event_id, event_id%2=0 and event_id%5<>0 and event_id%4>0 resume, cast(case when event_id%6=0 then 10 when event_id%4=0 then 20 when event_id%3=0 then 30 end as int) busy from events")


@query
def current_results(spark, d):
    s = tables.samples(spark, d)
    asked = s.select(F.col("job_id").alias("key"), F.col("seq").alias("stamp"), F.col("t_ms").alias("asked_ms"))
    done = s.select(F.col("job_id").alias("key"), F.col("seq").alias("stamp"), (F.col("t_ms") + F.col("seq") * 37 % 1500).alias("done_ms"))
    return export.current_results(asked, done)


sql("current_results", "select job_id as key, seq as stamp, done_ms from (select *, t_ms+seq*37%1500 done_ms, lead(t_ms) over (partition by job_id order by seq) nx from samples) where nx is null or done_ms<nx", "samples")



# Masks of all frames, at a sixteenth of the size, as detection on a proxy sees them.

PROXY, PW, PH = 1 / 16, 80, 45


def proxy_faces(spark, d):
    s = V.scale_rect(rect(), F.lit(PROXY), F.lit(PROXY))
    return tables.detections(spark, d).select("video_id", "frame_index", "face_idx", "conf", *(s[c].alias(c) for c in "xywh"))


_RASTER = """raster as materialized (select video_id, frame_index, x, y, max(case when d2<=0.65*0.65::double then 255 else cast(round_even((1.0-t*t*(3.0-2.0*t))*255.0,0) as int) end) alpha from (select *, (d2-0.65*0.65::double)/(1.0-0.65*0.65::double) t from
    (select video_id, frame_index, px x, py y, (px-(x0+x1-1)/2.0::double)*(px-(x0+x1-1)/2.0::double)/(greatest(1.0::double,(x1-x0)/2.0::double)*greatest(1.0::double,(x1-x0)/2.0::double))+(py-(y0+y1-1)/2.0::double)*(py-(y0+y1-1)/2.0::double)/(greatest(1.0::double,(y1-y0)/2.0::double)*greatest(1.0::double,(y1-y0)/2.0::double)) d2
    from (select *, unnest(range(y0, y1)) py from (select *, unnest(range(x0, x1)) px from (select video_id, frame_index, greatest(0,least(79,floor(x/16-greatest(6,w/16*0.15::double))))::int x0, greatest(0,least(44,floor(y/16-greatest(6,h/16*0.25::double))))::int y0,
    greatest(0,least(80,ceil(x/16+w/16+greatest(6,w/16*0.15::double))))::int x1, greatest(0,least(45,ceil(y/16+h/16+greatest(6,h/16*0.25::double))))::int y1 from detections)))) where d2<=1.0) group by all having alpha > 0)"""


@query
def frame_masks(spark, d):
    """The mask of every frame with faces: its pixels, the sum of alpha, and its bounds."""
    made = rasters.masks(proxy_faces(spark, d), F.lit(PW), F.lit(PH))
    return made.select("video_id", "frame_index", "lit", F.col("sum").alias("alpha"), "x0", "y0", "x1", "y1")


sql("frame_masks", "select video_id, frame_index, count(*) lit, cast(sum(alpha) as bigint) alpha, min(x) x0, min(y) y0, max(x)+1 x1, max(y)+1 y1 from raster group by all", *DET, recursive=_RASTER)


@query
def frame_fades(spark, d):
    """The masks of every video's frames with what is left of those before: pixels still lit, and the sum of alpha."""
    return rasters.fades(proxy_faces(spark, d), F.lit(PW), F.lit(PH))


def _fade(steps: int) -> str:
    out = "0"
    for back in range(steps, 0, -1):
        out = f"greatest(coalesce(lag(alpha, {back}) over w, 0), {out}*3//4)"
    return f"greatest(alpha, ({out})*3//4)"


sql("frame_fades", f"select video_id, frame_index, cast(count(*) filter (smooth > 0) as bigint) lit, cast(sum(smooth) as bigint) alpha from faded group by all", *DET, recursive=_RASTER + f""",
    boxes as (select video_id, frame_index, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from raster group by all), inside as materialized (select b.video_id, b.frame_index, b.x, b.y, coalesce(r.alpha, 0) alpha from (select *, unnest(range(y0, y1+1)) y from (select *, unnest(range(x0, x1+1)) x from boxes)) b left join raster r using (video_id, frame_index, x, y)),
    faded as (select video_id, frame_index, {_fade(18)} smooth from inside window w as (partition by video_id, x, y order by frame_index))""")


@query
def frame_radii(spark, d):
    """The blur radii of every frame's pixels, summed by frame."""
    return rasters.radii(proxy_faces(spark, d), F.lit(PW), F.lit(PH), 24).drop("radii")


sql("frame_radii", """select video_id, frame_index, count(*) covered, cast(sum(r) as bigint) radius, max(r) most from (select video_id, frame_index, px, py, max(r) r from (select *, unnest(range(y0, y1)) py from (select *, unnest(range(x0, x1)) px from (select video_id, frame_index,
    cast(greatest(1, least(24, round_even(24*case when a<=1 then 0.4::double when a<=3 then 0.55::double when a<=5 then 0.7::double else 1.0::double end,0))) as int) r, floor(greatest(0,x-px))::int x0, ceil(least(80,x+w+px))::int x1, floor(greatest(0,y-py))::int y0, ceil(least(45,y+h+py))::int y1
    from (select *, w*h*100.0::double/3600 a, greatest(6.0::double,w*0.15::double) px, greatest(6.0::double,h*0.25::double) py from (select video_id, frame_index, x/16 x, y/16 y, w/16 w, h/16 h from detections))))) group by all) group by all""", *DET)


@query
def frame_face_stats(spark, d):
    """Statistics of every face on its frame's own pixels: a scene that moves under the faces."""
    stats = pictures.face_stats(tables.detections(spark, d), pictures.scene_reader(W, H))
    return stats.withColumn("variance", F.round("variance", 6))


_STATS = """face as materialized (select video_id, frame_index, face_idx, greatest(0,least(1279,floor(x)))::int x0, greatest(0,least(719,floor(y)))::int y0, greatest(0,least(1279,ceil(x+w)-1))::int x1, greatest(0,least(719,ceil(y+h)-1))::int y1 from detections),
    sized as (select *, cast(least(4, greatest(1, floor(sqrt((x1-x0+1)*(y1-y0+1)/20.0::double)))) as int) st from face),
    points as (select *, (x-(17*video_id+5*frame_index)%1280+1280)%1280 sx, (y-3*frame_index%720+720)%720 sy from (select *, unnest(range(y0, y1+1, st)) y from (select *, unnest(range(x0, x1+1, st)) x from sized where x1>x0 and y1>y0))),
    shades as (select video_id, frame_index, face_idx, x, y, case when flat then 90 when grid then 140 when even then 120 else 90 end b, case when flat then 90 when grid then 220 when even then 190 else 140 end g, case when flat then 90 when grid then 240 when even then 210 else 160 end r
        from (select *, (sx//200+sy//200)%3=0 flat, sx%12=0 or sy%12=0 grid, (sx//6+sy//6)%2=0 even from points)),
    told as materialized (select video_id, frame_index, face_idx, count(*) samples, cast(sum(sk) as bigint) skin, cast(count(*) filter (abs(l-rt)>20)+count(*) filter (abs(l-dn)>20) as bigint) edges, count(rt)+count(dn) es, var_samp(l) v from
        (select *, lead(l) over (partition by video_id, frame_index, face_idx, y order by x) rt, lead(l) over (partition by video_id, frame_index, face_idx, x order by y) dn from
        (select *, (77*r+150*g+29*b)>>8 l, cast(128+floor((-43*r-85*g+128*b)/256.0) between 77 and 127 and 128+floor((128*r-107*g-21*b)/256.0) between 133 and 173 as int) sk from shades)) group by all),
    stats as materialized (select f.video_id, f.frame_index, f.face_idx, samples, skin, edges, round(v, 6) variance, coalesce(samples>=20 and skin/samples>=0.015 and edges/greatest(1,es)>=0.02 and v>=200, false) passed from face f left join told using (video_id, frame_index, face_idx))"""
sql("frame_face_stats", "select * from stats", *DET, recursive=_STATS)


@query
def faces_by_stats(spark, d):
    """Faces that pass by area, aspect and the statistics of their frame's own pixels, or by their confidence."""
    det = tables.detections(spark, d)
    return detect.filter_faces(det, pictures.face_stats(det, pictures.scene_reader(W, H)), W, H).select("video_id", "frame_index", "face_idx")


sql("faces_by_stats", "select video_id, frame_index, face_idx from detections join stats using (video_id, frame_index, face_idx) where w*h >= 0.001*1280*720 and w/h between 0.5 and 2.0 and (conf >= cast(0.85 as float) or passed)", *DET, recursive=_STATS)


# Whole pictures of all frames, at a sixteenth of the size.

_PICTURES = """pics as materialized (select i, j, x, y, case when grid then 140 when even then 120 else 90 end b, case when grid then 220 when even then 190 else 140 end g, case when grid then 240 when even then 210 else 160 end r from
    (select *, px%12=0 or py%12=0 grid, (px//6+py//6)%2=0 even from (select *, (x-i+80)%80 px, (y-j+45)%45 py from (select unnest(range(80)) x) a cross join (select unnest(range(45)) y) c cross join (select unnest(range(12)) i) s cross join (select unnest(range(12)) j) t)))"""
_BLURRED = """across as (select i, j, x, y, """ + ", ".join(f"sum({c}) over w + greatest(0, 6-x)*first({c}) over e + greatest(0, x-73)*last({c}) over e {c}" for c in "bgr") + """ from pics window w as (partition by i, j, y order by x range between 6 preceding and 6 following), e as (partition by i, j, y order by x rows between unbounded preceding and unbounded following)),
    lines as (select i, j, x, y, b//13 b, g//13 g, r//13 r from across),
    blurs as materialized (select i, j, x, y, """ + ", ".join(f"cast((sum({c}) over w + greatest(0, 6-y)*first({c}) over e + greatest(0, y-38)*last({c}) over e)//13 as int) {c}" for c in "bgr") + """ from lines window w as (partition by i, j, x order by y range between 6 preceding and 6 following), e as (partition by i, j, x order by y rows between unbounded preceding and unbounded following))"""


def small_reader():
    return rasters.pattern_reader(PW, PH)


def channel_sums(picture):
    return tuple(int(v) for v in picture.reshape(-1, 4).sum(axis=0, dtype="int64")[:3])


@query
def box_blur_separable(spark, d):
    """Every frame blurred across, then down: sums of its channels."""
    worker = lambda p: channel_sums(pictures.separable_blur(p, 6))
    return pictures.over_frames(tables.frame_spine(spark, d), small_reader(), worker, "b bigint, g bigint, r bigint")


sql("box_blur_separable", "select video_id, frame_index, b, g, r from spine join (select i, j, cast(sum(b) as bigint) b, cast(sum(g) as bigint) g, cast(sum(r) as bigint) r from blurs group by all) on i=(video_id+frame_index)%12 and j=frame_index%12", "video_meta", "spine", recursive=f"{_PICTURES}, {_BLURRED}")


@query
def alpha_blend(spark, d):
    """The preview of every frame with faces, its blurred form blended by its mask: sums of its channels."""
    return pictures.blended_sums(proxy_faces(spark, d), F.lit(PW), F.lit(PH), small_reader(), 6)


sql("alpha_blend", "select f.video_id, f.frame_index, " + ", ".join(f"cast(w.{c}+f.{c} as bigint) {c}" for c in "bgr") + " from (select video_id, frame_index, " + ", ".join(f"sum((n.{c}*alpha+p.{c}*(255-alpha)+127)//255-p.{c}) {c}" for c in "bgr") + """ from raster m join pics p on p.x=m.x and p.y=m.y and p.i=(video_id+frame_index)%12 and p.j=frame_index%12
    join blurs n on n.x=m.x and n.y=m.y and n.i=p.i and n.j=p.j group by all) f join (select i, j, sum(b) b, sum(g) g, sum(r) r from pics group by all) w on w.i=(video_id+frame_index)%12 and w.j=frame_index%12""", *DET, recursive=f"{_RASTER}, {_PICTURES}, {_BLURRED}")


@query
def downscale_nearest(spark, d):
    """Every frame at two fifths, the nearest pixels: sums of its planes of shares of 255."""
    worker = lambda p: tuple(float(round(v, 2)) for v in pictures.nearest(p, 0.4).sum(axis=(1, 2), dtype=float))
    return pictures.over_frames(tables.frame_spine(spark, d), small_reader(), worker, "b double, g double, r double")


_SCALED = " from spine join small on i=(video_id+frame_index)%12 and j=frame_index%12"
sql("downscale_nearest", f"select video_id, frame_index, b, g, r{_SCALED}", "video_meta", "spine", recursive=_PICTURES + ", small as (select i, j, " + ", ".join(f"round(sum({c})/255.0::double, 2) {c}" for c in "bgr") + " from (select unnest(range(32)) tx) a cross join (select unnest(range(18)) ty) c join pics on x=trunc(tx*(1/0.4::double)) and y=trunc(ty*(1/0.4::double)) group by all)")


@query
def downscale_bilinear(spark, d):
    """Every frame at two fifths, four pixels mixed: sums of its planes of shares of 255."""
    worker = lambda p: tuple(float(round(v, 2)) for v in pictures.bilinear(p, 0.4).sum(axis=(1, 2), dtype=float))
    return pictures.over_frames(tables.frame_spine(spark, d), small_reader(), worker, "b double, g double, r double")


sql("downscale_bilinear", f"select video_id, frame_index, b, g, r{_SCALED}", "video_meta", "spine", recursive=_PICTURES + ", small as (select i, j, " + ", ".join(f"round(sum({c}*wx*wy)/255.0::double, 2) {c}" for c in "bgr") + """ from (select case a when 0 then lx else least(79, lx+1) end x, case o when 0 then ly else least(44, ly+1) end y, case a when 0 then 1-(qx-lx) else qx-lx end wx, case o when 0 then 1-(qy-ly) else qy-ly end wy
    from (select tx*(1/0.4::double) qx, ty*(1/0.4::double) qy, least(79, cast(floor(tx*(1/0.4::double)) as int)) lx, least(44, cast(floor(ty*(1/0.4::double)) as int)) ly from (select unnest(range(32)) tx) f cross join (select unnest(range(18)) ty) g)
    cross join (select unnest([0,1]) a) h cross join (select unnest([0,1]) o) k) q join pics p using (x, y) group by all)""")


# Edited masks and their previews, in tiles.

TW, TH = 120, 90


def edit_log(spark, d):
    """Every event is a stroke, or an undo, on a mask of twenty frames."""
    e = tables.video_of(tables.events(spark, d).select("event_id", "user_id")).withColumn("frame_index", F.expr("frame_index div 20"))
    at = e.select("video_id", "frame_index", F.col("event_id").alias("seq"), (F.col("event_id") * 11 % 7 > 3).alias("undo"), (F.col("event_id") * 7 % 130).cast("int").alias("cx"), (F.col("event_id") * 5 % 97).cast("int").alias("cy"), (2 + F.col("event_id") % 4).cast("int").alias("radius"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(255).alias("value"), "user_id")
    return at.withColumns({"tx": (F.col("cx") + F.col("seq") % 23 - 11).cast("int"), "ty": (F.col("cy") + F.col("user_id") % 17 - 8).cast("int")}).drop("user_id")


_STROKES = """acts as materialized (select event_id%8 video_id, event_id//8//20 frame_index, event_id seq, event_id*11%7>3 undo, row_number() over w i, lead(event_id) over w is null last from events window w as (partition by event_id%8, event_id//8//20 order by event_id)),
    st as (select video_id, frame_index, i, last, case when undo then [] else [seq] end s from acts where i=1 union all select a.video_id, a.frame_index, a.i, a.last, case when undo then st.s[1:len(st.s)-1] else list_append(st.s, a.seq) end from st join acts a on a.video_id=st.video_id and a.frame_index=st.frame_index and a.i=st.i+1),
    live as materialized (select video_id, frame_index, unnest(s) seq from st where last),
    stroke as materialized (select event_id%8 video_id, event_id//8//20 frame_index, event_id seq, event_id*7%130 fx, event_id*5%97 fy, event_id*7%130+event_id%23-11 ex, event_id*5%97+user_id%17-8 ey, 2+event_id%4 r, case when event_id%3=0 then 0 else 255 end v from events where event_id*11%7<=3),
    sized as materialized (select *, greatest(1, ceil(sqrt(cast((ex-fx)*(ex-fx)+(ey-fy)*(ey-fy) as double))/greatest(1.0::double, r*0.5::double)))::int steps from stroke),
    stamp as (select video_id, frame_index, seq, r, v, 0 i, steps, cast(fx as double) x, cast(fy as double) y, cast(ex-fx as double)/steps sx, cast(ey-fy as double)/steps sy from sized
        union all select video_id, frame_index, seq, r, v, i+1, steps, x+sx, y+sy, sx, sy from stamp where i<steps),
    drawn as materialized (select video_id, frame_index, x, y, seq, v from (select *, cx+ox x, cy+oy y from (select *, unnest(range(-r, r+1)) oy from (select *, unnest(range(-r, r+1)) ox from
        (select distinct video_id, frame_index, seq, r, v, cast(round_even(x,0) as bigint) cx, cast(round_even(y,0) as bigint) cy from stamp) where cx between 0 and 119 and cy between 0 and 89)))
        where ox*ox+oy*oy<=r*r and x between 0 and 119 and y between 0 and 89),
    lit as materialized (select video_id, frame_index, x, y from (select video_id, frame_index, x, y, arg_max(v, seq) v from drawn semi join live using (video_id, frame_index, seq) group by all) where v=255)"""


@query
def undo_masks(spark, d):
    """Masks after all strokes and undos, from the versions of their tiles: lit pixels and where they are."""

    def places(tx, ty, alpha):
        shown = np.frombuffer(alpha, np.uint8).reshape(min(tilestore.TILE, TH - ty * tilestore.TILE), -1)
        ys, xs = np.nonzero(shown == 255)
        return int(len(xs)), int(xs.sum() + len(xs) * tx * tilestore.TILE), int(ys.sum() + len(ys) * ty * tilestore.TILE)

    def run(batches):
        for batch in batches:
            rows = [(v, f, *places(tx, ty, a)) for v, f, tx, ty, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield rasters._batch(rows, "video_id bigint, frame_index bigint, lit bigint, x bigint, y bigint")

    stored = tilestore.versions(tilestore.tiled(tilestore.ended(edit_log(spark, d)), TW, TH), TW, TH)
    told = tilestore.current(stored).mapInArrow(run, "video_id bigint, frame_index bigint, lit bigint, x bigint, y bigint")
    return told.groupBy("video_id", "frame_index").agg(*(F.sum(c).alias(c) for c in ("lit", "x", "y"))).where("lit > 0")


sql("undo_masks", "select video_id, frame_index, count(*) lit, cast(sum(x) as bigint) x, cast(sum(y) as bigint) y from lit group by all", recursive=_STROKES)


@query
def preview_tiles(spark, d):
    """Previews of the masks after three quarters of all events, brought up to date by the rest: composed anew only where tiles have changed."""
    log = edit_log(spark, d)
    border = (log.agg(F.max("seq")).first()[0] or 0) * 3 // 4
    folder, reader = shared.fresh_dir(spark, "previews"), rasters.pattern_reader(TW, TH)
    # The store is a table: what is drawn once is read from then on.
    tilestore.versions(tilestore.tiled(tilestore.ended(log.where(F.col("seq") <= border)), TW, TH), TW, TH).write.parquet(f"{folder}/store")
    first = spark.read.schema(tilestore.VERSIONS).parquet(f"{folder}/store")
    touched = first.select(*tilestore.TILES).distinct()
    tilestore.write_previews(f"{folder}/previews", tilestore.composed(touched.join(tilestore.current(first), list(tilestore.TILES), "left"), TW, TH, reader, 6))
    second, changed = tilestore.extended(first, log, TW, TH)
    tilestore.refresh_previews(spark, f"{folder}/previews", tilestore.current(second), changed, TW, TH, reader, 6)
    shown = tilestore.read_previews(spark, f"{folder}/previews").select("video_id", "frame_index", rasters.byte_sum(F.col("pixels")).alias("sum"))
    return shown.groupBy("video_id", "frame_index").agg(F.count("*").alias("tiles"), F.sum("sum").alias("sum"))


sql("preview_tiles", """select t.video_id, t.frame_index, tiles, cast(plain+coalesce(more, 0) as bigint) sum from
    (select video_id, frame_index, count(distinct (tx, ty)) tiles, sum(b+g+r+255) plain from (select distinct video_id, frame_index, x//30 tx, y//30 ty from drawn) q join pics p on p.i=(q.video_id+q.frame_index)%12 and p.j=q.frame_index%12 and p.x//30=tx and p.y//30=ty group by all) t left join
    (select video_id, frame_index, sum(n.b+n.g+n.r-p.b-p.g-p.r) more from lit l join pics p on p.x=l.x and p.y=l.y and p.i=(video_id+frame_index)%12 and p.j=frame_index%12 join blurs n on n.x=p.x and n.y=p.y and n.i=p.i and n.j=p.j group by all) m using (video_id, frame_index)""",
    recursive=f"{_STROKES}, " + f"{_PICTURES}, {_BLURRED}".replace("x-i+80)%80", "x-i+120)%120").replace("y-j+45)%45", "y-j+90)%90").replace("range(80)", "range(120)").replace("range(45)", "range(90)").replace("x-73", "x-113").replace("y-38", "y-83"))


# Detection over videos in order.


def loop_frames(spark, d):
    det = tables.detections(spark, d)
    stored = det.where("stored").select("video_id", "frame_index").distinct().withColumn("stored", F.lit(True))
    spine = tables.frame_spine(spark, d).select("video_id", "frame_index")
    return spine.join(faces_by_frame(det), ["video_id", "frame_index"], "left").join(stored, ["video_id", "frame_index"], "left")


def looped(spark, d):
    return tracking.detection_loop(loop_frames(spark, d), W, H, 4, tracking.sometimes_blind, pictures.scene_reader(W, H))


@query
def detection_loop(spark, d):
    """Every frame's detection: looked at or not, the region tried, calls of the detector, the faces that are held and where they are from."""
    faces = F.aggregate("faces", F.lit(0.0), lambda total, f: total + f["x"] + 3 * f["y"])
    return looped(spark, d).select("video_id", "frame_index", "detected", "attempt", "hit", "calls", F.rint("area").cast("bigint").alias("area"), "held_from", F.size("faces").alias("faces"), faces.alias("places"))


_FACE_LIST = "list({'x': x, 'y': y, 'w': w, 'h': h, 'ok': ok} order by face_idx)"
_LOOP = _STATS + f""", known as materialized (select s.video_id, s.frame_index, bool_or(coalesce(stored, false)) held_mask, coalesce({_FACE_LIST} filter (x is not null), []) known from spine s left join
    (select *, w*h >= 0.001*1280*720 and w/h between 0.5 and 2.0 and (conf >= cast(0.85 as float) or passed) ok from detections join stats using (video_id, frame_index, face_idx)) using (video_id, frame_index) group by all),
    looped as (select video_id, cast(-1 as bigint) frame_index, false detected, false attempt, false hit, cast(null as double) area, cast(null as bigint) held, cast(null as bigint) held_from, cast(null as struct(x double, y double, w double, h double, ok boolean)[]) as last, cast([] as struct(x double, y double, w double, h double, ok boolean)[]) faces from video_meta union all
    select video_id, frame_index, look, coalesce(usable, false), coalesce(hit, false), case when usable then (c-a)*(g-e) end, case when look then case when len(kept)>0 then frame_index end else held end,
        case when held_mask then null when look then case when len(kept)>0 then frame_index end else held end, case when look then case when len(kept)>0 then kept end else last end, case when held_mask then [] when look then kept else coalesce(last, []) end from
    (select *, list_filter(case when hit then inside else known end, lambda f: f.ok) kept from (select *, usable and len(inside)>0 hit from
    (select *, case when not usable or (frame_index%7=3 and (floor(a)>0 or floor(e)>0)) then [] else list_filter(known, lambda f: f.x+f.w/2>=floor(a) and f.x+f.w/2<least(1280, floor(a)+ceil(c-a)) and f.y+f.h/2>=floor(e) and f.y+f.h/2<least(720, floor(e)+ceil(g-e))) end inside from
    (select *, coalesce(look and last is not null and c-a>=64 and g-e>=64 and not (c-a>=1280*0.9::double and g-e>=720*0.9::double), false) usable from (select *, {_sides('x0', 'x1', 1280, 'a', 'c')}, {_sides('y0', 'y1', 720, 'e', 'g')} from
    (select *, list_min(list_transform(last, lambda f: f.x)) x0, list_max(list_transform(last, lambda f: f.x+f.w)) x1, list_min(list_transform(last, lambda f: f.y)) y0, list_max(list_transform(last, lambda f: f.y+f.h)) y1 from
    (select k.*, h.last, h.held, not k.held_mask and (k.frame_index%4=0 or h.last is null) look from looped h join known k on k.video_id=h.video_id and k.frame_index=h.frame_index+1)))))))),
    steps as (select *, cast(case when not detected then 0 when attempt and not hit then 2 else 1 end as int) calls from looped where frame_index >= 0)"""
sql("detection_loop", "select video_id, frame_index, detected, attempt, hit, calls, cast(round_even(area, 0) as bigint) area, held_from, cast(len(faces) as int) faces, coalesce(list_sum(list_transform(faces, lambda f: f.x+3*f.y)), 0.0::double) places from steps", *DET, "video_meta", "spine", recursive=_LOOP)


@query
def detector_calls(spark, d):
    """By video: calls of the detector, regions tried, hits, searches of whole frames, mean area tried."""
    return tracking.call_summary(looped(spark, d))


sql("detector_calls", "select video_id, cast(sum(calls) as bigint) calls, count(*) filter (attempt) attempts, count(*) filter (hit) hits, count(*) filter (detected and not hit) fallbacks, case when count(*) filter (attempt)>0 then round_even(sum(round_even(area, 0))/count(*) filter (attempt), 0) else 0.0::double end avg_area from steps group by video_id", *DET, "video_meta", "spine", recursive=_LOOP)


# Single frames, logs and state documents.


@query
def nth_frame(spark, d):
    """The fourth frame of each video by time stamp."""
    return lookups.nth_frame(tables.frame_pts(spark, d), 3)


sql("nth_frame", "select video_id, frame_no, pts from (select *, row_number() over (partition by video_id order by pts) r from frame_pts) where r = 4", "frame_pts")


@query
def analysis_rows(spark, d):
    """Per frame the time, whether it has a face, and the first face's box."""
    return detect.analysis_rows(tables.frame_spine(spark, d), faces_by_frame(tables.detections(spark, d)))


sql("analysis_rows", "select s.video_id, s.frame_index, s.frame_index/s.fps as time_s, f.x is not null has_face, case when f.x is null then 0.0::double else 1.0::double end confidence, f.x, f.y, f.w, f.h from spine s left join (select * from detections where face_idx=0) f using (video_id, frame_index)", *DET, "video_meta", "spine")


@query
def overlays(spark, d):
    """Frames whose boxes are drawn: the overlay is on (not on every fifth frame) and there is a box."""
    return detect.overlays(faces_by_frame(tables.detections(spark, d)).withColumn("overlay", F.col("frame_index") % 5 > 0)).select("video_id", "frame_index")


sql("overlays", "select distinct video_id, frame_index from detections where frame_index%5>0", *DET)


@query
def perf_sums(spark, d):
    """Calls and milliseconds of each video's stages, in lots of 60 frames."""
    e = tables.video_of(tables.events(spark, d).select("event_id")).select("video_id", "frame_index", (F.col("event_id") * 7 % 23).alias("decode_ms"), (F.col("event_id") * 11 % 37).alias("detect_ms"))
    return export.perf_sums(e, ["decode_ms", "detect_ms"])


sql("perf_sums", "select event_id%8 video_id, event_id//8//60 lot, count(*) calls, cast(sum(event_id*7%23) as bigint) decode_ms, cast(sum(event_id*11%37) as bigint) detect_ms, cast(sum(event_id*7%23+event_id*11%37) as bigint) total_ms from events group by all")


@query
def dirty_rects(spark, d):
    """What has to be drawn anew in each frame: the box of all its strokes, within 1280 x 720."""
    e = tables.video_of(tables.events(spark, d).select("event_id")).select("video_id", F.expr("frame_index div 10").alias("frame_index"), (F.col("event_id") * 7 % 1300 - 10).cast("int").alias("cx"), (F.col("event_id") * 5 % 740 - 10).cast("int").alias("cy"), (2 + F.col("event_id") % 9).cast("int").alias("radius"))
    return masks.dirty_rects(e, W, H)


sql("dirty_rects", "select * from (select event_id%8 video_id, event_id//8//10 frame_index, greatest(0, min(cx-r)) x0, greatest(0, min(cy-r)) y0, least(1280, max(cx+r+1)) x1, least(720, max(cy+r+1)) y1 from (select event_id, cast(event_id*7%1300-10 as int) cx, cast(event_id*5%740-10 as int) cy, cast(2+event_id%9 as int) r from events) group by all) where x0<x1 and y0<y1")


@query
def edits_persisted(spark, d):
    """Frames whose edits were not all taken back become stored masks."""
    a = tables.video_of(tables.events(spark, d).select("event_id")).select("video_id", F.expr("frame_index div 3").alias("frame_index"), F.col("event_id").alias("seq"), (F.col("event_id") * 11 % 7 > 3).alias("undo"))
    return masks.persisted_edits(masks.not_undone(a).withColumn("dirty", F.lit(True)))


sql("edits_persisted", "select video_id, frame_index, s[len(s)] seq, 'mask' op from st where last and len(s)>0", recursive="""acts as materialized (select event_id%8 video_id, event_id//8//3 frame_index, event_id seq, event_id*11%7>3 undo, row_number() over (partition by event_id%8, event_id//8//3 order by event_id) i, lead(event_id) over (partition by event_id%8, event_id//8//3 order by event_id) is null last from events),
    st as (select video_id, frame_index, i, last, case when undo then [] else [seq] end s from acts where i=1 union all select a.video_id, a.frame_index, a.i, a.last, case when undo then st.s[1:len(st.s)-1] else list_append(st.s, a.seq) end from st join acts a on a.video_id=st.video_id and a.frame_index=st.frame_index and a.i=st.i+1)""")  # fmt: skip


@query
def state_documents(spark, d):
    """The state written as one JSON document by path and read back: workspaces and masks of each."""
    written = tables.to_state(saved_workspaces(spark, d))
    back = written.select("path", F.from_json("document", tables.STATE_SCHEMA).alias("s"))
    return back.select("path", F.explode("s.Workspaces").alias("w")).select("path", F.col("w.Mode").alias("mode"), F.size("w.MaskIndices").cast("bigint").alias("masks"))


sql("state_documents", "select path, mode, count(*) masks from idx group by all", "opens", recursive=_WS)


@query
def opened_texts(spark, d):
    return tables.events(spark, d).select("event_id", V.opened_text(F.col("ts")).alias("opened"))


sql("opened_texts", "select event_id, 'Last opened: ' || strftime(ts, '%Y-%m-%d %H:%M') opened from events")


@query
def workspace_masks(spark, d):
    """Every frame's mask saved as a picture of its video's workspace, with the state document, and both read back: masks and their sums."""
    made = rasters.over_frames_with_faces(proxy_faces(spark, d), F.lit(PW), F.lit(PH), whole_mask, "alpha binary")
    mode = F.when(F.col("frame_index") % 2 == 0, "Auto").otherwise("Manual")
    rows = made.select(F.concat(F.lit("/v/Clip"), "video_id", F.lit(".mp4")).alias("path"), mode.alias("mode"), "frame_index", F.lit(PW).alias("width"), F.lit(PH).alias("height"), "alpha", F.to_json(F.struct(F.lit(7).alias("SelectedFrameIndex"), F.lit(True).alias("AutoCompleted"))).alias("snapshot"))
    root = shared.fresh_dir(spark, "workspaces")
    workspaces.save(rows, root)
    spaces, named, found = workspaces.opened(spark, root)
    counts = named.groupBy("path", "mode").agg(F.count("*").alias("listed"))
    sums = found.select("path", "mode", rasters.byte_sum(F.col("alpha")).alias("alpha")).groupBy("path", "mode").agg(F.count("*").alias("masks"), F.sum("alpha").alias("alpha"))
    listed = spaces.select(F.col("VideoPath").alias("path"), F.col("Mode").alias("mode"), F.col("SelectedFrameIndex").alias("selected"), F.col("AutoCompleted").alias("completed"))
    return listed.join(counts, ["path", "mode"]).join(sums, ["path", "mode"])


def whole_mask(video, frame, wide, high, boxes, box, alpha):
    """The mask of a frame in the frame's size."""
    x0, y0, x1, y1 = box
    out = np.zeros((high, wide), np.uint8)
    out[y0:y1, x0:x1] = alpha
    return (out.tobytes(),)


sql("workspace_masks", "select '/v/Clip' || video_id || '.mp4' path, case when frame_index%2=0 then 'Auto' else 'Manual' end as mode, 7 selected, true completed, count(*) listed, count(*) masks, cast(sum(a) as bigint) alpha from (select video_id, frame_index, sum(alpha) a from raster group by all) group by 1, 2", *DET, recursive=_RASTER)


@query
def single_frame_detection(spark, d):
    """Frame 17 of every video, read by the pushed condition alone, and what the detector finds there."""
    videos = [(r["video_id"], r["total_frames"], PW, PH) for r in tables.video_meta(spark, d).toLocalIterator()]
    one = frames.read_frames(spark, videos, "veilgrid.operators.rasters.pattern_reader").where("frame_index = 17")
    sums = one.select("video_id", "frame_index", "made", rasters.byte_sum(F.col("picture")).alias("picture"))
    return sums.join(detect.detect(one.select("video_id", "frame_index"), detect.stub_detector, detect.STUB_SCHEMA), ["video_id", "frame_index"], "left")


sql("single_frame_detection", "select video_id, frame_index, cast(1 as bigint) made, cast(b+g+r+255*3600 as bigint) picture, cast(frame_index*7%1000 as double) x, cast(frame_index*3%500 as double) y, 96.0::double w, 128.0::double h, cast(cast(50+frame_index%50 as double)/100 as float) conf from spine join (select i, j, sum(b) b, sum(g) g, sum(r) r from pics group by all) on i=(video_id+frame_index)%12 and j=frame_index%12 where frame_index=17", "video_meta", "spine", recursive=_PICTURES)


@query
def stub_detection(spark, d):
    """Detection by a plug-in on every frame: the built-in stub, a face that wanders with the frame number."""
    return detect.detect(tables.frame_spine(spark, d).select("video_id", "frame_index"), detect.stub_detector, detect.STUB_SCHEMA)


sql("stub_detection", "select video_id, frame_index, cast(frame_index*7%1000 as double) x, cast(frame_index*3%500 as double) y, 96.0::double w, 128.0::double h, cast(cast(50+frame_index%50 as double)/100 as float) conf from spine where frame_index%9<>4", "video_meta", "spine")


@query
def masked_export(spark, d):
    """The test picture in every frame, faces blurred and blended: changed pixels and sums of their channels by frame."""
    done = rasters.export(proxy_faces(spark, d), F.lit(PW), F.lit(PH), 6, rasters.pattern_reader(PW, PH, moving=False), with_pixels=False)
    return done.where("changed > 0").select("video_id", "frame_index", "changed", *"bgr")


_RADII = """radii as materialized (select video_id, frame_index, px x, py y, max(rd) rd from (select *, unnest(range(y0, y1)) py from (select *, unnest(range(x0, x1)) px from (select video_id, frame_index,
    cast(greatest(1, least(6, round_even(6*case when a<=1 then 0.4::double when a<=3 then 0.55::double when a<=5 then 0.7::double else 1.0::double end,0))) as int) rd, floor(greatest(0,x-px))::int x0, ceil(least(80,x+w+px))::int x1, floor(greatest(0,y-py))::int y0, ceil(least(45,y+h+py))::int y1
    from (select *, w*h*100.0::double/3600 a, greatest(6.0::double,w*0.15::double) px, greatest(6.0::double,h*0.25::double) py from (select video_id, frame_index, x/16 x, y/16 y, w/16 w, h/16 h from detections))))) group by all)"""
_SHOWN = """shown as materialized (select x, y, case when x%12=0 or y%12=0 then 140 when (x//6+y//6)%2=0 then 120 else 90 end b, case when x%12=0 or y%12=0 then 220 when (x//6+y//6)%2=0 then 190 else 140 end g,
    case when x%12=0 or y%12=0 then 240 when (x//6+y//6)%2=0 then 210 else 160 end r from (select unnest(range(80)) x) a cross join (select unnest(range(45)) y) c)"""
_BLURS = ", ".join(f"""lines{k} as (select x, y, sum(b) over w b, sum(g) over w g, sum(r) over w r, count(*) over w n from shown window w as (partition by y order by x range between {k} preceding and {k} following)),
    box{k} as (select x, y, {k} rd, cast(sum(b) over v//sum(n) over v as int) nb, cast(sum(g) over v//sum(n) over v as int) ng, cast(sum(r) over v//sum(n) over v as int) nr from lines{k} window v as (partition by x order by y range between {k} preceding and {k} following))""" for k in (2, 3, 4, 6))
sql("masked_export", "select video_id, frame_index, count(*) changed, " + ", ".join(f"cast(sum(case smooth when 255 then n{c} else (n{c}*smooth+{c}*(255-smooth)+127)//255 end) as bigint) {c}" for c in "bgr") + " from (select f.*, coalesce(q.rd, 6) rd from faded f left join radii q using (video_id, frame_index, x, y) where smooth > 0) z join blurred using (x, y, rd) join shown using (x, y) group by all", *DET, recursive=_RASTER + f""",
    boxes as (select video_id, frame_index, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from raster group by all), inside as materialized (select b.video_id, b.frame_index, b.x, b.y, coalesce(r.alpha, 0) alpha from (select *, unnest(range(y0, y1+1)) y from (select *, unnest(range(x0, x1+1)) x from boxes)) b left join raster r using (video_id, frame_index, x, y)),
    faded as materialized (select video_id, frame_index, x, y, {_fade(18)} smooth from inside window w as (partition by video_id, x, y order by frame_index)), {_RADII}, {_SHOWN}, {_BLURS}, blurred as materialized (select * from box2 union all select * from box3 union all select * from box4 union all select * from box6)""")


@query
def masked_export_full(spark, d):
    """Every frame with faces at 1280 x 720, a moving test picture: the box that changes, changed pixels, sums of the four channels.

    No SQL: a row a pixel is too much for it at this size. ``masked_export`` is the same at a sixteenth, with SQL.
    """
    return rasters.export(tables.detections(spark, d), F.lit(W), F.lit(H), 24, rasters.pattern_reader(W, H), with_pixels=False)
