"""DuckDB SQL for the registered queries over the derived tables."""

from __future__ import annotations

import re

from trackmend.config import Config
from trackmend.plans.fixtures import CHAIN, CONFIG, PREFIX

C = CONFIG


def area(p: str = "") -> str:
    return f"(greatest(0.0, {p}x2 - {p}x1) * greatest(0.0, {p}y2 - {p}y1))"


def cx(p: str = "") -> str:
    return f"(({p}x1 + {p}x2) / 2)"


def cy(p: str = "") -> str:
    return f"(({p}y1 + {p}y2) / 2)"


def dist(p: str, q: str) -> str:
    return f"sqrt(({cx(p)} - {cx(q)}) * ({cx(p)} - {cx(q)}) + ({cy(p)} - {cy(q)}) * ({cy(p)} - {cy(q)}))"


def diag(p: str = "") -> str:
    return f"sqrt(({p}x2 - {p}x1) * ({p}x2 - {p}x1) + ({p}y2 - {p}y1) * ({p}y2 - {p}y1))"


def aspect(p: str = "") -> str:
    w, h = f"greatest({p}x2 - {p}x1, 1e-6)", f"greatest({p}y2 - {p}y1, 1e-6)"
    return f"(greatest({w}, {h}) / least({w}, {h}))"


def common(p: str, q: str) -> str:
    return f"(greatest(0.0, least({p}x2, {q}x2) - greatest({p}x1, {q}x1)) * greatest(0.0, least({p}y2, {q}y2) - greatest({p}y1, {q}y1)))"


def overlap(p: str, q: str) -> str:
    return f"(CASE WHEN {common(p, q)} <= 0 OR least({area(p)}, {area(q)}) <= 0 THEN 0.0 ELSE {common(p, q)} / least({area(p)}, {area(q)}) END)"


def iou(p: str, q: str) -> str:
    union = f"({area(p)} + {area(q)} - {common(p, q)})"
    return f"(CASE WHEN {common(p, q)} <= 0 OR {union} <= 0 THEN 0.0 ELSE {common(p, q)} / {union} END)"


def wrap(d: str) -> str:
    return f"((({d}) + 180) - 360 * floor((({d}) + 180) / 360) - 180)"


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


PAIRS = f"pairs AS (SELECT a.cid, a.frame, a.det_id AS det_a, b.det_id AS det_b FROM fx_detections a JOIN fx_detections b ON a.cid = b.cid AND a.frame = b.frame AND a.det_id < b.det_id WHERE {overlap('a.', 'b.')} >= {C.duplicate_overlap_threshold})"


def merged(where: str = "true", boxes: str = "fx_detections") -> str:
    """CTEs up to ``cand``, the merged candidates of the boxes that ``where`` lets through."""
    return f"""
src AS (SELECT * FROM {boxes} WHERE {where}),
pr AS (SELECT a.cid, a.frame, a.det_id AS a, b.det_id AS b FROM src a JOIN src b ON a.cid = b.cid AND a.frame = b.frame AND a.det_id <> b.det_id WHERE {overlap("a.", "b.")} >= {C.duplicate_overlap_threshold}),
reach AS (SELECT cid, frame, det_id AS a, det_id AS b FROM src UNION SELECT r.cid, r.frame, r.a, p.b FROM reach r JOIN pr p ON r.cid = p.cid AND r.frame = p.frame AND r.b = p.a),
comp AS (SELECT cid, frame, a AS det_id, min(b) AS first FROM reach GROUP BY 1, 2, 3),
mem AS (SELECT s.*, c.first, row_number() OVER (PARTITION BY s.cid, s.frame, c.first ORDER BY s.confidence DESC, s.det_id) AS rk, count(*) OVER (PARTITION BY s.cid, s.frame, c.first) AS n FROM src s JOIN comp c USING (cid, frame, det_id)),
ids AS (SELECT cid, frame, first, list(det_id ORDER BY det_id) AS source_ids FROM mem GROUP BY 1, 2, 3),
cand AS (SELECT m.cid, m.frame, CAST(row_number() OVER (PARTITION BY m.cid, m.frame ORDER BY m.first) - 1 AS BIGINT) AS cand_idx, x1, y1, x2, y2, confidence, i.source_ids, n > 1 AS was_merged
         FROM mem m JOIN ids i ON m.cid = i.cid AND m.frame = i.frame AND m.first = i.first WHERE rk = 1)"""


GEO = f"""geo AS (SELECT *, CASE WHEN {area()} < {C.min_area_px2} OR {area()} > {C.max_area_px2} THEN 'size' WHEN {aspect()} > {C.max_aspect_ratio} THEN 'shape' END AS stage FROM cand)"""
RATE = f"""turn AS (SELECT *, coalesce({wrap("yaw - lag(yaw) OVER w")}, 0.0) AS dy, coalesce({wrap("pitch - lag(pitch) OVER w")}, 0.0) AS dp, coalesce({wrap("roll - lag(roll) OVER w")}, 0.0) AS dr FROM fx_vio WINDOW w AS (PARTITION BY cid ORDER BY idx)),
rate AS (SELECT cid, idx, speed, yaw, sqrt(dy * dy + dp * dp + dr * dr) AS ang_rate FROM turn),
lastpose AS (SELECT cid, max(idx) AS last FROM fx_vio GROUP BY 1)"""
MOVING = f"(speed > {C.camera_speed_moving_thresh} OR ang_rate > {C.camera_ang_moving_thresh_deg})"


def motion(source: str, name: str = "mot", key: str = "cid, track_id") -> str:
    return f"""
{name}0 AS (SELECT *, lag(frame) OVER w AS prev_frame, lag({cx()}) OVER w AS px, lag({cy()}) OVER w AS py FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY frame)),
{name} AS (SELECT *, frame - prev_frame AS elapsed, sqrt(({cx()} - px) * ({cx()} - px) + ({cy()} - py) * ({cy()} - py)) AS displacement,
  coalesce(({cx()} - px) / greatest(1, frame - prev_frame), 0.0) AS vx, coalesce(({cy()} - py) / greatest(1, frame - prev_frame), 0.0) AS vy FROM {name}0)"""


def gaps(source: str, config: Config = C, key: str = "cid, track_id") -> str:
    w = config.border_weights
    m, v = config.border_margin_px, config.outward_velocity_min_px_per_frame
    leaving = f"((x1 <= {m * w['left']} AND -vx >= {v}) OR (y1 <= {m * w['top']} AND -vy >= {v}) OR (1850 - x2 <= {m * w['right']} AND vx >= {v}) OR (1000 - y2 <= {m * w['bottom']} AND vy >= {v}))"
    ex, ey = f"({cx()} + vx * (gap + 1))", f"({cy()} + vy * (gap + 1))"
    near = f"sqrt(({cx('n_')} - {ex}) * ({cx('n_')} - {ex}) + ({cy('n_')} - {ey}) * ({cy('n_')} - {ey})) <= {config.resume_gate_px} + {config.max_speed_px_per_frame} * gap"
    return f"""{motion(source, "gm", key)},
gn AS (SELECT *, lead(frame) OVER w AS next_frame, lead(x1) OVER w AS n_x1, lead(y1) OVER w AS n_y1, lead(x2) OVER w AS n_x2, lead(y2) OVER w AS n_y2, lead(frame) OVER w - frame - 1 AS gap FROM gm WINDOW w AS (PARTITION BY {key} ORDER BY frame)),
gap AS (SELECT *, CASE WHEN gap > 0 THEN {leaving} END AS leaving, CASE WHEN gap > 0 THEN NOT {leaving} AND gap <= {config.max_dropout_frames} AND {near} END AS can_fill FROM gn)"""


SPLIT = """
brk AS (SELECT *, coalesce(lag(CASE WHEN gap > 0 AND NOT can_fill THEN 1 ELSE 0 END) OVER (PARTITION BY cid, track_id ORDER BY frame), 0) AS b FROM gap),
seq AS (SELECT *, sum(b) OVER (PARTITION BY cid ORDER BY track_ord, track_id, frame ROWS UNBOUNDED PRECEDING) AS s, sum(b) OVER (PARTITION BY cid, track_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS own, max(track_id) OVER (PARTITION BY cid) + 1 AS base FROM brk),
spl AS (SELECT *, CAST(CASE WHEN own = 0 THEN track_id ELSE base + s - 1 END AS BIGINT) AS out_id FROM seq)"""
FILL = """
fil AS (SELECT cid, frame + k AS frame, x1 + (n_x1 - x1) * (CAST(k AS DOUBLE) / (gap + 1)) AS x1, y1 + (n_y1 - y1) * (CAST(k AS DOUBLE) / (gap + 1)) AS y1, x2 + (n_x2 - x2) * (CAST(k AS DOUBLE) / (gap + 1)) AS x2, y2 + (n_y2 - y2) * (CAST(k AS DOUBLE) / (gap + 1)) AS y2, out_id AS track_id
        FROM (SELECT *, unnest(range(1, gap + 1)) AS k FROM spl WHERE gap > 0 AND can_fill) u)"""
FINAL = """
fin AS (SELECT cid, frame, x1, y1, x2, y2, CASE WHEN was_merged THEN 'merged' ELSE 'reported' END AS status, out_id AS track_id, det_id FROM spl
        UNION ALL SELECT cid, frame, x1, y1, x2, y2, 'interpolated', track_id, NULL FROM fil)"""
STABLE = "stable AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY cid, track_id) AS tn FROM fx_tracked) t WHERE tn >= 30)"
RANKED = """sup AS (SELECT *, count(*) OVER (PARTITION BY cid, track_id) AS n_frames, avg(confidence) OVER (PARTITION BY cid, track_id) AS mean_confidence FROM fx_tracked),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY cid, frame ORDER BY n_frames DESC, mean_confidence DESC, track_ord) AS BIGINT) AS track_rank FROM sup)"""
MULTI = "multi AS (SELECT cid, frame, CAST(count(*) AS BIGINT) AS n FROM fx_detections GROUP BY 1, 2 HAVING count(*) >= 3)"
BOX6 = ", ".join(r6(c, c) for c in ("x1", "y1", "x2", "y2"))


def q(ctes: str, select: str) -> str:
    return f"{PREFIX}{',' if ctes else ''} {ctes} {select}"


def pct(value: str, name: str, at: tuple[float, ...], where: str = "true") -> str:
    return ", ".join(f"round(quantile_cont({value}, {p / 100}) FILTER (WHERE {where}), 6) AS {f'{name}_p{p}'.replace('.', '_')}" for p in at)


def displaced(source: str, config: Config = C) -> str:
    return f"""
num AS (SELECT *, row_number() OVER (PARTITION BY cid, track_id ORDER BY frame) AS rn FROM {source}),
fold AS (
  SELECT cid, track_id, rn, frame, frame AS kf, {cx()} AS kx, {cy()} AS ky, false AS gone FROM num WHERE rn = 1
  UNION ALL
  SELECT n.cid, n.track_id, n.rn, n.frame, CASE WHEN g THEN kf ELSE n.frame END, CASE WHEN g THEN kx ELSE {cx("n.")} END, CASE WHEN g THEN ky ELSE {cy("n.")} END, g
  FROM (SELECT n.*, f.kf, f.kx, f.ky, sqrt(({cx("n.")} - f.kx) * ({cx("n.")} - f.kx) + ({cy("n.")} - f.ky) * ({cy("n.")} - f.ky)) / greatest(1, n.frame - f.kf) > {config.max_speed_px_per_frame} AS g
        FROM fold f JOIN num n ON n.cid = f.cid AND n.track_id = f.track_id AND n.rn = f.rn + 1) n
)"""


DISPLACED = displaced("fx_tracked")
_H = C.static_window_frames // 2
_STEP = f"sqrt(({cx()} - lag({cx()}) OVER w) * ({cx()} - lag({cx()}) OVER w) + ({cy()} - lag({cy()}) OVER w) * ({cy()} - lag({cy()}) OVER w))"


def static(source: str) -> str:
    """CTEs up to ``win``, whose rows are static where ``IS_STATIC`` holds."""
    return f"""{RATE},
lit AS (SELECT t.*, {MOVING} AS moving FROM {source} t JOIN lastpose l USING (cid) JOIN rate r ON r.cid = t.cid AND r.idx = greatest(0, least(t.frame, l.last))),
stp AS (SELECT *, {_STEP} / greatest(1, frame - lag(frame) OVER w) AS sp FROM lit WINDOW w AS (PARTITION BY cid, track_id ORDER BY frame)),
win AS (SELECT *, count(*) OVER a AS wn, max(frame) OVER a - min(frame) OVER a AS span, avg(sp) OVER p AS ms, avg(CASE WHEN sp IS NOT NULL THEN CASE WHEN moving THEN 1.0 ELSE 0.0 END END) OVER p AS mm, count(*) OVER (PARTITION BY cid, track_id) AS tn FROM stp
  WINDOW a AS (PARTITION BY cid, track_id ORDER BY frame ROWS BETWEEN {_H} PRECEDING AND {_H} FOLLOWING), p AS (PARTITION BY cid, track_id ORDER BY frame ROWS BETWEEN {_H - 1} PRECEDING AND {_H} FOLLOWING))"""


STATIC = static("fx_tracked")
IS_STATIC = f"tn >= 2 AND wn >= {max(3, _H)} AND span > 0 AND CAST(wn AS DOUBLE) / (span + 1) >= 0.5 AND ms < {C.static_motion_px_threshold} AND mm > 0.6"


def temporal(source: str, config: Config = C) -> str:
    """CTEs up to ``tmp``: the rows of ``source`` with the stage of the three rules for tracks as ``st2``."""
    return f"""{displaced(source, config)},
dsp AS (SELECT t.*, f.gone FROM {source} t JOIN fold f ON f.cid = t.cid AND f.track_id = t.track_id AND f.frame = t.frame),
uns AS (SELECT *, CASE WHEN gone THEN 'displacement' WHEN count(*) FILTER (WHERE NOT gone) OVER (PARTITION BY cid, track_id) < {config.min_track_len_supported} THEN 'unsupported' END AS st FROM dsp),
calm AS (SELECT * FROM uns WHERE st IS NULL),
{static("calm")},
tmp AS (SELECT u.*, CASE WHEN st IS NOT NULL THEN st WHEN w.cid IS NOT NULL THEN 'static' END AS st2 FROM uns u LEFT JOIN (SELECT cid, track_id, frame FROM win WHERE {IS_STATIC}) w ON w.cid = u.cid AND w.track_id = u.track_id AND w.frame = u.frame)"""


def lanes(source: str, n: str = "", boxes: str = "fx_detections", config: Config = CHAIN) -> str:
    """CTEs up to ``tk``: the candidates of ``source`` with the tracks and their order.  Lanes are cut where they are
    silent for too long; a displaced box is in a lane of its own.  ``n`` ends the names of the CTEs."""
    give_up = config.give_up_frames
    return f"""
lane{n} AS (SELECT c.*, d.lane * 2 + CASE WHEN d.kind = 2 THEN 1 ELSE 0 END AS lane FROM {source} c JOIN {boxes} d ON d.cid = c.cid AND d.det_id = c.source_ids[1]),
cut{n} AS (SELECT *, coalesce(sum(CASE WHEN frame - pf > {give_up} THEN 1 ELSE 0 END) OVER (PARTITION BY cid, lane ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS isl FROM (SELECT *, lag(frame) OVER (PARTITION BY cid, lane ORDER BY frame) AS pf FROM lane{n}) u),
trk{n} AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY ff, fi) - 1 AS track_id FROM (SELECT cid, lane, isl, min(frame) AS ff, max(frame) AS lf, arg_min(cand_idx, frame) AS fi FROM cut{n} GROUP BY 1, 2, 3) v),
ends{n} AS (SELECT t.cid, t.track_id, min(f.frame) AS stop FROM trk{n} t LEFT JOIN fx_frames f ON f.cid = t.cid AND f.frame > t.lf + {give_up} GROUP BY 1, 2),
ord{n} AS (SELECT cid, track_id, row_number() OVER (PARTITION BY cid ORDER BY stop NULLS LAST, track_id) - 1 AS track_ord FROM ends{n}),
tk{n} AS (SELECT c.cid, c.frame, c.cand_idx, c.x1, c.y1, c.x2, c.y2, c.confidence, c.source_ids, c.source_ids[1] AS det_id, c.was_merged, CAST(t.track_id AS BIGINT) AS track_id, CAST(o.track_ord AS BIGINT) AS track_ord
       FROM cut{n} c JOIN trk{n} t ON t.cid = c.cid AND t.lane = c.lane AND t.isl = c.isl JOIN ord{n} o ON o.cid = t.cid AND o.track_id = t.track_id)"""


def lane_tracks(boxes: str = "fx_detections", config: Config = CHAIN) -> str:
    """CTEs up to ``tk``: the boxes that pass the rules for single boxes, in their tracks."""
    return f"{merged(boxes=boxes)}, {GEO}, live0 AS (SELECT * FROM geo WHERE stage IS NULL), {lanes('live0', boxes=boxes, config=config)}"


def chained(boxes: str = "fx_detections", config: Config = CHAIN) -> str:
    """The whole correction: ``stg`` has every candidate with its stage, ``kept`` what is selected, ``out`` the output rows."""
    return f"""{lane_tracks(boxes, config)}, {temporal("tk", config)},
sup AS (SELECT *, count(*) OVER (PARTITION BY cid, track_id) AS nf, avg(confidence) OVER (PARTITION BY cid, track_id) AS mc FROM tmp WHERE st2 IS NULL),
rnk AS (SELECT *, row_number() OVER (PARTITION BY cid, frame ORDER BY nf DESC, mc DESC, track_ord) AS rk FROM sup),
stg AS (SELECT cid, frame, x1, y1, x2, y2, confidence, source_ids, was_merged, stage FROM geo WHERE stage IS NOT NULL
        UNION ALL SELECT cid, frame, x1, y1, x2, y2, confidence, source_ids, was_merged, st2 FROM tmp WHERE st2 IS NOT NULL
        UNION ALL SELECT cid, frame, x1, y1, x2, y2, confidence, source_ids, was_merged, CASE WHEN rk > {config.class_max} THEN 'cap' END FROM rnk),
kept AS (SELECT * FROM rnk WHERE rk <= {config.class_max}),
{gaps("kept", config)}, {SPLIT}, {FILL},
out AS (SELECT cid, frame, x1, y1, x2, y2, 'rejected' AS status, confidence, CAST(NULL AS BIGINT) AS track_id, stage AS reject_stage, source_ids FROM stg WHERE stage IS NOT NULL
        UNION ALL SELECT cid, frame, x1, y1, x2, y2, CASE WHEN was_merged THEN 'merged' ELSE 'reported' END, confidence, out_id, NULL, source_ids FROM spl
        UNION ALL SELECT cid, frame, x1, y1, x2, y2, 'interpolated', NULL, track_id, NULL, [] FROM fil)"""


LANE_TRACKS = lane_tracks()
CHAINED = chained()
#: All merged boxes but tiny ones.
LOOSE_LIVE = f"AS (SELECT * FROM cand WHERE {area()} >= {C.min_area_px2})"
LOOSE_TRACKS = f"{merged()}, live0 {LOOSE_LIVE}, {lanes('live0')}"
SURVIVORS = "sv AS (SELECT cid, unnest(source_ids) AS det_id, stage IS NULL OR stage NOT IN ('size', 'shape') AS geometric, stage IS NULL OR stage = 'cap' AS temporal, stage IS NULL AS cap FROM stg)"


def drawn_sql(seed: int, *columns: str) -> str:
    """The number that ``validation.draw`` takes from a digest."""
    digest = f"md5(concat_ws(':', {seed}, {', '.join(columns)}))"
    return "(" + " + ".join(f"(strpos('0123456789abcdef', {digest}[{i + 1}]) - 1) * {16 ** (7 - i)}" for i in range(8)) + ")"


def trials_sql(k: int) -> str:
    """Every run of k + 10 frames or more of a track of 20, hidden from its sixth frame on."""
    return f"""
isl AS (SELECT *, frame - row_number() OVER (PARTITION BY cid, track_id ORDER BY frame) AS g, count(*) OVER (PARTITION BY cid, track_id) AS tn FROM fx_tracked),
run AS (SELECT cid, track_id, g, min(frame) AS s, count(*) AS len FROM isl WHERE tn >= 20 GROUP BY 1, 2, 3 HAVING count(*) >= {k + 10}),
trial AS (SELECT cid, track_id, s + 5 AS gap_start FROM run)"""


def drawn_trials_sql(k: int, source: str, per_length: int) -> str:
    """The runs that ``validation.dropout_trials`` draws of one length, and where they are hidden."""
    at, order = drawn_sql(11, "cid", "track_id", "n", str(k)), drawn_sql(7, "cid", "track_id", "n", str(k))
    return f"""
isl AS (SELECT *, frame - row_number() OVER (PARTITION BY cid, track_id ORDER BY frame) AS g, count(*) OVER (PARTITION BY cid, track_id) AS tn FROM {source}),
run AS (SELECT cid, track_id, g, min(frame) AS s, count(*) AS len, row_number() OVER (PARTITION BY cid, track_id ORDER BY g) - 1 AS n FROM isl WHERE tn >= 20 GROUP BY 1, 2, 3),
drw AS (SELECT cid, track_id, s + 5 + {at} % (len - {k + 9}) AS gap_start, {order} AS pos FROM run WHERE len >= {k + 10}),
trial AS (SELECT cid, track_id, gap_start FROM drw QUALIFY row_number() OVER (ORDER BY pos, cid, track_id, gap_start) <= {per_length})"""


def dropout_sql(k: int, trials: str | None = None, source: str = "fx_tracked", config: Config = C) -> str:
    """CTEs up to ``per``: what is filled of each trial."""
    w, m, v = config.border_weights, config.border_margin_px, config.outward_velocity_min_px_per_frame
    vx, vy = f"({cx('b.')} - {cx('a.')})", f"({cy('b.')} - {cy('a.')})"
    leaving = f"((b.x1 <= {m * w['left']} AND -{vx} >= {v}) OR (b.y1 <= {m * w['top']} AND -{vy} >= {v}) OR (1850 - b.x2 <= {m * w['right']} AND {vx} >= {v}) OR (1000 - b.y2 <= {m * w['bottom']} AND {vy} >= {v}))"
    ex, ey = f"({cx('b.')} + {vx} * {k + 1})", f"({cy('b.')} + {vy} * {k + 1})"
    near = f"sqrt(({cx('c.')} - {ex}) * ({cx('c.')} - {ex}) + ({cy('c.')} - {ey}) * ({cy('c.')} - {ey})) <= {config.resume_gate_px + config.max_speed_px_per_frame * k}"
    fill = "true" if k <= config.max_dropout_frames else "false"
    lerp = ", ".join(f"b.{c} + (c.{c} - b.{c}) * (CAST(h.frame - b.frame AS DOUBLE) / {k + 1}) AS f_{c}" for c in ("x1", "y1", "x2", "y2"))
    return f"""{trials or trials_sql(k)},
res AS (SELECT t.cid, t.track_id, t.gap_start, h.x1, h.y1, h.x2, h.y2, {lerp}, NOT {leaving} AND {fill} AND {near} AS ok
  FROM trial t JOIN {source} a ON a.cid = t.cid AND a.track_id = t.track_id AND a.frame = t.gap_start - 2 JOIN {source} b ON b.cid = t.cid AND b.track_id = t.track_id AND b.frame = t.gap_start - 1
  JOIN {source} c ON c.cid = t.cid AND c.track_id = t.track_id AND c.frame = t.gap_start + {k} JOIN {source} h ON h.cid = t.cid AND h.track_id = t.track_id AND h.frame >= t.gap_start AND h.frame < t.gap_start + {k}),
per AS (SELECT cid, track_id, gap_start, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n_recovered, avg({iou("", "f_")}) FILTER (WHERE ok) AS mean_iou, avg({dist("", "f_")}) FILTER (WHERE ok) AS mean_center_dist_px FROM res GROUP BY 1, 2, 3)"""


def dropout_report_sql(lengths: list[int], source: str, per_length: int, config: Config) -> str:
    """CTEs up to ``rep``: the report over drawn trials of each length."""
    names = ("isl", "run", "drw", "trial", "res", "per")
    parts, rows = [], []
    for k in lengths:
        text = dropout_sql(k, drawn_trials_sql(k, source, per_length), source, config)
        for name in names:
            text = re.sub(rf"\b{name}\b", f"{name}_{k}", text)
        parts.append(text)
        rows.append(f"SELECT CAST({k} AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n_trials, round(CAST(sum(n_recovered) AS DOUBLE) / ({k} * count(*)), 6) AS recovery_rate, round(avg(mean_iou), 6) AS mean_iou, round(avg(mean_center_dist_px), 6) AS mean_center_dist_px FROM per_{k} HAVING count(*) > 0")
    return ", ".join(parts) + ", rep AS (" + " UNION ALL ".join(rows) + ")"


def disparity_sql(width: int, at: tuple[int, ...]) -> str:
    """CTEs up to ``dsp`` (cid, x1, disp, match_conf): each page in rows of ``width`` bytes against the same rows turned left
    by ``page_id % 9``.  The place of a box is the topmost, then leftmost window of the right image that is just its
    patch, within 6 rows of it and at its columns or left of them; one is, so the correlation is 1.  A box lower than 8
    pixels, or whose patch deviates by less than 4, has none.  Bytes are pairs of hexadecimal digits."""
    boxes = ", ".join(f"CAST({x} AS DOUBLE)" for x in at)
    margin = "* (1 - CAST(0.7 AS DOUBLE)) / 2"
    byte = "(strpos('0123456789ABCDEF', substr(part, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(part, 2 * i + 2, 1)) - 1"
    return f"""
pg AS (SELECT page_id, page_id % 9 AS s, hex(encode(coalesce(html, ''))) AS b, strlen(coalesce(html, '')) // {width} AS h FROM pages),
bx AS (SELECT page_id, s, h, x1, CAST(floor(x1 + 40 {margin}) AS BIGINT) AS a0, CAST(floor(x1 + 40 - 40 {margin}) AS BIGINT) - CAST(floor(x1 + 40 {margin}) AS BIGINT) AS pw,
  CAST(floor(h // 6 + (h - 2 * (h // 6)) {margin}) AS BIGINT) AS d0, CAST(floor(h - h // 6 - (h - 2 * (h // 6)) {margin}) AS BIGINT) AS d1 FROM pg, (SELECT unnest([{boxes}]) AS x1) x WHERE h - 2 * (h // 6) >= 8),
ln AS (SELECT page_id, r, substr(b, {2 * width} * r + 1, {2 * width}) AS line FROM (SELECT page_id, b, unnest(range(h)) AS r FROM pg) u),
cut AS (SELECT bx.page_id, x1, r, substr(line, 2 * a0 + 1, 2 * pw) AS part, pw FROM bx JOIN ln USING (page_id) WHERE r >= d0 AND r < d1),
pat AS (SELECT page_id, x1, string_agg(part, '' ORDER BY r) AS patch FROM cut GROUP BY 1, 2),
dev AS (SELECT page_id, x1, count(*) * sum(v * v) - sum(v) * sum(v) >= 16 * count(*) * count(*) AS clear FROM (SELECT page_id, x1, {byte} AS v FROM (SELECT page_id, x1, part, unnest(range(pw)) AS i FROM cut) u) w GROUP BY 1, 2),
col AS (SELECT page_id, x1, x, string_agg(substr(line || line, 2 * (x + s) + 1, 2 * pw), '' ORDER BY r) AS strip FROM (SELECT *, unnest(range(a0 + 1)) AS x FROM bx) b JOIN ln USING (page_id) GROUP BY 1, 2, 3),
fnd AS (SELECT bx.page_id, bx.x1, a0, t, x FROM (SELECT *, unnest(range(greatest(0, d0 - 6), least(h, d1 + 6) - (d1 - d0) + 1)) AS t FROM bx) bx JOIN pat ON pat.page_id = bx.page_id AND pat.x1 = bx.x1 JOIN col ON col.page_id = bx.page_id AND col.x1 = bx.x1
  WHERE substr(strip, 2 * pw * t + 1, 2 * pw * (d1 - d0)) = patch),
one AS (SELECT page_id, x1, CAST(a0 - x AS DOUBLE) AS disp FROM fnd QUALIFY row_number() OVER (PARTITION BY page_id, x1 ORDER BY t, x) = 1),
dsp AS (SELECT pg.page_id AS cid, x.x1, CASE WHEN clear THEN disp END AS disp, CASE WHEN clear THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS match_conf
  FROM pg CROSS JOIN (SELECT unnest([{boxes}]) AS x1) x LEFT JOIN dev ON dev.page_id = pg.page_id AND dev.x1 = x.x1 LEFT JOIN one ON one.page_id = pg.page_id AND one.x1 = x.x1)"""
