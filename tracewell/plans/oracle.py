"""The same plans in DuckDB's SQL, composed of common table expressions."""

from __future__ import annotations

# Sections b0, b1, b2, a1, a2 of a third-order Butterworth highpass at 0.6 and 0.01 of the Nyquist
# rate, and the stops of the colour ramps as decimal RGB, stated here again so that a wrong one elsewhere shows.
HP = (
    (0.2341476694226561, -0.4682953388453122, 0.2341476694226561, 0.4188560844817661, 0.3554467621723906),
    (0.4208077798377319, -0.4208077798377319, 0.0, 0.15838444032453622, 0.0),
)
KF = (
    (0.9842945605314826, -1.9685891210629651, 0.9842945605314826, -1.9681033112560973, 0.9690749308698328),
    (0.9845337085968967, -0.9845337085968967, 0.0, -0.9690674171937933, 0.0),
)
STOPS = {
    ('YellowMagenta', True): [(38, 41, 48), (68, 42, 74), (93, 51, 102), (123, 38, 140), (147, 4, 176)],
    ('YellowMagenta', False): [(38, 41, 48), (51, 49, 38), (61, 57, 31), (82, 75, 30), (117, 106, 30), (163, 144, 18), (255, 223, 18)],
    ('RedBlue', True): [(38, 41, 48), (46, 48, 66), (37, 44, 97), (36, 52, 179), (44, 67, 245)],
    ('RedBlue', False): [(38, 41, 48), (64, 44, 43), (97, 47, 44), (158, 50, 43), (245, 67, 54)],
    ('OrangeBlue', True): [(38, 41, 48), (41, 59, 84), (49, 84, 133), (45, 111, 196)],
    ('OrangeBlue', False): [(38, 41, 48), (74, 41, 34), (117, 54, 40), (209, 66, 33)],
    ('IceFire', True): [(38, 41, 48), (57, 50, 71), (57, 41, 92), (70, 39, 138), (32, 95, 158), (113, 181, 189), (147, 207, 201)],
    ('IceFire', False): [(38, 41, 48), (64, 49, 48), (77, 47, 45), (94, 41, 37), (138, 36, 29), (186, 79, 34), (217, 162, 115)],
    ('Vanimo', True): [(38, 41, 48), (46, 54, 39), (60, 82, 39), (86, 138, 34), (141, 237, 45)],
    ('Vanimo', False): [(38, 41, 48), (67, 49, 71), (102, 53, 115), (185, 78, 212)],
    ('GreyScale', True): [(38, 41, 48), (0, 0, 0)],
    ('GreyScale', False): [(38, 41, 48), (48, 48, 48), (80, 80, 80), (96, 96, 96), (208, 208, 208)],
}
BACKGROUND = (38, 41, 48)

GEOM = """geom AS (
  SELECT CAST(s * 19 AS INT) AS ch, 32e0 * ((s % 10) % 2) + 250e0 * (s // 10) AS x_um,
    20e0 * ((s % 10) // 2) + CASE WHEN s // 10 = 0 AND s % 10 >= 6 THEN 100e0 ELSE 0e0 END AS y_um, CAST(s // 10 AS INT) AS shank
  FROM range(20) r(s))"""
RAW = """raw AS (
  SELECT CAST(row_number() OVER (ORDER BY shank, y_um, ch) - 1 AS INT) AS data_idx, [ch] AS channels, ch AS first_ch, x_um, y_um, shank FROM geom)"""
AVG = """avgd AS (
  SELECT CAST(row_number() OVER (ORDER BY shank, y_um) - 1 AS INT) AS data_idx, list(ch ORDER BY ch) AS channels, min(ch) AS first_ch, arg_min(x_um, ch) AS x_um, y_um, shank
  FROM geom GROUP BY shank, y_um)"""
SAMPLES = """samples AS (
  SELECT CAST((vec_id % 20) * 19 AS INT) AS ch, (vec_id // 20) * 64 + pos AS t, CAST(embedding[pos + 1] AS DOUBLE) * 200 AS uv
  FROM embeddings, (SELECT unnest(range(64)) AS pos))"""
TRACE = "trace AS MATERIALIZED (SELECT r.shank, r.data_idx AS row_idx, t, uv FROM samples JOIN raw r ON r.first_ch = samples.ch)"
TRACE_AVG = "trace AS MATERIALIZED (SELECT r.shank, r.data_idx AS row_idx, t, avg(uv) AS uv FROM samples JOIN (SELECT *, unnest(channels) AS c FROM avgd) r ON r.c = samples.ch GROUP BY ALL)"


#: The same for many probes, made of suppliers.
PROBES = """geom AS (
  SELECT CAST(k // 20 AS INT) AS probe, CAST(s * 19 AS INT) AS ch, 32e0 * ((s % 10) % 2) + 250e0 * (s // 10) AS x_um,
    (20e0 + 5 * (k // 20 % 3)) * ((s % 10) // 2) + CASE WHEN s // 10 = 0 AND s % 10 >= 6 THEN 100e0 ELSE 0e0 END AS y_um, CAST(s // 10 AS INT) AS shank
  FROM (SELECT s_suppkey AS k, s_suppkey % 20 AS s FROM supplier))"""
PRAW = """raw AS (
  SELECT probe, CAST(row_number() OVER (PARTITION BY probe ORDER BY shank, y_um, ch) - 1 AS INT) AS data_idx, [ch] AS channels, ch AS first_ch, x_um, y_um, shank FROM geom)"""
PAVG = """avgd AS (
  SELECT probe, CAST(row_number() OVER (PARTITION BY probe ORDER BY shank, y_um) - 1 AS INT) AS data_idx, list(ch ORDER BY ch) AS channels, min(ch) AS first_ch, arg_min(x_um, ch) AS x_um, y_um, shank
  FROM geom GROUP BY probe, shank, y_um)"""
PITCH = """pitch AS (SELECT probe, shank, coalesce(min(d), 20e0) AS pitch_um FROM (
  SELECT probe, shank, y - lag(y) OVER (PARTITION BY probe, shank ORDER BY y) AS d FROM (SELECT DISTINCT probe, shank, y_um AS y FROM geom)) GROUP BY probe, shank)"""


def probe_display(source: str, name: str = "display") -> str:
    """Rows of each probe with gap and boundary markers."""
    return f"""{name} AS (
  SELECT probe, CAST(row_number() OVER (PARTITION BY probe ORDER BY o, p) - 1 AS INT) AS disp_idx, kind, data_idx, channels, first_ch, x_um, y_um, shank FROM (
    SELECT probe, data_idx AS o, 1 AS p, 'data' AS kind, data_idx, channels, first_ch, x_um, y_um, shank FROM {source}
    UNION ALL SELECT probe, data_idx, 0, kind, NULL, NULL, NULL, NULL, NULL, NULL FROM (
      SELECT r.probe, data_idx, CASE WHEN lag(r.shank) OVER w <> r.shank THEN 'boundary' WHEN y_um - lag(y_um) OVER w > 1.5 * pitch_um THEN 'gap' END AS kind
      FROM {source} r JOIN pitch q ON q.probe = r.probe AND q.shank = r.shank WINDOW w AS (PARTITION BY r.probe ORDER BY data_idx)) WHERE kind IS NOT NULL))"""


def display(source: str, name: str = "display") -> str:
    """Rows with gap and boundary markers."""
    return f"""{name} AS (
  SELECT CAST(row_number() OVER (ORDER BY o, p) - 1 AS INT) AS disp_idx, kind, data_idx, channels, first_ch, x_um, y_um, shank FROM (
    SELECT data_idx AS o, 1 AS p, 'data' AS kind, data_idx, channels, first_ch, x_um, y_um, shank FROM {source}
    UNION ALL SELECT data_idx, 0, kind, NULL, NULL, NULL, NULL, NULL, NULL FROM (
      SELECT data_idx, CASE WHEN lag(shank) OVER (ORDER BY data_idx) <> r.shank THEN 'boundary'
        WHEN y_um - lag(y_um) OVER (ORDER BY data_idx) > 1.5 * pitch THEN 'gap' END AS kind
      FROM {source} r JOIN (
        SELECT shank, coalesce(min(d), 20e0) AS pitch FROM (SELECT shank, y - lag(y) OVER (PARTITION BY shank ORDER BY y) AS d FROM (SELECT DISTINCT shank, y_um AS y FROM geom)) GROUP BY shank
      ) q USING (shank)) WHERE kind IS NOT NULL))"""


def _k(keys: tuple[str, ...]) -> str:
    return "".join(f"{k}, " for k in keys)


def dc(a: str, b: str, keys=()) -> str:
    return f"{b} AS (SELECT {_k(keys)}shank, row_idx, t, uv - avg(uv) OVER (PARTITION BY {_k(keys)}shank, row_idx) AS uv FROM {a})"


def phase(a: str, b: str, rows: str, np2: bool) -> str:
    delay = "((first_ch % 384) // 24) / 16e0" if np2 else "((first_ch % 384) // 32) / 13e0"
    return f"""{b} AS (
  SELECT a.shank, row_idx, t, coalesce(uv * (1 - {delay}) + lag(uv) OVER (PARTITION BY row_idx ORDER BY t) * {delay}, uv) AS uv
  FROM {a} a JOIN {rows} r ON r.data_idx = a.row_idx)"""


def _cascade(x: str, sections) -> str:
    """Columns of one step of two sections for input x and state z0, z1, w0, w1."""
    (b0, b1, b2, a1, a2), (c0, c1, c2, d1, d2) = [[repr(float(v)) + "::DOUBLE" for v in s] for s in sections]
    y1 = f"({b0} * {x} + z0)"
    y2 = f"({c0} * {y1} + w0)"
    return (
        f"{y2} AS y, {b1} * {x} - {a1} * {y1} + z1 AS z0, {b2} * {x} - {a2} * {y1} AS z1, "
        f"{c1} * {y1} - {d1} * {y2} + w1 AS w0, {c2} * {y1} - {d2} * {y2} AS w1"
    )


def sosfilt(a: str, b: str, sections, keys: tuple[str, ...], order: str, carry: str) -> str:
    """One pass along `order` within `keys`; `carry` is the column that places a value."""
    group = ", ".join(keys)
    on = " AND ".join(f"s.{k} = n.{k}" for k in keys)
    lead = ", ".join(f"n.{k}" for k in keys)
    return f"""{b}_in AS (SELECT {group}, {carry}, uv, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS i FROM {a}),
{b}_run AS (
  SELECT {group}, {carry}, i, {_cascade("uv", sections)} FROM (SELECT *, 0e0 AS z0, 0e0 AS z1, 0e0 AS w0, 0e0 AS w1 FROM {b}_in WHERE i = 1)
  UNION ALL
  SELECT {lead}, n.{carry}, n.i, {_cascade("n.uv", sections)} FROM {b}_run s JOIN {b}_in n ON {on} AND n.i = s.i + 1),
{b} AS (SELECT {group}, {carry}, y AS uv FROM {b}_run)"""


def filtfilt(a: str, b: str, sections, keys: tuple[str, ...], carry: str = "t") -> str:
    return sosfilt(a, f"{b}_f", sections, keys, carry, carry) + ",\n" + sosfilt(f"{b}_f", b, sections, keys, f"{carry} DESC", carry)


def hp(a: str, b: str, keys=()) -> str:
    return filtfilt(a, b, HP, (*keys, "shank", "row_idx"))


def cmr(a: str, b: str, keys=()) -> str:
    return f"{b} AS (SELECT {_k(keys)}shank, row_idx, t, uv - median(uv) OVER (PARTITION BY {_k(keys)}shank, t) AS uv FROM {a})"


def local(a: str, b: str, rows: str) -> str:
    return f"""{b}_n AS MATERIALIZED (
  SELECT p.data_idx AS i, q.data_idx AS j FROM {rows} p JOIN {rows} q ON p.shank = q.shank
    AND sqrt((p.x_um - q.x_um) ** 2 + (p.y_um - q.y_um) ** 2) BETWEEN 100 AND 400),
{b}_a AS MATERIALIZED (SELECT * FROM {a}),
{b}_m AS MATERIALIZED (SELECT i, t, median(uv) AS m FROM {b}_n JOIN {b}_a ON row_idx = j GROUP BY i, t),
{b} AS (SELECT shank, row_idx, a.t, uv - coalesce(m, 0e0) AS uv FROM {b}_a a LEFT JOIN {b}_m m ON m.i = a.row_idx AND m.t = a.t)"""


def gain(a: str, b: str, half: int = 50) -> str:
    return f"""{b} AS (
  SELECT a.shank, row_idx, t, uv, greatest(avg(abs(uv)) OVER (PARTITION BY row_idx ORDER BY t ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING), f) AS gain
  FROM {a} a JOIN (SELECT shank, greatest(stddev_pop(uv) * 0.003, 1e-8) AS f FROM {a} GROUP BY shank) USING (shank))"""


def kfilt(a: str, b: str) -> str:
    """The mirror-padded filter across rows, from its definition."""
    return f"""{b}_s AS (SELECT shank, t, row_idx - min(row_idx) OVER (PARTITION BY shank) AS p, count(*) OVER (PARTITION BY shank, t) AS n, min(row_idx) OVER (PARTITION BY shank) AS lo, uv FROM {a}),
{b}_p AS (
  SELECT shank, t, least(n, 60) + p AS p, uv FROM {b}_s
  UNION ALL SELECT shank, t, least(n, 60) - 1 - p, uv FROM {b}_s WHERE p < least(n, 60)
  UNION ALL SELECT shank, t, least(n, 60) + n + (n - 1 - p), uv FROM {b}_s WHERE n - 1 - p < least(n, 60)),
{filtfilt(f"{b}_p", f"{b}_q", KF, ("shank", "t"), "p")},
{b} AS (SELECT q.shank, s.lo + s.p AS row_idx, q.t, q.uv FROM {b}_q q JOIN {b}_s s ON s.shank = q.shank AND s.t = q.t AND q.p = least(s.n, 60) + s.p)"""


def destripe(a: str, b: str) -> str:
    return (
        gain(a, f"{b}_g")
        + f",\n{b}_d AS (SELECT shank, row_idx, t, uv / gain AS uv FROM {b}_g),\n"
        + kfilt(f"{b}_d", f"{b}_k")
        + f",\n{b} AS (SELECT k.shank, k.row_idx, k.t, k.uv * g.gain AS uv FROM {b}_k k JOIN {b}_g g ON g.row_idx = k.row_idx AND g.t = k.t)"
    )


def greedy(a: str, b: str, threshold: float, refractory: int) -> str:
    """Counted spikes by stepping from each counted time to the next one that may count."""
    return f"""{b}_t AS (SELECT row_idx, t FROM {a} WHERE uv < {threshold}),
{b}_x AS (
  SELECT row_idx, min(t) AS t FROM {b}_t GROUP BY row_idx
  UNION ALL
  SELECT x.row_idx, (SELECT min(n.t) FROM {b}_t n WHERE n.row_idx = x.row_idx AND n.t > x.t + {refractory}) AS t FROM {b}_x x WHERE x.t IS NOT NULL),
{b} AS (SELECT row_idx, count(t) AS n FROM {b}_x GROUP BY row_idx)"""


def windows(stims: str = "stims") -> str:
    """Windows of -5 .. 20 ms with 150 samples on either side: 325 samples."""
    return f"""total AS (SELECT max(t) + 1 AS n FROM samples),
stims AS (SELECT event_id AS stim_idx, (event_id % n) / 1000e0 AS onset_s FROM events, total WHERE event_type = 'signup'),
placed AS (SELECT stim_idx, CAST(round(onset_s * 1000) AS BIGINT) AS onset, CAST(round(onset_s * 1000) AS BIGINT) - 155 AS read_first FROM {stims}),
valid AS (SELECT placed.* FROM placed, total WHERE read_first >= 0 AND read_first + 325 <= n),
cut AS (SELECT stim_idx, shank, row_idx, trace.t, uv, read_first + 150 AS start FROM valid JOIN trace ON trace.t BETWEEN read_first AND read_first + 324)"""


def average(a: str, b: str) -> str:
    return f"{b} AS (SELECT row_idx AS data_idx, CAST(a.t - v.read_first - 150 AS INT) AS k, avg(uv) AS mean_uv FROM {a} a JOIN valid v USING (stim_idx) WHERE a.t - v.read_first - 150 BETWEEN 0 AND 24 GROUP BY ALL)"


def psth(with_hp: bool) -> list[str]:
    stages = [SAMPLES, GEOM, AVG, TRACE_AVG, windows(), dc("cut", "w1", ("stim_idx",))]
    if with_hp:
        stages.append(hp("w1", "w2", ("stim_idx",)))
    return [*stages, cmr("w2" if with_hp else "w1", "w3", ("stim_idx",)), average("w3", "psth")]


def with_(parts: list[str], query: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + query


R4 = "round(uv, 4) + 0e0 AS uv"
OUT = f"SELECT shank, row_idx, t, {R4} FROM "


def rgb(t: str, name: str) -> str:
    """Columns r, g, b of a value t in [-1, 1]."""

    def ramp(u: str, positive: bool, c: int) -> str:
        table = STOPS[name, positive]
        n = len(table) - 1
        values = "[" + ", ".join(f"{s[c]}e0" for s in table) + "]"
        at = f"CAST(least(floor({u} * {n}), {n - 1}) AS INT)"
        return f"CAST(floor({values}[{at} + 1] + ({values}[{at} + 2] - {values}[{at} + 1]) * ({u} * {n} - {at})) AS INT)"

    return ", ".join(f"CASE WHEN {t} >= 0 THEN {ramp(t, True, c)} ELSE {ramp(f'(-({t}))', False, c)} END AS {x}" for c, x in enumerate("rgb"))


def pixels(means: str, display_cte: str, width: int, height: int, vmax: str, name: str) -> str:
    """The painted picture of binned means (data_idx, px, v)."""
    t = f"greatest(-1e0, least(1e0, v / {vmax}))"
    back = BACKGROUND
    part = lambda x, i: f"CASE WHEN kind = 'boundary' THEN 255 WHEN kind = 'gap' AND (px // 4) % 2 = 0 THEN 96 WHEN v IS NULL THEN {back[i]} ELSE c{x} END AS {x}"
    return f"""
SELECT py, px, {part("r", 0)}, {part("g", 1)}, {part("b", 2)}, 255 AS a FROM (
  SELECT py, px, kind, v, r AS cr, g AS cg, b AS cb FROM (
    SELECT py, px, kind, v, {rgb(t, name)} FROM (
      SELECT CAST(y.py AS INT) AS py, CAST(x.px AS INT) AS px, kind, m.v
      FROM range({height}) y(py) CROSS JOIN range({width}) x(px)
      JOIN (SELECT *, count(*) OVER () AS n FROM {display_cte}) d ON d.disp_idx = greatest(d.n - 1 - (y.py * d.n) // {height}, 0)
      LEFT JOIN {means} m ON m.data_idx = d.data_idx AND m.px = x.px)))"""


def plot(rows: str, width: int, line: int, heat: int, vmax: str, name: str) -> str:
    """The picture of an event average of 25 points from -5 ms, channels 1 and 39, over `q(data_idx, k, v)`, `heat` and `display`."""
    accent = {"Vanimo": (202, 237, 166)}[name]
    colors = {"1": (255, 255, 255), "39": (255, 182, 23), "0": accent}
    tops = {"0": line + 6, "1": 0, "39": 0}
    step = f"({width - 1}e0 / 24)"
    pick = lambda c: "CASE s " + " ".join(f"WHEN {k} THEN {v[c]}" for k, v in colors.items()) + " END"
    shift = "CASE s " + " ".join(f"WHEN {k} THEN {v}" for k, v in tops.items()) + " END"
    y = lambda x: f"CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (({x} - x0) / (x1 - x0)) ELSE y0 END"
    row = lambda v: f"greatest(0, least({line - 1}, floor({v} + 0.5e0)))::BIGINT"
    bottom = 2 * (line + 6)
    return f"""
SELECT py::INT AS py, px::INT AS px, arg_max(r, z)::INT AS r, arg_max(g, z)::INT AS g, arg_max(b, z)::INT AS b, 255 AS a FROM (
  SELECT y.i AS py, x.i AS px, 0 AS z, {BACKGROUND[0]} AS r, {BACKGROUND[1]} AS g, {BACKGROUND[2]} AS b FROM range({width}) x(i), range({bottom + heat}) y(i)
  UNION ALL SELECT y.i, x.i, 1, 80, 80, 80 FROM range({width}) x(i), (VALUES ({(line - 1) // 2}), ({line + 6 + (line - 1) // 2})) y(i)
  UNION ALL SELECT py + {bottom}, px, 1, r, g, b FROM heat
  UNION ALL SELECT py + {bottom}, px, 2 + s, (r * 127 + cr * 128) // 255, (g * 127 + cg * 128) // 255, (b * 127 + cb * 128) // 255 FROM heat JOIN (
    SELECT s, cr, cg, cb, floor((n - 1 - disp_idx + 0.5e0) / n * {heat}) AS m FROM (SELECT *, count(*) OVER () AS n FROM display) JOIN (VALUES (0, 1, 255, 255, 255), (1, 39, 255, 182, 23)) v(s, ch, cr, cg, cb) ON first_ch + 1 = ch
  ) ON py = m OR py = m - 1
  UNION ALL SELECT y.i, {int(5 / 25 * width)}, 9, 150, 150, 150 FROM range({bottom + heat}) y(i) WHERE y.i < {line} OR y.i BETWEEN {line + 6} AND {2 * line + 5} OR y.i >= {bottom}
  UNION ALL SELECT {shift} + unnest(range(least({row("ya")}, {row("yb")}), greatest({row("ya")}, {row("yb")}) + 1)), px, CASE s WHEN 39 THEN 3 ELSE 2 END, {pick(0)}, {pick(1)}, {pick(2)} FROM (
    SELECT s, px, {y("greatest(x0, px + 0e0)")} AS ya, {y("least(x1, px + 1e0)")} AS yb FROM (
      SELECT s, x0, y0, x1, y1, unnest(range(floor(x0)::BIGINT, floor(x1)::BIGINT + 1)) AS px FROM (
        SELECT s, x AS x0, y AS y0, coalesce(lead(x) OVER w, x) AS x1, coalesce(lead(y) OVER w, y) AS y1 FROM (
          SELECT s, k, k * {step} AS x, {(line - 1) / 2}e0 - v / (max(abs(v)) OVER (PARTITION BY s = 0)) * {line / 2 - 2}e0 AS y FROM (
            SELECT 0 AS s, k, round(avg(v), 4) AS v FROM q GROUP BY k
            UNION ALL SELECT first_ch + 1, k, v FROM q JOIN {rows} USING (data_idx) WHERE first_ch + 1 IN (1, 39))
        ) WINDOW w AS (PARTITION BY s ORDER BY k))) WHERE px < {width})
) GROUP BY py, px"""


def bins(a: str, b: str, first: int, n: int, width: int, row: str = "row_idx", t: str = "t", v: str = "uv") -> str:
    return f"""{b} AS (
  SELECT {row} AS data_idx, px, avg({v}) AS v FROM {a} JOIN (
    SELECT px, {first} + (px * {n}) // {width} AS lo, {first} + greatest(least(((px + 1) * {n}) // {width}, {n}), (px * {n}) // {width} + 1) AS hi FROM range({width}) r(px)
  ) ON {t} >= lo AND {t} < hi GROUP BY ALL)"""
