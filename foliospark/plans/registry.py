"""All layout queries over the driver's tables, and DuckDB SQL for those that SQL can express.

Each SQL text is put together from named common table expressions; ``sql(body, *names)`` adds those that are needed.
What has no SQL here (the ratio of difflib) is held against sequential models in the tests.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.lineage import cut, remove, remove_at_exit, shared_dir
from ..operators import clusters, documents, duplicates, grouping, leaders, pairs, recognition, tablefunctions, textmerge
from ..operators.ledger import Ledger
from ..sources import layout as source
from ..streaming import pages as streamed
from . import layout as plan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WORDS = "list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')"


def _closure(name: str, nodes: str, edges: str, extra: str = "") -> dict[str, str]:
    """Least node reachable, by recursion over both directions of the edges."""
    return {
        f"{name}_s": f"select image_id, a, b from {edges} union all select image_id, b, a from {edges}",
        f"{name}_r": f"select image_id, element_id as node, element_id as root from {nodes} union select r.image_id, s.b, r.root from {name}_r r join {name}_s s on s.image_id = r.image_id and s.a = r.node",
        name: f"select image_id, node as element_id, min(root) as cluster_id from {name}_r group by image_id, node",
    }


def _edges(nodes: str, condition: str) -> str:
    return f"select a.image_id, a.element_id as a, b.element_id as b from {nodes} a join {nodes} b on a.image_id = b.image_id and a.element_id < b.element_id and {condition}"


def _independent() -> dict[str, str]:
    """Conditions for the SQL side, written out by themselves: they share nothing with functions.geometry, so a slip there shows."""
    w = lambda r: f"({r}.right_x - {r}.left_x)"
    h = lambda r: f"({r}.bottom_y - {r}.top_y)"

    def both(axis: str) -> str:
        low, high = ("left_x", "right_x") if axis == "x" else ("top_y", "bottom_y")
        return f"(case when a.{high} < b.{low} or b.{high} < a.{low} then 0 else (case when a.{high} < b.{high} then a.{high} else b.{high} end) - (case when a.{low} > b.{low} then a.{low} else b.{low} end) end)"

    def gap(axis: str) -> str:
        low, high = ("left_x", "right_x") if axis == "x" else ("top_y", "bottom_y")
        return f"(case when a.{high} < b.{low} then b.{low} - a.{high} when b.{high} < a.{low} then a.{low} - b.{high} else 0 end)"

    def span(axis: str) -> str:
        low, high = ("left_x", "right_x") if axis == "x" else ("top_y", "bottom_y")
        return f"((case when a.{high} > b.{high} then a.{high} else b.{high} end) - (case when a.{low} < b.{low} then a.{low} else b.{low} end))"

    def share(axis: str) -> str:
        size = w if axis == "x" else h
        least = f"(case when {size('a')} < {size('b')} then {size('a')} else {size('b')} end)"
        return f"(case when {least} > 0 then cast({both(axis)} as double) / {least} else 0 end)"

    areas = f"({w('a')} * {h('a')} + {w('b')} * {h('b')})"
    inter = f"({both('x')} * {both('y')})"
    whole = f"({span('x')} * {span('y')})"
    density = f"(case when {whole} > 0 then cast({areas} as double) / {whole} else cast(0 as double) end)"
    connected = lambda min_x, min_y: f"({density} >= 0.15 and ({share('y')} >= {min_y} or {share('x')} >= {min_x}))"
    smaller = f"(case when {w('a')} * {h('a')} = 0 or {w('b')} * {h('b')} = 0 then 1 when {w('a')} * {h('a')} < {w('b')} * {h('b')} then {w('a')} * {h('a')} else {w('b')} * {h('b')} end)"
    narrow = f"(case when {w('a')} < {w('b')} then {w('a')} else {w('b')} end)"
    low = f"(case when {h('a')} < {h('b')} then {h('a')} else {h('b')} end)"
    # The middles of two texts are less than half the lower height apart.
    one_line = f"(a.type = 'text' and b.type = 'text' and abs((a.top_y + a.bottom_y) - (b.top_y + b.bottom_y)) < {low})"
    return {
        "density": density, "strict": connected(0.2, 0.1), "loose": connected(0.1, 0.1), "inter": inter,
        "iou": f"(case when {areas} - {inter} > 0 then cast({inter} as double) / ({areas} - {inter}) else cast(0 as double) end)",
        "distance": f"({gap('x')} * {gap('x')} + {gap('y')} * {gap('y')})",
        "contained": "(b.left_x <= a.left_x and a.right_x <= b.right_x and b.top_y <= a.top_y and a.bottom_y <= b.bottom_y)",
        "adjacent": f"({gap('x')} <= 50 and {gap('y')} <= 50)",
        "smaller": f"(cast({inter} as double) / {smaller})",
        "close": f"(case when {one_line} then {gap('x')} <= 40 or 2 * {gap('x')} <= {narrow} else {gap('x')} <= 20 or {gap('y')} <= 20 or {share('x')} >= 0.3 or {share('y')} >= 0.1 end)",
    }


OWN = _independent()


def _of(condition: str, a: str, b: str) -> str:
    """A condition of OWN over rows of other names."""
    return re.sub(r"\b([ab])\.", lambda m: (a if m[1] == "a" else b) + ".", OWN[condition])


def _text_fold() -> str:
    """Of merge_in (image_id, group_id, rn, w: words, text and box): the text that is open after each row, and its number."""
    last = lambda n: f"array_to_string(wr[-{n}:], ' ')"
    first = lambda n: f"array_to_string(w[1:{n}], ' ')"
    heads = [f"(len(wr) >= {n} and starts_with(text, {last(n)}))" for n in (1, 2, 3)]
    tails = [f"(len(w) >= {n} and ends_with(rt, {first(n)}))" for n in (1, 2, 3)]
    cuts = " ".join(f"when {h} then rt || text[len({last(n)}) + 1:]" for n, h in zip((1, 2, 3), heads))
    met = f"""select o.*, r.no, r.text as rt, r.left_x as rl, r.top_y as rtop, r.right_x as rr, r.bottom_y as rb, r.confidence as rc, {WORDS.format(t='r.text')} as wr
        from merge_fold r join merge_in o on o.image_id = r.image_id and o.group_id = r.group_id and o.rn = r.rn + 1"""
    told = f"""select *, abs(rl - left_x) <= 5 and abs(rtop - top_y) <= 5 as same, {' or '.join(heads + tails)} as goes_on,
        rr + 50 >= left_x and right_x + 50 >= rl and rb + 50 >= top_y and bottom_y + 50 >= rtop as beside from ({met})"""
    text = f"case when same then case when len(rt) > len(text) then rt else text end when goes_on then case when starts_with(text, rt) then rt {cuts} else rt end else rt || ' ' || text end"
    pick = lambda both, own: f"case when same or goes_on or beside then {both} else {own} end"
    return f"""select image_id, group_id, rn, cast(1 as bigint) as no, text, left_x, top_y, right_x, bottom_y, confidence from merge_in where rn = 1 union all
        select image_id, group_id, rn, {pick('no', 'no + 1')}, {pick(text, 'text')}, {pick('least(rl, left_x)', 'left_x')}, {pick('least(rtop, top_y)', 'top_y')},
        {pick('greatest(rr, right_x)', 'right_x')}, {pick('greatest(rb, bottom_y)', 'bottom_y')}, {pick('greatest(rc, confidence)', 'confidence')} from ({told})"""


def _mean_fold(name: str, rows: str, keys: str, threshold: int) -> dict[str, str]:
    """rows: keys, rn, v. Groups g by distance from the running mean."""
    on = " and ".join(f"o.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    far = f"abs(r.n * o.v - r.total) > {threshold} * r.n"
    cols = ", ".join(f"o.{k.strip()}" for k in keys.split(","))
    return {
        name: f"select {keys}, rn, cast(1 as bigint) as g, cast(1 as bigint) as n, v as total from {rows} where rn = 1 union all "
        f"select {cols}, o.rn, case when {far} then r.g + 1 else r.g end, case when {far} then 1 else r.n + 1 end, case when {far} then o.v else r.total + o.v end "
        f"from {name} r join {rows} o on {on} and o.rn = r.rn + 1"
    }


def _leaders(name: str, ranked: str, similar: str) -> dict[str, str]:
    """ranked: image_id, rn, element_id, box. Seeds of each page, as kept."""
    seed = "{'element_id': o.element_id, 'rn': o.rn, 'left_x': o.left_x, 'top_y': o.top_y, 'right_x': o.right_x, 'bottom_y': o.bottom_y}"
    return {
        f"{name}_f": f"select image_id, rn, [{seed}] as kept from {ranked} o where rn = 1 union all "
        f"select o.image_id, o.rn, case when len(list_filter(r.kept, lambda k: {similar})) = 0 then list_append(r.kept, {seed}) else r.kept end "
        f"from {name}_f r join {ranked} o on o.image_id = r.image_id and o.rn = r.rn + 1",
        name: f"select image_id, unnest(kept, recursive := true) from (select image_id, arg_max(kept, rn) as kept from {name}_f group by image_id)",
    }


PARTS: dict[str, str] = {
    "el": source.events_sql(),
    "dense": source.events_sql(dense=True),
    "docs": source.DOCS_SQL,
    "cand": source.CANDIDATES_SQL,
    "ocr": "select * from docs where length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 2 and confidence >= 0.2",
    # clusters
    "strict_e": _edges("el", OWN["strict"]),
    **_closure("strict", "el", "strict_e"),
    "linewise_in": "select image_id, cluster_id, element_id, left_x, top_y, top_y + bottom_y as c2, row_number() over (partition by image_id, cluster_id order by top_y, element_id) as rn from strict join el using (image_id, element_id)",
    "linewise_fold": """select image_id, cluster_id, element_id, left_x, top_y, rn, [cast(1 as bigint)] as ns, [c2] as ts, cast(1 as bigint) as line_no from linewise_in where rn = 1 union all
        select image_id, cluster_id, element_id, left_x, top_y, rn, case when k <= len(ns) then list_transform(ns, lambda x, i: case when i = k then x + 1 else x end) else list_append(ns, 1) end,
        case when k <= len(ns) then list_transform(ts, lambda x, i: case when i = k then x + c2 else x end) else list_append(ts, c2) end, k from (
        select o.*, r.ns, r.ts, coalesce(list_min(list_filter(range(1, len(r.ns) + 1), lambda i: abs(r.ns[i] * o.c2 - r.ts[i]) <= 20 * r.ns[i])), len(r.ns) + 1) as k
        from linewise_fold r join linewise_in o on o.image_id = r.image_id and o.cluster_id = r.cluster_id and o.rn = r.rn + 1)""",
    "region_box": "select image_id, cluster_id, min(left_x) as left_x, min(top_y) as top_y, max(right_x) as right_x, max(bottom_y) as bottom_y, count(*) as n_elements from strict join el using (image_id, element_id) group by image_id, cluster_id",
    "region_el": "select image_id, cluster_id as element_id, left_x, top_y, right_x, bottom_y from region_box",
    "loose_e": _edges("region_el", OWN["loose"]),
    **_closure("loose", "region_el", "loose_e"),
    "block_box": "select image_id, l.cluster_id as block_id, min(left_x) as left_x, min(top_y) as top_y, max(right_x) as right_x, max(bottom_y) as bottom_y, count(*) as n_elements from el join strict s using (image_id, element_id) join (select image_id, element_id as cid, cluster_id from loose) l using (image_id) where l.cid = s.cluster_id group by image_id, l.cluster_id",
    # Sweeps over a page's boxes from the top: box i joins the one before it, unless that was joined in this sweep; a sweep that joins none is the last.
    "sweep_in": "select image_id, list({'l': left_x, 't': top_y, 'r': right_x, 'b': bottom_y, 'n': n_elements, 'm': cast(block_id as varchar)} order by top_y, block_id) as boxes from block_box group by image_id",
    "sweep": """select image_id, boxes, cast(1 as bigint) as i, boxes[1:0] as done, false as joined from sweep_in union all
        select image_id, case when i <= len(boxes) then boxes else done end, case when i <= len(boxes) then i + 1 else 1 end,
        case when i > len(boxes) then boxes[1:0] when meets then list_append(done[1:len(done) - 1], {'l': least(a.l, x.l), 't': least(a.t, x.t), 'r': greatest(a.r, x.r), 'b': greatest(a.b, x.b), 'n': a.n + x.n, 'm': a.m || ',' || x.m}) else list_append(done, x) end,
        i <= len(boxes) and meets from (select *, coalesce(not joined and a.r >= x.l and x.r >= a.l and abs(x.t - a.b) <= 40 and least(abs(x.l - a.r), abs(a.l - x.r)) <= 200, false) as meets
        from (select *, boxes[i] as x, done[len(done)] as a from sweep where i <= len(boxes) or len(done) < len(boxes)))""",
    "swept": "select image_id, unnest(done) as box, unnest(range(len(done))) as place from sweep where i > len(boxes) and len(done) = len(boxes)",
    # leaders
    "by_confidence": "select *, row_number() over (partition by image_id order by confidence desc, element_id) as rn from dense",
    **_leaders("kept_boxes", "by_confidence", f"{_of('iou', 'k', 'o')} > 0.3"),
    "by_area": "select *, row_number() over (partition by image_id order by (right_x - left_x) * (bottom_y - top_y) desc, confidence desc, element_id) as rn from dense",
    **_leaders("holders", "by_area", _of("contained", "o", "k")),
    "held": f"select a.image_id, a.element_id, arg_min(b.element_id, b.rn) as seed_id from dense a join holders b on a.image_id = b.image_id and {OWN['contained']} group by a.image_id, a.element_id",
    "held_box": "select image_id, seed_id as element_id, min(left_x) as left_x, min(top_y) as top_y, max(right_x) as right_x, max(bottom_y) as bottom_y, sum(confidence) / count(*) as confidence from held join dense using (image_id, element_id) group by image_id, seed_id",
    "near_e": _edges("held_box", f"{OWN['distance']} <= 3600"),
    **_closure("near", "held_box", "near_e"),
    # one-dimensional grouping of recognised lines
    "g_flag": "select *, case when top_y - max(bottom_y) over (partition by image_id order by top_y, element_id rows between unbounded preceding and 1 preceding) <= 50 then 0 else 1 end as new from ocr",
    "grouped": "select *, cast(sum(new) over (partition by image_id order by top_y, element_id) as bigint) as group_id from g_flag",
    "group_box": "select image_id, group_id, min(left_x) as left_x, min(top_y) as top_y, max(right_x) as right_x, max(bottom_y) as bottom_y, count(*) as n_elements from grouped group by image_id, group_id",
    "col_in": "select *, left_x as v, row_number() over (partition by image_id, group_id order by left_x, element_id) as rn from grouped where type = 'text'",
    **_mean_fold("col_fold", "col_in", "image_id, group_id", 100),
    "columned": "select c.* exclude (rn, v), f.g as column_id from col_in c join col_fold f using (image_id, group_id, rn)",
    "line_flag": "select *, case when top_y - lag(bottom_y) over (partition by image_id, group_id, column_id order by top_y, left_x, element_id) <= 15 then 0 else 1 end as fresh from columned",
    "line_no": "select *, cast(sum(fresh) over (partition by image_id, group_id, column_id order by top_y, left_x, element_id) as bigint) as line_id from line_flag",
    "line": "select image_id, group_id, column_id, line_id, string_agg(text, ' ' order by top_y, left_x, element_id) as text, min(top_y) + max(bottom_y) as v2, cast(sum(left_x) as bigint) as left_sum, cast(sum(right_x) as bigint) as right_sum, count(*) as n from line_no group by image_id, group_id, column_id, line_id",
    "col_span": "select image_id, group_id, column_id, min(cast(left_sum as double) / n) as low, max(cast(right_sum as double) / n) as high from line group by image_id, group_id, column_id",
    "col_flag": "select *, case when low - max(high) over (partition by image_id, group_id order by low, column_id rows between unbounded preceding and 1 preceding) < 50 then 0 else 1 end as fresh from col_span",
    "col_merge": "select image_id, group_id, column_id, cast(sum(fresh) over (partition by image_id, group_id order by low, column_id) as bigint) as merged_id from col_flag",
    "row_in": "select *, v2 as v, cast(left_sum as double) / n as x_at, row_number() over (partition by image_id, group_id order by v2, cast(left_sum as double) / n, column_id, line_id) as rn from line",
    **_mean_fold("row_fold", "row_in", "image_id, group_id", 50),
    "row_text": "select r.image_id, r.group_id, f.g as row_id, string_agg(r.text, ' ' order by x_at, v2, column_id, line_id) as text from row_in r join row_fold f using (image_id, group_id, rn) group by r.image_id, r.group_id, f.g",
    "para_flag": f"select *, case when row_id = min(row_id) over (partition by image_id, group_id) or len({WORDS.format(t='text')}) < 5 or ends_with(text, ':') then 1 else 0 end as fresh from row_text",
    "para_no": "select *, cast(sum(fresh) over (partition by image_id, group_id order by row_id) as bigint) as para_no from para_flag",
    "para": "select image_id, group_id, para_no, string_agg(text, ' ' order by row_id) as text from para_no group by image_id, group_id, para_no",
    "line_view": "select image_id, group_id, column_id, line_id, text, cast(v2 as double) / 2 as v_center, cast(left_sum as double) / n as left_x, cast(right_sum as double) / n as avg_right from line",
    "anchor_in": "select *, row_number() over (partition by image_id, group_id order by v_center, left_x, column_id, line_id) as rn from line_view",
    "anchor_fold": "select image_id, group_id, rn, cast(1 as bigint) as g, left_x as first from anchor_in where rn = 1 union all select o.image_id, o.group_id, o.rn, case when abs(o.left_x - r.first) >= 50 then r.g + 1 else r.g end, case when abs(o.left_x - r.first) >= 50 then o.left_x else r.first end from anchor_fold r join anchor_in o on o.image_id = r.image_id and o.group_id = r.group_id and o.rn = r.rn + 1",
    # merging of texts
    "merge_in": f"select image_id, group_id, text, left_x, top_y, right_x, bottom_y, coalesce(confidence, 1) as confidence, {WORDS.format(t='text')} as w, row_number() over (partition by image_id, group_id order by top_y, left_x, element_id) as rn from grouped where type = 'text' and text is not null",
    "merge_fold": _text_fold(),
    # angles
    "raw_angle": "select image_id, case when right_x = left_x then cast(90 as double) else degrees(atan2(bottom_y - top_y, right_x - left_x)) end as raw, sqrt(cast((right_x - left_x) * (right_x - left_x) + (bottom_y - top_y) * (bottom_y - top_y) as double)) as len from el",
    "angle": "select image_id, cast(round_even(case when raw - 180 * floor(raw / 180) > 90 then raw - 180 * floor(raw / 180) - 180 else raw - 180 * floor(raw / 180) end, 0) as bigint) as angle, len from raw_angle",
    "histogram": "select image_id, angle, sum(len) as weight from angle group by image_id, angle",
    "kept_in": "select image_id, a, row_number() over (partition by image_id order by element_id) as rn, count(*) over (partition by image_id) as n from (select image_id, element_id, a - 180 * floor(a / 180) as a from (select image_id, element_id, cast((element_id * 37) % 360 - 180 as double) as a from el))",
    "kept_fold": """select image_id, rn, n, [[a]] as ks from kept_in where rn = 1 union all
        select image_id, rn, n, case when k <= len(ks) then list_transform(ks, lambda x, i: case when i = k then list_append(x, a) else x end) else list_append(ks, [a]) end from (
        select o.*, r.ks, coalesce(list_min(list_filter(range(1, len(r.ks) + 1), lambda i: len(list_filter(r.ks[i], lambda v: abs(o.a - v) < 5)) > 0)), len(r.ks) + 1) as k
        from kept_fold r join kept_in o on o.image_id = r.image_id and o.rn = r.rn + 1)""",
    "kept_mean": "select image_id, list_transform(list_filter(ks, lambda c: len(c) >= n * cast(0.1 as double)), lambda c: list_sum(c) / len(c)) as ms from kept_fold where rn = n",
    "kept_snap": "select image_id, case when len(ms) = 0 then [cast(0 as double)] else list_transform(ms, lambda m: case when abs(m) < 5 then cast(0 as double) when abs(m - 90) < 5 then 90 when abs(m - 180) < 5 then 180 when abs(m - 270) < 5 then 270 else m end) end as ms from kept_mean",
    "angle_in": "select *, sum(weight) over (partition by image_id) as total, row_number() over (partition by image_id order by weight desc, angle) as rn from histogram",
    "angle_fold": "select image_id, rn, [angle] as kept, weight as w from angle_in where rn = 1 union all select o.image_id, o.rn, case when r.w > 0.8 * o.total or len(list_filter(r.kept, lambda k: abs(o.angle - k) < 5)) > 0 then r.kept else list_append(r.kept, o.angle) end, case when r.w > 0.8 * o.total or len(list_filter(r.kept, lambda k: abs(o.angle - k) < 5)) > 0 then r.w else r.w + o.weight end from angle_fold r join angle_in o on o.image_id = r.image_id and o.rn = r.rn + 1",
    "angle_last": "select image_id, arg_max(kept, rn) as kept from angle_fold group by image_id",
    "angle_all": "select image_id, case when len(list_filter(kept, lambda k: abs(k) < 5)) > 0 then kept else list_append(kept, 0) end as kept from angle_last",
}


def _whole_run() -> dict[str, str]:
    """Parts z_* of the whole run: regions of the recognised elements, texts merged in each, and the grouping of what that gives."""
    boxes = "strict_e strict_s strict_r strict region_box region_el loose_e loose_s loose_r loose block_box sweep_in sweep swept".split()
    texts = "g_flag grouped col_in col_fold columned line_flag line_no line row_in row_fold row_text para_flag para_no para".split()
    again = lambda names: {f"z_{n}": re.sub(rf"\b({'|'.join(['el', 'ocr', *names])})\b", r"z_\1", PARTS[n]) for n in names}
    box = ", ".join(f"arg_max({c}, rn) as {c}" for c in ("text", "confidence", "left_x", "top_y", "right_x", "bottom_y"))
    columns = "image_id, element_id, type, text, confidence, left_x, top_y, right_x, bottom_y"
    return {
        "z_el": f"select {columns} from el where length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 2 and confidence >= 0.2",
        **again(boxes),
        "z_region": "select image_id, region_no, unnest(string_split(m, ',')) as block_id from (select image_id, box.m as m, row_number() over (partition by image_id order by box.t, place) as region_no from z_swept)",
        "z_placed": "select e.*, r.region_no as group_id from z_el e join z_strict s using (image_id, element_id) join z_loose l on l.image_id = e.image_id and l.element_id = s.cluster_id join z_region r on r.image_id = e.image_id and r.block_id = cast(l.cluster_id as varchar)",
        "z_merge_in": PARTS["merge_in"].replace("from grouped", "from z_placed"),
        "z_merge_fold": re.sub(r"\b(merge_in|merge_fold)\b", r"z_\1", PARTS["merge_fold"]),
        "z_merged": f"select image_id, group_id, no, {box} from z_merge_fold group by image_id, group_id, no",
        "z_last": "select image_id, max(element_id) as last from z_el group by image_id",
        "z_ocr": f"select image_id, last + row_number() over (partition by image_id order by group_id, no) as element_id, 'text' as type, text, confidence, left_x, top_y, right_x, bottom_y from z_merged join z_last using (image_id) union all select {columns} from z_el where type <> 'text'",
        **again(texts),
    }


PARTS.update(_whole_run())


def sql(body: str) -> str:
    """The query body with the parts it needs, directly or through others, in the order of PARTS."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in set(re.findall(r"\b\w+\b", text)) & PARTS.keys() - needed:
            needed.add(name)
            need(PARTS[name])

    need(body)
    return "with recursive " + ",\n".join(f"{n} as ({t})" for n, t in PARTS.items() if n in needed) + "\n" + body


def query(body: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if body is not None:
            SQL[f.__name__] = sql(body)
        return f

    return add


def _pair_sql(view: str, condition: str, *measures: str) -> str:
    return f"select a.image_id, a.element_id as a_id, b.element_id as b_id{''.join(', ' + m for m in measures)} from {view} a join {view} b on a.image_id = b.image_id and a.element_id < b.element_id and {condition}"


events, docs = source.layout_events, source.layout_docs


# Recognition results and geometry.


@query("select image_id, element_id, text, confidence from el where length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 2 and confidence >= 0.2")
def p4_ocr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.recognised(events(spark, sf_dir)).select("image_id", "element_id", "text", "confidence")


@query("select image_id, element_id, text, cast(left_x as double) + 1 as left_x, cast(top_y as double) - 2 as top_y, cast(right_x as double) + 1 as right_x, cast(bottom_y as double) + 3 as bottom_y from el")
def p5_absolute_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = "array((1, -2), (right_x - left_x, 0), (right_x - left_x + 1, bottom_y - top_y + 3), (1, bottom_y - top_y))"
    box = f"cast({points} as array<struct<x:double,y:double>>) as box"
    found = events(spark, sf_dir).selectExpr("image_id", "element_id", "concat(' ', text, ' ') as text", "confidence", "left_x as roi_x", "top_y as roi_y", box)
    return recognition.absolute_boxes(found).select("image_id", "element_id", "text", "left_x", "top_y", "right_x", "bottom_y")


_CORNERS = "select image_id, element_id, 0 as corner, left_x as x, top_y as y, element_id % 360 as angle from el union all select image_id, element_id, 1, right_x, bottom_y, element_id % 360 from el"


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr("image_id", "element_id", "stack(2, 0L, left_x, top_y, 1L, right_x, bottom_y) as (corner, x, y)", "element_id % 360 as angle")


@query(
    f"""select image_id, element_id, cast(corner as bigint) as corner,
    cast(trunc((x - 800) * cos(radians(cast(angle as double))) - (y - 3000) * sin(radians(cast(angle as double))) + 800) as bigint) as rx,
    cast(trunc((x - 800) * sin(radians(cast(angle as double))) + (y - 3000) * cos(radians(cast(angle as double))) + 3000) as bigint) as ry from ({_CORNERS})"""
)
def p6_rotate_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.rotated_points(_corners(spark, sf_dir), "angle", "800", "3000").select("image_id", "element_id", "corner", "rx", "ry")


@query("select image_id, element_id, row_number() over (partition by image_id order by top_y, left_x, element_id) as place from el")
def p7_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.reading_order(events(spark, sf_dir)).select("image_id", "element_id", "place")


@query(_pair_sql("dense", f"{OWN['inter']} > 0", f"round({OWN['iou']}, 6) as iou"))
def o5_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.near_pairs(events(spark, sf_dir, True), f"{g.intersection()} > 0", 0, iou=f"round({g.iou()}, 6)")


@query(_pair_sql("el", f"{OWN['distance']} <= 3600", f"cast({OWN['distance']} as bigint) as d2"))
def o9_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.near_pairs(events(spark, sf_dir), f"{g.distance_squared()} <= 3600", 60, d2=f"cast({g.distance_squared()} as bigint)")


@query(_pair_sql("dense", OWN["contained"]).replace("a.element_id < b.element_id", "a.element_id <> b.element_id"))
def o10_containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = events(spark, sf_dir, True).select("image_id", "element_id", "left_x", "top_y", "right_x", "bottom_y")
    return pairs.containing_pairs(boxes, boxes, f"a.element_id <> b.element_id and {g.contained()}", "a.image_id as image_id", "a.element_id as a_id", "b.element_id as b_id")


@query(_pair_sql("el", OWN["strict"]))
def c1_connected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.box_pairs(events(spark, sf_dir), g.connected(*clusters.STRICT))


@query(_pair_sql("el", f"{OWN['density']} >= 0.15", f"round({OWN['density']}, 6) as density"))
def c1b_density_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.box_pairs(events(spark, sf_dir), f"{g.density()} >= 0.15", density=f"round({g.density()}, 6)")


@query(_pair_sql("el", OWN["close"]))
def b2_close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.box_pairs(events(spark, sf_dir), g.close_enough(min_y=0.1))


@query(_pair_sql("el", OWN["adjacent"]))
def m3_adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.near_pairs(events(spark, sf_dir), g.adjacent(50), 50)


@query(_pair_sql("dense", f"{OWN['smaller']} > 0.5", f"round({OWN['smaller']}, 6) as overlap"))
def d1_box_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.near_pairs(events(spark, sf_dir, True), f"{g.smaller_overlap()} > 0.5", 0, overlap=f"round({g.smaller_overlap()}, 6)")


def _continues_sql() -> str:
    last = lambda n: f"array_to_string(wa[-{n}:], ' ')"
    first = lambda n: f"array_to_string(wb[1:{n}], ' ')"
    heads = [f"(len(wa) >= {n} and starts_with(b_text, {last(n)}))" for n in (1, 2, 3)]
    tails = [f"(len(wb) >= {n} and ends_with(a_text, {first(n)}))" for n in (1, 2, 3)]
    words = f"select image_id, element_id, text, {WORDS.format(t='text')} as w from docs"
    met = f"select a.image_id, a.element_id as a_id, b.element_id as b_id, a.text as a_text, b.text as b_text, a.w as wa, b.w as wb from ({words}) a join ({words}) b on a.image_id = b.image_id and a.element_id <> b.element_id"
    return f"select image_id, a_id, b_id from ({met}) where {' or '.join(heads + tails)}"


@query(_continues_sql())
def m2_text_continuation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textmerge.continuation_pairs(docs(spark, sf_dir))


@query(
    """select image_id, cand_id as element_id, 'image' as type, cast(trunc(x / scale) as bigint) as left_x, cast(trunc(y / scale) as bigint) as top_y,
    cast(trunc(x / scale) + trunc(w / scale) as bigint) as right_x, cast(trunc(y / scale) + trunc(h / scale) as bigint) as bottom_y, edge_density as confidence
    from cand where w * h >= 5000 * scale * scale and cast(w as double) / h >= 0.2 and cast(w as double) / h <= 5 and edge_density > 0.1 and text_density < 0.3"""
)
def o3_candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.object_candidates(source.candidates(spark, sf_dir))


@query(
    f"""select image_id, element_id, cast(corner as bigint) as corner,
    cast(trunc(cos(radians(-cast(angle as double))) * x + sin(radians(-cast(angle as double))) * y + ((1 - cos(radians(-cast(angle as double)))) * 900 - sin(radians(-cast(angle as double))) * 3100 + (1600 / cast(2 as double) - 900))) as bigint) as ox,
    cast(trunc(-sin(radians(-cast(angle as double))) * x + cos(radians(-cast(angle as double))) * y + (sin(radians(-cast(angle as double))) * 900 + (1 - cos(radians(-cast(angle as double)))) * 3100 + (6000 / cast(2 as double) - 3100))) as bigint) as oy from ({_CORNERS})"""
)
def r5_transform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.points_to_page(_corners(spark, sf_dir), 1600, 6000, "angle", "1801", "6200").select("image_id", "element_id", "corner", "ox", "oy")


@query(
    """select image_id, element_id, text, confidence from dense where length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 2 and confidence > 0.3
    and cast(right_x - left_x as double) / (bottom_y - top_y) > 0.1 and cast(right_x - left_x as double) / (bottom_y - top_y) < 10
    and right_x - left_x > 5 and bottom_y - top_y > 5 and right_x - left_x < 200 * cast(0.9 as double) and bottom_y - top_y < 50 * cast(0.9 as double)"""
)
def r6_rotated_block_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.plausible_rotated(events(spark, sf_dir, True), 200, 50).select("image_id", "element_id", "text", "confidence")


# Clusters.


def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.in_clusters(events(spark, sf_dir), *clusters.STRICT)


@query("select image_id, element_id, cluster_id from strict")
def c2_strict_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strict(spark, sf_dir).select("image_id", "element_id", "cluster_id")


@query("select image_id, cluster_id, left_x, top_y, right_x, bottom_y, n_elements, row_number() over (partition by image_id order by top_y, cluster_id) as region_no from region_box")
def c5_mini_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.regions(_strict(spark, sf_dir))


@query("select image_id, element_id as cluster_id, cluster_id as block_id from loose")
def c7_loose_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.regions(_strict(spark, sf_dir))
    loose = clusters.box_clusters(clusters.as_elements(found), *clusters.LOOSE)
    return loose.select("image_id", F.col("element_id").alias("cluster_id"), F.col("cluster_id").alias("block_id"))


@query(
    """select image_id, l.cluster_id as block_id, min(left_x) as left_x, min(top_y) as top_y, max(right_x) as right_x, max(bottom_y) as bottom_y, count(*) as n_elements
    from el join strict s using (image_id, element_id) join (select image_id, element_id as cid, cluster_id from loose) l using (image_id) where l.cid = s.cluster_id group by image_id, l.cluster_id"""
)
def h1_region_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.union_boxes(clusters.in_blocks(events(spark, sf_dir)), "image_id", "block_id")


@query(
    """select image_id, row_number() over (partition by image_id order by box.t, place) as region_no, box.l as left_x, box.t as top_y, box.r as right_x, box.b as bottom_y,
    cast(box.n as bigint) as n_elements, box.m as members from swept"""
)
def h2_adjacent_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.build_regions(events(spark, sf_dir)).withColumn("members", F.array_join("members", ","))


@query("select image_id, element_id from kept_boxes")
def o4_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaders.without_overlaps(events(spark, sf_dir, True)).select("image_id", "element_id")


@query("select image_id, element_id, seed_id from held")
def o8_contained_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaders.contained_groups(events(spark, sf_dir, True))


@query(
    """select image_id, cluster_id, min(left_x) as left_x, min(top_y) as top_y, max(right_x) as right_x, max(bottom_y) as bottom_y, count(*) as n_elements,
    round(sum(confidence) / count(*), 9) as confidence from near join held_box using (image_id, element_id) group by image_id, cluster_id"""
)
def o6_object_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaders.object_clusters(events(spark, sf_dir, True)).withColumn("confidence", F.round("confidence", 9))


@query(
    """select image_id, cluster_id, min(left_x) as left_x, min(top_y) as top_y, max(right_x) as right_x, max(bottom_y) as bottom_y, count(*) as n_elements,
    round(sum(confidence) / count(*), 6) as confidence from strict join el using (image_id, element_id) group by image_id, cluster_id"""
)
def o7_cluster_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaders.merged(_strict(spark, sf_dir), "cluster_id").withColumn("confidence", F.round("confidence", 6))


@query()
def d2_dedupe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.without_duplicate_texts(docs(spark, sf_dir))


@query("select image_id, element_id, cluster_id, line_no, row_number() over (partition by image_id, cluster_id, line_no order by left_x, top_y, element_id) as place from linewise_fold")
def c4_linewise_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.linewise_order(_strict(spark, sf_dir))


# One-dimensional grouping.


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.region_groups(recognition.recognised(docs(spark, sf_dir)))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.lines(grouping.column_clusters(_grouped(spark, sf_dir)))


@query("select image_id, group_id, left_x, top_y, right_x, bottom_y, n_elements from group_box")
def g1_region_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_boxes(_grouped(spark, sf_dir))


@query(
    """select a.image_id, a.group_id, b.column_id from group_box a join (select image_id, group_id * 1000 + column_id as column_id, min(left_x) as left_x, min(top_y) as top_y,
    max(right_x) as right_x, max(bottom_y) as bottom_y from columned group by image_id, group_id, columned.column_id) b on a.image_id = b.image_id and b.left_x >= a.left_x - 20 and b.right_x <= a.right_x + 20
    and 2 * (least(a.bottom_y, b.bottom_y) - greatest(a.top_y, b.top_y)) > b.bottom_y - b.top_y"""
)
def g2_assign_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _grouped(spark, sf_dir)
    columns = grouping.column_clusters(grouped).withColumn("column_id", F.col("group_id") * 1000 + F.col("column_id"))
    return grouping.assigned_columns(grouping.group_boxes(grouped), clusters.union_boxes(columns, "image_id", "column_id"))


@query("select image_id, group_id, element_id, column_id from columned")
def t1_column_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.column_clusters(_grouped(spark, sf_dir)).select("image_id", "group_id", "element_id", "column_id")


@query("select * from line_view")
def t3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.line_table(_lines(spark, sf_dir))


@query("select image_id, group_id, column_id, line_id, merged_id from line join col_merge using (image_id, group_id, column_id)")
def t4_merge_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.merged_columns(_lines(spark, sf_dir)).select("image_id", "group_id", "column_id", "line_id", "merged_id")


@query("select image_id, group_id, row_id, text from row_text")
def l1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.rows(grouping.merged_columns(_lines(spark, sf_dir)))


@query("select image_id, group_id, para_no, text from para")
def l2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.paragraphs(recognition.recognised(docs(spark, sf_dir)))


@query("select a.image_id, a.group_id, a.column_id, a.line_id, f.g as anchor_id from anchor_in a join anchor_fold f using (image_id, group_id, rn)")
def v3_anchor_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.anchor_columns(grouping.line_table(_lines(spark, sf_dir))).select("image_id", "group_id", "column_id", "line_id", "anchor_id")


# Text, documents, angles, and the whole.


@query("select image_id, element_id, type, text, confidence, left_x, top_y, right_x, bottom_y from el where type = 'text' union all select image_id, element_id, type, null, confidence, left_x, top_y, right_x, bottom_y from el where type = 'image'")
def c0_union_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = events(spark, sf_dir)
    images = elements.where("type = 'image'").drop("text")
    return elements.where("type = 'text'").unionByName(images, allowMissingColumns=True)


@query("select image_id, group_id, no as item_no, arg_max(text, rn) as text, arg_max(confidence, rn) as confidence, arg_max(left_x, rn) as left_x, arg_max(top_y, rn) as top_y, arg_max(right_x, rn) as right_x, arg_max(bottom_y, rn) as bottom_y from merge_fold group by image_id, group_id, no")
def m1_merge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textmerge.merged_texts(_grouped(spark, sf_dir), ["image_id", "group_id"])


@query("select image_id, group_id, string_agg(text, ' ' order by para_no) as text from para group by image_id, group_id")
def w1_region_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.region_texts(plan.paragraphs(recognition.recognised(docs(spark, sf_dir))))


def _descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions as a model would give them."""
    boxes = grouping.group_boxes(_grouped(spark, sf_dir))
    return boxes.selectExpr("image_id", "group_id", "concat('region ', group_id, ' with ', n_elements) as description")


_DESCRIBED = "(select image_id, group_id, concat('region ', group_id, ' with ', n_elements) as description from group_box)"


@query(
    f"""select b.image_id, count(*) over (partition by b.image_id) as total_regions, b.group_id as region_id, top_y as top, bottom_y as bottom, left_x as "left", right_x as "right",
    description as vision_description, p.texts as paragraphs from group_box b join {_DESCRIBED} d using (image_id, group_id)
    left join (select image_id, group_id, string_agg(text, chr(10) order by para_no) as texts from para group by image_id, group_id) p using (image_id, group_id)"""
)
def w2_vision_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = recognition.recognised(docs(spark, sf_dir))
    made = documents.vision_documents(grouping.group_boxes(grouping.region_groups(elements)), _descriptions(spark, sf_dir), plan.paragraphs(elements))
    flat = made.select("image_id", "total_regions", F.explode("regions").alias("r"))
    texts = F.array_join("r.text_content.merged_paragraphs", "\n").alias("paragraphs")
    return flat.select("image_id", "total_regions", "r.region_id", "r.bounds.top", "r.bounds.bottom", "r.bounds.left", "r.bounds.right", "r.vision_description", texts)


@query(
    """select image_id, group_id, side, dash, cast(trunc(px + dx * s) as bigint) as x1, cast(trunc(py + dy * s) as bigint) as y1, cast(trunc(px + dx * e) as bigint) as x2, cast(trunc(py + dy * e) as bigint) as y2
    from (select *, dash * 40 / dist as s, least((dash * 2 + 1) * 20 / dist, cast(1 as double)) as e from (
    select *, unnest(range(greatest(cast(trunc(dist / 40) as bigint), 1))) as dash from (
    select *, qx - px as dx, qy - py as dy, sqrt(cast((qx - px) * (qx - px) + (qy - py) * (qy - py) as double)) as dist from (
    select image_id, group_id, cast(0 as bigint) as side, left_x as px, top_y as py, right_x as qx, top_y as qy from group_box
    union all select image_id, group_id, 1, right_x, top_y, right_x, bottom_y from group_box
    union all select image_id, group_id, 2, right_x, bottom_y, left_x, bottom_y from group_box
    union all select image_id, group_id, 3, left_x, bottom_y, left_x, top_y from group_box)) where dist > 0))"""
)
def w4_dash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.dash_segments(grouping.group_boxes(_grouped(spark, sf_dir)))


@query(
    f"""select image_id, group_id, concat('{{"model":"{documents.MODEL}","messages":[{{"role":"user","content":[{{"type":"text","text":"{documents.REGION_PROMPT}"}},{{"type":"image_url","image_url":"data:image/jpeg;base64,',
    to_base64(encode(description)), '"}}]}}]}}') as prompt from {_DESCRIBED}"""
)
def v4_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops = _descriptions(spark, sf_dir).selectExpr("image_id", "group_id", "cast(description as binary) as picture")
    return documents.region_prompts(crops)


_SUMMARY = f"""select image_id, concat('{documents.SUMMARY_PROMPT}', chr(10), chr(10), string_agg(concat('Section ', k, ': ', description), concat(chr(10), chr(10)) order by k)) as text
    from (select *, row_number() over (partition by image_id order by group_id) as k from {_DESCRIBED}) group by image_id"""


@query(_SUMMARY)
def v6_summary_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.summary_texts(_descriptions(spark, sf_dir))


def _reader() -> Callable[[str], str]:
    """Stands for a model: it reads what the prompt's picture says."""

    def call(prompt: str) -> str:
        said = base64.b64decode(json.loads(prompt)["messages"][0]["content"][1]["image_url"].split(",", 1)[1]).decode()
        return json.dumps({"choices": [{"message": {"content": f"seen: {said}"}}]}, ensure_ascii=False)

    return call


@query(f"select image_id, group_id, concat('seen: ', description) as description from {_DESCRIBED}")
def v5_ledger_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    answers = Ledger(folder).answered(v4_prompt(spark, sf_dir), _reader)
    return answers.select("image_id", "group_id", documents.response_text("response").alias("description"))


def _measurer() -> Callable[[str], str]:
    return lambda text: f"{len(text)} characters"


@query(f"select image_id, concat(length(text), ' characters') as answer from ({_SUMMARY})")
def v6_answers_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    tablefunctions.register_model(spark, "measured", _measurer)
    return spark.sql("select image_id, response as answer from measured(table({asked}), 'text')", asked=v6_summary_prompt(spark, sf_dir))


def _page_summary(elements: DataFrame) -> DataFrame:
    """image_id, box, n_elements, text: what there is on each page, in reading order."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top_y", "left_x", "element_id", "text"))), lambda t: t["text"]), " ")
    return elements.groupBy("image_id").agg(*(f(c).alias(c) for f, c in ((F.min, "left_x"), (F.min, "top_y"), (F.max, "right_x"), (F.max, "bottom_y"))), F.count("*").alias("n_elements"), texts.alias("text"))


@query("select image_id, min(left_x) as left_x, min(top_y) as top_y, max(right_x) as right_x, max(bottom_y) as bottom_y, count(*) as n_elements, string_agg(text, ' ' order by top_y, left_x, element_id) as text from el group by image_id")
def s13_streamed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements in files that split their pages, read as a stream of several batches; each page is laid out once it is complete."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    number = F.count("*").over(Window.partitionBy("image_id")).alias("n")
    rows = events(spark, sf_dir).select("*", number, F.current_timestamp().alias("at"))
    rows.repartition(max(6, spark.sparkContext.defaultParallelism), "element_id").write.parquet(f"{folder}/in")
    files = len(spark.read.parquet(f"{folder}/in").inputFiles())
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files // 3)).parquet(f"{folder}/in")
    streamed.write_pages(streamed.assembled(stream, "at", "n"), f"{folder}/out", f"{folder}/state", _page_summary).awaitTermination()
    found = cut(streamed.current(spark, f"{folder}/out"))
    remove(spark, folder)
    return found


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr("image_id", "element_id as line_id", "left_x as x1", "top_y as y1", "right_x as x2", "bottom_y as y2")


@query("select image_id, angle, round(weight, 6) as weight from histogram")
def r1_angle_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.angle_histogram(_segments(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(
    """select image_id, place, angle from (select image_id, angle, row_number() over (partition by image_id order by abs(angle), i) as place
    from (select image_id, unnest(kept) as angle, unnest(range(len(kept))) as i from angle_all)) where place <= 4"""
)
def r2_major_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.major_angles(recognition.angle_histogram(_segments(spark, sf_dir)))


@query("select image_id, cast(unnest(range(1, len(ms) + 1)) as bigint) as place, round(unnest(ms), 9) as angle from kept_snap")
def r3_angle_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    angles = events(spark, sf_dir).selectExpr("image_id", "element_id as line_id", "cast((element_id * 37) % 360 - 180 as double) as angle")
    return recognition.angle_clusters(angles).withColumn("angle", F.round("angle", 9))


@query("select image_id, group_id, string_agg(text, ' ' order by z_para_no) as text from z_para group by image_id, group_id")
def a2_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.run(events(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w1_region_text(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
