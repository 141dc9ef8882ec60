"""DuckDB SQL for every registered query that has one, built from shared CTEs."""

from __future__ import annotations

from ..operators.requests import PROMPT
from ..schema import FIELDS, OVERALL_FIELDS, RECEIPT
from . import roundtrips
from .fixtures import MODELS

# --- CTEs: receipts ---------------------------------------------------------

ITEMS = """
item AS (
  SELECT l_orderkey AS receipt_id, l_orderkey AS order_key, name, quantity, total,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY no, name, quantity, total) AS line
  FROM (SELECT l_orderkey, l_linenumber AS no, p_name || ' ' || p_brand || ' ' || p_type AS name,
          l_quantity AS quantity, l_extendedprice AS total
        FROM lineitem JOIN part ON l_partkey = p_partkey))"""

GT = f"""{ITEMS},
gt AS (
  SELECT o_orderkey AS receipt_id, o_orderkey AS order_key,
         n_name || ' ' || c_mktsegment AS store, strftime(o_orderdate, '%Y-%m-%d') AS date,
         o_totalprice AS total
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

KEYS = f"""{ITEMS},
gt AS (SELECT o_orderkey AS receipt_id, o_orderkey AS order_key FROM orders)"""

_MODEL_ROWS = ", ".join(f"('{m}', {i})" for i, m in enumerate(MODELS))

PRED = f"""
model AS (SELECT * FROM (VALUES {_MODEL_ROWS}) t(model_id, salt)),
pred_head AS (
  SELECT receipt_id, model_id,
    CASE WHEN (order_key + salt) % 5 = 0 THEN array_to_string(list_reverse(string_split(store, ' ')), ' ')
         WHEN (order_key + salt) % 5 = 1 THEN string_split(store, ' ')[1]
         WHEN (order_key + salt) % 17 = 0 THEN NULL ELSE store END AS store,
    CASE WHEN order_key % 13 = 0 THEN total WHEN order_key % 7 = 0 THEN total * 1.03 ELSE total END AS total
  FROM gt, model WHERE order_key % 11 <> 0),
edit AS (
  SELECT receipt_id, model_id, line, name, quantity, total, (order_key * 7 + line + salt) % 10 AS kind,
         string_split(name, ' ') AS tok
  FROM item, model WHERE order_key % 11 <> 0),
pred_item AS (
  SELECT receipt_id, model_id, line AS source_line,
    row_number() OVER (PARTITION BY receipt_id, model_id ORDER BY line) AS pos,
    CASE kind WHEN 1 THEN array_to_string(list_reverse(tok), ' ')
              WHEN 2 THEN array_to_string(list_slice(tok, 1, len(tok) - 1), ' ')
              WHEN 6 THEN 'UNKNOWN' ELSE name END AS name,
    CASE kind WHEN 5 THEN CAST(quantity + 1 AS VARCHAR) WHEN 8 THEN CAST(CAST(quantity AS BIGINT) AS VARCHAR)
              ELSE CAST(quantity AS VARCHAR) END AS quantity,
    CASE kind WHEN 3 THEN total * 1.015 WHEN 4 THEN total * 1.05 ELSE total END AS price
  FROM edit WHERE kind <> 0)"""


def _key(name: str) -> str:
    return (
        "array_to_string(list_sort(list_filter("
        f"string_split_regex(lower(coalesce({name}, '')), '\\s+'), lambda t: t <> '')), ' ')"
    )


def lcs(pairs: str) -> str:
    """``ratio(ka, kb, ratio)`` for the distinct key pairs of a query, by bit-parallel LCS."""
    return f"""
kp AS ({pairs}),
chars AS (
  SELECT k, substr(k, i, 1) AS ch, bit_or(CAST(1 AS HUGEINT) << (i - 1)) AS m
  FROM (SELECT k, unnest(range(1, length(k) + 1)) AS i FROM (SELECT DISTINCT ka AS k FROM kp))
  GROUP BY ALL),
walk(ka, kb, done, s) AS (
  SELECT ka, kb, 0, (CAST(1 AS HUGEINT) << length(ka)) - 1 FROM kp
  UNION ALL
  SELECT w.ka, w.kb, done + 1,
    ((s + (s & coalesce(m, 0))) | (s - (s & coalesce(m, 0)))) & ((CAST(1 AS HUGEINT) << length(w.ka)) - 1)
  FROM walk w LEFT JOIN chars c ON c.k = w.ka AND c.ch = substr(w.kb, done + 1, 1)
  WHERE done < length(w.kb)),
ratio AS (
  SELECT ka, kb,
    CASE WHEN length(ka) + length(kb) = 0 THEN 100.0 ELSE
    (1.0 - CAST(length(ka) + length(kb) - 2 * (length(ka) - bit_count(s)) AS DOUBLE)
           / (length(ka) + length(kb))) * 100.0 END AS ratio
  FROM walk WHERE done = length(kb))"""


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes)


ITEM_PAIRS = f"""
pk AS (SELECT *, {_key('name')} AS k FROM pred_item),
gk AS (SELECT *, {_key('name')} AS k FROM item),
""" + lcs("SELECT DISTINCT pk.k AS ka, gk.k AS kb FROM pk JOIN gk USING (receipt_id)").lstrip()

CANDIDATES = """
cand AS (
  SELECT pk.receipt_id, pk.model_id, pk.pos, gk.line, ratio
  FROM pk JOIN gk USING (receipt_id) JOIN ratio ON ka = pk.k AND kb = gk.k)"""

GREEDY = """
wish AS (
  SELECT receipt_id, model_id, pos, list(line ORDER BY ratio DESC, line) FILTER (WHERE ratio >= 70) AS lines
  FROM cand GROUP BY ALL),
fold(receipt_id, model_id, pos, used, pick) AS (
  SELECT DISTINCT receipt_id, model_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM wish
  UNION ALL
  SELECT receipt_id, model_id, pos,
         CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick
  FROM (SELECT f.receipt_id, f.model_id, w.pos, f.used,
               list_filter(w.lines, lambda j: NOT list_contains(f.used, j))[1] AS pick
        FROM fold f JOIN wish w ON w.receipt_id = f.receipt_id AND w.model_id = f.model_id AND w.pos = f.pos + 1)),
hit AS (SELECT receipt_id, model_id, pos, pick AS line FROM fold WHERE pick IS NOT NULL)"""

STORES = """
store_pair AS (
  SELECT gt.receipt_id, m.model_id, p.store AS p_store, gt.store AS g_store, {pk} AS pk, {gk} AS gk
  FROM gt CROSS JOIN model m LEFT JOIN pred_head p ON p.receipt_id = gt.receipt_id AND p.model_id = m.model_id)""".format(
    pk=_key("p.store"), gk=_key("gt.store")
)


def _prf(hits: str, n_pred: str, n_gt: str) -> tuple[str, str, str]:
    p = f"(CASE WHEN {n_pred} > 0 THEN CAST({hits} AS DOUBLE) / {n_pred} ELSE 0.0 END)"
    r = f"(CASE WHEN {n_gt} > 0 THEN CAST({hits} AS DOUBLE) / {n_gt} ELSE 0.0 END)"
    return p, r, f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"


def _near(p: str, g: str) -> str:
    return f"(CASE WHEN {p} IS NULL OR {g} IS NULL THEN false WHEN {g} = 0 THEN {p} = 0 ELSE abs({p} - {g}) / abs({g}) <= 0.02 END)"


# One row per receipt and model with the presence and hit counts of every field.
COUNTS = f"""
both_lines AS (
  SELECT h.receipt_id, h.model_id, count(*) AS name_hits,
    count(*) FILTER (WHERE {_near('p.price', 'g.total')}) AS total_hits,
    count(*) FILTER (WHERE p.quantity = CAST(g.quantity AS VARCHAR)) AS qty_hits
  FROM hit h JOIN pred_item p USING (receipt_id, model_id, pos)
  JOIN item g ON g.receipt_id = h.receipt_id AND g.line = h.line GROUP BY ALL),
n_p AS (SELECT receipt_id, model_id, count(*) AS n FROM pred_item GROUP BY ALL),
n_g AS (SELECT receipt_id, count(*) AS n FROM item GROUP BY ALL),
store_ratio AS (
  SELECT s.*, r.ratio FROM store_pair s JOIN ratio r ON r.ka = s.pk AND r.kb = s.gk),
counts AS (
  SELECT gt.receipt_id, m.model_id,
    CAST(s.p_store IS NOT NULL AS INT) AS store_p, 1 AS store_g,
    CAST(s.p_store IS NOT NULL AND s.ratio >= 80 AS INT) AS store_hits,
    CAST(ph.total IS NOT NULL AS INT) AS total_p, 1 AS total_g,
    CAST({_near('ph.total', 'gt.total')} AS INT) AS total_hit,
    coalesce(n_p.n, 0) AS np, coalesce(n_g.n, 0) AS ng,
    coalesce(b.name_hits, 0) AS name_hits, coalesce(b.total_hits, 0) AS total_hits, coalesce(b.qty_hits, 0) AS qty_hits
  FROM gt CROSS JOIN model m
  LEFT JOIN store_ratio s ON s.receipt_id = gt.receipt_id AND s.model_id = m.model_id
  LEFT JOIN pred_head ph ON ph.receipt_id = gt.receipt_id AND ph.model_id = m.model_id
  LEFT JOIN n_p ON n_p.receipt_id = gt.receipt_id AND n_p.model_id = m.model_id
  LEFT JOIN n_g ON n_g.receipt_id = gt.receipt_id
  LEFT JOIN both_lines b ON b.receipt_id = gt.receipt_id AND b.model_id = m.model_id)"""

_SHAPES = {
    "store_name": ("store_hits", "store_p", "store_g"),
    "total": ("total_hit", "total_p", "total_g"),
    "item_name": ("name_hits", "np", "ng"),
    "item_total": ("total_hits", "np", "ng"),
    "item_qty": ("qty_hits", "np", "ng"),
}


def _scores() -> str:
    columns = []
    for field in FIELDS:
        if field == "item_count":
            same = "CAST(CAST(np = ng AS INT) AS DOUBLE)"
            some = "CAST(np + ng > 0 AS INT)"
            columns += [f"{same} AS item_count_{p}" for p in ("p", "r", "f1")]
            columns += [f"{some} AS item_count_np", f"{some} AS item_count_ng"]
            continue
        hits, n_pred, n_gt = _SHAPES[field]
        for tag, sql in zip(("p", "r", "f1"), _prf(hits, n_pred, n_gt)):
            columns.append(f"{sql} AS {field}_{tag}")
        columns += [f"{n_pred} AS {field}_np", f"{n_gt} AS {field}_ng"]
    mean = " + ".join(f"{f}_f1" for f in OVERALL_FIELDS)
    return (
        f"scores0 AS (SELECT receipt_id, model_id, {', '.join(columns)} FROM counts), "
        f"scores AS (SELECT *, ({mean}) / 5 AS overall_f1 FROM scores0)"
    )


ONE_MODEL = PRED.replace(_MODEL_ROWS, f"('{MODELS[0]}', 0)")


def _scored(pred: str, tail: str) -> str:
    pairs = (
        "SELECT DISTINCT pk.k AS ka, gk.k AS kb FROM pk JOIN gk USING (receipt_id) "
        "UNION SELECT DISTINCT pk, gk FROM store_pair"
    )
    names = f"""
pk AS (SELECT *, {_key('name')} AS k FROM pred_item),
gk AS (SELECT *, {_key('name')} AS k FROM item)"""
    return _with(GT, pred, names, STORES, lcs(pairs), CANDIDATES, GREEDY, COUNTS, _scores()) + tail


def _paired(pred: str, *more: str) -> str:
    return _with(GT, pred, ITEM_PAIRS, CANDIDATES, *more)


def _summary(rows: str) -> str:
    """Long-form means from a wide one-row select named ``m``."""
    parts = [
        f"SELECT '{f}' AS field, round({f}_p, 6) AS precision, round({f}_r, 6) AS recall, "
        f"round({f}_f1, 6) AS f1, CAST({f}_np AS BIGINT) AS n_pred, CAST({f}_ng AS BIGINT) AS n_gt FROM m"
        for f in FIELDS
    ]
    mean = " + ".join(f"{f}_f1" for f in OVERALL_FIELDS)
    parts.append(f"SELECT 'overall', NULL, NULL, round(({mean}) / 5, 6), NULL, NULL FROM m")
    return f", m AS ({rows}) " + " UNION ALL ".join(parts)


def _means(source: str) -> str:
    columns = [f"avg({f}_{t}) AS {f}_{t}" for f in FIELDS for t in ("p", "r", "f1")]
    columns += [f"sum({f}_{t}) AS {f}_{t}" for f in FIELDS for t in ("np", "ng")]
    return f"SELECT {', '.join(columns)} FROM {source}"


# --- numbers ----------------------------------------------------------------

_D = r"[0-9]+(?:_[0-9]+)*"
_FLOAT = rf"^\s*([+-]?(?:(?:{_D})\.?(?:{_D})?|\.{_D})(?:[eE][+-]?{_D})?|[+-]?(?i:inf|infinity|nan))\s*$"


def _double(x: str) -> str:
    return f"try_cast(nullif(replace(regexp_extract({x}, '{_FLOAT}', 1), '_', ''), '') AS DOUBLE)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def n_metric(x: str) -> str:
    return _double(f"translate({x}, ',$£', '')")


def n_locale(x: str) -> str:
    body = _strip(f"regexp_replace({_strip(x)}, '^[RrpP ]+', '')")
    plain = (
        f"CASE WHEN contains({body}, ',') AND contains({body}, '.') AND regexp_matches({body}, ',[^.]*$') "
        f"THEN replace(replace({body}, '.', ''), ',', '.') ELSE replace({body}, ',', '') END"
    )
    return f"coalesce({_double(f'trim({plain}, chr(32) || chr(44) || chr(46))')}, 0.0)"


def n_cord(x: str) -> str:
    body = f"replace(regexp_replace({_strip(x)}, '(?i)^(Rp\\.?|KRW|₩|\\$|£|€)\\s*', ''), ',', '')"
    return _double(f"regexp_replace({body}, '[^0-9.+-]', '', 'g')")


def n_serving(x: str) -> str:
    kept = f"regexp_replace({x}, '[^0-9.,]', '', 'g')"
    plain = (
        f"CASE WHEN contains({kept}, ',') AND contains({kept}, '.') THEN "
        f"CASE WHEN instr({kept}, ',') < instr({kept}, '.') THEN replace({kept}, ',', '') "
        f"ELSE replace(replace({kept}, '.', ''), ',', '.') END ELSE replace({kept}, ',', '.') END"
    )
    return f"coalesce({_double(plain)}, 0.0)"


def q_corpus(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 1.0 ELSE {n_locale(x)} END"


def q_eval(x: str) -> str:
    return f"coalesce({_double(x)}, 1.0)"


def q_serving(x: str) -> str:
    return f"coalesce(nullif({n_serving(x)}, 0.0), 1.0)"


def printed(amount: str, style: str) -> str:
    g = f"format('{{:,.2f}}', {amount})"
    whole = f"format('{{:,.0f}}', {amount})"
    return (
        f"CASE {style} WHEN 0 THEN {g} WHEN 1 THEN translate({g}, ',.', '.,') "
        f"WHEN 2 THEN 'Rp ' || replace({whole}, ',', '.') WHEN 3 THEN CAST({amount} AS VARCHAR) "
        f"WHEN 4 THEN '$' || {g} WHEN 5 THEN '₩' || {whole} || '원' WHEN 6 THEN 'abc ' || {g} "
        f"ELSE '£' || CAST({amount} AS VARCHAR) END"
    )


# --- raw corpora ------------------------------------------------------------

CORD_LINES = f"""
cord_line AS (
  SELECT receipt_id, order_key, line, (order_key + line - 1) % 5 AS kind, name,
    CASE (order_key + line - 1) % 5 WHEN 0 THEN '' WHEN 1 THEN 'x2' WHEN 2 THEN CAST(quantity AS VARCHAR) END AS cnt,
    CASE WHEN (order_key + line - 1) % 5 <> 3 THEN {printed('total / 2', 'order_key % 8')} END AS unitprice,
    {printed('total', 'order_key % 8')} AS price
  FROM item),
cord AS (
  SELECT receipt_id, order_key,
    CASE WHEN order_key % 6 <> 0 AND order_key % 23 <> 0 THEN store END AS storenm,
    CASE WHEN order_key % 23 <> 0 THEN {printed('total', 'order_key % 8')} END AS subtotal_price,
    {printed('total', 'order_key % 8')} AS total_price
  FROM gt)"""

CORD_OUT = f"""
cord_items AS (
  SELECT receipt_id, count(*) AS n, max(line) AS last, sum({n_locale('price')}) AS item_total
  FROM cord_line GROUP BY ALL),
cord_out AS (
  SELECT receipt_id, order_key, order_key % 23 = 0 AS bad, coalesce(storenm, 'UNKNOWN') AS store,
    {n_locale('total_price')} AS total, nullif({n_locale('subtotal_price')}, 0.0) AS subtotal,
    coalesce(n, 1) AS n_items, coalesce(last + CAST(order_key % 9 = 0 AS INT), 1) AS last_line,
    coalesce(item_total, 0.0) AS item_total
  FROM cord LEFT JOIN cord_items USING (receipt_id) WHERE order_key % 37 <> 0)"""

SROIE_OUT = f"""
sroie AS (
  SELECT *,
    CASE WHEN order_key % 7 IN (2, 3) THEN 'UNKNOWN' WHEN order_key % 7 = 1 THEN 'None' ELSE store END AS company,
    CASE WHEN order_key % 5 = 0 THEN '1970-01-01' ELSE date END AS day,
    CASE WHEN order_key % 11 = 0 THEN NULL WHEN order_key % 11 IN (1, 2) THEN 0.0 ELSE total END AS amount
  FROM gt),
sroie_out AS (
  SELECT receipt_id, order_key,
    CASE WHEN order_key % 29 = 0 THEN 'not a JSON object'
         WHEN order_key % 31 = 0 THEN NULL
         WHEN order_key % 11 = 0 THEN 'total is not a number' END AS error,
    CASE WHEN order_key % 31 = 0 THEN 'UNKNOWN' ELSE company END AS store,
    CASE WHEN order_key % 31 = 0 THEN '1970-01-01' ELSE day END AS date,
    CASE WHEN order_key % 31 = 0 THEN 0.0 ELSE amount END AS total
  FROM sroie)"""


def _remap(store: str, total: str, name: str, qty: str, unit: str, price: str, empty: str) -> str:
    return f"""
SELECT receipt_id, {store} AS store, round({total}, 6) AS receipt_total, CAST(line AS INT) AS line_number,
  {name} AS name, round({qty}, 6) AS quantity, round({unit}, 6) AS unit_price, round({price}, 6) AS total
FROM cord JOIN cord_line USING (receipt_id)
UNION ALL
SELECT receipt_id, {store}, round({total}, 6), {empty}
FROM cord WHERE receipt_id NOT IN (SELECT receipt_id FROM cord_line)"""


# --- receipts as JSON -------------------------------------------------------

RECEIPT_JSON = """
item_json AS (
  SELECT receipt_id, string_agg(
    '{"line_number":' || (line - CAST(order_key % 16 = 9 AS INT)) || ',"name":"' || name || '",' ||
    CASE WHEN order_key % 16 = 7 THEN '"quantity":null' ELSE '"quantity":' || quantity END || ',' ||
    CASE WHEN order_key % 16 = 8 THEN '"unit":"box"' ELSE '"unit":"each"' END || ',"total":' || total || '}',
    ',' ORDER BY line) AS j
  FROM item GROUP BY ALL),
doc AS (
  SELECT receipt_id, order_key, order_key % 16 AS k, CAST('{' || concat_ws(',',
    CASE order_key % 16 WHEN 1 THEN NULL WHEN 2 THEN '"store":{}' ELSE '"store":{"name":"' || store || '"}' END,
    CASE order_key % 16 WHEN 4 THEN NULL WHEN 3 THEN '"date":5' ELSE '"date":"' || date || '"' END,
    CASE order_key % 16 WHEN 5 THEN '"items":[]' WHEN 6 THEN '"items":{}' ELSE '"items":[' || coalesce(j, '') || ']' END,
    CASE order_key % 16 WHEN 11 THEN NULL WHEN 10 THEN '"total":"12"' ELSE '"total":' || total END,
    CASE order_key % 16 WHEN 12 THEN '"currency":"usd"' ELSE '"currency":"USD"' END,
    CASE order_key % 16 WHEN 13 THEN '"payment":{"method":"barter"}' WHEN 14 THEN '"metadata":{"source":"web"}'
                        WHEN 15 THEN '"loyalty":{"points_earned":true}' END) || '}' AS JSON) AS j
  FROM gt LEFT JOIN item_json USING (receipt_id))"""

_NUM = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')"


def _each(test: str) -> str:
    return (
        "coalesce(CASE WHEN json_type(j, '$.items') = 'ARRAY' THEN "
        f"len(list_filter(CAST(json_extract(j, '$.items') AS JSON[]), lambda i: {test})) > 0 END, false)"
    )


# Rules the derived receipts can break, in rule order.
_RULES = [
    ("store is required", "json_type(j, '$.store') IS NULL"),
    ("date is required", "json_type(j, '$.date') IS NULL"),
    ("items is required", "json_type(j, '$.items') IS NULL"),
    ("total is required", "json_type(j, '$.total') IS NULL"),
    ("store.name is required", "json_type(j, '$.store') = 'OBJECT' AND json_type(j, '$.store.name') IS NULL"),
    ("date must be text", "json_type(j, '$.date') <> 'VARCHAR'"),
    ("items must be a list", "json_type(j, '$.items') <> 'ARRAY'"),
    ("items must not be empty", "json_type(j, '$.items') = 'ARRAY' AND json_array_length(j, '$.items') = 0"),
    ("line_number must be an integer from 1", _each("CAST(json_extract(i, '$.line_number') AS DOUBLE) < 1")),
    ("quantity must be a number", _each(f"json_type(i, '$.quantity') NOT IN {_NUM}")),
    ("unit is not known", _each("json_extract_string(i, '$.unit') NOT IN ('each', 'lb', 'kg', 'oz', 'g', 'L', 'mL', 'fl_oz', 'pack', 'bunch', 'other')")),
    ("total must be a number", f"json_type(j, '$.total') NOT IN {_NUM}"),
    ("currency must be three capitals", "NOT regexp_matches(json_extract_string(j, '$.currency'), '^[A-Z]{3}$')"),
    ("payment.method is not known", "json_extract_string(j, '$.payment.method') NOT IN ('card', 'cash', 'contactless', 'mobile_wallet', 'gift_card', 'other')"),
    ("loyalty is malformed", f"json_type(j, '$.loyalty.points_earned') NOT IN {_NUM}"),
    ("metadata is malformed", "json_extract_string(j, '$.metadata.source') NOT IN ('user_scan', 'sroie', 'cord', 'synthetic', 'other')"),
]
CHECKED = (
    "checked AS (SELECT receipt_id, order_key, list_filter(["
    + ", ".join(f"CASE WHEN {test} THEN '{msg}' END" for msg, test in _RULES)
    + "], lambda v: v IS NOT NULL) AS v FROM doc)"
)

# --- images -----------------------------------------------------------------

IMAGES = """
record AS (
  SELECT receipt_id, row_number() OVER (ORDER BY receipt_id) - 1 AS ordinal FROM gt),
named AS (
  SELECT receipt_id, CASE WHEN receipt_id % 3 <> 0 THEN 'receipt_' || receipt_id || '.jpg'
                          ELSE format('cord_{:05d}.jpg', ordinal) END AS image_name FROM record),
image AS (
  SELECT DISTINCT 'receipt_' || l_orderkey || '.jpg' AS image_name FROM lineitem
  UNION SELECT DISTINCT format('cord_{:05d}.jpg', p_partkey) FROM part),
resolved AS (
  SELECT n.receipt_id, n.image_name, i.image_name IS NOT NULL AS exists FROM named n LEFT JOIN image i USING (image_name))"""

_STATE = (
    "CASE event_type WHEN 'view' THEN 'STARTED' WHEN 'signup' THEN 'PENDING' WHEN 'purchase' THEN 'SUCCESS' "
    "WHEN 'error' THEN 'FAILURE' WHEN 'click' THEN 'RETRY' END"
)

JOB_STATUS = f"""
SELECT user_id AS job_id,
  CASE state WHEN 'PENDING' THEN 'pending' WHEN 'SUCCESS' THEN 'done' WHEN 'FAILURE' THEN 'failed' ELSE lower(state) END AS status,
  CASE WHEN state IN ('SUCCESS', 'FAILURE') THEN props END AS result
FROM (SELECT *, {_STATE} AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1"""

# --- responses --------------------------------------------------------------

RESPONSES = r"""
answer AS (
  SELECT conv_id, turn, CASE (conv_id + turn) % 6
    WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```' || chr(10)
    WHEN 1 THEN body WHEN 2 THEN body || chr(10) || 'Hope this helps.'
    WHEN 3 THEN '```' || chr(10) || body WHEN 4 THEN '[1, 2]' ELSE text END AS t
  FROM (SELECT *, CAST(to_json({'store': text, 'total': conv_id}) AS VARCHAR) AS body FROM conversations)),
bare AS (
  SELECT conv_id, turn, CASE WHEN starts_with(t, '```')
    THEN regexp_replace(regexp_replace(t, '^```[^\n]*\n?', ''), '\n```\s*$', '') ELSE t END AS t FROM answer),
parsed AS (
  SELECT conv_id, turn, t, CASE WHEN NOT json_valid(t) OR json_type(t) = 'NULL' THEN 'invalid'
    WHEN json_type(t) = 'OBJECT' THEN 'ok' ELSE 'not_object' END AS status FROM bare)"""

_OCR_HEAD = r"""
SELECT doc_id, CASE doc_id % 6
  WHEN 0 THEN '12/03/2024' || chr(10) || chr(10) || '  Corner Shop  ' || chr(10) || 'TOTAL: $' || price || chr(10)
  WHEN 1 THEN 'Corner Shop' || chr(10) || 'SUBTOTAL 5.00' || chr(10) || 'TOTAL ' || price || chr(10)
  WHEN 2 THEN chr(10) || ' 10:30 ' || chr(10) || 'Amount due: ' || price || chr(10)
  WHEN 3 THEN 'tea 3.50' || chr(10) || 'bread ' || price || chr(10)
  WHEN 4 THEN 'Grand Total amount  ' || price || chr(10) ELSE '' END || text AS text
FROM (SELECT doc_id, text, format('{:,.2f}', doc_id * 1.25 + 0.5) AS price FROM documents)"""

_SCORE_RECORD = {"p": 1.0, "r": 0.5, "f1": 0.75, "np": 1, "ng": 2}


def _restored() -> str:
    cells = []
    for f in FIELDS:
        for tag, value in _SCORE_RECORD.items():
            hit = {"store_name": "o_orderkey % 3 = 0", "total": "o_orderkey % 3 = 1"}.get(f)
            if f == "item_qty" and tag == "f1":
                hit, value = "o_orderkey % 3 = 1", 0.25
            cells.append(f"CASE WHEN {hit or 'false'} THEN {value} ELSE 0 END AS {f}_{tag}")
    return f"SELECT {', '.join(cells)} FROM orders"


def _prf_out(hits: str, n_pred: str, n_gt: str) -> str:
    p, r, f1 = _prf(hits, n_pred, n_gt)
    return (
        f" SELECT receipt_id, round({p}, 6) AS precision, round({r}, 6) AS recall, round({f1}, 6) AS f1, "
        f"CAST({n_pred} AS BIGINT) AS n_pred, CAST({n_gt} AS BIGINT) AS n_gt FROM counts"
    )


def _f1s(fields) -> str:
    return ", ".join(f"round({f}_f1, 6) AS {f}_f1" for f in fields)


def build() -> dict[str, str]:
    tags = "'^\\s+|\\s+$', '', 'g'"
    sql = {
        "parse_amounts": f"""
SELECT receipt_id, raw, {n_metric('raw')} AS n_metric, {n_locale('raw')} AS n_locale,
  {n_cord('raw')} AS n_cord, {n_serving('raw')} AS n_serving
FROM (SELECT o_orderkey AS receipt_id, {printed('o_totalprice', 'o_orderkey % 8')} AS raw FROM orders)""",
        "default_quantities": f"""
WITH {ITEMS} SELECT receipt_id, CAST(line AS INT) AS line_number, {q_corpus('q')} AS qty_gt, {q_eval('q')} AS qty_eval,
  {q_serving('q')} AS qty_serving, nullif(p, 0.0) AS unit_price
FROM (SELECT receipt_id, line, CASE (order_key + line) % 6 WHEN 0 THEN CAST(quantity AS VARCHAR) WHEN 1 THEN ''
        WHEN 3 THEN 'x' WHEN 4 THEN '0' WHEN 5 THEN '1,5' END AS q,
        CASE WHEN line % 3 = 0 THEN 0.0 ELSE total END AS p FROM item)""",
        "numeric_match": _with(GT, PRED)
        + f""" SELECT gt.receipt_id, m.model_id, p.total AS pred_total, gt.total AS gt_total,
  {_near('p.total', 'gt.total')} AS is_match
FROM gt CROSS JOIN model m LEFT JOIN pred_head p ON p.receipt_id = gt.receipt_id AND p.model_id = m.model_id""",
        "token_sort_ratio": _with(
            GT,
            PRED,
            f"names AS (SELECT DISTINCT p.name AS name_a, g.name AS name_b, {_key('p.name')} AS a, {_key('g.name')} AS b "
            "FROM pred_item p JOIN item g ON g.receipt_id = p.receipt_id AND g.line = p.source_line)",
            lcs("SELECT DISTINCT a AS ka, b AS kb FROM names"),
        )
        + " SELECT name_a, name_b, round(ratio, 6) AS ratio FROM names JOIN ratio ON ka = a AND kb = b",
        "best_candidates": _paired(PRED)
        + """ SELECT receipt_id, model_id, CAST(pos AS INT) AS pred_line, CAST(line AS INT) AS gt_line, round(ratio, 6) AS ratio
FROM (SELECT *, row_number() OVER (PARTITION BY receipt_id, model_id, pos ORDER BY ratio DESC, line) AS rn FROM cand) WHERE rn = 1""",
        "greedy_item_pairs": _paired(PRED, GREEDY)
        + " SELECT receipt_id, model_id, CAST(pos AS INT) AS pred_line, CAST(line AS INT) AS gt_line FROM hit",
        "score_store": _scored(ONE_MODEL, _prf_out("store_hits", "store_p", "store_g")),
        "score_total": _scored(ONE_MODEL, _prf_out("total_hit", "total_p", "total_g")),
        "score_items": _scored(
            ONE_MODEL,
            " SELECT receipt_id, "
            + ", ".join(
                f"round({f}_{tag}, 6) AS {f}_{part}"
                for f in FIELDS
                if f.startswith("item_")
                for tag, part in (("p", "precision"), ("r", "recall"), ("f1", "f1"))
            )
            + ", "
            "CAST(item_name_np AS BIGINT) AS n_pred, CAST(item_name_ng AS BIGINT) AS n_gt FROM scores",
        ),
        "score_receipts": _scored(
            ONE_MODEL, f" SELECT receipt_id, {_f1s(FIELDS)}, round(overall_f1, 6) AS overall_f1 FROM scores"
        ),
        "aggregate_scores": _scored(ONE_MODEL, _summary(_means("scores"))),
        "compare_models": _scored(
            PRED,
            ", m AS (SELECT model_id, "
            + ", ".join(f"avg({f}_f1) AS {f}_f1" for f in OVERALL_FIELDS)
            + " FROM scores GROUP BY ALL) SELECT model_id, "
            + _f1s(OVERALL_FIELDS)
            + f", round(({' + '.join(f'{f}_f1' for f in OVERALL_FIELDS)}) / 5, 6) AS overall_f1, "
            "false AS skipped, CAST(NULL AS VARCHAR) AS reason FROM m UNION ALL "
            "SELECT 'model-d', NULL, NULL, NULL, NULL, NULL, NULL, true, 'credential is not set'",
        ),
        "compare_runners": _scored(
            PRED,
            ", m AS (SELECT model_id, "
            + ", ".join(f"avg({f}_f1) AS {f}_f1" for f in OVERALL_FIELDS)
            + " FROM scores GROUP BY ALL) SELECT model_id, "
            + _f1s(OVERALL_FIELDS)
            + f", round(({' + '.join(f'{f}_f1' for f in OVERALL_FIELDS)}) / 5, 6) AS overall_f1, "
            "false AS skipped, CAST(NULL AS VARCHAR) AS reason, (SELECT count(*) FROM gt WHERE order_key % 11 = 0 "
            f"OR (model_id = '{MODELS[1]}' AND order_key % 4 = 0)) AS asked_again FROM m UNION ALL "
            "SELECT 'model-d', NULL, NULL, NULL, NULL, NULL, NULL, true, 'credential is not set', NULL UNION ALL "
            "SELECT 'model-e', NULL, NULL, NULL, NULL, NULL, NULL, true, 'runtime error: receipt ' || "
            "(SELECT min(order_key) FROM gt WHERE order_key % 50 = 3) || ' is too large', NULL",
        ),
        "running_scores": _scored(
            PRED,
            " SELECT model_id, count(*) AS n, round(avg(overall_f1), 6) AS mean_f1 FROM scores GROUP BY ALL",
        ),
        "collect_tally": f"""
WITH t AS (SELECT CASE {_STATE} WHEN 'SUCCESS' THEN 'ok' WHEN 'FAILURE' THEN 'failed' ELSE 'pending' END AS s FROM events)
SELECT status, (SELECT count(*) FROM t WHERE s = status) AS n FROM (VALUES ('ok'), ('failed'), ('pending')) v(status)""",
        "restore_scores": "WITH s AS (" + _restored() + ")" + _summary(_means("s")),
        "parse_responses": f"""
WITH {RESPONSES} SELECT conv_id, turn, status AS parse_status,
  CASE WHEN status = 'ok' THEN json_extract_string(t, '$.store') END AS store,
  CASE WHEN status = 'ok' THEN CAST(json_extract_string(t, '$.total') AS BIGINT) END AS total FROM parsed""",
        "retry_fallback": f"""
WITH {RESPONSES}, a AS (
  SELECT conv_id, count(*) FILTER (WHERE status = 'ok') AS n_ok, min(turn) FILTER (WHERE status = 'ok') AS first,
         arg_min(t, turn) FILTER (WHERE status = 'ok') AS t FROM parsed GROUP BY ALL)
SELECT conv_id, CASE WHEN n_ok > 0 THEN 'ok' ELSE 'failed' END AS parse_status,
  coalesce(first > 0, true) AS retried, json_extract_string(t, '$.store') AS store FROM a""",
        "unwrap_tagged": f"""
WITH s AS (SELECT o_orderkey AS receipt_id, CASE o_orderkey % 5
    WHEN 0 THEN '<s_cord-v2>{{"cord-v2":{{"id":' || o_orderkey || '}}}}</s_cord-v2></s>'
    WHEN 1 THEN '<s_receipt>{{"id":' || o_orderkey || '}}</s_receipt><pad><pad>'
    WHEN 2 THEN '{{"id":' || o_orderkey || '}}'
    WHEN 3 THEN 'noise <s_receipt>{{"id":' || o_orderkey || '}}'
    ELSE '0123456789{{"id":' || o_orderkey || '}}</s_receipt>' END AS q FROM orders),
p AS (SELECT *, CASE WHEN contains(q, '<s_cord-v2>') THEN regexp_extract(q, '(?s)<s_cord-v2>(.*?)</s_cord-v2>', 1) ELSE q END AS body,
    replace(replace(q, '</s>', ''), '<pad>', '') AS clean FROM s),
c AS (SELECT *, CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS payload,
    instr(clean, '<s_receipt>') - 1 + 11 AS a, instr(clean, '</s_receipt>') - 1 AS b FROM p)
SELECT receipt_id, payload,
  coalesce(CAST(json_extract(payload, '$."cord-v2"') AS VARCHAR), payload) AS inner_payload,
  CASE WHEN b > a THEN regexp_replace(substr(clean, a + 1, b - a), {tags}) ELSE clean END AS sliced FROM c""",
        "ocr_text_extract": r"""
WITH t AS (""" + _OCR_HEAD + r"""),
f AS (SELECT doc_id, text,
    list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]|\x{85}|\x{2028}|\x{2029}'),
      lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^[\d\s\-/:.]+$'))[1] AS store_name,
    nullif(regexp_extract(text, '(?i)total\s*(?:amount)?[:\s]*\$?\s*([\d,]+\.\d{2})', 1), '') AS a,
    nullif(regexp_extract(text, '(?i)amount\s+due[:\s]*\$?\s*([\d,]+\.\d{2})', 1), '') AS b,
    regexp_extract_all(text, '\b([\d,]+\.\d{2})\b', 1)[-1] AS c FROM t)
SELECT doc_id, store_name, try_cast(replace(coalesce(a, b, c), ',', '') AS DOUBLE) AS total,
  CAST(0 AS INT) AS n_items, CAST(length(text) AS INT) AS n_notes FROM f""",
        "normalize_cord": _with(GT, CORD_LINES, CORD_OUT)
        + """ SELECT receipt_id, CASE WHEN NOT bad THEN store END AS store, CASE WHEN NOT bad THEN '1970-01-01' END AS date,
  CASE WHEN NOT bad THEN round(total, 6) END AS total, CASE WHEN NOT bad THEN round(subtotal, 6) END AS subtotal,
  CASE WHEN NOT bad THEN CAST(n_items AS INT) END AS n_items, CASE WHEN NOT bad THEN CAST(last_line AS INT) END AS last_line,
  CASE WHEN NOT bad THEN round(item_total, 4) END AS item_total,
  CASE WHEN NOT bad THEN format('images/cord_{:05d}.jpg', order_key) END AS image_path,
  CASE WHEN bad THEN 'sub_total is null' END AS error FROM cord_out""",
        "normalize_sroie": _with(GT, SROIE_OUT)
        + """ SELECT receipt_id, CASE WHEN error IS NULL THEN store END AS store, CASE WHEN error IS NULL THEN date END AS date,
  CASE WHEN error IS NULL THEN round(total, 6) END AS total, CAST(NULL AS DOUBLE) AS subtotal,
  CASE WHEN error IS NULL THEN CAST(1 AS INT) END AS n_items, CASE WHEN error IS NULL THEN CAST(1 AS INT) END AS last_line,
  CASE WHEN error IS NULL THEN CAST(0.0 AS DOUBLE) END AS item_total,
  CASE WHEN error IS NULL THEN format('images/sroie_{:05d}.jpg', order_key) END AS image_path, error FROM sroie_out""",
        "remap_eval": _with(GT, CORD_LINES)
        + _remap(
            "coalesce(storenm, '')",
            n_cord("total_price"),
            "CASE WHEN kind = 4 THEN '' ELSE name END",
            q_eval("cnt"),
            n_cord("unitprice"),
            n_cord("price"),
            "NULL, NULL, NULL, NULL, NULL",
        ),
        "remap_serving": _with(GT, CORD_LINES)
        + _remap(
            "coalesce(storenm, 'Unknown')",
            n_serving("total_price"),
            "CASE WHEN kind = 4 THEN 'UNKNOWN' ELSE name END",
            q_serving("cnt"),
            f"nullif({n_serving('unitprice')}, 0.0)",
            n_serving("price"),
            "1, 'UNKNOWN', 1.0, NULL, 0.0",
        ),
        "union_sources": _with(GT, CORD_LINES, CORD_OUT, SROIE_OUT)
        + """ SELECT 'cord' AS source, count(*) AS n, round(sum(total), 3) AS sum_total FROM cord_out WHERE NOT bad
UNION ALL SELECT 'sroie', count(*), round(sum(total), 3) FROM sroie_out WHERE error IS NULL""",
        "validate_receipts": _with(GT, RECEIPT_JSON, CHECKED)
        + " SELECT receipt_id, len(v) = 0 AS valid, CAST(len(v) AS INT) AS n_violations, v[1] AS first_violation FROM checked",
        "field_completeness": _with(GT, RECEIPT_JSON)
        + """ SELECT 'store.name' AS field, count(*) FILTER (WHERE json_type(j, '$.store.name') IS NOT NULL) AS n_present, count(*) AS n_total FROM doc
UNION ALL SELECT 'total', count(*) FILTER (WHERE json_type(j, '$.total') IS NOT NULL), count(*) FROM doc
UNION ALL SELECT 'items', count(*) FILTER (WHERE json_type(j, '$.items') = 'OBJECT' OR json_array_length(j, '$.items') > 0), count(*) FROM doc""",
        "extraction_outcome": _with(GT, RECEIPT_JSON, CHECKED)
        + """ SELECT CAST(CASE WHEN order_key % 10 IN (1, 2) THEN 415 WHEN order_key % 10 = 4 THEN 503
    WHEN order_key % 10 = 3 THEN 500 WHEN len(v) > 0 THEN 422 ELSE 200 END AS INT) AS status_code, count(*) AS n
FROM checked GROUP BY ALL""",
        "split_train_val": f"""
WITH {KEYS}, r AS (SELECT receipt_id, row_number() OVER (ORDER BY md5('42:' || receipt_id), receipt_id) AS rn, count(*) OVER () AS n FROM gt)
SELECT receipt_id, CASE WHEN rn <= greatest(1, CAST(floor(CAST(n AS DOUBLE) * CAST(0.1 AS DOUBLE)) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM r""",
        "resolve_images": f"WITH {KEYS}, {IMAGES} SELECT receipt_id, image_name, exists FROM resolved",
        "assign_shards": f"""
WITH {KEYS}, {IMAGES}, o AS (SELECT receipt_id, row_number() OVER (ORDER BY receipt_id) - 1 AS ordinal FROM resolved WHERE exists)
SELECT ordinal // 1000 AS shard_id, count(*) AS n_items, min(receipt_id) AS first_key, max(receipt_id) AS last_key FROM o GROUP BY ALL""",
        "seeded_batches": f"""
WITH {KEYS} SELECT (row_number() OVER (ORDER BY md5('7:0:' || receipt_id), receipt_id) - 1) // 4 AS batch_id, receipt_id FROM gt""",
        "first_n_samples": f"""
WITH {KEYS} SELECT receipt_id, ordinal FROM (SELECT receipt_id, row_number() OVER (ORDER BY receipt_id) - 1 AS ordinal FROM gt) WHERE ordinal < 200""",
        "training_targets": _with(GT)
        + """, ij AS (SELECT receipt_id, string_agg('{"line_number":' || line || ',"name":"' || name || '","quantity":' || quantity ||
    ',"unit":"each","total":' || total || '}', ',' ORDER BY line) AS j FROM item GROUP BY ALL),
t AS (SELECT receipt_id, string_split_regex('<s_receipt>{"store":{"name":"' || store || '"},"date":"' || date || '","items":[' ||
    coalesce(j, '') || '],"total":' || total || ',"currency":"USD"}</s_receipt>', '\\s+') AS t FROM gt LEFT JOIN ij USING (receipt_id))
SELECT receipt_id, CAST(least(len(t), 24) AS INT) AS n_tokens, len(t) > 24 AS truncated, t[least(len(t), 24)] AS last_token FROM t""",
        "build_requests": f"""
SELECT page_id AS receipt_id, CAST(CASE WHEN page_id % 3 = 0 THEN 3 ELSE 1 END AS INT) AS n_messages,
  CAST({len(PROMPT.format(schema_json=RECEIPT))} AS INT) AS prompt_chars, md5(base64(encode(html))) AS image_md5 FROM pages""",
        "job_status": JOB_STATUS,
        "stream_job_status": JOB_STATUS,
        "stream_job_expiry": f"""
SELECT j.job_id, status, result, last + INTERVAL 24 HOUR AS expires_at FROM ({JOB_STATUS}) j
JOIN (SELECT user_id AS job_id, max(ts) AS last FROM events GROUP BY ALL) l USING (job_id)
WHERE last + INTERVAL 24 HOUR > (SELECT max(ts) FROM events)""",
        "stream_retries": """
WITH s AS (
  SELECT event_id AS job_id, ts, event_type, CASE WHEN event_id % 50 = 7 THEN 9 WHEN event_id % 10 = 3 THEN 1
    WHEN event_id % 10 = 5 THEN 2 WHEN event_id % 100 = 9 THEN 3 ELSE 0 END AS fails FROM events
), t AS (SELECT *, unnest(range(1, least(fails, 3) + 2)) AS attempt FROM s)
SELECT job_id, CAST(attempt AS INT) AS attempt, ts + (attempt - 1) * INTERVAL 2 SECOND AS due,
  CASE WHEN attempt > fails THEN event_type END AS raw,
  CASE WHEN attempt <= fails THEN 'ConnectionError: busy' END AS error, attempt <= fails AND attempt < 4 AS waits FROM t""",
        "dedupe_results": "SELECT event_id AS task_id, min(ts) AS first_ts FROM events GROUP BY ALL",
        "stream_dedupe_results": "SELECT event_id AS task_id, CAST(1 AS BIGINT) AS n FROM events GROUP BY ALL",
        "stream_extract": _with(GT, CORD_LINES)
        + """ SELECT code AS status_code, CASE WHEN code = 200 THEN 'true' ELSE 'false' END AS valid, count(*) AS n
FROM (SELECT CAST(CASE order_key % 8 WHEN 1 THEN 415 WHEN 2 THEN 500 WHEN 3 THEN 500 WHEN 4 THEN 503 ELSE 200 END AS INT) AS code FROM cord) GROUP BY ALL""",
        "predict_documents": r"""
SELECT CAST(doc_id AS VARCHAR) AS job_id, 'text' AS model_id, CAST(1 AS INT) AS attempt,
  list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]|\x{85}|\x{2028}|\x{2029}'),
      lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^[\d\s\-/:.]+$'))[1] AS store_name,
  CAST(length(text) AS INT) AS n_chars, CAST(NULL AS VARCHAR) AS error FROM documents""",
        "list_objects": f"""
WITH {KEYS} SELECT DISTINCT format('{{:06d}}.tar', (row_number() OVER (ORDER BY receipt_id) - 1) // 1000) AS key,
  true AS has_bytes FROM gt""",
        "buffered_order": _with(GT)
        + """, o AS (SELECT store, row_number() OVER (ORDER BY receipt_id) - 1 AS ordinal FROM gt),
s AS (SELECT shard_id, row_number() OVER (ORDER BY sha256('7:0:' || format('{:06d}.tar', shard_id))) - 1 AS shard_place
  FROM (SELECT DISTINCT ordinal // 1000 AS shard_id FROM o))
SELECT shard_place, shard_id, ordinal % 1000 AS idx, store, true AS in_reach FROM o JOIN s ON shard_id = ordinal // 1000""",
        "shard_roundtrip": _with(GT)
        + """, o AS (SELECT receipt_id, store, row_number() OVER (ORDER BY receipt_id) - 1 AS ordinal FROM gt)
SELECT ordinal // 1000 AS shard_id, ordinal % 1000 AS idx, receipt_id, store,
  receipt_id IN (SELECT receipt_id FROM item) AS has_items FROM o""",
    }
    sql["stream_running_scores"] = sql["running_scores"]
    return sql | roundtrips.sql(sql)
