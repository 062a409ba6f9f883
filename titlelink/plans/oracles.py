"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions import labels
from ..operators import score
from . import demo, queries
from .queries import GOLDEN, LOOSE

ORACLES: dict[str, str] = {}


def norm(c: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace(strip_accents({c}), '[^\x00-\x7F]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')))"


def nth(names: tuple[str, ...], k: str) -> str:
    return f"([{', '.join(repr(n) for n in names)}])[(({k}) % {len(names)}) + 1]"


def grams(text: str) -> str:
    """List of the windows in order of place."""
    return f"list_transform(range(1, length({text}) + 3), lambda i: substr('^^' || {text} || '$$', i, 3))"


# --- text ---

ORACLES["normalize_title"] = f"SELECT doc_id, {norm('text')} AS norm FROM documents"
ORACLES["trigrams"] = f"""
WITH t AS (SELECT item_id, {norm('text')} AS t FROM benchmark), g AS (SELECT item_id, unnest({grams('t')}) AS gram, generate_subscripts({grams('t')}, 1) AS p FROM t),
f AS (SELECT item_id, gram, min(p) AS p FROM g GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY p) - 1 AS pos, gram FROM f"""


def _value(x: float | None) -> str:
    return "NULL::DOUBLE" if x is None else f"{x}::DOUBLE"


ORACLES["title_meta_golden"] = "SELECT * FROM (VALUES " + ", ".join("('" + t.replace("'", "''") + f"', {_value(a)}, {_value(b)}, {_value(c)})" for t, a, b, c in GOLDEN) + ") v(title, season, part, episode)"
ORACLES["consolidate_mode"] = """
WITH raw AS (SELECT l_orderkey AS id, l_linenumber AS pos, CASE WHEN l_linenumber % 3 = 0 THEN 99.0 WHEN l_suppkey % 4 <> 3 THEN (l_suppkey % 4)::DOUBLE END AS season, CASE WHEN l_partkey % 2 = 0 THEN 2.0 END AS part FROM lineitem),
once AS (SELECT id, pos, min(struct_pack(a := coalesce(season, -1), b := coalesce(part, -1))) AS m FROM raw GROUP BY ALL),
rows_ AS (SELECT id, pos, nullif(m.a, -1)::DOUBLE AS season, nullif(m.b, -1)::DOUBLE AS part FROM once),
s AS (SELECT id, season AS v, count(*) AS n, min(pos) AS p FROM rows_ WHERE season IS NOT NULL AND season <> 99 GROUP BY ALL),
sb AS (SELECT id, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, p DESC) AS k FROM s) WHERE k = 1),
f AS (SELECT id, bool_or(season = 99) AS final, max(part) AS part FROM rows_ GROUP BY id)
SELECT f.id, CASE WHEN sb.v IS NOT NULL THEN sb.v WHEN f.final THEN 99.0::DOUBLE END AS season, f.part, coalesce(f.final, false) AS final FROM f LEFT JOIN sb USING (id)"""
ORACLES["hashed_id"] = "SELECT c_custkey, substr(sha256(c_name), 1, 16) AS hex FROM customer"
ORACLES["linked_ids"] = "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN doc_id END AS linked, doc_id AS paged, doc_id::VARCHAR || '-t' AS slug FROM documents"
ORACLES[
    "page_count"
] = r"""SELECT page_id, coalesce(list_max(list_transform(regexp_extract_all(url || ' ' || html, '[?&]page=(\d+)', 1), lambda x: TRY_CAST(x AS INTEGER))), 1)::BIGINT AS last_page FROM pages"""
ORACLES["cell_parsers"] = """
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 4 = 0 AS bare, o_orderkey % 30 AS w, o_orderkey % 7 AS t FROM orders)
SELECT k, CASE WHEN bare THEN 0 ELSE w END AS watched, CASE WHEN bare THEN NULL ELSE t END AS total, CASE WHEN bare THEN 0 ELSE least(w, t) END AS clamped, k % 11 AS rating, 'Ongoing' AS status,
CASE WHEN k % 3 = 2 THEN 'x' END AS cell, CASE WHEN k % 103 = 0 THEN 0 WHEN k % 103 >= 100 THEN 100 ELSE least(99, floor(((k % 103)::DOUBLE / 100) * 100 + 0.5))::BIGINT END AS percent FROM r"""
ORACLES[
    "loose_dates"
] = "SELECT event_id AS k, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(make_timestamp((floor(epoch(ts))::BIGINT + 3600) * 1000000), '%Y-%m-%d') END AS day FROM events"

# --- search ---

BASE = f"""
docs AS (
  SELECT doc_id AS id, 0 AS alias, {norm('text')} AS t FROM documents
  UNION ALL SELECT doc_id, 1, {norm("concat_ws(' ', source, lang)")} FROM documents),
post AS (SELECT DISTINCT id, alias, unnest({grams('t')}) AS gram FROM docs),
len AS (SELECT id, alias, count(*) AS len FROM post GROUP BY ALL),
total AS (SELECT count(*) AS n FROM docs),
freq AS (SELECT gram, count(*) AS df, ln(1 + any_value(total.n) / count(*)) AS idf FROM post, total GROUP BY gram),
norms AS (SELECT id, alias, sqrt(sum(idf * idf)) AS norm FROM post JOIN freq USING (gram) GROUP BY ALL),
asked AS (SELECT item_id AS q, {norm('text')} AS t FROM benchmark),
qg AS (SELECT q, gram, min(p) AS p FROM (SELECT q, unnest({grams('t')}) AS gram, generate_subscripts({grams('t')}, 1) AS p FROM asked) GROUP BY ALL),
known AS (SELECT q, gram, p, df, idf FROM qg JOIN freq USING (gram)),
terms AS (SELECT q, gram, df, idf, row_number() OVER (PARTITION BY q ORDER BY df, p) AS rank FROM known, total WHERE df < floor(0.2 * total.n)),
sizes AS (SELECT q, count(*) AS q_len, sqrt(sum(idf * idf)) AS q_norm, count(*) FILTER (df < floor(0.2 * total.n)) AS n_terms FROM known, total GROUP BY q),
loose AS (SELECT DISTINCT q, id, alias FROM terms JOIN sizes USING (q) JOIN post USING (gram) WHERE rank <= least(greatest(floor(n_terms / 3), 1), 4) + 1),
counts AS (SELECT q, id, alias, count(*) AS m, sum(idf * idf) AS weight FROM terms JOIN post USING (gram) GROUP BY ALL),
whole AS (SELECT q, id, alias FROM counts JOIN sizes USING (q) WHERE m = n_terms),
strict AS (SELECT * FROM whole UNION ALL SELECT * FROM loose WHERE q NOT IN (SELECT q FROM whole))"""


def scored(seeds: str, formula: str = "0.8 * m / q_len + 0.2 * m / (q_len + len - m)") -> str:
    return f"""
hits AS (SELECT q, id, alias, m, least(1.0, greatest(0.0, {formula})) AS score FROM counts SEMI JOIN {seeds} USING (q, id, alias) JOIN len USING (id, alias) JOIN norms USING (id, alias) JOIN sizes USING (q)),"""


def ranked(threshold: float, limit: int) -> str:
    return f"""
best AS (SELECT q, id, max(score) AS s FROM hits WHERE score >= {threshold} GROUP BY ALL),
top AS (SELECT q, id, s, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, id) AS rank FROM best QUALIFY rank <= {limit})"""


ORACLES["doc_freq"] = f"WITH {BASE} SELECT gram, df FROM freq"
ORACLES["idf_norms"] = f"WITH {BASE} SELECT id, alias::BIGINT AS alias, len, round(norm, 4) AS norm FROM len JOIN norms USING (id, alias)"
ORACLES["search_terms"] = f"WITH {BASE} SELECT q, gram, df, rank FROM terms"
ORACLES["seed_candidates_or"] = f"WITH {BASE} SELECT q, id, alias::BIGINT AS alias FROM loose"
ORACLES["seed_candidates_and_fallback"] = f"WITH {BASE} SELECT q, id, alias::BIGINT AS alias FROM strict"
ORACLES["fuzzy_search_topk"] = f"WITH {BASE}, {scored('loose')} {ranked(0.1, 20)} SELECT q, id, round(s, 6) AS score, rank FROM top"
ORACLES["strict_search_topk"] = f"WITH {BASE}, {scored('strict')} {ranked(0.1, 20)} SELECT q, id, round(s, 6) AS score, rank FROM top"
ORACLES["tfidf_cosine"] = f"WITH {BASE}, {scored('loose', 'weight / (q_norm * norm)')} {ranked(0.05, 20)} SELECT q, id, round(s, 6) AS score, rank FROM top"
ORACLES["alias_collapse"] = f"WITH {BASE}, {scored('loose').rstrip(',')} SELECT q, id, round(max(score), 6) AS score, count(*) AS n_docs FROM hits GROUP BY ALL"

# --- scores ---


def number(x: str, every: int, step: int) -> str:
    return f"CASE WHEN {x} % {every} <> 0 THEN ({x} % {step})::DOUBLE END"


PAIRS = f"""
o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate FROM orders),
pairs AS (SELECT k,
  CASE WHEN k % 17 = 0 THEN 99.0 ELSE {number('k', 3, 4)} END AS season, {number('k', 5, 3)} AS part, CASE WHEN k % 19 = 0 THEN 99.0 ELSE {number('k', 2, 5)} END AS episode,
  CASE WHEN c % 17 = 0 THEN 99.0 ELSE {number('c', 4, 4)} END AS c_season, {number('c', 6, 3)} AS c_part, c % 10 = 0 AS fs, c % 14 = 0 AS fp, c % 15 = 0 AS fe,
  CASE WHEN k % 9 <> 0 THEN 1990 + k % 12 END AS year, CASE WHEN c % 8 <> 0 THEN 1990 + c % 12 END AS c_year, {nth(demo.TYPE_NAMES, 'k')} AS type, {nth(demo.TYPE_NAMES, 'c')} AS c_type,
  {nth(demo.STATUS_NAMES, 'k')} AS status, {nth(demo.STATUS_NAMES, 'c')} AS c_status, CASE WHEN k % 13 <> 0 THEN o_orderdate::DATE END AS date, {nth(demo.SEASON_NAMES, 'c')} AS c_season_name, k % 30 AS episodes, c % 30 AS c_episodes FROM o)"""


def season_sql(season: str, part: str, episode: str, c_season: str, c_part: str, fs: str, fp: str, fe: str) -> str:
    sa, sb = f"trunc(coalesce({season}, {episode}, 1))", f"trunc(coalesce({c_season}, {episode}, 1))"
    fa = f"coalesce(coalesce({season}, {episode}) = 99, false)"
    fb = f"CASE WHEN {c_season} IS NOT NULL THEN coalesce({fs}, false) WHEN {episode} IS NOT NULL THEN coalesce({fe}, false) ELSE false END"
    return f"""least(1.0, greatest(0.0, round(0.5 + CASE WHEN {sa} = {sb} OR ({fa} AND {fb}) THEN 0.5 ELSE -0.4 END
      + CASE WHEN trunc(coalesce({part}, 1)) = trunc(coalesce({c_part}, 1)) OR (coalesce({part} = 99, false) AND coalesce({fp}, false)) THEN 0.3 ELSE -0.2 END, 9)))"""


def year_sql(q: str, c: str, as_of: int) -> str:
    age = f"greatest(0, {as_of} - {c})"
    return f"""CASE WHEN {q} IS NULL AND {c} IS NULL THEN 0.7 WHEN {q} IS NULL THEN CASE WHEN {age} <= 2 THEN 0.46 WHEN {age} <= 5 THEN 0.44 WHEN {age} <= 10 THEN 0.42 ELSE 0.4 END
      WHEN {c} IS NULL THEN 0.4 ELSE CASE abs({q} - {c}) WHEN 0 THEN 1.0 WHEN 1 THEN 0.35 WHEN 2 THEN -0.1 ELSE -0.35 END END::DOUBLE"""


def type_sql(q: str, c: str) -> str:
    return f"""CASE WHEN {q} = {c} THEN 1.0 WHEN {q} IN ('Ova', 'Special') AND {c} IN ('Ova', 'Special') THEN 0.6 WHEN {q} IN ('Tv', 'Ona') AND {c} IN ('Tv', 'Ona') THEN 0.4
      WHEN {q} = 'Unknown' OR {c} = 'Unknown' THEN 0.5 ELSE 0.2 END::DOUBLE"""


def status_sql(q: str, c: str) -> str:
    rows = " ".join(f"WHEN {q} = '{a}' AND {c} = '{b}' THEN {v}" for a, row in score.STATUS_SCORES.items() for b, v in zip(score.STATUS_ORDER, row, strict=True))
    return f"CASE {rows} END::DOUBLE"


def seasonal_sql(date: str, season: str) -> str:
    whens = " ".join(f"WHEN '{n}' THEN abs(dayofyear({date}) - dayofyear(make_date(year({date}), {m}, {x})))" for n, (m, x) in score.SEASON_STARTS.items())
    gap = f"(CASE {season} {whens} END)"
    near = f"least({gap}, dayofyear(make_date(year({date}), 12, 31)) - {gap})"
    return f"""CASE WHEN {date} IS NULL THEN CASE WHEN {season} = 'Undefined' THEN 0.7 ELSE 0.4 END WHEN {season} = 'Undefined' THEN 0.4
      WHEN {near} <= 45 THEN 1.0 WHEN {near} <= 93 THEN 0.75 WHEN {near} <= 124 THEN 0.4 ELSE 0.2 END::DOUBLE"""


def episodes_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN greatest(pow(least({a}, {b})::DOUBLE / greatest({a}, {b}), 1.15), 0.2) ELSE 0.7 END::DOUBLE"


def _pair(expr: str) -> str:
    return f"WITH {PAIRS} SELECT k, {expr} AS score FROM pairs"


ORACLES["score_season"] = _pair(f"round({season_sql('season', 'part', 'episode', 'c_season', 'c_part', 'fs', 'fp', 'fe')}, 6)::DOUBLE")
ORACLES["score_year"] = _pair(year_sql("year", "c_year", 2003))
ORACLES["score_type"] = _pair(type_sql("type", "c_type"))
ORACLES["score_status"] = _pair(status_sql("status", "c_status"))
ORACLES["score_seasonal"] = _pair(seasonal_sql("date", "c_season_name"))
ORACLES["score_episodes"] = _pair(f"round({episodes_sql('episodes', 'c_episodes')}, 6)")
_ON = [f"(CASE WHEN o_orderkey % {p} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for p in (2, 3, 5, 7)]
_W = [0.5, 0.3, 0.2, 0.0]
_SUM = " + ".join(f"{w}::DOUBLE * {o}" for w, o in zip(_W, _ON, strict=True))
ORACLES["masked_weights"] = "SELECT o_orderkey AS k, " + ", ".join(f"round(CASE WHEN {_SUM} > 0 THEN {w}::DOUBLE * {o} / ({_SUM}) WHEN {' + '.join(_ON)} > 0 THEN {o} / ({' + '.join(_ON)}) ELSE 0.0::DOUBLE END, 6) AS w{n}" for n, (w, o) in enumerate(zip(_W, _ON, strict=True))) + " FROM orders"

# --- matching ---

TABLES = f"""
entry AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN (1 + doc_id % 4)::DOUBLE END AS c_season, CASE WHEN doc_id % 5 = 0 THEN 2.0 END AS c_part, CASE WHEN doc_id % 7 <> 3 THEN 2000 + doc_id % 25 END AS c_year,
  {nth(demo.TYPE_NAMES, 'doc_id')} AS c_type, {nth(demo.STATUS_NAMES, 'doc_id')} AS c_status, {nth(demo.SEASON_NAMES, 'doc_id')} AS c_name, 1 + n_chars % 26 AS c_episodes FROM documents),
list AS (SELECT item_id AS q, CASE WHEN item_id % 2 = 0 THEN (1 + item_id % 3)::DOUBLE END AS season, CASE WHEN item_id % 4 = 1 THEN 2.0 END AS part, CASE WHEN item_id % 6 = 5 THEN 3.0 END AS episode,
  item_id % 8 <> 7 AS has_date, CASE WHEN item_id % 5 <> 4 THEN DATE '2000-01-01' + ((item_id * 37) % 9000)::INTEGER END AS date, item_id % 3 <> 2 AS has_type, {nth(demo.TYPE_NAMES, 'item_id')} AS type,
  {nth(demo.STATUS_NAMES, 'item_id + 1')} AS status, item_id % 4 <> 3 AS has_episodes, 1 + item_id % 13 AS episodes, CASE WHEN item_id % 7 = 0 THEN item_id * 3 WHEN item_id % 11 = 0 THEN item_id + 10000000 END AS mal_id FROM benchmark),
direct AS (SELECT q, mal_id AS id FROM list WHERE mal_id IN (SELECT id FROM entry))"""


def matched(preset: score.Preset, of: str = "top", only: str = "") -> str:
    """The candidates in `of` with all scores."""
    n = f"{preset.neutral}::DOUBLE"
    w = [f"{x!r}::DOUBLE" for x in preset.weights]
    on = ["1", "1", "1", "CASE WHEN has_type THEN 1 ELSE 0 END", "1", "CASE WHEN has_date THEN 1 ELSE 0 END", "CASE WHEN has_episodes THEN 1 ELSE 0 END"]
    total = " + ".join(f"{a} * {b}" for a, b in zip(w, on, strict=True))
    names = ("search_score", "season_score", "year_score", "type_score", "status_score", "seasonal_score", "episodes_score")
    return f"""
parts AS (SELECT q, id, rank AS search_rank, has_type, has_date, has_episodes, s AS search_score,
  {season_sql('season', 'part', 'episode', 'c_season', 'c_part', 'false', 'false', 'false')} AS season_score, {year_sql('year(date)', 'c_year', demo.AS_OF)} AS year_score,
  CASE WHEN has_type THEN {type_sql('type', 'c_type')} ELSE {n} END AS type_score, {status_sql('status', 'c_status')} AS status_score,
  CASE WHEN has_date THEN {seasonal_sql('date', 'c_name')} ELSE {n} END AS seasonal_score, CASE WHEN has_episodes THEN {episodes_sql('episodes', 'c_episodes')} ELSE {n} END AS episodes_score
  FROM {of} JOIN list USING (q) JOIN entry USING (id) {only}),
full_ AS (SELECT *, least(1.0, greatest(0.0, ({' + '.join(f'{a} * {b} * {c}' for a, b, c in zip(w, on, names, strict=True))}) / ({total}))) AS f FROM parts),
tiers AS (SELECT *, row_number() OVER win AS place, f > {preset.threshold} OR abs(f - {preset.threshold}) <= 1.1920929e-7 AS is_top,
  f - lead(CASE WHEN f > {preset.threshold} OR abs(f - {preset.threshold}) <= 1.1920929e-7 THEN f END) OVER win AS gap FROM full_ WINDOW win AS (PARTITION BY q ORDER BY round(f, 9) DESC, search_rank)),
won AS (SELECT *, is_top AND place = 1 AND (gap IS NULL OR gap > {preset.delta} OR abs(gap - {preset.delta}) <= 1.1920929e-7) AS wins FROM tiers)"""


_FOUND = f"{BASE}, {scored('strict')} {ranked(0.1, 50)}, {TABLES}"
_SCORES = ", ".join(f"round({n}, 6)::DOUBLE AS {n}" for n in ("search_score", "season_score", "year_score", "type_score", "status_score", "seasonal_score", "episodes_score"))
ORACLES["final_score"] = f"WITH {_FOUND}, {matched(score.STRICT)} SELECT q, id, {_SCORES}, round(f, 6) AS final_score FROM full_"
ORACLES["top_tier_and_winner"] = f"WITH {_FOUND}, {matched(LOOSE)} SELECT q, id, place AS rank, is_top, wins AS is_winner FROM won"
ORACLES["finalize_winners"] = """
WITH r AS (SELECT o_orderkey AS q, o_custkey AS id, round(o_totalprice / 1000, 0) AS f, o_orderkey % 2 = 0 AS w FROM orders)
SELECT q, id, w AND row_number() OVER (PARTITION BY id, w ORDER BY f DESC, q) = 1 AS is_winner FROM r"""
ORACLES["direct_matches"] = f"WITH {TABLES} SELECT q, id, 1.0::DOUBLE AS final_score, true AS is_direct FROM direct"
ORACLES["match_source_list"] = f"""
WITH {_FOUND}, {matched(LOOSE, only="WHERE q NOT IN (SELECT q FROM direct)")},
fin AS (SELECT *, wins AND row_number() OVER (PARTITION BY id, wins ORDER BY round(f, 9) DESC, q) = 1 AS is_winner FROM won)
SELECT q, id, round(f, 6) AS final_score, place AS rank, is_top, is_winner, false AS is_direct FROM fin
UNION ALL SELECT q, id, 1.0, 1, true, true, true FROM direct"""
ORACLES[
    "fuzzy_match_query"
] = f"WITH {BASE}, {scored('loose')} {ranked(0.1, 20)}, {TABLES}, {matched(score.QUERY_LINKED)} SELECT q, id, round(f, 6) AS final_score, place AS rank FROM won"
ORACLES["urgency_order"] = """
SELECT o_orderkey AS list_pos, dense_rank() OVER (ORDER BY CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::DATE END DESC NULLS FIRST, o_orderkey) AS place FROM orders"""

# --- lists ---

ORACLES[
    "merge_last_wins"
] = "SELECT o_custkey AS id, max(o_orderkey) AS list_pos, arg_max(o_totalprice, o_orderkey) AS o_totalprice, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey"
_MERGED = "SELECT o_custkey AS id, o_orderkey AS pos, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS rank, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS priority FROM orders"
ORACLES["merge_precedence"] = f"""
WITH r AS ({_MERGED}), t AS (SELECT *, max(rank) OVER (PARTITION BY id) AS best FROM r), s AS (SELECT *, min(CASE WHEN rank = best THEN pos END) OVER (PARTITION BY id) AS start FROM t)
SELECT id, min(pos) AS list_pos, max(rank)::BIGINT AS rank, arg_min(price, pos) FILTER (price IS NOT NULL) AS price, arg_min(priority, pos) FILTER (priority IS NOT NULL) AS priority FROM s WHERE pos >= start GROUP BY id"""
ORACLES["merge_first_nonnull"] = f"""
WITH r AS ({_MERGED}) SELECT id, min(pos) AS list_pos, arg_min(price, pos) FILTER (price IS NOT NULL) AS price, arg_min(priority, pos) FILTER (priority IS NOT NULL) AS priority FROM r GROUP BY id"""
ORACLES["lookup_by_ids"] = "SELECT o_orderkey AS id, o_totalprice FROM orders JOIN (VALUES (7, 0), (3, 1), (3, 2), (1000000000, 3), (100, 4)) v(i, p) ON o_orderkey = i"
ORACLES["batch_500"] = "SELECT o_orderkey AS list_pos, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 500)::BIGINT AS batch_id FROM orders"
ORACLES["direct_counts"] = f"WITH {TABLES} SELECT count(mal_id) AS direct, count(*) - count(mal_id) AS missing FROM list"

# --- review ---

REVIEW = """
w AS (SELECT doc_id AS source_id, CASE WHEN quality = 1 THEN doc_id % 50 END AS winner_id, quality = 1 OR doc_id % 2 = 0 AS has_top FROM labels),
o AS (SELECT doc_id AS source_id, doc_id % 45 AS catalog_id FROM labels WHERE quality = 0),
ig AS (SELECT doc_id AS source_id FROM labels WHERE toxic = 1),
disp AS (SELECT DISTINCT w.source_id FROM w JOIN o ON w.winner_id = o.catalog_id AND o.source_id <> w.source_id LEFT JOIN o mine ON mine.source_id = w.source_id
  WHERE w.source_id NOT IN (SELECT source_id FROM ig) AND (mine.catalog_id IS NULL OR mine.catalog_id = w.winner_id)),
st AS (SELECT w.source_id, w.winner_id, w.has_top, o.catalog_id AS override_id, w.source_id IN (SELECT source_id FROM ig) AS is_ignored, w.source_id IN (SELECT source_id FROM disp) AS is_displaced FROM w LEFT JOIN o USING (source_id)),
state AS (SELECT *, CASE WHEN is_ignored THEN NULL WHEN override_id IS NOT NULL THEN override_id WHEN is_displaced THEN NULL ELSE winner_id END AS effective_id,
  CASE WHEN winner_id IS NOT NULL THEN 2 WHEN has_top THEN 1 ELSE 0 END AS bucket FROM st)"""
ORACLES["displaced"] = f"WITH {REVIEW} SELECT source_id FROM disp"
ORACLES["effective_selection"] = f"WITH {REVIEW} SELECT source_id, effective_id, is_ignored, is_displaced FROM state"
ORACLES["status_label"] = f"""WITH {REVIEW} SELECT source_id, CASE WHEN is_ignored THEN 'ignored' WHEN override_id IS NOT NULL THEN 'manual' WHEN is_displaced THEN 'suppressed'
  WHEN winner_id IS NOT NULL THEN 'matched' WHEN has_top THEN 'review' ELSE 'unmatched' END AS label FROM state"""
ORACLES["views"] = f"""WITH {REVIEW}
SELECT 'all' AS view, source_id, bucket::BIGINT AS bucket FROM state
UNION ALL SELECT 'manual', source_id, bucket FROM state WHERE bucket < 2
UNION ALL SELECT 'manual', source_id, bucket FROM state WHERE bucket = 2 AND (is_displaced OR override_id IS NOT NULL)
UNION ALL SELECT 'automatic', source_id, bucket FROM state WHERE bucket = 2
UNION ALL SELECT 'ignored', source_id, bucket FROM state WHERE is_ignored"""
ORACLES[
    "match_summary"
] = f"WITH {REVIEW} SELECT count(*) AS total, count(winner_id) AS winners, count(*) FILTER (has_top) AS with_top, count(*) FILTER (winner_id IS NULL AND NOT has_top) AS unmatched FROM w"
ORACLES["summary"] = f"""WITH {REVIEW},
auto AS (SELECT source_id FROM w WHERE winner_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM ig) AND source_id NOT IN (SELECT source_id FROM o) AND source_id NOT IN (SELECT source_id FROM disp)),
done AS (SELECT source_id FROM ig UNION SELECT source_id FROM o UNION SELECT source_id FROM auto),
c AS (SELECT (SELECT count(*) FROM w) AS total, (SELECT count(*) FROM auto) AS automatic, (SELECT count(*) FROM w WHERE source_id IN (SELECT source_id FROM o)) AS manual,
  (SELECT count(*) FROM w WHERE source_id IN (SELECT source_id FROM ig)) AS ignored, (SELECT count(*) FROM w WHERE source_id IN (SELECT source_id FROM done)) AS resolved)
SELECT total, automatic, manual, ignored, greatest(0, total - resolved) AS review, CASE WHEN automatic + manual >= total THEN 100 ELSE least(99, floor(100 * ((automatic + manual)::DOUBLE / total) + 0.5)) END::BIGINT AS percentage FROM c"""
ORACLES[
    "winner_claims"
] = f"WITH {REVIEW} SELECT effective_id AS catalog_id, string_agg(source_id::VARCHAR, ',' ORDER BY source_id) AS sources FROM state WHERE effective_id IS NOT NULL GROUP BY effective_id"
ORACLES["conflicts"] = f"WITH {REVIEW} SELECT effective_id AS catalog_id, count(*) AS n FROM state WHERE effective_id IS NOT NULL GROUP BY effective_id HAVING count(*) > 1"
ORACLES["prune_overrides"] = f"WITH {REVIEW} SELECT source_id, catalog_id FROM o WHERE source_id IN (SELECT doc_id FROM documents) AND catalog_id IN (SELECT p_partkey FROM part)"

# --- export ---

_EXPORT = f"""
x AS (SELECT item_id AS i, CASE WHEN item_id % 3 = 0 AND item_id % 5 <> 4 THEN strftime(DATE '2000-01-01' + ((item_id * 37) % 9000)::INTEGER, '%Y-%m-%d') ELSE '0000-00-00' END AS d, {nth(demo.WATCH_NAMES, 'item_id')} AS s,
  CASE WHEN item_id % 2 = 1 THEN 'seen <twice> & liked' ELSE '' END AS n FROM benchmark),
e AS (SELECT i AS pair_pos, i * 10 AS series_animedb_id, i % 13 AS my_watched_episodes, '0000-00-00' AS my_start_date, d AS my_finish_date, i % 11 AS my_score,
  CASE s WHEN 'OnHold' THEN 'On-Hold' WHEN 'PlanToWatch' THEN 'Plan to Watch' ELSE s END AS my_status, n AS my_comments, 1::BIGINT AS update_on_import FROM x)"""
ORACLES["export_rows"] = f"WITH {_EXPORT} SELECT * FROM e"
_TAGS = " || ".join(f"'<{f}>' || replace(replace(replace({f}::VARCHAR, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</{f}>'" for f in (
    "series_animedb_id", "my_watched_episodes", "my_start_date", "my_finish_date", "my_score", "my_status", "my_comments", "update_on_import",
))
ORACLES["xml_lines"] = f"WITH {_EXPORT} SELECT pair_pos, '<anime>' || {_TAGS} || '</anime>' AS xml FROM e"

# --- words, users and labels ---


def picked(names: tuple[str, ...], k: str) -> str:
    return "([" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + f"])[(({k}) % {len(names)}) + 1]"


def words(x: str, table: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + f" ELSE {other} END"


ORACLES[
    "loose_bools"
] = f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE lower({picked(queries.BOOLS, 'o_orderkey')}) IN ('true', '1') END AS value FROM orders"
ORACLES["site_words"] = f"""
WITH r AS (SELECT o_orderkey AS k, lower(trim({picked(queries.TYPE_TEXTS, 'o_orderkey')})) AS t, lower(trim({picked(queries.WATCH_TEXTS, 'o_orderkey')})) AS w, lower(trim({picked(queries.STATUS_TEXTS, 'o_orderkey')})) AS s FROM orders)
SELECT k, CASE WHEN t = 'tv' THEN 'Tv' WHEN t IN ('movie', 'film') THEN 'Movie' WHEN t = 'ova' THEN 'Ova' WHEN t = 'ona' THEN 'Ona' WHEN t IN ('special', 'specjal', 'speciale') THEN 'Special' END AS type,
CASE w WHEN 'obejrzane' THEN 'Completed' WHEN 'oglądam' THEN 'Watching' WHEN 'wstrzymane' THEN 'OnHold' WHEN 'porzucone' THEN 'Dropped' WHEN 'nie oglądam' THEN 'Dropped' ELSE 'PlanToWatch' END AS watch,
CASE WHEN s IN ('zakończone', 'zakonczone') THEN 'Finished' WHEN s = 'emitowane' THEN 'Ongoing' WHEN s IN ('zapowiedź', 'nadchodzące') THEN 'Upcoming' END AS status, CASE WHEN k % 4 >= 2 THEN k % 11 END::BIGINT AS score FROM r"""
ORACLES["source_a_words"] = f"""
WITH r AS (SELECT o_orderkey AS k, {picked(queries.A_TYPES, 'o_orderkey')} AS t, {picked(queries.A_STATUSES, 'o_orderkey')} AS s, {picked(queries.A_WATCH, 'o_orderkey')} AS w FROM orders)
SELECT k, CASE t WHEN 'Music' THEN 'Ova' WHEN 'OVA' THEN 'Ova' WHEN 'TV' THEN 'Tv' WHEN 'ONA' THEN 'Ona' ELSE t END AS type,
CASE s WHEN 'Finished Airing' THEN 'Finished' WHEN 'Currently Airing' THEN 'Ongoing' ELSE 'Upcoming' END AS status,
CASE w WHEN 'completed' THEN 'Completed' WHEN 'plan' THEN 'PlanToWatch' WHEN 'in progress' THEN 'Watching' WHEN 'hold' THEN 'OnHold' ELSE 'Dropped' END AS watch, k % 30 AS watched FROM r"""
ORACLES["sections"] = f"""
WITH r AS (SELECT o_orderkey AS k, {picked(queries.SECTIONS, 'o_orderkey')} AS s, o_orderkey % 3 + 1 AS p, 'u' || (o_orderkey % 5) AS u, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 13 END AS e FROM orders)
SELECT k, CASE s WHEN 'rated' THEN 'Completed' WHEN 'watching' THEN 'Watching' ELSE 'PlanToWatch' END AS watch, CASE s WHEN 'rated' THEN 3 WHEN 'watching' THEN 2 ELSE 1 END::BIGINT AS rank,
CASE WHEN s = 'rated' THEN coalesce(e, 0) ELSE 0 END::BIGINT AS watched, '/user/' || u || '/' || s || CASE WHEN p > 1 THEN '?page=' || p ELSE '' END AS path, '/anime_list/' || u AS path_c FROM r"""
ORACLES["japanese_aliases"] = f"""
SELECT o_orderkey AS k, trim(list_filter(string_split({picked(queries.ALIASES, 'o_orderkey')}, '|'), lambda p: regexp_matches(p, '[\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF]'))[1]) AS alias FROM orders"""
ORACLES["small_texts"] = r"""
SELECT doc_id, substr(regexp_replace(trim(text), '[ \t\n\x0B\f\r]+', ' ', 'g'), 1, 200) AS preview, CASE WHEN doc_id % 3 = 1 THEN 'p' ELSE 't' || doc_id END AS cover,
CASE WHEN doc_id % 2 = 1 AND trim(lang) <> '' THEN trim(lang) ELSE 't' || doc_id END AS search FROM documents"""
_HOST = {p: h.replace(".", r"\.") for p, h in queries.HOSTS.items()}
_FRONT = {p: rf"^(?:https?://)?(?:www\.)?{h}" for p, h in _HOST.items()}
_URL = {
    "a": rf"{_FRONT['a']}/user/([0-9]+)(?:-[A-Za-z0-9_-]+)?/?$",
    "b": rf"(?i){_FRONT['b']}/user/([^/?#]+)(?:/(?:rated|watching|plans))?/?(?:[?#].*)?$",
    "c": rf"(?i){_FRONT['c']}/(?:anime_list|profile)/([0-9]+)(?:/[0-5])?/?(?:[?#].*)?$",
}
ORACLES["users_typed"] = rf"""
WITH r AS (SELECT o_orderkey AS k, trim({picked(queries.USERS, 'o_orderkey')}) AS t FROM orders),
n AS (SELECT k, t, TRY_CAST(coalesce(nullif(regexp_extract(t, '{_URL['a']}', 1), ''), nullif(regexp_extract(t, '^(?:https?://)?(?:www\.)?([0-9]+)(?:-[A-Za-z0-9_-]+)?/?$', 1), '')) AS DECIMAL(38, 0)) AS a,
  coalesce(nullif(regexp_extract(t, '{_URL['b']}', 1), ''), t) AS b, coalesce(nullif(regexp_extract(t, '{_URL['c']}', 1), ''), t) AS c FROM r),
u AS (SELECT k, t, CASE WHEN a > 0 AND a <= 9007199254740991 THEN a::VARCHAR END AS user_a, CASE WHEN regexp_full_match(b, '[A-Za-z0-9_-]+') THEN b END AS user_b, CASE WHEN regexp_full_match(c, '[0-9]+') THEN c END AS user_c FROM n)
SELECT k, user_a, user_b, user_c, 'b:' || lower(user_b) AS scope_b, CASE WHEN regexp_matches(t, '{_URL['a']}') THEN 'a' WHEN regexp_matches(t, '{_URL['c']}') THEN 'c' WHEN regexp_matches(t, '{_URL['b']}') THEN 'b' END AS provider FROM u"""
_LACK = f"'{labels.MISSING}'"
ORACLES["display_labels"] = f"""
WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 <> 0 THEN {nth(demo.TYPE_NAMES, 'o_orderkey')} END AS t, {nth(demo.STATUS_NAMES, 'o_orderkey')} AS s, {nth(demo.SEASON_NAMES, 'o_orderkey')} AS z, {nth(demo.WATCH_NAMES, 'o_orderkey')} AS w,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS d, o_orderkey % 40 AS n FROM orders)
SELECT k, {words('t', labels.TYPES, _LACK)} AS type, {words('s', labels.STATUSES, _LACK)} AS status, {words('z', labels.SEASONS, _LACK)} AS season, {words('w', labels.WATCH, _LACK)} AS watch,
coalesce(year(d)::VARCHAR, 'Nieznany rok') AS premiere_year, CASE WHEN d IS NULL THEN 'Nieznana data' ELSE year(d)::VARCHAR || ', ' || day(d)::VARCHAR || ' ' || {picked(labels.MONTHS, 'month(d) - 1')} END AS premiere,
coalesce(year(d)::VARCHAR, {_LACK}) AS year, CASE WHEN n > 0 THEN n::VARCHAR ELSE 'Brak' END AS episodes, CASE WHEN n > 0 THEN ((n * 50 + 59) // 60)::VARCHAR || ' min' ELSE {_LACK} END AS duration FROM r"""
ORACLES["label_merge"] = """
WITH c AS (SELECT l_orderkey AS id, l_linenumber AS p, min(l_returnflag) AS f, min(l_partkey) % 3 <> 0 AS filled, min(l_suppkey)::VARCHAR AS v FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT id, arg_min(v, p) FILTER (f = 'A' AND filled) AS status, arg_min(v, p) FILTER (f = 'N' AND filled) AS episodes FROM c GROUP BY id"""
ORACLES["every_hundredth"] = "SELECT o_orderkey AS pos, o_totalprice FROM orders WHERE o_orderkey % 100 = 0"

# --- joins and review steps ---

ORACLES["export_missing"] = "SELECT o_orderkey AS pair_pos, o_custkey AS source_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)"
ORACLES["detail_join"] = """
SELECT o_orderkey AS id, o_orderkey AS pos, CASE WHEN o_orderkey % 8 = 0 THEN 'page' WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status,
CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 6 = 0 THEN 'tip' WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS priority FROM orders"""
ORACLES["picker_order"] = f"""
WITH {REVIEW}, raw AS (SELECT l_orderkey AS q, min(l_partkey) % 50 AS id, l_linenumber AS rank, l_linenumber = 3 AS win FROM lineitem GROUP BY l_orderkey, l_linenumber),
once AS (SELECT q, id, bool_or(win) AS win, coalesce(min(rank) FILTER (win), min(rank)) AS rank FROM raw GROUP BY q, id),
mark AS (SELECT q, id, win, rank, EXISTS (SELECT 1 FROM state WHERE effective_id = once.id AND source_id <> once.q) AS is_claimed FROM once)
SELECT q, id, is_claimed, row_number() OVER (PARTITION BY q ORDER BY is_claimed, win DESC, rank) AS place FROM mark"""
ORACLES["override_set"] = f"""WITH {REVIEW}
SELECT source_id, catalog_id FROM o WHERE source_id <> 3 AND catalog_id <> 7
UNION ALL SELECT 3, 7 WHERE NOT EXISTS (SELECT 1 FROM w WHERE source_id = 3 AND winner_id = 7)
UNION ALL SELECT source_id, NULL FROM ig WHERE source_id <> 3"""
ORACLES["override_cleared"] = f"""WITH {REVIEW}
SELECT source_id, catalog_id FROM o WHERE source_id NOT IN (12, 21)
UNION ALL SELECT source_id, NULL FROM ig WHERE source_id <> 12
UNION ALL SELECT 12, NULL WHERE 12 NOT IN (SELECT source_id FROM ig)"""
ORACLES["selections"] = f"WITH {REVIEW} SELECT source_id, effective_id AS catalog_id, source_id AS list_pos FROM state WHERE effective_id IS NOT NULL"

# The weight grid over candidates' scores.
_GRID = [score.weights(p, g) for p, g in queries.GRID]
_TOTALS = " UNION ALL ".join(
    f"SELECT {k} AS setting, q, search_rank, {' + '.join(f'{w!r}::DOUBLE * {n}' for w, n in zip(ws, ('search_score', 'season_score', 'year_score', 'type_score', 'status_score', 'seasonal_score', 'episodes_score'), strict=True))} AS f FROM full_" for k, ws in enumerate(_GRID)
)
ORACLES["weight_grid"] = f"""WITH {_FOUND}, {matched(score.STRICT)}, totals AS ({_TOTALS}),
lined AS (SELECT *, row_number() OVER win AS place, f - lead(CASE WHEN f >= 0.3 THEN f END) OVER win AS lead_gap FROM totals WINDOW win AS (PARTITION BY setting, q ORDER BY f DESC, search_rank))
SELECT setting::BIGINT AS setting, count(*) FILTER (lead_gap IS NULL OR lead_gap > 0.01 OR abs(lead_gap - 0.01) <= 1.1920929e-7) AS winners FROM lined WHERE place = 1 AND f >= 0.3 GROUP BY setting"""
_TEXT = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))"
for _code, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_code}', '{_sign}')"
ORACLES["html_titles"] = f"SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<title') THEN {_TEXT} END AS title FROM pages"

ORACLES["html_links"] = r"""
WITH raw AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1) AS v FROM pages),
x AS (SELECT page_id, unnest(list_transform(v, lambda h: CASE WHEN h[1] IN ('"', '''') THEN substr(h, 2, length(h) - 2) ELSE h END)) AS href FROM raw)
SELECT page_id, count(*) AS n_links, count(*) FILTER (href[1] = '/') AS n_local FROM x WHERE href <> '' GROUP BY page_id"""
