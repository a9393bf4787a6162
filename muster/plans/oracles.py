"""SQL that checks the queries: the domain as common table expressions, and a select a query."""

from __future__ import annotations

DOMAIN = """
ord AS (SELECT o_orderkey AS k, o_custkey AS player_id, substr(o_orderpriority, 1, 1) AS event_type, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
          o_orderdate AS ordered_at, CAST(c_nationkey AS BIGINT) AS alliance_id FROM orders JOIN customer ON o_custkey = c_custkey),
roster AS (SELECT c_custkey AS player_id, CAST(c_nationkey AS BIGINT) AS alliance_id, c_name AS player_name, CAST(round(c_acctbal * 100) AS BIGINT) * 10 AS last_power FROM customer),
part0 AS (SELECT alliance_id, event_type, date_trunc('quarter', ordered_at) AS event_dt, player_id, CAST(floor(sum(cents) / 2500000.0) AS BIGINT) AS points, max(k) AS k
          FROM ord WHERE player_id % 17 <> 0 GROUP BY ALL),
parts AS (SELECT k AS participation_id, concat_ws('-', CAST(alliance_id AS VARCHAR), event_type, strftime(event_dt, '%Y-%m-%d')) AS event_id, alliance_id, event_type, event_dt, player_id, points,
          CASE WHEN k % 5 > 0 THEN k * 1000 END AS power, CASE WHEN k % 11 = 0 THEN -1.0::DOUBLE ELSE (k % 100)::DOUBLE / 100 END AS confidence FROM part0),
parts_r AS (SELECT *, confidence >= 0 AND confidence < 0.5 AS needs_review FROM parts),
ev0 AS (SELECT alliance_id, event_type, date_trunc('quarter', ordered_at) AS event_dt, count(DISTINCT CASE WHEN player_id % 17 <> 0 THEN player_id END) AS n, alliance_id + CAST(event_type AS BIGINT) AS kind FROM ord GROUP BY alliance_id, event_type, date_trunc('quarter', ordered_at)),
evs AS (SELECT concat_ws('-', CAST(alliance_id AS VARCHAR), event_type, strftime(event_dt, '%Y-%m-%d')) AS event_id, alliance_id, event_type, event_dt,
          CASE WHEN kind % 7 <> 0 THEN greatest(0, n + kind % 3 - CASE WHEN kind % 5 = 0 THEN 1 ELSE 0 END) END AS total_battlers,
          CASE WHEN kind % 4 > 0 THEN kind % 30 END AS alliance_rank, CASE WHEN kind % 6 > 0 THEN kind * 100000 END AS total_points FROM ev0),
seen AS (SELECT player_id, max(event_dt) AS last_seen_at FROM parts GROUP BY player_id),
players AS (SELECT roster.*, last_seen_at FROM roster LEFT JOIN seen USING (player_id)),
members AS (SELECT alliance_id, player_id, min(ordered_at) AS joined_at, CASE WHEN player_id % 7 = 0 THEN max(ordered_at) END AS left_at FROM ord GROUP BY alliance_id, player_id),
don0 AS (SELECT alliance_id, CAST(date_trunc('week', ordered_at) AS DATE) AS period_start, player_id, CAST(floor(sum(cents) / 100.0) AS BIGINT) AS honor, max(k) AS k FROM ord GROUP BY ALL),
dons AS (SELECT k AS donation_id, concat_ws('-', CAST(alliance_id AS VARCHAR), CAST(period_start AS VARCHAR)) AS period_id, alliance_id, period_start, player_id, honor, k % 50 + 1 AS leaderboard_position,
          CASE WHEN k % 13 = 0 THEN -1.0::DOUBLE ELSE (k % 100)::DOUBLE / 100 END AS confidence FROM don0),
dons_r AS (SELECT *, confidence >= 0 AND confidence < 0.5 AS needs_review FROM dons),
posts AS (SELECT user_id AS player_id, CAST(ts AS DATE) AS recorded_date, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
stat0 AS (SELECT player_id, recorded_date,
          floor((2 * sum(cents) FILTER (event_type = 'click') + count(*) FILTER (event_type = 'click')) / nullif(2.0 * count(*) FILTER (event_type = 'click'), 0)) / 100 AS attack_pct,
          floor((2 * sum(cents) FILTER (event_type = 'view') + count(*) FILTER (event_type = 'view')) / nullif(2.0 * count(*) FILTER (event_type = 'view'), 0)) / 100 AS hp_pct,
          floor((2 * sum(cents) FILTER (event_type = 'purchase') + count(*) FILTER (event_type = 'purchase')) / nullif(2.0 * count(*) FILTER (event_type = 'purchase'), 0)) / 100 AS defense_pct
          FROM posts GROUP BY player_id, recorded_date),
stats AS (SELECT alliance_id, player_id, player_name, CAST(recorded_date AS VARCHAR) AS recorded_date, CAST(attack_pct AS DOUBLE) AS attack_pct, CAST(hp_pct AS DOUBLE) AS hp_pct, CAST(defense_pct AS DOUBLE) AS defense_pct
          FROM stat0 JOIN roster USING (player_id))
"""


def sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((DOMAIN.strip(), *ctes)) + "\n" + select


RATE = """
firsts AS (SELECT r.player_id, r.alliance_id, least((SELECT min(event_dt) FROM parts p WHERE p.player_id = r.player_id), (SELECT min(joined_at) FROM members m WHERE m.player_id = r.player_id)) AS bound FROM roster r),
eligible AS (SELECT f.player_id, count(e.event_id) AS n FROM firsts f LEFT JOIN evs e ON e.alliance_id = f.alliance_id AND e.event_dt >= f.bound GROUP BY f.player_id),
rates AS (SELECT r.player_id, r.alliance_id, r.player_name, count(DISTINCT p.event_id) AS events_played, max(e.n) AS eligible_events, CAST(sum(p.points) AS BIGINT) AS total_points,
          CAST(round(avg(p.points)) AS BIGINT) AS avg_points, max(p.points) AS best_points, strftime(min(p.event_dt), '%Y-%m-%d') AS first_event, strftime(max(p.event_dt), '%Y-%m-%d') AS last_event
          FROM roster r JOIN eligible e ON e.player_id = r.player_id LEFT JOIN parts p ON p.player_id = r.player_id GROUP BY r.player_id, r.alliance_id, r.player_name)
"""
DELTA = """
delta AS (SELECT e.event_id, e.alliance_id, strftime(e.event_dt, '%Y-%m-%d') AS event_date, e.total_battlers AS declared, count(p.participation_id) AS imported,
          count(p.participation_id) FILTER (p.points > 0) AS scoring, count(p.participation_id) FILTER (p.needs_review) AS flagged
          FROM evs e LEFT JOIN parts_r p ON p.event_id = e.event_id GROUP BY ALL),
delta2 AS (SELECT *, declared - imported AS delta, CASE WHEN declared > 0 THEN CAST(floor((2000 * imported + declared) / (2.0 * declared)) / 10 AS DOUBLE) END AS coverage_pct FROM delta)
"""
REVIEW = """
review AS (
  SELECT 'participation' AS kind, participation_id AS row_id, event_id, CAST(NULL AS VARCHAR) AS period_id, alliance_id, player_id, confidence, points AS value, power, strftime(event_dt, '%Y-%m-%d') AS label FROM parts_r WHERE needs_review
  UNION ALL
  SELECT 'donation', donation_id, NULL, period_id, alliance_id, player_id, confidence, honor, NULL, strftime(period_start, '%Y-%m-%d') FROM dons_r WHERE needs_review)
"""
BOARD = """
board AS (SELECT event_id, p.alliance_id, event_type, strftime(event_dt, '%Y-%m-%d') AS event_date, player_id, player_name, points, power, confidence, needs_review,
          rank() OVER (PARTITION BY event_id ORDER BY points DESC) AS rank FROM parts_r p JOIN roster USING (player_id))
"""
