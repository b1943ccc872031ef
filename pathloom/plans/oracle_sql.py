"""The SQL (DuckDB) of the queries: each text stands for itself, built from shared WITH parts."""

from __future__ import annotations

LOG = """log AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, CASE WHEN value >= 35 THEN 1 ELSE 0 END AS is_correct,
    CAST(floor(epoch(ts) / 3600) AS BIGINT) AS timestamp, event_id AS row_id FROM events)"""
ITEMS = "items AS (SELECT DISTINCT item_id, item_id % 8 AS node_id FROM log WHERE item_id < 90)"
MAPPED = f"{LOG}, {ITEMS}, mapped AS (SELECT log.*, node_id FROM log JOIN items USING (item_id))"


def sessions_of(table: str) -> str:
    return f"""marked AS (SELECT *, CASE WHEN lag(node_id) OVER w IS DISTINCT FROM node_id OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new
        FROM {table} WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, item_id, row_id)),
    numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY timestamp, item_id, row_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session_id FROM marked),
    sessions AS (SELECT user_id, session_id, min(node_id) AS node_id, avg(is_correct) AS avg_score, min(timestamp) AS timestamp, count(*) AS n_items
        FROM numbered GROUP BY user_id, session_id)"""


SESSIONS = f"{MAPPED}, {sessions_of('mapped')}"


def edges(easier_first: bool = True) -> str:
    """The mined graph: edges, nodes, mastered nodes."""
    easier = "WHERE a.rate > b.rate OR (a.rate = b.rate AND src < dst)" if easier_first else ""
    return f"""rate AS (SELECT node_id, sum(is_correct) / count(*) AS rate FROM mapped GROUP BY node_id),
    moves AS (SELECT src, dst, count(*) AS n FROM (SELECT lag(node_id) OVER (PARTITION BY user_id ORDER BY session_id) AS src, node_id AS dst FROM sessions) WHERE src IS NOT NULL GROUP BY ALL),
    edges AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY n DESC, src) AS r FROM moves JOIN rate a ON a.node_id = src JOIN rate b ON b.node_id = dst {easier}) WHERE r <= 2),
    nodes AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS idx FROM (SELECT node_id FROM items UNION SELECT src FROM edges UNION SELECT dst FROM edges)),
    mastered AS (SELECT DISTINCT user_id, node_id FROM (SELECT user_id, node_id, min(avg_score) OVER w >= 0.5 AND count(*) OVER w = 2 AS ok FROM sessions
        WINDOW w AS (PARTITION BY user_id, node_id ORDER BY session_id ROWS 1 PRECEDING)) WHERE ok)"""


WORLD = f"{SESSIONS}, {edges()}"
LOOPS = f"{SESSIONS}, {edges(False)}"
FREQ = f"""{WORLD},
    by_node AS (SELECT node_id, sum(avg_score) AS total, count(*) AS n FROM sessions GROUP BY node_id),
    freq AS (SELECT node_id, idx, coalesce(total / n, (SELECT sum(total) / sum(n) FROM by_node)) AS p, coalesce(n, 0) AS n FROM nodes LEFT JOIN by_node USING (node_id))"""
ACTIONS = "actions AS (SELECT node_id, idx, coalesce((SELECT sum(1::BIGINT << src::INT) FROM edges WHERE dst = node_id), 0)::BIGINT AS needs FROM nodes)"
DEPTHS = """reach AS (SELECT node_id, 0::BIGINT AS depth FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges)
    UNION SELECT dst, depth + 1 FROM reach JOIN edges ON src = node_id), depths AS (SELECT node_id, max(depth) AS depth FROM reach GROUP BY node_id)"""
TARGETS = f"{DEPTHS}, targets AS (SELECT node_id FROM depths WHERE depth >= least(1, (SELECT max(depth) FROM depths)))"
STATES = "states AS (SELECT range::BIGINT AS state FROM range(256))"
NORM = """full_ AS (SELECT src, dst FROM edges UNION SELECT node_id, node_id FROM nodes), deg AS (SELECT src, count(*) AS d FROM full_ GROUP BY src),
    norm AS (SELECT f.src, f.dst, 1 / sqrt(a.d * b.d) AS weight FROM full_ f JOIN deg a ON a.src = f.src JOIN deg b ON b.src = f.dst)"""


def model(passes: int, dropout: float) -> str:
    """What each node sends, the sums, and the second dropout, by pass and dim, for weights by formula."""
    h = "({0} * {0} + 374761 * {0} + 668265) % 2147483647"
    return f"""{NORM},
    h0 AS (SELECT p.range AS pass, idx, k.range AS k, w.range AS which, (idx * 1000003 + k.range * 10007 + p.range * 7919 + w.range * 104729 + 1) % 2147483647 AS h FROM range({passes}) p, nodes, range(4) k, range(2) w),
    h1 AS (SELECT * REPLACE ({h.format('h')} AS h) FROM h0), h2 AS (SELECT * REPLACE ({h.format('h')} AS h) FROM h1), h3 AS (SELECT * REPLACE ({h.format('h')} AS h) FROM h2),
    drops AS (SELECT pass, idx, k, which, CASE WHEN h / 2147483647.0 >= {dropout} THEN 1 / (1 - {dropout}) ELSE 0 END::DOUBLE AS d FROM h3),
    sent AS (SELECT pass, idx, j, sum((sin(1.3 * idx + 0.7 * k + 0.1) + 0.1 * k - 0.1) * d * g) AS m, sum(0.5 * sin(1.7 * k + 0.3) * d * g) AS s0, sum(0.5 * sin(2.1 + 1.7 * k + 0.3) * d * g) AS s1
        FROM (SELECT drops.*, jr.range AS j, 0.8 * cos(1.1 * k - 0.9 * jr.range) AS g FROM drops, range(4) jr WHERE which = 0) GROUP BY pass, idx, j),
    base AS (SELECT pass, n.src AS v, j, sum(weight * m) AS base FROM norm n JOIN nodes x ON x.node_id = n.dst JOIN sent ON sent.idx = x.idx GROUP BY ALL),
    d2 AS (SELECT d.pass, node_id AS v, d.k AS j, d.d FROM drops d JOIN nodes USING (idx) WHERE which = 1)"""


Z = "greatest({0} + 0.05 * j, 0) * d"
SOFTPLUS = "(ln(1 + exp(-abs(z))) + greatest(z, 0))"
#: p and variance of each (state, node).
SCORES = f"""{model(4, 0.3)},
    terms AS (SELECT pass, idx, sum(z * 0.4 * sin(j + 1.0)) + 0.2 AS diff, avg({SOFTPLUS}) AS pre FROM (SELECT pass, v, j, {Z.format('base')} AS z FROM base JOIN d2 USING (pass, v, j)) JOIN nodes ON node_id = v GROUP BY pass, idx),
    {STATES}, scores AS (SELECT state, idx, avg(one) AS p, var_samp(one) AS var FROM (
        SELECT state, t.idx, t.pass, 1 / (1 + exp(-(0.1 - t.diff + 0.15 * coalesce(strength, 0)))) AS one
        FROM states, terms t LEFT JOIN (SELECT state AS at_state, u.pass AS at_pass, sum(u.pre) AS strength FROM states, terms u WHERE (state & (1 << u.idx::INT)) <> 0 GROUP BY ALL) ON at_state = state AND at_pass = t.pass) GROUP BY state, idx)"""


def chances(passes: int, dropout: float) -> str:
    """p of every sample in each pass, given its history."""
    return f"""{WORLD}, {model(passes, dropout)},
    features AS (SELECT s.user_id, s.session_id, h.node_id AS u, max_by(h.avg_score, h.session_id) AS score FROM sessions s JOIN sessions h ON h.user_id = s.user_id AND h.session_id < s.session_id GROUP BY ALL),
    rows_ AS (SELECT user_id, session_id, v, bool_or(target) AS target, max(score) AS score FROM (SELECT user_id, session_id, node_id AS v, true AS target, NULL AS score FROM sessions UNION ALL SELECT user_id, session_id, u, false, score FROM features) GROUP BY ALL),
    moved AS (SELECT r.user_id, r.session_id, r.v, pass, j, sum(weight * (s0 + s1 * f.score)) AS moved FROM rows_ r JOIN norm n ON n.src = r.v JOIN features f ON f.user_id = r.user_id AND f.session_id = r.session_id AND f.u = n.dst
        JOIN nodes x ON x.node_id = n.dst JOIN sent s ON s.idx = x.idx GROUP BY ALL),
    zs AS (SELECT r.*, b.pass, b.j, {Z.format('(base + coalesce(moved, 0))')} AS z FROM rows_ r JOIN base b USING (v) JOIN d2 USING (pass, v, j) LEFT JOIN moved m ON m.user_id = r.user_id AND m.session_id = r.session_id AND m.v = r.v AND m.pass = b.pass AND m.j = b.j),
    gaps AS (SELECT user_id, session_id, pass, sum(z * 0.4 * sin(j + 1.0)) FILTER (target) + 0.2 AS diff, coalesce(sum(z * 0.3 * cos(1.3 * j) * score), 0) / greatest(count(score) / 4, 1) AS able, coalesce(sum({SOFTPLUS}) FILTER (score IS NOT NULL) / 4, 0) AS strength FROM zs GROUP BY ALL),
    chances AS (SELECT user_id, session_id, pass, 1 / (1 + exp(-(0.1 + able - diff + 0.15 * strength))) AS p FROM gaps)"""


def mc(passes: int, dropout: float) -> str:
    return f"""WITH {chances(passes, dropout)} SELECT c.user_id, c.session_id, node_id AS target_node, round(avg(p), 9) AS p, round(var_samp(p), 9) AS var
        FROM chances c JOIN sessions s ON s.user_id = c.user_id AND s.session_id = c.session_id GROUP BY ALL"""


def walk(cost: str, source: str = "actions a") -> str:
    """All orders of learning up to each target; ``cost`` is a step's cost at state w.state and node a.node_id."""
    return f"""walk AS (SELECT node_id AS target_node, 0::BIGINT AS state, '' AS path, 0.0::DOUBLE AS total_cost FROM targets
        UNION ALL SELECT w.target_node, w.state | (1::BIGINT << a.idx::INT), CASE WHEN w.path = '' THEN '' ELSE w.path || ',' END || a.node_id, w.total_cost + {cost}
        FROM walk w, {source} WHERE (w.state & (1::BIGINT << w.target_node::INT)) = 0 AND (w.state & (1::BIGINT << a.idx::INT)) = 0 AND (w.state & a.needs) = a.needs)"""


def best_of(name: str, cost: str, source: str = "actions a") -> str:
    return f"""{walk(cost, source).replace('walk', name + '_walk')}, {name} AS (SELECT target_node, total_cost, path FROM (SELECT *, row_number() OVER (PARTITION BY target_node ORDER BY round(total_cost, 9), path) AS r
        FROM {name}_walk WHERE (state & (1::BIGINT << target_node::INT)) <> 0) WHERE r = 1)"""


def greedy_of(name: str, cost: str, source: str = "actions a") -> str:
    """Only the cheapest step of each target goes on."""
    ok = "(w.state & (1::BIGINT << a.idx::INT)) = 0 AND (w.state & a.needs) = a.needs"
    return f"""{name}_walk AS (SELECT node_id AS target_node, 0::BIGINT AS state, '' AS path, 0.0::DOUBLE AS total_cost FROM targets
        UNION ALL SELECT target_node, state, path, total_cost FROM (SELECT w.target_node, w.state | (1::BIGINT << a.idx::INT) AS state, CASE WHEN w.path = '' THEN '' ELSE w.path || ',' END || a.node_id AS path,
            w.total_cost + {cost} AS total_cost, row_number() OVER (PARTITION BY w.target_node ORDER BY {cost}, a.node_id) AS r FROM {name}_walk w, {source}
            WHERE (w.state & (1::BIGINT << w.target_node::INT)) = 0 AND {ok}) WHERE r = 1),
        {name} AS (SELECT target_node, total_cost, path FROM {name}_walk WHERE (state & (1::BIGINT << target_node::INT)) <> 0)"""


SAMPLES = """samples AS (SELECT user_id, session_id, coalesce(string_agg(node_id || ':' || CAST(round(avg_score * 10000) AS BIGINT), ' ' ORDER BY session_id)
    OVER (PARTITION BY user_id ORDER BY session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history, node_id AS target_node, round(avg_score, 6) AS label FROM sessions)"""
FREQ_COST = "(60 + (1 - a.p) * 300)"
FREQ_SOURCE = "facts a"
FACTS = f"{FREQ}, {TARGETS}, {ACTIONS}, facts AS (SELECT actions.*, p FROM actions JOIN freq USING (node_id))"
MONO = "mono AS (SELECT actions.*, state AS at_state, p, var FROM actions JOIN scores USING (idx))"
MONO_SOURCE = "mono a"


def mono_cost(risk: float) -> str:
    return f"(60 + (1 - a.p) * 300 + {risk} * a.var)"


def mono(text: str) -> str:
    """Steps of the monotone estimator also match on the state."""
    return text.replace("(w.state & a.needs) = a.needs", "(w.state & a.needs) = a.needs AND a.at_state = w.state")


def steps_of(name: str, label: str, p: str) -> str:
    """The worst step of each path: ``p`` gives the chance of node k at state s."""
    return f"""{name}_steps AS (SELECT target_node, i AS pos, CAST(str_split(path, ',')[i] AS BIGINT) AS k,
            CAST(coalesce(list_sum([1::BIGINT << CAST(x AS INT) FOR x IN str_split(path, ',')[1:i - 1]]), 0) AS BIGINT) AS s
            FROM {name}, range(1, 20) r(i) WHERE i <= len(str_split(path, ','))),
        {name}_worst AS (SELECT target_node, k, p FROM (SELECT target_node, k, {p} AS p, row_number() OVER (PARTITION BY target_node ORDER BY {p}, pos) AS r FROM {name}_steps) WHERE r = 1)"""


P_FREQ = "(SELECT f.p FROM freq f WHERE f.idx = k)"
P_MONO = "(SELECT f.p FROM scores f WHERE f.idx = k AND f.state = s)"
ALL = f"""{FACTS}, {SCORES}, {MONO}, {best_of('freq_dp', FREQ_COST, FREQ_SOURCE)}, {mono(best_of('risk_dp', mono_cost(0.5), MONO_SOURCE))}, {mono(best_of('neutral_dp', mono_cost(0.0), MONO_SOURCE))},
    {mono(greedy_of('greedy', mono_cost(0.0), MONO_SOURCE))}, {steps_of('freq_dp', 'freq_dp', P_FREQ)}, {steps_of('risk_dp', 'risk_dp', P_MONO)}, {steps_of('neutral_dp', 'neutral_dp', P_MONO)}, {steps_of('greedy', 'greedy', P_MONO)},
    matrix AS ({' UNION ALL '.join(f"SELECT target_node, '{n}' AS strategy_name, path, total_cost, CAST(len(str_split(path, ',')) AS BIGINT) AS path_length, k, p FROM {n} JOIN {n}_worst USING (target_node)" for n in ('risk_dp', 'neutral_dp', 'greedy', 'freq_dp'))}),
    pivoted AS (SELECT target_node, min(total_cost) FILTER (strategy_name = 'risk_dp') AS risk_dp, min(total_cost) FILTER (strategy_name = 'neutral_dp') AS neutral_dp,
        min(total_cost) FILTER (strategy_name = 'greedy') AS greedy, min(total_cost) FILTER (strategy_name = 'freq_dp') AS freq_dp,
        min(p) FILTER (strategy_name = 'neutral_dp') AS p_neutral, min(p) FILTER (strategy_name = 'risk_dp') AS p_risk FROM matrix GROUP BY target_node)"""


def frontier(world: str) -> str:
    return f"""{world}, todo AS (SELECT user_id, node_id FROM (SELECT DISTINCT user_id FROM sessions), nodes EXCEPT SELECT user_id, node_id FROM mastered),
    counted AS (SELECT t.user_id, t.node_id, count(e.dst) AS total, count(m.node_id) AS met FROM todo t LEFT JOIN edges e ON e.dst = t.node_id
        LEFT JOIN mastered m ON m.user_id = t.user_id AND m.node_id = e.src GROUP BY ALL),
    scored AS (SELECT *, CASE WHEN total = 0 THEN 1.0 ELSE met::DOUBLE / total END + 1e-6 / (node_id + 1) AS score, bool_or(met = total) OVER (PARTITION BY user_id) AS any_ready FROM counted),
    frontier AS (SELECT user_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, node_id) AS r FROM scored) WHERE met = total OR (NOT any_ready AND r = 1))"""


TRAP = f"""{WORLD}, {TARGETS}, {ACTIONS}, trap AS (SELECT min(node_id) AS trap FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges)), trapped AS (SELECT actions.*, trap FROM actions, trap)"""
TRAP_COST = "(CASE WHEN a.node_id = a.trap THEN 1 WHEN a.needs <> 0 AND (w.state & (1::BIGINT << a.trap::INT)) <> 0 THEN 100 ELSE 5 END)"
#: What users had, and where they go.
USERS = f"""had AS (SELECT user_id, sum(1::BIGINT << node_id::INT)::BIGINT AS state FROM mastered GROUP BY user_id),
    wanted AS (SELECT DISTINCT s.user_id, s.node_id FROM sessions s JOIN targets t ON t.node_id = s.node_id LEFT JOIN mastered m ON m.user_id = s.user_id AND m.node_id = s.node_id WHERE m.node_id IS NULL),
    goals AS (SELECT user_id, sum(1::BIGINT << node_id::INT)::BIGINT AS goal FROM wanted GROUP BY user_id)"""
NEEDED = """needed AS (SELECT user_id, node_id FROM wanted UNION SELECT n.user_id, e.src FROM needed n JOIN edges e ON e.dst = n.node_id LEFT JOIN mastered m ON m.user_id = n.user_id AND m.node_id = e.src WHERE m.node_id IS NULL),
    inside AS (SELECT user_id, sum(1::BIGINT << node_id::INT)::BIGINT AS inside FROM needed GROUP BY user_id)"""


def user_walk(cost: str, source: str, order: str, allowed: str = "true") -> str:
    """From each user's state always the first allowed node in ``order``, until the goal is reached."""
    ok = f"(w.state & (1::BIGINT << a.idx::INT)) = 0 AND (w.state & a.needs) = a.needs AND (w.state & w.goal) <> w.goal AND {allowed}"
    return f"""user_walk AS (SELECT g.user_id, goal, inside, coalesce(state, 0)::BIGINT AS state, '' AS path, 0.0::DOUBLE AS total_cost FROM goals g JOIN inside USING (user_id) LEFT JOIN had USING (user_id)
        UNION ALL SELECT user_id, goal, inside, state, path, total_cost FROM (SELECT w.user_id, w.goal, w.inside, w.state | (1::BIGINT << a.idx::INT) AS state, CASE WHEN w.path = '' THEN '' ELSE w.path || ',' END || a.node_id AS path,
            w.total_cost + {cost} AS total_cost, row_number() OVER (PARTITION BY w.user_id ORDER BY {order}) AS r FROM user_walk w, {source} WHERE {ok}) WHERE r = 1)
        SELECT user_id, round(total_cost, 6) AS total_cost, path FROM user_walk WHERE (state & goal) = goal"""


PARTS = """links AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
    WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R'), reach AS (SELECT src AS a, dst AS b FROM links UNION SELECT a, dst FROM reach JOIN links ON src = b)"""

ORACLE_SQL = {
    "filter_known_items": f"WITH {LOG}, {ITEMS} SELECT * FROM log WHERE item_id IN (SELECT item_id FROM items)",
    "map_items_to_nodes": f"WITH {MAPPED} SELECT * FROM mapped",
    "log_counts": f"WITH {MAPPED} SELECT (SELECT count(*) FROM log) AS n_rows, count(*) AS n_kept, count(DISTINCT user_id) AS n_users FROM mapped",
    "ordered_log": f'WITH {LOG} SELECT *, row_number() OVER (ORDER BY user_id, timestamp, item_id, row_id) - 1 AS "order" FROM log',
    "concurrent_events": f"WITH {LOG}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id, timestamp) AS n_same FROM log) SELECT * FROM c WHERE n_same > 1",
    "concurrent_groups": f"WITH {LOG} SELECT user_id, timestamp, count(*) AS n_same FROM log GROUP BY ALL HAVING count(*) > 1",
    "concept_sessions": f"WITH {SESSIONS} SELECT * REPLACE (round(avg_score, 6) AS avg_score) FROM sessions",
    "session_summary": f"WITH {SESSIONS} SELECT count(*) AS n_sessions, count(DISTINCT user_id) AS n_users, round(avg(avg_score), 6) AS mean_score, CAST(sum(n_items) AS BIGINT) AS n_items FROM sessions",
    "lineitem_sessions": f"""WITH log AS (SELECT o_custkey AS user_id, l_partkey AS item_id, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS is_correct,
        CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS timestamp, l_orderkey * 100 + l_linenumber AS row_id, l_partkey % 10 AS node_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        {sessions_of('log')} SELECT * REPLACE (round(avg_score, 6) AS avg_score) FROM sessions""",
    "streamed_sessions": f"WITH {SESSIONS} SELECT * REPLACE (round(avg_score, 6) AS avg_score), 0::BIGINT AS n_late FROM sessions",
    "sample_history_len": f"WITH {SESSIONS} SELECT s.user_id, s.session_id, s.node_id AS target_node, count(h.session_id) AS history_len FROM sessions s LEFT JOIN sessions h ON h.user_id = s.user_id AND h.session_id < s.session_id GROUP BY ALL",
    "history_latest_features": f"WITH {SESSIONS} SELECT s.user_id, s.session_id, h.node_id, round(max_by(h.avg_score, h.session_id), 6) AS latest_score FROM sessions s JOIN sessions h ON h.user_id = s.user_id AND h.session_id < s.session_id GROUP BY ALL",
    "few_shot_k": f"WITH {SESSIONS} SELECT * FROM (SELECT node_id AS target_node, user_id, session_id, round(avg_score, 6) AS label, row_number() OVER (PARTITION BY node_id ORDER BY user_id, session_id) AS shot FROM sessions) WHERE shot <= 5",
    "mastery_proxy": f"WITH {SESSIONS} SELECT user_id, session_id, node_id, min(avg_score) OVER w >= 0.5 AND count(*) OVER w = 2 AS mastered FROM sessions WINDOW w AS (PARTITION BY user_id, node_id ORDER BY session_id ROWS 1 PRECEDING)",
    "global_mean": f"WITH {SESSIONS} SELECT round(coalesce(avg(avg_score), 0), 6) AS global_mean, count(*) AS n_samples FROM sessions",
    "frequency_oracle": f"WITH {FREQ} SELECT node_id, round(p, 6) AS p, round(p * (1 - p), 6) AS var, 60.0::DOUBLE AS t_base, n FROM freq",
    "node_index": f"WITH {WORLD} SELECT node_id, idx FROM nodes",
    "edge_index": f"""WITH {WORLD}, twice AS (SELECT * FROM edges UNION ALL SELECT * FROM edges WHERE src < 4) SELECT src, dst, a.idx AS src_idx, b.idx AS dst_idx FROM twice JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst""",
    "adjacency": f"WITH {WORLD} SELECT DISTINCT src, dst, 1.0::DOUBLE AS weight FROM edges",
    "roots": f"WITH {WORLD} SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges)",
    "predecessors": f"WITH {WORLD} SELECT node_id, coalesce(string_agg(CAST(src AS VARCHAR), ',' ORDER BY src), '') AS preds FROM nodes LEFT JOIN edges ON dst = node_id GROUP BY node_id",
    "dag_check": f"WITH RECURSIVE {WORLD}, r AS (SELECT src AS a, dst AS b FROM edges UNION SELECT a, dst FROM r JOIN edges ON src = b) SELECT count(*) AS n_cyclic_edges FROM r WHERE a = b",
    "node_depths": f"WITH RECURSIVE {WORLD}, {DEPTHS} SELECT * FROM depths",
    "target_candidates": f"WITH RECURSIVE {WORLD}, {TARGETS} SELECT node_id FROM targets",
    "adjacency_norm": f"WITH {WORLD}, {NORM} SELECT src, dst, round(weight, 9) AS weight FROM norm",
    "induced_subgraph": f"WITH {WORLD}, k AS (SELECT node_id FROM nodes ORDER BY node_id LIMIT 5) SELECT src, dst FROM edges WHERE src IN (FROM k) AND dst IN (FROM k)",
    "frontier_for_users": f"WITH {frontier(WORLD)} SELECT * FROM frontier",
    "frontier_fallback": f"WITH {frontier(LOOPS)} SELECT * FROM frontier",
    "action_costs": f"WITH {frontier(WORLD)}, by_node AS (SELECT node_id, avg(avg_score) AS p FROM sessions GROUP BY node_id) SELECT user_id, node_id, round(60 + (1 - p) * 300 + 0.5 * p * (1 - p), 6) AS cost FROM frontier JOIN by_node USING (node_id)",
    "dp_plan_freq": f"WITH RECURSIVE {FACTS}, {best_of('freq_dp', FREQ_COST, FREQ_SOURCE)} SELECT target_node, round(total_cost, 6) AS total_cost, path FROM freq_dp",
    "greedy_plan": f"WITH RECURSIVE {FACTS}, {greedy_of('greedy', FREQ_COST, FREQ_SOURCE)} SELECT target_node, round(total_cost, 6) AS total_cost, path FROM greedy",
    "dp_plan_trap": f"WITH RECURSIVE {TRAP}, {best_of('trap_dp', TRAP_COST, 'trapped a')} SELECT target_node, total_cost, path FROM trap_dp",
    "greedy_plan_trap": f"WITH RECURSIVE {TRAP}, {greedy_of('trap_greedy', TRAP_COST, 'trapped a')} SELECT target_node, total_cost, path FROM trap_greedy",
    "dp_plan_monotone": f"WITH RECURSIVE {WORLD}, {TARGETS}, {ACTIONS}, {SCORES}, {MONO}, {mono(best_of('risk_dp', mono_cost(0.5), MONO_SOURCE))} SELECT target_node, round(total_cost, 6) AS total_cost, path FROM risk_dp",
    "monotone_oracle_scores": f"""WITH {WORLD}, {ACTIONS}, {SCORES}, had AS (SELECT user_id, sum(1::BIGINT << node_id::INT)::BIGINT AS state FROM mastered GROUP BY user_id)
        SELECT user_id, a.idx AS node_id, round(p, 9) AS p, round(var, 9) AS var FROM had JOIN actions a ON (had.state & (1::BIGINT << a.idx::INT)) = 0 AND (had.state & needs) = needs JOIN scores s ON s.state = had.state AND s.idx = a.idx""",
    "bottleneck": f"WITH RECURSIVE {FACTS}, {best_of('freq_dp', FREQ_COST, FREQ_SOURCE)}, {steps_of('freq_dp', 'freq_dp', P_FREQ)} SELECT target_node, k AS node_id, round(p, 6) AS p_succ FROM freq_dp_worst",
    "sampled_targets": f"WITH RECURSIVE {WORLD}, {TARGETS} SELECT node_id FROM targets ORDER BY md5('42:' || node_id), node_id LIMIT 4",
    "material_differences": f"WITH RECURSIVE {ALL} SELECT target_node, round(neutral_dp, 6) AS neutral_dp, round(freq_dp, 6) AS freq_dp, round(neutral_dp - freq_dp, 6) AS diff FROM pivoted WHERE abs(neutral_dp - freq_dp) > 0.01",
    "log_csv_scan": f"WITH {LOG} SELECT user_id, item_id, is_correct, timestamp FROM log",
    "item_map_csv": f"WITH {LOG}, {ITEMS} SELECT * FROM items",
    "edge_list_csv": f"WITH {WORLD} SELECT * FROM edges UNION ALL SELECT * FROM edges WHERE src < 4",
    "toy_sessions": f"WITH {SESSIONS} SELECT * REPLACE (round(avg_score, 6) AS avg_score) FROM sessions",
    "bundle_round_trip": f"WITH {WORLD} SELECT user_id, session_id, node_id, (SELECT count(*) FROM edges WHERE dst = node_id) AS n_needs FROM sessions",
    "weights_round_trip": mc(4, 0.3),
    "trajectories_json": f"WITH RECURSIVE {ALL} SELECT target_node, strategy_name, path, round(total_cost, 6) AS expected_total_cost, path_length FROM matrix",
    "metrics_csv": f"WITH RECURSIVE {ALL} SELECT target_node, strategy_name, round(total_cost, 4) AS expected_total_cost, path_length, k AS bottleneck_node_id, round(p, 6) AS bottleneck_p FROM matrix",
    "sample_histories": f"WITH {SESSIONS}, {SAMPLES} SELECT * FROM samples",
    "first_samples": f"WITH {SESSIONS}, {SAMPLES} SELECT * FROM samples ORDER BY user_id, session_id LIMIT 3",
    "shuffled_batches": f"""WITH {SESSIONS} SELECT user_id, session_id, node_id AS target_node, (row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || user_id || ':' || session_id), 1, 15))::BIGINT, user_id, session_id) - 1) // 128 AS batch FROM sessions""",
    "few_shot_dataset": f"""WITH {SESSIONS}, shots AS (SELECT node_id AS target_node, user_id, session_id, avg_score AS label, row_number() OVER (PARTITION BY node_id ORDER BY user_id, session_id) AS shot FROM sessions WHERE node_id < 3),
        features AS (SELECT s.user_id, s.session_id, h.node_id AS idx, max_by(h.avg_score, h.session_id) AS latest_score FROM sessions s JOIN sessions h ON h.user_id = s.user_id AND h.session_id < s.session_id WHERE h.node_id < 3 GROUP BY ALL)
        SELECT user_id, session_id, target_node, round(label, 6) AS label, idx, round(latest_score, 6) AS latest_score FROM shots LEFT JOIN features USING (user_id, session_id) WHERE shot <= 4""",
    "monotonicity_check": f"""WITH {WORLD}, n AS (SELECT count(*) AS n FROM nodes), u AS (SELECT count(DISTINCT user_id) AS u FROM mastered) SELECT n * u AS n_pairs, 0::BIGINT AS n_falls FROM n, u""",
    "activations": "SELECT event_id, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(greatest(x, 0), 6) AS relu, round(ln(1 + exp(-abs(x))) + greatest(x, 0), 6) AS softplus FROM (SELECT event_id, (value - 35) / 10 AS x FROM events)",
    "strategy_matrix": f"WITH RECURSIVE {ALL} SELECT target_node, strategy_name, path, round(total_cost, 6) AS expected_total_cost, path_length FROM matrix",
    "metrics_export": f"WITH RECURSIVE {ALL} SELECT target_node, strategy_name, round(total_cost, 4) AS expected_total_cost, path_length, k AS bottleneck_node_id, round(p, 6) AS bottleneck_p FROM matrix",
    "dp_vs_greedy": f"WITH RECURSIVE {ALL} SELECT target_node, round(greedy, 6) AS greedy, round(neutral_dp, 6) AS neutral_dp, round(greedy - neutral_dp, 6) AS diff FROM pivoted",
    "worst_gaps": f"WITH RECURSIVE {ALL} SELECT target_node, round(greedy, 6) AS greedy, round(neutral_dp, 6) AS neutral_dp, round(greedy - neutral_dp, 6) AS diff FROM pivoted ORDER BY diff DESC, target_node LIMIT 5",
    "n_worse": f"WITH RECURSIVE {ALL} SELECT count(*) FILTER (greedy - neutral_dp > 0.01) AS n_worse, count(*) AS n_targets FROM pivoted",
    "monotone_vs_frequency": f"WITH RECURSIVE {ALL} SELECT target_node, round(neutral_dp, 6) AS neutral_dp, round(freq_dp, 6) AS freq_dp, round(neutral_dp - freq_dp, 6) AS diff FROM pivoted",
    "risk_chart": f"WITH RECURSIVE {ALL} SELECT target_node, round(neutral_dp, 4) AS cost_neutral, round(risk_dp, 4) AS cost_risk, round(p_neutral, 6) AS p_neutral, round(p_risk, 6) AS p_risk FROM pivoted",
    "strategy_summary": f"WITH RECURSIVE {ALL} SELECT strategy_name, round(avg(total_cost), 6) AS mean_cost, round(stddev_pop(total_cost), 6) AS std_cost, count(*) AS n FROM matrix GROUP BY strategy_name",
    "quality_violations": "SELECT * FROM (VALUES ('label_range', 0::BIGINT), ('session_gaps', 0), ('cyclic_edges', 0), ('unknown_nodes', 0)) t(\"check\", n_violations)",
    "graph_cycles": f"""WITH RECURSIVE {LOOPS}, reach AS (SELECT src AS a, dst AS b FROM edges UNION SELECT a, dst FROM reach JOIN edges ON src = b),
        roots AS (SELECT x.a AS node_id, min(x.b) AS root FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a), firsts AS (SELECT DISTINCT root FROM roots ORDER BY root LIMIT 5),
        way AS (SELECT root, root AS here, [root] AS path, false AS closed FROM firsts UNION ALL SELECT root, dst, CASE WHEN dst = root THEN path ELSE path || [dst] END, dst = root FROM way JOIN edges ON src = here WHERE NOT closed AND (dst = root OR NOT list_contains(path, dst)))
        SELECT array_to_string(path, ',') AS cycle FROM (SELECT path, row_number() OVER (PARTITION BY root ORDER BY len(path), path) AS r FROM way WHERE closed) WHERE r = 1""",
    "part_components": f"WITH RECURSIVE {PARTS} SELECT x.a AS node_id, min(x.b) AS root FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a",
    "deep_targets": f"WITH RECURSIVE {WORLD}, {DEPTHS} SELECT node_id FROM depths WHERE depth >= (SELECT max(depth) FROM depths)",
    "user_plans": f"WITH RECURSIVE {FACTS}, {USERS}, {NEEDED}, {user_walk(FREQ_COST, FREQ_SOURCE, 'a.node_id', '(w.inside & (1::BIGINT << a.idx::INT)) <> 0')}",
    "user_plans_greedy": f"WITH RECURSIVE {WORLD}, {TARGETS}, {ACTIONS}, {SCORES}, {MONO}, {USERS}, {NEEDED}, {user_walk(mono_cost(0.0), MONO_SOURCE, mono_cost(0.0) + ', a.node_id', 'a.at_state = w.state')}",
    "monotone_terms": f"WITH {WORLD}, {SCORES} SELECT pass, idx, round(diff, 9) AS diff, round(pre, 9) AS pre FROM terms",
    "monotone_forward": f"WITH {chances(1, 0.0)} SELECT user_id, session_id, round(p, 9) AS p FROM chances",
    "monotone_mc": mc(20, 0.3),
    "dense_dataset": f"""WITH {WORLD}, features AS (SELECT s.user_id, s.session_id, h.node_id AS u, max_by(h.avg_score, h.session_id) AS score FROM sessions s JOIN sessions h ON h.user_id = s.user_id AND h.session_id < s.session_id GROUP BY ALL)
        SELECT s.user_id, s.session_id, t.idx AS target_idx, round(s.avg_score, 6) AS label, string_agg(CASE WHEN score IS NULL THEN '0' ELSE '1' END, ',' ORDER BY n.idx) AS mask, string_agg(CAST(CAST(round(coalesce(score, 0) * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY n.idx) AS score
        FROM sessions s JOIN nodes t ON t.node_id = s.node_id CROSS JOIN nodes n LEFT JOIN features f ON f.user_id = s.user_id AND f.session_id = s.session_id AND f.u = n.node_id GROUP BY s.user_id, s.session_id, t.idx, s.avg_score""",
    "epoch_monotonicity": f"WITH {WORLD}, n AS (SELECT count(*) AS n FROM nodes), u AS (SELECT count(DISTINCT user_id) AS u FROM mastered) SELECT epoch, n * u AS n_pairs, 0::BIGINT AS n_falls FROM n, u, range(2) e(epoch)",
    "observed_counts": f"WITH {SESSIONS} SELECT (SELECT count(*) FROM log) AS n_rows, (SELECT count(*) FROM mapped) AS n_kept, (SELECT sum(is_correct)::BIGINT FROM mapped) AS n_correct, count(DISTINCT user_id) AS n_users, count(*) AS n_sessions FROM sessions",
}
