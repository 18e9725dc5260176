"""The registered queries in DuckDB SQL."""

from __future__ import annotations

from gridspark.jobs.queries import EDGES, MIDDLES


def byte(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5({key} || '{salt}'), 1, 2))::int)"


def grids(keys: str) -> str:
    """CTEs `grid(key, text)` and `image(key, k, text)` of all keys that the query `keys` gives."""
    place = lambda k: f"(('0x' || substr(o, {2 * k + 1}, 2))::int % 64)"
    tiles = " ".join(f"WHEN {place(k)} = p THEN '{t}'" for k, t in reversed(list(enumerate("....$$$$@"))))
    rows = " || chr(10) || ".join(["'##########'", *(f"'#' || substr(cells, {8 * r + 1}, 8) || '#'" for r in range(8)), "'##########'"])
    turned = lambda r: f"list_transform(range(1, length({r}[1]) + 1), lambda c: array_to_string(list_transform(list_reverse({r}), lambda w: substr(w, c, 1)), ''))"
    joined = lambda r: f"array_to_string({r}, chr(10))"
    mirrored = lambda r: f"list_transform({r}, lambda w: reverse(w))"
    images = ", ".join([joined(f"r{k}") for k in range(4)] + [joined(mirrored(f"r{k}")) for k in range(4)])
    return f"""
    keys AS (SELECT DISTINCT key FROM ({keys})),
    hashed AS (SELECT key, translate(md5(key || ':w0') || md5(key || ':w1'), '0123456789abcdef', '######          ') AS base, md5(key || ':o') AS o FROM keys),
    laid AS (SELECT key, array_to_string(list_transform(range(0, 64), lambda p: CASE {tiles} ELSE substr(base, p + 1, 1) END), '') AS cells FROM hashed),
    grid AS (SELECT key, {rows} AS text FROM laid),
    turn0 AS (SELECT key, text, string_split(text, chr(10)) AS r0 FROM grid),
    turn1 AS (SELECT *, {turned("r0")} AS r1 FROM turn0),
    turn2 AS (SELECT *, {turned("r1")} AS r2 FROM turn1),
    turn3 AS (SELECT *, {turned("r2")} AS r3 FROM turn2),
    orbit AS MATERIALIZED (SELECT key, text, [{images}] AS images FROM turn3)"""


NUMBER = "substr(source, 4)::int"
LEVELS = f"""WITH RECURSIVE {grids("SELECT doc_id::varchar AS key FROM documents UNION ALL SELECT (doc_id - 1)::varchar FROM documents")},
    placed AS (SELECT *, {NUMBER} AS source_rank, doc_id % 7 = 0 AND doc_id > 0 AS twin FROM documents),
    lv AS MATERIALIZED (SELECT p.doc_id, p.source, p.source_rank, CASE WHEN source_rank <= 1 THEN 0 WHEN source_rank <= 4 THEN 1 WHEN source_rank = 5 THEN 2 ELSE 3 END AS split_rank,
        CASE WHEN source_rank <= 1 THEN 'test' WHEN source_rank <= 4 THEN 'val' WHEN source_rank = 5 THEN 'hard' ELSE 'train' END AS split,
        (p.doc_id // 100)::int AS file, (p.doc_id % 100)::int AS index, p.source || '/' || lpad((p.doc_id // 100)::varchar, 3, '0') || '#' || (p.doc_id % 100)::varchar AS id,
        CASE WHEN twin THEN o.images[(p.doc_id % 8)::int + 1] ELSE o.text END AS text, list_min(o.images) AS canonical, o.images AS base_images,
        CASE WHEN {byte("p.doc_id::varchar", ":s")} < 230 THEN 'solved' WHEN {byte("p.doc_id::varchar", ":s")} < 243 THEN 'unsolvable' ELSE 'budget_exceeded' END AS status,
        (4 + n_chars % 200)::int AS moves, ((4 + n_chars % 200) // 3)::int AS pushes, ((4 + n_chars % 200) * (4 + n_chars % 200))::bigint AS nodes_expanded
        FROM placed p JOIN orbit o ON o.key = CASE WHEN twin THEN (p.doc_id - 1)::varchar ELSE p.doc_id::varchar END),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY split_rank, source_rank, file, index, id) AS rn FROM lv),
    outcome AS MATERIALIZED (SELECT *, CASE WHEN rn > 1 THEN 'duplicate' WHEN status <> 'solved' THEN 'unsolved' ELSE 'kept' END AS outcome FROM ranked),
    kept AS MATERIALIZED (SELECT * FROM outcome WHERE outcome = 'kept'),
    edges AS MATERIALIZED (SELECT list_transform(quantile_cont(moves::double, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda e: round(e, 9)) AS edges FROM kept WHERE split = 'train'),
    bucketed AS MATERIALIZED (SELECT kept.*, len(list_filter(edges, lambda e: e <= moves))::int AS bucket, edges FROM kept, edges)"""
count = lambda t, tiles: f"(length({t}) - length(translate({t}, '{tiles}', '')))"


def valid(t: str) -> str:
    return f"coalesce(length({t}) = 109 AND len(string_split({t}, chr(10))) = 10 AND len(list_filter(string_split({t}, chr(10)), lambda w: length(w) <> 10)) = 0 AND length(translate({t}, '# @$.*+' || chr(10), '')) = 0 AND {count(t, '@+')} = 1 AND {count(t, '$*')} >= 1 AND {count(t, '$*')} = {count(t, '.*+')}, false)"


BUCKET = "CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 10)::int END"
CONDITION = f"CASE WHEN doc_id % 11 = 0 THEN 10 ELSE 11 + (doc_id % 10)::int END"
TOKENS = f"'8 ' || ({CONDITION})::varchar || ' ' || array_to_string(string_split(translate(replace(text, chr(10), ''), '# @$.*+', '0123456'), ''), ' ') || ' 9'"
PATH = "translate(md5(id), '0123456789abcdef', 'lurdLURDlurdlurd')"
UNIFORM = lambda seed, *keys: f"(('0x' || substr(md5('{seed}' || {' || '.join(f''' ':' || ({k})::varchar''' for k in keys)}), 1, 8))::bigint / 4294967296.0)"
level = lambda columns, tail="": f"{LEVELS} SELECT {columns} FROM {tail or 'lv'}"
BROKEN = "CASE WHEN doc_id % 4 = 0 THEN chr(10) || CASE WHEN doc_id % 8 = 0 THEN '-_-' || chr(10) ELSE '' END || replace(rtrim(text, ' '), ' ', '-') || chr(13) || chr(10) || chr(10) WHEN doc_id % 4 = 1 THEN replace(text, '#' || chr(10) || '#', chr(10) || '#') WHEN doc_id % 4 = 2 THEN replace(text, '$', 'x') ELSE text END"

ORACLES = {
    "fn1_valid": level(f"id, {valid('text')} AS valid"),
    "fn2_counts": level(f"id, {count('text', '@+')} AS players, {count('text', '$*')} AS boxes, {count('text', '.*+')} AS goals, {count('text', '#')} AS walls"),
    "fn7_canonical": level("id, canonical"),
    "fn8_condition": level(f"id, {CONDITION} AS token"),
    "fn9_encode": level(f"id, {TOKENS} AS tokens"),
    "fn10_decode": level("id, CASE WHEN doc_id % 3 <> 0 THEN text END AS text"),
    "fn11_level_id": level("id, file, index"),
    "fn12_bucket": level("id, bucket", "bucketed"),
    "fn13_bucket_labels": f"""{LEVELS}, e AS (SELECT unnest(edges) AS edge, generate_subscripts(edges, 1) AS k FROM edges), b AS (SELECT k, ceil(edge)::int AS lo, ceil(edge)::int - 1 AS hi, lead(ceil(edge)::int - 1) OVER (ORDER BY k) AS next FROM e)
        SELECT 0 AS bucket, '≤ ' || hi::varchar AS label FROM b WHERE k = 1 UNION ALL SELECT k::int, CASE WHEN next IS NULL THEN '≥ ' || lo::varchar WHEN next = lo THEN lo::varchar ELSE lo::varchar || '–' || next::varchar END FROM b""",
    "fn15_path_counts": level(f"id, length({PATH}) AS moves, length(regexp_replace({PATH}, '[^A-Z]', '', 'g')) AS pushes"),
    "win1_dedup": level("id, split, outcome", "outcome"),
    "win2_ordinal_rank": level("split, moves, doc_id AS sample_id, row_number() OVER (PARTITION BY split ORDER BY moves, doc_id) - 1 AS rank"),
    "win3_first_of_source": level("id", "(SELECT id, row_number() OVER (PARTITION BY source ORDER BY file, index, id) AS k FROM lv) WHERE k <= 25"),
    "agg1_source_stats": level("source, count(*) AS levels, " + ", ".join(f"count_if(status = '{s}')::bigint AS {s}" for s in ("solved", "unsolvable", "budget_exceeded", "invalid")), "lv GROUP BY source"),
    "win1_by_source": level("id, split, outcome", "outcome"),
    "set2_first_levels": level("canonical, id AS first_id", "ranked WHERE rn = 1 AND canonical IS NOT NULL"),
    "agg2_split_stats": level("split, count_if(outcome = 'kept')::bigint AS kept, count_if(outcome = 'duplicate')::bigint AS duplicates_removed, count_if(outcome = 'unsolved')::bigint AS unsolved_removed", "outcome GROUP BY split"),
    "agg3_edges": level("(generate_subscripts(edges, 1) - 1)::int AS k, unnest(edges) AS edge", "edges"),
    "agg4_move_stats": level("split, min(moves)::int AS moves_min, trunc(quantile_cont(moves::double, 0.1))::int AS moves_p10, trunc(quantile_cont(moves::double, 0.5))::int AS moves_median, trunc(quantile_cont(moves::double, 0.9))::int AS moves_p90, max(moves)::int AS moves_max, trunc(quantile_cont(pushes::double, 0.5))::int AS pushes_median, trunc(quantile_cont(nodes_expanded::double, 0.5))::bigint AS nodes_median", "kept GROUP BY split"),
    "agg5_bucket_counts": f"{LEVELS}, s AS (SELECT DISTINCT split FROM bucketed), spine AS (SELECT split, b::int AS bucket FROM s, range(0, 10) r(b)) SELECT spine.split, spine.bucket, count(x.id) AS n FROM spine LEFT JOIN bucketed x ON x.split = spine.split AND x.bucket = spine.bucket GROUP BY ALL",
    "agg14_nearest_rank": f"{LEVELS}, s AS (SELECT nodes_expanded AS v, row_number() OVER (ORDER BY nodes_expanded) - 1 AS k, count(*) OVER () AS n FROM lv) SELECT min(v) FILTER (k = floor(0.5 * n)) AS p50, min(v) FILTER (k = floor(0.99 * n)) AS p99, max(v) AS largest FROM s",
    "agg15_status_share": level("status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share", "lv GROUP BY status"),
    "agg16_effort": level("split, round(corr(pushes, moves), 9) AS pushes_moves, round(corr(nodes_expanded, moves), 9) AS nodes_moves", "kept GROUP BY split"),
    "set1_union": level("id, split", "lv WHERE split IN ('val', 'test')"),
    "set2_canonicals": level("DISTINCT canonical"),
    "ord2_first_of_split": level("id", "(SELECT * FROM lv WHERE split = 'train' ORDER BY split_rank, source_rank, file, index, id LIMIT 100)"),
    "smp1_fraction": level("id", f"(SELECT id, row_number() OVER (ORDER BY {UNIFORM('seed', 'id')}, id) - 1 AS k, count(*) OVER () AS n FROM lv) WHERE k < floor(n * 0.3)"),
    "smp4_dropout": level(f"id, CASE WHEN {UNIFORM('seed', 'id')} >= 0.1 THEN {BUCKET} END AS bucket"),
    "smp5_draws": f"{LEVELS}, idx AS (SELECT id, row_number() OVER (ORDER BY {UNIFORM('seed:place', 'id')}, id) - 1 AS k, count(*) OVER () AS n FROM lv), want AS (SELECT (i // 64)::int AS step, (i % 64)::int AS slot FROM range(0, 2560) r(i)) SELECT step, slot, id FROM want JOIN idx ON idx.k = floor({UNIFORM('seed', 'step', 'slot')} * n)",
    "smp8_oversampled": f"{LEVELS}, w AS (SELECT id, CASE bucket WHEN 8 THEN 2.5 WHEN 9 THEN 3.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS weight FROM bucketed), c AS (SELECT id, floor(weight)::int + ({UNIFORM('seed', 'id')} < weight - floor(weight))::int AS copies FROM w) SELECT id, unnest(range(1, copies + 1))::int AS copy FROM c",
}
NORMAL = f""", lines AS (SELECT id, list_transform(string_split({BROKEN}, chr(10)), lambda x: rtrim(x, chr(13))) AS l FROM lv),
    used AS (SELECT id, l, list_filter(range(1, len(l) + 1), lambda i: trim(l[i]) <> '') AS u FROM lines),
    inner_rows AS (SELECT id, CASE WHEN len(u) > 0 THEN list_slice(l, list_min(u), list_max(u)) ELSE [] END AS r FROM used),
    normal AS (SELECT id, coalesce(array_to_string(list_transform(r, lambda x: rpad(translate(x, '-_', '  '), list_max(list_transform(r, lambda y: length(y)))::int, ' ')), chr(10)), '') AS t FROM inner_rows)"""


def fault(t: str) -> str:
    """The first fault of a normalised text."""
    lines, before = f"string_split({t}, chr(10))", f"regexp_extract({t}, '^[# @$.*+\\n]*')"
    return f"""CASE WHEN {t} = '' THEN 'empty' WHEN length({lines}[1]) * len({lines}) > 128 THEN 'too large'
        WHEN length({before}) < length({t}) THEN 'unknown tile at row ' || (len(string_split({before}, chr(10))) - 1)::varchar || ' column ' || length(list_last(string_split({before}, chr(10))))::varchar
        WHEN {count(t, '@+')} <> 1 THEN 'players' WHEN {count(t, '$*')} = 0 THEN 'no boxes' WHEN {count(t, '$*')} <> {count(t, '.*+')} THEN 'boxes and goals' END"""


ORACLES["fn3_parse_error"] = f"{LEVELS}{NORMAL} SELECT id, {fault('t')} AS error FROM normal"
ORACLES["fn4_normalised"] = f"{LEVELS}{NORMAL} SELECT id, t AS text FROM normal"
ORACLES["snk3_edges"] = level("len(edges)::int AS n_edges, (generate_subscripts(edges, 1) - 1)::int AS k, unnest(edges) AS edge", "edges")
ORACLES["snk1_label_cache"] = level("text, arg_min(status, doc_id) AS status, arg_min(moves, doc_id) AS moves, CASE WHEN bool_or(doc_id % 2 = 0) THEN 0 ELSE 1 END::int AS run", "lv GROUP BY text")
ORACLES["snk5_bucket_card"] = ORACLES["fn13_bucket_labels"].replace("SELECT 0 AS bucket", ", labels AS (SELECT 0 AS bucket") + """),
    counts AS (SELECT bucket, """ + ", ".join(f"count_if(split = '{s}')::bigint AS {s}" for s in ("test", "val", "hard", "train")) + """ FROM bucketed GROUP BY bucket)
    SELECT labels.bucket::int AS bucket, """ + ", ".join(f"coalesce({s}, 0)::bigint AS {s}" for s in ("test", "val", "hard", "train")) + """, label AS moves FROM labels LEFT JOIN counts ON counts.bucket = labels.bucket"""
ORACLES["lbl1_labels"] = f"""{LEVELS}, tab AS (SELECT text AS t, arg_min(status, doc_id) AS s, arg_min(moves, doc_id) AS m FROM lv WHERE {byte("doc_id::varchar", ":z")} > 12 GROUP BY text)
    SELECT id, CASE WHEN {fault('text')} IS NOT NULL THEN 'invalid' WHEN s IS NULL THEN 'unlabelled' ELSE s END AS status, CASE WHEN {fault('text')} IS NOT NULL THEN 0 ELSE m END AS moves, {fault('text')} AS error FROM lv LEFT JOIN tab ON t = text"""
THEIRS = f"theirs AS (SELECT file AS f, index AS i, CASE WHEN {byte('doc_id::varchar', ':x')} < 10 THEN (moves + 1)::varchar WHEN {byte('doc_id::varchar', ':x')} < 20 THEN 'none' ELSE moves::varchar END AS steps FROM lv WHERE {byte('doc_id::varchar', ':y')} > 12), verdict AS (SELECT file, index, moves, try_cast(steps AS int) AS steps, CASE WHEN try_cast(steps AS int) IS NULL THEN 'unlabelled' WHEN try_cast(steps AS int) = moves THEN 'agree' ELSE 'disagree' END AS verdict FROM lv LEFT JOIN theirs ON f = file AND i = index WHERE status = 'solved')"
ORACLES["lbl3_agreement"] = f"{LEVELS}, {THEIRS} SELECT verdict, count(*) AS n FROM verdict GROUP BY verdict"
ORACLES["ord1_examples"] = f"{LEVELS}, {THEIRS} SELECT file, index, steps, moves FROM verdict WHERE verdict = 'disagree' ORDER BY file, index LIMIT 5"

# Images of the levels' own texts.
_TURN = lambda r: f"list_transform(range(1, length({r}[1]) + 1), lambda c: array_to_string(list_transform(list_reverse({r}), lambda w: substr(w, c, 1)), ''))"
OWN = f""", own0 AS (SELECT id, doc_id, bucket, string_split(text, chr(10)) AS r0 FROM (SELECT lv.*, 0 AS bucket FROM lv)), own1 AS (SELECT *, {_TURN("r0")} AS r1 FROM own0), own2 AS (SELECT *, {_TURN("r1")} AS r2 FROM own1), own3 AS (SELECT *, {_TURN("r2")} AS r3 FROM own2),
    own AS MATERIALIZED (SELECT id, doc_id, [{", ".join([f"array_to_string(r{k}, chr(10))" for k in range(4)] + [f"array_to_string(list_transform(r{k}, lambda w: reverse(w)), chr(10))" for k in range(4)])}] AS images FROM own3)"""
PICK = f"floor({UNIFORM('seed', 'id')} * 8)::int"
ORACLES["fn5_transform"] = f"{LEVELS}{OWN} SELECT id, images[(doc_id % 8)::int + 1] AS image FROM own"
ORACLES["fn6_orbit"] = f"{LEVELS}{OWN} SELECT id, array_to_string(images, '|') AS images FROM own"
ORACLES["smp3_augment"] = f"{LEVELS}{OWN} SELECT id, {PICK} AS k, images[{PICK} + 1] AS text FROM own"
ORACLES["smp6_expanded"] = f"{LEVELS}{OWN} SELECT id, (generate_subscripts(images, 1) - 1)::int AS k, unnest(images) AS text FROM own"
ORACLES["smp2_sequences"] = level("id, '8 ' || (11 + bucket)::varchar || ' ' || array_to_string(string_split(translate(replace(text, chr(10), ''), '# @$.*+', '0123456'), ''), ' ') || ' 9' AS tokens", "bucketed")

# Samples.
KEY = "sample_id::varchar"
SAMPLES = LEVELS.replace("SELECT doc_id::varchar AS key FROM documents UNION ALL", "SELECT k::varchar AS key FROM range(0, 97) r(k) UNION ALL SELECT 's' || (conv_id * 1000 + turn)::varchar FROM conversations UNION ALL SELECT doc_id::varchar AS key FROM documents UNION ALL") + f""",
    turns AS (SELECT conv_id * 1000 + turn AS sample_id, {byte("(conv_id * 1000 + turn)::varchar", ":k")} % 8 AS kind, {byte("(conv_id * 1000 + turn)::varchar", ":m")} % 64 AS tile FROM conversations),
    sm AS MATERIALIZED (SELECT sample_id, CASE WHEN sample_id % 5 <> 0 THEN {byte(KEY, ":t")} % 10 END AS target,
        CASE WHEN kind = 0 THEN NULL WHEN kind = 1 THEN o.text WHEN kind = 2 THEN o.images[{byte(KEY, ":r")} % 8 + 1] WHEN kind = 3 THEN left(o.text, (11 + tile // 8 * 11 + tile % 8 + 1)::int) || '#' || substr(o.text, (13 + tile // 8 * 11 + tile % 8 + 1)::int) ELSE n.text END AS text,
        CASE WHEN kind = 0 THEN NULL WHEN kind IN (1, 2) THEN o.images WHEN kind = 3 THEN NULL ELSE n.images END AS known_images,
        CASE WHEN {byte(KEY, ":s")} < 220 THEN 'solved' ELSE 'budget_exceeded' END AS solver_status, 4 + {byte(KEY, ":n")} % 120 AS solver_moves
        FROM turns JOIN orbit o ON o.key = (sample_id % 97)::varchar JOIN orbit n ON n.key = 's' || {KEY}),
    own0 AS (SELECT sample_id, string_split(text, chr(10)) AS r0 FROM sm WHERE text IS NOT NULL), own1 AS (SELECT *, {_TURN("r0")} AS r1 FROM own0), own2 AS (SELECT *, {_TURN("r1")} AS r2 FROM own1), own3 AS (SELECT *, {_TURN("r2")} AS r3 FROM own2),
    im AS MATERIALIZED (SELECT sample_id AS sid, [{", ".join([f"array_to_string(r{k}, chr(10))" for k in range(4)] + [f"array_to_string(list_transform(r{k}, lambda w: reverse(w)), chr(10))" for k in range(4)])}] AS images FROM own3),
    corpus AS MATERIALIZED (SELECT DISTINCT text, canonical FROM kept WHERE split = 'train')"""
EDGE_LIST = "[" + ", ".join(f"{e}::double" for e in EDGES) + "]"
MIDDLE = "CASE target " + " ".join(f"WHEN {b} THEN {m}::double" for b, m in MIDDLES.items()) + " END"
NEAR = "(SELECT DISTINCT s.text AS t FROM (SELECT DISTINCT text FROM sm WHERE text IS NOT NULL) s, (SELECT DISTINCT text FROM corpus) c WHERE levenshtein(s.text, c.text) < 5)"
SCORES = f"""{SAMPLES}, near AS MATERIALIZED {NEAR},
    s1 AS (SELECT sm.*, {valid("text")} AS valid, list_min(im.images) AS form FROM sm LEFT JOIN im ON im.sid = sample_id),
    s2 AS (SELECT *, CASE WHEN text IS NULL THEN 'undecodable' WHEN NOT valid THEN 'invalid' ELSE solver_status END AS status FROM s1),
    sc AS MATERIALIZED (SELECT sample_id, target, text, form, valid, status, status = 'solved' AS solved, CASE WHEN status = 'solved' THEN solver_moves END AS moves,
        CASE WHEN status = 'solved' THEN len(list_filter({EDGE_LIST}, lambda e: e <= solver_moves))::int END AS bucket,
        CASE WHEN form IS NOT NULL THEN form NOT IN (SELECT canonical FROM corpus) END AS novel_strict,
        text IS NOT NULL AND text NOT IN (SELECT t FROM near) AS novel_k,
        valid AND coalesce(form NOT IN (SELECT canonical FROM corpus), false) AS novel_exact FROM s2)"""
MEMBERS = """, members AS MATERIALIZED (SELECT 'all' AS "group", * FROM sc UNION ALL SELECT CASE WHEN target IS NULL THEN 'unconditional' ELSE 'conditional' END, * FROM sc UNION ALL SELECT 'd' || target::varchar, * FROM sc WHERE target IS NOT NULL),
    ranks AS (SELECT "group", target, row_number() OVER (PARTITION BY "group" ORDER BY target, sample_id) AS rt, row_number() OVER (PARTITION BY "group" ORDER BY moves, sample_id) AS rm FROM members WHERE solved AND target IS NOT NULL),
    spear AS (SELECT "group", CASE WHEN count(DISTINCT target) > 1 THEN round(corr(rt, rm), 9) END AS spearman FROM ranks GROUP BY "group")"""
mean = lambda x: f"round(avg(CASE WHEN {x} THEN 1.0 ELSE 0.0 END::double), 9)"
gap = lambda x: f"round(avg(CASE WHEN solved AND target IS NOT NULL THEN (CASE WHEN {x} THEN 1.0 ELSE 0.0 END)::double END), 9)"
SUMS = f"""{MEMBERS}, sums AS (SELECT "group", count(*) AS n, {mean("valid")} AS valid, {mean("valid AND solved")} AS playable, {mean("novel_k")} AS novel, {mean("coalesce(novel_strict, false)")} AS novel_strict, {mean("valid AND solved AND novel_k")} AS playable_novel, {mean("solved AND coalesce(novel_strict, false)")} AS novel_solvable,
    round(count(DISTINCT CASE WHEN valid THEN text END) / count(*), 9) AS "unique", quantile_cont(moves::double, 0.5) AS moves_median, {gap("bucket = target")} AS bucket_exact, {gap("abs(bucket - target) <= 1")} AS bucket_within1 FROM members GROUP BY "group"),
    spine AS (SELECT unnest(['all', 'conditional', 'unconditional', 'd0', 'd1', 'd2', 'd3', 'd4', 'd5', 'd6', 'd7', 'd8', 'd9']) AS "group")"""
SUMMARY = """SELECT spine."group", coalesce(n, 0) AS n, valid, playable, novel, novel_strict, playable_novel, novel_solvable, "unique", moves_median, bucket_exact, bucket_within1, spearman,
    CASE WHEN n > 0 THEN round(coalesce(len(alive), 0) / n, 9) END AS score FROM spine LEFT JOIN sums USING ("group") LEFT JOIN spear USING ("group") LEFT JOIN last USING ("group")"""


def greedy(rows: str) -> str:
    """CTEs down to `last`: of each group, the ids left when the one with most neighbours under 5 edits goes until none has any."""
    return f""", div AS MATERIALIZED (SELECT "group", sample_id, text FROM {rows}), texts AS (SELECT DISTINCT text FROM div WHERE text IS NOT NULL),
    close AS MATERIALIZED (SELECT a.text AS a, b.text AS b FROM texts a, texts b WHERE levenshtein(a.text, b.text) < 5),
    edge AS MATERIALIZED (SELECT x."group", x.sample_id AS u, y.sample_id AS v FROM div x JOIN close ON a = x.text JOIN div y ON y.text = b AND y."group" = x."group" WHERE x.sample_id <> y.sample_id),
    step AS (SELECT "group", 0 AS k, list(sample_id) AS alive FROM div WHERE text IS NOT NULL GROUP BY "group"
        UNION ALL SELECT s."group", s.k + 1, list_filter(s.alive, lambda i: i <> w.u) FROM step s JOIN LATERAL (SELECT u FROM edge e WHERE e."group" = s."group" AND list_contains(s.alive, u) AND list_contains(s.alive, v) GROUP BY u ORDER BY count(*) DESC, u LIMIT 1) w ON true),
    last AS (SELECT "group", arg_max(alive, k) AS alive FROM step GROUP BY "group")"""


REWARDS = f""", rw AS MATERIALIZED (SELECT *, sample_id // 16000 AS group_id, CASE WHEN valid THEN 0.0 ELSE -1.0 END::double AS r_valid, solved::int::double AS r_playable, CASE WHEN solved AND target IS NOT NULL THEN round(exp(-abs(moves - {MIDDLE}) / 10.0::double), 9) ELSE 0.0::double END AS r_match, coalesce(novel_strict, false)::int::double AS r_novel FROM sc),
    tot AS MATERIALIZED (SELECT *, round(CASE WHEN valid THEN r_playable + r_match + r_novel ELSE -1.0::double END, 9) AS total FROM rw)"""
ORACLES |= {
    "fn16_status": f"{SAMPLES} SELECT sample_id, CASE WHEN text IS NULL THEN 'undecodable' WHEN NOT {valid('text')} THEN 'invalid' ELSE solver_status END AS status FROM sm",
    "smp7_plan": "WITH c AS (SELECT count(*) // 20 AS per, count(*) // 10 AS un FROM conversations) SELECT i AS sample_id, CASE WHEN i < per * 10 THEN (i // greatest(per, 1))::int END AS target FROM c, LATERAL (SELECT unnest(range(0, per * 10 + un)) AS i)",
    "join1_novel": f"{SAMPLES} SELECT sample_id, CASE WHEN im.images IS NOT NULL THEN list_min(im.images) NOT IN (SELECT canonical FROM corpus) END AS novel FROM sm LEFT JOIN im ON im.sid = sample_id",
    "join1_bucketed": f"{SAMPLES} SELECT sample_id, CASE WHEN im.images IS NOT NULL THEN list_min(im.images) NOT IN (SELECT canonical FROM corpus) END AS novel FROM sm LEFT JOIN im ON im.sid = sample_id",
    "join2_nearest_edit": f"{SAMPLES}, q AS (SELECT sample_id, text FROM sm WHERE sample_id % 50 = 0), d AS (SELECT q.sample_id AS s, min(least(levenshtein(q.text, c.text), 21)) AS d FROM q, corpus c WHERE q.text IS NOT NULL GROUP BY ALL) SELECT sample_id, d::int AS nearest FROM q LEFT JOIN d ON s = sample_id",
    "join3_nearest_edit_symmetric": f"{SAMPLES}, q AS (SELECT sample_id, unnest(images) AS text FROM im JOIN sm ON sid = sample_id WHERE sample_id % 50 = 0), d AS (SELECT q.sample_id AS s, min(least(levenshtein(q.text, c.text), 21)) AS d FROM q, corpus c GROUP BY ALL) SELECT sample_id, d::int AS nearest FROM sm LEFT JOIN d ON s = sample_id WHERE sample_id % 50 = 0",
    "join4_novel_k": f"{SAMPLES}, near AS MATERIALIZED {NEAR} SELECT sample_id, text IS NOT NULL AND text NOT IN (SELECT t FROM near) AS novel_k FROM sm",
    "join5_close_pairs": f"{SAMPLES}, t AS MATERIALIZED (SELECT DISTINCT text FROM sm WHERE text IS NOT NULL) SELECT a.text AS a, b.text AS b, levenshtein(a.text, b.text)::int AS distance FROM t a, t b WHERE a.text < b.text AND levenshtein(a.text, b.text) < 5",
    "join6_scored": f"{SCORES} SELECT sample_id, target, valid, status, solved, moves, bucket, novel_strict, novel_k, novel_exact FROM sc",
    "lbl2_valid_only": f"""{SAMPLES}, tab AS (SELECT text AS t, arg_min(solver_status, sample_id) AS s, arg_min(solver_moves, sample_id) AS m FROM sm WHERE text IS NOT NULL AND sample_id % 3 > 0 GROUP BY text)
        SELECT sample_id, CASE WHEN text IS NULL THEN 'undecodable' WHEN NOT {valid("text")} THEN 'invalid' ELSE coalesce(s, 'unlabelled') END AS status, CASE WHEN {valid("text")} THEN m END AS moves FROM sm LEFT JOIN tab ON t = text""",
    "snk4_scored_rows": f"{SCORES} SELECT sample_id, target, text, valid, status, moves, bucket, novel_strict FROM sc",
    "agg8_summary": f'{SCORES}{SUMS}{greedy("members WHERE valid AND solved AND novel_k")} {SUMMARY}',
    "agg10_diversity": f'{SCORES}{MEMBERS}{greedy("members")} SELECT "group", len(alive) AS diversity FROM last',
    "agg11_headline": f'{SCORES}{MEMBERS}{greedy("members WHERE valid AND solved AND novel_k")} SELECT "group", count(*) AS n, coalesce(any_value(len(alive)), 0) AS diversity, round(coalesce(any_value(len(alive)), 0) / count(*), 9) AS score FROM members LEFT JOIN last USING ("group") GROUP BY "group"',
    "agg9_spearman": f'{SCORES}{MEMBERS} SELECT "group", spearman FROM spear',
    "agg12_confusion": f"{SCORES}, c AS (SELECT target, bucket, count(*) AS n FROM sc WHERE solved AND target IS NOT NULL GROUP BY ALL), e AS (SELECT a::int AS target, b::int AS bucket FROM range(0, 10) r(a), range(0, 10) s(b)) SELECT e.target, e.bucket, coalesce(n, 0) AS n, round(coalesce(n, 0) / greatest(coalesce(sum(n) OVER (PARTITION BY e.target), 1), 1), 9) AS share FROM e LEFT JOIN c ON c.target = e.target AND c.bucket = e.bucket",
    "agg13_calibration": f"{SCORES}, b AS (SELECT target, quantile_cont(moves::double, 0.25) AS q1, quantile_cont(moves::double, 0.5) AS median, quantile_cont(moves::double, 0.75) AS q3, count(*) AS n FROM sc WHERE solved AND target IS NOT NULL GROUP BY target), r AS (SELECT list_concat(list_concat([0.0::double], {EDGE_LIST}), [1.5 * {EDGES[-1]}::double]) AS r) SELECT b.target, round(r[b.target + 1], 9) AS lo, round(r[b.target + 2], 9) AS hi, q1, median, q3, min(moves)::double AS whisker_lo, max(moves)::double AS whisker_hi, n FROM b JOIN sc ON sc.target = b.target AND solved AND moves BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1), r GROUP BY ALL",
    "rwd1_rewards": f"{SCORES}{REWARDS} SELECT sample_id, r_valid, r_playable, r_match, r_novel, total FROM tot",
    "rwd2_copies": f"{SCORES}{REWARDS} SELECT sample_id, CASE WHEN text IS NULL THEN -0.0::double ELSE round(-0.5::double * (count(*) OVER (PARTITION BY group_id, text) - 1), 9) END AS r_copies FROM tot",
    "rwd3_advantages": f"{SCORES}{REWARDS} SELECT sample_id, round(total - avg(total) OVER (PARTITION BY group_id), 9) AS advantage FROM tot",
    "rwd4_informative": f"{SCORES}{REWARDS} SELECT sample_id, group_id FROM tot WHERE group_id IN (SELECT group_id FROM tot GROUP BY group_id HAVING min(total) <> max(total))",
    "rwd5_selected": f"{SCORES} SELECT min(sample_id) AS sample_id, arg_min(target, sample_id) AS target FROM sc WHERE valid AND solved AND novel_exact AND target IS NOT NULL AND bucket = target GROUP BY form",
}

ORACLES["join7_distances"] = f"SELECT a.sample_id, a.nearest AS nn_edit, b.nearest AS nn_edit_sym FROM ({ORACLES['join2_nearest_edit']}) a JOIN ({ORACLES['join3_nearest_edit_symmetric']}) b USING (sample_id)"
RUN = lambda k, more: f"""SELECT *, 'run{k}' AS run, {more} FROM ({SCORES.replace("sc AS MATERIALIZED", "whole AS MATERIALIZED")}, sc AS MATERIALIZED (SELECT * FROM whole WHERE sample_id % 2 = {k}){SUMS}{greedy("members WHERE valid AND solved AND novel_k")} {SUMMARY})"""
ORACLES["rwd6_runs"] = f"{RUN(0, '1.5::double AS cost, NULL::double AS latency')} UNION ALL {RUN(1, '2.0::double AS cost, 30.0::double AS latency')}"
ORACLES["join5_close_links"] = f"""{SAMPLES}, cls AS MATERIALIZED (SELECT text, min(sample_id) AS class_id, count(*) AS copies FROM sm WHERE text IS NOT NULL GROUP BY text),
    near AS (SELECT a.text AS t, sum(b.copies) AS n FROM cls a, cls b WHERE a.text <> b.text AND levenshtein(a.text, b.text) < 5 GROUP BY a.text)
    SELECT sample_id, class_id, (copies - 1 + coalesce(n, 0))::bigint AS links FROM sm LEFT JOIN cls USING (text) LEFT JOIN near ON t = text"""
ORACLES["src1_level_files"] = level("split, file, index, text")
ORACLES["src3_split_read"] = level("id, bucket", "bucketed WHERE split = 'train'")
ORACLES["snk2_splits"] = level("split, id, text, bucket", "bucketed")
ORACLES["src4_samples"] = f"{SAMPLES} SELECT sample_id, target::int AS target, text FROM sm"
ORACLES["src5_external_labels"] = f"{LEVELS}, {THEIRS} SELECT f AS file, i AS index, steps FROM theirs"
