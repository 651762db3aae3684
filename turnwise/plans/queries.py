"""Registered queries over the driver tables, each with its DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.functions import korean as K
from turnwise.functions import seams
from turnwise.functions import text as T
from turnwise.operators import arrays, audio, corpus, filters, manifest, metrics, segments, speakers, statistics, synthesis, tokens, windows
from turnwise.plans.views import UTTERANCES_SQL, WORDS_SQL, read, utterances, words
from turnwise.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WINDOW_MS = 20_000
SHARE_SQL = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0)"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# dialogue ------------------------------------------------------------------------------------------------

ROLES_SQL = (
    UTTERANCES_SQL
    + """,
t0 AS (SELECT conv_id, speaker, CAST(sum(dur_ms) AS BIGINT) AS total_ms, count(*) AS turns, min(pos) AS first_pos FROM utterances GROUP BY ALL),
t1 AS (SELECT *, 0.6 * total_ms / sum(total_ms) OVER (PARTITION BY conv_id) + 0.4 * turns / sum(turns) OVER (PARTITION BY conv_id) AS score FROM t0),
t2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 12) DESC, first_pos) AS rank FROM t1),
roles AS (SELECT *, CASE WHEN rank = 1 THEN 'main' ELSE 'user' END AS role FROM t2)"""
)


def _roles(spark, d):
    return speakers.assign_roles(utterances(spark, d))


@query(f"WITH {UTTERANCES_SQL} SELECT conv_id, turn, speaker, pos, start_ms, end_ms FROM utterances")
def utterance_times(spark, d):
    return utterances(spark, d).select("conv_id", "turn", "speaker", "pos", "start_ms", "end_ms")


@query(f"WITH {ROLES_SQL} SELECT conv_id, speaker, total_ms, turns, round(score, 6) AS score, rank, role FROM roles")
def speaker_roles(spark, d):
    return _roles(spark, d).select("conv_id", "speaker", "total_ms", "turns", F.round("score", 6).alias("score"), "rank", "role")


@query(
    f"""WITH {ROLES_SQL} SELECT conv_id, max(CASE WHEN role = 'main' THEN speaker END) AS main_speaker, round(max(CASE WHEN role = 'main' THEN score END), 4) AS main_score,
    round(sum(CASE WHEN role = 'main' THEN 0 ELSE score END), 4) AS user_score, CAST(sum(CASE WHEN role = 'main' THEN total_ms ELSE 0 END) AS BIGINT) AS main_ms,
    CAST(sum(CASE WHEN role = 'main' THEN 0 ELSE total_ms END) AS BIGINT) AS user_ms, count(*) AS num_speakers FROM roles GROUP BY conv_id"""
)
def role_totals(spark, d):
    return speakers.role_totals(_roles(spark, d))


@query(f"WITH {ROLES_SQL} SELECT conv_id, speaker, turns, row_number() OVER (PARTITION BY conv_id ORDER BY turns DESC, first_pos) AS rank FROM roles")
def speakers_by_turns(spark, d):
    return speakers.sort_speakers(speakers.speaker_totals(utterances(spark, d)), "turns").select("conv_id", "speaker", "turns", "rank")


@query(
    f"""WITH {UTTERANCES_SQL}, c AS (SELECT conv_id, max(end_ms) AS duration_ms, count(*) AS n_turns, count(DISTINCT speaker) AS num_speakers FROM utterances GROUP BY conv_id),
    r AS (SELECT *, CASE WHEN duration_ms / 1000.0 < 30.0 THEN printf('Too short: %.1fs < 30.0s', duration_ms / 1000.0) WHEN duration_ms / 1000.0 > 150.0 THEN printf('Too long: %.1fs > 150.0s', duration_ms / 1000.0)
      WHEN n_turns < 4 THEN printf('Too few turns: %d < 4', n_turns) WHEN num_speakers < 3 THEN 'No speakers found' END AS reason FROM c)
    SELECT conv_id, duration_ms, n_turns, reason, CASE WHEN reason IS NULL THEN 'valid' WHEN regexp_matches(reason, 'Too (short|long|few)') THEN 'skipped' ELSE 'failed' END AS outcome FROM r"""
)
def conversation_validation(spark, d):
    out = speakers.validate(speakers.conversation_totals(utterances(spark, d)), 30.0, 150.0, 4, 3)
    return out.select("conv_id", "duration_ms", "n_turns", "reason", "outcome")


@query(
    f"""WITH {UTTERANCES_SQL} SELECT a.conv_id, CAST(sum(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) AS BIGINT) AS overlap_ms, count(*) AS n_overlaps
    FROM utterances a JOIN utterances b ON a.conv_id = b.conv_id AND a.pos < b.pos AND b.start_ms < a.end_ms AND a.speaker <> b.speaker
    WHERE least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms) GROUP BY a.conv_id"""
)
def overlap_regions(spark, d):
    return speakers.overlap_summary(speakers.overlap_pairs(utterances(spark, d))).select("conv_id", "overlap_ms", "n_overlaps")


@query(
    f"""WITH {UTTERANCES_SQL}, l AS (SELECT *, lag(speaker) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM utterances),
    s AS (SELECT conv_id, count(*) AS n_turns, round(avg(dur_ms) / 1000.0, 3) AS mean_turn, count(*) FILTER (speaker <> before) AS transitions, max(end_ms) AS duration_ms FROM l GROUP BY conv_id)
    SELECT *, round(transitions / greatest(duration_ms / 60000.0, 0.001), 2) AS per_minute FROM s"""
)
def turn_statistics(spark, d):
    return speakers.turn_statistics(utterances(spark, d))


@query(
    f"""WITH {ROLES_SQL}, k AS (SELECT conv_id, count(*) AS num_speakers, string_agg(rank || ' ' || speaker || ' ' || role || ' ' || total_ms || ' ' || turns, ',' ORDER BY rank) AS ranked, round(max(score), 4) AS top_score FROM roles GROUP BY conv_id),
    o AS (SELECT a.conv_id, sum(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) AS ov FROM utterances a JOIN utterances b ON a.conv_id = b.conv_id AND a.pos < b.pos AND b.start_ms < a.end_ms AND a.speaker <> b.speaker WHERE least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms) GROUP BY a.conv_id),
    l AS (SELECT *, lag(speaker) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM utterances),
    s AS (SELECT conv_id, count(*) AS n_turns, round(avg(dur_ms) / 1000.0, 3) AS mean_turn, count(*) FILTER (speaker <> before) AS transitions, max(end_ms) AS duration_ms FROM l GROUP BY conv_id)
    SELECT k.conv_id, num_speakers, ranked, top_score, round(coalesce(ov, 0) / greatest(duration_ms, 1), 4) AS overlap_ratio, n_turns, mean_turn, transitions FROM k JOIN s ON k.conv_id = s.conv_id LEFT JOIN o ON k.conv_id = o.conv_id"""
)
def diarization_documents(spark, d):
    schema = "num_speakers bigint, speakers array<struct<rank int, speaker string, role string, score double, total_ms bigint, turns bigint>>, overlap_ratio double, n_turns bigint, mean_turn double, transitions bigint"
    doc = speakers.diarization_document(utterances(spark, d)).select("conv_id", F.from_json("document", schema).alias("x")).select("conv_id", "x.*")
    one = lambda r: F.concat_ws(" ", r["rank"].cast("string"), r["speaker"], r["role"], r["total_ms"].cast("string"), r["turns"].cast("string"))
    return doc.select("conv_id", "num_speakers", F.array_join(F.transform("speakers", one), ",").alias("ranked"), F.array_max(F.transform("speakers", lambda r: r["score"])).alias("top_score"), "overlap_ratio", "n_turns", "mean_turn", "transitions")


@query(
    f"""WITH {ROLES_SQL}, n AS (SELECT conv_id, coalesce(string_agg(speaker, ',' ORDER BY speaker) FILTER (role = 'user'), '') AS user_speakers FROM roles GROUP BY conv_id)
    SELECT u.conv_id, n.user_speakers, string_agg(r.role || ' ' || u.speaker || ' ' || u.start_ms || ': ' || u.text, chr(10) ORDER BY u.start_ms, u.pos) AS lines
    FROM utterances u JOIN roles r ON u.conv_id = r.conv_id AND u.speaker = r.speaker JOIN n ON n.conv_id = u.conv_id GROUP BY ALL"""
)
def role_tagged_utterances(spark, d):
    u = utterances(spark, d)
    line = lambda x: F.concat(x["role"], F.lit(" "), x["speaker"], F.lit(" "), x["start_ms"].cast("string"), F.lit(": "), x["text"])
    return speakers.role_utterances(u, speakers.assign_roles(u)).select("conv_id", "user_speakers", F.array_join(F.transform("segments", line), "\n").alias("lines"))


# segments ------------------------------------------------------------------------------------------------


@query(
    f"""WITH {UTTERANCES_SQL}, b AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NULL OR lag(speaker) OVER w <> speaker OR start_ms - lag(end_ms) OVER w > 300 THEN 1 ELSE 0 END AS brk FROM utterances WINDOW w AS (PARTITION BY conv_id ORDER BY start_ms, pos)),
    i AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY conv_id ORDER BY start_ms, pos) AS BIGINT) AS island FROM b)
    SELECT conv_id, island, min(speaker) AS speaker, min(start_ms) AS start_ms, arg_max(end_ms, pos) AS end_ms, count(*) AS n_merged, string_agg(text, ' ' ORDER BY start_ms, pos) AS text FROM i GROUP BY conv_id, island"""
)
def merged_segments(spark, d):
    return segments.merge_adjacent(utterances(spark, d), 300)


@query(
    f"""WITH {UTTERANCES_SQL}, b AS (SELECT *, CASE WHEN lag(end_ms) OVER w IS NULL OR start_ms - lag(end_ms) OVER w > 4000 THEN 1 ELSE 0 END AS brk FROM utterances WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY start_ms, pos)),
    i AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id, speaker ORDER BY start_ms, pos) AS island FROM b),
    g AS (SELECT conv_id, speaker, island, min(start_ms) AS s, max(end_ms) AS e FROM i GROUP BY ALL),
    k AS (SELECT *, max(e - s) OVER (PARTITION BY conv_id, speaker) AS top, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY e - s DESC, s) AS r FROM g)
    SELECT conv_id, speaker, s AS start_ms, least(e, s + 10000) AS end_ms FROM k WHERE e - s >= 3000 OR (top < 3000 AND r = 1)"""
)
def reference_regions(spark, d):
    return segments.reference_regions(utterances(spark, d), 4000)


@query(
    f"""WITH {WORDS_SQL}, b AS (SELECT *, CASE WHEN lag(end_ms) OVER w IS NULL OR start_ms - lag(end_ms) OVER w > 4000 THEN 1 ELSE 0 END AS brk FROM utterances WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY start_ms, pos)),
    i AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id, speaker ORDER BY start_ms, pos) AS island FROM b), g AS (SELECT conv_id, speaker, island, min(start_ms) AS s, max(end_ms) AS e FROM i GROUP BY ALL),
    k AS (SELECT *, max(e - s) OVER (PARTITION BY conv_id, speaker) AS top, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY e - s DESC, s) AS r FROM g),
    p AS (SELECT conv_id, speaker, s AS start_ms, least(e, s + 10000) AS end_ms FROM k WHERE e - s >= 3000 OR (top < 3000 AND r = 1))
    SELECT p.conv_id, p.speaker, p.start_ms, p.end_ms, coalesce(string_agg(word, ' ' ORDER BY w_start_ms, turn, k), '') AS text FROM p LEFT JOIN words w ON w.conv_id = p.conv_id AND w.speaker = p.speaker AND w_end_ms > p.start_ms AND w_start_ms < p.end_ms GROUP BY p.conv_id, p.speaker, p.start_ms, p.end_ms"""
)
def region_texts(spark, d):
    u = utterances(spark, d)
    return segments.region_texts(segments.reference_regions(u, 4000), words(u), ["conv_id", "speaker"])


@query(
    f"""WITH {UTTERANCES_SQL}, n AS (SELECT conv_id, speaker, start_ms, end_ms, greatest(end_ms - start_ms - 3000, 0) AS n FROM utterances),
    c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY conv_id, speaker ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY conv_id, speaker) AS BIGINT) AS every FROM n),
    s AS (SELECT *, CAST(floor({SHARE_SQL.format("'7:' || conv_id || ':' || speaker")} * (every + 1)) AS BIGINT) AS spot FROM c)
    SELECT conv_id, speaker, CAST(CASE WHEN arg_min(every, start_ms) <= 0 THEN min(start_ms) ELSE arg_min(start_ms + spot - (upto - n), start_ms) END AS BIGINT) AS start FROM s WHERE upto >= spot OR every <= 0 GROUP BY conv_id, speaker"""
)
def weighted_starts(spark, d):
    u = utterances(spark, d).select("conv_id", "speaker", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    return corpus.weighted_start(u, ["conv_id", "speaker"], 3000, 7)


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), n AS (SELECT vec_id, a, unnest(range(CAST(ceil(len(a) * 2 / 3) AS BIGINT))) AS n FROM e),
    m AS (SELECT vec_id, n, a[m + 1] AS x, 1.98::DOUBLE * (m / 3.0::DOUBLE - n / 2.0::DOUBLE) AS t FROM (SELECT *, unnest(range(len(a))) AS m FROM n)),
    y AS (SELECT vec_id, n, sum(CASE WHEN abs(t) >= 6 THEN 0.0 WHEN abs(t) < 1e-12 THEN x ELSE x * sin(pi() * t) / (pi() * t) * pow(cos(pi() * t / 12), 2) END) * 1.98 / 3 AS y FROM m GROUP BY vec_id, n)
    SELECT vec_id, count(*) AS n, round(sum(y), 6) AS total, round(sum((n + 1) * y), 5) AS weighted, round(sum(y * y), 6) AS power FROM y GROUP BY vec_id"""
)
def resampled_signals(spark, d):
    """Signals taken from 24 kHz to 16 kHz."""
    r = read(spark, d, "embeddings").select("vec_id", arrays.resample(F.col("embedding").cast("array<double>"), 24_000, 16_000).alias("y"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    return r.select("vec_id", F.size("y").cast("long").alias("n"), F.round(total(F.col("y")), 6).alias("total"), F.round(total(F.transform("y", lambda v, i: (i + 1) * v)), 5).alias("weighted"), F.round(total(F.transform("y", lambda v: v * v)), 6).alias("power"))


@query("SELECT doc_id, length(text) + 1 AS n_tokens, CAST(1 + list_sum(list_transform(string_split(text, ''), lambda c: CASE WHEN c = chr(10) THEN 2 WHEN c = '' THEN 0 ELSE 3 + unicode(c) END)) AS BIGINT) AS total FROM documents WHERE text <> ''")
def line_tokens(spark, d):
    """Lines as code points with a newline token between them, behind a first token."""
    encode = seams.line_tokenizer_column(lambda line: [3 + ord(c) for c in line], 2, 1)
    t = read(spark, d, "documents").filter("text <> ''").select("doc_id", encode(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(
    """WITH p AS (SELECT page_id, 'audio/' || page_id || '.wav' AS a, 'one/' || page_id || '.json' AS b, 'two/' || page_id || '.json' AS c, round(length(html) / 7.0::DOUBLE, 3) AS d, 'c' || page_id AS e, CASE WHEN page_id % 3 > 0 THEN 'all/' || page_id || '.json' END AS f FROM pages)
    SELECT page_id, CAST(to_json({audio: a, alignment_speaker01: b, alignment_speaker02: c, duration: d, speakers: 2}) AS VARCHAR) AS basic,
    CAST(CASE WHEN f IS NULL THEN to_json({audio: a, alignment_speaker01: b, alignment_speaker02: c, duration: d, speakers: 2, conversation_id: e}) ELSE to_json({audio: a, alignment_speaker01: b, alignment_speaker02: c, duration: d, speakers: 2, conversation_id: e, alignment: f}) END AS VARCHAR) AS extended FROM p"""
)
def manifest_entries(spark, d):
    name = lambda folder, end: F.concat(F.lit(f"{folder}/"), F.col("page_id").cast("string"), F.lit(end))
    p = read(spark, d, "pages").select("page_id", name("audio", ".wav").alias("audio"), name("one", ".json").alias("alignment_speaker01"), name("two", ".json").alias("alignment_speaker02"), (F.length("html") / F.lit(7.0)).alias("duration"), F.lit(None).cast("int").alias("speakers"), F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("conversation_id"), F.when(F.col("page_id") % 3 > 0, name("all", ".json")).otherwise("").alias("alignment"), F.lit("").alias("alignment_extended"))
    return p.select("page_id", F.to_json(sinks.basic_entry()).alias("basic"), F.to_json(sinks.extended_entry()).alias("extended"))


QUESTIONS = {
    "ability": (["What can you do?", "Can you help me plan?"], {"base": ["I can talk things through with you."], "formal": ["I can assist with plans and questions.", "I am able to discuss most subjects."]}),
    "maker": (["Who made you?", "Where do you come from?", "Who trained you?"], {"base": ["A group of engineers built me.", "I was built as an open project."]}),
    "name": (["What is your name?"], {"base": ["Call me what you like."], "casual": ["Just call me Turn."], "formal": ["You may call me Turn."]}),
}
_TEXTS = lambda texts: "[" + ", ".join(f"'{t}'" for t in texts) + "]"
QUESTIONS_SQL = ", ".join(f"({k}, {_TEXTS(q)}, {_TEXTS(a.get('formal', a['base']))})" for k, (q, a) in enumerate(QUESTIONS[c] for c in sorted(QUESTIONS)))


@query(
    f"""WITH q(k, questions, answers) AS (VALUES {QUESTIONS_SQL}), t AS (SELECT conv_id AS id, list({{speaker: role, text: text}} ORDER BY turn) AS turns FROM conversations GROUP BY conv_id),
    s AS (SELECT *, {SHARE_SQL.format("'5:' || id")} < 0.4 AS chosen, CAST(floor({SHARE_SQL.format("'6:' || id")} * 3) AS INTEGER) AS k, CAST(floor({SHARE_SQL.format("'15:' || id")} * (least(3, len(turns)) + 1)) AS BIGINT) AS spot FROM t),
    j AS (SELECT id, chosen, spot, turns, [{{speaker: 'user', text: questions[CAST(floor({SHARE_SQL.format("'7:' || id")} * len(questions)) AS BIGINT) + 1]}}, {{speaker: 'assistant', text: answers[CAST(floor({SHARE_SQL.format("'8:' || id")} * len(answers)) AS BIGINT) + 1]}}] AS new FROM s JOIN q USING (k)),
    r AS (SELECT id, chosen, CASE WHEN chosen THEN list_concat(list_concat(turns[1:spot], new), turns[spot + 1:]) ELSE turns END AS turns FROM j)
    SELECT id AS conv_id, CAST(len(turns) AS INTEGER) AS n_turns, array_to_string(list_transform(turns, lambda x: x.speaker || ': ' || x.text), chr(10)) AS dialogue FROM r"""
)
def identity_questions(spark, d):
    templates = spark.createDataFrame([(c, q, a) for c, (q, a) in QUESTIONS.items()], "category string, questions array<string>, answers map<string, array<string>>")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("speaker"), x["text"].alias("text")))
    dialogues = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(turns.alias("turns"))
    out = synthesis.with_questions(dialogues, templates, 5, 0.4)
    return out.select(F.col("id").alias("conv_id"), F.size("turns").alias("n_turns"), F.array_join(F.transform("turns", lambda x: F.concat_ws(": ", x["speaker"], x["text"])), "\n").alias("dialogue"))


@query(
    f"""WITH {UTTERANCES_SQL}, t AS (SELECT conv_id, start_ms AS t0, end_ms AS t1 FROM utterances WHERE turn = 2)
    SELECT u.conv_id, u.pos, u.start_ms, u.end_ms FROM utterances u JOIN t ON u.conv_id = t.conv_id WHERE u.end_ms <= t0 - 500 OR u.start_ms >= t1 + 500"""
)
def regions_outside_target(spark, d):
    u = utterances(spark, d)
    return segments.outside_target(u, u.filter("turn = 2"), 500).select("conv_id", "pos", "start_ms", "end_ms")


@query(
    f"""WITH {UTTERANCES_SQL}, n AS (SELECT a.conv_id, a.pos, a.end_ms, min(b.start_ms) AS next_ms FROM utterances a LEFT JOIN utterances b ON a.conv_id = b.conv_id AND b.speaker = 'assistant' AND b.start_ms > a.end_ms WHERE a.speaker = 'user' GROUP BY ALL)
    SELECT *, next_ms - end_ms AS latency_ms FROM n"""
)
def response_latency(spark, d):
    u = utterances(spark, d)
    return segments.next_response(u.filter("speaker = 'user'"), u.filter("speaker = 'assistant'"))


@query(f"WITH {UTTERANCES_SQL} SELECT conv_id, pos, start_ms FROM utterances m WHERE speaker = 'assistant' AND EXISTS (SELECT 1 FROM utterances u WHERE u.speaker = 'user' AND u.conv_id = m.conv_id AND u.start_ms < m.start_ms AND m.start_ms < u.end_ms)")
def interruptions(spark, d):
    u = utterances(spark, d)
    return segments.interruptions(u.filter("speaker = 'assistant'"), u.filter("speaker = 'user'")).select("conv_id", "pos", "start_ms")


@query(
    f"""WITH {UTTERANCES_SQL} SELECT conv_id, pos FROM utterances a WHERE speaker = 'assistant' AND EXISTS (SELECT 1 FROM utterances b WHERE b.speaker = 'user' AND b.conv_id = a.conv_id AND
    (abs(a.start_ms - b.start_ms) <= 3000 OR abs(a.end_ms - b.end_ms) <= 3000 OR (b.start_ms <= a.start_ms AND a.end_ms <= b.end_ms)))"""
)
def boundary_matches(spark, d):
    u = utterances(spark, d)
    return segments.boundary_matches(u.filter("speaker = 'assistant'"), u.filter("speaker = 'user'"), 3000).select("conv_id", "pos")


@query(
    f"""WITH RECURSIVE {UTTERANCES_SQL}, d AS (SELECT conv_id, list({{c: (start_ms + end_ms) / 2.0::DOUBLE, pos: pos}} ORDER BY start_ms, pos) AS det FROM utterances WHERE speaker = 'assistant' GROUP BY conv_id),
    t AS (SELECT conv_id, list({{c: (start_ms + end_ms) / 2.0::DOUBLE, pos: pos}} ORDER BY start_ms, pos) AS tru FROM utterances WHERE speaker = 'user' GROUP BY conv_id),
    r AS (SELECT conv_id, det, tru, 0 AS i, CAST([] AS BIGINT[]) AS used, NULL::STRUCT(d DOUBLE, k BIGINT) AS best FROM d JOIN t USING (conv_id) UNION ALL
    SELECT conv_id, det, tru, i + 1, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.k) END, b FROM (SELECT conv_id, det, tru, i, used,
    list_sort(list_filter(list_transform(range(1, len(tru) + 1), lambda k: {{d: abs(tru[k].c - det[i + 1].c), k: k}}), lambda x: x.d <= 20000 AND NOT list_contains(used, x.k)))[1] AS b FROM r WHERE i < len(det)))
    SELECT conv_id, det[i].pos AS pos, tru[best.k].pos AS matched_pos, best.d AS distance_ms FROM r WHERE best IS NOT NULL"""
)
def greedy_matches(spark, d):
    u = utterances(spark, d)
    return segments.greedy_match(u.filter("speaker = 'assistant'"), u.filter("speaker = 'user'"), 20_000)


def _diarized(u):
    off = (F.col("conv_id") * 31 + F.col("turn") * 17) % 130
    return u.withColumn("start_ms", F.col("start_ms") + F.when(off < 40, 0).otherwise(off - 20)).withColumn("unknown", filters.is_unknown("speaker"))


MIGRATION_SQL = (
    UTTERANCES_SQL
    + """, o AS (SELECT *, (conv_id * 31 + turn * 17) % 130 AS off FROM utterances), d AS (SELECT conv_id, pos, speaker, end_ms, start_ms + CASE WHEN off < 40 THEN 0 ELSE off - 20 END AS start_ms FROM o),
    j AS (SELECT s.conv_id, s.pos, s.start_ms, s.end_ms, d.speaker AS m, d.pos AS dp, greatest(abs(s.start_ms - d.start_ms), abs(s.end_ms - d.end_ms)) AS off FROM utterances s LEFT JOIN d ON s.conv_id = d.conv_id AND abs(s.start_ms - d.start_ms) < 100 AND abs(s.end_ms - d.end_ms) < 100),
    l AS (SELECT *, CASE WHEN off = 0 THEN 1 WHEN off < 50 THEN 2 WHEN off < 100 THEN 3 END AS level FROM j),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pos ORDER BY level NULLS LAST, dp NULLS LAST) AS r FROM l),
    migrated AS (SELECT conv_id, pos, start_ms, end_ms, level, m AS matched_speaker FROM r WHERE r = 1)"""
)


@query(f"WITH {MIGRATION_SQL} SELECT * FROM migrated")
def speaker_migration(spark, d):
    u = utterances(spark, d)
    return segments.tolerance_join(u.select("conv_id", "pos", "start_ms", "end_ms"), _diarized(u))


@query(f"WITH {UTTERANCES_SQL} SELECT conv_id, pos, greatest(start_ms - 200, coalesce(lag(end_ms) OVER w + 200, 0)) AS padded_start, end_ms + 200 AS padded_end FROM utterances WINDOW w AS (PARTITION BY conv_id ORDER BY start_ms, pos)")
def padded_intervals(spark, d):
    return segments.pad_intervals(utterances(spark, d), ["conv_id"], 200).select("conv_id", "pos", "padded_start", "padded_end")


@query(f"WITH {UTTERANCES_SQL} SELECT conv_id, string_agg(text, ' ' ORDER BY pos) AS context FROM utterances GROUP BY conv_id")
def text_context(spark, d):
    return segments.context(utterances(spark, d))


@query(f"WITH {WORDS_SQL} SELECT conv_id, turn, k, word, w_start_ms, w_end_ms FROM words")
def word_times(spark, d):
    return words(utterances(spark, d)).select("conv_id", "turn", "k", "word", "w_start_ms", "w_end_ms")


@query(
    f"""WITH {WORDS_SQL}, c AS (SELECT conv_id, turn, k, w_start_ms, w_end_ms, length(word) AS n, unnest(range(length(word))) AS i, word FROM words)
    SELECT conv_id, turn, k, CAST(i AS BIGINT) AS i, substr(word, CAST(i + 1 AS BIGINT), 1) AS char, round(w_start_ms + i * ((w_end_ms - w_start_ms) / n), 4) AS c_start FROM c"""
)
def char_times(spark, d):
    return segments.split_chars(words(utterances(spark, d))).select("conv_id", "turn", "k", F.col("i").cast("long").alias("i"), "char", F.round("c_start", 4).alias("c_start"))


SIGNAL_SQL = "s AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS frame FROM embeddings)"


def _frames(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("frame", "v"))
    return e.withColumn("active", F.col("v") > 0)


@query(f"WITH {SIGNAL_SQL}, a AS (SELECT vec_id, frame - row_number() OVER (PARTITION BY vec_id ORDER BY frame) AS g, frame FROM s WHERE v > 0) SELECT vec_id, CAST(min(frame) AS BIGINT) AS start, CAST(max(frame) + 1 AS BIGINT) AS \"end\" FROM a GROUP BY vec_id, g")
def speech_runs(spark, d):
    r = segments.speech_runs(_frames(spark, d), ["vec_id"])
    return r.select("vec_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    f"""WITH {SIGNAL_SQL}, a AS (SELECT vec_id, frame - row_number() OVER (PARTITION BY vec_id ORDER BY frame) AS g, frame FROM s WHERE v > 0), r AS (SELECT vec_id, max(frame) + 1 - min(frame) AS n FROM a GROUP BY vec_id, g),
    k AS (SELECT vec_id, count(*) AS runs, avg(n) AS m FROM r WHERE n >= 3 GROUP BY vec_id), t AS (SELECT vec_id, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) AS ratio FROM s GROUP BY vec_id)
    SELECT t.vec_id, round(ratio, 6) AS ratio, coalesce(runs, 0) AS runs, round(coalesce(m, 0), 6) AS mean_len FROM t LEFT JOIN k ON t.vec_id = k.vec_id"""
)
def activity_masks(spark, d):
    a = metrics.activity(_frames(spark, d), ["vec_id"], F.col("v") > 0, 3)
    return a.select("vec_id", F.round("ratio", 6).alias("ratio"), "runs", F.round("mean_len", 6).alias("mean_len"))


@query(
    f"""WITH {SIGNAL_SQL}, a AS (SELECT vec_id, frame - row_number() OVER (PARTITION BY vec_id ORDER BY frame) AS g, frame FROM s WHERE v > 0), r AS (SELECT vec_id, max(frame) + 1 - min(frame) AS n FROM a GROUP BY vec_id, g)
    SELECT vec_id, count(*) FILTER (n <= 2) AS backchannels, round(avg(n), 6) AS mean_turn FROM r GROUP BY vec_id"""
)
def backchannels(spark, d):
    b = metrics.backchannels(segments.speech_runs(_frames(spark, d), ["vec_id"]), ["vec_id"], 2)
    return b.select("vec_id", "backchannels", F.round("mean_turn", 6).alias("mean_turn"))


# windows and the cascade ---------------------------------------------------------------------------------

WINDOW_STATS_SQL = (
    WORDS_SQL
    + ", "
    + ROLES_SQL.removeprefix(UTTERANCES_SQL + ",")
    + f""",
p AS (SELECT w.*, w_start_ms // {WINDOW_MS} AS win, r.role FROM words w JOIN roles r ON w.conv_id = r.conv_id AND w.speaker = r.speaker),
ws0 AS (SELECT conv_id, CAST(win AS INTEGER) AS win, CAST(sum(CASE WHEN role = 'main' THEN 1 ELSE 0 END) AS BIGINT) AS main_words, CAST(sum(CASE WHEN role = 'main' THEN 0 ELSE 1 END) AS BIGINT) AS user_words,
  CAST(sum(CASE WHEN role = 'main' THEN w_end_ms - w_start_ms ELSE 0 END) AS BIGINT) AS main_ms, CAST(sum(CASE WHEN role = 'main' THEN 0 ELSE w_end_ms - w_start_ms END) AS BIGINT) AS user_ms FROM p GROUP BY conv_id, win),
ws AS (SELECT *, CASE WHEN main_ms + user_ms > 0 THEN round(main_ms / (main_ms + user_ms), 6) ELSE 0 END AS main_ratio FROM ws0),
wc AS (SELECT conv_id, max(end_ms) AS duration_ms FROM utterances GROUP BY conv_id),
k0 AS (SELECT ws.*, least({WINDOW_MS}, duration_ms - win * {WINDOW_MS}) AS segment_ms, CASE WHEN main_ms > 0 AND main_words > 0 AND user_ms > 0 THEN 1 WHEN main_ms > 0 AND main_words > 0 THEN 2 WHEN main_ms <= 0 AND main_words <= 0 AND user_ms > 0 THEN 3
  WHEN main_ms <= 0 AND main_words > 0 AND user_ms > 0 THEN 4 WHEN main_ms > 0 AND main_words <= 0 THEN 5 ELSE 0 END AS kase FROM ws JOIN wc ON ws.conv_id = wc.conv_id),
k1 AS (SELECT *, CASE WHEN main_ms <= 0 THEN 'no_main_speech' WHEN main_words < 3 THEN 'few_words' WHEN main_ms < 3000 THEN 'short_speech' WHEN main_ms + user_ms > 0 AND main_ratio < 0.1 THEN 'low_ratio' WHEN user_words < 0 THEN 'few_user_words' WHEN segment_ms < 10000 THEN 'short_segment' END AS quality FROM k0),
cascade AS (SELECT *, CASE WHEN kase NOT IN (1, 2) THEN 'case' WHEN quality IS NOT NULL THEN 'quality' ELSE 'kept' END AS layer, CASE WHEN kase NOT IN (1, 2) THEN printf('case_%d', kase) ELSE quality END AS reason FROM k1)"""
)


def _placed(spark, d):
    return windows.words_in_windows(words(utterances(spark, d)), WINDOW_MS)


def _decided(spark, d):
    u = utterances(spark, d)
    stats = windows.window_statistics(_placed(spark, d), speakers.assign_roles(u))
    convs = speakers.conversation_totals(u).select("conv_id", "duration_ms")
    stats = stats.join(convs, "conv_id").withColumn("segment_ms", F.least(F.lit(WINDOW_MS), F.col("duration_ms") - F.col("window").cast("long") * WINDOW_MS))
    return filters.cascade(stats)


@query(f"WITH {UTTERANCES_SQL}, c AS (SELECT conv_id, max(end_ms) AS duration_ms FROM utterances GROUP BY conv_id), w AS (SELECT *, unnest(range(CAST(ceil(duration_ms / {WINDOW_MS}.0) AS BIGINT))) AS win FROM c) SELECT conv_id, CAST(win AS INTEGER) AS win, win * {WINDOW_MS} AS start_ms FROM w")
def tumbling_windows(spark, d):
    w = windows.tumbling(speakers.conversation_totals(utterances(spark, d)), WINDOW_MS)
    return w.select("conv_id", F.col("window").alias("win"), "start_ms")


@query(
    f"""WITH {UTTERANCES_SQL}, c AS (SELECT conv_id, max(end_ms) AS t FROM utterances GROUP BY conv_id), n AS (SELECT *, greatest(CAST(ceil((t - 2000) / 18000.0) AS BIGINT), 1) AS n FROM c), k AS (SELECT *, unnest(range(n)) AS k FROM n),
    s AS (SELECT *, k * 18000 AS s, least(k * 18000 + 20000, t) AS e FROM k)
    SELECT conv_id, CAST(k AS INTEGER) AS chunk, s AS start_ms, e AS end_ms, CASE WHEN k = 0 THEN s ELSE s + least(1000, (e - s) // 4) END AS keep_from, CASE WHEN k = n - 1 THEN e ELSE e - least(1000, (e - s) // 4) END AS keep_to FROM s"""
)
def hopping_windows(spark, d):
    return windows.hopping(speakers.conversation_totals(utterances(spark, d)), 20_000, 2_000)


@query(f"WITH {WORDS_SQL} SELECT conv_id, CAST(w_start_ms // {WINDOW_MS} AS INTEGER) AS win, count(*) AS n, CAST(sum(w_start_ms % {WINDOW_MS}) AS BIGINT) AS rel FROM words GROUP BY ALL")
def words_by_window(spark, d):
    return _placed(spark, d).groupBy("conv_id", F.col("window").alias("win")).agg(F.count("*").alias("n"), F.sum("rel_start_ms").alias("rel"))


@query(f"WITH {WINDOW_STATS_SQL} SELECT conv_id, win, main_words, user_words, main_ms, user_ms, main_ratio FROM ws")
def window_statistics(spark, d):
    out = windows.window_statistics(_placed(spark, d), _roles(spark, d))
    return out.withColumnRenamed("window", "win")


@query(f"WITH {WINDOW_STATS_SQL} SELECT conv_id, win, kase, layer, reason FROM cascade")
def filter_cascade(spark, d):
    return _decided(spark, d).select("conv_id", F.col("window").alias("win"), F.col("case").alias("kase"), "layer", "reason")


@query(
    f"""WITH {WINDOW_STATS_SQL} SELECT count(*) AS total, count(*) FILTER (layer = 'case') AS n_case, count(*) FILTER (layer = 'quality') AS n_quality, count(*) FILTER (layer = 'preference') AS n_preference, count(*) FILTER (layer = 'kept') AS n_kept,
    round(count(*) FILTER (layer = 'kept') / count(*), 6) AS keep_rate, round(count(*) FILTER (layer <> 'kept') / count(*), 6) AS skip_rate FROM cascade"""
)
def cascade_counts(spark, d):
    return filters.cascade_counts(_decided(spark, d))


@query(
    f"""WITH {WINDOW_STATS_SQL}, b AS (SELECT conv_id, win, false AS swapped, main_words, user_words, main_ms, user_ms FROM cascade WHERE layer = 'kept' UNION ALL SELECT conv_id, win, true, user_words, main_words, user_ms, main_ms FROM cascade WHERE layer = 'kept')
    SELECT conv_id, win, swapped, main_words, user_words, main_ms, user_ms FROM b WHERE NOT swapped OR (main_ms > 0 AND main_words > 0)"""
)
def role_swap(spark, d):
    out = filters.with_role_swap(_decided(spark, d).filter("layer = 'kept'"))
    return out.select("conv_id", F.col("window").alias("win"), "swapped", "main_words", "user_words", "main_ms", "user_ms")




@query(
    f"""WITH {WINDOW_STATS_SQL}, f AS (SELECT conv_id, CAST(win AS INTEGER) AS win, arg_min(role, w_start_ms * 1000000000 + turn * 1000000 + k) = 'user' AS user_first FROM p GROUP BY ALL)
    SELECT c.conv_id, c.win, CASE WHEN user_words = 0 AND {SHARE_SQL.format("'7:' || c.conv_id || ':' || c.win")} < 0.5 THEN 'single_speaker' WHEN user_first AND {SHARE_SQL.format("'8:' || c.conv_id || ':' || c.win")} < 0.7 THEN 'user_first' END AS preference FROM cascade c JOIN f ON c.conv_id = f.conv_id AND c.win = f.win"""
)
def preference_layer(spark, d):
    u = utterances(spark, d)
    first = filters.first_speaker_is_user(_placed(spark, d), speakers.assign_roles(u))
    rows = _decided(spark, d).drop("preference").join(first, ["conv_id", "window"])
    return rows.select("conv_id", F.col("window").alias("win"), filters.preference_reason(7, 0.5, 0.7).alias("preference"))


@query(f"WITH {WORDS_SQL}, {ROLES_SQL.removeprefix(UTTERANCES_SQL + ',')} SELECT w.conv_id, w.turn, w.k, CAST(trunc(w_start_ms / 1000.0 * 12.5) AS INTEGER) AS f0, CAST(trunc(w_end_ms / 1000.0 * 12.5) AS INTEGER) AS f1 FROM words w JOIN roles r ON w.conv_id = r.conv_id AND w.speaker = r.speaker WHERE role = 'main' AND w_end_ms > w_start_ms AND trunc(w_end_ms / 1000.0 * 12.5) > trunc(w_start_ms / 1000.0 * 12.5)")
def main_word_frames(spark, d):
    u = utterances(spark, d)
    w = words(u).join(speakers.assign_roles(u).select("conv_id", "speaker", "role"), ["conv_id", "speaker"])
    return filters.frame_bounds(filters.main_only(w), 12.5).select("conv_id", "turn", "k", "f0", "f1")


@query(f"WITH {WORDS_SQL} SELECT conv_id, turn, k, greatest(w_start_ms - 5000, 0) AS w_start_ms, w_end_ms - 5000 AS w_end_ms FROM words WHERE w_end_ms > 5000")
def delayed_words(spark, d):
    return filters.delayed(words(utterances(spark, d)), 5000).select("conv_id", "turn", "k", "w_start_ms", "w_end_ms")


@query(
    f"""WITH {WORDS_SQL}, {ROLES_SQL.removeprefix(UTTERANCES_SQL + ',')}, b AS (SELECT w.conv_id, w.turn, w.k, role, lag(role) OVER (PARTITION BY w.conv_id ORDER BY w_start_ms, turn, k) AS before FROM words w JOIN roles r ON w.conv_id = r.conv_id AND w.speaker = r.speaker),
    m AS (SELECT conv_id, turn, k, CASE WHEN role = 'main' AND (before IS NULL OR before <> 'main') THEN 'bos' WHEN role <> 'main' AND before = 'main' THEN 'eos' END AS mark FROM b) SELECT * FROM m WHERE mark IS NOT NULL"""
)
def speaker_change_marks(spark, d):
    u = utterances(spark, d)
    w = words(u).join(speakers.assign_roles(u).select("conv_id", "speaker", "role"), ["conv_id", "speaker"])
    return filters.speaker_changes(w).filter("mark IS NOT NULL").select("conv_id", "turn", "k", "mark")


CONFIDENCE_SQL = WORDS_SQL + ", cw AS (SELECT *, ((conv_id * 13 + turn * 7 + k * 3) % 100) / 100.0 AS confidence FROM words)"


def _confident(spark, d):
    return words(utterances(spark, d)).withColumn("confidence", ((F.col("conv_id") * 13 + F.col("turn") * 7 + F.col("k") * 3) % 100) / 100.0)


@query(f"WITH {CONFIDENCE_SQL} SELECT conv_id, turn, k FROM cw WHERE confidence >= 0.5 AND w_end_ms > w_start_ms AND w_end_ms - w_start_ms <= 300")
def confident_words(spark, d):
    return filters.good_words(_confident(spark, d), 0.5, 300).select("conv_id", "turn", "k")


@query(f"WITH {CONFIDENCE_SQL}, a AS (SELECT count(*) AS n, count(*) FILTER (confidence < 0.5) AS low, count(*) FILTER (confidence < 0.3) AS very_low, count(*) FILTER (w_end_ms <= w_start_ms) AS zero, count(*) FILTER (w_end_ms < w_start_ms) AS negative FROM cw) SELECT *, round(greatest(0.0, 1 - (low + very_low + zero + negative) / n), 6) AS quality FROM a")
def word_diagnostics(spark, d):
    return metrics.word_diagnostics(_confident(spark, d))


@query(
    f"""WITH {CONFIDENCE_SQL}, c AS (SELECT conv_id, count(*) AS n, avg(confidence) FILTER (speaker = 'assistant') AS a, avg(confidence) FILTER (speaker = 'user') AS u FROM cw GROUP BY conv_id)
    SELECT conv_id, round(list_avg(list_filter([least(n / 100.0, 1.0), a, u, (CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN u IS NULL THEN 0 ELSE 1 END) / 2.0], lambda x: x IS NOT NULL)), 6) AS quality FROM c"""
)
def alignment_quality(spark, d):
    c = _confident(spark, d).groupBy("conv_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("speaker") == "assistant", F.col("confidence"))).alias("a"), F.avg(F.when(F.col("speaker") == "user", F.col("confidence"))).alias("u"))
    return c.select("conv_id", F.round(metrics.alignment_quality(F.col("n"), F.col("a"), F.col("u")), 6).alias("quality"))


# manifests -----------------------------------------------------------------------------------------------

MANIFEST_SQL = (
    UTTERANCES_SQL
    + """,
c AS (SELECT conv_id, max(end_ms) / 1000.0 AS duration FROM utterances GROUP BY conv_id),
m0 AS (SELECT conv_id, 'conv_' || lpad(CAST(conv_id AS VARCHAR), 6, '0') AS id, conv_id % 4 AS machine_id, conv_id AS line, duration FROM c),
manifest AS (SELECT * FROM m0 UNION ALL SELECT conv_id, id, machine_id + 1, line, duration FROM m0 WHERE conv_id % 10 = 0)"""
)


def _manifest(spark, d):
    c = speakers.conversation_totals(utterances(spark, d))
    m = c.select("conv_id", F.concat(F.lit("conv_"), F.lpad(F.col("conv_id").cast("string"), 6, "0")).alias("id"), (F.col("conv_id") % 4).alias("machine_id"), F.col("conv_id").alias("line"), (F.col("duration_ms") / 1000.0).alias("duration"))
    return m.unionByName(m.filter("conv_id % 10 = 0").withColumn("machine_id", F.col("machine_id") + 1))


@query(f"WITH {MANIFEST_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY machine_id, line) AS r FROM manifest) SELECT id, machine_id, duration FROM r WHERE r = 1")
def manifest_first_wins(spark, d):
    return manifest.first_wins(_manifest(spark, d), "id", ["machine_id", "line"]).select("id", "machine_id", "duration")


@query(f"WITH {MANIFEST_SQL} SELECT id, machine_id, duration FROM manifest WHERE duration BETWEEN 30 AND 120")
def manifest_duration_range(spark, d):
    return manifest.in_range(_manifest(spark, d), "duration", 30, 120).select("id", "machine_id", "duration")


@query(f"WITH {MANIFEST_SQL} SELECT id, machine_id FROM manifest WHERE conv_id % 3 <> 0")
def manifest_resume(spark, d):
    m = _manifest(spark, d)
    return manifest.resume(m, m.filter("conv_id % 3 = 0"), "id").select("id", "machine_id")


@query(
    f"""WITH {MANIFEST_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY machine_id, line) > 1 AS dup, CASE WHEN conv_id % 7 = 0 THEN 'missing_audio' WHEN conv_id % 5 = 0 THEN 'missing_alignment' END AS error FROM manifest)
    SELECT count(*) AS rows, count(*) FILTER (dup) AS duplicates, count(*) FILTER (NOT dup AND error IS NULL) AS valid, count(*) FILTER (NOT dup AND error IS NOT NULL) AS invalid,
    round(sum(CASE WHEN dup THEN 0 ELSE duration END) / 3600.0, 2) AS hours_all, round(sum(CASE WHEN NOT dup AND error IS NULL THEN duration ELSE 0 END) / 3600.0, 2) AS hours_valid FROM f"""
)
def manifest_merge_statistics(spark, d):
    m = _manifest(spark, d).withColumn("duplicate", F.row_number().over(Window.partitionBy("id").orderBy("machine_id", "line")) > 1)
    m = m.withColumn("audio_path", F.concat("id", F.lit(".wav"))).withColumn("alignment_path", F.concat("id", F.lit(".json")))
    files = m.filter("conv_id % 7 <> 0").select(F.col("audio_path").alias("path")).unionAll(m.filter("conv_id % 5 <> 0").select(F.col("alignment_path").alias("path")))
    return manifest.merge_statistics(manifest.validate_entries(m, files))


@query(
    f"""WITH {MANIFEST_SQL} SELECT i AS machine_id, CASE WHEN n IS NOT NULL AND i % 2 = 0 THEN 'complete' WHEN n IS NOT NULL OR i % 2 = 0 THEN 'partial' ELSE 'missing' END AS state, coalesce(n, 0) AS n_manifest
    FROM range(8) t(i) LEFT JOIN (SELECT machine_id, count(*) AS n FROM manifest GROUP BY machine_id) m ON m.machine_id = i"""
)
def machine_completeness(spark, d):
    checkpoints = spark.range(8).filter("id % 2 = 0").withColumnRenamed("id", "machine_id")
    return manifest.completeness(8, checkpoints, _manifest(spark, d))


@query("SELECT lang AS dataset, CAST(grouping(lang) AS INTEGER) AS is_total, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY ROLLUP (lang)")
def dataset_statistics(spark, d):
    return manifest.dataset_statistics(read(spark, d, "documents").withColumnRenamed("lang", "dataset"), "dataset", "n_chars")


@query("SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank, CAST((row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) % 4 AS INTEGER) AS machine FROM documents")
def longest_first_tasks(spark, d):
    return manifest.deal_out(read(spark, d, "documents").select("doc_id", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id").asc()], 4)


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents), b AS (SELECT *, rank // 16 AS batch FROM r) SELECT doc_id, rank, batch FROM b WHERE batch IN (SELECT batch FROM b GROUP BY batch HAVING count(*) = 16)")
def full_batches(spark, d):
    ranked = manifest.global_rank(read(spark, d, "documents").select("doc_id"), [F.col("doc_id").asc()])
    return manifest.full_batches(ranked, 16).select("doc_id", "rank", "batch")


@query(
    """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS i FROM documents),
    r AS (SELECT source, doc_id, i, 0 AS batch, n_chars AS total, 1 AS n FROM o WHERE i = 1 UNION ALL
    SELECT o.source, o.doc_id, o.i, CASE WHEN total + n_chars > 20000 OR n >= 32 THEN batch + 1 ELSE batch END, CASE WHEN total + n_chars > 20000 OR n >= 32 THEN n_chars ELSE total + n_chars END, CASE WHEN total + n_chars > 20000 OR n >= 32 THEN 1 ELSE n + 1 END
    FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1)
    SELECT r.source, r.doc_id, n_chars, batch FROM r JOIN documents d ON d.doc_id = r.doc_id"""
)
def next_fit_batches(spark, d):
    return manifest.next_fit(read(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", ["n_chars", "doc_id"], 20_000, 32)


@query("SELECT page_id, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN '' ELSE url END, ''), 'page/' || page_id) AS path FROM pages")
def path_fallback(spark, d):
    p = read(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url")).alias("path"), F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("audio"))
    return p.select("page_id", manifest.any_path("path", "audio").alias("path"))


@query(
    """WITH f AS (SELECT 'a/' || page_id || '.wav' AS path FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 'b/' || page_id || '.wav' FROM pages WHERE page_id % 3 = 0)
    SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'a/' || page_id || '.wav' WHEN page_id % 3 = 0 THEN 'b/' || page_id || '.wav' END AS resolved FROM pages"""
)
def alignment_resolution(spark, d):
    p = read(spark, d, "pages").select(F.col("page_id").alias("id"))
    name = lambda f: F.concat(F.lit(f"{f}/"), F.col("id").cast("string"), F.lit(".wav")).alias("path")
    files = p.filter("id % 2 = 0").select(name("a")).unionAll(p.filter("id % 3 = 0").select(name("b")))
    candidates = p.select("id", name("a"), F.lit(0).alias("priority")).unionAll(p.select("id", name("b"), F.lit(1).alias("priority")))
    return manifest.resolve(p, candidates, files)


@query("WITH b AS (SELECT url AS path, regexp_extract(url, '([^/]+)$', 1) AS base FROM pages) SELECT DISTINCT b.path, f.found FROM b LEFT JOIN (SELECT base, min(path) AS found FROM b GROUP BY base) f ON b.base = f.base")
def basename_repair(spark, d):
    p = read(spark, d, "pages").select(F.col("url").alias("path"))
    return manifest.by_basename(p.distinct(), p)


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id, event_id FROM r WHERE r > 10")
def retention(spark, d):
    return manifest.retention(read(spark, d, "events").select("user_id", "event_id", F.col("event_id").alias("step")), "user_id", 10).select("user_id", "event_id")


@query("SELECT regexp_extract(url, '^(.*)/[^/]+$', 1) AS folder, count(*) AS n_files FROM pages GROUP BY ALL")
def folder_inventory(spark, d):
    return manifest.writer_inventory(read(spark, d, "pages").select(F.col("url").alias("path")))


# text and corpora ----------------------------------------------------------------------------------------


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS normal FROM documents")
def normalized_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.normalize_text("text").alias("normal"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s.,!?]', ' ', 'g'), '\\s+', ' ', 'g')) AS normal FROM documents")
def bleu_normalized_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.normalize_for_bleu("text").alias("normal"))


PAIRS_SQL = (
    UTTERANCES_SQL
    + """,
a AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS t FROM utterances),
pairs AS (SELECT x.conv_id * 1000 + x.turn AS id, x.t AS ref, y.t AS hyp FROM a x JOIN a y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"""
)


def _pairs(spark, d):
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", ""), " +", " "))
    a = utterances(spark, d).select("conv_id", "turn", t.alias("t"))
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("h"))
    return a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("t").alias("ref"), F.col("h").alias("hyp"))


@query(f"WITH {PAIRS_SQL} SELECT id, round(CASE WHEN length(replace(ref, ' ', '')) > 0 THEN levenshtein(replace(ref, ' ', ''), replace(hyp, ' ', '')) / length(replace(ref, ' ', '')) WHEN length(hyp) > 0 THEN 1 ELSE 0 END, 6) AS cer FROM pairs")
def character_errors(spark, d):
    return _pairs(spark, d).select("id", F.round(T.char_error_rate("ref", "hyp"), 6).alias("cer"))


@query()
def word_errors(spark, d):
    p = _pairs(spark, d).select("id", T.word_array("ref").alias("ref"), T.word_array("hyp").alias("hyp"))
    return p.select("id", F.round(T.word_error_rate(F.col("ref"), F.col("hyp")), 6).alias("wer"))


@query()
def word_error_kinds(spark, d):
    p = _pairs(spark, d).select("id", T.word_array("ref").alias("ref"), T.word_array("hyp").alias("hyp"))
    return tokens.wer_counts(p)


@query(
    f"""WITH {PAIRS_SQL}, s AS (SELECT id, list_distinct(list_filter(string_split(ref, ''), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(hyp, ''), lambda x: x <> '')) AS y FROM pairs)
    SELECT id, round(CASE WHEN len(x) > 0 THEN len(list_intersect(x, y)) / len(x) ELSE 1.0 END, 6) AS coverage FROM s"""
)
def character_coverage(spark, d):
    return _pairs(spark, d).select("id", F.round(T.charset_coverage("ref", "hyp"), 6).alias("coverage"))


def _ngram_sql(n: int) -> str:
    return " UNION ALL ".join(f"SELECT id, {k} AS n, '{s}' AS side, array_to_string(list_slice({s}, i, i + {k - 1}), ' ') AS gram FROM (SELECT id, {s}, unnest(range(1, len({s}) - {k} + 2)) AS i FROM p)" for s in ("r", "h") for k in range(1, n + 1))


@query(
    f"""WITH {PAIRS_SQL}, p AS (SELECT id, list_filter(string_split(ref, ' '), lambda x: x <> '') AS r, list_filter(string_split(hyp, ' '), lambda x: x <> '') AS h FROM pairs), g AS ({_ngram_sql(4)}),
    e AS (SELECT id, n, gram, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 'h') AS h FROM g GROUP BY ALL), b AS (SELECT n, sum(least(r, h)) AS hit, sum(h) AS al FROM e GROUP BY n),
    l AS (SELECT {', '.join(f'sum(CASE WHEN n = {n} THEN ln(hit / al) END) AS p{n}' for n in range(1, 5))} FROM b), z AS (SELECT sum(len(r)) AS rl, sum(len(h)) AS hl FROM p),
    f AS (SELECT *, CASE WHEN hl >= rl THEN 1.0 ELSE exp(1 - rl / hl) END AS bp FROM l, z)
    SELECT {', '.join(f"round(bp * exp(({' + '.join(f'p{k}' for k in range(1, n + 1))}) / {n}), 6) AS bleu{n}" for n in range(1, 5))}, round(bp, 6) AS brevity, round(hl / rl, 6) AS length_ratio FROM f"""
)
def corpus_bleu(spark, d):
    p = _pairs(spark, d).select("id", T.word_array("ref").alias("ref"), T.word_array("hyp").alias("hyp"))
    return metrics.corpus_bleu(p, 4)


#: A written phrase for every rule and term, one of them put behind each document's text.
_WRITTEN = [re.sub(r"\\\\|\\$", "", p) for p, _ in K.SPOKEN_RULES]
_Q = lambda x: "'" + x.replace("'", "''") + "'"


def _with_phrase(spark, d, phrases):
    pick = F.element_at(F.array(*map(F.lit, phrases)), (F.col("doc_id") % len(phrases) + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), pick).alias("t"))


def _with_phrase_sql(phrases):
    return f"d AS (SELECT doc_id, coalesce(text, '') || ' ' || [{', '.join(map(_Q, phrases))}][doc_id % {len(phrases)} + 1] AS t FROM documents)"


def _rules_sql():
    out = "t"
    for pattern, to in K.SPOKEN_RULES:
        out = f"regexp_replace({out}, {_Q(pattern)}, {_Q(to)}, 'g')"
    hits = " + ".join(f"CAST(regexp_matches(t, {_Q(p)}) AS INTEGER)" for p, _ in K.SPOKEN_RULES)
    return f"WITH {_with_phrase_sql(_WRITTEN)} SELECT doc_id, {out} AS spoken, round(least(0.7 + 0.05 * ({hits}), 0.9), 6) AS confidence FROM d"


@query(_rules_sql())
def spoken_rules(spark, d):
    t = _with_phrase(spark, d, _WRITTEN)
    return t.select("doc_id", T.spoken("t").alias("spoken"), F.round(T.rule_confidence("t", K.SPOKEN_RULES), 6).alias("confidence"))


def _switch_sql():
    steps, now = [_with_phrase_sql(list(K.TECH_TERMS))], "d"
    for k, (term, to) in enumerate(K.TECH_TERMS.items()):
        share = SHARE_SQL.format(f"'11:' || doc_id || ':{k}'")
        steps.append(f"s{k} AS (SELECT doc_id, CASE WHEN {share} < 0.3 THEN regexp_replace(t, {_Q(f'(?s)^(.*?){term}')}, {_Q(chr(92) + '1' + to)}) ELSE t END AS t FROM {now})")
        now = f"s{k}"
    return f"WITH {', '.join(steps)} SELECT doc_id, t AS switched FROM {now}"


@query(_switch_sql())
def code_switching(spark, d):
    return _with_phrase(spark, d, list(K.TECH_TERMS)).select("doc_id", T.code_switch("t", K.TECH_TERMS, 0.3, 11, "doc_id").alias("switched"))


@query(
    f"SELECT doc_id, CASE WHEN {SHARE_SQL.format(chr(39) + '5:' + chr(39) + ' || doc_id')} < 0.1 THEN ['um', 'well', 'so'][CAST(floor({SHARE_SQL.format(chr(39) + '6:' + chr(39) + ' || doc_id')} * 3) AS BIGINT) + 1] || ', ' || text ELSE text END AS said FROM documents"
)
def fillers(spark, d):
    return read(spark, d, "documents").select("doc_id", T.with_filler("text", ["um", "well", "so"], 0.1, 5, "doc_id").alias("said"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def uniform_sample(spark, d):
    return corpus.sample_exact(read(spark, d, "documents").select("doc_id"), "doc_id", 100, 42)


@query(
    """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE lang <> 'en'), e AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents WHERE lang = 'en')
    SELECT doc_id, CASE WHEN r <= 140 THEN 'native' ELSE 'switched' END AS part FROM n WHERE r <= 160 UNION ALL SELECT doc_id, 'english' FROM e WHERE r <= 40"""
)
def corpus_mix(spark, d):
    docs = read(spark, d, "documents")
    return corpus.mix(docs.filter("lang <> 'en'").select("doc_id"), docs.filter("lang = 'en'").select("doc_id"), "doc_id", 200, 0.7, 0.1)


@query(
    """WITH m AS (SELECT doc_id, CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN 0.5 ELSE 0.0 END AS ratio, len(string_split(text, chr(10))) AS turns FROM documents)
    SELECT count(*) AS n, count(*) FILTER (ratio = 0) AS native_only, count(*) FILTER (ratio = 1) AS english_only, count(*) FILTER (ratio > 0 AND ratio < 1) AS switched, CAST(sum(turns) AS BIGINT) AS turns, round(avg(turns), 6) AS mean_turns FROM m"""
)
def mix_statistics(spark, d):
    ratio = F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "de", 0.5).otherwise(0.0)
    return corpus.mix_statistics(read(spark, d, "documents"), ratio, F.size(F.split("text", "\n")))


@query(f"SELECT doc_id, round(-ln(({SHARE_SQL.format(chr(39) + '3:' + chr(39) + ' || doc_id')} * 4294967296.0 + 0.5) / 4294967296.0) / CASE lang WHEN 'en' THEN 0.7 ELSE 0.3 END, 6) AS draw FROM documents")
def weighted_interleave(spark, d):
    w = F.when(F.col("lang") == "en", 0.7).otherwise(0.3)
    return corpus.weighted_order(read(spark, d, "documents").withColumn("w", w), "w", "doc_id", 3).select("doc_id", F.round("draw", 6).alias("draw"))


@query(f"SELECT doc_id, lang FROM documents WHERE {SHARE_SQL.format(chr(39) + '9:' + chr(39) + ' || doc_id')} < CASE lang WHEN 'en' THEN 0.4 WHEN 'de' THEN 0.15 ELSE 0.3 END")
def stratified_sample(spark, d):
    return corpus.stratified(read(spark, d, "documents"), "lang", "doc_id", {"en": 0.4, "de": 0.15, "fr": 0.3, "es": 0.3}, 9).select("doc_id", "lang")


@query(f"WITH {UTTERANCES_SQL} SELECT conv_id, pos, CASE WHEN (pos % 2 = 1) <> (conv_id % 2 = 1) THEN 'user' ELSE 'main' END AS speaker FROM utterances")
def alternating_speakers(spark, d):
    return corpus.alternate_speakers(utterances(spark, d), swap=F.col("conv_id") % 2 == 1).select("conv_id", "pos", "speaker")


@query("SELECT doc_id, CASE WHEN source IS NULL OR lower(trim(source)) IN ('?', '', 'unknown', 'n/a', 'none', 'null', '-', 'speaker_unknown', 'unidentified') THEN 'UNKNOWN_SPEAKER' ELSE trim(source) END AS speaker FROM documents")
def normalized_speakers(spark, d):
    return read(spark, d, "documents").select("doc_id", filters.normalize_speaker("source").alias("speaker"))


@query(
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'x' ELSE CAST(event_id % 50 - 2 AS VARCHAR) END AS s, CASE WHEN event_id % 17 = 0 THEN '9000' ELSE CAST(event_id % 60 AS VARCHAR) END AS e FROM events)
    SELECT event_id, CASE WHEN s IS NULL OR e IS NULL THEN 'missing_value' WHEN try_cast(s AS DOUBLE) IS NULL OR try_cast(e AS DOUBLE) IS NULL THEN 'invalid_type' WHEN try_cast(s AS DOUBLE) < 0 OR try_cast(e AS DOUBLE) < 0 THEN 'negative_value'
    WHEN try_cast(s AS DOUBLE) > try_cast(e AS DOUBLE) THEN 'start_after_end' WHEN try_cast(e AS DOUBLE) - try_cast(s AS DOUBLE) > 3600 THEN 'too_long' END AS error FROM t"""
)
def timestamp_errors(spark, d):
    i = F.col("event_id")
    t = read(spark, d, "events").select("event_id", F.when(i % 11 == 0, None).when(i % 13 == 0, "x").otherwise((i % 50 - 2).cast("string")).alias("s"), F.when(i % 17 == 0, "9000").otherwise((i % 60).cast("string")).alias("e"))
    return t.select("event_id", filters.timestamp_error("s", "e").alias("error"))


# metric logs ---------------------------------------------------------------------------------------------


def _log(spark, d):
    return read(spark, d, "events").select("user_id", "event_id", "value")


@query("SELECT user_id, event_id, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def running_best(spark, d):
    return metrics.running_best(_log(spark, d), ["user_id"], "event_id", "value").select("user_id", "event_id", "is_best", "best")


@query("WITH m AS (SELECT user_id, event_id, avg(value) OVER w AS moving, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT user_id, event_id, round(moving, 6) AS moving FROM m WHERE n = 5")
def moving_average(spark, d):
    return metrics.moving_average(_log(spark, d), ["user_id"], "event_id", "value", 5).select("user_id", "event_id", F.round("moving", 6).alias("moving"))


@query("SELECT user_id, round(list_reduce(list(CAST(value AS DOUBLE) ORDER BY event_id), lambda a, x: 0.1::DOUBLE * x + 0.9::DOUBLE * a), 6) AS ema FROM events GROUP BY user_id")
def exponential_average(spark, d):
    return metrics.ema(_log(spark, d), ["user_id"], "event_id", "value").select("user_id", F.round("ema", 6).alias("ema"))


@query("WITH s AS (SELECT user_id, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, min(value) AS least, max(value) AS most FROM events GROUP BY user_id) SELECT s.*, (SELECT min(event_id) FROM events e WHERE e.user_id = s.user_id AND e.value = s.least) AS best_step, round(CASE WHEN first <> 0 THEN (first - last) / first * 100 ELSE 0 END, 4) AS improvement FROM s")
def training_summary(spark, d):
    return metrics.training_summary(_log(spark, d), ["user_id"], "event_id", "value")


@query(
    """WITH t AS (SELECT user_id, event_id, CAST(event_id % 97 + 1 AS DOUBLE) AS words, CAST(event_id % 5 + 1 AS DOUBLE) AS seconds FROM events)
    SELECT user_id, event_id, round(words / seconds, 6) AS wps, round(sum(words) OVER w / sum(seconds) OVER w, 6) AS avg_wps, round(sum(seconds) OVER w / row_number() OVER w * (1000 - row_number() OVER w), 4) AS eta FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""
)
def throughput(spark, d):
    t = _log(spark, d).withColumn("words", (F.col("event_id") % 97 + 1).cast("double")).withColumn("seconds", (F.col("event_id") % 5 + 1).cast("double"))
    out = metrics.throughput(t, ["user_id"], "event_id", "words", "seconds", 1000)
    return out.select("user_id", "event_id", F.round("wps", 6).alias("wps"), F.round("avg_wps", 6).alias("avg_wps"), F.round("eta", 4).alias("eta"))


@query("SELECT event_id, event_id % 1000 AS step, round(CASE WHEN event_id % 1000 < 100 THEN 0.001 * (event_id % 1000) / 100 ELSE 0.001 * 0.5 * (1 + cos(pi() * (event_id % 1000 - 100) / 900)) END, 12) AS cosine, round(CASE WHEN event_id % 1000 < 100 THEN 0.001 * (event_id % 1000) / 100 ELSE 0.001 * greatest(0.0, (1000 - event_id % 1000) / 900) END, 12) AS linear FROM events")
def schedules(spark, d):
    s = F.col("step").cast("double")
    r = read(spark, d, "events").select("event_id", (F.col("event_id") % 1000).alias("step"))
    return r.select("event_id", "step", F.round(metrics.warmup_cosine(s, 100, 1000, 0.001), 12).alias("cosine"), F.round(metrics.warmup_linear(s, 100, 1000, 0.001), 12).alias("linear"))


@query("SELECT l_linenumber, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS loss FROM lineitem GROUP BY l_linenumber")
def weighted_loss(spark, d):
    out = metrics.weighted_loss(read(spark, d, "lineitem"), ["l_linenumber"], "l_discount", "l_quantity")
    return out.select("l_linenumber", F.round("loss", 6).alias("loss"))


@query("SELECT user_id, round(pow(2, avg(value) / 100), 6) AS perplexity FROM events GROUP BY user_id")
def perplexity(spark, d):
    return _log(spark, d).groupBy("user_id").agg(F.round(metrics.perplexity(F.avg("value") / 100), 6).alias("perplexity"))


@query("SELECT l_linenumber AS codebook, count(*) FILTER (l_returnflag <> 'N') AS n, round(avg(l_discount) FILTER (l_returnflag <> 'N'), 6) AS mean, min(l_discount) FILTER (l_returnflag <> 'N') AS least, max(l_discount) FILTER (l_returnflag <> 'N') AS most FROM lineitem GROUP BY l_linenumber")
def codebook_loss(spark, d):
    out = metrics.codebook_loss(read(spark, d, "lineitem").withColumnRenamed("l_linenumber", "codebook"), F.col("l_returnflag") != "N", "l_discount")
    return out.withColumn("mean", F.round("mean", 6))


@query(
    """WITH n AS (SELECT l_linenumber AS codebook, l_partkey % 50 AS token, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY codebook ORDER BY n DESC, token) AS r FROM n)
    SELECT codebook, count(*) AS distinct_tokens, CAST(sum(n) AS BIGINT) AS total, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy, array_to_string(list(token ORDER BY r) FILTER (r <= 10), ',') AS top FROM r GROUP BY codebook"""
)
def codebook_usage(spark, d):
    t = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("codebook"), (F.col("l_partkey") % 50).alias("token"))
    return metrics.token_usage(t).select("codebook", F.col("distinct").alias("distinct_tokens"), "total", F.round("entropy", 6).alias("entropy"), F.array_join(F.col("top").cast("array<string>"), ",").alias("top"))


@query("SELECT round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS std, CAST(0 AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_inf, max(value) > 100 AS exploding, max(value) < 1e-7 AS vanishing FROM events")
def norm_summary(spark, d):
    return metrics.norm_summary(_log(spark, d), "value").withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def value_spread(spark, d):
    return metrics.spread(read(spark, d, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("SELECT round(coalesce(avg(CASE WHEN value - 50 > 0 THEN value - 50 END), 0), 6) AS a, round(coalesce(avg(CASE WHEN 20 - value > 0 THEN 20 - value END), 0), 6) AS b FROM events")
def positive_means(spark, d):
    e = _log(spark, d).select((F.col("value") - 50).alias("a"), (20 - F.col("value")).alias("b"))
    return metrics.positive_means(e, ["a", "b"]).select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("SELECT user_id, 'log/' || name AS name, value FROM (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, CAST(max(event_id) AS DOUBLE) AS last FROM events GROUP BY user_id) UNPIVOT (value FOR name IN (n, last))")
def prefixed_metrics(spark, d):
    e = _log(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    return metrics.prefixed(e, ["user_id"], "log")


# arrays --------------------------------------------------------------------------------------------------


@query(
    """SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x)))), 5) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def neighbour_cosine(spark, d):
    e = read(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(arrays.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query(
    """WITH RECURSIVE p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), t AS (SELECT *, unnest(range(64)) AS t FROM p),
    k AS (SELECT vec_id, list(CASE WHEN abs(t // 8 - t % 8) <= 2 THEN sqrt(list_sum(list_transform(range(2, 9), lambda i: pow(CAST(x[t // 8 * 8 + i] AS DOUBLE) - y[t % 8 * 8 + i], 2)))) END ORDER BY t) AS c FROM t GROUP BY vec_id),
    d AS (SELECT vec_id, c, 1 AS t, [2 * c[1]] AS d FROM k UNION ALL SELECT vec_id, c, t + 1, list_append(d, least(CASE WHEN t >= 8 THEN d[t - 7] + c[t + 1] END, CASE WHEN t % 8 > 0 THEN d[t] + c[t + 1] END, CASE WHEN t >= 8 AND t % 8 > 0 THEN d[t - 8] + 2 * c[t + 1] END)) FROM d WHERE t < 64)
    SELECT vec_id, round(10 * sqrt(2) / ln(10) * d[64] / 16, 5) AS distortion FROM d WHERE t = 64"""
)
def cepstral_distances(spark, d):
    """Signals of 8 frames of 8 coefficients against the next one, warped by up to 2 frames."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice(F.col("embedding").cast("array<double>"), k * 8 + 1, F.lit(8)))
    e = read(spark, d, "embeddings").select("vec_id", frames.alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(b, "vec_id").select("vec_id", F.round(audio.cepstral_distance(F.col("x"), F.col("y"), 2), 5).alias("distortion"))


@query(
    """WITH s AS (SELECT vec_id // 64 AS signal, vec_id % 64 * 64 + i - 1 AS t, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)),
    v AS (SELECT *, CASE WHEN abs(x) >= 0.1 THEN x ELSE 0.0 END AS y, (count(*) OVER (PARTITION BY signal) - 256) // 128 AS top FROM s),
    f0 AS (SELECT *, unnest([t // 128 - 1, t // 128]) AS f FROM v), w0 AS (SELECT signal, f, t - 128 * f AS t, 0.5 - 0.5 * cos(2 * pi() * (t - 128 * f + 1) / 257) AS w, x, y FROM f0 WHERE f BETWEEN 0 AND top),
    e AS (SELECT signal, f, sum(pow(w * x, 2)) AS e FROM w0 GROUP BY ALL), kept AS (SELECT signal, f, row_number() OVER (PARTITION BY signal ORDER BY f) - 1 AS k FROM (SELECT *, max(e) OVER (PARTITION BY signal) AS most FROM e) WHERE e > most * 0.0001),
    o AS (SELECT signal, 128 * k + t AS t, sum(w * x) AS x, sum(w * y) AS y FROM w0 JOIN kept USING (signal, f) GROUP BY ALL),
    n AS (SELECT *, max(t) OVER (PARTITION BY signal) // 128 - 1 AS top FROM o), f1 AS (SELECT *, unnest([t // 128 - 1, t // 128]) AS f FROM n),
    w1 AS (SELECT signal, f, t - 128 * f AS t, (0.5 - 0.5 * cos(2 * pi() * (t - 128 * f + 1) / 257)) * x AS x, (0.5 - 0.5 * cos(2 * pi() * (t - 128 * f + 1) / 257)) * y AS y FROM f1 WHERE f BETWEEN 0 AND top),
    bands AS (SELECT j, unnest(range(CAST(round(150 * pow(2, (2 * j - 1) / 6.0) * 512 / 10000) AS BIGINT), CAST(round(150 * pow(2, (2 * j + 1) / 6.0) * 512 / 10000) AS BIGINT))) AS b FROM (SELECT unnest(range(15)) AS j)),
    z AS (SELECT signal, f, j, b, sum(x * cos(pi() * b * t / 256)) AS xr, sum(x * sin(pi() * b * t / 256)) AS xi, sum(y * cos(pi() * b * t / 256)) AS yr, sum(y * sin(pi() * b * t / 256)) AS yi FROM w1, bands GROUP BY ALL),
    p AS (SELECT signal, f, j, sqrt(sum(xr * xr + xi * xi)) AS x, sqrt(sum(yr * yr + yi * yi)) AS y, max(f) OVER (PARTITION BY signal) AS top FROM z GROUP BY signal, f, j),
    m AS (SELECT signal, j, x, y, top, unnest(range(greatest(f - 29, 0), f + 1)) AS m FROM p), q AS (SELECT *, y * sqrt(sum(x * x) OVER g / sum(y * y) OVER g) AS c FROM m WHERE m <= top - 29 WINDOW g AS (PARTITION BY signal, m, j)),
    r AS (SELECT signal, m, j, corr(x, least(c, x * (1 + pow(10, 0.75)))) AS r FROM q GROUP BY ALL), a AS (SELECT signal, avg(r) AS r FROM r GROUP BY signal)
    SELECT g.signal, round(r, 5) AS score FROM (SELECT DISTINCT signal FROM s) g LEFT JOIN a ON g.signal = a.signal"""
)
def signal_intelligibility(spark, d):
    """Runs of 64 vectors as signals of 10 kHz, against themselves without their quiet samples."""
    rows = F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("x"))))
    s = read(spark, d, "embeddings").groupBy(F.expr("vec_id div 64").alias("signal")).agg(F.flatten(F.transform(rows, lambda r: r["x"])).alias("x"))
    y = F.transform("x", lambda v: F.when(F.abs(v) >= 0.1, v).otherwise(0.0))
    return s.select("signal", F.round(audio.intelligibility(F.col("x"), y, 10_000), 5).alias("score"))


@query(
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding)), 5) AS rms, round(len(list_filter(embedding, lambda x: abs(x) >= 0.2)) / len(embedding), 6) AS clipped, embedding[1:3] AS first FROM embeddings"""
)
def signal_levels(spark, d):
    a = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", F.round(arrays.rms(a), 5).alias("rms"), F.round(arrays.clip_ratio(a, 0.2), 6).alias("clipped"), arrays.fingerprint(a)["first"].alias("first"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), f AS (SELECT vec_id, a, unnest(range(len(a) // 8)) AS k FROM e),
    n AS (SELECT vec_id, avg(CASE WHEN sqrt(list_sum(list_transform(a[8 * k + 1:8 * k + 8], lambda x: x * x)) / 8) > 0.1 THEN 1.0 ELSE 0 END) AS active FROM f GROUP BY vec_id),
    q AS (SELECT vec_id, quantile_cont(abs(v), 0.05) AS noise FROM (SELECT vec_id, unnest(a) AS v FROM e) GROUP BY vec_id),
    r AS (SELECT e.vec_id, sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)) AS rms, active, noise, len(a) AS n, list_max(list_transform(a, lambda x: abs(x))) AS top FROM e JOIN n ON e.vec_id = n.vec_id JOIN q ON q.vec_id = e.vec_id),
    s AS (SELECT vec_id, round(20 * log10(rms / (noise + 1e-8)), 4) AS snr, round(active, 6) AS active, round(20 * log10(rms + 1e-8), 4) AS dbfs, CASE WHEN top < 1e-10 THEN 'silent' WHEN n < 10 THEN 'short' END AS error FROM r)
    SELECT *, concat_ws(',', CASE WHEN snr < 20 THEN 'low_snr' END, CASE WHEN dbfs < -40 THEN 'too_quiet' END, CASE WHEN dbfs > -10 THEN 'too_loud' END) AS issues,
    concat_ws(',', CASE WHEN snr < 20 THEN 'record_quieter' END, CASE WHEN dbfs < -40 THEN 'raise_level' END, CASE WHEN dbfs > -10 THEN 'reduce_level' END, CASE WHEN 1 - active > 0.3 THEN 'trim_silence' END) AS advice FROM s"""
)
def signal_quality(spark, d):
    a = F.col("embedding")
    e = read(spark, d, "embeddings").select("vec_id", F.round(arrays.estimated_snr(a), 4).alias("snr"), F.round(arrays.active_ratio(a, 8, 0.1), 6).alias("active"), F.round(arrays.dbfs(a), 4).alias("dbfs"), filters.audio_error("embedding", 100).alias("error"))
    e = e.withColumn("issues", arrays.quality_issues(F.col("snr"), F.lit(0.0), F.col("dbfs")))
    e = e.withColumn("advice", arrays.quality_advice(F.col("issues"), 1 - F.col("active")))
    return e.withColumn("issues", F.array_join("issues", ",")).withColumn("advice", F.array_join("advice", ","))


@query("SELECT vec_id, embedding[1:8] AS head, embedding[len(embedding) - 7:] AS tail FROM embeddings")
def deterministic_spans(spark, d):
    a = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", arrays.span(a, 0.64, 12.5).alias("head"), arrays.span(a, 0.64, 12.5, "end").alias("tail"))


@query(
    """WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(abs(x) * 1000) AS INTEGER)) AS c FROM embeddings),
    w AS (SELECT *, list_filter(range(len(c)), lambda i: c[i + 1] <> 0) AS ix FROM c)
    SELECT vec_id, array_to_string(c[1:8] || c[9:64], ',') AS codes, repeat('f', len(c[1:8])) || repeat('t', len(c[9:64])) AS mask,
    CAST(CASE WHEN len(ix) <= 3 OR len(ix) < 5 THEN 0 ELSE greatest(ix[3] - 2, 0) END AS INTEGER) AS span_start, CAST(CASE WHEN len(ix) <= 3 OR len(ix) < 5 THEN len(c) ELSE least(ix[5] + 3, len(c)) END AS INTEGER) AS span_end FROM w"""
)
def prompted_codes(spark, d):
    codes = arrays.scaled_codes(F.transform("embedding", F.abs), 1000)
    e = read(spark, d, "embeddings").select("vec_id", codes.alias("codes"))
    return e.select("vec_id", arrays.with_prompt(F.slice("codes", 9, 56), F.slice("codes", 1, 8)).alias("p"), arrays.word_span(F.col("codes"), 0, 2, 3).alias("span")).select("vec_id", F.array_join(F.col("p.codes").cast("array<string>"), ",").alias("codes"), F.array_join(F.transform("p.mask", lambda x: F.when(x, "t").otherwise("f")), "").alias("mask"), F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"))


FRAMES_SQL = (
    WORDS_SQL
    + """, i AS (SELECT conv_id, w_start_ms / 1000.0::DOUBLE AS s, w_end_ms / 1000.0::DOUBLE AS e, list_transform(range(CAST(floor(least(length(word) / 3.0::DOUBLE, 3)) AS BIGINT) + 1), lambda x: CAST(unicode(word) + x AS INTEGER)) AS ids FROM words),
    o AS (SELECT conv_id, max(e) AS duration, CAST(ceil(max(e) * 12.5::DOUBLE) AS BIGINT) AS total FROM i GROUP BY conv_id),
    a AS (SELECT i.conv_id, s, e, ids, total, CAST(floor(s * 12.5::DOUBLE) AS BIGINT) AS a FROM i JOIN o ON i.conv_id = o.conv_id WHERE floor(s * 12.5::DOUBLE) < total)"""
)


@query(
    f"""WITH {FRAMES_SQL}, n AS (SELECT *, coalesce(lead(a) OVER w, total) AS b, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE a END AS f, CAST(trunc(e * 12.5::DOUBLE) AS BIGINT) AS until FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY s, e, ids)),
    p AS (SELECT *, unnest(range(f, b)) AS t FROM n), c AS (SELECT conv_id, t, CASE WHEN t >= a AND t - a < len(ids) THEN ids[t - a + 1] END AS token, CASE WHEN t >= a AND t <= until THEN 4 ELSE 3 END AS filler FROM p),
    m AS (SELECT conv_id, t, CASE WHEN lead(token) OVER (PARTITION BY conv_id ORDER BY t) IS NOT NULL AND coalesce(token, filler) IN (3, 4) THEN 0 ELSE coalesce(token, filler) END AS code FROM c)
    SELECT conv_id, any_value(duration) AS duration, string_agg(code, ',' ORDER BY t) AS codes FROM m JOIN o USING (conv_id) GROUP BY conv_id"""
)
def token_frames(spark, d):
    out = tokens.frame_layout(*_spoken_ids(spark, d), ["conv_id"], 12.5, 3, 0, in_word=4, zero=5)
    return out.withColumn("codes", F.array_join(F.col("codes").cast("array<string>"), ","))


def _spoken_ids(spark, d):
    """Words of conversations as ids with times in seconds, and the conversations' durations."""
    w = words(utterances(spark, d))
    ids = F.transform(F.sequence(F.lit(0), F.least(F.length("word") / 3, F.lit(3)).cast("int")), lambda i: (F.ascii("word") + i).cast("int"))
    said = w.select("conv_id", (F.col("w_start_ms") / 1000.0).alias("start"), (F.col("w_end_ms") / 1000.0).alias("end"), ids.alias("ids"))
    return said, said.groupBy("conv_id").agg(F.max("end").alias("duration"))


@query(
    f"""WITH {FRAMES_SQL}, q AS (SELECT conv_id, a, total, s, e, ids, unnest(ids) AS token, generate_subscripts(ids, 1) AS j FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s, e, ids, j) - 1 AS k FROM q),
    p AS (SELECT conv_id, token, total, k + max(a - k) OVER (PARTITION BY conv_id ORDER BY k) AS t FROM k)
    SELECT conv_id, count(*) AS n_tokens, CAST(sum(token * (t % 1000)) AS BIGINT) AS placed, CAST(max(t) AS BIGINT) AS last FROM p WHERE t < total GROUP BY conv_id"""
)
def queued_frames(spark, d):
    """Tokens that queue instead of replacing each other, told from padding by negative values."""
    out = tokens.frame_layout(*_spoken_ids(spark, d), ["conv_id"], 12.5, -1, -3, in_word=-2, replace=False)
    t = out.select("conv_id", F.posexplode("codes").alias("t", "token")).filter("token >= 0")
    return t.groupBy("conv_id").agg(F.count("*").alias("n_tokens"), F.sum(F.col("token").cast("long") * (F.col("t") % 1000)).alias("placed"), F.max("t").cast("long").alias("last"))


@query(
    f"""WITH {WORDS_SQL}, i AS (SELECT conv_id, w_start_ms / 1000.0::DOUBLE AS s, w_end_ms / 1000.0::DOUBLE AS e, list_transform(range(CAST(floor(least(length(word) / 3.0::DOUBLE, 3)) AS BIGINT) + 1), lambda x: CAST(unicode(word) + x AS INTEGER)) AS ids FROM words),
    o AS (SELECT conv_id, CAST(ceil(max(e) * 2) AS BIGINT) AS total, sum(len(ids)) AS n FROM i GROUP BY conv_id), q AS (SELECT conv_id, unnest(ids) AS token, generate_subscripts(ids, 1) AS j, s, e, ids FROM i),
    k AS (SELECT conv_id, token, row_number() OVER (PARTITION BY conv_id ORDER BY s, e, ids, j) - 1 AS k FROM q)
    SELECT conv_id, string_agg(token, ',' ORDER BY k) AS codes FROM k JOIN o USING (conv_id) WHERE n > total AND k < total GROUP BY conv_id"""
)
def crowded_frames(spark, d):
    """Conversations with more tokens than frames (two a second): the frames go to the first tokens, as no id is padding."""
    said, durations = _spoken_ids(spark, d)
    crowded = said.groupBy("conv_id").agg(F.sum(F.size("ids")).alias("n"), F.ceil(F.max("end") * 2).alias("total")).filter("n > total")
    out = tokens.frame_layout(said, durations, ["conv_id"], 2, -1, -3, adaptive=True).join(crowded, "conv_id", "left_semi")
    return out.select("conv_id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, len(props) > 2 AS filled FROM events")
def json_fields(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), (F.length("props") > 2).alias("filled"))


@query("SELECT doc_id, CASE WHEN n_chars / 10.0 < 60 THEN printf('%.1fs', n_chars / 10.0) WHEN n_chars / 10.0 < 3600 THEN printf('%.1fm', n_chars / 10.0 / 60) ELSE printf('%.1fh', n_chars / 10.0 / 3600) END AS duration FROM documents")
def formatted_durations(spark, d):
    return read(spark, d, "documents").select("doc_id", T.format_duration(F.col("n_chars") / 10.0).alias("duration"))


# statistics and synthesis --------------------------------------------------------------------------------


def _outcomes(spark, d):
    u = utterances(spark, d)
    v = speakers.validate(speakers.conversation_totals(u), 30.0, 150.0, 4, 3)
    return v.join(speakers.role_totals(speakers.assign_roles(u)).select("conv_id", "main_ms", "user_ms"), "conv_id")


OUTCOMES_SQL = (
    ROLES_SQL
    + """,
v AS (SELECT conv_id, max(end_ms) AS duration_ms, count(*) AS n_turns, count(DISTINCT speaker) AS n FROM utterances GROUP BY conv_id),
x AS (SELECT *, CASE WHEN duration_ms / 1000.0 < 30 OR duration_ms / 1000.0 > 150 OR n_turns < 4 THEN 'skipped' WHEN n < 3 THEN 'failed' ELSE 'valid' END AS outcome FROM v),
rt AS (SELECT conv_id, sum(CASE WHEN role = 'main' THEN total_ms ELSE 0 END) AS main_ms, sum(CASE WHEN role = 'main' THEN 0 ELSE total_ms END) AS user_ms FROM roles GROUP BY conv_id)"""
)


@query(
    f"""WITH {OUTCOMES_SQL}, a AS (SELECT count(*) AS total, count(*) FILTER (outcome = 'valid') AS processed, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed,
    round(coalesce(sum(duration_ms) FILTER (outcome = 'valid'), 0) / 3600000.0, 4) AS hours, round(coalesce(sum(main_ms) FILTER (outcome = 'valid'), 0) / 3600000.0, 4) AS main_hours, round(coalesce(sum(user_ms) FILTER (outcome = 'valid'), 0) / 3600000.0, 4) AS user_hours, 10.0 AS seconds FROM x JOIN rt ON x.conv_id = rt.conv_id)
    SELECT *, round(hours * 3600 / 10.0, 4) AS speed FROM a"""
)
def phase_statistics(spark, d):
    return statistics.phase_statistics(_outcomes(spark, d), 10.0)


@query(
    f"""WITH {OUTCOMES_SQL}, p AS (SELECT x.conv_id % 3 AS m, count(*) AS total, count(*) FILTER (outcome = 'valid') AS processed, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed,
    round(coalesce(sum(duration_ms) FILTER (outcome = 'valid'), 0) / 3600000.0, 4) AS hours, round(coalesce(sum(main_ms) FILTER (outcome = 'valid'), 0) / 3600000.0, 4) AS main_hours, round(coalesce(sum(user_ms) FILTER (outcome = 'valid'), 0) / 3600000.0, 4) AS user_hours, max(x.conv_id % 3) + 1.0 AS seconds FROM x JOIN rt ON x.conv_id = rt.conv_id GROUP BY 1)
    SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(failed) AS BIGINT) AS failed, round(sum(hours), 4) AS hours, round(sum(main_hours), 4) AS main_hours, round(sum(user_hours), 4) AS user_hours, max(seconds) AS seconds, round(round(sum(hours), 4) * 3600 / 3.0, 3) AS speed FROM p"""
)
def merged_statistics(spark, d):
    o = _outcomes(spark, d)
    parts = None
    for m in range(3):
        p = statistics.phase_statistics(o.filter(F.col("conv_id") % 3 == m), m + 1.0)
        parts = p if parts is None else parts.unionByName(p)
    out = statistics.merge(parts)
    return out.select("total", "processed", "skipped", "failed", *(F.round(c, 4).alias(c) for c in ("hours", "main_hours", "user_hours")), "seconds", F.round(F.round("hours", 4) * 3600 / 3.0, 3).alias("speed"))


@query(
    f"""WITH {MIGRATION_SQL}, p AS (SELECT conv_id, count(*) AS n, count(level) AS hit, count(*) FILTER (level = 1) AS l1, count(*) FILTER (level = 2) AS l2, count(*) FILTER (level = 3) AS l3, count(DISTINCT matched_speaker) AS s,
      count(*) FILTER (level IS NOT NULL AND matched_speaker IS DISTINCT FROM was) AS up, count(*) FILTER (level IS NOT NULL AND matched_speaker IS NULL) AS un FROM (SELECT m.*, CASE WHEN pos % 3 = 0 THEN 'old' ELSE matched_speaker END AS was FROM migrated m) GROUP BY conv_id),
    t AS (SELECT count(*) AS files, count(*) FILTER (up > 0) AS files_updated, count(*) FILTER (hit = n) AS files_whole, count(*) FILTER (hit = 0) AS files_unmatched, CAST(sum(n) AS BIGINT) AS segments, CAST(sum(l1) AS BIGINT) AS exact, CAST(sum(l2) AS BIGINT) AS near,
      CAST(sum(l3) AS BIGINT) AS far, CAST(sum(n - hit) AS BIGINT) AS unmatched, CAST(sum(up) AS BIGINT) AS updated, CAST(sum(un) AS BIGINT) AS unnamed, max(s) AS max_speakers, count(*) FILTER (s > 1) AS multi_speaker FROM p)
    SELECT *, round(100 * (segments - unmatched) / segments, 4) AS match_rate, round(100 * updated / segments, 4) AS update_rate FROM t"""
)
def migration_statistics(spark, d):
    u = utterances(spark, d)
    m = segments.tolerance_join(u.select("conv_id", "pos", "start_ms", "end_ms"), _diarized(u))
    return statistics.migration_statistics(m.withColumn("speaker", F.when(F.col("pos") % 3 == 0, "old").otherwise(F.col("matched_speaker"))))


@query(
    f"""WITH {WORDS_SQL}, {ROLES_SQL.removeprefix(UTTERANCES_SQL + ',')} SELECT w.conv_id, w.speaker, count(*) AS n_words, CAST(sum(w_end_ms - w_start_ms) AS BIGINT) AS speech_ms, min(role) AS first_role
    FROM words w JOIN roles r ON w.conv_id = r.conv_id AND w.speaker = r.speaker GROUP BY ALL"""
)
def speaker_word_statistics(spark, d):
    u = utterances(spark, d)
    w = words(u).join(speakers.assign_roles(u).select("conv_id", "speaker", "role"), ["conv_id", "speaker"]).withColumnRenamed("speaker", "original")
    return statistics.speaker_word_statistics(w)


@query("WITH k AS (SELECT l_returnflag AS speaker, l_linestatus AS kind, avg(l_discount) AS mean FROM lineitem GROUP BY ALL) SELECT speaker, round(sum(CASE kind WHEN 'O' THEN 2.0 WHEN 'F' THEN 0.5 ELSE 0 END * mean), 6) AS loss FROM k GROUP BY speaker")
def two_speaker_loss(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("speaker"), F.col("l_linestatus").alias("kind"), F.col("l_discount").alias("loss"))
    out = statistics.two_speaker_loss(rows, {"O": 2.0, "F": 0.5})
    return out.select("speaker", F.round("loss", 6).alias("loss"))


@query(
    f"""WITH {WORDS_SQL}, l AS (SELECT conv_id, turn, count(*) * 4 AS n_tokens, CAST(ceil((max(w_end_ms) - min(w_start_ms)) / 1000.0 * 12.5) AS BIGINT) AS n_frames FROM words GROUP BY ALL)
    SELECT count(*) AS windows, count(*) FILTER (n_tokens > n_frames) AS overflowing, CAST(sum(greatest(n_tokens - n_frames, 0)) AS BIGINT) AS lost_tokens, max(greatest(n_tokens - n_frames, 0)) AS most_lost FROM l"""
)
def overflow_statistics(spark, d):
    w = words(utterances(spark, d)).groupBy("conv_id", "turn").agg((F.count("*") * 4).alias("n_tokens"), F.ceil((F.max("w_end_ms") - F.min("w_start_ms")) / 1000.0 * 12.5).alias("n_frames"))
    return statistics.overflow_statistics(w)


@query("SELECT event_id, round((event_id % 80) / greatest(event_id % 100, 1), 6) AS real_share, round(100.0 * event_id / 1000, 6) AS percent_done, round(event_id * 1048576.0 / 1073741824.0, 6) AS gb FROM events")
def training_columns(spark, d):
    e = read(spark, d, "events").select("event_id", (F.col("event_id") % 80).alias("real_tokens"), (F.col("event_id") % 100).alias("tokens"), F.col("event_id").alias("step"), F.lit(1000).alias("max_steps"), (F.col("event_id") * 1048576).alias("bytes"))
    return statistics.training_columns(e).select("event_id", *(F.round(c, 6).alias(c) for c in ("real_share", "percent_done", "gb")))


@query("SELECT count(*) AS duplicates, (SELECT list(t ORDER BY t) FROM (SELECT text AS t FROM (SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1 ORDER BY n DESC, text LIMIT 5))) AS examples FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_report(spark, d):
    out = statistics.duplicate_report(read(spark, d, "documents"), "text")
    return out.select("duplicates", F.array_sort("examples").alias("examples"))


@query(
    f"""WITH {PAIRS_SQL}, t AS (SELECT id // 1000 AS item, id AS take, round(levenshtein(ref, hyp) / greatest(length(ref), 1), 6) AS wer FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY wer, take) AS r FROM t)
    SELECT item, take, wer FROM r WHERE r = 1 AND wer <= 0.75"""
)
def best_takes(spark, d):
    t = _pairs(spark, d).select(F.expr("id div 1000").alias("item"), F.col("id").alias("take"), F.round(F.levenshtein("ref", "hyp") / F.greatest(F.length("ref"), F.lit(1)), 6).alias("wer"))
    return synthesis.best_take(t, F.lit(0.75))


def _timed(spark, d):
    return synthesis.turn_times(utterances(spark, d).select("conv_id", F.col("turn").alias("pos"), "speaker", (F.col("dur_ms") / 1000.0).alias("dur")), 21)


def _share(seed: int, more: str = "pos") -> str:
    return SHARE_SQL.format(f"'{seed}:' || conv_id || ':' || {more}")


def _normal(seed: int, mean: float, deviation: float) -> str:
    return f"({mean} + {deviation} * sqrt(-2 * ln(greatest({_share(seed)}, 1 / 8589934592.0))) * cos(2 * pi() * {_share(seed + 1)}))"


TIMED_SQL = f"""t0 AS (SELECT conv_id, turn AS pos, role AS speaker, CAST((200 + 40 * length(text)) AS DOUBLE) / 1000.0 AS dur FROM conversations),
t1 AS (SELECT *, lag(speaker) OVER (PARTITION BY conv_id ORDER BY pos) = speaker AS same FROM t0),
t2 AS (SELECT *, CASE WHEN pos = 0 THEN 0.0 WHEN same THEN abs({_normal(27, 0.3, 0.1)}) WHEN {_share(21)} < 0.35 THEN -abs({_normal(23, 0.3, 0.15)}) ELSE exp({_normal(25, -0.9, 0.4)}) END AS gap FROM t1),
t3 AS (SELECT *, sum(gap + dur) OVER (PARTITION BY conv_id ORDER BY pos) AS e FROM t2), timed AS (SELECT conv_id, pos, dur, greatest(e - dur, 0.0) AS s, greatest(e - dur, 0.0) + dur AS e FROM t3)"""


@query(f'WITH {TIMED_SQL} SELECT conv_id, pos, round(s, 6) AS start, round(e, 6) AS "end" FROM timed')
def synthetic_turn_times(spark, d):
    return _timed(spark, d).select("conv_id", "pos", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(
    f"""WITH {TIMED_SQL}, b AS (SELECT conv_id, pos, e, s + 0.5 + 1.5 * {_share(32)} AS t, CASE WHEN {_share(33)} < 3 / 6.0 THEN 'yes' WHEN {_share(33)} < 5 / 6.0 THEN 'mm' ELSE 'right' END AS token FROM timed WHERE dur >= 2.0 AND {_share(31)} < 0.25)
    SELECT conv_id, pos, round(t, 6) AS "at", token FROM b WHERE t < e - 0.5"""
)
def synthetic_backchannels(spark, d):
    return synthesis.backchannels(_timed(spark, d), {"yes": 3.0, "mm": 2.0, "right": 1.0}, 31).withColumn("at", F.round("at", 6))


@query(
    f"""WITH {UTTERANCES_SQL}, b AS (SELECT a.conv_id, count(*) FILTER (a.speaker = 'assistant') AS det, count(*) FILTER (a.speaker = 'user') AS tru FROM utterances a GROUP BY a.conv_id),
    m AS (SELECT a.conv_id, count(*) AS hit FROM utterances a WHERE speaker = 'assistant' AND EXISTS (SELECT 1 FROM utterances b WHERE b.speaker = 'user' AND b.conv_id = a.conv_id AND (abs(a.start_ms - b.start_ms) <= 4000 OR abs(a.end_ms - b.end_ms) <= 4000 OR (b.start_ms <= a.start_ms AND a.end_ms <= b.end_ms))) GROUP BY a.conv_id),
    s AS (SELECT CASE WHEN det > 0 THEN coalesce(hit, 0) / det ELSE 0 END AS p, CASE WHEN tru > 0 THEN coalesce(hit, 0) / tru ELSE 0 END AS r FROM b LEFT JOIN m ON b.conv_id = m.conv_id), a AS (SELECT avg(p) AS p, avg(r) AS r FROM s)
    SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM a"""
)
def alignment_monitor(spark, d):
    u = utterances(spark, d)
    a, b = u.filter("speaker = 'assistant'"), u.filter("speaker = 'user'")
    n = u.groupBy("conv_id").agg(F.count_if(F.col("speaker") == "assistant").alias("det"), F.count_if(F.col("speaker") == "user").alias("tru"))
    hit = segments.boundary_matches(a, b, 4000).groupBy("conv_id").agg(F.count("*").alias("hit"))
    j = n.join(hit, "conv_id", "left").na.fill({"hit": 0})
    p, r, _ = metrics.match_scores(F.col("hit"), F.col("det"), F.col("tru"))
    return statistics.monitor_summary(j.select(p.alias("precision"), r.alias("recall")))


@query(
    f"""WITH {UTTERANCES_SQL}, g AS (SELECT conv_id, count(*) FILTER (speaker = 'assistant') AS m, count(*) FILTER (speaker = 'user') AS u, max(end_ms) AS d, sum(dur_ms) AS s FROM utterances GROUP BY conv_id),
    o AS (SELECT a.conv_id, sum(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) AS ov FROM utterances a JOIN utterances b ON a.conv_id = b.conv_id AND a.pos < b.pos AND b.start_ms < a.end_ms AND a.speaker <> b.speaker WHERE least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms) GROUP BY a.conv_id),
    r AS (SELECT g.conv_id, m, u, coalesce(ov, 0) / d AS o, greatest(0.0, (d - s + coalesce(ov, 0)) / d) AS q FROM g LEFT JOIN o ON g.conv_id = o.conv_id)
    SELECT conv_id, round(list_avg(list_filter([1 - least(abs(o - 0.1), 0.3) / 0.3, CASE WHEN q < 0.2 THEN q / 0.2 WHEN q <= 0.4 THEN 1.0 ELSE greatest(0.0, 1 - (q - 0.4) / 0.4) END, CASE WHEN m + u > 0 THEN greatest(0.0, 1 - abs(m / (m + u) - 0.5) * 2) END, CASE WHEN m > 0 THEN 1.0 END], lambda x: x IS NOT NULL)), 6) AS score FROM r"""
)
def turn_taking_scores(spark, d):
    u = utterances(spark, d)
    g = u.groupBy("conv_id").agg(F.count_if(F.col("speaker") == "assistant").alias("m"), F.count_if(F.col("speaker") == "user").alias("u"), F.max("end_ms").alias("d"), F.sum("dur_ms").alias("s"))
    j = g.join(speakers.overlap_summary(speakers.overlap_pairs(u)).select("conv_id", "overlap_ms"), "conv_id", "left").na.fill({"overlap_ms": 0})
    silence = F.greatest(F.lit(0.0), (F.col("d") - F.col("s") + F.col("overlap_ms")) / F.col("d"))
    score = metrics.turn_taking_score(F.col("overlap_ms") / F.col("d"), silence, F.lit(None).cast("double"), F.col("m"), F.col("u"), F.lit(0))
    return j.select("conv_id", F.round(score, 6).alias("score"))


# long audio, token times, tokenizer tables, voices -------------------------------------------------------


@query(
    f"""WITH RECURSIVE {WORDS_SQL}, a AS (SELECT conv_id, CAST(max(end_ms) AS DOUBLE) AS duration, list_sort(list(CAST(end_ms AS DOUBLE))) AS cuts FROM utterances GROUP BY conv_id),
    t AS (SELECT conv_id, list(word ORDER BY turn, k) AS words FROM words GROUP BY conv_id),
    c AS (SELECT conv_id, duration, cuts, 0.0::DOUBLE AS x0 FROM a UNION ALL SELECT conv_id, duration, cuts, list_min(list_filter(cuts, lambda x: x - x0 >= 0.8 * 20000)) FROM c WHERE duration > 20000 AND len(list_filter(cuts, lambda x: x - x0 >= 0.8 * 20000)) > 0),
    b AS (SELECT conv_id, duration, x0 FROM c UNION SELECT conv_id, duration, duration FROM a),
    g AS (SELECT conv_id, duration, x0, lead(x0) OVER (PARTITION BY conv_id ORDER BY x0) - x0 AS len FROM b),
    h AS (SELECT conv_id, duration, x0, len, CAST(greatest(ceil(CASE WHEN duration > 20000 THEN len / 20000 ELSE 1 END), 1) AS BIGINT) AS n FROM g WHERE len IS NOT NULL),
    p AS (SELECT conv_id, duration, x0 + len / n * j AS s FROM (SELECT *, unnest(range(n)) AS j FROM h)),
    q AS (SELECT conv_id, duration, s, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(lead(s) OVER w, duration) AS e FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY s)),
    r AS (SELECT q.conv_id, k, s, e, CASE WHEN n = 1 THEN words ELSE words[CAST(floor(k * len(words) / n) AS BIGINT) + 1:CAST(floor(k * len(words) / n) AS BIGINT) + CAST(greatest(floor(len(words) * ((e - s) / duration)), 1) AS BIGINT)] END AS w FROM q JOIN t ON q.conv_id = t.conv_id)
    SELECT conv_id, k, round(s, 4) AS start, round(e, 4) AS "end", array_to_string(w, ' ') AS text FROM r WHERE len(w) > 0"""
)
def long_audio_parts(spark, d):
    u = utterances(spark, d)
    a = u.groupBy("conv_id").agg(F.max("end_ms").alias("duration"), F.collect_list("end_ms").alias("cuts"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "k", "word"))), lambda x: x["word"])
    p = segments.split_long(a.join(words(u).groupBy("conv_id").agg(said.alias("words")), "conv_id"), ["conv_id"], 20_000)
    return p.select("conv_id", F.col("k").cast("long").alias("k"), F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), F.array_join("words", " ").alias("text"))


@query(
    f"""WITH {SIGNAL_SQL}, q AS (SELECT vec_id, frame, CAST(v AS DOUBLE) * v < 0.1 * max(CAST(v AS DOUBLE) * v) OVER (PARTITION BY vec_id) AS quiet FROM s), a AS (SELECT vec_id, frame, frame - row_number() OVER (PARTITION BY vec_id ORDER BY frame) AS g FROM q WHERE quiet)
    SELECT vec_id, CAST((min(frame) + max(frame) + 1) // 2 AS BIGINT) AS centre FROM a GROUP BY vec_id, g HAVING count(*) >= 3"""
)
def silence_points(spark, d):
    f = _frames(spark, d).withColumn("energy", F.col("v").cast("double") * F.col("v"))
    return segments.silence_points(f, ["vec_id"], 0.1, 3).select("vec_id", "centre")


@query(
    f"""WITH {WORDS_SQL}, c AS (SELECT conv_id, turn, k, unnest(range(length(word))) AS i, length(word) AS n, w_start_ms, w_end_ms, word FROM words),
    t AS (SELECT conv_id, turn, k, i // 3 AS part, string_agg(substr(word, CAST(i + 1 AS BIGINT), 1), '' ORDER BY i) AS token, min(w_start_ms + i * ((w_end_ms - w_start_ms) / n)) AS s, max(w_start_ms + (i + 1) * ((w_end_ms - w_start_ms) / n)) AS e FROM c GROUP BY ALL)
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k, part) AS t, token, round(s, 4) AS start, round(e, 4) AS "end" FROM t"""
)
def token_times(spark, d):
    w = words(utterances(spark, d))
    parts = w.select("conv_id", "turn", "k", F.posexplode(F.regexp_extract_all("word", F.lit("(?s).{1,3}"), F.lit(0))).alias("part", "token"))
    t = parts.withColumn("t", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("k", "part")).cast("long"))
    out = segments.token_times(segments.split_chars(w), t.select("conv_id", "turn", "t", "token"), ["conv_id", "turn"], ("k", "i"))
    return out.select("conv_id", "turn", "t", "token", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query(
    f"""WITH {UTTERANCES_SQL}, b AS (SELECT conv_id, count(*) FILTER (speaker = 'assistant') AS det, count(*) FILTER (speaker = 'user') AS tru, max(end_ms) / 80.0 AS frames, avg(abs(gap)) / 80.0 AS error FROM (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM utterances) GROUP BY conv_id),
    m AS (SELECT a.conv_id, count(*) AS hit FROM utterances a WHERE speaker = 'assistant' AND EXISTS (SELECT 1 FROM utterances b WHERE b.speaker = 'user' AND b.conv_id = a.conv_id AND (abs(a.start_ms - b.start_ms) <= 4000 OR abs(a.end_ms - b.end_ms) <= 4000 OR (b.start_ms <= a.start_ms AND a.end_ms <= b.end_ms))) GROUP BY a.conv_id),
    n AS (SELECT conv_id, sum(len(list_filter(string_split(regexp_replace(trim(text, ' \t\r\n'), '[ \t\r\n]+', ' ', 'g'), ' '), lambda x: x <> ''))) AS words FROM utterances GROUP BY conv_id),
    s AS (SELECT b.conv_id, coalesce(error, 0) AS error, words / frames AS cover, CASE WHEN det > 0 THEN coalesce(hit, 0) / det ELSE 0 END AS p, CASE WHEN tru > 0 THEN coalesce(hit, 0) / tru ELSE 0 END AS r FROM b LEFT JOIN m ON b.conv_id = m.conv_id JOIN n ON n.conv_id = b.conv_id)
    SELECT conv_id, round(0.4 * greatest(0.0, 1 - error / 10) + 0.4 * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END + 0.2 * greatest(0.0, 1 - abs(cover - 0.4) * 2), 6) AS sync FROM s"""
)
def sync_scores(spark, d):
    """The timing error is the mean pause or overlap between turns, the coverage words a frame of 80 ms."""
    u = utterances(spark, d)
    said = u.withColumn("gap", F.col("start_ms") - F.lag("end_ms").over(Window.partitionBy("conv_id").orderBy("turn")))
    n = said.groupBy("conv_id").agg(F.count_if(F.col("speaker") == "assistant").alias("det"), F.count_if(F.col("speaker") == "user").alias("tru"), (F.max("end_ms") / 80.0).alias("frames"), F.coalesce(F.avg(F.abs("gap")) / 80.0, F.lit(0.0)).alias("error"), F.sum(F.size(T.word_array("text"))).alias("words"))
    hit = segments.boundary_matches(u.filter("speaker = 'assistant'"), u.filter("speaker = 'user'"), 4000).groupBy("conv_id").agg(F.count("*").alias("hit"))
    j = n.join(hit, "conv_id", "left").na.fill({"hit": 0})
    f1 = metrics.match_scores(F.col("hit"), F.col("det"), F.col("tru"))[2]
    return j.select("conv_id", F.round(metrics.sync_score(F.col("error"), f1, F.col("words") / F.col("frames")), 6).alias("sync"))


@query(
    """WITH o AS (SELECT unnest(list_distinct(regexp_extract_all(hex(encode(text)), '..'))) AS o FROM documents), n AS (SELECT CAST('0x' || o AS BIGINT) AS byte, count(*) AS n_docs FROM o GROUP BY o),
    b AS (SELECT CAST(range AS BIGINT) AS byte, range BETWEEN 33 AND 126 OR range BETWEEN 161 AND 172 OR range BETWEEN 174 AND 255 AS own FROM range(256)),
    l AS (SELECT byte, CASE WHEN own THEN chr(CAST(byte AS INTEGER)) ELSE chr(CAST(255 + row_number() OVER (PARTITION BY own ORDER BY byte) AS INTEGER)) END AS letter, '<0x' || printf('%02X', byte) || '>' AS piece FROM b)
    SELECT byte, n_docs, letter, piece FROM l JOIN n USING (byte)"""
)
def byte_letters(spark, d):
    """The letters of all bytes that documents hold, with the number of documents of each."""
    octets = F.array_distinct(F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit(".."), F.lit(0)))
    n = read(spark, d, "documents").select(F.explode(octets).alias("o")).groupBy("o").agg(F.count("*").alias("n_docs"))
    b = n.select(F.conv("o", 16, 10).cast("long").alias("byte"), "n_docs")
    return b.select("byte", "n_docs", tokens.byte_letter(F.col("byte")).alias("letter"), tokens.letter_byte(tokens.byte_letter(F.col("byte"))).alias("piece"))


WORD_TABLE_SQL = "v AS (SELECT role, unnest(string_split(text, ' ')) AS w FROM conversations), n AS (SELECT w AS token, bool_or(role = 'assistant') AS merged FROM v GROUP BY w)"


@query(
    f"""WITH {WORD_TABLE_SQL}, o AS (SELECT token, row_number() OVER (ORDER BY token COLLATE "C") - 1 AS r FROM n WHERE merged AND length(token) > 1),
    m AS (SELECT token, 2 * r + s AS rank FROM o, (SELECT unnest([0, 1]) AS s)), k AS (SELECT token, max(rank) AS rank FROM m GROUP BY token)
    SELECT n.token, CASE WHEN rank IS NULL THEN 0.0 ELSE -CAST((SELECT count(*) FROM m) - rank AS DOUBLE) END AS score,
    CASE WHEN regexp_full_match(n.token, '<0x[0-9A-Fa-f]{{2}}>') OR (length(n.token) = 1 AND (unicode(n.token) BETWEEN 33 AND 126 OR unicode(n.token) BETWEEN 161 AND 172 OR unicode(n.token) BETWEEN 174 AND 323)) THEN 'byte' WHEN regexp_matches(n.token, '^<.*>$') THEN 'special' WHEN regexp_matches(n.token, '^[▁Ġ]') THEN 'space' ELSE 'plain' END AS kind FROM n LEFT JOIN k ON n.token = k.token"""
)
def merge_scores(spark, d):
    """Words as a vocabulary; those an assistant says have two merges each, the later of which counts."""
    v = read(spark, d, "conversations").select("role", F.explode(F.split("text", " ")).alias("token"))
    n = v.groupBy("token").agg(F.bool_or(F.col("role") == "assistant").alias("merged"))
    ranked = manifest.global_rank(n.filter("merged AND length(token) > 1").select("token"), [F.col("token").asc()])
    both = ranked.select("token", F.explode(F.array(F.lit(0), F.lit(1))).alias("s"), "rank")
    cut = F.when(F.col("s") == 0, F.lit(1)).otherwise(F.length("token") - 1)
    m = both.select(F.substr("token", F.lit(1), cut).alias("left"), F.substr("token", cut + 1).alias("right"), (2 * F.col("rank") + F.col("s")).alias("rank"))
    return tokens.merge_scores(n.select("token"), m).select("token", "score", tokens.token_class().alias("kind"))


@query("SELECT conv_id * 1000 + turn AS id, len(string_split(text, ' ')) AS n_a, length(text) AS n_b, len(string_split(text, ' ')) - length(text) AS difference FROM conversations")
def tokenizer_comparison(spark, d):
    c = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    out = tokens.compare_tokenizers(c.select("id", F.split("text", " ").alias("tokens")), c.select("id", F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)).alias("tokens")))
    return out.select("id", *(F.col(x).cast("long").alias(x) for x in ("n_a", "n_b", "difference")))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings),
    s AS (SELECT vec_id, a, list_max(list_transform(a, lambda x: abs(x))) AS top, sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)) AS rms, list_sum(list_transform(a[1:32], lambda x: x * x)) / 32 AS p, list_sum(list_transform(a[33:], lambda x: x * x)) / (len(a) - 32) AS n FROM e)
    SELECT vec_id, round(list_sum(list_transform(range(len(a)), lambda i: (i + 1) * greatest(-1.0, least(1.0, a[i + 1] * (0.95 / top) * (pow(10, -23.0 / 20) / (rms * 0.95 / top)))))), 5) AS levelled, round(10 * log10(p / n), 4) AS snr,
    round(list_sum(list_transform(range(len(a)), lambda i: CASE WHEN (i >= 4 AND i < 12) OR (i >= 40 AND i < 48) THEN a[i + 1] ELSE 0 END)), 6) AS kept,
    round(list_sum(list_transform(range(32), lambda i: (a[i + 1] + a[i + 33]) / 2)), 6) AS mono_sum,
    CAST(CASE WHEN vec_id % 20 > 8 THEN 1 ELSE 0 END + CASE WHEN len(a) - vec_id % 20 - 30 > 8 THEN 1 ELSE 0 END AS INTEGER) AS free FROM s"""
)
def prepared_voices(spark, d):
    a = F.col("embedding").cast("array<double>")
    spans = F.array(*(F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in ((1.0, 3.0), (10.0, 12.0))))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    start = (F.col("vec_id") % 20).cast("int")
    free = arrays.free_regions(F.size(a), start, start + 30, 8)
    return read(spark, d, "embeddings").select(
        "vec_id",
        F.round(total(F.transform(arrays.loudness_normalised(a), lambda x, i: (i + 1) * x)), 5).alias("levelled"),
        F.round(arrays.signal_to_noise(F.slice(a, 1, 32), F.slice(a, 33, 1000)), 4).alias("snr"),
        F.round(total(arrays.masked(a, spans, 4.0)), 6).alias("kept"),
        F.round(total(arrays.mono(F.slice(a, 1, 32), F.slice(a, 33, 32))), 6).alias("mono_sum"),
        F.size(free).alias("free"),
    )


@query("WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(x * 1000) AS INTEGER)) AS c FROM embeddings) SELECT vec_id, array_to_string(c[1:16], ',') || ';' || array_to_string(c[17:32], ',') || ';' || array_to_string(c[33:48], ',') || ';' || array_to_string(c[49:64], ',') || repeat(';' || array_to_string(list_transform(c[1:16], lambda x: -1), ','), 2) AS books FROM c")
def padded_codebooks(spark, d):
    codes = arrays.scaled_codes(F.col("embedding"), 1000)
    books = arrays.pad_codebooks(F.array(*(F.slice(codes, 16 * k + 1, 16) for k in range(4))), 6, -1)
    return read(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(books, lambda b: F.array_join(b.cast("array<string>"), ",")), ";").alias("books"))


@query("SELECT vec_id, round(-list_sum(list_transform(e, lambda x: x / s * ln(x / s + 1e-10))), 5) AS entropy FROM (SELECT vec_id, e, list_sum(e) AS s FROM (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))) AS e FROM embeddings))")
def signal_entropy(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(metrics.entropy(F.col("embedding").cast("array<double>")), 5).alias("entropy"))


@query("SELECT count(*) AS n, count(*) FILTER (value > 50) AS aligned, CAST(sum(event_id % 97) AS BIGINT) AS words, round(avg(value) FILTER (value > 50), 6) AS mean_quality FROM events")
def alignment_statistics(spark, d):
    return statistics.alignment_statistics(_log(spark, d).select((F.col("value") > 50).alias("aligned"), (F.col("event_id") % 97).alias("words"), F.col("value").alias("quality")))


@query(f"WITH {UTTERANCES_SQL} SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'no_text' WHEN end_ms <= start_ms THEN 'no_time' WHEN start_ms < 0 THEN 'negative' WHEN end_ms > 60000 THEN 'beyond_audio' END AS error FROM utterances")
def segment_errors(spark, d):
    return utterances(spark, d).select("conv_id", "turn", statistics.segment_error(F.lit(60_000), F.col("start_ms"), F.col("end_ms"), F.col("text")).alias("error"))


@query("SELECT page_id, url FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 <> 0 AND length(html) >= 1000")
def pages_to_do(spark, d):
    p = read(spark, d, "pages").select("page_id", "url", F.col("page_id").alias("path"), F.length("html").alias("size"))
    return filters.skip_existing(p, p.filter("page_id % 3 = 0").select("path"), p.filter("page_id % 5 = 0").select("path")).select("page_id", "url")
