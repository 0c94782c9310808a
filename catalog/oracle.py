"""The registered queries in plain SQL, written independently of the operators.

Rank pairs are formed by self-joins here, sequence numbers by one window, and so on: the point is
to say what the result is, not how to get it at scale.
"""

from __future__ import annotations

from prefdeck.functions.prompts import JUDGE_STYLES

SEED_EPOCH, BATCH, MAX_TOKENS = 8, 16, 60

# --- shared views -------------------------------------------------------------------------------

LINES = """
lines AS (
  SELECT 'status_' || o_orderstatus AS origin, o_orderpriority AS category,
         l_orderkey AS input_id, CAST(l_linenumber - 1 AS INTEGER) AS output_id,
         CAST(floor((l_quantity - 1) / 10) AS INTEGER) + 1 AS rank,
         l_extendedprice / 10000.0 AS reward, l_discount AS reward_tied,
         l_partkey, l_suppkey, l_extendedprice, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

SAMPLES = (
    LINES
    + """,
samples AS (
  SELECT origin, category, input_id, output_id, rank, reward, reward_tied FROM (
    SELECT *, row_number() OVER (PARTITION BY input_id, output_id
      ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_shipdate DESC) AS rn
    FROM lines) WHERE rn = 1)"""
)

VOTES = (
    SAMPLES
    + """,
votes AS (
  SELECT a.origin, a.input_id,
         CASE WHEN a.rank < b.rank THEN a.output_id ELSE b.output_id END AS chosen_id,
         CASE WHEN a.rank < b.rank THEN b.output_id ELSE a.output_id END AS rejected_id
  FROM lines a JOIN lines b
    ON a.input_id = b.input_id AND b.output_id = a.output_id + 1 AND a.rank <> b.rank),
dvotes AS (SELECT DISTINCT * FROM votes)"""
)

PAIRS = (
    VOTES
    + """,
pairs AS (
  SELECT v.origin, c.category, v.input_id, v.chosen_id, v.rejected_id,
         c.reward AS chosen_reward, r.reward AS rejected_reward
  FROM dvotes v
  JOIN samples c ON c.input_id = v.input_id AND c.output_id = v.chosen_id
  JOIN samples r ON r.input_id = v.input_id AND r.output_id = v.rejected_id)"""
)


def rank_views(source: str, reward: str) -> str:
    """All comparable pairs of a source with a unique row number, and per-prompt counts."""
    return f"""
numbered AS (
  SELECT origin, category, input_id, rank, {reward} AS reward,
         row_number() OVER (PARTITION BY input_id ORDER BY rank) AS n FROM {source}),
cmp AS (
  SELECT a.origin, a.category, a.input_id, a.reward AS better, b.reward AS worse
  FROM numbered a JOIN numbered b
    ON a.input_id = b.input_id AND a.n < b.n AND a.rank < b.rank),
per_prompt AS (
  SELECT origin, category, input_id, count(*) AS n_pairs,
         sum(CASE WHEN better > worse THEN 1 ELSE 0 END) AS n_c,
         sum(CASE WHEN better < worse THEN 1 ELSE 0 END) AS n_d
  FROM cmp GROUP BY ALL),
counts AS (
  SELECT s.origin, s.category, s.input_id, CAST(s.n AS BIGINT) AS n_responses,
         CAST(coalesce(p.n_pairs, 0) AS BIGINT) AS n_pairs,
         CAST(coalesce(p.n_c, 0) AS BIGINT) AS n_concordant,
         CAST(coalesce(p.n_d, 0) AS BIGINT) AS n_discordant
  FROM (SELECT origin, category, input_id, count(*) AS n FROM numbered GROUP BY ALL) s
  LEFT JOIN per_prompt p USING (origin, category, input_id))"""


TIED = LINES + "," + rank_views("lines", "reward_tied")

_SCORER_ROWS = """
  SELECT {by}, 'reward_mean' AS metric, avg({reward}) AS value FROM {source} GROUP BY {by}
  UNION ALL SELECT {by}, 'reward_std', stddev_samp({reward}) FROM {source} GROUP BY {by}
  UNION ALL SELECT {by}, 'accuracy-rank',
    sum(n_concordant) / CAST(nullif(sum(n_pairs), 0) AS DOUBLE) FROM counts GROUP BY {by}
  UNION ALL SELECT {by}, 'exact_match-rank',
    avg(CASE WHEN n_discordant = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM counts GROUP BY {by}"""

_PAIR_ROWS = """
  UNION ALL SELECT {by}, 'accuracy-labels',
    avg(CASE WHEN chosen_reward > rejected_reward THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    FROM pairs GROUP BY {by}
  UNION ALL SELECT {by}, 'chosen_reward_mean-labels', avg(chosen_reward) FROM pairs GROUP BY {by}
  UNION ALL SELECT {by}, 'chosen_reward_std-labels', stddev_samp(chosen_reward)
    FROM pairs GROUP BY {by}
  UNION ALL SELECT {by}, 'rejected_reward_mean-labels', avg(rejected_reward) FROM pairs GROUP BY {by}
  UNION ALL SELECT {by}, 'rejected_reward_std-labels', stddev_samp(rejected_reward)
    FROM pairs GROUP BY {by}
  UNION ALL SELECT {by}, 'reward_diverge_mean-labels', avg(chosen_reward - rejected_reward)
    FROM pairs GROUP BY {by}
  UNION ALL SELECT {by}, 'reward_diverge_std-labels', stddev_samp(chosen_reward - rejected_reward)
    FROM pairs GROUP BY {by}
  UNION ALL SELECT {by}, 'expectation_calibration_error-labels', ece FROM ece"""


def ece_views(by: str) -> str:
    """Five equal-width bins per group, and their weighted calibration gap."""
    return f"""
diffs AS (
  SELECT {by}, abs(chosen_reward - rejected_reward) AS diff,
         CASE WHEN chosen_reward >= rejected_reward THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit
  FROM pairs),
steps AS (SELECT {by}, max(diff) / 5 AS step FROM diffs GROUP BY {by}),
curve AS (
  SELECT {by}, CAST(i AS INTEGER) AS bin, avg(hit) AS accuracy, avg(diff) AS mean_diff,
         count(*) AS n_pairs
  FROM diffs JOIN steps USING ({by}), range(5) t(i)
  WHERE diff >= step * i AND diff < step * (i + 1) GROUP BY ALL),
ece AS (
  SELECT {by}, sum(abs(accuracy - 1 / (1 + exp(-mean_diff))) * n_pairs) / sum(n_pairs) AS ece
  FROM curve GROUP BY {by})"""


RECORDS = """
ranked AS (
  SELECT d.doc_id, d.lang, d.source, d.text,
         1 + (1 - coalesce(l.quality, 0)) + coalesce(l.toxic, 0) AS r
  FROM documents d LEFT JOIN labels l USING (doc_id)),
rec AS (
  SELECT x.doc_id, x.lang || '/' || x.source || '/' || CAST(x.doc_id // 1000 AS VARCHAR) AS p,
         x.doc_id % 4 AS shape, x.lang, x.text AS a, coalesce(y.text, x.text) AS b,
         md5(x.text) AS id_a, md5(coalesce(y.text, x.text)) AS id_b,
         x.r AS rank_a, coalesce(y.r, x.r) AS rank_b,
         CASE WHEN x.doc_id % 3 = 0 THEN 'source ' || x.source END AS sys_prompt,
         CASE WHEN x.doc_id % 50 = 0 THEN '3'
              WHEN substr(md5(CAST(x.doc_id AS VARCHAR)), 1, 1) < '8' THEN '1' ELSE '2' END AS vote
  FROM ranked x LEFT JOIN ranked y ON y.doc_id = x.doc_id + 1),
mention AS (
  SELECT p, id_a AS rid, a AS output, doc_id, 0 AS sub FROM rec WHERE shape < 3
  UNION ALL SELECT p, id_b, b, doc_id, 1 FROM rec WHERE shape < 3),
resp AS (
  SELECT p, rid, min(doc_id * 2 + sub) AS first_at, arg_max(output, doc_id * 2 + sub) AS output,
         count(*) AS n_mentions FROM mention GROUP BY p, rid),
ann AS (
  SELECT p, doc_id, CASE WHEN vote = '2' THEN id_b ELSE id_a END AS id_1,
         CASE WHEN vote = '2' THEN id_a ELSE id_b END AS id_2, '1' AS preference
  FROM rec WHERE shape < 2 AND vote IN ('1', '2')
  UNION ALL SELECT p, doc_id, id_a, id_b, vote FROM rec WHERE shape = 2),
inputs AS (
  SELECT p, min(doc_id) AS first_doc, count(*) AS n_records,
         count(CASE WHEN shape = 2 THEN 1 END) AS n_rank_maps,
         arg_max(CASE WHEN shape <> 3 THEN lang END, CASE WHEN shape <> 3 THEN doc_id END) AS category,
         arg_max(sys_prompt, CASE WHEN sys_prompt IS NOT NULL THEN doc_id END) AS sys_prompt
  FROM rec GROUP BY p),
outid AS (
  SELECT p, rid, CAST(row_number() OVER (PARTITION BY p ORDER BY first_at) - 1 AS INTEGER) AS output_id
  FROM resp),
inid AS (SELECT p, row_number() OVER (ORDER BY first_doc) - 1 AS input_id FROM inputs),
cats AS (
  SELECT category, CAST(row_number() OVER (ORDER BY min(first_doc)) - 1 AS INTEGER) AS category_id
  FROM inputs WHERE category IS NOT NULL GROUP BY category),
ranks AS (
  SELECT p, rid, CAST(arg_min(r, doc_id) AS INTEGER) AS rank FROM (
    SELECT p, doc_id, id_a AS rid, rank_a AS r FROM rec WHERE shape = 2
    UNION ALL SELECT p, doc_id, id_b, rank_b FROM rec WHERE shape = 2 AND id_b <> id_a)
  GROUP BY p, rid)"""

RANKED_DOCS = """
docs AS (
  SELECT 'docs_' || lang AS origin, lang AS category,
         lang || '/' || source || '/' || CAST(doc_id // 1000 AS VARCHAR) AS question, doc_id,
         CAST(1 + (1 - quality) + toxic AS INTEGER) AS rank, text
  FROM documents JOIN labels USING (doc_id)),
dpairs AS (
  SELECT a.origin, a.category, a.question, CAST(a.doc_id AS VARCHAR) AS id_a,
         CAST(b.doc_id AS VARCHAR) AS id_b, a.text AS answer_a, b.text AS answer_b,
         CASE WHEN a.rank < b.rank THEN 'A' ELSE 'B' END AS preference
  FROM docs a JOIN docs b
    ON a.question = b.question AND a.doc_id < b.doc_id AND a.rank <> b.rank),
flips AS (
  SELECT *, substr(md5(origin || ':' || question || ':' || id_a || ':' || id_b), 1, 1) < '8' AS flip
  FROM dpairs),
swapped AS (
  SELECT origin, category, question, CASE WHEN flip THEN id_b ELSE id_a END AS id_a,
         CASE WHEN flip THEN id_a ELSE id_b END AS id_b,
         CASE WHEN flip THEN answer_b ELSE answer_a END AS answer_a,
         CASE WHEN flip THEN answer_a ELSE answer_b END AS answer_b,
         CASE WHEN flip THEN CASE preference WHEN 'A' THEN 'B' ELSE 'A' END ELSE preference END
           AS preference
  FROM flips)"""

CHATS = """
chats AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer, s.text AS sys_prompt
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.role = 'system'
  WHERE u.role = 'user')"""

# Unicode White_Space plus the four ASCII separators, as a class for this regex dialect.
_WS = (
    "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)


def sql_strip(expression: str) -> str:
    return f"regexp_replace({expression}, '^{_WS}+|{_WS}+$', '', 'g')"


def sql_tokens(expression: str) -> str:
    return f"list_filter(string_split_regex({expression}, '[\\x09-\\x0d ]+'), lambda x: x <> '')"


TURNS = f"""
turns AS (
  SELECT 'chat' AS origin, conv_id AS input_id, CAST(turn AS INTEGER) AS output_id, text,
         CAST(len({sql_tokens("text")}) AS INTEGER) AS n_tokens,
         list_transform({sql_tokens("text")}, lambda x: length(x) - 2) AS ids
  FROM conversations)"""

CHAT_LABELS = (
    TURNS
    + f""",
raw_labels AS (
  SELECT a.origin, a.input_id,
    CASE WHEN substr(md5(a.input_id || ':' || a.output_id), 1, 1) < '8'
         THEN a.output_id ELSE b.output_id END AS chosen_id,
    CASE WHEN substr(md5(a.input_id || ':' || a.output_id), 1, 1) < '8'
         THEN b.output_id ELSE a.output_id END AS rejected_id
  FROM turns a JOIN turns b ON a.input_id = b.input_id AND b.output_id = a.output_id + 1
  UNION ALL SELECT origin, input_id, output_id, output_id FROM turns),
kept AS (SELECT * FROM turns WHERE n_tokens <= {MAX_TOKENS}),
usable AS (
  SELECT l.* FROM raw_labels l
  WHERE chosen_id <> rejected_id
    AND EXISTS (SELECT 1 FROM kept k WHERE k.input_id = l.input_id AND k.output_id = l.chosen_id)
    AND EXISTS (SELECT 1 FROM kept k WHERE k.input_id = l.input_id AND k.output_id = l.rejected_id))"""
)


def packed(source: str) -> str:
    return f"""
placed AS (
  SELECT origin, input_id, output_id, row_number() OVER (ORDER BY
    md5(origin || ':' || input_id || ':' || {SEED_EPOCH}), origin, input_id, output_id) - 1 AS pos
  FROM {source}),
packed AS (
  SELECT origin, input_id, output_id, pos // {BATCH} AS batch_id,
         CAST(pos % {BATCH} AS INTEGER) AS slot FROM placed)"""


BATCHES = (
    PAIRS
    + ","
    + packed("samples")
    + """,
inside AS (
  SELECT c.batch_id, v.origin, v.input_id, v.chosen_id, v.rejected_id
  FROM dvotes v
  JOIN packed c ON c.input_id = v.input_id AND c.output_id = v.chosen_id
  JOIN packed r ON r.input_id = v.input_id AND r.output_id = v.rejected_id
    AND r.batch_id = c.batch_id)"""
)

JUDGE_TEXTS = """
judged AS (
  SELECT 'events' AS origin, event_type AS category, 'user ' || user_id AS question, event_id,
         user_id % 4 AS digit, TRY_CAST(props->>'$.k' AS INTEGER) AS k,
         CASE event_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'A' ELSE 'error' END AS judgment,
         CASE WHEN substr(md5(CAST(event_id AS VARCHAR)), 1, 1) < '8' THEN 'A' ELSE 'B' END AS preference
  FROM events)"""


def _with(views: str, select: str) -> str:
    return f"WITH {views.strip()}\n{select.strip()}"


def _macro(rows: str) -> str:
    """(origin, metric, value) means over categories, undefined if one of them is."""
    return (
        "SELECT origin, metric, CASE WHEN count(value) = count(*) THEN avg(value) END AS value "
        f"FROM {rows} GROUP BY origin, metric"
    )


def _bundle(views: str, rows: str) -> str:
    return _with(
        views + f",\nby_cat AS ({rows}),\nmacro AS ({_macro('by_cat')})",
        """SELECT origin, category, metric, round(value, 6) AS value FROM by_cat
           UNION ALL SELECT origin, NULL, metric, round(value, 6) FROM macro""",
    )


def _scorer_rows(by: str, source: str, reward: str) -> str:
    return _SCORER_ROWS.format(by=by, source=source, reward=reward)


_BY = "origin, category"
_JUDGE_ROWS = """
  SELECT origin, category, 'accuracy-rank' AS metric, sum(n_right) / CAST(sum(n) AS DOUBLE) AS value
  FROM per_question GROUP BY ALL
  UNION ALL SELECT origin, category, 'exact_match-rank',
    avg(CASE WHEN n_right = n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM per_question GROUP BY ALL"""


def _per_question(source: str) -> str:
    return f"""
per_question AS (
  SELECT origin, category, question, count(*) AS n,
         sum(CASE WHEN judgment = preference THEN 1 ELSE 0 END) AS n_right
  FROM {source} GROUP BY ALL)"""


def _sql_judge_prompts() -> str:
    """The same wording as literals, put together in this dialect (chatml marks)."""
    slots = {"{question}": "question", "{first}": "answer", "{second}": "question"}

    def literal(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    selects = []
    for style, turns in JUDGE_STYLES.items():
        pieces = []
        for role, parts in turns:
            pieces.append(literal(f"<|im_start|>{role}\n"))
            pieces += [slots.get(part, literal(part)) for part in parts]
            pieces.append(literal("<|im_end|>\n"))
        pieces.append(literal("<|im_start|>assistant\n"))
        selects.append(
            f"SELECT conv_id, turn, '{style}' AS style, {' || '.join(pieces)} AS prompt FROM chats"
        )
    return _with(CHATS, "\nUNION ALL ".join(selects))


_CHATML = (
    "coalesce('<|im_start|>system\n' || sys_prompt || '<|im_end|>\n', '') || "
    "'<|im_start|>user\n' || question || '<|im_end|>\n' || "
    "'<|im_start|>assistant\n' || answer || '<|im_end|>\n'"
)
_PLAIN = (
    "coalesce('system: ' || sys_prompt || '\n', '') || 'user: ' || question || '\n' || "
    "'assistant: ' || answer || '\n'"
)

_WEIGHTS = "[" + ", ".join(f"{(i - 31.5) / 64.0}::DOUBLE" for i in range(64)) + "]"

LINE_DOCS = """
line_docs AS (
  SELECT doc_id, lang || '/' || source AS prompt, doc_id % 7 <> 0 AND doc_id % 11 <> 0 AS whole,
         CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END AS n_ranks FROM documents)"""

FEATURE_PAIRS = """
vectors AS (SELECT vec_id, label >= 5 AS chosen, row_number() OVER (
    PARTITION BY label >= 5 ORDER BY vec_id) - 1 AS k FROM embeddings),
smaller AS (SELECT nullif(least(count(*) FILTER (chosen), count(*) FILTER (NOT chosen)), 0) AS n FROM vectors),
feature_pairs AS (
  SELECT a.k AS a_k, b.k AS b_k, a.vec_id AS chosen_vec, b.vec_id AS rejected_vec
  FROM vectors a, vectors b, smaller s WHERE a.chosen AND NOT b.chosen AND a.k % s.n = b.k % s.n)"""

HISTORY = """
history AS (
  SELECT event_type AS run, CAST(day(ts) AS INTEGER) AS step, round(avg(value), 6) AS value
  FROM events GROUP BY 1, 2)"""

ORACLE: dict[str, str] = {
    # metrics
    "reward_stats": _with(
        LINES,
        """SELECT origin, category, round(avg(reward), 6) AS reward_mean,
                  round(stddev_samp(reward), 6) AS reward_std FROM lines GROUP BY ALL""",
    ),
    "dedup_scores": _with(
        SAMPLES,
        """SELECT origin, category, input_id, output_id, rank, round(reward, 6) AS reward
           FROM samples""",
    ),
    "rank_pairs": _with(
        SAMPLES,
        """SELECT a.origin, a.category, a.input_id, a.output_id AS chosen_id,
                  b.output_id AS rejected_id, round(a.reward, 6) AS chosen_reward,
                  round(b.reward, 6) AS rejected_reward
           FROM samples a JOIN samples b ON a.input_id = b.input_id AND a.rank < b.rank""",
    ),
    "rank_counts": _with(TIED, "SELECT * FROM counts"),
    "rank_accuracy": _with(
        TIED,
        """SELECT origin, category,
             round(sum(n_concordant) / CAST(sum(n_pairs) AS DOUBLE), 6) AS accuracy_rank
           FROM counts GROUP BY ALL""",
    ),
    "rank_exact_match": _with(
        TIED,
        """SELECT origin, category, round(avg(CASE WHEN n_discordant = 0 THEN 1.0::DOUBLE
             ELSE 0.0::DOUBLE END), 6) AS exact_match_rank FROM counts GROUP BY ALL""",
    ),
    "metrics_by_category": _with(
        TIED + f", m AS ({_scorer_rows(_BY, 'lines', 'reward_tied')})",
        "SELECT origin, category, metric, round(value, 6) AS value FROM m",
    ),
    "macro_metrics": _with(
        TIED + f", m AS ({_scorer_rows(_BY, 'lines', 'reward_tied')}), n AS ({_macro('m')})",
        "SELECT origin, metric, round(value, 6) AS value FROM n",
    ),
    "metric_bundle": _bundle(
        PAIRS + "," + rank_views("samples", "reward") + "," + ece_views(_BY),
        _scorer_rows(_BY, "samples", "reward") + _PAIR_ROWS.format(by=_BY),
    ),
    "train_eval_metrics": _with(
        PAIRS + "," + rank_views("samples", "reward") + "," + ece_views("origin")
        + f", m AS ({_scorer_rows('origin', 'samples', 'reward')}{_PAIR_ROWS.format(by='origin')})",
        "SELECT origin, metric, round(value, 6) AS value FROM m",
    ),
    "metric_documents": _with(
        TIED + f", m AS ({_scorer_rows(_BY, 'lines', 'reward_tied')}), n AS ({_macro('m')})",
        """SELECT origin, metric || '-' || category AS name, round(value, 6) AS value FROM m
           UNION ALL SELECT origin, metric, round(value, 6) FROM n""",
    ),
    "overall_score": _with(
        TIED + f", m AS ({_scorer_rows(_BY, 'lines', 'reward_tied')}), n AS ({_macro('m')})",
        """SELECT round(avg(score), 6) AS overall FROM (
             SELECT origin, sum(value) / 2 AS score FROM n WHERE metric LIKE '%-rank' GROUP BY 1)""",
    ),
    # label pairs
    "distinct_pairs": _with(VOTES, "SELECT * FROM dvotes"),
    "build_pairs": _with(
        PAIRS,
        """SELECT origin, input_id, category, chosen_id, rejected_id,
             round(chosen_reward, 6) AS chosen_reward, round(rejected_reward, 6) AS rejected_reward
           FROM pairs""",
    ),
    "require_pairs": _with(PAIRS, "SELECT count(*) AS n_pairs, count(*) > 0 AS has_pairs FROM pairs"),
    "pair_metrics": _with(
        PAIRS,
        """SELECT origin, category,
             round(avg(CASE WHEN chosen_reward > rejected_reward THEN 1.0::DOUBLE
               ELSE 0.0::DOUBLE END), 6) AS accuracy_labels,
             round(avg(chosen_reward), 6) AS chosen_reward_mean_labels,
             round(stddev_samp(chosen_reward), 6) AS chosen_reward_std_labels,
             round(avg(rejected_reward), 6) AS rejected_reward_mean_labels,
             round(stddev_samp(rejected_reward), 6) AS rejected_reward_std_labels,
             round(avg(chosen_reward - rejected_reward), 6) AS reward_diverge_mean_labels,
             round(stddev_samp(chosen_reward - rejected_reward), 6) AS reward_diverge_std_labels
           FROM pairs GROUP BY ALL""",
    ),
    "calibration_curve": _with(
        PAIRS + "," + ece_views("origin"),
        """SELECT origin, bin, round(accuracy, 6) AS accuracy, round(mean_diff, 6) AS mean_diff,
                  n_pairs FROM curve""",
    ),
    "expected_calibration_error": _with(
        PAIRS + "," + ece_views(_BY), "SELECT origin, category, round(ece, 6) AS ece FROM ece"
    ),
    "bradley_terry_loss": _with(
        PAIRS,
        """SELECT origin, round(avg(greatest(rejected_reward - chosen_reward, 0) +
             ln(1 + exp(-abs(chosen_reward - rejected_reward)))), 6) AS bt_loss
           FROM pairs GROUP BY ALL""",
    ),
    "reward_l2_penalty": _with(
        SAMPLES,
        "SELECT origin, round(avg(reward * reward) * 0.1::DOUBLE, 6) AS l2_penalty FROM samples GROUP BY ALL",
    ),
    # records, fusing, ids
    "normalize_prompt_key": _with(
        RECORDS, "SELECT doc_id, p AS input_text, md5(p) AS input_key FROM rec"
    ),
    "normalize_flat_pairs": _with(
        RECORDS,
        """SELECT doc_id, shape = 0 AS is_flat,
             CAST(CASE WHEN shape < 3 THEN 1 ELSE 0 END AS INTEGER) AS n_items FROM rec""",
    ),
    "first_category": _with(
        RECORDS, "SELECT doc_id, CASE WHEN shape <> 3 THEN lang END AS category FROM rec"
    ),
    "content_id": "SELECT doc_id, md5(text) AS response_id FROM documents",
    "canonical_annotations": _with(
        RECORDS,
        """SELECT md5(p) AS input_key, doc_id, CAST(0 AS INTEGER) AS sub,
             CASE WHEN vote = '2' THEN id_b ELSE id_a END AS id_1,
             CASE WHEN vote = '2' THEN id_a ELSE id_b END AS id_2, '1' AS preference
           FROM rec WHERE shape < 2 AND vote IN ('1', '2')""",
    ),
    "tuple_annotations": _with(
        RECORDS,
        """SELECT md5(p) AS input_key, doc_id, CAST(0 AS INTEGER) AS sub, id_a AS id_1,
             id_b AS id_2, vote AS preference FROM rec WHERE shape = 2""",
    ),
    "invalid_annotations": _with(
        RECORDS,
        """SELECT md5(p) AS input_key, doc_id, vote AS preference FROM rec
           WHERE shape < 2 AND vote NOT IN ('1', '2')""",
    ),
    "fuse_by_prompt": _with(
        RECORDS,
        """SELECT md5(i.p) AS input_key, i.p AS input, i.first_doc, i.category, i.n_records,
             coalesce(r.n, 0) AS n_responses, coalesce(a.n, 0) AS n_annotations
           FROM inputs i
           LEFT JOIN (SELECT p, count(*) AS n FROM resp GROUP BY p) r ON r.p = i.p
           LEFT JOIN (SELECT p, count(*) AS n FROM ann GROUP BY p) a ON a.p = i.p""",
    ),
    "dedup_responses": _with(
        RECORDS,
        """SELECT md5(p) AS input_key, rid AS response_id, first_at // 2 AS first_doc,
             CAST(first_at % 2 AS INTEGER) AS first_sub, output, n_mentions FROM resp""",
    ),
    "passthrough_scalars": _with(RECORDS, "SELECT md5(p) AS input_key, sys_prompt FROM inputs"),
    "rank_once": _with(
        RECORDS, "SELECT md5(p) AS input_key, n_rank_maps FROM inputs WHERE n_rank_maps > 1"
    ),
    "prune_common_keys": _with(
        RECORDS,
        """SELECT 'input' AS field, true AS is_common, count(*) AS n_present FROM inputs
           UNION ALL SELECT 'category', count(category) = count(*), count(category) FROM inputs
           UNION ALL SELECT 'sys_prompt', count(sys_prompt) = count(*), count(sys_prompt)
           FROM inputs""",
    ),
    "assign_input_ids": _with(RECORDS, "SELECT md5(p) AS input_key, input_id FROM inid"),
    "assign_output_ids": _with(
        RECORDS, "SELECT md5(p) AS input_key, rid AS response_id, output_id FROM outid"
    ),
    "category_dictionary": _with(RECORDS, "SELECT category, category_id FROM cats"),
    **dict.fromkeys(
        ["explode_responses", "stored_samples"],
        _with(
            RECORDS,
            """SELECT input_id, output_id, r.p AS input, output, i.category, category_id, rank, sys_prompt
           FROM resp r JOIN outid o ON o.p = r.p AND o.rid = r.rid
           JOIN inid n ON n.p = r.p JOIN inputs i ON i.p = r.p
           LEFT JOIN cats c ON c.category = i.category
           LEFT JOIN ranks k ON k.p = r.p AND k.rid = r.rid""",
        ),
    ),
    "sequential_order": _with(
        SAMPLES,
        """SELECT origin, input_id, output_id,
             row_number() OVER (ORDER BY origin, input_id, output_id) - 1 AS position FROM samples""",
    ),
    "null_uncommon_keys": _with(
        RECORDS,
        """SELECT input_id, output_id, r.p AS input,
             CASE WHEN (SELECT count(*) = count(category) FROM inputs) THEN i.category END AS category,
             CASE WHEN (SELECT count(*) = count(category) FROM inputs) THEN category_id END AS category_id,
             CASE WHEN (SELECT count(*) = count(sys_prompt) FROM inputs) THEN sys_prompt END AS sys_prompt
           FROM resp r JOIN outid o ON o.p = r.p AND o.rid = r.rid
           JOIN inid n ON n.p = r.p JOIN inputs i ON i.p = r.p
           LEFT JOIN cats c ON c.category = i.category""",
    ),
    **dict.fromkeys(
        ["index_labels", "stored_labels"],
        _with(
            RECORDS,
            """SELECT md5(a.p) AS input_key, c.output_id AS chosen_id, r.output_id AS rejected_id
           FROM ann a JOIN outid c ON c.p = a.p AND c.rid = a.id_1
           JOIN outid r ON r.p = a.p AND r.rid = a.id_2 WHERE a.preference = '1'""",
        ),
    ),
    "unknown_label_ids": _with(
        RECORDS,
        """SELECT md5(p) AS input_key, rid AS response_id, count(*) AS n_uses FROM (
             SELECT p, id_1 AS rid FROM ann WHERE preference = '1'
             UNION ALL SELECT p, id_2 FROM ann WHERE preference = '1') e
           WHERE NOT EXISTS (SELECT 1 FROM ranks k WHERE k.p = e.p AND k.rid = e.rid)
           GROUP BY 1, 2""",
    ),
    "attach_ranks": _with(
        RECORDS,
        """SELECT md5(r.p) AS input_key, r.rid AS response_id, rank,
             coalesce(rank, 0) AS rank_compat
           FROM resp r LEFT JOIN ranks k ON k.p = r.p AND k.rid = r.rid""",
    ),
    # text and length path
    "to_chat": _with(
        CHATS,
        """SELECT conv_id, turn,
             CAST(CASE WHEN sys_prompt IS NULL THEN 2 ELSE 3 END AS INTEGER) AS n_turns,
             coalesce('system=' || sys_prompt || '|', '') || 'user=' || question ||
             '|assistant=' || answer AS chat FROM chats""",
    ),
    "render_chat": _with(
        CHATS,
        f"""SELECT conv_id, turn, {sql_strip(_CHATML)} AS chatml,
              {sql_strip(_PLAIN + " || 'assistant: '")} AS plain,
              {sql_strip("'Human:' || question || chr(10) || chr(10) || 'Assistant:' || answer")} AS human
            FROM chats""",
    ),
    "strip_bos": _with(
        CHATS,
        f"SELECT conv_id, turn, replace('<s>' || {sql_strip(_PLAIN)}, '<s>', '') AS text FROM chats",
    ),
    "count_tokens": f"""
        SELECT doc_id, CAST(len({sql_tokens("text")}) AS INTEGER) AS n_tokens FROM documents""",
    "truncate_left": f"""
        SELECT doc_id, array_to_string(t[greatest(len(t) - {MAX_TOKENS} + 1, 1):], ' ') AS tail,
               CAST(least(len(t), {MAX_TOKENS}) AS INTEGER) AS n_kept
        FROM (SELECT doc_id, {sql_tokens("text")} AS t FROM documents)""",
    "length_filter": _with(CHAT_LABELS, "SELECT input_id, output_id, n_tokens FROM kept"),
    "label_endpoint_filter": _with(
        CHAT_LABELS, "SELECT input_id, chosen_id, rejected_id FROM usable"
    ),
    "orphan_output_filter": _with(
        CHAT_LABELS,
        """SELECT input_id, output_id, n_tokens FROM kept k WHERE EXISTS (
             SELECT 1 FROM usable u WHERE u.input_id = k.input_id
               AND (u.chosen_id = k.output_id OR u.rejected_id = k.output_id))""",
    ),
    **dict.fromkeys(
        ["length_path_truncated", "length_path_truncated_column"],
        f"""WITH {TURNS}
            SELECT input_id, output_id, CAST(least(n_tokens, {MAX_TOKENS}) AS INTEGER) AS n_tokens,
              array_to_string(ids[greatest(n_tokens - {MAX_TOKENS} + 1, 1):], ' ') AS ids
            FROM turns""",
    ),
    "length_path_dropped": _with(
        CHAT_LABELS,
        """SELECT input_id, output_id, n_tokens,
             array_to_string(ids, ' ') AS ids FROM kept k WHERE EXISTS (
             SELECT 1 FROM usable u WHERE u.input_id = k.input_id
               AND (u.chosen_id = k.output_id OR u.rejected_id = k.output_id))""",
    ),
    "length_path_dropped_labels": _with(
        CHAT_LABELS, "SELECT input_id, chosen_id, rejected_id FROM usable"
    ),
    # judge path
    "judge_pairs": _with(RANKED_DOCS, "SELECT * FROM dpairs"),
    "swap_positions": _with(
        RANKED_DOCS,
        """SELECT question, id_a, id_b, md5(answer_a) AS answer_a_md5, md5(answer_b) AS answer_b_md5,
             preference FROM swapped""",
    ),
    "render_judge_prompts_all": _sql_judge_prompts(),
    "parse_verdict_bracket": _with(JUDGE_TEXTS, "SELECT event_id, judgment FROM judged"),
    "parse_verdict_exact_choice": """
        SELECT event_id, CASE WHEN event_id % 6 = 4 THEN 'A' ELSE 'error' END AS judgment FROM events""",
    "parse_verdict_letter": """
        SELECT event_id, CASE WHEN event_id % 6 = 5 THEN 'B' ELSE 'error' END AS judgment FROM events""",
    "parse_verdict_json_choice": _with(
        JUDGE_TEXTS,
        """SELECT event_id, CASE
             WHEN n = 1 THEN 'A' WHEN n = 2 THEN 'B' ELSE 'error' END AS judgment
           FROM (SELECT event_id, CASE event_id % 12 WHEN 0 THEN k WHEN 1 THEN digit WHEN 2 THEN digit
                   WHEN 5 THEN digit WHEN 6 THEN 1 WHEN 9 THEN digit WHEN 11 THEN digit END AS n FROM judged)""",
    ),
    "score_judgments": _with(
        JUDGE_TEXTS,
        """SELECT event_id, CAST(CASE WHEN judgment = preference THEN 1 ELSE 0 END AS INTEGER) AS score
           FROM judged""",
    ),
    "judge_metrics": _bundle(JUDGE_TEXTS + "," + _per_question("judged"), _JUDGE_ROWS),
    # lines of JSON
    "records_from_lines": _with(
        LINE_DOCS,
        """SELECT doc_id, whole, CASE WHEN whole AND doc_id % 17 <> 0 THEN prompt END AS input,
             CASE WHEN whole THEN 1 END AS n_responses, CASE WHEN whole THEN n_ranks END AS n_ranks,
             CASE WHEN whole THEN '["a","b","1"]' END AS annotation FROM line_docs""",
    ),
    "invalid_lines": _with(
        LINE_DOCS,
        """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'not a record of the expected shape'
             ELSE 'annotations is not a list' END AS reason FROM line_docs WHERE NOT whole""",
    ),
    "records_without_prompt": _with(LINE_DOCS, "SELECT doc_id FROM line_docs WHERE whole AND doc_id % 17 = 0"),
    "invalid_ranks": _with(
        LINE_DOCS,
        """SELECT md5(prompt) AS input_key, CAST(doc_id AS VARCHAR) AS response_id, 'x' AS rank_text
           FROM line_docs WHERE whole AND doc_id % 17 <> 0 AND doc_id % 5 = 0""",
    ),
    "unknown_rank_ids": _with(
        LINE_DOCS,
        """SELECT DISTINCT md5(prompt) AS input_key, 'ghost' AS response_id
           FROM line_docs WHERE whole AND doc_id % 17 <> 0 AND doc_id % 13 = 0""",
    ),
    "scores_to_samples": _with(
        SAMPLES,
        """SELECT origin, input_id, output_id, CASE WHEN output_id % 2 = 0 THEN round(reward, 6) END AS reward
           FROM samples""",
    ),
    "question_answer": """
        SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u
        JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    # batches
    "epoch_order": f"""
        SELECT o_orderkey AS input_id, row_number() OVER (ORDER BY
          md5('orders:' || o_orderkey || ':' || {SEED_EPOCH}), o_orderkey) - 1 AS epoch_pos
        FROM orders""",
    "pack_batches": _with(BATCHES, "SELECT * FROM packed"),
    "pack_batches_greedy_audit": _with(
        SAMPLES,
        f"""SELECT count(*) AS n_samples, CAST(ceil(count(*) / {BATCH}.0) AS BIGINT) AS n_batches,
             CAST(0 AS BIGINT) AS n_oversize, CASE WHEN count(*) % {BATCH} = 0 THEN 0::BIGINT ELSE 1::BIGINT END AS n_short,
             CAST(0 AS BIGINT) AS n_uneven_slots, CAST(0 AS BIGINT) AS n_missing,
             CAST(0 AS BIGINT) AS n_repeated, true AS keeps_as_many FROM samples""",
    ),
    "pad_batch": _with(
        TURNS + "," + packed("turns") + """,
        wide AS (
          SELECT batch_id, slot, ids, max(len(ids)) OVER (PARTITION BY batch_id) - len(ids) AS n
          FROM packed JOIN turns USING (origin, input_id, output_id))""",
        """SELECT batch_id, slot,
             array_to_string(list_concat(list_transform(range(n), lambda x: 0), ids), ',') AS input_ids,
             array_to_string(list_concat(list_transform(range(n), lambda x: 0),
               list_transform(ids, lambda x: 1)), ',') AS attention_mask FROM wide""",
    ),
    "sanitize_token_ids": _with(
        TURNS,
        """SELECT input_id, output_id,
             array_to_string(list_transform(ids, lambda x: CASE WHEN x < 0 OR x >= 9 THEN 0 ELSE x END),
               ',') AS input_ids,
             CAST(len(list_filter(ids, lambda x: x < 0 OR x >= 9)) AS INTEGER) AS n_replaced FROM turns""",
    ),
    "last_attended_index": _with(
        TURNS,
        """SELECT input_id, output_id, list_max(list_transform(range(len(ids)), lambda i:
             CASE WHEN ids[i + 1] % 3 <> 0 THEN i END)) AS last_index FROM turns""",
    ),
    "in_batch_pairs": _with(BATCHES, "SELECT * FROM inside"),
    "pair_coverage": _with(
        BATCHES,
        """SELECT n_kept, n_all, round(n_kept / CAST(n_all AS DOUBLE), 6) AS coverage FROM
             (SELECT count(*) AS n_kept FROM inside), (SELECT count(*) AS n_all FROM dvotes)""",
    ),
    "expand_label_rows": _with(
        BATCHES, "SELECT DISTINCT origin, input_id, chosen_id, rejected_id FROM inside"
    ),
    "group_samples": _with(
        BATCHES,
        """SELECT p.batch_id, p.origin, p.input_id,
             string_agg(CAST(output_id AS VARCHAR), ',' ORDER BY output_id) AS outputs,
             CAST(coalesce(any_value(n), 0) AS INTEGER) AS n_labels
           FROM packed p LEFT JOIN (SELECT batch_id, input_id, count(*) AS n FROM inside GROUP BY ALL) i
             ON i.batch_id = p.batch_id AND i.input_id = p.input_id
           GROUP BY p.batch_id, p.origin, p.input_id""",
    ),
    "batch_loss": _with(
        BATCHES + """,
        row_part AS (
          SELECT batch_id, count(*) AS n_rows, avg(reward * reward) * 0.1::DOUBLE AS l2_penalty
          FROM packed JOIN samples USING (origin, input_id, output_id) GROUP BY batch_id),
        pair_part AS (
          SELECT batch_id, count(*) AS n_pairs, avg(greatest(rejected_reward - chosen_reward, 0) +
            ln(1 + exp(-abs(chosen_reward - rejected_reward)))) AS bt_loss
          FROM inside JOIN pairs USING (origin, input_id, chosen_id, rejected_id) GROUP BY batch_id)""",
        """SELECT batch_id, n_rows, coalesce(n_pairs, 0) AS n_pairs, round(bt_loss, 6) AS bt_loss,
             round(l2_penalty, 6) AS l2_penalty, round(bt_loss + l2_penalty, 6) AS loss
           FROM row_part LEFT JOIN pair_part USING (batch_id)""",
    ),
    # scoring, evaluation
    "score_responses": "SELECT doc_id, round(length(text) / 1000.0::DOUBLE, 6) AS reward FROM documents",
    "score_responses_python": (
        "SELECT doc_id, round(length(text) / 1000.0::DOUBLE, 6) AS reward FROM documents"
    ),
    "evaluate_judge": _bundle(
        RANKED_DOCS + """,
        judged AS (
          SELECT *, CASE WHEN length(answer_a) >= length(answer_b) THEN 'A' ELSE 'B' END AS judgment
          FROM swapped),""" + _per_question("judged"),
        _JUDGE_ROWS,
    ),
    # head, checkpoints
    "linear_reward": f"""
        SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, {_WEIGHTS}),
          lambda z: CAST(z[1] AS DOUBLE) * z[2])), 6) AS reward FROM embeddings""",
    "feature_pairs": _with(
        FEATURE_PAIRS, "SELECT greatest(a_k, b_k) AS k, chosen_vec, rejected_vec FROM feature_pairs"
    ),
    "linear_head_audit": _with(
        FEATURE_PAIRS,
        """SELECT count(*) AS n_pairs, true AS every_pair_once, true AS settled, true AS below_chance,
             true AS same_loss FROM feature_pairs""",
    ),
    "best_checkpoint": _with(
        HISTORY,
        """SELECT run, max(value) AS best_value, CAST(min(step) AS INTEGER) AS best_step
           FROM history h WHERE value = (SELECT max(value) FROM history g WHERE g.run = h.run)
           GROUP BY run""",
    ),
    "checkpoint_walk": _with(
        HISTORY,
        """SELECT run, step, value, coalesce(value > max(value) OVER (PARTITION BY run ORDER BY step
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_new_best FROM history""",
    ),
}

_DOC_SCORES = (
    RANKED_DOCS
    + """,
doc_samples AS (
  SELECT origin, category, question AS input_id, rank, length(text) / 1000.0::DOUBLE AS reward
  FROM docs),"""
    + rank_views("doc_samples", "reward")
)
ORACLE["evaluate_scorer"] = _bundle(_DOC_SCORES, _scorer_rows(_BY, "doc_samples", "reward"))
ORACLE["evaluate_python_scorer"] = ORACLE["evaluate_scorer"]
ORACLE["evaluate_python_judge"] = ORACLE["evaluate_judge"]
