"""The named queries over the driver's tables, each with the SQL of the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import domains, features, labels, metrics, outcomes, probes, reports, selection, splits
from ..sources import readers, writers
from ..sources.scratch import folder
from . import views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


#: Views as SQL.
TOKENS = "SELECT l_orderkey AS sample, l_linenumber AS line, l_partkey AS o1, l_suppkey AS o2, l_returnflag = 'R' AS wrong, l_linestatus = 'O' AS masked, l_discount * 10 AS score, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem"
LINES = f"SELECT sample, line, max(score) AS score, bool_or(wrong) AS is_error, avg(CASE WHEN wrong THEN 1.0 ELSE 0.0 END) AS y FROM ({TOKENS}) WHERE NOT masked GROUP BY sample, line"
CANDIDATES = "SELECT o_custkey AS problem, o_orderkey AS cand, o_orderpriority AS difficulty, o_orderstatus = 'F' AS is_correct, o_orderstatus = 'P' AS no_fix, o_totalprice < 20000 AS no_program, o_orderkey % 11 = 0 AS line_filter, o_orderkey % 13 = 0 AS no_correct_line, CASE WHEN o_orderstatus = 'F' THEN 'correct' WHEN o_totalprice < 20000 THEN 'no_program' ELSE 'tests_failed' END AS outcome FROM orders"
DROPPED = "(no_program OR no_fix OR line_filter OR no_correct_line)"
PROBLEMS = f"SELECT problem, count(*) AS n, count(*) FILTER (WHERE is_correct) AS n_correct FROM ({CANDIDATES}) GROUP BY problem"
SCORES = "SELECT user_id AS \"user\", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS score, event_type AS node_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 7.0) AS BIGINT) AS line, event_id FROM events"
LIBS = "SELECT c_custkey AS task, n_name AS lib FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, lower(n_name) FROM customer JOIN nation ON (c_nationkey + 1) % 25 = n_nationkey UNION ALL SELECT c_custkey, 'lib' || CAST(c_custkey % 4 AS VARCHAR) FROM customer WHERE c_custkey % 9 = 0"
MAPPED = f"SELECT task, l.lib, d.domain FROM ({LIBS}) l LEFT JOIN (SELECT n_name AS lib, r_name AS domain FROM nation JOIN region ON n_regionkey = r_regionkey) d ON lower(l.lib) = lower(d.lib)"
RESULTS = "SELECT c_mktsegment AS model, n_name AS baseline, n_nationkey AS ord, CASE WHEN n_regionkey = 0 THEN 'home' ELSE 'away' END AS rank, round((avg(c_acctbal) + 1000) / 11000, 6) AS roc_auc FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name, n_nationkey, n_regionkey"
KS = "(VALUES (1), (2), (3)) t(k)"
TENTHS = "(VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9)) t(tenth)"


def f1_sql(tp="tp", fp="fp", fn="fn") -> str:
    return f"round(CASE WHEN 2 * {tp} + {fp} + {fn} = 0 THEN 0.0 ELSE 2.0 * {tp} / CAST(2 * {tp} + {fp} + {fn} AS DOUBLE) END, 9)"


# Tokens and lines.


@query(f"SELECT sample, line, NOT bool_or(wrong AND NOT masked) AS line_is_clean FROM ({TOKENS}) GROUP BY sample, line")
def line_error_map(spark, sf):
    return labels.line_error_map(views.tokens(spark, sf), ["sample"])


@query(f"SELECT sample, line, bool_or(CASE WHEN masked THEN NULL ELSE wrong END) AS line_is_error FROM ({TOKENS}) GROUP BY sample, line")
def derived_line_label(spark, sf):
    return labels.derived_line_label(views.tokens(spark, sf), ["sample"])


@query(f"SELECT sample, line, max(score) AS score FROM ({TOKENS}) WHERE NOT masked GROUP BY sample, line")
def line_score_max(spark, sf):
    return labels.line_scores(views.tokens(spark, sf).where(~F.col("ws_comment")), ["sample"])


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, line) AS rk FROM ({LINES})),
e AS (SELECT sample, bool_or(is_error) AS el, min(CASE WHEN is_error THEN rk END) AS fh FROM r GROUP BY sample)
SELECT k, count(*) AS candidates, count(*) FILTER (WHERE el) AS eligible, count(*) FILTER (WHERE NOT el) AS excluded, count(*) FILTER (WHERE fh <= k) AS hits,
count(*) FILTER (WHERE el) - count(*) FILTER (WHERE fh <= k) AS misses, round(count(*) FILTER (WHERE fh <= k) / CAST(count(*) FILTER (WHERE el) AS DOUBLE), 9) AS hit_rate FROM e, {KS} GROUP BY k""")
def hit_at_k(spark, sf):
    return metrics.hit_at_k(views.lines(spark, sf))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, line) AS rk FROM ({LINES})),
e AS (SELECT sample, max(y) AS most, max(CASE WHEN rk = 1 THEN y END) AS top FROM r GROUP BY sample),
t AS (SELECT tenth, count(*) FILTER (WHERE most > tenth / 10.0) AS eligible, count(*) FILTER (WHERE top > tenth / 10.0) AS hits FROM e, {TENTHS} GROUP BY tenth),
u AS (SELECT *, round(hits / CAST(eligible AS DOUBLE), 9) AS hit_rate FROM t)
SELECT *, row_number() OVER (ORDER BY hit_rate DESC NULLS LAST, tenth) = 1 AS is_best FROM u""")
def hit_at_k_by_threshold(spark, sf):
    return metrics.hit_at_1_by_threshold(views.lines(spark, sf))


@query(f"""WITH d AS (SELECT trial, sample, line, is_error, row_number() OVER (PARTITION BY trial, sample ORDER BY md5('hit|' || trial || '|' || sample || '|' || line)) AS rk FROM ({LINES}), range(20) t(trial)),
e AS (SELECT trial, sample, min(CASE WHEN is_error THEN rk END) AS fh FROM d GROUP BY trial, sample),
p AS (SELECT trial, k, count(*) FILTER (WHERE fh <= k) / CAST(count(fh) AS DOUBLE) AS r FROM e, {KS} GROUP BY trial, k)
SELECT k, round(avg(r), 9) AS mean_rate, round(stddev_pop(r), 9) AS std_rate FROM p GROUP BY k""")
def random_hit_baseline(spark, sf):
    return metrics.random_hit_baseline(views.lines(spark, sf), 20, "hit")


@query(f"""WITH e AS (SELECT sample, count(*) AS n, count(*) FILTER (WHERE is_error) AS m FROM ({LINES}) GROUP BY sample HAVING m > 0)
SELECT k, round(avg(1 - CASE WHEN n <= k THEN 0.0 ELSE (CASE WHEN n - m > 0 THEN (n - m) / CAST(n AS DOUBLE) ELSE 0 END) * (CASE WHEN k < 2 THEN 1 WHEN n - m > 1 THEN (n - m - 1) / CAST(n - 1 AS DOUBLE) ELSE 0 END) * (CASE WHEN k < 3 THEN 1 WHEN n - m > 2 THEN (n - m - 2) / CAST(n - 2 AS DOUBLE) ELSE 0 END) END), 9) AS expected FROM e, {KS} GROUP BY k""")
def random_hit_expected(spark, sf):
    return metrics.expected_random_hit(views.lines(spark, sf))


@query(f"""WITH c AS (SELECT tenth, count(*) FILTER (WHERE score >= tenth / CAST(10.0 AS DOUBLE) AND wrong) AS tp, count(*) FILTER (WHERE score >= tenth / CAST(10.0 AS DOUBLE) AND NOT wrong) AS fp, count(*) FILTER (WHERE score < tenth / CAST(10.0 AS DOUBLE) AND wrong) AS fn FROM ({TOKENS}), {TENTHS} WHERE NOT masked GROUP BY tenth), f AS (SELECT *, {f1_sql()} AS f1 FROM c)
SELECT *, row_number() OVER (ORDER BY f1 DESC, tenth) = 1 AS is_best FROM f""")
def token_f1_sweep(spark, sf):
    return metrics.f1_sweep(views.tokens(spark, sf).where(~F.col("ws_comment")), ~F.col("tok_is_correct"), F.col("score"))


@query(f"""WITH l AS (SELECT sample, line, bool_or(score >= 0.5) AS flagged, arg_min(wrong, (o1, o2)) AS truth, min(wrong) <> max(wrong) AS mixed FROM ({TOKENS}) WHERE NOT masked GROUP BY sample, line),
c AS (SELECT count(truth) AS lines, count(*) - count(truth) AS unknown, count(*) FILTER (WHERE mixed) AS inconsistent, count(*) FILTER (WHERE flagged AND truth) AS tp, count(*) FILTER (WHERE flagged AND NOT truth) AS fp, count(*) FILTER (WHERE NOT flagged AND truth) AS fn FROM l) SELECT *, {f1_sql()} AS f1 FROM c""")
def partial_credit_line_f1(spark, sf):
    rows = views.tokens(spark, sf).where(~F.col("ws_comment")).withColumn("line_is_error", ~F.col("tok_is_correct"))
    return metrics.partial_credit_line_f1(rows, 0.5)


@query(f"""WITH l AS (SELECT score, count(*) FILTER (WHERE wrong) AS pos, count(*) FILTER (WHERE NOT wrong) AS neg FROM ({TOKENS}) WHERE NOT masked GROUP BY score),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM l)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 9) AS auc FROM r""")
def roc_auc_midrank(spark, sf):
    return metrics.roc_auc(views.tokens(spark, sf).where(~F.col("ws_comment")), ~F.col("tok_is_correct"), F.col("score"))


@query(f"""WITH a AS (SELECT count(*) AS n, avg(CAST(wrong AS DOUBLE)) AS b, avg((CAST(wrong AS DOUBLE) - score) * (CAST(wrong AS DOUBLE) - score)) AS e FROM ({TOKENS}) WHERE NOT masked)
SELECT n, round(b, 9) AS base_rate, round(e, 9) AS brier, round((b * (1 - b) - e) / (b * (1 - b)), 9) AS bss FROM a""")
def brier_skill(spark, sf):
    return metrics.brier_skill(views.tokens(spark, sf).where(~F.col("ws_comment")), ~F.col("tok_is_correct"), F.col("score"))


@query(f"""WITH c AS (SELECT line, count(*) FILTER (WHERE score >= 0.5 AND wrong) AS tp, count(*) FILTER (WHERE score >= 0.5 AND NOT wrong) AS fp, count(*) FILTER (WHERE score < 0.5 AND wrong) AS fn, count(*) AS n FROM ({TOKENS}) GROUP BY line)
SELECT line, n, round((n - fp - fn) / CAST(n AS DOUBLE), 9) AS accuracy, {f1_sql()} AS f1 FROM c""")
def accuracy_f1(spark, sf):
    return metrics.accuracy_f1(views.tokens(spark, sf), ~F.col("tok_is_correct"), F.col("score"), 0.5, ["line"])


@query(f"SELECT line, count(*) FILTER (WHERE NOT wrong) AS n_neg, count(*) FILTER (WHERE wrong) AS n_pos, round(count(*) FILTER (WHERE NOT wrong) / CAST(count(*) FILTER (WHERE wrong) AS DOUBLE), 9) AS scale_pos_weight FROM ({TOKENS}) GROUP BY line")
def class_weights(spark, sf):
    return metrics.class_weights(views.tokens(spark, sf), ~F.col("tok_is_correct"), ["line"])


@query(f"""SELECT sample, line, dim, round(avg(x), 6) AS value FROM (SELECT sample, line, unnest([0, 1, 2, 3]) AS dim, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM ({TOKENS}) WHERE NOT masked) GROUP BY sample, line, dim""")
def line_vector_mean(spark, sf):
    rows = labels.line_vectors(views.tokens(spark, sf).where(~F.col("ws_comment")), ["sample"], "mean")
    return rows.withColumn("value", F.round("value", 6))


@query(f"""SELECT sample, line, dim, max(x) AS value FROM (SELECT sample, line, unnest([0, 1, 2, 3]) AS dim, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM ({TOKENS}) WHERE NOT masked) GROUP BY sample, line, dim""")
def line_vector_max(spark, sf):
    return labels.line_vectors(views.tokens(spark, sf).where(~F.col("ws_comment")), ["sample"], "max")


@query(f"SELECT sample, line, max(o1) AS partkey, arg_max(o2, (o1, o2)) AS suppkey, count(*) AS n_tokens FROM ({TOKENS}) WHERE NOT masked GROUP BY sample, line")
def line_last_token(spark, sf):
    rows = labels.line_items(views.tokens(spark, sf), ["sample"])
    return rows.select("sample", "line", F.col("last.l_partkey").alias("partkey"), F.col("last.l_suppkey").alias("suppkey"), "n_tokens")


@query(f"SELECT sample, line, count(*) AS n_positions FROM ({TOKENS}) GROUP BY sample, line HAVING count(*) FILTER (WHERE NOT masked) > 0")
def line_sequences(spark, sf):
    return labels.sequence_items(views.tokens(spark, sf), ["sample"]).select("sample", "line", F.size("positions").cast("bigint").alias("n_positions"))


@query(f"""WITH a AS (SELECT row_number() OVER (PARTITION BY sample ORDER BY o1, o2, line, NOT wrong) - 1 AS i, count(*) OVER (PARTITION BY sample) AS n, wrong FROM (SELECT DISTINCT sample, line, o1, o2, wrong FROM ({TOKENS})))
SELECT CAST(least(floor(i * 20 / CAST(n AS DOUBLE)), 19) AS INTEGER) AS bucket, count(*) AS tokens, count(*) FILTER (WHERE wrong) AS errors, round(100.0 * count(*) FILTER (WHERE wrong) / count(*), 6) AS error_pct FROM a GROUP BY 1""")
def position_error_profile(spark, sf):
    rows = views.tokens(spark, sf).select("sample", "line", "ordinal", "tok_is_correct").distinct()
    rows = rows.withColumn("ordinal", F.struct("ordinal", "line", "tok_is_correct"))  # a total order
    return labels.position_profile(rows, ["sample"])


@query(f"""SELECT CASE WHEN masked THEN 'masked' WHEN score = 0 THEN 'no_score' WHEN line > 5 THEN 'late_line' ELSE 'kept' END AS reason, count(*) AS n FROM ({TOKENS}) GROUP BY 1""")
def drop_reason_audit(spark, sf):
    return labels.audit(views.tokens(spark, sf), {"masked": F.col("ws_comment"), "no_score": F.col("score") == 0, "late_line": F.col("line") > 5})


@query(f"""SELECT sample, count(*) FILTER (WHERE NOT (bad AND NOT masked)) AS n_correct, count(*) AS n FROM (SELECT *, bool_or(wrong) OVER (PARTITION BY sample, line) AS bad FROM ({TOKENS})) GROUP BY sample""")
def propagated_labels(spark, sf):
    rows = labels.propagated(views.tokens(spark, sf), ["sample"])
    return rows.groupBy("sample").agg(F.count_if("tok_is_correct").alias("n_correct"), F.count("*").alias("n"))


@query(f"SELECT sample, bool_or(ok) AS any_clean_line FROM (SELECT sample, line, bool_and(NOT wrong) AS ok FROM ({TOKENS}) WHERE NOT masked GROUP BY sample, line) GROUP BY sample")
def any_clean_line(spark, sf):
    return labels.has_clean_line(views.tokens(spark, sf), ["sample"])


@query(f"""WITH m AS (SELECT sample, line, NOT bool_or(wrong AND NOT masked) AS clean FROM ({TOKENS}) WHERE sample % 3 = 0 GROUP BY sample, line),
d AS (SELECT sample, line, bool_or(CASE WHEN masked THEN NULL ELSE wrong END) AS e FROM ({TOKENS}) GROUP BY sample, line)
SELECT coalesce(NOT clean, e) AS line_is_error, count(*) AS n FROM d LEFT JOIN m USING (sample, line) GROUP BY 1""")
def line_truth_precedence(spark, sf):
    t = views.tokens(spark, sf)
    mapped = labels.line_error_map(t.where("sample % 3 = 0"), ["sample"])
    return labels.line_truth(t, mapped, ["sample"]).groupBy("line_is_error").agg(F.count("*").alias("n"))


# Candidates.


@query(f"SELECT problem, count(*) AS n_kept, string_agg(CAST(cand AS VARCHAR), ',' ORDER BY cand) AS kept FROM ({CANDIDATES}) WHERE NOT {DROPPED} GROUP BY problem")
def candidate_filter(spark, sf):
    kept = outcomes.filtered(views.candidates(spark, sf))
    rows = outcomes.compacted(kept, "problem", "cand", ["cand"])
    return rows.select("problem", F.col("n_kept").cast("bigint").alias("n_kept"), F.array_join(F.transform("cand", lambda c: c.cast("string")), ",").alias("kept"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE NOT ({DROPPED} OR is_correct)) AS kept, count(*) FILTER (WHERE {DROPPED} OR is_correct) AS dropped, count(*) FILTER (WHERE no_program) AS n_no_program, count(*) FILTER (WHERE no_fix) AS n_no_fix, count(*) FILTER (WHERE line_filter) AS n_line_filter, count(*) FILTER (WHERE no_correct_line) AS n_no_correct_line, count(*) FILTER (WHERE is_correct) AS n_correct FROM ({CANDIDATES})""")
def filter_reason_counts(spark, sf):
    return outcomes.filter_counts(views.candidates(spark, sf), drop_correct=True)


@query(f"""WITH p AS (SELECT problem, count(*) AS n, count(*) FILTER (WHERE NOT {DROPPED}) AS l FROM ({CANDIDATES}) GROUP BY problem)
SELECT count(*) AS rows_total, count(*) FILTER (WHERE coalesce(l, 0) > 0) AS rows_kept, count(*) FILTER (WHERE n > 0 AND l = 0) AS rows_dropped, count(*) FILTER (WHERE n IS NULL) AS rows_empty FROM customer LEFT JOIN p ON c_custkey = problem""")
def row_filter_counts(spark, sf):
    return outcomes.row_counts(views.problems(spark, sf), views.candidates(spark, sf), "problem")


@query(f"SELECT difficulty, count(*) FILTER (WHERE outcome = 'correct') AS correct, count(*) FILTER (WHERE outcome = 'no_program') AS no_program, count(*) FILTER (WHERE outcome = 'tests_failed') AS tests_failed, count(*) AS total FROM ({CANDIDATES}) GROUP BY difficulty")
def outcome_by_difficulty(spark, sf):
    return outcomes.outcomes_by(views.candidates(spark, sf), "difficulty")


@query(f"SELECT problem, bool_or(is_correct) AS any_correct, count(*) AS n, count(*) FILTER (WHERE is_correct) AS n_correct FROM ({CANDIDATES}) GROUP BY problem")
def any_correct(spark, sf):
    return outcomes.any_correct(views.candidates(spark, sf), "problem")


_RANKED = "row_number() OVER ({by} ORDER BY md5('split|' || problem), problem)"


def _cuts(n: str) -> str:
    """Largest-remainder sizes for ratios .6, .2, .2 as SQL: floors, and the rest by fraction, ties to the earlier."""
    fl = [f"floor({n} * {r})" for r in ("CAST(0.6 AS DOUBLE)", "CAST(0.2 AS DOUBLE)", "CAST(0.2 AS DOUBLE)")]
    fr = [f"({n} * {r} - floor({n} * {r}))" for r in ("CAST(0.6 AS DOUBLE)", "CAST(0.2 AS DOUBLE)", "CAST(0.2 AS DOUBLE)")]
    rest = f"({n} - {fl[0]} - {fl[1]} - {fl[2]})"
    a = f"{fl[0]} + CASE WHEN {rest} > (CASE WHEN {fr[1]} > {fr[0]} THEN 1 ELSE 0 END) + (CASE WHEN {fr[2]} > {fr[0]} THEN 1 ELSE 0 END) THEN 1 ELSE 0 END"
    b = f"{fl[1]} + CASE WHEN {rest} > (CASE WHEN {fr[0]} >= {fr[1]} THEN 1 ELSE 0 END) + (CASE WHEN {fr[2]} > {fr[1]} THEN 1 ELSE 0 END) THEN 1 ELSE 0 END"
    return f"{a} AS ca, {b} AS cb"


_SPLIT = "CASE WHEN rk <= ca THEN 'train' WHEN rk <= ca + cb THEN 'validation' ELSE 'test' END"


@query(f"""WITH p AS (SELECT problem, {_RANKED.format(by="")} AS rk, count(*) OVER () AS n FROM ({PROBLEMS})), c AS (SELECT *, {_cuts("n")} FROM p) SELECT problem, {_SPLIT} AS split FROM c""")
def split_exact(spark, sf):
    return splits.split(views.problem_stats(spark, sf), "problem", (0.6, 0.2, 0.2), "split").select("problem", "split")


@query(f"""WITH p AS (SELECT problem, n_correct > 0 AS any_ok, {_RANKED.format(by="PARTITION BY n_correct > 0")} AS rk, count(*) OVER (PARTITION BY n_correct > 0) AS n FROM ({PROBLEMS})), c AS (SELECT *, {_cuts("n")} FROM p) SELECT problem, any_ok, {_SPLIT} AS split FROM c""")
def split_stratified(spark, sf):
    rows = views.problem_stats(spark, sf).withColumn("any_ok", F.col("n_correct") > 0)
    return splits.split(rows, "problem", (0.6, 0.2, 0.2), "split", strata="any_ok").select("problem", "any_ok", "split")


@query()
def split_grouped_greedy(spark, sf):
    return splits.greedy(views.problem_stats(spark, sf), "problem", (0.6, 0.2, 0.2))


@query(f"""WITH p AS (SELECT problem, n, n_correct, {_RANKED.format(by="")} AS rk, count(*) OVER () AS cnt FROM ({PROBLEMS})), c AS (SELECT *, {_cuts("cnt")} FROM p), s AS (SELECT {_SPLIT} AS split, n, n_correct FROM c)
SELECT split, count(*) AS "rows", CAST(sum(n) AS BIGINT) AS candidates, round(sum(n_correct) / CAST(sum(n) AS DOUBLE), 9) AS correct_rate, round(abs(sum(n_correct) / CAST(sum(n) AS DOUBLE) - (SELECT sum(n_correct) / CAST(sum(n) AS DOUBLE) FROM s)), 9) AS rate_gap FROM s GROUP BY split""")
def split_summary(spark, sf):
    return splits.summary(splits.split(views.problem_stats(spark, sf), "problem", (0.6, 0.2, 0.2), "split"))


_RECORDS = "SELECT o_custkey AS task, o_orderkey AS seq, 1 + o_orderkey % 3 AS n FROM orders WHERE o_orderstatus <> 'P'"
_STREAM = "SELECT o_custkey AS task, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag <> 'R' AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS ordinal FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _score_stream(spark, sf):
    o, l = views.table(spark, sf, "orders"), views.table(spark, sf, "lineitem")
    stream = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("task"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("score_seq"), (F.col("l_returnflag") != "R").alias("value"))
    records = o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("seq"), (1 + F.col("o_orderkey") % 3).alias("n"))
    return records, stream


@query(f"""WITH r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY task ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM ({_RECORDS})), p AS (SELECT task, seq, unnest(range(CAST(n AS BIGINT))) AS place, f FROM r)
SELECT p.task, seq, CAST(place AS INTEGER) AS place, coalesce(value, false) AS is_correct, value IS NULL AS padded FROM p LEFT JOIN ({_STREAM}) s ON p.task = s.task AND s.ordinal = f + place""")
def score_cursor_join(spark, sf):
    return outcomes.cursor_joined(*_score_stream(spark, sf), "task", "seq", "n")


@query(f"""WITH g AS (SELECT task, count(*) AS given FROM ({_STREAM}) GROUP BY task), u AS (SELECT task, sum(n) AS wanted FROM ({_RECORDS}) GROUP BY task), b AS (SELECT g.task, given, CAST(least(given, coalesce(wanted, 0)) AS BIGINT) AS consumed FROM g LEFT JOIN u ON g.task = u.task)
SELECT task, given, consumed, given - consumed AS unused FROM b WHERE given > consumed""")
def unused_scores(spark, sf):
    return outcomes.unused_scores(*_score_stream(spark, sf), "task", "n")


# Domains and reports.


@query(f"SELECT domain, count(*) AS tasks FROM (SELECT DISTINCT task, domain FROM ({MAPPED}) WHERE domain IS NOT NULL) GROUP BY domain")
def domain_fanout_counts(spark, sf):
    return domains.pairs(views.task_libs(spark, sf), views.lib_domains(spark, sf)).groupBy("domain").agg(F.count("*").alias("tasks"))


@query(f"SELECT task, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains, coalesce(bool_or(lower(domain) = 'asia'), false) AS is_held_out FROM ({MAPPED}) GROUP BY task")
def domain_holdout(spark, sf):
    rows = domains.held_out(domains.domains_of(views.task_libs(spark, sf), views.lib_domains(spark, sf)), "Asia")
    return rows.select("task", F.array_join("domains", ",").alias("domains"), "is_held_out")


@query(f"SELECT lib, count(DISTINCT task) AS tasks FROM ({MAPPED}) WHERE domain IS NULL GROUP BY lib")
def unmapped_libs(spark, sf):
    return domains.unmapped(views.task_libs(spark, sf), views.lib_domains(spark, sf))


@query(f"SELECT model, first(baseline ORDER BY roc_auc DESC, ord) AS baseline, max(roc_auc) AS roc_auc FROM ({RESULTS}) WHERE rank <> 'home' GROUP BY model")
def best_auc_per_model(spark, sf):
    return reports.best_auc(views.results(spark, sf), exclude="home")


@query(f"""WITH r AS ({RESULTS}), h AS (SELECT model, max(roc_auc) AS ha FROM r WHERE rank = 'home' GROUP BY model), j AS (SELECT r.model, ha - roc_auc AS d, greatest(ha - roc_auc, 0) AS s FROM r JOIN h USING (model) WHERE rank = 'away')
SELECT model, count(*) AS n, round(avg(s), 9) AS mean_shortfall, round(coalesce(stddev_samp(s), 0), 9) AS std_shortfall, round(avg(d), 9) AS mean_drop, round(avg(CASE WHEN s < 0.05 THEN 1.0 ELSE 0.0 END), 9) AS within FROM j GROUP BY GROUPING SETS ((model), ())""")
def ood_shortfall(spark, sf):
    rows = views.results(spark, sf)
    home = reports.best_auc(rows.where("rank = 'home'"))
    return reports.shortfall(home, rows.where("rank = 'away'"))


@query(f"""WITH v AS (SELECT model, list(roc_auc ORDER BY ord) AS v, count(*) AS n FROM ({RESULTS}) GROUP BY model), d AS (SELECT model, s, v[1 + CAST(CAST(('0x' || substring(md5('boot|' || s || '|' || j), 1, 8)) AS BIGINT) % n AS INTEGER)] AS x, n, j FROM v, range(200) a(s), range(100) b(j) WHERE j < n),
m AS (SELECT model, s, sum(x ORDER BY j) / max(n) AS m FROM d GROUP BY model, s), l AS (SELECT model, list(m ORDER BY m) AS l FROM m GROUP BY model) SELECT model, round(l[5], 9) AS low, round(l[195], 9) AS high FROM l""")
def bootstrap_ci(spark, sf):
    rows = views.results(spark, sf).select("model", F.col("ord").alias("id"), F.col("roc_auc").alias("value"))
    return reports.bootstrap(rows, 200, "boot", ["model"])


@query()
def bootstrap_replay(spark, sf):
    rows = views.results(spark, sf).select("model", F.col("ord").alias("id"), F.col("roc_auc").alias("value"))
    return reports.replayed_bootstrap(rows, 2000)


# Token selections.

_R = "row_number() OVER (PARTITION BY \"user\" ORDER BY score DESC, pos)"


@query()
def bootstrap_of_tokens(spark, sf):
    """Intervals of the mean score of every line number's tokens, by resamples that are summed cell by cell."""
    l = views.table(spark, sf, "lineitem")
    ids = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = l.select(F.col("l_returnflag").alias("flag"), ids.alias("id"), (F.col("l_discount") * 10).alias("value"))
    return reports.large_bootstrap(rows, 400, 42, ["flag"])


@query(f"SELECT \"user\", pos, score FROM (SELECT *, {_R} AS rk FROM ({SCORES})) WHERE rk <= 3")
def topk_entropy_k(spark, sf):
    return selection.top_scored(views.scores(spark, sf), ["user"], k=3).select("user", "pos", "score")


@query(f"SELECT \"user\", pos FROM (SELECT *, {_R} AS rk, count(*) OVER (PARTITION BY \"user\") AS n FROM ({SCORES})) WHERE rk <= greatest(1, floor(n * 0.05))")
def topk_entropy_quantile(spark, sf):
    return selection.top_scored(views.scores(spark, sf), ["user"]).select("user", "pos")


@query(f"SELECT \"user\", pos FROM (SELECT *, {_R} AS rk, count(*) OVER (PARTITION BY \"user\") AS n FROM ({SCORES}) WHERE score >= 5.5 AND score <= 60) WHERE rk <= greatest(1, floor(n * 0.2))")
def topk_entropy_range(spark, sf):
    return selection.top_scored(views.scores(spark, sf), ["user"], quantile=0.2, least=5.5, most=60).select("user", "pos")


@query(f"SELECT \"user\", pos, false AS appended FROM (SELECT *, {_R} AS rk FROM ({SCORES})) WHERE rk <= 2 UNION ALL SELECT \"user\", max(pos), true FROM ({SCORES}) GROUP BY \"user\"")
def topk_append_last(spark, sf):
    s = views.scores(spark, sf)
    return selection.with_last(selection.top_scored(s, ["user"], k=2), s, ["user"])


@query(f"SELECT \"user\", line, pos FROM (SELECT *, row_number() OVER (PARTITION BY \"user\", line ORDER BY score, pos) AS rk FROM ({SCORES})) WHERE rk <= 2")
def topk_per_line(spark, sf):
    return selection.top_per_line(views.scores(spark, sf), ["user"], k=2).select("user", "line", "pos")


@query(f"SELECT \"user\", arg_min(pos, (k, pos)) AS pos FROM ({SCORES}) GROUP BY \"user\", line UNION SELECT \"user\", max(pos) FROM ({SCORES}) GROUP BY \"user\"")
def newline_first_token(spark, sf):
    return selection.first_of_line(views.scores(spark, sf), ["user"], "k")


@query(f"WITH s AS ({SCORES}) SELECT \"user\", pos FROM s WHERE node_type <> 'click'")
def exclude_node_types(spark, sf):
    s = views.scores(spark, sf)
    return selection.excluded(s, s.where("node_type = 'click'"), ["user"]).select("user", "pos")


@query(f"""WITH s AS ({SCORES}), c AS (SELECT \"user\", count(*) FILTER (WHERE score > 90) AS n, min(pos) AS a, max(pos) AS b FROM s GROUP BY \"user\") SELECT s.\"user\", pos FROM s WHERE score > 90 UNION SELECT \"user\", unnest([a, b]) FROM c WHERE n = 0""")
def fallback_first_last(spark, sf):
    s = views.scores(spark, sf)
    return selection.or_first_last(s.where("score > 90"), s, ["user"])


@query(f"""WITH e AS (SELECT \"user\", max(pos) AS l, CAST(greatest(1, ceil(count(*) * 0.3)) AS BIGINT) AS tail FROM ({SCORES}) GROUP BY \"user\") SELECT \"user\", tail, l - CAST('0x' || substring(md5('tail|' || \"user\"), 1, 8) AS BIGINT) % tail AS pos FROM e""")
def random_tail_pick(spark, sf):
    return selection.tail_pick(views.scores(spark, sf), ["user"], 0.3, "tail")


@query(f"""WITH c AS (SELECT \"user\", CAST(count(*) AS BIGINT) AS n, min(CASE WHEN node_type = 'purchase' THEN pos END) AS a FROM ({SCORES}) GROUP BY \"user\") SELECT \"user\", a AS start, n - 2 AS "end" FROM c WHERE a IS NOT NULL AND n - 2 >= a""")
def sequence_bounds(spark, sf):
    c = views.scores(spark, sf).groupBy("user").agg(F.count("*").alias("assistant_tokens"), F.min(F.when(F.col("node_type") == "purchase", F.col("pos"))).alias("span_start"))
    rows = c.withColumn("span_end", F.when(F.col("span_start").isNotNull(), F.col("span_start") + 1))
    return selection.sequence_bounds(rows).select("user", "start", "end")


@query(f"SELECT \"user\", min(pos) AS \"end\" FROM ({SCORES}) WHERE k = 7 GROUP BY \"user\"")
def first_marker_realign(spark, sf):
    return selection.realigned_end(views.scores(spark, sf), ["user"], F.col("k") == 7)


_SHARES = f"SELECT \"user\", k, avg(CASE WHEN score < 10 THEN 100.0 ELSE 0.0 END) AS share FROM ({SCORES}) GROUP BY \"user\", k"


@query(f"""WITH s AS ({_SHARES}), l AS (SELECT list(share ORDER BY share) AS l, count(*) AS n, avg(share) AS m, quantile_cont(share, 0.5) AS md FROM s), w AS (SELECT avg(d) AS d FROM (SELECT stddev_pop(share) AS d FROM s GROUP BY \"user\" HAVING count(*) >= 2))
SELECT n, round(m, 6) AS mean, round(md, 6) AS median, round(l[1 + CAST(round_even(0.9 * (n - 1), 0) AS INTEGER)], 6) AS p90, round(d, 6) AS within_row_std FROM l, w""")
def false_pct_stats(spark, sf):
    rows = views.scores(spark, sf).groupBy("user", "k").agg(F.avg(F.when(F.col("score") < 10, 100.0).otherwise(0.0)).alias("share"))
    return reports.share_stats(rows, "share", "user")


@query("""WITH l AS (SELECT event_type, list(value ORDER BY value) AS l, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, n, l[1 + CAST(round_even(0.1 * (n - 1), 0) AS INTEGER)] AS p10, l[1 + CAST(round_even(0.5 * (n - 1), 0) AS INTEGER)] AS p50, l[1 + CAST(round_even(0.9 * (n - 1), 0) AS INTEGER)] AS p90 FROM l""")
def percentile_nearest_rank(spark, sf):
    return reports.percentiles(views.table(spark, sf, "events"), "value", (10.0, 50.0, 90.0), ["event_type"])


@query(f"""SELECT count(*) AS n, round(corr(n, e), 6) AS r FROM (SELECT sample, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE wrong) AS DOUBLE) AS e FROM ({TOKENS}) GROUP BY sample)""")
def pearson_len_error(spark, sf):
    per = views.tokens(spark, sf).groupBy("sample").agg(F.count("*").cast("double").alias("n_tok"), F.count_if(~F.col("tok_is_correct")).cast("double").alias("n_err"))
    return reports.pearson(per, "n_tok", "n_err")


# Responses.


@query("""SELECT lang AS difficulty, CASE WHEN coalesce(quality = 1, false) THEN 'correct' WHEN trim(text) = '' THEN 'no_program' ELSE 'tests_failed' END AS outcome, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def outcome_bucket(spark, sf):
    rows = views.responses(spark, sf).withColumn("outcome", outcomes.outcome(F.col("text"), F.col("is_correct")))
    return rows.groupBy("difficulty", "outcome").agg(F.count("*").alias("n"))


@query("""SELECT lang, count(*) AS docs, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines, max(length(text) - length(replace(text, chr(10), '')) + 1) AS most FROM documents GROUP BY lang""")
def line_count_stats(spark, sf):
    d = views.table(spark, sf, "documents").select("lang", scalars.line_of(F.col("text"), F.length("text")).cast("bigint").alias("n"))
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("lines"), F.max("n").alias("most"))


@query("""SELECT doc_id, CAST(list_sum(list_transform(regexp_extract_all(text, '#[^\\n]*'), lambda x: length(x))) AS BIGINT) AS comment_chars FROM documents WHERE contains(text, '#')""")
def comment_mask_chars(spark, sf):
    d = views.table(spark, sf, "documents").where(F.contains("text", F.lit("#")))
    return d.select("doc_id", scalars.comment_chars(F.col("text")).alias("comment_chars"))


@query("""SELECT CASE WHEN k % 4 = 0 THEN 'true' WHEN k % 4 = 1 THEN '1' WHEN k % 4 = 2 THEN 'passed' ELSE 'no' END AS raw, bool_and(k % 4 < 2) AS as_flag, bool_and(k % 4 < 3) AS as_score, count(*) AS n FROM (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1""")
def truthiness_normalise(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 4
    raw = F.when(k == 0, "true").when(k == 1, "1").when(k == 2, "passed").otherwise("no")
    rows = views.table(spark, sf, "events").select(raw.alias("raw"))
    return rows.groupBy("raw").agg(F.min(scalars.truthy(F.col("raw"))).alias("as_flag"), F.min(scalars.truthy_score(F.col("raw"))).alias("as_score"), F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT line, sample, count(*) AS n, count(*) FILTER (WHERE wrong) AS e FROM ({TOKENS}) WHERE NOT masked GROUP BY line, sample)
SELECT coalesce(CAST(line AS VARCHAR), 'all') AS line, count(*) AS samples, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(e) AS BIGINT) AS errors, round(100.0 * sum(e) / CAST(sum(n) AS DOUBLE), 6) AS micro_pct, round(100.0 * avg(e / CAST(n AS DOUBLE)), 6) AS macro_pct FROM p GROUP BY GROUPING SETS ((p.line), ())""")
def macro_vs_micro_distribution(spark, sf):
    rows = reports.label_distribution(views.tokens(spark, sf), "line", ["sample"])
    return rows.withColumn("line", F.coalesce(F.col("line").cast("string"), F.lit("all")))


_LABELLED = "SELECT conv_id AS sample_id, turn AS cand_idx, CASE WHEN turn % 5 = 3 THEN NULL ELSE sha1(text) END AS h, CASE WHEN conv_id % 2 = 0 THEN 'train' ELSE 'test' END AS ex FROM conversations"
_FEATURED = "SELECT conv_id AS sample_id, 'a' AS entry, 'train' AS split, 0 AS prio, turn AS fi, sha1(text) AS fh FROM conversations WHERE turn % 3 <> 1 UNION ALL SELECT conv_id, 'b', 'test', 1, turn + 1, sha1(text) FROM conversations"


@query(f"""WITH l AS ({_LABELLED}), f AS ({_FEATURED}), b AS (SELECT l.sample_id, cand_idx, ex, entry, split, prio, fi, 0 AS m FROM l JOIN f ON l.sample_id = f.sample_id AND cand_idx = fi WHERE h IS NULL OR fh IS NULL OR h = fh UNION ALL SELECT l.sample_id, cand_idx, ex, entry, split, prio, fi, 1 FROM l JOIN f ON l.sample_id = f.sample_id AND h = fh),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, cand_idx ORDER BY CASE WHEN split = ex THEN 0 ELSE 1 END, prio, entry, m, CAST(fi AS VARCHAR)) AS rk FROM b) SELECT sample_id, cand_idx, entry, split, fi AS feature_idx, CASE WHEN m = 0 THEN 'index' ELSE 'fingerprint' END AS method FROM r WHERE rk = 1""")
def fingerprint_match(spark, sf):
    c = views.table(spark, sf, "conversations")
    left = c.select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("cand_idx"), F.when(F.col("turn") % 5 != 3, F.sha1("text")).alias("token_hash"), F.when(F.col("conv_id") % 2 == 0, "train").otherwise("test").alias("expected_split"))
    entry = lambda rows, name, split, prio, shift: rows.select(F.col("conv_id").alias("sample_id"), F.lit(name).alias("entry"), F.lit(split).alias("split"), F.lit(prio).alias("split_priority"), (F.col("turn") + shift).alias("cand_idx"), F.sha1("text").alias("token_hash"))
    return features.matched(left, entry(c.where("turn % 3 <> 1"), "a", "train", 0, 0).unionByName(entry(c, "b", "test", 1, 1)))


@query("SELECT event_id, sha1('[' || k || ',' || (k + 1) || ']') AS fp FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def token_fingerprint(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return views.table(spark, sf, "events").select("event_id", features.fingerprint(F.array(k, k + 1)).alias("fp"))


# Vectors.

_VECTORS = "SELECT vec_id, label, layer, embedding[layer * 16 + 1 : layer * 16 + 16] AS vec FROM embeddings, range(4) t(layer)"


@query("SELECT vec_id, CAST(layer * 16 + i AS INTEGER) AS dim, CAST(embedding[(layer * 16 + i + 1)] AS FLOAT) AS value FROM embeddings, (VALUES (1), (3)) t(layer), range(16) u(i)")
def concat_layers(spark, sf):
    rows = features.concatenated(views.vectors(spark, sf).where("layer in (1, 3)"), ["vec_id"])
    long = rows.select("vec_id", F.posexplode("vec").alias("i", "value"))
    return long.select("vec_id", F.when(F.col("i") < 16, F.col("i") + 16).otherwise(F.col("i") + 32).alias("dim"), "value")


@query("SELECT vec_id, CAST(i AS INTEGER) AS dim, round((CAST(embedding[i + 1] AS DOUBLE) + embedding[i + 17] + embedding[i + 33] + embedding[i + 49]) / 4, 6) AS value FROM embeddings, range(16) t(i)")
def average_layers(spark, sf):
    rows = features.averaged(views.vectors(spark, sf), ["vec_id"])
    return rows.select("vec_id", F.posexplode("vec").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("""WITH v AS (SELECT vec_id, layer AS pos, 1 + vec_id % 4 AS n FROM embeddings, range(4) t(layer) WHERE layer <= vec_id % 4), r AS (SELECT vec_id, pos, n, unnest([0, -1, -2, -3]) AS requested, row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS i FROM v)
SELECT vec_id, requested, CAST(pos AS INTEGER) AS pos FROM r WHERE CASE WHEN requested >= 0 THEN pos = requested ELSE n BETWEEN 2 AND 4 AND (-requested <= least(n - 1, 3) OR (n = 3 AND requested = -3)) AND i = n + requested + 1 END""")
def negative_position(spark, sf):
    rows = views.vectors(spark, sf).where("pos <= vec_id % 4").withColumn("layer", F.lit(0))
    return features.resolved_positions(rows, ["vec_id"], [0, -1, -2, -3]).select("vec_id", "requested", "pos")


@query("SELECT vec_id, round(sum(x) , 6) AS total FROM (SELECT vec_id, unnest(list_transform(embedding, lambda e: CAST(e AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))) AS x FROM embeddings) GROUP BY vec_id")
def l2_normalise(spark, sf):
    e = views.table(spark, sf, "embeddings").select("vec_id", features.normalised(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0")
def required_features_semi(spark, sf):
    rows = views.vectors(spark, sf).where("not (vec_id % 3 = 0 and layer = 2)").withColumn("pos", F.lit(0))
    keys = features.having_all(rows, ["vec_id"], [0, 2], [0])
    return rows.join(keys, "vec_id", "left_semi").select("vec_id").distinct()


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e) SELECT vec_id, round(-list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)), 6) AS entropy FROM p""")
def token_entropy(spark, sf):
    return views.table(spark, sf, "embeddings").select("vec_id", F.round(scalars.token_entropy(F.col("embedding")), 6).alias("entropy"))


def _digamma(x: str) -> str:
    """Digamma for x >= 1 as SQL: seven steps of the recurrence, then the asymptotic series."""
    y = f"({x} + 7)"
    steps = " - ".join(f"1 / ({x} + {k})" for k in range(7))
    return f"(ln({y}) - 0.5 / {y} - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) + 1 / (240 * {y} ** 8) - 1 / (132 * {y} ** 10) - {steps})"


@query(f"""WITH a AS (SELECT vec_id, list_transform(list_reverse_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))[1:25], lambda x: greatest(x, 0) + 1) AS a FROM embeddings),
t AS (SELECT vec_id, a, list_sum(a) AS t FROM a), d AS (SELECT vec_id, t, len(a) AS n, unnest(a) AS x FROM t)
SELECT vec_id, round(sum(x / t * ({_digamma("(x + 1)")} - {_digamma("(t + 1)")})) * max(n) / max(t), 6) AS reliability FROM d GROUP BY vec_id""")
def logtoku_reliability(spark, sf):
    from ..functions.arrow import logtoku

    return views.table(spark, sf, "embeddings").select("vec_id", F.round(logtoku("embedding"), 6).alias("reliability"))


@query()
def gbt_probe_metrics(spark, sf):
    rows = probes.prepared(views.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"), (F.col("label") >= 4).alias("y")))
    train, test = rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0")
    got = probes.scores(probes.fitted("gbt", train, 64, weighted=True), test)
    return metrics.roc_auc(got, F.col("y") > 0, F.col("score"))


@query()
def pca2(spark, sf):
    return probes.in_two_dimensions(views.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec")), ["vec_id"])


# Turns.


@query("SELECT CAST(conv_id AS VARCHAR) AS task_id, coalesce(text, '') AS solution FROM conversations")
def flatten_samples(spark, sf):
    from ..sources.writers import flat_samples

    return flat_samples(views.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("sample_id"), F.col("text").alias("program")))


@query("SELECT conv_id, turn, array_to_string(str_split(text, ' ')[3:7], ' ') AS part FROM conversations")
def prompt_prefix_slice(spark, sf):
    c = views.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(scalars.token_slice(F.split("text", " "), F.lit(1), F.lit(5), F.lit(1)), " ").alias("part"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rk FROM conversations) WHERE rk <= 2")
def turn_window_limit(spark, sf):
    return selection.limited(views.table(spark, sf, "conversations"), ["conv_id"], ["turn"], 2).select("conv_id", "turn", "role")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-06-30'")
def date_window(spark, sf):
    return views.table(spark, sf, "orders").where(scalars.within_dates(F.col("o_orderdate"), "1995-01-01", "1995-06-30")).select("o_orderkey")


@query("SELECT conv_id, turn, CASE WHEN length(text) <= 20 THEN text ELSE left(text, 10) || '...' || right(text, 10) END AS short FROM conversations")
def middle_truncation(spark, sf):
    return views.table(spark, sf, "conversations").select("conv_id", "turn", scalars.shortened(F.col("text"), 20).alias("short"))


# Further operators on the same views.


@query(f"""WITH c AS (SELECT line, count(*) AS n, avg(CASE WHEN wrong THEN -ln(least(greatest(score, 1e-7), 1 - 1e-7)) ELSE -ln(1 - least(greatest(score, 1e-7), 1 - 1e-7)) END) AS l, count(*) FILTER (WHERE score >= 0.5 AND wrong) AS tp, count(*) FILTER (WHERE score >= 0.5 AND NOT wrong) AS fp, count(*) FILTER (WHERE score < 0.5 AND wrong) AS fn FROM ({TOKENS}) GROUP BY line)
SELECT line, n, round(l, 6) AS log_loss, round((n - fp - fn) / CAST(n AS DOUBLE), 9) AS accuracy, {f1_sql()} AS f1 FROM c""")
def evaluation_metrics(spark, sf):
    return metrics.evaluation(views.tokens(spark, sf), ~F.col("tok_is_correct"), F.col("score"), by=["line"])


@query(f"""WITH t AS (SELECT sample, count(*) FILTER (WHERE NOT wrong) AS a, count(*) FILTER (WHERE wrong) AS b FROM ({TOKENS}) WHERE NOT masked AND sample % 4 <> 0 GROUP BY sample),
m AS (SELECT sample, line, NOT bool_or(wrong AND NOT masked) AS clean FROM ({TOKENS}) GROUP BY sample, line), l AS (SELECT sample, count(*) FILTER (WHERE clean) AS a, count(*) FILTER (WHERE NOT clean) AS b FROM m GROUP BY sample)
SELECT l.sample, coalesce(t.a, l.a) AS n_true, coalesce(t.b, l.b) AS n_false, CASE WHEN t.a IS NULL THEN 'lines' ELSE 'tokens' END AS level FROM l LEFT JOIN t ON l.sample = t.sample""")
def label_counts_fallback(spark, sf):
    t = views.tokens(spark, sf)
    return labels.label_counts(t.where("sample % 4 <> 0"), labels.line_error_map(t, ["sample"]), ["sample"])


@query("SELECT l_shipdate_year AS year, count(*) AS tokens FROM (SELECT year(l_shipdate) AS l_shipdate_year FROM lineitem) GROUP BY 1 ORDER BY tokens DESC, year LIMIT 3")
def largest_groups(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("year"))
    return labels.largest_groups(rows, "year", 3)


@query("""WITH v AS (SELECT vec_id, layer AS pos, 1 + vec_id % 4 AS n, row_number() OVER (PARTITION BY vec_id ORDER BY layer) AS i FROM embeddings, range(4) t(layer) WHERE layer <= vec_id % 4)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, CASE WHEN n NOT BETWEEN 2 AND 4 THEN CAST(pos AS VARCHAR) WHEN i = 1 THEN 'first' WHEN i = n THEN 'last' WHEN i = n - 1 THEN 'second_last' ELSE 'second' END AS role FROM v""")
def role_positions(spark, sf):
    rows = views.vectors(spark, sf).where("pos <= vec_id % 4")
    return features.role_positions(rows, ["vec_id"]).select("vec_id", "pos", "role")


@query("SELECT vec_id FROM embeddings ORDER BY md5('sub|' || vec_id), vec_id LIMIT 50")
def random_subsample(spark, sf):
    return features.subsample(views.table(spark, sf, "embeddings").select("vec_id"), "vec_id", 50, "sub")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)")
def three_way_labels(spark, sf):
    return views.responses(spark, sf).select("doc_id", features.three_way(F.col("is_correct")).alias("verdict"))


@query(f"""WITH s AS ({SCORES}), l AS (SELECT "user", unnest([0, 1, 2]) AS tok_idx, min(pos) + 1 AS code_start FROM s GROUP BY "user") SELECT l."user", tok_idx, code_start + tok_idx AS pos, score FROM l JOIN s ON l."user" = s."user" AND s.pos = code_start + tok_idx""")
def label_feature_by_position(spark, sf):
    """Labels joined to features that are stored by user and position."""
    s = views.scores(spark, sf)
    starts = s.groupBy("user").agg((F.min("pos") + 1).alias("code_start"))
    labelled = starts.select("user", "code_start", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("tok_idx"))
    at = folder(spark, "positions")
    name, buckets = f"features_{at.rpartition('-')[2]}", max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    writers.bucketed(s.select("user", "pos", "score"), name, at, ["user", "pos"], buckets)
    stored = readers.bucketed(spark, name, at, "user bigint, pos bigint, score double", ["user", "pos"], buckets)
    return labels.at_positions(labelled, stored, ["user"]).select("user", "tok_idx", "pos", "score")


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) WHERE i >= 20 AND i < 50")
def row_window_relative(spark, sf):
    return selection.row_window(views.table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 20, 30)


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) WHERE i >= 20 AND i < 30")
def row_window_absolute(spark, sf):
    return selection.row_window(views.table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 20, 30, absolute=True)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 <= o_orderkey % 11 THEN CAST(o_orderkey % 11 - o_custkey % 7 AS INTEGER) ELSE -1 END AS width FROM orders")
def code_range_valid(spark, sf):
    span = scalars.valid_range((F.col("o_custkey") % 7).cast("string"), (F.col("o_orderkey") % 11).cast("string"))
    return views.table(spark, sf, "orders").select("o_orderkey", F.coalesce(span["end"] - span["start"], F.lit(-1)).alias("width"))


@query("SELECT vec_id, embedding[1 + greatest(vec_id % 64 - 1, 0)] AS logit FROM embeddings")
def shifted_gather(spark, sf):
    return views.table(spark, sf, "embeddings").select("vec_id", scalars.shifted(F.col("embedding"), F.col("vec_id") % 64).alias("logit"))


@query("SELECT role, CASE WHEN role IN ('val', 'valid', 'validation', 'dev') THEN 'validation' WHEN role IN ('train', 'training') THEN 'train' WHEN role IN ('test', 'testing') THEN 'test' ELSE role END AS split, n FROM (SELECT CASE CAST(turn % 4 AS INTEGER) WHEN 0 THEN 'val' WHEN 1 THEN 'training' WHEN 2 THEN 'test' ELSE role END AS role, count(*) AS n FROM conversations GROUP BY 1)")
def canonical_splits(spark, sf):
    raw = F.when(F.col("turn") % 4 == 0, "val").when(F.col("turn") % 4 == 1, "training").when(F.col("turn") % 4 == 2, "test").otherwise(F.col("role"))
    rows = views.table(spark, sf, "conversations").groupBy(raw.alias("role")).agg(F.count("*").alias("n"))
    return rows.select("role", scalars.canonical_split(F.col("role")).alias("split"), "n")


@query("SELECT o_orderkey, o_orderkey % 7 IN (0, 2, 4, 6) AS same FROM orders")
def graded_output(spark, sf):
    """Outputs that agree as text, as numbers of any length and form, or not."""
    k = F.col("o_orderkey")
    s = k.cast("string")
    zeros = lambda n: F.lit("0" * n)
    pairs = [
        (F.concat(s, F.lit(".50 x\nlast")), F.concat(s, F.lit(".50 x \n last "))),
        (F.concat(F.lit("0."), zeros(30), s), F.concat(F.lit("0."), zeros(31), s)),
        (F.concat(s, F.lit("9" * 24)), F.concat(F.lit(" +"), s, F.lit("9" * 24 + ".0"))),
        (F.concat(s, F.lit("1" * 24)), F.concat(s, F.lit("1" * 23 + "2"))),
        (F.concat(s, F.lit("e-19 -0.0 inf")), F.concat(F.lit("0."), F.lpad(F.concat(s, F.lit("00")), 21, "0"), F.lit("  0 Infinity"))),
        (F.lit("nan"), F.lit("NaN")),
        (F.concat(F.lit("1_0"), s, F.lit("\n\n.5")), F.concat(F.lit("10"), s, F.lit("\n\n5E-1"))),
    ]
    want, got = (F.coalesce(*[F.when(k % 7 == i, p[side]) for i, p in enumerate(pairs)]) for side in (0, 1))
    return views.table(spark, sf, "orders").select("o_orderkey", scalars.same_output(want, got).alias("same"))


@query("SELECT o_custkey, bool_and(o_orderstatus = 'F') AS verdict FROM orders GROUP BY o_custkey")
def candidate_verdict(spark, sf):
    rows = views.table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderstatus") == "F").alias("r"))
    return rows.select("o_custkey", outcomes.verdict(F.col("r")).alias("verdict"))


@query(f"""WITH p AS (SELECT sample, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE NOT wrong OR masked) AS t, count(*) FILTER (WHERE masked) AS m FROM ({TOKENS}) GROUP BY sample)
SELECT count(*) AS candidates, round(100 * avg(t / n - least(m / n, t / n)), 6) AS true_pct, round(100 * avg(1 - t / n), 6) AS false_pct, round(100 * avg(least(m / n, t / n)), 6) AS masked_pct FROM p""")
def macro_shares(spark, sf):
    return reports.macro_shares(views.tokens(spark, sf), ["sample"])


@query("""SELECT 'known' AS kind, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 10 UNION ALL SELECT 'unknown', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey < 10)""")
def unknown_problem_audit(spark, sf):
    known, unknown = outcomes.known_and_unknown(views.candidates(spark, sf), views.table(spark, sf, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("problem")), "problem")
    return known.agg(F.count("*").alias("n")).select(F.lit("known").alias("kind"), "n").union(unknown.agg(F.count("*").alias("n")).select(F.lit("unknown").alias("kind"), "n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import further, programs  # noqa: F401  they add their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)

