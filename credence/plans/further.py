"""Further named queries: sources and sinks that are written and read again, text and spans, selections by strategy, probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrow, scalars, spans
from ..operators import domains, features, labels, metrics, outcomes, probes, selection
from ..operators.ranges import running, with_cells
from ..sources import readers, writers
from ..sources.scratch import folder, stored
from . import views
from .catalogue import MAPPED, RESULTS, SCORES, TOKENS, query

# Sources and sinks.


@query("SELECT vec_id, layer, round(embedding[layer * 16 + 1], 6) AS first FROM embeddings, (VALUES (1), (3)) t(layer) WHERE vec_id % 3 <> 0")
def features_scan(spark, sf):
    """Features written by split and layer; of the train split two layers are read."""
    at = folder(spark, "features")
    writers.features(views.vectors(spark, sf).withColumn("split", F.when(F.col("vec_id") % 3 == 0, "test").otherwise("train")), at)
    rows = readers.features(spark, at, "train").where(F.col("layer").isin(1, 3))
    return rows.select("vec_id", "layer", F.round(F.get("vec", F.lit(0)), 6).alias("first"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'p' || doc_id ELSE 'd' || doc_id END AS sample_id FROM documents")
def sample_ids(spark, sf):
    d = views.table(spark, sf, "documents")
    name = F.concat(F.lit("/x/y.z/d"), F.col("doc_id").cast("string"), F.lit("__layer_3.pt"))
    return d.select("doc_id", scalars.sample_id(F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("p"), F.col("doc_id").cast("string"))), name).alias("sample_id"))


@query("SELECT o_orderkey AS question_id, row_number() OVER (ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-06-30'")
def problem_catalogue(spark, sf):
    """A catalogue as JSON lines, read between two dates in order of id."""
    at = folder(spark, "problems")
    views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderdate").alias("contest_date")).write.json(at)
    rows = readers.problems(spark, at, "1995-01-01", "1995-06-30")
    counted = with_cells(rows.select("question_id"), "question_id", "cell").groupBy("cell", "question_id").agg(F.count("*").alias("n"))
    return running(counted, "question_id", "cell", "n").select("question_id", (F.col("_before") + 1).alias("nth"))


@query("SELECT n_name AS lib, r_name AS domain FROM nation JOIN region ON n_regionkey = r_regionkey")
def domain_dimension(spark, sf):
    """A flat JSON object of names, written and read as rows."""
    at = folder(spark, "domains")
    whole = views.lib_domains(spark, sf).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("lib", "domain")))).alias("value"))  # a dimension
    whole.write.text(at)
    return readers.domain_map(spark, at)


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, lang, count(*) AS n FROM documents GROUP BY ALL")
def split_files(spark, sf):
    """JSON lines in a folder for each split, read back with the split that names it."""
    at = folder(spark, "splits")
    writers.split_json(views.table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split")), at)
    paths, _ = readers.split_paths([f"train={at}/split=train", f"test={at}/split=test", "neither"])
    return readers.split_records(spark, paths, "doc_id bigint, lang string").groupBy("split", "lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 1 AS n, CASE WHEN doc_id % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM documents WHERE doc_id IS NOT NULL")
def resumed_output(spark, sf):
    """A sink of which one run ended, the next died with its batch written but not committed, and two more went on: every row is there once."""
    at = folder(spark, "resumed")
    rows = views.table(spark, sf, "documents").where("doc_id is not null").select("doc_id", "lang")
    writers.resumed(rows.where("doc_id % 3 = 0").withColumn("run", F.lit("first")), "doc_id", at)
    writers.batch(rows.where("doc_id % 2 = 0").withColumn("run", F.lit("died")), at)
    for run in ("second", "third"):
        writers.resumed(rows.withColumn("run", F.lit(run)), "doc_id", at)
    return readers.committed(spark, at, "doc_id bigint, run string").groupBy("doc_id", "run").agg(F.count("*").cast("int").alias("n"))


@query("""WITH t AS (SELECT vec_id, 'test' AS split FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, 'train' FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 6 = 0),
n AS (SELECT vec_id, count(*) AS n FROM t GROUP BY vec_id)
SELECT split, CAST(4 AS BIGINT) AS files_scanned, CAST(4 AS BIGINT) AS files_loaded, CAST(0 AS BIGINT) AS files_skipped, count(*) AS "rows", count(DISTINCT vec_id) AS samples, count(DISTINCT vec_id) FILTER (WHERE n > 1) AS collisions FROM t JOIN n USING (vec_id) GROUP BY split
UNION ALL SELECT 'broken', 2, 0, 2, 0, 0, 0""")
def features_audit(spark, sf):
    """Feature files of two splits that share samples, and a split of files that are none: what was scanned, loaded and skipped."""
    at = folder(spark, "scanned")
    rows = views.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), F.col("embedding").alias("vec"))
    k = F.col("sample_id").cast("bigint")
    rows.where(k % 3 == 0).repartition(4).write.parquet(f"{at}/split=test")
    rows.where((k % 3 != 0) | (k % 6 == 0)).repartition(4).write.parquet(f"{at}/split=train")
    rows.select("sample_id").repartition(2).write.text(f"{at}/split=broken")
    _, audit = readers.audited_features(spark, at, "sample_id string, vec array<float>")
    return audit


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN o_orderstatus END AS input, CASE WHEN o_orderkey % 6 < 5 THEN 'x' || o_orderkey END AS output FROM orders")
def stored_test_cases(spark, sf):
    """Test cases in each of the forms in which they are stored, and in one that would call something, which gives none."""
    k = F.col("o_orderkey")
    case = F.to_json(F.array(F.struct(F.col("o_orderstatus").alias("input"), F.concat(F.lit("x"), k.cast("string")).alias("output"), F.lit("stdin").alias("testtype"))))
    rows = views.table(spark, sf, "orders").select("o_orderkey", arrow.stored_cases(case, (k % 6).cast("int")).alias("stored"))
    cases = rows.select("o_orderkey", arrow.test_cases("stored").alias("c"))
    return cases.select("o_orderkey", F.get("c", F.lit(0))["input"].alias("input"), F.get("c", F.lit(0))["output"].alias("output"))


@query("SELECT count(*) AS docs, count(DISTINCT lang) AS langs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def statistics_sidecar(spark, sf):
    at = folder(spark, "statistics")
    d = views.table(spark, sf, "documents")
    writers.statistics(d.agg(F.count("*").alias("docs"), F.count_distinct("lang").alias("langs"), F.sum(F.length("text")).alias("chars")), at)
    return readers.json_lines(spark, at, "docs bigint, langs bigint, chars bigint")


@query(f"SELECT model, baseline, roc_auc, rank FROM ({RESULTS})")
def metric_report(spark, sf):
    """Metric tables rendered as markdown, a section a model, and parsed again."""
    at = folder(spark, "report")
    rows = views.results(spark, sf).withColumn("auc", F.format_string("%.6f", "roc_auc"))
    writers.markdown_tables(rows, "model", "ord", {"baseline": "Baseline Model", "auc": "ROC_AUC", "rank": "Rank"}).write.text(at)
    texts = spark.read.text(at, wholetext=True).select(F.input_file_name().alias("source"), "value")
    return readers.metric_tables(texts).select("model", "baseline", "roc_auc", "rank")


def _records(spark, sf):
    """Orders as JSON records of candidates (customers' problems), written and read with the fixed schema."""
    at = folder(spark, "records")
    l = views.table(spark, sf, "lineitem")
    token = F.struct(F.col("l_partkey").alias("token_id"), F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("token_text"), (F.col("l_returnflag") != "R").alias("label"), F.col("l_linenumber").alias("line"), (F.col("l_linestatus") == "O").alias("ws_comment"))
    per = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(token)).alias("t"), F.count("*").alias("n"))
    k = F.col("l_orderkey")
    clean = F.map_from_entries(F.array_distinct(F.transform("t", lambda x: F.struct(x["line"].cast("string"), (x["line"] % 2 == 1).alias("v")))))
    rows = per.select(
        F.concat(F.lit("o"), k.cast("string")).alias("id"),
        F.array(F.lit("first"), F.lit("second")).alias("output"),
        F.when(k % 3 == 0, F.array(F.lit("x = 1"))).otherwise(F.array(F.lit("x = 1"), F.lit("y = 2"))).alias("program"),
        F.when(k % 2 == 0, F.lit("[true, 0]")).otherwise(F.lit('"passed"')).alias("is_correct"),
        F.array(F.array(F.lit(0), F.lit(0)), F.array((k % 7).cast("int"), (k % 7 + F.col("n")).cast("int"))).alias("code_token_idx"),
        F.array(F.col("t")).alias("token_labels"),
        F.array(clean).alias("line_error_map"),
    )
    rows.write.json(at)
    return readers.json_lines(spark, at)


@query("""SELECT 'o' || l_orderkey AS sample_id, CAST(i AS INTEGER) AS cand_idx, CASE WHEN i = 1 AND l_orderkey % 3 = 0 THEN '' WHEN i = 1 THEN 'y = 2' ELSE 'x = 1' END AS program, i = 0 AS is_correct,
CASE WHEN i = 1 AND (l_orderkey % 7 + n) > 0 THEN CAST(l_orderkey % 7 AS INTEGER) END AS span_start, CASE WHEN i = 1 AND (l_orderkey % 7 + n) > 0 THEN CAST(l_orderkey % 7 + n AS INTEGER) END AS span_end FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), range(2) t(i)""")
def candidates_from_records(spark, sf):
    return readers.candidates(_records(spark, sf)).select("sample_id", "cand_idx", "program", "is_correct", "span_start", "span_end")


@query("SELECT 'o' || l_orderkey AS sample_id, l_linenumber AS line, count(*) AS tokens, count(*) FILTER (WHERE l_returnflag = 'R') AS wrong, count(*) FILTER (WHERE l_linestatus = 'O') AS masked FROM lineitem GROUP BY ALL")
def tokens_from_records(spark, sf):
    return readers.tokens(_records(spark, sf)).groupBy("sample_id", F.col("line").cast("bigint").alias("line")).agg(F.count("*").alias("tokens"), F.count_if(~F.col("tok_is_correct")).alias("wrong"), F.count_if("ws_comment").alias("masked"))


@query("SELECT DISTINCT 'o' || l_orderkey AS sample_id, CAST(l_linenumber AS INTEGER) AS line, l_linenumber % 2 = 1 AS line_is_clean FROM lineitem")
def lines_from_records(spark, sf):
    return readers.lines(_records(spark, sf)).select("sample_id", "line", "line_is_clean")


# Text and spans.


@query("""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'no ' || text WHEN 1 THEN 'ok' || chr(10) || '```abc' || chr(10) || text || chr(10) || '```' || chr(10) || 'end' ELSE 'a ```x``` b ```' || chr(10) || text || '``` c' || CASE WHEN conv_id % 2 = 0 THEN ' ``` d' ELSE '' END END AS t FROM conversations),
p AS (SELECT *, str_split(t, '```') AS p FROM t), n AS (SELECT *, len(p) - 1 AS n FROM p),
b AS (SELECT *, p[n] AS body, length(array_to_string(p[1:n - 1], '```')) + 3 AS a, length(array_to_string(p[1:n - 1], '```')) + 3 + length(p[n]) AS z FROM n),
c AS (SELECT *, a + CASE WHEN contains(body, chr(10)) THEN position(chr(10) IN body) ELSE 0 END AS s FROM b)
SELECT conv_id, turn, CASE WHEN n >= 2 AND s < z THEN CAST(s AS INTEGER) END AS start, CASE WHEN n >= 2 AND s < z THEN CAST(z AS INTEGER) END AS "end", CASE WHEN n >= 2 AND s < z THEN regexp_replace(t[s + 1 : z], '^\\s+|\\s+$', '', 'g') ELSE '' END AS code FROM c""")
def code_spans(spark, sf):
    """The last fenced body of every turn's text, with none, one or several fences around it, an unpaired one after it, or any of its own."""
    k = F.col("turn") % 3
    several = F.concat(F.lit("a ```x``` b ```\n"), F.col("text"), F.lit("``` c"), F.when(F.col("conv_id") % 2 == 0, " ``` d").otherwise(""))
    t = F.when(k == 0, F.concat(F.lit("no "), F.col("text"))).when(k == 1, F.concat(F.lit("ok\n```abc\n"), F.col("text"), F.lit("\n```\nend"))).otherwise(several)
    rows = views.table(spark, sf, "conversations").withColumn("t", t)
    span = scalars.code_span(F.col("t"))
    return rows.select("conv_id", "turn", span["start"].alias("start"), span["end"].alias("end"), scalars.code_of(F.col("t")).alias("code"))


_PIECES = "SELECT conv_id, turn, i, b - length(w) - 1 AS a, b - 1 AS z FROM (SELECT conv_id, turn, i, w, sum(length(w) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) AS b FROM (SELECT conv_id, turn, unnest(str_split(text, ' ')) AS w, generate_subscripts(str_split(text, ' '), 1) - 1 AS i FROM conversations))"


@query(f"""WITH p AS ({_PIECES}) SELECT conv_id, turn, CAST(min(i) FILTER (WHERE z + 1 > 5 AND a < 20) AS INTEGER) AS first, CAST(max(i) FILTER (WHERE z + 1 > 5 AND a < 20) AS INTEGER) AS last, CAST(min(i) FILTER (WHERE a <= 9 AND 9 < z + 1) AS INTEGER) AS holds_9,
count(*) FILTER (WHERE z + 1 > 5 AND a < 20) AS inside FROM p GROUP BY conv_id, turn""")
def token_spans(spark, sf):
    """Words, each with the space after it, as tokens: those that overlap characters 5 to 20, and the one at 9."""
    pieces = F.transform(F.split("text", " "), lambda w: F.concat(w, F.lit(" ")))
    rows = views.table(spark, sf, "conversations").withColumn("o", spans.spans_from(pieces))
    span = scalars.token_span(F.col("o"), F.struct(F.lit(5).alias("start"), F.lit(20).alias("end")))
    return rows.select("conv_id", "turn", span["start"].alias("first"), span["end"].alias("last"), scalars.token_at(F.col("o"), F.lit(9)).alias("holds_9"), F.size(scalars.tokens_in(F.col("o"), F.lit(5), F.lit(20))).cast("bigint").alias("inside"))


@query("""WITH l AS (SELECT l_orderkey, list(DISTINCT l_linenumber) FILTER (WHERE l_returnflag = 'R') AS l FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(list_min(list_filter(l, lambda x: x >= 3)), list_max(list_filter(l, lambda x: x < 3))) AS line FROM l""")
def nearest_lines(spark, sf):
    l = views.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("l"))
    return l.select("l_orderkey", scalars.nearest_line(F.col("l"), F.lit(3)).alias("line"))


@query("""SELECT n_nationkey, unnest(CASE n_nationkey % 6 WHEN 0 THEN [lower(n_name), 'r' || n_regionkey] WHEN 1 THEN [lower(n_name), 'r' || n_regionkey] WHEN 2 THEN [lower(n_name)] WHEN 3 THEN [lower(n_name) || ',' || n_regionkey, 'it''s ' || chr(92)]
WHEN 4 THEN ['[' || lower(n_name) || ']'] ELSE [lower(n_name)] END) AS lib FROM nation""")
def library_lists(spark, sf):
    """Names as a list's literal, a comma list, a bare name, a literal with commas and quotes in its names, and in brackets."""
    name, region, k = F.lower("n_name"), F.col("n_regionkey").cast("string"), F.col("n_nationkey") % 6
    forms = [
        F.concat(F.lit("['"), name, F.lit("', \"r"), region, F.lit('", 3]')),
        F.concat(name, F.lit(", r"), region, F.lit(",")),
        name,
        F.concat(F.lit(" ('"), name, F.lit(","), region, F.lit("', 'it\\'s \\\\') ")),
        F.concat(F.lit("["), name, F.lit("]")),
        F.concat(F.lit("'"), name, F.lit("'")),
    ]
    raw = F.coalesce(*[F.when(k == i, x) for i, x in enumerate(forms)])
    return views.table(spark, sf, "nation").select("n_nationkey", F.explode(scalars.library_list(raw)).alias("lib"))


@query("SELECT event_id, 'w' || k AS text, k % 2 = 0 AS label, CASE WHEN k % 3 = 0 THEN -1 ELSE k END AS line FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def annotation_layouts(spark, sf):
    """One token a row in either layout: an object, or a list under `tokens` (without a line in every third)."""
    k = F.get_json_object("props", "$.k").cast("int")
    s, flag = k.cast("string"), F.when(k % 2 == 0, "true").otherwise("false")
    item = F.concat(F.lit('{"token_text": "w'), s, F.lit('", "label": '), flag, F.when(k % 3 != 0, F.concat(F.lit(', "line": '), s)).otherwise(""), F.lit("}"))
    listed = F.concat(F.lit('["w'), s, F.lit('", '), flag, F.when(k % 3 != 0, F.concat(F.lit(", "), s)).otherwise(""), F.lit("]"))
    raw = F.when(k % 2 == 0, F.concat(F.lit("["), item, F.lit("]"))).otherwise(F.concat(F.lit('{"tokens": ['), listed, F.lit("]}")))
    return views.table(spark, sf, "events").select("event_id", F.explode(scalars.annotation_tokens(raw)).alias("t")).select("event_id", "t.text", "t.label", "t.line")


@query("""WITH t AS (SELECT conv_id, turn, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM conversations) SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN s || chr(10) || 'more' WHEN 1 THEN CASE WHEN text = '' THEN '' ELSE s || chr(10) END || 'more' ELSE s END AS body FROM t""")
def channel_messages(spark, sf):
    """Replies of two whole messages, of messages without turns, and of a turn without channels."""
    k = F.col("turn") % 3
    whole = F.concat(F.lit("<|start|>assistant<|channel|>analysis<|message|>"), F.col("text"), F.lit(" <|end|><|start|>assistant<|channel|>final<|message|>more<|end|>"))
    begun = F.concat(F.lit("<|channel|>analysis<|message|>"), F.col("text"), F.lit("<|channel|>final<|message|> more <|return|>"))
    t = F.when(k == 0, whole).when(k == 1, begun).otherwise(F.concat(F.lit("<|start|>assistant "), F.col("text"), F.lit("<|return|>")))
    return views.table(spark, sf, "conversations").select("conv_id", "turn", scalars.stripped_channels(t).alias("body"))


@query("""WITH t AS (SELECT conv_id, turn, str_split(CASE WHEN turn % 2 = 0 THEN role || '</think>between</think>' || text ELSE text END, '</think>') AS p FROM conversations) SELECT conv_id, turn, CASE WHEN len(p) > 1 THEN regexp_replace(p[1], '^\\s+|\\s+$', '', 'g') END AS trace, CASE WHEN len(p) > 1 THEN regexp_replace(p[-1], '^\\s+|\\s+$', '', 'g') END AS answer FROM t""")
def reasoning_traces(spark, sf):
    """What stands before the first delimiter and after the last, of texts with several, some of their own, or none."""
    t = F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit("</think>between</think>"), "text")).otherwise(F.col("text"))
    first, last = scalars.reasoning_parts(t, "</think>")
    return views.table(spark, sf, "conversations").select("conv_id", "turn", first.alias("trace"), last.alias("answer"))


@query("""SELECT o_orderkey, o_orderpriority || chr(10) || chr(10) || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || '```python' || chr(10) || 'def f' || o_orderkey || '():' || chr(10) || '```' ELSE '' END AS prompt,
o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || chr(10) || 'Define `f' || o_orderkey || '`.' ELSE '' END AS instruction,
o_orderpriority || chr(10) || chr(10) || '```python' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE '' END || chr(10) || '```' || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || chr(10) || 'It fails with: E' || o_orderkey ELSE '' END AS repair FROM orders""")
def prompts(spark, sf):
    k = F.col("o_orderkey").cast("string")
    two, three = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0
    starter = F.when(two, F.concat(F.lit("def f"), k, F.lit("():"))).otherwise(" ")
    return views.table(spark, sf, "orders").select(
        "o_orderkey",
        scalars.prompt(F.col("o_orderpriority"), F.col("o_orderstatus"), starter).alias("prompt"),
        scalars.instruction(F.col("o_orderpriority"), F.when(three, F.concat(F.lit("f"), k))).alias("instruction"),
        scalars.repair_prompt(F.col("o_orderpriority"), F.when(two, "x"), F.when(three, F.concat(F.lit(" E"), k))).alias("repair"),
    )


@query("""SELECT event_id, CASE WHEN k % 4 = 0 THEN k WHEN k % 4 = 1 THEN 7 ELSE -1 END AS line, CASE WHEN k % 4 = 0 THEN k WHEN k % 4 = 1 THEN 7 WHEN k % 4 = 2 THEN k + 1 END AS line_id, CASE WHEN k % 4 <> 3 THEN CAST(k + 1 AS BIGINT) END AS total, CASE WHEN k % 4 = 0 THEN k + 0.5 END AS number,
greatest(30.0, k * 2.0 + 5) AS timeout, CASE WHEN k % 4 = 1 THEN 'm' || k ELSE CAST(k AS VARCHAR) END AS name FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def number_coercions(spark, sf):
    """Lines, line ids, lists of ids, numbers, time limits and names of specifiers from text of any form."""
    k = F.get_json_object("props", "$.k").cast("int")
    s = k.cast("string")
    raw = F.when(k % 4 == 0, s).when(k % 4 == 1, "7").when(k % 4 == 2, "x").otherwise(F.lit(None))
    other = F.when(k % 4 == 2, (k + 1).cast("string")).otherwise("none")
    ids = scalars.int_list(F.array(s, F.when(k % 4 == 3, "bad").otherwise("1")))
    number = F.when(k % 4 == 0, F.concat(s, F.lit(".5"))).when(k % 4 == 1, "NaN").when(k % 4 == 2, "inf").otherwise("no")
    return views.table(spark, sf, "events").select(
        "event_id", scalars.line_number(raw).alias("line"), scalars.line_id(raw, other).alias("line_id"), F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
        scalars.number(number).alias("number"), scalars.hard_timeout(k, F.lit(2.0)).alias("timeout"), scalars.specifier_name(F.when(k % 4 == 1, F.concat(F.lit("-"), s)).otherwise(s)).alias("name"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '<no_program>' WHEN o_orderkey % 5 = 0 THEN '<no_fix>' ELSE 'fixed' END AS fixed FROM orders")
def fix_sentinels(spark, sf):
    fixed = F.when(F.col("o_orderkey") % 5 != 0, "fixed")
    return views.table(spark, sf, "orders").select("o_orderkey", scalars.fix_of(fixed, F.when(F.col("o_orderstatus") == "P", " ").otherwise("x")).alias("fixed"))


@query("SELECT o_orderkey, CAST(pos AS INTEGER) AS pos FROM (SELECT o_orderkey, 0 AS pos FROM orders UNION SELECT o_orderkey, o_orderkey % 9 FROM orders UNION SELECT o_orderkey, unnest(range(o_orderkey % 5, o_orderkey % 9 + 1)) FROM orders WHERE o_orderkey % 2 = 0) WHERE pos <= o_orderkey % 9")
def token_positions(spark, sf):
    """The positions that the specifiers 0, -1 and code_to_end name, each once; no code, no code positions."""
    k = F.col("o_orderkey")
    end = F.when(k % 2 == 0, F.lit(99))
    at = scalars.resolved_specifiers(scalars.parsed_specifiers(["0", "-1", "code_to_end", "?", "0"]), (k % 9 + 1).cast("int"), (k % 5).cast("int"), end)
    return views.table(spark, sf, "orders").select("o_orderkey", F.explode(at).alias("pos"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 25 = 0 THEN '' ELSE n_name END AS piece FROM lineitem LEFT JOIN nation ON n_nationkey = l_suppkey % 25 AND n_nationkey < 20")
def decoded_tokens(spark, sf):
    vocabulary = views.table(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("bigint").alias("token_id"), F.col("n_name").alias("piece"))
    ids = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 25).cast("bigint").alias("token_id"))
    return features.decoded(ids, vocabulary, [0]).select("l_orderkey", "l_linenumber", "l_partkey", "piece")


# Candidates and vectors.


@query("SELECT o_custkey, CAST(o_custkey % 7 AS INTEGER) AS n, CAST(least(count(*) FILTER (WHERE rk <= o_custkey % 7 AND o_orderstatus = 'F'), o_custkey % 7) AS BIGINT) AS n_true FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rk FROM orders) GROUP BY o_custkey")
def aligned_scores(spark, sf):
    """Scores cut to a number or padded with false."""
    rows = views.table(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"] == "F").alias("v"))
    v = outcomes.aligned(F.col("v"), F.col("o_custkey") % 7)
    return rows.select("o_custkey", F.size(v).alias("n"), F.size(F.filter(v, lambda x: x)).cast("bigint").alias("n_true"))


@query("SELECT conv_id, turn FROM conversations WHERE NOT (turn % 2 = 0 AND conv_id % 2 = 0)")
def unmatched_labels(spark, sf):
    c = views.table(spark, sf, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("cand_idx"))
    return features.unmatched(c, c.where("cand_idx % 2 = 0 and sample_id % 2 = 0")).select(F.col("sample_id").alias("conv_id"), F.col("cand_idx").alias("turn"))


@query("SELECT vec_id, CAST(d AS INTEGER) AS dim, CAST(embedding[(CASE WHEN d < 16 THEN 48 ELSE 0 END) + d % 16 + 1] AS FLOAT) AS value FROM embeddings, range(32) t(d)")
def fixed_length_vectors(spark, sf):
    """Sequences of one token with layers 3 and 0, in that order, as flat vectors."""
    seqs = features.sequences(views.vectors(spark, sf).withColumn("pos", F.lit(0)), ["vec_id"], [3, 0])
    return features.fixed_length(seqs, ["vec_id"], 1).select("vec_id", F.posexplode("vec").alias("dim", "value"))


@query("SELECT vec_id, 4 AS tokens, CAST(1 + vec_id % 4 AS INTEGER) AS length, CASE WHEN vec_id % 4 < 3 THEN 0.0 ELSE CAST(embedding[49] AS DOUBLE) END AS last FROM embeddings")
def padded_sequences(spark, sf):
    """Sequences of one to four tokens, filled up to the longest with zeros; their lengths stay."""
    rows = views.vectors(spark, sf).where("pos <= vec_id % 4")
    seqs = rows.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vec"))), lambda x: x["vec"]).alias("s"))
    filled = features.padded(F.col("s"), F.lit(4), F.array_repeat(F.lit(0.0).cast("float"), 16))
    return seqs.select("vec_id", F.size(filled).alias("tokens"), F.size("s").alias("length"), F.get(F.get(filled, F.lit(3)), F.lit(0)).cast("double").alias("last"))


@query("SELECT vec_id, CAST(layer AS INTEGER) AS layer FROM embeddings, (VALUES (1), (3), (7)) t(layer) WHERE layer = 7 OR layer > vec_id % 4")
def missing_layers(spark, sf):
    have = views.vectors(spark, sf).where("layer <= vec_id % 4").groupBy("vec_id").agg(F.collect_set("layer").alias("have"))
    return have.select("vec_id", F.explode(features.missing_layers([3, 1, 7, 1], F.col("have"))).alias("layer"))


@query(f"""WITH b AS (SELECT line, CAST(floor((row_number() OVER (PARTITION BY line ORDER BY sample, o1, o2, wrong, score) - 1) / 64) AS BIGINT) AS b, CASE WHEN wrong THEN -ln(least(greatest(score, 1e-7), 1 - 1e-7)) ELSE -ln(1 - least(greatest(score, 1e-7), 1 - 1e-7)) END AS l FROM ({TOKENS})),
m AS (SELECT line, b, avg(l) AS l FROM b GROUP BY line, b) SELECT line, count(*) AS batches, round(avg(l), 6) AS loss FROM m GROUP BY line""")
def loss_of_batches(spark, sf):
    """The mean of the means of batches of 64, the last of which may be short."""
    from pyspark.sql import Window as W

    t = views.tokens(spark, sf)
    order = W.partitionBy("line").orderBy("sample", "ordinal", F.col("tok_is_correct").desc(), "score")
    rows = t.withColumn("b", F.floor((F.row_number().over(order) - 1) / 64))
    return metrics.batch_mean_loss(rows, ~F.col("tok_is_correct"), F.col("score"), F.col("b"), ["line"])


@query(f"SELECT model, baseline, CASE WHEN ord % 3 = 0 THEN 0.25 ELSE roc_auc END AS chosen_by FROM ({RESULTS})")
def model_selection(spark, sf):
    auc = F.when(F.col("ord") % 3 == 0, F.when(F.col("ord") % 2 == 0, F.lit(float("nan")))).otherwise(F.col("roc_auc"))
    return views.results(spark, sf).select("model", "baseline", metrics.selection_score(auc, F.lit(0.25)).alias("chosen_by"))


# Selections by name. events: reliability is the value turned round, a column the property k, clicks are comments and views identifiers.

_STRATEGY = f"SELECT *, 100 - score AS logtoku, CASE node_type WHEN 'click' THEN 'comment' WHEN 'view' THEN 'identifier' ELSE node_type END AS kind FROM ({SCORES})"
_NEW_LINE = f"SELECT \"user\", arg_min(pos, (k, pos)) AS pos FROM ({SCORES}) GROUP BY \"user\", line UNION SELECT \"user\", max(pos) FROM ({SCORES}) GROUP BY \"user\""


def _strategy(spark, sf, name: str, **options):
    s = views.scores(spark, sf)
    kind = F.when(F.col("node_type") == "click", "comment").when(F.col("node_type") == "view", "identifier").otherwise(F.col("node_type"))
    rows = s.select("user", "pos", "line", F.col("score").alias("entropy"), (100 - F.col("score")).alias("logtoku"), F.col("k").alias("column"), kind.alias("node_type"))
    return selection.STRATEGIES[name](rows, ["user"], **options).select("user", "pos")


@query(_NEW_LINE)
def strategy_new_line(spark, sf):
    return _strategy(spark, sf, "new-line")


@query(f"SELECT \"user\", pos FROM (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY score DESC, pos) AS rk FROM ({SCORES})) WHERE rk <= 4")
def strategy_entropy(spark, sf):
    return _strategy(spark, sf, "top_k-token-entropy", k=4)


@query(f"SELECT \"user\", pos FROM (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY logtoku, pos) AS rk, count(*) OVER (PARTITION BY \"user\") AS n FROM ({_STRATEGY})) WHERE rk <= greatest(1, floor(n * 0.1))")
def strategy_logtoku(spark, sf):
    """Lowest reliability first."""
    return _strategy(spark, sf, "top_k-logtoku", quantile=0.1)


@query(f"SELECT \"user\", pos FROM (SELECT *, row_number() OVER (PARTITION BY \"user\", line ORDER BY logtoku, pos) AS rk FROM ({_STRATEGY})) WHERE rk <= 2")
def strategy_lines_logtoku(spark, sf):
    return _strategy(spark, sf, "lines+top_k-logtoku", k=2)


@query(f"WITH n AS ({_NEW_LINE}) SELECT \"user\", pos FROM (SELECT s.*, row_number() OVER (PARTITION BY s.\"user\" ORDER BY s.score DESC, s.pos) AS rk FROM ({SCORES}) s JOIN n ON n.\"user\" = s.\"user\" AND n.pos = s.pos) WHERE rk <= 2")
def strategy_new_line_entropy(spark, sf):
    return _strategy(spark, sf, "new-line+top_k-token-entropy", k=2)


@query(f"SELECT \"user\", pos FROM ({_STRATEGY}) WHERE kind NOT IN ('comment', 'identifier')")
def strategy_comment_or_identifier(spark, sf):
    return _strategy(spark, sf, "comment-or-identifier")


@query(f"SELECT \"user\", pos FROM (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY score DESC, pos) AS rk FROM ({_STRATEGY}) WHERE kind NOT IN ('comment', 'identifier')) WHERE rk <= 3")
def strategy_comment_or_identifier_entropy(spark, sf):
    return _strategy(spark, sf, "comment-or-identifier+top_k-token-entropy", k=3)


# Small ones.


@query(f"SELECT domain, count(*) AS candidates FROM orders JOIN (SELECT DISTINCT task, domain FROM ({MAPPED}) WHERE domain IS NOT NULL) ON o_custkey = task GROUP BY domain")
def candidates_by_domain(spark, sf):
    """Candidates in every domain of their task."""
    rows = views.candidates(spark, sf).select(F.col("problem").alias("task"), "cand")
    return domains.fanned_out(rows, domains.pairs(views.task_libs(spark, sf), views.lib_domains(spark, sf))).groupBy("domain").agg(F.count("*").alias("candidates"))


@query("SELECT doc_id, regexp_replace(coalesce(source, '') || '/ ' || coalesce(lang, '') || ' v' || doc_id || '?', '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM documents")
def safe_names(spark, sf):
    raw = F.concat(F.coalesce("source", F.lit("")), F.lit("/ "), F.coalesce("lang", F.lit("")), F.lit(" v"), F.col("doc_id").cast("string"), F.lit("?"))
    return views.table(spark, sf, "documents").select("doc_id", scalars.safe_name(raw).alias("name"))


@query("SELECT event_id, k % 5 < 3 AS passed, CASE WHEN k % 5 < 2 THEN 2 WHEN k % 5 = 2 THEN 1 ELSE 0 END AS n_true, CASE WHEN k % 5 < 2 THEN 3 ELSE 1 END AS n FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def statuses(spark, sf):
    """Statuses in words, and flags from JSON that holds a list or one value."""
    k = F.get_json_object("props", "$.k").cast("int") % 5
    word = F.when(k == 0, "Passed").when(k == 1, " ok ").when(k == 2, "success").when(k == 3, "error")
    flags = scalars.flags(F.when(k < 2, '[true, "no", 1]').when(k == 2, '"pass"').otherwise("false"))
    return views.table(spark, sf, "events").select("event_id", scalars.passed(word).alias("passed"), F.size(F.filter(flags, lambda x: x)).alias("n_true"), F.size(flags).alias("n"))


@query("SELECT vec_id, unnest(CASE vec_id % 3 WHEN 0 THEN [vec_id % 4, 9] WHEN 1 THEN [7, vec_id % 5] ELSE [x for x in [0, 1, 2, 3] if x <> vec_id % 4] END) AS layer, CASE vec_id % 3 WHEN 0 THEN 'asked' WHEN 1 THEN 'declared' ELSE 'occurs' END AS how FROM embeddings")
def inferred_layers(spark, sf):
    """Each candidate's layers: those asked for, else those that its payload declares, else those that occur in it."""
    k = F.col("vec_id") % 3
    v = views.vectors(spark, sf).where("layer <> vec_id % 4")
    rows = v.withColumn("asked", F.when(k == 0, F.array((F.col("vec_id") % 4).cast("int"), F.lit(9)))).withColumn("declared", F.when(k == 1, F.array(F.lit(7), (F.col("vec_id") % 5).cast("int"))).when(k == 2, F.array().cast("array<int>")))
    return features.layers_of(rows, ["vec_id"], "asked", "declared").select("vec_id", F.explode(F.col("layers").cast("array<bigint>")).alias("layer"), "how")


@query("""WITH g AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1),
e AS (SELECT k, n, i, n * r AS exact FROM g, (VALUES (0, CAST(0.6 AS DOUBLE)), (1, CAST(0.2 AS DOUBLE)), (2, CAST(0.2 AS DOUBLE))) t(i, r)),
o AS (SELECT *, floor(exact) AS low, row_number() OVER (PARTITION BY k ORDER BY exact - floor(exact) DESC, i) AS nth, sum(floor(exact)) OVER (PARTITION BY k) AS given FROM e)
SELECT k, n, CAST(max(low + CASE WHEN nth <= n - given THEN 1 ELSE 0 END) FILTER (WHERE i = 0) AS BIGINT) AS train, CAST(max(low + CASE WHEN nth <= n - given THEN 1 ELSE 0 END) FILTER (WHERE i = 1) AS BIGINT) AS validation,
CAST(max(low + CASE WHEN nth <= n - given THEN 1 ELSE 0 END) FILTER (WHERE i = 2) AS BIGINT) AS test FROM o GROUP BY k, n""")
def allocations(spark, sf):
    """Largest remainders of the counts of each group."""
    from ..operators import splits

    rows = views.table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))
    dealt = splits.allotted(F.col("n"), (0.6, 0.2, 0.2))
    return rows.select("k", "n", *[F.get(dealt, F.lit(i)).alias(s) for i, s in enumerate(splits.SPLITS)])


# From programs and their fixes to labels, and probes end to end. SQL has neither alignments nor trees: the tests hold these against
# the alignment itself, and against data of known answers.


def _aligned(spark, sf):
    """Documents as programs of words, ten a line; the fix leaves out every seventh word, and the code begins after a quarter."""
    d = views.table(spark, sf, "documents").where("text is not null").select("doc_id", "text").repartition("doc_id").select("doc_id", F.split("text", " ").alias("given"))
    rows = d.withColumn("fixed", F.filter("given", lambda w, i: i % 7 != 3))
    n = F.size("given")
    start = F.floor(n / 4).cast("int")
    offset = F.size(F.filter("given", lambda w, i: (i % 7 != 3) & (i < start)))
    return rows.select("doc_id", "given", "fixed", start.alias("code_start"), n.alias("code_end"), offset.alias("offset"))


@query()
def diff_token_labels(spark, sf):
    """Every document: labels by the whole alignment, and by that and the code's own."""
    rows = _aligned(spark, sf)
    wrong = lambda c: F.size(F.filter(c, lambda x: ~x))
    both = rows.select("doc_id", F.size("given").alias("n"), arrow.token_labels("given", "fixed").alias("a"), arrow.code_token_labels("given", "fixed", "offset", "code_start", "code_end").alias("b"))
    return both.select("doc_id", "n", wrong("a").alias("n_wrong"), wrong("b").alias("n_wrong_with_code"))


@query()
def labelled_candidates(spark, sf):
    """Alignment labels spread over lines, counted, and candidates without a clean line or a fix dropped."""
    rows = _aligned(spark, sf).select("doc_id", F.size("fixed").alias("n_fixed"), F.posexplode(arrow.code_token_labels("given", "fixed", "offset", "code_start", "code_end")).alias("ordinal", "tok_is_correct"))
    tokens = rows.select("doc_id", "n_fixed", "ordinal", F.floor(F.col("ordinal") / 10).alias("line"), "tok_is_correct", F.lit(False).alias("ws_comment"))
    lines = labels.line_totals(tokens, ["doc_id", "n_fixed"])
    per = lines.groupBy("doc_id", "n_fixed").agg(F.sum("tokens").alias("tokens"), F.sum("correct").alias("correct"), F.max("is_clean").alias("any_clean_line"))
    flagged = per.withColumn("is_no_fix", F.col("n_fixed") == 0).withColumn("is_no_correct_line", ~F.col("any_clean_line"))
    for r in ("no_program", "line_filter", "correct"):
        flagged = flagged.withColumn(f"is_{r}", F.lit(False))
    return outcomes.filtered(flagged).select("doc_id", "tokens", "correct")


@query()
def token_offsets_of_ids(spark, sf):
    """Places of the tokens of ids that a tokenizer may or may not make again."""
    import public_tokenizers

    ids = F.transform("text_ids", lambda x: x)
    rows = views.table(spark, sf, "conversations").select("conv_id", "turn", F.transform(F.split("text", ""), lambda c: F.pmod(F.ascii(c) * 7 + F.col("turn"), F.lit(256)).cast("int")).alias("text_ids"))
    got = rows.select("conv_id", "turn", F.size("text_ids").alias("tokens"), arrow.token_offsets(public_tokenizers.path("byte_bpe_50k.json"))(ids).alias("o"))
    return got.select("conv_id", "turn", "tokens", F.size("o.spans").alias("spans"), F.element_at("o.spans", -1)["end"].alias("end"))


def _judged(model, test, trees=None):
    got = stored(probes.scores(model, test, trees).select("y", "score"), "scored")
    auc, best = metrics.roc_auc(got, F.col("y") > 0, F.col("score")), metrics.f1_sweep(got, F.col("y") > 0, F.col("score")).where("is_best")
    skill = metrics.brier_skill(got, F.col("y") > 0, F.col("score"))
    return auc.join(best.select("tenth", "f1")).join(skill.select("bss"))  # one row each


def _vectors_of_tokens(spark, sf):
    """Tokens that are not masked and have a score, with their numbers as a vector; wrong ones are what a probe finds."""
    t = views.tokens(spark, sf).where("not ws_comment and score > 0")
    return t.select("sample", "line", "ordinal", F.col("vec"), (~F.col("tok_is_correct")).alias("y"))


@query()
def token_probe_metrics(spark, sf):
    """Boosted trees on single tokens, weighted by class."""
    rows = probes.prepared(_vectors_of_tokens(spark, sf))
    return _judged(probes.fitted("gbt", rows.where("sample % 5 <> 0"), 4, weighted=True, rounds=5), rows.where("sample % 5 = 0"))


@query()
def line_probe_metrics(spark, sf):
    """Boosted trees on lines: the means of their tokens' vectors, and whether any token is wrong."""
    t = _vectors_of_tokens(spark, sf).withColumn("ws_comment", F.lit(False)).withColumn("tok_is_correct", ~F.col("y"))
    vec = labels.line_vectors(t, ["sample"], "mean").groupBy("sample", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("vec"))
    rows = probes.prepared(vec.join(labels.derived_line_label(t, ["sample"]), ["sample", "line"]).withColumnRenamed("line_is_error", "y"))
    return _judged(probes.fitted("gbt", rows.where("sample % 5 <> 0"), 4, weighted=True, rounds=5), rows.where("sample % 5 = 0"))


@query()
def tail_probe_metrics(spark, sf):
    """Boosted trees on one token drawn from each candidate's tail."""
    from pyspark.sql import Window as W

    t = _vectors_of_tokens(spark, sf).withColumn("pos", F.row_number().over(W.partitionBy("sample").orderBy("ordinal", "line", "y")) - 1)
    drawn = selection.tail_pick(t, ["sample"], 0.5, "tail").select("sample", "pos")
    rows = probes.prepared(t.join(drawn, ["sample", "pos"]))
    return _judged(probes.fitted("gbt", rows.where("sample % 5 <> 0"), 4, weighted=True, rounds=5), rows.where("sample % 5 = 0"))


@query()
def sequence_probe_metrics(spark, sf):
    """Boosted trees, with early stopping, on sequences of the two layers that a selection takes, as flat vectors."""
    v = views.vectors(spark, sf).where("layer in (0, 2)").withColumn("pos", F.lit(0))
    seqs = features.fixed_length(features.sequences(v, ["vec_id"], [0, 2]), ["vec_id"], 1)
    y = views.table(spark, sf, "embeddings").select("vec_id", (F.col("label") >= 4).alias("y"))
    rows = probes.prepared(seqs.join(y, "vec_id")).withColumn("held", F.col("vec_id") % 7 == 0)
    return _judged(probes.fitted("gbt", rows.where("vec_id % 5 <> 0"), 32, weighted=True, early_stop=True, rounds=8), rows.where("vec_id % 5 = 0"))


@query()
def perceptron_metrics(spark, sf):
    """Each perceptron on the vectors: its name and what it reaches on rows it has not seen."""
    rows = probes.prepared(views.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"), (F.col("label") >= 4).alias("y")))
    train, test = rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0")
    got = [_judged(probes.fitted(name, train, 64, rounds=15), test).withColumn("probe", F.lit(name)) for name in ("mlp_two_hidden", "mlp_one_hidden", "mlp_halving")]
    return got[0].unionByName(got[1]).unionByName(got[2])


@query()
def rate_sweep_metrics(spark, sf):
    """Boosted trees at several rates, fitted side by side, each scored with the number of trees that validates best."""
    rows = stored(probes.prepared(_vectors_of_tokens(spark, sf)).select("sample", "x", "y", "w"), "prepared")
    train, validation, test = (rows.where(f"sample % 5 {rule}") for rule in ("> 1", "= 1", "= 0"))
    got = [_judged(r["model"], test, r["trees"]).select(F.lit(r["rate"]).alias("rate"), F.lit(r["trees"]).alias("trees"), "*") for r in probes.sweep("gbt", train, validation, 4, (0.3, 0.1, 0.1, 0.03), weighted=True, rounds=8)]
    return got[0].unionByName(got[1]).unionByName(got[2])


@query()
def stored_probe_metrics(spark, sf):
    """A probe by name, fitted, stored, loaded with its needed parameters, and judged on rows it has not seen."""
    rows = probes.prepared(_vectors_of_tokens(spark, sf))
    at = folder(spark, "probe")
    probes.saved(probes.fitted("logistic", rows.where("sample % 5 <> 0"), 4, weighted=True), at)
    return _judged(probes.loaded(probes.MODELS["logistic"], at), rows.where("sample % 5 = 0"))
