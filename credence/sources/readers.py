"""Tables from JSON lines, Parquet partitions, markdown reports and JSON dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import first_number, sample_id

#: A problem and its candidates as parallel arrays.
RECORD = """id string, prompt string, language string, difficulty string, output array<string>, stripped_output array<string>,
program array<string>, is_correct string, code_token_idx array<array<int>>, prompt_token_count int, prompt_token_ids array<bigint>,
token_ids array<array<bigint>>, fixed_program array<string>, line_filter array<boolean>, no_correct_line_filter array<boolean>,
token_labels array<array<struct<token_id:bigint,token_text:string,label:boolean,line:int,ws_comment:boolean>>>,
line_error_map array<map<string,boolean>>"""


def json_lines(spark: SparkSession, path: str | list[str], schema: str = RECORD) -> DataFrame:
    """One object a line; blank lines are skipped, a malformed one fails. The schema is given, so that maps stay maps."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def split_records(spark: SparkSession, paths: dict[str, str], schema: str = RECORD) -> DataFrame:
    """Records of several splits, each row with its split."""
    frames = [json_lines(spark, p, schema).withColumn("split", F.lit(s)) for s, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def split_paths(values: list[str]) -> tuple[dict[str, str], list[str]]:
    """split=path or split:path entries, and those that are neither."""
    good, bad = {}, []
    for v in values:
        name, sign, path = v.partition("=") if "=" in v else v.partition(":")
        if sign and name.strip() and path.strip():
            good[name.strip()] = path.strip()
        else:
            bad.append(v)
    return good, bad


def candidates(records: DataFrame) -> DataFrame:
    """A row for each candidate, with its place; arrays that are too short give "" for a program, false for a flag, NULL for a span."""
    from ..functions.scalars import flags

    n = F.greatest(*[F.coalesce(F.size(c), F.lit(0)) for c in ("output", "program")], F.lit(0))
    rows = records.withColumn("_ok", flags(F.col("is_correct"))).withColumn("_i", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    i = F.col("_i")
    span = F.get("code_token_idx", i)
    a, b = F.get(span, F.lit(0)), F.get(span, F.lit(1))
    empty = b.isNull() | ((a == 0) & (b == 0))
    return rows.select(
        F.col("id").alias("sample_id"),
        i.alias("cand_idx"),
        "difficulty",
        F.coalesce(F.get("program", i), F.lit("")).alias("program"),
        F.coalesce(F.get("output", i), F.get("stripped_output", i)).alias("output"),
        F.coalesce(F.get("_ok", i), F.lit(False)).alias("is_correct"),
        F.when(~empty, a).alias("span_start"),
        F.when(~empty, b).alias("span_end"),
        F.get("token_ids", i).alias("token_ids"),
        F.get("fixed_program", i).alias("fixed_program"),
        F.coalesce(F.get("line_filter", i), F.lit(False)).alias("is_line_filter"),
        F.coalesce(F.get("no_correct_line_filter", i), F.lit(False)).alias("is_no_correct_line"),
    )


def tokens(records: DataFrame) -> DataFrame:
    """A row for each labelled token."""
    rows = records.select(F.col("id").alias("sample_id"), F.posexplode("token_labels").alias("cand_idx", "_t"))
    rows = rows.select("sample_id", "cand_idx", F.posexplode("_t").alias("tok_idx", "t"))
    return rows.select("sample_id", "cand_idx", "tok_idx", "t.token_id", "t.token_text", F.col("t.label").alias("tok_is_correct"), F.coalesce("t.line", F.lit(-1)).alias("line"), F.coalesce("t.ws_comment", F.lit(False)).alias("ws_comment"))


def lines(records: DataFrame) -> DataFrame:
    """A row for each line of the explicit maps; their true means clean."""
    rows = records.select(F.col("id").alias("sample_id"), F.posexplode("line_error_map").alias("cand_idx", "m"))
    return rows.select("sample_id", "cand_idx", F.explode("m").alias("line", "line_is_clean")).withColumn("line", F.col("line").try_cast("int"))


def features(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Parquet features partitioned by split (only that one's files are read); an empty result fails."""
    rows = spark.read.parquet(path)
    rows = rows if split is None else rows.where(F.col("split") == split)
    if rows.isEmpty():
        raise FileNotFoundError(f"no features in {path}" + (f" for split {split}" if split else ""))
    return rows


def audited_features(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, audit) of all files in the split=... folders under a path, damaged ones among them.

    rows: the schema's columns and split, of the files that can be read to their end; sample_id, where the schema has it, falls back to
    the file's name up to a double underscore. audit: for each split, files_scanned, files_loaded, files_skipped (unreadable, cut
    off, or without rows), rows, samples, and collisions: samples that occur in more than one loaded file of any split. A file
    counts as loaded if as many rows come out of it as its footer says; other files give no row at all. An empty path fails.

    Files are listed and counted by Spark, and nothing of them comes to the driver. Columns are read twice, once for the counts.
    """
    at = F.col("_metadata.file_path").alias("_file")
    own = F.regexp_extract(F.col("_metadata.file_path"), r"/split=([^/]*)/", 1)
    listed = spark.read.format("binaryFile").load(path).select(at, own.alias("split"))  # content isn't read
    tolerant = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)
    said = tolerant.select(at).groupBy("_file").agg(F.count("*").alias("_said"))  # no column: footers alone
    names = [c for c in tolerant.columns if c != "split"]
    found = tolerant.select(*names, at, own.alias("split"))
    if "sample_id" in names:
        found = found.withColumn("sample_id", sample_id(F.col("sample_id"), F.col("_file")))
    each = found.select("_file", F.hash(*names).alias("_h")).groupBy("_file").agg(F.count("*").alias("_got"), F.bit_xor("_h").alias("_h"))
    loaded = said.join(each, "_file").where("_said = _got and _h is not null").select("_file", "_got")  # the hash: so that every column is decoded
    files = listed.join(loaded, "_file", "left").groupBy("split").agg(F.count("*").alias("files_scanned"), F.count("_got").alias("files_loaded"), F.coalesce(F.sum("_got"), F.lit(0)).alias("rows"))
    rows = found.join(loaded.select("_file"), "_file", "left_semi")
    audit = files.withColumn("files_skipped", F.col("files_scanned") - F.col("files_loaded"))
    if "sample_id" in names:
        several = rows.select("split", "sample_id", "_file").distinct().withColumn("_n", F.count("*").over(W.partitionBy("sample_id")))
        per = several.groupBy("split").agg(F.count_distinct("sample_id").alias("samples"), F.count_distinct(F.when(F.col("_n") > 1, F.col("sample_id"))).alias("collisions"))
        audit = audit.join(per, "split", "left").fillna(0, ["samples", "collisions"])
    return rows.drop("_file"), audit


def bucketed(spark: SparkSession, name: str, path: str, schema: str, keys: list[str], buckets: int) -> DataFrame:
    """Features that writers.bucketed has stored, in this session or another."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{k}`" for k in keys)
        spark.sql(f"CREATE TABLE `{name}` ({schema}) USING parquet CLUSTERED BY ({columns}) SORTED BY ({columns}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the batches that writers.commit has entered in the manifest; none before the first. What a run that died has left is
    not read. Names of batches, not rows, come to the driver."""
    from .writers import exists

    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], schema)
    names = sorted(r["batch"] for r in spark.read.schema("batch string").json(f"{path}/manifest/*").collect())
    return json_lines(spark, [f"{path}/{n}" for n in names], schema) if names else spark.createDataFrame([], schema)


def problems(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A catalogue (question_id, contest_date, ...) between two dates, both inclusive, in order of id."""
    from ..functions.scalars import within_dates

    return spark.read.json(path).where(within_dates(F.col("contest_date").cast("timestamp"), start, end)).orderBy("question_id")


def domain_map(spark: SparkSession, path: str) -> DataFrame:
    """(lib, domain) of a flat JSON object; values that are no text fail."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})).alias("lib", "domain"))


def metric_tables(texts: DataFrame, first_only: bool = False) -> DataFrame:
    """Rows of the pipe tables under ### headings, of (source, value): model, table_ord, ord, baseline and the metrics.

    Rows with another number of cells than their header go. first_only keeps a heading's first table.
    """
    rows = texts.select("source", F.posexplode(F.split("value", "\n")).alias("ord", "line")).withColumn("line", F.trim("line"))
    w = W.partitionBy("source").orderBy("ord")
    head = F.when(F.col("line").startswith("### "), F.trim(F.substring("line", 5, 1000)))
    is_row = F.col("line").startswith("|")
    starts = is_row & ~F.coalesce(F.lag(is_row).over(w), F.lit(False))
    rows = rows.withColumn("model", F.last(head, ignorenulls=True).over(w)).withColumn("_row", is_row).withColumn("_table", F.sum(starts.cast("int")).over(w))
    own = W.partitionBy("source", "_table").orderBy("ord")
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = rows.where(F.col("_row") & F.col("model").isNotNull()).withColumn("cells", cells).withColumn("_n", F.row_number().over(own)).withColumn("header", F.first("cells").over(own))
    per_model = F.dense_rank().over(W.partitionBy("source", "model").orderBy("_table"))
    rows = rows.withColumn("table_ord", per_model)
    body = rows.where((F.col("_n") > 1) & (F.size("cells") == F.size("header")) & ~F.col("line").rlike(r"^[\s|:-]+$"))
    cell = lambda name: F.get("cells", F.array_position(F.transform("header", lambda h: F.lower(h)), name).cast("int") - 1)
    got = body.select("source", "model", "table_ord", "ord", cell("baseline model").alias("baseline"), *[first_number(cell(m)).alias(m) for m in ("roc_auc", "bss", "f1", "accuracy")], cell("rank").alias("rank"))
    return got.where("table_ord = 1") if first_only else got
