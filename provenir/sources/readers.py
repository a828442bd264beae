"""Readers with explicit schemas and validated headers, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from provenir.runtime import cut


def require_columns(df: DataFrame, required: list[str], label: str) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{label}: missing columns {missing}")
    return df


def pick_column(df: DataFrame, names: list[str]) -> str | None:
    """The first of the names that df has."""
    return next((n for n in names if n in df.columns), None)


def resolve_aliases(df: DataFrame, spec: dict[str, list[str]], extra: tuple[str, ...] = ()) -> DataFrame:
    """df under canonical names; a name that ends in ? may be missing (null then), others are an error."""
    out, missing = [], []
    for name, accepted in spec.items():
        found = pick_column(df, accepted)
        if found is None and not name.endswith("?"):
            missing.append(name)
        out.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name.rstrip("?")))
    if missing:
        raise ValueError(f"no column for {missing}")
    return df.select(*out, *extra)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None = None, sep: str = ",") -> DataFrame:
    """Delimited text with a header, quotes doubled inside quotes and line ends inside values; '' stays '' and only missing fields are null.

    Columns are found by header, so files may lack optional ones or have more.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", sep).option("emptyValue", "").option("nullValue", "\u0000").option("mode", "FAILFAST").csv(path)
    require_columns(raw, required or [], path)
    return raw.select(*[(F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})") if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def read_tsv_directory(spark: SparkSession, path: str, schema: T.StructType, truth: list[str], pred: list[str]) -> DataFrame:
    """All .tsv files below a folder whose header has a truth and a prediction column, with the file each row came from; others are left out.

    One scan for any number of files: every file is read whole by one task, and its own header
    says where its columns are. Fields hold no tabs or line ends.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tsv").load(path)
    lines = files.select(F.col("path").alias("file"), F.filter(F.split(F.decode("content", "UTF-8"), "\r\n|\n|\r"), lambda x: x != "").alias("lines")).where("size(lines) > 0")
    named = lines.withColumn("head", F.transform(F.split(F.get("lines", F.lit(0)), "\t"), F.trim))
    known = named.where(F.arrays_overlap("head", F.array(*map(F.lit, truth))) & F.arrays_overlap("head", F.array(*map(F.lit, pred))))
    cells = known.select("file", "head", F.explode(F.slice("lines", 2, 2**31 - 1)).alias("line")).select("file", "head", F.split("line", "\t").alias("cells"))
    value = lambda name: F.nullif(F.get("cells", (F.array_position("head", F.lit(name)) - 1).cast("int")), F.lit("")) if name else None
    out = cells.select(*(F.when(F.array_contains("head", f.name), value(f.name)).try_cast(f.dataType).alias(f.name) for f in schema.fields), "file")
    if not known.limit(1).count():
        raise ValueError(f"no file below {path} has the columns")
    return out


def read_numbered_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with file, line_no (from 1, blank lines counted), the object's fields and error (null for a line that parses).

    Files of lines are numbered inside each file, which one task reads.
    """
    kept = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\r\n|\n")).alias("n", "line"))
    rows = whole.where(F.trim("line") != "").select("file", (F.col("n") + 1).alias("line_no"), F.from_json("line", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return rows.select("file", "line_no", *(F.col(f"r.{f.name}").alias(f.name) for f in schema.fields), F.when(F.col("r._corrupt_record").isNotNull(), "invalid_json").alias("error"))


def read_parts(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """The CSV parts of one name in all folders below root (one a commit), as one table with the folder each row came from."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("escape", '"').option("multiLine", True).schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])).csv(root)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1)
    return raw.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields), folder.alias("part"))


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The last in order of the files that match a pattern."""
    return spark.read.format("binaryFile").load(pattern).select(F.max("path")).first()[0]


def input_files(spark: SparkSession, paths: list[str], suffix: str = ".py") -> DataFrame:
    """(path, mode) of a file, of the files of a folder, or of those of a grid of folders, whichever each path is; files of no bytes hold nothing and are left out."""
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    root = F.filter(F.array(*(F.lit(p.rstrip("/")) for p in paths)), lambda p: (F.col("path") == p) | F.startswith(F.col("path"), F.concat(p, F.lit("/"))))[0]
    below = F.size(F.split(F.substring("path", F.length(root) + 2, 2**31 - 1), "/"))
    return whole.select("path", F.when(F.col("path") == root, "file").when(below == 1, "folder").otherwise("grid").alias("mode"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with blanks skipped; a line that doesn't parse keeps its text in _corrupt_record. gzip is read as it is."""
    kept = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole JSON documents, one or an array a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id a line (or the first field of a CSV with that header), blanks and # comments skipped; ids that stand twice, in one file or in several, and strange signs are errors."""
    lines = spark.read.text(path).select(F.trim("value").alias("id")).where("id <> '' and not startswith(id, '#')")
    ids = lines.select(F.regexp_replace(F.split("id", ",")[0], '^"|"$', "").alias("id")).where("id not in ('function_event_id', 'event_id')")
    if bad := [r["id"] for r in ids.where("not id rlike '^[A-Za-z0-9_.:/@#-]+$'").limit(5).collect()]:
        raise ValueError(f"ids with other signs than letters, digits and _.:/@#-: {bad}")
    if twice := [r["id"] for r in ids.groupBy("id").count().where("count > 1").limit(5).collect()]:
        raise ValueError(f"repeated ids: {twice}")
    return ids


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    """One folder per split."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def write_content_addressed(df: DataFrame, text: str, path: str) -> DataFrame:
    """Each distinct text once, under its SHA-256, in folders by the hash's first two digits; what is there already is used again. Gives the hashes that are new."""
    spark = df.sparkSession
    keyed = df.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("sha256"), F.col(text).alias("content")).dropDuplicates(["sha256"]).withColumn("prefix", F.substring("sha256", 1, 2))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        shape = T.StructType([T.StructField("sha256", T.StringType()), T.StructField("prefix", T.StringType())])
        keyed = keyed.join(spark.read.schema(shape).parquet(path).select("sha256"), "sha256", "left_anti")
    made = cut(keyed, "content")
    made.write.mode("append").partitionBy("prefix").parquet(path)
    return made.select("sha256")


def rendered_sample(blocks: DataFrame, sample: str, order: str) -> tuple[DataFrame, DataFrame]:
    """From blocks (sample, order, function_name, label, source_idx, code): each sample's text, and the truth table of its blocks.

    A text has four lines of head, then the blocks parted by a blank line; the truth table has block_idx from 1
    and the lines a block takes up. Samples are a few blocks each.
    """
    clean = F.regexp_replace("code", "\\s+$", "")
    b = blocks.select(sample, F.col(order).alias("_o"), "function_name", "label", "source_idx", clean.alias("code"), F.size(F.split(clean, "\\r\\n|\\r|\\n")).alias("_lines"))
    w = Window.partitionBy(sample).orderBy("_o")
    placed = b.withColumn("block_idx", F.row_number().over(w)).withColumn("_before", F.coalesce(F.sum(F.col("_lines") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    truth = placed.select(sample, "block_idx", "function_name", (F.col("_before") + 5).cast("int").alias("start_line"), (F.col("_before") + 4 + F.col("_lines")).cast("int").alias("end_line"), "label", "source_idx")
    head = F.concat(F.lit("# mixed sample "), F.col(sample).cast("string"), F.lit("\n# blocks: "), F.count("*").cast("string"), F.lit("\n# truth is in the table beside\n#\n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "code"))), lambda x: x["code"]), "\n\n")
    return placed.groupBy(sample).agg(F.concat(head, listed, F.lit("\n")).alias("text")), truth


def two_rows(df: DataFrame, key: str, human: str, machine: str) -> DataFrame:
    """One row per half: key with _human or _lm, the code, and its label."""
    half = lambda c, tag: F.struct(F.concat(F.col(key).cast("string"), F.lit(f"_{tag}")).alias("idx"), F.col(c).alias("code"), F.lit(tag).alias("label"))
    return df.select(F.explode(F.array(half(human, "human"), half(machine, "lm"))).alias("h")).select("h.*")


def chat_lines(df: DataFrame, question: str, answer: str, system: str) -> DataFrame:
    """Fine-tuning lines: system, user and assistant messages as one JSON object."""
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.select(F.to_json(F.struct(F.array(said("system", F.lit(system)), said("user", F.col(question)), said("assistant", F.col(answer))).alias("messages"))).alias("value"))


def csv_files(spark: SparkSession, root: str, without: tuple[str, ...] = ("_manifest.csv", "_candidate_report.csv")) -> list[str]:
    """All .csv files below a folder but those whose names end so."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path")
    return sorted(r["path"] for r in found.collect() if not r["path"].endswith(without))


def read_blocks(spark: SparkSession, summary: str, folder: str, schema: T.StructType, truth: list[str], pred: list[str]) -> DataFrame:
    """The summary file where it is at the level of blocks (has a truth and a prediction column), else the TSV files of the folder."""
    head = spark.read.option("header", True).csv(summary)
    if pick_column(head, truth) and pick_column(head, pred):
        return read_csv(spark, summary, schema)
    return read_tsv_directory(spark, folder, schema, truth, pred)
