"""Problem 3: source files that do not parse, by table-driven parsers.

LALR(1) tables are built from the bundled grammars on the driver, in well
under a second, and broadcast (about 0.4 MB whatever the data). Each source
is cut into tokens and run through its language's table to the end; the first
token that no valid file can have there is the file's error. Every Python file
is put to Python's own parser besides, which has the last word both ways, so
neither a rule missing in the grammar nor one too wide counts; where that parser
gives up (a file nested too deep for it) the table's verdict stands.

The language follows from the path's ending; sources with another ending or a
null path are not judged. Null and blank generated code is no source; a human
source is prompt and solution one after the other, either null counting as
empty, and no source where both are. Rows delivered twice count once.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm import _grammars, _lexers, _lr
from provenir.llm._text import has_token, slices
from provenir.runtime import cut, spread, table

#: Language by the ending of a path.
ENDINGS = {"py": "python", "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "h": "cpp"}


def tables() -> dict[str, _lr.Tables]:
    return {"python": _lr.build(_grammars.PYTHON), "java": _lr.build(_grammars.JAVA), "cpp": _lr.build(_grammars.CPP)}


def language(path: Column | str) -> Column:
    """The language of a path, or null."""
    ending = F.lower(F.regexp_extract(F.trim(path), r"\.(\w+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair]), F.when(ending.isin(*ENDINGS), ending))


def syntax_error(text: str, kind: str, table: _lr.Tables) -> tuple[int, str] | None:
    """Line and text of the first token that can't stand where it does, or None for a valid file."""
    symbols, offsets = _lexers.LEXERS[kind](text)
    numbers = table.terminals
    found = _lr.first_error(table, [*(numbers.get(s, -1) for s in symbols), numbers[_lr.END]])
    if kind == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
            return None
        except SyntaxError as error:
            if found < 0:
                return max(1, error.lineno or 1), "ast"
        except ValueError:
            if found < 0:
                return 1, "ast"
        except (RecursionError, MemoryError):
            pass
    if found < 0:
        return None
    at = offsets[found] if found < len(offsets) else len(text)
    return text.count("\n", 0, at) + 1, (symbols[found] if found < len(symbols) else _lr.END)


def parsed(sources: DataFrame) -> DataFrame:
    """sources with language and text parsed: the other columns with valid, error_line and error_token.

    The column text is dropped. Rows whose language has no grammar or whose text is null are left out.
    """
    keep = [f for f in sources.schema.fields if f.name != "text"]
    bundle = sources.sparkSession.sparkContext.broadcast(tables())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = bundle.value
        for batch in slices(batches, "text"):
            found = [syntax_error(t, k, grammar[k]) for t, k in zip(batch.column("text").to_pylist(), batch.column("language").to_pylist())]
            made = [pa.array([x is None for x in found]), pa.array([x and x[0] for x in found], pa.int32()), pa.array([x and x[1] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *made], [*(f.name for f in keep), "valid", "error_line", "error_token"])

    kept = sources.where(F.col("text").isNotNull() & F.col("language").isin(*_lexers.LEXERS))
    return kept.mapInArrow(work, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "valid boolean, error_line int, error_token string"]))


def program_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, tag, repo_name, language, text) of all generated and human sources."""
    people = table(spark, sf_dir, "candidates").where("line_no is not null")
    paths = people.select("line_no", "repo_name", language("relative_path").alias("language")).where("language is not null")
    made = table(spark, sf_dir, "checkpoints").where(F.col("tag").isNotNull() & has_token(F.col("agc_code"))).select("line_no", "tag", F.col("agc_code").alias("text"))
    human = spread(people).select("line_no", F.lit("human").alias("tag"), "repo_name", language("relative_path").alias("language"), F.concat(F.coalesce("prompt", F.lit("")), F.coalesce("solution", F.lit(""))).alias("text"))
    made = made.join(paths, "line_no").select("line_no", "tag", "repo_name", "language", "text")
    return made.unionByName(human.where("language is not null and text <> ''"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(program_sources(spark, sf_dir).select("line_no", "tag", "language", "text")).where("not valid").select("line_no", "tag").distinct()


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source: its verdict, the first error's line and token, and whether the stored verdict differs."""
    files = parsed(program_sources(spark, sf_dir)).dropDuplicates(["line_no", "tag"])
    stored = table(spark, sf_dir, "checkpoints").groupBy("line_no", "tag").agg(F.max_by("agc_valid", "written_at").alias("stored_valid"))
    return files.join(stored, ["line_no", "tag"], "left").withColumn("stale", F.col("stored_valid") != F.col("valid"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository (null for all) and language: sources, invalid ones and their rate."""
    files = cut(parsed(program_sources(spark, sf_dir)).dropDuplicates(["line_no", "tag"]), "p3-files")
    rates = files.groupingSets([["repo_name", "language"], ["language"]], "repo_name", "language")
    return rates.agg(F.count("*").alias("sources"), F.count_if(~F.col("valid")).alias("invalid"), F.avg((~F.col("valid")).cast("double")).alias("invalid_rate"), F.grouping("repo_name").alias("all_repositories"))
