"""Files in and out: discovery and hashes, trace logs, golden sets, structured paper XML, run artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def discover_files(spark: SparkSession, folder: str, pattern: str = "*.{pdf,PDF}") -> DataFrame:
    """``(path, length, modificationTime)`` of the matching files below ``folder``, each once. Only the listing is read, as the content column is pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", "modificationTime").distinct()


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, file_sha256, doc_id)`` by the bytes of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    digest = F.sha2("content", 256)
    return files.select("path", digest.alias("file_sha256"), F.concat(F.lit("doc_"), F.substring(digest, 1, 16)).alias("doc_id"))


TRACE = "trace_id string, trace_type string, started_at string, finished_at string, total_elapsed_ms double, stages array<struct<stage:string,timestamp:string,elapsed_ms:double>>, metadata map<string,string>"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace logs in JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(TRACE).option("mode", "DROPMALFORMED").json(path).where("trace_id is not null")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Reports of evaluation runs in JSON lines, ``(run_id, generated_at, metrics)``; blank and malformed lines, and lines without metrics, are skipped."""
    return spark.read.schema("run_id string, generated_at string, metrics map<string,double>").option("mode", "DROPMALFORMED").json(path).where("metrics is not null")


def read_golden(spark: SparkSession, path: str, allow_list: bool = False) -> DataFrame:
    """A file that is a list of cases instead is an error unless ``allow_list``. ``(query_id, query, expected_chunk_ids, reference_answer)`` of golden sets ``{"test_cases": [...]}``; older names of the fields count too, cases without a query do not."""
    case = "array<struct<id:string,query_id:string,case_id:string,query:string,question:string,expected_chunk_ids:array<string>,supporting_chunk_ids:array<string>,reference_answer:string,answer:string>>"
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    is_list = F.col("value").startswith("[")
    refused = F.raise_error(F.lit("a golden set must be an object with test_cases; lists are read with allow_list only"))
    cases = F.when(is_list, F.from_json("value", case) if allow_list else refused.cast(case)).otherwise(F.from_json("value", f"struct<test_cases:{case}>")["test_cases"])
    c = whole.select(F.inline(cases))
    return c.select(
        F.coalesce("case_id", "query_id", "id").alias("query_id"), F.coalesce("query", "question").alias("query"),
        F.coalesce("expected_chunk_ids", "supporting_chunk_ids", F.array().cast("array<string>")).alias("expected_chunk_ids"), F.coalesce("reference_answer", "answer").alias("reference_answer"),
    ).where("query is not null")


def papers(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Fields of TEI documents in the column ``xml``: title, authors, abstract, section heads, figure captions and DOI; other columns are kept. Null XML gives null fields."""
    x = F.col(xml)
    fields = {
        "title": F.xpath_string(x, F.lit("//titleStmt/title")), "abstract": F.xpath_string(x, F.lit("//abstract")), "doi": F.xpath_string(x, F.lit("//idno[@type='DOI']")),
        "authors": F.xpath(x, F.lit("//sourceDesc//author/persName/surname/text()")), "heads": F.xpath(x, F.lit("//body//div/head/text()")), "figures": F.xpath(x, F.lit("//figure/head/text()")),
    }
    return df.withColumns({k: F.when(F.trim(v) != "", F.trim(v)) if k in ("title", "abstract", "doi") else v for k, v in fields.items()})


def prefer_structured(structured: DataFrame, fallback: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of ``structured`` where it has them, else those of ``fallback``."""
    f = fallback.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    return structured.join(f, key, "full").select(key, *[F.coalesce(c, f"__{c}").alias(c) for c in fields])


def write_run(df: DataFrame, folder: str) -> None:
    """Artifacts of a run as JSON lines; an existing folder is an error, never overwritten."""
    df.write.mode("errorifexists").json(folder)


def write_tables(df: DataFrame, folder: str) -> None:
    """Extracted tables ``(collection, table_id, ...)`` as JSON, a folder a collection and one line a table; an existing folder is an error."""
    df.write.mode("errorifexists").partitionBy("collection").json(folder)


def write_manifest(plan: DataFrame, folder: str, keys: list[str]) -> None:
    """A sync plan as a JSON manifest of one line an entry, in the order of its keys."""
    plan.select(*keys, "action").orderBy(*keys).write.mode("errorifexists").json(folder)


def append_traces(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def write_by_collection(df: DataFrame, folder: str) -> None:
    """Parquet partitioned by collection, so that readers prune to theirs."""
    df.write.mode("overwrite").partitionBy("collection").parquet(folder)
