"""Inputs: symbol tables in JSON, unified diffs, commit logs, module files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.schemas import DIRECT, DISPATCHED, SYMBOL_TABLE


def parsed_tables(spark: SparkSession, path: str) -> DataFrame:
    """A row per file, with its path; of a file that is no symbol table ``broken`` holds the text and all else is null."""
    read = spark.read.schema(f"{SYMBOL_TABLE}, broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "broken").json(path)
    return read.select(F.col("_metadata.file_path").alias("table_path"), "*")


def symbol_tables(spark: SparkSession, path: str) -> DataFrame:
    """The symbol tables of the files that could be parsed; parsed_tables tells which could not."""
    return parsed_tables(spark, path).where("broken is null").drop("table_path", "broken")


def defined_symbols(tables: DataFrame) -> DataFrame:
    """A row per definition, outside-root files dropped by the producer."""
    files = tables.select("module_path", F.explode("files").alias("f"))
    return files.select("module_path", "f.file_path", "f.import_path", F.explode("f.defined").alias("d")).select("module_path", "file_path", "import_path", "d.*")


def interfaces(defined: DataFrame) -> DataFrame:
    """(iface, methods) of all modules and packages, by qualified name; methods of embedded interfaces are not among them."""
    return defined.where("kind = 'interface'").select(F.col("qualified_name").alias("iface"), F.coalesce("method_set", F.array().cast("array<string>")).alias("methods")).distinct()


def type_methods(defined: DataFrame) -> DataFrame:
    """(type, methods) of the types that have methods: `pkg.T` with what is declared with a receiver T or *T."""
    owner = F.concat("import_path", F.lit("."), F.regexp_replace("receiver_type", r"^\*", ""))
    return defined.where("kind = 'method'").groupBy(owner.alias("type")).agg(F.array_sort(F.collect_set("name")).alias("methods"))


def direct_and_dispatched(references: DataFrame) -> DataFrame:
    """The references that become facts: direct calls and calls through interfaces."""
    return references.where(F.col("kind").isin(DIRECT, DISPATCHED))


def call_references(tables: DataFrame) -> DataFrame:
    files = tables.select("module_path", F.explode("files").alias("f"))
    return files.select("module_path", "f.file_path", F.explode("f.references").alias("r")).select("module_path", "file_path", "r.*")


def diff_hunks(patches: DataFrame, suffix: str = ".go") -> DataFrame:
    """(patch_id, path, h_start, h_end) of (patch_id, text) in unified format with no context; malformed headers are skipped."""
    lines = patches.select("patch_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    header = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.regexp_extract("line", r"^\+\+\+ (?:b/)?(\S+)", 1), r"\\", "/"))
    carried = Window.partitionBy("patch_id").orderBy("pos")
    lines = lines.withColumn("path", F.last(header, ignorenulls=True).over(carried))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    found = lines.where(F.col("line").rlike(hunk) & F.col("path").endswith(suffix))
    start, count = F.regexp_extract("line", hunk, 1).cast("int"), F.regexp_extract("line", hunk, 2)
    size = F.when(count == "", F.lit(1)).otherwise(F.expr(f"try_cast(regexp_extract(line, r'{hunk}', 2) as int)"))
    return found.select("patch_id", "path", start.alias("h_start"), F.greatest(start, start + size - 1).alias("h_end"))


def linearize(log: DataFrame) -> DataFrame:
    """(repo, seq, commit_hash, parent_hash) of (repo, pos, commit_hash), oldest first along first parents."""
    w = Window.partitionBy("repo").orderBy("pos")
    return log.select("repo", (F.row_number().over(w) - 1).cast("long").alias("seq"), "commit_hash", F.lag("commit_hash").over(w).alias("parent_hash"))


def required_modules(texts: DataFrame) -> DataFrame:
    """(id, module, path, version) of (id, text) in go.mod form: what single-line and block requires name, indirect ones included."""
    module = F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1)
    lines = texts.select("id", module.alias("module"), F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw"))
    line = F.regexp_replace(F.regexp_replace("raw", r"//.*$", ""), r"^\s+|\s+$", "")
    opened = F.when(line.rlike(r"^\w+\s*\($"), F.regexp_extract(line, r"^(\w+)", 1)).when(line == ")", F.lit(""))
    within = Window.partitionBy("id").orderBy("pos")
    lines = lines.withColumn("line", line).withColumn("block", F.coalesce(F.last(opened, ignorenulls=True).over(within), F.lit("")))
    entry = F.when(F.col("block") == "require", F.col("line")).when((F.col("block") == "") & F.col("line").rlike(r"^require\s"), F.regexp_replace("line", r"^require\s+", ""))
    found = lines.withColumn("entry", entry).where(F.col("entry").rlike(r"^\S+\s+v\S+$"))
    return found.select("id", "module", F.regexp_extract("entry", r"^(\S+)", 1).alias("path"), F.regexp_extract("entry", r"(\S+)$", 1).alias("version"))
