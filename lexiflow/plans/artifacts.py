"""The compiled relations, stored and kept up to date.

Relations are parquet tables in a folder named by the version of what they were compiled from; the
manifest, which names the version, is written last, so a reader never sees half of a compilation. Any
path that Spark reads and writes will do."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.operators.rules import default_rules
from lexiflow.plans.compile import LEXICON_STAGE, Compiled, compile_lexicon, migrate_legacy
from lexiflow.schema import ENTRY, RULE
from lexiflow.sources import lexicon as src

RELATIONS = ("entries", "excluded", "protected", "residual", "rules")
# The names of a data folder's files.
SOURCES = {"lexicon": "lexicon_entries.jsonl", "rules": "rule_entries.jsonl", "core": "core_lexicon.json", "allowlist": "char_verified_allowlist.txt"}
FOLDER = "artifacts"


def _files(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, modificationTime, length) of the files at path, without their content; None if there are none."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def sources_version(spark: SparkSession, data_dir: str) -> str:
    """Changes whenever a source file does, or the stage that the lexicon is made for."""
    parts = [LEXICON_STAGE]
    for name in SOURCES.values():
        if (files := _files(spark, f"{data_dir}/{name}")) is not None:
            line = F.concat_ws("|", "path", F.col("modificationTime").cast("string"), F.col("length").cast("string"))
            parts.append(files.agg(F.sha1(F.array_join(F.array_sort(F.collect_list(line)), ";"))).first()[0])
    return spark.range(1).select(F.sha1(F.lit("/".join(parts)))).first()[0]


def store(compiled: Compiled, path: str, version: str) -> None:
    for name in RELATIONS:
        getattr(compiled, name).write.mode("overwrite").parquet(f"{path}/{version}/{name}")
    compiled.manifest.withColumns({"version": F.lit(version), "generated_at": F.current_timestamp()}).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def load(spark: SparkSession, path: str) -> Compiled:
    found = manifest(spark, path)
    if found is None:
        raise FileNotFoundError(f"nothing compiled at {path}")
    version = found.first().version
    return Compiled(*(spark.read.parquet(f"{path}/{version}/{name}") for name in RELATIONS), manifest=found)


def compile_stored(spark: SparkSession, data_dir: str, *, fail_on_lint: bool = False) -> Compiled:
    """Compile the sources of a data folder, store the relations and read them back."""
    at = {k: f"{data_dir}/{name}" for k, name in SOURCES.items()}
    made = compile_lexicon(src.read_entries(spark, at["lexicon"]).drop("line_no"), src.read_core(spark, at["core"]), src.read_allowlist(spark, at["allowlist"]), src.read_rules(spark, at["rules"]), fail_on_lint=fail_on_lint)
    store(made, f"{data_dir}/{FOLDER}", sources_version(spark, data_dir))
    return load(spark, f"{data_dir}/{FOLDER}")


def ensure_ready(spark: SparkSession, data_dir: str, *, legacy: tuple[DataFrame, DataFrame] | None = None, fail_on_lint: bool = False) -> Compiled:
    """The compiled relations of a data folder, compiled anew only if a source has changed since or they were made for
    another stage. Without a lexicon, one is migrated from the legacy (src, tgt) tables of phrases and
    characters; without rules, the default ones are written."""
    if _files(spark, f"{data_dir}/{SOURCES['lexicon']}") is None:
        empty = spark.createDataFrame([], "src string, tgt string")
        rows = migrate_legacy(*(legacy or (empty, empty)), src.read_allowlist(spark, f"{data_dir}/{SOURCES['allowlist']}"))
        names = [c.split()[0] for c in ENTRY.split(", ") if c.split()[0] in rows.columns]
        src.write_jsonl(rows.select(*names), f"{data_dir}/{SOURCES['lexicon']}")
    if _files(spark, f"{data_dir}/{SOURCES['rules']}") is None:
        src.write_jsonl(default_rules(spark).select(*(c.split()[0] for c in RULE.split(", "))), f"{data_dir}/{SOURCES['rules']}")
    found = manifest(spark, f"{data_dir}/{FOLDER}")
    if found is not None and (row := found.first()).version == sources_version(spark, data_dir) and row.lexicon_stage == LEXICON_STAGE:
        return load(spark, f"{data_dir}/{FOLDER}")
    return compile_stored(spark, data_dir, fail_on_lint=fail_on_lint)
