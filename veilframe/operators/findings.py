"""Findings of language models: parsing their answers and locating what they found."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..categories import model_category
from ..functions.text import occurrences
from ..options import CATEGORY_SWITCH, Options
from ..shared import exists, materialize
from .detectors import CANDIDATES, PLACE_BITS
from .literals import terms_by_text

#: The priority of findings: after all patterns.
PRIORITY = 13
#: Where their ``seq`` begins: behind all detectors.
FIRST = 1 << 16 << PLACE_BITS
ENTITIES = "struct<entities:array<struct<text:string,category:string>>>"


def parse_answer(answer: Column) -> Column:
    """An answer's findings, ``array<struct<text, category>>``: whatever surrounds the JSON object is ignored, as are
    unusable entries; of equal texts the first stays.  An unusable answer has none."""
    first, last = F.instr(answer, "{"), F.length(answer) - F.instr(F.reverse(answer), "}") + 1
    body = F.when((first > 0) & (F.instr(answer, "}") > 0) & (last > first), F.substring(answer, first, last - first + 1))
    # entries are parsed one by one, so that one of a wrong kind does not spoil the others
    items = F.from_json(F.get_json_object(body, "$.entities"), "array<string>")
    pairs = F.transform(items, lambda i: F.struct(F.trim(F.get_json_object(i, "$.text")).alias("text"), F.get_json_object(i, "$.category").alias("category")))
    usable = F.filter(pairs, lambda p: p["text"].isNotNull() & (p["text"] != ""))
    texts = F.array_distinct(F.transform(usable, lambda p: p["text"]))
    found = F.transform(texts, lambda t: F.struct(t.alias("text"), F.coalesce(model_category(F.filter(usable, lambda p: p["text"] == t)[0]["category"]), F.lit("term")).alias("category")))
    return F.coalesce(found, F.array().cast("array<struct<text:string,category:string>>"))


def valid_findings(findings: Column, options: Options) -> Column:
    """Trimmed, at least two characters, without brackets, of a wanted category (unknown ones are)."""
    off = [c for c in CATEGORY_SWITCH if not options.enabled(c)]
    trimmed = F.transform(findings, lambda f: f.withField("text", F.trim(f["text"])))
    return F.filter(trimmed, lambda f: (F.length(f["text"]) >= 2) & ~f["text"].rlike(r"[\[\]]") & ~(f["category"].isin(*off) if off else F.lit(False)))


def locate(text: Column, findings: Column) -> Column:
    """Candidates at all occurrences of each finding; where there is none, at those that differ in case."""

    def places(f: Column, k: Column) -> Column:
        exact = occurrences(text, f["text"])
        starts = F.when(F.size(exact) > 0, exact).otherwise(occurrences(text, f["text"], "(?iU)"))
        return F.transform(starts, lambda s, i: F.struct(s.cast("int").alias("start"), F.length(f["text"]).alias("len"), F.substring(text, s + 1, F.length(f["text"])).alias("original"), f["category"].alias("category"), F.lit(PRIORITY).alias("priority"), (F.lit(FIRST) + k.cast("long") * (1 << PLACE_BITS) + i).alias("seq")))

    return F.flatten(F.transform(findings, places)).cast(CANDIDATES)


def with_findings(found: DataFrame, findings: DataFrame, options: Options, text: str = "text") -> DataFrame:
    """Adds located findings of the row's scope to its candidates.

    A row only looks for those of its scope's findings that can stand in it (``literals.terms_by_text``), so scopes may have
    any number of texts and findings.
    """
    wanted = valid_findings(F.array(F.struct("text", "category")), options)
    usable = findings.select("scope_id", "seq", F.explode(wanted).alias("f")).select("scope_id", "seq", "f.text", "f.category")
    row = materialize(found.withColumn("_row", F.monotonically_increasing_id()), "candidates")
    near = terms_by_text(row, usable, ("_row",), "scope_id", text)
    joined = row.join(near, "_row", "left")
    none = F.array().cast(CANDIDATES)
    terms = F.transform("found", lambda f: F.struct(f["text"].alias("text"), f["category"].alias("category")))
    return joined.withColumn("candidates", F.concat("candidates", F.coalesce(locate(F.col(text), terms), none))).drop("found", "_row")


def ask_model(texts: DataFrame, detector: Callable[[list[str]], list[str]], text: str = "text") -> DataFrame:
    """Adds ``answer``: what a pluggable callable returns for each batch of texts."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(answer=detector(batch[text].fillna("").tolist()))

    return texts.mapInPandas(ask, f"{texts.schema.simpleString()[:-1]},answer:string>")


def ask_known(texts: DataFrame, detector: Callable[[list[str]], list[str]], path: str, model: str, text: str = "text", batch: int = 32) -> DataFrame:
    """Adds ``answer`` as ``ask_model`` does, but asks each different text only once, in all runs with one ``path`` and ``model``.

    Answers are kept in a table by model and the text's SHA-256.  The texts that it lacks are asked ``batch`` at a time and
    appended before any answer is used, so a run that fails later asks nothing twice.  Null texts count as empty.
    """
    spark = texts.sparkSession
    hashed = texts.withColumn("_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    fresh = hashed.groupBy("_hash").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("_text"))

    def known() -> DataFrame:
        rows = spark.read.schema("_hash string, answer string, model string").parquet(path).where(F.col("model") == model)
        return rows.groupBy("_hash").agg(F.min("answer").alias("answer"))

    if exists(spark, path):
        fresh = fresh.join(known().select("_hash"), "_hash", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                yield pd.DataFrame({"_hash": part["_hash"], "answer": detector(part["_text"].tolist())})

    answered = fresh.mapInPandas(ask, "_hash string, answer string").withColumn("model", F.lit(model))
    answered.write.mode("append").partitionBy("model").parquet(path)
    return hashed.join(known(), "_hash", "left").drop("_hash")


def pull_progress(line: Column) -> Column:
    """A line of download progress as ``(status, percent, is_success, is_error)``; null for lines that are no object."""
    line = F.trim(line)
    error, total, done = (F.get_json_object(line, f"$.{k}") for k in ("error", "total", "completed"))
    failed = F.get_json_object(line, "$").isNotNull() & line.startswith("{") & F.array_contains(F.coalesce(F.json_object_keys(line), F.array().cast("array<string>")), "error")
    whole, part = total.try_cast("double"), done.try_cast("double")
    usable = (whole > 0) & ~F.isnan(whole) & ~F.isnan(part)
    # divided before it is multiplied only where the product would be no number
    share = F.when(part < 1e300, part * 100 / whole).otherwise(part / whole * 100)
    percent = F.when(usable & part.isNotNull(), F.floor(F.least(F.greatest(F.lit(0.0), share), F.lit(100.0))).cast("int"))
    status = F.coalesce(F.get_json_object(line, "$.status"), F.lit(""))
    good = F.struct(status.alias("status"), percent.alias("percent"), (F.lower(status) == "success").alias("is_success"), F.lit(False).alias("is_error"))
    bad = F.struct(F.coalesce(error, F.lit("error")).alias("status"), F.lit(None).cast("int").alias("percent"), F.lit(False).alias("is_success"), F.lit(True).alias("is_error"))
    return F.when(F.json_object_keys(line).isNull(), F.lit(None)).when(failed, bad).otherwise(good)


def latest_runs(results: DataFrame, key: str = "scope_id") -> DataFrame:
    """Per scope the result of the newest run, of its phases the last (patterns first, findings later)."""
    columns = [c for c in results.columns if c != key]
    best = results.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("run_gen", "phase")).alias("r"))
    return best.select(key, "r.*")
