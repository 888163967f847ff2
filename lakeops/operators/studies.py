"""Resolving, converting and reporting imaging studies."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.functions.studies import (
    PROBLEMS, RC_NO_IMAGES, RC_PARTIAL, REPORT_COLUMNS, STATUSES, STUDY_NAME,
    glob_base, glob_regex, glob_stem, has_glob, is_prefix_glob, is_report_path, study_accession, study_exam_date,
)
from lakeops.operators.skew import lookup_join
from lakeops.operators.supervised import ItemFailed, Supervised
from lakeops.session import durable


def check_selection(paths: list[str] | None, cohort_bucket: str | None, cohort_key: str | None) -> None:
    """Studies come either from a list of paths or from a cohort file, fully named."""
    if (cohort_bucket is None) != (cohort_key is None):
        raise ValueError("a cohort file needs both its bucket and its key")
    if paths and cohort_key:
        raise ValueError("studies come from paths or from a cohort file, not from both")
    if not paths and not cohort_key:
        raise ValueError("nothing selects the studies: give paths or a cohort file")


def _folder(key: str) -> Column:
    return F.regexp_extract(key, "^(.*)/[^/]*$", 1)


def _depth(path: str) -> Column:
    return F.when(F.col(path) == "", 0).otherwise(F.size(F.split(path, "/")))


def _depths(paths: DataFrame, path: str) -> list[int]:
    """Distinct segment counts of a set of paths: a handful of small numbers."""
    return sorted(row.depth for row in paths.select(_depth(path).alias("depth")).distinct().collect())


def stored_prefixes(objects: DataFrame, depths: list[int], key: str = "key") -> DataFrame:
    """Distinct folders of the given depths that hold objects at any level below."""
    folder = F.col("folder")
    above = [F.when(F.size(F.split(folder, "/")) >= d, F.substring_index(folder, "/", d)) for d in depths if d > 0]
    folders = objects.select(_folder(key).alias("folder"))
    return folders.select(F.explode(F.array(*above, F.lit(None).cast("string"))).alias("prefix")).where("prefix IS NOT NULL").distinct()


def study_candidates(objects: DataFrame, depths: list[int], key: str = "key") -> DataFrame:
    """``(depth, study)``: the first study folder met below each folder of the given depths.

    Objects are folded to their folders first, so that the expression runs once per folder and depth
    that some pattern starts from; the result grows with the folders, not with patterns times folders.
    """
    folder = F.col("folder")
    name = STUDY_NAME.removeprefix("^")
    pairs = F.array(*[
        F.struct(
            F.lit(d).alias("depth"),
            F.regexp_extract(folder, f"^((?:[^/]*/){{{d}}}(?:[^/]*/)*?{name}[^/]*)(?:/|$)", 1).alias("study"),
        )
        for d in depths
    ])
    folders = objects.select(_folder(key).alias("folder")).distinct()
    return folders.select(F.inline(pairs)).where("study <> ''").distinct()


def _below(objects: DataFrame, stems: DataFrame, key: str) -> DataFrame:
    """Objects whose keys can start with one of ``stems``: they start with what all stems start with, and lie
    between the first and the last of them. Both are literals, so the scan can skip by them, and one
    row is all that is fetched to know them."""
    ends = stems.agg(F.min("stem").alias("low"), F.max("stem").alias("high")).first()
    if ends.low is None:
        return objects
    shared = os.path.commonprefix([ends.low, ends.high])
    c = F.col(key)
    return objects.where(c.startswith(shared) & (c >= ends.low) & (c < f"{ends.high}\U0010ffff"))


def _anchor(text: Column) -> Column:
    """The longest literal text that starts a segment of a pattern after its base; every match has a segment
    that starts with it."""
    plain = F.split(F.regexp_extract(text, r"^[^\[]*", 0), "/")  # a bracket may hold a slash
    heads = F.transform(F.slice(plain, F.col("depth") + 1, F.size(plain)), lambda s: F.regexp_extract(s, "^[^*?]*", 0))
    return F.array_max(F.transform(heads, lambda h: F.struct(F.length(h).alias("n"), h.alias("head"))))["head"]


#: Characters of a gram; literal texts that are shorter are grams themselves.
GRAM = 3


def _pattern_grams(text: Column) -> Column:
    """Grams of the literal texts of a pattern, which every match holds; one empty gram if there is no literal."""
    texts = F.filter(F.split(text, r"\*|\?|\[!?\]?[^\]]*\]"), lambda t: t != "")
    grams = F.flatten(F.transform(texts, lambda t: F.when(F.length(t) <= GRAM, F.array(t)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(t) - (GRAM - 1)), lambda i: F.substr(t, i, F.lit(GRAM))))))
    return F.when(F.size(grams) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(grams))


def _text_grams(text: Column, sizes: list[int]) -> Column:
    """Distinct grams of a text, of the sizes that patterns have."""
    def of(n: int) -> Column:
        if n == 0:
            return F.array(F.lit(""))
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def _match_by_grams(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """Matches of patterns no segment of which starts with a literal text.

    A pattern meets the studies that hold the rarest of its grams. Studies are keyed by those of their
    grams that some pattern has, and counted per gram before any pattern is joined.
    """
    wanted = durable(patterns.select("ordinal", "pattern", "depth", "regex", _pattern_grams(F.col("bare")).alias("grams")))
    each = wanted.select("ordinal", "pattern", "depth", "regex", F.explode("grams").alias("gram"))
    needed = each.select("depth", "gram").distinct()
    sizes = sorted(r.n for r in needed.select(F.length("gram").alias("n")).distinct().collect())
    if not sizes:
        return found.select(F.lit(0).alias("ordinal"), F.lit("").alias("pattern"), "study").limit(0)
    held = durable(lookup_join(found.select("depth", "study", F.explode(_text_grams(F.col("study"), sizes)).alias("gram")), needed, ["depth", "gram"], "left_semi"))
    often = held.groupBy("depth", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(often, ["depth", "gram"], "left").groupBy("ordinal", "pattern", "depth", "regex").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("x"))
    chosen = rarest.select("ordinal", "pattern", "regex", "depth", F.col("x.gram").alias("gram"))
    return lookup_join(held, chosen, ["depth", "gram"]).where(F.rlike("study", F.col("regex"))).select("ordinal", "pattern", "study")


def match_studies(objects: DataFrame, patterns: DataFrame, key: str = "key") -> DataFrame:
    """``(ordinal, pattern, study)`` for every study a pattern selects.

    ``patterns`` holds ``ordinal`` and ``pattern``. An exact study path stands for itself even when
    nothing is stored there. Any other pattern is joined on two texts of its own, which is an equality:
    its stem, which all its matches start with, and its anchor, the longest text some segment of a match
    starts with. Only patterns with more than a final wildcard leave a regular expression to test, and
    only against studies that share both. Studies are keyed once per distinct pair of lengths, so
    candidates grow with the studies and not with patterns times studies, also where thousands of
    patterns have one stem. Patterns without an anchor meet studies on the rarest of their grams
    (``_match_by_grams``). What lies outside the literal text of all patterns is not scanned.
    """
    bare = patterns.withColumn("bare", F.rtrim("pattern", F.lit("/"))).where("bare <> ''")
    text = F.col("bare")
    wild = has_glob(text)
    exact = ~wild & F.element_at(F.split(text, "/"), -1).rlike(STUDY_NAME)
    named = bare.where(exact).select("ordinal", "pattern", text.alias("study"))
    base = F.when(wild, glob_base(text)).otherwise(text)
    regex = F.when(wild & ~is_prefix_glob(text), glob_regex(text))
    walked = bare.where(~exact).select(
        "ordinal", "pattern", "bare", base.alias("base"),
        F.when(wild, glob_stem(text)).otherwise(F.concat(text, F.lit("/"))).alias("stem"), regex.alias("regex"),
    ).withColumn("depth", _depth("base"))
    walked = walked.withColumn("anchor", F.when(F.col("regex").isNotNull(), F.coalesce(_anchor(F.col("bare")), F.lit(""))).otherwise(F.lit("")))
    loose = F.col("regex").isNotNull() & (F.col("anchor") == "")
    shapes = sorted(walked.select("depth", F.length("stem").alias("n"), F.length("anchor").alias("m"), loose.alias("loose")).distinct().collect())
    if not shapes:
        return named
    found = study_candidates(_below(objects, walked.select("stem"), key), sorted({s.depth for s in shapes}), key)
    if any(s.loose for s in shapes):
        found = durable(found)
        named = named.unionByName(_match_by_grams(found, walked.where(loose)))
    shapes = sorted({(s.depth, s.n, s.m) for s in shapes if not s.loose})
    if not shapes:
        return named
    kinds = F.array(*[F.struct(F.lit(s[0]).alias("kind"), F.lit(s[1]).alias("n"), F.lit(s[2]).alias("m")) for s in shapes])
    fitting = found.select("depth", "study", F.inline(kinds)).where("kind = depth AND length(study) >= n")
    long = F.filter(F.split("study", "/"), lambda s: F.length(s) >= F.col("m"))
    anchors = F.when(F.col("m") == 0, F.array(F.lit(""))).otherwise(
        F.array_distinct(F.transform(long, lambda s: F.substr(s, F.lit(1), F.col("m")))))
    keyed = fitting.select("depth", F.substr("study", F.lit(1), F.col("n")).alias("stem"), F.explode(anchors).alias("anchor"), "study")
    fits = F.col("regex").isNull() | F.rlike("study", F.col("regex"))
    matched = keyed.join(walked.where(~loose).drop("bare", "base"), ["depth", "stem", "anchor"]).where(fits)
    return named.unionByName(matched.select("ordinal", "pattern", "study"))


def split_existing(studies: DataFrame, objects: DataFrame, key: str = "key") -> DataFrame:
    """``present`` tells whether anything is stored below the study."""
    stored = stored_prefixes(objects, _depths(studies, "study"), key).withColumnRenamed("prefix", "study")
    return studies.join(stored.withColumn("present", F.lit(True)), "study", "left").fillna(False, ["present"])


def objects_of_studies(objects: DataFrame, studies: DataFrame, key: str = "key") -> DataFrame:
    """``(study, key)`` of every object below one of the ``studies``, by equality of the folder; one study may
    hold any share of the objects."""
    depths = _depths(studies, "study")
    above = [F.when(F.size(F.split(key, "/")) > d, F.substring_index(key, "/", d)) for d in depths if d > 0]
    if not above:
        return objects.select(F.lit("").alias("study"), key).limit(0)
    keyed = objects.select(key, F.explode(F.array(*above)).alias("study")).where("study IS NOT NULL")
    return lookup_join(keyed, studies.select("study").distinct(), ["study"], "left_semi").select("study", key)


def unmatched_patterns(patterns: DataFrame, resolved: DataFrame) -> DataFrame:
    return patterns.join(resolved.select("ordinal").distinct(), "ordinal", "left_anti")


def missing_studies(patterns: DataFrame, resolved: DataFrame, objects: DataFrame, key: str = "key") -> DataFrame:
    """Patterns that matched nothing, then resolved studies that hold no object.

    ``rank`` keeps the order of the list: pattern order first, empty studies after them by name.
    """
    unmatched = unmatched_patterns(patterns, resolved).select(
        F.lit("unmatched").alias("reason"), F.col("pattern").alias("item"), F.col("ordinal").cast("bigint").alias("rank")
    )
    empty = (
        split_existing(resolved.select("study").distinct(), objects, key).where(~F.col("present"))
        .select(F.lit("empty").alias("reason"), F.col("study").alias("item"), F.lit((1 << 62)).cast("bigint").alias("rank"))
    )
    return unmatched.unionByName(empty)


def top_missing(missing: DataFrame, patterns: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` missing items with the totals they belong to."""
    totals = missing.agg(F.count(F.lit(1)).alias("n"))
    asked = patterns.agg(F.count(F.lit(1)).alias("n"))
    return (
        missing.orderBy("rank", "item").limit(n)
        .withColumn("n_missing", totals.scalar())
        .withColumn("n_patterns", asked.scalar())
        .select("item", "reason", "n_missing", "n_patterns")
    )


def report_only(objects: DataFrame, study: str, path: str) -> DataFrame:
    """Per study: object count and whether every object belongs to a report series.

    A study without objects has no row here and is not report-only.
    """
    return objects.groupBy(study).agg(
        F.count(F.lit(1)).alias("n_objects"),
        F.bool_and(is_report_path(F.col(path))).alias("report_only"),
    )


def study_status(skip_existing: bool) -> Column:
    """Status of a study from its facts, first rule that holds.

    Facts: ``output_exists``, ``n_objects``, ``rc``, ``report_only``, ``output_files`` and
    ``error``, the message of a conversion that raised.
    """
    rc = F.col("rc")
    return (
        F.when(F.lit(skip_existing) & F.col("output_exists"), "skipped")
        .when(F.col("n_objects") == 0, "missing")
        .when(F.col("error").isNotNull(), "failed")
        .when((rc == RC_NO_IMAGES) & F.col("report_only"), "report only")
        .when(~rc.isin(0, RC_PARTIAL), "failed")
        .when(F.col("output_files") == 0, "failed")
        .when(rc == RC_PARTIAL, "partial")
        .otherwise("ok")
    )


def classify_studies(facts: DataFrame, skip_existing: bool = True, log_chars: int | None = None) -> DataFrame:
    """Outcome of every study: status, exit code when the tool's verdict stood, files, upload, log.

    Logs are carried whole; ``log_chars`` keeps only that many characters of the end of a failed
    study's log.
    """
    with_error = facts if "error" in facts.columns else facts.withColumn("error", F.lit(None).cast("string"))
    log = F.col("log") if log_chars is None else F.substring("log", -log_chars, log_chars)
    why = (
        F.when(F.col("rc") == RC_NO_IMAGES, "no images converted although some series are images")
        .when(~F.col("rc").isin(0, RC_PARTIAL), "converter gave up")
        .otherwise("converter wrote no file")
    )
    failure = F.coalesce("error", F.concat(why, F.lit(" (exit code "), F.col("rc").cast("string"), F.lit("): "), log))
    status = F.col("status")
    done = status.isin("ok", "partial")
    return with_error.withColumn("status", study_status(skip_existing)).select(
        "study", "status",
        F.when(done | (status == "report only"), F.col("rc")).alias("exit_code"),
        F.when(done, F.col("output_files")).otherwise(F.lit(0)).cast("bigint").alias("files_converted"),
        done.alias("uploaded"),
        F.when(status.isin("partial", "report only"), F.col("log"))
        .when(status == "failed", failure).otherwise("").alias("output"),
    )


def status_summary(outcomes: DataFrame) -> DataFrame:
    """Studies per status in fixed order, zeros included."""
    spark = outcomes.sparkSession
    names = spark.range(len(STATUSES)).select(
        F.col("id").alias("position"),
        F.get(F.array(*[F.lit(s) for s in STATUSES]), F.col("id").cast("int")).alias("status"),
    )
    counted = outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counted, "status", "left").fillna(0, ["n"]).select("position", "status", "n")


def problem_report(outcomes: DataFrame) -> DataFrame:
    """The report of studies worth a look, one line each, in the published column order."""
    return outcomes.where(F.col("status").isin(PROBLEMS)).select(
        study_accession(F.col("study")).alias("accession"),
        study_exam_date(F.col("study")).alias("exam_date"),
        F.col("study").alias("path"),
        "status",
        F.coalesce(F.col("exit_code").cast("string"), F.lit("")).alias("exit_code"),
        F.when(F.col("uploaded"), "yes").otherwise("no").alias("uploaded"),
        "files_converted",
        "output",
    ).select(*REPORT_COLUMNS)


# Fixed value: seconds that the conversion of one study may take.
CONVERT_SECONDS = 1800.0

# A converter takes the facts of one study and returns exit code, number of files written and log.
Converter = Callable[[dict[str, Any]], dict[str, Any]]

# A cleaner takes the facts of one study and removes what an earlier conversion wrote for it.
Cleaner = Callable[[dict[str, Any]], None]


def convert_studies(
    facts: DataFrame, make_converter: Callable[[], Converter], skip_existing: bool = True, tasks: int | None = None,
    make_cleaner: Callable[[], Cleaner] | None = None, limit_seconds: float | None = CONVERT_SECONDS,
) -> DataFrame:
    """Run a converter on each study and add ``rc``, ``output_files``, ``log`` and ``error``.

    ``facts`` has one row per study with ``study``, ``n_objects`` and ``output_exists``; the
    converter fetches the objects below the study itself, so no task ever holds the listing of one.
    With ``skip_existing`` off, a cleaner removes earlier output of a study before it is converted again.
    An exception becomes the error of its own study, and so does a conversion that takes longer than
    ``limit_seconds``: it runs in a process of its own, which is ended then, and the next study gets a
    new one. Without a limit the converter runs in the task itself. Rows are spread by study over a fixed number of
    tasks: they are tiny but each takes long, and coalescing by size would serialize them.
    """
    spark = facts.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism * 4
    schema = f"{', '.join(f'`{n}` {t}' for n, t in facts.dtypes)}, rc int, output_files bigint, log string, error string"

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        converter = Supervised(make_converter, limit_seconds) if limit_seconds else make_converter()
        cleaner = make_cleaner() if make_cleaner else None
        for batch in batches:
            results = []
            for row in batch.to_dict("records"):
                if (skip_existing and row["output_exists"]) or row["n_objects"] == 0:
                    results.append((None, None, None, None))
                    continue
                try:
                    if cleaner and row["output_exists"]:
                        cleaner(row)
                    done = converter(row)
                    results.append((done["rc"], done["output_files"], done["log"], None))
                except ItemFailed as bad:
                    results.append((None, None, None, str(bad)))
                except Exception as bad:  # one study never takes the batch with it
                    results.append((None, None, None, f"{type(bad).__name__}: {bad}"))
            added = pd.DataFrame(results, columns=["rc", "output_files", "log", "error"], index=batch.index)
            added = added.astype({"rc": "Int32", "output_files": "Int64"})
            yield pd.concat([batch, added], axis=1)
        if limit_seconds:
            converter.close()

    return facts.repartition(tasks, "study").mapInPandas(convert, schema)


def require_no_failure(outcomes: DataFrame, named: int = 20) -> None:
    """Fail the run at its end if any study failed; ``named`` of them are named in the message."""
    failed = outcomes.where(F.col("status") == "failed")
    n = failed.count()
    if n:
        names = [r.study for r in failed.select("study").orderBy("study").limit(named).collect()]
        raise RuntimeError(f"{n} studies failed: {names}")
