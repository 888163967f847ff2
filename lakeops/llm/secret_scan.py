"""Secret scans over every version of every path, with a ledger of content-addressed blobs.

A blob is a text, named by its SHA-256. The ledger remembers which pairs of blob and rule version have
been scanned and what was found. A run takes any number of versions (rows with a key and a text),
looks up which pairs are new, scans each new blob once however many versions share it, and joins the
findings of all runs back to all versions. Publishing a rule again under a higher version scans known
blobs for that rule alone.

Everything here is DataFrame expressions. Literal gates (a substring that each match must contain) come
before patterns, so most texts meet no pattern at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeops.operators.skew import lookup_join
from lakeops.session import scratch_dir
from lakeops.sources.store import Store


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` from left to right without overlap; those whose ``group`` has fewer than
    ``least`` characters are dropped. ``gates``: a text without any of these (in lower case, if
    ``folded``) has no match; none: the pattern itself is the gate."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    gates: tuple[str, ...] = ()
    folded: bool = False
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: In the order in which kinds are listed. Runs of a class with a least length are the same matches as
#: shorter runs dropped afterwards, because a run is maximal.
BASE = (
    Rule("assign", ASSIGN, least=6, group=2, gates=("passw", "secret", "token", "api_key", "apikey"), folded=True),
    Rule("access", "AKIA[A-Z0-9]{16,}", gates=("AKIA",)),
    Rule("hex", "[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("forge", "gh[oprsu]_[A-Za-z0-9]{36,}", gates=("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", gates=("eyJ",)),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", gates=("PRIVATE KEY-----",)),
)

_BASE64 = r"[A-Za-z0-9+/]"
_LINE_ENDS = r"(?=[\x20\t]*+(?:[\r\n\\]|$))"
_NEW_LINE = r"(?:[\x20\t]*+(?:\r?\n|(?:\\r)?\\n))++[\x20\t]*+"
#: A private key with its body: RFC 1421 headers and base64 up to the END line, whether lines are cut by line
#: feeds, blanks or escapes, or are quoted. Without an END line, long runs and whole lines of base64, the
#: first of 16 characters or more. Repeats are possessive, so nothing is tried twice or recursed into.
PEM_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    rf"(?:{_NEW_LINE}(?:Proc-Type|DEK-Info|Content-Domain|Comment):[^\r\n\\]*+)*+"
    r"(?:[A-Za-z0-9/=\s\"'+,>|#*\\]*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:(?:\s|\\[nrt])*+{_BASE64}{{40,}}+={{0,2}}|{_NEW_LINE}{_BASE64}{{16,}}+={{0,2}}{_LINE_ENDS})++"
    rf"(?:{_NEW_LINE}{_BASE64}{{1,63}}+={{0,2}}{_LINE_ENDS})?+)?+"
)
#: What is masked: as ``RULES``, but keys whole. ``RULES`` reports where a key begins.
MASKED = (*(r for r in RULES if r.kind != "pem"), Rule("pem", PEM_KEY, gates=("PRIVATE KEY-----",), version=2))


def blob_of(text: str | Column) -> Column:
    """Name of a text; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def _hits(rule: Rule, order: int) -> Column:
    """For a text with matches: the lengths of the gaps before them, of the matches and of the group."""
    text = F.col("text")
    if rule.gates:
        where = F.col("folded") if rule.folded else text
        gate = None
        for g in rule.gates:
            gate = F.contains(where, F.lit(g)) if gate is None else gate | F.contains(where, F.lit(g))
    else:
        gate = text.rlike(rule.pattern)
    pattern = F.lit(rule.pattern)
    lengths = lambda c: F.transform(c, F.length)
    return F.when(
        F.array_contains("todo", rule.name) & gate,
        F.struct(
            F.lit(order).alias("rule"), F.lit(rule.least).alias("least"),
            F.arrays_zip(
                lengths(F.split(text, rule.pattern, -1)).alias("gap"),
                lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("size"),
                lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("inner"),
            ).alias("hits"),
        ))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, rule, start, stop`` (code points, end exclusive) from ``blob, text, todo``, where
    ``todo`` names the rules to apply. A blob that occurs twice gives each finding once."""
    texts = blobs.select(
        "blob", "todo", "text", F.lower("text").alias("folded"), F.monotonically_increasing_id().alias("row"))
    found = texts.select("blob", "row", F.explode(F.array(*[_hits(r, i) for i, r in enumerate(rules)])).alias("h")).where("h IS NOT NULL")
    each = found.select("blob", "row", "h.rule", "h.least", F.posexplode("h.hits").alias("place", "hit")).where("hit.size IS NOT NULL")
    before = Window.partitionBy("blob", "row", "rule").orderBy("place")
    stop = F.sum(F.col("hit.gap") + F.col("hit.size")).over(before)
    spans = each.select("blob", "rule", "least", stop.alias("stop"), (stop - F.col("hit.size")).alias("start"), "hit.inner")
    names = F.array(*[F.lit(r.name) for r in rules])
    return spans.where("inner >= least").select("blob", names[F.col("rule")].alias("rule"), "start", "stop").distinct()


#: Session setting that names the folder of a ledger to go on with.
LEDGER = "lakeops.secret.ledger"


def ledger_path(spark: SparkSession, name: str) -> str:
    """Where the session keeps its ledger ``name``: below the folder that ``LEDGER`` names, so that a later run scans
    only what is new; without the setting a fresh folder."""
    base = spark.conf.get(LEDGER, None)
    return f"{base.rstrip('/')}/{name}" if base else scratch_dir(spark, f"secret_ledger_{name}")


class BlobLedger:
    """Findings per blob and rule version, in runs below ``path``.

    A run writes its findings first and the pairs it has scanned last; a run without the mark of a
    finished second table never happened, so a crash repeats work but loses and doubles nothing.
    """

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules, self._store = spark, path.rstrip("/"), rules, Store(spark)

    def _runs(self) -> list[str]:
        runs = [e.path for e in self._store.children(f"{self.path}/runs")]
        return [r for r in runs if self._store.exists(f"{r}/scanned/_SUCCESS")]

    def _all(self, table: str, schema: str) -> DataFrame:
        paths = [f"{r}/{table}" for r in self._runs()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        """``blob, rules``: rule versions that a run has applied to a blob."""
        return self._all("scanned", "blob string, rules array<string>")

    def findings(self) -> DataFrame:
        """``blob, rule, start, stop`` of all runs."""
        return self._all("findings", "blob string, rule string, start long, stop long")

    def todo(self, versions: DataFrame) -> DataFrame:
        """``blob, owner, todo`` for blobs of ``versions (path, blob)`` with rules left to apply; ``owner``
        is the version whose text is scanned for it."""
        current = F.array(*[F.lit(r.name) for r in self.rules])
        blobs = versions.groupBy("blob").agg(F.min("path").alias("owner"))
        if self._runs():
            done = self.scanned().groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done"))
            blobs = blobs.join(done, "blob", "left")
            current = F.when(F.col("done").isNull(), current).otherwise(F.array_except(current, "done"))
        return blobs.select("blob", "owner", current.alias("todo")).where(F.size("todo") > 0)

    def update(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Scan what is new in ``docs`` and return its versions, ``path, blob``."""
        named = docs.select(F.col(key).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        number = len(self._store.children(f"{self.path}/runs"))
        run = f"{self.path}/runs/{number:08d}"
        named.select("path", blob_of("text").alias("blob")).write.parquet(f"{run}/versions")
        versions = self.spark.read.parquet(f"{run}/versions")
        self.todo(versions).write.parquet(f"{run}/todo")
        todo = self.spark.read.parquet(f"{run}/todo")
        texts = named.withColumn("blob", blob_of("text")).join(
            todo.withColumnRenamed("blob", "b"), F.col("blob").eqNullSafe(F.col("b")) & F.col("path").eqNullSafe(F.col("owner")))
        scan_blobs(texts.select("blob", "text", "todo"), self.rules).write.parquet(f"{run}/findings")
        todo.select("blob", F.col("todo").alias("rules")).write.parquet(f"{run}/scanned")
        return versions

    def spans(self) -> DataFrame:
        """Per blob with findings of the current rule versions: ``spans``, an array of ``start, kind
        (place in the list of kinds), stop, covered`` in order; ``covered`` is how far the spans
        before reach."""
        names = [r.name for r in self.rules]
        kind = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("rule")).cast("int") - 1
        now = self.findings().where(F.col("rule").isin(names)).select("blob", "start", kind.alias("kind"), "stop")
        before = Window.partitionBy("blob").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
        now = now.withColumn("covered", F.coalesce(F.max("stop").over(before), F.lit(0)))
        return now.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "covered"))).alias("spans"))

    def report(self, versions: DataFrame) -> DataFrame:
        """``path, blob, spans`` for every version; ``spans`` is empty for clean ones."""
        return lookup_join(versions, self.spans(), ["blob"], "left").select(
            "path", "blob", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,covered:bigint>>")).alias("spans"))


def listed(spans: Column, rules: tuple[Rule, ...] = RULES, kinds: int | None = None) -> Column:
    """Spans as ``kind:start:end`` joined by commas; only the first ``kinds`` kinds, if given."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"] < kinds)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """``text`` with every stretch covered by spans replaced by ``mask``."""
    def piece(s):
        gap = F.substring(text, (s["covered"] + 1).cast("int"), F.greatest(s["start"] - s["covered"], F.lit(0)).cast("int"))
        return F.concat(gap, F.when(s["start"] >= s["covered"], F.lit(mask)).otherwise(F.lit("")))

    last = F.greatest(F.array_max(F.transform(spans, lambda s: s["stop"])), F.lit(0)).cast("int")
    return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, last + 1, F.length(text)))


def scan_and_redact(docs: DataFrame, ledger: BlobLedger, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with secrets in its texts masked; rows, columns and clean texts unchanged. Null texts
    stay null, repeated and null keys are rows like any other."""
    ledger.update(docs, key, text)
    names = {*docs.columns}
    own = next(f"__blob{i}" for i in range(len(names) + 1) if f"__blob{i}" not in names)
    spans = ledger.spans().select(F.col("blob").alias(own), F.col("spans").alias(f"{own}_spans")).hint("shuffle_hash")
    joined = lookup_join(docs.withColumn(own, blob_of(text)), spans, [own], "left")
    found = F.col(f"{own}_spans")
    return joined.withColumn(text, F.when(found.isNull(), F.col(text)).otherwise(redacted(F.col(text), found))).select(*docs.columns)
