"""Secret scans over a ledger of blobs, in DataFrame functions only.

Every version of every path is content-addressed (SHA-256). The ledger, a
Parquet table, says for each blob which rule versions have scanned it and what
they found. A run scans only pairs of blob and rule version that the ledger
does not have: equal contents are scanned once, whatever the number of their
paths, and a changed rule rescans with that rule alone. Findings are joined
back to all paths. Ids and hashes are grouped in narrow rows; a text is scanned
in the task that reads it while few rows need no scan, and moves once otherwise.

Defined results: a null content is an empty blob; paths may repeat and each row
is reported; runs that scan one blob at once report its findings once; a null path is a path; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialise
from .spans import add_spans

#: Rows of path and blob up to which a counted table is broadcast.
BROADCAST_ROWS = 200_000
LEDGER = "blob binary, scanned array<string>, findings array<struct<rule:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern with a version. Matches whose ``group`` is shorter than ``least`` are dropped, without another try.

    ``hint`` is a text that every match contains, or a cheap pattern.
    """

    name: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    def findings(self, spans: Column) -> Column:
        long_enough = F.filter(spans, lambda s: F.char_length(s["value"]) >= self.least)
        return F.transform(long_enough, lambda s: F.struct(F.lit(self.name).alias("rule"), s["start"].alias("start"), s["end"].alias("end")))


RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)(?:passw|secret|token|api_?key)", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", "AKIA", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", "[0-9a-f]{24}", 0, 24),
    Rule("private_key", 1, r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("forge_token", 1, r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", r"gh[pousr]_|glpat-"),
    Rule("chat_token", 1, r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
    Rule("web_token", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
)
#: The kinds of the base, in order.
BASE = ("assign", "access", "hex")


def blob_of(content: Column) -> Column:
    return F.unhex(F.sha2(F.encode(F.coalesce(content, F.lit("")), "UTF-8"), 256))


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger at ``path``; empty if there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(LEDGER)])


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows for ``blob, body, pending``: each blob is searched by its pending rules alone."""
    names = []
    for rule in rules:
        wanted = F.array_contains("pending", rule.key) & F.col("body").rlike(rule.hint)
        blobs = add_spans(blobs, f"__{rule.name}", "body", rule.pattern, wanted, rule.group)
        names.append(rule.findings(F.col(f"__{rule.name}")))
    return blobs.select("blob", F.col("pending").alias("scanned"), F.concat(*names).alias("findings"))


def _unseen(versions: DataFrame, index: DataFrame, pending: DataFrame, everything: Column) -> DataFrame:
    """``blob, body, pending``: one text (a few, if a path repeats it) of each blob that is to be scanned.

    Texts stay where they are read while either the pending blobs or the rows
    that need no scan, or not by all rules, are at most ``BROADCAST_ROWS``,
    counted: these are broadcast. Beyond that, texts meet the pending blobs in
    an exchange.
    """
    v = versions.withColumn("blob", blob_of(F.col("body"))).alias("v")

    def picked(rows: DataFrame) -> DataFrame:
        # both keys, since a path may have many versions
        p = rows.alias("p")
        return v.join(p, F.col("v.path").eqNullSafe(F.col("p.pick")) & (F.col("v.blob") == F.col("p.blob"))).select("v.blob", "v.body", "p.pending")

    if pending.count() <= BROADCAST_ROWS:
        return picked(F.broadcast(pending))
    new, older = pending.where(F.size("pending") == F.size(everything)), pending.where(F.size("pending") < F.size(everything))
    i, n = index.alias("i"), new.alias("n")
    others = materialise(i.join(n, F.col("i.path").eqNullSafe(F.col("n.pick")) & (F.col("i.blob") == F.col("n.blob")), "left_anti").distinct(), "not-new")
    if others.count() > BROADCAST_ROWS:
        return picked(pending)
    o = F.broadcast(others).alias("o")
    fresh = v.join(o, F.col("v.path").eqNullSafe(F.col("o.path")) & (F.col("v.blob") == F.col("o.blob")), "left_anti").select("blob", "body", everything.alias("pending"))
    # not new, so at most as many as were counted
    return fresh.unionByName(picked(F.broadcast(older)))


def update(df: DataFrame, ledger: str, path_col: str = "path", text_col: str = "content", rules=RULES) -> DataFrame:
    """Scan what ``ledger`` has not seen, append it, and give ``path, blob`` of every row."""
    spark = df.sparkSession
    versions = df.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    index = materialise(versions.select("path", blob_of(F.col("body")).alias("blob")), "versions")
    seen = read_ledger(spark, ledger).groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("seen"))
    everything = F.array(*[F.lit(r.key) for r in rules])
    blobs = index.groupBy("blob").agg(F.min("path").alias("pick")).join(seen, "blob", "left")
    pending = blobs.select("blob", "pick", F.array_except(everything, F.coalesce("seen", F.array().cast("array<string>"))).alias("pending")).where(F.size("pending") > 0)
    pending = materialise(pending, "pending")
    todo = _unseen(versions, index, pending, everything)
    scan(todo, rules).dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    return index


def report(index: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """``path, blob, findings`` of every row of ``index``: what the current rule versions found in its blob."""
    current = F.array(*[F.lit(r.key) for r in rules])
    rows = read_ledger(index.sparkSession, ledger)
    # a row whose rules are outdated as a whole has nothing to add
    live = rows.where(F.size(F.array_intersect("scanned", current)) > 0)
    names = F.transform(F.array_intersect("scanned", current), lambda k: F.element_at(F.split(k, "@"), 1))
    live = live.select("blob", F.filter("findings", lambda f: F.array_contains(names, f["rule"])).alias("findings"))
    # a row per blob, written so that Spark can split a hot blob of the index
    # a finding counts once, even if two runs at the same time scanned its blob
    once = materialise(live.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings")), "findings")
    return index.join(once, "blob").select("path", "blob", "findings")
