"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every text is a blob addressed by its SHA-256. A ledger lists the (blob, rule version) pairs already scanned; only
unseen pairs are scanned, each blob once, and findings are joined back to all rows that hold the blob. A rule version is
a hash of the rules themselves, so changed rules never meet old findings. SecretLedger keeps pairs and findings in files;
scan_history applies one to a history given as several tables, one after the other.

Positions come from splitting a text by the rule's pattern: the pieces between matches and the matches alternate, so a
running sum of their lengths gives each match's start in code points.

Defined cases: a null text is the empty text, an empty text has no findings, rows that repeat each get their findings,
spans that tie in start go by the order of the rules, null ids stay, other columns are left out, an empty table gives an
empty result; a text's length is not limited.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, new_path, session_of

#: Kind, pattern, group whose length counts, least length. The first three are the base rules.
BASE_RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE_RULES = (
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20),
    ("pat", r"(?:ghp|gho|ghs|glpat|xoxb|xoxp|sk_live)[_-][A-Za-z0-9-]{16,}", 0, 20),
    ("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,80}:[^\s/:@]{4,80}@", 0, 10),
)
RULES = BASE_RULES + MORE_RULES
PAIR = "sha256 string, rule_version string"
FINDING = "sha256 string, rule_version string, kind string, rank int, start long, end long"


def version_of(rules) -> str:
    return hashlib.sha256(json.dumps(rules).encode()).hexdigest()[:16]


def blob_ids(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("sha256", F.sha2("text", 256))


def find_spans(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(sha256, text) -> one row per finding; leftmost and non-overlapping within each kind."""

    def parts(rank: int, kind: str, pattern: str, group: int, least: int):
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
        zipped = F.zip_with(F.split("text", pattern, -1), F.arrays_zip(found.alias("m"), value.alias("v")), lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit["m"]).alias("len"), F.length(hit["v"]).alias("vlen")))
        rows = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), (x["vlen"] >= least).alias("ok")))
        return F.when(F.col("text").rlike(pattern), rows)

    each = [parts(i, *rule) for i, rule in enumerate(rules)]
    none = F.expr("cast(array() as array<struct<kind:string,rank:int,i:int,gap:int,len:int,ok:boolean>>)")
    hits = blobs.select("sha256", F.explode(F.concat(*[F.coalesce(x, none) for x in each])).alias("x")).select("sha256", "x.*")
    before = Window.partitionBy("sha256", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.coalesce("len", F.lit(0))).cast("long")).over(before)
    return hits.withColumn("end", end).where("len is not null and ok").select("sha256", F.lit(version_of(rules)).alias("rule_version"), "kind", "rank", (F.col("end") - F.col("len")).alias("start"), "end")


def scan(docs: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, rules=RULES):
    """(blobs of all rows, findings, the new ledger).

    ledger: (sha256, rule_version) pairs scanned before; known: their findings. Both may be missing. Without known, the
    findings are those of the pairs scanned now alone.
    """
    version = version_of(rules)
    rows = blob_ids(docs)
    blobs = rows.groupBy("sha256").agg(F.first("text").alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == version), "sha256", "left_anti")
    findings = find_spans(blobs, rules)
    scanned = rows.select("sha256").distinct().withColumn("rule_version", F.lit(version))
    if known is not None:
        findings = findings.unionByName(known.where(F.col("rule_version") == version))
    if ledger is not None:
        scanned = scanned.unionByName(ledger.select("sha256", "rule_version")).distinct()
    return rows.select("doc_id", "sha256"), findings, scanned


def empty_ledger(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], PAIR), spark.createDataFrame([], FINDING)


class SecretLedger:
    """Pairs scanned and their findings, in files that grow by one batch for each push and never change.

    A push writes its findings before its pairs: one that breaks off in between is scanned again, and findings are read
    for pairs of the ledger, each once.
    """

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "ledger")

    def _read(self, name: str, schema: str) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if files.exists(at) else self.spark.createDataFrame([], schema)

    def pairs(self, rules=RULES) -> DataFrame:
        return self._read("pairs", PAIR).where(F.col("rule_version") == version_of(rules))

    def findings(self, rules=RULES) -> DataFrame:
        return self._read("findings", FINDING).where(F.col("rule_version") == version_of(rules)).distinct()

    def push(self, docs: DataFrame, rules=RULES) -> None:
        """Scan the blobs of docs that the ledger lacks under these rules."""
        seen = self.pairs(rules)
        blobs = blob_ids(docs).groupBy("sha256").agg(F.first("text").alias("text")).join(seen, "sha256", "left_anti")
        find_spans(blobs, rules).write.mode("append").parquet(f"{self.path}/findings")
        new = blob_ids(docs).select("sha256").distinct().join(seen, "sha256", "left_anti")
        new.withColumn("rule_version", F.lit(version_of(rules))).write.mode("append").parquet(f"{self.path}/pairs")


def scan_history(versions: list[DataFrame], ledger: SecretLedger, rules=RULES) -> DataFrame:
    """The findings of every row of all versions (doc_id, text), as counts and span lists: each blob is scanned once."""
    for docs in versions:
        ledger.push(docs, rules)
    rows = None
    for docs in versions:
        own = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
        rows = own if rows is None else rows.unionByName(own)
    return with_digests(rows, ledger.findings(rules), rules)


def with_digests(rows: DataFrame, findings: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, sha256) with the findings of each blob as counts and span lists."""
    span = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    base = len(BASE_RULES)
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["span"]), ",")
    one = F.struct("start", "rank", "end", span.alias("span"))
    digest = findings.groupBy("sha256").agg(
        *[F.count(F.when(F.col("rank") == i, 1)).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE_RULES)],
        listed(F.when(F.col("rank") < base, one)).alias("base"),
        listed(one).alias("all_spans"),
    )
    out = rows.join(cut(digest, "digests"), "sha256", "left")  # a join alone, so that a blob of many rows can be split
    zero = [F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k, *_ in BASE_RULES]
    return out.select("doc_id", *zero, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("all_spans", F.lit("")).alias("spans"), "sha256")


def findings_per_document(docs: DataFrame, rules=RULES) -> DataFrame:
    """The findings of each document's blob as counts and span lists."""
    rows, findings, _ = scan(docs, rules=rules)
    return with_digests(rows, findings, rules)
