"""Secret scanning over an incremental ledger of content-addressed blobs, with DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content.  The ledger, a Parquet table that is appended
to, says which blob was scanned with which version of which rule, by which update, and what was found.  An update scans
each blob that holds an unseen pair once, for its unseen pairs only, however many paths and versions hold it; findings
are joined back to all of them.

The registered query takes two updates of one ledger: first the documents of the lower half of ids with the base rules,
then all documents with the base and the added rules.  The second scans what the first has scanned for the added rules
only, and all other blobs for all rules.

A rule is a regular expression with the least length of one of its groups.  Matches are taken leftmost and without
overlap; those whose group is too short are dropped after matching.  Places are code points, ends exclusive: the pieces
between the matches (``split``) and the matches themselves (``regexp_extract_all``) have the lengths that give them.

Edge cases: null content is an empty blob; empty content has no findings; repeated rows and repeated or null paths are
kept, each with the findings of its content; an empty table gives an empty result; other columns are ignored, whatever
their names; long texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkpi.llm.shared import cut, fold, scratch, ship, table, unfold, write


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters; a change needs a new ``version``."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which findings that begin at the same place are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Kinds beside the base ones; their findings are listed in ``spans`` too.
ADDED = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
#: Says quickly that a text has no finding; a rule without an entry is tried on every text.
HINTS = {"access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "jwt": r"eyJ[A-Za-z0-9_-]+\.", "pem": r"-----BEGIN ", "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""}

_FOUND = "array<struct<start:int,kind:int,stop:int,rule:string>>"


def rule_findings(content: str, rule: Rule, order: int) -> Column:
    """The findings of one rule in a text column, by place."""
    escaped = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    spans = f"""
        aggregate(
            arrays_zip(regexp_extract_all({content}, '{escaped}', 0) AS m, regexp_extract_all({content}, '{escaped}', {rule.group}) AS g, slice(split({content}, '{escaped}', -1), 1, size(regexp_extract_all({content}, '{escaped}', 0))) AS p),
            struct(0 AS at, cast(array() AS {_FOUND}) AS found),
            (s, x) -> struct(
                s.at + length(x.p) + length(x.m) AS at,
                if(length(x.g) >= {rule.least},
                   concat(s.found, array(named_struct('start', s.at + length(x.p), 'kind', {order}, 'stop', s.at + length(x.p) + length(x.m), 'rule', '{rule.key}'))),
                   s.found) AS found),
            s -> s.found)"""
    spans = spans.replace(" AS m,", ",").replace(" AS g,", ",").replace(" AS p)", ")").replace("x.m", "x['0']").replace("x.g", "x['1']").replace("x.p", "x['2']")
    hint = HINTS.get(rule.kind)
    nothing = F.expr(f"cast(array() AS {_FOUND})")
    return F.when(F.col(content).rlike(hint), F.expr(spans)).otherwise(nothing) if hint else F.expr(spans)


def blob_id(content: Column | str) -> Column:
    """The content address: SHA-256 of the UTF-8 text, null as empty."""
    return F.sha2(F.coalesce(content, F.lit("")), 256)


class BlobLedger:
    """The ledger table under ``path`` (created by the first update)."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path, rules
        ship(spark)

    def _exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def entries(self) -> DataFrame:
        """blob, number (of the update), scanned (rule keys), found: a row for each update that scanned the blob."""
        return self.spark.read.schema(f"blob string, number int, scanned array<string>, found {_FOUND}").parquet(self.path)

    def update(self, versions: DataFrame, content: str = "content", number: int | None = None) -> None:
        """Scan what has not been scanned: each unseen blob and rule-version pair of ``versions`` once.

        Updates are numbered on from the last that scanned anything, if ``number`` is not given.
        """
        blobs = versions.select(blob_id(F.col(content)).alias("blob"), F.coalesce(content, F.lit("")).alias("_text")).dropDuplicates(["blob"])
        keys = F.array(*[F.lit(r.key) for r in self.rules])
        if self._exists():
            number = number or (self.entries().agg(F.max("number")).first()[0] or 0) + 1
            seen = self.entries().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("_seen"))  # one entry per rule version
            blobs = blobs.join(seen.withColumnRenamed("blob", "_blob"), F.col("blob") == F.col("_blob"), "left").withColumn("due", F.array_except(keys, F.coalesce("_seen", F.array().cast("array<string>")))).where(F.size("due") > 0)
            found = [F.when(F.array_contains("due", r.key), rule_findings("_text", r, i)).otherwise(F.expr(f"cast(array() AS {_FOUND})")) for i, r in enumerate(self.rules)]
        else:
            blobs = blobs.withColumn("due", keys)
            found = [rule_findings("_text", r, i) for i, r in enumerate(self.rules)]
        write(blobs.select("blob", F.lit(number or 1).alias("number"), F.col("due").alias("scanned"), F.concat(*found).alias("found")), self.path, "append")

    def findings(self) -> DataFrame:
        """blob and the findings of the current rules in it, by place, then rule; only blobs that have any."""
        now = [r.key for r in self.rules]
        rows = self.entries().where(F.size("found") > 0)
        rows = rows.groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))  # one entry per rule version
        rows = rows.select("blob", F.array_sort(F.filter("found", lambda x: x["rule"].isin(now))).alias("found"))
        return rows.where(F.size("found") > 0)

    def report(self, versions: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
        """``path`` and ``found`` (never null) of every row of ``versions``."""
        here = versions.select(F.col(path).alias("path"), blob_id(F.col(content)).alias("_blob"))
        found = self.findings().select(F.col("blob").alias("_found_blob"), F.col("found").alias("_found"))
        out = here.join(found, F.col("_blob") == F.col("_found_blob"), "left")
        return out.select("path", F.coalesce("_found", F.expr(f"cast(array() AS {_FOUND})")).alias("found"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and ``found`` of every document, through a ledger of its own in the shared folder."""
    spark = docs.sparkSession
    ledger = BlobLedger(spark, scratch(spark, "ledger"), rules)
    ledger.update(docs, "text")
    return ledger.report(docs, "doc_id", "text").withColumnRenamed("path", "doc_id")


def scan_twice(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``found``, ``first_update`` (which scanned the content first) and ``scanned_last`` (the number of rules
    that the second update scanned it for), from two deliveries to one ledger: see above."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "ledger")
    half = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
    BlobLedger(spark, path).update(docs.where(F.col("doc_id") * 2 <= half), "text", 1)
    ledger = BlobLedger(spark, path, (*RULES, *ADDED))
    ledger.update(docs, "text", 2)
    entries = ledger.entries().groupBy(F.col("blob").alias("_b")).agg(F.min("number").alias("first_update"), F.max(F.when(F.col("number") == 2, F.size("scanned"))).alias("scanned_last"), F.flatten(F.collect_list("found")).alias("_found"))  # an entry per update
    entries = cut(entries, "entries")  # a table of its own, so that the join can split a blob that many documents hold
    rows = docs.select(F.col("doc_id"), blob_id("text").alias("_blob")).join(entries, F.col("_blob") == F.col("_b"))
    return rows.select("doc_id", F.array_sort("_found").alias("found"), "first_update", "scanned_last")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the secrets in every document, and what the second update had to scan."""
    found = scan_twice(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(r.kind) for r in (*RULES, *ADDED)])
    listed = lambda x: F.concat_ws(",", F.transform(x, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"].cast("string"), x["stop"].cast("string"))))
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = {i})) AS long) AS n_{r.kind}") for i, r in enumerate(RULES)]
    base = F.filter("found", lambda x: x["kind"] < len(RULES))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "first_update", "scanned_last")


def redact(docs: DataFrame, marker: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``marker`` (overlapping ones by one); all columns kept."""
    spark = docs.sparkSession
    ledger = BlobLedger(spark, scratch(spark, "ledger"), (*RULES, *ADDED))
    ledger.update(docs, "text")
    found = cut(ledger.findings().select(F.col("blob").alias("_blob"), F.col("found").alias("_found")), "findings")  # so that the join can split a hot blob
    clean = f"""if(_found IS NULL, text, aggregate(_found, struct(0 AS at, '' AS kept),
        (s, x) -> if(x.start < s.at, struct(greatest(s.at, x.stop) AS at, s.kept AS kept),
                     struct(x.stop AS at, s.kept || substring(text, s.at + 1, x.start - s.at) || '{marker}' AS kept)),
        s -> s.kept || substring(text, s.at + 1)))"""
    rows = fold(docs)
    rows = rows.join(found, blob_id("text") == F.col("_blob"), "left")
    return rows.select(*unfold(rows, docs.columns, F.expr(clean)))


def _oracle() -> str:
    """The same in DuckDB, scanning every document on its own."""
    parts, rules = [], (*RULES, *ADDED)
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
    SELECT doc_id, t, {i} AS kind, '{r.kind}' AS name, unnest(range(1, len(m) + 1)) AS i, m, g, p
    FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS g, regexp_split_to_array(t, '{p}') AS p FROM d)
    WHERE len(m) > 0""")
    lengths = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(rules))
    base = len(RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(parts)}),
b AS (SELECT doc_id, kind, name, length(g[i]) AS n, length(m[i]) AS size,
             length(array_to_string(p[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS start FROM a),
c AS (SELECT *, start + size AS stop FROM b WHERE n >= CASE kind {lengths} END),
e AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans,
             string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < {base}) AS base FROM c GROUP BY doc_id),
f AS (SELECT DISTINCT t FROM d WHERE doc_id * 2 <= (SELECT max(doc_id) FROM d))
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       CASE WHEN f.t IS NULL THEN 2 ELSE 1 END AS first_update, CASE WHEN f.t IS NULL THEN {len(rules)} ELSE {len(ADDED)} END AS scanned_last
FROM d LEFT JOIN e USING (doc_id) LEFT JOIN f ON f.t = d.t"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_secrets": op5_secrets}
ORACLES: dict[str, str] = {"op5_secrets": _oracle()}
