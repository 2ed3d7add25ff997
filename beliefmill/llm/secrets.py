"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its content. The ledger holds the (blob, rule
version) pairs that were scanned before; only pairs that it lacks are scanned, each blob once however
many paths carry it, and findings are joined back to all paths.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose group `group` has fewer than `least` characters are dropped."""

    kind: str
    version: str
    pattern: str
    group: int
    least: int
    base: bool = True


#: In the order in which kinds are listed.
RULES = (
    Rule("assign", "1", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "1", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "1", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", "1", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, base=False),
)


def rule_versions(rules) -> Column:
    """An array of the rules' (kind, version)."""
    return F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))


def matches(text: Column, rule: Rule) -> Column:
    """struct(kind, version, gaps, lengths, values): code points before each match, of it, and of its tested group."""
    pattern = F.lit(rule.pattern)
    size = lambda x: F.length(x)
    return F.struct(
        F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"),
        F.transform(F.split(text, rule.pattern, -1), size).alias("gaps"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), size).alias("lengths"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), size).alias("values"),
    )


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Findings (blob, kind, version, start, end) of blobs (blob, text, todo); todo lists the kinds to scan.

    Matches are leftmost and do not overlap within a kind; offsets count code points, end exclusive. A
    position is the running sum of the pieces between matches and of the matches before it.
    """
    wanted = [F.when(F.array_contains("todo", r.kind) & F.col("text").rlike(r.pattern), matches(F.col("text"), r)) for r in rules]
    found = blobs.select("blob", F.explode(F.filter(F.array(*wanted), lambda x: x.isNotNull())).alias("m")).select("blob", "m.*")
    found = found.dropDuplicates(["blob", "kind"])  # rows that repeat id and text carry one blob
    each = found.select("blob", "kind", "version", F.posexplode(F.arrays_zip("gaps", "lengths", "values")).alias("pos", "x"))
    order = Window.partitionBy("blob", "kind").orderBy("pos")
    end = F.sum(F.col("x.gaps") + F.coalesce("x.lengths", F.lit(0))).over(order)
    each = each.withColumn("end", end).where("x.lengths is not null")
    least = F.element_at(F.create_map(*[v for r in rules for v in (F.lit(r.kind), F.lit(r.least))]), F.col("kind"))
    each = each.where(F.col("x.values") >= least)
    return each.select("blob", "kind", "version", (F.col("end") - F.col("x.lengths")).alias("start"), "end")


def scan_unseen(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, pairs, findings): every path with its blob, and what this scan adds to ledger and findings; see scan_versions."""
    text = F.coalesce(versions[text_col], F.lit(""))
    texts = versions.select(versions[id_col].alias("path"), text.alias("text"))
    paths = staged(texts.select("path", F.sha2("text", 256).alias("blob")), "secret-paths")
    known = paths.groupBy("blob").agg(F.min("path").alias("first_path"))
    pairs = known.select("blob", "first_path", F.inline(rule_versions(rules)))
    if ledger is not None:
        pairs = pairs.join(ledger, ["blob", "kind", "version"], "left_anti")
    todo = staged(pairs.groupBy("blob", "first_path").agg(F.collect_set("kind").alias("todo")), "secret-todo")
    one = texts.withColumn("content", F.sha2("text", 256))
    blobs = todo.join(one, todo["first_path"].eqNullSafe(one["path"]) & (todo["blob"] == one["content"]))
    new = staged(scan(blobs.select("blob", "todo", "text"), rules).distinct(), "secret-findings")
    added = todo.select("blob", "todo", F.inline(rule_versions(rules))).where(F.array_contains("todo", F.col("kind"))).select("blob", "kind", "version")
    return paths, added, new


def scan_versions(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES,
                  ledger: DataFrame | None = None, findings: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, ledger, findings) after scanning `versions`; pass ledger and findings of earlier runs to scan only what is new.

    paths (path, blob): every row, null text as the empty text. ledger (blob, kind, version) and
    findings (blob, kind, version, start, end) hold the earlier rows and the new ones. Repeated rows and
    equal texts share a blob; an id that repeats with another text is another path of another blob; null
    ids are kept as paths (their blobs are scanned too). A rule with a new version is scanned again in all
    blobs. Texts are scanned whole, however long. Empty tables give empty tables; extra columns are ignored.
    """
    paths, added, new = scan_unseen(versions, id_col, text_col, rules, ledger)
    return (paths, added if ledger is None else ledger.select("blob", "kind", "version").union(added),
            new if findings is None else findings.select("blob", "kind", "version", "start", "end").union(new))


LEDGER = "blob string, kind string, version string"
FINDINGS = "blob string, kind string, version string, start bigint, end bigint"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_ledger(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(ledger, findings) of all runs that ended in the folder; both are empty where there is none."""
    at, store = _folder(spark, f"{folder}/run=*")
    there = len(store.globStatus(at) or ()) > 0
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/run=*/{name}") if there else spark.createDataFrame([], schema)
    return read("ledger", LEDGER), read("findings", FINDINGS)


def scan_into(folder: str, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, ledger, findings) as scan_versions gives them, with ledger and findings kept in a folder over runs.

    Only pairs of a blob and a rule version that no earlier run has scanned are scanned. What a run adds is
    written aside, both tables in one directory, and appears by one rename when both are whole; so a run that
    is lost leaves nothing, and the next one scans its pairs. Two runs at a time may scan a pair twice: their
    findings are equal, and spans_by_path counts them once.
    """
    spark = versions.sparkSession
    paths, added, new = scan_unseen(versions, id_col, text_col, rules, read_ledger(spark, folder)[0])
    run = uuid.uuid4().hex
    beside, store = _folder(spark, f"{folder}/.writing-{run}")
    whole, _ = _folder(spark, f"{folder}/run={run}")
    try:
        added.write.parquet(f"{folder}/.writing-{run}/ledger")
        new.write.parquet(f"{folder}/.writing-{run}/findings")
        if not store.rename(beside, whole):
            raise OSError(f"the scan can't be moved to {folder}/run={run}")
    finally:
        store.delete(beside, True)
    return paths, *read_ledger(spark, folder)


def spans_by_path(paths: DataFrame, findings: DataFrame, rules=RULES) -> DataFrame:
    """One row a path: doc_id, a count for each base kind, the digest of base spans, and all spans.

    Findings of other rule versions than those of `rules`, which a ledger may hold from earlier runs, don't count.
    """
    base = [r.kind for r in rules if r.base]
    order = F.element_at(F.create_map(*[v for i, r in enumerate(rules) for v in (F.lit(r.kind), F.lit(i))]), F.col("kind"))
    row = F.struct(F.col("start"), order.alias("order"), F.col("kind"), F.col("end"))
    current = findings.where(F.array_contains(rule_versions(rules), F.struct("kind", "version")))
    by_blob = current.groupBy("blob").agg(F.array_sort(F.collect_set(row)).alias("found"))
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    found = F.coalesce("found", F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>"))
    based = F.filter(found, lambda x: x["kind"].isin(base))
    of = lambda k: F.filter(found, lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return paths.join(by_blob, "blob", "left").select(
        F.col("path").alias("doc_id"), *counts,
        F.sha2(F.array_join(F.transform(based, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(found, text), ",").alias("spans"))
