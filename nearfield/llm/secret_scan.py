"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.common import text_or_empty
from nearfield.storage import materialise

REDACTED = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a pattern; those whose `group` is shorter than min_length are dropped after matching."""

    kind: str
    pattern: str
    min_length: int
    group: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Patterns and least lengths, in the order in which kinds are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
_CHEAPER = {r"AKIA[A-Z0-9]+": r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]+": r"[0-9a-f]{32,}"}
LEDGER = "blob binary, scanned array<string>, findings array<struct<start:int,rank:int,kind:string,end:int>>"


def blob_id(text: Column) -> Column:
    """Content address: the SHA-256 of the text's UTF-8 bytes; null texts share the empty blob."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _matches(rule: Rule, rank: int, pending: Column | None) -> Column:
    """array of struct(rank, kind, pos, gap, len, keep): each match, the characters since the one before, and its length.

    A run of one character class that is matched greedily has the same long matches if the least length is put into the
    pattern; that saves an array of all short ones.
    """
    pattern, text = _CHEAPER.get(rule.pattern, rule.pattern), F.col("text")
    wanted = text.rlike(pattern)
    if pending is not None:
        wanted = F.array_contains(pending, rule.name) & wanted
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.transform(F.split(text, pattern, -1), F.length).alias("g"))
    found = F.transform(
        F.filter(zipped, lambda z: z["m"].isNotNull()),
        lambda z, i: F.struct(
            F.lit(rank).alias("rank"),
            F.lit(rule.kind).alias("kind"),
            i.alias("pos"),
            z["g"].alias("gap"),
            F.length(z["m"]).alias("len"),
            (F.length(z["m"] if not rule.group else F.regexp_extract(z["m"], rule.pattern, rule.group)) >= rule.min_length).alias("keep"),
        ),
    )
    return F.when(wanted, found).otherwise(F.array().cast("array<struct<rank:int,kind:string,pos:int,gap:int,len:int,keep:boolean>>"))


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule] = RULES, pending: str | None = None) -> DataFrame:
    """Findings of distinct blobs (blob, text[, pending rule names]): blob, findings sorted by start, then rule.

    Blobs without findings have an empty array. Positions are code points: running sums of gaps and match lengths, so a
    text with many matches costs in proportion to their number.
    """
    asked = None if pending is None else F.col(pending)
    kept = ["blob"] if pending is None else ["blob", pending]
    rows = blobs.select(*kept, F.explode_outer(F.concat(*[_matches(r, i, asked) for i, r in enumerate(rules)])).alias("m")).select(*kept, "m.*")
    upto = Window.partitionBy("blob", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto).cast("int"))
    span = F.when(F.col("keep"), F.struct((F.col("end") - F.col("len")).alias("start"), "rank", "kind", "end"))
    extra = [] if pending is None else [F.first(pending).alias(pending)]
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("findings"), *extra)


def scan_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """New ledger rows (see LEDGER) for the blobs of docs with rule versions that the ledger hasn't seen.

    Every historical version of a document is a row of docs; equal texts are one blob and are scanned once. Each new row
    names the rule versions scanned now; append it to the ledger. Texts move between machines once for each distinct blob
    and map task, so a blob that a third of all rows share costs no more than others.
    """
    names = F.array(*[F.lit(r.name) for r in rules])
    texts = docs.select(blob_id(F.col("text")).alias("blob"), text_or_empty().alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        return scan_blobs(texts, rules).select("blob", names.alias("scanned"), "findings")
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
    todo = texts.join(seen, "blob", "left").withColumn("pending", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("pending") > 0)
    return scan_blobs(todo.drop("seen"), rules, "pending").select("blob", F.col("pending").alias("scanned"), "findings")


class Ledger:
    """A ledger kept as a Parquet table under one path, from run to run and over all historical versions of documents."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame | None:
        """What was scanned so far; None before the first scan."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        stored = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(LEDGER).parquet(self.path) if stored else None

    def update(self, docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
        """Scan what is new in docs, by blob and rule version, append it, and return all rows.

        A task that is run again writes its rows once; a run that failed before its end left nothing that is read.
        """
        scan_ledger(docs, self.rows(), rules).write.mode("append").parquet(self.path)
        return self.rows()


def findings_of(ledger: DataFrame) -> DataFrame:
    """blob, findings: those of all ledger rows of a blob, sorted; blobs without any are left out."""
    return ledger.filter(F.size("findings") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("findings"))


def secret_spans(docs: DataFrame, rules: Sequence[Rule] = RULES, findings: DataFrame | None = None) -> DataFrame:
    """Each row of docs with its findings: doc_id, findings (null if none), joined to every path by the blob.

    findings may come from a ledger (findings_of); without, a ledger of the blobs of docs is written to the shared folder. Null texts are empty;
    repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
    """
    if findings is None:
        findings = findings_of(materialise(scan_ledger(docs, None, rules), "ledger"))
    paths = docs.select("doc_id", blob_id(F.col("text")).alias("blob"))
    return paths.join(findings, "blob", "left").select("doc_id", "findings")


def digest_spans(spans: DataFrame, base: Sequence[str] = ("assign", "access", "hex")) -> DataFrame:
    def joined(c: Column) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = F.coalesce("findings", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>"))

    def count(kind: str) -> Column:
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *[count(k) for k in base], F.sha2(joined(F.filter(found, lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), joined(found).alias("spans"))


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with every finding in text replaced by REDACTED and n_chars counted anew; rows without findings stay as they are.

    Overlapping findings become one replacement. Columns and rows are those of docs.
    """
    found = findings_of(materialise(scan_ledger(docs, None, rules), "ledger")).select(F.col("blob").alias("_nf_blob"), F.col("findings").alias("_nf_found"))
    keyed = docs.withColumn("_nf_blob", blob_id(F.col("text"))).join(found, "_nf_blob", "left")
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.lit(REDACTED)).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], gap, mark).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    clean = F.aggregate("_nf_found", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    out = keyed.withColumn("_nf_text", F.when(F.col("_nf_found").isNull(), text).otherwise(clean))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("_nf_text").alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("_nf_found").isNull(), F.col("n_chars")).otherwise(F.length("_nf_text").cast("long")).alias("n_chars"))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)
