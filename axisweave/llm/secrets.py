"""Secret scans with an incremental ledger of blobs.

A blob is a text under its SHA-256. Every version in the history names a blob; the ledger is a table in a shared folder that holds
the findings of every (blob, rules version) pair scanned so far (a blob without secrets has a row with none). A scan takes only
the pairs that the ledger lacks, each blob once however many paths hold it, appends them, and all findings are joined back from the ledger to every path.

No text is moved: one row of each new blob is its home, a table by hash of bounded size names the homes to the tasks that read the texts, and only findings
go on. What the table names by chance is scanned in vain and dropped.

Edge cases. A null text is the empty blob. Equal rows give equal results, one a row. Null ids are kept, and ids may be of any type. Empty input gives no rows; other
columns, whatever their names, are ignored. A text of any length is scanned whole (a batch holds 12 MB of text, or one text). A blob that a third of all paths share is scanned
once; its findings reach the paths by a join of slim rows, whose hot side adaptive execution splits. Pairs that are in the ledger twice count once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisweave.functions.checkpoints import place, written
from axisweave.llm import setjoin
from axisweave.llm.common import bounded, mix64


RULES_VERSION = "2"
#: Kind, pattern, group whose length counts, least length. The first three are the base, the others the method's own.
RULES = (
    ("assign", r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)
BASE = 3
FINDINGS = "blob string, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(text: str, rules=RULES) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of one text in code points, by start, then by the rules' order."""
    found = []
    for k, (kind, pattern, group, least) in enumerate(rules):
        for m in re.finditer(pattern, text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def _found(blobs: list[str], texts: pa.Array) -> pa.RecordBatch:
    base = {r[0] for r in RULES[:BASE]}
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    rows = []
    for blob, text in zip(blobs, texts):
        spans = find(text.as_py())
        own = [x for x in spans if x[0] in base]
        n = [sum(x[0] == k for x in own) for k in ("assign", "access", "hex")]
        rows.append((blob, RULES_VERSION, *n, hashlib.sha256(join(own).encode()).hexdigest(), join(spans)))
    names = [x.split()[0] for x in FINDINGS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)


def blobs(docs: DataFrame) -> DataFrame:
    """(row, blob, text): a hash of each row, its blob and its text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def known(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The findings in the ledger, one row a pair; None where there is no ledger yet."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return None
    return spark.read.schema(FINDINGS).parquet(ledger).dropDuplicates(["blob", "rules"])


def unseen(docs: DataFrame, ledger: str) -> DataFrame:
    """(blob, row): the blobs that the ledger lacks under these rules, and the row that is each one's home."""
    homes = blobs(docs).groupBy("blob").agg(F.min("row").alias("row"))
    held = known(docs.sparkSession, ledger)
    return homes if held is None else homes.join(held.filter(F.col("rules") == RULES_VERSION).select("blob"), "blob", "left_anti")


def scan(docs: DataFrame, ledger: str) -> int:
    """Scans what the ledger (a path in a shared folder) lacks and appends the findings to it; the number of blobs scanned."""
    spark = docs.sparkSession
    homes = written(unseen(docs, ledger), "homes")
    n = homes.count()
    if not n:
        return 0
    size = min(setjoin.MOST, max(setjoin.LEAST, 1 << (8 * n).bit_length()))
    key = lambda b: mix64(b.column("row").to_numpy().view(np.uint64))
    shift = np.uint64(64 - (size.bit_length() - 1))
    with bounded(spark):
        held = spark.sparkContext.broadcast(setjoin.levels(homes.select("row"), key, size) > 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.filter(pa.array(held.value[(key(batch) >> shift).astype(np.int64)]))
                found = _found(own.column("blob").to_pylist(), own.column("text"))
                yield pa.RecordBatch.from_arrays([own.column("row"), *found.columns], ["row", *found.schema.names])

        found = blobs(docs).mapInArrow(run, f"row long, {FINDINGS}")
        found.join(homes, ["blob", "row"], "left_semi").dropDuplicates(["blob"]).drop("row").write.mode("append").parquet(ledger)
    return n


def report(docs: DataFrame, ledger: str) -> DataFrame:
    """Every path with the findings of its blob, from the ledger."""
    paths = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    found = known(docs.sparkSession, ledger)
    if found is None:  # nothing was ever scanned
        found = docs.sparkSession.createDataFrame([], FINDINGS)
    found = found.filter(F.col("rules") == RULES_VERSION)
    return paths.join(found, "blob").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")


def query(docs: DataFrame) -> DataFrame:
    """Per document, from a ledger of its own: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    ledger = place(docs.sparkSession, "ledger")
    scan(docs, ledger)
    return report(docs, ledger).drop("blob")


def _spans(kind: int) -> str:
    name, pattern, group, least = RULES[kind]
    letters = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
    p = (pattern.replace("(?ai:(?:password|passwd|secret|token|api_?key)", letters)[:-1] if kind == 0 else pattern).replace("'", "''")
    held = f"regexp_extract(x, '{p}', 2)" if kind == 0 else "x"
    return rf"""
  select rn, {kind} as kind, '{name}' as name, pos, pos + len(x) as stop from (
    select rn, x, list_sum([len(y) for y in gaps[1:i]])::bigint + coalesce(list_sum([len(y) for y in hits[1:i - 1]]), 0)::bigint as pos from (
      select rn, gaps, hits, unnest(hits) as x, generate_subscripts(hits, 1) as i from (
        select rn, string_split_regex(text, '{p}') as gaps, regexp_extract_all(text, '{p}') as hits from d))) where len({held}) >= {least}"""


#: A match begins behind the stretches between the matches before it.
SQL = f"""
with d as (select row_number() over () as rn, doc_id, coalesce(text, '') as text from documents),
s as ({" union all ".join(_spans(k) for k in range(len(RULES)))}),
j as (
  select rn, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
         string_agg(name || ':' || pos || ':' || stop, ',' order by pos, kind) filter (kind < {BASE}) as base, string_agg(name || ':' || pos || ':' || stop, ',' order by pos, kind) as spans
  from s group by rn)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join j using (rn)
"""
