"""Secret scan with an incremental blob ledger.

Every version of every file is content-addressed (SHA-256 of its text).  The ledger keeps,
for each (blob, rules version) pair that was ever scanned, what was found; a run scans only
the blobs whose pair is missing, appends them, and joins the findings back to all paths that
hold the blob.  Copies, renames and unchanged versions cost a hash, not a scan; a new rules
version scans everything once.  The version is a digest of the rules themselves, so changed rules
cannot pass for old ones.  The ledger only grows: runs append, and a run that broke off or ran
beside another one leaves rows that are right and at worst twice there, which reading evens out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstats.llm.common import filesystem, shared_dir

# Fixed values of the contract: kind, pattern (group 2 or the match has at least so many
# characters).  Matches are leftmost and do not overlap within a kind; short ones are dropped
# after matching.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_MIN = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")   # 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")
BASE_KINDS = ("assign", "access", "hex")
# Further kinds that this operator adds (key blocks and vendors' public token formats).
PEM_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
# what a key block may hold: header lines (Proc-Type, DEK-Info, ...), then base64; line ends may be escaped
PEM_BODY = re.compile(r"(?:\s|\\[nr])*(?:[A-Za-z][A-Za-z0-9-]*: [^\n\\]*(?:\s|\\[nr])+)*(?:[A-Za-z0-9+/=\s]|\\[nr])*")
MORE = (
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
)
MARKS = {"github": "gh", "slack": "xox", "jwt": "eyJ"}
KEYWORDS = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
RULES_VERSION = hashlib.sha256("\n".join(
    f"{p.flags} {p.pattern}" for p in (ASSIGN, ACCESS, HEX, PEM_BEGIN, PEM_BODY, KEYWORDS, *(p for _, p in MORE))).encode()
    + f" {ASSIGN_MIN} {MARKS}".encode()).hexdigest()[:16]
LEDGER_SCHEMA = ("blob string, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string, "
                 "findings array<struct<kind:string,start:int,end:int>>")


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the private keys in a text, of any length: from a BEGIN mark to the next END
    mark of the same label, with nothing but header lines and base64 between."""
    for m in PEM_BEGIN.finditer(text):
        end = f"-----END {m[1]}-----"
        at = text.find(end, m.end())
        if at >= 0 and PEM_BODY.fullmatch(text, m.end(), at):
            yield m.start(), at + len(end)


def find_secrets(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, order of kind, end, kind) of every span in a whole text; NULL has none."""
    text = text or ""
    found = []
    if KEYWORDS.search(text):
        found += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        found += [(start, len(BASE_KINDS), end, "pem") for start, end in key_blocks(text)]
    for order, (kind, pattern) in enumerate(MORE, len(BASE_KINDS) + 1):
        if MARKS[kind] in text:
            found += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text)]
    found.sort()
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [find_secrets(t) for t in batch.column(1).to_pylist()]
        joined = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        yield pa.RecordBatch.from_arrays([
            batch.column(0),
            *[pa.array([sum(x[3] == kind for x in f) for f in found], pa.int64()) for kind in BASE_KINDS],
            pa.array([joined(x for x in f if x[1] < len(BASE_KINDS)) for f in found], pa.string()),
            pa.array([joined(f) for f in found], pa.string()),
            pa.array([[{"kind": k, "start": s, "end": e} for s, _, e, k in f] for f in found], kinds)],
            names=["blob", "n_assign", "n_access", "n_hex", "base", "spans", "findings"])


def read_ledger(spark: SparkSession, ledger: str, version: str = RULES_VERSION) -> DataFrame:
    """What the ledger has for a rules version, a row per blob; empty before the first run."""
    store, path = filesystem(f"{ledger}/version={version}")
    there = store.get_file_info(path).type.name == "Directory"
    if not there:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(f"{ledger}/version={version}").dropDuplicates(["blob"])


def scan_versions(versions: DataFrame, ledger: str, *, text_col: str = "text", version: str = RULES_VERSION) -> DataFrame:
    """Scan the unseen blobs of ``versions`` into the ledger; return ``versions`` (without the
    text) with blob, n_assign, n_access, n_hex, base, spans and findings.

    NULL texts are the empty blob; repeated rows and paths each keep their row; an empty table
    scans nothing and gives no rows; columns of ``versions`` with those names are replaced.
    """
    spark = versions.sparkSession
    made = ["blob", "n_assign", "n_access", "n_hex", "base", "spans", "findings"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = versions.select(*[F.col(f"`{c}`") for c in versions.columns if c != text_col and c not in made],
                            F.sha2(text, 256).alias("blob"), text.alias("__text"))
    known = read_ledger(spark, ledger, version).select("blob")
    # the partial aggregation keeps one copy of a blob per map task, so a blob that a third of
    # the rows share is shuffled once per task at most
    unseen = (keyed.groupBy("blob").agg(F.first("__text").alias("text")).join(known, "blob", "left_anti"))
    unseen.mapInArrow(_scan, LEDGER_SCHEMA).write.mode("append").parquet(f"{ledger}/version={version}")
    return keyed.drop("__text").join(read_ledger(spark, ledger, version), "blob")


def secret_report(docs: DataFrame, ledger: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts per base kind, the hash of the base spans and all spans.  Without a
    ``ledger`` a new one is begun, so every text is scanned."""
    ledger = ledger or shared_dir(docs.sparkSession, "blob-ledger")
    out = scan_versions(docs.select(id_col, text_col), ledger, text_col=text_col)
    return out.select(id_col, "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
