"""Secret scans over an incremental blob ledger.

A version's text is addressed by its SHA-256. The ledger keeps, as Parquet under a shared folder, which blobs were scanned
under which version of the rules and what was found; a scan reads only pairs of blob and rule version not in it, and
findings are joined back to every path (document) that holds the blob.

Null texts are the empty blob, which is scanned once like any other. Repeated rows and copies are paths of one blob and
get the same findings. Extra columns are left out. Each run writes a folder of a fresh name; a ledger takes over what earlier
sessions left in its folder, but no part without its success mark, so a run that failed counts as not scanned.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurelens.llm.common import text_of, written

#: Kinds that are counted, in the order that breaks ties of places.
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: Further rules: name, pattern, least bits a character of the match (0: any).
EXTRA = (
    ("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0.0),
    ("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 3.0),
    ("bearer", r"\b[Bb]earer [A-Za-z0-9._~+/=-]{20,}", 3.0),
    ("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,128}@", 0.0),
    ("random", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{0,64}[0-9])(?=[A-Za-z0-9+/_-]{0,64}[A-Z])(?=[A-Za-z0-9+/_-]{0,64}[a-z])[A-Za-z0-9+/_-]{32,}", 4.2),
)
_EXTRA = [(name, re.compile(pattern), bits) for name, pattern, bits in EXTRA]
RULES = hashlib.sha256(repr((_ASSIGN.pattern, _ACCESS.pattern, _HEX.pattern, EXTRA)).encode()).hexdigest()[:16]
FINDINGS = "blob binary, spans array<struct<kind:string,first:int,last:int>>"


def bits_per_character(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind: the base kinds in their order, then the further rules."""
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for name, pattern, bits in _EXTRA:
        if name == "private_key" and "-----BEGIN" not in text or name == "web_token" and "eyJ" not in text or name == "bearer" and "earer " not in text or name == "url_login" and "://" not in text:
            continue
        spans += [(name, *m.span()) for m in pattern.finditer(text) if bits_per_character(m[0]) >= bits]
    order = {k: i for i, k in enumerate((*BASE, *(n for n, _, _ in EXTRA)))}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


class BlobLedger:
    """What was scanned under which rules, and what was found, below one folder."""

    def __init__(self, spark: SparkSession, folder: str, rules: str = RULES):
        self.spark, self.folder, self.rules, self.parts = spark, folder, rules, []
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rules={rules}")
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for run in files.listStatus(root) if files.exists(root) else []:
            if files.exists(spark._jvm.org.apache.hadoop.fs.Path(run.getPath(), "_SUCCESS")):
                self.add_part(f"{folder}/rules={rules}/{run.getPath().getName()}")

    def add_part(self, path: str) -> None:
        """Takes over a part that an earlier run wrote."""
        self.parts.append(path)

    def findings(self) -> DataFrame | None:
        """blob, spans of the current rules; None before the first scan."""
        own = [p for p in self.parts if f"/rules={self.rules}/" in p]
        return self.spark.read.schema(FINDINGS).parquet(*own) if own else None

    def scan(self, versions: DataFrame, run: str) -> int:
        """Scans the blobs of (blob, text) that the ledger lacks under these rules; returns how many."""
        fresh = versions.groupBy("blob").agg(F.first("text").alias("text"))
        known = self.findings()
        if known is not None:
            fresh = fresh.join(known.select("blob"), "blob", "left_anti")

        def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"blob": batch["blob"], "spans": [[{"kind": k, "first": a, "last": b} for k, a, b in find(t)] for t in batch["text"]]})

        path = f"{self.folder}/rules={self.rules}/run={run}-{uuid.uuid4()}"
        fresh.select("blob", "text").mapInPandas(scanned, FINDINGS).write.mode("overwrite").parquet(path)
        self.parts.append(path)
        return self.spark.read.parquet(path).count()


def scan_documents(docs: DataFrame, ledger: BlobLedger, run: str = "0", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, blob, spans of every document, after the ledger has scanned what it lacked."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.select("id", F.unhex(F.sha2("text", 256)).alias("blob"), "text")
    ledger.scan(rows.select("blob", "text"), run)
    paths = written(rows.select("id", "blob"), ledger.folder, f"paths/run={run}-{uuid.uuid4()}")
    return paths.join(ledger.findings(), "blob").select("id", "blob", "spans")


def digest(found: DataFrame) -> DataFrame:
    """The counted kinds, the digest of their spans and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(F.col("id").alias("doc_id"), *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
