"""Quality rules with host-level verdicts.

Each text is measured once.  A document fails outright by the base rule; softer signs (symbols, repeated lines, odd word
lengths) are only counted.  Failures of each rule are aggregated by host (the source), each host's rate is shrunk towards
all hosts' with a beta prior fitted to their spread by moments, and the verdict is joined back: on a host whose shrunk rate
for a rule is well above the prior's mean, a document that itself shows that rule's sign is rejected too.  Documents without
any sign always stay.
"""

from __future__ import annotations

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K
from .common import materialize, text_hash, without

#: Signs of each rule: a document that the base rule leaves shows them or not.
SIGNS = {
    "symbols": "n_words > 0 and n_symbols > 0.2 * n_words",
    "dup_lines": "n_lines > 3 and n_dup_lines > 0.5 * n_lines",
    "word_chars": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}
#: A host's verdict is bad where its shrunk rate is at least LIFT times the prior's mean.
LIFT = 1.5


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host, tx and the measures of each row, as a table in the shared folder."""
    kind = docs.schema["doc_id"].dataType
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    arrow = pa.schema([("doc_id", to_arrow_type(kind)), ("host", pa.string()), ("tx", pa.int64()), *((c, pa.int64()) for c in names)])
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("host", T.StringType()), T.StructField("tx", T.LongType()), *(T.StructField(c, T.LongType()) for c in names)])
    host = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", host.alias("host"), text_hash().alias("tx"), "text").mapInArrow(lambda it: K.quality_rows(it, arrow), schema)
    return materialize(rows, "measures")


def host_verdicts(signed: DataFrame) -> DataFrame:
    """host and bad_<rule> for each rule: shrunk rate (failures + m s) / (rows + s) of at least LIFT m.

    The prior's mean m is that of the hosts' rates; its strength s comes from their variance beyond what chance gives hosts of
    their sizes: s = m (1 - m) / (variance - mean of m (1 - m) / rows) - 1, at least 1.  Where that difference is not positive
    the prior is m itself, and no host stands out.  So few rows, or differences by chance, condemn nobody.
    """
    counts = signed.groupBy("host").agg(F.count("*").alias("rows"), *(F.sum(F.col(f"sign_{r}").cast("long")).alias(f"f_{r}") for r in SIGNS))
    rates = {r: F.col(f"f_{r}") / F.col("rows") for r in SIGNS}
    prior = counts.agg(F.avg(1 / F.col("rows")).alias("chance"), *(F.avg(x).alias(f"m_{r}") for r, x in rates.items()), *(F.avg(x * x).alias(f"q_{r}") for r, x in rates.items()))
    both = counts.crossJoin(F.broadcast(prior))  # the prior is one row

    def bad(r):
        m = F.col(f"m_{r}")
        spread = m * (1 - m)
        v = F.col(f"q_{r}") - m * m - spread * F.col("chance")
        s = F.greatest(F.lit(1.0), spread / v - 1)
        return F.when(v > 0, (F.col(f"f_{r}") + m * s) / (F.col("rows") + s) >= LIFT * m).otherwise(False).alias(f"bad_{r}")

    return both.select("host", *(bad(r) for r in SIGNS))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, tx, the measures, base_failed and kept of each row of docs (doc_id, text, and source as the host).

    base_failed: fewer than 20 words, or over 30 % of the words inside 8-word windows that repeat.  Null texts have no words.
    Null hosts form one host.  Repeated rows are rows of their own; an empty table gives none; other columns are not read.
    """
    m = measures(docs).withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    signed = m.select("*", *(F.expr(e).alias(f"sign_{r}") for r, e in SIGNS.items()))
    hosts = host_verdicts(signed).withColumnRenamed("host", "__host")
    joined = signed.join(hosts, signed["host"].eqNullSafe(hosts["__host"]), "left")
    worse = F.lit(False)
    for r in SIGNS:
        worse = worse | (F.col(f"sign_{r}") & F.coalesce(f"bad_{r}", F.lit(False)))
    return joined.select("doc_id", "tx", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~(F.col("base_failed") | worse)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, columns unchanged, that quality_verdicts keeps."""
    return without(docs, quality_verdicts(docs).where("not kept").select(F.col("doc_id").alias("id"), "tx"))
