"""Secret scans with multipart credential linking.

Strong patterns are reported as such.  Weak parts (identifiers, short or opaque secrets, endpoints) are reported only when
a complementary part (identifier and secret, or secret and endpoint) lies within 200 code points in the same paragraph:
an interval join of the parts of a text, by binary search over their sorted starts.  A text is the largest scope, so no
row leaves its task and nothing is shuffled.
"""

from __future__ import annotations

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans of each row of docs (doc_id, text), spans sorted by start, then assign, access, hex, id, key, endpoint.

    Positions are code points, ends exclusive.  Null and empty texts have no spans; repeated rows and null ids give rows of
    their own; an empty table gives none; other columns are not read, so any names may stand beside.
    """
    kind = docs.schema["doc_id"].dataType
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    arrow = pa.schema([("doc_id", to_arrow_type(kind)), ("spans", span)])
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("spans", T._parse_datatype_string(SPANS))])
    return docs.select("doc_id", "text").mapInArrow(lambda it: K.secret_rows(it, arrow), schema)


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by mask, overlapping spans as one; null texts stay null."""
    return docs.mapInArrow(lambda it: K.redact_rows(it, mask), docs.schema)
