"""Token counts of whole texts by the compiled transducer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import transducer
from millrace.llm.shared import small_batches


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    vocabulary is the path of a tokenizers .json file, compiled on the driver and
    broadcast (a few MB, whatever the data). Null and empty texts have 0 bytes and 0 tokens; ids
    may be null or repeated; other columns are not read; an empty table gives no rows. Rows are
    handled alone, so no row can hold up others and nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(transducer.read(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer.compiled(*source.value)
        for batch in batches:
            text = batch.column("text")
            tokens = pa.array(machine.counts(text))
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
