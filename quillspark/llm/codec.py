"""Whole-table encoding and decoding with the streaming transducer of ``bpe``."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe


def _encode(path: str):
    def run(batches):
        table = bpe.load(path)
        for batch in batches:
            ids = [b"".join(bpe.encode(table, text)) for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: ids of every whole text as little-endian u32, as the
    tokenizers library gives them without added special tokens, truncation or
    padding.  Null texts count as empty and give no ids; repeated rows give
    repeated rows; a null id stays null; other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(tokenizer), "id long, ids binary").withColumnRenamed("id", id_col)


def _decode(path: str, step: int = 4 << 12):
    def run(batches):
        table = bpe.load(path)
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                machine, ids = bpe.Decoder(table), ids or b""
                parts = [machine.feed(ids[at : at + step]) for at in range(0, len(ids), step)]
                texts.append("".join(parts) + machine.finish())
            at = batch.schema.names.index("ids")
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return run


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Replace the column ``ids`` by ``text``, keeping all others.  Null ids
    give an empty text; special tokens are kept."""
    schema = ", ".join(f"`{'text' if c == 'ids' else c}` {'string' if c == 'ids' else t}" for c, t in rows.dtypes)
    return rows.mapInArrow(_decode(tokenizer), schema)
