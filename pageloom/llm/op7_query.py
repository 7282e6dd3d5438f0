"""op7_packing: all documents packed into sequences of 4096 tokens. An online packing rule has no SQL form."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pageloom.llm.common import discard, settle, table
from pageloom.llm.packing import CAPACITY, cut, in_file_order, pack

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def pack_documents(docs: DataFrame, ordered: bool = False) -> DataFrame:
    """The packed pieces of docs(doc_id, text); ordered keeps to the order of the files that docs stand in, if they do."""
    placed = in_file_order(docs) if ordered else None
    rows = docs.select("doc_id", "text") if placed is None else placed
    pieces = settle(cut(rows, public_tokenizers.path(TOKENIZER), END_ID, CAPACITY), "pieces")
    packed = pack(pieces, CAPACITY)
    discard(pieces)  # packing has written all rounds
    return packed


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict[str, str] = {}
