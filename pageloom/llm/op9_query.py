"""op9_token_files: all documents encoded, written as token files and read back. Tokenizing has no SQL form."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pageloom.llm.common import shared_dir, table
from pageloom.llm.op7_query import END_ID, TOKENIZER
from pageloom.llm.token_files import read_token_files, write_token_files


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/pageloom/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), END_ID)
    return read_token_files(spark, path)


QUERIES = {"op9_token_files": op9_token_files}
ORACLES: dict[str, str] = {}
