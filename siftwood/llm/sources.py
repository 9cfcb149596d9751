"""Where the operators' tables and public vocabulary files are."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession

from ..sources import corpus

#: Bytes of a table below which it is dealt out over all cores, as it may be one row group.
SMALL = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return corpus.spread(corpus.table(spark, sf_dir, name), most=SMALL)


def tokenizer_path(name: str = "word_bpe_49k.json", folder: str | None = None) -> str:
    """A vocabulary file: in ``folder``, or in the installed package of public tokenizers, or in /opt/tokenizers."""
    if folder is None and importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder or "/opt/tokenizers", name)
