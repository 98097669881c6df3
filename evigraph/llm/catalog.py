"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from evigraph.llm import hmm, langid, mixing, packing, pii, quality, repetition, simhash, sketches, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": langid.query,
    "op2_simhash": simhash.query,
    "op3_hmm": hmm.query,
    "op4_warc": warc.query,
    "op5_mix": mixing.query,
    "op6_pack": packing.query,
    "op7_quality": quality.query,
    "op8_pii": pii.query,
    "op9_sketch": sketches.query,
    "op10_repetition": repetition.query,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {"op4_warc": warc.SQL, "op5_mix": mixing.SQL}
