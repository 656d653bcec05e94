"""The subpackage's queries by name, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.anchors import op11_anchors, op11_sql
from tallyloom.llm.ann import op7_ann
from tallyloom.llm.decontaminate import op1_decontaminate
from tallyloom.llm.licenses import op4_licenses, op4_sql
from tallyloom.llm.merkle import op13_merkle, op13_sql
from tallyloom.llm.mixing import op5_mixing, op5_sql
from tallyloom.llm.neardup import op9_neardup
from tallyloom.llm.quality import op8_quality
from tallyloom.llm.runs import op12_runs
from tallyloom.llm.secrets import op3_secrets
from tallyloom.llm.toxicity import op2_toxicity
from tallyloom.llm.urlfilter import op6_sql, op6_urlfilter
from tallyloom.llm.warc import op10_sql, op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_secrets": op3_secrets,
    "op4_licenses": op4_licenses,
    "op5_mixing": op5_mixing,
    "op6_urlfilter": op6_urlfilter,
    "op7_ann": op7_ann,
    "op8_quality": op8_quality,
    "op9_neardup": op9_neardup,
    "op10_warc": op10_warc,
    "op11_anchors": op11_anchors,
    "op12_runs": op12_runs,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op4_licenses": op4_sql(),
    "op5_mixing": op5_sql(),
    "op6_urlfilter": op6_sql(),
    "op10_warc": op10_sql(),
    "op11_anchors": op11_sql(),
    "op13_merkle": op13_sql(),
}
