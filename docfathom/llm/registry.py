"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_bpe
from .compact_windows import op3_compact_windows
from .divergence import op12_divergence
from .license_scan import op11_license_scan
from .ngram_join import op4_ngram_join
from .oracles import OP4, OP6, OP11, OP12, OP13
from .packing import op1_pack
from .periodic_runs import op13_periodic_runs
from .personal_data import op9_personal_data
from .quality_knn import op7_quality_knn
from .quality_rules import op10_quality_rules
from .suffix_dedup import op6_suffix_dedup
from .toxicity import op8_toxicity
from .vector_search import op5_ann

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_pack": op1_pack,
        "op2_bpe": op2_bpe,
        "op3_compact_windows": op3_compact_windows,
        "op4_ngram_join": op4_ngram_join,
        "op5_ann": op5_ann,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_quality_knn": op7_quality_knn,
        "op8_toxicity": op8_toxicity,
        "op9_personal_data": op9_personal_data,
        "op10_quality_rules": op10_quality_rules,
        "op11_license_scan": op11_license_scan,
        "op12_divergence": op12_divergence,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_join": OP4, "op6_suffix_dedup": OP6, "op11_license_scan": OP11, "op12_divergence": OP12, "op13_periodic_runs": OP13}
