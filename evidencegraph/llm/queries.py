"""The queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op6_bpe
from .decontaminate import SQL as TEST_SQL
from .decontaminate import op10_decontaminate
from .editprint import op5_editprint
from .linededup import SQL as LINE_SQL
from .linededup import op7_line_dedup
from .pii import op2_pii
from .simhash import op9_simhash
from .suffixdedup import op1_suffix_dedup
from .toxicity import op3_toxicity
from .urlfilter import SQL as URL_SQL
from .urlfilter import op4_urlfilter
from .wavelet import op8_wavelet


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_pii": op2_pii,
        "op3_toxicity": op3_toxicity,
        "op4_urlfilter": op4_urlfilter,
        "op5_editprint": op5_editprint,
        "op6_bpe": op6_bpe,
        "op7_line_dedup": op7_line_dedup,
        "op8_wavelet": op8_wavelet,
        "op9_simhash": op9_simhash,
        "op10_decontaminate": op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_urlfilter": URL_SQL, "op7_line_dedup": LINE_SQL, "op10_decontaminate": TEST_SQL}
