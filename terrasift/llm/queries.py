"""The queries of this subpackage, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .factorisation import op9_quality_classifier
from .html_text import op7_html_extraction
from .katz import op3_katz
from .mixing import op1_mixing
from .near_dups import op8_simhash
from .packing import op4_packing
from .quality_rules import op5_quality_rules
from .sketches import op10_bottom_k
from .toxicity import op2_toxicity
from .warc import op6_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_mixing": op1_mixing,
        "op2_toxicity": op2_toxicity,
        "op3_katz": op3_katz,
        "op4_packing": op4_packing,
        "op5_quality_rules": op5_quality_rules,
        "op6_warc": op6_warc,
        "op7_html_extraction": op7_html_extraction,
        "op8_simhash": op8_simhash,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_bottom_k": op10_bottom_k,
    }


#: Five hexadecimal digits of the digest are four letters of base32.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(d, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS INT), 1)), '')"

OP6_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS d FROM p), r AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM q)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM r"""


def oracle_sql() -> dict[str, str]:
    """The others hash with functions, tokenise or learn in ways that SQL hasn't: tests/llm/ holds brute-force versions."""
    return {"op6_warc": OP6_SQL}
