"""The queries of this package and their check SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, collocations, decontaminate, langid, line_dedup, media, near_dup, pages, periodic, ppm, quality, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_zstd": warc.query,
    "op2_webp_media": media.query,
    "op3_decontaminate": decontaminate.query,
    "op4_chat_format": chat.query,
    "op5_bpe": bpe.query,
    "op6_dart_minhash": near_dup.query,
    "op7_ppm_score": ppm.query,
    "op8_language_id": langid.query,
    "op9_quality": quality.query,
    "op10_line_dedup": line_dedup.query,
    "op11_periodic_runs": periodic.query,
    "op12_main_text": pages.query,
    "op13_collocations": collocations.query,
}
CHECKS: dict[str, str] = {
    "op1_warc_zstd": warc.ORACLE,
    "op4_chat_format": chat.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
