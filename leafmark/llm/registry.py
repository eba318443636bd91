"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from leafmark.llm import decontam, langid, licenses, linededup, packing, quality, secrets, simhash, suffixes, wavelet


def queries() -> dict:
    return {
        "op1_quality_divergence": quality.query,
        "op2_license_scan": licenses.query,
        "op3_wavelet_tokens": wavelet.query,
        "op4_suffix_repeats": suffixes.query,
        "op5_line_dedup": linededup.query,
        "op6_language_crf": langid.query,
        "op7_pack_best_fit": packing.query,
        "op8_secret_crf": secrets.query,
        "op9_simhash_gray": simhash.query,
        "op10_lsi_decontamination": decontam.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": linededup.SQL}
