"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from acctframe.llm import audio, chosen_path, decontam, edit_counts, katz, packing, quality, suffix_dedup, token_files, warc_audit


def queries() -> dict:
    return {
        "op1_katz_backoff": katz.query,
        "op2_chosen_path_join": chosen_path.query,
        "op3_hilbert_packing": packing.query,
        "op4_token_files": token_files.query,
        "op5_ftrl_quality": quality.query,
        "op6_suffix_dedup": suffix_dedup.query,
        "op7_edit_counts": edit_counts.query,
        "op8_aho_decontamination": decontam.query,
        "op9_warc_merkle_audit": warc_audit.query,
        "op10_audio_features": audio.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_aho_decontamination": decontam.SQL, "op9_warc_merkle_audit": warc_audit.SQL}
