"""Queries of the training-data operators, for __spark_entry__."""

from __future__ import annotations

from pairwell.llm import fingerprints, gif, language, packing, periods, phrases, pieces, quality, secrets, sharding, simhash, token_files, warc

QUERIES = {
    "op1_pigeonring_simhash": simhash.op1_pigeonring_simhash,
    "op2_salvage_reader": warc.op2_salvage_reader,
    "op3_weak_labels": quality.op3_weak_labels,
    "op4_gif_frames": gif.op4_gif_frames,
    "op5_simple8b_files": token_files.op5_simple8b_files,
    "op6_ftrl_language": language.op6_ftrl_language,
    "op7_merge_dropout": pieces.op7_merge_dropout,
    "op8_power_of_two": packing.op8_power_of_two,
    "op9_virtual_slots": sharding.op9_virtual_slots,
    "op10_canonical_digest": fingerprints.op10_canonical_digest,
    "op11_decoding_worklist": secrets.op11_decoding_worklist,
    "op12_count_tries": phrases.op12_count_tries,
    "op13_main_lorentz": periods.op13_main_lorentz,
}

#: The others have no SQL form: they need hashes, codecs, decoders, recursion over words or tokenizers that DuckDB lacks.
ORACLES: dict[str, str] = {"op12_count_tries": phrases.OP12_SQL}
