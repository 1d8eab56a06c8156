"""The queries of this folder, by name."""

from . import audio, bpe, linededup, ngramlm, pii, resampling, sharding, simhash, tiling, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        resampling.op1_importance_resampling,
        audio.op2_audio_features,
        linededup.op3_line_dedup_suffix,
        bpe.op4_bpe_tree,
        simhash.op5_simhash_covering,
        pii.op6_pii_checksums,
        ngramlm.op7_ngram_automaton,
        tiling.op8_decontamination_tiling,
        sharding.op9_rendezvous_sharding,
        toxicity.op10_toxicity_chain,
    )
}
#: Hashes, checksums of texts, trained models and window hashes have no SQL form: tests hold the other
#: queries against brute force instead.
ORACLES: dict[str, str] = {"op3_line_dedup_suffix": linededup.ORACLE}
