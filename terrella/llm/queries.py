"""The corpus queries and their oracle SQL, by name."""

from __future__ import annotations

from . import ann, decontamination, jaccard, licenses, mixing, secrets, sharding, toxicity, urlfilter, warc

QUERIES = {
    "op1_hilbert_sharding": sharding.query,
    "op2_prefix_decontamination": decontamination.query,
    "op3_permutation_index": ann.query,
    "op4_water_filling": mixing.query,
    "op6_secret_forest": secrets.query,
    "op8_link_graph_url_filter": urlfilter.query,
    "op5_license_signatures": licenses.query,
    "op7_seekable_warc": warc.query,
    "op9_noisy_channel_toxicity": toxicity.query,
    "op10_grouped_prefix_join": jaccard.query,
}
ORACLES = {
    "op2_prefix_decontamination": decontamination.ORACLE,
    "op4_water_filling": mixing.ORACLE,
    "op7_seekable_warc": warc.ORACLE,
    "op10_grouped_prefix_join": jaccard.ORACLE,
}
