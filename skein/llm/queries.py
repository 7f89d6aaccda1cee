"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import context_tree, decontamination, html_text, interaction, media, minhash, packing, repeats, secrets, sharding, sort_means, toxicity, warc


def queries() -> dict:
    return {
        "op1_media": media.op1_media,
        "op2_secrets": secrets.op2_secrets,
        "op3_minhash": minhash.op3_minhash,
        "op4_sharding": sharding.op4_sharding,
        "op5_context_tree": context_tree.op5_context_tree,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_html": html_text.op8_html,
        "op9_packing": packing.op9_packing,
        "op10_suffix": repeats.op10_suffix,
        "op11_warc": warc.op11_warc,
        "op12_interaction": interaction.op12_interaction,
        "op13_sort_means": sort_means.op13_sort_means,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": sharding.OP4_SQL, "op11_warc": warc.OP11_SQL, "op12_interaction": interaction.OP12_SQL, "op13_sort_means": sort_means.sql()}
