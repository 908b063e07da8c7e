"""The queries of this package and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import importance, jaccard, licenses, media, mixing, packing, pages, pii, quality, secrets, sharding, substrings, wavelet

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_sharding": sharding.op2_sharding,
    "op3_media": media.op3_media,
    "op4_substrings": substrings.op4_substrings,
    "op5_mixing": mixing.op5_mixing,
    "op6_licenses": licenses.op6_licenses,
    "op7_quality": quality.op7_quality,
    "op8_packing": packing.op8_packing,
    "op9_pii": pii.op9_pii,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_pages": pages.op11_pages,
    "op12_importance": importance.op12_importance,
    "op13_search": wavelet.op13_search,
    "quality_policies": quality.quality_policies,
}
ORACLE_SQL = {
    "op4_substrings": substrings.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_licenses": licenses.OP6_SQL,
    "op7_quality": quality.OP7_SQL,
    "op10_jaccard": jaccard.OP10_SQL,
    "op12_importance": importance.OP12_SQL,
    "op13_search": wavelet.OP13_SQL,
    "quality_policies": quality.QUALITY_POLICIES_SQL,
}
