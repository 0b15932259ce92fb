"""Queries of this subpackage, by name, and SQL for those that SQL can express on whole tables."""
from . import decontaminate, embed_dedup, langid, licenses, minhash, pieces, pii, ppm, resample, token_counts, token_files, urls, vector_codes
from .common import table


def _docs(fn):
    return lambda spark, sf_dir: fn(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": _docs(licenses.op1_license_scan),
    "op2_embedding_dedup": lambda spark, sf_dir: embed_dedup.op2_embedding_dedup(table(spark, sf_dir, "embeddings")),
    "op3_decontamination": lambda spark, sf_dir: decontaminate.op3_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op4_pii": _docs(pii.op4_pii),
    "op5_token_files": _docs(token_files.op5_token_files),
    "op6_lm_scoring": _docs(ppm.op6_lm_scoring),
    "op7_merge_dropout": _docs(pieces.op7_merge_dropout),
    "op8_url_filter": lambda spark, sf_dir: urls.op8_url_filter(table(spark, sf_dir, "pages")),
    "op9_language_id": _docs(langid.op9_language_id),
    "op10_minhash_dedup": _docs(minhash.op10_minhash_dedup),
    "op11_resampling": lambda spark, sf_dir: resample.op11_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op12_token_counts": _docs(token_counts.op12_token_counts),
    "op13_vector_codes": lambda spark, sf_dir: vector_codes.op13_vector_codes(table(spark, sf_dir, "embeddings")),
}
ORACLES: dict[str, str] = {"op8_url_filter": urls.oracle(), "op11_resampling": resample.oracle(), "op13_vector_codes": vector_codes.oracle()}
