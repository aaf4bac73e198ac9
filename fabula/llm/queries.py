"""Queries of the ten operators and the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from . import op1_toxicity, op2_topk, op3_media, op4_warc, op5_html, op6_bpe, op7_packing, op8_substring, op9_licenses, op10_icws


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity.query,
        "op2_topk": op2_topk.query,
        "op3_media": op3_media.query,
        "op4_warc": op4_warc.query,
        "op5_html": op5_html.query,
        "op6_bpe": op6_bpe.query,
        "op7_packing": op7_packing.query,
        "op8_substring": op8_substring.query,
        "op9_licenses": op9_licenses.query,
        "op10_icws": op10_icws.query,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": op2_topk.ORACLE, "op4_warc": op4_warc.ORACLE, "op9_licenses": op9_licenses.oracle()}
