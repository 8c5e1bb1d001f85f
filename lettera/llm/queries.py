"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontam import OP8_SQL, op8_decontaminate
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .fill_middle import OP12_SQL, op12_fill_middle
from .html_text import op10_html_text
from .langid import op7_langid
from .license_scan import op4_license_scan
from .quality import op2_quality
from .sentence_pieces import op6_sentence_pieces
from .simhash import op1_simhash
from .suffix_dedup import op3_suffix_dedup
from .token_files import op9_token_files
from .vector_codes import OP11_SQL, op11_vector_codes
from .warc import OP13_SQL, op13_warc

QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality, op3_suffix_dedup, op4_license_scan, op5_exact_dedup, op6_sentence_pieces, op7_langid, op8_decontaminate, op9_token_files, op10_html_text, op11_vector_codes, op12_fill_middle, op13_warc)}


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

ORACLES = {"op5_exact_dedup": OP5_SQL, "op8_decontaminate": OP8_SQL, "op11_vector_codes": OP11_SQL, "op12_fill_middle": OP12_SQL, "op13_warc": OP13_SQL}
