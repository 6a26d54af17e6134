"""The registered queries of this folder, and their SQL where there is one."""

from __future__ import annotations

from sightline.llm.best_fit import op11_best_fit_packing
from sightline.llm.decontamination import OP8_SQL, op8_decontamination
from sightline.llm.fingerprints import op10_fingerprints
from sightline.llm.jaccard_join import op7_ngram_jaccard_join
from sightline.llm.language import op2_language
from sightline.llm.license_scan import op3_license_scan
from sightline.llm.line_dedup import op5_line_dedup
from sightline.llm.lm_scoring import op9_lm_scoring
from sightline.llm.packing import op6_packing
from sightline.llm.ranked_search import OP12_SQL, op12_ranked_search
from sightline.llm.sharding import op1_sharding
from sightline.llm.spelling import op13_spelling_variants
from sightline.llm.token_counts import op4_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_language, op3_license_scan, op4_token_counts, op5_line_dedup, op6_packing, op7_ngram_jaccard_join, op8_decontamination, op9_lm_scoring, op10_fingerprints,
        op11_best_fit_packing, op12_ranked_search, op13_spelling_variants,
    )
}

ORACLE_SQL: dict[str, str] = {"op8_decontamination": OP8_SQL, "op12_ranked_search": OP12_SQL}
