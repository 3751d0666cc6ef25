"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import OP7_SQL, op7_benchmark_decontamination
from .embedding_dedup import OP12_SQL, op12_embedding_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .language_id import op6_language_id
from .language_model import op5_class_ngrams
from .line_dedup import op1_line_dedup
from .ngram_join import OP4_SQL, op4_ngram_join
from .packing import op9_packing
from .repetition import OP2_SQL, op2_repetition_coverage
from .sharding import op10_sharding
from .toxicity import op8_toxicity
from .url_filter import OP3_SQL, op3_url_filter
from .vector_codes import OP13_SQL, op13_vector_codes


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_repetition_coverage": op2_repetition_coverage,
        "op3_url_filter": op3_url_filter,
        "op4_ngram_join": op4_ngram_join,
        "op5_class_ngrams": op5_class_ngrams,
        "op6_language_id": op6_language_id,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_toxicity": op8_toxicity,
        "op9_packing": op9_packing,
        "op10_sharding": op10_sharding,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_embedding_dedup": op12_embedding_dedup,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_repetition_coverage": OP2_SQL, "op3_url_filter": OP3_SQL, "op4_ngram_join": OP4_SQL, "op7_benchmark_decontamination": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op12_embedding_dedup": OP12_SQL, "op13_vector_codes": OP13_SQL}
