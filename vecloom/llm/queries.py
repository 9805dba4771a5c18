"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from vecloom.llm import embedding_dedup, filter_audit, lexical_search, ngram_join, secret_scan, url_filter
from vecloom.llm.best_fit import op11_best_fit_packing
from vecloom.llm.bpe import op1_bpe
from vecloom.llm.media import op10_media_columns
from vecloom.llm.packing import op5_packing
from vecloom.llm.quality import op3_quality
from vecloom.llm.token_count import op7_token_counts
from vecloom.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_secret_scans": secret_scan.op2_secret_scans,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_ngram_jaccard": ngram_join.op6_ngram_jaccard,
    "op7_token_counts": op7_token_counts,
    "op8_url_filters": url_filter.op8_url_filters,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_media_columns": op10_media_columns,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLE_SQL = {
    "op2_secret_scans": secret_scan.ORACLE_SQL,
    "op6_ngram_jaccard": ngram_join.ORACLE_SQL,
    "op8_url_filters": url_filter.ORACLE_SQL,
    "op9_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_lexical_search": lexical_search.ORACLE_SQL,
}
