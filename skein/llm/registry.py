"""The queries of this subpackage and, where SQL can express them, their SQL."""

from .chat import OP8_SQL, op8_chat_formatting
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .filter_audit import OP11_SQL, op11_filter_audit
from .fingerprints import op6_fingerprints
from .importance import op12_importance
from .language_id import op5_language_id
from .license_scan import op4_license_scan
from .main_text import op13_main_text
from .mixing import op1_mixing
from .ngram_join import op2_ngram_join
from .packing import op3_packing
from .surrogates import op10_pii_surrogates
from .warc_zip import OP7_SQL, op7_warc

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_ngram_join": op2_ngram_join,
    "op3_packing": op3_packing,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_fingerprints": op6_fingerprints,
    "op7_warc": op7_warc,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_filter_audit": op11_filter_audit,
    "op12_importance": op12_importance,
    "op13_main_text": op13_main_text,
}
SQL = {"op7_warc": OP7_SQL, "op8_chat_formatting": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op11_filter_audit": OP11_SQL}
