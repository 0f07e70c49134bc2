"""The corpus operators' queries, by the name under which they are registered, and their SQL where it can express them."""

from . import oracle
from .decontaminate import op4_decontaminate
from .flac import op3_flac
from .html_extract import op1_html_extract
from .language_id import op7_language_id
from .line_dedup import op9_line_dedup
from .pii import op2_pii
from .simhash import op5_simhash
from .spm_codec import op10_sentencepiece
from .token_counts import op8_token_counts
from .token_files import op6_token_files

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_pii": op2_pii,
    "op3_flac": op3_flac,
    "op4_decontaminate": op4_decontaminate,
    "op5_simhash": op5_simhash,
    "op6_token_files": op6_token_files,
    "op7_language_id": op7_language_id,
    "op8_token_counts": op8_token_counts,
    "op9_line_dedup": op9_line_dedup,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLE: dict[str, str] = {
    "op4_decontaminate": oracle.DECONTAMINATE,
    "op9_line_dedup": oracle.LINE_DEDUP,
}
