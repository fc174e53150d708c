"""Registered queries of this subpackage, with DuckDB oracles where SQL can express them."""

from lumenloom.llm.bpe import op8_byte_bpe
from lumenloom.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from lumenloom.llm.fingerprint import fingerprint_near_duplicates, op9_fingerprints
from lumenloom.llm.language_id import op6_language_id
from lumenloom.llm.ngram_join import OP2_SQL, op2_ngram_join
from lumenloom.llm.packing import op3_packing
from lumenloom.llm.pii import op10_pii
from lumenloom.llm.secret_scan import op7_secret_scan
from lumenloom.llm.token_output import op1_token_frames
from lumenloom.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_token_frames": op1_token_frames,
    "op2_ngram_join": op2_ngram_join,
    "op3_packing": op3_packing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_secret_scan": op7_secret_scan,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_fingerprints": op9_fingerprints,
    "op10_pii": op10_pii,
    "fingerprint_near_duplicates": fingerprint_near_duplicates,
}

ORACLES: dict[str, str] = {
    "op2_ngram_join": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
}
