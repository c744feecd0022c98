"""The queries of this subpackage, and SQL for those that SQL can express."""

from stormsift.llm.html_text import op4_html_text
from stormsift.llm.language_model import op3_lm_score
from stormsift.llm.license_scan import op1_license_scan
from stormsift.llm.merkle import OP11_SQL, op11_merkle_manifest
from stormsift.llm.mixing import op2_mix
from stormsift.llm.near_dup import op7_near_dup
from stormsift.llm.quality import LIMITS_SQL, OP5_SQL, op5_quality_rules, quality_limits
from stormsift.llm.secrets import OP13_SQL, op13_secret_scan
from stormsift.llm.sentence_piece import op8_sentence_piece
from stormsift.llm.topk import OP10_SQL, op10_topk
from stormsift.llm.toxicity import op6_toxicity
from stormsift.llm.url_filter import OP9_SQL, op9_url_filter
from stormsift.llm.whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_mix, op3_lm_score, op4_html_text, op5_quality_rules, op6_toxicity, op7_near_dup, op8_sentence_piece, op9_url_filter, op10_topk, op11_merkle_manifest, op12_whitening, op13_secret_scan, quality_limits)}
ORACLE_SQL = {"op5_quality_rules": OP5_SQL, "quality_limits": LIMITS_SQL, "op9_url_filter": OP9_SQL, "op10_topk": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op13_secret_scan": OP13_SQL}
