"""Queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from .conversation_repair import op12_conversation_repair
from .conversation_repair import oracle_sql as repair_sql
from .fingerprints import op10_fingerprints
from .language_id import op2_language_id
from .license_scan import copies_sql, license_scan_copies, op3_license_scan
from .license_scan import oracle_sql as license_sql
from .packing import op5_packing
from .personal_data import op6_personal_data
from .piece_codec import op9_piece_codec
from .quality_model import op7_quality_model
from .quality_rules import op1_quality_rules
from .ranked_search import ORACLE_SQL as SEARCH_SQL
from .ranked_search import op11_ranked_search
from .revisits import ORACLE_SQL as REVISIT_SQL
from .revisits import op4_revisits
from .shingle_join import op8_shingle_join
from .url_filter import op13_url_filter
from .url_filter import oracle_sql as url_sql

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_license_scan, license_scan_copies, op4_revisits, op5_packing, op6_personal_data, op7_quality_model, op8_shingle_join, op9_piece_codec, op10_fingerprints, op11_ranked_search, op12_conversation_repair, op13_url_filter)}
ORACLE_SQL: dict[str, str] = {"op3_license_scan": license_sql(), "license_scan_copies": copies_sql(), "op4_revisits": REVISIT_SQL, "op11_ranked_search": SEARCH_SQL, "op12_conversation_repair": repair_sql(), "op13_url_filter": url_sql()}
