"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from trajecta.llm.doc_sketch import op7_document_sketch
from trajecta.llm.html_extract import op6_html_extract
from trajecta.llm.language_id import op5_language_id
from trajecta.llm.mixing import op10_mixing
from trajecta.llm.neighbours import op2_nearest_neighbours
from trajecta.llm.secret_scan import op9_secret_scan
from trajecta.llm.sentencepiece_bpe import op8_sentencepiece
from trajecta.llm.sharding import op3_sharding
from trajecta.llm.simhash import op4_simhash
from trajecta.llm.url_filter import OP1_SQL, op1_url_filter

QUERIES = {"op1_url_filter": op1_url_filter, "op3_sharding": op3_sharding, "op8_sentencepiece": op8_sentencepiece, "op9_secret_scan": op9_secret_scan, "op5_language_id": op5_language_id, "op10_mixing": op10_mixing, "op4_simhash": op4_simhash, "op7_document_sketch": op7_document_sketch, "op6_html_extract": op6_html_extract, "op2_nearest_neighbours": op2_nearest_neighbours}
SQL = {"op1_url_filter": OP1_SQL}
