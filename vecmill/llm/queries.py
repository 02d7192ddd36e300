"""The subpackage's queries and the SQL that DuckDB can check them with."""

from __future__ import annotations

from vecmill.llm import bpe, forest, languages, licenses, media, packing, phrases, records, simhash, spelling, suffixes, toxicity, urls

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_packing": packing.op2_packing,
    "op3_suffixes": suffixes.op3_suffixes,
    "op4_languages": languages.op4_languages,
    "op5_simhash": simhash.op5_simhash,
    "op6_media": media.op6_media,
    "op7_forest": forest.op7_forest,
    "op8_licenses": licenses.op8_licenses,
    "op9_urls": urls.op9_urls,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_records": records.op11_records,
    "op12_phrases": phrases.op12_phrases,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES: dict[str, str] = {"op9_urls": urls.OP9_SQL, "op12_phrases": phrases.OP12_SQL, "op13_spelling": spelling.OP13_SQL}
