"""The queries of this folder and their SQL, for the entry module."""

from sparkloom.llm import ann, decontaminate, html_text, minhash, mixing, packing, quality, spelling, suffix_dedup, toxicity, url_filter, warc, yinyang

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op4_nearest": ann.op4_nearest,
    "op5_quality": quality.op5_quality,
    "op6_html_text": html_text.op6_html_text,
    "op7_mix": mixing.op7_mix,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op8_near_duplicates": minhash.op8_near_duplicates,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_warc": warc.op10_warc,
    "op11_centroids": yinyang.op11_centroids,
    "op12_spelling": spelling.op12_spelling,
    "op13_packing": packing.op13_packing,
}
ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op7_mix": mixing.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_centroids": yinyang.ORACLE,
    "op12_spelling": spelling.ORACLE,
}
