"""The queries of this subpackage and the SQL that answers them where SQL can."""

from tidewatch.llm import decontam, secrets, urls
from tidewatch.llm.jaccard import op8_ngram_jaccard
from tidewatch.llm.packing import op1_packing
from tidewatch.llm.pages import op6_html_extraction
from tidewatch.llm.pii import op9_personal_data
from tidewatch.llm.quality import op7_quality_classifier
from tidewatch.llm.rules import op4_quality_rules
from tidewatch.llm.sharding import op5_sharding

QUERIES = {
    "op1_packing": op1_packing,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_url_filter": urls.op3_url_filter,
    "op4_quality_rules": op4_quality_rules,
    "op5_sharding": op5_sharding,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_personal_data": op9_personal_data,
    "op10_decontamination": decontam.op10_decontamination,
}

ORACLES: dict[str, str] = {
    "op2_secret_scan": secrets.SQL,
    "op3_url_filter": urls.SQL,
    "op10_decontamination": decontam.SQL,
}
