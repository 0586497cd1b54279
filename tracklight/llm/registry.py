"""The queries of this subpackage, with the SQL that checks them."""

from __future__ import annotations

from tracklight.llm.bestfit import op11_bestfit
from tracklight.llm.bpe import op9_bpe
from tracklight.llm.fingerprints import op4_fingerprints
from tracklight.llm.htmltext import op8_html
from tracklight.llm.licenses import op7_licenses
from tracklight.llm.licenses import oracle as licenses_oracle
from tracklight.llm.linededup import op3_lines
from tracklight.llm.merkle import op13_merkle
from tracklight.llm.merkle import oracle as merkle_oracle
from tracklight.llm.packing import op1_packing
from tracklight.llm.passages import op10_passages
from tracklight.llm.quality import op2_quality
from tracklight.llm.resampling import op12_resampling
from tracklight.llm.simhash import op6_simhash
from tracklight.llm.toxicity import op5_toxicity

QUERIES = {"op1_packing": op1_packing, "op2_quality": op2_quality, "op3_lines": op3_lines, "op4_fingerprints": op4_fingerprints, "op5_toxicity": op5_toxicity, "op6_simhash": op6_simhash, "op7_licenses": op7_licenses, "op8_html": op8_html, "op9_bpe": op9_bpe, "op10_passages": op10_passages, "op11_bestfit": op11_bestfit, "op12_resampling": op12_resampling, "op13_merkle": op13_merkle}
ORACLES: dict[str, str] = {"op7_licenses": licenses_oracle(), "op13_merkle": merkle_oracle()}
