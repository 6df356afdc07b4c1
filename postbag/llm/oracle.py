"""SQL counterparts for DuckDB, where SQL can express an operator."""

from postbag.llm.decontamination import CONTAMINATION_SQL
from postbag.llm.divergence import DIVERGENCE_SQL
from postbag.llm.fingerprints import FINGERPRINT_SQL
from postbag.llm.mixing import MIX_SQL

SQL = {
    "op3_source_mixing": MIX_SQL,
    "op9_document_fingerprints": FINGERPRINT_SQL,
    "op11_benchmark_decontamination": CONTAMINATION_SQL,
    "op13_source_divergence": DIVERGENCE_SQL,
}
