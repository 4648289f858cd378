"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP4_SQL, op4_chat_prefix_targets
from .decontaminate import OP6_SQL, op6_decontaminate
from .licenses import OP7_SQL, op7_license_diagonals
from .lines import OP9_SQL, op9_line_templates
from .lm import op10_language_model
from .mixing import op5_mix_sources
from .quality import OP3_SQL, op3_quality_divergence
from .secrets import op1_secret_scan
from .simhash import op8_simhash_pigeonring
from .warc import op2_warc_roundtrip

ALL = (
    op1_secret_scan,
    op2_warc_roundtrip,
    op3_quality_divergence,
    op4_chat_prefix_targets,
    op5_mix_sources,
    op6_decontaminate,
    op7_license_diagonals,
    op8_simhash_pigeonring,
    op9_line_templates,
    op10_language_model,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_divergence": OP3_SQL, "op4_chat_prefix_targets": OP4_SQL, "op6_decontaminate": OP6_SQL, "op7_license_diagonals": OP7_SQL, "op9_line_templates": OP9_SQL}
