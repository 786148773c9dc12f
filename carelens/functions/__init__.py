"""Column expressions (JVM-side, codegen-friendly) shared by the operators."""

from .columns import (add_minutes, anon_id, clip01, dq_score, fmt_num,
                      hour_diff, missing_count, nan_to_null, round_avg,
                      scale_to_range, text_or)

__all__ = ["add_minutes", "anon_id", "clip01", "dq_score", "fmt_num",
           "hour_diff", "missing_count", "nan_to_null", "round_avg",
           "scale_to_range", "text_or"]
