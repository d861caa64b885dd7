"""Special functions that Spark lacks, from the mathematics library on its class path.

Spark treats these calls as nondeterministic: use them in a projection after an aggregation, never inside one.  Every
argument is guarded, as the library rejects nulls.
"""

from __future__ import annotations

_PACKAGE = "org.apache.commons.math3.special"


def erfc(x: str) -> str:
    """SQL for the complementary error function of an SQL expression; null for null."""
    return f"CASE WHEN ({x}) IS NOT NULL THEN cast(java_method('{_PACKAGE}.Erf', 'erfc', cast(({x}) AS double)) AS double) END"


def regularised_beta(x: str, a: str, b: str) -> str:
    """SQL for the regularised incomplete beta function I_x(a, b), 0 <= x <= 1; null for null or a, b not positive."""
    call = f"cast(java_method('{_PACKAGE}.Beta', 'regularizedBeta', cast(({x}) AS double), cast(({a}) AS double), cast(({b}) AS double)) AS double)"
    return f"CASE WHEN ({x}) <= 0 THEN 0D WHEN ({x}) >= 1 THEN 1D WHEN ({x}) > 0 AND ({a}) > 0 AND ({b}) > 0 THEN {call} END"


def student_two_sided(t: str, df: str) -> str:
    """SQL for the two-sided p-value of Student's t."""
    return regularised_beta(f"({df}) / (({df}) + ({t}) * ({t}))", f"({df}) / 2", "0.5D")
